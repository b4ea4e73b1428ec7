"""Inverted multi-index, prefix trie and importance resampling, against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusforge.llm import multi_index, prefix_trie, resampling
from tests.llm import messy


# ------------------------------------------------------------- embeddings
def brute_links(rows, cosine=0.93):
    """{row number: (links, component)} by the definition."""
    def good(v, label):
        return label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)
    n, root = [0] * len(rows), list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    unit = [np.array(v, np.float64) / np.linalg.norm(np.array(v, np.float64)) if good(v, lab) else None for _, v, lab, *_ in rows]
    for i in range(len(rows)):
        for j in range(i):
            if unit[i] is None or unit[j] is None or rows[i][2] != rows[j][2] or len(unit[i]) != len(unit[j]):
                continue
            if unit[i] @ unit[j] >= cosine:
                n[i] += 1
                n[j] += 1
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        k = find(i)
        least[k] = min(least.get(k, (True, 0)), (r[0] is None, r[0] if r[0] is not None else 0))
    return [(r[0], n[i], None if least[find(i)][0] else least[find(i)][1]) for i, r in enumerate(rows)]


def clustered(seed, groups, size, dims, noise):
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(groups):
        c = rng.standard_normal(dims)
        c /= np.linalg.norm(c)
        for _ in range(size):
            x = c + noise * rng.standard_normal(dims) / np.sqrt(dims)
            out.append([float(np.float32(v)) for v in x])
    return out


def test_index_finds_the_links_of_brute_force(spark):
    vecs = clustered(1, 12, 25, 16, 0.3) + clustered(2, 60, 1, 16, 0.0)  # cosines on both sides of 0.93, and strangers
    rows = [(i, v, i % 3) for i, v in enumerate(vecs)]
    rows += [(1000 + i, vecs[5], 2) for i in range(40)]  # copies
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(4)
    got = sorted(tuple(r)[:3] for r in multi_index.near_duplicates(df).collect())
    want = sorted(brute_links(rows))
    assert sum(w[1] for w in want) > 1000
    assert got == want  # with all vectors as queries, the reach meets every link


def test_index_blocks_and_a_hot_group(spark, monkeypatch):
    monkeypatch.setattr(multi_index, "BLOCK", 16)
    vecs = clustered(3, 1, 150, 8, 0.25) + clustered(4, 30, 2, 8, 0.2)
    rows = [(i, v, 0) for i, v in enumerate(vecs)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(4)
    assert sorted(tuple(r)[:3] for r in multi_index.near_duplicates(df).collect()) == sorted(brute_links(rows))


def test_index_recall_with_few_queries(spark):
    vecs = clustered(5, 80, 10, 32, 0.35)
    rows = [(i, v, i % 2) for i, v in enumerate(vecs)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r["vec_id"]: r["n_links"] for r in multi_index.near_duplicates(df, queries=40).collect()}
    want = {i: n for i, n, _ in brute_links(rows)}
    assert all(got[i] <= want[i] for i in want)  # no link under the cosine
    assert sum(got.values()) >= 0.95 * sum(want.values()) > 0


def test_index_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0, 0.0], 0), (2, [2.0, 0.0, 0.0], 0), (2, [2.0, 0.0, 0.0], 0), (3, [1.0, 0.0, 0.0], 1), (4, [1.0, 0.0, 0.0], None),
            (5, None, 0), (6, [], 0), (7, [0.0, 0.0, 0.0], 0), (8, [nan, 0.0, 0.0], 0), (9, [inf, 0.0, 0.0], 0),
            (10, [1.0, None, 0.0], 0), (11, [1.0, 0.0], 0), (12, [5.0, 0.0], 0), (None, [1.0, 0.01, 0.0], 0), (None, None, None),
            (13, [0.0, 1e-30, 0.0], 0), (14, [0.0, 1e30, 0.0], 0)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<float>, label int, uid long, root long")
    got = multi_index.near_duplicates(df).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted((tuple(r)[:3] for r in got), key=key) == sorted(brute_links(rows), key=key)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)
    assert multi_index.near_duplicates(df.limit(0)).count() == 0
    double = df.withColumn("embedding", F.col("embedding").cast("array<double>"))
    assert sorted((tuple(r)[:3] for r in multi_index.near_duplicates(double).collect()), key=key) == sorted(brute_links(rows), key=key)


# ------------------------------------------------------------- trie
def brute_trie(rows):
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {}
    for conv, r in by.items():
        def tie(x):
            d = hashlib.sha256(f"{len(x[2].encode())}:{x[2]}{x[3]}".encode()).hexdigest()
            return x[0], x[1], x[2], int(d[:15], 16), int(d[15:30], 16)
        turns[conv] = [(x[2], x[3]) for x in sorted(r, key=tie)]
    built = {}
    for c, own in turns.items():
        h = 0 if c is None else zlib.crc32(str(c).encode()) % 4
        head = [] if c is None else turns.get(int(c - math.fmod(c, 20)), [])
        built[c] = head[:h] + own[h:]
    members, ends = defaultdict(list), defaultdict(list)
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
        ends[tuple(seq)].append(c)
    order = lambda c: (c is not None, c or 0)
    kids = Counter(p[:-1] for p in members if p)
    saved, leaves = Counter(), Counter()
    for p, m in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            saved[p[:d]] += (len(m) - 1) * words
            leaves[p[:d]] += p not in kids

    def name(m):
        known = [c for c in m if c is not None]
        return min(known) if known else None
    out = []
    for p, m in members.items():
        listed = ",".join("" if c is None else str(c) for c in sorted(ends[p], key=order))
        out.append((name(m), len(p), name(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p],
                    hashlib.sha256(listed.encode()).hexdigest()))
    return out


def _sorted(rows):
    return sorted(tuple(rows_) for rows_ in rows) if not isinstance(rows, list) else sorted(rows, key=lambda r: tuple((x is None, x or 0) for x in r[:7]) + (r[7],))


def conversations(seed=2):
    rng = random.Random(seed)
    say = ["hello there", "yes", "no  thanks\n", "what is this?", "", "a b c d e", "é ñ 漢字"]
    rows = []
    for c in list(range(0, 90)) + [207, 215, 333, 341, -1, -7, -20]:
        if c in (40, 60):
            continue  # absent heads
        for t in range(rng.choice([1, 1, 2, 3, 5, 8])):
            rows.append((c, t, ["user", "assistant"][t % 2], rng.choice(say[:3])))
    copied = [(0, "system", "common"), (1, "user", "the same question"), (2, "assistant", "the same answer"), (3, "user", "bye now")]
    for c in range(1000, 1300):  # a group of copies
        rows += [(c, t, r, x) for t, r, x in copied]
    return rows


def test_trie_equals_brute_force(spark):
    rows = conversations()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    got = [tuple(r) for r in prefix_trie.trie(df).collect()]
    assert _sorted(got) == _sorted(brute_trie(rows))


@pytest.fixture
def spread(spark):
    """Sorted rows stay in as many partitions as the sort has, however few they are."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_trie_awkward_rows(spread):
    spark = spread
    rows = [(1, None, "user", "first"), (1, 0, None, None), (1, 0, "user", "tie b"), (1, 0, "user", "tie a"), (1, 2, "user", "x"), (1, 2, "user", "x"),
            (None, 0, "user", "no id"), (None, 1, "assistant", "at all"), (3, 0, "user", "w " * 30000), (20, 0, "user", "h"), (21, 0, "user", "i"),
            (4, 0, "", ""), (5, 0, None, None)]
    rows += [(2, t, "user", f"long {t % 7}") for t in range(120)]  # most rows are one conversation's
    rows += [(6, t, "user", f"long {t % 7}") for t in range(100)]
    df = spark.createDataFrame([(*r, 9, 9) for r in rows], "conv_id long, turn long, role string, text string, run long, pos int").repartition(6)
    got = [tuple(r) for r in prefix_trie.trie(df).collect()]
    assert _sorted(got) == _sorted(brute_trie(rows))
    assert prefix_trie.trie(df.limit(0)).count() == 0


def test_a_long_conversation_lies_in_several_runs(spread):
    spark = spread
    rows = [(7, t, "user", str(t)) for t in range(4000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    _, runs = prefix_trie.placed(prefix_trie.narrow_turns(df))
    sizes = [r["n"] for r in runs.collect()]
    assert sum(sizes) == 4000 and len(sizes) > 1 and max(sizes) < 4000


def test_ends_come_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "END_PIECE", 7)
    rows = [(c, 0, "user", "same") for c in range(1, 400) if zlib.crc32(str(c).encode()) % 4 == 0]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["depth"]: r for r in prefix_trie.trie(df).collect()}
    listed = ",".join(str(r[0]) for r in rows)
    assert got[1]["ends_sha256"] == hashlib.sha256(listed.encode()).hexdigest() and got[1]["n_convs"] == len(rows)


# ------------------------------------------------------------- resampling
def brute_resample(docs, target, percent=10, min_words=20, max_n=1, buckets=10_000):
    def feats(t):
        t = re.sub("[A-Z]", lambda m: m.group().lower(), t or "")
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)
        runs = [" ".join(w[i:i + n]) for n in range(1, max_n + 1) for i in range(len(w) - n + 1)]
        return len(w), [zlib.crc32(f.encode()) % buckets for f in runs]
    docs = [(i, *feats(t)) for i, t in docs]
    s, t = Counter(b for _, _, f in docs for b in f), Counter(b for x in target for b in feats(x)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log(((t[b] + 1) * (big_s + buckets)) / ((s[b] + 1) * (big_t + buckets)))) for b in range(buckets)]
    out = []
    for i, n, f in docs:
        w = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, n, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in out if r[1] >= min_words), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    able = able[:percent * len(able) // 100]
    return sorted((r[0] is None, r[0] or 0, *r[1:]) for r in out), [(r[0], r[4], k + 1) for k, r in enumerate(able)]


@pytest.mark.parametrize("max_n,percent,finish", [(1, 10, 64), (2, 37, 1), (1, 100, 1)])
def test_resample_equals_brute_force(spark, monkeypatch, max_n, percent, finish):
    monkeypatch.setattr(resampling, "CHUNK", 16)
    rng = random.Random(4)
    data = [*messy.rows(150), *[(500 + i, "the same words again and again " * 5, "aa") for i in range(120)]]
    target = [messy.words(rng, 40) for _ in range(5)] + [None, ""]
    want, drawn = brute_resample([(i, t) for i, t, _ in data], target, percent, max_n=max_n)
    got = resampling.resample(messy.table(spark, data), spark.createDataFrame([(x, 1) for x in target], "text string, rid int"),
                              percent=percent, max_n=max_n, finish=finish).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, *[r[c] for c in ("n_words", "n_features", "weight", "score")]) for r in got) == want
    ranked = sorted((r["rank"], r["doc_id"], r["score"]) for r in got if r["rank"] is not None)
    assert [(d, s, k) for k, d, s in ranked] == drawn


def test_cutoff_is_exact_on_ties(spark):
    rng = random.Random(6)
    keys = [(-rng.choice([5, 5, 5, 1, 9]), rng.randrange(40), i) for i in range(500)]
    df = spark.createDataFrame([(a, i is None, i, r) for a, i, r in keys], "neg long, nil boolean, doc_id long, rid long").repartition(5)
    order = sorted(keys)
    for take in (1, 2, 250, 499, 500):
        r = resampling.cutoff(df, take, finish=1)
        assert (r["neg"], r["doc_id"], r["rid"]) == order[take - 1]


def test_resample_empty_tables(spark):
    docs = messy.table(spark)
    none = spark.createDataFrame([], "text string")
    assert resampling.resample(docs.limit(0), none).count() == 0
    want, drawn = brute_resample([(i, t) for i, t, _ in messy.rows()], [])
    got = resampling.resample(docs, none).collect()
    assert sorted((r["rank"], r["doc_id"]) for r in got if r["rank"] is not None) == [(k, d) for d, _, k in drawn]
