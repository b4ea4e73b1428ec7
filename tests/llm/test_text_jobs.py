"""Language model, decontamination, packing and digests against brute force."""

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from corpusforge.llm import decontam, fingerprint, lm_hmm, packing
from corpusforge.llm.common import running
from tests.llm import messy

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


# ------------------------------------------------------------- running totals
def test_running_totals(spark):
    df = spark.range(500).withColumn("v", F.col("id") % 7).withColumn("r", (F.col("id") % 3).cast("int"))
    got = sorted(running(df, "v", ["id"], F.col("r")).collect(), key=lambda r: (r["lo"], r["hi"]))
    at = 0
    for r in got:
        assert r["lo"] == at and r["hi"] == at + r["v"]
        at = r["hi"]
    assert [r["r"] for r in got if r["v"]] == sorted(r["r"] for r in got if r["v"])


# ------------------------------------------------------------- op 1
def model_of(states=3, groups=9, seed=0):
    rng = np.random.default_rng(seed)
    return rng.dirichlet(np.ones(states)), rng.dirichlet(np.ones(states), states), rng.dirichlet(np.ones(groups), states).T


def brute_forward_backward(s, pi, a, e):
    al, be = np.zeros((len(s), len(pi))), np.ones((len(s), len(pi)))
    al[0] = pi * e[s[0]]
    ll = math.log(al[0].sum())
    al[0] /= al[0].sum()
    for t in range(1, len(s)):
        x = (al[t - 1] @ a) * e[s[t]]
        ll += math.log(x.sum())
        al[t] = x / x.sum()
    for t in range(len(s) - 2, -1, -1):
        be[t] = a @ (e[s[t + 1]] * be[t + 1])
        be[t] /= be[t].sum()
    g = al * be
    g /= g.sum(1, keepdims=True)
    n = np.zeros_like(a)
    for t in range(1, len(s)):
        x = al[t - 1][:, None] * a * (e[s[t]] * be[t])[None]
        n += x / x.sum()
    em = np.zeros_like(e)
    np.add.at(em, s, g)
    return ll, g[0], n, em


def test_chunked_recursions_are_exact(monkeypatch):
    monkeypatch.setattr(lm_hmm, "LANES", 3)
    m = model_of()
    rng = np.random.default_rng(1)
    seqs = [rng.integers(0, 9, n) for n in (1, 2, 63, 64, 65, 128, 129, 700)]
    want = [brute_forward_backward(s, *m) for s in seqs]
    assert np.allclose(lm_hmm.log_likelihoods(seqs, m), [w[0] for w in want])
    pi, trans, emit, ll = lm_hmm.expected_counts(seqs, m)
    assert math.isclose(ll, sum(w[0] for w in want))
    for got, k in ((pi, 1), (trans, 2), (emit, 3)):
        assert np.allclose(got, sum(w[k] for w in want))


def test_word_numbers_round_trip():
    for ids in ([], [0], [70_000, 1, 65_535], [1 << 24, 5, (1 << 32) - 1]):
        assert lm_hmm._unpacked(lm_hmm._packed(np.array(ids, np.uint32))).tolist() == ids


def test_baum_welch_raises_the_likelihood():
    rng = np.random.default_rng(2)
    seqs = [rng.integers(0, 5, 80) + 5 * (i % 2) for i in range(20)]
    overall = np.full(10, 0.1)
    lls = [sum(lm_hmm.log_likelihoods(seqs, lm_hmm.start_model(seqs, overall, 2, r))) for r in (0, 3, 10)]
    assert lls[0] < lls[1] <= lls[2] + 1


def test_scores_and_base(spark, monkeypatch):
    monkeypatch.setattr(lm_hmm, "BLOCK_WORDS", 50)  # many blocks
    docs = messy.table(spark)
    got = lm_hmm.score_documents(docs).collect()
    rows = messy.rows()
    tok = lambda t: [*[w.decode() for w in (t or "").encode().lower().split()], "\0"]
    fold = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    c = Counter()
    for i, t, _ in rows:
        if not fold(i):
            c.update(tok(t))
    n, v = sum(c.values()), len(c)
    want = sorted((i is None, i or 0, len(tok(t)), sum(c[w] > 0 for w in tok(t)), fold(i),
                   round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tok(t)), 6)) for i, t, _ in rows)
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"], r["n_known"], r["held_out"], round(r["base_score"], 6))
                  for r in got) == want
    assert {r["train_tokens"] for r in got} == {n}
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)
    assert sum(r["score"] for r in got) > sum(r["base_score"] for r in got)


def test_state_word_probabilities_sum_to_one(spark):
    docs = messy.table(spark)
    seqs, stats = lm_hmm.prepare(docs)
    pi, trans, emit = lm_hmm.train(seqs, stats)
    assert np.allclose(emit.sum(0), 1) and np.allclose(trans.sum(1), 1) and math.isclose(pi.sum(), 1)
    # in every group: its words and one unknown word share all of the group's probability
    assert math.isclose(stats["room"].sum(), stats["N"] + stats["V"] + lm_hmm.GROUPS)


def test_every_round_sees_every_training_document(spark, caplog):
    rng = np.random.default_rng(8)
    docs = messy.table(spark, [(k, " ".join(f"{'qr'[k % 40 == 0]}{w}" for w in rng.integers(0, 30_000, 60)), "aa") for k in range(700)])
    seqs, stats = lm_hmm.prepare(docs)
    assert stats["V"] > 16_000 and len(stats["room"]) == 2 * int(lm_hmm.GROWTH * stats["V"] ** 0.5) + 1 > lm_hmm.GROUPS
    with caplog.at_level("INFO", logger=lm_hmm.log.name):
        pi, trans, emit = lm_hmm.train(seqs, stats)
    lls = [float(r.message.rsplit(" ", 1)[1]) for r in caplog.records if r.name == lm_hmm.log.name]
    shards: dict = {}
    for r in seqs.where("train").select("shard", "groups").collect():
        shards.setdefault(r["shard"], []).append(np.frombuffer(r["groups"], stats["code"]))
    assert sum(map(len, shards.values())) > 500 and len(shards) == lm_hmm.SHARDS
    overall = stats["room"] / stats["room"].sum()
    want, held = lm_hmm.start_model([], overall), {}
    for _ in lls:  # every sweep visits every shard
        for k in range(lm_hmm.SHARDS):
            held[k] = lm_hmm.expected_counts(shards[k], want)
            want = lm_hmm.reestimate(*[sum(h[j] for h in held.values()) for j in range(3)], overall)
    assert all(np.allclose(a, b, rtol=0.02, atol=1e-5) for a, b in zip((pi, trans, emit), want))  # training runs in single precision
    assert math.isclose(lls[-1], sum(h[3] for h in held.values()), rel_tol=1e-4) and lls[-1] > lls[0]


def test_scores_follow_from_the_parameters(spark):
    docs = messy.table(spark)
    seqs, stats = lm_hmm.prepare(docs)
    pi, trans, emit = model = lm_hmm.train(seqs, stats)
    got = {(r["doc_id"], r["n_tokens"], round(r["base_score"], 6)): r["score"] for r in lm_hmm.score(seqs, stats, model).collect()}
    base = math.log10(stats["N"] + stats["V"] + 1)
    for r in seqs.collect():
        o = np.frombuffer(r["groups"], stats["code"]).astype(int)
        x, total = pi * emit[o[0]], 0.0
        for g in o[1:]:  # the plain forward recursion
            total += math.log10(x.sum())
            x = x / x.sum() @ trans * emit[g]
        want = total + math.log10(x.sum()) + r["log_c"] - np.log10(stats["room"])[o].sum()
        assert math.isclose(got[r["id"], r["n_tokens"], round(r["log_c"] - r["n_tokens"] * base, 6)], want, rel_tol=1e-9)


def test_language_model_without_training_rows(spark):
    held = [i for i in range(60) if zlib.crc32(str(i).encode()) % 7 == 2][:2]
    got = lm_hmm.score_documents(messy.table(spark, [(held[0], "a b", "aa"), (held[1], None, "aa")])).collect()
    assert sorted((r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in got) == [(1, 0, 0, 0.0), (3, 0, 0, 0.0)]
    assert lm_hmm.score_documents(messy.table(spark).limit(0)).count() == 0


# ------------------------------------------------------------- op 2
ITEM = "Yesterday Alice bought 3 apples for 5 dollars and then she sold 3 of them to her friend Robert for 9 dollars near the old market."


def test_templates_and_slots(spark):
    vary = lambda a, x, y, z: (ITEM.replace("Alice", a).replace("3 apples", f"{x} apples").replace("sold 3", f"sold {y}")
                               .replace("9 dollars", f"{z} dollars"))
    rng = np.random.default_rng(3)
    filler = " ".join(f"w{rng.integers(0, 9999)}x" for _ in range(60))
    data = [(1, ITEM, "aa"), (2, vary("Maria", 7, 7, 20), "aa"), (3, vary("Maria", 7, 8, 20), "aa"),  # 3: slots disagree
            (4, "Before. " + filler + " " + ITEM + " After " + filler, "aa"), (5, ITEM.upper(), "aa"),
            (6, "Alice bought apples.", "aa"), (7, None, "aa"), (8, "", "aa"), (None, ITEM, "aa"), (2, filler, "aa"), (1, ITEM, "aa")]
    docs = messy.table(spark, data)
    items = spark.createDataFrame([(10, ITEM), (11, None), (12, "short"), (13, ""), (14, ITEM)], "item_id long, text string")
    got = decontam.leaks(docs, items).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(d, i) for d in (1, 2, 4, 5, None) for i in (10, 14)}
    kept = decontam.drop_leaks(docs, items)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"], (r["text"] or "")[:3]) for r in kept.collect()) == sorted(
        [(3, "Yes"), (6, "Ali"), (7, ""), (8, ""), (2, filler[:3])])


def leaking(spark, texts, items):
    docs = messy.table(spark, [(k, t, "aa") for k, t in enumerate(texts)])
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return {(r["doc_id"], r["item_id"]) for r in decontam.leaks(docs, bench).collect()}


def test_sentence_marks_do_not_decide(spark):
    item = ("Alice went out. She bought 3 apples there. Nobody saw her do it. Later the old man sold 4 pears. "
            "Then both walked home. Their friend Robert had 7 plums left over.")
    bare, other = item.replace(".", ""), item.replace(".", ";")
    again = item.replace("Alice", "Maria").replace("3", "12")  # a name that opens a sentence
    short = "Alice sold 9 apples to her friend near the river before noon. Who has more of them now?"
    assert leaking(spark, [bare, other, again, bare.replace("Alice", "Maria"), bare.lower(),
                           short.replace("Alice", "Maria").replace("9", "4"), "So " + short], [item, short]) == {
        (0, 0), (1, 0), (2, 0), (3, 0), (4, 0), (5, 1), (6, 1)}


def test_edits_do_not_split_an_item(spark):
    items = ["the quick grey goose walks over a narrow bridge while seven small ducks swim below it",  # 16 tokens
             "Yesterday Alice bought 25 apples and then she sold 3 of them to her old friend near the town market hall."]
    w = items[0].split()
    added = [" ".join(w[:k] + ["zebra"] + w[k:]) for k in range(1, 16)]
    fewer = [" ".join(w[:k] + w[k + 1:]) for k in range(16)]
    other = [items[1].replace("Alice", "Maria Anna").replace("25", "17"), items[1].replace("25", "twenty five"),
             items[1].replace("25", "fifty-two").replace("Alice", "John Peter Paul")]
    got = leaking(spark, added + fewer + other + ["the quick grey goose walks over", " ".join(w[::-1])], items)
    assert got == {(k, 0) for k in range(31)} | {(31, 1), (32, 1), (33, 1)}


def test_items_without_informative_windows(spark):
    items = ["What is 15% of 80?", "Solve 1 2 3 4 5 6 7 8 9 10 11 12.", "Paris Berlin Rome Madrid 5 6 7 Oslo Wien Bern 3",
             "Name eight of the words in this line", "Why?", "...", "four tokens are here", ""]
    texts = [f"Zebra before, and {t.rstrip('.?').lower() if k % 2 else t} and zebra after" for k, t in enumerate(items)]
    texts += ["What is 15% of 81?", "Solve 12 11 10 9 8 7 6 5 4 3 2 1.", "name eight of the lines", "what is 15% of 80 " * 40]
    assert leaking(spark, texts, items) == {(0, 0), (1, 1), (2, 2), (3, 3), (4, 4), (6, 6), (11, 0)}


def test_decontamination_of_nothing(spark):
    docs = messy.table(spark)
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.leaks(docs, none).count() == 0
    assert decontam.drop_leaks(docs, none).count() == docs.count()
    assert decontam.drop_leaks(docs.limit(0), none).count() == 0


def test_leaks_against_whole_text_search(spark):
    sf = "/root/testdata/sf0.01"
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    got = {(r["doc_id"], r["item_id"]) for r in decontam.leaks(docs, items).collect()}
    texts = [(r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect()]
    want = {(d, r["item_id"]) for r in items.collect() for d, t in texts if r["text"] in t}
    assert want <= got and len(got - want) <= 2


@pytest.mark.parametrize("bits", [4, 12])
def test_a_full_filter_changes_nothing(spark, monkeypatch, bits):
    monkeypatch.setattr(decontam, "BLOOM_BITS", max(bits, 6))
    docs = messy.table(spark, [(1, ITEM, "aa"), (2, "nothing here at all but a few words that no item holds", "aa")])
    items = spark.createDataFrame([(10, ITEM)], "item_id long, text string")
    assert [(r["doc_id"], r["item_id"]) for r in decontam.leaks(docs, items).collect()] == [(1, 10)]


# ------------------------------------------------------------- op 3
def check_packing(got, texts, tiers):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(TOKENIZER)
    want = Counter()
    for t in texts:
        want[np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes()] += 1
    seqs, docs = {}, {}
    for r in got:
        assert zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"] > 0
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"], r["window"], r["step"]))
        docs.setdefault((r["doc_id"], r["doc_tokens"]), []).append((r["start"], bytes(r["ids"])))
    steps = Counter()
    for pieces in seqs.values():
        pieces.sort()
        at = 0
        for off, n, _, _ in pieces:
            assert off == at
            at += n
        assert {p[2] for p in pieces} == {at} and at <= max(tiers) and at & (at - 1) == 0
        assert len({p[3] for p in pieces}) == 1
        steps[pieces[0][3]] += at
    assert sorted(seqs) == list(range(len(seqs)))
    if steps:
        last = max(steps)
        assert {n for s, n in steps.items() if s != last} <= {packing.STEP_TOKENS} and steps[last] <= packing.STEP_TOKENS
    assert sum(len(b) for p in docs.values() for _, b in p) == sum(len(k) * n for k, n in want.items())
    for (i, n), p in docs.items():
        if i is not None and sum(len(b) for _, b in p) == 4 * n:  # a row of its own
            assert want[b"".join(b for _, b in sorted(p))]


@pytest.mark.parametrize("tiers", [(1024, 2048, 4096), (64, 128, 256), (32,)])
def test_packing(spark, tiers):
    got = packing.pack(messy.table(spark), TOKENIZER, tiers).collect()
    check_packing(got, [t for _, t, _ in messy.rows()], tiers)


def test_packing_of_nothing(spark):
    docs = messy.table(spark)
    assert packing.pack(docs.limit(0), TOKENIZER).count() == 0
    one = packing.pack(docs.where("doc_id = 104"), TOKENIZER).collect()
    assert [(r["length"], bytes(r["ids"])) for r in one] == [(1, np.array([2], "<u4").tobytes())]


# ------------------------------------------------------------- op 6
def test_entropy_levels():
    rng = np.random.default_rng(5)
    b = rng.integers(97, 105, 400).astype(np.uint8)
    w = fingerprint.WINDOW

    def level(x):
        c = np.unique(x, return_counts=True)[1]
        return int((1 - (c * np.log2(c)).sum() / (w * np.log2(w))) * (fingerprint.LEVELS - 1) + 0.5)
    assert fingerprint.entropy_levels(b).tolist() == [level(b[i:i + w]) for i in range(len(b) - w + 1)]
    assert len(fingerprint.entropy_levels(b[:w - 1])) == 0


def test_digest_does_not_depend_on_the_batch():
    import random
    rng = random.Random(6)
    texts = [messy.words(rng, n).encode() for n in (0, 1, 3, 20, 400, 6000)]
    rank = fingerprint.rarity(np.arange(fingerprint.LEVELS))
    whole = [fingerprint.text_form(d) for d in fingerprint.digests(texts, rank)]
    assert whole == [fingerprint.text_form(fingerprint.digests([t], rank)[0]) for t in texts]
    d = fingerprint.digests(texts, rank)
    assert all(fingerprint.likeness(x, x) > 0.999 for x in d)
    assert fingerprint.likeness(d[0], d[4]) == 0 and fingerprint.likeness(d[4], d[5]) < 0.3


def test_neighbours_and_edits(spark, monkeypatch):
    monkeypatch.setattr(fingerprint, "BUCKET", 5)
    rows = messy.rows()
    got = fingerprint.fingerprints(messy.table(spark)).collect()
    line = sorted([(i is None, -(i or 0), t or "") for i, t, _ in rows])
    want = []
    for k, (nil, i, t) in enumerate(line):
        nxt = line[(k + 1) % len(line)][2]
        c = len(t) // 3
        want.append((nil, -i, len(t), hashlib.sha256((t[:len(t) - c] + nxt[:c]).encode()).hexdigest()))
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_chars"], r["edited_sha256"]) for r in got) == sorted(want)
    by = {r["doc_id"]: r for r in got}
    assert by[100]["fingerprint"] == by[101]["fingerprint"] and by[101]["near_next"] == 1
    assert by[110]["near_edited"] > 0.5 and all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)


def test_digest_of_one_and_none(spark):
    docs = messy.table(spark)
    one = fingerprint.fingerprints(docs.where("doc_id = 3")).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1
    assert fingerprint.fingerprints(docs.limit(0)).count() == 0
