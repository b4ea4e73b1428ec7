"""SimHash: fingerprints, links in blocks, components, keep-one, against brute force."""

import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from corpusforge.llm import simhash
from tests.llm import messy


def brute_fp(text, k=3):
    w = [x.decode() for x in (text or "").encode().lower().split()]
    if not w:
        return 0
    sh = [" ".join(w[i:i + k]) for i in range(len(w) - k + 1)] or [" ".join(w)]
    hs = [xxhash.xxh64_intdigest(s, seed=42) for s in sh]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def brute_components(fps, bits=3):
    u = sorted(set(fps))
    root = {x: x for x in u}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i, a in enumerate(u):
        for b in u[i + 1:]:
            if (a ^ b).bit_count() <= bits:
                root[find(a)] = find(b)
    return {x: find(x) for x in u}


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_every_pair_within_reach_shares_a_triple():
    rng = random.Random(3)
    for _ in range(3000):
        bytes_ = {rng.randrange(8) for _ in range(3)}
        assert any(not bytes_ & set(t) for t in simhash.TRIPLES)


def test_links_and_components_in_blocks(spark, monkeypatch):
    rng = random.Random(5)
    fps = {0, (1 << 64) - 1}
    for _ in range(6):  # dense balls, chains and strangers
        c = rng.getrandbits(64)
        for _ in range(60):
            x = c
            for _ in range(rng.randint(0, 6)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    fps |= {rng.getrandbits(64) for _ in range(200)}
    want = brute_components(fps)
    kinds = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
    for block in (2048, 8):
        monkeypatch.setattr(simhash, "BLOCK", block)
        got = {r["node"]: r["root"] for r in simhash.components(simhash.links(kinds)).collect()}
        groups = {}
        for x, r in want.items():
            groups.setdefault(r, set()).add(signed(x))
        for members in groups.values():
            assert {got.get(m, m) for m in members} == {min(members)}


def test_near_duplicates_and_keep_one(spark):
    docs = messy.table(spark)
    rows = messy.rows()
    fps = [brute_fp(t) for _, t, _ in rows]
    root = brute_components(fps)
    least = {}
    for (i, _, _), f in zip(rows, fps):
        r = root[f]
        least[r] = min(least.get(r, (True, 0)), (i is None, i or 0))
    want = sorted((i is None, i or 0, f"{f:016x}", None if least[root[f]][0] else least[root[f]][1]) for (i, _, _), f in zip(rows, fps))
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["fingerprint"], r["component_id"])
                 for r in simhash.near_duplicates(docs).collect())
    assert got == want
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    k = kept.collect()
    assert len(k) == len(set(root.values()))
    assert {root[brute_fp(r["text"])] for r in k} == set(root.values())
    again = simhash.keep_one(docs.where("doc_id = 102")).collect()  # only the repeated row
    assert len(again) == 1


def test_simhash_empty(spark):
    docs = messy.table(spark).limit(0)
    assert simhash.near_duplicates(docs).count() == 0
    assert simhash.keep_one(docs).count() == 0


def test_spark_hash_is_the_contract_hash(spark):
    got = spark.range(1).select(F.xxhash64(F.lit("abc é"))).first()[0]
    assert np.uint64(got & 0xFFFFFFFFFFFFFFFF) == xxhash.xxh64_intdigest("abc é".encode(), 42)


def test_links_of_more_bits(spark):
    rng = random.Random(11)
    base = [rng.getrandbits(64) for _ in range(20)]
    for bits in (4, 5, 7):
        far = []
        for b in base:  # one differing bit in each of ``bits`` bytes, half of them in each half
            places = [*rng.sample(range(4), bits // 2), *rng.sample(range(4, 8), bits - bits // 2)]
            far.append(b ^ sum(1 << 8 * p + rng.randrange(8) for p in places))
        want = brute_components(base + far, bits)
        assert len(set(want.values())) == 20
        kinds = spark.createDataFrame([(signed(x),) for x in base + far], "fp long")
        got = simhash.links(kinds, bits).collect()
        assert {frozenset((r["a"], r["b"])) for r in got} == {frozenset((signed(b), signed(f))) for b, f in zip(base, far)}
    for bits in (-1, 8):
        try:
            simhash.links(kinds, bits)
            raise AssertionError(bits)
        except ValueError:
            pass
