"""Forms that keep memory, time and shuffles in proportion to the input give the plain forms' results."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from corpusforge.functions import kernels
from corpusforge.functions.text import ngrams
from corpusforge.operators import annotate as ann
from corpusforge.operators import scores, sentences, tokens
from corpusforge.session import BATCH_BYTES
from tests import plain_lcs


def _pieces(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    rows = [(i, [rng.choice(words) for _ in range(rng.randrange(12))], None if i % 7 == 0 else [rng.choice(words + ["new"]) for _ in range(5)])
            for i in range(80)]
    return spark.createDataFrame(rows + [rows[0]], "k int, a array<string>, b array<string>").repartition(3)


def test_large_vocabulary_joins_the_distinct_pieces_of_blocks(spark, monkeypatch):
    df = _pieces(spark)
    vocab = tokens.build_vocabulary(df.select(F.col("a").alias("p")), "p", None)
    small = tokens.Vocabulary(vocab)
    monkeypatch.setattr(tokens, "MAX_BROADCAST_VOCAB", 2)
    monkeypatch.setattr(tokens, "BLOCK_VALUES", 40)
    large = tokens.Vocabulary(vocab)
    assert small.shared is not None and large.shared is None
    out = []
    for v in (small, large):
        e = tokens.encode(df, ["a", "b"], v, ["ia", "ib"], keep=False)
        assert e.columns == ["k", "ia", "ib"]
        d = tokens.decode(e, ["ia", "ib"], v, ["ta", "tb"])
        out.append(sorted((tuple(r) for r in d.collect()), key=repr))
    assert out[0] == out[1] and len(out[1]) == 81
    # only the distinct pieces of a block meet the vocabulary, not every piece of every row
    st = tokens.coded(df, ["a", "b"], False)
    n = st.agg(F.sum(F.size("_codes0")), F.sum(F.size("_codes1")), F.count_distinct("_block")).first()
    met = tokens.entries(st, "token")
    assert n[2] > 5 and met.count() < n[0] + (n[1] or 0)
    assert met.groupBy("_of", "token").count().where("count > 1").count() == 0


def test_n_gram_counts_from_codes(spark):
    rng = random.Random(5)
    rows = [(1, i, *(None if rng.random() < 0.1 else " ".join(rng.choice("abc") for _ in range(rng.randrange(9))) for _ in range(2))) for i in range(60)]
    df = spark.createDataFrame(rows, "run_id long, doc_id long, summary string, output string")
    for n in (1, 2, 3):
        key = lambda d: sorted(tuple(r) for r in d.collect())
        assert key(scores.rouge_n(df, n)) == key(scores.rouge_n(df, n, method="relational"))
    # the n-grams themselves never reach the Python step
    assert "transform" not in scores.rouge_n(df, 2)._jdf.queryExecution().optimizedPlan().toString()
    assert df.select(F.size(ngrams(F.split("summary", " "), 2))).count() == 60


def test_union_lcs_is_exact_and_stops_early(monkeypatch):
    rng = random.Random(11)
    for _ in range(150):
        words = "abcdef"[:rng.randrange(2, 7)]
        a, b = ([[rng.choice(words) for _ in range(rng.randrange(7))] for _ in range(rng.randrange(6))] for _ in range(2))
        a, b = [s for s in a if s], [s for s in b if s]
        left, hits = [t for s in b for t in s], 0
        for rs in a:
            for i in sorted({i for cs in b for i in plain_lcs.lcs_indices_table([ord(t) for t in rs], [ord(t) for t in cs])}):
                if rs[i] in left:
                    left.remove(rs[i])
                    hits += 1
        want = hits if a and b else 0
        assert kernels.summary_lcs_hits(a, b)[0] == want
        x, y = sum(a, []), sum(b, [])
        assert kernels.lcs_length(x, y) == plain_lcs.lcs_length_dp(x, y)
    calls = []
    plain = kernels._lcs_indices
    monkeypatch.setattr(kernels, "_lcs_indices", lambda *x: calls.append(1) or plain(*x))
    # each sentence is settled by the candidate that holds all of its tokens but the order
    a = [[f"x{i}", "the", f"y{i}", "of"] for i in range(200)]
    b = [[f"x{i}", "the", "and", f"y{i}", "of"] for i in range(200)]
    assert kernels.summary_lcs_hits(a, b)[0] == 800 and len(calls) == 200


def test_type_counts_are_staged_once(spark, monkeypatch):
    made = []
    plain = ann.materialize
    monkeypatch.setattr(ann, "materialize", lambda df, name="x": made.append(name) or plain(df, name))
    docs = spark.createDataFrame([(f"Dr. Who came. He left at {i}. The end.", "en") for i in range(20)], "text string, lang string")
    sentences.train(docs, "text", "lang")
    assert made == ["type-counts"]


def test_python_steps_get_small_batches(spark):
    text = "word " * 20_000
    sizes = spark.range(400, numPartitions=1).select(F.concat(F.lit(text), "id").alias("t")).mapInArrow(
        lambda bs: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"]) for b in bs), "n long").collect()
    assert len(sizes) > 2 and max(r["n"] for r in sizes) <= BATCH_BYTES + 2 * len(text)
    batch = pa.RecordBatch.from_arrays([pa.array([text] * 100)], ["t"])
    parts = list(ann.row_slices(batch, 1 << 20))
    assert sum(p.num_rows for p in parts) == 100 and max(p.num_rows for p in parts) <= 11


def test_flat_codes_keep_nulls_apart():
    (shape,), codes, values = tokens.flat_codes([pa.array([["a", None], None, [], ["b", "a"]])])
    assert shape[0].tolist() == [2, 0, 0, 2] and shape[1].to_pylist() == [False, True, False, False]
    assert codes.tolist() == [0, -1, 1, 0] and values.to_pylist() == ["a", "b"]
    assert np.array_equal(kernels.clipped_ngrams(np.array([0, 1, 0, 1, 1, 0]), np.array([3, 0]), np.array([2, 1]), 2), [0, 0])


def test_greedy_match_by_blocks(spark, monkeypatch):
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(30)]
    # a word with two vectors, one with a null, one with none
    rows = [(w, rng.normal(size=4).tolist()) for w in words[2:]] + [(words[5], rng.normal(size=4).tolist()), (words[1], None)]
    table = spark.createDataFrame(rows, "token string, vec array<float>")
    pairs = [(1, i, [words[j] for j in rng.integers(0, 30, rng.integers(0, 8))], [words[j] for j in rng.integers(0, 30, rng.integers(0, 8))]) for i in range(40)]
    pairs += [(1, 40, ["w0"], ["w1"]), (1, 41, ["w0"], ["w7", "w7"])]
    df = spark.createDataFrame(pairs, "run_id long, doc_id long, pred array<string>, ref array<string>")
    sides = df.select("run_id", "doc_id", F.explode(F.array(*[F.struct(F.lit(c).alias("side"), F.col(c).alias("t")) for c in ("pred", "ref")])).alias("x"))
    one = sides.select("run_id", "doc_id", "x.side", F.explode("x.t").alias("token")).join(table.where("vec IS NOT NULL"), "token")
    want = {r["doc_id"]: r[2:] for r in scores.greedy_embedding_match(one).collect()}
    monkeypatch.setattr(scores, "GREEDY_VALUES", 50)
    got = {r["doc_id"]: r[2:] for r in scores.greedy_embedding_match(df, vectors=lambda t: t.join(table, "token")).collect()}
    assert got.keys() == want.keys() and 40 not in got and 41 in got
    assert all(np.allclose(got[k], want[k]) for k in want)
