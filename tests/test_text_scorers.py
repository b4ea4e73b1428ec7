"""Scorers that cut texts into words themselves, and rows dealt out before the heavy steps."""

import random

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusforge.functions import kernels
from corpusforge.functions.text import rouge_tokens
from corpusforge.operators import scores
from corpusforge.plans import fixtures

ODD = ["The cat's 2nd-best_hat.\n\nIt sat", "", None, " \n ", "İstanbul Kelvin Über straße naïve", "a\tb\rc\x0bd\x85e f g", "日本 x1 😀y",
       "A" * 70 + "\nb", "Ünïted\nstates"]


def test_words_equal_the_column_form(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "i int, t string")
    lines = F.filter(F.transform(F.split("t", "\n"), rouge_tokens), lambda x: F.size(x) > 0)
    for r in df.select("i", "t", lines.alias("want")).collect():
        words = kernels.WordCodes()
        got = words.lines(None if r["t"] is None else r["t"].encode())
        names = {n: w.decode() for w, n in words.items()}
        assert [[names[n] for n in x] for x in got] == (r["want"] or [])


def test_suite_equals_the_single_scorers(spark):
    rng = random.Random(8)
    text = lambda: "\n".join(" ".join(rng.choice(["Running", "runs", "cat", "Cats.", "the", "İt"]) for _ in range(rng.randrange(9))) for _ in range(3))
    rows = [(1, i, text(), text()) for i in range(40)] + [(1, 90 + i, a, b) for i, (a, b) in enumerate([(None, "x"), ("x", None), ("", ""), ("x", "X"), ("x", "X")])]
    df = spark.createDataFrame(rows, "run_id long, doc_id long, summary string, output string")
    for stem in (False, True):
        names = ("rouge1", "rouge2", "rougeL", "rougeLsum")
        wide = scores.metric_suite(df, metrics=names, stem=stem)
        single = [scores.rouge_n(df, 1, stem=stem), scores.rouge_n(df, 2, stem=stem), scores.rouge_l(df, stem=stem), scores.rouge_lsum(df, stem=stem)]
        for name, one in zip(names, single):
            key = lambda d: sorted(tuple(r) for r in d.select("doc_id", name).collect())  # noqa: B023, E731
            assert key(wide) == key(one)
    assert "transform" not in scores.rouge_lsum(df)._jdf.queryExecution().optimizedPlan().toString()  # no token array goes to the Python step


def test_union_lcs_ends_when_the_candidate_has_nothing_left(monkeypatch):
    rng = random.Random(4)
    a = [[f"w{rng.randrange(80)}" for _ in range(30)] for _ in range(12)]
    b = [s[:10] + s[20:] for s in a]
    calls, plain = [], kernels._lcs_indices
    monkeypatch.setattr(kernels, "_lcs_indices", lambda *x: calls.append(1) or plain(*x))
    assert kernels.summary_lcs_hits(a, b) == (240, 360, 240)
    assert len(calls) <= 24  # not every sentence with every other one
    calls.clear()
    one = [[rng.choice("abc") for _ in range(300)]], [[rng.choice("abc") for _ in range(300)]]
    assert kernels.summary_lcs_hits(*one)[0] == kernels.lcs_length(one[0][0], one[1][0]) and not calls


def test_rows_of_one_row_group_are_dealt_out(spark, tmp_path):
    pq.write_table(pa.table({"doc_id": list(range(400)) + [None, 3], "lang": ["en"] * 402, "text": [f"A b{i}. C d. E f" for i in range(400)] + ["x", None]}),
                   tmp_path / "documents.parquet")
    d = fixtures.table(spark, str(tmp_path), "documents")
    out = fixtures.spread(d)
    sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) > 8 and max(sizes) < 100 and sorted(map(str, out.collect())) == sorted(map(str, d.collect()))
    pairs = fixtures.pred(spark, str(tmp_path), spread_out=True)
    assert sorted(map(str, pairs.collect())) == sorted(map(str, fixtures.pred(spark, str(tmp_path)).collect()))


def _documents(path, n=30):
    rng = random.Random(6)
    words = ["Runs", "running", "the", "cat", "über", "No", "12", "sat"]
    text = lambda: ". ".join(" ".join(rng.choice(words) for _ in range(rng.randrange(1, 9))) for _ in range(6))
    pq.write_table(pa.table({"doc_id": list(range(n)), "lang": ["en", "fr"] * (n // 2), "text": [text() for _ in range(n - 1)] + [None],
                             "source": ["s"] * n}), path / "documents.parquet")


def test_predictions_are_scored_and_measured_in_one_pass(spark, tmp_path):
    from corpusforge.operators import report, tokens
    from corpusforge.plans.catalog import REGISTRY
    _documents(tmp_path)
    out = REGISTRY["eval_predictions"](spark, str(tmp_path))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1  # the pairs, once
    got = {r["run_id"]: r for r in out.collect()}
    pairs = fixtures.paired_all(spark, str(tmp_path))
    size = lambda c: F.avg(F.size(tokens.text_pieces(c))).alias(c)
    for r in pairs.where("summary IS NOT NULL").groupBy("run_id").agg(size("summary"), size("output")).collect():
        assert (got[r["run_id"]]["mean_generated_len"], got[r["run_id"]]["mean_reference_len"]) == (r["summary"], r["output"])
    assert out.columns == ["run_id", "rouge1", "rouge2", "rougeL", "rougeLsum", "rouge_avg", "mean_generated_len", "mean_reference_len"]
    df = spark.createDataFrame([("g", [1, 0], [2, 3], 1.0), ("g", [1, 5], [0, 0], 2.0), ("h", None, [4], None)], "g string, p array<int>, l array<int>, x double")
    assert sorted(tuple(r) for r in report.mean_nonpad_len(df, ["g"], "p", "l", also=(F.avg("x").alias("x"),)).select("g", "mean_generated_len", "mean_reference_len", "x").collect()) \
        == [("g", 1.5, 1.0, 1.5), ("h", None, 1.0, None)]


def test_pieces_are_counted_in_batches(spark):
    from corpusforge.operators import tokens
    df = spark.createDataFrame([(["a", "b", "a", None],), (None,), ([],), (["b", "a", "<|im_end|>"],), (["c"],)], "p array<string>").repartition(2)
    v = tokens.build_vocabulary(df, "p", None)
    assert sorted(tuple(r) for r in v.collect()) == [("a", 4, 3), ("b", 5, 2), ("c", 6, 1)]
    plan = tokens.build_vocabulary(df, "p", 5)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "MapInArrow" in plan


def test_shared_rows_need_no_products():
    import numpy as np
    rng = np.random.default_rng(3)
    vec = rng.normal(size=(40, 6))
    unit = kernels.unit_rows(vec)
    for _ in range(30):
        p, r = (np.sort(rng.choice(40, rng.integers(1, 30), replace=False)) for _ in range(2))
        n_p, n_r = rng.integers(1, 5, len(p)), rng.integers(1, 5, len(r))
        want = kernels.greedy_match(vec[p], vec[r], n_p, n_r)
        assert all(np.allclose(kernels.greedy_rows(unit, p, r, n_p, n_r, own), want) for own in (True, False))
    short = vec.astype(np.float32)  # as a table of floats has them
    want = kernels.greedy_match(short[:9], short[5:30], np.ones(9), np.ones(25))
    assert np.allclose(kernels.greedy_rows(kernels.unit_rows(short), np.arange(9), np.arange(5, 30), np.ones(9), np.ones(25), True), want, rtol=1e-13)
    used = []

    class Seen(np.ndarray):
        def __getitem__(self, at):
            used.append(len(at))
            return np.asarray(self)[at]
    same = np.arange(10)
    assert kernels.greedy_rows(unit.view(Seen), same, same, np.ones(10), np.ones(10), True) == (1.0, 1.0, 1.0) and not used
    zero = np.array([[0.0, 0.0], [-1.0, 0.0], [1.0, 0.0]])
    got = kernels.greedy_rows(kernels.unit_rows(zero), np.array([0, 1]), np.array([0, 2]), np.ones(2), np.ones(2), False)
    assert np.allclose(got, kernels.greedy_match(zero[[0, 1]], zero[[0, 2]]))
    assert kernels.greedy_rows(unit, same[:0], same, np.ones(0), np.ones(10), True) == (0.0, 0.0, 0.0)


def test_word_pieces_and_ids_text(spark):
    from corpusforge.operators import tokens
    texts = [*ODD, "<|im_start|>user\nHi S E s<|im_end|>", "a<|im_start|im_end|>b<|IM_END|><|im_end|>", "Se E S"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    pattern = r"(<\|im_start\|>|<\|im_end\|>|[a-z0-9]+)"
    got = df.select("t", tokens.word_pieces("t").alias("p"), F.regexp_extract_all(F.lower("t"), F.lit(pattern), 1).alias("q"),
                    tokens.rouge_words("t").alias("w"), rouge_tokens("t").alias("v")).collect()
    assert all(r["p"] == r["q"] and r["w"] == r["v"] for r in got) and len(got) == len(texts)
    ids = spark.createDataFrame([([1, -100, 3],), ([],), (None,), ([None, 5, None],)], "a array<int>")
    joined = F.array_join(F.transform("a", lambda x: x.cast("string")), ",")
    assert all(r[0] == r[1] for r in ids.select(tokens.ids_text("a"), joined).collect())


def test_json_arrays_are_written_without_a_shuffle(spark, tmp_path):
    import os

    from corpusforge.sources import readers, sinks
    rows = [(i % 9 or None, ["en", "fr", None][i % 3], f'te"xt\n{i}' if i % 7 else None) for i in range(200)]
    rows += rows[:5]
    df = spark.createDataFrame(spark.sparkContext.parallelize(rows, 3), "doc_id long, lang string, input string")
    schema = "doc_id long, input string"
    for compression, end in (("none", ".json"), ("gzip", ".json.gz")):
        path = str(tmp_path / compression)
        jobs = spark.sparkContext.statusTracker()
        spark.sparkContext.setJobGroup(compression, compression)
        files = sinks.write_json_arrays(df, path, "lang", "doc_id", name="x", rows_per_file=20, compression=compression)
        spark.sparkContext.setJobGroup("after", "after")
        assert len(jobs.getJobIdsForGroup(compression)) == 1  # the write, and no exchange before it
        assert all(f.endswith(end) for f in files) and len(files) == len([f for f in os.listdir(path) if not f.startswith(".")])
        names = [f.rsplit("/", 1)[1] for f in files]
        back = readers.read_manifest(spark, path, names, T.StructType.fromDDL(schema))
        assert back.groupBy("source_file").count().agg(F.max("count")).first()[0] <= 20
        assert sorted(map(str, back.where("lang in ('en', 'fr')").select("doc_id", "lang", "input").collect())) == sorted(str(r) for r in df.where("lang IS NOT NULL").collect())
        assert back.count() == len(rows)
