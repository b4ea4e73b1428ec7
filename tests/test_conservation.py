"""Rows in = rows out: null groups, refused records, restarts, large vocabularies."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusforge.config import SplitConfig
from corpusforge.functions import kernels
from corpusforge.operators import annotate as ann
from corpusforge.operators import prep, report, scores, tokens
from corpusforge.operators.rank import ordered_rank
from corpusforge.operators.split import seeded_order, split_leakage, stratified_split
from corpusforge.sources import sinks
from corpusforge.streaming import jobs


def test_null_groups_are_split_like_any_other(spark):
    df = spark.range(1000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 5 > 0, F.concat(F.lit("l"), F.col("id") % 5)).alias("lang"))
    got = {(r["lang"], r["split"]): r["count"] for r in stratified_split(df, ["lang"]).groupBy("lang", "split").count().collect()}
    assert got == {(lang, s): n for lang in (None, "l1", "l2", "l3", "l4") for s, n in (("train", 160), ("valid", 2), ("test", 38))}
    assert seeded_order(df, ["lang"]).count() == 1000
    assert ordered_rank(df.withColumn("t", F.when(F.col("doc_id") > 3, F.col("doc_id"))), ["lang"], ["t", "doc_id"]).count() == 1000


def test_split_equals_the_ranks(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), (F.col("id") % 3).cast("string").alias("lang"))
    cfg = SplitConfig(0.5, 0.25, 0.25, seed=9)
    pos = {r["doc_id"]: r["pos"] for r in seeded_order(df, ["lang"], seed=9).collect()}
    for r in stratified_split(df, ["lang"], cfg=cfg).collect():
        p = pos[r["doc_id"]]
        assert r["split"] == ("train" if p <= 500 else "valid" if p <= 750 else "test")
    test = stratified_split(df, ["lang"], cfg=cfg, keep=("test",))
    assert test.count() == 750 and test.columns == ["doc_id", "lang", "split"]


def test_split_moves_no_text(spark):
    df = spark.range(100).select(F.col("id").alias("doc_id"), F.lit("a").alias("lang"), F.lit("long").alias("input"))
    plan = stratified_split(df.repartition(2).cache(), ["lang"])._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in plan.split("\n") if "Exchange hashpartitioning" in x and "input" in x]


def test_leakage_sees_lost_records(spark):
    src = spark.range(100).select(F.col("id").alias("doc_id"), F.lit("a").alias("lang"), F.col("id").cast("string").alias("input"))
    s = stratified_split(src, ["lang"])
    row = {r["check"]: r["value"] for r in split_leakage(s.where("doc_id <> 7"), source=src).collect()}
    assert row == {"key_overlap": 0, "missing": 1, "text_leak": 0}


def short_model():
    class Short:
        """Answers one prompt fewer than it is asked when it gets several."""

        def ask(self, batch):
            return [p[:3] for p in batch][:max(1, len(batch) - 1)]
    return Short


def deaf_model():
    class Deaf:
        def ask(self, batch):
            return [None for _ in batch]
    return Deaf


@pytest.mark.parametrize("model,good", [(short_model, 3), (deaf_model, 0)])
def test_annotation_keeps_every_record(spark, model, good):
    df = spark.createDataFrame([(1, "aaa"), (2, None), (3, "bbb"), (4, "ccc")], "k int, input string").coalesce(1)
    a = ann.materialize(ann.annotate(df, "P {input}", "out", model(), batch_size=4, attempts=2))
    ok, bad = ann.split_rejects(a, "out")
    assert ok.count() == good and ok.count() + bad.count() == 4
    assert {r["k"]: r["error"] for r in bad.collect()}[2] == "null prompt"


def test_chain_keeps_the_first_error(spark):
    df = spark.createDataFrame([(1, "short"), (2, "x" * 90), (3, None)], "k int, input string")
    steps = [{"prompt": "P {input}", "out": "a"}, {"prompt": "Q {a}", "out": "b"}]
    got = ann.materialize(ann.annotate_chain(df, steps, lambda: ann.PrefixModel(50, max_prompt_chars=60), attempts=2))
    ok, bad = ann.split_rejects(got, "b")
    assert [r["k"] for r in ok.collect()] == [1]
    assert {r["k"]: r["error"] for r in bad.collect()} == {2: "a: ValueError: prompt too long", 3: "a: null prompt"}


def test_export_writes_every_row_or_fails(spark, tmp_path):
    df = spark.createDataFrame([("a.txt", "é"), ("b.txt", None)], "name string, body string")
    sinks.export_text_files(df, str(tmp_path / "out"), "name", "body")
    assert {p.name: p.read_text() for p in (tmp_path / "out").iterdir()} == {"a.txt": "é", "b.txt": ""}
    with pytest.raises(ValueError):
        sinks.export_text_files(df.select(F.lit(None).cast("string").alias("name"), "body"), str(tmp_path / "out"), "name", "body")
    (tmp_path / "file").write_text("")
    with pytest.raises(Exception):
        sinks.export_text_files(df, str(tmp_path / "file"), "name", "body")


def test_large_vocabulary_is_joined(spark, monkeypatch):
    df = spark.createDataFrame([(1, "a b b c zz"), (2, ""), (3, None), (4, "c c é new")], "k int, t string")
    df = df.select("k", tokens.word_pieces("t").alias("p"))
    whole = tokens.build_vocabulary(df, "p", None)
    top = tokens.build_vocabulary(df, "p", 100)
    assert sorted(whole.collect()) == sorted(top.collect())
    small = tokens.Vocabulary(whole)
    monkeypatch.setattr(tokens, "MAX_BROADCAST_VOCAB", 2)
    large = tokens.Vocabulary(whole)
    assert small.shared is not None and large.shared is None
    out = []
    for v in (small, large):
        e = tokens.encode(df, "p", v).where("p IS NOT NULL")
        out.append(sorted((r["k"], r["ids"], r["text"]) for r in tokens.decode(e, "ids", v).collect()))
    assert out[0] == out[1] and out[0][0][2] == "a b b c zz"


def test_joined_vocabulary_keeps_null_texts(spark, monkeypatch):
    df = spark.createDataFrame([(1, "a b b c zz"), (2, ""), (3, None), (4, "c é new")], "k int, t string")
    df = df.select("k", tokens.word_pieces("t").alias("p"))
    whole = tokens.build_vocabulary(df, "p", None)
    made = [tokens.Vocabulary(whole)]
    monkeypatch.setattr(tokens, "MAX_BROADCAST_BYTES", 4)
    made.append(tokens.Vocabulary(whole))
    assert made[0].shared is not None and made[1].shared is None  # few entries, but many bytes
    out = []
    for v in made:
        e = tokens.encode(df, "p", v)
        e = e.withColumn("text", tokens.pad_truncate("ids", 4)[0])
        out.append(sorted((r["k"], r["ids"], r["text"]) for r in e.collect()))
    assert out[0] == out[1] and out[1][2] == (3, None, None) and out[1][1] == (2, [], [0, 0, 0, 0])


def test_foreign_tokenizer_and_left_padding(spark):
    class Chars:
        def encode(self, t):
            return [ord(c) for c in t]
    df = spark.createDataFrame([("ab",), (None,)], "t string")
    assert [r["ids"] for r in tokens.encode_with(df, "t", Chars).collect()] == [[97, 98], None]
    ids, mask = tokens.pad_truncate(F.array(F.lit(7), F.lit(8)), 4, padding_side="left")
    r = spark.range(1).select(ids.alias("i"), mask.alias("m")).first()
    assert r["i"] == [0, 0, 7, 8] and r["m"] == [0, 0, 1, 1]


def test_scores_do_not_depend_on_partitions(spark):
    df = spark.createDataFrame([(i, float(i % 7)) for i in range(200)], "k int, v double").withColumn("g", F.lit("x"))
    a, b = (scores.bootstrap_ci(df.repartition(n), ["g"], "k", "v", replicates=20).first() for n in (1, 5))
    assert all(abs(a[c] - b[c]) < 1e-9 for c in ("low", "mid", "high"))


def test_greedy_match_in_blocks(monkeypatch):
    rng = np.random.default_rng(0)
    p, r = rng.standard_normal((30, 4)), rng.standard_normal((50, 4))
    whole = kernels.greedy_match(p, r)
    monkeypatch.setattr(kernels, "GREEDY_BLOCK", 7)
    assert np.allclose(kernels.greedy_match(p, r), whole)
    twice = kernels.greedy_match(p[:2], r, np.array([1, 3]), None)
    assert np.isclose(twice[0], kernels.greedy_match(np.vstack([p[:1], p[1:2], p[1:2], p[1:2]]), r)[0])


def test_non_text_field_is_skipped(spark):
    df = spark.createDataFrame([(7, "a")], "n int, t string")
    got = df.select(*[F.length(prep.field_or_empty(df, c)).alias(f"c{i}") for i, c in enumerate(("n", "t", "gone"))]).first()
    assert tuple(got) == (None, 1, 0)


def test_shifted_accuracy(spark):
    rows = [(0, 0, [0.0, 1.0], 5), (0, 1, [1.0, 0.0], 1), (0, 2, [1.0, 0.0], 0), (1, 0, [1.0, 0.0], 9), (1, 1, [1.0, 0.0], -100)]
    df = spark.createDataFrame(rows, "s int, p int, logits array<double>, label int")
    r = report.token_accuracy(df, [], "logits", "label", shift_by=(["s"], "p")).first()
    assert r["positions"] == 3 and abs(r["accuracy"] - 2 / 3) < 1e-9 and r["accuracy_ignore_index"] == 1.0


def test_stream_leaderboard_restarts(spark, tmp_path):
    base = str(tmp_path)
    refs = spark.createDataFrame([(i, "s", "a b c d") for i in range(6)], "doc_id long, subtask string, output string")
    schema = "run_id long, doc_id long, summary string"

    def land(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{base}/in")

    def call():
        t = jobs.stream_leaderboard(spark, f"{base}/in", spark.createDataFrame([], schema).schema, refs, f"{base}/state",
                                    f"{base}/ckpt", files_per_batch=1)
        return sorted((r["run_id"], r["subtask"], r["rouge1"]) for r in t.collect())
    land([(1, 0, "a b c d"), (1, 1, "x")])
    land([(1, 2, "a b c d"), (1, 0, "x x x")])  # (1, 0) lands again: counted once
    first = call()
    assert first == [(1, "s", round(2 / 3, 4))]
    assert call() == first  # nothing new
    land([(2, 3, "a b c d")])
    assert call() == [(1, "s", round(2 / 3, 4)), (2, "s", 1.0)]
    assert len(list((tmp_path / "state" / "cells").iterdir())) <= 2


def test_stream_dedup_over_two_calls(spark, tmp_path):
    base = str(tmp_path)
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    for n in (2, 2, 3):
        df.unionByName(spark.createDataFrame([(n, "c")], df.schema)).coalesce(1).write.mode("append").parquet(f"{base}/in")
        out = jobs.stream_dedup(spark, f"{base}/in", df.schema, "k", f"{base}/out", f"{base}/ckpt")
    assert sorted(r["k"] for r in out.collect()) == [1, 2, 3]


def test_split_config_rejects_what_is_no_partition():
    for bad in (SplitConfig(0.8, 0.1, 0.2), SplitConfig(1.2, -0.1, -0.1)):
        with pytest.raises(ValueError):
            bad.check()


def test_scorers_of_your_own(spark):
    df = spark.createDataFrame([(1, 1, "a b", "a b c d")], "run_id int, doc_id int, summary string, output string")
    extra = {"ratio": lambda p, r: F.length(p) / F.length(r), "len": lambda p, r: {"p": F.length(p), "r": F.length(r)}}
    r = scores.metric_suite(df, metrics=("rouge1", "ratio", "len"), scorers=extra).first()
    assert r["ratio"] == 3 / 7 and (r["len_p"], r["len_r"]) == (3, 7) and abs(r["rouge1"] - 2 / 3) < 1e-9
    with pytest.raises(ValueError):
        scores.metric_suite(df, metrics=("unknown",))
