"""Hand-worked cases (FIXTURES.md section 4) and properties, on Spark."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusforge.config import SUMMARIZE_PROMPT, SplitConfig
from corpusforge.functions import prompts, text
from corpusforge.operators import joins, report, scores, tokens
from corpusforge.operators.split import split_bounds, stratified_split


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


def test_crop_code_points(spark):
    assert one(spark, text.crop(F.lit("😀abc"), 2)) == "😀a"


def test_sanitize(spark):
    s = " a\u0085b c\u001c d\t\n"
    assert one(spark, text.sanitize_text(F.lit(s))) == "a b c d"


def test_summary_file_name(spark):
    assert one(spark, text.summary_file_name(F.lit("x/case_1.txt"))) == "case_1_sum.txt"
    assert one(spark, text.summary_file_name(F.lit("a.b.txt"))) == "b_sum.txt"
    assert one(spark, text.summary_file_name(F.lit("noext"))) is None
    with pytest.raises(Exception):
        one(spark, text.summary_file_name(F.lit("noext"), strict=True))


def test_subtask_lang(spark):
    assert one(spark, text.subtask_lang(F.lit("casesum_test_es"))) == "es"


def test_rouge_tokens(spark):
    assert one(spark, text.rouge_tokens(F.lit("Texto clínico, 62 y.o"))) == ["texto", "cl", "nico", "62", "y", "o"]


def test_training_prompt_and_prefix(spark):
    p = one(spark, prompts.training_prompt("I", F.lit("T"), F.lit("S")))
    assert p == "<|im_start|>user\nI:\nT\n<|im_end|>\n<|im_start|>assistant\nS\n<|im_end|>"
    pre = one(spark, prompts.prompt_prefix(F.lit(p)))
    assert pre.endswith("<|im_end|>\n") and "assistant" not in pre


def test_localised_prompt(spark):
    df = spark.createDataFrame([("fr",), ("de",)], "lang string")
    got = {r.lang: r.instruction for r in joins.localised_prompt(df, spark, on_missing="default").collect()}
    assert got == {"fr": "Résumer le texte clinique", "de": SUMMARIZE_PROMPT}
    with pytest.raises(Exception):
        joins.localised_prompt(df, spark, on_missing="error").collect()


def test_chat_reply(spark):
    df = spark.createDataFrame([('{"choices":[{"message":{"content":" hi \\n"}}]}',), ("{}",)], "r string")
    assert [r.c for r in df.select(prompts.chat_reply_content("r").alias("c")).collect()] == ["hi", None]


# ------------------------------------------------------------------ split
def _split_sizes(spark, n, cfg=SplitConfig()):
    df = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("en").alias("lang"))
    out = stratified_split(df, ["lang"], "doc_id", cfg)
    return {r.split: r.c for r in out.groupBy("split").agg(F.count("*").alias("c")).collect()}


def test_split_counts(spark):
    assert _split_sizes(spark, 100) == {"train": 80, "valid": 1, "test": 19}
    assert _split_sizes(spark, 129) == {"train": 103, "valid": 1, "test": 25}


def test_split_ratio_rules(spark):
    te, _ = split_bounds(F.lit(100), SplitConfig(0.29, 0.01, 0.70))
    assert one(spark, te) == 28
    with pytest.raises(ValueError):
        SplitConfig(0.8, 0.1, 0.2).check()


@given(st.integers(min_value=1, max_value=400), st.integers(min_value=1, max_value=9))
@settings(max_examples=8, deadline=None)
def test_split_exact_and_partition_independent(spark, n, parts):
    df = spark.range(n).select(F.col("id").alias("doc_id"), (F.col("id") % 3).cast("string").alias("lang"))
    a = {(r.doc_id, r.split) for r in stratified_split(df, ["lang"], "doc_id").collect()}
    b = {(r.doc_id, r.split) for r in stratified_split(df.repartition(parts), ["lang"], "doc_id").collect()}
    assert a == b and len(a) == n  # complete, disjoint, deterministic
    for g in range(3):
        m = len([i for i in range(n) if i % 3 == g])
        got = sum(1 for d, s in a if d % 3 == g and s == "train")
        assert got == int(m * 0.8)


# ------------------------------------------------------------------ tokens
def test_pad_truncate_and_masks(spark):
    ids = F.array(*[F.lit(x) for x in [5, 6, 7, 8, 9, 4]])
    p8, m8 = tokens.pad_truncate(ids, 8)
    assert one(spark, p8) == [5, 6, 7, 8, 9, 4, 0, 0] and one(spark, m8) == [1, 1, 1, 1, 1, 1, 0, 0]
    p4, m4 = tokens.pad_truncate(ids, 4)
    assert one(spark, p4) == [5, 6, 7, 8] and one(spark, m4) == [1, 1, 1, 1]
    assert one(spark, tokens.mask_labels(p8, F.lit(3), "prompt")) == [-100, -100, -100, 8, 9, 4, 0, 0]
    assert one(spark, tokens.mask_labels(p8, F.lit(3), "as_written")) == [-100] * 8
    assert one(spark, tokens.mask_labels(p8, F.lit(3), "full")) == [5, 6, 7, 8, 9, 4, -100, -100]
    u = tokens.unmask_labels(F.array(F.lit(-100), F.lit(8), F.lit(9)))
    assert one(spark, u) == [0, 8, 9] and one(spark, report.nonpad_len(u)) == 2


def test_argmax_and_accuracy(spark):
    assert one(spark, report.argmax(F.array(F.lit(0.1), F.lit(0.7), F.lit(0.7)))) == 1
    onehot = lambda k: [1.0 if i == k else 0.0 for i in range(10)]
    df = spark.createDataFrame([(onehot(p), lab) for p, lab in [(1, -100), (2, 2), (3, 3), (4, 9)]],
                               "logits array<double>, label int")
    r = report.token_accuracy(df, [], "logits", "label").first()
    assert r.accuracy == 0.5 and abs(r.accuracy_ignore_index - 2 / 3) < 1e-12


def test_encode_decode_roundtrip(spark):
    df = spark.createDataFrame([(1, "the cat sat on the mat"), (2, "a dog")], "doc_id long, t string")
    df = df.select("doc_id", tokens.word_pieces("t").alias("p"))
    vocab = tokens.build_vocabulary(df, "p", 4)
    enc = tokens.encode(df, "p", vocab)
    rel = tokens.encode_relational(df, ["doc_id"], "p", vocab)
    a = {r.doc_id: list(r.ids) for r in enc.collect()}
    b = {r.doc_id: list(r.ids) for r in rel.collect()}
    assert a == b
    dec = {r.doc_id: r.text for r in tokens.decode(enc, "ids", vocab).collect()}
    kept = {r.token for r in vocab.collect()}
    assert dec[1] == " ".join(w for w in "the cat sat on the mat".split() if w in kept)


# ------------------------------------------------------------------ reports
def test_length_stats(spark):
    df = spark.createDataFrame([("x" * i,) for i in range(10)], "t string").withColumn("g", F.lit(1))
    r = report.length_stats(df, ["g"], "t").first()
    assert (r["count"], r["min"], r["max"], r["mean"], r["median"], r.percentile_90, r.percentile_95) == \
        (10, 0, 9, 4.5, 4.5, 9, 9)


def test_combined_loss(spark):
    df = spark.createDataFrame([(1, "pred", 1.0), (1, "expl", 2.0), (2, "pred", 1.0)], "step long, task string, loss double")
    rows = report.combined_loss(df, 0.8).collect()
    assert len(rows) == 1 and abs(rows[0].loss - 1.2) < 1e-12


def test_checkpoints(spark):
    h = spark.createDataFrame([("r", 250, 0.3), ("r", 500, 0.5), ("r", 750, 0.5)], "run string, step long, metric double")
    assert report.best_checkpoint(h, 250, 1).first().best_step == 500
    kept = {r.step for r in report.retained_checkpoints(h, 250, 1).collect()}
    assert kept == {500, 750}


# ------------------------------------------------------------------ scores
def _pairs(spark, rows):
    return spark.createDataFrame([(1, i, p, r) for i, (p, r) in enumerate(rows)],
                                 "run_id long, doc_id long, summary string, output string")


def test_rouge_hand_case(spark):
    df = _pairs(spark, [("the cat sat", "the cat ran fast"), ("", "x y"), ("a b", "a b")])
    r1 = {r.doc_id: r for r in scores.rouge_n(df, 1).collect()}
    assert abs(r1[0].rouge1_precision - 2 / 3) < 1e-12 and abs(r1[0].rouge1 - 4 / 7) < 1e-12
    assert r1[1].rouge1 == 0.0 and r1[2].rouge1 == 1.0
    r2 = {r.doc_id: r for r in scores.rouge_n(df, 2).collect()}
    assert abs(r2[0].rouge2 - 0.4) < 1e-12
    rl = {r.doc_id: r for r in scores.rouge_l(df).collect()}
    assert abs(rl[0].rougeL - 4 / 7) < 1e-12
    rel = {r.doc_id: r.rouge1 for r in scores.rouge_n(df, 1, method="relational").collect()}
    assert rel == {k: v.rouge1 for k, v in r1.items()}
    avg = (4 / 7 + 0.4 + 4 / 7) / 3 * 100
    assert round(avg, 4) == 51.4286


def test_rouge_lsum_hand_case(spark):
    df = _pairs(spark, [("a b d", "a b c\na d")])
    r = scores.rouge_lsum(df).first()
    assert r.rougeLsum_precision == 1.0 and abs(r.rougeLsum_recall - 0.6) < 1e-12 and abs(r.rougeLsum - 0.75) < 1e-12


def test_resume_anti_join(spark):
    inputs = spark.createDataFrame([("a.txt",), ("b.txt",)], "filename string")
    done = spark.createDataFrame([("a_sum.txt",)], "out_name string")
    got = joins.resume_anti_join(inputs, done, text.summary_file_name("filename")).collect()
    assert [r.filename for r in got] == ["b.txt"]
