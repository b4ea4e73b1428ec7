"""Stand-in inputs built from the driver's tables (FIXTURES.md section 3).

These only put the test tables into the schemas the jobs expect; the jobs
themselves never rely on how these rows were made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusforge.config import EXTRACT_PROMPT, RUN_MODELS
from corpusforge.functions.text import rouge_tokens
from corpusforge.operators.rank import ordered_rank
from corpusforge.operators.tokens import rouge_words


def sentences(text, keep) -> Column:
    """The parts of a whole text between '. ' whose number satisfies ``keep``, joined again."""
    return F.array_join(F.filter(F.split(text, r"\. ", -1), lambda x, i: keep(i)), ". ")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: Bytes of a file's row group, and rows' bytes of a task, by which ``spread`` judges whether files make enough tasks.
ROW_GROUP_BYTES, TASK_BYTES = 128 << 20, 8 << 20


def spread(df: DataFrame) -> DataFrame:
    """The same rows in tasks of about equal size, unless the files are large enough to make some tasks a core.

    A row group is read by one task, so files of few row groups would leave most cores idle.
    """
    size, cores = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()), df.sparkSession.sparkContext.defaultParallelism
    if size >= 4 * cores * ROW_GROUP_BYTES:
        return df
    return df.repartition(max(4 * cores, size // TASK_BYTES))


def rec(spark: SparkSession, sf_dir: str, spread_out: bool = False) -> DataFrame:
    """REC: annotated records (doc_id, lang, input, output, rationale, rationale_prompt)."""
    d = table(spark, sf_dir, "documents")
    if spread_out:
        d = spread(d)
    return d.select(
        "doc_id", "lang",
        F.col("text").alias("input"),
        F.col("text").alias("output"),
        sentences(F.col("text"), lambda i: i % 3 == 0).alias("rationale"),
        F.concat(F.lit(EXTRACT_PROMPT + ": "), F.col("text")).alias("rationale_prompt"))


def pred(spark: SparkSession, sf_dir: str, spread_out: bool = False) -> DataFrame:
    """PRED: one prediction per (run, doc): run k leaves out each (k + 1)-th part of the whole text."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    if spread_out:
        d = spread(d)
    run_ids = F.array(*[F.lit(k).cast("long") for k in sorted(RUN_MODELS)])
    return (d.select("doc_id", "text", F.explode(run_ids).alias("run_id"))
            .select("run_id", "doc_id",
                    sentences(F.col("text"), lambda i: i % (F.col("run_id") + 1) != F.col("run_id")).alias("summary")))


def mixed_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run_id, doc_id, output, summary): whole predictions that reorder and replace.

    The prediction of a document is the reversed parts of the document whose id
    differs in the last bit, then every other part of its own text.
    """
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    other = d.select(F.col("doc_id").bitwiseXOR(F.lit(1)).alias("doc_id"), F.col("text").alias("other"))
    parts = lambda c: F.split(c, r"\. ", -1)
    summary = F.array_join(F.concat(F.reverse(parts("other")), F.filter(parts("text"), lambda x, i: i % 2 == 0)), ". ")
    return d.join(other, "doc_id").select(F.lit(0).cast("long").alias("run_id"), "doc_id", F.col("text").alias("output"), summary.alias("summary"))


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LOGITS: one position per row: (vec_id, logits array<float>, label)."""
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.col("embedding").alias("logits"), "label")


def evalhist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EVALHIST: run = event_type, step = row_number by (ts, event_id), metric = value."""
    ev = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("run"), "ts", "event_id", F.col("value").alias("metric"))
    ranked = ordered_rank(ev, ["run"], ["ts", "event_id"], rank_col="step")
    return ranked.select("run", "step", "metric")


def losslog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LOSSLOG: long loss table (step, task, loss); pred = value, expl = value*0.5 + 1."""
    ev = table(spark, sf_dir, "events").select(F.col("event_id").alias("step"), "value")
    return ev.select("step", F.explode(F.array(
        F.struct(F.lit("pred").alias("task"), F.col("value").alias("loss")),
        F.struct(F.lit("expl").alias("task"), (F.col("value") * 0.5 + 1).alias("loss")))).alias("x")
    ).select("step", "x.task", "x.loss")


def paired_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRED joined to REC on doc_id: (run_id, doc_id, lang, output, summary)."""
    r = rec(spark, sf_dir).select("doc_id", "lang", "output")
    return pred(spark, sf_dir, spread_out=True).join(r, "doc_id").select("run_id", "doc_id", "lang", "output", "summary")


def token_vectors(spark: SparkSession, sf_dir: str):
    """A function that gives every row of a table with a column ``token`` the vector looked up for it."""
    emb = table(spark, sf_dir, "embeddings")
    e, n = emb.select("vec_id", F.col("embedding").alias("vec")), emb.count()

    def look_up(tokens: DataFrame) -> DataFrame:
        vec_id = F.pmod(F.conv(F.substring(F.md5("token"), 1, 8), 16, 10).cast("long"), F.lit(n))
        return tokens.withColumn("vec_id", vec_id).join(e, "vec_id")
    return look_up


def token_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run_id, doc_id, pred, ref): the tokens of summary and output; rows that repeat the key are one pair."""
    p = paired_all(spark, sf_dir).groupBy("run_id", "doc_id").agg(F.collect_list("summary").alias("s"), F.collect_list("output").alias("o"))
    toks = lambda c: rouge_words(F.array_join(c, " "))
    return p.select("run_id", "doc_id", toks("s").alias("pred"), toks("o").alias("ref"))


def tokvec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TOKVEC: every distinct token of output (ref) and summary (pred), its count and a looked-up vector."""
    p = paired_all(spark, sf_dir)
    sides = p.select("run_id", "doc_id", F.explode(F.array(
        F.struct(F.lit("ref").alias("side"), rouge_tokens("output").alias("t")),
        F.struct(F.lit("pred").alias("side"), rouge_tokens("summary").alias("t")))).alias("x"))
    toks = (sides.select("run_id", "doc_id", "x.side", F.explode("x.t").alias("token"))
            .groupBy("run_id", "doc_id", "side", "token").agg(F.count(F.lit(1)).alias("n")))
    return token_vectors(spark, sf_dir)(toks).select("run_id", "doc_id", "side", "token", "n", "vec")
