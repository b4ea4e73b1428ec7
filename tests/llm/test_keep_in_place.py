"""keep_one leaves texts where they lie; the bitmaps and the join keep the same rows."""

from collections import Counter

from pyspark.sql import functions as F

from corpusforge.llm import simhash
from tests.llm import messy


def test_keep_one_moves_no_text(spark):
    conf, old = "spark.sql.autoBroadcastJoinThreshold", spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set(conf, "-1")  # tables too large for the optimiser's own broadcasts
    try:
        kept = simhash.keep_one(messy.table(spark))
        plan = kept._jdf.queryExecution().executedPlan().toString()
        n = kept.count()
    finally:
        spark.conf.set(conf, old)
    assert "hashpartitioning" not in plan and "BroadcastHashJoin" in plan
    assert n == simhash.keep_one(messy.table(spark)).count()


def test_bitmaps_and_join_keep_the_same_rows(spark, monkeypatch):
    docs = messy.table(spark)
    by_bits = Counter(map(str, simhash.keep_one(docs).collect()))
    monkeypatch.setattr(simhash, "MAX_BITMAPS", 0)
    assert by_bits == Counter(map(str, simhash.keep_one(docs).collect()))


def test_kept_rows_over_many_partitions(spark, monkeypatch):
    rows = spark.range(0, 200_000, 1, 5).select(F.monotonically_increasing_id().alias("rid"), F.col("id").alias("cf_bits"))
    rows = rows.withColumn("text", F.hash("rid"))
    kept = rows.where("pmod(text, 3) = 0 or rid in (0, 1, 32767, 32768, 32769)").select("rid")
    want = rows.join(kept, "rid", "left_semi").agg(F.count(F.lit(1)), F.sum(F.hash("rid"))).first()
    got = simhash._where_kept(rows, kept, "rid")
    assert got.columns == rows.columns
    assert got.agg(F.count(F.lit(1)), F.sum(F.hash("rid"))).first() == want
    assert simhash._where_kept(rows, kept.limit(0), "rid").count() == 0
