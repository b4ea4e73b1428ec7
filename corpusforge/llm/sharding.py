"""Sharding by a Feistel permutation with cycle walking (DataFrame functions only).

Rows get a global number from an order that depends on their content alone;
an alternating Feistel network over Z_a x Z_b (a * b barely above the row
count) permutes the numbers, walking on while a value falls outside. The
permuted position p gives shard = p mod shards and slot = p div shards, so
shard counts differ by at most one, slots have no gap, and the place of any
row number can be computed without the data (`locate`).

Only (id, size, crc32) move: texts stay where they are read. Repeated rows are
counted before the shuffle and spread again in bounded runs afterwards, so a
value that holds a third of all rows never meets in one task.

Defined results: null text has size 1 and crc32 0; null ids order first;
fully equal rows are interchangeable; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusforge.llm.common import ORDER_BUCKETS

ROUNDS = 6
#: Walk steps unrolled. At most a - 1 values lie outside, so a walk of this
#: length fails with probability under N ** (-STEPS / 2); it raises, never misplaces.
STEPS = 24
#: Repeated rows are spread in runs of this many, two levels deep.
RUN = 65536


def _feistel(x: Column, a: Column, b: Column, seed: int) -> Column:
    keys = F.array(*[F.lit(k) for k in range(ROUNDS)])

    def step(s, k):
        even = k % 2 == 0
        left = F.pmod(s["l"] + F.pmod(F.xxhash64(F.lit(seed), k, s["r"]), a), a)
        right = F.pmod(s["r"] + F.pmod(F.xxhash64(F.lit(seed), k, s["l"]), b), b)
        return F.struct(F.when(even, left).otherwise(s["l"]).alias("l"),
                        F.when(even, s["r"]).otherwise(right).alias("r"))

    start = F.struct(F.pmod(x, a).alias("l"), F.floor(x / a).cast("long").alias("r"))
    return F.aggregate(keys, start, step, lambda s: s["r"] * a + s["l"])


def locate(number: Column, total: Column, seed: int = 42) -> Column:
    """Permuted position of a row number among ``total`` rows."""
    a = F.ceil(F.sqrt(total.cast("double"))).cast("long")
    b = F.ceil(total / a).cast("long")
    return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), _feistel(number, a, b, seed),
                       lambda v, _: F.when(v < total, v).otherwise(_feistel(v, a, b, seed)))


def number_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, row_number, total): global numbers in content order."""
    raw = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    rows = df.select(F.col(id_col).alias("id"), (F.octet_length(raw) + 1).cast("long").alias("size"),
                     F.crc32(raw).alias("text_crc32"))
    kinds = (rows.groupBy("id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("cnt"))
             .withColumn("bucket", F.pmod(F.xxhash64("id", "size", "text_crc32"), F.lit(ORDER_BUCKETS))))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (kinds.groupBy("bucket").agg(F.sum("cnt").alias("n"))  # at most ORDER_BUCKETS rows
               .select("bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("off"),
                       F.sum("n").over(Window.partitionBy(F.lit(0))).alias("total")))
    w = (Window.partitionBy("bucket").orderBy("id", "size", "text_crc32")
         .rowsBetween(Window.unboundedPreceding, -1))
    placed = (kinds.withColumn("within", F.coalesce(F.sum("cnt").over(w), F.lit(0)))
              .join(F.broadcast(offsets), "bucket")
              .withColumn("first", F.col("off") + F.col("within")))
    runs = placed.withColumn("lo", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cnt") - 1, F.lit(RUN).cast("long"))))
    each = runs.withColumn("i", F.explode(F.sequence(F.col("lo"), F.least(F.col("lo") + RUN, F.col("cnt")) - 1)))
    return each.select("id", "size", "text_crc32", (F.col("first") + F.col("i")).alias("row_number"), "total")


def shard_rows(df: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text",
               seed: int = 42) -> DataFrame:
    """(doc_id, size, text_crc32, row_number, position, shard, slot), one row per input row."""
    n = number_rows(df, id_col, text_col)
    n = n.withColumn("position", locate(F.col("row_number"), F.col("total"), seed))
    sure = F.when(F.col("position") < F.col("total"), F.col("position")).otherwise(
        F.raise_error(F.lit("cycle walk longer than STEPS")).cast("long"))
    n = n.withColumn("position", sure)
    return n.select(F.col("id").alias("doc_id"), "size", "text_crc32", "row_number", "position",
                    F.pmod(F.col("position"), F.lit(shards)).cast("int").alias("shard"),
                    F.floor(F.col("position") / shards).cast("long").alias("slot"))
