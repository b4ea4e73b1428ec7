"""Exact ranks without a one-task window.

``Window.partitionBy(lang)`` puts a whole language in one task, and a global
``row_number()`` puts everything in one task. Both ranks here are exact and
spread the rows over many tasks:

* ``hashed_rank`` (seeded shuffle order): the order key is a SHA-256 digest, so
  its first hex digits are a uniform, order-preserving bucket. Count rows per
  (group, bucket), turn that small table into running offsets, and rank inside
  (group, bucket) only.
* ``ordered_rank`` (numeric or time order key): the same scheme with buckets
  cut at approximate quantiles of the first order column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusforge.session import checkpoint_root

# Rows of a control table (offsets per group and bucket) we accept to broadcast.
BROADCAST_MAX_ROWS = 2_000_000
HASH_BUCKET_DIGITS = 4  # 65,536 buckets per group


def seeded_hash(key, seed: int) -> Column:
    """sha256 of '<seed>:<key>' as lower-case hex (same as DuckDB sha256)."""
    k = F.col(key) if isinstance(key, str) else key
    return F.sha2(F.concat(F.lit(f"{seed}:"), k.cast("string")), 256)


def small_table(small: DataFrame, max_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """Checkpoint a control table and broadcast it only if its row count is bounded."""
    checkpoint_root(small.sparkSession)  # the configured shared folder (own one only if unset)
    small = small.checkpoint(eager=True)
    return F.broadcast(small) if small.count() <= max_rows else small


def hash_bucket(hash_col) -> Column:
    return F.conv(F.substring(F.col(hash_col), 1, HASH_BUCKET_DIGITS), 16, 10).cast("int")


def left_offsets(offs: DataFrame, more: DataFrame, group_cols: list[str]) -> DataFrame:
    """Offsets with the columns of a table of some of their buckets; a small table again."""
    by = [*group_cols, "_b"]
    m = more.select(*[F.col(c).alias(f"_m_{c}") for c in by], *[c for c in more.columns if c not in by])
    return small_table(offs.join(m, on=[offs[c].eqNullSafe(m[f"_m_{c}"]) for c in by], how="left").drop(*[f"_m_{c}" for c in by]))


def bucket_offsets(df: DataFrame, group_cols: list[str], hash_col: str) -> DataFrame:
    """(group, _b) -> _cnt, _start (rows of the group in earlier buckets), _n (group size)."""
    b = hash_bucket(hash_col)
    counts = (df.select(*group_cols, b.alias("_b"))
              .groupBy(*group_cols, "_b").agg(F.count(F.lit(1)).alias("_cnt")))
    w = Window.partitionBy(*group_cols).orderBy("_b")
    return (counts
            .withColumn("_start", F.sum("_cnt").over(w) - F.col("_cnt"))
            .withColumn("_n", F.sum("_cnt").over(Window.partitionBy(*group_cols))))


def with_offsets(df: DataFrame, offs: DataFrame, group_cols: list[str]) -> DataFrame:
    """Each row with its bucket's offsets; a null group or key is a group or bucket like any other."""
    by = [*group_cols, "_b"]
    o = offs.select(*[F.col(c).alias(f"_o_{c}") for c in by], *[c for c in offs.columns if c not in by])
    same = [df[c].eqNullSafe(o[f"_o_{c}"]) for c in by]
    return df.join(o, on=same, how="inner").drop(*[f"_o_{c}" for c in by])


def hashed_rank(df: DataFrame, group_cols: list[str], key_col: str, seed: int,
                rank_col: str = "rank", size_col: str | None = "group_size",
                prefilter=None) -> DataFrame:
    """1-based rank per group in the order (sha256('<seed>:<key>'), key).

    ``prefilter(offsets_df) -> Column`` may drop whole buckets before the
    shuffle (e.g. buckets that cannot hold a wanted split).
    """
    h = "_h"
    hashed = df.withColumn(h, seeded_hash(key_col, seed))
    offs = bucket_offsets(hashed, group_cols, h)
    offs = small_table(offs)
    b = hash_bucket(h)
    joined = with_offsets(hashed.withColumn("_b", b), offs, group_cols)
    if prefilter is not None:
        joined = joined.filter(prefilter(joined))
    w = Window.partitionBy(*group_cols, "_b").orderBy(h, key_col)
    out = joined.withColumn(rank_col, (F.col("_start") + F.row_number().over(w)).cast("long"))
    if size_col:
        out = out.withColumn(size_col, F.col("_n").cast("long"))
    return out.drop(h, "_b", "_cnt", "_start", "_n")


def ordered_rank(df: DataFrame, group_cols: list[str], order_cols: list[str],
                 rank_col: str = "rank", buckets: int = 256,
                 relative_error: float = 0.001) -> DataFrame:
    """1-based row_number() over (partition by group order by order_cols), distributed.

    The first order column (numeric, date or timestamp) is cut at approximate
    quantiles into ``buckets`` ranges; the bounds are one small driver-side
    list, so the bucket of a row is a deterministic function of its values.
    Rows are then ranked inside (group, bucket) and shifted by the count of the
    group's rows in lower buckets, as in ``hashed_rank``. Pass a unique order key.
    """
    first = order_cols[0]
    dtype = df.schema[first].dataType.simpleString()
    if dtype.startswith("timestamp"):
        num = F.unix_micros(F.col(first).cast("timestamp")).cast("double")
    elif dtype == "date":
        num = F.unix_date(F.col(first)).cast("double")
    else:
        num = F.col(first).cast("double")
    probe = df.select(num.alias("_q")).filter(F.col("_q").isNotNull())
    probs = [i / buckets for i in range(1, buckets)]
    bounds = sorted(set(probe.approxQuantile("_q", probs, relative_error))) if probs else []
    bucket = F.when(num.isNull(), F.lit(-1)).otherwise(_count_le(F.col("_q"), bounds, 0, len(bounds)))
    df = df.withColumn("_q", num)
    x = df.withColumn("_b", bucket.cast("int"))
    counts = x.groupBy(*group_cols, "_b").agg(F.count(F.lit(1)).alias("_cnt"))
    w = Window.partitionBy(*group_cols).orderBy("_b") if group_cols else Window.orderBy("_b")
    offs = counts.withColumn("_start", F.sum("_cnt").over(w) - F.col("_cnt")).drop("_cnt")
    offs = small_table(offs)
    joined = with_offsets(x, offs, group_cols)
    wr = Window.partitionBy(*group_cols, "_b").orderBy(*order_cols)
    out = joined.withColumn(rank_col, (F.col("_start") + F.row_number().over(wr)).cast("long"))
    return out.drop("_b", "_start", "_q")


def _count_le(x: Column, bounds: list, lo: int, hi: int) -> Column:
    """Number of sorted bounds <= x, as a balanced CASE tree (log2 comparisons, codegen'd)."""
    if lo >= hi:
        return F.lit(lo)
    mid = (lo + hi) // 2
    return F.when(x < F.lit(float(bounds[mid])), _count_le(x, bounds, lo, mid)) \
        .otherwise(_count_le(x, bounds, mid + 1, hi))
