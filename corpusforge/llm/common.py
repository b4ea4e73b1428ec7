"""Helpers shared by the operators: staged tables, Arrow text buffers, names."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusforge.session import shared_dir

#: Buckets over which a global order is dealt; fixed, so offset tables stay bounded.
ORDER_BUCKETS = 8192


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder of ``spark.checkpoint.dir`` and read it back.

    Cuts lineage with a table every executor can read: a lost executor costs a
    re-read, and values fixed at the write (row ids, block ids) stay fixed. With
    ``by``, a filter on that column reads its part alone.
    """
    path = shared_dir(df.sparkSession, name)
    out = df.write.option("compression", "zstd")
    (out.partitionBy(by) if by else out).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(columns, *names: str) -> list[str]:
    """Column names that clash with none of ``columns`` (compared without case)."""
    taken = {c.lower() for c in columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        taken.add(n.lower())
        out.append(n)
    return out


def text_buffer(col) -> tuple[np.ndarray, np.ndarray]:
    """(uint8 bytes, int64 offsets of length n + 1) of an Arrow string column; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    a = col.cast(pa.large_binary())
    if a.null_count:
        a = a.fill_null(b"")
    offs = np.frombuffer(a.buffers()[1], np.int64)[a.offset:a.offset + len(a) + 1]
    data = a.buffers()[2]
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return data[offs[0]:offs[-1]], offs - offs[0]


def byte_slices(batch: pa.RecordBatch, col: int, most: int = 4 << 20):
    """Runs of rows of ``batch`` that hold at most ``most`` bytes in column ``col``, or one longer row."""
    a = batch.column(col)
    if not pa.types.is_large_string(a.type) and not pa.types.is_large_binary(a.type):
        ends = np.frombuffer(a.buffers()[1], np.int32)[a.offset:a.offset + len(a) + 1] if len(a) else np.zeros(1, np.int32)
    else:
        ends = np.frombuffer(a.buffers()[1], np.int64)[a.offset:a.offset + len(a) + 1] if len(a) else np.zeros(1, np.int64)
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(ends, int(ends[lo]) + most, "right")) - 1)
        yield batch.slice(lo, hi - lo)
        lo = hi


class RunHash:
    """64-bit hashes of runs of an array of codes: a polynomial in ``base``, from one running sum."""

    def __init__(self, base: int):
        self.bases = base | 1, pow(base | 1, -1, 1 << 64)
        self.rows = [np.ones(1, np.uint64)] * 2

    def __call__(self, codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        if len(self.rows[0]) <= len(codes):
            self.rows = [np.full(len(codes) + (len(codes) >> 2) + 1, b, np.uint64) for b in self.bases]
            for r in self.rows:
                r[0] = 1
                np.multiply.accumulate(r, out=r)
        power, inverse = self.rows
        total = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(codes * power[:len(codes)], out=total[1:])
        return (total[end] - total[start]) * inverse[start]


def hash_fraction(*cols) -> "F.Column":
    """A deterministic uniform number in [0, 1) from the columns' values."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 40)) / F.lit(float(1 << 40))


def crc_fold(id_col: str, mod: int):
    """crc32 of the id as text, modulo ``mod``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(mod))


def running(df: DataFrame, value: str, keys: list[str], rank=None, names=("lo", "hi")) -> DataFrame:
    """``df`` with the running total of ``value`` before and after each row.

    The order is (rank, hash of ``keys``, ``keys``); rows with equal keys must
    not occur. Totals of ORDER_BUCKETS buckets a rank are added up first (a
    bounded table), then each bucket runs on its own, so no task sees all rows.
    """
    from pyspark.sql import Window
    rank = F.lit(0) if rank is None else rank
    b, off = fresh(df.columns, "cf_bucket", "cf_off")
    df = df.withColumn(b, rank * ORDER_BUCKETS + F.pmod(F.xxhash64(*keys), F.lit(ORDER_BUCKETS)))
    before = Window.orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (df.groupBy(b).agg(F.sum(value).alias(off))
               .select(b, F.coalesce(F.sum(off).over(before), F.lit(0)).alias(off)))
    inside = Window.partitionBy(b).orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0)
    lo, hi = names
    return (df.withColumn(hi, F.sum(value).over(inside)).join(F.broadcast(offsets), b)
            .withColumn(hi, (F.col(hi) + F.col(off)).cast("long")).withColumn(lo, F.col(hi) - F.col(value)).drop(b, off))
