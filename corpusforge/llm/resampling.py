"""Target-distribution importance resampling with an exact distributed cutoff.

Features are the runs of 1 to ``max_n`` consecutive words, hashed by CRC-32 into
``buckets``. A bucket's gain is the log ratio of the target's and the corpus'
smoothed feature frequencies; a document's weight is the floored mean of its
features' gains, looked up in one array per task. Gumbel noise from a hash of
the id turns the weights into a draw without replacement: the documents with the
highest scores are the sample.

1. One pass reads the texts and stages (document, bucket numbers); bucket counts
   come from the staged numbers, at most ``buckets`` rows a task before the
   shuffle.
2. The cutoff key is found by weighted median of medians. Rows are in a total
   order (score descending, id ascending with nulls last, row number). Each round
   every task reports the medians of its remaining rows below and above the last
   pivot, and how many there are. The next pivot is the median of the medians of
   the side that holds the cutoff, weighted by those numbers, so a quarter of the
   remaining rows at least is below it and a quarter above it: one side is
   discarded. When rows are down to an eighth of the staged table, they are staged
   anew, so all rounds together read a few tables' worth. No row ever comes to the
   driver but the medians (one a task and CHUNK rows) and the last FINISH rows.
3. Winners are sorted by ranges; a row's rank is its place in its partition plus
   the sizes of the partitions before it. A hot score is split by the id.

Defined results: null and empty texts and texts without a word have no feature,
weight 0 and are never eligible unless ``min_words`` is 0; a null id is hashed as
the empty text and comes last among ties; repeated rows are scored and ranked
each, in the order of their row numbers; an empty table gives an empty result, an
empty target or corpus is smoothed like any other; texts of any length are read
whole, in runs of texts of bounded size; other columns are ignored, whatever
their names.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusforge.llm.common import byte_slices, staged

BUCKETS, MIN_WORDS, PERCENT, SEED = 10_000, 20, 10, "2024"
#: Entries of a task's table of words and their buckets, and the longest word in it (memory bound).
CACHE, LONGEST = 200_000, 64
#: Rows that one median stands for at most; remaining rows that are sorted on the driver.
CHUNK, FINISH = 1 << 18, 64
#: Byte -> its lower-case letter, digit or non-ASCII byte; all else is a space.
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


class _Buckets(dict):
    """Word -> its bucket; words are hashed when first seen."""

    def __init__(self, buckets: int):
        self.buckets = buckets

    def __missing__(self, word: bytes) -> int:
        b = zlib.crc32(word) % self.buckets
        if len(word) <= LONGEST:
            self[word] = b
        return b


def bucket_numbers(text: str | None, known: dict, max_n: int = 1, buckets: int = BUCKETS) -> tuple[int, np.ndarray]:
    """(words, buckets of all features) of a text."""
    words = (text or "").encode("utf-8", "replace").translate(_LOWER).split()
    out = list(map(known.__getitem__, words))
    for n in range(2, max_n + 1):
        out += [zlib.crc32(b" ".join(words[i:i + n])) % buckets for i in range(len(words) - n + 1)]
    return len(words), np.array(out, "<u4")


def _featured(df: DataFrame, text_col: str, buckets: int, max_n: int, id_col: str | None = None) -> DataFrame:
    """(id, n_words, n_features, feats): little-endian bucket numbers, two bytes each while they fit."""
    code = "<u2" if buckets <= 1 << 16 else "<u4"
    src = df.select(F.lit(None).cast("long").alias("id") if id_col is None else F.col(id_col).alias("id"),
                    F.col(text_col).cast("string").alias("text"))
    schema = src.select("id", F.lit(0).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_features"),
                        F.lit(b"").alias("feats")).schema

    def run(batches):
        known = _Buckets(buckets)
        for b in batches:
            for part in byte_slices(b, 1):
                if len(known) > CACHE:
                    known.clear()
                words, feats = [], []
                for t in part.column(1).to_pylist():
                    n, f = bucket_numbers(t, known, max_n, buckets)
                    words.append(n)
                    feats.append(f.astype(code).tobytes())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(words, pa.int64()), pa.array([len(f) // int(code[-1]) for f in feats], pa.int64()),
                     pa.array(feats, pa.binary())], names=schema.names)
    return src.mapInArrow(run, schema)


def _runs(batch: pa.RecordBatch, col: int, code: str):
    """(slice of the batch, its bucket numbers, offsets) in runs of bounded size."""
    for part in byte_slices(batch, col):
        a = part.column(col)
        ends = np.frombuffer(a.buffers()[1], np.int32)[a.offset:a.offset + len(a) + 1] // int(code[-1])
        yield part, np.frombuffer(a.buffers()[2] or b"", code)[ends[0]:ends[-1]], ends - ends[0]


def bucket_counts(featured: DataFrame, buckets: int) -> np.ndarray:
    """Features in each bucket; at most ``buckets`` rows reach the driver."""
    code = "<u2" if buckets <= 1 << 16 else "<u4"

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for _, ids, _ in _runs(b, 0, code):
                total += np.bincount(ids, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], names=["bucket", "n"])
    out = np.zeros(buckets, np.int64)
    for r in featured.select("feats").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln(smoothed target frequency / smoothed source frequency)) of every bucket."""
    k, s, t = len(source), source.astype(float), target.astype(float)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + k) / ((s + 1) * (t.sum() + k)))).astype(np.int64)


def weighted(featured: DataFrame, gain: np.ndarray, seed: str = SEED) -> DataFrame:
    """(rid, doc_id, n_words, n_features, weight, score) of staged rows."""
    code = "<u2" if len(gain) <= 1 << 16 else "<u4"
    schema = featured.select("rid", "id", "n_words", "n_features", F.lit(0).cast("long").alias("weight")).schema

    def run(batches):
        for b in batches:
            for part, ids, ends in _runs(b, 4, code):
                run_ = np.concatenate([[0], np.cumsum(gain[ids])])
                n = np.diff(ends)
                weight = (run_[ends[1:]] - run_[ends[:-1]]) // np.maximum(n, 1)  # floors go down
                yield pa.RecordBatch.from_arrays([part.column(k) for k in range(4)] + [pa.array(weight, pa.int64())], names=schema.names)
    out = featured.select("rid", "id", "n_words", "n_features", "feats").mapInArrow(run, schema)
    salt = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(salt, 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")
    return out.select("rid", F.col("id").alias("doc_id"), "n_words", "n_features", "weight", (F.col("weight") + noise).alias("score"))


# ------------------------------------------------------------- the cutoff
#: The total order of rows; compared field by field, as a struct.
KEY = ["neg", "nil", "doc_id", "rid"]


def _keyed(df: DataFrame) -> DataFrame:
    return df.withColumn("neg", -F.col("score")).withColumn("nil", F.col("doc_id").isNull())


def _medians(schema):
    """Tasks' remaining rows by side of the pivot: how many, and the median, for each CHUNK rows."""
    def run(batches):
        def report(rows):
            t = pa.Table.from_batches(rows)
            side = t.column("side").to_numpy()
            for k in np.unique(side):
                part = t.filter(pa.array(side == k))
                order = pc.sort_indices(part, sort_keys=[(c, "ascending") for c in KEY])
                mid = part.take(order.slice((len(part) - 1) // 2, 1)).append_column("n", pa.array([len(part)], pa.int64()))
                yield from mid.select(schema.names).to_batches()
        held, n = [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= CHUNK:
                yield from report(held)
                held, n = [], 0
        if n:
            yield from report(held)
    return run


def _order(r):
    return r["neg"], r["nil"], 0 if r["nil"] else r["doc_id"], r["rid"]


def cutoff(rows: DataFrame, take: int, finish: int = FINISH):
    """The key (neg, nil, doc_id, rid) of the ``take``-th of ``rows`` in key order, by weighted median of medians."""
    table = rows.select(*KEY)
    id_type = rows.schema["doc_id"].dataType
    total = remaining = table.count()
    if not 0 < take <= total:
        raise ValueError(f"take must be 1 to {total}: {take}")

    def at(r):
        return F.struct(F.lit(r["neg"]).cast("long"), F.lit(r["nil"]), F.lit(r["doc_id"]).cast(id_type), F.lit(r["rid"]).cast("long"))
    key, pivot = F.struct(*KEY), None
    while True:
        if remaining <= finish:
            return sorted(table.collect(), key=_order)[take - 1]
        side = F.lit(0) if pivot is None else F.when(key < at(pivot), 0).when(key == at(pivot), 1).otherwise(2)
        out = table.withColumn("side", side)
        got = out.mapInArrow(_medians(out.withColumn("n", F.lit(0).cast("long")).schema),
                             out.withColumn("n", F.lit(0).cast("long")).schema).collect()
        count = [sum(r["n"] for r in got if r["side"] == k) for k in range(3)]
        if pivot is None:
            keep = 0
        elif take <= count[0]:
            keep, table, remaining = 0, table.where(key < at(pivot)), count[0]
        elif take == count[0] + 1:
            return pivot
        else:
            keep, take = 2, take - count[0] - 1
            table, remaining = table.where(key > at(pivot)), count[2]
        # the median of the medians of what remains, weighted by the rows each stands for
        medians = sorted((r for r in got if r["side"] == keep), key=_order)
        half = np.searchsorted(np.cumsum([r["n"] for r in medians]), remaining / 2)
        pivot = medians[int(half)]
        if remaining * 8 <= total:
            table, total = staged(table, "resample-rest"), remaining


def ranked(winners: DataFrame) -> DataFrame:
    """``winners`` with their rank (1, 2, 3...) in key order: range-sorted, numbered within and across partitions."""
    rows = staged(winners.orderBy(*KEY).withColumn("place", F.monotonically_increasing_id()), "resample-winners")
    part = F.shiftright("place", 33)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (rows.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))  # a row a partition
               .select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("off")))
    return (rows.withColumn("part", part).join(F.broadcast(offsets), "part")
            .withColumn("rank", (F.col("off") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1)) + 1).cast("long"))
            .drop("part", "off", "place"))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, max_n: int = 1,
             buckets: int = BUCKETS, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text",
             target_text: str = "text", finish: int = FINISH) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of every document; rank is null for those not drawn.

    Drawn are floor(percent * N / 100) of the N documents with ``min_words`` words at least.
    """
    feats = staged(_featured(docs, text_col, buckets, max_n, id_col).withColumn("rid", F.monotonically_increasing_id()),
                   "resample-features")
    gain = gains(bucket_counts(feats, buckets), bucket_counts(_featured(target, target_text, buckets, max_n), buckets))
    rows = staged(_keyed(weighted(feats, gain, seed)), "resample-weights")
    eligible = F.col("n_words") >= min_words
    take = percent * rows.where(eligible).count() // 100
    out = ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    unranked = rows.withColumn("rank", F.lit(None).cast("long"))
    if not take:
        return unranked.select(out)
    last = cutoff(rows.where(eligible), take, finish)
    drawn = eligible & (F.struct(*KEY) <= F.struct(F.lit(last["neg"]).cast("long"), F.lit(last["nil"]), F.lit(last["doc_id"]).cast(
        rows.schema["doc_id"].dataType), F.lit(last["rid"]).cast("long")))
    return ranked(rows.where(drawn)).select(out).unionByName(unranked.where(~drawn).select(out))
