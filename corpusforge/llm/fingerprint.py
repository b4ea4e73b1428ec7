"""Improbable-feature digests of documents.

Every WINDOW bytes of a text have an entropy; how rare that entropy level is
among all windows of the corpus ranks the window (rarest first, windows of
nearly constant bytes left out). In each run of RUN neighbouring windows the
rarest one gets a vote; windows with VOTES or more are the text's features
(all windows of a text that has few).
Features enter Bloom filters of BITS bits in order, HASHES bits each; a filter
that holds CAPACITY features is closed and the next one chained on.

The likeness of two digests is taken from the one with fewer features: each of
its filters is compared with every filter of the other, the overlap of set
bits normalised between what chance gives (0) and the most possible (1), values
under CHANCE counting as 0; the best per filter is averaged by features.

The level counts come from all windows of all documents. Neighbouring
documents meet by one range shuffle: ids are cut at quantiles into buckets, a
bucket is read in descending order as a stream, and the first document of the
following bucket is sent along as its sentinel.

Defined results: null text is empty; an empty text has no feature, likeness 1
to another empty text and 0 to others; a text shorter than WINDOW is one
feature; equal ids follow the order of their texts; null ids come last, after
the smallest id; the last document is followed by the first (a single document
by itself); an empty table gives an empty result. Equal texts have equal
digests.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusforge.llm.common import text_buffer

WINDOW, RUN, VOTES = 16, 32, 10
#: A text of at most this many windows takes all of them as features.
FEW = 96
BITS, HASHES, CAPACITY, CHANCE = 2048, 5, 160, 0.2
LEVELS = 256
#: Entropy levels under this are left out of the features (nearly constant bytes).
LOWEST = 32
#: Documents of one bucket of the id order, and the most buckets.
BUCKET, MAX_BUCKETS = 500, 20_000
_SLICE = 1 << 20
_C = np.arange(WINDOW + 1, dtype=np.float64)
_G = np.round(np.where(_C > 0, _C * np.log2(np.maximum(_C, 1)), 0) * (1 << 20)).astype(np.int64)
_STEP = np.diff(_G, prepend=0)
_ODD = np.random.default_rng(97).integers(0, 1 << 62, WINDOW // 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def entropy_levels(buf: np.ndarray) -> np.ndarray:
    """Entropy level (0 .. LEVELS - 1) of the window that starts at each byte but the last WINDOW - 1."""
    n = len(buf)
    if n < WINDOW:
        return np.zeros(0, np.int64)
    back, ahead = np.ones(n, np.uint8), np.ones(n, np.uint8)  # equal bytes in the window that ends, starts here
    for k in range(1, WINDOW):
        same = (buf[k:] == buf[:-k]).view(np.uint8)
        back[k:] += same
        ahead[:-k] += same
    total = np.cumsum(_STEP[back])
    total[WINDOW:] -= np.cumsum(_STEP[ahead[:-WINDOW]])
    bits = 1 - total[WINDOW - 1:] / (WINDOW * np.log2(WINDOW) * (1 << 20))
    return np.clip((bits * (LEVELS - 1) + 0.5).astype(np.int64), 0, LEVELS - 1)


def _spans(offs: np.ndarray):
    """Runs of documents of about _SLICE bytes together."""
    lo = 0
    for i in range(1, len(offs)):
        if offs[i] - offs[lo] >= _SLICE or i == len(offs) - 1:
            yield lo, i
            lo = i


def level_counts(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    out = np.zeros(LEVELS, np.int64)
    for lo, hi in _spans(offs):
        at = offs[lo:hi + 1] - offs[lo]
        lv = entropy_levels(buf[offs[lo]:offs[hi]])
        inside = np.zeros(len(lv) + 1, np.int64)  # windows that lie in one document
        size = np.diff(at) - WINDOW + 1
        ok = size > 0
        np.add.at(inside, at[:-1][ok], 1)
        np.add.at(inside, at[:-1][ok] + size[ok], -1)
        out += np.bincount(lv[np.cumsum(inside[:-1]) > 0], minlength=LEVELS)
    return out


def corpus_rarity(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Rank of each entropy level, rarest first, from all windows of all documents."""
    def run(batches):
        total = np.zeros(LEVELS, np.int64)
        for b in batches:
            total += level_counts(*text_buffer(b.column(0)))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(LEVELS)), pa.array(total)], names=["level", "n"])
    got = (docs.select(F.col(text_col).cast("string").alias("t")).mapInArrow(run, "level long, n long")
           .groupBy("level").agg(F.sum("n").alias("n")).collect())
    n = np.zeros(LEVELS, np.int64)
    for r in got:
        n[r["level"]] = r["n"]
    return rarity(n)


def rarity(counts: np.ndarray) -> np.ndarray:
    rank = np.empty(LEVELS, np.int64)
    rank[np.lexsort((np.arange(LEVELS), counts))] = np.arange(LEVELS)
    rank[:LOWEST] += LEVELS  # nearly constant bytes: only if a text has nothing else
    return rank


def _features(buf: np.ndarray, offs: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, 64-bit hash) of each feature, in text order."""
    n_docs, size = len(offs) - 1, np.diff(offs)
    lv = entropy_levels(buf)
    doc_of = np.repeat(np.arange(n_docs), size)
    chosen = np.zeros(0, np.int64)
    if len(lv):
        m = len(lv)
        at = np.arange(m)
        room = offs[doc_of[:m] + 1] - at  # bytes to the end of the document
        fits = room >= WINDOW
        key = np.where(fits, rank[lv], 4 * LEVELS) << 40 | at
        low = key.copy()
        span = 1
        while span < RUN:  # rarest of RUN neighbouring windows, by doubling
            low[:m - span] = np.minimum(low[:m - span], low[span:])
            span *= 2
        whole = room >= WINDOW + RUN - 1
        votes = np.bincount(low[whole] & ((1 << 40) - 1), minlength=m)
        take = votes >= VOTES
        take |= fits & (size[doc_of[:m]] < WINDOW + FEW)
        # a text without an elected window gives its rarest one
        some = np.zeros(n_docs, bool)
        some[doc_of[:m][take]] = True
        bare = np.flatnonzero(~some & (size >= WINDOW))
        for d in bare:
            take[offs[d] + np.argmin(key[offs[d]:offs[d + 1] - WINDOW + 1])] = True
        chosen = np.flatnonzero(take)
    short = np.flatnonzero((size > 0) & (size < WINDOW))
    start = np.concatenate([chosen, offs[short]])
    length = np.concatenate([np.full(len(chosen), WINDOW), size[short]])
    doc = np.concatenate([doc_of[chosen] if len(chosen) else chosen, short]).astype(np.int64)
    idx = start[:, None] + np.arange(WINDOW)
    raw = np.where(np.arange(WINDOW) < length[:, None], buf[np.minimum(idx, max(len(buf) - 1, 0))] if len(buf) else 0, 0).astype(np.uint8)
    words = np.ascontiguousarray(raw).view("<u8").reshape(len(start), WINDOW // 8)
    h = length.astype(np.uint64) * _ODD[0]
    for k in range(WINDOW // 8):
        h = (h ^ words[:, k]) * _ODD[k]
        h ^= h >> np.uint64(29)
    order = np.argsort(doc, kind="stable")
    return doc[order], h[order]


def digests(texts: list[bytes], rank: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(filters as bits, features per filter) of each text."""
    offs = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    buf = np.frombuffer(b"".join(texts), np.uint8)
    out = []
    for lo, hi in _spans(offs) if len(texts) else ():
        doc, h = _features(buf[offs[lo]:offs[hi]], offs[lo:hi + 1] - offs[lo], rank)
        n = np.bincount(doc, minlength=hi - lo)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
        filters = -(-n // CAPACITY)
        base = np.cumsum(filters) - filters
        bits = np.zeros((filters.sum(), BITS), bool)
        row = base[doc] + nth // CAPACITY
        for k in range(HASHES):
            bits[row, (h >> np.uint64(11 * k)).astype(np.int64) & (BITS - 1)] = True
        for d in range(hi - lo):
            held = np.minimum(n[d] - np.arange(filters[d]) * CAPACITY, CAPACITY)
            out.append((bits[base[d]:base[d] + filters[d]], held))
    return out


def text_form(digest) -> str:
    """``features:base64 of the chained filters``."""
    bits, held = digest
    return f"{int(held.sum())}:{base64.b64encode(np.packbits(bits, axis=1).tobytes()).decode()}"


def likeness(a, b) -> float:
    """Normalised bit overlap of two digests, 0 to 1."""
    (x, n), (y, m) = a, b
    if not len(n) or not len(m):
        return float(len(n) == len(m))
    if n.sum() != m.sum():
        return _one_way(x, n, y) if n.sum() < m.sum() else _one_way(y, m, x)
    return (_one_way(x, n, y) + _one_way(y, m, x)) / 2


def _one_way(x, n, y) -> float:
    both = x.astype(np.float32) @ y.astype(np.float32).T
    i, j = x.sum(1)[:, None], y.sum(1)[None, :]
    least, most = i * j / BITS, np.minimum(i, j)
    s = np.clip((both - least) / np.maximum(most - least, 1e-9), 0, 1)
    best = s.max(1)
    return float(min(1.0, (np.where(best < CHANCE, 0, best) * n).sum() / n.sum()))


def in_buckets(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(bucket, sentinel, id, text): buckets of the descending id order, each with its followers."""
    src = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    ids = docs.select(F.col(id_col).cast("double").alias("id"))
    n = ids.count()
    parts = int(min(MAX_BUCKETS, max(1, -(-n // BUCKET))))
    cuts = sorted(set(ids.approxQuantile("id", [k / parts for k in range(1, parts)], 0.1 / parts))) if parts > 1 else []
    edge = np.array(cuts)

    def place(x: pa.Array) -> pa.Array:
        v = x.cast(pa.float64()).to_numpy(zero_copy_only=False)  # null reads as nan
        return pa.array(np.where(np.isnan(v), len(edge) + 1, len(edge) - np.searchsorted(edge, v)).astype(np.int32))
    bucket = F.arrow_udf(place, "int")(F.col("id"))
    # at most MAX_BUCKETS + 1 rows: the first id of every bucket that has documents
    firsts = sorted((r["bucket"], r["id"]) for r in docs.select(F.col(id_col).alias("id")).withColumn("bucket", bucket)
                    .groupBy("bucket").agg(F.max("id").alias("id")).collect())
    spark = docs.sparkSession
    follows = spark.createDataFrame([(i, firsts[k - 1][0]) for k, (_, i) in enumerate(firsts)],
                                    src.select(F.col("id").alias("first"), F.lit(0).alias("before")).schema)
    both = src.withColumn("bucket", bucket).join(F.broadcast(follows), F.col("id").eqNullSafe(F.col("first")), "left")
    rows = F.when(F.col("before").isNull(), F.array(F.struct(F.col("bucket").alias("b"), F.lit(0).alias("s")))).otherwise(
        F.array(F.struct(F.col("bucket").alias("b"), F.lit(0).alias("s")), F.struct(F.col("before").alias("b"), F.lit(1).alias("s"))))
    return (both.withColumn("r", F.explode(rows)).select(F.col("r.b").alias("bucket"), F.col("r.s").alias("sentinel"), "id", "text")
            .repartition("bucket").sortWithinPartitions("bucket", "sentinel", F.col("id").desc_nulls_last(), "text"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every document."""
    rank = corpus_rarity(docs, text_col)
    rows = in_buckets(docs, id_col, text_col)
    schema = rows.select(F.col("id").alias("doc_id"), F.lit(0).cast("long").alias("n_chars"), F.lit("").alias("edited_sha256"),
                         F.lit("").alias("fingerprint"), F.lit("").alias("edited_fingerprint"), F.lit(0.0).alias("near_edited"),
                         F.lit(0.0).alias("near_next")).schema

    def answer(ids, texts, own):
        """Rows for all but the last text, each followed by the next one; ``own`` marks rows that are no sentinel."""
        edited = []
        for t, nxt in zip(texts[:-1], texts[1:]):
            k = len(t) // 3
            edited.append((t[:len(t) - k] + nxt[:k]).encode("utf-8", "replace"))
        n = len(edited)
        d = digests([*[t.encode("utf-8", "replace") for t in texts], *edited], rank)
        real, ed = d[:n + 1], d[n + 1:]
        at = [i for i in range(n) if own[i]]
        return pa.RecordBatch.from_arrays(
            [ids.take(pa.array(at, pa.int64())), pa.array([len(texts[i]) for i in at], pa.int64()),
             pa.array([hashlib.sha256(edited[i]).hexdigest() for i in at], pa.string()),
             pa.array([text_form(real[i]) for i in at], pa.string()), pa.array([text_form(ed[i]) for i in at], pa.string()),
             pa.array([likeness(real[i], ed[i]) for i in at], pa.float64()),
             pa.array([likeness(real[i], real[i + 1]) for i in at], pa.float64())], names=schema.names)

    def run(batches):
        held = None  # the last row so far: what follows it is not known yet
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                p = b.slice(lo, 256)
                ids, texts, own = p.column(2), p.column(3).to_pylist(), [s == 0 for s in p.column(1).to_pylist()]
                if held is not None:
                    ids, texts, own = pa.concat_arrays([held[0], ids]), [held[1], *texts], [held[2], *own]
                if len(texts) > 1:
                    yield answer(ids, texts, own)
                held = ids.slice(len(texts) - 1), texts[-1], own[-1]
        # a bucket ends with a sentinel, so nothing of it is left
    return rows.mapInArrow(run, schema)
