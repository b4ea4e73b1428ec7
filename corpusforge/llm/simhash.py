"""SimHash near-dedup with a byte-position inverted index and count filtering.

A text's 64-bit fingerprint is the bitwise majority of XXH64 over its word
shingles. Two fingerprints with at most 3 differing bits differ in at most 3
of their 8 bytes, so they share at least 5 positional bytes, and at least 3 of
these lie in one half of the fingerprint. The index therefore posts each
distinct fingerprint under its byte triples within a half (8 postings of a
position set and its 24 bits): no pair of the guaranteed minimum can be missed.
Within a posting list the positional bytes that a pair shares are tallied,
pairs with at least 5 are retained, and the bit distance verifies them.

Scale: equal fingerprints are folded before the index is built (copies are
never paired); a long posting list is cut into blocks and every pair of blocks
is its own group, so no task holds more than two blocks; a group emits a
spanning forest of its links, never all pairs. Components come from
alternating large-star and small-star rounds over those links, each round
written to the shared folder. The rows that ``keep_one`` keeps are marked in
bitmaps of their row ids, so texts stay where they lie.

Defined results: null text, empty text and text without a word have
fingerprint 0 and link like any other; repeated rows are one group; a null id
joins its component and names it only if all ids there are null; an empty
table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusforge.llm.common import fresh, staged

SEED = 42
#: Fingerprints of one block of a long posting list; a group holds two at most.
BLOCK = 2048
#: Bitmaps of kept rows (4 KB each, for 32,768 row ids) that are sent to all tasks at most; beyond that rows move to meet their winners.
MAX_BITMAPS = 4096
#: Position sets: the byte triples of each half of the fingerprint.
TRIPLES = [t for half in (range(4), range(4, 8)) for t in combinations(half, 3)]
_SLICE = 65536


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Unsigned 64-bit SimHash of a text's lower-cased (A-Z) word shingles."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    start = end - size
    k = min(shingle, len(words))
    start, end = start[:len(words) - k + 1].tolist(), end[k - 1:].tolist()
    ones, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for lo in range(0, len(start), _SLICE):
        h = np.array([digest(line[a:b], SEED) for a, b in zip(start[lo:lo + _SLICE], end[lo:lo + _SLICE])], ">u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(start)).tobytes(), "big")


def fingerprint_column(text: Column, shingle: int = 3) -> Column:
    """Fingerprint as a signed long (the same 64 bits)."""
    def run(texts: pa.Array) -> pa.Array:
        return pa.array(np.array([fingerprint(t, shingle) for t in texts.to_pylist()], np.uint64).view(np.int64))
    return F.arrow_udf(run, "long")(text.cast("string"))


def position_sets(bits: int) -> list[tuple[int, ...]]:
    """Byte positions within a half of which two fingerprints at most ``bits`` apart share one set at least."""
    if not 0 <= bits <= 7:
        raise ValueError(f"bits must be 0 to 7, as fingerprints further apart may share no byte: {bits}")
    if bits <= 3:
        return TRIPLES
    shared = -(-(8 - bits) // 2)  # of the bytes shared for sure, those in the fuller half
    return [t for half in (range(4), range(4, 8)) for t in combinations(half, shared)]


def _byte(fp: Column, p: int) -> Column:
    return F.shiftrightunsigned(fp, 8 * p).bitwiseAND(F.lit(255).cast("long"))


def link_groups(group: np.ndarray, fp: np.ndarray, bits: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links (fingerprint, smaller index's fingerprint) within runs of equal ``group``.

    Rows come sorted by group. Distance d compares each row with the d-th next
    of its run; links already implied by earlier ones are not kept.
    """
    n = len(fp)
    label = np.arange(n)
    edge = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    run_end = np.repeat(np.append(edge[1:], n), np.diff(np.append(edge, n)))
    left = np.arange(n)
    d = 0
    while True:
        d += 1
        left = left[left + d < run_end[left]]
        if not len(left):
            break
        i = left[label[left] != label[left + d]]
        x = fp[i] ^ fp[i + d]
        shared = (x.view(np.uint8).reshape(-1, 8) == 0).sum(1)  # tally of shared positional bytes
        i, x = i[shared >= least], x[shared >= least]
        i = i[np.bitwise_count(x) <= bits]
        j = i + d
        while len(i):  # join the labels of linked rows, smallest index first
            low = np.minimum(label[i], label[j])
            np.minimum.at(label, label[i], low)
            np.minimum.at(label, label[j], low)
            while True:
                up = label[label]
                if (up == label).all():
                    break
                label = up
            open_ = label[i] != label[j]
            i, j = i[open_], j[open_]
    moved = np.flatnonzero(label != np.arange(n))
    return fp[moved], fp[label[moved]]


def _link_batches(bits: int, least: int):
    def run(batches):
        held = None

        def links(rows):
            group, fp = rows
            a, b = link_groups(group, fp, bits, least)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])
        for batch in batches:
            if not batch.num_rows:
                continue
            g = np.stack([batch.column(c).to_numpy() for c in range(3)], 1)
            fp = np.ascontiguousarray(batch.column(3).to_numpy()).view(np.uint64)
            if held is not None:
                g, fp = np.concatenate([held[0], g]), np.concatenate([held[1], fp])
            new = np.append(True, (g[1:] != g[:-1]).any(1))
            last = np.flatnonzero(new)[-1]  # the last group may go on in the next batch
            if last:
                yield links((np.cumsum(new)[:last], fp[:last]))
            held = g[last:], fp[last:]
        if held is not None:
            yield links((np.zeros(len(held[1]), int), held[1]))
    return run


def links(kinds: DataFrame, bits: int = 3) -> DataFrame:
    """(a, b): links that connect what fingerprints of at most ``bits`` differing bits connect.

    ``kinds`` has one row per distinct fingerprint ``fp``. More than 3 bits need
    smaller position sets with longer posting lists; more than 7 raise.
    """
    fp = F.col("fp")
    keys = [F.lit(n).cast("long") * (1 << 24) + sum(_byte(fp, p) * (1 << 8 * k) for k, p in enumerate(t))
            for n, t in enumerate(position_sets(bits))]
    posts = kinds.select("fp", F.explode(F.array(*keys)).alias("key"))
    long_lists = (posts.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 2 * BLOCK)
                  .select("key", F.ceil(F.col("n") / BLOCK).cast("long").alias("blocks")))
    own = F.pmod(F.xxhash64("fp"), F.coalesce("blocks", F.lit(1)).cast("long"))
    pairs = (posts.join(long_lists, "key", "left").withColumn("own", own)
             .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("blocks", F.lit(1)) - 1)))
             .select("key", F.least("own", "other").alias("bi"), F.greatest("own", "other").alias("bj"), "fp"))
    grouped = pairs.repartition("key", "bi", "bj").sortWithinPartitions("key", "bi", "bj")
    return grouped.mapInArrow(_link_batches(bits, 8 - bits), "a long, b long").distinct()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) of every node that has a link; root is the least node of its component."""
    def mark(df):
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    e = staged(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
               .where("u != v").distinct(), name)
    seen = mark(e)
    while seen[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .where("u != v").unionByName(least.where("m < u").select("u", F.col("m").alias("v"))).distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        e = staged(small, name)
        now = mark(e)
        if now == seen:
            break
        seen = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))


def group_fingerprints(marked: DataFrame, bits: int = 3) -> DataFrame:
    """(fp, least_id, winner_fp, winner_id, winner_rows) per distinct fingerprint of (id, fp) rows.

    The winner is one (id, fingerprint) of the component: least id, nulls last.
    """
    rows = marked.groupBy("fp", "id").agg(F.count(F.lit(1)).alias("n"))
    kinds = staged(rows.groupBy("fp").agg(F.min(F.struct(F.col("id").isNull().alias("nil"), "id", "fp", "n")).alias("w")),
                   "simhash-kinds")
    roots = components(links(kinds, bits), "simhash-links")
    roots = roots.unionByName(roots.select(F.col("root").alias("node"), "root")).distinct()
    linked = kinds.join(roots, kinds["fp"] == roots["node"], "left").select("fp", "w", F.coalesce("root", "fp").alias("root"))
    win = linked.groupBy("root").agg(F.min("w").alias("win"))
    return linked.join(win, "root").select("fp", F.col("win.id").alias("winner_id"), F.col("win.fp").alias("winner_fp"),
                                           F.col("win.n").alias("winner_rows"))


def near_duplicates(docs: DataFrame, shingle: int = 3, bits: int = 3, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id), one row per document."""
    marked = staged(docs.select(F.col(id_col).alias("id"), fingerprint_column(F.col(text_col), shingle).alias("fp")),
                    "simhash-marks")
    groups = group_fingerprints(marked, bits)
    return (marked.join(groups, "fp", "left")
            .select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                    F.col("winner_id").alias("component_id")))


def keep_one(docs: DataFrame, shingle: int = 3, bits: int = 3, id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """Rows of ``docs``, all columns: one document of each component (least id, nulls last)."""
    fp, rid = fresh(docs.columns, "cf_fp", "cf_rid")
    # rows and fingerprints are written once; what follows reads the narrow columns, then the kept rows
    marks = staged(docs.withColumn(fp, fingerprint_column(F.col(text_col), shingle)).withColumn(rid, F.monotonically_increasing_id()),
                   "simhash-rows")
    marked = marks.select(F.col(id_col).alias("id"), F.col(fp).alias("fp"), F.col(rid).alias("rid"))
    groups = group_fingerprints(marked.select("id", "fp"), bits).where("fp = winner_fp").select("winner_fp", "winner_id")
    # of the winner's rows (same id and fingerprint) the first one stays
    kept = (marked.join(groups, (marked["fp"] == groups["winner_fp"]) & marked["id"].eqNullSafe(groups["winner_id"]), "left_semi")
            .groupBy("fp").agg(F.min("rid").alias(rid)).select(rid))
    return _where_kept(marks, staged(kept, "simhash-winners"), rid).select(*docs.columns)


def _where_kept(rows: DataFrame, kept: DataFrame, rid: str) -> DataFrame:
    """Rows whose unique id ``rid`` is in ``kept``, left where they lie: one bit a row id is sent, no text moves."""
    bucket, bits = fresh(rows.columns, "cf_bucket", "cf_bits")
    maps = staged(kept.groupBy(F.bitmap_bucket_number(rid).alias(bucket))
                  .agg(F.bitmap_construct_agg(F.bitmap_bit_position(rid)).alias(bits)), "simhash-kept")
    if maps.count() > MAX_BITMAPS:
        return rows.join(kept, rid, "left_semi")
    at = F.bitmap_bit_position(rid)
    byte = F.conv(F.hex(F.substring(F.col(bits), (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return rows.join(F.broadcast(maps), (F.bitmap_bucket_number(rid) == F.col(bucket)) &
                     (byte.bitwiseAND(F.call_function("shiftleft", F.lit(1), (at % 8).cast("int"))) != 0), "left_semi")
