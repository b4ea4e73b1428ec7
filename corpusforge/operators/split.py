"""W1/W2 seeded order and exact ratio split; U1-U4 set operations; A11 counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusforge.config import SplitConfig
from corpusforge.operators.rank import (bucket_offsets, hash_bucket, hashed_rank, left_offsets, seeded_hash,
                                        small_table, with_offsets)


def split_bounds(n: Column, cfg: SplitConfig) -> tuple[Column, Column]:
    """train_end = int(n*r1), valid_end = train_end + int(n*r2) (binary doubles)."""
    train_end = F.floor(n.cast("double") * F.lit(float(cfg.train_ratio))).cast("long")
    valid_end = train_end + F.floor(n.cast("double") * F.lit(float(cfg.valid_ratio))).cast("long")
    return train_end, valid_end


def seeded_order(df: DataFrame, group_cols: list[str], key_col: str = "doc_id",
                 seed: int = 42, pos_col: str = "pos") -> DataFrame:
    """Deterministic shuffle position per group, independent of partitioning."""
    return hashed_rank(df, group_cols, key_col, seed, rank_col=pos_col, size_col=None)


def stratified_split(df: DataFrame, group_cols: list[str] | None = None, key_col: str = "doc_id",
                     cfg: SplitConfig = SplitConfig(), keep: tuple | None = None,
                     split_col: str = "split") -> DataFrame:
    """Exact per-group train/valid/test split of a seeded shuffle, without moving records.

    Counts per (group, hash bucket) tell which split a whole bucket belongs to.
    Only the buckets that hold a boundary (two a group at most) are ranked, on
    (hash, key) alone, to find the last row before each boundary; every record
    is then labelled where it lies by comparing with these rows. ``keep``
    limits the output to some splits. Keys are taken to be unique: rows that
    repeat a boundary's key stay on its side.
    """
    cfg.check()
    group_cols = group_cols or ["lang"]
    hashed = df.withColumn("_h", seeded_hash(key_col, cfg.seed)).withColumn("_b", hash_bucket("_h"))
    offs = bucket_offsets(df.select(*group_cols, seeded_hash(key_col, cfg.seed).alias("_h")), group_cols, "_h")
    te, ve = split_bounds(F.col("_n"), cfg)
    lo, hi = F.col("_start") + 1, F.col("_start") + F.col("_cnt")  # ranks in the bucket
    offs = offs.select(*group_cols, "_b", "_cnt", "_start", te.alias("_te"), ve.alias("_ve"), F.when(hi <= te, "train")
                       .when((lo > te) & (hi <= ve), "valid").when(lo > ve, "test").alias("_whole"))
    offs = small_table(offs)
    edge = with_offsets(hashed.select(*group_cols, "_b", "_h", F.col(key_col).alias("_k")), offs.where("_whole IS NULL"), group_cols)
    rank = F.col("_start") + F.row_number().over(Window.partitionBy(*group_cols, "_b").orderBy("_h", "_k"))
    last = F.struct("_h", "_k")
    cuts = (edge.withColumn("_r", rank).where((F.col("_r") == F.col("_te")) | (F.col("_r") == F.col("_ve")))
            .groupBy(*group_cols, "_b").agg(F.max(F.when(F.col("_r") == F.col("_te"), last)).alias("_t"),
                                            F.max(F.when(F.col("_r") == F.col("_ve"), last)).alias("_v")))
    marked = with_offsets(hashed, left_offsets(offs, cuts, group_cols), group_cols)
    here = F.struct("_h", F.col(key_col).alias("_k"))
    # without a row at the train boundary in this bucket, the boundary lies before (or after) all of it
    train = F.coalesce(here <= F.col("_t"), F.col("_start") + F.col("_cnt") <= F.col("_te"))
    valid = F.coalesce(here <= F.col("_v"), F.col("_start") + F.col("_cnt") <= F.col("_ve"))
    split = F.coalesce("_whole", F.when(train, "train").when(valid, "valid").otherwise("test"))
    out = marked.withColumn(split_col, split)
    if keep:
        out = out.filter(F.col(split_col).isin(*keep))
    return out.drop("_h", "_b", "_cnt", "_start", "_te", "_ve", "_whole", "_t", "_v")


def group_split(df: DataFrame, group: Column | str | None = None, cfg: SplitConfig = SplitConfig(), text_col: str = "input",
                split_col: str = "split") -> DataFrame:
    """Split that keeps groups together: copies of a text, or translations by a common ``group`` value.

    Groups are ordered by sha256('<seed>:<group>'). A group belongs to the split in
    which its first row lies when all rows are laid out in that order, so the sizes
    of the splits are those of the exact split within one group. As the order is
    that of the hash, the cut is two hashes: rows are counted by hash bucket (65,536
    numbers), only the buckets that hold a cut are counted by group, and every
    record is labelled where it lies. A group of any size is one hash; no record is
    moved. A null group (by default, a null text) is a group like any other.
    """
    cfg.check()
    value = F.sha2(F.col(text_col), 256) if group is None else F.col(group) if isinstance(group, str) else group
    hashed = df.withColumn("_h", seeded_hash(F.coalesce(value.cast("string"), F.lit("")), cfg.seed)).withColumn("_b", hash_bucket("_h"))
    counts = sorted((r["_b"], r["n"]) for r in hashed.groupBy("_b").agg(F.count(F.lit(1)).alias("n")).collect())  # 65,536 rows at most
    total = sum(n for _, n in counts)
    train_end = int(total * float(cfg.train_ratio))
    cuts = []
    for end in (train_end, train_end + int(total * float(cfg.valid_ratio))):
        start, cut = 0, ""
        for b, n in counts:
            if start < end <= start + n:  # the last group that starts before the end lies here
                sizes = hashed.where(F.col("_b") == b).groupBy("_h").agg(F.count(F.lit(1)).alias("n"))
                before = F.sum("n").over(Window.orderBy("_h").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
                cut = sizes.select("_h", before.alias("s")).where(F.col("s") < end - start).agg(F.max("_h")).first()[0]
                break
            start += n
        cuts.append(cut)
    split = F.when(F.col("_h") <= cuts[0], "train").when(F.col("_h") <= cuts[1], "valid").otherwise("test")
    return hashed.withColumn(split_col, split).drop("_h", "_b")


def merge_languages(df: DataFrame, splits=("train", "valid"), split_col: str = "split") -> DataFrame:
    """Bag union over languages of the given splits (language column kept), in one pass."""
    return df.filter(F.col(split_col).isin(*splits))


def split_counts(df: DataFrame, group_cols=("lang",), split_col: str = "split", totals: bool = False) -> DataFrame:
    """Record counts per (group, split).

    ``totals`` adds the totals of every leading part of (group..., split) by one
    rollup; ``level`` says how many of these columns are summed over (0: none).
    """
    if totals:
        by = [*group_cols, split_col]
        level = sum((F.grouping(c).cast("int") for c in by), F.lit(0))
        return df.rollup(*by).agg(level.alias("level"), F.count(F.lit(1)).alias("n"))
    return df.groupBy(*group_cols, split_col).agg(F.count(F.lit(1)).alias("n"))


def split_leakage(df: DataFrame, key_col: str = "doc_id", text_col: str = "input",
                  split_col: str = "split", source: DataFrame | None = None) -> DataFrame:
    """U4: integrity of a split, one row per check.

    - ``key_overlap``: keys in more than one split (should be 0)
    - ``missing``: keys of ``source`` (the records before the split) that have no
      split, or without it rows whose split is null (should be 0)
    - ``text_leak``: test texts that also occur in train (copies across splits)
    """
    keys = df.select(key_col, split_col)
    by_key = keys.groupBy(key_col).agg(F.countDistinct(split_col).alias("k"))
    overlap = by_key.filter(F.col("k") > 1).agg(F.count(F.lit(1)).alias("value"))
    lost = keys.filter(F.col(split_col).isNull())
    if source is not None:
        has = keys.filter(F.col(split_col).isNotNull()).select(F.col(key_col).alias("_has"))
        lost = source.select(key_col).join(has, F.col(key_col).eqNullSafe(F.col("_has")), "left_anti")
    missing = lost.agg(F.count(F.lit(1)).alias("value"))
    h = F.sha2(F.col(text_col), 256)
    train_h = df.filter(F.col(split_col) == "train").select(h.alias("h")).distinct()
    test = df.filter(F.col(split_col) == "test").select(h.alias("h"))
    leak = test.join(train_h, "h", "left_semi").agg(F.count(F.lit(1)).alias("value"))
    return (overlap.select(F.lit("key_overlap").alias("check"), "value")
            .unionByName(missing.select(F.lit("missing").alias("check"), "value"))
            .unionByName(leak.select(F.lit("text_leak").alias("check"), "value")))
