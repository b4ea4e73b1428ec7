"""The joins the reference's lookups and loops amount to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusforge.config import RUN_MODELS, SUMMARIZE_PROMPT_LOCALE
from corpusforge.session import checkpoint_root


def models_table(spark: SparkSession) -> DataFrame:
    """The run -> model dimension (fixed, 3 rows)."""
    return spark.createDataFrame(sorted(RUN_MODELS.items()), "run_id long, model string")


def prompts_table(spark: SparkSession) -> DataFrame:
    """The lang -> localised instruction dimension (fixed, 4 rows)."""
    return spark.createDataFrame(sorted(SUMMARIZE_PROMPT_LOCALE.items()), "lang string, instruction string")


def resume_anti_join(inputs: DataFrame, done: DataFrame, name_expr: Column,
                     done_col: str = "out_name") -> DataFrame:
    """Inputs whose output name is not already present in ``done``."""
    x = inputs.withColumn("_out", name_expr)
    d = done.select(F.col(done_col).alias("_out"))
    return x.join(d, "_out", "left_anti").drop("_out")


def run_model_lookup(df: DataFrame, spark: SparkSession) -> DataFrame:
    """Attach the model name of each run (broadcast of a fixed 3-row table)."""
    return df.join(F.broadcast(models_table(spark)), "run_id", "left")


def localised_prompt(df: DataFrame, spark: SparkSession, lang_col: str = "lang",
                     on_missing: str = "error", default_lang: str = "en") -> DataFrame:
    """Lang -> instruction. Unknown language raises, or falls back to ``default_lang``."""
    p = F.broadcast(prompts_table(spark))
    x = df.join(p.withColumnRenamed("lang", "_pl"), F.col(lang_col) == F.col("_pl"), "left").drop("_pl")
    if on_missing == "error":
        instr = F.when(F.col("instruction").isNotNull(), F.col("instruction")).otherwise(
            F.raise_error(F.concat(F.lit("no instruction for language: "), F.col(lang_col).cast("string"))))
    elif on_missing == "default":
        instr = F.coalesce(F.col("instruction"), F.lit(SUMMARIZE_PROMPT_LOCALE[default_lang]))
    elif on_missing == "null":
        instr = F.col("instruction")
    else:
        raise ValueError(on_missing)
    return x.withColumn("instruction", instr)


def pair_pred_ref(preds: DataFrame, refs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Pair predictions with references by key (equi-join; AQE picks the strategy)."""
    return preds.join(refs, key, "inner")


def numbered(files: DataFrame, position: str = "position") -> tuple[DataFrame, DataFrame]:
    """(rows with their 0-based place in the list, the list's chunks) of a DataFrame read from files.

    The list is the files in the order of their paths, each in its own order. A
    chunk is a file, or a split of one, by (path, first byte); a row's place is its
    place in the chunk plus the rows of the chunks before it, so nothing but a row
    a chunk is ever ordered in one task. Partitions and the rows in them follow
    from the listing of the files alone, so both uses of a row number agree, after
    a lost executor too.
    """
    mid = F.monotonically_increasing_id()
    cols = [c for c in files.columns if c != position]
    rows = files.select(*cols, F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_from"),
                        mid.alias("_mid"))
    chunks = rows.groupBy("_file", "_from").agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_first"))
    before = Window.orderBy("_file", "_from").rowsBetween(Window.unboundedPreceding, -1)
    checkpoint_root(files.sparkSession)
    chunks = chunks.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).checkpoint(eager=True)
    place = (F.col("_mid") - F.col("_first") + F.col("_before")).cast("long")
    return rows.join(chunks, ["_file", "_from"]).select(*cols, place.alias(position)), chunks


def pair_by_position(preds: DataFrame, refs: DataFrame, position: str = "position") -> tuple[DataFrame, DataFrame]:
    """J4 for lists without ids: the i-th prediction with the i-th reference.

    Both come straight from ``spark.read``. -> (pairs, report): the report counts
    ``predictions``, ``references``, ``pairs`` and what of either list is longer than
    the other (``unpaired_predictions``, ``unpaired_references``), from the chunks'
    counts. Columns that both lists have come from the predictions.
    """
    left, l_chunks = numbered(preds, position)
    right, r_chunks = numbered(refs, position)
    pairs = left.join(right.select(position, *[c for c in right.columns if c not in left.columns]), position)
    total = lambda chunks, side: chunks.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias(side))
    both = total(l_chunks, "_n").select(F.lit(0).alias("_side"), "_n").unionByName(total(r_chunks, "_n").select(F.lit(1).alias("_side"), "_n"))
    sizes = both.agg(F.max(F.when(F.col("_side") == 0, F.col("_n"))).alias("p"), F.max(F.when(F.col("_side") == 1, F.col("_n"))).alias("r"))
    zero = F.lit(0).cast("long")
    report = sizes.select(F.explode(F.array(*[F.struct(F.lit(k).alias("check"), v.cast("long").alias("value")) for k, v in (
        ("predictions", F.col("p")), ("references", F.col("r")), ("pairs", F.least("p", "r")),
        ("unpaired_predictions", F.greatest(F.col("p") - F.col("r"), zero)),
        ("unpaired_references", F.greatest(F.col("r") - F.col("p"), zero)))])).alias("x")).select("x.check", "x.value")
    return pairs, report


def run_subtask_grid(spark: SparkSession, cells: DataFrame, runs=None, subtasks=None) -> DataFrame:
    """Every (run, subtask) cell of the evaluation grid, with empty cells kept.

    The grid is generated from the two fixed lists; the scored cells are
    left-joined to it.
    """
    from corpusforge.config import SUBTASKS_UNOFFICIAL
    runs = runs or sorted(RUN_MODELS)
    subtasks = subtasks or SUBTASKS_UNOFFICIAL
    grid = models_table(spark).filter(F.col("run_id").isin(list(runs))).select(
        "run_id", "model", F.explode(F.array(*[F.lit(s) for s in subtasks])).alias("subtask"))
    return grid.join(cells, ["run_id", "subtask"], "left")
