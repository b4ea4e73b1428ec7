"""A1-A9 aggregations, W3-W5 ranking reports, O3 top-k.

Percentiles use a histogram: group by (group, value) first, so the window that
makes the running count sees one row per distinct value, not one per record.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusforge.config import IGNORE_ID, PAD_ID


def _value_at(idx: Column) -> Column:
    """Smallest histogram value whose running count exceeds a 0-based index."""
    return F.min(F.when(F.col("_cum") > idx, F.col("_v")))


def _histogram(df: DataFrame, group_cols: list[str], value: Column) -> DataFrame:
    hist = df.select(*group_cols, value.alias("_v")).filter(F.col("_v").isNotNull()) \
        .groupBy(*group_cols, "_v").agg(F.count(F.lit(1)).alias("_cnt"))
    w = Window.partitionBy(*group_cols).orderBy("_v") if group_cols else Window.orderBy("_v")
    wn = Window.partitionBy(*group_cols) if group_cols else Window.partitionBy()
    return hist.withColumn("_cum", F.sum("_cnt").over(w)).withColumn("_n", F.sum("_cnt").over(wn))


def rank_percentiles(df: DataFrame, group_cols: list[str], value_col: str,
                     ps=(0.9, 0.95), names=("percentile_90", "percentile_95")) -> DataFrame:
    """sorted[int(n*p)] per group, exact."""
    h = _histogram(df, group_cols, F.col(value_col))
    aggs = [_value_at(F.floor(F.col("_n").cast("double") * F.lit(float(p)))).cast("long").alias(nm)
            for p, nm in zip(ps, names)]
    return h.groupBy(*group_cols).agg(F.first("_n").cast("long").alias("count"), *aggs)


def length_stats(df: DataFrame, group_cols: list[str], text_col: str) -> DataFrame:
    """A1: count, min, max, mean, median, p90, p95 of text length in code points.

    Null texts are skipped (the reference skips non-strings). A group with no
    valid text yields no row.
    """
    h = _histogram(df, group_cols, F.length(F.col(text_col)).cast("long"))
    n = F.col("_n")
    lo, hi = F.floor((n - 1) / 2), F.floor(n / 2)
    return h.groupBy(*group_cols).agg(
        F.first("_n").cast("long").alias("count"),
        F.min("_v").cast("long").alias("min"),
        F.max("_v").cast("long").alias("max"),
        F.round(F.sum(F.col("_v") * F.col("_cnt")) / F.sum("_cnt"), 2).alias("mean"),
        ((_value_at(lo) + _value_at(hi)) / F.lit(2.0)).alias("median"),
        _value_at(F.floor(n.cast("double") * F.lit(0.9))).cast("long").alias("percentile_90"),
        _value_at(F.floor(n.cast("double") * F.lit(0.95))).cast("long").alias("percentile_95"))


def length_report(df: DataFrame, group_cols: list[str], text_cols: list[str]) -> DataFrame:
    """A2: A1 for every (group..., column) in one pass (unpivot, then group)."""
    long = df.select(*group_cols, *[F.col(c).cast("string") for c in text_cols]) \
        .unpivot(group_cols, text_cols, "column", "text")
    return length_stats(long, [*group_cols, "column"], "text")


def length_report_totals(df: DataFrame, group_cols: list[str], text_cols: list[str]) -> DataFrame:
    """A2 with totals and a row for empty sets.

    One shuffle counts lengths for all levels (grouping sets over group...,
    column, length): every leading part of ``group_cols`` down to all records,
    always per text column. ``level`` is the number of group columns summed over. A
    set of records without a valid text has a row with count 0, null figures and a
    ``message``, as the single report has.
    """
    long = (df.select(*group_cols, *[F.col(c).cast("string") for c in text_cols]).unpivot(group_cols, text_cols, "column", "text")
            .select(*group_cols, "column", F.length("text").cast("long").alias("_v")))
    kept = [group_cols[:k] for k in range(len(group_cols), -1, -1)]
    level = sum((F.grouping(c).cast("int") for c in group_cols), F.lit(0))
    hist = long.groupingSets([[F.col(c) for c in (*g, "column", "_v")] for g in kept], *group_cols, "column", "_v").agg(
        level.alias("level"), F.count(F.lit(1)).alias("_all"))
    by = ["level", *group_cols, "column"]
    hist = hist.withColumn("_cnt", F.when(F.col("_v").isNull(), 0).otherwise(F.col("_all")))
    run = Window.partitionBy(*by).orderBy(F.col("_v").asc_nulls_first())
    hist = hist.withColumn("_cum", F.sum("_cnt").over(run)).withColumn("_n", F.sum("_cnt").over(Window.partitionBy(*by)))
    n, some = F.col("_n"), F.when(F.col("_v").isNotNull(), F.col("_v"))
    at = lambda idx: F.min(F.when(F.col("_cum") > idx, some))
    message = F.concat(F.lit("No valid '"), F.col("column"), F.lit("' fields found."))
    return hist.groupBy(*by).agg(
        F.first("_n").cast("long").alias("count"), F.min(some).alias("min"), F.max(some).alias("max"),
        F.round(F.try_divide(F.sum(some * F.col("_cnt")), F.sum("_cnt")), 2).alias("mean"),
        ((at(F.floor((n - 1) / 2)) + at(F.floor(n / 2))) / F.lit(2.0)).alias("median"),
        at(F.floor(n.cast("double") * F.lit(0.9))).cast("long").alias("percentile_90"),
        at(F.floor(n.cast("double") * F.lit(0.95))).cast("long").alias("percentile_95"),
    ).withColumn("message", F.when(F.col("count") == 0, message))


def mean_scores(scores: DataFrame, group_cols: list[str], decimals: int = 4) -> DataFrame:
    """A3: mean per metric (long score table), rounded."""
    return scores.groupBy(*group_cols, "metric").agg(
        F.round(F.avg("score"), decimals).alias("score"), F.count(F.lit(1)).alias("n"))


def leaderboard(scores: DataFrame, models: DataFrame, metrics: list[str],
                keys=("run_id", "subtask"), decimals: int = 4) -> DataFrame:
    """A4: every metric for every (run, subtask), from wide scores (one column per metric).

    One aggregation with map-side sums; the run dimension joins the few cells
    that are left, by whatever join its size allows.
    """
    wide = scores.groupBy(*keys).agg(*[F.round(F.avg(m), decimals).alias(m) for m in metrics])
    return wide.join(models, "run_id", "left")


def rouge_avg_percent(means: DataFrame, decimals: int = 4) -> DataFrame:
    """A5: rouge_avg = mean(rouge1, rouge2, rougeL); all values x100, rounded."""
    avg = (F.col("rouge1") + F.col("rouge2") + F.col("rougeL")) / F.lit(3.0)
    cols = [c for c in ("rouge1", "rouge2", "rougeL", "rougeLsum") if c in means.columns]
    keys = [c for c in means.columns if c not in cols]
    return means.select(*keys, *[F.round(F.col(c) * 100, decimals).alias(c) for c in cols],
                        F.round(avg * 100, decimals).alias("rouge_avg"))


def nonpad_len(ids, pad: int = PAD_ID) -> Column:
    c = F.col(ids) if isinstance(ids, str) else ids
    return F.size(F.filter(c, lambda x: x != F.lit(pad)))


def mean_nonpad_len(df: DataFrame, group_cols: list[str], pred_ids: str, label_ids: str,
                    pad: int = PAD_ID, also: tuple = ()) -> DataFrame:
    """Mean non-pad lengths of predictions and references; ``also`` are more aggregates of the same rows."""
    return df.groupBy(*group_cols).agg(
        F.avg(nonpad_len(pred_ids, pad)).alias("mean_generated_len"),
        F.avg(nonpad_len(label_ids, pad)).alias("mean_reference_len"), *also)


def combined_loss(losses: DataFrame, alpha: float, keys=("step",)) -> DataFrame:
    """alpha*pred + (1-alpha)*expl per step; steps missing a task are dropped."""
    a = F.lit(float(alpha))
    return (losses.groupBy(*keys).agg(
                F.sum(F.col("loss") * F.when(F.col("task") == "pred", a).otherwise(F.lit(1.0) - a)).alias("loss"),
                F.sum(F.when(F.col("task") == "pred", F.col("loss"))).alias("loss_pred"),
                F.sum(F.when(F.col("task") == "expl", F.col("loss"))).alias("loss_expl"),
                F.count_if(F.col("task") == "pred").alias("_np"),
                F.count_if(F.col("task") == "expl").alias("_ne"))
            .filter((F.col("_np") > 0) & (F.col("_ne") > 0)).drop("_np", "_ne"))


def argmax(v) -> Column:
    """Index of the largest value, ties to the lowest index."""
    c = F.col(v) if isinstance(v, str) else v
    return (F.array_position(c, F.array_max(c)) - 1).cast("long")


def token_accuracy(df: DataFrame, group_cols: list[str], logits_col: str, label_col: str,
                   shift_by: tuple | None = None) -> DataFrame:
    """Mean of argmax == label over all positions (reference), and ignoring -100.

    ``shift_by`` = (sequence columns, position column) compares each position
    with the next label of its sequence, the last position with none.
    """
    label = F.col(label_col)
    if shift_by:
        seq, pos = shift_by
        df = df.select(*group_cols, argmax(logits_col).alias("_a"), F.lead(label).over(
            Window.partitionBy(*seq).orderBy(pos)).alias("_l")).where(F.col("_l").isNotNull())
        hit, label = (F.col("_a") == F.col("_l")).cast("int"), F.col("_l")
    else:
        hit = (argmax(logits_col) == label).cast("int")
    valid = label != F.lit(IGNORE_ID)
    return df.groupBy(*group_cols).agg(
        F.avg(hit).alias("accuracy"),
        F.try_divide(F.sum(F.when(valid, hit)), F.count_if(valid)).alias("accuracy_ignore_index"),
        F.count(F.lit(1)).alias("positions"))


def training_log_long(losses: DataFrame, alpha: float, phase: str = "train", accuracy: DataFrame | None = None,
                      rates: DataFrame | None = None) -> DataFrame:
    """Per-step log rows (step, name, value).

    Names are <phase>/loss, <phase>/loss_pred, <phase>/loss_expl; with an
    ``accuracy`` table (step, task, accuracy) <phase>/pred_accuracy and
    <phase>/expl_accuracy; with a ``rates`` table (step, learning_rate) learning_rate.
    """
    c = combined_loss(losses, alpha)
    names = [f"{phase}/{n}" for n in ("loss", "loss_pred", "loss_expl")]
    out = c.select("step", *[F.col(n.split("/")[1]).alias(n) for n in names]).unpivot(["step"], names, "name", "value")
    if accuracy is not None:
        out = out.unionByName(accuracy.select("step", F.concat(F.lit(f"{phase}/"), "task", F.lit("_accuracy")).alias("name"),
                                              F.col("accuracy").alias("value")))
    if rates is not None:
        out = out.unionByName(rates.select("step", F.lit("learning_rate").alias("name"), F.col("learning_rate").alias("value")))
    return out


def _evals(hist: DataFrame, eval_steps: int, eval_delay: int) -> DataFrame:
    return hist.filter((F.col("step") >= eval_delay) & (F.col("step") % eval_steps == 0))


def best_checkpoint(hist: DataFrame, eval_steps: int, eval_delay: int,
                    run_col: str = "run") -> DataFrame:
    """Evaluated step with the largest metric per run; ties go to the earlier step."""
    e = _evals(hist, eval_steps, eval_delay)
    best = F.max(F.struct(F.col("metric"), (-F.col("step")).alias("neg_step")))
    return e.groupBy(run_col).agg(best.alias("_b"), F.count(F.lit(1)).alias("n_evals")) \
        .select(run_col, (-F.col("_b.neg_step")).alias("best_step"),
                F.col("_b.metric").alias("best_metric"), "n_evals")


def retained_checkpoints(hist: DataFrame, eval_steps: int, eval_delay: int,
                         run_col: str = "run") -> DataFrame:
    """Checkpoints kept with a limit of one: the last one and the best one."""
    e = _evals(hist, eval_steps, eval_delay)
    best = F.max(F.struct(F.col("metric"), (-F.col("step")).alias("neg_step")))
    g = e.groupBy(run_col).agg(F.max("step").alias("_last"), best.alias("_b"))
    g = g.select(run_col, "_last", (-F.col("_b.neg_step")).alias("_best"))
    return g.select(run_col, F.explode(F.array_distinct(F.array("_last", "_best"))).alias("step"),
                    "_last", "_best") \
        .select(run_col, "step", (F.col("step") == F.col("_last")).alias("is_last"),
                (F.col("step") == F.col("_best")).alias("is_best"))


def longest_records(df: DataFrame, group_cols: list[str], text_col: str, key_col: str,
                    k: int) -> DataFrame:
    """O3: top-k longest records per group (ties by key); a per-group limit Catalyst pushes down."""
    w = Window.partitionBy(*group_cols).orderBy(F.length(text_col).desc(), F.col(key_col))
    return (df.select(*group_cols, key_col, F.length(text_col).cast("long").alias("n_chars"),
                      F.row_number().over(w).alias("rank"))
            .filter(F.col("rank") <= k).withColumn("rank", F.col("rank").cast("long")))
