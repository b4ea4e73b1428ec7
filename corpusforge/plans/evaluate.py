"""Inference-evaluation plans: test references -> pairs -> metrics -> leaderboard.

One Spark job replaces the reference's twelve (run, subtask) processes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusforge.config import SplitConfig
from corpusforge.operators import joins, report, scores
from corpusforge.operators.split import stratified_split
from corpusforge.plans import fixtures

SQL_METRICS = ("rouge1", "rouge2", "rougeL")


def test_references(spark: SparkSession, sf_dir: str, cfg: SplitConfig = SplitConfig()) -> DataFrame:
    """Test split of REC (never cropped): (doc_id, lang, subtask, output).

    Only buckets that can hold test rows go through the rank shuffle.
    """
    r = fixtures.rec(spark, sf_dir).select("doc_id", "lang", "output")
    t = stratified_split(r, ["lang"], "doc_id", cfg, keep=("test",))
    return t.select("doc_id", "lang", F.concat(F.lit("test_"), F.col("lang")).alias("subtask"), "output")


def test_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J4 on the evaluation set: every run's prediction paired with its test reference."""
    return joins.pair_pred_ref(fixtures.pred(spark, sf_dir), test_references(spark, sf_dir))


def predict_and_score(spark: SparkSession, sf_dir: str, models: dict, metrics=("rouge1",)) -> DataFrame:
    """Test split -> localised prompt -> each run's model -> predictions -> mean scores per (run, subtask).

    ``models`` maps run ids to model factories. Predictions are staged before they
    are scored, so a model is asked once per record; refused records have no score.
    """
    from corpusforge.operators import annotate as ann
    r = fixtures.rec(spark, sf_dir).select("doc_id", "lang", "input", "output")
    t = stratified_split(r, ["lang"], "doc_id", SplitConfig(), keep=("test",)).withColumn("subtask", F.concat(F.lit("test_"), "lang"))
    t = joins.localised_prompt(t, spark, on_missing="default").select("doc_id", "subtask", "instruction", "input", "output")
    parts = [ann.split_rejects(ann.materialize(ann.annotate(t, "{instruction}: {input}", "summary", make, keep_prompt=False),
                                               f"predictions-{run}"), "summary")[0].withColumn("run_id", F.lit(run).cast("long"))
             for run, make in sorted(models.items())]
    preds = parts[0]
    for p in parts[1:]:
        preds = preds.unionByName(p)
    wide = scores.metric_suite(preds, keys=("run_id", "subtask", "doc_id"), metrics=metrics)
    return report.leaderboard(wide, joins.models_table(spark), list(metrics))


def leaderboard(spark: SparkSession, sf_dir: str, metrics=SQL_METRICS) -> DataFrame:
    """A4 over S5 -> J4 -> M6: mean metric per (run, subtask) with the model name."""
    s = scores.metric_suite(test_pairs(spark, sf_dir), keys=("run_id", "subtask", "doc_id"), metrics=metrics)
    return report.leaderboard(s, joins.models_table(spark), list(metrics))
