"""Incremental runs with Structured Streaming.

Files landing in a folder are processed exactly once (file source + checkpoint
+ file sink), with ``trigger(availableNow=True)`` for catch-up batch runs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusforge.operators import annotate as ann
from corpusforge.operators import scores


def _run(query_builder, out_path: str, checkpoint: str, mode: str = "append"):
    q = (query_builder.writeStream.format("parquet").option("path", out_path)
         .option("checkpointLocation", checkpoint).outputMode(mode)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return q


def stream_annotate(spark: SparkSession, in_dir: str, schema: T.StructType, template: str, out: str,
                    model_factory: Callable, out_path: str, checkpoint: str, **kw) -> DataFrame:
    """G1: each new file's records are annotated once; the file sink is exactly-once."""
    src = spark.readStream.schema(schema).parquet(in_dir)
    annotated = ann.annotate(src, template, out, model_factory, **kw)
    _run(annotated, out_path, checkpoint)
    return spark.read.parquet(out_path)


def stream_dedup(spark: SparkSession, in_dir: str, schema: T.StructType, key: str,
                 out_path: str, checkpoint: str, event_time: str | None = None,
                 watermark: str = "1 hour") -> DataFrame:
    """At most one record per key when files repeat (state keyed by ``key``).

    With an event-time column, the state is bounded by a watermark.
    """
    src = spark.readStream.schema(schema).parquet(in_dir)
    if event_time:
        d = src.withWatermark(event_time, watermark).dropDuplicatesWithinWatermark([key])
    else:
        d = src.dropDuplicates([key])
    _run(d, out_path, checkpoint)
    return spark.read.parquet(out_path)


def stream_leaderboard(spark: SparkSession, in_dir: str, schema: T.StructType, refs: DataFrame,
                       state_path: str, checkpoint: str, metrics=("rouge1", "rouge2", "rougeL"),
                       keys=("run_id", "subtask"), files_per_batch: int | None = None) -> DataFrame:
    """Score each micro-batch of predictions, fold per-cell sums and counts into a table.

    ``state_path`` holds two kinds of folders per finished epoch: ``cells/eN``
    (one row per cell) and ``seen/eN`` (the (run, doc) keys counted so far that
    came in that epoch). An epoch is built from the last earlier epoch only, so
    a replayed batch rewrites the same result; a key that lands twice is
    counted once. The result is the last epoch's table, found by listing the
    folder, so a call without new files returns the same table again. Cells of
    older epochs are removed once the next one stands.
    """
    cell_schema = _state_schema(keys, metrics)

    def fold(batch: DataFrame, epoch_id: int):
        done = [e for e in _epochs(spark, f"{state_path}/cells") if e < epoch_id]
        fresh = batch.dropDuplicates(["run_id", "doc_id"])
        seen = [f"{state_path}/seen/e{e}" for e in _epochs(spark, f"{state_path}/seen") if e < epoch_id]
        if seen:
            fresh = fresh.join(spark.read.parquet(*seen), ["run_id", "doc_id"], "left_anti")
        fresh.select("run_id", "doc_id").write.mode("overwrite").parquet(f"{state_path}/seen/e{epoch_id}")
        keys_now = spark.read.parquet(f"{state_path}/seen/e{epoch_id}")
        pairs = batch.dropDuplicates(["run_id", "doc_id"]).join(keys_now, ["run_id", "doc_id"], "left_semi").join(refs, "doc_id")
        wide = scores.metric_suite(pairs, keys=(*keys, "doc_id"), metrics=metrics)
        part = wide.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.sum(m).alias(f"sum_{m}") for m in metrics])
        if done:
            old = spark.read.schema(cell_schema).parquet(f"{state_path}/cells/e{done[-1]}")
            part = old.unionByName(part).groupBy(*keys).agg(F.sum("n").alias("n"), *[F.sum(f"sum_{m}").alias(f"sum_{m}") for m in metrics])
        part.write.mode("overwrite").parquet(f"{state_path}/cells/e{epoch_id}")
        for e in done[:-1]:  # the one before stays until this epoch is committed
            _remove(spark, f"{state_path}/cells/e{e}")

    src = spark.readStream.schema(schema)
    if files_per_batch:
        src = src.option("maxFilesPerTrigger", files_per_batch)
    q = (src.parquet(in_dir).writeStream.option("checkpointLocation", checkpoint).foreachBatch(fold)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    done = _epochs(spark, f"{state_path}/cells")
    st = (spark.read.schema(cell_schema).parquet(f"{state_path}/cells/e{done[-1]}") if done
          else spark.createDataFrame([], cell_schema))
    return st.select(*keys, *[F.round(F.col(f"sum_{m}") / F.col("n"), 4).alias(m) for m in metrics])


def _folder(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def _epochs(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the epoch folders that were written to the end."""
    p, fs = _folder(spark, path)
    if not fs.exists(p):
        return []
    whole = [x.getPath() for x in fs.listStatus(p)
             if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(x.getPath(), "_SUCCESS"))]
    return sorted(int(x.getName()[1:]) for x in whole)


def _remove(spark: SparkSession, path: str) -> None:
    p, fs = _folder(spark, path)
    fs.delete(p, True)


def _state_schema(keys, metrics) -> T.StructType:
    types = {"run_id": T.LongType(), "subtask": T.StringType()}
    return T.StructType([T.StructField(k, types.get(k, T.StringType())) for k in keys]
                        + [T.StructField("n", T.LongType())]
                        + [T.StructField(f"sum_{m}", T.DoubleType()) for m in metrics])
