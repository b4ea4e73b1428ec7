"""Record sources."""

from __future__ import annotations

import itertools
import os
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusforge.session import shared_dir

RECORD_SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("input", T.StringType()),
    T.StructField("output", T.StringType()),
    T.StructField("rationale", T.StringType()),
    T.StructField("rationale_prompt", T.StringType()),
])

LANG_FROM_NAME = r"_([a-z]+)\.json(\.gz)?$"

#: Files of a text folder that a task reads, and the bytes of their rows that it hands over at a time.
FILES_PER_TASK = 10_000
FILE_BATCH_BYTES = 4 << 20


def read_json_records(spark: SparkSession, paths, schema: T.StructType = RECORD_SCHEMA) -> DataFrame:
    """Files that each hold one JSON array of records (declared schema, no inference).

    A JSON array is not splittable, so each file is one task; land the result
    as Parquet once and work from that.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    return (spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST")
            .json(paths).withColumn("source_file", F.col("_metadata.file_name")))


def read_manifest(spark: SparkSession, base_dir: str, input_files: list[str],
                  schema: T.StructType = RECORD_SCHEMA) -> DataFrame:
    """The files of a manifest; language = last '_' part of the file name."""
    paths = [f"{base_dir.rstrip('/')}/{f}" for f in input_files]
    df = read_json_records(spark, paths, schema)
    return df.withColumn("lang", F.regexp_extract("source_file", LANG_FROM_NAME, 1))


def _mounted(spark: SparkSession, folder: str) -> str | None:
    """The local path of a folder on a mounted file system; None for other stores and for patterns."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.getUri().getScheme() != "file" or any(c in folder for c in "*?[]{}\\"):
        return None
    return fs.makeQualified(path).toUri().getPath()


def _visible(name: str) -> bool:
    """Whether Spark's readers take a file of that name for data."""
    return not (name.startswith(".") or name.startswith("_") and "=" not in name or name.endswith("._COPYING_"))


def folder_names(spark: SparkSession, folder: str) -> DataFrame:
    """(filename, filepath) of the files that a flat folder holds now; empty ones are left out, as by Spark's file index.

    A mounted folder is listed by tasks, each of which keeps the names that a hash
    deals to it, and the names are staged, so neither the driver nor a task holds
    the list of all files. Another store is listed by Spark's file index.
    """
    root = _mounted(spark, folder)
    if root is None:
        return (spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(folder)
                .select(F.element_at(F.split("path", "/"), -1).alias("filename"), F.col("path").alias("filepath")))
    n = spark.sparkContext.defaultParallelism

    def run(batches):
        for b in batches:
            for k in b.column(0).to_pylist():
                with os.scandir(root) as entries:
                    mine = (e.name for e in entries if zlib.crc32(os.fsencode(e.name)) % n == k and _visible(e.name)
                            and e.is_file() and e.stat().st_size)
                    for names in itertools.batched(mine, 10_000):
                        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([f"file:{root}/{x}" for x in names], pa.string())],
                                                         names=["filename", "filepath"])
    path, schema = shared_dir(spark, "folder-names"), "filename string, filepath string"
    spark.range(0, n, 1, n).mapInArrow(run, schema).write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def _folder_contents(spark: SparkSession, folder: str) -> DataFrame:
    """(filename, filepath, content) of the files of a flat folder, FILES_PER_TASK to a task at most."""
    root = _mounted(spark, folder)
    if root is None:
        return (spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(folder)
                .select(F.element_at(F.split("path", "/"), -1).alias("filename"), F.col("path").alias("filepath"), "content"))
    names = folder_names(spark, folder)
    tasks = max(spark.sparkContext.defaultParallelism, -(-names.count() // FILES_PER_TASK))
    schema = "filename string, filepath string, content binary"

    def run(batches):
        def rows(names, paths, contents):
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(paths, pa.string()), pa.array(contents, pa.binary())],
                                              names=["filename", "filepath", "content"])
        for b in batches:
            held, size = ([], [], []), 0
            for name, path in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                with open(os.path.join(root, name), "rb") as f:
                    row = name, path, f.read()
                for col, x in zip(held, row):
                    col.append(x)
                size += len(row[2])
                if size >= FILE_BATCH_BYTES:
                    yield rows(*held)
                    held, size = ([], [], []), 0
            if held[0]:
                yield rows(*held)
    return names.repartition(tasks).mapInArrow(run, schema)


def read_text_folder(spark: SparkSession, folder: str, max_content_length: int | None = None,
                     encoding: str = "UTF-8") -> DataFrame:
    """S3: flat folder of text files -> (filename, filepath, input).

    Empty files are left out. Files that are not valid UTF-8 are skipped (not repaired); in another
    ``encoding`` (US-ASCII, ISO-8859-1, UTF-16 and kin) they fail the read. \\r\\n and \\r become \\n,
    the content is cropped to ``max_content_length`` code points.
    """
    raw = _folder_contents(spark, folder)
    if encoding.upper().replace("-", "") == "UTF8":
        ok = raw.filter(F.is_valid_utf8(F.col("content").cast("string")))
        text = F.col("content").cast("string")
    else:
        ok, text = raw, F.decode("content", encoding)
    text = F.regexp_replace(text, "\r\n?", "\n")
    if max_content_length is not None:
        text = F.substring(text, 1, max_content_length)
    return ok.select("filename", "filepath", text.alias("input"))


def load_train_valid(spark: SparkSession, path: str) -> DataFrame:
    """The prepared dataset's train and valid splits only (partition pruning on split)."""
    return spark.read.parquet(path).filter(F.col("split").isin("train", "valid"))


def read_predictions(spark: SparkSession, path: str, subtask: str | None = None,
                     run_id: int | None = None) -> DataFrame:
    """Predictions laid out as subtask=/run_id=; optional filters prune partitions."""
    df = spark.read.parquet(path)
    if subtask is not None:
        df = df.filter(F.col("subtask") == subtask)
    if run_id is not None:
        df = df.filter(F.col("run_id") == run_id)
    return df
