"""Sinks. Executors write as they go; nothing passes through the driver."""

from __future__ import annotations

import os
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROWS_PER_ARRAY_FILE = 50_000
#: Text bytes that end a JSON-array file; it is built in one cell.
BYTES_PER_ARRAY_FILE = 64 << 20


def write_json_lines(df: DataFrame, path: str) -> None:
    """Streamed JSON sink (JSON Lines, one record per line)."""
    df.write.mode("overwrite").json(path)


def write_splits(df: DataFrame, path: str) -> None:
    """Prepared dataset laid out as split=/lang= directories."""
    df.write.mode("overwrite").partitionBy("split", "lang").parquet(path)


def write_predictions(df: DataFrame, path: str, by=("subtask", "run_id")) -> None:
    """S5/S8 table form: predictions partitioned so readers prune to one cell."""
    df.write.mode("overwrite").partitionBy(*by).parquet(path)


def write_json_arrays(df: DataFrame, path: str, group_col: str, key_col: str, name: str = "records",
                      rows_per_file: int = ROWS_PER_ARRAY_FILE, compression: str = "none") -> list[str]:
    """One JSON array per file, named '<name>-<bucket>_<group>.json' (and '.gz' with ``compression`` "gzip").

    A file is bounded by rows and by bytes. A task writes the rows that it has into
    files of its own, so no row is shuffled, whatever its key; what a task holds of all
    groups is bounded by a file's bytes. A null group is written as Spark's default partition.
    Returns the written file paths (a list as long as the number of files).
    """
    from pyspark import TaskContext
    x = df.select(F.col(group_col), F.to_json(F.struct(*[c for c in df.columns if c != group_col])).alias("value"))
    schema = T.StructType([x.schema[group_col], T.StructField("_b", T.LongType()), T.StructField("value", T.StringType())])
    most = BYTES_PER_ARRAY_FILE

    def arrays(batches):
        number, held, total = TaskContext.get().partitionId() << 33, {}, 0

        def array(group):
            nonlocal number, total
            rows, size = held.pop(group)
            number, total = number + 1, total - size
            return pa.RecordBatch.from_arrays([pa.array([group], group_type), pa.array([number - 1], pa.int64()),
                                               pa.array([b"[" + b",".join(rows) + b"]"], pa.binary()).view(pa.string())], names=schema.names)
        for b in batches:
            group_type = b.column(0).type
            for group, row in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist()):
                rows, size = held.setdefault(group, ([], 0))
                rows.append(row)
                held[group], total = (rows, size + len(row)), total + len(row)
                if len(rows) >= rows_per_file:
                    yield array(group)
                while total >= most:
                    yield array(max(held, key=lambda g: held[g][1]))
        for group in list(held):
            yield array(group)
    tmp = path.rstrip("/") + "/_staging"
    x.mapInArrow(arrays, schema).write.mode("overwrite").option("compression", compression).partitionBy(group_col, "_b").text(tmp)
    return _rename_parts(df, tmp, path, group_col, name)


def _rename_parts(df: DataFrame, tmp: str, dest: str, group_col: str, name: str) -> list[str]:
    """Driver-side metadata moves (Hadoop FileSystem) into the flat naming scheme."""
    jvm = df.sparkSession._jvm
    conf = df.sparkSession._jsc.hadoopConfiguration()
    src_root = jvm.org.apache.hadoop.fs.Path(tmp)
    fs = src_root.getFileSystem(conf)
    out = []
    it = fs.listFiles(src_root, True)
    while it.hasNext():
        p = it.next().getPath()
        fname = p.getName()
        if not fname.startswith("part-"):
            continue
        b_dir, g_dir = p.getParent().getName(), p.getParent().getParent().getName()
        group = g_dir.split("=", 1)[1]
        bucket = b_dir.split("=", 1)[1]
        target = jvm.org.apache.hadoop.fs.Path(f"{dest.rstrip('/')}/{name}-{bucket}-{len(out)}_{group}.json{'.gz' if fname.endswith('.gz') else ''}")
        fs.rename(p, target)
        out.append(target.toString())
    fs.delete(src_root, True)
    return out


def write_result_log(results: DataFrame, path: str) -> None:
    """The result log, rebuilt as a whole on each run (JSON lines, one line a result)."""
    results.write.mode("overwrite").json(path)


def export_text_files(df: DataFrame, folder: str, name_col: str, text_col: str, encoding: str = "utf-8") -> None:
    """S8 submission export: one text file per row, named by ``name_col``.

    Needs a shared folder that executors mount. Every row ends up as a file or
    the job fails: a row without a name and a write error both raise. Files are
    put in place whole, so a retried task leaves the same folder. A task writes
    through one hidden file of its own: the folder's lock is what many tasks wait for.
    """
    nameless = df.filter(F.col(name_col).isNull()).limit(1).count()
    if nameless:
        raise ValueError(f"{name_col} is null in a row to export")

    def put(batches):
        os.makedirs(folder, exist_ok=True)
        part = os.path.join(folder, f".{uuid.uuid4().hex}")
        for pdf in batches:
            for name, body in zip(pdf[name_col], pdf[text_col].fillna("")):
                with open(part, "wb") as f:
                    f.write(body.encode(encoding))
                os.replace(part, os.path.join(folder, name))
            yield pdf[[name_col]]
    wrote = df.select(name_col, text_col).mapInPandas(put, df.select(name_col).schema)
    wrote.write.format("noop").mode("overwrite").save()
