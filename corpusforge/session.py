"""Session construction and the shared scratch location.

Lineage cuts and staged tables go to the folder the cluster names in
``spark.checkpoint.dir``. Only when that setting is absent (local runs and
tests) do we create one of our own.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def get_session(master: str | None = None, cpus: int | None = None,
                app: str = "corpusforge", extra: dict | None = None) -> SparkSession:
    """Return the active session, or build a local one tuned for these jobs."""
    active = SparkSession.getActiveSession()
    if active is not None and master is None:
        return active
    cpus = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    master = master or f"local[{cpus}]"
    b = (SparkSession.builder.master(master).appName(app)
         .config("spark.ui.enabled", "false")
         .config("spark.sql.shuffle.partitions", str(max(cpus, 4)))
         .config("spark.default.parallelism", str(max(cpus, 4)))
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true")
         # long documents: keep Arrow batches to Python small
         .config("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
         .config("spark.driver.memory", os.environ.get("CORPUSFORGE_DRIVER_MEM", "16g"))
         .config("spark.sql.files.maxPartitionBytes", str(128 * 1024 * 1024)))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    bound_batches(spark)
    ship_package(spark)
    return spark


#: Bytes of an Arrow batch that a Python step gets: a batch of 10,000 whole texts would not fit once it is Python objects.
BATCH_BYTES = 8 << 20


def bound_batches(spark: SparkSession) -> None:
    """Bound the session's Arrow batches by bytes too, unless they are bounded more tightly."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key)) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``corpusforge`` importable by Python workers (once per SparkContext)."""
    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    import zipfile
    pkg = os.path.dirname(os.path.abspath(__file__))
    fd, zpath = tempfile.mkstemp(prefix="corpusforge-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(zpath, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    sc.addPyFile(zpath)
    _SHIPPED.add(app)


def checkpoint_root(spark: SparkSession) -> str:
    """The shared checkpoint folder; set a local one only when none is configured."""
    sc = spark.sparkContext
    d = sc.getCheckpointDir()
    if d:
        return d
    try:
        d = spark.conf.get("spark.checkpoint.dir")
    except Exception:  # noqa: BLE001 - unset key raises on some versions
        d = None
    if not d:
        d = sc.getConf().get("spark.checkpoint.dir", None)
    if not d:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("spark.checkpoint.dir is not set: name a folder that all executors share")
        # Unset on a local master (a test): make our own folder.
        d = tempfile.mkdtemp(prefix="corpusforge-ckpt-")
    sc.setCheckpointDir(d)
    return sc.getCheckpointDir() or d


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh, unique folder under the shared checkpoint location."""
    root = checkpoint_root(spark)
    base = root.rstrip("/")
    return f"{base}/staged/{name}-{uuid.uuid4().hex[:12]}"
