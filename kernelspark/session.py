"""Spark session helpers.

On a cluster the session is created by the platform; we only read settings from
it. ``ensure_checkpoint_dir`` honours ``spark.checkpoint.dir`` when the cluster
sets it (a shared folder) and only creates a scratch folder when it is unset,
which is the local/test case.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

_CKPT_KEY = "spark.checkpoint.dir"


def _default_driver_memory() -> str:
    """60 % of physical memory, at most 16g (local mode: the driver is the executor)."""
    try:
        total = os.sysconf("SC_PAGE_SIZE") * os.sysconf("SC_PHYS_PAGES")
        gb = max(1, min(16, int(total * 0.6 / 2**30)))
    except (ValueError, OSError, AttributeError):
        gb = 4
    return f"{gb}g"


def build_session(master: str | None = None, app: str = "kernelspark",
                  shuffle_partitions: int | None = None,
                  driver_memory: str | None = None) -> SparkSession:
    driver_memory = driver_memory or _default_driver_memory()
    cpus = os.environ.get("BENCH_CPUS", "8")
    master = master or f"local[{cpus}]"
    parts = shuffle_partitions or int(cpus) * 2
    spark = (
        SparkSession.builder.master(master).appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", driver_memory)
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "4096")
        .config("spark.python.worker.reuse", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, creating a local one only if unset."""
    sc = spark.sparkContext
    path = spark.conf.get(_CKPT_KEY, None) or sc.getConf().get(_CKPT_KEY, None)
    if not path:
        current = sc._jsc.sc().getCheckpointDir()
        if current.isDefined():
            return current.get()
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError(f"{_CKPT_KEY} must name a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="kernelspark-ckpt-")
        spark.conf.set(_CKPT_KEY, path)
    sc.setCheckpointDir(path)
    return path


def checkpoint_table(df, spark: SparkSession, name: str):
    """Cut lineage by writing ``df`` as Parquet under the shared checkpoint dir.

    Reliable (survives executor loss), unlike local checkpoints.
    """
    import uuid

    base = ensure_checkpoint_dir(spark)
    path = f"{base.rstrip('/')}/tables/{name}-{uuid.uuid4().hex[:12]}"
    df.write.mode("overwrite").parquet(path)
    _TABLES.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.parquet(path)


#: Paths of the tables that ``checkpoint_table`` wrote, by application.
_TABLES: dict[str, list[str]] = {}


def discard_tables(spark: SparkSession, paths: list[str] | None = None) -> int:
    """Delete stored tables (all of this application's, or some) that nothing will read again.

    Only paths that ``checkpoint_table`` wrote in this application are touched. Returns how many went.
    """
    own = _TABLES.get(spark.sparkContext.applicationId, [])
    gone = [p for p in own if paths is None or p in paths]
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for p in gone:
        at = hadoop(p)
        at.getFileSystem(conf).delete(at, True)
        own.remove(p)
    return len(gone)


def last_table(spark: SparkSession) -> str:
    """Path of the table written last."""
    return _TABLES[spark.sparkContext.applicationId][-1]


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``kernelspark`` importable in every Python worker (once per application).

    Arrow functions (mapInPandas, applyInPandas, pandas UDFs) are unpickled in
    the workers, which import this package. A zip of it is added with
    ``SparkContext.addPyFile``, which distributes it to every executor.
    """
    import zipfile

    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    base = spark.conf.get(_CKPT_KEY, None) or ""
    if base.startswith("file:"):
        base = base[5:]
    folder = base if base.startswith("/") and os.path.isdir(base) else tempfile.mkdtemp(prefix="kernelspark-py-")
    path = os.path.join(folder, f"kernelspark-{app}.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as zf:
        for root, _, files in os.walk(pkg):
            for fn in files:
                if fn.endswith(".py"):
                    full = os.path.join(root, fn)
                    zf.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    sc.addPyFile(path)
    _SHIPPED.add(app)
