"""SparkSession construction and cluster-safe lineage cutting."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings every job in this package assumes. ANSI stays on (Spark 4 default):
# the operators use try_divide / guarded expressions instead of relying on
# silent nulls from division by zero.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # bar panels are small in bytes but heavy in per-row window / Python work:
    # keep AQE from merging a few-MB shuffle into a couple of tasks (large
    # shuffles are unaffected; they are far above this floor)
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
    # streaming state (bars in progress, per-instrument EMA state) lives in
    # RocksDB: off-heap, incrementally checkpointed, sized by disk not heap
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "barlake", extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the package defaults.

    On a cluster pass ``master=None`` and let spark-submit decide; size
    ``shuffle_partitions`` to the data (about 128 MB of shuffle per partition).
    """
    b = SparkSession.builder.appName(app_name)
    conf = dict(BASE_CONF)
    if master:
        b = b.master(master)
        if master.startswith("local"):
            # local mode: the driver JVM is the only executor
            conf.setdefault("spark.driver.memory", os.environ.get("BARLAKE_DRIVER_MEMORY", "16g"))
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared lineage-cut folder: the cluster's ``spark.checkpoint.dir``.

    A session without that setting (tests, a laptop) uses a folder under its
    own ``spark.sql.warehouse.dir``, which every executor must reach anyway.
    No machine-local temporary folder is ever chosen.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
        configured = f"{warehouse}/_scratch"
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint (survives executor loss; never localCheckpoint)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A sub-folder of the shared checkpoint dir for written stage tables."""
    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage through a compressed Parquet table in the shared folder.

    Cheaper on disk than ``checkpoint()`` (columnar and compressed), and just as
    safe: a lost executor costs nothing that was written. Each call writes to a
    folder of its own; the folders are removed when the driver exits.
    """
    spark = df.sparkSession
    path = scratch_path(spark, f"{name}-{uuid.uuid4().hex[:12]}")
    df.write.parquet(path)
    _remove_at_exit(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Deletes the folders of tables that :func:`written` made and that nothing reads any more."""
    for table in tables:
        path = getattr(table, "__dict__", {}).get("_scratch")
        if path in _SCRATCH:
            _delete(table.sparkSession, path)
            _SCRATCH.remove(path)


_SCRATCH: list[str] = []


def _delete(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    hpath = sc._jvm.org.apache.hadoop.fs.Path(path)
    hpath.getFileSystem(sc._jsc.hadoopConfiguration()).delete(hpath, True)


def _remove_at_exit(spark: SparkSession, path: str) -> None:
    if not _SCRATCH:
        atexit.unregister(_remove_scratch)
        atexit.register(_remove_scratch, spark)
    _SCRATCH.append(path)


def _remove_scratch(spark: SparkSession) -> None:
    sc = spark.sparkContext
    if sc._jsc is None:  # the session was stopped first: nothing can reach the folder any more
        return
    for path in _SCRATCH:
        _delete(spark, path)


def default_parallelism(spark: SparkSession) -> int:
    try:
        return int(spark.sparkContext.defaultParallelism)
    except Exception:  # pragma: no cover - connect sessions
        return int(os.environ.get("BARLAKE_PARALLELISM", "8"))


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``barlake`` importable in Python workers (grouped maps, pandas UDFs).

    Equivalent to ``spark-submit --py-files barlake.zip``: the package is zipped
    once per SparkContext and registered with ``addPyFile``; Spark ships it with
    every task, so workers started from any directory can unpickle our functions.
    """
    import zipfile

    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg)
    out = os.path.join(tempfile.mkdtemp(prefix="barlake-pyfiles-"), "barlake.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for base, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(base, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(out)
    _SHIPPED.add(key)
