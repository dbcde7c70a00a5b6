"""Session helpers: one place for the configs every job relies on."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

# Settings that matter at scale; all are plain Spark configs.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # checkpoint files of frames nothing refers to any more are deleted
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_spark(master: str | None = None, app: str = "kindred",
              shuffle_partitions: int | None = None,
              extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the library's defaults.

    On a cluster, call without ``master``; the launcher supplies it.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Make ``kindred`` importable in executor Python workers (once per context).

    The package is zipped on the driver and handed to ``addPyFile``, which
    ships it to every executor; pandas functions defined here then import on
    any worker, whatever the driver's working directory is.
    """
    import zipfile

    sc = spark.sparkContext
    if getattr(sc, "_kindred_shipped", False):
        return
    import kindred
    root = os.path.dirname(os.path.dirname(os.path.abspath(kindred.__file__)))
    fd, path = tempfile.mkstemp(prefix="kindred-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(path, "w") as z:
        for dirpath, _, files in os.walk(os.path.join(root, "kindred")):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(dirpath, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(path)
    sc._kindred_shipped = True


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder the cluster names.

    Read from ``spark.checkpoint.dir``. Only a local session without it gets
    a fresh scratch folder (tests); a cluster without it is an error, since a
    machine-local folder would not survive the loss of an executor.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if not conf:
        if not sc.master.startswith("local"):
            raise RuntimeError(
                "spark.checkpoint.dir is not set; point it at a shared folder")
        conf = tempfile.mkdtemp(prefix="kindred-ckpt-")
    sc.setCheckpointDir(conf)
    return sc.getCheckpointDir() or conf


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` is there, asked of the file system that holds it; a
    file system that fails raises instead of passing for an absent path."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(at)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint (written to the shared folder, survives executor loss).

    A reliable checkpoint writes its files in a second job that recomputes the
    plan unless it is persisted, so the rows are persisted (memory, spilling
    to disk) for the two jobs and released once the files are written.
    """
    from pyspark import StorageLevel
    checkpoint_dir(df.sparkSession)
    held = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return held.checkpoint(eager=True)
    finally:
        held.unpersist()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path under the shared checkpoint folder for stage tables."""
    base = checkpoint_dir(spark)
    return os.path.join(base, "tables", name)


def store(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: lineage is cut, the plan runs once,
    the rows are compressed and never held in memory, and their size is known to joins."""
    import uuid
    at = scratch_path(df.sparkSession, f"stage-{uuid.uuid4().hex}")
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)
