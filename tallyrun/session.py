"""Session and shared-storage helpers.

Everything that outlives one job (cut lineage, streaming state, written tables) goes to the folder that the cluster
names in ``spark.checkpoint.dir``.  Only where that is unset in local mode, as in tests, a folder of our own is used; a
cluster without it is refused.  ``remove_scratch`` deletes what an application has written there.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN_DIR: list[str] = []


def build_session(app: str = "tallyrun", cores: int | None = None) -> SparkSession:
    """A local session with the settings that the tests and the bench use; clusters bring their own."""
    master = f"local[{cores}]" if cores else "local[*]"
    parts = str(cores or os.cpu_count() or 8)
    return (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", parts)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", os.environ.get("TALLYRUN_DRIVER_MEMORY", "12g"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors share, made known to Spark for ``checkpoint()``."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        if not _OWN_DIR:
            _OWN_DIR.append("file://" + tempfile.mkdtemp(prefix="tallyrun-"))
            atexit.register(_remove_own)
        conf = _OWN_DIR[0]
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(conf)
    return conf


def _remove_own() -> None:
    import shutil

    for d in _OWN_DIR:
        shutil.rmtree(d.removeprefix("file://"), ignore_errors=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, grouped by application so that it can be removed with it."""
    return f"{shared_dir(spark)}/tallyrun-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def write_out(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage with a written table: survives lost executors and is read with column pruning."""
    path = scratch_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a scratch path on whatever file system it lies."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def remove_scratch(spark: SparkSession) -> None:
    """Delete everything this application wrote to the shared folder; results that still read it must be stored before."""
    remove_path(spark, f"{shared_dir(spark)}/tallyrun-{spark.sparkContext.applicationId}")


def list_names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none where there is no such folder."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []


def is_directory(spark: SparkSession, path: str) -> bool:
    """Whether the path is a directory (a written table) and not a single file."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return bool(fs.getFileStatus(p).isDirectory())
