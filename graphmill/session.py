"""Session settings, table access and scratch tables shared by all operators."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_DIR: str | None = None
_RUN = uuid.uuid4().hex
_USED: dict[str, SparkSession] = {}


def build_session(master: str = "local[*]", app: str = "graphmill", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session with the settings every operator assumes (UTC, AQE, skew joins)."""
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Only a session on one machine (``local[...]``) may go without the setting;
    it then gets a temporary folder that is removed when Python ends.
    """
    global _LOCAL_DIR
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if _LOCAL_DIR is None or not os.path.isdir(_LOCAL_DIR):
        _LOCAL_DIR = tempfile.mkdtemp(prefix="graphmill-")
        atexit.register(shutil.rmtree, _LOCAL_DIR, ignore_errors=True)
    return "file://" + _LOCAL_DIR


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses; it is removed when Python ends, or by ``cleanup``."""
    root = f"{shared_dir(spark)}/graphmill-{_RUN}"
    if root not in _USED:
        _USED[root] = spark
        if len(_USED) == 1:
            atexit.register(cleanup)
    return f"{root}/{name}-{uuid.uuid4().hex}"


def cleanup() -> None:
    """Delete all scratch tables of this process; frames that read them can then no longer be used."""
    for root, spark in list(_USED.items()):
        try:
            if root.startswith("file:") or "://" not in root:
                shutil.rmtree(root.removeprefix("file://").removeprefix("file:"), ignore_errors=True)
            else:
                remove(spark, root)
        except Exception:  # noqa: BLE001 - the session may be gone; what is left is scratch
            pass
        _USED.pop(root, None)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch table on whatever file system holds it."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def exists(spark: SparkSession, path: str) -> bool:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath)


def listed(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if it does not exist."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in fs.listStatus(jpath)] if fs.exists(jpath) else []


def materialize(df: DataFrame, name: str = "stage", partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    The table cuts the lineage and survives the loss of executors; reading it
    again prunes columns and pushes filters down as with any Parquet source.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def release(*frames: DataFrame) -> None:
    """Delete the scratch tables behind frames made by :func:`materialize`."""
    for df in frames:
        path = getattr(df, "scratch_path", None)
        if path:
            remove(df.sparkSession, path)
