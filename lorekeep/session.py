"""Session helpers shared by the whole library."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where the session names no folder of its own (tests, notebooks).
_LOCAL_FOLDER: list[str] = []


def local_session(cores: int | str = 8, shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and the benchmark."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("lorekeep")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("LOREKEEP_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, only on a local master, a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _LOCAL_FOLDER:
        _LOCAL_FOLDER.append(tempfile.mkdtemp(prefix="lorekeep-"))
        atexit.register(shutil.rmtree, _LOCAL_FOLDER[0], ignore_errors=True)
    return "file://" + _LOCAL_FOLDER[0]


#: How tables are compressed: they are read once or a few times, and disk is what large inputs run out of.
COMPRESSION = "zstd"


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it again: lineage ends here, and any executor can read it."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/lorekeep/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", COMPRESSION).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A broadcast side has at most so many bytes as a table (compressed).
BROADCAST_BYTES = 64 << 20


def bounded(df: DataFrame, rows: int) -> DataFrame:
    """df marked for broadcast if it has at most so many rows (counted) and BROADCAST_BYTES (the plan's estimate), else as
    it is. df should be a saved table, as counting runs its plan."""
    if df.limit(rows + 1).count() > rows or int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) > BROADCAST_BYTES:
        return df
    return F.broadcast(df)


def small(df: DataFrame, name: str, rows: int) -> DataFrame:
    """df, saved and so computed once, marked for broadcast if it is bounded."""
    return bounded(saved(df, name), rows)
