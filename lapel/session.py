"""Session settings of the tests and the benchmark (a cluster session is taken as it comes), and the scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: str | int = "*", app: str = "lapel", shuffle_partitions: int = 8) -> SparkSession:
    """A local session: AQE on, UTC, no web page, few shuffle partitions."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.sources.parallelPartitionDiscovery.threshold", "1000")
        .config("spark.driver.memory", os.environ.get("LAPEL_DRIVER_MEMORY", "12g"))
        .getOrCreate()
    )


def scratch_dir(spark: SparkSession) -> str:
    """A new folder for intermediate tables in the shared one of spark.checkpoint.dir.

    A cluster without that setting has no folder that all executors see: an error. A local session, as in tests, is its
    own only executor and gets a temporary folder.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return f"{shared.rstrip('/')}/lapel-{uuid.uuid4().hex}"
    if spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
        return "file://" + tempfile.mkdtemp(prefix="lapel-")
    raise ValueError("set spark.checkpoint.dir to a folder that all executors share")


def written_once(df: DataFrame) -> DataFrame:
    """The rows written to the scratch folder and read back, for a result that is used several times."""
    path = scratch_dir(df.sparkSession) + "/rows"
    save(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def save(df: DataFrame, path: str) -> None:
    df.write.parquet(path, compression="zstd")


def id_set(ids: DataFrame) -> DataFrame:
    """The distinct values of a column, NULL left out, worked out once for all that ask for them: written, read back.

    What is read back says between which values the ids lie. Spark carries that over to whatever they are joined with,
    so it reaches the other side's scan; and it lets Spark put a Bloom filter of the ids there, where that side is large
    enough for one (``spark.sql.optimizer.runtime.bloomFilter``).
    """
    (name,) = ids.columns
    known = written_once(ids.filter(F.col(name).isNotNull()).distinct())
    least, most = known.agg(F.min(name), F.max(name)).first()
    return known if least is None else known.filter(F.col(name).between(least, most))
