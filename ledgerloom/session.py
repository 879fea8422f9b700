"""Session settings and the shared folder that checkpoints and written tables use."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from types import ModuleType

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

# AQE sizes shuffle partitions, turns small sides into broadcasts at run time and
# splits skewed join partitions, so no equi-join in this package carries a hint.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def build_session(app: str = "ledgerloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings above; keyword settings win (dots written as ``__``)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def carried(module: ModuleType) -> None:
    """Functions of a module of plain helpers travel with the job, so executors need no copy of this package."""
    cloudpickle.register_pickle_by_value(module)


@contextmanager
def settings(spark: SparkSession, **conf: str) -> Iterator[None]:
    """Session settings for the jobs run inside (dots written as ``__``)."""
    wanted = {k.replace("__", "."): v for k, v in conf.items()}
    before = {k: spark.conf.get(k) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Deletes the shuffle files of each job inside when it ends, not when the driver happens to collect its garbage; for writes."""
    with settings(spark, spark__sql__classic__shuffleDependency__fileCleanup__enabled="true"):
        yield


def shared_root(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``; a temporary one only in local mode where it is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="ledgerloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh path below the shared folder, seen by the driver and all executors."""
    return f"{shared_root(spark)}/{purpose}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder, so the rows survive lost executors."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_root(spark))
    return df.checkpoint()


def stored(df: DataFrame, purpose: str, compression: str | None = None) -> DataFrame:
    """Writes a frame below the shared folder and reads it back.

    Like a checkpoint this survives lost executors; unlike one it gives the planner
    the real size, so a small table is broadcast and a large one is not.
    ``compression`` is for frames as long as the input, else the session's codec is used.
    What was shuffled for it is deleted as soon as it is written.
    """
    path = shared_folder(df.sparkSession, purpose)
    with shuffles_dropped(df.sparkSession):
        df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)
