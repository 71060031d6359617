"""Session, shared-folder and materialisation helpers used by every package."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "quillgraph", cores: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings the engine expects (UTC, AQE)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "6g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, from ``spark.checkpoint.dir``.

    Where it is unset, a temporary folder is made, but only on a local master:
    on a cluster such a folder would exist on one machine alone.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local[") and master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="quillgraph-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def spread(df: DataFrame, *keys, least: int = 0) -> DataFrame:
    """``df`` by ``keys`` in as many partitions as are set for shuffles, at any size, or in ``least``.

    Left to itself the planner joins partitions up to a number of compressed
    bytes; ids and repeated words take ten times that in memory.
    """
    return df.repartition(max(least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *keys)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path of its own under the shared folder; nothing else writes there."""
    return f"{shared_dir(spark)}/quillgraph/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write the frame as Parquet to the shared folder, read it back.

    Unlike an executor-local checkpoint the written table survives the loss of
    any executor, and unlike ``checkpoint()`` the plan is computed once.
    ``discard`` removes the table when nothing reads it any more.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    written._scratch = path
    return written


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a file or folder of any file system that Hadoop knows."""
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(there, True)


def discard(*written: DataFrame) -> None:
    """Delete tables of ``materialise``; frames that still read them fail from then on."""
    for df in written:
        remove_path(df.sparkSession, df._scratch)
