"""Cutting lineage by writing a step to shared storage.

Every executor must be able to read what another one wrote, so the only folder used is the one the
cluster names in ``spark.checkpoint.dir``. Where that setting is absent and the master is local (tests,
notebooks) a folder of this process is made once; on a cluster its absence is an error.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_FALLBACK: dict[str, str] = {}
#: With it on, a query's shuffle files go when the query ends. A written step no longer needs them.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of the session, without a trailing slash."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        base = _FALLBACK.setdefault(app, "file://" + tempfile.mkdtemp(prefix="presentia-"))
    return base.rstrip("/")


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A fresh path below the shared folder."""
    return f"{scratch_dir(spark)}/presentia/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Writes ``df`` as Parquet in the shared folder and returns a scan of it.

    The scan has file sizes, so later joins are planned from the true size, and a lost executor costs
    no recomputation of what led here.
    """
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.mode("overwrite").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._presentia_path = path
    return out


def release(written: DataFrame) -> None:
    """Deletes the files of a written step that no later plan reads."""
    spark = written.sparkSession
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(written._presentia_path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def partitions_for(n_bytes: float, target_bytes: float, least: int = 1) -> int:
    """How many partitions hold ``n_bytes`` at about ``target_bytes`` each."""
    return max(least, int(-(-n_bytes // target_bytes)))
