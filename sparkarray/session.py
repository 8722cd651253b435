"""Session settings and lineage cuts."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC")
    if master:
        builder = builder.master(master)
    for k, v in conf.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


_own: list[str] = []


def _folder(spark: SparkSession) -> str:
    """The folder all machines share; one of our own where none is set and Spark is local."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where
    given = spark.sparkContext._jsc.sc().getCheckpointDir()
    if given.isDefined():
        return given.get()
    if not re.match(r"local($|\[)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="cells-"))
    return _own[0]


def cut(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read again: computed once, where a checkpoint computes twice; column
    pruning goes on, and a lost executor costs its tasks only. The table goes when the program ends.
    """
    spark = df.sparkSession
    path = f"{_folder(spark)}/cells-{uuid.uuid4().hex}"
    df.write.option("compression", "lz4").parquet(path)
    atexit.register(_forget, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _forget(spark: SparkSession, path: str) -> None:
    try:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # noqa: BLE001  the session may be gone by then
        pass
