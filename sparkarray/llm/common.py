"""Shared pieces: reading, written intermediate tables, words, digests."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of characters that are not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"

_unset_dir: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all machines share; one of our own where none is set and Spark is local."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where
    if not re.match(r"local($|\[)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _unset_dir:
        _unset_dir.append(tempfile.mkdtemp(prefix="tables-"))
    return _unset_dir[0]


def drop_table(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def written(df: DataFrame, what: str, codec: str = "zstd") -> tuple[DataFrame, str]:
    """``df`` as a Parquet table in the shared folder, read again, and its path.

    It cuts lineage as a checkpoint does, yet keeps column pruning; a lost executor costs its tasks only.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    for made in _recorders:
        made.append(path)
    atexit.register(_forget, spark, path)
    return spark.read.schema(df.schema).parquet(path), path


_recorders: list[list[str]] = []


@contextmanager
def recorded() -> Iterator[list[str]]:
    """The paths of the tables that are written inside."""
    made: list[str] = []
    _recorders.append(made)
    try:
        yield made
    finally:
        _recorders[:] = [m for m in _recorders if m is not made]


def release(spark: SparkSession, paths: Iterable[str]) -> None:
    """Tables that nothing reads any more."""
    for path in paths:
        drop_table(spark, path)


def _forget(spark: SparkSession, path: str) -> None:
    try:
        drop_table(spark, path)
    except Exception:  # noqa: BLE001  the session may be gone by then
        pass


#: A key with more rows than this is hot; its rows don't move for a join with a table that has each key once.
HOT_ROWS = 10_000
#: Hot keys are broadcast up to so many.
MOST_HOT = 200_000


def joined(rows: DataFrame, table: DataFrame, on: list[str], n: str, how: str = "inner") -> DataFrame:
    """``rows`` with the columns of ``table``, which has each key once and in column ``n`` the number of rows with it.

    Hot keys are joined by broadcast (they are counted first), all others by a shuffle that the hot rows take no part in.
    """
    hot, _ = written(table.filter(F.col(n) > HOT_ROWS).drop(n), "hot-keys")
    k = hot.count()
    if not 0 < k <= MOST_HOT:
        return rows.join(table.drop(n), on, how)
    cold = table.filter(F.col(n) <= HOT_ROWS).drop(n)
    return rows.join(F.broadcast(hot), on).unionByName(rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(cold, on, how))


def free_name(df: DataFrame, *wanted: str) -> list[str]:
    """Column names that ``df`` does not use (case apart)."""
    have = {c.lower() for c in df.columns}
    out = []
    for w in wanted:
        while w.lower() in have:
            w = f"_{w}"
        have.add(w.lower())
        out.append(w)
    return out


def col(name: str) -> Column:
    return F.col(f"`{name}`")


def cols(names: Iterable[str]) -> list[Column]:
    return [col(n) for n in names]


def ascii_words(text: Column) -> Column:
    """The words of a text (null: none) as an array."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def n_words(text: Column) -> Column:
    """The number of words without building them: every word becomes one character, the rest goes."""
    return F.size(ascii_words(text)).cast("long")
