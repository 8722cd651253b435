"""The corpus pipeline: stages over documents, each written as Parquet and read again as the next one's input.

Quality rules, near-duplicates (one document of each group stays), personal data, mixing to target weights, packing. The
last stage returns the pieces of the packed sequences; all others return the columns of documents.

Edge cases follow from the stages: a null or empty text fails the base rules of the first stage and goes; equal rows are
copies, of which one stays; a null doc_id stays null up to the pieces; null language or source counts as empty; very long
texts are treated whole and cut over as many sequences as they need; further columns of documents, whatever their names,
pass through all stages but the last; an empty table gives no pieces. A stage's working tables go when the next stage of the
same thread begins, so what a stage returns has to be written (as ``run`` does) before the next one is called.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps
from threading import get_ident

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkarray.llm import minhash, mixing, packing, pii, quality
from sparkarray.llm.common import recorded, release, table, written

#: The mix takes nine tenths of the tokens it is given, at most two epochs of a source.
SHARE, EPOCHS = (9, 10), 2


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = pii.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in out.columns else out


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs, mixing.WEIGHTS, SHARE, EPOCHS, mixing.SEED)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_pieces(docs)


_working: dict[tuple[int, int], list[str]] = {}


def _stage(k: int, f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """A stage whose predecessor's working tables go: its result has been written when this one begins."""

    @wraps(f)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        me = get_ident()
        release(spark, _working.pop((me, k - 1), []))
        with recorded() as made:
            out = f(spark, docs, sf_dir)
        _working[me, k] = made
        return out

    return run


_ORDER = (("quality", good_quality), ("near-duplicates", near_duplicates), ("personal-data", personal_data), ("mixing", mixing_stage), ("packing", pack))
STAGES = [(name, _stage(k, f)) for k, (name, f) in enumerate(_ORDER)]

#: SQL can't express the signatures or the tokenizer: the tests hold run() against a version by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), []
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs, path = written(docs, f"stage-{name}")
            release(spark, before)
            before = [path]
    return docs
