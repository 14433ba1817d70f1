"""From raw documents to sharded training text, in five stages.

Each stage is a function of (spark, docs, sf_dir). run() writes what a stage returns as
Parquet in the shared folder and hands it, read again, to the next.

What holds for all stages: an empty table gives an empty table; rows that repeat a doc_id
are judged as one document and stay or go together, except that each row has its own
language; no decision depends on the order or partitioning of rows, so ties always end
alike; columns besides doc_id, text, lang and source aren't looked at, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from veldspar.llm import decontaminate, langid, mixing, sharding, simhash
from veldspar.llm.common import scratch, written
from veldspar.sources.files import Files, table_path


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the model recognises. A null or empty text, or one without
    letters, has none and goes; a null lang only means that the row isn't trained on. With
    no labelled row at all every document goes."""
    return langid.keep_identified(docs, langid.train(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the smallest doc_id. Rows without
    doc_id, text or a single word are in no group and stay."""
    return simhash.drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages. Rows without doc_id or text stay; benchmark items
    without id or text are passed over, and without items all documents stay."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document once at least, and as often as its source's weight asks. A null source
    is a source of its own; null doc_ids of one source are one document; a source without
    any text is left as it is."""
    return mixing.mixed(docs)


def shard_assignment(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their slot, shard and the version of the map; columns of these names
    are replaced. A null doc_id has slot 0, a null text no bytes; rows of one doc_id have
    one slot."""
    return sharding.sharded(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("source_mixing", source_mixing),
    ("shard_assignment", shard_assignment),
]

#: Fingerprints, tilings and dependent rounding have no SQL; the tests run the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents in ``sf_dir``. A stage's intermediate tables go once it is
    written, and so does what it read, the documents themselves apart."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = table_path(spark, f"stage-{name}")
        with scratch(spark):
            docs = written(stage(spark, docs, sf_dir), path)
        if before:
            Files(spark, before).delete()
        before = path
    return docs
