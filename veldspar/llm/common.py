"""What the operators of this subpackage share: words, word ids, shared tables."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import files

WORD = re.compile(r"\w+")

#: Distinct words a worker remembers before it starts its table anew.
REMEMBERED = 200_000


def words_of(text: str | None) -> list[str]:
    """The lower-cased words of a text; a null text has none."""
    return WORD.findall(text.lower()) if text else []


class WordHashes(dict):
    """word -> 64-bit hash, remembered up to a bound."""

    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return value

    def of(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


_BASE = 0x9E3779B97F4A7C15 | 1


def rolling(hashes: np.ndarray, k: int) -> np.ndarray:
    """Karp-Rabin hash of every window of k words, modulo 2**64 and mixed.

    Windows are put together of shorter ones, by the bits of k: the hash of a + b words is
    that of the first a times the base to the power b, plus that of the last b.
    """
    if len(hashes) < k:
        return np.empty(0, np.uint64)
    whole, size = None, 0
    part, span = hashes.astype(np.uint64), 1
    while True:
        if k & span:
            n = len(hashes) - size - span + 1
            if whole is None:
                whole = part[:n].copy()
            else:
                whole = whole[:n] * np.uint64(pow(_BASE, span, 1 << 64))
                whole += part[size : size + n]
            size += span
        if size == k:
            break
        longer = part[: len(part) - span] * np.uint64(pow(_BASE, span, 1 << 64))
        longer += part[span:]
        part, span = longer, span * 2
    whole ^= whole >> np.uint64(31)
    whole *= np.uint64(0xBF58476D1CE4E5B9)
    whole ^= whole >> np.uint64(29)
    return whole


#: Paths made since the innermost ``scratch`` began.
_MADE: list[list[str]] = []


def table_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    path = files.table_path(spark, name)
    if _MADE:
        _MADE[-1].append(path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What is written to the shared folder within goes when it ends: for intermediate tables
    of a result that is written already."""
    _MADE.append([])
    try:
        yield
    finally:
        for path in _MADE.pop():
            files.Files(spark, path).delete()


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it again: lineage ends here, and a
    lost executor costs nothing that was computed before."""
    return written(df, table_path(df.sparkSession, name))


def written(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def keyed_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, text) of the rows that have both; other columns never travel."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")


def column_values(batch: pa.RecordBatch, *names: str) -> list[list]:
    return [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names]


def per_batch(function: Callable[[pa.RecordBatch], pa.RecordBatch]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield function(batch)

    return run
