"""Approximate search by locality-sensitive hashing.

A vector's sketch is its distance r from a centre and the signs of its dot products, taken
from there, with ``bits`` random vectors. Two vectors at an angle of a half turns differ in
each sign with the chance a, independently (random hyperplanes). So from two sketches
follows how far apart the vectors can be: those that could lie within a limit, given the
signs that differ, are candidates, and only candidates are measured. A record within the
limit is missed with a chance of ``MISS`` at most, whatever the data are; distances from
the centre alone rule out the rest by the triangle inequality.

For Euclidean distance vectors are taken as they are, for angular distance with length 1,
where the chord takes the place of the angle. The centre is the mean of the vectors when it
is chosen; any other is right too, but tells apart less.

Sketches are columns next to the vector. They need no scale, and no other record, so a
record's sketch is written with it and goes with it. What is compared is native columns:
bit counts of five numbers in each row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import vectors
from . import search

BITS = 256
#: Standard deviations beyond the expected number of differing signs, for a chance of MISS to miss a record within the limit.
SLACK, MISS = 2.0, 0.025
#: Of the records that look nearest by their sketches, so many are measured first, to bound the distance of the k-th.
FIRST, TIMES_K = 64, 4
#: Largest k that is searched approximately.
MOST_K = 1000

WORDS = [f"_s{i}" for i in range(BITS // 64)]
COLUMNS = T.StructType([T.StructField("_r", T.DoubleType()), *(T.StructField(w, T.LongType()) for w in WORDS)])


class Index(Protocol):
    """What a collection asks of an index: a sketch for each record, and candidates."""

    def sketched(self, frame: DataFrame) -> DataFrame: ...
    def candidate(self, query, limit: float) -> Column: ...
    def estimate(self, query) -> Column: ...


@dataclass(frozen=True)
class Sketcher:
    method: str
    dimensions: int
    seed: int = 0
    centre: tuple[float, ...] = ()

    def _planes(self) -> np.ndarray:
        return np.random.default_rng(self.seed).standard_normal((BITS, self.dimensions))

    def _moved(self, matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Vectors as seen from the centre, and whether each has a place at all: the zero
        vector has no direction."""
        placed = np.ones(len(matrix), bool)
        if self.method == "cosine":
            n = np.linalg.norm(matrix, axis=1)
            placed = n > 0
            matrix = matrix / np.where(placed, n, 1.0)[:, None]
        return (matrix - np.array(self.centre) if self.centre else matrix), placed

    def sketch(self, matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(r, signs as longs) of vectors in rows; r is -1 where there is no direction."""
        moved, placed = self._moved(np.asarray(matrix, np.float64).reshape(-1, self.dimensions))
        signs = np.packbits(moved @ self._planes().T > 0, axis=1)
        return np.where(placed, np.linalg.norm(moved, axis=1), -1.0), signs.view(np.int64)

    def sketched(self, frame: DataFrame) -> DataFrame:
        """The frame with sketch columns, null where the vector is null."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                column = batch.column(batch.schema.get_field_index("vector"))
                there = np.asarray(column.is_valid())
                r, words = np.zeros(len(column)), np.zeros((len(column), len(WORDS)), np.int64)
                if there.any():
                    r[there], words[there] = self.sketch(np.asarray(column.drop_null().flatten(), np.float64))
                more = [pa.array(x, mask=~there) for x in (r, *words.T)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, *COLUMNS.names])

        return frame.mapInArrow(run, T.StructType([*frame.schema.fields, *COLUMNS.fields]))

    def _chord(self, limit: float) -> float:
        return limit if self.method == "euclidean" else 2 * np.sin(np.pi / 2 * min(max(limit, 0.0), 1.0))

    def _query(self, query) -> tuple[float, list[int]]:
        r, words = self.sketch(np.asarray(query, np.float64)[None, :])
        return float(r[0]), words[0].tolist()

    @staticmethod
    def _differing(words: list[int]) -> Column:
        total = F.lit(0)
        for name, word in zip(WORDS, words):
            total = total + F.bit_count(F.col(name).bitwiseXOR(F.lit(word)))
        return total

    def candidate(self, query, limit: float) -> Column:
        """Whether a record could lie within the limit of the query."""
        rq, words = self._query(query)
        r, t = F.col("_r"), self._chord(limit)
        if self.method == "cosine" and (rq < 0 or limit >= 1):
            return F.lit(limit >= 1)  # without direction everything is at distance 1
        slack = 1e-9 * (rq + t) + 1e-12
        by_radius = F.abs(r - rq) <= t + slack
        cosine = (r * r + (rq * rq - t * t)) / F.when(r * (2 * rq) > 0, r * (2 * rq)).otherwise(F.lit(1.0))
        a = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine))) / F.pi()
        most = a * BITS + F.sqrt(a * (1 - a) * BITS) * SLACK + 1
        return (r >= 0) & by_radius & ((r * (2 * rq) <= 0) | (self._differing(words) <= most))

    def estimate(self, query) -> Column:
        """The square of the distance, or chord, that the sketches suggest."""
        rq, words = self._query(query)
        r = F.col("_r")
        guess = r * r + rq * rq - r * (2 * rq) * F.cos(self._differing(words) * (np.pi / BITS))
        return F.when(r < 0, F.lit(4.0)).otherwise(guess)

    # the same on numpy, for many queries at once

    def _could(self, r: np.ndarray, words: np.ndarray, rq: float, wq: np.ndarray, limit: float) -> np.ndarray:
        if self.method == "cosine" and (rq < 0 or limit >= 1):
            return np.full(len(r), limit >= 1)
        t = self._chord(limit)
        both = 2 * r * rq
        a = np.arccos(np.clip((r * r + rq * rq - t * t) / np.where(both > 0, both, 1.0), -1.0, 1.0)) / np.pi
        differ = np.bitwise_count((words ^ wq).view(np.uint64)).sum(axis=1)
        return (r >= 0) & (np.abs(r - rq) <= t + 1e-9 * (rq + t) + 1e-12) & ((both <= 0) | (differ <= a * BITS + SLACK * np.sqrt(a * (1 - a) * BITS) + 1))

    def _guess(self, r: np.ndarray, words: np.ndarray, rq: float, wq: np.ndarray) -> np.ndarray:
        guess = r * r + rq * rq - 2 * r * rq * np.cos(np.bitwise_count((words ^ wq).view(np.uint64)).sum(axis=1) * (np.pi / BITS))
        return np.where(r < 0, 4.0, guess)


def centre_of(frame: DataFrame, method: str, dimensions: int) -> tuple[float, ...]:
    """The mean of the vectors, or of their directions: sums of each task, added up by place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(dimensions), 0
        for batch in batches:
            column = batch.column(0).drop_null()
            if len(column):
                moved, placed = Sketcher(method, dimensions)._moved(np.asarray(column.flatten(), np.float64).reshape(len(column), -1))
                total += moved[placed].sum(axis=0)
                n += int(placed.sum())
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64())), pa.array([n], pa.int64())], ["total", "n"])

    sums = frame.select("vector").mapInArrow(run, "total array<double>, n long").select(F.posexplode("total").alias("at", "x"), "n")
    rows = sums.groupBy("at").agg(F.sum("x").alias("x"), F.sum("n").alias("n")).orderBy("at").collect()
    return tuple(r.x / r.n for r in rows) if rows and rows[0].n else ()


def nearest(sketched: DataFrame, query, k: int, sketcher: Sketcher, predicate: Column | None = None) -> tuple[DataFrame, float, list[int]]:
    """The k nearest, approximately, of a frame with sketches; with them the distance they lie
    within, and the ids that were measured first.

    The records that look nearest by their sketches are measured first: the k-th of these
    bounds the distance of the k-th of all, and is the limit for candidates. So there are
    as many rows as an exact search finds.
    """
    if k > MOST_K:
        raise ValueError(f"k is {MOST_K} at most")
    rows, q = sketched if predicate is None else sketched.where(predicate), vectors.literal(query)
    looks = rows.select("id", sketcher.estimate(query).alias("e")).orderBy("e", "id").limit(max(FIRST, TIMES_K * k))
    ids = [r.id for r in looks.collect()]
    measured = search.nearest(rows.where(F.col("id").isin(ids)), q, k, sketcher.method).select("id", "distance").collect()
    if len(measured) < k:  # all there are
        return search.nearest(rows, q, k, sketcher.method), float("inf"), []
    first, limit = [r.id for r in measured], measured[-1].distance
    return search.nearest(rows.where(sketcher.candidate(query, limit) | F.col("id").isin(first)), q, k, sketcher.method), limit, first


def nearest_batch(sketched: DataFrame, queries: DataFrame, k: int, sketcher: Sketcher) -> DataFrame:
    """(query_id, id, distance, rank, searched) of each query (query_id, vector), approximately;
    ``searched`` is the number of records that were measured for it. One pass over the
    records for each slice of queries, as in the exact search."""

    def top(ids: np.ndarray, matrix: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rq, wq = sketcher.sketch(matrix)
            best = [(np.empty(0, np.int64), np.empty(0)) for _ in ids]
            counts = np.zeros(len(ids), np.int64)
            for batch in batches:
                row_ids, r = np.asarray(batch.column(0)), np.asarray(batch.column(2))
                found = np.asarray(batch.column(1).flatten(), np.float64).reshape(len(row_ids), -1)
                words = np.stack([np.asarray(c) for c in batch.columns[3:]], axis=1)
                for j in range(len(ids)):
                    have_ids, have = best[j]
                    if len(have) < k:  # measure what looks nearest, to have a limit
                        guess = sketcher._guess(r, words, rq[j], wq[j])
                        m = min(len(guess), max(FIRST, TIMES_K * k))
                        first = np.argpartition(guess, m - 1)[:m]
                    else:
                        first = np.empty(0, np.int64)
                    chosen = np.zeros(len(row_ids), bool)
                    chosen[first] = True
                    d = vectors.distances(found[first], matrix[j : j + 1], sketcher.method)[:, 0]
                    have_ids, have = search.ranked(np.r_[have_ids, row_ids[first]], np.r_[have, d], k)
                    limit = have[-1] if len(have) == k else np.inf
                    rest = np.flatnonzero((sketcher._could(r, words, rq[j], wq[j], limit) if np.isfinite(limit) else True) & ~chosen)
                    d = vectors.distances(found[rest], matrix[j : j + 1], sketcher.method)[:, 0]
                    counts[j] += len(first) + len(rest)
                    best[j] = search.ranked(np.r_[have_ids, row_ids[rest]], np.r_[have, d], k)
            sizes, n = [len(i) for i, _ in best], sum(len(i) for i, _ in best)
            found_ids, found_d = (np.concatenate([b[x] for b in best]) for x in (0, 1))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.r_[np.repeat(ids, sizes), ids]),
                    pa.array(np.r_[found_ids, np.full(len(ids), -1)].astype(np.int64)),
                    pa.array(np.r_[found_d, np.full(len(ids), np.inf)]),
                    pa.array(np.r_[np.zeros(n, np.int64), counts]),
                ],
                ["query_id", "id", "distance", "measured"],
            )

        return run

    rows = sketched.select("id", "vector", *COLUMNS.names).where("vector IS NOT NULL").withColumn("_r", F.coalesce("_r", F.lit(-1.0)))
    return search.sliced(rows, queries, k, top, "measured long")
