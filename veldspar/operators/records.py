"""Record maintenance on frames keyed by id, and statistics."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors
from . import search


def latest(frame: DataFrame, sequence: Column | str = "_seq") -> DataFrame:
    """Of each id the row of the highest sequence number."""
    order = F.col(sequence) if isinstance(sequence, str) else sequence
    w = Window.partitionBy("id").orderBy(order.desc())
    return frame.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def upserted(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Existing rows that ``new`` doesn't have, and all of ``new`` (an id once)."""
    return existing.join(new.select("id"), "id", "left_anti").unionByName(new)


def removed(existing: DataFrame, ids: DataFrame) -> DataFrame:
    return existing.join(ids.select("id"), "id", "left_anti")


def metadata_updated(existing: DataFrame, updates: DataFrame) -> DataFrame:
    """Metadata replaced, not merged, where ``updates`` (id, metadata) has the id; vectors stay."""
    new = updates.select("id", F.col("metadata").alias("_new"), F.lit(True).alias("_has"))
    joined = existing.join(new, "id", "left")
    return joined.withColumn("metadata", F.when(F.col("_has"), F.col("_new")).otherwise(F.col("metadata"))).drop("_new", "_has")


#: Records that meet ``QUERY_BLOCK`` others in one product, which stays in a core's cache.
TILE = 1024


def _pair_sums(s: int, ids: np.ndarray, matrix: np.ndarray, method: str):
    """The function that adds up what rows (id, vector, slice) of slices up to ``s`` measure
    against this slice; of two records of one slice the smaller id counts as the row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n, right = 0.0, 0, vectors.factors(matrix, method, True)
        for batch in batches:
            row_ids, found = search.taken(batch)
            number, left = np.asarray(batch.column(2)), vectors.factors(found, method)
            for own, rows in ((False, np.flatnonzero(number < s)), (True, np.flatnonzero(number == s))):
                for start in range(0, len(rows), TILE):
                    tile, tile_ids = left[rows[start : start + TILE]], row_ids[rows[start : start + TILE]]
                    for at in range(0, len(ids), search.QUERY_BLOCK):
                        d = vectors.multiplied_distances(tile, right[at : at + search.QUERY_BLOCK], method)
                        n += d.size
                        if own:
                            other = tile_ids[:, None] >= ids[None, at : at + search.QUERY_BLOCK]
                            np.copyto(d, 0.0, where=other)
                            n -= int(np.count_nonzero(other))
                        total += float(d.sum())
        yield pa.RecordBatch.from_arrays([pa.array([total]), pa.array([n], pa.int64())], ["total", "n"])

    return run


def mean_pair_distance(frame: DataFrame, method: str) -> DataFrame:
    """(average_distance) over all pairs, 0 without any. Each pair is measured once, in products
    of tiles: a slice of the records meets itself and the slices before it."""
    rows, parts = frame.select("id", vectors.doubles("vector").alias("vector")), []
    for s, slices, ids, matrix in search.query_slices(rows.withColumnRenamed("id", "query_id")):
        if not parts:
            rows = search.spread(rows, slices, len(ids))
        numbered = rows.withColumn("slice", search.slice_number(F.col("id"), slices))
        parts.append(numbered.mapInArrow(_pair_sums(s, ids, matrix, method), "total double, n long"))
    # the last slices have the most to meet, and start first
    found = reduce(DataFrame.unionByName, reversed(parts)) if parts else frame.sparkSession.createDataFrame([], "total double, n long")
    return found.agg(F.coalesce(F.try_divide(F.sum("total"), F.sum("n")), F.lit(0.0)).alias("average_distance"))


def sampled_pair_distances(rows: DataFrame, pairs: int = 100, seed: int = 0) -> DataFrame:
    """(name, average_distance): of each name the mean distance of random pairs of its records,
    rows being (name, method, id, vector). Names of fewer than two records have none.

    Records are drawn by the hash of seed and id, as two samples whose rows are paired.
    """
    drawn = []
    for i in (0, 1):
        h = F.xxhash64("id", F.lit(seed * 2 + i))
        n = F.row_number().over(Window.partitionBy("name").orderBy(h, "id"))
        drawn.append(rows.withColumn("n", n).where(F.col("n") <= pairs))
    a = drawn[0].select("name", "n", "method", F.col("id").alias("a"), F.col("vector").alias("va"))
    b = drawn[1].select("name", "n", F.col("id").alias("b"), F.col("vector").alias("vb"))
    d = F.when(F.col("method") == "cosine", vectors.angular(F.col("va"), F.col("vb"))).otherwise(vectors.euclidean(F.col("va"), F.col("vb")))
    return a.join(b, ["name", "n"]).where("a <> b").groupBy("name").agg(F.avg(d).alias("average_distance"))


def sampled_pair_distance(frame: DataFrame, method: str, pairs: int = 100, seed: int = 0) -> float:
    """The same for one collection (id, vector); 0 with fewer than two records."""
    rows = frame.select(F.lit("").alias("name"), F.lit(method).alias("method"), "id", "vector")
    found = sampled_pair_distances(rows, pairs, seed).first()
    return found.average_distance if found else 0.0


def side_counts(frame: DataFrame, normal: Column, offset: float, method: str) -> DataFrame:
    """(right, records): how many vectors lie on each side of a hyperplane."""
    right, _ = vectors.hyperplane_side(F.col("vector"), normal, offset, method)
    return frame.groupBy(right.alias("right")).agg(F.count(F.lit(1)).alias("records"))
