"""List, nearest neighbours and radius search, exact, on a collection's frame.

A frame has (id long, vector array<double>, metadata string). Results are
(id, metadata, distance). Nothing runs before an action.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors


def listed(frame: DataFrame, predicate: Column | None = None, offset: int = 0, limit: int = 0, order: str = "string") -> DataFrame:
    """A page of the records. Ids are in the order of their decimal digits as text (1, 10,
    2), or as numbers with order="numeric". Vectors aren't read."""
    rows = frame if predicate is None else frame.where(predicate)
    rows = rows.select("id", "metadata", F.lit(0.0).alias("distance"))
    keys = [F.col("id").cast("string")] if order == "string" else [F.col("id")]
    rows = rows.orderBy(*keys)
    if offset:
        rows = rows.offset(offset)
    return rows.limit(limit) if limit else rows


def measured(frame: DataFrame, query: Column, method: str, predicate: Column | None = None) -> DataFrame:
    """(id, metadata, distance); the predicate comes before the distance."""
    rows = frame if predicate is None else frame.where(predicate)
    return rows.select("id", "metadata", vectors.distance(F.col("vector"), query, method).alias("distance"))


def nearest(frame: DataFrame, query: Column, k: int, method: str, predicate: Column | None = None) -> DataFrame:
    """The k nearest, ascending, ties by id: a top-k on each partition and one of those."""
    return measured(frame, query, method, predicate).orderBy("distance", "id").limit(k)


def within(frame: DataFrame, query: Column, radius: float, method: str, predicate: Column | None = None) -> DataFrame:
    """All up to a distance, inclusive, ascending, ties by id."""
    return measured(frame, query, method, predicate).where(F.col("distance") <= radius).orderBy("distance", "id")


def ranked(ids: np.ndarray, distances: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest, ties by id."""
    keep = np.lexsort((ids, distances))[:k]
    return ids[keep], distances[keep]


#: Queries that are measured against a batch of records at once, and bytes of query vectors that travel to every task.
QUERY_BLOCK, QUERY_BYTES = 256, 16 << 20

#: Rows that a task has at least where they are dealt to tasks for many passes.
ROWS = 4096


#: Rows among which each query's first limit is looked for; numbers of the pairs that are measured at once.
FIRST, PAIRS = 2048, 1 << 19


def _measured(rows: np.ndarray, i: np.ndarray, queries: np.ndarray, j: np.ndarray, method: str) -> np.ndarray:
    """Distances of rows[i] to queries[j], in bounded memory."""
    step = max(1, PAIRS // max(1, rows.shape[1]))
    at = range(0, max(1, len(i)), step)
    return np.concatenate([vectors.pair_distances(rows[i[a : a + step]], queries[j[a : a + step]], method) for a in at])


def _first_limits(rows: np.ndarray, rough: np.ndarray, queries: np.ndarray, k: int, method: str) -> np.ndarray:
    """Distances within which each query has k rows: those of rows that look near."""
    if len(rows) < k:
        return np.full(len(queries), np.inf)
    some = rough[:, : max(FIRST, k)]
    near = np.argpartition(some, some.shape[1] - k, axis=1)[:, some.shape[1] - k :]
    return _measured(rows, near.ravel(), queries, np.repeat(np.arange(len(queries)), k), method).reshape(-1, k).max(axis=1)


def _candidates(rows: np.ndarray, queries: np.ndarray, limits: np.ndarray | None, k: int, method: str, left, right) -> tuple[np.ndarray, np.ndarray]:
    """(j, i) of the queries and the rows that can lie within the limits, by one product of short
    floats, and of long ones where these leave too many. left, right: factors by precision."""
    for dtype in (np.float32, np.float64):
        with np.errstate(over="ignore", invalid="ignore"):
            rough = right(dtype) @ left(dtype).T
        if limits is None:
            limits = _first_limits(rows, rough, queries, k, method)
        found = np.flatnonzero(~(rough < vectors.rough_floor(limits, queries, method, dtype)[:, None]))
        if len(found) <= max(rough.size // 32, 2 * k * len(queries)):
            break
    return np.divmod(found, len(rows))


def _top(k: int, method: str):
    def for_queries(ids: np.ndarray, queries: np.ndarray):
        def top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            blocks = [slice(at, at + QUERY_BLOCK) for at in range(0, len(ids), QUERY_BLOCK)]
            # for each query of a block its nearest rows so far, of which all have as many
            best = [(np.empty((len(ids[b]), 0), np.int64), np.empty((len(ids[b]), 0))) for b in blocks]
            right = lru_cache(lambda dtype: vectors.rough_factors(queries, method, dtype, True))
            for batch in batches if k > 0 else ():
                row_ids, found = taken(batch)
                if not len(row_ids):
                    continue
                left = lru_cache(lambda dtype, rows=found: vectors.rough_factors(rows, method, dtype))
                for n, block in enumerate(blocks):
                    have_ids, have = best[n]
                    full = have.shape[1] == k
                    j, i = _candidates(found, queries[block], have[:, -1] if full else None, k, method, left, lambda dtype, b=block: right(dtype)[b])
                    d, i = _measured(found, i, queries[block], j, method), row_ids[i]
                    if full:  # what comes after the last one goes
                        keep = ~((d > have[j, -1]) | ((d == have[j, -1]) & (i > have_ids[j, -1])))
                        j, i, d = j[keep], i[keep], d[keep]
                    m = min(k, have.shape[1] + len(row_ids))
                    at = np.repeat(np.arange(len(have)), have.shape[1])
                    j, i, d = np.r_[at, j], np.r_[have_ids.ravel(), i], np.r_[have.ravel(), d]
                    order = np.lexsort((i, d, j))
                    starts = np.searchsorted(j[order], np.arange(len(have)))
                    order = order[starts[:, None] + np.arange(m)]
                    best[n] = i[order], d[order]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([np.repeat(ids[b], i.shape[1]) for b, (i, _) in zip(blocks, best)])),
                    pa.array(np.concatenate([i.ravel() for i, _ in best])),
                    pa.array(np.concatenate([d.ravel() for _, d in best])),
                ],
                ["query_id", "id", "distance"],
            )

        return top

    return for_queries


def taken(batch: pa.RecordBatch | pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of rows (id, vector, ...), whose vectors must be there and of one length."""
    ids, column = np.asarray(batch.column(0)), batch.column(1)
    sizes = np.unique(pc.list_value_length(column).drop_null())
    if column.null_count or len(sizes) > 1:
        raise ValueError("vectors are missing or differ in length")
    flat = pc.list_flatten(column)
    return ids, np.asarray(flat, np.float64).reshape(len(ids), -1 if len(ids) else 0)


def slice_number(ids: Column, slices: int) -> Column:
    return F.pmod(F.xxhash64(ids.cast("long")), F.lit(slices))


def query_slices(queries: DataFrame) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(number, slices, ids, vectors) of the queries (query_id, vector), up to ``QUERY_BYTES`` at
    a time, by the slice_number() of their ids."""
    queries = queries.select(F.col("query_id").cast("long").alias("query_id"), vectors.doubles("vector").alias("vector"))
    size = queries.select(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.size("vector").cast("long")), F.lit(0)).alias("width")).first()
    slices = 1 if size.width * 8 <= QUERY_BYTES else min(size.n, -(-16 * size.width // max(1, QUERY_BYTES)))
    for s in range(slices):
        part = queries if slices == 1 else queries.where(slice_number(F.col("query_id"), slices) == s)
        ids, matrix = taken(part.toArrow())
        if len(ids):
            order = np.argsort(ids, kind="stable")
            yield s, slices, ids[order], matrix[order]


def spread(rows: DataFrame, slices: int, n: int) -> DataFrame:
    """Rows that ``slices`` passes go over, dealt by id to as many tasks as run at once, however
    few files or row groups they are in. All passes read one shuffle; a single one needs none.
    ``n``: how many queries there are in a slice, about."""
    tasks = min(rows.sparkSession.sparkContext.defaultParallelism, slices * n // ROWS)
    return rows.repartition(tasks, "id") if slices > 1 and tasks > 1 else rows


def sliced(rows: DataFrame, queries: DataFrame, k: int, top, extra: str = "") -> DataFrame:
    """The k nearest of each query, ranked: ``top(ids, vectors)`` makes the function that gives
    each task's nearest. ``extra``: a further column, added up over a query's rows, of which
    those with a negative id then go."""
    schema = "query_id long, id long, distance double" + (f", {extra}" if extra else "")
    found = None
    for _, slices, ids, matrix in query_slices(queries):
        if found is None:
            rows = spread(rows, slices, len(ids))
        part = rows.mapInArrow(top(ids, matrix), schema)
        found = part if found is None else found.unionByName(part)
    w = Window.partitionBy("query_id").orderBy("distance", "id")
    if found is None:
        found = rows.sparkSession.createDataFrame([], schema)
    if extra:  # a task's own count is in a row without a record
        found = found.withColumn("searched", F.sum(extra.split()[0]).over(Window.partitionBy("query_id"))).drop(extra.split()[0]).where("id >= 0")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def nearest_batch(frame: DataFrame, queries: DataFrame, k: int, method: str) -> DataFrame:
    """(query_id, id, distance, rank): the k nearest to each query (query_id, vector).

    Queries go to every task, up to ``QUERY_BYTES`` at a time: each such slice is one pass
    over the records, in which a task keeps k rows for each query while vectors stream
    through rough products with ``QUERY_BLOCK`` queries; only pairs that may be within the
    k-th distance so far are measured. A shuffle moves the k rows. More queries are more
    passes; records and queries never meet in a join.
    """
    return sliced(frame.select("id", "vector"), queries, k, _top(k, method))
