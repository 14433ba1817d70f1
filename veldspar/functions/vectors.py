"""Distances and other functions of vectors, as columns.

All take array<double> columns (others are cast) and stay in the JVM.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

METHODS = ("euclidean", "cosine")


def doubles(v: Column | str) -> Column:
    return (F.col(v) if isinstance(v, str) else v).cast("array<double>")


def literal(vector) -> Column:
    """A constant vector."""
    return F.lit(np.asarray(vector, np.float64)) if len(vector) else F.array().cast("array<double>")


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return _total(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(_total(F.transform(doubles(v), lambda x: x * x)))


def normalized(v: Column) -> Column:
    """A vector of length 1; the zero vector stays as it is."""
    n = norm(v)
    return F.when(n == 0, doubles(v)).otherwise(F.transform(doubles(v), lambda x: x / n))


def midpoint(a: Column, b: Column) -> Column:
    return F.zip_with(doubles(a), doubles(b), lambda x, y: (x + y) / 2)


def approx_equal(a: Column, b: Column, tolerance: float = 1e-9) -> Column:
    """Of one length, and nowhere further apart than the tolerance."""
    close = F.forall(F.zip_with(doubles(a), doubles(b), lambda x, y: F.abs(x - y) <= tolerance), lambda ok: F.coalesce(ok, F.lit(False)))
    return (F.size(a) == F.size(b)) & close


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(_total(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y))))


def angle(cosine: Column) -> Column:
    """The angle of a cosine as a share of a half turn; rounding errors beyond 1 are cut off."""
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine))) / F.pi()


def angular(a: Column, b: Column) -> Column:
    """The angle between two vectors as a share of a half turn; 1 if either is zero."""
    scale = norm(a) * norm(b)
    return F.when(scale == 0, F.lit(1.0)).otherwise(angle(dot(a, b) / F.when(scale == 0, F.lit(1.0)).otherwise(scale)))


def distance(a: Column, b: Column, method: str) -> Column:
    if method not in METHODS:
        raise ValueError(f"no distance method {method!r}")
    return euclidean(a, b) if method == "euclidean" else angular(a, b)


def hyperplane_side(v: Column, normal: Column, offset: float, method: str) -> tuple[Column, Column]:
    """(right of the hyperplane?, distance to it). For cosine, what is measured is the
    angle to the normal: beyond a quarter turn is right."""
    if method == "euclidean":
        d = dot(v, normal) - offset
        return d > 0, F.abs(d)
    a = angle(dot(v, normal) / norm(v))
    return a > 0.5, F.when(a > 0.5, 1 - a).otherwise(a)


def random_unit(dimensions: int, rng: np.random.Generator) -> np.ndarray:
    v = rng.standard_normal(dimensions)
    n = np.linalg.norm(v)
    return v / n if n else v


# --- the same on numpy, for Arrow batches ------------------------------------------


def distances(vectors: np.ndarray, queries: np.ndarray, method: str) -> np.ndarray:
    """Distance of each vector (rows) to each query (columns)."""
    if method == "euclidean":
        out = np.empty((len(vectors), len(queries)))
        for j, q in enumerate(queries):
            d = vectors - q
            out[:, j] = np.sqrt(np.einsum("ij,ij->i", d, d))
        return out
    scale = np.linalg.norm(vectors, axis=1)[:, None] * np.linalg.norm(queries, axis=1)[None, :]
    safe = np.where(scale == 0, 1.0, scale)
    return np.where(scale == 0, 1.0, np.arccos(np.clip(vectors @ queries.T / safe, -1.0, 1.0)) / np.pi)


def pair_distances(a: np.ndarray, b: np.ndarray, method: str) -> np.ndarray:
    """Distance of each row of one to the same row of the other. Equal rows have equal distances."""
    if method == "euclidean":
        d = a - b
        return np.sqrt(np.einsum("ij,ij->i", d, d))
    scale = np.sqrt(np.einsum("ij,ij->i", a, a)) * np.sqrt(np.einsum("ij,ij->i", b, b))
    safe = np.where(scale == 0, 1.0, scale)
    return np.where(scale == 0, 1.0, np.arccos(np.clip(np.einsum("ij,ij->i", a, b) / safe, -1.0, 1.0)) / np.pi)


def units(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length 1, and the zero vector."""
    n = np.sqrt(np.einsum("ij,ij->i", vectors, vectors))[:, None]
    return vectors / np.where(n == 0, 1.0, n)


def factors(vectors: np.ndarray, method: str, right: bool = False) -> np.ndarray:
    """What multiplied_distances() takes, of the vectors on either side."""
    if method == "cosine":
        return units(vectors)
    squares, ones = np.einsum("ij,ij->i", vectors, vectors)[:, None], np.ones((len(vectors), 1))
    return np.hstack([vectors, ones, squares] if right else [-2 * vectors, squares, ones])


def multiplied_distances(left: np.ndarray, right: np.ndarray, method: str) -> np.ndarray:
    """distances() by one product of factors: as exact as rounding of squares allows."""
    product = left @ right.T
    if method == "euclidean":
        return np.sqrt(np.maximum(product, 0.0, out=product), out=product)
    product[~left.any(axis=1)] = -1.0
    product[:, ~right.any(axis=1)] = -1.0
    return np.divide(np.arccos(np.clip(product, -1.0, 1.0, out=product), out=product), np.pi, out=product)


def rough_factors(vectors: np.ndarray, method: str, dtype: type, right: bool = False) -> np.ndarray:
    """Factors of products that fall as distances() grow, in either precision. Euclidean, a
    product is half the negative square of a distance, and never less by rounding: squares
    are taken too small by more than rounding can do."""
    with np.errstate(over="ignore"):
        if method == "cosine":
            return units(vectors).astype(dtype)
        short = (_rounding(vectors, dtype) - 1) / 2 * np.einsum("ij,ij->i", vectors, vectors)[:, None]
        ones = np.ones((len(vectors), 1))
        return np.hstack([vectors, ones, short] if right else [vectors, short, ones]).astype(dtype)


def rough_floor(limits: np.ndarray, vectors: np.ndarray, method: str, dtype: type) -> np.ndarray:
    """What a rough product of the vectors is at least, where the distance is a limit at most."""
    with np.errstate(over="ignore", invalid="ignore"):
        floor = np.cos(np.pi * limits) - _rounding(vectors, dtype) if method == "cosine" else -(limits**2) / 2 * (1 + 1e-14) - 100.0 * np.finfo(dtype).tiny
        return np.nextafter(floor.astype(dtype), dtype(-np.inf))


def _rounding(vectors: np.ndarray, dtype: type) -> float:
    """Twice what rounding does at most to a product of such vectors, as a share of their squares."""
    return 2.0 * (vectors.shape[1] + 8) * float(np.finfo(dtype).eps)
