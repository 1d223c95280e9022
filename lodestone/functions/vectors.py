"""Distance expressions on array columns, and block-wise numpy kernels for many vectors at once."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

METRICS = ("cosine", "euclidean", "dot")


def _same_length(a: Column, b: Column, value: Column) -> Column:
    return F.when(F.size(a) == F.size(b), value).otherwise(F.raise_error(F.lit("vectors differ in dimension")).cast("double"))


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision; vectors of unlike length raise."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return _same_length(a, b, F.aggregate(products, F.lit(0.0), lambda s, v: s + v))


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; 2 if either vector is zero."""
    return F.when((norm(a) == 0) | (norm(b) == 0), F.lit(2.0)).otherwise(1 - dot(a, b) / (norm(a) * norm(b)))


def euclidean(a: Column, b: Column) -> Column:
    squares = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.sqrt(_same_length(a, b, F.aggregate(squares, F.lit(0.0), lambda s, v: s + v)))


def dot_distance(a: Column, b: Column) -> Column:
    return -dot(a, b)


DISTANCES = {"cosine": cosine_distance, "euclidean": euclidean, "dot": dot_distance}


def distance(metric: str, a: Column, b: Column) -> Column:
    if metric not in DISTANCES:
        raise ValueError(f"metric {metric!r} is none of {', '.join(METRICS)}")
    return DISTANCES[metric](a, b)


def l2_normalise(a: Column, epsilon: float = 0.0) -> Column:
    """v / |v|, and v itself if zero; with an epsilon, v / (|v| + epsilon)."""
    size = norm(a)
    if epsilon:
        return F.transform(a, lambda x: x.cast("double") / (size + epsilon))
    return F.transform(a, lambda x: F.when(size > 0, x.cast("double") / size).otherwise(x.cast("double")))


def similarity_score(metric: str, a: Column, b: Column) -> Column:
    """Scores where more is nearer: inner product for ``mips``, on normalised vectors for ``cosine``, negated squared distance for ``l2``."""
    if metric == "mips":
        return dot(a, b)
    if metric == "cosine":
        return dot(l2_normalise(a), l2_normalise(b))
    if metric == "l2":
        return -euclidean(a, b) * euclidean(a, b)
    raise ValueError(f"metric {metric!r} is none of mips, cosine, l2")


def block_distances(metric: str, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All distances between the rows of two matrices."""
    inner = a @ b.T
    if metric == "dot":
        return -inner
    na, nb = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
    if metric == "euclidean":
        return np.sqrt(np.maximum(na[:, None] ** 2 + nb[None] ** 2 - 2 * inner, 0))
    scale = na[:, None] * nb[None]
    return np.where(scale > 0, 1 - inner / np.where(scale > 0, scale, 1), 2.0)


def relevance_label(dist: Column) -> Column:
    """Words for a distance: highly below 0.3, moderately below 0.7, else weakly relevant."""
    return F.when(dist < 0.3, "highly").when(dist < 0.7, "moderately").otherwise("weakly")


RELEVANCE = {"highly": 0.3, "moderately": 0.7, "weakly": 1.0}


def embedding_bytes(count: Column, dim: Column) -> Column:
    """Memory of so many float vectors with a 24-byte header each."""
    return count * (dim * 4 + 24)
