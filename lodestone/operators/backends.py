"""Search backends by name, each a function ``(table, query, k, metric, id_col, vec_col) -> (id_col, distance)``."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ivf, knn

Backend = Callable[[DataFrame, list[float], int, str, str, str], DataFrame]
BACKENDS: dict[str, Backend] = {"exact": lambda t, q, k, metric, i, v: knn.knn(t, q, k, metric, i, v), "codes": lambda t, q, k, metric, i, v: knn.two_stage(t, q, k, max(100, 10 * k), metric, i, v)}


def backend(name: str) -> Callable[[Backend], Backend]:
    """Registers a backend."""

    def add(f: Backend) -> Backend:
        BACKENDS[name] = f
        return f

    return add


@backend("lists")
def _lists(table: DataFrame, query: list[float], k: int, metric: str, id_col: str, vec_col: str) -> DataFrame:
    """Inverted lists made for this one search; an index keeps what `ivf.assign` gives."""
    centres = ivf.fit(table, 32, metric, id_col, vec_col)
    one = table.sparkSession.createDataFrame([(-1, np.asarray(query, float).tolist())], "qid long, vec array<double>")
    found = ivf.search(one, ivf.assign(table, centres, metric, id_col, vec_col), centres, k, 26, metric, "qid", "vec")
    return found.select(F.col("id").alias(id_col), "distance").orderBy("distance", id_col)


def search(name: str, table: DataFrame, query: list[float], k: int, metric: str = "cosine", id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    if name not in BACKENDS:
        raise ValueError(f"backend {name!r} is none of {', '.join(sorted(BACKENDS))}")
    return BACKENDS[name](table, query, k, metric, id_col, vec_col)
