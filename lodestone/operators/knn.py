"""Exact nearest neighbours: one query as a scan, many as products of packed blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import vectors

#: Vectors in one packed block.
BLOCK = 1024
#: Blocks in a part of the table, and the most parts that it is cut into for a search of many vectors; beyond, parts grow.
PART_BLOCKS, PARTS = 16, 48


def knn(table: DataFrame, query: list[float] | DataFrame, k: int, metric: str = "cosine", id_col: str = "vec_id", vec_col: str = "embedding", condition: Column | None = None) -> DataFrame:
    """The k nearest rows to one vector: ``(id, distance)``, nearest first, ties by id.

    The query is a list or a one-row table with a column ``q``. A ``condition`` restricts the rows before the ranking.
    """
    rows = table if condition is None else table.filter(condition)
    if isinstance(query, DataFrame):
        rows, q = rows.crossJoin(F.broadcast(query.select(F.col("q").alias("__q")))), F.col("__q")
    else:
        q = F.array(*[F.lit(float(x)) for x in query])
    scored = rows.select(F.col(id_col), vectors.distance(metric, F.col(vec_col), q).alias("distance"))
    return scored.orderBy("distance", id_col).limit(k)


_BLOCK = "block long, ids binary, vecs binary"


def blocks(table: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """The vectors packed into rows of up to BLOCK each. Null vectors are left out."""

    def pack(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for at in range(0, part.num_rows, BLOCK):
                some = part.slice(at, BLOCK)
                ids = some.column("i").to_numpy(zero_copy_only=False).astype(np.int64)
                vecs = some.column("v")
                flat = vecs.flatten().to_numpy(zero_copy_only=False).astype(np.float32)
                if len(flat) % len(ids):
                    raise ValueError("vectors differ in dimension")
                yield pa.RecordBatch.from_arrays([pa.array([int(ids[0])]), pa.array([ids.tobytes()], pa.binary()), pa.array([flat.tobytes()], pa.binary())], names=["block", "ids", "vecs"])

    return table.select(F.col(id_col).cast("long").alias("i"), F.col(vec_col).cast("array<float>").alias("v")).filter("i is not null and size(v) > 0").mapInArrow(pack, _BLOCK)


def _best(rows: np.ndarray, ids: np.ndarray, dist: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The k nearest of each row, ties by id, in order, and their places from 0."""
    order = np.lexsort((ids, dist, rows))
    rows, ids, dist = rows[order], ids[order], dist[order]
    place = np.arange(len(rows)) - np.searchsorted(rows, rows)
    keep = place < k
    return rows[keep], ids[keep], dist[keep], place[keep]


def knn_batch(queries: DataFrame, table: DataFrame, k: int, metric: str = "cosine", query_id: str = "vec_id", query_vec: str = "embedding", id_col: str = "vec_id", vec_col: str = "embedding", exclude_self: bool = False) -> DataFrame:
    """``(qid, rank, id, distance)``: the k nearest rows of every query; distances are rounded to 9 places, ties go by id.

    Both sides are packed into blocks, once, and dealt out anew. A task meets the blocks of one part of the table with about one block of queries; each pair of blocks is one
    matrix product, and of each query the task keeps the k nearest so far. A window over the tasks' rows takes the k nearest of all. There are at most PARTS parts of the table, so the
    rows that are shuffled grow with the number of queries only; work grows with the product, a task's memory not at all.
    """
    sides = []
    for rows, key, vec, size, most in ((queries, query_id, query_vec, 1, None), (table, id_col, vec_col, PART_BLOCKS, PARTS)):
        n = max(1, -(-rows.count() // (BLOCK * size)))
        sides.append(blocks(rows, key, vec).repartition(n if most is None else min(n, most)))
    # the exchanges keep the packing in stages of its own: in the product's, each task would pack its parts again, in two more workers
    pairs = sides[0].toDF("qblock", "qids", "qvecs").crossJoin(sides[1].hint("shuffle_replicate_nl"))

    def nearest(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, found, edge = None, None, None

        def out() -> Iterator[pa.RecordBatch]:
            if asked is not None:
                rows, ids, dist, _ = found
                yield pa.RecordBatch.from_arrays([pa.array(asked[0][rows]), pa.array(ids), pa.array(dist)], names=["qid", "id", "distance"])

        for part in parts:
            qids, qvecs, ids, vecs = (part.column(c) for c in ("qids", "qvecs", "ids", "vecs"))
            for at in range(part.num_rows):
                # views, no copies, of the batch
                qi, a, ti, b = np.frombuffer(qids[at].as_buffer(), np.int64), np.frombuffer(qvecs[at].as_buffer(), np.float32), np.frombuffer(ids[at].as_buffer(), np.int64), np.frombuffer(vecs[at].as_buffer(), np.float32)
                if asked is None or not (np.array_equal(asked[0], qi) and asked[1].tobytes() == a.tobytes()):
                    yield from out()
                    asked, edge = (qi.copy(), a.copy()), np.full(len(qi), np.inf)
                    found = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), None
                a, b = a.reshape(len(qi), -1).astype(np.float64), b.reshape(len(ti), -1).astype(np.float64)
                if a.shape[1] != b.shape[1]:
                    raise ValueError("vectors differ in dimension")
                d = vectors.block_distances(metric, a, b)
                np.floor(d * 1e9 + 0.5, out=d)
                d /= 1e9
                if exclude_self:
                    d[qi[:, None] == ti[None]] = np.inf
                most = edge
                if k < len(ti) and np.isinf(edge).any():
                    most = np.minimum(edge, np.partition(d, k - 1, axis=1)[:, k - 1])
                r, c = np.nonzero(d <= most[:, None])
                ok = np.isfinite(d[r, c])
                r, c = r[ok], c[ok]
                if len(r):
                    found = _best(np.concatenate([found[0], r]), np.concatenate([found[1], ti[c]]), np.concatenate([found[2], d[r, c]]), k)
                    last = found[3] == k - 1
                    edge[found[0][last]] = found[2][last]
        yield from out()

    local = pairs.mapInArrow(nearest, "qid long, id long, distance double")
    rank = F.row_number().over(Window.partitionBy("qid").orderBy("distance", "id"))
    return local.withColumn("rank", rank).filter(F.col("rank") <= k).select("qid", "rank", "id", "distance")


def codes(table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``(id, code, scale)``: every dimension in one byte, as a share of the vector's greatest absolute value. Stored, they are a quarter of the vectors."""
    rows = table.select(F.col(id_col), F.col(vec_col).alias("v"), F.array_max(F.transform(vec_col, lambda x: F.abs(x.cast("double")))).alias("scale"))
    return rows.select(id_col, F.transform("v", lambda x: F.round(F.when(F.col("scale") > 0, x / F.col("scale")).otherwise(0.0) * 127).cast("byte")).alias("code"), (F.col("scale") / 127).alias("scale"))


def two_stage(table: DataFrame, query: list[float], k: int, ef: int, metric: str = "cosine", id_col: str = "vec_id", vec_col: str = "embedding", coded: DataFrame | None = None) -> DataFrame:
    """A coarse distance over the codes of all rows and all dimensions takes ``ef`` candidates, which are ranked again exactly. ``coded`` is a stored table of `codes`."""
    q = [float(x) for x in query]
    rows = codes(table, id_col, vec_col) if coded is None else coded
    decoded = F.transform("code", lambda x: x * F.col("scale"))
    near = rows.withColumn("__coarse", vectors.distance(metric, decoded, F.array(*[F.lit(x) for x in q]))).orderBy("__coarse", id_col).limit(max(ef, k)).select(id_col)
    return knn(table.join(F.broadcast(near), id_col, "left_semi"), q, k, metric, id_col, vec_col)


def dimension_check(table: DataFrame, vec_col: str = "embedding") -> DataFrame:
    """``(rows, least_dim, greatest_dim)``; a table is sound if the dimensions agree."""
    return table.agg(F.count("*").alias("n_rows"), F.min(F.size(vec_col)).alias("least_dim"), F.max(F.size(vec_col)).alias("greatest_dim"))


def merge_fresh(base: DataFrame, fresh: DataFrame, k: int) -> DataFrame:
    """The k best of results found before and scores computed since, each ``(id, distance)``; of one id the nearer counts."""
    return base.unionByName(fresh).groupBy("id").agg(F.min("distance").alias("distance")).orderBy("distance", "id").limit(k)
