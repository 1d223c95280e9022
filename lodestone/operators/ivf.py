"""Approximate nearest neighbours by inverted lists: every row belongs to a cell, and a query looks into its nearest cells only.

The cells' centres are fitted on a bounded sample of rows; every row is assigned to a cell. Rows and queries meet by an equi-join on the cell, in packed blocks; a cell
of many blocks is cut into slots, so that no task holds a large one whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import vectors

#: Rows that the centres are fitted on, at most; the bound does not grow with the table.
SAMPLE = 20_000
BLOCK, SLOT_BLOCKS, ROUNDS = 1024, 64, 12


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _unit(m: np.ndarray, metric: str) -> np.ndarray:
    if metric != "cosine":
        return m
    size = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(size > 0, size, 1)


def fit(table: DataFrame, cells: int, metric: str = "cosine", id_col: str = "vec_id", vec_col: str = "embedding", sample: int = SAMPLE, seed: int = 0) -> np.ndarray:
    """The centres of so many cells (fewer if there are fewer rows), by k-means over the rows with the least hashes of their ids."""
    rows = table.filter(F.col(vec_col).isNotNull()).select(F.col(vec_col).cast("array<double>").alias("v"), F.xxhash64(F.col(id_col), F.lit(seed)).alias("h")).orderBy("h").limit(sample)
    m = _unit(_matrix(rows.select("v").toArrow().column("v").combine_chunks()), metric) if not rows.isEmpty() else np.zeros((0, 1))
    centres = m[: min(cells, len(m))].copy()
    for _ in range(ROUNDS if len(centres) else 0):
        near = (vectors.block_distances("euclidean", m, centres)).argmin(axis=1)
        sums, many = np.zeros_like(centres), np.bincount(near, minlength=len(centres))
        np.add.at(sums, near, m)
        centres[many > 0] = sums[many > 0] / many[many > 0, None]
    return centres


_LISTS = "cell int, block int, ids binary, vecs binary"


def assign(table: DataFrame, centres: np.ndarray, metric: str = "cosine", id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``(cell, block, ids, vecs)``: every row with a vector, packed by cell. This is the index; write it to use it again."""

    def packed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(len(centres), np.int64)
        for part in parts:
            for at in range(0, part.num_rows, 16 * BLOCK):
                some = part.slice(at, 16 * BLOCK)
                ids, m = some.column("i").to_numpy(zero_copy_only=False).astype(np.int64), _matrix(some.column("v"))
                near = vectors.block_distances("euclidean", _unit(m, metric), centres).argmin(axis=1)
                order = np.argsort(near, kind="stable")
                cells, first = np.unique(near[order], return_index=True)
                out = []
                for c, own in zip(cells, np.split(order, first[1:])):
                    for x in range(0, len(own), BLOCK):
                        mine = own[x : x + BLOCK]
                        out.append((int(c), int(seen[c]), ids[mine].tobytes(), m[mine].astype(np.float32).tobytes()))
                        seen[c] += 1
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.binary(), pa.binary()))], names=["cell", "block", "ids", "vecs"])

    return table.select(F.col(id_col).cast("long").alias("i"), F.col(vec_col).cast("array<float>").alias("v")).filter("i is not null and size(v) > 0").mapInArrow(packed, _LISTS)


def search(queries: DataFrame, lists: DataFrame, centres: np.ndarray, k: int, probes: int, metric: str = "cosine", query_id: str = "vec_id", query_vec: str = "embedding", exclude_self: bool = False) -> DataFrame:
    """``(qid, rank, id, distance)``: the k nearest of the rows in each query's ``probes`` nearest cells."""

    def routed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for at in range(0, part.num_rows, BLOCK):
                some = part.slice(at, BLOCK)
                ids, m = some.column("i").to_numpy(zero_copy_only=False).astype(np.int64), _matrix(some.column("v"))
                n = min(probes, len(centres))
                near = np.argsort(vectors.block_distances("euclidean", _unit(m, metric), centres), axis=1, kind="stable")[:, :n]
                out = []
                for c in np.unique(near):
                    mine = np.flatnonzero((near == c).any(axis=1))
                    out.append((int(c), ids[mine].tobytes(), m[mine].astype(np.float32).tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array([r[x] for r in out], t) for x, t in enumerate((pa.int32(), pa.binary(), pa.binary()))], names=["cell", "qids", "qvecs"])

    def nearest(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for qi, qv, ti, tv in zip(*(part.column(c).to_pylist() for c in ("qids", "qvecs", "ids", "vecs"))):
                qi, ti = np.frombuffer(qi, np.int64), np.frombuffer(ti, np.int64)
                d = vectors.block_distances(metric, np.frombuffer(qv, np.float32).reshape(len(qi), -1).astype(np.float64), np.frombuffer(tv, np.float32).reshape(len(ti), -1).astype(np.float64)).round(9)
                if exclude_self:
                    d[qi[:, None] == ti[None]] = np.inf
                edge = np.partition(d, min(k, len(ti)) - 1, axis=1)[:, min(k, len(ti)) - 1 : min(k, len(ti))]
                r, c = np.nonzero((d <= edge) & np.isfinite(d))  # ties at the edge go on to the window
                yield pa.RecordBatch.from_arrays([pa.array(qi[r]), pa.array(ti[c]), pa.array(d[r, c])], names=["qid", "id", "distance"])

    asked = queries.select(F.col(query_id).cast("long").alias("i"), F.col(query_vec).cast("array<float>").alias("v")).filter("i is not null and size(v) > 0").mapInArrow(routed, "cell int, qids binary, qvecs binary")
    slots = lists.groupBy("cell").agg(F.ceil(F.count("*") / SLOT_BLOCKS).cast("int").alias("slots"))  # one row for each cell
    rows = lists.join(F.broadcast(slots), "cell").withColumn("slot", F.pmod(F.xxhash64("ids"), F.col("slots")).cast("int"))
    asked = asked.join(F.broadcast(slots), "cell").withColumn("slot", F.explode(F.sequence(F.lit(0), F.col("slots") - 1)))
    local = asked.select("cell", "slot", "qids", "qvecs").join(rows.select("cell", "slot", "ids", "vecs"), ["cell", "slot"]).mapInArrow(nearest, "qid long, id long, distance double")
    rank = F.row_number().over(Window.partitionBy("qid").orderBy("distance", "id"))
    return local.withColumn("rank", rank).filter(F.col("rank") <= k).select("qid", "rank", "id", "distance")
