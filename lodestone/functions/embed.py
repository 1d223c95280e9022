"""Pluggable embedders: functions from texts to a matrix, called once for each Arrow batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.vectors import distance

Embedder = Callable[[list[str], int], np.ndarray]
EMBEDDERS: dict[str, Embedder] = {}


def embedder(name: str) -> Callable[[Embedder], Embedder]:
    def add(f: Embedder) -> Embedder:
        EMBEDDERS[name] = f
        return f

    return add


@embedder("hash")
def by_bytes(texts: list[str], dims: int) -> np.ndarray:
    """From the sum of a text's bytes, of unit length; the same everywhere, for tests without a model."""
    h = np.array([int(np.frombuffer(t.encode(), np.uint8).sum(dtype=np.uint64)) % 2**32 for t in texts], np.uint64)
    v = ((h[:, None] * np.arange(1, dims + 1, dtype=np.uint64)) % np.uint64(2**32) % np.uint64(1000)).astype(float) / 1000
    size = np.linalg.norm(v, axis=1, keepdims=True)
    return v / np.where(size > 0, size, 1)


@embedder("cluster")
def by_number(texts: list[str], dims: int) -> np.ndarray:
    """Ten clusters by the number a text ends with."""
    ids = np.array([int("".join(c for c in t if c.isdigit()) or 0) for t in texts])
    c, noise = (ids % 10) / 10, (ids * 7919 % 1000) / 1000
    base = np.stack([c, 1 - c, np.full(len(ids), 0.5)], axis=1)[:, np.arange(dims) % 3]
    v = base + 0.1 * noise[:, None]
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def embedded(rows: DataFrame, name: str, dims: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, vec)``; a null text is embedded as an empty one."""
    f = EMBEDDERS[name]

    def embed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            m = np.asarray(f([t or "" for t in part.column("t").to_pylist()], dims), np.float32)
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.ListArray.from_arrays(pa.array(np.arange(0, m.size + 1, dims), pa.int32()), pa.array(m.ravel()))], names=["id", "vec"])

    return rows.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t")).mapInArrow(embed, "id long, vec array<float>")


def recomputed(compacted: DataFrame, texts: DataFrame, name: str, dims: int) -> DataFrame:
    """``(id, vec)`` of a compacted table, its missing vectors embedded again from ``texts (id, text)``; stored ones stay."""
    missing = texts.join(compacted.filter("vec is null").select("id"), "id", "left_semi")
    return compacted.filter("vec is not null").select("id", "vec").unionByName(embedded(missing, name, dims, "id"))


def two_phase(compacted: DataFrame, edges: DataFrame, texts: DataFrame, query: list[float], k: int, name: str, dims: int, effort: int = 100, metric: str = "cosine") -> DataFrame:
    """``(id, distance)`` of the k nearest in a compacted index, with only the candidates' missing vectors embedded again.

    The ``effort`` nearest stored vectors are found by a scan; their neighbours by ``edges (src, dst)`` are the candidates without a vector. Those are
    embedded from ``texts (id, text)``, and both are ranked together.
    """
    q = F.array(*[F.lit(float(x)) for x in query])
    near = compacted.filter("vec is not null").select("id", distance(metric, F.col("vec"), q).alias("distance")).orderBy("distance", "id").limit(max(effort, k))
    missing = edges.join(F.broadcast(near.select(F.col("id").alias("src"))), "src", "left_semi").select(F.col("dst").alias("id")).distinct().join(compacted.filter("vec is null").select("id"), "id", "left_semi")
    again = embedded(texts.join(missing, "id", "left_semi"), name, dims, "id").select("id", distance(metric, F.col("vec"), q).alias("distance"))
    return near.unionByName(again).orderBy("distance", "id").limit(k)


#: The distance of an id that has no vector.
MISSING = 1e9


def distances_by_id(vecs: DataFrame, ids: DataFrame, query: list[float], metric: str = "cosine") -> DataFrame:
    """``(id, distance)`` of all given ids, in one join; ids without a vector are `MISSING` away."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return ids.select("id").join(vecs.select("id", "vec"), "id", "left").select("id", F.coalesce(distance(metric, F.col("vec"), q), F.lit(MISSING)).alias("distance"))


def truncated(texts: DataFrame, limit: int, text_col: str = "text", ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Texts cut to a model's limit: by the tokens of a tokenizer file where one is given, else to limit / 1.2 characters."""
    if ranks_path is None:
        return texts.withColumn(text_col, F.substring(F.col(text_col), 1, int(limit / 1.2)))
    import base64

    import pandas as pd

    @F.pandas_udf("string")
    def cut(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        coder = tiktoken.Encoding("own", pat_str=pattern or r"\s*\S+|\s+", mergeable_ranks=ranks, special_tokens={})
        for part in parts:
            yield part.map(lambda t: t if t is None else coder.decode(coder.encode_ordinary(t)[:limit]))

    return texts.withColumn(text_col, cut(text_col))
