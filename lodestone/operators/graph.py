"""Neighbour graphs as edge tables ``(layer, src, dst, distance)``, degrees, hubs and compaction."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone import staging
from lodestone.functions import vectors


def window_edges(table: DataFrame, m: int, metric: str = "cosine", id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Links each node to the m before it by id, both ways; an equi-join on id ranges of length m, never a cross product."""
    a = table.select(F.col(id_col).alias("a"), F.col(vec_col).alias("va")).withColumn("g", F.floor(F.col("a") / m))
    b = table.select(F.col(id_col).alias("b"), F.col(vec_col).alias("vb")).withColumn("g", F.explode(F.array(F.floor(F.col("b") / m), F.floor(F.col("b") / m) + 1)))
    near = a.join(b, "g").filter((F.col("b") >= F.col("a") - m) & (F.col("b") < F.col("a"))).select("a", "b", vectors.distance(metric, F.col("va"), F.col("vb")).alias("distance"))
    ways = F.explode(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst"))))
    return near.select(F.lit(0).alias("layer"), ways.alias("e"), "distance").select("layer", "e.src", "e.dst", "distance")


def random_levels(table: DataFrame, m: int = 16, seed: int = 0, id_col: str = "vec_id") -> DataFrame:
    """``(id, level)`` with the layers of a hierarchical graph, drawn from the id and a seed."""
    u = (F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.lit(2**31)) + 1) / float(2**31)
    return table.select(F.col(id_col).alias("id"), F.floor(-F.log(u) / F.log(F.lit(float(m)))).cast("int").alias("level"))


def prune_neighbours(edges: DataFrame, m: int) -> DataFrame:
    """Each node's m nearest on each layer."""
    place = F.row_number().over(Window.partitionBy("layer", "src").orderBy("distance", "dst"))
    return edges.withColumn("__place", place).filter(F.col("__place") <= m).drop("__place")


def degrees(nodes: DataFrame, edges: DataFrame, id_col: str = "vec_id") -> DataFrame:
    """``(id, degree)``: outgoing edges over all layers, 0 for nodes without any."""
    counts = edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))
    return nodes.select(F.col(id_col).alias("id")).join(counts, "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))


def threshold(degree: DataFrame, percentile: float = 0.95, least: int = 10) -> DataFrame:
    """One row ``threshold``: the degree at the percentile, counted from the top, and no less than ``least``.

    Found from the counts of each degree, so that no sort of the nodes is needed.
    """
    by = degree.groupBy("degree").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy(F.desc("degree")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))
    place = F.least(F.floor(F.lit(round(1 - percentile, 12)) * total), total - 1)
    return by.select("degree", before.alias("b"), place.alias("p"), "n").filter("b <= p and p < b + n").select(F.greatest(F.col("degree"), F.lit(least)).alias("threshold"))


def hubs(degree: DataFrame, percentile: float = 0.95, least: int = 10, entry_point: int | None = None) -> DataFrame:
    """``(id, degree)`` of the nodes at or above the threshold, and of the entry point."""
    degree = staging.written(degree, "degrees")
    keep = F.col("degree") >= F.col("threshold")
    if entry_point is not None:
        keep = keep | (F.col("id") == entry_point)
    return degree.crossJoin(F.broadcast(threshold(degree, percentile, least))).filter(keep).select("id", "degree")


def prune_stats(degree: DataFrame, dim: int, percentile: float = 0.95, least: int = 10) -> DataFrame:
    """One row: nodes, kept, pruned, bytes before and after, savings and retention."""
    degree = staging.written(degree, "degrees")
    kept = hubs(degree, percentile, least).agg(F.count("*").alias("kept"))
    both = degree.agg(F.count("*").alias("nodes")).crossJoin(kept)
    size = lambda n: vectors.embedding_bytes(F.col(n), F.lit(dim))
    return both.select("nodes", "kept", (F.col("nodes") - F.col("kept")).alias("pruned"), size("nodes").alias("bytes_before"), size("kept").alias("bytes_after"), (1 - F.col("kept") / F.col("nodes")).alias("savings"), (F.col("kept") / F.col("nodes")).alias("retention"))


def csr(edges: DataFrame) -> DataFrame:
    """``(src, degree, dsts, distances)``: each node's edges as arrays, in order of target."""
    rows = edges.groupBy("src").agg(F.array_sort(F.collect_list(F.struct("dst", "distance"))).alias("e"))
    return rows.select("src", F.size("e").alias("degree"), F.col("e.dst").alias("dsts"), F.col("e.distance").alias("distances"))


def compact(table: DataFrame, hub_ids: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The table with the vectors of all but the hubs set to null."""
    marks = hub_ids.select(F.col("id").alias("__hub"))
    joined = table.join(marks, table[id_col] == marks["__hub"], "left")
    return joined.withColumn(vec_col, F.when(F.col("__hub").isNotNull(), F.col(vec_col))).drop("__hub")


def restore(compacted: DataFrame, vectors_again: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The compacted table with its missing vectors from another."""
    again = vectors_again.select(F.col(id_col), F.col(vec_col).alias("__again"))
    return compacted.join(again, id_col, "left").withColumn(vec_col, F.coalesce(F.col(vec_col), F.col("__again"))).drop("__again")
