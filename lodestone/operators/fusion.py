"""Fusion of a vector and a keyword ranking: reciprocal rank, weighted, cascade.

Vector results are ``(id, distance)``, keyword results ``(id, score)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Results of each side that a fusion looks at. Their ranks are counted in one task, after a distributed top-k.
DEPTH = 10_000


def _ranked(df: DataFrame, order: Column, depth: int = DEPTH) -> DataFrame:
    return df.orderBy(order, "id").limit(depth).withColumn("rank", F.row_number().over(Window.orderBy(order, "id")))


def minmax(df: DataFrame, col: str, by: str | None = None) -> DataFrame:
    """Adds ``norm``: the column from 0 to 1, within groups if given; 1 where all are equal. Without groups the least and greatest are one row of sums."""
    if by:
        w = Window.partitionBy(by)
        rows, low, high = df, F.min(col).over(w), F.max(col).over(w)
    else:
        rows, low, high = df.crossJoin(F.broadcast(df.agg(F.min(col).alias("__low"), F.max(col).alias("__high")))), F.col("__low"), F.col("__high")
    return rows.withColumn("norm", F.when(high == low, F.lit(1.0)).otherwise((F.col(col) - low) / (high - low))).drop("__low", "__high")


def _scaled(df: DataFrame, col: str, order: Column, depth: int = DEPTH) -> DataFrame:
    """`minmax` over the best of a ranking, which are few enough for one window."""
    top, w = df.orderBy(order, "id").limit(depth), Window.partitionBy(F.lit(0))
    low, high = F.min(col).over(w), F.max(col).over(w)
    return top.withColumn("norm", F.when(high == low, F.lit(1.0)).otherwise((F.col(col) - low) / (high - low)))


def rrf(vector: DataFrame, keyword: DataFrame | None, k: int, constant: int = 60) -> DataFrame:
    """``(id, score)``: the sum over the rankings of 1 / (constant + rank)."""
    sides = [_ranked(vector, F.col("distance")).select("id", "rank")]
    if keyword is not None:
        sides.append(_ranked(keyword, F.desc("score")).select("id", "rank"))
    both = sides[0] if len(sides) == 1 else sides[0].unionByName(sides[1])
    return both.groupBy("id").agg(F.sum(1 / (F.lit(float(constant)) + F.col("rank"))).alias("score")).orderBy(F.desc("score"), "id").limit(k)


def weighted(vector: DataFrame, keyword: DataFrame, k: int, alpha: float = 0.5, raw_distance: bool = False) -> DataFrame:
    """``(id, score)``: alpha times the keyword's plus 1 - alpha times the vector's score, each from 0 to 1; an absent side gives 0.

    Distances count turned round, so that near is high; ``raw_distance`` adds them as they are.
    """
    v = _scaled(vector, "distance", F.col("distance"))
    v = v.select("id", ((1 - alpha) * (F.col("norm") if raw_distance else 1 - F.col("norm"))).alias("part"))
    w = _scaled(keyword, "score", F.desc("score")).select("id", (alpha * F.col("norm")).alias("part"))
    return v.unionByName(w).groupBy("id").agg(F.sum("part").alias("score")).orderBy(F.desc("score"), "id").limit(k)


def cascade(vector: DataFrame, keyword: DataFrame, k: int, threshold: int = 5) -> DataFrame:
    """``(id, score, side)``: the keyword results if there are at least so many, else the vector's; one plan."""
    # each side becomes one row of at most k results, so that neither is computed twice
    a = keyword.orderBy(F.desc("score"), "id").limit(k).agg(F.collect_list(F.struct("id", "score", F.lit("keyword").alias("side"))).alias("a"))
    b = vector.orderBy("distance", "id").limit(k).agg(F.collect_list(F.struct("id", F.col("distance").alias("score"), F.lit("vector").alias("side"))).alias("b"))
    return a.crossJoin(b).select(F.inline(F.when(F.size("a") >= threshold, F.col("a")).otherwise(F.col("b"))))


def merged(vector: DataFrame, keyword: DataFrame) -> DataFrame:
    """``(id, distance, score)`` of both lists, null where one lacks the id."""
    return vector.join(keyword, "id", "full_outer").select("id", "distance", "score")


def fuse(strategy: str, vector: DataFrame, keyword: DataFrame, k: int, **params: float) -> DataFrame:
    """By name; an unknown one is reciprocal rank fusion with 60."""
    known = {"weighted": weighted, "cascade": cascade, "rrf": rrf}
    if strategy == "vector":
        return vector.orderBy("distance", "id").limit(k)
    if strategy == "keyword":
        return keyword.orderBy(F.desc("score"), "id").limit(k)
    return known.get(strategy, rrf)(vector, keyword, k, **(params if strategy in known else {}))


def with_threshold(df: DataFrame, most: float, higher_is_better: bool = False) -> DataFrame:
    """Results within a threshold, whichever way the score runs."""
    col = "score" if "score" in df.columns else "distance"
    return df.filter(F.col(col) >= most if higher_is_better else F.col(col) <= most)
