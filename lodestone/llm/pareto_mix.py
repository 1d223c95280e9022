"""Operator 8: mixing sources to target weights by Pareto order sampling.

A source of weight w gets a fixed number of documents, n = round(fraction * documents * w / sum of
weights). Each of its documents expects e = n * x / sum(x) copies, with the size measure
x = floor(1000 * sqrt(1 + n_chars)). The whole part of e is certain. The fractions are inclusion odds
for the places left: documents are ranked by random odds over inclusion odds,
u / (1 - u) : f / (1 - f), and the least take the places, so that every source gets its number
exactly. u is read from a digest of the seed and the id and so is the same in every run.

A source's ranking never meets in one task: the ranks are cut into 65,536 buckets, counted, and
only the bucket in which the last place falls is sorted.

Nulls and ties: rows of null source are a source of their own; null or negative sizes count as 0
characters. Rows with one id in one source draw the same u; rows without an id draw it from their
source and size. Ties in rank go by id; rows that agree in both and don't all find a place are numbered in the order of a digest of all their columns
(but maps), so that every source gets its number exactly, whatever repeats.
Sources without a weight have ``default_weight``; of 0 or less, they go. Other columns are
carried along, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scratch

FRACTION, SEED, BUCKETS = 0.75, 17, 65_536
#: Target weights by source; the others weigh DEFAULT_WEIGHT.
WEIGHTS = {"src0": 3.0, "src1": 4.0, "src2": 0.5, "src3": 0.5, "src4": 2.0}
DEFAULT_WEIGHT = 1.0


def _weight(source: Column, weights: dict[str, float], default: float) -> Column:
    out = F.lit(float(default))
    for name, w in weights.items():
        out = F.when(source.eqNullSafe(F.lit(name)), F.lit(float(w))).otherwise(out)
    return out


def allotted(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", size_col: str = "n_chars", weights: dict[str, float] | None = None, default_weight: float = DEFAULT_WEIGHT, fraction: float = FRACTION, seed: int = SEED) -> DataFrame:
    """``(__mix_row, __mix_copies)``: the documents that are taken, each as one column, and how often."""
    weights = WEIGHTS if weights is None else weights
    src, size = F.col(f"`{source_col}`").cast("string"), F.greatest(F.coalesce(F.col(f"`{size_col}`").cast("long"), F.lit(0)), F.lit(0))
    key = F.coalesce(F.col(f"`{id_col}`").cast("string"), F.concat(F.lit("null:"), F.coalesce(src, F.lit("")), F.lit(":"), size.cast("string")))
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key)), 1, 12), 16, 10).cast("long")
    # the row goes along as one column, so that no name of it can meet the names below
    named = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__mix_row"), F.coalesce(F.concat(F.lit("s"), src), F.lit("null")).alias("__mix_src"), src.alias("__mix_name"),
        F.floor(1000 * F.sqrt(1.0 + size)).alias("__mix_x"), key.alias("__mix_key"), ((draw + 0.5) / F.lit(float(2**48))).alias("__mix_u"),
    )
    sums = named.groupBy("__mix_src").agg(F.sum("__mix_x").alias("__mix_sx"), F.count("*").alias("__mix_n"), F.first(_weight(F.col("__mix_name"), weights, default_weight)).alias("__mix_w"))
    sums = scratch.written(sums.filter("__mix_w > 0"), "sources")
    whole = Window.partitionBy(F.lit(0))
    total = docs.agg(F.count("*").alias("__mix_all"))
    plan = sums.crossJoin(F.broadcast(total)).withColumn("__mix_quota", F.floor(F.lit(float(fraction)) * F.col("__mix_all") * F.col("__mix_w") / F.sum("__mix_w").over(whole) + 0.5))
    plan = scratch.written(plan.select("__mix_src", "__mix_sx", "__mix_quota"), "quotas")
    expected = named.join(plan, "__mix_src").withColumn("__mix_e", F.col("__mix_quota") * F.col("__mix_x") / F.col("__mix_sx"))
    expected = expected.withColumn("__mix_sure", F.floor("__mix_e")).withColumn("__mix_f", F.col("__mix_e") - F.col("__mix_sure"))
    odds = F.col("__mix_u") * (1 - F.col("__mix_f")) / ((1 - F.col("__mix_u")) * F.col("__mix_f"))
    ranked = expected.withColumn("__mix_q", F.when(F.col("__mix_f") > 0, odds)).withColumn("__mix_b", F.floor(F.col("__mix_q") / (1 + F.col("__mix_q")) * BUCKETS))
    counts = ranked.groupBy("__mix_src", "__mix_b").agg(F.count("*").alias("__mix_c"), F.sum("__mix_sure").alias("__mix_s"), F.first("__mix_quota").alias("__mix_quota"))
    own = Window.partitionBy("__mix_src")
    left = counts.withColumn("__mix_k", F.col("__mix_quota") - F.sum("__mix_s").over(own)).filter("__mix_b is not null")
    left = left.withColumn("__mix_before", F.coalesce(F.sum("__mix_c").over(own.orderBy("__mix_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    cut = left.filter("__mix_before < __mix_k").groupBy("__mix_src").agg(F.max("__mix_b").alias("__mix_cut"), F.max_by(F.col("__mix_k") - F.col("__mix_before"), "__mix_b").alias("__mix_need"))
    cut = scratch.written(cut, "cuts")
    last = ranked.join(cut.withColumnRenamed("__mix_cut", "__mix_b"), ["__mix_src", "__mix_b"]).select("__mix_src", "__mix_b", "__mix_need", "__mix_q", "__mix_key")
    place = F.row_number().over(own.orderBy("__mix_q", "__mix_key"))
    ends = last.withColumn("__mix_at", place).groupBy("__mix_src", "__mix_b", "__mix_q", "__mix_key").agg(F.min("__mix_at").alias("__mix_from"), F.max("__mix_at").alias("__mix_to"), F.first("__mix_need").alias("__mix_need"))
    ends = ends.filter("__mix_from <= __mix_need and (__mix_to >= __mix_need)").select("__mix_src", F.col("__mix_b").alias("__mix_cut"), F.struct("__mix_q", "__mix_key").alias("__mix_end"), (F.col("__mix_need") - F.col("__mix_from") + 1).alias("__mix_most"), (F.col("__mix_to") > F.col("__mix_need")).alias("__mix_tied"))
    ends = scratch.written(ends.unionByName(_all_taken(cut, ends)), "ends")
    at = F.struct("__mix_q", "__mix_key")
    joined = ranked.join(F.broadcast(ends), "__mix_src", "left")
    before = (F.col("__mix_b") < F.col("__mix_cut")) | ((F.col("__mix_b") == F.col("__mix_cut")) & (F.col("__mix_end").isNull() | (at < F.col("__mix_end")) | ((at == F.col("__mix_end")) & ~F.col("__mix_tied"))))
    done = joined.withColumn("__mix_copies", F.col("__mix_sure") + F.when(F.coalesce(before, F.lit(False)), 1).otherwise(0))
    if not ends.filter("__mix_tied").isEmpty():
        tied = F.coalesce(F.col("__mix_tied") & (F.col("__mix_b") == F.col("__mix_cut")) & (at == F.col("__mix_end")), F.lit(False))
        digest = F.xxhash64(*[F.col(f"__mix_row.`{c}`") for c, k in docs.dtypes if not k.startswith(("map", "variant"))])
        numbered = done.filter(tied).withColumn("__mix_at", F.row_number().over(own.orderBy(digest)))
        numbered = numbered.withColumn("__mix_copies", F.col("__mix_copies") + F.when(F.col("__mix_at") <= F.col("__mix_most"), 1).otherwise(0)).drop("__mix_at")
        done = done.filter(~tied).unionByName(numbered)
    return done.filter("__mix_copies > 0").select("__mix_row", "__mix_copies")


def _all_taken(cut: DataFrame, ends: DataFrame) -> DataFrame:
    """The sources of which all that reach the last bucket are taken."""
    left = cut.join(ends.select("__mix_src"), "__mix_src", "left_anti")
    return left.select("__mix_src", "__mix_cut", F.lit(None).cast("struct<__mix_q:double,__mix_key:string>").alias("__mix_end"), F.lit(0).cast("long").alias("__mix_most"), F.lit(False).alias("__mix_tied"))


def sample(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", size_col: str = "n_chars", **params: object) -> DataFrame:
    """``(doc_id, source, copies)`` of all documents taken."""
    own = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{source_col}`").alias("source"), F.col(f"`{size_col}`").alias("n_chars"))
    return allotted(own, **params).select("__mix_row.doc_id", "__mix_row.source", F.col("__mix_copies").cast("long").alias("copies"))


def mixed(docs: DataFrame, **params: object) -> DataFrame:
    """The mixture: each document as often as it is taken, with all its columns."""
    return allotted(docs, **params).select("__mix_row", F.explode(F.sequence(F.lit(1), F.col("__mix_copies").cast("int")))).select("__mix_row.*")
