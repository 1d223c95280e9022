"""Late interaction: documents and queries as sets of token vectors ``(doc_id, seq_id, vec)``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.vectors import dot


def maxsim(query: DataFrame, tokens: DataFrame, k: int | None = None) -> DataFrame:
    """``(doc_id, score)``: over the query's tokens, the sum of their best inner product with a token of the document."""
    q = query.select(F.col("seq_id").alias("q_seq"), F.col("vec").alias("q_vec"))
    pairs = tokens.crossJoin(F.broadcast(q)).select("doc_id", "q_seq", F.nanvl(dot(F.col("q_vec"), F.col("vec")), F.lit(-1e30)).alias("sim"))
    best = pairs.groupBy("doc_id", "q_seq").agg(F.max("sim").alias("best"))
    out = best.groupBy("doc_id").agg(F.sum("best").alias("score"))
    return out.orderBy(F.desc("score"), "doc_id").limit(k) if k else out


def approximate(query: DataFrame, tokens: DataFrame, first_stage: int, k: int | None = None) -> DataFrame:
    """As `maxsim`, from the ``first_stage`` best tokens of each query token alone."""
    q = query.select(F.col("seq_id").alias("q_seq"), F.col("vec").alias("q_vec"))
    pairs = tokens.crossJoin(F.broadcast(q)).select("doc_id", "seq_id", "q_seq", dot(F.col("q_vec"), F.col("vec")).alias("sim"))
    place = F.row_number().over(Window.partitionBy("q_seq").orderBy(F.desc(F.round("sim", 9)), "doc_id", "seq_id"))
    hits = pairs.withColumn("place", place).filter(F.col("place") <= first_stage)
    out = hits.groupBy("doc_id", "q_seq").agg(F.max("sim").alias("best")).groupBy("doc_id").agg(F.sum("best").alias("score"))
    return out.orderBy(F.desc("score"), "doc_id").limit(k) if k else out


def reranked(query: DataFrame, tokens: DataFrame, first_stage: int, k: int | None = None) -> DataFrame:
    """The first stage picks documents, which are scored exactly over all their tokens."""
    chosen = approximate(query, tokens, first_stage).select("doc_id")
    return maxsim(query, tokens.join(chosen, "doc_id", "left_semi"), k)
