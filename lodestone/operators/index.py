"""A persistent index: documents, vectors and (optionally) a keyword index as Parquet tables under one folder.

Every build or append writes batches of its own, ``documents/batch=n`` and so on, and then one small file ``meta/n.json`` that lists the batches that count. A reader
takes the latest of these, so a job that fails halfway leaves the index as it was; what it wrote is not listed and is overwritten by the next.
"""

from __future__ import annotations

import json
import re
import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone import staging
from lodestone.functions.metadata import predicate
from lodestone.operators import fusion, graph, keyword, knn

VERSION = 2


def _path(spark: SparkSession, where: str):  # noqa: ANN202
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def with_ids(texts: DataFrame, start: int = 0) -> DataFrame:
    """Dense ids from ``start``, without a global sort.

    The rows are written to the shared folder first; a row's id is the number of rows in the files before its own, and its place in that file. So
    they don't depend on how a later job happens to be partitioned. Only the files' names and counts meet in one task.
    """
    rows = staging.written(texts, "numbered")
    placed = rows.select(F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"), *[F.col(f"`{c}`") for c in texts.columns])
    files = placed.groupBy("__file").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = F.broadcast(files.select("__file", before.alias("__before")))
    return placed.join(offsets, "__file").select((F.col("__before") + F.col("__row") + start).alias("id"), *[F.col(f"`{c}`") for c in texts.columns])


@dataclass
class Index:
    """``documents (id, text, metadata)`` and ``vectors (id, vec)``; metadata is JSON text in storage and variant in queries."""

    spark: SparkSession
    folder: str
    name: str = "default"
    metric: str = "cosine"
    dimension: int | None = None
    compacted: bool = False
    hybrid: bool = True
    num_documents: int = 0
    batches: tuple[int, ...] = ()
    options: dict = field(default_factory=dict)

    @classmethod
    def build(cls, spark: SparkSession, folder: str, documents: DataFrame, vectors: DataFrame, name: str = "default", metric: str = "cosine", hybrid: bool = True, hub_percentile: float | None = None, links: int = 32) -> Index:
        """Writes an index; with ``hub_percentile`` only the vectors of documents with many incoming links are stored."""
        dims = knn.dimension_check(vectors.withColumnRenamed("vec", "embedding")).first()
        if not dims.n_rows:
            raise ValueError("an index needs at least one document")
        if dims.least_dim != dims.greatest_dim:
            raise ValueError("vectors differ in dimension")
        p, fs = _path(spark, folder)
        fs.delete(p, True)
        kept = vectors.select(F.col("id").cast("long"), F.col("vec").cast("array<float>"))
        if hub_percentile is not None:
            nodes = kept.select(F.col("id").alias("vec_id"), F.col("vec").alias("embedding"))
            edges = staging.written(graph.prune_neighbours(graph.window_edges(nodes, links, metric), links), "edges")
            incoming = edges.select("layer", F.col("dst").alias("src"), F.col("src").alias("dst"), "distance")
            hubs = graph.hubs(graph.degrees(nodes, incoming), hub_percentile, min(10, links), entry_point=0)
            kept = graph.compact(kept, hubs, "id", "vec")
            edges.write.mode("overwrite").parquet(f"{folder}/edges")
        index = cls(spark, folder, name, metric, int(dims.least_dim), hub_percentile is not None, hybrid)
        index._write(0, documents, kept)
        index._publish(0, int(dims.n_rows))
        return cls.load(spark, folder)

    def _write(self, batch: int, documents: DataFrame, vectors: DataFrame) -> None:
        documents.select(F.col("id").cast("long"), "text", F.col("metadata").cast("string")).write.mode("overwrite").parquet(f"{self.folder}/documents/batch={batch}")
        vectors.select(F.col("id").cast("long"), F.col("vec").cast("array<float>")).write.mode("overwrite").parquet(f"{self.folder}/vectors/batch={batch}")
        if self.hybrid:
            # each file has the postings of some documents, by term: so a query's terms are few row groups of each, and a frequent term is in all files
            with staging.setting(self.spark, "spark.sql.execution.arrow.maxBytesPerBatch", "16m"):
                keyword.segments(documents, "id").write.mode("overwrite").parquet(f"{self.folder}/postings/batch={batch}")
            counted = self.spark.read.schema("tf long").parquet(f"{self.folder}/postings/batch={batch}").agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("num_words"))
            stored = self.spark.read.schema("id long").parquet(f"{self.folder}/documents/batch={batch}").agg(F.count("*").alias("num_docs"))
            words = F.when(F.col("num_docs") > 0, F.col("num_words"))
            stored.crossJoin(counted).select("num_docs", words.alias("num_words"), (words / F.col("num_docs")).alias("avg_words")).write.mode("overwrite").parquet(f"{self.folder}/statistics/batch={batch}")

    def _publish(self, batch: int, num_documents: int) -> None:
        meta = {"version": VERSION, "name": self.name, "metric": self.metric, "dimension": self.dimension, "num_documents": num_documents, "compacted": self.compacted, "hybrid": self.hybrid, "created_at": int(time.time()), "batches": [*self.batches, batch]}
        part, fs = _path(self.spark, f"{self.folder}/meta/.{batch}.part")
        out = fs.create(part, True)
        out.write(bytearray(json.dumps(meta).encode()))
        out.close()
        if not fs.rename(part, _path(self.spark, f"{self.folder}/meta/{batch}.json")[0]):
            raise OSError(f"batch {batch} is there already: another job has changed the index")

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> Index:
        schema = "version int, name string, metric string, dimension int, num_documents long, compacted boolean, hybrid boolean, batches array<int>"
        meta = spark.read.schema(schema).json(f"{folder}/meta").orderBy(F.desc(F.size("batches"))).first()
        if meta is None or meta.version != VERSION:
            raise ValueError(f"{folder} is no index of version {VERSION}")
        return cls(spark, folder, meta.name, meta.metric, meta.dimension, meta.compacted, meta.hybrid, meta.num_documents, tuple(meta.batches))

    def _table(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*[f"{self.folder}/{name}/batch={b}" for b in self.batches])

    def documents(self) -> DataFrame:
        return self._table("documents", "id long, text string, metadata string").withColumn("metadata", F.try_parse_json("metadata"))

    def vectors(self) -> DataFrame:
        return self._table("vectors", "id long, vec array<float>")

    def keywords(self) -> tuple[DataFrame, DataFrame]:
        """Postings and statistics."""
        if not self.hybrid:
            raise ValueError("the index has no keyword index")
        return self._table("postings", "term string, doc_id long, tf long, dl int, positions array<int>"), self._table("statistics", "num_docs long, num_words long, avg_words double")

    def __len__(self) -> int:
        return self.num_documents

    def append(self, documents: DataFrame, vectors: DataFrame) -> int:
        """Adds documents with new ids; refuses compacted indexes, known, repeated or unmatched ids and other dimensions before anything is written. All of it counts, or nothing."""
        if self.compacted:
            raise ValueError("a compacted index can't be appended to")
        ids, vec_ids = (t.select(F.col("id").cast("long").alias("id")) for t in (documents, vectors))
        if not vec_ids.unionByName(ids).join(self.documents(), "id", "left_semi").isEmpty():
            raise ValueError("some ids are in the index already")
        both = ids.withColumn("d", F.lit(1)).withColumn("v", F.lit(0)).unionByName(vec_ids.withColumn("d", F.lit(0)).withColumn("v", F.lit(1))).groupBy("id").agg(F.sum("d").alias("d"), F.sum("v").alias("v"))
        wrong = both.agg(F.bool_or(F.expr("d > 1 or v > 1")).alias("twice"), F.bool_or(F.expr("d <> 1 or v <> 1 or id is null")).alias("unmatched")).first()
        if wrong.twice:
            raise ValueError("some ids come twice")
        if wrong.unmatched:
            raise ValueError("documents and vectors must have the same ids")
        dims = knn.dimension_check(vectors.withColumnRenamed("vec", "embedding")).first()
        if dims.n_rows and (dims.least_dim, dims.greatest_dim) != (self.dimension, self.dimension):
            raise ValueError(f"the vectors must have {self.dimension} dimensions")
        batch = self.batches[-1] + 1
        self._write(batch, documents, vectors)
        self._publish(batch, self.num_documents + dims.n_rows)
        self.batches, self.num_documents = (*self.batches, batch), self.num_documents + dims.n_rows
        return dims.n_rows

    def vector_search(self, query: list[float], k: int = 10, spec: dict | None = None, prefilter: bool = False, mode: str = "coercing") -> DataFrame:
        """``(id, distance, text, metadata)``. The filter applies to the k results, or before the ranking with ``prefilter``."""
        rows = self.vectors().filter("vec is not null")
        docs = self.documents()
        if spec and prefilter:
            rows = rows.join(docs.filter(predicate(F.col("metadata"), spec, mode)).select("id"), "id", "left_semi")
        found = knn.knn(rows, query, k, self.metric, "id", "vec").join(docs, "id", "left").withColumn("text", F.coalesce("text", F.lit("")))
        if spec and not prefilter:
            found = found.filter(predicate(F.col("metadata"), spec, mode))
        return found.orderBy("distance", "id")

    def keyword_search(self, query: str, k: int = 10) -> DataFrame:
        return keyword.bm25(self.documents(), query, k, id_col="id", index=self.keywords()).join(self.documents(), "id").orderBy(F.desc("score"), "id")

    def hybrid_search(self, text: str, query: list[float], k: int = 10, strategy: str = "rrf", **params: float) -> DataFrame:
        """``(id, score, text, metadata)``; each side gives 2k candidates to the fusion."""
        v = knn.knn(self.vectors().filter("vec is not null"), query, 2 * k, self.metric, "id", "vec")
        w = keyword.bm25(self.documents(), text, 2 * k, id_col="id", index=self.keywords())
        return fusion.fuse(strategy, v, w, k, **params).join(self.documents(), "id")

    def remove(self) -> None:
        p, fs = _path(self.spark, self.folder)
        fs.delete(p, True)

    @staticmethod
    def listed(spark: SparkSession, root: str) -> list[tuple[str, int]]:
        """Names and bytes of the indexes below a folder."""
        p, fs = _path(spark, root)
        out = []
        if fs.exists(p):
            for s in fs.listStatus(p):
                meta = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(s.getPath(), "meta")
                if s.isDirectory() and fs.exists(meta):
                    out.append((re.sub(r".*/", "", s.getPath().toString()), fs.getContentSummary(s.getPath()).getLength()))
        return sorted(out)
