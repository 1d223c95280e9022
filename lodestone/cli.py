"""Command line: ``python -m lodestone.cli build|search|ask|evaluate|list|remove``."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone import staging
from lodestone.functions import embed
from lodestone.operators import chunking, evaluate, fusion, knn, rag
from lodestone.operators.index import Index, with_ids
from lodestone.session import session
from lodestone.sources import readers

DIMS = 64


def build(spark: SparkSession, root: str, name: str, folder: str, embedder: str = "hash", size: int = chunking.SIZE, overlap: int = chunking.OVERLAP, code: bool = False, hubs: float | None = None) -> Index:
    """Reads a folder, cuts its texts into chunks, embeds and indexes them."""
    files = readers.read_folder(spark, folder, code=code)
    numbered = with_ids(files)
    chunks = chunking.text_chunks(numbered, size, overlap, "id").join(numbered.select("id", "path"), "id")
    meta = F.to_json(F.struct("path", "chunk_index", "token_count"))
    documents = with_ids(chunks.select("text", meta.alias("metadata"))).persist()
    index = Index.build(spark, f"{root}/{name}", documents, embed.embedded(documents, embedder, DIMS, "id"), name, hub_percentile=hubs)
    documents.unpersist()
    return index


def search(index: Index, text: str, k: int = 10, strategy: str = "rrf", embedder: str = "hash", most: float | None = None, spec: dict | None = None) -> DataFrame:
    """By ``vector``, ``keyword`` or a fusion of both."""
    q = [float(x) for x in embed.EMBEDDERS[embedder]([text], index.dimension)[0]]
    if strategy == "vector":
        found = index.vector_search(q, k, spec)
    elif strategy == "keyword":
        found = index.keyword_search(text, k)
    else:
        found = index.hybrid_search(text, q, k, strategy)
    return found if most is None else fusion.with_threshold(found, most, "score" in found.columns)


def evaluated(index: Index, dataset: str, embedder: str = "hash", ks: tuple[int, ...] = evaluate.KS) -> DataFrame:
    """Means of precision, recall and F1 over a data set of judged queries, all queries in one job."""
    return evaluate.aggregate(*_judged(index, dataset, embedder, max(ks)), ks)


def _judged(index: Index, dataset: str, embedder: str, k: int) -> tuple[DataFrame, DataFrame]:
    queries, qrels = readers.evaluation_set(index.spark, dataset)
    vecs = embed.embedded(queries, embedder, index.dimension, "qid", "query").withColumnRenamed("id", "qid")
    results = knn.knn_batch(vecs, index.vectors(), k, index.metric, "qid", "vec", "id", "vec")
    return staging.written(results, "results"), qrels.withColumn("id", F.col("id").cast("long"))


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="lodestone")
    p.add_argument("--root", default="indexes")
    sub = p.add_subparsers(dest="verb", required=True)
    b = sub.add_parser("build")
    b.add_argument("name")
    b.add_argument("folder")
    b.add_argument("--chunk-size", type=int, default=chunking.SIZE)
    b.add_argument("--overlap", type=int, default=chunking.OVERLAP)
    b.add_argument("--code", action="store_true")
    b.add_argument("--hubs", type=float)
    for verb in ("search", "ask"):
        s = sub.add_parser(verb)
        s.add_argument("name")
        s.add_argument("text")
        s.add_argument("-k", type=int, default=10)
        s.add_argument("--fusion", default="rrf")
        s.add_argument("--max-score", type=float)
        s.add_argument("--filter", type=json.loads)
    e = sub.add_parser("evaluate")
    e.add_argument("name")
    e.add_argument("dataset")
    e.add_argument("--output")
    e.add_argument("--k-values", default="1,3,5,10,20")
    e.add_argument("--verbose", action="store_true")
    sub.add_parser("list")
    sub.add_parser("remove").add_argument("name")
    a = p.parse_args(argv)
    spark = session()
    if a.verb == "build":
        print(len(build(spark, a.root, a.name, a.folder, size=a.chunk_size, overlap=a.overlap, code=a.code, hubs=a.hubs)), "chunks")
    elif a.verb == "list":
        for name, size in Index.listed(spark, a.root):
            print(name, size)
    else:
        index = Index.load(spark, f"{a.root}/{a.name}")
        if a.verb == "remove":
            index.remove()
        elif a.verb == "evaluate":
            ks = tuple(int(k) for k in a.k_values.split(","))
            judged = _judged(index, a.dataset, "hash", max(*ks, 10))
            found = evaluate.aggregate(*judged, ks)
            found.orderBy("k").show()
            if a.verbose:
                evaluate.at_k(*judged, ks).orderBy("qid", "k").show(1000)
            evaluate.recommendations(*judged).show(truncate=False)
            if a.output:
                found.coalesce(1).write.mode("overwrite").json(a.output)
        else:
            found = search(index, a.text, a.k, a.fusion, most=a.max_score, spec=a.filter)
            if a.verb == "search":
                found.show(a.k, truncate=100)
            else:
                score = "score" if "score" in found.columns else "distance"
                order = F.desc("score") if score == "score" else F.col("score")
                ranked = found.withColumnRenamed(score, "score").withColumn("rank", F.row_number().over(Window.orderBy(order, "id")))
                print(rag.Chat(lambda q, k: ranked, k=a.k).ask(a.text))


if __name__ == "__main__":
    main()
