"""Distances, filters, search, fusion, evaluation and graphs on the survey's fixtures."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.functions import vectors as V
from lodestone.functions.metadata import predicate
from lodestone.operators import evaluate, fusion, graph, keyword, knn, multivector


@pytest.mark.parametrize("a, b, metric, want", [([1, 0, 0], [1, 0, 0], "cosine", 0), ([1, 0, 0], [0, 1, 0], "cosine", 1), ([1, 0, 0], [-1, 0, 0], "cosine", 2), ([0, 0, 0], [1, 0, 0], "cosine", 2), ([0, 0], [3, 4], "euclidean", 5), ([1, 2, 3], [4, 5, 6], "dot", -32)])
def test_distances(spark, a, b, metric, want):
    df = spark.createDataFrame([([float(x) for x in a], [float(x) for x in b])], "a array<float>, b array<float>")
    assert df.select(V.distance(metric, F.col("a"), F.col("b"))).first()[0] == pytest.approx(want)
    assert V.block_distances(metric, np.array([a], float), np.array([b], float))[0, 0] == pytest.approx(want)


def test_unlike_dimensions_raise(spark):
    df = spark.createDataFrame([([1.0, 2.0], [1.0, 2.0, 3.0])], "a array<float>, b array<float>")
    with pytest.raises(Exception, match="dimension"):
        df.select(V.dot(F.col("a"), F.col("b"))).collect()


BOOKS = [(0, '{"chapter": 1, "character": "Alice", "word_count": 150, "is_published": true, "genre": "fiction"}'), (1, '{"chapter": 3, "character": "Bob", "word_count": 250, "is_published": true, "genre": "fiction"}'), (2, '{"chapter": 5, "character": "Alice", "word_count": 300, "is_published": false, "genre": "non-fiction"}'), (3, '{"chapter": 10, "character": "Charlie", "word_count": 400, "is_published": true, "genre": "fiction"}')]


@pytest.mark.parametrize(
    "spec, ids",
    [
        ({}, [0, 1, 2, 3]), ({"chapter": {"==": 1}}, [0]), ({"genre": {"!=": "fiction"}}, [2]), ({"chapter": {"<": 5}}, [0, 1]), ({"word_count": {">": 200}}, [1, 2, 3]), ({"character": {"in": ["Alice", "Bob"]}}, [0, 1, 2]),
        ({"genre": {"contains": "fiction"}}, [0, 1, 2, 3]), ({"genre": {"starts_with": "non"}}, [2]), ({"is_published": {"is_true": None}}, [0, 1, 3]), ({"is_published": {"is_false": None}}, [2]), ({"genre": {"==": "fiction"}, "chapter": {"<=": 5}}, [0, 1]),
        ({"word_count": {">=": 200, "<=": 350}}, [1, 2]), ({"nonexistent": {"==": "value"}}, []), ({"nonexistent": {"!=": "value"}}, []), ({"chapter": {"not_in": 5}}, [0, 1, 2, 3]), ({"genre": {"ends_with": "fiction"}}, [0, 1, 2, 3]),
    ],
)
def test_filters(spark, spec, ids):
    df = spark.createDataFrame(BOOKS, "id long, j string").withColumn("m", F.parse_json("j"))
    assert sorted(r.id for r in df.filter(predicate(F.col("m"), spec)).collect()) == ids


@pytest.mark.parametrize(
    "json, op, value, mode, want",
    [
        ("25", "==", "25", "coercing", True), ("\"25\"", "==", 25, "coercing", True), ("true", "==", 1, "coercing", False), ("null", "==", None, "coercing", True), ("[1,\"a\"]", "contains", "list", "coercing", True), ("\"10\"", "<", "9", "coercing", False), ("\"10\"", "<", "9", "strict", True),
        ("25", "==", "25", "strict", False), ("\" 1 \"", "==", 1, "coercing", False), ("1.5", ">", "1", "coercing", True), ("[]", "is_false", None, "coercing", True), ("[0]", "is_true", None, "coercing", True), ("0", "is_true", None, "coercing", False), ("null", "is_false", None, "coercing", True), ("1", "like", "x", "strict", False), ("\"b\"", ">=", "a", "coercing", True),
    ],
)
def test_filter_kinds(spark, json, op, value, mode, want):
    df = spark.createDataFrame([(f'{{"x": {json}}}',)], "j string").select(F.parse_json("j").alias("m"))
    assert df.filter(predicate(F.col("m"), {"x": {op: value}}, mode)).count() == want


def test_unknown_operator_raises():
    with pytest.raises(ValueError, match="none of"):
        predicate(F.lit(None), {"x": {"like": 1}})


CORPUS = [(0, "Hello world"), (1, "Rust programming language"), (2, "Vector database search"), (3, "mxbai-embed-large model"), (4, None)]


def test_keyword_search(spark):
    docs = spark.createDataFrame(CORPUS, "doc_id long, text string")
    ids = lambda df: [r.id for r in df.collect()]
    assert ids(keyword.bm25(docs, "rust", 5)) == [1] and ids(keyword.bm25(docs, "mxbai-embed-large", 5)) == [3] and ids(keyword.bm25(docs, "nonexistent", 5)) == [] and ids(keyword.bm25(docs, "?!", 5)) == []
    assert ids(keyword.phrase(docs, "vector database")) == [2] and ids(keyword.phrase(docs, "database vector")) == []
    assert keyword.stats(docs).first().num_docs == 5
    n, avg, tf, dl, df = 5, 12 / 5, 1, 3, 1
    want = math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avg))
    assert keyword.bm25(docs, "rust").first().score == pytest.approx(want)
    assert [(r.id, r.score) for r in keyword.grep(docs, "vec.or", 5).collect()] == [(2, 0)]
    assert [r.fragment for r in keyword.highlighted(docs, "world").collect()] == ["Hello <b>world</b>"]


def test_fusion(spark):
    v = spark.createDataFrame([(1, 0.1), (2, 0.2), (3, 0.9)], "id long, distance double")
    w = spark.createDataFrame([(3, 9.0), (1, 4.0), (7, 4.0)], "id long, score double")
    got = {r.id: r.score for r in fusion.rrf(v, w, 10).collect()}
    assert got == pytest.approx({1: 1 / 61 + 1 / 62, 2: 1 / 62, 3: 1 / 63 + 1 / 61, 7: 1 / 63})
    assert [r.id for r in fusion.rrf(v, None, 2).collect()] == [1, 2]
    assert {r.id: r.score for r in fusion.weighted(v, w, 10).collect()} == pytest.approx({1: 0.5, 2: 0.4375, 3: 0.5, 7: 0})
    assert {r.side for r in fusion.cascade(v, w, 5, 3).collect()} == {"keyword"} and {r.side for r in fusion.cascade(v, w, 5, 4).collect()} == {"vector"}
    same = spark.createDataFrame([(1, 5.0), (2, 5.0)], "id long, s double")
    assert [r.norm for r in fusion.minmax(same, "s").collect()] == [1.0, 1.0]
    assert fusion.fuse("unheard of", v, w, 4).count() == 4


def test_batch_search_equals_single_searches(spark):
    r = np.random.default_rng(0)
    rows = [(i, [float(x) for x in r.normal(size=8)]) for i in range(60)] + [(60, [0.0] * 8), (61, None)]
    t = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    batch = {}
    for x in knn.knn_batch(t, t, 5).collect():
        batch.setdefault(x.qid, []).append((x.rank, x.id))
    for q in (0, 17, 60):
        single = knn.knn(t.filter("embedding is not null"), rows[q][1], 5).collect()
        assert [i for _, i in sorted(batch[q])] == [x.vec_id for x in single]


@pytest.mark.parametrize("folder", ["sf0.01", "sf0.1"])
def test_recall_of_approximate_searches(spark, folder):
    """Over the queries whose id is divisible by 20, against brute force, at the settings of the registered queries."""
    from lodestone.plans import catalogue

    d = f"/root/testdata/{folder}"
    e = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "embedding").toArrow()
    ids, m = e.column("vec_id").to_numpy(), np.stack(e.column("embedding").to_numpy(zero_copy_only=False)).astype(float)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    asked = np.flatnonzero(ids % 20 == 0)
    exact = {int(ids[q]): set(ids[np.argsort(-(m @ m[q]), kind="stable")[:10]].tolist()) for q in asked}
    found = {}
    for r in catalogue.QUERIES["knn_ivf"](spark, d).collect():
        found.setdefault(r.qid, set()).add(r.id)
    assert sum(len(found[q] & x) for q, x in exact.items()) >= 0.95 * 10 * len(exact)
    hits = 0
    for q in asked[:8]:
        rows = knn.two_stage(spark.read.parquet(f"{d}/embeddings.parquet"), m[q].tolist(), 10, 100).collect()
        hits += len({r.vec_id for r in rows} & exact[int(ids[q])])
    assert hits >= 0.95 * 80


def test_inverted_lists_of_odd_tables(spark):
    from lodestone.operators import ivf

    r = np.random.default_rng(1)
    rows = [(i, [float(x) for x in r.normal(size=6)]) for i in range(300)] + [(300 + i, [1.0] * 6) for i in range(200)] + [(600, [0.0] * 6), (601, None), (None, [1.0] * 6)]
    t = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    for metric in ("cosine", "euclidean"):
        centres = ivf.fit(t, 7, metric, sample=100)
        got = ivf.search(t.filter("vec_id % 50 = 0"), ivf.assign(t, centres, metric), centres, 5, 7, metric)
        want = knn.knn_batch(t.filter("vec_id % 50 = 0"), t, 5, metric)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert len(ivf.fit(t.limit(0), 5)) == 0 and len(ivf.fit(t, 1000)) == 502


def test_columns_compare_as_variants_do(spark):
    rows = [(None, None), ("en", 5), ("fr", -3), ("null", 10), ("9", 2500), ("src2", 0), ("", 7)]
    df = spark.createDataFrame(rows, "s string, n bigint").withColumn("m", F.to_variant_object(F.struct("s", "n")))
    specs = [{"n": {op: x}} for op in ("==", "!=", "<", "<=", ">", ">=") for x in (5, 2500.0, 2.5, "10", "x")] + [{"s": {op: x}} for op in ("==", "!=", "<", "<=", ">", ">=", "contains", "starts_with", "ends_with") for x in ("en", "9", "src2", "null", "ul", "")]
    specs += [{"n": {"in": [5, "10", 7.0]}}, {"n": {"not_in": [5, 10]}}, {"s": {"in": ["en", "fr"]}}, {"s": {"not_in": ["en", "fr"]}}, {"s": {"not_in": "en"}}, {"n": {"in": []}}, {"n": {"==": None}}, {"s": {"is_true": None}}]
    own = {"s": (F.col("s"), "string"), "n": (F.col("n"), "bigint")}
    for mode in ("coercing", "strict"):
        plain, native = (df.select("s", "n", *[F.coalesce(predicate(F.col("m"), spec, mode, top_level=x), F.lit(False)).alias(f"p{i}") for i, spec in enumerate(specs)]).collect() for x in (None, own))
        for a, b in zip(plain, native):
            assert not [(mode, spec, a.s, a.n) for i, spec in enumerate(specs) if a[f"p{i}"] != b[f"p{i}"]]


def test_filters_reach_the_scan(spark):
    from lodestone.plans import catalogue

    for name, part in (("meta_compound", "EqualTo(lang,en)"), ("knn_prefilter", "EqualTo(label,2)")):
        plan = catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert part in plan.split("PushedFilters")[1]


def test_evaluation(spark):
    res = spark.createDataFrame([(1, k, k) for k in range(1, 6)], "qid long, rank int, id long")
    qrels = spark.createDataFrame([(1, i, 1) for i in (1, 3, 5)], "qid long, id long, rel int")
    at5 = evaluate.at_k(res, qrels).filter("k = 5").first()
    assert (at5.precision, at5.recall) == (0.6, 1.0) and at5.f1 == pytest.approx(0.75)
    assert evaluate.reciprocal_rank(res, qrels).first().rr == 1.0
    assert evaluate.average_precision(res, qrels).first().ap == pytest.approx((1 + 2 / 3 + 3 / 5) / 3)
    perfect = spark.createDataFrame([(1, 1, 1), (1, 2, 3), (1, 3, 5)], "qid long, rank int, id long")
    assert evaluate.ndcg_binary(perfect, qrels, 5).first().ndcg == pytest.approx(1) and evaluate.ndcg_graded(perfect, qrels, 5).first().ndcg == pytest.approx(1)
    assert evaluate.summary(res, qrels).first().queries_without_hits == 0
    assert evaluate.recall_against(res, res, 5).first().recall == 1.0
    assert evaluate.least_effort(lambda c: min(1.0, c / 100), 0.9) == 96


def test_graph(spark):
    n = 100
    nodes = spark.createDataFrame([(i,) for i in range(n)], "vec_id long")
    edges = spark.createDataFrame([(0, i, (i + j + 1) % n, 0.5) for i in range(n) for j in range(15 if i < n / 10 else 5)], "layer int, src long, dst long, distance double")
    degree = graph.degrees(nodes, edges)
    assert graph.threshold(degree, 0.95, 10).first().threshold == 15
    assert 1 <= graph.hubs(degree).count() <= 10 and graph.hubs(degree, 0.95, 16, entry_point=99).count() == 1
    assert graph.prune_neighbours(edges, 3).groupBy("src").count().filter("count <> 3").count() == 0
    assert graph.csr(edges).filter("src = 99").first().dsts == [0, 1, 2, 3, 4]
    vecs = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(n)], "vec_id long, embedding array<float>")
    small = graph.compact(vecs, graph.hubs(degree))
    assert small.filter("embedding is not null").count() == graph.hubs(degree).count()
    assert graph.restore(small, vecs).exceptAll(vecs).count() == 0
    assert graph.window_edges(vecs, 4).count() == 2 * (4 * (n - 4) + 6)


def test_late_interaction(spark):
    tokens = spark.createDataFrame([(d, s, [float(d == s), float(s)]) for d in range(5) for s in range(3)], "doc_id long, seq_id long, vec array<float>")
    q = tokens.filter("doc_id = 1")
    exact = {r.doc_id: r.score for r in multivector.maxsim(q, tokens).collect()}
    assert {r.doc_id: r.score for r in multivector.reranked(q, tokens, 15).collect()} == exact
    assert {r.doc_id: r.score for r in multivector.approximate(q, tokens, 15).collect()} == exact


def test_text_functions(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(T.sentences(F.lit("One two. Three!  Four?\n\nFive"))) == ["One two.", "Three!", "Four?", "Five"]
    assert one(T.overlap_tail(F.lit("a b c d e f"), 10)) == "e f" and one(T.overlap_tail(F.lit("a b"), 100)) == "a b" and one(T.overlap_tail(F.lit("a"), 0)) == ""
    assert one(T.human_bytes(F.lit(2048))) == "2.00 KB" and one(T.human_bytes(F.lit(5))) == "5 B"
    assert one(T.language_of(F.lit("a/b.PY"))) == "python" and one(T.language_of(F.lit("x.zzz"))) is None
    assert T.safe_chunk_size(512, 128) == 332 and T.model_limit("mxbai-embed-large:latest") == 512 and T.model_limit("?") == 2048
    assert T.metric_for("text-embedding-3-small") == "cosine" and T.metric_for("other") == "mips"


def test_sentences_of_odd_texts_as_in_sql(spark, tmp_path):
    import duckdb

    from lodestone.plans import catalogue

    texts = ["", None, " ", "\n\n", ". ", "a.\x0b b", "\x0bq\x0b", "a.  \x0b  b", "a.\x01b", "a. \x01 b", "a  ", "a \n ", "a \r\x85", "x\r\n\r\ny. z", "!!! ??", "a.\n\n\nb", "no end", "a\x00. b"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = [tuple(r) for r in catalogue.QUERIES["sentence_split"](spark, str(tmp_path)).collect()]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(got) == sorted(con.execute(catalogue.SQL["sentence_split"]).fetchall()) and len(got) == 21


def test_judgements_by_label_are_counted_not_listed(spark):
    """Ids 0 to 39 in four labels, one of them of a single row, some null; the measures equal those over the listed pairs."""
    label = lambda i: None if i % 7 == 3 else 9 if i == 10 else i % 3
    rows = spark.createDataFrame([(i, label(i)) for i in range(40)], "id long, label int")
    asked = F.col("id") % 5 == 0
    pairs = [(q, i, 2 if (q + i) % 2 == 0 else 1) for q in range(0, 40, 5) for i in range(40) if q != i and label(q) is not None and label(q) == label(i)]
    listed, counted = spark.createDataFrame(pairs, "qid long, id long, rel int"), evaluate.ByLabel(rows, asked)
    results = spark.createDataFrame([(q, k, (q * 3 + k * 11) % 40) for q in range(0, 40, 5) for k in range(1, 13)], "qid long, rank int, id long")

    def told(f, qrels, *more):
        return sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in f(results, qrels, *more).collect())

    for f, *more in ((evaluate.at_k,), (evaluate.average_precision,), (evaluate.reciprocal_rank,), (evaluate.summary,), (evaluate.recommendations,), (evaluate.ndcg_binary, 10), (evaluate.ndcg_graded, 10)):
        assert told(f, listed, *more) == told(f, counted, *more), f


def test_evaluation_queries_list_no_pairs(spark):
    """The rows of the joins by label, as counted by Spark, stay below those of the table."""
    from lodestone.plans import catalogue

    for name in ("eval_summary", "eval_ap", "eval_ndcg_graded"):
        df = catalogue.QUERIES[name](spark, "/root/testdata/sf0.01")
        tree = df._jdf.queryExecution()
        df.collect()
        plan, most = [tree.executedPlan()], 0
        while plan:
            p = plan.pop()
            plan += [p.children().apply(i) for i in range(p.children().size())] + ([p.executedPlan()] if "AdaptiveSparkPlan" in p.nodeName() else [p.plan()] if "QueryStage" in p.nodeName() else [])
            if "Join" in p.nodeName() and p.metrics().contains("numOutputRows"):
                most = max(most, p.metrics().apply("numOutputRows").value())
        assert 0 < most <= 500


def test_knn_batch_in_parts_and_near_ties(spark, monkeypatch):
    # distances that are equal to 9 places are ties, which go by id
    t = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 2e-5]), (2, [1.0, 0.0])], "vec_id long, embedding array<float>")
    assert [(r.id, r.rank) for r in knn.knn_batch(t.filter("vec_id = 0"), t, 1, exclude_self=True).collect()] == [(1, 1)]
    monkeypatch.setattr(knn, "BLOCK", 4)
    monkeypatch.setattr(knn, "PART_BLOCKS", 1)
    monkeypatch.setattr(knn, "PARTS", 3)
    rng = np.random.default_rng(1)
    vecs = [[float(x) for x in rng.integers(-2, 3, 3)] for _ in range(60)]
    t = spark.createDataFrame(list(enumerate(vecs)), "vec_id long, embedding array<float>").repartition(2)
    for metric in V.METRICS:
        d = np.round(V.block_distances(metric, np.array(vecs), np.array(vecs)), 9)
        want = {(q, rank, i) for q in range(0, 60, 2) for rank, i in enumerate(sorted((i for i in range(60) if i != q), key=lambda i: (d[q, i], i))[:7], 1)}
        assert {(r.qid, r["rank"], r.id) for r in knn.knn_batch(t.filter("vec_id % 2 = 0"), t, 7, metric, exclude_self=True).collect()} == want
    assert knn.knn_batch(t.limit(0), t, 3).count() == knn.knn_batch(t, t.limit(0), 3).count() == 0
    assert knn.knn_batch(t.limit(1), t, 100).count() == 60
