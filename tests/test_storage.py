"""Readers, exports, chunking, conversations, prompts, the index and streams."""

import io
import json
import zipfile
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lodestone.operators import chunking, conversations, keyword, rag
from lodestone.operators.index import Index, with_ids
from lodestone.sources import exports, readers
from lodestone.streaming import ingest


def _zip(**files):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        for n, x in files.items():
            z.writestr(n.replace("__", "/").replace("_xml", ".xml"), x)
    return b.getvalue()


@pytest.mark.parametrize(
    "ext, data, want",
    [
        ("md", b"# Title\n\nSome **bold** text.", "Title Some bold text."), ("json", b'{"key":"value","number":42,"none":null}', "key: value number: 42 none:"), ("toml", b'key = "value"\nn = 42', "key: value n: 42"), ("csv", b"a,b\n1,2\n", "a b \n1 2 \n"),
        ("html", b"<p>Hi <b>you</b></p><script>x</script><p>there", "Hi you\nthere"), ("ipynb", json.dumps({"cells": [{"cell_type": "code", "source": ["a\n", "b"]}]}).encode(), "[code]\na\nb\n\n"), ("py", b"x = 1", "x = 1"),
        ("docx", _zip(word__document_xml='<w xmlns:w="u"><w:p><w:t>One</w:t></w:p><w:p><w:t>Two</w:t></w:p></w>'), "One\nTwo\n"), ("pptx", _zip(ppt__slides__slide1_xml='<s xmlns:a="u"><a:t>Hi</a:t></s>'), "[Slide]\nHi\n\n"),
        ("xlsx", _zip(xl__workbook_xml='<w><sheets><sheet name="S"/></sheets></w>', xl__worksheets__sheet1_xml="<w><row><c><v>1</v></c><c><v>2</v></c></row></w>"), "[Sheet: S]\n1\t2\t\n"),
    ],
)
def test_readers(ext, data, want):
    assert readers.extract(data, ext) == want


def test_unknown_and_damaged_files(spark, tmp_path):
    with pytest.raises(ValueError):
        readers.extract(b"x", "xyz")
    (tmp_path / "sub").mkdir()
    (tmp_path / "node_modules").mkdir()
    for name, data in {"a.md": "# A", "sub/b.json": "{bad", "c.xyz": "?", "node_modules/d.md": "no", ".e.md": "no", "f.py": "x = 1"}.items():
        (tmp_path / name).write_text(data)
    got = {r.path.rsplit("/", 1)[-1]: r.text for r in readers.extracted(readers.files(spark, str(tmp_path))).collect()}
    assert got == {"a.md": "A", "b.json": None}
    assert readers.read_folder(spark, str(tmp_path), code=True).count() == 2


def test_mail():
    assert readers.mail_to_text("From: a@b\nSubject: S\n\nbody\n").endswith("body") and readers.mail_to_text("From: a@b\n\n") is None


def test_chunks():
    text = "The quick brown fox jumps over the lazy dog. " * 20
    chunks = chunking.pack(text, 50, 10)
    assert len(chunks) > 1 and chunking.pack("", 50, 10) == [] and all(chunking.estimate(c) <= 75 for c in chunks)
    for size, overlap in ((0, 0), (5, 5)):
        with pytest.raises(ValueError):
            chunking.check(size, overlap)
    assert chunking.windows("abcdefghij", 4, 2) == ["abcd", "cdef", "efgh", "ghij"] and chunking.windows("ab", 4, 2) == ["ab"]
    code = "import os\n\ndef a():\n    return 1\n\nclass B:\n    pass\n"
    assert len(chunking.split_code(code, "python")) == 3 and chunking.split_code("def (", "python") == ["def ("]
    assert all(len(c) <= 40 for c in chunking.split_code("def f():\n" + "    x = 1\n" * 30, "python", 40))


def test_conversations(spark):
    m = spark.createDataFrame([(1, 0, "user", "hi"), (1, 2, "user", "bye"), (1, 1, "assistant", "yes"), (2, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    assert conversations.concatenated(m).filter("conv_id = 1").first().text == "user: hi\nassistant: yes\nuser: bye"
    t = spark.createDataFrame([(1, i, datetime(2024, 1, 1, 0, x), "aaaa") for i, x in enumerate((0, 10, 45, 50))], "c int, event_id long, at timestamp, text string")
    assert [r.group_no for r in conversations.gap_groups(t, "c", "at").orderBy("at").collect()] == [0, 0, 1, 1]
    assert sorted(r.n_messages for r in conversations.budget_groups(t, "c", "at", 4).collect()) == [1, 1, 1, 1]


def test_exports(spark):
    raw = spark.createDataFrame([(json.dumps({"messages": [{"sender": "human", "text": "hello there"}, {"sender": "ai", "content": "ok"}, {"role": "assistant", "content": "fine"}]}),)], "json string")
    got = exports.chat_export(raw).orderBy("turn").collect()
    assert [(r.role, r.text, r.title) for r in got] == [("user", "hello there", "hello there"), ("assistant", "fine", "hello there")]
    mail = spark.createDataFrame([("f", "Message-ID: <m1@x>\nTo: y\n\nbody\n\nmore"), ("g", "no headers")], "file string, message string")
    assert [(r.message_id, r.body) for r in exports.mail_corpus(mail).collect()] == [("m1@x", "body\n\nmore"), ("g", "")]
    assert spark.range(1).select(exports.quoted_message(F.lit("<msg><title>T</title></msg>"))).first()[0] == "T"


def test_times_and_chat(spark):
    now = datetime(2024, 1, 31)
    assert rag.time_range("mail 3 days ago", now) == ("mail", datetime(2024, 1, 28), now)
    _, a, b = rag.time_range("around 10 days ago", now)
    assert (b - a).days == 4 and rag.time_range("no time", now)[1] is None
    found = spark.createDataFrame([(2, 0.5, "b"), (1, 0.75, "a")], "rank int, score double, text string")
    assert rag.context(found).first().context == "[Document 1] (score: 0.7500):\na\n\n[Document 2] (score: 0.5000):\nb\n"
    chat = rag.Chat(lambda q, k: found)
    assert "simulated" in chat.ask("why?") and len(chat.history) == 2
    with pytest.raises(LookupError):
        rag.Chat(lambda q, k: found.limit(0)).ask("?")


def test_index(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"document {i} about topic {i % 5}", json.dumps({"year": 2020 + i})) for i in range(20)], "id long, text string, metadata string")
    vecs = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(20)], "id long, vec array<float>")
    index = Index.build(spark, str(tmp_path / "one"), docs, vecs)
    assert len(index) == 20 and [r.id for r in index.vector_search([1.0, 0.0], 2).collect()] == [0, 1]
    assert [r.id for r in index.vector_search([1.0, 0.0], 5, {"year": {">": 2022}}).collect()] == [3, 4]
    assert [r.id for r in index.vector_search([1.0, 0.0], 2, {"year": {">": 2022}}, prefilter=True).collect()] == [3, 4]
    assert index.keyword_search("17").first().id == 17 and index.hybrid_search("17", [1.0, 0.0], 3).count() == 3
    more = spark.createDataFrame([(20, "document 20", "{}")], "id long, text string, metadata string")
    new = spark.createDataFrame([(20, [1.0, 20.0])], "id long, vec array<float>")
    assert index.append(more, new) == 1 and len(index) == 21
    for bad in (new, spark.createDataFrame([(30, [1.0])], "id long, vec array<float>")):
        with pytest.raises(ValueError):
            index.append(more if bad is new else more.withColumn("id", F.lit(30).cast("long")), bad)
    small = Index.build(spark, str(tmp_path / "two"), docs, vecs, hub_percentile=0.9, links=4)
    assert small.vectors().filter("vec is not null").count() < 20
    with pytest.raises(ValueError):
        small.append(more, new)
    assert [n for n, _ in Index.listed(spark, str(tmp_path))] == ["one", "two"]
    small.remove()
    assert len(Index.listed(spark, str(tmp_path))) == 1
    assert sorted(r.id for r in with_ids(docs.select("text").repartition(4), 5).collect()) == list(range(5, 25))


def test_ids_after_a_shuffle_join(spark):
    """Each row has its id, and each id its row, however often the plan is run and coalesced."""
    left = spark.range(30_000).select(F.col("id").alias("k"), F.concat(F.lit("t"), "id").alias("text"))
    right = spark.range(0, 60_000, 2).select(F.col("id").alias("k"), F.lit(1).alias("x"))
    joined = left.hint("shuffle_hash").join(right, "k")
    got = with_ids(joined, 7)
    assert got.agg(F.count("*"), F.countDistinct("id"), F.min("id"), F.max("id"), F.countDistinct("text")).first()[:] == (15_000, 15_000, 7, 15_006, 15_000)
    assert got.select("id", "k").exceptAll(got.repartition(2).select("id", "k")).isEmpty()
    assert with_ids(joined.limit(0)).count() == 0 and with_ids(joined.limit(0)).columns == ["id", "k", "text", "x"]


def test_failed_append_leaves_the_index(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(i, f"document {i}", "{}") for i in range(6)], "id long, text string, metadata string")
    vecs = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(6)], "id long, vec array<float>")
    index = Index.build(spark, str(tmp_path), docs, vecs)
    new_docs, new_vecs = docs.withColumn("id", F.col("id") + 10), vecs.withColumn("id", F.col("id") + 10)
    with monkeypatch.context() as m:
        m.setattr(Index, "_publish", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            index.append(new_docs, new_vecs)
    for one in (index, Index.load(spark, str(tmp_path))):
        assert len(one) == one.documents().count() == one.vectors().count() == 6 and one.keyword_search("document", 50).count() == 6
    for d, v in ((new_docs, new_vecs.unionByName(new_vecs)), (new_docs, new_vecs.filter("id > 12")), (new_docs.filter("id > 12"), new_vecs), (docs.limit(1), new_vecs)):
        with pytest.raises(ValueError):
            index.append(d, v)
    assert index.append(new_docs, new_vecs) == 6
    again = Index.load(spark, str(tmp_path))
    assert len(again) == again.documents().count() == 12 and again.keyword_search("document", 50).count() == 12
    stale = Index(spark, str(tmp_path), "default", "cosine", 2, batches=(0,))
    with pytest.raises(OSError):
        stale._publish(1, 0)


QUERIES = ["stone river", "+stone -river", "stone AND river", "stone AND NOT river", '"stone river"', 'text:lamp "green quick" OR seven', "(stone OR lamp) AND (river OR cloud)", "-stone", "nowhere", "stone stone", '"stone nowhere"', "+stone lamp cloud"]


def test_keyword_index_and_scan_agree(spark, tmp_path):
    import random

    from lodestone.operators import keyword

    r = random.Random(3)
    words = "stone river cloud lamp green quick seven".split()
    rows = [(i, " ".join(r.choice(words) for _ in range(r.randrange(0, 12))), "{}") for i in range(60)]
    docs = spark.createDataFrame(rows, "id long, text string, metadata string")
    index = Index.build(spark, str(tmp_path), docs.filter("id < 40"), spark.createDataFrame([(i, [1.0]) for i in range(40)], "id long, vec array<float>"))
    index.append(docs.filter("id >= 40"), spark.createDataFrame([(i, [1.0]) for i in range(40, 60)], "id long, vec array<float>"))
    for q in QUERIES:
        scan = {x.id: round(x.score, 9) for x in keyword.bm25(docs, q, id_col="id").collect()}
        assert {x.id: round(x.score, 9) for x in keyword.bm25(docs, q, id_col="id", index=index.keywords()).collect()} == scan
        has = lambda t, w: w in t.split()
        want = {
            "stone river": lambda t: has(t, "stone") or has(t, "river"), "+stone -river": lambda t: has(t, "stone") and not has(t, "river"), "stone AND river": lambda t: has(t, "stone") and has(t, "river"), "stone AND NOT river": lambda t: has(t, "stone") and not has(t, "river"), '"stone river"': lambda t: "stone river" in t,
            "(stone OR lamp) AND (river OR cloud)": lambda t: (has(t, "stone") or has(t, "lamp")) and (has(t, "river") or has(t, "cloud")), "-stone": lambda t: False, "nowhere": lambda t: False, "+stone lamp cloud": lambda t: has(t, "stone"),
        }.get(q)
        if want:
            assert set(scan) == {i for i, t, _ in rows if want(t)}
    plan = keyword.bm25(docs, "stone river", id_col="id", index=index.keywords())._jdf.queryExecution().executedPlan().toString()
    assert "In(term, [river,stone])" in plan
    with pytest.raises(ValueError, match="field"):
        keyword.parse("title:x")


def test_budget_groups_equal_a_loop(spark):
    import random

    r = random.Random(1)
    rows, at = [], 0
    for i in range(300):
        at += r.choice((1, 2, 50))
        rows.append((r.choice("abc"), i, datetime(2024, 1, 1 + at // 1440, at // 60 % 24, at % 60), r.choice((None, "", "xx", "y" * 9))))
    for overlap in (0, 2):
        want = []
        for who in "abc":
            held, no, fresh = [], 0, 0
            for _, _, when, text in (x for x in rows if x[0] == who):
                pause = fresh and when - held[-1][0] > timedelta(minutes=30)
                if fresh and (pause or sum(len(t) for _, t in held) + len(text or "") > 20):
                    want.append((who, no, held[0][0], held[-1][0], len(held), "\n".join(t for _, t in held)))
                    held, no, fresh = held[-overlap:] if overlap and not pause else [], no + 1, 0
                held.append((when, text or ""))
                fresh += 1
            want.append((who, no, held[0][0], held[-1][0], len(held), "\n".join(t for _, t in held)))
        df = spark.createDataFrame(rows, "who string, event_id int, at timestamp, text string")
        assert sorted(map(tuple, conversations.budget_groups(df, "who", "at", 20, overlap=overlap).collect())) == sorted(want)
    assert conversations.budget_groups(df.limit(0), "who", "at", 20).count() == 0


def test_stream_upsert(spark, tmp_path):
    rows = spark.createDataFrame([(i % 3, f"t{i}", "{}", datetime(2024, 1, 1, 0, i)) for i in range(6)], "id long, text string, metadata string, at timestamp")
    rows.write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        ingest.upsert(ingest.documents_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [0, 1, 2]


def test_embedders(spark):
    from lodestone.functions import embed
    from lodestone.operators import knn

    docs = spark.createDataFrame([(i, f"text {i}") for i in range(30)] + [(30, None)], "doc_id long, text string")
    full = embed.embedded(docs, "hash", 16)
    part = full.withColumn("vec", F.when(F.col("id") % 2 == 0, F.col("vec")))
    again = embed.recomputed(part, docs.withColumnRenamed("doc_id", "id"), "hash", 16)
    assert again.exceptAll(full).count() == 0 and again.count() == 31
    q = [float(x) for x in embed.by_bytes(["text 7"], 16)[0]]
    assert knn.knn(again, q, 1, id_col="id", vec_col="vec").first().id == 7
    assert embed.by_number(["doc 12"], 6).shape == (1, 6)
    assert embed.truncated(docs, 6).first().text == "text "


def test_chat_html(spark):
    page = '<div class="user-message">You: how are you</div><div class="gpt turn"><p>Fine.</div>'
    rows = spark.createDataFrame([("a", page), ("b", "<p>plain text"), ("c", None)], "id string, html string")
    assert [(r.id, r.role, r.text) for r in exports.chat_html(rows).collect()] == [("a", "user", "how are you"), ("a", "assistant", "Fine."), ("b", "unknown", "plain text")]


def test_command_functions(spark, tmp_path):
    from lodestone import cli

    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / "in" / f"f{i}.md").write_text(f"# Note {i}\n\nThis note speaks of topic number{i}. " * 3)
    index = cli.build(spark, str(tmp_path / "ix"), "notes", str(tmp_path / "in"), size=20, overlap=5)
    assert "number2" in cli.search(index, "number2", 1, "keyword").first().text
    assert cli.search(index, "number1", 2).count() == 2 and cli.search(index, "number1", 2, "vector").count() == 2
    (tmp_path / "set.json").write_text(json.dumps({"name": "n", "description": "", "queries": [{"query": "number1", "relevant_docs": ["0"], "graded_relevance": {"0": 2}}]}))
    assert cli.evaluated(index, str(tmp_path / "set.json")).count() == 5


def test_postings_of_an_index_are_those_of_the_texts(spark, tmp_path, monkeypatch):
    """As grouped by Spark; nothing is shuffled for them."""
    monkeypatch.setattr(keyword, "GROUPED", 7)
    texts = ["b a b", "", None, "é Ab ab zz \U0001d51e ￮", "a " * 30, "...", "Zz é b", "b"]
    docs = spark.createDataFrame([(i * 5 % 8, t, "{}") for i, t in enumerate(texts)], "id long, text string, metadata string").repartition(2)
    stored = keyword.segments(docs, "id")
    assert "Exchange" not in stored._jdf.queryExecution().executedPlan().toString().split("Sort")[1].split("MapInArrow")[0]
    as_rows = lambda df: sorted((r.term, r.doc_id, r.tf, r.dl, r.positions) for r in df.collect())
    assert as_rows(stored) == as_rows(keyword.postings(docs, "id"))
    index = Index.build(spark, str(tmp_path / "one"), docs, docs.select("id", F.array(F.lit(1.0), F.col("id")).alias("vec")))
    postings, statistics = index.keywords()
    assert as_rows(postings) == as_rows(stored) and statistics.collect() == keyword.stats(docs).collect()
    for f in (tmp_path / "one/postings/batch=0").glob("*.parquet"):
        rows = [(r.term, r.doc_id) for r in spark.read.parquet(str(f)).collect()]
        assert rows == sorted(rows, key=lambda r: (r[0].encode(), r[1]))
