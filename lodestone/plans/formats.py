"""Queries over readers, exports, the stored index and small functions, each with its SQL."""

from __future__ import annotations

import io
import json
import uuid
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone import staging
from lodestone.functions import embed
from lodestone.functions import text as T
from lodestone.functions.metadata import predicate, projected
from lodestone.operators import backends, chunking, evaluate, fusion, knn
from lodestone.operators.index import Index
from lodestone.plans.catalogue import _EVAL, ASKED, COS, K, _bm25_sql, _docs, _emb, _eval, _fusion_sql, _q, _r, _sides, _t, query
from lodestone.sources import exports, readers


def _zip(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def _written(name: str, key: int) -> dict[str, bytes]:
    """One small file of each format."""
    cells = {"cells": [{"cell_type": "code", "source": ["x = 1\n", "print(x)"]}, {"cell_type": "markdown", "source": name}]}
    mail = f"From: a@b\nTo: c@d\nSubject: {name}\n\nbody {key}\n".encode()
    return {
        "txt": name.encode(), "md": f"# {name}\n\nSome **bold** text and a [link](http://x.y) of {key}.\n\n```\ncode\n```\n".encode(), "json": json.dumps({"name": name, "key": key, "none": None, "ok": True}).encode(), "yaml": f"name: {name}\nkey: {key}\n".encode(),
        "toml": f'name = "{name}"\nkey = {key}\n'.encode(), "csv": f"name,key\n{name},{key}\n".encode(), "html": f"<html><head><style>p {{}}</style></head><body><p>{name}</p><script>no()</script><div>{key} &amp; more</div></body></html>".encode(), "ipynb": json.dumps(cells).encode(), "py": f"x = {key}\n".encode(),
        "docx": _zip({"word/document.xml": f'<w xmlns:w="u"><w:p><w:t>{name}</w:t></w:p><w:p><w:t>{key}</w:t></w:p></w>'}), "pptx": _zip({"ppt/slides/slide1.xml": f'<s xmlns:a="u"><a:t>{name}</a:t></s>'}), "xlsx": _zip({"xl/workbook.xml": '<w><sheets><sheet name="S"/></sheets></w>', "xl/worksheets/sheet1.xml": f"<w><row><c><v>{name}</v></c><c><v>{key}</v></c></row></w>"}),
        "eml": mail, "emlx": b"%d\n" % len(mail) + mail + b"<plist/>", "mbox": b"From a@b Mon\n" + mail + b"\nFrom a@b Tue\n" + mail, "xyz": b"?", "bad.json": b"{",
    }


def _files(table: DataFrame, name: str, key: str) -> DataFrame:
    def made(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            rows = [(f"{k}.{ext}", data) for n, k in zip(part.column("n").to_pylist(), part.column("k").to_pylist()) for ext, data in _written(n, k).items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary())], names=["path", "content"])

    return table.select(F.col(name).alias("n"), F.col(key).cast("int").alias("k")).mapInArrow(made, "path string, content binary")


_MAIL = "'From: a@b' || chr(10) || 'To: c@d' || chr(10) || 'Subject: ' || n || chr(10) || 'Date: ' || chr(10) || chr(10) || 'body ' || k"


@query(f"""WITH t AS (SELECT n_name AS n, n_nationkey AS k FROM nation)
SELECT k || '.' || x.ext AS path, x.text AS text FROM t, LATERAL (SELECT unnest(['txt', 'md', 'json', 'yaml', 'toml', 'csv', 'html', 'ipynb', 'py', 'docx', 'pptx', 'xlsx', 'eml', 'emlx', 'mbox', 'xyz', 'bad.json']) AS ext, unnest([
  n, n || ' Some bold text and a link of ' || k || '. code', 'name: ' || n || ' key: ' || k || ' none: ok: true', 'name: ' || n || ' key: ' || k, 'name: ' || n || ' key: ' || k,
  'name key ' || chr(10) || n || ' ' || k || ' ' || chr(10), n || chr(10) || k || ' & more', '[code]' || chr(10) || 'x = 1' || chr(10) || 'print(x)' || chr(10) || chr(10) || '[markdown]' || chr(10) || n || chr(10) || chr(10), 'x = ' || k || chr(10),
  n || chr(10) || k || chr(10), '[Slide]' || chr(10) || n || chr(10) || chr(10), '[Sheet: S]' || chr(10) || n || chr(9) || k || chr(9) || chr(10), {_MAIL}, {_MAIL}, {_MAIL} || chr(10) || chr(10) || {_MAIL}, NULL, NULL]) AS text) x""")
def read_formats(spark: SparkSession, d: str) -> DataFrame:
    return readers.extracted(_files(_t(spark, d, "nation"), "n_name", "n_nationkey")).select("path", "text")


@query(r"""SELECT conv_id, turn, regexp_replace(content, '^\w[\w\-]*:\s*\n', '') AS content FROM (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN '<img src=x>' WHEN turn % 3 = 1 THEN 'bob:' || chr(10) || text ELSE text END AS content FROM conversations)
WHERE NOT regexp_matches(content, '<(img|emoji|voicemsg|videomsg|appmsg)\b') AND trim(content) <> ''""")
def messenger(spark: SparkSession, d: str) -> DataFrame:
    content = F.when(F.col("turn") % 3 == 0, "<img src=x>").when(F.col("turn") % 3 == 1, F.concat(F.lit("bob:\n"), "text")).otherwise(F.col("text"))
    return exports.messenger(_t(spark, d, "conversations").select("conv_id", "turn", content.alias("content")))


@query("SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN role WHEN 1 THEN role || ' [' || turn || ']' ELSE role || ' [a & b [' || turn || ']]' END AS text FROM conversations")
def quoted_message(spark: SparkSession, d: str) -> DataFrame:
    turn = F.col("turn").cast("string")
    inner = F.concat(F.lit("&lt;msg&gt;&lt;title&gt;a &amp;amp; b&lt;/title&gt;&lt;refermsg&gt;&lt;content&gt;"), turn, F.lit("&lt;/content&gt;&lt;/refermsg&gt;&lt;/msg&gt;"))
    quoted = F.when(F.col("turn") % 3 == 1, turn).otherwise(inner)
    xml = F.when(F.col("turn") % 3 == 0, F.col("role")).otherwise(F.concat(F.lit("<msg><title>"), "role", F.lit("</title><refermsg><content>"), quoted, F.lit("</content></refermsg></msg>")))
    return _t(spark, d, "conversations").select("conv_id", "turn", exports.quoted_message(xml).alias("text"))


@query("SELECT conv_id::VARCHAR AS channel, count(*) AS n_messages, string_agg('[' || turn || '] ' || coalesce(role, 'unknown') || ': ' || text, chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id")
def team_chat(spark: SparkSession, d: str) -> DataFrame:
    return exports.team_chat(_t(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("channel"), F.col("turn").alias("ts"), F.col("role").alias("user"), "text"))


@query("""SELECT event_id AS id, concat_ws(chr(10), event_type, 'Author: ' || CASE WHEN event_id % 2 = 0 THEN 'Ann' ELSE '@u' || user_id END, 'Date: ' || strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S'), 'URL: http://x/' || event_id, CASE WHEN event_id % 3 = 0 THEN 'Likes: ' || event_id END) AS text FROM events""")
def bookmarks(spark: SparkSession, d: str) -> DataFrame:
    e = _t(spark, d, "events")
    rows = e.select(
        F.col("event_id").alias("id"), F.when(F.col("event_id") % 2 == 0, "Ann").alias("author"), F.concat(F.lit("u"), "user_id").alias("username"), F.col("event_type").alias("text"), F.lit(None).cast("string").alias("full_text"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("created_at"), F.concat(F.lit("http://x/"), "event_id").alias("url"), F.when(F.col("event_id") % 3 == 0, F.col("event_id")).alias("likes"),
    )
    return exports.bookmarks(rows)


@query("""SELECT event_id AS message_id, event_type AS text, date_trunc('second', ts) AS sent_at, event_id % 2 AS from_me, CASE WHEN user_id % 4 <> 0 THEN 'u' || user_id END AS handle, CASE WHEN event_id % 7 <> 3 THEN CASE WHEN event_id % 7 < 5 THEN 'chat ' || (event_id % 7) ELSE 'ident' END END AS chat
FROM events WHERE event_id % 5 <> 0""")
def phone_messages(spark: SparkSession, d: str) -> DataFrame:
    e = _t(spark, d, "events")
    seconds = F.unix_seconds(F.date_trunc("second", F.col("ts").cast("timestamp")))
    message = e.select(F.col("event_id").alias("ROWID"), F.when(F.col("event_id") % 5 != 0, F.col("event_type")).alias("text"), ((seconds - 978_307_200) * 1_000_000_000).alias("date"), (F.col("event_id") % 2).alias("is_from_me"), F.col("user_id").alias("handle_id"))
    link = e.select(F.col("event_id").alias("message_id"), (F.col("event_id") % 7).alias("chat_id"))
    chat = spark.range(7).filter("id <> 3").select(F.col("id").alias("ROWID"), F.when(F.col("id") < 5, F.concat(F.lit("chat "), "id")).alias("display_name"), F.lit("ident").alias("chat_identifier"))
    handle = e.select("user_id").distinct().filter("user_id % 4 <> 0").select(F.col("user_id").alias("ROWID"), F.concat(F.lit("u"), "user_id").alias("id"))
    return exports.phone_messages(message, link, chat, handle).withColumn("sent_at", F.col("sent_at").cast("timestamp_ntz"))


@query("SELECT source AS folder, count(*) AS n FROM documents GROUP BY 1")
def folder_counts(spark: SparkSession, d: str) -> DataFrame:
    return exports.folders(_docs(spark, d).select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("path")))


@query("SELECT doc_id, source || '/' || lang || '/' || doc_id || '.log' AS path FROM documents WHERE NOT (source = 'src1' OR (lang = 'de' AND source <> 'src2'))")
def ignore_rules(spark: SparkSession, d: str) -> DataFrame:
    rows = _docs(spark, d).select("doc_id", F.concat("source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".log")).alias("path"))
    return readers.ignored(rows, "# rules\n/src1/\nde/\n!src2/**\n/src1\n*.tmp\n")


# small functions

_MODELS = {"nomic-embed-text": 2048, "mxbai-embed-large:latest": 512, "all-minilm:22m": 512, "bge-m3": 8192, "unheard-of": 2048}


@query("SELECT * FROM (VALUES " + ", ".join(f"('{m}', {n}::INT, greatest(1, floor({n} * 0.9) - 128)::INT, '{'cosine' if m.startswith('text-embedding-3') else 'mips'}')" for m, n in {**_MODELS, "text-embedding-3-small": 8192}.items()) + ") t(model, token_limit, chunk_size, metric)")
def model_limits(spark: SparkSession, d: str) -> DataFrame:
    rows = [(m, T.model_limit(m), T.safe_chunk_size(T.model_limit(m), 128), T.metric_for(m)) for m in (*_MODELS, "text-embedding-3-small")]
    return spark.createDataFrame(rows, "model string, token_limit int, chunk_size int, metric string")


@query("""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'python' WHEN 1 THEN 'rust' WHEN 2 THEN 'typescript' END AS language, 'a match of ' || doc_id AS plain, 'query: ' || lang AS prompt FROM documents""")
def small_functions(spark: SparkSession, d: str) -> DataFrame:
    ext = F.element_at(F.array(*map(F.lit, ("py", "RS", "tsx", "zzz"))), (F.col("doc_id") % 4 + 1).cast("int"))
    marked = F.concat(F.lit(" a <b>match</b> of "), F.col("doc_id").cast("string"))
    return _docs(spark, d).select("doc_id", T.language_of(F.concat(F.lit("dir/f."), ext)).alias("language"), T.strip_highlight(marked).alias("plain"), T.with_template(F.col("lang"), None, "query: ").alias("prompt"))


@query(r"""WITH w AS (SELECT doc_id, text, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS w FROM documents)
SELECT doc_id, text AS few, '' AS none, CASE WHEN len(w) > 40 THEN array_to_string(list_slice(w, -40, -1), ' ') ELSE text END AS some FROM w""")
def overlap_rules(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", *[T.overlap_tail(F.col("text"), n).alias(c) for n, c in ((3, "few"), (0, "none"), (200, "some"))])


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS k, 1 AS n_fields FROM events")
def metadata_projection(spark: SparkSession, d: str) -> DataFrame:
    shown = _t(spark, d, "events").select("event_id", projected(F.try_parse_json("props"), ["k", "absent"]).alias("m"))
    return shown.select("event_id", F.try_element_at("m", F.lit("k")).alias("k"), F.size("m").alias("n_fields"))


_WIRE = [("==", "lang = 'en'"), ("!=", "lang <> 'en'"), ("in", "lang IN ('en')"), ("not_in", "lang NOT IN ('en')"), ("contains", "contains(lang, 'en')"), ("starts_with", "starts_with(lang, 'en')"), ("ends_with", "ends_with(lang, 'en')")]


@query("SELECT op, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT '{op}' AS op FROM documents WHERE {where}" for op, where in _WIRE) + ") GROUP BY op")
def wire_names(spark: SparkSession, d: str) -> DataFrame:
    """Specifications as they come over the wire, in JSON."""
    out = None
    for op, _ in _WIRE:
        spec = json.loads(json.dumps({"lang": {op: ["en"] if "in" in op.split("_") else "en"}}))
        rows = _docs(spark, d).filter(predicate(F.lit(None), spec, top_level={"lang": (F.col("lang"), "string")})).select(F.lit(op).alias("op"))
        out = rows if out is None else out.unionByName(rows)
    return out.groupBy("op").agg(F.count("*").alias("n"))


@query("SELECT round(sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) / count(*), 6) AS hit_rate FROM events")
def cache_hit_rate(spark: SparkSession, d: str) -> DataFrame:
    hit = F.col("event_type") == "click"
    return evaluate.hit_rate(_t(spark, d, "events").select(hit.cast("int").alias("hits"), (~hit).cast("int").alias("misses"))).select(_r("hit_rate"))


@query("SELECT * FROM (VALUES (0.5::DOUBLE, 56::BIGINT), (0.9, 96), (0.99, 104), (2.0, 1024)) t(target, effort)")
def least_effort(spark: SparkSession, d: str) -> DataFrame:
    """The least search effort for several targets, where the recall is a hundredth of the effort."""
    rows = [(t, evaluate.least_effort(lambda c: min(1.0, c / 100), t)) for t in (0.5, 0.9, 0.99, 2.0)]
    return spark.createDataFrame(rows, "target double, effort long")


@query("""WITH c AS (SELECT doc_id, ch, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, '')) AS ch FROM documents) WHERE ch <> '' GROUP BY ALL),
b AS (SELECT doc_id, n, unicode(ch) AS u FROM c),
s AS (SELECT d.doc_id, coalesce(sum(n * CASE WHEN u < 128 THEN u WHEN u < 2048 THEN 320 + u // 64 + u % 64 WHEN u < 65536 THEN 480 + u // 4096 + u // 64 % 64 + u % 64 ELSE 624 + u // 262144 + u // 4096 % 64 + u // 64 % 64 + u % 64 END), 0)::BIGINT % 4294967296 AS b FROM documents d LEFT JOIN b ON b.doc_id = d.doc_id GROUP BY d.doc_id),
v AS (SELECT doc_id, list_transform(range(1, 65), lambda j: (b * j % 4294967296 % 1000)::DOUBLE / 1000) AS v FROM s),
n AS (SELECT doc_id, v, sqrt(list_inner_product(v, v)) AS size FROM v)
SELECT doc_id AS id, round(v[1] / CASE WHEN size > 0 THEN size ELSE 1 END, 4) AS head, round(list_sum(v) / CASE WHEN size > 0 THEN size ELSE 1 END, 3) AS total FROM n""")
def hash_embed(spark: SparkSession, d: str) -> DataFrame:
    vec = F.col("vec").cast("array<double>")
    return embed.embedded(_docs(spark, d), "hash", 64).select("id", F.round(vec[0], 4).alias("head"), F.round(F.aggregate(vec, F.lit(0.0), lambda s, x: s + x), 3).alias("total"))


@query("SELECT doc_id AS id, 0::INT AS chunk_index, 'import os' AS text, 'import_statement' AS node_type, false AS is_partial, false AS fallback FROM documents UNION ALL SELECT doc_id, 1, 'def f' || doc_id || '():' || chr(10) || '    return 1', 'function_definition', false, false FROM documents UNION ALL SELECT doc_id, 2, 'class C:' || chr(10) || '    x = ' || doc_id, 'class_definition', false, false FROM documents")
def code_chunks(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id").cast("string")
    code = F.concat(F.lit("import os\n\ndef f"), i, F.lit("():\n    return 1\n\n\nclass C:\n    x = "), i, F.lit("\n"))
    return chunking.code_chunks(_docs(spark, d).select("doc_id", code.alias("text"))).drop("token_count")


# results and documents

@query(f"SELECT vec_id, round(d, 6) AS distance FROM (SELECT vec_id, {COS} AS d FROM embeddings ORDER BY d, vec_id LIMIT 50) WHERE d <= 0.8")
def score_threshold(spark: SparkSession, d: str) -> DataFrame:
    return fusion.with_threshold(knn.knn(_emb(spark, d), _q(spark, d), 50), 0.8).select("vec_id", _r("distance"))


@query(f"SELECT vec_id, round(d, 6) AS distance, coalesce(text, '') AS text FROM (SELECT vec_id, {COS} AS d FROM embeddings ORDER BY d, vec_id LIMIT 10) LEFT JOIN documents ON doc_id = vec_id")
def result_documents(spark: SparkSession, d: str) -> DataFrame:
    found = knn.knn(_emb(spark, d), _q(spark, d), 10)
    return found.join(_docs(spark, d).select(F.col("doc_id").alias("vec_id"), "text"), "vec_id", "left").select("vec_id", _r("distance"), F.coalesce("text", F.lit("")).alias("text"))


_RRF = """, r AS (SELECT id, row_number() OVER (ORDER BY distance, id) AS r FROM v UNION ALL SELECT id, row_number() OVER (ORDER BY score DESC, id) FROM w),
f AS (SELECT id, sum(1 / (60.0::DOUBLE + r)) AS score FROM r GROUP BY id ORDER BY score DESC, id LIMIT 10)
"""


@query(_fusion_sql(_RRF + "SELECT id, round(score, 6) AS score, text FROM f JOIN documents ON doc_id = id"))
def fused_documents(spark: SparkSession, d: str) -> DataFrame:
    """An unknown strategy is reciprocal rank fusion."""
    fused = fusion.fuse("unheard of", *_sides(spark, d), K)
    return fused.join(_docs(spark, d).select(F.col("doc_id").alias("id"), "text"), "id").select("id", _r("score"), "text")


@query("SELECT vec_id AS id, lang, source, n_chars FROM embeddings JOIN documents ON doc_id = vec_id WHERE vec_id % 3 = 0")
def label_passages(spark: SparkSession, d: str) -> DataFrame:
    store = _docs(spark, d).select(F.col("doc_id").alias("id"), "lang", "source", "n_chars")
    return readers.lookup(store, _emb(spark, d).filter("vec_id % 3 = 0").select(F.col("vec_id").alias("id")))


@query(f"SELECT i.id, round(CASE WHEN vec_id IS NULL THEN 1e9 ELSE {COS} END, 6) AS distance FROM (SELECT unnest(range(0, 5000, 7)) AS id) i LEFT JOIN embeddings ON vec_id = i.id")
def distances_by_id(spark: SparkSession, d: str) -> DataFrame:
    vecs = _emb(spark, d).select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    return embed.distances_by_id(vecs, spark.range(0, 5000, 7), [float(x) for x in _q(spark, d).first().q]).select("id", _r("distance"))


for _name in ("exact", "codes"):

    @query(f"SELECT vec_id, round({COS}, 6) AS distance FROM embeddings ORDER BY {COS}, vec_id LIMIT 10", f"backend_{_name}")
    def _backend(spark: SparkSession, d: str, name: str = _name) -> DataFrame:
        return backends.search(name, _emb(spark, d), [float(x) for x in _q(spark, d).first().q], 10).select("vec_id", _r("distance"))


def _index(spark: SparkSession, d: str) -> Index:
    """An index of all documents, built from one half and appended to by the other; a document's vector is that of the same number, round and round."""
    docs = _docs(spark, d).select(F.col("doc_id").alias("id"), "text", F.to_json(F.struct("lang", "source")).alias("metadata"))
    n = _emb(spark, d).count()
    vecs = staging.written(docs.select("id", (F.col("id") % n).alias("vec_id")).join(_emb(spark, d), "vec_id").select("id", F.col("embedding").alias("vec")), "vectors")
    odd = F.col("id") % 2 == 1
    index = Index.build(spark, f"{staging.shared_dir(spark)}/index-{uuid.uuid4().hex[:12]}", docs.filter(~odd), vecs.filter(~odd))
    index.append(docs.filter(odd), vecs.filter(odd))
    staging.forget(vecs)
    return Index.load(spark, index.folder)


@query(_bm25_sql(1.2, 0.75, "SELECT id, round(score, 6) AS score, lang FROM (SELECT * FROM k ORDER BY score DESC, id LIMIT 10) JOIN documents ON doc_id = id"))
def index_keyword(spark: SparkSession, d: str) -> DataFrame:
    found = _index(spark, d).keyword_search(ASKED, 10)
    return found.select("id", _r("score"), F.try_variant_get("metadata", "$.lang", "string").alias("lang"))


@query(f"""WITH n AS (SELECT count(*) AS n FROM embeddings), x AS (SELECT doc_id AS id, text, embedding FROM documents, n JOIN embeddings ON vec_id = doc_id % n WHERE lang = 'en')
SELECT id, round({COS}, 6) AS distance, text FROM x ORDER BY {COS}, id LIMIT 10""")
def index_vector(spark: SparkSession, d: str) -> DataFrame:
    q = [float(x) for x in _q(spark, d).first().q]
    return _index(spark, d).vector_search(q, 10, {"lang": {"==": "en"}}, prefilter=True).select("id", _r("distance"), "text")


@query("SELECT count(*) AS n_documents, count(*) AS n_vectors, 2::BIGINT AS n_batches FROM documents")
def index_size(spark: SparkSession, d: str) -> DataFrame:
    index = _index(spark, d)
    rows = [(len(index), index.vectors().count(), len(index.batches))]
    return spark.createDataFrame(rows, "n_documents long, n_vectors long, n_batches long")


@query()
def compact_search(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of one in three documents are stored; of the others only the candidates are embedded again for the search."""
    docs = _docs(spark, d).select(F.col("doc_id").alias("id"), "text")
    stored = embed.embedded(docs, "hash", 64, "id").withColumn("vec", F.when(F.col("id") % 3 == 0, F.col("vec")))
    near = docs.select(F.col("id").alias("src"), F.explode(F.array(F.col("id") - 1, F.col("id") + 1)).alias("dst"))
    q = [float(x) for x in embed.by_bytes(["what is licensed"], 64)[0]]
    return embed.two_phase(stored, near, docs, q, 10, "hash", 64).select("id", _r("distance"))


@query(_EVAL + """, n AS (SELECT avg(d) AS ndcg FROM (SELECT sum(CASE WHEN rel > 0 AND rank <= 10 THEN 1 / log2(rank + 1) ELSE 0 END) / list_sum(list_transform(range(1, least(any_value(n_rel), 10) + 1), lambda i: 1 / log2(i + 1))) AS d FROM j GROUP BY qid)),
x AS (SELECT 'precision@10' AS measure, avg(pr) AS value, 0.3 AS least FROM m WHERE k = 10 UNION ALL SELECT 'recall@10', avg(re), 0.4 FROM m WHERE k = 10 UNION ALL SELECT 'ndcg@10', ndcg, 0.5 FROM n UNION ALL SELECT 'map', avg(ap), 0.3 FROM ap UNION ALL SELECT 'mrr', avg(rr), 0.5 FROM rr)
SELECT measure, round(value, 6) AS value FROM x WHERE value < least UNION ALL SELECT 'good', round(ndcg, 6) FROM n WHERE ndcg >= 0.7 AND (SELECT value FROM x WHERE measure = 'precision@10') >= 0.7 AND (SELECT value FROM x WHERE measure = 'recall@10') >= 0.6""")
def recommendations(spark: SparkSession, d: str) -> DataFrame:
    results, qrels = _eval(spark, d)
    return evaluate.recommendations(staging.written(results, "results"), qrels).select("measure", _r("value"))


@query("""WITH g AS (SELECT DISTINCT conv_id, text FROM conversations), f AS (SELECT DISTINCT conv_id, text FROM conversations WHERE turn % 2 = 0)
SELECT g.conv_id AS qid, round(count(f.text) / count(*), 6) AS recall FROM g LEFT JOIN f ON f.conv_id = g.conv_id AND f.text = g.text GROUP BY 1""")
def recall_by_text(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "conversations").select(F.col("conv_id").alias("qid"), "turn", "text")
    return evaluate.recall_by_text(rows.filter("turn % 2 = 0"), rows).select("qid", _r("recall"))
