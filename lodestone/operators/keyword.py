"""Keyword search: BM25, phrases, grep and highlights over a document table."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as T

K1, B = 1.2, 0.75
_WORD = re.compile(r"[^\W_]+")


_TOKEN = re.compile(r'\s*(?:([+-])?(?:(\w+):)?(?:"([^"]*)"|(\()|([^\s()"]+))|(\)))')

#: A parsed query: ``("words", [w])`` of one word or of a phrase, ``("and" | "or", [queries])``, ``("not", query)``.
Parsed = tuple


def parse(query: str, field: str = "text") -> Parsed | None:
    """A query with OR between words by default, ``AND``, ``OR``, ``NOT``, ``+must``, ``-not``, "phrases", ``field:word`` and parentheses; None if it has no word."""
    tokens = [m.groups() for m in _TOKEN.finditer(query)]
    at = 0

    def group() -> Parsed | None:
        nonlocal at
        ors: list[list[Parsed]] = [[]]
        must: list[Parsed] = []
        joined = negate = False
        while at < len(tokens) and tokens[at][5] is None:
            sign, name, quoted, opened, word, _ = tokens[at]
            at += 1
            if word in ("AND", "OR", "NOT") and not sign and not name:
                joined, negate = joined or word == "AND", negate or word == "NOT"
                continue
            if name is not None and name != field:
                raise ValueError(f"there is no field {name!r}")
            if opened:
                part = group()
                at += 1  # the closing one
            else:
                words = _WORD.findall((quoted if quoted is not None else word).lower())
                part = ("words", words) if words and quoted is not None else ("or", [("words", [w]) for w in words]) if len(words) > 1 else ("words", words) if words else None
            if part is not None:
                if negate or sign == "-":
                    part = ("not", part)
                if sign == "+" or part[0] == "not" and not joined:
                    must.append(part)
                elif joined and ors[-1]:
                    ors[-1].append(part)
                else:
                    ors.append([part])
            joined = negate = False
        some = [x[0] if len(x) == 1 else ("and", x) for x in ors if x]
        if not some and not must:
            return None
        any_ = [some[0] if len(some) == 1 else ("or", some)] if some else []
        if any(x[0] != "not" for x in must):  # what must be there decides; the others only add to the score
            return ("and", [*must, *(("may", x) for x in any_)])
        return ("and", [*any_, *must]) if must else any_[0]

    found = []
    while at < len(tokens):
        one = group()
        at += 1
        if one is not None:
            found.append(one)
    return found[0] if len(found) == 1 else ("or", found) if found else None


def _leaves(q: Parsed, positive: bool = True) -> list[tuple[tuple[str, ...], bool]]:
    """The words and phrases of a query, and whether they count for the score."""
    if q[0] == "words":
        return [(tuple(q[1]), positive)]
    inner = q[1] if isinstance(q[1], list) else [q[1]]
    return [x for p in inner for x in _leaves(p, positive and q[0] != "not")]


def _holds(q: Parsed, there: Callable[[tuple[str, ...]], Column]) -> Column:
    if q[0] == "words":
        return there(tuple(q[1]))
    if q[0] == "not":
        return ~_holds(q[1], there)
    if q[0] == "may":
        return F.lit(True)
    out = None
    for x in q[1]:
        one = _holds(x, there)
        out = one if out is None else out & one if q[0] == "and" else out | one
    return out


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(term, doc_id, tf, dl, positions)`` of all words: the keyword index as a table."""
    own = docs.select(F.col(id_col).alias("doc_id"), T.words(F.col(text_col)).alias("w"))
    words = own.select("doc_id", F.size("w").alias("dl"), F.posexplode("w").alias("at", "term"))
    return words.groupBy("term", "doc_id").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"), F.sort_array(F.collect_list("at")).alias("positions"))


#: Words that `segments` groups together.
GROUPED = 1_000_000


def _grouped(ids: pa.Array, words: pa.ListArray) -> pa.RecordBatch:
    """The postings of some texts, in the order of terms and ids."""
    sizes = np.diff(words.offsets.to_numpy())
    coded = words.flatten().dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy().astype(np.int64)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    own = ids.fill_null(-(2**63)).to_numpy()
    by_id = np.empty(len(own), np.int64)
    by_id[np.argsort(own, kind="stable")] = np.arange(len(own))
    key = rank[coded.indices.to_numpy()] * len(own) + np.repeat(by_id, sizes)
    at = np.arange(len(key)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    place = np.argsort(key, kind="stable")  # places of a text stay in order
    key = key[place]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    text = np.argsort(by_id)[key[first] % max(1, len(own))]
    columns = [
        coded.dictionary.take(pa.array(order[key[first] // max(1, len(own))])), ids.take(pa.array(text)), pa.array(np.diff(np.r_[first, len(key)])), pa.array(sizes[text].astype(np.int32)),
        pa.ListArray.from_arrays(pa.array(np.r_[first, len(key)].astype(np.int32)), pa.array(at[place].astype(np.int32))),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["term", "doc_id", "tf", "dl", "positions"])


def segments(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`postings` of texts whose ids differ, for storage: each partition has those of its own texts, by term and id. A text's words stand in one row, so nothing is shuffled."""

    def grouped(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            ends = part.column("w").offsets.to_numpy() - part.column("w").offsets[0].as_py()
            start = 0
            while start < part.num_rows:
                stop = max(start + 1, int(np.searchsorted(ends, ends[start] + GROUPED, "right")) - 1)
                some = part.slice(start, stop - start)
                yield _grouped(some.column("doc_id"), some.column("w"))
                start = stop

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), T.words(F.col(text_col)).alias("w"))
    return own.mapInArrow(grouped, "term string, doc_id long, tf long, dl int, positions array<int>").sortWithinPartitions("term", "doc_id")


def _times(words: Column, term: str) -> Column:
    return F.size(F.filter(words, lambda w: w == F.lit(term)))


def _earlier(places: Column, n: int) -> Column:
    return F.transform(places, lambda x: x - n)


def _counts(docs: DataFrame, leaves: list[tuple[str, ...]], id_col: str, text_col: str) -> DataFrame:
    """``(id, dl, tf0, tf1, ...)``: each text is cut into words once, as what a generator gives isn't inlined into those who use it."""

    def one(w: Column) -> Column:
        joined = F.concat(F.lit("  "), F.array_join(w, "  "), F.lit("  "))
        tf = [_times(w, leaf[0]) if len(leaf) == 1 else T.occurrences(joined, " " + "  ".join(leaf) + " ") for leaf in leaves]
        return F.struct(F.size(w).alias("dl"), *[c.alias(f"tf{i}") for i, c in enumerate(tf)])

    return docs.select(F.col(id_col).alias("id"), F.inline(F.transform(F.array(T.words(F.col(text_col))), one)))


def _indexed(table: DataFrame, leaves: list[tuple[str, ...]]) -> DataFrame:
    """``(id, dl, tf0, tf1, ...)`` from postings: only those of the query's words are read."""
    terms = list(dict.fromkeys(w for leaf in leaves for w in leaf))
    at = {t: F.max(F.when(F.col("term") == t, F.col("positions"))).alias(f"p{i}") for i, t in enumerate(terms)}
    rows = table.filter(F.col("term").isin(terms)).groupBy(F.col("doc_id").alias("id")).agg(F.first("dl").alias("dl"), *at.values())

    def tf(leaf: tuple[str, ...]) -> Column:
        found = F.col(f"p{terms.index(leaf[0])}")
        for k, w in enumerate(leaf[1:], 1):
            found = F.array_intersect(found, _earlier(F.col(f"p{terms.index(w)}"), k))
        return F.coalesce(F.size(found), F.lit(0))

    return rows.select("id", "dl", *[F.greatest(tf(leaf), F.lit(0)).alias(f"tf{i}") for i, leaf in enumerate(leaves)])


def terms_of(query: str) -> list[str]:
    """The distinct words of a query, in order."""
    return list(dict.fromkeys(_WORD.findall(query.lower())))


def bm25(docs: DataFrame, query: str, k: int | None = None, k1: float = K1, b: float = B, id_col: str = "doc_id", text_col: str = "text", index: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """``(id, score)`` of the documents that fit the query (see `parse`), best first, ties by id. A phrase counts like a word that stands where the phrase does.

    Without an index one pass counts the query's words in each document; the statistics are one row of sums, so the plan
    neither explodes nor shuffles the words. ``index`` is ``(postings, statistics)`` as written by `Index`: then only the postings of the query's words are read.
    """
    q = parse(query)
    none = docs.select(F.col(id_col).alias("id"), F.lit(0.0).alias("score")).limit(0)
    if q is None:
        return none
    leaves = list(dict.fromkeys(leaf for leaf, _ in _leaves(q)))
    scored = [i for i, leaf in enumerate(leaves) if (leaf, True) in _leaves(q)]
    if not scored:
        return none
    counted = _counts(docs, leaves, id_col, text_col) if index is None else _indexed(index[0], leaves)
    dfs = [F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(leaves))]
    if index is None:
        sums = counted.agg(F.count("*").alias("n"), F.avg("dl").alias("avg"), *dfs)
    else:
        sums = counted.agg(*dfs).crossJoin(index[1].agg(F.sum("num_docs").alias("n"), (F.sum("num_words") / F.sum("num_docs")).alias("avg")))
    score = F.lit(0.0)
    length = F.lit(k1) * (F.lit(1 - b) + F.lit(b) * F.col("dl") / F.col("avg"))
    for i in scored:
        tf, df = F.col(f"tf{i}"), F.col(f"df{i}")
        score = score + F.log(1 + (F.col("n") - df + 0.5) / (df + 0.5)) * tf * (k1 + 1) / (tf + length)
    hits = counted.filter(_holds(q, lambda leaf: F.col(f"tf{leaves.index(leaf)}") > 0)).crossJoin(F.broadcast(sums)).select("id", score.alias("score"))
    return hits.orderBy(F.desc("score"), "id").limit(k) if k else hits


def phrase(docs: DataFrame, words: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, matches)`` of the documents that have the words next to each other, in order."""
    leaf = tuple(_WORD.findall(words.lower()))
    return _counts(docs, [leaf], id_col, text_col).filter("tf0 > 0").select("id", F.col("tf0").alias("matches"))


def grep(docs: DataFrame, pattern: str, k: int | None = None, id_col: str = "doc_id", text_col: str = "text", whole_row: bool = False) -> DataFrame:
    """``(id, score)`` of the documents in which the pattern is found, ignoring case.

    The score is the number of times that the pattern occurs literally and may be 0. ``whole_row`` looks in the row's
    JSON, other columns included.
    """
    where = F.to_json(F.struct("*")) if whole_row else F.col(text_col)
    found = docs.filter(where.rlike("(?i)" + pattern)).select(F.col(id_col).alias("id"), T.occurrences(F.col(text_col), pattern).alias("score"))
    return found.orderBy(F.desc("score"), "id").limit(k) if k else found


def regex_count(docs: DataFrame, literal: str, k: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, score)``: how often a literal occurs, ignoring case; documents without it are left out."""
    found = docs.select(F.col(id_col).alias("id"), F.regexp_count(F.col(text_col), F.lit("(?i)" + re.escape(literal))).alias("score")).filter("score > 0")
    return found.orderBy(F.desc("score"), "id").limit(k) if k else found


def highlighted(docs: DataFrame, query: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, fragment, n_marks)`` of the documents with a word of the query."""
    marked = docs.select(F.col(id_col).alias("id"), T.highlight(F.col(text_col), terms_of(query)).alias("fragment"))
    return marked.withColumn("n_marks", F.regexp_count("fragment", F.lit("<b>"))).filter("n_marks > 0")


def stats(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``(num_docs, num_words, avg_words)`` of the index."""
    return docs.select(F.size(T.words(F.col(text_col))).alias("n")).agg(F.count("*").alias("num_docs"), F.sum("n").alias("num_words"), F.avg("n").alias("avg_words"))
