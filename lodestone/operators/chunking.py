"""Chunking of texts: sentence packing, fixed words, character windows, code by syntax."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIZE, OVERLAP = 256, 128
_END = re.compile(r"([.!?]+)\s+|\n\n+")
_TOP = {
    "javascript": r"^(?:export\s+)?(?:default\s+)?(?:async\s+)?(?:function|class|const|let|var)\b", "typescript": r"^(?:export\s+)?(?:default\s+)?(?:async\s+)?(?:function|class|interface|type|enum|const|let|var)\b",
    "java": r"^(?:public|private|protected|abstract|final|static|class|interface|enum|@)\b?", "rust": r"^(?:pub(?:\([^)]*\))?\s+)?(?:fn|struct|enum|impl|trait|mod|const|static|type)\b", "go": r"^(?:func|type|var|const)\b", "csharp": r"^\s{0,4}(?:public|private|protected|internal|namespace|class|interface|enum|struct)\b",
}


def check(size: int, overlap: int, safety: float = 0.9) -> None:
    if size <= 0:
        raise ValueError("the chunk size must be positive")
    if not 0 <= overlap < size:
        raise ValueError("the overlap must be below the chunk size")
    if not 0 < safety <= 1:
        raise ValueError("the safety factor must be above 0 and at most 1")


def estimate(text: str, code: bool = False) -> int:
    return -(-len(text) * 12 // 10) if code else -(-len(text) // 4)


def split_sentences(text: str) -> list[str]:
    out, at = [], 0
    for m in _END.finditer(text):
        out.append(text[at : m.end(1) if m[1] else m.start()].strip())
        at = m.end()
    out.append(text[at:].strip())
    return [s for s in out if s] or ([text] if text.strip() else [])


def tail(text: str, overlap: int) -> str:
    if overlap <= 0:
        return ""
    n, words = overlap // 5, text.split()
    return " ".join(words[-n:]) if 0 < n < len(words) else text


def pack(text: str, size: int = SIZE, overlap: int = OVERLAP, sep: str = " ") -> list[str]:
    """Sentences packed greedily into chunks of up to ``size`` estimated tokens; each chunk begins with the end of the one before."""
    chunks, held, count, fresh = [], "", 0, False
    for s in split_sentences(text):
        n = estimate(s)
        if fresh and count + n > size:
            chunks.append(held.strip())
            held = tail(held, overlap)
            count, fresh = estimate(held), False
        held = held + sep + s if held else s
        count, fresh = count + n, True
    if fresh and held.strip():
        chunks.append(held.strip())
    return chunks


_CHUNK = "id long, chunk_index int, text string, token_count int"


def _chunk_rows(parts: Iterator[pa.RecordBatch], cut: object, code: bool) -> Iterator[pa.RecordBatch]:
    for part in parts:
        rows = [(i, k, c, estimate(c, code)) for i, t in zip(part.column("id").to_pylist(), part.column("t").to_pylist()) for k, c in enumerate(cut(t or ""))]
        yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in enumerate((pa.int64(), pa.int32(), pa.string(), pa.int32()))], names=["id", "chunk_index", "text", "token_count"])


def text_chunks(docs: DataFrame, size: int = SIZE, overlap: int = OVERLAP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, chunk_index, text, token_count)`` by sentence packing; blank texts have no chunk."""
    check(size, overlap)
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"))
    return own.mapInArrow(lambda x: _chunk_rows(x, lambda t: pack(t, size, overlap), False), _CHUNK)


def code_chunks(docs: DataFrame, max_chars: int = 4096, overlap: int = 0, id_col: str = "doc_id", text_col: str = "text", language: str = "python") -> DataFrame:
    """``(id, chunk_index, text, token_count, node_type, is_partial, fallback)`` by top-level definitions; larger ones are cut at lines and partial, windows of characters are a fallback."""
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"))

    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.bool_(), pa.bool_())
        names = ["id", "chunk_index", "text", "token_count", "node_type", "is_partial", "fallback"]
        for part in parts:
            rows = [(i, k, c[0], estimate(c[0], True), *c[1:]) for i, t in zip(part.column("id").to_pylist(), part.column("t").to_pylist()) for k, c in enumerate(code_nodes(t or "", language, max_chars, overlap))]
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in enumerate(types)], names=names)

    return own.mapInArrow(cut, _CHUNK + ", node_type string, is_partial boolean, fallback boolean")


_PYTHON = {"FunctionDef": "function_definition", "AsyncFunctionDef": "function_definition", "ClassDef": "class_definition", "Import": "import_statement", "ImportFrom": "import_from_statement"}
_HEAD = re.compile(r"(?:\b(?:pub(?:\([^)]*\))?|export|default|async|public|private|protected|internal|abstract|final|static)\s+)*(\w+)")


def _kind(line: str, language: str) -> str:
    """The kind of a definition by its first word that isn't a modifier."""
    m = _HEAD.match(line.strip())
    return f"{m[1]}_item" if m else language


def _nodes(text: str, language: str) -> list[tuple[str, str]]:
    lines = text.splitlines(keepends=True)
    if language == "python":
        try:
            body = ast.parse(text).body
        except (SyntaxError, ValueError):
            return []
        starts = [min([n.lineno, *(d.lineno for d in getattr(n, "decorator_list", []))]) - 1 for n in body]
        kinds = [_PYTHON.get(type(n).__name__, type(n).__name__.lower()) for n in body]
    elif language in _TOP:
        head = re.compile(_TOP[language])
        starts = [i for i, line in enumerate(lines) if head.match(line)]
        kinds = [_kind(lines[i], language) for i in starts]
    else:
        return []
    if not starts:
        return []
    starts[0] = 0
    return [("".join(lines[a:b]).rstrip(), k) for a, b, k in zip(starts, [*starts[1:], len(lines)], kinds)]


def split_code(text: str, language: str, max_chars: int = 4096, overlap: int = 0) -> list[str]:
    """Definitions as chunks, those that are too long by lines; windows of characters where the syntax is unknown or broken."""
    return [x[0] for x in code_nodes(text, language, max_chars, overlap)]


def code_nodes(text: str, language: str, max_chars: int = 4096, overlap: int = 0) -> list[tuple[str, str, bool, bool]]:
    """`split_code` with the kind of each definition, whether it is a part of one, and whether it is a mere window."""
    out = []
    for node, kind in _nodes(text, language):
        if len(node) <= max_chars:
            out.append((node, kind, False, False))
            continue
        held: list[str] = []
        for line in node.splitlines(keepends=True):
            if held and sum(map(len, held)) + len(line) > max_chars:
                out.append(("".join(held), kind, True, False))
                held = held[-max(1, overlap // 80) :] if overlap else []
            held.append(line)
        out.append(("".join(held), kind, True, False))
    out = [x for x in out if x[0].strip()]
    return out or [(x, "window", False, True) for x in (windows(text, max_chars, overlap) if text.strip() else [])]


def windows(text: str, size: int, overlap: int) -> list[str]:
    check(size, overlap)
    return [text[a : a + size] for a in range(0, max(1, len(text) - overlap), size - overlap)]


def char_windows(docs: DataFrame, size: int, overlap: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, start, piece)``: windows of characters in whole texts, the last one where the text ends."""
    check(size, overlap)
    last = F.greatest(F.length(F.col(text_col)) - overlap - 1, F.lit(0))
    starts = docs.filter(F.length(text_col) > 0).select(F.col(id_col).alias("id"), F.col(text_col).alias("t"), F.explode(F.sequence(F.lit(0), last, F.lit(size - overlap))).alias("start"))
    return starts.select("id", "start", F.expr(f"substring(t, start + 1, {int(size)})").alias("piece"))


def word_chunks(docs: DataFrame, size: int = 256, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, chunk_index, text)``: chunks of so many words by white space."""
    words = F.filter(F.split(F.coalesce(F.col(text_col), F.lit("")), r"\s+"), lambda w: w != "")

    def parts(w: Column) -> Column:
        n = F.ceil(F.size(w) / size).cast("int")
        return F.transform(F.filter(F.sequence(F.lit(0), n), lambda i: i < n), lambda i: F.array_join(F.slice(w, i * size + 1, size), " "))

    # the words are the one element of an array, so that they are cut once for all chunks
    return docs.select(F.col(id_col).alias("id"), F.posexplode(F.flatten(F.transform(F.array(words), parts))).alias("chunk_index", "text"))


def routed(docs: DataFrame, language_col: str, **sizes: int) -> DataFrame:
    """Prose by sentences, code by syntax: rows with a known language go to `code_chunks` of that language."""
    out = text_chunks(docs.filter(F.col(language_col).isNull()), **sizes)
    for language in ("python", *_TOP):
        out = out.unionByName(code_chunks(docs.filter(F.col(language_col) == language), 4 * sizes.get("size", SIZE), 4 * sizes.get("overlap", 0), language=language).drop("node_type", "is_partial", "fallback"))
    return out
