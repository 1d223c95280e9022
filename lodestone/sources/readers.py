"""Files to text: a recursive binary scan, then an extractor by extension in Arrow batches."""

from __future__ import annotations

import csv
import email
import email.policy
import io
import json
import re
import zipfile
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SKIPPED = (".git", ".svn", ".hg", "node_modules", "target", "dist", "build", "__pycache__", ".venv", "venv", ".idea", ".vscode", ".cache", ".tox", ".mypy_cache", ".pytest_cache", "data", "vendor", ".next", ".gradle", "coverage", "bin")
CODE = ("py", "rs", "js", "ts", "jsx", "tsx", "java", "go", "c", "h", "cpp", "hpp", "cs", "rb", "php", "swift", "kt", "scala", "sh", "sql")


def _markdown(text: str) -> str:
    """Text of Markdown: marks of headings, lists, emphasis, links and code are dropped, their words stay."""
    out, fenced = [], False
    for line in text.splitlines():
        if re.match(r"\s*(```|~~~)", line):
            fenced = not fenced
            continue
        if fenced:
            out.append(line + "\n")
            continue
        line = re.sub(r"^\s{0,3}(#{1,6}\s+|>\s?|[-*+]\s+|\d+[.)]\s+)", "", line)
        line = re.sub(r"^\s*([-=*_]\s*){3,}$", "", line)
        line = re.sub(r"!?\[([^\]]*)\]\([^)]*\)", r"\1", line)
        line = re.sub(r"(\*\*|__|\*|`+|~~)(.+?)\1", r"\2", line)
        if line.strip():
            out.append(line.strip() + " ")
    return "".join(out).strip()


def _walk(value: object) -> str:
    """Strings, numbers and truth values of a tree in order, with ``key:`` before a mapping's values; nulls are dropped."""
    if isinstance(value, dict):
        return "".join((f"{k}: " if isinstance(k, str) else "") + _walk(v) for k, v in value.items())
    if isinstance(value, (list, tuple)):
        return "".join(_walk(v) for v in value)
    if isinstance(value, bool):
        return ("true" if value else "false") + " "
    return f"{value} " if isinstance(value, (str, int, float)) else ""


def _yaml(text: str) -> str:
    try:
        import yaml
    except ImportError:
        # block mappings and lists of scalars, by line
        pairs = (re.sub(r"^\s*(?:- )?", "", line) for line in text.splitlines() if line.strip() and not re.match(r"\s*(#|---|\.\.\.)", line))
        return " ".join(re.sub(r"['\"]", "", p).strip() for p in pairs)
    return _walk(yaml.safe_load(text)).strip()


def _toml(text: str) -> str:
    import tomllib

    return _walk(tomllib.loads(text)).strip()


def _csv(text: str) -> str:
    return "".join("".join(f + " " for f in row) + "\n" for row in csv.reader(io.StringIO(text)) if row)


class _Text(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag: str, attrs: object) -> None:
        self.hidden += tag in ("script", "style")
        if tag in ("p", "div", "br", "li", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article"):
            self.out.append("\n")

    def handle_endtag(self, tag: str) -> None:
        self.hidden = max(0, self.hidden - (tag in ("script", "style")))

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.out.append(re.sub(r"\s+", " ", data))


def html_to_text(text: str) -> str:
    parser = _Text()
    parser.feed(text)
    parser.close()
    return "\n".join(s for s in (line.strip() for line in "".join(parser.out).split("\n")) if s)


def _notebook(text: str) -> str:
    out = []
    for cell in json.loads(text).get("cells", []):
        source = cell.get("source", "")
        out.append(f"[{cell.get('cell_type', 'unknown')}]\n{source if isinstance(source, str) else ''.join(source)}\n\n")
    return "".join(out)


def _xml(data: bytes, name: str) -> ElementTree.Element:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        return ElementTree.fromstring(z.read(name))


def _local(e: ElementTree.Element) -> str:
    return e.tag.rsplit("}", 1)[-1]


def _docx(data: bytes) -> str:
    return "".join("".join(t.text or "" for t in p.iter() if _local(t) == "t") + "\n" for p in _xml(data, "word/document.xml").iter() if _local(p) == "p")


def _pptx(data: bytes) -> str:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))
    return "".join("[Slide]\n" + "\n".join(t.text or "" for t in _xml(data, n).iter() if _local(t) == "t") + "\n\n" for n in names)


def _xlsx(data: bytes) -> str:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter() if _local(t) == "t") for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")) if _local(si) == "si"]
        sheets = [e.get("name") for e in ElementTree.fromstring(z.read("xl/workbook.xml")).iter() if _local(e) == "sheet"]
        out = []
        for i, title in enumerate(sheets, 1):
            out.append(f"[Sheet: {title}]\n")
            if f"xl/worksheets/sheet{i}.xml" in names:
                for row in (e for e in ElementTree.fromstring(z.read(f"xl/worksheets/sheet{i}.xml")).iter() if _local(e) == "row"):
                    for c in (e for e in row if _local(e) == "c"):
                        v = "".join(x.text or "" for x in c.iter() if _local(x) in ("v", "t"))
                        out.append((shared[int(v)] if c.get("t") == "s" and v else v) + "\t")
                    out.append("\n")
    return "".join(out)


def _pdf(data: bytes) -> str:
    try:
        from pypdf import PdfReader
    except ImportError as missing:
        raise ValueError("PDF needs pypdf") from missing
    return "\n".join(p.extract_text() or "" for p in PdfReader(io.BytesIO(data)).pages)


def mail_to_text(raw: bytes | str, with_html: bool = False) -> str | None:
    """Headers and text of a message as one text; None if it has neither body nor subject."""
    m = email.message_from_bytes(raw if isinstance(raw, bytes) else raw.encode(), policy=email.policy.default)
    bodies = [part.get_content() for part in m.walk() if part.get_content_type() == "text/plain"]
    if with_html or not bodies:
        bodies += [html_to_text(part.get_content()) for part in m.walk() if part.get_content_type() == "text/html"]
    body = "\n".join(bodies).strip()
    if not body and not m["subject"]:
        return None
    return "\n".join([*(f"{h}: {m[h] or ''}" for h in ("From", "To", "Subject", "Date")), "", body])


_TEXT: dict[str, Callable[[str], str]] = {"md": _markdown, "markdown": _markdown, "json": lambda t: _walk(json.loads(t)).strip(), "yaml": _yaml, "yml": _yaml, "toml": _toml, "csv": _csv, "html": html_to_text, "htm": html_to_text, "ipynb": _notebook, "txt": lambda t: t}
_BINARY: dict[str, Callable[[bytes], str | None]] = {"docx": _docx, "pptx": _pptx, "xlsx": _xlsx, "pdf": _pdf, "eml": mail_to_text, "emlx": lambda d: mail_to_text(emlx(d)), "mbox": lambda d: "\n\n".join(t for t in map(mail_to_text, mailbox(d)) if t) or None}


def extract(data: bytes, ext: str) -> str:
    """The text of a file by its lower-cased extension; raises ValueError for others than the known ones."""
    ext = ext.lower()
    if ext in _BINARY:
        return _BINARY[ext](data) or ""
    if ext in _TEXT:
        return _TEXT[ext](data.decode("utf-8"))
    if ext in CODE:
        return data.decode("utf-8")
    raise ValueError(f"no reader for .{ext}")


def extracted(files: DataFrame, path_col: str = "path", data_col: str = "content") -> DataFrame:
    """``(path, ext, text, error)``: files that can't be read have null text and the reason."""

    def read(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            rows = []
            for path, data in zip(part.column("p").to_pylist(), part.column("d")):
                ext = path.rsplit(".", 1)[-1].lower() if "." in path.rsplit("/", 1)[-1] else ""
                try:
                    rows.append((path, ext, extract(data.as_py() or b"", ext), None))
                except Exception as e:  # noqa: BLE001 - any damaged file is skipped and counted, whatever its reader raises
                    rows.append((path, ext, None, f"{type(e).__name__}: {e}"[:200]))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(4)], names=["path", "ext", "text", "error"])

    return files.select(F.col(path_col).alias("p"), F.col(data_col).alias("d")).mapInArrow(read, "path string, ext string, text string, error string")


def files(spark: SparkSession, folder: str, extensions: tuple[str, ...] | None = None, code: bool = False, max_bytes: int | None = None, hidden: bool = False) -> DataFrame:
    """The files below a folder as ``(path, modificationTime, length, content)``, without skipped folders and hidden files.

    The conditions are on path and length and are met before the content is read.
    """
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    wanted = extensions or (*_TEXT, *_BINARY, *(CODE if code else ()))
    inside = F.expr(f"substring(path, locate('{folder.rstrip('/').removeprefix('file://')}', path) + {len(folder.rstrip('/').removeprefix('file://'))})")
    rows = rows.filter(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*wanted)).filter(~inside.rlike("/(" + "|".join(re.escape(s) for s in SKIPPED) + ")/"))
    if not hidden:
        rows = rows.filter(~inside.rlike(r"/\.[^/]"))
    return rows if max_bytes is None else rows.filter(F.col("length") <= max_bytes)


def extension_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).alias("ext")).agg(F.count("*").alias("n")).orderBy("ext")


def read_folder(spark: SparkSession, folder: str, **options: object) -> DataFrame:
    """``(path, ext, text)`` of the readable files below a folder."""
    return extracted(files(spark, folder, **options)).filter("text is not null").drop("error")


def passages(spark: SparkSession, path: str) -> DataFrame:
    """A passage store: JSON lines of ``id``, ``text``, ``metadata`` in one file or many; metadata as variant."""
    rows = spark.read.schema("id string, text string, metadata string").json(path)
    return rows.withColumn("metadata", F.try_parse_json("metadata"))


def lookup(store: DataFrame, ids: DataFrame, strict: bool = False) -> DataFrame:
    """The passages of a table of ids; unknown ones drop out, or raise where ``strict``."""
    wanted = ids.select("id").distinct()
    if not strict:
        return store.join(wanted, "id", "left_semi")
    known = F.when(F.col("__known").isNotNull(), F.col("id")).otherwise(F.raise_error(F.concat(F.lit("no passage has the id "), F.col("id").cast("string"))))
    found = wanted.join(store.withColumn("__known", F.lit(1)), "id", "left")
    return found.withColumn("id", known).drop("__known").select(*store.columns)


def mailbox(data: bytes) -> list[bytes]:
    """The messages of an mbox file: each begins with a line ``From `` after a blank one or at the start; quoted ``>From`` lines are unquoted."""
    parts = re.split(rb"(?:\A|(?<=\n\n)|(?<=\r\n\r\n))From [^\n]*\n", data)
    return [re.sub(rb"(?m)^>(>*From )", rb"\1", p).rstrip(b"\r\n") + b"\n" for p in parts if p.strip()]


def emlx(data: bytes) -> bytes:
    """The message of a file that begins with its length in a line of its own and ends with a property list."""
    head, _, rest = data.partition(b"\n")
    return rest[: int(head)] if head.strip().isdigit() else data


def ignored(paths: DataFrame, rules: str, path_col: str = "path") -> DataFrame:
    """The rows whose path the lines of an ignore file don't exclude: globs, ``dir/``, ``/anchored``, ``**`` and ``!again``; the last line that fits decides."""
    out = F.lit(False)
    for line in (x.strip() for x in rules.splitlines()):
        if not line or line.startswith("#"):
            continue
        again, body = line.startswith("!"), line.lstrip("!")
        anchored, folder = "/" in body.rstrip("/"), body.endswith("/")
        glob = "".join({"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(x, re.escape(x)) for x in re.split(r"(\*\*/|\*\*|\*|\?)", body.strip("/")))
        fits = F.col(path_col).rlike(("^/?" if anchored else "(?:^|/)") + glob + ("/" if folder else "(?:/|$)"))
        out = F.when(fits, F.lit(not again)).otherwise(out)
    return paths.filter(~out)


def with_placeholder(vectors: DataFrame, texts: DataFrame, id_col: str = "vec_id", text_id: str = "doc_id") -> DataFrame:
    """Vectors with their texts, ``Document <id>`` where there is none."""
    t = texts.select(F.col(text_id).alias("__t"), "text")
    return vectors.join(t, vectors[id_col] == F.col("__t"), "left").withColumn("text", F.coalesce("text", F.concat(F.lit("Document "), F.col(id_col).cast("string")))).drop("__t")


def evaluation_set(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``(queries (qid, query), qrels (qid, id, rel))`` of a JSON data set."""
    schema = "name string, description string, queries array<struct<query:string,relevant_docs:array<string>,graded_relevance:map<string,int>>>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path).select(F.posexplode("queries").alias("qid", "q"))
    graded = rows.select("qid", F.explode("q.graded_relevance").alias("id", "rel"))
    plain = rows.select("qid", F.explode("q.relevant_docs").alias("id"), F.lit(1).alias("rel"))
    return rows.select("qid", "q.query"), graded.unionByName(plain).groupBy("qid", "id").agg(F.max("rel").alias("rel"))
