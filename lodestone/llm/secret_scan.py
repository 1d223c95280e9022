"""Operator 10: secret scan by assignment-aware lexing.

Every ``=``, ``:=``, ``=>`` and ``:`` of a text, and every XML element, is read as a possible assignment. Backwards stands the
name (identifier, dotted, quoted or indexed key, with an optional type annotation), forwards an expression:
quoted literals with escapes, triple-quoted ones, bare configuration values, names and ``${name}`` references, joined
by ``+`` or put side by side. Literals bound to names are remembered through the document and references
to them replaced (constant propagation), so that a secret is also found where it is put together. The literal is scored:
the weight of the most sensitive word of the target's name, plus what its length, entropy and mix of characters say, less for
placeholders and plain words. From ``THRESHOLD`` on it is reported.

The result has one row for each finding: where the value stands (in characters), the name, the score, the literal's length, its
first four characters and its SHA-256; the secret itself is not repeated.

Nulls and ties: null and empty texts have no findings; a null id stays null; ids are integers (or text that reads as integers). Each assignment is reported by
itself, also where names and literals repeat; repeated rows repeat their findings. A name assigned anew has its last value.
Other columns are ignored. Texts are scanned whole, and literals, names, types and the blanks between them may
be of any length; a value put together that is longer than its whole text is scored but not carried on.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

THRESHOLD = 1.0
#: Weights of sensitive words in a name, by its parts joined without marks.
NAMES = {
    "password": 0.8, "passwd": 0.8, "passphrase": 0.8, "pwd": 0.7, "pass": 0.5, "secret": 0.8, "token": 0.7, "apikey": 0.9, "accesskey": 0.8, "privatekey": 0.9, "secretkey": 0.9, "authkey": 0.8, "encryptionkey": 0.8, "signingkey": 0.8,
    "accountkey": 0.8, "sharedkey": 0.8, "credential": 0.7, "credentials": 0.7, "auth": 0.5, "authorization": 0.6, "bearer": 0.7, "clientsecret": 0.9, "connectionstring": 0.6, "dsn": 0.4, "salt": 0.4, "key": 0.3, "cookie": 0.4, "session": 0.3,
}
_MARK = re.compile(r":=|=>|(?<![=!<>+\-*/%&|^~:])=(?![=>~])|:(?![:/=])|<(?=[A-Za-z_])")
#: What stands before a mark is read backwards, on the text turned round, so that names and types of any length cost no more than they have characters:
#: a name, dotted or quoted, and before ``=`` a type between them.
_KEY = r"[ \t]*+(?:([\w$]*[A-Za-z_$](?:[.\-][\w$]*[A-Za-z_$])*)|\]?([\"'`])([\w .\-]*[A-Za-z_])\2)"
_NAME = re.compile(r"[ \t]*+[?!+]?" + _KEY)
_TYPED = re.compile(r"[ \t]*+[\w.<>\[\], |?]*[A-Za-z_][ \t]*+:[?!]?" + _KEY)
_SPACE = re.compile(r"[ \t]*(?:\\\r?\n[ \t]*)?")
_TERM = re.compile(r"(?P<prefix>[rRbBfFuU]{0,2})(?P<q>\"\"\"|'''|\"|'|`)|\$\{(?P<ref>[A-Za-z_][\w.]*)(?::?-(?P<dflt>[^}]*))?\}|\$(?P<env>[A-Za-z_]\w*)|(?P<bare>[^\s,;\"'`<>(){}\[\]]+)")
_JOIN = re.compile(r"[ \t]*(?:\\?\r?\n[ \t]*)?(?:\+|\.\.|&(?!&))[ \t]*(?:\\?\r?\n[ \t]*)?")
_INNER = re.compile(r"\$?\{([A-Za-z_][\w.]*)\}|\$([A-Za-z_]\w*)")
_XML = re.compile(r"<([A-Za-z_][\w.:\-]*)(?:\s[^<>]*+)?>([^<>]++)</\1\s*>")
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "0": "\0"}
_DULL = re.compile(r"(?i)x{3,}|\*{3,}|\.{3}|change.?me|example|placeholder|your[_\-. ]|dummy|sample|redacted|<[^>]*>|none|null|undefined|true|false|test(?:ing)?|todo|secret|password|default|foo|bar|string|required|optional|env")
_WORDS = re.compile(r"[a-z]+|[A-Z][a-z]*|[A-Z]+|\d+")
_URL = re.compile(r"(?i)https?://\S*")
_PATH = re.compile(r"[\w./\\-]+")
_PIECE = r"(?:(?:[a-z]+|[A-Z]+|[A-Z]?[a-z]+(?:[A-Z][a-z]+)+|[A-Z][a-z]+)\d{0,4}|\d+)"
#: What stands between the slashes of a path: words and numbers with marks between them, or a name with an extension.
_SEGMENT = re.compile(rf"[._\-]*(?:{_PIECE}(?:[._\-]+{_PIECE})*[._\-]*)?|[\w.\-]+\.[a-z]{{1,5}}\d?")


def name_weight(name: str) -> float:
    """The greatest weight among the runs of one to three neighbouring parts of a name."""
    parts = [p.lower() for p in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+", name)]
    runs = ("".join(parts[i : i + n]) for n in (1, 2, 3) for i in range(len(parts) - n + 1))
    return max((NAMES.get(r, NAMES.get(r.rstrip("s"), 0.0)) for r in runs), default=0.0)


def _placeholder(value: str) -> bool:
    """Whether a short literal begins with a placeholder, not with random characters that happen to read like one."""
    m = _DULL.match(value)
    if m is None:
        return False
    head, rest = m[0], value[m.end() :]
    if not head[-1:].isalnum() or not rest[:1].isalnum():
        return True
    # no word border: the rest is of words and a short number ("changemenow", "test123"), not a mix
    return bool(re.fullmatch(r"[A-Za-z]?[a-z]*(?:[A-Z][a-z]+)*\d{0,4}\W*|(?:[a-z]+|[A-Z]+)?(?:[_\- ]+[a-z]+)*\d{0,4}\W*", rest))


def _is_path(value: str) -> bool:
    """Whether all segments between slashes look like words or names of files."""
    return "/" in value and bool(_PATH.fullmatch(value)) and all(_SEGMENT.fullmatch(x) for x in re.split(r"[/\\]", value))


def literal_score(value: str) -> float:
    """From -1 (placeholder) to 0.7 (long and random)."""
    n = len(value)
    if n < 6:
        return -1.0
    if _DULL.fullmatch(value) or (n < 40 and _placeholder(value)) or len(set(value)) < 4:
        return -1.0
    if (_URL.fullmatch(value) or _is_path(value)) and not re.search(r"://[^/\s:@]+:[^/\s:@]+@", value):
        return -0.5
    bits = -sum(k / n * math.log2(k / n) for k in Counter(value).values())
    kinds = sum(bool(re.search(p, value)) for p in (r"[a-z]", r"[A-Z]", r"\d", r"[^\w\s]"))
    if " " in value.strip() and kinds < 3:
        return -0.3
    if re.fullmatch(r"[A-Z][a-z]+", value) or (kinds == 1 and not re.search(r"\d", value)):
        return -0.1 if n < 16 or bits < 3.5 else 0.2
    return min(0.7, 0.1 * kinds + 0.08 * max(0.0, bits - 1.5) + 0.1 * (n >= 12) + 0.1 * (n >= 20))


class _Finder:
    """``str.find`` that remembers its last answer for each needle, so that asking again from within the same stretch costs nothing."""

    def __init__(self, text: str):
        self.text, self.last = text, {}

    def __call__(self, needle: str, at: int) -> int:
        """The first place of the needle from ``at`` on; the text's length if there is none."""
        begin, end = self.last.get(needle, (0, -1))
        if not begin <= at <= end:
            end = self.text.find(needle, at)
            end = len(self.text) if end < 0 else end
            self.last[needle] = at, end
        return end


def _quoted(text: str, at: int, quote: str, raw: bool, find: _Finder) -> tuple[str, int] | None:
    """The literal that opens before ``at``, and where it ends."""
    most = len(text) if len(quote) == 3 or quote == "`" else find("\n", at)
    out, i = [], at
    while True:
        j = find(quote, i)
        if j + len(quote) > most:
            return None
        back = text.find("\\", i, j)
        if raw or back < 0:
            out.append(text[i:j])
            return "".join(out), j + len(quote)
        out.append(text[i:back])
        nxt = text[back + 1 : back + 2]
        out.append(_ESCAPES.get(nxt, nxt))
        i = back + 2


def _expression(text: str, at: int, known: dict[str, str], find: _Finder) -> tuple[str, int, int, bool] | None:
    """``(value, start, end, quoted or composed)`` of the expression at ``at``."""
    at = _SPACE.match(text, at).end()
    begin, parts, sure = at, [], False
    while True:
        m = _TERM.match(text, at)
        if m is None:
            break
        if m["q"]:
            got = _quoted(text, m.end(), m["q"], "r" in m["prefix"].lower(), find)
            if got is None:
                break
            value, at = got
            parts.append(_INNER.sub(lambda x: known.get(x[1] or x[2], x[0]), value))
            sure = True
        elif m["bare"] is not None:
            word = m["bare"]
            at = m.end()
            if word in known:
                parts.append(known[word])
                sure = True
            elif parts or text[at : at + 1] in ("(", "["):  # a call or an index is no literal
                break
            else:
                parts.append(_INNER.sub(lambda x: known.get(x[1] or x[2], x[0]), word.rstrip(".,;") if word[-1:] in ".,;" else word))
        else:
            name = m["ref"] or m["env"]
            if name not in known and m["dflt"] is None:
                break
            parts.append(known.get(name, m["dflt"]))
            at, sure = m.end(), True
        join = _JOIN.match(text, at)
        if join is None:
            if text[at : at + 1] == "$" or (text[at : at + 1] in "\"'" and sure and text[at - 1] not in "\"'"):
                continue
            break
        at = join.end()
    return ("".join(parts), begin, at, sure) if parts else None


def scan(text: str, threshold: float = THRESHOLD) -> list[tuple[int, int, str, str, float]]:
    """``(start, end, name, literal, score)`` of the findings, in order."""
    known: dict[str, str] = {}
    find, turned = _Finder(text), text[::-1]
    found: dict[tuple[int, str], tuple[int, int, str, str, float]] = {}
    for m in _MARK.finditer(text):
        at = m.start()
        if m[0] == "<":
            x = _XML.match(text, at)
            if x is None:
                continue
            name, got = x[1], (x[2].strip(), x.start(2), x.end(2), True)
        else:
            n = (m[0] == "=" and _TYPED.match(turned, len(text) - at)) or _NAME.match(turned, len(text) - at)
            if n is None:
                continue
            name = (n[1] or n[3])[::-1]
            got = _expression(text, m.end(), known, find)
            if got is None:
                continue
        value, start, end, sure = got
        # names that are put together from themselves again and again grow beyond all bounds; nothing written in the text is as long as the text
        if len(value) > len(text):
            known.pop(name, None)
        elif sure:
            known[name] = value
            known[re.split(r"[.]", name)[-1]] = value
        elif m[0] in ("=", ":="):
            known[name] = value
        weight = name_weight(name)
        if weight <= 0:
            continue
        score = weight + literal_score(value)
        if score >= threshold:
            found.setdefault((start, name), (start, end, name, value, score))
    return sorted(found.values(), key=lambda r: (r[0], r[2]))


_OUT = "doc_id long, start int, end int, name string, score double, literal_length int, literal_head string, literal_sha256 string"


def _scanned(parts: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    for part in parts:
        rows = []
        for ident, text in zip(part.column("doc_id").to_pylist(), part.column("t")):
            for start, end, name, value, score in scan(text.as_py() or "", threshold):
                rows.append((ident, start, end, name, round(score, 6), len(value), value[:4], hashlib.sha256(value.encode("utf-8", "replace")).hexdigest()))
        types = (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.int32(), pa.string(), pa.string())
        names = [x.split()[0] for x in _OUT.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, start, end, name, score, literal_length, literal_head, literal_sha256)`` of all findings."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("t"))
    return own.filter(F.col("t").rlike("[=:<]")).mapInArrow(lambda x: _scanned(x, threshold), _OUT)
