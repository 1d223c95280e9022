"""Scalar text functions: tokens, sentences, estimates, highlights, formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words of letters and digits, for Java's and RE2's syntax alike.
WORD = r"[\p{L}\p{N}]+"


def words(text: Column) -> Column:
    """Lower-cased words; null has none."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def token_estimate(text: Column, code: bool = False) -> Column:
    """Tokens by rule of thumb: a quarter of the characters of prose, 1.2 for each of code."""
    return F.ceil(F.length(text) * (F.lit(1.2) if code else F.lit(0.25))).cast("int")


def safe_chunk_size(limit: int, overlap: int, safety: float = 0.9, code: bool = False) -> int:
    """The chunk size that keeps within a model's limit."""
    safe = int(limit * safety)
    return max(1, int(safe / 1.2) - overlap * 3) if code else max(1, safe - overlap)


#: White space as RE2 has it; Java's ``\s`` also has the vertical tab.
_BLANK = r"[\t\n\f\r ]"


def sentences(text: Column, or_whole: bool = True) -> Column:
    r"""Sentences of each paragraph: cut after ``.!?`` and white space or at blank lines (and at ``\x01``, which marks the cuts), trimmed, blanks dropped.

    A text without any is one sentence as a whole, unless ``or_whole`` is false; then it has none, and null stays null.
    """
    cut = F.split(F.regexp_replace(text, rf"([.!?]){_BLANK}+", "$1\x01"), r"\x01|\n\n+")
    # \z: Java's $ also matches before a last line end, which may be U+0085, U+2028 or U+2029
    parts = F.filter(F.transform(cut, lambda s: F.regexp_replace(s, rf"^{_BLANK}+|{_BLANK}+\z", "")), lambda s: s != "")
    return F.when(F.size(parts) > 0, parts).otherwise(F.array(text)) if or_whole else parts


def overlap_tail(text: Column, overlap: int) -> Column:
    """The last overlap // 5 words, joined by blanks; the whole text if that is no word or the text has no more; nothing without an overlap."""
    n = overlap // 5
    if overlap <= 0 or n == 0:
        return text if overlap > 0 else F.lit("")
    cut = F.transform(F.array(F.filter(F.split(text, r"\s+"), lambda w: w != "")), lambda w: F.when(F.size(w) > n, F.array_join(F.slice(w, -n, n), " ")))
    return F.coalesce(F.element_at(cut, 1), text)


def occurrences(text: Column, needle: Column | str) -> Column:
    """How often a string occurs, ignoring case, without overlaps."""
    low, part = F.lower(text), F.lower(F.lit(needle) if isinstance(needle, str) else needle)
    return ((F.length(low) - F.length(F.replace(low, part, F.lit("")))) / F.length(part)).cast("int")


def highlight(text: Column, terms: list[str]) -> Column:
    """Marks the terms as whole words with ``<b>``."""
    import re

    return F.regexp_replace(text, r"(?i)\b(" + "|".join(re.escape(t) for t in terms) + r")\b", "<b>$1</b>")


def strip_highlight(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "</?b>", ""))


def human_bytes(n: Column, decimals_for_bytes: bool = False) -> Column:
    """Sizes by powers of 1024; bytes without decimals unless asked for."""
    whole = F.format_string("%.2f B" if decimals_for_bytes else "%.0f B", n.cast("double"))
    out = whole
    for k, unit in enumerate(("KB", "MB", "GB", "TB"), 1):
        out = F.when(n >= 1024**k, F.concat(F.replace(F.format_number(F.bround(n / float(1024**k), 2), 2), F.lit(","), F.lit("")), F.lit(f" {unit}"))).otherwise(out)
    return out


LANGUAGES = {
    "py": "python", "rs": "rust", "js": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "java": "java", "go": "go", "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "hpp": "cpp", "cs": "csharp", "rb": "ruby", "php": "php", "swift": "swift", "kt": "kotlin", "scala": "scala",
}


def language_of(path: Column) -> Column:
    """Programming language by extension, null if none is known."""
    table = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.try_element_at(table, F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1)))


def with_template(text: Column, override: str | None = None, query_template: str | None = None, template: str | None = None) -> Column:
    """Prepends a prompt template: the override, else the query's, else the general one, else none."""
    chosen = override if override is not None else query_template if query_template is not None else template
    return F.concat(F.lit(chosen), text) if chosen else text


#: Token limits of embedding models by family.
MODEL_LIMITS = {"nomic-embed-text": 2048, "mxbai-embed-large": 512, "all-minilm": 512, "bge-m3": 8192, "snowflake-arctic-embed": 512, "text-embedding-3-small": 8192, "text-embedding-3-large": 8192, "text-embedding-ada-002": 8192}


def model_limit(name: str, default: int = 2048) -> int:
    """The limit of a model by full name, by the name before a colon, by part of the name, else the default."""
    base = name.split(":")[0]
    for key in (name, base):
        if key in MODEL_LIMITS:
            return MODEL_LIMITS[key]
    return next((n for k, n in MODEL_LIMITS.items() if k in base or base in k), default)


#: Models whose vectors are of unit length, by pattern; they are compared by cosine.
NORMALISED = ("text-embedding-3", "text-embedding-ada", "voyage", "embed-english", "embed-multilingual", "gemini-embedding")


def metric_for(model: str, given: str | None = None) -> str:
    """The metric asked for, else cosine for models with unit vectors, else inner product."""
    return given or ("cosine" if any(p in model.lower() for p in NORMALISED) else "mips")
