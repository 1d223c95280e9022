"""Operator 2: language identification by compression.

For each language a zstandard raw-content dictionary is filled with text known to be of it. A text is
encoded with every dictionary and belongs to the language whose dictionary makes it smallest. Texts
longer than ``CHUNK`` bytes are encoded in chunks of that length, all of them, so that the dictionary
keeps counting; the sizes are summed. If the runner-up is less than ``MARGIN`` (as a share of its size) worse,
the text is rejected: ``lang_pred`` is null.

The dictionaries are fitted on a bounded sample of labelled rows: ``dict_bytes`` of text for each language. Whole texts are cut into pieces of
``PIECE`` characters, and the pieces with the least hashes fill the dictionary, so that a long document adds as much as it has pieces and a language of
short rows has a dictionary too. The bound is a parameter and does not grow with the table.

Nulls and ties: null and empty texts, and texts of fewer than ``LEAST_BYTES`` bytes, are rejected. Equal sizes are a margin of
0 and rejected. Every row is judged by its text alone; repeated rows and null ids stay, other columns
are ignored. Ids are integers (or text that reads as integers). Without labelled rows there are no dictionaries and everything is rejected. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DICT_BYTES, CHUNK, MARGIN, LEAST_BYTES, LEVEL = 65_536, 1_024, 0.01, 8, 3
#: Characters of the pieces that texts are sampled by.
PIECE = 1_024


def fit(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", dict_bytes: int = DICT_BYTES) -> dict[str, bytes]:
    """Dictionaries by language."""
    own = docs.select(F.col(lang_col).cast("string").alias("l"), F.col(text_col).cast("string").alias("t")).filter("l is not null and length(t) > 0")
    sums = {r.l: (r.n, r.p) for r in own.groupBy("l").agg(F.sum(F.length("t")).alias("n"), F.sum(F.ceil(F.length("t") / PIECE)).alias("p")).collect()}
    pieces = own.select("l", F.explode(F.regexp_extract_all("t", F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))).alias("t")).withColumn("h", F.xxhash64("t"))
    picked = F.lit(False)
    for lang, (chars, count) in sums.items():
        # four times what is needed, and 64 pieces more, so that chance leaves no dictionary short
        share = min(1.0, (4.0 * dict_bytes * count / chars + 64) / count)
        picked = picked | ((F.col("l") == lang) & (F.col("h") <= min(2**63 - 1, int(share * 2**64) - 2**63)))
    held: dict[str, list[bytes]] = {}
    sizes_: dict[str, int] = {}
    for r in pieces.filter(picked).orderBy("l", "h", "t").toLocalIterator():
        if sizes_.get(r.l, 0) < dict_bytes:
            held.setdefault(r.l, []).append(r.t.encode() + b"\n")
            sizes_[r.l] = sizes_.get(r.l, 0) + len(held[r.l][-1])
    return {lang: b"".join(x)[:dict_bytes] for lang, x in held.items()}


def sizes(data: bytes, presses: list[zstandard.ZstdCompressor], chunk: int = CHUNK) -> list[int]:
    parts = [data[at : at + chunk] for at in range(0, len(data), chunk)]
    return [sum(len(press.compress(x)) for x in parts) for press in presses]


def compressors(dicts: dict[str, bytes]) -> tuple[list[str], list[zstandard.ZstdCompressor]]:
    langs, out = sorted(dicts), []
    for lang in langs:
        d = zstandard.ZstdCompressionDict(dicts[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        params = zstandard.ZstdCompressionParameters.from_level(LEVEL, source_size=CHUNK, dict_size=len(dicts[lang]), write_content_size=False, write_dict_id=False, write_checksum=False)
        d.precompute_compress(compression_params=params)
        out.append(zstandard.ZstdCompressor(dict_data=d, compression_params=params))
    return langs, out


def choose(data: bytes, langs: list[str], presses: list[zstandard.ZstdCompressor], margin: float = MARGIN) -> tuple[str | None, str | None, float | None]:
    """``(accepted language, smallest language, margin)``."""
    if len(data) < LEAST_BYTES or not langs:
        return None, None, None
    found = sorted(zip(sizes(data, presses), langs))
    if len(found) == 1:
        return found[0][1], found[0][1], None
    gap = (found[1][0] - found[0][0]) / found[1][0]
    return (found[0][1] if gap >= margin and gap > 0 else None), found[0][1], gap


_OUT = "doc_id long, lang_pred string, smallest string, margin double"


def identify(docs: DataFrame, dicts: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text", margin: float = MARGIN) -> DataFrame:
    """``(doc_id, lang_pred, smallest, margin)`` of every row; a null ``lang_pred`` means rejected."""

    def judged(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, presses = compressors(dicts)
        for part in parts:
            found = [choose((x or "").encode(), langs, presses, margin) for x in part.column("t").to_pylist()]
            cols = [pa.array([r[i] for r in found], t) for i, t in enumerate((pa.string(), pa.string(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *cols], names=["doc_id", "lang_pred", "smallest", "margin"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("t")).mapInArrow(judged, _OUT)
