"""Operator 9: quality rules from zstandard compression bands.

The whole text and each of its fixed chunks of 4,096 bytes are compressed; a ratio (bytes before
by bytes after) above the limit of the length's band means repetitive, below it incompressible.
A document goes if its whole ratio is out of band, or chunks out of band hold more than
``bad_share`` of its bytes. The whole text is compressed, however long.

Nulls and ties: a null or empty text is rejected as ``empty``. Every row is judged by its text
alone, so repeated rows get one decision, null ids and other columns are untouched, ids are integers (or text that reads as integers), and an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import slices

LEVEL, CHUNK, BAD_SHARE = 3, 4096, 0.3
#: (bytes up to, least ratio, greatest ratio). Short texts hardly compress; long prose of any script settles between 1.6 and 3.2.
BANDS = ((64, 0.0, 3.0), (256, 0.7, 3.0), (1024, 1.0, 3.5), (4096, 1.2, 4.0), (65_536, 1.25, 4.5), (float("inf"), 1.25, 6.0))


def band(size: int, bands: tuple = BANDS) -> tuple[float, float]:
    return next((low, high) for most, low, high in bands if size <= most)


def judge(data: bytes, press: zstandard.ZstdCompressor, bands: tuple = BANDS, chunk: int = CHUNK, bad_share: float = BAD_SHARE) -> tuple[float | None, int, int, str | None]:
    """``(ratio, chunks, chunks out of band, reason)``; the reason is None for a text to keep."""
    if not data:
        return None, 0, 0, "empty"
    ratio = len(data) / len(press.compress(data))
    low, high = band(len(data), bands)
    count = bad = bad_bytes = 0
    for at in range(0, len(data), chunk) if len(data) > chunk else ():
        part = data[at : at + chunk]
        own = len(part) / len(press.compress(part))
        least, most = band(len(part), bands)
        count += 1
        if not least <= own <= most:
            bad += 1
            bad_bytes += len(part)
    reason = "repetitive" if ratio > high else "incompressible" if ratio < low else "bad_chunks" if bad_bytes > bad_share * len(data) else None
    return ratio, count, bad, reason


_SCHEMA = pa.struct([("n_bytes", pa.int64()), ("ratio", pa.float64()), ("n_chunks", pa.int32()), ("bad_chunks", pa.int32()), ("reason", pa.string())])


def _judged(parts: Iterator[pa.RecordBatch], text: str, bands: tuple, chunk: int, bad_share: float, only_kept: bool, schema: pa.Schema | None) -> Iterator[pa.RecordBatch]:
    press = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False, write_checksum=False)
    for part in slices(parts):
        texts = pc.fill_null(part.column(text).cast(pa.large_string()), "").cast(pa.large_binary())
        found = [(len(b := x.as_py()), *judge(b, press, bands, chunk, bad_share)) for x in texts]
        if only_kept:
            yield part.filter(pa.array([r[4] is None for r in found], pa.bool_()))
            del part, texts
            continue
        ids = part.column("doc_id")
        cols = [pa.array([r[i] for r in found], _SCHEMA.field(i).type) for i in range(5)]
        yield pa.RecordBatch.from_arrays([ids, *cols, pa.array([r[4] is None for r in found], pa.bool_())], names=["doc_id", *(f.name for f in _SCHEMA), "keep"])
        del part, texts, ids


def decisions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bands: tuple = BANDS, chunk: int = CHUNK, bad_share: float = BAD_SHARE) -> DataFrame:
    """``(doc_id, n_bytes, ratio, n_chunks, bad_chunks, reason, keep)`` of every row."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("t"))
    return own.mapInArrow(lambda x: _judged(x, "t", bands, chunk, bad_share, False, None), "doc_id long, n_bytes long, ratio double, n_chunks int, bad_chunks int, reason string, keep boolean")


def kept(docs: DataFrame, text_col: str = "text", bands: tuple = BANDS, chunk: int = CHUNK, bad_share: float = BAD_SHARE) -> DataFrame:
    """The rows to keep, with all their columns."""
    return docs.mapInArrow(lambda x: _judged(x, text_col, bands, chunk, bad_share, True, None), docs.schema)
