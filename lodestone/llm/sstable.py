"""Operator 5: documents as sorted-string-table shards.

Documents are range-partitioned and sorted by identifier. Each shard is one binary table:

* data blocks of prefix-compressed entries (bytes shared with the key before, key suffix, value),
  with a full key at every 16th entry and the list of these restart points at the end; a block is
  compressed with zstandard;
* a sparse index: last key, place and length of every block;
* a Bloom filter of the distinct keys, 10 bits each and 7 probes;
* a footer of fixed size: places and lengths of index and filter, entries, checksum, magic number.

A lookup binary-searches shards by their first and last keys, asks the filter, then binary-searches index and
restart points and reads one run of entries. A key is the identifier as 16 hex digits with the sign turned, so
that keys sort as identifiers do; a value is the document's other columns as JSON.

Nulls and ties: a null identifier has the empty key, first of all, and is found by looking up None.
Rows that repeat an identifier are all stored, in order of their values, and a lookup returns them all;
they may lie in neighbouring shards. Null columns are stored as null. Extra columns are stored
like the others. Ids are integers (or text that reads as integers). An empty table gives no shards. A document larger than a block has one of its own.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import struct
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch
from .tokens import slices, trim

BLOCK_BYTES, TABLE_BYTES, RESTART, BITS, PROBES, LEVEL = 64_000, 16_000_000, 16, 10, 7, 3
FOOTER, MAGIC = struct.Struct("<QQQQQIQ"), 0x4C4F44455353540A

SCHEMA = "shard long, first_id long, last_id long, n_docs long, n_blocks long, n_bytes long, sstable binary"
_SCHEMA = pa.schema([(n, pa.binary() if n == "sstable" else pa.int64()) for n in ("shard", "first_id", "last_id", "n_docs", "n_blocks", "n_bytes", "sstable")])


def key_of(ident: int | None) -> bytes:
    return b"" if ident is None else b"%016x" % (ident + 2**63)


def _number(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _probes(key: bytes, bits: int) -> Iterator[int]:
    a, b = struct.unpack("<QQ", hashlib.blake2b(key, digest_size=16).digest())
    return ((a + i * b) % bits for i in range(PROBES))


class Writer:
    """Builds one table from entries in order of key."""

    def __init__(self) -> None:
        self.blocks, self.index, self.keys, self.count, self.raw, self.place = [], [], [], 0, 0, 0
        self.press = zstandard.ZstdCompressor(level=LEVEL)
        self._open()

    def _open(self) -> None:
        self.block, self.restarts, self.entries, self.last = bytearray(), [], 0, b""

    def add(self, key: bytes, value: bytes) -> None:
        shared = 0
        if self.entries % RESTART == 0:
            self.restarts.append(len(self.block))
        else:
            most = min(len(key), len(self.last))
            while shared < most and key[shared] == self.last[shared]:
                shared += 1
        self.block += _number(shared) + _number(len(key) - shared) + _number(len(value)) + key[shared:] + value
        self.entries += 1
        if not self.keys or self.keys[-1] != key:
            self.keys.append(key)
        self.last = key
        self.count += 1
        self.raw += len(value)
        if len(self.block) >= BLOCK_BYTES:
            self._close()

    def _close(self) -> None:
        if self.entries:
            data = self.press.compress(bytes(self.block) + struct.pack(f"<{len(self.restarts) + 1}I", *self.restarts, len(self.restarts)))
            self.blocks.append(data)
            self.index.append((self.last, self.place, len(data)))
            self.place += len(data)
        self._open()

    def finish(self) -> bytes:
        self._close()
        bits = max(64, len(self.keys) * BITS + 7 & ~7)
        bloom = bytearray(bits // 8)
        for key in self.keys:
            for p in _probes(key, bits):
                bloom[p >> 3] |= 1 << (p & 7)
        index = b"".join(_number(len(k)) + k + _number(at) + _number(n) for k, at, n in self.index)
        body = b"".join(self.blocks)
        tail = index + bytes(bloom)
        return body + tail + FOOTER.pack(len(body), len(index), len(body) + len(index), len(bloom), self.count, zlib.crc32(tail), MAGIC)


class Reader:
    """Lookups in one table."""

    def __init__(self, data: bytes):
        self.data = data
        at, n, bloom, m, self.count, check, magic = FOOTER.unpack(data[-FOOTER.size :])
        if magic != MAGIC or zlib.crc32(data[at : bloom + m]) != check:
            raise ValueError("not a whole table")
        self.bloom, self.last, self.places = data[bloom : bloom + m], [], []
        end = at + n
        while at < end:
            size, at = _read(data, at)
            self.last.append(data[at : at + size])
            place, at = _read(data, at + size)
            length, at = _read(data, at)
            self.places.append((place, length))

    def may_hold(self, key: bytes) -> bool:
        bits = len(self.bloom) * 8
        return all(self.bloom[p >> 3] >> (p & 7) & 1 for p in _probes(key, bits))

    def _block(self, i: int) -> tuple[bytes, tuple[int, ...]]:
        place, length = self.places[i]
        raw = zstandard.ZstdDecompressor().decompress(self.data[place : place + length])
        (n,) = struct.unpack("<I", raw[-4:])
        return raw[: -4 * (n + 1)], struct.unpack(f"<{n}I", raw[-4 * (n + 1) : -4])

    @staticmethod
    def _entries(body: bytes, at: int) -> Iterator[tuple[bytes, bytes]]:
        key = b""
        while at < len(body):
            shared, at = _read(body, at)
            own, at = _read(body, at)
            size, at = _read(body, at)
            key = key[:shared] + body[at : at + own]
            at += own
            yield key, body[at : at + size]
            at += size

    def get(self, ident: int | None) -> list[dict]:
        key, out = key_of(ident), []
        if not self.may_hold(key):
            return out
        for i in range(bisect.bisect_left(self.last, key), len(self.last)):
            body, restarts = self._block(i)
            start = bisect.bisect_left(restarts, key, key=lambda at: next(self._entries(body, at))[0])
            for k, value in self._entries(body, restarts[max(0, start - 1)]):
                if k > key:
                    return out
                if k == key:
                    out.append(json.loads(value))
        return out

    def items(self) -> Iterator[tuple[int | None, dict]]:
        for i in range(len(self.places)):
            for key, value in self._entries(self._block(i)[0], 0):
                yield (int(key, 16) - 2**63 if key else None), json.loads(value)


def _tables(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    task, seq, out = TaskContext.get().partitionId(), 0, None
    first = last = None

    def closed() -> pa.RecordBatch:
        data = out.finish()
        row = (task * 2**20 + seq, first, last, out.count, len(out.index), len(data), data)
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, _SCHEMA)], schema=_SCHEMA)

    for part in slices(parts):
        for ident, value in zip(part.column("__key"), part.column("__value")):
            ident = ident.as_py()
            if out is None:
                out, first = Writer(), ident
            out.add(key_of(ident), value.as_py().encode())
            last = ident
            if out.raw >= TABLE_BYTES:
                yield closed()
                out, seq = None, seq + 1
                trim()
        del part, value
    if out is not None:
        yield closed()
        out = None
        trim()


def tables(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row for each shard, in order of key: ``(shard, first_id, last_id, n_docs, n_blocks, n_bytes, sstable)``."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c != id_col]
    value = F.to_json(F.struct(*rest), {"ignoreNullFields": "false"}) if rest else F.lit("{}")
    own = docs.select(F.col(id_col).cast("long").alias("__key"), value.alias("__value"))
    parts = scratch.shuffle_partitions(docs.sparkSession)
    ordered = own.repartitionByRange(parts, F.col("__key").asc_nulls_first()).sortWithinPartitions(F.col("__key").asc_nulls_first(), "__value")
    return ordered.mapInArrow(_tables, SCHEMA)


def documents(shards: DataFrame) -> DataFrame:
    """``(doc_id, value)`` of all entries: the shards read back, for checks and for scans."""

    def read(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for data in part.column("sstable"):
                rows = list(Reader(data.as_py()).items())
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int64()), pa.array([json.dumps(v, ensure_ascii=False) for _, v in rows], pa.string())], names=["doc_id", "value"])

    return shards.select("sstable").mapInArrow(read, "doc_id long, value string")


def lookup(shards: DataFrame, ids: list[int | None]) -> list[dict]:
    """The values of some identifiers, in their order. The tasks read only shards whose range holds one, and only what is found comes to the driver."""
    known, null = sorted({i for i in ids if i is not None}), None in ids
    inside = F.lit(False)
    if known:
        inside = (F.coalesce(F.col("first_id"), F.lit(known[0])) <= known[-1]) & (F.col("last_id") >= known[0])
    if null:
        inside = inside | F.col("first_id").isNull()

    def read(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for first, last, shard, data in zip(*(part.column(c).to_pylist() for c in ("first_id", "last_id", "shard")), part.column("sstable")):
                low = 0 if first is None else bisect.bisect_left(known, first)
                wanted = [None] * (null and first is None) + (known[low : bisect.bisect_right(known, last)] if last is not None else [])
                if wanted:
                    reader = Reader(data.as_py())
                    rows = [(i, shard, k, json.dumps(v, ensure_ascii=False)) for i in wanted for k, v in enumerate(reader.get(i))]
                    yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string()))], names=["doc_id", "shard", "place", "value"])

    found: dict[int | None, list[dict]] = {}
    for r in shards.filter(inside).select("first_id", "last_id", "shard", "sstable").mapInArrow(read, "doc_id long, shard long, place long, value string").orderBy("shard", "place").toLocalIterator():
        found.setdefault(r.doc_id, []).append({"doc_id": r.doc_id, **json.loads(r.value)})
    return [v for i in dict.fromkeys(ids) for v in found.get(i, [])]
