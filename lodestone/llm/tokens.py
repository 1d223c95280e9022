"""Vectorised tokenising and hashing of whole Arrow text columns.

A token is a maximal run of word characters of the lower-cased text: ``[0-9a-z]`` and the non-ASCII letters, marks and digits.
Characters of scripts that are written without blanks (Chinese, Japanese, Thai, Lao, Khmer, Burmese) are tokens one by one.
Blanks, punctuation and symbols, whether ASCII or not, separate tokens; with ``symbols=True`` maximal runs of punctuation and symbols
are tokens too. The classes are the ranges of code points below, and `TOKEN_RE` says the same as a regular expression for Python and SQL.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Scripts without blanks: each character is a token.
ALONE = (
    (0x0E00, 0x0E3E), (0x0E40, 0x0E4E), (0x0E50, 0x0E59), (0x0E81, 0x0EFF), (0x1000, 0x1049), (0x1050, 0x109D), (0x1780, 0x17D3), (0x17D7, 0x17D7), (0x17DC, 0x17FF), (0x2E80, 0x2FDF), (0x3005, 0x3007), (0x3021, 0x302F), (0x3031, 0x303C),
    (0x3041, 0x309F), (0x30A1, 0x30FA), (0x30FC, 0x318F), (0x31A0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x1AFF0, 0x1B16F), (0x20000, 0x3FFFF),
)
#: Blanks and invisible characters.
BLANK = ((0x80, 0xA0), (0xAD, 0xAD), (0x1680, 0x1680), (0x2000, 0x200F), (0x2028, 0x202F), (0x205F, 0x206F), (0x3000, 0x3000), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFF0, 0xFFFB), (0xE0000, 0xE0FFF))
#: Punctuation and symbols.
MARKS = (
    (0xA1, 0xA9), (0xAB, 0xAC), (0xAE, 0xB1), (0xB4, 0xB4), (0xB6, 0xB8), (0xBB, 0xBB), (0xBF, 0xBF), (0xD7, 0xD7), (0xF7, 0xF7), (0x2C2, 0x2C5), (0x2D2, 0x2DF), (0x37E, 0x37E), (0x387, 0x387), (0x55A, 0x55F), (0x589, 0x58F), (0x5BE, 0x5BE), (0x5C0, 0x5C0),
    (0x5C3, 0x5C3), (0x5F3, 0x5F4), (0x606, 0x60F), (0x61B, 0x61F), (0x66A, 0x66D), (0x6D4, 0x6D4), (0x964, 0x965), (0x970, 0x970), (0xE3F, 0xE3F), (0xE4F, 0xE4F), (0xE5A, 0xE5B), (0x104A, 0x104F), (0x17D4, 0x17D6), (0x17D8, 0x17DB), (0x1800, 0x180A),
    (0x2010, 0x2027), (0x2030, 0x205E), (0x207A, 0x207E), (0x208A, 0x208E), (0x20A0, 0x20CF), (0x2190, 0x245F), (0x2500, 0x2BFF), (0x2E00, 0x2E7F), (0x3001, 0x3004), (0x3008, 0x3020), (0x3030, 0x3030), (0x303D, 0x303F), (0x30A0, 0x30A0), (0x30FB, 0x30FB), (0x3200, 0x33FF), (0x4DC0, 0x4DFF),
    (0xE000, 0xF8FF), (0xFD3E, 0xFD3F), (0xFE10, 0xFE1F), (0xFE30, 0xFE6F), (0xFF01, 0xFF0F), (0xFF1A, 0xFF20), (0xFF3B, 0xFF40), (0xFF5B, 0xFF65), (0xFFE0, 0xFFEE), (0xFFFC, 0xFFFF), (0x1F000, 0x1FAFF),
)


def _rest() -> list[tuple[int, int]]:
    """What no class holds: the non-ASCII word characters."""
    out, at = [], 0x80
    for low, high in sorted(ALONE + BLANK + MARKS):
        if low > at:
            out.append((at, low - 1))
        at = high + 1
    return [*out, (at, 0x10FFFF)]


def _ranges(ranges: tuple | list, form: str) -> str:
    return "".join(form % low + ("-" + form % high if high > low else "") for low, high in ranges)


_PY, _RE2 = "\\U%08x", "\\x{%X}"
#: The same tokens as a regular expression: for Python, and for engines that write code points as ``\\x{...}`` (SQL).
TOKEN_RE, TOKEN_SQL = (f"[{_ranges(ALONE, f)}]|[0-9a-z{_ranges(_rest(), f)}]+" for f in (_PY, _RE2))
SYMBOL_RE = TOKEN_RE + rf"|[!-/:-@\[-`{{-~{_ranges(MARKS, _PY)}]+"

#: Kinds of bytes: 0 separates, 1 is part of a word, 2 is a mark, 3 is part of a character that is a token.
_KIND = np.zeros(256, np.uint8)
_KIND[33:127] = 2
for _lo, _hi in ((48, 58), (97, 123), (128, 256)):
    _KIND[_lo:_hi] = 1


class _Classes:
    """The kind of every code point, made when it is first needed."""

    table: np.ndarray | None = None

    @classmethod
    def of(cls, points: np.ndarray) -> np.ndarray:
        if cls.table is None:
            cls.table = np.ones(0x110000, np.uint8)
            for kind, ranges in ((0, BLANK), (2, MARKS), (3, ALONE)):
                for low, high in ranges:
                    cls.table[low : high + 1] = kind
        return cls.table[points]


def _kinds(data: np.ndarray) -> np.ndarray:
    """The kind of each byte of valid UTF-8."""
    kind = _KIND[data]
    lead = np.flatnonzero(data >= 0xC0)
    if not len(lead):
        return kind
    first = data[lead].astype(np.int32)
    size = 2 + (first >= 0xE0) + (first >= 0xF0)
    point = first & np.array([0, 0, 0x1F, 0x0F, 0x07], np.int32)[size]
    for k in (1, 2, 3):
        more = size > k
        point[more] = (point[more] << 6) | (data[lead[more] + k] & 0x3F)
    found = _Classes.of(point)
    other = found != 1
    lead, size, found = lead[other], size[other], found[other]
    for k in range(4):
        part = size > k
        kind[lead[part] + k] = found[part]
    return kind


_BASE = 0x9E3779B97F4A7C15
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
_PRIME, _UNPRIME = 0x5851F42D4C957F2D, pow(0x5851F42D4C957F2D, -1, 2**64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
        np.cumprod(out, out=out)
    return out


class _Tables:
    up = _powers(_PRIME, 1)
    down = _powers(_UNPRIME, 1)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            cls.up, cls.down = _powers(_PRIME, n), _powers(_UNPRIME, n)
        return cls.up, cls.down


def tokenise(texts: pa.Array, symbols: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(hash, row, start, end)`` of every token; start and end are bytes of the row's lower-cased text. Null texts have none."""
    low = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    if isinstance(low, pa.ChunkedArray):
        low = low.combine_chunks()
    low = low.cast(pa.large_binary())
    offs = np.frombuffer(low.buffers()[1], np.int64)[low.offset : low.offset + len(low) + 1] if len(low) else np.zeros(1, np.int64)
    if offs[-1] == offs[0]:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, none
    data = np.frombuffer(low.buffers()[2], np.uint8)[offs[0] : offs[-1]]
    offs = offs - offs[0]
    kind = _kinds(data)
    if not symbols:
        kind[kind == 2] = 0
    new = np.empty(len(kind), bool)
    new[0] = True
    np.not_equal(kind[1:], kind[:-1], out=new[1:])
    new |= (kind == 3) & (data >= 0xC0)
    new[offs[:-1][offs[:-1] < len(kind)]] = True
    at = np.flatnonzero(new)
    ends = np.append(at[1:], len(kind))
    real = kind[at] > 0
    starts, ends = at[real], ends[real]
    up, down = _Tables.of(len(data))
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_BYTES[data] * up[: len(data)], out=sums[1:])
    value = (sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64)
    row = np.searchsorted(offs, starts, "right") - 1
    return mix(value), row, starts - offs[row], ends - offs[row]


def grams(tok: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """``(hash, row)`` of all word n-grams; a row of fewer than n tokens has one gram of all its tokens."""
    if not len(tok):
        return tok, row
    total = len(tok)
    h, whole = tok.copy(), np.ones(total, bool)
    first = np.empty(total, bool)
    first[0] = True
    np.not_equal(row[1:], row[:-1], out=first[1:])
    for k in range(1, n):
        nxt = np.zeros(total, bool)
        nxt[: total - k] = row[k:] == row[: total - k]
        shifted = np.zeros(total, np.uint64)
        shifted[: total - k] = tok[k:]
        h = np.where(nxt, mix(h * np.uint64(_BASE) + shifted + np.uint64(k)), h)
        whole &= nxt
    keep = whole | first
    return h[keep], row[keep]


def batches(parts: Iterator[pa.RecordBatch], text: str, target: int, rows: int = 60_000) -> Iterator[pa.Table]:
    """Regroup a task's record batches into tables of about ``target`` text bytes, split and joined at row borders."""
    held: list[pa.RecordBatch] = []
    size = count = 0
    for part in parts:
        if not part.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(part.column(text)), 0).to_numpy(zero_copy_only=False)
        reach, at = np.cumsum(lengths), 0
        while at < len(lengths):
            before = int(reach[at - 1]) if at else 0
            end = int(np.searchsorted(reach, before + max(1, target - size), "left")) + 1
            end = max(at + 1, min(end, len(lengths), at + rows - count))
            held.append(part.slice(at, end - at))
            size, count, at = size + int(reach[end - 1]) - before, count + end - at, end
            if size >= target or count >= rows:
                table = pa.Table.from_batches(held)
                held, size, count = [], 0, 0
                yield table
                del table
                trim()
    if held:
        table, held = pa.Table.from_batches(held), []
        yield table
        del table
        trim()


def slices(parts: Iterator[pa.RecordBatch], rows: int = 1_000) -> Iterator[pa.RecordBatch]:
    """A task's record batches in slices of so many rows, so that what is made of them is small on both sides. A batch is given up before the next is read, if the caller keeps nothing of it."""
    for part in parts:
        for at in range(0, part.num_rows, rows):
            yield part.slice(at, rows)
        del part
        trim()


def trim() -> None:
    """Give freed memory back, so that workers that wait don't hold what they needed at their peak."""
    pa.default_memory_pool().release_unused()
    give = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if give is not None:
        give(0)


def trimmed(f: Callable[..., pa.Table]) -> Callable[..., pa.Table]:
    """A grouped function that gives its memory back when it is done."""

    def one(table: pa.Table) -> pa.Table:
        out = f(table)
        trim()
        return out

    def two(left: pa.Table, right: pa.Table) -> pa.Table:
        out = f(left, right)
        trim()
        return out

    return two if f.__code__.co_argcount == 2 else one


def column(table: pa.Table, name: str) -> pa.Array:
    got = table.column(name)
    return got.combine_chunks() if got.num_chunks != 1 else got.chunk(0)


def murmur_int(value: int, seed: int = 42) -> int:
    """Spark's hash of a 32-bit integer, signed."""

    def turn(x: int, r: int) -> int:
        return ((x << r) | (x >> (32 - r))) & 0xFFFFFFFF

    k = turn(value * 0xCC9E2D51 & 0xFFFFFFFF, 15) * 0x1B873593 & 0xFFFFFFFF
    h = (turn(seed ^ k, 13) * 5 + 0xE6546B64) & 0xFFFFFFFF
    h ^= 4
    for s, m in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        h = (h ^ (h >> s)) * m & 0xFFFFFFFF
    h ^= h >> 16
    return h - 2**32 if h >= 2**31 else h


def spread(n: int, parts: int) -> np.ndarray:
    """n distinct 32-bit keys that Spark's hash partitioning deals evenly to ``parts`` partitions, in turn."""
    pools: list[list[int]] = [[] for _ in range(parts)]
    need, left, key = -(-n // parts), n, 0
    wanted = [need if i < n - (need - 1) * parts else need - 1 for i in range(parts)]
    while left:
        at = murmur_int(key) % parts
        if len(pools[at]) < wanted[at]:
            pools[at].append(key)
            left -= 1
        key += 1
    return np.array([pools[i % parts][i // parts] for i in range(n)], np.int32)


def tokenise_sliced(texts: pa.Array, symbols: bool = False, step: int = 1_000_000) -> tuple[np.ndarray, np.ndarray]:
    """``(hash, row)`` as from `tokenise`, in slices that bound its memory."""
    lengths = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    cuts = np.unique(np.concatenate([[0], np.flatnonzero(np.diff(np.cumsum(lengths) // step)) + 1, [len(texts)]])).astype(int)
    toks, rows = [], []
    for a, b in zip(cuts[:-1], cuts[1:]):
        tok, row, _, _ = tokenise(texts.slice(a, b - a), symbols)
        toks.append(tok)
        rows.append((row + a).astype(np.int32))
    if not toks:
        return np.zeros(0, np.uint64), np.zeros(0, np.int32)
    return np.concatenate(toks), np.concatenate(rows)
