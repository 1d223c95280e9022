"""Operator 6: benchmark decontamination with training suffix arrays.

Each task cuts its documents into shards and sorts all token suffixes of a shard, up to the
length of the longest test item: packed triples of token ranks first, then prefix doubling of
the suffixes that are still tied. Every suffix of every test item narrows an interval of the
array by binary search, one token at a time. From the intervals come all places that share at
least ``min_tokens`` tokens with an item (or the whole of a shorter one), and each is extended
to its longest verbatim match. Shards need no exchange; only matches leave them.

The test items go to the executors as packed arrays of about ``SLICE_TOKENS`` tokens, broadcast one by one; the driver holds one of them at a
time, and a worker too. Each shard's array is built once and meets all of them.

Nulls and ties: null and empty texts match nothing, and neither do null items. An item of fewer than ``min_tokens`` tokens matches where the whole of it
stands; those of fewer than ``least_item`` tokens (by default 1: none) are ignored. Per document and item the longest match is
given; of equal ones the first in the document, then the first in the item. Rows that repeat an
id count as one document in `matches`; `clean` judges each row by itself and returns it with all
its columns, whatever their names. Empty tables give no matches. Ids are integers (or text that reads as integers).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .packed import runs, starts
from .tokens import batches, column, tokenise_sliced

MIN_TOKENS, LEAST_ITEM = 10, 1
SHARD_BYTES, SLICE_TOKENS = 4_000_000, 2_000_000


class Shard:
    """The suffix array of some rows of tokens, sorted to ``depth`` tokens."""

    def __init__(self, tok: np.ndarray, row: np.ndarray, depth: int):
        self.words, ids = np.unique(tok, return_inverse=True)
        ids = ids.astype(np.int32)
        first = np.zeros(len(row), bool)
        begin = starts(row)
        first[begin] = True
        order = (np.cumsum(first) - 1).astype(np.int32)
        self.starts = (begin + np.arange(len(begin))).astype(np.int32)  # a 0 ends each row
        self.rows = row[begin]
        n = len(tok) + len(begin)
        self.seq = np.zeros(n + depth + 3, np.int32)
        place = np.arange(len(tok), dtype=np.int32) + order
        self.seq[place] = ids + 1
        self.owner = np.zeros(n + 1, np.int32)
        self.owner[place] = order
        self.array = self._sorted(place, n, depth) if len(tok) else place

    def _sorted(self, place: np.ndarray, n: int, depth: int) -> np.ndarray:
        s = self.seq
        h = 3 if len(self.words) < 2**21 - 1 else 2
        bits = 21 if h == 3 else 31
        key = s[place].astype(np.int64)
        gone = key == 0
        for k in range(1, h):
            nxt = s[place + k]
            gone |= nxt == 0
            key = (key << bits) | np.where(gone, 0, nxt)
        order = np.argsort(key, kind="stable")
        array, key = place[order], key[order]
        del order, gone
        end = np.zeros(n + 1, np.int32)
        end[place] = np.append(self.starts[1:], n)[self.owner[place]] - 1  # where the row's 0 is
        rank = np.zeros(n + depth + 3, np.int32)
        at, many = runs(key)
        rank[array] = np.repeat(at, many) + 1
        del key
        while h < depth:
            r = rank[array]
            tied = np.zeros(len(array), bool)
            same = r[1:] == r[:-1]
            tied[1:] |= same
            tied[:-1] |= same
            tied &= array + h <= end[array]  # else the rows have ended: equal for good
            slots = np.flatnonzero(tied)
            if not len(slots):
                break
            mine = array[slots]
            first, then = rank[mine], rank[mine + h]
            order = np.lexsort((then, first))
            mine, first, then = mine[order], first[order], then[order]
            array[slots] = mine
            at = starts(first, then)
            rank[mine] = np.repeat(slots[at], np.diff(np.append(at, len(mine)))) + 1
            h *= 2
        return array

    def find(self, tests: tuple[np.ndarray, np.ndarray], min_tokens: int) -> tuple[np.ndarray, ...]:
        """``(row, item, length, place in row, place in item)`` of all left-maximal matches."""
        none = tuple(np.zeros(0, np.int64) for _ in range(5))
        words, item = tests
        if not len(self.array) or not len(words):
            return none
        ids = np.searchsorted(self.words, words)
        ids[ids == len(self.words)] = 0
        ids = np.where(self.words[ids] == words, ids + 1, -1)
        first = np.concatenate([[True], item[1:] != item[:-1]])
        begin = np.flatnonzero(first)
        stop = np.append(begin[1:], len(item))[np.cumsum(first) - 1]
        begin = begin[np.cumsum(first) - 1]
        need = np.minimum(min_tokens, stop - begin)
        q = np.flatnonzero(stop - np.arange(len(item)) >= need)
        lo, hi = np.zeros(len(q), np.int64), np.full(len(q), len(self.array))
        hit_q, hit_p = [], []
        for k in range(int(need.max())):
            want = ids[q + k]
            left, right = self._bound(lo, hi, want, k, False), self._bound(lo, hi, want, k, True)
            full = (need[q] == k + 1) & (right > left)
            if full.any():
                width = (right - left)[full]
                hit_q.append(np.repeat(q[full], width))
                hit_p.append(self.array[np.repeat(left[full] - np.concatenate([[0], np.cumsum(width)[:-1]]), width) + np.arange(width.sum())])
            go = (right > left) & (need[q] > k + 1)
            q, lo, hi = q[go], left[go], right[go]
            if not len(q):
                break
        if not hit_q:
            return none
        q, p = np.concatenate(hit_q), np.concatenate(hit_p)
        inner = (q > begin[q]) & (p > 0)
        longer = np.zeros(len(q), bool)
        longer[inner] = ids[q[inner] - 1] == self.seq[p[inner] - 1]
        q, p = q[~longer], p[~longer]
        length = need[q].copy()
        live = np.arange(len(q))
        while len(live):
            live = live[q[live] + length[live] < stop[q[live]]]
            live = live[self.seq[p[live] + length[live]] == ids[q[live] + length[live]]]
            length[live] += 1
        own = self.owner[p]
        return self.rows[own], item[q], length, p - self.starts[own], q - begin[q]

    def _bound(self, lo: np.ndarray, hi: np.ndarray, want: np.ndarray, k: int, upper: bool) -> np.ndarray:
        lo, hi = lo.copy(), hi.copy()
        while True:
            open_ = lo < hi
            if not open_.any():
                return lo
            mid = (lo + hi) // 2
            seen = self.seq[self.array[np.minimum(mid, len(self.array) - 1)] + k]
            right = open_ & ((seen <= want) if upper else (seen < want))
            lo = np.where(right, mid + 1, lo)
            hi = np.where(open_ & ~right, mid, hi)


def _items(tests: DataFrame, id_col: str, text_col: str, least: int) -> tuple[list[Broadcast], int]:
    """Slices of ``(ids, tokens, item of each token)``, broadcast, and the tokens of the longest item."""
    spark = tests.sparkSession
    own = tests.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t")).filter("i is not null and t is not null")
    chars = own.agg(F.sum(F.length("t"))).first()[0] or 0
    slices = 1 + int(chars // (2 * SLICE_TOKENS))  # a token and what follows it have two characters, where it isn't of a script without blanks
    out, longest = [], 0
    for k in range(slices):
        got = own.filter((F.pmod(F.xxhash64("i"), F.lit(slices)) == k) if slices > 1 else F.lit(True)).orderBy("i", "t").toArrow()
        if not got.num_rows:
            continue
        tok, row = tokenise_sliced(column(got, "t"))
        many = np.bincount(row, minlength=got.num_rows)
        keep = many[row] >= max(1, least)
        if keep.any():
            out.append(spark.sparkContext.broadcast((column(got, "i").to_numpy(), tok[keep], row[keep].astype(np.int64))))
            longest = max(longest, int(many.max()))
    return out, longest


def _found(table: pa.Table, text: str, tests: list[Broadcast], longest: int, min_tokens: int) -> Iterator[tuple[np.ndarray, ...]]:
    """``(row, item's id, length, place in row, place in item)`` of a shard's matches, for each slice of the items."""
    tok, row = tokenise_sliced(column(table, text))
    shard = Shard(tok, row, longest)
    for one in tests:
        ids, words, item = one.value
        found = shard.find((words, item), min_tokens)
        yield found[0], ids[found[1]], *found[2:]
        if len(tests) > 1:
            one.__dict__.pop("_value", None)  # it can be read again


def _matches(parts: Iterator[pa.RecordBatch], tests: list[Broadcast], longest: int, min_tokens: int) -> Iterator[pa.RecordBatch]:
    for table in batches(parts, "t", SHARD_BYTES):
        for row, item, length, at, test_at in _found(table, "t", tests, longest, min_tokens):
            yield pa.RecordBatch.from_arrays([column(table, "id").take(pa.array(row, pa.int64())), *(pa.array(x.astype(np.int64)) for x in (item, length, at, test_at))], names=["doc_id", "item_id", "match_tokens", "doc_token", "item_token"])


def matches(docs: DataFrame, tests: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", min_tokens: int = MIN_TOKENS, least_item: int = LEAST_ITEM) -> DataFrame:
    """``(doc_id, item_id, match_tokens, doc_token, item_token)``: the longest verbatim match of each document with each item that it shares a passage with."""
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t")).filter("id is not null and t is not null")
    items, longest = _items(tests, item_col, item_text_col, least_item)
    found = own.mapInArrow(lambda x: _matches(x, items, longest, min_tokens), "doc_id long, item_id long, match_tokens long, doc_token long, item_token long")
    best = F.row_number().over(Window.partitionBy("doc_id", "item_id").orderBy(F.desc("match_tokens"), "doc_token", "item_token"))
    return found.withColumn("__place", best).filter("__place = 1").drop("__place")


def _unaffected(parts: Iterator[pa.RecordBatch], text: str, tests: list[Broadcast], longest: int, min_tokens: int) -> Iterator[pa.RecordBatch]:
    for table in batches(parts, text, SHARD_BYTES):
        keep = np.ones(table.num_rows, bool)
        for found in _found(table, text, tests, longest, min_tokens):
            keep[found[0]] = False
        yield from table.filter(pa.array(keep)).to_batches()


def clean(docs: DataFrame, tests: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", min_tokens: int = MIN_TOKENS, least_item: int = LEAST_ITEM) -> DataFrame:
    """The rows that share no passage with any item, with all their columns."""
    items, longest = _items(tests, item_col, item_text_col, least_item)
    return docs.mapInArrow(lambda x: _unaffected(x, text_col, items, longest, min_tokens), docs.schema) if items else docs
