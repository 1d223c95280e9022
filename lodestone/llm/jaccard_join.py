"""Operator 7: n-gram Jaccard join by vertical partitioning.

The global order of the n-grams (64-bit hashes) is cut into fragments. All exchanges are of packed arrays with few rows:

1. Each batch of documents sends every fragment the distinct n-grams that fall into it. The
   fragment finds how many records hold each n-gram; those of one record cannot add to an
   overlap and end here.
2. The shared n-grams return to their batch. Ordered from rare to frequent, a record whose
   prefix (size - ceil(t * size) + 1 n-grams) is unshared can have no partner; the others'
   shared n-grams go to fragments again, equal n-gram sets as one record.
3. Within a fragment, records that share a prefix n-gram become candidates. Each record knows in which fragments it has
   n-grams, so that a candidate goes only to those which both have.
4. Each fragment counts the candidates' partial overlaps by itself; the sum per pair is the
   exact overlap. Candidates travel in buckets, as lists of records and pairs of places in them, and only their counts come back.

5. A prefix n-gram of very many records lists no pairs, whose number grows with the square of theirs. Its records are a group
   (connected over all such n-grams), of which the whole n-gram sets are brought together and compared block by block. Each block
   returns counts, a forest of links and only those pairs that are asked for. Pairs from 3 within one group are left to it.

Nothing is capped: hot n-grams stand at the end of the order and outside nearly all prefixes,
and copies collapse into one record. The join is by default returned as one row per document, with its class and its number of
links: a thousand copies are a thousand rows, not half a million. `all_pairs` gives the pairs themselves. An n-gram set is known by the 64-bit sum of its
mixed n-grams: of 10^9 different sets two agree with odds of 1 in 37.

Nulls and ties: a null id takes no part; a null or empty text, or one without a token, has no
n-gram and no partner: its class is its own id. A text with fewer than n tokens has one n-gram of them all. Rows that repeat
an id are one document, similar to whatever any of its rows is similar to; it has one row in the result and isn't a link of itself. A class is a
connected group of similar documents, named by its smallest id. Other columns are ignored, whatever their names. An empty table gives no rows.
Ids are integers (or text that reads as integers).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scratch
from .packed import cells, loose, narrow, rows, runs, squeeze, starts
from .tokens import batches, column, grams, mix, spread, tokenise_sliced, trimmed

N, THRESHOLD = 3, 0.5
BATCH_BYTES = 5_000_000
#: Incidences that a fragment looks at together; larger ones are taken in slices.
SLICE = 1_000_000
#: Ids up to this number (4 MB) are sent to all executors when documents are dropped; beyond it they are joined by a shuffle.
BROADCAST_IDS = 500_000
#: Fragments of the second exchange are larger, as about one n-gram in six is left.
COARSER = 4
#: Links up to this number are followed in one task; beyond it in rounds over all executors, with the same result.
FEW_LINKS = 1_000_000

#: A prefix n-gram of more records than this makes their group instead of pairs; so do, in a slice of a fragment, the longest lists beyond so many pairs.
HOT, MOST_PAIRS = 200, 2_000_000
#: N-grams and records in a block of a group.
BLOCK_GRAMS, BLOCK_RECORDS = 500_000, 2_000
#: Candidates that a fragment looks at together: nearly every fragment sees nearly all candidates of the table.
TOGETHER = 300_000

#: Rows go to Python workers and back in batches of this size; a group has several. Larger ones are held several times, on both sides.
_SENT_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "4m"

PACKED = "frag int, uid long, kind int, a binary, b binary, c binary"
_PACKED = pa.schema([("frag", pa.int32()), ("uid", pa.int64()), ("kind", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())])


def _needed(size: np.ndarray, t: float) -> np.ndarray:
    return np.ceil(t * size - 1e-9).astype(np.int64)


def _fragment(g: np.ndarray, frags: int) -> np.ndarray:
    """The fragment of each n-gram: the order is cut by the hashes' first 24 bits."""
    return (((g >> np.uint64(40)) * np.uint64(frags)) >> np.uint64(24)).astype(np.int64)


def _send(parts: Iterator[pa.RecordBatch], n: int, frags: int, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
    task = TaskContext.get().partitionId()
    for seq, table in enumerate(batches(parts, "t", BATCH_BYTES)):
        yield _sent(table, task * 1_000_003 + seq, n, frags, keys)


def _sent(table: pa.Table, place: int, n: int, frags: int, keys: np.ndarray) -> pa.RecordBatch:
    g, d = grams(*tokenise_sliced(column(table, "t")), n)
    order = np.argsort(g, kind="stable")
    g, d = g[order], d[order]
    del order
    at = starts(g, d)
    g, d = g[at], d[at]
    ids = column(table, "id").to_numpy(zero_copy_only=False).astype(np.int64)
    sig = np.zeros(len(ids), np.uint64)
    np.add.at(sig, d, mix(g + np.uint64(1)))
    size = np.bincount(d, minlength=len(ids)).astype(np.int32)
    uid = int(mix(np.array([place], np.uint64) ^ np.add.reduce(sig * np.arange(1, 2 * len(sig), 2, dtype=np.uint64)))[0].astype(np.int64))
    d, part = narrow(d, len(ids)), _fragment(g, frags)
    at, many = runs(part)
    out = [(int(keys[uid % frags]), uid, 0, ids.tobytes(), sig.tobytes(), size.tobytes())]
    out += [(int(keys[part[x]]), uid, 1, squeeze(d[x : x + k]), squeeze(g[x : x + k], True), np.array([part[x], d.itemsize], np.int32).tobytes()) for x, k in zip(at, many)]
    return rows(out, _PACKED)


def _by_kind(table: pa.Table, kind: int) -> pa.Table:
    return table.filter(pc.equal(table.column("kind"), kind))


def _shared(table: pa.Table) -> pa.Table:
    """One fragment: the n-grams of two records or more, back to the batches."""
    heads, table = _by_kind(table, 0), _by_kind(table, 1)
    out = [(0, uid, 0, a, b, c) for uid, a, b, c in zip(heads.column("uid").to_pylist(), *(cells(heads, x) for x in "abc"))]
    if table.num_rows:
        uids, about = table.column("uid").to_pylist(), [np.frombuffer(c, np.int32) for c in cells(table, "c")]
        gs = [loose(b, np.uint64, True) for b in cells(table, "b")]
        src = np.repeat(np.arange(len(gs), dtype=np.int32), [len(x) for x in gs])
        g = np.concatenate(gs)
        del gs
        order = np.argsort(g, kind="stable")
        _, many = runs(g[order])
        df = np.zeros(len(g), np.int32)
        df[order] = np.repeat(many, many)
        del order, many
        d = np.concatenate([loose(a, np.uint16 if c[1] == 2 else np.uint32).astype(np.uint32) for a, c in zip(cells(table, "a"), about)])
        keep = df > 1
        g, d, src, df = g[keep], d[keep], src[keep], df[keep]
        rank = np.minimum(255, 8 * np.log2(df)).astype(np.uint8)
        frag = int(about[0][0])
        at, many = runs(src)
        out += [(frag, uids[src[x]], 1, squeeze(d[x : x + k]), squeeze(g[x : x + k], True), squeeze(rank[x : x + k])) for x, k in zip(at, many)]
    return pa.Table.from_batches([rows(out, _PACKED)])


def _bits(part: np.ndarray, coarse: int) -> np.ndarray:
    """The bit that stands for a fragment in a record's map of 64."""
    return part * 64 // max(64, coarse)


def _active(table: pa.Table, t: float, coarse: int, keys: np.ndarray) -> pa.Table:
    """One batch: its records (kind 0), prefix n-grams (1) and all shared n-grams (2) of records that may have a partner."""
    head, table = _by_kind(table, 0), _by_kind(table, 1)
    if head.num_rows != 1:
        raise ValueError("a batch of documents changed while it was read; write the input to a table first")
    uid, ids, sig, size = head.column("uid")[0].as_py(), cells(head, "a")[0], np.frombuffer(cells(head, "b")[0], np.uint64), np.frombuffer(cells(head, "c")[0], np.int32)
    out = [(-1, uid, 0, ids, sig.tobytes(), size.tobytes())]
    if table.num_rows:
        d = np.concatenate([loose(x, np.uint32) for x in cells(table, "a")])
        lead = np.zeros(len(sig), bool)
        lead[np.unique(sig, return_index=True)[1]] = True
        keep = lead[d]
        d, g = d[keep].astype(np.int32), np.concatenate([loose(x, np.uint64, True) for x in cells(table, "b")])[keep]
        rank = np.concatenate([loose(x, np.uint8) for x in cells(table, "c")])[keep]
        order = np.lexsort((g, rank, d))
        d, g = d[order], g[order]
        del order, rank, keep
        at, many = runs(d)
        place = np.arange(len(d)) - np.repeat(at, many) + np.repeat(size[d[at]] - many, many)
        prefix = place < (size[d] - _needed(size[d], t) + 1)
        active = np.zeros(len(sig), bool)
        active[d[prefix]] = True
        keep = active[d]
        d, g, prefix = d[keep], g[keep], prefix[keep]
        order = np.argsort(g, kind="stable")
        d, g, prefix = d[order], g[order], prefix[order]
        part = _fragment(g, coarse)
        held = np.zeros(len(sig), np.uint64)
        np.bitwise_or.at(held, d, np.uint64(1) << _bits(part, coarse).astype(np.uint64))
        cut = np.searchsorted(part, np.arange(coarse + 1))
        for f in np.flatnonzero(np.diff(cut)):
            own = slice(cut[f], cut[f + 1])
            for kind, x, y in ((1, d[own][prefix[own]], g[own][prefix[own]]), (2, d[own], g[own])):
                if len(x):
                    recs, local = np.unique(x, return_inverse=True)
                    out.append((int(keys[f]), uid, kind, np.concatenate([sig[recs], size[recs].astype(np.uint64), held[recs]]).tobytes(), squeeze(y, True), squeeze(local.astype(np.uint32))))
    return pa.Table.from_batches([rows(out, _PACKED)])


class _Records:
    """A fragment's records, in order of signature, and its n-grams."""

    def __init__(self, table: pa.Table):
        heads = [np.frombuffer(x, np.uint64).reshape(3, -1) for x in cells(table, "a")]
        self.sig, first = np.unique(np.concatenate([h[0] for h in heads]), return_index=True)
        self.size = np.concatenate([h[1] for h in heads])[first].astype(np.int64)
        self.held = np.concatenate([h[2] for h in heads])[first]
        self.places = [np.searchsorted(self.sig, h[0]).astype(np.int32) for h in heads]
        self.table = table

    def slices(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Distinct ``(n-gram, record)`` in order of n-gram, a slice of the n-grams at a time."""
        gs = [loose(x, np.uint64, True) for x in cells(self.table, "b")]
        recs = [place[loose(x, np.uint32)] for place, x in zip(self.places, cells(self.table, "c"))]
        g, rec = np.concatenate(gs), np.concatenate(recs)
        del gs, recs
        count = max(1, -(-len(g) // SLICE))
        for k in range(count):
            mine = np.flatnonzero(g % np.uint64(count) == k) if count > 1 else slice(None)
            x, y = g[mine], rec[mine]
            order = np.lexsort((y, x))
            x, y = x[order], y[order]
            at = starts(x, y)
            yield x[at], y[at]


_PAIRS = pa.schema([("frag", pa.int32()), ("bucket", pa.int64()), ("kind", pa.int32()), *((n, pa.binary()) for n in ("sig", "size", "held", "x", "y"))])
PAIRS = "frag int, bucket long, kind int, sig binary, size binary, held binary, x binary, y binary"


def _listed(frag: int, bucket: int, kind: int, sig: np.ndarray, size: np.ndarray, held: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple:
    """One packed row of pairs, in order of x and y: their records once each, and the pairs as places among these."""
    some, at = np.unique(np.concatenate([x, y]), return_inverse=True)
    order = np.lexsort((at[len(x) :], at[: len(x)]))
    x, y = at[: len(x)][order], at[len(x) :][order]
    return frag, bucket, kind, squeeze(sig[some], True), squeeze(size[some].astype(np.uint32)), squeeze(held[some]), squeeze(x.astype(np.uint32), True), squeeze(y.astype(np.uint32))


class _Listed:
    """Such a row, read."""

    def __init__(self, sig: pa.Buffer, size: pa.Buffer, held: pa.Buffer, x: pa.Buffer, y: pa.Buffer):
        self.sig, self.size, self.held = loose(sig, np.uint64, True), loose(size, np.uint32).astype(np.int64), loose(held, np.uint64)
        self.x, self.y = loose(x, np.uint32, True), loose(y, np.uint32)


def _few(table: pa.Table, most: int) -> Iterator[tuple[int, list[_Listed]]]:
    """The rows in turn, as many together as reach ``most`` pairs; each time with the number of the first."""
    held, first, count = [], 0, 0
    for k, x in enumerate(zip(*(cells(table, n) for n in ("sig", "size", "held", "x", "y")))):
        held.append(_Listed(*x))
        count += len(held[-1].x)
        if count >= most:
            yield first, held
            held, first, count = [], k + 1, 0
    if held:
        yield first, held


def _lists(table: pa.Table) -> list[_Listed]:
    return [_Listed(*x) for x in zip(*(cells(table, n) for n in ("sig", "size", "held", "x", "y")))]


def _longest(many: np.ndarray, hot: int, most: int) -> int:
    """The length up to which lists of records make pairs: at most ``hot``, and less where the pairs were more than ``most``."""
    by = np.sort(many).astype(np.int64)
    beyond = np.cumsum(by * (by - 1) // 2) > most
    return min(hot, int(by[np.argmax(beyond)]) - 1) if beyond.any() else hot


def _candidates(table: pa.Table, t: float, keys: np.ndarray, hot: int = 2**62, most: int = 2**62) -> pa.Table:
    """The pairs of records that share a prefix n-gram and whose sizes allow enough overlap, in buckets by their first record (kind 0).

    Lists that are too long for pairs give links of their records to their first one instead (kind 2).
    """
    own = _Records(table)
    size, total = own.size, len(own.sig)
    found: list[np.ndarray] = []
    linked: list[np.ndarray] = []
    for g, rec in own.slices():
        at, many = runs(g)
        longest = _longest(many, hot, most)
        long = np.repeat(many > longest, many)
        linked.append(np.unique(rec[np.repeat(at, many)[long]].astype(np.int64) * total + rec[long]))
        keep = np.repeat((many > 1) & (many <= longest), many)  # n-grams of one record make no pair
        begin = np.repeat(at + many, many)[keep]  # where each posting's list ends
        place = np.flatnonzero(keep)
        order = np.argsort(rec[keep], kind="stable")
        place, begin = place[order], begin[order]
        width = begin - place - 1  # the records behind it in the list, all of higher number
        who = rec[place]
        heads, lots = runs(who)
        reach = np.cumsum(width)
        mark = np.zeros(total, bool)
        i = 0
        while i < len(heads):
            base = reach[heads[i] - 1] if heads[i] else 0
            ends = heads + lots - 1
            j = max(i + 1, int(np.searchsorted(reach[ends], base + 200_000, "right")))
            some = slice(heads[i], ends[j - 1] + 1)
            w = width[some]
            hits = rec[np.repeat(place[some] + 1 - np.concatenate([[0], np.cumsum(w)[:-1]]), w) + np.arange(w.sum())]
            if j == i + 1:  # one record with many partners
                mark[hits] = True
                y = np.flatnonzero(mark)
                mark[y] = False
                x = np.full(len(y), who[heads[i]], np.int64)
            else:
                code = np.unique(np.repeat(who[some], w).astype(np.int64) * total + hits)
                x, y = code // total, code % total
            ok = np.minimum(size[x], size[y]) >= t * np.maximum(size[x], size[y]) - 1e-9
            found.append(x[ok] * total + y[ok])
            i = j
    pairs = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    x, y = pairs // max(total, 1), pairs % max(total, 1)
    part = _fragment(mix(own.sig[x]), len(keys))
    order = np.argsort(part, kind="stable")
    x, y = x[order], y[order]
    out = [_listed(int(keys[part[order[at]]]), int(part[order[at]]), 0, own.sig, size, own.held, x[at : at + k], y[at : at + k]) for at, k in zip(*runs(part[order]))]
    links = np.unique(np.concatenate(linked)) if linked else np.zeros(0, np.int64)
    if len(links):
        out.append(_listed(-1, -1, 2, own.sig, size, own.held, links // total, links % total))
    return pa.Table.from_batches([rows(out, _PAIRS)])


def _hot_forest(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """`_forest` of a task's packed links, in the same worker: a second function over its rows would take a Python worker more for each task."""
    lists = (a for part in parts for a in _lists(pa.Table.from_batches([part])))
    yield from _forest(pa.RecordBatch.from_arrays([pa.array(a.sig[a.x].view(np.int64)), pa.array(a.sig[a.y].view(np.int64))], names=["u", "v"]) for a in lists)


_BLOCK = pa.schema([("head", pa.int64()), ("block", pa.int64()), *((n, pa.binary()) for n in ("sig", "size", "single", "mark", "many", "g"))])
BLOCK = "head long, block long, sig binary, size binary, single binary, mark binary, many binary, g binary"


def _whole(segments: pa.Table, wanted: pa.Table) -> pa.Table:
    """The whole sets of shared n-grams of a batch's records that are in groups, by blocks."""
    if not wanted.num_rows or not segments.num_rows:
        return _BLOCK.empty_table()
    own, col = _Records(segments), {n: column(wanted, n).to_numpy(zero_copy_only=False) for n in ("sig", "head", "block", "size", "single", "mark")}
    order = np.lexsort((col["sig"], col["block"], col["head"]))
    col = {n: x[order] for n, x in col.items()}
    at = np.searchsorted(own.sig, col["sig"].view(np.uint64))
    if (own.sig[np.minimum(at, len(own.sig) - 1)] != col["sig"].view(np.uint64)).any():
        raise ValueError("a record of a group is missing from its batch")
    place = np.full(len(own.sig), -1, np.int32)
    place[at] = np.arange(len(at))
    gs, recs = [], []
    for g, rec in own.slices():
        mine = place[rec] >= 0
        gs.append(g[mine])
        recs.append(place[rec[mine]])
    g, rec = np.concatenate(gs), np.concatenate(recs)
    order = np.lexsort((g, rec))
    g, many = g[order], np.bincount(rec, minlength=len(at))
    ends, out = np.concatenate([[0], np.cumsum(many)]), []
    new = starts(col["head"], col["block"])
    for i, j in zip(new, np.append(new[1:], len(at))):
        out.append((int(col["head"][i]), int(col["block"][i]), *(col[n][i:j].astype(k).tobytes() for n, k in (("sig", np.int64), ("size", np.int64), ("single", np.int64), ("mark", bool))), many[i:j].astype(np.int64).tobytes(), squeeze(g[ends[i] : ends[j]], True)))
    return pa.Table.from_batches([rows(out, _BLOCK)])


class _Block:
    """A block's records and their n-grams."""

    def __init__(self, table: pa.Table):
        self.sig, self.size, self.single, self.mark, many = (np.concatenate([np.frombuffer(x, k) for x in cells(table, n)]) for n, k in (("sig", np.int64), ("size", np.int64), ("single", np.int64), ("mark", bool), ("many", np.int64)))
        self.g = np.concatenate([loose(x, np.uint64, True) for x in cells(table, "g")])
        self.rec = np.repeat(np.arange(len(many), dtype=np.int32), many)


def _common(a: _Block, b: _Block) -> np.ndarray:
    """The number of n-grams that each record of a shares with each of b."""
    high, wide = len(a.sig), len(b.sig)
    known = np.intersect1d(a.g, b.g)
    total = np.zeros((high, wide), np.int32)
    if not len(known):
        return total

    def sorted_by(x: _Block) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(known, x.g), len(known) - 1)
        some = np.flatnonzero(known[at] == x.g)
        some = some[np.argsort(at[some], kind="stable")]
        return at[some], x.rec[some]

    (ga, ra), (gb, rb) = sorted_by(a), sorted_by(b)
    na, nb = np.bincount(ga, minlength=len(known)), np.bincount(gb, minlength=len(known))
    full = na * nb * 32 > high * wide  # by a product of matrices, the others pair by pair
    number = np.cumsum(full) - 1
    pa_, pb_ = full[ga], full[gb]
    fa, fb = (number[ga[pa_]], ra[pa_]), (number[gb[pb_]], rb[pb_])
    for k in range(0, int(full.sum()), 512):
        sides = []
        for (n, r), count in ((fa, high), (fb, wide)):
            i, j = np.searchsorted(n, [k, k + 512])
            m = np.zeros((count, 512), np.float32)
            m[r[i:j], n[i:j] - k] = 1
            sides.append(m)
        total += (sides[0] @ sides[1].T).astype(np.int32)
    begin = (np.cumsum(nb) - nb)[ga[~pa_]]
    width, ra = nb[ga[~pa_]], ra[~pa_]
    reach, i = np.cumsum(width), 0
    while i < len(width):
        j = max(i + 1, int(np.searchsorted(reach, (reach[i - 1] if i else 0) + 1_000_000, "right")))
        w = width[i:j]
        hits = rb[np.repeat(begin[i:j] - np.cumsum(w) + w, w) + np.arange(w.sum())]
        total += np.bincount(np.repeat(ra[i:j], w).astype(np.int64) * wide + hits, minlength=high * wide).reshape(high, wide).astype(np.int32)
        i = j
    return total


def _joined(near: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``near`` links rows with columns: the linked rows and columns, and for each the first row of what is connected with it."""
    top, side = np.full(near.shape[0], -1), np.full(near.shape[1], -1)
    left = near.any(1)
    while left.any():
        root = int(np.argmax(left))
        some = np.array([root])
        while len(some):
            top[some], left[some] = root, False
            cols = np.flatnonzero(near[some].any(0) & (side < 0))
            side[cols] = root
            some = np.flatnonzero(near[:, cols].any(1) & left)
    x, y = np.flatnonzero(top >= 0), np.flatnonzero(side >= 0)
    return x, top[x], y, side[y]


_DENSE = pa.schema([("kind", pa.int32()), ("x", pa.int64()), ("y", pa.int64()), ("n", pa.int64()), ("j", pa.float64())])
DENSE = "kind int, x long, y long, n long, j double"


def _compared(table: pa.Table, t: float, every: bool) -> pa.Table:
    """Two blocks of a group, or one with itself: each record's similar documents (kind 0), links that connect what is similar (1), and the pairs of marked records or all (2)."""
    a = _Block(table.filter(pc.equal(table.column("side"), 0)))
    same = table.column("p")[0].as_py() == table.column("q")[0].as_py()
    b = a if same else _Block(table.filter(pc.equal(table.column("side"), 1)))
    total = _common(a, b)
    near = total / (a.size[:, None] + b.size[None, :] - total) >= t
    if same:
        np.fill_diagonal(near, False)
    x, top, y, side = _joined(near)
    u, v = np.concatenate([a.sig[top], a.sig[side]]), np.concatenate([a.sig[x], b.sig[y]])
    u, v = u[u != v], v[u != v]
    sig, count = (a.sig[x], near[x] @ b.single) if same else (np.concatenate([a.sig[x], b.sig[y]]), np.concatenate([near[x] @ b.single, a.single @ near[:, y]]))
    p, q = np.nonzero(near if every else near & (a.mark[:, None] | b.mark[None, :]))
    if same:
        p, q = p[p < q], q[p < q]
    j = total[p, q] / (a.size[p] + b.size[q] - total[p, q])
    kinds = np.repeat(np.arange(3, dtype=np.int32), [len(sig), len(u), len(p)])
    out = pa.table({"kind": kinds, "x": np.concatenate([sig, u, a.sig[p]]), "y": np.concatenate([sig, v, b.sig[q]]), "n": np.concatenate([count, np.zeros(len(u) + len(p), np.int64)]), "j": np.concatenate([np.zeros(len(sig) + len(u)), j])}, schema=_DENSE)
    return pa.Table.from_batches(out.to_batches(100_000), _DENSE)


def _spread_pairs(table: pa.Table, coarse: int, keys: np.ndarray) -> pa.Table:
    """One bucket's distinct pairs (kind 0), and for each fragment those of which both records have n-grams there (kind 1)."""
    lists, bucket = _lists(table), table.column("bucket")[0].as_py()
    sig, first = np.unique(np.concatenate([a.sig for a in lists]), return_index=True)
    size, held = np.concatenate([a.size for a in lists])[first], np.concatenate([a.held for a in lists])[first]
    code = np.unique(np.concatenate([np.searchsorted(sig, a.sig[a.x]).astype(np.int64) * len(sig) + np.searchsorted(sig, a.sig[a.y]) for a in lists]))
    x, y = code // len(sig), code % len(sig)
    both = held[x] & held[y]
    out = [_listed(-1, bucket, 0, sig, size, held, x, y)]
    for f in range(coarse):
        mine = np.flatnonzero((both >> np.uint64(_bits(np.int64(f), coarse))) & np.uint64(1))
        if len(mine):
            out.append(_listed(int(keys[f]), bucket, 1, sig, size, held, x[mine], y[mine]))
    return pa.Table.from_batches([rows(out, _PAIRS)])


_COUNTS = pa.schema([("bucket", pa.int64()), ("frag", pa.int32()), ("shared", pa.binary())])
COUNTS = "bucket long, frag int, shared binary"


def _partial(g: np.ndarray, cut: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many of the n-grams ``g``, cut by records, each x shares with its y."""
    order = np.lexsort((y, x))
    x, y = x[order], y[order]
    found = np.zeros(len(x), np.int32)
    width, seen = np.diff(cut), np.zeros(int(g.max()) + 1 if len(g) else 1, bool)
    for s, k in zip(*runs(x)):  # one record against all its partners
        one = g[cut[x[s]] : cut[x[s] + 1]]
        if not len(one):
            continue
        seen[one] = True
        for i in range(s, s + k, 1000):
            part = y[i : min(i + 1000, s + k)]
            w = width[part]
            ends = np.cumsum(w)
            where = np.repeat(cut[part] - ends + w, w) + np.arange(ends[-1])
            sums = np.concatenate([[0], np.cumsum(seen[g[where]])])
            found[i : i + len(part)] += (sums[ends] - sums[ends - w]).astype(np.int32)
        seen[one] = False
    shared = np.empty_like(found)
    shared[order] = found
    return shared


def _overlaps(segments: pa.Table, wanted: pa.Table, places: dict[int, int]) -> pa.Table:
    """Partial overlaps of the candidates, from one fragment alone, in the order of each bucket's row."""
    if not segments.num_rows or not wanted.num_rows:
        return _COUNTS.empty_table()
    own, found = _Records(segments), {}
    for g, rec in own.slices():
        by = np.argsort(rec, kind="stable")
        rec, g = rec[by], np.unique(g, return_inverse=True)[1][by].astype(np.int32)
        cut = np.searchsorted(rec, np.arange(len(own.sig) + 1))
        for first, lists in _few(wanted, TOGETHER):
            x, y = (np.concatenate([np.searchsorted(own.sig, a.sig)[getattr(a, n)] for a in lists]).astype(np.int32) for n in "xy")
            found[first] = found.get(first, 0) + _partial(g, cut, x, y)
    shared: list[bytes] = []
    for first, lists in _few(wanted, TOGETHER):
        shared += [squeeze(x.astype(np.uint32)) for x in np.split(found.pop(first), np.cumsum([len(a.x) for a in lists])[:-1])]
    frag = places[segments.column("frag")[0].as_py()]
    return pa.Table.from_batches([rows([(b, frag, x) for b, x in zip(wanted.column("bucket").to_pylist(), shared)], _COUNTS)])


_CLOSE = pa.schema([("x", pa.int64()), ("y", pa.int64()), ("j", pa.float64())])


def _summed(pairs: pa.Table, counts: pa.Table, t: float, coarse: int) -> pa.Table:
    """One bucket's pairs with enough overlap in all fragments together."""
    if not pairs.num_rows:
        return _CLOSE.empty_table()
    (own,) = _lists(pairs)
    both, total = own.held[own.x] & own.held[own.y], np.zeros(len(own.x), np.int64)
    for f, shared in zip(counts.column("frag").to_pylist(), cells(counts, "shared")):
        total[((both >> np.uint64(_bits(np.int64(f), coarse))) & np.uint64(1)).astype(bool)] += loose(shared, np.uint32)
    j = total / (own.size[own.x] + own.size[own.y] - total)
    near = np.flatnonzero(j >= t)
    return pa.table({"x": own.sig[own.x[near]].view(np.int64), "y": own.sig[own.y[near]].view(np.int64), "j": j[near]}, schema=_CLOSE)


def _members(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        for a, b, c in zip(*(part.column(k).to_pylist() for k in ("a", "b", "c"))):
            size = np.frombuffer(c, np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(a, np.int64)), pa.array(np.frombuffer(b, np.int64)), pa.array(size)], names=["id", "sig", "size"])


def _places(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        for uid, b, c in zip(*(part.column(k).to_pylist() for k in ("uid", "b", "c"))):
            size = np.frombuffer(c, np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(size), uid, np.int64)), pa.array(np.frombuffer(b, np.int64)), pa.array(size)], names=["uid", "sig", "size"])


def _dense(active: DataFrame, grouped: DataFrame, ids: DataFrame | None, members: DataFrame, t: float, frags: int, every: bool) -> DataFrame:
    """The groups ``(sig, head)`` compared, see `_compared`. Blocks are in order of size, and two are only met where their sizes allow enough overlap."""
    own = active.filter("kind = 0").mapInArrow(_places, "uid long, sig long, size int").join(grouped, "sig").groupBy("sig", "head").agg(F.min("uid").alias("uid"), F.max("size").cast("long").alias("size"))
    none = own.select("*", F.lit(0).cast("long").alias("single"), F.lit(False).alias("mark"))
    if ids is not None:
        single = ids.filter("sets = 1").groupBy("sig").agg(F.count("*").alias("single"))
        marked = ids.filter("sets > 1").select("id").join(members.filter("size > 0"), "id").select("sig", F.lit(True).alias("mark")).distinct()
        none = own.join(single, "sig", "left").join(marked, "sig", "left").select(*own.columns, F.coalesce("single", F.lit(0)).cast("long").alias("single"), F.coalesce("mark", F.lit(False)).alias("mark"))
    weight = F.greatest("size", F.lit(BLOCK_GRAMS // BLOCK_RECORDS))
    before = F.sum(weight).over(Window.partitionBy("head").orderBy("size", "sig").rowsBetween(Window.unboundedPreceding, 0)) - weight
    placed = scratch.written(none.withColumn("block", F.floor(before / BLOCK_GRAMS).cast("long")), "placed")
    blocks = scratch.written(active.filter("kind = 2").select("uid", "a", "b", "c").groupBy("uid").cogroup(placed.groupBy("uid")).applyInArrow(trimmed(_whole), BLOCK), "blocks")
    spans = placed.groupBy("head", "block").agg(F.min("size").alias("low"), F.max("size").alias("high"))
    first, second = spans.select("head", F.col("block").alias("p"), F.col("high")), spans.select("head", F.col("block").alias("q"), F.col("low"))
    items = scratch.written(first.join(second, "head").filter((F.col("p") <= F.col("q")) & (F.col("low") * t <= F.col("high") + 1e-6)).select("head", "p", "q"), "items")
    left = blocks.join(items.withColumn("block", F.col("p")), ["head", "block"]).withColumn("side", F.lit(0))
    right = blocks.join(items.filter("p < q").withColumn("block", F.col("q")), ["head", "block"]).withColumn("side", F.lit(1))
    work = left.unionByName(right).repartition(frags, "head", "p", "q").groupBy("head", "p", "q").applyInArrow(trimmed(lambda x: _compared(x, t, every)), DENSE)
    return scratch.written(work, "dense", placed, blocks, items)


def _in_small_batches(f: Callable) -> Callable:
    @wraps(f)
    def run(docs: DataFrame, *args: object, **kw: object) -> object:
        with scratch.setting(docs.sparkSession, *_SENT_BYTES):
            return f(docs, *args, **kw)

    return run


@_in_small_batches
def _sets(docs: DataFrame, id_col: str, text_col: str, n: int, threshold: float, links: bool = False, every: bool = False) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame | None]:
    """The ids of each n-gram set, ``(id, sig, size)``, the similar pairs of different sets that are in no group together, ``(x, y, j)``, what `_compared` says of the groups, and with ``links`` the ids' sets; all are scratch tables."""
    spark = docs.sparkSession
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be above 0 and at most 1")
    frags = scratch.shuffle_partitions(spark)
    coarse = -(-frags // COARSER)
    keys, coarse_keys = spread(frags, frags), spread(coarse, coarse)
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t")).filter("id is not null").withColumn("t", F.coalesce("t", F.lit("")))
    sent = own.mapInArrow(lambda parts: _send(parts, n, frags, keys), PACKED)
    shared = sent.repartition(frags, "frag").groupBy("frag").applyInArrow(trimmed(_shared), PACKED)
    active = scratch.written(shared.groupBy("uid").applyInArrow(trimmed(lambda x: _active(x, threshold, coarse, coarse_keys)), PACKED), "active")
    members = scratch.written(active.filter("kind = 0").mapInArrow(_members, "id long, sig long, size int").distinct(), "members")
    hot, most = HOT, MOST_PAIRS
    wanted = active.filter("kind = 1").repartition(coarse, "frag").groupBy("frag").applyInArrow(trimmed(lambda x: _candidates(x, threshold, keys, hot, most)), PAIRS)
    wanted = scratch.written(wanted, "candidates")
    heads = _followed(wanted.filter("kind = 2").mapInArrow(_hot_forest, "u long, v long"), FEW_LINKS)
    grouped = scratch.written(heads.toDF("sig", "head").unionByName(heads.select(F.col("head").alias("sig"), "head").distinct()), "grouped", heads)
    some = not grouped.isEmpty()
    ids = scratch.written(members.groupBy("id").agg(F.count_if(F.col("size") > 0).alias("sets"), F.max_by("sig", "size").alias("sig")), "ids") if links else None
    dense = _dense(active, grouped, ids, members, threshold, frags, every) if some else spark.range(0).selectExpr("int(id) as kind", "id as x", "id as y", "id as n", "double(id) as j")  # createDataFrame would start Python workers of another kind
    spread_out = wanted.filter("kind = 0").repartition(frags, "frag").groupBy("frag").applyInArrow(trimmed(lambda x: _spread_pairs(x, coarse, coarse_keys)), PAIRS)
    listed = scratch.written(spread_out, "pairs", wanted)
    places = {int(k): f for f, k in enumerate(coarse_keys)}
    counted = (
        active.filter("kind = 2").repartition(coarse, "frag").groupBy("frag")
        .cogroup(listed.filter("kind = 1").repartition(coarse, "frag").groupBy("frag"))
        .applyInArrow(trimmed(lambda x, y: _overlaps(x, y, places)), COUNTS)
    )
    close = listed.filter("kind = 0").groupBy("bucket").cogroup(counted.groupBy("bucket")).applyInArrow(trimmed(lambda x, y: _summed(x, y, threshold, coarse)), "x long, y long, j double")
    if some:
        x, y = grouped.toDF("x", "head_x"), grouped.toDF("y", "head_y")
        close = close.join(x, "x", "left").join(y, "y", "left").filter("not (head_x <=> head_y) or head_x is null").select("x", "y", "j")
    return members, scratch.written(close, "close", active, listed, grouped), dense, ids


def all_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_a, doc_b, jaccard)`` with doc_a < doc_b: every two documents with at least the threshold. Copies give as many rows as they have pairs."""
    members, close, dense, _ = _sets(docs, id_col, text_col, n, threshold, every=True)
    close = close.unionByName(dense.filter("kind = 2").select("x", "y", "j"))
    own = members.filter("size > 0").select("id", "sig")
    left, right = own.select(F.col("sig").alias("x"), F.col("id").alias("p")), own.select(F.col("sig").alias("y"), F.col("id").alias("q"))
    copies = left.join(right.withColumnRenamed("y", "x"), "x").filter("p < q").select("p", "q", F.lit(1.0).alias("j"))
    near = close.join(left, "x").join(right, "y").filter("p <> q").select("p", "q", "j")
    both = near.unionByName(copies)
    return both.groupBy(F.least("p", "q").alias("doc_a"), F.greatest("p", "q").alias("doc_b")).agg(F.max("j").alias("jaccard"))


def _heads(members: DataFrame, close: DataFrame, dense: DataFrame) -> DataFrame:
    """``(id, class_id)`` of the ids that aren't the smallest of their class."""
    own = members.filter("size > 0").select("id", "sig")
    leads = scratch.written(own.groupBy("sig").agg(F.min("id").alias("lead")), "leads")
    to = own.join(leads, "sig").filter("id <> lead").select(F.col("id").alias("doc_a"), F.col("lead").alias("doc_b"))
    near = close.select("x", "y").unionByName(dense.filter("kind = 1").select("x", "y")).join(leads.toDF("x", "doc_a"), "x").join(leads.toDF("y", "doc_b"), "y").select("doc_a", "doc_b")
    out = groups(near.unionByName(to))
    scratch.forget(leads)
    return out.withColumnRenamed("head", "class_id")


def similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, class_id, links)`` of every id: the smallest id of its group, and the number of other documents with similarity of at least the threshold."""
    members, close, dense, ids = _sets(docs, id_col, text_col, n, threshold, links=True)
    heads = _heads(members, close, dense)
    # sets by the ids that have no other; an id of several sets is looked at by itself
    sizes = ids.filter("sets = 1").groupBy("sig").agg(F.count("*").alias("single"))
    ways = close.select("x", "y").unionByName(close.select(F.col("y").alias("x"), F.col("x").alias("y")))
    around = ways.join(sizes.withColumnRenamed("sig", "y"), "y").select("x", F.col("single").alias("n")).unionByName(dense.filter("kind = 0").select("x", "n")).groupBy("x").agg(F.sum("n").alias("near"))
    per_set = sizes.join(around.withColumnRenamed("x", "sig"), "sig", "left").select("sig", (F.col("single") - 1 + F.coalesce("near", F.lit(0))).alias("links"))
    one = ids.filter("sets <= 1").join(per_set, "sig", "left").select(F.col("id").alias("doc_id"), F.when(F.col("sets") == 1, F.col("links")).otherwise(0).alias("links"))
    several = scratch.written(ids.filter("sets > 1").select("id").join(members.filter("size > 0"), "id").select("id", "sig"), "several")
    if not several.isEmpty():
        marked = dense.filter("kind = 2")
        ways = ways.unionByName(marked.select("x", "y")).unionByName(marked.select(F.col("y").alias("x"), F.col("x").alias("y")))
        reach = several.select("id", F.col("sig").alias("t")).unionByName(several.join(ways.withColumnRenamed("x", "sig"), "sig").select("id", F.col("y").alias("t"))).distinct()
        alone = reach.join(sizes.withColumnRenamed("sig", "t"), "t").groupBy("id").agg(F.sum("single").alias("n"))
        among = reach.join(several.select(F.col("sig").alias("t"), F.col("id").alias("other")), "t").filter("id <> other").groupBy("id").agg(F.countDistinct("other").alias("m"))
        many = several.select("id").distinct().join(alone, "id", "left").join(among, "id", "left").select(F.col("id").alias("doc_id"), (F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))).alias("links"))
        # the others count each of these ids once, whichever of its sets they are near
        met = reach.join(ids.filter("sets = 1").select(F.col("sig").alias("t"), F.col("id").alias("doc_id")), "t").groupBy("doc_id").agg(F.countDistinct("id").alias("extra"))
        one = one.join(met, "doc_id", "left").select("doc_id", (F.col("links") + F.coalesce("extra", F.lit(0))).alias("links")).unionByName(many)
    out = one.join(heads.withColumnRenamed("id", "doc_id"), "doc_id", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), "links")
    return scratch.written(out, "similar", members, close, dense, ids, several, heads)


def _forest(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's edges as ``(u, v)`` from each node to the smallest of its group, as far as these edges tell."""
    tables = [t for t in parts if t.num_rows]
    if not tables:
        return
    u, v = (np.concatenate([t.column(c).to_numpy() for t in tables]) for c in ("u", "v"))
    del tables
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    top = list(range(len(nodes)))
    for a, b in zip(at[: len(u)].tolist(), at[len(u) :].tolist()):
        while top[a] != a:
            top[a] = a = top[top[a]]
        while top[b] != b:
            top[b] = b = top[top[b]]
        if a < b:
            top[b] = a
        else:
            top[a] = b
    for i in range(len(top)):
        top[i] = top[top[i]]
    head = np.array(top)
    some = np.flatnonzero(head != np.arange(len(head)))
    yield pa.RecordBatch.from_arrays([pa.array(nodes[some]), pa.array(nodes[head[some]])], names=["u", "v"])


def groups(links: DataFrame, few: int = FEW_LINKS) -> DataFrame:
    """``(id, head)``: each id of ``links (doc_a, doc_b)`` but the smallest of its connected group, with that smallest id.

    Each task first reduces its links to a forest. More than ``few`` of what is left are then followed by alternating large-star and small-star
    steps until nothing changes; each halves the depth, so the number of rounds grows with the logarithm of the longest chain.
    """
    edges = links.select(F.col("doc_a").cast("long").alias("u"), F.col("doc_b").cast("long").alias("v")).filter("u <> v")
    return _followed(edges.mapInArrow(_forest, "u long, v long"), few)


def _followed(forests: DataFrame, few: int) -> DataFrame:
    """`groups` of the forests ``(u, v)`` of the tasks."""
    edges = scratch.written(forests.distinct(), "edges")
    if edges.count() <= few:
        out = edges.coalesce(1).mapInArrow(_forest, "u long, v long").toDF("id", "head")
        return scratch.written(out, "heads", edges)
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        floor = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(floor, "u").select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("e")).select("e.u", F.col("e.m").alias("v")).filter("u <> v").distinct()
        edges = scratch.written(small, "edges", edges)
        # edges are distinct, so their number and the sums of two hashes tell whether they changed
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.sum(F.hash("v", "u").cast("long"))).first()
        if now == before:
            return scratch.written(edges.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("head")), "heads", edges)
        before = now


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """The documents without all but the smallest id of each class of near duplicates; all columns stay.

    Rows with a null id or without tokens are kept: they have no partners. Of repeated rows with one id, one is kept
    (the one with the least text).
    """
    members, close, dense, _ = _sets(docs, id_col, text_col, n, threshold)
    drop = _heads(members, close, dense).select(F.col("id").alias("__near_id"))
    scratch.forget(members, close, dense)
    own = F.col(f"`{id_col}`").cast("long")
    again = scratch.written(docs.filter(own.isNotNull()).groupBy(own.alias("__near_id")).agg(F.count("*").alias("__near_n")).filter("__near_n > 1").select("__near_id"), "repeated")
    left = _without(docs, own, drop)
    if again.isEmpty():
        return left
    order = [F.col(f"`{c}`") for c, k in docs.dtypes if c not in (id_col, text_col) and not k.startswith(("map", "variant"))]
    place = F.row_number().over(Window.partitionBy(own).orderBy(F.col(f"`{text_col}`").asc_nulls_last(), *order))
    several = left.join(again, own == again["__near_id"], "left_semi")
    return _without(left, own, again).unionByName(several.withColumn("__near_place", place).filter("__near_place = 1").drop("__near_place"))


def _without(docs: DataFrame, own: Column, ids: DataFrame) -> DataFrame:
    side = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    return docs.join(side, own == side["__near_id"], "left_anti")
