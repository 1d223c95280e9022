"""Operator 3: quality by perplexity under an interpolated modified Kneser-Ney model.

A word bigram model is trained on all trusted documents (labelled of good quality and not toxic) and scores
all documents whole. Tokens are words and runs of symbols. Every token of trusted text has its own counts, at every size of the
input; a token that trusted text lacks gets what the discounts reserve for the uniform distribution and nothing else.

    P(w|v) = (c(vw) - D(c)) / c(v) + gamma(v) * P(w)
    P(w)   = (N(w) - D'(N)) / N + gamma' / V

where N(w) is the number of contexts that w follows, N their sum, V the number of kinds of tokens and an unknown one, and D and D' are each Chen and
Goodman's three discounts, estimated from the counts of counts of their order. In sums over a document

    log P(w|v) = log gamma(v) + log P(w) + delta(vw),   delta = 0 for bigrams unseen in training,

so bigrams meet deltas and tokens meet log P and log gamma, each by itself. Bigrams are sharded by the hash of both tokens, so that no shard holds a frequent context
whole; the shards exchange sums for each token. Each batch of documents sends each shard its bigrams and tokens as packed arrays, each shard gives
back a sum per document, and the sums are added. As they add up, the shards are asked in ``PASSES`` passes, one after the other, each over all
documents, so that only a part of the n-grams is on its way at a time. Nothing as long as the vocabulary is gathered in one place, and the number of shards follows
the trusted text. Within its shard an n-gram is known by 40 bits of its hash: an unseen one is taken for a seen one with odds of the shard's n-grams over 2^40.

A document is kept if its perplexity is at most its language's bar: the ``QUANTILE`` of the perplexities of trusted documents that the model
wasn't trained on (approximate percentile, relative rank error 1/100,000). For that, one in ``HOLD`` trusted ids, chosen by hash, is held out of the training; those
trained on look better than they are and would set the bar too low, and documents of unknown quality would by definition lose a fixed share. With fewer than ``LEAST_GOOD`` trusted
ids none is held out and the quantile is that of all documents not trained on, as also if ``quantile`` is given.

Nulls and ties: null and empty texts, or texts without a token, have null perplexity and are not kept. A null language is a
language of its own; one without documents for its bar takes the quantile over all languages, and if there are none, has no bar. Equal perplexities get
equal decisions. A null id is trusted by no label. Rows that repeat an id are scored one by one and counted
as often as they occur. A document with several labels is trusted if any of them trusts it. Without trusted text all perplexities are null and nothing
is kept. Other columns are ignored. Ids are integers (or text that reads as integers).
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch
from .packed import cells, loose, narrow, rows, runs, squeeze, starts
from .tokens import batches, column, mix, spread, tokenise_sliced, trimmed

QUANTILE, PASSES = 0.99, 2
HOLD, LEAST_GOOD = 10, 100
#: The context in which texts start.
START = np.uint64(1)
BATCH_BYTES = 8_000_000
#: Characters of trusted text for which there is one shard, if the session's shuffle partitions are fewer.
SHARD_CHARS = 20_000_000
#: Labels are sent to all executors up to this many ids (4 MB); beyond it they are joined by a shuffle.
BROADCAST_IDS = 500_000
_LOW = np.uint64(2**40 - 1)


def _pair(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """A hash of both tokens in their order."""
    return mix(mix(v) + w)


def _shard_of(key: np.ndarray, shards: int) -> np.ndarray:
    """By the first 24 bits; the other 40 are the key within the shard."""
    return (((key >> np.uint64(40)) * np.uint64(shards)) >> np.uint64(24)).astype(np.int32)


def bigrams(tok: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(context of each token, whether it is its text's first)``; a text starts in the context START."""
    first = np.zeros(len(tok), bool)
    first[starts(row)] = True
    v = np.empty_like(tok)
    v[1:] = tok[:-1]
    v[first] = START
    return v, first


def _small(counts: np.ndarray) -> np.ndarray:
    """Counts in 4 bytes, or in 8 where they need them."""
    return counts.astype(np.uint32) if not len(counts) or counts.max() < 2**32 else counts.astype(np.uint64)


def _counts(values: np.ndarray) -> bytes:
    small = _small(values)
    return bytes([small.itemsize]) + squeeze(small)


def _counted(data: pa.Buffer) -> np.ndarray:
    view = memoryview(data)
    return loose(view[1:], np.uint32 if view[0] == 4 else np.uint64).astype(np.int64)


def _summed(keys: list[np.ndarray], *values: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """Distinct keys, rising, with the sums of their values."""
    k = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
    order = np.argsort(k, kind="stable")
    k = k[order]
    at = starts(k)
    return (k[at], *(np.add.reduceat(np.concatenate(v)[order], at) if len(at) else np.zeros(0, np.int64) for v in values))


_COUNTS = pa.schema([("shard", pa.int32()), *((n, pa.binary()) for n in ("v", "v_at", "w", "w_at", "c"))])
COUNTS = "shard int, v binary, v_at binary, w binary, w_at binary, c binary"


def _send_bigrams(parts: Iterator[pa.RecordBatch], names: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Each batch's bigrams with their numbers; both tokens as places in lists of the distinct ones."""
    for table in batches(parts, "t", BATCH_BYTES):
        w, row = tokenise_sliced(column(table, "t"), True)
        v, _ = bigrams(w, row)
        part = _shard_of(_pair(v, w), len(names))
        if len(part):
            yield _packed_bigrams(part, v, w, np.ones(len(v), np.int64), names)


def _packed_bigrams(part: np.ndarray, v: np.ndarray, w: np.ndarray, c: np.ndarray, names: np.ndarray) -> pa.RecordBatch:
    order = np.lexsort((w, v, part))
    part, v, w, c = part[order], v[order], w[order], c[order]
    at = starts(part, v, w)
    part, v, w, c = part[at], v[at], w[at], np.add.reduceat(c, at)
    out = []
    for x, k in zip(*runs(part)):
        own = slice(x, x + k)
        va, many = runs(v[own])
        kinds, place = np.unique(w[own], return_inverse=True)
        out.append((int(names[part[x]]), squeeze(v[own][va], True), _counts(many), squeeze(kinds, True), squeeze(place.astype(np.uint32)), _counts(c[own])))
    return rows(out, _COUNTS)


def _unpacked(table: pa.Table) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
    v, v_at, w, w_at, c = (cells(table, n) for n in ("v", "v_at", "w", "w_at", "c"))
    vs = [np.repeat(loose(a, np.uint64, True), _counted(b)) for a, b in zip(v, v_at)]
    return vs, [loose(a, np.uint64, True)[loose(b, np.uint32)] for a, b in zip(w, w_at)], [_counted(x) for x in c]


_TABLE = pa.schema([*_COUNTS, ("cc", pa.binary())])
TABLE = COUNTS + ", cc binary"


def _shard_counts(table: pa.Table) -> pa.Table:
    """One shard's bigrams with their counts in the whole trusted text, and how many have the counts 1 to 4."""
    v, w, c = (np.concatenate(x) for x in _unpacked(table))
    one = _packed_bigrams(np.zeros(len(v), np.int32), v, w, c, np.array([table.column("shard")[0].as_py()]))
    c = _counted(one.column("c")[0].as_buffer())
    return pa.Table.from_batches([pa.RecordBatch.from_arrays([*one.columns, pa.array([np.array([(c == i).sum() for i in (1, 2, 3, 4)], np.int64).tobytes()], pa.binary())], schema=_TABLE)])


#: Sums for each token: occurrences as a context; bigrams of it as a context with counts of 1, 2 and more; contexts that it follows.
_SUMS = ("c", "n1", "n2", "n3", "before")
_ASKED = pa.schema([("shard", pa.int32()), ("asks", pa.int32()), ("t", pa.binary()), *((n, pa.binary()) for n in _SUMS)])
ASKED = "shard int, asks int, t binary, " + ", ".join(f"{n} binary" for n in _SUMS)


def _ask(parts: Iterator[pa.RecordBatch], names: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Each shard's sums for its tokens, to the shards of the tokens."""
    for part in parts:
        for i in range(part.num_rows):
            one = pa.Table.from_batches([part.slice(i, 1)])
            v, w, c = (np.concatenate(x) for x in _unpacked(one))
            own = [c, (c == 1).astype(np.int64), (c == 2).astype(np.int64), (c > 2).astype(np.int64)]
            zero, none = np.zeros(len(w), np.int64), np.zeros(len(v), np.int64)
            t, *sums = _summed([v, w], *([x, zero] for x in own), [none, zero + 1])
            to = _shard_of(mix(t), len(names))
            order = np.argsort(to, kind="stable")
            out = []
            for x, k in zip(*runs(to[order])):
                mine = order[x : x + k]
                out.append((int(names[to[mine[0]]]), part.column("shard")[i].as_py(), squeeze(t[mine], True), *(_counts(s[mine]) for s in sums)))
            yield rows(out, _ASKED)


_TOKENS = pa.schema([("shard", pa.int32()), ("t", pa.binary()), *((n, pa.binary()) for n in _SUMS), ("nn", pa.binary())])
TOKENS = "shard int, t binary, " + ", ".join(f"{n} binary" for n in _SUMS) + ", nn binary"


def _token_sums(table: pa.Table) -> pa.Table:
    """One shard's tokens with their whole sums, and the counts of the numbers of contexts that they follow."""
    t, *sums = _summed([loose(x, np.uint64, True) for x in cells(table, "t")], *([_counted(x) for x in cells(table, n)] for n in _SUMS))
    before = sums[-1]
    nn = np.array([before.sum(), (before > 0).sum(), *((before == i).sum() for i in (1, 2, 3, 4))], np.int64)
    return pa.Table.from_batches([rows([(table.column("shard")[0].as_py(), squeeze(t, True), *map(_counts, sums), nn.tobytes())], _TOKENS)])


def discounts(n: np.ndarray) -> np.ndarray:
    """The modified discounts of counts 0, 1, 2 and more, from the numbers of items with the counts 1 to 4."""
    n1, n2, n3, n4 = (float(x) for x in n)
    y = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
    d = np.array([0.0, 1 - 2 * y * n2 / n1 if n1 else y, 2 - 3 * y * n3 / n2 if n2 else y, 3 - 4 * y * n4 / n3 if n3 else y])
    d[1:] = np.clip(d[1:], 0.05, [0.95, 1.95, 2.95])
    return d


class Model:
    """The numbers that all shards share."""

    def __init__(self, cc: np.ndarray, nn: np.ndarray):
        self.d, self.low = discounts(cc), discounts(nn[2:])
        self.total, self.kinds = float(nn[0]), float(nn[1])
        n1, n2 = float(nn[2]), float(nn[3])
        held = self.low[1] * n1 + self.low[2] * n2 + self.low[3] * (self.kinds - n1 - n2)
        self.uniform = held / self.total / (self.kinds + 1)

    def log_low(self, before: np.ndarray) -> np.ndarray:
        """log P(w) of tokens that follow so many contexts."""
        return np.log((before - self.low[np.minimum(before, 3)]) / self.total + self.uniform)

    def log_gamma(self, c: np.ndarray, n1: np.ndarray, n2: np.ndarray, n3: np.ndarray) -> np.ndarray:
        """log gamma of contexts; 0 for what is none."""
        return np.where(c > 0, np.log(np.maximum(self.d[1] * n1 + self.d[2] * n2 + self.d[3] * n3, 1e-9) / np.maximum(c, 1)), 0.0)


_MODEL = pa.schema([("shard", pa.int32()), ("kind", pa.int32()), ("k", pa.binary()), ("x", pa.binary()), ("y", pa.binary())])
MODEL = "shard int, kind int, k binary, x binary, y binary"


def _floats(values: np.ndarray) -> bytes:
    return squeeze(values.astype(np.float32))


def _by_key(key: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """The 40-bit keys, rising, with their values."""
    key = key & _LOW
    order = np.argsort(key)
    return (key[order], *(v[order] for v in values))


_ANSWERED = pa.schema([("shard", pa.int32()), ("t", pa.binary()), ("c", pa.binary()), ("gamma", pa.binary()), ("low", pa.binary())])
ANSWERED = "shard int, t binary, c binary, gamma binary, low binary"


def _token_values(table: pa.Table, model: Model) -> tuple[np.ndarray, ...]:
    t, (c, n1, n2, n3, before) = loose(cells(table, "t")[0], np.uint64, True), (_counted(cells(table, n)[0]) for n in _SUMS)
    return t, c, model.log_gamma(c, n1, n2, n3), model.log_low(before)


def _answer(asked: pa.Table, own: pa.Table, model: Model) -> pa.Table:
    """To each shard that asked: the values of its tokens."""
    t, c, gamma, low = _token_values(own, model)
    out = []
    for to, some in zip(asked.column("asks").to_pylist(), cells(asked, "t")):
        at = np.searchsorted(t, loose(some, np.uint64, True))
        out.append((to, some, _counts(c[at]), _floats(gamma[at]), _floats(low[at])))
    return pa.Table.from_batches([rows(out, _ANSWERED)])


def _token_model(parts: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    """The token shards as scoring needs them: keys with log gamma and log P."""
    for part in parts:
        for i in range(part.num_rows):
            t, _, gamma, low = _token_values(pa.Table.from_batches([part.slice(i, 1)]), model)
            key, gamma, low = _by_key(mix(t), gamma, low)
            yield rows([(part.column("shard")[i].as_py(), 2, squeeze(key, True), _floats(low), _floats(gamma))], _MODEL)


def _bigram_model(table: pa.Table, answers: pa.Table, model: Model) -> pa.Table:
    """One shard's bigrams as scoring needs them: keys with what each adds to the logarithm of its backed-off probability."""
    v, w, n = (np.concatenate(x) for x in _unpacked(table))
    told = [loose(x, np.uint64, True) for x in cells(answers, "t")]
    values = [np.concatenate([f(x) for x in cells(answers, name)]) for name, f in (("c", _counted), ("gamma", lambda x: loose(x, np.float32)), ("low", lambda x: loose(x, np.float32)))]
    t = np.concatenate(told)
    order = np.argsort(t)
    t, (c, gamma, low) = t[order], (x[order] for x in values)
    at, to = np.searchsorted(t, v), np.searchsorted(t, w)
    back = gamma[at].astype(float) + low[to]
    delta = np.log((n - model.d[np.minimum(n, 3)]) / c[at] + np.exp(back)) - back
    key, delta = _by_key(_pair(v, w), delta)
    return pa.Table.from_batches([rows([(table.column("shard")[0].as_py(), 1, squeeze(key, True), _floats(delta), b"")], _MODEL)])


def train(trusted: DataFrame, shards: int) -> tuple[DataFrame, Model] | None:
    """The model's shards, a scratch table, and the numbers that they share. ``trusted`` has a text column ``t``."""
    names = spread(shards, shards)
    table = trusted.mapInArrow(lambda x: _send_bigrams(x, names), COUNTS).repartition(shards, "shard").groupBy("shard").applyInArrow(trimmed(_shard_counts), TABLE)
    table = scratch.written(table, "bigrams")
    asked = scratch.written(table.drop("cc").mapInArrow(lambda x: _ask(x, names), ASKED), "asked")
    tokens = scratch.written(asked.drop("asks").repartition(shards, "shard").groupBy("shard").applyInArrow(trimmed(_token_sums), TOKENS), "tokens")
    cc = sum((np.frombuffer(r.cc, np.int64) for r in table.select("cc").toLocalIterator()), np.zeros(4, np.int64))
    nn = sum((np.frombuffer(r.nn, np.int64) for r in tokens.select("nn").toLocalIterator()), np.zeros(6, np.int64))
    if not nn[0]:
        scratch.forget(table, asked, tokens)
        return None
    model = Model(cc, nn)
    answers = asked.select("shard", "asks", "t").repartition(shards, "shard").groupBy("shard").cogroup(tokens.drop("nn").repartition(shards, "shard").groupBy("shard"))
    answers = scratch.written(answers.applyInArrow(trimmed(lambda x, y: _answer(x, y, model)), ANSWERED), "answers", asked)
    whole = table.drop("cc").repartition(shards, "shard").groupBy("shard").cogroup(answers.repartition(shards, "shard").groupBy("shard")).applyInArrow(trimmed(lambda x, y: _bigram_model(x, y, model)), MODEL)
    whole = whole.unionByName(tokens.drop("nn").mapInArrow(lambda x: _token_model(x, model), MODEL))
    return scratch.written(whole, "model", table, tokens, answers), model


_SENT = pa.schema([("shard", pa.int32()), ("uid", pa.int64()), ("kind", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())])
SENT = "shard int, uid long, kind int, a binary, b binary, c binary"


def _send_documents(parts: Iterator[pa.RecordBatch], names: np.ndarray, first: int, last: int) -> Iterator[pa.RecordBatch]:
    task = TaskContext.get().partitionId()
    for seq, table in enumerate(batches(parts, "t", BATCH_BYTES)):
        yield _sent(table, task * 2**24 + seq, names, first, last)


def _sent(table: pa.Table, place: int, names: np.ndarray, first: int, last: int) -> pa.RecordBatch:
    """What a batch asks the shards from ``first`` up to ``last``; its documents go along with the first ones."""
    w, row = tokenise_sliced(column(table, "t"), True)
    n = np.bincount(row, minlength=table.num_rows)
    # a batch that is read again with other rows is another batch: the sums then miss their documents and the job stops
    uid = int.from_bytes(hashlib.blake2b(b"%d" % place + n.tobytes() + w.tobytes(), digest_size=7).digest(), "little")
    out = [(int(names[uid % len(names)]), uid, 0, *_documents(table), n.tobytes())] if first == 0 else []
    if len(w):
        v, begins = bigrams(w, row)
        out += _distinct(_pair(v, w), row, np.ones(len(w), np.uint64), (uid, 1), names, first, last)
        # each token is a word once, and a context once unless it is the last one; texts start in START
        ends = np.append(begins[1:], True)
        begin = np.flatnonzero(begins)
        roles = np.concatenate([np.where(ends, 1, 3), np.full(len(begin), 2)]).astype(np.uint64)
        out += _distinct(mix(np.concatenate([w, np.full(len(begin), START)])), np.concatenate([row, row[begin]]), roles, (uid, 2), names, first, last)
    return rows(out, _SENT)


def _distinct(key: np.ndarray, row: np.ndarray, roles: np.ndarray, head: tuple, names: np.ndarray, first: int, last: int) -> list[tuple]:
    """One packed row for each shard: distinct keys, the documents of each, and how often each is a word (role 1) and, less that, a context (role 2)."""
    part = _shard_of(key, len(names))
    mine = np.flatnonzero((part >= first) & (part < last))
    part = part[mine].astype(np.uint16 if len(names) <= 65_536 else np.int32)
    order = np.argsort(part, kind="stable")
    part = part[order]
    mine = mine[order]
    packed = ((key[mine] & _LOW) << np.uint64(24)) | (row[mine].astype(np.uint64) << np.uint64(2)) | roles[mine]
    out = []
    for x, k in zip(*runs(part)):
        own = np.sort(packed[x : x + k])
        at = starts(own >> np.uint64(2))
        word = np.add.reduceat((own & np.uint64(1)).astype(np.int64), at)
        times = [word] if head[1] == 1 else [word, np.add.reduceat(((own >> np.uint64(1)) & np.uint64(1)).astype(np.int64), at) - word + 1]
        keys, doc = own[at] >> np.uint64(24), ((own[at] >> np.uint64(2)) & np.uint64(2**22 - 1))
        ka, many = runs(keys)
        doc = narrow(doc, int(doc.max()) + 1)
        out.append((int(names[part[x]]), *head, len(ka).to_bytes(4, "little") + squeeze(np.concatenate([np.diff(keys[ka], prepend=np.uint64(0)), many.astype(np.uint64)])), doc.itemsize.to_bytes(1, "little") + squeeze(doc), _counts(np.concatenate(times))))
    return out


def _documents(table: pa.Table) -> tuple[bytes, bytes]:
    """Ids, null marks, trust (1 trained on, 2 held out) and languages of a batch."""
    ids = column(table, "id")
    known = np.asarray(ids.is_valid())
    return ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).tobytes() + known.tobytes() + np.asarray(column(table, "trusted")).astype(np.int8).tobytes(), json.dumps(column(table, "lang").to_pylist()).encode()


_PARTS = pa.schema([("uid", pa.int64()), ("kind", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())])
PARTS = "uid long, kind int, a binary, b binary, c binary"


def _looked_up(keys: np.ndarray, values: np.ndarray, key: np.ndarray, missing: float) -> np.ndarray:
    if not len(keys):
        return np.full(len(key), missing)
    at = np.searchsorted(keys, key)
    at[at == len(keys)] = 0
    return np.where(keys[at] == key, values[at], missing)


def _scored(sent: pa.Table, table: pa.Table, unseen: float) -> pa.Table:
    """The sums of the logarithms over each document's bigrams and tokens that fall into one shard."""
    none = np.zeros(0)
    known = {1: (none, none, none), 2: (none, none, none)}
    for kind, k, x, y in zip(table.column("kind").to_pylist(), *(cells(table, n) for n in ("k", "x", "y"))):
        known[kind] = loose(k, np.uint64, True), loose(x, np.float32), loose(y, np.float32) if kind == 2 else none
    out, totals = [], {}
    for uid, kind, a, b, c in zip(sent.column("uid").to_pylist(), sent.column("kind").to_pylist(), *(cells(sent, n) for n in "abc")):
        if kind == 0:
            out.append((uid, 0, a, b, c))
            continue
        words = loose(memoryview(a)[4:], np.uint64)
        half = int.from_bytes(memoryview(a)[:4], "little")
        key, many = np.cumsum(words[:half], dtype=np.uint64), words[half:].astype(np.int64)
        doc = loose(memoryview(b)[1:], np.uint16 if memoryview(b)[0] == 2 else np.uint32)
        times = _counted(c).reshape(-1, len(doc))
        k, x, y = known[kind]
        hit = np.repeat(_looked_up(k, x, key, 0.0 if kind == 1 else unseen), many) * times[0]
        if kind == 2:
            hit += np.repeat(_looked_up(k, y, key, 0.0), many) * (times[1] + times[0] - 1)
        total = np.bincount(doc, hit)
        if uid in totals:
            both = totals[uid], total
            total = np.zeros(max(map(len, both)))
            for one in both:
                total[: len(one)] += one
        totals[uid] = total
    for uid, total in totals.items():
        some = np.flatnonzero(total)
        out.append((uid, 1, squeeze(some.astype(np.uint32), True), _floats(total[some]), b""))
    return pa.Table.from_batches([rows(out, _PARTS)])


_RESULT = "doc_id long, lang string, trusted boolean, held boolean, n_tokens long, log_prob double"


def _added(table: pa.Table) -> pa.Table:
    kinds = table.column("kind").to_pylist()
    if kinds.count(0) != 1:
        raise ValueError("a batch of documents changed while it was read; write the input to a table first")
    a, b, c = (cells(table, n) for n in "abc")
    head = kinds.index(0)
    n = np.frombuffer(c[head], np.int64)
    size, total = len(n), np.zeros(len(n))
    for kind, doc, value in zip(kinds, a, b):
        if kind == 1:
            total[loose(doc, np.uint32, True)] += loose(value, np.float32)
    ids, known, trusted = np.frombuffer(a[head], np.int64, size), np.frombuffer(a[head], bool, size, 8 * size), np.frombuffer(a[head], np.int8, size, 9 * size)
    return pa.table({"doc_id": pa.array(ids, mask=~known), "lang": pa.array(json.loads(b[head].to_pybytes()), pa.string()), "trusted": pa.array(trusted == 1), "held": pa.array(trusted == 2), "n_tokens": pa.array(n), "log_prob": pa.array(total)})


def perplexities(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", hold: int | None = None, passes: int = PASSES) -> DataFrame:
    """``(doc_id, lang, trusted, held, n_tokens, log_prob)`` of every row, trusted if trained on; one in ``hold`` trusted ids is held out; labels have ``(doc_id, quality, toxic)``."""
    spark = docs.sparkSession
    good = labels.filter("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null").select(F.col("doc_id").cast("long").alias("__good")).distinct()
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"), F.col(lang_col).cast("string").alias("lang"))
    good = scratch.written(good, "trusted")
    many = good.count()
    side = F.broadcast(good) if many <= BROADCAST_IDS else good
    held = F.pmod(F.xxhash64("id"), F.lit(hold)) == 0 if hold and many >= LEAST_GOOD else F.lit(False)
    state = F.when(F.col("__good").isNull(), 0).when(held, 2).otherwise(1)
    marked = own.join(side, own["id"] == side["__good"], "left").select("id", "t", "lang", state.alias("trusted"))
    trusted = marked.filter("trusted = 1 and t is not null").select("t")
    chars = trusted.agg(F.sum(F.length("t"))).first()[0] or 0
    shards = max(scratch.shuffle_partitions(spark), -(-chars // SHARD_CHARS))
    trained = train(trusted, shards) if chars else None
    if trained is None:
        return own.select(F.col("id").alias("doc_id"), "lang", F.lit(False).alias("trusted"), F.lit(False).alias("held"), F.lit(0).cast("long").alias("n_tokens"), F.lit(None).cast("double").alias("log_prob"))
    table, model = trained
    unseen = float(model.log_low(np.zeros(1, np.int64))[0])
    names = spread(shards, shards)
    cuts = np.unique(np.linspace(0, shards, passes + 1).astype(int))
    sums = []
    for first, last in zip(cuts[:-1], cuts[1:]):
        sent = marked.mapInArrow(lambda x, a=int(first), b=int(last): _send_documents(x, names, a, b), SENT)
        part = table.filter(F.col("shard").isin([int(x) for x in names[first:last]])) if len(cuts) > 2 else table
        scored = sent.repartition(shards, "shard").groupBy("shard").cogroup(part.repartition(shards, "shard").groupBy("shard"))
        sums.append(scratch.written(scored.applyInArrow(trimmed(lambda x, y: _scored(x, y, unseen)), PARTS), "sums"))
    every = sums[0]
    for x in sums[1:]:
        every = every.unionByName(x)
    return scratch.written(every.groupBy("uid").applyInArrow(trimmed(_added), _RESULT), "perplexities", table, good, *sums)


def quality(docs: DataFrame, labels: DataFrame, quantile: float | None = None, **params: object) -> DataFrame:
    """``(doc_id, lang, n_tokens, perplexity, threshold, keep)`` of every row."""
    scored = perplexities(docs, labels, hold=HOLD if quantile is None else None, **params)
    scored = scored.withColumn("perplexity", F.when(F.col("n_tokens") > 0, F.exp(-F.col("log_prob") / F.col("n_tokens"))))
    unseen = scored.filter("not trusted and perplexity is not null")
    if not unseen.filter("held").isEmpty():
        unseen = unseen.filter("held")
    at = F.percentile_approx("perplexity", QUANTILE if quantile is None else quantile, 100_000)
    by_lang = scratch.written(unseen.groupBy(F.coalesce(F.concat(F.lit("="), "lang"), F.lit("")).alias("l")).agg(at.alias("own")), "thresholds")
    whole = unseen.agg(at.alias("whole"))
    both = scored.withColumn("l", F.coalesce(F.concat(F.lit("="), "lang"), F.lit(""))).join(by_lang, "l", "left").crossJoin(F.broadcast(whole))
    limit = F.coalesce("own", "whole", F.lit(float("inf")))
    return both.select("doc_id", "lang", "n_tokens", "perplexity", limit.alias("threshold"), F.coalesce(F.col("perplexity") <= limit, F.lit(False)).alias("keep"))
