"""Operators 6 and 7 against brute force."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import jaccard_join, packed, suffix_decontam, tokens

from . import fixtures

TOKEN = re.compile(tokens.TOKEN_RE)


def grams(text, n=3):
    w = TOKEN.findall((text or "").lower())
    return frozenset(tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))) if w else frozenset()


def brute_pairs(rows, threshold, n=3):
    """Every two ids with any rows of enough similarity."""
    sets = [(i, grams(t, n)) for i, t in rows if i is not None and grams(t, n)]
    out = {}
    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            same = len(a & b) / len(a | b)
            if i != j and same >= threshold:
                pair = min(i, j), max(i, j)
                out[pair] = max(same, out.get(pair, 0))
    return out


def brute_similar(rows, threshold, n=3):
    """``(doc_id, class_id, links)`` of each id, from the pairs."""
    ids = {i for i, _ in rows if i is not None}
    top, links = {i: i for i in ids}, Counter()
    for a, b in brute_pairs(rows, threshold, n):
        links[a] += 1
        links[b] += 1
        least = min(top[a], top[b])
        top = {i: least if h in (top[a], top[b]) else h for i, h in top.items()}
    return {(i, top[i], links[i]) for i in ids}


def similar(df, **params):
    got = [tuple(r) for r in jaccard_join.similar(df, **params).collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_similar_and_pairs_equal_brute_force(spark):
    rows = [(r[0], r[1]) for r in fixtures.rows()]
    for t in (0.3, 0.9):
        assert similar(fixtures.docs(spark), threshold=t) == brute_similar(rows, t)
    got = {(r.doc_a, r.doc_b): round(r.jaccard, 9) for r in jaccard_join.all_pairs(fixtures.docs(spark), threshold=0.4).collect()}
    assert got == {k: round(v, 9) for k, v in brute_pairs(rows, 0.4).items()}


def test_repeated_ids_with_different_texts(spark):
    """1 and 2 are copies, 3 and 4 near both; 5 and 6 each have two texts, one of them shared; 7 has an empty row too."""
    text, other = fixtures.prose(11, 40), fixtures.prose(12, 40)
    rows = [(1, text), (2, text), (3, text + " and more"), (4, text + " and more"), (5, other), (5, text), (None, text), (6, None), (6, other), (6, other + " and more"), (7, ""), (7, other), (8, fixtures.prose(13, 40)), (9, "")]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, sig int, id int")
    want = brute_pairs(rows, 0.5)
    assert (2, 3) in want and (5, 6) in want and (5, 7) in want
    assert {(r.doc_a, r.doc_b): round(r.jaccard, 9) for r in jaccard_join.all_pairs(df).collect()} == {k: round(v, 9) for k, v in want.items()}
    assert similar(df) == brute_similar(rows, 0.5)


def test_similar_of_many_edited_copies(spark):
    r = random.Random(5)
    rows = []
    for g in range(8):
        base = fixtures.prose(100 + g, 60).split()
        for _ in range(1 if g == 0 else 25):
            w = [x if r.random() > 0.06 else f"w{r.randrange(10**6)}" for x in base]
            rows.append((len(rows), " ".join(w)))
    hot = "this passage of nine words is shared by all"
    rows = [(i, f"{t} {hot}") for i, t in rows]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    df = spark.createDataFrame(df.collect(), df.schema)
    assert similar(df) == brute_similar(rows, 0.5)


def test_slices_and_many_fragments_give_the_same(spark, monkeypatch):
    rows = [(r[0], r[1]) for r in fixtures.rows()] + [(300 + k, "今天天气很好我们去公园" + "走" * (k % 3) + "玩") for k in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_similar(rows, 0.5)
    assert any(c == 300 and n for _, c, n in want)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    monkeypatch.setattr(jaccard_join, "COARSER", 1)
    for parts in (1, 70):
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        try:
            assert similar(df) == want
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)


def test_a_record_with_very_many_partners():
    """Candidates of one posting list, by the path for records with many partners and by the other."""
    sig = np.arange(1, 1501, dtype=np.uint64)
    head = np.concatenate([sig, np.full(1500, 10, np.uint64), np.full(1500, 1, np.uint64)])
    table = pa.table({"a": pa.array([head.tobytes()], pa.binary()), "b": pa.array([packed.squeeze(np.repeat(np.arange(2, dtype=np.uint64), [1500, 3]), True)], pa.binary()), "c": pa.array([packed.squeeze(np.concatenate([np.arange(1500), [3, 5, 9]]).astype(np.uint32))], pa.binary())})
    lists = jaccard_join._lists(jaccard_join._candidates(table, 0.5, np.arange(7)))
    got = {(int(x), int(y)) for a in lists for x, y in zip(a.sig[a.x], a.sig[a.y])}
    assert len(got) == sum(len(a.x) for a in lists) == 1500 * 1499 // 2 and all(x < y for x, y in got) and len(lists) == 7


def test_one_of_each_keeps_the_smallest_id_and_all_columns(spark):
    docs = fixtures.docs(spark)
    kept = jaccard_join.one_of_each(docs)
    assert kept.columns == docs.columns
    ids = sorted((r.doc_id for r in kept.collect()), key=lambda x: (x is None, x))
    assert ids == [0, 3, 4, 5, 6, 7, 8, 10, 11, 12, 13, 14, 50, None, None]


def test_near_empty_table(spark):
    assert jaccard_join.similar(fixtures.empty(spark)).count() == jaccard_join.all_pairs(fixtures.empty(spark)).count() == 0
    assert jaccard_join.one_of_each(fixtures.empty(spark)).count() == 0


def test_groups_follow_chains(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "doc_a long, doc_b long")
    for few in (10**6, 0):
        got = {r.id: r.head for r in jaccard_join.groups(links, few).collect()}
        assert got == {i: 0 for i in range(1, 41)} | {101: 100}
    assert jaccard_join.groups(links.limit(0), 0).count() == jaccard_join.groups(links.limit(0)).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text("ab é.\n“今ท文—1", max_size=30)), max_size=8))
def test_tokens_are_those_of_the_expression(texts):
    tok, row, start, end = tokens.tokenise(pa.array(texts, pa.string()))
    want = [(i, w) for i, t in enumerate(texts) for w in TOKEN.findall((t or "").lower())]
    assert [(i, (texts[i].lower().encode())[a:b].decode()) for i, a, b in zip(row, start, end)] == want
    assert len(set(tok.tolist())) == len({w for _, w in want})


def brute_matches(rows, items, least, least_item=1):
    out = {}
    for i, t in rows:
        w = TOKEN.findall((t or "").lower())
        for k, x in items:
            y = TOKEN.findall((x or "").lower())
            if i is None or k is None or len(y) < least_item:
                continue
            best = None
            for a in range(len(w)):
                for b in range(len(y)):
                    n = 0
                    while a + n < len(w) and b + n < len(y) and w[a + n] == y[b + n]:
                        n += 1
                    if n >= min(least, len(y)) and (best is None or (-n, a, b) < best):
                        best = (-n, a, b)
            if best:
                out[i, k] = min(out.get((i, k), (0, 0, 0)), best)
    return {k: (-a, b, c) for k, (a, b, c) in out.items()}


def test_longest_matches_equal_brute_force(spark):
    r = random.Random(3)
    items = [(k, fixtures.prose(200 + k, 14 + k)) for k in range(6)] + [(90, "too short"), (91, None), (92, "a b c d e f g")]
    rows = []
    for i in range(40):
        text = " ".join(r.choice("abcdefg") for _ in range(60))
        if i % 4 == 0:
            w = items[i % 6][1].split()
            a = r.randrange(4)
            text = text[:30] + " " + " ".join(w[a : a + r.randrange(5, 15)]) + " " + text[30:]
        rows.append((i, text))
    rows += [(None, items[0][1]), (60, ""), (61, None), (62, items[2][1] * 3), (62, items[2][1] * 3)]
    df = spark.createDataFrame([(*x, 1, 2) for x in rows], "doc_id long, text string, id int, item_id int")
    tests = spark.createDataFrame(items, "item_id long, text string")
    got = {(x.doc_id, x.item_id): (x.match_tokens, x.doc_token, x.item_token) for x in suffix_decontam.matches(df, tests, min_tokens=8).collect()}
    want = brute_matches(rows, items, 8)
    assert got == want and len(want) >= 5
    kept = suffix_decontam.clean(df, tests, min_tokens=8)
    assert kept.columns == df.columns
    hit = {i for i, _ in want}
    assert sorted((x.doc_id for x in kept.collect()), key=str) == sorted((i for i, _ in rows if i is not None and i not in hit), key=str)


def test_slices_of_items_short_items_and_long_texts(spark, monkeypatch):
    """Items in several broadcasts, one of one word and some of scripts without blanks; a text of a million characters."""
    items = [(k, fixtures.prose(700 + k, 25)) for k in range(30)] + [(50, "needle"), (51, "天气很好我们去公园玩儿吧"), (52, ""), (53, None), (50, "needle")]
    long = fixtures.long_prose(9, 150_000)
    rows = [(0, long + " needle"), (1, long + " " + items[7][1]), (2, "今天天气很好我们去公园玩儿吧！"), (3, "今天天气不好"), (4, items[3][1]), (4, items[3][1] + " needle")]
    df, tests = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = brute_matches([r for r in rows if r[0] not in (0, 1)], items, 10)
    whole = None
    for size in (2_000_000, 300):
        monkeypatch.setattr(suffix_decontam, "SLICE_TOKENS", size)
        assert (len(suffix_decontam._items(tests, "item_id", "text", 1)[0]) > 5) == (size == 300)
        got = {(x.doc_id, x.item_id): (x.match_tokens, x.doc_token, x.item_token) for x in suffix_decontam.matches(df, tests).collect()}
        assert {k: v for k, v in got.items() if k[0] > 1} == want and (0, 50) in got and (1, 7) in got and (2, 51) in got
        assert whole in (None, got)
        whole = got
        assert [r.doc_id for r in suffix_decontam.clean(df, tests).collect()] == [3]
        assert (0, 50) not in {(x.doc_id, x.item_id) for x in suffix_decontam.matches(df, tests, least_item=5).collect()}


def test_suffixes_are_sorted():
    r = np.random.default_rng(1)
    tok = r.integers(1, 4, 300).astype(np.uint64)
    row = np.sort(r.integers(0, 9, 300))
    shard = suffix_decontam.Shard(tok, row, 40)

    def suffix(p):
        out = []
        while shard.seq[p]:
            out.append(shard.seq[p])
            p += 1
        return out[:40]

    order = [suffix(p) for p in shard.array]
    assert order == sorted(order) and len(order) == 300


def test_decontamination_of_empty_tables(spark):
    tests = spark.createDataFrame([(1, fixtures.prose(1, 30))], "item_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert suffix_decontam.matches(fixtures.empty(spark), tests).count() == 0
    assert suffix_decontam.matches(fixtures.docs(spark), none).count() == 0
    assert suffix_decontam.clean(fixtures.docs(spark), none).count() == len(fixtures.rows())


def test_groups_by_blocks_equal_brute_force(spark, monkeypatch):
    """Edited copies in number: no list of more than `HOT` records becomes pairs; ids of several sets, copies, one block and many."""
    r = random.Random(8)
    rows = []
    for g in range(4):
        base = fixtures.prose(300 + g, 60).split()
        for _ in range(30):
            rows.append((len(rows), " ".join(x if r.random() > 0.07 else f"w{r.randrange(9)}" for x in base[: r.choice([60, 60, 45, 30])])))
    rows += [(k, rows[k + 40][1]) for k in (3, 5, 33)] + [(200 + k, rows[k][1]) for k in range(8)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    df = spark.createDataFrame(df.collect(), df.schema)
    want, pairs = brute_similar(rows, 0.5), brute_pairs(rows, 0.5)
    for hot, most, size in ((8, 10**6, 500_000), (2, 10**6, 700), (200, 40, 150)):
        for name, value in (("HOT", hot), ("MOST_PAIRS", most), ("BLOCK_GRAMS", size), ("BLOCK_RECORDS", max(1, size // 100))):
            monkeypatch.setattr(jaccard_join, name, value)
        assert similar(df) == want
    assert {(x.doc_a, x.doc_b): round(x.jaccard, 9) for x in jaccard_join.all_pairs(df).collect()} == {k: round(v, 9) for k, v in pairs.items()}
    assert sorted(x.doc_id for x in jaccard_join.one_of_each(df).collect()) == sorted({c for _, c, _ in want})


def test_long_lists_are_links_not_pairs():
    """A list of 3,000 records gives a link each; their 4.5 million pairs are never listed."""
    n = 3000
    head = np.concatenate([np.arange(1, n + 1, dtype=np.uint64), np.full(n, 10, np.uint64), np.full(n, 1, np.uint64)])
    table = pa.table({"a": pa.array([head.tobytes()], pa.binary()), "b": pa.array([packed.squeeze(np.repeat(np.arange(2, dtype=np.uint64), [n, 3]), True)], pa.binary()), "c": pa.array([packed.squeeze(np.concatenate([np.arange(n), [3, 5, 9]]).astype(np.uint32))], pa.binary())})
    out = jaccard_join._candidates(table, 0.5, np.arange(7), jaccard_join.HOT, jaccard_join.MOST_PAIRS)
    by = {k: [a for a, kind in zip(jaccard_join._lists(out), out.column("kind").to_pylist()) if kind == k] for k in (0, 2)}
    assert sorted((int(x), int(y)) for a in by[0] for x, y in zip(a.sig[a.x], a.sig[a.y])) == [(4, 6), (4, 10), (6, 10)]
    assert {int(y) for a in by[2] for x, y in zip(a.sig[a.x], a.sig[a.y]) if x == 1} == set(range(1, n + 1))
    assert jaccard_join._longest(np.array([5, 2, 3]), 200, 4) == 4


def test_candidates_of_a_fragment_are_taken_in_parts(monkeypatch):
    """A fragment that sees 800,000 candidates in 80 buckets holds a few of them at a time, and counts as brute force does."""
    r, n = np.random.default_rng(2), 600
    sets = [np.unique(r.integers(0, 60, 8)) for _ in range(n)]
    sig, size = np.arange(1, n + 1, dtype=np.uint64), np.full(n, 10, np.uint64)
    rec, g = np.repeat(np.arange(n), [len(x) for x in sets]), np.concatenate(sets).astype(np.uint64)
    order = np.lexsort((rec, g))
    head = np.concatenate([sig, size, np.ones(n, np.uint64)])
    segments = pa.table({"frag": pa.array([0], pa.int32()), "a": pa.array([head.tobytes()], pa.binary()), "b": pa.array([packed.squeeze(g[order], True)], pa.binary()), "c": pa.array([packed.squeeze(rec[order].astype(np.uint32))], pa.binary())})
    pairs = [np.sort(r.choice(n, (10_000, 2)), axis=1) for _ in range(80)]
    wanted = pa.Table.from_batches([packed.rows([jaccard_join._listed(0, k, 1, sig, size.astype(np.int64), np.ones(n, np.uint64), *p.T) for k, p in enumerate(pairs)], jaccard_join._PAIRS)])
    most, partial = [], jaccard_join._partial
    monkeypatch.setattr(jaccard_join, "SLICE", 1500)
    monkeypatch.setattr(jaccard_join, "TOGETHER", 25_000)
    monkeypatch.setattr(jaccard_join, "_partial", lambda g, cut, x, y: most.append(len(x)) or partial(g, cut, x, y))
    out = jaccard_join._overlaps(segments, wanted, {0: 0})
    assert max(most) == 30_000 and out.column("bucket").to_pylist() == list(range(80))
    has = np.zeros((n, 60), int)
    has[rec, g.astype(int)] = 1
    both = has @ has.T
    for a, x in zip(jaccard_join._lists(wanted), packed.cells(out, "shared")):
        assert (packed.loose(x, np.uint32) == both[a.sig[a.x].astype(int) - 1, a.sig[a.y].astype(int) - 1]).all()
