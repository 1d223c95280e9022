"""Operators 5, 8 and 9 against brute force and round trips."""

import hashlib
import json
import math
import os

import pytest
import zstandard

from lodestone.llm import compression_rules, pareto_mix, sstable

from . import fixtures


def brute_rules(text):
    data = (text or "").encode()
    if not data:
        return False
    press = zstandard.ZstdCompressor(level=3, write_content_size=False, write_checksum=False)
    inside = lambda b: (lambda r, lo_hi: lo_hi[0] <= r <= lo_hi[1])(len(b) / len(press.compress(b)), compression_rules.band(len(b)))
    chunks = [data[a : a + 4096] for a in range(0, len(data), 4096)] if len(data) > 4096 else []
    return inside(data) and sum(len(c) for c in chunks if not inside(c)) <= 0.3 * len(data)


def test_rules_equal_brute_force(spark):
    docs = fixtures.docs(spark)
    got = compression_rules.decisions(docs).collect()
    assert sorted((str(r.doc_id), r.keep) for r in got) == sorted((str(r[0]), brute_rules(r[1])) for r in fixtures.rows())
    reasons = {r.doc_id: r.reason for r in got}
    assert reasons[5] == reasons[6] == "empty" and reasons[11] == "repetitive" and reasons[10] is None
    kept = compression_rules.kept(docs)
    assert kept.columns == docs.columns
    assert kept.count() == sum(brute_rules(r[1]) for r in fixtures.rows())
    assert compression_rules.kept(fixtures.empty(spark)).count() == 0


def test_bad_chunks_and_noise():
    press = zstandard.ZstdCompressor(level=3)
    half = fixtures.prose(1, 8000) + "again and " * 4000
    assert compression_rules.judge(half.encode(), press)[3] in ("bad_chunks", "repetitive")
    assert compression_rules.judge(os.urandom(9000), press)[3] == "incompressible"


def brute_mix(rows, weights, default, fraction, seed):
    live = {}
    for i, s, n in rows:
        live.setdefault(s, []).append((i, max(0, n or 0)))
    w = {s: weights.get(s, default) for s in live}
    w = {s: x for s, x in w.items() if x > 0}
    out = {}
    for s in w:
        quota = math.floor(fraction * len(rows) * w[s] / sum(w.values()) + 0.5)
        x = [math.floor(1000 * math.sqrt(1 + n)) for _, n in live[s]]
        total, left, places = sum(x), [], quota
        for (i, n), xi in zip(live[s], x):
            e = quota * xi / total
            key = str(i) if i is not None else f"null:{s or ''}:{n}"
            u = (int(hashlib.md5(f"{seed}:{key}".encode()).hexdigest()[:12], 16) + 0.5) / 2**48
            f = e - math.floor(e)
            places -= math.floor(e)
            out[i, s, n] = out.get((i, s, n), 0) + math.floor(e)
            if f > 0:
                left.append((u * (1 - f) / ((1 - u) * f), key, (i, s, n)))
        for _, _, k in sorted(left)[:places]:
            out[k] += 1
    return {k: v for k, v in out.items() if v}


def test_mixture_equals_brute_force(spark):
    rows = [(i, ("a", "b", "c", None)[i % 4], (i * 37) % 900) for i in range(400)] + [(1000, "d", None), (1001, "e", 5)]
    df = spark.createDataFrame([(*r, 9, 9.0) for r in rows], "doc_id long, source string, n_chars long, copies int, q double")
    params = {"weights": {"a": 6.0, "b": 0.5, "e": 0.0}, "default_weight": 1.0, "fraction": 0.9, "seed": 4}
    got = {(r.doc_id, r.source): r.copies for r in pareto_mix.sample(df, **params).collect()}
    want = brute_mix(rows, params["weights"], 1.0, 0.9, 4)
    assert got == {(i, s): c for (i, s, _), c in want.items()}
    assert max(got.values()) > 1 and not any(s == "e" for _, s in got)
    mixed = pareto_mix.mixed(df, **params)
    assert mixed.columns == df.columns and mixed.count() == sum(got.values())
    sizes = {}
    for (_, s), c in got.items():
        sizes[s] = sizes.get(s, 0) + c
    share = sum({"a": 6.0, "b": 0.5, "c": 1, None: 1, "d": 1}.values())
    assert sizes["a"] == math.floor(0.9 * 402 * 6 / share + 0.5)


def test_mixture_of_odd_rows(spark):
    docs = fixtures.docs(spark)
    got = pareto_mix.mixed(docs)
    want = brute_mix([(r[0], r[3], r[4]) for r in fixtures.rows()], pareto_mix.WEIGHTS, 1.0, pareto_mix.FRACTION, pareto_mix.SEED)
    assert got.columns == docs.columns and got.count() == sum(want.values())
    assert pareto_mix.mixed(fixtures.empty(spark)).count() == 0 and pareto_mix.sample(fixtures.empty(spark)).count() == 0


def test_quotas_hold_with_ties(spark):
    """400 rows without an id, equal in source and size, some of them wholly equal; and rows that repeat an id."""
    rows = [(None, "a", 50, f"text {i // 2}") for i in range(400)] + [(i % 7, "b", 10, "x") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, source string, n_chars long, text string").repartition(7)
    params = {"weights": {"a": 2.0, "b": 1.0}, "fraction": 0.5, "seed": 3}
    mixed = pareto_mix.mixed(df, **params)
    assert {r.source: r["count"] for r in mixed.groupBy("source").count().collect()} == {"a": 233, "b": 117}
    assert sorted(map(tuple, mixed.collect()), key=str) == sorted(map(tuple, pareto_mix.mixed(df.repartition(2), **params).collect()), key=str)
    assert sum(r.copies for r in pareto_mix.sample(df, **params).collect()) == 350


def test_mixture_carries_columns_of_any_name(spark):
    rows = [(i, "ab"[i % 2], 10 * i, i, i, {"k": "v"}, "t") for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, source string, n_chars long, __mix_u int, `a.b` int, m map<string,string>, __mix_row string")
    got = pareto_mix.mixed(df, weights={}, fraction=0.5)
    assert got.columns == df.columns and got.count() == 26
    assert all(r["a.b"] == r["__mix_u"] == r.doc_id for r in got.collect())


def test_inclusion_follows_the_odds(spark):
    """Over many seeds a document's mean number of copies is near its expectation."""
    rows = [(i, "a", 100 if i < 10 else 2500) for i in range(20)]
    total = {}
    for seed in range(300):
        for k, c in brute_mix(rows, {}, 1.0, 0.4, seed).items():
            total[k[0]] = total.get(k[0], 0) + c / 300
    small, large = sum(total.get(i, 0) for i in range(10)) / 10, sum(total.get(i, 0) for i in range(10, 20)) / 10
    x = (math.floor(1000 * math.sqrt(101)), math.floor(1000 * math.sqrt(2501)))
    assert small == pytest.approx(8 * x[0] / (10 * sum(x)), abs=0.05) and large == pytest.approx(8 * x[1] / (10 * sum(x)), abs=0.05)


def test_tables_round_trip(spark):
    docs = fixtures.docs(spark)
    shards = sstable.tables(docs).collect()
    found = []
    for r in shards:
        reader = sstable.Reader(bytes(r.sstable))
        keys = [sstable.key_of(i) for i, _ in reader.items()]
        assert keys == sorted(keys) and reader.count == len(keys) == r.n_docs
        found += [(i, json.dumps(v, sort_keys=True)) for i, v in reader.items()]
    names = fixtures.SCHEMA.replace(",", "").split()[::2]
    want = [(r[0], json.dumps(dict(zip(names[1:], r[1:])), sort_keys=True)) for r in fixtures.rows()]
    assert sorted(found, key=str) == sorted(want, key=str)
    table = sstable.tables(docs)
    assert [v["text"] for v in sstable.lookup(table, [10])] == [fixtures.rows()[10][1]]
    assert len(sstable.lookup(table, [3])) == 2 and len(sstable.lookup(table, [None])) == 2 and sstable.lookup(table, [777, -1]) == []
    assert sstable.tables(fixtures.empty(spark)).count() == 0
    assert sstable.documents(table).count() == len(fixtures.rows())


def test_lookup_in_a_table_of_many_blocks():
    w = sstable.Writer()
    ids = list(range(-500, 3000, 3))
    for i in ids:
        w.add(sstable.key_of(i), json.dumps({"v": "x" * 300 + str(i)}).encode())
    reader = sstable.Reader(w.finish())
    assert len(reader.places) > 5
    assert all(reader.get(i)[0]["v"].endswith("x" + str(i)) for i in ids)
    assert all(reader.get(i) == [] for i in range(-499, 2990, 3))
    assert sum(reader.may_hold(sstable.key_of(i)) for i in range(10**6, 10**6 + 2000)) < 60
    with pytest.raises(ValueError):
        sstable.Reader(w.finish()[:-1] + b"x")
