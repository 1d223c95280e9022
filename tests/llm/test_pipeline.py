"""The pipeline against brute force, and the queries' registration."""

import random
import re

import pyarrow as pa
import zstandard

from lodestone.llm import compression_rules, jaccard_join, pareto_mix, scratch, sstable, tokens

from . import fixtures
from .test_near_and_leaks import brute_matches, brute_pairs
from .test_rules_mix_shards import brute_mix, brute_rules


def table():
    r = random.Random(11)
    rows = [(i, fixtures.prose(1000 + i, r.randrange(20, 120)), "en", f"src{i % 6}") for i in range(60)]
    rows += [(100 + i, rows[i][1], "en", "src0") for i in range(5)]
    rows += [(110 + i, rows[10 + i][1].replace("river", "ocean", 1), "en", "src1") for i in range(5)]
    rows += [(120, "The " * 500, "en", "src2"), (121, "", "en", "src2"), (122, None, None, None)]
    items = [(k, " ".join(f"bench{k}x{j}" for j in range(20))) for k in range(3)]
    rows += [(130 + k, rows[20 + k][1] + " " + items[k][1], "fr", "src3") for k in range(3)]
    return [(*x, None if x[1] is None else len(x[1])) for x in rows], items


def test_pipeline_equals_brute_force(spark, tmp_path):
    import corpus_pipeline

    rows, items = table()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = []
    for shard in corpus_pipeline.run(spark, str(tmp_path)).collect():
        got += [(i, v["source"]) for i, v in sstable.Reader(bytes(shard.sstable)).items()]

    left = [x for x in rows if brute_rules(x[1])]
    parent = {x[0]: x[0] for x in left}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in brute_pairs([(x[0], x[1]) for x in left], jaccard_join.THRESHOLD):
        a, b = sorted((top(a), top(b)))
        parent[b] = a
    left = [x for x in left if top(x[0]) == x[0]]
    assert len(left) < 68 and {x[0] for x in left} >= set(range(20))
    hit = {i for i, _ in brute_matches([(x[0], x[1]) for x in left], items, 10)}
    left = [x for x in left if x[0] not in hit]
    want = brute_mix([(x[0], x[3], x[4]) for x in left], pareto_mix.WEIGHTS, pareto_mix.DEFAULT_WEIGHT, pareto_mix.FRACTION, pareto_mix.SEED)
    assert sorted(got) == sorted((i, s) for (i, s, _), n in want.items() for _ in range(n))


def test_stages_keep_columns_and_take_empty_tables(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for docs in (fixtures.docs(spark), fixtures.empty(spark)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = scratch.written(stage(spark, docs, str(tmp_path)), name)
            assert docs.columns == fixtures.empty(spark).columns
        assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).columns[0] == "shard"


def chained(plan):
    """The Python functions of a plan that pull their rows from another one in the same task, and scans of Python objects."""
    above, out = [], []
    for line in plan.splitlines():
        if not (m := re.match(r"([ :+-]*)(?:\*\(\d+\) )?(\w+)(.*)", line)):
            continue
        depth, name = len(m[1]), m[2]
        above = [x for x in above if x[0] < depth]
        if name in ("MapInArrow", "FlatMapGroupsInArrow", "FlatMapCoGroupsInArrow"):
            near = []
            for _, x in reversed(above):
                if "Exchange" in x:
                    break
                near.append(x)
            out += [f"{name} below {x}" for x in near if x.endswith("InArrow")]
        if name == "Scan" and "ExistingRDD" in m[3]:
            out.append("Scan ExistingRDD")
        above.append((depth, name))
    return out


def test_near_duplicates_takes_one_python_worker_a_task(spark, tmp_path, monkeypatch):
    """A chained function takes a second worker for each task, and a table of Python objects a second daemon with workers of its own; both stay, with what they hold."""
    size, plain = jaccard_join._SENT_BYTES[0], scratch.written
    before, seen = spark.conf.get(size), []

    def written(df, name, *done):
        seen.append((name, spark.conf.get(size), chained(df._jdf.queryExecution().executedPlan().toString())))
        return plain(df, name, *done)

    monkeypatch.setattr(scratch, "written", written)
    spark.createDataFrame(table()[0], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents"))
    for hot in (jaccard_join.HOT, 1):
        monkeypatch.setattr(jaccard_join, "HOT", hot)
        seen.clear()
        left = jaccard_join.one_of_each(spark.read.parquet(str(tmp_path / "documents")))
        assert {"active", "candidates", "edges", "close"} <= {n for n, _, _ in seen} and ("dense" in {n for n, _, _ in seen}) == (hot == 1)
        assert [x for x in seen if x[2]] == [] and chained(left._jdf.queryExecution().executedPlan().toString()) == []
        assert {b for n, b, _ in seen if n in ("active", "candidates", "pairs", "close")} == {"4m"} and spark.conf.get(size) == before
        ids = [x[0] for x in table()[0]]
        assert sorted(r.doc_id for r in left.collect()) == sorted({*ids} - {max(x[:2]) for x in brute_pairs([x[:2] for x in table()[0]], jaccard_join.THRESHOLD)})


def test_chained_functions_are_seen(spark):
    once = spark.range(3).mapInArrow(lambda x: x, "id long")
    assert chained(once._jdf.queryExecution().executedPlan().toString()) == [] == chained(once.distinct().mapInArrow(lambda x: x, "id long")._jdf.queryExecution().executedPlan().toString())
    assert chained(once.filter("id > 1").mapInArrow(lambda x: x, "id long")._jdf.queryExecution().executedPlan().toString()) == ["MapInArrow below MapInArrow"]
    assert chained(spark.createDataFrame([], "id long")._jdf.queryExecution().executedPlan().toString()) == ["Scan ExistingRDD"]


def test_stages_give_small_batches():
    """A batch of 10,000 documents isn't returned as one."""
    texts = [fixtures.prose(k, 40) if k % 3 else None for k in range(2500)]
    part = pa.RecordBatch.from_pydict({"doc_id": list(range(2500)), "text": texts})
    assert [x.num_rows for x in tokens.slices(iter([part, part.slice(0, 0), part.slice(0, 7)]))] == [1000, 1000, 500, 7]
    got = list(compression_rules._judged(iter([part]), "text", compression_rules.BANDS, compression_rules.CHUNK, compression_rules.BAD_SHARE, True, None))
    press = zstandard.ZstdCompressor(level=compression_rules.LEVEL, write_content_size=False, write_checksum=False)
    want = [k for k, t in enumerate(texts) if compression_rules.judge((t or "").encode(), press)[3] is None]
    assert max(x.num_rows for x in got) <= 1000 and [i for x in got for i in x.column("doc_id").to_pylist()] == want and want


def test_all_are_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert "pipeline" in names and all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11))
    assert set(__spark_entry__.oracle_sql()) <= set(names)
