"""Contracts of the data-flow operators."""

import gzip
import hashlib
import random
import string
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace import queries
from millrace.functions.digest import md5_mod, mod
from millrace.functions.rng import array_generator, array_uniform, generator, native_uniform, uniform
from millrace.operators import partition as P
from millrace.operators.lookup import both_ways, lookup
from millrace.operators.mapreduce import map_data, reduce_data, reducemap_data, with_splits
from millrace.plans import counting, misc, walks
from millrace.plans.jobs import Jobs
from millrace.plans.program import Program, iterate, main, produce_consume
from millrace.session import Options
from millrace.sources import codecs, lines, pairs
from millrace.sources.files import Files

TEXT = ["It was a time,\n", "it was the TIME:\n", "\n", "-- a 'word' -- the end"]


@pytest.fixture
def corpus(tmp_path):
    for i in range(3):
        (tmp_path / f"part{i}.txt").write_text("".join(TEXT))
    return [str(tmp_path / f"part{i}.txt") for i in range(3)]


def expected(times):
    words = Counter(w for t in TEXT for w in (x.strip(string.punctuation).lower() for x in t.split()) if w)
    return {w: n * times for w, n in words.items()}


def test_lines_have_numbers_and_ends(spark, tmp_path):
    (tmp_path / "a").write_bytes("line 1\nline 2\r\n3\tline\rline ∞\n".encode())
    got = lines.read_lines(spark, str(tmp_path / "a")).orderBy("key").collect()
    assert [(r.key, r.value) for r in got] == [(0, "line 1\n"), (1, "line 2\n"), (2, "3\tline\n"), (3, "line ∞\n")]


def test_empty_file_and_last_line(spark, tmp_path):
    (tmp_path / "a").write_text("")
    assert lines.read_lines(spark, str(tmp_path / "a")).count() == 0
    (tmp_path / "b").write_text("x\n\ny")
    assert [r.value for r in lines.read_lines(spark, str(tmp_path / "b")).orderBy("key").collect()] == ["x\n", "\n", "y"]


def test_numbered_lines_over_many_blocks(spark, tmp_path):
    (tmp_path / "a").write_text("".join(f"{i}\n" for i in range(3000)))
    (tmp_path / "b").write_text("".join(f"{i}\n" for i in range(10)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        got = lines.numbered_lines(spark, [str(tmp_path / "a"), str(tmp_path / "b")]).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(got) == 3010 and all(str(r.key) == r.value for r in got)


def test_byte_lines(spark, tmp_path):
    (tmp_path / "a").write_bytes(b"\xff\n\x00x")
    assert [(r.key, bytes(r.value)) for r in lines.read_byte_lines(spark, str(tmp_path / "a")).orderBy("key").collect()] == [(0, b"\xff\n"), (1, b"\x00x")]


def test_records(spark, tmp_path):
    import struct

    rows = [(i, i % 5, 2**32 - 1 - i) for i in range(100)]
    (tmp_path / "w").write_bytes(b"".join(struct.pack(">IHI", *r) for r in rows))
    got = lines.read_records(spark, str(tmp_path / "w"), lines.WALK_FORM, lines.WALK_NAMES)
    assert sorted(tuple(r) for r in got.collect()) == rows


def test_records_are_written_a_batch_at_a_time(spark, tmp_path, monkeypatch):
    import struct

    seen, inner = [], pairs.write_binary
    monkeypatch.setattr(pairs, "write_binary", lambda df, *a, **more: (seen.append(df.count()), inner(df, *a, **more)))
    df = spark.range(0, 5000, 1, 2).select("id", (F.col("id") % 7).alias("hop"), (F.lit(2**32 - 1) - F.col("id")).alias("node"))
    pairs.write_records(df, str(tmp_path / "r"), lines.WALK_FORM)
    assert seen[0] < 10
    whole = b"".join(f.read_bytes() for f in sorted((tmp_path / "r").glob("source_0_split_*.bin")))
    assert whole == b"".join(struct.pack(">IHI", i, i % 7, 2**32 - 1 - i) for i in range(5000))
    back = lines.read_records(spark, f"{tmp_path}/r/source_*", lines.WALK_FORM, lines.WALK_NAMES)
    assert sorted(tuple(r) for r in back.collect()) == [(i, i % 7, 2**32 - 1 - i) for i in range(5000)]
    assert "SerializeFromObject" in (plan := back._jdf.queryExecution().optimizedPlan().toString()) and "LogicalRDD" not in plan
    with pytest.raises(Exception, match="format requires|out of range|error"):
        pairs.write_records(spark.range(2**32, 2**32 + 1).select("id"), str(tmp_path / "x"), ">I")


def test_manifest(spark, tmp_path, corpus):
    (tmp_path / "list").write_text("\n".join(corpus) + "\n")
    assert lines.read_manifest(spark, str(tmp_path / "list")) == corpus


def test_grid():
    cells = lines.grid(["a", "", "c", "d"], splits=2, first_source=3, first_split=1)
    assert [(c.source, c.split, c.url) for c in cells] == [(3, 1, "a"), (4, 1, "c"), (4, 2, "d")]
    assert [c.split for c in lines.grid(["a", "b"])] == [0, 1]
    assert [c.split for c in lines.grid(["a", "b", "c", "d"], sources=2)] == [0, 1, 0, 1]


def test_local_data(spark):
    rows = [(i, i * 10) for i in range(9)]
    assert {(r.key, r.split) for r in with_splits(lines.local_data(spark, rows, splits=4)).collect()} == {(i, i % 4) for i in range(9)}
    got = with_splits(lines.local_data(spark, [(4, 0), (5, 0), (7, 3), (9, 1)], splits=4, partition=P.by_mod)).collect()
    assert {r.split: sorted(x.key for x in got if x.split == r.split) for r in got} == {0: [4], 1: [5, 9], 3: [7]}
    with pytest.raises(ValueError):
        lines.local_data(spark, rows, partition=P.by_mod)


@pytest.mark.parametrize("splits", [1, 3, 5])
def test_wordcount_same_for_all_forms(spark, corpus, splits):
    want = expected(3)
    df = lines.read_lines(spark, corpus).repartition(splits)
    assert {r.word: r.n for r in counting.wordcount(df).collect()} == want
    program = counting.WordCount(spark)
    mapped = map_data(df, program.map, "key string, value bigint", splits, combiner=program.combine)
    out = with_splits(reduce_data(mapped, program.reduce, "key string, value bigint"))
    rows = out.collect()
    assert {r.key: r.value for r in rows} == want
    for split in {r.split for r in rows}:  # each partition is sorted by key
        keys = [r.key for r in rows if r.split == split]
        assert keys == sorted(keys)


def test_program_writes_text(spark, corpus, tmp_path):
    out = str(tmp_path / "out")
    assert main(counting.WordCount, ["--splits", "3", *corpus, out], spark) == 0
    got = dict(r.value.split(" ") for r in spark.read.text(out).collect())
    assert {k: int(v) for k, v in got.items()} == expected(3)


def test_bypass(spark):
    class Skip(Program):
        def bypass(self):
            return 7

    assert main(Skip, ["--bypass"], spark) == 7


def test_reducer_keeps_key_and_may_yield_many(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (2, 5), (None, 3), (None, 4)], "key bigint, value bigint")
    got = reduce_data(df, lambda k, vs: [] if k == 2 else [x for v in vs for x in (v, -v)], "key bigint, value bigint").collect()
    assert sorted(r.value for r in got if r.key == 1) == [-2, -1, 1, 2] and not [r for r in got if r.key == 2]
    assert sorted(r.value for r in got if r.key is None) == [-4, -3, 3, 4]


def test_reducemap(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 5)], "key string, value bigint")
    got = reducemap_data(df, lambda k, vs: [sum(vs)], lambda k, v: [(v, k), (v + 1, k)], "key string, value bigint", "key bigint, value string")
    assert sorted((r.key, r.value) for r in got.collect()) == [(3, "a"), (4, "a"), (5, "b"), (6, "b")]


def test_md5_mod(spark):
    words = ["", "a", "word", "été", "x" * 1000]
    for n in (1, 3, 5, 1000003, 2**31 - 1):
        got = spark.createDataFrame([(w,) for w in words], "w string").select("w", md5_mod(F.col("w"), n).alias("p")).collect()
        assert {r.w: r.p for r in got} == {w: int.from_bytes(hashlib.md5(w.encode()).digest(), "little") % n for w in words}


def test_partitioners(spark):
    df = spark.range(-20, 20).select(F.col("id").alias("key"))
    assert all(r.split == r.key % 5 for r in with_splits(P.by_mod(df, 5)).collect())
    assert all(r.split == (r.key + 100) % 3 for r in with_splits(P.by_function(df, 3, lambda k: F.pmod(k + 100, F.lit(3)), native=True)).collect())
    assert all(r.split == r.key * r.key % 3 for r in with_splits(P.by_function(df, 3, lambda k: int(k) * int(k) % 3)).collect())
    sizes = Counter(r.split for r in with_splits(P.round_robin(df, 4, "key")).collect())
    assert set(sizes.values()) == {10}
    assert [r.m for r in df.limit(1).select(mod(F.lit(-3), 5).alias("m")).collect()] == [2]


ROWS = [(b"key 1", b"value 1"), (b"hello", b"world"), (b"the", b"end")]


def test_pair_files(spark, tmp_path):
    df = spark.createDataFrame(ROWS, "key binary, value binary").coalesce(1)
    for kind, size in ((pairs.BIN, 56), (pairs.ZIP, None), (pairs.HEX, 62)):
        out = str(tmp_path / kind)
        pairs.writer_of(pairs.FORMATS.extension(kind))(df, out)
        names = [f for f in (tmp_path / kind).iterdir() if f.name.startswith("source_")]
        assert [f.name for f in names] == [f"source_0_split_0_.{pairs.FORMATS.extension(kind)}"]
        assert size is None or names[0].stat().st_size == size
        for where in ([str(f) for f in names], out):
            assert [(bytes(r.key), bytes(r.value)) for r in pairs.read_pairs(spark, where).collect()] == ROWS


def test_second_append_keeps_the_first(spark, tmp_path):
    df, out = spark.createDataFrame([("k1", 1)], "key string, value bigint"), str(tmp_path / "o")
    pairs.write_binary(df, out)
    pairs.write_binary(df.select(F.lit("k2").alias("key"), "value"), out)
    got = pairs.read_pairs(spark, out, key=codecs.STR, value=codecs.INT).collect()
    assert sorted((r.key, r.value) for r in got) == [("k1", 1), ("k2", 1)] and not list((tmp_path / "o").glob(".pairs*"))
    with pytest.raises(FileExistsError):
        pairs.write_binary(df, out, mode="errorifexists")
    with pytest.raises(Exception):  # nothing is published by a job that fails
        pairs.write_binary(df.union(df.select("key", F.raise_error(F.lit("no")).cast("bigint"))), out)
    assert len(list((tmp_path / "o").glob("source_*"))) == 2


def test_files_of_all_formats_together(spark, tmp_path):
    df = spark.createDataFrame([(7, "x")], "key bigint, value string")
    for kind in (pairs.BIN, pairs.ZIP, pairs.HEX):
        pairs.WRITERS[kind](df, str(tmp_path / kind))
    (tmp_path / "a.txt").write_text("line\n")
    paths = [str(tmp_path / kind) for kind in (pairs.BIN, pairs.ZIP, pairs.HEX)] + [str(tmp_path / "a.txt")]
    got = pairs.read_pairs(spark, paths, key=codecs.INT, value=codecs.STR).collect()
    assert sorted((r.key, r.value) for r in got) == [(0, "line\n"), (7, "x"), (7, "x"), (7, "x")]


def test_formats_of_another_program(spark, tmp_path):
    other = pairs.Formats(binary="abc", binary_mark=b"ABCD")
    pairs.write_binary(spark.createDataFrame(ROWS, "key binary, value binary").coalesce(1), str(tmp_path / "o"), formats=other)
    file = next((tmp_path / "o").glob("*.abc"))
    assert file.read_bytes() == pairs.encode(ROWS, pairs.BIN, other) and file.read_bytes()[:4] == b"ABCD"
    assert pairs.read_pairs(spark, str(file), formats=other).count() == 3


def test_codecs(spark):
    import struct

    df = spark.createDataFrame([(-5, "é", 1.5, None)], "i bigint, s string, x double, n bigint")
    for c, codec, raw in (("i", codecs.INT, b"-5"), ("s", codecs.STR, "é".encode()), ("i", codecs.primitive("<i"), struct.pack("<i", -5)), ("x", codecs.primitive(">d"), struct.pack(">d", 1.5)), ("n", codecs.INT, None), ("n", codecs.primitive(">q"), None)):
        one = df.select(c, codec.to_bytes(F.col(c)).alias("b")).select(c, "b", codec.from_bytes(F.col("b")).alias("back")).first()
        assert one.b == raw and one.back == one[c]
    form = codecs.record(">IHI", ["a", "b", "c"], ["bigint"] * 3)
    row = spark.createDataFrame([((1, 2, 3),)], "r struct<a:bigint,b:bigint,c:bigint>").select(form.to_bytes(F.col("r")).alias("b")).select("b", form.from_bytes(F.col("b")).alias("r")).first()
    assert row.b == struct.pack(">IHI", 1, 2, 3) and tuple(row.r) == (1, 2, 3)
    own = codecs.functions(lambda v: str(v[::-1]).encode(), lambda b: b.decode()[::-1], "string")
    assert df.select(own.from_bytes(own.to_bytes(F.col("s"))).alias("s")).first().s == "é"


def test_empty_partitions_write_no_files(spark, tmp_path):
    df = P.by_number(spark.createDataFrame([(b"a", b"b")], "key binary, value binary"), 5, F.lit(2))
    ext = pairs.FORMATS.binary
    pairs.write_binary(df, str(tmp_path / "o"), source=2)
    assert [f.name for f in (tmp_path / "o").glob("source*")] == [f"source_2_split_2_.{ext}"]
    pairs.write_binary(df, str(tmp_path / "o"), source=3, mode="overwrite")
    assert [f.name for f in (tmp_path / "o").glob("source*")] == [f"source_3_split_2_.{ext}"]


def test_large_partitions_are_several_files(spark, tmp_path):
    rows = spark.range(40).select(F.col("id").alias("key"), F.lit("x" * 10).alias("value")).coalesce(1)
    pairs.write_binary(rows, str(tmp_path / "o"), most=100)
    assert len(list((tmp_path / "o").glob("source_0_split_0_*"))) > 3
    assert pairs.read_pairs(spark, str(tmp_path / "o"), key=codecs.INT).count() == 40


def test_broken_pair_files():
    good = pairs.encode([(b"k", b"v")], pairs.BIN)
    assert list(pairs.decode(good, pairs.BIN)) == [(b"k", b"v")]
    for bad in (b"XXXX" + good[4:], good[:-1], good[:-5], good[:-6]):
        with pytest.raises(ValueError):
            list(pairs.decode(bad, pairs.BIN))
    assert list(pairs.decode(gzip.compress(pairs.FORMATS.zip_mark + good[4:]), pairs.ZIP)) == [(b"k", b"v")]


def test_results_are_kept_as_files(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 5)], "key string, value bigint")
    one, two = str(tmp_path / "map"), str(tmp_path / "reduce")
    mapped = map_data(df, lambda k, v: [(k, v + 1)], "key string, value bigint", splits=3, outdir=one, form=pairs.BIN)
    out = reduce_data(mapped, lambda k, vs: [sum(vs)], "key string, value bigint", outdir=two)
    want = [("a", 2), ("a", 3), ("b", 6)]
    assert sorted((r.key, r.value) for r in pairs.read_pairs(spark, one, key=codecs.STR, value=codecs.INT).collect()) == want
    assert sorted(r.value for r in spark.read.text(two).collect()) == ["a 5", "b 6"] and out.count() == 2


def test_sorted_by_key_and_value(spark):
    df = spark.createDataFrame([("b", 2), ("a", 9), ("b", 1), ("a", 3)], "key string, value bigint")
    got = reduce_data(df, lambda k, vs: vs, "key string, value bigint", splits=1, sort_values=True).collect()
    assert [(r.key, r.value) for r in got] == [("a", 3), ("a", 9), ("b", 1), ("b", 2)]


def test_set_up_partition_and_seed_of_a_program(spark, tmp_path):
    class Job(Program):
        map_schema = reduce_schema = "key bigint, value double"
        partition = staticmethod(P.by_mod)

        def setup(self):
            self.offset = 100

        def map(self, key, value):
            yield self.offset + key, self.random(key).random()

    (tmp_path / "in").write_text("a\nb\n")
    made = Job(spark, [str(tmp_path / "in"), str(tmp_path / "out")], Options(seed=5, splits=3))
    assert {r.key: r.value for r in made.plan().collect()} == {100 + i: random.Random(5 + (i << 64)).random() for i in range(2)}
    assert made.numpy_random(1).rand() == array_generator(5, 1).rand()


def test_file_system(spark, tmp_path):
    fs, top = Files(spark), str(tmp_path / "d")
    assert fs.mkdirs(top) and fs.exists(top) and fs.home()
    fs.create(f"{top}/a", b"some bytes")
    assert fs.read(f"{top}/a") == b"some bytes" and fs.status(f"{top}/a").length == 10
    assert fs.rename(f"{top}/a", f"{top}/b") and [s.path.rsplit("/", 1)[1] for s in fs.list(top)] == ["b"]
    fs.set_permission(f"{top}/b", "600")
    assert fs.status(f"{top}/b").permission == "rw-------" and fs.summary(top)[:2] == (10, 1)
    assert fs.delete(top, True) and not fs.exists(top)
    with pytest.raises(Exception):
        fs.read(f"{top}/b")


def test_draws_do_not_depend_on_partitions(spark):
    ids = spark.range(50)
    one, many = ({r.id: r.u for r in ids.repartition(n).select("id", uniform(7, F.col("id")).alias("u")).collect()} for n in (1, 7))
    assert one == many and one[3] == random.Random(7 + (3 << 64)).random()
    assert generator(1, 2).random() == generator(1, 2, 0).random() != generator(1, 0, 2).random()
    assert array_generator(1, 2).rand() == array_generator(1, 2).rand() != array_generator(2, 2).rand()
    assert array_generator(7, 1, 2).random_sample() == np.random.RandomState([7, 0, 1, 0, 2, 0]).random_sample()
    drawn = {r.id: r.u for r in ids.select("id", array_uniform(7, F.col("id")).alias("u")).collect()}
    assert drawn[3] == array_generator(7, 3).random_sample()
    native = [r.u for r in ids.select(native_uniform(7, F.col("id")).alias("u")).collect()]
    assert all(0 <= u < 1 for u in native) and len(set(native)) == 50


def test_count_series_and_loop(spark):
    first = spark.createDataFrame([(w, n) for n, k in ((1, 53), (2, 21), (3, 3), (4, 3), (5, 1), (8, 1), (11, 1), (12, 1), (16, 1), (18, 1)) for w in range(k)], "w int, n bigint")
    got = {(r.iteration, r["count"]): r.n for r in counting.count_series(first, "n", 3).collect()}
    assert got[1, 53 and 1] == 53 and got[2, 1] == 6 and {k: v for k, v in got.items() if k[0] == 3} == {(3, 1): 2, (3, 2): 1, (3, 6): 1}
    seen = []
    assert counting.count_until_one(first, "n", lambda df: seen.append(df.count())) == 6 and seen[-1] == 1


def test_drivers(spark):
    df, calls = spark.range(1), []
    assert iterate((df, lambda _, i=i: calls.append(i) or (None if i < 3 else False)) for i in range(10)) == 4 and calls == [0, 1, 2, 3]
    left = [[df, df], [df], []]
    assert produce_consume(lambda: left.pop(0), lambda _: True) == 3
    assert produce_consume(lambda: [df], lambda _: False) == 1


def test_jobs(spark):
    jobs = Jobs(spark)
    a, b = jobs.submit(spark.range(10)), jobs.submit(spark.range(20))
    done = set()
    while len(done) < 2:
        done |= {d.group for d in jobs.wait(*[x for x in (a, b) if x.group not in done], timeout=30)}
    assert (a.rows(), b.rows(), jobs.progress(a), a.ready()) == (10, 20, 1.0, True)
    assert sorted(r.id for r in a.data()) == sorted(r.id for r in a.fetchall()) == list(range(10)) and not a.computing()
    assert sorted(r.id for i in range(8) for r in a.splitdata(i)) == list(range(10))
    jobs.close(a)
    bad = jobs.submit(spark.range(1).select(F.raise_error(F.lit("no"))))
    with pytest.raises(Exception):
        while True:
            jobs.wait(bad, timeout=30)
    jobs.shutdown()


def test_halton(spark):
    got = {r.inside: r.n for r in counting.halton_points(spark).collect()}
    assert got == {True: 31414, False: 8586}
    assert counting.halton_points(spark).agg(counting.pi_estimate(None).alias("pi")).first().pi == 3.1414


def _steps(spark, *walk_nodes):
    return spark.createDataFrame([(w, h, n) for w, nodes in enumerate(walk_nodes) for h, n in reversed(list(enumerate(nodes)))], "walk bigint, hop int, node bigint")


def _slow_paths(nodes, name):
    """Paths by the rule in words, for one walk."""
    for i in range(len(nodes)):
        for j in range(i + 1, len(nodes)):
            out, at = [], j
            while at > i:
                out.append(name(nodes[at - 1], nodes[at]))
                at = next(k for k in range(i, at) if nodes[k] == nodes[at - 1])
            if len(out) <= 5:
                yield nodes[i], nodes[j], "-".join(reversed(out))


def test_paths_cut_cycles(spark):
    rng = random.Random(5)
    made = [[1, 2, 3, 1, 4], [1, 2, 1], [1, 2, 3, 4, 5, 6, 7], [3], *[[rng.randrange(4) for _ in range(9)] for _ in range(20)]]
    relation = spark.createDataFrame([(1, 2, "likes"), (2, 3, "knows"), (3, 4, "has")], "s bigint, t bigint, name string")
    names = {(r.s, r.t): r.name for r in both_ways(relation).collect()}
    assert names[2, 1] == "likes_inv"
    got = Counter((r.s, r.t, r.path) for r in walks.walk_paths(_steps(spark, *made), both_ways(relation)).collect())
    assert got == Counter(p for nodes in made for p in _slow_paths(nodes, lambda a, b: names.get((a, b), "UNKNOWN_EDGE")))


def test_ways_are_made_in_one_pass(spark):
    """Spans, starts that are no part of a way, nulls; a walk's steps are read once."""
    rng = random.Random(6)
    made = [[3], [1, None, 2, None, 1], [None, None], [1] * 5, *[[rng.randrange(3) for _ in range(k % 12)] for k in range(40)], list(range(99)), [1] * 101]

    def slow(nodes):
        for i in range(len(nodes)):
            yield nodes[i], nodes[i], "BEGIN"
            for j in range(i + 1, min(len(nodes), i + 7)):
                out, at = [], j
                while at > i:
                    out.append("UNKNOWN_RELATION")
                    before = nodes[at - 1]
                    at = next((k for k in range(i + 1, at) if nodes[k] == before), i) if before is not None else i
                if len(out) <= 6:
                    yield nodes[i], nodes[j], "-" + "-".join(out) + "-"

    relation = spark.createDataFrame([(777, 778, "x")], "s bigint, t bigint, name string")
    paths = walks.walk_paths(_steps(spark, *made), relation, **walks.TWIN)
    assert Counter(tuple(r) for r in paths.collect()) == Counter(p for nodes in made if len(nodes) < 101 for p in slow(nodes))
    plan = paths._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") == 1 and "lambdafunction" not in plan and "Union" not in plan
    assert "SortMergeJoin" not in paths._jdf.queryExecution().executedPlan().toString()


def _slow_stats(spark, d):
    """(s, path, t, p, total, targets) of all walks over nations, as the queries' thresholds have it."""
    table = lambda name: spark.read.parquet(f"{d}/{name}.parquet")
    nation = {r.s_suppkey: r.s_nationkey for r in table("supplier").collect()}
    made = {}
    for r in table("lineitem").select("l_orderkey", "l_linenumber", "l_suppkey").collect():
        made.setdefault(r.l_orderkey, []).append((r.l_linenumber, nation[r.l_suppkey]))
    region, regions = {r.n_nationkey: r.n_regionkey for r in table("nation").collect()}, {r.r_regionkey: r.r_name for r in table("region").collect()}
    name = lambda a, b: "UNKNOWN_EDGE" if a == b or region[a] != region[b] else regions[region[a]] + ("" if a < b else "_inv")
    found = Counter(p for steps in made.values() if len(steps) < 100 for p in _slow_paths([n for _, n in sorted(steps)], name))
    kept = {k: c for k, c in found.items() if c >= 2}
    totals, targets = Counter(), Counter()
    for (s, _, path), c in kept.items():
        totals[s, path] += c
        targets[s, path] += 1
    assert any(len({n for _, n in x}) < len(x) for x in made.values())
    return kept, {(s, path, t, c / totals[s, path], totals[s, path], targets[s, path]) for (s, t, path), c in kept.items() if totals[s, path] >= 3}


def test_path_queries_over_all_walks(spark):
    d = "/root/testdata/sf0.001"
    counts, stats = _slow_stats(spark, d)
    assert {(r.s, r.t, r.path): r.c for r in queries.QUERIES["path_counts"](spark, d).collect()} == counts
    assert {(r.s, r.path, r.t, r.p, r.total, r.targets) for r in queries.QUERIES["normalize_paths"](spark, d).collect()} == stats
    name = {r.n_nationkey: r.n_name for r in spark.read.parquet(f"{d}/nation.parquet").collect()}
    got = queries.QUERIES["matrix_rows"](spark, d).collect()
    assert Counter((r.source, r.target, r.path, r.p) for r in got) == Counter((name[s], name[t], path, p) for s, path, t, p, *_ in stats)


def test_walk_analyzer_from_files(spark, tmp_path):
    import struct

    made = [[1, 2, 3], [1, 2, 4], [1, 2, 3], [9, 2, 9, 2]]
    (tmp_path / "walks").write_bytes(b"".join(struct.pack(">IHI", w, h, n) for w, nodes in enumerate(made) for h, n in enumerate(nodes)))
    (tmp_path / "rel").write_text("1\t2\tlikes\n2\t3\tknows\n")
    (tmp_path / "nodes").write_text("1\tone\n2\ttwo\n3\tthree\n")
    out = str(tmp_path / "out")
    assert main(walks.WalkAnalyzer, ["--relations", str(tmp_path / "rel"), "--nodes", str(tmp_path / "nodes"), "--min-path-count", "1", "--min-total-count", "2", str(tmp_path / "walks"), out], spark) == 0
    got = sorted(r.value for r in spark.read.text(out).collect())
    assert "one two likes 1.00000 3 1" in got and "one three likes-knows 1.00000 2 1" in got and "UNKNOWN_NODE two UNKNOWN_EDGE 1.00000 3 1" in got


def test_long_walks_are_dropped(spark):
    got = {r.walk: len(r.nodes) for r in walks.walk_steps(_steps(spark, range(99), range(100), range(150), [4])).collect()}
    assert got == {0: 99, 3: 1}


def test_walks_are_dealt_by_the_number_of_steps(spark, monkeypatch):
    monkeypatch.setattr(walks, "MOST_STEPS", 200)
    monkeypatch.setattr(walks, "LEAST_STEPS", 50)
    chains = [[(7 * k + j * j) % 11 for j in range(k % 6)] for k in range(500)] + [[1, 2] * 49, [1, 2] * 50, [3] * 99]
    steps = _steps(spark, *chains)
    seen = Counter((c[i], c[j]) for c in chains if len(c) < 100 for i in range(len(c)) for j in range(i + 1, len(c)))
    kept = {p: n for p, n in seen.items() if n > 1}
    of = Counter()
    for (s, _), n in kept.items():
        of[s] += n
    found = walks.conditional_probabilities(steps)
    assert {(r.s, r.t): r.p for r in found.collect()} == {(s, t): n / of[s] for (s, t), n in kept.items()}
    assert found.rdd.getNumPartitions() == 1 + steps.count() // 200 > int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = walks.walk_steps(steps)
    assert max(Counter(r[0] for r in dealt.select(F.spark_partition_id()).collect()).values()) < dealt.count() / 2


def test_conditional_probabilities(spark):
    got = {(r.s, r.t): r.p for r in walks.conditional_probabilities(_steps(spark, [1, 2, 3], [1, 2], [1, 3], [1, 2])).collect()}
    assert got == {(1, 2): 3 / 5, (1, 3): 2 / 5}


def test_matrix(spark):
    counts = spark.createDataFrame([(1, 2, "a", 3), (1, 3, "a", 1), (2, 3, "b", 1)], "s bigint, t bigint, path string, c bigint")
    names = spark.createDataFrame([(1, "one"), (2, "two")], "node bigint, name string")
    rows = walks.matrix_rows(walks.normalised(counts, 4), names)
    assert sorted(tuple(r) for r in walks.matrix_text(rows).collect()) == [("one UNKNOWN_NODE", "a 0.25000 4 2"), ("one two", "a 0.75000 4 2")]


def test_lookup_has_one_value_of_a_key(spark):
    df = spark.createDataFrame([(1,), (1,)], "k int")
    small = spark.createDataFrame([(1, "x"), (1, "y")], "k int, v string")
    assert [tuple(r) for r in lookup(df, small, ["k"], "v", "none").collect()] == [(1, "y"), (1, "y")]


def test_grid_of_files(spark, tmp_path):
    for i in range(4):
        (tmp_path / f"f{i}").write_text(f"{i}\n")
    got = lines.read_grid(spark, lines.grid([str(tmp_path / f"f{i}") for i in range(4)], splits=2))
    assert sorted((r.source, r.split, r.value) for r in got.collect()) == [(0, 0, "0\n"), (0, 1, "1\n"), (1, 0, "2\n"), (1, 1, "3\n")]


def test_urls(spark):
    import http.server
    import threading

    class Answer(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            self.send_response(200)
            self.end_headers()
            self.wfile.write(self.path.encode())

        def log_message(self, *a):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Answer)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    urls = [f"http://127.0.0.1:{server.server_port}/{i}" for i in range(3)]
    assert sorted(bytes(r.content) for r in lines.read_urls(spark, urls).collect()) == [b"/0", b"/1", b"/2"]
    server.shutdown()
    with pytest.raises(ValueError):
        lines.read_urls(spark, ["file:///etc/passwd"])


def test_halton_refuses_large_indexes(spark):
    with pytest.raises(Exception):
        spark.range(3**25, 3**25 + 1).select(counting.halton_inside(F.col("id"))).collect()


def test_lookup_default(spark):
    df = spark.createDataFrame([(1,), (9,)], "k int")
    small = spark.createDataFrame([(1, "x")], "k int, v string")
    assert sorted(tuple(r) for r in lookup(df, small, ["k"], "v", "none").collect()) == [(1, "x"), (9, "none")]


def test_array_draws_are_numpys(spark):
    offsets = [(x, y) for x in (0, 1, 2**31, 2**32 + 5, 2**63 - 1, -1, -(2**63)) for y in (0, 7, -9)] * 120
    df = spark.createDataFrame([(k, *xy) for k, xy in enumerate(offsets)], "i int, x bigint, y bigint").coalesce(1)
    for seed in (0, -3, 2**40 + 1):
        want = {xy: array_generator(seed, *xy).random_sample() for xy in set(offsets)}
        got = df.select("x", "y", array_uniform(seed, F.col("x"), F.col("y")).alias("u")).collect()
        assert len(got) == len(offsets) and all(r.u == want[r.x, r.y] for r in got)
    assert df.where("i < 0").select(array_uniform(1, F.col("x"))).collect() == []


def test_draws_of_the_queries_use_all_partitions(spark):
    drawn = queries.QUERIES["numpy_random"](spark, "/root/testdata/sf0.001")
    plan = drawn._jdf.queryExecution().optimizedPlan().toString()
    assert "Repartition 4" in plan and "Repartition 3" not in plan


def test_objects_and_farm(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "k string, v bigint")
    got = misc.aggregate_objects(df, "k", dict, lambda s, r: {**s, r.v: 1}, lambda k, s: [(k, len(s), max(s))], "k string, n bigint, top bigint")
    assert sorted(tuple(r) for r in got.collect()) == [("a", 2, 2), ("b", 1, 3)]
    assert {r.task: r.result for r in misc.farm(spark, [("square", 3), ("triangle", 4)], 2).collect()} == {0: 9.0, 1: 10.0}
    with pytest.raises(ValueError):
        misc.farm(spark, [("rm -rf", 1)])


def test_objects_of_one_key_are_made_by_many_tasks(spark):
    def add(state, row):
        from pyspark import TaskContext

        return state[0] + 1, state[1] | {TaskContext.get().partitionId()}

    big = (1 << 53) + 1  # a float can't hold it
    df = spark.range(0, 1000, 1, 4).select(F.when(F.col("id") % 10 > 1, F.lit(big)).when(F.col("id") % 10 == 1, F.lit(big + 1)).alias("k"), F.col("id").alias("v"))
    got = misc.aggregate_objects(df, "k", lambda: (0, set()), add, lambda k, s: [(k, s[0], len(s[1]))], "k bigint, n bigint, tasks bigint", lambda a, b: (a[0] + b[0], a[1] | b[1]))
    assert {tuple(r) for r in got.collect()} == {(big, 800, 4), (big + 1, 100, 4), (None, 100, 4)}


def test_reducers_go_through_keys_in_one_pass(spark):
    nan = float("nan")
    df = spark.createDataFrame([(k, v) for k in (nan, None, 0.0, 1.5, -0.0, float("-nan")) for v in (1, 2, None)], "key double, value bigint").repartition(3)
    got = reduce_data(df, lambda k, vs: [next(vs), sum(1 for _ in vs)][1:] if k != 1.5 else [7], "key double, value bigint").collect()
    assert Counter((r.key and str(r.key), r.value) for r in got) == Counter([("nan", 5), (None, 2), (0.0, 5), ("1.5", 7)])
    many = spark.range(60_000).select((F.col("id") % 20_000).alias("key"), F.col("id").alias("value"))
    ends = reduce_data(many, lambda k, vs: [max(vs)], "key bigint, value bigint")
    assert ends.count() == 20_000 and ends.where("value <> key + 40000").count() == 0
    fused = reducemap_data(many, lambda k, vs: [sum(vs)], lambda k, v: [(k % 2, v)] * (k % 3), "value bigint", "odd bigint, total bigint")
    assert fused.agg(F.count(F.lit(1)), F.sum("total")).first() == (19_999, sum((3 * k + 60_000) * (k % 3) for k in range(20_000)))
    for df in (ends, fused):
        assert "FlatMapGroupsInPandas" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_log_times(spark):
    log = ["2014-01-01 00:00:00,000: INFO: Assigning task to worker: map_1, 0", "2014-01-01 00:00:02,500: INFO: Slave 3 report ready: map_1, 0", "junk", "2014-01-01 00:00:01,000: INFO: Assigning task to worker: map_1, 1", "2014-01-01 00:00:02,000: INFO: Slave 4 report ready: map_1, 1"]
    messages = misc.log_messages(spark.createDataFrame([(x,) for x in log], "value string"))
    log += ["2014-01-01 00:00:09,000: INFO: Worker 9 says: map_1, 1"]
    assert [(r.dataset, r.tasks, r.mean_seconds) for r in misc.task_times(messages).collect()] == [("map_1", 2, 1.75)]
    assert [(r.dataset, r.seconds, r.n) for r in misc.dataset_times(messages).collect()] == [("map_1", 2.5, 4)]


def test_log_lines_are_matched_once(spark):
    ends = ["", " \t", "\n", " \r\n", "\u2028", " \x0b\x85", "\u2028 ", "\u2003"]
    log = [f"2014-01-0{k % 9 + 1} 00:00:0{k},007: {level}: {text}{end}" for k, end in enumerate(ends) for level in ("INFO", "a_1", "") for text in ("Assigning a: b, 1: map_1, 07", "Slave 3 report: x, 2: é, 1", "Slave x report: y, 2", "a: b", "")]
    log += ["2014-01-01 00:00:00,00: INFO: a: b, 1", " 2014-01-01 00:00:00,000: INFO: Assigning: b, 1", "2014-01-01 00:00:00,000: INFO:Assigning: b, 1"]
    table = spark.createDataFrame([(x,) for x in log], "value string")
    pattern = r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2},\d{3}): (\w+): (.*?)\s*$"
    part = [F.regexp_extract("value", pattern, i) for i in range(4)]
    want = table.where(F.col("value").rlike(pattern)).select(F.to_timestamp(F.replace(part[1], F.lit(","), F.lit(".")), "yyyy-MM-dd HH:mm:ss.SSS"), part[2], part[3])
    got = misc.log_messages(table)
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect())) and got.count() > 50
    named = table.select(F.lit(None).cast("timestamp").alias("ts"), F.substring("value", 32, 99).alias("message"))
    texts = [r[0] for r in named.select("message").collect()]
    cases = [(begun, *(F.regexp_extract("message", p, i) for i in (1, 2))) for begun, p in ((True, misc.ASSIGNED), (False, misc.REPORTED))]
    whole = [r for (begun, a, b), p in zip(cases, (misc.ASSIGNED, misc.REPORTED)) for r in named.where(F.col("message").rlike(p)).select(F.lit(begun), a, b).collect()]
    assert Counter((r.begun, r.dataset, r.task) for r in misc._tasks(named).collect()) == Counter(map(tuple, whole)) and len(whole) > 5 and texts
    plan = misc._tasks(got)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract" not in plan and plan.count("RLIKE") == 2


def test_stream(spark, tmp_path):
    from millrace.streaming import events

    table = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    stream = events.read_stream(spark, "/root/testdata/sf0.001", table.schema, pattern="events.parquet")
    events.run_available(events.windowed_counts(stream, late="1 hour"), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = spark.read.parquet(str(tmp_path / "out"))
    batch = events.windowed_counts(table)
    assert 0 < got.count() <= batch.count() and got.join(batch, ["start", "event_type", "n"]).count() == got.count()
