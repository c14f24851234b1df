"""Queries of the data-flow operators over the driver's tables, and the same in DuckDB SQL."""

from __future__ import annotations

import string

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pyspark.sql import Window

from millrace.functions.digest import md5_mod, mod
from millrace.functions.rng import array_uniform, native_uniform, uniform
from millrace.functions.text import word_rows
from millrace.operators.lookup import both_ways, tagged_join
from millrace.operators.mapreduce import map_data, reduce_data, reducemap_data, with_splits
from millrace.operators.partition import by_function, by_hash, by_md5, by_mod, round_robin, with_place
from millrace.plans import counting, misc, walks
from millrace.sources import codecs, lines, pairs
from millrace.sources.lines import lines_of, union_sources
from millrace.storage import fresh_path

N = 7
PUNCTUATION = string.punctuation.replace("'", "''")
_WORDS = f"SELECT w FROM (SELECT lower(trim(unnest(regexp_split_to_array(text, '\\s+')), '{PUNCTUATION}')) AS w FROM documents) WHERE w <> ''"


def _t(spark, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def line_reader(spark, d):
    return lines_of(_t(spark, d, "documents"), "text", "doc_id")


def read_lines(spark, d):
    """Texts written as files, and read line by line: how often each line occurs."""
    path = fresh_path(spark, "lines")
    _t(spark, d, "documents").select(F.coalesce("text", F.lit(""))).write.text(path)
    return lines.read_lines(spark, path).groupBy("value").agg(F.count(F.lit(1)).alias("n"))


def numbered_lines(spark, d):
    """One file of keys in order: number and line."""
    path = fresh_path(spark, "numbered")
    _t(spark, d, "nation").coalesce(1).sortWithinPartitions("n_nationkey").select(F.col("n_nationkey").cast("string")).write.text(path)
    return lines.read_lines(spark, path)


def byte_lines(spark, d):
    path = fresh_path(spark, "bytes")
    _t(spark, d, "nation").select("n_name").coalesce(1).sortWithinPartitions("n_name").write.text(path)
    return lines.read_byte_lines(spark, path).select("key", F.hex("value").alias("value"))


def manifest_lines(spark, d):
    """Files that a list names, line by line: the texts of two folders of files."""
    path = fresh_path(spark, "manifest")
    for name, column in (("nation", "n_name"), ("region", "r_name")):
        _t(spark, d, name).select(column).write.text(f"{path}/{name}")
    spark.createDataFrame([(f"{path}/{n}",) for n in ("nation", "region")], "value string").coalesce(1).write.text(f"{path}/list")
    return lines.read_lines(spark, lines.read_manifest(spark, f"{path}/list")).select("value")


def fixed_records(spark, d):
    """Records of 4, 2 and 4 bytes, big-endian: written as files of nothing else, and read back."""
    path = fresh_path(spark, "records")
    pairs.write_records(_t(spark, d, "lineitem").select(F.col("l_orderkey").alias("walk"), F.col("l_linenumber").alias("hop"), F.col("l_suppkey").alias("node")), path, lines.WALK_FORM)
    return lines.read_records(spark, f"{path}/source_*", lines.WALK_FORM, lines.WALK_NAMES)


def _pair_round_trip(kind, key, value):
    def query(spark, d):
        path = fresh_path(spark, "pairs")
        rows = _t(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("value"))
        pairs.WRITERS[kind](rows, path, key=key, value=value)
        return pairs.read_pairs(spark, path, key=key, value=value)

    return query


pair_round_trip_hex = _pair_round_trip(pairs.HEX, codecs.INT, codecs.STR)
pair_round_trip_binary = _pair_round_trip(pairs.BIN, codecs.primitive(">q"), codecs.STR)
pair_round_trip_zip = _pair_round_trip(pairs.ZIP, codecs.INT, codecs.STR)


def pair_text(spark, d):
    """Pairs written as text, and read back as lines."""
    path = fresh_path(spark, "text")
    pairs.write_text(_t(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("value")), path)
    return pairs.read_pairs(spark, path).select("value")


def files_per_split(spark, d):
    """Files of pairs by name: one for each split that has rows."""
    path = fresh_path(spark, "files")
    dealt = by_md5(_t(spark, d, "nation").select(F.col("n_name").alias("key"), F.lit("x").alias("value")), N)
    pairs.write_binary(dealt, path)
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.regexp_extract("path", r"/source_0_split_(\d+)_[.]\w+$", 1).cast("bigint").alias("split"))


def local_data_default(spark, d):
    rows = [(r.n_nationkey, r.n_name) for r in _t(spark, d, "nation").collect()]  # a driver's own pairs
    return lines.local_data(spark, rows, "key bigint, value string")


def local_data_round_robin(spark, d):
    rows = sorted((r.n_nationkey, 0) for r in _t(spark, d, "nation").collect())  # a driver's own pairs
    return with_splits(lines.local_data(spark, rows, splits=4)).select("key", F.col("split").cast("bigint").alias("split"))


def local_data_partitioned(spark, d):
    rows = [(r.n_nationkey, 0) for r in _t(spark, d, "nation").collect()]  # a driver's own pairs
    return with_splits(lines.local_data(spark, rows, splits=4, partition=by_mod)).select("key", F.col("split").cast("bigint").alias("split"))


def enumerated(spark, d):
    """Each order with its place in the order of keys."""
    return with_place(_t(spark, d, "orders").select("o_orderkey"), "o_orderkey")


def round_robin_placed(spark, d):
    dealt = round_robin(_t(spark, d, "orders").select(F.col("o_orderkey").alias("key")), N, "key")
    return with_splits(dealt).select("key", F.col("split").cast("bigint").alias("split"))


def identity_map(spark, d):
    """A generator that hands pairs on."""
    rows = _t(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("value"))

    def same(key, value):
        yield key, value

    return map_data(rows, same, "key bigint, value string")


def union_all(spark, d):
    docs = _t(spark, d, "documents").select(F.lit("d").alias("kind"), F.col("doc_id").alias("key"), F.length("text").cast("bigint").alias("n"))
    items = _t(spark, d, "benchmark").select(F.lit("b").alias("kind"), F.col("item_id").alias("key"), F.length("text").cast("bigint").alias("n"))
    return union_sources(docs, items)


def map_filter(spark, d):
    return map_data(_t(spark, d, "events"), lambda df: df.where((F.col("event_type") == "click") & (F.col("value") > 10)).select(F.col("user_id").alias("key"), F.col("value")))


def wordcount(spark, d):
    return counting.wordcount(_t(spark, d, "documents"), "text")


def wordcount_combiner(spark, d):
    """By Python generators with a combiner in each task."""
    pairs = _t(spark, d, "documents").select(F.col("doc_id").alias("key"), F.col("text").alias("value"))
    strip = string.punctuation

    def split(_, text):
        for w in text.split():
            if w := w.strip(strip).lower():
                yield w, 1

    def add(_, counts):
        yield sum(counts)

    mapped = map_data(pairs, split, "key string, value bigint", combiner=add)
    return reduce_data(mapped, [F.sum("value").alias("n")]).withColumnRenamed("key", "word")


def reduce_multi_output(spark, d):
    pairs = _t(spark, d, "orders").select(F.col("o_custkey").alias("key"), F.col("o_totalprice").alias("value"))
    ends = reduce_data(pairs, [F.min("value").alias("lo"), F.max("value").alias("hi")])
    return ends.select("key", F.explode(F.array("lo", "hi")).alias("value"))


def reduce_python(spark, d):
    """A generator that yields none, one or two values for a key."""
    pairs = _t(spark, d, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("value"))

    def ends(_, values):
        got = list(values)
        known = sorted(v for v in got if v is not None) or [None]
        if len(got) > 1:
            yield from (known[0], known[-1])

    return reduce_data(pairs, ends, "key bigint, value bigint")


def reduce_sum_by_key(spark, d):
    pairs = _t(spark, d, "lineitem").select(F.col("l_suppkey").alias("key"), F.col("l_quantity").cast("bigint").alias("value"))
    return reduce_data(pairs, [F.sum("value").alias("total")])


def reducemap_fused(spark, d):
    pairs = _t(spark, d, "orders").select(F.col("o_custkey").alias("key"), F.lit(1).alias("value"))
    fused = reducemap_data(pairs, [F.count(F.lit(1)).alias("value")], lambda r: r.select(F.col("value").alias("key"), F.lit(1).alias("one")))
    return fused.groupBy(F.col("key").alias("orders_per_customer")).agg(F.count(F.lit(1)).alias("customers"))


def distinct_keys(spark, d):
    return _t(spark, d, "events").select("user_id", "event_type").distinct()


def global_count(spark, d):
    return _t(spark, d, "lineitem").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("l_quantity").cast("bigint")).alias("quantity"))


def tagged_join_(spark, d):
    joined = tagged_join(_t(spark, d, "orders"), _t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return joined.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))


def md5_partition(spark, d):
    """Where words really are after they were dealt out by MD5."""
    keys = word_rows(_t(spark, d, "documents"), "text", "key").distinct()
    return with_splits(by_md5(keys, N)).select(F.col("key").alias("word"), F.col("split").cast("bigint").alias("split"))


def md5_partition_int(spark, d):
    keys = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("key")).distinct()
    return with_splits(by_md5(keys, N)).select("key", F.col("split").cast("bigint").alias("split"))


def hash_partition(spark, d):
    """Equal keys meet: in how many partitions each key is."""
    dealt = with_splits(by_hash(_t(spark, d, "lineitem").select(F.col("l_orderkey").alias("key")), N))
    return dealt.groupBy("key").agg(F.count_distinct("split").alias("places"), F.count(F.lit(1)).alias("n"))


def user_partition(spark, d):
    """By a Python function of the key."""
    keys = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("key")).distinct()
    return with_splits(by_function(keys, N, lambda k: int(k) * int(k) % N)).select("key", F.col("split").cast("bigint").alias("split"))


def mod_partition(spark, d):
    """Numbers of partitions as a column."""
    keys = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("key")).distinct()
    return keys.select("key", mod(F.col("key"), N).alias("split"))


def mod_partition_placed(spark, d):
    """Where rows really are after they were dealt out."""
    keys = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("key")).distinct()
    return with_splits(by_mod(keys, N)).select("key", F.col("split").cast("bigint").alias("split"))


def partition_sizes(spark, d):
    keys = _t(spark, d, "customer").select(F.col("c_name").alias("key"))
    return keys.groupBy(md5_mod(F.col("key"), N).alias("split")).agg(F.count(F.lit(1)).alias("n"))


def sorted_within_partition(spark, d):
    """Place of each row in its partition, as in the files of a reduce: sorted by key, and by value for equal keys."""
    rows = _t(spark, d, "lineitem").select(F.col("l_partkey").cast("string").alias("key"), F.col("l_orderkey").alias("value")).distinct()
    dealt = by_md5(rows, N).sortWithinPartitions("key", "value")
    return dealt.select("key", "value", (F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("bigint"), 33)).alias("place"), F.spark_partition_id().cast("bigint").alias("split"))


def first_n_per_key(spark, d):
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_suppkey", "l_partkey", "l_quantity", "l_extendedprice")
    return _t(spark, d, "lineitem").withColumn("i", F.row_number().over(order).cast("bigint")).where("i <= 3").select("l_orderkey", "i", "l_linenumber", "l_suppkey")


def count_of_counts(spark, d):
    """The loop, until a round has one row: (iteration, count, n) of every round."""
    rounds: list = []
    counting.count_until_one(wordcount(spark, d), "n", rounds.append)
    return union_sources(*[r.select(F.lit(i).alias("iteration"), "count", "n") for i, r in enumerate(rounds, 1)])


def count_series(spark, d):
    """Three rounds in one plan."""
    return counting.count_series(wordcount(spark, d), "n", 3)


def halton_pi(spark, d):
    return counting.halton_points(spark)


def _steps(spark, d):
    return _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("walk"), F.col("l_linenumber").alias("hop"), F.col("l_suppkey").alias("node"))


def conditional_prob(spark, d):
    return walks.conditional_probabilities(_steps(spark, d), 2)


def _nation_steps(spark, d):
    supp = _t(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("nation"))
    return _steps(spark, d).join(supp, F.col("node") == F.col("s_suppkey")).select("walk", "hop", F.col("nation").alias("node"))


def _relation(spark, d):
    """Nations of a region, the lesser key first, named by the region; and back."""
    a = _t(spark, d, "nation").select(F.col("n_nationkey").alias("s"), F.col("n_regionkey").alias("r"))
    b = a.select(F.col("s").alias("t"), "r")
    pairs = a.join(b, "r").where("s < t").join(_t(spark, d, "region"), F.col("r") == F.col("r_regionkey"))
    return both_ways(pairs.select("s", "t", F.col("r_name").alias("name")))


def path_counts(spark, d):
    """Of all walks, with cycles cut out of their paths."""
    return walks.path_counts(walks.walk_paths(_nation_steps(spark, d), _relation(spark, d)), 2)


def path_counts_twin(spark, d):
    """By the parameters of the analyzer for Hadoop."""
    return walks.path_counts(walks.walk_paths(_nation_steps(spark, d), _relation(spark, d), **walks.TWIN), 2)


def normalize_paths(spark, d):
    return walks.normalised(path_counts(spark, d), 3)


def matrix_rows(spark, d):
    names = _t(spark, d, "nation").select(F.col("n_nationkey").alias("node"), F.col("n_name").alias("name"))
    return walks.matrix_rows(normalize_paths(spark, d), names)


def group_aggregate_native(spark, d):
    return misc.document_topics(_t(spark, d, "documents"))


def group_aggregate_object(spark, d):
    """An accumulator of one's own for each language, row by row."""

    def add(state, row):
        n = len(row.text or "")
        return [state[0] + 1, state[1] + n, max(state[2], n), min(state[3], n)]

    def merge(a, b):
        return [a[0] + b[0], a[1] + b[1], max(a[2], b[2]), min(a[3], b[3])]

    docs = _t(spark, d, "documents").select("lang", "text")
    return misc.aggregate_objects(docs, "lang", lambda: [0, 0, 0, 1 << 60], add, lambda k, s: [(k, *s)], "lang string, n_docs bigint, n_chars bigint, longest bigint, shortest bigint", merge)


def document_map(spark, d):
    """Topics of every document by a parser in Python, summed up: here words by their first letter."""

    def parse(text):
        out: dict = {}
        for w in text.split():
            if "a" <= w[0] <= "z":
                n, longest = out.get(w[0], (0, 0))
                out[w[0]] = (n + 1, max(longest, len(w)))
        return out

    found = misc.map_documents(_t(spark, d, "documents"), parse, "n bigint, longest bigint")
    return found.groupBy("topic").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("words"), F.max("longest").alias("longest"))


def job_farm(spark, d):
    names = sorted(misc.JOBS)
    return misc.farm(spark, [(names[i % 3], i) for i in range(300)], splits=8)


def _drawn(draw):
    """(id, inside, same): whether a draw is in [0, 1), and the same in another partitioning."""

    def query(spark, d):
        ids = _t(spark, d, "customer").select(F.col("c_custkey").alias("id"))
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))  # two numbers that differ, and grow with the cluster
        one = ids.repartition(max(3, n)).select("id", draw(42, F.col("id")).alias("u"))
        two = ids.repartition(max(5, n + 1), "id").select("id", draw(42, F.col("id")).alias("v"))
        return one.join(two, "id").select("id", ((F.col("u") >= 0) & (F.col("u") < 1)).alias("inside"), (F.col("u") == F.col("v")).alias("same"))

    return query


seeded_random, numpy_random, native_random = map(_drawn, (uniform, array_uniform, native_uniform))


def _log(spark, d):
    """A run's log, made from line items: each is a task of its order's priority, given out and reported."""
    rows = _t(spark, d, "lineitem").join(_t(spark, d, "orders").select("o_orderkey", "o_orderpriority"), F.col("l_orderkey") == F.col("o_orderkey"))
    name = F.concat(F.lit("d"), F.substring("o_orderpriority", 1, 1))
    task = F.concat(name, F.lit(", "), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("string"))
    at = lambda n: F.date_format(F.timestamp_seconds(F.lit(1_400_000_000) + F.col("l_orderkey") % 1000 + n), "yyyy-MM-dd HH:mm:ss")
    begun = F.concat(at(F.lit(0)), F.lit(",000: INFO: Assigning task to worker 1: "), task)
    over = F.concat(at(F.col("l_linenumber")), F.lit(",500: INFO: Slave 1 report ready: "), task)
    return misc.log_messages(rows.select(F.explode(F.array(begun, over)).alias("value")))


def log_task_times(spark, d):
    return misc.task_times(_log(spark, d))


def log_dataset_times(spark, d):
    return misc.dataset_times(_log(spark, d)).select("dataset", "n", "seconds")


def interval_times(spark, d):
    return misc.intervals(_t(spark, d, "events"), "event_type")


NAMES = """
    line_reader read_lines numbered_lines byte_lines manifest_lines fixed_records pair_round_trip_hex pair_round_trip_binary
    pair_round_trip_zip pair_text files_per_split local_data_default local_data_round_robin local_data_partitioned enumerated
    round_robin_placed identity_map union_all map_filter wordcount wordcount_combiner reduce_multi_output reduce_python
    reduce_sum_by_key reducemap_fused distinct_keys global_count tagged_join md5_partition md5_partition_int hash_partition
    user_partition mod_partition mod_partition_placed partition_sizes sorted_within_partition first_n_per_key count_of_counts
    count_series halton_pi conditional_prob path_counts path_counts_twin normalize_paths matrix_rows group_aggregate_native
    group_aggregate_object document_map job_farm seeded_random numpy_random native_random log_task_times log_dataset_times
    interval_times
"""
QUERIES = {n: globals()[n if n != "tagged_join" else "tagged_join_"] for n in NAMES.split()}

_WORDCOUNT = f"SELECT w AS word, count(*) AS n FROM ({_WORDS}) GROUP BY w"
_STEP = "SELECT l_orderkey AS walk, l_linenumber AS hop, l_suppkey AS node FROM lineitem"
_WALKS = """
WITH RECURSIVE rel0 AS (
  SELECT a.n_nationkey AS s, b.n_nationkey AS t, r_name AS name FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey JOIN region ON a.n_regionkey = r_regionkey
), rel AS (
  SELECT s, t, name FROM rel0 UNION ALL SELECT t, s, name || '_inv' FROM rel0
), steps AS (
  SELECT l_orderkey AS walk, s_nationkey AS node, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, s_nationkey) AS i FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
), good AS (
  SELECT walk, node, i FROM steps WHERE walk IN (SELECT walk FROM steps GROUP BY walk HAVING count(*) < {most})
), e AS (
  SELECT a.walk, a.i, coalesce(name, '{unknown}') AS name FROM good a JOIN good b ON a.walk = b.walk AND b.i = a.i + 1 LEFT JOIN rel ON a.node = rel.s AND b.node = rel.t
), f AS (
  SELECT a.walk, a.i AS i, b.i AS p, CASE WHEN b.i = a.i THEN a.i ELSE min(c.i) END AS k
  FROM good a JOIN good b ON a.walk = b.walk AND b.i >= a.i LEFT JOIN good c ON c.walk = b.walk AND c.node = b.node AND c.i <= b.i AND c.i >= a.i + {from_next} GROUP BY a.walk, a.i, b.i
), r AS (
  SELECT a.walk, a.i, b.i AS j, a.node AS s, b.node AS t, b.i AS pos, '' AS path, 0 AS n FROM good a JOIN good b ON a.walk = b.walk AND b.i > a.i AND b.i <= a.i + {span}
  UNION ALL
  SELECT r.walk, r.i, r.j, r.s, r.t, f.k, CASE WHEN r.n = 0 THEN e.name ELSE e.name || '-' || r.path END, r.n + 1
  FROM r JOIN e ON e.walk = r.walk AND e.i = r.pos - 1 JOIN f ON f.walk = r.walk AND f.i = r.i AND f.p = r.pos - 1 WHERE r.pos > r.i AND r.n <= {edges}
), paths AS (
  SELECT s, t, '{ends}' || path || '{ends}' AS path FROM r WHERE pos = i AND n BETWEEN 1 AND {edges} {begin}
), counts AS (
  SELECT s, t, path, count(*) AS c FROM paths GROUP BY s, t, path HAVING count(*) >= 2
), stats AS (
  SELECT s, path, t, c::DOUBLE / CAST(sum(c) OVER k AS DOUBLE) AS p, CAST(sum(c) OVER k AS BIGINT) AS total, count(*) OVER k AS targets FROM counts WINDOW k AS (PARTITION BY s, path)
)
"""
_PATHS = _WALKS.format(most=100, unknown="UNKNOWN_EDGE", from_next=0, span=1000, edges=5, ends="", begin="")
_TWIN = _WALKS.format(most=101, unknown="UNKNOWN_RELATION", from_next=1, span=6, edges=6, ends="-", begin="UNION ALL SELECT g.node, g.node, 'BEGIN' FROM good g WHERE g.walk IN (SELECT walk FROM good)")
_DRAWN = "SELECT c_custkey AS id, true AS inside, true AS same FROM customer"
_CUSTOMERS = "SELECT c_custkey AS key, c_name AS value FROM customer"
_LOG = "SELECT l_orderkey * 10 + l_linenumber AS task, 'd' || substr(o_orderpriority, 1, 1) AS dataset, 1400000000 + l_orderkey % 1000 AS first, 1400000000 + l_orderkey % 1000 + l_linenumber + 0.5::DOUBLE AS last FROM lineitem JOIN orders ON l_orderkey = o_orderkey"

ORACLES = {
    "line_reader": """
        WITH t AS (SELECT doc_id, string_split(replace(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)) AS p FROM documents),
        u AS (SELECT doc_id, unnest(p) AS line, generate_subscripts(p, 1) - 1 AS key, len(p) AS n FROM t)
        SELECT doc_id, key::BIGINT AS key, CASE WHEN key < n - 1 THEN line || chr(10) ELSE line END AS value FROM u WHERE key < n - 1 OR line <> ''""",
    "read_lines": r"""
        WITH t AS (SELECT unnest(string_split(replace(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10))) AS line FROM documents)
        SELECT line || chr(10) AS value, count(*) AS n FROM t GROUP BY 1""",
    "numbered_lines": "SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS key, n_nationkey::VARCHAR || chr(10) AS value FROM nation",
    "byte_lines": "SELECT row_number() OVER (ORDER BY n_name) - 1 AS key, hex(n_name || chr(10)) AS value FROM nation",
    "manifest_lines": "SELECT n_name || chr(10) AS value FROM nation UNION ALL SELECT r_name || chr(10) FROM region",
    "fixed_records": "SELECT l_orderkey AS walk, l_linenumber::BIGINT AS hop, l_suppkey AS node FROM lineitem",
    "pair_round_trip_hex": _CUSTOMERS,
    "pair_round_trip_binary": _CUSTOMERS,
    "pair_round_trip_zip": _CUSTOMERS,
    "pair_text": "SELECT c_custkey::VARCHAR || ' ' || c_name || chr(10) AS value FROM customer",
    "files_per_split": f"SELECT DISTINCT (md5_number(n_name) % {N})::BIGINT AS split FROM nation",
    "local_data_default": "SELECT n_nationkey AS key, n_name AS value FROM nation",
    "local_data_round_robin": "SELECT n_nationkey AS key, (row_number() OVER (ORDER BY n_nationkey) - 1) % 4 AS split FROM nation",
    "local_data_partitioned": "SELECT n_nationkey AS key, n_nationkey % 4 AS split FROM nation",
    "enumerated": "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS place FROM orders",
    "round_robin_placed": f"SELECT o_orderkey AS key, (row_number() OVER (ORDER BY o_orderkey) - 1) % {N} AS split FROM orders",
    "identity_map": _CUSTOMERS,
    "union_all": "SELECT 'd' AS kind, doc_id AS key, length(text)::BIGINT AS n FROM documents UNION ALL SELECT 'b', item_id, length(text)::BIGINT FROM benchmark",
    "map_filter": "SELECT user_id AS key, value FROM events WHERE event_type = 'click' AND value > 10",
    "wordcount": _WORDCOUNT,
    "wordcount_combiner": _WORDCOUNT,
    "reduce_multi_output": "SELECT o_custkey AS key, min(o_totalprice) AS value FROM orders GROUP BY 1 UNION ALL SELECT o_custkey, max(o_totalprice) FROM orders GROUP BY 1",
    "reduce_python": "WITH g AS (SELECT o_custkey AS key, min(o_orderkey) AS lo, max(o_orderkey) AS hi FROM orders GROUP BY 1 HAVING count(*) > 1) SELECT key, lo AS value FROM g UNION ALL SELECT key, hi FROM g",
    "reduce_sum_by_key": "SELECT l_suppkey AS key, sum(l_quantity::BIGINT)::BIGINT AS total FROM lineitem GROUP BY 1",
    "reducemap_fused": "SELECT c AS orders_per_customer, count(*) AS customers FROM (SELECT count(*) AS c FROM orders GROUP BY o_custkey) GROUP BY c",
    "distinct_keys": "SELECT DISTINCT user_id, event_type FROM events",
    "global_count": "SELECT count(*) AS n, sum(l_quantity::BIGINT)::BIGINT AS quantity FROM lineitem",
    "tagged_join": "SELECT c_mktsegment, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1",
    "md5_partition": f"SELECT w AS word, (md5_number(w) % {N})::BIGINT AS split FROM (SELECT DISTINCT w FROM ({_WORDS}))",
    "mod_partition": f"SELECT DISTINCT l_orderkey AS key, l_orderkey % {N} AS split FROM lineitem",
    "mod_partition_placed": f"SELECT DISTINCT l_orderkey AS key, l_orderkey % {N} AS split FROM lineitem",
    "partition_sizes": f"SELECT (md5_number(c_name) % {N})::BIGINT AS split, count(*) AS n FROM customer GROUP BY 1",
    "md5_partition_int": f"SELECT DISTINCT l_orderkey AS key, (md5_number(l_orderkey::VARCHAR) % {N})::BIGINT AS split FROM lineitem",
    "hash_partition": "SELECT l_orderkey AS key, 1::BIGINT AS places, count(*) AS n FROM lineitem GROUP BY 1",
    "user_partition": f"SELECT DISTINCT l_orderkey AS key, (l_orderkey * l_orderkey) % {N} AS split FROM lineitem",
    "sorted_within_partition": f"SELECT key, value, split, row_number() OVER (PARTITION BY split ORDER BY key, value) - 1 AS place FROM (SELECT DISTINCT l_partkey::VARCHAR AS key, l_orderkey AS value, (md5_number(l_partkey::VARCHAR) % {N})::BIGINT AS split FROM lineitem)",
    "first_n_per_key": "SELECT l_orderkey, i, l_linenumber, l_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_partkey, l_quantity, l_extendedprice) AS i FROM lineitem) WHERE i <= 3",
    "count_of_counts": f"""
        WITH RECURSIVE w AS ({_WORDCOUNT}), r AS (
          SELECT 1 AS iteration, n AS count, count(*) AS n FROM w GROUP BY n
          UNION ALL
          SELECT iteration + 1, n, count(*) FROM r GROUP BY iteration, n HAVING (SELECT count(*) FROM r) > 1
        ) SELECT iteration, count, n FROM r""",
    "count_series": f"WITH w AS ({_WORDCOUNT}), a AS (SELECT n AS count, count(*) AS n FROM w GROUP BY 1), b AS (SELECT n AS count, count(*) AS n FROM a GROUP BY 1), c AS (SELECT n AS count, count(*) AS n FROM b GROUP BY 1) SELECT 1 AS iteration, * FROM a UNION ALL SELECT 2, * FROM b UNION ALL SELECT 3, * FROM c",
    "halton_pi": """
        WITH d AS (SELECT i, (SELECT sum(((i // (2::BIGINT ** k)::BIGINT) % 2)::DOUBLE / 2.0 ** (k + 1)) FROM range(0, 17) t(k)) AS x, (SELECT sum(((i // (3 ** k)::BIGINT) % 3)::DOUBLE / 3.0 ** (k + 1)) FROM range(0, 11) t(k)) AS y FROM range(1, 40001) r(i))
        SELECT (x - 0.5) * (x - 0.5) + (y - 0.5) * (y - 0.5) <= 0.25 AS inside, count(*) AS n FROM d GROUP BY 1""",
    "conditional_prob": f"WITH w AS (SELECT walk, node, row_number() OVER (PARTITION BY walk ORDER BY hop, node) AS i FROM ({_STEP})), g AS (SELECT walk FROM w GROUP BY walk HAVING count(*) < 100), c AS (SELECT a.node AS s, b.node AS t, count(*) AS c FROM w a JOIN w b ON a.walk = b.walk AND a.i < b.i WHERE a.walk IN (SELECT walk FROM g) GROUP BY 1, 2 HAVING count(*) >= 2) SELECT s, t, c::DOUBLE / CAST(sum(c) OVER (PARTITION BY s) AS DOUBLE) AS p FROM c",
    "path_counts": _PATHS + "SELECT s, t, path, c FROM counts",
    "path_counts_twin": _TWIN + "SELECT s, t, path, c FROM counts",
    "normalize_paths": _PATHS + "SELECT s, path, t, p, total, targets FROM stats WHERE total >= 3",
    "matrix_rows": _PATHS + "SELECT coalesce(a.n_name, 'UNKNOWN_NODE') AS source, coalesce(b.n_name, 'UNKNOWN_NODE') AS target, path, p, total, targets FROM stats LEFT JOIN nation a ON s = a.n_nationkey LEFT JOIN nation b ON t = b.n_nationkey WHERE total >= 3",
    "group_aggregate_object": "SELECT lang, count(*) AS n_docs, sum(length(coalesce(text, '')))::BIGINT AS n_chars, max(length(coalesce(text, '')))::BIGINT AS longest, min(length(coalesce(text, '')))::BIGINT AS shortest FROM documents GROUP BY 1",
    "document_map": r"""
        WITH w AS (SELECT doc_id, unnest(regexp_split_to_array(text, '\s+')) AS w FROM documents)
        SELECT substr(w, 1, 1) AS topic, count(DISTINCT doc_id) AS docs, count(*) AS words, max(length(w))::BIGINT AS longest FROM w WHERE substr(w, 1, 1) BETWEEN 'a' AND 'z' AND regexp_matches(w, '^[a-z]') GROUP BY 1""",
    "seeded_random": _DRAWN,
    "numpy_random": _DRAWN,
    "native_random": _DRAWN,
    "log_task_times": f"SELECT dataset, count(*) AS tasks, avg(s) AS mean_seconds FROM (SELECT dataset, task, max(last) - max(first) AS s FROM ({_LOG}) GROUP BY 1, 2) GROUP BY 1",
    "log_dataset_times": f"SELECT dataset, 2 * count(*) AS n, max(last) - min(first) AS seconds FROM ({_LOG}) GROUP BY 1",
    "group_aggregate_native": "SELECT lang, source, count(*) AS n_docs, sum(length(text))::BIGINT AS n_chars, max(length(text))::BIGINT AS longest, min(length(text))::BIGINT AS shortest, count(DISTINCT n_chars) AS n_sizes FROM documents GROUP BY 1, 2",
    "job_farm": "SELECT i AS task, ['halves', 'square', 'triangle'][i % 3 + 1] AS job, i AS argument, CASE i % 3 WHEN 0 THEN length(ltrim(bin(i), '0'))::DOUBLE WHEN 1 THEN (i * i)::DOUBLE ELSE i * (i + 1) / 2.0::DOUBLE END::DOUBLE AS result FROM range(300) t(i)",
    "interval_times": "SELECT event_type, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n, (epoch_us(max(ts)) - epoch_us(min(ts)))::DOUBLE / 1e6 AS seconds FROM events GROUP BY 1",
}
