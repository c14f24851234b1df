"""Mixing sources to target weights by a time-varying curriculum, in DataFrame functions only.

Every source has a weight schedule over training time 0..1, piecewise linear between knots. The integral of
the schedule, scaled to the source's target, is its cumulative token demand; inverting it gives each copy of a
document the time at which its words are due, and documents are range-sorted by that position. Words are
supplied in a fixed pseudo-random order per source, in passes over the source, until the target is met.

Running sums go over range partitions of (source, order): sums by partition, offsets of partitions, then a
window inside each partition. A source with a third of all rows is spread over as many partitions as it needs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.scratch import free_name, stage

WEIGHTS = (5, 2, 1)
#: Knots (time, weight) by the same rank of the source as its weight: early, steady and late sources.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (0.5, 0.5), (1.0, 2.5)))
TOTAL_SHARE, MAX_REPEATS = 1.5, 2


def word_count(col):
    """Number of maximal runs of ``[^\\x20\\x09-\\x0D]``; null has none."""
    return F.coalesce(F.regexp_count(col, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def running_sum(df: DataFrame, keys: list, value: str, tag: str) -> DataFrame:
    """``df`` with ``before``: the sum of ``value`` over all rows that sort before, over range partitions.

    One row per partition is collected into the window over partitions; nothing else meets in one task.
    """
    ranged = df.repartitionByRange(*keys).withColumn("part", F.spark_partition_id())
    rows = stage(ranged, tag)
    parts = rows.groupBy("part").agg(F.sum(value).alias("s"))
    starts = parts.select("part", (F.sum("s").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("s")).alias("start"))
    inside = Window.partitionBy("part").orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0)
    return rows.join(F.broadcast(starts), "part").select(*df.columns, (F.col("start") + F.sum(value).over(inside) - F.col(value)).alias("before"))


def targets(sources: DataFrame, weights=WEIGHTS, total_share: float = TOTAL_SHARE, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """``sources`` (source, source_size, cls) with ``target``: what each takes of ``total_share`` of all sizes.

    Targets are ``min(max_repeats * size, level * weight)`` with one level for all: what is above a cap is
    shared out again by weight until none is above. The level is found by repeated sums over the sources;
    each round that changes anything fixes at least one more source at its cap.
    """
    cap, w = (F.col("source_size") * max_repeats).cast("double"), F.element_at(F.array(*[F.lit(float(x)) for x in weights]), F.col("cls") + 1)
    sources = sources.select("*", cap.alias("cap"), w.alias("w"))
    total = (sources.agg(F.sum("source_size")).first()[0] or 0) * total_share
    level = -1.0
    while True:
        full = F.col("cap") <= F.lit(level) * F.col("w")
        s = sources.agg(F.sum(F.when(full, F.col("cap")).otherwise(0.0)).alias("c"), F.sum(F.when(full, 0.0).otherwise(F.col("w"))).alias("w")).first()
        new = (total - (s["c"] or 0.0)) / s["w"] if s["w"] else level
        if new <= level or not s["w"]:
            break
        level = new
    return sources.select("source", "source_size", "cls", F.least(F.col("cap"), F.lit(level) * F.col("w")).alias("target"))


def due(share, cls, schedules=SCHEDULES):
    """Time at which a source's cumulative demand reaches ``share`` (0..1) of its target."""
    out = F.lit(None).cast("double")
    for k, knots in enumerate(schedules):
        area = sum((t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(knots, knots[1:]))
        done, at = 0.0, None
        for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
            slope, left = (w1 - w0) / (t1 - t0), share * area - F.lit(done)
            # w0 x + slope x^2 / 2 = left, in the form that is stable and also holds for slope 0
            x = 2 * left / (F.lit(w0) + F.sqrt(F.greatest(F.lit(w0 * w0) + F.lit(2 * slope) * left, F.lit(0.0))))
            piece = F.least(F.lit(t1), F.lit(t0) + x)
            at = piece if at is None else F.when(left >= 0, piece).otherwise(at)
            done += (t1 - t0) * (w0 + w1) / 2
        out = F.when(cls == k, at).otherwise(out)
    return out


def _hash(id_col):
    return F.md5(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary"))


def plan(df: DataFrame, id_col: str, text_col: str, source_col: str, weights=WEIGHTS) -> DataFrame:
    """id, source, h, size, source_size, target, cls, at (words of the source before), taken0, taken1, ... by pass."""
    # x and m part rows of one id, null among them: by text, and rows that are alike in all by number
    rows = df.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), F.xxhash64(text_col).alias("x"))
    rows = stage(rows.withColumn("m", F.monotonically_increasing_id()), "mix")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_source = [F.col("source").asc_nulls_last()]
    ranked = running_sum(sizes.withColumn("one", F.lit(1).cast("bigint")), by_source, "one", "mix-sources")
    ranked = stage(ranked.select("source", "source_size", (F.col("before") % len(weights)).cast("int").alias("cls")), "mix-ranks")
    goal = running_sum(targets(ranked, weights), by_source, "source_size", "mix-starts").withColumnRenamed("before", "source_start")
    keyed = rows.withColumn("h", _hash(F.col("id")))
    summed = running_sum(keyed, [*by_source, F.col("h").asc(), F.col("id").asc_nulls_first(), F.col("x").asc(), F.col("m").asc()], "size", "mix-order")
    joined = summed.alias("a").join(goal.alias("g"), F.col("a.source").eqNullSafe(F.col("g.source")))
    want, at = F.floor("g.target").cast("bigint"), F.col("a.before") - F.col("g.source_start")
    taken = [F.greatest(F.lit(0).cast("bigint"), F.least(F.col("a.size"), want - k * F.col("g.source_size") - at)).alias(f"taken{k}") for k in range(MAX_REPEATS)]
    return joined.select("a.id", "a.source", "a.h", "a.size", "g.source_size", "g.target", "g.cls", at.alias("at"), *taken)


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, schedules=SCHEDULES) -> DataFrame:
    """One row per input row: id, size, source_size, target, taken, position.

    Sources rank by code point, null last, and take ``weights`` and ``schedules`` in turn. ``taken`` sums to the
    whole part of the source's target and is at most twice the document's size; it is the size times 0, 1 or 2
    but for one document of a source, at which the target is met. ``position`` is the training time of the
    document's first word in the first pass, null where nothing is taken; ``copies`` has those of all passes. The
    order inside a source is that of md5(id), then id (null ids as empty), then a hash of the text, so reruns agree;
    rows that are alike in all of these stand in any order.
    Null text: size 0. Null source: a source of its own. Empty table: no rows. Other columns are not read.
    """
    out = plan(df, id_col, text_col, source_col, weights)
    taken = sum((F.col(f"taken{k}") for k in range(1, MAX_REPEATS)), F.col("taken0"))
    out = out.withColumn("taken", taken).withColumn("position", F.when(F.col("taken") > 0, due(F.col("at") / F.col("target"), F.col("cls"), schedules)))
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target", "taken", "position")


def at_pass(k: int, schedules=SCHEDULES):
    """Training time at which pass ``k`` over the source comes to the document, from the columns of ``plan``."""
    return due((F.col("at") + k * F.col("source_size")) / F.col("target"), F.col("cls"), schedules)


def copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, schedules=SCHEDULES) -> DataFrame:
    """One row per copy that the mix takes: id, copy, words, position.

    ``copy`` is the pass over the source, from 0, ``words`` what it takes of the document and ``position`` the
    training time of the copy's first word. The sum of ``words`` is ``taken`` of ``mix``; documents of which
    nothing is taken have no row.
    """
    passes = [F.struct(F.lit(k).alias("copy"), F.col(f"taken{k}").alias("words"), at_pass(k, schedules).alias("position")) for k in range(MAX_REPEATS)]
    out = plan(df, id_col, text_col, source_col, weights).select("id", F.explode(F.array(*passes)).alias("c")).where("c.words > 0")
    return out.select(F.col("id").alias(id_col), "c.copy", "c.words", "c.position")


def mixed_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, schedules=SCHEDULES) -> DataFrame:
    """``df`` with each row as often as the mix takes it, 0 to 2 times, in training order; all columns as they are.

    Each copy is due when its pass comes to the document, and the copies are range-sorted by that time. A pass over
    a source ends at one place of its order, so a row per source and pass says where. The document at which a target
    is met counts if at least half of it is taken. Rows of one source and id are at one place, and due with its first.
    Null text: nothing to take, so the row goes. Null source or id: like any other. Empty table: no rows. Columns of
    any name are handed on as they are.
    """
    planned = stage(plan(df, id_col, text_col, source_col, weights), "mix-plan")
    place = F.struct("h", F.col("id").isNotNull().alias("z"), "id")
    last = [F.max(F.when((F.col(f"taken{k}") > 0) & (2 * F.col(f"taken{k}") >= F.col("size")), place)).alias(f"last{k}") for k in range(MAX_REPEATS)]
    ends = stage(planned.groupBy(F.col("source").alias("of")).agg(*last), "mix-ends")
    first = planned.groupBy("source", "id", "h", "source_size", "target", "cls").agg(F.min("at").alias("at"))
    joined = first.join(ends, F.col("source").eqNullSafe(F.col("of"))).withColumn("own", place)
    due_at = F.array(*[F.when(F.col("own") <= F.col(f"last{k}"), at_pass(k, schedules)) for k in range(MAX_REPEATS)])
    source, key, times, position = (free_name(df, n) for n in ("source", "key", "times", "position"))
    found = joined.select(F.col("source").alias(source), F.col("id").alias(key), F.array_compact(due_at).alias(times)).where(F.size(times) > 0)
    own = [F.col(f"`{c}`") for c in df.columns]
    timed = df.join(found, F.col(source_col).eqNullSafe(F.col(source)) & F.col(id_col).eqNullSafe(F.col(key))).select(F.explode(times).alias(position), *own)
    order = [F.col(position).asc(), F.col(id_col).asc_nulls_last()]
    return timed.repartitionByRange(*order).sortWithinPartitions(*order).select(*own)


def in_training_order(mixed: DataFrame, position: str = "position") -> DataFrame:
    """Range-sort by training position, then the first column: every file follows the one before."""
    keys = [F.col(position).asc_nulls_last(), *[F.col(c).asc_nulls_last() for c in mixed.columns[:1]]]
    return mixed.repartitionByRange(*keys).sortWithinPartitions(*keys)


def op7_source_mixing(spark, sf_dir: str) -> DataFrame:
    return in_training_order(mix(spark.read.parquet(f"{sf_dir}/documents.parquet")))


def op7_source_mixing_copies(spark, sf_dir: str) -> DataFrame:
    return in_training_order(copies(spark.read.parquet(f"{sf_dir}/documents.parquet")))


SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)::INT AS cls FROM d GROUP BY source
), w AS (
  SELECT *, (2 * source_size)::DOUBLE AS cap, CASE cls WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS w FROM s
), p AS (
  SELECT *, sum(cap) OVER o - cap AS full_cap, sum(w) OVER () - (sum(w) OVER o - w) AS left_w, (SELECT sum(source_size)::DOUBLE * 1.5 FROM w) AS total
  FROM w WINDOW o AS (ORDER BY cap / w, source NULLS LAST ROWS UNBOUNDED PRECEDING)
), l AS (
  SELECT max((total - full_cap) / left_w) FILTER (WHERE (total - full_cap) / left_w <= cap / w) AS level FROM p
), g AS (
  SELECT source, source_size, cls, least(cap, (SELECT level FROM l) * w)::DOUBLE AS target FROM w
), r AS (
  SELECT d.doc_id, d.size, g.source_size, g.target, g.cls,
    (sum(d.size) OVER (PARTITION BY d.source ORDER BY md5(coalesce(d.doc_id::VARCHAR, '')), d.doc_id NULLS FIRST ROWS UNBOUNDED PRECEDING) - d.size)::BIGINT AS upto
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source
), t AS (
  SELECT *, (greatest(0, least(size, floor(target)::BIGINT - upto)) + greatest(0, least(size, floor(target)::BIGINT - source_size - upto)))::BIGINT AS taken FROM r
)
SELECT doc_id, size, source_size, target, taken,
  CASE WHEN taken > 0 THEN CASE cls
    WHEN 0 THEN least(1.0, 2 * (upto / target) / (1.5 + sqrt(greatest(2.25 - 2 * (upto / target), 0.0))))
    WHEN 1 THEN least(1.0, 2 * (upto / target) / (1.0 + sqrt(1.0)))
    ELSE CASE WHEN upto / target >= 0.25 THEN least(1.0, 0.5 + 2 * (upto / target - 0.25) / (0.5 + sqrt(greatest(0.25 + 8 * (upto / target - 0.25), 0.0))))
      ELSE least(0.5, 2 * (upto / target) / (0.5 + sqrt(0.25))) END
  END END::DOUBLE AS position
FROM t
"""

#: The same up to the order of a source, then a row per pass that takes words.
COPIES_SQL = (
    SQL[: SQL.index(", t AS (")]
    + r"""
, c AS (
  SELECT doc_id, cls, copy::INT AS copy, greatest(0, least(size, floor(target)::BIGINT - copy * source_size - upto))::BIGINT AS words, (upto + copy * source_size) / target AS share
  FROM r CROSS JOIN range(2) p(copy)
)
SELECT doc_id, copy, words, CASE cls
    WHEN 0 THEN least(1.0, 2 * share / (1.5 + sqrt(greatest(2.25 - 2 * share, 0.0))))
    WHEN 1 THEN least(1.0, 2 * share / (1.0 + sqrt(1.0)))
    ELSE CASE WHEN share >= 0.25 THEN least(1.0, 0.5 + 2 * (share - 0.25) / (0.5 + sqrt(greatest(0.25 + 8 * (share - 0.25), 0.0)))) ELSE least(0.5, 2 * share / (0.5 + sqrt(0.25))) END
  END::DOUBLE AS position
FROM c WHERE words > 0
"""
)
