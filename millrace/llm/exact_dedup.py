"""Exact deduplication by a heavy-hitter split, in DataFrame functions only.

A Misra-Gries summary (Spark's mergeable frequent-items sketch, a Misra-Gries variant) over the digests
finds every digest that may hold at least ``heavy_share`` of the rows. Their exact group sizes and
winners come from a partial aggregation, and the winners, at most ``1 / heavy_share`` rows, are broadcast:
rows of heavy groups are settled where they are read and never shuffled. The digests that are left have
small groups and go through an ordinary shuffle of slim rows (digest, length, id), never of texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.scratch import stage

BLANKS = " \t\n\x0b\x0c\r"


def normalised(col):
    """The text without the characters ``[\\x20\\x09-\\x0D]``; null counts as empty."""
    out = F.coalesce(col, F.lit(""))
    for c in BLANKS:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def heavy_digests(rows: DataFrame, column: str, heavy_share: float) -> list:
    """Values that Misra-Gries with ``4 / heavy_share`` counters estimates at ``heavy_share`` of the rows or more.

    The summary overestimates, so no value of that share is missed; at most ``1.4 / heavy_share`` come back.
    """
    k = int(1.4 / heavy_share)
    found = rows.agg(F.count(F.lit(1)).alias("n"), F.expr(f"approx_top_k({column}, {k}, {4 * k})").alias("top")).first()
    least = max(2, heavy_share * found["n"])
    return [x["item"] for x in found["top"] or [] if x["count"] >= least]


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", heavy_share: float = 0.002) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are so after all of ``[\\x20\\x09-\\x0D]`` is removed. The row with the most
    code points in its original text stays, then that with the smallest id (null ids last), then any one of
    rows that agree in both; exactly one row of a group is kept, also among fully repeated rows.
    Null text: as empty, so all empty and null texts are one group. Empty table: no rows. Columns other than
    the two named are not read, so clashing names do no harm.
    """
    texts = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    rows = stage(
        texts.select("id", F.length("t").cast("bigint").alias("n"), F.sha2(normalised(F.col("t")).cast("binary"), 256).alias("d"), F.monotonically_increasing_id().alias("r")),
        "exact",
    )
    # smallest of (-length, null id, id, row): the row that stays
    order = F.struct((-F.col("n")).alias("n"), F.col("id").isNull().alias("z"), F.col("id").alias("id"), F.col("r").alias("r"))
    heavy = heavy_digests(rows, "d", heavy_share)
    of_heavy = F.col("d").isin(heavy) if heavy else F.lit(False)
    winners = rows.where(of_heavy).groupBy("d").agg(F.min(order).alias("w"), F.count(F.lit(1)).alias("group_size"))
    settled = rows.where(of_heavy).join(F.broadcast(winners), "d")  # at most 1.4 / heavy_share rows
    group = Window.partitionBy("d")
    rest = rows.where(~of_heavy).select("*", F.min(order).over(group).alias("w"), F.count(F.lit(1)).over(group).alias("group_size"))
    return settled.select(rest.columns).unionByName(rest).select(
        F.col("id").alias(id_col), F.col("w.id").alias("keep_id"), "group_size", (F.col("r") == F.col("w.r")).alias("kept"), F.col("d").alias("text_sha256")
    )


def op1_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS d FROM documents
)
SELECT doc_id,
  first_value(doc_id) OVER w AS keep_id,
  count(*) OVER (PARTITION BY d) AS group_size,
  doc_id = first_value(doc_id) OVER w AS kept,
  d AS text_sha256
FROM t WINDOW w AS (PARTITION BY d ORDER BY n DESC, doc_id)
"""
