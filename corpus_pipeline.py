"""A training corpus from ``documents``: five stages, each an operator of millrace.llm.

Every stage reads the Parquet that the one before wrote; all but the last return the columns of documents.

Rows with null or empty text pass toxicity, near-dedup and decontamination, and the mix takes none of them, as they have
no words. Null ids and sources are like any other value; rows that repeat fully count as near duplicates, so one stays.
Empty tables give empty results, and further columns of any name are handed on up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from millrace.llm.decontam import drop_contaminated
from millrace.llm.mixing import mixed_documents
from millrace.llm.neardup import drop_near_duplicates
from millrace.llm.scratch import stage
from millrace.llm.tokenbin import file_order, token_ids
from millrace.llm.toxicity import drop_toxic


def drop_toxic_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without those that the toxicity score rejects."""
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (similarity 0.8 or more of shingles of five words; the query op6 has
    four, as its contract says)."""
    return drop_near_duplicates(docs)


def decontaminate_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without those that hold benchmark passages: 13 words in a row of an item, in a text of any length, or 5 %
    of the words (the query op4 marks the latter only, as its contract says)."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), passages=True)


def mix_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, 0 to 2 times."""
    return mixed_documents(docs)


def tokens_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token files' rows: doc_id, start, n_tokens, ids_crc32; in training order, which is that of the files of ``docs``."""
    import public_tokenizers

    return token_ids(docs, str(public_tokenizers.path("byte_bpe_50k.json")), order=file_order(docs))


STAGES = [
    ("toxicity", drop_toxic_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontaminate_stage),
    ("mixing", mix_stage),
    ("token_ids", tokens_stage),
]

#: The first stage scores with a learned lexicon and the second is a similarity join: not for SQL.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage_of in STAGES[:-1]:
        docs = stage(stage_of(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
