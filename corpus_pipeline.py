"""A corpus pipeline: five stages over `documents`, each an operator of dayline.llm on what the stage before it kept.

Every stage takes any table with the columns of documents; further columns are left out, whatever their names but ROW.
The first stage numbers the rows under that name, afresh even where its input has such a column, and the others go by it;
called by itself a later stage numbers its rows too. So null and repeated ids are documents like others. Each stage gives
an empty table for an empty one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dayline.llm import bpe, exact_dedup, langid, mixing, near_dedup
from dayline.llm.common import held_out, staged

#: Columns of documents, which every stage but the last returns with ROW.
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: The row number that the first stage gives; no other column may have this name.
ROW = "_corpus_pipeline_row"


def numbered(docs: DataFrame) -> DataFrame:
    """The columns of documents and ROW, a number of its own for each row, in order of doc_id (nulls last); written, so that it stays the same."""
    keys = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text")]
    return staged(docs.select(COLUMNS).repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn(ROW, F.monotonically_increasing_id()), "pipeline-rows")


def rows_of(docs: DataFrame) -> DataFrame:
    """The columns of documents and ROW of a stage's input; numbered here where no stage before has done it."""
    return docs.select(*COLUMNS, ROW) if ROW in docs.columns else numbered(docs)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language is rejected: no letter (so null and empty texts too), or two languages that explain them equally well.

    Texts are compressed whole, however long; repeated rows are decided alike and all stay or go.
    """
    found = langid.identify(numbered(docs), ~held_out(F.col("doc_id"), 4), carry=("text", "lang", "source", "n_chars", ROW))
    return found.where("not rejected").select(*COLUMNS, ROW)


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of equal texts: the longest, then the smallest id, nulls last; one of repeated rows.

    Null texts count as empty, and all empty texts are one group.
    """
    docs = rows_of(docs)
    kept = exact_dedup.exact_duplicates(docs.select(F.col(ROW).alias("doc_id"), "text")).where("kept").select(F.col("doc_id").alias(ROW))
    return docs.join(kept, ROW, "left_semi").select(*COLUMNS, ROW)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the row with the smallest id, nulls last, of each group of near duplicates; one of repeated rows.

    Null and blank texts are near nothing and stay.
    """
    docs = rows_of(docs)
    kept = near_dedup.near_duplicates(docs.select(F.col(ROW).alias("doc_id"), "text")).where("kept").select(F.col("doc_id").alias(ROW))
    return docs.join(kept, ROW, "left_semi").select(*COLUMNS, ROW)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Emits every row as often as the mix takes it: not at all, or up to three times.

    Null texts have size 0; a null source is the last source.
    """
    docs = rows_of(docs)
    taken = mixing.mix(docs, carry=(ROW,)).where("copies > 0").select(ROW, "copies")
    return docs.join(taken, ROW).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*COLUMNS, ROW)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of every document with the digests of the ids and of the bytes that they decode to; null texts have none."""
    coded = bpe.encode_and_decode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded.select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("mixing", mixing_stage),
    ("byte_bpe", byte_bpe),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, each result written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: Compression, sketches and merge ranks have no SQL; tests/llm/test_pipeline.py holds the stages and run() against brute force.
ORACLE_SQL = None
