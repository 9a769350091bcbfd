"""Corpus pipeline: quality, boilerplate lines, near duplicates, benchmark leaks, packing.

Each stage takes (spark, docs, folder of the tables) and works on all rows of its predecessor; all but the last return the
columns of documents. In every stage a null text counts as empty and stays null where the row stays; texts of any length are
taken whole; rows that repeat are judged alike, each for itself; columns beside those of documents pass through, whatever
their names; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.llm.decontaminate import decontaminate
from sedimenta.llm.linededup import drop_lines
from sedimenta.llm.neardup import drop_near_duplicates
from sedimenta.llm.packing import pack_documents
from sedimenta.llm.quality import keep_good
from sedimenta.llm.queries import table, tokenizer_path
from sedimenta.llm.support import materialize


def _measured(docs: DataFrame) -> DataFrame:
    """n_chars after a change of the text."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the co-trained classifier doesn't reject. Rows without an id are scored too; without labels of both kinds all rows
    stay."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, without lines that more than a tenth of their source's documents, and two at least, hold. Rows without a source
    keep all lines."""
    return _measured(drop_lines(docs, "source", "text", max_ratio=0.1, min_pages=2).select(*docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (the smallest doc_id) of each group linked by a similarity of 0.8 of five-word shingles. Documents without words,
    and rows without an id, stay; so do all rows of a kept id."""
    return drop_near_duplicates(docs, n=5, percent=80)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without benchmark passages; a document that is mostly benchmark goes. Untouched rows keep their text as it is."""
    return _measured(decontaminate(docs, table(spark, sf_dir, "benchmark"), n=10))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, placed in sequences of at most 1024 tokens; an empty text is a piece of one token."""
    return pack_documents(docs.select("doc_id", "text"), tokenizer_path(), derive={"ids_crc32": F.crc32("ids").cast("long")}, keep_ids=False)


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("leaks", leaks), ("packing", packing)]

#: Co-training and MinHash aren't expressible in SQL; tests/llm hold every stage against brute force or held-out labels.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
