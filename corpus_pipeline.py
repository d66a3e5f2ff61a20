"""Corpus pipeline: quality rules, line dedup, near-dedup, decontamination, tokenisation.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and reread as the next one's
docs.  All but the last return the columns of documents; extra columns go.

Every stage gives an empty table for an empty one and takes texts whole, however long.  Rows are judged one by one, so
repeated rows fare alike, but for line dedup and near-dedup, where rows of one doc_id are one document: none of them is a
copy of another.  Ties keep the smallest doc_id.  Rows without doc_id are compared with nothing and stay unless the quality
rules reject them.  Null texts count as empty: the quality rules reject them; the other stages, run alone, keep them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkledger.llm import bpe, decontaminate, line_dedup, near_dup, quality
from sparkledger.llm.common import BROADCAST_BYTES, Scratch, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and the table of thresholds. Null and empty texts fail the base rule."""
    return quality.kept_rows(quality.judge(quality.features(docs)), "kept").select(*COLUMNS)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that repeat earlier ones; those that had lines and have none left go. n_chars follows the text."""
    out = quality.kept_rows(line_dedup.dedup(docs), "n_lines = 0 OR n_removed_lines < n_lines")
    return out.withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest doc_id."""
    gone = Scratch(spark, "pipeline").save(near_dup.near_duplicates(docs).filter("NOT kept").select("doc_id"), "gone")
    side = F.broadcast(gone) if gone.count() * 16 <= BROADCAST_BYTES else gone
    return docs.join(side, "doc_id", "left_anti").select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark; an empty benchmark, or one of null texts, removes none."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their token ids, and whether the ids decode to the text; null and empty texts have no ids."""
    path, pattern = bpe.default_vocabulary()
    out = bpe.decode(bpe.encode(docs, path, pattern), path, pattern)
    return out.withColumns({"n_tokens": F.size("ids").cast("bigint"), "round_trip": F.expr("decoded = encode(coalesce(text, ''), 'UTF-8')")}).drop("decoded")


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup_stage),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("byte-level BPE", byte_bpe),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scratch = Scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        before, docs = docs, scratch.save(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        scratch.drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)


#: The chosen-path walk and the tokeniser have no SQL form; the tests run the stages against brute force.
ORACLE_SQL = None
