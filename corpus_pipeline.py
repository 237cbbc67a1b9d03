"""A pipeline over ``documents``: each stage works on all that the one before it has kept.

Quality rules drop documents; of each group of near duplicates the one with the least id stays; repeated passages are cut
out; documents that leak a benchmark item are dropped; what is left is encoded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajspark.llm import bpe, decontamination, quality_rules, simhash_dedup, substring_dedup
from trajspark.llm.common import materialise, row_ids
from trajspark.llm.queries import table, tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, rid = row_ids(docs, "doc_id", "text")
    kept = quality_rules.quality_verdicts(rows.select(rid, "text", "lang"), id_col=rid).where("kept").select(rid)
    return rows.join(kept, rid, "left_semi").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, rid = row_ids(docs, "doc_id", "text")
    found = simhash_dedup.near_duplicates(rows.select(rid, "text"), id_col=rid)
    return rows.join(found.where(F.col(rid) == F.col("component_id")).select(rid), rid, "left_semi").select(*docs.columns)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = substring_dedup.remove_repeats(docs)
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(docs, tokenizer_path())


STAGES = [("quality rules", quality), ("simhash near-dedup", near_duplicates), ("substring dedup", substrings), ("benchmark decontamination", decontaminate), ("bpe", encode)]
#: The fingerprints and the tokenizer have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; between stages, documents are written and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialise(docs, name.replace(" ", "-"))
    return docs
