"""From raw documents to token ids: quality, line dedup, near-duplicate removal, decontamination, tokenization.

Each stage takes (spark, docs, sf_dir) and returns a frame, which is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievewright.llm.common import fresh, materialize, read_table, where_id
from sievewright.llm.decontam import decontaminate
from sievewright.llm.line_dedup import dedup_lines
from sievewright.llm.near_dup import near_components
from sievewright.llm.quality import keep_good
from sievewright.llm.segment import encoded

#: SQL has no trained ranking, no XXH64 and no piece lattice.
ORACLE_SQL = None


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the ranking, trained on labels, accepts."""
    return keep_good(docs, read_table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated and near-equal lines; n_chars follows.

    A document goes when lines were dropped and only blank ones are left: all it said stands elsewhere.
    """
    total, dropped = fresh(docs, "lines_before"), fresh(docs, "lines_dropped")
    out = dedup_lines(docs, counts=(total, dropped))
    touched = F.col(dropped) > 0
    out = out.filter(~touched | F.col("text").rlike(r"\S"))
    if "n_chars" in docs.columns:
        length = F.length("text").cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", F.when(touched, length).otherwise(F.col("n_chars")))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates (5-word shingles, similarity 0.8): that with the smallest doc_id."""
    stays = F.col("doc_id").eqNullSafe(F.col("component_id"))
    gone = near_components(docs, similarity=0.8, words=5).groupBy("doc_id").agg(F.max(stays).alias("stays")).filter("not stays")
    return where_id(docs, gone.select("doc_id"), "left_anti")  # they are few: the texts needn't be shuffled


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in which no 13 consecutive words of a benchmark item, and no whole shorter item, occur.

    A single occurrence is enough: what op5 calls contaminated is a share of a document's words, by which a passage in
    a long document would stay in the corpus.
    """
    return where_id(docs, decontaminate(docs, read_table(spark, sf_dir, "benchmark")).filter("n_hit > 0").select("doc_id").distinct(), "left_anti")


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document's best segmentation, with the scores of the four best."""
    return encoded(docs, public_tokenizers.path("piece_bpe_32k.model"), n=4, with_ids=True)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("sentencepiece", sentencepiece),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
