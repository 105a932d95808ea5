"""Corpus pipeline over the table documents: five stages, from raw texts to packed token sequences.

Every stage works on all rows its predecessor kept and returns the columns of documents; the last one returns
the placed token pieces.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.llm import linededup, packing, quality, simhash, toxicity
from panelcast.llm.common import read, stored
from panelcast.llm.queries import QUALITY_CUT, TOXIC_CUT
from panelcast.shipping import ship


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that the quality classifier scores below the cut."""
    ship(spark)
    labels = read(spark, sf_dir, "labels", "doc_id", "quality")
    model = quality.train(quality.training_rows(docs, labels, "quality"))
    return quality.keep_good(docs, model, QUALITY_CUT)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that are likely to have any toxic grade."""
    ship(spark)
    model = toxicity.fit(toxicity.training_rows(docs, read(spark, sf_dir, "labels", "doc_id", "toxic")))
    return toxicity.keep_clean(docs, model, TOXIC_CUT)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes lines with an earlier near duplicate; documents stay, n_chars follows the text."""
    ship(spark)
    cleaned = linededup.deduplicate(docs)
    if "n_chars" in docs.columns:
        cleaned = cleaned.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return cleaned.select(docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each SimHash group."""
    ship(spark)
    return simhash.deduplicate(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts and places all tokens in sequences."""
    ship(spark)
    cut = packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json"))
    return packing.pack(cut.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))


STAGES = [
    ("quality classifier", quality_stage),
    ("toxicity", toxicity_stage),
    ("line dedup", line_stage),
    ("simhash near-dedup", near_duplicate_stage),
    ("best-fit packing", packing_stage),
]

#: The stages use trained models, trees and a search that SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's result; each one before is written to the shared folder and read back as the next one's docs."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    *stages, (_, last) = STAGES
    for name, stage in stages:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return last(spark, docs, sf_dir)
