"""A corpus pipeline over ``documents``.

Language ID drops what it rejects; of near copies one row stays; passages are cut out that repeat, be it strings of 400
bytes standing anywhere else or passages of 50 words standing in another document too (each copy of them goes, as in the operator);
the sources are mixed in Pfair order (the order of the rows in the written files); the texts are encoded, each with its ``rank``,
the place that the mix gave it. Equal rows may exchange their ranks.

Odd rows: a null, empty or letterless text is rejected by the first stage; a row without id is the last of its class to stay; a
repeated id is two documents; a null source is a source of its own; repeated rows are copies, of which one stays; a document of
which nothing is left after the cut goes; an empty table gives an empty result; extra columns travel as far as the last stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.llm import bpe, jaccard, langid, mixing, repeats
from geoloom.llm.common import Stages

#: The weight of each source in the mix; None: the square root of its rows.
TARGETS: dict[str, float] | None = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.recognised(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = repeats.without_repeats(docs)
    return kept.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.in_mixed_order(docs, targets=TARGETS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ranked = mixing.with_rank(docs)
    return bpe.encode(ranked, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep_ids=True, carry=("rank",))


STAGES = [("language", language), ("near_copies", near_copies), ("repeated_passages", repeated_passages), ("mix", mix), ("encode", encode)]

#: The stages train a model, follow links of any length and run merges; SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    stages = Stages(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stages.keep(stage(spark, docs, sf_dir), name)
    return docs
