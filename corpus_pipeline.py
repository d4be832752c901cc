"""A training-data pipeline over ``documents``: five stages, each one operator of ``rfrank.llm``.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next one's ``docs``. All but the last return the columns of ``docs`` as they were given,
whatever further columns these have and whatever their names; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rfrank.llm.common import materialize
from rfrank.llm.exact_dedup import exact_dedup
from rfrank.llm.mixing import mix_sources
from rfrank.llm.packing import pack
from rfrank.llm.quality import classify_quality
from rfrank.llm.simhash import simhash_dedup


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go.

    Null and empty texts stay: there is nothing to reject. Repeated rows share their lot.
    """
    return classify_quality(docs).filter("accepted").select("row.*")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for white space one stays: the longest as written, then the smallest id, null ids last.

    Null and empty texts equal each other; of repeated rows one stays.
    """
    return exact_dedup(docs).filter("kept").select("row.*")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (5-word shingles 0.8 alike, or four bits of SimHash) that with the smallest id stays.

    Texts without a word, null ones too, are alike among themselves; null ids come last; of repeated rows one stays.
    """
    return simhash_dedup(docs, similarity=0.8).filter("kept").select("row.*")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's budget asks, as whole texts: that at the cut is taken if half of it is within.

    A document without a word takes no part of a budget and goes. Repeated rows each count; a null source is
    a source of its own.
    """
    size, taken = F.col("size"), F.col("taken")
    times = F.floor(taken / size) + F.when(2 * (taken % size) >= size, 1).otherwise(0)
    wanted = mix_sources(docs).filter("taken > 0").withColumn("times", times.cast("int"))
    return wanted.select("row", F.explode(F.array_repeat(F.lit(0), F.col("times")))).select("row.*")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 4096, piece by piece; a null text counts as empty, and repeated rows are packed each."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", quality), ("exact_dedup", exact), ("near_dedup", near), ("mix", mix), ("pack", packing)]

#: Trained classifier, XXH64 fingerprints and subword tokens are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
