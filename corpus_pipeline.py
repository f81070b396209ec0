"""The corpus pipeline: language ID, near-dedup, decontamination, secret redaction, mixing.

Each stage works on all that the one before kept, and its result is written and read again, so stages are restartable
and none runs twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import decontaminate, langid, mixing, near_dedup, secret_scan
from ledgerloom.llm.common import materialize, numbered


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that language ID rejects go: those with a null text or one without a letter, and those far from all
    languages. Learns from the labelled rows of its own input; with none of them, or an empty table, nothing is kept. Very
    long texts are judged whole, equal ones alike, rows that repeat others each by itself; null keys, labels and sources
    don't matter. Other columns are carried, whatever they are called."""
    rows, own = numbered(docs)
    judged = langid.identify(rows, langid.fit(docs), text=own["text"])
    return judged.where(~F.col("rejected")).select(*own.values()).toDF(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (0.8 of word 5-grams) stays, that with the smallest key. Null and empty
    texts are nobody's copies and stay, as do rows with a null key; rows that repeat a key stay or go together. Very long
    texts are compared whole. An empty table stays empty; other columns are carried, whatever they are called."""
    return near_dedup.deduplicate(docs, percent=80)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item (of three words or more, within a fifth of its words in edits) go. Null and
    empty texts hold none; very long ones are searched whole; null keys and repeated rows are judged by their text. An
    empty table, or benchmark, changes nothing, whatever other columns there are."""
    return decontaminate.remove_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; secrets in their texts are replaced and n_chars follows. Null texts and their n_chars stay as
    they are, empty ones too; very long texts are cleaned whole, in time that goes with their length. A null key or source
    counts as one of its own; repeated rows are cleaned alike. An empty table stays empty; other columns are carried, whatever they are called."""
    return secret_scan.redact_secrets(docs).withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks for; reruns agree. Null and empty texts have no words and are
    repeated like their source's others; a null source is a source of its own, the last; rows that repeat a key and text
    are drawn alike. Very long texts count whole. An empty table stays empty; other columns are carried, whatever they are
    called."""
    return mixing.mix(docs)


STAGES = [
    ("language ID", keep_known_languages),
    ("near-dedup", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("secret redaction", redact_secrets),
    ("mixing", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs, "stage")
    return docs


#: The stages fit a classifier and compare edit distances, which SQL can't express.
ORACLE_SQL = None
