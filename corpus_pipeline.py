"""A corpus pipeline of five stages over `documents`; each stage's rows are written as Parquet and read again by the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seine.llm import decontam, jaccard_join, mixing, quality, sharding
from seine.llm.common import blank_words, cut, delete, keyed, lookup, noted
from seine.sources.tables import spread

SHARDS = 24


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or leave the limits of their language and source go.

    Null and empty texts fail the base rules. A null language or source is a group like any other. Repeated rows share
    their verdict. An empty table stays empty.
    """
    return quality.quality_filter(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of documents linked by a similarity of 0.8 or more on runs of five words, one stays.

    It is that of the smallest id (null last), then of the smallest text hash; of repeated rows one stays. Texts without
    words are linked to nothing and stay. An empty table stays empty.
    """
    return jaccard_join.dedupe(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten consecutive words of a benchmark item go, or all words of a shorter item.

    Null and empty texts stay; repeated rows share their verdict; benchmark rows without an id count, those without words
    do not. An empty table stays empty, and an empty benchmark takes nothing.
    """
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it whole, with the targets of the mixing query.

    A document that the mix takes in part once more is not cut: it gets that copy if half of it or more is taken. Texts
    without words take part with size 0 and go. Repeated rows share their copies; where they differ in other columns, the
    first as JSON is taken. An empty table stays empty.
    """
    rows = docs.select(*keyed(docs), "source", F.size(blank_words(F.col("text"))).cast("long").alias("size"), mixing.quality_weight(F.col("text")).alias("weight"))
    taken = mixing.mix(rows, ties=["_text_key"])
    copies = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + F.lit(0.5))).otherwise(F.lit(0))
    # repeated rows share a key: their copies are summed, and dealt out to their rows below
    plan = taken.groupBy("doc_id", "source", "_text_key").agg(F.sum(copies).cast("int").alias("_copies"), F.count(F.lit(1)).cast("int").alias("_rows"))
    packed = docs.select(F.struct("*").alias("__row"), "doc_id", "source", keyed(docs)[1])
    # the plan has a row a document, so it is never broadcast
    joined = lookup(packed, cut(plan.filter("_copies > 0"), "mix-plan"), ["doc_id", "source", "_text_key"], "inner", max_rows=0)
    single = joined.filter("_rows = 1")
    repeated = joined.filter("_rows > 1").groupBy("doc_id", "source", "_text_key", "_copies", "_rows").agg(F.min_by("__row", F.to_json("__row")).alias("__row"))
    return single.select("__row", "_copies").unionByName(repeated.select("__row", "_copies")).withColumn("_n", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select("__row.*")


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All columns, and the shard that the document's id decides; rows without an id share one. An empty table stays empty."""
    return sharding.shard(docs, SHARDS)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mixture),
    ("sharding", shards),
]

#: The near-duplicate classes are an iterative computation, and a plain SQL join of all runs of words is too slow on whole tables; tests/llm holds a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over `documents`. What a stage has written is deleted once the next stage's rows are, so only the result stays."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    with noted() as written:
        for name, stage in STAGES:
            docs = cut(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
            delete(spark, written[:-1])
            del written[:-1]
    return docs
