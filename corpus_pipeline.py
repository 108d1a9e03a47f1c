"""From raw documents to shards: quality, near duplicates, benchmark passages, mixture, sharding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet and gives it to the next stage.
All stages but the last return the columns of ``documents``. Null texts, null ids and repeated rows are treated as the operators say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tickloom.llm import decontaminate, jaccard, mixing, quality_model, sharding
from tickloom.llm.shared import parquet, written

#: Bytes of a shard.
SHARD_BYTES = 16 << 20


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weak-label quality model rejects go."""
    return quality_model.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the smallest id."""
    return jaccard.one_of_each(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more are benchmark passages go."""
    return decontaminate.without_contaminated(docs, parquet(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the order of the mix; a source whose weight asks for more than it has comes again."""
    return mixing.in_mix_order(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their ``shard`` of about ``SHARD_BYTES``."""
    return sharding.with_shards(docs, sharding.shards_for(docs, SHARD_BYTES))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("benchmark_passages", benchmark_passages), ("mixture", mixture), ("shards", shards)]
#: SQL cannot express the fitted classifier of the first stage; tests/llm compares stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = parquet(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
