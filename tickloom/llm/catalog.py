"""Queries of the corpus operators, each over its whole tables, with SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audit, cascade, decontaminate, jaccard, langid, mixing, oracles, pii, quality_model, sharding, spelling, substring, tokens, urls
from .shared import parquet

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return register


@query(oracles.SUBSTRING)
def op2_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Words in 50-word windows that a smaller document also holds are removed."""
    out = substring.remove_repeats(parquet(spark, folder, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query(oracles.JACCARD)
def op5_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    """Near-duplicate group and number of links of every document."""
    return jaccard.similarity_groups(parquet(spark, folder, "documents"))


@query()
def op7_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of every document in the vocabulary of 32,000 pieces."""
    import public_tokenizers

    counts = tokens.token_counts(parquet(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 4096)


@query()
def op4_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    """Label-model posterior, linear score and verdict of every document."""
    out = quality_model.classify(parquet(spark, folder, "documents"))
    return out.select("doc_id", F.round("posterior", 6).alias("posterior"), F.round("score", 6).alias("score"), "kept")


@query()
def op1_kd_sharding(spark: SparkSession, folder: str) -> DataFrame:
    """Forty shards of near equal bytes, one per leaf of a K-d tree over the metadata."""
    out = sharding.shard_slots(parquet(spark, folder, "documents"), 40)
    return out.select("*", F.lit("bytes").alias("law"), F.lit(None).cast("int").alias("grown_shard"))


@query(oracles.URL_FILTERS)
def op3_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    """Base list, then pattern rules, on every page's url."""
    out = urls.filter_urls(parquet(spark, folder, "pages"))
    return out.select("page_id", "host", "path", "rule", "pattern", "verdict")


@query(oracles.QUALITY_RULES)
def op6_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Base features and the verdict of the rule cascade."""
    return cascade.apply_rules(parquet(spark, folder, "documents")).drop("rejected_by")


@query()
def op8_pfair_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """Slot of every document's block in the mix of sources, as often as its source comes round."""
    out = mixing.mix(parquet(spark, folder, "documents").select("doc_id", "source"))
    return out.select("doc_id", "source", *[F.col(f"_{c}").alias(c) for c in ("block", "epoch", "release", "deadline", "slot")])


@query(oracles.DECONTAMINATION)
def op9_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Words of every document inside passages of the benchmark."""
    out = decontaminate.contamination(parquet(spark, folder, "documents"), parquet(spark, folder, "benchmark"))
    n = F.size("items").cast("long").alias("n_items")
    return out.select("doc_id", "n_words", "n_hit", n, F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


#: Key of the query only; a real corpus needs a secret one.
SURROGATE_KEY = "tickloom demonstration key"


@query()
def op10_pii_surrogates(spark: SparkSession, folder: str) -> DataFrame:
    """Texts with every detected entity replaced by its surrogate."""
    return pii.replace_entities(parquet(spark, folder, "documents"), SURROGATE_KEY)


@query()
def op11_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every document, learned from those that are not held out."""
    import public_tokenizers

    out = langid.predicted_languages(parquet(spark, folder, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return out.withColumn("score", F.round("score", 6))


@query(oracles.FILTER_AUDIT)
def op12_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    """What five filters keep, remove and lose for each source, in every order."""
    return audit.filter_audit(parquet(spark, folder, "documents"), parquet(spark, folder, "labels"))


@query(oracles.SPELLING)
def op13_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    """Form, root and near words of every word of the documents."""
    return spelling.spelling_variants(parquet(spark, folder, "documents"))
