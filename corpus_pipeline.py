"""From raw documents to token ids: good text, one of each near-duplicate, nothing of the benchmark, sources mixed, ids stored."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rankloom.llm import decontaminate, mixing, near_dedup, quality, token_store
from rankloom.llm.common import stored


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier doesn't reject.

    A null text is an empty one and has a score like any other; equal texts have equal scores, so repeated rows stay or go together. Without
    labels of both kinds nothing tells good from bad, and all rows score the labels' rate. An empty table stays empty."""
    return quality.keep_good(docs, quality.train(docs, _table(spark, sf_dir, "labels")), threshold=0.3)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates, that of the smallest id."""
    return near_dedup.near_dedup(docs, least=0.8, k=5)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.decontaminate(docs, _table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as many times as their source's rate says."""
    return mixing.mix(docs, weights=(3, 1, 2), share=1.5, cap=2.0)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix's token ids as bit planes; one row for each document, read back from them."""
    import public_tokenizers

    return token_store.store_tokens(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2)


STAGES = [
    ("quality classifier", quality_filter),
    ("MinHash near-dedup", near_duplicates),
    ("benchmark decontamination", benchmark_free),
    ("mixing sources to target weights", source_mix),
    ("token-ID / binary output", token_ids),
]

#: SQL can't express the classifier, the verified sketches or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; each one's rows are a Parquet table in the shared folder before the next begins.

    Nulls in any column, empty and very long texts, repeated rows and ids and further columns pass through all stages, as each
    stage's operator says; other columns travel along up to the last stage, whose names can't clash with them. An empty table gives none."""
    docs = _table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, "stage-" + name.split()[0].lower(), compression="zstd")
    return docs
