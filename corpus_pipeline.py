"""The corpus pipeline: five stages, each written as Parquet and read again as the next one's documents."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from paytrail.llm import exact_dedup, mixing, ngram_join, packing, quality, registry
from paytrail.plans.cut import cut, owned, release

#: The classifier, the mixture's rates and the packing are fitted or greedy, beyond SQL; tests compare with brute force.
ORACLE_SQL = None

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Tables of the stage before, whose result is stored once the next stage begins.
_left: list[str] = []


def _releasing(stage: Stage) -> Stage:
    """The stage, which first removes the tables that the stage before has left in the shared folder; its own result is lazy
    and reads its tables until it is stored."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(spark, _left)
        with owned() as own:
            out = stage(spark, docs, sf_dir)
        _left.extend(own)
        return out

    return run_stage


@_releasing
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject (score of 0.3 or more)."""
    return quality.keep_good(docs, quality.fit(docs, registry.table(spark, sf_dir, "labels")))


@_releasing
def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest doc_id."""
    return exact_dedup.drop_duplicates(docs)


@_releasing
def ngram_join_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five words, similarity 0.8), the row with the least doc_id."""
    return ngram_join.keep_one(docs)


@_releasing
def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the rates that bring the domains' tokens to their targets say. The quality stage has removed the
    low domain, so what is left of it keeps its share, and good and toxic have the rest in the targets' proportion."""
    return mixing.resample(docs, registry.table(spark, sf_dir, "labels"), mixing.GATED_TARGETS)


@_releasing
def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences: a row for each piece of a document, with its bin and place."""
    return packing.pack_documents(docs, registry.tokenizer())


STAGES = [
    ("quality_classifier", quality_stage),
    ("exact_dedup", exact_dedup_stage),
    ("ngram_jaccard_join", ngram_join_stage),
    ("source_mixing", mixing_stage),
    ("best_fit_packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage has read is removed once its result is stored."""
    docs, before = registry.table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        with owned() as own:
            docs = cut(out, f"pipeline-{name}")
        release(spark, before)
        before = own
    release(spark, _left)
    return docs
