"""The corpus pipeline: language ID, line dedup, near dedup, substring dedup, packing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptloom.llm import common, language_id, line_dedup, near_dedup, packing, substring_dedup


def _counted(docs: DataFrame, texts: DataFrame) -> DataFrame:
    """Columns as in ``docs``, with n_chars that fits the text."""
    n = F.coalesce(F.length("text"), F.lit(0)).cast("long")
    return texts.select(*[n.alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language."""
    return language_id.accepted(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that similar lines precede."""
    return _counted(docs, line_dedup.without_repeats(docs))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return near_dedup.keep_one_of_each(docs)


def spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without spans of 20 words and more that occur earlier."""
    return _counted(docs, substring_dedup.without_repeats(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences."""
    return packing.pack(docs)


def _after(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage gets what the one before it has written, so that one's intermediates can go."""

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        while _held:
            _held.pop().drop()
        with common.collected(_held):
            return stage(spark, docs, sf_dir)

    return run


_held: list[common.Stored] = []

STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", _after(language)),
    ("line_dedup", _after(lines)),
    ("near_dedup", _after(near)),
    ("substring_dedup", _after(spans)),
    ("packing", _after(pack)),
]

#: SQL can express neither the language model nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.store(stage(spark, docs, sf_dir), f"pipeline-{name}").read()
    return STAGES[-1][1](spark, docs, sf_dir)
