"""A corpus pipeline: five stages over documents, each written as Parquet and read again as the next one's input.

Each stage keeps all columns of its documents, whatever their names, and works on
whole texts, however long; null texts count as empty. No stage depends on the
order of rows; an empty table stays empty. A stage's scratch tables go when the
next one begins, whose input is written by then.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkveil.llm import decontaminate, exact_dedup, lang_id, near_dedup, packing, queries
from inkveil.llm._shared import free, mark, since, written

_left: list[tuple[SparkSession, str]] = []


def _freeing(stage: Callable) -> Callable:
    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        free(_left, docs)
        before = mark()
        out = stage(spark, docs, sf_dir)
        _left[:] = since(before)
        return out

    return run


def _own(docs: DataFrame) -> list:
    return [F.col("row")[c].alias(c) for c in docs.columns]


def _beside(docs: DataFrame) -> DataFrame:
    """The rows as a column row, beside their text: so that no name of theirs meets one of an operator."""
    return docs.select(F.struct("*").alias("row"), F.col("text"))


@_freeing
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: documents of no language go: those without a letter, among them null and empty texts, and all if no row
    has a label to learn from. Null labels are not learned from; of languages equally likely the first by name is
    taken. Repeated rows and ids are labelled alike."""
    found = lang_id.identify(_beside(docs), lang_id.train(docs), prefix="found_")
    return found.where(F.col("found_pred") != "und").select(*_own(docs))


@_freeing
def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Exact dedup: of texts equal but for A-Z the row with the largest doc_id stays, a null id only if there is no other; of
    repeated rows and equal ids one stays. All empty and null texts are one group."""
    return exact_dedup.deduplicated(docs)


@_freeing
def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """MinHash near-dedup: of each group the row with the smallest doc_id stays, a null id only if there is no other; of
    repeated rows and equal ids the first. Texts without words, null and empty ones among them, all stay."""
    return near_dedup.deduplicated(docs)


@_freeing
def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents that hold a window of a benchmark item go. Null and empty texts hold none and
    stay, and so do all if the benchmark is empty. Repeated rows fare alike."""
    found = decontaminate.contaminate(_beside(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), prefix="found_")
    return found.where(~F.col("found_contaminated")).select(*_own(docs))


@_freeing
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packing: all kept documents as sequences of at most 2048 tokens, a row for each piece. Null and empty texts have the
    end id alone; rows with null, equal or repeated ids are packed like any."""
    with open(f"{queries.TOKENIZERS}/byte_bpe_50k.json", encoding="utf-8") as f:
        return packing.pack(docs, f.read()).drop("ids")


STAGES = [("language", language), ("exact_dedup", exact), ("near_dedup", near), ("decontamination", clean), ("packing", pack)]

#: SQL can't express language ID, packing and ProbMinHash; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
