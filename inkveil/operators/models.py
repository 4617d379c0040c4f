"""Models as parts of a plan: predictors of spans over windows, recognisers and detectors for tests."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import spans

Predictor = Callable[[DataFrame, str, str], DataFrame]


def windowed(model: Callable[[Column], Column], size: int = 200, stride: int = 150, threshold: float = 0.5) -> Predictor:
    """A predictor that gives each window of tokens to a model (text column to array of start, end, label, score), moves
    its spans to the whole text, drops those outside it or below the threshold, and merges."""

    def predict(docs: DataFrame, key: str, text: str) -> DataFrame:
        rows = docs.select(key, F.col(text).alias("t"), T.tokens(F.col(text)).alias("tok")).where(F.size("tok") > 0)
        w = rows.select(key, "t", "tok", F.explode(spans.windows(F.size("tok"), size, stride)).alias("w"))
        base, end = F.get("tok", F.col("w.start"))["start"], F.get("tok", F.col("w.end") - 1)["end"]
        part = w.select(key, base.alias("base"), F.length("t").alias("n"), F.substr("t", base + 1, end - base).alias("part"))
        found = part.select(key, "base", "n", F.explode(model(F.col("part"))).alias("s"))
        moved = found.select(key, F.col("s.label").alias("label"), (F.col("base") + F.col("s.start")).alias("start"), (F.col("base") + F.col("s.end")).alias("end"), F.col("s.score").alias("score"), "n")
        return spans.merge(moved.where("start >= 0 and start < end and end <= n").where(F.col("score").cast("float") > F.lit(threshold).cast("float")).drop("n"), key)

    return predict


def gold(entities: DataFrame) -> DataFrame:
    """A perfect predictor: true entities as spans of score 1."""
    return entities.select("page", "label", "start", "end", F.lit(1.0).alias("score"))


def oracle_lines(words: DataFrame, noise: float = 0.0, seed: int = 1) -> DataFrame:
    """A recogniser for tests: the true words of a line (same y0) as one segment; a share of words loses its first letter."""
    u = F.pmod(F.xxhash64(F.lit(seed), "page", "wi"), F.lit(10_000)) / 10_000
    said = words.withColumn("said", F.when(u < noise, F.substr("text", F.lit(2))).otherwise(F.col("text")))
    line = said.groupBy("page", "y0").agg(F.array_sort(F.collect_list(F.struct("x0", "said"))).alias("w"), F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    return line.select("page", F.array_join(F.transform("w", lambda x: x["said"]), " ").alias("text"), "x0", "y0", "x1", "y1")


def oracle_words(words: DataFrame) -> DataFrame:
    """A recogniser that is right: every true word is a segment of its own. words: text and box; added: score."""
    return words.withColumn("score", F.lit(1.0))
