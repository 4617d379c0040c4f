"""Spans over text: merging, windows, tokens, agreement, islands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merge(spans: DataFrame, *keys: str) -> DataFrame:
    """Spans of one label that overlap or touch become one: least start, most end, best score."""
    by = Window.partitionBy(*keys, "label").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    to_here = Window.partitionBy(*keys, "label").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0)
    new = F.coalesce((F.col("start") > F.max("end").over(by)).cast("int"), F.lit(1))
    islands = spans.withColumn("__new", new).withColumn("__island", F.sum("__new").over(to_here))
    return islands.groupBy(*keys, "label", "__island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.max("score").alias("score")).drop("__island")


def union(*predictors: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """The merged union of several predictors' spans."""
    first, *rest = (p.select(*keys, "label", "start", "end", "score") for p in predictors)
    for p in rest:
        first = first.unionByName(p)
    return merge(first, *keys)


def windows(n: Column, size: int = 200, stride: int = 150) -> Column:
    """Overlapping windows [start, end); the last ends at n; one window where n is at most size."""
    count = F.when(n <= size, 1).otherwise(1 + F.ceil((n - size) / stride)).cast("int")
    return F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.struct((i * stride).cast("int").alias("start"), F.least(i * stride + size, n).cast("int").alias("end")))


def token_span(tokens: Column, start: Column, end: Column) -> Column:
    """First and last (inclusive) token that lies in [start, end); null where none does."""
    inside = F.filter(F.transform(tokens, lambda t, i: F.when((t["start"] >= start) & (t["end"] <= end), i)), lambda i: i.isNotNull())
    return F.when(F.size(inside) > 0, F.struct(F.array_min(inside).alias("first"), F.array_max(inside).alias("last")))


def chunk(window: Column, ner: Column) -> Column:
    """The token spans that lie in a window, counted from its start."""
    held = F.filter(ner, lambda e: (e["first"] >= window["start"]) & (e["last"] < window["end"]))
    return F.transform(held, lambda e: F.struct((e["first"] - window["start"]).alias("first"), (e["last"] - window["start"]).alias("last"), e["label"].alias("label")))


def clean(examples: DataFrame, labels: Column) -> DataFrame:
    """Training examples with tokens, none blank, and spans of known labels inside them."""
    ok_tokens = (F.size("tokens") > 0) & F.forall("tokens", lambda t: F.coalesce(F.trim(t) != "", F.lit(False)))
    ok_ner = F.forall("ner", lambda e: F.coalesce((e["first"] >= 0) & (e["first"] <= e["last"]) & (e["last"] < F.size("tokens")) & F.array_contains(labels, e["label"]), F.lit(False)))
    return examples.where(ok_tokens & ok_ner)


def agreement(a: DataFrame, b: DataFrame, *keys: str) -> DataFrame:
    """both, n_a, n_b and f1 = 2 both / (n_a + n_b) over distinct spans; 1 where there are none."""
    x, y = (d.select(*keys, "label", "start", "end").distinct() for d in (a, b))
    mark = x.withColumn("l", F.lit(1)).join(y.withColumn("r", F.lit(1)), [*keys, "label", "start", "end"], "full")
    n = mark.agg(F.count(F.when(F.col("l").isNotNull() & F.col("r").isNotNull(), 1)).alias("both"), F.count("l").alias("n_a"), F.count("r").alias("n_b"))
    return n.withColumn("f1", F.coalesce(F.try_divide(2.0 * F.col("both"), F.col("n_a") + F.col("n_b")), F.lit(1.0)))


def runs(rows: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """Gaps and islands: rows of equal value next to each other get one run number; null breaks runs and has none."""
    w = Window.partitionBy(*by).orderBy(*order)
    change = (~F.col(value).eqNullSafe(F.lag(value).over(w)) | (F.row_number().over(w) == 1)).cast("int")
    return rows.withColumn("__c", change).withColumn("run", F.when(F.col(value).isNotNull(), F.sum("__c").over(w))).drop("__c")


def score_positions(pages: DataFrame, pred: str, gold: str) -> DataFrame:
    """Character coverage of a page: size of gold, covered gold, predicted, predicted off gold (arrays of struct start, end)."""
    positions = lambda c: F.array_distinct(F.flatten(F.transform(F.filter(c, lambda s: s["end"] > s["start"]), lambda s: F.sequence(s["start"], s["end"] - 1))))
    p, g = positions(F.col(pred)), positions(F.col(gold))
    return pages.withColumn("gold_chars", F.size(g)).withColumn("gold_cov", F.size(F.array_intersect(g, p))).withColumn("pred_chars", F.size(p)).withColumn("pred_bad", F.size(F.array_except(p, g)))


def rank_runs(words: DataFrame, by: list[str], rank: str) -> DataFrame:
    """Members with neighbouring ranks form a run: by, run (smallest rank), last, n."""
    at = Window.partitionBy(*by).orderBy(rank)
    run = words.withColumn("__g", F.col(rank) - F.row_number().over(at))
    return run.groupBy(*by, "__g").agg(F.min(rank).alias("run"), F.max(rank).alias("last"), F.count("*").alias("n")).drop("__g")


def joined_over_space(spans: DataFrame, by: list[str], text: str) -> DataFrame:
    """Spans of one key with nothing but white space between them become one: by, start, end."""
    from ..functions.text import strip

    w = Window.partitionBy(*by).orderBy("start", "end")
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    gap = F.when(before < F.col("start"), strip(F.substr(text, before + 1, F.col("start") - before))).otherwise("")
    marked = spans.withColumn("__new", F.coalesce((before.isNull() | (gap != "")).cast("int"), F.lit(1)))
    runs_ = marked.withColumn("__g", F.sum("__new").over(w))
    return runs_.groupBy(*by, "__g").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("__g")


def readable(windows: Column, bad: Column) -> Column:
    """Windows (start, end) that no end of a bad token span (first, last) lies in."""
    ends = lambda w, x: (w["start"] <= x) & (x < w["end"])
    return F.filter(windows, lambda w: ~F.exists(bad, lambda b: ends(w, b["first"]) | ends(w, b["last"])))
