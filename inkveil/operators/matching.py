"""Matching of detections and truths, of two recognisers' segments, and of a text's occurrences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as T
from .layout import overlap_pairs


def greedy_match(pred: DataFrame, truth: DataFrame, page: str, least: float = 0.5) -> DataFrame:
    """One-to-one matches by page and label: predictions by score, each takes its best truth that is free and overlaps it
    enough (least: over 0). Columns of both: label, ord and box; of predictions also score. Rows: page, label, pred, gt, iou."""
    box = ("x0", "y0", "x1", "y1")
    met = overlap_pairs(pred.select(page, "label", "ord", "score", *box), truth.select(page, "label", "ord", *box), page).where("l_label = r_label")
    pairs = met.select(page, F.col("l_label").alias("label"), F.col("l_ord").alias("pred"), F.col("l_score").alias("score"), F.col("r_ord").alias("gt"), G.iou(G.Box.of("l_"), G.Box.of("r_")).alias("iou")).where(F.col("iou") >= least)
    rows = pairs.groupBy(page, "label").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("neg"), "pred", (-F.col("iou")).alias("off"), "gt"))).alias("c"))
    kind = "array<struct<pred:bigint,gt:bigint,iou:double>>"

    def step(acc, c):
        taken = F.exists(acc, lambda m: (m["pred"] == c["pred"]) | (m["gt"] == c["gt"]))
        return F.when(taken, acc).otherwise(F.concat(acc, F.array(F.struct(c["pred"].alias("pred"), c["gt"].alias("gt"), (-c["off"]).alias("iou")))))

    return rows.select(page, "label", F.explode(F.aggregate("c", F.array().cast(kind), step)).alias("m")).select(page, "label", "m.*")


def parity(a: DataFrame, b: DataFrame, page: str) -> DataFrame:
    """Two segment lists by place: n (of the longer), same text, same box, largest score difference."""
    x = a.select(page, F.posexplode_outer("segments").alias("pos", "s"))
    y = b.select(page, F.posexplode_outer("segments").alias("pos", "t"))
    both = x.join(y, [page, "pos"], "full").where(F.col("s").isNotNull() | F.col("t").isNotNull())
    return both.groupBy(page).agg(F.count("*").alias("n"), F.count(F.when(F.col("s.text") == F.col("t.text"), 1)).alias("same_text"), F.count(F.when(F.col("s.bbox") == F.col("t.bbox"), 1)).alias("same_box"), F.max(F.abs(F.col("s.score") - F.col("t.score"))).alias("max_diff"))


def occurrences(text: Column, needle: str, taken: Column, least: int = 3) -> Column:
    """Where a literal stands in a text apart from taken spans (array of struct start, end); none for short literals."""
    import re

    if len(re.sub(r"[\s\-.,:;]+", "", needle)) < least:
        return F.array().cast("array<struct<start:int,end:int,text:string>>")
    found = T.find_all(text, re.sub(r"([^\w\s])", r"\\\1", needle.strip()))
    return F.filter(found, lambda m: ~F.exists(taken, lambda t: (t["start"] < m["end"]) & (m["start"] < t["end"])))


def span_index(n: Column, width: int = 12) -> Column:
    """All spans of up to width tokens: array of (first, last, inside), for a span model's input."""
    each = lambda f: F.flatten(F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), f))
    first, last = each(lambda i: F.array_repeat(i, width)), each(lambda i: F.sequence(i, i + (width - 1)))
    # Column by column: a struct made span by span costs twice as much
    spans = F.arrays_zip(first, last, F.transform(last, lambda k: k < n)).cast("array<struct<first:int,last:int,inside:boolean>>")
    return F.when(n > 0, spans).otherwise(F.array().cast("array<struct<first:int,last:int,inside:boolean>>"))


def padded(values: Column, size: int, fill: Column) -> Column:
    """The values, filled up to size; more than size are an error."""
    n = F.size(values)
    refused = F.raise_error(F.concat(F.lit("padded: "), n.cast("string"), F.lit(f" values; at most {size} fit")))
    return F.when(n > size, refused).otherwise(F.concat(values, F.array_repeat(fill, F.lit(size) - n)))


def hit(items: DataFrame, x: float, y: float, pad: float, *keys: str) -> DataFrame:
    """The smallest item (the first of equals) whose padded box holds a point, on each page (keys)."""
    inside = items.where((F.col("x0") - pad <= x) & (F.col("x1") + pad >= x) & (F.col("y0") - pad <= y) & (F.col("y1") + pad >= y))
    size = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    first = inside.groupBy(*keys).agg(F.min_by(F.struct(*(c for c in items.columns if c not in keys)), F.struct(size, "ord")).alias("__i"))
    return first.where("__i is not null").select(*keys, "__i.*")
