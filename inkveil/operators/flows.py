"""Whole flows: from recognised segments to the regions to hide, records beside their recognised rows, pools of files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import layout
from .scoring import report

REGION = ("kind", "label", "x0", "y0", "x1", "y1", "score", "source")


def page_texts(segments: DataFrame, *keys: str) -> DataFrame:
    """Segments (keys, ord, text, box) in reading order, each with its place in its page's text, and the text: keys, ord, box,
    start, end, page_text."""
    placed = segments.join(layout.reading_lines(segments, *keys).select(*keys, "ord", "line"), [*keys, "ord"])
    order = Window.partitionBy(*keys).orderBy("line", "x0", "ord")
    placed = layout.assembled(placed.withColumn("place", F.row_number().over(order)), *keys)
    broken = F.lag("line").over(order) != F.col("line")
    part = F.concat(F.when(broken, "\n").when(broken.isNull(), "").otherwise(" "), "text")
    parts = placed.withColumn("__part", part).groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "place", "__part"))), lambda p: p["__part"]), "").alias("page_text"))
    return placed.join(parts, list(keys))


def text_regions(segments: DataFrame, predict: Callable[[Column], Column], engine: str, *keys: str, gap_fill: bool = True) -> DataFrame:
    """What a reading reveals: predict gives the spans (start, end, label, score) of a page's text; their boxes, filled gap by
    gap within each engine's own. Rows: keys, kind, label, box, score, source (the engine)."""
    own = [*keys, engine]
    read = page_texts(segments, *own)
    spans = read.select(*own, "page_text").distinct().select(*own, F.explode(predict(F.col("page_text"))).alias("s")).select(*own, "s.label", "s.score", "s.start", "s.end")
    boxes = layout.span_boxes(spans, read.select(*own, "start", "end", "x0", "y0", "x1", "y1"), *own)
    ranked = boxes.withColumn("ord", F.row_number().over(Window.partitionBy(*own).orderBy("a", "b", "label", "y0", "x0"))).withColumn("kind", F.lit("text"))
    found = layout.fill_gaps(ranked, *own) if gap_fill else ranked
    return found.withColumn("source", F.col(engine)).select(*keys, *REGION)


def visual_regions(found: DataFrame, *keys: str, least: float = 0.25, source: str = "detector") -> DataFrame:
    """Detections that are sure enough, as regions."""
    return found.where(F.col("score") >= least).withColumn("kind", F.lit("visual")).withColumn("source", F.lit(source)).select(*keys, *REGION)


def analyse(segments: DataFrame, predict: Callable[[Column], Column], engine: str, found: DataFrame | None, *keys: str, gap_fill: bool = True, least: float = 0.25) -> DataFrame:
    """All regions to hide: those of every engine's reading, and of the detector."""
    regions = text_regions(segments, predict, engine, *keys, gap_fill=gap_fill)
    return regions if found is None else regions.unionByName(visual_regions(found, *keys, least=least))


def filled_union(regions: DataFrame, engine: str, *keys: str) -> DataFrame:
    """Regions of several engines, gaps filled within each engine before they are put together."""
    return layout.fill_gaps(regions, *keys, engine)


def beside(records: DataFrame, read: DataFrame, key: str, keep: DataFrame | None = None) -> DataFrame:
    """Records with their recognised rows (errors left out), of kept ids alone if any are given."""
    kept = records if keep is None else records.join(keep.select(key), key, "left_semi")
    return kept.join(read.where(F.coalesce("error", F.lit("")) == "").drop("error"), key)


def page_files(pages: DataFrame, own: DataFrame, key: str, path: str) -> DataFrame:
    """Pages with the file of their id where there is one, else their own path."""
    other = own.select(key, F.col(path).alias("__path"))
    return pages.join(other, key, "left").withColumn(path, F.coalesce("__path", path)).drop("__path")


def pools(files: DataFrame, path: str) -> DataFrame:
    """Files of the pools train and heldout (one in ten, by crc32 of the name without folders): path, pool. A pool with no
    file takes the other's."""
    held = F.crc32(F.element_at(F.split(path, "/"), -1).cast("binary")) % 10 == 0
    dealt = files.select(path, F.when(held, "heldout").otherwise("train").alias("pool"))
    only = dealt.agg(F.min("pool").alias("a"), F.max("pool").alias("z")).where("a = z").select(F.when(F.col("a") == "train", "heldout").otherwise("train").alias("other"))
    return dealt.unionByName(dealt.join(F.broadcast(only), F.col("pool") != F.col("other")).select(path, F.col("other").alias("pool")))


def recognition_report(items: DataFrame, measures: dict[str, Column]) -> DataFrame:
    """Measures over all, by language, document type, script, and label (with the script where it is not latin): part, value."""
    label = F.concat("label", F.when(F.col("script") == "latin", "").otherwise(F.concat(F.lit(" ("), "script", F.lit(")"))))
    parts = ["lang", "doc_type", "script", "label"]
    r = report(items.withColumn("label", label), [[], *([p] for p in parts)], measures)
    return r.select(F.coalesce(*(F.when(F.col(p).isNotNull(), p) for p in parts), F.lit("overall")).alias("part"), F.coalesce(*parts).alias("value"), *measures)


def summed(counts: DataFrame, column: str) -> DataFrame:
    """Maps of counts added up key by key: key, n."""
    return counts.select(F.explode(column).alias("key", "n")).groupBy("key").agg(F.sum("n").alias("n"))
