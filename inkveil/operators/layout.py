"""Page layout: span boxes, gap filling, exact areas, spatial joins, reading order."""

from __future__ import annotations

from statistics import median

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from ..functions import geometry as G

MAX_GAP = 2.5


def overlap_pairs(left: DataFrame, right: DataFrame, page: str, cell: int = G.CELL) -> DataFrame:
    """Pairs of a page (columns l_* and r_*) whose boxes share area: boxes meet on grid cells, and each pair counts in the
    cell of its overlap's corner alone, so nothing need be made distinct."""
    sides = []
    for d, p in ((left, "l_"), (right, "r_")):
        named = d.select(page, *(F.col(c).alias(p + c) for c in d.columns if c != page))
        sides.append(named.withColumn("__cell", F.explode(G.cells(G.Box.of(p), cell))))
    a, b = G.Box.of("l_"), G.Box.of("r_")
    corner = (F.floor(F.greatest(a.x0, b.x0) / cell) == F.col("__cell.cx")) & (F.floor(F.greatest(a.y0, b.y0) / cell) == F.col("__cell.cy"))
    return sides[0].join(sides[1], [page, "__cell"]).where(corner & (G.intersection(a, b) > 0)).drop("__cell")


def best_overlap(pairs: DataFrame, page: str, seg: str, word: str, least: float = 0.5) -> DataFrame:
    """For each segment the true word with most of the segment's area, at least a share; the first word of equals."""
    share = G.intersection(G.Box.of("l_"), G.Box.of("r_")) / G.Box.of("l_").area_or_one()
    w = Window.partitionBy(page, seg).orderBy(F.desc("share"), word)
    ranked = pairs.withColumn("share", share).where(F.col("share") >= least).withColumn("__r", F.row_number().over(w))
    return ranked.where("__r = 1").drop("__r")


def fill_gaps(regions: DataFrame, *keys: str, max_gap: float = MAX_GAP) -> DataFrame:
    """Text boxes of one label on a line with gaps up to max_gap line heights become one, in order of (y0, x0, ord): each
    joins the first made box that it fits. Other kinds pass. Columns: keys, kind, label, x0, y0, x1, y1, score, ord."""
    box = "struct<x0:double,y0:double,x1:double,y1:double,score:double>"
    text = regions.where("kind = 'text'").groupBy(*keys, "kind", "label").agg(F.array_sort(F.collect_list(F.struct("y0", "x0", "ord", "x1", "y1", "score"))).alias("boxes"))

    def fits(m, r):
        overlap = F.least(m["y1"], r["y1"]) - F.greatest(m["y0"], r["y0"])
        line = overlap >= 0.5 * F.least(m["y1"] - m["y0"], r["y1"] - r["y0"])
        gap = F.greatest(m["x0"], r["x0"]) - F.least(m["x1"], r["x1"])
        return line & (gap <= max_gap * F.greatest(m["y1"] - m["y0"], r["y1"] - r["y0"]))

    def step(acc, r):
        at = F.array_position(F.transform(acc, lambda m: fits(m, r)), True)
        own = lambda x0, y0, x1, y1, s: F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"), s.alias("score"))
        joined = F.transform(acc, lambda m, i: F.when(i + 1 == at, own(F.least(m["x0"], r["x0"]), F.least(m["y0"], r["y0"]), F.greatest(m["x1"], r["x1"]), F.greatest(m["y1"], r["y1"]), F.greatest(m["score"], r["score"]))).otherwise(m))
        return F.when(at > 0, joined).otherwise(F.concat(acc, F.array(own(r["x0"], r["y0"], r["x1"], r["y1"], r["score"]))))

    made = text.select(*keys, "kind", "label", F.explode(F.aggregate("boxes", F.array().cast(f"array<{box}>"), step)).alias("b")).select(*keys, "kind", "label", "b.*")
    return made.unionByName(regions.where("kind <> 'text'").select(*keys, "kind", "label", "x0", "y0", "x1", "y1", "score"))


def union_area(boxes: DataFrame, *keys: str) -> DataFrame:
    """The exact area of the union of integer boxes by key: strips between neighbouring y values, and in each the union of
    x ranges by gaps and islands. Empty boxes count nothing."""
    full = boxes.where("x1 > x0 and y1 > y0").select(*keys, "x0", "y0", "x1", "y1")
    ys = full.select(*keys, F.explode(F.array("y0", "y1")).alias("y")).distinct()
    strips = ys.withColumn("to", F.lead("y").over(Window.partitionBy(*keys).orderBy("y"))).where("to is not null")
    rows = strips.join(full, list(keys)).where("y0 <= y and y1 >= to")
    w = Window.partitionBy(*keys, "y").orderBy("x0", "x1")
    seen = F.max("x1").over(w.rowsBetween(Window.unboundedPreceding, -1))
    width = F.greatest(F.lit(0), F.col("x1") - F.greatest(F.col("x0"), F.coalesce(seen, F.col("x0"))))
    return rows.withColumn("__w", width).groupBy(*keys).agg(F.sum(F.col("__w") * (F.col("to") - F.col("y"))).cast("long").alias("area"))


def coverage(items: DataFrame, bars: DataFrame, page: str, item: str) -> DataFrame:
    """Share of each item box that bars cover; 1 for an empty box. Items meet the bars that share area with them alone."""
    pairs = overlap_pairs(items.select(page, item, "x0", "y0", "x1", "y1"), bars.select(page, "x0", "y0", "x1", "y1"), page)
    clipped = pairs.select(page, F.col("l_" + item).alias(item), *(F.greatest("l_" + c, "r_" + c).alias(c) for c in ("x0", "y0")), *(F.least("l_" + c, "r_" + c).alias(c) for c in ("x1", "y1")))
    covered = union_area(clipped, page, item)
    size = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    full = items.select(page, item, F.when((F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0")), size).otherwise(0).alias("size"))
    return full.join(covered, [page, item], "left").select(page, item, F.when(F.col("size") == 0, 1.0).otherwise(F.coalesce("area", F.lit(0)) / F.col("size")).alias("coverage"))


def span_boxes(spans: DataFrame, segments: DataFrame, *keys: str) -> DataFrame:
    """Boxes of text spans: segments (start, end, box, n) that a span touches; a part of a segment is cut in proportion,
    one character wider at each end."""
    s = spans.select(*keys, "label", "score", F.col("start").alias("a"), F.col("end").alias("b"))
    r = s.join(segments, list(keys)).where((F.greatest("a", "start") < F.least("b", "end")))
    n, wide = F.col("end") - F.col("start"), F.col("x1") - F.col("x0")
    whole = (F.col("a") <= F.col("start")) & (F.col("b") >= F.col("end"))
    lo = F.greatest(F.lit(0), F.greatest("a", "start") - F.col("start") - 1)
    hi = F.least(n, F.least("b", "end") - F.col("start") + 1)
    return r.select(*keys, "label", "score", "a", "b", F.when(whole, F.col("x0")).otherwise(F.col("x0") + wide * lo / n).alias("x0"), "y0", F.when(whole, F.col("x1")).otherwise(F.col("x0") + wide * hi / n).alias("x1"), "y1")


def reading_lines(segments: DataFrame, *keys: str) -> DataFrame:
    """Simple reading order: by y centre; a segment more than 0.6 heights off its line's first centre begins a line; x in
    a line. One row for each segment: keys, ord, line."""
    item = F.struct(((F.col("y0") + F.col("y1")) / 2).alias("yc"), "x0", "ord", (F.col("y1") - F.col("y0")).alias("h"))
    rows = segments.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("s"))
    out = "array<struct<line:int,x0:double,ord:bigint>>"
    zero = F.struct(F.lit(-1).alias("line"), F.lit(None).cast("double").alias("first"), F.array().cast(out).alias("out"))

    def step(a, s):
        new = a["first"].isNull() | (F.abs(s["yc"] - a["first"]) > 0.6 * s["h"])
        line = F.when(new, a["line"] + 1).otherwise(a["line"])
        return F.struct(line.alias("line"), F.when(new, s["yc"]).otherwise(a["first"]).alias("first"), F.concat(a["out"], F.array(F.struct(line.alias("line"), s["x0"].alias("x0"), s["ord"].cast("bigint").alias("ord")))).alias("out"))

    return rows.select(*keys, F.explode(F.aggregate("s", zero, step, lambda a: a["out"])).alias("r")).select(*keys, "r.line", "r.ord", "r.x0")


def _chain(rows: list, slope: float) -> list[list]:
    """Lines of segments (ord, x0, y0, x1, y1), from left to right: each joins the nearest line end within 0.6 heights. Lines
    are in order of their mean height on the page, those less than a millionth apart by their first segment."""
    h = median(r[4] - r[2] for r in rows)
    y = {r[0]: (r[2] + r[4]) / 2 - slope * (r[1] + r[3]) / 2 for r in rows}
    lines: list[list] = []
    for r in sorted(rows, key=lambda r: (r[1], r[0])):
        near = min(((abs(y[r[0]] - y[line[-1][0]]), k) for k, line in enumerate(lines)), default=(2 * h, -1))
        if near[0] <= 0.6 * h and near[1] >= 0:
            lines[near[1]].append(r)
        else:
            lines.append([r])
    return sorted(lines, key=lambda line: round(sum(y[r[0]] for r in line) / len(line), 6))


@F.udf(ArrayType(StructType([StructField("ord", LongType()), StructField("line", IntegerType()), StructField("pos", IntegerType())])), useArrow=True)
def _tilted(rows):
    rows = [tuple(r) for r in rows]
    middle = lambda r: ((r[1] + r[3]) / 2, (r[2] + r[4]) / 2)
    ends = [(middle(line[0]), middle(line[-1])) for line in _chain(rows, 0.0) if len(line) > 1]
    slopes = [(b[1] - a[1]) / (b[0] - a[0]) for a, b in ends if b[0] > a[0]]
    return [(r[0], k, p) for k, line in enumerate(_chain(rows, median(slopes) if slopes else 0.0)) for p, r in enumerate(line)]


def tilted_order(segments: DataFrame, *keys: str) -> DataFrame:
    """Reading order of tilted pages: segments are chained to lines twice, the second time with the median slope of the
    first lines taken out. One row for each segment: keys, ord, line, pos."""
    pages = segments.groupBy(*keys).agg(F.collect_list(F.struct("ord", "x0", "y0", "x1", "y1")).alias("s"))
    return pages.select(*keys, F.explode(_tilted("s")).alias("r")).select(*keys, "r.*")


def covering(words: DataFrame, segments: DataFrame, page: str, least: float = 0.5) -> DataFrame:
    """The segments that cover at least a share of each word (wi), from the top left: page, wi, ords, text. Words that
    nothing covers are left out."""
    pairs = overlap_pairs(words.select(page, "wi", "x0", "y0", "x1", "y1"), segments.select(page, "ord", "text", "x0", "y0", "x1", "y1"), page)
    area = G.Box.of("l_").area()
    held = pairs.where(G.intersection(G.Box.of("l_"), G.Box.of("r_")) >= least * F.when(area == 0, 1.0).otherwise(area))
    hits = held.groupBy(page, F.col("l_wi").alias("wi")).agg(F.array_sort(F.collect_list(F.struct("r_y0", "r_x0", "r_ord", "r_text"))).alias("h"))
    return hits.select(page, "wi", F.transform("h", lambda s: s["r_ord"]).alias("ords"), F.array_join(F.transform("h", lambda s: s["r_text"]), " ").alias("text"))


def assembled(lines: DataFrame, *keys: str) -> DataFrame:
    """Where each word stands in its page's text: words of a line joined by a space, lines by a line break. lines: keys,
    line, place (in the line), text; added: start, end."""
    w = Window.partitionBy(*keys).orderBy("line", "place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.length("text") + 1).over(w) - 1
    return lines.withColumn("end", end).withColumn("start", F.col("end") - F.length("text"))


@F.udf(ArrayType(StructType([StructField("ord", LongType()), StructField("line", LongType()), StructField("part", LongType())])), useArrow=True)
def _grouped(rows, off, tall, wide):
    rows = sorted(((r["y0"] + r["y1"]) / 2, r["ord"], r["x0"], r["x1"], r["y1"] - r["y0"]) for r in rows)
    lines, out, centres, heights = [], [], 0.0, 0.0  # plain sums, in order: sum() would compensate
    for r in rows:
        n = len(lines[-1]) if lines else 0
        if n and abs(centres / n - r[0]) < off * (heights / n):
            lines[-1].append(r)
            centres, heights = centres + r[0], heights + r[4]
        else:
            lines.append([r])
            centres, heights = r[0], r[4]
    for k, line in enumerate(lines):
        part, n, high, right = -1, 0, 0.0, 0.0
        for r in sorted(line, key=lambda q: q[2]):
            if n and abs(high / n - r[4]) < tall * (high / n) and r[2] - right < wide * r[4]:
                n, high = n + 1, high + r[4]
            else:
                part, n, high = part + 1, 1, r[4]
            right = r[3]
            out.append((r[1], k, part))
    return out


def grouped_boxes(boxes: DataFrame, *keys: str, off: float = 0.5, tall: float = 0.5, wide: float = 0.5, margin: float = 0.1) -> DataFrame:
    """Upright detector boxes as text lines: a box joins a line by its centre and the running means of it, then neighbours
    of like height and little gap become one box with a margin. Rows: keys, line, part, n, x0, y0, x1, y1."""
    c = ("x0", "y0", "x1", "y1")
    held = boxes.groupBy(*keys).agg(F.collect_list(F.struct("ord", *c)).alias("b"))
    each = held.select(*keys, F.explode(_grouped("b", F.lit(off), F.lit(tall), F.lit(wide))).alias("g")).select(*keys, "g.*")
    g = each.join(boxes.select(*keys, "ord", *c), [*keys, "ord"]).groupBy(*keys, "line", "part").agg(F.count("*").alias("n"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    m = (margin * F.least(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))).cast("int")
    return g.select(*keys, "line", "part", "n", (F.col("x0") - m).alias("x0"), (F.col("y0") - m).alias("y0"), (F.col("x1") + m).alias("x1"), (F.col("y1") + m).alias("y1"))
