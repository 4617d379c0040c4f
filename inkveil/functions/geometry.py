"""Boxes as four columns or as an array [x0, y0, x1, y1]."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

PAD = {"text": 3, "visual": 6}
CELL = 64


class Box:
    """Four columns of a box."""

    def __init__(self, x0, y0, x1, y1):
        self.x0, self.y0, self.x1, self.y1 = (F.col(c) if isinstance(c, str) else c for c in (x0, y0, x1, y1))

    @classmethod
    def of(cls, prefix: str = "") -> Box:
        return cls(*(prefix + c for c in ("x0", "y0", "x1", "y1")))

    def area(self) -> Column:
        return F.greatest(F.lit(0.0), self.x1 - self.x0) * F.greatest(F.lit(0.0), self.y1 - self.y0)

    def area_or_one(self) -> Column:
        """The other rule: at least 1."""
        return F.greatest(F.lit(1.0), (self.x1 - self.x0) * (self.y1 - self.y0))


def intersection(a: Box, b: Box) -> Column:
    w = F.least(a.x1, b.x1) - F.greatest(a.x0, b.x0)
    h = F.least(a.y1, b.y1) - F.greatest(a.y0, b.y0)
    return F.greatest(F.lit(0.0), w) * F.greatest(F.lit(0.0), h)


def iou(a: Box, b: Box) -> Column:
    i = intersection(a, b)
    union = a.area() + b.area() - i
    return F.when(union > 0, i / union).otherwise(0.0)


def pixels(a: Box, pad, width: Column, height: Column, eps: float = 1e-3) -> list[Column]:
    """The pixel box: floor and ceil by eps, padded, in the page, not inverted. eps 0 is the visual scorer's rule."""
    pad = F.lit(pad) if not isinstance(pad, Column) else pad
    lo = lambda v, most: F.least(F.greatest(F.floor(v + eps) - pad, F.lit(0)), most)
    x0, y0 = lo(a.x0, width), lo(a.y0, height)
    x1 = F.greatest(F.least(F.ceil(a.x1 - eps) + pad, width), x0)
    y1 = F.greatest(F.least(F.ceil(a.y1 - eps) + pad, height), y0)
    return [c.cast("long") for c in (x0, y0, x1, y1)]


def padding(kind: Column) -> Column:
    return F.when(kind == "visual", PAD["visual"]).otherwise(PAD["text"])


def same_line(a: Box, b: Box) -> Column:
    overlap = F.least(a.y1, b.y1) - F.greatest(a.y0, b.y0)
    return overlap >= 0.5 * F.least(a.y1 - a.y0, b.y1 - b.y0)


def cells(a: Box, size: int = CELL) -> Column:
    """The grid cells that a box touches, to be exploded."""
    span = lambda u, v: F.sequence(F.floor(u / size), F.greatest(F.floor(u / size), F.floor(v / size)))
    return F.flatten(F.transform(span(a.x0, a.x1), lambda x: F.transform(span(a.y0, a.y1), lambda y: F.struct(x.alias("cx"), y.alias("cy")))))


def yolo_line(cls: Column, a: Box, width: Column, height: Column) -> Column:
    """A label line, six decimals; null for boxes under two pixels after clipping."""
    x0, x1 = F.greatest(a.x0, F.lit(0.0)), F.least(a.x1, width)
    y0, y1 = F.greatest(a.y0, F.lit(0.0)), F.least(a.y1, height)
    return F.when((x1 - x0 >= 2) & (y1 - y0 >= 2), _yolo(cls, (x0 + x1) / 2 / width, (y0 + y1) / 2 / height, (x1 - x0) / width, (y1 - y0) / height))


@F.udf(StringType(), useArrow=True)
def _yolo(cls, *numbers):
    """Decimals are those of the exact binary value, which the JVM's formatter does not give."""
    return None if None in numbers else f"{cls} " + " ".join(f"{x:.6f}" for x in numbers)


def letterbox(width: Column, height: Column, side: int = 1024) -> dict[str, Column]:
    """Gain, new size and left and top padding; halves go to even."""
    gain = F.least(F.lit(side) / width, F.lit(side) / height)
    w, h = F.bround(width * gain), F.bround(height * gain)
    return {"gain": gain, "w": w, "h": h, "left": F.bround((side - w) / 2 - 0.1), "top": F.bround((side - h) / 2 - 0.1)}


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def softmax(x: Column) -> Column:
    """Shares of an array's values, the largest taken out first."""
    e = F.transform(x, lambda v: F.exp(v - F.array_max(x)))
    return F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def tall_or_wide(a: Box, least: float = 20) -> Column:
    """Whether a box's longer side is over a number of pixels."""
    return F.greatest(a.x1 - a.x0, a.y1 - a.y0) > least


def drawn(a: Box) -> Column:
    """Whether a box has any area to draw."""
    return (a.x1 > a.x0) & (a.y1 > a.y0)


def rotated(a: Box, cx: Column, cy: Column, degrees: Column, width: Column, height: Column) -> list[Column]:
    """The box around a box turned about a centre, in the page."""
    r = F.radians(degrees)
    xs, ys = [], []
    for x, y in ((a.x0, a.y0), (a.x1, a.y0), (a.x1, a.y1), (a.x0, a.y1)):
        xs.append(cx + (x - cx) * F.cos(r) - (y - cy) * F.sin(r))
        ys.append(cy + (x - cx) * F.sin(r) + (y - cy) * F.cos(r))
    clip = lambda v, most: F.greatest(F.lit(0.0), F.least(v, most))
    return [clip(F.least(*xs), width), clip(F.least(*ys), height), clip(F.greatest(*xs), width), clip(F.greatest(*ys), height)]


def unletterbox(a: Box, width: Column, height: Column, side: int = 1024) -> list[Column]:
    """A box of the letterboxed image in the page's pixels, clipped to the page."""
    p = letterbox(width, height, side)
    clip = lambda v, most: F.greatest(F.lit(0.0), F.least(v, most))
    return [clip((a.x0 - p["left"]) / p["gain"], width), clip((a.y0 - p["top"]) / p["gain"], height), clip((a.x1 - p["left"]) / p["gain"], width), clip((a.y1 - p["top"]) / p["gain"], height)]


def of_polygon(xs: Column, ys: Column) -> list[Column]:
    """The box of a polygon's corners, cut to whole pixels toward zero."""
    return [F.array_min(xs).cast("int"), F.array_min(ys).cast("int"), F.array_max(xs).cast("int"), F.array_max(ys).cast("int")]


def warped(a: Box, h: list[float], width: Column, height: Column) -> list[Column]:
    """The box around a box's corners under a homography (nine numbers by rows), in the page."""
    xs, ys = [], []
    for x, y in ((a.x0, a.y0), (a.x1, a.y0), (a.x1, a.y1), (a.x0, a.y1)):
        w = h[6] * x + h[7] * y + h[8]
        xs.append((h[0] * x + h[1] * y + h[2]) / w)
        ys.append((h[3] * x + h[4] * y + h[5]) / w)
    clip = lambda v, most: F.greatest(F.lit(0.0), F.least(v, most))
    return [clip(F.least(*xs), width), clip(F.least(*ys), height), clip(F.greatest(*xs), width), clip(F.greatest(*ys), height)]
