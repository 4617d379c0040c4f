"""Decoders of model outputs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _iou(a: Column, b: Column) -> Column:
    w = F.greatest(F.lit(0.0), F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]))
    h = F.greatest(F.lit(0.0), F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"]))
    union = (a["x1"] - a["x0"]) * (a["y1"] - a["y0"]) + (b["x1"] - b["x0"]) * (b["y1"] - b["y0"]) - w * h
    return F.when(union > 0, w * h / union).otherwise(0.0)


def nms(boxes: Column, schema: str, over: float = 0.5, most: int = 300) -> Column:
    """Boxes (struct of neg score, ord, cls, x0, y0, x1, y1) by score, each dropped if a kept one of its class overlaps it
    by more than over; at most `most` stay, as the detector has it."""

    def step(kept, b):
        clash = F.exists(kept, lambda k: (k["cls"] == b["cls"]) & (_iou(k, b) > over))
        return F.when(clash | (F.size(kept) >= most), kept).otherwise(F.concat(kept, F.array(b)))

    return F.aggregate(F.array_sort(boxes), F.array().cast(f"array<{schema}>"), step)


def flat_spans(spans: Column, schema: str) -> Column:
    """Spans (struct of neg score, ord, first, last, label) by score, each kept if no kept one overlaps; then by start."""

    def step(kept, s):
        clash = F.exists(kept, lambda k: (k["first"] <= s["last"]) & (s["first"] <= k["last"]))
        return F.when(clash, kept).otherwise(F.concat(kept, F.array(s)))

    chosen = F.aggregate(F.array_sort(spans), F.array().cast(f"array<{schema}>"), step)
    return F.array_sort(chosen, lambda a, b: F.when(a["first"] < b["first"], -1).when(a["first"] > b["first"], 1).otherwise(0))


def ctc(indices: Column, best: Column) -> Column:
    """Greedy CTC: (ids without blanks 0 and repeats, confidence prod(p) ** (2 / sqrt(n)) over kept steps; 0 for none)."""
    steps = F.transform(F.arrays_zip(indices.alias("i"), best.alias("p")), lambda s, k: F.struct(s["i"].alias("i"), s["p"].alias("p"), F.when(k > 0, F.get(indices, k - 1)).alias("was")))
    kept = F.filter(steps, lambda s: (s["i"] != 0) & ~s["i"].eqNullSafe(s["was"]))
    product = F.aggregate(kept, F.lit(1.0), lambda a, s: a * s["p"].cast("double"))
    return F.struct(F.transform(kept, lambda s: s["i"]).alias("ids"), F.when(F.size(kept) > 0, F.pow(product, 2 / F.sqrt(F.size(kept)))).otherwise(0.0).alias("confidence"))
