"""Review of found items: occurrences, labels, near-duplicate spans, edits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType


def occurrences(spans: DataFrame, stream: str, label: str, value: Column) -> DataFrame:
    """The k-th occurrence of each value in each stream, by start."""
    w = Window.partitionBy("page", stream, label, "value").orderBy("start", "end")
    return spans.withColumn("value", value).withColumn("k", F.row_number().over(w))


def pair_occurrences(a: DataFrame, b: DataFrame) -> DataFrame:
    """The k-th occurrence in one stream with the k-th in the other; both sides stay when alone."""
    keys = ["page", "label", "value", "k"]
    left = a.select(*keys, F.col("start").alias("start_a"))
    right = b.select(*keys, F.col("start").alias("start_b"))
    return left.join(right, keys, "full")


def resolve_label(labels: DataFrame, *keys: str) -> DataFrame:
    """One label of each item: that of the best model score in [0.6, 1), else the most certain; the smaller name of equals."""
    model = (F.col("score") >= 0.6) & (F.col("score") < 1)
    w = Window.partitionBy(*keys).orderBy(F.desc(model.cast("int")), F.desc("score"), "label")
    return labels.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


@F.udf(ArrayType(StructType([StructField("ord", LongType()), StructField("item", LongType())])), useArrow=True)
def _linked(rows, share):
    rows = sorted((r["start"], r["end"], r["ord"]) for r in rows)
    owner = {r[2]: r[2] for r in rows}

    def root(o):
        while owner[o] != o:
            o = owner[o]
        return o

    live: list = []
    for r in rows:
        live = [q for q in live if q[1] > r[0]]
        for q in live:
            if min(q[1], r[1]) - r[0] >= share * min(q[1] - q[0], r[1] - r[0]):
                a, b = sorted((root(q[2]), root(r[2])))
                owner[b] = a
        live.append(r)
    return [(r[2], root(r[2])) for r in rows]


def link_near_duplicates(spans: DataFrame, page: str, share: float = 0.8) -> DataFrame:
    """Spans of a page and source that overlap by share of the shorter form one item: page, source, ord, item (smallest ord)."""
    pages = spans.groupBy(page, "source").agg(F.collect_list(F.struct("start", "end", "ord")).alias("s"))
    return pages.select(page, "source", F.explode(_linked("s", F.lit(share))).alias("r")).select(page, "source", "r.*")


def replay(edits: DataFrame, *keys: str) -> DataFrame:
    """State after a list of edits (seq, item, on; undo where item is null): each undo takes back the last edit left."""
    e = edits.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("seq", "item", "on"))).alias("e"))
    kind = "array<struct<seq:bigint,item:bigint,on:boolean>>"
    own = lambda s: F.struct(s["seq"].cast("bigint").alias("seq"), s["item"].cast("bigint").alias("item"), s["on"].alias("on"))
    stack = F.aggregate("e", F.array().cast(kind), lambda a, s: F.when(s["item"].isNotNull(), F.concat(a, F.array(own(s)))).otherwise(F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))))
    rows = e.select(*keys, F.explode(stack).alias("s")).select(*keys, "s.*")
    return rows.groupBy(*keys, "item").agg(F.max_by("on", "seq").alias("on"), F.count("*").alias("n_edits"))
