"""Samples and splits by hashes, the same however rows are dealt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def round_robin(meta: DataFrame, outer: str, inner: str, key: str, per_outer: int, order: Column) -> DataFrame:
    """Up to per_outer rows of each outer stratum, taken in turn from its inner strata (sorted), each in the given order. An
    inner stratum gives no more than per_outer rows, so only those are ordered by outer stratum."""
    inside = Window.partitionBy(outer, inner).orderBy(order, key)
    turn = Window.partitionBy(outer).orderBy("__turn", inner)
    first = meta.withColumn("__turn", F.row_number().over(inside)).where(F.col("__turn") <= per_outer)
    return first.withColumn("place", F.row_number().over(turn)).where(F.col("place") <= per_outer).drop("__turn")


def hash_split(key: Column, share: float) -> Column:
    """True for the validation part: crc32 of the key as text, by thousandths."""
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(1000)) < share * 1000


def rare_first(rows: DataFrame, rare: Column, order: Column, key: str, n: int) -> DataFrame:
    """n rows, those of a rare class first."""
    return rows.orderBy(~rare, order, key).limit(n)


def uniform(seed: int, *keys: Column) -> Column:
    """A number in [0, 1) from a hash."""
    return F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 53)) / float(1 << 53)


def weighted(u: Column, weights: dict[str, float]) -> Column:
    """The value whose share of the cumulated weights holds u."""
    total, at, out = sum(weights.values()), 0.0, None
    for value, w in weights.items():
        at += w / total
        out = F.when(u < at, value) if out is None else out.when(u < at, value)
    return out.otherwise(list(weights)[-1])


def diverse_first(rows: DataFrame, key: str, cls: str, n: int) -> DataFrame:
    """The n keys with most classes, equal ones by key: key, n_classes."""
    return rows.groupBy(key).agg(F.countDistinct(cls).alias("n_classes")).orderBy(F.desc("n_classes"), key).limit(n)


def quota(rows: DataFrame, source: str, page: str, per_source: int) -> DataFrame:
    """Whole pages of each source, in order, until a page reaches the quota of rows."""
    counts = rows.groupBy(source, page).agg(F.count("*").alias("__n"))
    w = Window.partitionBy(source).orderBy(page).rowsBetween(Window.unboundedPreceding, -1)
    kept = counts.withColumn("__before", F.coalesce(F.sum("__n").over(w), F.lit(0))).where(F.col("__before") < per_source)
    return rows.join(kept.select(source, page), [source, page], "left_semi")


def splits(meta: DataFrame, outer: str, inner: str, key: str, rare: Column, order: Column, n_bench: int, n_val: int, n_train: int) -> DataFrame:
    """Disjoint benchmark and validation (each up to n per outer stratum, in turn from its inner strata) and training rows
    (rare ones first): key, split."""
    bench = round_robin(meta, outer, inner, key, n_bench, order).select(key)
    rest = meta.join(bench, key, "left_anti")
    val = round_robin(rest, outer, inner, key, n_val, -order).select(key)
    train = rare_first(rest.join(val, key, "left_anti"), rare, order, key, n_train).select(key)
    named = lambda d, s: d.withColumn("split", F.lit(s))
    return named(bench, "bench").unionByName(named(val, "val")).unionByName(named(train, "train"))
