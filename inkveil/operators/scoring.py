"""Scores of detectors, recognisers and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from .layout import overlap_pairs

#: Buckets of scores from 0 to 1, about; predictions are ordered within them.
SCORE_BUCKETS = 4096


def bag_recall(truth: Column, said: Column) -> Column:
    """Share of the true words that were said, each as often as it was said."""
    counts = lambda w: F.least(F.size(F.filter(truth, lambda x: x == w)), F.size(F.filter(said, lambda x: x == w)))
    both = F.aggregate(F.array_distinct(truth), F.lit(0), lambda a, w: a + counts(w))
    return both / F.greatest(F.size(truth), F.lit(1))


def _score_bucket(score: str) -> Column:
    """A number that grows with the score, null lowest and NaN highest. The arc tangent needs no bounds of the scores."""
    place = F.floor(F.atan(F.col(score).cast("double")) * SCORE_BUCKETS)
    return F.when(F.col(score).isNull(), -2 * SCORE_BUCKETS).when(F.isnan(score), 2 * SCORE_BUCKETS).otherwise(place)


def average_precision(pairs: DataFrame, truths: DataFrame, page: str, label: str, pred: str, score: str, gt: str, least: float = 0.5) -> DataFrame:
    """AP50 by label. pairs: every prediction once or more, with iou to truths of its page and label (null: none; truths
    that share no area with it may be left out).
    The best truth of each prediction counts whether used or not; the first prediction by score on a truth is right.
    A label without truths gives no row; null scores come last, NaN first, ties by page and prediction.

    Predictions are ranked by label and bucket of scores, and buckets by label: no task orders all of a label."""
    best = Window.partitionBy(page, label, pred).orderBy(F.desc_nulls_last("iou"), F.asc_nulls_last(gt))
    top = pairs.withColumn("__b", F.row_number().over(best)).where("__b = 1").withColumn("ok", F.coalesce(F.col("iou") >= least, F.lit(False)))
    claim = Window.partitionBy(label, page, gt, "ok").orderBy(F.desc(score), pred)
    tp = top.withColumn("tp", (F.col("ok") & (F.row_number().over(claim) == 1)).cast("int")).withColumn("__k", _score_bucket(score))
    # Ranks and hits within the bucket, and those of the buckets above it
    keys = [F.col(label).alias("__l"), "__k"]
    by = Window.partitionBy("__l", "__k").orderBy(F.desc(score), page, pred)
    above = Window.partitionBy("__l").orderBy(F.desc("__k")).rowsBetween(Window.unboundedPreceding, -1)
    sums = tp.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("tp").alias("hits"))
    sums = sums.select("__l", "__k", F.coalesce(F.sum("n").over(above), F.lit(0)).alias("n"), F.coalesce(F.sum("hits").over(above), F.lit(0)).alias("hits"))
    own = tp.select(*keys, score, page, pred, "tp").withColumn("rk", F.row_number().over(by)).withColumn("own", F.sum("tp").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    hits = own.where("tp = 1").join(sums, ["__l", "__k"]).select("__l", "__k", (F.col("hits") + F.col("own")).alias("at"), ((F.col("hits") + F.col("own")) / (F.col("n") + F.col("rk"))).alias("pre"))
    # Of each hit the best precision from its rank on: within the bucket, and of the buckets below it
    down = Window.partitionBy("__l", "__k").orderBy(F.desc("at")).rowsBetween(Window.unboundedPreceding, 0)
    below = Window.partitionBy("__l").orderBy("__k").rowsBetween(Window.unboundedPreceding, -1)
    env = hits.withColumn("env", F.max("pre").over(down))
    later = hits.groupBy("__l", "__k").agg(F.max("pre").alias("most")).select("__l", "__k", F.max("most").over(below).alias("later"))
    got = env.join(later, ["__l", "__k"]).groupBy("__l").agg(F.sum(F.greatest("env", "later")).alias("sum"))
    n = truths.groupBy(label).agg(F.count("*").alias("n_gt"))
    return n.join(got, n[label] == got["__l"], "left").select(n[label], "n_gt", F.coalesce(F.col("sum") / F.col("n_gt"), F.lit(0.0)).alias("ap"))


def report(rows: DataFrame, sets: list[list[str]], measures: dict[str, Column]) -> DataFrame:
    """Measures by several groupings at once; columns that a grouping leaves out are null, grouping_id tells which."""
    columns = list(dict.fromkeys(c for s in sets for c in s))
    out = [m.alias(k) for k, m in measures.items()]
    return rows.groupingSets([[F.col(c) for c in s] for s in sets], *map(F.col, columns)).agg(F.grouping_id().alias("grouping_id"), *out)


def best_of(outcomes: DataFrame, keys: list[str], engine: str, ok: str, n: int) -> DataFrame:
    """Items that all n engines saw, with whether any got them right."""
    return outcomes.groupBy(*keys).agg(F.countDistinct(engine).alias("__n"), F.bool_or(ok).alias("any_ok"), F.count(F.when(F.col(ok), 1)).alias("n_ok")).where(F.col("__n") == n).drop("__n")


def exists_match(pred: DataFrame, truth: DataFrame, page: str, label: str, item: str, least: float = 0.5) -> DataFrame:
    """Whether any prediction of its class overlaps a truth enough (least: over 0, so only boxes that share area meet)."""
    box = ("x0", "y0", "x1", "y1")
    pairs = overlap_pairs(truth.select(page, label, item, *box), pred.select(page, label, *box), page)
    held = pairs.where((F.col("l_" + label) == F.col("r_" + label)) & (G.iou(G.Box.of("l_"), G.Box.of("r_")) >= least))
    hit = held.select(page, F.col("l_" + label).alias(label), F.col("l_" + item).alias(item), F.lit(True).alias("detected"))
    return truth.select(page, label, item, F.lit(False).alias("detected")).unionByName(hit).groupBy(page, label, item).agg(F.max("detected").alias("detected"))


def choose_variant(rows: DataFrame, least: float) -> DataFrame:
    """The smallest variant that agrees enough; else the one that agrees most."""
    return rows.agg(F.coalesce(F.min_by("variant", F.when(F.col("agreement") >= least, F.col("mb"))), F.max_by("variant", "agreement")).alias("variant"), F.coalesce(F.bool_or(F.col("agreement") >= least), F.lit(False)).alias("passed"))


def compared(outcomes: DataFrame, page: str, engine: str, part: str, n: int, measures: dict[str, Column]) -> DataFrame:
    """Measures of each engine, by part and over all parts (null), over the pages that all n engines have."""
    common = outcomes.groupBy(page).agg(F.countDistinct(engine).alias("__n")).where(F.col("__n") == n).select(page)
    return report(outcomes.join(common, page, "left_semi"), [[engine], [engine, part]], measures).drop("grouping_id")


def visual_report(truths: DataFrame, matches: DataFrame, preds: DataFrame, label: str) -> DataFrame:
    """By class and over all (null): truths (full, detected), predictions, one-to-one matches and their ratios."""
    t = truths.select(label, F.lit(1).alias("n"), F.col("full").cast("int").alias("full"), F.col("detected").cast("int").alias("det"), F.lit(0).alias("preds"), F.lit(0).alias("tp"))
    zero = [F.lit(0).alias(c) for c in ("n", "full", "det")]
    p = preds.select(label, *zero, F.lit(1).alias("preds"), F.lit(0).alias("tp"))
    m = matches.select(label, *zero, F.lit(0).alias("preds"), F.lit(1).alias("tp"))
    counts = {c: F.sum(c) for c in ("n", "full", "det", "preds", "tp")}
    r = report(t.unionByName(p).unionByName(m), [[], [label]], counts).drop("grouping_id")
    ratio = lambda a, b: F.try_divide(F.col(a), F.col(b))
    return r.withColumn("fully_redacted", ratio("full", "n")).withColumn("detected", ratio("det", "n")).withColumn("precision", ratio("tp", "preds"))


def report_diff(before: DataFrame, after: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    """Measures of two reports side by side, and their differences; rows of the first alone stay."""
    a = before.select(*keys, *(F.col(m).alias(m + "_a") for m in measures))
    b = after.select(*keys, *(F.col(m).alias(m + "_b") for m in measures))
    return a.join(b, keys, "left").select(*keys, *(c for m in measures for c in (F.col(m + "_a"), F.col(m + "_b"), (F.col(m + "_b") - F.col(m + "_a")).alias(m + "_d"))))
