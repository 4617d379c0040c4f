"""The named queries of the library and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import checksums
from ..functions import geometry as G
from ..functions import text as T
from ..operators import decode, flows, layout, matching, review, rules, sampling, scoring, spans, transfer
from . import oracles, toolkit
from .fixtures import BOXES, IDS, SPANS, TRUTHS, fixture, table

_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f):
    _queries[f.__name__] = f
    return f


def queries() -> dict:
    return _queries | toolkit.queries


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in oracles.all_sql().items() if k in _queries} | toolkit.sql


# Text


@query
def ascii_digits(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey")
    s = F.col("o_orderkey").cast("string")
    written = F.when(F.col("o_orderkey") % 3 == 0, F.translate(s, "0123456789", "०१२३४५६७८९")).when(F.col("o_orderkey") % 3 == 1, F.translate(s, "0123456789", "೦೧೨೩೪೫೬೭೮೯")).otherwise(F.translate(s, "123", "¹²³"))
    return o.select("o_orderkey", T.ascii_digits(written).alias("digits"))


@query
def norm(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(T.norm(F.col("text"))).alias("norm_md5"))


@query
def loose(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(T.loose(F.col("text"))).alias("loose_md5"))


@query
def squash(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(T.squash(F.col("text"))).alias("squash_md5"))


@query
def script_of(spark, sf):
    c = table(spark, sf, "customer")
    t = F.concat("c_name", F.when(F.col("c_custkey") % 3 == 0, "ಕ").when(F.col("c_custkey") % 3 == 1, "हि ಕ").otherwise(""))
    return c.select("c_custkey", T.script_of(t).alias("script"))


@query
def tokenize_offsets(spark, sf):
    """Tokens by place in the whole document: line by line, as no token holds a line end, from each line's start on."""
    lines = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("li", "line"))
    before = Window.partitionBy("doc_id").orderBy("li").rowsBetween(Window.unboundedPreceding, -1)
    t = lines.select("doc_id", F.coalesce(F.sum(F.length("line") + 1).over(before), F.lit(0)).alias("base"), T.tokens(F.col("line")).alias("t"))
    each = F.aggregate(F.transform("t", lambda x: x["start"] * 31 + x["end"]), F.lit(0).cast("long"), lambda a, x: a + x.cast("long"))
    return t.groupBy("doc_id").agg(F.sum(F.size("t")).alias("n_tokens"), F.sum(each + F.size("t") * F.col("base") * 32).alias("offsets"))


@query
def recall_tokens(spark, sf):
    w = T.recall_tokens(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.size(w).cast("long").alias("n"), F.md5(F.array_join(w, " ")).alias("words_md5"))


@query
def content_count(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.content_count(F.col("text")).cast("long").alias("n"))


@query
def levenshtein_pairs(spark, sf):
    a, b = table(spark, sf, "nation"), table(spark, sf, "nation").select(F.col("n_nationkey").alias("k2"), F.col("n_name").alias("name2"), (F.col("n_regionkey")).alias("r2"))
    return a.join(F.broadcast(b), F.col("n_regionkey") == F.col("r2")).select("n_nationkey", "k2", F.levenshtein("n_name", "name2").cast("long").alias("distance"))


@query
def cer(spark, sf):
    p = table(spark, sf, "part")
    return p.select("p_partkey", F.round(T.cer(F.col("p_name"), F.col("p_type")), 9).alias("cer"))


@query
def substring_distance(spark, sf):
    return table(spark, sf, "part").select("p_partkey", T.substring_distance(F.col("p_brand"), F.col("p_type")).alias("distance"))


@query
def inr_format(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", T.indian_grouping(F.floor(F.col("o_totalprice") * F.col("o_orderkey"))).alias("inr"))


@query
def ordinal(spark, sf):
    return table(spark, sf, "part").select("p_partkey", T.ordinal(F.col("p_partkey")).alias("ordinal"))


@query
def masked_end(spark, sf):
    o = table(spark, sf, "customer").select("c_custkey", F.concat(F.col("c_custkey").cast("string"), F.lit(" / "), F.col("c_custkey").cast("string"), F.when(F.col("c_custkey") % 2 == 0, "x").otherwise("")).alias("t"))
    return o.select("c_custkey", T.masked_end(F.col("t")).cast("long").alias("masked_end"))


@query
def safe_filename(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.safe_filename(F.col("url")).alias("name"))


@query
def python_round(spark, sf):
    return table(spark, sf, "part").select("p_partkey", T.python_round(F.col("p_retailprice"), F.lit(1)).alias("rounded"))


# Rules


def _rule(label):
    def run(spark, sf):
        found = fixture(spark, sf, IDS).select("id", F.explode(rules.matches(F.col("text"), label)).alias("m"))
        return found.select("id", F.col("m.start").cast("long").alias("start"), F.col("m.end").cast("long").alias("end"), F.col("m.text").alias("value"))

    return run


for _label, _ in rules.RULES:
    _queries["rx_" + _label.lower()] = _rule(_label)


@query
def find_rules(spark, sf):
    f = rules.find_rules(fixture(spark, sf, IDS), "id")
    return f.select("id", "label", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "value")


@query
def rule_counts(spark, sf):
    return rules.find_rules(table(spark, sf, "documents"), "doc_id").groupBy("label").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("n_docs"))


@query
def redact_text(spark, sf):
    r = rules.redact(table(spark, sf, "documents"), "doc_id")
    return r.select("doc_id", F.md5("redacted").alias("redacted_md5"), F.col("n_spans").cast("long").alias("n_spans"))


@query
def verhoeff_valid(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", checksums.verhoeff_valid(F.concat(F.lit("2"), F.lpad(F.col("o_orderkey").cast("string"), 11, "0"))).alias("valid"))


@query
def verhoeff_digit(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", checksums.verhoeff_digit(F.col("o_orderkey").cast("string")).cast("long").alias("digit"))


@query
def gstin_check(spark, sf):
    ids = fixture(spark, sf, IDS).select("id", F.regexp_extract("text", "GSTIN (.{14})", 1).alias("g"))
    return ids.select("id", checksums.gstin_check(F.col("g")).alias("check_char"))


@query
def context_filter(spark, sf):
    ids = fixture(spark, sf, IDS)
    found = rules.find_rules(ids, "id").join(ids.hint("merge"), "id")  # texts look smaller to Spark than they are: never broadcast
    keep = rules.context_keep(F.col("text"), F.col("label"), F.col("start"), F.col("end"), F.col("value"))
    return found.select("id", "label", F.col("start").cast("long").alias("start"), keep.alias("keep"))


@query
def gender_spans(spark, sf):
    found = fixture(spark, sf, IDS).select("id", F.explode(rules.gender_spans(F.col("text"))).alias("m"))
    return found.select("id", F.col("m.start").cast("long").alias("start"), F.col("m.text").alias("value"))


# Spans


def _out(d):
    return d.select("page", "label", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.round("score", 6).alias("score"))


@query
def merge_spans(spark, sf):
    return _out(spans.merge(fixture(spark, sf, SPANS), "page"))


@query
def union_spans(spark, sf):
    s = fixture(spark, sf, SPANS)
    return _out(spans.union(spans.merge(s.where("source = 'a'"), "page"), spans.merge(s.where("source = 'b'"), "page"), keys=("page",)))


@query
def span_agreement(spark, sf):
    s = fixture(spark, sf, SPANS)
    return spans.agreement(s.where("source = 'a'"), s.where("source = 'b'"), "label").withColumn("f1", F.round("f1", 9))


@query
def token_windows(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.explode(spans.windows(F.length("text"))).alias("w"))
    return d.select("doc_id", F.col("w.start").cast("long").alias("start"), F.col("w.end").cast("long").alias("end"))


@query
def char_to_token_ner(spark, sf):
    ids = fixture(spark, sf, IDS).select("id", "text", T.tokens(F.col("text")).alias("tokens"))
    found = rules.find_rules(ids, "id").join(ids.select("id", "tokens"), "id")
    s = spans.token_span(F.col("tokens"), F.col("start"), F.col("end"))
    return found.select("id", F.col("start").cast("long").alias("start"), s["first"].cast("long").alias("first"), s["last"].cast("long").alias("last"))


@query
def chunk_examples(spark, sf):
    s = fixture(spark, sf, SPANS)
    ner = s.groupBy("page").agg(F.sort_array(F.collect_list(F.struct(F.col("start").alias("first"), (F.col("end") - 1).alias("last"), "label"))).alias("ner"), F.max("end").alias("n"))
    e = ner.select("page", "ner", F.explode(spans.windows(F.col("n"), 20, 15)).alias("w"))
    e = e.select("page", F.col("w.start").alias("at"), F.explode(spans.chunk(F.col("w"), F.col("ner"))).alias("c"))
    return e.select("page", F.col("at").cast("long").alias("at"), F.col("c.first").cast("long").alias("first"), F.col("c.last").cast("long").alias("last"), F.col("c.label").alias("label"))


@query
def run_islands(spark, sf):
    r = spans.runs(fixture(spark, sf, SPANS), ["page"], ["ord"], "label")
    return r.groupBy("page", "run", "label").agg(F.min("ord").alias("first"), F.max("ord").alias("last")).select("page", "label", "first", "last")


@query
def position_scores(spark, sf):
    s = fixture(spark, sf, SPANS)
    side = lambda v: F.collect_list(F.when(F.col("source") == v, F.struct("start", "end")))
    p = spans.score_positions(s.groupBy("page").agg(side("a").alias("pred"), side("b").alias("gold")), "pred", "gold")
    return p.select("page", *(F.col(c).cast("long").alias(c) for c in ("gold_chars", "gold_cov", "pred_chars", "pred_bad")))


# Layout


def _pairs(spark, sf):
    return layout.overlap_pairs(fixture(spark, sf, BOXES), fixture(spark, sf, TRUTHS), "page")


@query
def grid_overlap_join(spark, sf):
    p = _pairs(spark, sf)
    return p.select("page", "l_ord", "r_ord", F.round(G.iou(G.Box.of("l_"), G.Box.of("r_")), 9).alias("iou"))


@query
def argmax_overlap(spark, sf):
    return layout.best_overlap(_pairs(spark, sf), "page", "l_ord", "r_ord", 0.5).select("page", "l_ord", "r_ord", F.round("share", 9).alias("share"))


@query
def pix_box(spark, sf):
    b = fixture(spark, sf, BOXES)
    c = G.pixels(G.Box("x0", "y0", F.col("x1") + F.lit(0.0005), F.col("y1") + F.lit(0.3)), G.padding(F.col("kind")), F.lit(320), F.lit(60))
    return b.select("page", "ord", *(x.alias(n) for x, n in zip(c, ("px0", "py0", "px1", "py1"), strict=True)))


@query
def union_area(spark, sf):
    b = fixture(spark, sf, BOXES).select("page", *(F.floor(c).alias(c) for c in ("x0", "y0", "x1", "y1")))
    return layout.union_area(b, "page")


@query
def coverage(spark, sf):
    ints = lambda d: d.select("page", "ord", *(F.floor(c).alias(c) for c in ("x0", "y0", "x1", "y1")))
    c = layout.coverage(ints(fixture(spark, sf, TRUTHS)), ints(fixture(spark, sf, BOXES)), "page", "ord")
    return c.select("page", "ord", F.round("coverage", 9).alias("coverage"))


@query
def fill_gaps(spark, sf):
    r = layout.fill_gaps(fixture(spark, sf, BOXES), "page")
    return r.select("page", "kind", "label", "x0", "y0", "x1", "y1", F.round("score", 6).alias("score"))


@query
def filled_union(spark, sf):
    b = fixture(spark, sf, BOXES).withColumn("engine", F.when(F.col("ord") % 2 == 0, "a").otherwise("b"))
    return flows.filled_union(b, "engine", "page").select("page", "engine", "kind", "label", "x0", "y0", "x1", "y1", F.round("score", 6).alias("score"))


@query
def span_boxes(spark, sf):
    s = fixture(spark, sf, SPANS)
    seg = fixture(spark, sf, BOXES).select("page", ((F.col("ord") - 1) * 8).cast("int").alias("start"), (F.col("ord") * 8 - 1).cast("int").alias("end"), "x0", "y0", "x1", "y1")
    b = layout.span_boxes(s.select("page", "label", "score", "start", "end"), seg, "page")
    return b.select("page", "label", F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), F.round("x0", 6).alias("x0"), "y0", F.round("x1", 6).alias("x1"), "y1")


@query
def reading_order_simple(spark, sf):
    return layout.reading_lines(fixture(spark, sf, BOXES), "page").select("page", F.col("line").cast("long").alias("line"), "ord")


@query
def reading_order_tilt(spark, sf):
    return layout.tilted_order(fixture(spark, sf, BOXES), "page")


@query
def yolo_labels(spark, sf):
    b = fixture(spark, sf, BOXES)
    return b.select("page", "ord", G.yolo_line(F.col("ord").cast("int"), G.Box.of(), F.lit(320.0), F.lit(64.0)).alias("line")).where("line is not null")


@query
def box_rotation(spark, sf):
    b = fixture(spark, sf, BOXES)
    r = G.rotated(G.Box.of(), F.lit(160.0), F.lit(32.0), F.col("ord") * 3.0, F.lit(320.0), F.lit(64.0))
    return b.select("page", "ord", *(F.round(x, 6).alias(n) for x, n in zip(r, ("rx0", "ry0", "rx1", "ry1"), strict=True)))


@query
def nms(spark, sf):
    kind = "struct<neg:double,ord:bigint,cls:string,x0:double,y0:double,x1:double,y1:double>"
    b = fixture(spark, sf, BOXES).groupBy("page").agg(F.collect_list(F.struct((-F.col("score")).alias("neg"), "ord", F.lit("a").alias("cls"), "x0", "y0", "x1", "y1")).alias("b"))
    return b.select("page", F.explode(decode.nms(F.col("b"), kind, 0.2)).alias("k")).select("page", F.col("k.ord").alias("ord"))


@query
def ner_decode(spark, sf):
    kind = "struct<neg:double,ord:bigint,first:int,last:int,label:string>"
    s = fixture(spark, sf, SPANS).groupBy("page").agg(F.collect_list(F.struct((-F.col("score")).cast("double").alias("neg"), "ord", F.col("start").alias("first"), (F.col("end") - 1).alias("last"), "label")).alias("s"))
    return s.select("page", F.explode(decode.flat_spans(F.col("s"), kind)).alias("k")).select("page", F.col("k.ord").alias("ord"))


@query
def ctc_decode(spark, sf):
    s = fixture(spark, sf, SPANS).groupBy("page").agg(F.array_sort(F.collect_list(F.struct("ord", (F.col("start") % 3).alias("i"), (1 - F.col("score") / 2).alias("p")))).alias("s"))
    c = decode.ctc(F.transform("s", lambda x: x["i"]), F.transform("s", lambda x: x["p"]))
    return s.select("page", F.array_join(c["ids"].cast("array<string>"), "").alias("ids"), F.round(c["confidence"], 6).alias("confidence"))


# Scores


@query
def ap50(spark, sf):
    b = fixture(spark, sf, BOXES).select("page", "label", F.col("ord").alias("pred"), "score", "x0", "y0", "x1", "y1")
    t = fixture(spark, sf, TRUTHS).select("page", "label", F.col("ord").alias("gt"), "x0", "y0", "x1", "y1")
    met = layout.overlap_pairs(b, t, "page").where("l_label = r_label")
    met = met.select("page", F.col("l_pred").alias("pred"), F.col("r_gt").alias("gt"), G.iou(G.Box.of("l_"), G.Box.of("r_")).alias("iou"))
    pairs = b.join(met, ["page", "pred"], "left")
    return scoring.average_precision(pairs, t, "page", "label", "pred", "score", "gt").withColumn("ap", F.round("ap", 6))


@query
def detected(spark, sf):
    p, t = fixture(spark, sf, BOXES), fixture(spark, sf, TRUTHS)
    return scoring.exists_match(p, t, "page", "label", "ord", 0.5)


@query
def pii_report(spark, sf):
    t = scoring.exists_match(fixture(spark, sf, BOXES), fixture(spark, sf, TRUTHS), "page", "label", "ord", 0.5).withColumn("part", F.col("page") % 4)
    m = {"items": F.count("*"), "found": F.count(F.when(F.col("detected"), 1)), "rate": F.round(F.try_divide(F.count(F.when(F.col("detected"), 1)), F.count("*")), 9)}
    return scoring.report(t, [[], ["label"], ["part"]], m).select("label", "part", *m)


@query
def bag_recall(spark, sf):
    p = table(spark, sf, "part")
    w = lambda c: F.split(F.lower(c), " ")
    return p.select("p_partkey", F.round(scoring.bag_recall(w(F.concat_ws(" ", "p_type", "p_name")), w(F.concat_ws(" ", "p_name", "p_brand"))), 9).alias("recall"))


@query
def best_of_engines(spark, sf):
    o = fixture(spark, sf, SPANS).groupBy("page", "label", "source").agg(F.bool_or(F.col("score") >= 0.5).alias("ok"))
    return scoring.best_of(o, ["page", "label"], "source", "ok", 2)


@query
def choose_variant(spark, sf):
    r = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("variant"), F.abs("s_acctbal").alias("mb"), (F.col("s_suppkey") % 97 / 97.0).alias("agreement"))
    return scoring.choose_variant(r, 0.9)


# Samples


@query
def stratified_round_robin(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang", "source")
    return sampling.round_robin(d, "lang", "source", "doc_id", 37, F.col("doc_id") * 7919 % 1000).select("doc_id", "lang", "source", F.col("place").cast("long").alias("place"))


@query
def hash_split(spark, sf):
    return table(spark, sf, "documents").select("doc_id", sampling.hash_split(F.col("doc_id"), 0.03).alias("val"))


@query
def train_split(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang", "source")
    return sampling.rare_first(d, F.col("lang") == "es", F.col("doc_id") * 31 % 977, "doc_id", 300).select("doc_id", "lang")


@query
def benchmark_anti_join(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang", "source")
    bench = sampling.round_robin(d, "lang", "source", "doc_id", 20, F.col("doc_id"))
    return d.join(bench.select("doc_id"), "doc_id", "left_anti").groupBy("lang").agg(F.count("*").alias("n"))


@query
def generation_stats(spark, sf):
    return table(spark, sf, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"), F.percentile("n_chars", 0.5).alias("median_chars"))


# Review and transfer


@query
def occurrence_join(spark, sf):
    s = fixture(spark, sf, SPANS)
    o = lambda v: review.occurrences(s.where(F.col("source") == v), "source", "label", F.concat(F.lit("v"), (F.col("start") % 5).cast("string")))
    p = review.pair_occurrences(o("a"), o("b"))
    return p.select("page", "label", "value", F.col("k").cast("long").alias("k"), F.col("start_a").cast("long").alias("start_a"), F.col("start_b").cast("long").alias("start_b"))


@query
def label_resolve(spark, sf):
    s = fixture(spark, sf, SPANS).groupBy("page", "label").agg(F.max("score").alias("score"))
    return review.resolve_label(s, "page").select("page", "label", F.round("score", 6).alias("score"))


@query
def near_duplicate_spans(spark, sf):
    return review.link_near_duplicates(fixture(spark, sf, SPANS), "page")


@query
def edit_replay(spark, sf):
    e = fixture(spark, sf, SPANS).select("page", F.col("ord").alias("seq"), F.when(F.col("start") % 4 != 0, F.col("start") % 3).cast("long").alias("item"), (F.col("end") % 2 == 0).alias("on"))
    return review.replay(e, "page").select("page", "item", "on", "n_edits")


@query
def contain_join(spark, sf):
    s = fixture(spark, sf, SPANS)
    words = s.where("source = 'a'").select("page", F.col("ord").alias("wi"), "start", "end")
    ents = s.where("source = 'b'").select("page", F.col("ord").alias("ei"), "start", "end")
    return transfer.entity_of_words(words, ents, "page")


@query
def transfer_words(spark, sf):
    t = fixture(spark, sf, TRUTHS).select("page", F.col("ord").alias("wi"), (F.col("ord") * 6).cast("int").alias("start"), (F.col("ord") * 6 + 5).cast("int").alias("end"), "x0", "y0", "x1", "y1")
    seg = fixture(spark, sf, BOXES).select("page", F.col("ord").alias("si"), (F.col("ord") * 9).cast("int").alias("start"), (F.col("ord") * 9 + 8).cast("int").alias("end"), F.concat(F.lit("seg"), "ord").alias("text"), "x0", "y0", "x1", "y1")
    ent = fixture(spark, sf, TRUTHS).where("ord % 4 = 1").select("page", F.col("ord").alias("ei"), (F.col("ord") * 6).cast("int").alias("start"), (F.col("ord") * 6 + 17).cast("int").alias("end"), F.concat(F.lit("seg"), "ord").alias("text"))
    g = transfer.transfer(seg, t, ent, "page")
    return g.select("page", "ei", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "ocr", F.round("cer", 9).alias("cer"))



@query
def greedy_match(spark, sf):
    m = matching.greedy_match(fixture(spark, sf, BOXES), fixture(spark, sf, TRUTHS), "page", 0.3)
    return m.select("page", "label", "pred", "gt", F.round("iou", 9).alias("iou"))


@query
def e2e_report(spark, sf):
    """Items fully hidden and pages without a leak, by label, by part of the pages, and over all."""
    c = coverage(spark, sf).join(fixture(spark, sf, TRUTHS).select("page", "ord", "label"), ["page", "ord"]).withColumn("part", F.col("page") % 4)
    hidden = F.col("coverage") >= 0.9
    m = {"items": F.count("*"), "hidden": F.count(F.when(hidden, 1)), "leaky_pages": F.countDistinct(F.when(~hidden, F.col("page")))}
    return scoring.report(c, [[], ["label"], ["part"]], m).select("label", "part", *m)


@query
def over_redaction(spark, sf):
    """Bar area off the truths, by page: the area of both less that of the truths; null is no bar."""
    ints = lambda d: d.select("page", *(F.floor(c).alias(c) for c in ("x0", "y0", "x1", "y1")))
    bars, truths = ints(fixture(spark, sf, BOXES)), ints(fixture(spark, sf, TRUTHS))
    a = layout.union_area(bars.unionByName(truths), "page").withColumnRenamed("area", "both")
    b = layout.union_area(truths, "page").withColumnRenamed("area", "true_area")
    drawn = layout.union_area(bars, "page").withColumnRenamed("area", "drawn")
    off = F.col("both") - F.coalesce("true_area", F.lit(0))
    return a.join(b, "page", "left").join(drawn, "page", "left").select("page", off.alias("off"), F.round(F.coalesce(F.try_divide(off, F.col("drawn")), F.lit(0.0)), 9).alias("share"))


@query
def ablation_grid(spark, sf):
    """Items hidden at each of three coverage thresholds: configurations crossed with the scored items."""
    grid = spark.range(3).select((F.col("id") * 0.25 + 0.45).alias("threshold"))
    return coverage(spark, sf).crossJoin(F.broadcast(grid)).groupBy("threshold").agg(F.count(F.when(F.col("coverage") >= F.col("threshold"), 1)).alias("hidden"), F.count("*").alias("items"))


@query
def transfer_lines(spark, sf):
    t = fixture(spark, sf, TRUTHS)
    words = t.select("page", F.col("ord").alias("wi"), (F.col("ord") * 6).cast("int").alias("start"), (F.col("ord") * 6 + 5).cast("int").alias("end"), F.concat(F.lit("word"), "ord").alias("text"), "x0", "y0", "x1", "y1")
    lines = fixture(spark, sf, BOXES).select("page", F.col("ord").alias("si"), F.concat(F.lit("a w0rd"), "ord", F.lit(" b")).alias("text"), "x0", "y0", "x1", "y1")
    ent = t.where("ord % 2 = 1").select("page", F.col("ord").alias("ei"), (F.col("ord") * 6).cast("int").alias("start"), (F.col("ord") * 6 + 11).cast("int").alias("end"), F.concat(F.lit("word"), "ord").alias("text"))
    g = transfer.transfer_lines(lines, words, ent, "page")
    return g.select("page", "ei", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "ocr", F.round("cer", 9).alias("cer"))


@query
def span_index(spark, sf):
    """Spans of every token window of every document, each counted from its window's start."""
    d = table(spark, sf, "documents").select("doc_id", F.regexp_count("text", F.lit(T.TOKEN)).alias("n"))
    d = d.select("doc_id", F.explode(spans.windows(F.col("n"))).alias("w"))
    d = d.select("doc_id", F.col("w.start").cast("long").alias("start"), matching.span_index(F.col("w.end") - F.col("w.start"), 12).alias("s"))
    return d.select("doc_id", "start", F.size("s").cast("long").alias("n"), F.size(F.filter("s.inside", lambda x: x)).cast("long").alias("inside"))


@query
def verdict(spark, sf):
    """Whether a change is kept: no part loses over 0.002 of found items, and none draws more."""
    r = pii_report(spark, sf).where("part is not null").select("part", "rate")
    after = r.withColumn("rate_b", F.col("rate") - F.when(F.col("part") == 2, 0.001).otherwise(0.0))
    return after.agg(F.bool_and(F.col("rate_b") - F.col("rate") >= -0.002).alias("keep"), F.count("*").alias("parts"))
