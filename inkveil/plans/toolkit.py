"""Queries of single tools, each beside its SQL (DuckDB; none where SQL has no like function)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import labels
from ..functions import text as T
from ..operators import flows, layout, matching, sampling, scoring, spans, transfer
from ..sources import records
from . import oracles
from .fixtures import BOXES, IDS, SPANS, TRUTHS, fixture, table
from .oracles import _boxes, _ids, _iou, _spans, _truths

queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
sql: dict[str, str] = {}


def query(text: str | None = None):
    def put(f):
        queries[f.__name__] = f
        if text is not None:
            sql[f.__name__] = text
        return f

    return put


# Text

_MARKS = "substr('.,;:-+$=()', CAST(c_custkey % 10 + 1 AS INT), 1) || CASE WHEN c_custkey % 3 = 0 THEN '' WHEN c_custkey % 3 = 1 THEN '!?' ELSE 'a' END"


@query(f"SELECT c_custkey, regexp_full_match({_MARKS}, '[\\pP\\pS]*') AS punct FROM customer")
def is_punct(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", T.is_punct(F.expr(_MARKS)).alias("punct"))


_WRAPPED = "substr('([{\"x', CAST(c_custkey % 5 + 1 AS INT), 1) || c_name || substr('.,;)]}\"x', CAST(c_custkey % 8 + 1 AS INT), 1) || CASE WHEN c_custkey % 2 = 0 THEN ',' ELSE '' END"
_PLAIN = "CASE WHEN c_custkey % 7 = 0 THEN '(' || c_name || ')' ELSE c_name END"


@query(f"""SELECT c_custkey, CASE WHEN h LIKE '%.' AND t NOT LIKE '%.' THEN h[:-2] ELSE h END AS value FROM (SELECT c_custkey, t, ltrim(rtrim(v, replace(',;:)]}}"''', right(t, 1), '')), replace('([{{"''', left(t, 1), '')) AS h FROM (SELECT c_custkey, {_WRAPPED} AS v, {_PLAIN} AS t FROM customer))""")
def trim_outer(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", T.trim_outer(F.expr(_WRAPPED), F.expr(_PLAIN))[1].alias("value"))


@query(f"""SELECT id, a - length(regexp_extract(substr(text, 1, a), '[^ \\n]*$')) AS "start", b + length(regexp_extract(substr(text, b + 1), '^[^ \\n]*')) AS "end" FROM (SELECT id, text, CAST(id % 50 AS BIGINT) AS a, CAST(id % 50 + 5 AS BIGINT) AS b FROM {_ids})""")
def snapped_spans(spark, sf):
    d = fixture(spark, sf, IDS)
    s = T.snapped(F.col("text"), (F.col("id") % 50).cast("int"), (F.col("id") % 50 + 5).cast("int"))
    return d.select("id", s[0].cast("long").alias("start"), s[1].cast("long").alias("end"))


@query("SELECT c_custkey, lower(replace(replace(replace(replace(replace(c_name || ' - ' || c_mktsegment || '.', ' ', ''), '-', ''), '.', ''), '#', '#'), ':', '')) AS review_key FROM customer")
def review_key(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", T.review_key(F.concat("c_name", F.lit(" - "), "c_mktsegment", F.lit("."))).alias("review_key"))


_CODES = ", ".join(f"'{v}': '{k}'" for k, v in labels.NAMES.items())
_GROUPED = ", ".join(f"'{c}': '{g}'" for g, codes in labels.GROUPS.items() for c in codes)
_NAMED = "CASE c_custkey % 4 WHEN 0 THEN ' Aadhaar Number ' WHEN 1 THEN 'upi id' WHEN 2 THEN 'Phone number' ELSE 'stamp' END"


@query(f"SELECT c_custkey, code, coalesce(MAP {{{_GROUPED}}}[code], 'manual') AS label_group FROM (SELECT c_custkey, coalesce(MAP {{{_CODES}}}[lower(trim(n))], upper(trim(n))) AS code FROM (SELECT c_custkey, {_NAMED} AS n FROM customer))")
def label_codes(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", labels.to_code(F.expr(_NAMED)).alias("code"))
    return c.withColumn("label_group", labels.group_of(F.col("code")))


@query("SELECT s_suppkey, format('{:.1f}%', s_suppkey / 8.0 * 100) AS percent FROM supplier UNION ALL SELECT -1, '–'")
def percent_format(spark, sf):
    s = table(spark, sf, "supplier").select("s_suppkey", (F.col("s_suppkey") / 8).alias("v"))
    return s.union(spark.range(1).select(F.lit(-1).cast("long"), F.lit(None).cast("double"))).select("s_suppkey", T.percent(F.col("v")).alias("percent"))


@query(f"""WITH p AS (SELECT id, list_transform(string_split(text, '5'), lambda x: length(x)) AS n FROM {_ids}),
    o AS (SELECT id, unnest(range(1, len(n))) AS i, n FROM p)
    SELECT id, CAST(list_sum(n[1:i]) + i - 1 AS BIGINT) AS "start" FROM o WHERE list_sum(n[1:i]) + i - 1 >= 40""")
def digit_occurrences(spark, sf):
    """Every place of a literal apart from a span that is taken."""
    taken = F.array(F.struct(F.lit(0).alias("start"), F.lit(40).alias("end")))
    found = F.explode(matching.occurrences(F.col("text"), "5", taken, least=1)).alias("m")
    return fixture(spark, sf, IDS).select("id", found).select("id", F.col("m.start").cast("long").alias("start"))


# Geometry

_GAIN = "least(1024 / 320.0, 1024 / 64.0)"


@query(f"""SELECT page, ord, {", ".join(f"round(greatest(0.0, least(({c} * 3 - {pad}) / 3.2, {most})), 6) AS {c}" for c, pad, most in (("x0", 0, "320.0"), ("y0", 409, "64.0"), ("x1", 0, "320.0"), ("y1", 409, "64.0")))} FROM {_boxes}""")
def unletterbox(spark, sf):
    b = fixture(spark, sf, BOXES)
    r = G.unletterbox(G.Box(*(F.col(c) * 3 for c in ("x0", "y0", "x1", "y1"))), F.lit(320.0), F.lit(64.0))
    return b.select("page", "ord", *(F.round(x, 6).alias(n) for x, n in zip(r, ("x0", "y0", "x1", "y1"), strict=True)))


@query(f"""SELECT page, ord, CAST(trunc(least(x0, x1 - 3.5)) AS INT) AS px0, CAST(trunc(y0) AS INT) AS py0, CAST(trunc(greatest(x1, x0 + 0.9)) AS INT) AS px1, CAST(trunc(y1 + 0.7) AS INT) AS py1 FROM {_boxes}""")
def polygon_box(spark, sf):
    b = fixture(spark, sf, BOXES)
    r = G.of_polygon(F.array(F.col("x0"), F.col("x1") - 3.5, F.col("x1"), F.col("x0") + 0.9), F.array(F.col("y0"), F.col("y0") + 0.2, F.col("y1") + 0.7, F.col("y1")))
    return b.select("page", "ord", *(x.alias(n) for x, n in zip(r, ("px0", "py0", "px1", "py1"), strict=True)))


_H = [1.02, 0.05, -3.0, 0.01, 0.98, 2.0, 0.0001, 0.0002, 1.0]


def _warp_sql() -> str:
    corner = lambda r, x, y: f"(({_H[3 * r]} * {x} + {_H[3 * r + 1]} * {y} + {_H[3 * r + 2]}) / ({_H[6]} * {x} + {_H[7]} * {y} + {_H[8]}))"
    corners = [("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1")]
    side = lambda r, f, most: f"round(greatest(0.0, least({f}({', '.join(corner(r, *c) for c in corners)}), {most})), 6)"
    doubles = f"(SELECT page, ord, CAST(x0 AS DOUBLE) AS x0, CAST(y0 AS DOUBLE) AS y0, CAST(x1 AS DOUBLE) AS x1, CAST(y1 AS DOUBLE) AS y1 FROM {_boxes})"
    return f"SELECT page, ord, {side(0, 'least', 320.0)} AS wx0, {side(1, 'least', 64.0)} AS wy0, {side(0, 'greatest', 320.0)} AS wx1, {side(1, 'greatest', 64.0)} AS wy1 FROM {doubles}"


@query(_warp_sql())
def warped_box(spark, sf):
    r = G.warped(G.Box.of(), _H, F.lit(320.0), F.lit(64.0))
    return fixture(spark, sf, BOXES).select("page", "ord", *(F.round(x, 6).alias(n) for x, n in zip(r, ("wx0", "wy0", "wx1", "wy1"), strict=True)))


@query(f"SELECT a.page, a.ord AS l_ord, b.ord AS r_ord, least(a.y1, b.y1) - greatest(a.y0, b.y0) >= 0.5 * least(a.y1 - a.y0, b.y1 - b.y0) AS same FROM {_boxes} a JOIN {_truths} b ON a.page = b.page AND a.ord = b.ord")
def same_line(spark, sf):
    a, t = fixture(spark, sf, BOXES), fixture(spark, sf, TRUTHS)
    b = t.select("page", "ord", *(F.col(c).alias("t" + c) for c in ("x0", "y0", "x1", "y1")))
    return a.join(b, ["page", "ord"]).select("page", F.col("ord").alias("l_ord"), F.col("ord").alias("r_ord"), G.same_line(G.Box.of(), G.Box.of("t")).alias("same"))


@query(f"SELECT page, ord, x0, y0 FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY (x1 - x0) * (y1 - y0), ord) AS r FROM {_boxes} WHERE x0 - 4 <= 100 AND x1 + 4 >= 100 AND y0 - 4 <= 30 AND y1 + 4 >= 30) WHERE r = 1")
def hit_test(spark, sf):
    """The smallest item of each page under a click."""
    return matching.hit(fixture(spark, sf, BOXES), 100, 30, 4, "page").select("page", "ord", "x0", "y0")


# Layout

_SEG_AREA = "(greatest(0.0, least(w.x1, s.x1) - greatest(w.x0, s.x0)) * greatest(0.0, least(w.y1, s.y1) - greatest(w.y0, s.y0)))"


@query(f"""SELECT w.page, w.ord AS wi, string_agg('s' || s.ord, ' ' ORDER BY s.y0, s.x0, s.ord) AS text FROM {_truths} w JOIN {_boxes} s ON w.page = s.page AND {_SEG_AREA} > 0 AND {_SEG_AREA} / greatest(1.0, (w.x1 - w.x0) * (w.y1 - w.y0)) >= 0.5 GROUP BY ALL""")
def covering_segments(spark, sf):
    words = fixture(spark, sf, TRUTHS).withColumnRenamed("ord", "wi")
    seg = fixture(spark, sf, BOXES).withColumn("text", F.concat(F.lit("s"), "ord"))
    return layout.covering(words, seg, "page").select("page", "wi", "text")


@query(f"""SELECT page, ord, CAST(e - length(t) AS BIGINT) AS "start", CAST(e AS BIGINT) AS "end" FROM (SELECT page, ord, t, sum(length(t) + 1) OVER (PARTITION BY page ORDER BY y0, ord) - 1 AS e FROM (SELECT *, 'w' || CAST(x0 AS BIGINT) AS t FROM {_boxes}))""")
def text_assembly(spark, sf):
    b = fixture(spark, sf, BOXES).select("page", "ord", F.col("y0").alias("line"), F.col("ord").alias("place"), F.concat(F.lit("w"), F.col("x0").cast("long")).alias("text"))
    return layout.assembled(b, "page").select("page", "ord", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


_GROUPED_BOXES = f"""WITH RECURSIVE c AS MATERIALIZED (SELECT page, ord, x0, x1, y0, y1, (y0 + y1) / 2 AS yc, y1 - y0 AS h, row_number() OVER (PARTITION BY page ORDER BY (y0 + y1) / 2, ord) AS rn FROM {_boxes}),
    l AS (SELECT page, rn, CAST(0 AS BIGINT) AS line, yc AS sy, h AS sh, 1 AS n FROM c WHERE rn = 1
        UNION ALL SELECT c.page, c.rn, CASE WHEN j THEN line ELSE line + 1 END, CASE WHEN j THEN sy + c.yc ELSE c.yc END, CASE WHEN j THEN sh + c.h ELSE c.h END, CASE WHEN j THEN n + 1 ELSE 1 END FROM (SELECT l.*, abs(l.sy / l.n - c.yc) < 0.5 * (l.sh / l.n) AS j, c.rn AS nr FROM l JOIN c ON c.page = l.page AND c.rn = l.rn + 1) l JOIN c ON c.page = l.page AND c.rn = l.nr),
    x AS MATERIALIZED (SELECT c.*, l.line, row_number() OVER (PARTITION BY c.page, l.line ORDER BY c.x0, c.rn) AS k FROM c JOIN l ON c.page = l.page AND c.rn = l.rn),
    g AS (SELECT page, line, k, CAST(0 AS BIGINT) AS part, h AS sh, 1 AS n, x1 AS r FROM x WHERE k = 1
        UNION ALL SELECT x.page, x.line, x.k, CASE WHEN j THEN part ELSE part + 1 END, CASE WHEN j THEN sh + x.h ELSE x.h END, CASE WHEN j THEN n + 1 ELSE 1 END, x.x1 FROM (SELECT g.*, abs(g.sh / g.n - x.h) < 0.5 * (g.sh / g.n) AND x.x0 - g.r < 0.5 * x.h AS j, x.k AS nk FROM g JOIN x ON x.page = g.page AND x.line = g.line AND x.k = g.k + 1) g JOIN x ON x.page = g.page AND x.line = g.line AND x.k = g.nk),
    b AS (SELECT x.page, x.line, g.part, count(*) AS n, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM x JOIN g ON x.page = g.page AND x.line = g.line AND x.k = g.k GROUP BY ALL)
    SELECT page, line, part, n, x0 - m AS x0, y0 - m AS y0, x1 + m AS x1, y1 + m AS y1 FROM (SELECT *, trunc(CAST(0.1 AS DOUBLE) * least(x1 - x0, y1 - y0)) AS m FROM b)"""


@query(_GROUPED_BOXES)
def grouped_boxes(spark, sf):
    return layout.grouped_boxes(fixture(spark, sf, BOXES), "page")


# Spans

@query(f"""SELECT page, label, min(ord) AS run, max(ord) AS last, count(*) AS n FROM (SELECT page, label, ord, ord - row_number() OVER (PARTITION BY page, label ORDER BY ord) AS g FROM {_spans}) GROUP BY page, label, g""")
def rank_runs(spark, sf):
    return spans.rank_runs(fixture(spark, sf, SPANS), ["page", "label"], "ord")


_WORDS = """SELECT id, key, text, CAST(p AS INT) AS "start", CAST(p + 3 AS INT) AS "end" FROM (SELECT id, id % 2 AS key, text, unnest([0, 4, 8, 13, 20, 24]) + id % 3 AS p FROM {ids})"""


@query(f"""WITH s AS ({_WORDS.format(ids=_ids)}), b AS (SELECT *, max("end") OVER (PARTITION BY id, key ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM s),
    m AS (SELECT *, sum(CASE WHEN b IS NULL OR (b < "start" AND NOT regexp_full_match(substr(text, b + 1, "start" - b), '\\s*')) THEN 1 ELSE 0 END) OVER (PARTITION BY id, key ORDER BY "start", "end") AS g FROM b)
    SELECT id, CAST(min("start") AS BIGINT) AS "start", CAST(max("end") AS BIGINT) AS "end" FROM m GROUP BY id, key, g""")
def joined_over_space(spark, sf):
    d = fixture(spark, sf, IDS).select("id", (F.col("id") % 2).alias("key"), "text", F.explode(F.array(*map(F.lit, (0, 4, 8, 13, 20, 24)))).alias("p"))
    s = d.select("id", "key", "text", (F.col("p") + F.col("id") % 3).cast("int").alias("start")).withColumn("end", F.col("start") + 3)
    r = spans.joined_over_space(s, ["id", "key"], "text")
    return r.select("id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


@query(f"""WITH w AS (SELECT page, unnest([0, 15, 30, 45]) AS s FROM (SELECT DISTINCT page FROM {_spans})), b AS (SELECT page, "start" AS f, "end" - 1 AS l FROM {_spans} WHERE score > 0.6)
    SELECT page, CAST(s AS BIGINT) AS "start" FROM w WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.page = w.page AND (f BETWEEN s AND s + 19 OR l BETWEEN s AND s + 19))""")
def readable_windows(spark, sf):
    bad = F.collect_list(F.when(F.col("score") > 0.6, F.struct(F.col("start").alias("first"), (F.col("end") - 1).alias("last"))))
    w = F.array(*(F.struct(F.lit(a).alias("start"), F.lit(a + 20).alias("end")) for a in (0, 15, 30, 45)))
    p = fixture(spark, sf, SPANS).groupBy("page").agg(bad.alias("bad"))
    return p.select("page", F.explode(spans.readable(w, F.col("bad"))).alias("w")).select("page", F.col("w.start").cast("long").alias("start"))


_EXAMPLES = "CASE WHEN c_custkey % 5 = 0 THEN [] WHEN c_custkey % 5 = 1 THEN ['a', ' '] ELSE ['a', 'b', 'c'] END"


@query(f"""SELECT c_custkey FROM (SELECT c_custkey, {_EXAMPLES} AS t, c_custkey % 3 AS s, c_custkey % 4 AS e, CASE WHEN c_custkey % 7 = 0 THEN 'other' ELSE 'email address' END AS l FROM customer)
    WHERE len(t) > 0 AND len(list_filter(t, lambda x: trim(x) = '')) = 0 AND s <= e AND e < len(t) AND l = 'email address'""")
def clean_examples(spark, sf):
    k = F.col("c_custkey")
    t = F.when(k % 5 == 0, F.array().cast("array<string>")).when(k % 5 == 1, F.array(F.lit("a"), F.lit(" "))).otherwise(F.array(*map(F.lit, "abc")))
    ner = F.array(F.struct((k % 3).cast("int").alias("first"), (k % 4).cast("int").alias("last"), F.when(k % 7 == 0, "other").otherwise("email address").alias("label")))
    e = table(spark, sf, "customer").select(k, t.alias("tokens"), ner.alias("ner"))
    return spans.clean(e, F.array(*map(F.lit, labels.NAMES.values()))).select("c_custkey")


@query("""WITH w AS (SELECT doc_id, i * 256 AS a, least(i * 256 + 256, n_chars) AS z FROM documents, unnest(range(0, CASE WHEN n_chars <= 256 THEN 1 ELSE CAST(ceil(n_chars / 256) AS BIGINT) END)) AS t(i)),
    p AS (SELECT doc_id, a, z, list_concat(range(a, z), repeat([-1], CAST(256 - (z - a) AS BIGINT))) AS s FROM w)
    SELECT doc_id, a AS "start", len(s) AS n, z - a AS held, s[1] AS first, s[256] AS last FROM p""")
def padded_feed(spark, sf):
    """Every document in windows of at most 256 ids, each padded to 256."""
    d = table(spark, sf, "documents").select("doc_id", F.explode(spans.windows(F.col("n_chars"), 256, 256)).alias("w"))
    start, end = F.col("w.start").cast("long"), F.col("w.end").cast("long")
    ids = F.when(end > start, F.sequence(start, F.greatest(end, start + 1) - 1)).otherwise(F.array().cast("array<bigint>"))
    d = d.select("doc_id", start.alias("start"), matching.padded(ids, 256, F.lit(-1).cast("long")).alias("s"))
    return d.select("doc_id", "start", F.size("s").cast("long").alias("n"), F.size(F.array_remove("s", F.lit(-1).cast("long"))).cast("long").alias("held"), F.get("s", F.lit(0)).alias("first"), F.get("s", F.lit(255)).alias("last"))


# Reports


@query(f"""WITH o AS (SELECT page, source AS engine, label, score >= 0.5 AS ok FROM {_spans} WHERE page IN (SELECT page FROM {_spans} GROUP BY page HAVING count(DISTINCT source) = 2))
    SELECT engine, label, count(*) AS items, round(avg(CAST(ok AS DOUBLE)), 9) AS rate FROM o GROUP BY GROUPING SETS ((engine), (engine, label))""")
def engine_comparison(spark, sf):
    o = fixture(spark, sf, SPANS).select("page", F.col("source").alias("engine"), "label", (F.col("score") >= 0.5).alias("ok"))
    m = {"items": F.count("*"), "rate": F.round(F.avg(F.col("ok").cast("double")), 9)}
    return scoring.compared(o, "page", "engine", "label", 2, m).select("engine", "label", *m)


def _visual(spark, sf):
    from . import catalog

    t = fixture(spark, sf, TRUTHS).select("page", "ord", "label")
    full = catalog.coverage(spark, sf).select("page", "ord", (F.col("coverage") >= 0.95).alias("full"))
    truths = t.join(full, ["page", "ord"]).join(catalog.detected(spark, sf), ["page", "label", "ord"])
    return truths, catalog.greedy_match(spark, sf), fixture(spark, sf, BOXES)


_DONE = oracles.all_sql()


@query(f"""WITH c AS (SELECT * FROM ({_DONE['coverage']})), d AS (SELECT * FROM ({_DONE['detected']})), m AS (SELECT * FROM ({_DONE['greedy_match']})),
    t AS (SELECT d.label, c.coverage >= 0.95 AS f, d.detected AS det FROM d JOIN c USING (page, ord)),
    u AS (SELECT label, 1 AS n, CAST(f AS INT) AS f, CAST(det AS INT) AS det, 0 AS p, 0 AS tp FROM t UNION ALL SELECT label, 0, 0, 0, 1, 0 FROM {_boxes} UNION ALL SELECT label, 0, 0, 0, 0, 1 FROM m)
    SELECT label, CAST(sum(n) AS BIGINT) AS n, CAST(sum(p) AS BIGINT) AS preds, CAST(sum(tp) AS BIGINT) AS tp, round(sum(f) / nullif(sum(n), 0), 9) AS fully_redacted, round(sum(det) / nullif(sum(n), 0), 9) AS detected, round(sum(tp) / nullif(sum(p), 0), 9) AS "precision" FROM u GROUP BY GROUPING SETS ((), (label))""")
def visual_report(spark, sf):
    r = scoring.visual_report(*_visual(spark, sf), "label")
    return r.select("label", "n", "preds", "tp", *(F.round(c, 9).alias(c) for c in ("fully_redacted", "detected", "precision")))


@query(f"""WITH r AS (SELECT source, label, count(*) AS n, sum(CAST("end" - "start" AS BIGINT)) AS chars FROM {_spans} GROUP BY ALL), a AS (SELECT label, n, chars FROM r WHERE source = 'a'), b AS (SELECT label, n, chars FROM r WHERE source = 'b' AND label <> 'L0')
    SELECT a.label, a.n AS n_a, b.n AS n_b, b.n - a.n AS n_d, CAST(a.chars AS BIGINT) AS chars_a, CAST(b.chars AS BIGINT) AS chars_b, CAST(b.chars - a.chars AS BIGINT) AS chars_d FROM a LEFT JOIN b USING (label)""")
def report_diff(spark, sf):
    r = fixture(spark, sf, SPANS).groupBy("source", "label").agg(F.count("*").alias("n"), F.sum((F.col("end") - F.col("start")).cast("long")).alias("chars"))
    return scoring.report_diff(r.where("source = 'a'"), r.where("source = 'b' AND label <> 'L0'"), ["label"], ["n", "chars"])


def _segments(d, source):
    s = F.struct(F.col("label").alias("text"), F.array("start", "end").alias("bbox"), "score")
    return d.where(F.col("source") == source).groupBy("page").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", s.alias("s")))), lambda x: x["s"]).alias("segments"))


@query(f"""WITH s AS (SELECT *, row_number() OVER (PARTITION BY page, source ORDER BY ord) AS pos FROM {_spans})
    SELECT coalesce(a.page, b.page) AS page, count(*) AS n, count(*) FILTER (a.label = b.label) AS same_text, count(*) FILTER (a."start" = b."start" AND a."end" = b."end") AS same_box, round(max(abs(a.score - b.score)), 9) AS max_diff
    FROM (SELECT * FROM s WHERE source = 'a') a FULL JOIN (SELECT * FROM s WHERE source = 'b') b ON a.page = b.page AND a.pos = b.pos GROUP BY 1""")
def engine_parity(spark, sf):
    d = fixture(spark, sf, SPANS)
    return matching.parity(_segments(d, "a"), _segments(d, "b"), "page").withColumn("max_diff", F.round("max_diff", 9))


@query(f"SELECT label, kind, count(*) AS n FROM {_boxes} GROUP BY ALL")
def region_counts(spark, sf):
    return fixture(spark, sf, BOXES).groupBy("label", "kind").agg(F.count("*").alias("n"))


@query("SELECT s_suppkey AS epoch, round(CAST(0.1 AS DOUBLE) * (s_suppkey % 10) + CAST(0.9 AS DOUBLE) * (s_suppkey * 7 % 13), 9) AS fitness FROM supplier ORDER BY fitness DESC, epoch LIMIT 1")
def best_epoch(spark, sf):
    k = F.col("s_suppkey")
    m = table(spark, sf, "supplier").select(k.alias("epoch"), (k % 10).cast("double").alias("a"), (k * 7 % 13).cast("double").alias("b"))
    return records.best_epoch(m, "a", "b").select("epoch", F.round("fitness", 9).alias("fitness"))


@query("""SELECT n_name || '@' || CAST(t AS VARCHAR) AS system, n_name AS name, CAST(t AS DOUBLE) AS threshold FROM nation, (VALUES (0.3), (0.5), (0.7)) v(t) WHERE n_regionkey > 0""")
def system_grid(spark, sf):
    """Systems that are there, crossed with three thresholds."""
    grid = spark.range(3).select((0.3 + F.col("id") * 0.2).cast("decimal(2,1)").alias("t"))
    n = table(spark, sf, "nation").where("n_regionkey > 0").crossJoin(F.broadcast(grid))
    return n.select(F.concat("n_name", F.lit("@"), F.col("t").cast("string")).alias("system"), F.col("n_name").alias("name"), F.col("t").cast("double").alias("threshold"))


# Samples


@query(f"SELECT page, count(DISTINCT label) AS n_classes FROM {_boxes} GROUP BY page ORDER BY n_classes DESC, page LIMIT 50")
def diverse_first(spark, sf):
    return sampling.diverse_first(fixture(spark, sf, BOXES), "page", "label", 50)


@query(f"""WITH c AS (SELECT label, page, count(*) AS n FROM {_boxes} GROUP BY ALL), k AS (SELECT label, page, coalesce(sum(n) OVER (PARTITION BY label ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM c)
    SELECT label, page, ord FROM {_boxes} JOIN k USING (label, page) WHERE b < 100""")
def page_quota(spark, sf):
    return sampling.quota(fixture(spark, sf, BOXES), "label", "page", 100).select("label", "page", "ord")


_PICK = "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY lang ORDER BY t, source) AS place FROM (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY {o}, doc_id) AS t FROM {d})) WHERE place <= {n}"


@query(f"""WITH b AS ({_PICK.format(o="doc_id * 31 % 977", d="documents", n=20)}), r AS (SELECT * FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM b)), v AS ({_PICK.format(o="-(doc_id * 31 % 977)", d="r", n=10)}),
    t AS (SELECT doc_id FROM r WHERE doc_id NOT IN (SELECT doc_id FROM v) ORDER BY lang <> 'es', doc_id * 31 % 977, doc_id LIMIT 300)
    SELECT doc_id, 'bench' AS split FROM b UNION ALL SELECT doc_id, 'val' FROM v UNION ALL SELECT doc_id, 'train' FROM t""")
def dataset_splits(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang", "source")
    return sampling.splits(d, "lang", "source", "doc_id", F.col("lang") == "es", F.col("doc_id") * 31 % 977, 20, 10, 300)


@query("SELECT c_custkey, CASE WHEN u < 0.4 THEN 'en' WHEN u < 0.7 THEN 'hi-en' ELSE 'kn-en' END AS lang FROM (SELECT c_custkey, c_custkey * 7919 % 1009 / 1009.0 AS u FROM customer)")
def weighted_choice(spark, sf):
    u = F.col("c_custkey") * 7919 % 1009 / 1009.0
    return table(spark, sf, "customer").select("c_custkey", sampling.weighted(u, {"en": 0.4, "hi-en": 0.3, "kn-en": 0.3}).alias("lang"))


# Sources and transfer


@query("""SELECT o_orderkey, 'w' || o_custkey AS text, CAST(o_orderkey % 100 AS INT) AS x0, CAST(o_custkey % 50 AS INT) AS y0, CAST(o_orderkey % 100 + 20 AS INT) AS x1, CAST(o_custkey % 50 + 10 AS INT) AS y1, CAST(o_custkey % 101 AS DOUBLE) / 100 AS score FROM orders WHERE o_orderkey % 3 <> 0 AND o_orderkey % 7 <> 0""")
def tsv_words(spark, sf):
    o, k = F.col("o_orderkey"), F.col("o_custkey")
    level = F.when(o % 3 == 0, "4").otherwise("5")
    word = F.when(o % 7 == 0, " ").otherwise(F.concat(F.lit("w"), k))
    line = F.concat_ws("\t", level, *[F.lit("1")] * 5, (o % 100).cast("string"), (k % 50).cast("string"), F.lit("20"), F.lit("10"), (k % 101).cast("string"), word)
    return records.tsv_words(table(spark, sf, "orders").select("o_orderkey", line.alias("value")), "o_orderkey")


@query(f"""SELECT page, label AS text, x0, y0 FROM {_boxes}""")
def block_words(spark, sf):
    b = fixture(spark, sf, BOXES)
    word = F.struct(F.col("label").alias("text"), "x0", "y0", "x1", "y1", F.col("score").cast("double").alias("confidence"))
    held = b.groupBy("page").agg(F.array(F.struct(F.array(F.struct(F.array(F.struct(F.collect_list(word).alias("words"))).alias("lines"))).alias("paragraphs"))).alias("blocks"))
    w = held.select("page", F.explode(records.words_of_blocks(F.col("blocks"))).alias("w"))
    return w.select("page", "w.text", "w.x0", "w.y0")


@query("SELECT DISTINCT p_brand || '.jpg' AS name FROM part WHERE p_partkey % 2 = 0 ORDER BY name LIMIT 20")
def face_files(spark, sf):
    name = F.concat("p_brand", F.when(F.col("p_partkey") % 2 == 0, ".jpg").otherwise(".txt"))
    return records.face_files(table(spark, sf, "part").select(name.alias("n")), "n", 20)


@query(f"""WITH g AS (SELECT page, label, "end" - "start" AS len, score FROM {_spans}) SELECT label, count(*) AS transferred, count(*) FILTER (score > 0.6) AS bad, round(avg(score), 9) AS mean_cer FROM g GROUP BY GROUPING SETS ((), (label))""")
def transfer_stats(spark, sf):
    g = fixture(spark, sf, SPANS).select("page", "label", F.col("score").alias("cer"))
    return transfer.stats(g, ["label"], 0.6).select("label", "transferred", "bad", F.round("mean_cer", 9).alias("mean_cer"))


# Flows


@query("SELECT o_orderkey, o_custkey, c_name AS said FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_custkey % 5 <> 0 AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey < 12)")
def records_beside(spark, sf):
    c = table(spark, sf, "customer")
    read = c.select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("said"), F.when(F.col("c_custkey") % 5 == 0, "bad").alias("error"))
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return flows.beside(o, read, "o_custkey", c.where("c_nationkey < 12").select(F.col("c_custkey").alias("o_custkey"))).select("o_orderkey", "o_custkey", "said")


@query("SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'own/' || page_id ELSE url END AS url FROM pages")
def page_files(spark, sf):
    p = table(spark, sf, "pages").select("page_id", "url")
    return flows.page_files(p, p.where("page_id % 3 = 0").select("page_id", F.concat(F.lit("own/"), "page_id").alias("url")), "page_id", "url").select("page_id", "url")


_CRC = oracles.crc32_sql("CAST(c_custkey AS VARCHAR)")


@query(f"SELECT 'a/b/' || c_custkey AS file, CASE WHEN {_CRC} % 10 = 0 THEN 'heldout' ELSE 'train' END AS pool FROM customer")
def face_pools(spark, sf):
    return flows.pools(table(spark, sf, "customer").select(F.concat(F.lit("a/b/"), "c_custkey").alias("file")), "file")


@query(f"""WITH i AS (SELECT 'g' || page % 3 AS lang, kind AS doc_type, s AS script, label || CASE WHEN s = 'latin' THEN '' ELSE ' (' || s || ')' END AS label, score FROM (SELECT *, CASE WHEN ord % 3 = 0 THEN 'kannada' ELSE 'latin' END AS s FROM {_boxes}))
    SELECT CASE WHEN grouping(lang) = 0 THEN 'lang' WHEN grouping(doc_type) = 0 THEN 'doc_type' WHEN grouping(script) = 0 THEN 'script' WHEN grouping(label) = 0 THEN 'label' ELSE 'overall' END AS part, coalesce(lang, doc_type, script, label) AS value, count(*) AS n, round(count(*) FILTER (score >= 0.25) / count(*), 9) AS "found"
    FROM i GROUP BY GROUPING SETS ((), (lang), (doc_type), (script), (label))""")
def recognition_report(spark, sf):
    script = F.when(F.col("ord") % 3 == 0, "kannada").otherwise("latin")
    i = fixture(spark, sf, BOXES).select(F.concat(F.lit("g"), F.col("page") % 3).alias("lang"), F.col("kind").alias("doc_type"), script.alias("script"), "label", "score")
    return flows.recognition_report(i, {"n": F.count("*"), "found": F.round(F.count(F.when(F.col("score") >= 0.25, 1)) / F.count("*"), 9)})


@query(f"SELECT page, ord FROM {_boxes} WHERE greatest(x1 - x0, y1 - y0) > 40 AND x1 - 30 > x0 AND y1 - 12 > y0")
def box_filters(spark, sf):
    b = fixture(spark, sf, BOXES)
    shrunk = G.Box("x0", "y0", F.col("x1") - 30, F.col("y1") - 12)
    return b.where(G.tall_or_wide(G.Box.of(), 40) & G.drawn(shrunk)).select("page", "ord")


@query("SELECT s_suppkey, round(exp(a) / (exp(a) + exp(b) + 1), 9) AS first, round(1 / (exp(a) + exp(b) + 1), 9) AS last FROM (SELECT s_suppkey, s_suppkey % 7 / 2.0 AS a, s_suppkey % 3 - 1.5 AS b FROM supplier)")
def softmax(spark, sf):
    x = F.array((F.col("s_suppkey") % 7 / 2.0), (F.col("s_suppkey") % 3 - 1.5).cast("double"), F.lit(0.0))
    s = table(spark, sf, "supplier").select("s_suppkey", G.softmax(x).alias("p"))
    return s.select("s_suppkey", F.round(F.get("p", F.lit(0)), 9).alias("first"), F.round(F.get("p", F.lit(2)), 9).alias("last"))


@query("SELECT key, CAST(sum(n) AS BIGINT) AS n FROM (SELECT c_mktsegment AS key, c_custkey AS n FROM customer UNION ALL SELECT 'all', 1 FROM customer) GROUP BY key")
def summed_counts(spark, sf):
    c = table(spark, sf, "customer").select(F.create_map("c_mktsegment", "c_custkey", F.lit("all"), F.lit(1).cast("long")).alias("m"))
    return flows.summed(c, "m")
