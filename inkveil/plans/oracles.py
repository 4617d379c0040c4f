"""SQL (DuckDB) that gives the same rows as the catalogue's queries."""

from __future__ import annotations

from ..functions import checksums
from .fixtures import BOXES, IDS, SPANS, TRUTHS, oracle

_ids, _boxes, _truths, _spans = (f"({oracle(s)})" for s in (IDS, BOXES, TRUTHS, SPANS))
_WS = r"\s\x0b\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_WORD = r"\pL\pN_"
_INDIC = "".join(chr(b + d) for b in (0x966, 0x9E6, 0xBE6, 0xC66, 0xCE6) for d in range(10))
def _norm(e: str) -> str:
    bare = f"regexp_replace(nfc_normalize({e}), '[\\x{{200b}}\\x{{200c}}\\x{{200d}}\\x{{feff}}]', '', 'g')"
    return f"trim(regexp_replace(translate({bare}, '{_INDIC}', '{'0123456789' * 5}'), '[{_WS}]+', ' ', 'g'))"


def _fold(e: str) -> str:
    return f"replace(lower({e}), 'ß', 'ss')"


_G = r"\b"
_PATTERNS = {
    "ABHA": _G + r"\d{2}-\d{4}-\d{4}-\d{4}" + _G,
    "AADHAAR": _G + r"[2-9]\d{3}[ -]?\d{4}[ -]?\d{4}" + _G,
    "GSTIN": _G + r"\d{2}[A-Z]{5}\d{4}[A-Z][1-9A-Z]Z[0-9A-Z]" + _G,
    "PAN": _G + r"[A-Z]{3}[ABCFGHLJPT][A-Z]\d{4}[A-Z]" + _G,
    "IFSC": _G + r"[A-Z]{4}0[A-Z0-9]{6}" + _G,
    "EMAIL": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "UPI_ID": r"([A-Za-z0-9._-]{2,}@[A-Za-z]{2,})(?:[^A-Za-z0-9.]|$)",
    "PHONE": r"(?:\+91[ -]?)?" + _G + r"[6-9]\d{4}[ -]?\d{5}" + _G,
    "VOTER_ID": _G + r"[A-Z]{3}\d{7}" + _G,
    "PASSPORT": _G + r"[A-PR-WYZ][1-9]\d{6}" + _G,
    "UAN": _G + r"10\d{10}" + _G,
    "VEHICLE_REG": _G + r"[A-Z]{2}[ -]?\d{1,2}[ -]?[A-Z]{1,2}[ -]?\d{4}" + _G,
}


def _verhoeff(d: str, shift: int) -> str:
    p = f"list_transform(range(1, length({d}) + 1), lambda i: CAST(substr('{checksums._P}', CAST(((i - 1 + {shift}) % 8) * 10 + CAST(substr(reverse({d}), CAST(i AS INT), 1) AS INT) + 1 AS INT), 1) AS INT))"
    return f"list_reduce(list_concat([0], {p}), lambda a, x: CAST(substr('{checksums._D}', a * 10 + x + 1, 1) AS INT))"


def _gstin(g: str) -> str:
    a = checksums._ALPHABET
    v = f"(instr('{a}', substr({g}, CAST(i AS INT), 1)) - 1) * ((i - 1) % 2 + 1)"
    return f"substr('{a}', CAST((36 - list_sum(list_transform(range(1, 15), lambda i: ({v}) // 36 + ({v}) % 36)) % 36) % 36 AS INT) + 1, 1)"


def _matches(src: str, label: str, key: str = "id") -> str:
    """Rows (key, start, end, value) of one pattern, by the lengths of matches and of what lies between."""
    p = _PATTERNS[label]
    group = 1 if label == "UPI_ID" else 0
    check = {"AADHAAR": f"WHERE {_verhoeff(chr(34) + 'd' + chr(34), 0)} = 0", "GSTIN": f"WHERE {_gstin('value')} = substr(value, 15, 1)"}.get(label, "")
    d = ", regexp_replace(value, '[ -]', '', 'g') AS d" if label == "AADHAAR" else ""
    return f"""SELECT {key}, "start", "start" + length(value) AS "end", value FROM (SELECT *{d} FROM (
        SELECT {key}, CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS "start", v[i] AS value
        FROM (SELECT {key}, regexp_extract_all(text, '{p}') AS m, regexp_extract_all(text, '{p}', {group}) AS v, regexp_split_to_array(text, '{p}') AS g FROM {src}) q, unnest(range(1, len(m) + 1)) AS t(i)) w) z {check}"""


def _chosen(src: str, key: str = "id") -> str:
    """All rules, then the greedy walk."""
    every = " UNION ALL ".join(f"SELECT *, {i} AS ord, '{label}' AS label FROM ({_matches(src, label, key)})" for i, label in enumerate(_PATTERNS))
    return f"""(WITH RECURSIVE c AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY "start", "start" - "end", ord) AS rn FROM ({every})),
        w AS (SELECT {key}, CAST(0 AS BIGINT) AS rn, CAST(0 AS BIGINT) AS last, false AS kept FROM (SELECT DISTINCT {key} FROM c)
            UNION ALL SELECT c.{key}, c.rn, CASE WHEN c."start" >= w.last THEN c."end" ELSE w.last END, c."start" >= w.last FROM w JOIN c ON c.{key} = w.{key} AND c.rn = w.rn + 1)
        SELECT c.{key}, c.label, c."start", c."end", c.value FROM c JOIN w ON c.{key} = w.{key} AND c.rn = w.rn WHERE w.kept)"""


def _merged(src: str) -> str:
    return f"""(SELECT page, label, min("start") AS "start", max("end") AS "end", max(score) AS score FROM (
        SELECT *, sum(n) OVER (PARTITION BY page, label ORDER BY "start", "end" ROWS UNBOUNDED PRECEDING) AS g FROM (
        SELECT *, CASE WHEN "start" <= max("end") OVER (PARTITION BY page, label ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS n FROM {src})) GROUP BY page, label, g)"""


def _inter(a: str, b: str) -> str:
    return f"greatest(0, least({a}.x1, {b}.x1) - greatest({a}.x0, {b}.x0)) * greatest(0, least({a}.y1, {b}.y1) - greatest({a}.y0, {b}.y0))"


def _iou(a: str, b: str) -> str:
    area = lambda t: f"({t}.x1 - {t}.x0) * ({t}.y1 - {t}.y0)"
    return f"({_inter(a, b)}) / ({area(a)} + {area(b)} - {_inter(a, b)})"


def _area(src: str, keys: str) -> str:
    join = " AND ".join(f"s.{k.strip()} = f.{k.strip()}" for k in keys.split(","))
    k = ", ".join(f"f.{x.strip()}" for x in keys.split(","))
    return f"""(WITH f AS (SELECT * FROM {src} WHERE x1 > x0 AND y1 > y0), ys AS (SELECT DISTINCT {keys}, unnest([y0, y1]) AS y FROM f),
        s AS (SELECT *, lead(y) OVER (PARTITION BY {keys} ORDER BY y) AS y2 FROM ys),
        r AS (SELECT {k}, s.y, s.y2, f.x0, f.x1, max(f.x1) OVER (PARTITION BY {k}, s.y ORDER BY f.x0, f.x1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM s JOIN f ON {join} AND f.y0 <= s.y AND f.y1 >= s.y2)
        SELECT {keys}, CAST(sum((y2 - y) * greatest(0, x1 - greatest(x0, coalesce(seen, x0)))) AS BIGINT) AS area FROM r GROUP BY {keys})"""


_INT_BOXES = f"(SELECT page, ord, CAST(floor(x0) AS BIGINT) AS x0, CAST(floor(y0) AS BIGINT) AS y0, CAST(floor(x1) AS BIGINT) AS x1, CAST(floor(y1) AS BIGINT) AS y1 FROM {_boxes})"
_INT_TRUTHS = _INT_BOXES.replace(_boxes, _truths)
_CORNERS = (("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1"))
_XS = ", ".join(f"160 + ({x} - 160) * cos(r) - ({y} - 32) * sin(r)" for x, y in _CORNERS)
_YS = ", ".join(f"32 + ({x} - 160) * sin(r) + ({y} - 32) * cos(r)" for x, y in _CORNERS)
_ROTATED = f"""SELECT page, ord, round(greatest(0, least(least({_XS}), 320)), 6) AS rx0, round(greatest(0, least(least({_YS}), 64)), 6) AS ry0, round(greatest(0, least(greatest({_XS}), 320)), 6) AS rx1, round(greatest(0, least(greatest({_YS}), 64)), 6) AS ry1
    FROM (SELECT *, radians(ord * 3.0) AS r FROM {_boxes})"""
_DETECTED = f"""(SELECT t.page, t.label, t.ord, coalesce(bool_or({_iou("t", "b")} >= 0.5), false) AS detected FROM {_truths} t LEFT JOIN {_boxes} b ON t.page = b.page AND t.label = b.label GROUP BY ALL)"""
_ROBIN = """(SELECT doc_id, lang, source, row_number() OVER (PARTITION BY lang ORDER BY turn, source) AS place FROM (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY {}, doc_id) AS turn FROM documents))"""


def _walk(cand: str, item: str, clash: str) -> str:
    """Greedy choice in order rn: a candidate stays if it clashes with no kept one (k); kept ones go along as a list."""
    return f"""WITH RECURSIVE c AS MATERIALIZED (SELECT page, rn, {item} AS c FROM ({cand})),
        w AS (SELECT page, rn, [c] AS kept FROM c WHERE rn = 1
            UNION ALL SELECT c.page, c.rn, CASE WHEN len(list_filter(w.kept, lambda k: {clash})) > 0 THEN w.kept ELSE list_append(w.kept, c.c) END FROM w JOIN c ON c.page = w.page AND c.rn = w.rn + 1)
        SELECT page, k.ord AS ord FROM (SELECT page, unnest(kept) AS k FROM (SELECT page, arg_max(kept, rn) AS kept FROM w GROUP BY page))"""


def _chained(name: str, c: str) -> str:
    """Tables name_w and name (page, rn, line): segments c (page, rn, y, h) in turn, each to the nearest line end within 0.6 h."""
    return f"""{name}_w AS (SELECT page, rn, [y] AS ends, [CAST(1 AS BIGINT)] AS line FROM {c} WHERE rn = 1
        UNION ALL SELECT page, nr, CASE WHEN d[k] <= CAST(0.6 AS DOUBLE) * h THEN list_transform(ends, lambda e, i: CASE WHEN i = k THEN y ELSE e END) ELSE list_append(ends, y) END, list_append(line, CASE WHEN d[k] <= CAST(0.6 AS DOUBLE) * h THEN k ELSE len(ends) + 1 END)
            FROM (SELECT *, CAST(list_position(d, list_min(d)) AS BIGINT) AS k FROM (SELECT w.*, c.rn AS nr, c.y, c.h, list_transform(w.ends, lambda e: abs(c.y - e)) AS d FROM {name}_w w JOIN {c} c ON c.page = w.page AND c.rn = w.rn + 1))),
        {name} AS (SELECT page, unnest(range(1, len(line) + 1)) AS rn, unnest(line) AS line FROM (SELECT page, arg_max(line, rn) AS line FROM {name}_w GROUP BY page))"""


def _tilted() -> str:
    middle = lambda v: f"list_sort({v})[(len({v}) + 1) // 2] / 2 + list_sort({v})[len({v}) // 2 + 1] / 2"
    return f"""WITH RECURSIVE s AS MATERIALIZED (SELECT *, (x0 + x1) / 2 AS xc, (y0 + y1) / 2 AS yc, row_number() OVER (PARTITION BY page ORDER BY x0, ord) AS rn FROM {_boxes}),
        h AS MATERIALIZED (SELECT page, {middle('v')} AS h FROM (SELECT page, list(y1 - y0) AS v FROM s GROUP BY page)),
        c AS MATERIALIZED (SELECT page, rn, yc AS y, h FROM s JOIN h USING (page)), {_chained('l', 'c')},
        e AS (SELECT page, line, arg_min(xc, rn) AS ax, arg_min(yc, rn) AS ay, arg_max(xc, rn) AS bx, arg_max(yc, rn) AS y2 FROM l JOIN s USING (page, rn) GROUP BY page, line),
        m AS (SELECT page, {middle('v')} AS slope FROM (SELECT page, list((y2 - ay) / (bx - ax)) AS v FROM e WHERE bx > ax GROUP BY page)),
        t AS MATERIALIZED (SELECT s.page, rn, ord, yc - coalesce(slope, 0) * (x0 + x1) / 2 AS y, h FROM s JOIN h USING (page) LEFT JOIN m USING (page)), {_chained('r', 't')},
        o AS (SELECT page, line, row_number() OVER (PARTITION BY page ORDER BY round(sum(y) / count(*), 6), line) - 1 AS k FROM r JOIN t USING (page, rn) GROUP BY page, line)
        SELECT page, ord, CAST(k AS INT) AS line, CAST(row_number() OVER (PARTITION BY page, line ORDER BY rn) - 1 AS INT) AS pos FROM r JOIN t USING (page, rn) JOIN o USING (page, line)"""


def crc32_sql(e: str) -> str:
    """crc32 of ASCII text, bit by bit."""
    bit = "list_reduce(list_concat([xor(c, CAST(x AS BIGINT))], [0, 0, 0, 0, 0, 0, 0, 0]), lambda k, z: CASE WHEN k % 2 = 1 THEN xor(k // 2, 3988292384) ELSE k // 2 END)"
    return f"xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(string_split({e}, ''), lambda d: CAST(ascii(d) AS BIGINT))), lambda c, x: {bit}), 4294967295)"


def all_sql() -> dict[str, str]:
    token = rf"[{_WORD}]+(?:[-_][{_WORD}]+)*|[^{_WS}]"
    n = _norm("text")
    trimmed = f"regexp_replace(regexp_replace(w, '^[^{_WORD}]+', ''), '[^{_WORD}]+$', '')"
    content = r"'[^\pL\pM\pN]', '', 'g'"
    lower_words = f"list_filter(list_transform(string_split({n}, ' '), lambda w: {_fold(trimmed)}), lambda w: w <> '')"
    out = {
        "ascii_digits": "SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS digits FROM orders",
        "norm": f"SELECT doc_id, md5({n}) AS norm_md5 FROM documents",
        "loose": f"SELECT doc_id, md5({_fold(f'regexp_replace({n}, {content})')}) AS loose_md5 FROM documents",
        "squash": f"SELECT doc_id, md5(replace({n}, ' ', '')) AS squash_md5 FROM documents",
        "script_of": "SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'kannada' WHEN 1 THEN 'devanagari' ELSE 'latin' END AS script FROM customer",
        "tokenize_offsets": f"""WITH c AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS li FROM documents),
            b AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY li ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM c),
            l AS (SELECT doc_id, li, base, regexp_extract_all(line, '{token}') AS m, regexp_split_to_array(line, '{token}') AS g FROM b),
            t AS (SELECT doc_id, li, base, i, length(m[i]) AS len, length(g[i]) AS gap FROM l, unnest(range(1, len(m) + 1)) AS u(i)),
            s AS (SELECT doc_id, len, base + sum(gap + len) OVER (PARTITION BY doc_id, li ORDER BY i) AS e FROM t)
            SELECT d.doc_id, CAST(count(len) AS BIGINT) AS n_tokens, CAST(coalesce(sum((e - len) * 31 + e), 0) AS BIGINT) AS offsets FROM documents d LEFT JOIN s USING (doc_id) GROUP BY d.doc_id""",
        "recall_tokens": f"SELECT doc_id, len(w) AS n, md5(array_to_string(w, ' ')) AS words_md5 FROM (SELECT doc_id, {lower_words} AS w FROM documents)",
        "content_count": r"SELECT doc_id, length(regexp_replace(text, '[^\pL\pM\pN]', '', 'g')) AS n FROM documents",
        "levenshtein_pairs": "SELECT a.n_nationkey, b.n_nationkey AS k2, levenshtein(a.n_name, b.n_name) AS distance FROM nation a JOIN nation b USING (n_regionkey)",
        "cer": f"SELECT p_partkey, round(CASE WHEN a = '' THEN CASE WHEN b = '' THEN 0.0 ELSE 1.0 END ELSE levenshtein(a, b) / length(a) END, 9) AS cer FROM (SELECT p_partkey, {_norm('p_name')} AS a, {_norm('p_type')} AS b FROM part)",
        "inr_format": "SELECT o_orderkey, CASE WHEN length(s) <= 3 THEN s ELSE reverse(rtrim(regexp_replace(reverse(left(s, length(s) - 3)), '(..)', '\\1,', 'g'), ',')) || ',' || right(s, 3) END AS inr FROM (SELECT o_orderkey, CAST(CAST(floor(o_totalprice * o_orderkey) AS BIGINT) AS VARCHAR) AS s FROM orders)",
        "ordinal": "SELECT p_partkey, p_partkey || CASE WHEN p_partkey % 100 BETWEEN 11 AND 13 THEN 'th' WHEN p_partkey % 10 = 1 THEN 'st' WHEN p_partkey % 10 = 2 THEN 'nd' WHEN p_partkey % 10 = 3 THEN 'rd' ELSE 'th' END AS ordinal FROM part",
        "masked_end": r"""SELECT c_custkey, CAST(CASE WHEN c_custkey % 2 = 0 THEN CASE WHEN regexp_matches(t, '([0-9][^0-9]*){4}$') THEN length(regexp_extract(t, '(?s)^(.*?)[^0-9]*((?:[0-9][^0-9]*){4})$', 1)) ELSE length(t) END
            ELSE CASE WHEN regexp_matches(t, '([0-9][^0-9]*){4}$') THEN length(regexp_extract(t, '(?s)^(.*?)[^0-9]*((?:[0-9][^0-9]*){4})$', 1)) ELSE length(t) END END AS BIGINT) AS masked_end FROM (SELECT c_custkey, c_custkey || ' / ' || c_custkey || CASE WHEN c_custkey % 2 = 0 THEN 'x' ELSE '' END AS t FROM customer)""",
        "safe_filename": "SELECT page_id, regexp_replace(url, '[^A-Za-z0-9._-]+', '_', 'g') AS name FROM pages",
        "find_rules": f'SELECT id, label, "start", "end", value FROM {_chosen(_ids)}',
        "rule_counts": f"SELECT label, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM {_chosen('documents', 'doc_id')} GROUP BY label",
        "verhoeff_valid": f"SELECT o_orderkey, {_verhoeff('d', 0)} = 0 AS valid FROM (SELECT o_orderkey, '2' || lpad(CAST(o_orderkey AS VARCHAR), 11, '0') AS d FROM orders)",
        "verhoeff_digit": f"SELECT o_orderkey, CAST(substr('{checksums._INVERSE}', {_verhoeff('d', 1)} + 1, 1) AS BIGINT) AS digit FROM (SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS d FROM orders)",
        "gstin_check": f"SELECT id, {_gstin('g')} AS check_char FROM (SELECT id, regexp_extract(text, 'GSTIN (.{{14}})', 1) AS g FROM {_ids})",
        "context_filter": rf"""SELECT id, label, "start", NOT (
              ("start" > 0 AND regexp_matches(substr(text, CAST(greatest("start" - 2, 0) + 1 AS INT), CAST("start" - greatest("start" - 2, 0) + 1 AS INT)), '[0-9][,.]?[0-9]$')) OR regexp_matches(substr(text, CAST("end" AS INT), 3), '^[0-9]([0-9]|[,.][0-9])')
              OR (label = 'AADHAAR' AND regexp_full_match(value, '[0-9]{{12}}') AND NOT regexp_matches(lower(right(regexp_extract(substr(text, 1, CAST("start" AS INT)), '[^\n]*$'), 60)), 'aadhaar|aadhar|adhaar|uid|आधार|ಆಧಾರ'))) AS keep
            FROM {_chosen(_ids)} JOIN {_ids} USING (id)""",
        "gender_spans": f"""SELECT id, "start", value FROM (
            SELECT id, strpos(text, 'Female') - 1 AS "start", 'Female' AS value FROM {_ids} WHERE id % 3 = 0
            UNION ALL SELECT id, strpos(text, 'Sex M / other') + 3, 'M' FROM {_ids} WHERE id % 3 = 1 UNION ALL SELECT id, strpos(text, 'Sex M / other') + 7, 'other' FROM {_ids} WHERE id % 3 = 1)""",
        "merge_spans": f'SELECT page, label, CAST("start" AS BIGINT) AS "start", CAST("end" AS BIGINT) AS "end", round(score, 6) AS score FROM {_merged(_spans)}',
        "span_agreement": f"""WITH a AS (SELECT DISTINCT page, label, "start", "end" FROM {_spans} WHERE source = 'a'), b AS (SELECT DISTINCT page, label, "start", "end" FROM {_spans} WHERE source = 'b'),
            x AS (SELECT DISTINCT label, "start", "end" FROM a), y AS (SELECT DISTINCT label, "start", "end" FROM b)
            SELECT n AS "both", na AS n_a, nb AS n_b, round(2.0 * n / (na + nb), 9) AS f1 FROM (SELECT (SELECT count(*) FROM x JOIN y USING (label, "start", "end")) AS n, (SELECT count(*) FROM x) AS na, (SELECT count(*) FROM y) AS nb)""",
        "token_windows": "SELECT doc_id, i * 150 AS \"start\", least(i * 150 + 200, n) AS \"end\" FROM (SELECT doc_id, length(text) AS n FROM documents), unnest(range(0, CASE WHEN n <= 200 THEN 1 ELSE 1 + CAST(ceil((n - 200) / 150) AS BIGINT) END)) AS t(i)",
        "chunk_examples": f"""WITH s AS (SELECT page, "start" AS f, "end" - 1 AS l, label, max("end") OVER (PARTITION BY page) AS n FROM {_spans}),
            w AS (SELECT DISTINCT page, i * 15 AS a, least(i * 15 + 20, n) AS b FROM s, unnest(range(0, CASE WHEN n <= 20 THEN 1 ELSE 1 + CAST(ceil((n - 20) / 15) AS BIGINT) END)) AS t(i))
            SELECT page, a AS at, f - a AS "first", l - a AS "last", label FROM w JOIN s USING (page) WHERE f >= a AND l < b""",
        "run_islands": f"""SELECT page, label, min(ord) AS "first", max(ord) AS "last" FROM (SELECT *, sum(c) OVER (PARTITION BY page ORDER BY ord) AS r FROM (SELECT *, CASE WHEN label = lag(label) OVER (PARTITION BY page ORDER BY ord) THEN 0 ELSE 1 END AS c FROM {_spans})) GROUP BY page, label, r""",
        "position_scores": f"""WITH p AS (SELECT DISTINCT page, source, unnest(range("start", "end")) AS i FROM {_spans}), a AS (SELECT page, i FROM p WHERE source = 'a'), b AS (SELECT page, i FROM p WHERE source = 'b')
            SELECT page, (SELECT count(*) FROM b WHERE b.page = d.page) AS gold_chars, (SELECT count(*) FROM b JOIN a USING (page, i) WHERE b.page = d.page) AS gold_cov, (SELECT count(*) FROM a WHERE a.page = d.page) AS pred_chars,
            (SELECT count(*) FROM a WHERE a.page = d.page AND NOT EXISTS (SELECT 1 FROM b WHERE b.page = a.page AND b.i = a.i)) AS pred_bad FROM (SELECT DISTINCT page FROM p) d""",
        "grid_overlap_join": f"SELECT a.page, a.ord AS l_ord, b.ord AS r_ord, round({_iou('a', 'b')}, 9) AS iou FROM {_boxes} a JOIN {_truths} b ON a.page = b.page AND {_inter('a', 'b')} > 0",
        "argmax_overlap": f"SELECT page, l_ord, r_ord, round(s, 9) AS share FROM (SELECT *, row_number() OVER (PARTITION BY page, l_ord ORDER BY s DESC, r_ord) AS r FROM (SELECT a.page, a.ord AS l_ord, b.ord AS r_ord, {_inter('a', 'b')} / greatest(1, (a.x1 - a.x0) * (a.y1 - a.y0)) AS s FROM {_boxes} a JOIN {_truths} b ON a.page = b.page) WHERE s >= 0.5) WHERE r = 1",
        "pix_box": f"""SELECT page, ord, px0, py0, greatest(least(CAST(ceil(x1 + 0.0005 - 0.001) AS BIGINT) + p, 320), px0) AS px1, greatest(least(CAST(ceil(y1 + 0.3 - 0.001) AS BIGINT) + p, 60), py0) AS py1 FROM (
            SELECT *, least(greatest(CAST(floor(x0 + 0.001) AS BIGINT) - p, 0), 320) AS px0, least(greatest(CAST(floor(y0 + 0.001) AS BIGINT) - p, 0), 60) AS py0 FROM (SELECT *, CASE WHEN kind = 'visual' THEN 6 ELSE 3 END AS p FROM {_boxes}))""",
        "union_area": f"SELECT * FROM {_area(_INT_BOXES, 'page')}",
        "coverage": f"""SELECT t.page, t.ord, round(CASE WHEN t.x1 <= t.x0 OR t.y1 <= t.y0 THEN 1.0 ELSE coalesce(a.area, 0) / ((t.x1 - t.x0) * (t.y1 - t.y0)) END, 9) AS coverage FROM {_INT_TRUTHS} t
            LEFT JOIN {_area(f'(SELECT t.page, t.ord, greatest(t.x0, b.x0) AS x0, greatest(t.y0, b.y0) AS y0, least(t.x1, b.x1) AS x1, least(t.y1, b.y1) AS y1 FROM {_INT_TRUTHS} t JOIN {_INT_BOXES} b USING (page))', 'page, ord')} a ON a.page = t.page AND a.ord = t.ord""",
        "span_boxes": f"""SELECT page, label, CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b, round(CASE WHEN w THEN x0 ELSE x0 + (x1 - x0) * lo / 7 END, 6) AS x0, y0, round(CASE WHEN w THEN x1 ELSE x0 + (x1 - x0) * hi / 7 END, 6) AS x1, y1 FROM (
            SELECT p.page, p.label, p."start" AS a, p."end" AS b, g.x0, g.y0, g.x1, g.y1, p."start" <= g.s AND p."end" >= g.e AS w, greatest(0, greatest(p."start", g.s) - g.s - 1) AS lo, least(7, least(p."end", g.e) - g.s + 1) AS hi
            FROM {_spans} p JOIN (SELECT *, (ord - 1) * 8 AS s, ord * 8 - 1 AS e FROM {_boxes}) g ON p.page = g.page AND greatest(p."start", g.s) < least(p."end", g.e))""",
        "reading_order_simple": f"""WITH RECURSIVE c AS MATERIALIZED (SELECT page, ord, (y0 + y1) / 2 AS yc, y1 - y0 AS h, row_number() OVER (PARTITION BY page ORDER BY (y0 + y1) / 2, x0, ord) AS rn FROM {_boxes}),
            w AS (SELECT page, ord, rn, yc AS f, CAST(0 AS BIGINT) AS line FROM c WHERE rn = 1 UNION ALL SELECT c.page, c.ord, c.rn, CASE WHEN abs(c.yc - w.f) > 0.6 * c.h THEN c.yc ELSE w.f END, CASE WHEN abs(c.yc - w.f) > 0.6 * c.h THEN w.line + 1 ELSE w.line END FROM w JOIN c ON c.page = w.page AND c.rn = w.rn + 1)
            SELECT page, line, ord FROM w""",
        "yolo_labels": f"""SELECT page, ord, format('{{:d}} {{:.6f}} {{:.6f}} {{:.6f}} {{:.6f}}', ord, (a + c) / 2 / 320.0, (b + d) / 2 / 64.0, (c - a) / 320.0, (d - b) / 64.0) AS line FROM (SELECT page, ord, greatest(x0, 0.0) AS a, greatest(y0, 0.0) AS b, least(x1, 320.0) AS c, least(y1, 64.0) AS d FROM {_boxes}) WHERE c - a >= 2 AND d - b >= 2""",
        "nms": _walk(f"SELECT *, row_number() OVER (PARTITION BY page ORDER BY -score, ord) AS rn FROM {_boxes}", "struct_pack(ord := ord, x0 := x0, y0 := y0, x1 := x1, y1 := y1)", f"{_iou('k', 'c.c')} > 0.2"),
        "ner_decode": _walk(f'SELECT *, row_number() OVER (PARTITION BY page ORDER BY -score, ord) AS rn FROM {_spans}', 'struct_pack(ord := ord, a := "start", b := "end")', "k.a < c.c.b AND c.c.a < k.b"),
        "box_rotation": _ROTATED,
        "ctc_decode": f"""SELECT page, coalesce(string_agg(CAST(i AS VARCHAR), '' ORDER BY ord) FILTER (k), '') AS ids, round(CASE WHEN count(*) FILTER (k) = 0 THEN 0 ELSE pow(product(p) FILTER (k), 2 / sqrt(count(*) FILTER (k))) END, 6) AS confidence
            FROM (SELECT *, i <> 0 AND i IS DISTINCT FROM lag(i) OVER (PARTITION BY page ORDER BY ord) AS k FROM (SELECT page, ord, "start" % 3 AS i, 1 - score / 2 AS p FROM {_spans})) GROUP BY page""",
        "redact_text": f"""SELECT doc_id, md5(coalesce(array_to_string(list_transform(g, lambda x, i: x || coalesce(repeat('█', CAST(length(m[i]) AS BIGINT)), '')), ''), '')) AS redacted_md5, len(m) AS n_spans
            FROM (SELECT doc_id, regexp_split_to_array(text, '{_PATTERNS["EMAIL"]}') AS g, regexp_extract_all(text, '{_PATTERNS["EMAIL"]}') AS m FROM documents)""",
        "char_to_token_ner": f"""WITH l AS (SELECT id, regexp_extract_all(text, '{token}') AS m, regexp_split_to_array(text, '{token}') AS g FROM {_ids}),
            t AS (SELECT id, i, len, sum(gap + len) OVER (PARTITION BY id ORDER BY i) AS e FROM (SELECT id, i, length(m[i]) AS len, length(g[i]) AS gap FROM l, unnest(range(1, len(m) + 1)) AS u(i)))
            SELECT f.id, f."start", min(t.i) - 1 AS "first", max(t.i) - 1 AS "last" FROM {_chosen(_ids)} f LEFT JOIN t ON t.id = f.id AND t.e - t.len >= f."start" AND t.e <= f."end" GROUP BY f.id, f."start" """,
        "fill_gaps": f"""WITH RECURSIVE b AS MATERIALIZED (SELECT page, kind, label, row_number() OVER (PARTITION BY page, kind, label ORDER BY y0, x0, ord) AS rn, struct_pack(x0 := x0, y0 := y0, x1 := x1, y1 := y1, score := score) AS r FROM {_boxes} WHERE kind = 'text'),
            w AS (SELECT page, kind, label, rn, [r] AS kept FROM b WHERE rn = 1
                UNION ALL SELECT page, kind, label, rn, CASE WHEN spot > 0 THEN list_transform(kept, lambda m, i: CASE WHEN i = spot THEN struct_pack(x0 := least(m.x0, r.x0), y0 := least(m.y0, r.y0), x1 := greatest(m.x1, r.x1), y1 := greatest(m.y1, r.y1), score := greatest(m.score, r.score)) ELSE m END) ELSE list_append(kept, r) END
                FROM (SELECT b.page, b.kind, b.label, b.rn, w.kept, b.r, coalesce(list_position(list_transform(w.kept, lambda m: least(m.y1, b.r.y1) - greatest(m.y0, b.r.y0) >= 0.5 * least(m.y1 - m.y0, b.r.y1 - b.r.y0) AND greatest(m.x0, b.r.x0) - least(m.x1, b.r.x1) <= 2.5 * greatest(m.y1 - m.y0, b.r.y1 - b.r.y0)), true), 0) AS spot
                    FROM w JOIN b ON b.page = w.page AND b.kind = w.kind AND b.label = w.label AND b.rn = w.rn + 1))
            SELECT page, kind, label, k.x0 AS x0, k.y0 AS y0, k.x1 AS x1, k.y1 AS y1, round(k.score, 6) AS score FROM (SELECT page, kind, label, unnest(arg_max(kept, rn)) AS k FROM w GROUP BY page, kind, label)
            UNION ALL SELECT page, kind, label, x0, y0, x1, y1, round(score, 6) FROM {_boxes} WHERE kind <> 'text'""",
        "edit_replay": f"""WITH RECURSIVE e AS MATERIALIZED (SELECT page, row_number() OVER (PARTITION BY page ORDER BY ord) AS rn, struct_pack(seq := ord, item := CASE WHEN "start" % 4 <> 0 THEN CAST("start" % 3 AS BIGINT) END, on_ := "end" % 2 = 0) AS r FROM {_spans}),
            w AS (SELECT page, CAST(0 AS BIGINT) AS rn, [r][1:0] AS kept FROM e WHERE rn = 1 UNION ALL SELECT e.page, e.rn, CASE WHEN e.r.item IS NOT NULL THEN list_append(w.kept, e.r) WHEN len(w.kept) <= 1 THEN w.kept[1:0] ELSE w.kept[1:len(w.kept) - 1] END FROM w JOIN e ON e.page = w.page AND e.rn = w.rn + 1)
            SELECT page, s.item AS item, arg_max(s.on_, s.seq) AS "on", count(*) AS n_edits FROM (SELECT page, unnest(arg_max(kept, rn)) AS s FROM w GROUP BY page) GROUP BY page, s.item""",
        "near_duplicate_spans": f"""WITH RECURSIVE s AS MATERIALIZED (SELECT * FROM {_spans}),
            e AS (SELECT a.page, a.source, a.ord AS a, b.ord AS b FROM s a JOIN s b ON a.page = b.page AND a.source = b.source AND least(a."end", b."end") - greatest(a."start", b."start") > 0 AND least(a."end", b."end") - greatest(a."start", b."start") >= 0.8 * least(a."end" - a."start", b."end" - b."start")),
            r AS (SELECT page, source, ord AS a, ord AS b FROM s UNION SELECT r.page, r.source, r.a, e.b FROM r JOIN e ON e.page = r.page AND e.source = r.source AND e.a = r.b)
            SELECT page, source, a AS ord, min(b) AS item FROM r GROUP BY page, source, a""",
        "ap50": f"""WITH p AS (SELECT b.page, b.label, b.ord AS pred, b.score, t.ord AS gt, CASE WHEN t.ord IS NOT NULL THEN {_iou('b', 't')} END AS iou FROM {_boxes} b LEFT JOIN {_truths} t ON b.page = t.page AND b.label = t.label),
            top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY page, label, pred ORDER BY iou DESC NULLS LAST, gt NULLS LAST) AS r FROM p) WHERE r = 1),
            rk AS (SELECT *, coalesce(iou >= 0.5, false) AS ok, row_number() OVER (PARTITION BY label ORDER BY score DESC, page, pred) AS rk FROM top),
            tp AS (SELECT *, CASE WHEN ok AND row_number() OVER (PARTITION BY label, page, gt, ok ORDER BY rk) = 1 THEN 1 ELSE 0 END AS tp FROM rk),
            n AS (SELECT label, count(*) AS n_gt FROM {_truths} GROUP BY label),
            c AS (SELECT label, rk, hits / n_gt AS rec, hits / rk AS pre FROM (SELECT *, sum(tp) OVER (PARTITION BY label ORDER BY rk) AS hits FROM tp) JOIN n USING (label)),
            e AS (SELECT label, (rec - lag(rec, 1, 0.0) OVER (PARTITION BY label ORDER BY rk)) * max(pre) OVER (PARTITION BY label ORDER BY rk DESC ROWS UNBOUNDED PRECEDING) AS a FROM c)
            SELECT label, n_gt, round(coalesce((SELECT sum(a) FROM e WHERE e.label = n.label), 0), 6) AS ap FROM n""",
        "detected": f"SELECT * FROM {_DETECTED}",
        "pii_report": f"SELECT label, part, count(*) AS items, count(*) FILTER (detected) AS found, round(count(*) FILTER (detected) / count(*), 9) AS rate FROM (SELECT *, page % 4 AS part FROM {_DETECTED}) GROUP BY GROUPING SETS ((), (label), (part))",
        "bag_recall": """WITH w AS (SELECT p_partkey, string_split(lower(concat_ws(' ', p_type, p_name)), ' ') AS t, string_split(lower(concat_ws(' ', p_name, p_brand)), ' ') AS s FROM part)
            SELECT p_partkey, round(list_sum(list_transform(list_distinct(t), lambda x: least(len(list_filter(t, lambda y: y = x)), len(list_filter(s, lambda y: y = x))))) / greatest(len(t), 1), 9) AS recall FROM w""",
        "best_of_engines": f"SELECT page, label, bool_or(ok) AS any_ok, count(*) FILTER (ok) AS n_ok FROM (SELECT page, label, source, bool_or(score >= 0.5) AS ok FROM {_spans} GROUP BY ALL) GROUP BY page, label HAVING count(DISTINCT source) = 2",
        "choose_variant": "SELECT coalesce(arg_min(variant, mb) FILTER (agreement >= 0.9), arg_max(variant, agreement)) AS variant, bool_or(agreement >= 0.9) AS passed FROM (SELECT s_suppkey AS variant, abs(s_acctbal) AS mb, s_suppkey % 97 / 97.0 AS agreement FROM supplier)",
        "stratified_round_robin": f"SELECT * FROM {_ROBIN.format('doc_id * 7919 % 1000')} WHERE place <= 37",
        "train_split": "SELECT doc_id, lang FROM documents ORDER BY lang <> 'es', doc_id * 31 % 977, doc_id LIMIT 300",
        "benchmark_anti_join": f"SELECT lang, count(*) AS n FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM {_ROBIN.format('doc_id')} WHERE place <= 20) GROUP BY lang",
        "generation_stats": "SELECT lang, source, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars, median(n_chars) AS median_chars FROM documents GROUP BY lang, source",
        "label_resolve": f"SELECT page, label, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY CASE WHEN score >= 0.6 AND score < 1 THEN 1 ELSE 0 END DESC, score DESC, label) AS r FROM (SELECT page, label, max(score) AS score FROM {_spans} GROUP BY ALL)) WHERE r = 1",
        "occurrence_join": f"""WITH o AS (SELECT *, row_number() OVER (PARTITION BY page, source, label, value ORDER BY "start", "end") AS k FROM (SELECT *, 'v' || ("start" % 5) AS value FROM {_spans}))
            SELECT coalesce(a.page, b.page) AS page, coalesce(a.label, b.label) AS label, coalesce(a.value, b.value) AS value, coalesce(a.k, b.k) AS k, CAST(a."start" AS BIGINT) AS start_a, CAST(b."start" AS BIGINT) AS start_b
            FROM (SELECT * FROM o WHERE source = 'a') a FULL JOIN (SELECT * FROM o WHERE source = 'b') b ON a.page = b.page AND a.label = b.label AND a.value = b.value AND a.k = b.k""",
        "contain_join": f"""SELECT a.page, a.ord AS wi, max(b.ord) AS ei FROM {_spans} a JOIN {_spans} b ON a.page = b.page AND a.source = 'a' AND b.source = 'b' AND a."start" >= b."start" AND a."end" <= b."end" GROUP BY ALL""",
    }
    both = f"(SELECT page, x0, y0, x1, y1 FROM {_INT_BOXES} UNION ALL SELECT page, x0, y0, x1, y1 FROM {_INT_TRUTHS})"
    out |= {
        "e2e_report": f"SELECT label, part, count(*) AS items, count(*) FILTER (coverage >= 0.9) AS hidden, count(DISTINCT page) FILTER (coverage < 0.9) AS leaky_pages FROM (SELECT c.page, c.coverage, t.label, c.page % 4 AS part FROM ({out['coverage']}) c JOIN {_truths} t ON c.page = t.page AND c.ord = t.ord) GROUP BY GROUPING SETS ((), (label), (part))",
        "ablation_grid": f"SELECT threshold, count(*) FILTER (coverage >= threshold) AS hidden, count(*) AS items FROM ({out['coverage']}), (SELECT i * 0.25::DOUBLE + 0.45::DOUBLE AS threshold FROM range(3) AS r(i)) GROUP BY threshold",
        "over_redaction": f"SELECT page, a.area - coalesce(b.area, 0) AS off, round(coalesce((a.area - coalesce(b.area, 0)) / nullif(d.area, 0), 0), 9) AS share FROM {_area(both, 'page')} a LEFT JOIN {_area(_INT_TRUTHS, 'page')} b USING (page) LEFT JOIN {_area(_INT_BOXES, 'page')} d USING (page)",
        "span_index": f"""WITH d AS (SELECT doc_id, len(regexp_extract_all(text, '{token}')) AS n FROM documents),
            w AS (SELECT doc_id, i * 150 AS "start", least(200, n - i * 150) AS w FROM d, unnest(range(0, CASE WHEN n <= 200 THEN 1 ELSE 1 + CAST(ceil((n - 200) / 150) AS BIGINT) END)) AS t(i))
            SELECT doc_id, "start", w * 12 AS n, coalesce(list_sum(list_transform(range(0, w), lambda i: least(12, w - i))), 0)::BIGINT AS inside FROM w""",
        "verdict": f"SELECT bool_and((rate - CASE WHEN part = 2 THEN 0.001 ELSE 0 END) - rate >= -0.002) AS keep, count(*) AS parts FROM ({out['pii_report']}) WHERE part IS NOT NULL",
        "greedy_match": f"""WITH RECURSIVE c AS MATERIALIZED (SELECT b.page, b.label, b.ord AS pred, t.ord AS gt, {_iou('b', 't')} AS iou, row_number() OVER (PARTITION BY b.page, b.label ORDER BY -b.score, b.ord, -({_iou('b', 't')}), t.ord) AS rn FROM {_boxes} b JOIN {_truths} t ON b.page = t.page AND b.label = t.label AND {_iou('b', 't')} >= 0.3),
            w AS (SELECT page, label, rn, [struct_pack(pred := pred, gt := gt, iou := iou)] AS kept FROM c WHERE rn = 1
                UNION ALL SELECT c.page, c.label, c.rn, CASE WHEN len(list_filter(w.kept, lambda k: k.pred = c.pred OR k.gt = c.gt)) > 0 THEN w.kept ELSE list_append(w.kept, struct_pack(pred := c.pred, gt := c.gt, iou := c.iou)) END FROM w JOIN c ON c.page = w.page AND c.label = w.label AND c.rn = w.rn + 1)
            SELECT page, label, m.pred AS pred, m.gt AS gt, round(m.iou, 9) AS iou FROM (SELECT page, label, unnest(arg_max(kept, rn)) AS m FROM w GROUP BY page, label)""",
    }
    inter = "greatest(0.0, least(s.x1, t.x1) - greatest(s.x0, t.x0)) * greatest(0.0, least(s.y1, t.y1) - greatest(s.y0, t.y0))"
    out["transfer_words"] = f"""WITH p AS (SELECT s.page, s.ord AS si, t.ord AS wi, ({inter}) / greatest(1.0, (s.x1 - s.x0) * (s.y1 - s.y0)) AS share FROM {_boxes} s JOIN {_truths} t ON s.page = t.page AND {inter} > 0),
        b AS (SELECT page, si, wi FROM (SELECT *, row_number() OVER (PARTITION BY page, si ORDER BY share DESC, wi) AS r FROM p WHERE share >= 0.5) WHERE r = 1),
        g AS (SELECT s.page, s.ord AS si, max(e.ord) AS ei FROM {_boxes} s LEFT JOIN b ON b.page = s.page AND b.si = s.ord LEFT JOIN {_truths} e ON e.page = s.page AND e.ord % 4 = 1 AND b.wi BETWEEN e.ord AND e.ord + 2 GROUP BY ALL),
        r AS (SELECT *, sum(c) OVER (PARTITION BY page ORDER BY si) AS run FROM (SELECT *, CASE WHEN ei IS DISTINCT FROM lag(ei) OVER (PARTITION BY page ORDER BY si) THEN 1 ELSE 0 END AS c FROM g)),
        o AS (SELECT page, run, ei, min(si) * 9 AS a, max(si) * 9 + 8 AS z, string_agg('seg' || si, ' ' ORDER BY si) AS ocr FROM r WHERE ei IS NOT NULL GROUP BY page, run, ei)
        SELECT page, ei, a AS "start", z AS "end", ocr, round(least(1.0, levenshtein('seg' || ei, replace(ocr, ' ', '')) / length('seg' || ei)), 9) AS cer FROM o"""
    out["python_round"] = "SELECT p_partkey, CAST(format('{:.1f}', p_retailprice) AS DOUBLE) AS rounded FROM part"
    out["substring_distance"] = """SELECT p_partkey, CAST(min(levenshtein(p_brand, substr(p_type, a, n))) AS INT) AS distance FROM part, unnest(range(1, length(p_type) + 1)) AS u(a), unnest(range(0, length(p_type) + 1)) AS v(n) WHERE a + n <= length(p_type) + 1 GROUP BY p_partkey"""
    out["hash_split"] = f"SELECT doc_id, {crc32_sql('CAST(doc_id AS VARCHAR)')} % 1000 < 30 AS val FROM documents"
    for label in _PATTERNS:
        out["rx_" + label.lower()] = f'SELECT id, "start", "end", value FROM ({_matches(_ids, label)})'
    out["reading_order_tilt"] = _tilted()
    own = f"(SELECT *, CASE WHEN ord % 2 = 0 THEN 'a' ELSE 'b' END AS engine FROM {_boxes})"
    out["filled_union"] = out["fill_gaps"].replace(_boxes, own).replace("page, kind, label", "page, engine, kind, label").replace("b.page, b.kind", "b.page, b.engine, b.kind").replace("b.kind = w.kind", "b.engine = w.engine AND b.kind = w.kind")
    merged = " UNION ALL ".join(f"SELECT page, label, \"start\", \"end\", score FROM {_merged(f'(SELECT * FROM {_spans} WHERE source = ' + chr(39) + v + chr(39) + ')')}" for v in "ab")
    out["union_spans"] = f'SELECT page, label, CAST("start" AS BIGINT) AS "start", CAST("end" AS BIGINT) AS "end", round(score, 6) AS score FROM {_merged("(" + merged + ")")}'
    return out
