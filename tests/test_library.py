"""Operators against hand values and independent models."""

import json
import random
import re
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkveil.functions import checksums, labels, registry, synth
from inkveil.functions import geometry as G
from inkveil.functions import text as T
from inkveil.operators import decode, flows, imaging, layout, matching, models, review, rules, sampling, scoring, spans, transfer
from inkveil.plans import catalog
from inkveil.sources import records
from inkveil.streaming import incremental

random.seed(11)
CHARS = list("ab Z-_.,@19é२೩²①ि\u00a0\n\tß😀ಕ&'")
RANDOM = ["".join(random.choice(CHARS) for _ in range(random.randrange(30))) for _ in range(400)]


def column(spark, values, f, kind="string"):
    return [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}").orderBy("i").select(f(F.col("v"))).collect()]


def test_text_values(spark):
    assert column(spark, ["#173, 1st Main Rd,", "Rekha31@Yahoo.co.in", "Straße"], T.loose) == ["1731stmainrd", "rekha31yahoocoin", "strasse"]
    assert column(spark, [" 8757 6329\n9050 "], T.squash) == ["875763299050"]
    assert column(spark, ["६३२२ ३७३० ८७६४", "೧೨೩", "e\u0301 \u200bx"], T.norm) == ["6322 3730 8764", "123", "é x"]
    assert column(spark, ["२९ ೩೪ 56", "²①"], T.ascii_digits) == ["29 34 56", "21"]
    assert column(spark, ["Aadhaar 6197 5241 0246", "६१९७ ५२४१ ०२४६", "123"], T.masked_end) == [17, 9, 3]
    assert column(spark, [1, 2, 3, 11, 112, 21], T.ordinal, "int") == ["1st", "2nd", "3rd", "11th", "112th", "21st"]
    assert column(spark, [1234567, 100, 1000], T.indian_grouping, "int") == ["12,34,567", "100", "1,000"]
    assert column(spark, ["Aadhaar Number ", "x y"], labels.to_code) == ["AADHAAR", "X Y"]
    pairs = [("9050", "aadhaar 8757 6329 9050 xyz", 0), ("9O50", "8757 6329 9050", 1), ("abc", "", 3)]
    assert [r[0] for r in spark.createDataFrame(pairs, "a string, b string, n int").select(T.substring_distance("a", "b")).collect()] == [0, 1, 3]
    assert [r[0] for r in spark.createDataFrame([("abcd", "abxd"), ("", "a")], "a string, b string").select(T.cer(F.col("a"), F.col("b"))).collect()] == [0.25, 1.0]
    assert column(spark, [2.675, 1003.45, 0.125], lambda c: T.python_round(c, F.lit(2)), "double") == [round(x, 2) for x in (2.675, 1003.45, 0.125)]
    assert set(registry.register(spark)) and spark.sql("SELECT python_round(2.5D, 0)").first()[0] == 2.0


def test_text_against_python(spark):
    token = re.compile(r"\w+(?:[-_]\w+)*|\S")
    got = column(spark, RANDOM, T.tokens)
    assert [[(t.start, t.end, t.text) for t in g] for g in got] == [[(m.start(), m.end(), m[0]) for m in token.finditer(v)] for v in RANDOM]
    digit = lambda v: "".join(str(unicodedata.digit(c)) if c.isdigit() else c for c in v)
    assert column(spark, RANDOM, T.ascii_digits) == [digit(v) for v in RANDOM]
    content = lambda v: sum(unicodedata.category(c)[0] in "LMN" for c in v)
    assert column(spark, RANDOM, T.content_count) == [content(v) for v in RANDOM]


def test_identifiers(spark):
    d = spark.range(300)
    made = d.select("id", *(F.expr("null").alias("x") if f is None else f(F.col("id")).alias(k) for k, f in synth.MAKERS.items())).collect()
    for label in synth.MAKERS:
        texts = [(r.id, f"x {r[label]} y") for r in made]
        found = spark.createDataFrame(texts, "id long, text string").select("text", rules.matches(F.col("text"), label).alias("m")).collect()
        assert all([m.text for m in r.m] == [r.text[2:-2]] for r in found), label
    wrong = [(r.id, "x " + re.sub(r"\d$", lambda m: str((int(m[0]) + 1) % 10), r["AADHAAR"])) for r in made]
    assert not spark.createDataFrame(wrong, "id long, text string").where(F.size(rules.matches(F.col("text"), "AADHAAR")) > 0).count()
    assert column(spark, ["27AAPFU0939F1Z"], checksums.gstin_check) == ["V"]
    assert column(spark, ["Loan Amount: Rs. 2,00,000 Tenure 24 months", "+919845012345", ""], lambda c: F.size(rules.greedy(rules.candidates(c)))) == [0, 0, 0]
    text = "write to nobody@example.com, pay nobody@okbank, or ring +91 70000 00001"
    row = rules.redact(spark.createDataFrame([(1, text)], "id int, text string"), "id").first()
    assert row.n_spans == 3 and len(row.redacted) == len(text) and "nobody" not in row.redacted
    greedy = [tuple(random.choice([(s, s + n, o) for s in range(12) for n in (1, 3, 5) for o in (0, 1)]) for _ in range(random.randrange(8))) for _ in range(60)]
    kind = f"array<{rules.SPAN}>"
    got = column(spark, [[(s, e, o, "L", "") for s, e, o in g] for g in greedy], rules.greedy, kind)
    for g, kept in zip(greedy, got, strict=True):
        want, last = [], 0
        for s, e, o in sorted(g, key=lambda x: (x[0], x[0] - x[1], x[2])):
            if s >= last:
                want.append((s, e, o))
                last = e
        assert [(k.start, k.end, k.ord) for k in kept] == want


def test_context_and_gender(spark):
    rows = [("Date of Birth 01/02/1990", "DOB", 14, 24, True), ("Date 01/02/1990", "DOB", 5, 15, False), ("ref 123456789012", "AADHAAR", 4, 16, False), ("UID 123456789012", "AADHAAR", 4, 16, True), ("uid\n1234 5678 9012", "AADHAAR", 4, 18, True), ("13,274 x", "PAN", 3, 6, False), ("a 274 x", "PAN", 2, 5, True), ("12.5", "PAN", 0, 2, False)]
    df = spark.createDataFrame([(*r, r[0][r[2] : r[3]]) for r in rows], "t string, label string, s int, e int, want boolean, v string")
    assert all(r[0] == r[1] for r in df.select(rules.context_keep(F.col("t"), F.col("label"), F.col("s"), F.col("e"), F.col("v")), "want").collect())
    text = "Gender: Female\nलिंग / Sex : महिला\nsex of x\nಲಿಂಗ: ಮಹಿಳೆ"
    assert [s.text for s in column(spark, [text], rules.gender_spans)[0]] == ["Female", "महिला", "ಮಹಿಳೆ"]


def test_spans(spark):
    s = spark.createDataFrame([(1, "A", 0, 5, 0.5), (1, "A", 3, 9, 0.9), (1, "B", 2, 4, 0.1), (1, "A", 9, 10, 0.2), (1, "A", 12, 13, 0.2)], "page int, label string, start int, end int, score double")
    assert sorted((r.label, r.start, r.end, r.score) for r in spans.merge(s, "page").collect()) == [("A", 0, 10, 0.9), ("A", 12, 13, 0.2), ("B", 2, 4, 0.1)]
    assert [[tuple(w) for w in g] for g in column(spark, [0, 10, 200, 201, 500], spans.windows, "int")] == [[(0, 0)], [(0, 10)], [(0, 200)], [(0, 200), (150, 201)], [(0, 200), (150, 350), (300, 500)]]
    text = "Name: Ramesh Kumar, PAN: ABCPK1234F."
    assert [tuple(column(spark, [text], lambda c, a=a, b=b: spans.token_span(T.tokens(c), F.lit(a), F.lit(b)))[0]) for a, b in ((6, 18), (25, 35))] == [(2, 3), (7, 7)]
    a = s.where("label = 'A'")
    assert spans.agreement(a, a, "page").first().f1 == 1.0 and spans.agreement(a.where("1=0"), a.where("1=0"), "page").first().f1 == 1.0
    ex = spark.createDataFrame([(["a"], [(0, 0, "x")]), ([], []), ([" "], []), (["a"], [(0, 1, "x")]), (["a"], [(0, 0, "?")])], "tokens array<string>, ner array<struct<first:int,last:int,label:string>>")
    assert spans.clean(ex, F.array(F.lit("x"))).count() == 1
    fake = lambda c: F.transform(T.find_all(c, "[A-Z]{5}"), lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.lit("X").alias("label"), F.lit(0.9).alias("score")))
    long = " ".join(["w"] * 190 + ["ABCDE"] + ["w"] * 300)
    found = models.windowed(fake)(spark.createDataFrame([(1, long)], "id int, text string"), "id", "text").collect()
    assert [(r.start, r.end) for r in found] == [(380, 385)]


def boxes(spark, rows):
    return spark.createDataFrame(rows, "page int, ord long, kind string, label string, x0 double, y0 double, x1 double, y1 double, score double")


def test_layout(spark):
    rows = [(1, 0, "text", "A", 0.0, 0.0, 20.0, 10.0, 0.5), (1, 1, "text", "A", 45.0, 0.0, 60.0, 10.0, 0.9), (1, 2, "text", "A", 85.01, 0.0, 90.0, 10.0, 0.1), (1, 3, "text", "B", 21.0, 0.0, 30.0, 10.0, 0.1), (1, 4, "visual", "A", 0.0, 0.0, 5.0, 5.0, 0.1), (1, 5, "text", "A", 0.0, 30.0, 9.0, 40.0, 0.1)]
    got = sorted((r.kind, r.label, r.x0, r.y0, r.x1, r.y1) for r in layout.fill_gaps(boxes(spark, rows), "page").collect())
    assert got == [("text", "A", 0, 0, 60, 10), ("text", "A", 0, 30, 9, 40), ("text", "A", 85.01, 0, 90, 10), ("text", "B", 21, 0, 30, 10), ("visual", "A", 0, 0, 5, 5)]
    rng = random.Random(3)
    many = [(p, i, *sorted(rng.sample(range(30), 2)), *sorted(rng.sample(range(30), 2))) for p in range(25) for i in range(6)]
    df = spark.createDataFrame([(p, i, a, c, b, d) for p, i, a, b, c, d in many], "page int, ord int, x0 int, y0 int, x1 int, y1 int")
    area = {r.page: r.area for r in layout.union_area(df, "page").collect()}
    for p in range(25):
        assert area[p] == len({(x, y) for q, _, a, b, c, d in many if q == p for x in range(a, b) for y in range(c, d)})
    px = spark.createDataFrame([(99.9999, 10.0001, 200.0, 20.5)], "x0 double, y0 double, x1 double, y1 double").select(*G.pixels(G.Box.of(), 0, F.lit(827), F.lit(1169))).first()
    assert tuple(px) == (100, 10, 200, 21)
    lines = [(1, k, "text", "A", 30.0 * c, 20.0 * r + 6.0 * c, 30.0 * c + 25, 20.0 * r + 6.0 * c + 10, 1.0) for k, (r, c) in enumerate((r, c) for r in range(3) for c in range(6))]
    got = {r.ord: (r.line, r.pos) for r in layout.tilted_order(boxes(spark, lines), "page").collect()}
    assert got == {k: divmod(k, 6) for k in range(18)}
    assert [r.line for r in layout.reading_lines(boxes(spark, [r for r in lines if r[1] % 6 == 0]), "page").orderBy("ord").collect()] == [0, 1, 2]


def test_scores(spark):
    t = spark.createDataFrame([(1, "A", 0, 0.0, 0.0, 10.0, 10.0)], "page int, label string, gt int, x0 double, y0 double, x1 double, y1 double")

    def ap(preds):
        p = spark.createDataFrame([(1, "A", i, s, iou, 0 if iou is not None else None) for i, (s, iou) in enumerate(preds)], "page int, label string, pred int, score double, iou double, gt int")
        return round(scoring.average_precision(p, t, "page", "label", "pred", "score", "gt").first().ap, 6)

    assert (ap([(0.9, 1.0)]), ap([(0.9, 0.1), (0.8, 0.9)]), ap([(0.9, 0.9), (0.8, 0.9)])) == (1.0, 0.5, 1.0)
    b = spark.createDataFrame([(["a", "a", "b"], ["a", "b", "b"])], "t array<string>, s array<string>")
    assert b.select(scoring.bag_recall(F.col("t"), F.col("s"))).first()[0] == pytest.approx(2 / 3)
    v = spark.createDataFrame([("s", 300.0, 0.95), ("m", 550.0, 0.995), ("l", 850.0, 1.0)], "variant string, mb double, agreement double")
    assert [tuple(scoring.choose_variant(v, x).first()) for x in (0.99, 0.999, 1.1)] == [("m", True), ("l", True), ("l", False)]
    kind = "struct<neg:double,ord:bigint,cls:string,x0:double,y0:double,x1:double,y1:double>"
    boxes_ = [(-0.9, 0, "a", 0.0, 0.0, 10.0, 10.0), (-0.8, 1, "a", 2.0, 0.0, 12.0, 10.0), (-0.7, 2, "a", 5.0, 0.0, 10.0, 10.0), (-0.6, 3, "b", 0.0, 0.0, 10.0, 10.0)]
    assert [k.ord for k in column(spark, [boxes_], lambda c: decode.nms(c, kind), f"array<{kind}>")[0]] == [0, 2, 3]
    c = spark.createDataFrame([([0, 1, 1, 0, 1, 2], [0.9, 0.5, 0.9, 1.0, 0.5, 1.0])], "i array<int>, p array<double>").select(decode.ctc(F.col("i"), F.col("p")).alias("c")).first().c
    assert c.ids == [1, 1, 2] and c.confidence == pytest.approx(0.25 ** (2 / 3**0.5))


def test_average_precision_is_the_area_under_the_envelope(spark):
    rng = random.Random(5)
    scores = [None, float("nan"), float("inf"), float("-inf"), -3.5, 0.0, 0.25, 0.5, 0.5000001, 0.75, 1.0, 1e300]
    preds = [(p, c, i, rng.choice(scores) if rng.random() < 0.5 else rng.random()) for p in range(12) for c in "AB" for i in range(9)]
    pairs = [(p, c, i, s, g, rng.random()) for p, c, i, s in preds for g in rng.sample(range(6), 2)] + [(99, "A", 0, 0.6, None, None)]
    truths = [(p, c, g) for p in range(12) for c in "AB" for g in range(6)] + [(0, "C", 0)]
    want = {"C": (1, 0.0)}
    for c in "AB":
        best = {}
        for p, _, i, s, g, iou in (x for x in pairs if x[1] == c):
            key = (-1 if iou is None else iou, -(g or 0))
            if (p, i) not in best or key > best[p, i][0]:
                best[p, i] = (key, s, g, iou is not None and iou >= 0.5)
        place = lambda s: (1, 0) if s is None else (0, float("-inf")) if s != s else (0, -s)
        order = sorted(best, key=lambda k: (*place(best[k][1]), best[k][1] == best[k][1], *k))
        used, hits, curve = set(), 0, []
        for n, k in enumerate(order, 1):
            _, _, g, ok = best[k]
            if ok and (k[0], g) not in used:
                used.add((k[0], g))
                hits += 1
                curve.append((n, hits / n))
        want[c] = (72, sum(max(p for m, p in curve if m >= n) for n, _ in curve) / 72)
    p = spark.createDataFrame(pairs, "page int, label string, pred int, score double, gt int, iou double").repartition(5)
    t = spark.createDataFrame(truths, "page int, label string, gt int")
    got = {r.label: (r.n_gt, r.ap) for r in scoring.average_precision(p, t, "page", "label", "pred", "score", "gt").collect()}
    assert got == {c: (n, pytest.approx(a)) for c, (n, a) in want.items()} and 0.1 < want["A"][1] < 0.9


def test_samples_and_review(spark):
    meta = spark.createDataFrame([(i, "en", f"t{i % 3}") for i in range(20)] + [(50, "fr", "t0")], "id int, lang string, kind string")
    got = sampling.round_robin(meta, "lang", "kind", "id", 7, F.xxhash64("id")).groupBy("lang", "kind").count().collect()
    assert sorted((r.lang, r.kind, r["count"]) for r in got) == [("en", "t0", 3), ("en", "t1", 2), ("en", "t2", 2), ("fr", "t0", 1)]
    l = spark.createDataFrame([(1, "AADHAAR", 1.0), (1, "BANK", 0.995), (2, "AADHAAR", 1.0), (2, "UAN", 0.48)], "item int, label string, score double")  # noqa: E741
    assert {r.item: r.label for r in review.resolve_label(l, "item").collect()} == {1: "BANK", 2: "AADHAAR"}
    e = spark.createDataFrame([(1, 1, 7, True), (1, 2, 7, False), (1, 3, None, None), (1, 4, 8, True)], "page int, seq int, item int, on boolean")
    assert sorted((r.item, r.on) for r in review.replay(e, "page").collect()) == [(7, True), (8, True)]


def test_sources(spark, tmp_path):
    page = {"id": 1, "image": "a.png", "width": 10, "height": 10, "doc_type": "d", "lang": "en", "aug": [], "text": "x", "words": [], "entities": [], "visuals": []}
    (tmp_path / "a.jsonl").write_text(json.dumps(page) + "\n{broken\n")
    assert [r.id for r in records.pages(spark, str(tmp_path / "a.jsonl"), ["id", "lang"]).where("id is not null").collect()] == [1]
    seg = [{"text": "a", "bbox": [0, 0, 1, 1], "score": 0.5}, {"text": "  ", "bbox": [0, 0, 1, 1], "score": 0.5}]
    (tmp_path / "o.jsonl").write_text("\n".join(json.dumps(x) for x in ({"id": 1, "segments": [], "sec": 1.0}, {"id": 1, "segments": seg, "sec": 2.0}, {"id": 2, "segments": seg, "seconds": 3.0, "error": "bad"})))
    got = records.segments(spark, str(tmp_path / "o.jsonl"))
    assert sorted((r.id, r.seconds, len(r.segments)) for r in got.collect()) == [(1, 2.0, 2), (2, 3.0, 0)]
    assert [(r.id, r.text) for r in records.explode_segments(got).collect()] == [(1, "a")]
    (tmp_path / "l.txt").write_text("1 0.5 0.5 0.2 0.4\nbad line\n")
    r = records.yolo_labels(spark, str(tmp_path / "l.txt"), 100, 50).first()
    assert (r.label, r.x0, r.y0, r.x1, r.y1) == ("SIGNATURE", 40.0, 15.0, 60.0, 35.0)
    (tmp_path / "m.csv").write_text("epoch, metrics/mAP50(B), metrics/mAP50-95(B)\n1, 0.5, 0.5\n2, 0.9, 0.6\n3, 0.9, 0.6\n4, x, 0.9\n")
    assert records.best_epoch(records.metrics_csv(spark, str(tmp_path / "m.csv"))).first().epoch == 2
    assert records.source_spec("a=/d:/o.jsonl:lines", "z") == ("a", "/d", "/o.jsonl", True) and records.source_spec("b=/o.jsonl", "z") == ("b", "z", "/o.jsonl", False)


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i, f"mail u{i}@mail.example.com here") for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    df.where("doc_id < 10").write.parquet(f"{tmp_path}/in")
    args = (spark, "doc_id long, text string", f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/cp")
    incremental.run(*args).awaitTermination()
    df.where("doc_id >= 10").write.mode("append").parquet(f"{tmp_path}/in")
    incremental.run(*args).awaitTermination()
    incremental.run(*args).awaitTermination()
    batch = rules.find_rules(df, "doc_id")
    assert sorted(map(str, spark.read.parquet(f"{tmp_path}/out").collect())) == sorted(map(str, batch.select(*spark.read.parquet(f"{tmp_path}/out").columns).collect()))


def test_imaging():
    src = np.array([(0, 0), (10, 0), (10, 10), (0, 10)], float)
    dst = np.array([(1, 2), (12, 1), (13, 14), (0, 11)], float)
    h = imaging.homography(src, dst)
    assert np.allclose(imaging.warp(h, src), dst) and imaging.warp_box(h, (0, 0, 10, 10), 100, 100) == pytest.approx([0, 1, 13, 14])
    mask = np.array([[1, 1, 0, 1], [0, 1, 0, 1], [1, 0, 0, 1], [1, 1, 1, 1]], bool)
    label, n = imaging.components4(mask)
    assert n == 2 and label.tolist() == [[1, 1, 0, 2], [0, 1, 0, 2], [2, 0, 0, 2], [2, 2, 2, 2]]
    assert [r["size"] for r in imaging.region_stats(label, n, np.ones((4, 4)), least=5)] == [8]
    w, d, _ = imaging.min_area_rect(np.array([(0, 0), (3, 3), (2, 4), (-1, 1), (1, 2)]))
    assert sorted((w, d)) == pytest.approx([2**0.5, 18**0.5])
    page = np.full((60, 60), 250, np.uint8)
    page[25:30, 25:35] = 20
    assert imaging.ink(page, (20, 20, 40, 40)).sum() == 50
    assert imaging.ink(np.array([[200, 200, 10], [200, 200, 200]], np.uint8), (0, 0, 3, 2)).sum() == 1  # no frame: the box's own paper
    assert imaging.contrast(np.array([[0, 255]])).tolist() == [[0, 255]]


def test_matching_and_lines(spark):
    seg = "page int, segments array<struct<text:string,bbox:array<double>,score:double>>"
    a = spark.createDataFrame([(1, [("x", [0.0], 0.5), ("y", [1.0], 0.5)])], seg)
    b = spark.createDataFrame([(1, [("x", [0.0], 0.7)])], seg)
    r = matching.parity(a, b, "page").first()
    assert (r.n, r.same_text, r.same_box, round(r.max_diff, 6)) == (2, 1, 1, 0.2)
    taken = F.array(F.struct(F.lit(0).alias("start"), F.lit(12).alias("end")))
    found = column(spark, ["Meena Sharma and Meena Sharma, meena sharma."], lambda c: matching.occurrences(c, "Meena Sharma", taken))[0]
    assert [(m.start, m.end) for m in found] == [(17, 29)]
    words = [(1, i, t, s, s + len(t), float(s) * 8, 0.0, float(s + len(t)) * 8, 10.0) for i, (t, s) in enumerate((("Name:", 0), ("Ravi", 6), ("Kumar", 11), ("age", 17), ("41", 21)))]
    w = spark.createDataFrame(words, "page int, wi int, text string, start int, end int, x0 double, y0 double, x1 double, y1 double")
    line = spark.createDataFrame([(1, 0, "Narne: Ravi Kurnar age 41", 0.0, 0.0, 184.0, 10.0)], "page int, si int, text string, x0 double, y0 double, x1 double, y1 double")
    e = spark.createDataFrame([(1, 0, 6, 16, "Ravi Kumar"), (1, 1, 21, 23, "41")], "page int, ei int, start int, end int, text string")
    moved = transfer.transfer_lines(line, w, e, "page").collect()
    assert sorted((r.ei, r.start, r.end, r.ocr, round(r.cer, 6)) for r in moved) == [(0, 7, 18, "Ravi Kurnar", round(2 / 9, 6)), (1, 23, 25, "41", 0.0)]


def test_edges_of_text(spark):
    d = spark.createDataFrame([("(ICIC0740688).", "ICIC0740688"), ("Bhat,", "Bhat"), ("Bhat,", "Bhat,"), ("St.", "St."), ("((", "x"), ("", "x")], "v string, t string")
    skip, value = T.trim_outer(F.col("v"), F.col("t"))
    assert [tuple(r) for r in d.select(skip, value).collect()] == [(1, "ICIC0740688)"), (0, "Bhat"), (0, "Bhat,"), (0, "St."), (2, ""), (0, "")]
    d = spark.createDataFrame([("ab cdef gh", 4, 5), ("ab cdef gh", 0, 0), ("ab", 2, 2), ("a\u00a0bc", 3, 4)], "t string, a int, b int")
    s = T.snapped(F.col("t"), F.col("a"), F.col("b"))
    assert [tuple(r) for r in d.select(*s).collect()] == [(3, 7), (0, 2), (0, 2), (2, 4)]
    assert column(spark, ["", "--", "₹+", "a-", "-\n"], T.is_punct) == [True, True, True, False, False]
    assert column(spark, [0.123, None], T.percent, "double") == ["12.3%", "–"]


def test_boxes_of_detectors(spark):
    b = [(1, 0, 0.0, 0.0, 40.0, 10.0), (1, 1, 42.0, 1.0, 80.0, 11.0), (1, 2, 200.0, 0.0, 240.0, 10.0), (1, 3, 0.0, 30.0, 40.0, 40.0)]
    d = spark.createDataFrame(b, "page int, ord long, x0 double, y0 double, x1 double, y1 double")
    g = layout.grouped_boxes(d, "page").orderBy("line", "part").collect()
    assert [(r.n, r.x0, r.y0, r.x1, r.y1) for r in g] == [(2, -1.0, -1.0, 81.0, 12.0), (1, 199.0, -1.0, 241.0, 11.0), (1, -1.0, 29.0, 41.0, 41.0)]
    assert [r.ord for r in matching.hit(d, 45, 5, 4, "page").collect()] == [1]
    assert layout.grouped_boxes(d.limit(0), "page").count() == 0
    h = spark.createDataFrame([(0.0, 341.0, 1024.0, 683.0)], "x0 double, y0 double, x1 double, y1 double")
    back = h.select(*G.unletterbox(G.Box.of(), F.lit(300.0), F.lit(100.0))).first()
    assert all(abs(a - b) < 0.5 for a, b in zip(back, (0, 0, 300, 100), strict=True))


def test_tables_of_recognisers(spark, tmp_path):
    rows = ["5\t1\t1\t1\t1\t1\t10\t20\t30\t40\t95\tword", "4\t1\t1\t1\t1\t0\t10\t20\t30\t40\t-1\tline", "5\t1\t1\t1\t1\t1\t1\t2\t3\t4\t9\t ", "5\tshort"]
    w = records.tsv_words(spark.createDataFrame([(r,) for r in rows], "value string"))
    assert [tuple(r) for r in w.collect()] == [("word", 10, 20, 40, 60, 0.95)]
    lines = spark.createDataFrame([("train", "a", "0 0.5 0.5 0.1 0.1")], "split string, file string, line string")
    records.write_yolo(lines, str(tmp_path / "y"))
    assert [tuple(r) for r in spark.read.text(str(tmp_path / "y")).select("split", "value").collect()] == [("train", "0 0.5 0.5 0.1 0.1")]
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        records.write_yolo(lines, str(tmp_path / "y"))


def test_quota_ends_with_a_page(spark):
    d = spark.createDataFrame([("f", p, k) for p in range(4) for k in range(3)], "source string, page int, k int")
    assert sorted({r.page for r in sampling.quota(d, "source", "page", 4).collect()}) == [0, 1]
    m = spark.createDataFrame([(i, "en", f"t{i % 3}") for i in range(30)], "id int, lang string, kind string")
    s = sampling.splits(m, "lang", "kind", "id", F.col("kind") == "t0", F.col("id"), 6, 3, 10).collect()
    assert len(s) == len({r.id for r in s}) == 19
    assert sum(r.split == "train" and r.id % 3 == 0 for r in s) == 7


def test_catalog_has_sql():
    missing = set(catalog.queries()) - set(catalog.oracle_sql())
    assert missing <= {"transfer_lines"}


def windows_of(n, size, stride):
    """The windows of n places, by the walk of the definition."""
    out, at = [(0, min(size, n))], 0
    while out[-1][1] < n:
        at += stride
        out.append((at, min(at + size, n)))
    return out


def test_texts_of_identifiers_are_not_broadcast(spark):
    from inkveil.plans import catalog

    plan = catalog.queries()["context_filter"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_span_index_takes_whole_documents(spark):
    token = re.compile(r"\w+(?:[-_]\w+)*|\S")
    want = []
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect():
        for a, b in windows_of(len(token.findall(r.text)), 200, 150):
            made = [a + i + k < b for i in range(b - a) for k in range(12)]
            want.append((r.doc_id, a, len(made), sum(made)))
    got = [tuple(r) for r in catalog.queries()["span_index"](spark, "/root/testdata/sf0.001").collect()]
    assert sorted(got) == sorted(want) and len({r[2:] for r in got}) > 100


def test_padded_feed_takes_whole_documents(spark):
    want = []
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "n_chars").collect():
        want += [(r.doc_id, a, 256, b - a, a if b > a else -1, b - 1 if b - a == 256 else -1) for a, b in windows_of(r.n_chars, 256, 256)]
    got = [tuple(r) for r in catalog.queries()["padded_feed"](spark, "/root/testdata/sf0.001").collect()]
    assert sorted(got) == sorted(want)


def test_padded_refuses_more_than_fit(spark):
    assert column(spark, [[], [1], [1, 2]], lambda c: matching.padded(c, 2, F.lit(-1)), "array<int>") == [[-1, -1], [1, -1], [1, 2]]
    with pytest.raises(Exception, match="3 values; at most 2 fit"):
        column(spark, [[1, 2, 3]], lambda c: matching.padded(c, 2, F.lit(-1)), "array<int>")


def test_fold_is_case_folding_of_every_character(spark):
    chars = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) != "Cn"]
    texts = [*(a + b for a, b in zip(chars, ["", "a", "Σ", "ß"] * len(chars))), "ΟΔΟΣ", "STRASSE ẞ", "ﬁn İ", ""]  # noqa: B905
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, v string")
    got = [r[0] for r in d.orderBy("i").select(T.fold(F.col("v"))).collect()]
    assert [(t, g) for t, g in zip(texts, got, strict=True) if g != t.casefold()] == []


def test_matches_of_long_texts(spark):
    rng = random.Random(5)
    texts = ["", "x", " ".join("w" * rng.randrange(1, 9) for _ in range(5000)), "-" * 130, "a " * 65, " " * 300]
    token = re.compile(r"\w+(?:[-_]\w+)*|\S")
    got = column(spark, texts, T.tokens)
    assert [[(t.start, t.end, t.text) for t in g] for g in got] == [[(m.start(), m.end(), m[0]) for m in token.finditer(v)] for v in texts]
    assert column(spark, [None, "a"], lambda c: T.tokens(c).isNull()) == [True, False]


def test_regions_of_two_readings(spark):
    seg = [(1, e, k, t, 10.0 * k, 0.0 if k < 2 else 30.0, 10.0 * k + 9, 10.0 if k < 2 else 40.0) for e in "ab" for k, t in enumerate(("PAN", "ABCPK1234F" if e == "a" else "ABCPKI234F", "end"))]
    s = spark.createDataFrame(seg, "page int, engine string, ord long, text string, x0 double, y0 double, x1 double, y1 double")
    assert {(r.engine, r.page_text) for r in flows.page_texts(s, "page", "engine").collect()} == {("a", "PAN ABCPK1234F\nend"), ("b", "PAN ABCPKI234F\nend")}
    rule = lambda c: F.transform(T.find_all(c, "[A-Z]{5}[0-9]{4}[A-Z]"), lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.lit("PAN").alias("label"), F.lit(1.0).alias("score")))
    d = spark.createDataFrame([(1, "FACE", 0.0, 50.0, 9.0, 60.0, 0.9), (1, "STAMP", 0.0, 70.0, 9.0, 80.0, 0.1)], "page int, label string, x0 double, y0 double, x1 double, y1 double, score double")
    got = flows.analyse(s, rule, "engine", d, "page").collect()
    assert sorted((r.kind, r.label, r.x0, r.y0, r.x1, r.y1, r.source) for r in got) == [("text", "PAN", 10.0, 0.0, 19.0, 10.0, "a"), ("visual", "FACE", 0.0, 50.0, 9.0, 60.0, "detector")]
    assert flows.analyse(s.limit(0), rule, "engine", None, "page").count() == 0


def test_pools_take_from_each_other(spark):
    import zlib

    names = [f"d/{k}.jpg" for k in range(40)]
    got = {(r.file, r.pool) for r in flows.pools(spark.createDataFrame([(n,) for n in names], "file string"), "file").collect()}
    assert got == {(n, "heldout" if zlib.crc32(n[2:].encode()) % 10 == 0 else "train") for n in names}
    one = flows.pools(spark.createDataFrame([(names[0],)], "file string"), "file").collect()
    assert sorted(r.pool for r in one) == ["heldout", "train"]
    assert flows.pools(spark.createDataFrame([], "file string"), "file").count() == 0


def test_words_meet_the_entities_of_their_stretch(spark):
    rng = random.Random(8)
    words = [(1, k, a, a + rng.randrange(8)) for k, a in enumerate(rng.randrange(400) for _ in range(150))]
    ents = [(1, k, a, a + rng.randrange(150)) for k, a in enumerate(rng.randrange(400) for _ in range(12))]
    w = spark.createDataFrame(words, "page int, wi int, start int, end int")
    e = spark.createDataFrame(ents, "page int, ei int, start int, end int")
    want = {(k, max(j for _, j, x, z in ents if x <= a and b <= z)) for _, k, a, b in words if any(x <= a and b <= z for _, _, x, z in ents)}
    assert {(r.wi, r.ei) for r in transfer.entity_of_words(w, e, "page").collect()} == want
