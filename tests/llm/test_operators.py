"""Each operator on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, against plain Python."""

import base64
import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict
from functools import reduce

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from inkveil.llm import _bytes as B
from inkveil.llm import _shared, chat_format, decontaminate, exact_dedup, lang_id, lattice_lm, near_dedup, packing, queries, token_counts, toxicity, warc

T = queries.TOKENIZERS
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()
random.seed(3)
BODY = " ".join(random.choice(WORDS) + str(random.randrange(50)) for _ in range(120))
NEAR = BODY.replace(BODY.split()[60], "changed", 1)
TEXTS = [(0, None), (1, ""), (2, "Straße Über ALLES"), (3, BODY), (3, BODY), (4, BODY.upper().replace("É", "é")), (5, NEAR), (None, BODY), (6, "don't we'll 'quote' x\n\n  y  I'm <|endoftext|> 12ab ½ 東京 😀 é́"), (7, LONG), (8, " \t\n "), (9, "one"), (10, None)]
CLASH = "text string, t string, uid long, id long, kept boolean, n_words long, h long, x int, registers string, score double, lang_pred string"


def low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "junk", 7, 7, True, 1, 1, 1, "r", 0.5, "zz") for i, t in TEXTS]
    return spark.createDataFrame(rows, f"doc_id long, {CLASH}")


def empty(df):
    return df.where("1 = 0")


def test_hashes_agree():
    column = pa.array(["a bc  d", None, "", "bc", "d d"])
    data, offsets = B.raw(column)
    s, e, bound = B.spans(data, offsets, B.SOLID)
    assert bound.tolist() == [0, 3, 3, 3, 4, 6]
    assert B.hashes(data, s, e).tolist() == [B.hash_of(x) for x in (b"a", b"bc", b"d", b"bc", b"d", b"d")]


def thue(a: str, b: str, n: int) -> tuple[str, str]:
    """A Thue-Morse string of two words and its complement: polynomial hashes modulo a power of two can't tell them apart."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join((a, b)[x] for x in bits), "".join((b, a)[x] for x in bits)


def test_words_are_told_apart_by_their_bytes():
    for n in (3, 8, 9, 16, 500, 513, 1024, 4096):
        x, y = thue("a", "b", n)
        data, off = B.raw(pa.array([x, y, x, y + "c", x]))
        codes, values, at = B.distinct_runs(data, off[:-1], off[1:])
        assert codes.tolist() == [0, 1, 0, 2, 0] and at.tolist() == [0, 1, 3] and len({*values.tolist()}) == 3
    rng = random.Random(3)
    words_ = ["".join(rng.choice("ab") for _ in range(rng.choice([1, 2, 7, 8, 9, 17, 40]))) for _ in range(2000)]
    data, off = B.raw(pa.array(words_))
    codes, _, at = B.distinct_runs(data, off[:-1], off[1:])
    assert [words_[i] for i in at[codes]] == words_ and len(at) == len({*words_})


def test_thue_morse_texts(spark):
    """Texts that a polynomial hash takes for one another: each operator tells them apart."""
    from tokenizers import Tokenizer

    raw = open(f"{T}/byte_bpe_50k.json", encoding="utf-8").read()
    x, y = thue("a", "b", 4096)
    ids, off = packing.Encoder(raw).encode(pa.array([x, y]))
    t = Tokenizer.from_str(raw)
    assert [ids[a:b].tolist() for a, b in zip(off[:-1], off[1:], strict=True)] == [t.encode(v, add_special_tokens=False).ids for v in (x, y)]
    i, s = thue("i", "s", 1024)
    df = spark.createDataFrame([(1, i), (2, s), (3, x), (4, y)], "doc_id long, text string")
    pieces = token_counts.load_pieces(f"{T}/piece_bpe_32k.model")
    machine = token_counts.Automaton(pieces)
    assert {r.doc_id: r.n_pieces for r in token_counts.count_tokens(df, pieces).collect()} == {k: machine.count(token_counts.MARK + v.encode()) for k, v in ((1, i), (2, s), (3, x), (4, y))}
    u, v = thue("one two three four five six ", "seven eight nine ten eleven twelve ", 2048)
    both = spark.createDataFrame([(1, u), (2, v), (3, x), (4, y)], "doc_id long, text string")
    doc, w, count, prints, n = near_dedup.shingles(pa.array([u, v, x, y]))
    assert len({*zip(prints[0].tolist(), prints[1].tolist(), strict=True)}) == 4
    got = {r.doc_id: r.class_id for r in near_dedup.near_groups(both).collect()}
    assert got[3] == 3 and got[4] == 4
    bench = spark.createDataFrame([("x", x)], "item_id string, text string")
    assert {r.doc_id: r.n_hit for r in decontaminate.contaminate(df, bench).collect()} == {1: 0, 2: 0, 3: 1, 4: 0}
    assert {r.doc_id: r.n_known for r in lattice_lm.score(spark.createDataFrame([(1, x), (6, y)], "doc_id long, text string"), [("▁a".encode(), -1.0)], held_out=(5, 9)).collect()} == {1: 2, 6: 2}


def shuffled(spark, rows, ddl, parts):
    """The rows after a shuffle, whose partitions adaptive execution joins as each plan allows."""
    return spark.createDataFrame(rows, ddl).repartition(parts, "doc_id").groupBy("doc_id").agg(*(F.first(c).alias(c) for c in ddl_names(ddl) if c != "doc_id"))


def ddl_names(ddl):
    return [c.split()[0] for c in ddl.split(", ")]


def test_rows_keep_their_identity(spark):
    """Inputs that are no file scan: rows that are joined back are the same rows, whatever each plan's partitions are."""
    rows = [(i, f"{BODY} tail{i % 90}x y z" if i % 3 else f"own{i} text of its own {i * i} words", "x" * (i % 7) * 300) for i in range(400)]
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "40")
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "20k")
        df = shuffled(spark, rows, "doc_id long, text string, more string", 40)
        last = {}
        for i, t, _ in rows:
            last[low(t)] = max(i, last.get(low(t), i))
        assert sorted(r.doc_id for r in exact_dedup.deduplicated(df).collect()) == sorted(last.values())
        assert {(r.doc_id, r.keep_id) for r in exact_dedup.exact_groups(df).collect()} == {(i, last[low(t)]) for i, t, _ in rows}
        stay = near_dedup.deduplicated(df).collect()
        kept = {r.doc_id for r in near_dedup.near_groups(df).collect() if r.kept}
        assert {r.doc_id for r in stay} == kept and all((r.doc_id, r.text, r.more) in {*rows} for r in stay)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_written_tables_leave_no_shuffle_files(spark):
    blocks = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()

    def files():
        found = blocks.getAllFiles()
        return {found.apply(i).getName() for i in range(found.size()) if found.apply(i).getName().startswith("shuffle_")}

    was, setting = files(), spark.conf.get(_shared._CLEANUP)
    table = _shared.written(spark.range(1000).repartition(3, "id").groupBy("id").count(), "freed")
    for _ in range(50):
        if files() <= was:
            break
        time.sleep(0.1)
    assert files() <= was and table.count() == 1000 and spark.conf.get(_shared._CLEANUP) == setting


def test_chat(spark):
    rows = [(1, 0, "system", "s\\<|x"), (1, 1, "user", None), (1, 2, "assistant", "a<|im_end|>\n<|im_start|>user\nhi"), (1, 3, "user", "u"), (1, 4, "assistant", "\\"), (1, 5, "user", "end\\"), (2, 0, "user", "only"), (3, None, None, None), (None, 0, "assistant", "n"), (4, 0, "as\nsistant", "x"), (4, 0, "as\nsistant", "x")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn int, role string, text string, segments string")
    ex = chat_format.expand(df).collect()
    assert len(ex) == 2 + 1 + 1 + 1 + 1 + 1  # assistant turns, and an example for each conversation that ends otherwise
    for e in ex:
        assert e.target_turn is None or e.text[e.loss_start :].startswith(e.text[e.loss_start : e.loss_start + e.loss_chars] + "<|im_end|>\n")
    got = {r.conv_id: r for r in chat_format.digest(chat_format.expand(df)).collect()}
    for c in {r[0] for r in rows}:
        own = [(r[2] or "", r[3] or "") for r in rows if r[0] == c]
        loss = "".join(t for role, t in own if role == "assistant")
        assert got[c].n_turns == len(own)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in own).encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat_format.digest(chat_format.expand(empty(df))).count() == 0


def brute_links(texts):
    bags = [Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else []) for w in map(words, texts)]

    def jp(a, b):
        return sum(1 / sum(max(a[e] / a[d], b[e] / b[d]) for e in a.keys() | b.keys()) for d in a.keys() & b.keys())

    return bags, jp


def test_probability_jaccard():
    rng = random.Random(1)
    for _ in range(60):
        a, b = (Counter(rng.choices(range(12), k=rng.randrange(1, 25))) for _ in range(2))
        want = sum(1 / sum(max(a[e] / a[d], b[e] / b[d]) for e in a.keys() | b.keys()) for d in a.keys() & b.keys())
        got = near_dedup.similarity(np.array([*a]), np.array([*a.values()]), np.array([*b]), np.array([*b.values()]))
        assert math.isclose(got, want, abs_tol=1e-12)


def test_registers_estimate():
    rng = np.random.default_rng(2)
    a, b = np.arange(1000), np.arange(100, 1100)
    mixed = B.mix(np.concatenate([a, b]).astype(np.uint64) + np.uint64(99))
    q = near_dedup.signatures(np.repeat([0, 1], 1000), mixed, np.ones(2000), 2, 2000)
    assert abs((q[0] == q[1]).mean() - 900 / 1100) < 0.03
    w = rng.integers(1, 9, 1000).astype(float)
    q = near_dedup.signatures(np.repeat([0, 1], 1000), B.mix(np.concatenate([a, a]).astype(np.uint64)), np.concatenate([w, 3 * w]), 2, 300)
    assert ((q[0] ^ q[1]) & np.uint64(0xFFFFFFFF) == 0).mean() > 0.99  # scale does not matter, but for rounded ties


def test_near_groups(docs):
    got = near_dedup.near_groups(docs).collect()
    assert len(got) == len(TEXTS)
    by = defaultdict(set)
    for r in got:
        by[r.doc_id].add(r.class_id)
    assert by[3] == by[4] == by[5] == by[None] == {3}
    assert by[2] == {2} and by[7] == {7} and by[8] == {8} and by[1] == {1}
    assert sum(r.kept for r in got if r.doc_id in (3, 4, 5, None)) == 1 and all(r.kept for r in got if r.doc_id in (0, 1, 2, 6, 7, 8, 9, 10))
    assert near_dedup.near_groups(empty(docs)).count() == 0
    stay = near_dedup.deduplicated(docs)
    assert stay.columns == docs.columns and stay.count() == len(TEXTS) - 4


def test_near_family(spark):
    """A hot family whose members differ in a few words, and others that share a passage only: all components."""
    rng = random.Random(5)
    base = [f"b{i}" for i in range(150)]
    texts = []
    for _ in range(60):
        w = list(base)
        for _ in range(rng.randrange(1, 6)):
            w[rng.randrange(150)] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    texts += [" ".join(base[:110] + [f"y{rng.randrange(10**6)}" for _ in range(40)]) for _ in range(20)]
    got = {r.doc_id: r.class_id for r in near_dedup.near_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    bags, jp = brute_links(texts)
    owner = list(range(len(texts)))

    def root(i):
        while owner[i] != i:
            i = owner[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if len(bags[i] & bags[j]) / len(bags[i] | bags[j]) >= 0.8:
                a, b = sorted((root(i), root(j)))
                owner[b] = a
    assert [got[i] for i in range(len(texts))] == [root(i) for i in range(len(texts))]


def test_meet_in_blocks():
    """Blocks of a cluster return links that join all components."""
    rng = random.Random(8)
    base = [f"b{i}" for i in range(100)]
    texts = [" ".join(w if rng.random() > 0.01 else f"z{rng.randrange(10**6)}" for w in base) for _ in range(30)]
    doc, w, count, _, n = near_dedup.shingles(pa.array(texts))
    q = near_dedup.signatures(doc, w, count.astype(float), len(n), near_dedup.BANDS * near_dedup.ROWS)
    regs = [(r & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes() for r in q]
    t = pa.table({"c": list(range(30)), "k": list(range(30)), "registers": pa.array(regs, pa.binary()), "t": texts, "side": [2] * 30})
    out = near_dedup._meet(0.8)(t)
    bags, _ = brute_links(texts)
    j = lambda a, b: len(bags[a] & bags[b]) / len(bags[a] | bags[b])
    assert all(j(a, b) >= 0.8 for a, b in zip(out["x"].to_pylist(), out["y"].to_pylist(), strict=True))
    assert out.num_rows <= 29


def test_blocks_are_dealt_in_shares_of_bounded_size(spark):
    """All pairs of different components of a cluster meet, but no share of the blocks holds much more than asked for."""
    rows = [(u, 1000 * u + i, 1000 * u + i // 3, f"{i:03d}" * 12) for u in (1, 2) for i in range(60)]
    placed = near_dedup._blocks(spark.createDataFrame(rows, "u long, c long, k long, t string"), 400)
    whole = placed.select("u", F.explode("o").alias("o"), "c", "k", "t").select("u", "o.*", "c", "k", "t").collect()
    total, most = sum(len(r.t) + 64 for r in whole), 30_000
    shares = [s.collect() for s in near_dedup._shares(placed, most)]
    assert total > 4 * most and max(sum(len(r.t) + 64 for r in s) for s in shares) < 1.5 * most
    assert sorted(r for s in shares for r in s) == sorted(whole)
    pairs = set()
    for s in shares:
        blocks = defaultdict(list)
        for r in s:
            blocks[r.u, r.kind, r.i, r.j].append(r)
        pairs |= {(a.c, b.c) for m in blocks.values() for a in m for b in m if a.side != 1 and b.side != 0 and a.k != b.k}
    assert {frozenset(p) for p in pairs} == {frozenset((a[1], b[1])) for a in rows for b in rows if a[0] == b[0] and a[2] != b[2]}


def test_lists_of_blocks_are_never_written(spark, monkeypatch):
    """A row's list of blocks grows with its cluster: thousands of rows with their lists in one batch don't fit a task."""
    rng, kinds = random.Random(11), {}
    texts = [" ".join([f"r{i}" for i in range(40)] + [f"v{d}x{rng.randrange(10**6)}" for _ in range(60)]) for d in range(30)]
    texts += [" ".join(t.split()[:-1] + ["other"]) for t in texts]
    keep = lambda df, name: kinds.setdefault(name, df.dtypes) and _shared.written(df, name)
    monkeypatch.setattr(near_dedup, "written", keep)
    got = near_dedup.near_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert {r.doc_id: r.class_id for r in got.collect()} == {d: d % 30 for d in range(60)}
    assert not any("array" in kind or "struct" in kind for _, kind in kinds["members"])


def test_ranks_are_counts_and_tell_shingles_of_many_texts_apart(spark):
    """A million shingles that occur once each don't hide those that occur thirty times."""
    rng = random.Random(8)
    common = "one two three four five six seven eight nine"
    texts = [" ".join(f"{rng.getrandbits(32):08x}" for _ in range(10_000)) for _ in range(100)] + [common] * 30 + [None, ""]
    ranks = near_dedup._ranked(spark.createDataFrame([(t or "",) for t in texts], "t string"))
    at = (near_dedup.shingles(pa.array(texts))[1] & np.uint64(len(ranks) - 1)).astype(np.int64)
    assert ranks.tolist() == np.bincount(at, minlength=len(ranks)).tolist()
    seen = (near_dedup.shingles(pa.array([common]))[1] & np.uint64(len(ranks) - 1)).astype(np.int64)
    assert ranks[seen].min() >= 30 and np.quantile(ranks[at[: -30 * len(seen)]], 0.99) <= 6
    many = near_dedup._ranks(pa.table({"g": [0] * 900, "i": [np.array([1, 2], "<u2").tobytes()] * 900, "n": [bytes([1, 255])] * 900}))
    rank = np.frombuffer(many["r"][0].as_py(), np.uint8)
    assert rank[0] == 0 < 127 < rank[1] < rank[2] <= 255


def test_meet_finds_all_components():
    """Blocks lose no pair of 0.8 or more, however few registers agree; bags of repeated shingles as well."""
    rng = random.Random(5)
    texts = []
    for g in range(1500):
        base = [f"g{g}w{i}" for i in range(94)]
        texts += [" ".join(base), " ".join(base[:-10] + [f"h{g}x{i}" for i in range(10)])]  # 80 shingles of 100 shared
    doc, w, count, _, n = near_dedup.shingles(pa.array(texts))
    m = near_dedup.BANDS * near_dedup.ROWS
    r = (near_dedup.signatures(doc, w, count.astype(float), len(n), m) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    lowest = np.argsort((r[::2] == r[1::2]).sum(1), kind="stable")[:4]
    chosen = [texts[2 * g + s] for g in lowest.tolist() for s in (0, 1)]
    regs = [r[2 * g + s].tobytes() for g in lowest.tolist() for s in (0, 1)]
    assert (r[2 * lowest[0]] == r[2 * lowest[0] + 1]).mean() < 0.7
    size = len(chosen)
    block = lambda ts, rs, side: near_dedup._meet(0.8)(pa.table({"c": list(range(len(ts))), "k": list(range(len(ts))), "registers": pa.array(rs, pa.binary()), "t": ts, "side": side}))
    out = block(chosen, regs, [2] * size)
    assert sorted(tuple(sorted(p)) for p in zip(out["x"].to_pylist(), out["y"].to_pylist(), strict=True)) == [(i, i + 1) for i in range(0, size, 2)]
    bags = ["a b c d e " * k + " ".join(f"t{rng.randrange(12)}" for _ in range(6)) for k in range(2, 22)]
    doc, w, count, _, n = near_dedup.shingles(pa.array(bags))
    of = [(w[doc == d], count[doc == d]) for d in range(len(n))]
    near = {(a, b) for a in range(0, 20, 2) for b in range(1, 20, 2) if near_dedup.similarity(*of[a], *of[b]) >= 0.8}
    out = block(bags, [b""] * 20, [0, 1] * 10)
    links = set(zip(out["x"].to_pylist(), out["y"].to_pylist(), strict=True))

    def groups(pairs):
        k = list(range(20))
        for a, b in pairs:
            k = [k[a] if x == k[b] else x for x in k]
        return [k.index(x) for x in k]

    assert near and links <= near and groups(links) == groups(near)


def test_lattice_is_all_segmentations():
    lat = lattice_lm.Lattice([("▁a".encode(), -1.0), ("▁ab".encode(), -2.0), ("▁".encode(), -3.0), (b"b", -1.5), (b"bc", -2.5), (b"abc", -4.0)])
    p = np.random.default_rng(0).dirichlet(np.ones(lat.n))
    at = {}
    for side, table in zip(("start", "inner"), lat.sides, strict=True):
        for k, (keys, ids, _) in table.items():
            at |= {(side, k, int(h)): i for h, i in zip(keys.tolist(), ids.tolist(), strict=True)}

    def inner(w):
        return 1.0 if not w else sum(p[i] * inner(w[k:]) for k in range(1, len(w) + 1) if (i := at.get(("inner", k, lattice_lm.piece_hash(w[:k])))) is not None)

    def word(w):
        return p[lat.bare] * inner(w) + sum(p[i] * inner(w[k:]) for k in range(1, len(w) + 1) if (i := at.get(("start", k, lattice_lm.piece_hash(w[:k])))) is not None)

    ws = [b"abc", b"a", b"bcb", "é".encode(), b"abcabcabc"]
    flat, off = np.frombuffer(b"".join(ws), np.uint8), np.concatenate([[0], np.cumsum([len(w) for w in ws])])
    assert np.allclose(np.exp(lat.forward(flat, off, np.log(p))), [word(w) for w in ws])
    z, uses = lat.forward(flat, off, np.log(p), np.ones(len(ws)))
    assert np.allclose(z, lat.forward(flat, off, np.log(p))) and np.all(uses >= -1e-12)


def test_long_words_in_slabs(monkeypatch):
    """A long word's probability and expected pieces, slab by slab, are those of its whole lattice."""
    lat = lattice_lm.Lattice([("▁a".encode(), -1.0), ("▁ab".encode(), -2.0), ("▁".encode(), -3.0), (b"b", -1.5), (b"bc", -2.5), (b"abc", -4.0), (b"cabcab", -3.0)])
    rng = random.Random(6)
    ws = ["".join(rng.choice("abc") for _ in range(n)).encode() for n in (1, 30, 200, 333)]
    flat, off = np.frombuffer(b"".join(ws), np.uint8), np.concatenate([[0], np.cumsum([len(w) for w in ws])])
    want = lat.forward(flat, off, lat.logp, np.arange(1.0, 5))
    monkeypatch.setattr(lattice_lm, "LONG", 20)
    monkeypatch.setattr(lattice_lm, "_SLAB", 64)
    got = lat.forward(flat, off, lat.logp, np.arange(1.0, 5))
    assert np.allclose(got[0], want[0]) and np.allclose(got[1], want[1]) and np.allclose(lat.forward(flat, off, lat.logp), want[0])


def test_language_model(docs):
    got = lattice_lm.score(docs, lattice_lm.load_vocabulary(f"{T}/piece_bpe_32k.model")).collect()
    assert len(got) == len(TEXTS)
    toks = lambda t: re.findall(r"[^\x20\x09-\x0D]+", low(t)) + [None]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    c = reduce(lambda a, b: a + b, (Counter(toks(t)) for i, t in TEXTS if not held(i)), Counter())
    n, v = sum(c.values()), len(c)
    want = sorted((str(i), held(i), len(toks(t)), sum(c[x] > 0 for x in toks(t)), n, round(sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in toks(t)), 5)) for i, t in TEXTS)
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got) == want
    joined = lattice_lm.score(docs, lattice_lm.load_vocabulary(f"{T}/piece_bpe_32k.model"), heavy=50).collect()  # most words by the join
    full = lambda rows: sorted((str(r.doc_id), r.n_known, round(r.base_score, 5), round(r.score, 5)) for r in rows)
    assert full(joined) == full(got)
    assert lattice_lm.score(empty(docs), [("▁a".encode(), -1.0)]).count() == 0


def test_language_model_score(spark):
    """The score is the log of the sum over all segmentations, with weights that the training words' expected pieces give."""
    vocabulary = [("▁a".encode(), -1.0), ("▁ab".encode(), -2.0), ("▁".encode(), -3.0), (b"b", -1.5), (b"bc", -2.5), (b"abc", -4.0)]
    texts = [(0, "ab abc  AB"), (1, None), (2, "cab"), (3, "abcabc a é"), (5, "bc"), (6, "abcab zz")]
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    weight = {("in", bytes([i])): -4.0 - 3 for i in range(256)}
    weight |= {("start" if p.startswith("▁".encode()) and len(p) > 3 else "bare" if p == "▁".encode() else "in", p.removeprefix("▁".encode())): w for p, w in vocabulary}

    def split(w, at=0):
        """All segmentations: lists of pieces."""
        if at == len(w):
            yield []
        for k in range(1, len(w) - at + 1):
            x = w[at : at + k]
            if not at and ("start", x) in weight:
                for rest in split(w, k):
                    yield [("start", x), *rest]
            if ("in", x) in weight:
                for rest in split(w, at + k):
                    yield [*([("bare", b"")] if not at else []), ("in", x), *rest]

    train = Counter(w.encode() for i, t in texts if not held(i) for w in low(t).split())
    total = sum(math.exp(w) for w in weight.values())
    p = {x: math.exp(w) / total for x, w in weight.items()}
    for _ in range(lattice_lm.ROUNDS):
        use = dict.fromkeys(p, 0.01)
        for w, c in train.items():
            ways = [(math.prod(p[x] for x in way), way) for way in split(w)]
            for q, way in ways:
                for x in way:
                    use[x] += c * q / sum(q for q, _ in ways)
        p = {x: u / sum(use.values()) for x, u in use.items()}
    n, m = sum(train.values()), sum(not held(i) for i, _ in texts)
    stop = (m + 0.5) / (n + m + 1)
    want = {i: math.log10(stop) + sum(math.log10((1 - stop) * sum(math.prod(p[x] for x in way) for way in split(w.encode()))) for w in low(t).split()) for i, t in texts}
    got = {r.doc_id: r.score for r in lattice_lm.score(spark.createDataFrame(texts, "doc_id long, text string"), vocabulary).collect()}
    assert any(held(i) for i, _ in texts) and all(math.isclose(got[i], want[i], rel_tol=1e-9) for i in want)


def test_language(spark, docs):
    en, de = "the house and the garden of this thing with other words that were there", "das haus und der garten von dieser sache mit anderen wörtern die dort waren"
    rows = [(i, en if i % 2 else de, "en" if i % 2 else "de") for i in range(40)] + [(100, "Привет мир это русский текст про дом и сад", "ru")] * 4 + [(101, None, "en"), (102, "x", None)]
    model = lang_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model["langs"] == ["de", "en", "ru"]
    test = spark.createDataFrame([(1, f"{en} {en}. {de}"), (2, None), (3, "12 !!"), (4, ""), (5, "привет"), (6, "«»"), (7, "İstanbul " + de), (7, "İstanbul " + de)], "doc_id long, text string")
    got = {r.doc_id: r for r in lang_id.identify(test, model).collect()}
    assert [s.lang for s in got[1].lang_spans] == ["en", "de"] and got[1].lang_pred == "en" and 0.5 < got[1].lang_score < 1
    assert got[1].lang_spans[1].start == len(f"{en} {en}. ")
    assert all(got[i].lang_pred == "und" and got[i].lang_score == 0 for i in (2, 3, 4, 6)) and got[5].lang_pred == "ru" and got[7].lang_pred == "de"
    assert lang_id.identify(empty(docs), model).count() == 0
    out = lang_id.identify(docs, model)
    assert out.columns == [c for c in docs.columns if c != "lang_pred"] + ["lang_pred", "lang_score", "lang_spans"] and out.count() == len(TEXTS)
    assert {r.lang_pred for r in lang_id.identify(test, lang_id.train(spark.createDataFrame([], "doc_id long, text string, lang string"))).collect()} == {"und"}


def test_viterbi_is_best_path():
    rng = np.random.default_rng(4)
    for n in (1, 2, 6):
        s = rng.normal(size=(n, 3)) * 3
        best = max(np.ndindex(*[3] * n), key=lambda p: sum(s[i, x] for i, x in enumerate(p)) - 2 * sum(a != b for a, b in zip(p, p[1:], strict=False)))
        assert lang_id.viterbi(np.concatenate([s, s[:1], s]), np.array([0, n, n, n + 1, 2 * n + 1]), 2.0)[:n].tolist() == list(best)


def test_decontaminate(spark, docs):
    item = " ".join(BODY.split()[40:53])
    bench = spark.createDataFrame([(1, item, 0), (1, item, 1), (2, "ONE", 2), (3, None, 3), (4, " .. ", 4), (None, "Über alles", 5), (5, LONG, 6), (6, "two one", 7)], "item_id long, text string, n_words int")
    items = [("1", item), ("2", "ONE"), ("", "Über alles"), ("5", LONG), ("6", "two one")]
    for size in (decontaminate.BROADCAST_BYTES, 100):  # by a broadcast, by joins
        out = decontaminate.contaminate(docs, bench, broadcast_bytes=size)
        assert set(docs.columns) <= set(out.columns)
        got = Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in out.collect())
        want = Counter()
        for i, t in TEXTS:
            w, hit, found = words(t), set(), set()
            at = defaultdict(list)
            for k, x in enumerate(w):
                at[x].append(k)
            for name, it in items:
                v = words(it)
                k = min(10, len(v))
                for win in {tuple(v[s : s + k]) for s in range(len(v) - k + 1)}:
                    for s in at[win[0]]:
                        if tuple(w[s : s + k]) == win:
                            hit.update(range(s, s + k))
                            found.add(name)
            want[i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)] += 1
        assert got == want
    assert decontaminate.contaminate(empty(docs), bench).count() == 0
    assert not decontaminate.contaminate(docs, empty(bench)).where("contaminated").count()


def test_warc(spark, tmp_path):
    rows = [(3, "http://a/\r\nb", "x\r\n\r\nWARC/1.1\r\n\r\n"), (1, None, "same"), (2, "u", "same"), (2, "u", "same"), (5, "u", None), (4, "v", ""), (None, "w", "same"), (9, "é", "é" * 5000)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, payload int")
    got = warc.deduplicate(df, f"file://{tmp_path}/a").collect()
    assert len(got) == len(rows)
    pays = Counter((r.page_id, r.payload_digest, r.payload_bytes) for r in got)
    assert pays == Counter((p, base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode(), len((h or "").encode())) for p, _, h in rows)
    kinds = Counter((r.page_id, r.record_type, r.refers_to) for r in got)
    assert kinds == Counter([(3, "response", None), (1, "response", None), (2, "revisit", 1), (2, "revisit", 1), (5, "revisit", 4), (4, "response", None), (None, "revisit", 1), (9, "response", None)])
    assert {r.payload for r in got if r.record_type == "response"} == {h or "" for _, _, h in rows}
    big = warc.deduplicate(df, f"file://{tmp_path}/b", min_bytes=10_000).collect()
    assert all(r.record_type == "response" for r in big)
    assert warc.deduplicate(empty(df), f"file://{tmp_path}/c").count() == 0


def test_token_counts(docs):
    pieces = token_counts.load_pieces(f"{T}/piece_bpe_32k.model")
    known, most = {*pieces, *(bytes([i]) for i in range(256))}, max(map(len, pieces))

    def greedy(w):
        n = 0
        while w:
            k = next(k for k in range(min(most, len(w)), 0, -1) if w[:k] in known)
            w, n = w[k:], n + 1
        return n

    got = token_counts.count_tokens(docs, pieces)
    assert got.columns == [c for c in docs.columns if c != "n_words"] + ["n_words", "n_pieces", "n_bytes"]
    split = lambda t: re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())
    assert Counter((r.doc_id, r.n_words, r.n_pieces, r.n_bytes) for r in got.collect()) == Counter((i, len(split(t)), sum(greedy(token_counts.MARK + w) for w in split(t)), len((t or "").encode())) for i, t in TEXTS)
    rng = random.Random(1)
    small = token_counts.Automaton([b"a", b"ab", b"abcd", b"bcx", b"dd", b"ddd"])
    known, most = {b"a", b"ab", b"abcd", b"bcx", b"dd", b"ddd", *(bytes([i]) for i in range(256))}, 4
    for _ in range(500):
        w = bytes(rng.choice(b"abcdx") for _ in range(rng.randrange(14)))
        assert small.count(w) == greedy(w)
    assert token_counts.count_tokens(empty(docs), pieces).count() == 0


def test_packing(docs):
    from tokenizers import Tokenizer

    raw = open(f"{T}/byte_bpe_50k.json", encoding="utf-8").read()
    t = Tokenizer.from_str(raw)
    odd = ["it's 'S 'll'd ''s x's're 're", " 's", "a  b \n\n c  ", "\n's", "1²3 a1b2", "I'M I'm", "'", "x'", " \n\t x", "﷽ ß　　y", "a'veve'relx", "<|endoftext|>'s"]
    ids, off = packing.Encoder(raw).encode(pa.array(odd))
    assert [ids[a:b].tolist() for a, b in zip(off[:-1], off[1:], strict=True)] == [t.encode(x, add_special_tokens=False).ids for x in odd]
    got = packing.pack(docs, raw).collect()
    by, seq = defaultdict(list), defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
        seq[r.sequence_id].append(r)
    for i in {i for i, _ in TEXTS}:
        want = Counter()
        for j, x in TEXTS:
            if i == j:
                want.update((k, v) for k, v in enumerate([*t.encode(x or "", add_special_tokens=False).ids, 1]))
        assert Counter((r.start + k, v) for r in by[i] for k, v in enumerate(r.ids)) == want
    assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and len(r.ids) == r.length for r in got)
    for rows in seq.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048 and (at == rows[0].sequence_length or rows[0].sequence_length == 2048)
    step = Counter()
    for rows in seq.values():
        step[rows[0].step_group] += rows[0].sequence_length
    assert max(step.values()) <= packing.STEP_TOKENS
    tasks = Counter(g >> 33 for g in step)
    assert sum(n < packing.STEP_TOKENS for n in step.values()) <= len(tasks)  # all but the last of each task are full
    assert {g for g, n in step.items() if n < packing.STEP_TOKENS} <= {max(g for g in step if g >> 33 == k) for k in tasks}
    assert packing.pack(empty(docs), raw).count() == 0


def test_toxicity(spark, docs):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        w = [rng.choice(WORDS) for _ in range(20)] + (["idiot"] if bad else []) + (["gay"] if bad and i % 8 or i % 40 == 1 else [])
        rows.append((i, " ".join(w)))
        labels += [(i, int(bad))] if i % 50 else [(i, int(bad)), (i, None)]
    table, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels + [(None, 1)], "doc_id long, toxic int")
    gap = {}
    for penalty in (0.0, 20.0):
        model = toxicity.train(table, marks, penalty=penalty)
        got = {r.doc_id: r.toxic_score for r in toxicity.score(spark.createDataFrame([(1, "you gay alpha"), (2, "you straight alpha"), (3, "you idiot"), (4, None), (5, "")], "doc_id long, text string"), model).collect()}
        gap[penalty] = abs(got[1] - got[2])
        assert got[3] > 0.7 > 0.5 > got[2] and got[4] == got[5] < 0.7
    assert gap[20.0] < 0.2 * gap[0.0]
    out = toxicity.score(docs, model, prefix="")
    assert set(docs.columns) <= set(out.columns) and out.count() == len(TEXTS) and toxicity.score(empty(docs), model).count() == 0
    none = toxicity.train(table, empty(marks))
    assert {r.toxic_predicted for r in toxicity.score(table, none).collect()} <= {0, 1}


def test_exact(docs):
    for keep, pick in (("max", max), ("min", min)):
        got = exact_dedup.exact_groups(docs, keep=keep).collect()
        want = Counter()
        groups = defaultdict(list)
        for i, t in TEXTS:
            groups[low(t)].append(i)
        for i, t in TEXTS:
            g = groups[low(t)]
            best = None if keep == "min" and None in g else pick(x for x in g if x is not None) if any(x is not None for x in g) else None
            want[i, best, len(g), hashlib.sha256(low(t).encode()).hexdigest()] += 1
        assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
        assert Counter(r.text_sha256 for r in got if r.kept) == Counter({hashlib.sha256(t.encode()).hexdigest(): 1 for t in groups})
    stay = exact_dedup.deduplicated(docs)
    assert stay.columns == docs.columns and stay.count() == len(groups)
    assert exact_dedup.exact_groups(empty(docs)).count() == 0


@pytest.mark.parametrize("limit", [1 << 40, 5_000, 300])
def test_trie(limit):
    rng = random.Random(7)
    trie, want = exact_dedup.PatriciaTrie(max, limit), {}
    for n in range(800):
        key = bytes(rng.choice(b"ab") for _ in range(rng.randrange(12))) * rng.randrange(1, 9)
        trie.insert(key, n, 2)
        a, b = want.get(key, (n, 0))
        want[key] = (max(a, n), b + 2)
    got = list(trie.items())
    assert len(got) == len(want) and {k: (o, r) for k, o, r in got} == want


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as P

    passage = " ".join(f"q{i}" for i in range(14))
    rows = [(0, None, None), (1, "12 34", "en"), (2, BODY, "en"), (3, BODY.upper(), "en"), (4, NEAR, "en"), (5, f"quite another text {passage} and more of it", "en"), (6, "plain clean text about the house and the garden", "en"), (7, "ein anderer text über das haus und den garten", "de")]
    spark.createDataFrame([(*r, "s", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = P.run(spark, str(tmp_path))
    assert {r.doc_id for r in out.select("doc_id").distinct().collect()} == {3, 6, 7}
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in P.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns


def pipeline_stages(texts, bench):
    """Which rows each of the first four stages keeps, by plain Python; texts are told apart well enough for every word to count."""
    letters = [r for r in texts if any(c.isalpha() for c in r[1] or "")]
    by = defaultdict(list)
    for r in letters:
        by[low(r[1])].append(r)
    first = [max(g, key=lambda r: (r[0] is not None, r[0] or 0)) for g in by.values()]
    bags, jp = brute_links([r[1] for r in first])
    group = list(range(len(first)))
    for i in range(len(first)):
        for j in range(i):
            a, b = bags[i], bags[j]
            plain = max([*a.values(), *b.values(), 0]) == 1
            if a and b and (len(a & b) / len(a | b) if plain else jp(a, b)) >= 0.8:
                group = [group[j] if g == group[i] else g for g in group]
    near = [min((first[i] for i in range(len(first)) if group[i] == g), key=lambda r: (r[0] is None, r[0] or 0)) for g in {*group}]
    windows = {tuple(w[s : s + 10]) for w in map(words, bench) for s in range(max(1, len(w) - 9)) if w}
    holds = lambda w: any(tuple(w[s : s + len(x)]) == x for x in windows for s in range(len(w)))
    return letters, first, near, [r for r in near if not holds(words(r[1]))]


def test_pipeline_stages(spark, tmp_path):
    """Each stage on nulls, empty and long texts, ties, repeated rows, an empty table and clashing names, against plain Python."""
    import corpus_pipeline as P

    passage, long = " ".join(f"q{i}" for i in range(14)), " ".join(f"w{i}" for i in range(60_000))
    texts = [(0, None), (1, ""), (2, " 12 "), (3, BODY), (3, BODY), (4, BODY.upper()), (5, NEAR), (6, NEAR + " more"), (None, BODY), (None, "a text of a row without an id"), (7, f"one {passage} two"), (8, long), (8, long + " end"), (9, "the house and the garden"), (9, "das haus und der garten")]
    ddl = "doc_id long, text string, lang string, uid long, t string, row string, found_pred string, n_words long"
    docs = spark.createDataFrame([(i, t, "en" if i != 9 else "de", 5, "t", "r", "und", 1) for i, t in texts], ddl)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, passage), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, want = spark.read.parquet(f"{tmp_path}/documents.parquet"), pipeline_stages(texts, [passage])
    for (_, stage), rows in zip(P.STAGES, want, strict=False):
        out = P.written(stage(spark, docs, str(tmp_path)), "stage")
        assert out.columns == docs.columns and Counter((r.doc_id, r.text) for r in out.collect()) == Counter(rows)
        assert {(r.uid, r.t, r.row, r.found_pred, r.n_words) for r in out.collect()} <= {(5, "t", "r", "und", 1)}
        docs = out
    pieces = P.pack(spark, docs, str(tmp_path)).collect()
    assert Counter(r.doc_id for r in pieces if r.start == 0) == Counter(i for i, _ in want[3])
    assert {r.doc_id: r.doc_tokens for r in pieces if r.doc_id in (3, 8)}.keys() == {r[0] for r in want[3] if r[0] in (3, 8)}
    none = spark.createDataFrame([], ddl)
    for _, stage in P.STAGES:
        assert stage(spark, none, str(tmp_path)).count() == 0
