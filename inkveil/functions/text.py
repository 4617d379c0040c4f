"""Text functions as Spark columns. Offsets are code points, half-open."""

from __future__ import annotations

import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType

#: White space as Python's str.split sees it, inside a character class.
WS = r"\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WORD = r"\p{L}\p{N}_"
CONTENT = r"\p{L}\p{M}\p{N}"
TOKEN = rf"[{WORD}]+(?:[-_][{WORD}]+)*|[^{WS}]"

_digits = [(chr(i), str(unicodedata.digit(chr(i)))) for i in range(128, sys.maxunicode + 1) if chr(i).isdigit()]
_FROM, _TO = ("".join(x) for x in zip(*_digits, strict=True))
#: Indic digit blocks that norm folds: Devanagari, Bengali, Tamil, Telugu, Kannada.
_INDIC = [chr(start + d) for start in (0x966, 0x9E6, 0xBE6, 0xC66, 0xCE6) for d in range(10)]


def ascii_digits(text: Column) -> Column:
    """Digits of any script as ASCII digits; the length stays."""
    return F.translate(text, _FROM, _TO)


@F.udf(StringType(), useArrow=True)
def _nfc(text):
    return None if text is None else unicodedata.normalize("NFC", text)


def nfc(text: Column) -> Column:
    """Canonical composition; texts of ASCII alone never leave the JVM's value."""
    return F.when(text.rlike(r"^\p{ASCII}*$"), text).otherwise(_nfc(text))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^[{WS}]+|[{WS}]+$", "")


def norm(text: Column) -> Column:
    """NFC, without zero-width characters, Indic digits as ASCII, white space collapsed and stripped."""
    folded = F.translate(F.regexp_replace(nfc(text), r"[\x{200b}\x{200c}\x{200d}\x{feff}]", ""), "".join(_INDIC), "0123456789" * 5)
    return F.trim(F.regexp_replace(folded, f"[{WS}]+", " "))


_cases = [(c, c.casefold()) for c in map(chr, range(sys.maxunicode + 1)) if c.casefold() != c]
_ONE = [(c, f) for c, f in _cases if len(f) == 1]
_MANY = [(c, f) for c, f in _cases if len(f) > 1]


def fold(text: Column) -> Column:
    """Full case folding by the Unicode tables, character by character; texts of ASCII alone are put in lower case."""
    wide = F.translate(text, "".join(c for c, _ in _ONE), "".join(f for _, f in _ONE))
    long = wide
    for c, f in _MANY:
        long = F.replace(long, F.lit(c), F.lit(f))
    return F.when(text.rlike(r"^\p{ASCII}*\z"), F.lower(text)).when(text.rlike("[" + "".join(c for c, _ in _MANY) + "]"), long).otherwise(wide)


def loose(text: Column) -> Column:
    """Letters, marks and numbers of norm(text), folded."""
    return fold(F.regexp_replace(norm(text), f"[^{CONTENT}]", ""))


def squash(text: Column) -> Column:
    return F.regexp_replace(norm(text), f"[{WS}]+", "")


def find_all(text: Column, pattern: str) -> Column:
    """array<struct<start,end,text>> of all matches, by lengths of matches and of what lies between them. An array that
    grows is copied at each step, so matches are placed in blocks of about the root of their number, then the blocks."""
    found = F.regexp_extract_all(text, F.lit(pattern), 0)
    between = F.split(text, pattern, -1)
    pairs = F.arrays_zip(found.alias("m"), F.slice(between, 1, F.size(found)).alias("g"))

    def blocks(held):
        wide = F.greatest(F.ceil(F.sqrt(F.size(held))).cast("int"), F.lit(1))
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(held) - 1) / wide).cast("int")), lambda b: F.slice(held, b * wide + 1, wide))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,text:string>>").alias("out"))

    def step(acc, p):
        start = acc["at"] + F.length(p["g"])
        end = start + F.length(p["m"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), end.alias("end"), p["m"].alias("text")))).alias("out"))

    def put(acc, b):
        moved = F.transform(b["out"], lambda m: F.struct((m["start"] + acc["at"]).alias("start"), (m["end"] + acc["at"]).alias("end"), m["text"].alias("text")))
        return F.struct((acc["at"] + b["at"]).alias("at"), F.concat(acc["out"], F.array(moved)).alias("out"))

    bound = F.get(F.transform(F.array(pairs), lambda p: F.when(F.size(p) > 64, blocks(p)).otherwise(F.array(p))), F.lit(0))  # a name for pairs: else each block would search again
    placed = F.transform(bound, lambda b: F.aggregate(b, zero, step))
    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<struct<start:int,end:int,text:string>>>").alias("out"))
    return F.aggregate(placed, first, put, lambda a: F.flatten(a["out"]))


def tokens(text: Column) -> Column:
    """Words (with inner hyphens) and single other characters, with offsets."""
    return find_all(text, TOKEN)


def recall_tokens(text: Column) -> Column:
    """White-space words of norm(text) without outer non-word characters, folded, none empty."""
    words = F.split(norm(text), " ")
    return F.filter(F.transform(words, lambda w: fold(F.regexp_replace(w, f"^[^{WORD}]+|[^{WORD}]+$", ""))), lambda w: w != "")


def content_count(text: Column) -> Column:
    return F.length(F.regexp_replace(text, f"[^{CONTENT}]", ""))


def script_of(text: Column) -> Column:
    first = F.regexp_extract(text, r"[\x{0900}-\x{097F}\x{0C80}-\x{0CFF}]", 0)
    return F.when(first == "", "latin").when(first < "ঀ", "devanagari").otherwise("kannada")


def cer(ref: Column, hyp: Column) -> Column:
    """Edit distance by length of the reference; an empty reference gives 0 or 1."""
    a, b = norm(ref), norm(hyp)
    return F.when(a == "", F.when(b == "", 0.0).otherwise(1.0)).otherwise(F.levenshtein(a, b) / F.length(a))


@F.udf(IntegerType(), useArrow=True)
def substring_distance(needle, hay):
    """Least edits from needle to any substring of hay (null if either is)."""
    if needle is None or hay is None:
        return None
    row = list(range(len(needle) + 1))
    best = row[-1]
    for c in hay:
        new = [0]
        for i, n in enumerate(needle, 1):
            new.append(min(row[i] + 1, new[-1] + 1, row[i - 1] + (n != c)))
        row = new
        best = min(best, row[-1])
    return best


def indian_grouping(number: Column) -> Column:
    """12,34,567."""
    s = number.cast("string")
    head = F.regexp_replace(F.substr(s, F.lit(1), F.length(s) - 3), r"(?<=\d)(?=(\d{2})+$)", ",")
    return F.when(F.length(s) <= 3, s).otherwise(F.concat(head, F.lit(","), F.right(s, F.lit(3))))


def ordinal(n: Column) -> Column:
    teen = (n % 100).between(11, 13)
    return F.concat(n.cast("string"), F.when(teen, "th").when(n % 10 == 1, "st").when(n % 10 == 2, "nd").when(n % 10 == 3, "rd").otherwise("th"))


def masked_end(text: Column) -> Column:
    """Where a bar ends that leaves the last four digits; all of it when there are fewer."""
    d = ascii_digits(text)
    return F.when(d.rlike("([0-9][^0-9]*){4}$"), F.length(F.regexp_extract(d, "(?s)^(.*?)[^0-9]*((?:[0-9][^0-9]*){4})$", 1))).otherwise(F.length(text))


def review_key(text: Column) -> Column:
    return F.regexp_replace(F.lower(ascii_digits(text)), r"[\s\-.,:;]+", "")


def safe_filename(text: Column) -> Column:
    return F.regexp_replace(text, r"[^A-Za-z0-9._-]+", "_")


def percent(value: Column) -> Column:
    return F.when(value.isNull(), "–").otherwise(F.format_string("%.1f%%", value * 100))


@F.udf(DoubleType(), useArrow=True)
def python_round(value, digits):
    """Rounding of the exact binary value, ties to even."""
    return None if value is None else round(value, digits)


def is_punct(text: Column) -> Column:
    """Whether all characters are punctuation or symbols; true for an empty text."""
    return text.rlike(r"^[\p{P}\p{S}]*\z")


def snapped(text: Column, start: Column, end: Column) -> list[Column]:
    """A span grown to whole white-space words."""
    left = F.regexp_extract(F.substr(text, F.lit(1), start), rf"[^{WS}]*\z", 0)
    right = F.regexp_extract(F.substr(text, end + 1), f"^[^{WS}]*", 0)
    return [start - F.length(left), end + F.length(right)]


def trim_outer(value: Column, true: Column) -> list[Column]:
    """A value without the outer punctuation that the true value does not have at the same edge: (characters dropped
    before it, value)."""
    openers = F.replace(F.lit("([{\"'"), F.left(true, F.lit(1)), F.lit(""))
    tail = F.rtrim(value, F.replace(F.lit(",;:)]}\"'"), F.right(true, F.lit(1)), F.lit("")))
    head = F.ltrim(tail, openers)
    bare = F.when(F.endswith(head, F.lit(".")) & ~F.endswith(true, F.lit(".")), F.left(head, F.length(head) - 1)).otherwise(head)
    return [F.length(tail) - F.length(head), bare]
