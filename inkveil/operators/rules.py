"""Rules for identifiers: patterns, checks, greedy choice, context filters, masking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.checksums import gstin_check, verhoeff_valid

_L, _R = "(?<![A-Za-z0-9])", "(?![A-Za-z0-9])"
#: Labels and patterns in order of priority.
RULES = (
    ("ABHA", _L + r"\d{2}-\d{4}-\d{4}-\d{4}" + _R),
    ("AADHAAR", _L + r"[2-9]\d{3}[ -]?\d{4}[ -]?\d{4}" + _R),
    ("GSTIN", _L + r"\d{2}[A-Z]{5}\d{4}[A-Z][1-9A-Z]Z[0-9A-Z]" + _R),
    ("PAN", _L + r"[A-Z]{3}[ABCFGHLJPT][A-Z]\d{4}[A-Z]" + _R),
    ("IFSC", _L + r"[A-Z]{4}0[A-Z0-9]{6}" + _R),
    ("EMAIL", _L + r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+" + _R),
    ("UPI_ID", _L + r"[A-Za-z0-9._-]{2,}@[A-Za-z]{2,}(?![A-Za-z0-9.])"),
    ("PHONE", r"(?:\+91[ -]?)?" + _L + r"[6-9]\d{4}[ -]?\d{5}" + _R),
    ("VOTER_ID", _L + r"[A-Z]{3}\d{7}" + _R),
    ("PASSPORT", _L + r"[A-PR-WYZ][1-9]\d{6}" + _R),
    ("UAN", _L + r"10\d{10}" + _R),
    ("VEHICLE_REG", _L + r"[A-Z]{2}[ -]?\d{1,2}[ -]?[A-Z]{1,2}[ -]?\d{4}" + _R),
)
#: Words before a date of birth and before an unspaced Aadhaar number, birth words in three languages.
BIRTH_WORDS = ("birth", "dob", "d.o.b", "born", "जन्म", "ಜನ್ಮ")
AADHAAR_WORDS = ("aadhaar", "aadhar", "adhaar", "uid", "आधार", "ಆಧಾರ")
GENDER_LABELS = r"(?iu)(?<![\p{L}\p{M}])(?:gender|sex|लिंग|ಲಿಂಗ)(?![\p{L}\p{M}])"
GENDER_VALUES = r"(?iu)(?<![\p{L}\p{M}])(?:transgender|female|male|other|m|f|t|पुरुष|महिला|स्त्री|अन्य|ಪುರುಷ|ಮಹಿಳೆ|ಸ್ತ್ರೀ|ಇತರೆ)(?![\p{L}\p{M}])"
BEFORE = 60

SPAN = "struct<start:int,end:int,ord:int,label:string,text:string>"


def pattern(label: str) -> str:
    return dict(RULES)[label]


def matches(text: Column, label: str) -> Column:
    """Matches of one rule that pass its check; a match that fails still uses up its text."""
    found = T.find_all(T.ascii_digits(text), pattern(label))
    if label == "AADHAAR":
        found = F.filter(found, lambda m: verhoeff_valid(m["text"]))
    if label == "GSTIN":
        found = F.filter(found, lambda m: gstin_check(F.left(m["text"], F.lit(14))) == F.right(m["text"], F.lit(1)))
    return found


def candidates(text: Column) -> Column:
    """All matches of all rules, unsorted."""
    def tagged(i: int, label: str) -> Column:
        return F.transform(matches(text, label), lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.lit(i).alias("ord"), F.lit(label).alias("label"), m["text"].alias("text")))

    return F.flatten(F.array(*(tagged(i, label) for i, (label, _) in enumerate(RULES))))


def greedy(found: Column) -> Column:
    """Spans in order of start, then length (long first), then rule, each kept if it begins at or after the last kept end."""
    order = F.array_sort(F.transform(found, lambda m: F.struct(m["start"].alias("start"), (m["start"] - m["end"]).alias("len"), m["ord"].alias("ord"), m["end"].alias("end"), m["label"].alias("label"), m["text"].alias("text"))))
    zero = F.struct(F.lit(0).alias("last"), F.array().cast(f"array<{SPAN}>").alias("out"))

    def step(acc, m):
        row = F.struct(m["start"].alias("start"), m["end"].alias("end"), m["ord"].alias("ord"), m["label"].alias("label"), m["text"].alias("text"))
        return F.when(m["start"] >= acc["last"], F.struct(m["end"].alias("last"), F.concat(acc["out"], F.array(row)).alias("out"))).otherwise(acc)

    return F.aggregate(order, zero, step, lambda a: a["out"])


def find_rules(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, label, start, end, value, score) of all rule spans; score is 1. Null texts have none.

    A text without an at sign or digit holds no identifier, so it is not searched.
    """
    rows = docs.where(F.col(text).rlike(r"[@\p{N}]"))
    found = rows.select(key, F.explode(greedy(candidates(F.col(text)))).alias("s"))
    return found.select(key, F.col("s.label").alias("label"), F.col("s.start").alias("start"), F.col("s.end").alias("end"), F.col("s.text").alias("value"), F.lit(1.0).alias("score"))


def redact(docs: DataFrame, key: str, text: str = "text", mask: str = "█") -> DataFrame:
    """(key, redacted, n_spans): each rule span's characters become the mask; length stays."""
    spans = greedy(candidates(F.col(text)))
    marked = docs.select(key, F.col(text).alias("t"), F.when(F.col(text).rlike(r"[@\p{N}]"), spans).otherwise(F.array().cast(f"array<{SPAN}>")).alias("s"))
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc, m):
        kept = F.substr(F.col("t"), acc["at"] + 1, m["start"] - acc["at"])
        return F.struct(m["end"].alias("at"), F.concat(acc["out"], kept, F.repeat(F.lit(mask), m["end"] - m["start"])).alias("out"))

    done = F.aggregate("s", zero, step, lambda a: F.concat(a["out"], F.substr(F.col("t"), a["at"] + 1, F.length("t"))))
    return marked.select(key, done.alias("redacted"), F.size("s").alias("n_spans"))


def before(text: Column, start: Column) -> Column:
    """What stands before a span on its line, at most 60 characters, in lower case."""
    return F.lower(F.right(F.substring_index(F.substr(text, F.lit(1), start), "\n", -1), F.lit(BEFORE)))


def cuts_number(text: Column, start: Column, end: Column) -> Column:
    """Whether a span begins or ends inside a number (digits joined by nothing, a comma or a point)."""
    part = lambda at: F.substr(text, F.greatest(at, F.lit(0)) + 1, F.lit(3))
    left = F.when(start >= 2, part(start - 2)).otherwise(F.substr(text, F.lit(1), start + 1))
    return ((start > 0) & left.rlike(r"[0-9][,.]?[0-9]$")) | part(end - 1).rlike(r"^[0-9]([0-9]|[,.][0-9])")


def context_keep(text: Column, label: Column, start: Column, end: Column, value: Column, rules: tuple[str, ...] = ("cut", "dob", "aadhaar")) -> Column:
    """Whether the context rules keep a span."""
    d, ahead = T.ascii_digits(text), before(text, start)
    any_of = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(ahead, w))
    drop = F.lit(False)
    if "cut" in rules:
        drop |= cuts_number(d, start, end)
    if "dob" in rules:
        drop |= (label == "DOB") & ~any_of(BIRTH_WORDS)
    if "aadhaar" in rules:
        drop |= (label == "AADHAAR") & T.ascii_digits(value).rlike("^[0-9]{12}$") & ~any_of(AADHAAR_WORDS)
    return ~drop


def gender_spans(text: Column) -> Column:
    """Values within 40 characters after a gender label, on its line, once by start."""

    def values(m):
        rest = F.substring_index(F.substr(text, m["end"] + 1, F.lit(40)), "\n", 1)
        return F.transform(T.find_all(rest, GENDER_VALUES), lambda v: F.struct((m["end"] + v["start"]).alias("start"), (m["end"] + v["end"]).alias("end"), v["text"].alias("text")))

    return F.array_sort(F.array_distinct(F.flatten(F.transform(T.find_all(text, GENDER_LABELS), values))))
