"""Chat formatting: prefix-target expansion, with DataFrame functions only.

Each assistant turn becomes an example of its own: all turns before it are the
context, its text alone is trainable. A conversation that does not end with an
assistant turn gives one more example without a target, so that no turn is lost.

Template of a turn: ``<|im_start|>role\\ntext<|im_end|>\\n``. Inside roles and
texts a backslash precedes every backslash and splits every ``<|``; in roles it
precedes a line end too. One left-to-right pass undoes that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
TARGET = "assistant"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def conversations(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row for each conversation: conv_id and segments, its rendered turns in order.

    Turns go by number (null first), then role, then text, so ties and repeated
    rows keep a defined order. Null roles and texts count as empty; rows with a
    null conversation form one conversation. Other columns are not read.
    """
    r = rows.select(F.col(conv).alias("conv_id"), F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")).alias("t"))
    head = lambda t: F.concat(F.lit(START), F.replace(escape(t["role"]), F.lit("\n"), F.lit("\\\n")), F.lit("\n"))
    segments = F.transform(F.array_sort(F.collect_list("t")), lambda t: F.struct((t["role"] == TARGET).alias("target"), head(t).alias("head"), escape(t["text"]).alias("body")))
    return r.groupBy("conv_id").agg(segments.alias("segments"))


def expand(rows: DataFrame, **columns: str) -> DataFrame:
    """The examples: conv_id, target_turn (its place from 0; null where nothing is trainable), is_last, text, loss_start
    and loss_chars (the mask, in characters from 0). Empty input gives no rows."""
    c = conversations(rows, **columns)
    n = F.size("segments")
    places = F.filter(F.transform("segments", lambda s, i: F.when(s["target"], i)), lambda i: i.isNotNull())
    open_end = F.when(F.element_at("segments", -1)["target"], F.array().cast("array<int>")).otherwise(F.array(n))
    e = c.withColumn("target_at", F.explode(F.concat(places, open_end)))
    whole = lambda part: F.array_join(F.transform(part, lambda s: F.concat(s["head"], s["body"], F.lit(END + "\n"))), "")
    has = F.col("target_at") < n
    context = whole(F.slice("segments", 1, F.col("target_at")))
    own = F.get("segments", F.col("target_at"))
    return e.select(
        "conv_id",
        F.when(has, F.col("target_at")).alias("target_turn"),
        (F.col("target_at") >= n - 1).alias("is_last"),
        F.when(has, F.concat(context, own["head"], own["body"], F.lit(END + "\n"))).otherwise(context).alias("text"),
        F.when(has, F.length(context) + F.length(own["head"])).otherwise(0).cast("long").alias("loss_start"),
        F.when(has, F.length(own["body"])).otherwise(0).cast("long").alias("loss_chars"),
    )


def parse(text: Column) -> Column:
    """The turns of a formatted text as array of (role, text), unescaped."""
    parts = F.filter(F.split(text, r"<\|im_end\|>\n(?=<\|im_start\|>|\z)"), lambda p: p != "")

    def turn(p: Column) -> Column:
        role = F.regexp_extract(p, r"(?s)\A<\|im_start\|>((?:[^\\\n]|\\.)*)\n", 1)
        return F.struct(unescape(role).alias("role"), unescape(F.substr(p, F.length(role) + len(START) + 2)).alias("text"))

    return F.transform(parts, turn)


def digest(examples: DataFrame) -> DataFrame:
    """Reads examples back, one row for each conversation: the contract's columns.

    The loss text is cut from each example by its mask; the turns are parsed from
    the last example, which holds the whole conversation.
    """
    loss = F.struct("target_turn", unescape(F.substr(F.col("text"), F.col("loss_start").cast("int") + 1, F.col("loss_chars").cast("int"))).alias("t"))
    g = examples.groupBy("conv_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("target_turn").isNotNull(), loss))), lambda s: s["t"]), "").alias("loss"),
        F.max(F.when(F.col("is_last"), F.col("text"))).alias("whole"),
        F.count("target_turn").alias("n_examples"),
    )
    g = g.withColumn("turns", parse(F.col("whole")))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return g.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("whole").cast("long").alias("formatted_chars"),
        F.col("n_examples").cast("long").alias("n_examples"),
    )
