"""Readers and writers of page records, recognised segments, labels, metrics and audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BOX = "bbox array<double>"
PAGES = (
    "id bigint, image string, width int, height int, doc_type string, lang string, aug array<string>, text string, "
    "words array<struct<text:string,bbox:array<int>,start:int,end:int,label:string>>, "
    "entities array<struct<label:string,text:string,start:int,end:int,group:int,bbox:array<int>>>, "
    "visuals array<struct<label:string,bbox:array<int>>>, ood boolean, photo boolean, _corrupt_record string"
)
SEGMENTS = "id bigint, engine string, lang string, doc_type string, seconds double, sec double, segments array<struct<text:string,bbox:array<double>,score:double>>, error string, _corrupt_record string"
#: Class names in the order of label files.
CLASSES = ("FACE", "SIGNATURE", "QR_CODE", "STAMP")


def pages(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Page records, one JSON object a line; only the named columns are parsed. Broken lines have _corrupt_record."""
    schema = PAGES if columns is None else ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.createDataFrame([], PAGES).schema if f.name in columns)
    return spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)


def segments(spark: SparkSession, path: str) -> DataFrame:
    """Recognised segments of either layout: id, engine, seconds, segments, error. Of rows of one id in a file the last
    stands; rows with an error have no segments."""
    rows = spark.read.schema(SEGMENTS).json(path).withColumn("file", F.col("_metadata.file_path")).withColumn("at", F.col("_metadata.file_block_start") * F.lit(1 << 20) + F.monotonically_increasing_id())
    last = rows.withColumn("__r", F.row_number().over(Window.partitionBy("file", "id").orderBy(F.desc("at")))).where("__r = 1")
    failed = F.coalesce(F.col("error"), F.lit("")) != ""
    return last.select("id", "engine", F.coalesce("seconds", "sec").alias("seconds"), F.when(failed, F.array().cast("array<struct<text:string,bbox:array<double>,score:double>>")).otherwise(F.col("segments")).alias("segments"), "error")


def explode_segments(rows: DataFrame) -> DataFrame:
    """One row for each segment that is not blank: id, engine, ord, text, x0, y0, x1, y1, score."""
    s = rows.select("id", "engine", F.posexplode("segments").alias("ord", "s"))
    box = [F.get("s.bbox", F.lit(i)).alias(c) for i, c in enumerate(("x0", "y0", "x1", "y1"))]
    return s.where(F.trim("s.text") != "").select("id", "engine", F.col("ord").cast("long").alias("ord"), "s.text", *box, "s.score")


def yolo_labels(spark: SparkSession, path: str, width: float, height: float) -> DataFrame:
    """Label files: lines of five fields as boxes in pixels: file, label, x0, y0, x1, y1."""
    f = spark.read.text(path).select(F.col("_metadata.file_name").alias("file"), F.split(F.trim("value"), r"\s+").alias("f")).where(F.size("f") == 5)
    c, x, y, w, h = (F.get("f", F.lit(i)).cast("double") for i in range(5))
    names = F.array(*map(F.lit, CLASSES))
    return f.select("file", F.get(names, c.cast("int")).alias("label"), ((x - w / 2) * width).alias("x0"), ((y - h / 2) * height).alias("y0"), ((x + w / 2) * width).alias("x1"), ((y + h / 2) * height).alias("y1"))


def metrics_csv(spark: SparkSession, path: str) -> DataFrame:
    """A table of training metrics; names are trimmed, numbers are numbers, other cells null."""
    raw = spark.read.option("header", True).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path)
    return raw.select(*(F.expr(f"try_cast(trim(`{c}`) AS DOUBLE)").alias(c.strip()) for c in raw.columns))


def best_epoch(metrics: DataFrame, a: str = "metrics/mAP50(B)", b: str = "metrics/mAP50-95(B)") -> DataFrame:
    """The first epoch with the best 0.1 a + 0.9 b."""
    score = 0.1 * F.col(f"`{a}`") + 0.9 * F.col(f"`{b}`")
    return metrics.withColumn("fitness", score).orderBy(F.desc_nulls_last("fitness"), "epoch").limit(1)


def source_spec(spec: str, default: str) -> tuple[str, str, str, bool]:
    """name=DATA:OCR[:lines] or name=OCR: (name, data, ocr, lines)."""
    name, _, rest = spec.partition("=")
    parts = rest.split(":")
    lines = parts[-1] == "lines"
    parts = parts[:-1] if lines else parts
    return (name, parts[0], parts[1], lines) if len(parts) > 1 else (name, default, parts[0], lines)


def audit(regions: DataFrame, *keys: str) -> DataFrame:
    """The audit of a page: its regions, boxes to one decimal and scores to three, and no text at all."""
    box = F.array(*(F.round(c, 1) for c in ("x0", "y0", "x1", "y1")))
    entry = F.struct("ord", "kind", "label", box.alias("bbox"), F.round("score", 3).alias("score"), "source")
    held = regions.groupBy(*keys).agg(F.array_sort(F.collect_list(entry)).alias("r"))
    return held.select(*keys, F.transform("r", lambda x: F.struct(x["kind"].alias("kind"), x["label"].alias("label"), x["bbox"].alias("bbox"), x["score"].alias("score"), x["source"].alias("source"))).alias("regions"))


def append_new(rows: DataFrame, done: DataFrame | None, key: str, path: str) -> None:
    """Appends rows whose key is not done yet, as JSON lines."""
    (rows if done is None else rows.join(done.select(key), key, "left_anti")).write.mode("append").json(path)


def tsv_words(lines: DataFrame, *keys: str) -> DataFrame:
    """Words of a recogniser's table (column value: level, ..., left, top, width, height, confidence, text by tabs): lines
    of level 5, at least twelve fields and some text. Rows: keys, text, x0, y0, x1, y1, score."""
    f = F.split("value", "\t")
    number = lambda i: F.get("f", F.lit(i)).cast("int")
    rows = lines.select(*keys, f.alias("f")).where((F.size("f") >= 12) & (F.get("f", F.lit(0)) == "5") & (F.trim(F.get("f", F.lit(11))) != ""))
    return rows.select(*keys, F.get("f", F.lit(11)).alias("text"), number(6).alias("x0"), number(7).alias("y0"), (number(6) + number(8)).alias("x1"), (number(7) + number(9)).alias("y1"), (F.get("f", F.lit(10)).cast("double") / 100).alias("score"))


def words_of_blocks(blocks: Column) -> Column:
    """Words of nested blocks (paragraphs, lines, words), in order; null levels are empty."""
    none = lambda c, kind: F.coalesce(c, F.array().cast(kind))
    word = "struct<text:string,x0:double,y0:double,x1:double,y1:double,confidence:double>"
    line = f"array<struct<words:array<{word}>>>"
    par = f"array<struct<lines:{line}>>"
    pars = F.flatten(F.transform(none(blocks, f"array<struct<paragraphs:{par}>>"), lambda b: none(b["paragraphs"], par)))
    lines = F.flatten(F.transform(pars, lambda p: none(p["lines"], line)))
    words = F.flatten(F.transform(lines, lambda x: none(x["words"], f"array<{word}>")))
    return F.filter(words, lambda w: F.trim(w["text"]) != "")


def face_files(table: DataFrame, column: str, most: int) -> DataFrame:
    """Distinct image names of a list, sorted, up to a number of them."""
    names = table.select(F.trim(column).alias("name")).where(F.lower("name").rlike(r"\.(jpg|jpeg|png)\z"))
    return names.distinct().orderBy("name").limit(most)


def write_yolo(lines: DataFrame, path: str) -> None:
    """Label lines (split, file, line) as text, a folder for each split and file; a folder that is there is left alone."""
    lines.repartition("split", "file").select("split", "file", "line").write.mode("errorifexists").partitionBy("split", "file").text(path)
