"""Derived inputs in SQL that both Spark and the oracle run, by arithmetic on the given tables alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _letter(e: str) -> str:
    return f"chr(CAST(65 + ({e}) % 26 AS INT))"


def _digits(e: str, n: int) -> str:
    return f"lpad(CAST(({e}) % {10**n} AS STRING), {n}, '0')"


_k = "c_custkey"
#: Texts with identifiers of all rules, valid and not, and lines for the context rules.
IDS = f"""SELECT {_k} AS id, concat(
 'Aadhaar ', CAST(2000 + {_k} * 37 % 7000 AS STRING), CASE WHEN {_k} % 3 = 0 THEN '' WHEN {_k} % 3 = 1 THEN ' ' ELSE '-' END, {_digits(_k + " * 7919", 4)}, CASE WHEN {_k} % 3 = 0 THEN '' ELSE ' ' END, {_digits(_k + " * 13", 4)}, '.', chr(10),
 'PAN ', {_letter(_k)}, {_letter(_k + " * 3")}, {_letter(_k + " * 7")}, substr('ABCFGHLJPT', CAST({_k} % 10 + 1 AS INT), 1), {_letter(_k + " * 5")}, {_digits(_k + " * 17", 4)}, {_letter(_k + " * 11")}, '; ',
 'GSTIN ', {_digits(_k, 2)}, {_letter(_k)}, {_letter(_k + " * 2")}, {_letter(_k + " * 3")}, {_letter(_k + " * 4")}, {_letter(_k + " * 5")}, {_digits(_k + " * 19", 4)}, {_letter(_k + " * 9")}, '1Z', substr('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', CAST({_k} * 5 % 36 + 1 AS INT), 1), chr(10),
 'IFSC SBIN0', {_digits(_k + " * 23", 6)}, ' mail user', CAST({_k} AS STRING), '@mail.example.com UPI name', CAST({_k} AS STRING), '@okaxis and ',
 CASE WHEN {_k} % 4 = 0 THEN '+91 ' WHEN {_k} % 4 = 1 THEN '+91' WHEN {_k} % 4 = 2 THEN '+91-' ELSE '' END, '9', {_digits(_k + " * 29", 4)}, CASE WHEN {_k} % 2 = 0 THEN ' ' ELSE '' END, {_digits(_k + " * 31", 5)}, chr(10),
 'Voter ', {_letter(_k)}, {_letter(_k + " * 2")}, {_letter(_k + " * 3")}, {_digits(_k + " * 101", 7)}, ' passport ', {_letter(_k)}, CAST({_k} % 9 + 1 AS STRING), {_digits(_k + " * 103", 6)}, ' UAN 10', {_digits(_k + " * 107", 10)}, chr(10),
 'Car ', {_letter(_k)}, {_letter(_k + " * 3")}, ' ', {_digits(_k, 2)}, ' ', {_letter(_k + " * 7")}, ' ', {_digits(_k + " * 41", 4)}, ' ABHA ', {_digits(_k, 2)}, '-', {_digits(_k + " * 43", 4)}, '-', {_digits(_k + " * 47", 4)}, '-', {_digits(_k + " * 53", 4)},
 ' total 1,', {_digits(_k, 3)}, '.', {_digits(_k + " * 59", 2)}, chr(10), CASE WHEN {_k} % 3 = 0 THEN 'Gender: Female' WHEN {_k} % 3 = 1 THEN 'Sex M / other' ELSE 'no such line' END) AS text
FROM {{customer}}"""

#: Boxes on pages: order as page, line as place.
BOXES = """SELECT l_orderkey AS page, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_discount, l_tax, l_extendedprice) AS BIGINT) AS ord, concat('L', CAST(l_linenumber % 3 AS STRING)) AS label, CASE WHEN l_linenumber % 5 = 0 THEN 'visual' ELSE 'text' END AS kind,
 CAST(l_partkey * 7 % 300 AS DOUBLE) AS x0, CAST(l_suppkey * 13 % 60 AS DOUBLE) AS y0, CAST(l_partkey * 7 % 300 + 20 + l_quantity AS DOUBLE) AS x1, CAST(l_suppkey * 13 % 60 + 10 + l_quantity / 5 AS DOUBLE) AS y1, l_discount * 5 + l_linenumber / 100.0 AS score
FROM {lineitem}"""

#: Truths near the boxes: every other box, moved a little.
TRUTHS = """SELECT l_orderkey AS page, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_discount, l_tax, l_extendedprice) AS BIGINT) AS ord, concat('L', CAST(l_linenumber % 3 AS STRING)) AS label,
 CAST(l_partkey * 7 % 300 + l_linenumber AS DOUBLE) AS x0, CAST(l_suppkey * 13 % 60 + l_partkey % 4 AS DOUBLE) AS y0, CAST(l_partkey * 7 % 300 + 25 + l_quantity AS DOUBLE) AS x1, CAST(l_suppkey * 13 % 60 + 12 + l_quantity / 5 AS DOUBLE) AS y1
FROM {lineitem} WHERE l_linenumber % 2 = 1"""

#: Spans of two predictors over one text.
SPANS = """SELECT l_orderkey AS page, CASE WHEN l_suppkey % 2 = 0 THEN 'a' ELSE 'b' END AS source, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_discount, l_tax, l_extendedprice) AS BIGINT) AS ord, concat('L', CAST(l_linenumber % 2 AS STRING)) AS label,
 CAST(l_partkey % 40 AS INT) AS start, CAST(l_partkey % 40 + 1 + l_suppkey % 12 AS INT) AS "end", l_tax * 10 + 0.05 AS score
FROM {lineitem}"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table. Text, and customers (of whom long texts are made), in few scan partitions (some of them empty, where a file
    has few row groups) is dealt over all cores; large tables have more, and stay."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if name in ("documents", "pages", "customer") and df.rdd.getNumPartitions() <= 2 * cores else df


def fixture(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    names = [n for n in ("customer", "lineitem") if "{" + n + "}" in sql]
    return spark.sql(sql.replace('"end"', "`end`"), **{n: table(spark, sf_dir, n) for n in names})


def oracle(sql: str) -> str:
    return sql.replace("{customer}", "customer").replace("{lineitem}", "lineitem")
