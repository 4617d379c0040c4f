"""Functions for SQL sessions."""

from __future__ import annotations

from pyspark.sql import SparkSession

from . import text


def register(spark: SparkSession) -> list[str]:
    """Registers what Spark's SQL lacks: python_round(x, n), substring_distance(needle, hay), nfc(text)."""
    functions = {"python_round": text.python_round, "substring_distance": text.substring_distance, "nfc": text._nfc}
    for name, f in functions.items():
        spark.udf.register(name, f)
    return list(functions)
