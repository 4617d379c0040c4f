"""The rule finder over files as they arrive; each file is done once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators import rules, spans


def find_rules(stream: DataFrame, key: str, text: str = "text") -> DataFrame:
    """As in a batch: no state is kept."""
    return rules.find_rules(stream, key, text)


def windows_of(stream: DataFrame, key: str, n, size: int = 200, stride: int = 150) -> DataFrame:
    from pyspark.sql import functions as F

    return stream.select(key, F.explode(spans.windows(n, size, stride)).alias("w")).select(key, "w.*")


def run(spark: SparkSession, schema: str, source: str, target: str, checkpoint: str, key: str = "doc_id", max_files: int = 1000) -> StreamingQuery:
    """Finds rule spans in all Parquet files that are new since the last run, to Parquet, and ends; the checkpoint
    keeps what is done, so nothing is done twice or lost."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(source)
    return find_rules(stream, key).writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(target)
