"""What the operators share: the scratch folder, written tables, hash remainders."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_written: list[tuple[SparkSession, str]] = []
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a temporary one if all runs on this
    machine, as in tests; on a cluster that is an error."""
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir") or spark.conf.get("inkveil.scratch.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="inkveil-")
        spark.conf.set("inkveil.scratch.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is written there goes when the driver ends."""
    path = f"{shared_dir(spark)}/inkveil-{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


@contextlib.contextmanager
def _shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is run inside go when it has run, not when the driver happens to collect its garbage."""
    was = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if was is None else spark.conf.set(_CLEANUP, was)


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder: cuts the lineage and outlives executors. Its shuffle files are removed."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with _shuffles_removed(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def mark() -> int:
    return len(_written)


def since(place: int) -> list[tuple[SparkSession, str]]:
    """The tables written since that mark."""
    return _written[place:]


def free(tables: list[tuple[SparkSession, str]], *keep: DataFrame) -> None:
    """Removes these tables but those that one of keep reads."""
    used = "".join(x for df in keep for x in df.inputFiles()) if tables else ""
    for entry in tables:
        if entry[1].rpartition("/")[2] not in used and entry in _written:
            discard(*entry)
            _written.remove(entry)


def discard(spark: SparkSession, path: str) -> None:
    """Removes a scratch table."""
    with contextlib.suppress(Exception):
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        with contextlib.suppress(Exception):
            if spark.sparkContext._jsc is not None:
                discard(spark, path)


def extended(schema: StructType, ddl: str) -> StructType:
    """The schema with more columns behind it."""
    return StructType([*schema.fields, *StructType.fromDDL(ddl).fields])


def remainder(column: Column, by: int) -> Column:
    """crc32 of the value as text, modulo by; null counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")), F.lit(by)).cast("int")
