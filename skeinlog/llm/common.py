"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words for the operators on white-space words.
SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a new local one where it is unset and the master is local."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="skeinlog-")
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def bounded_batches(spark: SparkSession) -> None:
    """Keeps the batches that go to Python small in bytes, since a text may be very long."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(1 << 24))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def drop(spark: SparkSession, *paths: str) -> None:
    for p in paths:
        try:
            _remove(spark, p)
        except Exception as e:  # the session may have ended; what is left lies in the shared folder only
            print(f"not removed: {p}: {e}")


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder; it is removed when the driver ends."""
    path = f"{shared_dir(spark)}/skein-{label}-{uuid.uuid4().hex}"
    atexit.register(lambda: spark.sparkContext._jsc and drop(spark, path))
    return path


def stored(df: DataFrame, label: str, compression: str = "snappy") -> tuple[DataFrame, str]:
    """df as a table in the shared folder, and its path, for drop() once no later step reads it."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a table in the shared folder: lineage is cut, and no executor's loss takes it away."""
    return stored(df, label)[0]


def without(df: DataFrame, *names: str) -> DataFrame:
    """df without the columns that an operator is about to add (names compare as Spark compares them)."""
    low = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in low])


def ascii_lower(c: Column) -> Column:
    """A-Z become a-z; nothing else changes."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def text_of(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def words_in(c: Column | str) -> Column:
    """The number of runs of other characters than SPACE; 0 for null."""
    bare = F.btrim(text_of(c), F.lit(SPACE))
    return F.when(bare == "", 0).otherwise(F.size(F.split(bare, f"[{SPACE}]+"))).cast("long")


def crc_mod(c: Column | str, m: int) -> Column:
    return F.crc32(F.encode(F.col(c).cast("string") if isinstance(c, str) else c.cast("string"), "UTF-8")) % m
