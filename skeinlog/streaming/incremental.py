"""Incremental runs over a growing folder of transcripts: planning by modification time, an append-only ledger, and a file stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StringType, StructField, StructType

LEDGER = "session_id string, mtime timestamp, outcome string, threshold int, seq bigint"


def latest(ledger: DataFrame) -> DataFrame:
    """The last entry of each session."""
    last = ledger.groupBy("session_id").agg(F.max_by(F.struct("mtime", "outcome", "threshold"), "seq").alias("e"))
    return last.select("session_id", "e.*")


def plan(refs: DataFrame, pool: DataFrame, ledger: DataFrame, now, threshold: int, quiet_seconds: int, force: bool = False) -> DataFrame:
    """refs (session_id, project_dir, mtime) with class: the first that holds of

    meta: a folder of this tool's own runs; incremental: the pool has the session as of this file time or later; gate: it was gated
    under this threshold and hasn't grown; quiet: it changed too recently; else process. force leaves only meta.
    """
    p = pool.select(F.col("session_id"), F.col("mtime").alias("stamp"))
    entries = latest(ledger).select("session_id", F.col("mtime").alias("seen"), "outcome", "threshold")
    rows = refs.join(p, "session_id", "left").join(entries, "session_id", "left")
    meta = F.lower("project_dir").contains("insights") | F.lower("project_dir").contains("facet")
    if force:
        kind = F.when(meta, "meta").otherwise("process")
    else:
        gated = (F.col("outcome") == "gated") & (F.col("threshold") == threshold) & (F.col("seen") >= F.col("mtime"))
        quiet = F.col("mtime") > F.lit(now).cast("timestamp") - F.make_interval(secs=F.lit(quiet_seconds))
        kind = F.when(meta, "meta").when(F.col("stamp") >= F.col("mtime"), "incremental").when(gated, "gate").when(quiet, "quiet").otherwise("process")
    return rows.select(*refs.columns, kind.alias("class"))


def append(spark: SparkSession, path: str, rows: DataFrame) -> None:
    rows.write.mode("append").parquet(path)


def memo(keys: DataFrame, stored: DataFrame, key: str, compute: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(all results, new results): what `stored` has under its content's hash is taken from there, and only the rest is computed."""
    hits = keys.join(stored, key, "inner")
    fresh = compute(keys.join(stored.select(key), key, "left_anti"))
    return hits.unionByName(fresh.select(*hits.columns)), fresh


def stream_lines(spark: SparkSession, root: str) -> DataFrame:
    """New files of root as a stream of (path, raw)."""
    schema = StructType([StructField("value", StringType())])
    return spark.readStream.schema(schema).format("text").option("pathGlobFilter", "*.jsonl").load(f"{root}/*").select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("raw"))


def stream_counts(spark: SparkSession, root: str, out: str, checkpoint: str) -> StreamingQuery:
    """Counts lines by session and type into `out`, batch by batch; whatever is there when it starts is processed, then it ends.

    Each batch is written under its own number, so a batch that is tried again after a failure replaces itself."""
    rows = stream_lines(spark, root)
    kind = F.coalesce(F.get_json_object("raw", "$.type"), F.lit("malformed"))
    rows = rows.select(F.regexp_extract("path", r"([^/]+)\.jsonl$", 1).alias("session_id"), kind.alias("type")).where("session_id not like 'agent-%'")

    def write(batch: DataFrame, n: int) -> None:
        batch.groupBy("session_id", "type").agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{out}/batch={n}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_activity(events: DataFrame, late: str = "1 hour", width: str = "30 minutes") -> DataFrame:
    """Events of each type in windows of `width`; rows later than `late` behind the newest are left out. For streams and tables."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.approx_count_distinct("user_id").alias("users")).select(F.col("window.start").alias("start"), "event_type", "n", "users")
