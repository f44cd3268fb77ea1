"""A stateful loop over a growing folder of transcripts.

Each step lists the folder and logs what is new or has grown; a stream reads that log together with the ledger of outcomes, and keeps
a state for each session: its newest file, the file times under which it was analysed or gated, and its failures in a row. A timer
makes a session due once its file has been quiet for long enough. Due sessions are analysed, their analyses merged into the pool, and
their outcomes appended to the ledger, where the next step's stream finds them. plan() says the same of the same tables in one batch.

State, log positions and timers are in the stream's checkpoint. A step that was killed runs its batch again: the pool's merge and the
ledger's folder of that batch take the place of what the first try wrote.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from skeinlog.functions.classify import substantial
from skeinlog.operators import judge, keyed
from skeinlog.operators.facts import corpora, session_facts
from skeinlog.operators.reduce import reduced
from skeinlog.operators.scoring import valid_quotes
from skeinlog.sources import transcripts
from skeinlog.sources.state import exists

REFS = "session_id string, path string, project_dir string, mtime timestamp, bytes bigint"
OUTCOMES = "session_id string, mtime timestamp, outcome string, threshold int, error string"
DUE = "session_id string, path string, project_dir string, mtime timestamp"
#: What an analysis keeps of what was judged, and of the session's facts.
JUDGED = tuple(c for c in judge.FIELDS if c != "error")
FACTS = (
    "project_dir", "cwd", "start", "assistant_turns", "user_turns", "interrupts", "rejections", "tool_errors", "skills", "tool_counts",
    "mechanical_friction", "mechanical_exemplars", "other_error_signatures", "directive_clauses",
)
#: A row that is in each step's log, so that timers are looked at even if nothing has changed.
TICK = ""
STATE = "path string, project_dir string, mtime bigint, stamp bigint, gated bigint, threshold int, failures int, timer bigint"
#: The number of the batch that a file of the ledger is of; null for the empty one that it begins with.
BATCH = r"try_cast(regexp_extract(_metadata.file_path, '/batch=(\\d+)/', 1) as bigint)"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@dataclass(frozen=True)
class Options:
    """threshold: assistant turns that make a session substantial; quiet_seconds: for how long a file must not have changed; failures:
    so many failures in a row park a session until its file grows."""

    threshold: int = 5
    quiet_seconds: int = 900
    failures: int = 3


class Sessions(StatefulProcessor):
    """The state of a session, and when it is due. Times are microseconds, a timer's are milliseconds."""

    def __init__(self, options: Options) -> None:
        self.options = options

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("session", STATE)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        if key[0] == TICK:
            return
        path, project, mtime, stamp, gated, threshold, failures, timer = self.state.get() if self.state.exists() else (None, None, -1, -1, -1, -1, 0, -1)
        outcomes = []
        for pdf in rows:
            for r in pdf.itertuples(index=False):
                if r.kind != "ref":
                    outcomes.append((r.at, r.seq, r.kind, r.threshold))
                elif r.at > mtime or (r.at == mtime and r.path < path):
                    failures = 0 if r.at > mtime else failures
                    path, project, mtime = r.path, r.project_dir, r.at
        for at, _, kind, least in sorted(outcomes):  # after files, so that a failure counts against the file it was of
            if kind == "analysed":
                stamp = max(stamp, at)
            if kind == "gated":
                gated, threshold = at, least
            if at == mtime:
                failures = failures + 1 if kind == "errored" else 0
        o = self.options
        done = stamp >= mtime or (threshold == o.threshold and gated >= mtime) or failures >= o.failures
        meta = "insights" in project.lower() or "facet" in project.lower() if project else False
        due = -1 if done or meta or mtime < 0 else max(mtime // 1000 + o.quiet_seconds * 1000, timerValues.getCurrentProcessingTimeInMs())
        if timer >= 0:
            self.handle.deleteTimer(timer)
        if due >= 0:
            self.handle.registerTimer(due)
        self.state.update((path, project, mtime, stamp, gated, threshold, failures, due))
        yield from ()

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        path, project, mtime, *rest, _ = self.state.get()
        self.state.update((path, project, mtime, *rest, -1))
        yield pd.DataFrame({"session_id": [key[0]], "path": [path], "project_dir": [project], "mtime": [pd.Timestamp(mtime, unit="us")]})

    def close(self) -> None:
        pass


def poll(spark: SparkSession, root: str, store: str) -> None:
    """Appends to the log of refs the files that are new or have another time than in the log, and a tick."""
    listed = transcripts.refs(spark, root).select("session_id", "path", "project_dir", "mtime", "bytes")
    if exists(spark, f"{store}/refs"):
        listed = listed.join(spark.read.schema(REFS).parquet(f"{store}/refs").select("path", "mtime"), ["path", "mtime"], "left_anti")
    tick = spark.createDataFrame([(TICK, TICK, TICK, None, 0)], REFS)
    listed.select(*StructType.fromDDL(REFS).names).unionByName(tick).write.mode("append").parquet(f"{store}/refs")


def ledger(spark: SparkSession, store: str) -> DataFrame:
    """The outcomes of all steps, with seq: later steps have higher ones."""
    if not exists(spark, f"{store}/ledger"):
        return spark.createDataFrame([], OUTCOMES + ", seq bigint")
    return spark.read.schema(OUTCOMES).parquet(f"{store}/ledger/*").withColumn("seq", F.expr(BATCH))


def quoted(analyses: DataFrame, decoded: DataFrame) -> DataFrame:
    """analyses whose quotes are held against what was said: a friction's that isn't there is cleared and flagged in quote_unverified, a
    preference without a quote of the user's own goes. Only sessions with a friction or a preference have their texts looked up."""
    some = analyses.where("size(friction) > 0 or size(preferences) > 0").select("session_id")
    said = corpora(decoded.join(some, "session_id", "left_semi"))
    out = analyses.drop("friction", "preferences")
    kinds = (("friction", False, ("type", "one_line", "quote", "file", "quote_unverified")), ("preferences", True, ("rule", "quote")))
    for name, preference, fields in kinds:
        rows = analyses.select("session_id", F.posexplode(name).alias("pos", "i")).select("session_id", "pos", "i.*")
        entry = F.struct("pos", F.struct(*fields).alias("i"))
        rows = valid_quotes(rows, said, preference).groupBy("session_id").agg(F.transform(F.sort_array(F.collect_list(entry)), lambda x: x["i"]).alias(name))
        out = out.join(rows, "session_id", "left")
    return out.withColumns({name: F.coalesce(name, F.array().cast(out.schema[name].dataType)) for name, _, _ in kinds})


def analysed(due: DataFrame, pool: str, options: Options, client: Callable[[pd.Series], list[dict]] = judge.by_rule) -> DataFrame:
    """Decodes due sessions, gates them, has the substantial ones judged and merges their analyses into the pool. Returns OUTCOMES.

    The paths of due sessions are known to the driver, as those of any files that Spark reads; their lines aren't. A file that grew since
    is read as it is now, under the time that it had: the stamp is older than what was read, so the session becomes due again."""
    spark = due.sparkSession
    paths = [r.path for r in due.select("path").collect()]
    if not paths:
        return spark.createDataFrame([], OUTCOMES)
    decoded = transcripts.lines(spark, paths)
    facts = session_facts(decoded)
    facts = due.join(facts, "session_id", "left")
    friction = F.col("interrupts") + F.col("rejections") + F.col("tool_errors")
    facts = facts.withColumn("__enough", F.coalesce(substantial(F.col("assistant_turns"), friction, options.threshold), F.lit(False)))
    enough = facts.where("__enough")
    said = judge.judged(reduced(decoded.join(enough.select("session_id"), "session_id", "left_semi"), enough), client)
    done = enough.drop("__enough", "path").withColumnRenamed("mtime", "transcript_mtime").join(said, "session_id", "left")
    done = done.withColumn("error", F.when(F.col("outcome").isNull(), F.coalesce("error", F.lit("no answer"))))
    kept = f"{pool}/tries"
    done.select("session_id", "transcript_mtime", "error", *JUDGED, *FACTS).write.mode("overwrite").parquet(kept)
    done = spark.read.parquet(kept)  # judged once
    keyed.merge(quoted(done.where("error is null").drop("error"), decoded), f"{pool}/analyses", "session_id", "transcript_mtime")
    judged = done.select("session_id", F.col("transcript_mtime").alias("mtime"), F.when(F.col("error").isNull(), "analysed").otherwise("errored").alias("outcome"), "error")
    gated = facts.where("not __enough").select("session_id", "mtime", F.lit("gated").alias("outcome"), F.lit(None).cast("string").alias("error"))
    return judged.unionByName(gated).withColumn("threshold", F.lit(options.threshold)).select(*StructType.fromDDL(OUTCOMES).names)


def step(spark: SparkSession, root: str, store: str, options: Options = Options(), analyse: Callable[[DataFrame, int], DataFrame] | None = None) -> dict[str, int]:
    """Runs what is due now and returns how many sessions had which outcome. analyse(due, batch) gives OUTCOMES; it may be called again
    for a batch whose step was killed. The default is analysed() with the pool below store."""
    analyse = analyse or (lambda due, _: analysed(due, f"{store}/pool", options))
    poll(spark, root, store)
    if not exists(spark, f"{store}/ledger/batch=start"):
        spark.createDataFrame([], OUTCOMES).write.mode("overwrite").parquet(f"{store}/ledger/batch=start")
    micros = F.coalesce(F.unix_micros("mtime"), F.lit(0)).alias("at")
    text = lambda c: F.coalesce(c, F.lit("")).alias(c)
    refs = spark.readStream.schema(REFS).parquet(f"{store}/refs").select("session_id", F.lit("ref").alias("kind"), micros, text("path"), text("project_dir"), F.lit(0).alias("threshold"), F.lit(0).cast("long").alias("seq"))
    nth = F.coalesce(F.expr(BATCH), F.lit(0)).alias("seq")
    outcomes = spark.readStream.schema(OUTCOMES).parquet(f"{store}/ledger/*").select("session_id", F.col("outcome").alias("kind"), micros, F.lit("").alias("path"), F.lit("").alias("project_dir"), F.coalesce("threshold", F.lit(0)).alias("threshold"), nth)
    due = refs.unionByName(outcomes).groupBy("session_id").transformWithStateInPandas(Sessions(options), outputStructType=DUE, outputMode="Append", timeMode="ProcessingTime")
    tally: dict[str, int] = {}

    def run(batch: DataFrame, n: int) -> None:
        batch = batch.persist()
        try:
            analyse(batch, n).write.mode("overwrite").parquet(f"{store}/ledger/batch={n}")
        finally:
            batch.unpersist()
        for r in spark.read.schema(OUTCOMES).parquet(f"{store}/ledger/batch={n}").groupBy("outcome").agg(F.count("*").alias("n")).collect():
            tally[r.outcome] = tally.get(r.outcome, 0) + r.n

    was = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    try:
        # one batch: with processing time, another would always follow, in case a timer has run out
        due.writeStream.foreachBatch(run).option("checkpointLocation", f"{store}/checkpoint").trigger(once=True).start().awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", was)
    return tally


def plan(refs: DataFrame, outcomes: DataFrame, now: Any, options: Options = Options()) -> DataFrame:
    """refs (the newest file of each session) with class, in one batch: meta, incremental, gate, parked, quiet or process."""
    stamp = outcomes.where("outcome = 'analysed'").groupBy("session_id").agg(F.max("mtime").alias("stamp"))
    gate = outcomes.where("outcome = 'gated'").groupBy("session_id").agg(F.max_by(F.struct("mtime", "threshold"), F.struct("mtime", "seq")).alias("gate"))
    of = refs.join(outcomes.select("session_id", "mtime", "seq", "outcome"), ["session_id", "mtime"])
    well = of.where("outcome <> 'errored'").groupBy("session_id").agg(F.max("seq").alias("well"))
    failed = of.join(well, "session_id", "left").where("outcome = 'errored' and (well is null or seq > well)").groupBy("session_id").agg(F.count("*").alias("failures"))
    rows = refs
    for part in (stamp, gate, failed):
        rows = rows.join(part, "session_id", "left")
    meta = F.lower("project_dir").contains("insights") | F.lower("project_dir").contains("facet")
    kind = F.when(meta, "meta").when(F.col("stamp") >= F.col("mtime"), "incremental")
    kind = kind.when((F.col("gate.threshold") == options.threshold) & (F.col("gate.mtime") >= F.col("mtime")), "gate").when(F.col("failures") >= options.failures, "parked")
    quiet = F.col("mtime") > F.lit(now).cast("timestamp") - F.make_interval(secs=F.lit(options.quiet_seconds))
    return rows.select(*refs.columns, kind.when(quiet, "quiet").otherwise("process").alias("class"))
