"""One run over all repositories: due-ness, evidence, a synthesizer's findings, their verification, a snapshot, and the run's state.

What the synthesizer reads is written first, and what it says is written before it is looked at, so it is called once and a run that
fails keeps its answer. Findings are few by their contract (ten ranks at most), so a snapshot is one document; what there is of each
repository stays a table beside it. Nothing is stored of a run of which any check fails, and the state says why.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skeinlog.operators import bundles, keyed, signals, stores, verify
from skeinlog.operators.repos import repo_key
from skeinlog.sources import state

FINDING = (
    "rank int, title string, statement string, rationale string, asset_type string, asset_target string, asset_content string, audience string, adopted string, adopted_path string, "
    "adopted_excerpt string, escalated boolean, escalated_path string, escalated_excerpt string, evidence_ids array<string>, quotes array<string>"
)
DROPPED = "position int, summary string, reason string, evidence_ids array<string>"
ASSETS, RULE_DATES = "path string, content string", "path string, changed timestamp"
REASONS = 100  # violations that a failed run's reason names, at most; all of them void it

Synthesizer = Callable[[DataFrame, DataFrame], tuple[DataFrame, DataFrame]]


class Rejected(ValueError):
    """Findings that fail a check."""


@dataclass(frozen=True)
class Options:
    """min_sessions: of a repository that counts; due_new_sessions and cadence_days: when a run is due; only_if_due: else it doesn't
    start; keep: snapshots that stay; aliases: of repositories' names; home: written as ~ in what is shown."""

    min_sessions: int = 10
    due_new_sessions: int = 10
    cadence_days: int = 14
    only_if_due: bool = False
    keep: int = 10
    home: str = ""
    aliases: Mapping[str, str] = field(default_factory=dict)


def due_state(analyses: DataFrame, last: datetime | None, now: datetime, options: Options = Options()) -> DataFrame:
    """One row (fresh, contributing, due) of analyses(repo, analysed_at): fresh ones were written after `last`, the last snapshot's time."""
    fresh = F.lit(True) if last is None else F.col("analysed_at") > F.lit(last)
    counts = analyses.where(F.coalesce("repo", F.lit("")) != "").groupBy("repo").agg(F.count_if(fresh).alias("fresh"), F.count("*").alias("total"))
    since = None if last is None else F.lit((now - last).total_seconds() / 86400)
    return signals.due(counts, "repo", "fresh", "total", options.min_sessions, options.due_new_sessions, since, options.cadence_days)


def auto_state(status: Column, reason: Column, written: Column, held: Column, due: Column) -> Column:
    """(state, last_outcome): running, error, due or idle. A run that calls itself running while nothing is held has died."""
    running, failed = status.eqNullSafe("running"), status.eqNullSafe("failed")
    what = F.when(running & held, "running").when(running | failed, "error").when(due, "due").otherwise("idle")
    said = F.when(running & ~held, "last run died (no exit record)").when(failed, F.concat(F.lit("last run failed: "), F.coalesce(reason, F.lit(""))))
    said = said.when(status.eqNullSafe("ok"), F.concat(F.lit("last run: "), F.coalesce(written, F.lit(0)).cast("string"), F.lit(" written")))
    return F.struct(what.alias("state"), F.coalesce(said, F.lit("")).alias("last_outcome"))


def by_rule(evidence: DataFrame, _: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A stand-in that calls no model: the three kinds of friction that most sessions have, of equal ones the first by name, each as a
    habit that cites the first friction of each of the first twenty repositories that have it."""
    f = evidence.where("kind = 'F' and label <> ''").select("label", "repo", "n", "id", F.col("session_ids")[0].alias("session_id"))
    most = f.groupBy("label").agg(F.count_distinct("repo", "session_id").alias("sessions")).orderBy(F.desc("sessions"), "label").limit(3)
    most = most.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("sessions"), "label")))  # three rows
    first = f.groupBy("label", "repo").agg(F.min_by("id", "n").alias("id"))
    first = first.join(F.broadcast(most), "label").withColumn("k", F.row_number().over(Window.partitionBy("label").orderBy("repo"))).where("k <= 20")
    got = first.groupBy("label", "rank").agg(F.sort_array(F.collect_list(F.struct("k", "id"))).alias("ids"))
    text = {"title": F.concat(F.lit("Recurring friction: "), "label"), "statement": F.concat(F.lit("Watch for "), "label"), "rationale": F.lit("It recurs over repositories"), "asset_type": F.lit("habit"), "adopted": F.lit("unknown")}
    got = got.withColumns(text | {"escalated": F.lit(False), "evidence_ids": F.col("ids.id"), "quotes": F.array().cast("array<string>")})
    return got, evidence.sparkSession.createDataFrame([], DROPPED)


def shaped(rows: DataFrame, ddl: str) -> DataFrame:
    """rows with the columns of ddl, in its types; one that lacks is null."""
    cut = [c.strip().split(" ", 1) for c in ddl.split(", ")]
    return rows.select(*[(F.col(n) if n in rows.columns else F.lit(None)).cast(t).alias(n) for n, t in cut])


def verified(findings: DataFrame, dropped: DataFrame, evidence: DataFrame, dates: DataFrame, assets: DataFrame, rule_dates: DataFrame | None, home: str = "") -> tuple[DataFrame, DataFrame]:
    """(findings, notes): findings by gapless ranks with repos, sessions and last_seen of what they cite, and notes(rank, note).

    Rejected names the rules that are broken; none of it holds a text of the model. A finding whose rule changed after it was last seen
    is left out, one that isn't adopted as it says is called unknown, quotes that aren't of its evidence go: each with a note."""
    bad = verify.violations(findings, evidence).select(F.coalesce(F.col("rank").cast("string"), F.lit("all")).alias("at"), "rule")
    bad = bad.unionByName(verify.dropped_violations(dropped, evidence).select(F.concat(F.lit("dropped "), F.col("position").cast("string")).alias("at"), "rule"))
    f = verify.adopted(findings, assets).join(verify.recounted(findings, evidence, dates), "rank", "left")
    f = verify.escalations(f, assets, rule_dates)
    wrong = f.where(F.col("state").isin("habit", "lacking", "unreadable", "not verbatim")).select(F.col("rank").cast("string").alias("at"), F.concat(F.lit("escalation "), "state").alias("rule"))
    reasons = [f"{r['at']}: {r['rule']}" for r in bad.unionByName(wrong).distinct().orderBy("at", "rule").limit(REASONS).collect()]
    if reasons:
        raise Rejected("verification failed: " + "; ".join(reasons))
    f = f.join(verify.quotes(findings, evidence).withColumnRenamed("dropped", "__gone"), "rank", "left")
    notes = F.array_compact(
        F.array(
            F.when(F.col("downgraded").isNotNull(), F.concat(F.lit("adopted is unknown: "), "downgraded")),
            F.when(F.col("state") == "removed", F.lit("removed: its rule changed after it was last seen")),
            F.when(F.col("state") == "undated", F.lit("escalation: no date to tell by")),
            F.when(F.col("__gone") > 0, F.concat(F.lit("quotes dropped: "), F.col("__gone").cast("string"))),
        )
    )
    noted = f.select("rank", F.explode(notes).alias("note"))
    kept = f.where(~F.col("state").eqNullSafe("removed")).withColumn("quotes", F.coalesce("kept", F.array().cast("array<string>")))
    kept = kept.withColumn("rank", F.row_number().over(Window.orderBy("rank")))  # ten rows at most, as was checked
    for c in ("adopted_path", "escalated_path", "asset_target"):
        kept = kept.withColumn(c, verify.tilde(F.col(c), home))
    return kept.drop("downgraded", "state", "kept", "__gone"), noted


def _document(findings: DataFrame, dropped: DataFrame, notes: DataFrame, heads: DataFrame, instant: str) -> str:
    """The snapshot, in JSON: ten findings at most, with what one answer dropped and what was noted of it."""
    window = heads.agg(F.min("from_day").alias("from"), F.max("to_day").alias("to")).first().asDict()
    out = {"schema_version": verify.SCHEMA, "generated_at": instant, "window": window}
    for name, rows, order in (("findings", findings, ["rank"]), ("dropped", dropped, ["position"]), ("notes", notes, ["rank", "note"])):
        out[name] = [json.loads(r["j"]) for r in rows.orderBy(*order).select(F.to_json(F.struct(*rows.columns)).alias("j")).collect()]
    return json.dumps(out, sort_keys=True)


def pooled(spark: SparkSession, store: str, options: Options) -> DataFrame | None:
    """The analyses of a store with their repository and when they were written; None where there are none yet."""
    path = f"{store}/pool/analyses"
    if not keyed.versions(spark, path):
        return None
    rows = keyed.read(spark, path)
    named = F.col("repo_path") if "repo_path" in rows.columns else F.lit("")
    at = F.coalesce("analysed_at", "transcript_mtime") if "analysed_at" in rows.columns else F.col("transcript_mtime")
    return rows.withColumns({"repo": repo_key(named, F.col("cwd"), options.aliases), "analysed_at": at})


def last_time(spark: SparkSession, store: str) -> datetime | None:
    """When the newest sound snapshot was begun."""
    got = state.latest_snapshot(spark, f"{store}/synthesis/snapshots").select(F.try_variant_get("v", "$.generated_at", "string").alias("t")).first()
    return datetime.strptime(got["t"], "%Y-%m-%dT%H-%M-%SZ") if got and got["t"] else None


def _note_state(spark: SparkSession, store: str, **what) -> None:
    stores.write_text(spark, f"{store}/synthesis/run.json", json.dumps(what, sort_keys=True))


def prepare(analyses: DataFrame, options: Options = Options()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(evidence, headers, dates) of the repositories that reach the floor: what a run would feed the synthesizer, and what it costs."""
    some = bundles.floored(analyses, options.min_sessions)
    evidence = bundles.items(some).unionByName(bundles.signal_items(some))
    dates = some.select("repo", "session_id", F.date_format("start", "yyyy-MM-dd").alias("day"))
    return evidence, bundles.headers(some, evidence), dates


def run(spark: SparkSession, store: str, now: datetime, synthesizer: Synthesizer = by_rule, options: Options = Options(), assets: DataFrame | None = None, rule_dates: DataFrame | None = None) -> dict:
    """Runs once over the store's pool and returns {due, contributing, repos, written, reason}. now: naive, in UTC; it stamps the snapshot,
    so that what is analysed while the synthesizer works counts as new for the next run. A run that fails isn't an exception: its reason
    is in the result and in run.json, and what the synthesizer said stays below diagnostics/. An empty pool is a run that writes nothing."""
    at, instant = f"{store}/synthesis", now.strftime("%Y-%m-%dT%H-%M-%SZ")
    pool, last = pooled(spark, store, options), last_time(spark, store)
    out = {"due": False, "contributing": [], "repos": 0, "written": 0, "reason": ""}
    if pool is not None:
        d = due_state(pool, last, now, options).first()
        out |= {"due": d["due"], "contributing": [x for x in d["contributing"].split(",") if x]}
    if options.only_if_due and not out["due"]:
        return out
    _note_state(spark, store, status="running", started_at=instant)
    kept = f"{at}/diagnostics/{instant}"
    try:
        if pool is not None:
            evidence, heads, dates = prepare(pool, options)
            evidence.write.mode("overwrite").parquet(f"{at}/evidence/{instant}")
            evidence = spark.read.schema(bundles.EVIDENCE).parquet(f"{at}/evidence/{instant}")
            heads = bundles.headers(bundles.floored(pool, options.min_sessions), evidence)
            heads.write.mode("overwrite").parquet(f"{at}/repos/{instant}")
            heads = spark.read.parquet(f"{at}/repos/{instant}")
            out["repos"] = heads.count()
        if out["repos"]:
            for part, rows, ddl in zip(("findings", "dropped"), synthesizer(evidence, heads), (FINDING, DROPPED), strict=True):
                shaped(rows, ddl).write.mode("overwrite").parquet(f"{kept}/{part}")
            findings, dropped = (spark.read.schema(ddl).parquet(f"{kept}/{part}") for part, ddl in (("findings", FINDING), ("dropped", DROPPED)))
            files = assets if assets is not None else spark.createDataFrame([], ASSETS)
            good, notes = verified(findings, dropped, evidence, dates, files, rule_dates, options.home)
            stores.store_snapshot(spark, f"{at}/snapshots", _document(good, dropped, notes, heads, instant), instant, options.keep)
            out["written"] = 1
    except Exception as e:
        said = f" (the answer is kept at {kept})" if state.exists(spark, kept) else ""
        out["reason"] = f"{e if isinstance(e, Rejected) else type(e).__name__ + ': ' + str(e)[:400]}{said}"
    if out["written"]:
        fs, path = stores._fs(spark, kept)
        fs.delete(path, True)
    _note_state(spark, store, status="failed" if out["reason"] else "ok", started_at=instant, written=out["written"], reason=out["reason"])
    return out


def status(spark: SparkSession, store: str, now: datetime, running: bool = False, acted: DataFrame | None = None, options: Options = Options()) -> DataFrame:
    """One row (running, due_repos, acted, state, last_outcome, last_run): what a header shows. due_repos is empty while no run would start."""
    pool = pooled(spark, store, options)
    d = due_state(pool, last_time(spark, store), now, options).first() if pool is not None else None
    due = d["contributing"].split(",") if d and d["due"] else []
    last = state.run_state(spark, f"{store}/synthesis/run.json").select(F.to_json("v").alias("j")).first()
    told = json.loads(last["j"]) if last else {}
    keys = acted.where("key is not null").distinct().count() if acted is not None else 0
    row = (running, due, keys, last["j"] if last else None, told.get("status"), told.get("reason"), told.get("written"))
    one = spark.createDataFrame([row], "running boolean, due_repos array<string>, acted long, last_run string, s string, r string, w long")
    auto = auto_state(F.col("s"), F.col("r"), F.col("w"), F.col("running"), F.size("due_repos") > 0)
    return one.withColumn("a", auto).select("running", "due_repos", "acted", "a.state", "a.last_outcome", "last_run")
