"""Checks of findings against evidence. Every violation is reported, not the first alone; hard ones void the run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinlog.functions.text import MIN_QUOTE, SNAPSHOT, has_quantity, normalise_ws, private_labels, shorten

# Kinds of evidence that each kind of asset may rest on, and the signals that a new skill may.
GROUNDING = {"claude_md_rule": "PF", "repo_doc": "PF", "hook": "FG", "setting": "FG", "new_skill": "GP", "habit": "FS"}
RETYPED = ("retyped_directives", "retyped_kickoffs")
AUDIENCES = ("user", "orchestrator", "subagents", "both", "automation")
NAMED = ("claude_md_rule", "repo_doc")  # kinds of asset that must name their audience
MOST_FINDINGS, MOST_QUOTES, MOST_MODEL_TEXT, SCHEMA = 10, 3, 120, 3


def cited(findings: DataFrame, evidence: DataFrame) -> DataFrame:
    """(rank, id, kind, signal_kind, sessions): a row for each citation; kind is null where no evidence has the id."""
    ids = findings.select("rank", "asset_type", "escalated", F.explode("evidence_ids").alias("id"))
    return ids.join(evidence.select("id", "kind", "signal_kind", "repo", "session_ids"), "id", "left")


def violations(findings: DataFrame, evidence: DataFrame) -> DataFrame:
    """(rank, rule): findings(rank, title, statement, rationale, asset_type, audience, adopted, escalated, evidence_ids), and asset_target
    and asset_content where the table has them."""
    f = findings
    rank = F.col("rank")

    def where(rule: str, bad) -> DataFrame:
        return f.where(bad).select(rank, F.lit(rule).alias("rule"))

    counts = f.agg(F.count("*").alias("n"), F.count_distinct("rank").alias("u"), F.min("rank").alias("lo"), F.max("rank").alias("hi"))
    wrong = (F.col("n") > 0) & ((F.col("u") != F.col("n")) | (F.col("lo") != 1) | (F.col("hi") != F.col("n")) | (F.col("n") > MOST_FINDINGS))
    out = counts.where(wrong).select(F.lit(None).cast("int").alias("rank"), F.lit("ranks").alias("rule"))
    free = F.concat_ws("\n", "title", "statement", "rationale")
    empty = F.coalesce(F.trim("title"), F.lit("")) == ""
    named = F.coalesce("audience", F.lit(""))
    for rule, bad in (
        ("title", empty),
        ("adopted", ~F.coalesce("adopted", F.lit("")).isin("yes", "no", "unknown")),
        ("no_citation", F.coalesce(F.size("evidence_ids"), F.lit(0)) < 1),
        ("asset_type", ~F.col("asset_type").isin(*GROUNDING)),
        ("audience", F.when(named == "", F.col("asset_type").isin(*NAMED)).otherwise(~named.isin(*AUDIENCES))),
        ("escalated_habit", F.col("escalated") & (F.col("asset_type") == "habit")),
        *([("asset", (F.col("asset_type") != "habit") & ((F.coalesce("asset_target", F.lit("")) == "") | (F.coalesce("asset_content", F.lit("")) == "")))] if "asset_content" in f.columns else []),
        ("quantity", has_quantity(free)),
        ("privacy", F.size(private_labels(free, SNAPSHOT)) > 0),
    ):
        out = out.unionByName(where(rule, bad))
    c = cited(f, evidence)
    out = out.unionByName(c.where("kind is null").select("rank", F.lit("dangling").alias("rule")).distinct())
    ok = F.col("escalated") & F.col("kind").isin("P", "F")
    for asset, kinds in GROUNDING.items():
        fits = (F.col("asset_type") == asset) & F.col("kind").isin(*kinds)
        if asset == "new_skill":
            fits &= (F.col("kind") != "G") | F.col("signal_kind").isin(*RETYPED)
        ok = ok | (~F.col("escalated") & fits)
    return out.unionByName(c.where(F.col("kind").isNotNull() & ~ok).select("rank", F.lit("grounding").alias("rule")).distinct())


def recounted(findings: DataFrame, evidence: DataFrame, dates: DataFrame) -> DataFrame:
    """(rank, repos, sessions, last_seen), all from what is cited; a session is known by its repo and id."""
    s = cited(findings, evidence).select("rank", "repo", F.explode("session_ids").alias("session_id")).distinct()
    s = s.join(dates, ["repo", "session_id"], "left")
    return s.groupBy("rank").agg(F.sort_array(F.collect_set("repo")).alias("repos"), F.count("*").alias("sessions"), F.max("day").alias("last_seen"))


def quotes(findings: DataFrame, evidence: DataFrame) -> DataFrame:
    """(rank, kept, dropped): the first three quotes of each finding, held against the joined quotes of its evidence."""
    pool = findings.select("rank", F.explode("evidence_ids").alias("id")).join(evidence.select("id", "quote_pool"), "id")
    pool = pool.groupBy("rank").agg(F.array_join(F.flatten(F.sort_array(F.collect_list("quote_pool"))), "\n").alias("pool"))
    rows = findings.select("rank", F.slice("quotes", 1, MOST_QUOTES).alias("quotes")).join(pool, "rank", "left")
    there = lambda q: (F.length(q) >= MIN_QUOTE) & (F.contains(F.coalesce("pool", F.lit("")), q) | F.contains(normalise_ws(F.coalesce("pool", F.lit(""))), normalise_ws(q)))
    kept = F.filter("quotes", there)
    return rows.select("rank", kept.alias("kept"), (F.size("quotes") - F.size(kept)).alias("dropped"))


def privacy_gate(rows: DataFrame, text: str) -> DataFrame:
    """rows that hold nothing private; what was found is never shown."""
    return rows.where(F.size(private_labels(F.col(text))) == 0)


def dropped_violations(dropped: DataFrame, evidence: DataFrame) -> DataFrame:
    """(position, rule): dropped(position, summary, reason, evidence_ids) must cite what there is, and say no quantity and nothing private."""
    free = F.concat_ws("\n", "summary", "reason")
    rules = F.array_compact(F.array(F.when(F.coalesce(F.size("evidence_ids"), F.lit(0)) < 1, "no_citation"), F.when(has_quantity(free), "quantity"), F.when(F.size(private_labels(free, SNAPSHOT)) > 0, "privacy")))
    ids = dropped.select("position", F.explode("evidence_ids").alias("id")).join(evidence.select("id"), "id", "left_anti")
    return dropped.select("position", F.explode(rules).alias("rule")).unionByName(ids.select("position", F.lit("dangling").alias("rule")).distinct())


def schema_violation(version) -> str | None:
    return None if version == SCHEMA else f"schema_version is not {SCHEMA}"


def tilde(c: Column, home: str) -> Column:
    """Paths below home begin with ~. Applied last, to a copy."""
    at = home.rstrip("/")
    return F.when(c == at, "~").otherwise(F.replace(c, F.lit(at + "/"), F.lit("~/"))) if at else c


def model_text(c: Column) -> Column:
    """What a model wrote, bounded, for a reason that is shown."""
    return shorten(c, MOST_MODEL_TEXT)


def _held(rows: DataFrame, assets: DataFrame, path: str, excerpt: str) -> DataFrame:
    """rows with __state: lacking, unreadable, not verbatim, or null if assets(path, content) has the excerpt, as it is or but for white
    space. An empty excerpt is in every file, so it is lacking."""
    a = assets.select(F.col("path").alias(path), F.col("content").alias("__content"))
    gap = (F.coalesce(path, F.lit("")) == "") | (F.coalesce(excerpt, F.lit("")) == "")
    there = F.contains("__content", excerpt) | F.contains(normalise_ws(F.col("__content")), normalise_ws(F.col(excerpt)))
    state = F.when(gap, "lacking").when(F.col("__content").isNull(), "unreadable").when(~there, "not verbatim")
    return rows.join(a, path, "left").withColumn("__state", state).drop("__content")


def adopted(findings: DataFrame, assets: DataFrame) -> DataFrame:
    """findings with adopted and downgraded: a yes whose adopted_excerpt isn't in the file adopted_path becomes unknown, and why."""
    f = _held(findings, assets, "adopted_path", "adopted_excerpt")
    why = F.when(F.col("adopted") == "yes", F.col("__state"))
    return f.withColumn("downgraded", why).withColumn("adopted", F.when(F.col("downgraded").isNotNull(), "unknown").otherwise(F.col("adopted"))).drop("__state")


def escalations(findings: DataFrame, assets: DataFrame, rule_dates: DataFrame | None) -> DataFrame:
    """findings with state, null where there is no escalation: habit, lacking, unreadable or not verbatim are violations; removed: the rule
    escalated_path changed after last_seen, the last cited day (on the same day counts as after the rule); undated: it can't be told; kept.
    rule_dates(path, changed) is null where there is no history, and then nothing is removed."""
    f = _held(findings, assets, "escalated_path", "escalated_excerpt")
    if rule_dates is None:
        age = F.lit("kept")
    else:
        f = f.join(rule_dates.select(F.col("path").alias("escalated_path"), F.to_date("changed").alias("__changed")), "escalated_path", "left")
        age = F.when(F.col("__changed").isNull() | F.col("last_seen").isNull(), "undated").when(F.to_date("last_seen") < F.col("__changed"), "removed").otherwise("kept")
    state = F.when(F.col("escalated"), F.when(F.col("asset_type") == "habit", "habit").when(F.col("__state").isNotNull(), F.col("__state")).otherwise(age))
    return f.withColumn("state", state).drop("__state", "__changed")
