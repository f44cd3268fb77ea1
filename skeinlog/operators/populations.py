"""Populations: which sessions a report was made of, what became of an anchor's sessions, and stored facts against recomputed ones.

Members stay rows; no population is an array or a driver's list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Words and a skill that mark a session about the pipeline itself, the most lines of a card, and what stands for no line.
META_WORDS, META_SKILL = ("insights", "facet"), "analyzing-agent-sessions"
MOST_LINES, NO_LINE = 6, "(no pool summary)"


def is_meta(cwd: Column, repo: Column, skills: Column) -> Column:
    """A session about the pipeline itself, by its folders or its skill. Such sessions are in no scoring population."""
    where = F.lower(F.concat_ws(" ", F.coalesce(cwd, F.lit("")), F.coalesce(repo, F.lit(""))))
    named = where.contains(META_WORDS[0]) | where.contains(META_WORDS[1])
    return named | F.coalesce(F.array_contains(skills, META_SKILL), F.lit(False))


def reconstructed(reports: DataFrame, analyses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What each report was made of, from what is stored now.

    reports(bucket, analysed, from_day, to_day, generated_at); analyses(bucket, session_id, start, meta, repo_path). A bucket's analyses
    are its population if they are as many as the report says, else those that had started before the report, if these are; else all,
    unresolved. A session without a start counts as started. Returns buckets (bucket, expected, reconstructed, resolved, from_day, to_day,
    the days in order, repo_path, the least, and problem, null if resolved) and members (bucket, session_id, scoring: not meta). A
    bucket without analyses has no members; analyses of no reported bucket are left out. The counts are summed in part, so a bucket of
    any size is only rows."""
    early = F.col("start").isNull() | (F.col("start") < F.col("generated_at"))
    at = reports.select("bucket", "generated_at")
    seen = analyses.join(at, "bucket").withColumn("early", early)
    counts = seen.groupBy("bucket").agg(F.count("*").alias("n"), F.count_if("early").alias("n_early"), F.min(F.nullif("repo_path", F.lit(""))).alias("all_path"), F.min(F.when(F.col("early"), F.nullif("repo_path", F.lit("")))).alias("early_path"))
    b = reports.join(counts, "bucket", "left").fillna(0, ["n", "n_early"])
    b = b.withColumn("cut", (F.col("n") != F.col("analysed")) & (F.col("n_early") == F.col("analysed")))
    got = F.when(F.col("cut"), F.col("n_early")).otherwise(F.col("n"))
    ok = got == F.col("analysed")
    turned = F.col("from_day") > F.col("to_day")
    problem = F.when(~ok, F.format_string("%s: reconstructed %d analyses, report says %d", "bucket", got, "analysed"))
    buckets = b.select(
        "bucket", F.col("analysed").alias("expected"), got.alias("reconstructed"), ok.alias("resolved"),
        F.when(turned, F.col("to_day")).otherwise(F.col("from_day")).alias("from_day"), F.when(turned, F.col("from_day")).otherwise(F.col("to_day")).alias("to_day"),
        F.substring_index(F.when(F.col("cut"), F.col("early_path")).otherwise(F.col("all_path")), "/.worktrees/", 1).alias("repo_path"), problem.alias("problem"),
    )
    members = seen.join(b.select("bucket", "cut"), "bucket").where("early or not cut").select("bucket", "session_id", (~F.col("meta")).alias("scoring"))
    return buckets, members


def scoring_union(members: DataFrame) -> DataFrame:
    """(session_id): all sessions that some bucket scores, once."""
    return members.where("scoring").select("session_id").distinct()


def all_resolved(buckets: DataFrame) -> DataFrame:
    """One row: whether there is a bucket and each one is resolved."""
    return buckets.agg((F.coalesce(F.bool_and("resolved"), F.lit(False))).alias("resolved"), F.count_if(~F.col("resolved")).alias("open"))


def cutover(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """(key, before, after): buckets whose numbers of rows differ between two tables; one that lacks counts 0, rows without key don't."""
    side = lambda df, a, b: df.where(F.col(key).isNotNull()).select(key, F.lit(a).alias("b"), F.lit(b).alias("a"))
    n = side(before, 1, 0).unionByName(side(after, 0, 1)).groupBy(key).agg(F.sum("b").alias("before"), F.sum("a").alias("after"))
    return n.where("before <> after")


def stripped(members: DataFrame, gaps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """members without sessions of gaps(session_id), whose transcripts are gone, and (bucket, session_id, note) of those that went."""
    gone = gaps.select("session_id").distinct()
    note = F.concat_ws("", "bucket", F.lit(": "), "session_id", F.lit(" stripped from full-scope population (gap)"))
    return members.join(gone, "session_id", "left_anti"), members.join(gone, "session_id", "left_semi").select("bucket", "session_id", note.alias("note"))


def membership(cards: DataFrame, anchors: DataFrame, lines: DataFrame) -> DataFrame:
    """(card, added, missing): what a card's item has beyond its target's anchors, and what it lacks of them, as one line for each session.

    cards(card, target, session_id) and anchors(target, session_id) are rows; lines(session_id, line). A session without a line shows
    NO_LINE. Lines are in the order of their sessions; MOST_LINES are shown and the rest is counted, so only those meet in a row."""
    item = cards.select("card", "target", "session_id").distinct()
    held = cards.select("card", "target").distinct().join(anchors.select("target", "session_id").distinct(), "target").select("card", "session_id")
    both = item.select("card", "session_id", F.lit(1).alias("side")).unionByName(held.withColumn("side", F.lit(2)))
    odd = both.groupBy("card", "session_id").agg(F.sum("side").alias("side")).where("side < 3")
    odd = odd.join(lines.select("session_id", "line"), "session_id", "left").withColumn("line", F.coalesce("line", F.lit(NO_LINE)))
    nth = Window.partitionBy("card", "side").orderBy("session_id")
    few = odd.withColumn("nth", F.row_number().over(nth)).where(F.col("nth") <= MOST_LINES)
    said = lambda k: F.transform(F.sort_array(F.collect_list(F.when(F.col("side") == k, F.struct("nth", "line")))), lambda x: x["line"])
    n = odd.groupBy("card").agg(F.count_if(F.col("side") == 1).alias("na"), F.count_if(F.col("side") == 2).alias("nm"))
    more = lambda c, n: F.when(F.col(n) > MOST_LINES, F.concat(F.col(c), F.array(F.format_string("… and %d more", F.col(n) - MOST_LINES)))).otherwise(F.coalesce(c, F.array().cast("array<string>")))
    out = cards.select("card").distinct().join(few.groupBy("card").agg(said(1).alias("a"), said(2).alias("m")), "card", "left").join(n, "card", "left")
    return out.select("card", more("a", "na").alias("added"), more("m", "nm").alias("missing"))


def anchor_history(rubrics: DataFrame, themes: DataFrame, gaps: DataFrame) -> DataFrame:
    """(target, session_id, state) of each rubric's anchors against the theme that it names, before anything was stripped.

    rubrics(target, theme, session_id: an anchor, null for a rubric without one), themes(theme, session_id), gaps(session_id). kept: an
    anchor that the theme has; gap: of the theme, no anchor any more, its transcript is gone; stripped: of the theme, no anchor for
    another reason; foreign: an anchor that the theme doesn't have, so the rubric names the wrong one; no_theme: its theme isn't there."""
    named = rubrics.where("theme is not null")
    before = named.select("target", "theme").distinct().join(themes.select("theme", "session_id").distinct(), "theme").select("target", "session_id", F.lit(True).alias("was"))
    now = named.where("session_id is not null").select("target", "session_id", F.lit(True).alias("is")).distinct()
    known = themes.select("theme").distinct()
    lost = named.join(known, "theme", "left_anti").select("target").distinct()
    gone = gaps.select("session_id", F.lit(True).alias("gap")).distinct()
    j = before.join(now, ["target", "session_id"], "full").join(gone, "session_id", "left").join(lost.withColumn("lost", F.lit(True)), "target", "left")
    state = F.when(F.col("lost"), "no_theme").when(F.col("was") & F.col("is"), "kept").when(F.col("is"), "foreign").when(F.col("gap"), "gap").otherwise("stripped")
    return j.select("target", "session_id", state.alias("state"))


def recomputed(ids: DataFrame, pool: DataFrame, facts: DataFrame) -> DataFrame:
    """ids(session_id) with judged fields of pool(session_id, judged, stats) and stats of facts(session_id, stats), and gap: where the
    facts are gone, the pool's stats stand in whole, and say so. An id that the pool doesn't have is an error when it is read."""
    j = ids.select("session_id").distinct().join(pool.select("session_id", "judged", F.col("stats").alias("old"), F.lit(True).alias("there")), "session_id", "left")
    j = j.join(facts.select("session_id", F.col("stats").alias("new"), F.lit(True).alias("fresh")), "session_id", "left")
    sound = F.when(F.col("there").isNull(), F.raise_error(F.concat(F.lit("no analysis of "), F.col("session_id"))).cast("boolean")).otherwise(F.col("fresh").isNull())
    return j.select("session_id", "judged", F.when(F.col("fresh"), F.col("new")).otherwise(F.col("old")).alias("stats"), sound.alias("gap"))


def differences(stored: DataFrame, fresh: DataFrame, key: str, value: str, depth: int = 2) -> DataFrame:
    """(key, path, stored, fresh): where the variants of two tables differ, as JSON; null is a field that isn't there, which is not the
    same as a null in JSON. Objects are taken apart to `depth` levels, what is below is compared as text. Keys of one table only show
    all of their fields. A field is a row, so objects of any size don't meet in one."""

    def leaves(df: DataFrame, name: str) -> DataFrame:
        rows, out = df.select(F.col(key).alias("__k"), F.lit("$").alias("path"), F.col(value).alias("v")), None
        for _ in range(depth):
            inner = rows.where(F.schema_of_variant("v").startswith("OBJECT<") & (F.schema_of_variant("v") != "OBJECT<>"))
            plain = rows.where(~F.coalesce(F.schema_of_variant("v").startswith("OBJECT<") & (F.schema_of_variant("v") != "OBJECT<>"), F.lit(False)))
            out = plain if out is None else out.unionByName(plain)
            spark = df.sparkSession
            each = inner.withColumnRenamed("v", "o").lateralJoin(spark.tvf.variant_explode(F.col("o").outer()))
            rows = each.select("__k", F.concat_ws(".", "path", "key").alias("path"), F.col("value").alias("v"))
        return out.unionByName(rows).select("__k", "path", F.to_json("v").alias(name))

    a, b = leaves(stored, "stored"), leaves(fresh, "fresh").withColumnsRenamed({"__k": "k2", "path": "p2"})
    j = a.join(b, (F.col("__k") == F.col("k2")) & (F.col("path") == F.col("p2")), "full").where(~F.col("stored").eqNullSafe(F.col("fresh")))
    return j.select(F.coalesce("__k", "k2").alias(key), F.coalesce("path", "p2").alias("path"), "stored", "fresh")
