"""Scoring algebra: corroboration, medians, majorities, target status, recall, churn and stability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Ordinals, weights and bars.
GRANULARITY = ("absent", "over_generalized", "partial", "full")
WEIGHT = {"HIGH": 3, "MODERATE-HIGH": 2, "MODERATE": 1, "MEDIUM": 1}
RECALL, PRECISION = 0.5, 0.5


def corroborate(dropped: Column, finding: Column, sessions: Column, anchors: Column, cap: Column) -> Column:
    """The class of an item: cap is the number of anchors that its size is held against; 0 or null means all of `anchors`."""
    size = F.size(F.array_distinct(sessions))
    hits = F.size(F.filter(anchors, lambda a: F.array_contains(sessions, a)))
    recall = hits >= RECALL * F.size(anchors)
    grounded = finding & (hits >= 1) & (hits >= PRECISION * size)
    cap = F.when(F.coalesce(cap, F.lit(0)) > 0, cap).otherwise(F.size(anchors))
    return (
        F.when(dropped, "dropped").when(F.size(anchors) == 0, "no_anchors").when((size == 0) | ~(recall | grounded), "anchor_mismatch")
        .when(size > 3 * cap + 2, "size_cap").when(recall, "corroborated").otherwise("grounded")
    )


def lower_median(c: str) -> Column:
    """sorted[(n - 1) / 2], never a mean of two."""
    return F.expr(f"cast(percentile_disc(0.5) within group (order by {c}) as bigint)")


def status_of(status: Column, median: Column, pass_at: Column, tier: Column, provisional: Column | None = None) -> tuple[Column, Column]:
    """(meets expectation, hard fail) of a target's median granularity. A provisional pass waits for confirmation: it doesn't meet the
    expectation, but is no hard fail. An invalidated target is left out of all counts: both are null."""
    would = median >= pass_at
    held = F.lit(False) if provisional is None else F.coalesce(provisional, F.lit(False))
    meets = F.when(status == "must_pass", would & ~held).when(status == "expected_partial", median > 0).when(status != "invalidated", True)
    hard = F.when(status == "must_pass", (tier == "HIGH") & ~would).when(status == "expected_partial", median == 0).when(status != "invalidated", False)
    return meets, hard


# Outcomes from worst to best; any other, such as unclear, has no place among them.
OUTCOMES = ("not_achieved", "partially_achieved", "mostly_achieved", "fully_achieved")


def outcome_ordinal(outcome: Column, scale: tuple[str, ...] = OUTCOMES) -> Column:
    """The place of an outcome, from 1; null for one that isn't on the scale."""
    return F.nullif(F.array_position(F.array(*map(F.lit, scale)), outcome), F.lit(0))


def two_class_jump(rows: DataFrame, key: str, outcome: str, scale: tuple[str, ...] = OUTCOMES) -> DataFrame:
    """(key, jump, unclear): whether outcomes on the scale lie two places apart or more (null without any), and how many aren't on it."""
    at = outcome_ordinal(F.col(outcome), scale)
    return rows.groupBy(key).agg((F.max(at) - F.min(at) >= 2).alias("jump"), F.count_if(at.isNull()).alias("unclear"))


def ratio(num: Column, den: Column, empty: float) -> Column:
    return F.when(den == 0, F.lit(empty)).otherwise(num / den)


def pairwise_stability(rows: DataFrame, key: str, repeat: str, kind: str) -> DataFrame:
    """(key, repeats, mean_jaccard, churn): over pairs of repeats the mean Jaccard of their sets of kinds (1 for fewer than two), and
    whether some kind is not in all repeats."""
    sets = rows.groupBy(key, repeat).agg(F.collect_set(kind).alias("s"))
    all_ = sets.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct(repeat, "s"))), lambda x: x["s"]).alias("sets"))
    n = F.size("sets")
    pairs = F.flatten(F.transform("sets", lambda a, i: F.transform(F.slice("sets", i + 2, F.greatest(n - i - 1, F.lit(0))), lambda b: F.when(F.size(F.array_union(a, b)) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))))))
    mean = F.when(n < 2, F.lit(1.0)).otherwise(F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x) / F.size(pairs))
    union = F.array_distinct(F.flatten("sets"))
    churn = F.exists(union, lambda k: ~F.forall("sets", lambda s: F.array_contains(s, k)))
    return all_.select(key, n.cast("long").alias("repeats"), F.round(mean, 9).alias("mean_jaccard"), churn.alias("churn"))


# Quotes under this length that stand more than once say little; reasons in their order.
GENERIC_QUOTE = 20
REASONS = ("run-to-run disagreement", "borderline outcome", "fabrication-pressure quote", "false-friction candidate", "recall candidate")


def contested(repeats: DataFrame, sessions: DataFrame) -> DataFrame:
    """(session_id, reasons): why a person should look at a session's repeats; those without a reason have an empty array.

    repeats(session_id, repeat, outcome, types: array of kinds of friction, one for each incident, quotes: array of what survived);
    sessions(session_id, friction: errors, interrupts and rejections together, all_text). Reasons: outcomes or sets of kinds differ, or
    numbers of incidents by two or more; an outcome is unclear, or both mostly and partially achieved are there; a quote of fewer than
    GENERIC_QUOTE characters stands in the session's text more than once; incidents without any friction; friction, but at least half of
    the repeats, rounded up, have no incident. Null arrays are empty ones; a session without repeats has no reason."""
    r = repeats.withColumns({c: F.coalesce(c, F.array().cast("array<string>")) for c in ("types", "quotes")})
    n = F.size("types")
    by = r.groupBy("session_id").agg(
        F.count_distinct("outcome").alias("outcomes"), F.count_distinct(F.array_join(F.sort_array(F.array_distinct("types")), "\0")).alias("sets"), (F.max(n) - F.min(n)).alias("range"),
        F.bool_or(F.col("outcome") == "unclear").alias("unclear"), (F.bool_or(F.col("outcome") == "mostly_achieved") & F.bool_or(F.col("outcome") == "partially_achieved")).alias("between"),
        F.max(n).alias("most"), F.count_if(n == 0).alias("without"), F.count("*").alias("repeats"),
    )
    short = r.select("session_id", F.explode(F.array_distinct("quotes")).alias("quote")).where((F.length("quote") < GENERIC_QUOTE) & (F.length("quote") > 0)).distinct()
    times = (F.length("all_text") - F.length(F.replace(F.col("all_text"), F.col("quote"), F.lit("")))) / F.length("quote")
    generic = short.join(sessions.select("session_id", "all_text"), "session_id").where(times > 1).select("session_id", F.lit(True).alias("generic")).distinct()
    j = sessions.select("session_id", "friction").join(by, "session_id", "left").join(generic, "session_id", "left")
    rules = (
        (F.col("outcomes") > 1) | (F.col("sets") > 1) | (F.col("range") >= 2),
        F.col("unclear") | F.col("between"),
        F.col("generic"),
        (F.col("friction") == 0) & (F.col("most") > 0),
        (F.col("friction") > 0) & (F.col("without") >= F.floor((F.col("repeats") + 1) / 2)),
    )
    return j.select("session_id", F.array_compact(F.array(*[F.when(rule, F.lit(name)) for rule, name in zip(rules, REASONS, strict=True)])).alias("reasons"))
