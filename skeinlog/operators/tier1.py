"""First-tier gates of a run: recall, fabrication, leaks, churn. What wasn't measured is an error, never a pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinlog.operators.scoring import membership_churn, recall

# Shares beyond which a run fails, and beyond which it warns.
FABRICATION, CHURN = 0.15, 0.5
KINDS = ("opportunity", "preference", "friction")


def complete(expected: DataFrame, stored: DataFrame, key: str, what: str) -> DataFrame:
    """The rows of expected with those of stored by key, each of which must be there: a missing one is an error that names it when the
    row is read, so that no count of fewer rows can pass for all. A stored key that stands twice is an error as well."""
    s = stored.groupBy(key).agg(F.count("*").alias("__n"), F.any_value(F.struct(*[c for c in stored.columns if c != key])).alias("__s"))
    j = expected.join(s, key, "left")
    why = F.when(F.col("__n").isNull(), F.concat(F.lit(f"{what} missing: "), F.col(key).cast("string"))).when(F.col("__n") > 1, F.concat(F.lit(f"{what} stored twice: "), F.col(key).cast("string")))
    rest = [c for c in stored.columns if c != key]
    # the check is part of every value, so that no plan can prune it
    held = [F.when(why.isNotNull(), F.raise_error(why).cast(stored.schema[c].dataType)).otherwise(F.col(f"__s.{c}")).alias(c) for c in rest]
    return j.select(*[c for c in expected.columns if c not in rest], *held)


def gates(samples: DataFrame, outputs: DataFrame, probes: DataFrame, findings: DataFrame, dropped: DataFrame, items: DataFrame, rejections: int = 0) -> DataFrame:
    """One row of gates, with reasons (a run with one fails) and warnings.

    samples(sample, key, fresh) are those that the run made; outputs(key, checkable, drops, leaks, notes, downgrades, empty) what is
    stored of them: each must be there once. probes(kind, id, evidence_id), findings and dropped (sample, evidence_id), items as in
    membership_churn. A sample without checkable quotes has no rate. Churn is null without two fresh samples in a row. A run without
    samples has measured nothing and fails. Misses and suppressions are of any sample, each probe counted once."""
    spark = samples.sparkSession
    told = complete(samples, outputs, "key", "output")
    n = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
    rate = F.when(F.col("checkable") > 0, F.col("drops") / F.col("checkable"))
    one = told.agg(F.count("*").alias("samples"), F.coalesce(F.max(rate), F.lit(0.0)).alias("fabrication"), n("leaks"), n("notes"), n("downgrades"), F.sort_array(F.collect_list(F.when(F.col("empty"), F.col("sample")))).alias("empties"))
    numbers = [r.sample for r in samples.select("sample").distinct().orderBy("sample").collect()]  # a run has a handful
    none = spark.createDataFrame([], "sample bigint, kind string, id string, state string")
    state = recall(probes, findings, dropped, numbers) if numbers else none
    seen = state.groupBy("kind", "id").agg(F.bool_or(F.col("state") == "miss").alias("miss"), F.bool_or(F.col("state") == "suppressed").alias("held"))
    missed = lambda k: F.sort_array(F.collect_list(F.when(F.col("miss") & (F.col("kind") == k), F.col("id")))).alias(f"{k}_misses")
    recalled = seen.agg(*[missed(k) for k in KINDS], F.count_if("held").alias("suppressed"))
    churn = membership_churn(items, samples.select("sample", "fresh")).agg(F.avg("churn").alias("churn"), F.count("*").alias("fresh_pairs"))
    g = one.crossJoin(recalled).crossJoin(churn).withColumn("rejections", F.lit(rejections).cast("long"))  # three single rows
    say = lambda c, text, *a: F.when(c, F.format_string(text, *a))
    reasons = F.concat(
        F.transform("empties", lambda s: F.format_string("sample %d: empty output", s)),
        F.array_compact(F.array(
            say(F.col("samples") == 0, "no sample was measured"),
            say(F.col("fabrication") > FABRICATION, f"raw fabrication rate %.3f exceeds {FABRICATION:.2f}", "fabrication"),
            say(F.col("leaks") > 0, "%d privacy leak(s) in raw prose", "leaks"),
        )),
    )
    warnings = F.concat(
        F.array_compact(F.array(say(F.col("churn") > CHURN, f"membership churn %.2f exceeds {CHURN:.2f} across %d fresh pairs", "churn", "fresh_pairs"))),
        *[F.transform(f"{k}_misses", _named(k)) for k in KINDS],
        F.array_compact(F.array(
            say(F.col("suppressed") > 0, "%d recall floor(s) suppressed by a dropped citation", "suppressed"),
            say(F.col("notes") > 0, "%d validation note(s) across %d sample(s)", "notes", "samples"),
            say(F.col("downgrades") > 0, "%d adopted verdict(s) downgraded to unknown", "downgrades"),
        )),
    )
    return g.withColumns({"reasons": reasons, "warnings": warnings}).withColumn("passes", F.size("reasons") == 0).drop("empties")


def _named(kind: str):
    return lambda i: F.concat(F.lit(f"{kind} recall miss: "), i)
