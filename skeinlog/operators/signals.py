"""Evidence of a repository: tails by nearest-rank percentile, rollups, floors, due-ness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def density(friction: Column, turns: Column) -> Column:
    return friction / F.greatest(turns, F.lit(1))


def tail(sessions: DataFrame, repo: str, session: str, value: str, share: float = 0.9, least: int = 3) -> DataFrame:
    """(repo, p90, magnitude, sessions): those at or above the nearest-rank percentile of their repo, and above 0; only repos with
    `least` of them. The percentile is summed in part and joined back, so that no repo is sorted in one task."""
    cut = sessions.groupBy(repo).agg(F.expr(f"percentile_disc({share}) within group (order by {value})").alias("p90"))
    high = sessions.join(cut, repo).where((F.col(value) >= F.col("p90")) & (F.col(value) > 0))
    grouped = high.groupBy(repo).agg(F.first("p90").alias("p90"), F.count("*").alias("magnitude"), F.array_join(F.sort_array(F.collect_list(session)), ",").alias("sessions"))
    return grouped.where(F.col("magnitude") >= least)


def floored(rows: DataFrame, repo: str, least: int, *aggregates: Column) -> DataFrame:
    """Groups by repo, without rows of no repo and repos of fewer than `least` rows."""
    return rows.where(F.col(repo).isNotNull() & (F.col(repo) != "")).groupBy(repo).agg(F.count("*").alias("n"), *aggregates).where(F.col("n") >= least)


def due(counts: DataFrame, repo: str, fresh: str, total: str, floor: int, threshold: int, since_days: Column | None = None, cadence_days: int = 0) -> DataFrame:
    """One row: fresh sessions over the repos that reach the floor, which repos contribute, and whether it is due: the fresh ones reach
    the threshold, and the last snapshot is at least cadence_days old (since_days null: there is none)."""
    ok = counts.where(F.col(total) >= floor)
    names = F.array_join(F.sort_array(F.collect_list(F.when(F.col(fresh) > 0, F.col(repo)))), ",")
    elapsed = F.lit(True) if since_days is None else since_days.isNull() | (since_days >= cadence_days)
    return ok.agg(F.coalesce(F.sum(fresh), F.lit(0)).alias("fresh"), names.alias("contributing")).withColumn("due", (F.col("fresh") >= threshold) & elapsed)
