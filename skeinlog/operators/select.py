"""Selecting and numbering rows: budgets, newest and last rows, evidence ids, ranks, stratified samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def budgeted(rows: DataFrame, key: str, priority: str, ordinal: str, size: str, budget: int | Column, levels: Sequence[int] = (2, 3, 4)) -> DataFrame:
    """rows that fit the budget of their key, a number or a column. Priority 0 always stays. Each of levels in turn keeps its longest prefix by ordinal
    that fits what is left; then the next has its turn. All windows share one exchange by key."""
    by_key = Window.partitionBy(key)
    left = (budget if isinstance(budget, Column) else F.lit(budget)) - F.coalesce(F.sum(F.when(F.col(priority) == 0, F.col(size))).over(by_key), F.lit(0))
    run = F.sum(size).over(Window.partitionBy(key, priority).orderBy(ordinal).rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumns({"__run": run, "__left": left, "__keep": F.col(priority) == 0})
    for level in levels:
        fits = (F.col(priority) == level) & (F.col("__run") <= F.col("__left"))
        rows = rows.withColumn("__keep", F.col("__keep") | fits)
        rows = rows.withColumn("__left", F.col("__left") - F.coalesce(F.sum(F.when((F.col(priority) == level) & F.col("__keep"), F.col(size))).over(by_key), F.lit(0)))
    return rows.where("__keep").drop("__run", "__left", "__keep")


def newest(rows: DataFrame, keys: Sequence[str], at: str, then: str) -> DataFrame:
    """One row for each key: the greatest `at`, of equal ones the least `then`. Summed in part before the exchange."""
    order = F.struct(F.col(at), (-F.col(then)).alias("__then"))
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in keys]), order).alias("__r")).select(*keys, "__r.*")


def numbered(rows: DataFrame, repo: Sequence[str], order: Sequence[str], prefix: str) -> DataFrame:
    """rows with evidence_id: prefix and 1, 2, ... in order within repo."""
    n = F.row_number().over(Window.partitionBy(*repo).orderBy(*order))
    return rows.withColumn("evidence_id", F.concat(F.lit(prefix), n.cast("string")))


def rank_check(rows: DataFrame, key: str, rank: str) -> DataFrame:
    """(key, n, is_permutation): whether ranks are 1 to n, each once."""
    n = F.count("*")
    return rows.groupBy(key).agg(n.alias("n"), ((F.count_distinct(rank) == n) & (F.min(rank) == 1) & (F.max(rank) == n)).alias("is_permutation"))


def top_counts(rows: DataFrame, key: str, what: str, most: int) -> DataFrame:
    """(key, top): the most frequent values as `value:n`, frequent first, then by name."""
    counts = rows.groupBy(key, what).agg(F.count("*").alias("n"))
    entries = F.slice(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("m"), F.col(what).alias("v")))), 1, most)
    return counts.groupBy(key).agg(F.array_join(F.transform(entries, lambda e: F.concat(e["v"], F.lit(":"), (-e["m"]).cast("string"))), ",").alias("top"))


def curate(rows: DataFrame, key: str, cells: Sequence[tuple[str, Column, int]], outlier: Sequence[Column]) -> DataFrame:
    """(key, cell): the outlier first, then for each cell in order the first rows by key that fit and are not yet taken.

    A row can be taken by earlier cells only as often as these have places, so of each cell the first rows by key, as many as all
    places so far, are enough: one pass tags the rows with their cells and keeps those; the choice is then among a few rows."""
    top = rows.orderBy(*outlier, key).limit(1).select(key).collect()
    tags = F.array_compact(F.array(*[F.when(fits, F.lit(i)) for i, (_, fits, _) in enumerate(cells)]))
    places = [1]
    for _, _, quota in cells:
        places.append(places[-1] + quota)
    tagged = rows.select(key, F.explode(tags).alias("__cell"))
    nth = F.row_number().over(Window.partitionBy("__cell").orderBy(key))
    most = F.element_at(F.array(*[F.lit(n) for n in places[1:]]), F.col("__cell") + 1)
    first: dict[int, list] = {}
    for r in tagged.withColumn("__n", nth).where(F.col("__n") <= most).orderBy("__cell", "__n").collect() if cells else []:  # at most the sum of places
        first.setdefault(r["__cell"], []).append(r[key])
    taken = [(r[0], "outlier") for r in top]
    seen = {k for k, _ in taken}
    for i, (name, _, quota) in enumerate(cells):
        new = [k for k in first.get(i, []) if k not in seen][:quota]
        taken += [(k, name) for k in new]
        seen.update(new)
    kind = rows.schema[key].dataType.simpleString()
    return rows.sparkSession.createDataFrame(taken, f"`{key}` {kind}, cell string")
