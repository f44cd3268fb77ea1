"""Exact nearest ranks of groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skeinlog.operators.similarity import _saved

CELLS = 1024


def nearest_rank(rows: DataFrame, key: str, value: str, share: float, cells: int = CELLS, most: int = 200) -> DataFrame:
    """(key, n, value): of each key's n values the one whose place is ceil(share * n), the first for share 0; null values don't count.

    Each round counts a key's values by `cells` cells of equal width between its bounds, with the least and the greatest value of each
    cell, and the cell with the rank gives the next bounds. These are values, so a round always splits what it looks at; counts are summed
    in part, and a key has `cells` rows at most, however many values it has. A null key is a key. NaN is an error."""
    x = F.col(value).cast("double")
    kept = rows.select(F.col(key).alias("k"), F.when(F.isnan(x), F.raise_error(F.lit(f"{value} is NaN")).cast("double")).otherwise(x).alias("x")).where("x is not null")
    bounds = kept.groupBy("k").agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    bounds = _saved(bounds.withColumn("rank", F.greatest(F.lit(1), F.ceil(F.lit(share) * F.col("n"))).cast("long")))
    settled = bounds.where("lo = hi")
    for _ in range(most):
        open_ = bounds.where("lo < hi").withColumnRenamed("k", "k2")
        if open_.isEmpty():
            return settled.select(F.col("k").alias(key), "n", F.col("lo").alias(value))
        inside = kept.join(open_, F.col("k").eqNullSafe(F.col("k2")) & F.col("x").between(F.col("lo"), F.col("hi")))
        half = (F.col("x") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2)  # halves, so that no difference is infinite
        cell = F.when(F.col("x") == F.col("hi"), cells - 1).when(F.col("x") == F.col("lo"), 0).otherwise(F.least(F.greatest(F.floor(half * cells), F.lit(0)), F.lit(cells - 1)))
        counts = inside.groupBy("k", "n", "rank", cell.cast("int").alias("cell")).agg(F.count("*").alias("m"), F.min("x").alias("lo"), F.max("x").alias("hi"))
        upto = F.sum("m").over(Window.partitionBy("k", "n", "rank").orderBy("cell"))
        at = counts.withColumn("upto", upto).where("rank <= upto and rank > upto - m")
        bounds = _saved(at.select("k", "n", "lo", "hi", (F.col("rank") - F.col("upto") + F.col("m")).alias("rank")))
        settled = settled.unionByName(bounds.where("lo = hi"))
    raise RuntimeError(f"ranks did not settle in {most} rounds")
