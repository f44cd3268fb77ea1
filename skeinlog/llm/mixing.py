"""Mixing sources to target weights by Pareto order sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skeinlog.llm.common import table, text_of, without, words_in, written


def targets(totals: DataFrame, weights: Sequence[float], most: float) -> DataFrame:
    """totals (source, source_size), one row a source, with `target`.

    The level L at which sum(min(most * size, L * weight)) is the sum of all sizes is found in closed form: with sources ordered
    by size / weight, a prefix is full and the others share what is left. The table has a row for each source, no more.
    """
    every = Window.partitionBy()
    ranked = totals.withColumn("__r", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    ranked = ranked.withColumn("__w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("__r") % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("__cap", most * F.col("source_size"))
    order = Window.orderBy(F.col("source_size") / F.col("__w"), "__r")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    ranked = ranked.withColumns(
        {
            "__level": (F.sum("source_size").over(every) - F.coalesce(F.sum("__cap").over(before), F.lit(0.0)))
            / (F.sum("__w").over(every) - F.coalesce(F.sum("__w").over(before), F.lit(0.0))),
            "__n": F.row_number().over(order),
        }
    )
    fits = F.col("__level") * F.col("__w") <= F.col("__cap")
    level = F.min(F.when(fits, F.struct("__n", "__level"))).over(every)["__level"]
    target = F.least(F.col("__cap"), F.coalesce(level * F.col("__w"), F.col("__cap"))).cast("double")
    return ranked.withColumn("target", target).select("source", "source_size", "target")


def pareto_mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), most: float = 3, seed: int = 20, cells: int = 4096, closing: int = 8) -> DataFrame:
    """docs with size, source_size, target, copies and taken (copies times size).

    A document of a source with rate r = target / source_size has r as its expected number of copies: floor(r) whole copies are
    certain, and the rest, p = r - floor(r), is its inclusion probability in a Pareto order sample. Documents rank by
    (u / (1 - u)) / (p / (1 - p)), with u a hash of doc_id and seed. A source's sample is fixed in size by words: ranks are taken
    while they fit in what the source still needs; the gap that is left, smaller than the document at the border, is closed with up
    to `closing` further documents: the largest that fit, at last the one nearest to the gap, if it helps. It ends early where all
    gaps are under 0.05% of their targets.

    No group is sorted as a whole: ranks are dealt into `cells` cells, cells are summed, and only the cell at a source's border is
    sorted. What decides is a row for each source, so every document is judged where it lies.
    Null texts have size 0 and no part in the sample; a null source is a source of its own, the last; a null doc_id hashes like a
    value; rows equal in doc_id and text have ranks of their own, one after the other. Columns of docs with the names of new ones
    give way. An empty table gives an empty result.
    """
    ruled = without(docs, "size", "source_size", "target", "copies", "taken", "__u", "__id", "__twin", "__s").withColumns(
        {
            "size": words_in("text"),
            "__u": (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id"), 11) + 0.5) / float(2**53),
            "__id": F.xxhash64(F.lit(seed + 1), "doc_id", text_of("text")),
            "__twin": F.monotonically_increasing_id(),  # tells equal rows apart
        }
    )
    ruled = written(ruled, "ruled")  # as numbered, for good
    rows = written(ruled.select("source", "size", "__u", "__id", "__twin"), "mix")
    goal = written(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most), "targets")
    few = goal.count() <= 100_000  # else the join shuffles, and splits a source that is too large
    small = lambda df: F.broadcast(df) if few else df

    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    goal = goal.withColumn("__whole", whole).withColumn("__rest", F.col("target") - F.col("__whole") * F.col("source_size"))
    goal = goal.withColumn("__p", F.when(F.col("source_size") > 0, F.col("__rest") / F.col("source_size")).otherwise(0.0))
    goal = goal.withColumnRenamed("source", "__s")

    def ranked(df: DataFrame, by_source: DataFrame) -> DataFrame:
        df = df.join(small(by_source), F.col("source").eqNullSafe(F.col("__s")), "left")
        odds = F.col("__u") / (1 - F.col("__u")) / (F.col("__p") / (1 - F.col("__p")))
        return df.withColumns({"__q": F.when((F.col("__p") > 0) & (F.col("__p") < 1) & (F.col("size") > 0), odds), "__cell": F.floor(F.col("__u") * cells)})

    def joined(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
        return left.join(right, F.col("__s").eqNullSafe(F.col(key)), "left").drop(key)

    live = ranked(rows, goal).where("__q is not null")
    sums = live.groupBy("__s", "__rest", "__cell").agg(F.sum("size").alias("__sum"))
    sums = sums.withColumn("__upto", F.sum("__sum").over(Window.partitionBy("__s").orderBy("__cell")))
    edge = sums.where("__upto >= __rest").groupBy("__s").agg(F.min(F.struct("__cell", (F.col("__upto") - F.col("__sum")).alias("before"))).alias("e"))
    edge = edge.select(F.col("__s").alias("__k"), F.col("e.__cell").alias("__edge"), F.col("e.before").alias("__before"))
    goal = written(joined(goal, edge, "__k"), "edges")

    order = Window.partitionBy("__s").orderBy("__q", "__id", "__twin").rowsBetween(Window.unboundedPreceding, 0)
    border = ranked(rows, goal).where("__q is not null and __cell = __edge").withColumn("__run", F.col("__before") + F.sum("size").over(order))
    fits = F.when(F.col("__run") <= F.col("__rest"), F.struct(F.col("__q").alias("q"), F.col("__id").alias("id"), F.col("__twin").alias("twin"), F.col("__run").alias("run")))
    stop = border.groupBy("__s").agg(F.max(fits).alias("__stop")).select(F.col("__s").alias("__k"), "__stop")
    goal = written(joined(goal, stop, "__k"), "stops")

    here = F.struct(F.col("__q").alias("q"), F.col("__id").alias("id"), F.col("__twin").alias("twin"))
    up_to = F.struct(F.col("__stop.q").alias("q"), F.col("__stop.id").alias("id"), F.col("__stop.twin").alias("twin"))
    drawn = F.col("__q").isNotNull() & (
        F.col("__edge").isNull() | (F.col("__cell") < F.col("__edge")) | ((F.col("__cell") == F.col("__edge")) & F.col("__stop").isNotNull() & (here <= up_to))
    )
    goal = goal.withColumn("__gap", F.col("__rest") - F.coalesce(F.col("__stop.run"), F.col("__before"))).withColumn("__close", F.array().cast("array<bigint>"))
    drawn = drawn | (F.col("__q").isNotNull() & F.array_contains(F.coalesce("__close", F.array().cast("array<bigint>")), F.col("__twin")))
    off = F.abs(F.col("size") - F.col("__gap"))
    for k in range(closing):
        near = (off < F.col("__gap")) | (F.col("size") <= F.col("__gap")) if k == closing - 1 else F.col("size") <= F.col("__gap")
        spare = ranked(rows, goal).where(F.col("__q").isNotNull() & ~drawn & near)
        best = spare.groupBy("__s").agg(F.min(F.struct(off.alias("off"), F.col("__id").alias("id"), F.col("__twin").alias("twin"), F.col("size").alias("size"))).alias("__c"))
        goal = joined(goal, best.select(F.col("__s").alias("__k"), "__c"), "__k")
        goal = goal.withColumn("__gap", F.col("__gap") - F.coalesce("__c.size", F.lit(0)))
        goal = written(goal.withColumn("__close", F.when(F.col("__c").isNull(), F.col("__close")).otherwise(F.concat("__close", F.array("__c.twin")))).drop("__c"), "closing")
        if k < closing - 2 and not goal.where("__gap > 0.0005 * target").limit(1).count():
            break

    extra = F.when(drawn, 1).otherwise(0)
    whole = F.when(F.col("__p") >= 1, F.col("__whole") + 1).otherwise(F.col("__whole"))
    out = ranked(ruled, goal).withColumn("copies", (whole + extra).cast("long")).withColumn("taken", F.col("copies") * F.col("size"))
    return out.drop("__u", "__id", "__twin", "__s", "__whole", "__rest", "__p", "__q", "__cell", "__edge", "__before", "__stop", "__gap", "__close")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pareto_mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")
