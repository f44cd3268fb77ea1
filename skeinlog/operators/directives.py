"""Directive clauses: what users tell a session to do, cut into clauses and counted by session."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skeinlog.functions import text as T


def clause_rows(said: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
    """(keys, line, pos, clause, norm): clauses of a turn that are long enough, outside of fences, pasted logs and placeholders of images.
    keys tell turns apart; the window is over the lines of one turn."""
    lines = said.select(*keys, F.posexplode(F.split(T.trim_ws(F.col(text)), "\n")).alias("line", "s")).withColumn("s", T.trim_ws(F.col("s")))
    fence = F.col("s").startswith("```")
    parity = F.sum(fence.cast("int")).over(Window.partitionBy(*keys).orderBy("line").rowsBetween(Window.unboundedPreceding, 0)) % 2
    kept = lines.withColumns({"fence": fence, "inside": parity}).where(~F.col("fence") & (F.col("inside") == 0))
    bad = F.col("s").rlike(r"^\d{4}-\d{2}-\d{2}[T ]") | ~F.col("s").rlike("[A-Za-z]") | F.col("s").startswith("[image:")
    cut = kept.where(~bad).select(*keys, "line", F.posexplode(T.clauses(F.col("s"))).alias("pos", "c"))
    clause = cut.withColumn("clause", T.sanitise(F.col("c"))).drop("c").withColumn("norm", T.normal_clause(F.col("clause")))
    return clause.where((F.size(T.tokens(F.col("clause"))) >= T.MIN_CLAUSE_TOKENS) & (F.length("norm") >= T.MIN_CLAUSE))


def by_session(said: DataFrame, session: str, turn: str, text: str = "text") -> DataFrame:
    """(session, norm, n, first_turn, exemplar): how often a session's user says a clause, how often of these in the first turn, and its
    first form."""
    opening = said.groupBy(session).agg(F.min(turn).alias("__opening"))
    first = F.count_if(F.col(turn) == F.col("__opening")).alias("first_turn")
    rows = clause_rows(said, [session, turn], text).join(opening, session)
    return rows.groupBy(session, "norm").agg(F.count("*").alias("n"), first, F.min_by("clause", F.struct(turn, "line", "pos")).alias("exemplar"))
