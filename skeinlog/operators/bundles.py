"""Evidence of repositories as rows: frictions, preferences, successes and signals, each under an id of its own.

A row of evidence is (repo, id, kind, n, signal_kind, label, text, quote, file, session_ids, quote_pool); id is repo/F1, repo/P1, repo/S1
or repo/G1, as its kind has it, and quote_pool what may be quoted of it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skeinlog.operators import detect
from skeinlog.operators.repos import relative_file
from skeinlog.operators.similarity import _saved

ACHIEVED = ("fully_achieved", "mostly_achieved")
EVIDENCE = "repo string, id string, kind string, n bigint, signal_kind string, label string, text string, quote string, file string, session_ids array<string>, quote_pool array<string>"
_COLUMNS = [c.split()[0] for c in EVIDENCE.split(", ")]


def placed(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """rows with n: 1, 2, ... in order within keys, however many rows share them.

    Rows are dealt by ranges of keys and order and kept as a table with the range that each fell into; a range is numbered by itself, and
    begins behind the sum of those before it. Rows that are equal in keys and order are numbered as they come. A null key is a key."""
    spark = rows.sparkSession
    dealt = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys, *order)
    dealt = _saved(dealt.withColumn("__part", F.spark_partition_id()))
    before = F.sum("__m").over(Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    sums = dealt.groupBy(*keys, "__part").agg(F.count("*").alias("__m")).withColumn("__before", F.coalesce(before, F.lit(0)))
    sums = sums.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("__part").alias("__of"), "__before")
    on = F.col("__part") == F.col("__of")
    for k in keys:
        on &= F.col(k).eqNullSafe(F.col(f"__{k}"))
    here = F.row_number().over(Window.partitionBy(*keys, "__part").orderBy(*order))
    return dealt.withColumn("__here", here).join(sums, on).select(*rows.columns, (F.col("__here") + F.col("__before")).alias("n"))


def floored(analyses: DataFrame, least: int) -> DataFrame:
    """analyses of repositories that have `least` of them; those of no repository are left out."""
    named = analyses.where(F.coalesce("repo", F.lit("")) != "")
    many = named.groupBy("repo").agg(F.count("*").alias("__n")).where(F.col("__n") >= least).select("repo")
    return named.join(many, "repo", "left_semi").select(*analyses.columns)


def items(analyses: DataFrame) -> DataFrame:
    """The evidence F, P and S of analyses(repo, session_id, start, outcome, session_type, underlying_goal, brief_summary, friction,
    preferences), numbered by start, then session, then place in the session. Null or empty lists have no items. analyses are read twice,
    since rows are dealt by ranges; so they should be a table."""
    none = F.lit(None).cast("string")
    item = "struct<pos:int,kind:string,label:string,text:string,quote:string,file:string>"
    row = lambda *cells: F.struct(*[c.alias(n) for c, n in zip(cells, ("pos", "kind", "label", "text", "quote", "file"), strict=True)]).cast(item)
    listed = lambda name, of: F.coalesce(F.transform(name, of), F.array().cast(f"array<{item}>"))
    f = listed("friction", lambda i, pos: row(pos, F.lit("F"), i["type"], i["one_line"], i["quote"], i["file"]))
    p = listed("preferences", lambda i, pos: row(pos, F.lit("P"), none, i["rule"], i["quote"], none))
    done = row(F.lit(0), F.lit("S"), F.col("session_type"), F.concat_ws(" — ", F.nullif("underlying_goal", F.lit("")), F.nullif("brief_summary", F.lit(""))), none, none)
    s = F.when(F.col("outcome").isin(*ACHIEVED), F.array(done)).otherwise(F.array().cast(f"array<{item}>"))
    rows = analyses.select("repo", "session_id", "start", F.inline(F.concat(f, p, s)))
    rows = placed(rows.withColumn("file", relative_file(F.col("file"))), ("repo", "kind"), ("start", "session_id", "pos"))
    pool = F.when(F.coalesce("quote", F.lit("")) != "", F.array("quote")).otherwise(F.array().cast("array<string>"))
    return rows.withColumns({"id": F.concat("repo", F.lit("/"), "kind", F.col("n").cast("string")), "signal_kind": none, "session_ids": F.array("session_id"), "quote_pool": pool}).select(*_COLUMNS)


def signal_items(analyses: DataFrame) -> DataFrame:
    """The evidence G: the signals of each repository. Their details may be quoted."""
    clauses = analyses.select("repo", "session_id", "start", F.explode("directive_clauses").alias("c")).select("repo", "session_id", "start", "c.*")
    g = detect.signals(analyses, clauses)
    none = F.lit(None).cast("string")
    n = F.substring(F.col("id"), 2, 10).cast("long")
    return g.select("repo", F.concat("repo", F.lit("/"), "id").alias("id"), F.lit("G").alias("kind"), n.alias("n"), F.col("kind").alias("signal_kind"), F.col("kind").alias("label"), F.array_join("detail", "\n").alias("text"), none.alias("quote"), none.alias("file"), F.col("sessions").alias("session_ids"), F.col("detail").alias("quote_pool"))


def headers(analyses: DataFrame, evidence: DataFrame) -> DataFrame:
    """(repo, sessions, from_day, to_day, friction, prefs, success, signals, bytes) of each repository; bytes is what its evidence takes
    as lines of JSON, which is what a synthesizer has to read."""
    day = F.date_format("start", "yyyy-MM-dd")
    heads = analyses.groupBy("repo").agg(F.count("*").alias("sessions"), F.min(day).alias("from_day"), F.max(day).alias("to_day"))
    line = F.to_json(F.struct(*[c for c in _COLUMNS if c != "n"]))
    kinds = (("F", "friction"), ("P", "prefs"), ("S", "success"), ("G", "signals"))
    sizes = evidence.groupBy("repo").agg(*[F.count_if(F.col("kind") == k).alias(name) for k, name in kinds], F.sum(F.octet_length(line) + 1).alias("bytes"))
    return heads.join(sizes, "repo", "left").fillna(0, [name for _, name in kinds] + ["bytes"])
