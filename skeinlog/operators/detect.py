"""Signals of a repository: tails, mechanical friction, and directives that users type again and again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skeinlog.operators.signals import density
from skeinlog.operators.similarity import _saved, clusters, similar_pairs

# Named modes, kinds of signal in their order, floors and bars.
NAMED_MODES = ("edit_before_read", "wrong_cwd", "permission", "symlink_edit")
KINDS = ("high_read", "friction_density", "unskilled_toil", "mechanical_friction", "retyped_directives", "retyped_kickoffs")
FLOOR, MOST_DETAIL, MOST_SIGNATURES, RETYPED, KICKOFF = 3, 8, 3, 0.6, 0.5


def _in_order(rows: DataFrame, order: Column, value: str, *keys: str) -> DataFrame:
    """(keys, value) as an array in order; a repository's signal is a list of its sessions, so its size is what the signal says."""
    return rows.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct(order.alias("o"), F.col(value).alias("v")))), lambda x: x["v"]).alias(value))


def tails(sessions: DataFrame) -> DataFrame:
    """(repo, kind, session_id): sessions at or above the 90th percentile (nearest rank) of their repo, and above 0: in files read, in
    friction per turn, and in files read by single tasks without a skill."""
    reads = F.coalesce(F.element_at(F.coalesce("tool_counts", F.create_map().cast("map<string,bigint>")), "Read"), F.lit(0)).cast("long")
    s = sessions.withColumns({"__reads": reads, "__density": density(F.col("interrupts") + F.col("rejections") + F.col("tool_errors"), F.col("assistant_turns"))})
    cut = s.groupBy("repo").agg(*[F.expr(f"percentile_disc(0.9) within group (order by {c})").alias(f"{c}_p90") for c in ("__reads", "__density")])
    s = s.join(cut, "repo")
    much = (F.col("__reads") >= F.col("__reads_p90")) & (F.col("__reads") > 0)
    rough = (F.col("__density") >= F.col("__density_p90")) & (F.col("__density") > 0)
    toil = much & (F.col("session_type") == "single_task") & (F.coalesce(F.size("skills"), F.lit(0)) <= 0)
    kinds = F.array_compact(F.array(F.when(much, "high_read"), F.when(rough, "friction_density"), F.when(toil, "unskilled_toil")))
    return s.select("repo", F.explode(kinds).alias("kind"), "session_id", "start")


def mechanical(sessions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members (repo, session_id, start): sessions with an error of a named mode. Details (repo, detail): `mode — exemplar` of each mode,
    frequent first, its exemplar that of the earliest session, then the three most frequent signatures of other errors."""
    modes = sessions.select("repo", "session_id", "start", F.explode("mechanical_friction").alias("mode", "n"), "mechanical_exemplars").where(F.col("mode").isin(*NAMED_MODES) & (F.col("n") > 0))
    shown = F.nullif(F.element_at("mechanical_exemplars", F.col("mode")), F.lit(""))
    by_mode = modes.groupBy("repo", "mode").agg(F.sum("n").alias("n"), F.min_by(shown, F.when(shown.isNotNull(), F.struct("start", "session_id"))).alias("shown"))
    line = by_mode.select("repo", F.struct(F.lit(0).alias("k"), (-F.col("n")).alias("m"), F.col("mode").alias("t")).alias("o"), F.concat_ws(" — ", "mode", "shown").alias("detail"))
    other = sessions.select("repo", F.explode("other_error_signatures").alias("signature", "n")).groupBy("repo", "signature").agg(F.sum("n").alias("n"))
    nth = F.row_number().over(Window.partitionBy("repo").orderBy(F.desc("n"), "signature"))
    top = _in_order(other.withColumn("nth", nth).where(F.col("nth") <= MOST_SIGNATURES), F.col("nth"), "signature", "repo")
    last = top.select("repo", F.struct(F.lit(1).alias("k"), F.lit(0).cast("long").alias("m"), F.lit("").alias("t")).alias("o"), F.concat(F.lit("residual signatures: "), F.array_join("signature", "; ")).alias("detail"))
    details = _in_order(line.unionByName(last), F.col("o"), "detail", "repo").select("repo", F.slice("detail", 1, MOST_DETAIL).alias("detail"))
    return modes.select("repo", "session_id", "start").distinct(), details


def retyping(clauses: DataFrame, bar: float = RETYPED, least: int = FLOOR) -> tuple[DataFrame, DataFrame]:
    """Clusters of clauses(repo, session_id, start, norm, n, first_turn, exemplar) that several sessions of a repo say.

    Equal norms are one form; forms whose token multisets are similar are linked, and links join to clusters (single link). Returns
    clusters (repo, cluster, rep, exemplar, occurrences, first, sessions, kickoff) of `least` sessions or more, rep being the most
    frequent form (of equal ones the least), and their members (repo, cluster, session_id)."""
    c = _saved(clauses.withColumn("id", F.concat_ws("\0", "repo", "norm")))  # read three times
    forms = c.groupBy("id", "repo", "norm").agg(F.sum("n").alias("n"), F.sum("first_turn").alias("first"), F.min_by("exemplar", F.struct("start", "session_id")).alias("exemplar"))
    joined = clusters(similar_pairs(forms, "id", "norm", bar, within="repo")).withColumnRenamed("cluster", "c")
    forms = forms.join(joined, "id", "left").withColumn("cluster", F.coalesce("c", "id")).drop("c")
    members = c.select("id", "session_id").join(forms.select("id", "repo", "cluster"), "id").select("repo", "cluster", "session_id").distinct()
    best = F.min_by(F.struct("norm", "exemplar"), F.struct((-F.col("n")).alias("m"), "norm"))
    got = forms.groupBy("repo", "cluster").agg(best.alias("b"), F.sum("n").alias("occurrences"), F.sum("first").alias("first"))
    sessions = members.groupBy("repo", "cluster").agg(F.count("*").alias("sessions"), F.sha2(F.array_join(F.sort_array(F.collect_set("session_id")), "\0"), 256).alias("set_key"))
    got = got.join(sessions.where(F.col("sessions") >= least), ["repo", "cluster"])
    got = got.select("repo", "cluster", F.col("b.norm").alias("rep"), F.col("b.exemplar").alias("exemplar"), "occurrences", "first", "sessions", "set_key", (F.col("first") > KICKOFF * F.col("occurrences")).alias("kickoff"))
    return got, members.join(got.select("repo", "cluster"), ["repo", "cluster"], "left_semi")


def signals(sessions: DataFrame, clauses: DataFrame) -> DataFrame:
    """(repo, id, kind, magnitude, sessions, detail): the signals of each repo with three sessions or more, G1, G2, ... in the order of
    KINDS; sessions by start. sessions: rows of session_facts with repo and session_type; clauses as in retyping."""
    sessions = _saved(sessions)  # each kind reads them
    hit, details = mechanical(sessions)
    found, members = retyping(clauses)
    kind = F.when(F.col("kickoff"), "retyped_kickoffs").otherwise("retyped_directives")
    retyped = members.join(found.select("repo", "cluster", kind.alias("kind")), ["repo", "cluster"]).select("repo", "kind", "session_id").distinct().join(sessions.select("repo", "session_id", "start"), ["repo", "session_id"])
    all_ = tails(sessions).unionByName(hit.withColumn("kind", F.lit("mechanical_friction"))).unionByName(retyped)
    grouped = _in_order(all_, F.struct("start", "session_id"), "session_id", "repo", "kind").withColumn("magnitude", F.size("session_id")).where(F.col("magnitude") >= FLOOR)
    one = Window.partitionBy("repo", "kind", "set_key").orderBy("rep")  # clusters of the same sessions show one exemplar
    shown = found.withColumn("kind", kind).withColumn("nth", F.row_number().over(one)).where("nth = 1")
    shown = _in_order(shown, F.struct((-F.col("sessions")).alias("m"), "rep"), "exemplar", "repo", "kind").select("repo", "kind", F.slice("exemplar", 1, MOST_DETAIL).alias("detail"))
    shown = shown.unionByName(details.withColumn("kind", F.lit("mechanical_friction")))
    place = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    n = F.row_number().over(Window.partitionBy("repo").orderBy(place))
    out = grouped.withColumn("id", F.concat(F.lit("G"), n.cast("string"))).join(shown, ["repo", "kind"], "left")
    return out.select("repo", "id", "kind", "magnitude", F.col("session_id").alias("sessions"), F.coalesce("detail", F.array().cast("array<string>")).alias("detail"))
