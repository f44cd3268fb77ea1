"""Scoring of findings against rubrics: items, payloads, repeats, samples, targets, flips and the first-tier gates.

A rubric is a target; each sample of the synthesis is read by a matcher several times (repeats). Granularities are ordinals: 0 absent,
1 over-generalised, 2 partial, 3 full. All are tables: matches(target, sample, repeat, item_id, granularity, nuances, forbidden),
items(sample, item_id, text, session_ids, dropped, reason), rubrics(target, part, tier, status, pass_at, anchors, cap, rubric_hash) and
adjudications(key_hash, decision). Arrays hold the few samples, repeats or matches of one target, never rows of a population.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skeinlog.functions.text import MIN_QUOTE, fingerprint_text, key_of, normalise_ws, sha_hex
from skeinlog.operators.evals import WEIGHT, corroborate, status_of
from skeinlog.operators.similarity import _saved, similar_pairs

ABSENT, OVER, PARTIAL, FULL = range(4)
# Bars and kinds.
SAME_PRACTICE, CHURN_WARN, FABRICATION = 0.45, 0.5, 0.05
COUNTED = ("corroborated", "grounded", "no_anchors")
PROVISIONAL = ("first_pass_no_anchor", "flip")


def id_set(ids: Column) -> Column:
    """A hash of a set of session ids, whatever their order."""
    return sha_hex(F.concat(F.lit("idset\0"), F.array_join(F.transform(F.sort_array(F.array_distinct(ids)), lambda x: F.concat(x, F.lit("\0"))), "")))


def adjudication_key(target: Column, text: Column, ids: Column, rubric_hash: Column, trigger: Column) -> Column:
    """What a person's decision is filed under; spaces and case of the text don't matter."""
    return key_of(F.lit("adj"), target.cast("string"), fingerprint_text(F.coalesce(text, F.lit(""))), id_set(F.coalesce(ids, F.array().cast("array<string>"))), F.coalesce(rubric_hash, F.lit("")), trigger)


def median(values: Column) -> Column:
    """The lower middle of an array; null of an empty one."""
    return F.get(F.sort_array(values), F.greatest(((F.size(values) - 1) / 2).cast("int"), F.lit(0)))


def decided(values: Column, repeats: int) -> Column:
    """Whether one value already has more than half of all repeats, so that further reads can't move the median."""
    return F.exists(F.array_distinct(values), lambda v: 2 * F.size(F.filter(values, lambda x: x == v)) > repeats)


def scored_items(findings: DataFrame, dropped: DataFrame, evidence: DataFrame) -> DataFrame:
    """(sample, item_id, text, dropped, reason, quotes, session_ids, repos): findings(sample, rank, title, statement, quotes,
    evidence_ids) as finding/<rank>, dropped(sample, position, summary, reason, evidence_ids) as dropped/<position>; sessions and repos
    are those of the cited evidence(id, repo, session_ids); ids that nothing has add none."""
    a = findings.select("sample", F.concat(F.lit("finding/"), F.col("rank").cast("string")).alias("item_id"), F.concat("title", F.lit(". "), "statement").alias("text"), F.lit(False).alias("dropped"), F.lit(None).cast("string").alias("reason"), F.slice("quotes", 1, 2).alias("quotes"), "evidence_ids")
    b = dropped.select("sample", F.concat(F.lit("dropped/"), F.col("position").cast("string")).alias("item_id"), F.col("summary").alias("text"), F.lit(True).alias("dropped"), "reason", F.array().cast("array<string>").alias("quotes"), "evidence_ids")
    items = a.unionByName(b)
    cited = items.select("sample", "item_id", F.explode("evidence_ids").alias("id")).join(evidence.select("id", "repo", "session_ids"), "id")
    of = cited.groupBy("sample", "item_id").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("session_ids")))).alias("session_ids"), F.sort_array(F.collect_set("repo")).alias("repos"))
    empty = F.array().cast("array<string>")
    return items.drop("evidence_ids").join(of, ["sample", "item_id"], "left").withColumns({c: F.coalesce(c, empty) for c in ("session_ids", "repos")})


def payload(rubrics: DataFrame, items: DataFrame) -> DataFrame:
    """(target, sample, item_id, text): what a matcher is shown. items have a surface; findings are shown to all rubrics, others to
    rubrics of their surface or of either."""
    shown = F.when(F.col("surface").isin("theme", "recommendation"), F.array(F.lit("finding"), F.col("surface"))).otherwise(F.array(F.lit("finding"), F.lit("theme"), F.lit("recommendation")))
    return rubrics.select("target", F.explode(shown).alias("surface")).join(items.select("sample", "item_id", "text", "surface"), "surface").select("target", "sample", "item_id", "text")


def match_errors(matches: DataFrame, shown: DataFrame, rubrics: DataFrame) -> DataFrame:
    """(target, sample, repeat, item_id, error): matches that contradict what was shown; rubrics have n_nuances and n_forbidden."""
    known = shown.select("target", "sample", "item_id", F.lit(True).alias("known"))
    m = matches.join(known, ["target", "sample", "item_id"], "left").join(rubrics.select("target", "n_nuances", "n_forbidden"), "target", "left")
    error = (
        F.when(F.col("known").isNull(), "unknown item").when(~F.coalesce(F.col("granularity").isin(OVER, PARTIAL, FULL), F.lit(False)), "granularity")
        .when(~F.size("nuances").eqNullSafe(F.col("n_nuances")), "nuances").when(F.exists("forbidden", lambda i: (i < 0) | (i >= F.col("n_forbidden"))), "forbidden")
    )
    return m.select("target", "sample", "repeat", "item_id", error.alias("error")).where("error is not null")


def judged(matches: DataFrame, items: DataFrame, rubrics: DataFrame, adjudications: DataFrame | None = None) -> DataFrame:
    """matches with level, class, key_hash, applied and counted. A forbidden form makes a match over-generalised, a failed nuance makes a
    full one partial; what isn't corroborated counts only if a person accepted it, and what was dropped never counts.

    Items are dealt by sample and id and looked up part by part: a file's size says little of how much they take as rows, and sent whole
    they are held by each executor."""
    m = matches.join(items.select("sample", "item_id", "text", "session_ids", "dropped", "reason").hint("shuffle_hash"), ["sample", "item_id"])
    m = m.join(rubrics.select("target", "anchors", "cap", "rubric_hash"), "target")
    form = F.coalesce(F.size("forbidden"), F.lit(0)) > 0
    level = F.when(form, OVER).when((F.col("granularity") == FULL) & ~F.forall("nuances", lambda x: x), PARTIAL).otherwise(F.col("granularity")).cast("int")
    kind = corroborate(F.col("dropped"), F.lit(True), F.col("session_ids"), F.col("anchors"), F.col("cap"))
    m = m.withColumns({"level": level, "forbids": form & ~F.col("dropped"), "class": kind})
    m = m.withColumn("key_hash", adjudication_key(F.col("target"), F.col("text"), F.col("session_ids"), F.col("rubric_hash"), F.col("class")))
    m = _ruled(m, adjudications)
    applied = F.col("class").isin("anchor_mismatch", "size_cap") & F.coalesce(F.col("adjudicated") == "accept", F.lit(False))
    return m.withColumns({"applied": applied, "counted": F.col("class").isin(*COUNTED) | applied})


def _ruled(rows: DataFrame, adjudications: DataFrame | None) -> DataFrame:
    if adjudications is None:
        return rows.withColumn("adjudicated", F.lit(None).cast("string"))
    return rows.join(adjudications.select("key_hash", F.col("decision").alias("adjudicated")), "key_hash", "left")


def repeat_outcomes(of: DataFrame, grid: DataFrame, listed: bool = True) -> DataFrame:
    """(target, sample, repeat, level, class, item_id, text, session_ids, nuances, applied, n_sides, sides) for each row of grid(target,
    sample, repeat), so that a repeat without matches is absent. The best counted match decides: by level, nuances, corroboration, then the
    least item_id; one forbidden form of a shipped item caps the level. sides: matches that don't count but outrank the outcome, or were
    dropped; n_sides is their number. With listed=False there are no lists: then a repeat may have any number of matches.

    Matches are first counted by what they amount to, in numbers alone; only those that tie for the best are then looked at as a whole.
    The counts and the outcome are kept as tables."""
    keys = ("target", "sample", "repeat")
    passed = F.size(F.filter("nuances", lambda x: x))
    top = F.struct((-F.col("level")).alias("a"), (-passed).alias("b"), F.when(F.col("class") == "corroborated", 0).otherwise(1).alias("c"))
    of = of.withColumn("__top", F.when(F.col("counted"), top))
    sums = of.groupBy(*keys, "level", (F.col("class") == "dropped").alias("gone"), "__top").agg(F.bool_or("forbids").alias("cap"), F.count_if(~F.col("counted")).alias("n"))
    sums = _saved(sums.groupBy(*keys).agg(F.min("__top").alias("__top"), F.bool_or("cap").alias("cap"), F.collect_list(F.struct("level", "gone", "n")).alias("s")))
    what = F.struct("level", "class", "item_id", "text", "session_ids", "nuances", F.when(F.col("applied"), F.col("key_hash")).alias("applied"))
    best = of.join(sums.select(*keys, "__top"), [*keys, "__top"]).groupBy(*keys).agg(F.min_by(what, "item_id").alias("b"))
    out = grid.select(*keys).join(sums, [*keys], "left").join(best, [*keys], "left")
    level = F.coalesce("b.level", F.lit(ABSENT))
    out = out.withColumn("level", F.when(F.coalesce("cap", F.lit(False)), F.least(level, F.lit(OVER))).otherwise(level))
    n = F.aggregate(F.filter("s", lambda x: x["gone"] | (x["level"] > F.col("level"))), F.lit(0).cast("long"), lambda m, x: m + x["n"])
    rest = [F.col(f"b.{c}").alias(c) for c in ("class", "item_id", "text", "session_ids", "nuances", "applied")]
    out = _saved(out.select(*keys, "level", *rest, F.coalesce(n, F.lit(0)).cast("int").alias("n_sides")))
    if not listed:
        return out
    side = F.struct("level", "item_id", "class", "text", "session_ids", "reason")
    lists = of.where(~F.col("counted")).groupBy(*keys).agg(F.sort_array(F.collect_list(side)).alias("s"))
    out = out.join(lists, [*keys], "left")
    sides = F.filter(F.coalesce("s", F.array().cast(out.schema["s"].dataType)), lambda x: (x["class"] == "dropped") | (x["level"] > F.col("level")))
    return out.withColumn("sides", sides).drop("s")


def sample_outcomes(repeats: DataFrame) -> DataFrame:
    """One row for each target and sample: the median level of its repeats, the share and number of repeats, and the details of the first
    repeat that has the median."""
    details = [c for c in ("class", "item_id", "text", "session_ids", "nuances", "applied", "sides") if c in repeats.columns]
    r = repeats.groupBy("target", "sample").agg(F.sort_array(F.collect_list(F.struct("repeat", "level"))).alias("r"))
    mid = median(F.transform("r", lambda x: x["level"]))
    agree = F.size(F.filter("r", lambda x: x["level"] == F.col("mid")))
    first = F.get(F.filter("r", lambda x: x["level"] == F.col("mid")), 0)["repeat"]
    r = r.withColumn("mid", mid).select("target", "sample", F.col("mid").alias("level"), (agree / F.size("r")).alias("agreement"), F.size("r").alias("repeats"), first.alias("repeat"))
    return r.join(repeats.select("target", "sample", "repeat", *details), ["target", "sample", "repeat"]).drop("repeat")


def negative_violations(matches: DataFrame, items: DataFrame, repeats: int) -> DataFrame:
    """(target, sample, hits): negative rubrics that more than half of the repeats match on something that wasn't dropped."""
    m = matches.join(items.where("not dropped").select("sample", "item_id"), ["sample", "item_id"], "left_semi")
    return m.groupBy("target", "sample").agg(F.count_distinct("repeat").alias("hits")).where(F.col("hits") * 2 > repeats)


def target_verdicts(rubrics: DataFrame, samples: DataFrame, adjudications: DataFrame | None = None, passed_before: DataFrame | None = None) -> DataFrame:
    """A row for each rubric, also for one without samples, which is absent and never passes: level, nuance_median, agreement, passes,
    provisional, meets, hard_fail, the deciding sample's item, and triggers(type, key_hash, samples, adjudicated).

    A pass that was never seen before, of a target that has no anchors, is provisional until a person accepts it. Invalidated targets
    have no row; invalidated() lists them. Samples without sides, as of repeat_outcomes(listed=False), give no triggers of side matches."""
    rubrics = rubrics.where(F.coalesce("status", F.lit("")) != "invalidated")
    cols = [c for c in ("sample", "level", "class", "item_id", "text", "session_ids", "nuances", "applied", "sides") if c in samples.columns]
    s = samples.groupBy("target").agg(F.sort_array(F.collect_list(F.struct("sample", "level"))).alias("order"), F.map_from_entries(F.collect_list(F.struct("sample", F.struct(*cols)))).alias("by"))
    s = s.withColumn("ss", F.transform("order", lambda o: F.element_at("by", o["sample"]))).drop("order", "by")
    base = rubrics.join(s, "target", "left")
    if passed_before is None:
        base = base.withColumn("before", F.lit(False))
    else:
        base = base.join(passed_before.select("target", F.lit(True).alias("before")).distinct(), "target", "left").withColumn("before", F.coalesce("before", F.lit(False)))
    n = F.coalesce(F.size("ss"), F.lit(0))
    base = base.withColumns({"n": F.greatest(n, F.lit(0)), "level": F.coalesce(median(F.transform("ss", lambda x: x["level"])), F.lit(ABSENT))})
    base = base.withColumn("d", F.get(F.filter("ss", lambda x: x["level"] == F.col("level")), 0))
    would = (F.col("n") > 0) & (F.col("level") >= F.col("pass_at"))
    must, status = F.col("status") == "must_pass", F.col("status")
    ids = lambda keep: F.transform(F.filter("ss", keep), lambda x: x["sample"].cast("long"))
    none, nothing = F.lit(None).cast("string"), F.array().cast("array<bigint>")
    split = ids(lambda x: (x["level"] >= F.col("pass_at")) != would)
    ground = ids(lambda x: x["class"] == "grounded")
    kind = "struct<type:string,key_hash:string,samples:array<bigint>>"
    trigger = lambda t, key, on, when: F.when(when, F.struct(F.lit(t).alias("type"), key.alias("key_hash"), on.alias("samples")).cast(kind))
    key = lambda t: adjudication_key(F.col("target"), F.col("d.text"), F.col("d.session_ids"), F.col("rubric_hash"), F.lit(t))
    ratchet = (status.isin("expected_fail", "needs_reconfirmation") & would) | ((status == "expected_partial") & (F.col("level") == FULL))
    fixed = F.array_compact(F.array(
        trigger("sample_split", none, split, must & (F.size(split) > 0)),
        trigger("adjudication_applied", F.col("d.applied"), nothing, F.col("d.applied").isNotNull()),
        trigger("grounded_pass", none, ground, must & would & (F.col("tier") == "HIGH") & (F.size(ground) > 0)),
        trigger("first_pass_no_anchor", key("first_pass_no_anchor"), nothing, must & would & (F.size("anchors") == 0) & ~F.col("before")),
        trigger("ratchet_candidate", key("ratchet_candidate"), nothing, ratchet & F.col("d").isNotNull()),
        trigger("needs_reconfirmation", none, nothing, (status == "needs_reconfirmation") & (F.col("n") > 0)),
    ))
    none_there = F.array().cast(f"array<{kind}>")
    side = none_there if "sides" not in cols else F.transform(F.flatten(F.transform("ss", lambda x: x["sides"])), lambda x: F.struct(x["class"].alias("type"), adjudication_key(F.col("target"), x["text"], x["session_ids"], F.col("rubric_hash"), x["class"]).alias("key_hash"), nothing.alias("samples")).cast(kind))
    base = base.withColumn("t", F.concat(fixed, F.coalesce(F.array_distinct(side), none_there)))
    t = _ruled(base.select("target", F.explode("t").alias("t")).select("target", "t.*"), adjudications)
    t = t.groupBy("target").agg(F.sort_array(F.collect_list(F.struct("type", "key_hash", "samples", "adjudicated"))).alias("triggers"), F.bool_or((F.col("type") == "first_pass_no_anchor") & ~F.coalesce(F.col("adjudicated") == "accept", F.lit(False))).alias("held"))
    out = base.join(t, "target", "left").withColumn("held", F.coalesce("held", F.lit(False)))
    meets, hard = status_of(status, F.col("level"), F.col("pass_at"), F.col("tier"), F.col("held"))
    meets = F.when(F.col("n") == 0, status.isin("expected_fail", "needs_reconfirmation")).otherwise(meets)
    agree = F.size(F.filter("ss", lambda x: x["level"] == F.col("level"))) / F.nullif("n", F.lit(0))
    nuance = median(F.transform("ss", lambda x: F.greatest(F.size(F.filter(x["nuances"], lambda y: y)), F.lit(0))))
    return out.select(
        "target", "part", "tier", "status", "pass_at", "rubric_hash", "n", "level", nuance.alias("nuance_median"), agree.alias("agreement"), (must & would & ~F.col("held")).alias("passes"), (must & would & F.col("held")).alias("provisional"),
        meets.alias("meets"), hard.alias("hard_fail"), F.col("d.item_id").alias("item_id"), F.col("d.text").alias("text"), F.col("d.session_ids").alias("session_ids"),
        F.coalesce("triggers", F.array().cast("array<struct<type:string,key_hash:string,samples:array<bigint>,adjudicated:string>>")).alias("triggers"),
    )


def invalidated(rubrics: DataFrame) -> DataFrame:
    """(target): those that verdicts and all rates leave out."""
    return rubrics.where("status = 'invalidated'").select("target")


def effective(verdicts: DataFrame, adjudications: DataFrame | None = None) -> DataFrame:
    """(target, passes, level): committed verdicts under later decisions: a provisional fail whose provisional triggers were all accepted
    counts as a pass if its level reaches pass_at."""
    t = verdicts.select("target", F.explode("triggers").alias("t")).select("target", "t.type", "t.key_hash").where(F.col("type").isin(*PROVISIONAL))
    t = _ruled(t, adjudications).groupBy("target").agg(F.bool_and(F.coalesce(F.col("adjudicated") == "accept", F.lit(False))).alias("ok"))
    lifted = F.coalesce("ok", F.lit(True)) & (F.col("level") >= F.col("pass_at"))
    return verdicts.join(t, "target", "left").select("target", F.when(F.col("provisional"), lifted).otherwise(F.col("passes")).alias("passes"), "level")


def latest_equal(current: DataFrame, prior: DataFrame, same: list[str], at: str, maps: tuple[str, ...] = ()) -> DataFrame:
    """For each row of current, the prior row that equals it in all of `same` (nulls equal nulls, maps by their entries) and has the
    latest `at`, as column baseline; null without one."""
    plain = lambda df: F.to_json(F.struct(*[F.sort_array(F.map_entries(c)).alias(c) if c in maps else F.col(c) for c in same]), {"ignoreNullFields": "false"})  # noqa: E731, ARG005
    p = prior.withColumn("__k", plain(prior)).groupBy("__k").agg(F.max_by(F.struct(*prior.columns), at).alias("baseline"))
    return current.withColumn("__k", plain(current)).join(p, "__k", "left").drop("__k")


def flips(verdicts: DataFrame, baseline: DataFrame | None, adjudications: DataFrame | None = None) -> DataFrame:
    """verdicts with what changed since baseline (rows of target_verdicts): base_passes, base_level and flip (none, baseline_miss, flip).
    Without a baseline each miss shows once. A new pass is held back until a person accepts the flip; a new fail isn't."""
    if baseline is None:
        miss = ((F.col("status") == "must_pass") & ~F.col("passes")) | ((F.col("status") == "expected_partial") & ~F.col("meets"))
        return verdicts.withColumns({"base_passes": F.lit(None).cast("boolean"), "base_level": F.lit(None).cast("int"), "flip": F.when(miss, "baseline_miss").otherwise("none")})
    b = effective(baseline, adjudications).select("target", F.col("passes").alias("base_passes"), F.col("level").alias("base_level"))
    v = verdicts.join(b, "target", "left")
    moved = F.col("base_passes").isNotNull() & (F.col("base_passes") != F.col("passes"))
    up = F.col("passes")
    key = adjudication_key(F.col("target"), F.when(up, F.col("text")), F.when(up, F.col("session_ids")), F.col("rubric_hash"), F.lit("flip"))
    v = _ruled(v.withColumns({"flip": F.when(moved, "flip").otherwise("none"), "key_hash": F.when(moved, key)}), adjudications)
    held = moved & up & ~F.coalesce(F.col("adjudicated") == "accept", F.lit(False))
    triggers = F.when(moved, F.array_append("triggers", F.struct(F.lit("flip").alias("type"), "key_hash", F.array().cast("array<bigint>").alias("samples"), "adjudicated"))).otherwise(F.col("triggers"))
    v = v.withColumns({"__held": held, "triggers": triggers}).drop("key_hash", "adjudicated")
    return v.withColumns({"passes": up & ~F.col("__held"), "provisional": F.col("provisional") | F.col("__held"), "meets": F.col("meets") & ~F.col("__held")}).drop("__held")


def delta(verdicts: DataFrame, baseline: DataFrame, adjudications: DataFrame | None = None) -> DataFrame:
    """(target, from, to, pass_changed): targets of both whose pass or level differ from what the baseline now amounts to."""
    b = effective(baseline, adjudications).select("target", F.col("passes").alias("p"), F.col("level").alias("from"))
    j = verdicts.select("target", "passes", F.col("level").alias("to")).join(b, "target")
    return j.where((F.col("p") != F.col("passes")) | (F.col("from") != F.col("to"))).select("target", "from", "to", (F.col("p") != F.col("passes")).alias("pass_changed"))


def summary(verdicts: DataFrame) -> DataFrame:
    """One row: how many must_pass targets were scored and passed, their weighted recall, and the lists of the others."""
    must = F.col("status") == "must_pass"
    weight = F.element_at(F.create_map(*[x for k, w in WEIGHT.items() for x in (F.lit(k), F.lit(float(w)))]), F.col("tier"))
    listed = lambda when: F.sort_array(F.collect_list(F.when(when, F.col("target"))))
    total, got = F.coalesce(F.sum(F.when(must, weight)), F.lit(0.0)), F.coalesce(F.sum(F.when(must & F.col("passes"), weight)), F.lit(0.0))
    partial = (F.col("status") == "expected_partial") & ~F.col("hard_fail")
    return verdicts.agg(
        F.count_if(must).alias("scored"), F.count_if(must & F.col("passes")).alias("passed"), total.alias("weight"), F.when(total > 0, got / total).otherwise(0.0).alias("weighted_recall"),
        listed(F.col("hard_fail")).alias("hard_fails"), listed(F.col("provisional")).alias("provisional"), listed(partial & (F.col("level") == FULL)).alias("partial_full"),
        listed(partial & (F.col("level") < FULL)).alias("partial_met"), F.coalesce(F.bool_or("hard_fail"), F.lit(False)).alias("hard_fail"),
    )


def depth_regressions(verdicts: DataFrame, watermarks: DataFrame) -> DataFrame:
    """(target, nuance_median, watermark): targets with samples whose median of passed nuances fell below their watermark."""
    return verdicts.join(watermarks, "target").where((F.col("n") > 0) & (F.col("nuance_median") < F.col("watermark"))).select("target", "nuance_median", "watermark")


def recall_probes(signals: DataFrame, friction: DataFrame, clusters: DataFrame, least: int = 3) -> DataFrame:
    """(kind, id, evidence_id), a row for each id that a probe holds: signals(repo, id, magnitude) of `least` or more, each repo that has
    friction(repo, id), and clusters(cluster, evidence_id) of preferences of `least` items or more."""
    named = F.concat_ws("/", "repo", "id")
    a = signals.where(F.col("magnitude") >= least).select(F.lit("opportunity").alias("kind"), named.alias("id"), named.alias("evidence_id"))
    b = friction.select(F.lit("friction").alias("kind"), F.col("repo").alias("id"), named.alias("evidence_id"))
    big = clusters.groupBy("cluster").agg(F.count_distinct("evidence_id").alias("n"), F.array_join(F.sort_array(F.collect_set("evidence_id")), ",").alias("id")).where(F.col("n") >= least)
    c = clusters.join(big, "cluster").select(F.lit("preference").alias("kind"), "id", "evidence_id")
    return a.unionByName(b).unionByName(c).distinct()


def recall(probes: DataFrame, findings: DataFrame, dropped: DataFrame, samples: Sequence[int]) -> DataFrame:
    """(sample, kind, id, state): cited where a finding cites any id of the probe, else suppressed where a dropped entry does, else miss.
    findings and dropped are (sample, evidence_id); samples has those that cite nothing too, a run has a handful."""
    cites = lambda df, name: probes.join(df.select("sample", "evidence_id"), "evidence_id").select("sample", "kind", "id", F.lit(True).alias(name)).distinct()
    grid = probes.select("kind", "id").distinct().withColumn("sample", F.explode(F.array(*map(F.lit, samples))))
    j = grid.join(cites(findings, "f"), ["sample", "kind", "id"], "left").join(cites(dropped, "d"), ["sample", "kind", "id"], "left")
    return j.select("sample", "kind", "id", F.when(F.col("f").isNotNull(), "cited").when(F.col("d").isNotNull(), "suppressed").otherwise("miss").alias("state"))


def unengaged_drops(dropped: DataFrame, findings: DataFrame, state: DataFrame, probes: DataFrame) -> DataFrame:
    """(sample, position, floors): dropped entries that a person should rule on: no finding cites what they name, or a probe's only hold
    is theirs. dropped(sample, position, evidence_id), findings(sample, evidence_id), state of recall."""
    held = dropped.join(probes, "evidence_id").join(state.where("state = 'suppressed'"), ["sample", "kind", "id"]).groupBy("sample", "position").agg(F.sort_array(F.collect_set(F.concat_ws(" floor ", "kind", "id"))).alias("floors"))
    seen = dropped.join(findings.select("sample", "evidence_id").distinct(), ["sample", "evidence_id"], "left_semi").select("sample", "position", F.lit(True).alias("seen")).distinct()
    all_ = dropped.select("sample", "position").distinct().join(held, ["sample", "position"], "left").join(seen, ["sample", "position"], "left")
    return all_.where("floors is not null or seen is null").select("sample", "position", F.coalesce("floors", F.array().cast("array<string>")).alias("floors"))


def same_practice(items: DataFrame, bar: float = SAME_PRACTICE) -> DataFrame:
    """(sample, a, b): pairs of findings of one sample whose statements say the same practice."""
    s = items.where("not dropped").select(F.col("sample").cast("string").alias("within"), F.concat_ws("\0", F.col("sample").cast("string"), "item_id").alias("key"), "text")
    p = similar_pairs(s, "key", "text", bar, within="within")
    at = lambda c: F.substring_index(c, "\0", -1)
    return p.select(F.substring_index("a", "\0", 1).alias("sample"), at("a").alias("a"), at("b").alias("b"))


def membership_churn(items: DataFrame, samples: DataFrame, bar: float = SAME_PRACTICE) -> DataFrame:
    """(sample, next, churn) for each two samples(sample, fresh) in a row that are fresh: 1 less the mean session Jaccard of the first
    one's findings and their most similar findings of the next; one without a similar one adds 0. items have ord, their place."""
    w = Window.orderBy("sample")  # a run has a handful of samples
    pairs = samples.select("sample", "fresh", F.lead("sample").over(w).alias("next"), F.lead("fresh").over(w).alias("then")).where("fresh and then").select("sample", "next")
    f = items.where("not dropped").select("sample", "ord", "text", "session_ids")
    side = lambda of, name: pairs.join(f.withColumnRenamed("sample", of), of).select(F.col("sample").cast("string").alias("within"), F.lit(name).alias("side"), "ord", "text", "session_ids")
    both = side("sample", "a").unionByName(side("next", "b")).withColumn("key", F.concat_ws("\0", "within", "side", F.col("ord").cast("string")))
    p = similar_pairs(both, "key", "text", bar, within="within")
    part = lambda c, i: F.get(F.split(c, "\0"), i)
    p = p.where((part("a", 1) == "a") & (part("b", 1) == "b")).withColumn("sim", F.col("inter") / (F.col("size_a") + F.col("size_b") - F.col("inter")))
    of = lambda n: both.select(F.col("key").alias(n), F.col("session_ids").alias(f"s{n}"), F.col("ord").alias(f"o{n}"))
    p = p.join(of("a"), "a").join(of("b"), "b")
    union = F.size(F.array_union("sa", "sb"))
    jac = F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect("sa", "sb")) / union)
    best = p.groupBy("a").agg(F.max_by(jac, F.struct("sim", "ob")).alias("jac"))
    got = both.where("side = 'a'").join(best, both["key"] == best["a"], "left").groupBy("within").agg((1 - F.sum(F.coalesce("jac", F.lit(0.0))) / F.count("*")).alias("churn"))
    return pairs.join(got, pairs["sample"].cast("string") == got["within"], "left").select("sample", "next", F.coalesce("churn", F.lit(0.0)).alias("churn"))


def probe_results(reads: DataFrame) -> DataFrame:
    """(probe, median, passes) of reads(probe, repeat, level): recall needs partial or more, negative_recall anything, near_miss at most
    an over-generalised match."""
    m = reads.groupBy("probe", "repeat").agg(F.max("level").alias("level")).groupBy("probe").agg(median(F.collect_list("level")).alias("median"))
    ok = F.when(F.col("probe") == "recall", F.col("median") >= PARTIAL).when(F.col("probe") == "negative_recall", F.col("median") > ABSENT).when(F.col("probe") == "near_miss", F.col("median") <= OVER)
    return m.withColumn("passes", F.coalesce(ok, F.lit(False)))


def valid_quotes(rows: DataFrame, corpora: DataFrame, preference: bool) -> DataFrame:
    """rows(session_id, quote, ...) held against corpora(session_id, user_text, all_text). A friction stays in any case: a quote that isn't
    in all that was said is cleared and flagged in quote_unverified. A preference stays only if the user's own words have its quote."""
    body, quote = F.coalesce(F.col("user_text" if preference else "all_text"), F.lit("")), F.coalesce("quote", F.lit(""))
    there = (F.length(quote) >= MIN_QUOTE) & (body.contains(quote) | normalise_ws(body).contains(normalise_ws(quote)))
    j = rows.join(corpora, "session_id", "left").withColumn("__there", there)
    if preference:
        return j.where("__there").select(*rows.columns)
    bad = (quote != "") & ~F.col("__there")
    return j.withColumns({"quote_unverified": bad, "quote": F.when(bad, "").otherwise(quote)}).select(*rows.columns, "quote_unverified")
