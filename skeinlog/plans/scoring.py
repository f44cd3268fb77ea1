"""Queries over scores and signals. Parts stand for findings, suppliers for targets, orders for samples, lines for a matcher's reads."""

from __future__ import annotations

from pyspark.sql import functions as F

from skeinlog.operators import detect, scoring
from skeinlog.sources.tables import table

SQL: dict[str, str] = {}


def _items(spark, d):
    p = table(spark, d, "part")
    row = p.select(F.col("p_partkey").cast("string").alias("item_id"), F.col("p_name").alias("text"), F.array(F.concat(F.lit("s"), (F.col("p_size") % 5).cast("string"))).alias("session_ids"), (F.col("p_partkey") % 7 == 0).alias("dropped"), F.lit("because").alias("reason"))
    return row.select(F.explode(F.expr("array(0L, 1L, 2L)")).alias("sample"), "*")


def _rubrics(spark, d):
    t = spark.range(40).withColumnRenamed("id", "target")
    of = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.col("target") % len(values) + 1).cast("int"))
    anchors = F.when(F.col("target") % 2 == 0, F.array(F.concat(F.lit("s"), (F.col("target") % 5).cast("string")))).otherwise(F.array().cast("array<string>"))
    return t.select("target", F.lit("regression").alias("part"), of(("HIGH", "MODERATE", "MEDIUM")).alias("tier"), of(("must_pass", "expected_partial", "must_pass", "expected_fail", "needs_reconfirmation")).alias("status"), (2 + F.col("target") % 2).cast("int").alias("pass_at"), anchors.alias("anchors"), F.lit(0).alias("cap"), F.lit("h").alias("rubric_hash"))


def _matches(spark, d):
    li = table(spark, d, "lineitem")
    return li.select((F.col("l_suppkey") % 38).alias("target"), (F.col("l_orderkey") % 3).alias("sample"), (F.col("l_linenumber") % 3).cast("long").alias("repeat"), F.col("l_partkey").cast("string").alias("item_id"), (F.col("l_quantity").cast("int") % 4).alias("granularity"), F.array(F.col("l_discount") > 0.03, F.col("l_tax") > 0.02).alias("nuances"), F.when((F.col("l_returnflag") == "R") & (F.col("l_partkey") % 5 == 0), F.array(F.lit(0))).otherwise(F.array().cast("array<int>")).alias("forbidden")).where("granularity > 0")


def _repeats(spark, d):
    grid = spark.range(38 * 9).select((F.col("id") % 38).alias("target"), (F.floor(F.col("id") / 38) % 3).alias("sample"), F.floor(F.col("id") / 114).alias("repeat"))
    return scoring.repeat_outcomes(scoring.judged(_matches(spark, d), _items(spark, d), _rubrics(spark, d)), grid, listed=False)


_SQL = """
m as (select l_suppkey % 38 as target, l_orderkey % 3 as sample, l_linenumber % 3 as repeat, l_partkey, l_quantity::int % 4 as g, l_discount > 0.03 as n1, l_tax > 0.02 as n2,
  l_returnflag = 'R' and l_partkey % 5 = 0 as form, l_partkey % 7 = 0 as dropped, p_size % 5 as s from lineitem join part on p_partkey = l_partkey
  where l_quantity::int % 4 > 0),
j as (select *, case when form then 1 when g = 3 and not (n1 and n2) then 2 else g end as level, n1::int + n2::int as passed,
  case when dropped then 'dropped' when target % 2 = 1 then 'no_anchors' when s = target % 5 then 'corroborated' else 'anchor_mismatch' end as class from m),
q as (select range % 38 as target, range // 38 % 3 as sample, range // 114 as repeat from range(342)),
b as (select *, row_number() over (partition by target, sample, repeat order by level desc, passed desc, (class = 'corroborated')::int desc, l_partkey::varchar) as nth
  from j where class in ('corroborated', 'no_anchors')),
c as (select target, sample, repeat, bool_or(form and not dropped) as cap from j group by 1, 2, 3),
r0 as (select q.*, case when coalesce(cap, false) then least(coalesce(b.level, 0), 1) else coalesce(b.level, 0) end as level, b.class, b.l_partkey::varchar as item_id, b.passed
  from q left join b on b.target = q.target and b.sample = q.sample and b.repeat = q.repeat and nth = 1
  left join c on c.target = q.target and c.sample = q.sample and c.repeat = q.repeat),
r as (select r0.*, (select count(*) from j where j.target = r0.target and j.sample = r0.sample and j.repeat = r0.repeat
  and j.class in ('dropped', 'anchor_mismatch') and (j.class = 'dropped' or j.level > r0.level)) as sides from r0),
o as (select target, sample, quantile_disc(level, 0.5) as level from r group by 1, 2),
s as (select o.target, o.sample, o.level, count(*) filter (where r.level = o.level) / count(*)::double as agreement, count(*) as repeats,
  arg_min(coalesce(r.class, '-'), r.repeat) filter (where r.level = o.level) as class, arg_min(coalesce(r.item_id, '-'), r.repeat) filter (where r.level = o.level) as item_id,
  arg_min(coalesce(r.passed, 0), r.repeat) filter (where r.level = o.level) as passed from o join r using (target, sample) group by 1, 2, 3),
u as (select range as target, (['HIGH', 'MODERATE', 'MEDIUM'])[range % 3 + 1] as tier, (['must_pass', 'expected_partial', 'must_pass', 'expected_fail', 'needs_reconfirmation'])[range % 5 + 1] as status,
  2 + range % 2 as pass_at from range(40)),
v0 as (select u.*, count(s.sample) as n, coalesce(quantile_disc(s.level, 0.5), 0) as level, quantile_disc(s.passed, 0.5) as nuance_median from u left join s using (target) group by all),
v1 as (select *, n > 0 and level >= pass_at as would from v0),
v as (select *, status = 'must_pass' and would and target % 2 = 1 as held from v1)"""


def score_repeats(spark, d):
    """What each read of a target and sample amounts to."""
    r = _repeats(spark, d)
    return r.select("target", "sample", "repeat", "level", F.coalesce("class", F.lit("-")).alias("class"), F.coalesce("item_id", F.lit("-")).alias("item_id"), F.col("n_sides").alias("sides"))


SQL["score_repeats"] = f"with {_SQL} select target, sample, repeat, level, coalesce(class, '-') as class, coalesce(item_id, '-') as item_id, sides from r"


def score_samples(spark, d):
    s = scoring.sample_outcomes(_repeats(spark, d))
    return s.select("target", "sample", "level", F.round("agreement", 9).alias("agreement"), "repeats", F.coalesce("class", F.lit("-")).alias("class"), F.coalesce("item_id", F.lit("-")).alias("item_id"))


SQL["score_samples"] = f"with {_SQL} select target, sample, level, round(agreement, 9) as agreement, repeats, class, item_id from s"


def _verdicts(spark, d):
    return scoring.target_verdicts(_rubrics(spark, d), scoring.sample_outcomes(_repeats(spark, d)))


def score_targets(spark, d):
    """Each target's verdict; two targets have no samples and so never pass."""
    v = _verdicts(spark, d)
    return v.select("target", "n", "level", F.coalesce("nuance_median", F.lit(-1)).alias("nuance_median"), "passes", "provisional", "meets", "hard_fail")


SQL["score_targets"] = f"""with {_SQL}
select target, n, level, coalesce(nuance_median, -1) as nuance_median, status = 'must_pass' and would and not held as passes, held as provisional,
  case when n = 0 then status in ('expected_fail', 'needs_reconfirmation') when status = 'must_pass' then would and not held when status = 'expected_partial' then level > 0 else true end as meets,
  case when status = 'must_pass' then tier = 'HIGH' and not level >= pass_at when status = 'expected_partial' then level = 0 else false end as hard_fail from v"""


def score_triggers(spark, d):
    """How many targets show each trigger, apart from those of side matches."""
    t = _verdicts(spark, d).select("target", F.explode("triggers").alias("t")).select("target", "t.type").where("type not in ('dropped', 'anchor_mismatch')")
    return t.groupBy("type").agg(F.count("*").alias("n"), F.min("target").alias("first"))


SQL["score_triggers"] = f"""with {_SQL},
x as (select target, unnest([case when status = 'must_pass' and exists (select 1 from s where s.target = v.target and (s.level >= pass_at) <> would) then 'sample_split' end,
  case when held then 'first_pass_no_anchor' end, case when n > 0 and ((status in ('expected_fail', 'needs_reconfirmation') and would) or (status = 'expected_partial' and level = 3)) then 'ratchet_candidate' end,
  case when status = 'needs_reconfirmation' and n > 0 then 'needs_reconfirmation' end]) as type from v)
select type, count(*) as n, min(target) as first from x where type is not null group by 1"""


def score_summary(spark, d):
    s = scoring.summary(_verdicts(spark, d))
    return s.select("scored", "passed", "weight", F.round("weighted_recall", 9).alias("weighted_recall"), F.size("hard_fails").alias("hard_fails"), F.size("provisional").alias("provisional"), F.size("partial_full").alias("partial_full"), F.size("partial_met").alias("partial_met"))


SQL["score_summary"] = f"""with {_SQL}, w as (select *, case tier when 'HIGH' then 3.0 else 1.0 end as w, status = 'must_pass' as must, status = 'must_pass' and would and not held as ok,
  case when status = 'must_pass' then tier = 'HIGH' and not would when status = 'expected_partial' then level = 0 else false end as hard from v)
select count(*) filter (where must) as scored, count(*) filter (where ok) as passed, sum(w) filter (where must)::double as weight, round(coalesce(sum(w) filter (where ok), 0)::double / sum(w) filter (where must)::double, 9) as weighted_recall,
  count(*) filter (where hard) as hard_fails, count(*) filter (where held) as provisional, count(*) filter (where status = 'expected_partial' and not hard and level = 3) as partial_full,
  count(*) filter (where status = 'expected_partial' and not hard and level < 3) as partial_met from w"""


def baseline_asof(spark, d):
    """For each order, the latest order of the same status and priority; orders stand for verdicts, status and priority for their tuple."""
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", F.create_map(F.lit("p"), F.col("o_orderpriority")).alias("models"), F.struct("o_orderdate", "o_orderkey").alias("at"))
    got = scoring.latest_equal(o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 2 = 1"), ["o_orderstatus", "models"], "at", ("models",))
    return got.select("o_orderkey", F.col("baseline.o_orderkey").alias("baseline"))


SQL["baseline_asof"] = """
with p as (select o_orderstatus, o_orderpriority, arg_max(o_orderkey, (o_orderdate, o_orderkey)) as baseline from orders where o_orderkey % 2 = 1 group by 1, 2)
select o_orderkey, baseline from orders left join p using (o_orderstatus, o_orderpriority) where o_orderkey % 2 = 0"""


def match_validation(spark, d):
    """Reads that contradict what was shown: parts that weren't, levels and numbers of nuances that can't be."""
    m = _matches(spark, d).withColumns({"granularity": F.when(F.col("item_id").cast("int") % 11 == 0, 0).otherwise(F.col("granularity")), "nuances": F.when(F.col("item_id").cast("int") % 13 == 0, F.slice("nuances", 1, 1)).otherwise(F.col("nuances"))})
    rubrics = _rubrics(spark, d).withColumns({"n_nuances": F.lit(2), "n_forbidden": (F.col("target") % 3).cast("int"), "surface": F.when(F.col("target") % 4 == 0, "theme").otherwise("either")})
    items = _items(spark, d).withColumn("surface", F.when(F.col("item_id").cast("int") % 6 == 0, "recommendation").otherwise("finding"))
    return scoring.match_errors(m, scoring.payload(rubrics, items), rubrics).groupBy("target", "error").agg(F.count("*").alias("n"))


SQL["match_validation"] = f"""with {_SQL},
e as (select target, case when l_partkey % 6 = 0 and target % 4 = 0 then 'unknown item' when l_partkey % 11 = 0 then 'granularity' when l_partkey % 13 = 0 then 'nuances'
  when form and target % 3 = 0 then 'forbidden' end as error from m)
select target, error, count(*) as n from e where error is not null group by 1, 2"""


def negative_reads(spark, d):
    return scoring.negative_violations(_matches(spark, d), _items(spark, d), 3)


SQL["negative_reads"] = f"with {_SQL} select target, sample, count(distinct repeat) as hits from m where not dropped group by 1, 2 having count(distinct repeat) * 2 > 3"


def recall_states(spark, d):
    """Parts stand for evidence, brands for probes, orders for findings and dropped entries."""
    probes = table(spark, d, "part").select(F.element_at(F.array(F.lit("friction"), F.lit("opportunity")), (F.col("p_size") % 2 + 1).cast("int")).alias("kind"), F.col("p_brand").alias("id"), F.col("p_partkey").alias("evidence_id"))
    li = table(spark, d, "lineitem").select((F.col("l_orderkey") % 3).alias("sample"), F.col("l_partkey").alias("evidence_id"), "l_returnflag")
    return scoring.recall(probes, li.where("l_returnflag = 'R' and evidence_id % 5 = 0"), li.where("l_returnflag = 'A' and evidence_id % 3 = 0"), range(3))


SQL["recall_states"] = """
with p as (select distinct case p_size % 2 when 0 then 'friction' else 'opportunity' end as kind, p_brand as id, p_partkey from part),
l as (select l_orderkey % 3 as sample, l_partkey, l_returnflag from lineitem),
g as (select range as sample, kind, id from range(3), (select distinct kind, id from p))
select sample, kind, id, case when exists (select 1 from l join p on p.p_partkey = l.l_partkey where l.sample = g.sample and p.kind = g.kind and p.id = g.id and l_returnflag = 'R' and l.l_partkey % 5 = 0) then 'cited'
  when exists (select 1 from l join p on p.p_partkey = l.l_partkey where l.sample = g.sample and p.kind = g.kind and p.id = g.id and l_returnflag = 'A' and l.l_partkey % 3 = 0) then 'suppressed' else 'miss' end as state from g"""


def signal_tails(spark, d):
    """Users as sessions of seven repositories: many views, much friction, many views by single tasks without a skill."""
    e = table(spark, d, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "view").alias("reads"), F.count_if(F.col("event_type") == "error").alias("tool_errors"), F.count_if(F.col("event_type") == "click").alias("assistant_turns"), F.min("ts").alias("start"))
    s = e.select((F.col("user_id") % 7).alias("repo"), F.col("user_id").alias("session_id"), "start", F.create_map(F.lit("Read"), F.col("reads")).alias("tool_counts"), F.lit(0).alias("interrupts"), F.lit(0).alias("rejections"), "tool_errors", "assistant_turns", F.when(F.col("user_id") % 2 == 0, "single_task").otherwise("mixed").alias("session_type"), F.when(F.col("user_id") % 3 == 0, F.array(F.lit("k"))).otherwise(F.array().cast("array<string>")).alias("skills"))
    return detect.tails(s).select("repo", "kind", "session_id")


SQL["signal_tails"] = """
with e as (select user_id, user_id % 7 as repo, count(*) filter (where event_type = 'view') as r, count(*) filter (where event_type = 'error') / greatest(count(*) filter (where event_type = 'click'), 1)::double as f from events group by 1),
p as (select repo, quantile_disc(r, 0.9) as r90, quantile_disc(f, 0.9) as f90 from e group by 1), j as (select * from e join p using (repo)),
k as (select repo, user_id, unnest([case when r >= r90 and r > 0 then 'high_read' end, case when f >= f90 and f > 0 then 'friction_density' end,
  case when r >= r90 and r > 0 and user_id % 2 = 0 and user_id % 3 <> 0 then 'unskilled_toil' end]) as kind from j)
select repo, kind, user_id as session_id from k where kind is not null"""


def _retyped(spark, d):
    j = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    norm = F.concat_ws(" ", "p_name", F.lower("p_type"), F.lower("p_brand"))
    return j.groupBy((F.col("p_partkey") % 40).cast("string").alias("repo"), (F.col("l_orderkey") % 30).alias("session_id"), norm.alias("norm")).agg(F.min("l_shipdate").alias("start"), F.count("*").alias("n"), F.count_if(F.col("l_linenumber") <= 3).alias("first_turn"), F.max("p_name").alias("exemplar"))


def retyped_clusters(spark, d):
    """Directives that sessions of a repository share: forms linked at 0.6, joined to clusters, of three sessions or more."""
    found, _ = detect.retyping(_retyped(spark, d))
    return found.select("repo", "rep", "occurrences", "first", "sessions", "kickoff")


SQL["retyped_clusters"] = r"""
with recursive c as (select (p_partkey % 40)::varchar as repo, l_orderkey % 30 as session_id, p_name || ' ' || lower(p_type) || ' ' || lower(p_brand) as norm, count(*) as n, count(*) filter (where l_linenumber <= 3) as f
  from lineitem join part on p_partkey = l_partkey group by 1, 2, 3),
f as (select repo, norm, sum(n) as n, sum(f) as f from c group by 1, 2),
w as (select repo, norm, regexp_replace(unnest(string_split(norm, ' ')), '^[^\p{L}\p{Nd}]+|[^\p{L}\p{Nd}]+$', '', 'g') as t from f),
g as (select repo, norm, t, count(*) as k from w where t <> '' group by 1, 2, 3), z as (select repo, norm, sum(k) as size from g group by 1, 2),
i as (select a.repo, a.norm as x, b.norm as y, sum(least(a.k, b.k)) as inter from g a join g b on a.repo = b.repo and a.t = b.t and a.norm <> b.norm group by 1, 2, 3),
e as (select i.repo, x, y from i join z p on p.repo = i.repo and p.norm = x join z q on q.repo = i.repo and q.norm = y where 5 * inter >= 3 * (p.size + q.size - inter)),
h(repo, x, y) as (select repo, norm, norm from f union select h.repo, h.x, e.y from h join e on e.repo = h.repo and e.x = h.y),
k as (select repo, x as norm, min(y) as cluster from h group by 1, 2),
s as (select repo, cluster, count(distinct session_id) as sessions from c join k using (repo, norm) group by 1, 2)
select repo, (list(norm order by f.n desc, norm))[1] as rep, sum(f.n)::bigint as occurrences, sum(f.f)::bigint as first, any_value(sessions) as sessions, sum(f.f) > 0.5 * sum(f.n) as kickoff
from f join k using (repo, norm) join s using (repo, cluster) where sessions >= 3 group by repo, cluster"""


def mechanical_details(spark, d):
    """Lines on friction by mode: event types stand for modes, props for signatures of other errors."""
    e = table(spark, d, "events")
    mode = F.when(F.col("event_type") == "view", "wrong_cwd").when(F.col("event_type") == "click", "permission").otherwise("other")
    by = e.groupBy("user_id", mode.alias("mode")).agg(F.count("*").alias("n"))
    modes = by.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("mode", "n"))).alias("mechanical_friction"))
    signs = e.where("event_type = 'error'").groupBy("user_id", "props").agg(F.count("*").alias("n")).groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("props", "n"))).alias("other_error_signatures"))
    start = e.groupBy("user_id").agg(F.min("ts").alias("start"))
    s = modes.join(signs, "user_id", "left").join(start, "user_id").select((F.col("user_id") % 5).alias("repo"), F.col("user_id").alias("session_id"), "start", "mechanical_friction", "other_error_signatures", F.create_map(F.lit("wrong_cwd"), F.concat(F.lit("in "), F.col("user_id").cast("string"))).alias("mechanical_exemplars"))
    members, details = detect.mechanical(s)
    n = members.groupBy("repo").agg(F.count("*").alias("members"))
    return details.join(n, "repo").select("repo", "members", F.array_join("detail", " | ").alias("detail"))


SQL["mechanical_details"] = """
with e as (select user_id, user_id % 5 as repo, ts, props, event_type, case event_type when 'view' then 'wrong_cwd' when 'click' then 'permission' end as mode from events),
st as (select user_id, min(ts) as start from e group by 1),
m as (select repo, mode, count(*) as n, case mode when 'wrong_cwd' then ' — in ' || arg_min(user_id, (start, user_id)) else '' end as shown from e join st using (user_id) where mode is not null group by 1, 2),
o as (select repo, props, count(*) as n, row_number() over (partition by repo order by count(*) desc, props) as nth from e where event_type = 'error' group by 1, 2),
l as (select repo, 0 as k, -n as m, mode as t, mode || shown as line from m union all
  select repo, 1, 0, '', 'residual signatures: ' || string_agg(props, '; ' order by nth) from o where nth <= 3 group by 1),
c as (select repo, count(distinct user_id) as members from e where mode is not null group by 1)
select repo, members, string_agg(line, ' | ' order by k, m, t) as detail from l join c using (repo) group by 1, 2"""

QUERIES = {name: globals()[name] for name in SQL}
