"""Queries over conversations and events: sessions, texts, tools, state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skeinlog.functions import classify as K
from skeinlog.functions import text as T
from skeinlog.operators import directives, evals, select, signals
from skeinlog.sources.tables import table
from skeinlog.streaming import incremental

NOW = "2024-02-01 00:00:00"  # a fixed now, so that results don't depend on the day
SQL: dict[str, str] = {}


def _micros(c: str):
    """Microseconds since 1970 of a time without zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(c))


def _users(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").where("role = 'user'").withColumn("normal", T.fingerprint_text(F.col("text")))


_TRIVIAL_SQL = "(normal in (" + ", ".join(f"'{t}'" for t in K.TRIVIAL) + ") or (normal like '@%' and normal not like '% %'))"
_USERS_SQL = r"(select *, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) as normal from conversations where role = 'user')"


def session_turn_stats(spark, d):
    c = table(spark, d, "conversations")
    of = lambda r: F.count_if(F.col("role") == r)
    real = (F.col("role") == "user") & (K.text_class(F.col("text")) == "user_turn")
    return c.groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.count_if(real).alias("user_turns"), of("assistant").alias("assistant_turns"), of("system").alias("system_turns"), F.sum(F.octet_length("text")).alias("text_bytes"), F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"))


SQL["session_turn_stats"] = """
select conv_id, count(*) as n_turns, count(*) filter (where role = 'user' and trim(text) <> '') as user_turns,
  count(*) filter (where role = 'assistant') as assistant_turns, count(*) filter (where role = 'system') as system_turns,
  sum(strlen(text))::bigint as text_bytes, min(turn) as first_turn, max(turn) as last_turn from conversations group by conv_id"""


def session_last_nonempty(spark, d):
    c = table(spark, d, "conversations").where("text <> ''")
    return c.groupBy("conv_id").agg(F.max_by("role", "turn").alias("last_role"), F.max_by(T.shorten(F.col("text"), T.OPENING), "turn").alias("last_text"))


SQL["session_last_nonempty"] = """
select conv_id, arg_max(role, turn) as last_role, arg_max(case when length(text) > 280 then text[1:280] || '…' else text end, turn) as last_text
from conversations where text <> '' group by conv_id"""


def first_genuine_turn(spark, d):
    u = _users(spark, d).where(K.text_class(F.col("text")) == "user_turn")
    return u.groupBy("conv_id").agg(F.min("turn").alias("turn"), F.min_by(T.shorten(T.normalise_ws(F.col("text")), T.OPENING), "turn").alias("opening"))


SQL["first_genuine_turn"] = rf"""
with u as (select conv_id, turn, trim(regexp_replace(text, '\s+', ' ', 'g')) as t from {_USERS_SQL} where normal <> '')
select conv_id, min(turn) as turn, arg_min(case when length(t) > 280 then t[1:280] || '…' else t end, turn) as opening from u group by conv_id"""


def user_turn_fingerprints(spark, d):
    u = _users(spark, d).where((K.text_class(F.col("text")) == "user_turn") & ~K.is_trivial(F.col("normal")))
    rows = F.sort_array(F.collect_list(F.struct("turn", T.fingerprint(F.col("normal")).alias("fp"))))
    return u.groupBy("conv_id").agg(F.count("*").alias("n"), F.array_join(F.transform(rows, lambda r: r["fp"]), ",").alias("fingerprints"))


SQL["user_turn_fingerprints"] = f"""
select conv_id, count(*) as n, string_agg(sha1(normal)[1:16], ',' order by turn, sha1(normal)[1:16]) as fingerprints
from {_USERS_SQL} where normal <> '' and not {_TRIVIAL_SQL} group by conv_id"""


def clause_tokens(spark, d):
    words = _users(spark, d).select(F.explode(T.tokens(F.lower("text"))).alias("token"))
    return words.groupBy("token").agg(F.count("*").alias("n"))


SQL["clause_tokens"] = rf"""
with w as (select unnest(regexp_split_to_array(lower(text), '\s+')) as w from {_USERS_SQL}),
t as (select regexp_replace(w, '^[^\p{{L}}\p{{Nd}}]+|[^\p{{L}}\p{{Nd}}]+$', '', 'g') as token from w)
select token, count(*) as n from t where token <> '' group by token"""


def _said(spark, d):
    return _users(spark, d).where(K.text_class(F.col("text")) == "user_turn")


def _clauses(spark, d):
    return directives.clause_rows(_said(spark, d), ["conv_id", "turn"])


_CLAUSES_SQL = rf"""
l as (select conv_id, turn, u.line, trim(u.s, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) as s from {_USERS_SQL}, unnest(string_split(text, chr(10))) with ordinality as u(s, line)),
f as (select *, s like '```%' as fence, sum((s like '```%')::int) over (partition by conv_id, turn order by line) % 2 as inside from l),
k as (select * from f where not fence and inside = 0 and not regexp_matches(s, '^\d{{4}}-\d{{2}}-\d{{2}}[T ]')
  and regexp_matches(s, '[A-Za-z]') and s not like '[image:%'),
c as (select conv_id, turn, line, u.pos, trim(u.x) as c from k,
  unnest(string_split(regexp_replace(s, '([.!?])\s+', '\1' || chr(10), 'g'), chr(10))) with ordinality as u(x, pos)),
s as (select *, trim(regexp_replace(regexp_replace(regexp_replace(c, '(?i)\bsc-\d+\b', '[ticket]', 'g'),
  '\$HOME[^\s]*|/(?:Users|home|private|var|tmp)/[^\s]*|[^\s]*\.worktrees/[^\s]*', '[path]', 'g'), '\s+', ' ', 'g'))[1:160] as clause from c where c <> ''),
n as (select *, regexp_replace(lower(trim(regexp_replace(clause, '\s+', ' ', 'g'))), '[.!?;:, ]+$', '') as norm,
  len(list_filter(list_transform(regexp_split_to_array(clause, '\s+'), lambda t: regexp_replace(t, '^[^\p{{L}}\p{{Nd}}]+|[^\p{{L}}\p{{Nd}}]+$', '', 'g')), lambda t: t <> '')) as nt from s),
clauses as (select * from n where nt >= 4 and length(norm) >= 16)"""


def directive_clauses(spark, d):
    """first_turn: how often a clause is in the first turn of the user."""
    return directives.by_session(_said(spark, d), "conv_id", "turn")


SQL["directive_clauses"] = f"""with {_CLAUSES_SQL}, o as (select conv_id, min(turn) as opening from {_USERS_SQL} where normal <> '' group by conv_id)
select conv_id, norm, count(*) as n, count(*) filter (where turn = opening) as first_turn, arg_min(clause, (turn, line, pos)) as exemplar from clauses join o using (conv_id) group by conv_id, norm"""


def repeated_directives(spark, d):
    """Clauses that several sessions repeat."""
    c = _clauses(spark, d)
    return c.groupBy("norm").agg(F.count_distinct("conv_id").alias("sessions"), F.count("*").alias("n"), F.min("conv_id").alias("first_session")).where("sessions >= 2")


SQL["repeated_directives"] = f"""with {_CLAUSES_SQL}
select norm, count(distinct conv_id) as sessions, count(*) as n, min(conv_id) as first_session from clauses group by norm having count(distinct conv_id) >= 2"""


def reduced_rows_budgeted(spark, d):
    size = F.octet_length("text") + 1
    priority = F.when(F.col("role") == "user", 0).when(F.col("role") == "system", 4).when(size > 1000, 3).otherwise(2)
    rows = table(spark, d, "conversations").select("conv_id", "turn", "role", priority.alias("priority"), size.cast("long").alias("bytes"))
    return select.budgeted(rows, "conv_id", "priority", "turn", "bytes", 6000)


SQL["reduced_rows_budgeted"] = """
with r as (select conv_id, turn, role, (strlen(text) + 1)::bigint as bytes,
  (case when role = 'user' then 0 when role = 'system' then 4 when strlen(text) + 1 > 1000 then 3 else 2 end)::int as priority from conversations),
q as (select *, sum(bytes) over (partition by conv_id, priority order by turn rows unbounded preceding) as run,
  6000 - coalesce(sum(bytes) filter (where priority = 0) over (partition by conv_id), 0) as l2 from r),
k2 as (select *, l2 - coalesce(sum(bytes) filter (where priority = 2 and run <= l2) over (partition by conv_id), 0) as l3 from q),
k3 as (select *, l3 - coalesce(sum(bytes) filter (where priority = 3 and run <= l3) over (partition by conv_id), 0) as l4 from k2)
select conv_id, turn, role, priority, bytes from k3
where priority = 0 or (priority = 2 and run <= l2) or (priority = 3 and run <= l3) or (priority = 4 and run <= l4)"""


def substantial_gate(spark, d):
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.count_if(F.col("role") == "assistant").alias("assistant_turns"), F.count_if(K.is_interrupt(F.col("text")) | K.is_rejection(F.col("text"))).alias("friction"))
    return c.withColumn("substantial", K.substantial(F.col("assistant_turns"), F.col("friction"), 3))


SQL["substantial_gate"] = """
select *, assistant_turns >= 3 or friction > 0 as substantial from (
select conv_id, count(*) filter (where role = 'assistant') as assistant_turns,
  count(*) filter (where text like '[Request interrupted by user%' or text like 'The user doesn''t want to proceed with this tool use%') as friction
from conversations group by conv_id)"""


def length_bucket_hist(spark, d):
    c = table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("turns"))
    return c.groupBy(K.length_bucket(F.col("turns")).alias("bucket")).agg(F.count("*").alias("sessions"), F.sum("turns").alias("turns"))


SQL["length_bucket_hist"] = """
with c as (select user_id, count(*) as turns from events group by user_id)
select case when turns < 5 then 'short' when turns < 50 then 'medium' else 'long' end as bucket, count(*) as sessions, sum(turns)::bigint as turns from c group by 1"""


def shape_hist(spark, d):
    c = table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("turns"), F.count_if(F.col("event_type") == "purchase").alias("writes"))
    return c.groupBy(K.shape(F.col("writes"), F.col("turns")).alias("shape")).agg(F.count("*").alias("sessions"))


SQL["shape_hist"] = """
with c as (select user_id, count(*) as turns, count(*) filter (where event_type = 'purchase') as writes from events group by user_id)
select case when writes > 0 then 'implementation' when turns >= 10 then 'exploration' else 'quick_question' end as shape, count(*) as sessions from c group by 1"""


def session_wall_clock_ns(spark, d):
    e = table(spark, d, "events").groupBy("user_id").agg(F.min_by("ts", "event_id").alias("a"), F.max_by("ts", "event_id").alias("b"))
    return e.select("user_id", ((_micros("b") - _micros("a")) * 1000).alias("wall_clock_ns"))


SQL["session_wall_clock_ns"] = "select user_id, (epoch_us(arg_max(ts, event_id)) - epoch_us(arg_min(ts, event_id))) * 1000 as wall_clock_ns from events group by user_id"


def tool_counts_top8(spark, d):
    return select.top_counts(table(spark, d, "events"), "user_id", "event_type", 8)


SQL["tool_counts_top8"] = """
with c as (select user_id, event_type, count(*) as n from events group by 1, 2),
r as (select *, row_number() over (partition by user_id order by n desc, event_type) as k from c)
select user_id, string_agg(event_type || ':' || n, ',' order by k) as top from r where k <= 8 group by user_id"""


def _sessions(spark, d):
    e = table(spark, d, "events")
    s = e.groupBy("user_id").agg(F.count("*").alias("turns"), F.count_if(F.col("event_type") == "error").alias("errors"), F.count_if(F.col("event_type") == "view").alias("reads"))
    return s.select((F.col("user_id") % 3).alias("repo"), F.lpad(F.col("user_id").cast("string"), 8, "0").alias("session"), "turns", "errors", "reads", signals.density(F.col("errors"), F.col("turns") - F.col("errors")).alias("density"))


_SESSIONS_SQL = """s as (select user_id % 3 as repo, lpad(user_id::varchar, 8, '0') as session, count(*) filter (where event_type = 'view') as reads,
  count(*) filter (where event_type = 'error')::double / greatest(count(*) filter (where event_type <> 'error'), 1) as density from events group by user_id)"""


def friction_density_p90(spark, d):
    return signals.tail(_sessions(spark, d), "repo", "session", "density").select("repo", "p90", "magnitude", "sessions")


def high_read_tail(spark, d):
    return signals.tail(_sessions(spark, d), "repo", "session", "reads").select("repo", F.col("p90").cast("long").alias("p90"), "magnitude", "sessions")


for _name, _value in (("friction_density_p90", "density"), ("high_read_tail", "reads")):
    SQL[_name] = f"""with {_SESSIONS_SQL}, p as (select repo, quantile_disc({_value}, 0.9) as p90 from s group by repo)
select repo, any_value(p90) as p90, count(*) as magnitude, string_agg(session, ',' order by session) as sessions
from s join p using (repo) where {_value} >= p90 and {_value} > 0 group by repo having count(*) >= 3"""


def friction_evidence(spark, d):
    """Both signals of each repo, numbered G1, G2, ... as emitted."""
    s = _sessions(spark, d)
    one = signals.tail(s, "repo", "session", "reads").select("repo", F.lit(1).alias("kind_no"), F.lit("high_read").alias("kind"), "magnitude")
    two = signals.tail(s, "repo", "session", "density").select("repo", F.lit(2).alias("kind_no"), F.lit("friction_density").alias("kind"), "magnitude")
    return select.numbered(one.unionByName(two), ["repo"], ["kind_no"], "G").select("repo", "kind", "magnitude", "evidence_id")


SQL["friction_evidence"] = f"""with {_SESSIONS_SQL},
p as (select repo, quantile_disc(reads, 0.9) as pr, quantile_disc(density, 0.9) as pd from s group by repo),
g as (select repo, 1 as kind_no, 'high_read' as kind, count(*) as magnitude from s join p using (repo) where reads >= pr and reads > 0 group by repo having count(*) >= 3
  union all select repo, 2, 'friction_density', count(*) from s join p using (repo) where density >= pd and density > 0 group by repo having count(*) >= 3)
select repo, kind, magnitude, 'G' || row_number() over (partition by repo order by kind_no) as evidence_id from g"""


def dedup_newest(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", "ts", "event_type")
    return select.newest(e, ["user_id"], "ts", "event_id").select("user_id", "event_id", "ts", "event_type")


SQL["dedup_newest"] = """
select user_id, event_id, ts, event_type from (select *, row_number() over (partition by user_id order by ts desc, event_id) as k from events) where k = 1"""


def ledger_last_wins(spark, d):
    e = table(spark, d, "events")
    return e.groupBy("user_id", "event_type").agg(F.max("event_id").alias("entry"), F.max_by("value", "event_id").alias("value"))


SQL["ledger_last_wins"] = "select user_id, event_type, max(event_id) as entry, arg_max(value, event_id) as value from events group by 1, 2"


def retention_newest10(spark, d):
    # the filter on row_number makes a limit for each group, which is applied before the exchange as well
    e = table(spark, d, "events")
    nth = F.row_number().over(Window.partitionBy("event_type").orderBy(F.col("event_id").desc()))
    return e.select("event_type", "event_id").withColumn("age", nth).where("age <= 10").withColumn("age", F.col("age").cast("long"))


SQL["retention_newest10"] = """
select event_type, event_id, age from (select event_type, event_id, row_number() over (partition by event_type order by event_id desc) as age from events) where age <= 10"""


def incremental_plan_counts(spark, d):
    """Users as sessions: the last event is a file's time, a purchase an analysis, an error a gate."""
    e = table(spark, d, "events").select(F.col("user_id").cast("string").alias("session_id"), "user_id", F.col("ts").cast("timestamp").alias("ts"), "event_type")
    folder = F.when(F.col("user_id") % 17 == 0, "insights-x").otherwise("p").alias("project_dir")
    last = lambda kind: e.where(F.col("event_type") == kind).groupBy("session_id").agg(F.max("ts").alias("mtime"))
    refs = e.groupBy("session_id", folder).agg(F.max("ts").alias("mtime"))
    ledger = last("error").select("session_id", "mtime", F.lit("gated").alias("outcome"), F.lit(5).alias("threshold"), F.lit(1).cast("long").alias("seq"))
    return incremental.plan(refs, last("purchase"), ledger, NOW, 5, 12 * 3600).groupBy("class").agg(F.count("*").alias("n"))


SQL["incremental_plan_counts"] = f"""
with r as (select user_id, max(ts) as mtime, max(ts) filter (where event_type = 'purchase') as stamp, max(ts) filter (where event_type = 'error') as gated from events group by user_id)
select case when user_id % 17 = 0 then 'meta' when stamp >= mtime then 'incremental' when gated >= mtime then 'gate'
  when mtime > timestamp '{NOW}' - interval 12 hours then 'quiet' else 'process' end as class, count(*) as n from r group by 1"""


def global_due(spark, d):
    e = table(spark, d, "events")
    fresh = F.count_if(F.col("ts") > F.lit("2024-01-20 00:00:00").cast("timestamp_ntz"))
    counts = e.groupBy((F.col("user_id") % 10).cast("string").alias("repo")).agg(F.count("*").alias("total"), fresh.alias("fresh"))
    return signals.due(counts, "repo", "fresh", "total", 10, 10)


SQL["global_due"] = """
with c as (select (user_id % 10)::varchar as repo, count(*) as total, count(*) filter (where ts > timestamp '2024-01-20 00:00:00') as fresh from events group by 1)
select coalesce(sum(fresh), 0)::bigint as fresh, coalesce(string_agg(repo, ',' order by repo) filter (where fresh > 0), '') as contributing, coalesce(sum(fresh), 0) >= 10 as due from c where total >= 10"""


def canary_props(spark, d):
    v = F.try_parse_json("props")
    k = F.try_variant_get(v, "$.k", "bigint")
    kind = F.when(v.isNull(), "malformed").when(k.isNull(), "missing").otherwise("known")
    return table(spark, d, "events").groupBy("event_type", kind.alias("kind")).agg(F.count("*").alias("n"), F.sum(k).alias("k_sum"), F.max(k).alias("k_max"))


SQL["canary_props"] = """
with e as (select event_type, json_valid(props) as ok, try_cast(case when json_valid(props) then json_extract(props, '$.k') end as bigint) as k from events)
select event_type, case when not ok then 'malformed' when k is null then 'missing' else 'known' end as kind, count(*) as n, sum(k)::bigint as k_sum, max(k) as k_max from e group by 1, 2"""


def type_stability(spark, d):
    e = table(spark, d, "events").select("user_id", (F.col("event_id") % 3).alias("repeat"), "event_type")
    return evals.pairwise_stability(e, "user_id", "repeat", "event_type")


SQL["type_stability"] = """
with s as (select user_id, event_id % 3 as rep, list_sort(list_distinct(list(event_type))) as s from events group by 1, 2),
n as (select user_id, count(*) as repeats from s group by 1),
p as (select a.user_id, avg(len(list_intersect(a.s, b.s))::double / len(list_distinct(list_concat(a.s, b.s)))) as m from s a join s b on a.user_id = b.user_id and a.rep < b.rep group by 1),
t as (select user_id, unnest(s) as k from s), c as (select user_id, k, count(*) as n from t group by 1, 2),
h as (select c.user_id, bool_or(c.n < n.repeats) as churn from c join n using (user_id) group by 1)
select n.user_id, n.repeats, round(coalesce(p.m, 1), 9) as mean_jaccard, h.churn from n left join p using (user_id) join h using (user_id)"""


def two_class_jump(spark, d):
    return evals.two_class_jump(table(spark, d, "events"), "user_id", "event_type", ("view", "click", "signup", "purchase"))


SQL["two_class_jump"] = """
with r as (select user_id, case event_type when 'view' then 1 when 'click' then 2 when 'signup' then 3 when 'purchase' then 4 end as k from events)
select user_id, max(k) - min(k) >= 2 as jump, count(*) filter (where k is null) as unclear from r group by user_id"""


def eval_report_rates(spark, d):
    e = table(spark, d, "events")
    n = F.count("*")
    bad = F.count_if(F.col("event_type") == "error")
    return e.agg(n.alias("n"), bad.alias("errors"), evals.ratio(bad, n, 0.0).alias("rate"), evals.ratio(n - bad, n, 1.0).alias("validity"), (evals.ratio(bad, n, 0.0) <= 0.02).alias("floor_met"))


SQL["eval_report_rates"] = """
with c as (select count(*) as n, count(*) filter (where event_type = 'error') as errors from events)
select n, errors, case when n = 0 then 0 else errors / n end as rate, case when n = 0 then 1 else (n - errors) / n end as validity, errors / n <= 0.02 as floor_met from c"""


def stratified_sample(spark, d):
    """One outlier and quotas of cells, each conversation once."""
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), F.count_if(F.col("role") == "system").alias("systems"), F.sum(F.octet_length("text")).alias("bytes"))
    cells = [("meta", F.col("systems") > 0, 1), ("short", F.col("turns") < 3, 2), ("medium", F.col("turns").between(3, 5), 2), ("long", F.col("turns") > 5, 2), ("fill", F.lit(True), 3)]
    return select.curate(c, "conv_id", cells, [F.col("turns").desc(), F.col("bytes").desc()])


SQL["stratified_sample"] = """
with c as (select conv_id, count(*) as turns, count(*) filter (where role = 'system') as systems, sum(strlen(text)) as bytes from conversations group by conv_id),
a as (select conv_id, 'outlier' as cell from c order by turns desc, bytes desc, conv_id limit 1),
b as (select * from a union all (select conv_id, 'meta' from c where systems > 0 and conv_id not in (select conv_id from a) order by conv_id limit 1)),
e as (select * from b union all (select conv_id, 'short' from c where turns < 3 and conv_id not in (select conv_id from b) order by conv_id limit 2)),
f as (select * from e union all (select conv_id, 'medium' from c where turns between 3 and 5 and conv_id not in (select conv_id from e) order by conv_id limit 2)),
g as (select * from f union all (select conv_id, 'long' from c where turns > 5 and conv_id not in (select conv_id from f) order by conv_id limit 2))
select * from g union all (select conv_id, 'fill' from c where conv_id not in (select conv_id from g) order by conv_id limit 3)"""


def ext_response_gaps(spark, d):
    """An extension: seconds between a user's events, from 2 to 3600."""
    gap = (_micros("ts") - F.lag(_micros("ts")).over(Window.partitionBy("user_id").orderBy("ts", "event_id"))) / 1_000_000
    g = table(spark, d, "events").select("user_id", F.floor(gap).alias("gap")).where("gap between 2 and 3600")
    return g.groupBy("user_id").agg(F.count("*").alias("n"), F.min("gap").alias("least"), F.max("gap").alias("most"), F.sum("gap").alias("total"))


SQL["ext_response_gaps"] = """
with g as (select user_id, floor((epoch_us(ts) - lag(epoch_us(ts)) over (partition by user_id order by ts, event_id)) / 1000000)::bigint as gap from events)
select user_id, count(*) as n, min(gap) as least, max(gap) as most, sum(gap)::bigint as total from g where gap between 2 and 3600 group by user_id"""


def ext_hour_hist(spark, d):
    return table(spark, d, "events").groupBy(F.hour("ts").cast("long").alias("hour")).agg(F.count("*").alias("n"), F.count_distinct(F.to_date("ts")).alias("days"))


SQL["ext_hour_hist"] = "select hour(ts) as hour, count(*) as n, count(distinct ts::date) as days from events group by 1"


def ext_overlap_30m(spark, d):
    """An extension: half hours in which two or more users were active."""
    slot = F.floor(_micros("ts") / 1_800_000_000)
    return table(spark, d, "events").groupBy(slot.alias("slot")).agg(F.count_distinct("user_id").alias("users"), F.count("*").alias("n")).where("users >= 2")


SQL["ext_overlap_30m"] = "select floor(epoch_us(ts) / 1800000000)::bigint as slot, count(distinct user_id) as users, count(*) as n from events group by 1 having count(distinct user_id) >= 2"

QUERIES = {name: globals()[name] for name in SQL}
