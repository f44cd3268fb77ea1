"""Queries over populations, anchors, gates, pseudonyms, shapes, trees and ranks. Orders stand for sessions, nations for buckets, suppliers
for cards and targets, parts for anchors."""

from __future__ import annotations

from pyspark.sql import functions as F

from skeinlog.functions import schema
from skeinlog.operators import evals, populations, ranks, redact, tier1, trees
from skeinlog.sources.tables import table

SQL: dict[str, str] = {}


def _reports(spark, d):
    """Every third nation's report counts all of its orders, every third those before a day, the others one too many."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("bucket"))
    o = table(spark, d, "orders").join(c, "o_custkey")
    path = F.concat(F.lit("/w/"), F.col("bucket").cast("string"), F.when(F.col("o_orderkey") % 2 == 0, "/.worktrees/t").otherwise(""))
    a = o.select("bucket", F.col("o_orderkey").alias("session_id"), F.col("o_orderdate").cast("date").alias("start"), (F.col("o_orderstatus") == "F").alias("meta"), path.alias("repo_path"))
    day = F.lit("1995-01-01").cast("date")
    n = F.when(F.col("bucket") % 3 == 0, F.count("*")).when(F.col("bucket") % 3 == 1, F.count_if(F.col("start") < day)).otherwise(F.count("*") + 1)
    r = a.groupBy("bucket").agg(n.alias("analysed"), F.max("start").cast("string").alias("from_day"), F.min("start").cast("string").alias("to_day")).withColumn("generated_at", day)
    return populations.reconstructed(r, a)


_POPULATION = """
o as (select c_nationkey as bucket, o_orderkey, o_orderdate::date as start, o_orderstatus = 'F' as meta from orders join customer on c_custkey = o_custkey),
n as (select bucket, count(*) as n, count(*) filter (where start < date '1995-01-01') as early, min(start) as low, max(start) as high from o group by 1),
r as (select *, case bucket % 3 when 0 then n when 1 then early else n + 1 end as expected from n),
k as (select *, n <> expected and early = expected as cut from r),
m as (select bucket, o_orderkey as session_id, not meta as scoring from o join k using (bucket) where not cut or start < date '1995-01-01')"""


def population_buckets(spark, d):
    buckets, members = _reports(spark, d)
    return buckets.join(members.groupBy("bucket").agg(F.count("*").alias("members"), F.count_if("scoring").alias("scoring"), F.sum("session_id").alias("ids")), "bucket", "left").fillna(0, ["members", "scoring"])


SQL["population_buckets"] = f"""with {_POPULATION}
select k.bucket, expected, case when cut then early else n end as reconstructed, case when cut then early else n end = expected as resolved, low::varchar as from_day, high::varchar as to_day, case when not cut or early > 0 then '/w/' || k.bucket end as repo_path,
  case when case when cut then early else n end <> expected then k.bucket || ': reconstructed ' || n || ' analyses, report says ' || expected end as problem,
  count(session_id) as members, count(*) filter (where scoring) as scoring, sum(session_id)::bigint as ids from k left join m using (bucket) group by all"""


def population_union(spark, d):
    """Sessions that some bucket scores, without those whose transcripts are gone, and how many were taken out of each bucket."""
    buckets, members = _reports(spark, d)
    gaps = table(spark, d, "orders").where("o_orderkey % 5 = 0").select(F.col("o_orderkey").alias("session_id"))
    kept, gone = populations.stripped(members, gaps)
    return populations.scoring_union(kept).agg(F.count("*").alias("n"), F.sum("session_id").alias("ids")).crossJoin(gone.agg(F.count("*").alias("gone"), F.max("note").alias("last"))).crossJoin(populations.all_resolved(buckets))


SQL["population_union"] = f"""with {_POPULATION}
select (select count(distinct session_id) from m where scoring and session_id % 5 <> 0) as n, (select sum(session_id)::bigint from m where scoring and session_id % 5 <> 0) as ids,
  (select count(*) from m where session_id % 5 = 0) as gone, (select max(bucket || ': ' || session_id || ' stripped from full-scope population (gap)') from m where session_id % 5 = 0) as last,
  false as resolved, (select count(*) from k where case when cut then early else n end <> expected) as open"""


def _anchors(spark, d):
    return table(spark, d, "part").select((F.col("p_size") % 25).cast("long").alias("target"), (F.col("p_partkey") % 60).alias("session_id"))


def card_membership(spark, d):
    """What suppliers' cards have beyond their targets' anchors, and what they lack."""
    cards = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("card"), (F.col("l_suppkey") % 25).alias("target"), (F.col("l_partkey") % 60).alias("session_id"))
    lines = table(spark, d, "part").where("p_partkey < 60 and p_partkey % 4 <> 0").select(F.col("p_partkey").alias("session_id"), F.col("p_name").alias("line"))
    got = populations.membership(cards, _anchors(spark, d), lines)
    return got.select("card", F.array_join("added", "|").alias("added"), F.array_join("missing", "|").alias("missing"))


SQL["card_membership"] = """
with c as (select distinct l_suppkey as card, l_suppkey % 25 as target, l_partkey % 60 as s from lineitem), a as (select distinct p_size % 25 as target, p_partkey % 60 as s from part),
x as (select card, s, 1 as side from c where not exists (select 1 from a where a.target = c.target and a.s = c.s)
  union all select card, a.s, 2 from (select distinct card, target from c) k join a using (target) where not exists (select 1 from c where c.card = k.card and c.s = a.s)),
l as (select x.*, coalesce(p_name, '(no pool summary)') as line, row_number() over (partition by card, side order by s) as nth, count(*) over (partition by card, side) as n from x left join part on p_partkey = s and s % 4 <> 0),
t as (select card, side, string_agg(line, '|' order by nth) filter (where nth <= 6) || case when any_value(n) > 6 then '|… and ' || any_value(n) - 6 || ' more' else '' end as said from l group by 1, 2)
select distinct c.card, coalesce(p.said, '') as added, coalesce(q.said, '') as missing from c left join t p on p.card = c.card and p.side = 1 left join t q on q.card = c.card and q.side = 2"""


def anchor_states(spark, d):
    """Suppliers' anchors against the themes that they name, some of which aren't there."""
    rubrics = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("target"), (F.col("l_suppkey") % 30).alias("theme"), (F.col("l_partkey") % 60).alias("session_id"))
    themes = _anchors(spark, d).withColumnRenamed("target", "theme").where("theme <> 3")
    gaps = table(spark, d, "part").select((F.col("p_partkey") % 60).alias("session_id")).where("session_id % 7 = 0")
    return populations.anchor_history(rubrics, themes, gaps).groupBy("target", "state").agg(F.count("*").alias("n"), F.sum("session_id").alias("ids"))


SQL["anchor_states"] = """
with r as (select distinct l_suppkey as target, l_suppkey % 30 as theme, l_partkey % 60 as s from lineitem), h as (select distinct p_size % 25 as theme, p_partkey % 60 as s from part where p_size % 25 <> 3),
u as (select target, theme, s from r union select target, h.theme, h.s from (select distinct target, theme from r) join h using (theme)),
j as (select u.target, u.s, exists (select 1 from h where h.theme = u.theme) as known, exists (select 1 from h where h.theme = u.theme and h.s = u.s) as was, exists (select 1 from r where r.target = u.target and r.s = u.s) as now from u)
select target, case when not known then 'no_theme' when was and now then 'kept' when now then 'foreign' when s % 7 = 0 then 'gap' else 'stripped' end as state, count(*) as n, sum(s)::bigint as ids from j group by 1, 2"""


def facts_differences(spark, d):
    """Orders as stored facts, of which some have since changed, lost a field or gone."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), "o_orderstatus", "o_orderpriority", "o_custkey")
    of = lambda status, priority: F.parse_json(F.to_json(F.struct(status.alias("status"), F.struct(priority.alias("priority"), F.col("o_custkey").alias("customer")).alias("of"))))
    k = F.col("k")
    stored = o.select("k", of(F.col("o_orderstatus"), F.col("o_orderpriority")).alias("v"))
    fresh = o.where(k % 13 != 0).select("k", of(F.when(k % 7 != 0, F.when(k % 5 == 0, "X").otherwise(F.col("o_orderstatus"))), F.when(k % 11 == 0, "none").otherwise(F.col("o_orderpriority"))).alias("v"))
    got = populations.differences(stored, fresh, "k", "v")
    return got.groupBy("path", F.col("fresh").isNull().alias("gone")).agg(F.count("*").alias("n"), F.sum("k").alias("keys"), F.max("stored").alias("stored"), F.max("fresh").alias("fresh"))


SQL["facts_differences"] = """
with o as (select o_orderkey as k, o_orderstatus as s, o_orderpriority as p, o_custkey as c from orders),
x as (select k, '$.status' as path, '"' || s || '"' as stored, case when k % 13 = 0 or k % 7 = 0 then null when k % 5 = 0 then '"X"' else '"' || s || '"' end as fresh from o
  union all select k, '$.of.priority', '"' || p || '"', case when k % 13 = 0 then null when k % 11 = 0 then '"none"' else '"' || p || '"' end from o
  union all select k, '$.of.customer', c::varchar, case when k % 13 = 0 then null else c::varchar end from o)
select path, fresh is null as gone, count(*) as n, sum(k)::bigint as keys, max(stored) as stored, max(fresh) as fresh from x where stored is distinct from fresh group by 1, 2"""


def tier1_gates(spark, d):
    """Lines of every third order are a sample's reads, brands are probes, nations' names are findings."""
    li = table(spark, d, "lineitem").withColumn("sample", F.col("l_orderkey") % 3)
    outputs = li.groupBy(F.concat(F.lit("k"), F.col("sample").cast("string")).alias("key")).agg(
        F.count("*").alias("checkable"), F.count_if(F.col("l_discount") > 0.08).alias("drops"), F.count_if((F.col("l_quantity") > 49) & (F.col("l_tax") > 0.07)).alias("leaks"),
        F.count_if(F.col("l_returnflag") == "R").alias("notes"), F.count_if(F.col("l_linenumber") == 7).alias("downgrades"), (F.min("l_linenumber") > 1).alias("empty"),
    )
    samples = li.select("sample").distinct().select("sample", F.concat(F.lit("k"), F.col("sample").cast("string")).alias("key"), (F.col("sample") < 2).alias("fresh"))
    kind = F.element_at(F.array(F.lit("friction"), F.lit("opportunity"), F.lit("preference")), (F.col("p_size") % 3 + 1).cast("int"))
    probes = table(spark, d, "part").select(kind.alias("kind"), F.col("p_brand").alias("id"), F.col("p_partkey").alias("evidence_id"))
    cites = li.select("sample", F.col("l_partkey").alias("evidence_id"), "l_returnflag")
    n = F.col("n_nationkey")
    items = table(spark, d, "nation").select(F.explode(F.array(*[F.lit(i).cast("long") for i in range(3)])).alias("sample"), n.cast("long").alias("ord"), n.cast("string").alias("item_id"), F.col("n_name").alias("text"), n.alias("n"))
    items = items.select("sample", "ord", "item_id", "text", F.array((F.col("n") + F.col("sample") * (F.col("n") % 2)).cast("string")).alias("session_ids"), F.lit(False).alias("dropped"))
    g = tier1.gates(samples, outputs, probes, cites.where("l_returnflag = 'R' and evidence_id % 50 = 0"), cites.where("l_returnflag = 'A' and evidence_id % 40 = 0"), items)
    short = lambda c: F.array_join(c, "|").alias(c)
    return g.select("samples", F.round("fabrication", 9).alias("fabrication"), "leaks", "notes", "downgrades", *[short(f"{k}_misses") for k in tier1.KINDS], "suppressed", F.round("churn", 9).alias("churn"), "fresh_pairs", short("reasons"), F.size("warnings").cast("long").alias("warnings"), "passes")


SQL["tier1_gates"] = """
with l as (select *, l_orderkey % 3 as sample from lineitem),
s as (select sample, count(*) as checkable, count(*) filter (where l_discount > 0.08) as drops, count(*) filter (where l_quantity > 49 and l_tax > 0.07) as leaks, count(*) filter (where l_returnflag = 'R') as notes,
  count(*) filter (where l_linenumber = 7) as downgrades from l group by 1),
p as (select distinct (['friction', 'opportunity', 'preference'])[p_size % 3 + 1] as kind, p_brand as id, p_partkey as k from part),
f as (select distinct sample, kind, id from l join p on k = l_partkey where l_returnflag = 'R' and l_partkey % 50 = 0), dr as (select distinct sample, kind, id from l join p on k = l_partkey where l_returnflag = 'A' and l_partkey % 40 = 0),
g as (select sample, kind, id from (select distinct sample from l), (select distinct kind, id from p)),
st as (select g.*, case when f.id is not null then 'cited' when dr.id is not null then 'suppressed' else 'miss' end as state from g left join f using (sample, kind, id) left join dr using (sample, kind, id)),
m as (select kind, id, bool_or(state = 'miss') as miss, bool_or(state = 'suppressed') as held from st group by 1, 2),
t as (select count(*) as samples, max(drops / checkable) as fabrication, sum(leaks)::bigint as leaks, sum(notes)::bigint as notes, sum(downgrades)::bigint as downgrades from s),
q as (select coalesce(string_agg(id, '|' order by id) filter (where kind = 'opportunity' and miss), '') as opportunity_misses, coalesce(string_agg(id, '|' order by id) filter (where kind = 'preference' and miss), '') as preference_misses,
  coalesce(string_agg(id, '|' order by id) filter (where kind = 'friction' and miss), '') as friction_misses, count(*) filter (where held) as suppressed, count(*) filter (where miss) as misses from m),
c as (select round(avg(n_nationkey % 2), 9) as churn from nation)
select samples, round(fabrication, 9) as fabrication, leaks, notes, downgrades, opportunity_misses, preference_misses, friction_misses, suppressed, churn, 1::bigint as fresh_pairs,
  concat_ws('|', case when fabrication > 0.15 then 'raw fabrication rate ' || format('{:.3f}', fabrication) || ' exceeds 0.15' end, case when leaks > 0 then leaks || ' privacy leak(s) in raw prose' end) as reasons,
  (misses + (suppressed > 0)::int + (notes > 0)::int + (downgrades > 0)::int + (churn > 0.5)::int)::bigint as warnings, fabrication <= 0.15 and leaks = 0 as passes from t, q, c"""


def redacted_joins(spark, d):
    """Orders by nation, joined over pseudonyms instead of names, and how many names each table had."""
    tables, manifest = redact.redacted({"customer": table(spark, d, "customer"), "orders": table(spark, d, "orders")}, {"customer": {"c_custkey": "customer", "c_name": "name"}, "orders": {"o_custkey": "customer"}}, "secret")
    left = redact.left_over({"customer": tables["customer"].select("c_custkey", "c_name"), "orders": tables["orders"].select("o_custkey")}, manifest).agg(F.count("*").alias("left_over"))
    n = manifest.groupBy("kind").agg(F.count("*").alias("names"), F.count_distinct("pseudonym").alias("pseudonyms"), F.sum("rows").alias("rows")).where("kind = 'customer'").drop("kind")
    j = tables["orders"].join(tables["customer"], F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey").agg(F.count("*").alias("n"), F.count_distinct("o_custkey").alias("customers"))
    return j.crossJoin(n).crossJoin(left)  # two single rows


SQL["redacted_joins"] = """
with k as (select c_custkey as k from customer union all select o_custkey from orders)
select c_nationkey, count(*) as n, count(distinct o_custkey) as customers, (select count(distinct k) from k) as names, (select count(distinct k) from k) as pseudonyms, (select count(*) from k) as rows, 0::bigint as left_over
from orders join customer on c_custkey = o_custkey group by 1"""


def schema_errors(spark, d):
    """Orders as judgements, some of which aren't as declared."""
    k, quote = F.col("o_orderkey"), F.lit('"')
    raw = F.concat(
        F.lit('{"outcome": "'), F.when(k % 3 == 0, "fine").otherwise("unclear"), F.lit('", "session_type": '), F.when(k % 4 == 0, "1").otherwise('"exploration"'), F.lit(', "underlying_goal": '), F.when(k % 5 == 0, '""').otherwise(F.concat(quote, F.col("o_orderpriority"), quote)),
        F.when(k % 6 == 0, "").otherwise(', "brief_summary": "s"'), F.when(k % 7 == 0, ', "friction_incidents": [{"type": "buggy_code"}, {"type": "odd"}, 3]').when(k % 7 == 1, ', "friction_incidents": {}').otherwise(', "friction_incidents": null'),
        F.when(k % 8 == 0, ', "standing_preferences": [{"rule": "r", "evidence_quote": ""}, {}]').otherwise(""), F.lit("}"),
    )
    v = F.when(k % 9 == 0, F.parse_json(F.lit("[1]"))).when(k % 9 != 1, F.parse_json(raw))
    return table(spark, d, "orders").select("o_orderkey", F.explode(schema.errors(v, schema.JUDGED)).alias("error")).groupBy("error").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


SQL["schema_errors"] = """
with o as (select o_orderkey as k from orders), x as (select * from o where k % 9 > 1),
e as (select k, '$: not a object' as error from o where k % 9 = 0 union all select k, '$: missing' from o where k % 9 = 1
  union all select k, '$.outcome: not one of fully_achieved, mostly_achieved, partially_achieved, not_achieved, unclear' from x where k % 3 = 0
  union all select k, '$.session_type: not a string' from x where k % 4 = 0 union all select k, '$.underlying_goal: empty' from x where k % 5 = 0 union all select k, '$.brief_summary: missing' from x where k % 6 = 0
  union all select k, '$.friction_incidents[1].type: not one of wrong_approach, buggy_code, misunderstood_request, excessive_changes, user_rejected_action, incomplete' from x where k % 7 = 0
  union all select k, '$.friction_incidents[2]: not a object' from x where k % 7 = 0 union all select k, '$.friction_incidents: not a array' from x where k % 7 = 1
  union all select k, unnest(['$.standing_preferences[0].evidence_quote: empty', '$.standing_preferences[1].rule: missing', '$.standing_preferences[1].evidence_quote: missing']) from x where k % 8 = 0)
select error, count(*) as n, sum(k)::bigint as keys from e group by 1"""


def tree_digests(spark, d):
    """Customers as files in folders of their nation and region."""
    place = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.concat_ws("/", "r_name", "n_name").alias("folder"))
    c = table(spark, d, "customer").join(place, F.col("c_nationkey") == F.col("n_nationkey"))
    return trees.tree_hashes(c.select(F.concat_ws("/", "folder", F.col("c_custkey").cast("string")).alias("path"), F.sha2("c_name", 256).alias("digest"))).where("path not like '%/%/%'")


SQL["tree_digests"] = """
with f as (select r_name || '/' || n_name as up, c_custkey::varchar as name, sha256(c_name) as digest from customer join nation on n_nationkey = c_nationkey join region on r_regionkey = n_regionkey),
a as (select up, substr(sha256(name), 1, 2) as part, sha256(string_agg(name || chr(0) || digest || chr(0), '' order by name)) as digest, count(*) as n from f group by 1, 2),
n as (select up as path, sha256(string_agg(digest, '' order by part)) as digest, sum(n) as files from a group by 1),
b as (select split_part(path, '/', 1) as up, split_part(path, '/', 2) as name, digest, files from n),
c as (select up, substr(sha256(name), 1, 2) as part, sha256(string_agg(name || chr(0) || digest || chr(0), '' order by name)) as digest, sum(files) as n from b group by 1, 2),
r as (select up as path, sha256(string_agg(digest, '' order by part)) as digest, sum(n) as files from c group by 1),
e as (select substr(sha256(path), 1, 2) as part, sha256(string_agg(path || chr(0) || digest || chr(0), '' order by path)) as digest, sum(files) as n from r group by 1)
select path, digest, files::bigint as files from n union all select path, digest, files::bigint from r union all select '', sha256(string_agg(digest, '' order by part)), sum(n)::bigint from e"""


def contested_reasons(spark, d):
    """Orders as sessions, their lines as repeats, with quotes from the order's priority."""
    k, n = F.col("l_orderkey"), F.col("l_linenumber")
    outcome = F.when(k % 5 == 0, "fully_achieved").when((k % 7 == 0) & (n == 1), "unclear").when(n % 2 == 0, "mostly_achieved").otherwise(F.when(k % 3 == 0, "partially_achieved").otherwise("mostly_achieved"))
    kinds = F.when(k % 4 == 1, F.array(F.lit("buggy_code"))).when((k % 4 == 2) & (n > 2), F.array(F.lit("incomplete"), F.lit("incomplete")))
    r = table(spark, d, "lineitem").select(k.alias("session_id"), n.alias("repeat"), outcome.alias("outcome"), kinds.alias("types"), F.when(k % 11 == 0, F.array(F.lit("HIGH"), F.lit(""))).alias("quotes"))
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("session_id"), (F.col("o_orderkey") % 2).alias("friction"), F.concat_ws(" ", "o_orderpriority", F.when(F.col("o_orderkey") % 22 == 0, F.col("o_orderpriority"))).alias("all_text"))
    return evals.contested(r, o).groupBy(F.array_join("reasons", "|").alias("reasons")).agg(F.count("*").alias("n"), F.sum("session_id").alias("keys"))


SQL["contested_reasons"] = """
with r as (select l_orderkey as k, case when l_orderkey % 5 = 0 then 'f' when l_orderkey % 7 = 0 and l_linenumber = 1 then 'u' when l_linenumber % 2 = 0 or l_orderkey % 3 <> 0 then 'm' else 'p' end as o,
  case when l_orderkey % 4 = 1 then 1 when l_orderkey % 4 = 2 and l_linenumber > 2 then 2 else 0 end as n from lineitem),
b as (select k, count(distinct o) > 1 or count(distinct n) > 1 as dis, bool_or(o = 'u') or (bool_or(o = 'm') and bool_or(o = 'p')) as edge, max(n) as most, count(*) filter (where n = 0) as zero, count(*) as c from r group by 1),
x as (select o_orderkey as k, concat_ws('|', case when dis then 'run-to-run disagreement' end, case when edge then 'borderline outcome' end,
  case when b.k is not null and o_orderkey % 22 = 0 and o_orderpriority like '%HIGH%' then 'fabrication-pressure quote' end, case when o_orderkey % 2 = 0 and most > 0 then 'false-friction candidate' end,
  case when o_orderkey % 2 = 1 and zero >= (c + 1) // 2 then 'recall candidate' end) as reasons from orders left join b on b.k = o_orderkey)
select reasons, count(*) as n, sum(k)::bigint as keys from x group by 1"""


def nearest_ranks(spark, d):
    """The ninth tenth of prices for each supplier, found by cells; no supplier's prices meet in one buffer."""
    return ranks.nearest_rank(table(spark, d, "lineitem"), "l_suppkey", "l_extendedprice", 0.9).select("l_suppkey", "n", F.col("l_extendedprice").alias("p90"))


SQL["nearest_ranks"] = "select l_suppkey, count(*) as n, quantile_disc(l_extendedprice::double, 0.9) as p90 from lineitem group by 1"

QUERIES = {name: globals()[name] for name in SQL}
