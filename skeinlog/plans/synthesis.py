"""Queries over evidence bundles and synthesis runs. Nations stand for repositories, orders for sessions, their lines for what was judged."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from skeinlog.operators import bundles, synthesis
from skeinlog.operators.similarity import _saved
from skeinlog.sources.tables import table

SQL: dict[str, str] = {}


def analyses(spark, d):
    """An analysis of each order: a friction for each returned line, a preference for each accepted one, achieved where it was fulfilled."""
    c, n = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("n_nationkey")), table(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("repo"))
    o = table(spark, d, "orders").join(c, "o_custkey").join(F.broadcast(n), "n_nationkey")  # nations are 25 rows by definition
    quote = F.concat(F.lit("part "), F.col("l_partkey").cast("string"))
    friction = F.struct(F.concat(F.lit("status "), "l_linestatus", F.lit(" of "), F.chr(F.lit(65) + F.col("l_suppkey") % 7)).alias("type"), quote.alias("one_line"), F.when(F.col("l_partkey") % 3 > 0, quote).alias("quote"), F.lit(None).cast("string").alias("file"))
    rule = F.struct(F.concat(F.lit("ship "), F.col("l_suppkey").cast("string")).alias("rule"), quote.alias("quote"))
    order = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_linestatus")
    listed = lambda flag, what: F.transform(F.sort_array(F.collect_list(F.when(F.col("l_returnflag") == flag, F.struct(order.alias("o"), what.alias("w"))))), lambda x: x["w"])
    li = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(listed("R", friction).alias("friction"), listed("A", rule).alias("preferences"))
    o = o.join(li, "o_orderkey", "left")
    return o.select("repo", F.col("o_orderkey").alias("session_id"), F.col("o_orderdate").alias("start"), F.when(F.col("o_orderstatus") == "F", "fully_achieved").otherwise("unclear").alias("outcome"), F.col("o_orderpriority").alias("session_type"), F.lit("").alias("underlying_goal"), F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("brief_summary"), "friction", "preferences", F.col("o_orderdate").alias("analysed_at"))


_ANALYSES = """
a as (select n_name as repo, o_orderkey, o_orderdate, o_orderstatus, o_orderpriority from orders join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey),
l as (select a.*, l_linenumber, l_partkey, l_suppkey, l_linestatus, l_returnflag from a join lineitem on l_orderkey = o_orderkey),
i as (
    select repo, 'F' as kind, o_orderkey, 'status ' || l_linestatus || ' of ' || chr((65 + l_suppkey % 7)::int) as label, 'part ' || l_partkey as text, l_partkey % 3 > 0 as quoted, 'part ' || l_partkey as q,
        row_number() over (partition by repo order by o_orderdate, o_orderkey, l_linenumber, l_partkey, l_suppkey, l_linestatus) as n from l where l_returnflag = 'R'
    union all
    select repo, 'P', o_orderkey, null, 'ship ' || l_suppkey, true, 'part ' || l_partkey,
        row_number() over (partition by repo order by o_orderdate, o_orderkey, l_linenumber, l_partkey, l_suppkey, l_linestatus) from l where l_returnflag = 'A'
    union all
    select repo, 'S', o_orderkey, o_orderpriority, 'order ' || o_orderkey, false, null, row_number() over (partition by repo order by o_orderdate, o_orderkey) from a where o_orderstatus = 'F')"""


def _analysed(spark, d):
    """Analyses as a table, as in a store, of the repositories that have three."""
    return bundles.floored(_saved(analyses(spark, d)), 3)


def bundle_items(spark, d):
    """All evidence of all repositories under its ids."""
    got = bundles.items(_analysed(spark, d))
    return got.select("repo", "id", "label", "text", F.size("quote_pool").alias("quotes"), F.col("session_ids")[0].alias("session_id"))


_FLOOR = "(select repo from a group by 1 having count(*) >= 3)"
SQL["bundle_items"] = f"""with {_ANALYSES}
select repo, repo || '/' || kind || n as id, label, text, quoted::int as quotes, o_orderkey as session_id from i where repo in {_FLOOR}"""


def bundle_headers(spark, d):
    """What a run would feed the synthesizer, and in how many bytes."""
    a = _analysed(spark, d).withColumn("session_id", F.col("session_id").cast("string"))
    return bundles.headers(a, bundles.items(a))


_LINE = """'{"repo":"' || repo || '","id":"' || repo || '/' || kind || n || '","kind":"' || kind || '"' || case when label is null then '' else ',"label":"' || label || '"' end || ',"text":"' || text || '"' ||
case when quoted then ',"quote":"' || q || '"' else '' end || ',"session_ids":["' || o_orderkey || '"],"quote_pool":[' || case when quoted then '"' || q || '"' else '' end || ']}'"""
SQL["bundle_headers"] = f"""with {_ANALYSES},
s as (select repo, count(*) filter (where kind = 'F') as friction, count(*) filter (where kind = 'P') as prefs, count(*) filter (where kind = 'S') as success, 0::bigint as signals, sum(strlen({_LINE}) + 1)::bigint as bytes from i group by 1),
h as (select repo, count(*) as sessions, strftime(min(o_orderdate), '%Y-%m-%d') as from_day, strftime(max(o_orderdate), '%Y-%m-%d') as to_day from a group by 1 having count(*) >= 3)
select repo, sessions, from_day, to_day, coalesce(friction, 0) as friction, coalesce(prefs, 0) as prefs, coalesce(success, 0) as success, coalesce(signals, 0) as signals, coalesce(bytes, 0) as bytes from h left join s using (repo)"""


def synthesis_findings(spark, d):
    """The stand-in's findings over all repositories, verified and counted anew from what they cite."""
    a = _analysed(spark, d)
    evidence = _saved(bundles.items(a))  # a run, too, writes what the synthesizer reads
    findings, dropped = synthesis.by_rule(evidence, bundles.headers(a, evidence))
    dates = a.select("repo", "session_id", F.date_format("start", "yyyy-MM-dd").alias("day"))
    good, _ = synthesis.verified(synthesis.shaped(findings, synthesis.FINDING), dropped, evidence, dates, spark.createDataFrame([], synthesis.ASSETS), None)
    return good.select("rank", "title", F.array_join("repos", ",").alias("repos"), "sessions", "last_seen", F.array_join("evidence_ids", ",").alias("cited"))


SQL["synthesis_findings"] = f"""with {_ANALYSES},
f as (select * from i where kind = 'F' and repo in {_FLOOR}),
m as (select label, row_number() over (order by count(distinct (repo, o_orderkey)) desc, label) as rank from f group by 1 qualify rank <= 3),
c as (select f.*, rank, row_number() over (partition by rank order by repo) as k from f join m using (label) where (repo, f.label, n) in (select (repo, label, min(n)) from f group by repo, label) qualify k <= 20)
select rank::int as rank, 'Recurring friction: ' || label as title, string_agg(c.repo, ',' order by c.repo) as repos, count(distinct (c.repo, c.o_orderkey)) as sessions,
    strftime(max(a.o_orderdate), '%Y-%m-%d') as last_seen, string_agg(c.repo || '/F' || n, ',' order by c.repo) as cited
from c join a on a.o_orderkey = c.o_orderkey and a.repo = c.repo group by rank, label"""


def synthesis_due(spark, d):
    """Due-ness at four times after a snapshot, by sessions since and by cadence."""
    a = analyses(spark, d).select("repo", "analysed_at")
    last, out = datetime(1998, 1, 1), None
    for days in (1, 13, 14, 400):
        now = last + timedelta(days=days)
        row = synthesis.due_state(a.where(F.col("analysed_at") <= F.lit(now)), last, now, synthesis.Options(min_sessions=3, due_new_sessions=20)).withColumn("days", F.lit(days))
        out = row if out is None else out.unionByName(row)
    return out


SQL["synthesis_due"] = f"""with {_ANALYSES},
t as (select unnest([1, 13, 14, 400]) as days), u as (select days, timestamp '1998-01-01' + days * interval 1 day as now from t),
r as (select days, repo, count(*) filter (where o_orderdate > timestamp '1998-01-01') as fresh, count(*) as total from a join u on o_orderdate <= now group by all having count(*) >= 3)
select days::int as days, coalesce(sum(fresh), 0)::bigint as fresh, coalesce(string_agg(repo, ',' order by repo) filter (where fresh > 0), '') as contributing,
    coalesce(sum(fresh), 0) >= 20 and days >= 14 as due from u left join r using (days) group by days"""


def auto_states(spark, d):
    """What a header says of each order as a run: its status, whether anything is held, and whether a run is due."""
    o = table(spark, d, "orders")
    status = F.when(F.col("o_orderkey") % 5 == 0, F.lit(None)).when(F.col("o_orderstatus") == "F", "failed").when(F.col("o_orderstatus") == "O", "ok").otherwise("running")
    auto = synthesis.auto_state(status, F.col("o_orderpriority"), F.col("o_custkey") % 2, F.col("o_custkey") % 3 == 0, F.col("o_totalprice") > 100000)
    return o.select(auto.alias("a")).groupBy("a.state", "a.last_outcome").agg(F.count("*").alias("n"))


SQL["auto_states"] = """with r as (select case when o_orderkey % 5 = 0 then null when o_orderstatus = 'F' then 'failed' when o_orderstatus = 'O' then 'ok' else 'running' end as s,
    o_orderpriority as reason, o_custkey % 2 as w, o_custkey % 3 = 0 as held, o_totalprice > 100000 as due from orders)
select case when s = 'running' and held then 'running' when s in ('running', 'failed') then 'error' when due then 'due' else 'idle' end as state,
    case when s = 'running' and not held then 'last run died (no exit record)' when s = 'failed' then 'last run failed: ' || coalesce(reason, '') when s = 'ok' then 'last run: ' || w || ' written' else '' end as last_outcome,
    count(*) as n from r group by all"""

QUERIES = {f.__name__: f for f in (bundle_items, bundle_headers, synthesis_findings, synthesis_due, auto_states)}
