"""Queries over state: upserts, frozen copies, contracts, repositories, side matches and cards."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skeinlog.functions import text as T
from skeinlog.operators import populations, repos, stores, verify
from skeinlog.sources import state
from skeinlog.sources.tables import table

SQL: dict[str, str] = {}


def adjudication_upsert(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", "event_type")
    return stores.upsert(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), "user_id", "event_id")


SQL["adjudication_upsert"] = "select user_id, max(event_id) as event_id, arg_max(event_type, event_id) as event_type from events group by 1"


def seed_statuses(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.lit("must_pass").alias("status"))
    have = p.where("p_partkey % 3 = 0").withColumn("status", F.lit("expected_fail"))
    return stores.insert_absent(have, p, "p_partkey")


SQL["seed_statuses"] = "select p_partkey, case when p_partkey % 3 = 0 then 'expected_fail' else 'must_pass' end as status from part"


def acted_set(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("key"), "event_type")
    on, off = e.where("event_type = 'purchase'"), e.where("event_type = 'error' and key % 4 = 0")
    return stores.unmark(stores.mark(on.limit(0), on), off)


SQL["acted_set"] = """
select distinct user_id as key from events where event_type = 'purchase'
and user_id not in (select user_id from events where event_type = 'error' and user_id % 4 = 0)"""


def frozen_corpus_diff(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    frozen = docs.where("doc_id % 7 <> 0")
    live = docs.where("doc_id % 5 <> 0").withColumn("text", F.when(F.col("doc_id") % 11 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return stores.frozen_diff(frozen, live, "doc_id", "text").groupBy("state").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))


SQL["frozen_corpus_diff"] = """
with s as (select doc_id, case when doc_id % 7 = 0 and doc_id % 5 = 0 then null when doc_id % 5 = 0 then 'gone' when doc_id % 7 = 0 then 'new'
  when doc_id % 11 = 0 then 'diverged' else 'same' end as state from documents)
select state, count(*) as n, min(doc_id) as first from s where state is not null group by 1"""


def show_contract(spark, d):
    c = table(spark, d, "customer").join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left")
    rows = c.groupBy("c_custkey").agg(F.sort_array(F.collect_list("o_orderkey")).alias("session_ids"), F.nullif(F.max("o_orderpriority"), F.lit("5-LOW")).alias("surface"))
    rows = rows.withColumn("session_ids", F.when(F.size("session_ids") > 0, F.col("session_ids")))
    return stores.contract(rows, ["session_ids"])


SQL["show_contract"] = """
with r as (select c_custkey, list(o_orderkey order by o_orderkey) filter (where o_orderkey is not null) as s, nullif(max(o_orderpriority), '5-LOW') as p
  from customer left join orders on c_custkey = o_custkey group by 1)
select '{"c_custkey":' || c_custkey || ',"session_ids":[' || coalesce(array_to_string(s, ','), '') || ']' || coalesce(',"surface":"' || p || '"', '') || '}' as json from r"""


def envelope_failures(spark, d):
    p = F.col("props")
    raw = F.when(F.col("event_type") == "error", F.lit('{"is_error": true}')).when(F.col("event_type") == "view", F.concat(F.lit('{"structured_output": '), p, F.lit("}"))).when(F.col("event_type") == "click", F.lit("{oops")).otherwise(F.lit("{}"))
    e = stores.envelope(table(spark, d, "events").select("event_type", raw.alias("raw")), "raw")
    k = F.try_variant_get("output", "$.k", "bigint")
    return e.groupBy("event_type", F.coalesce("failure", F.lit("")).alias("failure")).agg(F.count("*").alias("n"), F.coalesce(F.sum(k), F.lit(0)).alias("k_sum"))


SQL["envelope_failures"] = """
select event_type, case event_type when 'error' then 'model error' when 'view' then '' when 'click' then 'not JSON' else 'no output' end as failure, count(*) as n,
  coalesce(sum(case when event_type = 'view' then json_extract(props, '$.k')::bigint end), 0)::bigint as k_sum from events group by 1, 2"""


def repo_keys(spark, d):
    """Sessions of pages by the repository that their path tells."""
    path = F.regexp_extract("url", r"^https?://([^/]+)/", 1)
    repo = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("/w/"), path, F.lit("/.worktrees/x"))).otherwise(F.lit(""))
    cwd = F.when(F.col("page_id") % 3 == 1, F.concat(F.lit("/Users/u/Developer/"), path, F.lit("/src")))
    key = repos.repo_key(repo, cwd, {"m": "mobile"})
    return table(spark, d, "pages").groupBy(key.alias("repo")).agg(F.count("*").alias("n"))


SQL["repo_keys"] = r"""
with p as (select page_id, regexp_extract(url, '^https?://([^/]+)/', 1) as h from pages)
select case when page_id % 3 < 2 then h else '' end as repo, count(*) as n from p group by 1"""


def namespaced_ids(spark, d):
    id_ = F.concat_ws("/", F.concat(F.lit("r"), F.col("p_size").cast("string")), F.col("p_partkey").cast("string"))
    repo, rest = repos.split_id(id_)
    return table(spark, d, "part").select(id_.alias("id"), repo.alias("repo"), rest.alias("item"))


SQL["namespaced_ids"] = "select 'r' || p_size || '/' || p_partkey as id, 'r' || p_size as repo, p_partkey::varchar as item from part"


def cutover_diff(spark, d):
    """Suppliers whose counts differ between the lines of early and of late orders."""
    li = table(spark, d, "lineitem")
    return populations.cutover(li.where("l_linenumber <= 2"), li.where("l_linenumber between 3 and 4"), "l_suppkey")


SQL["cutover_diff"] = """
with c as (select l_suppkey, count(*) filter (where l_linenumber <= 2) as before, count(*) filter (where l_linenumber between 3 and 4) as after from lineitem group by 1)
select * from c where before <> after"""


def latest_snapshot(spark, d):
    """As of each purchase, the last view of the same user before it."""
    e = table(spark, d, "events")
    seen = F.last(F.when(F.col("event_type") == "view", F.col("event_id")), ignorenulls=True).over(Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1))
    return e.select("event_id", "user_id", "event_type", seen.alias("last_view")).where("event_type = 'purchase'").drop("event_type")


SQL["latest_snapshot"] = """
select event_id, user_id, last_view from (select *, last_value(case when event_type = 'view' then event_id end ignore nulls) over
  (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding) as last_view from events) where event_type = 'purchase'"""


def session_one_lines(spark, d):
    """One line for each session; a friction goes before a preference, and that before the first success."""
    li = table(spark, d, "lineitem")
    kind = F.when(F.col("l_returnflag") == "R", 3).when(F.col("l_returnflag") == "A", 2).otherwise(1)
    line = F.concat_ws(":", "l_returnflag", F.col("l_linenumber").cast("string"))
    place = F.when(kind == 1, -F.col("l_linenumber")).otherwise(F.col("l_linenumber"))
    return li.groupBy("l_orderkey").agg(F.max_by(line, F.struct(kind.alias("k"), place.alias("p"), "l_partkey", "l_suppkey")).alias("line"))


SQL["session_one_lines"] = """
with k as (select *, case l_returnflag when 'R' then 3 when 'A' then 2 else 1 end as k from lineitem)
select l_orderkey, arg_max(l_returnflag || ':' || l_linenumber, (k, case when k = 1 then -l_linenumber else l_linenumber end, l_partkey, l_suppkey)) as line from k group by 1"""


def side_matches(spark, d):
    """Matches that outrank the best counted one of their target but weren't counted."""
    li = table(spark, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", (F.col("l_quantity").cast("long") % 4).alias("g"), (F.col("l_partkey") % 3 == 0).alias("dropped"))
    best = li.where("not dropped").groupBy("l_suppkey").agg(F.max("g").alias("best"))
    return li.where("dropped").join(best, "l_suppkey", "left").where("g > coalesce(best, 0) or g = 3").groupBy("l_suppkey").agg(F.count("*").alias("n"), F.min("l_orderkey").alias("first"))


SQL["side_matches"] = """
with l as (select l_suppkey, l_orderkey, l_quantity::bigint % 4 as g, l_partkey % 3 = 0 as dropped from lineitem),
b as (select l_suppkey, max(g) as best from l where not dropped group by 1)
select l_suppkey, count(*) as n, min(l_orderkey) as first from l left join b using (l_suppkey) where dropped and (g > coalesce(best, 0) or g = 3) group by 1"""


def rubric_hash(spark, d):
    """A hash of a set of rubrics by source: of the sorted hashes of its texts."""
    b = table(spark, d, "documents").groupBy("source").agg(F.sort_array(F.collect_set(T.sha_hex(F.col("text")))).alias("h"))
    return b.select("source", F.size("h").cast("long").alias("n"), T.sha_hex(F.array_join("h", "\n")).alias("set_hash"))


SQL["rubric_hash"] = """
with h as (select distinct source, sha256(text) as h from documents)
select source, count(*) as n, sha256(string_agg(h, chr(10) order by h)) as set_hash from h group by 1"""



def _adoptions(spark, d):
    """Parts as findings; suppliers' numbers as files, of which some lack and some have other words."""
    p = F.col("p_partkey")
    f = table(spark, d, "part").select(
        F.col("p_partkey").alias("rank"), F.when(p % 4 == 0, "no").otherwise("yes").alias("adopted"), F.when(p % 9 != 0, F.concat(F.lit("/h/"), (p % 60).cast("string"))).alias("adopted_path"),
        F.when(p % 5 == 0, F.lit("")).when(p % 7 == 0, F.lit("other words")).otherwise(F.concat(F.lit("rule  "), (p % 60).cast("string"))).alias("adopted_excerpt"),
        (p % 3 == 0).alias("escalated"), F.when(p % 11 == 0, "habit").otherwise("hook").alias("asset_type"), F.when(p % 13 != 0, F.date_add(F.lit("2024-01-01").cast("date"), (p % 20).cast("int")).cast("string")).alias("last_seen"),
    )
    n = F.col("id").cast("string")
    assets = spark.range(50).select(F.concat(F.lit("/h/"), n).alias("path"), F.concat(F.lit("a rule "), n, F.lit(" of ours")).alias("content"))
    dates = spark.range(40).select(F.concat(F.lit("/h/"), n).alias("path"), F.lit("2024-01-10").alias("changed"))
    return f, assets, dates


_ADOPTIONS_SQL = """
f as (select p_partkey as k, p_partkey % 60 as file, p_partkey % 9 = 0 or p_partkey % 5 = 0 as lacking,
  case when p_partkey % 9 = 0 or p_partkey % 5 = 0 then 'lacking' when p_partkey % 60 >= 50 then 'unreadable' when p_partkey % 7 = 0 then 'not verbatim' end as state from part)"""


def adopted_downgrades(spark, d):
    f, assets, _ = _adoptions(spark, d)
    return verify.adopted(f, assets).groupBy("adopted", F.coalesce("downgraded", F.lit("-")).alias("why")).agg(F.count("*").alias("n"), F.min("rank").alias("first"))


SQL["adopted_downgrades"] = f"""with {_ADOPTIONS_SQL}
select case when k % 4 = 0 then 'no' when state is null then 'yes' else 'unknown' end as adopted, case when k % 4 = 0 then '-' else coalesce(state, '-') end as why, count(*) as n, min(k) as first from f group by 1, 2"""


def escalation_states(spark, d):
    f, assets, dates = _adoptions(spark, d)
    e = f.withColumnsRenamed({"adopted_path": "escalated_path", "adopted_excerpt": "escalated_excerpt"})
    return verify.escalations(e, assets, dates).where("state is not null").select("rank", "state")


SQL["escalation_states"] = f"""with {_ADOPTIONS_SQL}
select k as rank, case when k % 11 = 0 then 'habit' when state is not null then state when file >= 40 or k % 13 = 0 then 'undated' when k % 20 < 9 then 'removed' else 'kept' end as state from f where k % 3 = 0"""


def frozen_gaps(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 100).alias("mtime"))
    entries = o.where("id % 3 = 0").withColumn("mtime", F.when(F.col("id") % 10 == 0, -1).otherwise(F.col("mtime")))
    return state.frozen_gaps(o, o.where("id % 8 <> 1"), entries)


SQL["frozen_gaps"] = """
select o_orderkey as id, case when o_orderkey % 8 = 1 then 'gap' else 'skew' end as problem from orders where o_orderkey % 8 = 1 or (o_orderkey % 3 = 0 and o_orderkey % 10 = 0)"""


def rubric_errors(spark, d):
    """Parts as rubrics with fields that break one rule or other."""
    p = F.col("p_partkey")
    of = lambda m, *v: F.element_at(F.array(*map(F.lit, v)), (F.floor(p / m) % len(v) + 1).cast("int"))
    ids = lambda m: F.when(p % m == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("a")))
    r = table(spark, d, "part").select(
        p.cast("string").alias("id"), p.cast("string").alias("file"), of(1, *state.PARTS, "odd").alias("part"), of(2, "HIGH", "MEDIUM", "LOW").alias("tier"), of(3, "theme", "none").alias("surface"), F.when(p % 17 != 0, "s").alias("statement"),
        F.when(p % 19 == 0, "most").alias("pass_at"), F.when(p % 23 == 0, "odd").alias("seed_status"), F.lit("").alias("anchor_theme"), F.when(p % 6 != 0, F.array(F.lit("r"))).alias("repos"), ids(2).alias("anchor_session_ids"), ids(5).alias("source_theme_session_ids"),
    )
    return state.rubric_errors(r).groupBy("error").agg(F.count("*").alias("n"), F.min(F.col("id").cast("long")).alias("first"))


SQL["rubric_errors"] = """
with r as (select p_partkey as k, p_partkey % 4 < 2 as target, p_partkey % 4 = 2 as negative, p_partkey % 2 > 0 as anchored, p_partkey % 5 > 0 as source from part),
e as (select k, unnest([case when k % 17 = 0 then 'id and statement' end, case when k % 4 = 3 then 'part' end, case when target and k // 2 % 3 = 2 then 'tier' end, case when target and k // 3 % 2 = 1 then 'surface' end,
  case when target and k % 6 = 0 then 'repos' end, case when k % 4 = 1 and anchored then 'anchors of a gap' end, case when target and anchored and not source then 'source sessions of anchors' end,
  case when target and not anchored and source then 'source sessions without anchors' end, case when negative and (anchored or source) then 'anchors of a negative' end,
  case when k % 19 = 0 then 'pass_at' end, case when k % 23 = 0 then 'seed_status' end]) as error from r)
select error, count(*) as n, min(k) as first from e where error is not null group by 1"""

QUERIES = {name: globals()[name] for name in SQL}
