"""Queries over documents, benchmark and the order tables: evidence, quotes, similarity, verification, evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skeinlog.functions import text as T
from skeinlog.operators import evals, repos, select, signals, similarity, verify
from skeinlog.sources.tables import table

SQL: dict[str, str] = {}


def evidence_sanitise(spark, d):
    return table(spark, d, "documents").select("doc_id", T.sanitise(F.col("text")).alias("evidence"))


_TRIM = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(133) || chr(160)"
_SANITISE_SQL = (
    r"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim({0}, """ + _TRIM + r"""), '^<tool_use_error>|</tool_use_error>$', '', 'g'),
  '(?i)[0-9a-f]{{8}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{12}}', '[id]', 'g'), '(?i)\bsc-\d+\b', '[ticket]', 'g'),
  '\$HOME[^\s]*|/(?:Users|home|private|var|tmp)/[^\s]*|[^\s]*\.worktrees/[^\s]*', '[path]', 'g'), '\s+', ' ', 'g'))[1:160]"""
)
SQL["evidence_sanitise"] = f"select doc_id, {_SANITISE_SQL.format('text')} as evidence from documents"


def error_signatures(spark, d):
    s = table(spark, d, "documents").select(T.error_signature(F.col("text")).alias("signature"))
    return s.groupBy("signature").agg(F.count("*").alias("n"))


SQL["error_signatures"] = rf"""
with f as (select string_split(trim(text, {_TRIM}), chr(10))[1] as l from documents)
select regexp_replace({_SANITISE_SQL.format('l')}, '\d+', 'N', 'g')[1:120] as signature, count(*) as n from f group by 1"""


def privacy_labels(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(T.private_labels(F.col("text")), ",").alias("labels")).where("labels <> ''")


SQL["privacy_labels"] = r"""
with m as (select doc_id, 1 as k, 'users_path' as label, unnest(regexp_extract_all(text, '(?i)/users/([a-z0-9._-]+)', 1)) as name from documents
  union all select doc_id, 2, 'users_slug', unnest(regexp_extract_all(text, '(?i)-users-([a-z0-9._]+)', 1)) from documents
  union all select doc_id, 3, 'home_path', unnest(regexp_extract_all(text, '(?i)/home/([a-z0-9._-]+)', 1)) from documents
  union all select doc_id, 4, 'home_slug', unnest(regexp_extract_all(text, '(?i)-home-([a-z0-9._]+)', 1)) from documents
  union all select doc_id, 5, 'uuid', unnest(regexp_extract_all(text, '(?i)[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}')) from documents
  union all select doc_id, 6, 'ticket', unnest(regexp_extract_all(text, '(?i)\bsc-[0-9]{4,}\b')) from documents),
k as (select distinct doc_id, k, label from m where not (label like 'users%' and lower(name) = 'dev') and not (label like 'home%' and lower(name) = 'user')
  and not (label = 'uuid' and (lower(name) like '00000000-%' or lower(name) like '0abc1234-%')))
select doc_id, string_agg(label, ',' order by k) as labels from k group by doc_id"""


def quantitative_claims(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.count_if(T.has_quantity(F.col("text"))).alias("claims"), F.count("*").alias("n"))


SQL["quantitative_claims"] = r"select source, count(*) filter (where regexp_matches(text, '\d+\s*%|\b\d+\s+(sessions?|times?|incidents?)\b|\b\d+\s+of\s+\d+\b')) as claims, count(*) as n from documents group by source"


def verbatim_quotes_exact(spark, d):
    return similarity.quoted(table(spark, d, "documents"), table(spark, d, "benchmark"))


SQL["verbatim_quotes_exact"] = "select doc_id, item_id from documents d join benchmark b on contains(d.text, b.text)"


def verbatim_quotes_normalised(spark, d):
    return similarity.quoted(table(spark, d, "documents"), table(spark, d, "benchmark"), T.fingerprint_text)


SQL["verbatim_quotes_normalised"] = r"""
with d as (select doc_id, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) as t from documents),
b as (select item_id, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) as q from benchmark)
select doc_id, item_id from d join b on contains(t, q)"""


def quotes_dropped(spark, d):
    """Quotes that no document has, and those that are too short to be checked."""
    q = table(spark, d, "benchmark")
    found = similarity.quoted(table(spark, d, "documents"), q).select("item_id").distinct()
    lost = q.join(found, "item_id", "left_anti")
    return lost.agg(F.count("*").alias("dropped"), F.count_if(F.length("text") < T.MIN_QUOTE).alias("too_short"), F.min("item_id").alias("first_item"))


SQL["quotes_dropped"] = """
select count(*) as dropped, count(*) filter (where length(text) < 12) as too_short, min(item_id) as first_item
from benchmark b where not exists (select 1 from documents d where contains(d.text, b.text))"""


def exact_dup_clusters(spark, d):
    return similarity.duplicate_groups(table(spark, d, "documents"), "doc_id", "text")


SQL["exact_dup_clusters"] = "select min(doc_id) as cluster, count(*) as n from documents group by sha256(text) having count(*) > 1"

_BAG_SQL = r"""
w as (select item_id as id, regexp_replace(unnest(regexp_split_to_array(lower(text), '\s+')), '^[^\p{L}\p{Nd}]+|[^\p{L}\p{Nd}]+$', '', 'g') as t from benchmark),
g as (select id, t, count(*) as n from w where t <> '' group by 1, 2),
z as (select id, sum(n)::bigint as size from g group by 1),
s as (select a.id as a, b.id as b, sum(least(a.n, b.n))::bigint as inter from g a join g b on a.t = b.t and a.id < b.id group by 1, 2),
pairs as (select s.a, s.b, inter, x.size as size_a, y.size as size_b from s join z x on x.id = s.a join z y on y.id = s.b where inter >= 0.1 * (x.size + y.size - inter))"""


def similar_pairs(spark, d):
    return similarity.similar_pairs(table(spark, d, "benchmark"), "item_id", "text", 0.1)


SQL["similar_pairs"] = f"with {_BAG_SQL} select * from pairs"


def practice_clusters(spark, d):
    got = similarity.clusters(similarity.similar_pairs(table(spark, d, "benchmark"), "item_id", "text", 0.1))
    return got.groupBy("cluster").agg(F.count("*").alias("members")).where("members >= 2")


SQL["practice_clusters"] = f"""with recursive {_BAG_SQL},
e as (select a as x, b as y from pairs union select b, a from pairs),
r(x, y) as (select x, x from e union select r.x, e.y from r join e on e.x = r.y),
c as (select x, min(y) as cluster from r group by x)
select cluster, count(*) as members from c group by cluster having count(*) >= 2"""


def acted_keys(spark, d):
    return table(spark, d, "documents").select("doc_id", T.acted_key(F.col("source"), F.col("lang") == "fr", F.col("text")).alias("acted_key"))


SQL["acted_keys"] = r"""
select doc_id, sha256(source || case when lang = 'fr' then chr(0) || 'esc' || chr(0) else chr(0) end || lower(trim(regexp_replace(text, '\s+', ' ', 'g'))))[1:16] as acted_key from documents"""


def idset_hash(spark, d):
    # a set's hash needs the set in one row; it is that of one customer's orders
    o = table(spark, d, "orders").select("o_custkey", F.col("o_orderkey").cast("string").alias("id"))
    return o.groupBy("o_custkey").agg(F.count("*").alias("n"), T.set_hash(F.collect_set("id")).alias("set_hash"))


SQL["idset_hash"] = """
select o_custkey, count(*) as n, sha256(array_to_string(list_sort(list_distinct(list(o_orderkey::varchar))), chr(0)) || chr(0)) as set_hash from orders group by 1"""


def message_dedup_tokens(spark, d):
    """Of lines with one id only the first counts; two measures are summed, one is a peak."""
    li = table(spark, d, "lineitem")
    first = li.groupBy("l_orderkey").agg(F.min_by(F.struct("l_suppkey", "l_quantity", "l_partkey"), F.struct("l_linenumber", "l_partkey", "l_suppkey")).alias("r"))
    return first.groupBy(F.col("r.l_suppkey").alias("l_suppkey")).agg(F.count("*").alias("messages"), F.sum(F.col("r.l_quantity").cast("long")).alias("quantity"), F.max("r.l_partkey").alias("peak_part"))


SQL["message_dedup_tokens"] = """
with f as (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) as k from lineitem)
select l_suppkey, count(*) as messages, sum(l_quantity::bigint)::bigint as quantity, max(l_partkey) as peak_part from f where k = 1 group by 1"""


def _by_nation(spark, d):
    o, c, n = (table(spark, d, t) for t in ("orders", "customer", "nation"))
    # orders meet customers by a shuffle that AQE can split; the nations, 25 rows by definition, are broadcast
    return o.select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority").join(c.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(n.select("n_nationkey", "n_name")), F.col("c_nationkey") == F.col("n_nationkey"))


_NATION_SQL = "orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey"


def repo_bundles_floor(spark, d):
    return signals.floored(_by_nation(spark, d), "n_name", 10, F.count_distinct("o_custkey").alias("customers"))


SQL["repo_bundles_floor"] = f"select n_name, count(*) as n, count(distinct o_custkey) as customers from {_NATION_SQL} group by 1 having count(*) >= 10"


def bundle_window(spark, d):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    return _by_nation(spark, d).groupBy("n_name").agg(F.min(day).alias("from_day"), F.max(day).alias("to_day"), F.count("*").alias("n"))


SQL["bundle_window"] = f"select n_name, strftime(min(o_orderdate), '%Y-%m-%d') as from_day, strftime(max(o_orderdate), '%Y-%m-%d') as to_day, count(*) as n from {_NATION_SQL} group by 1"


def context_rollup(spark, d):
    return _by_nation(spark, d).groupBy("n_name", "o_orderpriority").agg(F.count("*").alias("n"))


SQL["context_rollup"] = f"select n_name, o_orderpriority, count(*) as n from {_NATION_SQL} group by 1, 2"


def evidence_ids(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return select.numbered(o, ["o_custkey"], ["o_orderdate", "o_orderkey"], "F").select("o_custkey", "o_orderkey", "evidence_id")


SQL["evidence_ids"] = "select o_custkey, o_orderkey, 'F' || row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as evidence_id from orders"


def dangling_citations(spark, d):
    """Lines that cite a part which the evidence doesn't list."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_partkey")
    known = table(spark, d, "part").where("p_size <= 25").select("p_partkey")
    return li.join(known, li["l_partkey"] == known["p_partkey"], "left_anti").groupBy("l_partkey").agg(F.count("*").alias("n"), F.min("l_orderkey").alias("first_order"))


SQL["dangling_citations"] = """
select l_partkey, count(*) as n, min(l_orderkey) as first_order from lineitem where not exists (select 1 from part where p_partkey = l_partkey and p_size <= 25) group by 1"""


def finding_recount(spark, d):
    """What a finding says of itself is counted anew from what it cites."""
    li = table(spark, d, "lineitem").join(table(spark, d, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    per = li.groupBy("p_brand", "l_suppkey", "l_orderkey").agg(F.max("l_shipdate").alias("last"))  # two steps instead of two distinct counts
    sup = per.groupBy("p_brand", "l_suppkey").agg(F.count("*").alias("pairs"), F.max("last").alias("last"))
    return sup.groupBy("p_brand").agg(F.count("*").alias("repos"), F.sum("pairs").alias("sessions"), F.date_format(F.max("last"), "yyyy-MM-dd").alias("last_seen"))


SQL["finding_recount"] = """
select p_brand, count(distinct l_suppkey) as repos, count(distinct (l_suppkey, l_orderkey)) as sessions, strftime(max(l_shipdate), '%Y-%m-%d') as last_seen
from lineitem join part on l_partkey = p_partkey group by 1"""


def global_window(spark, d):
    day = lambda c: F.nullif(F.date_format(c, "yyyy-MM-dd"), F.lit(""))
    return table(spark, d, "orders").agg(F.min(day("o_orderdate")).alias("from_day"), F.max(day("o_orderdate")).alias("to_day"), F.count("*").alias("n"))


SQL["global_window"] = "select strftime(min(o_orderdate), '%Y-%m-%d') as from_day, strftime(max(o_orderdate), '%Y-%m-%d') as to_day, count(*) as n from orders"


def rank_permutation(spark, d):
    p = table(spark, d, "part").select("p_brand", (F.col("p_partkey") % 1000 + 1).alias("rank"))
    return select.rank_check(p, "p_brand", "rank")


SQL["rank_permutation"] = """
with p as (select p_brand, p_partkey % 1000 + 1 as r from part)
select p_brand, count(*) as n, count(distinct r) = count(*) and min(r) = 1 and max(r) = count(*) as is_permutation from p group by 1"""


def rank_renumber(spark, d):
    p = table(spark, d, "part").where("p_size > 10")
    w = Window.partitionBy("p_brand").orderBy("p_size", "p_partkey")
    return p.select("p_brand", "p_partkey", F.row_number().over(w).cast("long").alias("rank"))


SQL["rank_renumber"] = "select p_brand, p_partkey, row_number() over (partition by p_brand order by p_size, p_partkey) as rank from part where p_size > 10"


def corroboration_class(spark, d):
    """A customer's orders are an item's sessions; those of even key are its anchors."""
    o = table(spark, d, "orders")
    ids = o.groupBy("o_custkey").agg(F.sort_array(F.collect_set(F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderkey")))).alias("sessions"), F.sort_array(F.collect_set(F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderkey")))).alias("anchors"))
    kind = evals.corroborate(F.col("o_custkey") % 11 == 0, F.col("o_custkey") % 2 == 0, F.col("sessions"), F.col("anchors"), F.lit(3))
    return ids.select("o_custkey", kind.alias("class"))


SQL["corroboration_class"] = """
with s as (select o_custkey, coalesce(list(distinct o_orderkey) filter (where o_orderkey % 3 <> 0), []) as ss, coalesce(list(distinct o_orderkey) filter (where o_orderkey % 2 = 0), []) as a from orders group by 1),
h as (select *, len(list_intersect(ss, a)) as h from s)
select o_custkey, case when o_custkey % 11 = 0 then 'dropped' when len(a) = 0 then 'no_anchors' when len(ss) = 0 then 'anchor_mismatch'
  when not (h >= 0.5 * len(a) or (o_custkey % 2 = 0 and h >= 1 and h >= 0.5 * len(ss))) then 'anchor_mismatch'
  when len(ss) > 11 then 'size_cap' when h >= 0.5 * len(a) then 'corroborated' else 'grounded' end as class from h"""


def _votes(spark, d):
    """(target, sample, repeat, granularity): a vote for each line of an order."""
    li = table(spark, d, "lineitem")
    return li.select((F.col("l_suppkey") % 50).alias("target"), (F.col("l_orderkey") % 3).alias("sample"), (F.col("l_linenumber") % 5).cast("long").alias("repeat"), (F.col("l_quantity").cast("long") % 4).alias("granularity"))


_VOTES_SQL = "v as (select l_suppkey % 50 as target, l_orderkey % 3 as sample, (l_linenumber % 5)::bigint as repeat, l_quantity::bigint % 4 as granularity from lineitem)"


def median_granularity(spark, d):
    return _votes(spark, d).groupBy("target", "sample").agg(evals.lower_median("granularity").alias("median"), F.count("*").alias("votes"))


SQL["median_granularity"] = f"with {_VOTES_SQL} select target, sample, quantile_disc(granularity, 0.5) as median, count(*) as votes from v group by 1, 2"


def repeat_argmax(spark, d):
    """Of a repeat's items the one that matches best: granularity, then number of nuances, then the smallest id."""
    li = table(spark, d, "lineitem")
    key = F.struct((F.col("l_quantity").cast("long") % 4).alias("g"), (F.col("l_partkey") % 5).alias("nu"), (-F.col("l_orderkey")).alias("o"), (-F.col("l_linenumber")).alias("l"))
    return li.groupBy("l_suppkey").agg(F.max(key).alias("k")).select("l_suppkey", F.col("k.g").alias("granularity"), F.col("k.nu").alias("nuances"), (-F.col("k.o")).alias("item"))


SQL["repeat_argmax"] = """
select l_suppkey, g as granularity, nu as nuances, l_orderkey as item from (
  select l_suppkey, l_orderkey, l_quantity::bigint % 4 as g, l_partkey % 5 as nu,
    row_number() over (partition by l_suppkey order by l_quantity::bigint % 4 desc, l_partkey % 5 desc, l_orderkey, l_linenumber) as k from lineitem) where k = 1"""


def negative_majority(spark, d):
    lab = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "source"), "doc_id")
    return lab.groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("quality") == 1).alias("matched"), (F.count_if(F.col("quality") == 1) * 2 > F.count("*")).alias("fires"))


SQL["negative_majority"] = """
select source, count(*) as n, count(*) filter (where quality = 1) as matched, count(*) filter (where quality = 1) * 2 > count(*) as fires
from labels join documents using (doc_id) group by 1"""



def _status():
    return F.when(F.col("target") % 5 == 0, "expected_partial").when(F.col("target") % 5 == 1, "expected_fail").otherwise("must_pass")


_STATUS_SQL = "case when target % 5 = 0 then 'expected_partial' when target % 5 = 1 then 'expected_fail' else 'must_pass' end"


def target_status(spark, d):
    m = _votes(spark, d).groupBy("target").agg(evals.lower_median("granularity").alias("median")).withColumn("status", _status())
    meets, hard = evals.status_of(F.col("status"), F.col("median"), F.lit(3), F.when(F.col("target") % 2 == 0, "HIGH").otherwise("MODERATE"), F.col("target") % 7 == 2)
    return m.select("target", "status", "median", meets.alias("meets"), hard.alias("hard_fail"))


SQL["target_status"] = f"""
with {_VOTES_SQL}, m as (select target, quantile_disc(granularity, 0.5) as median, {_STATUS_SQL} as status from v group by 1)
select target, status, median, case when status = 'must_pass' then median >= 3 and target % 7 <> 2 when status = 'expected_partial' then median > 0 else true end as meets,
  case when status = 'must_pass' then target % 2 = 0 and median < 3 when status = 'expected_partial' then median = 0 else false end as hard_fail from m"""


def weighted_recall(spark, d):
    m = _votes(spark, d).groupBy("target").agg(evals.lower_median("granularity").alias("median"))
    w = F.when(F.col("target") % 3 == 0, evals.WEIGHT["HIGH"]).when(F.col("target") % 3 == 1, evals.WEIGHT["MODERATE-HIGH"]).otherwise(evals.WEIGHT["MODERATE"])
    got = m.agg(F.sum(w).alias("weight"), F.coalesce(F.sum(F.when(F.col("median") >= 2, w)), F.lit(0)).alias("passed"))
    return got.withColumn("recall", evals.ratio(F.col("passed"), F.col("weight"), 1.0))


SQL["weighted_recall"] = f"""
with {_VOTES_SQL}, m as (select target, quantile_disc(granularity, 0.5) as median, case target % 3 when 0 then 3 when 1 then 2 else 1 end as w from v group by 1)
select sum(w)::bigint as weight, coalesce(sum(w) filter (where median >= 2), 0)::bigint as passed, coalesce(sum(w) filter (where median >= 2), 0) / sum(w) as recall from m"""


def baseline_delta(spark, d):
    """Targets whose median differs between the first and the last sample."""
    m = _votes(spark, d).groupBy("target", "sample").agg(evals.lower_median("granularity").alias("median"))
    a = m.where("sample = 0").select("target", F.col("median").alias("before"))
    b = m.where("sample = 2").select("target", F.col("median").alias("after"))
    return a.join(b, "target").where("before <> after").withColumn("direction", F.when(F.col("after") > F.col("before"), "up").otherwise("down"))


SQL["baseline_delta"] = f"""
with {_VOTES_SQL}, m as (select target, sample, quantile_disc(granularity, 0.5) as median from v group by 1, 2)
select a.target, a.median as before, b.median as after, case when b.median > a.median then 'up' else 'down' end as direction
from m a join m b on a.target = b.target and a.sample = 0 and b.sample = 2 where a.median <> b.median"""


def ever_passed(spark, d):
    m = _votes(spark, d).groupBy("target", "sample").agg(evals.lower_median("granularity").alias("median"))
    return m.groupBy("target").agg(F.bool_or(F.col("median") >= 2).alias("ever_passed"), F.count_if(F.col("median") >= 2).alias("samples_passed"))


SQL["ever_passed"] = f"""
with {_VOTES_SQL}, m as (select target, sample, quantile_disc(granularity, 0.5) as median from v group by 1, 2)
select target, bool_or(median >= 2) as ever_passed, count(*) filter (where median >= 2) as samples_passed from m group by 1"""


def sample_churn(spark, d):
    """For each pair of samples that follow one another, the share of a target's parts that don't recur."""
    v = table(spark, d, "lineitem").select((F.col("l_suppkey") % 50).alias("target"), (F.col("l_orderkey") % 3).alias("sample"), (F.col("l_partkey") % 40).alias("part"))
    s = v.groupBy("target", "sample").agg(F.collect_set("part").alias("s"))
    nxt = F.lead("s").over(Window.partitionBy("target").orderBy("sample"))
    p = s.select("target", "sample", "s", nxt.alias("t")).where("t is not null")
    return p.select("target", "sample", F.round(1 - F.size(F.array_intersect("s", "t")) / F.size(F.array_union("s", "t")), 9).alias("churn"))


SQL["sample_churn"] = """
with v as (select distinct l_suppkey % 50 as target, l_orderkey % 3 as sample, l_partkey % 40 as part from lineitem),
s as (select target, sample, list(part) as s from v group by 1, 2),
p as (select target, sample, s, lead(s) over (partition by target order by sample) as t from s)
select target, sample, round(1 - len(list_intersect(s, t)) / len(list_distinct(list_concat(s, t))), 9) as churn from p where t is not null"""


def _findings(spark, d):
    """A finding for each part: kinds of asset and of evidence, audiences, and what it says, by the part's columns."""
    of = lambda values, c: F.element_at(F.array(*[F.lit(v) for v in values]), (F.col(c) % len(values) + 1).cast("int"))
    p = table(spark, d, "part")
    asset = of(sorted(verify.GROUNDING), "p_size")
    return p.select(
        F.col("p_partkey").alias("rank"), F.col("p_name").alias("title"), F.when(F.col("p_partkey") % 13 == 0, "see $HOME/x").otherwise(F.col("p_type")).alias("statement"),
        F.when(F.col("p_partkey") % 17 == 0, F.concat(F.col("p_size").cast("string"), F.lit(" of 60"))).otherwise(F.lit("none")).alias("rationale"), asset.alias("asset_type"),
        of(("user", "both", "", "martians"), "p_partkey").alias("audience"), of(("yes", "no", "maybe"), "p_partkey").alias("adopted"),
        (F.col("p_partkey") % 5 == 0).alias("escalated"), F.array(F.concat(F.lit("E"), (F.col("p_partkey") % 9).cast("string"))).alias("evidence_ids"),
    )


def finding_violations(spark, d):
    """How many findings break each rule; the evidence is E0 to E7, of all kinds, so E8 dangles."""
    rows = spark.range(8).select(
        F.concat(F.lit("E"), F.col("id").cast("string")).alias("id"), F.substring(F.lit("FPSGFPSG"), (F.col("id") + 1).cast("int"), F.lit(1)).alias("kind"),
        F.when(F.col("id") == 3, "retyped_kickoffs").otherwise("high_read").alias("signal_kind"), F.lit("r").alias("repo"), F.array(F.lit("s")).alias("session_ids"),
    )
    return verify.violations(_findings(spark, d), rows).groupBy("rule").agg(F.count("*").alias("n"))


SQL["finding_violations"] = r"""
with p as (select p_partkey as k, (['claude_md_rule', 'habit', 'hook', 'new_skill', 'repo_doc', 'setting'])[p_size % 6 + 1] as a, (['user', 'both', '', 'martians'])[p_partkey % 4 + 1] as who,
  p_partkey % 5 = 0 as esc, p_partkey % 9 as e, p_name || chr(10) || case when p_partkey % 13 = 0 then 'see $HOME/x' else p_type end || chr(10)
    || case when p_partkey % 17 = 0 then p_size || ' of 60' else 'none' end as free, trim(p_name) as title from part),
k as (select *, 'FPSGFPSG'[e + 1] as kind from p),
r as (
  select 'ranks' as rule from (select count(*) as n, max(k) as hi from p) where n > 10 or hi <> n
  union all select 'title' from p where title = ''
  union all select 'adopted' from p where k % 3 = 2
  union all select 'audience' from p where who = 'martians' or (who = '' and a in ('claude_md_rule', 'repo_doc'))
  union all select 'escalated_habit' from p where esc and a = 'habit'
  union all select 'quantity' from p where regexp_matches(free, '\d+\s*%|\b\d+\s+(sessions?|times?|incidents?)\b|\b\d+\s+of\s+\d+\b')
  union all select 'privacy' from p where free like '%/Users/%' or free like '%$HOME%' or regexp_matches(free, '[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}|\bsc-\d+\b')
  union all select 'dangling' from p where e = 8
  union all select 'grounding' from k where e < 8 and not case when esc then kind in ('P', 'F') when a in ('claude_md_rule', 'repo_doc') then kind in ('P', 'F')
    when a in ('hook', 'setting') then kind in ('F', 'G') when a = 'habit' then kind in ('F', 'S') else kind = 'P' or e = 3 end)
select rule, count(*) as n from r group by rule"""


def session_to_root(spark, d):
    """Which of the configured roots a page's path begins with, at a component's boundary; the first in their order."""
    roots = ["/en", "/fr", "/de", "/es", "/e"]
    path = F.regexp_extract("url", r"^https?://[^/]+(/[^?#]*)", 1)
    hit = F.coalesce(repos.root_of(path, roots), F.lit("unavailable"))
    return table(spark, d, "pages").groupBy(hit.alias("root")).agg(F.count("*").alias("n"))


SQL["session_to_root"] = r"""
with p as (select regexp_extract(url, '^https?://[^/]+(/[^?#]*)', 1) as path from pages)
select case when path = '/en' or path like '/en/%' then '/en' when path = '/fr' or path like '/fr/%' then '/fr' when path = '/de' or path like '/de/%' then '/de'
  when path = '/es' or path like '/es/%' then '/es' when path = '/e' or path like '/e/%' then '/e' else 'unavailable' end as root, count(*) as n from p group by 1"""

QUERIES = {name: globals()[name] for name in SQL}
