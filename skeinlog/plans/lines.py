"""Queries over transcripts' lines, which are made of events and conversations: each event is a line of its user's session, each turn one
of its conversation's. They drive the decoder, the facts, the reduced transcript and the signals; their SQL reads the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinlog.functions import classify as K
from skeinlog.operators import detect, facts, reduce
from skeinlog.sources import transcripts
from skeinlog.sources.tables import table

SQL: dict[str, str] = {}
REJECTED = K.REJECTION + "."
SAID = f"{K.REJECTION}. To tell you how to proceed, {K.REASON}\nuse "


def _by(n, *values):
    """The value whose place is event_id modulo their number."""
    return F.element_at(F.array(*[v if not isinstance(v, str) else F.lit(v) for v in values]), (n % len(values) + 1).cast("int"))


def _lines(spark: SparkSession, d: str) -> DataFrame:
    """Events as decoded lines; some are malformed, some of a type that no one knows."""
    e, n = table(spark, d, "events"), F.col("event_id")
    ts = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    text = lambda head, c: F.concat(F.lit(head), c.cast("string"))
    row = lambda **c: F.to_json(F.struct(*[v.alias(k) for k, v in c.items()]))
    of = lambda **c: F.struct(*[v.alias(k) for k, v in c.items()])
    usage = of(input_tokens=n % 1000, output_tokens=n % 7, cache_creation_input_tokens=n % 5, cache_read_input_tokens=n % 900)
    tool = _by(n, "Read", "Edit", "Agent", "Read")
    used = of(type=F.lit("tool_use"), name=tool, input=of(file_path=text("/w/f", n % 9), subagent_type=F.when(tool == "Agent", text("kind", n % 3))))
    body = _by(n, text("File has not been read yet, line ", n), text(SAID, n), REJECTED, f"{K.INTERRUPT} for tool use]", text("exit status ", n), "cannot find main module")
    said = _by(n, f" {K.INTERRUPT}]", text("Add a  retry to client ", n % 13), f"{K.NOTIFICATION}done", "<system-reminder>x", "continue", text(SAID, n))
    patch = F.array(of(lines=F.when(n % 2 == 1, F.array(F.lit("+a"), F.lit("-b"), F.lit(" c"))).otherwise(F.array(F.lit("+a"), F.lit(" c")))))
    user, assistant = F.lit("user"), F.lit("assistant")
    raw = (
        F.when(n % 50 == 7, F.lit('{"type": '))
        .when(n % 50 == 11, row(type=F.lit("brand-new"), timestamp=ts))
        .when(F.col("event_type") == "view", row(type=assistant, timestamp=ts, message=of(id=text("m", F.floor(n / 100)), model=text("m", n % 3), content=F.array(used), usage=usage)))
        .when(F.col("event_type") == "click", row(type=assistant, timestamp=F.when(n % 20 != 0, ts), gitBranch=text("b", n % 4), message=of(content=text("plain text ", n), usage=F.when(n % 10 != 3, of(output_tokens=F.lit(2))))))
        .when(F.col("event_type") == "error", row(type=user, timestamp=ts, message=of(content=F.array(of(type=F.lit("tool_result"), is_error=F.lit(True), content=body)))))
        .when(F.col("event_type") == "signup", row(type=user, timestamp=ts, cwd=text("/w/p", F.col("user_id") % 3), message=of(content=said)))
        .otherwise(row(type=user, timestamp=ts, attributionSkill=text("s", n % 3), message=of(content=F.array(of(type=F.lit("odd"), text=F.lit("z")))), toolUseResult=of(filePath=text("/w/f", n % 6), structuredPatch=patch)))
    )
    return transcripts.decode(e.select(text("u", F.col("user_id")).alias("session_id"), n.alias("line_no"), raw.alias("raw")))


def _turns(spark: SparkSession, d: str) -> DataFrame:
    """Turns of conversations as decoded lines."""
    message = F.struct(F.array(F.struct(F.lit("text").alias("type"), "text")).alias("content"))
    raw = F.to_json(F.struct(F.col("role").alias("type"), message.alias("message")))
    return transcripts.decode(table(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("session_id"), F.col("turn").alias("line_no"), raw.alias("raw")))


# The same of the tables: k is what an event's line is, r the place in the lists of texts; a malformed line has no k.
_SQL = f"""
b as (select *, event_id as e, 'u' || user_id as session_id, event_id % 6 as r,
  case when event_id % 50 = 7 then null when event_id % 50 = 11 then 'brand-new' else event_type end as k from events),
w as (select * from b where k is not null),
x as (select *, case when k in ('view', 'click') then 'assistant' when k = 'brand-new' then k else 'user' end as line_type,
  case when k = 'click' and e % 20 = 0 then null else ts end as tm,
  case k when 'error' then case r when 0 then 'File has not been read yet, line ' || e when 1 then {SAID!r} || e when 2 then {REJECTED!r} when 3 then '{K.INTERRUPT} for tool use]' when 4 then 'exit status ' || e else 'cannot find main module' end end as body,
  case k when 'signup' then case r when 0 then ' {K.INTERRUPT}]' when 1 then 'Add a  retry to client ' || e % 13 when 2 then '{K.NOTIFICATION}done' when 3 then '<system-reminder>x' when 4 then 'continue' else {SAID!r} || e end when 'click' then 'plain text ' || e end as said,
  (['Read', 'Edit', 'Agent', 'Read'])[e % 4 + 1] as tool from w)""".replace(repr(SAID), "'" + SAID.replace("'", "''").replace("\n", "' || chr(10) || '") + "'").replace(repr(REJECTED), "'" + REJECTED.replace("'", "''") + "'")


def transcript_types(spark, d):
    ev = transcripts.events(_lines(spark, d))
    return ev.groupBy("type").agg(F.count("*").alias("n"), F.count("ts").alias("timed"), F.unix_micros(F.max("ts")).alias("last"), F.sum("cache_read").alias("cache_read"), F.count_if("patched").alias("patched"))


SQL["transcript_types"] = f"""with {_SQL}
select line_type as type, count(*) as n, count(tm) as timed, epoch_us(max(tm)) as last, sum(case k when 'view' then e % 900 else 0 end)::bigint as cache_read, count(*) filter (where k = 'purchase') as patched from x group by 1"""


def transcript_canary(spark, d):
    return transcripts.canary(_lines(spark, d))


SQL["transcript_canary"] = f"""with {_SQL}, c as (
  select session_id, 'malformed' as kind, 'line' as key from b where k is null union all
  select session_id, 'unknown_line_type', k from x where k = 'brand-new' union all
  select session_id, 'unknown_block_type', 'odd' from x where k = 'purchase' union all
  select session_id, 'missing', 'timestamp' from x where tm is null and line_type <> 'brand-new' union all
  select session_id, 'missing', 'assistant.usage' from x where k = 'click' and e % 10 = 3)
select session_id, kind, key, count(*) as n from c group by 1, 2, 3"""


def transcript_blocks(spark, d):
    b = transcripts.blocks(transcripts.events(_lines(spark, d)))
    return b.groupBy("session_id", "line_type", "block_type").agg(F.count("*").alias("n"), F.count_if("is_error").alias("errors"), F.sum(F.length("text")).alias("text"), F.sum(F.length("body")).alias("body"), F.count("tool_name").alias("tools"))


SQL["transcript_blocks"] = f"""with {_SQL}
select session_id, line_type, case k when 'view' then 'tool_use' when 'error' then 'tool_result' when 'purchase' then 'odd' else 'text' end as block_type, count(*) as n, count(body) as errors,
  sum(case k when 'purchase' then 1 else coalesce(length(said), 0) end)::bigint as text, sum(coalesce(length(body), 0))::bigint as body, count(*) filter (where k = 'view') as tools from x where k <> 'brand-new' group by 1, 2, 3"""


def facts_tokens(spark, d):
    f = facts.session_facts(_lines(spark, d))
    return f.select("session_id", "assistant_turns", "input_tokens", "output_tokens", "cache_creation", "cache_read_peak")


SQL["facts_tokens"] = f"""with {_SQL},
m as (select session_id, k, e, row_number() over (partition by session_id, case k when 'view' then e // 100 else -e - 1 end order by e) as nth from x where line_type = 'assistant'),
s as (select session_id, count(*) as turns, sum(case k when 'view' then e % 1000 else 0 end) as i, sum(case when k = 'view' then e % 7 when e % 10 <> 3 then 2 else 0 end) as o,
  sum(case k when 'view' then e % 5 else 0 end) as c, max(case k when 'view' then e % 900 else 0 end) as p from m where nth = 1 group by 1)
select a.session_id, coalesce(turns, 0)::bigint as assistant_turns, coalesce(i, 0)::bigint as input_tokens, coalesce(o, 0)::bigint as output_tokens, coalesce(c, 0)::bigint as cache_creation, coalesce(p, 0)::bigint as cache_read_peak
from (select distinct session_id from w) a left join s using (session_id)"""


def facts_friction(spark, d):
    return facts.session_facts(_lines(spark, d)).select("session_id", "user_turns", "task_notifications", "interrupts", "rejections", "tool_errors")


SQL["facts_friction"] = f"""with {_SQL}
select session_id, count(*) filter (where k = 'signup' and r in (1, 4)) as user_turns, count(*) filter (where k = 'signup' and r = 2) as task_notifications,
  count(*) filter (where k = 'signup' and r = 0 or k = 'error' and r = 3) as interrupts, count(*) filter (where k = 'signup' and r = 5 or k = 'error' and r in (1, 2)) as rejections,
  count(*) filter (where k = 'error' and r in (0, 4, 5)) as tool_errors from x group by 1"""


def facts_modes(spark, d):
    return facts.session_facts(_lines(spark, d)).select("session_id", F.explode("mechanical_friction").alias("mode", "n"), F.element_at("mechanical_exemplars", F.col("mode")).alias("exemplar"))


SQL["facts_modes"] = f"""with {_SQL}
select session_id, case r when 0 then 'edit_before_read' when 2 then 'permission' when 4 then 'other' else 'wrong_cwd' end as mode, count(*) as n,
  case r when 0 then arg_min(body, e) when 5 then arg_min(body, e) end as exemplar from x where k = 'error' and r in (0, 2, 4, 5) group by session_id, r"""


def facts_signatures(spark, d):
    return facts.session_facts(_lines(spark, d)).select("session_id", F.explode("other_error_signatures").alias("signature", "n"))


SQL["facts_signatures"] = f"with {_SQL} select session_id, 'exit status N' as signature, count(*) as n from x where k = 'error' and r = 4 group by 1"


def facts_patches(spark, d):
    return facts.session_facts(_lines(spark, d)).select("session_id", "lines_added", "lines_removed", "files_touched", F.array_join("skills", ",").alias("skills"))


SQL["facts_patches"] = f"""with {_SQL}
select session_id, count(*) filter (where k = 'purchase') as lines_added, count(*) filter (where k = 'purchase' and e % 2 = 1) as lines_removed, count(distinct case k when 'purchase' then e % 6 end) as files_touched,
  coalesce(array_to_string(list_sort(list(distinct 's' || e % 3) filter (where k = 'purchase')), ','), '') as skills from x group by 1"""


def facts_tools(spark, d):
    f = facts.session_facts(_lines(spark, d)).where("tool_counts is not null")
    return f.select("session_id", "edits", "fan_out", F.array_join("subagent_types", ",").alias("agents"), F.explode("tool_counts").alias("tool", "n"))


SQL["facts_tools"] = f"""with {_SQL},
s as (select session_id, count(*) filter (where tool = 'Edit') as edits, count(*) filter (where tool = 'Agent') as fan_out, coalesce(array_to_string(list_sort(list(distinct 'kind' || e % 3) filter (where tool = 'Agent')), ','), '') as agents from x where k = 'view' group by 1)
select session_id, edits, fan_out, agents, tool, count(*) as n from x join s using (session_id) where k = 'view' group by all"""


def facts_ends(spark, d):
    f = facts.session_facts(_lines(spark, d))
    return f.select("session_id", F.unix_micros("start").alias("started"), F.unix_micros("end").alias("ended"), "wall_clock", "cwd", "git_branch", F.array_join(F.map_keys("model_mix"), ",").alias("models"))


SQL["facts_ends"] = f"""with {_SQL},
m as (select *, row_number() over (partition by session_id, e // 100 order by e) as nth from x where k = 'view')
select x.session_id, epoch_us(arg_min(tm, e) filter (where tm is not null)) as started, epoch_us(arg_max(tm, e) filter (where tm is not null)) as ended,
  (epoch_us(arg_max(tm, e) filter (where tm is not null)) - epoch_us(arg_min(tm, e) filter (where tm is not null))) * 1000 as wall_clock,
  max(case k when 'signup' then '/w/p' || user_id % 3 end) as cwd, 'b' || arg_max(e % 4, e) filter (where k = 'click') as git_branch,
  (select array_to_string(list_sort(list(distinct 'm' || m.e % 3)), ',') from m where m.session_id = x.session_id and nth = 1) as models from x group by x.session_id"""


def facts_fingerprints(spark, d):
    f = facts.session_facts(_turns(spark, d))
    return f.select("session_id", "user_turns", "assistant_turns", F.array_join("fingerprints", ",").alias("fingerprints"))


SQL["facts_fingerprints"] = r"""
with t as (select *, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) as normal from conversations)
select conv_id::varchar as session_id, count(*) filter (where role = 'user' and normal <> '') as user_turns, count(*) filter (where role = 'assistant') as assistant_turns,
  coalesce(string_agg(substr(sha1(normal), 1, 16), ',' order by turn) filter (where role = 'user' and normal <> '' and normal not in ('yes', 'y', 'yep', 'yeah', 'ok', 'okay', 'sure', 'no', 'continue', 'go on', 'go ahead', 'please continue', 'proceed')
    and not (normal like '@%' and normal not like '% %')), '') as fingerprints from t group by 1"""


def session_corpora(spark, d):
    c = facts.corpora(_turns(spark, d))
    return c.select("session_id", F.sha2("user_text", 256).alias("user_text"), F.sha2("all_text", 256).alias("all_text"), F.length("all_text").cast("long").alias("size"))


SQL["session_corpora"] = """
with t as (select conv_id, turn, role, case role when 'user' then trim(text, ' ' || chr(10)) else text end as text from conversations where role in ('user', 'assistant') and text <> '')
select conv_id::varchar as session_id, sha256(coalesce(string_agg(text, chr(10) order by turn) filter (where role = 'user'), '')) as user_text, sha256(string_agg(text, chr(10) order by turn)) as all_text,
  length(string_agg(text, chr(10) order by turn)) as size from t group by 1"""


def reduced_lines(spark, d):
    return reduce.reduced_rows(_lines(spark, d)).groupBy("session_id", "priority").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"), F.max("text").alias("last"))


SQL["reduced_lines"] = f"""with {_SQL},
t as (select session_id, e, case k when 'view' then 4 when 'click' then 2 else 0 end as priority,
  case k when 'click' then '[Assistant]: ' || said when 'view' then '[Tool: ' || tool || ' ' || case tool when 'Agent' then 'kind' || e % 3 else '/w/f' || e % 9 end || ']'
    when 'error' then case when r in (0, 4, 5) then '[ToolError]: ' || body when r = 3 then '[Interrupt]' when r = 2 then '[Rejected]' else '[Rejected]: use ' || e end
    when 'signup' then case r when 0 then '[Interrupt]' when 2 then '[Subagent result]: ' || said when 5 then '[Rejected]: use ' || e when 3 then null else '[User]: ' || said end end as text from x)
select session_id, priority, count(*) as n, sum(length(text))::bigint as chars, max(text) as last from t where text is not null group by 1, 2"""


def session_signals(spark, d):
    """Signals of the repositories in which the sessions of events were, without directives."""
    f = facts.session_facts(_lines(spark, d))
    f = f.withColumns({"repo": F.col("cwd"), "session_type": F.when(F.col("user_turns") % 2 == 0, "single_task").otherwise("multi_task")}).where("repo is not null")
    none = spark.createDataFrame([], "repo string, session_id string, start timestamp, norm string, n bigint, first_turn bigint, exemplar string")
    return detect.signals(f, none).select("repo", "id", "kind", "magnitude", F.array_join("sessions", ",").alias("sessions"), F.size("detail").alias("details"))


SQL["session_signals"] = f"""with {_SQL},
s as (select session_id, max(case k when 'signup' then '/w/p' || user_id % 3 end) as repo, arg_min(tm, e) filter (where tm is not null) as start,
  count(*) filter (where k = 'view' and tool = 'Read') as reads, count(*) filter (where k = 'signup' and r in (1, 4)) as turns, count(*) filter (where k = 'purchase') as skilled,
  count(*) filter (where k = 'signup' and r in (0, 5) or k = 'error') as friction, count(distinct case when k = 'view' then e // 100 end) + count(*) filter (where k = 'click') as spoken,
  count(*) filter (where k = 'error' and r in (0, 2, 5)) as mechanical from x group by 1 having repo is not null),
p as (select repo, quantile_disc(reads, 0.9) as rp, quantile_disc(friction / greatest(spoken, 1), 0.9) as fp from s group by 1),
h as (select s.repo, session_id, start, unnest([case when reads >= rp and reads > 0 then 'high_read' end, case when friction / greatest(spoken, 1) >= fp and friction > 0 then 'friction_density' end,
  case when reads >= rp and reads > 0 and turns % 2 = 0 and skilled = 0 then 'unskilled_toil' end, case when mechanical > 0 then 'mechanical_friction' end]) as kind from s join p using (repo)),
g as (select repo, kind, count(*) as magnitude, string_agg(session_id, ',' order by start, session_id) as sessions from h where kind is not null group by 1, 2 having count(*) >= 3),
md as (select repo, count(distinct r) + max(case when o > 0 then 1 else 0 end) as details from (select s.repo, x.r, count(*) filter (where x.r = 4) over (partition by s.repo) as o from x join s using (session_id) where k = 'error' and x.r in (0, 2, 5, 4)) where r <> 4 group by 1)
select g.repo, 'G' || row_number() over (partition by g.repo order by list_position(['high_read', 'friction_density', 'unskilled_toil', 'mechanical_friction'], kind)) as id, kind, magnitude, sessions,
  (case kind when 'mechanical_friction' then md.details else 0 end)::int as details from g left join md using (repo)"""

QUERIES = {name: globals()[name] for name in SQL}
