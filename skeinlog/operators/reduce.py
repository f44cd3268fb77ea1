"""A transcript as the text that a judge reads: a header, everything the user did, and as much of the rest as a budget allows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinlog.functions.classify import is_interrupt, is_rejection, rejection_reason
from skeinlog.functions.text import elide, trim_ws
from skeinlog.operators.facts import user_texts
from skeinlog.operators.select import budgeted
from skeinlog.operators.similarity import _saved
from skeinlog.sources.transcripts import blocks, events

# The budget in bytes, the most characters of each kind of row, and the inputs that tell what a tool was used on.
BUDGET = 160_000
MOST_TEXT, MOST_REASON, MOST_ERROR, MOST_KEY, MOST_TOOLS = 4000, 1000, 400, 120, 8
KEYS = ("file_path", "path", "command", "pattern", "description")
SPINE, PROSE, THOUGHT, TOOL = 0, 2, 3, 4


def rejected(body: Column) -> Column:
    reason = rejection_reason(body)
    return F.when(F.coalesce(reason, F.lit("")) != "", F.concat(F.lit("[Rejected]: "), elide(reason, MOST_REASON))).otherwise("[Rejected]")


def tool_key(name: Column, given: Column) -> Column:
    """What a tool was used on: an agent's kind, else the first input that isn't an empty string; null without one."""

    def of(k: str) -> Column:
        v = F.try_variant_get(given, f"$.{k}", "variant")
        return F.when(F.schema_of_variant(v) == "STRING", F.nullif(F.try_variant_get(given, f"$.{k}", "string"), F.lit("")))

    return F.coalesce(F.when(name == "Agent", of("subagent_type")), *[of(k) for k in KEYS])


def reduced_rows(decoded: DataFrame) -> DataFrame:
    """(session_id, line_no, block_no, priority, text): a row for each thing that was done or said. Priority 0 always stays; 2 is what the
    assistant said, 3 what it thought, 4 which tools it used. A line's own text comes after its results of tools. Blocks are kept as a
    table, so that lines are decoded once."""
    ev = events(decoded)
    bl = _saved(blocks(ev))
    body = F.col("body")
    error = F.when(is_interrupt(body), "[Interrupt]").when(is_rejection(body), rejected(body)).otherwise(F.concat(F.lit("[ToolError]: "), elide(body, MOST_ERROR)))
    results = bl.where("line_type = 'user' and block_type = 'tool_result'").select("session_id", "line_no", "block_no", F.lit(SPINE).alias("priority"), F.when(F.col("is_error"), error).when(is_interrupt(body), "[Interrupt]").alias("text"))
    kind, t = F.col("class"), F.col("text")
    mine = F.when(kind == "task_notification", F.concat(F.lit("[Subagent result]: "), elide(t, MOST_TEXT))).when(kind == "interrupt", "[Interrupt]").when(kind == "rejection", rejected(t)).when(kind == "user_turn", F.concat(F.lit("[User]: "), elide(t, MOST_TEXT)))
    said = user_texts(ev, bl).select("session_id", "line_no", F.lit(2**31 - 1).alias("block_no"), F.lit(SPINE).alias("priority"), mine.alias("text"))
    kind, t = F.col("block_type"), trim_ws(F.col("text"))
    name, key = F.coalesce("tool_name", F.lit("")), tool_key(F.col("tool_name"), F.col("tool_input"))
    tool = F.concat(F.lit("[Tool: "), name, F.when(key.isNotNull(), F.concat(F.lit(" "), elide(key, MOST_KEY))).otherwise(""), F.lit("]"))
    spoken = F.when((kind == "text") & (t != ""), F.concat(F.lit("[Assistant]: "), t)).when((kind == "thinking") & (t != ""), F.concat(F.lit("[Thinking]: "), t)).when(kind == "tool_use", tool)
    level = F.when(kind == "text", PROSE).when(kind == "thinking", THOUGHT).otherwise(TOOL)
    theirs = bl.where("line_type = 'assistant'").select("session_id", "line_no", "block_no", level.alias("priority"), spoken.alias("text"))
    return results.unionByName(said).unionByName(theirs).where("text is not null")


def header(f: DataFrame) -> DataFrame:
    """(session_id, header) of rows of session_facts."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    n = lambda c: F.col(c).cast("string")
    ranked = F.slice(F.sort_array(F.transform(F.map_entries("tool_counts"), lambda e: F.struct((-e["value"]).alias("m"), e["key"].alias("k")))), 1, MOST_TOOLS)
    tools = F.coalesce(F.array_join(F.transform(ranked, lambda e: F.concat(e["k"], F.lit("="), (-e["m"]).cast("string"))), ", "), F.lit(""))
    models = F.coalesce(F.array_join(F.sort_array(F.map_keys("model_mix")), ","), F.lit(""))
    minutes = F.coalesce(F.round(F.col("wall_clock") / 60_000_000_000).cast("bigint"), F.lit(0)).cast("string")
    lines = (
        F.concat(F.lit("Session: "), F.substring("session_id", 1, 8)), F.concat(F.lit("Title: "), F.coalesce(F.nullif(text("ai_title"), F.lit("")), F.lit("(none)"))),
        F.concat(F.lit("Project: "), text("cwd"), F.lit("   Branch: "), text("git_branch")), F.concat(F.lit("Duration: "), minutes, F.lit(" min   Models: "), models),
        F.concat(F.lit("User turns: "), n("user_turns"), F.lit("   Assistant turns: "), n("assistant_turns"), F.lit("   Tool errors: "), n("tool_errors"), F.lit("   Interrupts: "), n("interrupts"), F.lit("   Rejections: "), n("rejections")),
        F.concat(F.lit("Top tools: "), tools), F.lit("---"),
    )
    return f.select("session_id", F.concat_ws("\n", *lines).alias("header"))


def reduced(decoded: DataFrame, facts: DataFrame, budget: int = BUDGET) -> DataFrame:
    """(session_id, text, chars, kept, dropped): chars are bytes. The rows that stay are chosen by windows; their texts meet in one row
    only once they fit the budget, but what the user did always stays."""
    heads = header(facts)
    rows = reduced_rows(decoded).join(heads.select("session_id", F.octet_length("header").alias("__head")), "session_id")
    rows = rows.withColumns({"__size": F.octet_length("text").cast("long") + 1, "__at": F.struct("line_no", "block_no")})
    all_ = rows.groupBy("session_id").agg(F.count("*").alias("total"))
    kept = budgeted(rows, "session_id", "priority", "__at", "__size", F.lit(budget) - F.col("__head"))
    body = kept.groupBy("session_id").agg(F.count("*").alias("kept"), F.transform(F.sort_array(F.collect_list(F.struct("__at", "text"))), lambda x: x["text"]).alias("body"))
    out = heads.join(all_, "session_id", "left").join(body, "session_id", "left")
    kept, dropped = F.coalesce("kept", F.lit(0)), F.coalesce(F.col("total") - F.coalesce("kept", F.lit(0)), F.lit(0))
    note = F.when(dropped > 0, F.concat(F.lit("---\n[reduction: kept "), kept.cast("string"), F.lit("/"), F.col("total").cast("string"), F.lit(" events; "), dropped.cast("string"), F.lit(" lower-priority assistant events dropped to fit budget]")))
    text = F.concat_ws("\n", "header", "body", note)
    return out.select("session_id", text.alias("text"), F.octet_length(text).alias("chars"), kept.alias("kept"), dropped.alias("dropped"))
