"""One row of facts for each session, from its events and blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skeinlog.functions.classify import is_interrupt, is_rejection, is_trivial, mode_of, rejection_reason, result_class, text_class
from skeinlog.functions.text import error_signature, fingerprint, fingerprint_text, sanitise, trim_ws
from skeinlog.operators import directives
from skeinlog.operators.similarity import _saved
from skeinlog.sources.transcripts import blocks, events


def _last(c: str):
    """The last value in the order of the file that isn't empty."""
    return F.max_by(c, F.when(F.col(c).isNotNull() & (F.col(c) != ""), F.col("line_no"))).alias(c)


def _map(key: str, value: str):
    """A map of rows that have each key once."""
    return F.map_from_entries(F.sort_array(F.collect_list(F.struct(key, value))))


def messages(ev: DataFrame) -> DataFrame:
    """Assistant lines, one for each message id, the first; lines without an id all count."""
    a = ev.where("type = 'assistant'").withColumn("mid", F.coalesce("message_id", F.lit("")))
    first = F.row_number().over(Window.partitionBy("session_id", "mid").orderBy("line_no"))
    return a.withColumn("nth", first).where("nth = 1 or mid = ''").drop("nth", "mid")


def user_texts(ev: DataFrame, bl: DataFrame) -> DataFrame:
    """(session_id, line_no, text, class): the text blocks of a user's line, joined."""
    t = bl.where("line_type = 'user' and block_type = 'text'").groupBy("session_id", "line_no").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block_no", "text"))), lambda x: x["text"]), "\n").alias("text"))
    t = t.withColumn("text", trim_ws(F.col("text")))
    return t.where("text <> ''").withColumn("class", text_class(F.col("text")))


def session_facts(decoded: DataFrame) -> DataFrame:
    """Times are the first and last in the order of the file; tokens are of messages, cache reads are a peak; tools are of blocks.

    Events and blocks are kept as tables, since each fact reads one of them; lines are decoded once."""
    ev = _saved(events(decoded))
    bl = _saved(blocks(ev))
    base = ev.groupBy("session_id").agg(
        F.min_by("ts", F.when(F.col("ts").isNotNull(), F.col("line_no"))).alias("start"),
        F.max_by("ts", F.when(F.col("ts").isNotNull(), F.col("line_no"))).alias("end"),
        *[_last(c) for c in ("cwd", "git_branch", "ai_title", "version")],
        F.sort_array(F.collect_set(F.nullif("skill", F.lit("")))).alias("skills"),
        F.coalesce(F.sum(F.size(F.filter("patch_lines", lambda x: x.startswith("+")))), F.lit(0)).alias("lines_added"),
        F.coalesce(F.sum(F.size(F.filter("patch_lines", lambda x: x.startswith("-")))), F.lit(0)).alias("lines_removed"),
        F.size(F.collect_set(F.when(F.col("patched"), F.col("result_path")))).cast("long").alias("files_touched"),
    )
    spoken = messages(ev).groupBy("session_id").agg(
        F.count("*").alias("assistant_turns"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"),
        F.sum("cache_creation").alias("cache_creation"), F.max("cache_read").alias("cache_read_peak"),
    )
    texts = user_texts(ev, bl)
    normal = fingerprint_text(F.col("text"))
    said = texts.groupBy("session_id").agg(
        *[F.count_if(F.col("class") == k).alias(f"text_{k}") for k in ("task_notification", "interrupt", "rejection", "user_turn")],
        F.transform(F.sort_array(F.collect_list(F.when((F.col("class") == "user_turn") & ~is_trivial(normal), F.struct("line_no", fingerprint(normal).alias("fp"))))), lambda x: x["fp"]).alias("fingerprints"),
    )
    results = bl.where("line_type = 'user' and block_type = 'tool_result'").withColumn("class", result_class(F.col("body"), F.col("is_error")))
    mode = F.when(F.col("class") == "error", mode_of(F.col("body"))).when((F.col("class") == "rejection") & rejection_reason(F.col("body")).isNull(), "permission")
    results = results.withColumn("mode", mode)
    done = results.groupBy("session_id").agg(*[F.count_if(F.col("class") == k).alias(f"result_{k}") for k in ("interrupt", "rejection", "error")])
    modes = results.where("mode is not null").groupBy("session_id", "mode").agg(F.count("*").alias("n")).groupBy("session_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("mode", "n")))).alias("mechanical_friction"))
    shown = results.where("class = 'error' and mode <> 'other'").groupBy("session_id", "mode").agg(F.min_by(sanitise(F.col("body")), F.struct("line_no", "block_no")).alias("shown"))
    shown = shown.groupBy("session_id").agg(_map("mode", "shown").alias("mechanical_exemplars"))
    other = results.where("mode = 'other'").groupBy("session_id", error_signature(F.col("body")).alias("signature")).agg(F.count("*").alias("n"))
    other = other.groupBy("session_id").agg(F.sort_array(F.collect_list("signature")).alias("error_signatures"), _map("signature", "n").alias("other_error_signatures"))
    models = messages(ev).where("model <> ''").groupBy("session_id", "model").agg(F.count("*").alias("n")).groupBy("session_id").agg(_map("model", "n").alias("model_mix"))
    agent = F.try_variant_get("tool_input", "$.subagent_type", "variant")
    agent = F.when((F.col("tool_name") == "Agent") & (F.schema_of_variant(agent) == "STRING"), F.nullif(F.try_variant_get("tool_input", "$.subagent_type", "string"), F.lit("")))
    agents = bl.where("line_type = 'assistant' and block_type = 'tool_use'").groupBy("session_id").agg(F.sort_array(F.collect_set(agent)).alias("subagent_types"))
    told = directives.by_session(texts.where("class = 'user_turn'"), "session_id", "line_no")
    told = told.groupBy("session_id").agg(F.sort_array(F.collect_list(F.struct("norm", "n", "first_turn", "exemplar"))).alias("directive_clauses"))
    used = bl.where("line_type = 'assistant' and block_type = 'tool_use'").groupBy("session_id", "tool_name").agg(F.count("*").alias("n"))
    tools = used.groupBy("session_id").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("tool_name", "n")))).alias("tool_counts"),
        *[F.coalesce(F.sum(F.when(F.col("tool_name") == t, F.col("n"))), F.lit(0)).alias(k) for t, k in (("Edit", "edits"), ("Write", "writes"), ("Agent", "fan_out"))],
    )
    out = base
    for part in (spoken, said, done, modes, shown, other, tools, models, agents, told):
        out = out.join(part, "session_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return out.select(
        "session_id", "start", "end", ((F.unix_micros("end") - F.unix_micros("start")) * 1000).alias("wall_clock"), "cwd", "git_branch", "ai_title", "version", "skills",
        *[zero(c).alias(c) for c in ("assistant_turns", "input_tokens", "output_tokens", "cache_creation", "cache_read_peak", "lines_added", "lines_removed", "files_touched", "edits", "writes", "fan_out")],
        zero("text_user_turn").alias("user_turns"), zero("text_task_notification").alias("task_notifications"),
        (zero("text_interrupt") + zero("result_interrupt")).alias("interrupts"), (zero("text_rejection") + zero("result_rejection")).alias("rejections"),
        zero("result_error").alias("tool_errors"), "mechanical_friction", "mechanical_exemplars", "error_signatures", "other_error_signatures", "tool_counts", "model_mix", "subagent_types", "directive_clauses", F.coalesce("fingerprints", F.array().cast("array<string>")).alias("fingerprints"),
    )


def corpora(decoded: DataFrame) -> DataFrame:
    """(session_id, user_text, all_text): what the user said, and all that was said, in order; quotes are looked up in them."""
    ev = events(decoded)
    bl = blocks(ev)
    texts = user_texts(ev, bl)
    reason = rejection_reason(F.col("text"))
    mine = texts.select("session_id", "line_no", F.lit(0).alias("block_no"), F.when(F.col("class") == "user_turn", F.col("text")).when(F.col("class") == "rejection", reason).alias("mine"), F.when(F.col("class") == "task_notification", F.col("text")).alias("other"))
    body = bl.where("block_type = 'tool_result'").select("session_id", "line_no", "block_no", F.when(is_rejection(F.col("body")), rejection_reason(F.col("body"))).alias("mine"), F.when(~is_rejection(F.col("body")) & ~is_interrupt(F.col("body")), F.col("body")).alias("other"))
    theirs = bl.where("line_type = 'assistant' and block_type in ('text', 'thinking')").select("session_id", "line_no", "block_no", F.lit(None).cast("string").alias("mine"), F.col("text").alias("other"))
    rows = mine.unionByName(body).unionByName(theirs)
    order = F.struct("line_no", "block_no")
    put = lambda c: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(c.isNotNull() & (c != ""), F.struct(order.alias("o"), c.alias("t"))))), lambda x: x["t"]), "\n")
    return rows.groupBy("session_id").agg(put(F.col("mine")).alias("user_text"), put(F.coalesce("mine", "other")).alias("all_text"))
