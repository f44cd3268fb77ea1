"""Chat formatting by multi-party perspective rotation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinlog.llm.common import table, text_of

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def _safe(c: Column) -> Column:
    """Markers inside of a text are broken up, so that a text can't open or close a turn."""
    return F.replace(F.replace(c, F.lit(OPEN), F.lit("< |im_start|>")), F.lit(CLOSE), F.lit("< |im_end|>"))


def rotate(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", speaker: str = "role", context: tuple[str, ...] = ("system",), block: int = 512) -> DataFrame:
    """A row for each conversation, participant and block: that participant is the assistant, all others are named users.

    Turns are ordered by number, speaker, text. Speakers in `context` set the scene: they are rendered as the system and take no
    perspective. A block holds the turns with numbers from block * b on, fewer than `block` of them if numbers don't repeat, so
    that no conversation, however long, must fit in one row; the blocks of a conversation, joined in order, are the dialogue. Where numbers
    repeat or lack so often that a block has more than `block` turns, they are dealt by hash into parts of about that many, each in the
    order of turns. A name in which characters had to be replaced ends in a hash, so that no two speakers become one.
    Columns: conversation, perspective, block_no, part_no (0 but for such blocks), n_turns, text, mask (code point spans [start, end) of the block's text that are
    to be learnt: the assistant's words and the marker that ends them) and n_masked, their sum.
    A null or empty text is an empty turn; a null speaker is a user named `unknown`; turns without a number come first, in block
    -1; a null conversation is one conversation; repeated rows are repeated turns. A conversation of context only, and an empty
    table, give no row. Other columns are not read, so their names can't clash.
    """
    rows = turns.select(
        F.col(conversation).alias("conv"),
        F.coalesce(F.floor(F.col(turn) / block), F.lit(-1)).cast("long").alias("block_no"),
        F.struct(F.col(turn).cast("long").alias("n"), F.coalesce(F.col(speaker), F.lit("unknown")).alias("who"), _safe(text_of("text")).alias("said")).alias("t"),
    )
    parts = rows.groupBy("conv", "block_no").agg(F.ceil(F.count("*") / block).alias("parts")).where("parts > 1").withColumnsRenamed({"conv": "c", "block_no": "b"})
    few = parts.limit(10_001).count()
    parts = F.broadcast(parts) if few <= 10_000 else parts
    here = F.col("conv").eqNullSafe(F.col("c")) & (F.col("block_no") == F.col("b"))
    turns = rows.withColumn("part_no", F.lit(0).cast("long"))
    if few:
        same = rows.join(parts, here).groupBy("conv", "block_no", "parts", "t").agg(F.count("*").alias("m"))  # equal turns are counted, and dealt one by one
        each = same.withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), "m")))
        dealt = each.select("conv", "block_no", "t", F.pmod(F.xxhash64("t", "k"), F.col("parts")).cast("long").alias("part_no"))
        turns = turns.join(parts, here, "left_anti").unionByName(dealt)
    blocks = turns.groupBy("conv", "block_no", "part_no").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    heard = rows.where(~F.col("t.who").isin(*context)).groupBy("conv").agg(F.sort_array(F.collect_set("t.who")).alias("cast"))
    views = blocks.join(heard.withColumnRenamed("conv", "c"), F.col("conv").eqNullSafe(F.col("c"))).select("conv", "block_no", "part_no", "turns", F.explode("cast").alias("perspective"))

    def part(t: Column) -> Column:
        mine = t["who"] == F.col("perspective")
        bare = F.regexp_replace(t["who"], r"[^\p{L}\p{N}_.-]", "_")
        name = F.when(bare == t["who"], bare).otherwise(F.concat(bare, F.lit("_"), F.substring(F.md5(F.encode(t["who"], "UTF-8")), 1, 8)))
        head = F.when(mine, F.lit(f"{OPEN}assistant\n")).when(t["who"].isin(*context), F.lit(f"{OPEN}system\n")).otherwise(F.concat(F.lit(f"{OPEN}user name="), name, F.lit("\n")))
        return F.struct(head.alias("head"), F.concat(t["said"], F.lit(CLOSE)).alias("body"), mine.alias("mine"))

    views = views.withColumn("parts", F.transform("turns", part))
    span = "array<struct<start: int, end: int>>"

    def step(s: Column, p: Column) -> Column:
        start = s["at"] + F.char_length(p["head"])
        end = start + F.char_length(p["body"])
        grown = F.concat(s["out"], F.array(F.struct(start.alias("start"), end.alias("end"))))
        return F.struct((end + 1).alias("at"), F.when(p["mine"], grown).otherwise(s["out"]).alias("out"))

    mask = F.aggregate("parts", F.struct(F.lit(0).alias("at"), F.array().cast(span).alias("out")), step, lambda s: s["out"])
    text = F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"], F.lit("\n"))), "")
    out = views.select(F.col("conv").alias(conversation), "perspective", "block_no", "part_no", F.size("turns").cast("long").alias("n_turns"), text.alias("text"), mask.alias("mask"))
    return out.withColumn("n_masked", F.aggregate("mask", F.lit(0).cast("long"), lambda a, m: a + m["end"] - m["start"]))


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    views = rotate(table(spark, sf_dir, "conversations"))
    said = F.array_join(F.transform("mask", lambda m: F.concat_ws("-", m["start"], m["end"])), ",")
    return views.select("conv_id", "perspective", "block_no", "part_no", "n_turns", "text", said.alias("mask"), "n_masked")


ORACLE_SQL = """
with t as (
  select conv_id, turn, coalesce(floor(turn / 512), -1)::bigint as block_no, coalesce(role, 'unknown') as who,
    replace(replace(coalesce(text, ''), '<|im_start|>', '< |im_start|>'), '<|im_end|>', '< |im_end|>') || '<|im_end|>' as body
  from conversations),
p as (select distinct conv_id as c, who as perspective from t where who <> 'system'),
v as (
  select t.*, perspective, who = perspective as mine,
    case when who = perspective then '<|im_start|>assistant' when who = 'system' then '<|im_start|>system'
      else '<|im_start|>user name=' || regexp_replace(who, '[^\\p{L}\\p{N}_.-]', '_', 'g')
        || case when regexp_matches(who, '[^\\p{L}\\p{N}_.-]') then '_' || md5(who)[1:8] else '' end end || chr(10) as head
  from t join p on t.conv_id is not distinct from p.c),
o as (
  select *, coalesce(sum(length(head) + length(body) + 1) over w, 0) + length(head) as s
  from v window w as (partition by conv_id, perspective, block_no order by turn nulls first, who, body
    rows between unbounded preceding and 1 preceding))
select conv_id, perspective, block_no, 0::bigint as part_no, count(*)::bigint as n_turns,
  string_agg(head || body || chr(10), '' order by turn nulls first, who, body) as text,
  coalesce(string_agg((s::bigint)::varchar || '-' || (s::bigint + length(body))::varchar, ',' order by s) filter (where mine), '') as mask,
  coalesce(sum(length(body)) filter (where mine), 0)::bigint as n_masked
from o group by conv_id, perspective, block_no
"""
