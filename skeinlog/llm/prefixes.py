"""A trie of conversation prefixes, merged family by family.

Conversations with one base id are a family: they open with turns of the base conversation. A conversation's rows are dealt by range,
so that one of any length is spread over tasks; a prefix is known by two 64-bit sums (XOR) of hashes of (place, turn), which pieces of a
conversation can work out apart and add up. Equal prefixes are combined inside of each family first, and only these family nodes are
shuffled to be merged. What a subtree has is summed without walking it: a node belongs to its smallest member, a conversation's own
nodes are the end of its path, so each conversation adds to each node on its path what lies below it and isn't its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skeinlog.llm.common import crc_mod, table, text_of, written

#: Ids of a family; a conversation opens with crc32(id) % HEADS turns of its base.
FAMILY, HEADS = 100, 6
#: Ids whose ends are joined into one string before they are hashed in order.
RUN = 64 * FAMILY
KEY = ("depth", "k1", "k2")


def _placed(turns: DataFrame) -> DataFrame:
    """(pid, seq, conv_id, t1, t2, len): turns in order, dealt by range, as a table. seq orders the rows of a pid."""
    rows = turns.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        "turn",
        text_of("role").alias("role"),
        text_of("text").alias("text"),
        F.monotonically_increasing_id().alias("row"),  # so that equal rows, however many, can be dealt among tasks
    )
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"), F.col("row")]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    turn = [F.xxhash64(F.lit(i), "role", "text").alias(f"t{i}") for i in (1, 2)]
    placed = dealt.select(
        F.spark_partition_id().alias("pid"), F.monotonically_increasing_id().alias("seq"), "conv_id", *turn, F.char_length("text").cast("long").alias("len")
    )
    return written(placed, "turns")


def _mixed(i: int, depth: Column, turn: Column) -> Column:
    return F.xxhash64(F.lit(i), depth.cast("long"), turn)


def rebuilt(turns: DataFrame, family: int = FAMILY, heads: int = HEADS) -> DataFrame:
    """A row for each conversation and depth from 0 on: conv_id, base, depth, the prefix's key (k1, k2), its parent's (p1, p2), the code
    points of its last turn (len) and of the turns before that one (before), and whether the conversation ends there (ends)."""
    placed = _placed(turns)
    pieces = placed.groupBy("conv_id", "pid").agg(F.count("*").alias("n"))
    before = Window.partitionBy("conv_id").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn("off", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("spans", F.count("*").over(Window.partitionBy("conv_id")))
    local = Window.partitionBy("pid", "conv_id").orderBy("seq")

    # the first turns of each base conversation, at most heads - 1 of them
    bases = pieces.where(F.col("conv_id") % family == 0).where(F.col("off") < heads - 1).select("pid", "conv_id", "off")
    first = placed.join(bases, ["pid", "conv_id"]).withColumn("i", F.row_number().over(local)).where(F.col("i") < heads)
    first = first.withColumn("i", F.col("off") + F.col("i")).where(F.col("i") < heads)
    opening = first.groupBy(F.col("conv_id").alias("base")).agg(F.sort_array(F.collect_list(F.struct("i", "t1", "t2", "len"))).alias("opening"))

    convs = pieces.groupBy("conv_id").agg(F.sum("n").alias("n_own")).withColumns({"base": F.col("conv_id") - F.col("conv_id") % family, "h": crc_mod("conv_id", heads)})
    none = F.array().cast("array<struct<i: bigint, t1: bigint, t2: bigint, len: bigint>>")
    # cogroup: each conversation meets its base's opening
    convs = convs.join(opening, "base", "left").withColumn("opening", F.slice(F.coalesce("opening", none), F.lit(1), F.col("h").cast("int")))
    zero = F.lit(0).cast("long")
    said = {
        "h1": F.aggregate("opening", zero, lambda s, x: s.bitwiseXOR(_mixed(1, x["i"], x["t1"]))),
        "h2": F.aggregate("opening", zero, lambda s, x: s.bitwiseXOR(_mixed(2, x["i"], x["t2"]))),
        "hlen": F.aggregate("opening", zero, lambda s, x: s + x["len"]),
    }
    convs = convs.withColumns(said).withColumn("m", F.size("opening").cast("long"))
    convs = convs.withColumn("total", F.col("m") + F.greatest(F.col("n_own") - F.col("h"), F.lit(0)))

    # a conversation's own turns after the first h
    opened = pieces.join(convs.select("conv_id", "base", "h", "m", "h1", "h2", "hlen", "total"), "conv_id")

    def own(opened: DataFrame) -> DataFrame:
        at = placed.join(opened, ["pid", "conv_id"]).withColumn("pos", F.col("off") + F.row_number().over(local)).where("pos > h")
        at = at.withColumn("depth", F.col("m") + F.col("pos") - F.col("h"))
        return at.withColumns({f"x{i}": _mixed(i, F.col("depth"), F.col(f"t{i}")) for i in (1, 2)})

    # only conversations that lie in several pieces need what the pieces before add up to
    sums = own(opened.where("spans > 1")).groupBy("conv_id", "pid").agg(F.bit_xor("x1").alias("o1"), F.bit_xor("x2").alias("o2"), F.sum("len").alias("olen"))
    prior = sums.withColumns({c: F.coalesce((F.sum(c) if c == "olen" else F.bit_xor(c)).over(before), F.lit(0)) for c in ("o1", "o2", "olen")})
    # a piece without turns after the first h has no row in sums, and none to add to
    opened = opened.join(prior, ["conv_id", "pid"], "left").fillna(0, ["o1", "o2", "olen"])
    run = local.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = own(opened).withColumns({
        "k1": F.bit_xor("x1").over(run).bitwiseXOR(F.col("h1")).bitwiseXOR(F.col("o1")),
        "k2": F.bit_xor("x2").over(run).bitwiseXOR(F.col("h2")).bitwiseXOR(F.col("o2")),
        "upto": F.sum("len").over(run) + F.col("hlen") + F.col("olen"),
    })
    parent = [F.col(f"k{i}").bitwiseXOR(F.col(f"x{i}")).alias(f"p{i}") for i in (1, 2)]
    tail = rows.select("conv_id", "base", "depth", "k1", "k2", *parent, "len", (F.col("upto") - F.col("len")).alias("before"), (F.col("depth") == F.col("total")).alias("ends"))

    def step(s: Column, x: Column) -> Column:
        last = s[F.size(s) - 1]
        key = [last[f"k{i}"].bitwiseXOR(_mixed(i, x["i"], x[f"t{i}"])).alias(f"k{i}") for i in (1, 2)]
        return F.concat(s, F.array(F.struct(
            x["i"].alias("depth"), *key, last["k1"].alias("p1"), last["k2"].alias("p2"), x["len"].alias("len"), (last["before"] + last["len"]).alias("before")
        )))

    root = F.array(F.struct(*[zero.alias(c) for c in ("depth", "k1", "k2", "p1", "p2", "len", "before")]))
    head = convs.select("conv_id", "base", "total", F.inline(F.aggregate("opening", root, step)))
    return tail.unionByName(head.withColumn("ends", F.col("depth") == F.col("total")).drop("total"))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each key's strings, which come in order: a batch is held, and one hash."""
    key, state, out = None, None, []
    for batch in batches:
        for *at, said in zip(*(batch.column(c).to_pylist() for c in (*KEY, "said")), strict=True):
            if at != key:
                if state is not None:
                    out.append((*key, state.hexdigest()))
                key, state = at, hashlib.sha256(said.encode())
            else:
                state.update(b"," + said.encode())
        if len(out) > 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], [*KEY, "ends_sha256"])
            out = []
    if state is not None:
        out.append((*key, state.hexdigest()))
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], [*KEY, "ends_sha256"])


def _ends(nodes: DataFrame) -> DataFrame:
    """(KEY, ends_sha256) of nodes in which a conversation ends. Runs of families are joined first; a node with one run is hashed by
    SQL, others are read in order, a run at a time, so that no node's list must fit in memory."""
    mine = nodes.where(F.size("ends") > 0).select(*KEY, "base", F.array_join("ends", ",").alias("said"))
    runs = mine.groupBy(*KEY, F.floor(F.col("base") / RUN).alias("run")).agg(F.sort_array(F.collect_list(F.struct("base", "said"))).alias("l"))
    runs = runs.select(*KEY, "run", F.array_join(F.transform("l", lambda x: x["said"]), ",").alias("said"))
    single = runs.groupBy(*KEY).agg(F.count("*").alias("runs"), F.min("said").alias("said"))
    many = runs.join(single.where("runs > 1").select(*KEY), list(KEY)).repartition(*KEY).sortWithinPartitions(*KEY, "run")
    hashed = many.select(*KEY, "said").mapInArrow(_digests, "depth bigint, k1 bigint, k2 bigint, ends_sha256 string")
    return single.where("runs = 1").select(*KEY, F.sha2("said", 256).alias("ends_sha256")).unionByName(hashed)


def prefix_trie(turns: DataFrame, family: int = FAMILY, heads: int = HEADS) -> DataFrame:
    """The nodes of the trie of all rebuilt conversations: conv_id (the smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens and ends_sha256, all but the last long.

    turns: conv_id, turn, role, text; other columns aren't read, so their names can't clash. A null role or text is an empty one. Turns
    without a number come first; equal numbers are ordered by role and text; repeated rows are repeated turns. Rows without conv_id
    belong to no conversation and make no node. An empty text is a turn like any other, a long one counts whole. An empty table has no
    nodes, not even a root. Prefixes are told apart by 128 bits of hash and their depth.
    """
    rows = written(rebuilt(turns, family, heads), "paths")
    same = {c: F.min(c).alias(c) for c in ("p1", "p2", "len", "before")}
    families = rows.groupBy("base", *KEY).agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n"), *same.values(), F.sort_array(F.collect_list(F.when(F.col("ends"), F.col("conv_id")))).alias("ends")
    )
    families = written(families, "families")
    nodes = written(families.groupBy(*KEY).agg(F.min("conv_id").alias("conv_id"), F.sum("n").alias("n_convs"), *same.values()), "nodes")

    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, list(KEY), "left").fillna(0, ["n_children"])
    # what each conversation owns: nodes of which it is the smallest member, from one depth on
    owned = nodes.groupBy("conv_id").agg(F.min("before").alias("from"), F.max((F.col("n_children") == 0).cast("long")).alias("leaf"))
    whole = rows.groupBy("conv_id").agg(F.max(F.col("before") + F.col("len")).alias("whole"))
    shares = whole.join(owned, "conv_id", "left").select("conv_id", F.coalesce("from", "whole").alias("from"), F.coalesce("leaf", F.lit(0)).alias("leaf"))
    added = rows.select("conv_id", "base", *KEY, "before").join(shares, "conv_id")
    added = added.select("base", *KEY, "leaf", F.greatest(F.col("from") - F.col("before"), F.lit(0)).alias("saved")).where("leaf + saved > 0")
    added = added.groupBy("base", *KEY).agg(F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved"))  # in the family first
    added = added.groupBy(*KEY).agg(F.sum("leaf").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))

    out = nodes.join(added, list(KEY), "left").join(_ends(families), list(KEY), "left")
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    out = out.join(parents, ["depth", "p1", "p2"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", zero("n_children"), zero("n_leaves"), zero("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


def op13_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


#: Prefixes as strings, subtrees by walking each node's smallest member up. DuckDB has no crc32: it is a fold over the digits' bits.
ORACLE_SQL = """
with recursive ids as (select distinct conv_id from conversations where conv_id is not null),
bits as (
  select conv_id, flatten([[(ascii(substr(conv_id::varchar, i::int, 1)) >> j) & 1 for j in range(8)] for i in range(1, length(conv_id::varchar) + 1)]) as b
  from ids),
h as (
  select conv_id, conv_id - conv_id % 100 as base,
    xor(list_reduce(list_prepend(4294967295::bigint, b::bigint[]),
      lambda c, x: xor(c >> 1, case when (c & 1) <> x then 3988292384::bigint else 0::bigint end)), 4294967295::bigint) % 6 as h
  from bits),
t as (
  select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
    row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as pos
  from conversations where conv_id is not null),
r as (
  select h.conv_id, t.pos, 0 as own, t.role, t.text from h join t on t.conv_id = h.base and t.pos <= h.h
  union all
  select h.conv_id, t.pos, 1, t.role, t.text from h join t on t.conv_id = h.conv_id and t.pos > h.h),
o as (
  select conv_id, row_number() over (partition by conv_id order by own, pos) as depth, length(text) as len,
    md5(length(role) || ':' || role || length(text) || ':' || text) as one
  from r),
p as (
  select conv_id, depth, len, md5(string_agg(one, '') over (partition by conv_id order by depth)) as k from o
  union all select conv_id, 0, 0, '' from h),
e as (select conv_id, max(depth) as last from p group by 1),
n as (
  select k, p.depth, min(p.conv_id) as conv_id, count(*) as n_convs, min(len) as len,
    sha256(coalesce(string_agg(p.conv_id::varchar, ',' order by p.conv_id) filter (where p.depth = e.last), '')) as ends_sha256
  from p join e on p.conv_id = e.conv_id group by k, p.depth),
up as (select n.k, n.depth, q.k as parent from n join p q on q.conv_id = n.conv_id and q.depth = n.depth - 1),
kids as (select parent as k, depth - 1 as depth, count(*) as n_children from up group by 1, 2),
w as (select n.*, coalesce(n_children, 0) as n_children from n left join kids on kids.k = n.k and kids.depth = n.depth),
sub as (
  select a.k, a.depth, sum(case when w.n_children = 0 then 1 else 0 end) as n_leaves, sum((w.n_convs - 1) * w.len) as saved_tokens
  from w join p a on a.conv_id = w.conv_id and a.depth <= w.depth group by 1, 2)
select w.conv_id, w.depth::bigint as depth, parent.conv_id as parent_conv_id, w.n_convs::bigint as n_convs, w.n_children::bigint as n_children,
  sub.n_leaves::bigint as n_leaves, sub.saved_tokens::bigint as saved_tokens, w.ends_sha256
from w join sub on sub.k = w.k and sub.depth = w.depth left join up on up.k = w.k and up.depth = w.depth
  left join w parent on parent.k = up.parent and parent.depth = w.depth - 1
"""
