"""Sharding by histogram sort.

Every row has a key: the hash of its text, the hash of its doc_id, and a number of its own, by which rows that are equal in both can
be told apart. Cutting the key order into pieces of equal
bytes needs splitters; they are found by counting. Each round counts, over all partitions, the exact bytes below a grid of
candidate boundaries inside the key ranges that still hold a splitter, and moves every splitter into one cell of that grid.
Rounds end once every open cell holds no more than the tolerance or a single row, or both hashes have no bits left. The rows are written
with their piece, cross the network once, straight into it, and are numbered there; a piece's first slot is the count of rows in the
pieces before it.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skeinlog.llm.common import table, text_of, without, written

BITS = 12  # of the key, resolved by one round
KEY_BITS = 64


def _prefix(level: int) -> tuple[Column, int]:
    """The key's leading bits after `level` rounds, as (part hash, bits of it)."""
    per = math.ceil(KEY_BITS / BITS)
    return (F.col("__k1"), (level + 1) * BITS) if level < per else (F.col("__k2"), (level + 1 - per) * BITS)


def keyed(docs: DataFrame) -> DataFrame:
    t = text_of("text")
    return without(docs, "__k1", "__k2", "__k3", "__size").withColumns(
        {"__k1": F.xxhash64(t), "__k2": F.xxhash64(F.lit(7), F.col("doc_id")), "__k3": F.xxhash64(F.lit(11), F.monotonically_increasing_id()), "__size": F.octet_length(t).cast("long") + 8}
    )


def _floor(c: Column, bits: int) -> Column:
    """c with all but its leading bits cleared: the lower bound of its cell, in signed order."""
    return c if bits >= KEY_BITS else F.shiftleft(F.shiftright(c, KEY_BITS - bits), KEY_BITS - bits)


def splitters(keys: DataFrame, parts: int, tolerance: float) -> tuple[list[tuple[int, int, int]], int]:
    """parts-1 keys (k1, k2, k3), not descending, that cut `keys` into parts of near equal bytes; the number of rounds.

    The cells of a round are summed up on the executors, which return the cell of each open splitter only; so the driver sees fewer
    rows than parts, whatever the rows. Where a cell of rows equal in k1 and k2 is still too large once no bits are left, it is cut
    through k3, which is spread evenly over its rows, at the share that is due."""
    spark = keys.sparkSession
    per, low = math.ceil(KEY_BITS / BITS), -(2**63)
    total = keys.agg(F.sum("__size")).first()[0]
    if not total:
        return [(low, low, low)] * (parts - 1), 0
    cells = {(low, low): [(p, total * p / parts, 0) for p in range(1, parts)]}
    done, level, limit = {}, 0, tolerance * total / parts
    while cells and level < 2 * per:
        part, bits = _prefix(level)
        outer = F.lit(0) if level == 0 else F.col("__cell")
        rows, shown = keys, sorted(cells)
        if level:  # only rows of cells that hold an open splitter are counted again
            width = min(KEY_BITS, level * BITS) if level <= per else KEY_BITS
            on = [_floor(F.col("__k1"), width) == F.col("__a")]
            if level > per:
                on.append(_floor(F.col("__k2"), (level - per) * BITS) == F.col("__b"))
            small = F.broadcast(_rows(spark, [(i, a, b) for i, (a, b) in enumerate(shown)], "__cell int, __a bigint, __b bigint"))  # fewer rows than parts
            rows = keys.join(small, on[0] if len(on) == 1 else on[0] & on[1])
        got = rows.groupBy(outer.alias("cell"), _floor(part, min(bits, KEY_BITS)).alias("at")).agg(F.sum("__size").alias("bytes"), F.count("*").alias("n"))
        got = got.withColumn("upto", F.sum("bytes").over(Window.partitionBy("cell").orderBy("at")))
        goals = _rows(spark, [(i, p, goal - below) for i, cell in enumerate(shown) for p, goal, below in cells[cell]], "__of int, __p int, __goal double")
        held = got.join(F.broadcast(goals), F.col("cell") == F.col("__of")).where((F.col("upto") >= F.col("__goal")) & (F.col("upto") - F.col("bytes") < F.col("__goal")))
        new: dict[tuple[int, int], list] = {}
        goal_of = {p: (goal, below) for cell in cells.values() for p, goal, below in cell}
        for r in held.select("cell", "__p", "at", "bytes", "n", "upto").collect():  # a row for each open splitter
            (goal, below), p = goal_of[r["__p"]], r["__p"]
            below += r.upto - r.bytes
            edge = (r["at"], low) if level < per else (shown[r.cell][0], r["at"])
            if level == 2 * per - 1 and r.n > 1 and r.bytes > limit:
                done[p] = (*edge, low + int((goal - below) / r.bytes * 2**64))
            elif r.bytes <= limit or r.n == 1 or level == 2 * per - 1:
                # the nearer side of the cell; its upper side is the next cell's lower one
                done[p] = (*(_above(edge, level, per, min(bits, KEY_BITS)) if below + r.bytes - goal < goal - below else edge), low)
            else:
                new.setdefault(edge, []).append((p, goal, below))
        cells = new
        level += 1
    out, last = [], 2**63 - 1
    for p in range(1, parts):
        mark = done[p] if done[p][0] <= last else (last, last, last)
        mark = (*mark[:2], min(mark[2], last))
        out.append(max(mark, out[-1]) if out else mark)
    return out, level


def _above(edge: tuple[int, int], level: int, per: int, bits: int) -> tuple[int, int]:
    """The lower side of the next cell."""
    (a, b), low = edge, -(2**63)
    if level < per:
        return a + (1 << (KEY_BITS - bits)), low
    b += 1 << (KEY_BITS - bits)
    return (a + 1, low) if b >= 2**63 else (a, b)


def _listed(values: list[int], kind: str) -> Column:
    """A constant array; one literal, which the optimizer folds, instead of an expression for each value."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def _rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table from values that the driver holds."""
    names = [x.split()[0] for x in schema.split(", __")]
    names = [n if n.startswith("__") else f"__{n}" for n in names]
    text = json.dumps([dict(zip(names, [[{"a": a, "b": b, "c": c} for a, b, c in x] if isinstance(x, list) else x for x in r], strict=True)) for r in rows])
    kind = "array<struct<" + ", __".join(x.replace(" ", ": ", 1) for x in schema.split(", __")) + ">>"
    return spark.range(1).select(F.inline(F.from_json(F.lit(text), kind)))


def _piece(marks: list[tuple[int, int, int]], spark: SparkSession, rows: DataFrame) -> DataFrame:
    """Adds __piece: the number of splitters that are not above the row's key. A cell of the first grid that holds splitters is
    looked up in a table of at most one row for each of them; in all others the number follows from the cell."""
    cell = lambda k: (k >> (KEY_BITS - BITS)) + (1 << (BITS - 1))
    base, inner, j = [], {}, 0
    for c in range(1 << BITS):
        base.append(j)
        while j < len(marks) and cell(marks[j][0]) == c:
            inner.setdefault(c, []).append(marks[j])
            j += 1
    here = (F.shiftright(F.col("__k1"), KEY_BITS - BITS) + (1 << (BITS - 1))).cast("int")
    rows = rows.withColumn("__cell", here)
    start = F.element_at(_listed(base, "int"), F.col("__cell") + 1)
    if not inner:
        return rows.withColumn("__piece", start).drop("__cell")
    found = _rows(spark, [(c, v) for c, v in inner.items()], "__cell int, __marks array<struct<a: bigint, b: bigint, c: bigint>>")
    more = F.size(F.filter("__marks", lambda m: m <= F.struct(F.col("__k1").alias("a"), F.col("__k2").alias("b"), F.col("__k3").alias("c"))))
    return rows.join(F.broadcast(found), "__cell", "left").withColumn("__piece", start + F.when(F.col("__marks").isNotNull(), more).otherwise(0)).drop("__cell", "__marks")


def histogram_sort(docs: DataFrame, shards: int = 24, tolerance: float = 0.002, pieces: int | None = None) -> DataFrame:
    """docs with size, text_crc32, law ('bytes'), shard, slot and grown_shard (null under this law).

    Shards get near equal bytes; equal texts lie side by side, so they share a shard unless a border falls among them. A border
    falls within `tolerance` of a piece, and a shard is `pieces` of them. Rows that are equal in text and doc_id
    are neighbours too, and a border may fall among them. A null text has size 8 and the checksum of no bytes, 0, and goes with the empty texts; a null
    doc_id is a key like any other. Columns of docs with the names of new ones give way. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    if pieces is None:
        pieces = max(32, math.ceil(4 * int(spark.conf.get("spark.sql.shuffle.partitions")) / shards))
    parts = shards * pieces
    full = keyed(without(docs, "size", "text_crc32", "law", "shard", "slot", "grown_shard"))
    keys = written(full.select("__k1", "__k2", "__size"), "keys")
    marks, _ = splitters(keys, parts, tolerance * pieces)
    rows = written(_piece(marks, spark, full.withColumn("text_crc32", F.crc32(F.encode(text_of("text"), "UTF-8")))), "pieces")  # as dealt, for good
    counts = dict(rows.groupBy("__piece").count().collect())  # at most `parts` rows
    first, seen = [], 0
    for p in range(parts):
        seen = 0 if p % pieces == 0 else seen
        first.append(seen)
        seen += counts.get(p, 0)
    order = Window.partitionBy("__piece").orderBy("__k1", "__k2", "doc_id", "__k3")
    return rows.withColumns(
        {
            "size": F.col("__size"),
            "law": F.lit("bytes"),
            "shard": F.floor(F.col("__piece") / pieces).cast("int"),
            "slot": F.row_number().over(order) - 1 + F.element_at(_listed(first, "bigint"), F.col("__piece") + 1),
            "grown_shard": F.lit(None).cast("int"),
        }
    ).drop("__k1", "__k2", "__k3", "__size", "__piece")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram_sort(table(spark, sf_dir, "documents")).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
