"""The trie of conversation prefixes against a plain trie, with pieces of conversations over many tasks; and against its SQL."""

import hashlib
import random
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from skeinlog.llm import prefixes

COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def plain(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for *_, r, t in sorted(v)] for c, v in own.items()}
    members, ends, kids = {}, {}, {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        path = own.get(base, [])[:h] + own[c][h:]
        for d in range(len(path) + 1):
            members.setdefault(tuple(path[:d]), []).append(c)
            if d:
                kids.setdefault(tuple(path[: d - 1]), set()).add(tuple(path[:d]))
        ends.setdefault(tuple(path), []).append(c)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        below = kids.get(p, ())
        leaves[p] = sum(leaves[k] for k in below) if below else 1
        saved[p] = sum(saved[k] for k in below) + (len(members[p]) - 1) * (len(p[-1][1]) if p else 0)
    said = lambda p: hashlib.sha256(",".join(map(str, sorted(ends.get(p, ())))).encode()).hexdigest()
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids.get(p, ())), leaves[p], saved[p], said(p)) for p, m in members.items())


def many(seed):
    """Families that share openings, one very long conversation, equal numbers and repeated rows."""
    rnd = random.Random(seed)
    rows = [(200, i, "user", "x" * (i % 5)) for i in range(700)]
    rows += [(c, i, "user", "x" * (i % 5)) for c in (201, 7, 13_000) for i in range(rnd.randint(300, 700))]
    for c in [0, 100, *rnd.sample(range(30_000), 60), -3, -150, -100]:
        rows += [(c, rnd.choice([None, 0, 1, 2, 3]), rnd.choice(["user", "assistant", None]), rnd.choice(["", "a", "bé", None])) for _ in range(rnd.randint(1, 6))]
    return rows + rows[-9:]


KIND = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("seed", [1, 2])
def test_plain(spark, monkeypatch, seed):
    rows = many(seed)
    monkeypatch.setattr(prefixes, "RUN", 300)  # ends of several runs are hashed in order
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        docs = spark.createDataFrame(rows, KIND).withColumns({"depth": F.lit(5), "k1": F.lit("x"), "pid": F.lit(0)})
        got = prefixes.prefix_trie(docs)
        assert tuple(got.columns) == COLUMNS
        assert prefixes._placed(docs).where("conv_id = 200").select("pid").distinct().count() > 1
        assert sorted(map(tuple, got.collect()), key=str) == sorted(plain(rows), key=str)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_edges(spark):
    got = lambda rows: sorted(map(tuple, prefixes.prefix_trie(spark.createDataFrame(rows, KIND)).collect()), key=str)
    assert got([]) == got([(None, 1, "user", "x")]) == []
    short = [(3, None, None, None), (99_999, 1, "u", "t")]  # bases that are absent leave them without their first turns
    assert got(short) == sorted(plain(short), key=str)
    long = [(0, 0, "u", "y" * 300_000), (1, 0, "u", "y" * 300_000)]
    assert got(long) == sorted(plain(long), key=str)


def test_sql(spark, small):
    db = duckdb.connect()
    db.execute(f"create view conversations as select * from '{small}/conversations.parquet'")
    want = db.sql(f"select {', '.join(COLUMNS)} from ({prefixes.ORACLE_SQL})").fetchall()
    assert sorted(map(tuple, prefixes.op13_prefixes(spark, small).collect()), key=str) == sorted(want, key=str)
