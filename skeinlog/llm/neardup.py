"""Near-duplicate classes by MinHash with sequential Bayesian verification.

Rows of equal shingle sets are one node. Nodes that agree in a band of their signature are candidates. A candidate's signatures are
compared a batch of hashes at a time, and it is dropped as soon as the posterior probability that its similarity reaches the
threshold falls under the chosen miss probability. What survives is decided on the full shingle sets.

In a bucket every node is first held against the smallest one only, its center. Links found that way join nearly all of a group of
copies; then the nodes of a center that still lie outside of its main component are held against all its nodes, in blocks that
compare signatures in the same way, verify what survives, and return no more links than join components (a spanning forest). Thus a group is not expanded into pairs, and no pair of a bucket that could still join two components is left
out.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinlog.llm.common import bounded_batches, table, written
from skeinlog.llm.components import components

ROWS, BANDS = 6, 48  # 1 - (1 - 0.75 ** 6) ** 48: fewer than 1 link of similarity 0.75 in 10,000 meets in no band
HASHES = ROWS * BANDS
BATCH = 32
WIDTH, NUM, DEN = 5, 75, 100
#: A candidate is dropped once its posterior probability of being a link is under this.
MISS = 1e-6
BLOCK = 16_384  # shingles in a block, at least
CACHE = 400_000  # words whose hash a worker keeps

_rng = np.random.default_rng(75)
_A = (_rng.integers(0, 1 << 31, HASHES, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
_B = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint32)
_M = (_rng.integers(0, 1 << 63, WIDTH, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)


class _Words(dict):
    """Hashes of words; a bounded cache."""

    def __missing__(self, w: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        self[w] = h = xxhash.xxh3_64_intdigest(w)
        return h


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the finalizer of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, words: dict) -> np.ndarray:
    """The hashes of a text's distinct shingles, sorted. A text of fewer words than a shingle has one, one without words none."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z and the six spaces only
    n = len(tokens)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(words.__getitem__, tokens), np.uint64, n)
    if n < WIDTH:
        return _mix((h * _M[:n]).sum(dtype=np.uint64, keepdims=True) + np.uint64(n))
    s = h[: n - WIDTH + 1] * _M[0]
    for j in range(1, WIDTH):
        s += h[j : n - WIDTH + 1 + j] * _M[j]
    return np.unique(_mix(s))


def _digest(data: bytes) -> tuple[int, int]:
    d = xxhash.xxh3_128_digest(data)
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def signature(s: np.ndarray) -> np.ndarray:
    """The least value of each hash over a set that isn't empty."""
    low = (s >> np.uint64(32)).astype(np.uint32)
    out = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(low), 512):  # so that all stays in the cache
        part = low[i : i + 512]
        v = _A[:, None] * part[None, :]
        v += _B[:, None]
        np.minimum(out, v.min(axis=1), out=out)
    return out


def _spread(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint32(16))) * np.uint32(0x7FEB352D)
    x = (x ^ (x >> np.uint32(15))) * np.uint32(0x846CA68B)
    return x ^ (x >> np.uint32(16))


SIGNED = "doc_id bigint, n_shingles bigint, set_hi bigint, set_lo bigint, bands array<bigint>, bytes binary"


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words = _Words()
    salt = np.arange(BANDS, dtype=np.uint64) << np.uint64(40)
    weight = (np.random.default_rng(6).integers(0, 1 << 63, ROWS, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
    for batch in batches:
        n, hi, lo, sig = [], [], [], []
        for text in batch.column("text"):
            s = shingles(text.as_py(), words)
            n.append(len(s))
            h, l = _digest(s.tobytes())
            hi.append(h)
            lo.append(l)
            sig.append(signature(s) if len(s) else np.zeros(HASHES, np.uint32))
        m = np.array(sig, np.uint32).reshape(len(n), HASHES)
        bands = _mix((m.reshape(len(n), BANDS, ROWS).astype(np.uint64) * weight).sum(axis=2, dtype=np.uint64) + salt).view(np.int64)
        packed = _spread(m).astype(np.uint8)
        offsets = pa.array(np.arange(len(n) + 1, dtype=np.int32) * BANDS)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(bands.ravel())), pa.array([r.tobytes() for r in packed], pa.binary())],
            ["doc_id", "n_shingles", "set_hi", "set_lo", "bands", "bytes"],
        )


@cache
def bars(threshold: float = NUM / DEN, miss: float = MISS) -> tuple[int, ...]:
    """For each batch, the fewest agreeing hashes so far with which a candidate stays. A worker works them out once, since blocks are many.

    With a flat prior on similarity s, and bytes of hashes that agree with probability s + (1 - s) / 256, the posterior after m of n
    agree is proportional to their binomial likelihood; it is summed over a grid of s."""
    grid = (np.arange(4000) + 0.5) / 4000
    p = grid + (1 - grid) / 256
    out = []
    for n in range(BATCH, HASHES + 1, BATCH):
        m = np.arange(n + 1)[:, None]
        logs = m * np.log(p) + (n - m) * np.log1p(-p)
        like = np.exp(logs - logs.max(axis=1, keepdims=True))
        post = like[:, grid >= threshold].sum(axis=1) / like.sum(axis=1)
        out.append(int(np.argmax(post >= miss)))
    return tuple(out)


def _likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    need = bars()
    for batch in batches:
        if not batch.num_rows:
            continue
        a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, HASHES) for c in ("x", "y"))
        alive, got = np.arange(len(a)), np.zeros(len(a), np.int64)
        for k, least in enumerate(need):
            part = slice(k * BATCH, (k + 1) * BATCH)
            got[alive] += (a[alive, part] == b[alive, part]).sum(axis=1)
            alive = alive[got[alive] >= least]
        yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(alive)) for c in ("a", "b")], ["a", "b"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words = _Words()
    for batch in batches:
        rows, held, ids, high = [], 0, [], []
        for node, text in zip(batch.column("node"), batch.column("text"), strict=True):
            rows.append(shingles(text.as_py(), words).tobytes())
            high.append(_digest(rows[-1])[0])
            ids.append(node.as_py())
            held += len(rows[-1])
            if held > 1 << 24:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(high, pa.int64()), pa.array(rows, pa.binary())], ["node", "set_hi", "set"])
                rows, held, ids, high = [], 0, [], []
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(high, pa.int64()), pa.array(rows, pa.binary())], ["node", "set_hi", "set"])


def _near(s: np.ndarray, t: np.ndarray) -> bool:
    both = np.concatenate((s, t))
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return DEN * common >= NUM * (len(s) + len(t) - common)


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for i, (x, y) in enumerate(zip(batch.column("x"), batch.column("y"), strict=True)):
            if _near(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)):
                keep.append(i)
        yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(keep, pa.int64())) for c in ("a", "b")], ["a", "b"])


def _two(pairs: DataFrame, of: DataFrame, column: str) -> DataFrame:
    """pairs (a, b) with column of each as x and y. `of` is a table with a row for each node."""
    one = of.select(F.col("node").alias("a"), F.col(column).alias("x"))
    other = of.select(F.col("node").alias("b"), F.col(column).alias("y"))
    return pairs.join(one, "a").join(other, "b").select("a", "b", "x", "y")


def _sets_of(ids: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, set) for the nodes in ids."""
    ids = written(ids.select("node").distinct().join(nodes.select("node", "doc", "set_hi"), "node"), "ids")
    texts = docs.select(F.col("doc_id").cast("bigint").alias("node"), "text").join(ids.select(F.col("doc").alias("node")).distinct(), "node", "left_semi")
    sets = texts.mapInArrow(_sets, "node bigint, set_hi bigint, set binary").withColumnRenamed("node", "doc")
    return written(sets.join(ids, ["doc", "set_hi"]).select("node", "set").dropDuplicates(["node"]), "sets")


def _verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """The links among pairs (a, b)."""
    likely = written(_two(pairs, nodes, "bytes").mapInArrow(_likely, "a bigint, b bigint"), "likely")
    sets = _sets_of(likely.select(F.explode(F.array("a", "b")).alias("node")), nodes, docs)
    return written(_two(likely, sets, "set").mapInArrow(_linked, "a bigint, b bigint").distinct(), "links")


def _block(pdf: pd.DataFrame) -> pd.DataFrame:
    """Links between a block of asking rows and a block of rows of other components, fewer than these have components.

    Each asking row's signature is compared with those of all rows that aren't yet joined with it, a batch of hashes at a time, and what
    its similarity can't be is dropped as in _likely; the others are verified on the full sets, until the asking row is joined with them."""
    ask, data = pdf[pdf["asks"]], pdf[~pdf["asks"]]
    need, out, root = bars(), [], {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    if len(data) and len(ask):
        packed = np.frombuffer(b"".join(data["bytes"]), np.uint8).reshape(-1, HASHES)
        sets, size = [np.frombuffer(x, np.uint64) for x in data["set"]], data["n"].to_numpy(np.int64)
        ids, comps = data["node"].to_numpy(np.int64), data["component"].to_numpy(np.int64)
        for node, comp, x, mine in zip(ask["node"], ask["component"], ask["set"], ask["bytes"], strict=True):
            x, mine = np.frombuffer(x, np.uint64), np.frombuffer(mine, np.uint8)
            alive = np.flatnonzero((comps != comp) & (DEN * np.minimum(size, len(x)) >= NUM * np.maximum(size, len(x))))
            got = np.zeros(len(alive), np.int64)
            for k, least in enumerate(need):
                part = slice(k * BATCH, (k + 1) * BATCH)
                got += (packed[alive, part] == mine[part]).sum(axis=1)
                alive, got = alive[got >= least], got[got >= least]
            for i in alive.tolist():
                if find(int(comps[i])) != find(int(comp)) and _near(x, sets[i]):
                    root[find(int(comps[i]))] = find(int(comp))
                    out.append((int(node), int(ids[i])))
    return pd.DataFrame(out, columns=["a", "b"]).astype("int64")


def _remaining(met: DataFrame, label: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """Links (a, b) that join components, among nodes that met one center.

    The nodes of a center that lie outside of its most frequent component ask; all its nodes answer. Both are dealt into blocks of
    about equal numbers of shingles, and each pair of blocks is one group, which returns a spanning forest of the links that it finds."""
    rows = written(met.join(label, "node", "left").withColumn("component", F.coalesce("component", "node")), "rows")
    by = rows.groupBy("center", "component").agg(F.sum("n").alias("s"))
    by = by.groupBy("center").agg(F.max(F.struct("s", "component"))["component"].alias("main"), F.sum("s").alias("all"), F.max("s").alias("most"), F.count("*").alias("parts"))
    by = by.where("parts > 1").withColumn("asked", F.col("all") - F.col("most"))
    limit = F.least(F.greatest(F.sqrt(F.col("all") * F.col("asked") / 256), F.lit(BLOCK)), F.lit(1 << 22))
    by = by.select("center", "main", F.ceil(F.col("all") / limit).alias("nd"), F.ceil(F.col("asked") / limit).alias("na"))
    rows = written(rows.join(written(by, "mixed"), "center"), "mixed-rows")
    count = lambda c: F.sequence(F.lit(0).cast("long"), F.col(c) - 1)
    mine = lambda c: F.pmod(F.xxhash64("node"), F.col(c))
    data = rows.select("center", "node", "component", F.lit(False).alias("asks"), F.explode(count("na")).alias("i"), mine("nd").alias("j"))
    ask = rows.where("component <> main").select("center", "node", "component", F.lit(True).alias("asks"), mine("na").alias("i"), F.explode(count("nd")).alias("j"))
    dealt = data.unionAll(ask).join(_sets_of(rows, nodes, docs), "node").join(nodes.select("node", "bytes", F.col("n_shingles").alias("n")), "node")
    return written(dealt.groupBy("center", "i", "j").applyInPandas(_block, "a bigint, b bigint").distinct(), "more")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs (doc_id, text).

    component_id is the smallest doc_id that can be reached over links of similarity 0.75 or more on distinct 5-word shingles; kept
    is true of the row that has it. A text without words, null or empty, has no shingle, no link, and itself as component; so has
    a null doc_id, whose component is null and which is kept. Rows that repeat a doc_id are one document, whose links are those of all
    its texts. A doc_id must be an integer, or a string of one, above -2**62. Other columns are not read. An empty table gives an
    empty result.
    """
    bounded_batches(docs.sparkSession)
    signed = written(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(_sign, SIGNED), "signed")
    whole = signed.where("n_shingles > 0 and doc_id is not null")
    groups = whole.groupBy("set_hi", "set_lo").agg(F.min("doc_id").alias("doc"))
    first = groups.groupBy("doc").agg(F.min(F.struct("set_hi", "set_lo")).alias("s")).select("doc", F.col("s.set_hi").alias("set_hi"), F.col("s.set_lo").alias("set_lo"), F.lit(True).alias("own"))
    # a set is known by its least doc_id; where that has several sets, all but one by a number below those of documents
    other = F.shiftrightunsigned(F.col("set_lo"), 2) - F.lit(1 << 62).cast("long") - F.lit(1 << 62).cast("long")
    groups = groups.join(first, ["doc", "set_hi", "set_lo"], "left").withColumn("node", F.when(F.col("own"), F.col("doc")).otherwise(other)).drop("own")
    groups = written(groups, "groups")
    nodes = whole.select("doc_id", "n_shingles", "set_hi", "set_lo", "bands", "bytes").withColumnRenamed("doc_id", "doc").join(groups, ["doc", "set_hi", "set_lo"])
    nodes = written(nodes.dropDuplicates(["node"]), "nodes")

    keys = nodes.select("node", F.col("n_shingles").alias("n"), F.explode("bands").alias("key"))
    buckets = keys.groupBy("key").agg(F.min("node").alias("center"), F.count("*").alias("size")).where("size > 1")
    buckets = written(buckets, "buckets")
    met = written(keys.join(buckets.drop("size"), "key").where("node <> center").select("center", "node", "n").distinct(), "met")
    links = _verified(met.select(F.col("center").alias("a"), F.col("node").alias("b")), nodes, docs)
    label = written(components(links), "labels")

    more = _remaining(met, label, nodes, docs)
    tied = signed.select("doc_id", "n_shingles", "set_hi", "set_lo").join(groups.drop("doc"), ["set_hi", "set_lo"], "left")
    several = groups.where("node <> doc").limit(1).count()
    if several:  # the sets of one doc_id are one document
        sets = tied.where("doc_id is not null and node is not null").select("doc_id", "node").distinct()
        more = more.unionAll(sets.join(sets.groupBy("doc_id").agg(F.min("node").alias("least")), "doc_id").where("node <> least").select("node", "least"))
    full = components(links.unionAll(more)) if more.limit(1).count() else label
    named = tied.join(written(full, "components"), "node", "left")
    if several:
        named = written(named.withColumn("component", F.coalesce("component", "node")), "named")
        named = named.join(named.groupBy("component").agg(F.min("doc_id").alias("least")), "component", "left").drop("component").withColumnRenamed("least", "component")
    own = F.when(F.col("n_shingles") > 0, F.coalesce("component", "node")).otherwise(F.col("doc_id"))
    out = named.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), own).alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").isNull() | (F.col("doc_id") == F.col("component_id")))


def representatives(docs: DataFrame) -> DataFrame:
    """The rows of docs that are kept, each once: of each class the document with the smallest doc_id, and rows without an id."""
    kept = near_duplicates(docs).where("kept").select(F.col("doc_id").alias("__id"))
    rows = docs.join(kept, docs["doc_id"].cast("bigint").eqNullSafe(kept["__id"]), "left_semi")
    return rows.dropDuplicates(["doc_id", "text"])


def op3_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
