"""Language identification by prediction by partial matching.

Each language has a tree of byte contexts of up to ORDER bytes, with counts of what followed, learnt once and then frozen. A byte is
coded in the longest known context; where it hasn't been seen there, an escape is coded (method C: as likely as the context has
different successors) and the next shorter context is tried, without the bytes that the longer one has ruled out; below them all are
the bytes never seen, equally likely. Code lengths are thus those of a proper code. A text's language is the one in which the text and
the language's share of the learning rows take the fewest bits.

With frozen counts a byte's code length depends on it and the ORDER bytes before it only, so each distinct (ORDER + 1)-gram of a batch
is coded once. Lengths are whole numbers of 2^-20 bits: sums don't depend on how rows are dealt.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from skeinlog.llm.common import bounded_batches, crc_mod, table, without

ORDER = 4
#: Bounds of the learning sample: different texts of each language, bytes of each language, bytes of all languages together. Texts are
#: taken whole, in the order of their hashes, until the next would pass the bound; a language has one text at least.
TEXTS, BYTES, ALL_BYTES = 2000, 1 << 20, 1 << 24
#: The hashes of at most so many sample texts are broadcast (some 40 bytes each).
HELD = 1 << 20
#: Every text is coded as if it came after this many line feeds.
START = b"\n" * ORDER
#: Code lengths are counted in 2^-20 bits.
UNIT = 1 << 20
#: Bytes that are looked at together.
PIECE = 1 << 22


def grams(data: np.ndarray) -> np.ndarray:
    """For each byte after the first ORDER: the bytes before it, the nearest as the most significant, then the byte itself."""
    n = len(data) - ORDER
    g = np.zeros(max(0, n), np.int64)
    for j in range(ORDER):
        g = g << 8 | data[ORDER - 1 - j : ORDER - 1 - j + n]
    return g << 8 | data[ORDER:]


def _find(keys: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return at, keys[at] == asked


@dataclass
class Level:
    """Contexts of one length. fresh: bits of an escape from a context; after: log2 of what is left of the next shorter context's
    counts and escapes without this context's successors; again: bits of an escape from what is left."""

    contexts: np.ndarray
    fresh: np.ndarray
    after: np.ndarray
    again: np.ndarray
    edges: np.ndarray
    bits: np.ndarray
    count: np.ndarray


class Tree:
    """The context tree of one language: levels from no context up to ORDER bytes."""

    def __init__(self, found: np.ndarray, times: np.ndarray) -> None:
        self.levels: list[Level] = []
        shorter = None
        for k in range(ORDER + 1):
            own = (found >> 8 + 8 * (ORDER - k)) << 8 | found & 255
            edges, place = np.unique(own, return_inverse=True)
            count = np.bincount(place, times)
            contexts, first, q = np.unique(edges >> 8, return_index=True, return_counts=True)
            n = np.add.reduceat(count, first)
            fresh, total = np.log2((n + q) / q), np.repeat(n + q, q)
            after = again = np.zeros(len(contexts))
            if shorter is not None:
                up, up_n, up_q = shorter
                seen = up.count[_find(up.edges, (edges >> 16) << 8 | edges & 255)[0]]
                at = _find(up.contexts, contexts >> 8)[0]
                left_n, left_q = up_n[at] - np.add.reduceat(seen, first), up_q[at] - q
                some = left_q > 0
                left = np.where(some, left_n + left_q, 1)
                after, again = np.log2(left), np.where(some, np.log2(left / np.maximum(left_q, 1)), 0)
            level = Level(contexts, fresh, after, again, edges, np.log2(total / count), count)
            self.levels.append(level)
            shorter = level, n, q
        self.rest = float(np.log2(max(1, 256 - len(self.levels[0].edges))))

    def bits(self, asked: np.ndarray) -> np.ndarray:
        """The code length of the last byte of each gram, in UNITs."""
        cost = np.zeros(len(asked))
        todo = np.arange(len(asked))  # those that are not coded yet
        left, again = np.full(len(asked), -1.0), np.zeros(len(asked))  # -1: no longer context is known
        for k in range(ORDER, -1, -1):
            level, g = self.levels[k], asked[todo]
            context = g >> 8 + 8 * (ORDER - k)
            at, known = _find(level.contexts, context)
            edge, hit = _find(level.edges, context << 8 | g & 255)
            fresh = left < 0
            cost[todo] += np.where(
                hit,
                np.where(fresh, level.bits[edge], left - np.log2(level.count[edge])),
                np.where(known, np.where(fresh, level.fresh[at], again), 0),
            )
            left, again = np.where(known, level.after[at], left)[~hit], np.where(known, level.again[at], again)[~hit]
            todo = todo[~hit]
        cost[todo] += self.rest
        return np.rint(cost * UNIT).astype(np.int64)


@dataclass
class Model:
    """Languages in the order of their names, their trees, and the bits of their shares among learning rows, in UNITs."""

    names: list[str]
    trees: list[Tree]
    shares: np.ndarray

    def lengths(self, texts: list[bytes]) -> np.ndarray:
        """(text, language): the code length of each text under each language. Texts are taken together, PIECE bytes at a time."""
        out = np.zeros((len(texts), len(self.names)), np.int64)
        data = np.frombuffer(b"".join(x for t in texts for x in (START, t)), np.uint8)
        start = np.cumsum([0] + [len(START) + len(t) for t in texts])  # where each text's START is: its grams begin there, and end
        for a in range(0, len(data) - ORDER, PIECE):  # with those that reach into the next text's START
            g = grams(data[a : a + PIECE + ORDER])
            distinct, place = np.unique(g, return_inverse=True)
            i, j = np.searchsorted(start, a, "right") - 1, np.searchsorted(start, a + len(g), "left")
            low = np.clip(start[i:j] - a, 0, len(g))
            high = np.clip(start[i + 1 : j + 1] - ORDER - a, low, len(g))
            cut = np.stack([low, high], 1).ravel()
            for n, tree in enumerate(self.trees):
                upto = np.concatenate([[0], np.cumsum(tree.bits(distinct)[place])])
                out[i:j, n] += np.diff(upto[cut])[::2]
        return out

    def best(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The language of each text, the first by name among equals, and its share of the probability of all."""
        bits = self.lengths(texts) + self.shares
        lang = bits.argmin(1)
        more = (bits - bits.min(1, keepdims=True)) / UNIT
        return lang, 1 / np.exp2(-more).sum(1)


def learn(docs: DataFrame, texts: int = TEXTS, size: int = BYTES, all_size: int = ALL_BYTES) -> Model | None:
    """A model from docs with text and lang; None if no row has both a letter and a lang.

    Shares are counted over all rows. Trees are learnt from a bounded sample: of each language at most `texts` different texts and
    `size` bytes, of all together all_size bytes and a text of each (see TEXTS). Copies count once, so a group of copies can't fill the
    sample. Grams are counted on the executors; what the driver gets is bounded by the sample's bytes.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    known = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    rows = known.select("lang", F.xxhash64(F.lit(11), "text").alias("h"), F.xxhash64(F.lit(12), "text").alias("h2"), F.octet_length("text").cast("long").alias("size"))
    shares = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not shares:
        return None
    names = sorted(shares)
    each = min(size, all_size // len(names))
    # rows are few numbers each, copies become one before a language's rows meet, and each task keeps the first `texts` of a language only
    first = Window.partitionBy("lang").orderBy("h", "h2")
    picked = rows.dropDuplicates().withColumn("r", F.row_number().over(first)).where(F.col("r") <= texts)
    picked = picked.withColumn("upto", F.sum("size").over(first.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    picked = picked.where((F.col("upto") <= each) | (F.col("r") == 1)).select("lang", "h", "h2")
    keyed = known.select("lang", "text", F.xxhash64(F.lit(11), "text").alias("h"), F.xxhash64(F.lit(12), "text").alias("h2"))
    if texts * len(names) <= HELD:  # else texts and their hashes meet in a shuffle
        picked = F.broadcast(picked)
    sample = keyed.join(picked, ["lang", "h", "h2"], "left_semi").dropDuplicates(["lang", "h", "h2"]).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                found, n = np.unique(grams(np.frombuffer(START + text.encode(), np.uint8)), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), pa.array(found), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])

    counted = sample.mapInArrow(count, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    got = counted.toArrow()
    lang = got.column("lang").combine_chunks().dictionary_encode()
    code = np.asarray(lang.indices)
    gram, n = (got.column(c).to_numpy() for c in ("gram", "n"))
    trees = {name: Tree(gram[code == i], n[code == i]) for i, name in enumerate(lang.dictionary.to_pylist())}
    total = sum(shares.values())
    return Model(names, [trees[x] for x in names], np.rint([-np.log2(shares[x] / total) * UNIT for x in names]).astype(np.int64))


def identify(docs: DataFrame, model: Model | None, name: str = "lang_pred", score: str = "score") -> DataFrame:
    """docs with the language of its whole text and that language's probability among all learnt ones.

    A text that is null, empty or has no letter is `und` with score 0, as is every text if nothing was learnt. Ties go to the first
    name. Repeated rows and null ids are rows like others; an empty table gives an empty one; columns called name or score give way.
    A text must fit in a task, its grams are looked at PIECE bytes at a time.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = without(docs, name, score)
    schema = StructType([*docs.schema.fields, StructField(name, StringType()), StructField(score, DoubleType())])
    held = spark.sparkContext.broadcast(model)  # bounded by ALL_BYTES of learning text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in batches:
            texts = batch.column("__letters").to_pylist()
            langs, scores = ["und"] * len(texts), np.zeros(len(texts))
            where = [i for i, t in enumerate(texts) if t is not None] if model else []
            if where:
                best, share = model.best([texts[i].encode() for i in where])
                scores[where] = share
                for i, b in zip(where, best, strict=True):
                    langs[i] = model.names[b]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(langs, pa.string()), pa.array(scores)], schema.names)

    return docs.withColumn("__letters", F.when(F.col("text").rlike(r"\p{L}"), F.col("text"))).mapInArrow(run, schema)


def op11_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False))
    model = learn(docs.where(~held_out))
    got = identify(docs.select("doc_id", held_out.alias("held_out"), "text"), model)
    return got.select("doc_id", "held_out", "lang_pred", "score")
