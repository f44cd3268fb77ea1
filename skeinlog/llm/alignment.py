"""Alignment of two tokenizers' tokens.

B's tokens are a static index of byte intervals in order. Each A token bisects it for the B tokens that it overlaps; a gap between two B
tokens that no A token spans is the border of a group.

Neither tokenizer merges over a space that follows a character other than white space, so a text falls into chunks there, which are
encoded and aligned on their own, each distinct one of a batch once. Texts are encoded in one pass that keeps each document's digest and
its distinct linked pairs as a table; counts of pairs over the corpus are summed from it, and a second pass over it, without texts, adds
them up for each document. Counts of the most frequent pairs are broadcast, up to a bound; a rarer pair's count is joined.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinlog.llm.common import bounded_batches, table, written

TOKENIZERS = "/opt/tokenizers"
A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Code points of texts that are encoded together; a text isn't cut.
TOGETHER = 1 << 21
#: Chunks whose ids a task keeps; each has fewer than 64 code points.
KNOWN = 1 << 17
#: At most so many pairs, the most frequent ones, are broadcast with their counts (17 bytes each).
PAIRS = 1 << 20
#: From a space that follows another character than white space up to the next such space; a text's single last space isn't cut off, since
#: B, which adds a chunk's first space, has no ids for an empty rest.
CHUNK = re.compile(r" \s*\S*(?:[^\S ]\s*\S*)*(?: \Z)?")
NUMBERS = ("n_a", "n_b", "n_groups", "n_links")
DOC = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, a array<int>, b array<int>, times array<int>"


def byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, others from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Pair:
    """Both tokenizers, and the bytes of each of their entries."""

    def __init__(self, folder: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import sentencepiece
        from tokenizers import Tokenizer

        self.known: dict[str, tuple[list[int], list[int]]] = {}
        self.a = Tokenizer.from_file(f"{folder}/{A_FILE}")
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=f"{folder}/{B_FILE}")
        of = byte_of()
        self.a_bytes = [bytes(of[c] for c in self.a.id_to_token(i) or "" if c in of) for i in range(self.a.get_vocab_size())]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_size, self.b_size = (np.array([len(x) for x in v]) for v in (self.a_bytes, self.b_bytes))
        # a token's id with what follows it: A's within a side and at its end, then B's
        self.names = [f"{i}{end}" for v, ends in ((self.a_bytes, ",|"), (self.b_bytes, ",;")) for end in ends for i in range(len(v))]
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("a piece has a space after another character: chunks aren't encoded on their own")

    def encode(self, chunks: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """A's and B's ids of chunks, each of which begins with a space, which B adds on its own. The first KNOWN chunks of a task stay
        known to it; frequent ones come early."""
        new = [c for c in chunks if c not in self.known]
        a = [e.ids for e in self.a.encode_batch_fast(new, add_special_tokens=False)]
        got = dict(zip(new, zip(a, self.b.encode([c[1:] for c in new], num_threads=1), strict=True), strict=True))
        both = [got.get(c) or self.known[c] for c in chunks]
        for c in new[: max(0, KNOWN - len(self.known))]:
            if len(c) < 64:
                self.known[c] = got[c]
        return [x for x, _ in both], [y for _, y in both]


def overlaps(a_end: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two token sequences that cover the same bytes, by the ends of their tokens: the first B token that each A token overlaps, the one
    after the last, and whether the gap after each B token is never spanned."""
    a_start, b_start = np.concatenate([[0], a_end[:-1]]), np.concatenate([[0], b_end[:-1]])
    first = np.searchsorted(b_end, a_start, "right")
    after = np.searchsorted(b_start, a_end, "left")
    spans = np.zeros(len(b_end) + 1, np.int64)  # an A token spans the gaps after first .. after - 2
    np.add.at(spans, first, 1)
    np.add.at(spans, after - 1, -1)
    return first, after, np.cumsum(spans[:-1]) == 0


class Aligned:
    """Distinct chunks: sound (both tokenizers give the chunk's bytes), counts, groups as a string, links as (a, b)."""

    def __init__(self, pair: Pair, chunks: list[str]) -> None:
        a, b = pair.encode(chunks)
        n = len(chunks)
        self.sound = self._sound(pair, chunks, a, b)
        a, b = ([x if s else [] for x, s in zip(ids, self.sound, strict=True)] for ids in (a, b))
        self.n_a, self.n_b = (np.fromiter(map(len, ids), np.int64, n) for ids in (a, b))
        a_id, b_id = (np.fromiter(chain.from_iterable(ids), np.int64) for ids in (a, b))
        self.groups, self.n_groups, self.n_links = [""] * n, np.zeros(n, np.int64), np.zeros(n, np.int64)
        self.a, self.b = a_id[:0], b_id[:0]
        if not len(a_id):
            return
        # all chunks one after the other: no token spans a chunk's end, since both sequences end there
        first, after, border = overlaps(np.cumsum(pair.a_size[a_id]), np.cumsum(pair.b_size[b_id]))
        b_group = np.cumsum(border) - border
        a_group = b_group[first]
        many = after - first
        self.a = np.repeat(a_id, many)
        self.b = b_id[np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first, many)]
        a_chunk, b_chunk = np.repeat(np.arange(n), self.n_a), np.repeat(np.arange(n), self.n_b)
        self.n_groups = np.bincount(b_chunk[border], minlength=n)
        self.n_links = np.bincount(a_chunk, many, n).astype(np.int64)
        # a1,a2|b1;a3|b2,b3
        a_last, b_last = np.append(a_group[1:] != a_group[:-1], True), border
        named = np.concatenate([a_id + a_last * len(pair.a_size), 2 * len(pair.a_size) + b_id + b_last * len(pair.b_size)])
        order = np.argsort(np.concatenate([a_group * 2, b_group * 2 + 1]), kind="stable")
        said = list(map(pair.names.__getitem__, named[order].tolist()))
        ends = np.cumsum(self.n_a + self.n_b).tolist()
        self.groups = ["".join(said[i:j])[:-1] for i, j in zip([0, *ends], ends, strict=False)]

    @staticmethod
    def _sound(pair: Pair, chunks: list[str], a: list[list[int]], b: list[list[int]]) -> np.ndarray:
        """All chunks are looked at as one, and each on its own only if that fails."""
        said = [c.encode() for c in chunks]
        size, n = np.fromiter(map(len, said), np.int64, len(said)), len(said)
        whole = b"".join(said)
        for ids, of, sizes in ((a, pair.a_bytes, pair.a_size), (b, pair.b_bytes, pair.b_size)):
            flat = list(chain.from_iterable(ids))
            chunk = np.repeat(np.arange(n), np.fromiter(map(len, ids), np.int64, n))
            if b"".join(map(of.__getitem__, flat)) != whole or (np.bincount(chunk, sizes[flat], n) != size).any():
                both = zip(a, b, said, strict=True)
                return np.array([b"".join([pair.a_bytes[i] for i in x]) == c == b"".join([pair.b_bytes[i] for i in y]) for x, y, c in both], bool)
        return np.ones(n, bool)


def _flat(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[i], start[i] + 1, ... for each i, size[i] of them."""
    return np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(start, size)


def _lists(values: np.ndarray, size: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(values.astype(np.int32)))


def align(pair: Pair, texts: list[str | None]) -> list[pa.Array]:
    """The columns of DOC for each text."""
    chunks = [CHUNK.findall(" " + t) if t else [] for t in texts]
    size, said = np.fromiter(map(len, chunks), np.int64, len(chunks)), list(chain.from_iterable(chunks))
    index = {c: i for i, c in enumerate(dict.fromkeys(said))}
    got = Aligned(pair, list(index))
    flat, doc = np.fromiter(map(index.__getitem__, said), np.int64, len(said)), np.repeat(np.arange(len(chunks)), size)
    lost = np.bincount(doc[~got.sound[flat]], minlength=len(chunks)) > 0
    flat, doc, size = flat[~lost[doc]], doc[~lost[doc]], np.where(lost, 0, size)
    numbers = [np.bincount(doc, getattr(got, c)[flat], len(chunks)).astype(np.int64) for c in NUMBERS]
    groups, ends = list(map(got.groups.__getitem__, flat.tolist())), np.cumsum(size).tolist()
    digest = [hashlib.sha256(";".join(groups[i:j]).encode()).hexdigest() if i < j else "" for i, j in zip([0, *ends], ends, strict=False)]
    # each document's distinct pairs, and how often it has them
    both, pair_no = np.unique(got.a << 32 | got.b, return_inverse=True)
    at = _flat((np.cumsum(got.n_links) - got.n_links)[flat], got.n_links[flat])
    keys, times = np.unique(np.repeat(doc, got.n_links[flat]) * max(1, len(both)) + pair_no[at], return_counts=True)
    of, which = np.divmod(keys, max(1, len(both)))
    each, found = np.bincount(of, minlength=len(chunks)), both[which]
    return [*map(pa.array, numbers), pa.array(digest, pa.string()), _lists(found >> 32, each), _lists(found & (1 << 32) - 1, each), _lists(times, each)]


def aligned(docs: DataFrame, key: str = "doc_id", folder: str = TOKENIZERS) -> DataFrame:
    """key with the columns of DOC, for each row of docs: what is known of a document without the others."""
    bounded_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = Pair(folder)
        names = [x.split()[0] for x in DOC.split(", ")]
        for batch in batches:
            texts = batch.column(1)
            upto = np.cumsum(pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False)) // TOGETHER
            cut = [0, *(np.flatnonzero(np.diff(upto)) + 1).tolist(), batch.num_rows]
            for i, j in zip(cut, cut[1:], strict=False):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *align(pair, texts.slice(i, j - i).to_pylist())], [key, *names])

    return docs.select(key, F.col("text").alias("__text")).mapInArrow(run, f"`{key}` {kind}, {DOC}")


def counted(rows: DataFrame) -> DataFrame:
    """(a, b, n, top): how often the corpus links each pair of ids, and whether no pair of its B id is linked more often."""
    pairs = rows.select(F.inline(F.arrays_zip("a", "b", "times"))).groupBy("a", "b").agg(F.sum("times").alias("n"))
    pairs = written(pairs, "pairs")
    most = pairs.groupBy(F.col("b").alias("b_id")).agg(F.max("n").alias("most"))  # a row for each entry of B's vocabulary at most
    return pairs.join(F.broadcast(most), F.col("b") == F.col("b_id")).select("a", "b", "n", (F.col("n") == F.col("most")).alias("top"))


def frequent(pairs: DataFrame, bound: int) -> int:
    """The least count such that at most `bound` pairs have it or a higher one, found by cells of counts of which there are some
    hundreds at most."""
    cells = pairs.groupBy(F.floor(F.log2("n") * 8).alias("cell")).agg(F.count("*").alias("pairs"), F.min("n").alias("least")).orderBy(F.desc("cell")).collect()
    least, total = 1 << 62, 0
    for c in cells:
        total += c["pairs"]
        if total > bound:
            break
        least = c["least"]
    return least


def alignments(docs: DataFrame, key: str = "doc_id", folder: str = TOKENIZERS, bound: int = PAIRS) -> DataFrame:
    """key, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 for each row of docs.

    A text that is null, empty or not given back byte by byte by both tokenizers has no tokens: zeros, and '' for the hash; it links
    nothing. Repeated rows count as often as they are there; null keys are kept; ties for a B id's highest count are all best; an empty
    table gives an empty one. Other columns aren't read. A long text is encoded chunk by chunk, but it, its ids and its links must fit
    in a task. `folder` has the tokenizers' files on each executor.
    """
    spark = docs.sparkSession
    rows = written(aligned(docs, key, folder).withColumn("__row", F.monotonically_increasing_id()), "aligned")
    pairs = written(counted(rows), "counts")
    least = frequent(pairs, bound)
    most = pairs.where(F.col("n") >= least).select((F.col("a").cast("long") * (1 << 32) + F.col("b")).alias("code"), "n", "top").toArrow().sort_by("code")
    held = spark.sparkContext.broadcast([most.column(c).to_numpy() for c in ("code", "n", "top")])
    kind = docs.schema[key].dataType.simpleString()
    kept = [key, *NUMBERS, "groups_sha256", "__row"]
    schema = f"`{key}` {kind}, " + ", ".join(f"{c} bigint" for c in NUMBERS) + ", groups_sha256 string, __row bigint, n_best bigint, count_sum bigint, a array<int>, b array<int>, times array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, n, top = held.value
        for batch in batches:
            a, b, times = (batch.column(c).flatten().to_numpy() for c in ("a", "b", "times"))
            size = batch.column("a").value_lengths().fill_null(0).to_numpy()
            doc = np.repeat(np.arange(batch.num_rows), size)
            asked = a.astype(np.int64) << 32 | b
            at = np.minimum(np.searchsorted(code, asked), max(0, len(code) - 1))
            hit = code[at] == asked if len(code) else np.zeros(len(asked), bool)
            best, total = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            if hit.any():
                np.add.at(best, doc[hit], times[hit] * top[at[hit]])
                np.add.at(total, doc[hit], times[hit] * n[at[hit]])
            rest = np.bincount(doc[~hit], minlength=batch.num_rows)
            lists = [_lists(x[~hit], rest) for x in (a, b, times)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(best), pa.array(total), *lists], [*kept, "n_best", "count_sum", "a", "b", "times"])

    out = rows.select(*kept, "a", "b", "times").mapInArrow(run, schema)
    names = [key, *NUMBERS, "n_best", "count_sum", "groups_sha256"]
    if pairs.where(F.col("n") < least).isEmpty():
        return out.select(*names)
    # pairs under `least` are in fewer than `least` links each, so no key of this join is hot
    out = written(out, "partly")
    rare = out.select("__row", F.inline(F.arrays_zip("a", "b", "times"))).join(pairs.where(F.col("n") < least), ["a", "b"])
    more = rare.groupBy("__row").agg(F.sum(F.when(F.col("top"), F.col("times")).otherwise(0)).alias("best2"), F.sum(F.col("times") * F.col("n")).alias("sum2"))
    both = lambda c, d: (F.col(c) + F.coalesce(d, F.lit(0))).alias(c)
    return out.join(more, "__row", "left").select(key, *NUMBERS, both("n_best", "best2"), both("count_sum", "sum2"), "groups_sha256")


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignments(table(spark, sf_dir, "documents"))
