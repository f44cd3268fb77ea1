"""Language-model scoring by online logistic context mixing.

A text is a sequence of binary decisions, and its score is the sum of their logarithms.

- Its symbols are spelt by a Huffman code: a frequent word, the class of another known word (a hash of its last two bytes), or a new
  word. Before each bit several predictors, each a table of counts addressed by its context and by the place in the code, give the
  logarithm of the odds. Contexts are addressed by a hash (of the two symbols before; of one to four bytes of a new word), or plainly
  where they are few (none, the symbol before, two of frequent words and suffix classes). A gate, chosen by the depth in the code and by
  how sure two predictors are, selects the weights that add them up. Weights and an offset move along each text, from its first tokens on.
- Inside of a class, a word has its exact share of the class's count. A new word is spelt in bytes, by predictors of its own.
- Before each word, a decision says whether it comes from what has followed the word before it, with its exact share there.
- Before each segment, a decision says whether the whole segment repeats one that has followed the same four words. Segments begin
  where a hash of the four words before is divisible by SPAN, so that copies are cut alike.

The exact counts, of words, of pairs of words, of contexts and of segments, grow with the learning texts; only the symbols' and the
bytes' tables have a fixed size. A learning text is scored by the counts of all others, and every text by its own words so far
besides: a count is the total, less the text's own, plus what came before in the text. The tables of fixed size don't leave a text's
own counts out.

Texts are made into numbers once, in blocks, each with its own list of words. Shards by hash add up the counts of all blocks and send
each block its totals back, so no task holds the counts of the corpus. The weights learn online: a task goes once over its learning
texts, whole, by a step of Newton's method for every few thousand tokens; the tasks' weights are then averaged by their curvatures.
Blocks are cut from partitions as they are read, so a table read in other partitions gives somewhat other weights, and so other scores.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from itertools import groupby, pairwise, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from skeinlog.llm.common import bounded_batches, crc_mod, drop, stored, table, text_of, written

TOP = 511  # words with a symbol of their own, at most
CLASSES = 255  # of the other words
FEW = 32  # words that stand for the language or the manner of a text
PAIRS = 2048  # rows of the table whose context is a hash of two symbols
ORDERS = (1, 2, 3, 4)  # of the bytes' contexts
BYTE_BITS = (18, 18, 20, 20)  # of the addresses of the bytes' tables
END_OF_WORD = 256
BLOCK = 1 << 19  # tokens of a block, about
SHARDS = 1 << 14  # at most
SEGMENT = 1 << 14  # cells that are sent as one row
SPAN = 8  # tokens of a segment, about
SLACK = 14  # bits of a key beyond those that number the tokens: 1 in 2 ** SLACK unseen contexts is taken for a seen one
CHUNK, STEP = 1500, 1 << 13  # tokens whose decisions are worked out at once, and those of a step of learning
PRIOR, RATE, TURN = 0.4, 0.003, 0.0003  # of counts; of the offsets; of the weights
PACE, LATER, SLOW = 8, 256, 64  # weights move every PACE tokens, from token LATER on every SLOW
BESIDE = 256  # texts that go on side by side
HOLD = 20.0  # decisions that the first weights count for
GATES, LEVELS = 64, 24
SURE, FOUR = np.array([0.1, 1, 3], np.float32), np.uint8(4)
WORDS, BYTES, PAIR, SEG = range(4)
_C = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(int(_C), -1, 1 << 64))


def tokens(text: str | None) -> list[bytes]:
    """The words of a text, A-Z lowered, and then the end, which is the empty word."""
    return [*(text or "").encode("utf-8", "surrogatepass").lower().split(), b""]


def pack(a: np.ndarray) -> bytes:
    """An array, byte by byte of its values, so that the upper bytes compress."""
    values = np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.itemsize)
    raw = np.empty(values.shape[::-1], np.uint8)
    for k, to in enumerate(raw):  # several times faster than tobytes() of what is transposed
        to[:] = values[:, k]
    return a.dtype.char.encode() + raw.size.to_bytes(8, "little") + (pa.compress(raw, codec="zstd", asbytes=True) if raw.size else b"")


def unpack(data: bytes) -> np.ndarray:
    kind, size = np.dtype(data[:1].decode()), int.from_bytes(data[1:9], "little")
    if not size:
        return np.empty(0, kind)
    raw = np.frombuffer(pa.decompress(data[9:], decompressed_size=size, codec="zstd", asbytes=True), np.uint8).reshape(kind.itemsize, -1)
    values = np.empty(raw.shape[::-1], np.uint8)
    for k, of in enumerate(raw):
        values[:, k] = of
    return values.view(kind).ravel()


def _small(a: np.ndarray) -> np.ndarray:
    return a.astype(np.uint32) if not len(a) or a.max() < 1 << 32 else a.astype(np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def look(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """values[at]; places that are known to be inside aren't checked one by one, which takes longer than to look."""
    return values.take(at, mode="clip")


class Code:
    """A Huffman code of the symbols 0..n-1; each decision is a node of the tree and a bit."""

    def __init__(self, counts: list[int]) -> None:
        n = len(counts)
        heap = [(max(1, c), i) for i, c in enumerate(counts)]
        heapq.heapify(heap)
        parent, bit, below = [0] * (2 * n), [0] * (2 * n), []
        for node in range(n, 2 * n - 1):
            (a, i), (b, j) = heapq.heappop(heap), heapq.heappop(heap)
            parent[i], parent[j], bit[j] = node, node, 1
            below.append((i, j))
            heapq.heappush(heap, (a + b, node))
        root = 2 * n - 2
        nodes, bits, start = [], [], [0]
        for s in range(n):
            path = []
            while s != root:
                path.append((root - parent[s], bit[s]))
                s = parent[s]
            nodes += [x for x, _ in reversed(path)]
            bits += [x for _, x in reversed(path)]
            start.append(len(nodes))
        self.n, self.start = n, np.array(start, np.int64)
        self.size = np.diff(self.start)
        self.nodes, self.bits = np.array(nodes, np.int64), np.array(bits, np.uint8)
        self.sign = np.where(self.bits, -1, 1).astype(np.float32)
        depth = np.arange(len(nodes)) - np.repeat(self.start[:-1], self.size)
        self.gate = ((depth > 1).astype(np.uint8) + (depth > 4) + (depth > 8)).astype(np.uint8) * np.uint8(16)
        # symbols from left to right, and the runs of them under the branches of each node
        self.leaves, open_ = [], [root]
        while open_:
            x = open_.pop()
            if x < n:
                self.leaves.append(x)
            else:
                open_ += reversed(below[x - n])
        at = {s: k for k, s in enumerate(self.leaves)}
        span = {s: (at[s], at[s] + 1) for s in range(n)}
        self.runs = np.zeros((n - 1, 3), np.int64)
        for k, (i, j) in enumerate(below):
            span[n + k] = (span[i][0], span[j][1])
            self.runs[root - n - k] = (span[i][0], span[j][0], span[j][1])

    def expand(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which symbol, place in the code) of each decision."""
        return self.decisions(symbols)[:2]

    def decisions(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(which symbol, place in the code) of each decision, and the first decision of each symbol; none is without one."""
        size = look(self.size, symbols)
        first = np.cumsum(size)
        many = int(first[-1]) if len(first) else 0
        first -= size
        # sums of differences, which are 1 inside of a symbol's code, and jump where the next one begins
        which, at = np.zeros(many, np.int64), np.ones(many, np.int64)
        start = look(self.start, symbols)
        if many:
            which[first[1:]] = 1
            at[first[1:]] = np.diff(start) - size[:-1] + 1
            at[0] = start[0]
        return np.cumsum(which, out=which), np.cumsum(at, out=at), first

    def by_node(self, counts: np.ndarray) -> np.ndarray:
        """From counts of symbols, a row for each context, the counts (zeros, ones) of each context and node."""
        below = np.zeros((len(counts), self.n + 1))
        np.cumsum(counts[:, self.leaves], axis=1, out=below[:, 1:])
        lo, mid, hi = (below[:, self.runs[:, k]] for k in range(3))
        return np.stack((mid - lo, hi - mid), axis=2).reshape(-1, 2).astype(np.float32)


def byte_code() -> Code:
    """Of bytes and the end of a word; by rule, so that it needs no pass: letters and the end are short, what is seldom in texts is long."""
    return Code([32 if 97 <= x <= 122 else 8 if x >= 128 or 48 <= x <= 57 else 4 if x in b"-'.,!?" else 1 for x in range(256)] + [160])


def odds(counts: np.ndarray) -> np.ndarray:
    """The log odds of ones by counts (zeros, ones)."""
    return np.log((counts[:, 1] + np.float32(PRIOR)) / (counts[:, 0] + np.float32(PRIOR))).astype(np.float32)


def classes(joined: bytes) -> np.ndarray:
    """For words joined by line ends: a number under CLASSES by the last two bytes of each."""
    data = np.frombuffer(b"\n\n" + joined + b"\n", np.uint8).astype(np.int64)
    ends = np.flatnonzero(data == 10)[2:]
    last, before = data[ends - 1], data[ends - 2]
    return ((last * 257 + np.where(last == 10, 0, before)) * 40503 >> 4) % CLASSES


class Model:
    """What scoring needs. words, counts: the frequent ones; by_class: tokens of each class, those of frequent words left out."""

    def __init__(self, words: list[bytes], counts: list[int], by_class: np.ndarray, total: int, distinct: int, new: int, bits: int) -> None:
        self.words, self.n, self.v, self.by_class, self.bits = words, total, distinct, by_class, bits
        self.ids = {w: i for i, w in enumerate(words)}
        self.new = len(words) + CLASSES  # the symbol of a new word
        self.code, self.bytes = Code([*counts, *by_class.tolist(), new]), byte_code()
        few = min(FEW, len(words)) + 1
        ends = classes(b"\n".join(words)) if words else np.empty(0, np.int64)
        self.suffix = np.concatenate((ends % 32, np.arange(CLASSES) % 32, (32, 32)))  # of each symbol; of a new word, and of none, 32
        self.few, self.rows = few, (1, self.new + 2, few * 33, PAIRS, few * few)
        self.tables: list[list[np.ndarray]] = [[], []]  # log odds; while weights learn, those without a zero and without a one, by turns
        tree = np.array([0.1, 0.3, 0.2, 0.2, 0.2, 0.0])
        self.weights = [np.tile(tree, (GATES, 1)), np.tile([0.1, 0.2, 0.4, 0.3, 0.0], (GATES, 1)), np.tile([0.1, 0.0, -1.0], (LEVELS, 1)), np.tile([0.3, 0.5, 0.0], (LEVELS, 1))]


# ---- a block ----


def _before(a: np.ndarray, place: np.ndarray, k: int, none: int) -> np.ndarray:
    """What stands k places before, in the same text."""
    out = np.full(len(a), none, a.dtype)
    out[k:] = a[:-k] if k < len(a) else a[:0]
    out[place < k] = none
    return out


def ordered(key: np.ndarray, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys, from 0 to `high`, in ascending order, and the place that each comes from; equal keys keep their order. Where both fit in 64
    bits, key and place are sorted as one number, which is several times faster than sorting places by key."""
    bits = max(1, len(key)).bit_length()
    if int(high).bit_length() + bits > 64:
        order = np.argsort(key, kind="stable")
        return key[order], order
    both = np.sort((key.astype(np.uint64) << np.uint64(bits)) | np.arange(len(key), dtype=np.uint64))
    return both >> np.uint64(bits), (both & np.uint64((1 << bits) - 1)).astype(np.int64)


def ranked(key: np.ndarray, high: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in ascending order, and which of them each key is."""
    key, order = ordered(key, high)
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    which = np.empty(len(key), np.int64)
    which[order] = np.cumsum(new) - 1
    return key[new], which


def occurrences(doc: np.ndarray, value: np.ndarray, values: int) -> tuple[np.ndarray, np.ndarray]:
    """For each entry: how often its value, one of so many, stands before it in its text, and how often in all of the text."""
    values = max(1, values)
    key, order = ordered(doc * values + value, (int(doc[-1]) + 1) * values if len(doc) else 0)
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    first = np.flatnonzero(new)
    size = np.diff(first, append=len(key))
    early, all_ = np.empty(len(key), np.int64), np.empty(len(key), np.int64)
    early[order] = np.arange(len(key)) - np.repeat(first, size)
    all_[order] = np.repeat(size, size)
    return early, all_


_held: list[np.ndarray] = [np.empty(0, np.uint64)] * 2


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of an odd number, and their inverses; kept for the next block."""
    if len(_held[0]) < n:
        _held[:] = [np.cumprod(np.full(max(n, 2 * BLOCK), x), dtype=np.uint64) for x in (_C, _BACK)]
    return _held[0][:n], _held[1][:n]


class Block:
    """Texts as numbers of words in a list of their own, one text after the other."""

    def __init__(self, ids: bytes, size: bytes, learn: bytes, words: bytes) -> None:
        self.ids, self.size, self.learn = unpack(ids).astype(np.int64), unpack(size), unpack(learn).astype(bool)
        self.joined = pa.decompress(words[8:], decompressed_size=int.from_bytes(words[:8], "little"), codec="zstd", asbytes=True) if words[8:] else b""
        self.words = self.joined.split(b"\n")
        self.doc = np.repeat(np.arange(len(self.size)), self.size)
        self.first = np.cumsum(self.size) - self.size
        self.place = np.arange(len(self.ids)) - np.repeat(self.first, self.size)
        self.learns = self.learn[self.doc]
        self.hash = np.fromiter(map(xxhash.xxh3_64_intdigest, self.words), np.uint64, len(self.words))

    def shard(self, shards: int) -> np.ndarray:
        """That of each word."""
        return (self.hash % np.uint64(shards)).astype(np.int64)

    def keys(self, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keys of the pair that each token makes with the one before (an end before the first), then of each segment's context, then of
        each segment; and the segments' begins and ends."""
        h = self.hash[self.ids]
        end = np.uint64(xxhash.xxh3_64_intdigest(b""))
        back = [np.where(self.place >= k, np.concatenate((np.full(min(k, len(h)), end), h[:-k])), end) for k in (1, 2, 3, 4)]
        pair = _mix(h + back[0] * _C)
        context = np.zeros(len(h), np.uint64)
        for b in back:
            context = (context + b) * _C
        context = _mix(context ^ np.uint64(0xA5A5))
        begin = np.flatnonzero((self.place == 0) | ((context >> np.uint64(33)) % np.uint64(SPAN) == 0))
        end_ = np.append(begin[1:], len(h))
        powers, undo = _powers(len(h))
        run = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * powers, dtype=np.uint64)))
        segment = _mix((run[end_] - run[begin]) * undo[begin] + context[begin])
        return np.concatenate((pair, context[begin], segment)) >> np.uint64(64 - bits), begin, end_

    def known(self, model: Model, totals: np.ndarray, of_keys: np.ndarray) -> dict[str, bytes]:
        """What scoring needs of the block, packed: symbols; the logarithms of words' shares in their classes; new words; counts of pairs
        and segments, and of what they are shares of; all counts as they are before each token. And base scores and known tokens."""
        ids, doc, learns = self.ids, self.doc, self.learns
        total = totals.astype(np.int64)[ids]
        early, own = occurrences(doc, ids, len(self.words))
        count = total + early - np.where(learns, own, 0)
        top = np.fromiter(map(model.ids.get, self.words, repeat(-1)), np.int64, len(self.words))
        sym, cls = top[ids], classes(self.joined)[ids]
        rare = np.flatnonzero(sym < 0)
        early, own = occurrences(doc[rare], cls[rare], CLASSES)
        inside = model.by_class[cls[rare]] + early - np.where(learns[rare], own, 0)
        there = count[rare] > 0
        sym[rare] = np.where(there, len(model.words) + cls[rare], model.new)
        share = np.log(count[rare][there] / inside[there])
        new, spelt = np.unique(ids[rare[~there]], return_inverse=True)
        new = b"\n".join([self.words[i] for i in new.tolist()])

        keys, begin, _ = self.keys(model.bits)
        where, n, m = ranked(keys, 1 << model.bits)[1], len(ids), len(begin)
        left = np.where(self.place > 0, np.concatenate((np.zeros(1, np.int64), count[:-1])), 0)  # of the word before, as one that is followed
        ends = int(totals[self.words.index(b"")]) if n else 0
        left[self.place == 0] = ends - learns[self.place == 0]
        low = math.log10(model.n + model.v + 1)
        out = {"sym": sym.astype(np.uint16), "share": share.astype(np.float32), "spelt": spelt.astype(np.uint32), "begin": np.diff(begin, prepend=0).astype(np.uint32)}
        live = {"pair": self._live(doc, where[:n], of_keys), "left": left, "context": self._live(doc[begin], where[n : n + m], of_keys), "segment": self._live(doc[begin], where[n + m :], of_keys)}
        per = {"n_known": np.bincount(doc, total > 0, len(self.size)).astype(np.int64), "base": np.bincount(doc, (np.log10(totals + 1.0) - low)[ids], len(self.size))}
        out |= {k: _small(v) for k, v in live.items()} | per
        return {k: pack(v) for k, v in out.items()} | {"new": len(new).to_bytes(8, "little") + (pa.compress(new, codec="zstd", asbytes=True) if new else b"")}

    def _live(self, doc: np.ndarray, key: np.ndarray, totals: np.ndarray) -> np.ndarray:
        early, own = occurrences(doc, key, len(totals))
        return totals[key].astype(np.int64) + early - np.where(self.learn[doc], own, 0)


KNOWN = ("sym", "share", "spelt", "begin", "pair", "left", "context", "segment", "n_known", "base", "new")


class Symbols:
    """The symbols of a block's texts."""

    def __init__(self, row: dict[str, bytes]) -> None:
        self.size, self.learn = unpack(row["size"]), unpack(row["learn"]).astype(bool)
        self.doc = np.repeat(np.arange(len(self.size)), self.size)
        self.first = np.cumsum(self.size) - self.size
        self.place = np.arange(len(self.doc)) - np.repeat(self.first, self.size)
        self.learns = self.learn[self.doc]
        self.sym = unpack(row["sym"]).astype(np.int64)

    def contexts(self, model: Model) -> list[np.ndarray]:
        """The row of each token in the tables of each predictor: none; the symbol before; the last of the few most frequent words, and
        the end of the word before; a hash of the two symbols before; the last two of the few."""
        sym, place, few = self.sym, self.place, model.few
        one, two, n = _before(sym, place, 1, model.new + 1), _before(sym, place, 2, model.new + 1), len(sym)
        at = np.maximum.accumulate(np.where(sym < few - 1, np.arange(n), -1))
        last = _before(at, place, 1, -1)
        last[last < np.repeat(self.first, self.size)] = -1
        f1 = np.where(last >= 0, sym[last], few - 1)
        f2 = np.where(last >= 0, f1[last], few - 1)
        both = _mix((one * (model.new + 2) + two).astype(np.uint64)) % np.uint64(PAIRS)
        return [np.zeros(n, np.int64), one, f1 * 33 + model.suffix[one], both.astype(np.int64), f1 * few + f2]


class Ready(Symbols):
    """A block whose counts are known: row has what known() gave, size and learn."""

    def __init__(self, row: dict[str, bytes], model: Model) -> None:
        super().__init__(row)
        self.share = np.zeros(len(self.sym))
        self.share[(self.sym >= len(model.words)) & (self.sym < model.new)] = unpack(row["share"])
        self.at, self.spelt, data = np.flatnonzero(self.sym == model.new), unpack(row["spelt"]).astype(np.int64), row["new"]
        self.new = pa.decompress(data[8:], decompressed_size=int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True).split(b"\n") if data[8:] else [b""][: len(self.at)]
        self.begin = np.cumsum(unpack(row["begin"]), dtype=np.int64)
        self.pair, self.left, self.context, self.segment = (unpack(row[k]) for k in ("pair", "left", "context", "segment"))


def spelled(words: list[bytes]) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """The symbols of words spelt out, their contexts and the word of each."""
    data = np.frombuffer(b"".join(words), np.uint8)
    size = np.array([len(w) for w in words]) + 1
    last = np.cumsum(size) - 1
    sym = np.full(last[-1] + 1, END_OF_WORD, np.int64)
    inside = np.ones(len(sym), bool)
    inside[last] = False
    sym[inside] = data
    place = np.arange(len(sym)) - np.repeat(last - size + 1, size)
    contexts, history = [], np.zeros(len(sym), np.uint64)
    for k in range(1, max(ORDERS) + 1):
        history = history * np.uint64(263) + (_before(sym, place, k, -1) + 1).astype(np.uint64)
        if k in ORDERS:
            contexts.append(_mix(history + np.uint64(k << 40)) & ~np.uint64(511))  # room for a symbol
    return sym, contexts, np.repeat(np.arange(len(words)), size)


def byte_slot(code: Code, which: np.ndarray, at: np.ndarray, context: np.ndarray, bits: int) -> np.ndarray:
    key = look(context, which)
    key += look(code.nodes, at).view(np.uint64) * _C
    key *= np.uint64(0xBF58476D1CE4E5B9)
    key >>= np.uint64(64 - bits)
    return key.view(np.int64)


def byte_slots(code: Code, which: np.ndarray, at: np.ndarray, contexts: list[np.ndarray]) -> Iterator[np.ndarray]:
    """The address of each decision in each of the bytes' tables."""
    return (byte_slot(code, which, at, c, b) for c, b in zip(contexts, BYTE_BITS, strict=True))


def sliced(words: list[bytes], most: int = 8000) -> Iterator[tuple[int, int]]:
    """Runs of words with about that many bytes."""
    begin, size = 0, 0
    for i, w in enumerate(words):
        size += len(w) + 1
        if size >= most or i == len(words) - 1:
            yield begin, i + 1
            begin, size = i + 1, 0


def gates(depth: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """By the depth (times 16) and by how sure two predictors are."""
    out = np.zeros(len(x), np.uint8)
    for v in (np.abs(x), np.abs(y)):
        out *= FOUR
        for edge in SURE:
            out += (v > edge).view(np.uint8)  # of one type, so that nothing is cast
    out += depth
    return out.astype(np.intp)


class Learner:
    """Weights that learn online, by Newton's method with all the curvature so far."""

    def __init__(self, weights: list[np.ndarray]) -> None:
        self.weights = [w.copy() for w in weights]
        self.bend = [np.zeros((*w.shape, w.shape[1])) for w in weights]

    def step(self, part: int, gate: np.ndarray, x: np.ndarray, e: np.ndarray, v: np.ndarray) -> None:
        """x: inputs and a one, a row for each of them; e: what came less the probability of a one; v: curvature. The curvature, by which
        steps are scaled, is that of every fourth decision, times four."""
        w, few, n = self.weights[part], slice(None, None, 4), len(x)
        slope = np.stack([np.bincount(gate, e * row, len(w)) for row in x], axis=1)
        rows, some, scaled = x[:, few], gate[few], 4 * v[few]
        order = np.argsort(some.astype(np.uint8), kind="stable")  # decisions of a gate side by side
        rows, scaled = rows.take(order, axis=1, mode="clip"), look(scaled, order)
        many = np.bincount(some, minlength=len(w))
        there = np.flatnonzero(many)
        first = (np.cumsum(many) - many)[there]
        for i in range(n if len(there) else 0):
            one = scaled * rows[i]
            for j in range(i, n):
                h = np.add.reduceat(one * rows[j], first)
                self.bend[part][there, i, j] += h
                if j > i:
                    self.bend[part][there, j, i] += h
        move = np.linalg.solve(self.bend[part] + HOLD * np.eye(n), slope[..., None])[..., 0]
        w += np.clip(move, -1, 1)

    def sums(self) -> np.ndarray:
        """Curvatures, and weights times curvatures, which add up over tasks."""
        return np.concatenate([a.ravel() for w, b in zip(self.weights, self.bend, strict=True) for a in (b, np.einsum("gij,gj->gi", b, w))])


def averaged(first: list[np.ndarray], sums: np.ndarray) -> list[np.ndarray]:
    """The weights of all tasks, averaged by their curvatures; the first ones count for HOLD decisions."""
    out, at = [], 0
    for w in first:
        g, n = w.shape
        bend = sums[at : at + g * n * n].reshape(g, n, n) + HOLD * np.eye(n)
        pull = sums[at + g * n * n : at + g * n * n + g * n].reshape(g, n) + HOLD * w
        out.append(np.round(np.linalg.solve(bend, pull[..., None])[..., 0], 6))
        at += g * n * n + g * n
    return out


def without_one(counts: np.ndarray) -> np.ndarray:
    """For each cell of counts (zeros, ones) the log odds once a zero, and once a one, that is looked at has been taken out."""
    zero, one = np.maximum(counts - np.array([1, 0], np.float32), 0), np.maximum(counts - np.array([0, 1], np.float32), 0)
    return np.stack((odds(zero), odds(one)), axis=1).ravel()


def _p(s: np.ndarray, sign: np.ndarray) -> np.ndarray:
    """The probability of what came."""
    out = np.clip(s, -30, 30)
    out *= sign
    np.exp(out, out=out)
    out += 1
    return np.reciprocal(out, out=out)


def above(s: np.ndarray) -> np.ndarray:
    """log(1 + exp(s)), of s up to 30 and to some 1e-7, which is what single precision has; logaddexp takes ten times as long."""
    return np.log(np.exp(s) + np.float32(1))


def learn_tree(model: Model, learner: Learner, part: int, code: Code, symbols: np.ndarray, addresses) -> np.ndarray:
    """The log probability of each symbol, with weights that learn from it. addresses(which, at, bits) gives those of decisions."""
    which, at, first = code.decisions(symbols)
    bits = look(code.bits, at)
    rows = np.empty((len(model.tables[part]) + 1, len(at)), np.float32)
    rows[-1] = 1
    for t, a, x in zip(model.tables[part], addresses(which, at, bits), rows, strict=False):
        np.take(t, a, out=x, mode="clip")
    g = gates(look(code.gate, at), rows[1], rows[-2])
    *weights, offset = np.ascontiguousarray(learner.weights[part].astype(np.float32).T)
    s = look(offset, g)
    for x, w in zip(rows, weights, strict=False):
        y = look(w, g)
        y *= x
        s += y
    sign = look(code.sign, at)
    p = _p(s, sign)
    q = 1 - p
    learner.step(part, g, rows, -sign * q, p * q)
    return np.add.reduceat(np.log(p), first)


def spelling(model: Model, words: list[bytes], learner: Learner | None = None) -> np.ndarray:
    """The log probability of each word's spelling."""
    out, code = np.zeros(len(words)), model.bytes
    for a, b in sliced(words):
        sym, contexts, word = spelled(words[a:b])
        if learner:
            p = learn_tree(model, learner, BYTES, code, sym, lambda which, at, bits, c=contexts: (a * 2 + bits for a in byte_slots(code, which, at, c)))
            out[a:b] = np.bincount(word, p, b - a)
            continue
        which, at, first = code.decisions(sym)
        x = [look(t, i) for t, i in zip(model.tables[BYTES], byte_slots(code, which, at, contexts), strict=True)]
        w = np.ascontiguousarray(model.weights[BYTES].astype(np.float32).T)
        g = gates(look(code.gate, at), x[1], x[-1])
        s = look(w[-1], g)
        for v, k in zip(x, w, strict=False):
            v *= look(k, g)
            s += v
        out[a:b] = np.bincount(word, np.add.reduceat(np.log(_p(s, look(code.sign, at))), first), b - a)
    return out


def tree(model: Model, block: Ready, rows: list[np.ndarray]) -> np.ndarray:
    """The log probability of each token's symbol. Texts go on side by side, each with weights of its own that move every few tokens.
    What is in `rows` gives way."""
    code, sym, nodes = model.code, block.sym, model.code.n - 1
    logp = np.zeros(len(sym))
    rank = np.empty(len(block.size), np.int64)
    rank[np.argsort(-block.size, kind="stable")] = np.arange(len(block.size))
    rank = rank[block.doc]
    turn = np.where(block.place < LATER, block.place // PACE, LATER // PACE + (block.place - LATER) // SLOW)
    turn += rank // BESIDE * (int(turn.max(initial=0)) + 1)  # texts go on in groups, whose weights stay in the cache
    turn, order = ordered(turn * BESIDE + rank % BESIDE, (int(turn.max(initial=0)) + 1) * BESIDE)
    turn, rank = turn.astype(np.int64) // BESIDE, rank[order] % BESIDE
    first = model.weights[WORDS].astype(np.float32).T[:, None]
    for i, r in enumerate(rows[1:], 1):  # in their place, so that no table of rows is there twice; the first predictor has one row
        rows[i] = r[order] * nodes
    sym, text = sym[order], rank * GATES
    got, place = np.zeros(len(sym)), block.place[order]
    for begin, end in pairwise([*np.flatnonzero(np.diff(turn, prepend=-1)).tolist(), len(turn)]):
        if not place[begin]:  # of a group
            own = np.repeat(first, BESIDE, axis=1)  # weights and offset of each text and gate
            flat = own.reshape(len(own), -1)
        texts = 4 * (int(rank[end - 1]) + 1)
        error = np.zeros((len(own), texts))
        for k in range(begin, end, CHUNK):
            part = slice(k, min(end, k + CHUNK))
            which, at, start = code.decisions(sym[part])
            node = look(code.nodes, at)
            x = [look(model.tables[WORDS][0], node)]  # it has one row
            for t, r in zip(model.tables[WORDS][1:], rows[1:], strict=True):
                cell = look(r[part], which)
                cell += node
                x.append(look(t, cell))
            g = gates(look(code.gate, at), x[1], x[-1])
            cell = look(text[part], which)
            cell += g
            s = look(flat[-1], cell)
            for v, w in zip(x, flat, strict=False):
                y = look(w, cell)
                y *= v
                s += y
            sign = look(code.sign, at)
            p = _p(s, sign)
            got[part] = np.add.reduceat(np.log(p), start)
            e = sign * (p - 1)
            cell >>= 4
            error[-1] += np.bincount(cell, e, texts)
            for i, v in enumerate(x):
                v *= e
                error[i] += np.bincount(cell, v, texts)
        error[:-1] *= TURN
        error[-1] *= RATE
        own[:, : texts // 4] += np.repeat(error.astype(np.float32), 16, axis=1).reshape(len(own), -1, GATES)
    logp[order] = got
    return logp


def blend(weights: np.ndarray, logp: np.ndarray, count: np.ndarray, of: np.ndarray, doc: np.ndarray, learner: Learner | None, part: int, learns: np.ndarray) -> np.ndarray:
    """The log probability of entries that are taken, as a decision has it, from their share count / of, or else have logp. The decision's
    inputs are how often such a count was there so far in the text, and whether it was the last time; its gate is the size of `of`. With
    a learner, only entries of learning texts are gone over."""
    out = logp.copy()
    at = np.flatnonzero(of > 0)
    cuts = np.arange(0, len(at), STEP)
    if learner:
        own = learns[at]
        cuts = (np.cumsum(own) - own)[cuts]
        at = at[own]
    if not len(at):
        return out
    count, of, d = count[at].astype(np.float32), of[at].astype(np.float32), doc[at]
    y = count > 0
    start = np.flatnonzero(np.diff(d, prepend=-1))
    size = np.diff(start, append=len(d))
    place = np.arange(len(d), dtype=np.int32) - np.repeat(start.astype(np.int32), size)
    ones = np.cumsum(y, dtype=np.int32) - y
    ones -= np.repeat(ones[start], size)
    x = np.ones((3, len(d)), np.float32)
    np.log((ones.astype(np.float32) + np.float32(0.5)) / ((place - ones).astype(np.float32) + np.float32(0.5)), out=x[0])
    x[1, 1:] = np.where(y[:-1], np.float32(1), np.float32(-1))
    x[1, start] = 0
    g = np.minimum((of.view(np.uint32) >> np.uint32(23)).astype(np.intp) - 127, LEVELS - 1)  # the whole part of the logarithm to base 2
    rest = logp[at]
    share = np.log(count[y] / of[y])
    n = 0
    for a, b in pairwise([*cuts.tolist(), len(at)]):
        k = slice(a, b)
        w = np.ascontiguousarray((learner.weights[part] if learner else weights).astype(np.float32).T)
        s = sum(v * look(u, g[k]) for v, u in zip(x[:, k], w, strict=True))
        np.clip(s, -30, 30, out=s)
        no = rest[k] - above(s)
        hits = np.flatnonzero(y[k])
        yes = share[n : n + len(hits)] - above(-s[hits])
        n += len(hits)
        no_ = no[hits]
        both = np.maximum(yes, no_) + above(-np.abs(yes - no_).astype(np.float32))
        no[hits] = both
        out[at[k]] = no
        if learner:
            p = 1 / (1 + np.exp(-s))
            e = -p
            e[hits] += np.exp((yes - both).astype(np.float32))
            learner.step(part, g[k], x[:, k], e, p * (1 - p))
    return out


def follow(model: Model, block: Ready, learner: Learner | None = None) -> np.ndarray:
    """The log10 probability of each text of a block. With a learner, only learning texts are gone over."""
    logp = np.zeros(len(block.sym))
    rows, nodes = block.contexts(model), model.code.n - 1
    rows[0] = rows[0][:0]  # which has one row
    if learner:
        mine = np.flatnonzero(block.learns)
        for k in range(0, len(mine), STEP):
            part = mine[k : k + STEP]
            rows_ = [r[part] * (2 * nodes) for r in rows[1:]]

            def addresses(which: np.ndarray, at: np.ndarray, bits: np.ndarray, rows_: list[np.ndarray] = rows_) -> Iterator[np.ndarray]:
                node = look(model.code.nodes, at)
                node += node
                node += bits
                yield node  # the first has one row
                for r in rows_:
                    cell = look(r, which)
                    cell += node
                    yield cell

            logp[part] = learn_tree(model, learner, WORDS, model.code, block.sym[part], addresses)
    else:
        logp = tree(model, block, rows)
    del rows
    logp += block.share
    spell, asked = np.zeros(len(block.new)), np.arange(len(block.new))
    if learner:
        asked = np.unique(block.spelt[block.learns[block.at]])
    spell[asked] = spelling(model, [block.new[i] for i in asked.tolist()], learner)
    logp[block.at] += spell[block.spelt]
    logp = blend(model.weights[PAIR], logp, block.pair, block.left, block.doc, learner, PAIR, block.learns)
    whole = np.add.reduceat(logp, block.begin)
    doc = block.doc[block.begin]
    whole = blend(model.weights[SEG], whole, block.segment, block.context, doc, learner, SEG, block.learn[doc])
    return np.bincount(doc, whole, len(block.size)) / math.log(10)


# ---- counting ----

MADE = "block bigint, doc_id array<{kind}>, learn binary, bytes binary, size binary, ids binary, words binary"


def _numbered(kind: pa.DataType, most: int):
    """Blocks of texts (doc_id, learn, text), as numbers of the words in a list of the block's own, the end the last of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId() if TaskContext.get() else 0, 0
        held: list[tuple[pa.RecordBatch, pa.Array, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            nonlocal made
            found = pa.concat_arrays([w for _, w, _ in held]).dictionary_encode()
            size = np.concatenate([n for _, _, n in held])
            end = len(found.dictionary)
            ids = np.insert(found.indices.to_numpy().astype(np.uint32), np.cumsum(size), end)
            words = b"\n".join([*found.dictionary.cast(pa.binary()).to_pylist(), b""])
            of = lambda c: pa.concat_arrays([b.column(c) for b, _, _ in held])
            names = of("doc_id").cast(kind)
            row = {
                "learn": pack(of("learn").to_numpy(zero_copy_only=False).astype(np.uint8)),
                "bytes": pack(pc.binary_length(of("text")).to_numpy().astype(np.int64)),
                "size": pack(size + 1), "ids": pack(ids),
                "words": len(words).to_bytes(8, "little") + (pa.compress(words, codec="zstd", asbytes=True) if words else b""),
            }
            block = pa.array([(task << 32) + made], pa.int64())
            out = pa.RecordBatch.from_arrays([block, pa.ListArray.from_arrays(pa.array([0, len(names)], pa.int32()), names), *(pa.array([x], pa.binary()) for x in row.values())], ["block", "doc_id", *row])
            made += 1
            held.clear()
            return out

        n = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            parts = pc.ascii_split_whitespace(pc.ascii_lower(batch.column("text")))  # of ASCII only; nothing where a text begins or ends with space
            words, owner = parts.flatten(), pc.list_parent_indices(parts).to_numpy()
            full = pc.not_equal(words, "")
            words, owner = words.filter(full), owner[full.to_numpy(zero_copy_only=False)]
            size = np.bincount(owner, minlength=batch.num_rows)
            ends = np.cumsum(size)
            begin = 0
            while begin < batch.num_rows:
                base = ends[begin] - size[begin]
                stop = min(batch.num_rows, int(np.searchsorted(ends + np.arange(1, len(ends) + 1) - base - begin, most - n)) + 1)  # at most one text beyond
                held.append((batch.slice(begin, stop - begin), words.slice(base, ends[stop - 1] - base), size[begin:stop]))
                n += int(size[begin:stop].sum()) + stop - begin
                begin = stop
                if n >= most:
                    yield flush()
                    n = 0
        if held:
            yield flush()

    return run


ASKED = "block bigint, shard int, kind int, data binary, counts binary"


def _asked(shards: int, bits: int):
    """What a block has, a row for each shard: its words (kind 0) and its keys (kind 1), with their counts in its learning texts."""
    fields = pa.schema([("block", pa.int64()), ("shard", pa.int32()), ("kind", pa.int32()), ("data", pa.binary()), ("counts", pa.binary())])
    edges = np.array([(s << bits) // shards for s in range(shards)], np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                b = Block(r["ids"], r["size"], r["learn"], r["words"])
                rows = []
                shard, n = b.shard(shards), np.bincount(b.ids[b.learns], minlength=len(b.words))
                order = np.argsort(shard, kind="stable")
                ends = np.cumsum(np.bincount(shard, minlength=shards)).tolist()
                for s, (i, j) in enumerate(zip([0, *ends], ends, strict=False)):
                    if j > i:
                        words = b"\n".join([b.words[k] for k in order[i:j].tolist()])
                        rows.append((s, 0, len(words).to_bytes(8, "little") + pa.compress(words, codec="zstd", asbytes=True), pack(_small(n[order[i:j]]))))
                keys, begin, _ = b.keys(bits)
                counts = np.concatenate((b.learns, b.learns[begin], b.learns[begin])).astype(np.float64)
                keys, where = ranked(keys, 1 << bits)
                n = np.bincount(where, counts, len(keys)).astype(np.int64)
                ends = np.append(np.searchsorted(keys, edges[1:]), len(keys)).tolist()
                for s, (i, j) in enumerate(zip([0, *ends], ends, strict=False)):
                    if j > i:
                        rows.append((s, 1, pack(_small(np.diff(keys[i:j], prepend=edges[s]))), pack(_small(n[i:j]))))
                columns = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array([r["block"]] * len(rows), pa.int64()), *(pa.array(c, f.type) for c, f in zip(columns, list(fields)[1:], strict=True))], schema=fields)

    return run


def words_of(data: bytes) -> pa.Array:
    """The words that a block has in a shard, from their packed list."""
    size = int.from_bytes(data[:8], "little")
    text = np.frombuffer(pa.decompress(data[8:], decompressed_size=size, codec="zstd", asbytes=True) if size else b"", np.uint8)
    ends = np.append(np.flatnonzero(text == 10), size)
    sizes = np.diff(ends, prepend=-1) - 1
    offsets = np.concatenate((np.zeros(1, np.int64), np.cumsum(sizes)))
    return pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(text[text != 10]))])


def word_totals(held: list[dict]) -> tuple[list[np.ndarray], dict[bytes, int]]:
    """The counts of words over all blocks, in each block's order; and those of words that occur in learning texts."""
    lists = [words_of(r["data"]) for r in held]
    found = pa.concat_arrays(lists).dictionary_encode()
    where, ends = found.indices.to_numpy(), np.cumsum([len(w) for w in lists])
    total = np.bincount(where, np.concatenate([unpack(r["counts"]) for r in held]), len(found.dictionary)).astype(np.int64)
    seen = np.flatnonzero(total)
    learnt = dict(zip(found.dictionary.take(pa.array(seen)).to_pylist(), total[seen].tolist(), strict=True))
    return [total[w] for w in np.split(where, ends[:-1])], learnt


TOTALS = "block bigint, shard int, kind int, data binary, n bigint"
STATS, FREQUENT, SPELT = 2, 3, 4


def segments(tables: list[np.ndarray], kind: int) -> Iterator[pa.RecordBatch]:
    """The cells of tables that aren't all zero, as rows (block: which table, shard: which segment)."""
    for k, t in enumerate(tables):
        t, rows = t.ravel(), []
        for s in range(0, len(t), SEGMENT):
            x = t[s : s + SEGMENT]
            if x.any():
                rows.append((k, s // SEGMENT, kind, pack(_small(x)), None))
        yield from _rows(rows)


def _rows(rows: list[tuple], most: int = 256) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(rows), most):
        columns = zip(*rows[i : i + most], strict=True)
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["block", "shard", "kind", "data", "n"])


def count_bytes(tables: list[np.ndarray], code: Code, words: list[bytes]) -> None:
    """Adds each of the words, once, to the bytes' tables of counts (zeros, ones). What is equal in context and symbol is added at once."""
    for a, b in sliced(words, 1 << 20):
        sym, contexts, _ = spelled(words[a:b])
        for k, c in enumerate(contexts):
            both = np.sort(c | sym.astype(np.uint64))
            first = np.flatnonzero(np.concatenate(([True], both[1:] != both[:-1])))
            n, both = np.diff(first, append=len(both)).astype(np.uint32), both[first]
            which, at = code.expand((both & np.uint64(511)).astype(np.int64))
            np.add.at(tables[k].ravel(), byte_slot(code, which, at, both & ~np.uint64(511), BYTE_BITS[k]) * 2 + code.bits[at], n[which])


def _totals(top: int):
    """For each shard and block the counts over all blocks, in the block's order; besides, for the model: (STATS) tokens of each class, at
    -1 distinct words, at -2 words that occur once; (FREQUENT) the most frequent words; (SPELT) the bytes' tables, each word counted once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_class, distinct, once, frequent = np.zeros(CLASSES, np.int64), 0, 0, []
        code, tables = byte_code(), [np.zeros((1 << b, 2), np.uint32) for b in BYTE_BITS]
        rows = (r for batch in batches for r in batch.to_pylist())
        for (shard, kind), held in groupby(rows, lambda r: (r["shard"], r["kind"])):
            held = list(held)
            if kind == 1:
                parts = [np.cumsum(unpack(r["data"]), dtype=np.uint64) for r in held]
                keys = np.concatenate(parts)  # from the shard's own edge on
                keys, where = ranked(keys, int(keys.max()))
                total = np.bincount(where, np.concatenate([unpack(r["counts"]) for r in held]), len(keys)).astype(np.int64)
                ends = np.cumsum([len(k) for k in parts]).tolist()
                yield from _rows([(r["block"], shard, kind, pack(_small(total[where[e - len(k) : e]])), None) for r, k, e in zip(held, parts, ends, strict=True)])
                continue
            counts, learnt = word_totals(held)
            yield from _rows([(r["block"], shard, kind, pack(_small(n)), None) for r, n in zip(held, counts, strict=True)])
            del held, counts
            pa.default_memory_pool().release_unused()  # of the words, for what the worker does next
            if learnt:
                n = np.fromiter(learnt.values(), np.int64, len(learnt))
                np.add.at(by_class, classes(b"\n".join(learnt)), n)
                distinct, once = distinct + len(learnt), once + int((n == 1).sum())
                frequent = heapq.nsmallest(top, [*frequent, *((-n, w) for w, n in learnt.items() if n > 1)])
                count_bytes(tables, code, [w for w in learnt if w])
        yield from _rows([(0, c, STATS, None, n) for c, n in [*enumerate(by_class.tolist()), (-1, distinct), (-2, once)]])
        yield from _rows([(0, 0, FREQUENT, w, -n) for n, w in frequent])
        yield from segments(tables, SPELT)

    return run


def _adder(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up the segments of a partition; there is a fixed number of them, however many tasks have sent theirs."""
    sums: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        for r in batch.to_pylist():
            at, x = (r["block"], r["shard"]), unpack(r["data"]).astype(np.uint64)
            sums[at] = sums[at] + x if at in sums else x
    yield from _rows([(t, s, 0, pack(_small(x)), None) for (t, s), x in sums.items()])


def _gathered(rows: DataFrame, spread: int, sizes: list[int], label: str) -> list[np.ndarray]:
    """The tables, added up; they have a fixed size."""
    out = [np.zeros(n, np.float64) for n in sizes]
    for r in written(rows.repartition(spread, "block", "shard").mapInArrow(_adder, TOTALS), label).select("block", "shard", "data").collect():
        x = unpack(r.data)
        out[r.block][r.shard * SEGMENT : r.shard * SEGMENT + len(x)] = x
    return out


READY = "block bigint, doc_id array<{kind}>, learn binary, bytes binary, size binary, " + ", ".join(f"{k} binary" for k in KNOWN)


def _joined(held, shards: int):
    """A block with what is known of it, from its totals: those of words by shards of its list, those of keys in ascending order."""

    def run(block: pa.Table, totals: pa.Table) -> pa.Table:
        parts: dict[tuple[int, int], np.ndarray] = {}
        for kind, shard, data in zip(*(totals.column(c).to_pylist() for c in ("kind", "shard", "data")), strict=True):
            parts[kind, shard] = unpack(data)
        of = lambda kind: np.concatenate([parts[k] for k in sorted(parts) if k[0] == kind])
        r = block.select(["ids", "size", "learn", "words"]).to_pylist()[0]
        b = Block(r["ids"], r["size"], r["learn"], r["words"])
        total = np.empty(len(b.words), np.int64)
        total[np.argsort(b.shard(shards), kind="stable")] = of(0)
        got = b.known(held.value, total, of(1))
        return pa.table([*(block.column(c) for c in ("block", "doc_id", "learn", "bytes", "size")), *(pa.array([got[k]], pa.binary()) for k in KNOWN)], ["block", "doc_id", "learn", "bytes", "size", *KNOWN])

    return run


def _counter(held):
    """The symbols' counts in each predictor's contexts, of learning texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = held.value
        tables = [np.zeros(r * model.code.n, np.uint32) for r in model.rows]
        for batch in batches:
            for r in batch.to_pylist():
                b = Symbols(r)
                for t, x in zip(tables, b.contexts(model), strict=True):
                    np.add.at(t, x[b.learns] * model.code.n + b.sym[b.learns], np.uint32(1))
        yield from segments(tables, 0)

    return run


def _blocks(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[tuple[pa.RecordBatch, Ready]]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1), Ready({c: batch.column(c)[i].as_py() for c in ("size", "learn", *KNOWN[:8], "new")}, model)


def _learner(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = held.value
        learner = Learner(model.weights)
        for _, b in _blocks(batches, model):
            follow(model, b, learner)
        sums = learner.sums()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(sums)), pa.int32()), pa.array(sums, pa.float64())], ["k", "v"])

    return run


def _scorer(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = held.value
        for row, b in _blocks(batches, model):
            of = lambda c, r=row: pa.array(unpack(r.column(c)[0].as_py()))
            got = [pa.array(b.learn), of("bytes"), of("size"), of("n_known"), of("base"), pa.array(follow(model, b))]
            yield pa.RecordBatch.from_arrays([row.column("doc_id")[0].values, *got], ["doc_id", "learn", "bytes", "n_tokens", "n_known", "base_score", "score"])

    return run


# ---- the operator ----


def score_texts(docs: DataFrame, learn, top: int = TOP, block: int = BLOCK) -> DataFrame:
    """(doc_id, learn, bytes, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) for each row of docs (doc_id, text).

    learn: a Column, true of the rows that the counts are learnt from; null counts as false. base_score is the add-one unigram model by
    the counts of all learning rows; score is by the counts of all others. top: words with a symbol of their own, at most; of equally
    frequent ones the smaller bytes win. A null text is empty: the end alone, and no bits_per_byte; repeated rows are counted and scored
    one by one; a null doc_id is passed through. Without learning rows every word is new and is spelt. An empty table gives an empty
    result. A text must fit in a task's memory.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    spread = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = docs.schema["doc_id"].dataType
    rows = docs.select("doc_id", F.coalesce(learn, F.lit(False)).alias("learn"), text_of("text").alias("text"))
    made, first = stored(rows.mapInArrow(_numbered(to_arrow_type(kind), block), MADE.format(kind=kind.simpleString())), "blocks", "none")
    blocks = made.count()
    # more tokens than this can't be: each block but the last of a task has `block` of them, and its last text's
    bits = min(64, max(32, math.ceil(math.log2(max(1, blocks) * block)) + SLACK))
    shards = max(1, min(math.ceil(blocks / 4), SHARDS))
    asked = made.drop("doc_id", "bytes").mapInArrow(_asked(shards, bits), ASKED).repartition(max(spread, shards // 4), "shard")
    totals, second = stored(asked.sortWithinPartitions("shard", "kind").mapInArrow(_totals(top), TOTALS), "totals", "none")

    stats = {r.shard: r.n for r in totals.where(F.col("kind") == STATS).groupBy("shard").agg(F.sum("n").alias("n")).collect()}  # a number for each class
    frequent = totals.where(F.col("kind") == FREQUENT).orderBy(F.col("n").desc(), "data").limit(top).collect()  # at most `top` rows
    words, counts = [bytes(r.data) for r in frequent], [r.n for r in frequent]
    by_class = np.array([stats.get(c, 0) for c in range(CLASSES)], np.int64)
    total = int(by_class.sum())
    np.subtract.at(by_class, classes(b"\n".join(words)) if words else np.empty(0, np.int64), counts)
    model = Model(words, counts, by_class, total, stats.get(-1, 0), stats.get(-2, 0), bits)
    spelt = _gathered(totals.where(F.col("kind") == SPELT), spread, [2 << b for b in BYTE_BITS], "bytes")

    held = spark.sparkContext.broadcast(model)
    both = made.groupBy("block").cogroup(totals.where("kind < 2").select("block", "kind", "shard", "data").groupBy("block"))
    ready, _ = stored(both.applyInArrow(_joined(held, shards), READY.format(kind=kind.simpleString())), "ready", "none")  # what is large is packed
    drop(spark, first, second)
    symbols = _gathered(ready.select("size", "learn", "sym").mapInArrow(_counter(held), TOTALS), spread, [r * model.code.n for r in model.rows], "symbols")
    held.destroy()
    tables = [[model.code.by_node(t.reshape(-1, model.code.n)) for t in symbols], [t.reshape(-1, 2).astype(np.float32) for t in spelt]]
    del symbols, spelt
    model.tables = [[without_one(t) for t in p] for p in tables]
    held = spark.sparkContext.broadcast(model)
    sums = ready.select("size", "learn", *KNOWN[:8], "new").mapInArrow(_learner(held), "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).orderBy("k").collect()  # a fixed number
    held.destroy()
    if sums:
        model.weights = averaged(model.weights, np.array([r.v for r in sums]))
    model.tables = [[odds(t) for t in p] for p in tables]
    del tables

    held = spark.sparkContext.broadcast(model)
    out = ready.mapInArrow(_scorer(held), f"doc_id {kind.simpleString()}, learn boolean, bytes bigint, n_tokens bigint, n_known bigint, base_score double, score double")
    return out.withColumn("train_tokens", F.lit(total).cast("long")).withColumn("bits_per_byte", F.when(F.col("bytes") > 0, -F.col("score") * math.log2(10) / F.col("bytes")))


def op5_mixlm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    got = score_texts(docs, crc_mod("doc_id", 7) != 2)
    return got.select("doc_id", (~F.col("learn")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")
