"""Toxicity by a bidirectional gated recurrent network with attention pooling, over character and word inputs.

A word's vector is its own embedding, if it is frequent among the learning rows, and what a character network makes of its bytes.
A second network of the same kind reads windows of words that overlap. A document's score comes from its highest window. Both
networks are trained in numpy, on the driver, on a bounded sample of labelled rows; scoring runs on the executors over all windows
of all texts. A word's part in the gates is worked out once and kept, so that frequent words cost a lookup.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from skeinlog.llm.common import bounded_batches, crc_mod, table
from skeinlog.llm.gru import BiGRU

WINDOW, STRIDE = 32, 20
PIECE = 24  # bytes of a word that the character network reads at once; longer words are read as several
#: The most labelled rows of each class that are learnt from.
SAMPLE = 1500
WORDS = 4096  # words with an embedding of their own, at most
CACHE = 150_000  # words whose gates a worker keeps
# Letters, digits and bytes beyond ASCII make up words; A-Z are lowered.
_TABLE = bytes((b + 32 if 65 <= b <= 90 else b) if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def tokens(text: str | None) -> list[bytes]:
    words = (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()
    if any(len(w) > PIECE for w in words):
        words = [w[i : i + PIECE] for w in words for i in range(0, len(w), PIECE)]
    return words


def starts(n: int) -> range:
    """Where the windows of n words begin; each word is in one at least, and a text without words has one window of padding."""
    return range(0, max(1, n - (WINDOW - STRIDE)), STRIDE)


class Network:
    """The two networks and their output. Row 0 of `words` stands for padding, row 1 for words without an embedding."""

    BYTES, CHAR, CHAR_H, WORD, H, ATTEND = 256, 8, 6, 12, 8, 8

    def __init__(self, vocabulary: list[bytes], seed: int = 2) -> None:
        rng = np.random.default_rng(seed)
        self.vocabulary = {w: i + 2 for i, w in enumerate(vocabulary)}
        self.chars = BiGRU(self.CHAR, self.CHAR_H, self.ATTEND, rng)
        self.main = BiGRU(self.WORD + 2 * self.CHAR_H, self.H, self.ATTEND, rng)
        small = lambda *s: (0.3 * rng.standard_normal(s)).astype(np.float32)
        self.bytes, self.words, self.out = small(self.BYTES, self.CHAR), small(len(vocabulary) + 2, self.WORD), small(2 * self.H + 1)
        self.scale, self.shift = 1.0, 0.0

    def letters(self, words: list[bytes]) -> np.ndarray:
        width = max(1, max(map(len, words)))
        return np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(len(words), width)

    def _two_ways(self, gates: np.ndarray, at: np.ndarray) -> np.ndarray:
        """gates (2, V, 3h) of the symbols at (B, T): (T, 2, B, 3h), the second direction reversed."""
        return np.stack((gates[0][at.T], gates[1][at.T[::-1]]), axis=1)

    def vectors(self, words: list[bytes], keep: bool = False):
        """A vector for each word; an empty word is padding."""
        letters = self.letters(words)
        cut = self._two_ways(self.chars.project(self.bytes), letters)
        spelt = self.chars.run(cut, keep)
        cache = None
        if keep:
            spelt, cache = spelt
        own = np.array([self.vocabulary.get(w, 1) if w else 0 for w in words])
        x = np.concatenate((self.words[own], spelt), axis=1)
        return (x, (letters, own, cache)) if keep else x

    def logits(self, gates: np.ndarray, at: np.ndarray) -> np.ndarray:
        pooled = self.main.run(self._two_ways(gates, at))
        return pooled @ self.out[:-1] + self.out[-1]

    def parameters(self) -> dict[str, np.ndarray]:
        named = {"bytes": self.bytes, "words": self.words, "out": self.out}
        return named | {f"c.{k}": v for k, v in self.chars.p.items()} | {f"m.{k}": v for k, v in self.main.p.items()}

    def step(self, windows: list[list[bytes]], label: np.ndarray, weight: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """The weighted loss of a batch and its gradients."""
        index: dict[bytes, int] = {b"": 0}
        at = np.array([[index.setdefault(w, len(index)) for w in x] + [0] * (WINDOW - len(x)) for x in windows])
        x, (letters, own, chars) = self.vectors(list(index), keep=True)
        pooled, cache = self.main.run(self._two_ways(self.main.project(x), at), keep=True)
        logit = pooled @ self.out[:-1] + self.out[-1]
        p = 1 / (1 + np.exp(-logit))
        loss = -(weight * np.log(np.maximum(1e-9, np.where(label, p, 1 - p)))).sum() / weight.sum()
        d = ((p - label) * weight / weight.sum()).astype(np.float32)
        g = {k: np.zeros_like(v) for k, v in self.parameters().items()}
        g["out"][:-1], g["out"][-1] = pooled.T @ d, d.sum()
        part = {k[2:]: v for k, v in g.items() if k[:2] == "m."}
        dgates = self.main.back(d[:, None] * self.out[:-1], cache, part)
        dx = self._spread(dgates, at, len(index), x, self.main, part)
        np.add.at(g["words"], own, dx[:, : self.WORD])
        part = {k[2:]: v for k, v in g.items() if k[:2] == "c."}
        dgates = self.chars.back(dx[:, self.WORD :], chars, part)
        g["bytes"] += self._spread(dgates, letters, self.BYTES, self.bytes, self.chars, part)
        return float(loss), g

    def _spread(self, dgates: np.ndarray, at: np.ndarray, n: int, x: np.ndarray, layer: BiGRU, grads: dict) -> np.ndarray:
        """The gradient of the n symbols' vectors x from that of the gates at their places."""
        per = np.zeros((2, n, dgates.shape[-1]), np.float32)
        np.add.at(per[0], at.T, dgates[:, 0])
        np.add.at(per[1], at.T[::-1], dgates[:, 1])
        grads["b"] += per.sum(axis=1, keepdims=True)
        grads["wx"] += np.matmul(x.T[None], per)
        return np.matmul(per, layer.p["wx"].transpose(0, 2, 1)).sum(axis=0)

    def tops(self, docs: list[list[bytes]], cache: GateCache, chunk: int = 2048) -> tuple[np.ndarray, np.ndarray]:
        """Each document's highest logit over all its windows, and which window has it."""
        best, where = np.empty(len(docs), np.float32), np.empty(len(docs), np.int64)
        known = np.split(cache.ids([w for d in docs for w in d]), np.cumsum([len(d) for d in docs])[:-1])
        begin = 0
        while begin < len(docs):
            end, size, rows, firsts = begin, 0, [], []
            while end < len(docs) and (end == begin or size + len(starts(len(docs[end]))) <= chunk):
                s = starts(len(docs[end]))
                padded = np.zeros(s[-1] + WINDOW, np.int64)
                padded[: len(known[end])] = known[end]
                rows.append(np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::STRIDE])
                firsts.append(size)
                size += len(s)
                end += 1
            at = np.concatenate(rows)
            logit = np.concatenate([self.logits(cache.gates, at[i : i + chunk]) for i in range(0, len(at), chunk)])
            best[begin:end] = np.maximum.reduceat(logit, firsts)
            for k, (i, j) in enumerate(zip(firsts, [*firsts[1:], size], strict=True)):
                where[begin + k] = np.argmax(logit[i:j])
            begin = end
        cache.trim()
        return best, where

    def score(self, top: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.scale * top.astype(np.float64) + self.shift)))


class _Numbered(dict):
    """Numbers new keys in the order in which they are met."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


class GateCache:
    """The gates of words, worked out when first met. Bounded: once it is full it starts anew after the texts in hand."""

    def __init__(self, net: Network) -> None:
        self.net = net
        self.clear()

    def clear(self) -> None:
        self.at = _Numbered({b"": 0})
        self.gates = np.empty((2, 4096, 3 * self.net.H), np.float32)
        self.gates[:, :1] = self.net.main.project(self.net.vectors([b""]))

    @property
    def full(self) -> bool:
        return len(self.at) > CACHE

    def trim(self) -> None:
        if self.full:
            self.clear()

    def ids(self, words: list[bytes]) -> np.ndarray:
        at = self.at
        n = len(at)
        out = np.fromiter(map(at.__getitem__, words), np.int64, len(words))
        if len(at) > n:
            new = list(islice(reversed(at), len(at) - n))[::-1]
            while self.gates.shape[1] < len(at):
                self.gates = np.concatenate((self.gates, np.empty_like(self.gates)), axis=1)
            by_length = sorted(range(len(new)), key=lambda i: len(new[i]))  # a batch takes as many steps as its longest word
            for i in range(0, len(new), 4096):
                part = by_length[i : i + 4096]
                self.gates[:, n + np.array(part)] = self.net.main.project(self.net.vectors([new[k] for k in part]))
        return out


def train(texts: list[str | None], toxic: list[bool], prior: float, rounds: int = 2, epochs: int = 4, least: int = 280, seed: int = 2) -> Network:
    """A network from labelled texts. A label is of a whole text, so each text is learnt from its most telling window: at first
    the one with the word that is most frequent in toxic texts against others, later the one that the network finds. Each text
    that isn't toxic also gives a window at random. prior: the share of toxic texts among all. A round is `epochs` passes, or as many more as make `least` updates."""
    docs = [tokens(t) for t in texts]
    y = np.array(toxic, bool)
    seen = [Counter(), Counter()]
    for d, t in zip(docs, y, strict=True):
        seen[int(t)].update(set(d))
    both = seen[0] + seen[1]
    vocabulary = [w for w, n in sorted(both.items(), key=lambda x: (-x[1], x[0])) if n > 2][:WORDS]
    bad, good = max(1, y.sum()), max(1, (~y).sum())
    odds = {w: np.log((seen[1][w] + 0.5) / bad) - np.log((seen[0][w] + 0.5) / good) for w in vocabulary}
    net = Network(vocabulary, seed)
    rng = np.random.default_rng(seed)
    best = [max(starts(len(d)), key=lambda s, d=d: max((odds.get(w, 0.0) for w in d[s : s + WINDOW]), default=0.0)) for d in docs]
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.parameters().items()}
    count = 0
    clean = np.flatnonzero(~y)
    epochs = max(epochs, -(-least * 64 // (len(docs) + len(clean))))
    for part in range(rounds):
        if part:
            top, where = net.tops(docs, GateCache(net))
            best = [starts(len(d))[w] for d, w in zip(docs, where, strict=True)]
        for epoch in range(epochs):
            more = [(i, int(rng.choice(starts(len(docs[i]))))) for i in clean]
            items = [*enumerate(best), *more]
            order = rng.permutation(len(items))
            rate = 0.01 * 0.05 ** ((part * epochs + epoch) / (rounds * epochs))
            for k in range(0, len(order), 64):
                batch = [items[j] for j in order[k : k + 64]]
                label = np.array([y[i] for i, _ in batch], np.float32)
                _, g = net.step([docs[i][s : s + WINDOW] for i, s in batch], label, np.ones(len(batch), np.float32))
                count += 1
                for name, p in net.parameters().items():
                    m, v = moments[name]
                    m += 0.1 * (g[name] - m)
                    v += 0.01 * (g[name] ** 2 - v)
                    p -= rate * (m / (1 - 0.9**count)) / (np.sqrt(v / (1 - 0.99**count)) + 1e-6)
    top, _ = net.tops(docs, GateCache(net))
    weight = np.where(y, prior / bad, (1 - prior) / good)
    a, b, x = 1.0, 0.0, top.astype(np.float64)
    for _ in range(400):  # scale and shift of the documents' scores, with a weak pull to scale 1
        p = 1 / (1 + np.exp(-(a * x + b)))
        e = weight * (p - y)
        s = weight * p * (1 - p) + 1e-9
        ga, gb = (e * x).sum() + 1e-3 * (a - 1), e.sum() + 1e-4 * b
        haa, hab, hbb = (s * x * x).sum() + 1e-3, (s * x).sum(), s.sum() + 1e-4
        det = haa * hbb - hab * hab
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        a, b = a - 0.5 * da, b - 0.5 * db
        if abs(da) + abs(db) < 1e-9:
            break
    net.scale, net.shift = max(a, 1e-3), b
    return net


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Network | float:
    """A network from at most `sample` labelled rows of each class, those with the least hash of doc_id, out of those whose remainder
    isn't 0; a constant, the share of toxic rows, if there are fewer than two classes. A doc_id with several labels counts as toxic if
    one of them says so; a null label is none."""
    known = labels.where("toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(crc_mod("doc_id", 5) != 0)
    sizes = {r.toxic: r.n for r in known.groupBy((F.col("toxic") > 0).alias("toxic")).agg(F.count("*").alias("n")).collect()}
    total = sum(sizes.values())
    if len(sizes) < 2:
        return float(sizes.get(True, 0)) / max(1, total)
    order = F.xxhash64(F.lit(5), "doc_id")
    rows = []
    for toxic in (True, False):
        ids = known.where((F.col("toxic") > 0) == toxic).select("doc_id").orderBy(order, "doc_id").limit(sample)
        got = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").orderBy(order, "doc_id", "text").limit(sample).collect()
        rows += [(r.text, toxic) for r in got]
    if len({t for _, t in rows}) < 2:
        return float(sizes[True]) / total
    return train([t for t, _ in rows], [t for _, t in rows], sizes[True] / total)


def score(docs: DataFrame, model: Network | float, name: str = "score") -> DataFrame:
    """docs with the score of its whole text (0 to 1), over all windows. A null text counts as empty, and an empty one is a window
    of padding. A column of docs called `name` gives way."""
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.drop(name)
    schema = StructType([*docs.schema.fields, StructField(name, DoubleType())])
    held = spark.sparkContext.broadcast(model)  # some 100 kB: its size doesn't depend on the rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = held.value
        cache = GateCache(net) if isinstance(net, Network) else None
        for batch in batches:
            if cache is None:
                got = np.full(batch.num_rows, net)
            else:
                got = np.empty(batch.num_rows)
                for i in range(0, batch.num_rows, 128):
                    part = batch.column("text").slice(i, 128).to_pylist()
                    got[i : i + len(part)] = net.score(net.tops([tokens(t) for t in part], cache)[0])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got)], [*batch.schema.names, name])

    return docs.mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, name: str = "score") -> DataFrame:
    """docs with a score for each row. labels: (doc_id, toxic). Repeated rows and null ids are scored like all others; an empty table
    gives an empty result, and without labels of both classes the score is a constant."""
    return score(docs, learn(docs, labels, sample), name)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = toxicity(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return got.select("doc_id", F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
