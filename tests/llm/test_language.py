"""Language identification: code lengths against a plain coder, byte by byte; held-out accuracy; edge cases."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from skeinlog.llm import language
from skeinlog.llm.common import crc_mod


class Plain:
    """The same code from dictionaries: counts of what followed each context of up to ORDER bytes, escapes, exclusions."""

    def __init__(self, texts):
        self.after = defaultdict(Counter)
        for t in texts:
            t = language.START + t
            for i in range(language.ORDER, len(t)):
                for k in range(language.ORDER + 1):
                    self.after[t[i - k : i]][t[i]] += 1

    def bits(self, past, b):
        total, out = 0.0, set()
        for k in range(language.ORDER, -1, -1):
            seen = self.after.get(past[len(past) - k :])
            if not seen:
                continue
            left = {x: n for x, n in seen.items() if x not in out}
            if not left:
                continue
            size = sum(left.values()) + len(left)
            if b in left:
                return total - math.log2(left[b] / size)
            total -= math.log2(len(left) / size)
            out |= set(left)
        return total + math.log2(256 - len(out))

    def length(self, text):
        t = language.START + text
        return sum(self.bits(t[i - language.ORDER : i], t[i]) for i in range(language.ORDER, len(t)))


def tree(texts):
    found, times = np.unique(np.concatenate([language.grams(np.frombuffer(language.START + t, np.uint8)) for t in texts]), return_counts=True)
    return language.Tree(found, times)


TEXTS = [b"the cat sat on the mat", "der Hund läuft über die Straße".encode(), b"", b"aaaa\n\n\naaaab", b"\x00\xff"]


def test_code_lengths(monkeypatch):
    monkeypatch.setattr(language, "PIECE", 7)  # texts lie in several pieces
    rng = np.random.default_rng(1)
    learnt = [b"the dog sat on the log and the cat on the mat", bytes(rng.integers(0, 256, 400).tolist()), b"abab" * 30]
    asked = [*TEXTS, *[bytes(rng.integers(97, 105, 30).tolist()) for _ in range(20)], learnt[0][:20]]
    model = language.Model(["x", "y"], [tree(learnt), tree([learnt[0]])], np.zeros(2, np.int64))
    got = model.lengths(asked) / language.UNIT
    for n, plain in enumerate((Plain(learnt), Plain([learnt[0]]))):
        for i, t in enumerate(asked):
            assert got[i, n] == pytest.approx(plain.length(t), abs=1e-3)


def test_a_proper_code():
    model = tree([b"the dog sat on the log", "größer".encode()])
    for past in (b"the ", b"zzzz", b"\n\n\n\n", "größ".encode()[-4:]):
        grams = np.concatenate([language.grams(np.frombuffer(past + bytes([b]), np.uint8)) for b in range(256)])
        assert np.exp2(-model.bits(grams) / language.UNIT).sum() == pytest.approx(1, abs=1e-4)


def test_held_out(spark):
    sf = "/root/testdata/sf0.01"
    lang = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    got = language.op11_language(spark, sf).join(lang, "doc_id").collect()
    assert len(got) == lang.count() and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert len(held) > 200 and sum(r.lang == r.lang_pred for r in held) >= 0.98 * len(held)
    assert {r.doc_id for r in held} == {r.doc_id for r in lang.where(crc_mod("doc_id", 4) == 2).collect()}


KIND = "doc_id long, text string, lang string, lang_pred int, score string, h long, gram long"


def test_edges(spark, monkeypatch):
    rows = [(1, None, None), (2, "", "en"), (3, " 12 !?", "en"), (4, "the cat and the dog " * 5000, "en"), (5, "der Hund und die Katze", "de"), (5, "der Hund und die Katze", "de"), (None, "the cat", None), (6, "É", "fr")]
    docs = spark.createDataFrame([(*r, 1, "x", 2, 3) for r in rows], KIND)
    model = language.learn(docs)
    assert model.names == ["de", "en", "fr"]
    got = language.identify(docs, model)
    assert set(got.columns) == set(docs.columns)
    by = {(r.doc_id, r.text and r.text[:7]): (r.lang_pred, r.score) for r in got.collect()}
    assert got.count() == len(rows)
    assert by[1, None] == by[2, ""] == by[3, " 12 !?"] == ("und", 0.0)
    assert by[4, "the cat"][0] == by[None, "the cat"][0] == "en" and by[5, "der Hun"][0] == "de" and by[6, "É"][0] == "fr"
    # copies count once in the sample, and its bounds leave each language a text
    twice = language.learn(docs, size=1)
    assert all(len(t.levels[0].edges) for t in twice.trees)
    monkeypatch.setattr(language, "HELD", 0)  # by a shuffle
    again = language.learn(docs)
    assert all((a.levels[-1].edges == b.levels[-1].edges).all() for a, b in zip(model.trees, again.trees, strict=True))
    none = docs.where(F.lit(False))
    assert language.learn(none) is None and language.identify(none, model).count() == 0
    assert {r.lang_pred for r in language.identify(docs, None).collect()} == {"und"}


def test_sums_do_not_depend_on_partitions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = language.learn(docs)
    one, many = (language.identify(docs.repartition(n), model).select("doc_id", "score").collect() for n in (1, 9))
    assert {tuple(r) for r in one} == {tuple(r) for r in many}
