"""Alignment of tokenizers against whole-text encoding and a walk over intervals; edge cases."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from skeinlog.llm import alignment


@pytest.fixture(scope="module")
def pair():
    return alignment.Pair(alignment.TOKENIZERS)


def spans(tokens):
    out, at = [], 0
    for t in tokens:
        out.append((at, at + len(t)))
        at += len(t)
    return out


def plain(pair, texts):
    """doc_id, text -> the query's columns: each text encoded whole, all intervals compared in order."""
    rows, links = [], []
    for key, t in texts:
        row, mine = [0, 0, 0, 0, ""], []
        a = pair.a.encode(" " + t, add_special_tokens=False).ids if t else []
        b = pair.b.encode(t) if t else []
        x, y = [pair.a_bytes[i] for i in a], [pair.b_bytes[i] for i in b]
        if t and b"".join(x) == b"".join(y) == (" " + t).encode():
            x, y = spans(x), spans(y)
            groups, i, j = [], 0, 0
            for end in sorted({e for _, e in x} & {e for _, e in y}):
                i2 = next(k for k in range(i, len(x)) if x[k][1] == end) + 1
                j2 = next(k for k in range(j, len(y)) if y[k][1] == end) + 1
                groups.append(",".join(map(str, a[i:i2])) + "|" + ",".join(map(str, b[j:j2])))
                mine += [(a[p], b[q]) for p in range(i, i2) for q in range(j, j2) if x[p][0] < y[q][1] and y[q][0] < x[p][1]]
                i, j = i2, j2
            row = [len(a), len(b), len(groups), len(mine), hashlib.sha256(";".join(groups).encode()).hexdigest()]
        rows.append((key, row))
        links.append(mine)
    count = Counter(x for m in links for x in m)
    best = Counter()
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    return [(k, *r[:4], sum(count[x] == best[x[1]] for x in m), sum(count[x] for x in m), r[4]) for (k, r), m in zip(rows, links, strict=True)], len(count)


def test_op12(spark, small, pair):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    want, _ = plain(pair, [(r.doc_id, r.text) for r in docs.collect()])
    assert sorted(map(tuple, alignment.op12_alignment(spark, small).collect())) == sorted(want)


ROWS = [
    (1, None),
    (2, ""),
    (3, " "),
    (4, "\n\n  a \n  b\t c   "),
    (5, "<|endoftext|> </s> <unk> don't we'll  x"),
    (6, "a▁b lost"),  # B gives a space back
    (7, "Straße 日本語 👩‍👩‍👧 é\x00\x1c \x1d  　 end"),
    (8, "supercalifragilistic " * 3000 + "x" * 20_000),
    (9, "same text"),
    (9, "same text"),
    (None, "same text"),
    (10, "no_space" * 50 + "\r\n" * 9),
]


@pytest.mark.parametrize("bound", [0, 20, 1 << 20])
def test_edges(spark, pair, monkeypatch, bound):
    monkeypatch.setattr(alignment, "TOGETHER", 30)
    docs = spark.createDataFrame([(*r, 1, [2], "c") for r in ROWS], "doc_id long, text string, n_a int, a array<int>, groups_sha256 string")
    want, pairs = plain(pair, ROWS)
    assert pairs > 20 and [w[1:] for w in want if w[0] in (1, 2, 6)] == [(0, 0, 0, 0, 0, 0, "")] * 3
    order = lambda rows: sorted(map(tuple, rows), key=lambda r: (r[0] is None, r[0] or 0))
    assert order(alignment.alignments(docs, bound=bound).collect()) == order(want)
    assert alignment.alignments(docs.where(F.lit(False)), bound=bound).count() == 0


def test_index():
    a, b = np.array([2, 5, 9, 10]), np.array([1, 2, 3, 7, 10])
    first, after, border = alignment.overlaps(a, b)
    assert list(zip(first, after, strict=True)) == [(0, 2), (2, 4), (3, 5), (4, 5)] and border.tolist() == [False, True, False, False, True]


@pytest.mark.parametrize("end", [" ", "  ", "\n ", "\t", " \n"])
def test_white_space_at_the_end(pair, end):
    texts = [f"a word{end}", f"x.{end}", end, f"a word{end}y"]
    want, _ = plain(pair, list(enumerate(texts)))
    got = zip(*[c.to_pylist() for c in alignment.align(pair, texts)[:5]], strict=True)
    assert list(got) == [(*w[1:5], w[7]) for w in want] and all(w[1] for w in want)
