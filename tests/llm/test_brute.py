"""The queries against brute-force versions, over whole tables."""

import hashlib
import json
import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from skeinlog.llm import mixing, neardup, queries, shards, toxicity, warc
from skeinlog.llm.common import written
from skeinlog.llm.components import components

SPACES = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark, small):
    return {r.doc_id: r for r in spark.read.parquet(f"{small}/documents.parquet").collect()}


def run(spark, small, name):
    return {r[0]: r for r in queries.queries()[name](spark, small).collect()}


def test_op1(spark, small, docs):
    word = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    where = defaultdict(set)
    for r in spark.read.parquet(f"{small}/benchmark.parquet").collect():
        w = word.findall((r.text or "").encode().lower())
        for k in range(max(1, len(w) - 9) if w else 0):
            where[tuple(w[k : k + 10])].add(str(r.item_id))
    got = run(spark, small, "op1_decontaminate")
    for i, d in docs.items():
        w = word.findall((d.text or "").encode().lower())
        hit, items = set(), set()
        for k in range(len(w)):
            if found := where.get(tuple(w[k : k + 10])):
                hit |= set(range(k, k + 10))
                items |= found
        r = got[i]
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (len(w), len(hit), len(items), bool(hit))
        assert r.items_sha256 == hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def shingle_sets(texts):
    out = {}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        out[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    return out


def classes(sets):
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(i for i in sets if sets[i])
    for n, i in enumerate(ids):
        for j in ids[:n]:
            a, b = sets[i], sets[j]
            if min(len(a), len(b)) * 100 >= 75 * max(len(a), len(b)):
                c = len(a & b)
                if 100 * c >= 75 * (len(a) + len(b) - c):
                    x, y = find(i), find(j)
                    root[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


def test_op3(spark, small, docs):
    sets = shingle_sets({i: d.text for i, d in docs.items()})
    want = classes(sets)
    got = run(spark, small, "op3_neardup")
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()} == {i: (len(sets[i]), want[i], want[i] == i) for i in sets}


def test_op3_chains(spark):
    """A group of near copies that are not all linked to the smallest, so that classes hang together by chains."""
    rng = np.random.default_rng(3)
    base = [f"w{k}" for k in range(120)]
    texts = {}
    for i in range(150):
        w = list(base)
        for k in rng.choice(120, int(rng.integers(0, 6)), replace=False):
            w[k] = f"x{i}_{k}"
        texts[i] = " ".join(w)
    d = spark.createDataFrame([(1000 - i, t) for i, t in texts.items()], "doc_id long, text string")
    want = classes(shingle_sets({1000 - i: t for i, t in texts.items()}))
    assert {r.doc_id: r.component_id for r in neardup.near_duplicates(d).collect()} == want


def test_components(spark):
    links = [(i, i + 1) for i in range(1, 60)] + [(100, 50), (200, 201), (300, 300)] + [(500, k) for k in range(501, 600)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {got[i] for i in range(1, 61)} == {1} and got[100] == 1 and got[201] == 200 and got[599] == 500 and 300 not in got


def test_bars_are_worked_out_once():
    """Blocks are many, and each asks for them."""
    assert neardup.bars() is neardup.bars()


def test_posterior_bars():
    from math import comb

    for n, least in zip(range(32, 289, 32), neardup.bars(), strict=True):
        grid = (np.arange(2000) + 0.5) / 2000
        p = grid + (1 - grid) / 256
        post = lambda m: (lambda l: l[grid >= 0.75].sum() / l.sum())(float(comb(n, m)) * p**m * (1 - p) ** (n - m))  # noqa: B023,E731
        assert post(least) >= neardup.MISS * 0.9 and (least == 0 or post(least - 1) < neardup.MISS * 1.1)


def test_op4(spark, small, docs):
    got = run(spark, small, "op4_mixing")
    size = {i: len(SPACES.findall(d.text or "")) for i, d in docs.items()}
    total = Counter()
    for i, d in docs.items():
        total[d.source] += size[i]
    names = sorted(total, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    left, open_, target = sum(total.values()), set(names), {}
    while open_:
        w = sum(weight[s] for s in open_)
        full = [s for s in open_ if left * weight[s] / w > 3 * total[s]]
        if not full:
            target |= {s: left * weight[s] / w for s in open_}
            break
        for s in full:
            target[s] = 3 * total[s]
            open_.discard(s)
        left = sum(total.values()) - sum(target.values())
    taken = Counter()
    for i, r in got.items():
        s = docs[i].source
        assert (r["size"], r.source_size) == (size[i], total[s]) and math.isclose(r.target, target[s], rel_tol=1e-9) and r.taken <= 3 * size[i]
        taken[s] += r.taken
    largest = {s: max(size[i] for i in docs if docs[i].source == s) for s in names}  # ten documents a source: no subset may come nearer
    assert all(abs(taken[s] - target[s]) <= max(0.02 * target[s], largest[s] / 2) for s in names)
    again = run(spark, small, "op4_mixing")
    assert again == got


def test_op4_probabilities(spark):
    """Over many seeds a document is in the sample as often as its rate says."""
    d = spark.createDataFrame([(i, "w " * 10, "a" if i < 200 else "b") for i in range(400)], "doc_id long, text string, source string")
    n = Counter()
    for seed in range(3):
        for r in mixing.pareto_mix(d, weights=(3, 1), seed=seed).collect():
            n[r.source] += r.copies
    assert (n["a"], n["b"]) == (3 * 300, 3 * 100)


def test_op5(spark, small, docs):
    got = run(spark, small, "op5_mixlm")
    words = {i: [*(d.text or "").encode().lower().split(), b""] for i, d in docs.items()}
    c = Counter(w for i, x in words.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in x)
    n, v = sum(c.values()), len(c)
    for i, w in words.items():
        r = got[i]
        base = sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(c[x] > 0 for x in w), n)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and r.score < 0
        assert r.held_out == (zlib.crc32(str(i).encode()) % 7 == 2)


def plain_scores(texts, learn, model):
    """The score of each text by loops over tokens and bits, with dicts for all counts; symbols, tables and weights are the model's."""
    from skeinlog.llm import mixlm

    mask = (1 << 64) - 1

    def mix(x):
        x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & mask
        x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & mask
        return x ^ (x >> 31)

    def gate(depth, x, y):
        sure = lambda v: (abs(v) > 0.1) + (abs(v) > 1) + (abs(v) > 3)
        return int(depth) + 4 * sure(x) + sure(y)

    hashed = lambda w: xxhash.xxh3_64_intdigest(w)
    docs = [mixlm.tokens(t) for t in texts]

    def cut(d):
        """(begin, end, the four words before) of each segment."""
        begins, four = [], []
        for t in range(len(d)):
            w = tuple(d[t - k] if t >= k else b"" for k in (1, 2, 3, 4))
            c = 0
            for x in w:
                c = ((c + hashed(x)) * int(mixlm._C)) & mask
            if t == 0 or (mix(c ^ 0xA5A5) >> 33) % mixlm.SPAN == 0:
                begins.append(t)
                four.append(w)
        return list(zip(begins, [*begins[1:], len(d)], four, strict=True))

    def counted(d):
        c = Counter(d)
        c.update(zip([b"", *d], d, strict=False))
        c.update(("from", w) for w in [b"", *d[:-1]])
        c.update(("class", int(mixlm.classes(w)[0])) for w in d if w not in model.ids)
        for a, b, four in cut(d):
            c["four", four] += 1
            c["segment", four, tuple(d[a:b])] += 1
        return c

    total = Counter()
    for d, l in zip(docs, learn, strict=True):
        if l:
            total.update(counted(d))

    def spell(w):
        out, history = 0.0, []
        for s in [*w, 256]:
            contexts, h = [], 0
            for k in range(1, 5):
                h = (h * 263 + (history[-k] + 1 if len(history) >= k else 0)) & mask
                contexts.append(mix((h + (k << 40)) & mask) & ~511)
            for k in range(model.bytes.start[s], model.bytes.start[s + 1]):
                here = int(model.bytes.nodes[k]) * int(mixlm._C)
                x = [float(t[((c + here) * 0xBF58476D1CE4E5B9 & mask) >> (64 - b)]) for t, c, b in zip(model.tables[1], contexts, mixlm.BYTE_BITS, strict=True)]
                g = model.weights[1][gate(model.bytes.gate[k], x[1], x[-1])]
                z = sum(a * b for a, b in zip(g, [*x, 1.0], strict=True))
                out -= math.log1p(math.exp((1 - 2 * int(model.bytes.bits[k])) * z))
            history.append(s)
        return out

    def decided(part, history, share, of, rest):
        ones = sum(history)
        x = [math.log((ones + 0.5) / (len(history) - ones + 0.5)), (history[-1] * 2 - 1) if history else 0, 1.0]
        z = sum(a * b for a, b in zip(model.weights[part][min(int(math.log2(of)), mixlm.LEVELS - 1)], x, strict=True))
        p = 1 / (1 + math.exp(-z))
        history.append(int(share > 0))
        return math.log(p * share + (1 - p) * math.exp(rest)) if share else math.log(1 - p) + rest

    out = []
    for d, l in zip(docs, learn, strict=True):
        live = Counter(total)
        if l:
            live.subtract(counted(d))
        wide = len(model.weights[0][0])
        moved, error = np.zeros((4, wide)), np.zeros((4, wide))
        turn, few, logs, syms, often, pairs = 0, [], [], [], [], []
        for t, w in enumerate(d):
            now = t // mixlm.PACE if t < mixlm.LATER else mixlm.LATER // mixlm.PACE + (t - mixlm.LATER) // mixlm.SLOW
            if now != turn:
                moved, error, turn = moved + error * np.array([*[mixlm.TURN] * (wide - 1), mixlm.RATE]), np.zeros((4, wide)), now
            c = int(mixlm.classes(w)[0])
            s = model.ids.get(w, len(model.words) + c if live[w] > 0 else model.new)
            none = model.new + 1
            one = syms[-1] if t else none
            f = [*few[::-1], model.few - 1, model.few - 1][:2]
            suffix = int(mixlm.classes(d[t - 1])[0]) % 32 if t and syms[-1] != model.new else 32
            two = mix(one * (model.new + 2) + (syms[-2] if t > 1 else none)) % mixlm.PAIRS
            rows = [0, one, f[0] * 33 + suffix, two, f[0] * model.few + f[1]]
            lp = 0.0
            for k in range(model.code.start[s], model.code.start[s + 1]):
                x = [float(tab[r * (model.code.n - 1) + model.code.nodes[k]]) for tab, r in zip(model.tables[0], rows, strict=True)]
                g, cell = gate(model.code.gate[k], x[1], x[-1]), int(model.code.gate[k]) >> 4
                x = np.array([*x, 1.0])
                p = 1 / (1 + math.exp((1 - 2 * int(model.code.bits[k])) * float(((model.weights[0][g] + moved[cell]) * x).sum())))
                error[cell] += (1 - 2 * int(model.code.bits[k])) * (p - 1) * x
                lp += math.log(p)
            if len(model.words) <= s < model.new:
                lp += math.log(live[w] / live["class", c])
            elif s == model.new:
                lp += spell(w)
            before = d[t - 1] if t else b""
            if live["from", before] > 0:
                lp = decided(2, pairs, live[before, w] / live["from", before], live["from", before], lp)
            logs.append(lp)
            syms.append(s)
            if s < model.few - 1:
                few.append(s)
            live[w] += 1
            live[before, w] += 1
            live["from", before] += 1
            if w not in model.ids:
                live["class", c] += 1
        whole, again = 0.0, []
        for a, b, four in cut(d):
            rest, of = sum(logs[a:b]), live["four", four]
            whole += decided(3, again, live["segment", four, tuple(d[a:b])] / of, of, rest) if of else rest
            live["four", four] += 1
            live["segment", four, tuple(d[a:b])] += 1
        out.append(whole / math.log(10))
    return out


def test_op5_score_is_that_of_plain_loops(spark, monkeypatch):
    """Every part of the score, from the decisions to the counts without the text itself, against loops, with several blocks."""
    from skeinlog.llm import mixlm

    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{x}" for x in rng.zipf(1.4, n) % 400) for n in (0, 1, 7, 60, 300, 40, 700, 25, 90, 33)] + ["ünseen wörds here w1 w1 w1 w2", None]
    texts += [texts[4], texts[5], texts[4][:300]]
    learn = [i % 5 != 3 for i in range(len(texts))]
    seen = []
    first = mixlm._scorer
    monkeypatch.setattr(mixlm, "_scorer", lambda held: seen.append(held.value) or first(held))
    d = spark.createDataFrame([(i, t, l) for i, (t, l) in enumerate(zip(texts, learn, strict=True))], "doc_id long, text string, learn boolean").repartition(2, "doc_id")
    got = {r.doc_id: r.score for r in mixlm.score_texts(d, F.col("learn"), top=40, block=400).collect()}
    want = plain_scores(texts, learn, seen[0])
    for i, w in enumerate(want):
        assert math.isclose(got[i], w, rel_tol=2e-4, abs_tol=1e-3), (i, got[i], w)


def test_op5_codes_are_distributions():
    """The symbols' probabilities add up to one in any context; so do those of short spellings, nearly."""
    from skeinlog.llm import mixlm

    m = mixlm.Model([b"ab", b""], [80, 40], np.arange(mixlm.CLASSES), 200, 4, 2, 40)
    rng = np.random.default_rng(1)
    m.tables = [[rng.normal(size=r * (m.code.n - 1)).astype(np.float32) for r in m.rows], [rng.normal(size=1 << b).astype(np.float32) for b in mixlm.BYTE_BITS]]
    x = [t[: m.code.n - 1][m.code.nodes] for t in m.tables[0]]
    s = sum(a * b for a, b in zip(x, m.weights[0][0], strict=False))
    which, at = m.code.expand(np.arange(m.code.n))
    assert math.isclose(np.exp(np.bincount(which, np.log(mixlm._p(s, m.code.sign))[at])).sum(), 1, rel_tol=1e-4)
    one = [bytes([x]) for x in range(256)]
    assert 0 < np.exp(mixlm.spelling(m, [*one, *[a + b for a in one for b in one]])).sum() <= 1 + 1e-5
    counts = rng.integers(0, 9, (3, m.code.n))
    by = m.code.by_node(counts).reshape(3, m.code.n - 1, 2)
    want = np.zeros_like(by)
    for sym in range(m.code.n):
        for k in range(m.code.start[sym], m.code.start[sym + 1]):
            want[:, m.code.nodes[k], m.code.bits[k]] += counts[:, sym]
    assert (by == want).all()


def test_op5_beats_the_base(spark):
    got = queries.queries()["op5_mixlm"](spark, "/root/testdata/sf0.01").where("held_out").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    assert got[0] > 0.9 * got[1] and got[2] > 50_000


def test_op5_knows_copies_and_orders(spark):
    """A learnt order costs less than another, and that less than new words; of learning texts, those that occur twice cost least."""
    from skeinlog.llm import mixlm

    texts = [" ".join(f"k{i}x{j}" for j in range(60)) for i in range(20)]
    rows = [(n, texts[n % 20]) for n in range(100)] + [(500, " ".join(f"k{i}x3" for i in range(200, 260))), (501, " ".join(f"m{i}x3" for i in range(200, 260)))]
    rows += [(1000, texts[3]), (1001, " ".join(reversed(texts[3].split()))), (1002, " ".join(f"k{i}x3" for i in range(100, 160)))]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.score for r in mixlm.score_texts(d, F.col("doc_id") < 1000).collect()}
    assert got[1000] > 0.2 * got[1001] and got[1001] > 0.9 * got[1002]
    assert got[3] > 0.2 * got[500]


def test_op5_packed_arrays():
    from skeinlog.llm import mixlm

    for a in (np.array([], np.uint32), np.array([1, 2**40, 3], np.uint64), np.array([-1, 5], np.int64), np.arange(1000, dtype=np.uint32)):
        b = mixlm.unpack(mixlm.pack(a))
        assert b.dtype == a.dtype and b.tolist() == a.tolist()
    assert mixlm._small(np.array([2**33])).tolist() == [2**33]  # counts beyond 32 bits are kept


def test_op5_learning_leaves_held_out_texts_alone():
    """Only learning texts are gone over while the decisions on shares learn; the steps are those of all entries, cut at the same places."""
    from skeinlog.llm import mixlm

    rng = np.random.default_rng(5)
    n = 3 * mixlm.STEP + 17
    doc = np.sort(rng.integers(0, 300, n))
    learn = rng.random(300) < 0.6
    of, logp = rng.integers(0, 40, n), -10 * rng.random(n)
    count = np.where(rng.random(n) < 0.4, (of * rng.random(n)).astype(np.int64), 0)
    first = [np.tile([0.1, 0.0, -1.0], (mixlm.LEVELS, 1))] * 4
    learner = mixlm.Learner(first)
    got = mixlm.blend(first[0], logp, count, of, doc, learner, mixlm.PAIR, learn[doc])
    np.testing.assert_array_equal(got[~learn[doc]], logp[~learn[doc]])

    weights, bend = first[0].copy(), np.zeros((mixlm.LEVELS, 3, 3))  # by plain loops
    at = np.flatnonzero(of > 0)
    before: dict[int, list[bool]] = {}
    for a in range(0, len(at), mixlm.STEP):
        slope, seen, w = np.zeros((mixlm.LEVELS, 3)), 0, weights.copy()
        for t in at[a : a + mixlm.STEP].tolist():
            if not learn[doc[t]]:
                continue
            past = before.setdefault(doc[t], [])
            y, ones = bool(count[t] > 0), sum(past)
            x = np.array([math.log((ones + 0.5) / (len(past) - ones + 0.5)), 0 if not past else 1 if past[-1] else -1, 1])
            g = min(int(math.log2(of[t])), mixlm.LEVELS - 1)
            p = 1 / (1 + math.exp(-x @ w[g]))
            yes = p * count[t] / of[t]
            both = yes + (1 - p) * math.exp(logp[t])
            assert math.isclose(got[t], math.log(both), rel_tol=1e-4, abs_tol=1e-4)
            slope[g] += (yes / both - p) * x
            bend[g] += 4 * p * (1 - p) * np.outer(x, x) * (seen % 4 == 0)
            seen += 1
            past.append(y)
        weights += np.clip(np.linalg.solve(bend + mixlm.HOLD * np.eye(3), slope[..., None])[..., 0], -1, 1)
    np.testing.assert_allclose(learner.weights[mixlm.PAIR], weights, rtol=1e-3, atol=1e-4)


def test_op5_words_of_a_shard():
    """A shard's totals are summed over lists of words that stay in Arrow; the end is the empty word, alone or among others."""
    from skeinlog.llm import mixlm

    for words in ([b""], [b"a", b"", b"b\xc3\xa4"], [b"", b"a"], [b"long" * 1000, b""]):
        joined = b"\n".join(words)
        assert mixlm.words_of(len(joined).to_bytes(8, "little") + pa.compress(joined, codec="zstd", asbytes=True)).to_pylist() == words
    rows = [(0, [b"a", b""], [3, 2]), (1, [b"", b"new", b"a"], [1, 0, 4]), (2, [b""], [5])]
    pack = lambda words: len(b"\n".join(words)).to_bytes(8, "little") + pa.compress(b"\n".join(words), codec="zstd", asbytes=True)
    batch = pa.RecordBatch.from_pylist([{"block": b, "shard": 0, "kind": 0, "data": pack(w), "counts": mixlm.pack(np.array(n, np.uint32))} for b, w, n in rows])
    out = [r for b in mixlm._totals(5)([batch]) for r in b.to_pylist()]
    assert [mixlm.unpack(r["data"]).tolist() for r in out if r["kind"] == 0] == [[7, 8], [8, 0, 7], [8]]
    assert {r["shard"]: r["n"] for r in out if r["kind"] == mixlm.STATS and r["shard"] < 0} == {-1: 2, -2: 0}
    assert [(r["data"], r["n"]) for r in out if r["kind"] == mixlm.FREQUENT] == [(b"", 8), (b"a", 7)]


def test_op5_adapts_in_short_texts(monkeypatch):
    """A symbol that a text repeats gets cheaper within its first 160 tokens; the texts beside don't matter."""
    from skeinlog.llm import mixlm

    m = mixlm.Model([b"a", b"b", b"c", b""], [1600, 300, 100, 5], np.zeros(mixlm.CLASSES, np.int64), 2005, 4, 0, 40)
    m.tables[0] = [mixlm.odds(m.code.by_node(np.tile(np.array([1600, 300, 100, 5, *[0] * (mixlm.CLASSES + 1)]), (r, 1)))) for r in m.rows]

    def cost(*docs):
        size = np.array([len(d) for d in docs])
        words = b"\n".join(m.words)
        ids = np.array([m.words.index(w) for d in docs for w in d], np.uint32)
        b = mixlm.Block(mixlm.pack(ids), mixlm.pack(size), mixlm.pack(np.zeros(len(docs), np.uint8)), len(words).to_bytes(8, "little") + pa.compress(words, codec="zstd", asbytes=True))
        got = b.known(m, np.array([1600, 300, 100, 5]), np.zeros(len(np.unique(b.keys(40)[0])), np.int64))
        b = mixlm.Ready(got | {"size": mixlm.pack(size), "learn": mixlm.pack(np.zeros(len(docs), np.uint8))}, m)
        return np.bincount(b.doc, mixlm.tree(m, b, b.contexts(m)), len(docs))

    def later():
        c = {n: cost([b"c"] * n)[0] for n in (8, 80, 160)}
        assert math.isclose(cost([b"a"] * 300, [b"c"] * 80)[1], c[80], rel_tol=1e-5)
        return (c[160] - c[80]) / ((c[80] - c[8]) * 80 / 72)

    assert later() < 0.97
    monkeypatch.setattr(mixlm, "RATE", 0)
    assert later() < 0.99


def test_op6_and_op9(spark, small, docs):
    got, found = run(spark, small, "op6_quality"), run(spark, small, "op9_secrets")
    assign = re.compile(r"""(?ia)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    for i, d in docs.items():
        t = d.text or ""
        w = SPACES.findall(t)
        win = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        c = Counter(win)
        cover = {p for k, x in enumerate(win) if c[x] > 1 for p in range(k, k + 5)}
        seen, dup = set(), 0
        for line in t.split("\n"):
            if SPACES.search(line):
                dup += line in seen
                seen.add(line)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(cover))
        assert r.base_failed == (len(w) < 10 or 100 * len(cover) > 20 * len(w)) and not (r.kept and r.base_failed)
        spans = [(m.start(), 0, "assign", m.end()) for m in assign.finditer(t) if len(m[2]) >= 8]
        spans += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
        spans += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
        want = ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(spans))
        s = found[i]
        assert s.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert (s.n_assign, s.n_access, s.n_hex) == tuple(sum(x[1] == k for x in spans) for k in range(3))
        assert set(want.split(",")) - {""} <= set(s.spans.split(","))


def test_op6_kept(spark, small, docs):
    """The verdict of the policy, worked out from the text in plain loops."""
    got = run(spark, small, "op6_quality")
    for i, d in docs.items():
        t, r = d.text or "", got[i]
        w = SPACES.findall(t)
        lines = [x for x in t.split("\n") if SPACES.search(x)]
        chars, alpha = sum(map(len, w)), sum(1 for x in w if x.encode()[0] > 64 or x.encode()[-1] > 64)
        bad = chars < 2 * len(w) or chars > 20 * len(w) or 10 * r.n_symbols > len(w) or 10 * r.n_dup_lines > 3 * len(lines) or 10 * alpha < 6 * len(w)
        assert r.kept == (not r.base_failed and not bad), i


def test_op6_keeps_clean(spark, small):
    got = run(spark, small, "op6_quality")
    good = [r.doc_id for r in spark.read.parquet(f"{small}/labels.parquet").where("quality = 1").collect()]
    base_ok = [i for i in good if not got[i].base_failed]
    assert sum(got[i].kept for i in base_ok) >= 0.97 * len(base_ok)


def test_op10(spark, small, docs):
    got = run(spark, small, "op10_sharding")
    assert set(got) == set(docs)
    load, n = Counter(), Counter()
    for i, r in got.items():
        data = (docs[i].text or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(data) + 8, zlib.crc32(data), "bytes", None) and 0 <= r.shard < 24
        load[r.shard] += r["size"]
    for s in set(r.shard for r in got.values()):
        assert sorted(r.slot for r in got.values() if r.shard == s) == list(range(sum(r.shard == s for r in got.values())))
    mean = sum(load.values()) / 24
    longest = max(r["size"] for r in got.values())
    assert all(abs(load[s] - mean) <= longest for s in range(24))


def test_op10_hot_text(spark):
    """A text that a third of all rows share is cut by doc_id, and the shards stay equal."""
    d = spark.createDataFrame([(i, "same text" if i % 3 == 0 else f"text {i:06d}") for i in range(6000)], "doc_id long, text string")
    load = Counter()
    for r in shards.histogram_sort(d, shards=6).collect():
        load[r.shard] += r["size"]
    assert max(load.values()) <= 1.02 * min(load.values())


@pytest.mark.parametrize("name", ["op7_warc", "op8_chat"])
def test_oracles(spark, small, name):
    db = duckdb.connect()
    for t in ("pages", "conversations"):
        db.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    got = queries.queries()[name](spark, small)
    cols = sorted(got.columns)
    want = db.sql(queries.oracle_sql()[name])
    assert sorted(want.columns) == cols
    assert Counter(map(tuple, got.select(*cols).collect())) == Counter(map(tuple, db.sql(f"select {', '.join(cols)} from ({queries.oracle_sql()[name]})").fetchall()))


def test_zip_is_readable_by_others(spark, small, tmp_path):
    """Python's own reader finds the same members in a package."""
    import zipfile

    at = f"file://{tmp_path}/p"
    manifest = warc.write_packages(spark.read.parquet(f"{small}/pages.parquet"), at)
    name = manifest.first().name
    with zipfile.ZipFile(f"{tmp_path}/p/{name}") as z, open(f"{tmp_path}/p/{name}", "rb") as f:
        assert z.testzip() is None
        mine = warc.directory(f, f.seek(0, 2))
        assert [(m.name, m.size, m.crc) for m in mine] == [(i.filename, i.file_size, i.CRC) for i in z.infolist()]
        index = z.read(warc.INDEX_MEMBER).decode().splitlines()
        entry = json.loads(index[0].split(" ", 2)[2])
        data = z.read(warc.WARC_MEMBER)
        assert data[entry["offset"] :][: entry["length"]].startswith(b"WARC/1.1\r\n")


def test_zip_of_others(tmp_path):
    """Packages with a comment and without ZIP64 fields are read as well; a compressed member is refused by name."""
    import zipfile

    path = tmp_path / "x.zip"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("a.txt", "hello", zipfile.ZIP_STORED)
        z.writestr("b.txt", "hello" * 100, zipfile.ZIP_DEFLATED)
        z.comment = b"PK\x05\x06 inside of a comment"
    with open(path, "rb") as f:
        a, b = warc.directory(f, f.seek(0, 2))
        at = warc.data_start(f, a)
        f.seek(at)
        assert f.read(a.size) == b"hello"
        with pytest.raises(ValueError, match="b.txt"):
            warc.data_start(f, b)


def test_gradients():
    net = toxicity.Network([b"a", b"bc", b"the"])
    batch = [[b"a", b"zz", b"the"], [b"bc", b"xyz"] * 5, []]
    y, w = np.array([1, 0, 1], np.float32), np.ones(3, np.float32)
    _, g = net.step(batch, y, w)
    for name, p in net.parameters().items():
        i = np.unravel_index(np.argmax(np.abs(g[name])), p.shape)
        old = p[i]
        p[i] = old + 0.01
        up = net.step(batch, y, w)[0]
        p[i] = old - 0.01
        down = net.step(batch, y, w)[0]
        p[i] = old
        assert math.isclose((up - down) / 0.02, g[name][i], rel_tol=0.02, abs_tol=2e-5), name


def test_windows_cover_all_words():
    for n in (0, 1, 31, 32, 33, 52, 53, 1000):
        assert {k for s in toxicity.starts(n) for k in range(s, s + toxicity.WINDOW)} >= set(range(n))


def test_op2_held_out(spark):
    """Learnt on sf0.1's labels, the network finds held-out toxic documents and leaves clean ones alone."""
    big = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{big}/labels.parquet")
    held = (F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 5) == 0
    docs = spark.read.parquet(f"{big}/documents.parquet").join(labels, "doc_id")
    net = toxicity.learn(docs.select("doc_id", "text"), labels, sample=300)
    rows = toxicity.score(docs.where(held), net).select("toxic", "score").collect()
    right = {t: [(r.score >= 0.5) == bool(t) for r in rows if r.toxic == t] for t in (0, 1)}
    assert np.mean(right[1]) > 0.8 and np.mean(right[0]) > 0.97


def test_pipeline(spark, small, docs):
    """Each stage against a brute-force version over what it was given."""
    frame = spark.read.parquet(f"{small}/documents.parquet").withColumn("size", F.lit("mine"))
    columns, before, kept = frame.columns, dict(docs), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        frame = written(stage(spark, frame, small), "stage")
        assert frame.columns == columns, name
        rows = frame.collect()
        assert all(tuple(r)[:-1] == tuple(before[r.doc_id])[: len(columns) - 1] and r["size"] == "mine" for r in rows), name
        kept[name] = (before, Counter(r.doc_id for r in rows))
        before = {r.doc_id: r for r in rows}
    _, left = kept["toxicity"]
    calls = run(spark, small, "op2_toxicity")
    assert set(left) == {i for i, r in calls.items() if r.score < 0.5} and set(left.values()) == {1}
    given, left = kept["near-duplicates"]
    same = classes(shingle_sets({i: d.text for i, d in given.items()}))
    assert left == Counter(i for i in given if same[i] == i)
    given, left = kept["decontamination"]
    word = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    runs = lambda x: {tuple(w[k : k + 10]) for w in [word.findall((x or "").encode().lower())] for k in range(max(1, len(w) - 9) if w else 0)}
    bad = {w for r in spark.read.parquet(f"{small}/benchmark.parquet").collect() for w in runs(r.text)}
    assert all(len(w) == 10 for w in bad)
    assert left == Counter(i for i, d in given.items() if not runs(d.text) & bad)
    given, left = kept["mixing"]
    size = {i: len(SPACES.findall(d.text or "")) for i, d in given.items()}
    drawn = {i: r["target"] for i, r in ((r.doc_id, r) for r in mixing.pareto_mix(spark.createDataFrame([(i, d.text, d.source) for i, d in given.items()], "doc_id long, text string, source string")).collect())}
    for s in {d.source for d in given.values()}:
        ids = [i for i, d in given.items() if d.source == s]
        assert all(left[i] <= 3 for i in ids)
        assert abs(sum(left[i] * size[i] for i in ids) - drawn[ids[0]]) <= max(0.02 * drawn[ids[0]], max(size[i] for i in ids) / 2), s
    final = corpus_pipeline.STAGES[-1][1](spark, frame, small).collect()
    assert Counter(r.doc_id for r in final) == left
    slots = defaultdict(list)
    for r in final:
        slots[r.shard].append(r.slot)
    assert set(slots) <= set(range(24)) and all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_pipeline_run(spark, tmp_path):
    """run() over nulls, empty and long texts, repeated rows and exact copies; and over an empty table."""
    labels = "doc_id long, quality int, toxic int"
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    plain = [f"plain words about topic {i} and the things that go with it in lot {i * 7}" for i in range(40)]
    rows = [(i, t, "en", f"s{i % 2}", len(t)) for i, t in enumerate(plain)] + [(90, None, None, None, None), (91, "", "en", None, 0), (92, "long " * 50_000, "en", "s0", 250_000), (93, plain[3], "en", "s1", 1)]
    truth = [(i, 1, int(i % 10 == 0)) for i in range(40)]
    bench = [(1, "completely other words that no document has in such an order at all")]
    for name, data, schema in (("documents", rows, kind), ("labels", truth, labels), ("benchmark", bench, "item_id long, text string")):
        spark.createDataFrame(data, schema).write.parquet(str(tmp_path / "a" / f"{name}.parquet"))
        spark.createDataFrame([], schema).write.parquet(str(tmp_path / "b" / f"{name}.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path / "a")).collect()
    ids = {r.doc_id for r in got}
    assert ids and 93 not in ids and ids <= {r[0] for r in rows}
    assert corpus_pipeline.run(spark, str(tmp_path / "b")).count() == 0
