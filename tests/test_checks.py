"""Edge cases of populations, gates, pseudonyms, shapes, trees and ranks, against plain versions."""

import hashlib
import math
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from skeinlog.functions import schema
from skeinlog.operators import populations, ranks, redact, tier1, trees


def test_meta(spark):
    rows = [("/w/Insights-x", None, None), ("/w", "/r/FACETS", []), ("/w", None, ["other", "analyzing-agent-sessions"]), ("/w", "/r", ["other"]), (None, None, None)]
    df = spark.createDataFrame(rows, "cwd string, repo string, skills array<string>")
    assert [r[0] for r in df.select(populations.is_meta(F.col("cwd"), F.col("repo"), F.col("skills"))).collect()] == [True, True, True, False, False]


def test_reconstructed(spark):
    reports = spark.createDataFrame([("all", 2, "b", "a", 10), ("early", 1, "a", "b", 10), ("wrong", 9, "a", "b", 10), ("none", 0, "a", "b", 10)], "bucket string, analysed long, from_day string, to_day string, generated_at int")
    rows = [("all", "1", 5, False), ("all", "2", 15, True), ("early", "3", 5, False), ("early", "4", 15, False), ("wrong", "5", None, False), ("wrong", "6", 15, False), ("unreported", "7", 1, False)]
    analyses = spark.createDataFrame([(*r, "/w/x/.worktrees/y") for r in rows], "bucket string, session_id string, start int, meta boolean, repo_path string")
    b, m = populations.reconstructed(reports, analyses)
    got = {r.bucket: (r.reconstructed, r.resolved, r.from_day, r.repo_path, r.problem) for r in b.collect()}
    assert got["all"] == (2, True, "a", "/w/x", None) and got["early"][:2] == (1, True) and got["none"] == (0, True, "a", None, None)
    assert got["wrong"][1] is False and got["wrong"][4] == "wrong: reconstructed 2 analyses, report says 9"
    assert {tuple(r) for r in m.collect()} == {("all", "1", True), ("all", "2", False), ("early", "3", True), ("wrong", "5", True), ("wrong", "6", True)}
    assert populations.all_resolved(b).first().resolved is False and populations.all_resolved(b.where("bucket = 'x'")).first().resolved is False


def test_membership_is_cut(spark):
    cards = spark.createDataFrame([("c", "t", f"s{i:02}") for i in range(9)] + [("d", "u", "s1")], "card string, target string, session_id string")
    anchors = spark.createDataFrame([("t", "s00"), ("t", "z"), ("u", "s1")], "target string, session_id string")
    lines = spark.createDataFrame([("s01", "one"), ("z", None)], "session_id string, line string")
    got = {r.card: (r.added, r.missing) for r in populations.membership(cards, anchors, lines).collect()}
    assert got == {"c": (["one", *["(no pool summary)"] * 5, "… and 2 more"], ["(no pool summary)"]), "d": ([], [])}


def test_recomputed_and_differences(spark):
    v = lambda df: df.select("session_id", F.lit("j").alias("judged"), F.parse_json("s").alias("stats"))
    pool = v(spark.createDataFrame([("a", '{"x": 1, "y": {"z": null, "w": [1]}}'), ("b", '{"x": 1}')], "session_id string, s string"))
    facts = v(spark.createDataFrame([("a", '{"x": 1.0, "y": {"w": [2], "n": {}}}'), ("c", "3")], "session_id string, s string"))
    ids = spark.createDataFrame([("a",), ("b",), ("a",)], "session_id string")
    got = {r.session_id: (r.gap, r.s) for r in populations.recomputed(ids, pool, facts).select("session_id", "gap", F.to_json("stats").alias("s")).collect()}
    assert got["b"] == (True, '{"x":1}') and got["a"][0] is False
    with pytest.raises(PySparkException, match="no analysis of q"):
        populations.recomputed(spark.createDataFrame([("q",)], "session_id string"), pool, facts).collect()
    diff = {(r.session_id, r.path): (r.stored, r.fresh) for r in populations.differences(pool, facts, "session_id", "stats").collect()}
    assert diff == {("a", "$.y.z"): ("null", None), ("a", "$.y.w"): ("[1]", "[2]"), ("a", "$.y.n"): (None, "{}"), ("b", "$.x"): ("1", None), ("c", "$"): (None, "3")} | ({("a", "$.x"): ("1", "1.0")} if ("a", "$.x") in diff else {})
    assert populations.differences(pool, pool, "session_id", "stats").count() == 0


def gates(spark, outputs, samples=((0, "k0", True), (1, "k1", True))):
    kind = "key string, checkable long, drops long, leaks long, notes long, downgrades long, empty boolean"
    probes = spark.createDataFrame([("friction", "f", "e1"), ("preference", "p", "e2")], "kind string, id string, evidence_id string")
    cites = lambda *r: spark.createDataFrame(list(r), "sample long, evidence_id string")
    items = spark.createDataFrame([(i, 0, "x", "always run the tests", ["s"], False) for i in (0, 1)], "sample long, ord long, item_id string, text string, session_ids array<string>, dropped boolean")
    s = spark.createDataFrame(list(samples), "sample long, key string, fresh boolean")
    return tier1.gates(s, spark.createDataFrame(outputs, kind), probes, cites((0, "e1"), (1, "e1")), cites((0, "e2")), items)


def test_gates(spark):
    fine = [("k0", 10, 1, 0, 0, 0, False), ("k1", 0, 0, 0, 0, 0, False)]
    r = gates(spark, fine).first()
    assert r.passes and r.reasons == [] and r.fabrication == 0.1 and r.churn == 0.0 and r.fresh_pairs == 1
    assert r.preference_misses == ["p"] and r.friction_misses == [] and r.suppressed == 1 and len(r.warnings) == 2
    r = gates(spark, [("k0", 10, 2, 1, 3, 1, True), fine[1]]).first()
    assert not r.passes and r.reasons == ["sample 0: empty output", "raw fabrication rate 0.200 exceeds 0.15", "1 privacy leak(s) in raw prose"] and len(r.warnings) == 4
    for outputs, why in ((fine[:1], "output missing: k1"), ([*fine, fine[0]], "output stored twice: k0")):
        with pytest.raises(PySparkException, match=why):
            gates(spark, outputs).select("passes").collect()
    r = gates(spark, fine, ()).first()
    assert not r.passes and r.reasons == ["no sample was measured"] and r.churn is None


def test_redacted(spark):
    a = spark.createDataFrame([("anna-lee", "n1", "about anna-lee here"), (None, "n2", "x")], "who string, note string, said string")
    b = spark.createDataFrame([("anna-lee",), ("bob",)], "name string")
    out, manifest = redact.redacted({"a": a, "b": b}, {"a": {"who": "user", "note": "note"}, "b": {"name": "user"}}, "s1")
    assert out["a"].join(out["b"], F.col("who") == F.col("name")).count() == a.join(b, F.col("who") == F.col("name")).count() == 1
    m = {(r.kind, r.name): (r.pseudonym, r.rows) for r in manifest.collect()}
    assert set(m) == {("user", "anna-lee"), ("user", "bob"), ("note", "n1"), ("note", "n2")} and m["user", "anna-lee"][1] == 2
    assert {r.who for r in out["a"].collect()} == {None, m["user", "anna-lee"][0]} and len({p for p, _ in m.values()}) == 4
    assert [tuple(r) for r in redact.left_over(out, manifest).collect()] == [("a", "said", "user", 1)]
    other, _ = redact.redacted({"b": b}, {"b": {"name": "user"}}, "s2")
    assert other["b"].join(out["b"], "name").count() == 0
    assert spark.range(1).select(redact.short_hash(F.lit("s")), redact.base_name(F.lit("/w/a/")), redact.base_name(F.lit(None))).first() == (hashlib.sha256(b"s").hexdigest()[:12], "a", "")


def test_shapes(spark):
    shape = schema.Shape("object", required=True, fields={"n": schema.Shape("number", least=0, most=9), "i": schema.Shape("integer"), "l": schema.Shape("array", least=1, each=schema.Shape("boolean", required=True))})
    rows = ['{"n": 10, "l": []}', '{"n": -0.5, "i": 1.5}', '{"n": 3, "l": [true, null, "x"]}', '{"l": {}}', "null", '"x"', "{}"]
    got = [r[0] for r in spark.createDataFrame([(r,) for r in rows], "r string").select(schema.errors(F.parse_json("r"), shape)).collect()]
    assert got == [["$.n: too large", "$.l: too small"], ["$.n: too small", "$.i: not a integer"], ["$.l[1]: missing", "$.l[2]: not a boolean"], ["$.l: not a array"], ["$: missing"], ["$: not a object"], []]


def plain_tree(files):
    def of(prefix):
        names = {}
        for p, d in files.items():
            if p.startswith(prefix):
                rest = p[len(prefix) :]
                names.setdefault(rest.split("/")[0], []).append((rest, d))
        parts = {}
        for name, inner in sorted(names.items()):
            digest = inner[0][1] if inner[0][0] == name else of(f"{prefix}{name}/")
            parts.setdefault(hashlib.sha256(name.encode()).hexdigest()[:2], []).append(f"{name}\0{digest}\0")
        out[prefix.rstrip("/")] = hashlib.sha256("".join(hashlib.sha256("".join(v).encode()).hexdigest() for _, v in sorted(parts.items())).encode()).hexdigest()
        return out[prefix.rstrip("/")]

    out = dict(files)
    of("")
    return out


def test_trees(spark):
    files = {"a/b/c.txt": "1", "a/b/d.txt": "2", "a/e": "3", "f": "4", **{f"m/{i}": str(i) for i in range(300)}}
    at = lambda f: trees.tree_hashes(spark.createDataFrame(list(f.items()), "path string, digest string"))
    before = at(files)
    assert {r.path: r.digest for r in before.collect()} == plain_tree(files) and {r.path: r.files for r in before.collect()}[""] == len(files)
    after = at({k: "9" if k == "a/b/d.txt" else v for k, v in files.items() if k != "f"} | {"g": "5"})
    assert {(r.path, r.state) for r in trees.changed(before, after).collect()} == {("", "changed"), ("a", "changed"), ("a/b", "changed"), ("a/b/d.txt", "changed"), ("f", "removed"), ("g", "added")}
    assert trees.tree_hashes(before.select("path", "digest").where("false")).count() == 0
    for odd in ({"a": "1", "a/b": "2"}, {"/".join("x" * 70): "1"}):
        with pytest.raises(PySparkException, match="twice: a|too deep"):
            at(odd).collect()


@pytest.mark.parametrize("share", [0.0, 0.5, 0.9, 1.0])
def test_ranks(spark, share):
    rnd = random.Random(3)
    rows = [("one", 1.5)] + [("same", 2.0)] * 7 + [("wide", rnd.choice([1, -1]) * 10 ** rnd.uniform(-300, 300)) for _ in range(200)] + [("close", 1 + i * 2**-52) for i in range(50)] + [("ties", float(rnd.randint(0, 3))) for _ in range(99)]
    rows += [(None, float(i)) for i in range(5)] + [("same", None)]
    got = {r.k: (r.n, r.x) for r in ranks.nearest_rank(spark.createDataFrame(rows, "k string, x double"), "k", "x", share, cells=4).collect()}
    for k in ("one", "same", "wide", "close", "ties", None):
        v = sorted(x for kk, x in rows if kk == k and x is not None)
        assert got[k] == (len(v), v[max(1, math.ceil(share * len(v))) - 1])
