import gzip
import hashlib
import json

import pytest
from pyspark.errors import PySparkException

from skeinlog.functions.text import SNAPSHOT
from skeinlog.operators import keyed, stores, verify
from skeinlog.sources import state


def put(folder, **files):
    folder.mkdir(parents=True, exist_ok=True)
    for name, text in files.items():
        (folder / name.replace("__", ".")).write_text(text if isinstance(text, str) else json.dumps(text))
    return str(folder)


def test_pool_and_snapshots(spark, tmp_path):
    at = put(tmp_path / "pool", a__json={"stats": {"session_id": "s1"}, "transcript_mtime": "2026-01-02T03:04:05Z"}, b__json={})
    assert {r.session_id for r in state.pool(spark, at).collect()} == {"s1", "b"}
    ids = spark.createDataFrame([("b",)], "session_id string")
    assert state.pool_entries(state.pool(spark, at), ids).count() == 1 and state.pool(spark, str(tmp_path / "none")).count() == 0
    put(tmp_path / "pool", c__json="{bad")
    with pytest.raises(PySparkException, match="malformed: c.json"):
        state.pool(spark, at).collect()
    assert state.latest_snapshot(spark, at).first().name == "b.json" and state.latest_snapshot(spark, str(tmp_path / "none")).first() is None
    put(tmp_path / "truth" / "r", **{"1__json": {"k": 1}, "2__json": "oops"})
    put(tmp_path / "truth" / "global", **{"3__json": {}})
    assert [(r.repo, r.name) for r in state.ground_truth(spark, str(tmp_path / "truth")).collect()] == [("r", "1.json")]
    put(tmp_path / "runs", x__json={"ran_at": "2026-01-02T00:00:00Z"}, y__json={"ran_at": "2026-01-01T00:00:00Z"})
    assert state.latest_run(spark, str(tmp_path / "runs")).first().name == "x.json" and [r.name for r in state.verdicts(spark, str(tmp_path / "runs")).collect()] == ["x.json", "y.json"]


def test_settings_keys_and_patterns(spark, tmp_path):
    at = put(tmp_path / "c", set__yaml="cadence_days: 3\nmin_sessions: -1\n", keys__json='["a", "b", "a"]', odd__json="{", state__json='{"op": 1}', pat__txt="# none\n\nabc+\n", bad__txt="ok\n(")
    assert state.settings(spark, f"{at}/set.yaml") == {"cadence_days": 3, "min_sessions": 10, "due_new_sessions": 10} and state.settings(spark, f"{at}/no.yaml") == state.DEFAULTS
    assert [state.acted_keys(spark, f"{at}/{n}.json").count() for n in ("keys", "odd", "no")] == [2, 0, 0]
    assert [state.run_state(spark, f"{at}/{n}.json").count() for n in ("state", "odd", "no")] == [1, 0, 0]
    assert state.private_patterns(spark, f"{at}/pat.txt") == [("private_3", "(?i)abc+")] and state.private_patterns(spark, f"{at}/no.txt") == []
    with pytest.raises(ValueError, match="line 2"):
        state.private_patterns(spark, f"{at}/bad.txt")


def test_adjudications_and_cards(spark):
    from pyspark.sql import functions as F

    kind = "target string, statement string, session_ids array<string>, rubric_hash string, trigger string, decision string"
    rows = spark.createDataFrame([("t", "S", ["a"], "h", "flip", "accept")], kind)
    hashed = rows.withColumn("key_hash", state.adjudication_key(F.col("target"), F.col("statement"), F.col("session_ids"), F.col("rubric_hash"), F.col("trigger")))
    assert state.adjudications(hashed).first().decision == "accept"
    for odd, why in ((hashed.withColumn("statement", F.lit("T")), "bad key_hash"), (hashed.withColumn("decision", F.lit("maybe")), "bad decision")):
        with pytest.raises(PySparkException, match=why):
            state.adjudications(odd).collect()
    cards = spark.createDataFrame([("ab1", True), ("ab2", True), ("c", False)], "key_hash string, adjudicable boolean")
    assert state.card_by_prefix(cards, "ab1").count() == 1
    for prefix in ("x", "ab", "c"):
        with pytest.raises(ValueError, match=prefix):
            state.card_by_prefix(cards, prefix)


GOOD = "id: t1\npart: regression\ntier: HIGH\nsurface: either\nstatement: s\nrepos: [r]\nanchor_session_ids: [a]\nsource_theme_session_ids: [a, b]\nanchor_theme: r/2\n"


def test_rubrics(spark, tmp_path):
    at = put(tmp_path / "r", a__yaml=GOOD, b__yaml="id: g\npart: gap\ntier: MEDIUM\nsurface: theme\nstatement: s\nrepos: [r]\n", c__yaml="id: n\npart: negative\nstatement: s\n")
    got = {r.id: r for r in state.rubrics(spark, at).collect()}
    assert {k: (r.pass_at, r.status) for k, r in got.items()} == {"t1": ("full", "must_pass"), "g": ("partial", "expected_fail"), "n": ("partial", "must_pass")}
    assert got["t1"].hash == hashlib.sha256(GOOD.encode()).hexdigest()
    statuses = spark.createDataFrame([("t1", "odd")], "id string, status string")
    assert {tuple(r) for r in state.status_gaps(state.rubrics(spark, at), statuses).collect()} == {("t1", "invalid"), ("g", "missing")}
    cases = {"id of another file": GOOD, "unknown fields": GOOD + "odd: 1\n", "anchors outside": GOOD.replace("[a]", "[z]").replace("t1", "x"), "bucket of anchor_theme": GOOD.replace("r/2", "q/2").replace("t1", "x"), "tier": GOOD.replace("HIGH", "HUGE").replace("t1", "x"), "anchors of a gap": GOOD.replace("regression", "gap").replace("t1", "x"), "pass_at": GOOD.replace("t1", "x") + "pass_at: most\n"}
    for why, text in cases.items():
        put(tmp_path / "r", z__yaml=text)
        with pytest.raises(ValueError, match=why):
            state.rubrics(spark, at)
    for folder in (put(tmp_path / "empty"), str(tmp_path / "none")):
        with pytest.raises(ValueError, match="no rubrics"):
            state.rubrics(spark, folder)


def test_frozen(spark, tmp_path):
    put(tmp_path / "f" / "s1" / "subagents" / "deep", **{"agent-1__jsonl": "sub"})
    put(tmp_path / "f" / "s1", **{"agent-2__jsonl": "no parent"})
    (tmp_path / "f" / "s1.jsonl.gz").write_bytes(gzip.compress(b"text"))
    root = str(tmp_path / "f")
    assert [r.parent for r in state.sidechains(spark, root).collect()] == ["s1"]
    sha = hashlib.sha256(b"text").hexdigest()
    manifest = lambda h: spark.createDataFrame([("s1", "s1.jsonl.gz", h)], "id string, path string, sha256 string")
    assert state.frozen(spark, root, manifest(sha)).first().text == "text"
    with pytest.raises(PySparkException, match="s1.jsonl.gz"):
        state.frozen(spark, root, manifest("0")).collect()
    of = lambda *rows: spark.createDataFrame(rows, "id string, mtime int")
    assert {tuple(r) for r in state.frozen_gaps(of(("a", 0), ("b", 0), ("c", 0)), of(("a", 1), ("b", 1)), of(("a", 1), ("b", 2))).collect()} == {("b", "skew"), ("c", "gap")}


def test_sinks(spark, tmp_path):
    folder = str(tmp_path / "s")
    for i in range(12):
        stores.store_snapshot(spark, folder, "{}", f"2026-01-{i + 1:02}T00-00-00Z")
    assert len(list((tmp_path / "s").glob("*.json"))) == 10 and state.latest_snapshot(spark, folder).first().name.startswith("2026-01-12")
    cache = stores.Cache(spark, str(tmp_path / "cache"))
    cache.put("l1", "k", {"b": [1]})
    assert cache.get("l1", "k") == {"b": [1]} and cache.get("l1", "none") is None
    (tmp_path / "cache" / "l1" / ".k.json.crc").unlink(missing_ok=True)
    (tmp_path / "cache" / "l1" / "k.json").write_text("{")
    with pytest.raises(ValueError, match="corrupt entry l1/k"):
        cache.get("l1", "k")
    stores.publish(spark, str(tmp_path / "l"), str(tmp_path / "p"), "v.json", "fine", SNAPSHOT)
    with pytest.raises(ValueError, match="holds: users_path"):
        stores.publish(spark, str(tmp_path / "l"), str(tmp_path / "p"), "w.json", "at /Users/me", SNAPSHOT)
    assert (tmp_path / "l" / "w.json").exists() and not (tmp_path / "p" / "w.json").exists() and (tmp_path / "p" / "v.json").read_text() == "fine"
    at, kind = str(tmp_path / "a"), "session_id string, transcript_mtime int, n int"
    stores.store_analyses(spark.createDataFrame([("a", 1, 1), ("b", 1, 1)], kind), at, buckets=1)
    assert stores.store_analyses(spark.createDataFrame([("a", 2, 2)], kind), at) == 2
    assert {(r.session_id, r.n) for r in keyed.read(spark, at).collect()} == {("a", 2), ("b", 1)}
    cards = spark.createDataFrame([("u", "flip", 3, "", None), ("t", "flip", 2, "do", "why")], "target string, trigger string, level int, text string, note string")
    assert stores.cards_markdown(cards).first().text == "## t — flip\n\n> do\n\nlevel 2\n\nwhy\n\n## u — flip\n\nlevel 3"


def test_adopted_and_escalated(spark):
    assets = spark.createDataFrame([("/h/a", "always  run\ntests")], "path string, content string")
    f = spark.createDataFrame([(1, "yes", "/h/a", "run tests"), (2, "yes", "/h/a", "run all"), (3, "yes", "/h/b", "x"), (4, "yes", None, ""), (5, "no", None, None)], "rank int, adopted string, adopted_path string, adopted_excerpt string")
    assert {r["rank"]: (r.adopted, r.downgraded) for r in verify.adopted(f, assets).collect()} == {1: ("yes", None), 2: ("unknown", "not verbatim"), 3: ("unknown", "unreadable"), 4: ("unknown", "lacking"), 5: ("no", None)}
    rows = [(1, True, "hook", "/h/a", "run\ntests", "2026-01-01"), (2, True, "hook", "/h/a", "run\ntests", "2026-01-02"), (3, True, "habit", "/h/a", "run", "2026-01-01"), (4, True, "hook", "/h/a", "", "2026-01-01"), (5, False, "hook", None, None, None), (6, True, "hook", "/h/a", "tests", None)]
    e = spark.createDataFrame(rows, "rank int, escalated boolean, asset_type string, escalated_path string, escalated_excerpt string, last_seen string")
    dates = spark.createDataFrame([("/h/a", "2026-01-02")], "path string, changed string")
    assert {r["rank"]: r.state for r in verify.escalations(e, assets, dates).collect()} == {1: "removed", 2: "kept", 3: "habit", 4: "lacking", 5: None, 6: "undated"}
    assert {r["rank"]: r.state for r in verify.escalations(e, assets, None).collect()}[1] == "kept"


def test_dropped_and_small_ones(spark):
    from pyspark.sql import functions as F

    ev = spark.createDataFrame([("F1",)], "id string")
    d = spark.createDataFrame([(0, "fine", "ok", ["F1"]), (1, "3 of 4", "ok", ["F9"]), (2, "x", "$HOME", [])], "position int, summary string, reason string, evidence_ids array<string>")
    assert {tuple(r) for r in verify.dropped_violations(d, ev).collect()} == {(1, "quantity"), (1, "dangling"), (2, "no_citation"), (2, "privacy")}
    assert verify.schema_violation(3) is None and verify.schema_violation("3")
    got = spark.range(1).select(verify.tilde(F.lit("see /h/me/x and /h/mean"), "/h/me/"), verify.tilde(F.lit("/h/me"), "/h/me"), verify.model_text(F.lit("x" * 200))).first()
    assert got[0] == "see ~/x and /h/mean" and got[1] == "~" and len(got[2]) == 121
