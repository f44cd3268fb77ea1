"""Runs of synthesis over pools: from files to a snapshot, due-ness, refusals that store nothing, and placing without one task a repository."""

import json
import os
import time
from collections import defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from skeinlog.operators import bundles, keyed, synthesis
from skeinlog.sources import state
from skeinlog.streaming import backfill

NOW = datetime(2026, 3, 1, 12, 0, 0)
ALL = synthesis.Options(min_sessions=1, due_new_sessions=1)
ANALYSIS = (
    "session_id string, transcript_mtime timestamp, cwd string, start timestamp, session_type string, outcome string, underlying_goal string, brief_summary string, "
    "friction array<struct<type:string,one_line:string,quote:string,file:string>>, preferences array<struct<rule:string,quote:string>>, assistant_turns long, interrupts long, rejections long, "
    "tool_errors long, skills array<string>, tool_counts map<string,long>, mechanical_friction map<string,long>, mechanical_exemplars map<string,string>, other_error_signatures map<string,long>, "
    "directive_clauses array<struct<norm:string,n:long,first_turn:long,exemplar:string>>"
)


def analysis(name, repo="r", day=1, friction=(), preferences=(), outcome="unclear"):
    at = datetime(2026, 1, day)
    return (name, at, f"/u/Developer/{repo}" if repo else None, at, "single_task", outcome, "goal", "sum", [(*f, None, None)[:4] for f in friction], list(preferences), 5, 0, 0, 0, [], {"Read": day}, {}, {}, {}, [])


def pool(spark, store, rows):
    keyed.merge(spark.createDataFrame(rows, ANALYSIS), f"{store}/pool/analyses", "session_id", "transcript_mtime", 2)


def finding(ids, **more):
    base = dict(rank=1, title="Title", statement="Say", rationale="Why", asset_type="claude_md_rule", asset_target="CLAUDE.md", asset_content="text", audience="user", adopted="no", escalated=False, evidence_ids=ids, quotes=[])
    return base | more


def says(*findings, dropped=()):
    def answer(evidence, _):
        spark = evidence.sparkSession
        rows = spark.read.schema(synthesis.FINDING).json(spark.sparkContext.parallelize([json.dumps(f) for f in findings]))
        return rows, spark.createDataFrame(list(dropped), synthesis.DROPPED)

    return answer


def test_placed_is_a_plain_count(spark):
    rows = [("hot" if i % 3 else f"r{i % 7}", (i * 37) % 50, i) for i in range(900)] + [(None, 1, 1000), (None, 0, 1001)]
    got = bundles.placed(spark.createDataFrame(rows, "k string, o int, i int").repartition(7), ("k",), ("o", "i")).collect()
    want, groups = {}, defaultdict(list)
    for k, o, i in rows:
        groups[k].append((o, i))
    for k, g in groups.items():
        want |= {(k, i): n for n, (_, i) in enumerate(sorted(g), 1)}
    assert {(r.k, r.i): r.n for r in got} == want and len(got) == len(rows)


def test_evidence_and_edges(spark):
    rows = [
        analysis("b", day=2, friction=[("slow", "It was slow", "so very slow today"), ("odd", "Odd", "")], outcome="fully_achieved"),
        analysis("a", day=1, friction=[("slow", "Slow", None)], preferences=[("Use tabs", "please use tabs")]),
        analysis("lost", repo=None, friction=[("slow", "x", "y")]),
        (*analysis("nulls", day=3)[:8], None, None, *analysis("nulls")[10:14], None, None, None, None, None, None),
    ]
    a = spark.createDataFrame(rows, ANALYSIS).withColumns({"repo": F.when(F.col("cwd").isNotNull(), "r"), "extra": F.lit(1), "n": F.lit(9)})
    evidence, heads, dates = synthesis.prepare(a, ALL)
    got = {r.id: r for r in evidence.collect()}
    assert sorted(got) == ["r/F1", "r/F2", "r/F3", "r/P1", "r/S1"]
    assert [(got[f"r/F{n}"].label, got[f"r/F{n}"].quote_pool, got[f"r/F{n}"].session_ids) for n in (1, 2, 3)] == [("slow", [], ["a"]), ("slow", ["so very slow today"], ["b"]), ("odd", [], ["b"])]
    h = heads.first()
    assert (h.sessions, h.friction, h.prefs, h.success, h.signals, h.from_day, h.to_day) == (3, 3, 1, 1, 0, "2026-01-01", "2026-01-03") and h.bytes > 300
    assert dates.count() == 3
    none = synthesis.prepare(a.limit(0), ALL)
    assert [x.count() for x in none] == [0, 0, 0]


def test_signals_are_evidence(spark):
    rows = [analysis(f"s{i}", day=9) for i in range(4)]
    a = spark.createDataFrame(rows, ANALYSIS).withColumn("repo", F.lit("r"))
    g = [r for r in synthesis.prepare(a, ALL)[0].collect() if r.kind == "G"]
    assert [(r.id, r.signal_kind, r.session_ids) for r in g] == [("r/G1", "high_read", ["s0", "s1", "s2", "s3"]), ("r/G2", "unskilled_toil", ["s0", "s1", "s2", "s3"])]


def test_run_stores_what_holds(spark, tmp_path):
    store = str(tmp_path)
    pool(spark, store, [analysis("a", day=3, friction=[("slow", "Slow", "it was so very slow")]), analysis("b", "q", day=5, friction=[("slow", "Slow", "")])])
    files = spark.createDataFrame([("/h/me/r.md", "be  quick about it")], synthesis.ASSETS)
    dated = spark.createDataFrame([("/h/me/r.md", datetime(2026, 1, 4))], synthesis.RULE_DATES)
    held = dict(escalated=True, escalated_path="/h/me/r.md", escalated_excerpt="be quick about it")
    answer = says(
        finding(["r/F1"], rank=1, **held),  # last seen before the rule
        finding(["r/F1", "q/F1"], rank=2, adopted="yes", adopted_path="/h/me/none", adopted_excerpt="x", quotes=["it was so very slow", "never said by them"]),
        finding(["q/F1"], rank=3, **held),
        dropped=[(0, "Left out", "Too thin", ["q/F1"])],
    )
    options = synthesis.Options(min_sessions=1, due_new_sessions=1, home="/h/me")
    out = synthesis.run(spark, store, NOW, answer, options, files, dated)
    assert out == {"due": True, "contributing": ["q", "r"], "repos": 2, "written": 1, "reason": ""}
    doc = json.loads((tmp_path / "synthesis/snapshots/2026-03-01T12-00-00Z.json").read_text())
    assert [(f["rank"], f["repos"], f["sessions"], f["last_seen"], f["adopted"], f["quotes"]) for f in doc["findings"]] == [(1, ["q", "r"], 2, "2026-01-05", "unknown", ["it was so very slow"]), (2, ["q"], 1, "2026-01-05", "no", [])]
    assert doc["findings"][1]["escalated_path"] == "~/r.md" and doc["window"] == {"from": "2026-01-03", "to": "2026-01-05"} and len(doc["dropped"]) == 1
    assert [(n["rank"], n["note"].split(":")[0]) for n in doc["notes"]] == [(1, "removed"), (2, "adopted is unknown"), (2, "quotes dropped")]
    assert not (tmp_path / f"synthesis/diagnostics/{doc['generated_at']}").exists()
    # nothing is new: not due, and neither is it after the cadence without new sessions
    later = synthesis.Options(min_sessions=1, due_new_sessions=1, only_if_due=True)
    assert synthesis.run(spark, store, NOW + timedelta(days=30), answer, later)["written"] == 0
    s = synthesis.status(spark, store, NOW + timedelta(days=30), acted=spark.createDataFrame([("k",), ("k",), (None,)], "key string"), options=later).first()
    assert (s.state, s.last_outcome, s.due_repos, s.acted, json.loads(s.last_run)["status"]) == ("idle", "last run: 1 written", [], 1, "ok")


@pytest.mark.parametrize(
    "bad, why",
    [
        (dict(evidence_ids=["r/F9"]), "1: dangling"), (dict(rank=2), "all: ranks"), (dict(evidence_ids=[]), "1: no_citation"), (dict(asset_type="poem"), "1: asset_type"), (dict(asset_content=""), "1: asset"),
        (dict(asset_type="habit", escalated=True, escalated_path="x", escalated_excerpt="y"), "1: escalated_habit"), (dict(escalated=True, escalated_path="gone", escalated_excerpt="y"), "1: escalation unreadable"),
        (dict(audience="cats"), "1: audience"), (dict(title=" "), "1: title"), (dict(asset_type="new_skill"), "1: grounding"),
    ],
)
def test_run_refuses(spark, tmp_path, bad, why):
    store = str(tmp_path)
    pool(spark, store, [analysis("a", friction=[("slow", "Slow", "q")])])
    out = synthesis.run(spark, store, NOW, says(finding(["r/F1"]) | bad), ALL)
    assert out["written"] == 0 and why in out["reason"] and "diagnostics/2026-03-01T12-00-00Z" in out["reason"]
    assert not (tmp_path / "synthesis/snapshots").exists() and (tmp_path / "synthesis/diagnostics/2026-03-01T12-00-00Z/findings").exists()
    s = synthesis.status(spark, store, NOW, options=ALL).first()
    assert s.state == "error" and s.last_outcome.startswith("last run failed: verification failed: ") and s.due_repos == ["r"]


def test_run_survives_its_synthesizer(spark, tmp_path):
    def fails(*_):
        raise RuntimeError("no answer")

    store = str(tmp_path)
    assert synthesis.run(spark, store, NOW, fails, ALL) | {"reason": ""} == {"due": False, "contributing": [], "repos": 0, "written": 0, "reason": ""}
    pool(spark, store, [analysis("a", friction=[("slow", "Slow", "q")])])
    assert synthesis.run(spark, store, NOW, fails, ALL)["reason"] == "RuntimeError: no answer"
    assert state.run_state(spark, f"{store}/synthesis/run.json").count() == 1


def test_from_files_to_a_snapshot(spark, tmp_path):
    root, store = tmp_path / "in", str(tmp_path / "store")
    for i, word in enumerate(("an error came up here", "fine", "another error came up")):
        lines = [{"type": "assistant", "cwd": "/u/Developer/app", "timestamp": f"2026-01-0{i + 1}T00:00:0{n}Z", "message": {"id": f"m{n}", "content": [{"type": "text", "text": word}], "usage": {"output_tokens": 1}}} for n in range(3)]
        at = root / "p" / f"s{i}.jsonl"
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text("\n".join(map(json.dumps, lines)) + "\n")
        os.utime(at, (time.time() - 9999,) * 2)
    o = backfill.Options(threshold=2, quiet_seconds=60)
    done = [backfill.step(spark, str(root), store, o) for _ in range(2)]
    assert sum(d.get("analysed", 0) for d in done) == 3
    stored = {r.session_id: r for r in keyed.read(spark, f"{store}/pool/analyses").collect()}
    assert {k: len(r.friction) for k, r in stored.items()} == {"s0": 1, "s1": 0, "s2": 1} and not stored["s0"].friction[0].quote_unverified
    out = synthesis.run(spark, store, NOW, options=ALL)
    assert out["written"] == 1 and out["repos"] == 1, out
    doc = json.loads((tmp_path / "store/synthesis/snapshots/2026-03-01T12-00-00Z.json").read_text())
    assert [(f["title"], f["sessions"], f["repos"]) for f in doc["findings"]] == [("Recurring friction: tool_error", 1, ["app"])]


def test_items_read_their_analyses_in_one_pass(spark, monkeypatch):
    seen, placed = [], bundles.placed
    monkeypatch.setattr(bundles, "placed", lambda rows, *a: seen.append(rows) or placed(rows, *a))
    row = ("r", "s", datetime(2026, 1, 1), "fully_achieved", "mixed", "", "done", None, [("be brief", "q")])
    schema = "repo string, session_id string, start timestamp, outcome string, session_type string, underlying_goal string, brief_summary string, friction array<struct<type:string,one_line:string,quote:string,file:string>>, preferences array<struct<rule:string,quote:string>>"
    got = bundles.items(spark.createDataFrame([row, ("r", "t", datetime(2026, 1, 2), None, "mixed", "g", "", [("k", "o", None, "f"), ("k", "p", "", None)], [])], schema))
    assert sorted((r.id, r.label, r.text, len(r.quote_pool)) for r in got.collect()) == [("r/F1", "k", "o", 0), ("r/F2", "k", "p", 0), ("r/P1", None, "be brief", 1), ("r/S1", "mixed", "done", 0)]
    assert "Union" not in seen[0]._jdf.queryExecution().optimizedPlan().toString()
    analyses = spark.createDataFrame([row], schema)
    assert [r.n for r in bundles.items(analyses.limit(0)).collect()] == []
