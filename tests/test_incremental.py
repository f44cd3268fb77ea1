import datetime as dt
import json

import pandas as pd
from pyspark.sql import functions as F

from skeinlog.operators import judge, verify
from skeinlog.streaming import incremental


def at(h):
    return dt.datetime(2024, 1, 1, h)


def test_plan(spark):
    refs = spark.createDataFrame([(s, p, at(m)) for s, p, m in [("a", "insights-x", 1), ("b", "p", 5), ("c", "p", 6), ("d", "p", 5), ("e", "p", 5), ("f", "p", 11), ("g", "p", 5)]], "session_id string, project_dir string, mtime timestamp")
    pool = spark.createDataFrame([("b", at(5)), ("c", at(5))], "session_id string, mtime timestamp")
    ledger = spark.createDataFrame([("d", at(5), "gated", 5, 1), ("e", at(5), "gated", 5, 1), ("e", at(5), "errored", 5, 2), ("g", at(5), "gated", 4, 1)], incremental.LEDGER)
    got = {r.session_id: r["class"] for r in incremental.plan(refs, pool, ledger, "2024-01-01 12:00:00", 5, 7200).collect()}
    assert got == {"a": "meta", "b": "incremental", "c": "process", "d": "gate", "e": "process", "f": "quiet", "g": "process"}
    forced = {r["class"] for r in incremental.plan(refs, pool, ledger, "2024-01-01 12:00:00", 5, 7200, force=True).collect()}
    assert forced == {"meta", "process"}


def test_memo(spark):
    stored = spark.createDataFrame([("k1", "old")], "h string, v string")
    keys = spark.createDataFrame([("k1",), ("k2",)], "h string")
    all_, fresh = incremental.memo(keys, stored, "h", lambda df: df.withColumn("v", F.lit("new")))
    assert {tuple(r) for r in all_.collect()} == {("k1", "old"), ("k2", "new")} and fresh.count() == 1


def test_stream(spark, tmp_path):
    root = tmp_path / "in"
    (root / "p").mkdir(parents=True)
    write = lambda name, kinds: (root / "p" / name).write_text("\n".join(json.dumps({"type": k}) for k in kinds) + "\n")
    write("s1.jsonl", ["user", "assistant", "user"])
    write("agent-2.jsonl", ["user"])
    run = lambda: incremental.stream_counts(spark, str(root), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    run()
    write("s2.jsonl", ["user"])
    run()
    got = spark.read.parquet(str(tmp_path / "out")).groupBy("session_id", "type").agg(F.sum("n").alias("n")).collect()
    assert {(r.session_id, r.type, r.n) for r in got} == {("s1", "user", 2), ("s1", "assistant", 1), ("s2", "user", 1)}


def test_windows(spark):
    rows = [(dt.datetime(2024, 1, 1, 0, m), "view", u) for m, u in [(1, 1), (2, 1), (29, 2), (31, 1)]]
    got = incremental.windowed_activity(spark.createDataFrame(rows, "ts timestamp, event_type string, user_id long")).collect()
    assert sorted((r.start.minute, r.n, r.users) for r in got) == [(0, 3, 2), (30, 1, 1)]


def test_judge(spark):
    rows = spark.createDataFrame([("a", "fine"), ("b", "an error")], "session_id string, text string")
    assert {r.session_id: r.outcome for r in judge.judged(rows).collect()} == {"a": "fully_achieved", "b": "partially_achieved"}

    def breaks(texts: pd.Series) -> list[dict]:
        if any("error" in t for t in texts):
            raise ValueError("no")
        return judge.by_rule(texts)

    got = {r.session_id: (r.outcome, r.error) for r in judge.judged(rows, breaks).collect()}
    assert got == {"a": ("fully_achieved", None), "b": (None, "ValueError: no")}


FINDING = "rank int, title string, statement string, rationale string, asset_type string, audience string, adopted string, escalated boolean, evidence_ids array<string>, quotes array<string>"
EVIDENCE = "id string, kind string, signal_kind string, repo string, session_ids array<string>, quote_pool array<string>"


def check(spark, **change):
    good = {"rank": 1, "title": "t", "statement": "s", "rationale": "r", "asset_type": "claude_md_rule", "audience": "both", "adopted": "no", "escalated": False, "evidence_ids": ["alpha/P1", "beta/P1"], "quotes": ["always run the tests", "short", "never\nspoken of at all"]}
    f = spark.createDataFrame([tuple((good | change).values())], FINDING)
    e = spark.createDataFrame([("alpha/P1", "P", None, "alpha", ["s1", "s2"], ["please always run  the tests first"]), ("beta/P1", "P", None, "beta", ["s1"], []), ("alpha/G1", "G", "high_read", "alpha", ["s1"], []), ("alpha/G2", "G", "retyped_directives", "alpha", ["s1"], [])], EVIDENCE)
    return f, e


def test_verify(spark):
    rules = lambda **c: {r.rule for r in verify.violations(*check(spark, **c)).collect()}
    assert rules() == set()
    assert rules(rank=2) == {"ranks"} and rules(title=" ") == {"title"} and rules(adopted="maybe") == {"adopted"}
    assert rules(evidence_ids=[]) == {"no_citation"} and rules(evidence_ids=["alpha/P9"]) == {"dangling"}
    assert rules(evidence_ids=["alpha/G1"]) == {"grounding"} and rules(asset_type="hook", evidence_ids=["alpha/G1"]) == set()
    assert rules(asset_type="new_skill", evidence_ids=["alpha/G1"]) == {"grounding"} and rules(asset_type="new_skill", evidence_ids=["alpha/G2"]) == set()
    assert rules(asset_type="habit", escalated=True) == {"escalated_habit"} and rules(audience="all") == {"audience"}
    assert rules(statement="seen in 3 sessions") == {"quantity"} and rules(statement="see $HOME/x") == {"privacy"}
    assert rules(asset_type="hook", evidence_ids=["alpha/G1"], audience="martians") == {"audience"} and rules(asset_type="hook", evidence_ids=["alpha/G1"], audience="") == set()


def test_recount_and_quotes(spark):
    f, e = check(spark)
    dates = spark.createDataFrame([("alpha", "s1", "2026-06-01"), ("alpha", "s2", "2026-06-05"), ("beta", "s1", "2026-06-11")], "repo string, session_id string, day string")
    r = verify.recounted(f, e, dates).first()
    assert (r.repos, r.sessions, r.last_seen) == (["alpha", "beta"], 3, "2026-06-11")
    q = verify.quotes(f, e).first()
    assert (q.kept, q.dropped) == (["always run the tests"], 2)
