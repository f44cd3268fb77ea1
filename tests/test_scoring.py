import json

import pytest

from skeinlog.operators import detect, facts, reduce, scoring
from skeinlog.sources import transcripts

RUBRIC = "target string, part string, tier string, status string, pass_at int, anchors array<string>, cap int, rubric_hash string"
MATCH = "target string, sample int, repeat int, item_id string, granularity int, nuances array<boolean>, forbidden array<int>"
ITEM = "sample int, item_id string, text string, session_ids array<string>, dropped boolean, reason string"
GRID = "target string, sample int, repeat int"


def rubric(target, status="must_pass", tier="HIGH", pass_at=3, anchors=("a", "b")):
    return (target, "regression", tier, status, pass_at, list(anchors), 0, "h")


def chain(spark, rubrics, matches, items, repeats=1, samples=1, decisions=(), before=()):
    """(repeats, verdicts) by target."""
    r, m, i = spark.createDataFrame(rubrics, RUBRIC), spark.createDataFrame(matches, MATCH), spark.createDataFrame(items, ITEM)
    adj = spark.createDataFrame(list(decisions), "key_hash string, decision string")
    grid = spark.createDataFrame([(x[0], s, k) for x in rubrics for s in range(samples) for k in range(repeats)], GRID)
    out = scoring.repeat_outcomes(scoring.judged(m, i, r, adj), grid)
    verdicts = scoring.target_verdicts(r, scoring.sample_outcomes(out), adj, spark.createDataFrame([(b,) for b in before], "target string"))
    return out, verdicts


def test_best_match_decides(spark):
    items = [(0, "finding/1", "one", ["a"], False, None), (0, "finding/2", "two", ["a", "b"], False, None), (0, "dropped/0", "gone", ["a"], True, "no"), (0, "finding/3", "far", ["z"], False, None)]
    got, _ = chain(spark, [rubric("t"), rubric("f"), rubric("none")], [
        ("t", 0, 0, "finding/1", 3, [True, False], []), ("t", 0, 0, "finding/2", 2, [True, True], []), ("t", 0, 0, "dropped/0", 3, [True, True], []), ("t", 0, 0, "finding/3", 3, [True, True], []),
        ("f", 0, 0, "finding/2", 3, [True], []), ("f", 0, 0, "finding/1", 3, [True], [0]), ("f", 0, 0, "dropped/0", 2, [True], [0]),
    ], items)
    got = {r.target: r for r in got.collect()}
    assert (got["t"].level, got["t"].item_id, got["t"]["class"]) == (2, "finding/2", "corroborated")  # a failed nuance: full is partial
    assert {(s["item_id"], s["class"]) for s in got["t"].sides} == {("dropped/0", "dropped"), ("finding/3", "anchor_mismatch")}
    assert (got["f"].level, got["f"].item_id) == (1, "finding/2")  # one forbidden form caps the target, its item stays
    assert (got["none"].level, got["none"].item_id, got["none"].sides) == (0, None, [])


def test_accepted_mismatch_counts_and_accepted_drop_does_not(spark):
    items = [(0, "finding/1", "Far  Away", ["z"], False, None), (0, "dropped/0", "gone", ["a"], True, "no")]
    matches = [("t", 0, 0, "finding/1", 3, [], []), ("d", 0, 0, "dropped/0", 3, [], [])]
    first, _ = chain(spark, [rubric("t"), rubric("d")], matches, items)
    assert {r.target: r.level for r in first.collect()} == {"t": 0, "d": 0}
    keys = scoring.judged(spark.createDataFrame(matches, MATCH), spark.createDataFrame(items, ITEM), spark.createDataFrame([rubric("t"), rubric("d")], RUBRIC)).select("key_hash").collect()
    again, verdicts = chain(spark, [rubric("t"), rubric("d")], matches, items, decisions=[(k[0], "accept") for k in keys])
    assert {r.target: r.level for r in again.collect()} == {"t": 3, "d": 0}
    assert "adjudication_applied" in {t["type"] for t in verdicts.where("target = 't'").first().triggers}


def test_key_ignores_case_space_and_order(spark):
    rows = spark.createDataFrame([("t", " A  b", ["y", "x"]), ("t", "a B", ["x", "y", "x"]), ("t", "a b", ["x"]), ("u", "a b", ["x"]), ("t", None, None)], "t string, s string, i array<string>")
    from pyspark.sql import functions as F

    keys = [r[0] for r in rows.select(scoring.adjudication_key(F.col("t"), F.col("s"), F.col("i"), F.lit("h"), F.lit("flip"))).collect()]
    assert keys[0] == keys[1] and len(set(keys)) == 4 and all(keys)


def test_statuses_and_empty_samples(spark):
    rubrics = [rubric("high"), rubric("low", tier="MEDIUM"), rubric("part", "expected_partial"), rubric("gap", "expected_fail"), rubric("again", "needs_reconfirmation"), rubric("off", "invalidated")]
    empty = spark.createDataFrame([], GRID)
    r = spark.createDataFrame(rubrics, RUBRIC)
    none = scoring.sample_outcomes(scoring.repeat_outcomes(scoring.judged(spark.createDataFrame([], MATCH), spark.createDataFrame([], ITEM), r), empty))
    got = {v.target: (v.level, v.passes, v.meets, v.hard_fail) for v in scoring.target_verdicts(r, none).collect()}
    assert got == {"high": (0, False, False, True), "low": (0, False, False, False), "part": (0, False, False, True), "gap": (0, False, True, False), "again": (0, False, True, False)}
    assert [t.target for t in scoring.invalidated(r).collect()] == ["off"]  # left out of verdicts and rates


def test_first_pass_without_anchors_waits(spark):
    items, matches = [(s, "finding/1", "do it", ["a"], False, None) for s in range(3)], [("t", s, 0, "finding/1", 3 if s else 2, [], []) for s in range(3)]
    _, v = chain(spark, [rubric("t", anchors=())], matches, items, samples=3)
    v = v.first()
    assert (v.level, v.passes, v.provisional, v.meets, v.hard_fail) == (3, False, True, False, False)
    types = {t["type"]: t for t in v.triggers}
    assert set(types) == {"first_pass_no_anchor", "sample_split"} and types["sample_split"]["samples"] == [0]
    key = types["first_pass_no_anchor"]["key_hash"]
    _, v = chain(spark, [rubric("t", anchors=())], matches, items, samples=3, decisions=[(key, "accept")])
    assert v.first().passes
    _, v = chain(spark, [rubric("t", anchors=())], matches, items, samples=3, before=["t"])
    assert v.first().passes


def test_flips_and_effective_outcomes(spark):
    items = [(0, "finding/1", "do it", ["a", "b"], False, None)]
    _, good = chain(spark, [rubric("t"), rubric("u")], [("t", 0, 0, "finding/1", 3, [], [])], items)
    _, bad = chain(spark, [rubric("t"), rubric("u")], [("u", 0, 0, "finding/1", 3, [], [])], items)
    assert {r.target: r.flip for r in scoring.flips(good, None).collect()} == {"t": "none", "u": "baseline_miss"}
    moved = scoring.flips(good, bad)
    got = {r.target: (r.flip, r.passes, r.provisional) for r in moved.collect()}
    assert got == {"t": ("flip", False, True), "u": ("flip", False, False)}
    key = next(t["key_hash"] for t in moved.where("target = 't'").first().triggers if t["type"] == "flip")
    adj = spark.createDataFrame([(key, "accept")], "key_hash string, decision string")
    assert scoring.flips(good, bad, adj).where("target = 't'").first().passes
    assert scoring.effective(moved, adj).where("target = 't'").first().passes and not scoring.effective(moved).where("target = 't'").first().passes
    assert {(r.target, r.pass_changed) for r in scoring.delta(good, bad).collect()} == {("t", True), ("u", True)}
    marks = spark.createDataFrame([("t", 1)], "target string, watermark int")
    assert scoring.depth_regressions(good, marks).collect()[0][1:] == (0, 1)


def test_decided(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([([2, 2],), ([1, 2],), ([],)], "v array<int>").select(scoring.decided(F.col("v"), 3)).collect()
    assert [r[0] for r in rows] == [True, False, False]


def test_churn_and_same_practice(spark):
    rows = [
        (0, "finding/1", 0, "run the tests before each commit", ["a", "b"], False), (0, "finding/2", 1, "name branches by ticket", ["c"], False), (0, "dropped/0", 2, "run the tests before each commit", ["a"], True),
        (1, "finding/1", 0, "run the tests before each commit", ["z"], False), (1, "finding/2", 1, "run the tests before each commit", ["a"], False), (2, "finding/1", 0, "other words", ["a"], False),
    ]
    items = spark.createDataFrame(rows, "sample int, item_id string, ord int, text string, session_ids array<string>, dropped boolean")
    fresh = spark.createDataFrame([(0, True), (1, True), (2, False)], "sample int, fresh boolean")
    assert [tuple(r) for r in scoring.membership_churn(items, fresh).collect()] == [(0, 1, 0.75)]  # of equal matches the later one counts
    assert [tuple(r) for r in scoring.same_practice(items).collect()] == [("1", "finding/1", "finding/2")]


def test_recall_and_drops(spark):
    signals = spark.createDataFrame([("r", "G1", 3), ("r", "G2", 2)], "repo string, id string, magnitude int")
    friction = spark.createDataFrame([("r", "F1"), ("r", "F2"), ("q", "F1")], "repo string, id string")
    clusters = spark.createDataFrame([(1, "r/P1"), (1, "r/P2"), (1, "q/P1"), (2, "q/P2")], "cluster int, evidence_id string")
    probes = scoring.recall_probes(signals, friction, clusters)
    assert {(r.kind, r.id) for r in probes.collect()} == {("opportunity", "r/G1"), ("friction", "r"), ("friction", "q"), ("preference", "q/P1,r/P1,r/P2")}
    cites = spark.createDataFrame([(0, "r/F2"), (1, "r/G1")], "sample int, evidence_id string")
    drops = spark.createDataFrame([(0, 0, "r/G1"), (0, 1, "r/F2"), (1, 0, "x")], "sample int, position int, evidence_id string")
    state = scoring.recall(probes, cites, drops, (0, 1))
    got = {(r.sample, r.kind, r.id): r.state for r in state.collect()}
    assert got[0, "friction", "r"] == "cited" and got[0, "opportunity", "r/G1"] == "suppressed" and got[0, "friction", "q"] == "miss" and got[1, "opportunity", "r/G1"] == "cited" and len(got) == 8
    cards = {(r.sample, r.position): r.floors for r in scoring.unengaged_drops(drops, cites, state, probes).collect()}
    assert cards == {(0, 0): ["opportunity floor r/G1"], (1, 0): []}


def test_quotes_policy(spark):
    said = spark.createDataFrame([("s", "please use tabs everywhere", "please use tabs everywhere\nthe  build is broken again")], "session_id string, user_text string, all_text string")
    rows = spark.createDataFrame([("s", "use tabs everywhere"), ("s", "build is broken again"), ("s", "tabs"), ("s", ""), ("x", "use tabs everywhere")], "session_id string, quote string")
    fr = {(r.session_id, r.quote, r.quote_unverified) for r in scoring.valid_quotes(rows, said, False).collect()}
    assert fr == {("s", "use tabs everywhere", False), ("s", "build is broken again", False), ("s", "", True), ("s", "", False), ("x", "", True)}
    assert [r.quote for r in scoring.valid_quotes(rows, said, True).collect()] == ["use tabs everywhere"]


def test_probes(spark):
    reads = spark.createDataFrame([("recall", 0, 2), ("recall", 1, 0), ("recall", 2, 3), ("negative_recall", 0, 0), ("near_miss", 0, 2)], "probe string, repeat int, level int")
    assert {r.probe: r.passes for r in scoring.probe_results(reads).collect()} == {"recall": True, "negative_recall": False, "near_miss": False}


def test_scored_items(spark):
    found = spark.createDataFrame([(0, 1, "T", "S", ["q1", "q2", "q3"], ["r/F1", "gone"])], "sample int, rank int, title string, statement string, quotes array<string>, evidence_ids array<string>")
    drops = spark.createDataFrame([(0, 0, "D", "why", ["q/G1", "r/F1"])], "sample int, position int, summary string, reason string, evidence_ids array<string>")
    ev = spark.createDataFrame([("r/F1", "r", ["b", "a"]), ("q/G1", "q", ["a", "c"])], "id string, repo string, session_ids array<string>")
    got = {r.item_id: r for r in scoring.scored_items(found, drops, ev).collect()}
    assert (got["finding/1"].text, got["finding/1"].session_ids, got["finding/1"].quotes) == ("T. S", ["a", "b"], ["q1", "q2"])
    assert (got["dropped/0"].dropped, got["dropped/0"].session_ids, got["dropped/0"].repos) == (True, ["a", "b", "c"], ["q", "r"])


def line(kind, content, ts, **message):
    return json.dumps({"type": kind, "timestamp": f"2026-06-01T10:{ts}Z", "cwd": "/w/a", "gitBranch": "main", "message": {"role": kind, "content": content, **message}})


@pytest.fixture(scope="module")
def decoded(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("t")
    (root / "p").mkdir()
    use = {"usage": {"input_tokens": 1}, "model": "m1"}
    rows = [
        line("user", "always run the linter first please. ok", "00:00"),
        line("assistant", [{"type": "text", "text": " sure "}, {"type": "thinking", "thinking": "hm"}, {"type": "tool_use", "name": "Agent", "input": {"subagent_type": "scout", "description": "d"}}, {"type": "tool_use", "name": "Read", "input": {"path": "x/y", "limit": 3}}], "00:10", id="1", **use),
        line("user", [{"type": "tool_result", "is_error": True, "content": "File has not been read yet. Read it first"}, {"type": "text", "text": "always run the linter first please"}], "00:20"),
        line("user", [{"type": "tool_result", "is_error": True, "content": "The user doesn't want to proceed with this tool use. the user said: no force"}], "00:30"),
        line("assistant", [{"type": "tool_use", "name": "Bash", "input": {}}], "01:40", id="2", **(use | {"model": "m0"})),
    ]
    (root / "p" / "0123456789.jsonl").write_text("\n".join(rows))
    return transcripts.lines(spark, str(root))


def test_reduced(spark, decoded):
    f = facts.session_facts(decoded)
    row = f.first()
    assert row.model_mix == {"m0": 1, "m1": 1} and row.subagent_types == ["scout"] and row.mechanical_exemplars == {"edit_before_read": "File has not been read yet. Read it first"}
    assert [(c["norm"], c["n"], c["first_turn"]) for c in row.directive_clauses] == [("always run the linter first please", 2, 1)]
    got = reduce.reduced(decoded, f).first()
    want = [
        "Session: 01234567", "Title: (none)", "Project: /w/a   Branch: main", "Duration: 2 min   Models: m0,m1", "User turns: 2   Assistant turns: 2   Tool errors: 1   Interrupts: 0   Rejections: 1",
        "Top tools: Agent=1, Bash=1, Read=1", "---", "[User]: always run the linter first please. ok", "[Assistant]: sure", "[Thinking]: hm", "[Tool: Agent scout]", "[Tool: Read x/y]",
        "[ToolError]: File has not been read yet. Read it first", "[User]: always run the linter first please", "[Rejected]: no force", "[Tool: Bash]",
    ]
    assert got.text.split("\n") == want and (got.kept, got.dropped, got.chars) == (9, 0, len(got.text))


def test_reduced_to_a_budget(spark, decoded):
    got = reduce.reduced(decoded, facts.session_facts(decoded), 1).first()
    assert (got.kept, got.dropped) == (4, 5) and got.text.endswith("---\n[reduction: kept 4/9 events; 5 lower-priority assistant events dropped to fit budget]")
    assert "[Assistant]" not in got.text and "[Rejected]: no force" in got.text


def test_signals(spark):
    cols = "repo string, session_id string, start int, tool_counts map<string,bigint>, interrupts int, rejections int, tool_errors int, assistant_turns int, session_type string, skills array<string>, mechanical_friction map<string,bigint>, mechanical_exemplars map<string,string>, other_error_signatures map<string,bigint>"
    s = [("r", f"s{i}", 9 - i, {"Read": 5}, 0, 0, 0, 4, "single_task" if i else "mixed", [], {"wrong_cwd": 1, "other": 2} if i < 3 else None, {"wrong_cwd": f"at {i}"}, {f"e{i % 2}": 1, "z": 1}) for i in range(4)]
    c = [("r", f"s{i}", 9 - i, "please run all of the tests" + " now" * (i % 2), 2, 2 if i < 3 else 0, "Please run") for i in range(3)] + [("r", "s0", 9, "only two sessions say so", 1, 0, "x"), ("r", "s1", 8, "only two sessions say so", 1, 0, "x")]
    got = {r.kind: r for r in detect.signals(spark.createDataFrame(s, cols), spark.createDataFrame(c, "repo string, session_id string, start int, norm string, n int, first_turn int, exemplar string")).collect()}
    assert {k: (v.id, v.magnitude) for k, v in got.items()} == {"high_read": ("G1", 4), "unskilled_toil": ("G2", 3), "mechanical_friction": ("G3", 3), "retyped_kickoffs": ("G4", 3)}
    assert got["high_read"].sessions == ["s3", "s2", "s1", "s0"]  # by start
    assert got["mechanical_friction"].detail == ["wrong_cwd — at 2", "residual signatures: z; e0; e1"] and got["retyped_kickoffs"].detail == ["Please run"]


def test_counted_sides_are_those_listed(spark):
    from pyspark.sql import functions as F

    items = [(s, f"i{k:02}", f"text {k}", [("a", "b", "z")[k % 3]], k % 4 == 0, None) for s in range(2) for k in range(24)]
    matches = [(t, s, r, f"i{k:02}", 1 + (k + r) % 3, [True, k % 5 > 0], [0] if k == 7 and r else []) for t in ("t", "u") for s in range(2) for r in range(2) for k in range(24) if (k + s) % 2]
    r, m, i = spark.createDataFrame([rubric("t"), rubric("u", anchors=()), rubric("none")], RUBRIC), spark.createDataFrame(matches, MATCH), spark.createDataFrame(items, ITEM)
    grid = spark.createDataFrame([(t, s, k) for t in ("t", "u", "none") for s in range(2) for k in range(2)], GRID)
    judged = scoring.judged(m, i, r)
    full, bare = scoring.repeat_outcomes(judged, grid), scoring.repeat_outcomes(judged, grid, listed=False)
    assert "sides" not in bare.columns and full.where(F.size("sides") != F.col("n_sides")).count() == 0 and full.where("n_sides > 2").count() > 0
    plain = lambda df: sorted(map(str, df.drop("sides").collect()))
    assert plain(full) == plain(bare)
    a, b = (scoring.target_verdicts(r, scoring.sample_outcomes(x)) for x in (full, bare))
    assert plain(a.drop("triggers")) == plain(b.drop("triggers"))
    mine = lambda df: {(x.target, t["type"]) for x in df.collect() for t in x.triggers}
    assert {x for x in mine(a) if x[1] not in ("dropped", "anchor_mismatch")} == mine(b)


def test_items_are_looked_up_part_by_part(spark):
    """Few enough bytes to be sent whole, by their estimate; they must be dealt by key nevertheless."""
    items = spark.createDataFrame([(0, "finding/1", "one", ["a"], False, None)], ITEM)
    of = scoring.judged(spark.createDataFrame([("t", 0, 0, "finding/1", 3, [True], [])], MATCH), items, spark.createDataFrame([rubric("t")], RUBRIC))
    assert "ShuffledHashJoin [sample#" in of._jdf.queryExecution().executedPlan().toString()
    assert [(r.level, r["class"]) for r in of.collect()] == [(3, "corroborated")]
