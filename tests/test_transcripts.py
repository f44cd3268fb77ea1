import datetime as dt
import json

import pytest

from skeinlog.operators import facts
from skeinlog.sources import transcripts

REJECT = "The user doesn't want to proceed with this tool use. The tool use was rejected. To tell you how to proceed, the user said:\nuse a flag"


def line(kind, content=None, ts=None, **more):
    row = {"type": kind, **more}
    if ts:
        row["timestamp"] = f"2026-06-01T10:{ts}Z"
    if content is not None:
        row["message"] = {"role": kind, "content": content, **row.pop("message", {})}
    return json.dumps(row)


def spoken(i, ts, blocks, **usage):
    return line("assistant", blocks, ts, message={"id": i, "model": "m", "usage": {"input_tokens": 10, "output_tokens": 5, "cache_creation_input_tokens": 1, "cache_read_input_tokens": 100} | usage})


FILES = {
    "p/clean.jsonl": [line("user", "Fix the build please", "00:00", cwd="/w/a", gitBranch="main"), spoken("m1", "00:30", [{"type": "text", "text": "ok"}]), spoken("m1", "00:31", [{"type": "tool_use", "name": "Read", "input": {"file_path": "x"}}]), line("user", [{"type": "tool_result", "content": "text of x"}], "00:40"), spoken("m2", "01:00", [{"type": "text", "text": "done"}], cache_read_input_tokens=40)],
    "p/friction.jsonl": [
        line("user", "  add a retry  to the client", "00:00"),
        spoken("a", "00:10", [{"type": "tool_use", "name": "Edit", "input": {}}, {"type": "tool_use", "name": "Agent", "input": {"subagent_type": "general"}}]),
        line("user", [{"type": "tool_result", "is_error": True, "content": [{"text": "lint stopped: "}, {"text": "unused import os at line 17"}]}], "00:20"),
        line("user", [{"type": "tool_result", "is_error": True, "content": REJECT}], "00:30"),
        line("user", [{"type": "tool_result", "is_error": "yes", "content": "fine"}], "00:35"),
        line("user", [{"type": "text", "text": "[Request interrupted by user]"}], "00:40"),
        line("user", "continue", "00:45"),
        line("user", "it says [Request interrupted by user somewhere", "00:50", toolUseResult={"filePath": "c.go", "structuredPatch": [{"lines": ["+a", "+b", "-c", " d"]}]}),
        "{not json", "", line("brand-new", ts="00:55"), '"text"',
    ],
    "p/agent-1.jsonl": [line("user", "of a subagent", "00:00")],
    "q/deep/subagents/z.jsonl": [line("user", "too deep", "00:00")],
}


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    at = tmp_path_factory.mktemp("projects")
    for name, rows in FILES.items():
        (at / name).parent.mkdir(parents=True, exist_ok=True)
        (at / name).write_text("\n".join(rows))
    return str(at)


def test_listing(spark, root):
    assert {(r.session_id, r.project_dir) for r in transcripts.newest(transcripts.refs(spark, root)).collect()} == {("clean", "p"), ("friction", "p")}


def test_lines(spark, root):
    rows = transcripts.lines(spark, root).collect()
    bad = [r.raw for r in rows if r.v is None]
    assert sorted(bad) == ['"text"', "{not json"] and {r.session_id for r in rows} == {"clean", "friction"}


def test_long_line(spark, tmp_path):
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "s.jsonl").write_text(line("user", "x" * 2_000_000, "00:00"))
    assert transcripts.blocks(transcripts.events(transcripts.lines(spark, str(tmp_path)))).first().text == "x" * 2_000_000


def test_facts(spark, root):
    got = {r.session_id: r for r in facts.session_facts(transcripts.lines(spark, root)).collect()}
    c, f = got["clean"], got["friction"]
    assert (c.user_turns, c.assistant_turns, c.tool_counts, c.wall_clock) == (1, 2, {"Read": 1}, 60_000_000_000)
    assert (c.input_tokens, c.output_tokens, c.cache_creation, c.cache_read_peak) == (20, 10, 2, 100)
    assert (c.cwd, c.git_branch, c.tool_errors, c.interrupts) == ("/w/a", "main", 0, 0)
    assert (f.user_turns, f.tool_errors, f.rejections, f.interrupts, f.edits, f.fan_out) == (3, 1, 1, 1, 1, 1)
    assert (f.lines_added, f.lines_removed, f.files_touched) == (2, 1, 1)
    assert f.mechanical_friction == {"other": 1} and f.error_signatures == ["lint stopped: unused import os at line N"]
    assert len(f.fingerprints) == 2  # `continue` says nothing


def test_corpora(spark, root):
    got = {r.session_id: r for r in facts.corpora(transcripts.lines(spark, root)).collect()}
    assert "use a flag" in got["friction"].user_text and "unused import os" not in got["friction"].user_text
    assert "unused import os" in got["friction"].all_text and "text of x" in got["clean"].all_text


def test_canary(spark, root):
    got = {(r.session_id, r.kind, r.key): r.n for r in transcripts.canary(transcripts.lines(spark, root)).collect()}
    assert got["friction", "malformed", "line"] == 2 and got["friction", "unknown_line_type", "brand-new"] == 1
    assert not [k for k in got if k[0] == "clean"]


def test_large_files_are_cut(spark, tmp_path, monkeypatch):
    """A file beyond the bound is read in pieces by many tasks; its numbers of lines are those of a plain read."""
    (tmp_path / "p").mkdir()
    said = ["", *("x" * (i * 37 % 5000) + f" é{i}" for i in range(900)), "", "last"]
    (tmp_path / "p" / "big.jsonl").write_text("\n".join(said) + "\n")
    (tmp_path / "p" / "other.jsonl").write_text("\n".join(reversed(said)))  # its last line break ends a line
    (tmp_path / "p" / "small.jsonl").write_text("a\n\nb")
    monkeypatch.setattr(transcripts, "WHOLE", 1000)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40000")
    try:
        raw = transcripts.raw_lines(spark, f"{tmp_path}/*/*.jsonl")
        got = {}
        for r in raw.collect():
            got.setdefault(r.session_id, {})[r.line_no] = r.raw
        assert spark.read.text(f"{tmp_path}/p/big.jsonl").rdd.getNumPartitions() > 10
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == {"big": dict(enumerate(said)), "other": dict(enumerate([*reversed(said)][:-1])), "small": {0: "a", 1: "", 2: "b"}}


def test_newest_of_equal_times(spark):
    t = dt.datetime(2026, 1, 1)
    rows = [("s", f"/p/{c}", "p", t, 1) for c in "hgfedcba"] + [("s", "/p/0", "p", t - dt.timedelta(1), 1)]
    assert transcripts.newest(spark.createDataFrame(rows, "session_id string, path string, project_dir string, mtime timestamp, bytes long")).first().path == "/p/a"


PLAN = lambda df: df._jdf.queryExecution().optimizedPlan().toString()


def raw_lines(spark):
    return spark.createDataFrame([("s", 0, '{"type": "user", "message": {"content": "hello"}}'), ("s", 1, '{"type": 1}'), ("s", 2, " ")], "session_id string, line_no long, raw string")


def test_lines_are_parsed_once(spark):
    """Neither the checks of a line nor filters on what came of it may parse it again."""
    decoded = transcripts.decode(raw_lines(spark))
    assert PLAN(transcripts.blocks(transcripts.events(decoded))).count("parseJson") == 1
    assert [(r.line_no, r.v is None) for r in decoded.orderBy("line_no").collect()] == [(0, False), (1, True)]


def test_facts_read_what_is_kept(spark):
    f = facts.session_facts(transcripts.decode(raw_lines(spark)))
    assert PLAN(f).count("parseJson") == 0 and [r.user_turns for r in f.collect()] == [1]
