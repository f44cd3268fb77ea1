import pytest

from skeinlog.operators import repos, stores


def test_freeze(spark, tmp_path):
    path = str(tmp_path / "frozen")
    kind = "id long, text string"
    spark.createDataFrame([(1, "a"), (2, "b")], kind).write.parquet(path)
    live = spark.createDataFrame([(1, "a"), (3, "c")], kind)
    assert [tuple(r) for r in stores.freeze(spark, path, spark.read.parquet(path), live, "id", "text").collect()] == [(3, "c")]
    assert spark.read.parquet(path).count() == 3
    with pytest.raises(ValueError, match=r"\[1\]"):
        stores.freeze(spark, path, spark.read.parquet(path), spark.createDataFrame([(1, "z")], kind), "id", "text")


def test_bundles(spark, tmp_path):
    e = spark.createDataFrame([("alpha", "F1", "x", ["2026-06-01"]), ("beta", "P1", "y", [])], "repo string, id string, text string, session_dates array<string>")
    stores.write_bundles(e, str(tmp_path / "b"))
    back = spark.read.json(str(tmp_path / "b"))
    assert {(r.repo, r.id) for r in back.collect()} == {("alpha", "alpha/F1"), ("beta", "beta/P1")} and "session_dates" not in back.columns


def test_envelope(spark):
    raw = ['{"structured_output": {"k": 1}}', '{"is_error": true, "structured_output": {}}', "nope", '{"structured_output": null}']
    got = [r.failure for r in stores.envelope(spark.createDataFrame([(x,) for x in raw], "raw string"), "raw").collect()]
    assert got == [None, "model error", "not JSON", "no output"]


def test_repos(spark):
    rows = [("/w/alpha/.worktrees/t1", None), ("", "/Users/u/Developer/tc/src"), ("", "/Users/u/Developer/lib"), ("", "/tmp"), (None, None)]
    df = spark.createDataFrame(rows, "repo string, cwd string")
    got = [r[0] for r in df.select(repos.repo_key(df["repo"], df["cwd"], {"tc": "tmux-ctrl"})).collect()]
    assert got == ["alpha", "tmux-ctrl", "lib", "", ""]


def test_roots_and_files(spark):
    df = spark.createDataFrame([("/a/b/c",), ("/a/bc",), ("/a/b",)], "p string")
    assert [r[0] for r in df.select(repos.root_of(df["p"], ["/a/b", "/a"])).collect()] == ["/a/b", "/a", "/a/b"]
    df = spark.createDataFrame([("/x/.worktrees/t/src/m.go",), ("/Users/me/n.go",), ("rel.go",)], "p string")
    assert [r[0] for r in df.select(repos.relative_file(df["p"])).collect()] == ["src/m.go", "[redacted]", "rel.go"]
