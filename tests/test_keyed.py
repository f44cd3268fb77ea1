"""Merges by key into a versioned table: other keys stay, two writers leave one sound state, readers keep their version."""

import pytest
from pyspark.errors import PySparkException

from skeinlog.operators import keyed

KIND = "k string, at int, v string"


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), KIND)


def rows(df):
    return {tuple(r) for r in df.collect()}


def test_merge(spark, tmp_path):
    at = str(tmp_path / "t")
    assert keyed.merge(frame(spark, ("a", 1, "x"), ("b", 1, "x"), ("b", 2, "y"), ("c", None, "x")), at, "k", "at", 3) == 1
    old = keyed.read(spark, at)
    assert keyed.merge(frame(spark, ("a", 1, "tie"), ("b", 1, "late"), ("c", None, "tie"), ("d", 0, "new")), at, "k", "at") == 2
    assert rows(keyed.read(spark, at)) == {("a", 1, "tie"), ("b", 2, "y"), ("c", None, "tie"), ("d", 0, "new")}
    assert rows(old) == rows(keyed.read(spark, at, 1)) == {("a", 1, "x"), ("b", 2, "y"), ("c", None, "x")}  # a reader keeps its version
    assert keyed.merge(frame(spark), at, "k", "at") == 2 and keyed.versions(spark, at) == [1, 2]
    with pytest.raises(PySparkException, match="a row without k"):
        keyed.merge(frame(spark, (None, 1, "x")), at, "k", "at")
    with pytest.raises(ValueError, match="columns differ"):
        keyed.merge(frame(spark, ("a", 1, "x")).drop("v"), at, "k", "at")
    with pytest.raises(ValueError, match="kept by k"):
        keyed.merge(frame(spark, ("a", 1, "x")), at, "v", "at")
    assert keyed.vacuum(spark, at, 1) >= 1 and keyed.versions(spark, at) == [2] and keyed.read(spark, at).count() == 4


@pytest.mark.parametrize("other", ["a", "b"])
def test_two_writers(spark, tmp_path, monkeypatch, other):
    """Another writer commits between this one's reading and its commit: in the same bucket, so that both are merged."""
    at, commit, once = str(tmp_path / "t"), keyed._commit, []
    keyed.merge(frame(spark, ("a", 1, "x"), ("b", 1, "x"), ("z", 1, "x")), at, "k", "at", 1)

    def late(spark, path, entry):
        if not once:
            once.append(1)
            keyed.merge(frame(spark, (other, 3, "theirs")), at, "k", "at")
        return commit(spark, path, entry)

    monkeypatch.setattr(keyed, "_commit", late)
    assert keyed.merge(frame(spark, ("a", 2, "mine")), at, "k", "at") == 3
    want = {"a": "mine", "b": "x", "z": "x"} | {other: "theirs"}
    assert {r.k: r.v for r in keyed.read(spark, at).collect()} == want
