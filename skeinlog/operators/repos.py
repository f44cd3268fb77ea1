"""Which repository a session belongs to."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip_worktree(path: Column) -> Column:
    """The path up to a folder of worktrees."""
    return F.regexp_replace(path, r"/\.worktrees/.*$", "")


def repo_key(repo: Column, cwd: Column, aliases: Mapping[str, str]) -> Column:
    """The last part of repo; without one, the folder below Developer in cwd, under its alias. Empty if neither tells."""
    named = F.substring_index(strip_worktree(repo), "/", -1)
    guess = F.regexp_extract(F.coalesce(cwd, F.lit("")), r"/Developer/([^/]+)", 1)
    known = guess
    for name, real in aliases.items():
        known = F.when(guess == name, F.lit(real)).otherwise(known)
    return F.when(F.coalesce(repo, F.lit("")) != "", named).otherwise(known)


def root_of(cwd: Column, roots: Sequence[str]) -> Column:
    """The first of roots that cwd is, or lies in, at a component's boundary."""
    return F.coalesce(*[F.when((cwd == r) | cwd.startswith(r.rstrip("/") + "/"), F.lit(r)) for r in roots], F.lit(None).cast("string"))


def relative_file(path: Column) -> Column:
    """A file within its worktree; one below a home folder is redacted, as its path names a person."""
    inner = F.regexp_extract(path, r"/\.worktrees/[^/]+/(.+)$", 1)
    return F.when(inner != "", inner).when(path.startswith("/Users/") | path.startswith("/home/"), "[redacted]").otherwise(path)


def split_id(c: Column) -> tuple[Column, Column]:
    """(repo, id) of repo/id, cut at the first slash."""
    at = F.instr(c, "/")
    return F.when(at > 0, F.substr(c, F.lit(1), at - 1)).otherwise(F.lit("")), F.substr(c, at + F.lit(1))
