"""Column builders over text: normalising, clauses, sanitising, hashing, quoting. Built-in functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Sizes in characters.
MIN_QUOTE, MIN_CLAUSE, MIN_CLAUSE_TOKENS = 12, 16, 4
SANITISED, SIGNATURE, OPENING = 160, 120, 280

# Patterns of what evidence text must not show.
_UUID = r"(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"
_TICKET = r"(?i)\bsc-\d+\b"
_PATH = r"\$HOME[^\t\n\f\r ]*|/(?:Users|home|private|var|tmp)/[^\t\n\f\r ]*"
_WORKTREE = r"(?<![^\t\n\f\r ])[^\t\n\f\r ]*\.worktrees/[^\t\n\f\r ]*"  # from the start of its run of characters on, so that long runs are read once

#: All white space of Unicode.
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def normalise_ws(c: Column) -> Column:
    """Runs of white space of any kind become one space; none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def trim_ws(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def fingerprint_text(c: Column) -> Column:
    return F.lower(normalise_ws(c))


def normal_clause(c: Column) -> Column:
    return F.rtrim(fingerprint_text(c), F.lit(".!?;:, "))


def fingerprint(c: Column) -> Column:
    """The first 16 hex digits of the SHA-1."""
    return F.substring(F.sha1(F.encode(c, "UTF-8")), 1, 16)


def sha_hex(c: Column) -> Column:
    return F.sha2(F.encode(c, "UTF-8"), 256)


def key_of(*parts: Column) -> Column:
    """SHA-256 over parts, each followed by NUL."""
    return sha_hex(F.concat(*[x for p in parts for x in (p, F.lit("\0"))]))


def set_hash(ids: Column) -> Column:
    """A hash of a set of ids that doesn't depend on their order or repetition."""
    return sha_hex(F.concat(F.array_join(F.sort_array(F.array_distinct(ids)), "\0"), F.lit("\0")))


def acted_key(kind: Column, escalated: Column, statement: Column) -> Column:
    sep = F.when(escalated, F.lit("\0esc\0")).otherwise(F.lit("\0"))
    return F.substring(sha_hex(F.concat(kind, sep, fingerprint_text(statement))), 1, 16)


def tokens(c: Column) -> Column:
    """Words without the characters at their edges that are neither letter nor digit; those inside stay."""
    bare = F.transform(F.split(c, r"(?U)\s+"), lambda t: F.regexp_replace(F.regexp_replace(t, r"^[^\p{L}\p{Nd}]+", ""), r"(?<=[\p{L}\p{Nd}])[^\p{L}\p{Nd}]+$", ""))
    return F.filter(bare, lambda t: t != "")


def clauses(line: Column) -> Column:
    """A line cut after . ! or ? where white space follows."""
    cut = F.transform(F.split(line, r"(?U)(?<=[.!?])(?=\s)"), trim_ws)
    return F.filter(cut, lambda c: c != "")


def sanitise(c: Column) -> Column:
    """Evidence text fit to be shown: identifiers, tickets and private paths are replaced, in this order, and the rest is cut."""
    s = trim_ws(c)
    s = F.regexp_replace(s, r"^<tool_use_error>|</tool_use_error>$", "")
    s = F.regexp_replace(s, _UUID, "[id]")
    s = F.regexp_replace(s, _TICKET, "[ticket]")
    s = F.when(F.contains(s, F.lit(".worktrees/")), F.regexp_replace(s, _WORKTREE, "[path]")).otherwise(s)
    s = F.regexp_replace(s, _PATH, "[path]")
    return F.substring(normalise_ws(s), 1, SANITISED)


def error_signature(c: Column) -> Column:
    first = F.substring_index(trim_ws(c), "\n", 1)
    return F.substring(F.regexp_replace(sanitise(first), r"\d+", "N"), 1, SIGNATURE)


def elide(c: Column, most: int) -> Column:
    """The first and last half of a longer text, trimmed, and by how much it is too long."""
    half, c = most // 2, trim_ws(c)
    cut = F.concat(F.substring(c, 1, half), F.lit(" …["), (F.length(c) - most).cast("string"), F.lit(" chars cut]… "), F.right(c, F.lit(half)))
    return F.when(F.length(c) > most, cut).otherwise(c)


def shorten(c: Column, most: int) -> Column:
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit("…"))).otherwise(c)


# Fixed value: the pattern of a claim of quantity.
QUANTITY = r"\d+\s*%|\b\d+\s+(sessions?|times?|incidents?)\b|\b\d+\s+of\s+\d+\b"


def has_quantity(c: Column) -> Column:
    """Says a number of sessions, times or incidents, a share, or so many of so many."""
    return c.rlike(QUANTITY)


# What a snapshot's free text must not hold (case matters), and what the files of an evaluation must not. Each has a set of
# its own; they aren't one set.
SNAPSHOT: Sequence[tuple[str, str]] = (
    ("users_path", r"/Users/"),
    ("home", r"\$HOME"),
    ("uuid", r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"),
    ("ticket", r"\bsc-\d+\b"),
)
ARTIFACT: Sequence[tuple[str, str]] = (
    ("uuid", r"(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"),
    ("users_path", r"/Users/"),
    ("home_path", r"/home/"),
    ("home", r"\$HOME"),
    ("ticket", r"(?i)\bsc-\d+\b"),
    ("worktree", r"\.worktrees/"),
)
# What no file of a repository must hold. The names in round brackets are made up and allowed.
PRIVATE: Sequence[tuple] = (
    ("users_path", r"(?i)/Users/([a-zA-Z0-9._-]+)", ("dev",)),
    ("users_slug", r"(?i)-Users-([a-zA-Z0-9._]+)", ("dev",)),
    ("home_path", r"(?i)/home/([a-zA-Z0-9._-]+)", ("user",)),
    ("home_slug", r"(?i)-home-([a-zA-Z0-9._]+)", ("user",)),
    ("uuid", r"(?i)([0-9a-f]{8})-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}", ("00000000", "0abc1234")),
    ("ticket", r"(?i)\bsc-[0-9]{4,}\b"),
)


def private_labels(c: Column, patterns: Sequence[tuple] = PRIVATE) -> Column:
    """The labels of the patterns that a text matches, never the matches. A pattern is a label, a regular expression and, if need be,
    what its first group may be: it takes a match with another name, in whatever case."""

    def hit(pattern: str, allowed: Sequence[str] = ()) -> Column:
        if not allowed:
            return c.rlike(pattern)
        return F.exists(F.regexp_extract_all(c, F.lit(pattern), F.lit(1)), lambda name: ~F.lower(name).isin(*allowed))

    return F.array_compact(F.array(*[F.when(hit(*p[1:]), F.lit(p[0])) for p in patterns]))
