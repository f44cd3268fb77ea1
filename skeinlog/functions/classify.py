"""Predicates and classes of transcript texts."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from skeinlog.functions.text import trim_ws

# Markers that the recording tool writes, and what follows from them.
INTERRUPT = "[Request interrupted by user"
REJECTION = "The user doesn't want to proceed with this tool use"
REASON = "the user said:"
NOTIFICATION = "<task-notification>"
SYNTHETIC = (
    "<ide_opened_file", "<ide_selection", "<command-name", "<command-message", "<command-args", "<command-stdout",
    "<local-command-stdout", "<local-command-caveat", "<system-reminder", "<bash-", "<user-prompt-submit",
    "Caveat: The messages below", "Base directory for this skill:", "Result of calling the",
    "The following deferred tools", "[structured-output-enforce]",
)
TRIVIAL = ("yes", "y", "yep", "yeah", "ok", "okay", "sure", "no", "continue", "go on", "go ahead", "please continue", "proceed")
MODES = (
    ("File has not been read yet", "edit_before_read"),
    ("Note: your current working directory is", "wrong_cwd"),
    ("no such file or directory: src", "wrong_cwd"),
    ("does not contain main module", "wrong_cwd"),
    ("cannot find main module", "wrong_cwd"),
    ("Refusing to write through symlink", "symlink_edit"),
)


def starts(c: Column, *heads: str) -> Column:
    """c, without white space at its front, begins with one of heads. Never a search inside of the text."""
    return c.rlike(r"^(?U:\s*)(?:" + "|".join(re.escape(h) for h in heads) + ")")


def is_interrupt(c: Column) -> Column:
    return starts(c, INTERRUPT)


def is_rejection(c: Column) -> Column:
    return starts(c, REJECTION)


def is_notification(c: Column) -> Column:
    return starts(c, NOTIFICATION)


def is_synthetic(c: Column) -> Column:
    return (trim_ws(c) == "") | starts(c, *SYNTHETIC)


def text_class(c: Column) -> Column:
    """What a user's text is; the first that holds."""
    return F.when(is_notification(c), "task_notification").when(is_interrupt(c), "interrupt").when(is_rejection(c), "rejection").when(is_synthetic(c), "synthetic").otherwise("user_turn")


def result_class(body: Column, is_error: Column) -> Column:
    return F.when(is_error & is_interrupt(body), "interrupt").when(is_error & is_rejection(body), "rejection").when(is_error, "error").when(is_interrupt(body), "interrupt")


def is_trivial(normal: Column) -> Column:
    return normal.isin(*TRIVIAL) | (normal.startswith("@") & ~normal.contains(" "))


def rejection_reason(c: Column) -> Column:
    """What follows the first mark of a reason; null without one."""
    at = F.instr(c, REASON)
    return F.when(at > 0, trim_ws(F.substr(c, at + F.lit(len(REASON)))))


def mode_of(body: Column) -> Column:
    out = None
    for text, mode in MODES:
        out = F.when(body.contains(text), mode) if out is None else out.when(body.contains(text), mode)
    return out.otherwise("other")


def length_bucket(turns: Column) -> Column:
    return F.when(turns < 5, "short").when(turns < 50, "medium").otherwise("long")


def shape(writes: Column, turns: Column) -> Column:
    return F.when(writes > 0, "implementation").when(turns >= 10, "exploration").otherwise("quick_question")


def substantial(assistant_turns: Column, friction: Column, least: int = 5) -> Column:
    return (assistant_turns >= least) | (friction > 0)
