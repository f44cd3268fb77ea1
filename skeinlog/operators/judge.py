"""The seam for a model's judgement: a function of texts, called in batches. The default is a fixed rule and calls no one."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

JUDGED = (
    "session_id string, session_type string, outcome string, underlying_goal string, brief_summary string, friction array<struct<type:string,one_line:string,quote:string,file:string>>, "
    "preferences array<struct<rule:string,quote:string>>, error string"
)
FIELDS = ("session_type", "outcome", "underlying_goal", "brief_summary", "friction", "preferences", "error")


def by_rule(texts: pd.Series) -> list[dict]:
    """A stand-in that depends on nothing but the text."""
    out = []
    for t in texts:
        body = f"{t}\n".split("\n---\n", 1)[-1]  # the header has a count of errors, whatever there were
        failed = "error" in body.lower()
        line = next((x for x in body.split("\n") if "error" in x.lower()), "")
        friction = [{"type": "tool_error", "one_line": "A tool failed", "quote": line.split("]: ", 1)[-1][:200], "file": None}] if failed else []
        out.append({"session_type": "single_task" if len(t) < 2000 else "multi_task", "outcome": "partially_achieved" if failed else "fully_achieved", "underlying_goal": "", "brief_summary": " ".join(t.split())[:80], "friction": friction, "preferences": []})
    return out


def judged(reduced: DataFrame, client: Callable[[pd.Series], list[dict]] = by_rule) -> DataFrame:
    """(session_id, and FIELDS) of reduced (session_id, text). A batch that fails is tried row by row,
    and a row that fails has its error and nothing else."""

    def one(text: str) -> dict:
        try:
            return client(pd.Series([text]))[0]
        except Exception as e:
            return {"error": f"{type(e).__name__}: {e}"[:120]}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            try:
                rows = client(pdf["text"])
            except Exception:
                rows = [one(t) for t in pdf["text"]]
            got = {c: pd.Series([r.get(c) for r in rows], dtype=object) for c in FIELDS}
            yield pd.DataFrame({"session_id": pd.Series(list(pdf["session_id"]), dtype=object)} | got)

    return reduced.select("session_id", "text").mapInPandas(run, JUDGED)
