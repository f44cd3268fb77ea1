"""The stateful loop: after each step its ledger is what a batch plan says, also where a step was killed on its way."""

import json
import os
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from skeinlog.operators import judge, keyed
from skeinlog.sources import transcripts
from skeinlog.streaming import backfill

OPTIONS = backfill.Options(threshold=2, quiet_seconds=3600, failures=3)
HOUR = 3600


def put(root, project, name, turns, word="fine", age=2 * HOUR):
    lines = [json.dumps({"type": "assistant", "timestamp": f"2026-01-01T00:00:{i:02}Z", "message": {"id": f"m{i}", "content": [{"type": "text", "text": word}], "usage": {"output_tokens": 1}}}) for i in range(turns)]
    at = root / project / f"{name}.jsonl"
    at.parent.mkdir(parents=True, exist_ok=True)
    at.write_text("\n".join(lines) + "\n")
    when = time.time() - age
    os.utime(at, (when, when))


def test_loop(spark, tmp_path):
    root, store = tmp_path / "in", str(tmp_path / "store")
    put(root, "p", "a", 3)
    put(root, "p", "small", 1)
    put(root, "insights-x", "meta", 3)
    put(root, "p", "busy", 3, age=10)
    put(root, "p", "bad", 3, "broken")
    put(root, "p", "agent-1", 3)
    killed = []

    def client(texts: pd.Series) -> list[dict]:
        if any("broken" in t for t in texts):
            raise RuntimeError("window")
        return judge.by_rule(texts)


    def analyse(due, n):
        if "facts" in killed:  # the whole way from lines to judged facts; the other steps only need outcomes
            got = backfill.analysed(due, f"{store}/pool", OPTIONS, client)
        else:
            bad = F.when(F.col("session_id") == "small", "gated").when((F.col("session_id") == "bad") & ("mended" not in killed), "errored").otherwise("analysed")
            got = due.select("session_id", "mtime", bad.alias("outcome"), F.lit(2).alias("threshold"), F.lit(None).cast("string").alias("error")).persist()
            done = got.where("outcome = 'analysed'").select("session_id", F.col("mtime").alias("transcript_mtime"))
            keyed.merge(done, f"{store}/pool/stamps", "session_id", "transcript_mtime", 2)
        if "now" in killed:  # after the pool's merge, before the ledger
            killed.remove("now")
            raise RuntimeError("killed")
        return got

    def step():
        planned = backfill.plan(transcripts.newest(transcripts.refs(spark, str(root))), backfill.ledger(spark, store), pd.Timestamp.utcnow().strftime("%Y-%m-%d %H:%M:%S"), OPTIONS)
        todo = {r.session_id for r in planned.where("class = 'process'").collect()}
        seen = backfill.ledger(spark, store).count()
        classes = {r.session_id: r["class"] for r in planned.collect()}
        tally = backfill.step(spark, str(root), store, OPTIONS, analyse)
        after = backfill.ledger(spark, store)
        assert after.count() - seen == len(todo) == sum(tally.values())
        last = max((r.seq or 0 for r in after.collect()), default=0)
        assert {r.session_id for r in after.where(f"seq = {last}").collect()} == todo or not todo
        return tally, classes

    tally, classes = step()
    assert tally == {"analysed": 1, "gated": 1, "errored": 1} and classes["busy"] == "quiet" and classes["meta"] == "meta"
    assert step()[0] == {"errored": 1}  # the failed one is tried again
    put(root, "p", "a", 4, age=HOUR + 60)  # grows
    put(root, "q", "late", 2)
    killed.append("now")
    with pytest.raises(Exception, match="killed"):
        backfill.step(spark, str(root), store, OPTIONS, analyse)
    tally, _ = step()  # the killed step's batch runs again, in a new query
    assert tally == {"analysed": 2, "errored": 1}
    tally, classes = step()
    assert tally == {} and classes["bad"] == "parked" and classes["a"] == "incremental" and classes["small"] == "gate"
    stamps = {r.session_id: r.transcript_mtime for r in keyed.read(spark, f"{store}/pool/stamps").collect()}
    assert set(stamps) == {"a", "late"} and stamps["a"] > stamps["late"]
    killed.append("facts")
    put(root, "p", "bad", 4, age=HOUR + 30)  # grows, and is mended
    put(root, "p", "a", 4, "broken", age=HOUR + 40)
    assert step()[0] == {"analysed": 1, "errored": 1}
    assert {(r.session_id, r.assistant_turns) for r in keyed.read(spark, f"{store}/pool/analyses").collect()} == {("bad", 4)}
