"""The progress gate over attempts as they arrive, with state by conversation.

Attempts may come late and out of order, by ``late`` at most. A group's state holds those that the
watermark has not passed yet, and what the last judged one had; once the watermark passes an
attempt nothing earlier can come any more, so it is judged in the order of time and leaves the
state. The result is that of ``agent.progress_gate`` over the same rows, batch by batch, and a
batch that is run again gives the same rows. What comes later than ``late`` is left out by the
watermark. The last attempts of a group wait until the watermark passes them.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

ATTEMPTS = "conv string, attempt long, ts timestamp, failure_signature string, f2p_passed long, regression_failed long, clean_resolution boolean"
JUDGED = "conv string, attempt long, ts timestamp, reason string, passed boolean, stagnation long, relocalize boolean"
#: What is kept of a group: attempts that wait, as JSON rows, and the last judged one's row and stagnation.
STATE = "waiting string, last string, stagnation long"
MEASURES = ("failure_signature", "f2p_passed", "regression_failed", "clean_resolution")


def _reason(now: dict, before: dict | None) -> str:
    """Why an attempt passes the gate, or that it is stagnant; nulls compare as SQL's do."""

    def both(c: str) -> bool:
        return now[c] is not None and before[c] is not None

    if before is None:
        return "first_attempt"
    if both("f2p_passed") and now["f2p_passed"] > before["f2p_passed"]:
        return "new_issue_tests_green"
    if both("regression_failed") and now["regression_failed"] < before["regression_failed"]:
        return "regression_failures_reduced"
    if now["clean_resolution"] and not before["clean_resolution"]:
        return "clean_resolution_improved"
    if now["failure_signature"] != before["failure_signature"]:
        return "failure_signature_changed"
    return "stagnant_failure_signature"


def _rows(frame: pd.DataFrame) -> list[dict]:
    plain = frame.astype(object).where(frame.notna(), None)
    out = []
    for r in plain.to_dict("records"):
        row = {"attempt": int(r["attempt"]), "us": r["ts"].value // 1000, "failure_signature": r["failure_signature"]}
        row |= {c: None if r[c] is None else int(r[c]) for c in ("f2p_passed", "regression_failed")}
        out.append(row | {"clean_resolution": None if r["clean_resolution"] is None else bool(r["clean_resolution"])})
    return out


def _judge(limit: int):
    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waiting, last, stagnation = [], None, 0
        if state.exists:
            text, before, stagnation = state.get
            waiting, last = json.loads(text), json.loads(before) if before else None
        for frame in frames:
            waiting += _rows(frame)
        passed = state.getCurrentWatermarkMs() * 1000
        waiting.sort(key=lambda r: (r["us"], r["attempt"], json.dumps([r[c] for c in MEASURES])))
        ready = [r for r in waiting if r["us"] <= passed]
        waiting = waiting[len(ready) :]
        out = []
        for r in ready:
            reason = _reason(r, last)
            stagnation = stagnation + 1 if reason == "stagnant_failure_signature" else 0
            out.append((key[0], r["attempt"], pd.Timestamp(r["us"], unit="us"), reason, stagnation == 0, stagnation, stagnation >= limit))
            last = r
        state.update((json.dumps(waiting), json.dumps(last) if last else None, stagnation))
        if waiting:
            state.setTimeoutTimestamp(max(waiting[0]["us"] // 1000, state.getCurrentWatermarkMs() + 1))
        if out:
            yield pd.DataFrame(out, columns=["conv", "attempt", "ts", "reason", "passed", "stagnation", "relocalize"])

    return step


def judge_attempts(attempts: DataFrame, late: str = "30 minutes", limit: int = 2) -> DataFrame:
    """The stream of judged attempts of a stream of attempts (ATTEMPTS); without conversation or time they are left out."""
    known = attempts.where(F.col("conv").isNotNull() & F.col("ts").isNotNull() & F.col("attempt").isNotNull())
    return known.withWatermark("ts", late).groupBy("conv").applyInPandasWithState(_judge(limit), JUDGED, STATE, "append", GroupStateTimeout.EventTimeTimeout)
