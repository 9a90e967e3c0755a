"""Policy state over streams of write events: the circuit breaker and the loop guard.

The batch forms are windows in quartzite.operators.history; these keep the same answers event by event. State is keyed by session; events of a
session are taken in the order of ``seq`` within a micro-batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quartzite.operators.shared import folded

TRIP = 3


def circuit_breaker(events: DataFrame, trip: int = TRIP) -> DataFrame:
    """``session, seq, rule_id, streak, tripped``: the consecutive denials of each denied rule; a round without a denial of a rule
    resets it. ``events``: session, seq, denied_rules."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rules, counts = state.get if state.exists else ([], [])
        held = dict(zip(rules, counts, strict=True))
        out = []
        for r in pd.concat(list(frames)).sort_values("seq").itertuples():
            denied = sorted(set(r.denied_rules if r.denied_rules is not None else []))
            held = {rule: held.get(rule, 0) + 1 for rule in denied}
            out += [(key[0], r.seq, rule, n, n >= trip) for rule, n in held.items()]
        state.update((list(held), list(held.values())))
        yield pd.DataFrame(out, columns=["session", "seq", "rule_id", "streak", "tripped"])

    return events.groupBy("session").applyInPandasWithState(
        run, "session string, seq long, rule_id string, streak int, tripped boolean", "rules array<string>, counts array<int>", "append", GroupStateTimeout.NoTimeout
    )


def loop_guard(events: DataFrame, trip: int = TRIP) -> DataFrame:
    """``session, seq, in_a_row, alarm``: how often the same path and content came in a row. ``events``: session, seq, path, signature."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, n = state.get if state.exists else ("", 0)
        out = []
        for r in pd.concat(list(frames)).sort_values("seq").itertuples():
            now = f"{r.path}\x00{r.signature}"
            n = n + 1 if now == last else 1
            last = now
            out.append((key[0], r.seq, n, n >= trip))
        state.update((last, n))
        yield pd.DataFrame(out, columns=["session", "seq", "in_a_row", "alarm"])

    return events.groupBy("session").applyInPandasWithState(
        run, "session string, seq long, in_a_row int, alarm boolean", "last string, n int", "append", GroupStateTimeout.NoTimeout
    )


def approvals(events: DataFrame) -> DataFrame:
    """``token, seq, approved`` of each write that asks: whether an approval of its token was pending, which it spends. Approving twice is approving
    once. Spark commits state with output, so a restart spends no token twice. ``events``: token, seq, kind (approve or ask)."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pending = bool(state.get[0]) if state.exists else False
        out = []
        for r in pd.concat(list(frames)).sort_values(["seq", "kind"]).itertuples():
            if r.kind == "ask":
                out.append((key[0], r.seq, pending))
            pending = r.kind == "approve"
        state.update((pending,))
        yield pd.DataFrame(out, columns=["token", "seq", "approved"])

    return events.groupBy("token").applyInPandasWithState(run, "token string, seq long, approved boolean", "pending boolean", "append", GroupStateTimeout.NoTimeout)


#: The issue workflow, transition by state.
TRANSITIONS = {
    "Open": {"confirm": "Confirmed", "resolve": "Resolved"},
    "Confirmed": {"resolve": "Resolved"},
    "Resolved": {"reopen": "Open", "close": "Closed"},
    "Closed": {},
}


def issue_states(events: DataFrame) -> DataFrame:
    """``issue, status, resolution, errors`` after all transitions in order; an illegal one is an error and changes nothing. Resolving takes
    the event's resolution, closing keeps it, reopening drops it. ``events``: issue, seq, transition, resolution."""

    def step(state: tuple, row: tuple) -> tuple:
        (status, held, errors), (t, resolution) = state, row
        after = TRANSITIONS[status].get(t)
        if after is None:
            return status, held, errors + 1
        return after, resolution if t == "resolve" else held if t == "close" else None, errors

    steps = events.select(F.col("issue").cast("long").alias("issue"), "transition", "resolution", "seq")
    return folded(steps, "issue", [F.asc_nulls_last("seq")], ("Open", None, 0), lambda state, row: step(state, row[:2]), "issue long, status string, resolution string, errors int")
