"""Life cycles checked: events move things from state to state; what the table of moves doesn't allow is refused and kept as a row.

An event is a function from states to states, and such functions compose.  So
the log is cut anywhere: every part works out what it does to each state, the
parts' results are put together in order, and then every part goes through its
events with the state it begins with.  A thing with any number of events is spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .graph import _settled

# The states of a fact, and where each action may lead from each.
FACT_MOVES = {
    "support": {"observed": "supported", "conflicted": "supported"}, "verify": {"observed": "verified", "supported": "verified", "conflicted": "verified"},
    "dispute": {"observed": "conflicted", "supported": "conflicted", "verified": "conflicted"},
    "reject": {"observed": "superseded", "supported": "superseded", "verified": "superseded", "conflicted": "superseded"},
    "retire": {"observed": "retired", "supported": "retired", "verified": "retired", "conflicted": "retired", "superseded": "retired"},
}
FACT_START = "observed"
OUT = "from_state string, to_state string, accepted boolean"


def _step(moves: Mapping[str, Mapping[str, str]], state: str, action: str | None) -> tuple[str, bool]:
    to = moves.get(action, {}).get(state)
    return (state, False) if to is None else (to, True)


def checked_moves(log: DataFrame, moves: Mapping[str, Mapping[str, str]] = FACT_MOVES, start: str = FACT_START) -> DataFrame:
    """log (thing, moment, seq, action and more) with from_state, to_state and accepted: each event in the order of (moment, seq) of its thing.

    Everything begins in `start`.  An action that the moves don't have for the state, or that is null, is
    refused and leaves the state as it is.  Events equal in thing, moment and seq come in any order; seq should tell them apart.  Null things are one thing.
    Columns of the log named like a new one are replaced.  The driver holds two rows for each partition.
    """
    states = sorted({start} | {s for m in moves.values() for f, t in m.items() for s in (f, t)})
    new = [c.split()[0] for c in OUT.split(", ")]
    log = log.select(*(c for c in log.columns if c.lower() not in new))
    ordered = _settled(log.repartitionByRange("thing", "moment", "seq").sortWithinPartitions("thing", "moment", "seq"))

    def effects(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """For the part's first and last thing, what their events do to each state."""
        first = last = None  # [thing, state -> state]
        for pdf in batches:
            for thing, action in zip(pdf["thing"], pdf["action"]):
                thing = None if pd.isna(thing) else str(thing)
                if last is None or last[0] != thing:
                    last = [thing, list(states)]
                    first = first or last
                last[1] = [_step(moves, s, action)[0] for s in last[1]]
        if first is not None:
            part = TaskContext.get().partitionId()
            yield pd.DataFrame({"part": [part] * 2, "last": [False, True], "thing": [first[0], last[0]], "leads": [first[1], last[1]], "one": [first is last] * 2})

    rows = ordered.select("thing", "action").mapInPandas(effects, "part int, last boolean, thing string, leads array<string>, one boolean").collect()
    ends = {(r["part"], r["last"]): r for r in rows}
    begins: dict[int, tuple] = {}  # part -> (thing that goes on, its state)
    thing, state = object(), start
    for part in sorted({r["part"] for r in rows}):
        head, tail = ends[part, False], ends[part, True]
        if head["thing"] == thing:
            begins[part] = (thing, state)
        before = state if tail["one"] and head["thing"] == thing else start
        thing, state = tail["thing"], tail["leads"][states.index(before)]
    sent = log.sparkSession.sparkContext.broadcast(begins)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, state = sent.value.get(TaskContext.get().partitionId(), (object(), start))
        for pdf in batches:
            out = []
            for thing, action in zip(pdf["thing"], pdf["action"]):
                thing = None if pd.isna(thing) else str(thing)
                if thing != own:
                    own, state = thing, start
                was = state
                state, ok = _step(moves, state, action)
                out.append((was, state, ok))
            yield pdf.assign(**dict(zip(new, map(list, zip(*out))))) if out else pdf.assign(**{n: [] for n in new}).astype({"accepted": bool})

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ordered.schema.fields)
    return ordered.mapInPandas(run, f"{kinds}, {OUT}")


def checked_on_stream(events: DataFrame, moves: Mapping[str, Mapping[str, str]] = FACT_MOVES, start: str = FACT_START, idle: str = "30 days") -> DataFrame:
    """The same over a stream (thing string, moment timestamp, seq long, action string, with a watermark on moment): a thing's state is kept between batches.

    Events of a batch go in the order of (moment, seq); what comes in a later batch goes after them.  A thing's state is
    dropped once the watermark is `idle` past its last event.
    """
    wait = int(pd.Timedelta(idle).total_seconds() * 1000)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        now = state.get[0] if state.exists else start
        rows = pd.concat(list(batches)).sort_values(["moment", "seq"], kind="stable")  # a thing's events of one batch
        out = []
        for action in rows["action"]:
            was = now
            now, ok = _step(moves, now, action)
            out.append((was, now, ok))
        state.update((now,))
        state.setTimeoutTimestamp(max(int(rows["moment"].max().timestamp() * 1000), state.getCurrentWatermarkMs()) + wait)
        yield rows.assign(**dict(zip(("from_state", "to_state", "accepted"), map(list, zip(*out)))))[["thing", "moment", "seq", "action", "from_state", "to_state", "accepted"]]

    return events.groupBy("thing").applyInPandasWithState(run, f"thing string, moment timestamp, seq long, action string, {OUT}", "state string", "append", GroupStateTimeout.EventTimeTimeout)


def lifecycle_summary(checked: DataFrame) -> DataFrame:
    """(action, from_state, accepted, n): what was tried in which state, and whether it was let pass."""
    return checked.groupBy("action", "from_state", "accepted").agg(F.count("*").alias("n"))
