"""The assigner as a stateful stream: grants, closings and tasks of a shard in, assignments out."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.nassign import ShardState, assign

EVENTS = "collection string, partition int, seq long, kind string, worker long, n long, offset long, item string"
OUT = "collection string, partition int, worker long, offset long, item string, replica int"


def _load(text: str | None) -> tuple[ShardState, list[tuple[int, str]]]:
    if not text:
        return ShardState(), []
    d = json.loads(text)
    ints = lambda m: {int(k): v for k, v in m.items()}
    return ShardState(ints(d["quota"]), ints(d["last"]), set(d["active"]), d["progress"], ints(d["placed"])), [tuple(x) for x in d["waiting"]]


def _dump(s: ShardState, waiting: list[tuple[int, str]]) -> str:
    return json.dumps({"quota": s.quota, "last": s.last, "active": sorted(s.active), "progress": s.progress, "placed": s.placed, "waiting": waiting})


def run_events(state: ShardState, waiting: list[tuple[int, str]], events: list[tuple], n: int) -> tuple[list[tuple], list[tuple[int, str]]]:
    """Applies events (kind, worker, n, offset, item) in order; what can't be placed waits, and is tried again
    after each grant. Kinds: grant, close, task."""
    out: list[tuple] = []
    known = {o for o, _ in waiting}

    def place() -> None:
        nonlocal waiting
        out.extend(assign(state, iter(waiting), n))
        waiting = [t for t in waiting if state.progress is None or t[0] > state.progress]

    fresh = False
    for kind, worker, amount, offset, item in events:
        if kind == "task":
            if (state.progress is None or offset > state.progress) and offset not in known:
                waiting.append((offset, item))
                known.add(offset)
                fresh = True
            continue
        if fresh:
            place()
            fresh = False
        if kind == "grant":
            state.grant(worker, amount)
            place()
        elif kind == "close":
            state.remove(worker)
        else:
            raise ValueError(f"unknown event: {kind}")
    if fresh:
        place()
    return out, waiting


def assigner(events: DataFrame, n: int = 3) -> DataFrame:
    """events (EVENTS) of many shards to assignments (OUT). A shard's events count in order of seq within a
    micro-batch; unplaced tasks stay in its state, which holds a shard's workers and waiting tasks."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], group: GroupState) -> Iterator[pd.DataFrame]:
        state, waiting = _load(group.get[0] if group.exists else None)
        rows = pd.concat(list(frames)).sort_values("seq")
        none = lambda x: None if pd.isna(x) else int(x)
        found, waiting = run_events(state, waiting, [(r.kind, none(r.worker), none(r.n), none(r.offset), r.item) for r in rows.itertuples()], n)
        group.update((_dump(state, waiting),))
        yield pd.DataFrame([(*key, *r) for r in found], columns=["collection", "partition", "worker", "offset", "item", "replica"])

    return events.groupBy("collection", "partition").applyInPandasWithState(step, OUT, "state string", "append", GroupStateTimeout.NoTimeout)
