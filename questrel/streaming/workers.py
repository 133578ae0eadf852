"""Workers as a stateful stream: sessions, queue, acknowledgements and expiry of each, results out."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..model import TIMEOUT
from ..operators.sessions import batches, watchdog_sleep

EVENTS = "worker long, seq long, time long, kind string, session long, offset long, item string, exp_time long, status int"
OUT = "worker long, offset long, item string, status int, exp_time long"


@dataclass
class WorkerState:
    serial: int = 0
    sessions: dict[int, int] = field(default_factory=dict)  # id to exp_time
    queue: dict[int, tuple[str, int]] = field(default_factory=dict)  # offset to item and exp_time

    def dump(self) -> str:
        return json.dumps([self.serial, self.sessions, self.queue])

    @classmethod
    def load(cls, text: str) -> WorkerState:
        serial, sessions, queue = json.loads(text)
        return cls(serial, {int(k): v for k, v in sessions.items()}, {int(k): tuple(v) for k, v in queue.items()})

    def _end(self, offsets: list[int]) -> list[tuple]:
        return [(o, item, TIMEOUT, exp) for o in offsets for item, exp in [self.queue.pop(o)]]

    def expire(self, now: int) -> list[tuple]:
        """Tasks at the queue's head and sessions that ended before now; without sessions, the whole queue."""
        out = []
        while self.queue and self.queue[head := min(self.queue)][1] < now:
            out += self._end([head])
        had = bool(self.sessions)
        self.sessions = {s: e for s, e in self.sessions.items() if e >= now}
        if had and not self.sessions:
            out += self._end(sorted(self.queue))
        return out

    def apply(self, time: int, kind: str, session: int | None, offset: int | None, item: str | None, exp_time: int | None, status: int | None, timeout: int) -> list[tuple]:
        """One event, after what has expired by its time. Kinds: open, refresh, close, assign, ack."""
        out = self.expire(time)
        if kind == "open":
            self.serial += 1
            self.sessions[self.serial] = time + timeout
        elif kind == "refresh":
            if session in self.sessions:
                self.sessions[session] = time + timeout
        elif kind == "close":
            if self.sessions.pop(session, None) is not None and not self.sessions:
                out += self._end(sorted(self.queue))
        elif kind == "assign":
            self.queue[offset] = (item, exp_time)
        elif kind == "ack":
            if offset in self.queue:
                item, exp = self.queue.pop(offset)
                out.append((offset, item, status, exp))
        else:
            raise ValueError(f"unknown event: {kind}")
        return out

    def next_time(self) -> int:
        """The earliest time at which something here expires, 0 for never."""
        head = [self.queue[min(self.queue)][1]] if self.queue else []
        return min([*self.sessions.values(), *head], default=0)


def _int(x) -> int | None:
    return None if pd.isna(x) else int(x)


def results(events: DataFrame, timeout: int = 300, timers: bool = True) -> DataFrame:
    """events (EVENTS) to results (OUT): acknowledged, expired and dead-lettered tasks.

    A worker's events count in order of seq within a micro-batch. Time is theirs; with timers, a silent
    worker's state is also looked at when its next expiry has passed by the clock.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], group: GroupState) -> Iterator[pd.DataFrame]:
        state = WorkerState.load(group.get[0]) if group.exists else WorkerState()
        out: list[tuple] = []
        now = group.getCurrentProcessingTimeMs() // 1000
        if group.hasTimedOut:
            out += state.expire(now)
        else:
            for r in pd.concat(list(frames)).sort_values("seq").itertuples():
                out += state.apply(int(r.time), r.kind, _int(r.session), _int(r.offset), r.item, _int(r.exp_time), _int(r.status), timeout)
        group.update((state.dump(),))
        if timers and (at := state.next_time()):
            group.setTimeoutDuration(max(1000, int(1000 * watchdog_sleep(at + 1, now))))
        yield pd.DataFrame([(*key, *r) for r in out], columns=["worker", "offset", "item", "status", "exp_time"])

    kind = GroupStateTimeout.ProcessingTimeTimeout if timers else GroupStateTimeout.NoTimeout
    return events.groupBy("worker").applyInPandasWithState(step, OUT, "state string", "append", kind)


def push(delivered: DataFrame, send: Callable[[int, int, list], None], checkpoint: str, every: str | None = None):
    """A stream of delivered rows to workers: send(worker, session, assignments), called on the executors once
    for each session of a micro-batch, in order of offset."""

    def rows(part: Iterator) -> None:
        for r in part:
            send(r.worker, r.session, [a.asDict() for a in r.assignments])

    w = delivered.writeStream.foreachBatch(lambda batch, _: batches(batch).foreachPartition(rows)).option("checkpointLocation", checkpoint)
    return (w.trigger(processingTime=every) if every else w.trigger(availableNow=True)).start()
