"""Schemas of the engine's tables, and the configuration of collections."""

from __future__ import annotations

import tomllib
from dataclasses import asdict, dataclass, field, fields
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession

MESSAGE = "topic string, partition int, offset long, key binary, value binary, timestamp timestamp"
POINTER = "dst struct<collection:string,id:string>, timestamp timestamp"
RESULT = "locator struct<collection:string,id:string>, finish_time timestamp, worker_id long, status int"
ITEMS = "item_id string, found_t timestamp, last_update timestamp, updates long"
QUEUE = "worker long, offset long, item string, exp_time long"
QUEUE_RESULT = "worker long, offset long, item string, status int, exp_time long"
REPORT = "worker long, offset long, status int"
TOKENS = "id binary, worker_id long, created_at timestamp, last_used_at timestamp, token_bit string, description string"
TOPOLOGY = "name string, pk_type string, task_assignments int, assign_batch int, deliver_batch int, session_timeout long, task_timeout long"

SUCCESS, CLIENT_FAILURE, TIMEOUT = 0, 1, 2


def seconds(text: str | int | float) -> float:
    """A duration as '250ms', '5m' or '1h30m', or a number of seconds."""
    if isinstance(text, int | float):
        return float(text)
    units = {"ms": 0.001, "s": 1.0, "m": 60.0, "h": 3600.0}
    total, rest = 0.0, text.strip()
    while rest:
        n = len(rest) - len(rest.lstrip("0123456789."))
        unit = rest[n : n + 2] if rest[n : n + 2] == "ms" else rest[n : n + 1]
        if not n or unit not in units:
            raise ValueError(f"not a duration: {text!r}")
        total += float(rest[:n]) * units[unit]
        rest = rest[n + len(unit) :]
    return total


def _duration(text: str):
    return field(default=timedelta(seconds=seconds(text)), metadata={"duration": True})


@dataclass(frozen=True)
class CollectionConfig:
    """A collection's knobs. The defaults are fixed values of the engine's interface."""

    name: str
    pk_type: str = "BIGINT"
    task_assignments: int = 3
    assign_interval: timedelta = _duration("250ms")
    assign_batch: int = 1024
    session_timeout: timedelta = _duration("5m")
    session_refresh_interval: timedelta = _duration("3s")
    session_expire_interval: timedelta = _duration("10s")
    session_expire_batch: int = 16
    task_timeout: timedelta = _duration("60s")
    task_expire_batch: int = 128
    deliver_batch: int = 1024
    result_interval: timedelta = _duration("2s")
    result_batch: int = 128
    result_backoff: timedelta = _duration("10s")

    @classmethod
    def of(cls, values: dict) -> CollectionConfig:
        known = {f.name: f for f in fields(cls)}
        if odd := set(values) - set(known):
            raise ValueError(f"unknown settings: {sorted(odd)}")
        return cls(**{k: timedelta(seconds=seconds(v)) if known[k].metadata.get("duration") else v for k, v in values.items()})


@dataclass(frozen=True)
class Topology:
    collections: tuple[CollectionConfig, ...]

    def get(self, name: str) -> CollectionConfig | None:
        """The first collection of that name, or None."""
        return next((c for c in self.collections if c.name == name), None)

    def to_df(self, spark: SparkSession) -> DataFrame:
        """One row a collection, in order: position and every knob, durations in seconds."""
        rows = [{"position": i} | {k: v.total_seconds() if isinstance(v, timedelta) else v for k, v in asdict(c).items()} for i, c in enumerate(self.collections)]
        kinds = {int: "long", str: "string", float: "double"}
        names = ["position", *(f.name for f in fields(CollectionConfig))]
        sample = {"position": 0} | {k: v.total_seconds() if isinstance(v, timedelta) else v for k, v in asdict(CollectionConfig("x")).items()}
        schema = ", ".join(f"{n} {kinds[type(sample[n])]}" for n in names)
        return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], schema)


def read_topology(text: str) -> Topology:
    """From TOML with a list of tables [[collections]]; what is missing takes its default."""
    return Topology(tuple(CollectionConfig.of(c) for c in tomllib.loads(text).get("collections", [])))
