"""N-Assign: give each task of a shard to N distinct workers, the least advanced first, within quotas."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

OK, SEEK, NO_WORKERS = "OK", "SEEK", "NO_WORKERS"


@dataclass
class ShardState:
    """What a shard remembers between batches.

    quota: what each worker may still take. active: workers that may be chosen. last: the last offset each
    worker took (-1: none). progress: the last offset placed in full (None: none yet). placed: workers that
    an unfinished offset already has.
    """

    quota: dict[int, int] = field(default_factory=dict)
    last: dict[int, int] = field(default_factory=dict)
    active: set[int] = field(default_factory=set)
    progress: int | None = None
    placed: dict[int, list[int]] = field(default_factory=dict)

    def grant(self, worker: int, n: int) -> None:
        self.quota[worker] = self.quota.get(worker, 0) + n
        self.last.setdefault(worker, -1)
        if self.quota[worker] > 0:
            self.active.add(worker)

    def remove(self, worker: int) -> None:
        self.active.discard(worker)
        self.quota.pop(worker, None)


def assign(state: ShardState, tasks: Iterator[tuple[int, str]], n: int, compat: str = "intended") -> Iterator[tuple[int, int, str, int]]:
    """Yields (worker, offset, item, replica) and returns the code; updates state as it goes.

    Each replica goes to the active worker with the least (last offset, id). If none is left, or the least
    has already had this offset or a later one, the fold stops with NO_WORKERS and keeps the replicas that
    it placed. "intended": offsets up to the progress are passed over, and an unfinished offset gets what
    lacks to n. "as_written": an offset equal to the progress is placed again, one below it stops the fold
    with SEEK, and an unfinished offset counts as having the replicas it had when its last turn began, plus one.
    """
    heap = [(state.last.get(w, -1), w) for w in state.active]
    heapify(heap)
    loose = compat == "as_written"
    for offset, item in tasks:
        if loose and offset < (state.progress or 0):
            return SEEK
        if not loose and state.progress is not None and offset <= state.progress:
            continue
        had = state.placed.get(offset, [])
        for replica in range(len(had), n):
            if not heap or heap[0][0] >= offset:
                return NO_WORKERS
            _, w = heappop(heap)
            state.last[w] = offset
            state.quota[w] -= 1
            if state.quota[w] > 0:
                heappush(heap, (offset, w))
            else:
                state.active.discard(w)
            state.placed[offset] = had + [w] if loose else [*state.placed.get(offset, []), w]
            yield w, offset, item, replica
        state.progress = offset
        state.placed.pop(offset, None)
    return OK


def _fold(n: int, compat: str, batches):
    """Rows sorted by shard, then workers before tasks, then offset: one pass that holds a shard's workers only."""
    names = ["collection", "partition", "worker", "offset", "item", "replica", "code", "progress", "assigns"]
    kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int64()]

    def rows():
        for b in batches:
            yield from zip(*(b.column(c).to_pylist() for c in ("collection", "partition", "kind", "offset", "item", "worker", "quota")), strict=True)

    def shards():
        source = rows()
        row = next(source, None)
        while row is not None:
            shard, state, previous = row[:2], ShardState(), None
            while row is not None and row[:2] == shard and row[2] == 0:
                state.grant(row[5], row[6])
                state.last[row[5]] = row[3]
                row = next(source, None)

            def tasks():
                nonlocal row, previous
                while row is not None and row[:2] == shard:
                    if previous is not None and row[3] <= previous:
                        raise ValueError(f"offsets must rise: {row[3]} after {previous}")
                    previous = row[3]
                    offset, item = row[3], row[4]
                    if row[5]:
                        state.placed[offset] = [-1] * row[5]
                    row = next(source, None)
                    yield offset, item

            fold, count = assign(state, tasks(), n, compat), 0
            while True:
                try:
                    w, offset, item, replica = next(fold)
                except StopIteration as end:
                    code = end.value
                    break
                count += 1
                yield (*shard, w, offset, item, replica, None, None, None)
            while row is not None and row[:2] == shard:  # what no worker was left for
                row = next(source, None)
            yield (*shard, None, None, None, None, code, state.progress, count)

    held = []
    for r in shards():
        held.append(r)
        if len(held) >= 8192:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names)


SHARD = ["collection", "partition"]
RANGE = 1 << 17  # tasks of a shard that are ranked in one sort, about


def _tasks(tasks: DataFrame) -> DataFrame:
    placed = F.col("placed") if "placed" in tasks.columns else F.lit(None)
    return tasks.select("collection", F.col("partition").cast("int").alias("partition"), F.col("offset").cast("long").alias("offset"), F.col("item").cast("string").alias("item"), placed.cast("long").alias("placed"))


def _workers(workers: DataFrame) -> DataFrame:
    last = F.coalesce("last_offset", F.lit(-1)) if "last_offset" in workers.columns else F.lit(-1)
    quota = F.col("quota") if "quota" in workers.columns else F.lit(None)
    return workers.select("collection", F.col("partition").cast("int").alias("partition"), F.col("worker").cast("long").alias("worker"), quota.cast("long").alias("quota"), last.cast("long").alias("last"))


def _extent(t: DataFrame) -> DataFrame:
    """For each shard the number of its tasks, and its first and last offset."""
    return t.groupBy(*SHARD).agg(F.count("*").alias("t"), F.count("offset").alias("known"), F.min("offset").alias("lo"), F.max("offset").alias("hi"), F.coalesce(F.max("placed"), F.lit(0)).alias("placed"))


def _even(t: DataFrame, w: DataFrame, shards: DataFrame, n: int) -> DataFrame:
    """The assignments of shards (collection, partition, w workers, t tasks, lo, hi), in each of which n divides w.

    A task's place is its rank in a range of its shard's offsets plus the tasks of the ranges before, so a shard with
    most tasks is sorted in as many parts as it has RANGE tasks. A log's offsets are dense; gaps make ranges uneven,
    no more. An offset that occurs twice in a shard is an error, as in the fold.
    """
    d = t.join(shards.select(*SHARD, "w", "t", "lo", "hi"), SHARD)
    d = d.withColumn("range", F.expr(f"(offset - lo) div ((hi - lo) div ((t + {RANGE - 1}) div {RANGE}) + 1)"))
    before = d.groupBy(*SHARD, "range").agg(F.count("*").alias("c"))
    before = before.select(*SHARD, "range", (F.sum("c").over(Window.partitionBy(*SHARD).orderBy("range")) - F.col("c")).alias("before"))
    ranked = w.select(*SHARD, "worker", (F.row_number().over(Window.partitionBy(*SHARD).orderBy("worker")) - 1).alias("place"))
    order = Window.partitionBy(*SHARD, "range").orderBy("offset")
    d = d.withColumn("rank", F.row_number().over(order) - 1).withColumn("previous", F.lag("offset").over(order)).join(before, [*SHARD, "range"])
    twice = F.raise_error(F.concat(F.lit("offsets must rise: "), F.col("offset").cast("string"), F.lit(" occurs twice")))
    d = d.withColumn("s", F.when(F.col("offset") == F.col("previous"), twice.cast("long")).otherwise(F.col("before") + F.col("rank")))
    d = d.withColumn("replica", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("place", ((F.col("s") * n + F.col("replica")) % F.col("w")).cast("int"))
    return d.join(ranked, [*SHARD, "place"]).select(*SHARD, "worker", "offset", "item", "replica")


def nassign(tasks: DataFrame, workers: DataFrame, n: int = 3, compat: str = "intended", closed: bool = True) -> tuple[DataFrame, DataFrame]:
    """Assignments (collection, partition, worker, offset, item, replica) and a status row for each shard
    (collection, partition, code, progress, assigns).

    tasks: collection, partition, offset, item, and placed, the replicas that an earlier fold placed of it, if known.
    workers: collection, partition, worker, quota, and last_offset if known.

    Shards where n divides the number of workers, all workers stand at one offset below the tasks', the least quota
    lasts and nothing is half placed go by the closed form of nassign_even(), which needs no fold; closed=False folds
    them as well, with the same result, which is less work for a few tasks. The fold is sequential within a shard, as
    its definition is; shards run in parallel, each as a stream of sorted rows, so memory holds a shard's workers and
    not its tasks.
    """
    if compat not in ("intended", "as_written"):
        raise ValueError(compat)
    t, w = _tasks(tasks), _workers(workers)
    if not closed:
        return _folded(t, w, n, compat)
    each = w.groupBy(*SHARD, "worker").agg(F.count("*").alias("c"), F.min(F.coalesce("quota", F.lit(0))).alias("quota"), F.min("last").alias("last"))
    able = each.groupBy(*SHARD).agg(F.count("*").alias("w"), F.count("worker").alias("named"), F.max("c").alias("c"), F.min("quota").alias("quota"), F.min("last").alias("low"), F.max("last").alias("high"))
    able = _extent(t).join(able, SHARD).where(f"known = t and placed <= 0 and named = w and c = 1 and w % {n} = 0 and low = high and high < lo and lo >= 0 and quota > 0 and (t * {n} + w - 1) div w <= quota")
    key = able.select(*SHARD)
    found, status = _folded(t.join(key, SHARD, "left_anti"), w.join(key, SHARD, "left_anti"), n, compat)
    done = able.select(*SHARD, F.lit(OK).alias("code"), F.col("hi").alias("progress"), (F.col("t") * n).alias("assigns"))
    return found.unionByName(_even(t, w, able, n)), status.unionByName(done)


def _folded(tasks: DataFrame, workers: DataFrame, n: int, compat: str) -> tuple[DataFrame, DataFrame]:
    w = workers.select(*SHARD, F.lit(0).alias("kind"), F.col("last").alias("offset"), F.lit(None).cast("string").alias("item"), "worker", "quota")
    t = tasks.select(*SHARD, F.lit(1).alias("kind"), "offset", "item", F.col("placed").alias("worker"), F.lit(None).cast("long").alias("quota"))
    schema = "collection string, partition int, worker long, offset long, item string, replica int, code string, progress long, assigns long"
    out = w.unionByName(t).repartition(*SHARD).sortWithinPartitions(*SHARD, "kind", "offset").mapInArrow(partial(_fold, n, compat), schema)
    return out.where("code is null").drop("code", "progress", "assigns"), out.where("code is not null").select(*SHARD, "code", "progress", "assigns")


def nassign_even(tasks: DataFrame, workers: DataFrame, n: int) -> DataFrame:
    """The same assignments where n divides the number of a shard's workers and quotas don't run out: replica r
    of the task at place s goes to worker (s * n + r) modulo their number. No fold and no Python.

    A shard with another number of workers raises an error.
    """
    t, w = _tasks(tasks), _workers(workers)
    count = w.groupBy(*SHARD).agg(F.count("*").alias("w"))
    wrong = F.raise_error(F.lit(f"{n} must divide a shard's workers")).cast("long")
    return _even(t, w, _extent(t).join(count.withColumn("w", F.when(F.col("w") % n == 0, F.col("w")).otherwise(wrong)), SHARD), n)


def progress(assignments: DataFrame, n: int) -> DataFrame:
    """Each shard's last offset with all its n replicas."""
    full = assignments.groupBy("collection", "partition", "offset").agg(F.count("*").alias("c")).where(F.col("c") >= n)
    return full.groupBy("collection", "partition").agg(F.max("offset").alias("progress"))


def stale(tasks: DataFrame, progressed: DataFrame) -> DataFrame:
    """Tasks behind their shard's progress."""
    return tasks.join(progressed, ["collection", "partition"]).where("offset < progress").drop("progress")


def checked_offsets(tasks: DataFrame) -> DataFrame:
    """tasks; reading them raises an error where a shard's offsets don't rise with seq."""
    w = Window.partitionBy("collection", "partition").orderBy("seq")
    ok = F.col("offset") > F.coalesce(F.lag("offset").over(w), F.lit(-1))
    return tasks.withColumn("offset", F.when(ok, F.col("offset")).otherwise(F.raise_error(F.concat(F.lit("offsets must rise: "), F.col("offset").cast("string")))))
