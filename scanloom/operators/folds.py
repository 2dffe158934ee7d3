"""Finite machines over each key's ordered events, as an associative fold.

What a run of events does is a map from every state to the state after it and to what was
counted on the way.  Maps of neighbouring runs compose, so a key's log can be cut anywhere:
tasks fold their range of (key, seq) to one map a key, and only the keys that touch the
border of a range, two of each, are composed further, range by range of ranges.  A key that
holds nearly all events is thus folded by as many tasks as its rows fill.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanloom.sources.shared import written

#: Events of a range at least, and border maps that one range composes.
RANGE_ROWS = 100_000
RANGE_MAPS = 4096


@dataclass(frozen=True)
class Machine:
    """``step(state, event)`` gives the next state and the names counted; an event that is
    none of ``events`` changes nothing."""

    states: tuple[str, ...]
    events: tuple[str, ...]
    counts: tuple[str, ...]
    step: Callable[[str, str], tuple[str, tuple[str, ...]]]

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """Next state [event, state] and counts [event, state, name]; the last event is none."""
        shape = (len(self.events) + 1, len(self.states))
        to = np.tile(np.arange(shape[1]), (shape[0], 1))
        seen = np.zeros((*shape, len(self.counts)), np.int64)
        for e, event in enumerate(self.events):
            for s, state in enumerate(self.states):
                after, names = self.step(state, event)
                to[e, s] = self.states.index(after)
                for name in names:
                    seen[e, s, self.counts.index(name)] += 1
        return to, seen


def composed(to: np.ndarray, seen: np.ndarray, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One map for each run of maps (``runs`` their lengths, none 0), composed pairwise in a tree."""
    while (runs > 1).any():
        at = np.arange(len(to)) - np.repeat(np.cumsum(runs) - runs, runs)
        left = np.flatnonzero(at % 2 == 0)
        has = at[left] + 1 < np.repeat(runs, runs)[left]
        a_to, a_seen, b = to[left].copy(), seen[left].copy(), left[has] + 1
        rows = np.arange(len(b))[:, None]
        a_seen[has] += seen[b][rows, a_to[has]]
        a_to[has] = to[b][rows, a_to[has]]
        to, seen, runs = a_to, a_seen, (runs + 1) // 2
    return to, seen


def _folded(batches: Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """(keys, to, seen) with one map a key, from batches of sorted keys and their maps; the
    last key of a batch waits for the next one."""
    wait = None
    for keys, to, seen in batches:
        if wait is not None:
            keys, to, seen = pa.concat_arrays([wait[0], keys]), np.concatenate([wait[1], to]), np.concatenate([wait[2], seen])
        coded = keys.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        first = np.flatnonzero(np.r_[True, coded[1:] != coded[:-1]])
        runs = np.diff(np.r_[first, len(coded)])
        to, seen = composed(to, seen, runs)
        keys = keys.take(pa.array(first))
        wait = keys.slice(len(keys) - 1), to[-1:], seen[-1:]
        if len(keys) > 1:
            yield keys.slice(0, len(keys) - 1), to[:-1], seen[:-1]
    if wait is not None:
        yield wait


def fold(log: DataFrame, key: str, order: list[str], event: str, machine: Machine, start: str, rows: int = RANGE_ROWS, maps: int = RANGE_MAPS) -> DataFrame:
    """Per key what was counted and ``state`` after its events in order, from ``start``.

    Rows without a key are a key of their own; equal places are taken in order of the event.
    Other columns are not read; an empty log gives no rows.
    """
    to, seen = machine.tables()
    s, c = len(machine.states), len(machine.counts)
    kind = dict(log.dtypes)[key]
    names = {x: i for i, x in enumerate(machine.events)}
    schema = f"`_key` {kind}, `_part` int, `_border` boolean, `_to` array<int>, `_seen` array<long>"

    def run(read: Callable[[pa.RecordBatch], tuple[pa.Array, np.ndarray, np.ndarray]]) -> Callable:
        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part, held, first = TaskContext.get().partitionId(), None, True
            for found in _folded(read(b) for b in batches if b.num_rows):
                if held is not None:
                    yield told(held, part, first)
                    first = False
                held = found
            if held is not None:
                yield told(held, part, first, last=True)

        return task

    def told(found: tuple[pa.Array, np.ndarray, np.ndarray], part: int, first: bool, last: bool = False) -> pa.RecordBatch:
        keys, own_to, own_seen = found
        n = len(keys)
        border = np.zeros(n, bool)
        border[:1] |= first
        border[n - 1 :] |= last
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x.reshape(-1), t), w).cast(pa.list_(t)) for x, t, w in ((own_to, pa.int32(), s), (own_seen, pa.int64(), s * c))]
        return pa.RecordBatch.from_arrays([keys, pa.array([part] * n, pa.int32()), pa.array(border), *lists], ["_key", "_part", "_border", "_to", "_seen"])

    def events(batch: pa.RecordBatch) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        coded = batch.column(1).dictionary_encode()
        place = np.array([*(names.get(x, len(names)) for x in coded.dictionary.to_pylist()), len(names)])
        which = place[coded.indices.fill_null(len(place) - 1).to_numpy(zero_copy_only=False)]
        return batch.column(0), to[which], seen[which]

    def stored(batch: pa.RecordBatch) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        own_to, own_seen = (batch.column(i).flatten().to_numpy(zero_copy_only=False) for i in (1, 2))
        return batch.column(0), own_to.reshape(-1, s), own_seen.reshape(-1, s, c)

    spark = log.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), log.count() // rows + 1)
    keyed = log.select(F.col(key).alias("_key"), *(F.col(x).alias(f"_by{i}") for i, x in enumerate(order)), F.col(event).alias("_event"))
    by = ["_key", *(f"_by{i}" for i in range(len(order))), "_event"]
    level = written(keyed.repartitionByRange(parts, *by).sortWithinPartitions(*by).select("_key", "_event").mapInArrow(run(events), schema), "maps")
    done = level.filter("not _border")
    while True:
        border = level.filter("_border").drop("_border")
        parts = -(-border.count() // max(maps, 4)) or 1  # a range leaves two at most, so fewer ranges each time
        dealt = border.repartition(1) if parts == 1 else border.repartitionByRange(parts, "_key", "_part")
        level = written(dealt.sortWithinPartitions("_key", "_part").select("_key", "_to", "_seen").mapInArrow(run(stored), schema), "maps")
        if parts == 1:
            break
        done = done.union(level.filter("not _border"))
    from_ = machine.states.index(start)
    counted = (F.col("_seen")[from_ * c + i].alias(name) for i, name in enumerate(machine.counts))
    state = F.element_at(F.array(*(F.lit(x) for x in machine.states)), F.col("_to")[from_] + 1)
    return done.union(level).select(F.col("_key").alias(key), *counted, state.alias("state"))
