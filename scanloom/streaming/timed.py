"""Each file's inspection as a stream with typed state and a timer for runs that hang."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from scanloom.operators.folds import Machine
from scanloom.operators.requests import INSPECTION

COUNTS = (*INSPECTION.counts, "expired")
STATE = "state string, heard long, " + ", ".join(f"{c} long" for c in COUNTS)
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _timed(state: str, event: str) -> tuple[str, tuple[str, ...]]:
    if event == "expired":
        return ("absent", ("expired",)) if state == "running" else (state, ())
    return INSPECTION.step(state, event)


#: The inspection's machine with one more event: nothing was heard for too long.
TIMED = Machine(INSPECTION.states, (*INSPECTION.events, "expired"), COUNTS, _timed)
STEPS = {(s, e): TIMED.step(s, e) for s in TIMED.states for e in TIMED.events}


class _Inspection(StatefulProcessor):
    """Folds a file's new events into its state; a run from which nothing is heard for
    ``seconds`` is given up, by the gap to its next event or else by a timer."""

    def __init__(self, seconds: int):
        self.millis = seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.own = handle.getValueState("inspection", STATE)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        # Files have few new events each, so that a call costs more than its events.
        new = [(seq is None, seq or 0, event is None, event or "", at) for seq, event, at in ((r["seq"], r["event"], r["_at"]) for r in rows)]
        new.sort(key=lambda r: r[:4])
        state, heard, *counts = self.own.get() or ("absent", None, *[0] * len(COUNTS))
        timer = self._timer(state, heard)
        for _, _, _, event, at in new:
            quiet = heard is not None and at is not None and at - heard > self.millis
            for e in ("expired", event) if quiet else (event,):
                state, names = STEPS.get((state, e), (state, ()))
                for name in names:
                    counts[COUNTS.index(name)] += 1
            heard = at
        yield self._keep(key, timer, state, heard, counts)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[Row]:
        state, heard, *counts = self.own.get()
        timer = self._timer(state, heard)
        if timer is not None and expiredTimerInfo.getExpiryTimeInMs() >= timer:
            yield self._keep(key, timer, "absent", heard, [*counts[:-1], counts[-1] + 1])

    def _timer(self, state: str, heard: int | None) -> int | None:
        """When a file's one timer expires, if it has one."""
        return heard + self.millis + 1 if state == "running" and heard is not None else None

    def _keep(self, key: tuple, before: int | None, state: str, heard: int | None, counts: list[int]) -> Row:
        after = self._timer(state, heard)
        if before != after:
            if before is not None:
                self.handle.deleteTimer(before)
            if after is not None:
                self.handle.registerTimer(after)
        self.own.update((state, heard, *counts))
        return Row(**dict(zip(("file", "state", *COUNTS), (key[0], state, *counts), strict=True)))

    def close(self) -> None:
        pass


def inspections(log: DataFrame, seconds: int, late: str = "0 seconds") -> DataFrame:
    """State and counts of each file whenever they change, from a stream of (file, seq, ts,
    event): as inspection_log() has them, but a run of whose file nothing is heard for more
    than ``seconds`` is forgotten and counted as expired.  Rows later than ``late`` are left
    out by the watermark.  The session needs a RocksDB state store (PROVIDER).
    """
    kind = dict(log.dtypes)["file"]
    at = F.col("ts").cast("timestamp")
    rows = log.select("file", "seq", at.alias("ts"), "event", F.unix_millis(at).alias("_at")).withWatermark("ts", late)
    out = f"file {kind}, state string, " + ", ".join(f"{c} long" for c in COUNTS)
    return rows.groupBy("file").transformWithState(_Inspection(seconds), out, "update", "eventTime")
