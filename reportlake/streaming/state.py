"""Keyed state with timers and lists: who has checked in by a deadline, and the last values of a key."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: Entities of a key that are in memory before they go to the state.
HELD = 10_000


def with_state_store(spark: SparkSession) -> None:
    """State of this kind is kept in RocksDB, on disk and by key."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


class _Deadline(StatefulProcessor):
    """First sighting of each entity of a key, the key's first time, and whether it is settled."""

    def __init__(self, key: str, entity: str, least: int, timeout_ms: int):
        self.key, self.entity, self.least, self.timeout = key, entity, least, timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getMapState("seen", "entity string", "at long")
        self.first = handle.getValueState("first", "at long, settled boolean")

    def _note(self, fresh: dict[str, int]) -> None:
        for entity, at in fresh.items():
            if not self.seen.containsKey((entity,)) or at < self.seen.getValue((entity,))[0]:
                self.seen.updateValue((entity,), (at,))
        fresh.clear()

    def _in_time(self, first: int) -> list[int]:
        """Times of the entities that came by the deadline, in order."""
        return sorted(at[0] for at in self.seen.values() if at[0] <= first + self.timeout)

    def _row(self, key, times: list[int], first: int, timed_out: bool) -> Row:
        elapsed = self.timeout if timed_out else times[self.least - 1] - first
        return Row(**{self.key: key[0], "n": len(times) if timed_out else self.least, "elapsed_ms": elapsed, "timed_out": timed_out})

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        known = self.first.get() if self.first.exists() else None
        if known is not None and known[1]:
            return
        first = known[0] if known is not None else None
        # a visit to the state is a call to the executor: one for each entity, not for each row
        fresh: dict[str, int] = {}
        for r in rows:
            at, entity = r["at_ms"], str(r[self.entity])
            first = at if first is None or at < first else first
            if at < fresh.get(entity, at + 1):
                fresh[entity] = at
                if len(fresh) >= HELD:
                    self._note(fresh)
        self._note(fresh)
        if known is None or first < known[0]:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(first + self.timeout + 1)
        times = self._in_time(first)
        settled = len(times) >= self.least
        self.first.update((first, settled))
        if settled:
            self.seen.clear()
            yield self._row(key, times, first, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        first, settled = self.first.get()
        times = [] if settled else self._in_time(first)
        self.seen.clear()
        # a key that is settled stays so: what comes later starts no new wait
        self.first.update((first, True))
        if not settled:
            yield self._row(key, times, first, True)

    def close(self) -> None:
        pass


def ready_by_deadline(stream: DataFrame, key: str, entity: str, ts: str, least: int, timeout_s: int, watermark: str) -> DataFrame:
    """key, n, elapsed_ms, timed_out: one row for each key as soon as ``least`` distinct entities have been seen within ``timeout_s`` of its first event, or else when that time is over.

    The row of a key that waits in vain needs no event of its own: a timer ends it when the watermark has passed its deadline. A ready key has n = ``least`` and the
    time of the entity that made it so; of a late one n counts those that came in time. Events out of order within the watermark count by their time.
    """
    with_state_store(stream.sparkSession)
    kind = stream.schema[key].dataType.simpleString()
    rows = stream.withWatermark(ts, watermark).select(key, entity, ts, F.unix_millis(ts).alias("at_ms"))
    return rows.groupBy(key).transformWithState(
        _Deadline(key, entity, least, timeout_s * 1000), f"{key} {kind}, n int, elapsed_ms long, timed_out boolean", "Append", "EventTime")


class _LastN(StatefulProcessor):
    """A list of the last values: new ones are appended, and the list is cut when it has twice as many as are asked for."""

    def __init__(self, key: str, order: str, value: str, n: int, ttl_ms: int | None):
        self.key, self.order, self.value, self.n, self.ttl = key, order, value, n, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.items = handle.getListState("items", "at long, value string", self.ttl)
        self.held = handle.getValueState("held", "n int", self.ttl)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held = self.held.get()[0] if self.held.exists() else 0
        fresh: list[tuple[int, str]] = []
        for r in rows:
            fresh.append((r[self.order], r[self.value]))
            if len(fresh) >= 4 * self.n:
                fresh = sorted(fresh, key=lambda x: x[0])[-self.n :]
        kept = [tuple(x) for x in self.items.get()] if held else []
        last = sorted([*kept, *fresh], key=lambda x: x[0])[-self.n :]
        if held + len(fresh) > 2 * self.n:
            self.items.put(last)
            held = len(last)
        else:
            self.items.appendList(fresh)
            held += len(fresh)
        self.held.update((held,))
        yield Row(**{self.key: key[0], "n": len(last), "last": [v for _, v in last]})

    def close(self) -> None:
        pass


def last_n(stream: DataFrame, key: str, order: str, value: str, n: int = 8, ttl_s: int | None = None) -> DataFrame:
    """key, n, last: the n last values of each key by ``order``, oldest first, whenever the key gets new ones.

    State is a list of at most 2 n values a key, to which new ones are appended. With ``ttl_s`` values that are older than that many seconds of processing time go by themselves.
    """
    with_state_store(stream.sparkSession)
    kind = stream.schema[key].dataType.simpleString()
    rows = stream.select(key, stream[order].cast("long").alias(order), value)
    mode = "ProcessingTime" if ttl_s else "None"
    return rows.groupBy(key).transformWithState(_LastN(key, order, value, n, ttl_s * 1000 if ttl_s else None), f"{key} {kind}, n int, last array<string>", "Update", mode)
