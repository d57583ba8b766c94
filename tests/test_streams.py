"""State of streams over several batches and restarts."""

import tempfile
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from reportlake.streaming import intake, state

START = datetime(2024, 1, 1)


@pytest.fixture()
def folders():
    return tempfile.mkdtemp(prefix="stream-in-"), tempfile.mkdtemp(prefix="stream-out-")


def put(spark, where, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(where)


def test_last_n_over_batches_and_a_restart(spark, folders):
    source, out = folders
    schema = "k string, at int, v string"
    fed = []
    for batch in range(4):
        rows = [("a", 10 * batch + i, f"a{10 * batch + i}") for i in range(3)] + ([("b", batch, f"b{batch}")] if batch % 2 else []) + [(None, batch, f"n{batch}")]
        # the second batch brings old values, too
        rows += [("a", -1, "old")] if batch == 1 else []
        put(spark, source, rows, schema)
        fed += rows
        stream = spark.readStream.schema(schema).parquet(source)
        got = intake.table_run(state.last_n(stream, "k", "at", "v", 4), out, ["k"])
        want = {k: [v for _, v in sorted((o, v) for kk, o, v in fed if kk == k)[-4:]] for k in {r[0] for r in fed}}
        assert {r.k: (r.n, r["last"]) for r in got.collect()} == {k: (len(v), v) for k, v in want.items()}


def test_values_with_a_time_to_live(spark, folders):
    source, out = folders
    put(spark, source, [("a", 1, "x"), ("a", 2, "y")], "k string, at int, v string")
    stream = spark.readStream.schema("k string, at int, v string").parquet(source)
    got = intake.table_run(state.last_n(stream, "k", "at", "v", 4, ttl_s=3600), out, ["k"])
    assert [(r.k, r["last"]) for r in got.collect()] == [("a", ["x", "y"])]


def beats(*rows):
    return [(k, e, START + timedelta(minutes=m)) for k, e, m in rows]


def test_deadline_ends_a_wait_without_an_event(spark, folders):
    source, out = folders
    schema = "k string, agent string, ts timestamp"

    def run():
        stream = spark.readStream.schema(schema).parquet(source)
        waits = state.ready_by_deadline(stream, "k", "agent", "ts", 2, 600, "1 minute")
        return {r.k: (r.n, r.elapsed_ms, r.timed_out) for r in intake.table_run(waits, out).collect()}

    put(spark, source, beats(("ready", "x", 0), ("ready", "x", 1), ("ready", "y", 4), ("late", "x", 0), ("open", "x", 3)), schema)
    assert run() == {"ready": (2, 240_000, False)}
    # a second agent after the deadline; only another key's events move the clock
    put(spark, source, beats(("other", "x", 12), ("ready", "z", 12)), schema)
    assert run() == {"ready": (2, 240_000, False), "late": (1, 600_000, True)}
    put(spark, source, beats(("late", "y", 13), ("open", "y", 14), ("other", "x", 13), ("clock", "x", 60)), schema)
    got = run()
    assert got["open"] == (1, 600_000, True) and got["other"] == (1, 600_000, True)
    assert got["late"] == (1, 600_000, True) and got["ready"] == (2, 240_000, False) and "clock" not in got


def test_events_out_of_order_count_by_their_time(spark, folders):
    source, out = folders
    schema = "k string, agent string, ts timestamp"
    put(spark, source, beats(("a", "x", 9), ("b", "x", 11)), schema)
    stream = spark.readStream.schema(schema).parquet(source)
    wait = lambda: intake.table_run(state.ready_by_deadline(stream, "k", "agent", "ts", 2, 600, "1 hour"), out).collect()
    assert wait() == []
    put(spark, source, beats(("a", "y", 0), ("b", "y", 0)), schema)
    assert [(r.k, r.n, r.elapsed_ms, r.timed_out) for r in wait()] == [("a", 2, 540_000, False)]


def test_latest_of_a_stream_is_kept(spark, folders):
    source, out = folders
    put(spark, source, [("a", "RUNNING", 1), ("a", "DONE", 2), ("a", "RUNNING", 3)], "k string, v string, at int")
    stream = spark.readStream.schema("k string, v string, at int").parquet(source)
    got = intake.table_run(intake.latest_by_key(stream, "k", "v", "at", ("DONE",)), out, ["k"])
    assert [(r.k, r.v) for r in got.select("k", F.col("v")).collect()] == [("a", "DONE")]


def test_state_is_visited_once_for_each_entity():
    class Fake(dict):
        visits = 0

        def containsKey(self, k):
            Fake.visits += 1
            return k in self

        getValue, updateValue = dict.__getitem__, dict.__setitem__

    class Cell:
        held = None
        exists = lambda self: self.held is not None
        get = lambda self: self.held
        update = lambda self, x: setattr(self, "held", x)

    class Handle:
        listTimers = lambda self: []
        registerTimer = lambda self, at: None

    p = state._Deadline("k", "e", 3, 1000)
    p.handle, p.seen, p.first = Handle(), Fake(), Cell()
    rows = [{"at_ms": 5000 - i, "e": "ab"[i % 2]} for i in range(4000)]
    assert list(p.handleInputRows((7,), iter(rows), None)) == []
    assert dict(p.seen) == {("a",): (1002,), ("b",): (1001,)} and p.first.held == (1001, False)
    assert Fake.visits <= 4
    (row,) = p.handleInputRows((7,), iter([{"at_ms": 1500, "e": "c"}]), None)
    assert (row.n, row.elapsed_ms, row.timed_out) == (3, 499, False)
