"""The session engine as a stream, split into batches with late commands, against its batch twin and a plain run."""

import random
import time

from corpusloom.sources.storage import new_path
from corpusloom.streaming import session_engine as E

MINUTE = 60_000_000


def test_state_machine():
    told = [(0, 1, "a", "start", None, 0), (1, 2, "b", "resume", None, 0), (2, 3, "b", "heartbeat", None, 0), (3, 4, "a", "checkpoint", "w1", 9), (4, 5, "a", "checkpoint", None, 5), (5, 6, "a", "start", None, 0)]
    told += [(20, 7, "b", "resume", None, 0), (21, 8, "a", "end", None, 0), (22, 9, "b", "end", None, 0), (23, 10, "c", "start", None, 0)]
    state, rows = E.run_through(E.NOTHING, [(t * MINUTE, *c) for t, *c in reversed(told)], 60 * MINUTE)
    got = [(r[0] // MINUTE, r[2], r[4], r[5], r[6], r[7]) for r in rows]
    assert got == [
        (0, "a", "started", "a", 0, 0), (1, "b", "refused", "a", 0, 0), (2, "b", "not held", "a", 0, 0), (3, "a", "recorded", "a", 1, 9), (4, "a", "recorded", "a", 1, 9), (5, "a", "attached", "a", 1, 9),
        (20, "a", "expired", None, 1, 9), (20, "b", "attached", "b", 1, 9), (21, "a", "not held", "b", 1, 9), (22, "b", "ended", None, 1, 9), (23, "c", "attached", "c", 1, 9), (38, "c", "expired", None, 1, 9),
    ]
    assert state[0] is None


def test_stream_in_late_batches_equals_the_batch(spark):
    rng = random.Random(12)
    base = 1_700_000_000_000_000
    rows = [(k, base + rng.randrange(8 * 60 * MINUTE), rng.randrange(30), rng.choice(["signup", "error", "click", "view", "purchase"]), rng.random() * 100) for k in range(900)]
    rows += [(k + 900, rows[k][1], rows[k][2], "click", 99.0) for k in range(40)]  # several at one moment
    rows.sort(key=lambda r: r[1] + rng.randrange(50 * MINUTE))  # up to 50 minutes late
    events = spark.createDataFrame(rows, "event_id long, micros long, user_id long, event_type string, value double").selectExpr("*", "timestamp_micros(micros) AS ts")
    folder = new_path(spark, "commands")
    order = {r[0]: k for k, r in enumerate(rows)}
    for part in range(4):
        ids = [i for i, k in order.items() if k * 4 // len(rows) == part]
        events.where(events.event_id.isin(ids)).coalesce(1).write.mode("append").parquet(folder)
        time.sleep(1.1)  # files are taken by their time
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", E.ROCKSDB)
    own.conf.set("spark.sql.shuffle.partitions", "2")
    stream = own.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    out, state = new_path(spark, "audit"), new_path(spark, "state")
    query = E.session_stream(E.event_commands(stream), "ts", "1 hour").writeStream.outputMode("append").option("checkpointLocation", state).trigger(availableNow=True).format("parquet").start(out)
    query.awaitTermination()
    mark = (max(r[1] for r in rows) // 1000 - 60 * 60_000) * 1000
    got = [tuple(r) for r in spark.read.schema(E.AUDIT).parquet(out).collect()]
    before = E.event_commands(events).where(f"at < {mark}").drop("ts")
    want = [tuple(r) for r in E.audited(before, mark - 1).collect()]
    key = lambda r: (r[0], r[1], r[2], r[3])
    assert sorted(got, key=key) == sorted(want, key=key) and {r[5] for r in got} == {"started", "attached", "refused", "not held", "recorded", "alive", "ended", "expired"}


def test_waiting_commands_are_packed_and_not_read_back():
    """A frame of commands becomes one row of state, and the timer moves without the commands that wait being read; later ones are written back packed."""
    import pandas as pd

    class State:
        def __init__(self):
            self.rows, self.reads, self.value = [], 0, None

        def appendValue(self, row):
            self.rows.append(row)

        def get(self):
            self.reads += 1
            return self.value or iter(self.rows)

        def put(self, rows):
            self.rows = list(rows)

        def clear(self):
            self.rows = []

        def exists(self):
            return self.value is not None

        def update(self, value):
            self.value = value

    class Handle:
        def __init__(self):
            self.timers = set()

        listTimers = lambda self: sorted(self.timers)
        deleteTimer = lambda self, t: self.timers.remove(t)
        registerTimer = lambda self, t: self.timers.add(t)

    class Times:
        getCurrentWatermarkInMs = lambda self: 15

    p = E.RunProcessor()
    p.handle, p.state, p.waiting = Handle(), State(), State()
    frame = lambda rows: pd.DataFrame([("r", *r) for r in rows], columns=["run", "at", "seq", "session", "action", "step", "spent"])
    first = [(20_000, 2, "a", "checkpoint", None, 3), (10_000, 1, "a", "start", "w", None)]
    assert list(p.handleInputRows(("r",), iter([frame(first), frame([(30_000, 3, "a", "end", None, 1)])]), None)) == []
    assert list(p.handleInputRows(("r",), iter([frame([(40_000, 4, "b", "start", None, None)])]), None)) == []
    assert (len(p.waiting.rows), p.waiting.reads, p.handle.timers) == (3, 0, {11})
    assert p.waiting.rows[0] == ([20_000, 10_000], [2, 1], ["a", "a"], ["checkpoint", "start"], [None, "w"], [3, None])
    (out,) = p.handleExpiredTimer(("r",), Times(), None)
    assert out[["run", "at", "outcome", "held_by"]].values.tolist() == [["r", 10_000, "started", "a"]]
    assert p.waiting.rows == [([20_000, 30_000, 40_000], [2, 3, 4], ["a", "a", "b"], ["checkpoint", "end", "start"], [None] * 3, [3, 1, None])] and p.handle.timers == {21}
