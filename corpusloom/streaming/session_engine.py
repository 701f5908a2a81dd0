"""Sessions that hold runs by leases, as a state machine over a stream of commands."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.fixed_values import LEASE_MINUTES

#: at is in microseconds since 1970; seq tells commands of one moment apart.
COMMANDS = "run string, at long, seq long, session string, action string, step string, spent long"
#: held_by is the session that holds the run after the command; done the steps completed and spent the greatest amount told so far.
AUDIT = "run string, at long, seq long, session string, action string, outcome string, held_by string, done long, spent long"
STATE = "holder string, beat long, ever boolean, done long, spent long"
NOTHING = (None, 0, False, 0, 0)
#: Commands that wait, packed: a row of columns as arrays for each frame that came.
WAITING = "at array<long>, seq array<long>, session array<string>, action array<string>, step array<string>, spent array<long>"
#: Commands in one packed row, at most, as those that wait on are written back.
PACKED = 10_000
LEASE = LEASE_MINUTES * 60 * 1_000_000
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def lapsed(state: tuple, now: int) -> tuple[tuple, list[tuple]]:
    """The state at a time, and the row of a lease that has run out by then."""
    holder, beat, ever, done, spent = state
    if holder is None or now - beat < LEASE:
        return state, []
    return (None, beat, ever, done, spent), [(beat + LEASE, -1, holder, "expire", "expired", None, done, spent)]


def told(state: tuple, at: int, seq: int, session: str, action: str, step: str | None, spent: int | None) -> tuple[tuple, list[tuple]]:
    """The state after a command, and its audit rows.

    start and resume take a run that no live session holds (`started` the first time, else `attached`; the holder itself is `attached`
    again), and are `refused` otherwise. checkpoint, heartbeat and end are the holder's alone, `not held` for others; each but end renews the lease. A checkpoint
    that names a step completes it.
    """
    state, rows = lapsed(state, at)
    holder, beat, ever, done, most = state
    if action in ("start", "resume"):
        if holder in (None, session):
            outcome, holder, beat, ever = "attached" if ever else "started", session, at, True
        else:
            outcome = "refused"
    elif session != holder:
        outcome = "not held"
    elif action == "end":
        outcome, holder = "ended", None
    else:
        outcome, beat = "recorded" if action == "checkpoint" else "alive", at
        done += action == "checkpoint" and step is not None
        most = max(most, spent or 0) if action == "checkpoint" else most
    return (holder, beat, ever, done, most), [*rows, (at, seq, session, action, outcome, holder, done, most)]


def run_through(state: tuple, commands: list[tuple], until: int) -> tuple[tuple, list[tuple]]:
    """The state after commands (at, seq, session, action, step, spent) in their order, and at `until`; with all audit rows."""
    rows = []
    for command in sorted(commands, key=lambda c: c[:2]):
        state, more = told(state, *command)
        rows += more
    state, more = lapsed(state, until)
    return state, rows + more


def audit_frame(run: str, rows: list[tuple]) -> pd.DataFrame:
    run_column, *others = [c.split()[0] for c in AUDIT.split(", ")]
    columns = dict(zip(others, zip(*rows, strict=True), strict=True)) if rows else {c: [] for c in others}
    return pd.DataFrame({run_column: [run] * len(rows)} | {c: list(v) for c, v in columns.items()}).astype({"at": "int64", "seq": "int64", "done": "int64", "spent": "int64"})


def columns_of(frame: pd.DataFrame) -> tuple[list, ...]:
    """Commands as a list for each column but the run; missing values are None."""
    out = []
    for name in ("at", "seq", "session", "action", "step", "spent"):
        column, kind = frame[name], int if name in ("at", "seq", "spent") else lambda v: v
        values = column.tolist()
        missing = column.isna().tolist() if column.hasnans else [False] * len(values)
        out.append([None if gone else kind(v) for v, gone in zip(values, missing, strict=True)])
    return tuple(out)


def plain(frame: pd.DataFrame) -> list[tuple]:
    """Commands as tuples without the run; missing values are None."""
    return list(zip(*columns_of(frame), strict=True))


def audited(commands: DataFrame, until: int) -> DataFrame:
    """AUDIT rows of a table of COMMANDS, with leases that run out up to `until`. A run's commands meet in one task: they are a sequence."""

    def whole_run(frame: pd.DataFrame) -> pd.DataFrame:
        return audit_frame(frame["run"].iloc[0], run_through(NOTHING, plain(frame), until)[1])

    return commands.groupBy("run").applyInPandas(whole_run, AUDIT)


class RunProcessor(StatefulProcessor):
    """Keeps each run's state. Commands wait until the watermark has passed them, so that those that come late, within its delay, still take their turn; a timer
    stands at the first one that waits, or where the lease runs out."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("run", STATE)
        self.waiting = handle.getListState("waiting", WAITING)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        # The timer stands for all that waited before, so that they need not be read.
        ends = []
        for frame in rows:
            packed = columns_of(frame)
            if packed[0]:
                self.waiting.appendValue(packed)
                ends.append(min(packed[0]) // 1000 + 1)
        self.watch(ends, [*self.handle.listTimers()])
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = [c for packed in self.waiting.get() for c in zip(*packed, strict=True)]
        due, later = [c for c in waiting if c[0] < until], [c for c in waiting if c[0] >= until]
        state = tuple(self.state.get()) if self.state.exists() else NOTHING
        state, rows = run_through(state, due, until - 1)
        self.state.update(state)
        if due:
            self.waiting.clear()
            if later:
                self.waiting.put([tuple(map(list, zip(*later[k : k + PACKED], strict=True))) for k in range(0, len(later), PACKED)])
        ends = [min(c[0] for c in later)] if later else []
        ends += [state[1] + LEASE] if state[0] is not None else []
        for t in [*self.handle.listTimers()]:
            self.handle.deleteTimer(t)
        self.watch([t // 1000 + 1 for t in ends], [])
        if rows:
            yield audit_frame(key[0], rows)

    def watch(self, ends: list[int], timers: list[int]) -> None:
        """One timer at a time, in milliseconds: past the first command that waits and the end of the lease, whichever is first; timers are those that stand."""
        first = min([*ends, *timers], default=None)
        for t in timers:
            if t != first:
                self.handle.deleteTimer(t)
        if first is not None and first not in timers:
            self.handle.registerTimer(first)

    def close(self) -> None:
        pass


def session_stream(commands: DataFrame, time: str, late: str = "1 hour") -> DataFrame:
    """AUDIT rows of a stream of COMMANDS with an event time column `time`, which says the same as `at`.

    A command takes effect once the watermark, which follows the latest command by `late`, has passed it; those that come still later are dropped. The
    stream's session must use the RocksDB state store. The rows are those of audited() over all commands that the watermark has passed, however these are split into batches.
    """
    marked = commands.withWatermark(time, late)
    return marked.groupBy("run").transformWithStateInPandas(statefulProcessor=RunProcessor(), outputStructType=AUDIT, outputMode="append", timeMode="eventTime")


def event_commands(events: DataFrame) -> DataFrame:
    """User events as COMMANDS with their time: ten users share a run, each is a session of it."""
    action = F.expr("CASE event_type WHEN 'signup' THEN 'start' WHEN 'error' THEN 'resume' WHEN 'click' THEN 'checkpoint' WHEN 'view' THEN 'heartbeat' ELSE 'end' END")
    step = F.when(F.col("value") >= 50, F.concat(F.lit("w"), (F.floor("value") % 8).cast("string")))
    return events.select(
        F.concat(F.lit("run"), F.floor(F.col("user_id") / 10).cast("string")).alias("run"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.col("event_id").alias("seq"),
        F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("session"), action.alias("action"), step.alias("step"), F.floor("value").cast("long").alias("spent"), F.col("ts").cast("timestamp").alias("ts"),
    )
