"""Alert state on streams: hold time (A2), notices (A7) and cooldown (A11), each a small state per key with timers.

Rows wait in the state of their key until the watermark has passed them, and are then taken in order of event time. So
the result equals the batch form for all rows that are not late, in whatever order they come; late rows are dropped by the
watermark. A timer ends what a key remembers after a day of silence, or once its alert group has vanished.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidewatch.operators.alerts import COOLDOWN_MINUTES, stable_key
from tidewatch.operators.samples import series_key

SILENCE_MS = 86_400_000
HOLD_OUT = "alertname string, key string, second bigint, since bigint, state string"
COOL_OUT = "key string, us bigint, accepted boolean"
NOTICE_OUT = "receiver string, group_key string, second bigint, reason string, alerts bigint"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_timers(spark: SparkSession) -> None:
    """State with timers needs the store that keeps it outside the heap."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


class InOrder(StatefulProcessor):
    """Hands the rows of a key to ``take`` in order of time, once the watermark has passed them.

    A row waits under its time; what it carries are ``waiting`` columns. ``kept`` is the schema of what the key remembers,
    its last column the last time taken; after ``silence`` milliseconds it is forgotten.
    """

    columns: tuple[str, ...] = ()
    waiting: str = ""
    kept: str = ""
    at: str = ""
    silence = SILENCE_MS

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getMapState("rows", f"{self.at} bigint", self.waiting)
        self.state = handle.getValueState("state", self.kept)

    def due(self, at: int) -> int:
        """The timer of a row: the first millisecond not before it."""
        raise NotImplementedError

    def fields(self) -> list[str]:
        return [part.split()[0] for part in self.waiting.split(",")]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            for at, *carried in frame[[self.at, *self.fields()]].itertuples(index=False):
                self.rows.updateValue((int(at),), tuple(x.item() if hasattr(x, "item") else x for x in carried))
                self.handle.registerTimer(self.due(int(at)))
        yield pd.DataFrame(columns=list(self.columns))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        ready = sorted(at for (at,) in self.rows.keys() if self.due(at) <= now)
        state = self.state.get() if self.state.exists() else None
        out = []
        for at in ready:
            state, made = self.take(state, at, self.rows.getValue((at,)))
            out.append((*key, at, *made))
            self.rows.removeKey((at,))
        if ready:
            self.state.update(state)
            self.handle.registerTimer(self.due(state[-1]) + self.silence)
        elif state is not None and self.due(state[-1]) + self.silence <= now and not any(True for _ in self.rows.keys()):
            self.state.clear()
        yield pd.DataFrame(out, columns=list(self.columns))

    def take(self, state, at: int, carried) -> tuple[tuple, tuple]:
        raise NotImplementedError

    def close(self) -> None:
        pass


class Hold(InOrder):
    columns = ("alertname", "key", "second", "since", "state")
    waiting, kept, at = "hold bigint", "since bigint, last bigint", "second"

    def __init__(self, step: int):
        self.step = step

    def due(self, at):
        return at * 1000

    def take(self, state, at, carried):
        since, last = state or (None, None)
        if last is None or at - last > self.step:
            since = at
        return (since, at), (since, "firing" if at - since >= carried[0] else "pending")


class Cooldown(InOrder):
    columns = ("key", "us", "accepted")
    waiting, kept, at = "one boolean", "accepted bigint, last bigint", "us"

    def __init__(self, minutes: int):
        self.cool = minutes * 60 * 1_000_000
        self.silence = max(SILENCE_MS, minutes * 60_000)

    def due(self, at):
        return -(-at // 1000)

    def take(self, state, at, carried):
        accepted = state is None or at - state[0] >= self.cool
        return (at if accepted else state[0], at), (accepted,)


class Notices(StatefulProcessor):
    """The flushes of an alert group: a timer for the wait, then one for each interval until the group has vanished.

    The run is (next flush, last row's second, its alerts, its fingerprint, whether a notice went out, the fingerprint
    and the time of the last one). Rows wait under their second until a flush takes them.
    """

    def __init__(self, step: int):
        self.step = step

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getMapState("rows", "second bigint", "alerts bigint, fingerprint bigint")
        self.timing = handle.getValueState("timing", "wait bigint, interval bigint, repeat bigint")
        self.run = handle.getValueState("run", "flush bigint, second bigint, alerts bigint, mark bigint, sent boolean, sent_mark bigint, sent_at bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        quiet = not self.run.exists()
        for frame in rows:
            for second, alerts, mark, wait, interval, repeat in frame[["second", "alerts", "fingerprint", "wait", "interval", "repeat"]].itertuples(index=False):
                self.rows.updateValue((int(second),), (int(alerts), int(mark)))
                self.timing.update((int(wait), int(interval), int(repeat)))
                if quiet:  # whichever row comes to be the first
                    self.handle.registerTimer((int(second) + int(wait)) * 1000)
        yield pd.DataFrame(columns=["receiver", "group_key", "second", "reason", "alerts"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() // 1000
        out = []
        if self.timing.exists():
            waiting = {second: tuple(row) for (second,), row in self.rows.iterator()}
            out = self._flushes(waiting, now)
        yield pd.DataFrame([(*key, *row) for row in out], columns=["receiver", "group_key", "second", "reason", "alerts"])

    def _flushes(self, waiting: dict[int, tuple[int, int]], now: int) -> list[tuple[int, str, int]]:
        wait, interval, repeat = self.timing.get()
        run = tuple(self.run.get()) if self.run.exists() else None
        out = []
        while run is not None or waiting:
            if run is None:
                start = min(waiting)
                run = (start + wait, start, *waiting[start], False, 0, 0)
                started = False
            else:
                started = True
            flush, second, alerts, mark, sent, sent_mark, sent_at = run
            if flush > now:
                if not started:  # an earlier row may still come
                    run = None
                self.handle.registerTimer(flush * 1000)
                break
            for s in sorted(x for x in waiting if x <= flush):
                second, (alerts, mark) = s, waiting.pop(s)
                self.rows.removeKey((s,))
            if flush - second >= self.step:
                if sent:
                    out.append((flush, "resolved", 0))
                run = None
                continue
            reason = "first" if not sent else "change" if mark != sent_mark else "repeat" if flush - sent_at >= repeat else None
            if reason:
                out.append((flush, reason, alerts))
                sent, sent_mark, sent_at = True, mark, flush
            run = (flush + interval, second, alerts, mark, sent, sent_mark, sent_at)
        if run is not None:
            self.run.update(run)
        else:
            self.run.clear()
            if not waiting:
                self.timing.clear()
        return out

    def close(self) -> None:
        pass


def _with_state(d: DataFrame, keys: tuple[str, ...], processor: StatefulProcessor, out: str) -> DataFrame:
    use_timers(d.sparkSession)
    return d.groupBy(*keys).transformWithStateInPandas(processor, out, "Append", "EventTime")


def hold_for_stream(breaches: DataFrame, holds: DataFrame, step: int, watermark: str = "10 minutes") -> DataFrame:
    """A2 on a stream of (t, alertname, labels, value): the state of each point once the watermark has passed it."""
    d = breaches.withWatermark("t", watermark).join(holds, "alertname").select(
        "t", "alertname", series_key(F.col("labels")).alias("key"), F.unix_seconds("t").alias("second"), F.col("hold").cast("bigint").alias("hold"))
    return _with_state(d, ("alertname", "key"), Hold(step), HOLD_OUT)


def suppress_cooldown_stream(alerts: DataFrame, minutes: int = COOLDOWN_MINUTES, ts: str = "ts", watermark: str = "10 minutes") -> DataFrame:
    """A11 on a stream of alerts: one row per key and time, accepted or not, once the watermark has passed it."""
    d = alerts.withWatermark(ts, watermark).select(ts, stable_key().alias("key"), F.unix_micros(ts).alias("us"), F.lit(True).alias("one"))
    return _with_state(d, ("key",), Cooldown(minutes), COOL_OUT)


def notification_times_stream(groups: DataFrame, step: int, watermark: str = "10 minutes") -> DataFrame:
    """A7 on a stream of groups (as ``group_alerts`` gives them): each notice once the watermark has passed its flush."""
    d = groups.withWatermark("t", watermark).select(
        "t", "receiver", "group_key", F.unix_seconds("t").alias("second"), "alerts", "fingerprint",
        *[F.col(c).cast("bigint").alias(n) for n, c in (("wait", "group_wait"), ("interval", "group_interval"), ("repeat", "repeat_interval"))])
    return _with_state(d, ("receiver", "group_key"), Notices(step), NOTICE_OUT)
