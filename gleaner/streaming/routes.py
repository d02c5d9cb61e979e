"""Health of routes over a stream of their calls: a state machine with timers and a time to live.

A route is quarantined from the second failure in a row on, for a time that doubles with each further failure; a success ends it, and so does the time.
By hand it is disabled for a while or enabled. The machine's state is what the batch query ``posts.route_state`` would tell from all calls so far, in whatever
batches, order and after whatever restarts they came, as long as no call is later than the watermark allows: failures newer than the watermark are kept one by one,
because a success may still arrive that came before them; older ones are counted. A route without calls for so many days of event time is forgotten, by a timer.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: Seconds of the first quarantine, of the longest, and how often it doubles at most.
BASE, MOST, DOUBLINGS = 1800, 43200, 20
#: What a stream of calls holds: kind is ok, fail, disable or enable; hours is for disable.
CALLS = "route string, at timestamp, kind string, hours double"
STATES = "route string, at timestamp, calls long, fails int, disabled_until timestamp, usable boolean"
# times are microseconds inside the machine
_OUT = "route string, at long, calls long, fails int, disabled_until long, usable boolean"
_STATE = "last_ok long, old int, last_old long, fails array<bigint>, manual_at long, manual_until long, seen long, calls long"
_SECOND = 1_000_000


def quarantine(fails: int, last_fail: int | None) -> int | None:
    if fails < 2 or last_fail is None:
        return None
    return last_fail + min(BASE * 2 ** min(fails - 2, DOUBLINGS), MOST) * _SECOND


class RouteHealth(StatefulProcessor):
    """One route's state; a row for every batch that touches it, and one when its quarantine ends by itself."""

    def __init__(self, idle_days: int = 30) -> None:
        self.idle = idle_days * 86_400 * _SECOND

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("health", _STATE)

    def _read(self) -> dict:
        empty = {"last_ok": None, "old": 0, "last_old": None, "fails": [], "manual_at": None, "manual_until": None, "seen": None, "calls": 0}
        held = self.state.get() if self.state.exists() else None
        return empty if held is None else dict(zip(empty, held, strict=True)) | {"fails": list(held[3] or [])}

    @staticmethod
    def _told(s: dict) -> tuple[int, int | None]:
        fails = s["old"] + len(s["fails"])
        until = quarantine(fails, max(s["fails"], default=s["last_old"]))
        if s["manual_at"] is not None and (s["last_ok"] is None or s["manual_at"] > s["last_ok"]):
            until = max((u for u in (until, s["manual_until"]) if u is not None), default=None)
        return fails, until

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        s, newest = self._read(), None
        for r in rows:
            newest = r.t if newest is None else max(newest, r.t)
            s["calls"] += 1
            if r.kind == "ok" and (s["last_ok"] is None or r.t > s["last_ok"]):
                s["last_ok"] = r.t
            elif r.kind == "fail":
                s["fails"].append(r.t)
            elif r.kind in ("disable", "enable") and (s["manual_at"] is None or r.t >= s["manual_at"]):
                s["manual_at"] = r.t
                s["manual_until"] = r.t + int((r.hours or 0) * 3600) * _SECOND if r.kind == "disable" else None
                if r.kind == "enable" and (s["last_ok"] is None or r.t > s["last_ok"]):
                    s["last_ok"] = r.t
        if s["last_ok"] is not None:
            s["fails"] = [f for f in s["fails"] if f > s["last_ok"]]
            if s["last_old"] is not None and s["last_old"] <= s["last_ok"]:
                s["old"], s["last_old"] = 0, None
        settled = timerValues.getCurrentWatermarkInMs() * 1000
        old = [f for f in s["fails"] if f < settled]
        if old:
            s["old"] += len(old)
            s["last_old"] = max(old if s["last_old"] is None else [*old, s["last_old"]])
            s["fails"] = [f for f in s["fails"] if f >= settled]
        s["seen"] = newest if s["seen"] is None else max(s["seen"], newest)
        self.state.update(tuple(s.values()))
        fails, until = self._told(s)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        for due in {s["seen"] + self.idle, until}:
            if due is not None and due > settled:
                self.handle.registerTimer(-(-due // 1000))
        yield Row(route=key[0], at=s["seen"], calls=s["calls"], fails=fails, disabled_until=until, usable=until is None or until <= s["seen"])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if not self.state.exists():
            return
        s, now = self._read(), timerValues.getCurrentWatermarkInMs() * 1000
        fails, until = self._told(s)
        if until is not None and until <= now and expiredTimerInfo.getExpiryTimeInMs() == -(-until // 1000):
            yield Row(route=key[0], at=until, calls=s["calls"], fails=fails, disabled_until=until, usable=True)
        if s["seen"] + self.idle <= now:
            self.state.clear()


def route_states(calls: DataFrame, late: str = "1 hour", idle_days: int = 30) -> DataFrame:
    """STATES of a stream of CALLS: the last of a route is that with the most calls. Needs the RocksDB state store, which ``stateful`` sets."""
    stateful(calls.sparkSession)
    dated = calls.filter(F.col("route").isNotNull() & F.col("at").isNotNull()).withColumn("t", F.unix_micros("at")).withWatermark("at", late)
    found = dated.groupBy("route").transformWithState(RouteHealth(idle_days), _OUT, "Append", "EventTime")
    return found.select("route", F.timestamp_micros("at").alias("at"), "calls", "fails", F.timestamp_micros("disabled_until").alias("disabled_until"), "usable")


def stateful(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
