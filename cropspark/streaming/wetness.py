"""Leaf wetness and severity from a stream of hourly readings, and severity since the last spray."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from cropspark.constants import SPRAY_THRESHOLD, WET_RH
from cropspark.functions.agronomy import daily_severity
from cropspark.operators.lookup import latest_by

LATENESS = "6 hours"


def daily_wetness(readings: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """One row per (site, day) once the watermark has passed the day; later readings are dropped.

    The state is a handful of partial sums per open site-day. ``readings`` has site_id, ts, temp, rh and
    optionally ``sprayed``.
    """
    wet = F.col("rh") >= F.lit(WET_RH)
    wet_temp = F.when(wet, F.col("temp"))
    sprayed = F.max("sprayed") if "sprayed" in readings.columns else F.max(F.lit(False))
    days = (
        readings.withWatermark("ts", lateness)
        .groupBy("site_id", F.window("ts", "1 day"))
        .agg(
            F.count(wet_temp).cast("int").alias("wet_hours"),
            F.coalesce(F.avg(wet_temp), F.avg("temp")).alias("wet_temp"),
            sprayed.alias("sprayed"),
        )
    )
    return days.filter(F.col("wet_temp").isNotNull()).select(
        "site_id",
        F.to_date("window.start").alias("day"),
        "wet_hours",
        "wet_temp",
        daily_severity(F.col("wet_temp"), F.col("wet_hours")).alias("severity"),
        "sprayed",
    )


RUNNING_SCHEMA = "site_id string, day date, severity int, total long, spray_due boolean, revision long"
OPEN_DAYS = "30 days"
_DAY_MS = 86_400_000


class SeveritySinceSpray(StatefulProcessor):
    """State machine of one site: days that may still change stay open, closed ones are one number.

    Whatever order days arrive in, the totals are summed in the order of the days: a day or a spray that comes late re-sums its
    day and all open days after it, and these go out again under a higher revision. A timer at the end of each open day closes it,
    with the days before it, once the watermark has passed, so the state holds no more days than the lateness allows.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._closed = handle.getValueState("closed", "total long, revision long")
        self._open = handle.getMapState("open", "day int", "severity int, sprayed boolean")

    def _state(self) -> tuple[int, int]:
        return self._closed.get() if self._closed.exists() else (0, 0)

    def _days(self) -> list[tuple[int, int, bool]]:
        return sorted((key[0], value[0], value[1]) for key, value in self._open.iterator())

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        total, revision = self._state()
        open_days = {day: (severity, sprayed) for day, severity, sprayed in self._days()}
        first = None
        for frame in rows:
            for day, severity, sprayed in zip(frame["day_number"], frame["severity"], frame["sprayed"], strict=True):
                day, new = int(day), (int(severity), bool(sprayed))
                old = open_days.get(day)
                if old is not None:
                    new = (max(old[0], new[0]), old[1] or new[1])
                if new == old:
                    continue
                if old is None:
                    self._handle.registerTimer((day + 1) * _DAY_MS)
                open_days[day] = new
                self._open.updateValue((day,), new)
                first = day if first is None else min(first, day)
        if first is None:
            return
        self._closed.update((total, revision + 1))
        out = []
        for day in sorted(open_days):
            severity, sprayed = open_days[day]
            total = (0 if sprayed else total) + severity
            if day >= first:
                out.append((key[0], dt.date(1970, 1, 1) + dt.timedelta(days=day), severity, total, total >= SPRAY_THRESHOLD, revision + 1))
        yield pd.DataFrame(out, columns=["site_id", "day", "severity", "total", "spray_due", "revision"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        total, revision = self._state()
        last = expiredTimerInfo.getExpiryTimeInMs() // _DAY_MS - 1
        for day, severity, sprayed in self._days():
            if day <= last:
                total = (0 if sprayed else total) + severity
                self._open.removeKey((day,))
        self._closed.update((total, revision))
        return iter([])

    def close(self) -> None:
        pass


def severity_since_spray(days: DataFrame, lateness: str = OPEN_DAYS) -> DataFrame:
    """Running severity per site, restarted on the day of a spray, as revisions of (site, day) rows.

    The input is the daily table, one row per site and day, so a site brings few rows into a batch however many readings it
    sends; a day told twice counts once, with its larger severity and any spray. Days later than ``lateness`` are dropped. The
    last revision of a row holds (see ``latest_revision``). Needs the RocksDB state store (``runs.rocksdb_state``).
    """
    day = F.datediff("day", F.lit("1970-01-01").cast("date")).alias("day_number")
    sprayed = F.coalesce("sprayed", F.lit(False)).alias("sprayed")
    rows = days.select("site_id", day, "severity", sprayed, F.col("day").cast("timestamp").alias("at")).withWatermark("at", lateness)
    return rows.groupBy("site_id").transformWithStateInPandas(
        SeveritySinceSpray(), RUNNING_SCHEMA, outputMode="append", timeMode="EventTime"
    )


def latest_revision(rows: DataFrame) -> DataFrame:
    """The last revision of every (site, day)."""
    return latest_by(rows, ["site_id", "day"], ["revision"], ["severity", "total", "spray_due"])
