"""Look-back windows over site series: sums, dry spells, season onset, rain climatology."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cropspark.constants import (
    FOLLOW_DAYS,
    KILLING_DRY_DAYS,
    SEVERITY_DAYS,
    SHORT_WINDOW_DAYS,
    WET_SPELL_DAYS,
    WINDOW_DAYS,
)
from cropspark.functions.agronomy import crop_coefficient, heat_stress_days, phenology_stage, water_balance
from cropspark.functions.numeric import half_even
from cropspark.operators.calendar import bound


def longest_dry_run(marks: Column) -> Column:
    """Longest run of 'd' in a dry/wet text."""
    return F.array_max(F.transform(F.split(marks, "w"), F.length)).cast("int")


def _text(marks: str, start: Column, n) -> Column:
    """n letters of a byte-per-day text from a 0-based day."""
    return F.substring(F.col(marks), start + F.lit(1), n if isinstance(n, Column) else F.lit(n)).cast("string")


def _season_onset(end: Column) -> Column:
    """First day of the window before ``end`` that starts the season, from its first day; NULL for none.

    Where the days that follow a spell lie inside the window, its mark decides. Later spells are only followed up to the
    window's end: there the first spell counts of those behind the window's last killing run.
    """
    first, late = end - F.lit(WINDOW_DAYS), end - F.lit(WET_SPELL_DAYS + FOLLOW_DAYS - 1)
    early = F.instr(_text("season_marks", first, WINDOW_DAYS - WET_SPELL_DAYS - FOLLOW_DAYS + 1), "s")
    seen = FOLLOW_DAYS - 1
    killed = F.instr(F.reverse(_text("dry_marks", end - F.lit(seen), seen)), "d" * KILLING_DRY_DAYS)
    begin = F.when(killed > 0, F.greatest(late, end - killed - F.lit(KILLING_DRY_DAYS + WET_SPELL_DAYS - 2))).otherwise(late)

    def tail(start: Column) -> Column:
        rest = F.instr(F.translate(_text("season_marks", start, end - F.lit(WET_SPELL_DAYS) - start), "k", "s"), "s")
        return F.when(rest > 0, start - first + rest - F.lit(1))

    return F.when(early > 0, early - F.lit(1)).otherwise(bound(begin, tail))


def _climatology(asof: Column, exclude_own_year: bool, years: int | None) -> Column:
    """Mean 30-day rain before the same month and day of the other (or all) years; NULL when unknown."""
    start, n = F.col("start_date"), F.col("n_days")
    low = F.lit(0) if years is None else F.greatest(F.lit(0), n - F.lit(years * 365))
    all_years = F.sequence(F.year(start), F.year(F.date_add(start, n - F.lit(1))))
    picked = F.filter(all_years, lambda y: y != F.year(asof)) if exclude_own_year else all_years

    def day_number(y: Column) -> Column:
        leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
        exists = leap | (F.month(asof) != F.lit(2)) | (F.day(asof) != F.lit(29))
        return F.when(exists, F.datediff(F.make_date(y, F.month(asof), F.day(asof)), start))

    usable = F.filter(F.transform(picked, day_number), lambda i: (i >= low + F.lit(SHORT_WINDOW_DAYS)) & (i < n))

    def mean(days: Column) -> Column:
        summed = F.aggregate(
            days, F.lit(0.0), lambda acc, i: acc + F.get("rain_to", i) - F.get("rain_to", i - F.lit(SHORT_WINDOW_DAYS))
        )
        return F.when(F.size(days) > 0, summed / F.size(days))

    return bound(usable, mean)


def cut_windows(
    series: DataFrame,
    asofs: DataFrame,
    date: str,
    include_asof_day: bool = False,
    exclude_own_year: bool = True,
    climatology_years: int | None = None,
) -> DataFrame:
    """What the 90-day look-back of every as-of row needs of its site's series.

    Training looks at the 90 days before the as-of day; scoring ends with that day. As-of rows without
    a full look-back drop out. The as-of rows of a site (at most one per day) travel to its series as
    one array, so the series is joined once per site; an as-of row takes from it the runs at its window's
    bounds, whose running totals give every sum, and the lengths of dry runs.
    """
    carried = [c for c in asofs.columns if c != "site_id"]
    grouped = asofs.groupBy("site_id").agg(F.collect_list(F.struct(*carried)).alias("asofs"))
    both = series.hint("merge").join(grouped, "site_id")  # both lie by site already; a series is far larger than its estimate
    shift = 1 if include_asof_day else 0

    def with_end(a: Column) -> Column:
        return F.struct(a.alias("own"), (F.datediff(a[date], F.col("start_date")) + F.lit(shift)).alias("end"))

    usable = F.filter(
        F.transform("asofs", with_end),
        lambda w: (w["end"] >= F.lit(WINDOW_DAYS)) & (w["end"] - F.lit(shift) < F.col("n_days")),
    )

    def with_onset(w: Column) -> Column:
        return F.struct(w["own"].alias("own"), w["end"].alias("end"), _season_onset(w["end"]).alias("onset"))

    def run_before(day: Column) -> Column:
        return F.get("runs", F.get("run_of", day - F.lit(1)))

    def windows(w: Column) -> Column:
        own, end, long = w["own"], w["end"], w["end"] - F.lit(WINDOW_DAYS)
        return F.struct(
            *[own[c].alias(c) for c in carried],
            end.alias("end"),
            w["onset"].alias("onset"),
            run_before(end).alias("at_end"),
            run_before(end - F.lit(SHORT_WINDOW_DAYS)).alias("at_short"),
            run_before(long).alias("at_long"),
            run_before(long + w["onset"]).alias("at_onset"),
            longest_dry_run(_text("dry_marks", end - F.lit(SHORT_WINDOW_DAYS), SHORT_WINDOW_DAYS)).alias("dry_run_30"),
            longest_dry_run(_text("dry_marks", long, WINDOW_DAYS)).alias("dry_run_90"),
            _climatology(own[date], exclude_own_year, climatology_years).alias("clim_rain"),
        )

    return both.select("site_id", F.inline(F.transform(F.transform(usable, with_onset), windows)))


def window_totals(windows: DataFrame) -> DataFrame:
    """Crop-independent totals of the cut windows, as differences of running totals."""
    days = {"at_end": 0, "at_short": SHORT_WINDOW_DAYS, "at_long": WINDOW_DAYS}
    cut = ["end", "onset", "at_end", "at_short", "at_long", "at_onset", "dry_run_30", "dry_run_90", "clim_rain"]

    def upto(value: str, at: str, day: Column) -> Column:
        """The value's total over the days before ``day``, whose last lies in the run."""
        run = F.col(at)
        return F.coalesce(run[f"{value}_before"] + (day - run["start"]) * run[value], F.lit(0.0))

    def span(value: str, since: str) -> Column:
        return upto(value, "at_end", F.col("end")) - upto(value, since, F.col("end") - F.lit(days[since]))

    onset_day = F.col("end") - F.lit(WINDOW_DAYS) + F.col("onset")
    since = upto("heat", "at_end", F.col("end")) - upto("heat", "at_onset", onset_day)
    return windows.select(
        *[c for c in windows.columns if c not in cut],
        span("et0", "at_long").alias("et0_sum_90"),
        span("et0", "at_short").alias("et0_sum_30"),
        span("radiation", "at_long").alias("radiation_sum_90"),
        span("tmax", "at_short").alias("tmax_sum_30"),
        span("tmin", "at_short").alias("tmin_sum_30"),
        span("rh", "at_short").alias("rh_sum_30"),
        span("hot", "at_short").cast("int").alias("hot_days_30"),
        span("heat", "at_long").alias("heat_sum_90"),
        F.when(F.col("onset").isNotNull(), since).otherwise(F.lit(0.0)).alias("heat_since_onset"),
        F.coalesce(F.lit(WINDOW_DAYS) - F.col("onset"), F.lit(0)).alias("days_since_onset"),
        span("rain", "at_short").alias("rain_sum_30"),
        span("rain", "at_long").alias("rain_sum_90"),
        "dry_run_30",
        "dry_run_90",
        F.coalesce("clim_rain", span("rain", "at_short")).alias("clim_rain_30"),
    )


def weather_features(crop: Column | None = None) -> list[Column]:
    """The 18 weather columns of a feature row from window totals; only the stage depends on the crop."""
    days = F.lit(float(SHORT_WINDOW_DAYS))
    stage = phenology_stage(F.col("heat_since_onset"), crop)
    balance = water_balance(F.col("rain_sum_30"), F.col("et0_sum_30"), stage)
    return [
        half_even(F.col("heat_sum_90"), 1).alias("gdd_90"),
        half_even(F.col("heat_since_onset"), 1).alias("gdd_since_onset"),
        half_even(F.col("tmax_sum_30") / days, 2).alias("tmax_mean_30"),
        half_even(F.col("tmin_sum_30") / days, 2).alias("tmin_mean_30"),
        half_even((F.col("tmax_sum_30") - F.col("tmin_sum_30")) / days, 2).alias("diurnal_range_30"),
        heat_stress_days(F.col("hot_days_30"), stage).alias("heat_stress_days"),
        half_even(F.col("rain_sum_30"), 1).alias("rain_30"),
        half_even(F.col("rain_sum_90"), 1).alias("rain_90"),
        half_even(F.col("et0_sum_90"), 1).alias("et0_90"),
        balance["satisfaction"].alias("water_satisfaction_30"),
        balance["deficit_mm"].alias("water_deficit_30"),
        F.col("dry_run_30").alias("dry_spell_30"),
        F.col("dry_run_90").alias("dry_spell_90"),
        half_even(F.col("rain_sum_30") - F.col("clim_rain_30"), 1).alias("rain_anomaly_30"),
        half_even(F.col("rh_sum_30") / days, 1).alias("rh_mean_30"),
        half_even(F.col("radiation_sum_90"), 1).alias("radiation_90"),
        F.col("days_since_onset").cast("int").alias("days_since_onset"),
        crop_coefficient(stage).alias("stage_kc"),
    ]


def severity_totals(hourly: DataFrame, as_of: dt.date) -> DataFrame:
    """Severity total and spray flag per site over the last SEVERITY_DAYS calendar days up to ``as_of``."""
    from cropspark.functions.agronomy import daily_severity, spray_due

    first = F.lit(as_of - dt.timedelta(days=SEVERITY_DAYS - 1)).cast("timestamp_ntz")
    after = F.lit(as_of + dt.timedelta(days=1)).cast("timestamp_ntz")
    days = leaf_wetness(hourly.filter((F.col("ts") >= first) & (F.col("ts") < after)))
    return days.groupBy("site_id").agg(
        F.sum(daily_severity(F.col("wet_temp"), F.col("wet_hours"))).cast("long").alias("dsv_total")
    ).withColumn("spray_due", spray_due(F.col("dsv_total")))


def leaf_wetness(hourly: DataFrame) -> DataFrame:
    """Calendar days of hourly readings: mean temperature of the wet hours, wet hours.

    A day without wet hours reports its plain mean and 0 hours; a day without any temperature is dropped, and so is a site's
    last day if its readings end before the last hour. The raw rows are only aggregated, with partial sums before the shuffle;
    the last day is judged on the day rows.
    """
    from cropspark.constants import WET_RH

    wet_temp = F.when(F.col("rh") >= F.lit(WET_RH), F.col("temp"))
    days = hourly.groupBy("site_id", F.to_date("ts").alias("day")).agg(
        F.count(wet_temp).cast("int").alias("wet_hours"),
        F.coalesce(F.avg(wet_temp), F.avg("temp")).alias("wet_temp"),
        F.max(F.hour("ts")).alias("_end"),
    )
    last = F.max("day").over(Window.partitionBy("site_id"))
    complete = days.withColumn("_last", last).filter((F.col("day") < F.col("_last")) | (F.col("_end") == F.lit(23)))
    return complete.filter(F.col("wet_temp").isNotNull()).select("site_id", "day", "wet_hours", "wet_temp")
