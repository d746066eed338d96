"""Gap filling and dense calendars.

A gap day repeats the last observed day, so a calendar needs no join: each observed row knows how many
days it stands for. A site's series is bounded by its calendar, one row per day, whatever the raw volume.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cropspark.constants import DRY_DAY_MM, FOLLOW_DAYS, KILLING_DRY_DAYS, WEATHER_VARS, WET_SPELL_DAYS, WET_SPELL_MM
from cropspark.functions.agronomy import growing_degree_days, is_hot


def fill_gaps(daily: DataFrame, variables: list[str] = WEATHER_VARS) -> DataFrame:
    """Carry values forward, back-fill a leading gap, leave a wholly absent variable NULL.

    Adds ``days``: the number of calendar days until the next observed row (1 for the last). Of several rows of one site and day
    the last in order of the variables stays, and takes from the others what it lacks.
    """
    ordered = Window.partitionBy("site_id").orderBy("date", *variables)
    so_far = ordered.rowsBetween(Window.unboundedPreceding, 0)
    whole = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    filled = [
        F.coalesce(F.last(v, ignorenulls=True).over(so_far), F.first(v, ignorenulls=True).over(whole)).alias(v)
        for v in variables
    ]
    days = F.coalesce(F.datediff(F.lead("date").over(ordered), F.col("date")), F.lit(1)).alias("days")
    return daily.select("site_id", "date", *filled, days).filter(F.col("days") > 0)


def dense_days(filled: DataFrame) -> DataFrame:
    """One row per (site, calendar day) between the site's first and last observed day."""
    values = [c for c in filled.columns if c not in ("site_id", "date", "days")]
    offsets = F.explode(F.sequence(F.lit(0), F.col("days") - F.lit(1))).alias("_off")
    return filled.select("site_id", "date", *values, offsets).select(
        "site_id", F.date_add("date", F.col("_off")).alias("date"), *values
    )


def complete_sites(daily: DataFrame) -> DataFrame:
    """Sites where every variable was observed at least once."""
    counts = daily.groupBy("site_id").agg(*[F.count(v).alias(v) for v in WEATHER_VARS])
    ok = F.lit(True)
    for v in WEATHER_VARS:
        ok = ok & (F.col(v) > 0)
    return counts.filter(ok).select("site_id")


def bound(value: Column, use) -> Column:
    """use(value) with the value computed once, also where ``use`` reads it inside a lambda."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def site_series(daily: DataFrame) -> DataFrame:
    """One row per complete site: its observed days as runs with running totals, and a rain index by day.

    ``runs`` holds an observed day and the gap behind it: the first calendar day's number, how many days it stands for, the
    values of a day, and of each value the total before the run. ``run_of`` gives the run of a day number, so the total of any
    span of days is a difference of two lookups. ``rain_to`` is the rain before each day, ``dry_marks`` a letter a day
    (d dry, w wet) and ``season_marks`` a letter a day that may start the season: ``.`` for no wet spell, ``s`` for one, ``k`` for one
    that a killing dry run follows. The windows that fill the gaps and sum the runs and the grouping share one shuffle by site.
    """
    totals = [*WEATHER_VARS, "heat", "hot"]
    filled = fill_gaps(daily).withColumns(
        {"heat": growing_degree_days(F.col("tmin"), F.col("tmax")), "hot": is_hot(F.col("tmax")).cast("double")}
    )
    before = Window.partitionBy("site_id").orderBy("date").rowsBetween(Window.unboundedPreceding, -1)
    running = filled.select(
        "site_id",
        "date",
        F.struct(
            F.coalesce(F.sum("days").over(before), F.lit(0)).cast("int").alias("start"),
            "days",
            *totals,
            *[F.coalesce(F.sum(F.col(v) * F.col("days")).over(before), F.lit(0.0)).alias(f"{v}_before") for v in totals],
        ).alias("run"),
    )
    grouped = running.groupBy("site_id").agg(F.min("date").alias("start_date"), F.sort_array(F.collect_list("run")).alias("runs"))
    first, last = F.get("runs", F.lit(0)), F.element_at("runs", -1)
    complete = F.lit(True)
    for v in WEATHER_VARS:
        complete = complete & first[v].isNotNull()

    def days_of(r: Column) -> Column:
        return F.sequence(F.lit(0), r["days"] - F.lit(1))

    rain_to = F.concat(
        F.flatten(F.transform("runs", lambda r: F.transform(days_of(r), lambda k: r["rain_before"] + k * r["rain"]))),
        F.array(last["rain_before"] + last["days"] * last["rain"]),
    )
    dry_marks = F.array_join(
        F.transform("runs", lambda r: F.repeat(F.when(r["rain"] < F.lit(DRY_DAY_MM), F.lit("d")).otherwise(F.lit("w")), r["days"])), ""
    ).cast("binary")

    def season_marks(s: Column) -> Column:
        def mark(i: Column) -> Column:
            spell = F.get(s["rain_to"], i + F.lit(WET_SPELL_DAYS)) - F.get(s["rain_to"], i)
            after = F.substring(s["dry_marks"], i + F.lit(WET_SPELL_DAYS + 1), F.lit(FOLLOW_DAYS)).cast("string")
            return (
                F.when(spell < F.lit(WET_SPELL_MM), F.lit("."))
                .when(F.instr(after, "d" * KILLING_DRY_DAYS) > 0, F.lit("k"))
                .otherwise(F.lit("s"))
            )

        starts = F.size(s["rain_to"]) - F.lit(WET_SPELL_DAYS + 1)
        letters = F.array_join(F.transform(F.sequence(F.lit(0), starts), mark), "")
        marks = F.when(starts >= F.lit(0), letters).otherwise(F.lit(""))
        return F.struct(s["rain_to"].alias("rain_to"), s["dry_marks"].alias("dry_marks"), marks.cast("binary").alias("season_marks"))

    index = bound(F.struct(rain_to.alias("rain_to"), dry_marks.alias("dry_marks")), season_marks)
    run_of = F.flatten(F.transform("runs", lambda r, i: F.array_repeat(i, r["days"])))
    return grouped.filter(complete).select(
        "site_id", "start_date", (last["start"] + last["days"]).alias("n_days"), "runs", run_of.alias("run_of"), index.alias("_index")
    ).select("site_id", "start_date", "n_days", "runs", "run_of", "_index.*")
