"""Golden values and properties of the scalar rules."""

import pytest
from pyspark.sql import functions as F

from cropspark.functions import agronomy as A
from cropspark.functions import farmer as FR
from cropspark.functions import numeric as N
from cropspark.functions import risk as R
from cropspark.functions import spectral as S
from cropspark.functions.labels import linear_to_db, month_index, month_keys, stress_class


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def L(x):
    return F.lit(x).cast("double")


def test_indices(spark):
    r = one(
        spark,
        ndvi=S.ndvi(L(0.4), L(0.1)), zero=S.ndvi(L(0.0), L(0.0)), evi=S.evi(L(0.4), L(0.1), L(0.05)), savi=S.savi(L(0.4), L(0.1)),
        rvi=S.rvi(L(0.2), L(0.05)), rvi0=S.rvi(L(0.0), L(0.0)), ratio=S.vh_vv_ratio(L(0.0), L(0.1)),
        vci=S.vci(L(0.5), L(0.2), L(0.8)), flat=S.vci(L(0.5), L(0.5), L(0.5)), high=S.vci(L(0.9), L(0.2), L(0.8)),
    )
    assert r.ndvi == pytest.approx(0.6) and r.zero == 0.0
    assert r.evi == pytest.approx(2.5 * 0.3 / (0.4 + 0.6 - 0.375 + 1.0))
    assert r.savi == pytest.approx(0.3 * 1.5 / 1.0)
    assert r.rvi == pytest.approx(0.8) and r.rvi0 == 0.0 and r.ratio is None
    assert r.vci == pytest.approx(50.0) and r.flat == 50.0 and r.high == 100.0


def test_standardisation_three_ways(spark):
    r = one(
        spark,
        plain=N.reference_z(L(0.32), L(0.5), L(0.1)), no_value=N.reference_z(L(None), L(0.5), L(0.1)), no_ref=N.reference_z(L(0.3), L(None), L(0.1)),
        no_sd=N.reference_z(L(0.3), L(0.5), L(None)), constant=N.reference_z(L(0.3), L(0.5), L(0.0)), z0=N.anomaly_z(L(1.0), L(0.0), L(1e-7)),
    )
    assert r.plain == pytest.approx(-1.8)
    assert r.no_value is None and r.no_ref is None
    assert r.no_sd == 0.0 and r.constant == 0.0 and r.z0 == 0.0


def test_missing_stays_missing(spark):
    nan, inf = F.lit(float("nan")), F.lit(float("inf"))
    r = one(spark, a=N.finite_or_null(nan), b=N.finite_or_null(-inf), c=N.finite_or_null(L(2.0)), d=N.clamp01(L(None)), e=N.finite(nan))
    assert r.a is None and r.b is None and r.c == 2.0 and r.d is None and r.e is False


def test_thermal_time_and_stage(spark):
    r = one(
        spark,
        capped=A.growing_degree_days(L(20), L(45)), limit=A.growing_degree_days(L(20), L(30)), cold=A.growing_degree_days(L(2), L(8)),
        emergence=A.phenology_stage(L(0)), edge=A.phenology_stage(L(120)), over=A.phenology_stage(L(1700)),
        rice=A.phenology_stage(L(110), F.lit(" RICE ")), other=A.phenology_stage(L(110), F.lit("yam")), none=A.phenology_stage(L(110), F.lit(None).cast("string")),
        kc=A.crop_coefficient(F.lit("Flowering")), unknown=A.crop_coefficient(F.lit("?")),
        hot=A.heat_stress_days(F.lit(3), F.lit("Flowering")), cool=A.heat_stress_days(F.lit(3), F.lit("Vegetative")),
        faw=A.fall_armyworm_generations(L(800.0)),
    )
    assert r.capped == r.limit == 15.0 and r.cold == 0.0
    assert (r.emergence, r.edge, r.over) == ("Emergence", "Vegetative", "Post-Harvest")
    assert (r.rice, r.other, r.none) == ("Vegetative", "Emergence", "Emergence")
    assert r.kc == 1.2 and r.unknown == 1.0 and r.hot == 3 and r.cool == 0 and r.faw == 2.05


def test_water_balance(spark):
    r = one(
        spark,
        dry=A.water_balance(L(20.0), L(100.0), F.lit("Flowering")), idle=A.water_balance(L(0.0), L(0.0), F.lit("Flowering")),
        wet=A.water_balance(L(500.0), L(100.0), F.lit("Flowering")), watered=A.water_balance(L(20.0), L(100.0), F.lit("Flowering"), 100.0),
    )
    assert (r.dry.requirement_mm, r.dry.deficit_mm, r.dry.satisfaction) == (120.0, 100.0, 0.167)
    assert r.idle.satisfaction == 1.0 and r.wet.satisfaction == 1.0 and r.wet.deficit_mm == 0.0
    assert r.watered.satisfaction == 1.0


@pytest.mark.parametrize("temp,hours,value", [(20, 24, 4), (20, 5, 0), (35, 24, 0), (11.65, 24, 0), (7.2, 16, 1), (15.0, 22, 4), (26.6, 11, 1)])
def test_severity(spark, temp, hours, value):
    assert one(spark, v=A.daily_severity(L(temp), F.lit(hours))).v == value


def test_crop_health(spark):
    h = one(spark, h=S.crop_health(L(0.5), L(0.1), L(0.2), L(0.8), L(0.5), L(0.1))).h
    assert (h.score, h.vigour, h.moisture, h.anomaly, h.status) == (50.0, 0.5, 0.5, 0.5, "Marginal")


def test_vegetation_hazard(spark):
    zs = [-3.0, -2.0, -1.0, 0.0, 1.0, 2.0]
    r = one(spark, **{f"h{i}": R.vegetation_hazard(L(z)) for i, z in enumerate(zs)}, missing=R.vegetation_hazard(L(None)))
    values = [r[f"h{i}"] for i in range(len(zs))]
    assert r.h2 == pytest.approx(0.5) and r.missing == 0.0
    assert all(a > b for a, b in zip(values, values[1:]))


def test_probabilities_recover_the_hazard(spark):
    hs = [0.0, 0.1, 0.37, 0.5, 0.73, 1.0]
    rows = spark.createDataFrame([(h,) for h in hs], "h double").select("h", R.hazard_probabilities(F.col("h")).alias("p")).collect()
    for r in rows:
        assert sum(r.p.values()) == pytest.approx(1.0)
        assert 0.5 * r.p["medium"] + r.p["high"] == pytest.approx(r.h, abs=1e-3)


def test_noisy_or_column_and_aggregate(spark):
    assert one(spark, v=N.noisy_or([L(0.4), L(0.4)])).v == pytest.approx(0.64)
    df = spark.createDataFrame([(0.4,), (0.4,), (-1.0,)], "p double")
    assert df.agg(N.noisy_or_agg(F.col("p")).alias("v")).first().v == pytest.approx(0.64)


def test_hazard_exposure_risk(spark):
    h = one(spark, h=R.assess_hazard(L(0.4), F.lit(5), F.lit(9), F.lit(0), L(0.0))).h
    assert (h.drought, h.disease, h.heat, h.dominant) == (0.9, 0.5, 0.0, "drought")
    assert h.combined == 0.95
    calm = one(spark, h=R.assess_hazard(L(1.0), F.lit(0), F.lit(0), F.lit(0), L(0.05))).h
    assert calm.dominant == "none"
    tie = one(spark, h=R.assess_hazard(L(1.0), F.lit(0), F.lit(9), F.lit(0), L(0.5))).h
    assert tie.dominant == "disease"
    r = one(spark, v=R.assess_exposure(L(2), L(3), L(250)), r=R.assess_risk(L(1.0), L(1500.0), L(1.0)), low=R.assess_risk(L(0.1), L(100.0), L(0.0)))
    assert r.v == 1500.0
    assert (r.r.risk_score, r.r.expected_loss, r.r.severity) == (100.0, 900.0, "CRITICAL")
    assert (r.low.risk_score, r.low.severity) == (5.0, "NORMAL")


def test_vulnerability_and_guard(spark):
    v = one(spark, v=R.assess_vulnerability({"asset_score": L(1.0), "has_irrigation": L(1.0)})).v
    assert v.coping_capacity == pytest.approx(2.0 / 5.4, abs=1e-3)
    assert v.gaps == ["has_extension_access", "received_credit", "used_fertilizer", "crop_diversity", "market_access"]
    with pytest.raises(ValueError, match="head_gender"):
        R.assess_vulnerability({"head_gender": L(1.0)})


def test_gap_wording_never_inverts(spark):
    r = one(spark, known=R.describe_gap(F.lit("has_irrigation")), other=R.describe_gap(F.lit("soil_depth")))
    assert r.known == "No irrigation available" and r.other == "Missing: soil depth"


def test_farm_rules(spark):
    arr = lambda *x: F.array(*[F.lit(v) for v in x]).cast("array<string>")
    r = one(
        spark,
        first=FR.dominant_crop(arr(" Rice ", "Maize")), blank=FR.dominant_crop(arr("  ")), empty=FR.dominant_crop(arr()),
        text=FR.dominant_crop_text(F.lit("Yam, Rice")), no_text=FR.dominant_crop_text(F.lit("  ")),
        size=FR.farm_size_ha(F.lit(" 3.5 ha")), bad=FR.farm_size_ha(F.lit("large")), none=FR.farm_size_ha(F.lit(None).cast("string")),
        reported=FR.expected_yield(L(2.2), L(0.1)), zero=FR.expected_yield(L(0.0), L(0.4)), absent=FR.expected_yield(L(None), L(None)),
        rice=FR.price_per_t(F.lit("RICE")), spaced=FR.price_per_t(F.lit(" rice")),
        cold=FR.coldstart_id(L(10.8), L(7.9)), uid=FR.well_formed_id(F.lit("0b6a2f5e-0c1d-4e2f-8a9b-001122334455")), no=FR.well_formed_id(F.lit("42")),
    )
    assert (r["first"], r.blank, r.empty, r.text, r.no_text) == ("Rice", "Maize", "Maize", "Yam", "Maize")
    assert (r.size, r.bad, r.none) == (3.5, 1.0, 1.0)
    assert (r.reported, r.zero, r.absent) == (2.2, 1.5, 0.5)
    assert r.rice == 420.0 and r.spaced == 250.0
    assert r.cold == "coldstart-10.8000-7.9000" and r.uid and not r.no


def test_coordinates(spark):
    rows = spark.createDataFrame([(90.0, 180.0), (90.1, 0.0), (None, 0.0), (0.0, -181.0)], "lat double, lon double")
    got = rows.select(FR.coordinate_problem(F.col("lat"), F.col("lon")).alias("p")).collect()
    assert [r.p for r in got] == [None, "coordinates out of range", "missing coordinates", "coordinates out of range"]


def test_labels_and_months(spark):
    d = F.lit("2025-03-15").cast("date")
    r = one(
        spark, severe=stress_class(L(-1.0)), mild=stress_class(L(-0.35)), fine=stress_class(L(-0.34)), missing=stress_class(L(None)),
        db=linear_to_db(L(0.1)), floor=linear_to_db(L(0.0)), months=month_keys(d), idx=month_index(d),
    )
    assert (r.severe, r.mild, r.fine, r.missing) == (2, 1, 0, 0)
    assert r.db == pytest.approx(-10.0) and r.floor == -50.0 and r.idx == 2
    assert len(r.months) == 12 and str(r.months[0]) == "2024-04-01" and str(r.months[-1]) == "2025-03-01"


def test_drivers_and_actions(spark):
    h = F.struct(L(0.5).alias("drought"), L(0.0).alias("disease"), L(0.0).alias("heat"), L(0.6).alias("vegetation"), F.lit("drought").alias("dominant"))
    calm = F.struct(L(0.0).alias("drought"), L(0.0).alias("disease"), L(0.0).alias("heat"), L(0.0).alias("vegetation"), F.lit("none").alias("dominant"))
    health = F.struct(L(30.4).alias("score"), F.lit("Stressed").alias("status"))
    good = F.struct(L(80.0).alias("score"), F.lit("Healthy").alias("status"))
    none = F.array().cast("array<string>")
    gaps = F.array(F.lit("has_irrigation"), F.lit("asset_score"), F.lit("market_access"))
    r = one(
        spark,
        full=R.drivers(h, L(0.42), L(61.5), F.lit(9), F.lit(2), L(-30.5), F.lit(18), health, gaps),
        quiet=R.drivers(calm, L(1.0), L(0.0), F.lit(0), F.lit(0), L(0.0), F.lit(0), good, none),
        spray=R.recommended_action(F.lit("WATCH"), calm, F.lit(True), F.lit("Flowering"), F.lit("Maize")),
        drought=R.recommended_action(F.lit("WATCH"), h, F.lit(False), F.lit("Flowering"), F.lit("Maize")),
        watch=R.recommended_action(F.lit("WATCH"), calm, F.lit(False), F.lit("Flowering"), F.lit("Maize")),
    )
    assert r.full == [
        "Water satisfaction 42% over 30 days (62 mm unmet demand)", "Longest dry spell 9 days in the last 30",
        "Blight severity values at 18, spray threshold (18) reached", "2 days above 35 °C during flowering",
        "Model projects canopy stress relative to peers within 30 days (hazard 0.60)", "Crop Health Index 30/100 — Stressed",
        "Rainfall 30 mm below the site's normal for this time of year", "No irrigation available", "Few productive assets",
    ]
    assert r.quiet == ["No critical stress drivers detected"]
    assert r.spray.startswith("Apply a protective fungicide")
    assert "Maize at Flowering is in water deficit" in r.drought
    assert r.watch.startswith("Increase monitoring")
