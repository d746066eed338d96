"""Scalar rules applied to whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from cropspark import constants as K
from cropspark.functions import agronomy as A
from cropspark.functions import farmer as FR
from cropspark.functions import numeric as N
from cropspark.functions import registry
from cropspark.functions import risk as R
from cropspark.functions import spectral as S
from cropspark.functions.labels import linear_to_db
from cropspark.queries import oracle as O
from cropspark.queries.flatten import plain
from cropspark.queries.oracle import rounded

C = F.col


def _crop():
    return F.when(C("o_orderpriority") == "1-URGENT", " Sorghum ").when(C("o_orderpriority") == "2-HIGH", "RICE").when(
    C("o_orderpriority") == "3-MEDIUM", "millet").when(C("o_orderpriority") == "5-LOW", "maize")


CROP_SQL = "CASE o_orderpriority WHEN '1-URGENT' THEN ' Sorghum ' WHEN '2-HIGH' THEN 'RICE' WHEN '3-MEDIUM' THEN 'millet' WHEN '5-LOW' THEN 'maize' END"
STAGES = list(K.KC_BY_STAGE)


def _stage():
    return F.get(F.array(*[F.lit(s) for s in [*STAGES, "Unknown"]]), C("l_linenumber") - 1)


_STAGE_SQL = "[" + ", ".join(f"'{s}'" for s in [*STAGES, "Unknown"]) + "][l_linenumber]"
_KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
_KEYS_SQL = ", ".join(_KEYS)


def _nd(a, b):
    return f"CASE WHEN {a} + {b} = 0 THEN 0e0 ELSE ({a} - {b}) / ({a} + {b}) END"


def _spectral(d):
    a, b, q = C("l_discount"), C("l_tax"), C("l_quantity") / 50
    return d.raw("lineitem").select(
        *_KEYS, S.ndvi(a, b).alias("ndvi"), S.ndmi(b, a).alias("ndmi"), S.ndre(q, a).alias("ndre"), S.evi(a, b, q).alias("evi"),
        S.savi(a, b).alias("savi"), S.rvi(b, a).alias("rvi"), S.vh_vv_ratio(b, a).alias("ratio"),
    )


def _standardise(d):
    x, mu = C("l_quantity"), C("l_discount") * 500
    sd = F.floor(C("l_tax") * 100 / 3).cast("double")
    return d.raw("lineitem").select(
        *_KEYS, N.anomaly_z(x, mu, sd).alias("z"), N.reference_z(x, F.when(mu != 0, mu), F.when(sd != 2, sd)).alias("ref_z"),
        N.logistic(C("l_discount") - C("l_tax"), 0.01, 12.0).alias("squashed"), N.clamp01((x - 20) / 20).alias("unit"),
        S.vci(x, mu, mu + sd * 10).alias("vci"), N.half_even(x / 8, 2).alias("rounded"), linear_to_db(C("l_discount")).alias("db"),
    )


_STANDARD_SQL = f"""SELECT {_KEYS_SQL}, CASE WHEN sd <= 1e-6 THEN 0e0 ELSE (x - mu) / sd END AS z,
  {O.ref_z('x', 'nullif(mu, 0)', 'nullif(sd, 2)')} AS ref_z, 1e0 / (1e0 + exp(-12e0 * (l_discount - l_tax - 0.01e0))) AS squashed,
  greatest(0e0, least(1e0, (x - 20) / 20)) AS unit, {O.vci('x', 'mu', 'mu + sd * 10')} AS vci, round_even(x / 8, 2) AS rounded,
  CASE WHEN l_discount > 0 THEN 10e0 * log10(l_discount) ELSE -50e0 END AS db
  FROM (SELECT *, l_quantity AS x, l_discount * 500 AS mu, floor(l_tax * 100 / 3) AS sd FROM lineitem)"""


def _hazard_inputs(d):
    li = d.raw("lineitem")
    z = F.when(C("l_linenumber") != 7, (C("l_discount") - C("l_tax")) * 40)
    return li.select(
        *_KEYS, (C("l_quantity") / 50).alias("ws"), F.floor(C("l_discount") * 200).cast("int").alias("dry"),
        F.floor(C("l_tax") * 250).cast("int").alias("dsv"), (C("l_linenumber") - 4).alias("heat"), z.alias("z"),
        (C("l_extendedprice") / 30000).alias("area"), C("l_quantity").alias("yield"),
    )


def _hazards(d):
    base = _hazard_inputs(d).withColumn("veg", R.vegetation_hazard(C("z")))
    hazard = R.assess_hazard(C("ws"), C("dry"), C("dsv"), C("heat"), C("veg"))
    return base.select(*_KEYS, hazard.alias("h"), "area", "yield", "ws")


_HAZARD_SQL = f"""SELECT *, round_even(drought, 3) AS h_drought, round_even(disease, 3) AS h_disease, round_even(heat, 3) AS h_heat, round_even(veg, 3) AS h_vegetation,
    round_even(1e0 - (1e0 - drought) * (1e0 - disease) * (1e0 - heat) * (1e0 - veg), 3) AS h_combined,
    CASE WHEN NOT greatest(drought, disease, heat, veg) > 0.05e0 THEN 'none' WHEN drought >= greatest(disease, heat, veg) THEN 'drought'
         WHEN disease >= greatest(heat, veg) THEN 'disease' WHEN heat >= veg THEN 'heat' ELSE 'vegetation' END AS h_dominant
  FROM (SELECT {_KEYS_SQL}, l_quantity / 50 AS ws, l_extendedprice / 30000 AS area, l_quantity AS yield,
    greatest({O.clamp('(1e0 - l_quantity / 50 - 0.15e0) / 0.5e0')}, {O.clamp('(floor(l_discount * 200) - 7) / 14e0')}) AS drought,
    {O.clamp('floor(l_tax * 250) / 18e0')} AS disease, {O.clamp('(l_linenumber - 4) / 3e0')} AS heat,
    CASE WHEN l_linenumber = 7 THEN 0e0 ELSE {O.clamp('1e0 / (1e0 + exp(((l_discount - l_tax) * 40 + 1e0) / 0.5e0))')} END AS veg FROM lineitem)"""

_LOSS = "h_combined * (0.5e0 + 0.5e0 * ws) * 0.6e0"


def _risk(d):
    rows = _hazards(d).filter(C("ws").isNotNull())
    var = R.assess_exposure(C("area"), C("yield"), F.lit(12.5))
    risk = R.assess_risk(C("h.combined"), C("var"), C("ws"))
    staged = rows.withColumn("var", var).withColumn("r", risk)
    cls = R.severity_class(C("r.severity"))
    return staged.select(*_KEYS, C("var").alias("value_at_risk"), C("r.*"), cls.alias("cls"), R.priority_label(cls).alias("label"))


def _probabilities(d):
    h = R.vegetation_hazard((C("l_discount") - C("l_tax")) * 40)
    p = R.hazard_probabilities(h)
    return d.raw("lineitem").select(*_KEYS, h.alias("hazard"), p.alias("p"), R.expected_severity(p["medium"], p["high"]).alias("severity"))


def _vulnerability(d):
    survey = d.field_survey
    signals = FR.coping_signals(*[C(c) for c in (
        "has_extension_access", "received_credit", "used_fertilizer", "crop_diversity_score", "asset_score", "market_access_score")])
    v = R.assess_vulnerability(signals)
    return survey.select("field_id", v.alias("v"), F.transform(v["gaps"], R.describe_gap).alias("wording"))


_GAP = "CASE g " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in K.GAP_WORDING.items()) + " END"

QUERIES = {
    "fn01_fn04_spectral_indices": (
        lambda d: plain(_spectral(d)),
        rounded(f"""SELECT {_KEYS_SQL}, {_nd('l_discount', 'l_tax')} AS ndvi, {_nd('l_tax', 'l_discount')} AS ndmi, {_nd('l_quantity / 50', 'l_discount')} AS ndre,
                   CASE WHEN l_discount + 6e0 * l_tax - 7.5e0 * (l_quantity / 50) + 1e0 = 0 THEN 0e0
                        ELSE 2.5e0 * (l_discount - l_tax) / (l_discount + 6e0 * l_tax - 7.5e0 * (l_quantity / 50) + 1e0) END AS evi,
                   CASE WHEN l_discount + l_tax + 0.5e0 = 0 THEN 0e0 ELSE (l_discount - l_tax) * 1.5e0 / (l_discount + l_tax + 0.5e0) END AS savi,
                   CASE WHEN l_tax + l_discount > 0 THEN 4e0 * l_discount / (l_tax + l_discount) ELSE 0e0 END AS rvi,
                   CASE WHEN l_tax <> 0 THEN l_discount / l_tax END AS ratio FROM lineitem""",
                "ndvi", "ndmi", "ndre", "evi", "savi", "rvi", "ratio"),
    ),
    "fn05_fn06_fn08_fn36_standardise_and_round": (
        lambda d: plain(_standardise(d)),
        rounded(_STANDARD_SQL, "z", "ref_z", "squashed", "unit", "vci", "rounded", "db"),
    ),
    "fn10_fn16_degree_days": (
        lambda d: plain(d.daily_weather.select(
            "site_id", "date", A.growing_degree_days(C("tmin"), C("tmax")).alias("gdd"), A.is_hot(C("tmax")).alias("hot"),
            A.fall_armyworm_generations(A.growing_degree_days(C("tmin"), C("tmax")) * 90).alias("generations"))),
        rounded(f"""SELECT site_id, CAST(date AS VARCHAR) AS date, {O.gdd('tmin', 'tmax')} AS gdd, CAST(tmax >= 35 AS INTEGER) AS hot,
                    round_even({O.gdd('tmin', 'tmax')} * 90 / 390e0, 2) AS generations FROM daily""", "gdd", "generations"),
    ),
    "fn11_fn12_join15_stage_and_coefficient": (
        lambda d: plain(d.raw("orders").select("o_orderkey", A.phenology_stage(C("o_totalprice") / 240, _crop()).alias("stage")).withColumn(
            "kc", A.crop_coefficient(C("stage")))),
        rounded(f"""SELECT o_orderkey, stage, {O.kc('stage')} AS kc FROM (SELECT o_orderkey, {O.stage('o_totalprice / 240', f'({CROP_SQL})')} AS stage FROM orders)""", "kc"),
    ),
    "fn13_fn14_water_balance": (
        lambda d: plain(d.raw("lineitem").select(
            *_KEYS, A.water_balance(C("l_quantity") * 4 + F.floor(C("l_tax") * 100), F.floor(C("l_extendedprice") / 500).cast("double"), _stage(), 1.5).alias("w"),
            A.heat_stress_days(F.floor(C("l_discount") * 100), _stage()).alias("heat_days"))),
        rounded(f"""SELECT {_KEYS_SQL}, round_even(need, 1) AS w_requirement_mm, round_even(supply, 1) AS w_rainfall_mm, round_even(greatest(0e0, need - supply), 1) AS w_deficit_mm,
                    round_even(CASE WHEN need <= 1e-6 THEN 1e0 ELSE least(1e0, supply / need) END, 3) AS w_satisfaction,
                    CAST(CASE WHEN stage = 'Flowering' THEN floor(l_discount * 100) ELSE 0 END AS INTEGER) AS heat_days
                    FROM (SELECT *, l_quantity * 4 + floor(l_tax * 100) + 1.5e0 AS supply, ({O.kc('stage')}) * floor(l_extendedprice / 500) AS need
                          FROM (SELECT *, {_STAGE_SQL} AS stage FROM lineitem))""", "w_requirement_mm", "w_rainfall_mm", "w_deficit_mm", "w_satisfaction"),
    ),
    "fn15_daily_severity": (
        lambda d: plain(d.raw("events").select("event_id", A.daily_severity(F.bround(C("value") % 35, 1), F.hour("ts") + F.pmod("user_id", F.lit(4))).alias("dsv"))),
        rounded(f"""SELECT event_id, {O.dsv('t', 'h')} AS dsv FROM (SELECT event_id, round_even(value % 35, 1) AS t, hour(ts) + user_id % 4 AS h FROM events)"""),
    ),
    "fn17_fn22_fn23_hazard_probabilities": (
        lambda d: plain(_probabilities(d)),
        rounded(f"""SELECT {_KEYS_SQL}, h AS hazard, p_low, p_medium, p_high, p_medium + 2e0 * p_high AS severity FROM (
                    SELECT *, round_even(CASE WHEN h <= 0.5e0 THEN 1e0 - 2e0 * h ELSE 0e0 END, 3) AS p_low,
                           round_even(CASE WHEN h <= 0.5e0 THEN 2e0 * h ELSE 2e0 - 2e0 * h END, 3) AS p_medium,
                           round_even(CASE WHEN h <= 0.5e0 THEN 0e0 ELSE 2e0 * h - 1e0 END, 3) AS p_high
                    FROM (SELECT *, {O.clamp('1e0 / (1e0 + exp(((l_discount - l_tax) * 40 + 1e0) / 0.5e0))')} AS h FROM lineitem))""",
                "hazard", "p_low", "p_medium", "p_high", "severity"),
    ),
    "fn18_agg11_hazard": (
        lambda d: plain(_hazards(d).select(*_KEYS, "h")),
        rounded(f"SELECT {_KEYS_SQL}, h_drought, h_disease, h_heat, h_vegetation, h_combined, h_dominant FROM ({_HAZARD_SQL})",
                "h_drought", "h_disease", "h_heat", "h_vegetation", "h_combined"),
    ),
    "fn19_fn20_fn21_risk": (
        lambda d: plain(_risk(d)),
        rounded(f"""SELECT {_KEYS_SQL}, value_at_risk, risk_score, expected_loss, severity,
                    CAST(CASE severity WHEN 'CRITICAL' THEN 2 WHEN 'ELEVATED' THEN 1 ELSE 0 END AS INTEGER) AS cls,
                    CASE severity WHEN 'CRITICAL' THEN 'High Priority' WHEN 'ELEVATED' THEN 'Medium Priority' ELSE 'Low Priority' END AS label FROM (
                    SELECT *, round_even(value_at_risk * loss, 2) AS expected_loss,
                      CASE WHEN risk_score >= 65 THEN 'CRITICAL' WHEN risk_score >= 35 THEN 'ELEVATED' WHEN risk_score >= 15 THEN 'WATCH' ELSE 'NORMAL' END AS severity FROM (
                    SELECT *, {_LOSS} AS loss, round_even(100e0 * least(1e0, {_LOSS} / 0.6e0), 1) AS risk_score,
                           round_even(greatest(0e0, area * yield * 12.5e0), 2) AS value_at_risk FROM ({_HAZARD_SQL})))""",
                "value_at_risk", "risk_score", "expected_loss"),
    ),
    "agg12_fn29_fn30_vulnerability": (
        lambda d: plain(_vulnerability(d)),
        rounded(f"""SELECT field_id, v_score, capacity AS v_coping_capacity, array_to_string(gaps, '|') AS v_gaps,
                    array_to_string(list_transform(gaps, lambda g: {_GAP}), '|') AS wording FROM vulnerable""", "v_score", "v_coping_capacity"),
    ),
    "fn26_fn27_fn28_farm_inputs": (
        lambda d: plain(d.farmers.select(
            "user_id", FR.dominant_crop(C("crops")).alias("crop"),
            FR.dominant_crop_text(F.array_join("crops", ", ")).alias("crop_text"), FR.farm_size_ha(C("farm_size")).alias("area_ha"),
            FR.expected_yield(C("yield_value"), C("market_access_score") / 100).alias("yield_t_ha"),
            FR.price_per_t(FR.dominant_crop(C("crops"))).alias("price"))),
        rounded("""SELECT user_id, coalesce(nullif(trim(crops[1]), ''), 'Maize') AS crop,
                   CASE WHEN trim(array_to_string(crops, ', ')) <> '' THEN trim(split_part(array_to_string(crops, ', '), ',', 1)) ELSE 'Maize' END AS crop_text,
                   coalesce(TRY_CAST(split_part(trim(farm_size), ' ', 1) AS DOUBLE), 1e0) AS area_ha,
                   CASE WHEN yield_value > 0 THEN yield_value
                        ELSE round_even(greatest(0.5e0, least(5e0, 1.5e0 + (coalesce(market_access_score / 100, 0e0) - 0.4e0) * 3.5e0)), 2) END AS yield_t_ha,
                   CASE lower(coalesce(nullif(trim(crops[1]), ''), 'Maize')) WHEN 'maize' THEN 250e0 WHEN 'sorghum' THEN 230e0 WHEN 'rice' THEN 420e0 WHEN 'cassava' THEN 120e0 ELSE 250e0 END AS price
                   FROM farmers""", "area_ha", "yield_t_ha", "price"),
    ),
}


# --- the same rules called from SQL text: every query below must match the SQL of its Column form -------------------------


def _in_sql(text: str, **views):
    """A query of spark.sql over temporary views, with the rules registered as SQL functions."""

    def build(d):
        registry.register(d.spark)
        for name, make in views.items():
            make(d).createOrReplaceTempView(f"rules_{name}")
        return plain(d.spark.sql(text))

    return build


def _raw(table):
    return lambda d: d.raw(table)


_KEY_TEXT = ", ".join(_KEYS)
_STAGE_TEXT = "get(array(" + ", ".join(f"'{s}'" for s in [*STAGES, "Unknown"]) + "), CAST(l_linenumber - 1 AS INT))"

_SQL_FORMS = {
    "fn01_fn04_spectral_indices": _in_sql(
        f"""SELECT {_KEY_TEXT}, ndvi(l_discount, l_tax) AS ndvi, ndmi(l_tax, l_discount) AS ndmi, ndre(l_quantity / 50, l_discount) AS ndre,
            evi(l_discount, l_tax, l_quantity / 50) AS evi, savi(l_discount, l_tax) AS savi, rvi(l_tax, l_discount) AS rvi,
            vh_vv_ratio(l_tax, l_discount) AS ratio FROM rules_lineitem""",
        lineitem=_raw("lineitem"),
    ),
    "fn05_fn06_fn08_fn36_standardise_and_round": _in_sql(
        f"""SELECT {_KEY_TEXT}, anomaly_z(x, mu, sd) AS z, reference_z(x, nullif(mu, 0D), nullif(sd, 2D)) AS ref_z,
            logistic(l_discount - l_tax, 0.01D, 12D) AS squashed, clamp01((x - 20) / 20) AS unit, vci(x, mu, mu + sd * 10) AS vci,
            half_even_2(x / 8) AS rounded, linear_to_db(l_discount) AS db
            FROM (SELECT *, l_quantity AS x, l_discount * 500 AS mu, CAST(floor(l_tax * 100 / 3) AS DOUBLE) AS sd FROM rules_lineitem)""",
        lineitem=_raw("lineitem"),
    ),
    "fn10_fn16_degree_days": _in_sql(
        """SELECT site_id, date, growing_degree_days(tmin, tmax) AS gdd, is_hot(tmax) AS hot,
           fall_armyworm_generations(growing_degree_days(tmin, tmax) * 90) AS generations FROM rules_daily""",
        daily=lambda d: d.daily_weather,
    ),
    "fn11_fn12_join15_stage_and_coefficient": _in_sql(
        f"SELECT o_orderkey, stage, crop_coefficient(stage) AS kc FROM (SELECT o_orderkey, phenology_stage(o_totalprice / 240, {CROP_SQL}) AS stage FROM rules_orders)",
        orders=_raw("orders"),
    ),
    "fn13_fn14_water_balance": _in_sql(
        f"""SELECT {_KEY_TEXT}, named_struct('requirement_mm', w.requirement_mm, 'rainfall_mm', half_even_1(rain + 1.5D), 'deficit_mm', half_even_1(greatest(0D, need - rain - 1.5D)),
            'satisfaction', half_even_3(CASE WHEN need <= 1e-6 THEN 1D ELSE least(1D, (rain + 1.5D) / need) END)) AS w, heat_stress_days(CAST(floor(l_discount * 100) AS INT), stage) AS heat_days
            FROM (SELECT *, water_balance(rain, et0, stage) AS w, crop_coefficient(stage) * et0 AS need FROM (
              SELECT *, l_quantity * 4 + floor(l_tax * 100) AS rain, CAST(floor(l_extendedprice / 500) AS DOUBLE) AS et0, {_STAGE_TEXT} AS stage FROM rules_lineitem))""",
        lineitem=_raw("lineitem"),
    ),
    "fn15_daily_severity": _in_sql(
        "SELECT event_id, daily_severity(half_even_1(value % 35), CAST(hour(ts) + pmod(user_id, 4) AS INT)) AS dsv FROM rules_events", events=_raw("events")
    ),
    "fn17_fn22_fn23_hazard_probabilities": _in_sql(
        f"""SELECT {_KEY_TEXT}, hazard, p, expected_severity(p['medium'], p['high']) AS severity FROM (
            SELECT *, hazard_probabilities(hazard) AS p FROM (SELECT *, vegetation_hazard((l_discount - l_tax) * 40) AS hazard FROM rules_lineitem))""",
        lineitem=_raw("lineitem"),
    ),
    "fn18_agg11_hazard": _in_sql(
        f"SELECT {_KEY_TEXT}, assess_hazard(ws, dry, CAST(dsv AS BIGINT), CAST(heat AS INT), vegetation_hazard(z)) AS h FROM rules_hazards", hazards=_hazard_inputs
    ),
    "fn19_fn20_fn21_risk": _in_sql(
        f"""SELECT {_KEY_TEXT}, value_at_risk, r.risk_score, r.expected_loss, r.severity, severity_class(r.severity) AS cls, priority_label(severity_class(r.severity)) AS label FROM (
            SELECT *, assess_risk(h.combined, value_at_risk, ws) AS r FROM (
              SELECT *, assess_hazard(ws, dry, CAST(dsv AS BIGINT), CAST(heat AS INT), vegetation_hazard(z)) AS h, assess_exposure(area, yield, 12.5D) AS value_at_risk
              FROM rules_hazards)) WHERE ws IS NOT NULL""",
        hazards=_hazard_inputs,
    ),
    "agg12_fn29_fn30_vulnerability": _in_sql(
        f"""SELECT field_id, v, array_compact(array({', '.join(f'describe_gap(get(v.gaps, {i}))' for i in range(len(K.COPING_WEIGHTS)))})) AS wording FROM (
           SELECT field_id, assess_vulnerability(has_extension_access, received_credit, used_fertilizer, crop_diversity_score, asset_score, market_access_score) AS v FROM rules_survey)""",
        survey=lambda d: d.field_survey,
    ),
    "fn26_fn27_fn28_farm_inputs": _in_sql(
        """SELECT user_id, dominant_crop(crops) AS crop, dominant_crop_text(array_join(crops, ', ')) AS crop_text, farm_size_ha(farm_size) AS area_ha,
           expected_yield(yield_value, market_access_score / 100) AS yield_t_ha, price_per_t(dominant_crop(crops)) AS price FROM rules_farmers""",
        farmers=lambda d: d.farmers,
    ),
}

QUERIES |= {f"{name}_from_sql": (build, QUERIES[name][1]) for name, build in _SQL_FORMS.items()}
