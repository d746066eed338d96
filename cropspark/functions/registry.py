"""The scalar rules as temporary SQL functions of the same names.

The body of each function is the rule's own expression, written out by the analyzer, so SQL text and Column code run the same
plan: nothing is evaluated in Python. Rules over groups of rows (quantile cuts, means) are operators and stay out of here.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from cropspark.functions import agronomy, farmer, labels, numeric, risk, spectral

_HAZARD = "struct<drought: double, disease: double, heat: double, vegetation: double, combined: double, dominant: string>"
_HEALTH = "struct<score: double, vigour: double, moisture: double, anomaly: double, status: string>"
_SIGNALS = "extension boolean, credit boolean, fertilizer boolean, diversity double, assets double, market double"


def _coping(*survey: Column) -> Column:
    signals = farmer.coping_signals(*survey)
    return F.struct(*[v.alias(k) for k, v in signals.items()])


#: name -> (rule, parameters with their types)
FUNCTIONS: dict[str, tuple[Callable[..., Column], str]] = {
    "ndvi": (spectral.ndvi, "nir double, red double"),
    "ndmi": (spectral.ndmi, "nir double, swir1 double"),
    "ndre": (spectral.ndre, "nir double, red_edge double"),
    "evi": (spectral.evi, "nir double, red double, blue double"),
    "savi": (spectral.savi, "nir double, red double"),
    "rvi": (spectral.rvi, "vv double, vh double"),
    "vh_vv_ratio": (spectral.vh_vv_ratio, "vv double, vh double"),
    "anomaly_z": (numeric.anomaly_z, "observed double, mean double, sd double"),
    "reference_z": (numeric.reference_z, "observed double, mu double, sigma double"),
    "vci": (spectral.vci, "latest double, low double, high double"),
    "clamp01": (numeric.clamp01, "x double"),
    "logistic": (
        lambda x, midpoint, steepness: F.lit(1.0) / (F.lit(1.0) + F.exp(-steepness * (x - midpoint))),
        "x double, midpoint double, steepness double",
    ),
    "crop_health": (spectral.crop_health, "ndvi_now double, ndmi_now double, low double, high double, mean double, sd double"),
    "growing_degree_days": (agronomy.growing_degree_days, "tmin double, tmax double"),
    "phenology_stage": (agronomy.phenology_stage, "gdd double, crop string"),
    "crop_coefficient": (agronomy.crop_coefficient, "stage string"),
    "water_balance": (agronomy.water_balance, "rain_sum double, et0_sum double, stage string"),
    "heat_stress_days": (agronomy.heat_stress_days, "hot_days int, stage string"),
    "is_hot": (agronomy.is_hot, "tmax double"),
    "daily_severity": (agronomy.daily_severity, "wet_temp double, wet_hours int"),
    "spray_due": (agronomy.spray_due, "total bigint"),
    "fall_armyworm_generations": (agronomy.fall_armyworm_generations, "gdd double"),
    "vegetation_hazard": (risk.vegetation_hazard, "z double"),
    "assess_hazard": (risk.assess_hazard, "water_satisfaction double, dry_spell_days int, severity_total bigint, heat_days int, vegetation double"),
    "assess_exposure": (risk.assess_exposure, "area_ha double, yield_t_ha double, price double"),
    "assess_risk": (risk.assess_risk, "combined double, value_at_risk double, vulnerability_score double"),
    "severity_class": (risk.severity_class, "severity string"),
    "priority_label": (risk.priority_label, "cls int"),
    "hazard_probabilities": (risk.hazard_probabilities, "hazard double"),
    "expected_severity": (risk.expected_severity, "p_medium double, p_high double"),
    "stress_class": (labels.stress_class, "z double"),
    "persistence_risk": (lambda z: -z, "z double"),
    "dominant_crop": (farmer.dominant_crop, "crops array<string>"),
    "dominant_crop_text": (farmer.dominant_crop_text, "crops string"),
    "farm_size_ha": (farmer.farm_size_ha, "farm_size string"),
    "price_per_t": (farmer.price_per_t, "crop string"),
    "expected_yield": (farmer.expected_yield, "reported double, greenness double"),
    "coping_signals": (_coping, _SIGNALS),
    "assess_vulnerability": (lambda *survey: risk.assess_vulnerability(farmer.coping_signals(*survey)), _SIGNALS),
    "describe_gap": (risk.describe_gap, "factor string"),
    "risk_drivers": (
        risk.drivers,
        f"hazard {_HAZARD}, water_satisfaction double, water_deficit double, dry_spell int, heat_days int, rain_anomaly double, "
        f"severity_total bigint, health {_HEALTH}, gaps array<string>",
    ),
    "recommended_action": (risk.recommended_action, f"severity string, hazard {_HAZARD}, spray boolean, stage string, crop string"),
    "linear_to_db": (labels.linear_to_db, "power double"),
    "month_keys": (labels.month_keys, "day date"),
    "month_index": (labels.month_index, "day date"),
    "coldstart_id": (farmer.coldstart_id, "lat double, lon double"),
    "usable_coordinates": (farmer.usable_coordinates, "lat double, lon double"),
    "coordinate_problem": (farmer.coordinate_problem, "lat double, lon double"),
    "well_formed_id": (farmer.well_formed_id, "id string"),
    "bucket_month": (lambda day: F.month(day), "day date"),
    **{f"half_even_{n}": (lambda x, n=n: numeric.half_even(x, n), "x double") for n in range(5)},
}


def definition(spark: SparkSession, name: str) -> str:
    """CREATE statement of one function."""
    rule, parameters = FUNCTIONS[name]
    inputs = spark.createDataFrame([], parameters)
    made = inputs.select(rule(*[F.col(c) for c in inputs.columns]).alias("out"))
    body = made._jdf.queryExecution().analyzed().expressions().head().child().sql()
    kind = made.schema["out"].dataType.simpleString()
    return f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}"


def register(spark: SparkSession, names: list[str] | None = None) -> list[str]:
    """Register the rules in the session; returns their names. Registering again replaces them."""
    chosen = list(FUNCTIONS) if names is None else names
    for name in chosen:
        spark.sql(definition(spark, name))
    return chosen
