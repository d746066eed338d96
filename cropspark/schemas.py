"""Explicit schemas: nothing in this package infers a schema from data."""

from __future__ import annotations

from pyspark.sql import types as T

from cropspark.constants import BAND_KEYS, FEATURES, OPTICAL_KEYS, PAYLOAD_VARS, RADAR_KEYS

_D = T.DoubleType()
_INT_FEATURES = {"heat_stress_days", "dry_spell_30", "dry_spell_90", "days_since_onset"}


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


WEATHER_PAYLOAD = _struct(
    site_id=T.LongType(),
    latitude=_D,
    longitude=_D,
    elevation=_D,
    daily=_struct(time=T.ArrayType(T.StringType()), **{v: T.ArrayType(_D) for v in PAYLOAD_VARS}),
)
HOURLY_PAYLOAD = _struct(
    site_id=T.StringType(),
    hourly=_struct(
        time=T.ArrayType(T.StringType()),
        temperature_2m=T.ArrayType(_D),
        relative_humidity_2m=T.ArrayType(_D),
    ),
)


def statistics_payload(keys: list[str]) -> T.StructType:
    stats = _struct(mean=_D, sampleCount=T.LongType())
    band = _struct(bands=_struct(B0=_struct(stats=stats)))
    interval = _struct(**{"from": T.StringType(), "to": T.StringType()})
    return _struct(
        site_id=T.LongType(),
        data=T.ArrayType(_struct(interval=interval, outputs=_struct(**{k: band for k in keys}))),
    )


DAILY_WEATHER = _struct(
    site_id=T.LongType(), date=T.DateType(), tmax=_D, tmin=_D, rain=_D, et0=_D, rh=_D, radiation=_D
)
OPTICAL_OBS = _struct(site_id=T.LongType(), sensing_date=T.DateType(), **{k: _D for k in OPTICAL_KEYS})
RADAR_OBS = _struct(site_id=T.LongType(), sensing_date=T.DateType(), **{k: _D for k in RADAR_KEYS})
BAND_OBS = _struct(site_id=T.LongType(), sensing_date=T.DateType(), **{k: _D for k in BAND_KEYS})
HOURLY_WEATHER = _struct(site_id=T.StringType(), ts=T.TimestampNTZType(), temp=_D, rh=_D)
FEATURE_STRUCT = T.StructType(
    [T.StructField(c, T.IntegerType() if c in _INT_FEATURES else _D) for c in FEATURES]
)
CROP_HEALTH = _struct(score=_D, vigour=_D, moisture=_D, anomaly=_D, status=T.StringType())
CONTEXT_STRUCT = _struct(
    index_source=T.StringType(),
    sensing_date=T.DateType(),
    crop_health=CROP_HEALTH,
    dsv_total=T.LongType(),
    spray_due=T.BooleanType(),
)
FIELD_FEATURES = _struct(
    field_id=T.LongType(),
    computed_at=T.TimestampNTZType(),
    latitude=_D,
    longitude=_D,
    crop=T.StringType(),
    features=FEATURE_STRUCT,
    context=CONTEXT_STRUCT,
)
HAZARD = _struct(drought=_D, disease=_D, heat=_D, vegetation=_D, combined=_D, dominant=T.StringType())
VULNERABILITY = _struct(score=_D, coping_capacity=_D, gaps=T.ArrayType(T.StringType()))
PREDICTIONS = _struct(
    id=T.LongType(),
    field_id=T.LongType(),
    predicted_at=T.TimestampNTZType(),
    model_version=T.StringType(),
    feature_source=T.StringType(),
    features=FEATURE_STRUCT,
    risk_score=_D,
    severity=T.StringType(),
    dominant_hazard=T.StringType(),
    expected_loss=_D,
    hazard=HAZARD,
    vulnerability=VULNERABILITY,
    probabilities=T.MapType(T.StringType(), _D),
)
OUTCOMES = _struct(
    id=T.LongType(),
    prediction_id=T.LongType(),
    field_id=T.LongType(),
    observed_at=T.TimestampNTZType(),
    recorded_at=T.TimestampNTZType(),
    outcome_type=T.StringType(),
    stress_confirmed=T.BooleanType(),
    diagnosis=T.StringType(),
    yield_t_ha=_D,
    notes=T.StringType(),
    reported_by=T.StringType(),
)
STORE_TABLES = {"field_features": FIELD_FEATURES, "predictions": PREDICTIONS, "field_outcomes": OUTCOMES}
