"""Hazard, exposure, vulnerability, their composition and the advisory wording."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from cropspark import constants as K
from cropspark.functions.numeric import clamp01, half_even, noisy_or


def vegetation_hazard(z: Column) -> Column:
    """Logistic of a peer anomaly, centred on the severe cut; a missing anomaly is no hazard."""
    h = F.lit(1.0) / (F.lit(1.0) + F.exp((z - F.lit(K.SEVERE_Z)) / F.lit(K.ANOMALY_SOFTNESS)))
    return F.coalesce(clamp01(h), F.lit(0.0))


def assess_hazard(
    water_satisfaction: Column,
    dry_spell_days: Column,
    severity_total: Column,
    heat_days: Column,
    vegetation: Column,
    spray_threshold: int = K.SPRAY_THRESHOLD,
) -> Column:
    drought = F.greatest(
        clamp01((F.lit(1.0) - water_satisfaction - F.lit(0.15)) / F.lit(0.5)),
        clamp01((dry_spell_days - F.lit(7)) / F.lit(14.0)),
    )
    parts = {
        "drought": drought,
        "disease": clamp01(severity_total / F.lit(float(max(1, spray_threshold)))),
        "heat": clamp01(heat_days / F.lit(3.0)),
        "vegetation": clamp01(vegetation),
    }
    top = F.greatest(*parts.values())
    dominant = reduce(
        lambda chain, name: chain.when(parts[name] == top, F.lit(name)),
        parts,
        F.when(~(top > F.lit(0.05)), F.lit("none")),
    )
    return F.struct(
        *[half_even(v, 3).alias(n) for n, v in parts.items()],
        half_even(noisy_or(list(parts.values())), 3).alias("combined"),
        dominant.alias("dominant"),
    )


def assess_exposure(area_ha: Column, yield_t_ha: Column, price_per_t: Column) -> Column:
    return half_even(F.greatest(F.lit(0.0), area_ha * yield_t_ha * price_per_t), 2)


def assert_no_protected(names: list[str]) -> None:
    leaked = K.PROTECTED_ATTRIBUTES & set(names)
    if leaked:
        raise ValueError(f"protected attributes must not drive vulnerability: {sorted(leaked)}")


def assess_vulnerability(signals: dict[str, Column]) -> Column:
    """Struct(score, coping_capacity, gaps). An absent signal counts as 0."""
    assert_no_protected(list(signals))
    values = {
        name: clamp01(F.coalesce(signals[name].cast("double"), F.lit(0.0))) if name in signals else F.lit(0.0)
        for name in K.COPING_WEIGHTS
    }
    weighted = reduce(lambda a, b: a + b, [F.lit(w) * values[n] for n, w in K.COPING_WEIGHTS.items()])
    capacity = weighted / F.lit(sum(K.COPING_WEIGHTS.values()))
    gaps = F.array_compact(F.array(*[F.when(values[n] < F.lit(K.COPING_GAP_CUT), F.lit(n)) for n in K.COPING_WEIGHTS]))
    return F.struct(
        half_even(F.lit(1.0) - capacity, 3).alias("score"),
        half_even(capacity, 3).alias("coping_capacity"),
        gaps.alias("gaps"),
    )


def assess_risk(combined: Column, value_at_risk: Column, vulnerability_score: Column) -> Column:
    """Struct(risk_score, expected_loss, severity) from the already rounded hazard and vulnerability."""
    loss = combined * (F.lit(0.5) + F.lit(0.5) * vulnerability_score) * F.lit(K.MAX_LOSS_FRACTION)
    score = half_even(F.lit(100.0) * clamp01(loss / F.lit(K.MAX_LOSS_FRACTION)), 1)
    severity = F.lit(K.LOWEST_BAND)
    for cut, name in reversed(K.RISK_BANDS):
        severity = F.when(score >= F.lit(cut), F.lit(name)).otherwise(severity)
    return F.struct(
        score.alias("risk_score"),
        half_even(value_at_risk * loss, 2).alias("expected_loss"),
        F.when(score.isNotNull(), severity).alias("severity"),
    )


def severity_class(severity: Column) -> Column:
    out = F.lit(None).cast("int")
    for name, cls in K.CLASS_BY_BAND.items():
        out = F.when(severity == F.lit(name), F.lit(cls)).otherwise(out)
    return out


def priority_label(cls: Column) -> Column:
    out = F.lit(None).cast("string")
    for value, name in K.PRIORITY_LABELS.items():
        out = F.when(cls == F.lit(value), F.lit(name)).otherwise(out)
    return out


def hazard_probabilities(hazard: Column) -> Column:
    """Map low/medium/high that recovers the hazard as 0.5 * medium + high."""
    h = clamp01(hazard)
    lower = h <= F.lit(0.5)
    low = F.when(lower, F.lit(1.0) - F.lit(2.0) * h).otherwise(F.lit(0.0))
    medium = F.when(lower, F.lit(2.0) * h).otherwise(F.lit(2.0) - F.lit(2.0) * h)
    high = F.when(lower, F.lit(0.0)).otherwise(F.lit(2.0) * h - F.lit(1.0))
    return F.create_map(
        F.lit("low"), half_even(low, 3), F.lit("medium"), half_even(medium, 3), F.lit("high"), half_even(high, 3)
    )


def expected_severity(p_medium: Column, p_high: Column) -> Column:
    return p_medium + F.lit(2.0) * p_high


def describe_gap(factor: Column) -> Column:
    text = F.concat(F.lit("Missing: "), F.replace(factor, F.lit("_"), F.lit(" ")))
    for name, wording in K.GAP_WORDING.items():
        text = F.when(factor == F.lit(name), F.lit(wording)).otherwise(text)
    return text


def whole(x: Column) -> Column:
    """A number as text without decimals, half to even."""
    return half_even(x, 0).cast("bigint").cast("string")


def drivers(
    hazard: Column,
    water_satisfaction: Column,
    water_deficit: Column,
    dry_spell: Column,
    heat_days: Column,
    rain_anomaly: Column,
    severity_total: Column,
    health: Column,
    gaps: Column,
) -> Column:
    """Ordered list of conditional sentences; one default sentence when none applies."""
    spray = severity_total >= F.lit(K.SPRAY_THRESHOLD)
    total = severity_total.cast("string")
    sentences = F.array(
        F.when(
            hazard["drought"] > F.lit(0.2),
            F.concat(
                F.lit("Water satisfaction "), whole(water_satisfaction * F.lit(100.0)), F.lit("% over 30 days ("),
                whole(water_deficit), F.lit(" mm unmet demand)"),
            ),
        ),
        F.when(
            dry_spell >= F.lit(8),
            F.concat(F.lit("Longest dry spell "), dry_spell.cast("string"), F.lit(" days in the last 30")),
        ),
        F.when(
            spray, F.concat(F.lit("Blight severity values at "), total, F.lit(", spray threshold (18) reached"))
        ).when(
            severity_total >= F.lit(9),
            F.concat(F.lit("Blight severity values accumulating ("), total, F.lit("/18)")),
        ),
        F.when(
            heat_days != F.lit(0),
            F.concat(heat_days.cast("string"), F.lit(" days above 35 °C during flowering")),
        ),
        F.when(
            hazard["vegetation"] > F.lit(0.35),
            F.concat(
                F.lit("Model projects canopy stress relative to peers within 30 days (hazard "),
                F.format_string("%.2f", half_even(hazard["vegetation"], 2)),
                F.lit(")"),
            ),
        ),
        F.when(
            health["score"] < F.lit(45),
            F.concat(F.lit("Crop Health Index "), whole(health["score"]), F.lit("/100 — "), health["status"]),
        ),
        F.when(
            rain_anomaly < F.lit(-20),
            F.concat(
                F.lit("Rainfall "), whole(F.abs(rain_anomaly)),
                F.lit(" mm below the site's normal for this time of year"),
            ),
        ),
    )
    first_gaps = F.array(*[describe_gap(F.get(gaps, F.lit(i))) for i in (0, 1)])
    all_of = F.array_compact(F.concat(sentences, first_gaps))
    return F.when(F.size(all_of) > 0, all_of).otherwise(F.array(F.lit(K.NO_DRIVERS)))


def _fill(template: str, crop: Column, stage: Column) -> Column:
    before, rest = template.split("{crop}")
    middle, after = rest.split("{stage}")
    return F.concat(F.lit(before), crop, F.lit(middle), stage, F.lit(after))


def recommended_action(severity: Column, hazard: Column, spray: Column, stage: Column, crop: Column) -> Column:
    dominant = hazard["dominant"]
    return (
        F.when(spray, F.lit(K.ACTION_SPRAY))
        .when(
            (dominant == "drought") & (hazard["drought"] > F.lit(0.4)), _fill(K.ACTION_DROUGHT, crop, stage)
        )
        .when(dominant == "heat", F.lit(K.ACTION_HEAT))
        .when(dominant == "disease", _fill(K.ACTION_DISEASE, crop, stage))
        .when(dominant == "vegetation", F.lit(K.ACTION_VEGETATION))
        .when(severity.isin("ELEVATED", "WATCH"), F.lit(K.ACTION_MONITOR))
        .otherwise(F.lit(K.ACTION_DEFAULT))
    )
