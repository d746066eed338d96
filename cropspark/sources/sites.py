"""Deterministic sampling of sites inside the zone boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cropspark.constants import SITE_SEED
from cropspark.functions.numeric import half_even


def radical_inverse(n: Column, base: int) -> Column:
    """Mirror the base-b digits of n behind the radix point."""
    digits = F.conv(n.cast("string"), 10, base)
    mirrored = F.conv(F.reverse(digits), base, 10).cast("double")
    return mirrored / F.pow(F.lit(float(base)), F.length(digits).cast("double"))


def place_in_box(ordinal: Column, low: Column, high: Column, base: int, seed: int = SITE_SEED) -> Column:
    return half_even(low + radical_inverse(ordinal + F.lit(seed), base) * (high - low), 4)


def sample_sites(ordinals: DataFrame, clusters: DataFrame, per_cluster_key: str | None = None) -> DataFrame:
    """Sites of every zone: each ordinal is placed in the box of each zone (or of its own zone).

    With ``per_cluster_key`` the ordinals already name their zone. Otherwise the result is the product by definition: each
    ordinal is repeated for every place in the catalogue and joined on it.
    """
    if per_cluster_key is not None:
        rows = ordinals.join(clusters, per_cluster_key)
    else:
        low, high = clusters.agg(F.min("cluster_idx"), F.max("cluster_idx")).first()
        places = F.array().cast("array<int>") if low is None else F.sequence(F.lit(low), F.lit(high))
        repeated = ordinals.select("ordinal", F.explode(places).alias("cluster_idx"))
        rows = repeated.join(clusters, "cluster_idx").select("ordinal", *clusters.columns)
    return rows.select(
        F.format_string("%s-%03d", F.col("cluster"), F.col("ordinal")).alias("site_name"),
        *[c for c in rows.columns if c not in ("lat0", "lat1", "lon0", "lon1")],
        place_in_box(F.col("ordinal"), F.col("lat0"), F.col("lat1"), 2).alias("latitude"),
        place_in_box(F.col("ordinal"), F.col("lon0"), F.col("lon1"), 3).alias("longitude"),
    )
