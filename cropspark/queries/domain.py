"""Domain tables of one test-data folder, built on demand."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cropspark.constants import BAND_KEYS, OPTICAL_KEYS, PAYLOAD_VARS, RADAR_KEYS, WEATHER_VARS
from cropspark.functions.farmer import dominant_crop
from cropspark.operators.peers import peer_stats, with_peer_z
from cropspark.plans import farmers as farmer_plans
from cropspark.plans.features import field_features, severity_by_station, site_state
from cropspark.plans.scoring import assess, hazard_anomaly
from cropspark.plans.training import build_samples, canopy_samples
from cropspark.session import cut_lineage
from cropspark.sources import mapping as M
from cropspark.streaming.runs import scratch


class Domain:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        builder = getattr(M, name, None)
        if builder is None:
            raise AttributeError(name)
        return builder(self.spark, self.folder)

    def raw(self, name: str) -> DataFrame:
        return M.table(self.spark, self.folder, name)

    @cached_property
    def n_clusters(self) -> int:
        """Size of the zone catalogue, the bound of every cluster-keyed reference."""
        return self.clusters.count()

    @cached_property
    def last_hourly_day(self):
        """The day up to which hourly readings have arrived."""
        return self.hourly_weather.agg(F.max(F.to_date("ts"))).first()[0]

    # the observations of a site, written once for the coverage, the canopy rows, the site state and the windows that read them

    @cached_property
    def stored_weather(self) -> DataFrame:
        return cut_lineage(self.daily_weather)

    @cached_property
    def stored_optical(self) -> DataFrame:
        return cut_lineage(self.optical_obs)

    @cached_property
    def stored_radar(self) -> DataFrame:
        return cut_lineage(self.radar_obs)

    @cached_property
    def canopy(self) -> DataFrame:
        """Labelled canopy rows, written once: the peer reference and its users both start from the files."""
        return cut_lineage(
            canopy_samples(self.stored_weather, self.stored_optical, self.stored_radar, self.sites, self.n_clusters)
        )

    @cached_property
    def canopy_z(self) -> DataFrame:
        return with_peer_z(self.canopy, peer_stats(self.canopy), self.n_clusters)

    @cached_property
    def samples(self) -> DataFrame:
        return build_samples(self.stored_weather, self.stored_optical, self.stored_radar, self.sites, self.n_clusters)

    @cached_property
    def stored_samples(self) -> DataFrame:
        """The sample set as files, for jobs that pass over it more than once."""
        return cut_lineage(self.samples)

    @cached_property
    def located_farms(self) -> DataFrame:
        """The latest farm of every farmer at its site, written once: the farmer rows and the choice of crop lines read it."""
        latest = farmer_plans.latest_farm(self.farms).select(*self.farms.columns)
        return cut_lineage(farmer_plans.located_farms(latest, self.farm_sites, self.sites))

    @cached_property
    def farmers(self) -> DataFrame:
        survey = self.survey.drop("head_gender")
        return farmer_plans.farmer_features(
            self.farmer_profiles, self.located_farms, self.farm_crops, self.crops, survey, self.farms
        )

    @cached_property
    def stored_farmers(self) -> DataFrame:
        """Fields and survey answers both come from the farmer rows, so those are written once."""
        return cut_lineage(self.farmers)

    @cached_property
    def fields(self) -> DataFrame:
        usable, _ = farmer_plans.split_by_coordinates(self.stored_farmers)
        return usable.select(
            F.col("user_id").alias("field_id"), "site_id", "latitude", "longitude", dominant_crop(F.col("crops")).alias("crop")
        )

    @cached_property
    def site_state(self) -> DataFrame:
        """One row per site, written once for all the fields that share it."""
        return cut_lineage(
            site_state(
                self.stored_weather, self.stored_optical, self.stored_radar, severity_by_station(self.hourly_weather, self.last_hourly_day),
                self.sites, self.clusters, peer_stats(self.canopy), self.n_clusters,
            )
        )

    @cached_property
    def field_rows(self) -> DataFrame:
        return field_features(self.fields, self.site_state)

    @cached_property
    def field_survey(self) -> DataFrame:
        return self.stored_farmers.select(
            F.col("user_id").alias("field_id"), "farm_size", *farmer_plans.SURVEY_COLUMNS, "crop_diversity_score"
        )

    @cached_property
    def assessed(self) -> DataFrame:
        return assess(hazard_anomaly(self.field_rows), self.field_survey)

    def landed(self, payloads: DataFrame) -> str:
        """The payloads as landed JSON files; returns their folder."""
        path = scratch(self.spark, "landed")
        payloads.write.json(path)
        return path

    # --- the same tables in the shape in which providers deliver them ---

    @cached_property
    def weather_payloads(self) -> DataFrame:
        rows = F.sort_array(F.collect_list(F.struct("date", *WEATHER_VARS)))
        grouped = self.daily_weather.groupBy("site_id").agg(rows.alias("r"))
        daily = F.struct(
            F.col("r.date").cast("array<string>").alias("time"),
            *[F.col(f"r.{v}").alias(p) for v, p in zip(WEATHER_VARS, PAYLOAD_VARS)],
        )
        return grouped.select("site_id", daily.alias("daily"))

    @cached_property
    def hourly_payloads(self) -> DataFrame:
        """One payload for each station and day, so no payload grows with the series."""
        rows = F.sort_array(F.collect_list(F.struct("ts", "temp", "rh")))
        grouped = self.hourly_weather.groupBy("site_id", F.to_date("ts").alias("_day")).agg(rows.alias("r"))
        hourly = F.struct(
            F.col("r.ts").cast("array<string>").alias("time"),
            F.col("r.temp").alias("temperature_2m"),
            F.col("r.rh").alias("relative_humidity_2m"),
        )
        return grouped.select("site_id", hourly.alias("hourly"))

    def statistics_payloads(self, obs: DataFrame, keys: list[str]) -> DataFrame:
        outputs = F.struct(
            *[
                F.struct(
                    F.struct(
                        F.struct(
                            F.struct(F.col(k).alias("mean"), F.when(F.col(keys[0]) == 0, 0).otherwise(9).alias("sampleCount")).alias("stats")
                        ).alias("B0")
                    ).alias("bands")
                ).alias(k)
                for k in keys
            ]
        )
        interval = F.struct(F.concat(F.col("sensing_date").cast("string"), F.lit("T00:00:00Z")).alias("to"))
        rows = F.collect_list(F.struct(interval.alias("interval"), outputs.alias("outputs")))
        return obs.groupBy("site_id").agg(rows.alias("data"))

    @cached_property
    def optical_payloads(self) -> DataFrame:
        return self.statistics_payloads(self.optical_obs, OPTICAL_KEYS)

    @cached_property
    def radar_payloads(self) -> DataFrame:
        return self.statistics_payloads(self.radar_obs, RADAR_KEYS)

    @cached_property
    def band_payloads(self) -> DataFrame:
        return self.statistics_payloads(self.band_obs, BAND_KEYS)
