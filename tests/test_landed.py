"""Scans of landed JSON files."""

import json

from cropspark.constants import PAYLOAD_VARS
from cropspark.sources import landed


def write(path, rows):
    path.write_text("\n".join(json.dumps(r) for r in rows))
    return str(path)


def test_daily_scan(spark, tmp_path):
    daily = {"time": ["2026-05-10", "2026-05-11"], **{v: [1.0, None] for v in PAYLOAD_VARS[:-1]}}
    path = write(tmp_path / "w.json", [{"site_id": 4, "elevation": 463.0, "daily": daily}])
    rows = landed.daily_from_payload(landed.weather_payloads(spark, path)).orderBy("date").collect()
    assert [str(r.date) for r in rows] == ["2026-05-10", "2026-05-11"]
    assert rows[0].rain == 1.0 and rows[1].rain is None and rows[0].radiation is None


def band(mean, n):
    return {"bands": {"B0": {"stats": {"mean": mean, "sampleCount": n}}}}


def test_observation_scan(spark, tmp_path):
    def iv(to, **outputs):
        return {"interval": {"from": "x", "to": to}, "outputs": outputs}

    ok = {"ndvi": band(0.5, 4), "ndwi": band(0.1, 4), "evi": band(0.6, 4)}
    rows = [
        {"site_id": 1, "data": [iv("2025-01-30T00:00:00Z", **ok), iv("2025-03-01T00:00:00Z", **{**ok, "evi": band(0.1, 0)}),
                                iv("2025-03-31T00:00:00Z", **{**ok, "ndwi": band(None, 3)}), iv("2025-04-30T00:00:00Z", ndvi=band(0.1, 3))]},
        {"site_id": 2, "data": []},
    ]
    payloads = landed.statistics_payloads(spark, write(tmp_path / "o.json", rows), ["ndvi", "ndwi", "evi"])
    got = landed.optical_observations(payloads).collect()
    assert [(r.site_id, str(r.sensing_date), r.ndvi) for r in got] == [(1, "2025-01-30", 0.5)]
    assert [r.site_id for r in landed.landed_with_data(payloads).collect()] == [1]
    sites = spark.createDataFrame([(1,), (2,)], "site_id long")
    assert [r.site_id for r in landed.sites_to_reingest(sites, landed.landed_with_data(payloads)).collect()] == [2]


def test_short_humidity_series(spark, tmp_path):
    hourly = {"time": ["2025-01-01T00:00", "2025-01-01T01:00"], "temperature_2m": [20.0, 21.0], "relative_humidity_2m": [95.0]}
    path = write(tmp_path / "h.json", [{"site_id": 1, "hourly": hourly}])
    rows = landed.hourly_from_payload(landed.hourly_payloads(spark, path)).orderBy("ts").collect()
    assert (rows[0].rh, rows[1].rh, rows[1].temp) == (95.0, None, 21.0)


def test_broken_payloads_go_to_the_side_table(spark, tmp_path):
    from cropspark.schemas import WEATHER_PAYLOAD
    from cropspark.streaming.runs import run_to_files

    good = '{"site_id": 1, "daily": {"time": ["2024-01-01"], "temperature_2m_max": [30.0]}}'
    lines = [good, good[:40], '{"site_id": "x", "daily": {"time": ["2024-01-01"]}}', '{"daily": {"time": ["2024-01-01"]}}', '{"site_id": 2, "daily": {"time": []}}', '{"site_id": 3}']
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.json").write_text("\n".join(lines))
    sift = lambda: spark.read.parquet(run_to_files(landed.sifted(spark, str(source), WEATHER_PAYLOAD, "daily"), "s", str(tmp_path / "out")))
    rows = sift()
    assert sorted((r.reason, r.file) for r in landed.refused(rows).collect()) == sorted((x, "a.json") for x in ("no json", "half parsed", "no site", "no series", "no series"))
    assert [r.site_id for r in landed.accepted(rows).collect()] == [1]
    assert [r.raw for r in landed.refused(rows).filter("reason = 'no json'").collect()] == [good[:40]]
    (source / "b.json").write_text(good)
    assert landed.accepted(sift()).count() == 2 and landed.refused(sift()).count() == 5  # a file is met once
