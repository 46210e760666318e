import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from cellwise.functions import geo
from cellwise.functions.period import Periods
from cellwise.operators import cluster, cube, hotspot
from cellwise.plans import batch
from cellwise.sources import events, sinks, socrata
from cellwise.sources.adapter import BBOX, GRID, event_points
from cellwise.streaming.cube_stream import streaming_counts, write_counts
from cellwise.streaming.trend_stream import running_trends, trends_at, write_trends


def test_utm_known_point_and_round_trip(spark):
    # The CN Tower: zone 17, 630084 E 4833438 N (a published example).
    df = spark.createDataFrame([(-79.387139, 43.642567, 17), (-87.65, 41.85, 16), (-74.0, 40.7, 18)], "lon double, lat double, zone int")
    x, y = geo.utm_forward(F.col("lon"), F.col("lat"), 17)
    tower = df.where("zone = 17").select(x.alias("x"), y.alias("y")).first()
    assert abs(tower.x - 630084) < 1 and abs(tower.y - 4833438) < 1
    for zone in (16, 17, 18):
        x, y = geo.utm_forward(F.col("lon"), F.col("lat"), zone)
        lon, lat = geo.utm_inverse(F.col("x"), F.col("y"), zone)
        back = df.where(F.col("zone") == zone).select("lon", "lat", x.alias("x"), y.alias("y")).select("lon", "lat", lon.alias("lon2"), lat.alias("lat2")).first()
        assert abs(back.lon - back.lon2) < 1e-9 and abs(back.lat - back.lat2) < 1e-9


def test_loaders(spark, tmp_path):
    raw = spark.createDataFrame(
        [("2023-05-01T10:00:00", "ROBBERY", "40.7", "-74.0"), ("2023-05-02T10:00:00", "UNKNOWN", "bad", "-74.0"), ("2023-05-03T10:00:00", "PETIT LARCENY", "40.8", "-73.9"), (None, "ROBBERY", "40.7", "-74.0"), ("2023-05-04T00:00:00", None, "40.7", "-74.0")],
        "cmplnt_fr_dt string, ofns_desc string, latitude string, longitude string",
    )
    got = events.nyc(raw).collect()
    assert [r.crime_type for r in got] == ["robbery", "theft", "other"] and all(r.hotspot_id == -1 and 400_000 < r.x < 700_000 for r in got)
    assert [r.crime_type for r in events.nyc(raw, types=["theft"]).collect()] == ["theft"]
    assert events.nyc(raw, limit=1).first().crime_type == "other"
    assert events.nyc(raw, start="2023-05-03", end="2023-05-03 23:00:00").count() == 1
    chicago = raw.select(F.col("cmplnt_fr_dt").alias("date"), F.lit("BATTERY").alias("primary_type"), "latitude", "longitude")
    assert {r.crime_type for r in events.chicago(chicago).collect()} == {"assault"}
    path = tmp_path / "own.csv"
    path.write_text("when,lat,lon\n2024-01-02 03:00:00,41.8,-87.6\nnever,41.8,-87.6\n2024-01-01 03:00:00,x,-87.6\n")
    own = events.read_lonlat_csv(spark, str(path), "when", "lat", "lon").collect()
    assert len(own) == 1 and own[0].crime_type == "other" and own[0].datetime == dt.datetime(2024, 1, 2, 3)


def test_equal_csv_rows_are_events_of_their_own(spark, tmp_path):
    path = tmp_path / "equal.csv"
    path.write_text("datetime,latitude,longitude\n" + "2024-01-01 10:00:00,41.9,-87.6\n" * 12)
    own = events.read_lonlat_csv(spark, str(path))
    assert own.count() == own.select("event_id").distinct().count() == 12
    assert cluster.fit_transform(own.limit(3), min_samples=5).where("cluster = -1").count() == 3


@pytest.mark.parametrize("name", ["made.csv", "made"])
def test_load_or_generate(spark, tmp_path, name):
    path = f"{tmp_path}/{name}"
    first = events.load_or_generate(spark, path, n_events=500)
    again = events.load_or_generate(spark, path)
    assert first.count() == again.count() > 400 and dict(first.dtypes) == dict(again.dtypes)


def test_synthetic(spark):
    made = events.synthetic(spark)
    # The monthly numbers are the formula's; draws are not another library's.
    by_month = {(r.y, r.m): r.n for r in made.groupBy(F.year("datetime").alias("y"), F.month("datetime").alias("m")).agg(F.count("*").alias("n")).collect()}
    assert sum(by_month.values()) == 13_951 and by_month[2022, 1] == 337 and by_month[2023, 12] == 417
    assert events.synthetic(spark, 4000).count() == 4592
    facts = made.agg(F.min("x"), F.max("x"), F.max(F.dayofmonth("datetime")), F.countDistinct("crime_type")).first()
    assert facts[0] >= 0 and facts[1] <= 20_000 and facts[2] == 30 and facts[3] == 4
    assert abs(sum(events.hour_weights()) - 1) < 1e-12


def test_socrata_pages_and_url():
    reader = socrata.SocrataReader({"base": "http://h", "resource": "r", "select": "a,b", "limit": "11", "page": "5", "where": socrata.where("a", "2024-01-01", None), "order": "a DESC"})
    assert [(p.offset, p.rows) for p in reader.partitions()] == [(0, 5), (5, 5), (10, 1)]
    url = reader.url(reader.partitions()[2])
    assert url.startswith("http://h/resource/r.json?") and "%24offset=10" in url and "%24limit=1" in url and "latitude+IS+NOT+NULL" in url


def test_socrata_source_reads(spark, monkeypatch, tmp_path):
    class Server:
        pass

    import http.server
    import threading

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            body = json.dumps([{"date": "2024-01-01T00:00:00", "primary_type": "THEFT", "latitude": 41.8}]).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    rows = socrata.load(spark, (base, *socrata.CHICAGO[1:]), limit=1).collect()
    server.shutdown()
    assert [tuple(r) for r in rows] == [("2024-01-01T00:00:00", "THEFT", "41.8", None, None)]


def test_geojson(spark, tmp_path):
    features = sinks.geojson_features(GRID.cells(spark), GRID)
    whole = json.loads(sinks.feature_collection(features).first()[0])
    assert len(whole["features"]) == 100 and whole["features"][7]["id"] == "7" and whole["features"][7]["properties"] == {"flat_idx": 7}
    ring = whole["features"][11]["geometry"]["coordinates"][0]
    assert ring[0] == ring[-1] == [4000.0, 2000.0] and len(ring) == 5
    degrees = json.loads(sinks.geojson_features(GRID.cells(spark), GRID, lonlat=True).where("flat_idx = 0").first().feature)["geometry"]["coordinates"][0][3]
    assert -88 < degrees[0] < -87 and 41 < degrees[1] < 42
    sinks.write_csv(features, f"{tmp_path}/f")
    assert spark.read.csv(f"{tmp_path}/f", header=True).count() == 100


def test_batch(spark, tmp_path):
    made = events.synthetic(spark, 1500)
    config = batch.BatchConfig(cell_size=4000.0, cluster_sample=300, min_samples=4)
    result = batch.run(made, config, BBOX)
    assert result.cube.agg(F.sum("count")).first()[0] == made.count()
    assert {r.model for r in result.scores.collect()} == {"ARIMA", "OLS", "Spatial Lag", "Naive"}
    assert result.categories.count() == 25 and result.moran.count() == 1
    result.write(f"{tmp_path}/out")
    assert spark.read.csv(f"{tmp_path}/out/pai_curve", header=True).count() == 10
    result.close()


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    rows = event_points(spark, sf_dir)
    rows.repartitionByRange(6, "datetime").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    counts = streaming_counts(stream, GRID, "1 day", "40 days")
    late = spark.createDataFrame([(1, 0.0, 0.0, dt.datetime(2024, 6, 1), "x")], rows.schema)
    write_counts(counts, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination(120)
    late.write.mode("append").parquet(f"{tmp_path}/in")
    write_counts(counts, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination(120)
    got = {(r.period_start.date(), r.flat_idx): r.n for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    periods = Periods.fit(rows, "D")
    plain = cube.count_cube(rows, GRID, periods).where("count > 0").withColumn("d", F.to_date(periods.begins(F.col("t")))).collect()
    assert got == {(r.d, r.flat_idx): int(r["count"]) for r in plain}


def test_stream_of_trends_equals_batch_also_after_a_restart(spark, tmp_path):
    """Files by time, half of them before the restart; cells that start late, end early, have gaps, or no events at all."""
    day = dt.datetime(2024, 3, 1)
    rng = np.random.default_rng(3)
    rows = [(k, *map(float, rng.uniform(0, 6000, 2)), day + dt.timedelta(hours=int(h)), "x") for k, h in enumerate(np.sort(rng.integers(0, 20 * 24, 300)))]
    rows += [(1000 + k, 15000.0, 15000.0, day + dt.timedelta(days=int(d)), "x") for k, d in enumerate([7, 7, 9, 12])]
    rows += [(2000, 500.0, 500.0, day, "x"), (2001, 500.0, 500.0, day + dt.timedelta(days=19, hours=5), "x")]
    form = "event_id long, x double, y double, datetime timestamp_ntz, crime_type string"
    table = spark.createDataFrame(rows, form)
    closer = spark.createDataFrame([(3000, 0.0, 0.0, day + dt.timedelta(days=60), "x")], form)
    halves = [table.where(F.col("datetime") < day + dt.timedelta(days=11)), table.where(F.col("datetime") >= day + dt.timedelta(days=11)), closer]
    store = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    for part in halves:
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        trends = running_trends(streaming_counts(stream, GRID, "1 day", "12 days"))
        query = write_trends(trends, f"{tmp_path}/out", f"{tmp_path}/cp")
        query.awaitTermination()
        assert query.exception() is None
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == store
    periods = Periods.fit(table, "D")
    first = (day - dt.datetime(1970, 1, 1)).days
    got = trends_at(spark.read.parquet(f"{tmp_path}/out"), GRID, first, first + periods.n - 1)
    plain = hotspot.mann_kendall(cube.count_cube(table, GRID, periods))
    columns = ["row", "col", "n", "s", "z", "trend", "significant"]
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, plain.select(columns).collect()))


def test_entry_and_registration(spark, sf_dir):
    assert __spark_entry__.entry(spark).count() == 10
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_loaders_keep_every_row_by_default(spark):
    raw = spark.range(20_500).select(F.date_format(F.timestamp_seconds(F.col("id") * 60), "yyyy-MM-dd HH:mm:ss").alias("date"), F.lit("THEFT").alias("primary_type"), F.lit("41.8").alias("latitude"), F.lit("-87.6").alias("longitude"))
    assert events.chicago(raw).count() == 20_500 and events.chicago(raw, limit=20_000).count() == 20_000
    assert events.nyc(raw.select(F.col("date").alias("cmplnt_fr_dt"), F.lit("ROBBERY").alias("ofns_desc"), "latitude", "longitude")).count() == 20_500


def test_batch_clusters_all_events(spark, monkeypatch):
    """More than 5,000 events: all of them are clustered, not a sample."""
    made = events.synthetic(spark, 5000).persist()
    monkeypatch.setattr(cluster, "fit_transform", lambda rows, **_: rows.withColumn("cluster", F.lit(0)))
    result = batch.run(made, batch.BatchConfig(cell_size=4000.0), BBOX)
    assert result.clusters.first().n_events == made.count() > 5000
    result.close()
