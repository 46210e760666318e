"""Event tables: readers, cleansing, offence categories, the synthetic source, writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellwise.functions.geo import utm_forward

SCHEMA = "event_id long, x double, y double, datetime timestamp_ntz, crime_type string, hotspot_id int"

# Offence names of the two public sources and the category of each: fixed values.
NYC_OFFENSES = {
    "FELONY ASSAULT": "assault",
    "ROBBERY": "robbery",
    "BURGLARY": "burglary",
    "PETIT LARCENY": "theft",
    "GRAND LARCENY": "theft",
    "THEFT OF SERVICES": "theft",
    "CRIMINAL MISCHIEF": "vandalism",
    "HARRASSMENT 2": "harassment",
}
CHICAGO_TYPES = {
    "THEFT": "theft",
    "BATTERY": "assault",
    "ASSAULT": "assault",
    "BURGLARY": "burglary",
    "ROBBERY": "robbery",
    "MOTOR VEHICLE THEFT": "theft",
    "CRIMINAL DAMAGE": "vandalism",
}


def categorised(column: Column, names: dict[str, str]) -> Column:
    """The category of an offence; other for an unknown or null one."""
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(table[column], F.lit("other"))


def cleansed(rows: DataFrame, lon: str = "longitude", lat: str = "latitude", zone: int = 16) -> DataFrame:
    """rows whose coordinates are numbers, with x and y in metres of the UTM zone; the others go."""
    kept = rows.withColumns({lon: F.col(lon).try_cast("double"), lat: F.col(lat).try_cast("double")}).dropna(subset=[lon, lat])
    kept = kept.where(~F.isnan(lon) & ~F.isnan(lat))
    x, y = utm_forward(F.col(lon), F.col(lat), zone)
    return kept.withColumns({"x": x, "y": y})


def in_period(rows: DataFrame, start: str | None = None, end: str | None = None, column: str = "datetime") -> DataFrame:
    """Rows with a time from start to end, both included where given."""
    kept = rows.where(F.col(column).isNotNull())
    kept = kept.where(F.col(column) >= F.lit(start).cast("timestamp_ntz")) if start else kept
    return kept.where(F.col(column) <= F.lit(end).cast("timestamp_ntz")) if end else kept


def of_types(rows: DataFrame, types: list[str]) -> DataFrame:
    return rows.where(F.col("crime_type").isin(types))


def _numbered(rows: DataFrame, same: list[str]) -> DataFrame:
    """rows with an event_id: reports that are equal in all of same are counted, so that each has an id of its own."""
    made = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*same).orderBy(same[0])))
    return made.withColumn("event_id", F.xxhash64(*same, "_n")).drop("_n")


def _loaded(raw: DataFrame, when: str, offense: str, names: dict[str, str], zone: int, limit: int | None, start: str | None, end: str | None) -> DataFrame:
    """Filter and, with a limit, keep the newest rows as the remote service would; then categories, projection and order by time."""
    rows = raw.withColumn("datetime", F.try_to_timestamp(F.col(when)).cast("timestamp_ntz"))
    found = in_period(rows.where(F.col("latitude").isNotNull() & F.col("longitude").isNotNull()), start, end)
    found = found if limit is None else found.orderBy(F.desc("datetime")).limit(limit)
    made = cleansed(found.withColumn("crime_type", categorised(F.col(offense), names)), zone=zone)
    made = _numbered(made, ["datetime", "x", "y", offense])
    return made.select("event_id", "x", "y", "datetime", "crime_type", F.lit(-1).alias("hotspot_id")).orderBy("datetime")


def nyc(raw: DataFrame, limit: int | None = None, start: str | None = None, end: str | None = None, types: list[str] | None = None) -> DataFrame:
    """Events from the New York table's columns (cmplnt_fr_dt, ofns_desc, latitude, longitude), UTM zone 18."""
    out = _loaded(raw, "cmplnt_fr_dt", "ofns_desc", NYC_OFFENSES, 18, limit, start, end)
    return of_types(out, types) if types else out


def chicago(raw: DataFrame, limit: int | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """Events from the Chicago table's columns (date, primary_type, latitude, longitude), UTM zone 16."""
    return _loaded(raw, "date", "primary_type", CHICAGO_TYPES, 16, limit, start, end)


def read_lonlat_csv(spark: SparkSession, path: str, datetime_col: str = "datetime", lat_col: str = "latitude", lon_col: str = "longitude", type_col: str = "crime_type", zone: int = 16) -> DataFrame:
    """Events from a CSV of degrees; a missing type column gives other, unreadable times and places drop the row."""
    raw = spark.read.csv(path, header=True)
    kind = F.col(type_col) if type_col in raw.columns else F.lit("other")
    spot = F.col("hotspot_id").try_cast("int") if "hotspot_id" in raw.columns else F.lit(-1)
    rows = raw.select(F.try_to_timestamp(F.col(datetime_col)).cast("timestamp_ntz").alias("datetime"), F.col(lat_col).alias("latitude"), F.col(lon_col).alias("longitude"), kind.alias("crime_type"), spot.alias("hotspot_id"))
    made = _numbered(cleansed(rows.where("datetime IS NOT NULL"), zone=zone), ["datetime", "longitude", "latitude", "crime_type"])
    return made.select("event_id", "x", "y", "datetime", "crime_type", "hotspot_id").orderBy("datetime")


def load_or_generate(spark: SparkSession, path: str, **options) -> DataFrame:
    """The event table at path (Parquet, or CSV by its name); where there is none, a synthetic one is written there first."""
    files = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not files.getFileSystem(spark._jsc.hadoopConfiguration()).exists(files):
        write_events(synthetic(spark, **options), path)
    if path.endswith(".csv"):
        return spark.read.schema(SCHEMA).csv(path, header=True)
    return spark.read.schema(SCHEMA).parquet(path)


def write_events(events: DataFrame, path: str) -> None:
    if path.endswith(".csv"):
        events.write.csv(path, header=True)
    else:
        events.write.parquet(path)


# The synthetic city: centre, spread, intensity, growth per month, first month. Fixed values.
HOTSPOTS = (
    (5000.0, 5000.0, 1500.0, 0.28, 0.000, 0),
    (15000.0, 15000.0, 1200.0, 0.24, -0.008, 0),
    (10000.0, 8000.0, 1000.0, 0.20, 0.018, 6),
    (4000.0, 16000.0, 800.0, 0.12, 0.000, 0),
    (17000.0, 5000.0, 1000.0, 0.10, -0.022, 0),
)
TYPES = (("theft", 0.40), ("assault", 0.25), ("burglary", 0.20), ("robbery", 0.15))
NOISE_SHARE = 0.30


def hour_weights() -> list[float]:
    """Shares of the hours of a day: late evening most, early morning least."""
    raw = [3.0 if h >= 20 else 2.5 if h <= 2 else 0.5 if 6 <= h <= 8 else 1.0 for h in range(24)]
    return [w / sum(raw) for w in raw]


def _drawn(u: Column, shares: list[tuple]) -> Column:
    """The value whose share u, from 0 to 1, falls in."""
    total, out = 0.0, None
    for value, share in shares:
        total += share
        out = F.when(u < total, F.lit(value)) if out is None else out.when(u < total, F.lit(value))
    return out.otherwise(F.lit(shares[-1][0]))


def seasonal_factor(month: Column) -> Column:
    """1 at the equinoxes, more in summer."""
    return 1 + 0.35 * F.sin(F.lit(3.141592653589793) * (month - 1) / 6 - F.lit(3.141592653589793) / 2)


def months(spark: SparkSession, start: str, end: str) -> DataFrame:
    """m and month_start of every month from start's to end's."""
    every = F.sequence(F.trunc(F.lit(start).cast("date"), "month"), F.lit(end).cast("date"), F.expr("INTERVAL 1 MONTH"))
    return spark.range(1).select(F.posexplode(every).alias("m", "month_start"))


def synthetic_counts(spark: SparkSession, n_events: int = 12_000, start: str = "2022-01-01", end: str = "2023-12-31", hotspots: tuple = HOTSPOTS) -> DataFrame:
    """m, month_start, hotspot (-1: noise) and n, how many events each draws."""
    calendar = months(spark, start, end)
    many = F.lit(n_events) / F.lit(calendar.count())
    total = calendar.withColumn("total", F.floor(many * seasonal_factor(F.month("month_start"))).cast("long"))
    spots = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("h", "cx", "cy", "sigma", "intensity", "trend", "first"), (k, *s), strict=True)]) for k, s in enumerate(hotspots)])
    each = total.withColumn("s", F.explode(spots))
    share = F.least(F.greatest(F.col("s.intensity") * (1 + F.col("s.trend") * (F.col("m") - F.col("s.first"))), F.lit(0.0)), F.lit(1.0))
    own = each.where(F.col("m") >= F.col("s.first")).select("m", "month_start", F.col("s.h").alias("hotspot"), "s.cx", "s.cy", "s.sigma", F.floor(F.col("total") * share).alias("n"))
    noise = total.select("m", "month_start", F.lit(-1).alias("hotspot"), *[F.lit(0.0).alias(c) for c in ("cx", "cy", "sigma")], F.floor(F.col("total") * NOISE_SHARE).alias("n"))
    return own.unionByName(noise)


def synthetic(spark: SparkSession, n_events: int = 12_000, start: str = "2022-01-01", end: str = "2023-12-31", bbox: tuple = (0.0, 0.0, 20000.0, 20000.0), seed: int = 42) -> DataFrame:
    """Events around hotspots and everywhere, with season, hours and types; the same for the same seed and partitions.

    As in the analysed generator, hotspot_id is the month's number for hotspot events, and a month's last day has none.
    """
    counts = synthetic_counts(spark, n_events, start, end).where("n > 0")
    rows = counts.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n"))))
    clip = lambda v, lo, hi: F.least(F.greatest(v, F.lit(lo)), F.lit(hi))
    noise = F.col("hotspot") == -1
    x = F.when(noise, bbox[0] + F.rand(seed) * (bbox[2] - bbox[0])).otherwise(clip(F.col("cx") + F.randn(seed + 1) * F.col("sigma"), bbox[0], bbox[2]))
    y = F.when(noise, bbox[1] + F.rand(seed + 2) * (bbox[3] - bbox[1])).otherwise(clip(F.col("cy") + F.randn(seed + 3) * F.col("sigma"), bbox[1], bbox[3]))
    span = F.datediff(F.last_day("month_start"), F.col("month_start"))
    day = F.floor(F.rand(seed + 4) * span).cast("int")
    hour = _drawn(F.rand(seed + 5), list(enumerate(hour_weights())))
    when = F.timestamp_add("HOUR", hour, F.timestamp_add("DAY", day, F.col("month_start").cast("timestamp_ntz")))
    made = rows.select(F.xxhash64("m", "hotspot", "k").alias("event_id"), x.alias("x"), y.alias("y"), when.alias("datetime"), _drawn(F.rand(seed + 6), list(TYPES)).alias("crime_type"), F.when(noise, -1).otherwise(F.col("m")).cast("int").alias("hotspot_id"))
    return made.orderBy("datetime", "event_id")
