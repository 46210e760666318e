"""Writers of results, and grids as GeoJSON features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellwise.functions.geo import local_to_lonlat
from cellwise.functions.grid import GridSpec

# Categories of cells and their colours: fixed values.
CATEGORY_COLORS = {
    "NEW_HOTSPOT": "#FF0000",
    "CONSECUTIVE_HOTSPOT": "#FF6600",
    "INTENSIFYING_HOTSPOT": "#FFAA00",
    "PERSISTENT_HOTSPOT": "#FFD700",
    "DIMINISHING_HOTSPOT": "#AAAAFF",
    "SPORADIC_HOTSPOT": "#FFCCCC",
    "OSCILLATING_HOTSPOT": "#FF00FF",
    "HISTORICAL_HOTSPOT": "#BBBBBB",
    "NEW_COLDSPOT": "#0000FF",
    "CONSECUTIVE_COLDSPOT": "#0066FF",
    "INTENSIFYING_COLDSPOT": "#00AAFF",
    "PERSISTENT_COLDSPOT": "#00CCFF",
    "DIMINISHING_COLDSPOT": "#CCCCFF",
    "SPORADIC_COLDSPOT": "#CCDDFF",
    "OSCILLATING_COLDSPOT": "#AA00FF",
    "HISTORICAL_COLDSPOT": "#DDDDFF",
    "NO_PATTERN": "#F5F5F5",
}


def category_legend(categories: DataFrame) -> DataFrame:
    """category, title, color of every category, and how many cells have it."""
    names = categories.sparkSession.createDataFrame(list(CATEGORY_COLORS.items()), "category string, color string")
    counts = categories.groupBy("category").agg(F.count("*").alias("n"))
    title = F.initcap(F.replace(F.col("category"), F.lit("_"), F.lit(" ")))
    return names.join(counts, "category", "left").select("category", title.alias("title"), "color", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def geojson_features(cells: DataFrame, spec: GridSpec, lonlat: bool = False) -> DataFrame:
    """flat_idx and feature, a GeoJSON polygon of the cell as text (local metres, or degrees of UTM zone 16)."""
    size = spec.cell_size
    corners = []
    for dx, dy in ((1, 0), (1, 1), (0, 1), (0, 0), (1, 0)):
        x, y = F.lit(spec.minx) + (F.col("col") + dx) * size, F.lit(spec.miny) + (F.col("row") + dy) * size
        corners.append(F.array(*(local_to_lonlat(x, y) if lonlat else (x.cast("double"), y.cast("double")))))
    geometry = F.struct(F.lit("Polygon").alias("type"), F.array(F.array(*corners)).alias("coordinates"))
    feature = F.struct(F.lit("Feature").alias("type"), F.col("flat_idx").cast("string").alias("id"), F.struct(F.col("flat_idx")).alias("properties"), geometry.alias("geometry"))
    return cells.select("flat_idx", F.to_json(feature).alias("feature"))


def feature_collection(features: DataFrame) -> DataFrame:
    """One text of all features, by cell: for grids, whose size the caller chose."""
    held = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("flat_idx", "feature"))), lambda x: x["feature"]), ",")
    return features.agg(F.concat(F.lit('{"type":"FeatureCollection","features":['), held, F.lit("]}")).alias("geojson"))


def map_values(grid: DataFrame, value: str) -> DataFrame:
    """id (text) and value of each cell, row by row."""
    return grid.orderBy("flat_idx").select(F.col("flat_idx").cast("string").alias("id"), F.col(value).alias("value"))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)
