"""Readers of station, index and polygon files, and writers of results. All return long tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isohyet.functions.calendar import MONTHS
from isohyet.functions.text import fix_name
from isohyet.operators.clean import not_negative

STATION = "ID string, Lat double, Lon double, Year int, " + ", ".join(f"`{m}` double" for m in MONTHS)
#: Names that coordinates have in files, by ours.
COORDINATES = {"lon": ["lon", "longitude", "X", "Longitude", "Lon"], "lat": ["lat", "latitude", "Y", "Latitude", "Lat"], "time": ["time", "T"]}


class LayoutError(ValueError):
    """A file that does not have the layout it should have."""


def canonical_names(df: DataFrame) -> DataFrame:
    named = {other: own for own, others in COORDINATES.items() for other in others if other in df.columns and other != own}
    return df.withColumnsRenamed(named)


def header_of(spark: SparkSession, path: str) -> list[str]:
    first = spark.read.text(path).limit(1).first()
    return [c.strip() for c in first[0].split(",")] if first else []


def check_station_header(header: list[str]) -> None:
    if len(header) < 5:
        raise LayoutError("fewer than four commas in the header")
    if [h for h in header if h in ("Year", *MONTHS)] != ["Year", *MONTHS]:
        raise LayoutError("the header lacks Year, Jan, ..., Dec")
    if "ID" not in header:
        raise LayoutError("the header lacks ID")


def months_to_rows(wide: DataFrame, sentinel: float | None = None, mask_negative: bool = True) -> DataFrame:
    """(loc_id, lat, lon, time, value) of rows with one column a month."""
    long_ = wide.unpivot(["ID", "Lat", "Lon", "Year"], MONTHS, "mon", "value")
    value = F.col("value")
    if sentinel is not None:
        value = F.nullif(value, F.lit(float(sentinel)))
    value = not_negative(value) if mask_negative else value
    number = F.array_position(F.array(*map(F.lit, MONTHS)), F.col("mon")).cast("int")
    return long_.select(F.col("ID").cast("string").alias("loc_id"), F.col("Lat").alias("lat"), F.col("Lon").alias("lon"), F.make_date("Year", number, F.lit(1)).alias("time"), value.alias("value"))


def read_station_months(spark: SparkSession, path: str, sentinel: float | None = None, mask_negative: bool = True) -> DataFrame:
    """Stations with columns ID, Lat, Lon, Year, Jan to Dec; every station must cover whole years without a gap."""
    check_station_header(header_of(spark, path))
    wide = spark.read.csv(path, header=True, schema=STATION, enforceSchema=False)
    years = wide.groupBy("ID").agg((F.count(F.lit(1)) != F.max("Year") - F.min("Year") + 1).alias("gap"))
    if not years.filter("gap or ID is null").isEmpty():
        raise LayoutError("a station's years are not continuous, or an ID is missing")
    return months_to_rows(wide, sentinel, mask_negative)


def read_station_columns(spark: SparkSession, path: str, sentinel: float | None = None, mask_negative: bool = True) -> DataFrame:
    """Stations as columns below three header lines (name, latitude, longitude); the first column is the date."""
    lines = spark.read.text(path).withColumn("cells", F.split("value", ","))
    head = lines.limit(3).collect()
    if len(head) < 3 or not head[1]["cells"][0].strip().lower().startswith("lat") or not head[2]["cells"][0].strip().lower().startswith("lon"):
        raise LayoutError("no three header lines of name, latitude and longitude")
    dims = spark.createDataFrame([(i, n.strip(), float(a), float(o)) for i, (n, a, o) in enumerate(zip(*(h["cells"] for h in head), strict=True)) if i], "pos int, loc_id string, lat double, lon double")
    body = lines.select(F.get("cells", F.lit(0)).try_cast("date").alias("time"), F.posexplode("cells").alias("pos", "cell")).filter("time is not null and pos > 0")
    value = F.col("cell").try_cast("double")
    value = F.nullif(value, F.lit(float(sentinel))) if sentinel is not None else value
    value = not_negative(value) if mask_negative else value
    return body.join(F.broadcast(dims), "pos").select("loc_id", "lat", "lon", F.trunc("time", "MM").alias("time"), value.alias("value"))


def read_stations(spark: SparkSession, path: str, **options) -> DataFrame:
    """Either layout: 16 columns and repeated ids mean months as columns."""
    return (read_station_months if len(header_of(spark, path)) == 16 else read_station_columns)(spark, path, **options)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """(time, value) of a CSV with a date and one index."""
    return spark.read.csv(path, header=True, schema="date date, value double", enforceSchema=True).select(F.trunc("date", "MM").alias("time"), "value")


def parse_index_lines(lines: DataFrame, column: str = "value", missing: float = 99.9) -> DataFrame:
    """(time, value) of lines with a year and twelve monthly values, dated at month's end; missing values are left out."""
    cells = F.split(F.trim(column), r"\s+")
    rows = lines.select(F.get(cells, F.lit(0)).try_cast("int").alias("year"), F.posexplode(F.slice(cells, 2, 12)).alias("pos", "cell")).filter("year is not null")
    out = rows.select(F.last_day(F.make_date("year", F.col("pos") + 1, F.lit(1))).alias("time"), F.col("cell").try_cast("double").alias("value"))
    return out.filter(F.col("value") != missing)


def read_index_text(spark: SparkSession, path: str) -> DataFrame:
    return parse_index_lines(spark.read.text(path))


#: The letters of ISO-8859-9 that differ from ISO-8859-1, which Spark reads, and those of the latter.
LATIN_5, LATIN_1 = "ĞİŞğış", "ÐÝÞðýþ"


def merged_stations(raw: DataFrame, missing: float) -> DataFrame:
    """Station rows (ID, Lat, Lon, Year, Jan, ..., Dec) of many files, all cells as text, cleaned: a cell that is the
    sentinel as a number is null, however it is written; rows without any monthly value go; IDs become plain names."""
    cell = lambda c: F.when(F.coalesce(F.col(c).try_cast("double") == float(missing), F.lit(False)), None).otherwise(F.col(c))
    months = [c for c in raw.columns if c in MONTHS]
    cleaned = raw.select(*(cell(f"`{c}`").alias(c) if c in months else F.col(f"`{c}`") for c in raw.columns))
    return cleaned.filter(F.coalesce(*months).isNotNull()).withColumn("ID", fix_name(F.col("ID"))) if months else cleaned.withColumn("ID", fix_name(F.col("ID")))


def read_stations_union(spark: SparkSession, paths: list[str], missing: float) -> DataFrame:
    """Many station files in ISO-8859-9 with the same header as one table of text, see merged_stations."""
    raw = spark.read.csv(paths, header=True, encoding="ISO-8859-1")
    return merged_stations(raw.select(*(F.translate(F.col(f"`{c}`"), LATIN_1, LATIN_5).alias(c) for c in raw.columns)), missing)


def station_series(merged: DataFrame, mask_negative: bool = True) -> DataFrame:
    """(loc_id, lat, lon, time, value) of merged station rows: of several rows of a station and year the first in the
    order of their values counts; cells that aren't numbers are null."""
    numbers = merged.select("ID", *(F.col(c).cast("string").try_cast("double").alias(c) for c in ("Lat", "Lon")), F.col("Year").cast("string").try_cast("int").alias("Year"), *(F.col(c).cast("string").try_cast("double").alias(c) for c in MONTHS))
    one = numbers.groupBy("ID", "Year").agg(F.min(F.struct("Lat", "Lon", *MONTHS)).alias("_r")).select("ID", "Year", "_r.*")
    return months_to_rows(one, mask_negative=mask_negative)


def variables(spark: SparkSession, path: str) -> list[str]:
    """What a file offers as variables: the first word of a table's name, the attributes of a map, or the data variables of
    a NetCDF file."""
    stem = path.rstrip("/").rpartition("/")[2]
    kind = stem.rpartition(".")[2].lower()
    if kind in ("geojson", "json"):
        return attributes(read_geojson(spark, path))
    if kind == "nc":
        from isohyet.sources import netcdf

        return netcdf.variables(spark, path)
    if kind == "shp":
        from isohyet.sources import shapefile

        return shapefile.attributes(path)
    if kind == "csv":
        return [stem.rpartition(".")[0].split("_")[0]]
    raise LayoutError(f"{stem}: only csv, nc, shp, json and geojson files are known")


def explode_features(collection: DataFrame, column: str = "value") -> DataFrame:
    """(properties MAP, rings) of the features of GeoJSON texts; a multipolygon gives the rings of all of its parts."""
    point = "array<double>"
    schema = "features array<struct<properties: map<string,string>, geometry: struct<type: string, coordinates: string>>>"
    f = collection.select(F.explode(F.from_json(column, schema)["features"]).alias("f"))
    kind, raw = F.col("f.geometry.type"), F.col("f.geometry.coordinates")
    multi = F.flatten(F.from_json(raw, f"array<array<array<{point}>>>"))
    rings = F.when(kind == "MultiPolygon", multi).when(kind == "Polygon", F.from_json(raw, f"array<array<{point}>>"))
    as_points = F.transform(rings, lambda r: F.transform(r, lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y"))))
    return f.select(F.col("f.properties").alias("properties"), as_points.alias("rings"))


def read_geojson(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(properties, rings) of a GeoJSON document, or of a file with a feature a line."""
    if not lines:
        return explode_features(spark.read.text(path, wholetext=True))
    return explode_features(spark.read.text(path).select(F.format_string('{"features":[%s]}', "value").alias("value")))


def read_map(spark: SparkSession, path: str) -> DataFrame:
    """(properties, rings) of a vector map, by the ending of its name: a shapefile or a GeoJSON document."""
    if path.lower().endswith(".shp"):
        from isohyet.sources import shapefile

        return shapefile.read(spark, path).select("properties", "rings")
    return read_geojson(spark, path)


def feature_lines(features: DataFrame, properties: str = "properties", geometry: str = "geometry") -> DataFrame:
    """One GeoJSON feature a row, from properties MAP and geometry as GeoJSON text: newline-delimited GeoJSON, of any size."""
    return features.select(F.format_string('{"type":"Feature","properties":%s,"geometry":%s}', F.to_json(properties), F.col(geometry)).alias("value"))


def feature_collection(features: DataFrame, properties: str = "properties", geometry: str = "geometry", most: int = 100_000) -> DataFrame:
    """One GeoJSON text of up to `most` features - a single row, made in one task; of more, write feature_lines."""
    lines = feature_lines(features, properties, geometry)
    if lines.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} features in one document; write them as lines")
    return lines.agg(F.format_string('{"type":"FeatureCollection","features":[%s]}', F.array_join(F.array_sort(F.collect_list("value")), ",")).alias("value"))


def write_geojson(features: DataFrame, path: str, single: bool = False, overwrite: bool = True) -> None:
    """Features with properties MAP and geometry as GeoJSON text: a feature a line, or one document of few features."""
    texts = feature_collection(features) if single else feature_lines(features)
    texts.write.mode("overwrite" if overwrite else "ignore").text(path)


def attributes(df: DataFrame, column: str = "properties") -> list[str]:
    first = df.select(F.map_keys(column)).first()
    return list(first[0]) if first else []


KINDS = ("parquet", "csv", "netcdf")


def write_output(df: DataFrame, path: str, kind: str = "parquet", overwrite: bool = True) -> None:
    """A result in the form of its kind: parquet; CSV with a header, for stations and zones; or NetCDF, for grids with lat
    and lon, one file a time. Where overwrite is off, a result that is there stays."""
    mode = "overwrite" if overwrite else "ignore"
    if kind == "netcdf":
        from isohyet.sources import netcdf

        netcdf.write(df, path, overwrite=overwrite)
    elif kind == "csv":
        df.write.mode(mode).option("header", True).csv(path)
    elif kind == "parquet":
        df.write.mode(mode).parquet(path)
    else:
        raise ValueError(f"unknown kind {kind}; one of {', '.join(KINDS)}")


def write_forecast(outputs: dict[str, DataFrame], root: str, season: str, predictor: str, target: str, model: str, overwrite: bool = True, kind: str = "parquet", points: DataFrame | None = None) -> None:
    """The result tables of a forecast, rounded to two places (skill as it is), below one folder a model.

    As NetCDF, tables with a time need the points (loc_id, lat, lon) of the grid; others become CSV."""
    for name, df in outputs.items():
        rounded = df if name == "skill" else df.select(*(F.bround(c, 2).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))
        grid = kind == "netcdf" and points is not None and "time" in df.columns
        rounded = rounded.join(points, "loc_id").drop("loc_id") if grid else rounded
        write_output(rounded, f"{root}/{season}/{predictor}/{target}/{model}/output/{name}", kind if grid or kind != "netcdf" else "csv", overwrite)


def write_verification(layers: DataFrame, points: DataFrame, root: str, season: str, years: str, dataset: str, kind: str = "csv", overwrite: bool = True) -> str:
    """All layers of a verification by location: CSV with a column a layer, or NetCDF with a variable a layer."""
    path = f"{root}/maps_verification_{season}-{years}_{dataset}"
    placed = layers.join(points.select("loc_id", "lat", "lon"), "loc_id")
    write_output(placed.drop("loc_id", "zone_id") if kind == "netcdf" else placed.drop("time"), path, kind, overwrite)
    return path


def write_zoning(outputs: dict[str, DataFrame], points: DataFrame, root: str, rotation: str, overwrite: bool = True) -> None:
    """The tables of a zoning as CSV - seasons by station, components before and after rotation with their places - and
    the zones as a NetCDF raster of bytes."""
    write_output(outputs["data"], f"{root}/data", "csv", overwrite)
    for name, key in (("components", "components"), (f"components_{rotation}", "components_rotated")):
        write_output(outputs[key].withColumnRenamed("loc_id", "station").join(points.select(F.col("loc_id").alias("station"), F.col("lat").alias("Lat"), F.col("lon").alias("Lon")), "station"), f"{root}/{name}", "csv", overwrite)
    zones = outputs["zones"].select(F.current_date().alias("time"), "lat", "lon", F.col("zone").cast("byte").alias("Zones"))
    write_output(zones, f"{root}/izones", "netcdf", overwrite)


def load_config(path: str, defaults: dict) -> dict:
    """A JSON configuration over defaults; a file that cannot be read leaves the defaults."""
    try:
        with open(path, encoding="utf-8") as f:
            return defaults | json.load(f)
    except (OSError, ValueError):
        return dict(defaults)


def save_config(path: str, config: dict) -> None:
    with open(path, "w", encoding="utf-8") as f:
        json.dump(config, f, indent=4)
