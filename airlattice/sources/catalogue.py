"""Catalogue scans (S2): countries, cities and sensors from landed JSON documents.

Schemas are fixed (upstream spellings kept: ``longitute``, ``intialZoomLevel``);
coordinates arrive as text and are cast on use. A missing path yields an empty frame.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

POINT = T.StructType([T.StructField("latitude", T.StringType()), T.StructField("longitute", T.StringType())])

CITY = T.StructType([
    T.StructField("cityName", T.StringType()), T.StructField("siteName", T.StringType()),
    T.StructField("siteTitle", T.StringType()), T.StructField("siteUrl", T.StringType()),
    T.StructField("countryCode", T.StringType()), T.StructField("countryName", T.StringType()),
    T.StructField("cityLocation", POINT), T.StructField("cityBorderPoints", T.ArrayType(POINT)),
    T.StructField("intialZoomLevel", T.IntegerType()),
])

COUNTRY = T.StructType([
    T.StructField("countryCode", T.StringType()), T.StructField("countryName", T.StringType()),
    T.StructField("cities", T.ArrayType(CITY)),
])

SENSOR = T.StructType([
    T.StructField("sensorId", T.StringType()), T.StructField("position", T.StringType()),
    T.StructField("comments", T.StringType()), T.StructField("type", T.StringType()),
    T.StructField("description", T.StringType()), T.StructField("status", T.StringType()),
    T.StructField("cityName", T.StringType()), T.StructField("_id", T.StringType()),
])

SCHEMAS = {"countries": COUNTRY, "cities": CITY, "sensors": SENSOR}


def read_catalogue(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Read a catalogue document (a JSON array or one object per line)."""
    from airlattice.sources.store import path_exists

    schema = SCHEMAS[kind]
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("multiLine", "true").json(path)


def city_points(cities: DataFrame) -> DataFrame:
    """City location and border points as doubles (cast on read, P4 semantics)."""
    pt = lambda p: F.struct(p["latitude"].try_cast("double").alias("latitude"),
                            p["longitute"].try_cast("double").alias("longitude"))
    return cities.select("cityName", "countryCode",
                         pt(F.col("cityLocation")).alias("location"),
                         F.transform("cityBorderPoints", pt).alias("border"))


def sensors_with_city(sensors: DataFrame, city_name: str | None = None) -> DataFrame:
    """Tag sensors with their city (the city folder the document came from)."""
    return sensors.withColumn("cityName", F.coalesce(F.col("cityName"), F.lit(city_name)))
