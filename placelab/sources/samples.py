"""Small example inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placelab.functions.random import gaussian, uniform

# Sample keywords, and sample locations as (subdistrict, district).
KEYWORDS = ["warung kelontong", "toko kelontong", "minimarket", "cafe", "restoran", "apotek"]
LOCATIONS = [
    ("Gunung", "Kebayoran Baru"), ("Melawai", "Kebayoran Baru"), ("Kramat Pela", "Kebayoran Baru"),
    ("Cilandak Barat", "Cilandak"), ("Cipete Selatan", "Cilandak"),
]
SAMPLE_CITY = "Jakarta Selatan"

# Damaged coordinates, latitude and longitude per row.
DAMAGED = [
    ("-8.7096028-8.7096583-8.7114426", "115.1234567-115.1234890-115.1235123"),
    ("-8.7055983-8.7075263-8.7064947", "115.1240000-115.1241000-115.1242000"),
    ("-8.7108147-8.7116563-8.7076849", "115.1250000-115.1251000-115.1252000"),
    ("-8.7108262-8.7108914-8.7075621", "115.1260000-115.1261000-115.1262000"),
    ("-8.7107953-8.7076736-8.7081228", "115.1270000-115.1271000-115.1272000"),
    ("-8.7105679", "115.1280000"),
    ("-8.7106134", "115.1290000"),
    ("-8.7093778-8.7066775-8.7073352", "115.1300000-115.1301000-115.1302000"),
    ("-8.7080000", "115.1310000"),
    ("-8.7090000", "115.1320000"),
    ("-8.7096028-8.7096583-8.7114426-8.7114058", "115.1330000-115.1331000-115.1332000-115.1333000"),
    ("-8.7055983-8.7055983-8.7075263-8.7064947", "115.1340000-115.1341000-115.1342000-115.1343000"),
    ("-8.7108147-8.7116563-8.7116563-8.7076849", "115.1350000-115.1351000-115.1352000-115.1353000"),
    ("-8.7108262-8.7108914-8.7075621-8.7107953", "115.1360000-115.1361000-115.1362000-115.1363000"),
    ("-8.7076736-8.7081228-8.7105679-8.7106134", "115.1370000-115.1371000-115.1372000-115.1373000"),
    ("-8.7093778-8.7066775-8.7073352", "115.1380000-115.1381000-115.1382000"),
    ("-8.7100000", "115.1390000"),
    ("-8.7110000", "115.1400000"),
    ("-8.7120000", "115.1410000"),
    ("-8.7130000", "115.1420000"),
]

# Hot-spot centres (latitude, longitude) and spreads in degrees.
HOT_SPOTS = [(-6.2088, 106.8456), (-6.2100, 106.8500), (-6.2050, 106.8400)]
HOT_SPREAD, BACKGROUND_SPREAD = 0.005, 0.02


def sample_keywords(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(KEYWORDS)), "pos long, keyword string")


def sample_locations(spark: SparkSession) -> DataFrame:
    rows = [(i, d, s, SAMPLE_CITY) for i, (s, d) in enumerate(LOCATIONS)]
    return spark.createDataFrame(rows, "pos long, district string, subdistrict string, city string")


def damaged_merchants(spark: SparkSession) -> DataFrame:
    rows = [(f"M_{i:03d}", lat, lon, "Jakarta", f"District_{i % 3 + 1}") for i, (lat, lon) in enumerate(DAMAGED)]
    return spark.createDataFrame(
        rows, "merchant_id string, latitude string, longitude string, city string, district string"
    )


def synthetic_merchants(spark: SparkSession, n: int = 1000, per_spot: int = 115, seed: int = 42) -> DataFrame:
    """``n`` merchants around the hot-spots; see ``scattered``."""
    return scattered(spark.range(n).withColumnRenamed("id", "row_id"), per_spot, seed)


def scattered(rows: DataFrame, per_spot: int = 115, seed: int = 42) -> DataFrame:
    """A merchant per ``row_id``: Gaussian hot-spots of ``per_spot`` rows each, the rest spread wider.

    Everything about a merchant follows from its row_id and the seed, whatever the partitioning.
    """
    row, spot = F.col("row_id"), F.floor(F.col("row_id") / per_spot)
    hot = spot < len(HOT_SPOTS)
    at = F.least(spot, F.lit(len(HOT_SPOTS) - 1)).cast("int") + 1
    lat = F.element_at(F.array(*[F.lit(a) for a, _ in HOT_SPOTS]), at)
    lon = F.element_at(F.array(*[F.lit(o) for _, o in HOT_SPOTS]), at)
    spread = F.when(hot, HOT_SPREAD).otherwise(BACKGROUND_SPREAD)
    return rows.select(
        "row_id",
        (F.when(hot, lat).otherwise(HOT_SPOTS[0][0]) + gaussian(seed, row, "lat") * spread).alias("latitude"),
        (F.when(hot, lon).otherwise(HOT_SPOTS[0][1]) + gaussian(seed, row, "lon") * spread).alias("longitude"),
        F.format_string("M_%04d", "row_id").alias("merchant_id"),
        F.lit("Jakarta").alias("city"),
        F.format_string("District_%d", F.floor(uniform(seed, row, "district") * 3) + 1).alias("district"),
        F.format_string("Subdistrict_%d", F.floor(uniform(seed, row, "subdistrict") * 9) + 1).alias("subdistrict"),
    )
