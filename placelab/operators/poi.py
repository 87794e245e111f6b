"""POI tables, membership, statistics and map layers from cluster assignments."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placelab.functions.geo import haversine_m
from placelab.operators import skew
from placelab.operators.dbscan import NOISE, dbscan
from placelab.operators.neighbors import Config
from placelab.session import materialize

PLACE_NAMES = ("subdistrict", "district", "city")


@dataclass(frozen=True)
class Detection:
    """Result of one detector: the POI table and all merchants with their cluster."""

    pois: DataFrame
    membership: DataFrame


def poi_name(cluster: Column) -> Column:
    return F.format_string("POI_%03d", cluster)


def describe(assigned: DataFrame, radius: Column, min_merchants: int, lat: str, lon: str, *more: Column) -> Detection:
    """POI table and membership of merchants that carry ``poi_cluster`` (-1 outside any POI).

    ``assigned`` has to be written out already, since it is read several times.
    Centres are plain means; the distances need a second look at the members,
    joined so that one large cluster does not land on one task. ``radius`` may
    use columns of the POI measures; ``more`` are further POI columns.
    """
    c = F.col
    names = [n for n in PLACE_NAMES if n in assigned.columns]
    extra = [n for n in ("poi_radius",) if n in assigned.columns]
    inside, outside = assigned.filter(c("poi_cluster") >= 0), assigned.filter(c("poi_cluster") < 0)
    centres = materialize(inside.groupBy("poi_cluster").agg(
        F.avg(lat).alias("center_lat"), F.avg(lon).alias("center_lon"), F.count("*").alias("merchant_count"),
        *[F.first(n).alias(n) for n in extra],
    ))
    if names:
        centres = materialize(centres.join(_commonest(inside, names), "poi_cluster", "left").fillna("", names))
    sized = centres.select("poi_cluster", "center_lat", "center_lon", c("merchant_count").alias("_n"))
    measured = skew.join_per_key(inside, sized, ["poi_cluster"], "_n").withColumn(
        "distance_to_center", haversine_m(c("center_lat"), c("center_lon"), c(lat), c(lon))
    )
    spread = measured.groupBy("poi_cluster").agg(
        F.max("distance_to_center").alias("max_distance"), F.avg("distance_to_center").alias("avg_distance"),
        F.min("distance_to_center").alias("min_distance"),
    )
    pois = centres.join(spread, "poi_cluster").select(
        poi_name(c("poi_cluster")).alias("poi_id"), c("poi_cluster").alias("cluster_id"),
        "center_lat", "center_lon", "merchant_count", "max_distance", "avg_distance", "min_distance",
        radius.cast("double").alias("radius_meters"), F.lit(min_merchants).cast("int").alias("min_merchants"),
        *names, *more,
    )
    columns = [n for n in assigned.columns if n not in extra]
    membership = measured.select(*columns, "distance_to_center").unionByName(
        outside.select(*columns, F.lit(None).cast("double").alias("distance_to_center"))
    )
    return Detection(pois, membership)


def _commonest(inside: DataFrame, names: list[str]) -> DataFrame:
    """(poi_cluster, *names): the most frequent value of each column per cluster, the first in order on ties.

    Values are counted first, which combines before the shuffle; a cluster then has one row per value.
    """
    pairs = inside.select("poi_cluster", F.inline(F.array(*[
        F.struct(F.lit(n).alias("_name"), F.col(n).alias("_value")) for n in names]))).filter("_value IS NOT NULL")
    counts = pairs.groupBy("poi_cluster", "_name", "_value").agg((-F.count("*")).alias("_n"))
    first = counts.groupBy("poi_cluster", "_name").agg(F.min(F.struct("_n", "_value")).alias("_best"))
    return first.groupBy("poi_cluster").agg(*[F.max(F.when(F.col("_name") == n, F.col("_best._value"))).alias(n) for n in names])


def detect_dbscan(merchants: DataFrame, radius: float = 250, min_merchants: int = 30, lat: str = "latitude",
                  lon: str = "longitude", row_id: str = "row_id") -> Detection:
    """POIs by density clustering."""
    found = dbscan(merchants, [Config(0, radius, min_merchants)], lat, lon, row_id)
    labels = found.select(F.col("lat").alias("_lat"), F.col("lon").alias("_lon"), "weight", "poi_cluster")
    keyed = merchants.withColumns({"_lat": F.col(lat).cast("double"), "_lon": F.col(lon).cast("double")})
    assigned = skew.join_per_key(keyed, materialize(labels), ["_lat", "_lon"], "weight", "left").drop("_lat", "_lon")
    assigned = materialize(assigned.withColumn("poi_cluster", F.coalesce("poi_cluster", F.lit(NOISE))))
    return describe(assigned, F.lit(radius), min_merchants, lat, lon)


def coverage(membership: DataFrame) -> DataFrame:
    """One row: merchants, merchants in POIs, and their share in percent."""
    total, inside = F.count("*"), F.count_if(F.col("poi_cluster") >= 0)
    return membership.agg(
        total.alias("total_merchants"), inside.alias("merchants_in_pois"),
        F.coalesce(F.when(total > 0, inside * 100.0 / total), F.lit(0.0)).alias("coverage_percentage"),
    )


def statistics(detection: Detection) -> DataFrame:
    """One row with the ten POI statistics; zeros and nulls when there is no POI."""
    pois = detection.pois.agg(
        F.count("*").alias("total_pois"),
        F.avg("merchant_count").alias("avg_merchants_per_poi"),
        F.stddev_samp("merchant_count").alias("std_merchants_per_poi"),
        F.min("merchant_count").alias("min_merchants_in_poi"),
        F.max("merchant_count").alias("max_merchants_in_poi"),
        F.avg("max_distance").alias("avg_max_distance"),
        F.avg("avg_distance").alias("avg_avg_distance"),
    )
    share = coverage(detection.membership).select(
        F.col("merchants_in_pois").alias("total_merchants_in_pois"),
        (F.col("total_merchants") - F.col("merchants_in_pois")).alias("total_merchants_outside_pois"),
        "coverage_percentage",
    )
    return pois.crossJoin(F.broadcast(share)).select(  # one row each
        "total_pois", "total_merchants_in_pois", "total_merchants_outside_pois", "coverage_percentage",
        "avg_merchants_per_poi", "std_merchants_per_poi", "min_merchants_in_poi", "max_merchants_in_poi",
        "avg_max_distance", "avg_avg_distance",
    )


def _whole(x: Column) -> Column:
    """Rounded half to even, as text without decimals."""
    return F.bround(x, 0).cast("decimal(38,0)").cast("string")


def map_layers(detection: Detection, lat: str = "latitude", lon: str = "longitude", row_id: str = "row_id",
               show_radius: bool = True) -> DataFrame:
    """Map features: POI markers, POI circles and merchant dots with colours and labels."""
    c = F.col
    pois, members = detection.pois, detection.membership
    radius = F.when(c("radius_meters") == F.floor("radius_meters"), c("radius_meters").cast("long").cast("string")).otherwise(
        c("radius_meters").cast("string"))
    none = F.lit(None).cast("double")
    marker = pois.select(
        F.lit("poi").alias("layer"), c("poi_id").alias("id"), c("center_lat").alias("lat"), c("center_lon").alias("lon"),
        none.alias("radius_m"), F.lit("red").alias("color"),
        F.concat(c("poi_id"), F.lit(": "), c("merchant_count").cast("string"), F.lit(" merchants")).alias("label"),
        F.concat(
            c("poi_id"), F.lit("; Merchants: "), c("merchant_count").cast("string"),
            F.lit("; Max distance: "), _whole(c("max_distance")), F.lit("m; Avg distance: "), _whole(c("avg_distance")),
            F.lit("m; Radius: "), radius, F.lit("m"),
        ).alias("popup"),
    )
    circle = pois.select(
        F.lit("circle").alias("layer"), c("poi_id").alias("id"), c("center_lat").alias("lat"), c("center_lon").alias("lon"),
        c("radius_meters").alias("radius_m"), F.lit("red").alias("color"), F.lit("").alias("label"),
        F.concat(c("poi_id"), F.lit(" boundary ("), radius, F.lit("m radius)")).alias("popup"),
    )
    inside = c("poi_cluster") >= 0
    distance = F.when(inside, F.coalesce(
        F.concat(F.lit("Distance: "), _whole(c("distance_to_center")), F.lit("m")), F.lit("Distance: N/A")
    )).otherwise("")
    label = F.when(inside, poi_name(c("poi_cluster"))).otherwise("No POI")
    dot = members.select(
        F.lit("merchant").alias("layer"), c(row_id).cast("string").alias("id"), c(lat).alias("lat"), c(lon).alias("lon"),
        F.lit(3.0).alias("radius_m"), F.when(inside, "blue").otherwise("gray").alias("color"), label.alias("label"),
        F.concat_ws("; ", F.lit("Merchant"), label, distance).alias("popup"),
    )
    layers = marker.unionByName(circle) if show_radius else marker
    return layers.unionByName(dot)
