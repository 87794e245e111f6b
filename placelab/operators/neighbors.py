"""Merchants within a radius of each other."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placelab.operators import grid, skew
from placelab.session import materialize, spread


@dataclass(frozen=True)
class Config:
    """One parameter set; ``cfg`` numbers the sets that run together."""

    cfg: int
    radius: float
    min_merchants: int = 1


def config_table(spark: SparkSession, configs: list[Config]) -> DataFrame:
    """The parameter sets as a table; it has one row per set the caller wrote down."""
    rows = [(c.cfg, float(c.radius), c.min_merchants) for c in configs]
    return spark.createDataFrame(rows, "cfg int, radius double, min_merchants int")


def grid_points(rows: DataFrame, configs: list[Config], lat: str, lon: str, row_id: str, *values: str) -> DataFrame:
    """Points once per parameter set, placed on the grid of their radius."""
    points = rows.select(
        F.col(row_id).alias("id"), F.col(lat).cast("double").alias("lat"), F.col(lon).cast("double").alias("lon"),
        *values,
    ).crossJoin(F.broadcast(config_table(rows.sparkSession, configs)))
    return grid.with_cells(points)


def neighbor_counts(merchants: DataFrame, radius: float, lat: str = "latitude", lon: str = "longitude",
                    row_id: str = "row_id") -> DataFrame:
    """(row_id, neighbors): merchants within ``radius`` metres, itself included.

    Merchants at the same position are counted as one weighted point, and whole
    blocks inside the radius add their size without looking at their points.
    """
    spots = merchants.groupBy(F.col(lat).alias("_lat"), F.col(lon).alias("_lon")).agg(
        F.min(row_id).alias("_spot"), F.count("*").alias("weight")
    )
    spots = materialize(spread(spots))
    points = materialize(grid_points(spots, [Config(0, radius)], "_lat", "_lon", "_spot", "weight"))
    counts = grid.fold(points, points, "weight", F.sum).selectExpr("id AS _spot", "value AS neighbors")
    per_spot = materialize(spots.join(counts, "_spot"))
    return skew_back(merchants, per_spot, lat, lon).select(row_id, "neighbors")


def skew_back(merchants: DataFrame, per_spot: DataFrame, lat: str, lon: str) -> DataFrame:
    """Carry columns of distinct positions back to all merchants; a position may hold very many."""
    keyed = merchants.withColumns({"_lat": F.col(lat).cast("double"), "_lon": F.col(lon).cast("double")})
    return skew.join_per_key(keyed, per_spot, ["_lat", "_lon"], "weight").drop("_lat", "_lon", "_spot")


def neighbor_pairs(merchants: DataFrame, radius: float, lat: str = "latitude", lon: str = "longitude",
                   row_id: str = "row_id", mode: str = grid.SPHERE) -> DataFrame:
    """(a_id, b_id, hav_m) for all ordered pairs within ``radius``, each merchant with itself included.

    The pairs are the result here, so there are as many rows as neighbours. Their
    making is spread evenly: no block pair compares more than a fixed number of points.
    Mode ``both`` also asks for the planar distance in degrees to be within the
    planar tolerance at the first merchant.
    """
    points = materialize(grid_points(spread(merchants), [Config(0, radius)], lat, lon, row_id))
    return _listed(points, points, mode)


def _listed(centres: DataFrame, points: DataFrame, mode: str) -> DataFrame:
    pairs = None
    for level in grid.relate(centres, points, mode):
        part = grid.compared(level.listed(), mode).selectExpr("a_id", "b_id", f"{grid.distance()} AS hav_m")
        pairs = part if pairs is None else pairs.unionByName(part)
    return pairs


def in_company(centres: DataFrame, spots: DataFrame) -> DataFrame:
    """(cfg, id) of ``centres`` (cfg, id, lat, lon, radius) with another merchant in their planar ball.

    ``spots`` (id, lat, lon, weight) hold the centres themselves too. Each centre
    is looked at on a grid of the size of its planar radius, of which there are at
    most forty, and only merchants in cells around centres take part.
    """
    left = materialize(grid.with_planar_cells(
        centres.selectExpr("cfg AS _cfg", "id", "lat", "lon", "radius", f"{grid.PLANAR_SPAN} AS span")
        .withColumn("cfg", F.col("_cfg") * 64 + F.col("span") + 32)))
    spans = left.select("cfg", "span").distinct()
    right = grid.with_planar_cells(spots.select("id", "lat", "lon", "weight", F.lit(0.0).alias("radius")).crossJoin(F.broadcast(spans)))
    around = grid.cover(grid.blocks(left, 0, "a"), grid.PLANAR).selectExpr("cfg", "by AS cy", "bx AS cx").distinct()
    near = materialize(right.join(around, ["cfg", "cy", "cx"], "left_semi"))
    found = grid.fold(left, near, "weight", F.sum, grid.PLANAR).filter("value > 1")
    return found.selectExpr("CAST(cfg div 64 AS INT) AS cfg", "id")


def neighbors_of(centres: DataFrame, merchants: DataFrame, radius: float, lat: str = "latitude", lon: str = "longitude",
                 row_id: str = "row_id") -> DataFrame:
    """(a_id, b_id, hav_m): merchants near each of the given centres, which are merchants themselves.

    A neighbour is within the radius, and within the planar tolerance in degrees
    at the centre's latitude. A centre alone in its planar ball has no list, not even itself.
    Only cells around centres are joined, so few centres cost little. Centres alone are
    left out beforehand, so the pairs are made once and not written out.
    """
    config = [Config(0, radius)]
    left = materialize(grid_points(centres, config, lat, lon, row_id))
    points = materialize(grid_points(merchants, config, lat, lon, row_id))
    single = materialize(left.join(_accompanied(left, points), "id", "left_anti"))
    if single.isEmpty():
        return _listed(left, points, grid.BOTH)
    spots = points.select("id", "lat", "lon", F.lit(1).cast("long").alias("weight"))
    alone = single.join(in_company(single, spots), "id", "left_anti").select("id")
    return _listed(materialize(left.join(alone, "id", "left_anti")), points, grid.BOTH)


def _accompanied(centres: DataFrame, points: DataFrame) -> DataFrame:
    """(id) of centres with a neighbour of another id, found by the least and the largest id around, without pairs."""
    named = points.filter("id IS NOT NULL").withColumn("other", F.col("id"))
    known = centres.filter("id IS NOT NULL")
    least = materialize(grid.fold(known, named, "other", F.min, grid.BOTH))
    found = least.filter("value != id").select("id")
    first = materialize(known.join(found, "id", "left_anti"))
    most = materialize(grid.fold(first, named, "other", F.max, grid.BOTH))
    return found.unionByName(most.filter("value != id").select("id"))
