"""Density clustering on great-circle distance, exact and without listing pairs.

Positions that repeat are one weighted point. The grid cells have a diagonal of
at most the radius, so a cell that holds enough merchants makes all its points
core points, and the core points of one cell belong together. Clusters are
therefore connected components of cells; only points of thin cells need their
neighbours counted, and a thin cell holds fewer than ``min_merchants`` points.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placelab.operators import grid, skew
from placelab.operators.components import connected_components
from placelab.operators.neighbors import Config, grid_points
from placelab.operators.rows import with_row_id
from placelab.session import materialize, spread

NOISE = -1
#: Cell numbers have 28 bits per axis.
LEAST_RADIUS = 0.25
_CELL = ["cfg", "cy", "cx"]


def weighted_spots(merchants: DataFrame, lat: str, lon: str, row_id: str) -> DataFrame:
    """Distinct positions with their number of merchants and smallest row number."""
    return merchants.groupBy(F.col(lat).cast("double").alias("lat"), F.col(lon).cast("double").alias("lon")).agg(
        F.min(row_id).alias("spot"), F.count("*").alias("weight")
    )


def _node(cy: str, cx: str) -> str:
    """A grid cell of one parameter set as a single number; cells are at least decimetres wide."""
    return f"shiftleft(CAST(cfg AS BIGINT), 56) + shiftleft({cy}, 28) + {cx}"


_SPOT = ("cfg", "lat", "lon", "weight", "poi_cluster")


def cluster(spots: DataFrame, configs: list[Config]) -> DataFrame:
    """``cluster_points`` of weighted positions for several parameter sets at once."""
    if any(c.radius < LEAST_RADIUS for c in configs):
        raise ValueError(f"a radius below {LEAST_RADIUS} m has more cells than a cell number holds")
    return cluster_points(grid_points(spots, configs, "lat", "lon", "spot", "weight"))


def cluster_points(points: DataFrame) -> DataFrame:
    """(cfg, lat, lon, weight, poi_cluster) for every position that belongs to a cluster.

    ``points`` come placed on the grid, with id, weight, radius and min_merchants, cheap to read twice.
    Clusters are numbered by their first core row; a border point goes to the
    cluster with the smallest number within the radius.
    """
    cells = materialize(
        points.groupBy(*_CELL).agg(
            F.expr("count(*)").alias("n"), F.expr("sum(weight) >= first(min_merchants)").alias("dense"),
            F.first("radius").alias("radius"), F.first("min_merchants").alias("min_merchants")
        )
    )
    points = materialize(skew.join_per_key(points, cells.drop("radius", "min_merchants"), _CELL, "n"))
    core = points.filter("dense").selectExpr("*", f"{_node('cy', 'cx')} AS node")
    thin = points.filter("NOT dense")
    if thin.isEmpty():
        return _labelled(core).select(*_SPOT)

    # sets of one radius have the same neighbours: they are counted once, for the set whose thin cells include those of the others
    sets = cells.select("cfg", "radius", "min_merchants").distinct().collect()  # one row per parameter set
    widest = {s.radius: s.cfg for s in sorted(sets, key=lambda s: (s.min_merchants, s.cfg))}
    counted = F.col("cfg").isin(list(widest.values()))
    near = grid.fold(thin.filter(counted), points.filter(counted), "weight", F.sum).select(
        F.col("cfg").alias("_widest"), "id", F.col("value").alias("near"))
    lead = F.create_map(*[F.lit(x) for s in sets for x in (s.cfg, widest[s.radius])])
    thin = materialize(
        thin.withColumn("_widest", lead[F.col("cfg")]).join(near, ["_widest", "id"])
        .withColumn("core", F.col("near") >= F.col("min_merchants")).drop("near", "_widest")
    )
    more = thin.filter("core").drop("core").selectExpr("*", f"{_node('cy', 'cx')} AS node")
    labelled = materialize(_labelled(materialize(core.unionByName(more))))
    border = thin.filter("NOT core")
    adopted = grid.fold(border, labelled, "poi_cluster", F.min).withColumnRenamed("value", "poi_cluster")
    return labelled.select(*_SPOT).unionByName(border.join(adopted, ["cfg", "id"]).select(*_SPOT))


def _labelled(core: DataFrame) -> DataFrame:
    return skew.join_per_key(core, materialize(_numbered_cells(core)), ["cfg", "node"], "n")


def _cell_edges(core: DataFrame) -> DataFrame:
    """Pairs of neighbouring cells that hold core points within the radius of each other.

    Blocks are cut until few pairs are left to compare: one block pair inside the radius settles a pair of cells.
    """
    earlier = "struct(ay, ax) < struct(by, bx)"
    edges = None
    for level in grid.relate(core, core, pair_limit=grid.PAIR_LIMIT // grid.FEW_PAIRS, cells=earlier, until_one=True):
        origin = ["cfg", "cell_ay", "cell_ax", "cell_by", "cell_bx"]
        found = level.inside.select(*origin).unionByName(grid.compared(level).select(*origin))
        edges = found if edges is None else edges.unionByName(found)
    return edges.selectExpr(f"{_node('cell_ay', 'cell_ax')} AS u", f"{_node('cell_by', 'cell_bx')} AS v")


def _numbered_cells(core: DataFrame) -> DataFrame:
    """(cfg, node, n, poi_cluster): the cluster number of every cell that holds core points."""
    linked = connected_components(_cell_edges(core))
    cells = core.groupBy("cfg", "node").agg(F.min("id").alias("first_row"), F.count("*").alias("n"))
    cells = materialize(
        cells.join(linked, "node", "left").withColumn("component", F.coalesce("component", "node"))
    )
    clusters = cells.groupBy("cfg", "component").agg(F.min("first_row").alias("first_row"), F.count("*").alias("m"))
    ordered = with_row_id(clusters, "cfg", "first_row", name="_order")
    start = ordered.groupBy("cfg").agg(F.min("_order").alias("_start"))  # one row per parameter set
    numbers = ordered.join(F.broadcast(start), "cfg").select(
        "cfg", "component", "m", (F.col("_order") - F.col("_start")).cast("int").alias("poi_cluster")
    )
    return skew.join_per_key(cells, numbers, ["cfg", "component"], "m").select("cfg", "node", "n", "poi_cluster")


def dbscan(merchants: DataFrame, configs: list[Config], lat: str = "latitude", lon: str = "longitude",
           row_id: str = "row_id") -> DataFrame:
    """Clustered positions for all parameter sets in one run; see ``cluster``."""
    return cluster(materialize(spread(weighted_spots(merchants, lat, lon, row_id))), configs)
