"""From raw merchants to POIs: diagnose, clean, sweep, detect with the best parameters."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placelab.operators import clean as cleaning
from placelab.operators import kmeans, poi
from placelab.operators.adaptive import detect_adaptive
from placelab.operators.poi import Detection, detect_dbscan
from placelab.operators.rows import with_row_id
from placelab.plans import sweep as sweeps
from placelab.session import materialize

# Relaxed parameters tried in order when the sweep finds nothing.
LADDER = [("DBSCAN", 600, 10), ("DBSCAN", 800, 8), ("Adaptive", 1000, 8), ("DBSCAN", 1000, 5)]


@dataclass(frozen=True)
class Solution:
    """``detection`` and the parameters are None when no parameter set gave a POI."""

    cleaned: DataFrame
    issues: DataFrame
    results: DataFrame | None = None
    detection: Detection | None = None
    method: str | None = None
    radius: float | None = None
    min_merchants: int | None = None


def detect(merchants: DataFrame, method: str, radius: float, min_merchants: int, lat: str = "latitude",
           lon: str = "longitude", row_id: str = "row_id", restarts: int = kmeans.RESTARTS) -> Detection:
    """Run one detector by its sweep name."""
    if method == "DBSCAN":
        return detect_dbscan(merchants, radius, min_merchants, lat, lon, row_id)
    if method == "Adaptive":
        return detect_adaptive(merchants, radius, min_merchants, lat, lon, row_id)
    if method == "KMeans":
        return kmeans.detect_kmeans(merchants, None, radius, min_merchants, lat, lon, row_id, restarts)
    raise ValueError(f"unknown method {method}")


def relaxed(merchants: DataFrame, lat: str = "latitude", lon: str = "longitude",
            row_id: str = "row_id") -> tuple[Detection, str, float, int] | None:
    """The first relaxed parameter set that gives a POI."""
    for method, radius, needed in LADDER:
        detection = detect(merchants, method, radius, needed, lat, lon, row_id)
        if not detection.pois.isEmpty():
            return detection, method, radius, needed
    return None


def solve(merchants: DataFrame, *order: str, lat: str = "latitude", lon: str = "longitude",
          restarts: int = kmeans.RESTARTS) -> Solution:
    """Whole way from raw merchants; ``order`` names a unique key that numbers the rows."""
    cleaned = cleaning.clean(merchants, lat, lon)
    rows = materialize(with_row_id(cleaned.rows, *order))
    if rows.isEmpty():
        return Solution(rows, cleaned.issues)
    results = materialize(sweeps.sweep(rows, lat, lon, restarts=restarts))
    chosen = sweeps.best(results).first()
    if chosen.pois_found > 0:
        found = detect(rows, chosen.method, chosen.radius, chosen.min_merchants, lat, lon, restarts=restarts)
        return Solution(rows, cleaned.issues, results, found, chosen.method, chosen.radius, chosen.min_merchants)
    fallback = relaxed(rows, lat, lon)
    return Solution(rows, cleaned.issues, results, *(fallback or ()))


def solution_summary(solution: Solution) -> DataFrame:
    """One row: method, parameters and the statistics of the chosen detection."""
    spark = solution.cleaned.sparkSession
    schema = "method string, radius double, min_merchants int"
    if solution.detection is None:
        return spark.createDataFrame([], schema)
    head = spark.createDataFrame([(solution.method, float(solution.radius), solution.min_merchants)], schema)
    return head.crossJoin(F.broadcast(poi.statistics(solution.detection)))  # one row each
