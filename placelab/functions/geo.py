"""Great-circle arithmetic as column expressions (all of it stays in generated code)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Sphere radius and metres per degree of the planar approximation.
EARTH_RADIUS_M = 6371000.0
METRES_PER_DEGREE = 111320.0


def _sin2_half(angle_deg: Column) -> Column:
    s = F.sin(F.radians(angle_deg) / 2)
    return s * s


def half_chord_sq(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Squared half chord; grows with the distance, and needs no arc sine to compare."""
    return _sin2_half(lat2 - lat1) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * _sin2_half(lon2 - lon1)


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    return EARTH_RADIUS_M * 2 * F.asin(F.sqrt(half_chord_sq(lat1, lon1, lat2, lon2)))


def degree_tolerances(metres: Column | float, lat: Column) -> tuple[Column, Column]:
    """(latitude, longitude) degrees that span ``metres`` at ``lat`` in the planar approximation."""
    m = metres if isinstance(metres, Column) else F.lit(float(metres))
    return m / METRES_PER_DEGREE, m / (METRES_PER_DEGREE * F.cos(F.radians(lat)))


def planar_tolerance(metres: Column | float, lat: Column) -> Column:
    return F.greatest(*degree_tolerances(metres, lat))
