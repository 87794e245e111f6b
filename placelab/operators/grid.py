"""Distance joins on a sphere through a hierarchy of grid blocks.

Points fall into cells of a grid whose column width follows the latitude of the
row. Occupied cells that may hold points within the radius are paired by an
equi-join of cell tables. A pair of blocks is then settled by the bounding boxes
of its points where possible (all pairs of points inside the radius, or none).
What stays open is compared point by point only when the product of the two
block sizes is small (for ``fold``: when both blocks are small); otherwise both
blocks are cut in four and looked at again.
So the number of points in a cell never bounds the work of one task, and the
result is exact.

Every table carries ``cfg``: several radii run through the same jobs.

Point tables have the columns cfg, id, lat, lon, radius, fy, fx (fine grid
position) and whatever values the caller needs.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import partial
from math import isqrt
from typing import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from placelab.functions.geo import EARTH_RADIUS_M, METRES_PER_DEGREE
from placelab.operators import grid_arrays, skew
from placelab.session import materialize, ship_package, spread

LEVELS = 20
PAIR_LIMIT = 250_000
# Of the pair limit: what ``fold`` compares row by row, above it as arrays.
FEW_PAIRS = 100

SPHERE, PLANAR, BOTH = "sphere", "planar", "both"

_DIAMETER = f"{2 * EARTH_RADIUS_M}D"
# bounds leave a margin, so that rounding can only keep a pair open, never settle it wrongly
_LESS, _MORE = "(1 - 1e-9D)", "(1 + 1e-9D)"

def _half_angle(metres: str) -> str:
    """Half the angle that spans ``metres``; nothing is farther than half the globe."""
    return f"least({metres} / {_DIAMETER}, pi() / 2)"


CELL_HEIGHT = f"degrees(2 * asin(sin({_half_angle('radius')}) / sqrt(2D))) * {_LESS}"
"""Height in degrees of a cell whose diagonal does not exceed the column ``radius``."""


def _cos(lat: str) -> str:
    return f"cos(radians({lat}))"


def _sin2_half(deg: str) -> str:
    return f"pow(sin(radians({deg}) / 2), 2)"


def _nearest_to_equator(low: str, high: str) -> str:
    return f"CASE WHEN {low} < 0 AND {high} > 0 THEN 0D ELSE least(abs({low}), abs({high})) END"


def _row_range(row: str, height: str) -> tuple[str, str]:
    return f"({row} * {height} - 90)", f"({row} * {height} - 90 + {height})"


def _columns_in_row(row: str, height: str) -> str:
    """Columns of a grid row: as wide as a cell is high, where the row is nearest to the equator."""
    nearest = f"least(90D, {_nearest_to_equator(*_row_range(row, height))})"
    return f"CAST(ceil(360D / degrees(2 * asin(least(1D, sin(radians({height}) / 2) / {_cos(nearest)})))) AS BIGINT)"


def with_cells(points: DataFrame) -> DataFrame:
    """Add ``height``, ``fy``/``fx`` (position at the finest level) and ``cy``/``cx`` (cell)."""
    scale = 1 << LEVELS
    return (
        points.selectExpr("*", f"{CELL_HEIGHT} AS height")
        .selectExpr("*", f"CAST(floor((lat + 90) / height * {scale}) AS BIGINT) AS fy")
        .selectExpr("*", f"shiftright(fy, {LEVELS}) AS cy")
        .selectExpr("*", f"{_columns_in_row('cy', 'height')} AS _cols")
        .selectExpr("*", f"pmod(CAST(floor((lon + 180) / 360 * _cols * {scale}) AS BIGINT), _cols * {scale}) AS fx")
        .selectExpr("*", f"shiftright(fx, {LEVELS}) AS cx")
        .drop("_cols")
    )


def _block(level: int, prefix: str) -> list[str]:
    shift = LEVELS - level
    return [f"shiftright(fy, {shift}) AS {prefix}y", f"shiftright(fx, {shift}) AS {prefix}x"]


def blocks(points: DataFrame, level: int, prefix: str, value: Column | None = None) -> DataFrame:
    """Occupied blocks with row count, bounding box and an aggregated value. Combines map-side."""
    p = prefix
    wanted = ["first(radius) radius", "first(height) height", "count(*) n", "min(lat) lat0", "max(lat) lat1",
              "min(lon) lon0", "max(lon) lon1"]
    measures = [F.expr(w.split()[0]).alias(f"{p}_{w.split()[1]}") for w in wanted]
    extra = [value.alias(f"{p}_value")] if value is not None else []
    return points.selectExpr("*", *_block(level, p)).groupBy("cfg", f"{p}y", f"{p}x").agg(*measures, *extra)


PLANAR_SPAN = f"CAST(greatest(-30, least(9, ceil(log2(radius / ({METRES_PER_DEGREE}D * {_cos('lat')}) * {_MORE})))) AS INT)"
"""Power of two, in degrees, that the planar radius at ``lat`` does not exceed; 2^9 is more than the globe."""


def with_planar_cells(points: DataFrame) -> DataFrame:
    """Like ``with_cells``, on a square grid of degrees with cells of 2^span.

    The planar radius grows without limit towards the poles. On a grid of its
    own size it never reaches further than the next cell.
    """
    scale = 1 << LEVELS
    return points.selectExpr("*", "pow(2D, span) AS height").selectExpr(
        "*", f"CAST(floor((lat + 90) / height * {scale}) AS BIGINT) AS fy",
        f"CAST(floor((lon + 180) / height * {scale}) AS BIGINT) AS fx",
    ).selectExpr("*", f"shiftright(fy, {LEVELS}) AS cy", f"shiftright(fx, {LEVELS}) AS cx")


def cover(cells: DataFrame, mode: str) -> DataFrame:
    """All cells (by, bx) that may hold a partner of a point in the boxes ``a_*``.

    The longitude reach follows from sin²(d/2R) ≥ cos φ1 · cos φ2 · sin²(Δλ/2).
    Columns wrap at the antimeridian; near a pole, where rows have few columns, a
    whole row is covered. In planar mode the cells are those of ``with_planar_cells``.
    """
    if mode == PLANAR:
        return cells.selectExpr("*", "explode(sequence(ay - 1, ay + 1)) AS by").selectExpr(
            "*", "explode(sequence(ax - 1, ax + 1)) AS bx")
    own = "greatest(abs(a_lat0), abs(a_lat1))"
    low, high = _row_range("by", "a_height")
    farthest = f"least(90D, greatest(abs({low}), abs({high})))"
    whole = "_ratio >= 1 OR _c1 - _c0 + 1 >= _cols"
    return (
        cells.selectExpr("*", f"degrees(2 * {_half_angle('a_radius')}) * {_MORE} + 1e-12D AS _up")
        .selectExpr("*", """explode(sequence(
            greatest(CAST(floor((a_lat0 - _up + 90) / a_height) AS BIGINT), 0L),
            least(CAST(floor((a_lat1 + _up + 90) / a_height) AS BIGINT), CAST(floor(180D / a_height) AS BIGINT)))) AS by""")
        .selectExpr("*", f"{_columns_in_row('by', 'a_height')} AS _cols",
                    f"sin({_half_angle('a_radius')}) / sqrt({_cos(own)} * {_cos(farthest)}) AS _ratio")
        .selectExpr("*", f"degrees(2 * asin(least(1D, _ratio))) * {_MORE} + 1e-12D AS _side")
        .selectExpr("*", "CAST(floor((a_lon0 - _side + 180) / 360 * _cols) AS BIGINT) AS _c0",
                    "CAST(floor((a_lon1 + _side + 180) / 360 * _cols) AS BIGINT) AS _c1")
        .selectExpr("*", f"""explode(CASE WHEN {whole} THEN sequence(0L, _cols - 1)
            ELSE sequence(_c0, greatest(_c0, _c1)) END) AS _c""")
        .selectExpr("*", "pmod(_c, _cols) AS bx")
        .drop("_up", "_cols", "_ratio", "_side", "_c0", "_c1", "_c")
    )


def distance(a_lat: str = "a_lat", a_lon: str = "a_lon", b_lat: str = "b_lat", b_lon: str = "b_lon") -> str:
    """Great-circle metres as SQL text; the same arithmetic as ``haversine_m``."""
    chord = f"{_sin2_half(f'{b_lat} - {a_lat}')} + {_cos(a_lat)} * {_cos(b_lat)} * {_sin2_half(f'{b_lon} - {a_lon}')}"
    return f"{EARTH_RADIUS_M}D * 2 * asin(sqrt({chord}))"


def within(mode: str) -> str:
    """The point predicate over a_lat, a_lon, b_lat, b_lon and a_radius."""
    sphere = f"{distance()} <= a_radius"
    planar = (f"pow(b_lat - a_lat, 2) + pow(b_lon - a_lon, 2) <= pow(a_radius / ({METRES_PER_DEGREE}D * {_cos('a_lat')}), 2)")
    return {SPHERE: sphere, PLANAR: planar, BOTH: f"{planar} AND {sphere}"}[mode]


def _gaps(a0: str, a1: str, b0: str, b1: str) -> tuple[str, str]:
    """(smallest, largest) absolute difference between values of two intervals."""
    low, high = f"({b0} - {a1})", f"({b1} - {a0})"
    smallest = f"CASE WHEN {low} <= 0 AND {high} >= 0 THEN 0D ELSE least(abs({low}), abs({high})) END"
    return smallest, f"greatest(abs({low}), abs({high}))"


def _with_verdict(pairs: DataFrame, mode: str, open_again: str) -> DataFrame:
    """Add ``verdict``: in (every point pair is within), out (none is), split or small."""
    lat_min, lat_max = _gaps("a_lat0", "a_lat1", "b_lat0", "b_lat1")
    turn = "360 * round(((b_lon0 + b_lon1) - (a_lon0 + a_lon1)) / 720)"
    near, far = _gaps("a_lon0", "a_lon1", "(b_lon0 - _turn)", "(b_lon1 - _turn)")
    flat_min, flat_max = _gaps("a_lon0", "a_lon1", "b_lon0", "b_lon1")

    def extremes(p: str) -> list[str]:
        low, high = f"{p}_lat0", f"{p}_lat1"
        return [f"{_cos(f'greatest(abs({low}), abs({high}))')} AS _{p}_least",
                f"{_cos(_nearest_to_equator(low, high))} AS _{p}_most"]

    limit = f"pow(sin({_half_angle('a_radius')}), 2)"
    sphere_in = f"{_sin2_half('_lat_max')} + _a_most * _b_most * {_sin2_half('least(_far, 180D)')} <= {limit} * {_LESS}"
    sphere_out = (f"{_sin2_half('_lat_min')} + _a_least * _b_least * "
                  f"{_sin2_half('least(_near, greatest(360 - _far, 0D))')} > {limit} * {_MORE}")
    planar_in = f"pow(_lat_max, 2) + pow(_flat_max, 2) <= pow(a_radius / ({METRES_PER_DEGREE}D * _a_most), 2) * {_LESS}"
    planar_out = f"pow(_lat_min, 2) + pow(_flat_min, 2) > pow(a_radius / ({METRES_PER_DEGREE}D * _a_least), 2) * {_MORE}"
    inside = {SPHERE: sphere_in, PLANAR: planar_in, BOTH: f"{sphere_in} AND {planar_in}"}[mode]
    outside = {SPHERE: sphere_out, PLANAR: planar_out, BOTH: f"({sphere_out}) OR ({planar_out})"}[mode]
    return (
        pairs.selectExpr("*", f"{turn} AS _turn", f"{lat_min} AS _lat_min", f"{lat_max} AS _lat_max",
                         f"{flat_min} AS _flat_min", f"{flat_max} AS _flat_max", *extremes("a"), *extremes("b"))
        .selectExpr("*", f"{near} AS _near", f"{far} AS _far")
        .selectExpr("*", f"CASE WHEN {outside} THEN 'out' WHEN {inside} THEN 'in' WHEN {open_again} THEN 'split' "
                         "ELSE 'small' END AS verdict")
    )


@dataclass(frozen=True)
class Level:
    """One level: its points, and the settled block pairs (``inside`` whole, ``small`` to compare)."""

    level: int
    left: DataFrame
    right: DataFrame
    inside: DataFrame
    small: DataFrame
    hot_left: DataFrame | None
    hot_right: DataFrame | None

    def listed(self) -> "Level":
        """The same level with whole pairs among those to compare, for callers that need every pair."""
        return Level(self.level, self.left, self.right, self.inside, self.inside.unionByName(self.small),
                     self.hot_left, self.hot_right)


_A, _B = ["cfg", "ay", "ax"], ["cfg", "by", "bx"]
# the pair of cells that a pair of blocks comes from
_ORIGIN = ["cell_ay", "cell_ax", "cell_by", "cell_bx"]


def relate(left: DataFrame, right: DataFrame, mode: str = SPHERE, value: Column | None = None,
           pair_limit: int | None = None, cells: str = "true", until_one: bool = False,
           block_limit: int | None = None) -> list[Level]:
    """Block pairs of two point tables, level by level until none is open.

    A pair is open while its blocks make more than ``pair_limit`` pairs of points
    or, if that is given, while one of them has more than ``block_limit`` points.
    ``value`` is aggregated per right block (column ``b_value``). ``cells`` filters
    the pairs of cells at the start. With ``until_one`` a pair of cells is done as
    soon as one of its block pairs lies inside the radius.
    """
    limit = pair_limit or PAIR_LIMIT
    b_cells = blocks(right, 0, "b", value).drop("b_radius", "b_height")
    pairs = cover(blocks(left, 0, "a"), mode).join(b_cells, _B).filter(cells).selectExpr(
        "*", "ay AS cell_ay", "ax AS cell_ax", "by AS cell_by", "bx AS cell_bx"
    )
    values = ["b_value"] if value is not None else []
    levels = []
    for level in range(LEVELS + 1):
        large = f"greatest(a_n, b_n) > {block_limit}" if block_limit else f"a_n * b_n > {limit}"
        open_again = large if level < LEVELS else "false"
        settled = materialize(
            _with_verdict(spread(pairs), mode, open_again).filter("verdict != 'out'").select(
                "cfg", "ay", "ax", "by", "bx", *_ORIGIN, "a_radius", "a_n", "b_n", *values, "verdict"
            )
        )
        split, most_left, most_right = settled.selectExpr(
            "count_if(verdict = 'split')", "max(a_n)", "max(b_n)"
        ).first()
        whole = settled.filter("verdict = 'in'")
        undecided = settled.filter("verdict != 'in'")
        if until_one:
            undecided = undecided.join(whole.select("cfg", *_ORIGIN).distinct(), ["cfg", *_ORIGIN], "left_anti")
        levels.append(Level(
            level, left, right, whole, undecided.filter("verdict = 'small'"),
            _hot(settled, _A, "a_n", most_left), _hot(settled, _B, "b_n", most_right),
        ))
        if not split:
            break
        pairs, left, right = _children(undecided.filter("verdict = 'split'"), levels[-1], value)
    return levels


def cell_pairs(left: DataFrame, right: DataFrame, mode: str = SPHERE) -> DataFrame:
    """(cfg, ay, ax, by, bx, b_n): pairs of occupied cells that may hold points within the radius of each other."""
    pairs = cover(blocks(left, 0, "a"), mode).join(blocks(right, 0, "b").drop("b_radius", "b_height"), _B)
    return _with_verdict(pairs, mode, "false").filter("verdict != 'out'").select("cfg", "ay", "ax", "by", "bx", "b_n")


def _hot(settled: DataFrame, keys: list[str], size: str, most: int | None) -> DataFrame | None:
    if not most or most <= skew.HOT_ROWS:
        return None
    return skew.hot_keys(settled.select(*keys, size).distinct(), keys, size)


def _join_points(points: DataFrame, other: DataFrame, keys: list[str], hot: DataFrame | None) -> DataFrame:
    return points.join(other, keys) if hot is None else skew.salted_join(points, other, keys, hot)


def _children(open_pairs: DataFrame, at: Level, value: Column | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The (at most sixteen) block pairs below each open pair, and the points they hold."""

    def below(points: DataFrame, prefix: str, keys: list[str], hot: DataFrame | None, agg: Column | None):
        parents = open_pairs.select(*keys).distinct()
        kept = materialize(
            _join_points(points.selectExpr("*", *_block(at.level, prefix)), parents, keys, hot).drop(*keys[1:])
        )
        fine = blocks(kept, at.level + 1, prefix, agg).selectExpr(
            "*", f"shiftright({prefix}y, 1) AS _{prefix}y", f"shiftright({prefix}x, 1) AS _{prefix}x"
        )
        return kept, fine

    left, a = below(at.left, "a", _A, at.hot_left, None)
    right, b = below(at.right, "b", _B, at.hot_right, value)
    up = open_pairs.selectExpr("cfg", "ay AS _ay", "ax AS _ax", "by AS _by", "bx AS _bx", *_ORIGIN)
    pairs = up.join(a, ["cfg", "_ay", "_ax"]).join(b.drop("b_radius", "b_height"), ["cfg", "_by", "_bx"])
    return pairs.drop("_ay", "_ax", "_by", "_bx"), left, right


def compared(level: Level, mode: str = SPHERE, left_columns: tuple[str, ...] = ("id",),
             right_columns: tuple[str, ...] = ("id",)) -> DataFrame:
    """Point pairs of the small block pairs that pass the predicate, values as ``a_*`` and ``b_*``."""
    a = level.left.selectExpr("cfg", *_block(level.level, "a"), *[f"{c} AS a_{c}" for c in ("lat", "lon", *left_columns)])
    b = level.right.selectExpr("cfg", *_block(level.level, "b"), *[f"{c} AS b_{c}" for c in ("lat", "lon", *right_columns)])
    pairs = level.small.select(*_A, "by", "bx", *_ORIGIN, "a_radius")
    with_left = spread(_join_points(a, pairs, _A, level.hot_left), *_B)
    return _join_points(b, with_left, _B, level.hot_right).filter(within(mode))


def _compared_arrays(level: Level, many: DataFrame, value: str, how: Callable[[str], Column], mode: str) -> DataFrame:
    """(cfg, id, value) over the block pairs ``many``: each left block meets all right points it needs in one task."""
    a = level.left.selectExpr("cfg", *_block(level.level, "a"), "id", "lat", "lon")
    b = level.right.selectExpr("cfg", *_block(level.level, "b"), "lat", "lon", f"{value} AS value")
    lefts = spread(_join_points(a, many.groupBy(*_A).agg(F.first("a_radius").alias("radius")), _A, level.hot_left), *_A)
    rights = _join_points(b, many.select(*_A, "by", "bx"), _B, level.hot_right).selectExpr(
        "cfg AS b_cfg", "ay AS b_ay", "ax AS b_ax", "lat AS b_lat", "lon AS b_lon", "value AS b_value")
    kind = level.right.select(how(value).alias("value")).schema["value"].dataType
    schema = T.StructType([*level.left.select("cfg", "id").schema, T.StructField("value", kind)])
    ship_package(many.sparkSession)
    task = partial(grid_arrays.fold_block, how.__name__, mode, to_arrow_schema(schema))

    def block(left, right):
        return task(left, right)

    return lefts.groupBy(*_A).cogroup(rights.groupBy("b_cfg", "b_ay", "b_ax")).applyInArrow(block, schema)


def fold(left: DataFrame, right: DataFrame, value: str, how: Callable[[str], Column], mode: str = SPHERE,
         pair_limit: int | None = None) -> DataFrame:
    """For every left point that has partners: ``how`` over the partners' ``value`` -> (cfg, id, value).

    ``how`` is sum, min or max. No pair of points is shuffled: comparisons feed
    a partial aggregate in the same stage, and blocks that lie wholly inside the
    radius add their own aggregate at once. Where a pair of blocks is dense, all
    points a left block needs are compared with it as arrays.
    """
    limit = pair_limit or PAIR_LIMIT
    total = None
    for level in relate(left, right, mode, how(value), block_limit=4 * isqrt(limit)):
        whole = level.inside.groupBy(*_A).agg(how("b_value").alias("value"))
        points = level.left.selectExpr("cfg", *_block(level.level, "a"), "id")
        part = _join_points(points, whole, _A, level.hot_left).select("cfg", "id", "value")
        few = replace(level, small=level.small.filter(f"a_n * b_n <= {limit // FEW_PAIRS}"))
        pairs = compared(few, mode, ("id",), (value,)).selectExpr("cfg", "a_id AS id", f"b_{value} AS value")
        part = part.unionByName(pairs.groupBy("cfg", "id").agg(how("value").alias("value")))
        many = level.small.filter(f"a_n * b_n > {limit // FEW_PAIRS}")
        if not many.isEmpty():
            part = part.unionByName(_compared_arrays(level, many, value, how, mode))
        total = part if total is None else total.unionByName(part)
    return total.groupBy("cfg", "id").agg(how("value").alias("value"))
