import numpy as np
import pytest
from pyspark.sql import functions as F

from placelab.operators import adaptive, adaptive_blocks, adaptive_rounds, grid, grid_arrays, kmeans, neighbors, poi
from placelab.operators.components import connected_components
from placelab.operators.dbscan import dbscan
from placelab.operators.neighbors import Config
from tests import models


def cloud(seed, n, lat, lon, spread, copies=0):
    """Two dense spots in a wider spread, with exact copies of the first point."""
    r = np.random.default_rng(seed)
    k = n // 3
    lats = np.concatenate([lat + r.normal(0, spread / 8, k), lat + spread / 2 + r.normal(0, spread / 8, k), lat + r.uniform(-spread, spread, n - 2 * k)])
    wide = spread / max(np.cos(np.radians(lat)), 0.02)
    lons = np.concatenate([lon + r.normal(0, wide / 8, k), lon + wide / 2 + r.normal(0, wide / 8, k), lon + r.uniform(-wide, wide, n - 2 * k)])
    lats, lons = np.clip(lats, -90, 90), (lons + 180) % 360 - 180
    order = r.permutation(n)
    lats, lons = lats[order], lons[order]
    lats[:copies], lons[:copies] = lats[0], lons[0]
    return lats, lons


def table(spark, lats, lons):
    rows = [(i, float(a), float(o), f"c{i % 3}") for i, (a, o) in enumerate(zip(lats, lons))]
    return spark.createDataFrame(rows, "row_id long, latitude double, longitude double, city string").repartition(3)


PLACES = [(-6.2, 106.8), (0.0, 0.0), (60.0, 179.999), (84.9, -180.0), (89.995, 10.0)]


def everywhere(n, copies=0):
    """One cloud per place, among them the equator, the antimeridian and near a pole."""
    parts = [cloud(i, n, lat, lon, 0.01, copies) for i, (lat, lon) in enumerate(PLACES)]
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def test_pairs_equal_brute_force(spark, hot_paths):
    lats, lons = everywhere(60)
    got = neighbors.neighbor_pairs(table(spark, lats, lons), 400.0).select("a_id", "b_id").collect()
    want = {(i, int(j)) for i, near in enumerate(models.neighbor_sets(lats, lons, 400.0)) for j in near}
    assert len(got) == len(want) and {tuple(r) for r in got} == want


@pytest.mark.parametrize("pair_limit", [9, 250_000])
def test_counts_equal_brute_force_with_hot_positions(spark, hot_paths, monkeypatch, pair_limit):
    monkeypatch.setattr(grid, "PAIR_LIMIT", pair_limit)
    lats, lons = everywhere(45, copies=15)
    got = dict(map(tuple, neighbors.neighbor_counts(table(spark, lats, lons), 400.0).collect()))
    assert got == {i: len(n) for i, n in enumerate(models.neighbor_sets(lats, lons, 400.0))}


def test_dense_blocks_are_not_compared_row_by_row(spark, monkeypatch):
    lats, lons = cloud(3, 6000, -6.2, 106.8, 0.004)
    rowwise, plain = [], grid.compared
    monkeypatch.setattr(grid, "compared", lambda level, *more: rowwise.append(
        level.small.selectExpr("max(a_n * b_n)").first()[0] or 0) or plain(level, *more))
    got = dict(map(tuple, neighbors.neighbor_counts(table(spark, lats, lons), 300.0).collect()))
    assert got == {i: len(n) for i, n in enumerate(models.neighbor_sets(lats, lons, 300.0))}
    assert max(rowwise) <= grid.PAIR_LIMIT // grid.FEW_PAIRS


@pytest.mark.parametrize("lat, lon, radius", [(-6.2, 106.8, 300.0), (60.0, 179.9995, 200.0), (89.999, 10.0, 90.0), (0.0, 0.0, 3e7), (20.0, 5.0, 0.3)])
@pytest.mark.parametrize("mode", [grid.SPHERE, grid.PLANAR, grid.BOTH])
def test_arrays_of_a_block_equal_every_pair(mode, lat, lon, radius):
    r = np.random.default_rng(5)
    reach = min(radius / 111320, 3.0)
    a = np.clip(lat + r.uniform(-reach, reach, 300), -90, 90), (lon + r.uniform(-reach, reach, 300) + 180) % 360 - 180
    b = np.clip(np.append(a[0][:50] + radius / 111320, r.choice(a[0], 5000)), -90, 90), np.append(a[1][:50], r.choice(a[1], 5000))
    i, j = (x.ravel() for x in np.meshgrid(np.arange(300), np.arange(5050), indexing="ij"))
    inside = grid_arrays._within(mode, radius, a[0][i], a[1][i], b[0][j], b[1][j]).reshape(300, 5050)
    value = r.integers(1, 9, 5050)
    for how, empty, wanted in (("sum", 0, (inside * value).sum(axis=1)), ("min", 99, np.where(inside, value, 99).min(axis=1)),
                               ("max", 0, np.where(inside, value, 0).max(axis=1))):
        found, got = grid_arrays._folded(mode, radius, a, b, value, how)
        assert (found == inside.any(axis=1)).all() and (np.where(found, got, empty) == wanted).all()


def test_lists_do_not_write_their_pairs_out(spark, monkeypatch):
    lats, lons = cloud(4, 200, -6.2, 106.8, 0.01)
    lats[7], lons[7] = -7.0, 107.0
    written, plain = [], neighbors.materialize
    monkeypatch.setattr(neighbors, "materialize", lambda df: written.append(df.columns) or plain(df))
    merchants = table(spark, lats, lons)
    rows = merchants.unionByName(merchants.filter("row_id IN (3, 7)"))
    got = neighbors.neighbors_of(rows, rows, 300.0).groupBy("a_id", "b_id").count().collect()
    times = {3: 2}
    assert {(r.a_id, r.b_id): r["count"] for r in got if r.a_id != 7} == {
        (i, j): times.get(i, 1) * times.get(j, 1) for i, j in lists_of(lats, lons, 300.0, range(200))}
    assert not any("hav_m" in columns for columns in written)


def lists_of(lats, lons, radius, centres):
    """Pairs by plain Python: both distances, and no list for a centre alone in its planar ball."""
    pairs = set()
    for i in centres:
        planar = radius / (111320 * np.cos(np.radians(lats[i])))
        ball = np.flatnonzero((lats - lats[i]) ** 2 + (lons - lons[i]) ** 2 <= planar**2)
        if len(ball) > 1:
            pairs |= {(i, int(j)) for j in ball[models.distances(lats[i], lons[i], lats[ball], lons[ball]) <= radius]}
    return pairs


def test_lists_need_company(spark):
    lats, lons = np.array([0.0, 0.0001, 5.0]), np.array([0.0, 0.0, 5.0])
    merchants = table(spark, lats, lons)
    got = {(r.a_id, r.b_id) for r in neighbors.neighbors_of(merchants, merchants, 50.0).collect()}
    assert got == {(0, 0), (0, 1), (1, 0), (1, 1)}


@pytest.mark.parametrize("radius", [600.0, 3e7])
def test_lists_of_given_centres_up_to_the_poles(spark, hot_paths, radius):
    r = np.random.default_rng(12)
    lats = np.concatenate([[90, 90, 90, -90, 89.99, 89.99, 89.99, 89.999, -89.99, 60.0, 60.02, 0.0, 30.0, 45.0],
                           90 - r.uniform(0, 0.02, 12), r.uniform(-90, 90, 30)])
    lons = np.concatenate([[0, 120, -180, 50, 10, 10.5, 100, -80, 0, 179.999, -179.999, 0, 0, 0], r.uniform(-180, 180, 42)])
    merchants = table(spark, lats, lons)
    centres = [i for i in range(len(lats)) if i < 14 or i % 2]
    found = neighbors.neighbors_of(merchants.filter(F.col("row_id").isin(centres)), merchants, radius).collect()
    assert {(x.a_id, x.b_id) for x in found} == lists_of(lats, lons, radius, centres)


def labels_of(spark, lats, lons, configs):
    m = table(spark, lats, lons)
    found = dbscan(m, configs).select("cfg", "lat", "lon", "poi_cluster")
    joined = m.join(found, (m.latitude == found.lat) & (m.longitude == found.lon))
    out = {c.cfg: np.full(len(lats), -1) for c in configs}
    for r in joined.collect():
        out[r.cfg][r.row_id] = r.poi_cluster
    return out


def test_dbscan_equals_ordered_expansion(spark):
    lats, lons = everywhere(150, copies=20)
    configs = [Config(0, 150.0, 4), Config(1, 300.0, 8), Config(2, 500.0, 25)]
    got = labels_of(spark, lats, lons, configs)
    for c in configs:
        assert (got[c.cfg] == models.dbscan(lats, lons, c.radius, c.min_merchants)).all()


def test_dbscan_on_skewed_paths(spark, hot_paths):
    lats, lons = cloud(4, 80, -6.2, 106.8, 0.008, copies=25)
    got = labels_of(spark, lats, lons, [Config(0, 300.0, 8)])[0]
    want = models.dbscan(lats, lons, 300.0, 8)
    assert (got == want).all() and want.max() >= 0


def test_components_of_a_long_chain_and_a_star(spark, monkeypatch):
    from placelab.operators import skew

    monkeypatch.setattr(skew, "HOT_ROWS", 5)
    chain = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 40)] + [(7, 7)]
    got = connected_components(spark.createDataFrame(chain, "u long, v long")).collect()
    assert {r.node: r.component for r in got} == {**{i: 0 for i in range(61)}, **{100 + i: 100 for i in range(40)}}


@pytest.mark.parametrize("n,tried,tile,listed,per_tile", [
    (220, 64, 32, 50_000, 2_000_000), (120, 2, 1, 50_000, 40), (120, 3, 2, 0, 1000), (120, 64, 32, 12, 1000)])
def test_adaptive_equals_sequential_loop(spark, monkeypatch, n, tried, tile, listed, per_tile):
    for name, value in (("FIRST_TRIED", tried), ("TILE_CELLS", tile), ("LISTED", listed), ("LISTED_PER_TILE", per_tile)):
        monkeypatch.setattr(adaptive_rounds, name, value)
    radius, needed = 600.0, 6
    lats, lons = cloud(7, n, 60.0, 179.999, 0.02, copies=20)
    labels, radii = models.adaptive(lats, lons, radius, needed)
    found = adaptive.detect_adaptive(table(spark, lats, lons), radius, needed)
    got = [r.poi_cluster for r in found.membership.orderBy("row_id").collect()]
    assert got == labels.tolist() and max(got) >= 0
    pois = found.pois.orderBy("cluster_id").collect()
    assert [p.radius_meters for p in pois] == pytest.approx(radii)
    assert poi.coverage(found.membership).first().merchants_in_pois == (labels >= 0).sum()


def test_adaptive_with_thousands_of_centres_in_one_cell(spark):
    r = np.random.default_rng(4)
    lats, lons = 0.001 + r.uniform(0, 0.003, 21_000), 0.001 + r.uniform(0, 0.003, 21_000)
    labels, _ = models.adaptive(lats, lons, 600.0, 15)
    found = adaptive.detect_adaptive(table(spark, lats, lons), 600.0, 15)
    got = [r.poi_cluster for r in found.membership.orderBy("row_id").collect()]
    assert got == labels.tolist() and max(got) >= 2
    assert adaptive_rounds.claims_in_order.rounds <= 12  # of 2,100 centres


def test_adaptive_rounds_do_not_grow_with_merchants_in_reach(spark):
    r = np.random.default_rng(5)
    lats, lons = 10.0 + r.uniform(0, 0.02, 30_000), 20.0 + r.uniform(0, 0.02, 30_000)
    labels, _ = models.adaptive(lats, lons, 600.0, 15)
    found = adaptive.detect_adaptive(table(spark, lats, lons), 600.0, 15)
    got = [x.poi_cluster for x in found.membership.orderBy("row_id").collect()]
    assert got == labels.tolist() and max(got) >= 20
    assert adaptive_rounds.claims_in_order.rounds <= 3  # six when a round listed the neighbours of every tried centre


@pytest.mark.parametrize("lat,lon", [(-6.2, 106.8), (60.0, 179.999), (89.995, 10.0)])
def test_free_blocks_equal_brute_force(lat, lon):
    radius = 600.0
    lats, lons = cloud(12, 3000, lat, lon, 0.01)
    weight = np.random.default_rng(12).integers(1, 4, 3000)
    blocks, free = adaptive_blocks.FreeBlocks(lats, lons, weight), np.ones(3000, bool)
    doubted = np.zeros(3000, bool)
    for x in range(0, 3000, 60):
        near = blocks.near(lats[x], lons[x], radius)
        inside = grid_arrays._within("both", radius, np.full(3000, lats[x]), np.full(3000, lons[x]), lats, lons)
        want = np.flatnonzero(inside & free)
        found = near.spots()
        assert sorted(blocks.order[found]) == want.tolist() and near.total == weight[want].sum()
        assert near.doubtful() == doubted[want].any()
        if len(want):
            middle = [(c[want] * weight[want]).sum() / weight[want].sum() for c in (lats, lons)]
            kept = want[models.distances(*middle, lats[want], lons[want]) <= 200.0]
            bound = near.at_most(200.0, 10)
            assert bound >= weight[kept].sum() and (bound < 10 or bound == weight[kept].sum())
            if x % 180 == 0:
                taken = blocks.take(found[: len(found) // 2])
                free[taken] = False
        if x % 600 == 540:
            blocks.doubt(lats[x], lons[x], 50.0)
            doubted |= free & grid_arrays._within("both", 50.0, np.full(3000, lats[x]), np.full(3000, lons[x]), lats, lons)


def test_kmeans_invariants(spark):
    lats, lons = cloud(8, 240, -6.2, 106.8, 0.01)
    found = kmeans.detect_kmeans(table(spark, lats, lons), max_radius=400.0, min_merchants=10, restarts=3)
    members = found.membership.collect()
    assert sorted(r.row_id for r in members) == list(range(240))
    pois = found.pois.orderBy("cluster_id").collect()
    assert [p.cluster_id for p in pois] == list(range(len(pois))) and pois
    assert all(p.merchant_count >= 10 and p.actual_max_radius == p.max_distance for p in pois)
    firsts = [min(r.row_id for r in members if r.poi_cluster == p.cluster_id) for p in pois]
    assert len(set(firsts)) == len(firsts)


def test_kmeans_single_cluster_and_rule(spark):
    assert [kmeans.auto_clusters(*a) for a in ((1000, 30), (20, 15), (15000, 30))] == [16, 1, 20]
    lats, lons = cloud(9, 30, -6.2, 106.8, 0.0005)
    found = kmeans.detect_kmeans(table(spark, lats, lons), n_clusters=1, max_radius=1000.0, min_merchants=5)
    assert found.pois.first().merchant_count == 30


def test_statistics_without_pois(spark):
    lats, lons = cloud(10, 12, -6.2, 106.8, 0.5)
    row = poi.statistics(poi.detect_dbscan(table(spark, lats, lons), 10.0, 5)).first()
    assert (row.total_pois, row.total_merchants_in_pois, row.total_merchants_outside_pois) == (0, 0, 12)
    assert row.coverage_percentage == 0 and row.std_merchants_per_poi is None


def test_partitioning_does_not_matter(spark):
    lats, lons = cloud(11, 150, -6.2, 106.8, 0.012)
    m = table(spark, lats, lons)
    first = poi.detect_dbscan(m, 300.0, 5).membership.orderBy("row_id").collect()
    other = poi.detect_dbscan(m.orderBy(F.rand(3)).repartition(7), 300.0, 5).membership.orderBy("row_id").collect()
    assert [r.poi_cluster for r in first] == [r.poi_cluster for r in other]


def test_small_tables_are_compared_by_all_tasks(spark):
    lats, lons = cloud(3, 3000, -6.2, 106.8, 0.01)
    pairs = neighbors.neighbor_pairs(table(spark, lats, lons), 300.0)
    tasks = pairs.groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert len(tasks) >= 6 and sum(t["count"] for t in tasks) == sum(map(len, models.neighbor_sets(lats, lons, 300.0)))


def test_positions_of_a_small_table_are_dealt_over_tasks(spark, monkeypatch):
    from placelab.operators import dbscan as module

    files, plain = [], module.cluster
    monkeypatch.setattr(module, "cluster", lambda spots, configs: files.append(len(spots.inputFiles())) or plain(spots, configs))
    lats, lons = cloud(4, 300, -6.2, 106.8, 0.008, copies=25)
    got = labels_of(spark, lats, lons, [Config(0, 300.0, 8)])[0]
    assert files[0] >= 8 and (got == models.dbscan(lats, lons, 300.0, 8)).all()
