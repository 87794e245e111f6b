import duckdb
import pytest

from placelab.operators import adaptive, grid
from placelab.operators.dbscan import dbscan
from placelab.operators.neighbors import Config
from placelab.plans import sweep
from tests import models
from tests.test_distance import cloud, table
from workload import check, oracles, queries


@pytest.fixture
def customers(spark, tmp_path):
    """A folder of tables with customers of the given keys."""

    def write(keys, nations=25):
        rows = [(k, f"c{k}", i % nations, 1.0, "S") for i, k in enumerate(keys)]
        spark.createDataFrame(rows, "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string").write.parquet(
            f"{tmp_path}/customer.parquet")
        return str(tmp_path)

    return write


@pytest.mark.parametrize("name", ["poi_sweep_density", "poi_sweep_density_top"])
def test_a_failed_detector_is_no_result_without_an_error_column(spark, customers, monkeypatch, name):
    def fail(*_):
        raise ValueError("cannot take it")

    monkeypatch.setattr(sweep.dbscan, "dbscan", fail)
    monkeypatch.setattr(sweep, "_adaptive", lambda *_: spark.createDataFrame([(9, 1, 1)], "cfg int, pois_found long, inside long"))
    with pytest.raises(ValueError, match="cannot take it"):
        queries.queries()[name](spark, customers(range(20)))


def same_as_sql(spark, folder, name):
    """The rows of a query, once they equal those of its SQL."""
    con = duckdb.connect()
    con.execute(f"CREATE VIEW customer AS SELECT * FROM read_parquet('{folder}/customer.parquet/*.parquet')")
    got = queries.queries()[name](spark, folder).toArrow()
    assert check.compare(got, con.sql(oracles.oracle_sql()[name]).to_arrow_table()) == ""
    return got.to_pylist()


def test_adaptive_tries_every_merchant(spark, customers):
    folder = customers(range(3, 3003, 10), nations=2)  # no key is a multiple of ten
    assert len(same_as_sql(spark, folder, "poi_adaptive")) >= 2


def test_adaptive_with_every_merchant_equals_sequential_loop(spark, monkeypatch):
    lats, lons = cloud(7, 150, 60.0, 179.999, 0.02, copies=20)
    monkeypatch.setattr(models, "range", lambda start, end, step: range(start, end), raising=False)
    labels, radii = models.adaptive(lats, lons, 600.0, 6)
    found = adaptive.detect_adaptive(table(spark, lats, lons), 600.0, 6, step=1)
    got = [r.poi_cluster for r in found.membership.orderBy("row_id").collect()]
    assert got == labels.tolist() and max(got) >= 0
    assert [p.radius_meters for p in found.pois.orderBy("cluster_id").collect()] == pytest.approx(radii)


def test_sweep_top_tries_every_merchant(spark, customers):
    folder = customers(range(3, 1503, 10), nations=1)  # no key is a multiple of ten
    assert any(r["method"] == "Adaptive" and r["pois_found"] for r in same_as_sql(spark, folder, "poi_sweep_top"))


def test_cells_are_linked_and_neighbours_counted_once_per_radius(spark, monkeypatch):
    lats, lons = cloud(3, 6000, -6.2, 106.8, 0.004)
    configs = [Config(i, radius, needed) for i, (radius, needed) in enumerate([(300.0, 15), (300.0, 40), (200.0, 15), (300.0, 25)])]
    linked, counted, compared, fold = [], [], grid.compared, grid.fold

    def comparing(level, *more):
        linked.append(level.small.selectExpr("max(a_n * b_n)").first()[0] or 0)
        return compared(level, *more)

    def folding(left, right, value, *more):
        counted.append((value, {r.cfg for r in left.select("cfg").distinct().collect()}))
        return fold(left, right, value, *more)

    monkeypatch.setattr(grid, "compared", comparing)
    monkeypatch.setattr(grid, "fold", folding)
    rows = table(spark, lats, lons)
    got = {(r.cfg, r.lat, r.lon): r.poi_cluster for r in dbscan(rows, configs).collect()}
    for c in configs:
        want = models.dbscan(lats, lons, c.radius, c.min_merchants)
        assert [got.get((c.cfg, a, o), -1) for a, o in zip(lats, lons)] == want.tolist()
    assert max(linked) <= grid.PAIR_LIMIT // grid.FEW_PAIRS
    assert [cfgs for value, cfgs in counted if value == "weight"] == [{1, 2}]
    counted.clear()
    adaptive.claims(rows, configs)
    assert [len(cfgs) for value, cfgs in counted if value == "weight"] == [2]
