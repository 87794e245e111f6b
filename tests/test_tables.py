import numpy as np
import pytest
from pyspark.sql import functions as F

from placelab import gazetteer
from placelab.operators import clean, harvest, rows, summary, tasks
from placelab.operators import places as P
from placelab.schemas import PLACE_COLUMNS
from placelab.sources import samples


def test_row_ids_are_dense_and_ordered(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("k")).repartition(5)
    got = rows.with_row_id(df, "k").orderBy("k").collect()
    assert [r.row_id for r in got] == list(range(1000))
    totals = rows.with_running_total(df, "k", "k").orderBy("k").collect()
    assert [r.running_total for r in totals] == [sum(r.k for r in totals[: i + 1]) for i in range(1000)]


def observed(spark, scrolls):
    data = [(1, s, p, h) for s, links in enumerate(scrolls) for p, h in enumerate(links)]
    return spark.createDataFrame(data, "task_id long, scroll_no int, pos int, href string")


@pytest.mark.parametrize("scrolls,want", [
    ([["a", "b"], ["a", "b", "c"], ["c"], ["d", "e"]], "abcd"),
    ([["a"], ["a"], ["a"], ["a"], ["b"]], "a"),
    ([[], [], [], ["a"]], ""),
    ([["a"], [], [], ["b"]], "ab"),
    ([["a", None, ""], ["b"]], "ab"),
    ([["a"]] + [[c] for c in "bcdefghijk"], "abcd"),
])
def test_harvest(spark, scrolls, want):
    got = harvest.harvest_links(observed(spark, scrolls), max_results=4).orderBy("rank").collect()
    assert "".join(r.href for r in got) == want and [r.rank for r in got] == list(range(1, len(want) + 1))


def test_harvest_limits_each_task(spark):
    both = observed(spark, [["a", "b", "c"]]).unionByName(
        observed(spark, [["x", "y", "z"]]).withColumn("task_id", F.lit(2).cast("long")))
    plan = spark.createDataFrame([(1, 1), (2, 2)], "task_id long, max_results int")
    assert sorted(r.href for r in harvest.harvest_for_tasks(both, plan).collect()) == ["a", "x", "y"]


def test_gazetteer_sizes(spark):
    levels = dict(map(tuple, gazetteer.gazetteer(spark).groupBy("level").count().collect()))
    assert levels == {"district": 42, "subdistrict": 34}


def test_tasks_from_locations(spark):
    places = spark.createDataFrame(
        [(0, "Senayan", "Kebayoran Baru", "Jakarta Selatan", "x"), (1, None, "Menteng", "Jakarta Pusat", None),
         (2, " ", "nan", None, " Tebet "), (3, None, None, None, None)],
        "pos long, subdistrict string, district string, city string, location string")
    got = tasks.tasks_from_tables(tasks.from_list(spark, ["toko", "cafe"], "keyword"), places).orderBy("task_id").collect()
    assert [r.location for r in got[:4]] == ["Senayan, Kebayoran Baru, Jakarta Selatan", "Menteng, Jakarta Pusat", "Tebet", ""]
    assert [r.task_id for r in got] == list(range(8)) and got[5].query == "cafe Menteng, Jakarta Pusat"


def test_sample_tasks(spark):
    made = tasks.tasks_from_tables(samples.sample_keywords(spark), samples.sample_locations(spark), 30)
    assert tasks.estimate(made, 4, 10).first().asDict() == {
        "keywords": 6, "locations": 5, "tasks": 30, "est_seconds": 75.0, "max_places": 900}
    subdistricts = tasks.subdistrict_tasks(samples.sample_keywords(spark), "Jakarta Selatan", "Tebet")
    assert subdistricts.count() == 42 and subdistricts.first().district == "Tebet"


def test_rerun_layouts(spark):
    full = spark.createDataFrame([(" a ", None, "D", "R"), ("a", "", "D", "R"), ("a", "S", None, "R")],
                                 "search_keyword string, search_subdistrict string, search_district string, search_region string")
    short = spark.createDataFrame([("b", " x "), ("b", "x")], "search_keyword string, search_location string")
    wrong = spark.createDataFrame([("c",)], "keyword string")
    got = tasks.rerun_tasks([full.withColumn("source_file", F.lit("f")), short, wrong]).orderBy("task_id").collect()
    assert [(r.keyword, r.location) for r in got] == [("b", "x"), ("a", "D, R"), ("a", "D, R"), ("a", "S, R")]
    with pytest.raises(ValueError):
        tasks.rerun_tasks(wrong)


def test_validity(spark):
    assert not tasks.validate_keywords(spark.createDataFrame([("x",)], "word string")).ok
    assert "city" in tasks.validate_locations(spark.createDataFrame([("x",)], "district string")).message
    assert tasks.validate_locations(samples.sample_locations(spark)).message == "Valid (with subdistrict column)"


def captured(spark, data):
    return spark.createDataFrame(data, "task_id long, rank int, link string, name_text string, address_aria array<string>")


def test_first_valid_place_wins(spark):
    rows_ = captured(spark, [
        (1, 1, "u", " ", None), (1, 2, "u", "Second", ["no", "Address: Jl. Braga 10, Bandung"]), (1, 3, "u", "Third", None),
        (1, 4, "v", "Results", None), (1, 5, None, "No link", None), (2, 1, "u", "Other task", None)])
    got = P.places_from_captures(rows_).orderBy("task_id").collect()
    assert [(r.task_id, r.rank, r.name) for r in got] == [(1, 2, "Second"), (2, 1, "Other task")]
    assert got[0].address == "Jl. Braga 10, Bandung" and got[0].city == "Bandung"
    assert [c for c in P.places_from_captures(rows_).columns if c not in ("task_id", "rank")] == PLACE_COLUMNS


def test_identity(spark):
    data = [(1, 1, "A", 0.0, 5.0), (1, 2, "A", None, 5.0), (1, 3, "A", 1.0, 5.0), (2, 1, "A", 1.0, 5.0), (2, 2, "B", 1.0, 5.0)]
    df = spark.createDataFrame(data, "task_id long, rank int, name string, latitude double, longitude double")
    assert sorted((r.task_id, r.rank) for r in P.dedup_global(df).collect()) == [(1, 1), (1, 3), (2, 2)]
    assert sorted(r.copies for r in P.duplicates(df).collect()) == [2, 2]


def test_counts_hide_blank_after_the_cut(spark):
    df = spark.createDataFrame([(c,) for c in ["", "", "", "b", "b", "a", "a", "z", None]], "category string")
    assert [(r.category, r.places) for r in summary.top_categories(df, 3).collect()] == [("a", 2), ("b", 2)]


def test_damaged_coordinates(spark):
    df = samples.damaged_merchants(spark)
    fixed = clean.repair(df).collect()
    assert len(fixed) == 20 and sum(r.latitude > 0 for r in fixed) == 12 and sum(r.latitude < 0 for r in fixed) == 8
    assert all(r.latitude < 0 for r in clean.repair(df, keep_sign=True).collect())
    codes = [r.code for r in clean.diagnose(df).orderBy("ord").collect()]
    # joined text is no number, so the range only covers the plain values
    assert codes == ["string_type", "string_type", "concatenated", "concatenated"]
    assert clean.quick_fix(df).count() == 20 and clean.repair_only(df).count() == 20


def test_clean_counts_and_errors(spark):
    df = spark.createDataFrame([(1.0, 2.0), (None, 2.0), (float("nan"), 1.0), (91.0, 0.0), (0.0, 181.0)],
                               "latitude double, longitude double")
    result = clean.clean(df)
    assert result.rows.count() == 1
    assert dict(map(tuple, result.rejected.collect())) == {"null": 2, "out_of_range": 2}
    assert clean.clean(df, auto_fix=False).rows.count() == 5
    with pytest.raises(ValueError):
        clean.clean(df.drop("latitude"))
    assert [r.code for r in clean.diagnose(df.drop("latitude")).collect()] == ["missing_column"]


def test_diagnose_first_value_only(spark):
    df = spark.createDataFrame([(1, None, "1"), (2, "1.5", "2"), (3, "1.5-1.6-1.7-1.8-1.9", "3")], "k int, latitude string, longitude string")
    assert "concatenated" in {r.code for r in clean.diagnose(df).collect()}
    assert "concatenated" not in {r.code for r in clean.diagnose(df, order_col="k").collect()}


def test_synthetic_merchants(spark):
    df = samples.synthetic_merchants(spark, 1000)
    assert df.count() == 1000 and clean.diagnose(df).isEmpty()
    rows = sorted(map(tuple, df.collect()))
    assert rows == sorted(map(tuple, samples.scattered(spark.range(0, 1000, 1, 7).toDF("row_id")).collect()))
    spread = np.array([r[1] for r in rows[:345]]) - np.repeat([-6.2088, -6.2100, -6.2050], 115)
    assert abs(spread.mean()) < 0.001 and abs(spread.std() - 0.005) < 0.0006


def test_only_needed_fields_are_planned(spark):
    rows = [(1, 1, "u/@-6.5,106.8", "Shop", "food", "Jl. A, Kel. Menteng, Kec. Tebet, Jakarta Selatan, DKI Jakarta 12810", "4.5 (7)"),
            (1, 2, None, "No link", "food", None, None), (1, 3, "v", "Results", "x", None, None)]
    schema = "task_id long, rank int, link string, name_text string, category_text string, address_text string, rating_box_text string"
    captures = spark.createDataFrame(rows, schema)
    whole = P.assemble(captures)
    for columns in (("category",), ("city",), ("subdistrict",), ("zip_code", "rating"), ("latitude", "name"), ("province", "district")):
        part = P.assemble(captures, columns=columns)
        assert set(part.columns) == {"task_id", "rank", *columns}
        assert part.collect() == whole.select(part.columns).collect() and part.count() == 1
    plan = P.assemble(captures, columns=("category",))._jdf.queryExecution().toString()
    assert "Generate" not in plan and "regexp" not in plan.split("Physical Plan")[1].lower().replace("regexp_replace", "")


def test_commonest_names_of_clusters(spark):
    rows = [(0, "b", None), (0, "a", None), (0, "b", "x"), (0, "a", "y"), (1, None, None), (2, "z", "q")]
    from placelab.operators.poi import _commonest

    got = _commonest(spark.createDataFrame(rows, "poi_cluster int, city string, district string"), ["city", "district"]).collect()
    assert sorted(map(tuple, got)) == [(0, "a", "x"), (2, "z", "q")]


def test_one_long_number_is_not_joined(spark):
    rows = spark.createDataFrame([(0, "-6.1234567890123456", "106.8"), (1, "-6.2", "106.9")], "row_id long, latitude string, longitude string")
    assert "concatenated" not in {r.code for r in clean.diagnose(rows).collect()}
