import pytest
from pyspark.sql import functions as F

from placelab.functions import text as X
from placelab.functions.address import parse_address_columns
from placelab.functions.coords import link_coordinates, repair_coordinate
from placelab.functions.geo import degree_tolerances, haversine_m

NBSP = " "


def test_rating(values):
    cases = {"4.5": 4.5, "4,5": 4.5, "4.5 (123)": 4.5, "5": 5.0, "0": 0.0, "5.9": 5.0, "10.5": None, "7": None,
             "-3.2": 3.2, "abc": None, "": None, None: None}
    assert values(list(cases), X.parse_rating) == list(cases.values())


def test_reviews_count(values):
    cases = {"123 reviews": 123, "(123)": 123, "1,234 reviews": 1234, "1.234 reviews": 1234, "1 234 reviews": 1234,
             "1.5K": 15, f"1{NBSP}234": None, "12\t3": None, "no": None, "": None, None: None, "1 review\n": 1}
    assert values(list(cases), X.parse_reviews_count) == list(cases.values())


def test_clean_text(values):
    cases = {"  a\nb\r\n ": "a b", "a\r\nb": "a b", "   ": "", "": None, None: None, f"{NBSP}x\t": "x"}
    assert values(list(cases), X.clean_text) == list(cases.values())


def test_labels(values):
    assert values(["Phone: 021: 5 ", "none", None, ":"], X.after_colon) == ["021: 5", None, None, ""]


def test_box_texts(values):
    texts = ["4,6 (1.234 reviews)", "4.5 (12 3)", "x", None]
    assert values(texts, lambda x: X.rating_text(x, F.lit("alt"))) == ["4.6", "4.5", "alt", "alt"]
    assert values(["4.5 (1.234)", "(12 3)", "(x)"], X.reviews_text) == ["1.234", "12 3", None]


def test_stars(spark):
    df = spark.createDataFrame([(["9 x", None, "none"],), (None,)], "bars array<string>")
    got = df.select(*[X.star_count(df.bars, s).alias(f"s{s}") for s in range(1, 6)]).collect()
    assert [tuple(r) for r in got] == [(None, None, None, None, 9), (None,) * 5]


def test_slug(spark):
    df = spark.createDataFrame([(7, "toko/a b", "Tebet, Jakarta/S"), (1234, "x", "y")], "t long, k string, l string")
    got = [r.s for r in df.select(X.task_slug(df.t, df.k, df.l).alias("s")).collect()]
    assert got == ["task_007_toko_a_b_Tebet_Jakarta_S", "task_1234_x_y"]


def test_link_coordinates(values):
    links = ["x/@-6.2,106.8,17z/data=!8m2!3d-6.2088!4d106.8456", "x/@-6.2000,106.8000,17z", "x/@-6,106,17z", None]
    assert [tuple(v) for v in values(links, link_coordinates)] == [
        (-6.2088, 106.8456), (-6.2, 106.8), (None, None), (None, None)
    ]


ADDRESSES = [
    ("Jl. Sudirman No.1, Senayan, Kec. Kebayoran Baru, Jakarta Selatan, DKI Jakarta 12190",
     ("Senayan", "Kebayoran Baru", "Jakarta Selatan", "DKI Jakarta", "12190")),
    ("Jl. X, Kel. Melawai, Kec. Kebayoran Baru, Kota Jakarta Selatan, Daerah Khusus Ibukota Jakarta 12160",
     ("Melawai", "Kebayoran Baru", "Jakarta Selatan", "Daerah Khusus Ibukota Jakarta", "12160")),
    ("Jl. Y, Melawai, Jakarta Selatan, Daerah Khusus Ibukota Jakarta 12160",
     ("Melawai", None, "Jakarta 12160", "Daerah Khusus Ibukota Jakarta", "12160")),
    ("Kec. Tebet, Jakarta Selatan", ("Kec. Tebet", "Tebet", "Jakarta Selatan", None, None)),
    ("Jl. Braga 10, Bandung", (None, None, "Bandung", None, None)),
    ("Toko A, Balige, Toba", ("Toko A", None, None, "Bali", None)),
    (f"Desa Suka, Kota{NBSP}Bandung", ("Suka", None, "Bandung", None, None)),
    ("Pasar Lama, Kec Tebet", ("Pasar Lama", "Tebet", None, None, None)),
    ("", (None,) * 5), (None, (None,) * 5),
]


def test_address(spark):
    df = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(ADDRESSES)], "i int, address string")
    got = [tuple(r)[2:] for r in parse_address_columns(df).orderBy("i").collect()]
    assert got == [parts for _, parts in ADDRESSES]


REPAIRS = [
    ("-8.7096028-8.7096583-8.7114426", (8.7096028, 8.7114426, 8.7096583, 8.7102345667)),
    ("115.1-115.2-115.3-115.4", (115.1, 115.4, 115.3, 115.25)),
    ("-8.7105679", (-8.7105679,) * 4), (" 1e-5 ", (0.00001,) * 4),
    ("115.1-x", (None,) * 4), ("", (None,) * 4), ("-", (None,) * 4), (None, (None,) * 4), ("1.0d", (None,) * 4),
]


@pytest.mark.parametrize("at,method", list(enumerate(["first", "last", "middle", "average"])))
def test_repair(values, at, method):
    got = values([t for t, _ in REPAIRS], lambda x: repair_coordinate(x, method))
    assert got == [None if w[at] is None else pytest.approx(w[at]) for _, w in REPAIRS]


def test_repair_options(values):
    assert values(["-8.7-8.8", "8.7-8.8", "-8.7"], lambda x: repair_coordinate(x, "first", keep_sign=True)) == [-8.7, 8.7, -8.7]
    assert values(["8.7|8.8", "8.7.|8"], lambda x: repair_coordinate(x, "unknown", "|")) == [8.7, None]


def test_distance(spark):
    lat, lon = degree_tolerances(111320.0, F.lit(60.0))
    row = spark.range(1).select(
        haversine_m(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)).alias("d"), lat.alias("lat"), lon.alias("lon")
    ).first()
    assert row.d == pytest.approx(111194.926645) and (row.lat, row.lon) == (1.0, pytest.approx(2.0))
