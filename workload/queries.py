"""One query per operator over the given tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from placelab.functions import text as X
from placelab.functions.address import parse_address_columns
from placelab.functions.coords import REPAIR_METHODS, link_coordinates
from placelab.functions.geo import degree_tolerances, haversine_m
from placelab.operators import adaptive, clean, harvest, kmeans, neighbors, poi, summary, tasks
from placelab.operators import places as P
from placelab.operators.rows import with_row_id
from placelab.plans import merge, run, search, solution, sweep
from placelab.session import checkpoint_dir, materialize
from placelab.sources import html, readers, samples, sinks, task_writer
from placelab.streaming import identity_index, incremental
from workload import views

Query = Callable[[SparkSession, str], DataFrame]

RADIUS, NEEDED = 500.0, 15


class Tables:
    """The given tables and the views derived from them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getitem__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def _bound(self, text: str, tables: tuple[str, ...]) -> DataFrame:
        # temporary views keep the text identical to the one the checking engine runs
        for name in tables:
            self[name].createOrReplaceTempView(name)
        return self.spark.sql(text)

    def merchants(self) -> DataFrame:
        return self._bound(views.MERCHANTS, ("customer",))

    def captures(self) -> DataFrame:
        return self._bound(views.CAPTURES, ("customer",))

    def observations(self) -> DataFrame:
        return self._bound(views.OBSERVATIONS, ("events",))

    def keywords(self) -> DataFrame:
        return self._bound(views.KEYWORDS, ("part",))

    def locations(self) -> DataFrame:
        return self._bound(views.LOCATIONS, ("nation", "region"))

    def dirty(self) -> DataFrame:
        self.merchants().createOrReplaceTempView("merchants")
        return self.spark.sql(views.DIRTY_MERCHANTS)

    def rerun(self) -> DataFrame:
        return self._bound(views.RERUN, ("orders",))

    def bars(self) -> DataFrame:
        return self._bound(views.BARS, ("customer",))

    def event_captures(self) -> DataFrame:
        return self._bound(views.EVENT_CAPTURES, ("events",))

    def event_tasks(self) -> DataFrame:
        return self._bound(views.EVENT_TASKS, ("events",))

    def places(self, *columns: str) -> DataFrame:
        """Assembled places; only ``columns`` are worked out, if any are named."""
        return P.assemble(self.captures(), columns=columns) if columns else P.assemble(self.captures())

    def scratch(self) -> str:
        return f"{checkpoint_dir(self.spark)}/run-{uuid.uuid4().hex}"


def _round(df: DataFrame, **digits: int) -> DataFrame:
    return df.withColumns({c: F.round(c, d) for c, d in digits.items() if c in df.columns})


def _rounded_pois(df: DataFrame) -> DataFrame:
    return _round(df, center_lat=6, center_lon=6, max_distance=3, avg_distance=3, min_distance=3, radius_meters=3,
                  actual_max_radius=3)


def _named_locations(t: Tables) -> DataFrame:
    return t["nation"].select(F.col("n_nationkey").cast("long").alias("pos"), F.col("n_name").alias("location"))


# ---- planning


def task_cross(t: Tables) -> DataFrame:
    return tasks.cross_tasks(t.keywords(), _named_locations(t))


def task_from_table(t: Tables) -> DataFrame:
    return tasks.tasks_from_tables(t.keywords(), t.locations())


def task_form_locations(t: Tables) -> DataFrame:
    return tasks.cross_tasks(t.keywords(), tasks.form_locations(t.locations()).select("pos", "location"))


def task_district(t: Tables) -> DataFrame:
    return tasks.district_tasks(t.keywords(), "Jakarta Selatan")


def task_subdistrict(t: Tables) -> DataFrame:
    return tasks.subdistrict_tasks(t.keywords(), "Jakarta Selatan", "Kebayoran Baru")


def task_estimate(t: Tables) -> DataFrame:
    return tasks.estimate(task_from_table(t), workers=4, sec_per_task=15)


def task_slug(t: Tables) -> DataFrame:
    named = tasks.slugs(task_from_table(t))
    return named.select("task_id", "task_slug", tasks.task_label(F.col("keyword"), F.col("location")).alias("label"))


def rerun_pairs(t: Tables) -> DataFrame:
    return tasks.rerun_pairs(t.rerun())


def rerun_tasks(t: Tables) -> DataFrame:
    return tasks.rerun_tasks(t.rerun(), 150).select("task_id", "keyword", "location", "max_results", "query")


def validate_inputs(t: Tables) -> DataFrame:
    checks = [
        ("keywords", tasks.validate_keywords(t.keywords())),
        ("keywords_renamed", tasks.validate_keywords(t.keywords().withColumnRenamed("keyword", "word"))),
        ("keywords_empty", tasks.validate_keywords(t.keywords().filter("keyword IS NULL"))),
        ("locations", tasks.validate_locations(t.locations())),
        ("locations_no_city", tasks.validate_locations(t.locations().drop("city"))),
        ("locations_plain", tasks.validate_locations(t.locations().drop("subdistrict"))),
    ]
    return t.spark.createDataFrame([(n, c.ok, c.message) for n, c in checks], "input string, ok boolean, message string")


# ---- capture to place


def harvest_links(t: Tables) -> DataFrame:
    return harvest.harvest_links(t.observations(), max_results=40)


def harvest_links_impatient(t: Tables) -> DataFrame:
    """Tasks stop at the first scroll without a new link, which most of them meet."""
    t.observations().createOrReplaceTempView("observations")
    return harvest.harvest_links(t.spark.sql(views.SPARSE_OBSERVATIONS), max_results=1000, max_scrolls=200, patience=1)


def search_places(t: Tables) -> DataFrame:
    found = search.collect_places(t.event_tasks(), t.observations(), t.event_captures())
    return found.select("task_id", "rank", "link", "name", "category", "search_keyword", "search_location")


def _searched(t: Tables) -> tuple[run.Run, str]:
    """A whole run from two delimited files; every eleventh task has failed."""
    files = {"keywords": t.keywords().orderBy("pos").select("keyword"), "locations": t.locations().orderBy("pos").drop("pos")}
    paths = {name: t.scratch() for name in files}
    for name, rows in files.items():
        rows.coalesce(1).write.options(
            header=True, escape='"', emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(paths[name])
    failed = t.event_tasks().filter("task_id % 11 = 3").select("task_id", F.lit("timeout").alias("error"))
    options = sinks.OutputOptions(output_dir=t.scratch())
    done = run.run_search(t.spark, paths["keywords"], paths["locations"], t.observations(), t.event_captures(), failed, options)
    return done, options.output_dir


def run_outcomes(t: Tables) -> DataFrame:
    return _searched(t)[0].outcomes


def run_task_files(t: Tables) -> DataFrame:
    """The files that a run has written, one per task with places, read back."""
    rows = merge.merge_task_files(t.spark, _searched(t)[1]).places
    number = F.regexp_extract("source_file", r"^task_(\d+)_", 1).cast("long")
    return rows.select(number.alias("task_id"), "name", "category", "link", "search_keyword", "search_location")


def place_parse_coords(t: Tables) -> DataFrame:
    return t.captures().select("rank", link_coordinates(F.col("link")).alias("at")).select("rank", "at.latitude", "at.longitude")


def place_parse_address(t: Tables) -> DataFrame:
    return parse_address_columns(t.captures().select("rank", "address_text"), "address_text").drop("address_text")


def place_parse_rating(t: Tables) -> DataFrame:
    box = F.col("rating_box_text")
    return t.captures().select(
        "rank", X.parse_rating(X.rating_text(box, F.lit(None).cast("string"))).alias("rating"), X.parse_rating(box).alias("raw_rating")
    )


def place_parse_reviews(t: Tables) -> DataFrame:
    box = F.col("rating_box_text")
    return t.captures().select(
        "rank", X.parse_reviews_count(X.reviews_text(box)).alias("reviews"), X.parse_reviews_count(box).alias("raw_reviews")
    )


def place_clean_text(t: Tables) -> DataFrame:
    return t["documents"].select("doc_id", X.clean_text(F.col("text")).alias("cleaned"))


def place_stars(t: Tables) -> DataFrame:
    bars = F.slice(F.array("b1", "b2", "b3", "b4", "b5"), 1, F.col("bars"))
    listed = t.bars().select("rank", bars.alias("texts"))
    return listed.select("rank", *[X.star_count(F.col("texts"), s).alias(f"star_{s}") for s in range(1, 6)])


def place_phone_fallback(t: Tables) -> DataFrame:
    return t.captures().select("rank", X.text_or_label(F.col("phone_text"), F.col("phone_aria")).alias("phone"))


def _place_columns(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, "name", "category", "address", "subdistrict", "district", "city", "province", "zip_code",
                     "latitude", "longitude", "rating", "reviews_count", "phone", "website", "link")


def place_assemble(t: Tables) -> DataFrame:
    return _place_columns(t.places(), "task_id", "rank")


def place_dedup_task(t: Tables) -> DataFrame:
    few = F.concat(F.lit("u"), (F.col("rank") % 70).cast("string"))  # links that a task meets again and again
    return P.first_per_link(t.places().withColumn("link", few)).select("task_id", "rank", "link", "name")


def _recurring(t: Tables) -> DataFrame:
    # few names at few positions, some of them at zero
    named = F.concat(F.lit("Shop "), (F.col("rank") % 40).cast("string"))
    lat = F.when(F.col("rank") % 5 == 0, 0.0).otherwise(F.col("latitude"))
    return t.places().withColumns({"name": named, "latitude": lat})


def place_dedup_global(t: Tables) -> DataFrame:
    return P.dedup_global(_recurring(t)).select("task_id", "rank", "name", "latitude", "longitude")


def place_duplicates(t: Tables) -> DataFrame:
    return P.duplicates(_recurring(t))


def place_duplicate_searches(t: Tables) -> DataFrame:
    tagged = _recurring(t).withColumns({
        "search_keyword": F.concat(F.lit("k"), F.col("task_id").cast("string")),
        "search_location": F.concat(F.lit("l"), (F.col("rank") % 3).cast("string")),
    })
    return P.duplicate_searches(tagged)


def merge_union(t: Tables) -> DataFrame:
    shops = t["customer"].select(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("category"))
    firms = t["supplier"].select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    return P.union_all([shops, firms, shops])


def _by_file(t: Tables) -> DataFrame:
    return _recurring(t).withColumn("source_file", F.concat(F.lit("task_"), F.col("task_id").cast("string"), F.lit(".csv")))


def merge_file_counts(t: Tables) -> DataFrame:
    return summary.file_counts(_by_file(t))


def merge_totals(t: Tables) -> DataFrame:
    return summary.merge_totals(_by_file(t))


def task_outcomes(t: Tables) -> DataFrame:
    planned = t["nation"].select(F.col("n_nationkey").cast("long").alias("task_id"), F.col("n_name").alias("keyword"))
    found = t["customer"].filter("c_acctbal > 0 AND c_nationkey % 6 <> 5").select(F.col("c_nationkey").cast("long").alias("task_id"))
    return P.task_outcomes(planned, found)


# ---- summaries


def summary_category_top10(t: Tables) -> DataFrame:
    """Some thirty values, one of them blank: it takes part in the cut and is hidden afterwards."""
    named = F.when(F.col("rank") % 13 == 0, "").otherwise(F.concat(F.lit("c"), (F.col("rank") * F.col("rank") % 29).cast("string")))
    return summary.top_categories(t.places("category").withColumn("category", named))


def summary_city(t: Tables) -> DataFrame:
    return summary.city_counts(t.places("city"))


def summary_district_top10(t: Tables) -> DataFrame:
    """More values than are kept, most of them equally frequent."""
    return summary.top_districts(t.places("district").withColumn("district", F.concat(F.lit("d"), (F.col("rank") % 23).cast("string"))))


def summary_overview(t: Tables) -> DataFrame:
    needed = ("rating", "phone", "website", "latitude", "longitude")
    return _round(summary.overview(t.places(*needed)), avg_rating=6, coords_pct=6)


def place_preview(t: Tables) -> DataFrame:
    return summary.preview(t.places("name", "city"), 50, "task_id", "rank")


# ---- coordinates


def coord_diagnose(t: Tables) -> DataFrame:
    return clean.diagnose(t.dirty()).select("ord", "code", "column", "n")


def coord_suggest(t: Tables) -> DataFrame:
    return clean.suggest_fixes(t.dirty()).select("ord", "code", "column", "suggestion")


def coord_profile(t: Tables) -> DataFrame:
    return _round(clean.profile(t.dirty()).select("column", "rows", "nulls", "numbers", "min", "max", "width"), min=6, max=6)


def _repaired(method: str, keep_sign: bool = False) -> Callable[[Tables], DataFrame]:
    def query(t: Tables) -> DataFrame:
        fixed = clean.repair(t.dirty(), method=method, keep_sign=keep_sign)
        # nine digits: averages of micro-degrees have exact ties at six
        return _round(fixed.select("row_id", "latitude", "longitude"), latitude=9, longitude=9)

    return query


def coord_clean(t: Tables) -> DataFrame:
    return _round(clean.quick_fix(t.dirty()).select("row_id", "latitude", "longitude"), latitude=6, longitude=6)


def coord_reject_counts(t: Tables) -> DataFrame:
    return clean.clean(t.dirty()).rejected


def coord_repair_only(t: Tables) -> DataFrame:
    return _round(clean.repair_only(t.dirty()).select("row_id", "latitude", "longitude"), latitude=6, longitude=6)


# ---- distance


def geo_distance(t: Tables) -> DataFrame:
    m = t.merchants()
    metres = haversine_m(F.lit(-6.2), F.lit(106.8), F.col("latitude"), F.col("longitude"))
    lat_tol, lon_tol = degree_tolerances(250.0, F.col("latitude"))
    return m.select("row_id", F.round(metres, 3).alias("metres"), F.round(lat_tol, 9).alias("lat_tol"), F.round(lon_tol, 9).alias("lon_tol"))


def neighbor_pairs(t: Tables) -> DataFrame:
    return _round(neighbors.neighbor_pairs(t.merchants(), 300.0), hav_m=3)


def neighbor_lists(t: Tables) -> DataFrame:
    return _round(neighbors.neighbors_of(t.merchants(), t.merchants(), 300.0), hav_m=3)


def neighbor_centres(t: Tables) -> DataFrame:
    """Neighbours of given centres: the merchants that the adaptive detector starts from, among all merchants."""
    centres = t.merchants().filter(F.col("row_id") % adaptive.SAMPLE_STEP == 0)
    return _round(neighbors.neighbors_of(centres, t.merchants(), 600.0), hav_m=3)


def neighbor_counts(t: Tables) -> DataFrame:
    return neighbors.neighbor_counts(t.merchants(), RADIUS)


def dense_merchants(t: Tables) -> DataFrame:
    """The ten merchants with most neighbours in each city."""
    counted = t.merchants().join(neighbors.neighbor_counts(t.merchants(), RADIUS), "row_id")
    order = Window.partitionBy("city").orderBy(F.desc("neighbors"), "row_id")
    ranked = counted.withColumn("place", F.row_number().over(order)).filter("place <= 10")
    return ranked.select("city", "place", "row_id", "name", "neighbors")


# ---- POIs


def poi_dbscan_membership(t: Tables) -> DataFrame:
    found = poi.detect_dbscan(t.merchants(), RADIUS, NEEDED).membership
    return _round(found.select("row_id", "poi_cluster", "distance_to_center"), distance_to_center=3)


def poi_dbscan_summary(t: Tables) -> DataFrame:
    return _rounded_pois(poi.detect_dbscan(t.merchants(), RADIUS, NEEDED).pois)


def poi_statistics(t: Tables) -> DataFrame:
    stats = poi.statistics(poi.detect_dbscan(t.merchants(), RADIUS, NEEDED))
    return _round(stats, coverage_percentage=6, avg_merchants_per_poi=6, std_merchants_per_poi=6, avg_max_distance=3,
                  avg_avg_distance=3)


def poi_coverage(t: Tables) -> DataFrame:
    return _round(poi.coverage(poi.detect_dbscan(t.merchants(), 300.0, NEEDED).membership), coverage_percentage=6)


def poi_map_layers(t: Tables) -> DataFrame:
    layers = poi.map_layers(poi.detect_dbscan(t.merchants(), RADIUS, NEEDED))
    return _round(layers, lat=6, lon=6)


def poi_adaptive(t: Tables) -> DataFrame:
    """Every merchant is a centre."""
    return _rounded_pois(adaptive.detect_adaptive(t.merchants(), 600.0, NEEDED, step=1).pois)


def poi_adaptive_membership(t: Tables) -> DataFrame:
    found = adaptive.detect_adaptive(t.merchants(), 600.0, NEEDED).membership
    return _round(found.select("row_id", "poi_cluster", "distance_to_center"), distance_to_center=3)


def poi_kmeans(t: Tables) -> DataFrame:
    return _rounded_pois(kmeans.detect_kmeans(t.merchants(), max_radius=350.0, min_merchants=NEEDED).pois)


def poi_kmeans_trim(t: Tables) -> DataFrame:
    """The trimming of given clusters: those of the merchants' nations."""
    labels = t.merchants().withColumn("_label", F.expr("CAST(substring(city, 8) AS INT)"))
    found = kmeans.trim(labels, 700.0, 60, "latitude", "longitude", "row_id")
    return found.select("row_id", F.col("poi_cluster").cast("int").alias("poi_cluster"))


def poi_sweep(t: Tables) -> DataFrame:
    return _round(sweep.sweep(t.merchants()), coverage=6)


def _lists(results: DataFrame) -> DataFrame:
    listed = [("most_pois", sweep.top(results, "pois_found", 10)), ("most_coverage", sweep.top(results, "coverage", 5)),
              ("best", sweep.best(results))]
    return P.union_all([df.withColumn("list", F.lit(name)) for name, df in listed])


def poi_sweep_top(t: Tables) -> DataFrame:
    """Every merchant is a centre of the adaptive detector."""
    return _round(_lists(materialize(sweep.sweep(t.merchants(), step=1))), coverage=6)


def _density_sweep(t: Tables) -> DataFrame:
    # without the column of errors, a detector that fails must not look like one without POIs
    return sweep.sweep(t.merchants(), methods=("DBSCAN", "Adaptive"), keep_errors=False).drop("error")


def poi_sweep_density(t: Tables) -> DataFrame:
    return _round(_density_sweep(t), coverage=6)


def poi_sweep_density_top(t: Tables) -> DataFrame:
    return _round(_lists(materialize(_density_sweep(t))), coverage=6)


def poi_solution(t: Tables) -> DataFrame:
    return _round(solution.solution_summary(solution.solve(t.dirty(), "row_id")), coverage_percentage=6, avg_merchants_per_poi=6,
                  std_merchants_per_poi=6, avg_max_distance=3, avg_avg_distance=3)


def poi_relaxed(t: Tables) -> DataFrame:
    found = solution.relaxed(t.merchants())
    return _rounded_pois(found[0].pois)


# ---- files and streams


def io_delimited(t: Tables) -> DataFrame:
    path = t.scratch()
    sinks.write_delimited(_place_columns(t.places(), "task_id", "rank"), path)
    return readers.as_places(readers.read_text_table(t.spark, path, sinks.DEFAULT_SEP)).withColumns(
        {"task_id": F.col("task_id").cast("long"), "rank": F.col("rank").cast("long")}
    )


def io_rerun(t: Tables) -> DataFrame:
    """Re-run lists as files whose header names have spaces around them."""
    rows, path = t.rerun().drop("source_file"), t.scratch()
    rows.select(*[F.col(c).alias(f" {c} ") for c in rows.columns]).write.options(
        header=True, escape='"', emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    read = readers.read_rerun(t.spark, path)
    return tasks.rerun_pairs(read).select("keyword", "location").distinct()


def io_final(t: Tables) -> DataFrame:
    """Both time-stamped results, read back: their rows, columns and names."""
    written = sinks.write_final(t.places(), t.scratch(), at=datetime(2024, 5, 6, 7, 8, 9))
    tables = [t.spark.read.parquet(written[0]), readers.as_places(readers.read_text_table(t.spark, written[1], sinks.RESULT_SEP))]
    return P.union_all([
        table.select(
            F.lit(path.rsplit("/", 1)[1]).alias("file"), F.lit(",".join(table.columns)).alias("columns"),
            "name", "category", "city", "zip_code", "phone", "link")
        for path, table in zip(written, tables)
    ])


def io_task_files(t: Tables) -> DataFrame:
    path = t.scratch()
    tagged = t.places().withColumns({"search_keyword": F.lit("toko/a b"), "search_location": F.concat(F.lit("x, "), F.col("task_id").cast("string"))})
    sinks.write_per_task(tagged, path)
    written = readers.read_text_table(t.spark, path, sinks.RESULT_SEP)
    return written.select("task_slug", "name", "link", "zip_code")


def io_named_files(t: Tables) -> DataFrame:
    """One file per task by its published name, read back with the name of the file."""
    path = t.scratch()
    tagged = t.places().withColumns({"search_keyword": F.lit("toko/a b"), "search_location": F.concat(F.lit("x, "), F.col("task_id").cast("string"))})
    task_writer.write_task_files(tagged, path)
    reader = t.spark.read.options(sep=sinks.RESULT_SEP, header=True, escape='"', multiLine=True)
    written = reader.csv(path).withColumn("file", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.csv$", 1))
    return written.select("file", "name", "link", "zip_code")


def _layouts(t: Tables) -> str:
    """Three task files with different columns, one of them with the published name of the link."""
    path, shops = t.scratch(), t["customer"]
    link = F.concat(F.lit("http://x/"), F.col("c_custkey").cast("string"))
    for name, part, columns in (
        ("task_a.csv", 0, [F.col("c_name").alias("name"), F.col("c_mktsegment").alias("category"),
                           link.alias("google_maps_link"), F.col("c_custkey").alias("reviews_count")]),
        ("task_b.csv", 1, [F.concat(F.lit("021-"), F.col("c_custkey").cast("string")).alias("phone"), link.alias("link"), F.col("c_name").alias("name")]),
        ("task_c.csv", 2, [F.col("c_name").alias("name"), F.col("c_nationkey").alias("extra")]),
    ):
        sinks.write_delimited(shops.filter(F.col("c_custkey") % 3 == part).select(*columns), f"{path}/{name}", sinks.RESULT_SEP)
    return path


def io_merge(t: Tables) -> DataFrame:
    rows = merge.merge_task_files(t.spark, _layouts(t)).places
    return rows.select("source_file", "name", "category", "link", "reviews_count", "phone", "extra")


def io_merge_counts(t: Tables) -> DataFrame:
    return merge.merge_task_files(t.spark, _layouts(t)).per_file


def io_merchants(t: Tables) -> DataFrame:
    path = t.scratch()
    t.dirty().drop("row_id").write.parquet(path)
    return readers.read_merchants(t.spark, path, "city", "district", "latitude", "longitude", fmt="parquet").agg(
        F.min("row_id").alias("first"), F.max("row_id").alias("last"), F.countDistinct("row_id").alias("numbers")
    )


def row_numbers(t: Tables) -> DataFrame:
    return with_row_id(t["orders"].select("o_orderkey", "o_totalprice"), F.desc("o_totalprice"), "o_orderkey")


def html_fields(t: Tables) -> DataFrame:
    return html.extract_fields(
        t["pages"], {"heading": "h1, title", "ad": "div.ad"}, {"first_link": ("a", "href"), "lang": ("html[lang]", "lang")}
    )


def html_panels(t: Tables) -> DataFrame:
    """Result panels with a link for each customer; every third one has cards without links only."""
    key = F.col("c_custkey").cast("string")
    card = F.when(F.col("c_nationkey") % 3 == 0, F.concat(F.lit('<div class="card Nv2PK"><a>'), key, F.lit("</a></div>"))).otherwise(
        F.concat(F.lit('<div class="Nv2PK"><a class="x hfpxzc" href="http://x/?a=1&amp;k='), key, F.lit('">'), key, F.lit("</a></div>")))
    panels = t["customer"].groupBy(F.col("c_nationkey").cast("long").alias("task_id"), (F.col("c_custkey") % 5).cast("int").alias("scroll_no")).agg(
        F.sort_array(F.collect_list(F.struct("c_custkey", card.alias("card")))).alias("cards"))
    page = F.concat(F.lit('<div role="feed">'), F.array_join("cards.card", "<hr>"), F.lit("</div>"))
    return html.observations_from_panels(panels.withColumn("html", page))


def html_captures(t: Tables) -> DataFrame:
    """Detail pages of customers, some without a phone and with the plain heading only."""
    key, name = F.col("c_custkey").cast("string"), F.col("c_name")
    pieces = [
        "<html><head><title>T</title><style>h1 {}</style></head><body>",
        F.when(F.col("c_custkey") % 4 == 0, F.concat(F.lit("<h1>"), name, F.lit("</h1>"))).otherwise(
            F.concat(F.lit("<h1>no</h1><h1 class='a DUwDvf'> "), name, F.lit(" <b>&amp; Co</b></h1>"))),
        "<div class='LBgpqf'><p><button>", F.lower("c_mktsegment"), "</button></p></div>",
        "<div class='F7nice'><span aria-hidden='true'>4,", (F.col("c_custkey") % 10).cast("string"), "</span> (", key, ")</div>",
        "<button data-item-id='address' aria-label='Address: ", key, " Street'>", key, " Street<script>no</script></button>",
        F.when(F.col("c_custkey") % 3 > 0, F.concat(F.lit("<button data-item-id='phone:tel' aria-label='Phone: 021-"), key, F.lit("'></button>"))).otherwise(""),
        "<a data-item-id='authority' href='http://w/", key, "'>w</a><table>",
        F.array_join(F.transform(F.sequence(F.lit(1), (F.col("c_custkey") % 7 + 1).cast("int")), lambda i: F.concat(
            F.lit("<tr class='BHOKXe'><td>"), i.cast("string"), F.lit("</td></tr>"))), ""), "</table></body></html>",
    ]
    pages = t["customer"].select(
        F.col("c_nationkey").cast("long").alias("task_id"), F.col("c_custkey").cast("int").alias("rank"),
        F.concat(F.lit("u"), key).alias("url"), F.concat(*[F.lit(x) if isinstance(x, str) else x for x in pieces]).alias("html"))
    return html.captures_from_pages(pages).select(
        "task_id", "rank", "link", "name_text", "category_text", "address_text", "rating_box_text", "rating_alt_text", "phone_aria", "website",
        F.array_join("address_aria", "|").alias("labels"), F.array_join("star_bar_texts", "|").alias("bars"))


def _capture_files(t: Tables) -> tuple[str, DataFrame]:
    path = t.scratch()
    t.captures().withColumn(
        "captured_at", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("rank") * 7)
    ).repartition(4).write.parquet(path)
    return path, t.spark.read.parquet(path)


def _drained(t: Tables, stream: DataFrame) -> DataFrame:
    out, progress = t.scratch(), t.scratch()
    incremental.append_to(stream, out, progress, once=True).awaitTermination()
    return t.spark.read.schema(stream.schema).parquet(out)


def stream_places(t: Tables) -> DataFrame:
    path, written = _capture_files(t)
    arriving = incremental.read_captures(t.spark, path, written.schema, files_per_trigger=1)
    return _place_columns(_drained(t, incremental.places(arriving)), "task_id", "rank")


def stream_dedup(t: Tables) -> DataFrame:
    path, written = _capture_files(t)
    arriving = incremental.places(incremental.read_captures(t.spark, path, written.schema))
    named = arriving.withColumn("name", F.concat(F.lit("Shop "), (F.col("rank") % 40).cast("string")))
    return _drained(t, incremental.dedup(named, "30 days")).select("name", "latitude", "longitude")


def stream_dedup_all_time(t: Tables) -> DataFrame:
    """Every identity once, though all places come again years later, in a stream that was stopped in between."""
    path, written = _capture_files(t)
    out, index, progress = t.scratch(), t.scratch(), t.scratch()
    for again in (False, True):
        if again:
            late = written.withColumn("captured_at", F.col("captured_at") + F.expr("INTERVAL 3 YEARS"))
            materialize(late).write.mode("append").parquet(path)
        arriving = incremental.places(incremental.read_captures(t.spark, path, written.schema, files_per_trigger=1))
        named = arriving.withColumn("name", F.concat(F.lit("Shop "), (F.col("rank") % 40).cast("string")))
        identity_index.dedup_all_time(named, out, index, progress, merge_every=3, once=True).awaitTermination()
    return identity_index.kept(t.spark, out, named.schema).select("name", "latitude", "longitude")


def stream_summary(t: Tables) -> DataFrame:
    """The running overview after every complete window; the last hour waits for its watermark."""
    path, written = _capture_files(t)
    later = written.limit(1).withColumn("captured_at", F.timestamp_seconds(F.lit(1_900_000_000)))
    later.write.mode("append").parquet(path)
    arriving = incremental.places(incremental.read_captures(t.spark, path, written.schema))
    windows = _drained(t, incremental.windowed_summary(arriving))
    return _round(incremental.running_summary(windows), avg_rating=6, coords_pct=6)


def stream_counts(t: Tables) -> DataFrame:
    """Running places per city, kept by upserts as four files arrive one by one."""
    path, written = _capture_files(t)
    arriving = incremental.read_captures(t.spark, path, written.schema, files_per_trigger=1)
    counts = incremental.running_counts(P.assemble(arriving, columns=("city",)), "city")
    out = t.scratch()
    incremental.upsert_to(counts, out, t.scratch(), once=True).awaitTermination()
    return incremental.latest(t.spark, out, counts.schema, "city")


def synthetic_merchants(t: Tables) -> DataFrame:
    """A synthetic merchant per customer."""
    made = samples.scattered(t["customer"].select(F.col("c_custkey").cast("long").alias("row_id")))
    return _round(made, latitude=9, longitude=9)


_PLAIN = [
    task_cross, task_from_table, task_form_locations, task_district, task_subdistrict, task_estimate, task_slug,
    rerun_pairs, rerun_tasks, validate_inputs, harvest_links, harvest_links_impatient, search_places, run_outcomes, run_task_files,
    place_parse_coords, place_parse_address, place_parse_rating, place_parse_reviews, place_clean_text, place_stars,
    place_phone_fallback, place_assemble, place_dedup_task, place_dedup_global, place_duplicates,
    place_duplicate_searches, merge_union, merge_file_counts, merge_totals, task_outcomes, summary_category_top10,
    summary_city, summary_district_top10, summary_overview, place_preview, coord_diagnose, coord_suggest,
    coord_profile, coord_clean, coord_reject_counts, coord_repair_only, geo_distance, neighbor_pairs, neighbor_lists, neighbor_centres,
    neighbor_counts, dense_merchants, poi_dbscan_membership, poi_dbscan_summary, poi_statistics, poi_coverage,
    poi_map_layers, poi_adaptive, poi_adaptive_membership, poi_kmeans, poi_kmeans_trim, poi_sweep, poi_sweep_top, poi_sweep_density,
    poi_sweep_density_top, poi_solution,
    poi_relaxed, io_delimited, io_rerun, io_final, io_task_files, io_named_files, io_merge, io_merge_counts, io_merchants, row_numbers, html_fields, html_panels, html_captures, stream_places, stream_dedup,
    stream_dedup_all_time, stream_summary, stream_counts, synthetic_merchants,
]


def _bind(query: Callable[[Tables], DataFrame]) -> Query:
    return lambda spark, folder: query(Tables(spark, folder))


def queries() -> dict[str, Query]:
    named = {q.__name__: _bind(q) for q in _PLAIN}
    named |= {f"coord_repair_{m}": _bind(_repaired(m)) for m in REPAIR_METHODS}
    named["coord_repair_signed"] = _bind(_repaired("first", keep_sign=True))
    return named


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded_pois(poi.detect_dbscan(Tables(spark, folder).merchants(), 500.0, 3).pois)
