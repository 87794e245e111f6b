import csv
import datetime
import io
import os
import random
import subprocess
import sys

import pandas as pd
import pytest
from pyspark.sql import functions as F

from placelab.operators import places as P
from placelab.plans import merge, run
from placelab.session import discard, materialize
from placelab.sources import html, readers, sinks, task_reader
from placelab.streaming import identity_index, incremental


def test_rows_of_one_file_are_read_by_many_tasks(spark, tmp_path):
    one = spark.range(400).coalesce(1).selectExpr(
        "id AS task_id", "CAST(id AS INT) AS rank", "'u' AS url", "concat('<h1>', id, '</h1>') AS html")
    pid = F.spark_partition_id().alias("part")
    assert html.captures_from_pages(one).select(pid).distinct().count() > 1
    assert html.extract_fields(one, {"t": "h1"}).select(pid).distinct().count() > 1
    one.select("task_id", "rank").write.parquet(f"{tmp_path}/in")
    arriving = incremental.read_captures(spark, f"{tmp_path}/in", one.select("task_id", "rank").schema, files_per_trigger=1)
    found = []
    arriving.writeStream.option("checkpointLocation", f"{tmp_path}/progress").trigger(availableNow=True).foreachBatch(
        lambda batch, number: found.append((batch.count(), batch.select(pid).distinct().count()))).start().awaitTermination()
    assert found[0][0] == 400 and found[0][1] > 1


def some_places(spark, n=6):
    captures = spark.range(n).select(
        (F.col("id") % 3).alias("task_id"), F.col("id").cast("int").alias("rank"),
        F.format_string("http://x/%d/@-6.%d1,106.5", "id", "id").alias("link"),
        F.concat(F.lit('Shop "|" \n~'), (F.col("id") % 2).cast("string")).alias("name_text"),
        F.lit("4.5 (1,234)").alias("rating_box_text"), F.lit("toko a").alias("search_keyword"),
        F.lit("Tebet, Jakarta").alias("search_location"),
        F.timestamp_seconds(F.col("id") * 600 + 1_700_000_000).alias("captured_at"),
    )
    return P.assemble(captures)


def test_delimited_round_trip(spark, tmp_path):
    wanted = some_places(spark).withColumn("name", F.concat("name", F.lit("\nline|two~")))
    sinks.write_delimited(P.result_columns(wanted), str(tmp_path / "out"))
    back = readers.as_places(readers.read_text_table(spark, str(tmp_path / "out"), "~", multi_line=True))
    key = lambda r: r.link
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, P.result_columns(wanted).collect()), key=str)
    assert sorted(back.collect(), key=key)[0].reviews_count == 1234


def test_task_files_and_merge(spark, tmp_path):
    """Files of any layout are united by name, also with the published header; broken ones are listed."""
    folder = tmp_path / "tasks"
    folder.mkdir()
    (folder / "task_001_a.csv").write_text("name|category|google_maps_link|reviews_count|zip_code\nA|c|u1|12.0|01234\nB||u2||\n")
    (folder / "task_002_b.csv").write_text('zip_code|link|name|extra\n99999|u3|"two\nlines"|x\n')
    (folder / "task_003_c.csv").write_text("name|link\nC|u4\nD\n")
    (folder / "task_004_d.csv").write_bytes(b"name|link\n\xff\xfe|u5\n")
    (folder / "task_005_e.csv").write_text("\n\n")
    (folder / "task_006_f.csv").write_text("name|link\nF|u6|more\n")
    (folder / "task_007_g.csv").write_text("name|link\n")
    (folder / "other.csv").write_text("name|link\nX|u\n")
    merged = merge.merge_task_files(spark, str(folder), str(tmp_path / "merged"))
    got = {(r.source_file, r.name, r.link, r.reviews_count, r.zip_code, r.extra) for r in merged.places.collect()}
    assert got == {
        ("task_001_a.csv", "A", "u1", 12, "01234", None), ("task_001_a.csv", "B", "u2", None, None, None),
        ("task_002_b.csv", "two\nlines", "u3", None, "99999", "x"), ("task_003_c.csv", "C", "u4", None, None, None),
        ("task_003_c.csv", "D", None, None, None, None)}
    assert sorted(r.places for r in merged.per_file.collect()) == [1, 2, 2]
    reasons = {r.source_file: r.reason for r in merged.skipped.collect()}
    assert set(reasons) == {"task_004_d.csv", "task_005_e.csv", "task_006_f.csv"} and "3 fields" in reasons["task_006_f.csv"]
    assert readers.read_text_table(spark, str(tmp_path / "merged"), "|", multi_line=True).count() == 5


def csv_rows(data, sep):
    lines = [r for r in csv.reader(io.StringIO(data.decode("utf-8-sig"), newline=""), delimiter=sep) if any(r)]
    return lines[0], lines[1:]


@pytest.mark.parametrize("size", [1, 7, 40, 1000])
def test_ranges_of_a_file_add_up_to_the_file(size):
    """Any cut at line ends gives the records of the whole file, whatever the quotes do."""
    rng = random.Random(size)
    for _ in range(300):
        data = "".join(rng.choices(['"', "|", "\n", "a", "b", "\r\n", '""', "é", '|"', '"|'], [2, 4, 4, 6, 2, 1, 1, 1, 2, 2], k=rng.randint(1, 80))).encode()
        lines, ranges, at = data.split(b"\n"), [], 0
        if not lines[-1]:
            lines.pop()
        for begin in range(0, len(lines), max(size // 5, 1)):
            some = lines[begin : begin + max(size // 5, 1)]
            ranges.append((at, some))
            at += sum(map(len, some)) + len(some)
        got = [r for start, some in ranges for r in task_reader.range_rows("f", start, some, "|")]
        ends = task_reader.resolved(pd.DataFrame([r for r in got if r[8] is not None], columns=[
            "path", "start", "seq", "inside", "fields", "head", "tail", "closed", "n", "problem"]), "|")
        files = list(ends.itertuples(index=False))
        chosen = {(r.start, bool(r.inside)) for r in files if r.n >= 0 and r.start >= 0}
        rows = [(r[1], r[2], r[4]) for r in got if r[8] is None and (r[3] is None or (r[1], r[3]) in chosen)]
        rows += [(r.start, r.seq, r.fields) for r in files if r.n == -1]
        wanted = [r for r in csv.reader(io.StringIO(data.decode() + "\n" * (not data.endswith(b"\n")), newline=""), delimiter="|") if any(r)]
        assert [f for *_, f in sorted(rows)] == wanted, data
        assert next(r for r in files if r.start == -1).n == len(wanted)


def test_large_task_files_are_read_in_splits(spark, tmp_path):
    """Quoted line breaks over split ends, a split without a quote's end, and a long row far behind the header."""
    folder = tmp_path / "tasks"
    folder.mkdir()
    rng = random.Random(4)
    for i in range(3):
        with open(folder / f"task_00{i}_x y+%41.csv", "w", newline="") as out:
            writer = csv.writer(out, delimiter="|")
            writer.writerow(["name", "link", f"extra{i}"])
            for j in range(200):
                writer.writerow([rng.choice(["a", 'q"uote', "two\nlines", "x\n" * rng.randint(0, 300), "", "é|"]), f"u{i}-{j}", "z" * rng.randint(0, 9)])
            if i == 2:
                out.write("a|b|c|d\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300b")
    try:
        found = readers.read_task_files(spark, str(folder))
        got = [(r.source_file, r.name, r.link, r.extra0, r.extra1) for r in found.rows.collect()]
        assert [(r.source_file, "4 fields" in r.reason) for r in found.skipped.collect()] == [("task_002_x y+%41.csv", True)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    wanted = []
    for i in range(2):
        for name, link, extra in csv_rows((folder / f"task_00{i}_x y+%41.csv").read_bytes(), "|")[1]:
            wanted.append((f"task_00{i}_x y+%41.csv", name or None, link, *[(extra or None) if k == i else None for k in range(2)]))
    key = lambda r: tuple(x or "" for x in r)
    assert sorted(got, key=key) == sorted(wanted, key=key)


def test_repeat_searches(spark):
    doubled = P.union_all([some_places(spark, 2), some_places(spark, 1)])
    found = merge.searches_to_repeat(doubled.select("name", "latitude", "longitude", "search_keyword", "search_location")).collect()
    assert [(r.keyword, r.location, r.max_results) for r in found] == [("toko a", "Tebet, Jakarta", 50)]
    assert merge.deduplicated(doubled, "task_id", "rank").count() == 2


def test_files_per_task_and_final(spark, tmp_path):
    sinks.write_per_task(some_places(spark), str(tmp_path / "t"))
    names = sorted(p.name for p in (tmp_path / "t").iterdir() if p.is_dir())
    assert names == [f"task_slug=task_00{i}_toko_a_Tebet_Jakarta" for i in range(3)]
    at = datetime.datetime(2024, 1, 2, 3, 4, 5)
    parquet, text = sinks.write_final(some_places(spark), str(tmp_path), at=at)
    assert parquet.endswith("final_results_20240102_030405.parquet") and spark.read.parquet(parquet).count() == 6
    assert sinks.write_final(P.empty_places(spark), str(tmp_path)) is None


def test_inputs(spark, tmp_path):
    (tmp_path / "k.csv").write_text('keyword\n"warung, kelontong"\ncafe\n')
    (tmp_path / "l.csv").write_text("district,city\nTebet,Jakarta\n")
    (tmp_path / "r.csv").write_text("search_keyword , search_location\n a ,b\n")
    (tmp_path / "m.csv").write_text("id,latitude,longitude\n2,1.5,2\n1,1,2\n")
    assert [r.keyword for r in readers.read_keywords(spark, str(tmp_path / "k.csv")).collect()] == ["warung, kelontong", "cafe"]
    assert readers.read_locations(spark, str(tmp_path / "l.csv")).first().subdistrict is None
    assert readers.read_rerun(spark, str(tmp_path / "r.csv")).columns == ["search_keyword", "search_location", "source_file"]
    assert [(r.id, r.row_id) for r in readers.read_merchants(spark, str(tmp_path / "m.csv"), "id").orderBy("row_id").collect()] == [("1", 0), ("2", 1)]


PAGE = """<html><head><title>T</title></head><body><h1 class="x">Toko <b>A</b></h1><h1 class="fontHeadlineLarge"> </h1>
<div class="F7nice">4,6 <span aria-hidden="true">4,6</span> (1.234)</div>
<button data-item-id="address" aria-label="Address: Jl. Braga 10, Bandung"></button>
<button data-item-id="phone:1" aria-label="Phone: 021-5"></button><a data-item-id="authority" href="http://a">w</a>
<table><tr class="BHOKXe"><td>5 stars</td></tr><tr class="BHOKXe"><td>none</td></tr></table>
<script>var x = "<h1>no</h1>";</script></body></html>"""


def test_html_captures(spark):
    pages = spark.createDataFrame([(1, 1, "http://x/@-6.5,106.5", PAGE), (1, 2, "y", None)], "task_id long, rank int, url string, html string")
    place = P.places_from_captures(html.captures_from_pages(pages)).collect()
    assert len(place) == 1
    p = place[0]
    assert (p.name, p.rating, p.reviews_count, p.phone, p.website, p.city) == ("Toko A", 4.6, 1234, "021-5", "http://a", "Bandung")
    assert (p.star_5, p.star_4, p.latitude) == (5, None, -6.5)


def test_html_panels_and_fields(spark):
    panel = '<div role="feed"><a class="hfpxzc" href="u1"></a><a class="b hfpxzc" href="u2"></a><div class="Nv2PK"></div></div>'
    df = spark.createDataFrame([(3, 0, panel)], "task_id long, scroll_no int, html string")
    assert [(r.pos, r.href) for r in html.observations_from_panels(df).orderBy("pos").collect()] == [(0, "u1"), (1, "u2")]
    got = html.extract_fields(df, {"t": 'div[role="feed"] a, div'}, {"u": ('a[href*="2"]', "href")}).first()
    assert got.t is None and got.u == "u2"


def test_deep_pages_take_linear_time():
    """Text is written once, stray ends are no search, and descendants need no walk to the root."""
    deep = 100_000
    page = html._Page('<p class="a">x' + "<div>y</i><span>" * deep + "z" + "</span></div>" * deep + "</p><b>w")
    assert len(page.elements) == 2 * deep + 2 and page.elements[0].text() == "x" + "y" * deep + "z"
    assert len(page.matching(html._parse("p.a div span"))) == len(page.matching(html._parse("div span"))) == deep
    assert len(page.matching(html._parse("span div"))) == deep - 1 and not page.matching(html._parse("p b"))


def test_descendants_equal_walking_up():
    rng = random.Random(1)
    for _ in range(200):
        parts = [rng.choice(["<a>", "<b class='k'>", "<div>", "</a>", "</b>", "</div>", "<br>", "t", "<title>", "</title>"]) for _ in range(30)]
        page = html._Page("".join(parts))
        inside = lambda e: [o for o in page.elements if o.at < e.at <= o.last]
        wanted = [e for e in page.elements if e.tag == "a" and any(
            o.tag == "div" and any(u.attrs.get("class") == "k" for u in inside(o)) for o in inside(e))]
        assert page.matching(html._parse("b.k div a")) == wanted


def drain(spark, stream, tmp_path, name):
    out = str(tmp_path / name)
    incremental.append_to(stream, out, str(tmp_path / f"{name}_progress"), once=True).awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def test_streams_equal_batch(spark, tmp_path):
    captures = spark.range(40).select(
        (F.col("id") % 3).alias("task_id"), F.col("id").cast("int").alias("rank"), F.format_string("u%d/@-6.5,106.%d", "id", F.col("id") % 4).alias("link"),
        F.concat(F.lit("Shop "), (F.col("id") % 5).cast("string")).alias("name_text"), F.lit("4.5 (7)").alias("rating_box_text"),
        F.timestamp_seconds(F.col("id") * 60 + 1_700_000_000).alias("captured_at"))
    path = str(tmp_path / "in")
    captures.repartition(4).write.parquet(path)
    written = spark.read.parquet(path)
    arriving = lambda: incremental.places(incremental.read_captures(spark, path, written.schema, files_per_trigger=1))
    batch = P.assemble(written)
    got = drain(spark, arriving(), tmp_path, "places")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, batch.collect()), key=str)
    names = drain(spark, incremental.dedup(arriving(), "1 day"), tmp_path, "dedup")
    assert names.count() == P.dedup_global(batch).count() == 20
    # a much later row moves the watermark past the others
    written.limit(1).withColumn("captured_at", F.timestamp_seconds(F.lit(1_900_000_000))).write.mode("append").parquet(path)
    late = incremental.places(incremental.read_captures(spark, path, written.schema))
    windows = drain(spark, incremental.windowed_summary(late), tmp_path, "windows")
    total = incremental.running_summary(windows).first()
    assert total.total_places == 40 and total.avg_rating == 4.5 and total.coords_pct == 100.0


def test_running_counts_survive_replays(spark, tmp_path):
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "k string"
    progress = str(tmp_path / "progress")
    for keys in (["a", "b", "a", None], ["a", "c"]):
        spark.createDataFrame([(k,) for k in keys], schema).coalesce(1).write.mode("append").parquet(path)
        stream = incremental.running_counts(spark.readStream.schema(schema).parquet(path), "k")
        incremental.upsert_to(stream, out, progress, once=True).awaitTermination()
    read = lambda: sorted(map(tuple, incremental.latest(spark, out, stream.schema, "k").collect()))
    assert read() == [("a", 3), ("b", 1), ("c", 1)]
    last = sorted((tmp_path / "progress" / "commits").glob("[0-9]*"))[-1]
    (last.parent / f".{last.name}.crc").unlink(missing_ok=True)
    last.unlink()  # as if the job had died between writing and committing its last batch
    incremental.upsert_to(stream, out, progress, once=True).awaitTermination()
    assert read() == [("a", 3), ("b", 1), ("c", 1)]


def uncommit(progress):
    """As if the job had died between writing and committing its last batch."""
    last = sorted((progress / "commits").glob("[0-9]*"), key=lambda f: int(f.name))[-1]
    (last.parent / f".{last.name}.crc").unlink(missing_ok=True)
    last.unlink()


def test_dedup_over_all_time(spark, tmp_path):
    path, out, index, progress = (str(tmp_path / n) for n in ("in", "out", "index", "progress"))
    schema = "task_id long, rank int, name string, latitude double, longitude double"
    rows = [(i, j, f"n{(i * 3 + j) % 9}", [1.0, 0.0, None][j % 3], 2.0) for i in range(8) for j in range(5)] + [(7, 9, "late", None, None)]
    whole = spark.createDataFrame(rows, schema)
    wanted = sorted(map(tuple, P.dedup_global(whole).collect()), key=str)
    read = lambda: sorted(map(tuple, identity_index.kept(spark, out, whole.schema).collect()), key=str)
    os.mkdir(path)
    arriving = spark.readStream.schema(schema).parquet(path)
    for i in range(8):  # one batch per task, in order, so that the first arrival is the first by task
        whole.filter(F.col("task_id") == i).coalesce(1).write.mode("append").parquet(path)
        work = lambda: identity_index.dedup_all_time(arriving, out, index, progress, buckets=4, merge_every=3, once=True).awaitTermination()  # noqa: E731, B023
        work()
        if i in (3, 4, 6):  # the batch that merges, the one after it, which removes what was merged, and the next merge
            uncommit(tmp_path / "progress")
            work()
    assert read() == wanted
    assert sorted(f.name for f in (tmp_path / "index").iterdir()) == ["batch-7", "merged-6"]


def test_a_whole_run(spark, tmp_path):
    keywords, locations, out = tmp_path / "k.csv", tmp_path / "l.csv", str(tmp_path / "out")
    keywords.write_text("keyword\nzoo\nbank\n")
    locations.write_text("subdistrict,district,city\nSenayan,Kebayoran Baru,Jakarta\n,Tebet,Jakarta\n")
    seen = spark.createDataFrame([(t, 0, p, f"u{p}") for t in (0, 1, 3) for p in range(3)], "task_id long, scroll_no int, pos int, href string")
    captures = spark.createDataFrame(
        [(t, p, f"u{p}", f"Shop {p}", "", "") for t in (0, 1, 3) for p in range(3)],
        "task_id long, rank int, link string, name_text string, search_keyword string, search_location string")
    errors = spark.createDataFrame([(1, "timeout"), (1, "again")], "task_id long, error string")
    options = sinks.OutputOptions(output_dir=out, max_results=2)
    done = run.run_search(spark, str(keywords), str(locations), seen, captures, errors, options)
    got = [(r.task_id, r.keyword, r.location, r.places_found, r.status, r.error) for r in done.outcomes.orderBy("task_id").collect()]
    assert got == [
        (0, "zoo", "Senayan, Kebayoran Baru, Jakarta", 2, "found", None), (1, "zoo", "Tebet, Jakarta", 0, "failed", "again"),
        (2, "bank", "Senayan, Kebayoran Baru, Jakarta", 0, "empty", None), (3, "bank", "Tebet, Jakarta", 2, "found", None)]
    names = sorted(f for f in os.listdir(out) if f.startswith("task_"))
    assert names == ["task_000_zoo_Senayan_Kebayoran_Baru_Jakarta.csv", "task_003_bank_Tebet_Jakarta.csv"]
    assert merge.merge_task_files(spark, out).places.count() == spark.read.parquet(done.final[0]).count() == 4
    keywords.write_text("word\nzoo\n")
    with pytest.raises(ValueError, match="'keyword' column"):
        run.planned_tasks(spark, str(keywords), str(locations), 5)
    keywords.write_text("keyword\nzoo\n")
    nothing = run.run_search(spark, str(keywords), str(locations), seen.limit(0), captures, options=options)
    assert nothing.final is None and {r.status for r in nothing.outcomes.collect()} == {"empty"}


def test_rows_are_numbered_in_the_order_of_the_file(spark, tmp_path):
    values = [f"w{(i * 7919) % 5000:05d}" for i in range(5000)]
    (tmp_path / "k.csv").write_text("keyword\n" + "\n".join(values) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")  # many splits of one file
    try:
        rows = readers.in_file_order(readers.read_keywords(spark, str(tmp_path / "k.csv"))).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [r.keyword for r in sorted(rows, key=lambda r: r.pos)] == values and {r.pos for r in rows} == set(range(5000))


def test_materialized_tables_are_read_back_and_removed(spark):
    table = materialize(spark.range(5))
    assert table.count() == 5
    discard(table)
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist|FAILED_READ_FILE"):
        spark.read.parquet(table._placelab_path).count()


def test_workers_need_no_path_to_the_package(tmp_path):
    """Started in another folder, with the path set in the driver only."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    script = f"""
import sys
sys.path.insert(0, {root!r})
from placelab.session import discard_all, local_session, materialize
from placelab.sources import html
spark = local_session("elsewhere", cores="1")
page = spark.createDataFrame([(1, "<h1>x</h1>")], "page_id int, html string")
print("GOT", materialize(html.extract_fields(page, {{"t": "h1"}})).first().t)
discard_all(spark)
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=180)
    assert "GOT x" in done.stdout, done.stderr[-2000:]


def test_one_named_file_per_task(spark, tmp_path):
    from placelab.sources.task_writer import write_task_files

    rows = [(1, r, f"n {r}|\"q\"", "u", "kw one", "loc, a") for r in (3, 1, 2)] + [(2, 1, "x", "v", "kw", "b"), (12, 1, None, "w", "k", "c")]
    schema = "task_id long, rank int, name string, link string, search_keyword string, search_location string"
    places = P.assemble(spark.createDataFrame(rows, schema).withColumnRenamed("name", "name_text")).repartition(3)
    out = str(tmp_path / "results")
    write_task_files(places, out)
    files = sorted(f.name for f in (tmp_path / "results").iterdir())
    assert len(files) == 2 and files[0].startswith("task_001_kw_one") and all(f.endswith(".csv") for f in files)
    back = spark.read.options(sep="|", header=True, escape='"', multiLine=True).csv(f"{out}/{files[0]}")
    assert [r.name for r in back.collect()] == ['n 1|"q"', 'n 2|"q"', 'n 3|"q"']
    with pytest.raises(Exception, match="there already"):
        write_task_files(places, out)
    assert sorted(f.name for f in (tmp_path / "results").iterdir()) == files  # nothing of the failed job is left
    write_task_files(places, out, mode="overwrite")
    failing = places.withColumn("name", F.when(F.col("rank") == 3, F.raise_error(F.lit("bad"))).otherwise(F.col("name")))
    with pytest.raises(Exception, match="bad"):
        write_task_files(failing, str(tmp_path / "none"))
    left = tmp_path / "none"
    assert not left.exists() or not any(left.rglob("*.csv"))
