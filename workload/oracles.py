"""Equivalent SQL for the queries, written independently of the Spark code."""

from __future__ import annotations

from functools import partial

from placelab.functions.address import CITIES, PROVINCES
from placelab.gazetteer import DISTRICTS, SUBDISTRICTS
from placelab.operators.clean import SUGGESTIONS
from workload import views

NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def with_views(body: str, *names: str, recursive: bool = False) -> str:
    texts = {
        "merchants": views.MERCHANTS, "captures": views.CAPTURES, "observations": views.OBSERVATIONS,
        "keywords": views.KEYWORDS, "locations": views.LOCATIONS, "dirty": views.DIRTY_MERCHANTS,
        "rerun": views.RERUN, "bars": views.BARS, "event_captures": views.EVENT_CAPTURES,
        "event_tasks": views.EVENT_TASKS,
    }
    ctes = ", ".join(f"{n} AS ({texts[n]})" for n in names)
    sep = ", " if body.lstrip().startswith("+") else " "
    return f"WITH {'RECURSIVE ' if recursive else ''}{ctes}{sep}{body.lstrip().lstrip('+')}"


# ---- planning

_PARTS = f"""
 located AS (SELECT pos, nullif({strip('subdistrict')}, '') AS s0, nullif({strip('district')}, '') AS d0, nullif({strip('city')}, '') AS c0, {strip('location')} AS single FROM locations),
 loc AS (SELECT pos, coalesce(nullif(concat_ws(', ', s, d, c), ''), single, '') AS location, coalesce(s, '') AS subdistrict, coalesce(d, '') AS district, coalesce(c, '') AS city
  FROM (SELECT pos, single, CASE WHEN lower(s0) = 'nan' THEN NULL ELSE s0 END AS s, CASE WHEN lower(d0) = 'nan' THEN NULL ELSE d0 END AS d, CASE WHEN lower(c0) = 'nan' THEN NULL ELSE c0 END AS c FROM located) x)
"""

_CROSS = """
SELECT k.pos * (SELECT count(*) FROM loc) + l.pos AS task_id, k.keyword, l.location, l.subdistrict, l.district, l.city,
 CAST(1000 AS INTEGER) AS max_results, k.keyword || ' ' || l.location AS query FROM keywords k, loc l
"""


def _listed(names: list[str], column: str) -> str:
    return "(VALUES " + ", ".join(f"({i}, '{n}')" for i, n in enumerate(names)) + f") v(pos, {column})"


def _task_oracles() -> dict[str, str]:
    district, city = "Kebayoran Baru", "Jakarta Selatan"
    plain = "+loc AS (SELECT n_nationkey AS pos, n_name AS location, '' AS subdistrict, '' AS district, '' AS city FROM nation)"
    form = ("+loc AS (SELECT pos, CASE WHEN subdistrict IS NOT NULL THEN concat_ws(', ', subdistrict, district, city) "
            "ELSE concat_ws(', ', district, city) END AS location, '' AS subdistrict, '' AS district, '' AS city FROM locations)")
    by_district = (f"+loc AS (SELECT pos, name || ', {city}' AS location, '' AS subdistrict, name AS district, '{city}' AS city "
                   f"FROM {_listed(DISTRICTS[city], 'name')})")
    by_subdistrict = (f"+loc AS (SELECT pos, name || ', {district}, {city}' AS location, name AS subdistrict, '{district}' AS district, '{city}' AS city "
                      f"FROM {_listed(SUBDISTRICTS[district], 'name')})")
    estimate = ("SELECT count(DISTINCT keyword) AS keywords, count(DISTINCT location) AS locations, count(*) AS tasks, "
                "count(*) * 15.0E0 / 4 AS est_seconds, CAST(sum(max_results) AS BIGINT) AS max_places FROM t")
    slug = ("SELECT task_id, 'task_' || CASE WHEN task_id < 1000 THEN lpad(CAST(task_id AS VARCHAR), 3, '0') ELSE CAST(task_id AS VARCHAR) END || '_' || "
            "replace(replace(keyword, ' ', '_'), '/', '_') || '_' || replace(replace(replace(location, ' ', '_'), ',', ''), '/', '_') AS task_slug, "
            "keyword || ' in ' || location AS label FROM t")
    pairs = f"""SELECT DISTINCT source_file, {strip('search_keyword')} AS keyword, {strip('search_subdistrict')} AS s, {strip('search_district')} AS d, {strip('search_region')} AS r FROM rerun"""
    listed = "SELECT source_file, keyword, concat_ws(', ', nullif(s, ''), nullif(d, ''), nullif(r, '')) AS location FROM p"
    valid_names = "'Valid (with subdistrict column)'"
    validate = f"""SELECT 'keywords' AS input, count(*) > 0 AS ok, CASE WHEN count(*) > 0 THEN 'Valid' ELSE 'the keyword table is empty' END AS message FROM keywords
 UNION ALL SELECT 'keywords_renamed', false, 'a ''keyword'' column is needed'
 UNION ALL SELECT 'keywords_empty', count(*) > 0, CASE WHEN count(*) > 0 THEN 'Valid' ELSE 'the keyword table is empty' END FROM keywords WHERE keyword IS NULL
 UNION ALL SELECT 'locations', count(*) > 0, CASE WHEN count(*) > 0 THEN {valid_names} ELSE 'the location table is empty' END FROM locations
 UNION ALL SELECT 'locations_no_city', false, 'columns district and city are needed; missing: city'
 UNION ALL SELECT 'locations_plain', count(*) > 0, CASE WHEN count(*) > 0 THEN 'Valid (without subdistrict, district only)' ELSE 'the location table is empty' END FROM locations"""
    return {
        "task_cross": with_views(plain + _CROSS, "keywords"),
        "task_from_table": with_views("+" + _PARTS + _CROSS, "keywords", "locations"),
        "task_form_locations": with_views(form + _CROSS, "keywords", "locations"),
        "task_district": with_views(by_district + _CROSS, "keywords"),
        "task_subdistrict": with_views(by_subdistrict + _CROSS, "keywords"),
        "task_estimate": with_views("+" + _PARTS + f", t AS ({_CROSS}) " + estimate, "keywords", "locations"),
        "task_slug": with_views("+" + _PARTS + f", t AS ({_CROSS}) " + slug, "keywords", "locations"),
        "io_rerun": with_views(f"+p AS ({pairs}) SELECT DISTINCT keyword, location FROM ({listed}) x", "rerun"),
        "rerun_pairs": with_views(f"+p AS ({pairs}) {listed}", "rerun"),
        "rerun_tasks": with_views(
            f"+p AS ({pairs}), l AS ({listed}) SELECT row_number() OVER (ORDER BY source_file, keyword, location) - 1 AS task_id, keyword, location, "
            "CAST(150 AS INTEGER) AS max_results, keyword || ' ' || location AS query FROM l", "rerun"),
        "validate_inputs": with_views(validate, "keywords", "locations"),
    }


# ---- harvest


def _harvest(max_scrolls: int, patience: int) -> str:
    return f"""
 first_seen AS (SELECT task_id, href, scroll_no, pos FROM (
   SELECT *, row_number() OVER (PARTITION BY task_id, href ORDER BY scroll_no, pos) AS rn FROM observations
   WHERE scroll_no < {max_scrolls} AND href IS NOT NULL AND href <> '') x WHERE rn = 1),
 fresh AS (SELECT DISTINCT task_id, scroll_no FROM first_seen),
 stops AS (SELECT f.task_id, min(f.scroll_no) AS stop FROM fresh f WHERE f.scroll_no >= {patience} AND NOT EXISTS (
   SELECT 1 FROM fresh g WHERE g.task_id = f.task_id AND g.scroll_no < f.scroll_no AND g.scroll_no >= f.scroll_no - {patience})
   GROUP BY f.task_id),
 links AS (SELECT f.task_id, CAST(row_number() OVER (PARTITION BY f.task_id ORDER BY f.scroll_no, f.pos) AS INTEGER) AS rank, f.href, f.scroll_no, f.pos
   FROM first_seen f LEFT JOIN stops s ON s.task_id = f.task_id WHERE s.stop IS NULL OR f.scroll_no < s.stop)
"""


def _harvest_oracles() -> dict[str, str]:
    listed = "SELECT task_id, rank, href, scroll_no, pos FROM links WHERE rank <= {}"
    found = f"""
 , kept AS (SELECT l.task_id, l.rank, l.href AS link, {strip('c.name_text')} AS name, {strip('c.category_text')} AS category,
   t.keyword AS search_keyword, t.location AS search_location
  FROM links l JOIN event_tasks t ON t.task_id = l.task_id JOIN event_captures c ON c.task_id = l.task_id AND c.link = l.href
  WHERE l.rank <= t.max_results AND c.name_text IS NOT NULL AND c.name_text NOT IN ('', 'Hasil', 'Results'))
 SELECT * FROM kept WHERE length(name) > 0
"""
    filled = {c: f"nullif({c}, '')" for c in ("subdistrict", "district", "city")}
    run = f"""+loc AS (SELECT pos, concat_ws(', ', {filled['subdistrict']}, {filled['district']}, {filled['city']}) AS location,
  '' AS subdistrict, '' AS district, '' AS city FROM locations), tasks AS ({_CROSS}), {_harvest(10, 3)},
 found AS (SELECT l.task_id, l.href AS link, {strip('c.name_text')} AS name, {strip('c.category_text')} AS category
  FROM links l JOIN event_captures c ON c.task_id = l.task_id AND c.link = l.href
  WHERE l.rank <= 50 AND l.task_id % 11 <> 3 AND c.name_text IS NOT NULL AND c.name_text NOT IN ('', 'Hasil', 'Results')),
 kept AS (SELECT * FROM found WHERE length(name) > 0)
"""
    outcomes = """, counted AS (SELECT task_id, count(*) AS n FROM kept GROUP BY task_id),
 failed AS (SELECT DISTINCT user_id AS task_id FROM events WHERE user_id % 11 = 3)
 SELECT t.task_id, keyword, location, coalesce(n, 0) AS places_found,
  CAST(sum(coalesce(n, 0)) OVER (ORDER BY t.task_id) AS BIGINT) AS running_total,
  CASE WHEN f.task_id IS NOT NULL THEN 'timeout' END AS error,
  CASE WHEN f.task_id IS NOT NULL THEN 'failed' WHEN n IS NULL THEN 'empty' ELSE 'found' END AS status
 FROM tasks t LEFT JOIN counted c ON c.task_id = t.task_id LEFT JOIN failed f ON f.task_id = t.task_id"""
    files = """ SELECT t.task_id, name, category, link, keyword AS search_keyword, nullif(location, '') AS search_location
 FROM kept k JOIN tasks t ON t.task_id = k.task_id"""
    inputs = ("keywords", "locations", "observations", "event_captures")
    return {
        "run_outcomes": with_views(run + outcomes, *inputs),
        "run_task_files": with_views(run + files, *inputs),
        "harvest_links": with_views("+" + _harvest(10, 3) + listed.format(40), "observations"),
        "harvest_links_impatient": with_views(
            f"+sparse AS ({views.SPARSE_OBSERVATIONS}), " + _harvest(200, 1).replace("FROM observations", "FROM sparse") + listed.format(1000),
            "observations"),
        "search_places": with_views("+" + _harvest(10, 3) + found, "observations", "event_captures", "event_tasks"),
    }


# ---- capture to place


def _contains_first(lowered: str, names: list[str]) -> str:
    return "CASE " + " ".join(f"WHEN contains({lowered}, '{n.lower()}') THEN '{n}'" for n in names) + " END"


def _ex(column: str, pattern: str, group: int = 0) -> str:
    return f"nullif(regexp_extract({column}, '{pattern}', {group}), '')"


_END = r"(?:,|\n|$)"
_CITY_NAMES = "Jakarta|Bandung|Surabaya|Medan|Semarang|Makassar|Palembang|Tangerang|Depok|Bekasi|Bogor"

ADDRESS = f"""
 named AS (SELECT *, nullif(address_text, '') AS a, lower(nullif(address_text, '')) AS low FROM captures),
 parts1 AS (SELECT *,
   {_ex('a', r'\b\d{5}\b')} AS zip_code,
   {_contains_first('low', sorted(PROVINCES, key=len, reverse=True))} AS province,
   coalesce(nullif(trim(coalesce({_ex('a', r'(?i)(?:Kota|Kab\.|Kabupaten)\s+([^,\n]+?)' + _END, 1)},
     {_ex('a', r'(?i)(?:' + _CITY_NAMES + r')\s+(?:Selatan|Utara|Barat|Timur|Pusat|Kota)?')})), ''), {_contains_first('low', CITIES)}) AS city,
   trim(coalesce({_ex('a', r'(?i)(?:Kecamatan|Kec\.)\s+([^,\n]+?)' + _END, 1)}, {_ex('a', r'(?i)(?:Kec\.?)\s+([A-Z][a-zA-Z\s]+?)' + _END, 1)})) AS district,
   nullif(trim(coalesce({_ex('a', r'(?i)(?:Kelurahan|Kel\.)\s+([^,\n]+?)' + _END, 1)}, {_ex('a', r'(?i)(?:Desa)\s+([^,\n]+?)' + _END, 1)})), '') AS marked
  FROM named),
 exploded AS (SELECT rank, ord, trim(part) AS p FROM (SELECT rank, unnest(string_split(a, ',')) AS part, generate_subscripts(string_split(a, ','), 1) AS ord FROM parts1 WHERE a IS NOT NULL) x),
 usable AS (SELECT e.rank, e.ord, e.p, c.district, strpos(c.a, e.p) < strpos(c.a, c.district) AS early FROM exploded e JOIN parts1 c ON c.rank = e.rank
   WHERE length(e.p) > 3 AND NOT coalesce(contains(lower(e.p), lower(nullif(c.city, ''))), false) AND NOT coalesce(contains(lower(e.p), lower(c.province)), false)
    AND NOT regexp_matches(e.p, '(?i)\\b(Kota|Kabupaten|Kab\\.)\\b') AND NOT regexp_matches(e.p, '^\\d{{5}}$')
    AND NOT regexp_matches(e.p, '(?i)^(Jl\\.?|Jalan|Gang|Gg\\.)') AND NOT regexp_matches(e.p, '(?i)\\b(Kecamatan|Kec\\.)\\b') AND NOT regexp_matches(e.p, '\\d{{2,}}')),
 inferred AS (SELECT rank, coalesce(first(p ORDER BY ord) FILTER (WHERE early), first(p ORDER BY ord)) AS guess FROM usable GROUP BY rank),
 parts AS (SELECT c.*, coalesce(c.marked, i.guess) AS subdistrict FROM parts1 c LEFT JOIN inferred i ON i.rank = c.rank)
"""

_LAT = r"coalesce(try_cast(nullif(regexp_extract(link, '!8m2!3d(-?\d+\.\d+)!4d(-?\d+\.\d+)', {g}), '') AS DOUBLE), try_cast(nullif(regexp_extract(link, '@(-?\d+\.\d+),(-?\d+\.\d+)', {g}), '') AS DOUBLE))"
LATITUDE, LONGITUDE = _LAT.replace("{g}", "1"), _LAT.replace("{g}", "2")


def _rating(text: str) -> str:
    dotted = f"replace({text}, ',', '.')"
    one = f"try_cast(nullif(regexp_extract({dotted}, '\\d+\\.\\d+'), '') AS DOUBLE)"
    two = f"try_cast(nullif(regexp_extract({dotted}, '\\d+'), '') AS DOUBLE)"
    return f"CASE WHEN {one} BETWEEN 0 AND 5 THEN {one} WHEN {two} BETWEEN 0 AND 5 THEN {two} END"


def _reviews(text: str) -> str:
    bare = f"replace(replace(replace(replace(lower({text}), 'reviews', ''), 'review', ''), '(', ''), ')', '')"
    digits = f"translate(regexp_replace({strip(bare)}, '[^\\d,.\\s]', '', 'g'), ',. ', '')"
    return f"CASE WHEN regexp_matches({digits}, '^[0-9]+$') THEN try_cast({digits} AS BIGINT) END"


_BOX_RATING = r"replace(nullif(regexp_extract(rating_box_text, '\d+[.,]\d+'), ''), ',', '.')"
_BOX_REVIEWS = r"nullif(regexp_extract(rating_box_text, '\(([0-9.,\s]+)\)', 1), '')"
_PHONE = r"coalesce(nullif(phone_text, ''), CASE WHEN contains(phone_aria, ':') THEN trim(regexp_extract(phone_aria, ':(.*)$', 1)) END)"

PLACES = ADDRESS + f"""
 , places AS (SELECT task_id, rank, name_text AS name, category_text AS category, address_text AS address, subdistrict, district, city, province, zip_code,
   {LATITUDE} AS latitude, {LONGITUDE} AS longitude, {_rating(_BOX_RATING)} AS rating, {_reviews(_BOX_REVIEWS)} AS reviews_count,
   {_PHONE} AS phone, website, link
  FROM parts WHERE name_text IS NOT NULL AND name_text NOT IN ('', 'Hasil', 'Results') AND link IS NOT NULL)
"""

RECURRING = PLACES + """
 , recurring AS (SELECT task_id, rank, 'Shop ' || CAST(rank % 40 AS VARCHAR) AS name, CASE WHEN rank % 5 = 0 THEN 0.0E0 ELSE latitude END AS latitude, longitude FROM places),
 keyed AS (SELECT *, CASE WHEN latitude <> 0 AND longitude <> 0 THEN latitude END AS key_lat, CASE WHEN latitude <> 0 AND longitude <> 0 THEN longitude END AS key_lon FROM recurring)
"""


def _first_int(x: str) -> str:
    return f"try_cast(nullif(regexp_extract({x}, '\\d+'), '') AS INTEGER)"


def _from_places(body: str) -> str:
    return with_views("+" + PLACES + body, "captures")


def _from_keyed(body: str) -> str:
    return with_views("+" + RECURRING + body, "captures")


def _unescaped(text: str) -> str:
    """Text of markup without inner tags; the entities that the pages use."""
    for entity, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#x27;", "''"), ("&amp;", "&")):
        text = f"replace({text}, '{entity}', '{sign}')"
    return f"nullif(trim({text}), '')"


def _synthetic() -> str:
    def uniform(stream: str) -> str:
        return f"((CAST(('0x' || substr(md5('42:{stream}:' || CAST(row_id AS VARCHAR)), 1, 13)) AS BIGINT) + 0.5E0) / 4503599627370496.0E0)"

    def normal(stream: str) -> str:
        return f"sqrt(-2 * ln({uniform(stream + 'a')})) * cos(2 * pi() * {uniform(stream + 'b')})"

    lats, lons = "[-6.2088E0, -6.2100E0, -6.2050E0]", "[106.8456E0, 106.8500E0, 106.8400E0]"
    spread, place = "CASE WHEN spot < 3 THEN 0.005E0 ELSE 0.02E0 END", "CASE WHEN spot < 3 THEN spot + 1 ELSE 1 END"
    return f"""WITH rows AS (SELECT CAST(c_custkey AS BIGINT) AS row_id, CAST(floor(c_custkey / 115) AS BIGINT) AS spot FROM customer)
SELECT row_id, round({lats}[{place}] + {normal('lat')} * {spread}, 9) AS latitude, round({lons}[{place}] + {normal('lon')} * {spread}, 9) AS longitude,
 'M_' || CASE WHEN row_id < 10000 THEN lpad(CAST(row_id AS VARCHAR), 4, '0') ELSE CAST(row_id AS VARCHAR) END AS merchant_id, 'Jakarta' AS city,
 'District_' || CAST(CAST(floor({uniform('district')} * 3) AS BIGINT) + 1 AS VARCHAR) AS district,
 'Subdistrict_' || CAST(CAST(floor({uniform('subdistrict')} * 9) AS BIGINT) + 1 AS VARCHAR) AS subdistrict FROM rows"""


def _place_oracles() -> dict[str, str]:
    stars = ", ".join(f"CASE WHEN bars >= {6 - s} THEN {_first_int(f'b{6 - s}')} END AS star_{s}" for s in range(1, 6))
    counts = "SELECT {c}, places FROM (SELECT {c}, count(*) AS places FROM places WHERE {c} IS NOT NULL GROUP BY {c}{cut}) x WHERE {c} <> ''"
    overview = """SELECT count(*) AS total_places, round(avg(rating), 6) AS avg_rating, count(rating) AS rated_places, count(phone) AS with_phone, count(website) AS with_website,
 count(*) FILTER (WHERE latitude IS NOT NULL AND longitude IS NOT NULL) AS with_coords,
 round(count(*) FILTER (WHERE latitude IS NOT NULL AND longitude IS NOT NULL) * 100.0E0 / count(*), 6) AS coords_pct FROM places"""
    assembled = _from_places("SELECT * FROM places")
    return {
        "place_parse_coords": with_views(f"SELECT rank, {LATITUDE} AS latitude, {LONGITUDE} AS longitude FROM captures", "captures"),
        "place_parse_address": with_views("+" + ADDRESS + "SELECT rank, subdistrict, district, city, province, zip_code FROM parts", "captures"),
        "place_parse_rating": with_views(f"SELECT rank, {_rating(_BOX_RATING)} AS rating, {_rating('rating_box_text')} AS raw_rating FROM captures", "captures"),
        "place_parse_reviews": with_views(f"SELECT rank, {_reviews(_BOX_REVIEWS)} AS reviews, {_reviews('rating_box_text')} AS raw_reviews FROM captures", "captures"),
        "place_clean_text": f"SELECT doc_id, CASE WHEN text <> '' THEN replace(replace({strip('text')}, chr(10), ' '), chr(13), '') END AS cleaned FROM documents",
        "place_stars": with_views(f"SELECT rank, {stars} FROM bars", "bars"),
        "place_phone_fallback": with_views(f"SELECT rank, {_PHONE} AS phone FROM captures", "captures"),
        "place_assemble": assembled,
        "io_delimited": assembled,
        "io_merge": """SELECT 'task_' || substr('abc', CAST(c_custkey % 3 AS INTEGER) + 1, 1) || '.csv' AS source_file, c_name AS name,
  CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END AS category,
  CASE WHEN c_custkey % 3 < 2 THEN 'http://x/' || CAST(c_custkey AS VARCHAR) END AS link,
  CASE WHEN c_custkey % 3 = 0 THEN c_custkey END AS reviews_count,
  CASE WHEN c_custkey % 3 = 1 THEN '021-' || CAST(c_custkey AS VARCHAR) END AS phone,
  CASE WHEN c_custkey % 3 = 2 THEN CAST(c_nationkey AS VARCHAR) END AS extra FROM customer""",
        "html_fields": f"""SELECT page_id, url, {_unescaped("regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)")} AS heading,
  {_unescaped("regexp_extract(html, '(?s)<div class=.ad.>(.*?)</div>', 1)")} AS ad,
  regexp_extract(html, '<a href="([^"]*)"', 1) AS first_link, regexp_extract(html, '<html lang="([^"]*)"', 1) AS lang FROM pages""",
        "html_panels": """SELECT CAST(c_nationkey AS BIGINT) AS task_id, CAST(c_custkey % 5 AS INTEGER) AS scroll_no,
  CAST(row_number() OVER (PARTITION BY c_nationkey, c_custkey % 5 ORDER BY c_custkey) - 1 AS INTEGER) AS pos,
  CASE WHEN c_nationkey % 3 > 0 THEN 'http://x/?a=1&k=' || CAST(c_custkey AS VARCHAR) END AS href FROM customer""",
        "html_captures": """SELECT CAST(c_nationkey AS BIGINT) AS task_id, CAST(c_custkey AS INTEGER) AS rank, 'u' || CAST(c_custkey AS VARCHAR) AS link,
  CASE WHEN c_custkey % 4 = 0 THEN c_name ELSE c_name || ' & Co' END AS name_text, lower(c_mktsegment) AS category_text,
  CAST(c_custkey AS VARCHAR) || ' Street' AS address_text,
  '4,' || CAST(c_custkey % 10 AS VARCHAR) || ' (' || CAST(c_custkey AS VARCHAR) || ')' AS rating_box_text,
  '4,' || CAST(c_custkey % 10 AS VARCHAR) AS rating_alt_text,
  CASE WHEN c_custkey % 3 > 0 THEN 'Phone: 021-' || CAST(c_custkey AS VARCHAR) END AS phone_aria, 'http://w/' || CAST(c_custkey AS VARCHAR) AS website,
  'Address: ' || CAST(c_custkey AS VARCHAR) || ' Street' AS labels,
  substr('1|2|3|4|5', 1, CAST(2 * least(c_custkey % 7 + 1, 5) - 1 AS INTEGER)) AS bars FROM customer""",
        "io_merge_counts": """SELECT 'task_' || substr('abc', CAST(c_custkey % 3 AS INTEGER) + 1, 1) || '.csv' AS source_file,
  count(*) AS places FROM customer GROUP BY 1""",
        "stream_places": assembled,
        "place_dedup_task": _from_places("SELECT task_id, rank, 'u' || CAST(rank % 70 AS VARCHAR) AS link, name FROM (SELECT *, row_number() OVER (PARTITION BY task_id, rank % 70 ORDER BY rank) AS rn FROM places) x WHERE rn = 1"),
        "place_dedup_global": _from_keyed("SELECT task_id, rank, name, latitude, longitude FROM (SELECT *, row_number() OVER (PARTITION BY name, key_lat, key_lon ORDER BY task_id, rank) AS rn FROM keyed) x WHERE rn = 1"),
        "place_duplicates": _from_keyed("SELECT name, key_lat, key_lon, count(*) AS copies FROM keyed GROUP BY ALL HAVING count(*) > 1"),
        "place_duplicate_searches": _from_keyed(
            "SELECT DISTINCT 'k' || CAST(task_id AS VARCHAR) AS search_keyword, 'l' || CAST(rank % 3 AS VARCHAR) AS search_location "
            "FROM (SELECT *, count(*) OVER (PARTITION BY name, key_lat, key_lon) AS n FROM keyed) x WHERE n > 1"),
        "stream_dedup": _from_keyed(
            "SELECT DISTINCT name, key_lat AS latitude, key_lon AS longitude FROM (SELECT 'Shop ' || CAST(rank % 40 AS VARCHAR) AS name, latitude AS key_lat, longitude AS key_lon FROM places) x"),
        "stream_dedup_all_time": _from_keyed(
            "SELECT DISTINCT name, key_lat AS latitude, key_lon AS longitude FROM (SELECT 'Shop ' || CAST(rank % 40 AS VARCHAR) AS name, latitude AS key_lat, longitude AS key_lon FROM places) x"),
        "merge_union": "SELECT c_name AS name, c_mktsegment AS category, CAST(NULL AS DOUBLE) AS balance FROM customer UNION ALL SELECT s_name, NULL, s_acctbal FROM supplier UNION ALL SELECT c_name, c_mktsegment, NULL FROM customer",
        "merge_file_counts": _from_keyed("SELECT 'task_' || CAST(task_id AS VARCHAR) || '.csv' AS source_file, count(*) AS places FROM keyed GROUP BY 1"),
        "merge_totals": _from_keyed("SELECT count(DISTINCT task_id) AS files, count(*) AS total_places, (SELECT count(*) FROM (SELECT DISTINCT name, key_lat, key_lon FROM keyed) y) AS unique_places FROM keyed"),
        "task_outcomes": """WITH found AS (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_acctbal > 0 AND c_nationkey % 6 <> 5 GROUP BY 1)
 SELECT CAST(n_nationkey AS BIGINT) AS task_id, n_name AS keyword, coalesce(n, 0) AS places_found, coalesce(n, 0) = 0 AS "empty",
 CAST(sum(coalesce(n, 0)) OVER (ORDER BY n_nationkey) AS BIGINT) AS running_total FROM nation LEFT JOIN found ON k = n_nationkey""",
        "summary_category_top10": _from_places(
            """SELECT category, places FROM (SELECT CASE WHEN rank % 13 = 0 THEN '' ELSE 'c' || CAST(rank * rank % 29 AS VARCHAR) END AS category,
  count(*) AS places FROM places GROUP BY 1 ORDER BY places DESC, category LIMIT 10) x WHERE category <> ''"""),
        "stream_counts": _from_places("SELECT city, count(*) AS places FROM places WHERE city IS NOT NULL GROUP BY 1"),
        "synthetic_merchants": _synthetic(),
        "summary_city": _from_places(counts.format(c="city", cut="")),
        "summary_district_top10": _from_places(
            "SELECT 'd' || CAST(rank % 23 AS VARCHAR) AS district, count(*) AS places FROM places GROUP BY 1 ORDER BY places DESC, district LIMIT 10"),
        "summary_overview": _from_places(overview),
        "stream_summary": _from_places(overview),
        "place_preview": _from_places("SELECT task_id, rank, name, city FROM places ORDER BY task_id, rank LIMIT 50"),
        "io_final": _from_places("""SELECT 'final_results_20240506_070809.' || suffix AS file,
  'name,category,address,subdistrict,district,city,province,zip_code,latitude,longitude,rating,reviews_count,phone,website,link,opening_hours,star_1,star_2,star_3,star_4,star_5,search_keyword,search_location,scraped_at' AS columns,
  name, category, city, zip_code, phone, link FROM places, (VALUES ('parquet'), ('csv')) v(suffix)"""),
        "io_named_files": _from_places("SELECT 'task_' || lpad(CAST(task_id AS VARCHAR), 3, '0') || '_toko_a_b_x_' || CAST(task_id AS VARCHAR) AS file, name, link, zip_code FROM places"),
        "io_task_files": _from_places("SELECT 'task_' || lpad(CAST(task_id AS VARCHAR), 3, '0') || '_toko_a_b_x_' || CAST(task_id AS VARCHAR) AS task_slug, name, link, zip_code FROM places"),
        "row_numbers": "SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1 AS row_id FROM orders",
        "io_merchants": "SELECT CAST(0 AS BIGINT) AS first, count(*) - 1 AS last, count(*) AS numbers FROM customer",
    }


# ---- coordinates


def _number(x: str) -> str:
    return f"CASE WHEN regexp_matches({x}, '{NUMBER}') THEN try_cast({x} AS DOUBLE) END"


def _repair(column: str, method: str, signed: bool = False) -> str:
    text = strip(column)
    pieces = f"list_filter(list_transform(string_split({text}, '-'), lambda p: {strip('p')}), lambda p: p <> '')"
    numbers = f"list_transform({pieces}, lambda p: {_number('p')})"
    pick = {
        "first": f"{numbers}[1]", "last": f"{numbers}[-1]", "middle": f"{numbers}[len({pieces}) // 2 + 1]",
        "average": f"list_avg({numbers})",
    }[method]
    if signed:
        pick = f"CASE WHEN starts_with({text}, '-') THEN -({pick}) ELSE {pick} END"
    usable = f"len({pieces}) > 0 AND len(list_filter({numbers}, lambda v: v IS NULL)) = 0"
    return f"coalesce({_number(text)}, CASE WHEN {usable} THEN {pick} END)"


def _coordinate_oracles() -> dict[str, str]:
    issue = """SELECT CAST({o} AS INTEGER) AS ord, '{code}' AS code, '{c}' AS "column", {n} AS n, '{s}' AS suggestion FROM stats WHERE {test}"""
    tests = {
        "string_type": ("true", "CAST(NULL AS BIGINT)"), "nulls": ("{c}_nulls > 0", "{c}_nulls"),
        "concatenated": ("{c}_width > 15", "{c}_width"),
        "invalid_range": ("NOT coalesce({c}_min >= -{b} AND {c}_max <= {b}, false)", "CAST(NULL AS BIGINT)"),
    }
    rows = []
    for i, (code, (test, n)) in enumerate(tests.items()):
        for j, (c, b) in enumerate((("latitude", 90), ("longitude", 180))):
            rows.append(issue.format(o=2 * i + j, code=code, c=c, n=n.format(c=c), s=SUGGESTIONS[code], test=test.format(c=c, b=b)))
    per_column = ", ".join(
        f"count(*) FILTER (WHERE {c} IS NULL) AS {c}_nulls, CAST(max(length({c})) AS BIGINT) AS {c}_width, count({_number(strip(c))}) AS {c}_numbers, "
        f"min({_number(strip(c))}) AS {c}_min, max({_number(strip(c))}) AS {c}_max" for c in ("latitude", "longitude"))
    stats = f"+stats AS (SELECT count(*) AS rows, {per_column} FROM dirty), issues AS ({' UNION ALL '.join(rows)}) "
    profile = " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", rows, {c}_nulls AS nulls, {c}_numbers AS numbers, round({c}_min, 6) AS min, round({c}_max, 6) AS max, {c}_width AS width FROM stats"""
        for c in ("latitude", "longitude"))
    fixed = "SELECT row_id, {la} AS latitude, {lo} AS longitude FROM dirty"
    rounded = "SELECT row_id, round(latitude, 6) AS latitude, round(longitude, 6) AS longitude FROM f"

    def repaired(method: str, signed: bool = False) -> str:
        return with_views("+f AS (" + fixed.format(la=_repair("latitude", method, signed), lo=_repair("longitude", method, signed)) + ") " + rounded.replace(", 6)", ", 9)"), "merchants", "dirty")

    marked = ("+f AS (" + fixed.format(la=_repair("latitude", "first"), lo=_repair("longitude", "first")) + "), m AS (SELECT *, CASE WHEN latitude IS NULL OR longitude IS NULL THEN 'null' "
              "WHEN NOT (latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180) THEN 'out_of_range' END AS reject_reason FROM f) ")
    return {
        "coord_diagnose": with_views(stats + """SELECT ord, code, "column", n FROM issues""", "merchants", "dirty"),
        "coord_suggest": with_views(stats + """SELECT ord, code, "column", suggestion FROM issues""", "merchants", "dirty"),
        "coord_profile": with_views(stats + profile, "merchants", "dirty"),
        **{f"coord_repair_{m}": repaired(m) for m in ("first", "last", "middle", "average")},
        "coord_repair_signed": repaired("first", True),
        "coord_clean": with_views(marked + rounded.replace("FROM f", "FROM m WHERE reject_reason IS NULL"), "merchants", "dirty"),
        "coord_reject_counts": with_views(marked + "SELECT reject_reason, count(*) AS n FROM m WHERE reject_reason IS NOT NULL GROUP BY 1", "merchants", "dirty"),
        "coord_repair_only": with_views(marked + rounded.replace("FROM f", "FROM f WHERE latitude IS NOT NULL AND longitude IS NOT NULL"), "merchants", "dirty"),
    }


# ---- distance and POIs


def hav(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    return (f"6371000.0E0 * 2 * asin(sqrt(pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) "
            f"* pow(sin(radians({lon2} - {lon1}) / 2), 2)))")


_AB = hav("a.latitude", "a.longitude", "b.latitude", "b.longitude")


def _pairs(radius: float, more: str = "") -> str:
    return (f"pairs AS (SELECT a.row_id AS a_id, b.row_id AS b_id, {_AB} AS hav_m FROM merchants a JOIN merchants b "
            f"ON abs(a.latitude - b.latitude) < {radius / 100000} AND {_AB} <= {radius}{more})")


def _dbscan(radius: float, needed: int) -> str:
    return f"""+{_pairs(radius)},
 core AS (SELECT a_id AS id FROM pairs GROUP BY a_id HAVING count(*) >= {needed}),
 walk(root, id) AS (SELECT id, id FROM core UNION SELECT w.root, p.b_id FROM walk w JOIN pairs p ON p.a_id = w.id JOIN core c ON c.id = p.b_id),
 comp AS (SELECT id, min(root) AS root FROM walk GROUP BY id),
 num AS (SELECT root, row_number() OVER (ORDER BY root) - 1 AS k FROM (SELECT DISTINCT root FROM comp) x),
 corelabel AS (SELECT comp.id, num.k FROM comp JOIN num ON num.root = comp.root),
 label AS (SELECT id, k FROM corelabel UNION ALL SELECT p.a_id, min(c.k) FROM pairs p JOIN corelabel c ON c.id = p.b_id WHERE p.a_id NOT IN (SELECT id FROM core) GROUP BY p.a_id),
 member AS (SELECT m.*, CAST(coalesce(l.k, -1) AS INTEGER) AS poi_cluster FROM merchants m LEFT JOIN label l ON l.id = m.row_id)
"""


def _modes() -> str:
    one = "coalesce((SELECT {c} FROM member m WHERE m.poi_cluster = centre.poi_cluster AND {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1), '') AS {c}"
    return ", ".join(one.format(c=c) for c in ("subdistrict", "district", "city"))


def _described(radius: str, needed: int) -> str:
    """Centres, distances and the POI table of ``member``; ``radius`` is an expression over ``centre``."""
    return f"""
 , centre AS (SELECT poi_cluster, avg(latitude) AS clat, avg(longitude) AS clon, count(*) AS n FROM member WHERE poi_cluster >= 0 GROUP BY poi_cluster),
 dist AS (SELECT m.row_id, m.poi_cluster, {hav('c.clat', 'c.clon', 'm.latitude', 'm.longitude')} AS d FROM member m JOIN centre c ON c.poi_cluster = m.poi_cluster),
 spread AS (SELECT poi_cluster, max(d) AS maxd, avg(d) AS avgd, min(d) AS mind FROM dist GROUP BY poi_cluster),
 pois AS (SELECT 'POI_' || CASE WHEN centre.poi_cluster < 1000 THEN lpad(CAST(centre.poi_cluster AS VARCHAR), 3, '0') ELSE CAST(centre.poi_cluster AS VARCHAR) END AS poi_id,
   centre.poi_cluster AS cluster_id, clat AS center_lat, clon AS center_lon, n AS merchant_count, maxd AS max_distance, avgd AS avg_distance, mind AS min_distance,
   CAST({radius} AS DOUBLE) AS radius_meters, CAST({needed} AS INTEGER) AS min_merchants, {_modes()} FROM centre JOIN spread ON spread.poi_cluster = centre.poi_cluster)
"""


_POI_ROWS = """SELECT poi_id, cluster_id, round(center_lat, 6) AS center_lat, round(center_lon, 6) AS center_lon, merchant_count, round(max_distance, 3) AS max_distance,
 round(avg_distance, 3) AS avg_distance, round(min_distance, 3) AS min_distance, round(radius_meters, 3) AS radius_meters, min_merchants, subdistrict, district, city FROM pois"""
_MEMBER_ROWS = """SELECT m.row_id, m.poi_cluster, round(dist.d, 3) AS distance_to_center FROM member m LEFT JOIN dist ON dist.row_id = m.row_id"""

_STATISTICS = """SELECT count(*) AS total_pois, (SELECT count(*) FROM member WHERE poi_cluster >= 0) AS total_merchants_in_pois,
 (SELECT count(*) FROM member WHERE poi_cluster < 0) AS total_merchants_outside_pois,
 (SELECT round(count(*) FILTER (WHERE poi_cluster >= 0) * 100.0E0 / count(*), 6) FROM member) AS coverage_percentage,
 round(avg(merchant_count), 6) AS avg_merchants_per_poi, round(stddev_samp(merchant_count), 6) AS std_merchants_per_poi,
 min(merchant_count) AS min_merchants_in_poi, max(merchant_count) AS max_merchants_in_poi,
 round(avg(max_distance), 3) AS avg_max_distance, round(avg(avg_distance), 3) AS avg_avg_distance FROM pois"""

_COVERAGE = """SELECT count(*) AS total_merchants, count(*) FILTER (WHERE poi_cluster >= 0) AS merchants_in_pois,
 round(count(*) FILTER (WHERE poi_cluster >= 0) * 100.0E0 / count(*), 6) AS coverage_percentage FROM member"""


def _int(x: str) -> str:
    return f"CAST(CAST(round_even({x}, 0) AS BIGINT) AS VARCHAR)"


_NAME = "'POI_' || lpad(CAST(m.poi_cluster AS VARCHAR), 3, '0')"
_LAYERS = f"""
SELECT 'poi' AS layer, poi_id AS id, round(center_lat, 6) AS lat, round(center_lon, 6) AS lon, CAST(NULL AS DOUBLE) AS radius_m, 'red' AS color,
  poi_id || ': ' || CAST(merchant_count AS VARCHAR) || ' merchants' AS label,
  poi_id || '; Merchants: ' || CAST(merchant_count AS VARCHAR) || '; Max distance: ' || {_int('max_distance')} || 'm; Avg distance: ' || {_int('avg_distance')} || 'm; Radius: 500m' AS popup FROM pois
UNION ALL SELECT 'circle', poi_id, round(center_lat, 6), round(center_lon, 6), radius_meters, 'red', '', poi_id || ' boundary (500m radius)' FROM pois
UNION ALL SELECT 'merchant', CAST(m.row_id AS VARCHAR), round(m.latitude, 6), round(m.longitude, 6), 3.0E0, CASE WHEN m.poi_cluster >= 0 THEN 'blue' ELSE 'gray' END,
  CASE WHEN m.poi_cluster >= 0 THEN {_NAME} ELSE 'No POI' END,
  CASE WHEN m.poi_cluster >= 0 THEN 'Merchant; ' || {_NAME} || '; Distance: ' || {_int('dist.d')} || 'm' ELSE 'Merchant; No POI; ' END
  FROM member m LEFT JOIN dist ON dist.row_id = m.row_id
"""

_TOLERANCE = "{r} / (111320.0E0 * cos(radians(a.latitude)))"
_PLANAR = "pow(b.latitude - a.latitude, 2) + pow(b.longitude - a.longitude, 2) <= pow({t}, 2)"


def _adaptive(radius: float, needed: int, centres: str = "a.row_id % 10 = 0") -> str:
    """The sequential greedy loop: one recursion step per centre, carrying the list of taken merchants."""
    planar = _PLANAR.format(t=_TOLERANCE.format(r=radius))
    away = hav("mlat", "mlon", "p.latitude", "p.longitude")
    return f"""+near AS (SELECT a.row_id AS a_id, b.row_id AS id, b.latitude, b.longitude FROM merchants a JOIN merchants b ON {centres} AND {planar} AND {_AB} <= {radius}),
 centres AS (SELECT a_id, count(*) AS density, list({{'id': id, 'latitude': latitude, 'longitude': longitude}} ORDER BY id) AS nb FROM near GROUP BY a_id HAVING count(*) >= {needed}),
 ordered AS (SELECT row_number() OVER (ORDER BY density DESC, a_id) AS i, nb FROM centres),
 run(i, taken, got, r) AS (
  SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[]), CAST([] AS BIGINT[]), CAST(0 AS DOUBLE)
  UNION ALL
  SELECT i, CASE WHEN len(fin) >= {needed} THEN list_concat(taken, fin) ELSE taken END, CASE WHEN len(fin) >= {needed} THEN fin ELSE CAST([] AS BIGINT[]) END, r FROM (
   SELECT i, taken, r, CASE WHEN len(av) >= {needed} THEN list_transform(list_filter(av, lambda p: {away} <= r), lambda p: p.id) ELSE CAST([] AS BIGINT[]) END AS fin FROM (
    SELECT *, greatest(100, least(list_aggregate(list_transform(av, lambda p: {away}), 'quantile_cont', 0.8), {radius} * 0.6E0)) AS r FROM (
     SELECT *, list_avg(list_transform(av, lambda p: p.latitude)) AS mlat, list_avg(list_transform(av, lambda p: p.longitude)) AS mlon FROM (
      SELECT o.i, run.taken, list_filter(o.nb, lambda p: NOT list_contains(run.taken, p.id)) AS av FROM run JOIN ordered o ON o.i = run.i + 1) s1) s2) s3) s4),
 won AS (SELECT row_number() OVER (ORDER BY i) - 1 AS k, got, r FROM run WHERE len(got) > 0),
 taken AS (SELECT k, r, unnest(got) AS id FROM won),
 member AS (SELECT m.*, CAST(coalesce(t.k, -1) AS INTEGER) AS poi_cluster, t.r FROM merchants m LEFT JOIN taken t ON t.id = m.row_id)
"""


def _kmeans(radius: float, needed: int) -> str:
    """All restarts from their fixed seeds until none moves, the cheapest one, and the trim of its clusters."""
    square = "(s.lat - l.lat) * (s.lat - l.lat) + (s.lon - l.lon) * (s.lon - l.lon)"
    return f"""+spots AS MATERIALIZED (SELECT latitude AS lat, longitude AS lon, min(row_id) AS spot, count(*) AS w FROM merchants GROUP BY ALL),
 rules AS MATERIALIZED (SELECT least(greatest(1, sum(w) // ({needed} * 2)), 20) AS k, 1e-4 * (sum(w * (lat - mlat) * (lat - mlat)) / sum(w) + sum(w * (lon - mlon) * (lon - mlon)) / sum(w)) / 2 AS tol
  FROM spots, (SELECT sum(lat * w) / sum(w) AS mlat, sum(lon * w) / sum(w) AS mlon FROM spots) m),
 seeds AS (SELECT r, c, lat, lon FROM (SELECT r, row_number() OVER (PARTITION BY r ORDER BY md5(CAST(r AS VARCHAR) || ':' || CAST(spot AS VARCHAR)), spot) - 1 AS c, lat, lon
  FROM spots, (SELECT unnest(range(10)) AS r) runs) x WHERE c < (SELECT k FROM rules)),
 lloyd(pass, r, c, lat, lon, done) AS (
  SELECT 0, r, c, lat, lon, false FROM seeds
  UNION ALL
  SELECT pass + 1, r, c, nlat, nlon, sum((nlat - lat) * (nlat - lat) + (nlon - lon) * (nlon - lon)) OVER (PARTITION BY r) <= (SELECT tol FROM rules) FROM (
   SELECT l.*, coalesce(m.lat, l.lat) AS nlat, coalesce(m.lon, l.lon) AS nlon FROM lloyd l LEFT JOIN (
    SELECT r, b.c AS c, sum(lat * w) / sum(w) AS lat, sum(lon * w) / sum(w) AS lon FROM (
     SELECT l.r, s.spot, s.lat, s.lon, s.w, min({{'d': {square}, 'c': l.c}}) AS b FROM spots s, lloyd l WHERE NOT l.done GROUP BY ALL) a GROUP BY ALL
   ) m ON m.r = l.r AND m.c = l.c WHERE NOT l.done) moved WHERE pass < 300),
 ends AS MATERIALIZED (SELECT * FROM lloyd QUALIFY pass = max(pass) OVER (PARTITION BY r)),
 assigned AS MATERIALIZED (SELECT l.r, s.spot, s.lat, s.lon, s.w, min({{'d': {square}, 'c': l.c}}) AS b FROM spots s, ends l GROUP BY ALL),
 cheapest AS (SELECT r FROM assigned GROUP BY r ORDER BY sum(w * b.d), r LIMIT 1),
 lab AS (SELECT m.*, a.b.c AS l FROM merchants m JOIN assigned a ON a.lat = m.latitude AND a.lon = m.longitude WHERE a.r = (SELECT r FROM cheapest)),
 means AS (SELECT l, avg(latitude) AS la, avg(longitude) AS lo, min(row_id) AS f FROM lab GROUP BY l HAVING count(*) >= {needed}),
 inside AS (SELECT m.row_id, m.l, x.f FROM lab m JOIN means x ON x.l = m.l WHERE {hav('x.la', 'x.lo', 'm.latitude', 'm.longitude')} <= {radius}),
 kept AS (SELECT l, row_number() OVER (ORDER BY min(f)) - 1 AS k FROM inside GROUP BY l HAVING count(*) >= {needed}),
 member AS (SELECT m.*, CAST(coalesce(k.k, -1) AS INTEGER) AS poi_cluster FROM merchants m LEFT JOIN inside i ON i.row_id = m.row_id LEFT JOIN kept k ON k.l = i.l)
"""


_DENSITY = (("DBSCAN", (200, 300, 500), _dbscan), ("Adaptive", (400, 600, 800), _adaptive))
_METHODS = (*_DENSITY, ("KMeans", (250, 350, 500), _kmeans))
# the same with every merchant as a centre
_ALL_CENTRES = tuple((m, radii, partial(text, centres="true") if text is _adaptive else text) for m, radii, text in _METHODS)


def _density_sweep(methods: tuple = _DENSITY) -> str:
    """Parameter sets of the given detectors, in the published order; coverage is not rounded yet."""
    parts, ord_ = [], 0
    for method, radii, text in methods:
        for radius in radii:
            for needed in (15, 20, 30):
                body = f"""SELECT CAST({ord_} AS INTEGER) AS ord, '{method}_r{radius}_m{needed}' AS config, '{method}' AS method, CAST({radius} AS INTEGER) AS radius,
 CAST({needed} AS INTEGER) AS min_merchants, count(DISTINCT poi_cluster) FILTER (WHERE poi_cluster >= 0) AS pois_found,
 count(*) FILTER (WHERE poi_cluster >= 0) * 100.0E0 / count(*) AS coverage FROM member"""
                parts.append(f"SELECT * FROM ({with_views(text(float(radius), needed) + body, 'merchants', recursive=True)}) t{ord_}")
                ord_ += 1
    return " UNION ALL ".join(parts)


def _listed_sets(methods: tuple, more: str = "") -> str:
    return f"""WITH s AS MATERIALIZED ({_density_sweep(methods)}), listed AS (
 SELECT *, 'most_pois' AS list FROM (SELECT * FROM s ORDER BY pois_found DESC, ord LIMIT 10) a
 UNION ALL SELECT *, 'most_coverage' FROM (SELECT * FROM s ORDER BY coverage DESC, ord LIMIT 5) b
 UNION ALL SELECT *, 'best' FROM (SELECT * FROM s ORDER BY pois_found DESC, ord LIMIT 1) c)
SELECT * REPLACE (round(coverage, 6) AS coverage){more} FROM listed"""


def _solution() -> str:
    """Statistics of every parameter set on the cleaned merchants; the first of those with most POIs stays."""
    parts = []
    for method, radii, text in _METHODS:
        for radius, needed in ((r, m) for r in radii for m in (15, 20, 30)):
            body = text(float(radius), needed) + _described(str(radius), needed)
            parts.append(f"""SELECT * FROM (WITH RECURSIVE merchants AS (SELECT * FROM cleaned), {body.lstrip().lstrip('+')}
 SELECT {len(parts)} AS ord, '{method}' AS method, CAST({radius} AS DOUBLE) AS radius, CAST({needed} AS INTEGER) AS min_merchants, s.* FROM ({_STATISTICS}) s) t{len(parts)}""")
    return with_views(f"""+f AS (SELECT row_id, {_repair('latitude', 'first')} AS latitude, {_repair('longitude', 'first')} AS longitude FROM dirty),
 cleaned AS MATERIALIZED (SELECT row_number() OVER (ORDER BY row_id) - 1 AS row_id, latitude, longitude, CAST(NULL AS VARCHAR) AS subdistrict,
  CAST(NULL AS VARCHAR) AS district, CAST(NULL AS VARCHAR) AS city FROM f WHERE latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180)
SELECT * EXCLUDE (ord) FROM ({' UNION ALL '.join(parts)}) every_set ORDER BY total_pois DESC, ord LIMIT 1""", "merchants", "dirty")


def _poi_oracles() -> dict[str, str]:
    near = with_views("+" + _pairs(300.0) + " SELECT a_id, b_id, round(hav_m, 3) AS hav_m FROM pairs", "merchants")

    def lists(radius: float, centres: str = "true") -> str:
        planar = _PLANAR.format(t=_TOLERANCE.format(r=radius))
        return with_views(f"""+{_pairs(radius, ' AND ' + planar)}, ball AS (SELECT a.row_id AS id FROM merchants a JOIN merchants b ON {planar} WHERE {centres} GROUP BY a.row_id HAVING count(*) > 1)
 SELECT a_id, b_id, round(hav_m, 3) AS hav_m FROM pairs WHERE a_id IN (SELECT id FROM ball)""", "merchants")

    counts = "+" + _pairs(500.0) + ", n AS (SELECT a_id AS row_id, count(*) AS neighbors FROM pairs GROUP BY a_id) "

    def found(radius: float, needed: int, body: str) -> str:
        return with_views(_dbscan(radius, needed) + _described(str(radius), needed) + body, "merchants", recursive=True)

    def fitted(body: str, *centres: str) -> str:
        radius = "(SELECT max(r) FROM member m WHERE m.poi_cluster = centre.poi_cluster)"
        return with_views(_adaptive(600.0, 15, *centres) + _described(radius, 15) + body, "merchants", recursive=True)

    return {
        "geo_distance": with_views(
            f"SELECT row_id, round({hav('-6.2E0', '106.8E0', 'latitude', 'longitude')}, 3) AS metres, round(250.0E0 / 111320.0E0, 9) AS lat_tol, "
            "round(250.0E0 / (111320.0E0 * cos(radians(latitude))), 9) AS lon_tol FROM merchants", "merchants"),
        "neighbor_pairs": near,
        "neighbor_lists": lists(300.0),
        "neighbor_centres": lists(600.0, "a.row_id % 10 = 0"),
        "neighbor_counts": with_views(counts + "SELECT row_id, neighbors FROM n", "merchants"),
        "dense_merchants": with_views(counts + """SELECT city, CAST(place AS INTEGER) AS place, row_id, name, neighbors FROM (
 SELECT m.city, m.row_id, m.name, n.neighbors, row_number() OVER (PARTITION BY m.city ORDER BY n.neighbors DESC, m.row_id) AS place FROM merchants m JOIN n ON n.row_id = m.row_id) x WHERE place <= 10""", "merchants"),
        "poi_dbscan_membership": found(500.0, 15, _MEMBER_ROWS),
        "poi_dbscan_summary": found(500.0, 15, _POI_ROWS),
        "poi_statistics": found(500.0, 15, _STATISTICS),
        "poi_coverage": found(300.0, 15, _COVERAGE),
        "poi_map_layers": found(500.0, 15, _LAYERS),
        "poi_relaxed": found(600.0, 10, _POI_ROWS),
        "poi_kmeans": with_views(_kmeans(350.0, 15) + _described("350.0", 15) + _POI_ROWS.replace("SELECT poi_id,", "SELECT poi_id, round(max_distance, 3) AS actual_max_radius,"), "merchants", recursive=True),
        "poi_sweep": f"SELECT * REPLACE (round(coverage, 6) AS coverage), CAST(NULL AS VARCHAR) AS error FROM ({_density_sweep(_METHODS)}) s",
        "poi_sweep_density": f"SELECT * REPLACE (round(coverage, 6) AS coverage) FROM ({_density_sweep()}) s",
        "poi_sweep_density_top": _listed_sets(_DENSITY),
        "poi_sweep_top": _listed_sets(_ALL_CENTRES, ", CAST(NULL AS VARCHAR) AS error"),
        "poi_solution": _solution(),
        "poi_kmeans_trim": with_views(f"""+lab AS (SELECT *, CAST(substr(city, 8) AS INTEGER) AS l FROM merchants),
 means AS (SELECT l, avg(latitude) AS la, avg(longitude) AS lo, min(row_id) AS f FROM lab GROUP BY l HAVING count(*) >= 60),
 inside AS (SELECT m.row_id, m.l, x.f FROM lab m JOIN means x ON x.l = m.l WHERE {hav('x.la', 'x.lo', 'm.latitude', 'm.longitude')} <= 700),
 kept AS (SELECT l, row_number() OVER (ORDER BY min(f)) - 1 AS k FROM inside GROUP BY l HAVING count(*) >= 60)
 SELECT m.row_id, CAST(coalesce(k.k, -1) AS INTEGER) AS poi_cluster FROM lab m LEFT JOIN inside i ON i.row_id = m.row_id LEFT JOIN kept k ON k.l = i.l""", "merchants"),
        "poi_adaptive": fitted(_POI_ROWS, "true"),
        "poi_adaptive_membership": fitted(_MEMBER_ROWS),
    }


def oracle_sql() -> dict[str, str]:
    return _task_oracles() | _harvest_oracles() | _place_oracles() | _coordinate_oracles() | _poi_oracles()
