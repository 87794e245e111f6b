"""Derived input tables; the same text runs in Spark and in the checking engine."""

MERCHANTS = """
SELECT c_custkey AS row_id, c_name AS name, concat('NATION_', CAST(n AS STRING)) AS city, c_mktsegment AS district,
 concat('Sub_', CAST(c_custkey % 7 AS STRING)) AS subdistrict,
 -6.2E0 + CAST(n % 5 AS DOUBLE) * 0.02E0 + (CAST((c_custkey * 7919) % 2003 AS DOUBLE) / 2003E0 - 0.5E0) * s AS latitude,
 106.8E0 + CAST(floor(n / 5) AS DOUBLE) * 0.02E0 + (CAST((c_custkey * 104729) % 1999 AS DOUBLE) / 1999E0 - 0.5E0) * s AS longitude
FROM (SELECT *, c_nationkey AS n, CASE WHEN c_custkey % 5 = 0 THEN 0.02E0 ELSE 0.008E0 END AS s FROM customer) t
"""

CAPTURES = """
SELECT c_custkey AS rank, c_custkey % 10 AS task_id, c_name AS name_text, c_mktsegment AS category_text,
 concat('https://maps.example/place/', CAST(c_custkey % 997 AS STRING), '/@-6.2', CAST(c_custkey % 10 AS STRING), ',106.8',
   CAST(c_custkey % 7 AS STRING), ',17z', CASE WHEN c_custkey % 3 = 0 THEN concat('/data=!8m2!3d-6.3',
   CAST(c_custkey % 9 AS STRING), '!4d106.9', CAST(c_custkey % 8 AS STRING)) ELSE '' END) AS link,
 CASE c_custkey % 6
  WHEN 0 THEN concat('Jl. Sudirman No.', CAST(c_custkey % 90 + 1 AS STRING), ', Senayan, Kec. Kebayoran Baru, Jakarta Selatan, DKI Jakarta 12', CAST(100 + c_custkey % 900 AS STRING))
  WHEN 1 THEN concat('Jl. X, Kel. Melawai, Kec. Tebet, Kota ', c_mktsegment, ', Jawa Barat 40', CAST(100 + c_custkey % 900 AS STRING))
  WHEN 2 THEN 'Kec. Tebet, Jakarta Selatan'
  WHEN 3 THEN concat('Jl. Y, Melawai, Jakarta Selatan, Daerah Khusus Ibukota Jakarta 12', CAST(100 + c_custkey % 900 AS STRING))
  WHEN 4 THEN 'Jl. Braga 10, Bandung' ELSE NULL END AS address_text,
 CASE WHEN c_acctbal < 0 THEN NULL
      WHEN c_custkey % 4 = 0 THEN concat('4,', CAST(c_custkey % 10 AS STRING), ' (1.', CAST(100 + c_custkey % 900 AS STRING), ')')
      ELSE concat(CAST(c_custkey % 5 + 1 AS STRING), '.', CAST(c_custkey % 10 AS STRING), ' (', CAST(c_custkey AS STRING), ')') END AS rating_box_text,
 CASE WHEN c_custkey % 8 = 3 THEN NULL ELSE concat('+62 21 ', CAST(c_custkey AS STRING)) END AS phone_text,
 CASE WHEN c_custkey % 8 = 3 AND c_custkey % 16 = 3 THEN concat('Phone: 021-', CAST(c_custkey AS STRING)) END AS phone_aria,
 CASE WHEN c_custkey % 3 = 1 THEN concat('https://shop', CAST(c_custkey % 50 AS STRING), '.example') END AS website
FROM customer
"""

OBSERVATIONS = """
SELECT user_id AS task_id, CAST(floor((rn - 1) / 8) AS INT) AS scroll_no, CAST((rn - 1) % 8 AS INT) AS pos, props AS href
FROM (SELECT user_id, props, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events) t
"""

# few new links, so that some scrolls bring none
SPARSE_OBSERVATIONS = """
SELECT task_id, scroll_no, pos, concat('h', CAST(floor((scroll_no * 8 + pos + task_id % 9) / 20E0) AS BIGINT)) AS href
FROM observations
"""

# keyword and location positions follow the text, so that task numbers are the same everywhere
KEYWORDS = """
SELECT CAST(row_number() OVER (ORDER BY keyword) - 1 AS BIGINT) AS pos, keyword
FROM (SELECT DISTINCT p_type AS keyword FROM part) t
"""

LOCATIONS = """
SELECT CAST(row_number() OVER (ORDER BY n_nationkey) - 1 AS BIGINT) AS pos,
 CASE WHEN n_nationkey % 3 = 0 THEN concat(' Sub_', CAST(n_nationkey AS STRING), ' ')
      WHEN n_nationkey % 3 = 1 THEN 'nan' ELSE NULL END AS subdistrict,
 CASE WHEN n_nationkey % 7 = 6 THEN '' ELSE n_name END AS district,
 CASE WHEN n_nationkey % 7 = 6 THEN NULL ELSE r_name END AS city,
 CASE WHEN n_nationkey % 7 = 6 THEN concat(' ', n_name) ELSE 'unused' END AS location
FROM nation JOIN region ON n_regionkey = r_regionkey
"""

DIRTY_MERCHANTS = """
SELECT row_id, city, district,
 CASE row_id % 50 WHEN 7 THEN NULL WHEN 13 THEN '' WHEN 17 THEN 'abc' WHEN 23 THEN '95.0'
  ELSE CASE row_id % 4 WHEN 0 THEN la WHEN 1 THEN concat(la, la) WHEN 2 THEN concat(la, la2, la) ELSE concat(la2, la, la, la2) END END AS latitude,
 CASE row_id % 50 WHEN 8 THEN NULL WHEN 29 THEN '106.8-x' WHEN 31 THEN '-' WHEN 37 THEN '1e3' WHEN 41 THEN ' 1.068e2 '
  ELSE CASE row_id % 4 WHEN 0 THEN lo WHEN 1 THEN concat(lo, '-', lo) WHEN 2 THEN concat(lo, '-', lo2, '-', lo) ELSE concat(lo2, '-', lo, '-', lo, '-', lo2) END END AS longitude
FROM (SELECT row_id, city, district,
  concat('-', CAST(CAST(floor(a / 1000000E0) AS BIGINT) AS STRING), '.', lpad(CAST(a % 1000000 AS STRING), 6, '0')) AS la,
  concat('-', CAST(CAST(floor((a + 777) / 1000000E0) AS BIGINT) AS STRING), '.', lpad(CAST((a + 777) % 1000000 AS STRING), 6, '0')) AS la2,
  concat(CAST(CAST(floor(o / 1000000E0) AS BIGINT) AS STRING), '.', lpad(CAST(o % 1000000 AS STRING), 6, '0')) AS lo,
  concat(CAST(CAST(floor((o + 555) / 1000000E0) AS BIGINT) AS STRING), '.', lpad(CAST((o + 555) % 1000000 AS STRING), 6, '0')) AS lo2
 FROM (SELECT row_id, city, district, CAST(round(-latitude * 1000000E0) AS BIGINT) AS a, CAST(round(longitude * 1000000E0) AS BIGINT) AS o
       FROM merchants) m) t
"""

RERUN = """
SELECT concat('duplicates_', CAST(o_custkey % 3 AS STRING)) AS source_file, concat(' ', o_orderpriority, ' ') AS search_keyword,
 CASE o_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN '  ' ELSE concat('Sub_', CAST(o_custkey % 5 AS STRING), ' ') END AS search_subdistrict,
 CASE WHEN o_custkey % 11 = 0 THEN NULL ELSE concat('District_', CAST(o_custkey % 6 AS STRING)) END AS search_district,
 o_orderstatus AS search_region
FROM orders
"""

BARS = """
SELECT c_custkey AS rank, concat(CAST(c_custkey % 1000 AS STRING), ' x 5') AS b1,
 CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE concat('stars: ', CAST(c_custkey % 77 AS STRING)) END AS b2,
 CASE WHEN c_custkey % 4 = 0 THEN 'none' ELSE CAST(c_custkey AS STRING) END AS b3,
 c_mktsegment AS b4, '1,234' AS b5, CAST(c_custkey % 6 AS INT) AS bars
FROM customer
"""

# events as captures: every link a task saw, with a name that is sometimes missing or a heading
EVENT_CAPTURES = """
SELECT user_id AS task_id, props AS link, CAST(min(event_id) AS INT) AS rank,
 CASE min(event_id) % 9 WHEN 0 THEN NULL WHEN 1 THEN 'Hasil' ELSE concat(' Shop ', CAST(min(event_id) AS STRING)) END AS name_text,
 min(event_type) AS category_text
FROM events GROUP BY user_id, props
"""

EVENT_TASKS = """
SELECT user_id AS task_id, concat('kw', CAST(user_id % 7 AS STRING)) AS keyword, concat('place ', CAST(user_id % 5 AS STRING)) AS location,
 CAST(5 + user_id % 40 AS INT) AS max_results
FROM (SELECT DISTINCT user_id FROM events) t
"""
