"""The SQL that each query must agree with, over the plain test tables."""

from __future__ import annotations

from cellgrid.functions import vocab
from cellgrid.plans.drafts import VIOLATION_TEXT
from cellgrid.sources.fixtures import FIXTURE_SQL

ORACLES: dict[str, str] = {}

WRAP = "lat BETWEEN -40 AND 40 AND (lon >= 100 OR lon <= -60)"
WINDOW = "time BETWEEN TIMESTAMP '2024-01-03 12:00:00' AND TIMESTAMP '2024-01-20 18:30:00'"
STAMP = "strftime({}, '%Y-%m-%d %H:%M:%S')"
SLICE = """sliced AS (SELECT variable AS request_id, time, lat, lon, CASE WHEN lon >= 100 THEN 0 ELSE 1 END AS seg, value
  FROM grid_obs)"""


def ctes(*names: str) -> list[str]:
    return [f"{name} AS ({FIXTURE_SQL[name][1]})" for name in names]


def with_(parts: list[str], body: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n" + body


def oracle(name: str, body: str, *fixtures: str, also: list[str] | None = None) -> None:
    parts = ctes(*fixtures) + (also or [])
    ORACLES[name] = with_(parts, body) if parts else body


def case_map(expr: str, table: dict[str, str]) -> str:
    return f"CASE {expr} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + " END"


def name_list(names) -> str:
    return ", ".join(f"'{x}'" for x in names)


CANONICAL = f"coalesce({case_map('upper(trim(variable))', vocab.VARIABLE_ALIASES)}, upper(trim(variable)))"
SERVED = name_list(vocab.COLUMN_VARIABLES)

# --- sources ------------------------------------------------------------------------
CALENDAR = """calendar AS (SELECT CAST(unnest(generate_series(CAST(min(ts) AS DATE), CAST(max(ts) AS DATE), INTERVAL 1 DAY)) AS DATE) AS day FROM events),
urls AS (SELECT day, 's3://archive/grids/' || strftime(day, '%Y/%m') || '/MERRA2_400.tavg1_2d_aer_Nx.' || strftime(day, '%Y%m%d') || '.nc4' AS url FROM calendar)"""
oracle("granule_calendar", "SELECT strftime(day, '%Y-%m-%d') AS day, url FROM urls", also=[CALENDAR])
oracle("first_n_granules", "SELECT url AS path FROM urls ORDER BY url LIMIT 12", also=[CALENDAR])
oracle("granule_date", """SELECT event_id, CASE WHEN event_id % 11 = 0 OR event_id % 7 = 0 THEN NULL ELSE strftime(ts, '%Y-%m-%d') END AS day FROM events""")
oracle("read_manifest", "SELECT strftime(day, '%Y-%m-%d') AS day, ref_name FROM manifest", "manifest")
oracle("pending_granules", """SELECT url, name AS ref_name FROM (SELECT url, 'MERRA2_400.tavg1_2d_aer_Nx.' || strftime(day, '%Y%m%d') || '.json' AS name FROM urls) u
WHERE name NOT IN (SELECT ref_name FROM manifest)""", "manifest", also=[CALENDAR])
oracle("build_index", """SELECT strftime(day, '%Y-%m-%d') AS day, name AS ref_name, name NOT IN (SELECT ref_name FROM manifest) AS built
FROM (SELECT day, 'MERRA2_400.tavg1_2d_aer_Nx.' || strftime(day, '%Y%m%d') || '.json' AS name FROM urls) u""", "manifest", also=[CALENDAR])
oracle("merge_manifest", """SELECT key, ref_name FROM (
  SELECT key, ref_name, row_number() OVER (PARTITION BY key ORDER BY rank DESC) AS rn FROM (
    SELECT CAST(day AS VARCHAR) AS key, ref_name, -1 AS rank FROM manifest
    UNION ALL
    SELECT CASE WHEN extract(day FROM ts) % 3 = 0 THEN strftime(ts, '%Y-%m-%d') ELSE 's3://archive/loose/' || CAST(user_id % 40 AS VARCHAR) END,
           'v' || CAST(event_id AS VARCHAR) || '.json', event_id FROM events)) WHERE rn = 1""", "manifest")
LINKS = """links AS (SELECT event_id, ts, CASE WHEN extract(day FROM ts) % 3 = 0 THEN strftime(ts, '%Y-%m-%d')
  ELSE 's3://archive/loose/' || CAST(user_id % 40 AS VARCHAR) END AS key, user_id FROM events)"""
oracle("index_log", """SELECT key, ref_name FROM (
  SELECT key, ref_name, row_number() OVER (PARTITION BY key ORDER BY builder DESC, event_id DESC) AS rn FROM (
    SELECT CAST(day AS VARCHAR) AS key, ref_name, -1 AS builder, 0 AS event_id FROM manifest
    UNION ALL SELECT key, 'v' || CAST(event_id AS VARCHAR) || '.json', event_id % 4, event_id FROM links)) WHERE rn = 1""", "manifest", also=[LINKS])
oracle("index_listing", """SELECT CAST(day AS VARCHAR) AS key, ref_name FROM manifest
UNION SELECT key, CASE WHEN extract(day FROM ts) % 3 = 0 THEN 'MERRA2_400.tavg1_2d_aer_Nx.' || strftime(ts, '%Y%m%d')
  ELSE CAST(user_id % 40 AS VARCHAR) END || '.json' FROM links""", "manifest", also=[LINKS])
oracle("read_chunk_refs", """SELECT path, variable || '/' || ct || '.' || cy || '.' || cx AS key, CAST(NULL AS VARCHAR) AS inline,
  's3://archive/' || path AS url, CAST("offset" AS BIGINT) AS "offset", CAST(length AS BIGINT) AS length FROM chunk_rows
UNION ALL SELECT DISTINCT path, '.zgroup', '{}', NULL, NULL, NULL FROM chunk_rows""", "chunk_rows")
oracle("remote_scheme", """SELECT collection, max(CASE WHEN rn = 1 THEN scheme END) AS scheme FROM (
  SELECT collection, scheme, CASE WHEN scheme IS NOT NULL THEN row_number() OVER (PARTITION BY collection, scheme IS NULL ORDER BY path, event_id) END AS rn FROM (
    SELECT event_type || '-' || CAST(user_id % 400 AS VARCHAR) AS collection, strftime(ts, '%Y-%m-%d') AS path, event_id,
      CASE event_id % 9 WHEN 4 THEN 'https' WHEN 5 THEN 'https' WHEN 6 THEN 's3' END AS scheme FROM events)) GROUP BY collection""")
oracle("chunk_report", """SELECT path, variable, '1x91x144' AS chunks, CAST(bytes AS BIGINT) AS chunk_bytes, nt * 16 AS n_chunks, bytes * nt * 16 / 1000000.0::DOUBLE AS total_mb FROM (
  SELECT path, variable, CASE WHEN variable = 'BCEXTTAU' THEN 104832 ELSE 52416 END AS bytes, COUNT(DISTINCT ct) AS nt
  FROM chunk_rows WHERE variable <> 'lat' GROUP BY path, variable)""", "chunk_rows")
oracle("prune_chunks", """SELECT request_id, COUNT(*) AS n_chunks, CAST(SUM(length) AS BIGINT) AS bytes_to_read FROM (
  SELECT CAST(n_nationkey AS BIGINT) AS request_id, c.length FROM nation JOIN chunk_rows c
    ON CAST(c.path AS DATE) BETWEEN DATE '2024-01-03' + CAST(n_nationkey % 9 AS INT) AND DATE '2024-01-03' + CAST(n_nationkey % 9 + 5 AS INT)
   AND c.variable = CASE WHEN n_nationkey % 2 = 0 THEN 'DUEXTTAU' ELSE 'TOTEXTTAU' END
   AND c.ct BETWEEN n_nationkey % 12 AND n_nationkey % 12 + 11
   AND c.cy BETWEEN floor((n_nationkey * 13 % 300) / 91) AND floor((n_nationkey * 13 % 300 + 60) / 91)
   AND c.cx BETWEEN floor((n_nationkey * 37 % 500) / 144) AND floor((n_nationkey * 37 % 500 + 75) / 144)) GROUP BY request_id""", "chunk_rows")
oracle("prune_chunks_pushed", """SELECT request_id, COUNT(*) AS n_chunks, CAST(SUM(length) AS BIGINT) AS bytes_to_read FROM (
  SELECT CAST(c_custkey AS BIGINT) AS request_id, c.length FROM customer JOIN chunk_rows c
    ON CAST(c.path AS DATE) BETWEEN DATE '2024-01-03' + CAST(c_custkey % 9 AS INT) AND DATE '2024-01-03' + CAST(c_custkey % 9 + 5 AS INT)
   AND c.variable = CASE WHEN c_custkey % 2 = 0 THEN 'DUEXTTAU' ELSE 'TOTEXTTAU' END
   AND c.ct BETWEEN c_custkey % 12 AND c_custkey % 12 + 8
   AND c.cy BETWEEN floor((c_custkey * 13 % 300) / 91) AND floor((c_custkey * 13 % 300 + 60) / 91)
   AND c.cx BETWEEN floor((c_custkey * 37 % 500) / 144) AND floor((c_custkey * 37 % 500 + 75) / 144)) GROUP BY request_id""", "chunk_rows")
oracle("decode_cf_time", "SELECT event_id, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:30:00') AS time FROM events")
FLAT = f"SELECT variable, {STAMP.format('time')} AS time, lat, lon, round(value, 4) AS value FROM grid_obs"
oracle("concat_granules", FLAT, "grid_obs")
oracle("write_cells", FLAT, "grid_obs")

# --- requests -----------------------------------------------------------------------
oracle("canonical_variable", f"SELECT draft_id, {CANONICAL} AS variable FROM drafts", "drafts")
oracle("servable_variable", f"SELECT draft_id, {CANONICAL} IN ({SERVED}) AS servable FROM drafts", "drafts")


def box_parts(source: str, ident: str) -> str:
    part = lambda i: f"CASE WHEN len(string_split(bbox, ',')) = 4 THEN TRY_CAST(trim(split_part(bbox, ',', {i})) AS DOUBLE) END"
    return f"""boxes AS (SELECT {ident}, {part(1)} AS w, {part(2)} AS s, {part(3)} AS e, {part(4)} AS n FROM {source})"""


BOX_ERROR = """CASE WHEN w IS NULL OR s IS NULL OR e IS NULL OR n IS NULL THEN 'bbox_format'
  WHEN w NOT BETWEEN -180 AND 180 OR e NOT BETWEEN -180 AND 180 THEN 'bbox_longitude'
  WHEN s NOT BETWEEN -90 AND 90 OR n NOT BETWEEN -90 AND 90 THEN 'bbox_latitude' WHEN NOT s < n THEN 'bbox_order' END"""
oracle("parse_bbox", f"SELECT box_id, w, s, e, n, {BOX_ERROR} AS error FROM boxes", "box_texts", also=[box_parts("box_texts", "box_id")])
oracle("parse_utc_time", """SELECT event_id, CASE event_id % 8 WHEN 0 THEN d || ' 00:00:00' WHEN 1 THEN d || ' 07:08:09' WHEN 2 THEN d || ' 07:08:00'
  WHEN 3 THEN strftime(CAST(d AS TIMESTAMP) - INTERVAL '51 minutes 51 seconds', '%Y-%m-%d %H:%M:%S')
  WHEN 4 THEN strftime(CAST(d AS TIMESTAMP) + INTERVAL '27 hours 38 minutes 9 seconds', '%Y-%m-%d %H:%M:%S') END AS time
FROM (SELECT event_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS d FROM events)""")


def utc(column: str) -> str:
    return (f"CASE WHEN {column} LIKE '%Z' THEN TRY_CAST(replace({column}, 'Z', '') AS TIMESTAMP) "
            f"WHEN {column} LIKE '%+02:00' THEN TRY_CAST(left({column}, 19) AS TIMESTAMP) - INTERVAL 2 HOUR ELSE TRY_CAST({column} AS TIMESTAMP) END")


def checked(source: str) -> list[str]:
    """Requests parsed and judged as ``checked``, good ones as ``good``."""
    return [
        box_parts(source, "*"),
        f"parsed AS (SELECT * REPLACE ({CANONICAL} AS variable), variable AS given, {utc('t0')} AS st, {utc('t1')} AS en, {BOX_ERROR} AS box_error FROM boxes)",
        f"""checked AS (SELECT *, CASE WHEN source <> 'merra2' THEN 'source' WHEN variable NOT IN ({SERVED}) THEN 'variable'
          WHEN agg NOT IN ({name_list(vocab.AGGREGATIONS)}) THEN 'aggregation' WHEN box_error IS NOT NULL THEN box_error
          WHEN st IS NULL THEN 't0' WHEN en IS NULL THEN 't1' WHEN en < st THEN 'time_order'
          WHEN CAST(st AS DATE) > DATE '2024-04-17' THEN 'latency' END AS reason FROM parsed)""",
        "good AS (SELECT * FROM checked WHERE reason IS NULL)",
    ]


oracle("check_requests", """SELECT request_id, reason, CASE WHEN reason = 'variable' THEN 'unknown_variable' WHEN reason IS NOT NULL THEN 'bad_request' END AS error_class,
  CASE WHEN reason IS NULL THEN 200 ELSE 422 END AS status FROM checked""", "customer_requests", also=checked("customer_requests"))
oracle("granules_for_window", """SELECT request_id, strftime(day, '%Y-%m-%d') AS day, ref_name FROM good JOIN manifest
  ON day BETWEEN CAST(st AS DATE) AND CAST(en AS DATE)""", "customer_requests", "manifest", also=checked("customer_requests"))

# axes, longitude pieces and counts of good requests
GEOMETRY = [
    "cells AS (SELECT *, CAST(time AS DATE) AS day FROM grid_obs)",
    "lats AS (SELECT DISTINCT variable, lat FROM cells)",
    "lons AS (SELECT DISTINCT variable, lon FROM cells)",
    "ext AS (SELECT variable, min(lon) AS lo, max(lon) AS hi FROM lons GROUP BY variable)",
    """segs AS (SELECT * FROM (
      SELECT request_id, g.variable, 0 AS seg, greatest(w, lo) AS a, CASE WHEN w > e THEN hi ELSE least(e, hi) END AS b FROM good g JOIN ext USING (variable)
      UNION ALL SELECT request_id, g.variable, 1, lo, least(e, hi) FROM good g JOIN ext USING (variable) WHERE w > e) WHERE b > a)""",
    "rlat AS (SELECT request_id, lat, row_number() OVER (PARTITION BY request_id ORDER BY lat) - 1 AS iy FROM good JOIN lats USING (variable) WHERE lat BETWEEN s AND n)",
    "rlon AS (SELECT request_id, seg, lon, row_number() OVER (PARTITION BY request_id ORDER BY seg, lon) - 1 AS ix FROM segs JOIN lons USING (variable) WHERE lon BETWEEN a AND b)",
    "gdays AS (SELECT request_id, count(*) AS granule_days FROM good JOIN manifest ON day BETWEEN CAST(st AS DATE) AND CAST(en AS DATE) GROUP BY request_id)",
    """steps AS (SELECT request_id, count(*) AS n FROM good g JOIN (SELECT DISTINCT variable, day, time FROM cells WHERE day IN (SELECT day FROM manifest)) c
      ON c.variable = g.variable AND c.time BETWEEN st AND en GROUP BY request_id)""",
    """coverage AS (SELECT request_id, coalesce(granule_days, 0) AS granule_days,
      CAST(en AS DATE) - CAST(st AS DATE) + 1 - coalesce(granule_days, 0) AS missing_days, coalesce(steps.n, 0) AS time_steps_used,
      CASE WHEN granule_days IS NULL THEN 'no_coverage' WHEN NOT EXISTS (SELECT 1 FROM ext x WHERE x.variable = good.variable) THEN 'variable_absent'
           WHEN request_id NOT IN (SELECT request_id FROM segs) THEN 'no_longitude_cells'
           WHEN request_id NOT IN (SELECT request_id FROM rlat) OR request_id NOT IN (SELECT request_id FROM rlon) THEN 'no_grid_cells'
           WHEN steps.n IS NULL THEN 'no_time_steps' END AS gap
      FROM good LEFT JOIN gdays USING (request_id) LEFT JOIN steps USING (request_id))""",
]
oracle("coverage_status", "SELECT request_id, granule_days, missing_days, time_steps_used, gap FROM coverage",
       "customer_requests", "grid_obs", "manifest", also=checked("customer_requests") + GEOMETRY)
oracle("time_steps_used", "SELECT request_id, coalesce(steps.n, 0) AS time_steps_used FROM gdays LEFT JOIN steps USING (request_id)",
       "customer_requests", "grid_obs", "manifest", also=checked("customer_requests") + GEOMETRY)

# --- slices -------------------------------------------------------------------------
oracle("slice_bbox", f"SELECT variable, {STAMP.format('time')} AS time, lat, lon, 0 AS seg, round(value, 4) AS value FROM grid_obs WHERE lat BETWEEN -35 AND 30 AND lon BETWEEN -100 AND 50", "grid_obs")
oracle("wrap_union", f"""SELECT variable, {STAMP.format('time')} AS time, lat, lon, 0 AS seg, round(value, 4) AS value FROM grid_obs WHERE lat BETWEEN -40 AND 40 AND lon >= 100
UNION ALL SELECT variable, {STAMP.format('time')}, lat, lon, 1, round(value, 4) FROM grid_obs WHERE lat BETWEEN -40 AND 40 AND lon <= -60""", "grid_obs")
oracle("slice_time", f"{FLAT} WHERE {WINDOW}", "grid_obs")
SELECTED = """selected AS (SELECT g.request_id, g.agg, c.variable, c.time, c.day, c.lat, c.lon, p.seg, c.value FROM good g JOIN cells c ON c.variable = g.variable AND c.lat BETWEEN s AND n AND c.time BETWEEN st AND en
  JOIN segs p ON p.request_id = g.request_id AND c.lon BETWEEN p.a AND p.b WHERE c.day IN (SELECT day FROM manifest))"""
REQUEST_PARTS = checked("grid_requests") + GEOMETRY + [SELECTED]
REQUEST_FIXTURES = ("grid_requests", "grid_obs", "manifest")
oracle("slice_requests", f"SELECT CAST(request_id AS BIGINT) AS request_id, variable, {STAMP.format('time')} AS time, lat, lon, seg, round(value, 4) AS value FROM selected",
       *REQUEST_FIXTURES, also=REQUEST_PARTS)
INDEX = """idx AS (SELECT CAST(request_id AS BIGINT) AS request_id, 'lat' AS axis, 0 AS seg, lat AS coord, iy AS position FROM rlat
  UNION ALL SELECT CAST(request_id AS BIGINT), 'lon', seg, lon, ix FROM rlon)"""
INDEX_PARTS = checked("customer_requests") + GEOMETRY + [INDEX]
INDEX_FIXTURES = ("customer_requests", "grid_obs", "manifest")
oracle("slice_index", "SELECT * FROM idx", *INDEX_FIXTURES, also=INDEX_PARTS)
oracle("ordered_cells", "SELECT request_id, lat, seg, lon, round(avg(value), 4) AS value FROM sliced GROUP BY 1, 2, 3, 4", "grid_obs", also=[SLICE])
oracle("canvas_order", "SELECT request_id, coord AS lat, max(position) OVER (PARTITION BY request_id) - position AS y FROM idx WHERE axis = 'lat'", *INDEX_FIXTURES, also=INDEX_PARTS)

# --- fields -------------------------------------------------------------------------
DAILY = "daily AS (SELECT request_id, seg, lat, lon, avg(v) AS value FROM (SELECT request_id, seg, lat, lon, date_trunc('day', time) AS b, avg(value) AS v FROM sliced GROUP BY 1, 2, 3, 4, 5) GROUP BY 1, 2, 3, 4)"
oracle("collapse_hourly", "SELECT request_id, seg, lat, lon, round(avg(value), 4) AS value FROM sliced GROUP BY 1, 2, 3, 4", "grid_obs", also=[SLICE])
oracle("collapse_daily", "SELECT request_id, seg, lat, lon, round(value, 4) AS value FROM daily", "grid_obs", also=[SLICE, DAILY])
oracle("collapse_monthly", """SELECT request_id, seg, lat, lon, round(avg(v), 4) AS value FROM (
  SELECT variable AS request_id, CASE WHEN lon >= 100 THEN 0 ELSE 1 END AS seg, lat, lon, date_trunc('month', time) AS b, avg(value) AS v FROM grid_history
  GROUP BY 1, 2, 3, 4, 5) GROUP BY 1, 2, 3, 4""", "grid_history")
oracle("prefix_fields", """SELECT CAST(request_id AS BIGINT) AS request_id, seg, lat, lon, round(avg(v), 4) AS value FROM (
  SELECT request_id, seg, lat, lon, CASE agg WHEN 'daily' THEN strftime(time, '%Y-%m-%d') WHEN 'monthly_mean' THEN strftime(time, '%Y-%m') END AS b, avg(value) AS v
  FROM selected GROUP BY 1, 2, 3, 4, 5) GROUP BY 1, 2, 3, 4 HAVING avg(v) IS NOT NULL""", "customer_requests", "grid_obs", "manifest",
       also=checked("customer_requests") + GEOMETRY + [SELECTED])
oracle("downsample", """SELECT CAST(floor(iy / fy) AS BIGINT) AS by, CAST(floor(ix / fx) AS BIGINT) AS bx, round(avg(DISTINCT la.lat), 4) AS lat, round(avg(DISTINCT lo.lon), 4) AS lon, round(avg(value), 4) AS value
FROM la CROSS JOIN lo CROSS JOIN shape LEFT JOIN grid_fine g ON g.lat = la.lat AND g.lon = lo.lon
WHERE floor(iy / fy) < floor(ny / fy) AND floor(ix / fx) < floor(nx / fx) GROUP BY 1, 2""", "grid_fine", also=[
    "la AS (SELECT lat, row_number() OVER (ORDER BY lat) - 1 AS iy FROM (SELECT DISTINCT lat FROM grid_fine))",
    "lo AS (SELECT lon, row_number() OVER (ORDER BY lon) - 1 AS ix FROM (SELECT DISTINCT lon FROM grid_fine))",
    "shape AS (SELECT ny, nx, ceil(ny / 180) AS fy, ceil(nx / 360) AS fx FROM (SELECT (SELECT count(*) FROM la) AS ny, (SELECT count(*) FROM lo) AS nx))"])


BLOCKS = """SELECT {nlon}::BIGINT AS max_nlon, CAST(floor(iy / fy) AS BIGINT) AS by, CAST(floor(ix / fx) AS BIGINT) AS bx, round(avg(DISTINCT la.lat), 4) AS lat,
  round(avg(DISTINCT lo.lon), 4) AS lon, round(avg(value), 4) AS value
FROM la CROSS JOIN lo CROSS JOIN (SELECT ny, nx, ceil(ny / {nlat}) AS fy, ceil(nx / {nlon}) AS fx FROM (SELECT (SELECT count(*) FROM la) AS ny, (SELECT count(*) FROM lo) AS nx))
LEFT JOIN grid_fine g ON g.lat = la.lat AND g.lon = lo.lon WHERE floor(iy / fy) < floor(ny / fy) AND floor(ix / fx) < floor(nx / fx) GROUP BY 1, 2, 3"""
oracle("block_means", " UNION ALL ".join(BLOCKS.format(nlon=x, nlat=y) for x, y in ((360, 180), (90, 60), (41, 17))), "grid_fine", also=[
    "la AS (SELECT lat, row_number() OVER (ORDER BY lat) - 1 AS iy FROM (SELECT DISTINCT lat FROM grid_fine))",
    "lo AS (SELECT lon, row_number() OVER (ORDER BY lon) - 1 AS ix FROM (SELECT DISTINCT lon FROM grid_fine))"])


def range_sql(source: str) -> list[str]:
    """p2 and p98 of ``source`` per request, widened where constant, as ``rng``."""
    return [
        f"pq AS (SELECT request_id, quantile_cont(value, 0.02) AS lo, quantile_cont(value, 0.98) AS hi FROM {source} GROUP BY request_id)",
        """rng AS (SELECT *, (vmin + vmax) / 2 AS vmid FROM (SELECT request_id, lo IS NULL AS empty,
          CASE WHEN lo IS NULL THEN 0 WHEN hi > lo THEN lo WHEN lo <> 0 THEN lo - abs(lo) * 0.01 ELSE -1e-6 END AS vmin,
          CASE WHEN lo IS NULL THEN 1 WHEN hi > lo THEN hi WHEN lo <> 0 THEN lo + abs(lo) * 0.01 ELSE 1e-6 END AS vmax FROM pq))""",
    ]


oracle("normalize_range", "SELECT request_id, round(vmin, 6) AS vmin, round(vmid, 6) AS vmid, round(vmax, 6) AS vmax, empty FROM rng",
       "grid_obs", also=[SLICE, DAILY] + range_sql("daily"))
oracle("exact_range", "SELECT request_id, round(vmin, 6) AS vmin, round(vmid, 6) AS vmid, round(vmax, 6) AS vmax, empty FROM rng",
       "fine_obs", also=["field AS (SELECT variable AS request_id, value FROM fine_obs)"] + range_sql("field"))
UNWRAPPED = """unwrapped AS (SELECT request_id, position, coord AS lon, coord + CASE WHEN seg = 1 AND has_left THEN 360 ELSE 0 END AS unwrapped
  FROM (SELECT *, bool_or(seg = 0) OVER (PARTITION BY request_id) AS has_left FROM idx WHERE axis = 'lon'))"""
oracle("unwrap_lons", "SELECT * FROM unwrapped", *INDEX_FIXTURES, also=INDEX_PARTS + [UNWRAPPED])
EXTENT = """extent AS (SELECT request_id, west, south, east, north FROM (SELECT request_id, min(unwrapped) AS west, max(unwrapped) AS east FROM unwrapped GROUP BY 1)
  JOIN (SELECT request_id, min(coord) AS south, max(coord) AS north FROM idx WHERE axis = 'lat' GROUP BY 1) USING (request_id))"""
oracle("grid_extent", "SELECT * FROM extent", *INDEX_FIXTURES, also=INDEX_PARTS + [UNWRAPPED, EXTENT])
oracle("grid_corners", """SELECT request_id, CAST(0 AS BIGINT) AS corner, west AS lon, north AS lat FROM extent UNION ALL SELECT request_id, 1, east, north FROM extent
UNION ALL SELECT request_id, 2, east, south FROM extent UNION ALL SELECT request_id, 3, west, south FROM extent""", *INDEX_FIXTURES, also=INDEX_PARTS + [UNWRAPPED, EXTENT])


def window_mean(name: str, condition: str) -> str:
    return f"""{name} AS (SELECT variable AS request_id, seg, lat, lon, avg(v) AS value FROM (
      SELECT variable, CASE WHEN lon >= 100 THEN 0 ELSE 1 END AS seg, lat, lon, date_trunc('day', time) AS b, avg(value) AS v FROM grid_obs
      WHERE {condition} GROUP BY 1, 2, 3, 4, 5) GROUP BY 1, 2, 3, 4)"""


oracle("compare_windows", """SELECT request_id, seg, lat, lon, round(a.value, 4) AS value_a, round(b.value, 4) AS value_b, round(b.value - a.value, 4) AS difference,
  round(b.value / nullif(a.value, 0), 2) AS ratio FROM a FULL JOIN b USING (request_id, seg, lat, lon)""", "grid_obs",
       also=[window_mean("a", "time < TIMESTAMP '2024-01-15'"), window_mean("b", "time >= TIMESTAMP '2024-01-15'")])

# --- documents ----------------------------------------------------------------------
ANSWER = [
    """field AS (SELECT request_id, seg, lat, lon, avg(v) AS value FROM (SELECT request_id, seg, lat, lon,
      CASE agg WHEN 'daily' THEN date_trunc('day', time) WHEN 'monthly_mean' THEN date_trunc('month', time) ELSE TIMESTAMP '2000-01-01' END AS b, avg(value) AS v
      FROM selected GROUP BY 1, 2, 3, 4, 5) GROUP BY 1, 2, 3, 4)""",
    """dense AS (SELECT request_id, iy, ix, rlat.lat, rlon.lon, round(value, 4) AS value FROM coverage JOIN rlat USING (request_id) JOIN rlon USING (request_id)
      LEFT JOIN field USING (request_id, seg, lat, lon) WHERE gap IS NULL)""",
]
ANSWER_PARTS = REQUEST_PARTS + ANSWER
ISO = "strftime({}, '%Y-%m-%dT%H:%M:%SZ')"
oracle("explode_grid_documents", "SELECT CAST(request_id AS BIGINT) AS request_id, iy, ix, lat, lon, value, CAST(NULL AS VARCHAR) AS error FROM dense", *REQUEST_FIXTURES, also=ANSWER_PARTS)
ANSWER_ROWS = """SELECT CAST(c.request_id AS BIGINT) AS request_id, CAST(CASE WHEN reason IS NULL AND gap IS NULL THEN 200 ELSE 422 END AS BIGINT) AS status, coalesce(reason, gap) AS reason,
  v.time_steps_used, v.missing_days, iy, ix, lat, lon, value FROM checked c LEFT JOIN coverage v USING (request_id) LEFT JOIN dense d USING (request_id)"""
oracle("answer_grid_requests", ANSWER_ROWS, *REQUEST_FIXTURES, also=ANSWER_PARTS)
oracle("answer_many_requests", ANSWER_ROWS, "customer_requests", "grid_obs", "manifest",
       also=checked("customer_requests") + GEOMETRY + [SELECTED] + ANSWER)
HEAD = f"""head AS (SELECT request_id, g.variable, 'dimensionless' AS units, {ISO.format('st')} AS time_start, {ISO.format('en')} AS time_end, time_steps_used, agg AS aggregation
  FROM good g JOIN coverage v USING (request_id) WHERE gap IS NULL)"""
oracle("grid_documents", """SELECT CAST(request_id AS BIGINT) AS request_id, variable, units, lats, lons, nx, ny, n_missing, time_start, time_end, time_steps_used, aggregation, false AS downsampled, 'merra2' AS source
FROM head JOIN (SELECT request_id, string_agg(CAST(lat AS VARCHAR), ',' ORDER BY iy) AS lats, count(*) AS ny FROM rlat GROUP BY 1) USING (request_id)
  JOIN (SELECT request_id, string_agg(CAST(lon AS VARCHAR), ',' ORDER BY ix) AS lons, count(*) AS nx FROM rlon GROUP BY 1) USING (request_id)
  JOIN (SELECT request_id, count(*) FILTER (value IS NULL) AS n_missing FROM dense GROUP BY 1) USING (request_id)""", *REQUEST_FIXTURES, also=ANSWER_PARTS + [HEAD])


def ramp_rows() -> str:
    rows = []
    for name, stops in vocab.RENDER_RAMPS.items():
        for (t0, c0), (t1, c1) in zip(stops, stops[1:]):
            low, high = bytes.fromhex(c0[1:]), bytes.fromhex(c1[1:])
            rows.append(f"('{name}', {t0}::DOUBLE, {t1}::DOUBLE, {', '.join(str(x) for x in (*low, *high))})")
    return "ramps(ramp, t0, t1, r0, g0, b0, r1, g1, b1) AS (VALUES " + ", ".join(rows) + ")"


MIX = ", ".join(f"CAST(floor({c}0 + ({c}1 - {c}0) * ((x - t0) / (t1 - t0)) + 0.5) AS BIGINT) AS {c}" for c in "rgb")
ON_RAMP = "ON p.ramp = m.ramp AND (x > t0 OR t0 = 0) AND x <= t1"
oracle("colorize_grid", f"""SELECT request_id, y, x, coalesce(r, 0) AS r, coalesce(g, 0) AS g, coalesce(b, 0) AS b, CAST(CASE WHEN seen THEN 235 ELSE 0 END AS BIGINT) AS a FROM (
  SELECT p.request_id, p.y, p.ix AS x, p.seen, {MIX} FROM pix p LEFT JOIN ramps m {ON_RAMP})""", *REQUEST_FIXTURES, also=ANSWER_PARTS + range_sql("dense") + [
    ramp_rows(),
    """pix AS (SELECT CAST(request_id AS BIGINT) AS request_id, max(iy) OVER (PARTITION BY request_id) - iy AS y, ix, value IS NOT NULL AS seen,
      CASE WHEN variable LIKE '%DU%' THEN 'dust' ELSE 'viridis' END AS ramp, CASE WHEN value IS NOT NULL THEN greatest(0.0, least(1.0, (value - vmin) / (vmax - vmin))) END AS x
      FROM dense JOIN rng USING (request_id) JOIN (SELECT request_id, variable FROM good) USING (request_id))"""])
TICK = "coalesce(format('{{:.3g}}', {}), '–')"


def ramp_sql(name: str) -> str:
    """The gradient text of a ramp, put together in SQL from its stops."""
    stops = ", ".join(f"('{colour}', {position}::DOUBLE)" for position, colour in vocab.RENDER_RAMPS[name])
    return f"""(SELECT 'linear-gradient(to right, ' || string_agg(colour || ' ' || printf('%.1f%%', 100 * position), ', ' ORDER BY position) || ')'
  FROM (VALUES {stops}) AS stops(colour, position))"""


GRADIENT = f"CASE WHEN {{}} LIKE '%DU%' THEN {ramp_sql('dust')} ELSE {ramp_sql('viridis')} END"
oracle("legend_for_grid", f"""SELECT CAST(request_id AS BIGINT) AS request_id, {case_map('variable', vocab.DISPLAY_NAMES)} AS title, {GRADIENT.format('variable')} AS gradient,
  {TICK.format('vmin')} AS tick_min, {TICK.format('vmid')} AS tick_mid, {TICK.format('vmax')} AS tick_max,
  units || ' · ' || left(time_start, 10) || ' → ' || left(time_end, 10) || ' · ' || aggregation AS meta FROM head JOIN rng USING (request_id)""",
       *REQUEST_FIXTURES, also=ANSWER_PARTS + [HEAD] + range_sql("dense"))

# --- plans --------------------------------------------------------------------------
DRAFTS = f"dated AS (SELECT * REPLACE ({CANONICAL} AS variable), variable AS given, TIMESTAMP '2024-01-01' AS t0, TIMESTAMP '2024-01-01' + to_days(CAST(span_days AS INT)) - INTERVAL 1 SECOND AS t1 FROM drafts)"
NAMES = """names AS (SELECT place_key, name, w, s, e, n FROM (
  SELECT *, row_number() OVER (PARTITION BY place_key ORDER BY rank DESC, name DESC) AS rn FROM (
    SELECT lower(name) AS place_key, 0 AS rank, * FROM places UNION ALL SELECT alias, 1, places.* FROM place_aliases JOIN places ON canonical = name)) WHERE rn = 1)"""
FIRST = "(SELECT string_agg(name, ', ' ORDER BY name) FROM (SELECT DISTINCT name FROM places ORDER BY name LIMIT 12))"
PLACE_ERROR = f"CASE WHEN name IS NULL THEN 'unknown place ''' || trim(place) || '''; known places include ' || {FIRST} END"
PLACE_FIXTURES = ("drafts", "places", "place_aliases")
LOCATED = f"located AS (SELECT d.*, names.*, {PLACE_ERROR} AS place_error FROM dated d LEFT JOIN names ON lower(trim(place)) = place_key)"
oracle("resolve_places", "SELECT draft_id, name AS place_name, w, s, e, n, place_error FROM located", *PLACE_FIXTURES, also=[DRAFTS, NAMES, LOCATED])
oracle("known_places", "SELECT DISTINCT n_name AS name FROM nation ORDER BY name LIMIT 12")
oracle("plan_from_draft", """SELECT draft_id, CASE WHEN draft_id % 17 <> 0 THEN name END AS place_name, CASE WHEN draft_id % 17 <> 0 THEN w END AS w, CASE WHEN draft_id % 17 <> 0 THEN n END AS n,
  CASE WHEN draft_id % 19 = 0 THEN 'the question needs the user''s location' WHEN draft_id % 17 = 0 THEN 'the draft names no place' ELSE place_error END AS refusal FROM located""",
       *PLACE_FIXTURES, also=[DRAFTS, NAMES, LOCATED])
oracle("check_plan_schema", f"""SELECT draft_id, variable, aggregation, mode, opacity, 'aqi' AS colormap, array_to_string(list_filter([
    CASE WHEN draft_id % 29 = 0 THEN 'intent' END,
    CASE WHEN draft_id % 23 = 0 THEN 'bbox_format' WHEN w NOT BETWEEN -180 AND 180 OR e NOT BETWEEN -180 AND 180 THEN 'bbox_longitude' WHEN n NOT BETWEEN -90 AND 90 THEN 'bbox_latitude'
         WHEN NOT w < e THEN 'bbox_wrap' WHEN NOT -10 < n THEN 'bbox_order' END,
    CASE WHEN draft_id % 37 = 0 THEN 'time_end' END, CASE WHEN draft_id % 31 = 0 THEN 'mode' END, CASE WHEN opacity > 1 THEN 'opacity' END], lambda x: x IS NOT NULL), ',') AS errors
FROM (SELECT draft_id, variable, CASE WHEN draft_id % 5 = 0 THEN 'daily' ELSE aggregation END AS aggregation, CASE WHEN draft_id % 31 = 0 THEN 'binary' ELSE 'continuous' END AS mode,
  CASE WHEN draft_id % 3 <> 0 THEN CAST(draft_id % 14 AS DOUBLE) / 10 ELSE 0.65::DOUBLE END AS opacity,
  draft_id % 400 - 200 AS w, draft_id % 90 AS e, draft_id % 50 - 20 AS n FROM dated)""", "drafts", also=[DRAFTS])
VIOLATION = f"""CASE WHEN intent = 'health' AND level <> 'surface' THEN 'health_level' WHEN intent = 'health' AND variable IN ({SERVED}) THEN 'health_variable'
  WHEN level = 'surface' AND variable IN ({SERVED}) THEN 'surface_variable' WHEN level = 'column' AND variable IN ({name_list(vocab.SURFACE_VARIABLES)}) THEN 'column_variable'
  WHEN span_days > CASE aggregation WHEN 'hourly' THEN 7 WHEN 'daily' THEN 62 ELSE 1825 END THEN 'window_days' END"""
oracle("validate_plans", f"SELECT draft_id, {VIOLATION} AS violation FROM dated", "drafts", also=[DRAFTS])


def default_of(i: int) -> str:
    return case_map("intent", {k: v[i] for k, v in vocab.INTENT_DEFAULTS.items()})


oracle("intent_defaults", f"""SELECT draft_id, CASE WHEN draft_id % 2 <> 0 THEN level ELSE {default_of(0)} END AS level, CASE WHEN draft_id % 3 <> 0 THEN source ELSE {default_of(1)} END AS source,
  CASE WHEN draft_id % 5 <> 0 THEN aggregation ELSE {default_of(2)} END AS aggregation FROM drafts""", "drafts")
oracle("route_source", """SELECT draft_id, CASE WHEN draft_id % 7 = 0 THEN 'merra2' WHEN DATE '2024-01-01' + CAST(draft_id % 60 AS INT) >= DATE '2024-01-11' THEN 'google'
  WHEN level = 'surface' THEN 'cams' ELSE 'merra2' END AS routed_source FROM drafts""", "drafts")
oracle("style_defaults", """SELECT draft_id, CASE WHEN intent = 'plume' THEN 'aod_sequential' ELSE 'aqi' END AS colormap,
  CASE WHEN intent = 'health' AND draft_id % 2 = 0 THEN 'exceedance' ELSE 'continuous' END AS mode, CAST(0.65 AS DOUBLE) AS opacity FROM drafts""", "drafts")
LINK = f"""CASE source WHEN 'google' THEN 'google://heatmapTiles/{{z}}/{{x}}/{{y}}' WHEN 'cams' THEN 'cams://pending'
  ELSE '/grid?source=merra2&variable=' || variable || '&bbox=' || w || ',' || s || ',' || e || ',' || n || '&t0=' || {ISO.format('t0')} || '&t1=' || {ISO.format('t1')} || '&agg=' || aggregation END"""
CAPTION = "variable || ' over ' || coalesce(name, 'requested area') || ', ' || strftime(t0, '%Y-%m-%d') || '..' || strftime(t1, '%Y-%m-%d') || ' (' || source || ')'"
oracle("data_url", f"SELECT draft_id, {LINK} AS data_url FROM located", *PLACE_FIXTURES, also=[DRAFTS, NAMES, LOCATED])
oracle("legend_spec", """SELECT draft_id, CASE level WHEN 'surface' THEN 'µg/m³' ELSE 'AOD (unitless)' END AS units, CASE level WHEN 'surface' THEN 'aqi' ELSE 'aod_sequential' END AS stops,
  CASE level WHEN 'surface' THEN 'WHO 24h' END AS guideline FROM drafts""", "drafts")
LEGEND_STOPS = "stops(colormap, position, t, hex) AS (VALUES " + ", ".join(
    f"('{name}', {i}::BIGINT, {t}::DOUBLE, '{colour}')" for name, ramp in vocab.LEGEND_RAMPS.items() for i, (t, colour) in enumerate(ramp)) + ")"
oracle("legend_stops", """SELECT draft_id, CASE level WHEN 'surface' THEN 'µg/m³' ELSE 'AOD (unitless)' END AS units, position, t, hex
  FROM drafts JOIN stops ON colormap = CASE level WHEN 'surface' THEN 'aqi' ELSE 'aod_sequential' END""", "drafts", also=[LEGEND_STOPS])
oracle("auto_caption", f"SELECT draft_id, CASE WHEN draft_id % 3 = 0 THEN 'given' ELSE {CAPTION} END AS caption FROM located", *PLACE_FIXTURES, also=[DRAFTS, NAMES, LOCATED])
oracle("exceedance", """SELECT event_id, threshold, CASE WHEN event_id % 47 <> 0 THEN value > threshold END AS exceeds FROM (
  SELECT *, CAST(CASE event_type WHEN 'click' THEN 15 WHEN 'view' THEN 45 WHEN 'signup' THEN 25 END AS DOUBLE) AS threshold FROM events)""")
oracle("answer_plans", f"""SELECT draft_id, CAST(CASE WHEN problem IS NULL THEN 200 ELSE 422 END AS BIGINT) AS status, problem, variable, name AS place_name, CASE WHEN problem IS NULL THEN link END AS data_url,
  CASE WHEN problem IS NULL THEN CASE level WHEN 'surface' THEN 'aqi' ELSE 'aod_sequential' END END AS stops, CASE WHEN problem IS NULL THEN caption END AS caption FROM (
  SELECT *, {LINK} AS link, {CAPTION} AS caption,
    CASE WHEN place_error IS NOT NULL THEN place_error ELSE {case_map('(' + VIOLATION + ')', VIOLATION_TEXT)} END AS problem
  FROM located)""", *PLACE_FIXTURES, also=[DRAFTS, NAMES, LOCATED])

# --- questions ----------------------------------------------------------------------
WORDS = "' ' || trim(regexp_replace(lower({}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) || ' '"
ALIASES = "aliases(event_id, alias) AS (VALUES " + ", ".join(f"('{e[0]}', '{a}')" for e in vocab.EVENT_CATALOG for a in e[2]) + ")"
MATCHES = f"""matches AS (SELECT question_id, event_id, min(alias) AS alias FROM event_questions JOIN aliases
  ON contains({WORDS.format('text')}, ' ' || alias || ' ') GROUP BY 1, 2)"""
oracle("match_events", "SELECT * FROM matches", "event_questions", also=[ALIASES, MATCHES])
PLANS = "event_plans(event_id, w, time_start, source, level, intent, variable, aggregation) AS (VALUES " + ", ".join(
    f"('{e[0]}', {e[3][0]}::DOUBLE, '{e[4].replace('T', ' ').replace('Z', '')}', {name_list(p)})" for e in vocab.EVENT_CATALOG for p in e[6]) + ")"
oracle("event_plans", "SELECT question_id, event_id, source, level, intent, variable, aggregation, w, time_start FROM matches JOIN event_plans USING (event_id)",
       "event_questions", also=[ALIASES, MATCHES, PLANS])
PHRASES = "phrases(phrase, variable, level) AS (VALUES " + ", ".join(f"('{p}', '{v}', '{lv}')" for p, (v, lv) in vocab.TRIGGER_PHRASES.items()) + ")"
oracle("tag_aerosol_words", f"""SELECT question_id, phrase, variable, level FROM (
  SELECT question_id, phrase, variable, level, row_number() OVER (PARTITION BY question_id ORDER BY length(phrase) DESC, phrase) AS rn
  FROM questions LEFT JOIN phrases ON contains({WORDS.format('text')}, ' ' || regexp_replace(phrase, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g') || ' ')) WHERE rn = 1""", "questions", also=[PHRASES])
oracle("tag_phrases", f"""SELECT doc_id, found FROM (
  SELECT doc_id, found, row_number() OVER (PARTITION BY doc_id ORDER BY length(found) DESC, found) AS rn
  FROM (SELECT doc_id, {WORDS.format('text')} AS words FROM documents) d LEFT JOIN openings ON contains(words, ' ' || found || ' ')) WHERE rn = 1""", also=[
    f"openings AS (SELECT DISTINCT array_to_string(string_split(trim({WORDS.format('text')}), ' ')[1 : item_id % 3 + 2], ' ') AS found FROM benchmark)"])
NORMAL = "regexp_replace(regexp_replace(trim(lower(text), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '[\\s\\p{Z}]+', ' ', 'g'), '[^\\p{L}\\p{N}_\\s]', '', 'g')"
oracle("normalize_question", f"SELECT conv_id, turn, {NORMAL} AS normal FROM conversations")
KEY = f"sha256({NORMAL} || chr(0) || scope)"
oracle("question_key", f"SELECT question_id, {KEY} AS key FROM questions", "questions")
CACHE = f"""cache AS (SELECT question_id, key, ok, coalesce(max(CASE WHEN ok THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY ts, question_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS hit
  FROM (SELECT *, {KEY} AS key FROM questions))"""
oracle("question_cache", "SELECT question_id, key, hit FROM cache", "questions", also=[CACHE])
ORACLES["question_cache_stream"] = ORACLES["question_cache"]
oracle("cache_stats", "SELECT count(*) FILTER (hit) AS hits, count(*) FILTER (NOT hit) AS misses, count(DISTINCT key) FILTER (ok) AS entries FROM cache", "questions", also=[CACHE])
ASKED = """questions AS (SELECT question_id, text, 'all' AS scope, question_id % 13 <> 0 AS ok,
  TIMESTAMP '2024-01-01' + to_minutes(CAST(question_id AS BIGINT)) AS ts FROM event_questions)"""
ROUTED = DRAFTS.replace("* REPLACE (", "* REPLACE (CASE WHEN draft_id % 5 <> 0 THEN source WHEN level = 'surface' THEN 'cams' ELSE 'merra2' END AS source, ")
oracle("answer_questions", f"""SELECT question_id, hit AS cached, coalesce(events, '') AS events, CAST(CASE WHEN problem IS NULL THEN 200 ELSE 422 END AS BIGINT) AS status, problem,
  source, CASE WHEN intent = 'plume' THEN 'aod_sequential' ELSE 'aqi' END AS colormap,
  CASE WHEN problem IS NULL THEN link END AS data_url, CASE WHEN problem IS NULL THEN caption END AS caption
FROM cache LEFT JOIN (SELECT question_id, string_agg(event_id, ',' ORDER BY event_id) AS events FROM matches GROUP BY 1) USING (question_id)
JOIN (SELECT *, draft_id AS question_id, {LINK} AS link, {CAPTION} AS caption,
    CASE WHEN place_error IS NOT NULL THEN place_error ELSE {case_map('(' + VIOLATION + ')', VIOLATION_TEXT)} END AS problem FROM located) USING (question_id)""",
       *PLACE_FIXTURES, "event_questions", also=[ROUTED, NAMES, LOCATED, ALIASES, MATCHES, ASKED, CACHE])

# --- scalars ------------------------------------------------------------------------
oracle("grid_value", "SELECT event_id, CASE WHEN event_id % 47 <> 0 THEN round(value / 97.31, 4) END AS value FROM events")
oracle("hex_to_rgb", """SELECT event_id, CASE WHEN event_id % 13 <> 0 THEN k // 65536 END AS r, CASE WHEN event_id % 13 <> 0 THEN k // 256 % 256 END AS g, CASE WHEN event_id % 13 <> 0 THEN k % 256 END AS b,
  CASE WHEN event_id % 13 = 0 THEN 'not a colour: #x' || printf('%06x', k) END AS error FROM (SELECT event_id, event_id * 7919 % 16777216 AS k FROM events)""")
oracle("sample_colormap", f"""SELECT event_id, {MIX} FROM (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'dust' ELSE 'viridis' END AS ramp,
  greatest(0.0, least(1.0, value / 97.31 - 0.25)) AS x FROM events) p JOIN ramps m {ON_RAMP}""", also=[ramp_rows()])
oracle("colormap_for", "SELECT draft_id, CASE WHEN upper(variable) LIKE '%DU%' THEN 'dust' ELSE 'viridis' END AS colormap FROM drafts", "drafts")
oracle("pretty_variable", f"SELECT draft_id, coalesce({case_map('upper(trim(variable))', vocab.DISPLAY_NAMES)}, trim(variable)) AS title FROM drafts", "drafts")
# the formatter here rounds the exact value but an exact half to even, which one step up corrects
TICK_VALUE = """CASE WHEN event_id % 5 <> 0 THEN CASE WHEN event_id % 47 <> 0 THEN value / 97.31 END
  WHEN event_id % 125 = 0 AND event_id > 0 THEN nextafter(event_id / 1000, 1e300::DOUBLE) ELSE event_id / 1000 END"""
oracle("format_tick", f"SELECT event_id, {TICK.format(TICK_VALUE)} AS tick FROM events")
oracle("legend_gradient", f"SELECT draft_id, {GRADIENT.format('upper(variable)')} AS gradient FROM drafts", "drafts")
oracle("grid_title", f"""SELECT draft_id, 'dimensionless · 2024-01-01' || CASE WHEN span_days = 1 THEN '' ELSE ' → ' || strftime(t1, '%Y-%m-%d') END || ' · ' || aggregation AS title FROM dated""", "drafts", also=[DRAFTS])

# --- request log --------------------------------------------------------------------
LOG = "log AS (SELECT event_id, ts, coalesce(nullif(trim(split_part(xff, ',', 1)), ''), peer, 'unknown') AS ip FROM request_log)"
oracle("client_ip", "SELECT event_id, ip FROM log", "request_log", also=[LOG])
oracle("request_rate", """SELECT event_id, ip, count(*) OVER (PARTITION BY ip ORDER BY ts RANGE BETWEEN INTERVAL '7199.999999 seconds' PRECEDING AND CURRENT ROW) AS requests FROM log""", "request_log", also=[LOG])
LIMITER = """WITH RECURSIVE request_log AS (%s), %s,
ranked AS (SELECT event_id, ip, epoch_us(ts) AS us, row_number() OVER (PARTITION BY ip ORDER BY ts, event_id) AS n FROM log),
run AS (
  SELECT event_id, ip, us, n, true AS allowed, CAST(0 AS BIGINT) AS retry_after, [us] AS ring FROM ranked WHERE n = 1
  UNION ALL
  SELECT event_id, ip, us, n, len(live) < 3, CASE WHEN len(live) < 3 THEN 0 ELSE greatest(1, CAST(ceil((live[1] + 7200000000 - us) / 1000000.0) AS BIGINT)) END,
         CASE WHEN len(live) < 3 THEN list_append(live, us) ELSE live END
  FROM (SELECT r.event_id, r.ip, r.us, r.n, list_filter(p.ring, lambda x: x > r.us - 7200000000) AS live FROM run p JOIN ranked r ON r.ip = p.ip AND r.n = p.n + 1))
SELECT event_id, ip, allowed, retry_after FROM run""" % (FIXTURE_SQL["request_log"][1], LOG)
ORACLES["rate_limit"] = LIMITER
ORACLES["rate_limit_stream"] = LIMITER
ORACLES["rate_limit_keyed"] = f"SELECT *, CAST(NULL AS VARCHAR) AS reason FROM ({LIMITER})"

# --- dimension files ----------------------------------------------------------------
oracle("read_gazetteer", "SELECT c_name AS name, (c_custkey % 300 - 170)::DOUBLE AS w, -35::DOUBLE AS s, (c_custkey % 300 - 150)::DOUBLE AS e, 45.5::DOUBLE AS n FROM customer")
oracle("read_event_catalog", """SELECT c_name AS id, c_name AS name, c_mktsegment || ',dust' AS aliases, (c_custkey % 300 - 170)::DOUBLE AS w,
  '2020-06-' || lpad((c_custkey % 28 + 1)::VARCHAR, 2, '0') || ' 00:00:00' AS time_start,
  '2020-07-' || lpad((c_custkey % 28 + 1)::VARCHAR, 2, '0') || ' 00:00:00' AS time_end, (c_custkey % 3)::BIGINT AS n_plans,
  CASE WHEN c_custkey % 3 > 0 THEN c_mktsegment END AS first_variable FROM customer""")
oracle("read_colormaps", """SELECT 'ramp ' || p_partkey AS colormap, k::BIGINT AS position, k / 2.0::DOUBLE AS t,
  (CASE k WHEN 0 THEN 0 WHEN 1 THEN (p_partkey >> 16) & 255 ELSE 255 END)::BIGINT AS r, (CASE k WHEN 1 THEN (p_partkey >> 8) & 255 ELSE 0 END)::BIGINT AS g,
  (CASE k WHEN 0 THEN 255 WHEN 1 THEN p_partkey & 255 ELSE 0 END)::BIGINT AS b, 'AOD' AS units FROM part, (VALUES (0), (1), (2)) AS v(k)""")

# --- boxes of all sizes -------------------------------------------------------------
MIXED_ROWS = f"""SELECT CAST(request_id AS BIGINT) AS request_id, {STAMP.format('time')} AS time, lat, lon,
  CASE WHEN lon BETWEEN l_lo AND l_hi THEN 0 ELSE 1 END AS seg, round(value, 4) AS value
FROM mixed_boxes b JOIN fine_obs c ON b.variable = c.variable AND c.time BETWEEN CAST(day0 AS TIMESTAMP) + INTERVAL 6 HOUR AND CAST(day0 AS TIMESTAMP) + INTERVAL 30 HOUR
  AND lat BETWEEN s AND n AND (lon BETWEEN l_lo AND l_hi OR coalesce(lon BETWEEN r_lo AND r_hi, false))"""
for name in ("slice_covered", "slice_zoned"):
    oracle(name, MIXED_ROWS, "mixed_boxes", "fine_obs")
