"""Tables of the engine's own shapes, derived from the star-schema test tables.

The SQL is plain enough to run unchanged in other engines too; ``fixture`` runs it here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# name: (source table, SQL over it)
FIXTURE_SQL: dict[str, tuple[str, str]] = {
    "grid_obs": ("events", """
SELECT CASE event_type WHEN 'click' THEN 'DUEXTTAU' WHEN 'view' THEN 'TOTEXTTAU'
            WHEN 'purchase' THEN 'BCEXTTAU' WHEN 'signup' THEN 'SUEXTTAU' ELSE 'SSEXTTAU' END AS variable,
       date_trunc('hour', ts) + INTERVAL '30' MINUTE AS time,
       CAST(-60 + 30 * (event_id % 5) AS DOUBLE) AS lat,
       CAST(-180 + 45 * (user_id % 9) AS DOUBLE) AS lon,
       AVG(CASE WHEN event_id % 47 = 0 THEN NULL ELSE value / 97.31 END) AS value
FROM events GROUP BY 1, 2, 3, 4"""),
    "grid_fine": ("events", """
SELECT CAST(-90 + 0.5 * (event_id % 361) AS DOUBLE) AS lat,
       CAST(-180 + 0.625 * ((event_id * 7) % 576) AS DOUBLE) AS lon,
       AVG(value / 97.31) AS value
FROM events GROUP BY 1, 2"""),
    "fine_obs": ("events", """
SELECT CASE event_type WHEN 'click' THEN 'DUEXTTAU' WHEN 'view' THEN 'TOTEXTTAU'
            WHEN 'purchase' THEN 'BCEXTTAU' WHEN 'signup' THEN 'SUEXTTAU' ELSE 'SSEXTTAU' END AS variable,
       date_trunc('hour', ts) + INTERVAL '30' MINUTE AS time,
       CAST(-90 + 0.5 * (event_id % 361) AS DOUBLE) AS lat,
       CAST(-180 + 0.625 * ((event_id * 7) % 576) AS DOUBLE) AS lon,
       AVG(value / 97.31) AS value
FROM events GROUP BY 1, 2, 3, 4"""),
    "mixed_boxes": ("customer", """
SELECT c_custkey AS request_id,
       CASE c_custkey % 3 WHEN 0 THEN 'DUEXTTAU' WHEN 1 THEN 'TOTEXTTAU' ELSE 'BCEXTTAU' END AS variable,
       CAST(CASE WHEN c_custkey % 50 = 0 THEN -90 ELSE -90 + c_custkey % 170 END AS DOUBLE) AS s,
       CAST(CASE WHEN c_custkey % 50 = 0 THEN 90 ELSE -90 + c_custkey % 170 + 1 + c_custkey % 7 END AS DOUBLE) AS n,
       CAST(CASE WHEN c_custkey % 50 = 0 THEN -180 WHEN c_custkey % 11 = 0 THEN 178 ELSE -180 + (c_custkey * 7) % 350 END AS DOUBLE) AS l_lo,
       CAST(CASE WHEN c_custkey % 50 = 0 OR c_custkey % 11 = 0 THEN 180 ELSE -180 + (c_custkey * 7) % 350 + 1 + c_custkey % 9 END AS DOUBLE) AS l_hi,
       CAST(CASE WHEN c_custkey % 50 <> 0 AND c_custkey % 11 = 0 THEN -180 END AS DOUBLE) AS r_lo,
       CAST(CASE WHEN c_custkey % 50 <> 0 AND c_custkey % 11 = 0 THEN -176 END AS DOUBLE) AS r_hi,
       DATE '2024-01-01' + CAST(c_custkey % 29 AS INT) AS day0
FROM customer"""),
    "grid_history": ("orders", """
SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 'DUEXTTAU' WHEN '2-HIGH' THEN 'BCEXTTAU' ELSE 'TOTEXTTAU' END AS variable,
       o_orderdate AS time,
       CAST(-60 + 30 * (o_orderkey % 5) AS DOUBLE) AS lat,
       CAST(-180 + 45 * (o_custkey % 9) AS DOUBLE) AS lon,
       AVG(CASE WHEN o_orderkey % 47 = 0 THEN NULL ELSE o_totalprice / 97310.7 END) AS value
FROM orders GROUP BY 1, 2, 3, 4"""),
    "grid_requests": ("nation", """
SELECT n_nationkey AS request_id,
       CASE WHEN n_nationkey = 24 THEN 'cams' ELSE 'merra2' END AS source,
       CASE WHEN n_nationkey = 19 THEN 'FOO' WHEN n_nationkey % 3 = 0 THEN ' duaod '
            WHEN n_nationkey % 3 = 1 THEN 'TOTEXTTAU' ELSE 'bcexttau' END AS variable,
       CASE WHEN n_nationkey = 20 THEN 'w;s;e;n' WHEN n_nationkey = 21 THEN '20,35,50,15'
            WHEN n_nationkey % 4 = 3 THEN '150,-40,-120,20'
            ELSE concat(CAST(-170 + 10 * n_nationkey AS VARCHAR(8)), ',-35,', CAST(-100 + 10 * n_nationkey AS VARCHAR(8)), ',45') END AS bbox,
       CASE WHEN n_nationkey = 18 THEN '2023-05-01' WHEN n_nationkey = 22 THEN '2024-01-20T00:00:00Z'
            ELSE '2024-01-03T12:00:00Z' END AS t0,
       CASE WHEN n_nationkey = 18 THEN '2023-05-02' WHEN n_nationkey % 2 = 0 THEN '2024-01-09T23:59:59Z'
            ELSE '2024-01-10T01:30:00+02:00' END AS t1,
       CASE WHEN n_nationkey = 23 THEN 'weekly' WHEN n_nationkey % 3 = 0 THEN 'daily'
            WHEN n_nationkey % 3 = 1 THEN 'hourly' ELSE 'monthly_mean' END AS agg
FROM nation"""),
    "manifest": ("events", """
SELECT DISTINCT CAST(ts AS DATE) AS day,
       concat('MERRA2_400.tavg1_2d_aer_Nx.', replace(CAST(CAST(ts AS DATE) AS VARCHAR(10)), '-', ''), '.json') AS ref_name
FROM events WHERE extract(day FROM ts) NOT IN (6, 13)"""),
    "customer_requests": ("customer", """
SELECT c_custkey AS request_id,
       CASE WHEN c_custkey % 41 = 0 THEN 'cams' ELSE 'merra2' END AS source,
       CASE WHEN c_custkey % 37 = 0 THEN 'FOO' WHEN c_custkey % 31 = 0 THEN 'OCEXTTAU' WHEN c_custkey % 3 = 0 THEN ' duaod '
            WHEN c_custkey % 3 = 1 THEN 'TOTEXTTAU' ELSE 'bcexttau' END AS variable,
       CASE WHEN c_custkey % 29 = 0 THEN 'w;s;e;n' WHEN c_custkey % 23 = 0 THEN '20,35,50,15' WHEN c_custkey % 19 = 0 THEN '-190,0,10,10'
            WHEN c_custkey % 17 = 0 THEN '180,-35,180,45' WHEN c_custkey % 13 = 0 THEN '7,3,11,9' WHEN c_custkey % 4 = 3 THEN '150,-40,-120,20'
            ELSE concat(CAST(-170 + 10 * (c_custkey % 25) AS VARCHAR(8)), ',-35,', CAST(-100 + 10 * (c_custkey % 25) AS VARCHAR(8)), ',45') END AS bbox,
       CASE WHEN c_custkey % 43 = 0 THEN '2023-05-01' WHEN c_custkey % 47 = 0 THEN '2024-01-20T00:00:00Z' WHEN c_custkey % 53 = 0 THEN 'soon'
            WHEN c_custkey % 59 = 0 THEN '2024-05-20' ELSE '2024-01-03T12:00:00Z' END AS t0,
       CASE WHEN c_custkey % 43 = 0 THEN '2023-05-02' WHEN c_custkey % 59 = 0 THEN '2024-05-21' WHEN c_custkey % 61 = 0 THEN '2024-01-03T12:00:01Z'
            WHEN c_custkey % 2 = 0 THEN '2024-01-09T23:59:59Z' ELSE '2024-01-10T01:30:00+02:00' END AS t1,
       CASE WHEN c_custkey % 67 = 0 THEN 'weekly' WHEN c_custkey % 3 = 0 THEN 'daily'
            WHEN c_custkey % 3 = 1 THEN 'hourly' ELSE 'monthly_mean' END AS agg
FROM customer"""),
    "box_texts": ("customer", """
SELECT c_custkey AS box_id,
       CASE c_custkey % 9 WHEN 0 THEN 'a,b,c,d' WHEN 1 THEN '0,10,10' WHEN 2 THEN '-181,0,10,10' WHEN 3 THEN '0,-91,10,10'
            WHEN 4 THEN '20,35,50,15' WHEN 5 THEN '170,-40,-120,20' WHEN 6 THEN ' 1.5 , -2e1,3.25,+7 ' WHEN 7 THEN '1,2,3,4,5'
            ELSE concat(CAST(-170 + 10 * c_nationkey AS VARCHAR(8)), ',-35,', CAST(-100 + 10 * c_nationkey AS VARCHAR(8)), ',45.5') END AS bbox
FROM customer"""),
    "time_texts": ("events", """
SELECT event_id,
       CASE event_id % 8
            WHEN 0 THEN CAST(CAST(ts AS DATE) AS VARCHAR(10))
            WHEN 1 THEN concat(CAST(CAST(ts AS DATE) AS VARCHAR(10)), 'T07:08:09Z')
            WHEN 2 THEN concat(CAST(CAST(ts AS DATE) AS VARCHAR(10)), ' 07:08')
            WHEN 3 THEN concat(CAST(CAST(ts AS DATE) AS VARCHAR(10)), 'T01:08:09.123456+02:00')
            WHEN 4 THEN concat(CAST(CAST(ts AS DATE) AS VARCHAR(10)), 'T22:08:09-05:30')
            WHEN 5 THEN '2024-13-01' WHEN 6 THEN '12:30' ELSE '2024' END AS text
FROM events"""),
    "event_questions": ("customer", """
SELECT c_custkey AS question_id,
       concat(CASE c_custkey % 7 WHEN 0 THEN 'Show the Godzilla   Dust' WHEN 1 THEN 'How bad was hunga-tonga? And the August complex fire'
                   WHEN 2 THEN '2020 Saharan dust plumes' WHEN 3 THEN 'the 2020 california wildfires' WHEN 4 THEN 'Tonga eruption'
                   WHEN 5 THEN 'june 2020 dust and godzilla dust' ELSE 'smog' END,
              ' in ', c_mktsegment) AS text
FROM customer"""),
    "chunk_rows": ("events", """
SELECT CAST(CAST(ts AS DATE) AS VARCHAR(10)) AS path,
       CASE event_type WHEN 'click' THEN 'DUEXTTAU' WHEN 'view' THEN 'TOTEXTTAU'
            WHEN 'purchase' THEN 'BCEXTTAU' WHEN 'signup' THEN 'SUEXTTAU' ELSE 'lat' END AS variable,
       CAST(extract(hour FROM ts) AS INT) AS ct,
       CAST(floor((event_id % 361) / 91) AS INT) AS cy,
       CAST(floor(((event_id * 7) % 576) / 144) AS INT) AS cx,
       MIN(event_id) * 100 AS offset, COUNT(*) * 1000 AS length
FROM events GROUP BY 1, 2, 3, 4, 5"""),
    "places": ("nation", """
SELECT n_name AS name, CAST(-170 + 12 * n_nationkey AS DOUBLE) AS w, CAST(-60 + 4 * n_nationkey AS DOUBLE) AS s,
       CAST(-150 + 12 * n_nationkey AS DOUBLE) AS e, CAST(-40 + 4 * n_nationkey AS DOUBLE) AS n
FROM nation"""),
    "place_aliases": ("nation", """
SELECT concat('land of ', lower(n_name)) AS alias,
       CASE WHEN n_nationkey = 8 THEN 'Nowhere' ELSE n_name END AS canonical
FROM nation WHERE n_nationkey % 2 = 0"""),
    "drafts": ("customer", """
SELECT c_custkey AS draft_id,
       CASE c_custkey % 3 WHEN 0 THEN 'health' WHEN 1 THEN 'plume' ELSE 'comparison' END AS intent,
       CASE WHEN c_custkey % 5 < 3 THEN 'surface' ELSE 'column' END AS level,
       CASE c_custkey % 7 WHEN 0 THEN 'google' WHEN 1 THEN 'cams' ELSE 'merra2' END AS source,
       CASE c_custkey % 4 WHEN 0 THEN 'PM25' WHEN 1 THEN ' totaod ' WHEN 2 THEN 'suaod' ELSE 'DUEXTTAU' END AS variable,
       CASE WHEN c_custkey % 11 = 0 THEN 'Atlantis'
            WHEN c_custkey % 11 = 1 THEN concat('Land of nation_', CAST(c_nationkey AS VARCHAR(8)))
            ELSE concat(' nation_', CAST(c_nationkey AS VARCHAR(8)), ' ') END AS place,
       1 + (c_custkey * 37) % 2000 AS span_days,
       CASE c_custkey % 3 WHEN 0 THEN 'hourly' WHEN 1 THEN 'daily' ELSE 'monthly_mean' END AS aggregation
FROM customer"""),
    "questions": ("events", """
SELECT event_id AS question_id, ts,
       concat(CAST(CAST(ts AS DATE) AS VARCHAR(10)), '|', CAST(user_id % 5 AS VARCHAR(4))) AS scope,
       event_id % 13 <> 0 AS ok,
       concat(CASE event_id % 3 WHEN 0 THEN '  Show ' WHEN 1 THEN 'show  ' ELSE 'SHOW ' END,
              CASE event_type WHEN 'click' THEN 'Saharan dust' WHEN 'view' THEN 'dust' WHEN 'purchase' THEN 'wildfire smoke'
                   WHEN 'signup' THEN 'PM2.5' ELSE 'ozone' END,
              CASE event_id % 2 WHEN 0 THEN ' today?!' ELSE ' today' END) AS text
FROM events"""),
    "request_log": ("events", """
SELECT event_id, ts,
       CASE WHEN event_id % 10 = 0 THEN NULL WHEN event_id % 10 = 1 THEN ' , 10.9.9.9'
            ELSE concat(' 10.0.0.', CAST(user_id % 8 AS VARCHAR(4)), ' , 70.41.3.18') END AS xff,
       CASE WHEN event_id % 20 = 0 THEN NULL ELSE concat('192.168.0.', CAST(user_id % 8 AS VARCHAR(4))) END AS peer
FROM events"""),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One derived table; cells come with their ``day`` and zone-free times."""
    source, sql = FIXTURE_SQL[name]
    df = spark.sql(sql.replace(f"FROM {source}", "FROM {src}"), src=table(spark, sf_dir, source))
    if "time" in df.columns:
        df = df.withColumn("time", F.col("time").cast("timestamp_ntz")).withColumn("day", F.to_date("time"))
    if name == "grid_fine":
        df = df.withColumn("request_id", F.lit(0)).withColumn("seg", F.lit(0))
    return df
