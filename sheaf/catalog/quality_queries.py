"""Queries over load samples, rasters, boxes and source texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import quality as Q
from . import recipes as R
from .registry import query, wide_table

_SAMPLES = """SELECT event_id AS ord, user_id % 4 AS concurrency, event_type AS path, CASE WHEN event_type = 'error' THEN 500 WHEN event_id % 50 = 0 THEN 404 ELSE 200 END AS status,
  value AS ms, event_type <> 'error' AS ok FROM <events>"""
SAMPLES_DUCK = R.duck(_SAMPLES)


def samples(spark, sf):
    return R.run(spark, sf, _SAMPLES, "events")


@query(
    "latency_percentiles",
    f"""SELECT concurrency, n AS requests, ms[1 + least(n - 1, CAST(floor(n * 0.5) AS BIGINT))] AS p50, ms[1 + least(n - 1, CAST(floor(n * 0.95) AS BIGINT))] AS p95, ms[n] AS max_ms
    FROM (SELECT concurrency, count(*) AS n, list_sort(list(ms)) AS ms FROM ({SAMPLES_DUCK}) GROUP BY concurrency)""",
)
def latency_percentiles(spark, sf):
    return Q.latency_percentiles(samples(spark, sf))


@query(
    "status_histogram",
    f"""SELECT s.concurrency, string_agg(status || ':' || n, ',' ORDER BY status) AS statuses, CAST(sum(n) AS BIGINT) AS requests, CAST(sum(bad) AS BIGINT) AS errors, any_value(f.paths) AS failed_paths
    FROM (SELECT concurrency, status, count(*) AS n, count(*) FILTER (NOT ok) AS bad FROM ({SAMPLES_DUCK}) GROUP BY concurrency, status) AS s
    JOIN (SELECT concurrency, array_to_string((list(path || '#' || ord ORDER BY ord) FILTER (NOT ok))[1:3], ',') AS paths FROM ({SAMPLES_DUCK}) GROUP BY concurrency) AS f ON f.concurrency = s.concurrency
    GROUP BY s.concurrency""",
)
def status_histogram(spark, sf):
    named = samples(spark, sf).withColumn("path", F.concat("path", F.lit("#"), F.col("ord").cast("string")))
    out = Q.status_histogram(named)
    entries = F.transform(F.map_entries("statuses"), lambda e: F.concat(e["key"].cast("string"), F.lit(":"), e["value"].cast("string")))
    return out.select("concurrency", F.array_join(entries, ",").alias("statuses"), "requests", "errors", F.array_join("failed_paths", ",").alias("failed_paths"))


_RASTERS = """SELECT a.vec_id, CASE WHEN a.vec_id % 10 = 0 THEN 8 ELSE 4 END AS width, 4 AS height, 4 AS channels, 4 AS ref_width, 4 AS ref_height, 4 AS ref_channels,
  {t1} AS actual, {t2} AS reference FROM <embeddings> AS a JOIN <embeddings> AS b ON b.vec_id = a.vec_id + 1"""
_SPARK_T = "transform({}.embedding, e -> CAST(floor(CAST(e AS DOUBLE) * 255) AS INT) + 128)"
_DUCK_T = "list_transform({}.embedding, lambda e: CAST(floor(CAST(e AS DOUBLE) * 255) AS INT) + 128)"
RASTERS = _RASTERS.replace("{t1}", _SPARK_T.format("a")).replace("{t2}", _SPARK_T.format("b"))
RASTERS_DUCK = R.duck(_RASTERS.replace("{t1}", _DUCK_T.format("a")).replace("{t2}", _DUCK_T.format("b")))


@query(
    "raster_diff",
    f"""WITH r AS ({RASTERS_DUCK}), d AS (SELECT vec_id, width = ref_width AS ok, unnest(generate_series(0, 63)) AS i, unnest(list_transform(list_zip(actual, reference), lambda p: abs(p[1] - p[2]))) AS d FROM r),
    p AS (SELECT vec_id, ok, i // 4 AS px, sum(d) AS s, max(d) AS m FROM d WHERE i % 4 < 3 GROUP BY ALL)
    SELECT vec_id, ok AS geometry_match, round(CASE WHEN ok THEN sum(s) / 255.0 / 48 ELSE 1 END, 6) AS mean_abs_error, round(CASE WHEN ok THEN count(*) FILTER (m > 24) / 16.0 ELSE 1 END, 6) AS changed_ratio
    FROM p GROUP BY vec_id, ok""",
)
def raster_diff(spark, sf):
    out = Q.raster_diff(R.run(spark, sf, RASTERS, "embeddings"))
    return out.select(
        "vec_id", "geometry_match", F.round("mean_abs_error", 6).alias("mean_abs_error"), F.round("changed_ratio", 6).alias("changed_ratio")
    )


def _boxes(at: str) -> str:
    e = {i: f"CAST({at.format(i)} AS DOUBLE)" for i in range(5)}
    return f"""SELECT vec_id, 250 + {e[0]} * 1200 AS x, 300 + {e[1]} * 1500 AS y, abs({e[2]}) * 1500 AS width, abs({e[3]}) * 1500 AS height, {e[4]} * 720 AS angle,
      CAST(CASE WHEN vec_id % 40 = 3 THEN 50 ELSE 612 END AS DOUBLE) AS page_width, CAST(CASE WHEN vec_id % 40 = 5 THEN 5000 ELSE 792 END AS DOUBLE) AS page_height FROM <embeddings>"""


BOXES = _boxes("element_at(embedding, {} + 1)")
BOXES_DUCK = R.duck(_boxes("embedding[{} + 1]"))


@query(
    "bounds_violations",
    f"""WITH b AS (SELECT *, abs(width * cos(radians(angle))) + abs(height * sin(radians(angle))) AS w, abs(width * sin(radians(angle))) + abs(height * cos(radians(angle))) AS h FROM ({BOXES_DUCK}))
    SELECT * FROM (SELECT vec_id, CASE WHEN page_width < 72 OR page_width > 4000 OR page_height < 72 OR page_height > 4000 THEN 'page-size'
      WHEN x + (width - w) / 2 < -0.5 OR y + (height - h) / 2 < -0.5 OR x + (width + w) / 2 > page_width + 0.5 OR y + (height + h) / 2 > page_height + 0.5 THEN 'outside' END AS problem FROM b)
    WHERE problem IS NOT NULL""",
)
def bounds_violations(spark, sf):
    return Q.bounds_violations(R.run(spark, sf, BOXES, "embeddings")).select("vec_id", "problem")


_SOURCE = """html || CASE page_id % 6 WHEN 0 THEN 'fetch (u); new  Worker(x)' WHEN 1 THEN 'new XMLHttpRequest(); WEBASSEMBLY' WHEN 2 THEN 'new WebSocket(a); prefetch(x)'
  WHEN 3 THEN 'navigator.sendBeacon(1); a.wasm' WHEN 4 THEN 'URL.createObjectURL(b); URL.revokeObjectURL(b)' ELSE 'HTTPS://e.example http://e.example' END"""


@query(
    "signal_counts",
    " UNION ALL ".join(
        f"SELECT '{name}' AS signal, CAST(sum(len(regexp_extract_all({_SOURCE}, '{pattern}'))) AS BIGINT) AS n FROM pages" for name, pattern in Q.SIGNALS.items()
    ),
)
def signal_counts(spark, sf):
    return Q.signal_counts(wide_table(spark, sf, "pages").select(F.expr(_SOURCE).alias("text")))
