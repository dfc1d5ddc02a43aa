"""Queries of route matching."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import routes as R
from .adapters import table


def _endpoints(spark, sf_dir):
    path = F.regexp_replace(F.regexp_extract("url", r"^https?://[^/]*([^?#]*)", 1), "[0-9]+", "{id}")
    own = table(spark, sf_dir, "pages").select(path.alias("raw")).distinct().filter("raw <> ''")
    lang = F.element_at(R.segments(F.col("raw")), 1)
    methods = F.when(lang == "en", F.array(F.lit("GET"))).when(lang == "fr", F.array(F.lit("GET"), F.lit("POST"))).when(lang == "de", F.array(F.lit("ANY"))).otherwise(F.array(F.lit("DELETE")))
    return own.select("raw", F.col("raw").alias("endpoint_id"), F.col("raw").alias("ord"), methods.alias("methods"), R.normalize_route(F.when(lang == "fr", F.concat(F.lit("/api"), "raw")).otherwise(F.col("raw"))).alias("path"))


def _calls(spark, sf_dir):
    p, i = F.regexp_extract("url", r"^https?://[^/]*(.*)$", 1), F.col("page_id")
    raw = F.when(i % 7 == 0, F.regexp_replace(p, r"[0-9]+([^0-9]*)$", "\\${id}$1")).when(i % 7 == 1, F.regexp_replace(p, r"[0-9]+([^0-9]*)$", ":id$1")).otherwise(p)
    raw = F.when(i % 2 == 0, F.concat(F.lit("/api"), raw)).otherwise(raw)
    norm = R.normalize_route(raw)
    method = F.element_at(F.array(*[F.lit(m) for m in ("GET", "POST", "UNKNOWN", "DELETE")]), (i % 4 + 1).cast("int"))
    return table(spark, sf_dir, "pages").select(i.alias("call_id"), method.alias("method"), raw.alias("raw"), F.when(i % 11 == 0, F.concat(norm, F.lit("/extra"))).otherwise(norm).alias("path"))


def api_path(spark, sf_dir):
    value = F.when(F.col("page_id") % 5 == 0, F.regexp_replace("url", r"^(https?://[^/]*)(.*)$", "$1/api$2")).otherwise(F.regexp_extract("url", r"^https?://[^/]*(.*)$", 1))
    return table(spark, sf_dir, "pages").select("page_id", R.api_path(value).alias("path"))


def route_normalize(spark, sf_dir):
    return _calls(spark, sf_dir).select("call_id", "path", F.size(R.segments(F.col("path"))).alias("n_segments"))


def route_candidates(spark, sf_dir):
    return R.route_candidates(_calls(spark, sf_dir), _endpoints(spark, sf_dir))


def route_map(spark, sf_dir):
    return R.map_routes(_calls(spark, sf_dir), _endpoints(spark, sf_dir))


def route_summary(spark, sf_dir):
    return R.route_summary(route_map(spark, sf_dir))


QUERIES = {f.__name__: f for f in (api_path, route_normalize, route_candidates, route_map, route_summary)}
NORM = r"regexp_replace(regexp_replace('/' || regexp_replace(regexp_replace(regexp_replace(trim(split_part({0}, '?', 1)), '\$\{{[^}}]+\}}', '{{param}}', 'g'), '<([^>/]+)>', '{{\1}}', 'g'), ':([A-Za-z_][A-Za-z0-9_-]*)', '{{\1}}', 'g'), '/+', '/', 'g'), '(.)/+$', '\1')"
BASE = r"""e0 AS (SELECT DISTINCT regexp_replace(regexp_extract(url, '^https?://[^/]*([^?#]*)', 1), '[0-9]+', '{id}', 'g') AS raw FROM pages),
e AS (SELECT raw AS endpoint_id, raw AS ord, CASE lang WHEN 'en' THEN ['GET'] WHEN 'fr' THEN ['GET', 'POST'] WHEN 'de' THEN ['ANY'] ELSE ['DELETE'] END AS methods, NORM(CASE WHEN lang = 'fr' THEN '/api' || raw ELSE raw END) AS path FROM (SELECT raw, list_filter(string_split(raw, '/'), lambda x: x <> '')[1] AS lang FROM e0 WHERE raw <> '')),
p AS (SELECT page_id, regexp_extract(url, '^https?://[^/]*(.*)$', 1) AS p FROM pages),
c0 AS (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN '/api' ELSE '' END || CASE page_id % 7 WHEN 0 THEN regexp_replace(p, '[0-9]+([^0-9]*)$', '${id}\1') WHEN 1 THEN regexp_replace(p, '[0-9]+([^0-9]*)$', ':id\1') ELSE p END AS raw FROM p),
c AS (SELECT page_id AS call_id, ['GET', 'POST', 'UNKNOWN', 'DELETE'][page_id % 4 + 1] AS method, NORM(raw) || CASE WHEN page_id % 11 = 0 THEN '/extra' ELSE '' END AS path FROM c0),
cv AS (SELECT call_id, 0 AS v, path, 'direct' AS s FROM c UNION ALL SELECT call_id, 1, CASE WHEN path = '/api' THEN '/' ELSE path[5:] END, 'x' FROM c WHERE path = '/api' OR starts_with(path, '/api/')),
ev AS (SELECT endpoint_id, 0 AS v, path, 'direct' AS s FROM e UNION ALL SELECT endpoint_id, 1, CASE WHEN path = '/api' THEN '/' ELSE path[5:] END, 'x' FROM e WHERE path = '/api' OR starts_with(path, '/api/')),
m AS (SELECT call_id, endpoint_id, cv.v AS vc, ev.v AS ve, cv.s AS sc, ev.s AS se, list_transform(list_zip(list_filter(string_split(cv.path, '/'), lambda x: x <> ''), list_filter(string_split(ev.path, '/'), lambda x: x <> '')), lambda z: CASE WHEN z[1] = z[2] THEN 2 WHEN regexp_matches(z[1], '^(\{.*\}|<.*>)$') OR regexp_matches(z[2], '^(\{.*\}|<.*>)$') THEN 1 ELSE -1000 END) AS pts
  FROM cv JOIN ev ON len(list_filter(string_split(cv.path, '/'), lambda x: x <> '')) = len(list_filter(string_split(ev.path, '/'), lambda x: x <> ''))),
cand AS (SELECT call_id, endpoint_id, score::INT AS score, CASE WHEN sc = 'direct' AND se = 'direct' THEN 'direct' ELSE 'api_prefix_stripped' END AS strategy FROM (
  SELECT *, coalesce(list_sum(pts), 0) AS score, row_number() OVER (PARTITION BY call_id, endpoint_id ORDER BY vc, ve) AS r FROM m WHERE coalesce(list_sum(pts), 0) >= 0) WHERE r = 1),
best AS (SELECT * FROM (SELECT cand.*, fits, row_number() OVER (PARTITION BY cand.call_id ORDER BY fits DESC, score DESC, ord) AS r FROM (SELECT cand.*, ord, method = 'UNKNOWN' OR list_contains(methods, 'ANY') OR list_contains(methods, method) AS fits FROM cand JOIN e USING (endpoint_id) JOIN c USING (call_id)) cand) WHERE r = 1),
mapped AS (SELECT c.call_id, CASE WHEN fits THEN 'matched' WHEN fits IS NOT NULL THEN 'method_mismatch' ELSE 'unmatched' END AS status, CASE WHEN fits AND method <> 'UNKNOWN' THEN 'high' WHEN fits IS NOT NULL THEN 'medium' ELSE 'low' END AS confidence, endpoint_id, coalesce(strategy, 'none') AS strategy FROM c LEFT JOIN best ON best.call_id = c.call_id)"""
for _raw in ("CASE WHEN lang = 'fr' THEN '/api' || raw ELSE raw END", "raw"):
    BASE = BASE.replace(f"NORM({_raw})", NORM.format(_raw))
SQL = {
    "api_path": r"""WITH v AS (SELECT page_id, CASE WHEN page_id % 5 = 0 THEN regexp_replace(url, '^(https?://[^/]*)(.*)$', '\1/api\2') ELSE regexp_extract(url, '^https?://[^/]*(.*)$', 1) END AS v FROM pages),
      b AS (SELECT page_id, CASE WHEN regexp_matches(v, '^https?://') THEN regexp_replace(regexp_replace(v, '^https?://[^/?#]*', ''), '#.*$', '') ELSE v END AS b FROM v)
      SELECT page_id, CASE WHEN starts_with(b, '/api') THEN b WHEN starts_with(b, './api') THEN b[2:] END AS path FROM b""",
    "route_normalize": f"WITH {BASE} SELECT call_id, path, len(list_filter(string_split(path, '/'), lambda x: x <> ''))::INT AS n_segments FROM c",
    "route_candidates": f"WITH {BASE} SELECT * FROM cand",
    "route_map": f"WITH {BASE} SELECT * FROM mapped",
    "route_summary": f"WITH {BASE} SELECT count(*) AS calls, count(*) FILTER (status = 'matched') AS matched, count(*) FILTER (status = 'method_mismatch') AS method_mismatch, count(*) FILTER (status = 'unmatched') AS unmatched FROM mapped",
}
