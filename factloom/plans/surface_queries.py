"""Queries of the framework surface, on parts as annotated methods and brands as annotated types."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import surface as C
from .adapters import table

ANNOTATION = "struct<name:string,arguments:map<string,array<string>>,raw:string>"


def _annotation(name, **arguments):
    args = F.map_from_arrays(F.array(*[F.lit(k) for k in arguments]).cast("array<string>"), F.array(*arguments.values()).cast("array<array<string>>")) if arguments else F.create_map().cast("map<string,array<string>>")
    return F.struct(F.lit(name).alias("name") if isinstance(name, str) else name.alias("name"), args.alias("arguments"), F.concat(F.lit("@"), name if not isinstance(name, str) else F.lit(name)).alias("raw")).cast(ANNOTATION)


def _number():
    return F.replace("p_brand", F.lit("Brand#"), F.lit("")).cast("int")


def types(spark, sf_dir):
    n = _number()
    kind = F.element_at(F.array(*[F.lit(x) for x in ("Service", "Controller", "Mapper", "Other")]), n % 4 + 1)
    mapping = _annotation("RequestMapping", value=F.array(F.concat(F.lit("/b"), n), F.concat(F.lit("/v"), n)))
    own = table(spark, sf_dir, "part").select("p_brand").distinct()
    return own.select(F.lit("f").alias("file_path"), F.col("p_brand").alias("name"), n.alias("ord"), F.when(n % 3 == 0, F.array(_annotation(kind), mapping)).otherwise(F.array(_annotation(kind))).alias("annotations"))


def methods(spark, sf_dir):
    s, key = F.col("p_size") % 6, F.col("p_partkey")
    a = F.when(s == 0, F.array(_annotation("GetMapping", value=F.array(F.concat(F.lit("/m/"), key, F.lit("/")))))).when(s == 1, F.array(_annotation("PostMapping"))).when(s == 2, F.array(_annotation("RequestMapping", method=F.array(F.lit("RequestMethod.PUT")))))
    a = a.when(s == 3, F.array(_annotation("RequestMapping"))).when(s == 4, F.array(_annotation("Select", value=F.array(F.concat(F.lit("select * from t_"), key), F.lit("true"))))).otherwise(F.array().cast(f"array<{ANNOTATION}>"))
    q = F.col("p_size") % 4
    p = F.when(q == 0, F.array(_annotation("PathVariable", value=F.array(F.lit("id"))))).when(q == 1, F.array(_annotation("Other"), _annotation("RequestParam", required=F.array(F.lit("false")), defaultValue=F.array(F.lit("7"))))).when(q == 2, F.array(_annotation("RequestBody"))).otherwise(F.array().cast(f"array<{ANNOTATION}>"))
    return table(spark, sf_dir, "part").select(
        F.lit("f").alias("file_path"), F.col("p_brand").alias("type"), F.concat("p_name", F.lit("_"), key).alias("name"), key.alias("ord"), a.alias("annotations"), F.array(F.struct(F.lit("arg").alias("name"), p.alias("annotations"))).alias("parameters")
    )


def components(spark, sf_dir):
    return C.derive_components(types(spark, sf_dir))


def endpoints(spark, sf_dir):
    return C.derive_endpoints(types(spark, sf_dir), methods(spark, sf_dir)).withColumn("http_methods", F.array_join("http_methods", ","))


def endpoint_params(spark, sf_dir):
    return C.endpoint_params(methods(spark, sf_dir))


def sql_refs(spark, sf_dir):
    return C.sql_refs(methods(spark, sf_dir))


def component_deps(spark, sf_dir):
    n = _number()
    fields = table(spark, sf_dir, "part").select(F.col("p_brand").alias("type"), F.concat(F.lit("Brand#"), ((n + F.length("p_type")) % 25 + 1)).alias("field_type"))
    params = table(spark, sf_dir, "part").filter("p_size % 2 = 0").select(F.col("p_brand").alias("type"), F.concat(F.lit("Brand#"), F.col("p_size") % 25 + 1).alias("param_type"))
    return C.component_deps(C.derive_components(types(spark, sf_dir)), fields, params)


QUERIES = {f.__name__: f for f in (components, endpoints, endpoint_params, sql_refs, component_deps)}
TYPES = "t AS (SELECT DISTINCT p_brand AS name, replace(p_brand, 'Brand#', '')::INT AS n FROM part), c AS (SELECT name, n, ['Service', 'Controller', 'Mapper', 'Other'][n % 4 + 1] AS annotation FROM t)"
SQL = {
    "components": f"WITH {TYPES} SELECT 'f' AS file_path, name, annotation, lower(annotation) AS component FROM c WHERE annotation <> 'Other'",
    "endpoints": f"""WITH {TYPES}, m AS (SELECT p_brand AS type, p_name || '_' || p_partkey AS method, p_partkey AS ord, p_size % 6 AS s FROM part WHERE p_size % 6 < 4), b AS (SELECT name, 0 AS base_ord, '/b' || n AS base FROM t WHERE n % 3 = 0 UNION ALL SELECT name, 1, '/v' || n FROM t WHERE n % 3 = 0 UNION ALL SELECT name, 0, '' FROM t WHERE n % 3 <> 0)
      SELECT 'f' AS file_path, type, method, CASE WHEN base = '' AND s > 0 THEN '/' ELSE base || CASE WHEN s = 0 THEN '/m/' || ord ELSE '' END END AS path, ['GET', 'POST', 'PUT', 'ANY'][s + 1] AS http_methods, ord, base_ord, 0 AS path_ord FROM m JOIN b ON b.name = m.type""",
    "endpoint_params": """SELECT 'f' AS file_path, p_brand AS type, p_name || '_' || p_partkey AS method, 0 AS pos, 'arg' AS name, ['path', 'query', 'body', 'unknown'][p_size % 4 + 1] AS source, CASE WHEN p_size % 4 = 0 THEN 'id' END AS alias, CASE WHEN p_size % 4 = 1 THEN false END AS required, CASE WHEN p_size % 4 = 1 THEN '7' END AS "default" FROM part""",
    "sql_refs": "SELECT 'f' AS file_path, p_brand AS type, p_name || '_' || p_partkey AS method, 'select' AS operation, 'select * from t_' || p_partkey AS statement FROM part WHERE p_size % 6 = 4",
    "component_deps": f"""WITH {TYPES}, k AS (SELECT name FROM c WHERE annotation <> 'Other'), u AS (SELECT p_brand AS owner, 'Brand#' || ((replace(p_brand, 'Brand#', '')::INT + length(p_type)) % 25 + 1) AS dep FROM part UNION SELECT p_brand, 'Brand#' || (p_size % 25 + 1) FROM part WHERE p_size % 2 = 0)
      SELECT owner, dep FROM u WHERE owner IN (SELECT name FROM k) AND dep IN (SELECT name FROM k)""",
}
