"""Framework surface derived from annotated facts: components, endpoints, parameters, statements, dependencies.

Annotations are arrays of (name, arguments map<string, array<string>>, raw).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Annotation names and what they stand for.
COMPONENTS = {"Component": "component", "Controller": "controller", "Mapper": "mapper", "Repository": "repository", "RestController": "rest_controller", "Service": "service"}
MAPPINGS = {"DeleteMapping": "DELETE", "GetMapping": "GET", "PatchMapping": "PATCH", "PostMapping": "POST", "PutMapping": "PUT", "RequestMapping": None}
STATEMENTS = {
    "Delete": "delete", "DeleteProvider": "delete_provider", "Insert": "insert", "InsertProvider": "insert_provider",
    "Select": "select", "SelectProvider": "select_provider", "Update": "update", "UpdateProvider": "update_provider",
}
PARAMETERS = {
    "CookieValue": "cookie", "MatrixVariable": "matrix", "PathVariable": "path", "RequestAttribute": "attribute",
    "RequestBody": "body", "RequestHeader": "header", "RequestParam": "query", "RequestPart": "part",
}


def _map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def derive_components(types: DataFrame) -> DataFrame:
    """(file_path, name, annotation, component): a row for each known annotation of a type."""
    rows = types.select("file_path", "name", F.explode("annotations").alias("a"))
    return rows.select("file_path", "name", F.col("a.name").alias("annotation"), F.try_element_at(_map(COMPONENTS), F.col("a.name")).alias("component")).filter("component is not null")


def join_paths(base: Column, path: Column) -> Column:
    """Both parts without slashes at their ends, joined; the root is ``/``."""
    parts = F.filter(F.array(*[F.regexp_replace(F.trim(p), "^/+|/+$", "") for p in (base, path)]), lambda x: x != "")
    return F.concat(F.lit("/"), F.array_join(parts, "/"))


def _paths(annotation: Column) -> Column:
    """Values of ``value`` and then ``path``; one empty path if there are none."""
    none = F.array().cast("array<string>")
    both = F.concat(*[F.coalesce(F.try_element_at(annotation["arguments"], F.lit(k)), none) for k in ("value", "path")])
    return F.when(F.size(both) > 0, both).otherwise(F.array(F.lit("")))


def http_methods(annotation: Column) -> Column:
    """Fixed by the annotation; a bare mapping has those that it names, or ANY."""
    fixed = F.try_element_at(_map({k: v for k, v in MAPPINGS.items() if v}), annotation["name"])
    named = F.filter(F.transform(F.coalesce(F.try_element_at(annotation["arguments"], F.lit("method")), F.array().cast("array<string>")), lambda x: F.regexp_extract(x, r"RequestMethod\.([A-Z]+)", 1)), lambda x: x != "")
    return F.when(fixed.isNotNull(), F.array(fixed)).when(F.size(named) > 0, named).otherwise(F.array(F.lit("ANY")))


def derive_endpoints(types: DataFrame, methods: DataFrame) -> DataFrame:
    """(file_path, type, method, path, http_methods, ord, base_ord, path_ord): base paths of the type times paths of the method.

    Of mapped types of one name in a file the last counts; unmapped types have an empty base path.
    """
    known = list(MAPPINGS)
    mapped = types.withColumn("a", F.get(F.filter("annotations", lambda a: a["name"] == "RequestMapping"), F.lit(0))).filter("a is not null")
    bases = mapped.groupBy("file_path", F.col("name").alias("type")).agg(F.max_by(_paths(F.col("a")), "ord").alias("bases"))
    rows = methods.select("file_path", "type", F.col("name").alias("method"), "ord", F.explode("annotations").alias("a")).filter(F.col("a.name").isin(known))
    found = rows.join(bases, ["file_path", "type"], "left").select("file_path", "type", "method", "ord", http_methods(F.col("a")).alias("http_methods"), _paths(F.col("a")).alias("paths"), F.coalesce("bases", F.array(F.lit(""))).alias("bases"))
    based = found.select("*", F.posexplode("bases").alias("base_ord", "base")).select("*", F.posexplode("paths").alias("path_ord", "p"))
    return based.select("file_path", "type", "method", join_paths(F.col("base"), F.col("p")).alias("path"), "http_methods", "ord", "base_ord", "path_ord")


def endpoint_params(methods: DataFrame) -> DataFrame:
    """(file_path, type, method, pos, name, source, alias, required, default): by each parameter's first known annotation."""
    known = F.array(*[F.lit(x) for x in PARAMETERS])
    rows = methods.select("file_path", "type", F.col("name").alias("method"), F.posexplode("parameters").alias("pos", "p"))
    a = F.get(F.filter(F.col("p.annotations"), lambda x: F.array_contains(known, x["name"])), F.lit(0))
    first = lambda k: F.get(F.try_element_at(F.col("a.arguments"), F.lit(k)), F.lit(0))
    return rows.withColumn("a", a).select(
        "file_path", "type", "method", "pos", F.col("p.name").alias("name"), F.coalesce(F.try_element_at(_map(PARAMETERS), F.col("a.name")), F.lit("unknown")).alias("source"),
        F.coalesce(first("value"), first("name"), first("path")).alias("alias"), (F.lower(first("required")) == "true").alias("required"), first("defaultValue").alias("default"),
    )


def sql_refs(methods: DataFrame) -> DataFrame:
    """(file_path, type, method, operation, statement): texts of statement annotations, or the raw annotation if it has none."""
    rows = methods.select("file_path", "type", F.col("name").alias("method"), F.explode("annotations").alias("a"))
    texts = F.filter(F.flatten(F.map_values("a.arguments")), lambda x: ~x.isin("true", "false") & ~F.endswith(x, F.lit(".class")) & ~F.startswith(x, F.lit("RequestMethod.")))
    joined = F.array_join(texts, " ")
    return rows.select("file_path", "type", "method", F.try_element_at(_map(STATEMENTS), F.col("a.name")).alias("operation"), F.when(joined == "", F.col("a.raw")).otherwise(joined).alias("statement")).filter("operation is not null")


def component_deps(components: DataFrame, fields: DataFrame, params: DataFrame) -> DataFrame:
    """(owner, dep): distinct pairs of known components, where a field or parameter of one has the other's type."""
    known = components.select("name").distinct()
    uses = fields.select(F.col("type").alias("owner"), F.col("field_type").alias("dep")).union(params.select(F.col("type").alias("owner"), F.col("param_type").alias("dep"))).distinct()
    return uses.join(known.withColumnRenamed("name", "owner"), "owner", "left_semi").join(known.withColumnRenamed("name", "dep"), "dep", "left_semi")
