"""From the given tables to the shapes that the operators take, as DataFrames and as SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.facts import FACTS as FACT_LISTS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


CORPUS = """
  SELECT 'doc:' || d.doc_id AS id, d.doc_id AS ord, coalesce(text, '') AS text, lang AS kind, source || '/' || d.doc_id || '.md' AS file_path,
    CASE d.doc_id % 3 WHEN 0 THEN 'code' WHEN 1 THEN 'kb' ELSE 'knowledge_asset' END AS source_type,
    CASE WHEN toxic = 1 THEN 'stale' WHEN quality = 1 THEN 'confirmed' WHEN quality = 0 THEN 'draft' ELSE 'pending_review' END AS status
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id"""


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as searchable chunks."""
    d, l = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "l_doc")  # noqa: E741
    kind = F.col("doc_id") % 3
    return d.join(l, d["doc_id"] == l["l_doc"], "left").select(
        F.concat(F.lit("doc:"), "doc_id").alias("id"), F.col("doc_id").alias("ord"), F.coalesce("text", F.lit("")).alias("text"), F.col("lang").alias("kind"),
        F.concat("source", F.lit("/"), "doc_id", F.lit(".md")).alias("file_path"),
        F.when(kind == 0, "code").when(kind == 1, "kb").otherwise("knowledge_asset").alias("source_type"),
        F.when(F.col("toxic") == 1, "stale").when(F.col("quality") == 1, "confirmed").when(F.col("quality") == 0, "draft").otherwise("pending_review").alias("status"),
    )


def query_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, text) of the benchmark items."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.coalesce("text", F.lit("")).alias("text"))


LINES = """
  SELECT l_orderkey, l_partkey, l_linenumber, l_returnflag, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax, l_shipdate) - 1 AS idx FROM lineitem"""
FACTS = f"""
  lines AS ({LINES}),
  home AS (SELECT c_custkey, c_name, r_name AS project_id, 'r' || r_regionkey || '/n' || n_nationkey || '.src' AS file_path FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
  facts AS MATERIALIZED (
    SELECT r_name AS project_id, 'r' || r_regionkey || '/n' || n_nationkey || '.src' AS key, 'file' AS type, 'r' || r_regionkey || '/n' || n_nationkey || '.src' AS file_path, '' AS symbol_name, '' AS enclosing_type, '' AS enclosing_method, 0 AS start_line, 0 AS end_line FROM nation JOIN region ON n_regionkey = r_regionkey
    UNION ALL SELECT project_id, file_path || '::type::' || c_name || '::' || c_custkey, 'type', file_path, c_name, '', '', 1, 999 FROM home
    UNION ALL SELECT project_id, file_path || '::method::' || c_name || '::o' || o_orderkey, 'method', file_path, 'o' || o_orderkey, c_name, '', 1, 7 FROM orders JOIN home ON o_custkey = c_custkey
    UNION ALL SELECT project_id, file_path || '::endpoint::o' || o_orderkey, 'endpoint', file_path, 'o' || o_orderkey, c_name, '', 1, 1 FROM orders JOIN home ON o_custkey = c_custkey WHERE o_orderpriority = '1-URGENT'
    UNION ALL SELECT project_id, file_path || '::call::' || c_name || '::o' || o_orderkey || '::p' || l_partkey || '::' || idx, 'call', file_path, 'p' || l_partkey, c_name, 'o' || o_orderkey, l_linenumber, l_linenumber
      FROM lines JOIN orders ON l_orderkey = o_orderkey JOIN home ON o_custkey = c_custkey
  )"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with their place in the order's list."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_shipdate")) - 1
    return table(spark, sf_dir, "lineitem").withColumn("idx", place).select("l_orderkey", "l_partkey", "l_linenumber", "l_returnflag", "idx")


def call_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of :func:`lines` that calls have. Lines of one number and part give the same calls, so nothing else needs to order them."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")) - 1
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber").withColumn("idx", place)


def analyses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as nested analyses: a file for each order with its lines as calls."""
    own = lines(spark, sf_dir).groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("idx", "l_partkey", "l_linenumber", "l_returnflag"))).alias("c"))
    calls = F.transform("c", lambda x: F.struct(F.concat(F.lit("p"), x["l_partkey"]).alias("name"), x["l_linenumber"].alias("start_line"), x["l_returnflag"].alias("flag")))
    none = F.array().cast("array<struct<name:string,start_line:int,flag:string>>")
    return table(spark, sf_dir, "orders").join(own, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(F.concat(F.lit("o"), "o_orderkey").alias("file_path"), F.col("o_orderpriority").alias("package"), F.coalesce(calls, none).alias("calls"))


#: For each fact type the remainder by 4 of the line numbers that fill its list, and the fields of all elements, from a line item.
KINDS = {kind: i % 4 for i, kind in enumerate(FACT_LISTS)}
ELEMENT = {
    "name": "'p' || l_partkey", "enclosing_type": "'T' || (l_partkey % 2)", "enclosing_method": "CASE WHEN l_linenumber % 3 = 0 THEN '' ELSE 'p' || (l_partkey % 3) END", "method_name": "'p' || (l_partkey % 3)", "kind": "l_returnflag",
    "path": "'/p' || (l_partkey % 9)", "expression": "'return ' || l_linenumber", "start_line": "l_linenumber", "end_line": "l_linenumber + 2",
    "modifiers": "split('public ' || l_returnflag, ' ')", "annotation": "'@A' || l_returnflag", "interfaces": "split('I' || (l_partkey % 5) || ',J', ',')", "superclass": "CASE WHEN l_partkey % 2 = 0 THEN 'Base' ELSE '' END", "http_methods": "split('GET,POST', ',')",
    "operation": "'select'", "statement": "'select ' || l_partkey", "condition": "CASE WHEN l_partkey % 2 = 0 THEN 'x > ' || l_linenumber ELSE '' END", "arguments": "split('a,' || l_linenumber, ',')",
}


def full_analyses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as analyses with metrics and all thirteen lists, which their line items fill; some orders have no path or no metrics, and lists can be null or empty."""
    fields = ", ".join(f"{value} AS {name}" for name, value in ELEMENT.items())
    rows = lines(spark, sf_dir).select("l_orderkey", "idx", "l_linenumber", F.expr(f"struct({fields})").alias("e"))
    own = rows.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("idx", "l_linenumber", "e"))).alias("c"))
    joined = table(spark, sf_dir, "orders").join(own, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    elements = lambda r: F.transform(F.filter("c", lambda x: x["l_linenumber"] % 4 == r), lambda x: x["e"])
    lists = {FACT_LISTS[kind][0]: elements(r) for kind, r in KINDS.items()}
    metrics = F.when(F.col("o_orderkey") % 3 != 0, F.struct(F.size(F.coalesce("c", F.array().cast(own.schema["c"].dataType))).alias("lines"), (F.col("o_orderkey") % 10).alias("depth")))
    path = F.when(F.col("o_orderkey") % 7 != 0, F.concat(F.lit("o"), "o_orderkey"))
    return joined.select(path.alias("file_path"), F.col("o_orderpriority").alias("package"), (F.col("o_orderkey") % 5 == 0).alias("has_error"), metrics.alias("metrics"), *[x.alias(name) for name, x in lists.items()])


def _key_sql(kind: str) -> str:
    return " || ".join([f"{p} || '::'" for p in FACT_LISTS[kind][1]] or ["''"])


FULL_FACTS = f"""
  lines AS ({LINES}),
  kinds AS (SELECT * FROM (VALUES {', '.join(f"('{k}', {r})" for k, r in KINDS.items())}) AS v(fact, r)),
  heads AS (SELECT *, CASE WHEN o_orderkey % 7 <> 0 THEN 'o' || o_orderkey ELSE '' END AS file_path, CASE WHEN o_orderkey % 7 <> 0 THEN 'o' || o_orderkey ELSE '<memory>' END AS root FROM orders),
  sizes AS (SELECT l_orderkey, count(*) AS n FROM lines GROUP BY 1),
  elements AS (SELECT l_orderkey, fact, {', '.join(f'{value} AS {name}' for name, value in ELEMENT.items())}, row_number() OVER (PARTITION BY l_orderkey, fact ORDER BY idx) - 1 AS i FROM lines JOIN kinds ON l_linenumber % 4 = r),
  full_facts AS MATERIALIZED (
    SELECT root AS key, 'file' AS type, file_path, o_orderpriority AS package, '' AS symbol_name, '' AS enclosing_type, '' AS enclosing_method, 0 AS start_line, 0 AS start_column, 0 AS end_line, 0 AS end_column,
      to_json({{'filePath': file_path, 'package': o_orderpriority, 'hasError': o_orderkey % 5 = 0}})::VARCHAR AS payload, -1 AS ord FROM heads
    UNION ALL SELECT root || '::metrics', 'metrics', file_path, o_orderpriority, '', '', '', 0, 0, 0, 0, to_json({{'lines': coalesce(n, 0), 'depth': o_orderkey % 10}})::VARCHAR, -1 FROM heads LEFT JOIN sizes ON l_orderkey = o_orderkey WHERE o_orderkey % 3 <> 0
    UNION ALL SELECT root || '::' || fact || '::' || CASE fact {' '.join(f"WHEN '{k}' THEN {_key_sql(k)}" for k in KINDS)} END || i, fact, file_path, o_orderpriority, name, enclosing_type, enclosing_method, start_line::INT, 0, end_line::INT, 0,
      to_json({{{', '.join(f"'{name}': {name}" for name in ELEMENT)}}})::VARCHAR, i::INT FROM elements JOIN heads ON o_orderkey = l_orderkey)"""


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as files, customers as types, orders as methods, urgent orders as endpoints, line items as calls."""
    t = lambda name: table(spark, sf_dir, name)
    path = F.concat(F.lit("r"), "r_regionkey", F.lit("/n"), "n_nationkey", F.lit(".src"))
    nations = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("r_name").alias("project_id"), path.alias("file_path"))
    home = t("customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_name", "project_id", "file_path")
    own = t("orders").join(home, F.col("o_custkey") == F.col("c_custkey")).withColumn("o", F.concat(F.lit("o"), "o_orderkey"))
    calls = call_lines(spark, sf_dir).join(own, F.col("l_orderkey") == F.col("o_orderkey"))
    none = F.lit("")

    def fact(df, kind, parts, symbol, enclosing=none, method=none, start=0, end=0):
        number = lambda x: x.cast("int") if hasattr(x, "cast") else F.lit(x)
        key = F.concat_ws("::", "file_path", F.lit(kind), *parts) if parts else F.col("file_path")
        return df.select("project_id", key.alias("key"), F.lit(kind).alias("type"), "file_path", symbol.alias("symbol_name"), enclosing.alias("enclosing_type"), method.alias("enclosing_method"), number(start).alias("start_line"), number(end).alias("end_line"))

    name, o, part, line = F.col("c_name"), F.col("o"), F.concat(F.lit("p"), "l_partkey"), F.col("l_linenumber")
    out = fact(nations, "file", [], none)
    for df in (
        fact(home, "type", [name, F.col("c_custkey").cast("string")], name, start=1, end=999),
        fact(own, "method", [name, o], o, name, start=1, end=7),
        fact(own.filter("o_orderpriority = '1-URGENT'"), "endpoint", [o], o, name, start=1, end=1),
        fact(calls, "call", [name, o, part, F.col("idx").cast("string")], part, name, o, line, line),
    ):
        out = out.unionByName(df)
    return out
