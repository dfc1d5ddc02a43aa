"""Queries of facts and of the property graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import facts as B
from ..operators import graph as L
from .adapters import CORPUS, FACTS, FULL_FACTS, LINES, analyses, corpus, facts, full_analyses, table


def fact_flatten(spark, sf_dir):
    return B.flatten_facts(full_analyses(spark, sf_dir))


def fact_counts(spark, sf_dir):
    return B.count_by_type(facts(spark, sf_dir))


def fact_page(spark, sf_dir):
    return B.page_facts(facts(spark, sf_dir), "call", limit=200, offset=1000).select("key", "type", "file_path", "symbol_name", "start_line", "total")


def file_metrics(spark, sf_dir):
    return B.file_metrics(analyses(spark, sf_dir), {"calls": "calls"}, "calls.flag", "calls.start_line")


def line_counts(spark, sf_dir):
    return corpus(spark, sf_dir).select("id", B.line_count(F.col("text")).alias("n_lines"))


def project_totals(spark, sf_dir):
    metrics = B.file_metrics(analyses(spark, sf_dir), {"calls": "calls"}, "calls.flag", "calls.start_line").join(analyses(spark, sf_dir).select("file_path", "package"), "file_path")
    return B.project_totals(metrics, ["n_calls"], "package")


def rel_path(spark, sf_dir):
    return corpus(spark, sf_dir).select("id", B.relative_path(F.col("file_path"), "src0").alias("path"))


def attach_enclosing(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    types = o.select(F.concat(F.lit("c"), "o_custkey").alias("file_path"), F.concat(F.lit("o"), "o_orderkey").alias("name"), (F.col("o_orderkey") % 50).cast("int").alias("start_line"), (F.col("o_orderkey") % 50 + F.col("o_orderkey") % 700).cast("int").alias("end_line"))
    spans = table(spark, sf_dir, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.concat(F.lit("c"), "o_custkey").alias("file_path"), F.concat(F.lit("p"), "l_partkey").alias("id")).agg((F.min("l_linenumber") * 40).alias("start_line")).withColumn("end_line", F.col("start_line") + 5)
    return B.attach_enclosing(spans, types)


def graph_nodes(spark, sf_dir):
    return L.graph_nodes(facts(spark, sf_dir))


def graph_edges(spark, sf_dir):
    return L.graph_edges(facts(spark, sf_dir))


def graph_overview(spark, sf_dir):
    f = facts(spark, sf_dir)
    return L.graph_overview(L.graph_nodes(f), L.graph_edges(f))


def graph_search(spark, sf_dir):
    return L.graph_search(facts(spark, sf_dir), "O1", "method", limit=50, offset=5).select("key", "file_path", "symbol_name", "total")


def graph_relations(spark, sf_dir):
    f = facts(spark, sf_dir)
    return L.graph_relations(L.graph_edges(f), f, "OWNS_BEHAVIOR")


def chain_summary(spark, sf_dir):
    f = facts(spark, sf_dir)
    return L.chain_summary(f, L.graph_edges(f))


def chain_detail(spark, sf_dir):
    f = facts(spark, sf_dir)
    return L.chain_detail(f.filter("type = 'endpoint'").select("key"), f, L.graph_edges(f))


def method_chain(spark, sf_dir):
    f = facts(spark, sf_dir)
    return L.method_chain(f.filter("type = 'method'").select("key"), f, L.graph_edges(f))


def file_chain(spark, sf_dir):
    f = facts(spark, sf_dir)
    return L.file_chain(f.select(F.col("file_path").alias("path")).distinct(), f, L.graph_edges(f))


QUERIES = {f.__name__: f for f in (fact_flatten, fact_counts, fact_page, file_metrics, line_counts, project_totals, rel_path, attach_enclosing, graph_nodes, graph_edges, graph_overview, graph_search, graph_relations, chain_summary, chain_detail, method_chain, file_chain)}
NODES = """nodes AS (SELECT DISTINCT project_id AS id, 'project' AS label, project_id, '' AS type FROM facts UNION ALL SELECT DISTINCT file_path, 'file', project_id, '' FROM facts UNION ALL SELECT DISTINCT key, 'record', project_id, type FROM facts)"""
EDGES = """edges AS MATERIALIZED (
  SELECT project_id AS src, 'HAS_RECORD' AS type, key AS dst, project_id FROM facts UNION SELECT file_path, 'CONTAINS', key, project_id FROM facts
  UNION SELECT p.key, 'ENCLOSES', c.key, c.project_id FROM facts c JOIN facts p ON p.type = 'type' AND p.project_id = c.project_id AND p.file_path = c.file_path AND p.symbol_name = c.enclosing_type WHERE c.enclosing_type <> '' AND p.key <> c.key
  UNION SELECT p.key, 'OWNS_BEHAVIOR', c.key, c.project_id FROM facts c JOIN facts p ON p.type = 'method' AND p.project_id = c.project_id AND p.file_path = c.file_path AND p.symbol_name = c.enclosing_method WHERE c.enclosing_method <> '' AND c.type IN ('call', 'return', 'control_structure', 'local_variable'))"""
GRAPH = f"{FACTS}, {NODES}, {EDGES}"
METRICS = f"""lines AS ({LINES}), m AS (SELECT 'o' || o_orderkey AS file_path, any_value(o_orderpriority) AS package, count(l_orderkey) AS n_calls, coalesce(max(l_linenumber), 0) AS max_depth FROM orders LEFT JOIN lines ON o_orderkey = l_orderkey GROUP BY o_orderkey),
  hist AS (SELECT 'o' || l_orderkey AS file_path, string_agg(l_returnflag || ':' || n, ',' ORDER BY l_returnflag) AS histogram FROM (SELECT l_orderkey, l_returnflag, count(*) AS n FROM lines GROUP BY 1, 2) GROUP BY l_orderkey)"""
SQL = {
    "fact_flatten": f"WITH {FULL_FACTS} SELECT * FROM full_facts",
    "fact_counts": f"WITH {FACTS} SELECT type, count(*) AS n FROM facts GROUP BY type",
    "fact_page": f"WITH {FACTS} SELECT key, type, file_path, symbol_name, start_line, count(*) OVER () AS total FROM facts WHERE type = 'call' ORDER BY type, file_path, start_line, key LIMIT 200 OFFSET 1000",
    "file_metrics": f"WITH {METRICS} SELECT m.file_path, n_calls::INT AS n_calls, max_depth, coalesce(histogram, '') AS histogram FROM m LEFT JOIN hist USING (file_path)",
    "line_counts": f"WITH corpus AS ({CORPUS}) SELECT id, (length(text) - length(replace(text, chr(10), '')) + CASE WHEN suffix(text, chr(10)) THEN 0 ELSE 1 END)::INT AS n_lines FROM corpus",
    "project_totals": f"WITH {METRICS} SELECT count(*) AS n_files, sum(n_calls)::BIGINT AS n_calls, string_agg(DISTINCT package, ',' ORDER BY package) AS packages FROM m",
    "rel_path": f"WITH corpus AS ({CORPUS}) SELECT id, CASE WHEN starts_with(file_path, 'src0/') THEN substr(file_path, 6) ELSE file_path END AS path FROM corpus",
    "attach_enclosing": """WITH t AS (SELECT 'c' || o_custkey AS file_path, 'o' || o_orderkey AS name, o_orderkey % 50 AS a, o_orderkey % 50 + o_orderkey % 700 AS b FROM orders),
      s AS (SELECT 'c' || o_custkey AS file_path, 'p' || l_partkey AS id, min(l_linenumber) * 40 AS start_line, min(l_linenumber) * 40 + 5 AS end_line FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)
      SELECT s.file_path, s.id, start_line, end_line, (SELECT name FROM t WHERE t.file_path = s.file_path AND a <= start_line AND b >= end_line ORDER BY b - a, a, name LIMIT 1) AS enclosing FROM s""",
    "graph_nodes": f"WITH {GRAPH} SELECT * FROM nodes",
    "graph_edges": f"WITH {GRAPH} SELECT * FROM edges",
    "graph_overview": f"WITH {GRAPH} SELECT 'total' AS section, label || 's' AS name, count(*) AS n FROM nodes GROUP BY 2 UNION ALL SELECT 'record', type, count(*) FROM nodes WHERE label = 'record' GROUP BY 2 UNION ALL SELECT 'edge', type, count(*) FROM edges GROUP BY 2",
    "graph_search": f"WITH {FACTS} SELECT key, file_path, symbol_name, count(*) OVER () AS total FROM facts WHERE type = 'method' AND contains(lower(concat_ws(chr(10), key, file_path, symbol_name, enclosing_type, enclosing_method)), 'o1') ORDER BY type, file_path, start_line, key LIMIT 50 OFFSET 5",
    "graph_relations": f"WITH {GRAPH}, page AS (SELECT * FROM edges WHERE type = 'OWNS_BEHAVIOR' ORDER BY type, src, dst LIMIT 500) SELECT src, page.type, dst, a.symbol_name AS src_name, b.symbol_name AS dst_name FROM page JOIN facts a ON a.key = src JOIN facts b ON b.key = dst",
    "chain_summary": f"""WITH {GRAPH}, own AS (SELECT src, dst FROM edges WHERE type = 'OWNS_BEHAVIOR'),
      e AS (SELECT 'endpoint' AS type, e.key, e.symbol_name AS title, count(DISTINCT m.key) + count(DISTINCT own.dst) AS n FROM facts e LEFT JOIN facts m ON m.type = 'method' AND m.file_path = e.file_path AND m.symbol_name = e.symbol_name LEFT JOIN own ON own.src = m.key WHERE e.type = 'endpoint' GROUP BY e.key, e.symbol_name, e.file_path, e.start_line ORDER BY e.file_path, e.start_line, e.key LIMIT 300),
      m AS (SELECT 'method' AS type, m.key, m.symbol_name AS title, count(DISTINCT own.dst) AS n FROM facts m LEFT JOIN own ON own.src = m.key WHERE m.type = 'method' GROUP BY m.key, m.symbol_name, m.file_path, m.start_line ORDER BY n DESC, m.file_path, m.start_line, m.key LIMIT 300),
      f AS (SELECT 'file' AS type, src AS key, src AS title, count(DISTINCT dst) AS n FROM edges WHERE type = 'CONTAINS' GROUP BY src ORDER BY n DESC, src LIMIT 300)
      SELECT type, key, title, n + 1 AS n_nodes, n AS n_relations FROM (SELECT * FROM e UNION ALL SELECT * FROM m UNION ALL SELECT * FROM f) ORDER BY n DESC, title, type, key LIMIT 100""",
    "method_chain": f"""WITH {GRAPH}, m AS (SELECT key, file_path FROM facts WHERE type = 'method'), o AS (SELECT m.key AS chain, dst, row_number() OVER (PARTITION BY m.key ORDER BY f.start_line, dst) AS n FROM m JOIN edges ON edges.type = 'OWNS_BEHAVIOR' AND src = m.key JOIN facts f ON f.key = dst)
      SELECT key AS chain, file_path AS src, 'CONTAINS' AS type, key AS dst FROM m WHERE file_path <> '' UNION SELECT chain, chain, 'OWNS_BEHAVIOR', dst FROM o WHERE n <= 120 AND chain <> dst""",
    "file_chain": f"""WITH {GRAPH}, h AS (SELECT src AS chain, dst, row_number() OVER (PARTITION BY src ORDER BY f.start_line, f.type, dst) AS n FROM edges JOIN facts f ON f.key = dst WHERE edges.type = 'CONTAINS') SELECT DISTINCT chain, chain AS src, 'CONTAINS' AS type, dst FROM h WHERE n <= 160 AND chain <> dst AND chain <> ''""",
    "chain_detail": f"""WITH {GRAPH}, e AS (SELECT * FROM facts WHERE type = 'endpoint'), m AS (SELECT e.key AS chain, f.key AS method FROM e JOIN facts f ON f.type = 'method' AND f.file_path = e.file_path AND f.symbol_name = e.symbol_name),
      o AS (SELECT chain, method, dst, row_number() OVER (PARTITION BY chain ORDER BY f.start_line, dst, method) AS n FROM m JOIN edges ON edges.type = 'OWNS_BEHAVIOR' AND src = method JOIN facts f ON f.key = dst)
      SELECT key AS chain, file_path AS src, 'CONTAINS' AS type, key AS dst FROM e UNION SELECT chain, chain, 'HANDLES', method FROM m UNION SELECT chain, method, 'OWNS_BEHAVIOR', dst FROM o WHERE n <= 120""",
}
