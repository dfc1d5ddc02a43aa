"""Queries of the call graph and of lineage."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import callgraph as D
from ..operators import lineage as E
from ..sources.work import kept
from .adapters import CORPUS, corpus, table

CALLS = """
  methods AS MATERIALIZED (SELECT p_partkey AS id, p_partkey AS ord, p_partkey AS line, p_brand || '' AS type, p_name || CASE WHEN p_partkey % 97 = 0 THEN '_' || p_partkey ELSE '' END AS name, p_size, p_type || '' AS p_type FROM part),
  lines AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax, l_shipdate) - 1 AS idx FROM lineitem),
  named AS (SELECT list(type ORDER BY id) AS ty, list(name ORDER BY id) AS na, list(p_type ORDER BY id) AS pt, list(p_size ORDER BY id) AS ps, count(*) AS n FROM methods),
  calls AS MATERIALIZED (
    SELECT l_orderkey || ':' || idx AS call_id, ty[l_partkey + 1] AS type, na[l_partkey + 1] AS method, na[q + 1] AS name, l_partkey + l_linenumber AS line, l_orderkey * 100 + idx AS ord, l_orderkey, l_linenumber,
      CASE l_linenumber WHEN 1 THEN '' WHEN 2 THEN 'this' WHEN 3 THEN ty[q + 1] WHEN 4 THEN 'f_' || pt[l_partkey + 1] WHEN 5 THEN 'a.b.' || ty[q + 1] WHEN 6 THEN 'q_' || (ps[l_partkey + 1] % 5) ELSE 'zzz' END AS qualifier
    FROM (SELECT *, (l_partkey * 7 + l_suppkey) % n AS q FROM lines CROSS JOIN named))"""


def methods(spark, sf_dir):
    name = F.concat("p_name", F.when(F.col("p_partkey") % 97 == 0, F.concat(F.lit("_"), "p_partkey")).otherwise(""))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_partkey").alias("ord"), F.col("p_partkey").alias("line"), F.col("p_brand").alias("type"), name.alias("name"), "p_size", "p_type")


def _lines(spark, sf_dir):
    """Line items with their place in the order. The columns that would order them further tell no calls apart."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")) - 1
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").withColumn("idx", place)


def _placed(lines, m):
    """Lines as calls inside the method of their part; parts, a thirtieth of the lines, are the hashed side."""
    own = m.select(F.col("id").alias("l_partkey"), "type", F.col("name").alias("method"), "p_size", "p_type").hint("shuffle_hash")
    at = {"call_id": F.concat("l_orderkey", F.lit(":"), "idx"), "line": F.col("l_partkey") + F.col("l_linenumber"), "ord": F.col("l_orderkey") * 100 + F.col("idx")}
    return lines.join(own, "l_partkey").withColumns(at)


def calls(spark, sf_dir):
    m = methods(spark, sf_dir)
    called = m.select(F.col("id").alias("q_id"), F.col("type").alias("q_type"), "name").hint("shuffle_hash")
    lines = _lines(spark, sf_dir).withColumn("q_id", (F.col("l_partkey") * 7 + F.col("l_suppkey")) % m.count())
    joined = _placed(lines.join(called, "q_id").select("l_orderkey", "l_partkey", "l_linenumber", "idx", "q_type", "name"), m)
    n = F.col("l_linenumber")
    qualifier = F.when(n == 1, "").when(n == 2, "this").when(n == 3, F.col("q_type")).when(n == 4, F.concat(F.lit("f_"), "p_type")).when(n == 5, F.concat(F.lit("a.b."), "q_type")).when(n == 6, F.concat(F.lit("q_"), F.col("p_size") % 5)).otherwise("zzz")
    return joined.select("call_id", "type", "method", "name", "line", "ord", "l_orderkey", "l_linenumber", qualifier.alias("qualifier"))


def _brand(number):
    return F.concat(F.lit("Brand#"), (number % 25 + 1).cast("string"))


def _fields(spark, sf_dir):
    number = F.replace("p_brand", F.lit("Brand#"), F.lit("")).cast("int")
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias("type"), F.concat(F.lit("f_"), "p_type").alias("field"), _brand(number + F.length("p_type")).alias("field_type")).distinct()


def _params(spark, sf_dir):
    own = methods(spark, sf_dir).filter("p_size % 2 = 0").select("type", F.col("name").alias("method"), F.concat(F.lit("q_"), F.col("p_size") % 5).alias("param"), _brand(F.col("p_size")).alias("param_type"), "ord")
    return own.groupBy("type", "method", "param").agg(F.max_by("param_type", "ord").alias("param_type"))


def _resolved(spark, sf_dir, own=None):
    refs = D.method_refs(methods(spark, sf_dir))
    return D.resolve_calls(D.attribute_callers(calls(spark, sf_dir) if own is None else own, refs), refs, _fields(spark, sf_dir), _params(spark, sf_dir))


def _ends(spark, sf_dir):
    """Attributed and resolved calls with the qualified names of both ends; ``dst`` is null where unresolved."""
    dst = F.when(F.col("callee").isNotNull(), F.concat_ws(".", "callee_type", "name"))
    return _resolved(spark, sf_dir).withColumns({"src": F.concat_ws(".", "type", "method"), "dst": dst})


def _called(spark, sf_dir):
    return _ends(spark, sf_dir).filter("dst is not null").select("src", "dst", "ord")


def _edges(spark, sf_dir):
    """All resolved calls by qualified names, written once for the queries that walk along them."""
    return kept(_called(spark, sf_dir), "edges")


def _endpoints(spark, sf_dir):
    return methods(spark, sf_dir).filter("p_size % 6 = 0").select(F.col("id").alias("endpoint_id"), "type", "name")


def _usages(spark, sf_dir):
    return methods(spark, sf_dir).filter("p_size % 6 = 4").select(
        F.col("type").alias("owner_type"), F.col("name").alias("method"), F.lit("select").alias("operation"),
        F.concat(F.lit("select * from t_"), F.lower("p_type"), F.lit(" join s."), "type", F.lit(" x")).alias("statement"), F.concat("type", F.lit(".src")).alias("file_path"), F.col("line").cast("int").alias("line"),
    ).withColumn("statement", F.replace("statement", F.lit("#"), F.lit("_")))


def caller_nearest(spark, sf_dir):
    m = methods(spark, sf_dir)
    return D.attribute_callers(_placed(_lines(spark, sf_dir), m).select("call_id", "type", "method", "line"), D.method_refs(m)).select("call_id", "caller")


def method_lookup(spark, sf_dir):
    refs = D.method_refs(methods(spark, sf_dir))
    return D.method_lookup(refs).withColumnRenamed("id", "last_id").join(D.method_lookup(refs, "first").withColumnRenamed("id", "first_id"), ["type", "name"])


def call_resolution(spark, sf_dir):
    return _resolved(spark, sf_dir).select("call_id", "caller", "callee", "resolution")


def resolution_stats(spark, sf_dir):
    return D.resolution_stats(_resolved(spark, sf_dir))


def _entries(spark, sf_dir, edges):
    return D.entrypoints(_endpoints(spark, sf_dir), D.method_refs(methods(spark, sf_dir)), edges)


def entrypoints(spark, sf_dir):
    return _entries(spark, sf_dir, _called(spark, sf_dir))


def call_chains(spark, sf_dir):
    edges = _edges(spark, sf_dir)
    return D.call_chains(edges, _entries(spark, sf_dir, edges))


def call_sites(spark, sf_dir):
    """Chains of all calls, the unresolved ones too, with the sites of their calls."""
    calls = kept(_ends(spark, sf_dir).select("src", D.shown_callee(F.col("dst"), F.col("name")).alias("dst"), "ord", F.concat("type", F.lit(".src")).alias("file_path"), "line", F.col("name").alias("call"), F.col("dst").isNotNull().alias("resolved")), "sites")
    found = D.call_sites(D.call_chains(calls, _entries(spark, sf_dir, calls.filter("resolved")), with_calls=True), calls)
    return found.select("n", "entry", "chain", F.array_join("sites.place", ",").alias("places"), F.array_join("sites.call", ",").alias("calls"))


def reachable_paths(spark, sf_dir):
    edges = _edges(spark, sf_dir)
    return D.reachable_paths(edges, _entries(spark, sf_dir, edges)).select("entry", "node", F.array_join("path", " -> ").alias("path"))


def extract_tables(spark, sf_dir):
    return corpus(spark, sf_dir).select("id", F.array_join(E.extract_tables(F.col("text")), ",").alias("tables"))


def usages(spark, sf_dir):
    return E.sql_usages(_usages(spark, sf_dir)).withColumn("tables", F.array_join("tables", ","))


def annotation_usages(spark, sf_dir):
    refs = _usages(spark, sf_dir).withColumn("owner_type", F.when(F.col("line") % 11 == 0, "").when(F.col("line") % 5 == 0, F.lit("Elsewhere")).otherwise(F.col("owner_type")))
    types = table(spark, sf_dir, "part").select(F.col("p_brand").alias("name"), F.concat("p_type", F.lit("/"), F.col("p_partkey") % 13).alias("file_path"), F.col("p_partkey").alias("ord"))
    return E.usages_from_annotations(refs, types)


def _flows(spark, sf_dir):
    owned = E.sql_usages(_usages(spark, sf_dir)).select(F.concat_ws(".", "owner_type", "method").alias("owner"), "statement", "tables").distinct()
    edges = _edges(spark, sf_dir)
    ends = _entries(spark, sf_dir, edges).select("entry", F.concat(F.lit("/"), "entry").alias("endpoint_path")).distinct()
    return E.endpoint_flows(ends, D.reachable_paths(edges, ends, targets=owned.select(F.col("owner").alias("node"))), owned), edges, ends


def endpoint_flows(spark, sf_dir):
    return _flows(spark, sf_dir)[0]


def flow_nodes(spark, sf_dir):
    return E.flow_nodes(_flows(spark, sf_dir)[0])


def flow_graph(spark, sf_dir):
    flows, edges, ends = _flows(spark, sf_dir)
    return E.flow_graph(flows, D.call_chains(edges, ends) if flows.isEmpty() else None)


def capped_flows(spark, sf_dir):
    return E.capped(_flows(spark, sf_dir)[0], ["endpoint_path", "code_path", "owner", "statement"])


QUERIES = {f.__name__: f for f in (caller_nearest, method_lookup, call_resolution, resolution_stats, entrypoints, call_chains, reachable_paths, extract_tables, usages, annotation_usages, endpoint_flows, flow_graph, flow_nodes, call_sites, capped_flows)}
RESOLVED = f"""{CALLS},
  near AS (SELECT call_id, arg_min(m.id, abs(m.line - c.line) * 1000000000 + m.ord) AS caller FROM calls c JOIN methods m ON m.type = c.type AND m.name = c.method GROUP BY call_id),
  attributed AS (SELECT c.*, caller FROM calls c JOIN near USING (call_id)),
  lookup AS (SELECT type, name, max(id) AS last_id, min(id) AS first_id, count(*) AS n FROM methods GROUP BY 1, 2),
  uniq AS (SELECT name, min(id) AS id FROM methods GROUP BY name HAVING count(*) = 1),
  fields AS (SELECT DISTINCT p_brand AS type, 'f_' || p_type AS field, 'Brand#' || ((replace(p_brand, 'Brand#', '')::INT + length(p_type)) % 25 + 1) AS field_type FROM part),
  params AS (SELECT type, name AS method, 'q_' || (p_size % 5) AS param, arg_max('Brand#' || (p_size % 25 + 1), ord) AS param_type FROM methods WHERE p_size % 2 = 0 GROUP BY 1, 2, 3),
  q AS (SELECT a.*, string_split(qualifier, '.')[-1] AS q FROM attributed a),
  targeted AS (SELECT q.*, CASE WHEN q IN ('', 'this', 'super') THEN q.type WHEN q IN (SELECT type FROM methods) THEN q WHEN field_type IS NOT NULL THEN field_type ELSE param_type END AS target,
    CASE WHEN q IN ('', 'this', 'super') THEN 'same_type' WHEN q IN (SELECT type FROM methods) THEN 'static_type' WHEN field_type IS NOT NULL THEN 'field_type' ELSE 'parameter_type' END AS label
    FROM q LEFT JOIN fields ON fields.type = q.type AND field = q LEFT JOIN params ON params.type = q.type AND params.method = q.method AND param = q),
  resolved AS (SELECT call_id, caller, ord, l_orderkey, l_linenumber, coalesce(last_id, CASE WHEN q = '' THEN uniq.id END) AS callee, CASE WHEN last_id IS NOT NULL THEN label WHEN q = '' AND uniq.id IS NOT NULL THEN 'unique_method' ELSE 'unresolved' END AS resolution
    FROM targeted LEFT JOIN lookup ON lookup.type = target AND lookup.name = targeted.name LEFT JOIN uniq ON uniq.name = targeted.name),
  edges AS (SELECT a.type || '.' || a.name AS src, b.type || '.' || b.name AS dst, r.ord FROM resolved r JOIN methods a ON a.id = caller JOIN methods b ON b.id = callee),
  entries AS (SELECT DISTINCT m.type || '.' || m.name AS entry, first_id AS line FROM methods m JOIN lookup USING (type, name) WHERE p_size % 6 = 0)"""
def _hops(depth: int) -> str:
    """Chains hop by hop: an entry's first 80 prefixes hold its first 80 chains."""
    hops = ["hop0 AS (SELECT entry, [entry] AS nodes, CAST([] AS BIGINT[]) AS path, entry AS src, false AS closes FROM (SELECT DISTINCT entry FROM entries) WHERE entry IN (SELECT src FROM edges))"]
    for k in range(1, depth + 1):
        hops.append(f"""hop{k} AS MATERIALIZED (SELECT entry, nodes, path, src, closes FROM (SELECT entry, list_append(nodes, dst) AS nodes, list_append(path, ord) AS path, dst AS src, list_contains(nodes, dst) AS closes,
      row_number() OVER (PARTITION BY entry ORDER BY list_append(path, ord)) AS r FROM hop{k - 1} JOIN edges USING (src) WHERE NOT closes) WHERE r <= 80)""")
    return ",\n  ".join(hops)


def _levels(depth: int) -> str:
    """Breadth-first search hop by hop: every new node's parent is the one discovered first."""
    levels = ["first_edges AS MATERIALIZED (SELECT src, dst, min(ord) AS ord FROM edges GROUP BY 1, 2)", "level0 AS MATERIALIZED (SELECT DISTINCT entry, entry AS node, [entry] AS nodes, 1::BIGINT AS rank FROM entries)", "seen0 AS (SELECT entry, node, nodes FROM level0)"]
    for k in range(1, depth + 1):
        levels.append(f"""level{k} AS MATERIALIZED (SELECT n.entry, n.node, list_append(p.nodes, n.node) AS nodes, row_number() OVER (PARTITION BY n.entry ORDER BY n.by) AS rank
    FROM (SELECT entry, dst AS node, min((rank, ord)) AS by, arg_min(src, (rank, ord)) AS src FROM level{k - 1} JOIN first_edges ON node = src GROUP BY 1, 2) n JOIN level{k - 1} p ON p.entry = n.entry AND p.node = n.src
    WHERE NOT EXISTS (SELECT 1 FROM seen{k - 1} s WHERE s.entry = n.entry AND s.node = n.node))""")
        levels.append(f"seen{k} AS MATERIALIZED (SELECT * FROM seen{k - 1} UNION ALL SELECT entry, node, nodes FROM level{k})")
    return ",\n  ".join(levels) + f",\n  reach AS (SELECT * FROM seen{depth})"


CHAINS = f"""{RESOLVED}, {_hops(4)},
  chains AS (SELECT entry, nodes, path FROM hop4 UNION ALL SELECT entry, nodes, path FROM (SELECT * FROM hop1 UNION ALL SELECT * FROM hop2 UNION ALL SELECT * FROM hop3) WHERE closes OR src NOT IN (SELECT src FROM edges))"""
REACH = f"""{RESOLVED}, {_levels(6)}"""
TABLES = r"""(list_filter(list_transform(regexp_extract_all({0}, '(?i)(?:^|[^A-Za-z0-9_])(?:from|join|into|update)[\x20\x09-\x0D]+([`"\[]?[A-Za-z_][A-Za-z0-9_$]*(?:\.[A-Za-z_][A-Za-z0-9_$]*)?[`"\]]?)', 1), lambda x: regexp_replace(x, '[`"\[\]]', '', 'g')), lambda x: lower(x) NOT IN ('select', 'set', 'where')))"""
USAGES = """usages AS (SELECT type AS owner_type, name AS method, 'select' AS operation, replace('select * from t_' || lower(p_type) || ' join s.' || type || ' x', '#', '_') AS statement, 't_' || lower(p_type) || ',s.' || replace(type, '#', '_') AS tables, type || '.src' AS file_path, line::INT AS line FROM methods WHERE p_size % 6 = 4)"""
FLOWS = f"""{REACH}, {USAGES}, owned AS (SELECT DISTINCT owner_type || '.' || method AS owner, statement, tables FROM usages),
  flows AS (SELECT '/' || entry AS endpoint_path, entry AS handler, array_to_string(nodes, ' -> ') AS code_path, owner, statement, tables FROM reach JOIN owned ON owner = node)"""
SQL = {
    "caller_nearest": f"WITH {RESOLVED} SELECT call_id, caller FROM attributed",
    "method_lookup": f"WITH {RESOLVED} SELECT type, name, last_id, first_id FROM lookup",
    "call_resolution": f"WITH {RESOLVED} SELECT call_id, caller, callee, resolution FROM resolved",
    "resolution_stats": f"WITH {RESOLVED} SELECT resolution, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM resolved GROUP BY resolution",
    "entrypoints": f"WITH {RESOLVED} SELECT entry, line FROM entries",
    "call_chains": f"WITH RECURSIVE {CHAINS} SELECT n::INT AS n, entry, array_to_string(nodes, ' -> ') AS chain FROM (SELECT *, row_number() OVER (ORDER BY entry, path) AS n FROM chains) WHERE n <= 80",
    "call_sites": f"""WITH RECURSIVE {RESOLVED}, sites AS (SELECT a.type || '.' || a.name AS src, coalesce(b.type || '.' || b.name, c.name || ' ?') AS dst, r.ord, a.type || '.src:' || c.line AS place, c.name AS call FROM resolved r JOIN calls c USING (call_id) JOIN methods a ON a.id = r.caller LEFT JOIN methods b ON b.id = callee),
      {_hops(4).replace("JOIN edges USING", "JOIN sites USING").replace("SELECT src FROM edges", "SELECT src FROM sites")},
      chains AS (SELECT entry, nodes, path FROM hop4 UNION ALL SELECT entry, nodes, path FROM (SELECT * FROM hop1 UNION ALL SELECT * FROM hop2 UNION ALL SELECT * FROM hop3) WHERE closes OR src NOT IN (SELECT src FROM sites)),
      top AS (SELECT *, row_number() OVER (ORDER BY entry, path) AS n FROM chains)
      SELECT n::INT AS n, entry, array_to_string(nodes, ' -> ') AS chain, (SELECT string_agg(place, ',' ORDER BY list_position(path, ord)) FROM sites WHERE list_contains(path, ord)) AS places, (SELECT string_agg(call, ',' ORDER BY list_position(path, ord)) FROM sites WHERE list_contains(path, ord)) AS calls FROM (SELECT * FROM top WHERE n <= 80)""",
    "flow_nodes": f"""WITH RECURSIVE {FLOWS}, top AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY endpoint_path, code_path, owner, statement) AS n FROM flows) WHERE n <= 80),
      p AS (SELECT 'endpoint' AS kind, endpoint_path AS name, n FROM top UNION ALL SELECT 'sql', statement, n FROM top), s AS (SELECT kind, name, row_number() OVER (PARTITION BY kind ORDER BY min(n), name) AS number FROM p GROUP BY 1, 2),
      named_nodes AS (SELECT DISTINCT 'method' AS kind, unnest(string_split(code_path, ' -> ')) AS name FROM top UNION SELECT DISTINCT 'table', unnest(string_split(tables, ',')) FROM top)
      SELECT kind, name, number::INT AS number FROM s UNION ALL SELECT kind, name, (row_number() OVER (PARTITION BY kind ORDER BY name))::INT FROM named_nodes WHERE name <> ''""",
    "reachable_paths": f"WITH RECURSIVE {REACH} SELECT entry, node, array_to_string(nodes, ' -> ') AS path FROM reach",
    "extract_tables": f"WITH corpus AS ({CORPUS}), t AS (SELECT id, {TABLES.format('text')} AS l FROM corpus) SELECT id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ',') AS tables FROM t",
    "usages": f"WITH {CALLS}, {USAGES} SELECT owner_type, method, operation, statement, tables, file_path, line, 'annotation' AS source FROM usages",
    "annotation_usages": f"""WITH {CALLS}, {USAGES}, r AS (SELECT *, CASE WHEN line % 11 = 0 THEN '' WHEN line % 5 = 0 THEN 'Elsewhere' ELSE owner_type END AS o FROM usages), t AS (SELECT p_brand AS name, arg_max(p_type || '/' || (p_partkey % 13), p_partkey) AS file FROM part GROUP BY 1)
      SELECT o AS owner_type, method, operation, statement, coalesce(t.file, file_path) AS file_path, line FROM r LEFT JOIN t ON t.name = o WHERE o <> ''""",
    "endpoint_flows": f"WITH RECURSIVE {FLOWS} SELECT * FROM flows",
    "flow_graph": f"""WITH RECURSIVE {FLOWS}, top AS (SELECT *, row_number() OVER (ORDER BY endpoint_path, code_path, owner, statement) AS n FROM flows), t AS (SELECT *, list_prepend(endpoint_path, string_split(code_path, ' -> ')) AS p FROM top WHERE n <= 80)
      SELECT DISTINCT p[i] AS src, 'calls' AS type, p[i + 1] AS dst FROM (SELECT p, unnest(range(1, len(p))) AS i FROM t) UNION SELECT owner, 'runs', statement FROM t UNION SELECT statement, 'touches', unnest(string_split(tables, ',')) FROM t
      UNION SELECT '', 'omitted', (count(*) - 80)::VARCHAR FROM flows HAVING count(*) > 80""",
    "capped_flows": f"""WITH RECURSIVE {FLOWS}, top AS (SELECT *, (row_number() OVER (ORDER BY endpoint_path, code_path, owner, statement))::INT AS place FROM flows)
      SELECT *, 0::BIGINT AS omitted FROM top WHERE place <= 100 UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, NULL, NULL, count(*) - 100 FROM flows HAVING count(*) > 100""",
}
