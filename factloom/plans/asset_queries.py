"""Queries of chunks, assets and state tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import assets as K
from ..operators import chunking as G
from ..operators import graph as H
from ..operators.facts import flatten_facts
from ..sources import state as A
from ..sources.work import kept
from .adapters import CORPUS, FACTS, FULL_FACTS, corpus, facts, full_analyses, table

NAMESPACE_URL = "6ba7b8119dad11d180b400c04fd430c8"
TRANSCRIPTS = """
  transcripts AS (SELECT conv_id AS id, CASE WHEN conv_id % 3 = 0 THEN 'Intro line' || chr(10) ELSE '' END || string_agg('# ' || role || ' ' || turn || chr(10) || chr(10) || replace(text, chr(10), chr(10) || chr(10)) || chr(10) || chr(10), '' ORDER BY turn) AS text FROM conversations GROUP BY conv_id)"""
ASSETS = """
  assets AS (SELECT 'Rule ' || item_id AS id, 'Rule ' || (item_id % 10) AS title, ['business_rule', 'adr', 'incident', 'api_doc', 'standard', 'glossary', 'module_note'][item_id % 7 + 1] AS type, ['draft', 'pending_review', 'confirmed', 'stale', 'archived'][item_id % 5 + 1] AS status, text AS content, item_id AS ord, string_split(text, ' ') AS w FROM benchmark),
  evidence AS (
    SELECT 'Rule ' || item_id AS asset_id, 0 AS ord, 'n' || (item_id % 25) || '.src' AS file_path, '' AS symbol_name, 0 AS start_line, 0 AS end_line FROM benchmark
    UNION ALL SELECT 'Rule ' || item_id, 1, 'r' || n_regionkey || '/n' || n_nationkey || '.src', c_name, 0, 0 FROM benchmark JOIN customer ON c_custkey = item_id JOIN nation ON c_nationkey = n_nationkey
    UNION ALL SELECT 'Rule ' || item_id, 2, '', 'o' || (item_id * 37), 2, 3 FROM benchmark UNION ALL SELECT 'Rule ' || item_id, 3, '', '', 0, 0 FROM benchmark)"""
LOG = """
  log AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r, CASE event_type WHEN 'signup' THEN 'draft' WHEN 'view' THEN 'pending_review' WHEN 'purchase' THEN 'confirmed' WHEN 'error' THEN 'stale' ELSE 'archived' END AS state FROM events)"""


def _transcripts(spark, sf_dir):
    turn = F.concat(F.lit("# "), "role", F.lit(" "), "turn", F.lit("\n\n"), F.replace("text", F.lit("\n"), F.lit("\n\n")), F.lit("\n\n"))
    own = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", turn.alias("t")))), lambda x: x["t"]), "").alias("text"))
    return own.select("id", F.concat(F.when(F.col("id") % 3 == 0, "Intro line\n").otherwise(""), "text").alias("text"))


def _assets(spark, sf_dir):
    i = F.col("item_id")
    pick = lambda values, n: F.element_at(F.array(*[F.lit(v) for v in values]), (i % n + 1).cast("int"))
    w = F.split("text", " ")
    return table(spark, sf_dir, "benchmark").select(
        F.concat(F.lit("Rule "), i).alias("id"), F.concat(F.lit("Rule "), i % 10).alias("title"), pick(K.TYPES, 7).alias("type"), pick(K.STATUSES, 5).alias("status"), F.col("text").alias("content"), i.alias("ord"),
        F.concat(w[0], F.lit(","), w[1], F.lit("，"), w[2], F.lit(" "), w[3], F.lit(" , "), w[4], F.lit(","), w[5]).alias("raw_tags"),
    )


def _evidence(spark, sf_dir):
    t = lambda name: table(spark, sf_dir, name)
    b, i = t("benchmark"), F.col("item_id")
    row = lambda df, n, path, symbol, a=0, z=0: df.select(F.concat(F.lit("Rule "), i).alias("asset_id"), F.lit(n).alias("ord"), path.alias("file_path"), symbol.alias("symbol_name"), F.lit(a).alias("start_line"), F.lit(z).alias("end_line"))
    none = F.lit("")
    named = b.join(t("customer"), F.col("c_custkey") == i).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return (
        row(b, 0, F.concat(F.lit("n"), i % 25, F.lit(".src")), none).unionByName(row(named, 1, F.concat(F.lit("r"), "n_regionkey", F.lit("/n"), "n_nationkey", F.lit(".src")), F.col("c_name")))
        .unionByName(row(b, 2, none, F.concat(F.lit("o"), i * 37), 2, 3)).unionByName(row(b, 3, none, none))
    )


def _tags(spark, sf_dir):
    return _assets(spark, sf_dir).select(F.col("id").alias("asset_id"), F.posexplode(K.norm_tags(F.col("raw_tags"))).alias("ord", "tag"))


def _log(spark, sf_dir):
    state = F.when(F.col("event_type") == "signup", "draft").when(F.col("event_type") == "view", "pending_review").when(F.col("event_type") == "purchase", "confirmed").when(F.col("event_type") == "error", "stale").otherwise("archived")
    return table(spark, sf_dir, "events").withColumn("state", state)


def sections(spark, sf_dir):
    return G.split_sections(_transcripts(spark, sf_dir)).drop("section")


def packed_parts(spark, sf_dir):
    return _transcripts(spark, sf_dir).select("id", F.posexplode(G.pack_paragraphs(F.col("text"), 200)).alias("n", "part"))


def kb_chunks(spark, sf_dir):
    return G.kb_chunks(_transcripts(spark, sf_dir), 200)


def document_chunks(spark, sf_dir):
    return G.document_chunks(corpus(spark, sf_dir).select(F.col("file_path").alias("path"), "text"))


def _typed_facts(spark, sf_dir):
    """Facts are written once; a filter on them would else reach into the generator that lays them out."""
    return kept(flatten_facts(full_analyses(spark, sf_dir)), "facts")


def chunk_facts(spark, sf_dir):
    return G.chunk_facts(_typed_facts(spark, sf_dir))


def chunk_methods(spark, sf_dir):
    """Methods are called as their elements' handlers, of which there are few, so that bodies meet several methods."""
    found = _typed_facts(spark, sf_dir)
    return G.chunk_methods(found.withColumn("symbol_name", F.when(F.col("type") == "method", F.get_json_object("payload", "$.method_name")).otherwise(F.col("symbol_name"))))


def asset_chunks(spark, sf_dir):
    return G.asset_chunks(_assets(spark, sf_dir).withColumn("tags", K.norm_tags(F.col("raw_tags"))), _evidence(spark, sf_dir).withColumn("note", F.lit("")))


def norm_tags(spark, sf_dir):
    return _tags(spark, sf_dir)


def slugs(spark, sf_dir):
    return K.unique_slugs(_assets(spark, sf_dir).select("ord", "title"), "title", "ord")


def nest_assets(spark, sf_dir):
    return K.nest_assets(_assets(spark, sf_dir).select("id"), _tags(spark, sf_dir), _evidence(spark, sf_dir)).select("id", F.array_join("tags", ",").alias("tags"), F.array_join("evidence", ",").alias("evidence"))


def page_assets(spark, sf_dir):
    return K.page_assets(_assets(spark, sf_dir), _tags(spark, sf_dir), _evidence(spark, sf_dir), "o3", limit=30, offset=1).select("id", "type", "status", "total")


def match_evidence(spark, sf_dir):
    return K.match_evidence(_evidence(spark, sf_dir), facts(spark, sf_dir))


def evidence_links(spark, sf_dir):
    return K.links(match_evidence(spark, sf_dir))


def asset_edge_refresh(spark, sf_dir):
    """Assets of three projects, two of which are refreshed: the old edges are those of even assets, by their first evidence, and some to records that nobody names now."""
    assets = _assets(spark, sf_dir).select("id", F.concat(F.lit("p"), F.col("ord") % 3).alias("project_id"), "ord")
    links = kept(evidence_links(spark, sf_dir), "links").withColumnRenamed("ord", "evidence")
    even = assets.filter("ord % 2 = 0")
    old = H.asset_edges(even, links.filter("evidence = 1").withColumn("note", F.lit("old")))
    gone = H.asset_edges(even, even.select(F.col("id").alias("asset_id"), F.concat(F.lit("gone "), "id").alias("key"))).filter("type = 'EVIDENCED_BY'")
    new = H.asset_edges(assets, links)
    found = H.refresh_edges(old.unionByName(gone), new, spark.createDataFrame([("p0",), ("p1",), ("p9",)], "tenant string"))
    return found.select("tenant", "src", "type", "dst", F.col("props")["evidence"].alias("evidence"), F.col("props")["note"].alias("note"), "state")


def documents_list(spark, sf_dir):
    return K.list_documents(corpus(spark, sf_dir).select(F.col("file_path").alias("path"), "text"), "src1")


def visible_projects(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    users = e.select("user_id", (F.col("user_id") % 10 == 0).alias("is_admin")).distinct()
    grants = e.select("user_id", (F.col("event_id") % 25).alias("project_id"), F.when(F.col("event_type") == "error", "deleted").otherwise("active").alias("status"))
    return K.visible_projects(users, grants, table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("project_id")))


def live_rows(spark, sf_dir):
    return A.read_live(_log(spark, sf_dir).select("event_id", F.when(F.col("event_type") == "error", "deleted").otherwise("active").alias("status")))


def upsert_latest(spark, sf_dir):
    log = _log(spark, sf_dir)
    old, new = log.filter("event_id % 2 = 0"), log.filter("event_id % 2 = 1")
    shape = lambda df: A.latest(df, ["user_id"], ["ts", "event_id"]).select("user_id", "state", F.col("event_id").alias("created"))
    return A.upsert(shape(old), shape(new), ["user_id"], ["state"])


def soft_delete(spark, sf_dir):
    rows = _log(spark, sf_dir).select("event_id", "event_type", F.when(F.col("event_id") % 5 == 0, "deleted").otherwise("active").alias("status"), F.lit(None).cast("string").alias("deleted_at"))
    return A.soft_delete(rows, F.col("event_type") == "error", F.lit("2024-01-01"))


def prune_missing(spark, sf_dir):
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    return A.prune_missing(c.select("c_custkey", "c_name"), o.filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


def sync_grants(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("project_id", F.col("event_id") % 25)
    grants = e.filter("event_type <> 'purchase'").select("user_id", "project_id").distinct().withColumn("status", F.lit("active"))
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))
    wanted = e.filter("user_id % 2 = 0").withColumn("r", place).filter("r <= 5").select("user_id", "project_id")
    return A.sync_grants(grants, wanted)


def point_uuid5(spark, sf_dir):
    name = F.concat(F.lit("p:"), "id")
    return corpus(spark, sf_dir).select("id", A.uuid5(NAMESPACE_URL, name).alias("uuid"), F.sha2(name, 256).alias("fact_hash"))


def snapshot_latest(spark, sf_dir):
    log = _log(spark, sf_dir).select(F.col("user_id").alias("project"), F.col("event_type").alias("mode"), F.concat("event_id", F.lit("\n\n")).alias("text"), "ts", "event_id")
    last = A.latest(log, ["project", "mode"], ["ts", "event_id"]).select("project", "mode", "text")
    stored = A.save_snapshot(last.filter("project % 2 = 0"), last.filter("project % 3 = 0"))
    return A.load_snapshot(stored, last.select("project", "mode"))


def delete_where(spark, sf_dir):
    return A.delete_where(_log(spark, sf_dir).select("event_id", "event_type", "state"), (F.col("event_type") == "click") | (F.col("state") == "stale"))


def json_lines(spark, sf_dir):
    return A.to_json_lines(table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey"))


def norm_evidence(spark, sf_dir):
    return K.norm_evidence(_evidence(spark, sf_dir).withColumn("note", F.lit("")), 2).select("asset_id", "ord", "file_path", "symbol_name", "start_line", "end_line")


def validate_assets(spark, sf_dir):
    own = _assets(spark, sf_dir)
    i = F.col("ord")
    broken = own.select("id", F.when(i % 4 == 0, " ").otherwise(F.col("title")).alias("title"), F.when(i % 3 == 0, "poem").otherwise(F.col("type")).alias("type"), F.when(i % 2 == 0, "lost").otherwise(F.col("status")).alias("status"))
    return K.validate_assets(broken).select("id", "reason")


def transition(spark, sf_dir):
    """Every event is a change of a rule: purchases confirm, errors make stale, the others update, with and without fields."""
    e, n, text = table(spark, sf_dir, "events"), F.col("event_id"), F.lit(None).cast("string")
    kind = F.when(F.col("event_type") == "purchase", "confirm").when(F.col("event_type") == "error", "stale").otherwise("update")
    status = F.when(n % 3 == 0, "confirmed").when(n % 3 == 1, F.when(n % 2 == 0, "draft").otherwise("unheard of"))
    changes = e.select(
        F.concat(F.lit("Rule "), "user_id").alias("id"), kind.alias("action"), F.concat(F.lit("u"), n % 7).alias("by"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"), n.alias("seq"),
        status.alias("status"), F.when(n % 5 == 0, F.concat(F.lit("r"), n % 9)).alias("reviewer"), F.when(n % 11 == 0, "2020-01-01").otherwise("").alias("confirmed_at"),
    )
    first = F.when(F.col("ord") % 2 == 0, "confirmed").otherwise(F.col("status"))
    return K.transition(_assets(spark, sf_dir).select("id", first.alias("status"), F.when(F.col("ord") % 4 == 0, "first").alias("reviewer"), text.alias("confirmed_at")), changes)


def merge_nodes(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.lit("customer").alias("label"), F.create_map(F.lit("name"), "c_name", F.lit("segment"), "c_mktsegment").alias("props"))
    o = table(spark, sf_dir, "orders").select(F.concat(F.lit("c"), "o_custkey").alias("id"), F.lit("customer").alias("label"), F.create_map(F.lit("segment"), F.lit("buyer"), F.lit("last"), F.lit("order")).alias("props"))
    merged = A.merge_nodes(c, o, F.lit(0))
    return merged.select("id", "label", *[F.col("props")[k].alias(k) for k in ("name", "segment", "last")])


def merge_edges(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    rows = o.select(F.concat(F.lit("c"), "o_custkey").alias("src"), F.lit("PLACED").alias("type"), F.concat(F.lit("p"), F.substring("o_orderpriority", 1, 1)).alias("dst"), F.create_map(F.lit("last"), F.col("o_orderkey").cast("string")).alias("props"), "o_orderkey")
    nodes = table(spark, sf_dir, "customer").filter("c_acctbal > 0").select(F.concat(F.lit("c"), "c_custkey").alias("id")).union(o.select(F.concat(F.lit("p"), F.substring("o_orderpriority", 1, 1))))
    old, new = rows.filter("o_orderkey % 2 = 0").drop("o_orderkey"), rows.drop("props").withColumn("props", F.create_map(F.lit("seen"), F.lit("yes"))).filter("o_orderkey % 3 = 0").drop("o_orderkey")
    merged = A.merge_edges(A.merge_edges(old.limit(0), old.select("src", "type", "dst", F.create_map(F.lit("kind"), F.lit("old")).alias("props")), nodes), new, nodes)
    return merged.select("src", "type", "dst", F.col("props")["kind"].alias("kind"), F.col("props")["seen"].alias("seen"))


QUERIES = {f.__name__: f for f in (
    delete_where, json_lines, norm_evidence, validate_assets, transition, merge_nodes, merge_edges,
    sections, packed_parts, kb_chunks, document_chunks, chunk_facts, chunk_methods, asset_chunks, norm_tags, slugs, nest_assets, page_assets, match_evidence, evidence_links, asset_edge_refresh, documents_list, visible_projects,
    live_rows, upsert_latest, soft_delete, prune_missing, sync_grants, point_uuid5, snapshot_latest,
)}
TAGS = "tags AS (SELECT id AS asset_id, i - 1 AS ord, t[i] AS tag FROM (SELECT id, list_filter(w, lambda x, i: list_position(w, x) = i)[1:12] AS t FROM (SELECT id, list_filter(string_split(regexp_replace(array_to_string(w[1:6], ','), '[,\\x20\\x09-\\x0D]+', ',', 'g'), ','), lambda x: x <> '') AS w FROM assets)), unnest(range(1, len(t) + 1)) AS u(i))".replace("\\\\x", "\\x")
MATCH = """matched AS (
  SELECT asset_id, e.ord, f.key FROM evidence e JOIN facts f ON lower(e.symbol_name) IN (lower(f.symbol_name), lower(f.enclosing_type), lower(f.enclosing_method)) AND e.symbol_name <> '' AND (e.file_path = '' OR e.file_path = f.file_path)
    AND (e.start_line = 0 OR (f.start_line > 0 AND f.start_line <= e.end_line AND (CASE WHEN f.end_line > 0 THEN f.end_line ELSE f.start_line END) >= e.start_line))
  UNION SELECT asset_id, e.ord, f.key FROM evidence e JOIN facts f ON f.type = 'file' AND e.symbol_name = '' AND e.file_path <> '' AND (f.file_path = e.file_path OR suffix(f.file_path, '/' || e.file_path)))"""
SECTIONS = r"""
  feeds AS (SELECT id, i, l[i] AS line FROM (SELECT id, string_split(regexp_replace(text, '\n$', ''), chr(10)) AS l FROM transcripts), unnest(range(1, len(l) + 1)) AS u(i)),
  headed AS (SELECT *, sum(CASE WHEN regexp_matches(line, '^#{1,6}[\x20\x09]+[^\x20\x09-\x0D]') THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY i) AS g FROM feeds),
  grouped AS (SELECT id, g, arg_min(line, i) AS head, min(i)::INT AS start_line, max(i)::INT AS end_line, regexp_replace(string_agg(line, chr(10) ORDER BY i), '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS text FROM headed GROUP BY id, g),
  sections AS (SELECT id, g, CASE WHEN regexp_matches(head, '^#{1,6}[\x20\x09]+[^\x20\x09-\x0D]') THEN trim(regexp_extract(head, '^#{1,6}[\x20\x09]+(.*)', 1)) ELSE 'document' END AS title, start_line, end_line, text FROM grouped WHERE text <> '')"""
#: Parts of at most 200 characters: each step of the recursion takes one paragraph and gives the parts that it completes.
PACKED = r"""
  bits AS (SELECT id, g, i, regexp_replace(b[i], '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS p FROM (SELECT id, g, regexp_split_to_array(text, '\n[\x20\x09-\x0D]*\n') AS b FROM whole WHERE length(text) > 200), unnest(range(1, len(b) + 1)) AS u(i)),
  paragraphs AS MATERIALIZED (SELECT id, g, p, length(p) > 200 AS long, row_number() OVER (PARTITION BY id, g ORDER BY i) AS i, count(*) OVER (PARTITION BY id, g) AS last FROM bits WHERE p <> ''),
  steps AS (
    SELECT id, g, 0::BIGINT AS i, CAST([] AS VARCHAR[]) AS done, '' AS held, 0::BIGINT AS size FROM (SELECT DISTINCT id, g FROM paragraphs)
    UNION ALL
    SELECT id, g, i, list_concat(CASE WHEN full_ THEN [held] ELSE [] END, CASE WHEN long THEN list_transform(range(0, (length(p) + 199) // 200), lambda k: p[k * 200 + 1:k * 200 + 200]) ELSE [] END),
      CASE WHEN long THEN CASE WHEN full_ THEN '' ELSE held END WHEN full_ OR size = 0 THEN p ELSE held || chr(10) || chr(10) || p END, CASE WHEN full_ THEN 0 ELSE size END + CASE WHEN long THEN 0 ELSE length(p) + 2 END
    FROM (SELECT s.id, s.g, q.i, q.p, q.long, held, size, size > 0 AND size + length(p) + 2 > 200 AS full_ FROM steps s JOIN paragraphs q ON q.id = s.id AND q.g = s.g AND q.i = s.i + 1)),
  parts AS (
    SELECT id, g, i, k, done[k] AS part FROM steps, unnest(range(1, len(done) + 1)) AS u(k)
    UNION ALL SELECT s.id, s.g, s.i + 1, 1, held FROM steps s JOIN (SELECT DISTINCT id, g, last FROM paragraphs) e ON e.id = s.id AND e.g = s.g AND e.last = s.i WHERE size > 0
    UNION ALL SELECT id, g, 1, 1, text FROM whole WHERE length(text) <= 200),
  packed AS (SELECT id, g, row_number() OVER (PARTITION BY id, g ORDER BY i, k) - 1 AS n, part FROM parts)"""
SQL = {
    "sections": rf"""WITH {TRANSCRIPTS}, {SECTIONS} SELECT id, title, start_line, end_line, text FROM sections""",
    "packed_parts": f"""WITH RECURSIVE {TRANSCRIPTS}, whole AS (SELECT id, 0 AS g, text FROM transcripts), {PACKED} SELECT id, n::INT AS n, part FROM packed""",
    "kb_chunks": f"""WITH RECURSIVE {TRANSCRIPTS}, {SECTIONS}, whole AS (SELECT id, g, text FROM sections), {PACKED},
      placed AS (SELECT id, g, n, part, title, start_line + CASE WHEN strpos(s.text, part) > 0 THEN len(string_split(s.text[1:strpos(s.text, part) - 1], chr(10))) - 1 ELSE 0 END AS start FROM packed JOIN sections s USING (id, g))
      SELECT id || '::kb::' || title || '::' || (n + 1) AS id, id AS doc, CASE WHEN min_g = 0 THEN g ELSE g - 1 END::INT AS section, (n + 1)::INT AS n, start::INT AS start_line, (start + len(string_split(part, chr(10))) - 1)::INT AS end_line,
        'Knowledge document ' || id || chr(10) || 'Section: ' || title || chr(10) || part AS text
      FROM placed JOIN (SELECT id, min(g) AS min_g FROM headed GROUP BY id) USING (id)""",
    "document_chunks": f"WITH corpus AS ({CORPUS}) SELECT 'kb:' || file_path AS id, 'Knowledge document ' || file_path || chr(10) || text AS text FROM corpus",
    "chunk_facts": f"""WITH {FULL_FACTS}, p AS (SELECT *, payload->>'$.kind' AS kind, payload->>'$.annotation' AS annotation, payload->>'$.method_name' AS handler, payload->>'$.superclass' AS superclass, (payload->'$.interfaces')::VARCHAR[] AS interfaces, (payload->'$.modifiers')::VARCHAR[] AS modifiers, payload->>'$.path' AS path, payload->>'$.statement' AS statement,
        CASE WHEN file_path <> '' THEN file_path ELSE '<memory>' END AS root, chr(10) AS nl, CASE WHEN file_path <> '' THEN chr(10) || 'File: ' || file_path ELSE '' END AS file FROM full_facts),
      c AS (SELECT *, CASE type WHEN 'sql_reference' THEN 'sql' ELSE type END AS k, CASE WHEN type IN ('endpoint', 'sql_reference') THEN enclosing_type || '.' || handler ELSE symbol_name END AS symbol, nl || 'Modifiers: ' || array_to_string(modifiers, ' ') AS mods FROM p)
      SELECT root || '::' || k || '::' || symbol || '::' || start_line AS id, k AS kind, symbol, CASE type
        WHEN 'type' THEN 'Java ' || kind || ' ' || symbol_name || nl || 'Package: ' || package || file || mods || nl || 'Enclosing type: ' || enclosing_type || CASE WHEN superclass <> '' THEN nl || 'Extends: ' || superclass ELSE '' END || nl || 'Implements: ' || array_to_string(interfaces, ', ')
        WHEN 'field' THEN 'Java field ' || symbol_name || nl || 'Package: ' || package || file || nl || 'Enclosing type: ' || enclosing_type || mods
        WHEN 'component' THEN 'Java Spring component ' || symbol_name || nl || 'Component kind: ' || kind || nl || 'Annotation: ' || annotation || nl || 'Package: ' || package || file
        WHEN 'endpoint' THEN 'Java HTTP endpoint GET, POST ' || path || nl || 'Controller: ' || enclosing_type || nl || 'Method: ' || handler || nl || 'Annotation: ' || annotation || nl || 'Package: ' || package || file
        ELSE 'Java SQL select ' || handler || nl || 'Enclosing type: ' || enclosing_type || nl || 'Statement: ' || statement || nl || 'Annotation: ' || annotation || nl || 'Package: ' || package || file END AS text
      FROM c WHERE type IN ('type', 'field', 'component', 'endpoint', 'sql_reference')""",
    "chunk_methods": f"""WITH {FULL_FACTS}, p AS (SELECT *, payload->>'$.kind' AS kind, payload->>'$.condition' AS condition, payload->>'$.expression' AS expression, payload->>'$.method_name' AS handler, (payload->'$.modifiers')::VARCHAR[] AS modifiers, (payload->'$.arguments')::VARCHAR[] AS arguments, chr(10) AS nl FROM full_facts),
      s AS (SELECT file_path, enclosing_type, enclosing_method AS handler, type, ord, CASE type WHEN 'call' THEN symbol_name || '(' || array_to_string(arguments, ', ') || ')' WHEN 'local_variable' THEN '? ' || symbol_name WHEN 'return' THEN expression ELSE kind || CASE WHEN condition <> '' THEN '(' || condition || ')' ELSE '' END END AS s
        FROM p WHERE type IN ('call', 'local_variable', 'return', 'control_structure') AND enclosing_method <> ''),
      b AS (SELECT file_path, enclosing_type, handler, type, CASE type WHEN 'return' THEN string_agg(s, '; ' ORDER BY ord, s) ELSE string_agg(s, ', ' ORDER BY ord, s) END AS s FROM s GROUP BY file_path, enclosing_type, handler, type),
      m AS (SELECT p.*, file_path AS f, enclosing_type AS t FROM p WHERE type = 'method')
      SELECT CASE WHEN f <> '' THEN f ELSE '<memory>' END || '::' || kind || '::' || handler || '::' || start_line AS id, kind, handler AS symbol,
        'Java ' || kind || ' ' || symbol_name || nl || 'Package: ' || package || CASE WHEN f <> '' THEN nl || 'File: ' || f ELSE '' END || nl || 'Enclosing type: ' || t || nl || 'Modifiers: ' || array_to_string(modifiers, ' ')
        || coalesce((SELECT nl || 'Calls: ' || s FROM b WHERE type = 'call' AND b.file_path = f AND b.enclosing_type = t AND b.handler = m.handler), '') || coalesce((SELECT nl || 'Local variables: ' || s FROM b WHERE type = 'local_variable' AND b.file_path = f AND b.enclosing_type = t AND b.handler = m.handler), '')
        || coalesce((SELECT nl || 'Returns: ' || s FROM b WHERE type = 'return' AND b.file_path = f AND b.enclosing_type = t AND b.handler = m.handler), '') || coalesce((SELECT nl || 'Control flow: ' || s FROM b WHERE type = 'control_structure' AND b.file_path = f AND b.enclosing_type = t AND b.handler = m.handler), '') AS text FROM m""",
    "asset_chunks": f"""WITH {ASSETS}, {TAGS}, ev AS (SELECT asset_id, string_agg(l, chr(10) ORDER BY ord) AS l FROM (SELECT asset_id, ord, concat_ws(' - ', nullif(file_path, ''), nullif(symbol_name, '')) AS l FROM evidence) WHERE l <> '' GROUP BY 1)
      SELECT id, concat_ws(chr(10), 'Asset: ' || title, 'Kind: ' || type, 'Status: ' || status, 'Tags: ' || (SELECT string_agg(tag, ', ' ORDER BY ord) FROM tags WHERE asset_id = id), content, ev.l) AS text FROM assets LEFT JOIN ev ON asset_id = id""",
    "norm_tags": f"WITH {ASSETS}, {TAGS} SELECT asset_id, ord::INT AS ord, tag FROM tags",
    "slugs": "WITH t AS (SELECT item_id AS ord, 'Rule ' || (item_id % 10) AS title, row_number() OVER (PARTITION BY item_id % 10 ORDER BY item_id) AS n FROM benchmark) SELECT ord, title, lower(replace(title, ' ', '-')) || CASE WHEN n = 1 THEN '' ELSE '-' || n END AS slug FROM t",
    "nest_assets": f"WITH {ASSETS}, {TAGS} SELECT id, (SELECT string_agg(tag, ',' ORDER BY ord) FROM tags WHERE asset_id = id) AS tags, (SELECT string_agg(file_path || '|' || symbol_name, ',' ORDER BY evidence.ord) FROM evidence WHERE asset_id = id) AS evidence FROM assets",
    "page_assets": f"WITH {ASSETS}, {TAGS} SELECT id, type, status, count(*) OVER () AS total FROM assets a WHERE contains(lower(title || chr(10) || content), 'o3') OR EXISTS (SELECT 1 FROM tags WHERE asset_id = a.id AND contains(lower(tag), 'o3')) OR EXISTS (SELECT 1 FROM evidence WHERE asset_id = a.id AND contains(lower(file_path || chr(10) || symbol_name), 'o3')) ORDER BY a.ord DESC LIMIT 30 OFFSET 1",
    "match_evidence": f"WITH {FACTS}, {ASSETS}, {MATCH} SELECT * FROM matched",
    "evidence_links": f"WITH {FACTS}, {ASSETS}, {MATCH} SELECT asset_id, key, min(ord) AS ord FROM matched GROUP BY 1, 2",
    "asset_edge_refresh": f"""WITH {FACTS}, {ASSETS}, {MATCH}, a AS (SELECT id, 'p' || (ord % 3) AS tenant, ord FROM assets), l AS (SELECT asset_id, key, min(ord) AS evidence FROM matched GROUP BY 1, 2),
      n AS (SELECT tenant, tenant AS src, 'HAS_KNOWLEDGE_ASSET' AS type, id AS dst, NULL AS evidence FROM a UNION ALL SELECT tenant, id, 'EVIDENCED_BY', key, evidence::VARCHAR FROM a JOIN l ON asset_id = id),
      o AS (SELECT tenant, tenant AS src, 'HAS_KNOWLEDGE_ASSET' AS type, id AS dst, NULL AS evidence, NULL AS note FROM a WHERE ord % 2 = 0 UNION ALL SELECT tenant, id, 'EVIDENCED_BY', key, evidence::VARCHAR, 'old' FROM a JOIN l ON asset_id = id WHERE ord % 2 = 0 AND evidence = 1
        UNION ALL SELECT tenant, id, 'EVIDENCED_BY', 'gone ' || id, NULL, NULL FROM a WHERE ord % 2 = 0)
      SELECT tenant, src, type, dst, evidence, NULL AS note, CASE WHEN (tenant, src, type, dst) IN (SELECT (tenant, src, type, dst) FROM o) THEN 'kept' ELSE 'added' END AS state FROM n WHERE tenant IN ('p0', 'p1')
      UNION ALL SELECT tenant, src, type, dst, evidence, note, CASE WHEN tenant = 'p2' THEN 'kept' ELSE 'dropped' END FROM o WHERE tenant = 'p2' OR (tenant, src, type, dst) NOT IN (SELECT (tenant, src, type, dst) FROM n)""",
    "documents_list": f"WITH corpus AS ({CORPUS}) SELECT file_path AS path, string_split(file_path, '/')[-1] AS name, strlen(text)::INT AS bytes FROM corpus WHERE starts_with(file_path, 'src1/')",
    "visible_projects": "SELECT DISTINCT user_id, event_id % 25 AS project_id FROM events WHERE event_type <> 'error' AND user_id % 10 <> 0 UNION ALL SELECT user_id, n_nationkey::BIGINT FROM (SELECT DISTINCT user_id FROM events WHERE user_id % 10 = 0), nation",
    "live_rows": "SELECT event_id, 'active' AS status FROM events WHERE event_type <> 'error'",
    "upsert_latest": f"WITH {LOG}, o AS (SELECT user_id, arg_max(state, (ts, event_id)) AS state, arg_max(event_id, (ts, event_id)) AS created FROM log WHERE event_id % 2 = 0 GROUP BY 1), n AS (SELECT user_id, arg_max(state, (ts, event_id)) AS state, arg_max(event_id, (ts, event_id)) AS created FROM log WHERE event_id % 2 = 1 GROUP BY 1) SELECT coalesce(o.user_id, n.user_id) AS user_id, coalesce(n.state, o.state) AS state, coalesce(o.created, n.created) AS created FROM o FULL JOIN n ON o.user_id = n.user_id",
    "soft_delete": "SELECT event_id, event_type, CASE WHEN event_id % 5 = 0 OR event_type = 'error' THEN 'deleted' ELSE 'active' END AS status, CASE WHEN event_id % 5 <> 0 AND event_type = 'error' THEN '2024-01-01' END AS deleted_at FROM events",
    "prune_missing": "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')",
    "sync_grants": """WITH g AS (SELECT DISTINCT user_id, event_id % 25 AS project_id FROM events WHERE event_type <> 'purchase'), w AS (SELECT DISTINCT user_id, project_id FROM (SELECT user_id, event_id % 25 AS project_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events WHERE user_id % 2 = 0) WHERE r <= 5)
      SELECT coalesce(g.user_id, w.user_id) AS user_id, coalesce(g.project_id, w.project_id) AS project_id, CASE WHEN w.user_id IS NOT NULL THEN 'active' WHEN g.user_id IN (SELECT user_id FROM w) THEN 'deleted' ELSE 'active' END AS status FROM g FULL JOIN w ON g.user_id = w.user_id AND g.project_id = w.project_id""",
    "point_uuid5": f"WITH corpus AS ({CORPUS}), h AS (SELECT id, sha1(unhex('{NAMESPACE_URL}') || encode('p:' || id)) AS h, sha256('p:' || id) AS fact_hash FROM corpus) SELECT id, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || ['8', '9', 'a', 'b'][('0x' || h[17:17])::BIGINT % 4 + 1] || h[18:20] || '-' || h[21:32] AS uuid, fact_hash FROM h",
    "delete_where": f"WITH {LOG} SELECT event_id, event_type, state FROM log WHERE event_type <> 'click' AND state <> 'stale'",
    "json_lines": """SELECT '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '","n_regionkey":' || n_regionkey || '}' AS value FROM nation""",
    "norm_evidence": f"WITH {ASSETS} SELECT asset_id, ord, file_path, symbol_name, start_line, end_line FROM (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY ord) AS r FROM evidence WHERE file_path <> '' OR symbol_name <> '') WHERE r <= 2",
    "validate_assets": "SELECT 'Rule ' || item_id AS id, CASE WHEN item_id % 4 = 0 THEN 'title required' WHEN item_id % 3 = 0 THEN 'unknown type' WHEN item_id % 2 = 0 THEN 'unknown status' END AS reason FROM benchmark",
    "transition": f"""WITH RECURSIVE {ASSETS}, e AS (SELECT *, strftime(ts, '%Y-%m-%d %H:%M:%S') AS moment, CASE WHEN event_id % 3 = 0 THEN 'confirmed' WHEN event_id % 3 = 1 THEN CASE WHEN event_id % 2 = 0 THEN 'draft' ELSE 'unheard of' END END AS s FROM events),
      c AS (SELECT 'Rule ' || user_id AS id, event_type, moment, 'u' || (event_id % 7) AS who, s, CASE WHEN event_id % 5 = 0 THEN 'r' || (event_id % 9) END AS r, CASE WHEN event_id % 11 = 0 THEN '2020-01-01' END AS c,
        row_number() OVER (PARTITION BY user_id ORDER BY moment, event_id) AS n FROM e WHERE event_type IN ('purchase', 'error') OR s IS DISTINCT FROM 'unheard of'),
      t AS (
        SELECT id, 0::BIGINT AS n, CASE WHEN ord % 2 = 0 THEN 'confirmed' ELSE status END AS status, CASE WHEN ord % 4 = 0 THEN 'first' END AS reviewer, NULL::VARCHAR AS confirmed_at FROM assets
        UNION ALL
        SELECT id, n, status, CASE WHEN event_type = 'purchase' THEN who WHEN event_type = 'error' THEN reviewer WHEN status = 'confirmed' AND stated IS NULL THEN coalesce(r, reviewer, who) ELSE coalesce(r, reviewer) END,
          CASE WHEN event_type = 'purchase' THEN moment WHEN event_type = 'error' THEN confirmed_at WHEN status = 'confirmed' THEN coalesce(stated, moment) ELSE stated END
        FROM (SELECT t.id, c.n, c.event_type, c.who, c.r, c.moment, t.reviewer, t.confirmed_at, coalesce(c.c, t.confirmed_at) AS stated, CASE c.event_type WHEN 'purchase' THEN 'confirmed' WHEN 'error' THEN 'stale' ELSE coalesce(c.s, t.status) END AS status FROM t JOIN c ON c.id = t.id AND c.n = t.n + 1))
      SELECT id, arg_max(status, n) AS status, arg_max(reviewer, n) AS reviewer, arg_max(confirmed_at, n) AS confirmed_at FROM (SELECT * FROM t) GROUP BY id""",
    "merge_nodes": "SELECT 'c' || c_custkey AS id, 'customer' AS label, c_name AS name, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders) THEN 'buyer' ELSE c_mktsegment END AS segment, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders) THEN 'order' END AS last FROM customer UNION SELECT 'c' || o_custkey, 'customer', NULL, 'buyer', 'order' FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)",
    "merge_edges": "SELECT 'c' || o_custkey AS src, 'PLACED' AS type, 'p' || o_orderpriority[1] AS dst, max(CASE WHEN o_orderkey % 2 = 0 THEN 'old' END) AS kind, max(CASE WHEN o_orderkey % 3 = 0 THEN 'yes' END) AS seen FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_acctbal > 0 AND (o_orderkey % 2 = 0 OR o_orderkey % 3 = 0) GROUP BY 1, 2, 3",
    "snapshot_latest": "WITH l AS (SELECT user_id AS project, event_type AS mode, arg_max(event_id, (ts, event_id)) AS e FROM events GROUP BY 1, 2) SELECT project, mode, (project % 2 = 0 OR project % 3 = 0) AS found, CASE WHEN project % 3 = 0 THEN e || chr(10) WHEN project % 2 = 0 THEN e || chr(10) || chr(10) END AS text FROM l",
}
