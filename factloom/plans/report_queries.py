"""Queries of evidence fusion and of the retrieval report."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import fusion as U
from ..operators import report as R
from ..sources.work import kept
from .adapters import CORPUS, corpus, query_texts, table
from .search_queries import EMBED, hits, hits_sql

STOP = ", ".join(f"'{w}'" for w in U.STOP_WORDS)
#: Words of a page that say nothing about it.
PAGE_STOP = ["api", "class", "com", "controller", "get", "java", "method", "post", "public", "return", "service", "string", "user", "void"]


def terms_sql(x: str) -> str:
    """SQL of the distinct terms of a text."""
    return rf"""list_distinct(list_filter(list_transform(regexp_split_to_array(regexp_replace(array_to_string(regexp_extract_all({x}, '[A-Za-z_][A-Za-z0-9_]*|[0-9]+|[\x{{4e00}}-\x{{9fff}}]{{2,}}'), ' '), '([a-z0-9])([A-Z])', '\1 \2', 'g'), '[_\-\s./:{{}}()]+'), lambda t: lower(t)), lambda t: length(t) >= 2 AND t NOT IN ({STOP})))"""


BASE = f"""{EMBED}, {hits_sql()},
h AS (SELECT h.query_id, h.rank, h.id, h.score, c.ord, c.source_type, c.status, c.kind, c.file_path, c.text, b.text AS query FROM hits h JOIN corpus c USING (id) JOIN benchmark b ON b.item_id = h.query_id),
ht AS (SELECT query_id, rank, id, CASE WHEN source_type = 'code' THEN 'c' ELSE 'k' END AS side, {terms_sql("query || chr(10) || text")} AS terms FROM h),
rt AS (SELECT id, ord, CASE WHEN source_type = 'code' THEN 'c' ELSE 'k' END AS side, {terms_sql("text || chr(10) || kind || ' ' || file_path || ' ' || source_type || ' ' || status")} AS terms FROM corpus),
ov AS (SELECT x.query_id, x.rank, x.id AS hit_id, y.id, y.ord, count(*) AS n FROM (SELECT query_id, rank, id, side, unnest(terms) AS t FROM ht) x JOIN (SELECT id, ord, side, unnest(terms) AS t FROM rt) y ON x.t = y.t AND x.side <> y.side GROUP BY ALL),
cand AS (SELECT query_id, rank AS hit_rank, hit_id, id, n::INT AS overlap, r::INT AS cand_rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id, rank ORDER BY n DESC, ord) AS r FROM ov WHERE NOT EXISTS (SELECT 1 FROM hits WHERE hits.query_id = ov.query_id AND hits.id = ov.id)) WHERE r <= 5),
rel AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hit_rank, cand_rank) AS n FROM cand) WHERE n <= 10),
ev AS (SELECT query_id, side, pos, id, overlap FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id, side ORDER BY hit_rank, cand_rank) AS pos FROM (
    SELECT cand.*, CASE WHEN source_type = 'code' THEN 'code' ELSE 'knowledge' END AS side, row_number() OVER (PARTITION BY query_id, cand.id ORDER BY hit_rank, cand_rank) AS k FROM cand JOIN corpus USING (id)) WHERE k = 1) WHERE pos <= 5),
items AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY g, pos) AS n, id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id, id ORDER BY g, pos) AS k FROM (
    SELECT query_id, 0 AS g, rank AS pos, id, score FROM hits UNION ALL SELECT query_id, CASE side WHEN 'knowledge' THEN 1 ELSE 2 END, pos, id, overlap::DOUBLE FROM ev)) WHERE k = 1),
flat AS (SELECT id, kind, file_path, source_type, trim(regexp_replace(text, '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS t FROM corpus),
cites AS (SELECT query_id, n::INT AS n, items.id, kind AS title, file_path AS location, score, CASE WHEN length(t) <= 180 THEN t ELSE rtrim(t[1:180]) || '...' END AS excerpt, source_type FROM items JOIN flat USING (id) WHERE n <= 8),
facts AS (SELECT query_id, max(score) AS top, bool_or(source_type = 'knowledge_asset' AND status = 'confirmed') AS conf, bool_or(status IN ('draft', 'pending_review', 'stale')) AS unsure, bool_or(source_type = 'code') AS code FROM h GROUP BY query_id),
risk AS (
  SELECT query_id, 1 AS n, 'medium' AS level, 'low_score' AS risk FROM facts WHERE top < 0.15
  UNION ALL SELECT query_id, 2, 'medium', 'no_confirmed_asset' FROM facts WHERE NOT conf
  UNION ALL SELECT query_id, 3, 'low', 'unreviewed' FROM facts WHERE unsure
  UNION ALL SELECT query_id, 4, 'low', 'no_code' FROM facts WHERE NOT code AND NOT EXISTS (SELECT 1 FROM ev WHERE ev.query_id = facts.query_id AND side = 'code')
  UNION ALL SELECT item_id, 0, 'high', 'no_hits' FROM benchmark WHERE item_id NOT IN (SELECT query_id FROM facts)
)""".replace("\\\\x", "\\x")


class Flow:
    """The tables of one retrieval flow; built once, used by every query below."""

    def __init__(self, spark, sf_dir):
        self.records = corpus(spark, sf_dir).withColumn("title", F.lit(""))
        self.queries = query_texts(spark, sf_dir)
        named = self.records.select("id", "text", "source_type", "status")
        self.hits = kept(hits(spark, sf_dir).drop("ord").join(named, "id").join(self.queries.withColumnRenamed("text", "query"), "query_id"), "hits")
        self.candidates = kept(U.related_candidates(self.hits, self.records), "candidates")
        self.relations = U.relations(self.candidates)
        self.evidence = U.evidence(self.candidates, self.records)
        self.items = R.context_items(self.hits, self.evidence)
        self.cited = R.citations(self.items, self.records)
        self.risks = R.risks(self.queries, self.hits, self.evidence)


def terms(spark, sf_dir):
    own = U.terms(F.col("text"))
    return corpus(spark, sf_dir).select("id", F.size(own).alias("n_terms"), F.array_join(F.array_sort(own), ",").alias("terms"))


def related_candidates(spark, sf_dir):
    return Flow(spark, sf_dir).candidates


def relations(spark, sf_dir):
    f = Flow(spark, sf_dir)
    anchors = f.hits.select("query_id", F.col("id").alias("hit_id"), U.anchor_terms(F.col("query"), F.col("text")).alias("anchor"))
    own = f.records.select("id", U.record_terms(F.col("text"), F.col("kind"), F.col("file_path"), F.col("source_type"), F.col("status")).alias("own"))
    return U.shared_terms(f.relations, anchors, own).select("query_id", "hit_id", "id", "overlap", "n", F.array_join("terms", ",").alias("terms"))


def evidence(spark, sf_dir):
    return Flow(spark, sf_dir).evidence


def related_chunks(spark, sf_dir):
    word = lambda text: F.array_distinct(F.filter(F.transform(F.regexp_extract_all(text, F.lit("([A-Za-z_][A-Za-z0-9_]*|[0-9]+)"), F.lit(1)), lambda t: F.lower(t)), lambda t: (F.length(t) > 2) & ~t.isin(PAGE_STOP)))
    pages = table(spark, sf_dir, "benchmark").select((F.col("item_id")).alias("query_id"), word(F.coalesce("text", F.lit(""))).alias("terms"), F.lit(None).cast("array<string>").alias("excluded"), F.lit(None).cast("string").alias("side"))
    chunks = corpus(spark, sf_dir).filter("source_type = 'kb'").select("id", "ord", word(F.col("text")).alias("terms"), F.lit(None).cast("string").alias("side"))
    return U.overlaps(pages.withColumnRenamed("query_id", "q"), chunks).select(F.col("q").alias("query_id"), "rank", "id", F.col("score").cast("int").alias("overlap"))


def context_items(spark, sf_dir):
    return Flow(spark, sf_dir).items


def citations(spark, sf_dir):
    return Flow(spark, sf_dir).cited


def risks(spark, sf_dir):
    return Flow(spark, sf_dir).risks


def stage_summary(spark, sf_dir):
    f = Flow(spark, sf_dir)
    return R.stage_summary(f.queries, f.hits, f.evidence, f.relations, f.cited, f.risks)


def context_package(spark, sf_dir):
    f = Flow(spark, sf_dir)
    return R.context_package(f.queries, f.hits, f.relations, f.cited, f.risks)


def trust_order(spark, sf_dir):
    return R.trust_order(Flow(spark, sf_dir).hits)


def rag_search(spark, sf_dir):
    """The whole flow: one row for each query with what it found."""
    f = Flow(spark, sf_dir)
    count = lambda df, name: df.groupBy("query_id").agg(F.count("*").alias(name))
    out = f.queries.select("query_id")
    for df, name in ((f.hits, "n_hits"), (f.relations, "n_relations"), (f.cited, "n_citations"), (f.risks, "n_risks")):
        out = out.join(count(df, name), "query_id", "left").fillna(0, [name])
    return out


QUERIES = {f.__name__: f for f in (terms, related_candidates, relations, evidence, related_chunks, context_items, citations, risks, stage_summary, context_package, trust_order, rag_search)}
PAGE_WORDS = "list_distinct(list_filter(list_transform(regexp_extract_all({0}, '[A-Za-z_][A-Za-z0-9_]*|[0-9]+'), lambda t: lower(t)), lambda t: length(t) > 2 AND t NOT IN (" + ", ".join(f"'{w}'" for w in PAGE_STOP) + ")))"
SQL = {
    "terms": f"WITH {EMBED} SELECT id, len({terms_sql('text')})::INT AS n_terms, array_to_string(list_sort({terms_sql('text')}), ',') AS terms FROM corpus",
    "related_candidates": f"WITH {BASE} SELECT query_id, hit_rank::INT AS hit_rank, hit_id, id, overlap, cand_rank FROM cand",
    "relations": f"WITH {BASE} SELECT rel.query_id, hit_id, rel.id, overlap, n::INT AS n, array_to_string(list_sort(list_intersect(ht.terms, rt.terms))[1:8], ',') AS terms FROM rel JOIN ht ON ht.query_id = rel.query_id AND ht.id = rel.hit_id JOIN rt ON rt.id = rel.id",
    "evidence": f"WITH {BASE} SELECT query_id, side, pos::INT AS pos, id, overlap FROM ev",
    "related_chunks": f"""WITH corpus AS ({CORPUS}),
      o AS (SELECT x.query_id, y.id, y.ord, count(*) AS n FROM (SELECT item_id AS query_id, unnest({PAGE_WORDS.format("coalesce(text, '')")}) AS t FROM benchmark) x JOIN (SELECT id, ord, unnest({PAGE_WORDS.format('text')}) AS t FROM corpus WHERE source_type = 'kb') y USING (t) GROUP BY ALL)
      SELECT query_id, rank::INT AS rank, id, n::INT AS overlap FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, ord) AS rank FROM o) WHERE rank <= 5""",
    "context_items": f"WITH {BASE} SELECT query_id, n::INT AS n, id, score FROM items",
    "citations": f"WITH {BASE} SELECT * FROM cites",
    "risks": f"WITH {BASE} SELECT query_id, n::INT AS n, level, risk FROM risk",
    "stage_summary": f"""WITH {BASE}, k AS (SELECT item_id AS query_id, text, (SELECT count(*) FROM hits WHERE hits.query_id = item_id) AS h, (SELECT count(*) FROM ev WHERE ev.query_id = item_id) + (SELECT count(*) FROM rel WHERE rel.query_id = item_id) AS e, (SELECT count(*) FROM cites WHERE cites.query_id = item_id) AS c, (SELECT count(*) FROM risk WHERE risk.query_id = item_id) AS k FROM benchmark)
      SELECT query_id, 'plan' AS stage, CASE WHEN text <> '' THEN 'done' ELSE 'warning' END AS status, CASE WHEN text <> '' THEN 1 ELSE 0 END::BIGINT AS n FROM k
      UNION ALL SELECT query_id, 'retrieve', CASE WHEN h > 0 THEN 'done' ELSE 'warning' END, h FROM k UNION ALL SELECT query_id, 'fuse', CASE WHEN e > 0 THEN 'done' ELSE 'warning' END, e FROM k
      UNION ALL SELECT query_id, 'compose', CASE WHEN c > 0 THEN 'done' ELSE 'warning' END, c FROM k UNION ALL SELECT query_id, 'guard', CASE WHEN k = 0 THEN 'done' ELSE 'warning' END, k FROM k""",
    "context_package": f"""WITH {BASE}, tn AS (SELECT h.query_id, h.rank, h.source_type, title FROM h JOIN cites ON cites.query_id = h.query_id AND cites.id = h.id),
      d AS (SELECT b.item_id AS query_id, b.text, concat_ws(chr(10), 'On: ' || b.text,
          'Knowledge: ' || (SELECT array_to_string(list(title ORDER BY rank)[1:3], ', ') FROM tn WHERE tn.query_id = b.item_id AND source_type <> 'code'),
          'Code: ' || (SELECT array_to_string(list(title ORDER BY rank)[1:3], ', ') FROM tn WHERE tn.query_id = b.item_id AND source_type = 'code'),
          CASE WHEN (SELECT count(*) FROM rel WHERE rel.query_id = b.item_id) > 0 THEN 'Relations: ' || (SELECT count(*) FROM rel WHERE rel.query_id = b.item_id) END) AS draft FROM benchmark b)
      SELECT query_id, draft, concat_ws(chr(10), '# Question', text, '# Draft', draft, '# Sources',
        coalesce((SELECT string_agg(n || '. ' || title || chr(10) || '   at ' || location || chr(10) || '   says ' || excerpt, chr(10) ORDER BY n) FROM cites WHERE cites.query_id = d.query_id), 'none'),
        '# Risks', coalesce((SELECT string_agg('- ' || risk, chr(10) ORDER BY n) FROM risk WHERE risk.query_id = d.query_id), 'none')) AS package FROM d""",
    "trust_order": f"WITH {BASE}, w AS (SELECT query_id, rank, id, CASE WHEN source_type = 'knowledge_asset' AND status = 'confirmed' THEN 40 WHEN source_type = 'knowledge_asset' THEN 30 WHEN source_type = 'kb' THEN 20 WHEN source_type = 'code' THEN 10 ELSE 0 END AS weight FROM h) SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY weight DESC, rank))::INT AS trust_rank, id, weight FROM w",
    "rag_search": f"WITH {BASE} SELECT item_id AS query_id, (SELECT count(*) FROM hits WHERE hits.query_id = item_id) AS n_hits, (SELECT count(*) FROM rel WHERE rel.query_id = item_id) AS n_relations, (SELECT count(*) FROM cites WHERE cites.query_id = item_id) AS n_citations, (SELECT count(*) FROM risk WHERE risk.query_id = item_id) AS n_risks FROM benchmark",
}
