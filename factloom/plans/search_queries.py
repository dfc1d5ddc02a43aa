"""Queries of embedding and search."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import search as S
from ..sources import index
from ..sources.work import folder
from .adapters import CORPUS, corpus, query_texts, table

TOKENS = "list_transform(regexp_extract_all({0}, '[A-Za-z_][A-Za-z0-9_]*|[0-9]+'), lambda t: lower(t))"
EMBED = f"""corpus AS ({CORPUS}),
dt AS (SELECT id, unnest({TOKENS.format('text')}) AS t FROM corpus),
dv AS (SELECT id, ('0x' || sha256(t)[1:8])::BIGINT % 384 AS bucket, sum(CASE WHEN ('0x' || sha256(t)[9:10])::BIGINT % 2 = 0 THEN 1 ELSE -1 END)::BIGINT AS weight FROM dt GROUP BY 1, 2 HAVING weight <> 0),
dn AS (SELECT id, sum(weight * weight)::BIGINT AS norm2 FROM dv GROUP BY id),
qt AS (SELECT item_id AS query_id, unnest({TOKENS.format("coalesce(text, '')")}) AS t FROM benchmark),
qv AS (SELECT query_id, ('0x' || sha256(t)[1:8])::BIGINT % 384 AS bucket, sum(CASE WHEN ('0x' || sha256(t)[9:10])::BIGINT % 2 = 0 THEN 1 ELSE -1 END)::BIGINT AS weight FROM qt GROUP BY 1, 2),
qn AS (SELECT query_id, sum(weight * weight)::BIGINT AS norm2 FROM qv GROUP BY query_id),
dots AS (SELECT query_id, id, sum(qv.weight * dv.weight)::BIGINT AS dot FROM qv JOIN dv USING (bucket) GROUP BY 1, 2)"""


def hits_sql(condition: str = "true", name: str = "hits", k: int = 5) -> str:
    """CTE of the top-k hits of all queries among the corpus rows that meet a condition."""
    return f"""{name} AS (
  SELECT * FROM (
    SELECT b.item_id AS query_id, c.id, c.ord, row_number() OVER (PARTITION BY b.item_id ORDER BY s DESC, c.ord) AS rank, s AS score
    FROM (SELECT b.item_id, c.id, coalesce(floor(coalesce(dot, 0)::DOUBLE / (sqrt(qn.norm2::DOUBLE) * sqrt(dn.norm2::DOUBLE)) * 1000000 + 0.5) / 1000000, 0) AS s
      FROM benchmark b CROSS JOIN corpus c LEFT JOIN dots ON dots.query_id = b.item_id AND dots.id = c.id LEFT JOIN qn ON qn.query_id = b.item_id LEFT JOIN dn ON dn.id = c.id WHERE {condition}) x
    JOIN benchmark b ON b.item_id = x.item_id JOIN corpus c ON c.id = x.id) WHERE rank <= {k})"""


def hits(spark, sf_dir, condition="true", k=5):
    """Top-k hits of all benchmark texts."""
    return S.search(query_texts(spark, sf_dir), S.vector_rows(corpus(spark, sf_dir).filter(condition)), k)


def tokens(spark, sf_dir):
    own = S.tokens(F.col("text"))
    return corpus(spark, sf_dir).select("id", F.size(own).alias("n_tokens"), F.size(F.array_distinct(own)).alias("n_distinct"), F.sha2(F.array_join(own, " "), 256).alias("digest"))


def hash_embed(spark, sf_dir):
    return S.hash_embed(corpus(spark, sf_dir))


def vec_norm(spark, sf_dir):
    return S.vector_norms(S.hash_embed(corpus(spark, sf_dir)))


def search_topk(spark, sf_dir):
    return hits(spark, sf_dir)


def search_filtered(spark, sf_dir):
    return hits(spark, sf_dir, "source_type = 'kb' and status <> 'stale'", 3)


def dense_topk(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    rows = e.select(F.col("vec_id").alias("id"), F.col("vec_id").alias("ord"), "embedding")
    return S.dense_search(e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), rows)


def index_status(spark, sf_dir):
    return S.index_status(corpus(spark, sf_dir))


def facet_share(spark, sf_dir):
    return S.facet_share(corpus(spark, sf_dir), "kind")


def browse(spark, sf_dir):
    return S.browse(corpus(spark, sf_dir), "The ", source_type="code", limit=50, offset=10).select("id", "file_path", "kind")


def matched_terms(spark, sf_dir):
    found = hits(spark, sf_dir)
    q = query_texts(spark, sf_dir).withColumnRenamed("text", "query")
    return found.join(q, "query_id").join(corpus(spark, sf_dir).select("id", "text"), "id").select("query_id", "id", F.array_join(S.matched_terms(F.col("query"), F.col("text")), ",").alias("terms"))


def _index(spark, sf_dir):
    """An index by source: built from all records, then two sources are rebuilt from a seventh of theirs (one of them has none), and a third of all records is appended anew; one build is repeated."""
    path, rows = folder(spark, "index"), corpus(spark, sf_dir).withColumn("project", F.element_at(F.split("file_path", "/"), 1))
    made = S.vector_rows(rows.withColumn("made", F.lit("first")))
    index.build(made, path, "project", "first")
    some = S.vector_rows(rows.filter("project = 'src1' and ord % 7 = 0").withColumn("made", F.lit("again")))
    index.build(some, path, "project", "again", tenants=spark.createDataFrame([("src2",)], "tenant string"))
    more = S.vector_rows(rows.filter("ord % 3 = 0").withColumn("made", F.lit("more")))
    for _ in range(2):
        index.build(more, path, "project", "more", append=True)
    return path


def index_builds(spark, sf_dir):
    return index.read(spark, _index(spark, sf_dir)).select("tenant", "id", "made")


def tenant_search(spark, sf_dir):
    """Each of two tenants is searched for all benchmark texts, among its code records."""
    path = _index(spark, sf_dir)
    own = [S.search(query_texts(spark, sf_dir), index.read(spark, path, [t]).filter("source_type = 'code'"), 3).withColumn("tenant", F.lit(t)) for t in ("src1", "src3")]
    return own[0].unionByName(own[1])


def tenant_listing(spark, sf_dir):
    """The second page of a tenant's records."""
    rows = index.read(spark, _index(spark, sf_dir), ["src0"]).select("tenant", "ord", "id", "kind", "source_type", "made")
    last = index.page(rows, "ord", limit=5, source_type="code").agg(F.max("ord")).first()[0]
    return index.page(rows, "ord", last, 5, "code")


QUERIES = {f.__name__: f for f in (index_builds, tenant_search, tenant_listing, tokens, hash_embed, vec_norm, search_topk, search_filtered, dense_topk, index_status, facet_share, browse, matched_terms)}
INDEX = """c AS (SELECT *, string_split(file_path, '/')[1] AS tenant FROM corpus),
held AS (SELECT *, CASE WHEN ord % 3 = 0 THEN 'more' WHEN tenant = 'src1' THEN 'again' ELSE 'first' END AS made FROM c WHERE ord % 3 = 0 OR CASE tenant WHEN 'src1' THEN ord % 7 = 0 WHEN 'src2' THEN false ELSE true END)"""


def _tenant_hits(tenant: str) -> str:
    return hits_sql(f"c.source_type = 'code' AND c.id IN (SELECT id FROM held WHERE tenant = '{tenant}')", f"hits_{tenant}", 3)


SQL = {
    "index_builds": f"WITH corpus AS ({CORPUS}), {INDEX} SELECT tenant, id, made FROM held",
    "tenant_search": f"WITH {EMBED}, {INDEX}, {_tenant_hits('src1')}, {_tenant_hits('src3')} " + " UNION ALL ".join(f"SELECT query_id, rank::INT AS rank, id, ord, score, '{t}' AS tenant FROM hits_{t}" for t in ("src1", "src3")),
    "tenant_listing": f"WITH corpus AS ({CORPUS}), {INDEX} SELECT tenant, ord, id, kind, source_type, made FROM held WHERE tenant = 'src0' AND source_type = 'code' ORDER BY ord LIMIT 5 OFFSET 5",
    "tokens": f"WITH corpus AS ({CORPUS}), t AS (SELECT id, {TOKENS.format('text')} AS t FROM corpus) SELECT id, len(t)::INT AS n_tokens, len(list_distinct(t))::INT AS n_distinct, sha256(array_to_string(t, ' ')) AS digest FROM t",
    "hash_embed": f"WITH {EMBED} SELECT id, bucket::INT AS bucket, weight FROM dv",
    "vec_norm": f"WITH {EMBED} SELECT id, norm2 FROM dn",
    "search_topk": f"WITH {EMBED}, {hits_sql()} SELECT query_id, rank::INT AS rank, id, ord, score FROM hits",
    "search_filtered": f"WITH {EMBED}, {hits_sql(chr(39).join(['source_type = ', 'kb', ' AND status <> ', 'stale', '']), k=3)} SELECT query_id, rank::INT AS rank, id, ord, score FROM hits",
    "dense_topk": """WITH n AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), s AS (
      SELECT q.vec_id AS query_id, d.vec_id AS id, round(list_cosine_similarity(q.e, d.e), 6) AS score FROM n q CROSS JOIN n d WHERE q.vec_id % 100 = 0)
      SELECT query_id, rank::INT AS rank, id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 5""",
    "index_status": f"WITH corpus AS ({CORPUS}) SELECT 'source_type' AS facet, source_type AS value, count(*) AS n FROM corpus GROUP BY 2 UNION ALL SELECT 'kind', kind, count(*) FROM corpus GROUP BY 2 UNION ALL SELECT 'total', '', count(*) FROM corpus",
    "facet_share": f"WITH corpus AS ({CORPUS}) SELECT kind AS value, count(*) AS n, greatest(4.0, floor(100.0 * count(*) / sum(count(*)) OVER () + 0.5))::DOUBLE AS share FROM corpus GROUP BY kind ORDER BY n DESC, value LIMIT 8",
    "browse": f"WITH corpus AS ({CORPUS}) SELECT id, file_path, kind FROM corpus WHERE source_type = 'code' AND contains(lower(id || chr(10) || text || chr(10) || file_path), 'the ') ORDER BY ord LIMIT 50 OFFSET 10",
    "matched_terms": f"WITH {EMBED}, {hits_sql()} SELECT h.query_id, h.id, array_to_string(list_sort(list_distinct(list_intersect({TOKENS.format('b.text')}, {TOKENS.format('c.text')}))), ',') AS terms FROM hits h JOIN benchmark b ON b.item_id = h.query_id JOIN corpus c ON c.id = h.id",
}
