"""Merkle manifest of a table: a leaf for each row, a tree over each group's leaves, and a tree over the groups' roots.

A node of the tree has ``FANOUT`` children, the last one of a level fewer. The rows of a group, numbered by their order, are cut into blocks
of FANOUT ** DEPTH leaves, so that the first DEPTH levels of a block need no other block. Within a block all leaves stay as rows; a
node's digest stands in the row of its first leaf. On level j the children of one parent are FANOUT ** j rows apart, so lag and lead
columns of fixed offsets, masked by the node's slot and by the length of its run, supply its siblings, and the rows of first children
hash the parents. All levels of a block share one shuffle and one sort. The blocks' roots are the leaves of the next tier, until
one node of each group is left; the groups' roots are one more group. No window holds more than FANOUT ** DEPTH rows, however large a group is.

Cases: a null field is ``-``; a null group is a group of its own, before all others; rows of one group with equal keys come in the order of
their leaves, null keys first; repeated rows are leaves each; a lone leaf is its group's root and a lone group's root the root; a
row whose key is null is not tampered with; extra columns are ignored; texts of any length are hashed whole, inside the JVM; an empty
table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, keep, scratch, table
from .ranking import running_sums

FANOUT, DEPTH = 3, 7
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def digest(*parts: Column) -> Column:
    """Lower-case hex SHA-256 of the parts' text."""
    return F.sha2(F.concat(*parts), 256)


def leaf(**fields: Column) -> Column:
    """Digest of a row: for each field its UTF-8 length, a colon and its value, or ``-``."""
    as_text = [c.cast("string") for c in fields.values()]
    return digest(*[F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in as_text])


def _block_levels(nodes: DataFrame, depth: int) -> DataFrame:
    """Nodes (grp, pos, n, digest) with ``block``, ``levels`` (the siblings before and after on each level inside the block), ``top``
    (the block's root, in the row of its first leaf)."""
    window = Window.partitionBy("grp", "block").orderBy("pos")
    so_far = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = nodes.withColumn("block", F.floor(F.col("pos") / FANOUT**depth)).withColumn("top", F.col("digest"))
    for level in range(depth):
        span = FANOUT**level
        index, count = F.floor(F.col("pos") / span), F.ceil(F.col("n") / span)
        slot = index % FANOUT
        run = F.least(F.lit(FANOUT), count - index + slot)
        heads = (F.col("pos") % span == 0) & (count > 1)
        lags = {f"_lag{k}": F.lag("top", k * span).over(window) for k in range(1, FANOUT)}
        leads = {f"_lead{k}": F.lead("top", k * span).over(window) for k in range(1, FANOUT)}
        shown = lambda mask, c: F.when(mask, F.col(c)).otherwise(F.lit(""))
        before = F.concat(*[shown(slot >= k, f"_lag{k}") for k in range(FANOUT - 1, 0, -1)])
        after = F.concat(*[shown(slot + k < run, f"_lead{k}") for k in range(1, FANOUT)])
        at = at.withColumns(lags | leads).withColumn(f"_at{level}", F.when(heads, F.struct(before.alias("before"), after.alias("after"))))
        parent = F.when(heads & (slot == 0), digest(F.col("top"), F.col(f"_at{level}.after"))).when(count == 1, F.col("top"))
        at = at.withColumn("top", parent).drop(*lags, *leads)
    at = at.withColumns({f"_at{level}": F.last(f"_at{level}", ignorenulls=True).over(so_far) for level in range(1, depth)})
    return at.select(*nodes.columns, "block", F.array_compact(F.array(*[f"_at{level}" for level in range(depth)])).alias("levels"), "top")


def tree(nodes: DataFrame, largest: int, finish) -> DataFrame:
    """Nodes (grp, pos from 0 on, n of the group, digest, ...) with ``levels``, their siblings on the way up, and the columns that
    ``finish`` gives: it gets the groups' roots, in the same columns, and adds levels of its own. ``largest``: the greatest n."""
    if largest <= 1:
        return finish(nodes)
    depth = 1
    while depth < DEPTH and FANOUT**depth < largest:
        depth += 1
    found = cut(_block_levels(nodes, depth), "merkle-tier")
    tops = found.filter(F.col("pos") % FANOUT**depth == 0).select("grp", F.col("block").alias("pos"), F.ceil(F.col("n") / FANOUT**depth).alias("n"), F.col("top").alias("digest"))
    above = tree(tops, -(-largest // FANOUT**depth), finish).drop("n", "digest").withColumnsRenamed({"pos": "block", "levels": "_more"})
    rest = [c for c in above.columns if c not in ("grp", "block", "_more")]
    return found.join(above, ["grp", "block"]).select(*nodes.columns, F.concat("levels", "_more").alias("levels"), *rest)


def fold(start: Column, levels: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(levels, start, lambda x, at: digest(at["before"], x, at["after"]))


def _placed(leaves: DataFrame, group: str, order: list[Column]) -> DataFrame:
    """Leaves with ``pos`` and ``n``, their place in the group and its size."""
    return running_sums(leaves, group, order, {"rows": F.lit(1).cast("long")}).withColumnsRenamed({"rows_before": "pos", "rows_total": "n"})


def manifest(leaves: DataFrame, group: str, order: str) -> DataFrame:
    """``leaves`` (with a column ``leaf``) with ``levels`` (array of siblings before and after, from the leaf up to the root of all),
    ``subroot`` and ``root``. The result is written; it is the manifest."""
    own = [c for c in leaves.columns if c not in ("grp", "pos", "n", "digest", "levels", "subroot", "root")]
    no_levels = F.array().cast("array<struct<before: string, after: string>>").alias("levels")

    def above_groups(subroots: DataFrame) -> DataFrame:
        subroots = cut(subroots.select("grp", "pos", "n", "digest", F.lit("").alias("_all")), "merkle-subroots")
        ranked = _placed(subroots.select(F.col("_all").alias("grp"), F.col("grp").alias("_own"), "digest"), "grp", [F.col("_own")])
        whole = tree(ranked, subroots.count(), lambda roots: roots.select("*", no_levels, F.col("digest").alias("root")))
        return subroots.drop("_all").withColumn("subroot", F.col("digest")).join(whole.select(F.col("_own").alias("grp"), "levels", "root"), "grp")

    with scratch():
        keyed = cut(leaves.select(*own, F.coalesce(F.concat(F.lit("1"), F.col(group)), F.lit("0")).alias("grp"), F.col("leaf").alias("digest")), "merkle-leaves")
        largest = keyed.groupBy("grp").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
        placed = _placed(keyed, "grp", [F.col(order).asc_nulls_first(), F.col("digest")])
        return keep(tree(placed, max(2, largest), above_groups).select(*own, "levels", "subroot", "root"), "merkle-manifest")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf, roots and proof, and what folding a tampered leaf gives."""
    docs = table(spark, sf_dir, "documents")
    fields = {c: F.col(c) for c in FIELDS}
    own = leaf(**fields)
    bare = leaf(**fields | {"text": F.replace("text", F.lit("\n"), F.lit(""))})
    hit = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0) & F.contains("text", F.lit("\n"))
    leaves = docs.select("doc_id", "source", own.alias("leaf"), F.when(hit, bare).otherwise(own).alias("shown"))
    found = manifest(leaves, "source", "doc_id").withColumn("folded_root", fold(F.col("shown"), F.col("levels")))
    proof = F.sha2(F.array_join(F.transform("levels", lambda at: F.concat(at["before"], at["after"])), ""), 256)
    return found.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


#: CRC-32 by its polynomial, byte by byte; trees level by level; a leaf's way up level by level.
OP11_SQL = r"""
WITH RECURSIVE rem AS (SELECT list(r ORDER BY b) AS t FROM (SELECT b, list_reduce(range(8), lambda r, i: CASE WHEN r % 2 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END, b) AS r FROM range(256) AS v(b))),
f AS (SELECT *, chr(10) AS nl, CASE WHEN doc_id IS NULL THEN '-' ELSE length(doc_id::VARCHAR) || ':' || doc_id END || CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END
    || CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END || CASE WHEN n_chars IS NULL THEN '-' ELSE length(n_chars::VARCHAR) || ':' || n_chars END AS head,
    xor(list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT), lambda c, x: xor(c >> 8, t[xor(c & 255, x) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) AS crc FROM documents, rem),
l AS MATERIALIZED (SELECT doc_id, source, sha256(head || CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END) AS leaf,
    sha256(head || CASE WHEN text IS NULL THEN '-' WHEN crc % 2 = 0 THEN strlen(replace(text, nl, '')) || ':' || replace(text, nl, '') ELSE strlen(text) || ':' || text END) AS shown FROM f),
p AS MATERIALIZED (SELECT *, coalesce('1' || source, '0') AS g, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM l),
up AS (
  SELECT g, 0 AS level, pos, n, leaf AS d FROM p
  UNION ALL
  SELECT g, level + 1, pos // 3, (n + 2) // 3, sha256(string_agg(d, '' ORDER BY pos)) FROM up WHERE n > 1 GROUP BY g, level, pos // 3, n
),
s AS MATERIALIZED (SELECT g, d, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS n FROM up WHERE n = 1),
top AS (
  SELECT 0 AS level, pos, n, d FROM s
  UNION ALL
  SELECT level + 1, pos // 3, (n + 2) // 3, sha256(string_agg(d, '' ORDER BY pos)) FROM top WHERE n > 1 GROUP BY level, pos // 3, n
),
both_trees AS (SELECT g, level, pos, n, d FROM up UNION ALL SELECT s.g, 1000 + level, top.pos, top.n, top.d FROM top JOIN s ON top.pos // 3 = s.pos // pow(3, level + 1)::BIGINT),
ways AS (
  SELECT p.g, p.pos, b.level, coalesce(string_agg(b.d, '' ORDER BY b.pos) FILTER (b.pos < own), '') AS before, coalesce(string_agg(b.d, '' ORDER BY b.pos) FILTER (b.pos > own), '') AS after
  FROM (SELECT g, pos, n FROM p) p JOIN s USING (g) JOIN both_trees b ON b.g = p.g AND b.n > 1
    JOIN LATERAL (SELECT CASE WHEN b.level < 1000 THEN p.pos // pow(3, b.level)::BIGINT ELSE s.pos // pow(3, b.level - 1000)::BIGINT END AS own) o ON b.pos // 3 = own // 3
  GROUP BY p.g, p.pos, b.level
),
way AS (SELECT g, pos, list({'b': before, 'a': after} ORDER BY level) AS levels FROM ways GROUP BY g, pos),
folded AS (
  SELECT g, pos, shown AS d, 1 AS i, coalesce(levels, []) AS levels FROM p LEFT JOIN way USING (g, pos)
  UNION ALL
  SELECT g, pos, sha256(levels[i].b || d || levels[i].a), i + 1, levels FROM folded WHERE i <= len(levels)
)
SELECT doc_id, leaf, s.d AS subroot, (SELECT d FROM top WHERE n = 1) AS root, sha256(coalesce(list_reduce(list_transform(levels, lambda x: x.b || x.a), lambda x, y: x || y, ''), '')) AS proof_sha256,
  f.d AS folded_root, f.d = (SELECT d FROM top WHERE n = 1) AS verified
FROM p JOIN s USING (g) JOIN folded f ON f.g = p.g AND f.pos = p.pos WHERE i > len(levels)"""
