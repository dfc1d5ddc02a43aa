"""Mixing sources to target weights by systematic sampling.

Sources get shares by weight of a total number of words; a target stops at ``LIMIT`` times what its source has, and the excess is
shared anew by weight (water filling: with the sources in the order of size over weight, those before the first one that keeps its share
are the capped ones, so two running sums give the level that all others share). Every document of a source expects target / size
copies. The expected copies are summed along the source, in the order of the documents' sizes, from one random offset on; a document is
emitted once for each integer that its own stretch crosses. So copies are as many as expected, but for less than one, in
every stretch of that order: short and long documents are taken at the same rate, and a source's words miss its target by its largest
document at most. Sums are integers in units of 1 / UNIT copies, so a document never gets more than LIMIT copies through rounding.

Running sums are taken over ranges of (source, size), so that a source of any size lies in many tasks. Only ids and sizes are moved.

Cases: a null or empty text has size 0 and no word is taken; a null source is a source of its own, the last one; repeated rows
are documents each, and which of them gets a further copy is arbitrary; null ids come first among equal sizes; a source without
words has target 0; extra columns are ignored by the plan and kept by :func:`mixture`; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, keep, scratch, table
from .ranking import running_sums

WEIGHTS = (3, 1, 2)
#: The mix's words as a multiple of all words, halved: 3 / 2.
TOTAL_HALVES = 3
LIMIT = 2
UNIT = 1 << 30
SEED = "mix"


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, total_halves: int = TOTAL_HALVES) -> DataFrame:
    """(src, source_size, target) from (src, source_size): weights repeat along the order of src; targets add up to total_halves / 2 of all sizes."""
    exact = lambda c: F.col(c).cast("decimal(28,0)")
    # A source's place by size / weight, in integers: weights divide their product.
    product = 1
    for w in weights:
        product *= w
    ranked = running_sums(cut(sources.withColumn("_all", F.lit("")), "mix-sources"), "_all", [F.col("src")], {"rows": F.lit(1).cast("long")})
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (F.col("rows_before") % len(weights) + 1).cast("int"))
    weighed = cut(ranked.withColumn("weight", weight).withColumn("_key", F.col("source_size") * (F.lit(product) / F.col("weight")).cast("long")), "mix-weights")
    filled = running_sums(weighed, "_all", [F.col("_key"), F.col("src")], {"size": F.col("source_size"), "w": F.col("weight")})
    words_left = total_halves * exact("size_total") - 2 * LIMIT * exact("size_before")  # twice the words that the sources from here on share
    weight_left = exact("w_total") - exact("w_before")
    below = words_left * exact("weight") <= 2 * LIMIT * exact("source_size") * weight_left
    filled = cut(filled.select("src", "source_size", "weight", "_key", words_left.alias("_words"), weight_left.alias("_weights"), below.alias("_free")), "mix-filled")
    first = filled.filter("_free").agg(F.min_by(F.struct("_words", "_weights"), F.struct("_key", "src")).alias("x")).select("x.*").first()
    words, weights_left = (F.lit(x).cast("decimal(38,0)") for x in (first if first and first[0] is not None else (0, 1)))
    own = exact("weight") * words
    capped = own.cast("decimal(38,0)") > (2 * LIMIT * exact("source_size") * weights_left).cast("decimal(38,0)")
    share = own.cast("double") / (2 * weights_left).cast("double")
    return filled.select("src", "source_size", F.when(capped, (LIMIT * F.col("source_size")).cast("double")).otherwise(share).alias("target"))


def copies(docs: DataFrame, size: str = "size", source: str = "source", seed: str = SEED) -> DataFrame:
    """Documents (doc_id, size, source) with ``source_size``, ``target`` and ``copies``; the result is written."""
    with scratch():
        src = F.coalesce(F.concat(F.lit("0"), F.col(source)), F.lit("1"))  # null last
        sized = cut(docs.select("doc_id", F.col(size).cast("long").alias("size"), F.col(source).alias("source"), src.alias("src")), "mix-sizes")
        aims = cut(targets(sized.groupBy("src").agg(F.sum("size").alias("source_size"))), "mix-targets")
        expected = F.when(F.col("source_size") > 0, F.least(F.lit(LIMIT * UNIT), F.round(F.col("target") / F.col("source_size") * UNIT).cast("long"))).otherwise(F.lit(0))
        offset = F.conv(F.substring(F.md5(F.concat(F.lit(seed), "src").cast("binary")), 1, 7), 16, 10).cast("long") * (UNIT >> 28)
        aimed = cut(sized.join(aims, "src").withColumns({"step": expected.cast("long"), "start": offset}), "mix-steps")
        summed = running_sums(aimed, "src", [F.col("size"), F.col("doc_id").asc_nulls_first()], {"sum": F.col("step").cast("decimal(12,0)")})
        crossed = F.expr(f"(sum_before + start + step) div {UNIT}L - (sum_before + start) div {UNIT}L")
        return keep(summed.select("doc_id", "size", "source", "source_size", "target", crossed.cast("int").alias("copies")), "mix-copies")


def mixture(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """The mix itself: each document as often as ``plan`` (doc_id, copies) says, with ``copy_number`` from 1; ids must be unique."""
    chosen = plan.filter("copies > 0").select("doc_id", F.explode(F.sequence(F.lit(1), "copies")).alias("copy_number"))
    return docs.drop("copy_number").join(chosen, "doc_id")


def op12_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its source's target and the words that the mix takes of it."""
    words = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    found = copies(table(spark, sf_dir, "documents").select("doc_id", "source", words.alias("size")))
    return found.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"), "copies")


OP12_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce('0' || source, '1') AS src, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT *, [3, 1, 2][(row_number() OVER (ORDER BY src) - 1) % 3 + 1] AS w FROM (SELECT src, sum(size)::HUGEINT AS source_size FROM d GROUP BY src)),
f AS (SELECT *, 3 * sum(source_size) OVER () - 4 * (sum(source_size) OVER o - source_size) AS words, sum(w) OVER () - (sum(w) OVER o - w) AS weights
  FROM s WINDOW o AS (ORDER BY source_size * 6 // w, src ROWS UNBOUNDED PRECEDING)),
x AS (SELECT words AS x_words, weights AS x_weights FROM f WHERE words * w <= 4 * source_size * weights ORDER BY source_size * 6 // w, src LIMIT 1),
t AS (SELECT src, source_size, CASE WHEN w * x_words > 4 * source_size * x_weights THEN (2 * source_size)::DOUBLE ELSE (w * x_words)::DOUBLE / (2 * x_weights)::DOUBLE END AS target FROM s, x),
e AS (SELECT *, CASE WHEN source_size > 0 THEN least({LIMIT * UNIT}, round(target / source_size::DOUBLE * {UNIT})::BIGINT) ELSE 0 END AS step, ('0x' || substr(md5('{SEED}' || src), 1, 7))::BIGINT * {UNIT >> 28} AS start FROM d JOIN t USING (src)),
c AS (SELECT *, sum(step) OVER (PARTITION BY src ORDER BY size, doc_id NULLS FIRST ROWS UNBOUNDED PRECEDING) + start AS upto FROM e)
SELECT doc_id, size, source_size::BIGINT AS source_size, target, ((upto // {UNIT} - (upto - step) // {UNIT}) * size)::BIGINT AS taken, (upto // {UNIT} - (upto - step) // {UNIT})::INT AS copies FROM c"""
