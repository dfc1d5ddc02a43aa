"""Retrieval report of many queries at once: context, citations, risks, stages and a context package."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LOW_SCORE, CITATIONS, EXCERPT = 0.15, 8, 180


def first_of(*columns: Column) -> Column:
    """The first non-empty text."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])


def excerpt(text: Column, limit: int = EXCERPT) -> Column:
    """White space collapsed, cut to ``limit`` characters."""
    flat = F.trim(F.regexp_replace(text, "[\\x20\\x09-\\x0D]+", " "))
    return F.when(F.length(flat) <= limit, flat).otherwise(F.concat(F.rtrim(F.substring(flat, 1, limit)), F.lit("...")))


def context_items(hits: DataFrame, evidence: DataFrame) -> DataFrame:
    """(query_id, n, id, score): direct hits, then related knowledge, then related code; the first occurrence of an id counts.

    Direct hits hold the knowledge and code hits already, so those groups add nothing.
    """
    direct = hits.select("query_id", F.lit(0).alias("g"), F.col("rank").alias("pos"), "id", F.col("score").cast("double").alias("score"))
    related = evidence.select("query_id", F.when(F.col("side") == "knowledge", 1).otherwise(2).alias("g"), "pos", "id", F.col("overlap").cast("double").alias("score"))
    once = F.row_number().over(Window.partitionBy("query_id", "id").orderBy("g", "pos"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("g", "pos"))
    return direct.unionByName(related).filter("id <> ''").withColumn("k", once).filter("k = 1").withColumn("n", place).select("query_id", "n", "id", "score")


#: The columns that can name a record, the first non-empty one counts.
TITLES = ["title", "symbol_name", "doc_name", "section", "kind"]


def citations(items: DataFrame, records: DataFrame, n: int = CITATIONS) -> DataFrame:
    """(query_id, n, id, title, location, score, excerpt, source_type): the first ``n`` items. Titles come from the first of :data:`TITLES` that a record has
    and fills, else ``fragment``; a location is the path, with the line if there is one. Null and empty values are the same."""
    title = first_of(*[F.col(c).cast("string") for c in TITLES if c in records.columns], F.lit("fragment"))
    path = F.coalesce("file_path", F.lit(""))
    location = path if "start_line" not in records.columns else F.when((path != "") & (F.col("start_line") > 0), F.concat_ws(":", path, F.col("start_line").cast("string"))).otherwise(path)
    own = records.select("id", title.alias("title"), location.alias("location"), excerpt(F.col("text")).alias("excerpt"), "source_type")
    return items.filter(F.col("n") <= n).join(own, "id").select("query_id", "n", "id", "title", "location", "score", "excerpt", "source_type")


def risks(queries: DataFrame, hits: DataFrame, evidence: DataFrame) -> DataFrame:
    """(query_id, n, level, risk): without hits only ``no_hits``; else those of four rules that hold. hits have source_type and status."""
    asset = (F.col("source_type") == "knowledge_asset") & (F.col("status") == "confirmed")
    facts = hits.groupBy("query_id").agg(
        F.max("score").alias("top"), F.bool_or(asset).alias("confirmed"), F.bool_or(F.col("status").isin("draft", "pending_review", "stale")).alias("unsure"), F.bool_or(F.col("source_type") == "code").alias("code")
    )
    related = evidence.filter("side = 'code'").select("query_id").distinct().withColumn("related_code", F.lit(True))
    found = queries.select("query_id").join(facts, "query_id", "left").join(related, "query_id", "left")
    some = F.col("top").isNotNull()
    rules = [
        (~some, "high", "no_hits"),
        (some & (F.col("top") < LOW_SCORE), "medium", "low_score"),
        (some & ~F.col("confirmed"), "medium", "no_confirmed_asset"),
        (some & F.col("unsure"), "low", "unreviewed"),
        (some & ~F.col("code") & F.col("related_code").isNull(), "low", "no_code"),
    ]
    listed = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(i).alias("n"), F.lit(level).alias("level"), F.lit(name).alias("risk"))) for i, (c, level, name) in enumerate(rules)]))
    return found.select("query_id", F.inline(listed))


def stage_summary(queries: DataFrame, hits: DataFrame, evidence: DataFrame, relations: DataFrame, cited: DataFrame, risky: DataFrame) -> DataFrame:
    """(query_id, stage, status, n): plan, retrieve, fuse, compose, guard."""
    count = lambda df, name: df.groupBy("query_id").agg(F.count("*").alias(name))
    found = queries
    for df, name in ((hits, "h"), (evidence, "e"), (relations, "r"), (cited, "c"), (risky, "k")):
        found = found.join(count(df, name), "query_id", "left")
    n = {name: F.coalesce(name, F.lit(0)) for name in "herck"}
    done = lambda c: F.when(c, "done").otherwise("warning")
    plan = F.col("text") != ""
    stages = [
        ("plan", done(plan), F.when(plan, 1).otherwise(0).cast("long")), ("retrieve", done(n["h"] > 0), n["h"]), ("fuse", done(n["e"] + n["r"] > 0), n["e"] + n["r"]),
        ("compose", done(n["c"] > 0), n["c"]), ("guard", done(n["k"] == 0), n["k"]),
    ]
    return found.select("query_id", F.inline(F.array(*[F.struct(F.lit(s).alias("stage"), status.alias("status"), c.alias("n")) for s, status, c in stages])))


def context_package(queries: DataFrame, hits: DataFrame, relations: DataFrame, cited: DataFrame, risky: DataFrame) -> DataFrame:
    """(query_id, draft, package): a draft answer from titles and counts, and the whole text with sources and risks."""
    titled = hits.join(cited.select("query_id", "id", "title"), ["query_id", "id"])
    ordered = lambda c, by: F.transform(F.array_sort(F.collect_list(F.when(c, F.struct(by, "title")))), lambda x: x["title"])
    names = titled.groupBy("query_id").agg(ordered(F.col("source_type").isin("kb", "knowledge_asset"), "rank").alias("kn"), ordered(F.col("source_type") == "code", "rank").alias("co"))
    line = F.concat_ws("\n", F.concat(F.col("n"), F.lit(". "), "title"), F.concat(F.lit("   at "), "location"), F.concat(F.lit("   says "), "excerpt"))
    sources = cited.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", line.alias("l")))), lambda x: x["l"]), "\n").alias("sources"))
    warnings = risky.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", F.concat(F.lit("- "), "risk").alias("l")))), lambda x: x["l"]), "\n").alias("warnings"))
    related = relations.groupBy("query_id").agg(F.count("*").alias("r"))
    found = queries
    for df in (names, sources, warnings, related):
        found = found.join(df, "query_id", "left")
    top = lambda c, head: F.when(F.size(F.coalesce(c, F.array().cast("array<string>"))) > 0, F.concat(F.lit(head), F.array_join(F.slice(c, 1, 3), ", ")))
    draft = F.concat_ws("\n", F.concat(F.lit("On: "), "text"), top(F.col("kn"), "Knowledge: "), top(F.col("co"), "Code: "), F.when(F.col("r") > 0, F.concat(F.lit("Relations: "), "r")))
    package = F.concat_ws("\n", F.lit("# Question"), F.col("text"), F.lit("# Draft"), draft, F.lit("# Sources"), F.coalesce("sources", F.lit("none")), F.lit("# Risks"), F.coalesce("warnings", F.lit("none")))
    return found.select("query_id", draft.alias("draft"), package.alias("package"))


def trust_order(hits: DataFrame) -> DataFrame:
    """(query_id, trust_rank, id, weight): by trust in the source, stable within a weight."""
    asset = F.col("source_type") == "knowledge_asset"
    weight = F.when(asset & (F.col("status") == "confirmed"), 40).when(asset, 30).when(F.col("source_type") == "kb", 20).when(F.col("source_type") == "code", 10).otherwise(0)
    return hits.withColumn("weight", weight).withColumn("trust_rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("weight"), "rank"))).select("query_id", "trust_rank", "id", "weight")
