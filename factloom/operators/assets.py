"""Knowledge assets: normalisation, pages, lifecycle, and links to facts by evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Kinds and states of assets.
TYPES = ["business_rule", "adr", "incident", "api_doc", "standard", "glossary", "module_note"]
STATUSES = ["draft", "pending_review", "confirmed", "stale", "archived"]


def norm_tags(raw: Column, n: int = 12) -> Column:
    """The first ``n`` distinct tags of a text, cut at commas (both kinds) and blanks."""
    return F.slice(F.array_distinct(F.filter(F.split(raw, "[,\\uFF0C\\x20\\x09-\\x0D]+"), lambda t: t != "")), 1, n)


def norm_evidence(evidence: DataFrame, n: int = 20) -> DataFrame:
    """Evidence rows with a path, a symbol or a note, the first ``n`` of each asset, null lines as 0."""
    text = [F.trim(F.coalesce(c, F.lit(""))).alias(c) for c in ("file_path", "symbol_name", "note")]
    rows = evidence.select("asset_id", "ord", *text, F.coalesce("start_line", F.lit(0)).alias("start_line"), F.coalesce("end_line", F.lit(0)).alias("end_line")).filter("file_path <> '' or symbol_name <> '' or note <> ''")
    return rows.withColumn("r", F.row_number().over(Window.partitionBy("asset_id").orderBy("ord"))).filter(F.col("r") <= n).drop("r")


def validate_assets(assets: DataFrame) -> DataFrame:
    """Assets with ``reason``: why a row is rejected, null for valid ones."""
    reason = F.when(F.trim(F.coalesce("title", F.lit(""))) == "", "title required").when(~F.col("type").isin(TYPES), "unknown type").when(~F.col("status").isin(STATUSES), "unknown status")
    return assets.withColumn("reason", reason)


def slug(text: Column, default: str = "item") -> Column:
    """Lower-cased letters, digits, ``_`` and ``-``; other runs become ``-``."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9_-]+", "-"), "^-+|-+$", "")
    return F.when(bare == "", default).otherwise(bare)


def unique_slugs(df: DataFrame, text: str, order: str, existing: DataFrame | None = None) -> DataFrame:
    """Add ``slug``: in ascending ``order``, each row takes its slug if nobody has it, else the first free one of ``-2``, ``-3`` and so on.

    Only slugs that agree but for numbers at their end can collide. Where no such number is in sight, the n-th row of a slug gets
    ``-n``; the others are settled family by family, on (order, slug) rows alone.
    """
    family = lambda c: F.regexp_replace(c, "(-[0-9]+)+$", "")
    base = df.withColumns({"_base": slug(F.col(text)), "_family": family(slug(F.col(text)))})
    taken = df.sparkSession.createDataFrame([], "slug string") if existing is None else existing.select("slug").distinct()
    taken = taken.select(family(F.col("slug")).alias("_family"), "slug")
    mixed = base.filter("_base <> _family").select("_family").union(taken.select("_family")).distinct()
    n = F.row_number().over(Window.partitionBy("_base").orderBy(order))
    plain = base.join(mixed, "_family", "left_anti").withColumn("slug", F.when(n == 1, F.col("_base")).otherwise(F.concat("_base", F.lit("-"), n)))

    def settle(rows, has):
        used, following, found = set(has["slug"]), {}, []
        rows = rows.sort_values("_order", kind="stable")
        for name in rows["_base"]:
            own, k = name, following.get(name, 2)
            while own in used:
                own, k = f"{name}-{k}", k + 1
            following[name] = k
            used.add(own), found.append(own)
        return rows.assign(slug=found)[["_order", "_base", "slug"]]

    kind = df.schema[order].dataType.simpleString()
    inside = base.join(mixed, "_family", "left_semi")
    settled = inside.select("_family", F.col(order).alias("_order"), "_base").groupBy("_family").cogroup(taken.groupBy("_family")).applyInPandas(settle, f"_order {kind}, _base string, slug string")
    named = settled.withColumnRenamed("_base", "_b")
    moved = inside.join(named, (F.col(order) == F.col("_order")) & (F.col("_base") == F.col("_b")))
    return plain.unionByName(moved, allowMissingColumns=True).select(*[f"`{c}`" for c in df.columns], "slug")


def nest_assets(assets: DataFrame, tags: DataFrame, evidence: DataFrame) -> DataFrame:
    """(id, tags, evidence) with the children in their order, empty arrays where there are none."""
    t = tags.groupBy(F.col("asset_id").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "tag"))), lambda x: x["tag"]).alias("tags"))
    e = evidence.groupBy(F.col("asset_id").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "file_path", "symbol_name"))), lambda x: F.concat(x["file_path"], F.lit("|"), x["symbol_name"])).alias("evidence"))
    none = F.array().cast("array<string>")
    return assets.join(t, "id", "left").join(e, "id", "left").withColumns({"tags": F.coalesce("tags", none), "evidence": F.coalesce("evidence", none)})


def page_assets(assets: DataFrame, tags: DataFrame, evidence: DataFrame, text: str = "", kind: str | None = None, status: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of assets, newest (largest ord) first, that contain a text themselves, in a tag or in evidence, with the ``total`` of all pages; limit clamped to 1..100."""
    found = assets
    for name, value in (("type", kind), ("status", status)):
        found = found.filter(F.col(name) == value) if value else found
    if text:
        has = lambda *c: F.contains(F.lower(F.concat_ws("\n", *c)), F.lit(text.lower()))
        ids = found.filter(has("title", "content")).select("id").union(tags.filter(has("tag")).select("asset_id")).union(evidence.filter(has("file_path", "symbol_name")).select("asset_id")).distinct()
        found = found.join(ids, "id", "left_semi")
    return found.orderBy(F.desc("ord")).offset(max(0, offset)).limit(min(100, max(1, limit))).withColumn("total", found.agg(F.count("*")).scalar())


def match_evidence(evidence: DataFrame, facts: DataFrame) -> DataFrame:
    """(asset_id, ord, key): facts that evidence points at.

    A symbol must equal one of the fact's names, whatever the case; a path must equal the fact's or be its suffix, or the reverse;
    lines must overlap. A path alone matches file facts only. Symbols and last path parts are equality joins, the rest is filtered.
    """
    e = evidence.select("asset_id", "ord", F.trim(F.replace(F.coalesce("file_path", F.lit("")), F.lit("\\"), F.lit("/"))).alias("e_path"), F.lower(F.trim(F.coalesce("symbol_name", F.lit("")))).alias("symbol"), "start_line", "end_line")
    f = facts.select("key", "type", F.col("file_path").alias("f_path"), F.col("start_line").alias("f0"), F.when(F.col("end_line") > 0, F.col("end_line")).otherwise(F.col("start_line")).alias("f1"), "symbol_name", "enclosing_type", "enclosing_method")
    inside = (F.col("e_path") == F.col("f_path")) | F.endswith("f_path", F.concat(F.lit("/"), "e_path")) | F.endswith("e_path", F.concat(F.lit("/"), "f_path"))
    last = F.when(F.col("end_line") > 0, F.col("end_line")).otherwise(F.col("start_line"))
    lines = (F.col("start_line") <= 0) | ((F.col("f0") > 0) & (F.col("f0") <= last) & (F.col("f1") >= F.col("start_line")))
    names = f.withColumn("symbol", F.explode(F.array_distinct(F.filter(F.transform(F.array("symbol_name", "enclosing_type", "enclosing_method"), lambda x: F.lower(x)), lambda x: x != ""))))
    by_symbol = e.filter("symbol <> ''").join(names, "symbol").filter(((F.col("e_path") == "") | inside) & lines)
    base = lambda c: F.element_at(F.split(c, "/"), -1)
    by_path = e.filter("symbol = '' and e_path <> ''").withColumn("b", base(F.col("e_path"))).join(f.filter("type = 'file'").withColumn("b", base(F.col("f_path"))), "b").filter(inside & lines)
    return by_symbol.select("asset_id", "ord", "key").unionByName(by_path.select("asset_id", "ord", "key")).distinct()


def links(matches: DataFrame) -> DataFrame:
    """(asset_id, key, ord): one link for each asset and fact, by the first evidence."""
    return matches.groupBy("asset_id", "key").agg(F.min("ord").alias("ord"))


#: What a change log may say: ``confirm`` and ``stale`` transitions, and updates that state fields.
ACTIONS = {"confirm": "confirmed", "stale": "stale"}


def transition(assets: DataFrame, changes: DataFrame) -> DataFrame:
    """Assets (id, status, reviewer, confirmed_at, ...) after a log of changes (id, action, by, at, seq, status, reviewer, confirmed_at), applied in the order (at, seq).

    ``confirm`` sets the status and always stamps reviewer and time; ``stale`` sets the status alone. An ``update`` takes over the fields that
    it states, empty ones stay; if the asset is confirmed after it and has no time of confirmation, it gets the update's, and the updater as
    reviewer unless it has one. Other actions and updates to an unknown status change nothing.

    A log is not replayed: a stamp that is set stays set, so the last change that sets a field decides it, and what an update fills in counts only
    if no change before has set it. So each asset needs a handful of first and last changes, which are aggregated before the shuffle; an asset
    may have any number of changes. Null and empty fields are the same, changes without an asset go, assets without changes stay.
    """
    when, given = F.struct("at", "seq"), lambda c: F.nullif(F.col(c), F.lit(""))
    update = F.col("action") == "update"
    valid = F.col("action").isin(*ACTIONS) | (update & (given("status").isNull() | F.col("status").isin(STATUSES)))
    said = changes.filter(valid).select(
        "id", when.alias("p"), F.struct("at", "by").alias("stamp"), update.alias("updates"),
        F.when(F.col("action") == "confirm", "confirmed").when(F.col("action") == "stale", "stale").otherwise(given("status")).alias("s"),
        F.when(F.col("action") == "confirm", F.col("by")).when(update, given("reviewer")).alias("r"), F.when(F.col("action") == "confirm", F.col("at")).when(update, given("confirmed_at")).alias("c"),
    )
    only = lambda condition, c: F.when(condition, F.col(c))
    fills, follows = (F.col("updates") & F.col("c").isNull() & x for x in (F.col("s") == "confirmed", F.col("s").isNull()))
    log = said.groupBy("id").agg(
        *[F.max_by(x, only(F.col(x).isNotNull(), "p")).alias(f"last_{x}") for x in "src"], F.min(only(F.col("s").isNotNull(), "p")).alias("first_s"), F.min(only(F.col("c").isNotNull(), "p")).alias("first_c"),
        *[f(x, only(condition, "p")).alias(f"{name}_{x}") for name, condition in (("fill", fills), ("follow", follows)) for f, x in ((F.min_by, "stamp"), (F.min_by, "p"))],
    )
    found = assets.join(log, "id", "left")
    # an update without a status fills the stamps of an asset that was confirmed, and without them, from the start
    follow = (F.col("status") == "confirmed") & F.col("follow_p").isNotNull() & (F.col("first_s").isNull() | (F.col("follow_p") < F.col("first_s")))
    stamp, at = F.when(follow, F.col("follow_stamp")).otherwise(F.col("fill_stamp")), F.when(follow, F.col("follow_p")).otherwise(F.col("fill_p"))
    stamp = F.when(given("confirmed_at").isNull() & (F.col("first_c").isNull() | (at < F.col("first_c"))), stamp)
    return found.select(*[{
        "status": F.coalesce("last_s", "status"), "reviewer": F.coalesce("last_r", given("reviewer"), stamp["by"]), "confirmed_at": F.coalesce("last_c", given("confirmed_at"), stamp["at"]),
    }.get(c, F.col(f"`{c}`")).alias(c) for c in assets.columns])


def list_documents(docs: DataFrame, prefix: str = "") -> DataFrame:
    """(path, name, bytes) of documents below a prefix."""
    found = docs.filter(F.startswith("path", F.lit(prefix.rstrip("/") + "/"))) if prefix else docs
    return found.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.octet_length("text").alias("bytes"))


def with_defaults(df: DataFrame, defaults: DataFrame, tenants: DataFrame, key: str) -> DataFrame:
    """Rows, and the default rows for every tenant that has none. ``defaults`` is a small fixed table."""
    lacking = tenants.join(df, key, "left_anti").select(key).withColumn("one", F.lit(1))
    return df.unionByName(lacking.join(F.broadcast(defaults.withColumn("one", F.lit(1))), "one").drop("one").select(*df.columns))


def visible_projects(users: DataFrame, grants: DataFrame, projects: DataFrame) -> DataFrame:
    """(user_id, project_id): all projects for admins, else those of active grants."""
    granted = grants.filter("status = 'active'").select("user_id", "project_id").distinct().join(users.filter("not is_admin"), "user_id", "left_semi").join(projects, "project_id", "left_semi")
    admins = users.filter("is_admin").select("user_id", F.lit(1).alias("one")).join(projects.select("project_id", F.lit(1).alias("one")), "one").select("user_id", "project_id")
    return granted.select("user_id", "project_id").unionByName(admins)


def unknown_projects(wanted: DataFrame, projects: DataFrame) -> DataFrame:
    """Rows of ``wanted`` (project_id, ...) whose project does not exist, null ones among them."""
    return wanted.join(projects.select("project_id").distinct(), "project_id", "left_anti")
