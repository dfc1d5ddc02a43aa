"""State tables: live rows, keyed upserts, deletes, snapshots and deterministic ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def read_live(table: DataFrame) -> DataFrame:
    """Active rows."""
    return table.filter("status = 'active'")


def write_replace(df: DataFrame, path: str, by: list[str]) -> None:
    """Replace the partitions that ``df`` has; others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def latest(changes: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last change of each key."""
    r = F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order]))
    return changes.withColumn("_r", r).filter("_r = 1").drop("_r")


def upsert(target: DataFrame, source: DataFrame, keys: list[str], update: list[str]) -> DataFrame:
    """Target with the source's columns put in by key: ``update`` columns are overwritten, the others keep what they have; new keys come in."""
    t, s = target.select(*[F.col(c).alias(f"t_{c}") for c in target.columns]), source.select(*[F.col(c).alias(f"s_{c}") for c in target.columns], F.lit(True).alias("s_in"))
    on = [F.col(f"t_{k}") == F.col(f"s_{k}") for k in keys]
    joined = t.join(s, on, "full_outer")
    pick = lambda c: F.when(F.col("s_in"), F.col(f"s_{c}")).otherwise(F.col(f"t_{c}")) if c in update else F.coalesce(f"t_{c}", f"s_{c}")
    return joined.select(*[pick(c).alias(c) for c in target.columns])


def soft_delete(table: DataFrame, condition: Column, now: Column) -> DataFrame:
    """Active rows that meet the condition become deleted, with a stamp."""
    hit = condition & (F.col("status") == "active")
    return table.withColumns({"deleted_at": F.when(hit, now).otherwise(F.col("deleted_at")), "status": F.when(hit, "deleted").otherwise(F.col("status"))})


def delete_where(table: DataFrame, condition: Column) -> DataFrame:
    """Rows that do not meet the condition."""
    return table.filter(~F.coalesce(condition, F.lit(False)))


def prune_missing(stored: DataFrame, current: DataFrame, key: str) -> DataFrame:
    """Stored rows whose key is still current."""
    return stored.join(current, key, "left_semi")


def sync_grants(grants: DataFrame, wanted: DataFrame) -> DataFrame:
    """(user_id, project_id, status): a user's grants become the wanted list; users without a list keep theirs."""
    w = wanted.select("user_id", "project_id", F.lit(True).alias("w")).distinct()
    listed = wanted.select("user_id").distinct().withColumn("l", F.lit(True))
    both = grants.join(w, ["user_id", "project_id"], "full_outer").join(listed, "user_id", "left")
    return both.select("user_id", "project_id", F.when(F.col("w"), "active").when(F.col("l"), "deleted").otherwise(F.col("status")).alias("status"))


def _merged(old: DataFrame, new: DataFrame, keys: list[str], order: Column | None = None) -> DataFrame:
    """Rows by key with a map ``props``: old properties stay, new ones come in or replace them; of several new rows the last by order counts for each property."""
    every = old.select(*keys, "props", F.lit(0).alias("_age"), F.lit(0).alias("_at")).unionByName(new.select(*keys, "props", F.lit(1).alias("_age"), (F.lit(0) if order is None else order).alias("_at")))
    one = every.select(*keys, "_age", "_at", F.explode_outer("props").alias("_name", "_value"))
    last = one.groupBy(*keys, "_name").agg(F.max_by("_value", F.struct("_age", "_at", F.coalesce("_value", F.lit("")))).alias("_value"))
    return last.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("_name").isNotNull(), F.struct("_name", "_value"))))).alias("props"))


def merge_nodes(nodes: DataFrame, new: DataFrame, order: Column | None = None) -> DataFrame:
    """(id, label, props): nodes after a merge by label and id; rows without an id are left out."""
    return _merged(nodes, new.filter("id is not null and id <> ''"), ["id", "label"], order)


def merge_edges(edges: DataFrame, new: DataFrame, nodes: DataFrame, order: Column | None = None) -> DataFrame:
    """(src, type, dst, props): edges after a merge by ends and type; new edges need both of their ends among the nodes (id)."""
    ids = nodes.select("id").distinct()
    known = new.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return _merged(edges, known.select(*new.columns), ["src", "type", "dst"], order)


def uuid5(namespace_hex: str, name: Column) -> Column:
    """Version 5 UUID of a name, from SHA-1."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace_hex)), F.encode(name, "UTF-8")))
    variant = F.element_at(F.array(*[F.lit(x) for x in "89ab"]), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1).cast("int"))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def save_snapshot(outputs: DataFrame, new: DataFrame) -> DataFrame:
    """(project, mode, text): one text for each project and mode, the new one if there is one, with one line feed at its end."""
    own = new.withColumn("text", F.concat(F.regexp_replace("text", "\n+$", ""), F.lit("\n")))
    return own.unionByName(outputs.join(own, ["project", "mode"], "left_anti"))


def load_snapshot(outputs: DataFrame, requests: DataFrame) -> DataFrame:
    """(project, mode, found, text) for each request."""
    return requests.join(outputs.withColumn("found", F.lit(True)), ["project", "mode"], "left").withColumn("found", F.coalesce("found", F.lit(False)))


def to_json_lines(df: DataFrame) -> DataFrame:
    """One JSON text for each row."""
    return df.select(F.to_json(F.struct("*")).alias("value"))
