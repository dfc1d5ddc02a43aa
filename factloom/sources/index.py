"""A vector index laid out by tenant: each build of a tenant is a set of folders of its own, and one small manifest names those that count.

A manifest is a table of tenants and their parts, written whole into a folder with the next number; the highest number that was written
completely is the index's state. Readers take the parts of one manifest, so they see a tenant before or after a rebuild, never half of it; what an interrupted build has
written is in no manifest. Parts are written before the manifest that names them and stay until :func:`vacuum`. A part is named by its build and tenant, and a
build that is repeated (a replayed batch, a retried job) writes the same parts and changes nothing. One writer at a time.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .state import latest

#: Files that a build of a large tenant is dealt to.
SPREAD = 16
MANIFEST = "number long, build string, tenant string, part string, added long"


def _files(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def _children(spark: SparkSession, path: str) -> list[str]:
    files, where = _files(spark, path)
    return [f.getPath().getName() for f in files.listStatus(where)] if files.exists(where) else []


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the complete manifests, ascending."""
    files, _ = _files(spark, path)
    done = (n for n in _children(spark, f"{path}/manifests") if files.exists(_files(spark, f"{path}/manifests/{n}/_SUCCESS")[1]))
    return sorted(int(n.split("=")[1]) for n in done)


def manifest(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """(number, build, tenant, part, added) of a version, the last one by default; number is the build's place."""
    known = versions(spark, path)
    if not known:
        return spark.createDataFrame([], MANIFEST)
    return spark.read.schema(MANIFEST).parquet(f"{path}/manifests/version={known[-1] if version is None else version}")


def build(vectors: DataFrame, path: str, tenant: str, name: str, append: bool = False, tenants: DataFrame | None = None) -> int:
    """Write the rows into the index under the build's name; the new version comes back.

    A rebuild replaces all parts of the tenants that have rows, and of those in ``tenants`` (tenant), rows or not; ``append`` adds parts, of which
    :func:`read` takes the latest row for each key. A name that the present version holds is not built again. Rows without a tenant are left out.
    """
    spark = vectors.sparkSession
    known, old = versions(spark, path), manifest(spark, path)
    if not old.filter(F.col("build") == name).isEmpty():
        return known[-1]
    number, part = (known[-1] if known else 0) + 1, "b" + hashlib.sha256(name.encode()).hexdigest()[:16]
    rows = vectors.filter(F.coalesce(F.col(tenant).cast("string"), F.lit("")) != "").withColumn("_tenant", F.col(tenant).cast("string"))
    rows.repartition("_tenant", F.pmod(F.xxhash64(vectors.columns[0]), F.lit(SPREAD))).write.mode("overwrite").partitionBy("_tenant").parquet(f"{path}/parts/build={part}")
    new = spark.createDataFrame([], MANIFEST)
    if any(c.startswith("_tenant=") for c in _children(spark, f"{path}/parts/build={part}")):
        counts = _parts(spark, path).filter(F.col("build") == part).groupBy(F.col("_tenant").alias("tenant")).agg(F.count("*").alias("added"))
        new = counts.select(F.lit(number).cast("long").alias("number"), F.lit(name).alias("build"), "tenant", F.lit(part).alias("part"), "added")
    gone = new.select("tenant") if tenants is None else new.select("tenant").union(tenants.select(F.col("tenant").cast("string")))
    stays = old if append else old.join(gone.distinct(), "tenant", "left_anti").select(*old.columns)
    stays.unionByName(new).write.mode("overwrite").parquet(f"{path}/manifests/version={number}")
    return number


def _parts(spark: SparkSession, path: str) -> DataFrame:
    """All parts' rows with ``build`` and ``_tenant``, which are texts whatever they look like."""
    own = spark.read.parquet(f"{path}/parts").schema
    names = ("build", "_tenant")
    return spark.read.schema(StructType([*(f for f in own.fields if f.name not in names), *(StructField(n, StringType()) for n in names)])).parquet(f"{path}/parts")


def read(spark: SparkSession, path: str, tenants: list[str] | None = None, key: str = "id", version: int | None = None) -> DataFrame:
    """The index's rows with ``tenant``: the latest build's row for each key of a tenant. An index without a build is an error.

    Parts are folders by build and tenant: tenants that are asked for prune the scan when it is planned, builds that count when it runs.
    """
    parts, counts = _parts(spark, path), manifest(spark, path, version).select(F.col("part").alias("build"), F.col("tenant").alias("_tenant"), F.col("number").alias("_number"))
    if tenants is not None:
        parts, counts = (df.filter(F.col("_tenant").isin(tenants)) for df in (parts, counts))
    rows = parts.join(counts, ["build", "_tenant"])
    rest = [F.col(f"`{c}`") for c in parts.columns if c not in ("build", "_tenant", "tenant")]
    return latest(rows.select(*rest, F.col("_tenant").alias("tenant"), "_number"), ["tenant", key], ["_number"]).drop("_number")


def page(rows: DataFrame, key: str, after=None, limit: int = 1000, source_type: str | None = None) -> DataFrame:
    """The first ``limit`` rows (1 to 1000) whose key follows ``after``, in the key's order: the next page starts after this one's last key, however far
    in it is, and rows that come in meanwhile move nothing."""
    found = rows if source_type is None else rows.filter(F.col("source_type") == source_type)
    found = found if after is None else found.filter(F.col(key) > F.lit(after))
    return found.orderBy(key).limit(min(1000, max(1, limit)))


def vacuum(spark: SparkSession, path: str) -> int:
    """Remove manifests before the last one and builds that it does not name; how many folders went comes back. No reader may use an older version."""
    known = versions(spark, path)
    counts = {r["part"] for r in manifest(spark, path).select("part").distinct().toLocalIterator()}
    names = {int(n.split("=")[1]): n for n in _children(spark, f"{path}/manifests") if n.startswith("version=")}
    stale = [f"{path}/manifests/{n}" for v, n in names.items() if not known or v != known[-1]] + [f"{path}/parts/{n}" for n in _children(spark, f"{path}/parts") if n.startswith("build=") and n.split("=")[1] not in counts]
    for folder in stale:
        files, where = _files(spark, folder)
        files.delete(where, True)
    return len(stale)
