"""Hashed embeddings and exact top-k search."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from ..sources.work import kept

DIM = 384
#: Tokens whose hashes a task remembers at most.
KNOWN_TOKENS = 1_000_000


def tokens(text: Column) -> Column:
    """Lower-cased identifiers and digit runs, repeats kept."""
    return F.transform(F.regexp_extract_all(text, F.lit("([A-Za-z_][A-Za-z0-9_]*|[0-9]+)"), F.lit(1)), lambda t: F.lower(t))


def bucket_of(token: Column, dim: int = DIM) -> Column:
    """First four bytes of the token's SHA-256, modulo the dimension."""
    return (F.conv(F.substring(F.sha2(token, 256), 1, 8), 16, 10).cast("long") % dim).cast("int")


def sign_of(token: Column) -> Column:
    """1 if the fifth byte of the token's SHA-256 is even, else -1."""
    return F.when(F.conv(F.substring(F.sha2(token, 256), 9, 2), 16, 10).cast("int") % 2 == 0, 1).otherwise(-1)


_TOKEN = re.compile("[A-Za-z_][A-Za-z0-9_]*|[0-9]+")


def _weights(text: str | None, dim: int, known: dict[str, tuple[int, int]]) -> tuple[list[int], list[int]]:
    """Buckets and non-zero weights of a text; ``known`` keeps buckets and signs of tokens that a task has met."""
    own: dict[int, int] = {}
    for token, n in Counter(t.lower() for t in _TOKEN.findall(text or "")).items():
        if token not in known:
            if len(known) >= KNOWN_TOKENS:
                known.clear()
            code = hashlib.sha256(token.encode()).digest()
            known[token] = int.from_bytes(code[:4], "big") % dim, 1 - code[4] % 2 * 2
        bucket, sign = known[token]
        own[bucket] = own.get(bucket, 0) + sign * n
    kept_ones = {b: w for b, w in own.items() if w}
    return list(kept_ones), list(kept_ones.values())


def vector_rows(chunks: DataFrame, id_col: str = "id", dim: int = DIM) -> DataFrame:
    """One row for each text, where it lies: its columns with arrays ``buckets`` and ``weights``; texts without tokens have empty ones, null texts too.

    A token's bucket and sign are those of :func:`bucket_of` and :func:`sign_of`.
    """
    rest = [c for c in chunks.columns if c not in ("buckets", "weights")]
    rows = chunks.select(*[f"`{c}`" for c in rest])
    schema = StructType([*rows.schema.fields, StructField("buckets", ArrayType(IntegerType())), StructField("weights", ArrayType(LongType()))])
    at = rest.index("text")

    def run(batches):
        import pyarrow as pa

        known: dict[str, tuple[int, int]] = {}
        for batch in batches:
            found = [_weights(text, dim, known) for text in batch.column(at).to_pylist()]
            added = [pa.array([f[i] for f in found], pa.list_(kind)) for i, kind in enumerate((pa.int32(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*rest, "buckets", "weights"])

    return rows.mapInArrow(run, schema)


def hash_embed(chunks: DataFrame, id_col: str = "id", dim: int = DIM) -> DataFrame:
    """(id, bucket, weight): non-zero integer weights of each text, counted inside its row, so that nothing is shuffled."""
    rows = vector_rows(chunks.select(id_col, "text"), id_col, dim)
    return rows.select(id_col, F.explode(F.arrays_zip("buckets", "weights")).alias("v")).select(id_col, F.col("v.buckets").alias("bucket"), F.col("v.weights").alias("weight"))


def vector_norms(sparse: DataFrame, id_col: str = "id") -> DataFrame:
    """(id, norm2): squared length of each vector, an exact integer."""
    return sparse.groupBy(id_col).agg(F.sum(F.col("weight") * F.col("weight")).alias("norm2"))


def model_embed(chunks: DataFrame, load, dim: int, id_col: str = "id") -> DataFrame:
    """(id, embedding) by any model: ``load()`` is called once in each task and gives a function from texts to vectors, which are normalised."""

    def run(frames):
        import pandas as pd

        embed = load()
        for frame in frames:
            found = np.asarray(embed(frame["text"].fillna("").tolist()), float).reshape(len(frame), dim)
            size = np.linalg.norm(found, axis=1, keepdims=True)
            yield pd.DataFrame({id_col: frame[id_col], "embedding": list(found / np.where(size == 0, 1, size))})

    kind = chunks.schema[id_col].dataType.simpleString()
    return chunks.select(id_col, "text").mapInPandas(run, f"{id_col} {kind}, embedding array<double>")


def cosine(left: Column, right: Column) -> Column:
    """Dot product of two normalised dense vectors; different lengths are an error."""
    dot = F.aggregate(F.zip_with(left, right, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(left) == F.size(right), dot).otherwise(F.raise_error(F.lit("vectors differ in length")).cast("double"))


#: Scores that a task computes at a time, and the queries and rows of a block at most; rows are dealt to more blocks while these hold more than FEW_ROWS.
BLOCK_SCORES = 4_000_000
BLOCK_QUERIES, BLOCK_ROWS, FEW_ROWS = 8192, 16384, 512


def best_in_blocks(queries: DataFrame, rows: DataFrame, dense, score, k: int) -> DataFrame:
    """(query_id, id, ord, score, rank): for each query the best ``k`` rows; ties go by ord.

    Queries (query_id, ...) and rows (id, ord, ...) are dealt to blocks of bounded size; each pair of blocks is one co-group. A task turns
    its blocks into matrices by ``dense``, scores tile by tile by ``score(queries, rows)`` and keeps each query's best, and only these meet.
    """
    spark = rows.sparkSession
    queries, rows = kept(queries, "search-queries"), kept(rows, "search-rows")
    n_queries, n_rows = queries.count(), rows.count()
    q_blocks = max(1, -(-n_queries // BLOCK_QUERIES))
    r_blocks = max(1, -(-n_rows // BLOCK_ROWS), min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_rows // FEW_ROWS)))
    every, dealt = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1))), lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    left = queries.withColumns({"_q": dealt("query_id", q_blocks)}).withColumn("_r", every(r_blocks))
    right = rows.withColumns({"_r": dealt("id", r_blocks)}).withColumn("_q", every(q_blocks))
    kinds = dict(rows.dtypes) | {"query_id": dict(queries.dtypes)["query_id"]}

    def run(asked, held):
        import pyarrow as pa

        n = asked.num_rows
        best, orders, places = np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max), np.zeros((n, k), np.int64)
        asking = dense(asked)
        order = held["ord"].to_numpy().astype(np.int64)
        for at in range(0, held.num_rows if n else 0, max(1, BLOCK_SCORES // max(1, n))):
            part = held.slice(at, max(1, BLOCK_SCORES // n))
            found, own_order = score(asking, dense(part)), order[at : at + part.num_rows]
            q, row = np.nonzero((found > best[:, -1:]) | ((found == best[:, -1:]) & (own_order < orders[:, -1:])))
            own = np.unique(q)
            who = np.concatenate((q, np.repeat(own, k)))
            s, o, i = (np.concatenate((new, old[own].ravel())) for new, old in ((found[q, row], best), (own_order[row], orders), (row + at, places)))
            first = np.lexsort((o, -s, who))
            top = first[np.searchsorted(who[first], own)[:, None] + np.arange(k)]
            best[own], orders[own], places[own] = s[top], o[top], i[top]
        q, place = np.nonzero(best > -np.inf)
        return pa.table({
            "query_id": asked["query_id"].combine_chunks().take(pa.array(q)), "id": held["id"].combine_chunks().take(pa.array(places[q, place])), "ord": pa.array(orders[q, place]), "score": pa.array(best[q, place]),
        })

    found = left.groupBy("_q", "_r").cogroup(right.groupBy("_q", "_r")).applyInArrow(run, f"query_id {kinds['query_id']}, id {kinds['id']}, ord long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "ord"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def _flat(lists, kind=float) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers, values) of an Arrow list column; null lists are empty."""
    lists = lists.combine_chunks()
    size = np.array(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), np.int64)
    return np.repeat(np.arange(len(size)), size), lists.flatten().to_numpy(zero_copy_only=False).astype(kind)


def search(queries: DataFrame, vectors: DataFrame, k: int = 5, dim: int = DIM) -> DataFrame:
    """(query_id, rank, id, ord, score): exact top-k by cosine, rounded to 6 digits; texts without common buckets score 0.

    ``queries``: (query_id, text), of any number, each id once; ``vectors``: :func:`vector_rows` with an ``ord`` column, filtered beforehand.
    """

    def dense(rows):
        own = np.zeros((rows.num_rows, dim))
        at, bucket = _flat(rows["buckets"], np.int64)
        own[at, bucket] = _flat(rows["weights"])[1]
        return own

    def score(asked, held):
        both = np.sqrt((asked**2).sum(axis=1))[:, None] * np.sqrt((held**2).sum(axis=1))[None, :]
        dot = asked @ held.T
        return np.floor(np.divide(dot, both, out=np.zeros_like(dot), where=both > 0) * 1e6 + 0.5) / 1e6

    own = vectors.select("id", F.col("ord").cast("long").alias("ord"), "buckets", "weights")
    asked = vector_rows(queries.select("query_id", "text"), "query_id", dim).select("query_id", "buckets", "weights")
    return best_in_blocks(asked, own, dense, score, k).select("query_id", "rank", "id", "ord", "score")


def dense_search(queries: DataFrame, vectors: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, id, score) over dense vectors: ``queries`` (query_id, embedding), of any number, each id once, ``vectors`` (id, ord, embedding). Scores are cosines, rounded to 6 digits.

    Zero vectors score 0, null ones are left out, unequal lengths are an error, and empty tables give no rows.
    """

    def dense(rows):
        at, flat = _flat(rows["embedding"])
        if len(set(np.bincount(at, minlength=rows.num_rows).tolist())) > 1:
            raise ValueError("vectors differ in length")
        own = flat.reshape(rows.num_rows, len(flat) // max(1, rows.num_rows))
        size = np.linalg.norm(own, axis=1, keepdims=True)
        return own / np.where(size == 0, 1, size)

    def score(asked, held):
        if asked.shape[1] != held.shape[1]:
            raise ValueError("vectors differ in length")
        return np.round(asked @ held.T, 6) + 0.0

    own = vectors.select("id", F.col("ord").cast("long").alias("ord"), "embedding").filter("embedding is not null")
    asked = queries.select("query_id", "embedding").filter("embedding is not null")
    return best_in_blocks(asked, own, dense, score, k).select("query_id", "rank", "id", "score")


def index_status(vectors: DataFrame) -> DataFrame:
    """(facet, value, n): total and counts by source_type and kind in one pass."""
    named = vectors.select(F.coalesce(F.nullif("source_type", F.lit("")), F.lit("unknown")).alias("source_type"), F.coalesce(F.nullif("kind", F.lit("")), F.lit("unknown")).alias("kind"))
    grouped = named.groupingSets([["source_type"], ["kind"], []], "source_type", "kind").agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    return grouped.select(F.when(F.col("g") == 1, "source_type").when(F.col("g") == 2, "kind").otherwise("total").alias("facet"), F.coalesce("source_type", "kind", F.lit("")).alias("value"), "n")


def facet_share(df: DataFrame, column: str, n: int = 8) -> DataFrame:
    """(value, n, share): the most frequent values with their rounded percentage, 4 at least."""
    counts = df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    total = df.agg(F.count("*").alias("total"))
    return counts.join(F.broadcast(total)).select("value", "n", F.greatest(F.lit(4.0), F.floor(100.0 * F.col("n") / F.col("total") + 0.5).cast("double")).alias("share")).orderBy(F.desc("n"), "value").limit(n)


def browse(vectors: DataFrame, query: str = "", source_type: str | None = None, kind: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of records that contain ``query`` in id, text or path, whatever the case; limit is clamped to 1..200."""
    found = vectors
    for name, value in (("source_type", source_type), ("kind", kind)):
        if value is not None:
            found = found.filter(F.col(name) == value)
    if query:
        found = found.filter(F.contains(F.lower(F.concat_ws("\n", "id", "text", "file_path")), F.lit(query.lower())))
    return found.orderBy("ord").offset(max(0, offset)).limit(min(200, max(1, limit)))


def matched_terms(query: Column, text: Column) -> Column:
    """Sorted tokens that both texts have."""
    return F.array_sort(F.array_intersect(tokens(query), tokens(text)))
