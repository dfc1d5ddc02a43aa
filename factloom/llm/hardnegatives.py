"""Hard-negative mining with segment summaries.

Each vector is cut into segments; for each segment its mean and deviation (root mean squared distance from the mean) are stored. Over a segment of length
L, the inner product of two vectors is L * mean * mean plus a rest of at most L * deviation * deviation. So the sums over
all segments, plus or minus, bound the score from both sides. The segments form a hierarchy (one, then 4, then 16); a pair
that a coarse level cannot exclude goes on to the next finer one, and only what is left is scored exactly, in integers.

A search asks, for each anchor and each of its score windows, for the best ``k`` rows. Anchors (a stated set of rows) and rows are dealt
to blocks of bounded size, and each pair of blocks is one group of a co-grouped job: a task holds one block of each side, scores
them in small tiles and keeps the best k of each window, whose last score excludes more and more pairs by their bounds. Per anchor only those are
shuffled once more. First the positives are sought (one window without ends, same label), then the negatives, with a window for each positive.

Cases: rows with a null label, a null vector, or any null or non-finite component take no part; a shorter vector counts as
filled up with zeros, an empty one scores 0 with all; rows with a null id are no anchors and come last among ties; repeated ids are rows
of their own, and equal scores of equal ids come in an arbitrary but fixed order; scores beyond 64 bits become the nearest 64-bit
number; an anchor without another row of its label has no positive; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, keep, scratch, table

SEGMENTS = (1, 4, 16)
N_POSITIVES = N_NEGATIVES = 5
SCALE = 256
#: Rows and anchors of a block, and of a tile inside a task.
BLOCK_ROWS, BLOCK_ANCHORS, TILE_ROWS, TILE_ANCHORS = 8192, 8192, 2048, 128
#: Bounds are widened by this share of the two norms' product; summaries are rounded to 32 bits.
SLACK = 1e-5
_LONG = (-(2**63), 2**63 - 1)


def summaries(vectors: np.ndarray) -> np.ndarray:
    """For each vector the means of all segments of all levels, times the root of the segment's length, then the deviations likewise."""
    found = [[], []]
    width = vectors.shape[1]
    for count in SEGMENTS:
        for part in np.array_split(np.arange(width), count):
            inside = vectors[:, part]
            found[0].append(inside.mean(1) * np.sqrt(len(part)) if len(part) else np.zeros(len(vectors)))
            found[1].append(inside.std(1) * np.sqrt(len(part)) if len(part) else np.zeros(len(vectors)))
    return np.stack([*found[0], *found[1]], axis=1).astype(np.float32)


def prepared(rows: DataFrame, scale: int = SCALE) -> DataFrame:
    """The rows that take part, written: (rid, vec_id, label, vector of integers as doubles, summary)."""
    usable = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = rows.filter(F.col("label").isNotNull() & F.col("embedding").isNotNull()).filter(usable)
    # floor() gives a long; components beyond it are whole numbers already
    exact = F.transform("embedding", lambda x: F.when(F.abs(x.cast("double")) < 2.0**50, F.floor(scale * x.cast("double")).cast("double")).otherwise(scale * x.cast("double")))
    found = cut(whole.select(F.monotonically_increasing_id().alias("rid"), "vec_id", "label", exact.alias("vector")), "negatives-rows")
    width = found.agg(F.coalesce(F.max(F.size("vector")), F.lit(0))).first()[0]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            summary = summaries(_matrix(batch["vector"], max(1, width)))
            yield batch.append_column("summary", pa.array(list(summary), pa.list_(pa.float32())))

    kinds = dict(found.dtypes)
    out = found.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in found.columns) + ", summary array<float>")
    return cut(out, "negatives-summaries")


def _matrix(column, width: int, kind=np.float64) -> np.ndarray:
    """An Arrow column of lists as a matrix, short lists filled up with zeros."""
    import pyarrow as pa

    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.asarray(column.value_lengths().fill_null(0))
    out = np.zeros((len(column), width), kind)
    out[np.arange(width) < lengths[:, None]] = np.asarray(column.flatten(), kind)
    return out


def _exact(a: np.ndarray, b: np.ndarray, ia: np.ndarray, ib: np.ndarray) -> np.ndarray:
    """Inner products of row pairs as 64-bit integers; in doubles where these are exact."""
    top = max(1, a.shape[1]) * np.abs(a).max(initial=0) * np.abs(b).max(initial=0)
    if top < 2.0**53:
        return np.einsum("ij,ij->i", a[ia], b[ib]).astype(np.int64)
    big = lambda m: np.array([[int(x) for x in r] for r in m], object)
    return np.array([min(max(int((x * y).sum()), _LONG[0]), _LONG[1]) for x, y in zip(big(a[ia]), big(b[ib]))], np.int64)


def _best(score: np.ndarray, key: np.ndarray, tie: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of each key, by score, then by ``tie``; ordered by key and rank."""
    order = np.lexsort((tie, ~score, key))
    sorted_key = key[order]
    first = np.searchsorted(sorted_key, sorted_key)
    return order[np.arange(len(order)) - first < k]


def _block(anchors: dict, rows: dict, same: bool, k: int) -> list[tuple]:
    """The best k rows of a block for each anchor and window.

    anchors, rows: vector, summary, label, rid and, for rows, ``order`` (place by id); anchors: low and high, the windows' ends (anchor x window, low > high: none).
    Gives (anchor, window, row, score) as arrays of places.
    """
    n_windows = anchors["low"].shape[1]
    ends = np.cumsum(SEGMENTS)
    spans = [slice(e - s, e) for e, s in zip(ends, SEGMENTS)]
    out = []
    for a0 in range(0, len(anchors["rid"]), TILE_ANCHORS):
        a = {c: v[a0 : a0 + TILE_ANCHORS] for c, v in anchors.items()}
        # a score at an end of 64 bits stands for all beyond it
        low, high = (np.where(a[end] == side, np.copysign(np.inf, side), a[end]) for end, side in zip(("low", "high"), _LONG))
        high = high.max(1)
        mean_a, dev_a = np.split(a["summary"].astype(np.float64), 2, axis=1)
        norm_a = np.sqrt((a["vector"] ** 2).sum(1))
        best = tuple(np.zeros(0, np.int64) for _ in range(3))  # anchor x window, row, score
        for r0 in range(0, len(rows["rid"]), TILE_ROWS):
            r = {c: v[r0 : r0 + TILE_ROWS] for c, v in rows.items()}
            mean_r, dev_r = np.split(r["summary"].astype(np.float64), 2, axis=1)
            slack = SLACK * np.sqrt((r["vector"] ** 2).sum(1))
            needed = low.min(1)
            wanted = (a["label"][:, None] == r["label"]) == same
            wanted &= a["rid"][:, None] != r["rid"]
            middle, rest = mean_a[:, spans[0]] @ mean_r[:, spans[0]].T, dev_a[:, spans[0]] @ dev_r[:, spans[0]].T
            rest += norm_a[:, None] * slack + 1e-3
            ia, ib = np.nonzero(wanted & ~(middle + rest < needed[:, None]) & ~(middle - rest > high[:, None]))  # a bound that is no number excludes nothing
            for span in spans[1:]:
                middle = np.einsum("ij,ij->i", mean_a[ia, span], mean_r[ib, span])
                rest = np.einsum("ij,ij->i", dev_a[ia, span], dev_r[ib, span]) + norm_a[ia] * slack[ib] + 1e-3
                left = ~(middle + rest < needed[ia]) & ~(middle - rest > high[ia])
                ia, ib = ia[left], ib[left]
            score = _exact(a["vector"], r["vector"], ia, ib)
            found = [best]
            for w in range(n_windows):
                left = (score >= a["low"][ia, w]) & (score <= a["high"][ia, w])
                found.append((ia[left] * n_windows + w, ib[left] + r0, score[left]))
            key, row, score = (np.concatenate(x) for x in zip(*found))
            top = _best(score, key, rows["order"][row], k)
            best = key[top], row[top], score[top]
            # a window that has k rows needs no score below its last one
            count = np.bincount(best[0], minlength=low.size)
            last = np.cumsum(count)[count == k] - 1
            full = np.flatnonzero(count == k)
            low.reshape(-1)[full] = np.maximum(low.reshape(-1)[full], best[2][last])
        out.append((best[0] // n_windows + a0, best[0] % n_windows, best[1], best[2]))
    return out


def search(anchors: DataFrame, rows: DataFrame, same: bool, k: int) -> DataFrame:
    """(rid, window, rank, score, row_rid, row_id): for each anchor and window the best k rows with the same label, or with another.

    anchors: (rid, label, vector, summary, windows: array of (low, high)); rows: as :func:`prepared` gives them.
    """
    n_rows, n_anchors = rows.count(), anchors.count()
    r_blocks, a_blocks = max(1, -(-n_rows // BLOCK_ROWS)), max(1, -(-n_anchors // BLOCK_ANCHORS))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda n: F.pmod(F.xxhash64("rid"), F.lit(n)).cast("int")
    left = anchors.select("rid", "label", "vector", "summary", "windows", dealt(a_blocks).alias("a"), every(r_blocks).alias("r"))
    right = rows.select("rid", "vec_id", "label", "vector", "summary", dealt(r_blocks).alias("r"), every(a_blocks).alias("a"))
    id_kind = dict(rows.dtypes)["vec_id"]

    def run(own, others):
        import pyarrow as pa
        import pyarrow.compute as pc

        if own.num_rows == 0 or others.num_rows == 0:
            return pa.table({"rid": pa.array([], pa.int64()), "window": pa.array([], pa.int32()), "score": pa.array([], pa.int64()), "row_rid": pa.array([], pa.int64()), "row_id": others["vec_id"].slice(0, 0)})
        width = max(1, *(int(pc.max(pc.list_value_length(t["vector"])).as_py() or 0) for t in (own, others)))
        places = np.empty(others.num_rows, np.int64)
        places[np.asarray(pc.sort_indices(others, sort_keys=[("vec_id", "ascending"), ("rid", "ascending")], null_placement="at_end"))] = np.arange(others.num_rows)
        sides = []
        for t in (own, others):
            sides.append({"vector": _matrix(t["vector"], width), "summary": _matrix(t["summary"], 2 * sum(SEGMENTS), np.float32), "label": np.asarray(t["label"]), "rid": np.asarray(t["rid"])})
        sides[1]["order"] = places
        windows = own["windows"].to_pylist()
        most = max(1, max(map(len, windows)))
        for end, none in (("low", _LONG[1]), ("high", _LONG[0])):
            sides[0][end] = np.array([[w[end] for w in ws] + [none] * (most - len(ws)) for ws in windows], np.int64)
        found = [np.concatenate(x) for x in zip(*_block(sides[0], sides[1], same, k))]
        return pa.table({
            "rid": pa.array(sides[0]["rid"][found[0]], pa.int64()), "window": pa.array(found[1], pa.int32()), "score": pa.array(found[3], pa.int64()),
            "row_rid": pa.array(sides[1]["rid"][found[2]], pa.int64()), "row_id": others["vec_id"].combine_chunks().take(pa.array(found[2])),
        })

    pairs = left.groupBy("a", "r").cogroup(right.groupBy("a", "r")).applyInArrow(run, f"rid long, window int, score long, row_rid long, row_id {id_kind}")
    rank = F.row_number().over(Window.partitionBy("rid", "window").orderBy(F.desc("score"), F.asc_nulls_last("row_id"), "row_rid"))
    return pairs.withColumn("rank", rank).filter(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, anchor: Column, n_positives: int = N_POSITIVES, n_negatives: int = N_NEGATIVES, low_percent: int = 80, high_percent: int = 100) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of the rows (vec_id, embedding, label) that ``anchor`` selects.

    A negative's score is between the two percentages of the positive's. The result is written.
    """
    with scratch():
        ready = prepared(rows)
        own = cut(ready.filter(anchor), "negatives-anchors")
        whole = F.array(F.struct(F.lit(_LONG[0]).alias("low"), F.lit(_LONG[1]).alias("high")))
        near = cut(search(own.withColumn("windows", whole), ready, True, n_positives).select("rid", "rank", "row_id", "score"), "negatives-positives")
        # integers: low_percent * p <= 100 * n <= high_percent * p
        p = F.col("score").cast("decimal(20,0)")
        at = lambda percent, rounded: F.greatest(F.lit(_LONG[0]), F.least(F.lit(_LONG[1]), rounded(p * percent / 100)))
        window = F.struct((F.col("rank") - 1).alias("place"), at(low_percent, F.ceil).cast("long").alias("low"), at(high_percent, F.floor).cast("long").alias("high"))
        windows = near.groupBy("rid").agg(F.array_sort(F.collect_list(window)).alias("windows"))  # n_positives at most
        far = search(own.join(windows, "rid"), ready, False, n_negatives)
        named = near.select("rid", (F.col("rank") - 1).alias("window"), F.col("row_id").alias("positive_id"), F.col("score").alias("positive_score"))
        found = far.join(named, ["rid", "window"]).join(own.select("rid", F.col("vec_id").alias("anchor_id")), "rid")
        return keep(found.select("anchor_id", "positive_id", "rank", F.col("row_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")), "negatives")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every row whose vec_id is divisible by 100, against all rows."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", moved.alias("label"))
    return hard_negatives(rows, F.col("vec_id") % 100 == 0)


OP13_SQL = """
WITH e AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
s AS (SELECT a.r AS a, a.vec_id AS anchor_id, e.r, e.vec_id, e.label = a.label AS same, list_inner_product(a.v, e.v)::BIGINT AS score FROM e a JOIN e ON a.r <> e.r WHERE a.vec_id % 100 = 0),
p AS (SELECT a, r AS pos, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id, r) <= 5)
SELECT anchor_id, positive_id, rank::INT AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM (SELECT *, row_number() OVER (PARTITION BY a, pos ORDER BY score DESC, vec_id, r) AS rank FROM p JOIN s USING (a) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score)
WHERE rank <= 5"""
