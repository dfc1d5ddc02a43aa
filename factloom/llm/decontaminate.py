"""Benchmark decontamination by winnowing.

Texts are lower-cased (A-Z) and cut into runs of digits, a-z and characters beyond ASCII. Of the hashes of all k-grams, the
smallest of each ``window`` neighbours are kept as fingerprints, on both sides alike. Any span of ``k + window - 1`` shared words
therefore has a fingerprint in common; with k = window = 7 that is 13 words, the length of the item windows. Hits are then
extended: the 13-word windows around a hit are compared with the items' windows word by word, so hash collisions do no harm.
An item of fewer than 13 words is one window of its own length, fingerprinted with k = length and windows of one hash.

Cases: a null or wordless text has no words, hits or items; items without words or without item_id are ignored; repeated rows
are judged one by one; a column named ``contamination`` is replaced, others stay; empty tables give empty results or no hits.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import add_struct, table

K = WINDOW = 7
SPAN = 13
#: Item windows that are broadcast at most (about 150 bytes each); beyond that, fingerprints are joined by shuffle.
BROADCAST_WINDOWS = 500_000
FIELDS = "n_words long, n_hit long, n_items long, item_ids array<string>"

_SEPARATORS = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256))
_TABLE = _SEPARATORS.lower()


def words_of(raw: bytes | None) -> list[bytes]:
    """Lower-cased words of a text in UTF-8."""
    return raw.translate(_TABLE).split() if raw else []


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def gram_hashes(words: list[bytes], k: int) -> np.ndarray:
    """64-bit hashes of all runs of ``k`` words."""
    n = len(words) - k + 1
    if n < 1:
        return np.empty(0, np.uint64)
    own = _mixed(np.fromiter(map(zlib.crc32, words), np.uint64, len(words)))
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = _mixed(out + own[j : j + n])
    return out


def winnow(hashes: np.ndarray, window: int) -> np.ndarray:
    """Positions of the (rightmost) smallest hash of every ``window`` neighbours; of all of them where they are fewer."""
    if not len(hashes):
        return np.empty(0, np.int64)
    window = min(window, len(hashes))
    views = np.lib.stride_tricks.sliding_window_view(hashes[::-1], window)
    return np.unique(len(hashes) - 1 - (views.argmin(axis=1) + np.arange(len(views))))


def item_windows(item_id, raw: bytes | None):
    """(length, words joined by blanks, item_id as text) of each window of an item."""
    words = words_of(raw)
    n = min(SPAN, len(words))
    return [(n, b" ".join(words[i : i + n]), str(item_id)) for i in range(len(words) - n + 1)] if n and item_id is not None else []


def _scheme(length: int) -> tuple[int, int]:
    return (K, WINDOW) if length == SPAN else (length, 1)


def _prints(words: list[bytes], length: int):
    """Fingerprints of a text for item windows of one length: their hashes and positions."""
    k, window = _scheme(length)
    if len(words) < length:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    hashes = gram_hashes(words, k)
    at = winnow(hashes, window)
    return hashes[at], at


def _starts(at: np.ndarray, length: int, n: int) -> np.ndarray:
    """Where windows that hold a fingerprint's k-gram may start."""
    around = (at[:, None] - np.arange(length - _scheme(length)[0] + 1)).ravel()
    return np.unique(around[(around >= 0) & (around <= n - length)])


def _verdicts(index: dict[int, tuple[np.ndarray, dict[bytes, tuple[str, ...]]]]):
    """The function that judges texts against broadcast item windows."""

    def judge(raw: bytes | None) -> tuple:
        words = words_of(raw)
        hit, items = np.zeros(len(words) + 1, np.int32), set()
        for length, (prints, windows) in index.items():
            own, at = _prints(words, length)
            if not len(own):
                continue
            near = np.minimum(np.searchsorted(prints, own), len(prints) - 1)
            for start in _starts(at[prints[near] == own], length, len(words)).tolist():
                if found := windows.get(b" ".join(words[start : start + length])):
                    items.update(found)
                    hit[start] += 1
                    hit[start + length] -= 1
        return len(words), int((np.cumsum(hit) > 0).sum()), len(items), sorted(items)

    return judge


def _windows_table(benchmark: DataFrame) -> DataFrame:
    """(length, window, item_id): distinct windows of all items."""

    def cut_items(batches):
        import pyarrow as pa

        for b in batches:
            rows = [w for i, t in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist()) for w in item_windows(i, t)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1].decode() for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string())], names=["length", "window", "item_id"])

    return benchmark.select("item_id", "text").mapInArrow(cut_items, "length int, window string, item_id string").distinct()


def contamination(docs: DataFrame, benchmark: DataFrame, broadcast_windows: int = BROADCAST_WINDOWS, keep: list[str] | None = None) -> DataFrame:
    """``docs`` with a struct ``contamination`` (n_words, n_hit, n_items, item_ids as text, sorted).

    The items' windows are counted first. Up to ``broadcast_windows`` of them are sent to every worker, and documents are
    judged where they lie. Beyond that, fingerprints and windows meet in joins. Both ways give the same rows.
    """
    windows = _windows_table(benchmark)
    rows = windows.limit(broadcast_windows + 1).collect()
    if len(rows) > broadcast_windows:
        return _joined(docs, windows, keep)
    grouped: dict[int, dict[bytes, list[str]]] = {}
    for length, window, item in rows:
        grouped.setdefault(length, {}).setdefault(window.encode(), []).append(item)
    index = {}
    for length, found in grouped.items():
        hashes = [gram_hashes(w.split(b" "), _scheme(length)[0]) for w in found]
        index[length] = np.unique(np.concatenate([h[winnow(h, _scheme(length)[1])] for h in hashes])), {w: tuple(i) for w, i in found.items()}
    sent = docs.sparkSession.sparkContext.broadcast(index)

    def compute(texts):
        judge = _verdicts(sent.value)
        return map(judge, texts)

    return add_struct(docs, "contamination", FIELDS, compute, keep=keep)


def _joined(docs: DataFrame, windows: DataFrame, keep: list[str] | None) -> DataFrame:
    """The way for benchmarks of any size: fingerprint join, then a join on the windows around hits."""
    lengths = sorted(r[0] for r in windows.select("length").distinct().collect())  # 13 values at most

    def text_prints(batches):
        import pyarrow as pa

        for b in batches:
            out = []
            for key, raw in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist()):
                words = words_of(raw)
                out += [(key, n, int(h), int(p)) for n in lengths for h, p in zip(*(x.tolist() for x in _signed(_prints(words, n))))]
            yield _batch(out, ["key", "length", "print", "at"], [pa.string(), pa.int32(), pa.int64(), pa.int64()])

    def window_prints(batches):
        import pyarrow as pa

        for b in batches:
            out = set()
            for n, w in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                out.update((n, int(h)) for h in _signed(_prints(w.encode().split(b" "), n))[0].tolist())
            yield _batch(list(out), ["length", "print"], [pa.int32(), pa.int64()])

    def around(batches):
        import pyarrow as pa

        for b in batches:
            out = []
            for key, raw, hits in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), b.column(2).to_pylist()):
                words = words_of(raw)
                for n in {h["length"] for h in hits}:
                    at = np.array([h["at"] for h in hits if h["length"] == n])
                    out += [(key, n, s, b" ".join(words[s : s + n]).decode()) for s in _starts(at, n, len(words)).tolist()]
            yield _batch(out, ["key", "length", "start", "window"], [pa.string(), pa.int32(), pa.int64(), pa.string()])

    key = F.sha2(F.col("text"), 256)  # equal texts have equal verdicts
    texts = docs.filter(F.col("text").isNotNull()).select(key.alias("key"), "text").dropDuplicates(["key"])
    own = windows.select("length", "window").distinct().mapInArrow(window_prints, "length int, print long").distinct()
    hits = texts.mapInArrow(text_prints, "key string, length int, print long, at long").join(own, ["length", "print"], "left_semi")
    places = hits.groupBy("key").agg(F.collect_list(F.struct("length", "at")).alias("hits"))
    found = texts.join(places, "key").select("key", "text", "hits").mapInArrow(around, "key string, length int, start long, window string").join(windows, ["length", "window"])
    covered = found.select("key", F.explode(F.sequence("start", F.col("start") + F.col("length") - 1)).alias("w")).groupBy("key").agg(F.count_distinct("w").alias("n_hit"))
    items = found.groupBy("key").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"))
    verdicts = covered.join(items, "key").select(F.col("key").alias("_key"), "n_hit", "item_ids")
    counted = add_struct(docs, "contamination", "n_words long", lambda texts: ((len(words_of(t)),) for t in texts))
    wanted = [c for c in (keep if keep is not None else docs.columns) if c != "contamination"]
    return counted.join(verdicts, key == F.col("_key"), "left").select(
        *[f"`{c}`" for c in wanted],
        F.struct(
            F.col("contamination.n_words").alias("n_words"), F.coalesce("n_hit", F.lit(0)).alias("n_hit"),
            F.when(F.col("item_ids").isNull(), 0).otherwise(F.size("item_ids")).cast("long").alias("n_items"),
            F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
        ).alias("contamination"),
    )


def _signed(prints):
    return prints[0].view(np.int64), prints[1]


def _batch(rows, names, kinds):
    import pyarrow as pa

    columns = list(zip(*rows)) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


def is_contaminated():
    """The contamination rule: a hit, and at least a twentieth of the words."""
    hit, words = F.col("contamination.n_hit"), F.col("contamination.n_words")
    return (hit > 0) & (20 * hit >= words)


def remove_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that the rule leaves, with their own columns."""
    own = docs.withColumnRenamed("contamination", "_own_contamination")  # the struct of verdicts takes that name for a while
    return contamination(own, benchmark).filter(~is_contaminated()).select(*[F.col(f"`{o}`").alias(c) for o, c in zip(own.columns, docs.columns)])


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against every benchmark item."""
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return found.select(
        "doc_id", "contamination.n_words", "contamination.n_hit", "contamination.n_items",
        F.sha2(F.array_join("contamination.item_ids", ","), 256).alias("items_sha256"), is_contaminated().alias("contaminated"),
    )


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), iw AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i+n-1], ' ') AS t FROM (
    SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM (SELECT *, least(13, len(w)) AS n FROM b WHERE len(w) > 0))
), lengths AS (SELECT DISTINCT n FROM iw),
dw AS (
  SELECT doc_id, i, n, array_to_string(w[i:i+n-1], ' ') AS t FROM (
    SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lengths WHERE len(w) >= n)
), hits AS (SELECT doc_id, i, iw.n, item_id FROM dw JOIN iw ON dw.t = iw.t AND dw.n = iw.n),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM hits GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""
