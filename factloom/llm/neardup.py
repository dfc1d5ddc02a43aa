"""Near-duplicate documents by MinHash bands, odd sketches and exact confirmation.

A document's set holds the distinct runs of ``shingle`` words (A-Z lower-cased, split at ASCII blanks), as 64-bit hashes; a text of
fewer words has its whole sequence as one. Documents with equal sets form a class, of which only the smallest doc_id goes on.
MinHash samples are cut into bands; two sets of similarity 0.8 share a band with probability over 0.99997. What shares a band is
verified by odd sketches: MinHash samples are folded into a bitmap of 2048 parities, and the population count of two sketches' XOR
tells how many samples differ. The samples folded are the least hash in each of 1024 ranges of one permutation (a set's mixed
hashes). From their estimated number of differing samples, sets of over 1280 hashes are candidates up to six standard deviations
below the similarity asked for (0.7 for 0.8), which loses less than one pair in 10^7; smaller sets are folded whole, where each
differing hash flips one bit at most, so that the filter is sound. What remains is confirmed on the full sets.

Buckets do not emit all their pairs. Two rounds compare the members of a bucket with one pivot each (its smallest, then its
largest id). Only in buckets that still hold several components are pairs across components compared, so no link is lost that
would join two components. Components come from alternating star steps.

Cases: a text that is null or has no words has an empty set and is linked with nothing; a null doc_id is linked with nothing and
stays; rows of one doc_id are one document and stay or go together; ties cannot arise, as ids decide; other columns stay in
:func:`remove_near_duplicates`; empty tables give empty results.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, keep, scratch, table
from .components import connected_components

SHINGLE, PERCENT = 5, 80
BANDS, ROWS = 20, 4
SKETCH_BITS = 2048
#: Ranges of a permutation, each with one sample; sets up to WHOLE hashes are folded whole, those from SAMPLED on by samples.
RANGES, WHOLE, SAMPLED = 1024, 1280, 1024
#: How far below the similarity asked for an estimate may lie, in standard deviations.
DEVIATIONS = 6
#: Shingles that are hashed for all samples at a time.
_CHUNK = 4096

_RANDOM = np.random.default_rng(20240229)
_FACTORS = _RANDOM.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_OFFSETS = _RANDOM.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingle_set(raw: bytes | None, shingle: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles."""
    words = raw.lower().split() if raw else []
    if not words:
        return np.empty(0, np.uint64)
    size = min(shingle, len(words))
    own = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = len(words) - size + 1
    out = np.full(n, size, np.uint64)
    for j in range(size):
        out = _mixed(out + own[j : j + n])
    return np.unique(out)


def samples(hashes: np.ndarray) -> np.ndarray:
    """MinHash samples of a non-empty set."""
    out = np.full(len(_FACTORS), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), _CHUNK):
        part = hashes[at : at + _CHUNK]
        np.minimum(out, (part[None, :] * _FACTORS[:, None] + _OFFSETS[:, None]).min(axis=1), out=out)
    return out


def bands(found: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band; keys of different bands differ."""
    rows = found.reshape(BANDS, ROWS)
    out = np.arange(1, BANDS + 1, dtype=np.uint64)
    for j in range(ROWS):
        out = _mixed(out * np.uint64(31) + rows[:, j])
    return out.view(np.int64)


def odd_sketch(hashes: np.ndarray) -> np.ndarray:
    """Parity bitmap of hashes or samples: every one flips one bit."""
    at = _mixed(hashes) % np.uint64(SKETCH_BITS)
    bits = np.bincount(at.astype(np.int64), minlength=SKETCH_BITS) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def range_samples(hashes: np.ndarray) -> np.ndarray:
    """MinHash samples of one permutation: the least of the sorted hashes in each of ``RANGES`` equal ranges that has any.

    As samples of different ranges differ, a sample stands for its range as well.
    """
    ranges = hashes >> np.uint64(64 - RANGES.bit_length() + 1)
    return hashes[np.concatenate(([True], ranges[1:] != ranges[:-1]))] if len(hashes) else hashes


def sketches(hashes: np.ndarray) -> tuple[np.ndarray | None, np.ndarray | None]:
    """(sketch of the whole set, sketch of its samples): small sets have the first, large ones the second, those between both.

    Any two sets of sizes that allow ``PERCENT`` or more have one of the two in common.
    """
    n = len(hashes)
    return odd_sketch(hashes) if n <= WHOLE else None, odd_sketch(range_samples(hashes)) if n >= SAMPLED else None


def most_samples_apart(n_a: Column, n_b: Column, percent: int) -> Column:
    """Samples that differ between sets of these sizes and of this similarity, plus ``DEVIATIONS`` standard deviations.

    A union of u hashes fills RANGES (1 - e^(-u / RANGES)) ranges, in each of which the least hash lies in both sets with the
    probability of their similarity. A range that disagrees adds one sample that differs, or two if both sets have a hash in it.
    The variance is at most four times that of the disagreeing ranges, and folding adds less than the number itself.
    """
    union, mean_size = (n_a + n_b) * (100 / (100 + percent)), (n_a + n_b) * 0.5
    ranges = (1 - F.exp(union * (-1 / RANGES))) * (RANGES * (100 - percent) / 100)
    apart = ranges * (2 - F.exp(mean_size * (-1 / RANGES)))
    return apart + F.sqrt(ranges * (4 * percent / 100) + apart) * DEVIATIONS


def bits_apart(samples_apart: Column) -> Column:
    """How many bits of two sketches are expected to differ, as samples that meet in a bit undo each other."""
    return (1 - F.exp(samples_apart * (-2 / SKETCH_BITS))) * (SKETCH_BITS / 2)


def _sketches_near(a: str, b: str, percent: int) -> Column:
    """Whether sizes and odd sketches allow the similarity; ``a`` and ``b`` end the names of the columns n, whole and sampled.

    Whole sets of s hashes together are similar enough if and only if at most s (1 - t) / (1 + t) hashes are in one of them alone.
    Each of these flips one bit, so no more bits can differ.
    """
    n_a, n_b = F.col(f"n{a}"), F.col(f"n{b}")

    def apart(c: str):
        return sum(F.bit_count(F.get(f"{c}{a}", F.lit(i)).bitwiseXOR(F.get(f"{c}{b}", F.lit(i)))) for i in range(SKETCH_BITS // 64))

    sized = 100 * F.least(n_a, n_b) >= percent * F.greatest(n_a, n_b)
    small = apart("whole") * (100 + percent) <= (100 - percent) * (n_a + n_b)
    large = apart("sampled") <= bits_apart(most_samples_apart(n_a, n_b, percent))
    return sized & F.coalesce(small, F.lit(True)) & F.coalesce(large, F.lit(True))


def signatures(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, n_shingles, set_key, bands, whole, sampled) of every document; the last two are odd sketches."""

    longs = "array<long>"

    def run(batches):
        import pyarrow as pa

        for b in batches:
            sizes, rows = [], []
            for raw in b.column(1).cast(pa.binary()):
                found = shingle_set(raw.as_py(), shingle)
                sizes.append(len(found))
                rows.append((xxhash.xxh3_128_digest(found.tobytes()), bands(samples(found)), *sketches(found)) if len(found) else (None, [], None, None))
            keys, *lists = zip(*rows) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), *(pa.array(x, pa.list_(pa.int64())) for x in lists)],
                names=["doc_id", "n_shingles", "set_key", "bands", "whole", "sampled"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_shingles long, set_key binary, bands {longs}, whole {longs}, sampled {longs}")


def _heads(classes: DataFrame, end: str, *more: str) -> DataFrame:
    """What sketches are compared by, with ``end`` added to all names."""
    return classes.select(*[F.col(c).alias(f"{c}{end}") for c in ("rep", "n", "whole", "sampled", *more)])


def _pairs_near(pairs: DataFrame, heads: DataFrame, percent: int) -> DataFrame:
    """Candidates whose set sizes and odd sketches allow the similarity. heads: (rep, n, whole, sampled)."""
    both = pairs.join(_heads(heads, "_a").withColumnRenamed("rep_a", "a"), "a").join(_heads(heads, "_b").withColumnRenamed("rep_b", "b"), "b")
    return both.filter(_sketches_near("_a", "_b", percent)).select("a", "b")


def _confirmed(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs whose full sets are similar enough."""

    def run(batches):
        import pyarrow as pa

        last, last_set = None, None
        for b in batches:
            keep = []
            for one, two, ta, tb in zip(b.column(0), b.column(1), b.column(2).cast(pa.binary()), b.column(3).cast(pa.binary())):
                if last != two:
                    last, last_set = two, shingle_set(tb.as_py(), shingle)
                own = shingle_set(ta.as_py(), shingle)
                common = len(np.intersect1d(own, last_set, assume_unique=True))
                keep.append(100 * common >= percent * (len(own) + len(last_set) - common))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], names=["a", "b"])

    left, right = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    kind = pairs.schema["a"].dataType.simpleString()
    return pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b").mapInArrow(run, f"a {kind}, b {kind}").distinct()


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): one row for each row of ``docs``."""
    with scratch():
        return keep(_grouped(docs, shingle, percent), "near-duplicates")


def _grouped(docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    found = cut(signatures(docs, shingle), "signatures")
    classes = (
        found.filter("n_shingles > 0 and doc_id is not null").groupBy("set_key")
        .agg(F.min("doc_id").alias("rep"), F.min_by(F.struct(F.col("n_shingles").alias("n"), "bands", "whole", "sampled"), "doc_id").alias("s"))
    )
    classes = cut(classes.select("set_key", "rep", "s.*"), "classes")
    heads = classes.select("rep", "n", "whole", "sampled")
    keyed = classes.select("rep", F.explode("bands").alias("band"))
    shared = keyed.groupBy("band").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).filter("low < high")
    members = cut(keyed.join(shared, "band"), "members")

    low = members.filter("rep <> low").select(F.col("rep").alias("a"), F.col("low").alias("b"))
    high = members.filter("rep <> high and low <> high").select(F.col("high").alias("a"), F.col("rep").alias("b"))
    tried = cut(_pairs_near(low.union(high).distinct(), heads, percent), "pairs")
    involved = members.select(F.col("rep").alias("doc_id")).distinct()
    texts = cut(docs.select("doc_id", "text").join(involved, "doc_id", "left_semi"), "texts")
    links = cut(_confirmed(tried, texts, shingle, percent), "links")

    # buckets that still hold several components
    roots = connected_components(links)
    labelled = cut(members.join(roots, members["rep"] == roots["node"], "left").select("band", "rep", F.coalesce("root", "rep").alias("label")), "labelled")
    open_ = labelled.groupBy("band").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x < y").select("band")
    rest = cut(labelled.join(open_, "band", "left_semi").join(heads, "rep"), "rest")
    x, y = _heads(rest, "_x", "label", "band"), _heads(rest, "_y", "label", "band")
    near = (F.col("label_x") < F.col("label_y")) & _sketches_near("_x", "_y", percent)
    across = x.join(y, (x["band_x"] == y["band_y"]) & near).select(F.greatest("rep_x", "rep_y").alias("a"), F.least("rep_x", "rep_y").alias("b")).distinct()
    more = _confirmed(across.join(tried, ["a", "b"], "left_anti"), texts, shingle, percent)
    roots = connected_components(links.union(more))

    ends = classes.join(roots, classes["rep"] == roots["node"], "left").select("set_key", F.coalesce("root", "rep").alias("end"))
    out = found.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("set_key")).alias("set_key")).join(ends, "set_key", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("end", "doc_id").alias("component_id"), F.coalesce(F.col("doc_id") == F.coalesce("end", "doc_id"), F.lit(True)).alias("kept"))


def remove_near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One document of each group: the one with the smallest doc_id."""
    gone = near_duplicates(docs, shingle, percent).filter("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*[f"`{c}`" for c in docs.columns])


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its set size and group, on shingles of four words."""
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=4)


OP9_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i+3], ' ') AS t FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 3) + 1)) AS i FROM w WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (
  SELECT p.a, p.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.t = y.t AND x.doc_id > y.doc_id GROUP BY 1, 2) p
  JOIN n na ON na.doc_id = p.a JOIN n nb ON nb.doc_id = p.b WHERE 100 * c >= 80 * (na.n + nb.n - c)
), sym AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id, doc_id AS r FROM w UNION SELECT reach.doc_id, sym.b FROM reach JOIN sym ON reach.r = sym.a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id, m.c = w.doc_id AS kept
FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(r) AS c FROM reach GROUP BY doc_id) m ON m.doc_id = w.doc_id
"""
