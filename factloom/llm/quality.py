"""Quality rules with risk-controlled thresholds.

Each rule compares one measure of a text with a cutoff; all rules tighten together along a fixed path of strictness levels. In
each stratum (language) the labelled good documents are a holdout: level by level, from the loosest, the number that the rules
would reject is tested against the largest tolerated rate ``alpha`` with the exact binomial tail. A level is certified while
P(Bin(n, alpha) <= rejected) <= delta / strata (Bonferroni over strata); the first failure ends the stratum's path, so within a
stratum the fixed order of tests needs no further correction. With probability 1 - delta, no stratum's true rate of false
rejection exceeds ``alpha``. A stratum with too few labels certifies nothing and keeps what the base rule keeps.

Cases: a null text has no words and fails the base rule; a null stratum is a stratum of its own; labels that contradict each
other or are null are left out; labels of one document count once; repeated rows are judged one by one; a column named
``quality`` is replaced; empty tables give empty results, and no labels certify nothing.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import add_struct, cut, keep, scratch, table

COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
#: Each rule's measure with its cutoff at the loosest and at the strictest level; a document is rejected above the cutoff.
RULES = {
    "symbol_share": (0.50, 0.03),
    "upper_share": (0.90, 0.15),
    "top_word_share": (0.60, 0.14),
    "dup_line_share": (0.90, 0.25),
    "repeat_share": (0.30, 0.08),
    "mean_word_chars": (16.0, 7.0),
    "stutter_share": (0.80, 0.12),
}
LEVELS = 12
ALPHA, DELTA = 0.05, 0.10
FIELDS = COUNTS + "".join(f", {r} double" for r in RULES) + ", first_level int, base_failed boolean"

_CONTINUED = bytes(range(0x80, 0xC0))
_BLANKS = b" \t\n\x0b\x0c\r"
_UPPER = bytes(range(0x41, 0x5B))
_WINDOW = 8


def cutoffs(level: int) -> dict[str, float]:
    """The rules' cutoffs at a level from 0 (loosest) to LEVELS - 1: geometric steps."""
    share = level / (LEVELS - 1)
    return {rule: loose * (strict / loose) ** share for rule, (loose, strict) in RULES.items()}


def _repeated_words(ids: np.ndarray) -> int:
    """Words in 8-word windows that occur twice or more."""
    n = len(ids) - _WINDOW + 1
    if n < 2:
        return 0
    pairs = ids[:-1] * (int(ids.max()) + 1) + ids[1:]
    _, code, count = np.unique(pairs, return_inverse=True, return_counts=True)
    again = count[code] > 1
    alive = np.flatnonzero(again[:n] & again[2 : n + 2] & again[4 : n + 4] & again[6 : n + 6])  # a repeated window's pairs repeat
    if len(alive) < 2:
        return 0
    keys = np.stack([code[alive + j] for j in (0, 2, 4, 6)], axis=1)
    _, code, count = np.unique(keys, axis=0, return_inverse=True, return_counts=True)
    starts = alive[count[code.ravel()] > 1]
    marks = np.zeros(len(ids) + 1, np.int64)
    marks[starts] += 1
    marks[starts + _WINDOW] -= 1
    return int((np.cumsum(marks) > 0).sum())


def measure(raw: bytes | None) -> tuple:
    """The counts and rule measures of one text, in the order of FIELDS."""
    raw = raw or b""
    words = raw.split()  # at the six blanks of ASCII
    n = len(words)
    chars = len(raw.translate(None, _CONTINUED + _BLANKS))
    symbols = len(raw) - len(raw.translate(None, b"#*$%&|<>"))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    dup = len(lines) - len(set(lines))
    repeat, top, stutter = 0, 0, 0
    if n:
        last = dict(zip(words, range(n)))
        ids = np.fromiter(map(last.__getitem__, words), np.int64, n)
        repeat, top = _repeated_words(ids), int(np.bincount(ids).max())
        stutter = int((ids[1:] == ids[:-1]).sum())
    upper = len(raw) - len(raw.translate(None, _UPPER))
    share = (symbols / max(1, chars), upper / max(1, chars), top / max(1, n), dup / max(1, len(lines)), repeat / max(1, n), chars / max(1, n), stutter / max(1, n))
    first = next((level for level, cut_at in enumerate(_PATH) if any(x > c for x, c in zip(share, cut_at))), None)
    return n, chars, symbols, dup, repeat, *share, first, n < 20 or 100 * repeat > 30 * n


_PATH = [tuple(cutoffs(level).values()) for level in range(LEVELS)]


def measured(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """``docs`` with a struct ``quality`` of counts, measures, the first level that rejects (null: none) and the base rule."""
    return add_struct(docs, "quality", FIELDS, lambda texts: map(measure, texts), keep=keep)


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(Bin(n, p) <= k), exactly summed."""
    terms = (math.exp(math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) + j * math.log(p) + (n - j) * math.log1p(-p)) for j in range(k + 1))
    return min(1.0, math.fsum(terms))


def certified_level(n: int, first_rejects: list[int], alpha: float, threshold: float) -> int:
    """The last level of the path that is certified, -1 for none. first_rejects: good documents that each level is the first to reject."""
    rejected, level = 0, -1
    for found in first_rejects:
        rejected += found
        if not n or binomial_tail(rejected, n, alpha) > threshold:
            break
        level += 1
    return level


def certify(holdout: DataFrame, stratum: str, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """(stratum, n_good, level) from measured good documents; a row for each stratum that has any."""
    at = [F.count_if(F.col("quality.first_level") == level).alias(f"at_{level}") for level in range(LEVELS)]
    counts = cut(holdout.filter(~F.col("quality.base_failed")).groupBy(F.col(stratum).alias("stratum")).agg(F.count("*").alias("n_good"), *at), "quality-counts")
    strata = max(1, counts.count())

    def decide(frames):
        for frame in frames:
            levels = [certified_level(int(r["n_good"]), [int(r[f"at_{i}"]) for i in range(LEVELS)], alpha, delta / strata) for r in frame.to_dict("records")]
            yield pd.DataFrame({"stratum": frame["stratum"], "n_good": frame["n_good"], "level": levels})

    return counts.mapInPandas(decide, f"stratum {counts.schema['stratum'].dataType.simpleString()}, n_good long, level int")


def good_ids(labels: DataFrame) -> DataFrame:
    """doc_id of the documents that all their labels call good."""
    return labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("q")).filter("q = 1").select("doc_id")


def verdicts(found: DataFrame, levels: DataFrame, stratum: str) -> DataFrame:
    """Add ``_level`` and ``_kept`` to measured documents."""
    named = levels.select(F.col("stratum").alias("_stratum"), F.col("level").alias("_level"))
    kept = ~F.col("quality.base_failed") & (F.col("quality.first_level").isNull() | (F.col("quality.first_level") > F.coalesce("_level", F.lit(-1))))
    return found.join(named, F.col(stratum).eqNullSafe(F.col("_stratum")), "left").withColumn("_kept", kept).drop("_stratum")


def calibrate(docs: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """Certified levels of all strata. Texts are measured where they lie; only the measures meet the labels."""
    with scratch():
        found = cut(measured(docs.withColumn("_stratum", F.col(stratum)), keep=["doc_id", "_stratum"]), "quality-measures")
        return keep(certify(found.join(good_ids(labels), "doc_id", "left_semi"), "_stratum", alpha, delta), "quality-levels")


def apply_quality(docs: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """The documents that the base rule and the certified rules leave, with their own columns."""
    levels = calibrate(docs, labels, stratum, alpha, delta)
    own = docs.withColumnRenamed("quality", "_own_quality")  # the struct of measures takes that name for a while
    found = verdicts(measured(own), levels, "_own_quality" if stratum == "quality" else stratum).filter("_kept")
    return found.select(*[F.col(f"`{o}`").alias(c) for o, c in zip(own.columns, docs.columns)])


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document; measures are taken once and kept in the shared folder without the texts."""
    docs = table(spark, sf_dir, "documents")
    found = cut(measured(docs, keep=["doc_id", "lang"]), "quality-measures")
    levels = cut(certify(found.join(good_ids(table(spark, sf_dir, "labels")), "doc_id", "left_semi"), "lang"), "quality-levels")
    counts = [f"quality.{c.split()[0]}" for c in COUNTS.split(", ")]
    return verdicts(found, levels, "lang").select(
        "doc_id", *counts, "quality.base_failed", F.col("_kept").alias("kept"), F.coalesce("_level", F.lit(-1)).alias("certified_level"), F.col("quality.first_level").alias("first_level")
    )


def _sql() -> str:
    """The query in DuckDB SQL, with this module's cutoffs."""
    word, number = r"[^\x20\x09-\x0D]", lambda x: f"{x!r}e0"
    above = [" OR ".join(f"{rule} > {number(at)}" for rule, at in cutoffs(level).items()) for level in range(LEVELS)]
    first = "CASE " + " ".join(f"WHEN {x} THEN {level}" for level, x in enumerate(above)) + " END"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, regexp_extract_all(t, '{word}+') AS w FROM d),
u AS (SELECT r, i, w[i] AS x, CASE WHEN i > 1 THEN w[i - 1] END AS y, CASE WHEN i + 7 <= len(w) THEN array_to_string(w[i:i + 7], ' ') END AS g FROM w, unnest(range(1, len(w) + 1)) AS v(i)),
rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 8)) AS p FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM u WHERE g IS NOT NULL) WHERE c > 1) GROUP BY r),
top AS (SELECT r, max(c) AS n FROM (SELECT r, x, count(*) AS c FROM u GROUP BY r, x) GROUP BY r),
st AS (SELECT r, count(*) AS n FROM u WHERE x = y GROUP BY r),
m AS (
  SELECT d.*, len(w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars, length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols,
    length(t) - length(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')) AS upper, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{word}')) AS ls, coalesce(rep.n, 0) AS n_repeat_words, coalesce(top.n, 0) AS top, coalesce(st.n, 0) AS st
  FROM d JOIN w USING (r) LEFT JOIN rep USING (r) LEFT JOIN top USING (r) LEFT JOIN st USING (r)
), f AS (
  SELECT *, len(ls) - len(list_distinct(ls)) AS n_dup_lines, n_symbols::DOUBLE / greatest(1, word_chars) AS symbol_share, upper::DOUBLE / greatest(1, word_chars) AS upper_share, top::DOUBLE / greatest(1, n_words) AS top_word_share,
    (len(ls) - len(list_distinct(ls)))::DOUBLE / greatest(1, len(ls)) AS dup_line_share, n_repeat_words::DOUBLE / greatest(1, n_words) AS repeat_share, word_chars::DOUBLE / greatest(1, n_words) AS mean_word_chars, st::DOUBLE / greatest(1, n_words) AS stutter_share,
    n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed
  FROM m
), q AS (SELECT *, {first} AS first_level FROM f),
good AS (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1),
h AS (SELECT * FROM q WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM good)),
n AS (SELECT lang, count(*) AS n, count(*) OVER () AS strata FROM h GROUP BY lang),
k AS (SELECT n.lang, n.n, strata, l, (SELECT count(*) FROM h WHERE h.lang IS NOT DISTINCT FROM n.lang AND first_level <= l) AS k FROM n, unnest(range({LEVELS})) AS v(l)),
p AS (SELECT lang, l, strata, (SELECT sum(exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({number(ALPHA)}) + (n - j) * ln(1 - {number(ALPHA)}))) FROM unnest(range(k + 1)) AS v(j)) AS p FROM k),
c AS (SELECT lang, coalesce(min(l) FILTER (p > {number(DELTA)} / strata), {LEVELS}) - 1 AS level FROM p GROUP BY lang)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
  NOT base_failed AND (first_level IS NULL OR first_level > coalesce(level, -1)) AS kept, coalesce(level, -1)::INT AS certified_level, first_level
FROM q LEFT JOIN c ON c.lang IS NOT DISTINCT FROM q.lang"""


OP3_SQL = _sql()
