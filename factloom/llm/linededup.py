"""Line dedup by an exact set-similarity join, in DataFrame functions only.

A line's set holds its distinct lower-cased words between ASCII blanks. A line that has a word goes if an earlier one (by doc_id,
then position) has a Jaccard similarity of 0.8 or more with it. Lines with equal sets form a class, of which only the first is
compared with other classes.

Words are ordered by rarity: a table of 2^20 hash buckets, counted over all documents, gives each word a level, and rarer levels
come first, ties by hash. Two sets of similarity t have at least a = ceil(t n) words in common, so they share l of the first
n - a + l words of each, for any l up to a (prefix filter). A single shared word says little once a corpus is large. Therefore

* a word that occurs ``RARE`` times or less is a key by itself; as few lines can have it, all that share it are compared;
* other words are dealt to ``m`` parts by their hash, and every ``wise`` of them that lie in one part are a key together.

With l = 1 + m (wise - 1), the shared words have a rare one, or else ``wise`` of them are in one part: nothing is lost. Longer
lines have more parts (``BANDS``); a line joins the band below as well if a shorter partner can be there. The number of keys a
line follows from its length and not from the corpus, and ``wise`` grows with the corpus, so that keys stay selective.
Sets of fewer than eight words can only match equal ones or those with one word more or less: their key is the set, and that of
sets of up to eight words every set without one word.

Candidates that share a key must also fit in length (n_x >= t n_y) and in position (the words that are left must suffice). What
is left is verified on the whole sets (64-bit hashes of their words). A key that more than ``HOT`` classes share does not emit all
their pairs: its classes are compared with the first of them, and those without an earlier match are sought anew among the lines of
hot keys, by keys of one word more from a longer prefix. Such keys split a hot one into many, and nothing is lost as long as a
matching pair must share l words, which holds up to ``WISEST`` words at every length. Only under keys of so many words that are
still hot do lines without an earlier match meet all earlier ones of fitting length.

Cases: null or empty texts have no lines to judge; lines without a word and lines of documents with a null doc_id are left
alone; rows of one doc_id count as one document; ties go by doc_id and position; very long lines are judged whole; doc_ids may be
of any ordered type; other columns stay; empty tables give empty results.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, drop, free_shuffles, keep, scratch, table

PERCENT = 80
#: Words of more occurrences are keys only together; keys of more classes are hot.
RARE, HOT = 8, 256
#: Words of a key at most: 1 + m (WISEST - 1) words are no more than two matching lines share, in all bands.
WISEST = 4
#: (least number of words, parts) of each band of lengths. Shorter lines are matched by sets without one word.
BANDS = ((8, 2), (16, 3), (32, 6), (64, 11), (128, 22))
BUCKET_BITS = 20
#: Beyond so many classes, keys have three words in place of two.
MANY_CLASSES = 1 << 31
#: Keys or line numbers that are broadcast at most (about 80 bytes of the driver's memory each); beyond that, the tables are shuffled.
BROADCAST_ROWS = 1 << 18
_LOW = (1 << 56) - 1
#: A prefix word is a number of 31 bits: 29 of its hash, whether it is often seen, whether it may be in a hot key.
_OFTEN, _BUSY = 1, 2


def _plain(text: Column, blanks: str = "\t\x0b\x0c\r") -> Column:
    """The lower-cased text with blanks in place of other ASCII blanks; looking for each is much cheaper than a pattern."""
    for c in blanks:
        text = F.replace(text, F.lit(c), F.lit(" "))
    return F.lower(text)


def _lines(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, line): the lines to judge, as plain texts; documents without an id have none."""
    return docs.filter("doc_id is not null").select("doc_id", F.posexplode(F.split(_plain(F.col("text")), "\n")).alias("pos", "line"))


def _hashes(line: Column) -> Column:
    """Hashes of a plain line's words."""
    return F.transform(F.array_remove(F.split(line, " "), ""), lambda w: F.xxhash64(w))


def _level(count: int) -> int:
    """Half-steps of log2."""
    return min(120, 2 * count.bit_length() - (count < 3 << max(0, count.bit_length() - 2)))


def _levels(counts: np.ndarray) -> np.ndarray:
    """:func:`_level` of each count."""
    starts = sorted({n for e in range(60) for n in (1 << e, 3 << e)})  # where the next level begins
    return np.array([0, *map(_level, starts)], np.uint8)[np.searchsorted(starts, counts, "right")]


def rarity_levels(docs: DataFrame) -> bytes:
    """For each hash bucket, the level of how many words of all documents fall into it."""
    bucket = F.xxhash64("w").bitwiseAND(F.lit((1 << BUCKET_BITS) - 1)).cast("int")
    counts = docs.select(F.explode(F.split(_plain(F.col("text"), "\n\t\x0b\x0c\r"), " ")).alias("w")).filter("w <> ''").groupBy(bucket.alias("b")).agg(F.count("*").alias("n"))
    levels, found = np.zeros(1 << BUCKET_BITS, np.uint8), counts.filter("n > 1").toArrow()  # 2^20 rows at most
    levels[found.column("b").to_numpy()] = _levels(found.column("n").to_numpy())
    return levels.tobytes()


def _at_most(n: Column) -> Column:
    """How many of n words a set can lack and still match another one: n - ceil(t n)."""
    return F.floor(n * (100 - PERCENT) / 100).cast("int")


def _by_band(n: Column, values) -> Column:
    """The value of the band that n lies in; for the shortest lines that of the first."""
    found = F.lit(values[0])
    for (least, _), value in zip(BANDS, values):
        found = F.when(n >= least, F.lit(value)).otherwise(found)
    return found


def measured_lines(lines: DataFrame, wise: int, levels: bytes) -> DataFrame:
    """(doc_id, pos, k1, k2, n, b0, b1, prefix) of every plain line that has a word; k1 and k2 are hashes of its set, n is the set's size.

    b0 and b1 are the parities of how many words fall to each of 128 bits.
    """
    levels = F.lit(levels)
    level = lambda h: F.ascii(F.substring(levels, h.bitwiseAND(F.lit((1 << BUCKET_BITS) - 1)).cast("int") + 1, F.lit(1)).cast("string"))
    coded = F.transform(_hashes(F.col("line")), lambda h: F.shiftleft(level(h).cast("long"), 56).bitwiseOR(h.bitwiseAND(F.lit(_LOW))))
    flags = lambda t: F.when(t >= F.lit(_level(HOT + 1) << 56), _OFTEN + _BUSY).when(t > F.lit((_level(RARE) + 1 << 56) - 1), _OFTEN).otherwise(0)
    packed = lambda t: (F.shiftright(t, 24).bitwiseAND(F.lit((1 << 29) - 1)) * 4 + flags(t)).cast("int")
    # explode() of one set: a plain column would be copied into every expression that uses it
    sets = lines.select("doc_id", "pos", F.explode(F.array(F.sort_array(F.array_distinct(coded)))).alias("s")).filter(F.size("s") > 0)
    n = F.size("s")
    size = F.when(n <= BANDS[0][0], n).otherwise(_at_most(n) + 1 + _by_band(n, [m for _, m in BANDS]) * (wise - 1))
    bit = lambda h: F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(F.lit(63)).cast("int"))
    parity = lambda half: F.aggregate("s", F.lit(0).cast("long"), lambda b, h: F.when(h.bitwiseAND(F.lit(64)) == half, b.bitwiseXOR(bit(h))).otherwise(b))
    return sets.select("doc_id", "pos", F.xxhash64("s").alias("k1"), F.xxhash64(F.lit(17), "s").alias("k2"), n.alias("n"), parity(0).alias("b0"), parity(64).alias("b1"), F.transform(F.slice("s", F.lit(1), size), packed).alias("prefix"))


def _order(lines: DataFrame) -> tuple[Column, Column, Column]:
    """What orders lines by (doc_id, pos): one long where both fit, else a struct; and doc_id and pos as they follow from a column ``ord``."""
    kind = lines.schema["doc_id"].dataType
    if kind.simpleString() in ("tinyint", "smallint", "int", "bigint"):
        low, high, pos = lines.agg(F.min("doc_id"), F.max("doc_id"), F.max("pos")).first()
        bits = (pos or 0).bit_length() + 1
        if max(abs(low or 0), abs(high or 0)).bit_length() + bits < 63:
            back = F.shiftright("ord", bits).cast(kind), F.col("ord").bitwiseAND(F.lit((1 << bits) - 1)).cast("int")
            return F.col("doc_id").cast("long") * F.lit(1 << bits) + F.col("pos"), *back
    return F.struct("doc_id", "pos"), F.col("ord.doc_id"), F.col("ord.pos")


def _chosen(docs: DataFrame, ids: DataFrame, order: tuple[Column, Column, Column]) -> DataFrame:
    """(doc_id, pos, line): the plain lines of the numbers in ``ids``; texts meet the places of their lines, and only these lines are made into rows."""
    _, doc_id, pos = order
    places = ids.select(doc_id.alias("doc_id"), pos.alias("pos")).groupBy("doc_id").agg(F.collect_list("pos").alias("at"))
    places = F.broadcast(places) if _few(ids) else places
    # explode() of one array: see measured_lines
    split = docs.select("doc_id", "text").join(places, "doc_id").select("doc_id", "at", F.explode(F.array(F.split(_plain(F.col("text")), "\n"))).alias("s"))
    lines = split.select("doc_id", F.explode(F.transform("at", lambda p: F.struct(p.alias("pos"), F.get(F.col("s"), p).alias("line")))).alias("l"))
    return lines.select("doc_id", "l.pos", "l.line").filter("line is not null")


def _keys(classes: DataFrame, wise: int) -> DataFrame:
    """(key, ord, busy, n, i): the keys of every class of eight words or more; i is the place of the key's last word."""
    n, part = F.col("n"), lambda c: F.shiftright(c, 2) % F.col("m")
    ends = [least for least, _ in BANDS[1:]] + [1 << 30]
    bands = F.array(*[F.when((n >= least) & (n - _at_most(n) < end), b) for b, ((least, _), end) in enumerate(zip(BANDS, ends))])
    lines = classes.filter(n >= BANDS[0][0]).select("ord", "n", "prefix", F.explode(bands).alias("band")).filter("band is not null")
    parts = F.get(F.array(*[F.lit(m) for _, m in BANDS]), F.col("band"))
    lines = lines.withColumn("m", parts).select("ord", "n", "band", "m", F.slice("prefix", F.lit(1), _at_most(n) + 1 + F.col("m") * (wise - 1)).alias("p"))
    single = lines.select("*", F.posexplode("p").alias("i", "w")).withColumn("key", F.xxhash64("band", "w"))
    often = lambda c: F.col(c).bitwiseAND(F.lit(_OFTEN)) > 0
    rare = single.filter(~often("w")).select("key", "ord", F.lit(False).alias("busy"), "n", "i")
    some = single.filter(often("w")).withColumn("busy", F.col("w"))
    for _ in range(wise - 1):
        some = some.select("*", F.posexplode(F.slice("p", F.col("i") + 2, F.size("p"))).alias("j", "v")).filter(often("v") & (part(F.col("v")) == part(F.col("w")))).select(
            "ord", "n", "band", "m", "p", (F.col("i") + 1 + F.col("j")).alias("i"), "w", F.xxhash64("key", "v").alias("key"), F.col("busy").bitwiseAND(F.col("v")).alias("busy")
        )
    return rare.union(some.select("key", "ord", F.col("busy").bitwiseAND(F.lit(_BUSY)) > 0, "n", "i"))


def _fitting(x: DataFrame, y: DataFrame, *on: str) -> DataFrame:
    """(ord_x, ord_y): pairs of a later line x and an earlier line y that agree in the columns ``on`` and fit in length and position."""
    nx, ny, ix, iy = (F.col(c) for c in ("x.n", "y.n", "x.i", "y.i"))
    sized = 100 * F.least(nx, ny) >= PERCENT * F.greatest(nx, ny)
    placed = (1 + F.least(nx - 1 - ix, ny - 1 - iy) + F.least(ix, iy)) * (100 + PERCENT) >= PERCENT * (nx + ny)
    same = [F.col(f"x.{c}") == F.col(f"y.{c}") for c in on]
    return x.alias("x").join(y.alias("y"), [*same, F.col("x.ord") > F.col("y.ord"), sized, placed]).select(F.col("x.ord").alias("ord_x"), F.col("y.ord").alias("ord_y"))


def _short_pairs(classes: DataFrame) -> DataFrame:
    """(ord_x, ord_y): pairs of short sets of which one is the other without one word."""
    most = BANDS[0][0]
    n, without = F.col("n"), F.concat(F.slice("prefix", F.lit(1), F.col("i")), F.slice("prefix", F.col("i") + 2, F.lit(most)))
    least = 100 // (100 - PERCENT)
    whole = classes.filter((n >= least - 1) & (n < most)).select("ord", F.xxhash64("prefix").alias("key"))
    less = classes.filter((n >= least) & (n <= most)).select("ord", "prefix", F.explode(F.sequence(F.lit(0), n - 1)).alias("i")).select("ord", F.xxhash64(without).alias("key"))
    met = whole.alias("x").join(less.alias("y"), F.col("x.key") == F.col("y.key"))
    return met.select(F.greatest("x.ord", "y.ord").alias("ord_x"), F.least("x.ord", "y.ord").alias("ord_y")).filter("ord_x > ord_y")


def _few(df: DataFrame) -> bool:
    return df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS


def _small(df: DataFrame) -> DataFrame:
    """The table, broadcast if its size has been checked."""
    return F.broadcast(df) if _few(df) else df


def _verified(pairs: DataFrame, docs: DataFrame, order: tuple[Column, Column, Column], maps: DataFrame) -> DataFrame:
    """Lines (by order number) with an earlier match among the pairs (ord_x later, ord_y earlier).

    Bitmaps of parities (``maps``: ord, n, b0, b1) come first: no more bits can differ than the sets' difference has words; only what
    is left is looked up in the texts. One match is enough, so each line is then compared with the earliest of its candidates, and with
    the others only if that fails.
    """
    ends = cut(pairs.distinct(), "line-pairs")
    free_shuffles(docs.sparkSession)
    named = lambda df, c: df.select(*[F.col(x).alias(f"{x}_{c}") for x in df.columns])
    differ = sum(F.bit_count(F.col(f"{b}_x").bitwiseXOR(F.col(f"{b}_y"))) for b in ("b0", "b1"))
    near = ends.join(named(maps, "x"), "ord_x").join(named(maps, "y"), "ord_y").filter(differ * (100 + PERCENT) <= (100 - PERCENT) * (F.col("n_x") + F.col("n_y")))
    near = cut(near.select("ord_x", "ord_y"), "line-near-pairs")
    drop(ends)
    wanted = cut(near.select(F.col("ord_x").alias("ord")).union(near.select("ord_y")).distinct(), "line-ids")
    lines = _chosen(docs, wanted, order)
    sets = cut(lines.select(order[0].alias("ord"), F.array_distinct(_hashes(F.col("line"))).alias("w")).dropDuplicates(["ord"]), "line-words")
    drop(wanted)

    def similar(some):
        both = some.join(named(sets, "x"), "ord_x").join(named(sets, "y"), "ord_y")
        return both.filter(F.size(F.array_intersect("w_x", "w_y")) * (100 + PERCENT) >= PERCENT * (F.size("w_x") + F.size("w_y"))).select(F.col("ord_x").alias("ord")).distinct()

    first = near.groupBy("ord_x").agg(F.min("ord_y").alias("ord_y"))
    found = cut(similar(first), "lines-similar")
    rest = near.join(found.withColumnRenamed("ord", "ord_x"), "ord_x", "left_anti").join(first, ["ord_x", "ord_y"], "left_anti")
    return found.union(similar(rest))


def removed_lines(docs: DataFrame, wise: int | None = None) -> DataFrame:
    """(doc_id, pos): every line that an earlier one matches. ``wise``: words of a key; it follows the corpus if it is not given."""
    with scratch():
        return keep(_removed(docs, wise), "lines-removed")


def _removed(docs: DataFrame, wise: int | None) -> DataFrame:
    if wise is None:  # the number of lines is known only with the lines, so the texts' line feeds bound it
        most = docs.agg(F.sum(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1)).first()[0] or 0
        wise = 2 if most <= MANY_CLASSES else 3
    levels = rarity_levels(docs)
    lines = cut(measured_lines(_lines(docs), wise, levels), "lines")
    order = _order(lines)
    numbered = cut(lines.select("doc_id", "pos", "k1", "k2", order[0].alias("ord")), "line-numbers")
    classes = lines.withColumn("ord", order[0]).groupBy("k1", "k2").agg(F.min("ord").alias("ord"), *[F.any_value(c).alias(c) for c in ("n", "b0", "b1", "prefix")])
    classes = cut(classes, "line-classes")
    drop(lines)
    gone = _matched(docs, classes, order, wise, levels)
    near = gone.distinct().withColumn("near", F.lit(True))

    verdicts = classes.select("k1", "k2", "ord").join(near, "ord", "left").select("k1", "k2", F.col("ord").alias("first"), F.coalesce("near", F.lit(False)).alias("near"))
    return numbered.join(verdicts, ["k1", "k2"]).filter((F.col("ord") > F.col("first")) | F.col("near")).select("doc_id", "pos").distinct()


def _matched(docs: DataFrame, classes: DataFrame, order: tuple[Column, Column, Column], wise: int, levels: bytes) -> DataFrame:
    """(ord): classes that an earlier one matches. Classes of hot keys are sought again with longer keys until no key is hot."""
    pairs, gone, maps = _short_pairs(classes), None, classes.select("ord", "n", "b0", "b1")
    while True:
        keyed = _keys(classes, wise)
        later = lambda rows: rows if gone is None else rows.join(_small(gone), "ord", "left_anti")  # noqa: B023, E731
        busy = keyed.filter("busy")
        hot_keys = cut(busy.groupBy("key").agg(F.count("*").alias("c"), F.min("ord").alias("first")).filter(F.col("c") > HOT), "hot-keys")
        if hot_keys.isEmpty():
            last = _fitting(later(keyed), keyed, "key")
            return _verified(last.union(pairs), docs, order, maps) if gone is None else gone.union(_verified(last, docs, order, maps))
        usual = keyed.join(_small(hot_keys), "key", "left_anti").select("key", "ord", "n", "i")
        hot = cut(busy.join(_small(hot_keys), "key").select("key", "ord", "n", "i", "first"), "hot-lines")
        met = _fitting(later(usual), usual, "key").union(_fitting(later(hot), hot.filter("ord = first"), "key"))
        if gone is None:
            gone = cut(_verified(met.union(pairs), docs, order, maps), "lines-gone")
        else:
            gone = cut(gone.union(_verified(met, docs, order, maps)), "lines-gone")
        if wise >= WISEST:
            step = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100 / PERCENT))).cast("int")
            rest = later(hot).select("key", "ord", "n", "i", F.explode(F.array(step - 1, step, step + 1)).alias("step"))
            return gone.union(_verified(_fitting(rest, hot.select("key", "ord", "n", "i", step.alias("step")), "key", "step"), docs, order, maps))
        wise += 1
        # plans with the table of levels are long texts for the driver, which adaptive execution renews after each stage: here there are none to renew
        texts = cut(_chosen(docs, hot.select("ord").distinct(), order), "hot-line-texts")
        longer = cut(measured_lines(texts, wise, levels).withColumn("ord", order[0]), "hot-lines-measured")
        drop(texts)
        classes = cut(longer.groupBy("ord").agg(F.any_value("n").alias("n"), F.any_value("prefix").alias("prefix")), "hot-line-classes")


def remove_lines(docs: DataFrame) -> DataFrame:
    """Documents without their removed lines (``n_chars`` follows, if there is one); documents that lose all their words go."""
    gone = removed_lines(docs).groupBy("doc_id").agg(F.collect_list("pos").alias("_gone"))
    left = F.array_join(F.filter(F.split("text", "\n"), lambda line, i: ~F.array_contains("_gone", i)), "\n")
    found = docs.join(gone, "doc_id", "left").withColumn("_left", F.when(F.col("_gone").isNull(), F.col("text")).otherwise(left))
    found = found.filter(F.col("_gone").isNull() | F.col("_left").rlike("[^\\x20\\x09-\\x0D]"))
    columns = {"text": F.col("_left"), "n_chars": F.when(F.col("_gone").isNull(), F.col("n_chars")).otherwise(F.length("_left")).cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None}
    return found.select(*[columns[c].alias(c) if columns.get(c) is not None else f"`{c}`" for c in docs.columns])


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its number of lines, and the positions (from 0) of those that are removed."""
    docs = table(spark, sf_dir, "documents")
    gone = removed_lines(docs).groupBy("doc_id").agg(F.count("*").alias("k"), F.array_join(F.sort_array(F.collect_list("pos")), ",").alias("r"))
    n_lines = F.coalesce(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1, F.lit(0))
    return docs.select("doc_id", n_lines.cast("long").alias("n_lines")).join(gone, "doc_id", "left").select(
        "doc_id", "n_lines", F.coalesce("k", F.lit(0)).alias("n_removed"), F.coalesce("r", F.lit("")).alias("removed_lines")
    )


OP8_SQL = r"""
WITH l AS (
  SELECT doc_id, i - 1 AS pos, list_distinct(regexp_extract_all(lower(s[i]), '[^\x20\x09-\x0D]+')) AS w
  FROM (SELECT doc_id, string_split(text, chr(10)) AS s, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)
), c AS (
  SELECT list_sort(w) AS k, len(list_sort(w)) AS n, min((doc_id, pos)) AS first FROM l WHERE len(w) > 0 GROUP BY 1, 2
), ids AS (SELECT *, row_number() OVER (ORDER BY first) AS id FROM c),
t AS (SELECT id, n, unnest(k) AS t FROM ids),
p AS (SELECT x.id, x.n AS nx, y.n AS ny, y.id AS y, count(*) AS o FROM t x JOIN t y ON x.t = y.t AND x.id > y.id AND 100 * least(x.n, y.n) >= 80 * greatest(x.n, y.n) GROUP BY 1, 2, 3, 4),
near AS (SELECT DISTINCT id FROM p WHERE 100 * o >= 80 * (nx + ny - o)),
gone AS (
  SELECT l.doc_id, l.pos FROM l JOIN ids ON list_sort(l.w) = ids.k LEFT JOIN near ON near.id = ids.id
  WHERE (l.doc_id, l.pos) > ids.first OR near.id IS NOT NULL
), g AS (SELECT doc_id, count(*) AS k, string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) AS r FROM gone GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(len(string_split(d.text, chr(10))), 0) AS BIGINT) AS n_lines, coalesce(k, 0) AS n_removed, coalesce(r, '') AS removed_lines
FROM documents d LEFT JOIN g USING (doc_id)
"""
