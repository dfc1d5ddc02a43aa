"""Evidence fusion: records of the other side that share terms with search hits."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.work import kept, scope

#: Words that say nothing about a text; the patterns of ``terms`` are fixed too.
STOP_WORDS = ["api", "code", "document", "file", "java", "knowledge", "method", "package", "section", "type"]
M = 5
#: Fields of a hit whose terms count besides its text's.
ANCHOR_FIELDS = ["symbol_name", "type_name", "path", "section", "statement"]
#: Records on the lists of rare terms that give an anchor's first bound.
FIRST_POSTINGS = 200
#: Anchors and records of a block at most (records are dealt to more blocks while these hold more than FEW_RECORDS), and matches pairs that a task lays out at a time.
BLOCK_ANCHORS, BLOCK_RECORDS, FEW_RECORDS, PAIRS, PAIR_BLOCK = 1024, 4096, 512, 10_000_000, 20_000
KNOWLEDGE = ("kb", "knowledge_asset")


def terms(text: Column, least: int = 2, stop: list[str] = STOP_WORDS) -> Column:
    """Distinct lower-cased parts of identifiers, digit runs and CJK runs, without stop words."""
    raw = F.array_join(F.regexp_extract_all(text, F.lit("([A-Za-z_][A-Za-z0-9_]*|[0-9]+|[\\u4e00-\\u9fff]{2,})"), F.lit(1)), " ")
    parts = F.split(F.regexp_replace(raw, "([a-z0-9])([A-Z])", "$1 $2"), "[_\\-\\s./:{}()]+")
    return F.array_distinct(F.filter(F.transform(parts, lambda t: F.lower(t)), lambda t: (F.length(t) >= least) & ~t.isin(stop)))


def is_knowledge(source_type: str = "source_type") -> Column:
    """Whether a record is on the knowledge side."""
    return F.col(source_type).isin(*KNOWLEDGE)


def anchor_terms(query: Column, *fields: Column) -> Column:
    """Terms of a query and of a hit's text and names."""
    return terms(F.concat_ws("\n", query, *fields))


def record_terms(text: Column, *metadata: Column) -> Column:
    """Terms of a record's text and of all its metadata values."""
    return terms(F.concat(text, F.lit("\n"), F.concat_ws(" ", *metadata)))


def _sharing(asked: DataFrame, lists: DataFrame) -> DataFrame:
    """(qn, rn, score): pairs that share at least ``need`` terms besides the ``late`` ones, with the number of all that they share.

    asked: (qn, code, side, need, late), a row for each term; lists: (rn, code, of). Anchors and records are dealt to blocks; each pair of
    blocks is a co-group, which matches its lists code by code, adds up in a matrix, and looks late terms up for the pairs that are left.
    """
    spark = lists.sparkSession
    n_anchors, n_records = (df.select(c).distinct().count() for df, c in ((asked, "qn"), (lists, "rn")))
    q_blocks, r_blocks = max(1, -(-n_anchors // BLOCK_ANCHORS)), max(1, -(-n_records // BLOCK_RECORDS), min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_records // FEW_RECORDS)))
    every, dealt = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1))), lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    left = asked.withColumn("_q", dealt("qn", q_blocks)).withColumn("_r", every(r_blocks))
    right = lists.withColumn("_r", dealt("rn", r_blocks)).withColumn("_q", every(q_blocks))

    def run(own, held):
        import pyarrow as pa

        (anchors, first, q), (records, first_r, r) = (np.unique(t[c].to_numpy(), return_index=True, return_inverse=True) for t, c in ((own, "qn"), (held, "rn")))
        late, every_code, code = own["late"].to_numpy(zero_copy_only=False), own["code"].to_numpy(), held["code"].to_numpy()
        order = np.flatnonzero(~late)[np.argsort(every_code[~late], kind="stable")]
        codes, having = every_code[order], q[order]
        begin, many = np.searchsorted(codes, code), np.searchsorted(codes, code, side="right")
        many -= begin
        shared = np.zeros(len(anchors) * len(records), np.int64)
        steps = np.searchsorted(np.cumsum(many), np.arange(0, many.sum() + PAIRS, PAIRS)[1:], side="right") if len(many) else []
        at = 0
        for end in [*steps, len(many)]:
            size = many[at:end]
            if size.sum():
                place = np.repeat(begin[at:end] - (np.cumsum(size) - size), size) + np.arange(size.sum())
                shared += np.bincount(having[place] * len(records) + np.repeat(r[at:end], size), minlength=len(shared))
            at = max(at, end)
        shared = shared.reshape(len(anchors), len(records))
        side, of = (np.array([x or none for x in t[c].to_pylist()], object)[i] for t, c, i, none in ((own, "side", first, "any"), (held, "of", first_r, "none")))
        need = own["need"].to_numpy()[first]
        found = np.nonzero((shared >= need[:, None]) & (shared > 0) & ((side[:, None] == "any") | (side[:, None] != of[None, :])))
        # late terms of the pairs that are left: one look-up for each, in the sorted (record, code) of the block
        order = np.flatnonzero(late)[np.argsort(q[late], kind="stable")]
        begin, many = np.searchsorted(q[order], found[0]), np.searchsorted(q[order], found[0], side="right")
        many -= begin
        names, local = np.unique(code, return_inverse=True)
        held_keys = np.sort(r * (len(names) + 1) + local)
        score = shared[found]
        for at in range(0, len(many), PAIR_BLOCK):
            size = many[at : at + PAIR_BLOCK]
            pair = np.repeat(np.arange(len(size)), size)
            asked_code = every_code[order[np.repeat(begin[at : at + PAIR_BLOCK] - (np.cumsum(size) - size), size) + np.arange(size.sum())]]
            name = np.minimum(np.searchsorted(names, asked_code), max(0, len(names) - 1))
            key = found[1][at + pair] * (len(names) + 1) + name
            spot = np.minimum(np.searchsorted(held_keys, key), max(0, len(held_keys) - 1))
            hit = (names[name] == asked_code) & (held_keys[spot] == key)
            score[at : at + PAIR_BLOCK] += np.bincount(pair[hit], minlength=len(size))
        return pa.table({"qn": pa.array(anchors[found[0]], pa.int64()), "rn": pa.array(records[found[1]], pa.int64()), "score": pa.array(score, pa.float64())})

    return left.groupBy("_q", "_r").cogroup(right.groupBy("_q", "_r")).applyInArrow(run, "qn long, rn long, score double")


def overlaps(anchors: DataFrame, records: DataFrame, m: int = M) -> DataFrame:
    """(q, id, ord, score, rank): for each anchor the ``m`` records that share most terms with it; records that share none are absent.

    ``anchors``: (q, terms, side, excluded ids), of any number, each q once; ``records``: (id, ord, terms, side), each id once. Sides
    must differ where the anchor has one; ties go by ord; repeated and null terms count once and not at all.

    Terms that some anchor has get codes, and lists of the records that hold them; an anchor walks its lists from the rarest term on. A first walk over the rarest ones, FIRST_POSTINGS
    records in all, finds records whose whole overlap is then counted; the m-th best of them, ``least``, bounds what a result must have.
    So the second walk leaves out the ``left`` most frequent terms, half of ``least``: a record that can be a result shares ``least - left`` of the
    others. Only records that do are counted on their whole sets. Nothing is collected, and work grows with the lists that are walked.
    """
    with scope():
        own = kept(anchors.select("q", F.array_distinct(F.array_compact("terms")).alias("terms"), "side", F.coalesce("excluded", F.array().cast(anchors.schema["excluded"].dataType)).alias("excluded"), F.monotonically_increasing_id().alias("qn")), "anchors")
        rows = kept(records.select("id", F.col("ord").cast("long").alias("ord"), F.array_distinct(F.array_compact("terms")).alias("terms"), F.col("side").alias("of"), F.monotonically_increasing_id().alias("rn")), "records")
        asked = own.select("qn", "side", F.explode("terms").alias("term"))
        codes = kept(asked.select("term").distinct().withColumn("code", F.monotonically_increasing_id()), "codes")
        lists = kept(rows.select("rn", "of", F.explode("terms").alias("term")).join(codes, "term").drop("term"), "lists")
        place = Window.partitionBy("qn").orderBy("n", "code")
        known = asked.join(codes, "term").join(lists.groupBy("code").agg(F.count("*").alias("n")), "code")
        placed = kept(known.select("qn", "side", "code", "n", F.row_number().over(place).alias("place"), F.count("*").over(Window.partitionBy("qn")).alias("terms"), F.sum("n").over(place.rowsBetween(Window.unboundedPreceding, -1)).alias("walked")), "placed")

        def best(pairs: DataFrame) -> DataFrame:
            """The best m of scored pairs for each anchor."""
            named = pairs.join(own.select("qn", "q", "excluded"), "qn").join(rows.select("rn", "id", "ord"), "rn").filter(~F.array_contains("excluded", F.col("id")))
            rank = F.row_number().over(Window.partitionBy("qn").orderBy(F.desc("score"), "ord"))
            return named.select("qn", "q", "id", "ord", "score").withColumn("rank", rank).filter(F.col("rank") <= m)

        rare = placed.filter(F.coalesce("walked", F.lit(0)) < FIRST_POSTINGS).join(lists, "code").filter(F.col("side").isNull() | ~F.col("side").eqNullSafe(F.col("of")))
        near = F.row_number().over(Window.partitionBy("qn").orderBy(F.desc("shared"), "rn"))
        tried = rare.groupBy("qn", "rn").agg(F.count("*").alias("shared")).withColumn("r", near).filter(F.col("r") <= 2 * m).select("qn", "rn")
        both = tried.join(own.select("qn", F.col("terms").alias("asked")), "qn").join(rows.select("rn", "terms"), "rn")
        bound = best(both.select("qn", "rn", F.size(F.array_intersect("asked", "terms")).alias("score"))).filter(F.col("rank") == m).select("qn", F.col("score").alias("least"))
        left = F.floor(F.coalesce("least", F.lit(0)) / 2)
        bounded = kept(placed.join(bound, "qn", "left").select("qn", "code", "side", (F.coalesce("least", F.lit(1)) - left).cast("long").alias("need"), (F.col("place") > F.col("terms") - left).alias("late")), "bounds")
        return kept(best(_sharing(bounded, lists)).drop("qn"), "overlaps", outlives=True)


def related_candidates(hits: DataFrame, records: DataFrame, m: int = M) -> DataFrame:
    """(query_id, hit_rank, hit_id, id, overlap, cand_rank): opposite-side records that are no hits of the query themselves.

    ``hits``: (query_id, rank, id, query, text, source_type) of a stated set of queries, and those of :data:`ANCHOR_FIELDS` that they have; ``records``: corpus rows.
    """
    listed = hits.withColumn("all_ids", F.collect_list("id").over(Window.partitionBy("query_id")))
    anchors = listed.select(
        "query_id", "rank", "id", anchor_terms(F.col("query"), F.col("text"), *[F.col(c) for c in ANCHOR_FIELDS if c in hits.columns]).alias("terms"), F.col("all_ids").alias("excluded"),
        F.when(is_knowledge(), "k").when(F.col("source_type") == "code", "c").alias("side"),
    )
    numbered = anchors.withColumn("q", F.struct("query_id", "rank", "id"))
    own = records.select("id", "ord", record_terms(F.col("text"), F.col("kind"), F.col("file_path"), F.col("source_type"), F.col("status")).alias("terms"), F.when(is_knowledge(), "k").when(F.col("source_type") == "code", "c").alias("side"))
    found = overlaps(numbered, own.filter("side is not null"), m)
    return found.select("q.query_id", F.col("q.rank").alias("hit_rank"), F.col("q.id").alias("hit_id"), "id", F.col("score").cast("int").alias("overlap"), F.col("rank").alias("cand_rank"))


def relations(candidates: DataFrame, m: int = M) -> DataFrame:
    """The first ``2 m`` (hit, candidate) pairs of each query, in hit order."""
    n = F.row_number().over(Window.partitionBy("query_id").orderBy("hit_rank", "cand_rank"))
    return candidates.withColumn("n", n).filter(F.col("n") <= 2 * m)


def shared_terms(pairs: DataFrame, anchors: DataFrame, records: DataFrame, n: int = 8) -> DataFrame:
    """Add ``terms``: the first ``n`` shared terms, sorted. anchors: (query_id, hit_id, anchor); records: (id, own)."""
    return pairs.join(anchors, ["query_id", "hit_id"]).join(records, "id").withColumn("terms", F.slice(F.array_sort(F.array_intersect("anchor", "own")), 1, n)).drop("anchor", "own")


def evidence(candidates: DataFrame, records: DataFrame, m: int = M) -> DataFrame:
    """(query_id, side, pos, id, overlap): related records of each side, first seen first, ``m`` of each."""
    first = F.row_number().over(Window.partitionBy("query_id", "id").orderBy("hit_rank", "cand_rank"))
    once = candidates.withColumn("n", first).filter("n = 1").join(records.select("id", "source_type"), "id").withColumn("side", F.when(is_knowledge(), "knowledge").otherwise("code"))
    pos = F.row_number().over(Window.partitionBy("query_id", "side").orderBy("hit_rank", "cand_rank"))
    return once.withColumn("pos", pos).filter(F.col("pos") <= m).select("query_id", "side", "pos", "id", "overlap")
