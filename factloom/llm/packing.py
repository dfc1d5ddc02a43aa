"""Best-fit packing of documents into training sequences, with conflicts.

A sequence (bin) holds at most ``capacity`` words; a longer document is cut into full sequences and a rest. No two pieces of one
source, and no two of one duplicate cluster, share a bin: every bin carries a bitmap of the sources and clusters that it has.
Open bins are ordered by residual room. A piece goes to the tightest bin that has room and no conflict; the search starts at
the piece's size and goes on to the next larger residual until it finds one. Inner nodes of the order hold the AND of the
bitmaps below, so ranges in which every bin has the piece's source or cluster are passed over at once.

Pieces are dealt to shards by a hash of their document and each shard is packed by itself, longest first; the number of shards
follows the corpus, so no task holds more than about ``shard_rows`` pieces or their words. Only ids, sizes, sources and cluster
keys are moved, never texts.

Cases: a document without words (or with a null text) gets one row with no bin; a null source or cluster conflicts with
nothing; repeated rows are packed each; ties go by doc_id, piece, source and cluster; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, keep, scratch, table

CAPACITY = 2048
SHARD_ROWS, SHARD_WORDS = 10_000, 8_000_000
#: Bit 0 is set only where there is no bin; every search asks for it, and so passes over empty ranges.
_NONE = -1


class Bins:
    """Open bins of one shard, ordered by residual room."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.tree = [_NONE] * (2 * self.leaves)
        self.at = [[] for _ in range(capacity + 1)]
        self.mask: list[int] = []
        self.capacity = capacity

    def _refresh(self, room: int) -> None:
        bits = _NONE
        for b in self.at[room]:
            bits &= self.mask[b]
        node = room + self.leaves
        while node and self.tree[node] != bits:
            self.tree[node] = bits
            node >>= 1
            bits = self.tree[2 * node] & self.tree[2 * node + 1] if node else bits

    def find(self, size: int, bits: int) -> tuple[int, int] | None:
        """(residual, place in its list) of the tightest bin with room for ``size`` and none of ``bits``."""
        stack = [(1, 0, self.leaves)]
        while stack:
            node, low, span = stack.pop()
            if low + span <= size or self.tree[node] & bits:
                continue
            if span == 1:
                for place, b in enumerate(self.at[low]):
                    if not self.mask[b] & bits:
                        return low, place
                continue
            half = span // 2
            stack += ((2 * node + 1, low + half, half), (2 * node, low, half))
        return None

    def put(self, size: int, bits: int) -> tuple[int, int]:
        """Place a piece; its bin and where it starts there."""
        found = self.find(size, bits | 1) if size < self.capacity else None
        if found is None:
            b, room = len(self.mask), self.capacity
            self.mask.append(bits)
        else:
            room, place = found
            own = self.at[room]
            b = own[place]
            own[place] = own[-1]
            own.pop()
            self.mask[b] |= bits
            self._refresh(room)
        left = room - size
        if left:
            self.at[left].append(b)
            self._refresh(left)
        return b, self.capacity - room


def pack_shard(n_words: list[int], groups: list[np.ndarray], capacity: int) -> tuple[list[int], list[int]]:
    """Pack pieces in their order: the bin of each (from 0) and where it starts there. Pieces of a full sequence get bins of their own.

    ``groups``: for sources and for clusters the number of each piece's group, -1 for none.
    """
    bits, used = [0] * len(n_words), 1
    for codes in groups:
        count = np.bincount(codes[codes >= 0]) if (codes >= 0).any() else np.zeros(0, np.int64)
        bit_of = np.cumsum(count > 1) - 1  # groups of one piece need no bit
        for row in np.flatnonzero(codes >= 0).tolist():
            if count[codes[row]] > 1:
                bits[row] |= 1 << used + int(bit_of[codes[row]])
        used += int((count > 1).sum())
    bins = Bins(capacity)
    placed = [bins.put(size, b) for size, b in zip(n_words, bits)]
    return [p[0] for p in placed], [p[1] for p in placed]


def pack(sizes: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Pack documents given as (doc_id, n_words, source, cluster): (doc_id, piece, start_word, n_words, bin_id, bin_start)."""
    with scratch():
        return keep(_packed(sizes, capacity), "packed")


def _packed(sizes: DataFrame, capacity: int) -> DataFrame:
    sizes = cut(sizes.select("doc_id", "n_words", "source", "cluster"), "sizes")
    pieces = F.greatest(F.lit(1), F.ceil(F.col("n_words") / capacity))
    total = sizes.agg(F.coalesce(F.sum(pieces), F.lit(0)), F.coalesce(F.sum("n_words"), F.lit(0))).first()
    shards = max(1, -(-total[0] // SHARD_ROWS), -(-total[1] // SHARD_WORDS))
    cut_up = sizes.select("*", F.explode(F.sequence(F.lit(0).cast("long"), pieces - 1)).alias("piece")).select(
        "doc_id", "piece", (F.col("piece") * capacity).alias("start_word"),
        F.least(F.lit(capacity), F.col("n_words") - F.col("piece") * capacity).alias("n_words"), "source", "cluster",
    )
    dealt = cut_up.filter("n_words > 0").withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(shards)))
    kind = sizes.schema["doc_id"].dataType.simpleString()

    def run(key, rows):
        """Ids stay in Arrow, as 64-bit ids beside a null one would become floats elsewhere."""
        import pyarrow as pa

        rows = rows.sort_by([("n_words", "descending"), *((c, "ascending") for c in ("doc_id", "piece", "source", "cluster"))])
        groups = [rows[c].combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False) for c in ("source", "cluster")]
        bins, starts = pack_shard(rows["n_words"].to_pylist(), groups, capacity)
        first = key[0].as_py() << 32
        out = rows.select(["doc_id", "piece", "start_word", "n_words"])
        return out.append_column("bin_id", pa.array([first + b for b in bins], pa.int64())).append_column("bin_start", pa.array(starts, pa.int64()))

    schema = f"doc_id {kind}, piece long, start_word long, n_words long, bin_id long, bin_start long"
    packed = dealt.groupBy("shard").applyInArrow(run, schema)
    empty = cut_up.filter("n_words <= 0").select("doc_id", "piece", "start_word", F.lit(0).cast("long").alias("n_words"), F.lit(None).cast("long").alias("bin_id"), F.lit(None).cast("long").alias("bin_start"))
    return packed.unionByName(empty)


def pack_documents(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Pack whole texts, sized in words between ASCII blanks; texts that are equal but for case are one duplicate cluster."""
    words = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    return pack(docs.select("doc_id", words.alias("n_words"), "source", F.xxhash64(F.lower("text")).alias("cluster")), capacity)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces with their bins."""
    return pack_documents(table(spark, sf_dir, "documents"))
