"""Token ids in a binary format with Re-Pair grammar compression.

Documents are put in ascending doc_id order by a range partitioning and encoded with a public tokenizer; each partition is written
as shards of about ``SHARD_IDS`` ids. Within a shard, frequent pairs of neighbouring ids (never across documents) are replaced by
new symbols, round after round: a round takes the most frequent pairs of which no two can overlap. The grammar ends once no pair
occurs ``MIN_COUNT`` times in its shard, or ``LIMIT`` rules are made (with 16-bit symbols: once these are used up, after about
16,000 rules for a vocabulary of 49,408). A shard row holds

* ``part, seq``: its place; ``first_new``: its first new symbol; ``n_docs, n_ids``; ``doc_ids``, ``n_tokens`` and ``symbol_ends`` of its documents,
* ``rules``: the two symbols of each new symbol, ``lengths``: how many ids each new symbol stands for (random access),
* ``sequence``: the shard's symbols. Numbers are little-endian; symbols have 16 bits where ids and rules fit, else 32.

Encoding goes word by word: the tokenizer never joins across ASCII blanks, so distinct words are encoded once per worker and
kept in a bounded cache. The names of its added tokens in a text give those tokens, as in the tokenizer's own encoding. Its file is
read by the driver and broadcast (a few MB). Cases: a null or empty text has only its end id; a null doc_id sorts first; rows of one doc_id are
ordered by a hash of their text; other columns are ignored; an empty table gives no shards.
"""

from __future__ import annotations

import hashlib
import sys
import types
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import keep, table

END_ID = 1
SHARD_IDS = 1 << 21
ROUND_RULES, MIN_COUNT, LIMIT = 2000, 16, 1 << 16
#: Distinct words that a worker keeps encoded.
CACHE_WORDS = 1_000_000
#: Words that are given to the tokenizer in one text, and told apart by their offsets.
_JOINED = 256
_SHARD = "part int, seq int, first_new int, n_docs long, n_ids long, doc_ids array<{kind}>, n_tokens array<long>, symbol_ends array<long>, rules binary, lengths binary, sequence binary"


def replace_pairs(seq: np.ndarray, last: np.ndarray, first_new: int, limit: int):
    """Re-Pair: (symbols, last, rules). ``last`` marks the last symbol of each document; at most ``limit`` rules."""
    seq, rules = seq.astype(np.uint32), []
    bits = 16 if first_new + limit <= 1 << 16 else 32
    wide = np.uint32 if bits == 16 else np.uint64
    while True:
        inner = ~last[:-1]
        code = (seq[:-1].astype(wide, copy=False) << wide(bits)) | seq[1:]
        values, count = _frequent(code[inner])
        order = np.lexsort((values, -count))
        chosen, role = [], {}
        for value in values[order].tolist():
            if len(chosen) >= min(ROUND_RULES, limit - len(rules)):
                break
            left, right = value >> bits, value & ((1 << bits) - 1)
            if left == right:
                if left in role:
                    continue
                role[left] = "both"
            elif role.setdefault(left, "left") != "left" or role.setdefault(right, "right") != "right":
                continue
            chosen.append((left, right))
        if not chosen:
            break
        # a small table by left and right symbol gives each pair's rule; 0 is for no left, no right, no rule
        pairs = np.array(chosen)
        left_at, right_at = np.zeros((2, first_new + limit), np.int32)
        lefts, rights = np.unique(pairs[:, 0]), np.unique(pairs[:, 1])
        left_at[lefts], right_at[rights] = np.arange(1, len(lefts) + 1), np.arange(1, len(rights) + 1)
        rule_of = np.zeros((len(lefts) + 1, len(rights) + 1), np.int32)
        rule_of[left_at[pairs[:, 0]], right_at[pairs[:, 1]]] = np.arange(1, len(pairs) + 1)
        at = np.flatnonzero((left_at[seq[:-1]] > 0) & inner)
        near = rule_of[left_at[seq[at]], right_at[seq[at + 1]]]
        hit = near > 0
        at, near = at[hit], near[hit] - 1
        if len(at):  # of overlapping hits, which only a pair of equal symbols has, every second one counts
            begins = np.concatenate(([True], np.diff(at) > 1))
            run = at[begins][np.cumsum(begins) - 1]
            use = (at - run) % 2 == 0
            at, near = at[use], near[use]
        seq[at] = first_new + len(rules) + near
        last = last.copy()
        last[at] |= last[at + 1]
        keep = np.ones(len(seq), bool)
        keep[at + 1] = False
        seq, last = seq[keep], last[keep]
        rules += chosen
    return seq, last, np.array(rules, np.uint32).reshape(-1, 2)


def _frequent(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The codes that occur MIN_COUNT times or more, ascending, and how often."""
    code.sort()
    again = code[: len(code) - MIN_COUNT + 1] == code[MIN_COUNT - 1 :] if len(code) >= MIN_COUNT else np.empty(0, bool)
    values = np.unique(code[: len(again)][again])
    return values, np.searchsorted(code, values, "right") - np.searchsorted(code, values)


def rule_lengths(rules: np.ndarray, first_new: int) -> np.ndarray:
    """How many ids each new symbol stands for."""
    out: list[int] = []
    size = lambda s: 1 if s < first_new else out[s - first_new]
    for left, right in rules.tolist():
        out.append(size(left) + size(right))
    return np.array(out, np.uint32)


def expand(symbols: np.ndarray, rules: np.ndarray, first_new: int) -> np.ndarray:
    """The ids that symbols stand for; only rules that these need are looked at."""
    while (new := symbols >= first_new).any():
        size = 1 + new
        at = (np.cumsum(size) - size)[new]
        pair = rules[symbols[new] - first_new]
        symbols = np.repeat(symbols, size)
        symbols[at], symbols[at + 1] = pair[:, 0], pair[:, 1]
    return symbols.astype(np.uint32)


def expand_all(symbols: np.ndarray, rules: np.ndarray, lengths: np.ndarray, first_new: int) -> np.ndarray:
    """:func:`expand` for whole shards: every rule is unfolded once, and its ids are copied to where it occurs."""
    ends = np.cumsum(lengths.astype(np.int64))
    flat = np.empty(first_new + int(lengths.sum()), np.uint32)
    flat[:first_new] = np.arange(first_new)
    start = np.concatenate((np.arange(first_new), first_new + ends - lengths)).astype(np.int64)
    size = np.concatenate((np.ones(first_new, np.int64), lengths.astype(np.int64)))
    for new, (left, right) in enumerate(rules.tolist(), first_new):
        at, n = start[new], size[left]
        flat[at : at + n] = flat[start[left] : start[left] + n]
        flat[at + n : at + size[new]] = flat[start[right] : start[right] + size[right]]
    n = size[symbols]
    total = int(n.sum())
    return flat[np.repeat(start[symbols] - (np.cumsum(n) - n), n) + np.arange(total)]


def _word_ids(tokenizer_json: str):
    """(tokenizer, first new symbol, cache of words to id bytes); one per worker process, kept between tasks."""
    home = sys.modules.setdefault("_factloom_tokenizers", types.ModuleType("_factloom_tokenizers"))
    name = hashlib.sha256(tokenizer_json.encode()).hexdigest()
    if name not in home.__dict__:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        own = Tokenizer.from_str(tokenizer_json)
        home.__dict__[name] = own, max(own.get_vocab_size(with_added_tokens=True), END_ID + 1), {}
    return home.__dict__[name]


def _split(raw: bytes | None) -> list[bytes]:
    """A text's words, in lower case where that changes no ids.

    The tokenizer composes letters and marks before it lower-cases, and looks for added tokens first; some capitals have no composed
    form with a mark (all marks that compose with ASCII letters begin with the byte CC). Such texts keep their capitals.
    """
    raw = raw or b""
    return raw.split() if b"\xcc" in raw or b"<|" in raw else raw.lower().split()


def encode_texts(texts: list[bytes | None], tokenizer) -> list[np.ndarray]:
    """Ids of each text with the end id, as unsigned 32-bit numbers. ``tokenizer``: what _word_ids gives."""
    own, _, cache = tokenizer
    split = [_split(t) for t in texts]
    found = [list(map(cache.get, words)) for words in split]
    fresh = {w for words, got in zip(split, found) if None in got for w, x in zip(words, got) if x is None}
    if len(cache) + len(fresh) > CACHE_WORDS:
        cache.clear()  # what has been found stays in ``found``
    kind = np.uint16 if own.get_vocab_size() < 1 << 16 else np.uint32
    fresh = sorted(fresh)
    for at in range(0, len(fresh), _JOINED):
        _remember(fresh[at : at + _JOINED], own, kind, cache)
    end = np.array([END_ID], kind).tobytes()
    whole = ([x if x is not None else cache[w] for w, x in zip(words, got)] if None in got else got for words, got in zip(split, found))
    return [np.frombuffer(b"".join(got) + end, kind).astype(np.uint32) for got in whole]


def _remember(words: list[bytes], own, kind, cache: dict[bytes, bytes]) -> None:
    """Encode distinct words, joined by blanks, and keep each one's ids."""
    plain = [w.decode() for w in words]
    found = own.encode(" ".join(plain), add_special_tokens=False)
    ids = np.array(found.ids, kind).tobytes()
    starts = np.cumsum([0, *(len(w) + 1 for w in plain)])
    cuts = np.searchsorted([o[0] for o in found.offsets], starts).tolist()
    size = np.dtype(kind).itemsize
    for word, a, b in zip(words, cuts, cuts[1:]):
        cache[word] = ids[size * a : size * b]


def shard_row(doc_ids: list, ids: list[np.ndarray], first_new: int) -> dict:
    """Compress the documents of one shard."""
    sizes = np.array([len(x) for x in ids])
    last = np.zeros(int(sizes.sum()), bool)
    last[np.cumsum(sizes) - 1] = True
    narrow = first_new < 1 << 16
    limit = (1 << 16) - first_new if narrow else LIMIT
    seq, last, rules = replace_pairs(np.concatenate(ids), last, first_new, limit)
    kind = np.uint16 if narrow else np.uint32
    return {
        "first_new": first_new, "n_docs": len(ids), "n_ids": int(sizes.sum()), "doc_ids": doc_ids, "n_tokens": sizes.tolist(), "symbol_ends": (np.flatnonzero(last) + 1).tolist(),
        "rules": rules.astype(kind).tobytes(), "lengths": rule_lengths(rules, first_new).tobytes(), "sequence": seq.astype(kind).tobytes(),
    }


def encode_corpus(docs: DataFrame, tokenizer_file: str) -> DataFrame:
    """The shards of a corpus, to be written as Parquet; ``tokenizer_file`` is a path on the driver."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = _parse_datatype_string(_SHARD.format(kind=kind))
    with open(tokenizer_file, encoding="utf-8") as file:
        sent = docs.sparkSession.sparkContext.broadcast(file.read())

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part, seq, keys, ids, n = TaskContext.get().partitionId(), 0, [], [], 0
        tokenizer = _word_ids(sent.value)
        first_new = tokenizer[1]

        def row():
            return pa.RecordBatch.from_pylist([{"part": part, "seq": seq} | shard_row(keys, ids, first_new)], schema=to_arrow_schema(schema))

        for b in batches:
            size = 512
            for at in range(0, b.num_rows, size):
                some = b.slice(at, size)
                for key, own in zip(some.column(0).to_pylist(), encode_texts(some.column(1).cast(pa.binary()).to_pylist(), tokenizer)):
                    keys.append(key), ids.append(own)
                    n += len(own)
                    if n >= SHARD_IDS:
                        yield row()
                        seq, keys, ids, n = seq + 1, [], [], 0
        if keys:
            yield row()

    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    return ordered.mapInArrow(run, schema)


def decode_document(row, index: int, start: int = 0, stop: int | None = None) -> np.ndarray:
    """Random access: ids [start, stop) of one document of a shard row, expanding only the symbols that reach into the range."""
    kind = np.uint16 if row["first_new"] < 1 << 16 else np.uint32
    rules, lengths = np.frombuffer(row["rules"], kind).reshape(-1, 2), np.frombuffer(row["lengths"], np.uint32)
    begin = row["symbol_ends"][index - 1] if index else 0
    symbols = np.frombuffer(row["sequence"], kind)[begin : row["symbol_ends"][index]].astype(np.int64)
    size = np.where(symbols < row["first_new"], 1, np.append(lengths, 1)[np.maximum(symbols - row["first_new"], 0)])
    ends = np.cumsum(size)
    stop = int(ends[-1]) if stop is None else min(stop, int(ends[-1]))
    a, b = np.searchsorted(ends, start, "right"), np.searchsorted(ends, stop, "left") + 1
    skipped = int(ends[a - 1]) if a else 0
    return expand(symbols[a:b], rules, row["first_new"])[start - skipped : stop - skipped]


def read_corpus(shards: DataFrame) -> DataFrame:
    """(doc_id, part, seq, local_start, n_tokens, ids_crc32, n_symbols): every document decoded from its shard."""
    kind = shards.schema["doc_ids"].dataType.elementType.simpleString()

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for row in b.to_pylist():
                first_new = row["first_new"]
                number = np.uint16 if first_new < 1 << 16 else np.uint32
                rules, lengths = np.frombuffer(row["rules"], number).reshape(-1, 2), np.frombuffer(row["lengths"], np.uint32)
                ids = expand_all(np.frombuffer(row["sequence"], number).astype(np.int64), rules, lengths, first_new).astype("<u4")
                starts = np.concatenate(([0], np.cumsum(row["n_tokens"])[:-1])).astype(np.int64)
                ends = np.cumsum(row["n_tokens"])
                view = memoryview(ids.tobytes())
                crc = [zlib.crc32(view[4 * s : 4 * e]) for s, e in zip(starts.tolist(), ends.tolist())]
                n = len(crc)
                symbols = np.diff(np.concatenate(([0], row["symbol_ends"])))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_ids"], b.schema.field("doc_ids").type.value_type), pa.array([row["part"]] * n, pa.int32()), pa.array([row["seq"]] * n, pa.int32()), pa.array(starts), pa.array(row["n_tokens"], pa.int64()), pa.array(crc, pa.int64()), pa.array(symbols.astype(np.int64))],
                    names=["doc_id", "part", "seq", "local_start", "n_tokens", "ids_crc32", "n_symbols"],
                )

    return shards.mapInArrow(run, f"doc_id {kind}, part int, seq int, local_start long, n_tokens long, ids_crc32 long, n_symbols long")


def shard_starts(shards: DataFrame) -> DataFrame:
    """(part, seq, start): ids before each shard. Sums within partitions and over partitions, so no task sees all shards."""
    sizes = shards.select("part", "seq", "n_ids")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.withColumn("own", F.coalesce(F.sum("n_ids").over(within), F.lit(0))).join(parts, "part").select("part", "seq", (F.col("base") + F.col("own")).alias("shard_start"))


def op4_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place and checksum, read back from the written shards."""
    import public_tokenizers

    tokenizer_file = public_tokenizers.path("word_bpe_49k.json")
    shards = keep(encode_corpus(table(spark, sf_dir, "documents"), tokenizer_file), "token-shards")
    return read_corpus(shards).join(shard_starts(shards), ["part", "seq"]).select(
        "doc_id", (F.col("shard_start") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32", "n_symbols"
    )
