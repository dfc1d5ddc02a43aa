"""A hidden Markov language model, trained by Baum-Welch over all partitions.

Tokens are the lower-cased (A-Z) words between ASCII blanks and one end. The most frequent words are emission symbols of their
own; any other word belongs to the class of its last three bytes, and is drawn within its class by its own smoothed count, with
one share for all unknown words. The model is a proper distribution over texts: P(text) = sum over state paths of
transitions x emissions, times the words' shares in their classes.

Counts come from all training documents (those whose crc32 of doc_id as text is not 0 modulo 10). Documents are turned into
symbols once and kept in the shared folder. Baum-Welch needs a start at which states differ: symbols are clustered by what stands
before and after them (sums of random signs over all training documents, ``DIMS`` for each side), and each state begins with a
preference for one cluster. Every round then adds up expected counts of all training documents over partitions. Long texts are
trained in segments of ``SEGMENT`` tokens, of which later ones start from the previous round's average state. Scores are exact: the
scaled forward recursion runs over each whole text. ``STATES``, ``SYMBOLS`` and ``CLASSES`` fix the size of the latent model, at every
size of the corpus; words beyond the ``SYMBOLS`` most frequent ones have counts of their own, but share their states by class.

Words are joined with their counts by shuffle, but for the ``KNOWN_WORDS`` most frequent ones, which are broadcast.
Cases: a null or empty text has only the end; a null doc_id is held out; rows are scored one by one; other columns are ignored;
an empty table gives no rows; without training documents all counts are 0 and the model is flat.
"""

from __future__ import annotations

import zlib
from collections import Counter
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, keep, scratch, table

STATES, ROUNDS, DIMS, PREFERENCE = 12, 12, 16, 20.0
SYMBOLS, CLASSES, KNOWN_WORDS = 4095, 512, 250_000
SEGMENT, PRIOR = 256, 50.0
#: Symbol 0 is the end; then the frequent words, then the classes.
_FIRST_CLASS = SYMBOLS + 1
ALPHABET = _FIRST_CLASS + CLASSES


def tokens(raw: bytes | None) -> list[bytes]:
    """Lower-cased words, without the end."""
    return raw.lower().split() if raw else []


def held_out(doc_id: str = "doc_id"):
    """Whether a document is kept out of training."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 10 == 0, F.lit(True))


def _class(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % CLASSES


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n): counts over all training documents; partitions add up their own words first."""

    def run(batches):
        import pyarrow as pa

        found: Counter = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], names=["word", "n"])

        for b in batches:
            for raw in b.column(0).cast(pa.binary()):
                found.update(tokens(raw.as_py()))
                if len(found) > 500_000:
                    yield out()
                    found = Counter()
        yield out()

    return docs.filter(~held_out()).select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Vocabulary:
    """What every worker needs: frequent words with counts, class totals, corpus totals. All of bounded size."""

    def __init__(self, counts: DataFrame, train_docs: int):
        level = F.floor(F.log("n") * 50)
        total, distinct, levels = 0, 0, counts.groupBy(level.alias("l")).agg(F.count("*").alias("k"), F.sum("n").alias("s")).collect()
        room, least = KNOWN_WORDS, None
        for row in sorted(levels, reverse=True):
            total, distinct, room = total + row["s"], distinct + row["k"], room - row["k"]
            if room >= 0:
                least = row["l"]
        known = [] if least is None else counts.filter(level >= least).collect()
        known = sorted(((-r["n"], bytes(r["word"])) for r in known))
        self.words = [w for _, w in known]
        self.counts = np.array([-n for n, _ in known] + [0], np.int64)
        self.end_count, self.total, self.distinct = train_docs, total + train_docs, distinct + (train_docs > 0)
        edge = known[min(SYMBOLS, len(known)) - 1] if known else (0, b"")
        rest = counts.filter((F.col("n") < -edge[0]) | ((F.col("n") == -edge[0]) & (F.col("word") > F.lit(bytearray(edge[1]))))) if known else counts
        kind = F.pmod(F.crc32(F.substring("word", -3, 3)), F.lit(CLASSES))
        self.class_n, self.class_v = np.zeros(CLASSES), np.zeros(CLASSES)
        for row in rest.groupBy(kind.alias("c")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():
            self.class_n[row["c"]], self.class_v[row["c"]] = row["n"], row["v"]
        self.symbol = np.array([i + 1 if i < SYMBOLS else _FIRST_CLASS + _class(w) for i, w in enumerate(self.words)] + [0], np.int64)
        self.index = None

    def lookup(self) -> dict[bytes, int]:
        """Word to place; built once in each task."""
        if self.index is None:
            self.index = dict(zip(self.words, range(len(self.words))))
        return self.index

    def base_log(self, count):
        """log10 of a token's smoothed share."""
        return np.log10((count + 0.1) / (self.total + 0.1 * (self.distinct + 1)))

    def class_log(self, count, kind):
        """log10 of a word's share in its class."""
        return np.log10((count + 0.1) / (self.class_n[kind] + 0.1 * (self.class_v[kind] + 1)))

    def unigram(self) -> np.ndarray:
        """Smoothed shares of the symbols."""
        n = np.full(ALPHABET, 0.1)
        n[0] += self.end_count
        top = min(SYMBOLS, len(self.words))
        n[1 : 1 + top] += self.counts[:top]
        n[_FIRST_CLASS:] += self.class_n
        return n / n.sum()


def encoded(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Each document as symbols, with sums over its frequent words and a list of its other words."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"uid long, doc_id {kind}, held_out boolean, n_tokens long, n_known long, base double, within double, rare array<binary>, symbols binary"

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        v, uid = sent.value, TaskContext.get().partitionId() << 36
        index = v.lookup()
        logs = v.base_log(v.counts)
        inner = np.where(v.symbol >= _FIRST_CLASS, v.class_log(v.counts, np.maximum(v.symbol - _FIRST_CLASS, 0)), 0.0)
        end = v.base_log(v.end_count)
        for b in batches:
            rows = []
            for raw in b.column(2).cast(pa.binary()):
                words = tokens(raw.as_py())
                at = np.fromiter(map(index.get, words, repeat(-1)), np.int64, len(words))
                rare_at = np.flatnonzero(at < 0).tolist()
                rare = [words[i] for i in rare_at]
                symbols = np.append(v.symbol[at], 0)
                symbols[rare_at] = [_FIRST_CLASS + _class(w) for w in rare]
                known = at[at >= 0]
                rows.append((uid, len(words) + 1, len(known) + (v.end_count > 0), float(logs[known].sum() + end), float(inner[known].sum()), rare, symbols.astype("<u2").tobytes()))
                uid += 1
            c = list(zip(*rows)) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays(
                [pa.array(c[0], pa.int64()), b.column(0), b.column(1), pa.array(c[1], pa.int64()), pa.array(c[2], pa.int64()), pa.array(c[3], pa.float64()), pa.array(c[4], pa.float64()), pa.array(c[5], pa.list_(pa.binary())), pa.array(c[6], pa.binary())],
                names=["uid", "doc_id", "held_out", "n_tokens", "n_known", "base", "within", "rare", "symbols"],
            )

    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(run, schema)


class Model:
    """Start, transition and emission probabilities, and the average state."""

    def __init__(self, start, move, emit, mean):
        self.start, self.move, self.emit, self.mean = start, move, emit, mean

    @staticmethod
    def initial(unigram: np.ndarray, cluster: np.ndarray) -> Model:
        """The unigram model in every state, with a preference for the symbols of one cluster."""
        emit = unigram * np.where(cluster == np.arange(STATES)[:, None], PREFERENCE, 1.0)
        flat = np.full(STATES, 1.0 / STATES)
        return Model(flat, 0.3 * np.eye(STATES) + 0.7 * flat, emit / emit.sum(axis=1, keepdims=True), flat)

    @staticmethod
    def from_counts(counts: np.ndarray, unigram: np.ndarray) -> Model:
        """The M step. counts: a row for each state: its start count, its moves, its emissions."""
        start, move, emit = counts[:, 0] + 0.5, counts[:, 1 : 1 + STATES] + 0.5, counts[:, 1 + STATES :]
        mean = emit.sum(axis=1) + 1e-9
        emit = emit + PRIOR * unigram
        return Model(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=1, keepdims=True), mean / mean.sum())


def segments(texts: list[np.ndarray]):
    """Where rows of up to SEGMENT symbols begin in the joined texts, their lengths, and whether a row begins its text; longer rows first."""
    sizes = np.array([len(x) for x in texts], np.int64)
    rows = -(-sizes // SEGMENT)
    place = np.arange(int(rows.sum())) - np.repeat(np.cumsum(rows) - rows, rows)
    begin = np.repeat(np.cumsum(sizes) - sizes, rows) + place * SEGMENT
    size = np.minimum(np.repeat(sizes, rows) - place * SEGMENT, SEGMENT)
    order = np.argsort(-size, kind="stable")
    return begin[order], size[order], (place == 0)[order]


def _by_step(begin: np.ndarray, size: np.ndarray, symbols: np.ndarray):
    """Symbols of all rows step after step, and the slice of each step; rows are ordered by length, so a step's rows are the first ones."""
    steps = int(size[0]) if len(size) else 0
    active = np.searchsorted(-size, -np.arange(steps), "left").tolist()  # rows longer than t
    ends = np.cumsum(active).tolist()
    flat = np.concatenate([symbols[begin[:m] + t] for t, m in enumerate(active)]) if steps else symbols[:0]
    return flat, [slice(end - m, end) for end, m in zip(ends, active)], active


def expected_counts(model: Model, texts: list[np.ndarray]) -> np.ndarray:
    """The E step over some texts: expected starts, moves and emissions of every state, by scaled forward and backward passes.

    Arrays have a row for each state, and in it all segments, step after step (see _by_step), as 32-bit numbers. A symbol's emissions
    are divided by their largest, which changes no posterior and keeps numbers in range between the steps that scale, every fourth
    and each segment's last. Sums are in 64 bits.
    """
    begin, size, first = segments(texts)
    out = np.zeros((STATES, 1 + STATES + ALPHABET))
    if not len(begin):
        return out
    flat, rows, active = _by_step(begin, size, np.concatenate(texts))
    emit = np.ascontiguousarray(model.emit / model.emit.max(axis=0), np.float32)
    move, start, mean = (np.asarray(x, np.float32) for x in (model.move, model.start[:, None], model.mean[:, None]))
    turned = np.ascontiguousarray(move.T)
    emits = np.empty((STATES, len(flat)), np.float32)
    for k in range(STATES):
        emit[k].take(flat, out=emits[k], mode="clip")
    forward, scales, now = [], [], np.where(first, start, mean)
    for t, m in enumerate(active):
        now = (now if t == 0 else turned @ now[:, :m]) * emits[:, rows[t]]
        after = active[t + 1] if t + 1 < len(active) else 0
        done = 0 if t % 4 == 3 else after  # rows from there on are scaled
        scale = now[:, done:].sum(axis=0)
        now[:, done:] /= scale
        forward.append(now), scales.append((done, scale))
    moves, back, post = np.zeros((STATES, STATES)), np.ones((STATES, active[-1]), np.float32), np.empty((STATES, len(flat)), np.float32)
    for t in range(len(active) - 1, -1, -1):
        np.multiply(forward[t], back, out=post[:, rows[t]])
        if t == 0:
            break
        done, scale = scales[t]
        ahead = emits[:, rows[t]] * back
        ahead[:, done:] /= scale
        moves += forward[t - 1][:, : active[t]] @ ahead.T
        back = np.ones((STATES, active[t - 1]), np.float32)
        np.matmul(move, ahead, out=back[:, : active[t]])
    out[:, 0] = post[:, rows[0]][:, first].sum(axis=1, dtype=np.float64)
    out[:, 1 : 1 + STATES] = model.move * moves
    for k in range(STATES):
        out[k, 1 + STATES :] = np.bincount(flat, post[k], ALPHABET)
    return out


def log10_likelihoods(model: Model, texts: list[np.ndarray]) -> np.ndarray:
    """Exact log10 probability of each symbol sequence, by the forward recursion, scaled at every fourth symbol and at the last one."""
    size = np.array([len(x) for x in texts], np.int64)
    order = np.argsort(-size, kind="stable")
    begin, size = (np.cumsum(size) - size)[order], size[order]
    symbols, total = np.concatenate(texts) if len(texts) else np.empty(0, np.int64), np.zeros(len(texts))
    active = np.searchsorted(-size, -np.arange(int(size[0]) if len(texts) else 0), "left").tolist()
    emit_of, ones, a = np.ascontiguousarray(model.emit.T), np.ones(STATES), None
    for t, (m, after) in enumerate(zip(active, [*active[1:], 0])):
        a = (model.start if t == 0 else a[:m] @ model.move) * emit_of.take(symbols[begin[:m] + t], axis=0)
        done = 0 if t % 4 == 3 else after  # texts from there on are scaled
        if done < m:
            scale = a[done:] @ ones
            total[done:m] += np.log10(scale)
            a[done:] /= scale[:, None]
    out = np.empty(len(texts))
    out[order] = total
    return out


def _texts(column) -> list[np.ndarray]:
    """The symbols of each row of a binary column, as parts of one array."""
    if not len(column):
        return []
    column = column.cast("large_binary")
    _, ends, data = column.buffers()
    ends = np.frombuffer(ends, np.int64)[column.offset : column.offset + len(column) + 1] // 2
    whole = np.frombuffer(data, "<u2", ends[-1] - ends[0], 2 * ends[0]).astype(np.int64) if ends[-1] > ends[0] else np.empty(0, np.int64)
    ends = (ends - ends[0]).tolist()
    return [whole[a:b] for a, b in zip(ends, ends[1:])]


def neighbour_sums(texts: list[np.ndarray]) -> np.ndarray:
    """For each symbol, sums of the random signs of its next and of its previous symbols; a row for each sign, the last one counts."""
    signs = np.random.default_rng(3).integers(0, 2, (2, ALPHABET, DIMS)) * 2.0 - 1.0
    out = np.zeros((2 * DIMS + 1, ALPHABET))
    if texts:
        flat = np.concatenate(texts)
        inner = np.ones(len(flat), bool)
        inner[np.cumsum([len(x) for x in texts]) - 1] = False
        at = np.flatnonzero(inner)
        left, right = flat[at], flat[at + 1]
        for d in range(DIMS):
            out[d] = np.bincount(left, signs[0, right, d], ALPHABET)
            out[DIMS + d] = np.bincount(right, signs[1, left, d], ALPHABET)
        out[-1] = np.bincount(flat, minlength=ALPHABET)
    return out


def clusters(sums: np.ndarray) -> np.ndarray:
    """A cluster for each symbol, by weighted k-means of its mean signs; rare symbols are drawn towards the middle."""
    count = sums[-1]
    trust = np.sqrt(np.minimum(count, 50) / 50)[:, None]
    points = sums[:-1].T / np.maximum(count, 1)[:, None]
    points = (points - (points * count[:, None]).sum(axis=0) / max(1.0, count.sum())) * trust
    rng, centres = np.random.default_rng(5), [points[int(np.argmax(count))]]
    for _ in range(STATES - 1):
        far = np.min([((points - c) ** 2).sum(axis=1) for c in centres], axis=0) * count
        centres.append(points[rng.choice(len(points), p=far / far.sum()) if far.sum() > 0 else 0])
    centres = np.array(centres)
    for _ in range(25):
        own = np.argmin(np.stack([((points - c) ** 2).sum(axis=1) for c in centres]), axis=0)
        for k in range(STATES):
            weight = count * (own == k)
            if weight.sum() > 0:
                centres[k] = (points * weight[:, None]).sum(axis=0) / weight.sum()
    return own


def baum_welch(symbols: DataFrame, unigram: np.ndarray, rounds: int = ROUNDS) -> Model:
    """Train on a table with a column ``symbols``; the start and every round cover all rows."""
    model = Model.initial(unigram, clusters(_summed(symbols, neighbour_sums, 2 * DIMS + 1, ALPHABET)))
    for _ in range(rounds):
        sent = symbols.sparkSession.sparkContext.broadcast(model)
        model = Model.from_counts(_summed(symbols, lambda texts, sent=sent: expected_counts(sent.value, texts), STATES, 1 + STATES + ALPHABET), unigram)
    return model


def _summed(symbols: DataFrame, count, rows: int, size: int) -> np.ndarray:
    """Sums over all texts of ``count(texts)``, an array of rows x size; partitions send one array for each row, which Spark adds up by place."""

    def run(batches):
        import pyarrow as pa

        total, held, n = np.zeros((rows, size)), [], 0
        for b in batches:
            for own in _texts(b.column(0)):
                held.append(own)
                n += len(own)
                if n > 400_000:
                    total += count(held)
                    held, n = [], 0
        total += count(held)
        yield pa.RecordBatch.from_arrays([pa.array(range(rows), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=["row", "counts"])

    parts = symbols.select("symbols").mapInArrow(run, "row int, counts array<double>")
    out = np.zeros((rows, size))
    for row in parts.select("row", F.posexplode("counts").alias("i", "x")).filter("x <> 0").groupBy("row", "i").agg(F.sum("x").alias("x")).toArrow().to_pylist():
        out[row["row"], row["i"]] = row["x"]
    return out


def score(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score): one row for each row of ``docs``."""
    with scratch():
        return keep(_scored(docs), "scores")


def _scored(docs: DataFrame) -> DataFrame:
    counts = cut(word_counts(docs), "word-counts")
    v = Vocabulary(counts, docs.filter(~held_out()).count())
    rows = cut(encoded(docs, v), "symbols")
    model = baum_welch(rows.filter("not held_out"), v.unigram())
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for at in range(0, b.num_rows, 4096):
                part = b.slice(at, 4096)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(log10_likelihoods(sent.value, _texts(part.column(1))))], names=["uid", "hmm"])

    scored = rows.select("uid", "symbols").mapInArrow(run, "uid long, hmm double")
    kind = F.pmod(F.crc32(F.substring("word", -3, 3)), F.lit(CLASSES)).cast("int")
    shares = F.array(*[F.lit(float(n + 0.1 * (d + 1))) for n, d in zip(v.class_n, v.class_v)])
    n = F.coalesce("n", F.lit(0))
    rare = rows.select("uid", F.explode("rare").alias("word")).join(counts, "word", "left").groupBy("uid").agg(
        F.count("n").alias("rare_known"),
        F.sum(F.log10((n + 0.1) / (v.total + 0.1 * (v.distinct + 1)))).alias("rare_base"),
        F.sum(F.log10((n + 0.1) / F.get(shares, kind))).alias("rare_within"),
    )
    return rows.drop("rare", "symbols").join(scored, "uid").join(rare, "uid", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"), F.lit(v.total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rare_base", F.lit(0.0))).alias("base_score"), (F.col("hmm") + F.col("within") + F.coalesce("rare_within", F.lit(0.0))).alias("score"),
    )


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every document."""
    return score(table(spark, sf_dir, "documents"))
