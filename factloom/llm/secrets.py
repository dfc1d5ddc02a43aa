"""Secret scans: three base patterns, and character Markov models of random strings and ordinary identifiers.

The labelled samples are the corpus's own: values of base matches are random strings, all other runs of the secret alphabet are
ordinary. Documents whose text's CRC-32 is 0 modulo ``HOLDOUT`` are held out; character pairs of both classes are counted over all
others (a table of at most 2 x 68 x 68 rows). As labelled secrets of one corpus are often of one kind, the model of random strings
is half what it learned and half uniform over the alphabet. Every run, of any length, is scored by the log-likelihood ratio of the
two models. Its threshold is ``LEAST_RATIO`` (a secret among a million runs), or the least one that at most ``FALSE_SHARE`` of the
held-out ordinary runs exceed, if that is higher; but held-out secrets have a say: as ordinary runs hold secrets without a label
too, the threshold goes up no further than ``RECALL`` of the labelled ones allow. What reaches it becomes a span of kind ``model``;
base spans always stay. :func:`calibrate` reports the share of held-out secrets that are found.

Cases: a null text is empty; an empty text has no spans; corpora without any base match have a uniform model of random strings;
repeated rows are scanned one by one; very long texts are scanned whole; a column named ``secrets`` is replaced, others stay; an
empty table gives no rows; positions are code points.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import add_struct, table

KINDS = ("assign", "access", "hex", "model")
#: One of so many documents is held out; the shares of held-out ordinary runs and of held-out secrets that may and must reach the
#: threshold; nats that a secret needs in any case.
HOLDOUT, FALSE_SHARE, RECALL, LEAST_RATIO = 5, 1e-5, 0.95, 14.0
_TOP = 1000  # scores are counted by whole nats up to this one
FIELDS = "n_assign long, n_access long, n_hex long, n_model long, base string, spans string"

_ASSIGN = re.compile(rb"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_WORDS = (b"password", b"passwd", b"secret", b"token", b"api_key", b"apikey")
_ALPHABET = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
_N = len(_ALPHABET) + 1  # and the start
_SYMBOL = np.full(256, _N - 1, np.uint16)
_SYMBOL[list(_ALPHABET)] = np.arange(_N - 1)
_IN = np.zeros(256, np.int8)
_IN[list(_ALPHABET)] = 1
_HEX = np.zeros(256, np.int8)
_HEX[list(b"0123456789abcdef")] = 1
_CONTINUED = bytes(range(0x80, 0xC0))


def _runs(mask: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of ones that are long enough."""
    step = np.diff(np.concatenate(([0], mask, [0])).astype(np.int8))
    start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    long = end - start >= least
    return start[long], end[long]


def base_spans(raw: bytes) -> list[tuple[int, int, int, int, int]]:
    """(start, kind, end, value start, value end) in bytes, by start and kind."""
    out = []
    low = raw.lower()
    if any(w in low for w in _WORDS):
        out += [(m.start(), 0, m.end(), m.start(1), m.end(1)) for m in _ASSIGN.finditer(raw) if m.end(1) - m.start(1) >= 12]
    if b"AKIA" in raw:
        out += [(m.start(), 1, m.end(), m.start(), m.end()) for m in _ACCESS.finditer(raw) if m.end() - m.start() >= 18]
    start, end = _runs(_HEX[np.frombuffer(raw, np.uint8)], 16)
    out += [(s, 2, e, s, e) for s, e in zip(start.tolist(), end.tolist())]
    return sorted(out)


def _ordinary(raw: bytes, spans) -> tuple[np.ndarray, np.ndarray]:
    """The text as bytes, and where it has the secret alphabet outside base spans."""
    own = np.frombuffer(raw, np.uint8)
    mask = _IN[own]
    for s, _, e, *_ in spans:
        mask[s:e] = 0
    return own, mask


def _pairs(symbols: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the character pairs of runs, and where each run's codes begin; a run's first character follows the start symbol."""
    size = end - start
    begins = np.cumsum(size) - size
    at = np.repeat(start - begins, size) + np.arange(size.sum())
    before = symbols[np.maximum(at - 1, 0)].astype(np.int64)
    before[begins] = _N - 1
    return before * _N + symbols[at], begins


def _samples(raw: bytes):
    """(symbols, starts, ends) of a text's ordinary runs and of its labelled secrets."""
    spans = base_spans(raw)
    own, mask = _ordinary(raw, spans)
    secret = np.array([(s, e) for _, _, _, s, e in spans], np.int64).reshape(-1, 2)
    return _SYMBOL[own], (_runs(mask, 1), (secret[:, 0], secret[:, 1]))


def _held_out(raw: bytes) -> bool:
    return zlib.crc32(raw) % HOLDOUT == 0


def _table(total: np.ndarray):
    """The non-zero counts by (kind, code)."""
    import pyarrow as pa

    kind, code = np.nonzero(total)
    return pa.RecordBatch.from_arrays([pa.array(kind, pa.int64()), pa.array(code, pa.int64()), pa.array(total[kind, code], pa.int64())], names=["kind", "code", "n"])


def _added(docs: DataFrame, count, size: int) -> np.ndarray:
    """Sums of what ``count(raw, total)`` adds for each text; every partition sends one bounded table."""
    import pyarrow as pa

    def run(batches):
        total = np.zeros((2, size), np.int64)
        for b in batches:
            for raw in b.column(0).cast(pa.binary()):
                if raw.as_py():
                    count(raw.as_py(), total)
        yield _table(total)

    out = np.zeros((2, size), np.int64)
    for kind, code, n in docs.select("text").mapInArrow(run, "kind long, code long, n long").groupBy("kind", "code").agg(F.sum("n")).collect():
        out[kind, code] = n
    return out


def log_ratios(counts: np.ndarray, weight: float = 5.0) -> np.ndarray:
    """Log ratio of the two models' transition probabilities (random over ordinary).

    Every transition gives up one count, so that a secret nobody labelled cannot vouch for itself; these counts and ``weight`` more are
    dealt out by each model's own frequencies of characters, to which half a count is added. Half of the random model is uniform.
    """
    pairs = counts.reshape(2, _N, _N).astype(float)
    chars = pairs.sum(axis=1) + 0.5
    chars /= chars.sum(axis=1, keepdims=True)
    total, kept = pairs.sum(axis=2, keepdims=True), np.maximum(pairs - 1, 0)
    spare = total - kept.sum(axis=2, keepdims=True) + weight
    shares = (kept + spare * chars[:, None, :]) / (total + weight)
    return (np.log((shares[1] + 1 / (_N - 1)) / 2) - np.log(shares[0])).ravel()


def train(docs: DataFrame) -> np.ndarray:
    """The log ratios, from all documents that are not held out."""

    def count(raw, total):
        if not _held_out(raw):
            symbols, classes = _samples(raw)
            for kind, (start, end) in enumerate(classes):
                total[kind] += np.bincount(_pairs(symbols, start, end)[0], minlength=_N * _N)

    return log_ratios(_added(docs, count, _N * _N))


def _scores(symbols: np.ndarray, start: np.ndarray, end: np.ndarray, ratios: np.ndarray) -> np.ndarray:
    """The log-likelihood ratio of each run."""
    if not len(start):
        return np.zeros(0)
    codes, begins = _pairs(symbols, start, end)
    return np.add.reduceat(ratios[codes], begins)


def calibrate(docs: DataFrame, ratios: np.ndarray) -> tuple[float, float]:
    """(threshold, share of held-out labelled secrets above it; nan without any), from the documents that are held out."""

    def count(raw, total):
        if _held_out(raw):
            symbols, classes = _samples(raw)
            for kind, (start, end) in enumerate(classes):
                total[kind] += np.bincount(np.clip(np.floor(_scores(symbols, start, end, ratios)), 0, _TOP - 1).astype(np.int64), minlength=_TOP)

    ordinary, secret = _added(docs, count, _TOP)
    above, found = (np.append(x[::-1].cumsum()[::-1], 0) for x in (ordinary, secret))  # runs with at least so many nats
    threshold = int(np.argmax(above <= FALSE_SHARE * above[0]))
    if found[0]:
        threshold = min(threshold, int(np.flatnonzero(found >= RECALL * found[0])[-1]))
    threshold = max(LEAST_RATIO, float(threshold))
    return threshold, float(found[int(threshold)] / found[0]) if found[0] else float("nan")


def scan(raw: bytes | None, ratios: np.ndarray, threshold: float) -> tuple:
    """Counts and spans of one text, in the order of FIELDS."""
    if not raw:
        return 0, 0, 0, 0, "", ""
    base = base_spans(raw)
    found = [(s, kind, e) for s, kind, e, *_ in base]
    own, mask = _ordinary(raw, base)
    start, end = _runs(mask, 1)
    high = _scores(_SYMBOL[own], start, end, ratios) >= threshold
    found += [(s, 3, e) for s, e in zip(start[high].tolist(), end[high].tolist())]
    found.sort()
    at, chars, placed = 0, 0, {}
    for edge in sorted({x for s, _, e in found for x in (s, e)}):
        chars += len(raw[at:edge].translate(None, _CONTINUED))
        at = edge
        placed[edge] = chars
    told = [(kind, f"{KINDS[kind]}:{placed[s]}:{placed[e]}") for s, kind, e in found]
    return *(sum(k == kind for k, _ in told) for kind in range(4)), ",".join(x for k, x in told if k < 3), ",".join(x for _, x in told)


def find_secrets(docs: DataFrame, model: tuple[np.ndarray, float] | None = None, keep: list[str] | None = None) -> DataFrame:
    """``docs`` with a struct ``secrets``: counts by kind, base spans and all spans as text. Without a model (ratios, threshold) it trains on ``docs``."""
    if model is None:
        ratios = train(docs)
        model = ratios, calibrate(docs, ratios)[0]
    return add_struct(docs, "secrets", FIELDS, lambda texts: (scan(t, *model) for t in texts), keep=keep)


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document."""
    found = find_secrets(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return found.select("doc_id", "secrets.n_assign", "secrets.n_access", "secrets.n_hex", F.sha2("secrets.base", 256).alias("base_sha256"), "secrets.spans", "secrets.n_model")
