"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on toxic and one on ordinary text. A text is read in
windows of a few whole words; a window's distance is how many bytes shorter it gets with the
toxic dictionary than with the ordinary one. Windows of different lengths and languages compare,
since both dictionaries end in the same base, trained on ordinary text too.

Compressed lengths of a few words say little, so every byte is written as ``CODE`` fixed
random bytes, in dictionaries and windows alike: then a length counts the phrases that a dictionary
leaves of a window.

Most windows of a toxic text are ordinary. So the toxic dictionary is trained in rounds, crosswise
on two halves of the toxic texts: each half's windows are measured with what the other half taught,
and those that lie beyond nearly all ordinary windows are what the next round trains on. Then come
parts for the texts in which the dictionary so far finds too little.

A text's score is a logistic function of how many of its windows lie beyond each of several
thresholds of the distance, calibrated on labelled texts that no dictionary has seen; 0.5 is its threshold.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, give_back, small_batches

#: At most so many labelled texts of each class are learned from, and so many characters of them.
SAMPLE, SAMPLE_CHARS = 2500, 8_000_000
#: Least bytes of a window; it ends with the word that reaches them, or at twice as many.
WINDOW = 28
#: Bytes of the common base, and of each part of the toxic dictionary.
BASE, PART = 98304, 1024
#: Parts of the toxic dictionary at most, and rounds of training for each.
PARTS, ROUNDS = 6, 2
#: Bytes of the segments that the trainer picks, for the base and for the parts.
BASE_SEGMENT, SEGMENT = 64, 24
CODE = 3
#: A selected window lies beyond this share of the ordinary ones, and a text with two windows beyond the other share needs no further part.
SELECT, ENOUGH = 99.0, 99.9
#: Ordinary windows that thresholds of the training come from.
MEASURED = 10_000
#: Distances beyond count as this.
TOP = 20
#: Thresholds of the distance, in bytes, over which windows are counted.
THRESHOLDS = (3, 6, 9)
#: Windows at a time: repeats are told inside of so many.
BLOCK = 1 << 16
WIDE = np.random.default_rng(7).integers(0, 256, (256, CODE), dtype=np.uint8)
NARROW = {x.tobytes(): i for i, x in enumerate(WIDE)}
PARAMETERS = {"window_log": 20, "chain_log": 20, "hash_log": 17, "search_log": 5, "min_match": 3, "target_length": 6, "strategy": zstandard.STRATEGY_BTOPT, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
#: While the toxic dictionary is trained, matches are looked for longer.
THOROUGH = 32
NO_WORD = re.compile(r"[\W_]+")


def plain(text: str) -> bytes:
    """Lower-case words with single blanks."""
    return f" {NO_WORD.sub(' ', text.lower()).strip()} ".encode("utf-8", "surrogatepass")


def windows(raw: bytes) -> Iterator[bytes]:
    """A plain text, coded, in runs of whole words that share the blank between them; a very long word is cut. Every text has at least one."""
    coded, find, at, last = wide(raw), raw.find, 0, len(raw) - 1
    while True:
        end = find(b" ", at + WINDOW, at + 2 * WINDOW + 1)
        if end < 0:
            end = min(last, at + 2 * WINDOW)
        yield coded[CODE * at : CODE * end + CODE]
        if end >= last:
            return
        at = end


def wide(raw: bytes) -> bytes:
    return WIDE[np.frombuffer(raw, np.uint8)].tobytes()


def narrow(coded: bytes) -> bytes:
    """The text of a coded window."""
    return bytes(map(NARROW.__getitem__, (coded[i : i + CODE] for i in range(0, len(coded), CODE))))


def compressor(content: bytes, target: int | None = None):
    """Compresses coded windows with a dictionary, given uncoded."""
    parameters = zstandard.ZstdCompressionParameters(**PARAMETERS | ({"target_length": target} if target else {}))
    known = zstandard.ZstdCompressionDict(wide(content), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    known.precompute_compress(compression_params=parameters)
    return zstandard.ZstdCompressor(compression_params=parameters, dict_data=known).compress


@dataclass
class Detector:
    """What travels to the tasks: two dictionaries' contents and the calibration."""

    toxic: bytes
    ordinary: bytes
    table: list[float]
    weights: list[float]

    def score(self, text: str) -> float:
        z = float(np.dot(self.weights, _features(histogram(text, *_pair(self.ordinary, self.toxic)), self.table)))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


@lru_cache(maxsize=1)
def _pair(ordinary: bytes, toxic: bytes) -> tuple:
    return compressor(ordinary), compressor(toxic)


def distances(found: Iterable[bytes], long, short) -> np.ndarray:
    """How many bytes shorter each window is with ``short`` than with ``long``."""
    return np.array([len(long(w)) - len(short(w)) for w in found], np.int64)


def histogram(text: str, long, short) -> np.ndarray:
    """How many windows have each distance from -TOP to TOP; the n-fold repeat of a window weighs 1 + log n."""
    total, found = np.zeros(2 * TOP + 1), windows(plain(text))
    while block := Counter(islice(found, BLOCK)):
        places = np.clip(distances(block, long, short), -TOP, TOP) + TOP
        total += np.bincount(places, 1 + np.log(np.fromiter(block.values(), float, len(block))), 2 * TOP + 1)
    return total


def _features(counts: np.ndarray, table: list[float]) -> list[float]:
    """Constant, evidence of all windows and of the toxic ones, the largest distance, the text's length, windows over each threshold.

    All sums as logarithms: with them a text is held against its length, however long it is.
    """
    gain, positive = float(counts @ table), float(counts[TOP + 1 :] @ np.array(table[TOP + 1 :]))
    largest = int(np.flatnonzero(counts)[-1]) - TOP
    return [1.0, math.log1p(max(0.0, gain)), math.log1p(max(0.0, -gain)), math.log1p(positive), largest / TOP, math.log1p(counts.sum()), *(math.log1p(counts[TOP + t :].sum()) for t in THRESHOLDS)]


def _trained(samples: list[bytes], size: int, segment: int) -> bytes:
    """The content of the dictionary that the zstandard trainer makes of the samples."""
    try:
        return zstandard.train_dictionary(size, samples, d=8, k=segment).as_bytes()[-size:]
    except zstandard.ZstdError:  # too few or too short samples for the trainer
        return b"".join(samples)[-size:]


def _toxic_part(texts: list[list[bytes]], known: bytes, long, ordinary: list[bytes]) -> bytes:
    """One part more before the ``known`` content, from the windows of toxic texts that lie beyond nearly all ordinary ones."""
    halves = [list(dict.fromkeys(w for ws in texts[i::2] for w in ws)) for i in (0, 1)]
    picked = halves
    for _ in range(ROUNDS):
        shorts = [compressor(_trained(list(map(narrow, p)), PART, SEGMENT) + known, THOROUGH) for p in picked]
        least = max(1.0, float(np.percentile(distances(ordinary, long, shorts[0]), SELECT)))
        beyond = [[w for w, d in zip(half, distances(half, long, short), strict=True) if d > least] for half, short in zip(halves, reversed(shorts), strict=True)]
        picked = [b or half for b, half in zip(beyond, halves, strict=True)]
    return _trained([narrow(w) for p in picked for w in p], PART, SEGMENT)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(toxic: list[str], ordinary: list[str], prior: float | None = None) -> Detector:
    """Learns from labelled texts; two thirds make the dictionaries, the rest calibrates.

    ``prior`` is the share of toxic texts to calibrate for (that of the texts given, if None). With
    fewer than 6 texts of a class every score is that share (one half where there are no texts).
    """
    share = prior if prior is not None else len(toxic) / max(1, len(toxic) + len(ordinary)) if toxic or ordinary else 0.5
    share = min(1 - 1e-3, max(1e-3, share))
    odds = math.log(share / (1 - share))
    if min(len(toxic), len(ordinary)) < 6:
        return Detector(bytes(8), bytes(8), [0.0] * (2 * TOP + 1), [odds, *[0.0] * (5 + len(THRESHOLDS))])
    bad = [list(windows(plain(t))) for i, t in enumerate(toxic) if i % 3]
    good = [plain(t) for i, t in enumerate(ordinary) if i % 3]
    base = _trained(good[::2], BASE, BASE_SEGMENT)
    rest = list(dict.fromkeys(w for t in good[1::2] for w in windows(t)))
    random.Random(2).shuffle(rest)
    cut = max(1, min(MEASURED, len(rest) // 2))
    measured = rest[:cut]
    own = _trained(list(map(narrow, rest[cut:])), PARTS * PART, SEGMENT) + base
    long, known, left = compressor(own, THOROUGH), base, bad
    for _ in range(PARTS):
        known = _toxic_part(left, known, long, measured) + known
        short = compressor(known, THOROUGH)
        beyond = np.percentile(distances(measured, long, short), ENOUGH)
        left = [ws for ws in left if (distances(list(dict.fromkeys(ws)), long, short) > beyond).sum() < 2]
        if len(left) < 6:
            break
    # Calibration on the texts that no dictionary has seen.
    long, short = compressor(own), compressor(known)
    counts = [np.array([histogram(t, long, short) for i, t in enumerate(c) if i % 3 == 0]) for c in (toxic, ordinary)]
    spread = [c.sum(axis=0) + 0.5 for c in counts]
    table = np.log(spread[0] / spread[0].sum()) - np.log(spread[1] / spread[1].sum())
    # A larger distance is never less evidence, and only a positive one is evidence for toxicity.
    table = np.r_[np.minimum(table[: TOP + 1], 0), np.maximum.accumulate(np.maximum(table[TOP + 1 :], 0))]
    x = np.array([_features(h, table.tolist()) for c in counts for h in c])
    weights = _logistic(x, np.repeat([1.0, 0.0], [len(c) for c in counts]))
    weights[0] += odds - math.log(len(counts[0]) / len(counts[1]))
    return Detector(known, own, table.tolist(), weights.tolist())


def learned_rows(id_col: str = "doc_id") -> Column:
    """Rows that labels may be learned from: crc32 of the id as text is no multiple of five."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 != 0


def train(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", label_col: str = "toxic") -> Detector:
    """Learns from at most ``SAMPLE`` labelled rows of each class outside the held-out fifth.

    The sample is the rows whose ids have the smallest hashes, the same on every run; its texts are
    read whole, in the order of the hashes, and those of over a sixteenth of ``SAMPLE_CHARS`` characters
    after the others. A text that does not fit what is left of ``SAMPLE_CHARS`` is left out and takes
    nothing of it, so long texts do not keep others out. Null labels and ids are not used; an id with
    both labels counts as toxic.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & learned_rows(id_col)).groupBy(F.col(id_col).alias("i")).agg(F.max((F.col(label_col) != 0).cast("int")).alias("y"))
    share = known.agg(F.avg("y")).first()[0]
    first = lambda y: known.where(F.col("y") == y).orderBy(F.xxhash64("i"), "i").limit(SAMPLE)
    picked = F.broadcast(first(0).unionByName(first(1)))
    size = F.char_length("t")
    found = docs.select(F.col(id_col).alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).join(picked, "i").where(size <= SAMPLE_CHARS)
    ranked = found.orderBy(size > SAMPLE_CHARS // 16, F.xxhash64("i"), "i", "t").select("y", "t")
    texts: list[list[str]] = [[], []]
    room = [SAMPLE_CHARS, SAMPLE_CHARS]
    for row in ranked.toLocalIterator():
        if len(row.t) <= room[row.y] and len(texts[row.y]) < SAMPLE:
            room[row.y] -= len(row.t)
            texts[row.y].append(row.t)
    ordinary, toxic = texts
    return fit(toxic, ordinary, min(0.9, max(0.01, share)) if share is not None else None)


def score_column(detector: Detector, text: Column) -> Column:
    """The score of a text, null as empty. Only texts travel to Python and only scores come back."""

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        found = pa.array([detector.score(t.as_py() or "") for t in texts], pa.float64())
        give_back()
        return found

    return score(text)


def score_texts(docs: DataFrame, detector: Detector, text_col: str = "text", carry: dict[str, Column] | None = None) -> DataFrame:
    """The carried columns, score and predicted for every row: whole texts, null as empty; rows do not move."""
    small_batches(docs)
    scored = docs.select(*(c.alias(k) for k, c in (carry or {}).items()), score_column(detector, F.col(text_col)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_ordinary(docs: DataFrame, detector: Detector, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with their own columns only."""
    small_batches(docs)
    mark = fresh("score", docs.columns)
    return docs.withColumn(mark, score_column(detector, F.col(text_col))).where(F.col(mark) < 0.5).drop(mark)
