"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on windows of toxic text and one on windows of ordinary text. A window is
a short run of whole words. What it gains is its compressed length under the ordinary dictionary less that under the
toxic one. Windows that gain at least a threshold count as hits; thresholds and the weight of the hits are calibrated
on labelled texts that the dictionaries have not seen.

Most words of a toxic text are ordinary. So both dictionaries share one part, trained on ordinary text, and each has a
part of its own, trained on the words that recur in its class and hardly in the other.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lifeloom.llm.common import kept_rows

#: Labelled documents of each class that a model is fitted on, at most: a hash of the id chooses them. Their texts are
#: whole, whatever their length.
SAMPLE_ROWS = 1500
#: Bytes of a window: whole words, one at least.
WINDOW = 7
DICT_BYTES = 8192
#: Part of a dictionary that holds what sets its class apart.
OWN_BYTES = 4096
#: A word that trains it follows so many different words in its class, is in so large a share of its texts (one long text
#: makes no mark), and follows so many times as many words as in the other class.
MIN_AFTER = 3
#: Bytes of such a run, a blank at either end of the word included: stems with many endings are found by their runs.
PIECE = 6
MIN_SHARE = 0.03
MIN_RATIO = 8.0
#: Both dictionaries end with it and every window is compressed behind it, so that even a short window is stored
#: compressed and its own cost shows byte by byte.
LEAD = b"0123456789" * 8
#: The compressor begins no match in the last eight bytes of its input, so those are not the window's.
TAIL = b" !#$%&(*+"
#: Gains in bytes that are tried as thresholds of a hit.
THRESHOLDS = (2, 3, 4, 5)
#: Weight of the toxic class in the calibration.
TOXIC_WEIGHT = 0.35
KNOWN_WINDOWS = 400_000


def windows_of(text: str | None) -> list[bytes]:
    """Whole words of the lower-cased text in windows of about WINDOW bytes; characters other than letters are spaces."""
    if not text:
        return []
    out, held, size = [], [], 0
    for w in re.sub(r"[\W\d_]+", " ", text.lower()).encode("utf-8", "replace").split():
        if held and size + len(w) > WINDOW:
            out.append(b" ".join(held))
            held, size = [], 0
        held.append(w)
        size += len(w) + 1
    if held:
        out.append(b" ".join(held))
    return out


def compressor(content: bytes) -> zstd.ZstdCompressor:
    """Frames without magic number, size, checksum or dictionary id, so that lengths are those of the contents."""
    held = zstd.ZstdCompressionDict(content + LEAD, dict_type=zstd.DICT_TYPE_RAWCONTENT)
    params = zstd.ZstdCompressionParameters(
        window_log=14, chain_log=12, hash_log=12, search_log=3, min_match=4, target_length=16, strategy=zstd.STRATEGY_DFAST,
        format=zstd.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_checksum=0, write_dict_id=0,
    )
    held.precompute_compress(compression_params=params)
    return zstd.ZstdCompressor(dict_data=held, compression_params=params)


@dataclass(frozen=True)
class Model:
    toxic: bytes
    ordinary: bytes
    threshold: int
    #: log-odds: bias, per log(1 + hits), per log(1 + hits per 100 windows)
    weights: tuple[float, float, float]


class Scorer:
    def __init__(self, toxic: bytes, ordinary: bytes):
        self.compress = compressor(toxic).compress, compressor(ordinary).compress
        self.known: dict[bytes, int] = {}

    def gain(self, window: bytes) -> int:
        found = self.known.get(window)
        if found is None:
            if len(self.known) >= KNOWN_WINDOWS:
                self.known.clear()
            text = LEAD + b" " + window + TAIL
            found = self.known[window] = len(self.compress[1](text)) - len(self.compress[0](text))
        return found

    def gains(self, text: str | None) -> np.ndarray:
        return np.array([self.gain(w) for w in windows_of(text)], np.int64)


def features(gains: np.ndarray, threshold: int) -> np.ndarray:
    hits = int((gains >= threshold).sum())
    return np.array([1.0, np.log1p(hits), np.log1p(100.0 * hits / max(1, len(gains)))])


def score(model: Model, gains: np.ndarray) -> float:
    """Probability-like score; without a window it is that of a text without a hit."""
    return float(1 / (1 + np.exp(-np.clip(features(gains, model.threshold) @ np.array(model.weights), -30, 30))))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Newton steps for a ridge logistic regression; an ordinary text that is rejected weighs more than a missed one."""
    c = np.where(y == 1, TOXIC_WEIGHT / max(1, y.sum()), (1 - TOXIC_WEIGHT) / max(1, (1 - y).sum())) * len(y)
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (c * (p - y)) + ridge * w
        h = (x * (c * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w = w - np.linalg.solve(h, g)
    return w


def _dictionary(windows: list[bytes], size: int) -> bytes:
    """Content that zstandard's trainer picks from the windows; where there is too little to train on, their tail."""
    samples = [b" ".join((b"", *windows[i : i + 8], b"")) for i in range(0, len(windows), 8)]
    try:
        return zstd.train_dictionary(size, samples, k=24, d=6, level=3).as_bytes()[-size:]
    except zstd.ZstdError:
        return b" ".join((b"", *windows, b""))[-size:]


def pieces_of(word: bytes) -> set[bytes]:
    """The runs of PIECE bytes in a word between blanks; a shorter word is one run."""
    held = b" " + word + b" "
    return {held[i : i + PIECE] for i in range(max(1, len(held) - PIECE + 1))}


def fit(toxic: list[str], ordinary: list[str]) -> Model:
    """Three of four texts of each class train the dictionaries, the others calibrate threshold and weights."""
    tox, low = (([t for i, t in enumerate(x) if i % 4 != 1], x[1::4]) for x in (toxic, ordinary))
    words = [[[w for x in windows_of(t) for w in x.split()] for t in side[0]] for side in (tox, low)]
    number: dict[bytes, int] = {}
    runs = {w: tuple(number.setdefault(r, len(number)) for r in sorted(pieces_of(w))) for side in words for text in side for w in text}
    place = {w: i for i, w in enumerate(runs, 1)}

    def spread(side: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """How many different words each run follows (copies of a text, exact or near, count once), and how many texts hold it."""
        pairs, held = array("Q"), np.zeros(len(number), np.int64)
        for text in side:
            before, start = 0, len(pairs)
            for w in text:
                pairs.extend(before << 32 | r for r in runs[w])
                before = place[w]
            held[np.unique(np.frombuffer(pairs[start:], np.uint64) & np.uint64(0xFFFFFFFF)).astype(np.int64)] += 1
        distinct = np.unique(np.frombuffer(pairs, np.uint64)) & np.uint64(0xFFFFFFFF)
        return np.bincount(distinct.astype(np.int64), minlength=len(number)), held

    spreads = [spread(side) for side in words]
    plain = _dictionary([w for text in words[1] for w in text], DICT_BYTES)

    def apart(mine: int) -> bytes:
        # Nearly all words of a toxic text are ordinary: the own part is trained on words with runs that recur in one class only.
        (own, texts), (other, _) = spreads[mine], spreads[1 - mine]
        share = len(words[mine]) / max(1, len(words[1 - mine]))
        many = max(MIN_AFTER, MIN_SHARE * len(words[mine]))
        mark = (np.minimum(own, texts) >= many) & (own >= MIN_RATIO * (share * other + 0.5))
        return _dictionary([w for text in words[mine] for w in text if any(mark[r] for r in runs[w])], OWN_BYTES)

    toxic_dict, plain_dict = plain + apart(0), plain + apart(1)
    scorer = Scorer(toxic_dict, plain_dict)
    both = [scorer.gains(t) for t in tox[1]], [scorer.gains(t) for t in low[1]]
    y = np.array([1.0] * len(both[0]) + [0.0] * len(both[1]))
    best = None
    for threshold in THRESHOLDS:
        x = np.array([features(g, threshold) for side in both for g in side]).reshape(len(y), 3)
        w = _logistic(x, y)
        wrong = ((x @ w >= 0) != (y == 1)).astype(float)
        rate = TOXIC_WEIGHT * np.mean(wrong[y == 1]) + (1 - TOXIC_WEIGHT) * np.mean(wrong[y == 0]) if 0 < y.sum() < len(y) else 1.0
        if best is None or rate < best[0]:
            best = rate, threshold, w
    return Model(toxic_dict, plain_dict, best[1], tuple(float(v) for v in best[2]))


def held_out(doc_id) -> F.Column:
    return F.crc32(doc_id.cast("string")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on labelled documents that are not held out: at most SAMPLE_ROWS of each class, chosen by a hash of the id.

    An id that is labelled both toxic and ordinary is toxic. Of a repeated doc_id the least text counts, so neither
    repeated rows nor repeated labels crowd out others. Null ids, null labels and empty texts teach nothing.
    """
    known = (
        labels.where(~held_out(labels["doc_id"]) & labels["toxic"].isin(0, 1))
        .groupBy(labels["doc_id"].cast("long").alias("doc_id"))
        .agg(F.max("toxic").alias("toxic"))
    )
    chosen = [
        known.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS) for label in (1, 0)
    ]
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).where("text <> ''")
    found = texts.join(F.broadcast(chosen[0].union(chosen[1])), "doc_id")  # at most twice SAMPLE_ROWS ids
    rows = found.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    return fit([r.text for r in rows if r.toxic], [r.text for r in rows if not r.toxic])


SCHEMA = "doc_id long, score double, predicted int, windows long, hits long"


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, predicted, windows, hits) of each row of docs (doc_id, text).

    One pass without a shuffle. Null, empty and letterless texts have no window and get the score of a text without
    a hit. Repeated rows each give a row; an empty table gives none. Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model.toxic, model.ordinary)
        for b in batches:
            texts = b.column(1)
            for k in range(0, len(texts), 512):
                gains = [scorer.gains(t) for t in texts[k : k + 512].to_pylist()]
                scores = [score(model, g) for g in gains]
                cols = (
                    pa.array(scores, pa.float64()),
                    pa.array([int(s >= 0.5) for s in scores], pa.int32()),
                    pa.array([len(g) for g in gains], pa.int64()),
                    pa.array([int((g >= model.threshold).sum()) for g in gains], pa.int64()),
                )
                yield pa.RecordBatch.from_arrays([b.column(0)[k : k + 512], *cols], names=[f.split()[0] for f in SCHEMA.split(", ")])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(run, SCHEMA)


def keep_ordinary(docs: DataFrame, model: Model) -> DataFrame:
    """Rows of docs whose score is below one half, with all their columns; rows of equal text stay or go together.

    Null, empty and letterless texts have the score of a text without a hit. An empty table stays empty.
    """
    scorer = None

    def decide(text: str | None) -> bool:
        nonlocal scorer
        scorer = scorer or Scorer(model.toxic, model.ordinary)
        return score(model, scorer.gains(text)) < 0.5

    return kept_rows(docs, decide)
