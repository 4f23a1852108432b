"""Language identification as a mixture of languages.

A language is a distribution over hashed character n-grams. For each document, expectation-maximisation estimates
which shares of the n-grams come from which language; languages are then taken away one after another as long as the
penalised likelihood (log-likelihood less PENALTY * log(n) for each language) grows, so that a document has the
smallest set of languages that explains it. Its language is that with the largest share of this set.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lifeloom.llm.common import kept_rows

UND = "und"
#: Labelled documents of a language in the fit, at most; a hash of the id chooses them. Their texts are whole.
SAMPLE_ROWS = 600
#: Documents of the fit in all, at most, but for one of each language.
SAMPLE_TOTAL = 20_000
#: Languages that a model holds in memory (128 kB each); more are an error, none is left out.
MAX_LANGUAGES = 2000
BUCKETS = 1 << 15
SMOOTHING = 0.25
#: A change of all shares by less ends the estimation.
TOLERANCE = 1e-3
PENALTY = 3.0
#: Share of a text's n-grams that its first language must hold for a filter to keep the text.
MIN_SHARE = 0.5
_LETTER = re.compile(r"[^\W\d_]")
_OTHER = re.compile(r"[\W\d_]+")


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(distinct hashed n-grams, how often each) of the letters of a text: words with a space at both ends, n = 2 and 3."""
    x = np.frombuffer((" " + _OTHER.sub(" ", text.lower()).strip() + " ").encode("utf-32-le", "replace"), np.uint32)
    two = x[:-1] * np.uint32(0x9E3779B1) + x[1:] * np.uint32(0x85EBCA77)
    three = two[:-1] * np.uint32(0xC2B2AE3D) + x[2:] * np.uint32(0x27D4EB2F)
    shift = np.uint32(32 - (BUCKETS.bit_length() - 1))
    ids = np.concatenate([(two ^ (two >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> shift, (three ^ (three >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> shift])
    if len(ids) < 2 * BUCKETS:
        found, counts = np.unique(ids, return_counts=True)
        return found, counts.astype(np.float32)
    counts = np.bincount(ids, minlength=BUCKETS)
    found = np.flatnonzero(counts)
    return found, counts[found].astype(np.float32)


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    #: n-gram, language -> probability
    probability: np.ndarray


def fit(rows: list[tuple[str, str]]) -> Model:
    """Smoothed n-gram distributions of (text, language) rows."""
    names = tuple(sorted({lang for _, lang in rows}))
    counts = np.zeros((BUCKETS, len(names)), np.float64)
    for text, lang in rows:
        found, n = grams(text)
        counts[found, names.index(lang)] += n
    total = counts.sum(axis=0)
    # A language with little text leans on what all languages share.
    shared = (counts.sum(axis=1) + SMOOTHING) / (total.sum() + SMOOTHING * BUCKETS)
    weight = SMOOTHING * BUCKETS
    return Model(names, ((counts + weight * shared[:, None]) / (total + weight)).astype(np.float32) if names else counts)


def shares(p: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, float]:
    """EM: the mixture shares of the columns of p for rows that count n, and the log-likelihood.

    It goes on until no share changes by TOLERANCE: the likelihood never falls and is bounded, so steps get smaller.
    """
    share = np.full(p.shape[1], 1 / p.shape[1], np.float32)
    total, done = n.sum(), p.shape[1] == 1
    while not done:
        new = share * (p.T @ (n / (p @ share))) / total
        done = np.abs(new - share).max() < TOLERANCE
        share = new
    return share, float(n @ np.log(p @ share))


def mixture(model: Model, text: str | None) -> list[tuple[str, float]]:
    """(language, share) of the chosen set, largest share first; empty without a letter or without a language."""
    if not text or not model.languages or not _LETTER.search(text):
        return []
    ids, n = grams(text)
    p = model.probability[ids]
    chosen = np.arange(len(model.languages))
    share, likelihood = shares(p, n)
    cost = PENALTY * np.log(n.sum())
    while len(chosen) > 1:
        keep = np.delete(np.arange(len(chosen)), share.argmin())
        less_share, less = shares(p[:, chosen[keep]], n)
        if less + cost < likelihood:
            break
        chosen, share, likelihood = chosen[keep], less_share, less
    order = np.lexsort((chosen, -share))
    return [(model.languages[chosen[i]], float(share[i])) for i in order]


def held_out(doc_id) -> F.Column:
    return F.crc32(doc_id.cast("string")) % 4 == 2


def train(docs: DataFrame) -> Model:
    """Fit on documents with a language that are not held out, at most SAMPLE_ROWS of each language.

    Rows are counted for each language (one row a language comes to the driver). A hash of the id first thins each
    language to a little more than its bound, with no shuffle; the rows left are ranked, so the bound is exact and a
    language with a text is never without one. Of a repeated doc_id of a language the least text counts.
    """
    known = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"), docs["lang"].cast("string").alias("lang"))
    known = known.where(~held_out(known["doc_id"]) & known["lang"].isNotNull() & (known["text"] != ""))
    counts = known.groupBy("lang").count().collect()
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"{len(counts)} languages, a model holds {MAX_LANGUAGES}")
    if not counts:
        return fit([])
    rows = max(1, min(SAMPLE_ROWS, SAMPLE_TOTAL // len(counts)))
    # So many more than the bound that fewer than the bound pass only where ids are repeated very often.
    wanted = rows + 8 * rows**0.5 + 24
    part = F.create_map(*(F.lit(v) for r in counts for v in (r["lang"], min(1.0, wanted / r["count"]))))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) / (1 << 40)
    thin = known.where(place <= part[F.col("lang")]).groupBy("lang", "doc_id").agg(F.min("text").alias("text"))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    sample = thin.withColumn("place", F.row_number().over(order)).where(F.col("place") <= rows).orderBy("lang", "place").collect()
    return fit([(r.text, r.lang) for r in sample])


SCHEMA = "doc_id long, lang_pred string, score double, languages string"


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score, languages) of each row of docs (doc_id, text).

    languages lists the chosen set with shares, score is the share of the predicted one. One pass without a shuffle.
    Null, empty and letterless texts are `und` with score 0, as is every text if nothing could be learned. Equal
    shares go to the language that comes first by name. Repeated rows each give a row; an empty table gives none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1)
            for k in range(0, len(texts), 512):
                found = [mixture(model, t) for t in texts[k : k + 512].to_pylist()]
                cols = (
                    pa.array([m[0][0] if m else UND for m in found], pa.string()),
                    pa.array([min(1.0, m[0][1]) if m else 0.0 for m in found], pa.float64()),
                    pa.array([",".join(f"{x}:{v:.3f}" for x, v in m) for m in found], pa.string()),
                )
                yield pa.RecordBatch.from_arrays([b.column(0)[k : k + 512], *cols], names=[f.split()[0] for f in SCHEMA.split(", ")])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(run, SCHEMA)


def keep_known(docs: DataFrame, model: Model, min_share: float = MIN_SHARE) -> DataFrame:
    """Rows of docs of which one language holds min_share of the text at least, with all their columns.

    Texts without a letter go, as do those mixed of languages of which none holds so much; a model that has learned no
    language judges nothing else. Rows of equal text stay or go together; an empty table stays empty.
    """

    def known(text: str | None) -> bool:
        if not model.languages:
            return bool(text and _LETTER.search(text))
        found = mixture(model, text)
        return bool(found) and found[0][1] >= min_share

    return kept_rows(docs, known)
