"""N-gram Jaccard join: MinHash banding, candidates by band hash, verification on full n-gram sets.

1. Texts with the same set of word n-grams are one class from the start; the least doc_id stands for it.
2. Each class has one hash for each band of its MinHash signature. Bands and rows are chosen for the target recall at
   the threshold, so that one pair in 1 / (1 - recall) is missed at most.
3. Classes meet in the buckets of equal band hashes. Small buckets give pairs. A large bucket would give the square of
   its size, so its members are dealt to chunks of bounded size, and every pair of chunks that shares a large bucket is
   compared as a whole by one task: shared n-grams are counted by matrix products, and what leaves the task is a number
   of links for each member and a spanning forest, not the pairs. Members of overlapping large buckets have one leader
   and share chunks, so a group of n members has about n / CHUNK chunks, however many buckets it fills.
4. Every pair is verified on its n-gram sets, so all links are real; connected components give the groups.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lifeloom.llm.common import BATCH_ROWS, Durable, give_back, tidy, words_of
from lifeloom.llm.components import components

WORDS = 5
THRESHOLD = 0.8
RECALL = 0.9999
ROWS = 6
#: Members up to which a bucket gives its pairs; larger ones are compared in chunks.
SMALL = 16
#: N-grams of a chunk, about: 8 MB of hashes. Long texts make small chunks.
CHUNK_GRAMS = 1_000_000
#: Members of a chunk, about: the matrix of counts of two chunks has 17 MB.
CHUNK = 2048
#: Cells of the 0/1 matrix of members and n-grams that is multiplied at once: 16 MB.
CELLS = 1 << 22
#: Rows of the matrix of counts that are held against the threshold at once.
LINKED_ROWS = 128
#: Characters of text whose n-grams are hashed at once.
BATCH_CHARS = 2_000_000
_M = np.uint64(0x9E3779B97F4A7C15)


def bands_for(threshold: float = THRESHOLD, rows: int = ROWS, recall: float = RECALL) -> int:
    """The fewest bands of so many rows that a pair at the threshold shares with probability recall."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows)))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def ngram_sets(texts: list[str | None], n: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's word n-grams; a text of fewer words has one, of none no n-gram."""
    words = [words_of(t) for t in texts]
    counts = [len(w) for w in words]
    coded = pa.array([w for x in words for w in x], pa.large_binary()).dictionary_encode()
    known = np.array([xxhash.xxh64_intdigest(w) for w in coded.dictionary.to_pylist()], np.uint64)
    h = known[coded.indices.to_numpy(zero_copy_only=False)] if len(known) else known
    grams = np.zeros(max(0, len(h) - n + 1), np.uint64)
    for i in range(n):
        grams = grams * _M + h[i : i + len(grams)]
    grams = _mix(grams)
    out, at = [], 0
    for c in counts:
        if c >= n:
            out.append(np.unique(grams[at : at + c - n + 1]))
        elif c:
            x = np.full(1, c, np.uint64)
            for i in range(c):
                x = x * _M + h[at + i : at + i + 1]
            out.append(_mix(x))
        else:
            out.append(np.empty(0, np.uint64))
        at += c
    return out


class MinHash:
    def __init__(self, bands: int, rows: int, seed: int = 1):
        r = np.random.default_rng(seed)
        self.bands, self.rows = bands, rows
        self.a = r.integers(0, 2**63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = r.integers(0, 2**63, bands * rows, dtype=np.uint64)

    def band_hashes(self, grams: np.ndarray) -> np.ndarray:
        """One signed 64-bit hash for each band; different bands never share one but by chance."""
        low = np.full(len(self.a), np.iinfo(np.uint64).max, np.uint64)
        for k in range(0, len(grams), 256):
            np.minimum(low, (grams[k : k + 256, None] * self.a + self.b).min(axis=0), out=low)
        out = np.arange(self.bands, dtype=np.uint64)
        for column in low.reshape(self.bands, self.rows).T:
            out = _mix(out * _M + column)
        return out.view(np.int64)


def set_key(grams: np.ndarray, text: str | None) -> bytes:
    """Equal for texts with the same n-grams; of texts without words, for equal ones only."""
    data = grams.tobytes() if len(grams) else b"raw" + (text or "").encode("utf-8", "replace")
    return hashlib.blake2b(data, digest_size=16).digest()


def _batches(texts: pa.Array, limit: int) -> Iterator[tuple[int, list]]:
    held, size, start = [], 0, 0
    for i, t in enumerate(t for k in range(0, len(texts), BATCH_ROWS) for t in texts[k : k + BATCH_ROWS].to_pylist()):
        held.append(t)
        size += len(t) if t else 0
        if size >= limit:
            yield start, held
            held, size, start = [], 0, i + 1
    if held:
        yield start, held


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))


def signed(docs: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, key, grams, bands) of each row of docs: n-gram set key, number of n-grams, band hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = MinHash(bands, rows)
        for b in batches:
            for at, texts in _batches(b.column(1), BATCH_CHARS):
                sets = ngram_sets(texts, words)
                keys = [set_key(s, t) for s, t in zip(sets, texts, strict=True)]
                done: dict[bytes, np.ndarray] = {}
                for k, s in zip(keys, sets, strict=True):
                    if k not in done:
                        done[k] = hasher.band_hashes(s) if len(s) else np.empty(0, np.int64)
                flat = np.concatenate([done[k] for k in keys])
                ends = np.concatenate([[0], np.cumsum([len(done[k]) for k in keys])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0)[at : at + len(texts)],
                        pa.array(keys, pa.binary()),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.ListArray.from_arrays(ends, pa.array(flat, pa.int64())),
                    ],
                    names=["doc_id", "key", "grams", "bands"],
                )

    return _rows(docs).mapInArrow(tidy(run), "doc_id long, key binary, grams long, bands array<long>")


def sets_of(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(rep, weight, grams binary) of the wanted (rep, key, weight): full n-gram sets, from the texts."""
    met = _rows(docs).join(wanted.withColumnRenamed("rep", "doc_id"), "doc_id").select("doc_id", "weight", "key", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, texts in _batches(b.column("text"), BATCH_CHARS):
                sets = ngram_sets(texts, words)
                keys = b.column("key")[at : at + len(texts)].to_pylist()
                fit = pa.array([set_key(s, t) == k for s, t, k in zip(sets, texts, keys, strict=True)], pa.bool_())
                made = pa.RecordBatch.from_arrays(
                    [
                        b.column("doc_id")[at : at + len(texts)],
                        b.column("weight")[at : at + len(texts)],
                        pa.array([s.tobytes() for s in sets], pa.binary()),
                    ],
                    names=["rep", "weight", "grams"],
                )
                yield made.filter(fit)

    return met.mapInArrow(tidy(run), "rep long, weight long, grams binary")


def shared_counts(a: list[np.ndarray], b: list[np.ndarray] | None = None) -> np.ndarray:
    """How many n-grams each set of a shares with each of b, or of a: products of 0/1 columns, a slice of n-grams at a time."""
    both = [*a, *(b or [])]
    rows = np.repeat(np.arange(len(both), dtype=np.int32), [len(x) for x in both])
    flat = np.concatenate(both)
    order = np.argsort(flat)
    rows, flat = rows[order], flat[order]
    del order
    starts = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]])) if len(flat) else np.empty(0, np.int64)
    del flat
    n = np.diff(starts, append=len(rows))
    often = n > 1
    rows, n = rows[np.repeat(often, n)], n[often]  # an n-gram of one set is shared by none
    ends = np.concatenate([[0], np.cumsum(n)])
    out = np.zeros((len(a), len(a) if b is None else len(b)), np.float32)
    width = max(1, CELLS // max(1, len(both)))
    for lo in range(0, len(n), width):
        s, e = ends[lo], ends[min(lo + width, len(n))]
        plane = np.zeros((len(both), min(width, len(n) - lo)), np.float32)
        plane[rows[s:e], np.repeat(np.arange(plane.shape[1]), n[lo : lo + width])] = 1
        out += plane[: len(a)] @ plane[0 if b is None else len(a) :].T
    return out


def linked(shared: np.ndarray, a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Where shared / (a + b - shared) >= threshold, without rounding a quotient."""
    return (shared > 0) & (shared.astype(np.float64) * (1 + threshold) >= threshold * (a[:, None] + b[None, :]) - 1e-9)


def _forest(match: np.ndarray) -> np.ndarray:
    """The least member that each member of a symmetric relation is connected with."""
    label = np.arange(len(match))
    while True:
        new = np.array([min(label[i], label[row].min(initial=len(label))) for i, row in enumerate(match)])
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


_COMPARED = "rep long, links long, parent long"


def compare_chunks(threshold: float):
    """Function for a group of rows (pair, side, rep, weight, grams): links and a spanning forest of a pair of chunks."""

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["side", "rep"])
        sets = [np.frombuffer(g, np.uint64) for g in frame["grams"]]
        n = int((frame["side"] == 0).sum())
        rep, weight = frame["rep"].to_numpy(), frame["weight"].to_numpy().astype(np.float64)
        size = np.array([len(s) for s in sets], np.float64)
        own = n == len(sets)  # a chunk with itself
        shared = shared_counts(sets) if own else shared_counts(sets[:n], sets[n:])
        other = 0 if own else n
        match, links = np.zeros((len(sets), len(sets)), bool), np.zeros(len(sets))
        for lo in range(0, n, LINKED_ROWS):
            hi = min(lo + LINKED_ROWS, n)
            part = linked(shared[lo:hi], size[lo:hi], size[other:], threshold)
            if own:
                part[np.arange(hi - lo), np.arange(lo, hi)] = False
            else:
                match[n:, lo:hi] = part.T
                links[n:] += weight[lo:hi] @ part
            match[lo:hi, other:] = part
            links[lo:hi] = part @ weight[other:]
        del shared
        parent = rep[_forest(match)]
        some = links > 0
        return pd.DataFrame({"rep": rep[some], "links": links[some].astype(np.int64), "parent": parent[some]})

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        found = compare(frame)
        give_back()
        return found

    return run


def _verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The (a, b) of pairs whose sets reach the threshold, with both weights."""
    own = sets.select(F.col("rep").alias("b"), F.col("weight").alias("b_weight"), F.col("grams").alias("b_grams"))
    other = sets.select(F.col("rep").alias("a"), F.col("weight").alias("a_weight"), F.col("grams").alias("a_grams"))
    met = pairs.join(own, "b").join(other, "a").select("a", "b", "a_weight", "b_weight", "a_grams", "b_grams")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column("a_grams"), b.column("b_grams"), strict=True):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                shared = np.array([[len(np.intersect1d(p, q, assume_unique=True))]], np.float64)
                keep.append(bool(linked(shared, np.array([len(p)]), np.array([len(q)]), threshold)[0, 0]))
            yield b.filter(pa.array(keep, pa.bool_())).select(["a", "b", "a_weight", "b_weight"])

    return met.mapInArrow(tidy(run), "a long, b long, a_weight long, b_weight long")


def leaders(large: DataFrame) -> DataFrame:
    """(rep, grams, leader) of the members (bucket, rep, grams) of large buckets.

    The least member of a bucket leads it; a member follows the least leader of its buckets, and then the least that
    members of its buckets follow. Whom members follow decides only which of them are compared by one task, not what is
    compared: two hops reach across the buckets of a group of near copies, and chains stay apart in smaller chunks.
    """
    held = large.select("bucket", "rep", "grams")
    at = F.col("rep")
    for _ in range(2):
        least = held.withColumn("at", at).groupBy("bucket").agg(F.min("at").alias("near"))
        found = held.join(least, "bucket").groupBy("rep").agg(F.min("near").alias("leader"), F.first("grams").alias("grams"))
        held = held.select("bucket", "rep", "grams").join(found.select("rep", "leader"), "rep")
        at = F.col("leader")
    return found.select("rep", "grams", "leader")


def similar_documents(docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL, rows: int = ROWS) -> DataFrame:
    """(doc_id, class_id, n_links) of each row of docs (doc_id, text).

    Two documents are linked if their texts have the same n-grams or their n-gram sets reach the threshold. class_id is
    the least doc_id of the connected component, n_links the number of other rows linked with a row directly.

    A text of fewer words than n is one n-gram of its own. Texts without words (null, empty, only signs) are linked
    with equal texts only. Repeated rows are documents of their own; rows that share a doc_id but not the text fall
    into one class. Null ids and empty tables give no row. Other columns are ignored.
    """
    bands = bands_for(threshold, rows, recall)
    docs = docs.where(docs["doc_id"].isNotNull())
    spent: list[Durable] = []

    def held(df: DataFrame) -> DataFrame:
        spent.append(Durable(df))
        return spent[-1].df

    own = Durable(signed(docs, words, bands, rows)).df
    classes = held(
        own.groupBy("key").agg(
            F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("weight"), F.first("grams").alias("grams"), F.first("bands").alias("bands")
        )
    )
    entries = classes.select("rep", "grams", F.explode("bands").alias("bucket"))
    buckets = entries.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = held(entries.join(buckets, "bucket"))

    small = members.where(F.col("n") <= SMALL)
    x, y = small.select("bucket", F.col("rep").alias("a"), F.col("grams").alias("a_grams")), small.select("bucket", F.col("rep").alias("b"), F.col("grams").alias("b_grams"))
    near_size = F.least("a_grams", "b_grams") >= F.greatest("a_grams", "b_grams") * F.lit(threshold) - 1e-9
    pairs = x.join(y, "bucket").where((F.col("a") < F.col("b")) & near_size).select("a", "b").distinct()

    large = members.where(F.col("n") > SMALL)
    led = held(leaders(large))
    groups_of = led.groupBy("leader").agg(F.count(F.lit(1)).alias("n"), F.sum("grams").alias("mass"))
    parts = F.greatest(F.ceil(F.col("n") / CHUNK), F.ceil(F.col("mass") / CHUNK_GRAMS))
    part = F.pmod(F.xxhash64("rep"), parts)
    chunks = held(led.join(groups_of, "leader").select("rep", F.xxhash64("leader", part).alias("chunk")))
    touched = large.select("bucket", "rep").join(chunks, "rep").select("bucket", "chunk").distinct()
    met = held(
        touched.select("bucket", F.col("chunk").alias("a"))
        .join(touched.select("bucket", F.col("chunk").alias("b")), "bucket")
        .where("a <= b")
        .select("a", "b")
        .distinct()
    )
    first, second = chunks.select(F.col("rep").alias("a"), F.col("chunk").alias("p")), chunks.select(F.col("rep").alias("b"), F.col("chunk").alias("q"))
    placed = pairs.join(first, "a", "left").join(second, "b", "left")
    compared = met.select(F.col("a").alias("p"), F.col("b").alias("q"))
    # A pair of which one has no chunk is compared by no task; least() alone would take it for the other's own chunk.
    both = F.col("p").isNotNull() & F.col("q").isNotNull()
    sides_of = {"p": F.when(both, F.least("p", "q")), "q": F.when(both, F.greatest("p", "q"))}
    pairs = held(placed.withColumns(sides_of).join(compared, ["p", "q"], "left_anti").select("a", "b"))

    needed = chunks.select("rep").union(pairs.select("a")).union(pairs.select("b")).distinct()
    wanted = classes.select("rep", "key", "weight").join(needed, "rep")
    sets = held(sets_of(docs, wanted, words))

    sides = met.select("a", "b", F.col("a").alias("chunk"), F.lit(0).alias("side")).union(
        met.where("a < b").select("a", "b", F.col("b").alias("chunk"), F.lit(1).alias("side"))
    )
    grouped = sides.join(chunks, "chunk").join(sets, "rep").select("a", "b", "side", "rep", "weight", "grams")
    in_chunks = held(grouped.groupBy("a", "b").applyInPandas(compare_chunks(threshold), _COMPARED))
    in_pairs = held(_verified(pairs, sets, threshold))

    links = (
        in_chunks.select("rep", "links")
        .union(in_pairs.select("a", "b_weight"))
        .union(in_pairs.select("b", "a_weight"))
        .groupBy("rep")
        .agg(F.sum("links").alias("links"))
    )
    edges = in_chunks.select(F.col("rep").alias("a"), F.col("parent").alias("b")).union(in_pairs.select("a", "b"))
    found = components(edges)
    groups = Durable(
        classes.select("key", "rep", "weight")
        .join(links, "rep", "left")
        .join(found.withColumnRenamed("node", "rep"), "rep", "left")
        .select(
            "key",
            F.coalesce("component", "rep").alias("class_id"),
            (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).cast("long").alias("n_links"),
        )
    ).df
    for table in spent:
        table.drop()
    return own.select("doc_id", "key").join(groups, "key").select("doc_id", "class_id", "n_links")


def keep_one_of_each(docs: DataFrame, **settings) -> DataFrame:
    """docs without those rows whose class has a smaller doc_id, with all their columns.

    Of repeated rows of the kept id, all stay; so do rows with a null id, which are in no class. Texts without words are
    copies of equal texts only. An empty table stays empty.
    """
    found = similar_documents(docs, **settings)
    gone = found.where("class_id < doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)
