"""Exact top-k inner products, pruned by norms and by SVD-rotated partial sums.

Vectors are sorted by descending length and written in blocks. The head block, with the longest vectors, gives every
query a first k-th score. Then query blocks are sent to the candidate blocks, in rounds of bounded size; a pair of blocks
is left out if no product of its vectors can reach the lowest k-th score of the query block. Within a pair, vectors are rotated to the right singular
vectors of all data, so that a few leading coordinates hold most of a product, and

    <q, x>  <=  <q, x> on the leading coordinates  +  |rest of q| * |rest of x|      (Cauchy-Schwarz)

leaves few vectors whose exact integer product is computed at all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lifeloom.llm.common import Durable

K = 5
SCALE = 256
#: Vectors of a block, at most.
BLOCK = 4096
#: Components of a block, at most, but for one vector that has more: wide vectors make small blocks.
CELLS = 1 << 21
#: Bytes of query blocks that are broadcast at once.
ROUND = 64_000_000
#: Leading components that are rotated, at most; those beyond it count among the rest, so results are the same.
TURNED = 1024
#: Share of the squared length that the leading coordinates hold.
LEADING = 0.6
#: Products up to this are exact as float64; beyond it they are computed with Python's integers.
EXACT = 2.0**52
LEAST, MOST = -(2**63), 2**63 - 1

_BLOCKS = "block long, ids binary, vectors binary, width int, longest double"


def integer_vectors(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, v array<long>): floor(scale * x) of each component; null, empty and non-finite vectors are left out."""
    x = F.transform("embedding", lambda c: c.cast("double") * scale)
    fine = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    kept = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0))
    return kept.where(F.coalesce(fine, F.lit(False))).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c)).alias("v")
    )


def _pack(block: int, ids: list, rows: list) -> dict:
    """A block, as wide as its longest row."""
    width = max(len(r) for r in rows)
    m = np.zeros((len(rows), width), np.int64)
    for i, r in enumerate(rows):
        m[i, : len(r)] = r
    longest = float(np.sqrt((m.astype(np.float64) ** 2).sum(axis=1)).max())
    kind = "<i4" if np.abs(m, dtype=np.float64).max(initial=0) < 2**31 else "<i8"
    return {"block": block, "ids": np.array(ids, "<i8").tobytes(), "vectors": m.astype(kind).tobytes(), "width": width, "longest": longest}


def _unpack(r) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(r["ids"], "<i8")
    cells = len(ids) * r["width"]
    return ids, np.frombuffer(r["vectors"], f"<i{len(r['vectors']) // cells}").reshape(-1, r["width"]).astype(np.int64)


def _as_wide(m: np.ndarray, width: int) -> np.ndarray:
    return np.pad(m, ((0, 0), (0, width - m.shape[1]))) if m.shape[1] < width else m


def blocks_of(rows: DataFrame, count: int, size: int = BLOCK, cells: int = CELLS) -> DataFrame:
    """Blocks of vectors by descending length: range-partitioned by length, sorted within, packed as arrays.

    Neighbouring partitions are put together where they are much smaller than a block.
    """
    norm = F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double"))
    sorted_ = rows.withColumn("norm", norm).repartitionByRange(F.desc("norm"), F.asc("vec_id")).sortWithinPartitions(F.desc("norm"), "vec_id")
    sorted_ = sorted_.coalesce(max(1, -(-count // size)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        block, ids, held, widest = TaskContext.get().partitionId() << 32, [], [], 0
        for b in batches:
            for i, v in zip(b["vec_id"].tolist(), b["v"], strict=True):
                if ids and (len(ids) == size or (len(ids) + 1) * max(widest, len(v)) > cells):
                    yield pd.DataFrame([_pack(block, ids, held)])
                    block, ids, held, widest = block + 1, [], [], 0
                ids.append(i)
                held.append(v)
                widest = max(widest, len(v))
        if ids:
            yield pd.DataFrame([_pack(block, ids, held)])

    return sorted_.select("vec_id", "v").mapInPandas(run, _BLOCKS)


def rotation(blocks: DataFrame, width: int) -> tuple[np.ndarray, int]:
    """Right singular vectors of the leading `width` components, and how many of them hold LEADING of the squared length.

    Each partition gives one width x width sum of products, of which its upper half is added up; the vectors stay where
    they are, and what comes to the driver is bounded by TURNED.
    """

    def grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((width, width))
        for b in batches:
            for r in b.to_dict("records"):
                m = _as_wide(_unpack(r)[1][:, :width].astype(np.float64), width)
                total += m.T @ m
        i, j = np.triu_indices(width)
        yield pd.DataFrame({"i": i, "j": j, "g": total[i, j]})

    cells = blocks.select("ids", "vectors", "width").mapInPandas(grams, "i int, j int, g double")
    found = cells.groupBy("i", "j").agg(F.sum("g").alias("g")).toPandas()
    gram = np.zeros((width, width))
    gram[found["i"], found["j"]] = found["g"]
    gram[found["j"], found["i"]] = found["g"]
    values, vectors = np.linalg.eigh(gram)
    values, vectors = np.maximum(values[::-1], 0), vectors[:, ::-1]
    share = np.cumsum(values) / max(values.sum(), 1e-300)
    return vectors, int(min(width, np.searchsorted(share, LEADING) + 1))


def _exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer products of the rows of x with q; those beyond 64 bits are the least or the largest that 64 bits hold."""
    if float(np.abs(q, dtype=np.float64).max(initial=0)) * float(np.abs(x, dtype=np.float64).max(initial=0)) * x.shape[1] < EXACT:
        return (x.astype(np.float64) @ q.astype(np.float64)).astype(np.int64)
    own = q.tolist()
    return np.array([min(MOST, max(LEAST, sum(a * b for a, b in zip(row, own, strict=True)))) for row in x.tolist()], np.int64)


def _turned(m: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """Rows with their leading components rotated and the others as they are: lengths and products stay the same."""
    m = _as_wide(m.astype(np.float64), len(turn))
    return np.hstack([m[:, : len(turn)] @ turn, m[:, len(turn) :]])


def search(
    q_ids: np.ndarray, q: np.ndarray, floor: np.ndarray, x_ids: np.ndarray, x: np.ndarray, turn: np.ndarray, lead: int, k: int
) -> Iterator[tuple[int, int, int]]:
    """(query, vector, score) of the k best of a candidate block for each query that reach the query's floor."""
    width = max(q.shape[1], x.shape[1])
    q, x = _as_wide(q, width), _as_wide(x, width)
    qr, xr = _turned(q, turn), _turned(x, turn)
    q_rest = np.sqrt((qr[:, lead:] ** 2).sum(axis=1))
    x_rest = np.sqrt((xr[:, lead:] ** 2).sum(axis=1))
    order = np.argsort(-((xr**2).sum(axis=1)), kind="stable")
    x_ids, x, xr, x_rest = x_ids[order], x[order], xr[order], x_rest[order]
    bound = qr[:, :lead] @ xr[:, :lead].T + np.outer(q_rest, x_rest)
    slack = 1e-9 * np.outer(np.sqrt((qr**2).sum(axis=1)), np.sqrt((xr**2).sum(axis=1))) + 1e-6
    bound = np.maximum(bound + slack, float(LEAST))  # a score is never less, nor is a floor
    for i, own in enumerate(q_ids.tolist()):
        at = np.flatnonzero((bound[i] >= floor[i]) & (x_ids != own))
        if len(at) > 8 * k:  # the best bounds first: they raise the floor for the rest
            first = at[np.argpartition(-bound[i, at], 4 * k)[: 4 * k]]
            low = np.sort(_exact(q[i], x[first]))[-k]
            at = at[bound[i, at] >= float(low)]
        scores = _exact(q[i], x[at])
        if len(at) > k:  # all that tie with the k-th stay
            top = scores >= np.partition(scores, -k)[-k]
            at, scores = at[top], scores[top]
        ids = x_ids[at]
        best = np.lexsort((ids, ~scores))[:k]  # ~s falls as s grows, for any s of 64 bits
        for s, v in zip(scores[best].tolist(), ids[best].tolist(), strict=True):
            if s >= floor[i]:
                yield own, v, s


def rounds_of(blocks: list, limit: int = ROUND) -> Iterator[tuple[list[int], float]]:
    """(numbers of query blocks, their least reach) of each round: blocks of (block, reach, size) in the order given, of at
    most `limit` bytes together, or one that is larger."""
    held, size, least = [], 0, 0.0
    for r in blocks:
        if held and size + r["size"] > limit:
            yield held, least
            held, size = [], 0
        least = min(least, r["reach"]) if held else r["reach"]
        held.append(r["block"])
        size += r["size"]
    if held:
        yield held, least


def top_k(vectors: DataFrame, is_query, k: int = K, scale: int = SCALE, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest integer inner products of each query with every other row.

    is_query(vec_id column) chooses the queries. All are answered, in blocks, against all vectors. Ties go to the
    smaller vec_id; a query with fewer than k others gets all. Vectors null, empty or with null or non-finite
    components take no part; shorter vectors count as padded with zeros. Rows with the query's own id are no
    candidates for it; other repeated rows each are. Of repeated query ids the row with the least components counts.
    A component or score beyond 64 bits is the largest (or least) that 64 bits hold. Empty tables give no row. Other
    columns are ignored.
    """
    rows = integer_vectors(vectors, scale)
    queries = rows.where(is_query(F.col("vec_id"))).groupBy("vec_id").agg(F.min("v").alias("v"))
    width, n, asking = rows.agg(F.max(F.size("v")), F.count(F.lit(1)), F.count(F.when(is_query(F.col("vec_id")), 1))).first()
    stored = Durable(blocks_of(rows, n, block)).df
    asked = Durable(blocks_of(queries, asking, block)).df
    turn, lead = rotation(stored, min(width or 1, TURNED))

    def against(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.to_dict("records"):
                q_ids, q = _unpack(r)
                x_ids, x = _unpack({"ids": r["x_ids"], "vectors": r["x_vectors"], "width": r["x_width"]})
                floors = r.get("floors")
                floor = np.frombuffer(floors, "<f8") if floors else np.full(len(q_ids), -np.inf)
                out += search(q_ids, q, floor, x_ids, x, turn, lead, k)
            yield pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    hit = "query_id long, vec_id long, score long"
    head_rows = stored.orderBy("block").limit(1).select(F.col("ids").alias("x_ids"), F.col("vectors").alias("x_vectors"), F.col("width").alias("x_width"))
    # One block, bounded by `block` vectors, meets every query block.
    first = asked.crossJoin(F.broadcast(head_rows)).mapInPandas(against, hit)
    floors = (
        first.groupBy("query_id")
        .agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least"))
        .select("query_id", F.when(F.col("n") >= k, F.col("least").cast("double")).alias("floor"))
    )

    def with_floor(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.to_dict("records"):
                known = dict(zip(r["qs"], r["fs"], strict=True))
                ids = np.frombuffer(r["ids"], "<i8").tolist()
                f = np.array([known.get(i, -np.inf) for i in ids], "<f8")
                lengths = np.sqrt((_unpack(r)[1].astype(np.float64) ** 2).sum(axis=1))
                with np.errstate(invalid="ignore", divide="ignore"):
                    reach = np.where(lengths > 0, f / lengths, np.where(f <= 0, -np.inf, np.inf))
                out.append({"block": r["block"], "ids": r["ids"], "vectors": r["vectors"], "width": r["width"], "floors": f.tobytes(), "reach": float(reach.min())})
            yield pd.DataFrame(out, columns=["block", "ids", "vectors", "width", "floors", "reach"])

    of_query = asked.select("block", "ids").mapInPandas(
        lambda it: (pd.DataFrame([(r.block, i) for r in b.itertuples() for i in np.frombuffer(r.ids, "<i8").tolist()], columns=["block", "query_id"]) for b in it),
        "block long, query_id long",
    )
    # A block has at most `block` queries, so its floors are a bounded list.
    listed = of_query.join(floors.where("floor is not null"), "query_id").groupBy("block").agg(
        F.collect_list("query_id").alias("qs"), F.collect_list("floor").alias("fs")
    )
    blank = F.array().cast("array<long>"), F.array().cast("array<double>")
    ready = asked.join(listed, "block", "left").select(
        *asked.columns, F.coalesce("qs", blank[0]).alias("qs"), F.coalesce("fs", blank[1]).alias("fs")
    )
    ready = ready.mapInPandas(with_floor, "block long, ids binary, vectors binary, width int, floors binary, reach double")
    # Candidate blocks stay where they are: bounded rounds of query blocks are sent to them, those with like reach together.
    # No vector of a candidate block can reach a floor unless its longest one is as long as the least floor / |q|.
    reach = Durable(ready).df
    head, blocks = stored.agg(F.min("block"), F.count(F.lit(1))).first()
    sides = stored.where(F.col("block") != F.lit(head if head is not None else -1))
    sides = sides.select(F.col("ids").alias("x_ids"), F.col("vectors").alias("x_vectors"), F.col("width").alias("x_width"), (F.col("longest") * (1 + 1e-9) + 1e-6).alias("x_reach"))
    # Few blocks lie in few files, which a scan would put into one task: they are dealt out, a block a task.
    if 1 < blocks <= 4 * stored.sparkSession.sparkContext.defaultParallelism:
        sides = sides.repartition(blocks)
    size = F.octet_length("vectors") + F.octet_length("ids") + F.octet_length("floors")
    found = first
    for numbers, least in rounds_of(reach.select("block", "reach", size.alias("size")).orderBy("reach", "block").collect()):  # a row a query block
        sent = F.broadcast(reach.where(F.col("block").isin(numbers)))
        met = sides.where(F.col("x_reach") >= least).join(sent, F.col("x_reach") >= F.col("reach"))
        found = found.unionByName(Durable(met.select("ids", "vectors", "width", "floors", "x_ids", "x_vectors", "x_width").mapInPandas(against, hit)).df)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    )
