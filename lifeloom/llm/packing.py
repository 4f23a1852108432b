"""Sequence packing by minimum bin slack.

A bitset subset-sum over the lengths that remain picks, window after window, the multiset of pieces that fills the
window closest to its capacity; how often each length was taken is backtracked from the bitsets.
"""

from __future__ import annotations

import base64
import json
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from lifeloom.llm.common import tidy

CAPACITY = 2048
#: Tokens that a task packs at once; what doesn't fill a window is carried to its next block, so no document is dropped.
BLOCK_TOKENS = 4_000_000
#: Texts handed to the tokenizer at once.
BATCH_ROWS = 256
END_ID = 1


class ByteBPE:
    """Ids of byte_bpe_50k.json.

    Texts that hold the string of an added token go through the tokenizers library itself. All others go through
    tiktoken with the same vocabulary and split pattern, which gives the same ids at a quarter of the CPU time
    (tests/llm/test_small.py compares the two). Where tiktoken's pattern gives up, as it does on about a million blanks
    in a row, the tokenizers library encodes the text. It is loaded at the first text that needs it (28 MB).
    """

    def __init__(self, name: str = "byte_bpe_50k"):
        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.path = public_tokenizers.path(f"{name}.json")
        with open(self.path, encoding="utf-8") as f:
            self.added = [t["content"] for t in json.load(f)["added_tokens"]]

    @cached_property
    def exact(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def __call__(self, text: str | None) -> np.ndarray:
        if not text:
            return np.empty(0, np.uint32)
        if any(a in text for a in self.added):
            return self.slow(text)
        try:
            return np.frombuffer(self.fast.encode_to_numpy(text), np.uint32)
        except ValueError:
            return self.slow(text)

    def slow(self, text: str) -> np.ndarray:
        return np.array(self.exact.encode(text, add_special_tokens=False).ids, np.uint32)


def fill(counts: dict[int, int], capacity: int) -> list[tuple[int, int]]:
    """The multiset of the available lengths whose sum is at most and closest to capacity: (length, how often).

    Bit s of reach[i] says that the first i (length, copies) steps can sum to s. Copies are split into powers of
    two, so that a length that is there n times costs log n shifts. Longer lengths come first; the sums stop as soon
    as the capacity is reached exactly.
    """
    mask, reach, steps = (1 << (capacity + 1)) - 1, [1], []
    for length in sorted((x for x, n in counts.items() if n and x <= capacity), reverse=True):
        left, k = min(counts[length], capacity // length), 1
        while left:
            k = min(k, left)
            steps.append((length, k))
            reach.append((reach[-1] | (reach[-1] << (length * k))) & mask)
            left, k = left - k, 2 * k
            if reach[-1] >> capacity & 1:
                break
        if reach[-1] >> capacity & 1:
            break
    total, taken = reach[-1].bit_length() - 1, Counter()
    for i in range(len(steps), 0, -1):
        if not reach[i - 1] >> total & 1:
            length, k = steps[i - 1]
            taken[length] += k
            total -= length * k
    return sorted(taken.items(), reverse=True)


def pack(lengths: np.ndarray, capacity: int, keep_open: bool) -> tuple[list[list[tuple[int, int, int]]], list[int]]:
    """Windows as lists of (item, start in the item, length), and the items left over (only with keep_open).

    Items longer than capacity give whole windows first; what remains of each is at most one piece. Each window is
    seeded with the longest piece and completed by fill(). If the best multiset leaves slack while pieces remain, the
    shortest piece that is longer than the slack is cut to close it. With keep_open, windows that could not be closed
    are not made and their items are left over.
    """
    windows: list[list[tuple[int, int, int]]] = []
    pools: dict[int, list[tuple[int, int]]] = defaultdict(list)  # length -> (item, start)
    for item, n in enumerate(lengths.tolist()):
        whole = n // capacity
        windows += [[(item, k * capacity, capacity)] for k in range(whole)]
        if n % capacity:
            pools[n % capacity].append((item, whole * capacity))
    counts = {n: len(p) for n, p in pools.items()}
    while counts:
        seed = max(counts)
        if keep_open and sum(n * c for n, c in counts.items()) < capacity:
            return windows, sorted(i for p in pools.values() for i, _ in p)
        rest = dict(counts)
        rest[seed] -= 1
        chosen = Counter(dict(fill(rest, capacity - seed)))
        chosen[seed] += 1
        slack = capacity - sum(n * c for n, c in chosen.items())
        times = min(counts[n] // c for n, c in chosen.items()) if not slack else 1
        for _ in range(times):
            windows.append([(*pools[n].pop(), n) for n, c in chosen.items() for _ in range(c)])
        for n, c in chosen.items():
            counts[n] -= c * times
            if not counts[n]:
                del counts[n]
        if slack and counts:  # every piece that is left is longer than the slack: cut one
            n = min(counts)
            item, start = pools[n].pop()
            windows[-1].append((item, start, slack))
            counts[n] -= 1
            if not counts[n]:
                del counts[n]
            pools[n - slack].append((item, start + slack))
            counts[n - slack] = counts.get(n - slack, 0) + 1
    return windows, []


SCHEMA = (
    "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, "
    "sequence_tokens long, padded_to long"
)


def padded_to(tokens: int, capacity: int) -> int:
    """A sequence whose fill is a power of two stays as it is; any other is padded to the capacity."""
    return tokens if tokens & (tokens - 1) == 0 else capacity


def pack_documents(
    docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, block_tokens: int = BLOCK_TOKENS
) -> DataFrame:
    """Pack (doc_id, text) into sequences of at most `capacity` ids; one row per piece, its ids as little-endian uint32.

    Every task packs the documents of its own input partition, block after block, so nothing is shuffled or sent to
    the driver, memory is bounded by block_tokens plus one document, and a lost task is computed anew from its input.
    Each partition can leave one window that isn't full.

    Null and empty texts are a document of the end id alone. Repeated rows, also of one doc_id, are documents of
    their own. Which of equally long pieces shares a window is the task's choice. An empty table gives no row. Other
    columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, made = ByteBPE(), 0
        base = TaskContext.get().partitionId() << 33
        held: list[tuple[object, int, np.ndarray, int]] = []  # doc_id, first id's place, ids, ids of the document
        size = 0

        def emit(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, size, made
            windows, left = pack(np.array([len(h[2]) for h in held], np.int64), capacity, not last)
            for k in range(0, len(windows), 512):
                cols: list[list] = [[] for _ in range(9)]
                for window in windows[k : k + 512]:
                    total, at = sum(n for _, _, n in window), 0
                    for item, start, n in window:
                        doc, first, ids, tokens = held[item]
                        row = (doc, first + start, n, ids[start : start + n].tobytes(), tokens, base + made, at, total)
                        for c, v in zip(cols, (*row, padded_to(total, capacity)), strict=True):
                            c.append(v)
                        at += n
                    made += 1
                kinds = [pa.int64()] * 3 + [pa.binary()] + [pa.int64()] * 5
                names = [f.split()[0] for f in SCHEMA.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)
            starts: dict[int, int] = defaultdict(int)
            for window in windows:
                for item, start, n in window:
                    starts[item] = max(starts[item], start + n)
            held = [(h[0], h[1] + starts[i], h[2][starts[i] :], h[3]) for i in left for h in (held[i],)]
            size = sum(len(h[2]) for h in held)

        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for k in range(0, len(ids), BATCH_ROWS):
                for doc, text in zip(ids[k : k + BATCH_ROWS], texts[k : k + BATCH_ROWS].to_pylist(), strict=True):
                    own = np.append(encode(text), np.uint32(end_id)).astype("<u4")
                    held.append((doc, 0, own, len(own)))
                    size += len(own)
                    if size >= block_tokens:
                        yield from emit(False)
        yield from emit(True)

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(tidy(run), SCHEMA)
