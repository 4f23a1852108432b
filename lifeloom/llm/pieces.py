"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie.

Pieces and their log scores come from a model file. The trie's transitions are arrays (base, check), so that many
words advance through it at once; the best path is a vectorised dynamic programme over all distinct words of a
batch. A character that no piece covers becomes its UTF-8 bytes (byte fallback).

White space is written as the marker U+2581, with one put before the text, as the model's identity normaliser does.
No piece has the marker after another character, so a best path can be cut before each run of markers, and equal words
are encoded once a batch. A long word, such as a text without spaces, is cut at each place that no piece of the model
crosses in it; what stays long goes through a dynamic programme of its own over all places where pieces match, in blocks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

MARK = "▁"
MODEL = "piece_bpe_32k.model"
#: A character without a piece costs this much less than the worst piece.
UNKNOWN_PENALTY = 10.0
#: Word bytes that are laid out at once in the dynamic programme.
PLANE = 1_000_000
#: Characters from which a word is cut further, and bytes from which a part is encoded by itself.
LONG = 64
#: Bytes of a long word whose matches are held at once.
BLOCK = 1 << 18
#: Encoded words that a task keeps at hand.
KNOWN_WORDS = 200_000
_WORDS = re.compile(f"{MARK}+[^{MARK}\n]*|[^{MARK}\n]+|\n+")


def spread(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... (size[0] of them), begin[1], ..."""
    return np.arange(int(size.sum())) + np.repeat(begin - (np.cumsum(size) - size), size)


def load_pieces(path: str) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Pieces, scores and kinds (1 normal, 2 unknown, 3 control, 4 user defined, 6 byte) of a model file."""
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    return (
        [p.piece for p in model.pieces],
        np.array([p.score for p in model.pieces], np.float64),
        np.array([p.type for p in model.pieces], np.int64),
    )


class DoubleArrayTrie:
    """Byte trie in two arrays: from state s, byte b leads to t = base[s] + b + 1 if check[t] == s."""

    def __init__(self, entries: dict[bytes, int]):
        children: list[dict[int, int]] = [{}]
        value = [-1]
        for word, v in entries.items():
            node = 0
            for b in word:
                node = children[node].setdefault(b, len(children))
                if node == len(children):
                    children.append({})
                    value.append(-1)
            value[node] = v
        size = 2 * len(children) + 1024
        self.base, self.check = np.zeros(size, np.int64), np.full(size, -1, np.int64)
        self.value = np.full(size, -1, np.int64)
        used = bytearray(size)
        used[0] = 1
        place, first = {0: 0}, 1
        todo = [0]
        for node in todo:
            kids = sorted(children[node])
            if not kids:
                continue
            while used[first]:
                first += 1
            base = max(0, first - kids[0] - 1)
            while base + kids[-1] + 1 < size and any(used[base + b + 1] for b in kids):
                base = self._next_free(used, base + kids[0] + 2) - kids[0] - 1
            if base + kids[-1] + 258 > size:
                grow = size
                self.base = np.concatenate([self.base, np.zeros(grow, np.int64)])
                self.check = np.concatenate([self.check, np.full(grow, -1, np.int64)])
                self.value = np.concatenate([self.value, np.full(grow, -1, np.int64)])
                used.extend(bytearray(grow))
                size += grow
            s = place[node]
            self.base[s] = base
            for b in kids:
                t, kid = base + b + 1, children[node][b]
                used[t] = 1
                self.check[t], self.value[t] = s, value[kid]
                place[kid] = t
                todo.append(kid)

    @staticmethod
    def _next_free(used: bytearray, at: int) -> int:
        found = used.find(b"\0", at)
        return found if found >= 0 else len(used)

    def step(self, states: np.ndarray, bytes_: np.ndarray) -> np.ndarray:
        """The next states; -1 where there is none."""
        t = self.base[states] + bytes_ + 1
        return np.where(self.check[t] == states, t, -1)


class Unigram:
    """Encoder and decoder for a table of pieces with log scores."""

    def __init__(self, pieces: list[str], scores: np.ndarray, kinds: np.ndarray):
        normal = np.flatnonzero((kinds == 1) | (kinds == 4))
        self.scores = scores
        self.trie = DoubleArrayTrie({pieces[i].encode(): int(i) for i in normal})
        self.longest = max(len(pieces[i].encode()) for i in normal)
        self.byte_id = np.full(256, int(np.flatnonzero(kinds == 2)[0]), np.int64)
        for i in np.flatnonzero(kinds == 6):
            self.byte_id[int(pieces[i][1:-1], 16)] = i
        self.unknown_score = float(scores[normal].min()) - UNKNOWN_PENALTY
        #: What each id stands for, markers already written as spaces.
        self.bytes_of = [p.replace(MARK, " ").encode() if k in (1, 4) else b"" for p, k in zip(pieces, kinds, strict=True)]
        for i in np.flatnonzero(kinds == 6):
            self.bytes_of[i] = bytes([int(pieces[i][1:-1], 16)])
        inner = [pieces[i] for i in normal if MARK in pieces[i].lstrip(MARK) or "\n" in pieces[i].strip("\n")]
        self.split = _WORDS.findall if not inner else (lambda text: [text])
        self.forget()

    @classmethod
    def from_file(cls, path: str | None = None) -> Unigram:
        if path is None:
            import public_tokenizers

            path = public_tokenizers.path(MODEL)
        return cls(*load_pieces(path))

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best paths of words: all ids one after another, how many each word has, and the paths' scores."""
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        ids, sizes, scores, k = [], [], [], 0
        while k < len(order):
            if len(words[order[k]]) > LONG:
                path, score = self._alone(words[order[k]])
                ids.append(path)
                sizes.append(np.array([len(path)]))
                scores.append(np.array([score]))
                k += 1
                continue
            n = 1
            while k + n < len(order) and n < 65536 and (n + 1) * (size := len(words[order[k + n]]) + 1) <= PLANE and size <= LONG + 1:
                n += 1
            for x, y in zip((ids, sizes, scores), self._viterbi([words[i] for i in order[k : k + n]]), strict=True):
                x.append(y)
            k += n
        if not words:
            return np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0)
        size, score, flat = np.concatenate(sizes), np.concatenate(scores), np.concatenate(ids)
        place = np.empty(len(words), np.int64)
        place[order] = np.arange(len(words))
        begin = np.cumsum(size) - size
        return flat[spread(begin[place], size[place])], size[place], score[place]

    def _viterbi(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        width, n = len(words[-1]), len(words)
        lengths = np.array([len(w) for w in words], np.int64)
        text = np.frombuffer(b"".join([w.ljust(width, b"\0") for w in words]), np.uint8).reshape(n, width).T.astype(np.int32)
        best = np.full((width + 1, n), -np.inf)
        piece = np.full((width + 1, n), -2, np.int32)  # -1: a character without a piece
        start = np.zeros((width + 1, n), np.int32)
        best[0] = 0.0
        for i in range(width):
            live = np.flatnonzero((lengths > i) & (best[i] > -np.inf))
            if not len(live):
                continue
            lead = text[i, live]
            step = np.where(lead < 128, 1, np.where(lead < 224, 2, np.where(lead < 240, 3, 4)))
            end = np.minimum(i + step, lengths[live])
            self._better(best, piece, start, live, end, best[i, live] + self.unknown_score, -1, i)
            at, states, j = live, np.zeros(len(live), np.int64), i
            while len(at) and j < width:
                states = self.trie.step(states, text[j, at])
                ok = (states >= 0) & (lengths[at] > j)
                at, states, j = at[ok], states[ok], j + 1
                value = self.trie.value[states]
                hit = value >= 0
                if hit.any():
                    rows, ids = at[hit], value[hit]
                    self._better(best, piece, start, rows, np.full(len(rows), j), best[i, rows] + self.scores[ids], ids, i)
        steps, at, rows = [], lengths.copy(), np.flatnonzero(lengths)
        while len(rows):
            ends = at[rows]
            p, s = piece[ends, rows], start[ends, rows]
            steps.append((rows, p, s, ends))
            at[rows] = s
            rows = rows[s > 0]
        size = np.zeros(n, np.int64)
        for rows, p, s, e in steps:
            size[rows] += np.where(p >= 0, 1, e - s)
        left = np.cumsum(size)
        ids = np.empty(int(size.sum()), np.int32)
        for rows, p, s, e in steps:
            left[rows] -= np.where(p >= 0, 1, e - s)
            whole = p >= 0
            ids[left[rows[whole]]] = p[whole]
            for r, a, b in zip(rows[~whole].tolist(), s[~whole].tolist(), e[~whole].tolist(), strict=True):
                ids[left[r] : left[r] + b - a] = self.byte_id[list(words[r][a:b])]
        return ids, size, best[lengths, np.arange(n)]

    def _matches(self, text: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, piece) of all pieces that begin in text[lo:hi], by start and then by end."""
        at = np.arange(lo, hi)
        at = at[(text[lo:hi] & 0xC0) != 0x80]
        states, found, j = np.zeros(len(at), np.int64), [], 0
        while len(at):
            inside = at + j < len(text)
            at, states = at[inside], states[inside]
            states = self.trie.step(states, text[at + j])
            ok = states >= 0
            at, states, j = at[ok], states[ok], j + 1
            value = self.trie.value[states]
            hit = value >= 0
            found.append((at[hit], at[hit] + j, value[hit]))
        start, end, piece = (np.concatenate([f[c] for f in found]) if found else np.empty(0, np.int64) for c in range(3))
        order = np.lexsort((end, start))
        return start[order], end[order], piece[order]

    @staticmethod
    def _steps(text: np.ndarray) -> np.ndarray:
        """Bytes of the character that begins at each place."""
        return np.where(text < 128, 1, np.where(text < 224, 2, np.where(text < 240, 3, 4)))

    def parts(self, word: str) -> list[str]:
        """The word cut wherever no piece crosses: best paths of the parts make up its best path."""
        data = word.encode("utf-8", "replace")
        text = np.frombuffer(data, np.uint8).astype(np.int64)
        first = (text & 0xC0) != 0x80
        reach = np.zeros(len(text), np.int64)
        reach[first] = np.flatnonzero(first) + self._steps(text)[first]
        for lo in range(0, len(text), BLOCK):
            start, end, _ = self._matches(text, lo, min(len(text), lo + BLOCK))
            np.maximum.at(reach, start, end)
        far = np.maximum.accumulate(reach)
        cuts = np.flatnonzero(first[1:] & (far[:-1] <= np.arange(1, len(text)))) + 1
        places = [0, *cuts.tolist(), len(data)]
        return [data[a:b].decode("utf-8", "replace") for a, b in zip(places, places[1:], strict=False)]

    def _alone(self, word: bytes) -> tuple[np.ndarray, float]:
        """Ids and score of the best path of one long word."""
        text = np.frombuffer(word, np.uint8).astype(np.int64)
        n, room = len(text), max(self.longest, 4) + 1
        piece, start = np.full(n + 1, -2, np.int32), np.zeros(n + 1, np.int64)
        none = -float("inf")
        best = [0.0] + [none] * room
        for lo in range(0, n, BLOCK):
            hi = min(n, lo + BLOCK)
            begin, end, value = self._matches(text, lo, hi)
            chars = np.arange(lo, hi)[(text[lo:hi] & 0xC0) != 0x80]
            # The character by itself comes first, as a match without a piece.
            begin = np.concatenate([chars, begin])
            end = np.concatenate([np.minimum(n, chars + self._steps(text[chars])), end])
            score = np.concatenate([np.full(len(chars), self.unknown_score), self.scores[value]])
            value = np.concatenate([np.full(len(chars), -1), value])
            order = np.argsort(begin, kind="stable")
            begin, end, value, score = begin[order], end[order], value[order], score[order]
            best = best[: room + 1] + [none] * (hi - lo)
            chosen = [-1] * len(best)
            for k, (i, j, more) in enumerate(zip((begin - lo).tolist(), (end - lo).tolist(), score.tolist(), strict=True)):
                total = best[i] + more
                if total > best[j]:
                    best[j] = total
                    chosen[j] = k
            for_end = np.array(chosen)
            at = np.flatnonzero(for_end >= 0)
            kept = at[at + lo <= n]
            piece[kept + lo], start[kept + lo] = value[for_end[kept]], begin[for_end[kept]]
            score_at_end = best[n - lo] if hi == n else none
            best = best[hi - lo :]
        out, j = [], n
        while j > 0:
            i = int(start[j])
            out.append([int(piece[j])] if piece[j] >= 0 else self.byte_id[list(word[i:j])].tolist())
            j = i
        return np.array([x for part in reversed(out) for x in part], np.int32), float(score_at_end)

    @staticmethod
    def _better(best, piece, start, rows, ends, score, value, i) -> None:
        """Keep the higher score; on equal scores the piece that starts first (is longer) stays."""
        more = score > best[ends, rows]
        rows, ends = rows[more], ends[more]
        best[ends, rows] = score[more]
        piece[ends, rows] = value[more] if isinstance(value, np.ndarray) else value
        start[ends, rows] = i

    def segments(self, text: str | None) -> list[str]:
        """The words, and parts of long words, of a text between which a best path can be cut."""
        words = self.split(MARK + text.replace(" ", MARK)) if text else []
        if max(map(len, words), default=0) <= LONG:
            return words
        return [x for w in words for x in (self.parts(w) if len(w) > LONG else (w,))]

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.size, self.score = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0)

    def look_up(self, words: list[str]) -> np.ndarray:
        """Places of distinct words among the known ones; words not met lately are encoded."""
        if len(self.known) + len(words) > KNOWN_WORDS or len(self.ids) > 8 * KNOWN_WORDS:
            self.forget()
        new = [w for w in words if w not in self.known]
        ids, size, score = self.encode_words([w.encode("utf-8", "replace") for w in new])
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
        self.ids, self.size = np.concatenate([self.ids, ids]), np.concatenate([self.size, size])
        self.score = np.concatenate([self.score, score])
        return np.array([self.known[w] for w in words], np.int64)

    def encode_batch(self, texts: list[str | None]) -> list[tuple[np.ndarray, float]]:
        """(ids, score of the best path) of each text; null and empty texts have no ids."""
        split = [self.segments(t) for t in texts]
        counts = [len(s) for s in split]
        coded = pa.array(list(chain.from_iterable(split)), pa.large_string()).dictionary_encode()
        which = self.look_up(coded.dictionary.to_pylist())[coded.indices.to_numpy(zero_copy_only=False)]
        begin = np.cumsum(self.size) - self.size
        out, k = [], 0
        for n in counts:
            w = which[k : k + n]
            k += n
            out.append((self.ids[spread(begin[w], self.size[w])], float(self.score[w].sum())))
        return out

    def encode(self, text: str | None) -> list[int]:
        return self.encode_batch([text])[0][0].tolist()

    def decode(self, ids) -> str:
        """Text of ids: bytes put together, markers as spaces, the marker before the text taken off."""
        text = b"".join([self.bytes_of[i] for i in ids]).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


SCHEMA = "doc_id long, ids binary, n_ids long, n_byte_ids long, score double, decoded string"
BATCH_CHARS = 1_000_000


def _batches(texts: list, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about limit characters; a longer text stands alone."""
    lo = chars = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > lo and chars + n > limit:
            yield lo, i
            lo, chars = i, 0
        chars += n
    if lo < len(texts):
        yield lo, len(texts)


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Ids (little-endian uint32) of each text of docs (doc_id, text), the best path's score, and what they decode to.

    One pass without a shuffle. Null and empty texts have no ids and decode to the empty text. U+2581 in a text is
    decoded to a space, as in every SentencePiece model. Of paths of equal score the one whose last piece starts first wins.
    Repeated rows each give a row; an empty table gives none. Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Unigram.from_file(path)
        is_byte = np.zeros(len(model.bytes_of), bool)
        is_byte[np.unique(model.byte_id)] = True
        for b in batches:
            texts = b.column(1).to_pylist()
            for lo, hi in _batches(texts, BATCH_CHARS):
                coded = model.encode_batch(texts[lo:hi])
                cols = (
                    pa.array([x.astype("<u4").tobytes() for x, _ in coded], pa.binary()),
                    pa.array([len(x) for x, _ in coded], pa.int64()),
                    pa.array([int(is_byte[x].sum()) for x, _ in coded], pa.int64()),
                    pa.array([s for _, s in coded], pa.float64()),
                    pa.array([model.decode(x.tolist()) for x, _ in coded], pa.string()),
                )
                yield pa.RecordBatch.from_arrays([b.column(0)[lo:hi], *cols], names=[f.split()[0] for f in SCHEMA.split(", ")])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(run, SCHEMA)


