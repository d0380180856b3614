"""SentencePiece encoding and decoding in batches of words.

A file whose piece scores are whole numbers is of merge type: they are merge
ranks, and a word is encoded by joining, again and again, the neighbouring
pair whose joined piece ranks best, the leftmost of equals. Any other file's
scores are unigram log-probabilities: a word gets the segmentation of the
greatest total score, by Viterbi, ties going to the longest last piece. A
character without a piece falls back to its bytes; for the Viterbi it costs
the least score minus 10. Words of equal length advance together: all their
substrings of one length are hashed and looked up in the sorted keys of the
pieces of that length, and the joins or backpointers work on those tables.

Texts are cut before every run of blanks (no piece goes on across one), so
each distinct word is encoded once in a task and remembered.

Defined cases: a null or empty text has no ids; a row without an id keeps none;
a word of any length is encoded whole, in n log n steps by merges; the mark U+2581 in a text
decodes to a blank; repeated rows are each returned; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

MARK = "▁"
WORD = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
UNKNOWN_PENALTY = 10.0
#: Words that advance together, and words that a task remembers.
TOGETHER, REMEMBERED = 16384, 400_000
#: Characters beyond which a word is merged by itself, with a heap.
LONG = 48
BASE = np.uint64(0x9E3779B97F4A7C15)


class Vocabulary:
    """Pieces of a SentencePiece file, with sorted keys for each length."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.bytes_of: list[bytes] = [b""] * n
        self.byte_ids = np.zeros(256, np.int64)
        normal = []
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_ids[int(piece[3:-1], 16)] = i
                self.bytes_of[i] = bytes([int(piece[3:-1], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                if MARK in piece.lstrip(MARK):
                    raise ValueError(f"piece {i} goes on across a blank")
                normal.append((piece, model.get_score(i), i))
                self.bytes_of[i] = piece.replace(MARK, " ").encode()
        #: Whether the scores are merge ranks.
        self.merges = all(s == int(s) for _, s, _ in normal)
        self.by_piece = {p: (s, i) for p, s, i in normal} if self.merges else {}
        self.unknown = min(s for _, s, _ in normal) - UNKNOWN_PENALTY
        self.longest = max(len(p) for p, _, _ in normal)
        self.powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(self.longest, BASE)]), dtype=np.uint64)
        self.keys: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.zeros(0, np.uint64),) * 3] * (self.longest + 1)
        for k in range(1, self.longest + 1):
            own = [x for x in normal if len(x[0]) == k]
            codes = np.array([[ord(c) for c in p] for p, _, _ in own], np.uint64).reshape(len(own), k)
            key = self._mixed(self._prefixes(codes)[:, k])
            order = np.argsort(key)
            self.keys[k] = key[order], np.array([s for _, s, _ in own])[order] if own else np.zeros(0), np.array([i for _, _, i in own], np.int64)[order] if own else np.zeros(0, np.int64)
        self.flat = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.sizes = np.fromiter(map(len, self.bytes_of), np.int64, n)
        self.starts = np.cumsum(self.sizes) - self.sizes

    @staticmethod
    def _prefixes(codes: np.ndarray) -> np.ndarray:
        """Polynomial hashes of the prefixes of each row."""
        out = np.zeros((codes.shape[0], codes.shape[1] + 1), np.uint64)
        for k in range(codes.shape[1]):
            out[:, k + 1] = out[:, k] * BASE + codes[:, k] + np.uint64(1)
        return out

    @staticmethod
    def _mixed(key: np.ndarray) -> np.ndarray:
        return common.mix(key)

    def _tables(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Score (-inf if none) and id (-1) of the piece of each length at each character of words of one length."""
        n, m = len(words[0]), len(words)
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(m, n)
        prefix = self._prefixes(codes.astype(np.uint64))
        most = min(n, self.longest)
        score = np.full((most + 1, m, n), -np.inf)
        piece = np.full((most + 1, m, n), -1, np.int32)
        for k in range(1, most + 1):
            keys, scores, ids = self.keys[k]
            if not len(keys):
                continue
            key = self._mixed(prefix[:, k:] - prefix[:, : n - k + 1] * self.powers[k])
            at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            hit = keys[at] == key
            score[k, :, : n - k + 1] = np.where(hit, scores[at], -np.inf)
            piece[k, :, : n - k + 1] = np.where(hit, ids[at], -1)
        return score, piece

    def _merge(self, words: list[str]) -> np.ndarray:
        """As ``_viterbi``, by the order of the merges."""
        score, piece = self._tables(words)
        most, (m, n) = len(score) - 1, score.shape[1:]
        # a word's symbols stand at the left of its row: where each begins, then n
        start = np.tile(np.append(np.arange(n + 1), n), (m, 1))
        live = np.arange(m)
        while len(live) and n > 1:
            now = start[live]
            size = now[:, 2:] - now[:, :-2]
            joined = score[np.minimum(size, most), live[:, None], np.minimum(now[:, :-2], n - 1)]
            joined[(size > most) | (now[:, 1:-1] >= n)] = -np.inf
            at = joined.argmax(axis=1)
            more = joined[np.arange(len(live)), at] > -np.inf
            live, now, at = live[more], now[more], at[more]
            place = np.arange(n + 1)[None, :]
            start[live, :-1] = np.take_along_axis(now, place + (place > at[:, None]), axis=1)
        out = np.full((m, n), -1, np.int32)
        row, col = np.nonzero(start[:, :-1] < n)
        first, size = start[row, col], start[row, col + 1] - start[row, col]
        got = piece[size, row, first]
        out[row, first] = np.where(got < 0, -2, got)
        return out

    def _merge_long(self, word: str) -> np.ndarray:
        """As ``_merge``, for one word of any length."""
        n, known = len(word), self.by_piece
        after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        heap: list[tuple[float, int, int, int]] = []

        def offer(a: int) -> None:
            b = after[a]
            if b < n and (found := known.get(word[a : end[b]])):
                heapq.heappush(heap, (-found[0], a, b, end[b]))

        for k in range(n):
            offer(k)
        while heap:
            _, a, b, stop = heapq.heappop(heap)
            if end[a] != b or end[b] != stop:  # one of the two has been joined meanwhile
                continue
            end[a], end[b], after[a] = stop, -1, after[b]
            if after[a] < n:
                before[after[a]] = a
            if before[a] >= 0:
                offer(before[a])
            offer(a)
        out, k = np.full(n, -1, np.int32), 0
        while k < n:
            out[k] = known.get(word[k : end[k]], (0, -2))[1]
            k = end[k]
        return out

    def _viterbi(self, words: list[str]) -> np.ndarray:
        """Ids of words of one length: at a piece's first character its id, else -1; -2 for a character without a piece."""
        score, piece = self._tables(words)
        most, (m, n) = len(score) - 1, score.shape[1:]
        lone = piece[1] < 0
        score[1][lone], piece[1][lone] = self.unknown, -2
        best = np.full((m, n + 1), -np.inf)
        best[:, 0] = 0
        back = np.zeros((m, n + 1), np.int32)
        for end in range(1, n + 1):
            for k in range(min(end, most), 0, -1):
                total = best[:, end - k] + score[k, :, end - k]
                more = total > best[:, end]
                best[more, end] = total[more]
                back[more, end] = k
        out = np.full((m, n), -1, np.int32)
        rows, end = np.arange(m), np.full(m, n)
        while len(rows):
            k = back[rows, end]
            end = end - k
            out[rows, end] = piece[k, rows, end]
            rows, end = rows[end > 0], end[end > 0]
        return out

    def encode_words(self, words: list[str], merges: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words end to end, and how many each has, by Viterbi or by merges. ``words`` are not empty."""
        length = np.fromiter(map(len, words), np.int64, len(words))
        parts: list[np.ndarray] = [np.zeros(0, np.int64)] * len(words)
        for n in np.unique(length).tolist():
            own = np.flatnonzero(length == n)
            step = max(1, min(TOGETHER, (4 << 20) // (n * min(n, self.longest))))
            for a in range(0, len(own), step):
                some = own[a : a + step].tolist()
                if merges:
                    ids = self._merge([words[k] for k in some]) if n <= LONG else [self._merge_long(words[k]) for k in some]
                else:
                    ids = self._viterbi([words[k] for k in some])
                for k, row in zip(some, ids):
                    row_ids = row[row != -1]
                    if (row_ids == -2).any():
                        row_ids = np.concatenate([self.byte_ids[list(words[k][c].encode("utf-8", "surrogatepass"))] if i == -2 else np.array([i]) for c, i in enumerate(row.tolist()) if i != -1])
                    parts[k] = row_ids
        count = np.fromiter(map(len, parts), np.int64, len(parts))
        return np.concatenate(parts).astype(np.int32) if parts else np.zeros(0, np.int32), count

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 of the text that ``ids`` stand for."""
        text = self.flat[common.ragged(self.starts[ids], self.sizes[ids])].tobytes()
        return text[1:] if text[:1] == b" " else text


class Encoder:
    """Ids of many texts, each distinct word encoded once and remembered."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.starts, self.counts = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _numbers(self, words: list[str]) -> np.ndarray:
        if len(self.known) > REMEMBERED:
            self._forget()
        new = [w for w in words if w not in self.known]
        if new:
            ids, count = self.vocabulary.encode_words(new, self.vocabulary.merges)
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
            self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(count) - count])
            self.counts, self.ids = np.concatenate([self.counts, count]), np.concatenate([self.ids, ids])
        return np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))

    def __call__(self, texts: pa.Array) -> list[np.ndarray]:
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(texts)
        odd = pc.match_substring_regex(texts, f"^ |  |{MARK}").to_numpy(zero_copy_only=False).astype(bool)
        empty = pc.equal(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(bool)
        for k in np.flatnonzero(odd).tolist():
            words = WORD.findall((" " + texts[k].as_py()).replace(" ", MARK))
            distinct = list(dict.fromkeys(words))
            number = dict(zip(distinct, self._numbers(distinct).tolist()))
            number = np.array([number[w] for w in words])
            out[k] = self.ids[common.ragged(self.starts[number], self.counts[number])]
        at = np.flatnonzero(~odd & ~empty)
        if len(at):
            split = pc.split_pattern(texts.take(pa.array(at)), " ")
            words = pc.dictionary_encode(split.values)
            number = self._numbers([MARK + w for w in words.dictionary.to_pylist()])[words.indices.to_numpy()]
            count = self.counts[number]
            ids = self.ids[common.ragged(self.starts[number], count)]
            ends = np.concatenate([[0], np.cumsum(count)])[split.offsets.to_numpy()].tolist()
            for k, a, b in zip(at.tolist(), ends[:-1], ends[1:]):
                out[k] = ids[a:b]
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """This worker's encoder, which keeps the vocabulary and the words of earlier tasks."""
    return Encoder(Vocabulary(path))


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_ids, ids, ids_crc32, decoded_sha256, round_trip) for every row: ids as an array, the CRC-32 of their little-endian uint32, and the digest of what they decode to."""
    names = ["doc_id", "n_ids", "ids", "ids_crc32", "decoded_sha256", "round_trip"]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in common.slices(batches, "text"):
            every = own(batch.column(1))
            decoded = [own.vocabulary.decode(ids) for ids in every]
            same = [d == x.as_buffer().to_pybytes() for d, x in zip(decoded, common.text_bytes(batch.column(1)))]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in every])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(map(len, every), pa.int64()),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(every).astype(np.int32))),
                    pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in every], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in decoded]),
                    pa.array(same),
                ],
                names=names,
            )

    schema = "doc_id long, n_ids long, ids array<int>, ids_crc32 long, decoded_sha256 string, round_trip boolean"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(task, schema)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = encoder(path).vocabulary
        for batch in batches:
            texts = [vocabulary.decode(np.array(x.as_py() or [], np.int64)).decode("utf-8", "replace") for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(task, "doc_id long, text string")
