"""Sequence packing with a bounded number of open windows.

Every document is tokenised and closed with an end token. Whole windows of a
long document leave at once; the rest is placed best-fit among the ``open_windows``
open windows of its partition. When none has room, the fullest open window is
topped up with the first ids of the piece and emitted, and the rest of the
piece is placed. What is left open when a partition ends is merged in rounds:
the leftovers of ``FAN_IN`` tasks go through the same placing in one task, so a
task of a round reads at most ``FAN_IN`` x ``open_windows`` windows, until one is left.
The windows of the last task are cut at powers of two, which need no padding.

Defined cases: a null or empty text is one end token; a row without an id and a
repeated id are packed as often as they come; a text of any length is cut into
whole windows; of windows with equal room the one opened first is filled; an
empty table gives no pieces; other columns of the input are ignored. The order of documents in a partition is the order in
which Spark reads them.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Letters and other characters about whose class there is no doubt.
LETTER, SIGN = "[A-Za-zÀ-ÖØ-öø-ɏ]", r"[\x00-@\[-`{-\x7f]"
#: The characters by which a byte-level vocabulary spells bytes: printable ones by themselves, the others from U+0100 on.
PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_SIGNS = {b: b for b in PRINTED} | {b: 256 + k for k, b in enumerate(x for x in range(256) if x not in PRINTED)}
#: Words whose ids a worker remembers, and text bytes it encodes at once: larger slices look up fewer words.
REMEMBERED, SLICE_BYTES = 800_000, 8 << 20
#: Tasks whose leftovers one task merges.
FAN_IN = 8
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, window long, offset long"


class WordEncoder:
    """Ids of many texts by a byte-level tokenizer, each distinct word encoded once.

    A single blank between two other characters always begins a new
    pre-token, so a text can be cut there and its parts encoded apart. A text
    with a blank beside other white space is encoded whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        with open(path, encoding="utf-8") as file:
            rules = json.load(file)
        # words are only cut where the pre-tokenizer is known to cut; with any other, texts are encoded whole
        before = rules.get("pre_tokenizer") or {}
        self.cuts = rules.get("normalizer") is None and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
        self.known: dict[str, int] = {}
        self.ids, self.starts, self.lengths = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _plain(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words end to end, and how many each has.

        A letter before a sign always ends a pre-token, and so does a single
        line end between a sign or letter and a letter: words are cut there,
        and a part of letters only is one pre-token, which goes straight to
        the tokenizer's model.
        """
        cut = pc.replace_substring_regex(pa.array(words, pa.large_string()), f"({LETTER})({SIGN})", "\\1\x1e\\2")
        cut = pc.replace_substring_regex(cut, f"\x1e([!-~]*\n)({LETTER})", "\x1e\\1\x1e\\2")
        split = pc.split_pattern(cut, "\x1e")
        parts = pc.dictionary_encode(split.values)
        single = pc.match_substring_regex(parts.dictionary, f"^ ?{LETTER}+$")
        plain = pc.and_(single, pc.string_is_ascii(parts.dictionary))
        lettered = pc.and_not(single, plain)
        tokenize = self.tokenizer.model.tokenize
        # a blank is all that is spelled another way in ASCII letters
        tokens = [tokenize(x) for x in pc.replace_substring(parts.dictionary.filter(plain), " ", chr(BYTE_SIGNS[32])).to_pylist()]
        tokens += [tokenize(x.encode().decode("latin-1").translate(BYTE_SIGNS)) for x in parts.dictionary.filter(lettered).to_pylist()]
        other = self._plain(parts.dictionary.filter(pc.invert(single)).to_pylist())
        length = np.fromiter(chain(map(len, tokens), map(len, other)), np.int64, len(parts.dictionary))
        flat = np.fromiter(chain((t.id for x in tokens for t in x), chain.from_iterable(other)), np.uint32, int(length.sum()))
        place = np.empty(len(length), np.int64)
        place[np.concatenate([np.flatnonzero(x.to_numpy(zero_copy_only=False)) for x in (plain, lettered, pc.invert(single))])] = np.arange(len(length))
        code = place[parts.indices.to_numpy()]
        size = length[code]
        ends = np.concatenate([[0], np.cumsum(size)])[split.offsets.to_numpy()]
        return flat[common.ragged((np.cumsum(length) - length)[code], size)], np.diff(ends)

    def _numbers(self, words: list[str]) -> np.ndarray:
        """The number of each distinct word among those known."""
        known = self.known
        if len(known) > REMEMBERED:  # forgotten whole, as any text can be encoded anew
            known.clear()
            self.ids, self.starts, self.lengths = self.ids[:0], self.starts[:0], self.lengths[:0]
        number = np.fromiter((known.get(w, -1) for w in words), np.int64, len(words))
        new = np.flatnonzero(number < 0)
        if len(new):
            spelled = [words[k] for k in new.tolist()]
            ids, length = self._encode(spelled)
            number[new] = np.arange(len(known), len(known) + len(new))
            known.update(zip(spelled, number[new].tolist()))
            self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(length) - length])
            self.lengths, self.ids = np.concatenate([self.lengths, length]), np.concatenate([self.ids, ids])
        return number

    def __call__(self, texts: pa.Array) -> list[np.ndarray]:
        """uint32 ids of each text."""
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        if not self.cuts:
            return [np.array(ids, np.uint32) for ids in self._plain(texts.to_pylist())]
        odd = pc.match_substring_regex(texts, r"[\s\pZ\x{85}\x{1c}-\x{1f}] | [\s\pZ\x{85}\x{1c}-\x{1f}]|\x{1e}").to_numpy(zero_copy_only=False).astype(bool)
        out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(texts)
        if odd.any():
            at = np.flatnonzero(odd)
            for k, ids in zip(at.tolist(), self._plain(texts.take(pa.array(at)).to_pylist())):
                out[k] = np.array(ids, np.uint32)
        at = np.flatnonzero(~odd)
        if not len(at):
            return out
        split = pc.split_pattern(pc.replace_substring(texts.take(pa.array(at)), " ", "\x1e "), "\x1e")  # before each blank
        words = pc.dictionary_encode(split.values)
        offsets = split.offsets.to_numpy()
        number = self._numbers(words.dictionary.to_pylist())[words.indices.to_numpy()]
        length = self.lengths[number]
        ids = self.ids[common.ragged(self.starts[number], length)]
        ends = np.concatenate([[0], np.cumsum(length)])[offsets]
        for k, a, b in zip(at.tolist(), ends[:-1].tolist(), ends[1:].tolist()):
            out[k] = ids[a:b]
        return out


@lru_cache(maxsize=1)
def encoder(path: str) -> WordEncoder:
    """This worker's encoder, which keeps the words of earlier tasks."""
    return WordEncoder(path)


class Windows:
    """The open windows of one task. ``put`` yields the windows it closes, each a list of pieces."""

    def __init__(self, size: int, most: int):
        self.size, self.most = size, most
        self.pieces: list[list[tuple]] = []
        self.room = np.zeros(0, np.int64)

    def _close(self, k: int) -> list[tuple]:
        closed = self.pieces.pop(k)
        self.room = np.delete(self.room, k)
        return closed

    def put(self, doc: int, start: int, ids: np.ndarray, total: int) -> Iterator[list[tuple]]:
        while len(ids):
            if len(ids) >= self.size:
                yield [(doc, start, ids[: self.size], total)]
                start, ids = start + self.size, ids[self.size :]
                continue
            fits = np.where(self.room >= len(ids), self.room, self.size + 1)
            k = int(fits.argmin()) if len(fits) else 0
            if len(fits) and fits[k] <= self.size:
                self.pieces[k].append((doc, start, ids, total))
                self.room[k] -= len(ids)
                if not self.room[k]:
                    yield self._close(k)
                return
            if len(self.pieces) < self.most:
                self.pieces.append([(doc, start, ids, total)])
                self.room = np.append(self.room, self.size - len(ids))
                return
            k = int(self.room.argmin())  # the fullest, topped up
            n = int(self.room[k])
            self.pieces[k].append((doc, start, ids[:n], total))
            start, ids = start + n, ids[n:]
            yield self._close(k)


def _rows(windows: list[tuple[int, list[tuple]]]) -> pa.RecordBatch:
    doc, start, length, ids, total, window, offset = ([] for _ in range(7))
    for number, pieces in windows:
        at = 0
        for d, s, i, t in pieces:
            doc.append(d), start.append(s), length.append(len(i)), ids.append(i.astype("<u4").tobytes()), total.append(t), window.append(number), offset.append(at)
            at += len(i)
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip((doc, start, length, ids, total, window, offset), kinds)], names=["doc_id", "start", "length", "ids", "doc_tokens", "window", "offset"])


def _powers(pieces: list[tuple], number: int) -> Iterator[tuple[int, list[tuple]]]:
    """A window cut into windows whose lengths are powers of two; they get the numbers from ``number`` on."""
    left = sum(len(p[2]) for p in pieces)
    queue = list(pieces)
    while left:
        need = 1 << (left.bit_length() - 1)
        left -= need
        now = []
        while need:
            d, s, i, t = queue.pop(0)
            now.append((d, s, i[:need], t))
            if len(i) > need:
                queue.insert(0, (d, s + need, i[need:], t))
            need -= len(now[-1][2])
        yield number, now
        number += 1


def pack(docs: DataFrame, tokenizer: str, window: int = 2048, open_windows: int = 64, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids (little-endian uint32), doc_tokens, sequence_id, offset.

    A sequence_id has the round and task that closed it in its upper bits; it
    is unique, not gapless. Memory of a task: its open windows, one slice of
    text and the remembered words; a text longer than a slice, and one that cannot be cut
    because it has no blank or one beside other white space, is encoded whole.
    """

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 36
        encode, windows, number = encoder(tokenizer), Windows(window, open_windows), 0
        for batch in common.slices(batches, "text", SLICE_BYTES):
            closed = []
            for doc, ids in zip(batch.column(0).to_pylist(), encode(batch.column(1))):
                ids = np.append(ids, np.uint32(end_id))
                for pieces in windows.put(doc, 0, ids, len(ids)):
                    closed.append((base + number, pieces))
                    number += 1
            yield _rows(closed)
        left = -1 - TaskContext.get().partitionId()  # leftovers carry their task as a negative number
        yield _rows([(left, pieces) for pieces in windows.pieces])

    def again(step: int, last: bool):
        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            base = (step << 60) | TaskContext.get().partitionId() << 36
            windows, number = Windows(window, open_windows), 0
            for batch in batches:
                closed = []
                for doc, start, ids, total in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "start", "ids", "doc_tokens"))):
                    for pieces in windows.put(doc, start, np.frombuffer(ids, "<u4"), total):
                        closed.append((base + number, pieces))
                        number += 1
                yield _rows(closed)
            if not last:
                left = -1 - TaskContext.get().partitionId()
                yield _rows([(left, pieces) for pieces in windows.pieces])
                return
            closed = []
            for pieces in windows.pieces:
                closed += _powers(pieces, base + number)
                number = closed[-1][0] - base + 1
            yield _rows(closed)

        return task

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    made = common.scratch(source.mapInArrow(first, SCHEMA), "packed")
    done, left, step = [made.where("window >= 0")], made.where("window < 0"), 0
    while True:
        # the tasks that left something open, by the numbers they wrote
        tasks = -(left.agg(F.min("window")).first()[0] or -1)
        step, groups = step + 1, -(-tasks // FAN_IN)
        group = F.floor((-1 - F.col("window")) / FAN_IN).cast("int")
        dealt = left.repartitionById(groups, group) if groups > 1 else left.repartition(1)
        merged = common.scratch(dealt.sortWithinPartitions("doc_id", "start", "length", "ids").mapInArrow(again(step, groups == 1), SCHEMA), "merged")
        done.append(merged.where("window >= 0"))
        left = merged.where("window < 0")
        if groups == 1:
            break
    whole = done[0]
    for part in done[1:]:
        whole = whole.unionByName(part)
    return whole.withColumnRenamed("window", "sequence_id")
