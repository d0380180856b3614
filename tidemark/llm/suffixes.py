"""Removal of repeated byte strings by bucket-pointer refinement over sampled suffixes.

A byte goes if a ``size`` = 50-byte string that covers it also starts in a
document with a smaller id. Bucket identifiers are 64-bit hashes, made as in
bucket-pointer refinement: the bucket of a 2k-byte string is the pair of the
buckets of the k-byte strings at offsets 0 and k, and every refinement reuses
the identifiers of the one before (2, 4, 8, 16, 32, 50 bytes).

Only sampled suffixes are exchanged. Each 50-byte string has a representative
16-byte suffix start, the one with the least bucket identifier among its 35;
equal strings have it at the same offset. Neighbouring strings that share it
form a run. Stage one sends a row for each run (about one for 18 bytes) to its
16-byte bucket and refines the bucket by the identifiers of the run's first
and last string, which together cover the run: in runs that are equal as a
whole, all but those of the smallest document go. Stage two refines what is
left to single strings: only runs whose bucket holds several documents and
several variants are opened, one for each variant.

Rows travel as arrays, one row for each bucket range and task slice, so a
shuffle moves few large rows and a reducer holds one bucket range at a time.
Buckets are mixed before they are dealt and the number of ranges grows with the
text, so ranges are even. Within a slice, equal runs are reduced to the one of
the smallest document before the shuffle, so a passage of any frequency brings
one row for each slice. A range with more rows than ``RANGE_ROWS`` (a frequent
16-byte string in ever new contexts) is not held: its rows are reduced piece by
piece and dealt again by (bucket, refined bucket), or by the 50-byte string, in
a Spark aggregation to the smallest document.

Strings are told apart by identifiers: 88 bits for whole runs, 128 for single
strings. With n runs about n^2 / 2^89 pairs of different runs are confused: 5e-9
over 30 GB, 0.05 over 100 TB.

A row is known by its id or, where it has none or its id has several texts, by its id and
a 64-bit hash of its text (``keyed``), so no row loses bytes for another's sake.

Defined cases: a null text is empty; rows that share an id are one document in
the order of documents, whatever their texts, and never lose bytes to each other; each keeps
its own spans, and all are returned as often as they come; a row without an id comes after
all rows with one (the id 2^63 - 1 counts as none), and such rows are ordered by
the hash of their text, equal texts being one document; strings never cross
rows; a text may be longer than any slice; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Bytes of the first bucket, and bits by which bucket ranges are dealt to reducers.
GRAM, RANGE_BITS = 16, 12
#: Rows of a range that a task holds: of runs, and of opened runs, each of which is up to 35 strings.
RANGE_ROWS, OPENED_ROWS = 1 << 21, 1 << 17
#: Bytes of text for one range, beyond those of 2^RANGE_BITS ranges.
RANGE_BYTES = 8 << 20
#: The document number of rows without an id, which their keys order.
WITHOUT_ID = (1 << 63) - 1
#: Bytes of text whose rows are gathered before they are sent.
GATHER = 8 << 20
#: Bytes of text that are hashed at once.
SLICE = 1 << 19
#: Bits of a sort key that hold a position; the others hold the leading bits of a bucket identifier.
POSITION_BITS = np.uint64(31)
SPANS = "doc_id long, key long, kind byte, a int, b int, x long, y long"


def pair(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The bucket identifier of two neighbouring strings from theirs."""
    z = x * np.uint64(0x9E3779B97F4A7C15) + y
    z ^= z >> np.uint64(32)
    z *= np.uint64(0xD6E8FEB86659FD93)
    z ^= z >> np.uint64(29)
    return z


def refine(data: np.ndarray, size: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """Identifiers of the 16-byte and of the ``size``-byte string at each position (both ``len(data) - size + 1`` or longer)."""
    if not 2 * GRAM < size <= 2 * GRAM + GRAM + 2 * GRAM:
        raise ValueError("strings of 33 to 80 bytes")
    ids = {1: pair(data.astype(np.uint64), np.uint64(0xA5))}
    k = 1
    while k < 2 * GRAM:
        ids[2 * k] = pair(ids[k][: len(ids[k]) - k], ids[k][k:])
        k *= 2
    whole, at, left = ids[2 * GRAM], 2 * GRAM, size - 2 * GRAM
    while left:
        k = min(2 * GRAM, 1 << (left.bit_length() - 1))
        n = max(0, min(len(whole), len(ids[k]) - at))
        whole = pair(whole[:n], ids[k][at : at + n])
        at, left = at + k, left - k
    return ids[GRAM], whole


def runs(data: np.ndarray, offsets: np.ndarray, size: int = 50) -> tuple[np.ndarray, ...]:
    """The runs of all texts: bucket, refined bucket, text number, first string and count of strings less one."""
    none = (np.zeros(0, np.uint64), np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3)))
    if len(data) < size:
        return none
    gram, whole = refine(data, size)
    width, n = size - GRAM + 1, len(whole)
    key = (gram >> POSITION_BITS << POSITION_BITS) | np.arange(len(gram), dtype=np.uint64)
    k, low = 1, key
    while 2 * k <= width:
        low = np.minimum(low[: len(low) - k], low[k:])
        k *= 2
    if k < width:
        low = np.minimum(low[: len(low) - (width - k)], low[width - k :])
    chosen = (low[:n] & ((np.uint64(1) << POSITION_BITS) - np.uint64(1))).astype(np.int64)
    lengths = np.diff(offsets)
    text = np.repeat(np.arange(len(lengths)), lengths)[:n]
    valid = np.arange(n) + size <= offsets[1:][text]
    edge = np.ones(n, bool)
    edge[1:] = (chosen[1:] != chosen[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(edge & valid)
    if not len(first):
        return none
    stop = edge | ~valid
    marks = np.append(np.flatnonzero(stop), n)
    last = marks[np.searchsorted(marks, first, side="right")] - 1
    more = last - first
    refined = pair(whole[first], whole[last]) + more.astype(np.uint64)
    doc = text[first]
    return gram[chosen[first]], refined, doc, first - offsets[doc], more


def planes(x: np.ndarray, width: int) -> bytes:
    """The ``width`` low bytes of each value by significance, so that equal leading bytes compress."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1)[:, :width].T).tobytes()


def unplanes(raw: np.ndarray, n: int, kind: type, width: int) -> np.ndarray:
    out = np.zeros((n, np.dtype(kind).itemsize), np.uint8)
    out[:, :width] = raw.reshape(width, n).T
    return out.reshape(-1).view(kind)


class Sender:
    """Gives out equal-length columns as rows (range, n, size, blob), one for each range of the first column.

    The first column is an unsigned key below 2^KEY_BITS, whose upper bits
    are the range. ``kinds`` has the type of each column and the bytes kept of
    it. Each row of columns can have a payload of bytes besides.
    """

    schema = "part int, n int, size int, blob binary"

    def __init__(self, kinds: tuple[tuple[type, int], ...], bits: int):
        self.kinds, self.bits = kinds, bits

    def rows(self, columns: list[np.ndarray], payload: np.ndarray | None = None, lengths: np.ndarray | None = None) -> pa.RecordBatch:
        order = np.argsort(columns[0], kind="stable")
        columns = [np.asarray(c, k)[order] for c, (k, _) in zip(columns, self.kinds)]
        part = (columns[0] >> np.uint64(KEY_BITS - self.bits)).astype(np.int32)
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(part)]]) if len(part) else np.zeros(1, np.int64)
        if payload is not None:
            payload = payload[common.ragged((np.cumsum(lengths) - lengths)[order], lengths[order])]
            ends = np.concatenate([[0], np.cumsum(lengths[order])])[cuts].tolist()
        codec = pa.Codec("zstd", 3)
        sizes, blobs = [], []
        for k, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())):
            raw = b"".join(planes(c[a:b], w) for c, (_, w) in zip(columns, self.kinds))
            if payload is not None:
                raw += payload[ends[k] : ends[k + 1]].tobytes()
            sizes.append(len(raw))
            blobs.append(codec.compress(raw, asbytes=True))
        return pa.RecordBatch.from_arrays(
            [pa.array(part[cuts[:-1]], pa.int32()), pa.array(np.diff(cuts), pa.int32()), pa.array(sizes, pa.int32()), pa.array(blobs, pa.binary())], names=["part", "n", "size", "blob"]
        )

    def received(self, batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[bool, list[np.ndarray]]]:
        """Of each range in turn the columns and the payload of all its rows end to end, from rows sorted by range; a range of over ``most`` rows comes in pieces, which are marked False."""
        codec, now, held, rows, whole = pa.Codec("zstd"), None, [], 0, True
        for batch in batches:
            for part, n, size, blob in zip(*(batch.column(c) for c in ("part", "n", "size", "blob"))):
                part, n = part.as_py(), n.as_py()
                if part != now:
                    if held:
                        yield whole, [np.concatenate(x) for x in zip(*held)]
                    held, rows, whole = [], 0, True
                now, at, columns = part, 0, []
                raw = np.frombuffer(codec.decompress(blob.as_buffer(), size.as_py()), np.uint8)
                for kind, width in self.kinds:
                    columns.append(unplanes(raw[at : at + n * width], n, kind, width))
                    at += n * width
                held.append([*columns, raw[at:]])
                rows += n
                if rows > most:
                    whole = False
                    yield False, [np.concatenate(x) for x in zip(*held)]
                    held, rows = [], 0
        if held:
            yield whole, [np.concatenate(x) for x in zip(*held)]


def _dealt(df: DataFrame) -> DataFrame:
    return df.repartition("part").sortWithinPartitions("part")


def _later(doc: np.ndarray, key: np.ndarray, least: np.ndarray, least_key: np.ndarray) -> np.ndarray:
    """Whether each document comes after the least one."""
    return (doc > least) | ((doc == WITHOUT_ID) & (least == WITHOUT_ID) & (key > least_key))


def _spans(doc: np.ndarray, key: np.ndarray, kind: np.ndarray | int, a: np.ndarray, b: np.ndarray, x: np.ndarray | None = None, y: np.ndarray | None = None) -> pa.RecordBatch:
    kind = np.full(len(doc), kind, np.int8) if np.isscalar(kind) else kind.astype(np.int8)
    strings = [pa.nulls(len(doc), pa.int64()) if k is None else pa.array(k.view(np.int64)) for k in (x, y)]
    return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(key, pa.int64()), pa.array(kind), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), *strings], names=["doc_id", "key", "kind", "a", "b", "x", "y"])


def _settled(found: DataFrame, gone: Column, kept: Column | None) -> DataFrame:
    """``found`` with the rows that were dealt again by (x, y) decided: those of a larger document than the least go up to ``gone``, the others are to be opened up to ``kept`` or stay."""
    again = found.where(F.col("kind") == AGAIN)
    if not again.limit(1).count():
        return found.select("doc_id", "key", "kind", "a", "b")
    least = again.groupBy("x", "y").agg(F.min(F.struct("doc_id", "key")).alias("least"))
    later = (F.col("doc_id") > F.col("least.doc_id")) | ((F.col("doc_id") == WITHOUT_ID) & (F.col("least.doc_id") == WITHOUT_ID) & (F.col("key") > F.col("least.key")))
    again = again.join(least, ["x", "y"])
    again = again.select("doc_id", "key", F.when(later, GONE).otherwise(OPEN).cast("byte").alias("kind"), "a", F.when(later, gone).otherwise(F.col("b") if kept is None else kept).alias("b"))
    return found.where(F.col("kind") != AGAIN).select("doc_id", "key", "kind", "a", "b").unionByName(again)


#: Bits kept of a bucket identifier in an exchange; with the 40 of the refined one, 88 tell runs apart.
KEY_BITS = 48
#: Columns of a run: bucket, refined bucket, document, key (mostly the document again, which compresses), first string, strings less one, known to go.
RUN = ((np.uint64, 6), (np.uint64, 5), (np.int64, 8), (np.int64, 8), (np.uint32, 4), (np.uint8, 1), (np.uint8, 1))
#: Columns of an opened run, whose bytes are the payload: bucket, document, key, first string, strings less one.
OPENED = ((np.uint64, 6), (np.int64, 8), (np.int64, 8), (np.uint32, 4), (np.uint8, 1))
#: Kinds of rows in the table of decisions: bytes a to b go; strings a to b are to be opened; a run of b more strings than one, or a string, is to be judged with those of its x and y.
GONE, OPEN, AGAIN = 0, 1, 2


def decided(docs: DataFrame, size: int = 50, bits: int = RANGE_BITS) -> DataFrame:
    """Stage one: (doc_id, key, kind, a, b) for the runs of shared buckets."""

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, gathered = [], 0

        def rows() -> pa.RecordBatch:
            bucket, refined, doc, key, first, more = (np.concatenate(x) for x in zip(*held)) if held else (np.zeros(0, k) for k, _ in RUN[:6])
            order = np.lexsort((key, doc, refined, bucket))
            bucket, refined, doc, key, first, more = (x[order] for x in (bucket, refined, doc, key, first, more))
            lead = np.ones(len(bucket), bool)
            lead[1:] = (bucket[1:] != bucket[:-1]) | (refined[1:] != refined[:-1])
            of = np.flatnonzero(lead)[np.cumsum(lead) - 1]
            known = _later(doc, key, doc[of], key[of])
            # these go for certain: dealt by their own hash, only to be passed on
            bucket[known] = common.mix(doc[known].astype(np.uint64) + first[known].astype(np.uint64))
            held.clear()
            return Sender(RUN, bits).rows([bucket >> np.uint64(64 - KEY_BITS), refined, doc, key, first, more, known])

        for batch in common.slices(batches, "text", SLICE):
            data, offsets = common.flat(batch.column("text"))
            bucket, refined, text, first, more = runs(data, offsets, size)
            held.append((common.mix(bucket), refined >> np.uint64(24), *(batch.column(c).to_numpy()[text] for c in ("doc_id", "key")), first.astype(np.uint32), more.astype(np.uint8)))
            gathered += len(data)
            if gathered > GATHER:
                yield rows()
                gathered = 0
        yield rows()

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for range_whole, (bucket, refined, doc, key, first, more, known, _) in Sender(RUN, bits).received(batches, RANGE_ROWS):
            first, more, known = first.astype(np.int64), more.astype(np.int64), known.astype(bool)
            if known.any():
                yield _spans(doc[known], key[known], GONE, first[known], first[known] + more[known] + size)
                bucket, refined, doc, key, first, more = (x[~known] for x in (bucket, refined, doc, key, first, more))
            if not len(doc):
                continue
            order = np.lexsort((key, doc, refined, bucket))
            bucket, refined, doc, key, first, more = (x[order] for x in (bucket, refined, doc, key, first, more))
            new = np.ones(len(doc), bool)
            new[1:] = bucket[1:] != bucket[:-1]
            lead = new.copy()
            lead[1:] |= refined[1:] != refined[:-1]
            at = np.flatnonzero(new)
            group = np.cumsum(new) - 1
            last = np.maximum.reduceat(doc, at)
            shared = ((np.minimum.reduceat(doc, at) < last) | ((last == WITHOUT_ID) & (np.minimum.reduceat(key, at) < np.maximum.reduceat(key, at))))[group]
            several = (np.add.reduceat(lead.astype(np.int64), at) > 1)[group]
            of = np.flatnonzero(lead)[np.cumsum(lead) - 1]
            later = _later(doc, key, doc[of], key[of])
            if not range_whole:
                yield _spans(doc[later], key[later], GONE, first[later], (first + more + size)[later])
                yield _spans(doc[~later], key[~later], AGAIN, first[~later], more[~later], bucket[~later], refined[~later])
                continue
            gone = shared & later
            opened = shared & several & ~later
            keep = gone | opened
            yield _spans(doc[keep], key[keep], np.where(gone, GONE, OPEN)[keep], first[keep], np.where(gone, first + more + size, first + more)[keep])

    source = docs.select("doc_id", "key", "text")
    found = common.scratch(_dealt(source.mapInArrow(sent, Sender.schema)).mapInArrow(judged, SPANS), "runs")
    end = F.col("a") + F.col("b")
    return _settled(found, end + size, end)


def removed(docs: DataFrame, texts: DataFrame, size: int = 50, bits: int = RANGE_BITS) -> DataFrame:
    """(doc_id, key, spans): the byte spans that go, as an array of (a, b), for each row that loses any. ``texts`` is ``docs`` dealt out by doc_id and key."""
    first = decided(docs, size, bits)
    wanted = first.where(F.col("kind") == OPEN).groupBy("doc_id", "key").agg(F.collect_list(F.struct("a", "b")).alias("spans"))

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, gathered = [], 0

        def rows() -> pa.RecordBatch:
            *columns, lengths, payload = (np.concatenate(x) for x in zip(*held)) if held else (*(np.zeros(0, k) for k, _ in OPENED), np.zeros(0, np.int64), np.zeros(0, np.uint8))
            held.clear()
            return Sender(OPENED, bits).rows(columns, payload, lengths)

        for batch in common.slices(batches, "text", SLICE):
            batch = batch.filter(batch.column("spans").is_valid())
            data, offsets = common.flat(batch.column("text"))
            if len(data) < size:
                continue
            spans = batch.column("spans")
            row = np.repeat(np.arange(batch.num_rows), np.diff(spans.offsets.to_numpy()))
            items = spans.flatten()
            a, b = items.field("a").to_numpy().astype(np.int64), items.field("b").to_numpy().astype(np.int64)
            start, lengths = offsets[:-1][row] + a, b - a + size
            gram = refine(data, size)[0] >> POSITION_BITS
            width = size - GRAM + 1
            low = np.minimum.reduceat(gram[common.ragged(start, np.full(len(start), width))], np.arange(len(start)) * width) if len(start) else gram[:0]
            held.append((common.mix(low) >> np.uint64(64 - KEY_BITS), *(batch.column(c).to_numpy()[row] for c in ("doc_id", "key")), a, b - a, lengths, data[common.ragged(start, lengths)]))
            gathered += int(lengths.sum())
            if gathered > GATHER:
                yield rows()
                gathered = 0
        yield rows()

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for range_whole, (_, doc, key, first, more, payload) in Sender(OPENED, bits).received(batches, OPENED_ROWS):
            n = more.astype(np.int64) + 1
            lengths = n + size - 1
            start = np.cumsum(lengths) - lengths
            string, other = string_ids(payload, start, n, size)
            doc, key, at = np.repeat(doc, n), np.repeat(key, n), common.ragged(first.astype(np.int64), n)
            order = np.lexsort((key, doc, other, string))
            string, other, doc, key, at = (x[order] for x in (string, other, doc, key, at))
            new = np.ones(len(doc), bool)
            new[1:] = (string[1:] != string[:-1]) | (other[1:] != other[:-1])
            of = np.flatnonzero(new)[np.cumsum(new) - 1]
            gone = _later(doc, key, doc[of], key[of])
            if not range_whole:
                yield _spans(doc[~gone], key[~gone], AGAIN, at[~gone], at[~gone] + size, string[~gone], other[~gone])
            doc, key, at = doc[gone], key[gone], at[gone]
            order = np.lexsort((at, key, doc))
            doc, key, at = doc[order], key[order], at[order]
            edge = np.ones(len(doc), bool)
            edge[1:] = (doc[1:] != doc[:-1]) | (key[1:] != key[:-1]) | (at[1:] - at[:-1] > size)
            start = np.flatnonzero(edge)
            if len(start):
                stop = np.append(start[1:], len(doc)) - 1
                yield _spans(doc[start], key[start], GONE, at[start], at[stop] + size)

    # both joins with the texts are left joins on one exchange of them, which Spark makes once
    strings = texts.join(wanted, ["doc_id", "key"], "left").select("spans", *texts.columns).mapInArrow(opened, Sender.schema)
    second = _settled(common.scratch(_dealt(strings).mapInArrow(judged, SPANS), "strings"), F.col("a") + size, None)
    return first.unionByName(second).where(F.col("kind") == GONE).groupBy("doc_id", "key").agg(F.collect_list(F.struct("a", "b")).alias("spans"))


def string_ids(payload: np.ndarray, start: np.ndarray, n: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Two identifiers, 128 bits in all, of the ``n`` strings that begin in each run of the payload; runs are hashed a slice at a time."""
    one, two = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    part = start // SLICE
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(start)] if len(start) else [0]
    for a, b in zip(cuts, cuts[1:]):
        first = start[a]
        data = payload[first : start[b - 1] + n[b - 1] + size - 1]
        place = common.ragged(start[a:b] - first, n[a:b])
        one.append(refine(data, size)[1][place])
        two.append(refine(data ^ np.uint8(0x5A), size)[1][place])
    return np.concatenate(one), np.concatenate(two)


def cover(length: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether each of ``length`` bytes lies in one of the spans."""
    change = np.zeros(length + 1, np.int64)
    np.add.at(change, np.minimum(a, length), 1)
    np.add.at(change, np.minimum(b, length), -1)
    return np.cumsum(change)[:length] > 0


def range_bits(docs: DataFrame) -> int:
    """The logarithm of the number of bucket ranges for the text of ``docs``."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(RANGE_BITS, min(24, (total // RANGE_BYTES).bit_length()))


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) with ``key``: the id again, or a hash of the text where there is no id or the id has texts of several hashes."""
    digest = F.xxhash64(F.coalesce("text", F.lit("")))
    several = docs.where(F.col("doc_id") != WITHOUT_ID).groupBy("doc_id").agg(F.min(digest).alias("a"), F.max(digest).alias("b")).where("a <> b")
    several = common.scratch(several.select("doc_id"), "ids")
    if several.isEmpty():
        return docs.withColumn("key", F.when(F.col("doc_id") == WITHOUT_ID, digest).otherwise(F.col("doc_id")))
    marked = docs.join(common.with_broadcast_if_small(several.withColumn("_several", F.lit(True))), "doc_id", "left")
    own = (F.col("doc_id") == WITHOUT_ID) | F.col("_several").isNotNull()
    return marked.withColumn("key", F.when(own, digest).otherwise(F.col("doc_id"))).drop("_several")


def whole_characters(data: np.ndarray, covered: np.ndarray) -> np.ndarray:
    """``covered`` with all bytes of each UTF-8 character of which it has any."""
    number = np.cumsum((data & 0xC0) != 0x80) - 1
    hit = np.zeros(int(number[-1]) + 1 if len(number) else 0, bool)
    hit[number[covered]] = True
    return hit[number]


def without_repeats(docs: DataFrame, size: int = 50, bits: int | None = None, id_col: str = "doc_id", text_col: str = "text", rows: bool = False, characters: bool = False) -> DataFrame:
    """Every row with doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the remaining bytes).

    With ``rows`` the other columns of the input come along as the struct ``row``; with
    ``characters`` a character of which some bytes go goes whole.
    """
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "text"):
            out = []
            texts, spans = common.text_bytes(batch.column("text")), batch.column("spans")
            for text, span in zip(texts, spans):
                data = np.frombuffer(text.as_buffer(), np.uint8)
                gone = 0, 0
                if span.is_valid and len(data):
                    a, b = (span.values.field(c).to_numpy() for c in ("a", "b"))
                    covered = cover(len(data), a, b)
                    if characters:
                        covered = whole_characters(data, covered)
                    gone = int(covered.sum()), int(covered[0]) + int((covered[1:] & ~covered[:-1]).sum())
                    kept = data[~covered].tobytes()
                else:
                    kept = data.tobytes()
                out.append((len(data), *gone, hashlib.sha256(kept).hexdigest(), kept))
            columns = list(zip(*out))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            columns = [batch.column("id"), *(pa.array(c, k) for c, k in zip(columns, kinds))]
            yield pa.RecordBatch.from_arrays([*columns, *([batch.column("row")] if rows else [])], names=[*names, *(["row"] if rows else [])])

    own = F.col(id_col).cast("long")
    others = [F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != text_col)).alias("row")] if rows else []
    full = keyed(docs.select(F.coalesce(own, F.lit(WITHOUT_ID)).alias("doc_id"), F.col(text_col).alias("text"), own.alias("id"), *others))
    plain, texts = full.select("doc_id", "key", "text"), full.repartition("doc_id", "key")
    bits = range_bits(plain) if bits is None else bits
    both = texts.join(removed(plain, texts, size, bits), ["doc_id", "key"], "left").select("doc_id", "id", "text", "spans", *(["row"] if rows else []))
    return both.mapInArrow(task, schema + (f", row {full.schema['row'].dataType.simpleString()}" if rows else ""))
