"""SimHash near-duplicates by anchor-point covering.

A text becomes a 64-bit fingerprint. Two fingerprints that differ in at most
``distance`` = 4 bits differ in at most one bit of at least one of three blocks
(21, 21 and 22 bits). On a block the anchors are a covering code: a Hamming
[15, 11] code word on the first 15 bits and anything on the rest, so every
value lies within covering radius 1 of its own anchor. A fingerprint is
replicated to every anchor within radius + block threshold = 2 bits (14 or 15
of them), so that a pair meets at the own anchor of either member, and
fingerprints are compared per anchor, an own member against all. Each anchor
sends on a spanning forest of its links, never all pairs.

Defined cases: a null or blank text has fingerprint zero and links like any
other; a text is read whole, however long; repeated rows are returned as often
as they come, with one component; a row without an id links like any other, and
a component of such rows alone has no id (null); an empty table gives an empty
result; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: First bit and width of each block.
BLOCKS = ((0, 21), (21, 21), (42, 22))
#: Width of the part of a block that the Hamming code covers.
CODED = 15
#: Members of an anchor beyond which its comparisons are split over several tasks.
HOT = 8192
#: Linking pairs that are gathered before they are folded into the roots of an anchor's members.
FOLD = 1 << 18
#: Hashes whose bits are unpacked at once.
UNPACK = 1 << 16


def fingerprint(text: bytes, shingle: int = 4, seed: int = 42) -> int:
    """Majority bits of the XXH64 of each word shingle of a UTF-8 text; 0 for a text without words."""
    words = text.lower().split()  # of bytes: A-Z only, and white space 0x20 and 0x09-0x0D
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(joined, seed)]
    else:
        length = np.fromiter(map(len, words), np.int64, len(words))
        end = np.cumsum(length + 1) - 1
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], seed) for a, b in zip((end - length).tolist(), end[shingle - 1 :].tolist())]
    h = np.array(hashes, np.uint64)
    ones = np.zeros(64, np.int64)
    for k in range(0, len(h), UNPACK):
        ones += np.unpackbits(h[k : k + UNPACK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(h), bitorder="little")
    return int(bits.view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, fp): the fingerprint of every row, as a signed 64-bit value, and Spark's xxhash64 of its text."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.fromiter((fingerprint(x.as_buffer().to_pybytes() if x.is_valid else b"", shingle) for x in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(fp.view(np.int64))], names=["doc_id", "text_hash", "fp"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_hash"))
    return source.mapInArrow(task, "doc_id long, text_hash long, fp long")


def _patterns(width: int) -> tuple[list[list[int]], list[int]]:
    """For each Hamming syndrome: the bit patterns of weight up to 2 that lead to an anchor, and the one that leads to the own anchor."""
    column = [k + 1 if k < CODED else 0 for k in range(width)]
    found: list[list[int]] = [[] for _ in range(16)]
    for weight in (0, 1, 2):
        for at in combinations(range(width), weight):
            found[reduce(lambda s, k: s ^ column[k], at, 0)].append(sum(1 << k for k in at))
    return found, [0, *(1 << k for k in range(CODED))]


def _syndrome(value: Column) -> Column:
    masks = [sum(1 << k for k in range(CODED) if (k + 1) >> b & 1) for b in range(4)]
    parts = [F.shiftleft(F.bit_count(value.bitwiseAND(F.lit(m))) % 2, b) for b, m in enumerate(masks)]
    return reduce(lambda a, b: a + b, parts)


def replicas(prints: DataFrame) -> DataFrame:
    """(key, own, fp): every fingerprint at each anchor within covering radius plus threshold."""
    parts = []
    for k, (first, width) in enumerate(BLOCKS):
        patterns, leaders = _patterns(width)
        value = F.shiftrightunsigned("fp", first).bitwiseAND(F.lit((1 << width) - 1)).cast("int")
        table = F.array(*(F.array(*map(F.lit, p)) for p in patterns))
        one = prints.select("fp", value.alias("v")).withColumn("s", _syndrome(F.col("v")) + 1)
        one = one.withColumn("leader", F.element_at(F.array(*map(F.lit, leaders)), F.col("s")))
        one = one.select("fp", "v", "leader", F.explode(F.element_at(table, F.col("s"))).alias("p"))
        parts.append(one.select((F.lit(k << 22) + F.col("v").bitwiseXOR(F.col("p"))).alias("key"), (F.col("p") == F.col("leader")).alias("own"), "fp"))
    return reduce(DataFrame.unionByName, parts)


def _links_of(key: np.ndarray, own: np.ndarray, fp: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links within each run of equal keys, as pairs of fingerprints.

    Hits are folded into the roots of the members every ``FOLD`` pairs, pairs
    that are joined already are passed over, and a run whose members have one
    root is done: memory is that of the members. A tree is given as a chain, so
    that no fingerprint becomes a hub here.
    """
    n = len(key)
    root, run = np.arange(n), np.cumsum(np.concatenate([[0], key[1:] != key[:-1]])) if n else np.zeros(0, np.int64)
    first = np.flatnonzero(np.diff(run, prepend=-1))
    at, step, left, right, held = np.arange(n), 1, [], [], 0
    while len(at := at[at < n - step]) and len(at := at[key[at] == key[at + step]]):
        near = (root[at] != root[at + step]) & (own[at] | own[at + step]) & (np.bitwise_count(fp[at] ^ fp[at + step]) <= distance)
        hit = at[near]
        left.append(root[hit])
        right.append(root[hit + step])
        held += len(hit)
        step += 1
        if held > FOLD:
            root = common.local_roots(np.concatenate(left), np.concatenate(right), n)[root]
            left, right, held = [], [], 0
            whole = np.minimum.reduceat(root, first) == np.maximum.reduceat(root, first)
            at = at[~whole[run[at]]]
    if held:
        root = common.local_roots(np.concatenate(left), np.concatenate(right), n)[root]
    order = np.lexsort((fp, root))
    joined = root[order[1:]] == root[order[:-1]]
    return fp[order[:-1][joined]], fp[order[1:][joined]]


def links(prints: DataFrame, distance: int = 4) -> DataFrame:
    """(a, b): a spanning forest of the links between distinct fingerprints. ``prints`` has them in column fp."""
    if distance > 4:
        raise ValueError("the blocks cover distances of 4 bits or fewer")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        for batch in batches:
            now = [batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_numpy().view(np.uint64)]
            now = now if held is None else [np.concatenate(x) for x in zip(held, now)]
            cut = int(np.searchsorted(now[0], now[0][-1])) if len(now[0]) else 0
            held = [x[cut:] for x in now]
            if cut:
                a, b = _links_of(*(x[:cut] for x in now), distance)
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])
        if held is not None and len(held[0]):
            a, b = _links_of(*held, distance)
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    rows = replicas(prints).withColumn("key", F.col("key").cast("long"))
    hot = common.scratch(rows.groupBy("key").count().where(F.col("count") > HOT), "hot-anchors")
    if hot.limit(1).count():  # such an anchor's members go to blocks of at most HOT on average, and every two blocks to a task
        m = F.ceil(F.coalesce(F.col("count"), F.lit(0)) / HOT).cast("long")
        mine = F.pmod(F.xxhash64("fp"), F.greatest(m, F.lit(1)))
        rows = rows.join(common.with_broadcast_if_small(hot), "key", "left").withColumn("m", F.greatest(m, F.lit(1))).withColumn("mine", mine)
        rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1)))
        pair = F.least("mine", "other") * F.col("m") + F.greatest("mine", "other")
        rows = rows.select((F.shiftleft("key", 38) + pair).alias("key"), "own", "fp")
    rows = rows.select("key", "own", "fp").repartition("key").sortWithinPartitions("key")
    return rows.mapInArrow(task, "a long, b long")


def _classes(prints: DataFrame, distance: int) -> DataFrame:
    """(fp, component): the component of each distinct fingerprint is its smallest fingerprint."""
    distinct = common.scratch(prints.select("fp").distinct(), "distinct-fingerprints")
    found = common.components(links(distinct, distance)).select(F.col("node").alias("fp"), "component")
    return distinct.join(found, "fp", "left").withColumn("component", F.coalesce("component", "fp"))


def near_duplicates(docs: DataFrame, shingle: int = 4, distance: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) for every row; the component is its smallest doc_id."""
    prints = common.scratch(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    grouped = _classes(prints, distance).join(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "fp")
    least = grouped.groupBy("component").agg(F.min("least").alias("component_id"))
    classes = grouped.join(least, "component").select("fp", "component_id")
    return prints.join(classes, "fp").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, shingle: int = 4, distance: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay when one of each component does: that of the least id (rows without one last), of equal ids that of the least text hash, of equal texts the least row."""
    prints = common.scratch(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    rank = F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "text_hash")
    first = prints.groupBy("fp").agg(F.min(rank).alias("first"))
    first = _classes(prints, distance).join(first, "fp").groupBy("component").agg(F.min("first").alias("first"))
    kept = common.scratch(first.select(F.col("first.doc_id").alias("kept_id"), F.col("first.text_hash").alias("kept_hash")), "kept")
    own, text = F.col(id_col).cast("long"), F.xxhash64(text_col)
    rows = docs.select(F.struct("*").alias("row"), own.alias("own_id"), text.alias("own_hash"))
    rows = rows.join(kept, F.col("own_id").eqNullSafe(F.col("kept_id")) & (F.col("own_hash") == F.col("kept_hash")), "left_semi")
    again = prints.groupBy("doc_id", "text_hash").count().where("count > 1").select(F.col("doc_id").alias("kept_id"), F.col("text_hash").alias("kept_hash"))
    same = F.col("own_id").eqNullSafe(F.col("kept_id")) & (F.col("own_hash") == F.col("kept_hash"))
    again = common.scratch(again, "repeated")
    if again.limit(1).count():
        several = rows.join(again, same, "left_semi").groupBy("own_id", "own_hash").agg(F.min("row").alias("row"))
        rows = rows.join(again, same, "left_anti").select("row").unionByName(several.select("row"))
    return rows.select("row.*")
