"""What the corpus operators share: scratch tables, batch slicing, components."""

from __future__ import annotations

import atexit
import gc
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder

#: Text bytes that a task handles at once; numpy temporaries are a small multiple of it.
SLICE_BYTES = 4 << 20


#: Folders that this process made in the shared folder and has not cleared yet.
_made: list[str] = []


#: Bytes of an Arrow batch between the JVM and a worker, beside the ten thousand rows that Spark allows: what both hold of long texts.
BATCH_BYTES = 8 << 20


def bound_batches(spark: SparkSession) -> None:
    """Bound the session's Arrow batches by bytes. The setting counts when a plan runs, so it stays."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, which ``clear`` deletes."""
    bound_batches(spark)
    path = f"{shared_folder(spark)}/tidemark-{name}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(clear)
    _made.append(path)
    return path


def clear(spark: SparkSession | None = None) -> None:
    """Delete all scratch tables; results that read them can no longer be used. Runs by itself when the process ends with its session open."""
    spark = spark or SparkSession.getActiveSession()
    if spark is not None and spark.sparkContext._jsc is not None:
        hadoop = spark.sparkContext._jsc.hadoopConfiguration()
        for path in _made:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(hadoop).delete(place, True)
    _made.clear()


#: On a local or mounted file system Hadoop starts a process for the mode and writes a checksum file for each file it makes; its plain file system does neither. Other stores don't look at this.
PLAIN_FILES = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}


def write(df: DataFrame, path: str) -> None:
    """Write ``df`` as Parquet to a scratch path."""
    df.write.options(**PLAIN_FILES).option("compression", "zstd").parquet(path)


def tidy(spark: SparkSession) -> None:
    """Let the driver go of what finished queries left: their plans, and the files of their shuffles. Else its heap grows to its bound, from query to query."""
    gc.collect()  # the JVM keeps what Python still names
    spark._jvm.System.gc()


def scratch(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again, which cuts the lineage; the driver is tidied."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    write(df, path)
    tidy(spark)
    return spark.read.schema(df.schema).parquet(path)


def with_broadcast_if_small(df: DataFrame, most_rows: int = 20_000) -> DataFrame:
    """Mark a written table for broadcast if it has at most ``most_rows`` narrow rows; else leave the join to shuffle."""
    small = df.limit(most_rows + 1).count() <= most_rows
    return F.broadcast(df) if small else df


def text_bytes(column: pa.Array) -> pa.Array:
    """UTF-8 bytes of a text column, null as empty, with 64-bit offsets."""
    return pc.fill_null(column, "").cast(pa.large_string()).cast(pa.large_binary())


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows with about ``most`` text bytes each; a longer text is a run by itself."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(size) // most
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts end to end, and where each begins (one more entry for the end)."""
    data = text_bytes(column)
    if isinstance(data, pa.ChunkedArray):
        data = data.combine_chunks()
    offsets = np.frombuffer(data.buffers()[1], np.int64)[data.offset : data.offset + len(data) + 1]
    raw = data.buffers()[2]
    got = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return got[offsets[0] : offsets[-1]], offsets - offsets[0]


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions start, start + 1, ... of each run, end to end."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def hash_pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Spark's xxhash64 of two bigints."""
    u = np.uint64
    turn = lambda x, k: (x << u(k)) | (x >> u(64 - k))
    p1, p2, p3, p4, p5 = (u(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    h = np.full(len(a), 42, u)
    for key in (a, b):
        h = (h + u(8) + p5) ^ (turn(key.view(u) * p2, 31) * p1)
        h = turn(h, 27) * p1 + p4
        h = (h ^ (h >> u(33))) * p2
        h = (h ^ (h >> u(29))) * p3
        h = h ^ (h >> u(32))
    return h.view(np.int64)


def local_roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest reachable index of each of ``n`` nodes under the undirected links a[i]-b[i], by min-label hooking and pointer jumping."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up
        if np.array_equal(before, root):
            break
    return root


#: Nodes of a round that may count as hubs, at most.
HUBS = 20_000


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an undirected link table, as rows (node, component) for every linked node.

    The component is its smallest node. Large-star and small-star rounds alternate
    until no link changes; each round is written to the shared folder, so a lost
    executor costs at most one round. Nodes with over 1/``HUBS`` of all link ends
    are hubs: there are fewer than ``HUBS`` of them, so their least neighbours are
    broadcast and the links of a hub need not meet in one task.
    """

    def checked(links: DataFrame):
        return links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()

    links = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct()
    links = scratch(links, "links")
    before = checked(links)
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("ends"))
        often = 2 * before.n / HUBS
        hubs = low.where(F.col("ends") > often).select("u", F.col("m").alias("hub_m"))
        marked = both.join(F.broadcast(hubs), "u", "left")
        plain = marked.where("hub_m is null").drop("hub_m").join(low.where(F.col("ends") <= often).drop("ends"), "u")
        large = plain.unionByName(marked.where("hub_m is not null").withColumnRenamed("hub_m", "m"))
        large = large.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        links = scratch(small, "links")
        now = checked(links)
        if now == before:
            break
        before = now
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
