"""Embedding near-duplicates by navigable small-world graphs.

Vectors are compared within their label only. Equal vectors become one
representative, the one of the least id, which carries their number. A label's
representatives are cut into shards of about ``shard_rows`` by a hash of the
id; a task builds one shard's hierarchical graph and stores it in the shared
folder, and every representative of the label queries every shard of it, in
blocks of about ``BLOCK`` queries, each of which reads the stored graph: the
queries of a shard are split over tasks. A query's beam has ``beam`` places and
takes in everything at or above the threshold besides. When a graph is built, an
audit compares up to ``AUDITED`` members with brute force over the shard and
doubles the beam until each of them finds ``AUDIT_RECALL`` of its links to
others or the beam holds the shard, which is brute force; every batch of queries
(members or not) audits ``AUDITED_HERE`` of its own in the same way and widens
the beam from there on. Every link is verified in double precision.

A task sends a count for each query and a spanning forest of each batch's
links, never all pairs; components join the forests. The work is that of every
representative in every shard of its label, so it grows with n^2 / ``shard_rows``.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite
components, and rows without a label or id, link with nothing; vectors of
different lengths do not link; of rows with one id the least (label,
embedding) counts; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SHARD_ROWS, NEIGHBOURS, BUILD_BEAM, BEAM = 16384, 12, 40, 24
AUDITED, AUDITED_HERE, AUDIT_RECALL = 512, 16, 0.999
#: Queries of a shard that one task answers, about.
BLOCK = 65536
#: Queries whose links are joined before they are sent.
BATCH = 2048
#: How far single precision may fall short of the exact cosine.
SLIP = 1e-4


class Graph:
    """A hierarchical navigable small-world graph over the rows of ``x`` (unit vectors)."""

    def __init__(self, x: np.ndarray):
        self.exact, self.x = x, x.astype(np.float32)
        n = len(x)
        # a level for each row from a fixed generator: rebuilt tasks build the same graph
        draw = np.random.default_rng(7).random(n)
        self.level = np.minimum((-np.log(np.maximum(draw, 1e-12)) / np.log(NEIGHBOURS)).astype(int), 8)
        self.links: list[dict[int, np.ndarray]] = [{} for _ in range(9)]
        self.seen, self.stamp = np.zeros(n, np.int64), 0
        self.entry = 0
        for k in range(n):
            self._insert(k)

    def stored(self, **others: np.ndarray) -> bytes:
        """The graph and other arrays as bytes."""
        arrays = dict(x=self.exact, level=self.level, entry=np.array(self.entry), **others)
        for k, layer in enumerate(self.links):
            arrays |= {f"nodes{k}": np.fromiter(layer, np.int64, len(layer)), f"sizes{k}": np.fromiter(map(len, layer.values()), np.int64, len(layer)), f"links{k}": np.concatenate([np.zeros(0, np.int64), *layer.values()])}
        out = io.BytesIO()
        np.savez(out, **arrays)
        return out.getvalue()

    @classmethod
    def read(cls, data: bytes) -> tuple[Graph, dict[str, np.ndarray]]:
        """What ``stored`` gave."""
        arrays = dict(np.load(io.BytesIO(data)))
        graph = cls.__new__(cls)
        graph.exact, graph.level, graph.entry = arrays["x"], arrays["level"], int(arrays["entry"])
        graph.x, graph.links = graph.exact.astype(np.float32), []
        for k in range(9):
            ends = np.cumsum(arrays[f"sizes{k}"])
            graph.links.append({n: arrays[f"links{k}"][b - size : b] for n, size, b in zip(arrays[f"nodes{k}"].tolist(), arrays[f"sizes{k}"].tolist(), ends.tolist())})
        graph.seen, graph.stamp = np.zeros(len(graph.x), np.int64), 0
        return graph, arrays

    def _walk(self, q: np.ndarray, entry: list[tuple[float, int]], beam: int, layer: int, limit: float = 2.0) -> list[tuple[float, int]]:
        """The ``beam`` nearest found, and all found at ``limit`` or above, best first."""
        self.stamp += 1
        seen, stamp, x, links = self.seen, self.stamp, self.x, self.links[layer]
        open_, best, sure = [], [], []
        for s, k in entry:
            seen[k] = stamp
            open_.append((-s, k))
            (sure if s >= limit else best).append((s, k))
        heapq.heapify(open_)
        heapq.heapify(best)
        while open_:
            s, k = heapq.heappop(open_)
            if len(best) >= beam and -s < best[0][0]:
                break
            near = links.get(k)
            if near is None:
                continue
            near = near[seen[near] != stamp]
            if not len(near):
                continue
            seen[near] = stamp
            sims = x[near] @ q
            if len(best) >= beam:
                good = sims > best[0][0]
                near, sims = near[good], sims[good]
            for v, j in zip(sims.tolist(), near.tolist()):
                if v >= limit:
                    sure.append((v, j))
                    heapq.heappush(open_, (-v, j))
                elif len(best) < beam:
                    heapq.heappush(best, (v, j))
                    heapq.heappush(open_, (-v, j))
                elif v > best[0][0]:
                    heapq.heapreplace(best, (v, j))
                    heapq.heappush(open_, (-v, j))
        return sorted(sure + best, reverse=True)

    def _diverse(self, found: list[tuple[float, int]], most: int) -> list[int]:
        """Neighbours that are nearer to the row than to any neighbour taken before, then the nearest of the rest."""
        ids = [k for _, k in found]
        if len(ids) <= most:
            return ids
        among = self.x[ids] @ self.x[ids].T
        own = [s for s, _ in found]
        taken = [0]
        for k in range(1, len(ids)):
            if len(taken) == most:
                break
            if own[k] > among[k, taken].max():
                taken.append(k)
        if len(taken) < most:
            left = set(taken)
            taken += [k for k in range(len(ids)) if k not in left][: most - len(taken)]
        return [ids[k] for k in taken]

    def _insert(self, k: int) -> None:
        top = self.level[k]
        if k == 0:
            for layer in range(top + 1):
                self.links[layer][k] = np.zeros(0, np.int64)
            return
        q, highest = self.x[k], self.level[self.entry]
        entry = [(float(self.x[self.entry] @ q), self.entry)]
        for layer in range(highest, -1, -1):
            found = self._walk(q, entry, 1 if layer > top else BUILD_BEAM, layer)
            if layer <= top:
                mine = self._diverse(found, NEIGHBOURS)
                most = NEIGHBOURS * (2 if layer == 0 else 1)
                self.links[layer][k] = np.array(mine, np.int64)
                for j in mine:
                    now = np.append(self.links[layer][j], k)
                    if len(now) > most + most // 2:  # pruned now and then, not at every insertion
                        sims = self.x[now] @ self.x[j]
                        order = np.argsort(-sims, kind="stable")
                        now = np.array(self._diverse(list(zip(sims[order].tolist(), now[order].tolist())), most), np.int64)
                    self.links[layer][j] = now
            entry = found[:1]
        if top > highest:
            for layer in range(highest + 1, top + 1):
                self.links[layer][k] = np.zeros(0, np.int64)
            self.entry = k

    def near(self, q: np.ndarray, threshold: float, beam: int) -> np.ndarray:
        """Rows whose exact cosine with the unit vector ``q`` is at ``threshold`` or above."""
        if beam >= len(self.x):
            hits = np.flatnonzero(self.x @ q.astype(np.float32) >= threshold - SLIP)
        else:
            single = q.astype(np.float32)
            entry = [(float(self.x[self.entry] @ single), self.entry)]
            for layer in range(self.level[self.entry], 0, -1):
                entry = self._walk(single, entry, 1, layer)[:1]
            found = self._walk(single, entry, beam, 0, threshold - SLIP)
            hits = np.array([k for s, k in found if s >= threshold - SLIP], np.int64)
        return hits[self.exact[hits] @ q >= threshold] if len(hits) else hits

    def audited_beam(self, threshold: float, queries: np.ndarray | None = None, own: np.ndarray | None = None, beam: int = BEAM) -> int:
        """The beam, from ``beam`` on, at which each query finds its share of links, without itself: its place is in ``own``. Without queries, evenly spaced members."""
        n = len(self.exact)
        if queries is None:
            own = np.unique(np.linspace(0, n - 1, min(n, AUDITED)).astype(np.int64))
            queries = self.exact[own]
        truth = [np.setdiff1d(np.flatnonzero(row >= threshold), k) for k, row in zip(own, queries @ self.exact.T)]
        while beam < n:
            if all(len(np.intersect1d(t, self.near(q, threshold, beam))) >= AUDIT_RECALL * len(t) for q, t in zip(queries, truth) if len(t)):
                break
            beam *= 2
        return beam


def _vectors(batch: pa.RecordBatch) -> np.ndarray:
    column = batch.column("embedding")
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


GRAPHS = "shard long, class long, graph binary"


def _built(threshold: float):
    """A task that stores the graph of each shard of (shard, class, vec_id, weight, embedding), rows sorted by shard."""

    def out(shard: int, of_class: int, held: list) -> pa.RecordBatch:
        members, rows, weight = (np.concatenate(c) for c in zip(*held))
        graph = Graph(rows)
        data = graph.stored(members=members, weight=weight, beam=np.array(graph.audited_beam(threshold)))
        return pa.RecordBatch.from_arrays([pa.array([shard]), pa.array([of_class]), pa.array([data], pa.binary())], names=["shard", "class", "graph"])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = (0, 0), []
        for batch in batches:
            shard = batch.column("shard").to_numpy()
            cuts = (np.flatnonzero(np.diff(shard)) + 1).tolist()
            for a, b in zip([0, *cuts], [*cuts, len(shard)]):
                if a == b:
                    continue
                if held and shard[a] != now[0]:
                    yield out(*now, held)
                    held = []
                now = int(shard[a]), batch.column("class")[a].as_py()
                part = batch.slice(a, b - a)
                held.append((part.column("vec_id").to_numpy(), _vectors(part), part.column("weight").to_numpy()))
        if held:
            yield out(*now, held)

    return task


def _answered(threshold: float):
    """A task that answers the queries of each part of (part, role, vec_id, embedding, graph), rows sorted by part and role: role 0 is the graph."""

    def out(a: np.ndarray, n: np.ndarray, b: np.ndarray | None) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(n, pa.int64()), pa.array(b, pa.int64()) if b is not None else pa.nulls(len(a), pa.int64())], names=["vec_id", "n", "other"])

    def answer(graph: Graph, beam: int, held: dict, ids: np.ndarray, x: np.ndarray, at: np.ndarray) -> Iterator[pa.RecordBatch]:
        members, weight = held["members"], held["weight"]
        hits = [graph.near(q, threshold, beam) for q in x]
        hits = [h[members[h] != v] for h, v in zip(hits, ids.tolist())]
        n = np.fromiter(map(len, hits), np.int64, len(hits))
        yield out(ids, np.fromiter((weight[h].sum() for h in hits), np.int64, len(hits)), None)
        if n.sum():
            at = np.where(at < 0, len(members) + np.arange(len(at)), at)
            root = common.local_roots(np.repeat(at, n), np.concatenate(hits), len(members) + len(ids))
            child = np.flatnonzero(root != np.arange(len(root)))
            names = np.concatenate([members, ids])
            yield out(names[child], np.zeros(len(child), np.int64), names[root[child]])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph, held, place, beam = None, {}, {}, 0
        for whole in batches:
            part, role = (whole.column(c).to_numpy() for c in ("part", "role"))
            cuts = (np.flatnonzero((np.diff(part) != 0) | (np.diff(role) != 0)) + 1).tolist()
            for a, b in zip([0, *cuts], [*cuts, len(part)]):
                if a == b:
                    continue
                if role[a] == 0:
                    graph, held = Graph.read(whole.column("graph")[a].as_py())
                    place, beam = {v: k for k, v in enumerate(held["members"].tolist())}, int(held["beam"])
                    continue
                some = whole.slice(a, b - a)
                ids, x = some.column("vec_id").to_numpy(), _vectors(some)
                at = np.array([place.get(v, -1) for v in ids.tolist()])
                for k in range(0, len(ids), BATCH):
                    cut = slice(k, k + BATCH)
                    audited = np.arange(len(ids))[cut][:: max(1, len(ids[cut]) // AUDITED_HERE)]
                    beam = graph.audited_beam(threshold, x[audited], at[audited], beam)
                    yield from answer(graph, beam, held, ids[cut], x[cut], at[cut])

    return task


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, shard_rows: int = SHARD_ROWS, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row for each id."""
    one = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.struct(F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("embedding")).alias("r"))
    one = common.scratch(one.groupBy("vec_id").agg(F.min("r").alias("r")).select("vec_id", "r.*"), "vectors")
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    usable = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("embedding") > 0) & finite & F.exists("embedding", lambda v: v != 0), F.lit(False))
    sound = one.where(usable).select("vec_id", "embedding", F.xxhash64("label", F.size("embedding")).alias("class"))
    distinct = common.scratch(sound.groupBy("class", "embedding").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("weight")), "distinct-vectors")
    sizes = distinct.groupBy("class").agg(F.count("*").alias("size"))
    sizes = common.scratch(sizes.select("class", F.ceil(F.col("size") / shard_rows).cast("int").alias("n_shards"), F.ceil(F.col("size") / BLOCK).cast("int").alias("n_blocks")), "shards")
    placed = distinct.join(sizes, "class")
    mine = F.pmod(F.xxhash64("vec_id"), F.col("n_shards")).cast("int")
    members = placed.select(F.xxhash64("class", mine).alias("shard"), "class", "vec_id", "weight", "embedding")
    graphs = common.scratch(members.repartition("shard").sortWithinPartitions("shard", "vec_id").mapInArrow(_built(threshold), GRAPHS), "graphs")
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    none = F.lit(None)
    readers = graphs.join(sizes, "class").withColumn("block", numbers("n_blocks")).select(F.xxhash64("shard", "block").alias("part"), F.lit(0).alias("role"), none.cast("long").alias("vec_id"), none.cast("array<double>").alias("embedding"), "graph")
    queries = placed.withColumn("s", numbers("n_shards")).withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.col("n_blocks")).cast("int"))
    queries = queries.select(F.xxhash64(F.xxhash64("class", "s"), F.col("block")).alias("part"), F.lit(1).alias("role"), "vec_id", "embedding", none.cast("binary").alias("graph"))
    rows = readers.unionByName(queries).repartition("part").sortWithinPartitions("part", "role", "vec_id")
    found = common.scratch(rows.mapInArrow(_answered(threshold), "vec_id long, n long, other long"), "vector-links")
    counts = found.groupBy("vec_id").agg(F.sum("n").alias("n"))
    classes = common.components(found.where("other is not null").select(F.col("vec_id").alias("a"), F.col("other").alias("b")))
    linked = distinct.join(counts, "vec_id", "left").join(classes.withColumnRenamed("node", "vec_id"), "vec_id", "left")
    linked = linked.select("class", "embedding", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    out = sound.join(linked, ["class", "embedding"]).select("vec_id", "n_links", "component_id")
    out = out.unionByName(one.where(~usable).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))
