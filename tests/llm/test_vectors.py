"""HNSW near-duplicates and components against brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest

from tidemark.llm import common, hnsw

SCHEMA = "vec_id long, embedding array<float>, label int, n int"


def brute(rows, threshold=0.93):
    sound = {}
    for vec, x, label, _ in rows:
        if x is not None and label is not None and x and all(v is not None and np.isfinite(v) for v in x) and any(x):
            sound[vec] = (label, np.array(x, np.float32).astype(float))
    links = {vec: set() for vec, *_ in rows}
    for a in sound:
        for b in sound:
            (la, x), (lb, y) = sound[a], sound[b]
            if a != b and la == lb and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= threshold:
                links[a].add(b)
    out = {}
    for vec in links:
        seen, todo = {vec}, [vec]
        while todo:
            todo += [b for b in links[todo.pop()] if b not in seen and not seen.add(b)]
        out[vec] = (len(links[vec]), min(seen), vec == min(seen))
    return out


def table():
    rng = np.random.default_rng(1)
    rows, vec = [], 0
    for label in (0, 1, 2):
        base = rng.normal(size=(120, 16))
        near = np.repeat(base[:6], [40, 9, 3, 2, 2, 2], axis=0)
        near = near + rng.normal(size=near.shape) * 0.08
        for x in [*base, *near, *base[:5]]:
            rows.append((vec, [float(v) for v in np.float32(x)], label, 0))
            vec += 1
    x = rows[0][1]
    rows += [(1000, None, 0, 0), (1001, [0.0] * 16, 0, 0), (1002, [float("nan"), *x[1:]], 0, 0), (1003, [None, *x[1:]], 0, 0), (1004, x, None, 0), (1005, [], 0, 0), (1006, [float("inf"), *x[1:]], 0, 0), (1007, x[:8], 0, 0), (1008, [3 * v for v in x], 0, 0), (1009, x, 7, 0)]
    return rows


@pytest.mark.parametrize("shard_rows, block", [(16384, hnsw.BLOCK), (70, 50)])
def test_links_and_components_are_those_of_brute_force(spark, monkeypatch, shard_rows, block):
    monkeypatch.setattr(hnsw, "BLOCK", block)
    rows = table()
    frame = spark.createDataFrame(rows + rows[:3], SCHEMA).repartition(5)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in hnsw.near_duplicates(frame, shard_rows=shard_rows).collect()}
    assert got == brute(rows)


def test_no_rows(spark):
    assert hnsw.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_recall_of_the_graph():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(1500, 32))
    x[700:1000] = x[0] + rng.normal(size=(300, 32)) * 0.1
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    graph = hnsw.Graph(x)
    beam = graph.audited_beam(0.93)
    truth = x @ x.T >= 0.93
    found = sum(len(graph.near(x[k], 0.93, beam)) for k in range(len(x)))
    assert found >= 0.99 * truth.sum() and beam < len(x)
    assert all(truth[k, graph.near(x[k], 0.93, beam)].all() for k in range(0, len(x), 50))


def test_a_graph_is_read_as_it_was_stored():
    x = np.random.default_rng(6).normal(size=(300, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    graph = hnsw.Graph(x)
    again, arrays = hnsw.Graph.read(graph.stored(members=np.arange(300) * 7))
    assert (arrays["members"] == np.arange(300) * 7).all()
    assert all(np.array_equal(graph.near(q, 0.7, 24), again.near(q, 0.7, 24)) for q in x)
    assert graph.audited_beam(0.7, x[:9] * 1.0, np.arange(9), 24) == again.audited_beam(0.7, x[:9], np.arange(9), 24)


def test_copies_do_not_make_the_beam_as_wide_as_the_shard(spark):
    rng = np.random.default_rng(8)
    x = np.concatenate([np.repeat(rng.normal(size=(1, 16)), 4000, axis=0), rng.normal(size=(300, 16))])
    frame = spark.createDataFrame([(k, [float(v) for v in np.float32(x[k])], 0, 0) for k in range(len(x))], SCHEMA)
    got = {r.vec_id: (r.n_links, r.component_id) for r in hnsw.near_duplicates(frame).collect()}
    assert all(got[k] == (3999, 0) for k in range(4000)) and all(got[k] == (0, k) for k in range(4000, 4300))


def test_a_hot_group_does_not_hide_the_links_of_others(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(60, 16))
    x = np.concatenate([np.repeat(base[:1], 90, axis=0), base, base + rng.normal(size=base.shape) * 0.08])
    rows = [(int(k), [float(v) for v in np.float32(x[k])], 0, 0) for k in range(len(x))]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in hnsw.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()}
    assert got == brute(rows)


def test_the_audit_holds_each_member_to_its_recall():
    x = np.repeat(np.eye(64), [2000, *[2] * 63], axis=0)
    graph = hnsw.Graph.__new__(hnsw.Graph)
    graph.x = graph.exact = x
    # a walk that finds the large group whole, and of the small ones the query alone
    graph.near = lambda q, threshold, beam: np.arange(2000) if q[0] else np.flatnonzero(x @ q >= threshold)[: 1 if beam < 200 else 2]
    assert graph.audited_beam(0.93) >= 200


@pytest.mark.parametrize("hubs", [20_000, 8])
def test_components_of_chains_hubs_and_rings(spark, monkeypatch, hubs):
    monkeypatch.setattr(common, "HUBS", hubs)
    rng = random.Random(3)
    links = [(k, k + 1) for k in range(100, 160)] + [(500, k) for k in range(501, 700)] + [(k, 200 + (k - 199) % 30) for k in range(200, 230)] + [(9, 8), (8, 9), (9, 9)]
    rng.shuffle(links)
    got = {r.node: r.component for r in common.components(spark.createDataFrame(links, "a long, b long")).collect()}
    wanted = {k: 100 for k in range(100, 161)} | {k: 500 for k in range(500, 700)} | {k: 200 for k in range(200, 230)} | {8: 8, 9: 8}
    assert got == wanted
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_local_roots():
    rng = np.random.default_rng(4)
    for _ in range(30):
        a, b = rng.integers(0, 60, 40), rng.integers(0, 60, 40)
        root = common.local_roots(a, b, 60)
        assert (root[a] == root[b]).all() and (root[root] == root).all() and (root <= np.arange(60)).all()
        parent = list(range(60))
        for x, y in zip(a, b):
            x, y = (next(k for k in iter(lambda s=s: s[0], None) if not s.__setitem__(0, parent[k]) and parent[k] == k) for s in ([int(x)], [int(y)]))
            parent[max(x, y)] = min(x, y)
        assert len(set(root.tolist())) == sum(parent[k] == k for k in range(60))


def test_batches_are_bounded_by_bytes(spark, monkeypatch):
    import pyarrow as pa

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([b.num_rows], pa.int64())})

    monkeypatch.setattr(common, "BATCH_BYTES", 100_000)
    common.bound_batches(spark)
    try:
        rows = spark.range(200, numPartitions=1).selectExpr("repeat('x', 5000) AS text")
        found = [r.n for r in rows.mapInArrow(sizes, "n long").collect()]
        assert sum(found) == 200 and max(found) <= 40
    finally:
        monkeypatch.undo()
        common.bound_batches(spark)
