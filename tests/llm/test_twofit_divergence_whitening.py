"""Best-two-fit packing, divergence of sources and whitening against plain versions, with null, empty, repeated and long values and clashing columns."""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tidemark.llm import divergence, queries, twofit, whitening

BPE = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = ("task", "rank", "key", "length", "ids", "term", "n", "found", "g", "row", "vector", "before", "piece")


def texts() -> list[tuple]:
    rng = random.Random(5)
    words = ["alpha", "Beta", "beta", "GAMMA", "étoile", "Étoile", "delta", "x", "straße", "ká", "日本"]
    out = []
    for k in range(160):
        lang, source = rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", None, "dé"])
        n = rng.choice([0, 1, 3, 12, 40])
        out.append((k, "".join(rng.choice(words[: 5 + len(source or "") * 3]) + rng.choice([" ", ", ", "9", "_", "\n"]) for _ in range(n)), lang, source, n))
    out += [(900, None, "en", "a", 1), (901, "", "de", None, 1), (None, "alpha beta", "en", "b", 1), (3, out[3][1], out[3][2], out[3][3], 1), (902, " ".join(rng.choice(words) for _ in range(9000)), "en", "c", 1)]
    out += [(903, "onlyhere", "xx", "z", 1), (904, "?!", "xx", "y", 1)]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(texts(), SCHEMA).withColumns({c: F.lit(1) for c in CLASHES}).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def one_by_one(counts: Counter, size: int) -> list[tuple]:
    left, bins = Counter(counts), []
    while left := +left:
        room, now = size, []
        while fits := [x for x in left if left[x] and x <= room]:
            now.append(max(fits))
            left[now[-1]] -= 1
            room -= now[-1]
        if room and len(now) > 1:
            least = min(now)
            pairs = [(a + b, a, b) for a in left for b in left if left[a] and left[b] and a >= b and (a > b or left[a] > 1) and least < a + b <= room + least]
            if pairs:
                now.remove(least)
                left[least] += 1
                now += max(pairs)[1:]
                left.subtract(max(pairs)[1:])
        bins.append(tuple(sorted(now)))
    return bins


@pytest.mark.parametrize("seed", range(60))
def test_the_plan_is_packing_one_by_one(seed):
    rng = random.Random(seed)
    size = rng.choice([1, 10, 37, 64])
    counts = Counter(rng.choice([rng.randint(1, size), rng.randint(1, max(1, size // 3))]) for _ in range(rng.randint(0, 150)))
    made = [tuple(sorted(x for x, n in net.items() for _ in range(n))) for times, net in twofit.plan(dict(counts), size) for _ in range(times)]
    assert made == one_by_one(counts, size)


@pytest.mark.parametrize("size, broadcast", [(1024, True), (16, False), (1, True)])
def test_packed_sequences_hold_every_id_once(spark, docs, monkeypatch, size, broadcast):
    from tokenizers import Tokenizer

    if not broadcast:
        monkeypatch.setattr(twofit, "BROADCAST_ROWS", 1)
    got = [r.asDict() for r in twofit.pack(docs, BPE, size=size).collect()]
    tokenizer = Tokenizer.from_file(BPE)
    wanted = Counter()
    for doc_id, text, *_ in texts():
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        first = len(ids) - size * (-(-len(ids) // size) - 1)
        cuts = [0, *range(first, len(ids) + 1, size)]
        wanted.update((doc_id, k, a, tuple(ids[a:b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:])))
    assert Counter((r["doc_id"], r["piece"], r["start"], tuple(np.frombuffer(r["ids"], "<u4").tolist())) for r in got) == wanted
    sequences = defaultdict(list)
    for r in got:
        assert r["length"] * 4 == len(r["ids"])
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for placed in sequences.values():
        ends = np.cumsum([0, *(n for _, n in sorted(placed))])
        assert [o for o, _ in sorted(placed)] == ends[:-1].tolist() and ends[-1] <= size
    assert len(sequences) == len(one_by_one(Counter(len(x[3]) for x in wanted.elements()), size))


def test_no_texts_to_pack(nothing):
    assert twofit.pack(nothing, BPE).collect() == []


def diverging(min_docs: int, k: int) -> set[tuple]:
    rows = [(t or "", lang or "", s or "") for _, t, lang, s, _ in texts()]
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found = [(lang, s, re.findall(r"[^\x00-\x40\x5b-\x60\x7b-\x7f]+", t.translate(lower))) for t, lang, s in rows]
    out = set()
    for lang in {r[1] for r in rows}:
        in_docs = Counter(w for at, _, words in found if at == lang for w in set(words))
        kept = [w for w, n in in_docs.items() if n >= min_docs]
        groups = {s: Counter(w for at, src, words in found if (at, src) == (lang, s) for w in words if w in set(kept)) for s in {r[2] for r in rows if r[1] == lang}}
        total = sum(groups.values(), Counter())

        def share(counts):
            all_ = sum(counts.values()) + 2 * len(kept)
            return {w: 1 + 10**9 * (counts[w] + 2) // all_ for w in kept}

        p, q = {s: share(c) for s, c in groups.items()}, share(total)
        f = lambda x, y: (x - y) ** 2 // (x + y)
        for s in groups:
            pair = [(o, sum(f(p[s][w], p[o][w]) for w in kept)) for o in groups if o != s]
            term = [(w, f(p[s][w], q[w])) for w in kept if groups[s][w] and p[s][w] > q[w]]
            for part, items in (("pair", pair), ("term", term)):
                ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))
                out |= {(lang, s, part, item, value, n + 1) for n, (item, value) in enumerate(ranked) if part == "pair" or n < k}
    return out


@pytest.mark.parametrize("min_docs, k, first, broadcast", [(10, 10, 100, True), (3, 2, 0, True), (1, 10, 0, False), (1000, 10, 100, True)])
def test_divergence_is_that_of_its_definition(docs, monkeypatch, min_docs, k, first, broadcast):
    monkeypatch.setattr(divergence, "FIRST_TERMS", first)
    monkeypatch.setattr(divergence, "GROWTH", 2)
    monkeypatch.setattr(divergence, "PAIRS", 7)
    if not broadcast:
        monkeypatch.setattr(divergence, "BROADCAST_ROWS", 1)
        monkeypatch.setattr(divergence, "SUMS", 3)
    assert {tuple(r) for r in divergence.audit(docs, min_docs, k).collect()} == diverging(min_docs, k)


def test_divergence_of_no_texts(nothing):
    assert divergence.audit(nothing).collect() == []


def test_divergence_sql_agrees_on_odd_rows(spark, docs, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(map(tuple, queries.op12_divergence(spark, str(tmp_path)).collect())) == sorted(con.execute(queries.oracle_sql()["op12_divergence"]).fetchall())


def vectors(dims: int = 40) -> list[tuple]:
    rng = np.random.default_rng(2)
    base = rng.normal(size=(300, 6)) @ rng.normal(size=(6, dims)) + rng.normal(size=(300, dims)) * 0.3
    rows = [(k, [float(v) for v in np.float32(x)], 0) for k, x in enumerate(base)]
    x = rows[0][1]
    odd = [(900, None), (901, [float("nan"), *x[1:]]), (902, [None, *x[1:]]), (903, [float("inf"), *x[1:]]), (904, []), (905, x[:5]), (906, [1e30, *x[1:]])]
    return rows + [(0, x, 0), (None, rows[7][1], None)] + [(k, v, 1) for k, v in odd]


@pytest.mark.parametrize("tile, block", [(32, whitening.ROW_BLOCK_BYTES), (7, 4000), (64, 1)])
def test_whitening_is_that_of_the_whole_matrix(spark, monkeypatch, tile, block):
    monkeypatch.setattr(whitening, "ROW_BLOCK_BYTES", block)
    frame = spark.createDataFrame(vectors(), "vec_id long, embedding array<float>, label int").withColumns({c: F.lit(1) for c in CLASHES}).repartition(4)
    got = whitening.component_rows(whitening.whiten(frame, tile=tile)).select("row.vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error").collect()
    kept = [(k, v) for k, v, _ in vectors()[:302]]
    x = np.floor(1024 * np.array([np.float32(v) for _, v in kept]).astype(float)).astype(int) + 100000
    n, sums = len(x), x.sum(0)
    z = x - sums / n
    values, basis = np.linalg.eigh(z.T @ z / n)
    white = z @ basis[:, ::-1][:, :8] / np.sqrt(values[::-1][:8])
    assert len(got) == 8 * n and {r.n for r in got} == {n} and all(r.identity_error < 1e-9 for r in got)
    wanted = Counter((k, c + 1, int(((n * x[i] - sums) ** 2).sum()), round(abs(float(white[i, c])), 6), round(float(values[::-1][c] / values.sum()), 9)) for i, (k, _) in enumerate(kept) for c in range(8))
    assert Counter((r.vec_id, r.component, int(r.deviation), round(abs(r.whitened), 6), round(r.explained, 9)) for r in got) == wanted


def test_whitening_without_spread_or_rows(spark):
    schema = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], schema)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, None), (2, [])], schema)).collect() == []
    same = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema)).collect()
    assert [(r.whitened, r.identity_error, int(r.deviation)) for r in same] == [([None, None], 0.0, 0)] * 2
    line = whitening.whiten(spark.createDataFrame([(k, [float(k), 2.0 * k]) for k in range(5)], schema)).collect()
    assert all(r.whitened[1] is None and r.identity_error < 1e-9 and math.isclose(r.explained[0], 1) for r in line)
    # exact where the squares exceed 64 bits
    far = whitening.whiten(spark.createDataFrame([(1, [4e12, 0.0]), (2, [-4e12, 1.0])], "vec_id long, embedding array<double>")).collect()
    assert {int(r.deviation) for r in far} == {(2 * 1024 * 4 * 10**12) ** 2 + 1024**2}
