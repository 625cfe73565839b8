"""Vector codes and nearest neighbours against brute force, with the awkward cases."""

import hashlib
from functools import reduce

import numpy as np
import pytest

from loomgraph.llm import codes, neighbours

VECTORS = "vec_id long, embedding array<float>, label int, v string, code string, error int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, label, "clash", "clash", 1) for i, v, label in rows], VECTORS)


def odd_rows(width, first):
    good = [0.5] * width
    return [(first, None, 1), (first + 1, [None] + good[1:], 1), (first + 2, [float("nan")] + good[1:], 1), (first + 3, [float("inf")] + good[1:], 1), (first + 4, [], 1), (first + 5, good[:-1], 1)]


def plain_codes(rows, rounds=codes.ROUNDS):
    """As the docstring says, with Python's integers."""
    whole = [(i, [int(np.floor(4096 * float(x))) for x in v], label) for i, v, label in rows]
    cut = lambda v: [v[p * len(v) // 8 : (p + 1) * len(v) // 8] for p in range(8)]
    ids = sorted({i for i, _, _ in whole if i is not None})[:16]
    starts = [min(v for j, v, _ in whole if j == i) for i in ids]
    if len(starts) < 16 and any(i is None for i, _, _ in whole):
        starts.append(min(v for i, v, _ in whole if i is None))
    books = [[cut(v)[p] for v in starts] for p in range(8)]
    gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda p, x: min(range(len(books[p])), key=lambda e: (gap(x, books[p][e]), e))
    for _ in range(rounds):
        new = []
        for p in range(8):
            taken = {}
            for _, v, _ in whole:
                taken.setdefault(near(p, cut(v)[p]), []).append(cut(v)[p])
            new.append([[sum(c) // len(taken[e]) for c in zip(*taken[e])] if e in taken else b for e, b in enumerate(books[p])])
        books = new
    out = []
    for i, v, label in whole:
        best = [near(p, x) for p, x in enumerate(cut(v))]
        out.append((i, "".join(f"{e:02x}" for e in best), sum(gap(x, books[p][best[p]]) for p, x in enumerate(cut(v))), label))
    sums = {label: sum(e for _, _, e, x in out if x == label) for _, _, _, label in out}
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted(((i, c, e, sums[label], sha) for i, c, e, label in out), key=repr)


@pytest.mark.parametrize("n", [300, 5])
def test_codes_equal_brute_force(spark, n):
    rng = np.random.default_rng(n)
    rows = [(int(i) * 3 - 20, rng.normal(0, 1, 16).astype(np.float32).tolist(), int(i) % 4 or None) for i in rng.permutation(n)]
    rows += rows[:3] + [(rows[0][0], [-0.0] * 16, 7), (None, [1.0] * 16, 7), (None, [0.25] * 16, None)] + [(1000 + i, [0.125] * 16, 9) for i in range(n)]
    got = codes.vector_codes(table(spark, rows + odd_rows(16, 5000))).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()
    assert sorted(map(tuple, got), key=repr) == plain_codes(rows)


def test_codes_of_nothing_and_of_large_numbers(spark):
    assert codes.vector_codes(table(spark, [])).collect() == []
    assert codes.vector_codes(table(spark, odd_rows(8, 0)[:5])).collect() == []
    far = codes.vector_codes(table(spark, [(1, [3e38] * 8, None), (2, [-3e38] * 8, None), (3, [8192.0] * 8, None)])).orderBy("vec_id").collect()
    assert [(r["code"], r["error"]) for r in far] == [("00" * 8, 0), ("01" * 8, 0), ("00" * 8, 0)]


def test_bounds_hold_and_spare_work():
    rng = np.random.default_rng(3)
    entries, x = rng.integers(-2000, 2000, (16, 8)), rng.integers(-2500, 2500, (500, 8))
    cells = codes.Cells(entries)
    exact = ((x[:, None, :] - entries[None]) ** 2).sum(axis=2)
    lower, upper = cells.bounds(x)
    assert (lower <= exact).all() and (exact <= upper).all()
    assert (lower <= upper.min(axis=1, keepdims=True)).mean() < 0.75
    best, gap = cells.nearest(x)
    assert (best == exact.argmin(axis=1)).all() and (gap == exact.min(axis=1)).all()


def plain_nearest(rows, k=20, by=20):
    fine = [(n, i, np.array(v, float)) for n, (i, v, _) in enumerate(rows) if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    out = []
    for n, i, q in fine:
        if i % by == 0:
            all_ = sorted((-reduce(lambda s, x: s + x[0] * x[1], zip(q.tolist(), v.tolist()), 0.0), j) for m, j, v in fine if m != n and len(v) == len(q))
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(all_[:k])]
    return sorted(out)


def test_nearest_of_few_vectors_is_exact(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(0, 1, 8).astype(np.float32).tolist(), None) for i in range(90)]
    rows += [(100 + i, [1.0] * 8, None) for i in range(60)] + [(200, rows[20][1], None), (40, rows[40][1], None), (40, rows[41][1], None), (None, [1.0] * 8, None), (240, [0.0] * 8, None), (260, [-0.0, 1.0] + [0.0] * 6, None), (261, [0.0, 1.0] + [0.0] * 6, None), (280, [1.0] * 7, None), (281, [2.0] * 7, None)]
    rows += odd_rows(8, 300)[:5]
    for shard in (1000, 25):
        got = sorted(map(tuple, neighbours.nearest(table(spark, rows), shard=shard, chunk=4).collect()))
        assert got == plain_nearest(rows)
    assert neighbours.nearest(table(spark, [])).collect() == []
    assert neighbours.nearest(table(spark, rows[:1])).collect() == []


@pytest.mark.parametrize("lengths", ["equal", "unequal"])
def test_recall_of_graphs(spark, lengths):
    rng = np.random.default_rng(6)
    centres = rng.normal(0, 1, (40, 32))
    points = centres[rng.integers(0, 40, 3000)] + rng.normal(0, 0.6, (3000, 32))
    points *= (1 if lengths == "equal" else rng.uniform(0.2, 3, 3000)[:, None]) / np.linalg.norm(points, axis=1)[:, None]
    rows = [(i, v, None) for i, v in enumerate(points.astype(np.float32).tolist())] + [(3000 + i, points[7].tolist(), None) for i in range(1500)]
    got = neighbours.nearest(table(spark, rows), shard=1500).collect()
    best = {}
    for q, _, v, s in plain_nearest(rows, by=300):
        best.setdefault(q, {})[v] = s
    hits = total = 0
    for q, wanted in best.items():
        own = [r for r in got if r["query_id"] == q]
        assert [r["rank"] for r in sorted(own, key=lambda r: (-r["score"], r["vec_id"]))] == list(range(1, 21))
        hits += sum(r["vec_id"] in wanted for r in own)
        total += 20
    assert hits / total >= 0.95


def test_graph_levels_and_degrees():
    rng = np.random.default_rng(8)
    points = neighbours.lifted(rng.normal(0, 1, (700, 8)))
    graph = neighbours.build(points)
    assert len(graph.links) == graph.level.max() + 1 and graph.links[0].shape == (700, neighbours.GROUND)
    for k, links in enumerate(graph.links):
        near = links[links >= 0]
        assert (graph.level[near] >= k).all()
        assert all(len(set(r[r >= 0])) == (r >= 0).sum() and i not in r for i, r in enumerate(links))


def test_searches_of_many_shards_keep_fewer_nodes_each(monkeypatch):
    """A query's work grew in proportion to the number of shards, so that all queries' grew with the square of the vectors."""
    rng = np.random.default_rng(9)
    points, queries = neighbours.lifted(rng.normal(0, 1, (6000, 24))), rng.normal(0, 1, (40, 24))
    lifted = np.concatenate([queries / np.linalg.norm(queries, axis=1)[:, None], np.zeros((40, 1))], axis=1).astype(np.float32)
    gaps = []
    monkeypatch.setattr(neighbours, "_apart", lambda p, q, nodes, real=neighbours._apart: gaps.append((nodes >= 0).sum()) or real(p, q, nodes))

    def work(shards):
        parts = [np.arange(i, 1500 * shards, shards) for i in range(shards)]
        graphs = [neighbours.build(points[own]) for own in parts]
        gaps.clear()
        near = [own[neighbours.search(g, lifted, neighbours.width_in(shards, width=160))] for own, g in zip(parts, graphs)]
        best = np.argsort(-(lifted @ points[: 1500 * shards].T), axis=1)[:, :20]
        return sum(gaps), np.mean([np.isin(b, np.concatenate([x[i] for x in near])).mean() for i, b in enumerate(best)])

    (one, _), (four, recall) = work(1), work(4)
    assert four < 3.5 * one and recall >= 0.95


def test_shards_grow_in_number_and_size():
    made = [neighbours.shards_of(n * neighbours.SHARD) for n in (0, 1, 16, 64, 6400, 10**6)]
    assert made == [1, 1, 16, 32, 800, 125_000]
    assert neighbours.width_in(1) == neighbours.SEARCH and neighbours.width_in(10**6) == neighbours.LEAST and neighbours.width_in(10, 100.0) == neighbours.SEARCH
