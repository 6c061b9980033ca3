"""The search against brute force: exact scores, ranks and ties, recall, split lists, odd vectors, and short results."""

import numpy as np
import pytest

from trailgrid.llm import ann


def brute(rows, k=20, every=20):
    dim = max(len(v) for _, v in rows)
    ids = np.array([i for i, _ in rows])
    x = np.array([list(v) + [0.0] * (dim - len(v)) for _, v in rows], np.float64)
    out = {}
    for i, v in zip(ids.tolist(), x):
        if i % every == 0:
            s = (x * v).sum(1)
            order = [j for j in np.lexsort((ids, -s)) if ids[j] != i][:k]
            out[i] = [(int(ids[j]), float(s[j])) for j in order]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def recall(got, want):
    assert got.keys() == want.keys() and all(len(got[q]) == len(want[q]) for q in want)
    for q, rows in got.items():
        assert rows == sorted(rows, key=lambda x: (-x[1], x[0]))
        true = dict(want[q])
        assert all(abs(true[i] - s) <= 1e-12 * (1 + abs(s)) for i, s in rows if i in true)
    return np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / len(want[q]) for q in want])


@pytest.mark.parametrize("kind", ["float", "double"])
def test_clusters_norms_and_precision(spark, kind):
    rng = np.random.default_rng(1)
    centre = rng.normal(size=(40, 12)) * 3
    x = centre[rng.integers(0, 40, 3000)] + rng.normal(size=(3000, 12)) * rng.choice([0.2, 1.0], (3000, 1))
    x = (x.astype(np.float32) if kind == "float" else x * 1e150).tolist()
    rows = [(i, v) for i, v in enumerate(x)]
    assert recall(found(ann.search(spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>"))), brute(rows)) >= 0.95


def test_lists_that_are_split_twice(spark, monkeypatch):
    monkeypatch.setattr(ann, "SAMPLE", 256)
    monkeypatch.setattr(ann, "LIST", 20)
    monkeypatch.setattr(ann, "FANOUT", 4)
    monkeypatch.setattr(ann, "_blocks", lambda space: 64)
    monkeypatch.setattr(ann, "SHELF", 4)
    rng = np.random.default_rng(2)
    centre = rng.normal(size=(30, 8)) * 2
    rows = [(i, (centre[i % 30] + rng.normal(size=8)).tolist()) for i in range(4000)]
    assert recall(found(ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))), brute([(i, np.float32(v).astype(float).tolist()) for i, v in rows])) >= 0.93


def test_ties_repeats_lengths_and_few_vectors(spark):
    rows = [(i, [1.0, 0.0]) for i in range(60)] + [(100 + i, [0.5, float(i % 3)]) for i in range(30)] + [(200, [1.0]), (220, [0.0, 0.0, 2.0])]
    odd = [(1, [1.0, 0.0]), (None, [1.0, 1.0]), (300, None), (320, []), (340, [None, 1.0]), (360, [float("inf"), 0.0]), (380, [0.0, 0.0]), (400, [float("nan"), 1.0])]
    got = found(ann.search(spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>")))
    assert got == brute(rows)
    few = rows[:3] + rows[-1:]
    assert found(ann.search(spark.createDataFrame(few, "vec_id long, embedding array<double>"))) == brute(few)
    assert found(ann.search(spark.createDataFrame([(0, [2.0])], "vec_id long, embedding array<double>"))) == {}


def test_tight_clusters_smaller_than_a_result(spark, monkeypatch):
    monkeypatch.setattr(ann, "LIST", 4)
    rng = np.random.default_rng(3)
    rows = [(i, (np.eye(50)[i % 50] * 5 + rng.normal(size=50) * 1e-3).tolist()) for i in range(300)]
    got, want = found(ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))), brute(rows)
    assert got.keys() == want.keys() and all(len(got[q]) == 20 for q in want)


def test_graph_finds_what_is_within_the_ratio():
    rng = np.random.default_rng(4)
    points, x = rng.normal(size=(700, 6)), rng.normal(size=(200, 6))
    graph, d = ann.Centroids(points), ann.distances(x, points)
    for ratio in (1.0, 1.1, 2.5):
        row, ids, away = graph.search(x, ratio)
        want = {(int(r), int(c)) for r, c in zip(*np.nonzero(d <= d.min(1, keepdims=True) * ratio))}
        assert len(want & set(zip(row.tolist(), ids.tolist()))) >= 0.99 * len(want) and np.allclose(away, d[row, ids], atol=1e-6)
        assert len(set(zip(row.tolist(), ids.tolist()))) == len(row)
