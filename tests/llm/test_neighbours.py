"""Neighbour descent against all pairs."""

import brute
import numpy as np
import pytest

from trafficlens.llm.neighbours import Descent, near_vectors

KIND = "vec_id long, embedding array<float>, label int"


def all_pairs(rows, threshold=0.98):
    ids = [r[0] for r in rows]
    links, degree = [], dict.fromkeys(ids, 0)
    for label in {r[2] for r in rows}:
        own = [r for r in rows if r[2] == label]
        x = np.array([r[1] for r in own], np.float32).astype(float)
        n = np.linalg.norm(x, axis=1)
        near = np.triu((x @ x.T) / np.outer(n, n) >= threshold, 1)
        for i, j in zip(*np.nonzero(near), strict=True):
            a, b = own[i][0], own[j][0]
            links.append((a, b))
            degree[a] += 1
            degree[b] += 1
    found = brute.reach(ids, links)
    return {i: (degree[i], found[i]) for i in ids}


@pytest.mark.parametrize("block", [256, 32])
def test_same_as_all_pairs(spark, block):
    rng = np.random.default_rng(4)
    rows, centres = [], rng.standard_normal((12, 24))
    for i in range(900):
        if i % 3 == 0:
            x = centres[0] + 0.08 * rng.standard_normal(24)  # a third of all rows near each other
        elif i % 3 == 1:
            x = centres[i % 12] + rng.choice([0.1, 0.17, 1.0]) * rng.standard_normal(24)
        else:
            x = rng.standard_normal(24)
        rows.append((i, x.astype(np.float32).tolist(), i % 2))
    rows += [(1000 + i, rows[0][1], 0) for i in range(40)]
    got = near_vectors(spark.createDataFrame(rows, KIND), Descent(block=block)).collect()
    want = all_pairs(rows)
    assert len(got) == len(rows)
    wrong = [r.vec_id for r in got if (r.n_links, r.component_id) != want[r.vec_id]]
    assert len(wrong) <= 0.01 * len(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0], 0), (2, [2.0, 0.0], 0), (2, [2.0, 0.0], 0), (3, [1.0, 0.0], 1), (4, [1.0, 0.0], None), (5, None, 0),
        (6, [0.0, 0.0], 0), (7, [nan, 1.0], 0), (8, [inf, 1.0], 0), (9, [None, 1.0], 0), (10, [], 0), (None, [1.0, 0.0], 0),
        (11, [1.0, 0.0, 0.0], 0),
    ]
    frame = spark.createDataFrame([(*r, 1, True) for r in rows], KIND + ", node int, kept boolean")
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in near_vectors(frame).collect()), key=lambda r: (r[0] is None, r))
    assert got == [
        (1, 2, 1, True), (2, 2, 1, False), (2, 2, 1, False), *((i, 0, i, True) for i in range(3, 12)), (None, 0, None, True)
    ]
    assert near_vectors(frame.limit(0)).collect() == []
