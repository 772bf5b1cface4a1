import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkweft.llm import clustering as c
from tests.llm.conftest import CLASH


def brute(rows, k, rounds, seed, dims, scale):
    """Plain Python integers, one vector after the other."""
    import math

    kept = [(i, [math.floor(scale * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    start = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in start[:k]]
    dist = lambda v, w: sum((x - y) ** 2 for x, y in zip(v, w, strict=True))
    nearest = lambda v: min(range(len(centroids)), key=lambda j: (dist(v, centroids[j]), j))
    for _ in range(rounds):
        at = [nearest(v) for _, v in kept]
        for j in set(at):
            mine = [v for (_, v), a in zip(kept, at, strict=True) if a == j]
            centroids[j] = [sum(col) // len(mine) for col in zip(*mine, strict=True)]
    at = [nearest(v) for _, v in kept]
    d = [dist(v, centroids[a]) for (_, v), a in zip(kept, at, strict=True)]
    of = {j: sum(x for x, a in zip(d, at, strict=True) if a == j) for j in at}
    name = {j: hashlib.sha256(",".join(map(str, centroids[j])).encode()).hexdigest() for j in at}
    return sorted((str(i), a, x, of[a], sum(d), name[a]) for (i, _), a, x in zip(kept, at, d, strict=True))


def vectors(spark, rows, kind="float"):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").withColumns({k: F.lit(v) for k, v in (CLASH | {"cluster": 1, "vec": 2, "upper": 3}).items()})


def taken(df):
    return sorted((str(r["vec_id"]), r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"], r["centroid_sha256"]) for r in df.collect())


def some(seed, n, dims, spread=1.0, hubs=5):
    r = np.random.default_rng(seed)
    middle = r.normal(size=(hubs, dims))
    return [(i, [float(np.float32(x)) for x in middle[i % hubs] + spread * r.normal(size=dims)]) for i in range(n)]


@pytest.mark.parametrize(("spread", "k"), [(0.05, 7), (1.0, 12), (0.0, 6), (0.3, 1)])
def test_against_brute_force(spark, spread, k):
    rows = some(1, 300, 8, spread)
    assert taken(c.cluster(vectors(spark, rows), k, 5, 2, 8, 256)) == brute(rows, k, 5, 2, 8, 256)


def test_odd_vectors(spark):
    rows = some(2, 40, 4) + [
        (None, [0.5, 0.25, -0.125, 1.0]), (3, None), (4, []), (5, [1.0, None, 1.0, 1.0]), (6, [float("nan"), 1.0, 1.0, 1.0]), (7, [1.0, float("-inf"), 1.0, 1.0]), (8, [1.0] * 5), (9, [1.0] * 3),
        (41, [0.0, 0.0, 0.0, 0.0]), (41, [0.0, 0.0, 0.0, 0.0]), (41, [-0.001, -0.001, 0.001, 0.001]), (42, [0.0, 0.0, 0.0, 0.0]), (43, [-0.00390625, -1e-9, 1e-9, 300.0]),
    ]
    assert taken(c.cluster(vectors(spark, rows), 6, 5, 2, 4, 256)) == brute(rows, 6, 5, 2, 4, 256)
    assert taken(c.cluster(vectors(spark, rows, "double"), 100, 3, 2, 4, 256)) == brute(rows, 100, 3, 2, 4, 256)


def test_ties_go_to_the_smaller_number(spark):
    rows = [(i, [float(i % 2), 0.0]) for i in range(30)] + [(100 + i, [0.5, 0.0]) for i in range(10)]
    for k in (2, 3, 9):
        assert taken(c.cluster(vectors(spark, rows), k, 4, 2, 2, 256)) == brute(rows, k, 4, 2, 2, 256)


def test_large_components_stay_exact_and_too_large_ones_raise(spark):
    rows = [(i, [float(x) * 1000 for x in v]) for i, v in some(3, 60, 4)] + [(99, [500_000.0, -500_000.0, 0.0, 1.0])]
    assert taken(c.cluster(vectors(spark, rows, "double"), 5, 4, 2, 4, 256)) == brute(rows, 5, 4, 2, 4, 256)
    with pytest.raises(Exception, match="would not fit 64 bits"):
        c.cluster(vectors(spark, [(1, [1e30, 0.0])]), 2, 1, 2, 2, 256).collect()


def test_empty_tables(spark):
    assert c.cluster(vectors(spark, []), 4).count() == 0
    assert c.cluster(vectors(spark, [(1, None), (2, [1.0])]), 4).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_bounds_hold_and_save_scans(spark):
    """After every round the bounds enclose the true distances, and in clustered data most vectors need no scan."""
    x = np.array([[int(256 * v) for v in row] for _, row in some(5, 2000, 16, 0.1, 8)], np.int64)
    middle = x[:8].copy()
    state = c.reassign(x, middle, np.zeros(2000, np.int32), np.zeros(2000), np.zeros(2000), None)
    scans = []
    for _ in range(4):
        moved = np.array([x[state[0] == j].sum(0) // max(1, (state[0] == j).sum()) if (state[0] == j).any() else middle[j] for j in range(8)])
        drift = np.sqrt(((moved - middle) ** 2).sum(1).astype(float)) * (1 + c.SLACK)
        middle = moved
        state = c.reassign(x, middle, *state[:3], drift)
        d = np.sqrt(((x[:, None, :] - middle[None]) ** 2).sum(-1).astype(float))
        assert (state[0] == d.argmin(1)).all()
        own = d[np.arange(2000), state[0]]
        rest = np.where(np.arange(8) == state[0][:, None], np.inf, d).min(1)
        assert (state[1] >= own).all() and (state[2] <= rest).all()
        scans.append(int(state[3].sum()))
    assert scans[-1] < 200
