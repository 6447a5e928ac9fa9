"""Clustering by filtered centroids against all distances in unbounded integers."""

import math
from hashlib import sha256

import numpy as np
import pytest

from credilake.llm import centroids

DATA = "/root/testdata/sf0.001"


def brute(rows, clusters=40, rounds=5, dimensions=64):
    sound = lambda v: v is not None and len(v) == dimensions and all(x is not None and math.isfinite(x) and abs(x * 256) < 2**62 for x in v)
    kept = [(i, [math.floor(256.0 * x) for x in v]) for i, v in rows if sound(v)]
    first = sorted(kept, key=lambda r: (sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centres = [v for _, v in first[:clusters]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(centres))
    for _ in range(rounds):
        labels = [near(v)[1] for _, v in kept]
        own = [[v for (_, v), label in zip(kept, labels) if label == k] for k in range(len(centres))]
        centres = [[sum(x) // len(vs) for x in zip(*vs)] if vs else c for vs, c in zip(own, centres)]
    told = [(i, *near(v)) for i, v in kept]
    fits = lambda s: s if s < 2**63 else None
    sums = {k: sum(d for _, d, j in told if j == k) for k in {j for *_, j in told}}
    whole = fits(sum(sums.values()))
    return sorted((str(i), k, str(fits(d)), str(fits(sums[k])), str(whole), centres[k]) for i, d, k in told)


def found(df, **how):
    names = ("distance", "cluster_inertia", "inertia")
    rows = centroids.cluster_vectors(df, **how).collect()
    return sorted((str(r["vec_id"]), r["cluster"], *(str(r[n]) for n in names), r["centroid"]) for r in rows)


ODD = [
    (None, [2.0**20 + j for j in range(64)]), (7, [-(2.0**25)] * 64), (7, [-(2.0**25)] * 64), (8, [3e38] * 64), (9, None),
    (10, [1.0] * 63), (11, [math.nan] * 64), (12, [None] * 64), (13, []), (14, [math.inf] + [0.0] * 63), (15, [2.0**45] * 64),
]


@pytest.mark.parametrize("more", [[], ODD])
def test_equals_all_distances(spark, more):
    rows = [(r["vec_id"], list(r["embedding"])) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()] + more
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "vec_id long, embedding array<float>, v string, cluster string")
    assert found(df) == brute(rows)


def test_few_vectors_ties_and_empty_clusters(spark):
    rows = [(i, [float(i % 3), 0.0]) for i in range(30)] + [(1, [1.0, 0.0])] * 3
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    for clusters in (1, 5, 40):
        assert found(df, clusters=clusters, dimensions=2, leading=1) == brute(rows, clusters, dimensions=2)
    assert found(df.limit(0)) == []


def test_bound_is_below_and_rules_out(spark):
    rnd = np.random.default_rng(1)
    groups = rnd.normal(size=(40, 64)) * 200 * 0.85 ** np.arange(64)  # vectors in groups, with a falling spectrum
    v = (groups[np.arange(3000) % 40] + rnd.normal(size=(3000, 64)) * 5).astype(np.int64)
    mean, axes = v.mean(0), np.linalg.eigh(np.cov(v.T))[1][:, ::-1]
    c = centroids.Centroids(v[:40].tolist(), mean, axes)
    lead, rest = centroids._rotated(v, mean, axes, centroids.LEADING)
    whole = ((v[:, None] - v[:40]) ** 2).sum(2)
    assert (c.bounds(lead, rest) <= whole).all()
    label, best = c.nearest(v, lead, rest)
    assert (label == whole.argmin(1)).all() and (best == whole.min(1)).all()
    assert c.verified < 0.3 * whole.size
