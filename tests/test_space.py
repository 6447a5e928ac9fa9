import math
import re

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from credilake.operators import anomaly, cluster_metrics, clustering, many_means, neighbors, patterns
from credilake.operators.components import connected_components
from credilake.operators.scaling import RobustScale
from credilake.sources import artefacts


def _frame(spark, x, **extra):
    rows = [(i, [float(v) for v in row], *[int(e[i]) for e in extra.values()]) for i, row in enumerate(x)]
    return spark.createDataFrame(rows, "id long, vec array<double>" + "".join(f", {c} long" for c in extra))


def _distances(x, y=None):
    y = x if y is None else y
    return np.sqrt(((x[:, None] - y[None]) ** 2).sum(-1))


@pytest.fixture(scope="module")
def points():
    """Three clumps, scatter, and one vector that a third of the table shares."""
    rng = np.random.default_rng(1)
    clumps = [rng.normal(c, 0.3, size=(30, 3)) for c in (0, 4, 9)]
    return np.concatenate([*clumps, rng.uniform(-3, 12, size=(30, 3)), np.full((60, 3), 4.0)])


def _brute_knn(x, k):
    d = _distances(x)
    np.fill_diagonal(d, np.inf)
    ids = np.arange(len(x))
    return {i: [int(j) for j in sorted(ids, key=lambda j: (d[i, j], j))[:k]] for i in ids}


@pytest.mark.parametrize(("pivots", "chunk_rows"), [(1, 1000), (8, 1000), (8, 7), (40, 16)])
def test_knn_is_exact_for_any_layout(spark, points, pivots, chunk_rows):
    df = _frame(spark, points)
    got = {}
    rows = neighbors.knn_join(df, df, 6, exclude_self=True, pivots=pivots, chunk_rows=chunk_rows).collect()
    for r in sorted(rows, key=lambda r: r.rank):
        got.setdefault(r.id, []).append(r.neighbor_id)
    assert got == _brute_knn(points, 6)


def test_knn_between_frames_and_few_base_rows(spark, points):
    base = points[:4]
    rows = neighbors.knn_join(_frame(spark, points), _frame(spark, base), 10, pivots=2).collect()
    assert len(rows) == len(points) * 4
    d = _distances(points, base)
    assert all(r.distance == pytest.approx(d[r.id, r.neighbor_id], abs=1e-12) for r in rows)


@pytest.mark.parametrize(("pivots", "chunk_rows"), [(1, 1000), (12, 9)])
def test_eps_join_is_exact(spark, points, pivots, chunk_rows):
    eps = 0.7
    rows = neighbors.eps_join(_frame(spark, points), eps, pivots=pivots, chunk_rows=chunk_rows).collect()
    i, j = np.nonzero(np.triu(_distances(points) <= eps, 1))
    assert len(rows) == len(i) and {(r.id, r.other) for r in rows} == set(zip(i.tolist(), j.tolist()))


def _brute_dbscan(x, eps, min_samples):
    near = _distances(x) <= eps
    core = near.sum(1) >= min_samples
    label = np.full(len(x), -1)
    cluster = 0
    for i in range(len(x)):
        if not core[i] or label[i] != -1:
            continue
        stack, label[i] = [i], cluster
        while stack:
            for j in np.nonzero(near[stack.pop()])[0]:
                if label[j] == -1:
                    label[j] = cluster
                    if core[j]:
                        stack.append(j)
        cluster += 1
    return label, core


@pytest.mark.parametrize(("eps", "min_samples", "chunk_rows"), [(0.5, 5, 1000), (0.5, 5, 8), (1.2, 4, 16), (0.01, 5, 1000), (50.0, 3, 20)])
def test_dbscan_against_the_textbook(spark, points, eps, min_samples, chunk_rows):
    rows = clustering.dbscan(_frame(spark, points), eps, min_samples, chunk_rows=chunk_rows).orderBy("id").collect()
    label, core = _brute_dbscan(points, eps, min_samples)
    assert [r.cluster for r in rows] == label.tolist()
    assert [r.is_core for r in rows] == core.tolist()


def test_dbscan_assignment(spark, points):
    df = _frame(spark, points)
    labels = clustering.dbscan(df, 0.5, 5)
    cores = df.join(labels.where("is_core"), "id").select("id", "vec", "cluster")
    new = _frame(spark, np.array([points[0] + 0.01, [100, 100, 100]]))
    got = {r.id: r.cluster for r in clustering.assign_density_cluster(new, cores, 0.5).collect()}
    assert got == {0: 0, 1: -1}


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(0, 25), st.integers(0, 25)), min_size=1, max_size=40))
def test_components(spark, edges):
    parent = {v: v for e in edges for v in e}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in edges:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    expected = {v: root(v) for v in parent if any(v in e and e[0] != e[1] for e in edges)}
    assert got == expected


def test_long_chain_of_components(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(200)], "src long, dst long")
    assert {r.component for r in connected_components(chain).collect()} == {0}


def _brute_silhouette(x, labels):
    d = _distances(x)
    values = []
    for i, own in enumerate(labels):
        same = labels == own
        if same.sum() == 1:
            values.append(0.0)
            continue
        a = d[i][same].sum() / (same.sum() - 1)
        b = min(d[i][labels == c].mean() for c in set(labels) - {own})
        values.append((b - a) / max(a, b) if max(a, b) else 0.0)
    return float(np.mean(values))


def test_cluster_quality_against_numpy(spark, points):
    labels = np.array([i % 4 if i < 100 else 4 for i in range(len(points))])
    labels[0] = 9  # a cluster of one
    df = _frame(spark, points, cluster=labels)
    assert cluster_metrics.silhouette(df, chunk_rows=16).first()[0] == pytest.approx(_brute_silhouette(points, labels))
    q = cluster_metrics.quality(df, "euclidean").first()
    centres = {c: points[labels == c].mean(0) for c in set(labels)}
    within = sum(((points[labels == c] - m) ** 2).sum() for c, m in centres.items())
    assert q.inertia == pytest.approx(within)
    k, n = len(centres), len(points)
    between = sum((labels == c).sum() * ((m - points.mean(0)) ** 2).sum() for c, m in centres.items())
    assert q.calinski_harabasz == pytest.approx(between / within * (n - k) / (k - 1))
    scatter = {c: np.sqrt(((points[labels == c] - m) ** 2).sum(1)).mean() for c, m in centres.items()}
    worst = [max((scatter[i] + scatter[j]) / np.linalg.norm(centres[i] - centres[j]) for j in centres if j != i) for i in centres]
    assert q.davies_bouldin == pytest.approx(np.mean(worst))


def test_one_cluster_scores_zero(spark, points):
    q = cluster_metrics.quality(_frame(spark, points, cluster=np.zeros(len(points))), "squared").first()
    assert (q.silhouette, q.davies_bouldin, q.calinski_harabasz) == (0.0, 0.0, 0.0)


def test_kmeans_finds_the_clumps(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(c, 0.2, size=(40, 2)) for c in (0, 5, 10)])
    df = _frame(spark, x)
    labels = np.array([r.cluster for r in clustering.kmeans(df, 3, restarts=2).orderBy("id").collect()])
    assert labels.tolist() == np.repeat([0, 1, 2], 40).tolist()
    ward = np.array([r.cluster for r in clustering.hierarchical(df, 3, micro_clusters=20).orderBy("id").collect()])
    assert all(len(set(part)) == 1 for part in np.split(ward, 3)) and len(set(ward)) == 3
    chosen = clustering.auto_select_k(df, range(2, 5), restarts=1, silhouette_metric="squared").where("optimal").collect()
    assert [r.k for r in chosen] == [3]


def test_best_k_first_wins_ties(spark):
    rows = spark.createDataFrame([(4, 0.50001), (3, 0.5), (2, 0.2)], "k int, silhouette double")
    assert clustering.best_k(rows).first()[0] == 3


def _cost(x, centres):
    return ((x[:, None] - np.asarray(centres)) ** 2).sum(2).min(1).sum()


def test_many_kmeans_cost_no_more_than_the_library(spark):
    from pyspark.ml.clustering import KMeans

    rng = np.random.default_rng(9)
    x = np.concatenate([rng.normal(c, 1.0, (n, 3)) for c, n in ((0, 200), (6, 80), (-7, 40), (15, 5))])
    df = clustering.materialize(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>"), "test")
    found = many_means.fit_many(df, [2, 3, 4, 6], restarts=10)
    features = clustering._features(df)
    for k, centres in found.items():
        theirs = min(KMeans(k=k, seed=42 + r, maxIter=300, tol=1e-4).fit(features).summary.trainingCost for r in range(3))
        assert len(centres) == k and centres == sorted(centres) and _cost(x, centres) <= theirs * 1.0001
    again = many_means.fit_many(df.repartition(5), [3], restarts=10)[3]
    assert np.allclose(again, found[3])


def test_silhouettes_of_many_labellings(spark):
    rng = np.random.default_rng(10)
    x = rng.normal(size=(90, 3)).round(1)
    x[60:] = x[:30]  # repeated points, some of them labelled otherwise
    labels = np.stack([rng.integers(0, 2, 90), rng.integers(-1, 4, 90), np.arange(90) // 89], 1)
    rows = [(i, v.tolist(), *map(int, row)) for i, (v, row) in enumerate(zip(x, labels))]
    df = spark.createDataFrame(rows, "id long, vec array<double>, a int, b int, c int")
    found = cluster_metrics.silhouettes(df, ["a", "b", "c"], chunk_rows=16)
    for name in "abc":
        one = cluster_metrics.silhouette(df.select("id", "vec", df[name].alias("cluster"))).first()[0]
        assert found[name] == pytest.approx(one)


def test_silhouettes_of_many_pairs_write_no_pairs(spark, monkeypatch):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(150, 3))
    x[0] = 1e7  # far from all others
    labels = rng.integers(0, 3, (150, 2))
    rows = [(i, v.tolist(), *map(int, row)) for i, (v, row) in enumerate(zip(x, labels))]
    df = spark.createDataFrame(rows, "id long, vec array<double>, a int, b int")
    one = {n: cluster_metrics.silhouette(df.select("id", "vec", df[n].alias("cluster"))).first()[0] for n in "ab"}
    plans, summed = [], neighbors.summed_over_all

    def watched(*args):
        out = summed(*args)
        plans.append(out._jdf.queryExecution().executedPlan().toString())
        return out

    def shuffled(*args):
        raise AssertionError("blocks of all pairs are shuffled")

    monkeypatch.setattr(cluster_metrics, "all_blocks", shuffled)
    monkeypatch.setattr(cluster_metrics, "summed_over_all", watched, raising=False)
    found = cluster_metrics.silhouettes(df, ["a", "b"], 16)
    assert found == {n: pytest.approx(v) for n, v in one.items()}
    # the stored blocks pass by; only the side that a task holds is dealt, once
    assert len(plans) == 1 and "CartesianProduct" in plans[0] and len(re.findall(r"[+:]- Exchange", plans[0])) == 1


def test_kmeans_of_few_or_equal_rows(spark):
    df = spark.createDataFrame([(i, [float(i % 2), 1.0]) for i in range(9)], "id long, vec array<double>")
    assert many_means.fit_many(df, [4], restarts=2)[4] == [[0.0, 1.0], [1.0, 1.0]]
    assert many_means.fit_many(df.limit(0), [2, 3])[3] == []


def test_ward_merges_like_the_definition():
    for seed in range(5):
        _ward_case(seed)
    assert clustering.ward_merge(np.zeros((3, 2)), np.array([0, 2, 0]), 2).tolist() == [-1, 0, -1]


def _ward_case(seed):
    rng = np.random.default_rng(seed)
    centres, sizes = rng.normal(size=(12, 2)), rng.integers(1, 9, 12)
    label = clustering.ward_merge(centres, sizes, 4)
    groups = [[i] for i in range(12)]

    def sse(g):
        w = sizes[g][:, None]
        return (w * (centres[g] - (centres[g] * w).sum(0) / w.sum()) ** 2).sum()

    while len(groups) > 4:
        pairs = [(sse(a + b) - sse(a) - sse(b), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j]
        _, i, j = min(pairs)
        groups[i] += groups.pop(j)
    assert {frozenset(g) for g in groups} == {frozenset(np.nonzero(label == c)[0].tolist()) for c in set(label)}


def test_lof_against_numpy(spark, points):
    x = points[:120]
    k = 7
    near = _brute_knn(x, k)
    d = _distances(x)
    k_distance = {i: max(d[i, j] for j in near[i]) for i in near}
    density = {i: 1 / (np.mean([max(d[i, j], k_distance[j]) for j in near[i]]) + 1e-10) for i in near}
    expected = [np.mean([density[j] for j in near[i]]) / density[i] for i in range(len(x))]
    scores = anomaly.lof(_frame(spark, x), k)
    assert [r.lof for r in scores.orderBy("id").collect()] == pytest.approx(expected)
    flagged = anomaly.lof_anomalies(scores, 0.1).where("is_anomaly").collect()
    cut = np.percentile(-np.array(expected), 10)
    assert {r.id for r in flagged} == set(np.nonzero(-np.array(expected) < cut)[0].tolist())


def test_lof_novelty(spark, points):
    new = _frame(spark, np.array([[0.0, 0, 0], [60.0, 60, 60]]))
    labels = {r.id: r.label for r in anomaly.lof_novelty(new, _frame(spark, points[:90]), 10).collect()}
    assert labels == {0: "NORMAL", 1: "ANOMALY"}


def test_stored_models_judge_alike(spark, points, tmp_path):
    known, new = _frame(spark, points[:90]), _frame(spark, points[90:])
    rows = lambda df: sorted(tuple(r) for r in df.drop("vec").collect())
    _, forest = anomaly.isolation_forest(known, 0.1, trees=10)
    path = str(tmp_path / "forest")
    assert artefacts.save_forest(spark, path, forest) == 1
    assert rows(anomaly.score_anomaly(new, artefacts.load_forest(spark, path))) == rows(anomaly.score_anomaly(new, forest))
    base = anomaly.LofBase.fit(known, 10)
    artefacts.save_lof_base(spark, str(tmp_path / "lof"), base)
    stored = artefacts.load_lof_base(spark, str(tmp_path / "lof"))
    assert rows(stored.novelty(new)) == rows(base.novelty(new)) == rows(anomaly.lof_novelty(new, known, 10))
    centres, scale = clustering.fit_kmeans(known, 3, 2), RobustScale({"a": 1.5, "b": -0.1}, {"a": 2.0, "b": 1.0})
    artefacts.save_centres(spark, str(tmp_path / "centres"), centres, scale)
    found, stored_scale = artefacts.load_centres(spark, str(tmp_path / "centres"))
    assert (found, stored_scale) == ([list(c) for c in centres], scale)
    assert rows(clustering.assign_cluster(new, found)) == rows(clustering.assign_cluster(new, centres))
    with pytest.raises(TypeError):
        artefacts.load_centres(spark, path)


def test_a_half_written_version_is_never_read(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "centres")
    with pytest.raises(FileNotFoundError):
        artefacts.load_centres(spark, path)
    artefacts.save_centres(spark, path, [[1.0], [2.0]])
    with monkeypatch.context() as m:
        m.setattr(artefacts.snapshots, "publish", lambda *a, **k: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            artefacts.save_centres(spark, path, [[9.0]])
    assert artefacts.load_centres(spark, path) == ([[1.0], [2.0]], None)
    assert artefacts.save_centres(spark, path, [[3.0]]) == 2
    assert artefacts.load_centres(spark, path)[0] == [[3.0]] and artefacts.load_centres(spark, path, 1)[0] == [[1.0], [2.0]]


@pytest.mark.parametrize("trees", [20, 100])
def test_isolation_forest_ranks_planted_outliers(spark, trees):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=(400, 4)), np.full((3, 4), 9.0) + rng.normal(size=(3, 4))])
    df = _frame(spark, x)
    flagged, forest = anomaly.isolation_forest(df, 0.1, trees=trees)
    rows = flagged.orderBy("score").collect()
    assert {r.id for r in rows[:3]} == {400, 401, 402}
    assert sum(r.is_anomaly for r in rows) == pytest.approx(0.1 * len(x), abs=2)
    assert len(forest.trees) == trees and all(len(t["feature"]) <= 511 for t in forest.trees)
    again = anomaly.score_anomaly(df.where("id in (0, 401)"), forest)
    assert {r.id: r.label for r in again.collect()}[401] == "ANOMALY"
    assert anomaly.first_anomalies(flagged, limit=5).count() == 5


def test_average_path():
    assert anomaly.average_path([1, 2]).tolist() == [0.0, 1.0]
    harmonic = 2 * (math.log(255) + 0.5772156649) - 2 * 255 / 256
    assert float(anomaly.average_path(256)) == pytest.approx(harmonic)


def test_pca_against_numpy(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(200, 4)) @ rng.normal(size=(4, 4)) + 5
    variance, loadings, coordinates = patterns.pca(_frame(spark, x), list("abcd"), 2)
    centred = x - x.mean(0)
    values, vectors = np.linalg.eigh(np.cov(centred.T))
    values, vectors = values[::-1], vectors[:, ::-1]
    rows = variance.orderBy("component").collect()
    assert [r.explained_variance for r in rows] == pytest.approx((values / values.sum())[:2])
    assert rows[1].cumulative_variance == pytest.approx((values / values.sum())[:2].sum())
    first = vectors[:, 0] * np.sign(vectors[np.abs(vectors[:, 0]).argmax(), 0])
    got = {r.feature: r.loading for r in loadings.where("component = 1").collect()}
    assert [got[f] for f in "abcd"] == pytest.approx(first)
    assert [r.pc1 for r in coordinates.orderBy("id").collect()] == pytest.approx(centred @ first)


def test_rules_have_consequents_of_any_size(spark):
    rows = [(1, 1, 1)] * 6 + [(1, 0, 0)] * 2 + [(0, 1, 0)] * 2
    df = spark.createDataFrame(rows, "a int, b int, c int")
    items = {c: F.col(c) == 1 for c in "abc"}
    sets = patterns.frequent_itemsets(df, items, 0.1)
    assert {r.itemset: r.support for r in sets.collect()} == pytest.approx(
        {1: 0.8, 2: 0.8, 4: 0.6, 3: 0.6, 5: 0.6, 6: 0.6, 7: 0.6}
    )
    rules = {(r.antecedent, r.consequent): r for r in patterns.association_rules(sets, 0.5).collect()}
    assert rules[(4, 3)].confidence == pytest.approx(1.0) and rules[(4, 3)].lift == pytest.approx(1 / 0.6)
    assert rules[(1, 6)].confidence == pytest.approx(0.75)
    assert len(rules) == 12


def test_items_of_a_raw_profile(spark, profile):
    assert list(patterns.credit_items(profile)) == [
        "ingreso_alto", "deuda_alta_ap", "excedente_positivo", "mora_alta", "resultado_viable", "ratio_alto",
    ]
    top = patterns.apriori(profile).collect()
    assert len(top) <= 10 and all(isinstance(r.antecedents, list) for r in top)


@pytest.mark.parametrize(
    "query, module, name",
    [
        ("auto_select_k", "clustering", "auto_select_k"),
        ("kmeans", "clustering", "kmeans"),
        ("hierarchical", "clustering", "hierarchical"),
        ("full_analysis", "catalog_space", "full_analysis"),
        ("iforest", "anomaly", "isolation_forest"),
        ("iforest_unseen", "anomaly", "isolation_forest"),
    ],
)
def test_queries_run_the_operators_at_their_settings(spark, monkeypatch, query, module, name):
    from inspect import signature

    from credilake.plans import catalog_space

    owner = catalog_space if module == "catalog_space" else getattr(catalog_space, module)
    operator = signature(getattr(owner, name))

    class Called(Exception):
        pass

    def called(*args, **options):
        raise Called(operator.bind(*args, **options).arguments)

    monkeypatch.setattr(owner, name, called)
    with pytest.raises(Called) as found:
        catalog_space.QUERIES[query](spark, "/root/testdata/sf0.001")
    for k, v in found.value.args[0].items():
        assert operator.parameters[k].default in (operator.parameters[k].empty, v)


def test_auto_select_k_hands_out_its_centres(spark):
    rows = [(i, [float(i % 3) * 10 + i / 100, float(i % 2)]) for i in range(30)]
    df = spark.createDataFrame(rows, "id long, vec array<double>")
    fitted = {}
    out = clustering.auto_select_k(df, range(2, 4), restarts=2, fitted=fitted)
    assert [r["k"] for r in out.where("optimal").collect()] == [3]
    assert {k: len(v) for k, v in fitted.items()} == {2: 2, 3: 3}


def test_a_point_travels_once_to_a_group_of_cells(spark):
    """In many dimensions nearly every cell is within reach: rows and their vectors must not travel once per cell."""
    x = np.random.default_rng(3).normal(size=(600, 32))
    index = neighbors.eps_index(_frame(spark, x), 6.0, pivots=40, chunk_rows=200)
    assert 3 <= index.cells.groups <= 8 and (index.cells.parts == 1).all()
    moved = neighbors._candidates(index.own.withColumn("bound", F.lit(6.0)), index.cells, "bound", True)
    assert moved.count() <= 600 * index.cells.groups


def test_matrix_products_decide_like_differences():
    """Far from the origin, with pairs at the very edge and a row that is no number."""
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=(70, 3)) * 4) + 1e6
    y = np.vstack([np.round(rng.normal(size=(90, 3)) * 4) + 1e6, [[np.nan, 0, 0]]])
    d = np.sqrt(((x[:, None] - y[None]) ** 2).sum(-1))
    for eps in (0.0, 1.0, 5.0, math.sqrt(2)):
        assert (neighbors._near(x, y, eps) == (d <= eps)).all()
    ends, weight = np.array([20, 50, 90]), rng.integers(1, 5, 90).astype(float)
    sums = neighbors.summed_distances(x, y[:90], weight, ends)
    wanted = np.stack([d[:, a:b] @ weight[a:b] for a, b in ((0, 20), (20, 50), (50, 90))], 1)
    assert np.allclose(sums, wanted, rtol=1e-9)


def test_nearest_within_a_distance(spark, points):
    df = _frame(spark, points)
    rows = neighbors.knn_join(df, df, 3, exclude_self=True, pivots=8, chunk_rows=40, within=0.3).collect()
    wanted = {(i, j) for i, js in _brute_knn(points, 3).items() for j in js if _distances(points[[i]], points[[j]])[0, 0] <= 0.3}
    assert {(r.id, r.neighbor_id) for r in rows} == wanted


def test_labels_of_every_k_are_written_once(spark, monkeypatch):
    """Measures read stored labels: no plan of theirs holds the distances to the centres."""
    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(size=3) + 6 * (i % 3)).tolist()) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, vec array<double>")
    seen, inner = [], clustering.quality
    monkeypatch.setattr(clustering, "quality", lambda own, *a: seen.append(own) or inner(own, *a))
    fitted = {}
    found = {r.k: r for r in clustering.auto_select_k(df, range(2, 5), 2, fitted=fitted).collect()}
    assert len(seen) == 3
    for own in seen:
        plan = own._jdf.queryExecution().optimizedPlan().toString()
        assert "array_min" not in plan and "k" in plan
    for k, centres in fitted.items():
        alone = inner(clustering.assign_cluster(df, centres)).first()
        assert [alone[c] for c in alone.__fields__] == pytest.approx([found[k][c] for c in alone.__fields__])


def test_distances_to_centres_are_compiled(spark):
    rows = [(i, i % 2, [float(i), 2.0 * (i % 3), 1.0]) for i in range(8)]
    df = spark.createDataFrame(rows, "id long, cluster int, vec array<double>")
    stats = {r.cluster: r for r in cluster_metrics.cluster_stats(df).collect()}
    for c, r in stats.items():
        own = np.array([v for _, k, v in rows if k == c])
        d2 = ((own - own.mean(0)) ** 2).sum(1)
        assert (r.within, r.scatter) == (pytest.approx(d2.sum()), pytest.approx(np.sqrt(d2).mean()))
    wide = spark.createDataFrame([(i, i % 2, [float(i % (j + 2)) for j in range(40)]) for i in range(8)], df.schema)
    assert cluster_metrics.cluster_stats(wide).count() == 2
