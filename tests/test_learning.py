import math
import random
import re
from dataclasses import dataclass

import numpy as np
import pytest
from conftest import DATA
from fixtures import training_rows
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from credilake.constants import FEATURES, KEY, TARGET
from credilake.operators import explain, fits, metrics, network, prep, regression, supervised, trees
from credilake.operators.prefix import totals_before
from credilake.plans import training
from credilake.sources.models import describe_model, load_model, model_registry, save_model


def small_specs(rounds: int = 15, depth: int = 4) -> dict:
    """The ten models with settings that tests can afford."""
    out = supervised.specs()
    for spec in out.values():
        if isinstance(spec, fits.TreeSpec):
            spec.trees, spec.depth, spec.grid = min(spec.trees, rounds), min(spec.depth, depth), {}
        elif isinstance(spec, fits.NetworkSpec):
            spec.hidden, spec.epochs = [8, 4], rounds
        elif isinstance(spec, fits.StumpSpec):
            spec.rounds = rounds
    return out


@pytest.fixture(scope="module")
def labelled(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 3))
    y = (x[:, 0] + 0.5 * x[:, 1] + rng.normal(scale=0.5, size=300) > 0.6).astype(int)
    rows = [(i, int(y[i]), *map(float, x[i])) for i in range(300)]
    return spark.createDataFrame(rows, f"{KEY} long, label int, a double, b double, c double")


@pytest.fixture(scope="module")
def vectors(labelled):
    df = labelled.select(KEY, "label", F.array("a", "b", "c").alias("vec"))
    return prep.balanced_weights(df)


@pytest.fixture(scope="module")
def trained(profile):
    quick = small_specs(9)
    specs = {n: quick[n] for n in ("Random Forest", "Logistic Regression", "KNN")}
    specs["AdaBoost"] = fits.StumpSpec(rounds=3)
    return training.train_all(profile, specs=specs, tune=False, cv_folds=2, stack_folds=2, select_trees=10)


def _counts(df, *columns):
    return {tuple(r[c] for c in columns): r["count"] for r in df.groupBy(*columns).count().collect()}


def test_split_is_exact_disjoint_and_repeatable(labelled):
    train, test = prep.stratified_split(labelled)
    whole, held = _counts(labelled, "label"), _counts(test, "label")
    assert all(held[c] == int(n * 0.2 + 0.5) for c, n in whole.items())
    assert train.join(test, KEY).count() == 0 and train.count() + test.count() == labelled.count()
    again = prep.stratified_split(labelled.repartition(3))[1]
    assert {r[0] for r in again.select(KEY).collect()} == {r[0] for r in test.select(KEY).collect()}


def test_dense_index_has_no_gaps(labelled):
    indexed = prep.dense_index(labelled, by="label")
    for label in (0, 1):
        values = sorted(r.idx for r in indexed.where(F.col("label") == label).collect())
        assert values == list(range(len(values)))


def test_folds_are_balanced(labelled):
    counts = _counts(prep.stratified_folds(labelled, 5), "label", "fold")
    for label in (0, 1):
        sizes = [n for (c, _), n in counts.items() if c == label]
        assert len(sizes) == 5 and max(sizes) - min(sizes) <= 1


def test_random_split_is_a_partition(labelled):
    train, test = prep.random_split(labelled)
    assert train.count() + test.count() == labelled.count() and 30 < test.count() < 90


def test_selection_keeps_the_nodes_of_its_rows(labelled, monkeypatch):
    fitted = []

    class Watched(RandomForestClassifier):
        def fit(self, dataset, params=None):
            fitted.append(self)
            return super().fit(dataset, params)

    monkeypatch.setattr(prep, "RandomForestClassifier", Watched)
    df = labelled.withColumns({"d": F.col("a") * F.col("b"), "e": F.col("a") + F.col("c")})
    names = ["a", "b", "c", "d", "e"]
    chosen = prep.select_features(df, names, trees=20, depth=6)
    # rows do not walk down from the root at each level, and the forest is the one that walks grow
    assert fitted[0].getCacheNodeIds() and fitted[0].getNumTrees() == 20
    walked = RandomForestClassifier(labelCol="label", numTrees=20, maxDepth=6, seed=42, cacheNodeIds=False)
    importance = walked.fit(VectorAssembler(inputCols=names, outputCol="features").transform(df)).featureImportances
    assert chosen == [n for n, v in zip(names, importance.toArray()) if v >= np.median(importance.toArray())]


def test_weights(labelled):
    weighted = prep.balanced_weights(labelled)
    sums = {r.label: r.s for r in weighted.groupBy("label").agg(F.sum("weight").alias("s")).collect()}
    assert sums[0] == pytest.approx(150) and sums[1] == pytest.approx(150)


def test_smote_reaches_parity_between_neighbours(labelled):
    features = ["a", "b", "c"]
    out = prep.smote(labelled, features)
    counts = _counts(out, "label")
    assert counts[(0,)] == counts[(1,)]
    original = {r[KEY] for r in labelled.select(KEY).collect()}
    made = [r for r in out.collect() if r[KEY] not in original]
    assert made and len({r[KEY] for r in made}) == len(made)
    small = min(_counts(labelled, "label").items(), key=lambda kv: kv[1])[0][0]
    x = np.array([[r[c] for c in features] for r in labelled.where(F.col("label") == small).collect()])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    near = [(i, j) for i in range(len(x)) for j in np.argsort(d[i])[:3]]
    start, along = x[[i for i, _ in near]], x[[j for _, j in near]] - x[[i for i, _ in near]]
    for r in made:
        assert r.label == small
        p = np.array([r[c] for c in features])
        u = ((p - start) * along).sum(1) / (along**2).sum(1)
        gap = np.linalg.norm(p - (start + u[:, None] * along), axis=1)
        assert ((gap < 1e-9) & (u > -1e-9) & (u < 1 + 1e-9)).any()


def test_smote_leaves_tiny_classes_alone(spark):
    df = spark.createDataFrame([(i, int(i < 2), float(i)) for i in range(9)], f"{KEY} long, label int, a double")
    assert prep.smote(df, ["a"]).count() == 9


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(0, 1), st.sampled_from([0.0, 0.1, 0.25, 0.5, 0.7, 0.99, 1.0])), min_size=2, max_size=40))
def test_auc_with_ties(spark, rows):
    got = metrics.roc_auc(spark.createDataFrame(rows, "label int, p double")).first()[0]
    pos, neg = [p for y, p in rows if y], [p for y, p in rows if not y]
    if not pos or not neg:
        assert got is None
    else:
        wins = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg)
        assert got == pytest.approx(wins / (len(pos) * len(neg)))


def test_auc_of_saturated_scores_per_group(spark):
    rnd = random.Random(5)
    rows = [(g, int(rnd.random() < 0.4), 1.0 - rnd.choice([0.0, 1e-16, 1e-9, rnd.random() * 1e-3])) for g in ("a", "b", None) for _ in range(400)]
    rows += [("c", 1, 0.5), ("a", 1, None)]
    got = {r[0]: r[1] for r in metrics.roc_auc(spark.createDataFrame(rows, "g string, label int, p double"), by=("g",)).collect()}
    assert got["c"] is None
    for g in ("a", "b", None):
        pos = [p for k, y, p in rows if k == g and y and p is not None]
        neg = [p for k, y, p in rows if k == g and not y]
        assert got[g] == pytest.approx(sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg)))


def test_totals_before_against_a_loop(spark):
    rnd = random.Random(6)
    rows = [(rnd.choice(["x", "y", None]), i, rnd.randint(-5, 5)) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, at long, n long").repartition(7)
    for by in ((), ("g",)):
        got = {r.at: r.before for r in totals_before(df, "n", "at", by).collect()}
        assert got == {a: sum(n for h, b, n in rows if b < a and (not by or h == g)) for g, a, _ in rows}
    assert totals_before(df.limit(0), "n", "at").count() == 0


def test_metrics_without_positives(spark):
    row = metrics.classification_metrics(spark.createDataFrame([(0, 0), (0, 0)], "label int, predicted int")).first()
    assert (row.accuracy, row.precision, row.recall, row.f1_score) == (1.0, 0.0, 0.0, 0.0)


def test_best_model_ignores_failures(spark):
    rows = [("a", 0.9, 0.5, None), ("b", 0.7, 0.8, None), ("c", None, None, "boom")]
    df = spark.createDataFrame(rows, "model string, f1_score double, roc_auc double, error string")
    assert metrics.best_model(df).first().model == "b"


def test_ols_against_normal_equations(labelled):
    fit = regression.fit_ols(labelled, ["a", "b", "c"], "label")
    rows = labelled.collect()
    x = np.array([[1, r.a, r.b, r.c] for r in rows])
    w = np.linalg.solve(x.T @ x, x.T @ np.array([r.label for r in rows]))
    assert [fit.intercept, *fit.coefficients.values()] == pytest.approx(w)
    assert fit.formula().startswith(f"y = {w[0]:.4f} + {w[1]:.4f}*a")
    _, scores = regression.linear_regression(labelled, ["a", "b", "c"], "label")
    assert 0 < scores.first().mse < 0.25


def test_logistic_against_newton(vectors):
    model = supervised.logistic(0.5, 200).fit(vectors).model
    rows = vectors.collect()
    x = np.array([[1, *r.vec] for r in rows])
    y, s = np.array([r.label for r in rows]), np.array([r.weight for r in rows])
    w, ridge = np.zeros(4), np.diag([0, 1, 1, 1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ w))
        gradient = ridge @ w + 0.5 * x.T @ (s * (p - y))
        w -= np.linalg.solve(ridge + 0.5 * (x.T * (s * p * (1 - p))) @ x, gradient)
    assert [model.intercept, *model.coefficients] == pytest.approx(w, abs=1e-4)


def test_adaboost_follows_samme(vectors):
    model = fits.StumpSpec(rounds=5, learning_rate=0.5).fit(vectors)
    rows = vectors.collect()
    x, y = np.array([r.vec for r in rows]), np.array([r.label for r in rows])
    w = np.full(len(y), 1 / len(y))
    assert len(model.stumps) == 5
    for alpha, f, threshold, low, high in model.stumps:
        wrong = np.where(x[:, f] <= threshold, low, high) != y
        error = w[wrong].sum()
        assert 0 < error < 0.5
        assert alpha == pytest.approx(0.5 * math.log((1 - error) / error))
        w = w * np.where(wrong, math.exp(alpha), 1)
        w /= w.sum()
    total = sum(s[0] for s in model.stumps)
    vote = sum(a * (2 * np.where(x[:, f] <= t, lo, hi) - 1) for a, f, t, lo, hi in model.stumps) / total
    got = {r[KEY]: r.p for r in model.transform(vectors).collect()}
    assert [got[r[KEY]] for r in rows] == pytest.approx(1 / (1 + np.exp(-vote)))


def test_knn_zero_distance_takes_all(spark):
    near = spark.createDataFrame([(1, 10, 0.0), (1, 11, 0.1), (1, 12, 0.1)], "id long, neighbor_id long, distance double")
    labels = spark.createDataFrame([(10, 0), (11, 1), (12, 1)], "neighbor_id long, label int")
    row = supervised.knn_vote(near, labels).first()
    assert (row.predicted, row.share) == (0, 1.0)


def test_out_of_fold_never_sees_its_rows(vectors):
    class Memory:
        """Predicts 1 for rows it was trained on."""

        def __init__(self, seen=None):
            self.seen = seen

        def fit(self, df):
            return Memory(df.select(KEY).withColumn("p", F.lit(1.0)))

        def transform(self, df):
            out = df.join(self.seen, KEY, "left").withColumn("p", F.coalesce("p", F.lit(0.0)))
            return out.withColumn("predicted", F.lit(0))

    votes = supervised.StackedSpec({"memory": Memory()}, 3).out_of_fold(vectors)
    assert votes.count() == vectors.count()
    assert {r["p_memory"] for r in votes.collect()} == {0.0}


def test_every_preset_fits(vectors):
    for name, spec in small_specs(3).items():
        scored = spec.fit(vectors).transform(vectors)
        assert {"p", "predicted", KEY} <= set(scored.columns), name
        assert scored.where("p < 0 or p > 1 or p is null").count() == 0, name


def test_full_settings_are_the_fixed_ones():
    full = supervised.specs()
    rf = full["Random Forest"]
    assert (rf.trees, rf.depth, rf.least, rf.features) == (300, 20, 2, "sqrt")
    assert full["AdaBoost"].rounds == 300 and full["KNN"].k == 5
    assert full["Neural Network"].hidden == [256, 128, 64, 32]
    assert math.prod(len(v) for v in full["Random Forest"].grid.values()) == 36
    assert math.prod(len(v) for v in full["XGBoost"].grid.values()) == 18


def test_training(trained, spark, tmp_path, profile):
    rows = {r.model: r for r in trained.metrics.collect()}
    assert all(r.error is None for r in rows.values()), rows
    assert set(rows) == {"Random Forest", "Logistic Regression", "KNN", "AdaBoost", training.ENSEMBLE}
    value = {m: 0.5 * r.f1_score + 0.5 * r.roc_auc for m, r in rows.items()}
    assert value[trained.best] == max(value.values())
    assert 1 <= len(trained.preprocessor.names) <= prep.MAX_SELECTED
    assert trained.cv.count() == 8
    top = metrics.top_importance(trained.importance, 3)
    assert max(_counts(top, "model").values()) == 3
    registry = {r.model: r for r in model_registry(trained).collect()}
    assert sum(r.is_best for r in registry.values()) == 1 and "StackedModel" in registry[training.ENSEMBLE].architecture


def test_store_round_trip(trained, spark, tmp_path, profile):
    for name in (training.ENSEMBLE, "KNN"):
        path = str(tmp_path / name.split()[0])
        save_model(spark, path, name, trained.models[name], trained.preprocessor)
        stored_name, model, preprocessor = load_model(spark, path)
        assert stored_name == name
        before = training.predict(profile, trained.preprocessor, trained.models[name], name).select(KEY, "probability")
        after = training.predict(profile, preprocessor, model, name).select(KEY, "probability")
        assert sorted(map(tuple, before.collect())) == sorted(map(tuple, after.collect()))


def test_predict_batch_keeps_rows_and_columns(trained, profile):
    model = trained.models["Logistic Regression"]
    out = training.predict_batch(profile, trained.preprocessor, model, "Logistic Regression")
    rows = out.collect()
    assert len(rows) == profile.count()
    assert all((r.prediction == 1) == (r.prediction_label == "VIABLE") for r in rows)
    assert all(r.confidence == pytest.approx(100 * max(r.probability, 1 - r.probability), abs=0.02) for r in rows)
    base = {r[KEY]: r.num_deudas for r in profile.collect()}
    assert all(base[r[KEY]] == r.num_deudas for r in rows)


def test_failing_model_is_reported(profile):
    class Broken:
        def fit(self, df):
            raise ValueError("no")

    result = training.train_all(
        profile, specs={"Broken": Broken(), "KNN": supervised.KnnSpec(3)}, tune=False, cv_folds=0, stacking=False, select_trees=5
    )
    rows = {r.model: r.error for r in result.metrics.collect()}
    assert rows["Broken"] == "no" and rows["KNN"] is None and result.best == "KNN"


def test_network_architecture(vectors):
    model = fits.NetworkSpec([5, 4], 5).fit(vectors)
    info = describe_model(model)
    assert [layer["width"] for layer in info["layers"]] == [3, 5, 4, 1]
    assert [layer["parameters"] for layer in info["layers"]] == [0, 3 * 5 + 5, 5 * 4 + 4, 4 * 1 + 1]
    assert [layer["kind"] for layer in info["layers"]] == ["input", "relu", "relu", "logistic"]


def test_network_gradients_are_slopes():
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(20, 3)), (rng.random(20) > 0.5).astype(float)
    net = network.Network([rng.normal(size=(3, 4)), rng.normal(size=(4, 1))], [rng.normal(size=4), rng.normal(size=1)])

    def loss():
        p = net.score(x)
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean() + network.DECAY / 2 / len(x) * sum((w**2).sum() for w in net.weights)

    for values, slopes in zip(net.weights + net.biases, network.gradients(net, x, y)):
        for i in np.ndindex(values.shape):
            before = values[i]
            values[i] = before + 1e-6
            up = loss()
            values[i] = before - 1e-6
            down = loss()
            values[i] = before
            assert slopes[i] == pytest.approx((up - down) / 2e-6, abs=1e-6)


def test_network_learns_what_a_line_cannot():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(2000, 4))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    net = network.fit(x[:1500], y[:1500], [32, 16], 200, 1)
    assert fits.auc(y[1500:], net.score(x[1500:])) > 0.95


def _best_split(codes, y, w, impurity, least):
    """(gain, feature, cut) by trying every split."""

    def worth(rows):
        total, ones = w[rows].sum(), (w * y)[rows].sum()
        if not total:
            return 0.0
        if impurity == "entropy":
            return total * sum(q * math.log2(q) for q in (ones / total, 1 - ones / total) if q > 0)
        return ones * ones / total

    everything, best = np.ones(len(y), bool), (-1.0, 0, 0)
    for f in range(codes.shape[1]):
        for c in range(codes[:, f].max()):
            low = codes[:, f] <= c
            if low.sum() >= least and (~low).sum() >= least:
                gain = worth(low) + worth(~low) - worth(everything)
                if gain > best[0] + 1e-9:
                    best = gain, f, c
    return best


@pytest.mark.parametrize("impurity", ["variance", "entropy"])
def test_splits_are_the_best_ones(impurity):
    rng = np.random.default_rng(3)
    for least in (1, 5):
        x = rng.normal(size=(60, 4)).round(1)
        y, w = (x[:, 1] + rng.normal(size=60) > 0).astype(float), rng.random(60) + 0.5
        codes = trees.binned(x, trees.bin_edges(x))
        tree = trees.grow(codes, y, w, np.ones(60), 3, least, impurity=impurity)
        node = np.zeros(60, int)
        for step in range(tree.depth):
            for n in np.unique(node):
                own = node == n
                if tree.left[n] != n:
                    gain, f, c = _best_split(codes[own], y[own], w[own], impurity, least)
                    assert tree.gain[n] == pytest.approx(gain) and (tree.feature[n], tree.cut[n]) == (f, c)
                assert tree.value[n] == pytest.approx(np.average(y[own], weights=w[own]))
            node = tree.walk(codes, step + 1)


def test_bins_keep_the_order():
    x = np.random.default_rng(4).normal(size=(500, 3)).round(2)
    x[:, 2] = (x[:, 2] > 0) * 1.0
    edges = trees.bin_edges(x)
    codes = trees.binned(x, edges)
    assert max(map(len, edges)) < trees.BINS and len(edges[2]) == 1
    for f in range(3):
        order = np.argsort(x[:, f], kind="stable")
        assert (np.diff(codes[order, f].astype(int)) >= 0).all()
        assert all(((x[:, f] <= e) == (codes[:, f] <= i)).all() for i, e in enumerate(edges[f]))


def _held(rng, n=1500):
    x = rng.normal(size=(n, 6))
    y = (x[:, 0] * x[:, 1] + x[:, 2] + rng.normal(size=n) * 0.5 > 0).astype(float)
    return fits.Sample(x, y, np.ones(n), np.arange(n) % 3)


@pytest.mark.parametrize("kind", ["forest", "boost", "tree"])
def test_as_good_as_the_librarys_trees(spark, kind):
    from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, RandomForestClassifier
    from pyspark.ml.functions import vector_to_array

    whole = _held(np.random.default_rng(5))
    own, held = whole.without(0), whole.rows(whole.fold == 0)
    frame = lambda s: supervised.with_vector(
        spark.createDataFrame([(i, float(y), v.tolist()) for i, (y, v) in enumerate(zip(s.y, s.x))], f"{KEY} long, label double, vec array<double>")
    )
    spec, library = {
        "forest": (fits.TreeSpec("forest", 100, 10, 2, "sqrt"), RandomForestClassifier(numTrees=100, maxDepth=10, minInstancesPerNode=2, featureSubsetStrategy="sqrt", seed=1)),
        "boost": (fits.TreeSpec("boost", 40, 4, step=0.1), GBTClassifier(maxIter=40, maxDepth=4, stepSize=0.1, seed=1)),
        "tree": (fits.TreeSpec("tree", 1, 5, 2, impurity="entropy"), DecisionTreeClassifier(impurity="entropy", maxDepth=5, minInstancesPerNode=2)),
    }[kind]
    rows = library.fit(frame(own)).transform(frame(held)).select(KEY, vector_to_array("probability")[1].alias("p")).orderBy(KEY).collect()
    theirs = fits.auc(held.y, np.asarray([r["p"] for r in rows]))
    ours = fits.auc(held.y, spec.fit_rows(own).score(held.x))
    assert ours > theirs - 0.01


@pytest.mark.parametrize("kind", ["forest", "boost"])
def test_one_growth_answers_all_its_grid_points(kind):
    whole = _held(np.random.default_rng(6), 400)
    own, held = whole.without(1), whole.rows(whole.fold == 1)
    spec = fits.TreeSpec(kind, 5, 3, features="sqrt", grid={"trees": [3, 6], "depth": [2, 5], "least": [1, 4]})
    groups = spec.groups()
    assert len(groups) == (2 if kind == "forest" else 4) and sum(map(len, groups)) == 8
    for group in groups:
        alone = [fits.auc(held.y, p.fit_rows(own).score(held.x)) for p in group]
        assert fits.TreeSpec.scores(group, own, held) == pytest.approx(alone)


def test_fits_of_folds_do_not_see_their_rows_and_repeat(vectors):
    folded = prep.stratified_folds(vectors, 3)
    specs = {"a": fits.TreeSpec("boost", 5, 3), "b": fits.NetworkSpec([4], 3), "c": fits.StumpSpec(4)}
    found = supervised.fit_models(folded, specs, 3)
    assert set(found) == {(n, f) for n in specs for f in (None, 0, 1, 2)}
    whole = fits.sample(folded)
    assert len(whole.y) == vectors.count() and set(whole.fold) == {0, 1, 2}
    for f in range(3):
        alone = specs["a"].fit_rows(whole.without(f))
        assert (found["a", f].local.value == alone.value).all()
    votes = {r[KEY]: r.p for r in supervised.out_of_fold(folded, "a", found, 3).collect()}
    for r in folded.where("fold = 1").collect():
        assert votes[r[KEY]] == pytest.approx(found["a", 1].local.score(np.asarray([r.vec]))[0])


def test_sample_is_bounded_and_repeatable(vectors):
    a, b = fits.sample(vectors, 50), fits.sample(vectors.repartition(5), 50)
    assert len(a.y) == 50 and (a.x == b.x).all() and (a.y == b.y).all()


def test_grid_search_picks_the_best_of_the_grid(vectors):
    spec = fits.TreeSpec("forest", 6, 4, features="sqrt", grid={"depth": [1, 3], "trees": [2, 6]})
    scores = {(p.trees, p.depth): s for _, p, s in fits.grid_scores(vectors, {"x": spec}, 2)}
    assert set(scores) == {(t, d) for t in (2, 6) for d in (1, 3)}
    chosen = spec.tune(vectors, folds=2)
    assert scores[chosen.trees, chosen.depth] == max(scores.values())


def test_measures_per_group(spark):
    rng = np.random.default_rng(7)
    rows = [(g, int(rng.random() > 0.5), round(float(rng.random()), 1), int(rng.random() > 0.5)) for g in "abc" for _ in range(40)]
    df = spark.createDataFrame(rows, "g string, label int, p double, predicted int")
    got = {r["g"]: r.asDict() for r in metrics.evaluate_groups(df, "g").collect()}
    for g in "abc":
        assert {m: got[g][m] for m in metrics.METRICS} == pytest.approx(metrics.evaluate(df.where(F.col("g") == g)))


def test_linear_shap(labelled):
    rows = labelled.collect()
    got = {r.feature: r.mean_abs_shap for r in explain.linear_shap(labelled, {"a": 2.0, "b": -1.0}).collect()}
    a, b = np.array([r.a for r in rows]), np.array([r.b for r in rows])
    assert got == pytest.approx({"a": np.abs(2 * (a - a.mean())).mean(), "b": np.abs(b - b.mean()).mean()})


def test_shapley_steps_add_up(vectors):
    class Linear:
        def transform(self, df):
            v = F.col("vec")
            return df.withColumn("p", v[0] * 0.5 - v[1] * 0.25).withColumn("predicted", F.lit(0))

    values = explain.shapley_values(Linear(), vectors, ["a", "b", "c"], permutations=3)
    rows = values.collect()
    assert len(rows) == vectors.count() * 3
    # a linear model's contribution is coefficient * (x - mean reference), so c counts for nothing
    assert all(abs(r.shap) < 1e-12 for r in rows if r.feature == "c")
    x = {r[KEY]: r.vec for r in vectors.collect()}
    by = {(r.id, r.feature): r.shap for r in rows}
    for i in {r.id for r in rows}:
        reference_a = x[i][0] - by[i, "a"] / 0.5
        assert min(v[0] for v in x.values()) - 1e-9 <= reference_a <= max(v[0] for v in x.values()) + 1e-9


def test_retraining(spark, profile):
    none = profile.select(*FEATURES, F.lit(None).cast("int").alias("true_label"))
    summary, result = training.retrain_with_feedback(profile, none)
    assert summary["feedback_added"] == 0 and result is None
    some = profile.select(*FEATURES, F.col(TARGET).alias("true_label"))
    summary, result = training.retrain_with_feedback(
        profile, some, specs={"KNN": supervised.KnnSpec(3)}, tune=False, cv_folds=0, stacking=False, select_trees=5
    )
    labelled = profile.where(F.col(TARGET).isNotNull()).count()
    assert summary["feedback_added"] == labelled
    assert summary["total_combined"] == profile.count() + labelled and result.best == "KNN"


def test_leaky_order_is_available(spark):
    frames = training_rows(spark)
    for _ in range(3):
        frames = frames.unionByName(frames.withColumn(KEY, F.col(KEY) + frames.count()))
    train, test, preprocessor = training.prepare(frames, leaky=True, select_trees=5)
    assert train.count() and test.count() and preprocessor.names


def test_full_analysis(spark, profile):
    from credilake.plans.unsupervised import full_analysis

    out = full_analysis(
        profile, range(2, 4), restarts=1, eps=2.0, trees=20, neighbours=10, micro_clusters=20, silhouette_metric="squared"
    )
    n = profile.count()
    assert {"optimal_k", "kmeans", "dbscan", "hierarchical", "iforest", "lof", "pca"} <= set(out)
    for name in ("kmeans", "dbscan", "hierarchical"):
        assert sum(r["size"] for r in out[name].collect()) == n
    assert out["pca"].count() == out["lof"].count() == n
    assert {"cluster_kmeans", "cluster_dbscan", "cluster_hierarchical"} <= set(out["pca"].columns)
    assert DATA


def test_repeated_keys_keep_their_rows(spark, vectors):
    """Every second row shares its key with another one, with other values."""
    rows = vectors.withColumn(KEY, F.floor(F.col(KEY) / 2).cast("long"))
    votes = supervised.StackedSpec({"knn": supervised.KnnSpec(3)}, 3).out_of_fold(rows)
    assert votes.count() == rows.count() and votes.columns[:2] == [KEY, "label"]
    scored = supervised.KnnSpec(3).fit(rows).transform(rows)
    assert scored.count() == rows.count() and set(scored.columns) == {*rows.columns, "p", "predicted"}
    assert scored.where("p is null").count() == 0


def test_labels_are_looked_up_without_a_shuffle(labelled):
    plan = prep.balanced_weights(labelled)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan


class Called(Exception):
    pass


def _stop(*args, **options):
    raise Called(options)


@pytest.mark.parametrize(
    "query, operator",
    [
        *[(q, "train_all") for q in ("models_metrics", "cross_validation", "stacking", "importance", "model_registry", "model_store", "predict_batch", "shap")],
        ("train_targets", "train_targets"),
        ("retrain", "retrain_with_feedback"),
    ],
)
def test_queries_train_at_the_full_settings(spark, monkeypatch, query, operator):
    from credilake.plans import catalog_learn

    monkeypatch.setattr(catalog_learn, "_TRAINED", {})
    monkeypatch.setattr(catalog_learn.training, operator, _stop)
    with pytest.raises(Called) as found:
        catalog_learn.QUERIES[query](spark, "/root/testdata/sf0.001")
    assert found.value.args[0] == {}


@pytest.mark.parametrize("query", ["adaboost", "boosted_models", "grid_search"])
def test_queries_fit_models_at_the_full_settings(spark, monkeypatch, query):
    from credilake.plans import catalog_learn

    full, prepared, used = supervised.specs(), [], []
    monkeypatch.setattr(catalog_learn.training, "prepare", lambda df, **o: prepared.append(o) or (None, None, None))

    def stop(df, specs, *args, **options):
        used.append(specs if isinstance(specs, dict) else {"AdaBoost": specs})
        _stop()

    for name in ("fit_all", "fit_one", "grid_scores"):
        monkeypatch.setattr(fits, name, stop)
    with pytest.raises(Called):
        catalog_learn.QUERIES[query](spark, "/root/testdata/sf0.001")
    assert prepared == [{}] and used[0] and used[0] == {n: full[n] for n in used[0]}


def test_shapley_rows_do_not_meet_their_neighbours(vectors):
    class Linear:
        def transform(self, df):
            return df.withColumns({"p": F.col("vec")[0] * 0.5, "predicted": F.lit(0)})

    values = explain.shapley_values(Linear(), vectors, ["a", "b", "c"], permutations=3)
    plan = values._jdf.queryExecution().executedPlan().toString()
    # one join, with the reference rows; a key of each path row as a join key would shuffle all of them
    assert "lag(" not in plan and not re.search(r"Join \[id_cliente", plan) and "paths-" not in plan


def test_base_models_score_the_test_rows_once(spark, profile):
    scored = []

    @dataclass
    class Counted:
        inner: object

        def fit(self, df):
            return Counted(self.inner.fit(df))

        def transform(self, df):
            scored.append(1)
            return self.inner.transform(df)

    specs = {"Logistic Regression": Counted(supervised.logistic(0.5, 5))}
    found = training.train_all(profile, specs=specs, tune=False, cv_folds=2, stack_folds=2, select_trees=5)
    assert len(scored) == 3  # the test rows and each fold
    ensemble = found.predictions[training.ENSEMBLE]
    assert ensemble.columns == found.predictions["Logistic Regression"].columns
    assert ensemble.count() == found.predictions["Logistic Regression"].count()


def test_deep_trees_score_as_by_walking():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(900, 4))
    y = (x[:, 0] + rng.normal(size=900) > 0).astype(float)
    edges = trees.bin_edges(x)
    codes = trees.binned(x, edges)
    grown = trees.forest(codes, y, np.ones(900), 7, 25, 1, 2, 3)
    ensemble = trees.Ensemble.of(grown, edges, [1 / 7] * 7, False)
    assert ensemble.depth > trees.BRANCHING
    walked = np.stack([t.value[t.walk(codes)] for t in grown], 1) @ ensemble.scale
    assert ensemble.score(x) == pytest.approx(walked)
    assert len(ensemble.score(x[:0])) == 0


@pytest.fixture
def counted():
    class Counted:
        """A spec whose model, one stump, tells how many rows it was fitted on and what their first numbers add up to."""

        def fit_rows(self, s):
            return [(float(len(s.y)), 0, float(s.x[:, 0].sum()), 0, 1)]

    return Counted()


@pytest.fixture(scope="module")
def many(spark):
    """More rows than the fits once took."""
    n = F.col("id")
    vec = F.array(n.cast("double"), F.pmod(F.xxhash64("id"), F.lit(1000)).cast("double"), F.sin(n.cast("double")))
    label = (F.pmod(F.xxhash64("id"), F.lit(1000)) + 300 * F.sin(n.cast("double")) > 500).cast("int")
    return spark.range(0, 9500, 1, 5).select(n.alias(KEY), label.alias("label"), vec.alias("vec"), F.lit(1.0).alias("weight"))


def test_fits_take_all_rows(many, counted):
    folded = prep.stratified_folds(many, 3)
    found = fits.fit_all(folded, {"a": counted}, 3)
    assert found["a", None].stumps == [(9500, 0, 9500 * 9499 / 2, 0, 1)] == fits.fit_one(many, counted).stumps
    assert sum(9500 - found["a", f].stumps[0][0] for f in range(3)) == 9500
    model = fits.TreeSpec("tree", 1, 4, 2, impurity="entropy").fit(many).local
    alone = fits.TreeSpec("tree", 1, 4, 2, impurity="entropy").fit_rows(fits.sample(many))
    assert (model.value == alone.value).all() and (model.threshold == alone.threshold).all()


def test_grid_scores_take_all_rows(many):
    spec = fits.TreeSpec("boost", 2, 2, grid={"depth": [1, 2]})
    scores = {p.depth: s for _, p, s in fits.grid_scores(many, {"x": spec}, 2)}
    whole = fits.sample(prep.stratified_folds(many, 2))
    assert len(whole.y) == 9500
    for depth, score in scores.items():
        point = fits.TreeSpec("boost", 2, depth)
        held = [whole.rows(whole.fold == f) for f in range(2)]
        assert score == pytest.approx(np.mean([fits.auc(h.y, point.fit_rows(whole.without(f)).score(h.x)) for f, h in enumerate(held)]))


def test_training_uses_all_rows(many, counted):
    columns = [F.col("vec")[i].alias(c) for i, c in enumerate(("ingreso_mensual", "total_gastos", "mora_diaria"))]
    rest = [F.lit(0.0).alias(c) for c in FEATURES if c not in ("ingreso_mensual", "total_gastos", "mora_diaria")]
    profiles = many.select(KEY, *columns, *rest, F.col("label").alias("viable")).where("id_cliente % 2 = 0 or viable = 1")
    profiles = profiles.unionByName(profiles.withColumn(KEY, F.col(KEY) + 10000))
    found = training.train_all(profiles, specs={"a": counted}, tune=False, cv_folds=2, stacking=False, select_trees=2)
    assert found.models["a"].stumps[0][0] == found.train.count() > 8192


@pytest.mark.parametrize("rows, cells", [(64, 256), (1 << 16, 1)])
def test_growth_in_parts_is_the_same(monkeypatch, rows, cells):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(700, 6)).round(1)
    y, w = (x[:, 0] + rng.normal(size=700) > 0).astype(float), rng.integers(1, 4, 700).astype(float)
    edges = trees.bin_edges(x)
    codes = trees.binned(x, edges)

    def grown():
        # whole numbers add up to the same in any order
        times = rng_times.copy()
        some = trees.grow(codes, y, w * times, times, 12, 1, 3, rng=np.random.default_rng(1))
        every = trees.grow(codes, y, w, np.ones(700), 12, 2, impurity="entropy")
        return some, every, some.walk(codes)

    rng_times = rng.poisson(1.0, 700).astype(float)
    whole = grown()
    monkeypatch.setattr(trees, "ROWS", rows)
    monkeypatch.setattr(trees, "CELLS", cells)
    parts = grown()
    for a, b in zip(whole[:2], parts[:2]):
        assert all((getattr(a, n) == getattr(b, n)).all() for n in ("feature", "cut", "left", "value", "gain"))
    assert (whole[2] == parts[2]).all()


def test_vectors_beyond_memory_are_a_scratch_file(monkeypatch):
    s = _held(np.random.default_rng(9), 400)
    specs = [fits.TreeSpec("boost", 4, 3, subsample=0.8), fits.NetworkSpec([4], 2)]
    within = [spec.fit_rows(s.without(1)).score(s.x) for spec in specs]
    monkeypatch.setattr(fits, "IN_MEMORY", 100)
    assert isinstance(fits.table(50, 6).base, np.memmap)
    for spec, p in zip(specs, within):
        assert (spec.fit_rows(s.without(1)).score(s.x) == p).all()


def test_targets_are_trained_beside_each_other(spark, monkeypatch):
    import threading

    together = threading.Barrier(3, timeout=60)

    def train(df, target, **options):
        together.wait()
        return target, options

    monkeypatch.setattr(training, "train_all", train)
    df = spark.createDataFrame([(1, 0, 1, 0)], f"{KEY} long, " + ", ".join(f"{t} int" for t in training.MULTI_TARGETS))
    found = training.train_targets(df, tune=False)
    assert list(found) == list(training.MULTI_TARGETS)
    assert all(v == (t, {"tune": False}) for t, v in found.items())
    assert training.train_targets(df.select(KEY)) == {}


@pytest.mark.parametrize("bound", [0, 1 << 28])
def test_large_models_are_held_packed(vectors, monkeypatch, bound):
    monkeypatch.setattr(fits, "UNPACKED", bound)
    folded = prep.stratified_folds(vectors, 2)
    found = fits.fit_all(folded, {"a": fits.TreeSpec("forest", 9, 6, 1)}, 2)
    model = found["a", None]
    assert isinstance(model, fits.PackedModel)
    size = int.from_bytes(model.packed()[:8], "big")
    assert sum(v.nbytes for v in vars(model.local).values() if isinstance(v, np.ndarray)) <= size > 2 * len(model.packed())
    votes = {r[KEY]: r.p for r in supervised.out_of_fold(folded, "a", found, 2).collect()}
    rows = folded.collect()
    for f in range(2):
        own = [r for r in rows if r.fold == f]
        assert [votes[r[KEY]] for r in own] == pytest.approx(found["a", f].local.score(np.asarray([r.vec for r in own])).tolist())


def test_fits_without_rows_end(vectors):
    found = fits.fit_all(vectors.where("false"), {"a": fits.NetworkSpec([2], 1), "b": fits.TreeSpec("forest", 2, 2)})
    assert set(found) == {("a", None), ("b", None)}
