"""Queries over vectors: neighbours, clusters, anomalies, components and rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from credilake.constants import FEATURES, KEY, TARGET
from credilake.operators import anomaly, clean, cluster_metrics, clustering, neighbors, patterns
from credilake.operators.scaling import RobustScale
from credilake.operators.supervised import knn_vote
from credilake.plans.catalog_core import _work, rounded, snapshot
from credilake.plans.unsupervised import cluster_frame, full_analysis
from credilake.session import materialize
from credilake.sources.artefacts import load_centres, load_forest, save_centres, save_forest

EPS, MIN_SAMPLES = 1.15, 5


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings as ``id, vec, cluster``."""
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(
        F.col("vec_id").alias("id"),
        F.transform("embedding", lambda v: v.cast("double")).alias("vec"),
        F.col("label").alias("cluster"),
    )


def _knn(spark, sf_dir) -> DataFrame:
    v = vectors(spark, sf_dir)
    return rounded(neighbors.knn_join(v, v, 5, exclude_self=True), 6, "distance")


def _knn_classify(spark, sf_dir) -> DataFrame:
    v = vectors(spark, sf_dir)
    near = neighbors.knn_join(v, v, 5, exclude_self=True)
    labels = v.select(F.col("id").alias("neighbor_id"), F.col("cluster").alias("label"))
    return rounded(knn_vote(near, labels), 6, "share")


def _lof(spark, sf_dir) -> DataFrame:
    return rounded(anomaly.lof(vectors(spark, sf_dir), 20), 6, "lof")


def _lof_flags(spark, sf_dir) -> DataFrame:
    flagged = anomaly.lof_anomalies(anomaly.lof(vectors(spark, sf_dir), 20), 0.1)
    return rounded(anomaly.first_anomalies(flagged), 6, "lof").select("id", "lof")


def _profiles(spark, sf_dir) -> DataFrame:
    """Profiles by the latest order's term as a given labelling."""
    df = snapshot(spark, sf_dir).withColumn("cluster", F.col("num_cuotas"))
    columns = [c for c in FEATURES if c != "num_cuotas"]
    profiles = cluster_metrics.cluster_profiles(df, columns)
    # sums of cents differ in their last bits by the order of rows: rounded twice, ties fall alike
    profiles = rounded(profiles, 8, *[f"center_{c}" for c in columns])
    return rounded(profiles, 4, *[f"center_{c}" for c in columns], "percentage", "viable_ratio")


def _assign(spark, sf_dir) -> DataFrame:
    """Every vector against the label centres as stored centres."""
    v = vectors(spark, sf_dir)
    centres = [r["centre"] for r in cluster_metrics.centroids(v).orderBy("cluster").collect()]
    return clustering.assign_cluster(v.drop("cluster"), centres).select("id", "cluster")


def _assign_stored(spark, sf_dir) -> DataFrame:
    """The same through the artefact store."""
    v = vectors(spark, sf_dir)
    path = _work(spark, "centres")
    save_centres(spark, path, [r["centre"] for r in cluster_metrics.centroids(v).orderBy("cluster").collect()])
    return clustering.assign_cluster(v.drop("cluster"), load_centres(spark, path)[0]).select("id", "cluster")


def _forest_stored(spark, sf_dir) -> DataFrame:
    """Clients that the stored forest scores or flags otherwise than the one just grown: none, of all."""
    known, new = _halves(spark, sf_dir)
    _, forest = anomaly.isolation_forest(known, 0.1)
    path = _work(spark, "forest")
    save_forest(spark, path, forest)
    fresh = anomaly.score_anomaly(new, forest).select("id", "score", "label")
    stored = anomaly.score_anomaly(new, load_forest(spark, path)).select("id", F.col("score").alias("s"), F.col("label").alias("l"))
    same = F.col("score").eqNullSafe(F.col("s")) & F.col("label").eqNullSafe(F.col("l"))
    return fresh.join(stored, "id", "full").agg(F.count("*").alias("n"), F.count_if(~same).alias("n_other"))


def _rules(spark, sf_dir) -> DataFrame:
    df = clean.clean(snapshot(spark, sf_dir))
    items = patterns.credit_items(clean.engineer_features(df))
    rules = patterns.association_rules(patterns.frequent_itemsets(df, items, 0.1), 0.5)
    return rounded(rules, 6, "support", "confidence", "lift")


def _top_rules(spark, sf_dir) -> DataFrame:
    rules = patterns.apriori(clean.engineer_features(clean.clean(snapshot(spark, sf_dir))))
    joined = rules.withColumns({c: F.array_join(c, "+") for c in ("antecedents", "consequents")})
    return rounded(joined, 6, "support", "confidence", "lift")


def _scaled(spark, sf_dir) -> DataFrame:
    df = snapshot(spark, sf_dir).select(KEY, *FEATURES)
    return rounded(RobustScale.fit(df, df.columns[1:]).transform(df), 9, *df.columns[1:])


def _inverse(spark, sf_dir) -> DataFrame:
    """Scaled and back: the original units again."""
    df = snapshot(spark, sf_dir).select(KEY, *FEATURES)
    scale = RobustScale.fit(df, df.columns[1:])
    return rounded(scale.inverse(scale.transform(df)), 6, *df.columns[1:])


def _halves(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Scaled profiles by outcome: the viable ones to learn from, the others to judge."""
    df = snapshot(spark, sf_dir)
    frame, _ = cluster_frame(df)
    marked = frame.join(df.select(F.col(KEY).alias("id"), TARGET), "id")
    return marked.where(F.col(TARGET) == 1).drop(TARGET), marked.where(F.col(TARGET) == 0).drop(TARGET)


def _unseen(spark, sf_dir) -> DataFrame:
    known, new = _halves(spark, sf_dir)
    _, forest = anomaly.isolation_forest(known, 0.1)
    return anomaly.score_anomaly(new, forest).select("id", "score", "label")


def _novelty(spark, sf_dir) -> DataFrame:
    known, new = _halves(spark, sf_dir)
    return anomaly.lof_novelty(new, known, 20)


def _density_assignment(spark, sf_dir) -> DataFrame:
    """Non-viable clients against the density clusters of the viable ones."""
    known, new = _halves(spark, sf_dir)
    labels = clustering.dbscan(known, 1.5, 5).where("is_core").select("id", "cluster")
    return clustering.assign_density_cluster(new, known.join(labels, "id"), 1.5)


def _full(spark, sf_dir) -> DataFrame:
    """Rows per part of the whole analysis."""
    parts = full_analysis(snapshot(spark, sf_dir))
    rows = None
    for name, df in parts.items():
        row = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n")
        rows = row if rows is None else rows.unionByName(row)
    return rows


def _kmeans(spark, sf_dir) -> DataFrame:
    frame, _ = cluster_frame(snapshot(spark, sf_dir))
    labelled = clustering.kmeans(frame, 4)
    return labelled.groupBy("cluster").agg(F.count("*").alias("size"))


def _hierarchical(spark, sf_dir) -> DataFrame:
    frame, _ = cluster_frame(snapshot(spark, sf_dir))
    return clustering.hierarchical(frame, 4).groupBy("cluster").agg(F.count("*").alias("size"))


def _auto_k(spark, sf_dir) -> DataFrame:
    frame, _ = cluster_frame(snapshot(spark, sf_dir))
    return clustering.auto_select_k(frame)


def _iforest(spark, sf_dir) -> DataFrame:
    frame, _ = cluster_frame(snapshot(spark, sf_dir))
    flagged, _ = anomaly.isolation_forest(frame, 0.1)
    return flagged.select(F.col("id").alias(KEY), "score", "is_anomaly")


def _pca(spark, sf_dir) -> DataFrame:
    frame, names = cluster_frame(snapshot(spark, sf_dir))
    variance, _, _ = patterns.pca(frame, names, 2)
    return variance


def _pca_coordinates(spark, sf_dir) -> DataFrame:
    frame, names = cluster_frame(snapshot(spark, sf_dir))
    return patterns.pca(frame, names, 2)[2].select("id", "pc1", "pc2")


def _client_dbscan(spark, sf_dir) -> DataFrame:
    frame, _ = cluster_frame(snapshot(spark, sf_dir))
    labels = clustering.dbscan(frame, 0.5, 5)
    return labels.groupBy("cluster").agg(F.count("*").alias("size"))


def _measure(function, *columns, **options):
    return lambda s, d: rounded(function(materialize(vectors(s, d), "vectors"), **options), 6, *columns)


QUERIES = {
    "robust_scaled": _scaled,
    "inverse_scaled": _inverse,
    "knn_topk": _knn,
    "knn_classify": _knn_classify,
    "eps_pairs": lambda s, d: rounded(neighbors.eps_join(vectors(s, d), EPS), 6, "distance"),
    "dbscan": lambda s, d: clustering.dbscan(vectors(s, d), EPS, MIN_SAMPLES),
    "dbscan_clients": _client_dbscan,
    "lof": _lof,
    "lof_anomalies": _lof_flags,
    "silhouette": _measure(cluster_metrics.silhouette, "silhouette"),
    "silhouette_squared": _measure(cluster_metrics.squared_silhouette, "silhouette"),
    "davies_bouldin": _measure(cluster_metrics.davies_bouldin, "davies_bouldin"),
    "calinski_harabasz": _measure(cluster_metrics.calinski_harabasz, "calinski_harabasz"),
    "inertia": _measure(cluster_metrics.inertia, "inertia"),
    "count_clusters": lambda s, d: cluster_metrics.count_clusters(vectors(s, d)),
    "cluster_profiles": _profiles,
    "assign_cluster": _assign,
    "assign_cluster_stored": _assign_stored,
    "iforest_stored": _forest_stored,
    "apriori_rules": _rules,
    "apriori_top": _top_rules,
    "kmeans": _kmeans,
    "hierarchical": _hierarchical,
    "auto_select_k": _auto_k,
    "iforest": _iforest,
    "iforest_unseen": _unseen,
    "lof_novelty": _novelty,
    "assign_density_cluster": _density_assignment,
    "full_analysis": _full,
    "pca": _pca,
    "pca_coordinates": _pca_coordinates,
}
