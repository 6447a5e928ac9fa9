"""The whole unsupervised analysis on one prepared frame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credilake.constants import KEY
from credilake.operators import anomaly, clean, cluster_metrics, clustering, patterns
from credilake.operators.neighbors import vector_column
from credilake.operators.scaling import RobustScale
from credilake.session import materialize


def cluster_frame(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """(``id, vec`` with cleaned, enriched and robust-scaled features, the feature names).

    Written once: every method passes over it several times.
    """
    features = clean.engineer_cluster_features(clean.clean_for_clustering(df))
    features = materialize(features, "cluster-features")
    names = clean.numeric_columns(features)
    scaled = RobustScale.fit(features, names).transform(features)
    return materialize(scaled.select(F.col(KEY).alias("id"), vector_column(names).alias("vec")), "cluster-frame"), names


def summarise(df: DataFrame, labelled: DataFrame) -> DataFrame:
    """Profiles of a labelling (``id, cluster``) in the original units."""
    joined = df.join(labelled.select(F.col("id").alias(KEY), "cluster"), KEY)
    return cluster_metrics.cluster_profiles(joined, clean.numeric_columns(df))


def full_analysis(
    df: DataFrame,
    ks: range = range(2, 9),
    restarts: int = 10,
    eps: float = 0.5,
    min_samples: int = 5,
    trees: int = 200,
    neighbours: int = 20,
    contamination: float = 0.1,
    micro_clusters: int = clustering.MICRO_CLUSTERS,
    silhouette_metric: str = "euclidean",
) -> dict[str, DataFrame]:
    """Choice of k, k-means (at the best k when that is 2 to 5, and at 4), DBSCAN, hierarchical, both anomaly
    methods and PCA with the cluster labels attached. Each entry is a DataFrame."""
    frame, names = cluster_frame(df)
    results: dict[str, DataFrame] = {}
    fitted: dict[int, list[list[float]]] = {}
    choice = materialize(
        clustering.auto_select_k(frame, ks, restarts, silhouette_metric=silhouette_metric, fitted=fitted), "choice"
    )
    four = fitted[4] if 4 in fitted else clustering.fit_kmeans(frame, 4, restarts)
    results["optimal_k"] = choice
    best = choice.where("optimal").select("k").first()["k"]
    labels = {"kmeans": clustering.assign_cluster(frame, four).select("id", "cluster")}
    if 2 <= best <= 5:
        results[f"kmeans_k{best}"] = summarise(df, clustering.assign_cluster(frame, fitted[best]))
    labels["dbscan"] = materialize(clustering.dbscan(frame, eps, min_samples).select("id", "cluster"), "dbscan")
    labels["hierarchical"] = clustering.hierarchical(frame, 4, micro_clusters).select("id", "cluster")
    for name, labelled in labels.items():
        results[name] = summarise(df, labelled)
    results["iforest"], _ = anomaly.isolation_forest(frame, contamination, trees)
    results["lof"] = anomaly.lof_anomalies(anomaly.lof(frame, neighbours), contamination)
    variance, loadings, coordinates = patterns.pca(frame, names, 2)
    for name, labelled in labels.items():
        coordinates = coordinates.join(labelled.withColumnRenamed("cluster", f"cluster_{name}"), "id")
    results |= {"pca_variance": variance, "pca_loadings": loadings, "pca": coordinates}
    return results
