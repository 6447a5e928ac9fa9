"""Training-set preparation: exact splits and folds, oversampling, weights, feature selection."""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from credilake.constants import KEY
from credilake.functions.arithmetic import num
from credilake.operators.neighbors import knn_join, vector_column

LEAST_BUCKETS = 256
MAX_SELECTED = 20  # fixed value


def hash_uniform(seed: int, *columns) -> F.Column:
    """A number in [0, 1) fixed by the row's values and the seed; unlike ``rand`` it survives recomputation."""
    return F.pmod(F.xxhash64(*columns, F.lit(seed)), F.lit(1 << 52)).cast("double") / num(1 << 52)


def dense_index(df: DataFrame, key: str = KEY, by: str | None = None, seed: int = 42, name: str = "idx") -> DataFrame:
    """Adds 0, 1, 2, ... in hash order of ``key``, restarting per value of ``by``.

    Rows are numbered inside hash buckets, which never hold more than a sliver of the table however few groups
    there are, and shifted by the bucket sizes (one number per group and bucket, sent to every task).
    """
    buckets = max(LEAST_BUCKETS, 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    group = F.lit(0) if by is None else F.col(by)
    hashed = df.withColumns(
        {"_group": group, "_hash": F.xxhash64(F.col(key), F.lit(seed))}
    ).withColumn("_bucket", F.pmod("_hash", F.lit(buckets)).cast("int"))
    sizes = hashed.groupBy("_group", "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("_group").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_group", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    within = Window.partitionBy("_group", "_bucket").orderBy("_hash", key)
    return (
        hashed.withColumn("_row", F.row_number().over(within))
        .join(F.broadcast(offsets), ["_group", "_bucket"])
        .withColumn(name, (F.col("_offset") + F.col("_row") - 1).cast("long"))
        .drop("_group", "_hash", "_bucket", "_row", "_offset")
    )


def with_row_ids(df: DataFrame, key: str = KEY) -> DataFrame:
    """Replaces ``key``, which may repeat, by a number of each row; the key stays as ``client``.

    Rows of one key are numbered in no fixed order, so the result is to be written out.
    """
    return dense_index(df, key, name="_row_id").withColumns({"client": F.col(key), key: F.col("_row_id")}).drop("_row_id")


def stratified_split(
    df: DataFrame, test_size: float = 0.2, seed: int = 42, label: str = "label", key: str = KEY
) -> tuple[DataFrame, DataFrame]:
    """(train, test) with the share exact per class, fixed by key and seed."""
    sizes = df.groupBy(label).agg(F.round(F.count("*") * num(test_size)).cast("long").alias("_test"))
    marked = dense_index(df, key, label, seed, "_idx").join(F.broadcast(sizes), label)  # a row per class
    columns = df.columns
    return (
        marked.where(F.col("_idx") >= F.col("_test")).select(*columns),
        marked.where(F.col("_idx") < F.col("_test")).select(*columns),
    )


def random_split(df: DataFrame, test_size: float = 0.2, seed: int = 42, key: str = KEY) -> tuple[DataFrame, DataFrame]:
    """(train, test) by hash threshold: one filter each, no shuffle; the share holds in expectation."""
    u = hash_uniform(seed, F.col(key))
    return df.where(u >= test_size), df.where(u < test_size)


def stratified_folds(df: DataFrame, k: int, seed: int = 42, label: str = "label", key: str = KEY) -> DataFrame:
    """Adds ``fold`` 0..k-1 with class counts that differ by one row at most."""
    return dense_index(df, key, label, seed, "_idx").withColumn("fold", (F.col("_idx") % k).cast("int")).drop("_idx")


def balanced_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Adds ``weight`` = n / (classes * n of the row's class)."""
    sizes = df.groupBy(label).agg(F.count("*").alias("_n"))
    totals = sizes.agg(F.sum("_n").alias("n"), F.count("*").alias("c")).select(F.struct("n", "c").alias("t"))
    weights = sizes.select(
        label, (totals.scalar()["n"] / (totals.scalar()["c"] * F.col("_n"))).cast("double").alias("weight")
    )
    return df.join(F.broadcast(weights), label)  # a row per class


def smote(
    df: DataFrame, features: list[str], k: int = 3, seed: int = 42, label: str = "label", key: str = KEY
) -> DataFrame:
    """Oversamples the smaller class to parity: each new row lies between a row and one of its k neighbours.

    New rows get negative keys. Every minority row serves as base equally often, up to one; neighbour and
    position are drawn by hash. A class too small for k neighbours leaves the input as it is.
    """
    sizes = {r[label]: r["count"] for r in df.groupBy(label).count().collect()}
    columns = [key, label, *features]
    base = df.select(*columns)
    if len(sizes) != 2:
        return base
    (small, n_small), (_, n_large) = sorted(sizes.items(), key=lambda kv: (kv[1], kv[0]))
    missing = n_large - n_small
    if missing == 0 or n_small <= k:
        return base
    minority = base.where(F.col(label) == small).select(
        F.col(key).cast("long").alias("id"), vector_column(features).alias("vec")
    )
    near = knn_join(minority, minority, k, exclude_self=True)
    each, extra = divmod(missing, n_small)
    copies = F.lit(each) + (F.col("_idx") < extra).cast("int")
    drawn = (
        dense_index(minority, "id", seed=seed, name="_idx")
        .withColumn("_copies", copies)
        .where(F.col("_copies") > 0)
        .withColumn("_copy", F.explode(F.sequence(F.lit(0), F.col("_copies") - 1)))
        .withColumn("rank", (F.pmod(F.xxhash64("id", "_copy", F.lit(seed)), F.lit(k)) + 1).cast("int"))
        .withColumn("_u", hash_uniform(seed + 1, F.col("id"), F.col("_copy")))
        .withColumn("_key", -(F.col("_copy").cast("long") * n_small + F.col("_idx") + 1))
    )
    there = minority.select(F.col("id").alias("neighbor_id"), F.col("vec").alias("_there"))
    made = (
        drawn.join(near.select("id", "rank", "neighbor_id"), ["id", "rank"])
        .join(there, "neighbor_id")
        .withColumn(
            "vec", F.zip_with("vec", F.transform("_there", lambda v: v), lambda a, b: a + F.col("_u") * (b - a))
        )
        .select(
            F.col("_key").alias(key),
            F.lit(small).alias(label),
            *[F.col("vec")[i].alias(c) for i, c in enumerate(features)],
        )
    )
    doubles = base.select(key, label, *[F.col(c).cast("double").alias(c) for c in features])
    return doubles.unionByName(made)


def select_features(
    df: DataFrame,
    features: list[str],
    label: str = "label",
    trees: int = 200,
    depth: int = 10,
    max_features: int = MAX_SELECTED,
    seed: int = 42,
) -> list[str]:
    """Features whose forest importance reaches the median importance, at most ``max_features``, in order."""
    assembled = VectorAssembler(inputCols=features, outputCol="features").transform(df)
    forest = RandomForestClassifier(
        featuresCol="features", labelCol=label, numTrees=trees, maxDepth=depth, seed=seed,
        cacheNodeIds=True,  # a row keeps its node of each tree: no level walks down all trees again
    ).fit(assembled)
    importance = dict(zip(features, forest.featureImportances.toArray().tolist()))
    ordered = sorted(importance.values())
    middle = len(ordered) // 2
    median = ordered[middle] if len(ordered) % 2 else (ordered[middle - 1] + ordered[middle]) / 2
    strongest = sorted((f for f in features if importance[f] >= median), key=lambda f: -importance[f])[:max_features]
    return [f for f in features if f in set(strongest)]
