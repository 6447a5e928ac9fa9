"""Streaming jobs: scoring applications, counting by window, applying labels."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from credilake.functions import decisions, scoring
from credilake.operators.validate import REASONS, validate_applications, with_reject_reasons
from credilake.schemas import APPLICATION_SCHEMA, LABEL_SCHEMA
from credilake.sources.evaluations import evaluation_rows, valid_labels


def read_applications(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """JSON application records as they arrive, with an event time."""
    schema = T.StructType([*APPLICATION_SCHEMA.fields, T.StructField("created_at", T.TimestampType())])
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(path)


def score_stream(applications: DataFrame, predict: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Validate, predict, score, adjust, recommend: the batch projection, on a stream.

    ``predict`` adds the prediction columns; any model that is a projection will do.
    """
    valid, _ = validate_applications(applications)
    adjusted = scoring.adjust_with_probability(scoring.score(predict(valid)))
    return evaluation_rows(decisions.recommend(adjusted), F.col("created_at"))


def write_scored(
    applications: DataFrame, predict: Callable[[DataFrame], DataFrame], path: str, errors: str, checkpoint: str
) -> StreamingQuery:
    """Scores the valid applications into the log and puts the others, with their reasons, into ``errors``.

    Every row of a batch ends in one of the two tables. Both have the number of the batch as a partition, and a
    batch that is run again after a failure replaces what it had written, so nothing is missing or written twice.
    The log is partitioned by day first, for reads by date. Records that are no JSON have no field and are rejected
    for all of them. Keep this log in a folder of its own: appends of other jobs have no batch.
    """

    def write(batch: DataFrame, number: int) -> None:
        checked = with_reject_reasons(batch).withColumn("batch", F.lit(number).cast("long")).persist()
        try:
            valid, rejected = (checked.where(c).drop("batch") for c in (F.size(REASONS) == 0, F.size(REASONS) > 0))
            adjusted = scoring.adjust_with_probability(scoring.score(predict(valid.drop(REASONS))))
            rows = evaluation_rows(decisions.recommend(adjusted), F.col("created_at"))
            dated = rows.withColumns({"created_date": F.to_date("created_at"), "batch": F.lit(number).cast("long")})
            _replace_batch(dated.hint("rebalance", "created_date"), path, "created_date", "batch")
            _replace_batch(rejected.withColumn("batch", F.lit(number).cast("long")), errors, "batch")
        finally:
            checked.unpersist()

    return (
        applications.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def _replace_batch(rows: DataFrame, path: str, *partitions: str) -> None:
    """Writes the partitions that ``rows`` fall into, in place of what stood there, and leaves the others."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(path)


def write_evaluations(evaluations: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends to the log by day, exactly once by way of the sink's own commit log."""
    return (
        evaluations.withColumn("created_date", F.to_date("created_at"))
        .writeStream.format("parquet")
        .partitionBy("created_date")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def windowed_counts(
    stream: DataFrame, key: str, at: str = "created_at", window: str = "1 day", late: str = "1 hour", value: str | None = None
) -> DataFrame:
    """Rows (and the sum of ``value``) per tumbling window and key; rows later than ``late`` are dropped."""
    totals = [F.count("*").alias("n")] + ([F.sum(value).alias("total")] if value else [])
    timed = stream.withColumn(at, F.col(at).cast("timestamp"))
    return (
        timed.withWatermark(at, late)
        .groupBy(F.window(at, window).alias("w"), key)
        .agg(*totals)
        .select(F.col("w.start").alias("window_start"), key, *[c for c in ("n", "total") if c == "n" or value])
    )


def write_windows(counts: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends each window once, when the watermark has passed its end, and then frees its state.

    Windows that may still get rows are not in the table yet; the next run writes them.
    """
    return (
        counts.writeStream.outputMode("append")
        .format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def decision_counts_stream(evaluations: DataFrame, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Decisions per tumbling window."""
    return windowed_counts(evaluations, "final_decision", window=window, late=late)


def read_labels(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(LABEL_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).json(path)


def label_stream(labels: DataFrame, repeats_within: str = "30 days") -> DataFrame:
    """All valid labels, however late, each event once.

    Whether an event is known is asked of the state by its id. Rows are timed by their arrival, so old labels are
    never dropped as late ones, and an id is forgotten ``repeats_within`` after it came: a repeat later than that is
    logged again, which the live view bears. Needs no Python, and keys are events, so no evaluation is a hot spot.
    """
    keep_state_on_disk(labels.sparkSession)
    arrived = valid_labels(labels).withColumn("_arrived", F.current_timestamp()).withWatermark("_arrived", repeats_within)
    return arrived.dropDuplicatesWithinWatermark(["id", "event_id"]).drop("_arrived")


def newest_labels_stream(labels: DataFrame) -> DataFrame:
    """The newest label so far of every evaluation that a batch has events of; write it with ``write_newest_labels``.

    Rows are combined before they are shuffled, so a much relabelled evaluation is no hot spot. State is one label per
    evaluation, on disk, and stays: a straggler of any age has to be told from a newer label.
    """
    keep_state_on_disk(labels.sparkSession)
    newest = F.max(F.struct("updated_at", "event_id", "true_label")).alias("l")
    known = valid_labels(labels).dropna(subset=["id", "updated_at", "event_id"]).groupBy("id").agg(newest)
    return known.select("id", "l.true_label", "l.updated_at", "l.event_id")


def write_newest_labels(newest: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """One folder per batch, replaced if the batch runs again; at most one row per evaluation and batch."""

    def write(batch: DataFrame, number: int) -> None:
        _replace_batch(batch.withColumn("batch", F.lit(number).cast("long")), path, "batch")

    writer = newest.writeStream.outputMode("update").foreachBatch(write)
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def keep_state_on_disk(spark: SparkSession) -> None:
    """Streams started from now on keep their state in RocksDB, so that it is not bounded by memory."""
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )


def write_labels(labels: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends to the label log, from which the live view takes the latest per evaluation."""
    return (
        labels.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
