"""What the text operators share: the word alphabet, row keys and reading of documents."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed by the contracts: what separates words, and is stripped from lines.
SPACE = "[\\x20\\x09-\\x0D]"
WORD = "[^\\x20\\x09-\\x0D]+"

DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def keyed(docs: DataFrame, *more: str) -> DataFrame:
    """``doc_id``, ``text`` and the named columns of ``docs``; null texts become empty. Other columns are left out."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        *more,
    )


def text_key(text: Column) -> Column:
    """128 bits that stand for a text: texts with equal keys are taken for equal."""
    return F.unhex(F.md5(text.cast("binary")))


def same_row(left: DataFrame, right: DataFrame, *names: str) -> Column:
    """Join condition that also matches nulls."""
    condition = F.lit(True)
    for name in names:
        condition &= left[name].eqNullSafe(right[name])
    return condition


def texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """The texts of a batch as UTF-8."""
    return [x or b"" for x in batch.column(name).cast(pa.binary()).to_pylist()]


def table(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.record_batch(list(columns), schema=schema)


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows``, so that few long texts are unpacked at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
