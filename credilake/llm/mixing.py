"""Mixing sources to target weights: random order within a source, distributed prefix sums, an exact cut."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from credilake.llm.base import WORD
from credilake.session import materialize

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_EPOCHS = 2
SEED = 17

#: A table of sources with more rows than this is joined by shuffle, not sent to every task.
SENT_SOURCES = 100_000


def source_targets(
    sizes: Sequence[tuple[str | None, int]], weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST_EPOCHS
) -> list[tuple[str | None, int, float]]:
    """``source, size, target`` in code point order, null last.

    ``share`` of all sizes is dealt by weight; a source gets ``most`` times its size at most, and what that
    leaves is dealt again among the others until none is above.
    """
    ordered = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    weight = [weights[i % len(weights)] for i in range(len(ordered))]
    whole = share * sum(size for _, size in ordered)
    free = set(range(len(ordered)))
    while True:
        left = whole - sum(most * ordered[i][1] for i in range(len(ordered)) if i not in free)
        among = sum(weight[i] for i in free)
        full = {i for i in free if left * weight[i] / among > most * ordered[i][1]}
        if not full:
            break
        free -= full
    return [
        (source, size, left * weight[i] / among if i in free else float(most * size))
        for i, (source, size) in enumerate(ordered)
    ]


_ORDERED = "rank int, random string, doc_id long, row long, size long"


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the partition's number and how many words of the row's source come before it in this partition."""
    part = TaskContext.get().partitionId()
    rank, so_far = None, 0
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        ranks, size = batch.column("rank").to_numpy(), batch.column("size").to_numpy()
        before = np.cumsum(size) - size
        new = np.r_[True, ranks[1:] != ranks[:-1]]
        starts = np.flatnonzero(new)
        base = before[starts].copy()
        if ranks[0] == rank:
            base[0] -= so_far
        before = before - base[np.cumsum(new) - 1]
        rank, so_far = ranks[-1], int(before[-1] + size[-1])
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array(before.astype(np.int64))],
            names=[*batch.schema.names, "part", "before"],
        )


def mix(
    docs: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    share: float = SHARE,
    most: int = MOST_EPOCHS,
    seed: int = SEED,
) -> DataFrame:
    """``doc_id``, ``row`` (hash of the text), ``size``, ``source_size``, ``target`` and ``taken`` words of every row.

    ``size`` counts words. Rows get keys that look random but depend only on seed, id and text, so that reruns
    agree; rows that are equal in both are equal in everything and may swap places. Every source is
    range-sorted by key; its words are summed within each partition and then over the partitions, and the mix
    takes whole epochs, then the beginning of one more, down to the word: the row at the cut gives a part.
    Texts are never shuffled. Null texts have no words, null sources are one source, null ids are kept. The
    driver sees one row per source. A source of a third of all rows is spread over as many partitions as it needs.
    """
    rows = materialize(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.col("source").cast("string").alias("source"),
            F.xxhash64(F.coalesce("text", F.lit(""))).alias("row"),
            F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long").alias("size"),
        ),
        "mix-rows",
    )
    spark = docs.sparkSession
    sizes = [(r["source"], r["n"]) for r in rows.groupBy("source").agg(F.sum("size").alias("n")).collect()]
    targets = [(*t, i) for i, t in enumerate(source_targets(sizes, weights, share, most))]
    plan = spark.createDataFrame(targets, "source string, source_size long, target double, rank int")
    if len(targets) <= SENT_SOURCES:
        plan = F.broadcast(plan)
    order = ["rank", "random", "doc_id", "row"]
    random = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    placed = materialize(
        rows.join(plan, rows["source"].eqNullSafe(plan["source"]))
        .select("rank", random.alias("random"), "doc_id", "row", "size")
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .mapInArrow(_prefixes, _ORDERED + ", part int, before long"),
        "mix-placed",
    )
    # one row per partition and source within it: their running sums are as small as the number of partitions
    parts = placed.groupBy("rank", "part").agg(F.sum("size").alias("n"))
    earlier = Window.partitionBy("rank").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("rank", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    rest = F.round("target").cast("long") - F.col("epochs") * F.col("source_size")
    start = F.col("before") + F.col("offset")
    return (
        placed.join(offsets, ["rank", "part"])
        .join(plan, "rank")
        .withColumn("epochs", epochs.cast("long"))
        .withColumn("taken", F.col("epochs") * F.col("size") + F.least(F.col("size"), F.greatest(F.lit(0), rest - start)))
        .select("doc_id", "row", "size", "source_size", "target", F.col("taken").cast("long").alias("taken"))
    )


def mixed_documents(docs: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it; the row at a source's cut comes whole if at least
    half of it is taken. Settings as in ``mix``. Rows without words never come more than once, and stay."""
    taken = mix(docs, **settings)
    copies = F.when(F.col("size") > 0, F.round(F.col("taken") / F.col("size"))).otherwise(1).cast("int")
    times = taken.groupBy("doc_id", "row").agg(F.max(copies).alias("times"))
    left = docs.select(
        F.struct(*docs.columns).alias("d"),
        F.col("doc_id").cast("long").alias("id"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("row"),
    )
    joined = left.join(times, left["id"].eqNullSafe(times["doc_id"]) & (left["row"] == times["row"]))
    return (
        joined.where("times > 0")
        .select("d", F.explode(F.sequence(F.lit(1), "times")))
        .select(*[F.col(f"d.{c}").alias(c) for c in docs.columns])
    )
