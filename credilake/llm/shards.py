"""Sharding: the smallest capacity by which contiguous, unbroken groups fit into a number of shards."""

from __future__ import annotations

import bisect
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from credilake.session import materialize

SHARDS = 24
ROW_BYTES = 8

#: Bits of the group key, and how many cells of a refinement the driver looks at, at most.
KEY_BITS = 63
CELLS = 1 << 16


def sized(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``size``, ``text_crc32`` and group ``key`` of every row; equal texts have equal keys.

    Different texts with one 63-bit key would stay together too, which breaks nothing. A null text is empty.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
        F.shiftrightunsigned(F.xxhash64(text), 64 - KEY_BITS).alias("key"),
    )


@dataclass
class Cells:
    """Groups in key order as far as they are known: runs of keys (first key, bits left open, groups, size)."""

    runs: list[tuple[int, int, int, int]]

    def __post_init__(self):
        self.runs.sort()
        self.ends = []
        total = 0
        for *_, size in self.runs:
            total += size
            self.ends.append(total)
        self.total = total

    def reach(self, limit: int) -> int:
        """Largest known end of a run that is at most ``limit``."""
        i = bisect.bisect_right(self.ends, limit)
        return self.ends[i - 1] if i else 0

    def hope(self, limit: int) -> int:
        """No group can end later than here and yet at most at ``limit``."""
        i = bisect.bisect_right(self.ends, limit)
        if i == len(self.runs):
            return self.total
        whole = self.runs[i][2] == 1 or self.runs[i][1] == 0
        return (self.ends[i - 1] if i else 0) if whole else limit

    def balanced(self, capacity: int, shards: int) -> list[int]:
        """Cuts within the capacity that are as near to equal shares as what lies behind them allows."""
        earliest = [self.total]  # of each cut, from the last one: behind it must be room for the rest
        for _ in range(shards - 1):
            earliest.append(self.ends[bisect.bisect_left(self.ends, earliest[-1] - capacity)] if earliest[-1] > capacity else 0)
        at, out = 0, []
        for i, least in enumerate(reversed(earliest), 1):
            share = -(-self.total * i // shards)
            at = min(self.reach(at + capacity), max(least, self.reach(share)))
            out.append(at)
        return out

    def cuts(self, capacity: int, shards: int, step) -> list[int]:
        at, out = 0, []
        for _ in range(shards):
            at = step(at + capacity)
            out.append(at)
        return out


def _smallest(low: int, high: int, good) -> int:
    """The smallest number in (low, high] that is good, given that ``high`` is and goodness is monotone."""
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (low, middle) if good(middle) else (middle, high)
    return high


def _split(groups: DataFrame, runs: list[tuple[int, int, int, int]], bits: int) -> list[tuple[int, int, int, int]]:
    """The given runs in finer cells of ``bits`` open bits; at most ``CELLS`` come to the driver."""
    coarse = runs[0][1]
    spark = groups.sparkSession
    wanted = spark.createDataFrame([(r[0] >> coarse,) for r in runs], "run long")  # at most CELLS rows
    cell = F.shiftright("key", bits)
    found = (
        groups.withColumn("run", F.shiftright("key", coarse) if coarse < KEY_BITS else F.lit(0).cast("long"))
        .join(F.broadcast(wanted), "run", "left_semi")
        .groupBy(cell.alias("cell"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))
        .collect()
    )
    return [(r["cell"] << bits, bits, r["n"], r["size"]) for r in found]


def minimax_cuts(groups: DataFrame, shards: int, cells: int = CELLS) -> tuple[int, list[int]]:
    """Smallest capacity, and for each shard but the last the first key behind it.

    ``groups`` has ``key`` and ``size``. The driver never sees the groups: it keeps sums of key ranges, bounds
    the smallest capacity from both sides by greedy runs over them, and has only those ranges refined in which a
    cut can still fall. Each round narrows these by a factor of a hundred or so, down to single groups.
    """
    everything = [(0, KEY_BITS, 2, 0)]
    runs = _split(groups, everything, KEY_BITS - max(1, cells.bit_length() - 1))
    if not runs:
        return 0, []
    low, high = 0, None
    while True:
        known = Cells(runs)
        low = max(low, -(-known.total // shards) - 1)
        high = _smallest(low, high or known.total, lambda c: known.cuts(c, shards, known.reach)[-1] == known.total)
        low = _smallest(low, high, lambda c: known.cuts(c, shards, known.hope)[-1] == known.total) - 1
        if high - low > 1:  # where the cuts of any capacity in (low, high] can lie
            spans = zip(known.cuts(low + 1, shards, known.reach), known.cuts(high, shards, known.hope))
        else:  # where a cut can lie, so that what is behind it still fits
            latest = known.cuts(high, shards, known.hope)
            spans = [(known.total - (shards - i) * high, end) for i, end in enumerate(latest, 1)]
        unclear: set[int] = set()
        for a, b in spans:
            i, j = bisect.bisect_right(known.ends, max(0, a)), bisect.bisect_right(known.ends, b)
            unclear.update(
                k for k in range(max(0, i - 1), min(j + 1, len(known.runs))) if known.runs[k][2] > 1 and known.runs[k][1] > 0
            )
        if not unclear:
            break
        # the coarsest of them first, so that the runs of one round have the same width
        open_bits = max(known.runs[k][1] for k in unclear)
        chosen = [known.runs[k] for k in sorted(unclear) if known.runs[k][1] == open_bits]
        finer = max(1, (cells // len(chosen)).bit_length() - 1)
        gone = set(chosen)
        runs = [r for r in known.runs if r not in gone] + _split(groups, chosen, max(0, open_bits - finer))
    behind = []
    for end in known.balanced(high, shards)[:-1]:
        i = bisect.bisect_right(known.ends, end)
        behind.append(known.runs[i][0] if i < len(known.runs) else 1 << KEY_BITS)
    return high, behind


def place(rows: DataFrame, shards: int = SHARDS) -> tuple[Column, int]:
    """The shard of a row as an expression over ``key``, and the capacity.

    Groups larger than a fair share get shards of their own, first in the order, largest first; they are fewer
    than the shards. The others are cut in key order so that the largest shard is as small as it can be.
    """
    groups = materialize(rows.groupBy("key").agg(F.sum("size").alias("size")), "shard-groups")
    total = groups.agg(F.sum("size")).first()[0] or 0
    largest = groups.orderBy(F.col("size").desc(), "key").limit(shards - 1).collect()
    own: list[int] = []
    rest = total
    for r in largest:
        if r["size"] * (shards - len(own)) <= rest:
            break
        own.append(r["key"])
        rest -= r["size"]
    common = groups.where(~F.col("key").isin(own)) if own else groups
    capacity, behind = minimax_cuts(common, shards - len(own))
    shard: Column = F.lit(len(own))
    for key in behind:
        if key < 1 << KEY_BITS:
            shard = shard + (F.col("key") >= F.lit(key)).cast("int")
    for i, key in enumerate(own):
        shard = F.when(F.col("key") == F.lit(key), F.lit(i)).otherwise(shard)
    return shard.cast("int"), max([capacity, *(r["size"] for r in largest[: len(own)])])


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``doc_id, size, text_crc32, key, shard, slot`` of every row of ``docs``.

    Slots are gapless within a shard, in the order of key and id. Rows are numbered without a window over the
    shard: they are range-sorted by shard, key and id, which splits even a single huge group, and each
    partition's running number is shifted by the counts of the partitions before. Null ids come first within
    their group; repeated rows get slots of their own. Only ids, sizes and hashes are shuffled.
    """
    rows = materialize(sized(docs), "shard-rows")
    shard, _ = place(rows, shards)
    order = ["shard", "key", "doc_id", "text_crc32"]
    placed = materialize(
        rows.withColumn("shard", shard)
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("number", F.monotonically_increasing_id())
        .withColumn("part", F.shiftright("number", 33)),
        "shard-placed",
    )
    parts = placed.groupBy("shard", "part").agg(F.min("number").alias("first"), F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("shard", "part", "first", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    return placed.join(offsets, ["shard", "part"]).select(
        "doc_id",
        "size",
        "text_crc32",
        "key",
        "shard",
        (F.col("number") - F.col("first") + F.col("offset")).cast("long").alias("slot"),
    )
