"""SimHash near-duplicates: vantage-point trees over parts of the fingerprints, exact links, components."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from credilake.llm.base import keyed, sliced, texts
from credilake.operators.components import connected_components
from credilake.session import materialize

SHINGLE_WORDS = 4
MAX_DISTANCE = 4
SEED = 42

#: Parts of a fingerprint that get a tree each. Two fingerprints within the distance are within the distance
#: divided by the parts (rounded down) in one part at least.
PARTS = 3

#: Fingerprints a shard is meant to hold, and most levels of a tree.
SHARD_ROWS = 1024
MOST_LEVELS = 14
#: Sampled fingerprints per shard by which the radii are set; the sample is at most SAMPLE_ROWS * 2**MOST_LEVELS.
SAMPLE_ROWS = 32

#: A shard with more members is cut into chunks of this size, and its visitors into blocks.
CHUNK_ROWS = 2048
VISITOR_ROWS = 16384


def fingerprint(text: bytes, words: int = SHINGLE_WORDS, unique: bool = False) -> int:
    """64 bits, each the majority of that bit among the hashes of all shingles; 0 for no words or a tie.
    Repeated shingles count as often as they occur, or once if ``unique``."""
    found = text.lower().split()
    if not found:
        return 0
    k = min(words, len(found))
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1]
    shingles = [joined[a:b] for a, b in zip(starts[: len(found) - k + 1].tolist(), ends[k - 1 :].tolist())]
    if unique:
        shingles = set(shingles)
    hashes = np.fromiter(map(partial(xxh64_intdigest, seed=SEED), shingles), np.uint64, len(shingles))
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        block = hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = 2 * ones > len(hashes)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def fingerprints(
    docs: DataFrame, words: int = SHINGLE_WORDS, unique: bool = False, confirm_words: int | None = None
) -> DataFrame:
    """``doc_id``, ``row`` (hash of the text), ``fp`` (the fingerprint as a signed long) and ``other`` (that of
    shingles of ``confirm_words``, else 0) of every row."""
    schema = pa.schema([(n, pa.int64()) for n in ("doc_id", "row", "fp", "other")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            all_texts = texts(batch)
            fps = [fingerprint(t, words, unique) for t in all_texts]
            others = [fingerprint(t, confirm_words) if confirm_words else 0 for t in all_texts]
            signed = (pa.array(np.asarray(x, np.uint64).view(np.int64)) for x in (fps, others))
            yield pa.record_batch([batch.column("doc_id"), batch.column("row"), *signed], schema=schema)

    rows = keyed(docs).withColumn("row", F.xxhash64("text"))
    return rows.mapInArrow(run, "doc_id long, row long, fp long, other long")


def part_masks(parts: int = PARTS) -> list[int]:
    """The bits of each part."""
    borders = [64 * i // parts for i in range(parts + 1)]
    return [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(borders[:-1], borders[1:])]


class VantageTree:
    """A tree over one part of the fingerprints, kept as arrays: node i has the children 2i + 1 and 2i + 2.

    A fingerprint within ``radius[i]`` of ``vantage[i]`` lies inside (first child), the others outside.
    """

    def __init__(self, mask: int, levels: int, sample: np.ndarray, seed: int):
        random = np.random.default_rng(seed)
        self.mask, self.levels = np.uint64(mask), levels
        nodes = (1 << levels) - 1
        self.vantage = random.integers(0, 1 << 64, nodes, np.uint64, endpoint=False) & self.mask
        self.radius = np.zeros(nodes, np.int16)
        at = np.zeros(len(sample), np.int64)
        middle = max(0, int(mask).bit_count() // 2)
        for level in range(levels):
            first = (1 << level) - 1
            d = self.distance(sample, at)
            for node in range(first, 2 * first + 1):
                own = d[at == node] if level < 12 else d[:0]
                # half inside; an empty or tiny sample takes half of the bits
                self.radius[node] = np.sort(own)[(len(own) - 1) // 2] if len(own) >= 8 else middle
            at = 2 * at + 1 + (d > self.radius[at])

    def distance(self, fps: np.ndarray, node: np.ndarray) -> np.ndarray:
        return np.bitwise_count((fps ^ self.vantage[node]) & self.mask).astype(np.int16)

    def route(self, fps: np.ndarray, reach: int) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
        """``positions in fps, shard, is member``: each fingerprint's own shard, and the shards it visits.

        It visits a shard if the triangle inequality cannot rule out a member within ``reach``. A pair that a
        radius parts is met once: the one inside visits the outside.
        """
        who = np.arange(len(fps))
        member = np.ones(len(fps), bool)
        at = np.zeros(len(fps), np.int64)
        for _ in range(self.levels):
            d, r = self.distance(fps[who], at), self.radius[at]
            inside = np.where(member, d <= r, d - reach <= r)
            outside = np.where(member, (d > r) | (d + reach > r), d + reach > r)
            stays = member & (d > r)
            who, at, member = (
                np.r_[who[inside], who[outside]],
                np.r_[2 * at[inside] + 1, 2 * at[outside] + 2],
                np.r_[member[inside], stays[outside]],
            )
        shard = at - ((1 << self.levels) - 1)
        for flag in (True, False):
            chosen = member == flag
            yield who[chosen], shard[chosen], flag


class Links:
    """Pairs of some fingerprints that are near enough, in ``fp`` and, where asked for, also in ``other``."""

    def __init__(self, fp: np.ndarray, other: np.ndarray, distance: int, other_distance: int | None):
        self.fp, self.other, self.distance, self.other_distance = fp, other, distance, other_distance

    def near(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``a`` and ``b`` (positions of fingerprints) that are linked."""
        i, j = np.nonzero(np.bitwise_count(self.fp[a][:, None] ^ self.fp[b][None, :]) <= self.distance)
        if self.other_distance is not None:
            keep = np.bitwise_count(self.other[a[i]] ^ self.other[b[j]]) <= self.other_distance
            i, j = i[keep], j[keep]
        return i, j

    def forest(self, members: int) -> tuple[np.ndarray, np.ndarray]:
        """Links that connect whatever is linked to one of the first ``members``: a spanning forest.

        Pairs are listed while they are few, and thinned to a forest. Where they are many, the links are found by
        search from one fingerprint to those not reached yet, so that a dense group costs little more than its size.
        """
        everyone = np.arange(len(self.fp))
        a, b = [everyone[:0]], [everyone[:0]]
        found = 0
        for start in range(0, members, 256):
            rows = everyone[start : min(start + 256, members)]
            i, j = self.near(rows, everyone[start:])
            keep = j > i  # members before this row have met it already
            a.append(rows[i[keep]])
            b.append(start + j[keep])
            found += int(keep.sum())
            if found > 8 * len(everyone) + 1000:
                return self._search()
        return _thinned(np.concatenate(a), np.concatenate(b))

    def _search(self) -> tuple[np.ndarray, np.ndarray]:
        rest = np.arange(len(self.fp))
        a, b = [rest[:0]], [rest[:0]]
        while len(rest):
            frontier, rest = rest[:1], rest[1:]
            while len(frontier) and len(rest):
                step, frontier = frontier[:64], frontier[64:]
                i, j = self.near(step, rest)
                hit, first = np.unique(j, return_index=True)
                if len(hit):
                    a.append(step[i[first]])
                    b.append(rest[hit])
                    frontier = np.concatenate([frontier, rest[hit]])
                    rest = np.delete(rest, hit)
        return np.concatenate(a), np.concatenate(b)


def _thinned(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The links without those whose ends are connected by earlier ones."""
    parent: dict[int, int] = {}
    keep = []
    for k, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        while (up := parent.setdefault(y, y)) != y:
            parent[y] = y = parent[up]
        if x != y:
            parent[max(x, y)] = min(x, y)
            keep.append(k)
    return a[keep], b[keep]


def close_pairs(
    nodes: DataFrame,
    distance: int = MAX_DISTANCE,
    parts: int = PARTS,
    other_distance: int | None = None,
    shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """``src, dst``: links between rows of ``nodes`` (``node, fp, other``) at most ``distance`` bits apart in ``fp``
    and, if given, ``other_distance`` in ``other``. ``nodes`` is read several times and should be stored.

    All links that connect, not all pairs: within a shard a spanning forest stands for its pairs.
    Each part of the fingerprint has a vantage-point tree whose radii come from a bounded sample. A fingerprint is
    a member of one shard per part and visits those that it may reach over a border. Shards are cut into bounded
    chunks: members meet the chunks before their own as visitors, so a shard that holds a large group is spread
    over many tasks.
    """
    n = nodes.count()
    levels = min(MOST_LEVELS, max(0, int(np.ceil(np.log2(max(1, n / shard_rows))))))
    wanted = SAMPLE_ROWS << levels
    pick = F.pmod(F.xxhash64("fp"), F.lit(1 << 20)) < max(1, (wanted << 20) // max(1, n))
    sampled = nodes.select("fp").where(pick).limit(2 * wanted).collect() if levels else []
    sample = np.sort(np.asarray([r[0] for r in sampled], np.int64).view(np.uint64))
    reach = distance // parts
    trees = [VantageTree(mask, levels, sample, seed) for seed, mask in enumerate(part_masks(parts))]
    # they go along with the task: about 10 bytes for each of at most parts * 2**MOST_LEVELS nodes

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column("fp").to_numpy().view(np.uint64)
            for part, tree in enumerate(trees):
                for who, shard, member in tree.route(own, reach):
                    row = pa.array(who)
                    yield pa.record_batch(
                        [
                            pa.array((part << levels) + shard, pa.int64()),
                            *(batch.column(c).take(row) for c in ("node", "fp", "other")),
                            pa.array(np.full(len(who), member)),
                        ],
                        names=["shard", "node", "fp", "other", "member"],
                    )

    routed = nodes.select("node", "fp", "other").mapInArrow(
        route, "shard long, node long, fp long, other long, member boolean"
    )
    sizes = routed.groupBy("shard").agg(
        F.count_if("member").alias("members"), F.count_if(~F.col("member")).alias("visitors")
    )
    # one row per shard: at most parts * 2**MOST_LEVELS
    cut = sizes.select(
        "shard",
        F.ceil(F.col("members") / CHUNK_ROWS).cast("int").alias("chunks"),
        F.greatest(F.lit(1), F.ceil((F.col("visitors") + F.col("members")) / VISITOR_ROWS)).cast("int").alias("blocks"),
    )
    dealt = (
        routed.join(F.broadcast(cut), "shard")
        .where("chunks > 0")
        .withColumn("own", F.pmod(F.xxhash64("node", F.lit(1)), "chunks").cast("int"))
        .withColumn("block", F.pmod(F.xxhash64("node", F.lit(2)), "blocks").cast("int"))
    )
    # a member is one in its own chunk, for every block of visitors, and visits the chunks before; a visitor
    # visits all chunks
    last = F.when(F.col("member"), F.col("own") - 1).otherwise(F.col("chunks") - 1)
    as_member = F.transform(
        F.when(F.col("member"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array()),
        lambda block: F.struct(F.col("own").alias("chunk"), block.alias("block"), F.lit(True).alias("member")),
    )
    as_visitor = F.transform(
        F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array()),
        lambda chunk: F.struct(chunk.alias("chunk"), F.col("block").alias("block"), F.lit(False).alias("member")),
    )
    places = dealt.select("shard", "node", "fp", "other", F.explode(F.concat(as_member, as_visitor)).alias("place"))

    def link(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["member", "node"], ascending=[False, True])
        fp, other = (rows[c].to_numpy().view(np.uint64) for c in ("fp", "other"))
        a, b = Links(fp, other, distance, other_distance).forest(int(rows["member"].sum()))
        node = rows["node"].to_numpy()
        return pd.DataFrame({"src": node[a], "dst": node[b]})

    return (
        places.select("shard", "place.chunk", "place.block", "node", "fp", "other", "place.member")
        .groupBy("shard", "chunk", "block")
        .applyInPandas(link, "src long, dst long")
    )


def near_duplicates(
    docs: DataFrame,
    words: int = SHINGLE_WORDS,
    distance: int = MAX_DISTANCE,
    parts: int = PARTS,
    unique: bool = False,
    confirm: tuple[int, int] | None = None,
) -> DataFrame:
    """``doc_id``, ``row``, ``fp``, ``component_id`` (smallest id reachable over links) and ``component`` (a number
    of the component that is never null) of every row.

    ``confirm`` (words, distance) asks that the fingerprints of other shingles are near as well. Only different
    fingerprints are compared, so groups of copies cost their distinct values. Null and wordless texts have
    fingerprint 0 and link like any other; null ids take part but are never a component's id unless it has no
    other; repeated rows stay repeated. Other columns are left out.
    """
    confirm_words, other_distance = confirm or (None, None)
    rows = materialize(fingerprints(docs, words, unique, confirm_words), "simhash")
    # numbers are fixed once they are stored
    nodes = materialize(
        rows.groupBy("fp", "other").agg(F.min("doc_id").alias("least")).withColumn("node", F.monotonically_increasing_id()),
        "fingerprints",
    )
    linked = connected_components(close_pairs(nodes, distance, parts, other_distance)).withColumnRenamed("id", "node")
    grouped = nodes.join(linked, "node", "left").select("fp", "other", "least", F.coalesce("component", "node").alias("component"))
    smallest = grouped.groupBy("component").agg(F.min("least").alias("component_id"))
    labels = grouped.join(smallest, "component").select("fp", "other", "component_id", "component")
    return rows.join(labels, ["fp", "other"], "left").select("doc_id", "row", "fp", "component_id", "component")


def one_of_each(docs: DataFrame, **settings) -> DataFrame:
    """One row of ``docs`` per component: the one with the smallest id (null only if there is no other), and of
    those the smallest hash of its text. Settings as in ``near_duplicates``. Rows that are equal in id and text
    are one; rows with one id, or without ids, in different components all stay."""
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row")
    keep = near_duplicates(docs, **settings).groupBy("component").agg(F.min(order).alias("k")).select("k.doc_id", "k.row")
    left = docs.select(
        F.struct(*docs.columns).alias("d"),
        F.col("doc_id").cast("long").alias("id"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("hash"),
    )
    joined = left.join(keep, left["id"].eqNullSafe(keep["doc_id"]) & (left["hash"] == keep["row"]), "left_semi")
    one = joined.groupBy("id", "hash").agg(F.min_by("d", F.to_json("d")).alias("d"))
    return one.select(*[F.col(f"d.{c}").alias(c) for c in docs.columns])
