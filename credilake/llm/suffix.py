"""Suffix-array dedup: maximal repeats from the interval tree of a sparse, enhanced suffix array.

Only suffixes at chosen positions (anchors) enter the array. A window of ``length`` bytes has its anchor where the
hash of ``seed`` bytes is smallest within the window, so equal windows have their anchors at the same place, and
every repeat of ``length`` bytes is met at an anchor common to all its occurrences: it begins at most ``reach`` =
length - seed bytes before it and ends behind the seed. What an anchor can tell is therefore within ``reach``
bytes to its left and ``length`` bytes to its right, its context.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from credilake.llm.base import keyed, sliced, texts
from credilake.session import materialize

LENGTH = 400
SEED_BYTES = 128

#: Groups of more different contexts than this are not sorted in one task, see ``_large_groups``.
GROUP_CONTEXTS = 1024
BAND = 16

#: Bytes of text that are hashed at a time; small enough for a processor's cache.
BLOCK_BYTES = 1 << 18

_KEY = [("doc", pa.int64()), ("row", pa.int64())]
_CLASS = [("h", pa.int64()), ("c1", pa.int64()), ("c2", pa.int64())]


def _slide(x: np.ndarray, width: int, op) -> np.ndarray:
    """``op`` (minimum or maximum) over every run of ``width`` values."""
    have = 1
    while 2 * have <= width:
        x = op(x[:-have], x[have:])
        have *= 2
    return op(x[: len(x) - (width - have)], x[width - have :]) if width > have else x


def seed_hashes(b: np.ndarray, seed: int) -> np.ndarray:
    """Hash of the ``seed`` bytes at each position, doubling the width step by step; seed is a power of two."""
    h = b.astype(np.uint64) + np.uint64(1)
    width, factor = 1, 0x9E3779B97F4A7C15
    while width < seed:
        h = h[:-width] * np.uint64(factor) + h[width:]
        factor = (factor * factor + 2) & (1 << 64) - 1 | 1
        width *= 2
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h | np.uint64(1)


def anchors(block: list[bytes], length: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``number of the text, position, hash`` of all anchors in some texts. Ties within a window are all chosen."""
    sizes = np.asarray([len(t) for t in block], np.int64)
    ends = np.cumsum(sizes)
    b = np.frombuffer(b"".join(block), np.uint8)
    none = np.empty(0, np.int64)
    if len(b) < length:
        return none, none, none.astype(np.uint64)
    h = seed_hashes(b, seed)
    windows = _slide(h, length - seed + 1, np.minimum)  # smallest hash of the window at each position
    # windows do not cross texts
    inside = np.zeros(len(b) + 1, np.int32)
    long = sizes >= length
    np.add.at(inside, (ends - sizes)[long], 1)
    np.add.at(inside, (ends - length + 1)[long], -1)
    windows[np.cumsum(inside)[: len(windows)] == 0] = 0
    pad = np.zeros(length - seed, np.uint64)
    best = _slide(np.concatenate([pad, windows, pad]), length - seed + 1, np.maximum)
    at = np.flatnonzero(best[: len(h)] == h)
    which = np.searchsorted(ends, at, side="right")
    return which, at - (ends - sizes)[which], h[at]


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[int, list[bytes]]]:
    start, block, size = 0, [], 0
    for text in texts(batch):
        block.append(text)
        size += len(text)
        if size >= BLOCK_BYTES:
            yield start, block
            start, block, size = start + len(block), [], 0
    if block:
        yield start, block


def anchored(rows: DataFrame, length: int, seed: int) -> DataFrame:
    """``h``, 128-bit hash ``c1, c2`` of the context, ``doc``, ``row``, ``pos`` of the anchors of every row.

    Anchors of one row with equal contexts are one: ``n`` of them, with the spans of all their contexts put
    together in ``own`` (null for a single one). Periodic texts, in which every period has an anchor, need few.
    """
    reach = length - seed
    span = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
    schema = pa.schema([*_CLASS, *_KEY, ("pos", pa.int64()), ("n", pa.int64()), ("own", span)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            for start, block in _blocks(batch):
                out: dict[tuple[int, bytes], list] = {}
                for w, p, h in zip(*(x.tolist() for x in anchors(block, length, seed))):
                    context = xxh3_128_digest(block[w][max(0, p - reach) : p + length], seed=min(p, reach))
                    out.setdefault((w, context), [h, p]).append(p)
                which = pa.array([start + w for w, _ in out], pa.int64())
                c = np.frombuffer(b"".join([c for _, c in out]), np.int64).reshape(-1, 2)
                own = []
                for (w, _), (_, _, *at) in out.items():
                    spans = merged([(max(0, p - reach), p + length) for p in at], len(block[w])) if len(at) > 1 else None
                    own.append(spans and [{"a": x, "b": y} for x, y in spans])
                yield pa.record_batch(
                    [
                        pa.array(np.asarray([v[0] for v in out.values()], np.uint64).view(np.int64)),
                        pa.array(c[:, 0]), pa.array(c[:, 1]),
                        batch.column("doc").take(which), batch.column("row").take(which),
                        pa.array([v[1] for v in out.values()], pa.int64()),
                        pa.array([len(v) - 2 for v in out.values()], pa.int64()), pa.array(own, span),
                    ],
                    schema=schema,
                )

    fields = "h long, c1 long, c2 long, doc long, row long, pos long, n long, own array<struct<a:long,b:long>>"
    return rows.mapInArrow(run, fields)


def seed_counts(rows: DataFrame, length: int, seed: int) -> DataFrame:
    """``h`` and ``n``, how many anchors of a row have it, without their contexts."""
    schema = pa.schema([("h", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            for _, block in _blocks(batch):
                h, n = np.unique(anchors(block, length, seed)[2], return_counts=True)
                yield pa.record_batch([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], schema=schema)

    return rows.mapInArrow(run, "h long, n long")


def common_prefix(a: bytes, b: bytes) -> int:
    """Length of the common prefix, by halving."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n  # equal up to low, different at high
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (middle, high) if a[low:middle] == b[low:middle] else (low, middle)
    return low


def interval_tree(lcp: list[int]) -> Iterator[tuple[int, int, int]]:
    """``depth, first, last`` of all inner intervals of a suffix array, children before parents.

    ``lcp[i]`` is the common prefix of suffixes i and i + 1. One scan with a stack of open intervals.
    """
    stack: list[tuple[int, int]] = []  # depth, first suffix
    for i, depth in enumerate([*lcp, -1]):
        first = i
        while stack and stack[-1][0] > depth:
            d, first = stack.pop()
            yield d, first, i
        if depth >= 0 and (not stack or stack[-1][0] < depth):
            stack.append((depth, first))


def maximal_repeats(lefts: list[bytes], rights: list[bytes], length: int) -> Iterator[tuple[int, int, list[int]]]:
    """``bytes to the left, bytes to the right, members`` of the repeats of at least ``length`` bytes that hold the
    anchor, for anchors with the given contexts; ``lefts`` run away from the anchor, i.e. are reversed.

    Suffixes are sorted by what follows the anchor; each interval of their tree is split by what precedes it. A
    part is a repeat of its common left and right extension; it is reported where it is diverse on the left, that
    is, where a part with a longer left extension has fewer members, and on the right, as a whole of an interval.
    """
    n = len(rights)
    order = sorted(range(n), key=rights.__getitem__)
    lcp = [common_prefix(rights[a], rights[b]) for a, b in zip(order, order[1:])]
    by_left = sorted(range(n), key=lefts.__getitem__)
    rank = [0] * n
    for r, i in enumerate(by_left):
        rank[i] = r
    for depth, first, last in interval_tree(lcp):
        members = sorted(order[first : last + 1], key=rank.__getitem__)
        shared = [common_prefix(lefts[a], lefts[b]) for a, b in zip(members, members[1:])]
        for left, low, high in interval_tree(shared):
            if left + depth >= length:
                yield left, depth, members[low : high + 1]


def _extents(group: list[tuple[bytes, bytes]], length: int) -> list[tuple[int, int]]:
    """For each member, how far bytes repeated together with its anchor reach to the left and to the right."""
    if len(group) == 2:
        (la, ra), (lb, rb) = group
        left, right = common_prefix(la, lb), common_prefix(ra, rb)
        return [(left, right)] * 2 if left + right >= length else [(0, 0)] * 2
    out = [(0, 0)] * len(group)
    for left, right, members in maximal_repeats([g[0] for g in group], [g[1] for g in group], length):
        for i in members:
            out[i] = max(out[i][0], left), max(out[i][1], right)
    return out


_SOLVED = "h long, c1 long, c2 long, back long, ahead long, context binary, left int"


def _groups(contexts: DataFrame, length: int) -> DataFrame:
    """Extents of the classes of groups that fit into a task: a suffix array and its tree per group. The contexts
    of larger groups pass unchanged, spread by their own hashes."""
    schema = pa.schema([*_CLASS, ("back", pa.int64()), ("ahead", pa.int64()), ("context", pa.binary()), ("left", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solved(rows: list[tuple]) -> Iterator[tuple]:
            if len(rows) > 1:
                found = _extents([(r[3][: r[4]][::-1], r[3][r[4] :]) for r in rows], length)
                yield from ((*r[:3], *x, None, None) for r, x in zip(rows, found) if x[1])

        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        group: list[tuple] = []
        for batch in sliced(batches, 1024):
            ready: list[tuple] = []
            columns = [batch.column(n).to_pylist() for n in ("h", "c1", "c2", "context", "left", "large")]
            for *row, large in zip(*columns):
                if large:
                    ready.append((*row[:3], None, None, *row[3:]))
                    continue
                if group and row[0] != group[0][0]:
                    ready += solved(group)
                    group = []
                group.append(row)
            if ready:
                yield out(ready)
        ready = list(solved(group))
        if ready:
            yield out(ready)

    large = F.col("k") > GROUP_CONTEXTS
    dealt = contexts.withColumns({"large": large, "spread": F.when(large, F.col("c1"))})
    dealt = dealt.repartition("h", "spread").sortWithinPartitions("h")
    return dealt.mapInArrow(run, _SOLVED)


def _bands(contexts: DataFrame, length: int, seed: int) -> DataFrame:
    """For each band of windows that begin ``back`` to ``back`` + BAND - 1 bytes before the anchor: hash ``k1, k2``
    of the bytes that all of them share, and ``o1, o2`` of all bytes that they cover (null where the context or
    the reach ends within the band)."""
    schema = pa.schema([*_CLASS, *((n, pa.int64()) for n in ("k1", "k2", "o1", "o2")), ("back", pa.int32())])
    reach = length - seed

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            inner, outer, whole, which, backs = [], [], [], [], []
            for i, (context, left) in enumerate(zip(batch.column("context").to_pylist(), batch.column("left").to_pylist())):
                for back in range(0, min(left, reach) + 1, BAND):
                    start, stop = left - back, left - back + length
                    if stop - BAND + 1 > len(context):
                        continue
                    inner.append(xxh3_128_digest(context[start : stop - BAND + 1], seed=back))
                    whole.append(back + BAND - 1 <= min(left, reach) and stop <= len(context))
                    outer.append(xxh3_128_digest(context[start - BAND + 1 : stop], seed=back) if whole[-1] else bytes(16))
                    which.append(i)
                    backs.append(back)
            k, o = (np.frombuffer(b"".join(x), np.int64).reshape(-1, 2) for x in (inner, outer))
            row, none = pa.array(which, pa.int64()), ~np.asarray(whole, bool)
            yield pa.record_batch(
                [
                    *(batch.column(n).take(row) for n in ("h", "c1", "c2")), pa.array(k[:, 0]), pa.array(k[:, 1]),
                    pa.array(o[:, 0], mask=none), pa.array(o[:, 1], mask=none), pa.array(backs, pa.int32()),
                ],
                schema=schema,
            )

    return contexts.mapInArrow(run, "h long, c1 long, c2 long, k1 long, k2 long, o1 long, o2 long, back int")


def _windows(contexts: DataFrame, length: int, seed: int) -> DataFrame:
    """Hash ``k1, k2`` of each window that begins within the ``band`` of a context."""
    schema = pa.schema([*_CLASS, ("k1", pa.int64()), ("k2", pa.int64()), ("back", pa.int32())])
    reach = length - seed

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            digests, which, backs = [], [], []
            for i, (context, left, band) in enumerate(zip(*(batch.column(n).to_pylist() for n in ("context", "left", "band")))):
                for back in range(band, min(left, reach, band + BAND - 1) + 1):
                    if left - back + length <= len(context):
                        digests.append(xxh3_128_digest(context[left - back : left - back + length], seed=back))
                        which.append(i)
                        backs.append(back)
            k = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            row = pa.array(which, pa.int64())
            yield pa.record_batch(
                [*(batch.column(n).take(row) for n in ("h", "c1", "c2")), pa.array(k[:, 0]), pa.array(k[:, 1]), pa.array(backs, pa.int32())],
                schema=schema,
            )

    return contexts.mapInArrow(run, "h long, c1 long, c2 long, k1 long, k2 long, back int")


def _large_groups(contexts: DataFrame, length: int, seed: int) -> DataFrame:
    """Extents of the classes of groups too large for a task, window by window.

    Two contexts that share a window share, of the band in which it begins, all but the band's width: bands of
    which nobody shares that go. If they share the whole band, all its windows are shared. Only of the bands in
    between single windows are counted: those at the ends of a passage. Equal windows are the intervals of depth
    ``length``. Nothing is gathered: all of it is grouped counts and joins on 128-bit hashes.
    """

    def extent(back, ahead) -> list:
        return ["h", "c1", "c2", back.cast("long").alias("back"), ahead.cast("long").alias("ahead")]

    def twice(pieces: DataFrame, *key: str) -> DataFrame:
        return pieces.groupBy(*key).agg(F.count(F.lit(1)).alias("times")).where("times > 1").select(*key)

    pieces = _bands(contexts, length, seed)
    bands = materialize(
        pieces.join(twice(pieces, "k1", "k2"), ["k1", "k2"], "left_semi").select("h", "c1", "c2", "o1", "o2", "back"), "bands"
    )
    whole = (
        bands.where("o1 IS NOT NULL")
        .groupBy("o1", "o2")
        .agg(F.count(F.lit(1)).alias("times"), F.min(F.struct("h", "c1", "c2", F.col("back").alias("band"))).alias("one"))
        .where("times > 1")
    )
    told = bands.join(whole.select("o1", "o2", F.lit(True).alias("whole")), ["o1", "o2"], "left")
    full = told.where("whole").select(*extent(F.col("back") + BAND - 1, length - F.col("back")))
    # one of those that share a whole band stands for them, since others may share some of its windows
    unclear = told.where("whole IS NULL").select("h", "c1", "c2", F.col("back").alias("band")).unionByName(whole.select("one.*"))
    windows = _windows(contexts.join(unclear, ["h", "c1", "c2"]), length, seed)
    single = windows.join(twice(windows, "k1", "k2"), ["k1", "k2"], "left_semi")
    return full.unionByName(single.select(*extent(F.col("back"), length - F.col("back"))))


def repeated_spans(docs: DataFrame, length: int = LENGTH, seed: int = SEED_BYTES) -> DataFrame:
    """``doc, row, spans``: byte spans (start, end) of every row whose ``length`` bytes stand elsewhere too,
    overlapping and unsorted.

    ``seed`` is a power of two below ``length``. Steps: anchors whose seed stands nowhere else are dropped; equal
    contexts become a class, and a class with two occurrences is repeated as a whole; the contexts of different
    classes with one seed make a suffix array, see ``maximal_repeats``, of which each class enters once. So a
    group of copies costs one member, however large it is.
    """
    reach = length - seed
    rows = source_rows(docs)
    twice = seed_counts(rows, length, seed).groupBy("h").agg(F.sum("n").alias("times")).where("times > 1").select("h")
    shared = materialize(anchored(rows, length, seed).join(twice, "h", "left_semi"), "anchors")
    classes = materialize(
        shared.groupBy("h", "c1", "c2").agg(F.sum("n").alias("n"), F.min(F.struct("doc", "row", "pos")).alias("first")),
        "contexts",
    )
    several = classes.groupBy("h").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    schema = pa.schema([*_CLASS, ("k", pa.int64()), ("context", pa.binary()), ("left", pa.int32())])

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in sliced(batches, 64):
            out = []
            names = ("doc", "row", "wanted")
            for text, doc, row, wanted in zip(unpacked(batch), *(batch.column(n).to_pylist() for n in names)):
                if (doc, row) == last:  # a repeated row has the same contexts
                    continue
                last = doc, row
                for w in wanted:
                    p = w["pos"]
                    out.append((w["h"], w["c1"], w["c2"], w["k"], text[max(0, p - reach) : p + length], min(p, reach)))
            if out:
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    wanted = (
        classes.join(several, "h")
        .select("first.*", "h", "c1", "c2", "k")
        .groupBy("doc", "row")
        .agg(F.collect_list(F.struct("pos", "h", "c1", "c2", "k")).alias("wanted"))
    )
    contexts = (
        packed(rows)
        .join(wanted, ["doc", "row"])
        .sortWithinPartitions("doc", "row")
        .mapInArrow(fetch, "h long, c1 long, c2 long, k long, context binary, left int")
    )
    solved = materialize(_groups(contexts, length), "extents")
    names = ("h", "c1", "c2", "back", "ahead")
    everywhere = classes.where("n > 1").select(
        "h", "c1", "c2", F.lit(reach).cast("long").alias("back"), F.lit(length).cast("long").alias("ahead")
    )
    extents = (
        solved.where("context IS NULL")
        .select(*names)
        .unionByName(_large_groups(solved.where("context IS NOT NULL").drop("back", "ahead"), length, seed))
        .unionByName(everywhere)
        .groupBy("h", "c1", "c2")
        .agg(F.max("back").alias("back"), F.max("ahead").alias("ahead"))
    )
    one = F.struct(F.greatest(F.lit(0), F.col("pos") - F.col("back")).alias("a"), (F.col("pos") + F.col("ahead")).alias("b"))
    return (
        shared.join(extents, ["h", "c1", "c2"])
        .select("doc", "row", F.coalesce("own", F.array(one)).alias("spans"))
        .groupBy("doc", "row")
        .agg(F.flatten(F.collect_set("spans")).alias("spans"))
    )


def packed(rows: DataFrame) -> DataFrame:
    """``rows`` with their texts compressed, to be shuffled."""
    schema = pa.schema([*_KEY, ("packed", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = zstandard.ZstdCompressor(level=3)
        for batch in sliced(batches):
            found = [codec.compress(t) for t in texts(batch)]
            yield pa.record_batch([batch.column("doc"), batch.column("row"), pa.array(found, pa.binary())], schema=schema)

    return rows.mapInArrow(run, "doc long, row long, packed binary")


def unpacked(batch: pa.RecordBatch) -> Iterator[bytes]:
    codec = zstandard.ZstdDecompressor()
    return map(codec.decompress, batch.column("packed").to_pylist())


def source_rows(docs: DataFrame) -> DataFrame:
    """``doc`` (id, null as the smallest) and ``row`` (hash of the text) tell rows apart; with ``text``."""
    return keyed(docs).select(
        F.coalesce("doc_id", F.lit(-(1 << 63))).alias("doc"), F.xxhash64("text").alias("row"), "text"
    )


def merged(spans: list[tuple[int, int]], size: int) -> list[tuple[int, int]]:
    """Spans put together where they overlap or touch, cut at the end of the text."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        b = min(b, size)
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], b)
        else:
            out.append((a, b))
    return out


def remove_repeats(docs: DataFrame, length: int = LENGTH, seed: int = SEED_BYTES) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``removed`` (array of start, end) and the ``kept`` bytes of every row.

    Bytes covered by a string of ``length`` bytes that starts anywhere else too go, all copies of it. Null and
    empty texts stay empty, texts shorter than ``length`` stay whole. Rows that are equal in id and text are
    copies of each other like any other rows. Further columns are left out.
    """
    rows = source_rows(docs)
    spans = repeated_spans(docs, length, seed)
    schema = pa.schema(
        [("doc_id", pa.int64()), ("n_bytes", pa.int64())]
        + [("removed", pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))), ("kept", pa.binary())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 256):
            all_texts = list(unpacked(batch))
            cut, kept = [], []
            for text, found in zip(all_texts, batch.column("spans").to_pylist()):
                gone = merged([(s["a"], s["b"]) for s in found or ()], len(text))
                borders = [0, *(x for s in gone for x in s), len(text)]
                kept.append(b"".join([text[a:b] for a, b in zip(borders[::2], borders[1::2])]))
                cut.append([{"a": a, "b": b} for a, b in gone])
            yield pa.record_batch(
                [batch.column("doc_id"), pa.array([len(t) for t in all_texts], pa.int64()), pa.array(cut, schema.field("removed").type), pa.array(kept, pa.binary())],
                schema=schema,
            )

    joined = (
        packed(rows)
        .join(spans, ["doc", "row"], "left")
        .select(F.nullif("doc", F.lit(-(1 << 63))).alias("doc_id"), "packed", "spans")
    )
    return joined.mapInArrow(run, "doc_id long, n_bytes long, removed array<struct<a:long,b:long>>, kept binary")
