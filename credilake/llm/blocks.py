"""Substring dedup by fixed-block anchors: runs of ``window`` words that stand anywhere else too are removed.

Of every text the non-overlapping blocks of ``(window + 1) // 2`` words are the reference; whatever its alignment, a
window holds one of them whole. Every rolling window of a block's width probes the reference. A block that nothing
but itself hits cannot lie in a repeat. The others are extended to the left and right as far as a window around
them reaches; runs of windows with an equal are the maximal exact repeats.

Texts are kept in chunks of a few MB. Hashes travel as packed arrays, one per chunk and bucket of the hash space,
each hash once per chunk: a passage in a third of all documents costs one entry a chunk, and a bucket's size depends
on the number of chunks, not of copies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_intdigest

from credilake.llm.base import keyed, sliced, texts
from credilake.session import materialize

WINDOW = 35

#: Text of a chunk, and of the share of all text whose windows meet in one bucket.
CHUNK_BYTES = 4 << 20
BUCKET_BYTES = 8 << 20

#: Distinct words whose hashes a worker remembers, by their length in bytes.
REMEMBERED_BYTES = 32 << 20

_MASK = (1 << 64) - 1
_NOT_ASKED = np.uint32(0xFFFFFFFF)


class _Words(dict):
    """Number of each word, and 128 bits of hash by number."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        super().clear()
        self.high, self.low, self.bytes = [], [], 0

    def __missing__(self, word: bytes) -> int:
        digest = xxh3_128_intdigest(word)
        self.high.append(digest >> 64)
        self.low.append(digest & _MASK)
        self.bytes += len(word) + 150
        self[word] = number = len(self.high) - 1
        return number

    def hashes(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        if self.bytes > REMEMBERED_BYTES:
            self.clear()
        at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        return np.asarray(self.high, np.uint64)[at], np.asarray(self.low, np.uint64)[at]


def _join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = a * np.uint64(0x9E3779B97F4A7C15) + b
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of the ``width`` words from each position, put together from runs of 1, 2, 4 ... words."""
    n = len(words) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    run, size, whole, have = words, 1, None, 0
    while True:
        if width & size:
            whole, have = (run, size) if whole is None else (_join(whole[: len(run) - have], run[have:]), have + size)
        if have == width:
            return whole[:n]
        run, size = _join(run[:-size], run[size:]), 2 * size


class Chunk:
    """Words of the texts of a chunk; ``start`` and ``end`` of the text of each word."""

    def __init__(self, packed: bytes, sizes: list[int], remembered: _Words):
        text = zstandard.ZstdDecompressor().decompress(packed) if packed else b""
        ends = np.cumsum([0, *sizes])
        self.words = [text[a:b].split() for a, b in zip(ends[:-1], ends[1:])]
        counts = np.asarray([len(w) for w in self.words], np.int64)
        self.ends = np.cumsum(counts)
        self.starts = self.ends - counts
        self.start, self.end = np.repeat(self.starts, counts), np.repeat(self.ends, counts)
        self.high, self.low = remembered.hashes([w for text in self.words for w in text])

    def windows(self, width: int) -> np.ndarray:
        """Positions at which ``width`` words of one text begin."""
        at = np.arange(max(0, len(self.start) - width + 1))
        return at[at + width <= self.end[: len(at)]]

    def probes(self, block: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """Places with a window of ``block`` words, and for each bucket, hash (30 bits) and bit 0 for a reference block."""
        at = self.windows(block)
        h = window_hashes(self.high, block)[at]
        key = (h >> np.uint64(32)) % np.uint64(buckets) << np.uint64(32) | h & np.uint64(0xFFFFFFFC)
        return at, key | ((at - self.start[at]) % block == 0).astype(np.uint64)


def _bytes(x: np.ndarray, kind: str) -> bytes:
    return x.astype(kind).tobytes()


def _arrays(column: pa.ChunkedArray | pa.Array, kind: str) -> list[np.ndarray]:
    return [np.frombuffer(x or b"", kind) for x in column.to_pylist()]


def _packed(sorted_keys: np.ndarray) -> bytes:
    """Differences of sorted numbers of 32 bits, byte by byte, compressed: the upper bytes hold little."""
    planes = np.diff(sorted_keys.astype("<u4"), prepend=np.uint32(0)).view(np.uint8).reshape(-1, 4).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpacked(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u4").ravel(), dtype=np.uint32)


def _dealt(bucket: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Runs of equal values in a sorted array."""
    if len(bucket):
        cuts = [0, *(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1).tolist(), len(bucket)]
        yield from ((int(bucket[a]), slice(a, b)) for a, b in zip(cuts, cuts[1:]))


def chunks(docs: DataFrame) -> DataFrame:
    """``chunk``, ``docs`` (ids), ``sizes`` (bytes), ``bytes`` and the ``packed`` texts; one row per few MB of text.

    Written once, so that a chunk is the same whoever reads it.
    """
    schema = pa.schema(
        [("chunk", pa.int64()), ("docs", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64()))]
        + [("bytes", pa.int64()), ("packed", pa.binary())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, number = zstandard.ZstdCompressor(level=3), TaskContext.get().partitionId() << 33

        def row(number: int, ids: list, parts: list[bytes]) -> pa.RecordBatch:
            sizes = [len(t) for t in parts]
            columns = [number], [ids], [sizes], [sum(sizes)], [codec.compress(b"".join(parts))]
            return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

        ids, parts, size = [], [], 0
        for batch in sliced(batches):
            for doc, text in zip(batch.column("doc_id").to_pylist(), texts(batch)):
                ids.append(doc)
                parts.append(text)
                size += len(text)
                if size >= CHUNK_BYTES:
                    yield row(number, ids, parts)
                    ids, parts, size, number = [], [], 0, number + 1
        if ids:
            yield row(number, ids, parts)

    fields = "chunk long, docs array<long>, sizes array<long>, bytes long, packed binary"
    return materialize(keyed(docs).mapInArrow(run, fields), "chunks")


def block_hits(chunked: DataFrame, block: int, buckets: int) -> DataFrame:
    """``chunk`` and ``hits``: the keys of its reference blocks that are hit by a window at any other place."""
    schema = pa.schema([("bucket", pa.int64()), ("chunk", pa.int64()), ("keys", pa.binary())])
    found = pa.schema([("chunk", pa.int64()), ("hits", pa.binary())])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remembered = _Words()
        for batch in sliced(batches, 1):
            chunk, sizes, packed = (batch.column(n)[0].as_py() for n in ("chunk", "sizes", "packed"))
            key = np.sort(Chunk(packed, sizes, remembered).probes(block, buckets)[1])
            if not len(key):
                continue
            last = np.append(np.flatnonzero(key[1:] >> np.uint64(2) != key[:-1] >> np.uint64(2)), len(key) - 1)
            several = np.diff(last, prepend=-1) > 1  # of equal hashes the last one says whether a block is among them
            key = key[last] | several.astype(np.uint64) << np.uint64(1)
            rows = [(b, chunk, _packed(key[s])) for b, s in _dealt(key >> np.uint64(32))]
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    def index(group: pa.Table) -> pa.Table:
        own, bucket = [_unpacked(x) for x in group.column("keys").to_pylist()], group.column("bucket")[0].as_py()
        key = np.concatenate(own)
        order = np.argsort(key, kind="stable")
        runs = np.append(0, np.cumsum(key[order][1:] >> 2 != key[order][:-1] >> 2))
        times = np.bincount(runs, weights=1 + (key[order] >> 1 & 1))
        hit = np.zeros(len(key), bool)
        hit[order] = (times > 1)[runs]
        hit &= key & 1 == 1
        out, at = [], 0
        for keys in own:
            mine = keys[hit[at : at + len(keys)]] & np.uint32(0xFFFFFFFC)
            at += len(keys)
            out.append(_bytes(mine.astype(np.uint64) | np.uint64(bucket << 32), "<u8"))
        return pa.table([group.column("chunk"), pa.array(out, pa.binary())], schema=found)

    probes = chunked.select("chunk", "sizes", "packed").mapInArrow(probe, "bucket long, chunk long, keys binary")
    return probes.groupBy("bucket").applyInArrow(index, "chunk long, hits binary").where("length(hits) > 0")


def repeated_windows(asked: DataFrame, window: int, buckets: int) -> DataFrame:
    """``chunk`` and ``at``: word numbers within the chunk where ``window`` words begin that stand elsewhere too.

    ``asked`` holds chunks with their ``hits``. The windows around a hit block are compared by 96 bits.
    """
    block = (window + 1) // 2
    names = ("bucket", "chunk", "a", "b", "at")
    schema = pa.schema([*((n, pa.int64()) for n in names[:2]), *((n, pa.binary()) for n in names[2:])])
    found = pa.schema([("chunk", pa.int64()), ("at", pa.binary())])

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remembered = _Words()
        for batch in sliced(batches, 1):
            chunk, sizes, packed, hits = (batch.column(n)[0].as_py() for n in ("chunk", "sizes", "packed", "hits"))
            c = Chunk(packed, sizes, remembered)
            at, key = c.probes(block, buckets)
            hit = np.zeros(len(c.start) + block, bool)
            hit[at] = np.isin(key & ~np.uint64(3), np.frombuffer(b"".join(hits), "<u8")) & (key & np.uint64(1) == 1)
            at = c.windows(window)
            at = at[hit[at + (c.start[at] - at) % block]]  # the first block that the window holds whole
            if not len(at):
                continue
            a, b = window_hashes(c.high, window)[at], window_hashes(c.low, window)[at].astype(np.uint32)
            bucket = (a >> np.uint64(32)) % np.uint64(buckets)
            order = np.lexsort((b, a, bucket))
            a, b, at, bucket = a[order], b[order], at[order].astype(np.uint32), bucket[order]
            new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))
            several = np.append(np.diff(np.flatnonzero(new)), len(new) - np.flatnonzero(new)[-1]) > 1
            ask = np.where(several, _NOT_ASKED, at[new])
            a, b, bucket = a[new], b[new], bucket[new]
            rows = [(k, chunk, _bytes(a[s], "<u8"), _bytes(b[s], "<u4"), _bytes(ask[s], "<u4")) for k, s in _dealt(bucket)]
            # what repeats within the chunk is known
            rows.append((chunk % buckets, chunk, b"", b"", _bytes(np.sort(at[several[np.cumsum(new) - 1]]), "<u4")))
            yield pa.record_batch([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema)

    def compare(group: pa.Table) -> pa.Table:
        own, at = _arrays(group.column("a"), "<u8"), _arrays(group.column("at"), "<u4")
        a, b = np.concatenate(own), np.concatenate(_arrays(group.column("b"), "<u4"))
        order = np.lexsort((b, a))
        same = (a[order][1:] == a[order][:-1]) & (b[order][1:] == b[order][:-1])
        twice = np.zeros(len(a), bool)
        twice[order] = np.append(False, same)[: len(a)] | np.append(same, False)[: len(a)]
        out, start = [], 0
        for keys, ask in zip(own, at):
            told = twice[start : start + len(keys)] & (ask != _NOT_ASKED) if len(keys) else np.ones(len(ask), bool)
            start += len(keys)
            out.append(_bytes(ask[told], "<u4"))
        return pa.table([group.column("chunk"), pa.array(out, pa.binary())], schema=found)

    windows = asked.mapInArrow(extend, "bucket long, chunk long, a binary, b binary, at binary")
    return windows.groupBy("bucket").applyInArrow(compare, "chunk long, at binary").where("length(at) > 0")


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id``, ``n_words``, ``removed`` (array of first word, end) and the ``kept`` words of every row.

    Words covered by ``window`` words that start anywhere else too go, all copies of them; words are compared as
    they stand and kept ones joined by one space. Null and empty texts and texts without words have no words and
    keep the empty string; texts shorter than ``window`` words stay whole. Rows that are equal in id and text are
    copies of each other like any other rows. An empty table gives an empty one. Further columns are left out.
    """
    if window < 1:
        raise ValueError("window must be at least one word")
    block = (window + 1) // 2
    chunked = chunks(docs)
    spark = docs.sparkSession
    total = chunked.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    buckets = max(1, total // BUCKET_BYTES)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // (4 * CHUNK_BYTES))
    texts_by_chunk = chunked.select("chunk", "docs", "sizes", "packed").repartition(parts, "chunk")

    def with_lists(lists: DataFrame, name: str, how: str) -> DataFrame:
        return texts_by_chunk.join(lists.groupBy("chunk").agg(F.collect_list(name).alias(name)), "chunk", how)

    hits = block_hits(chunked.repartition(parts) if parts > 8 * buckets else chunked, block, buckets)
    asked = with_lists(hits, "hits", "inner").select("chunk", "sizes", "packed", "hits")
    spans = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("removed", spans), ("kept", pa.string())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1):
            ids, sizes, packed, at = (batch.column(n)[0].as_py() for n in ("docs", "sizes", "packed", "at"))
            text = zstandard.ZstdDecompressor().decompress(packed) if packed else b""
            at = np.sort(np.frombuffer(b"".join(at or ()), "<u4")).astype(np.int64)
            start, place, rows = 0, 0, []
            for doc, size in zip(ids, sizes):
                words = text[place : place + size].split()
                own = at[np.searchsorted(at, start) : np.searchsorted(at, start + len(words))] - start
                gap = np.flatnonzero(own[1:] > own[:-1] + window)
                firsts = own[np.append(0, gap + 1)].tolist() if len(own) else []
                ends = (own[np.append(gap, -1)] + window).tolist() if len(own) else []
                edges = [0, *(x for s in zip(firsts, ends) for x in s), len(words)]
                kept = b" ".join([w for a, b in zip(edges[::2], edges[1::2]) for w in words[a:b]])
                rows.append((doc, len(words), [{"a": a, "b": b} for a, b in zip(firsts, ends)], kept.decode()))
                start, place = start + len(words), place + size
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    found = repeated_windows(asked, window, buckets)
    told = with_lists(found, "at", "left").select("docs", "sizes", "packed", "at")
    return told.mapInArrow(cut, "doc_id long, n_words long, removed array<struct<a:long,b:long>>, kept string")
