"""Document fingerprints: a hash tree over sections, paragraphs and phrases of a text."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from xxhash import xxh3_128_digest

from credilake.llm.base import keyed, sliced
from credilake.session import materialize

#: A phrase ends where a hash of the last four bytes says so, on average behind every 24th byte, in lines of any
#: length alike. So what follows an edit is cut as it was before, four bytes behind it at the latest.
_FACTORS, _BELOW = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F), (1 << 32) // 24

#: A section ends behind a paragraph whose hash ends in these bits all zero: on average every eighth.
SECTION_MASK = 7


class Node(NamedTuple):
    """A branch: its hash, the bytes below it, and its children (phrases have none)."""

    digest: bytes
    weight: int
    children: tuple[Node, ...] | list[Node]


def _inner(kind: bytes, children: list[Node]) -> Node:
    digests = [c.digest for c in children]
    return Node(xxh3_128_digest(kind + b"".join(digests)), sum(c.weight for c in children), children)


def phrase_ends(text: bytes) -> list[int]:
    """Places behind which a phrase ends, in order."""
    b = np.frombuffer(text, np.uint8).astype(np.uint32)
    if len(b) < 4:
        return []
    h = sum(b[i : len(b) - 3 + i] * np.uint32(f) for i, f in enumerate(_FACTORS))
    h = (h ^ h >> np.uint32(15)) * np.uint32(0x2C1B3C6D)
    return (np.flatnonzero(h < np.uint32(_BELOW)) + 4).tolist()


def tree(text: bytes) -> Node:
    """Root over sections over paragraphs (lines) over phrases.

    Phrases end where the last bytes say so and sections where a paragraph's own hash does, so an edit leaves the
    borders elsewhere as they were. The phrases of a text together are the text, and each level marks
    what it is, so equal roots stand for equal texts. An empty text has one empty paragraph.
    """
    sections: list[Node] = []
    section: list[Node] = []
    ends, place, start = phrase_ends(text), 0, 0
    for line in text.split(b"\n"):
        # the line break counts as a byte of its paragraph, so that empty lines weigh something
        stop = start + len(line)
        first = place = bisect_right(ends, start, place)
        place = bisect_left(ends, stop, first)
        phrases, at = [], start
        for end in [*ends[first:place], stop] if line else ():
            phrases.append(Node(xxh3_128_digest(text[at:end]), end - at, ()))
            at = end
        start = stop + 1
        digest = xxh3_128_digest(b"p" + b"".join([p.digest for p in phrases]))
        section.append(Node(digest, len(line) + 1, phrases))
        if not digest[-1] & SECTION_MASK:
            sections.append(_inner(b"s", section))
            section = []
    if section:
        sections.append(_inner(b"s", section))
    return _inner(b"d", sections)


def _apart(a: list[Node], b: list[Node]) -> tuple[int, list[Node], list[Node]]:
    """Weight of branches that stand on both sides, and the branches that do not, repeats counted."""
    have = Counter(x.digest for x in b)
    common, left = 0, []
    for x in a:
        if have[x.digest] > 0:
            have[x.digest] -= 1
            common += x.weight
        else:
            left.append(x)
    right = []
    for x in reversed(b):
        if have[x.digest] > 0:
            have[x.digest] -= 1
            right.append(x)
    return common, left, right[::-1]


def likeness(a: Node, b: Node) -> float:
    """Bytes in equal branches over all bytes, 0 to 1; only differing branches are opened."""
    if a.digest == b.digest:
        return 1.0
    common, left, right = 0, [a], [b]
    while left and right:
        left = [c for x in left for c in x.children]
        right = [c for x in right for c in x.children]
        found, left, right = _apart(left, right)
        common += found
    return min(1.0, 2 * common / (a.weight + b.weight))


def edits(a: Node, b: Node) -> list[tuple[int, int]]:
    """Byte spans of ``a`` whose phrases or paragraphs stand in no matching place of ``b``."""
    spans: list[list[int]] = []

    def walk(x: Node, y: list[Node], at: int) -> None:
        have = Counter(n.digest for n in y)
        pending = []
        for child in x.children:
            if have[child.digest] > 0:
                have[child.digest] -= 1
            else:
                pending.append((child, at))
            at += child.weight
        others = [c for n in y if have[n.digest] > 0 for c in n.children]
        for child, start in pending:
            if child.children:
                walk(child, others, start)
            elif spans and spans[-1][1] == start:
                spans[-1][1] = start + child.weight
            else:
                spans.append([start, start + child.weight])

    if a.digest != b.digest:
        walk(a, list(b.children), 0)
    return [tuple(s) for s in spans]


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id``, root ``fingerprint`` (32 hex digits), numbers of sections, paragraphs and phrases, one row per
    row. Null texts are empty; null ids are kept; other columns are left out. No shuffle."""
    schema = pa.schema(
        [("doc_id", pa.int64()), ("fingerprint", pa.string())]
        + [(n, pa.int64()) for n in ("n_sections", "n_paragraphs", "n_phrases")]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                root = tree(text.encode())
                paragraphs = [p for s in root.children for p in s.children]
                rows.append(
                    (doc_id, root.digest.hex(), len(root.children), len(paragraphs), sum(len(p.children) for p in paragraphs))
                )
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return keyed(docs).mapInArrow(
        run, "doc_id long, fingerprint string, n_sections long, n_paragraphs long, n_phrases long"
    )


def with_next(docs: DataFrame, apply: Callable[[str, str], tuple], fields: str) -> DataFrame:
    """``doc_id`` and what ``apply(text, text of the next row)`` returns, for every row.

    The order is descending by id, then by hash of the text; null ids come last, and the first row follows the
    last one. Rows are range-sorted once and streamed. A partition's last row waits: its partner heads the next
    partition, and the two are joined on the partition's number. That concerns one row per partition.
    """
    names = [f.split()[0] for f in fields.split(", ")]
    order = [F.col("doc_id").desc_nulls_last(), F.xxhash64("text")]
    kinds = "kind int, part int, other string, doc_id long, " + fields

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, str]]:
        for batch in sliced(batches):
            yield from zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist())

    def packed(out: list[tuple]) -> pa.RecordBatch:
        ends = [(k, p, t, i, *([None] * len(names) if r is None else r)) for k, p, t, i, r in out]
        columns = [list(c) for c in zip(*ends)]
        types = [pa.int32(), pa.int32(), pa.string(), pa.int64()]
        arrays = [pa.array(c, t) for c, t in zip(columns, types)]
        arrays += [pa.array(c, _ARROW[f.split()[1]]) for c, f in zip(columns[4:], fields.split(", "))]
        return pa.RecordBatch.from_arrays(arrays, names=["kind", "part", "other", "doc_id", *names])

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        out: list[tuple] = []
        before = None
        for row in rows(batches):
            if before is None:
                out.append((1, part, row[1], None, None))
            else:
                out.append((0, part, None, before[0], apply(before[1], row[1])))
            before = row
            if len(out) >= 1000:
                yield packed(out)
                out = []
        if before is not None:
            out.append((2, part, before[1], before[0], None))
            yield packed(out)

    def paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            columns = [batch.column(n).to_pylist() for n in ("doc_id", "text", "follows")]
            out = [(0, 0, None, i, apply(a, b)) for i, a, b in zip(*columns)]
            if out:
                yield packed(out)

    stored = materialize(
        keyed(docs).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(stream, kinds), "neighbours"
    )
    heads = stored.where("kind = 1").select("part", F.col("other").alias("follows"))
    parts = heads.select("part")
    everywhere = Window.orderBy("part")  # one row per partition
    following = parts.select(
        "part", F.coalesce(F.lead("part").over(everywhere), F.first("part").over(everywhere)).alias("head")
    )
    waiting = (
        stored.where("kind = 2")
        .select("part", "doc_id", F.col("other").alias("text"))
        .join(following, "part")
        .join(heads.withColumnRenamed("part", "head"), "head")
        .select("doc_id", "text", "follows")
    )
    done = waiting.mapInArrow(paired, kinds)
    return stored.where("kind = 0").unionByName(done).select("doc_id", *names)


#: Types that ``with_next`` can return.
_ARROW = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}
