"""Line dedup: a line that many documents hold stays only in the document with the largest id."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_intdigest

from credilake.llm.base import keyed, sliced, texts
from credilake.session import materialize

MIN_CHARS = 20
MIN_DOCUMENTS = 3

#: Stands for a null id while ids are compared: below all others.
NO_ID = -(1 << 63)

#: A run of equal lines that is longer than this is not held back while streaming.
HELD_ROWS = 50_000

_LINES = pa.schema([(n, pa.int64()) for n in ("k1", "k2", "doc", "row")] + [("at", pa.int32())])
_FOUND = pa.schema([*_LINES, ("open", pa.bool_())])


def line_key(line: bytes) -> bytes:
    """A line without blanks at its ends and with A-Z in lower case."""
    return line.strip(b" \t\n\x0b\f\r").lower()


def long_enough(key: bytes, min_chars: int) -> bool:
    """At least ``min_chars`` code points; decoded only where the number of bytes does not tell."""
    return len(key) >= min_chars and (len(key) >= 4 * min_chars or len(key.decode("utf-8", "replace")) >= min_chars)


def rows_of(docs: DataFrame, *more: str) -> DataFrame:
    """``doc`` and ``row`` tell rows apart (id and text); null ids count as the smallest."""
    return keyed(docs, *more).select(
        F.coalesce("doc_id", F.lit(NO_ID)).alias("doc"), F.xxhash64("text").alias("row"), "text", *more
    )


def line_hashes(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """128-bit hash ``k1, k2``, ``doc``, ``row`` and number ``at`` of every line long enough to count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            hashes, which, ats = bytearray(), [], []
            for i, text in enumerate(texts(batch)):
                for at, line in enumerate(text.split(b"\n")):
                    if len(line) >= min_chars and long_enough(key := line_key(line), min_chars):
                        hashes += xxh3_128_intdigest(key).to_bytes(16, "little")
                        which.append(i)
                        ats.append(at)
            k = np.frombuffer(bytes(hashes), np.int64).reshape(-1, 2)
            at_row = pa.array(which, pa.int32())
            yield pa.record_batch(
                [
                    pa.array(k[:, 0]),
                    pa.array(k[:, 1]),
                    batch.column("doc").take(at_row),
                    batch.column("row").take(at_row),
                    pa.array(ats, pa.int32()),
                ],
                schema=_LINES,
            )

    return rows_of(docs).mapInArrow(run, "k1 long, k2 long, doc long, row long, at int")


def _streamed(min_docs: int):
    """Walks lines sorted by hash, document (largest first) and position, and yields those to drop.

    Of a key that ends inside the partition, all lines but those of its first document are yielded if it has
    enough documents. The partition's first and last key may go on in its neighbours: their lines are all
    yielded, marked open, and so are those of a run too long to be held back.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.Table.from_batches([], _LINES)  # the run that has not ended yet
        first, spilled = True, False  # the run is the partition's first; some of it is out already, as open

        def out(rows: pa.Table, is_open: np.ndarray) -> Iterator[pa.RecordBatch]:
            yield from rows.append_column("open", pa.array(is_open)).to_batches()

        for batch in batches:
            rows = pa.concat_tables([held, pa.Table.from_batches([batch]).cast(_LINES)]).combine_chunks()
            if not rows.num_rows:
                continue
            k1, k2, doc = (rows.column(c).to_numpy() for c in ("k1", "k2", "doc"))
            new = np.r_[True, (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])]
            starts = np.flatnonzero(new)
            last = starts[-1]
            run_of = np.cumsum(new) - 1
            turn = np.r_[0, ((doc[1:] != doc[:-1]) & ~new[1:]).cumsum()]
            turn -= turn[starts][run_of]  # how many documents of the key came before
            docs = np.maximum.reduceat(turn, starts) + 1
            is_open = (run_of == 0) & (first or spilled)
            drop = is_open | ((turn > 0) & (docs[run_of] >= min_docs))
            drop[last:] = False
            if drop.any():
                yield from out(rows.filter(pa.array(drop)), is_open[drop])
            if len(starts) > 1:
                first = spilled = False
            held = rows.slice(last)
            if held.num_rows > HELD_ROWS:
                yield from out(held, np.ones(held.num_rows, bool))
                # one row stays, so that the next batch is seen to go on with this key; it is open twice
                held, spilled = held.slice(held.num_rows - 1), True
        if held.num_rows:
            yield from out(held, np.ones(held.num_rows, bool))

    return run


def repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCUMENTS) -> DataFrame:
    """``doc, row, at`` of every line to drop; a line can be listed twice.

    Hashes are range-partitioned with document and position as secondary sort and streamed, see ``_streamed``.
    The range goes over hash and document, so a line that a third of all documents hold is spread over as many
    partitions as its rows need. The runs of one key in several partitions are put together by a grouped
    maximum and count; there are at most two open keys a partition and one per ``HELD_ROWS`` lines.
    """
    order = [F.col("k1"), F.col("k2"), F.col("doc").desc(), F.col("row"), F.col("at")]
    found = materialize(
        line_hashes(docs, min_chars)
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .mapInArrow(_streamed(min_docs), "k1 long, k2 long, doc long, row long, at int, open boolean"),
        "lines",
    )
    still_open = found.where("open")
    shared = (
        still_open.groupBy("k1", "k2", "doc")
        .agg(F.lit(1).alias("n"))
        .groupBy("k1", "k2")
        .agg(F.count("n").alias("docs"), F.max("doc").alias("keeper"))
        .where(F.col("docs") >= min_docs)
    )
    # a few keys per partition, so they are sent to the lines: a line that a third of all documents hold stays spread
    # at most two keys per partition and one per HELD_ROWS lines
    decided = still_open.join(F.broadcast(shared), ["k1", "k2"]).where(F.col("doc") != F.col("keeper"))
    return found.where("not open").select("doc", "row", "at").unionByName(decided.select("doc", "row", "at"))


def pack(dropped: np.ndarray) -> bytes:
    """Bitmap of kept lines up to the last dropped one, compressed; what lies behind is kept."""
    keep = np.ones(8 * (int(dropped.max()) // 8 + 1), bool)  # whole bytes: padding must not read as dropped
    keep[dropped] = False
    return zlib.compress(np.packbits(keep).tobytes())


def unpack(bitmap: bytes, n_lines: int) -> np.ndarray:
    keep = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8)).astype(bool)
    return np.r_[keep[:n_lines], np.ones(max(0, n_lines - len(keep)), bool)]


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCUMENTS) -> DataFrame:
    """``doc, row, n_dropped, bitmap`` of every row that loses lines; the others need none.

    ``doc`` is the id (null ids: ``NO_ID``), ``row`` the hash of the text. Rows with one id are one document when
    documents are counted, whatever their texts. Null and empty texts are one empty line, which never counts.
    """

    @F.pandas_udf("bitmap binary, n_dropped long")
    def bitmaps(ats: pd.Series) -> pd.DataFrame:
        unique = [np.unique(np.asarray(x)) for x in ats]
        return pd.DataFrame({"bitmap": [pack(x) for x in unique], "n_dropped": [len(x) for x in unique]})

    dropped = repeated_lines(docs, min_chars, min_docs).groupBy("doc", "row").agg(F.collect_list("at").alias("ats"))
    return dropped.select("doc", "row", bitmaps("ats").alias("b")).select("doc", "row", "b.bitmap", "b.n_dropped")


def drop_lines(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """The columns of ``docs`` with the kept ``text`` (null stays null where nothing is dropped), ``n_lines`` and
    ``n_dropped``. Columns of ``docs`` by the last two names are replaced."""

    @F.pandas_udf("string")
    def kept(text: pd.Series, bitmap: pd.Series) -> pd.Series:
        def one(t, b):
            if b is None:
                return t
            split = t.split("\n")
            return "\n".join(np.asarray(split, object)[unpack(b, len(split))])

        return pd.Series([one(t, b) for t, b in zip(text, bitmap)], dtype=object)

    columns = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    text = F.coalesce(F.col("text"), F.lit(""))
    left = docs.select(
        F.struct(*columns).alias("d"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"),
        F.xxhash64(text).alias("row"),
    )
    joined = left.join(bitmaps.select("doc", "row", "bitmap", F.col("n_dropped").alias("dropped")), ["doc", "row"], "left")
    return joined.select(
        *[(kept("d.text", "bitmap") if c == "text" else F.col(f"d.{c}")).alias(c) for c in columns],
        (F.length("d.text") - F.length(F.translate("d.text", "\n", "")) + 1).alias("n"),
        F.coalesce("dropped", F.lit(0)).cast("long").alias("n_dropped"),
    ).select(*columns, F.coalesce("n", F.lit(1)).cast("long").alias("n_lines"), "n_dropped")


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCUMENTS) -> DataFrame:
    """Every row of ``docs`` with its remaining text; see ``drop_lines``."""
    return drop_lines(docs, keep_bitmaps(docs, min_chars, min_docs))
