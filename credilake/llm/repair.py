"""Conversation structure repair: the cheapest edits that make the roles of a conversation ``(s?(ua)+)?``.

A row is a symbol of its role and fault. A symbol is a 4 x 4 matrix over the states of the grammar: what the
cheapest edits of that row cost on the way from one state to another, and their audit. Matrices are multiplied by
minimum and sum. Re-Pair names the commonest pairs of symbols over all conversations, then the commonest pairs of
those; a rule's matrix is the product of its two parts' and is made once for all conversations, its audit a rope of
the parts' audits.

Rows are numbered in the order of conversation and turn. A conversation is cut at every 512th row of the table into
segments, whose matrices are multiplied in groups of 512 until one is left, so that no task holds the rows of a long
conversation.

Of two equally cheap edits with different audits neither audit begins with the other (it would have further inserts
and so cost more), therefore the smaller one stays the smaller one whatever is put before or behind.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credilake.llm.base import same_row, sliced
from credilake.session import materialize

#: Costs and what a truncated row adds unless it is deleted.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5

#: States of the grammar: start, after s, after u, after a; ends in ``ACCEPTING``.
STEPS = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
ACCEPTING = (0, 3)
LEGAL = ("su", "ua", "au")

#: Rows of a segment and matrices multiplied at a time, as a power of two.
SEGMENT_BITS = 9
RULE_ROUNDS = 8
RULES_A_ROUND = 32
#: Rules are made of pairs met at least so often; a worker remembers the matrices of so many sequences.
LEAST_PAIRS = 4
REMEMBERED = 20_000

_BLANKS = " \t\n\x0b\x0c\r"
_ROLES = "sua"  # others are number 3
_BLANK, _DUPLICATE = 2, 3  # faults; 0 is none, 1 truncated

Entry = tuple[int, object] | None  # cost and audit, a text or a pair of ropes
Matrix = list[list[Entry]]


def flat(rope) -> str:
    """The text of a rope."""
    out, stack = [], [rope]
    while stack:
        part = stack.pop()
        if isinstance(part, str):
            out.append(part)
        else:
            stack += part[1], part[0]
    return "".join(out)


def cheaper(a: Entry, b: Entry) -> Entry:
    if a is None or b is None:
        return b if a is None else a
    if a[0] != b[0]:
        return min(a, b, key=lambda x: x[0])
    return a if flat(a[1]) <= flat(b[1]) else b


def product(a: Matrix, b: Matrix) -> Matrix:
    out: Matrix = [[None] * 4 for _ in range(4)]
    for i in range(4):
        for k, first in enumerate(a[i]):
            if first:
                for j, second in enumerate(b[k]):
                    if second:
                        out[i][j] = cheaper(out[i][j], (first[0] + second[0], (first[1], second[1])))
    return out


def unit() -> Matrix:
    return [[(0, "") if i == j else None for j in range(4)] for i in range(4)]


def inserts() -> Matrix:
    """Any number of inserts; more than two never pay."""
    one: Matrix = [[None] * 4 for _ in range(4)]
    for role in "ua":
        for i, j in STEPS[role].items():
            one[i][j] = (INSERT, "I")
    once = [[cheaper(x, y) for x, y in zip(*rows)] for rows in zip(unit(), one)]
    return product(once, once)


def row_matrix(role: int, fault: int) -> Matrix:
    """Inserts, then one edit of a row."""
    edits: Matrix = [[(DELETE, "D") if i == j else None for j in range(4)] for i in range(4)]
    if fault < _BLANK:
        more = TRUNCATED * fault
        for name in "sua":
            kept = _ROLES[role : role + 1] == name
            for i, j in STEPS[name].items():
                if kept or name != "s":
                    edits[i][j] = cheaper(edits[i][j], (more, "K") if kept else (REROLE + more, "R"))
    return product(inserts(), edits)


#: Symbols A to H stand for role + 4 * fault, I for every row that has to go.
SYMBOLS = {chr(65 + code): row_matrix(code & 3, code >> 2) for code in range(9)}


def symbols(codes: str) -> str:
    """Symbols of rows with codes A to P: role + 4 * fault."""
    return codes.translate({65 + code: "I" for code in range(9, 16)})


class Grammar:
    """Re-Pair rules in the order in which they were made, and the matrices of all symbols."""

    def __init__(self):
        self.rules: list[tuple[str, str]] = []  # pair, its name
        self.matrices = dict(SYMBOLS)
        self.known: dict[str, Matrix] = {}

    def add(self, pair: str) -> None:
        name = chr(0xE000 + len(self.rules))
        self.matrices[name] = product(self.matrices[pair[0]], self.matrices[pair[1]])
        self.rules.append((pair, name))

    def compressed(self, sequence: str) -> str:
        for pair, name in self.rules:
            sequence = sequence.replace(pair, name)
        return sequence

    def matrix(self, sequence: str) -> Matrix:
        """Of a whole sequence, with flat audits."""
        if sequence not in self.known:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            out = unit()
            for name in self.compressed(sequence):
                out = product(out, self.matrices[name])
            self.known[sequence] = [[x and (x[0], flat(x[1])) for x in row] for row in out]
        return self.known[sequence]


def learned(sequences: DataFrame) -> Grammar:
    """Rules for the pairs that are commonest over all ``sequences`` (``symbols``, ``n`` times).

    Every round counts the pairs of all sequences as compressed so far and names the commonest ones of which no two
    can overlap. Equal sequences count as often as they occur; the counts are added up by Spark, and only the
    commonest pairs come to the driver.
    """
    grammar = Grammar()
    schema = pa.schema([("pair", pa.string()), ("n", pa.int64())])

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        for batch in batches:
            for text, n in zip(batch.column("symbols").to_pylist(), batch.column("n").to_pylist()):
                text = grammar.compressed(text)
                for pair in {text[i : i + 2] for i in range(len(text) - 1)}:
                    counts[pair] += n * text.count(pair)
        yield pa.record_batch([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], schema=schema)

    for _ in range(RULE_ROUNDS):
        counted = sequences.mapInArrow(pairs, "pair string, n long").groupBy("pair").agg(F.sum("n").alias("n"))
        best = counted.where(F.col("n") >= LEAST_PAIRS).orderBy(F.desc("n"), "pair").limit(2 * RULES_A_ROUND).collect()
        first, last, fresh = set(), set(), []
        for a, b in (row["pair"] for row in best):
            if a not in last and b not in first and (a != b or a not in first):
                first.add(a)
                last.add(b)
                fresh.append(a + b)
        for pair in fresh[:RULES_A_ROUND]:
            grammar.add(pair)
        if not fresh:
            break
    return grammar


def initials(role) -> F.Column:
    """Number of the initial of a role in ``sua``, 3 for any other."""
    found = F.substring(role, 1, 1)
    return F.when(found == "s", 0).when(found == "u", 1).when(found == "a", 2).otherwise(3)


def ordered(turns: DataFrame) -> DataFrame:
    """``conv``, ``turn``, ``role``, ``tie`` and ``code`` of every row, and ``at``, its number in the order of these.

    The number has no gaps. Duplicates are not told yet. Texts stay behind.
    """
    ends = F.rtrim("text", F.lit(_BLANKS))
    fault = F.when(F.length(ends) == 0, _BLANK).when(F.right(ends, F.lit(1)).isin(".", "!", "?"), 0).otherwise(1)
    narrow = turns.select(
        "conv", "turn", "role", F.md5(F.col("text").cast("binary")).alias("tie"),
        (initials(F.col("role")) + 4 * fault).cast("int").alias("code"), F.monotonically_increasing_id().alias("salt"),
    )
    keys = ("conv", "turn", "role", "tie", "salt")
    parts = max(1, int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = (
        narrow.repartitionByRange(parts, *keys)
        .sortWithinPartitions(*keys)
        .withColumn("at", F.monotonically_increasing_id())
        .drop("salt")
    )
    placed = materialize(placed, "turns")
    part = F.shiftright("at", 33).cast("int")
    sizes = placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    before, total = {}, 0
    for row in sorted(sizes.collect()):  # one row per partition
        before[row["part"]], total = total, total + row["n"]
    shift = F.element_at(F.create_map(*(F.lit(x) for pair in before.items() for x in pair)), part) if before else F.lit(0)
    return placed.withColumn("at", F.col("at").bitwiseAND((1 << 33) - 1) + shift)


_SUMS = "blank long, duplicate long, truncated long, illegal long, first int, last int"
_SEGMENT = f"conv long, seg long, {_SUMS}, costs array<long>, audits array<string>"
_SEGMENT_SCHEMA = pa.schema(
    [("conv", pa.int64()), ("seg", pa.int64())]
    + [(n, pa.int64()) for n in ("blank", "duplicate", "truncated", "illegal")]
    + [("first", pa.int32()), ("last", pa.int32())]
    + [("costs", pa.list_(pa.int64())), ("audits", pa.list_(pa.string()))]
)


def _illegal(a: int, b: int) -> bool:
    return (_ROLES + "-")[a] + (_ROLES + "-")[b] not in LEGAL


def _listed(matrix: Matrix) -> tuple[list, list]:
    entries = [x for row in matrix for x in row]
    return [x and x[0] for x in entries], [x and flat(x[1]) for x in entries]


def _segment_codes(rows: DataFrame) -> DataFrame:
    """``conv``, ``seg`` and ``codes`` of its rows in order, duplicates told from the first of their kind.

    First rows find their segment by their number: a grouped minimum and a union, no join, and nothing that one
    common text could make large.
    """
    firsts = rows.groupBy("conv", "role", "tie").agg(F.min("at").alias("at")).select("conv", "at")
    seg = F.shiftright("at", SEGMENT_BITS).alias("seg")
    both = rows.select("conv", seg, "at", "code").unionByName(firsts.select("conv", seg, "at", F.lit(-1).alias("code")))
    schema = pa.schema([("conv", pa.int64()), ("seg", pa.int64()), ("codes", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for rows in batch.column("rows").to_pylist():
                first = {r["at"] for r in rows if r["code"] < 0}
                codes = []
                for r in rows:
                    if (code := r["code"]) >= 0:
                        late = r["at"] not in first and code >> 2 != _BLANK
                        codes.append(chr(65 + (code & 3 | _DUPLICATE << 2 if late else code)))
                out.append("".join(codes))
            yield pa.record_batch([batch.column("conv"), batch.column("seg"), pa.array(out, pa.string())], schema=schema)

    listed = both.groupBy("conv", "seg").agg(F.sort_array(F.collect_list(F.struct("at", "code"))).alias("rows"))
    return listed.mapInArrow(run, "conv long, seg long, codes string")


def _solved(segments: DataFrame, grammar: Grammar) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            rows = []
            for conv, seg, codes in zip(*(batch.column(n).to_pylist() for n in ("conv", "seg", "codes"))):
                faults = Counter(ord(c) - 65 >> 2 for c in codes)
                roles = [ord(c) - 65 & 3 for c in codes]
                illegal = sum(map(_illegal, roles, roles[1:]))
                sums = faults[_BLANK], faults[_DUPLICATE], faults[1], illegal, roles[0], roles[-1]
                rows.append((conv, seg, *sums, *_listed(grammar.matrix(symbols(codes)))))
            yield _record(rows)

    return segments.mapInArrow(run, _SEGMENT)


def _record(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [()] * len(_SEGMENT_SCHEMA)
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, _SEGMENT_SCHEMA)], schema=_SEGMENT_SCHEMA)


def _multiplied(segments: DataFrame) -> DataFrame:
    """Segments put together by 512 neighbours."""
    names = ("costs", "audits", "blank", "duplicate", "truncated", "illegal", "first", "last")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            rows = []
            for conv, seg, parts in zip(*(batch.column(n).to_pylist() for n in ("conv", "seg", "parts"))):
                whole, sums, last = unit(), [0, 0, 0, 0], None
                for p in parts:
                    entries = [None if c is None else (c, a) for c, a in zip(p["costs"], p["audits"])]
                    whole = product(whole, [entries[i : i + 4] for i in range(0, 16, 4)])
                    sums = [s + p[n] for s, n in zip(sums, names[2:6])]
                    sums[3] += last is not None and _illegal(last, p["first"])
                    last = p["last"]
                rows.append((conv, seg, *sums, parts[0]["first"], last, *_listed(whole)))
            yield _record(rows)

    up = F.shiftright("seg", SEGMENT_BITS).alias("up")
    grouped = segments.groupBy("conv", up).agg(F.sort_array(F.collect_list(F.struct("seg", *names))).alias("parts"))
    return grouped.select("conv", F.col("up").alias("seg"), "parts").mapInArrow(run, _SEGMENT)


def _turns(turns: DataFrame) -> DataFrame:
    """Nulls in role and text are one space; further columns are left out."""
    return turns.select(
        F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"),
        *(F.coalesce(F.col(n).cast("string"), F.lit(" ")).alias(n) for n in ("role", "text")),
    )


def audits(turns: DataFrame) -> DataFrame:
    """``conv_id``, the counts of faults, ``illegal`` neighbours, ``cost`` and ``audit`` of every conversation."""
    rows = ordered(_turns(turns))
    segments = materialize(_segment_codes(rows), "segments")
    top = segments.agg(F.coalesce(F.max("seg"), F.lit(0))).first()[0]
    grown = segments.select(F.translate("codes", "JKLMNOP", "IIIIIII").alias("symbols"))
    sequences = materialize(grown.groupBy("symbols").agg(F.count(F.lit(1)).alias("n")), "sequences")
    solved = _solved(segments, learned(sequences))
    while True:
        solved = _multiplied(solved)
        top >>= SEGMENT_BITS
        if not top:
            break
    last = inserts()
    schema = pa.schema([("cost", pa.int64()), ("audit", pa.string())])
    counts = ("blank", "duplicate", "truncated", "illegal")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            found = []
            for costs, texts in zip(batch.column("costs").to_pylist(), batch.column("audits").to_pylist()):
                start = [None if c is None else (c, a) for c, a in zip(costs[:4], texts[:4])]
                ends = product([start, *[[None] * 4] * 3], last)[0]
                cost, rope = cheaper(*(ends[j] for j in ACCEPTING))
                found.append((cost, flat(rope)))
            cost, audit = zip(*found) if found else ((), ())
            arrays = [batch.column(n) for n in ("conv", *counts)] + [pa.array(cost, pa.int64()), pa.array(audit, pa.string())]
            yield pa.record_batch(arrays, names=["conv_id", *counts, *schema.names])

    return solved.mapInArrow(close, f"conv_id long, {', '.join(f'{n} long' for n in counts)}, cost long, audit string")


def _repaired(conv, audit: str, rows: Iterator[tuple]) -> Iterator[tuple]:
    """``conversation, position, role, text, edit`` of what is left; ``rows`` are role and text, taken one by one."""
    odd = (len(audit) - audit.count("D")) % 2  # begins with s
    place = 0
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(rows)
        if edit != "D":
            if edit != "K":
                role = "assistant" if (place - odd) % 2 else "user"
            yield conv, place, role, text, edit
            place += 1


def _streamed(turns: DataFrame, found: DataFrame) -> DataFrame:
    """Rows in the order of conversation and turn, each conversation led by its audit."""
    rows = _turns(turns).withColumn("tie", F.md5(F.col("text").cast("binary"))).withColumn("audit", F.lit(None).cast("string"))
    heads = found.select(
        F.col("conv_id").alias("conv"), *(F.lit(None).cast(t).alias(n) for n, t in (("turn", "long"), ("role", "string"), ("text", "string"), ("tie", "string"))), "audit"
    )
    both = rows.withColumn("head", F.lit(1)).unionByName(heads.withColumn("head", F.lit(0)))
    spread = F.coalesce("conv", F.lit(-1))
    return (
        both.repartition(spread)
        .sortWithinPartitions("conv", "head", "turn", "role", "tie")
        .select("conv", "audit", "role", "text")
    )


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """``conversation, audit, rows``; the rows have to be taken before the next conversation is asked for."""
    columns = ("conv", "audit", "role", "text")
    stream = (r for batch in sliced(batches) for r in zip(*(batch.column(n).to_pylist() for n in columns)))
    head = next(stream, None)

    def own() -> Iterator[tuple]:
        nonlocal head
        head = None
        for row in stream:
            if row[1] is not None:
                head = row
                return
            yield row[2:]

    while head:
        conv, audit = head[:2]
        rows = own()
        yield conv, audit, rows
        for _ in rows:
            pass


def repaired_turns(turns: DataFrame, found: DataFrame) -> DataFrame:
    """``conv_id, position, role, text, edit`` of the repaired conversations; ``found`` is the result of ``audits``."""
    schema = pa.schema(
        [("conv_id", pa.int64()), ("position", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("edit", pa.string())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready: list[tuple] = []
        for conversation in _conversations(batches):
            for row in _repaired(*conversation):
                ready.append(row)
                if len(ready) >= 512:
                    yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*ready), schema)], schema=schema)
                    ready = []
        if ready:
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*ready), schema)], schema=schema)

    return _streamed(turns, found).mapInArrow(run, "conv_id long, position long, role string, text string, edit string")


def repaired_digests(turns: DataFrame, found: DataFrame) -> DataFrame:
    """``conv_id`` and ``repaired_sha256``, of ``role:text`` of the repaired turns, one a line.

    The digest of a conversation is one after the other by nature, so its rows pass one task, one at a time.
    """
    schema = pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, digests = [], []
        for conv, audit, rows in _conversations(batches):
            digest = hashlib.sha256()
            for _, place, role, text, _ in _repaired(conv, audit, rows):
                digest.update(f"{chr(10) if place else ''}{role}:{text}".encode())
            ids.append(conv)
            digests.append(digest.hexdigest())
        yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(digests, pa.string())], schema=schema)

    return _streamed(turns, found).mapInArrow(run, "conv_id long, repaired_sha256 string")


def repair_conversations(turns: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256`` of every conversation.

    ``turns`` has conv_id, turn, role and text; nulls in role and text are one space, rows with a null conv_id are
    one conversation. Rows of one turn follow by role, then by the md5 of their text; null turns come first. Rows
    without anything but blanks have to go, as do those equal in role and text to an earlier one; repeated rows are
    such. ``gaps`` counts the turns missing between the first and the last (null where 64 bits do not hold it).
    Conversations in ``ids`` (``conv_id``) without any turn get zeros and an empty audit. An empty table gives an
    empty one. Further columns are left out.
    """
    found = materialize(audits(turns), "audits")
    span = F.max("turn").cast("decimal(38,0)") - F.min("turn").cast("decimal(38,0)") + 1 - F.countDistinct("turn")
    gaps = _turns(turns).groupBy("conv").agg(F.coalesce(span, F.lit(0)).alias("gaps"))
    gaps = gaps.select(F.col("conv").alias("gap_conv"), F.expr("try_cast(gaps AS long)").alias("gaps"))
    digests = repaired_digests(turns, found).withColumnRenamed("conv_id", "digest_conv")
    whole = found.join(gaps, found["conv_id"].eqNullSafe(gaps["gap_conv"])).join(
        digests, found["conv_id"].eqNullSafe(digests["digest_conv"])
    )
    counts = ("blank", "duplicate", "truncated", "illegal", "cost")
    names = ("gaps", *counts, "audit", "repaired_sha256")
    if ids is None:
        return whole.select("conv_id", *names)
    every = ids.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    joined = every.join(whole, same_row(every, found, "conv_id"), "left")
    empty = {"audit": F.lit(""), "repaired_sha256": F.lit(hashlib.sha256().hexdigest())}
    # a gap count too large for 64 bits stays null
    absent = found["audit"].isNull()
    return joined.select(every["conv_id"], *(F.when(absent, empty.get(n, F.lit(0))).otherwise(whole[n]).alias(n) for n in names))
