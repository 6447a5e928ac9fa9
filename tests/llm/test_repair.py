"""Conversation repair against a plain left-to-right search over all edits."""

import hashlib
import random

import pytest

from credilake.llm import queries, repair

BLANKS = " \t\n\x0b\x0c\r"
STEP = {("0", "s"): "1", ("0", "u"): "2", ("1", "u"): "2", ("2", "a"): "3", ("3", "u"): "2"}


def brute_one(rows):
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    rows.sort(key=lambda q: (q[0] is not None, q[0] or 0, q[1], hashlib.md5(q[2].encode()).hexdigest()))
    turns = [t for t, _, _ in rows if t is not None]
    seen, faults = set(), []
    for _, r, x in rows:
        y = x.strip(BLANKS)
        faults.append("b" if not y else "d" if (r, x) in seen else "t" if y[-1] not in ".!?" else "")
        seen.add((r, x))

    def better(states, state, cost, audit, out):
        if state and (state not in states or (cost, audit) < states[state][:2]):
            states[state] = cost, audit, out
            return True

    def closed(states):
        while any(
            better(states, STEP.get((s, role[0])), c + 5, a + "I", (*o, (role, "")))
            for s, (c, a, o) in list(states.items())
            for role in ("user", "assistant")
        ):
            pass
        return states

    states = closed({"0": (0, "", ())})
    for (_, r, x), fault in zip(rows, faults):
        after: dict = {}
        for s, (c, a, o) in states.items():
            better(after, s, c + 2, a + "D", o)
            if fault not in ("b", "d"):
                more = 5 * (fault == "t")
                better(after, STEP.get((s, r[:1])), c + more, a + "K", (*o, (r, x)))
                for role in ("user", "assistant"):
                    better(after, STEP.get((s, role[0])), c + more + 1, a + "R", (*o, (role, x)))
        states = closed(after)
    cost, audit, out = min(states[s] for s in ("0", "3") if s in states)
    illegal = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    text = "\n".join(f"{r}:{x}" for r, x in out)
    return gaps, *(faults.count(f) for f in "bdt"), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest(), text


def brute(rows):
    by: dict = {}
    for conv, *row in rows:
        by.setdefault(conv, []).append(tuple(row))
    return {conv: brute_one(own) for conv, own in by.items()}


def rows():
    rnd = random.Random(3)
    texts = ["Hi.", "Hello there", "What? ", " ", "", None, "ok!\n", "Ünï  ", "x. ", "w?", "a. ", "long " * 3000 + "."]
    roles = ["user", "assistant", "system", "tool", None, "User", "", "u2"]

    def conversation(i, n):
        for _ in range(n):
            text = f"t{rnd.randrange(1000)}{rnd.choice('.!?:')}" if rnd.random() < 0.7 else rnd.choice(texts)
            yield i, rnd.choice([None, *range(2 * n)]), rnd.choices(roles, [9, 9, 3, 1, 1, 1, 1, 1])[0], text

    sizes = [(i, rnd.randrange(1, 12)) for i in range(150)] + [(None, 40), (-1, 30), (9999, 1500)]
    return [row for i, n in sizes for row in conversation(i, n)]


SCHEMA = "conv_id long, turn long, role string, text string, conv string, at string, seg string, audit string"


@pytest.mark.parametrize("bits", [9, 2])
def test_equals_search_over_all_edits(spark, monkeypatch, bits):
    monkeypatch.setattr(repair, "SEGMENT_BITS", bits)
    df = spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows()], SCHEMA).repartition(5)
    got = {r[0]: tuple(r[1:]) for r in repair.repair_conversations(df).collect()}
    want = brute(rows())
    assert got == {conv: w[:-1] for conv, w in want.items()}
    turns = repair.repaired_turns(df, repair.audits(df)).collect()
    texts = {conv: "\n".join(f"{r['role']}:{r['text']}" for r in sorted((t for t in turns if t["conv_id"] == conv), key=lambda t: t["position"])) for conv in want}
    assert texts == {conv: w[-1] for conv, w in want.items()}


def test_query_damages_and_keeps_every_conversation(spark):
    data = "/root/testdata/sf0.001"
    source = spark.read.parquet(f"{data}/conversations.parquet")
    got = {r[0]: tuple(r[1:]) for r in queries.op12_repair(spark, data).collect()}
    hurt = [tuple(r) for r in queries.damaged(source.select("conv_id", "turn", "role", "text")).collect()]
    want = {conv: w[:-1] for conv, w in brute(hurt).items()}
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())
    assert got == {r["conv_id"]: want.get(r["conv_id"], nothing) for r in source.select("conv_id").distinct().collect()}


def test_damage_follows_the_checksum(spark):
    import zlib

    rows = [(c, t, "system", "A. b! c?") for c in range(12) for t in range(12)] + [(None, None, None, None)]
    got = sorted(map(str, queries.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()))
    want = []
    for c, t, role, text in rows:
        n = lambda x: " " if x is None else x
        kind = zlib.crc32(f"{n(c)}:{n(t)}".encode()) % 20
        said = "" if kind == 1 else n(text).translate({ord(x): None for x in ".!?"}) if kind == 2 else n(text)
        want += [(c, t, "user" if kind == 4 else n(role), said)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    frame = spark.createDataFrame(want, "conv_id long, turn long, role string, text string")
    assert got == sorted(map(str, frame.collect()))


def test_empty_tables_and_conversations_without_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    ids = spark.createDataFrame([(1,), (None,), (1,)], "conv_id long")
    assert repair.repair_conversations(none).collect() == []
    got = sorted(repair.repair_conversations(none, ids).collect(), key=lambda r: r[0] or 0)
    assert [tuple(r) for r in got] == [(i, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest()) for i in (None, 1)]


def test_rules_are_shared_and_exact(spark):
    sequences = spark.createDataFrame([("BCBCBCBC", 50), ("ABCBC", 30), ("BIFC", 3)], "symbols string, n long")
    grammar = repair.learned(sequences)
    assert grammar.rules and len(grammar.compressed("BCBCBCBC")) == 1
    plain = repair.Grammar()
    for text in ("BCBCBCBC", "ABCBC", "BIFCBCA", "", "GGHHAB"):
        assert grammar.matrix(text) == plain.matrix(text)
