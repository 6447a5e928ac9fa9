"""Sharding, mixing and hash trees against brute force."""

import random
import zlib
from collections import defaultdict
from difflib import SequenceMatcher
from hashlib import sha256

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from text_cases import frame, pairs, rows

from credilake.llm import merkle, mixing, shards
from credilake.llm.queries import QUERIES

DATA = "/root/testdata/sf0.001"


def smallest_capacity(sizes, n):
    """By trying every sum of neighbours."""
    def fits(capacity):
        used, room = 0, -1
        for s in sizes:
            if s > capacity:
                return False
            if s > room:
                used, room = used + 1, capacity
            room -= s
        return used <= n

    return min(c for a in range(len(sizes)) for b in range(a, len(sizes)) if fits(c := sum(sizes[a : b + 1])))


@settings(max_examples=25, deadline=None)
@given(st.lists(st.integers(1, 50), min_size=1, max_size=25), st.integers(1, 6))
def test_smallest_capacity(spark, sizes, n):
    groups = spark.createDataFrame([(i * (1 << 62) // len(sizes) + i % 3, s) for i, s in enumerate(sizes)], "key long, size long")
    capacity, behind = shards.minimax_cuts(groups, n, cells=4)
    assert capacity == smallest_capacity(sizes, n)
    loads = defaultdict(int)
    for r in groups.collect():
        loads[sum(r["key"] >= k for k in behind)] += r["size"]
    assert max(loads.values()) <= capacity and len(behind) == n - 1


def check_shards(got, n):
    slots, groups = defaultdict(list), defaultdict(set)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        groups[r["key"]].add(r["shard"])
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert all(len(x) == 1 for x in groups.values()) and set(slots) <= set(range(n))


def test_shards_of_odd_rows(spark):
    got = shards.shard_documents(frame(spark), 4).collect()
    check_shards(got, 4)
    expected = sorted((str(i), len(t.encode()) + 8, zlib.crc32(t.encode())) for i, t in pairs())
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in got) == expected
    assert shards.shard_documents(frame(spark, empty=True)).count() == 0


def test_a_large_group_gets_a_shard_of_its_own(spark):
    docs = spark.createDataFrame([(i, "copy of one text " * 10 if i < 300 else f"text {i} " * 9) for i in range(900)], "doc_id long, text string")
    got = shards.shard_documents(docs).collect()
    check_shards(got, 24)
    load = defaultdict(int)
    for r in got:
        load[r["shard"]] += r["size"]
    own = {r["shard"] for r in got if r["doc_id"] < 300}
    rest = [v for k, v in load.items() if k not in own]
    assert len(own) == 1 and len(load) == 24 and max(rest) < 1.25 * min(rest)


def test_sharding_query(spark):
    got = QUERIES["op5_sharding"](spark, DATA).collect()
    load = defaultdict(int)
    for r in got:
        load[r["shard"]] += r["size"]
    assert len(got) == 200 and len(load) == 24 and {r["law"] for r in got} == {"bytes"}
    again = QUERIES["op5_sharding"](spark, DATA).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, again), key=str)


def test_targets_stop_at_twice_the_size():
    got = mixing.source_targets([("c", 10), (None, 1000), ("a", 100), ("b", 500)])
    assert [g[0] for g in got] == ["a", "b", "c", None]
    assert got[0][2] == 200 and got[2][2] == 20 and sum(g[2] for g in got) == pytest.approx(1.5 * 1610)
    assert got[1][2] * 3 == pytest.approx(got[3][2])  # weights 1 and 3
    assert mixing.source_targets([]) == [] and mixing.source_targets([("a", 0)])[0][2] == 0


def test_mix_of_odd_rows(spark):
    docs = frame(spark)
    got = mixing.mix(docs).collect()
    assert len(got) == docs.count()
    sizes = defaultdict(int)
    for r in rows():
        sizes[r[3]] += len((r[1] or "").split())
    targets = {t: size for _, size, t in mixing.source_targets(list(sizes.items()))}
    taken = defaultdict(int)
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["target"]] += r["taken"]
    assert all(abs(taken[t] - t) <= 0.5 for t in targets)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs).collect()))
    assert mixing.mix(frame(spark, empty=True)).count() == 0


def test_mixed_documents(spark):
    docs = frame(spark)
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    got = out.groupBy("doc_id", "text").count().collect()
    assert max(r["count"] for r in got if r["doc_id"] != 7) <= 2
    assert {r["doc_id"] for r in got} >= {1, 2, 3}  # without words


def test_equal_roots_stand_for_equal_texts():
    texts = ["", "\n", "a", "a.b", "a.\nb", "a\nb", "a\n\nb", "a b", "ab"]
    roots = {merkle.tree(t.encode()).digest for t in texts}
    assert len(roots) == len(texts) and merkle.tree(b"a.b") == merkle.tree(b"a.b")


@settings(max_examples=100, deadline=None)
@given(st.text("ab.,\n ", max_size=200), st.text("ab.,\n ", max_size=200))
def test_likeness(a, b):
    x, y = merkle.tree(a.encode()), merkle.tree(b.encode())
    value = merkle.likeness(x, y)
    assert 0 <= value <= 1 and (value == 1 or a != b) and value == merkle.likeness(y, x)
    assert merkle.likeness(x, x) == 1


def test_edits_are_located():
    lines = [f"Paragraph {i} has a few words, and some more. Then it ends." for i in range(40)]
    before = "\n".join(lines).encode()
    lines[17] = lines[17].replace("some more", "much less")
    after = "\n".join(lines).encode()
    spans = merkle.edits(merkle.tree(before), merkle.tree(after))
    changed = before.index(b"some more", before.index(b"Paragraph 17"))
    assert spans and all(a < b for a, b in spans) and any(a <= changed < b for a, b in spans)
    assert sum(b - a for a, b in spans) < 200


def unchanged(a: bytes, b: bytes) -> float:
    """Share of bytes in an alignment of the two texts."""
    return SequenceMatcher(None, a, b, autojunk=False).ratio()


def test_likeness_follows_the_bytes_left_unchanged():
    rnd = random.Random(8)
    line = lambda n: bytes(rnd.choice(b"abcdefghijklmnopqrstuvwxyz   ") for _ in range(n))
    short, long = line(140), bytes(rnd.choice(b"abcdefghij") for _ in range(4000))
    cases = [(short, short[:100]), (short, short[:70] + b"\n" + short[70:]), (long, long[:9] + b"zz" + long[9:])]
    for n in (300, 900, 2500):
        text = b"\n".join(line(rnd.randrange(20, 200)) for _ in range(n // 100))
        at = rnd.randrange(len(text) // 2)
        cases += [(text, text[:at] + text[at + 60 :]), (text, text[:at] + line(50) + text[at:]), (text, text[: len(text) // 2] + line(len(text) // 2))]
    assert all(merkle.likeness(merkle.tree(a), merkle.tree(b)) > 0.5 for a, b in cases[:3])
    for a, b in cases:
        found = merkle.likeness(merkle.tree(a), merkle.tree(b))
        assert found == merkle.likeness(merkle.tree(b), merkle.tree(a))
        lost = 200 / (len(a) + len(b))  # an edit touches the phrases around it, in both texts
        assert unchanged(a, b) - 0.1 - lost < found <= unchanged(a, b) + 0.02, (len(a), len(b), found, unchanged(a, b))
    assert merkle.likeness(merkle.tree(line(500)), merkle.tree(line(500))) < 0.1


def test_phrases_are_the_text_and_are_cut_by_content():
    for _, text in pairs():
        root = merkle.tree(text.encode())
        lines = [p for s in root.children for p in s.children]
        assert sum(p.weight for p in lines) == len(text.encode()) + 1
        assert [sum(x.weight for x in p.children) for p in lines] == [len(x) for x in text.encode().split(b"\n")]
    text = pairs()[4][1].encode()
    ends = merkle.phrase_ends(text)
    assert [e + 7 for e in ends if e > 4] == [e for e in merkle.phrase_ends(b"another" + text) if e > 11]
    assert 12 < len(text) / len(ends) < 48


def expected_fingerprints(found):
    ordered = sorted(found, key=lambda r: (r[0] is not None, r[0] or 0), reverse=True)
    out = []
    for (i, t), (_, follows) in zip(ordered, [*ordered[1:], ordered[0]]):
        half = len(t) // 2
        edited = t[: len(t) - half] + follows[:half]
        trees = [merkle.tree(x.encode()) for x in (t, edited, follows)]
        likeness = merkle.likeness(*trees[:2]), merkle.likeness(trees[0], trees[2])
        out.append((i, len(t), sha256(edited.encode()).hexdigest(), trees[0].digest.hex(), trees[1].digest.hex(), *likeness))
    return out


def test_merkle_query(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    got = QUERIES["op6_merkle"](spark, DATA).collect()
    assert sorted(map(tuple, got)) == sorted(expected_fingerprints([(r[0], r[1] or "") for r in docs]))


def test_next_row_over_partitions(spark):
    seen = merkle.with_next(frame(spark), lambda a, b: (a, b), "text string, follows string").collect()
    found = sorted((t for _, t in pairs()), key=str)
    assert sorted(r["text"] for r in seen) == found and sorted(r["follows"] for r in seen) == found
    ids = {r["doc_id"]: r["follows"] for r in seen}
    by_id = dict(pairs())
    assert ids[16] == by_id[15] and ids[2] is not None
    single = frame(spark).where("doc_id = 4")
    assert [tuple(r) for r in merkle.with_next(single, lambda a, b: (a, b), "text string, follows string").collect()] == [(4, "ab", "ab")]
    assert merkle.with_next(frame(spark, empty=True), lambda a, b: (a,), "text string").count() == 0
    assert merkle.fingerprints(frame(spark)).count() == len(pairs())
