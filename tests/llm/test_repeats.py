"""Suffix-array dedup, line dedup and SimHash against brute force."""

from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from text_cases import EXTRA, SCHEMA, frame, pairs

from credilake.llm import lines, simhash, suffix
from credilake.llm.base import documents
from credilake.llm.queries import QUERIES

DATA = "/root/testdata/sf0.001"


def given_rows(spark, found):
    return spark.createDataFrame([(i, t, "en", "s", 1, *["x"] * EXTRA) for i, t in found], SCHEMA)


def some_documents(spark):
    return [(r["doc_id"], r["text"] or "") for r in documents(spark, DATA).select("doc_id", "text").collect()]


def removed_by_hand(found, length):
    texts = [t.encode() for _, t in found]
    seen = Counter(t[p : p + length] for t in texts for p in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for p in range(len(t) - length + 1):
            if seen[t[p : p + length]] > 1:
                gone[p : p + length] = True
        borders = np.flatnonzero(np.diff(np.r_[False, gone[:-1], False].astype(int)))
        spans = [tuple(x) for x in borders.reshape(-1, 2).tolist()]
        out.append((spans, bytes(np.frombuffer(t, np.uint8)[~gone[:-1]])))
    return out


def sort_key(r):
    return (r[0] is None, r[0] or 0, *map(str, r[1:]))


@pytest.mark.parametrize("length, seed", [(400, 128), (40, 16), (17, 8)])
def test_removed_bytes(spark, length, seed):
    found = pairs()
    got = suffix.remove_repeats(frame(spark), length, seed).collect()
    got = [(r["doc_id"], r["n_bytes"], [tuple(s) for s in r["removed"]], bytes(r["kept"])) for r in got]
    expected = [(i, len(t.encode()), *x) for (i, t), x in zip(found, removed_by_hand(found, length))]
    assert sorted(got, key=sort_key) == sorted(expected, key=sort_key)


def test_removed_bytes_of_large_groups(spark, monkeypatch):
    # a passage of 120 bytes with different surroundings, and one that is a byte too short
    found = [(i, f"{i:05d} " * 9 + "passage " * 8 + "p" * 56 + f" {i:07d}" * 9) for i in range(60)]
    found += [(100 + i, f"{i:04d} " * 9 + "q" * 99 + f" {i:06d}" * 9) for i in range(60)]
    expected = [(i, x[1]) for (i, _), x in zip(found, removed_by_hand(found, 100))]
    for most in (1024, 3):
        monkeypatch.setattr(suffix, "GROUP_CONTEXTS", most)
        got = suffix.remove_repeats(given_rows(spark, found), 100, 32).collect()
        assert sorted((r["doc_id"], bytes(r["kept"])) for r in got) == expected


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab", min_size=0, max_size=40), min_size=2, max_size=6))
def test_maximal_repeats_hold_all_occurrences(texts):
    length = 6
    anchored = [(t, p) for t in texts for p in range(len(t))]
    lefts, rights = [t[:p][::-1].encode() for t, p in anchored], [t[p:].encode() for t, p in anchored]
    found = list(suffix.maximal_repeats(lefts, rights, length))
    for left, right, members in found:
        whole = {lefts[i][:left][::-1] + rights[i][:right] for i in members}
        assert len(whole) == 1 and len(members) > 1 and left + right >= length
        piece = whole.pop()
        assert len(members) == sum(lefts[i][:left][::-1] + rights[i][:right] == piece for i in range(len(anchored)))
    pairs_met = {(a, b) for _, _, m in found for a in m for b in m if a < b}
    for a in range(len(anchored)):
        for b in range(a + 1, len(anchored)):
            reach = suffix.common_prefix(lefts[a], lefts[b]) + suffix.common_prefix(rights[a], rights[b])
            assert (reach >= length) == ((a, b) in pairs_met)


def test_suffix_query(spark):
    found = some_documents(spark)
    got = {r["doc_id"]: tuple(r) for r in QUERIES["op2_suffix_array"](spark, DATA).collect()}
    for (i, t), (spans, kept) in zip(found, removed_by_hand(found, 400)):
        n = sum(b - a for a, b in spans)
        assert got[i] == (i, len(t.encode()), n, len(spans), sha256(kept).hexdigest())


def lines_by_hand(found):
    holders = defaultdict(set)
    key = lambda line: "".join(c.lower() if c.isascii() else c for c in line.strip(" \t\n\x0b\f\r"))
    low = lambda i: -(1 << 63) if i is None else i
    for i, t in found:
        for line in t.split("\n"):
            if len(key(line)) >= 20:
                holders[key(line)].add(low(i))
    out = []
    for i, t in found:
        all_lines = t.split("\n")
        kept = [x for x in all_lines if len(holders[key(x)]) < 3 or max(holders[key(x)]) == low(i)]
        out.append((i, "\n".join(kept), len(all_lines), len(all_lines) - len(kept)))
    return out


@pytest.mark.parametrize("held", [50_000, 2])
def test_kept_lines(spark, monkeypatch, held):
    monkeypatch.setattr(lines, "HELD_ROWS", held)
    found = pairs() + [(20 + i, f"{t}\nshared by four or five texts\nshort") for i, (_, t) in enumerate(pairs()[:5])]
    got = [(r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in lines.dedup_lines(given_rows(spark, found)).collect()]
    assert sorted(got, key=sort_key) == sorted(lines_by_hand(found), key=sort_key)


def test_line_dedup_keeps_columns_and_empty_tables(spark):
    docs = frame(spark)
    out = lines.dedup_lines(docs)
    assert set(out.columns) == {*docs.columns, "n_dropped"} and out.count() == docs.count()
    assert out.where("doc_id = 1").first()["text"] is None
    assert lines.dedup_lines(frame(spark, empty=True)).count() == 0


def test_bitmaps_round_trip():
    for dropped, n in (([0], 1), ([3, 9], 10), ([7], 30), ([0, 1, 2], 3)):
        keep = lines.unpack(lines.pack(np.asarray(dropped)), n)
        assert len(keep) == n and np.flatnonzero(~keep).tolist() == dropped


def fingerprint_by_hand(text, k):
    from xxhash import xxh64_intdigest

    found = "".join(c.lower() if c.isascii() else c for c in text).encode().split()
    if not found:
        return 0
    shingles = [b" ".join(found[i : i + k]) for i in range(max(1, len(found) - k + 1))]
    hashes = [xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components_by_hand(fps, others, ids, distance, other_distance=64):
    parent = list(range(len(fps)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(fps)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= distance and (others[a] ^ others[b]).bit_count() <= other_distance:
                parent[root(a)] = root(b)
    least = defaultdict(list)
    for i in range(len(fps)):
        least[root(i)].append(ids[i])
    return [min((x for x in least[root(i)] if x is not None), default=None) for i in range(len(fps))]


@pytest.mark.parametrize("rows_per_shard, chunk", [(1024, 2048), (4, 3)])
def test_components(spark, monkeypatch, rows_per_shard, chunk):
    monkeypatch.setattr(simhash, "CHUNK_ROWS", chunk)
    monkeypatch.setattr(simhash, "VISITOR_ROWS", 4 * chunk)
    monkeypatch.setattr(simhash.close_pairs, "__defaults__", (*simhash.close_pairs.__defaults__[:-1], rows_per_shard))
    found = pairs() + [(200 + i, t) for i, t in some_documents(spark)]
    fps = [fingerprint_by_hand(t, 4) for _, t in found]
    ids = [i for i, _ in found]
    got = simhash.near_duplicates(given_rows(spark, found)).collect()
    expected = zip(ids, fps, components_by_hand(fps, [0] * len(fps), ids, 4))
    assert sorted(((r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in got), key=sort_key) == sorted(expected, key=sort_key)


def test_dense_groups_are_connected_by_few_links():
    rnd = np.random.default_rng(1)
    near = np.unique(np.uint64(12345) ^ (np.uint64(1) << rnd.integers(0, 24, (3000, 3)).astype(np.uint64)).sum(axis=1).astype(np.uint64))
    links = simhash.Links(near, near, 4, None)
    a, b = links.forest(len(near))
    assert len(a) < 8 * len(near) + 1000
    assert (np.bitwise_count(near[a] ^ near[b]) <= 4).all()
    ids = list(range(len(near)))
    expected = components_by_hand(near.tolist(), [0] * len(near), ids, 4)
    parent = dict(zip(ids, ids))
    for x, y in zip(a.tolist(), b.tolist()):
        while parent[x] != x:
            x = parent[x]
        while parent[y] != y:
            y = parent[y]
        parent[max(x, y)] = min(x, y)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    assert [root(i) for i in ids] == expected


def test_one_of_each_near_copy_stays(spark):
    found = pairs()
    docs = given_rows(spark, found)
    kept = sorted(simhash.one_of_each(docs).collect(), key=sort_key)
    prints = [simhash.fingerprint(t.encode()) for _, t in found]
    parts = {i: {i} for i in range(len(found))}
    for i in range(len(found)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= simhash.MAX_DISTANCE and parts[i] is not parts[j]:
                parts[i] |= parts[j]
                parts.update(dict.fromkeys(parts[j], parts[i]))
    least = {id(c): min((found[i][0] is None, found[i][0] or 0) for i in c) for c in parts.values()}
    ids = [(r["doc_id"] is None, r["doc_id"] or 0) for r in kept]
    assert sorted(ids) == sorted(least.values()) and set(docs.columns) == set(kept[0].asDict())
    assert simhash.one_of_each(frame(spark, empty=True)).count() == 0


def test_one_of_each_is_the_same_whatever_the_order(spark):
    rows = [(1, "same text here", str(i)) for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {simhash.one_of_each(docs.repartition(n)).first()["lang"] for n in (1, 3, 8)} == {"0"}


def test_one_of_each_component_stays_without_ids_or_with_one_id(spark):
    # six unrelated texts: three without id, two by one id, one alone; and a copy of one without id
    unrelated = [" ".join(f"{w}{i * j % 97}" for j in range(1, 60)) for i, w in enumerate("abcdef", 1)]
    found = [(None, unrelated[0]), (None, unrelated[1]), (None, unrelated[2]), (4, unrelated[3]), (4, unrelated[4])]
    found += [(5, unrelated[5]), (None, unrelated[5]), (None, unrelated[0]), (4, unrelated[3]), (6, unrelated[3])]
    kept = simhash.one_of_each(given_rows(spark, found)).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in kept), key=sort_key) == sorted(found[:6], key=sort_key)


def test_links_are_thinned_to_a_forest():
    a, b = simhash._thinned(np.asarray([3, 1, 2, 0, 5]), np.asarray([1, 2, 3, 3, 6]))
    assert list(zip(a.tolist(), b.tolist())) == [(3, 1), (1, 2), (0, 3), (5, 6)]
