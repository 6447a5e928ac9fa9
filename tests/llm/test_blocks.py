"""Substring dedup by blocks against every window of every text."""

import random
from collections import Counter

import numpy as np
import pytest
from text_cases import EXTRA, SCHEMA, frame, pairs, rows

from credilake.llm import blocks


def brute(texts, window):
    split = [t.encode().split() for t in texts]
    times = Counter(tuple(w[i : i + window]) for w in split for i in range(len(w) - window + 1))
    out = []
    for w in split:
        gone = {j for i in range(len(w) - window + 1) if times[tuple(w[i : i + window])] > 1 for j in range(i, i + window)}
        out.append((len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return out


def found(df, window):
    got = blocks.remove_repeats(df, window).collect()
    order = lambda i: (i is not None, i or 0)
    return sorted((order(r["doc_id"]), r["n_words"], sum(s["b"] - s["a"] for s in r["removed"]), r["kept"]) for r in got)


def expected(texts, window):
    order = lambda i: (i is not None, i or 0)
    return sorted((order(i), *b) for (i, _), b in zip(texts, brute([t for _, t in texts], window)))


@pytest.mark.parametrize(("window", "chunk", "bucket"), [(35, 1 << 12, 1 << 12), (1, 1 << 9, 1 << 11), (2, 1 << 20, 1 << 20), (8, 1 << 9, 1 << 30)])
def test_removes_what_every_window_says(spark, monkeypatch, window, chunk, bucket):
    monkeypatch.setattr(blocks, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(blocks, "BUCKET_BYTES", bucket)
    rnd = random.Random(window)
    base = [f"{rnd.choice('abc')}{rnd.randrange(9)}" for _ in range(400)]
    more = []
    for i in range(50):
        a = rnd.randrange(350)
        parts = base[a : a + rnd.randrange(60)], [str(rnd.random()) for _ in range(rnd.randrange(40))], base[a // 2 : a // 2 + rnd.randrange(50)]
        more.append((100 + i, "\n".join(" ".join(p) for p in parts)))
    df = spark.createDataFrame(rows() + [(*m, None, None, None, *["x"] * EXTRA) for m in more], SCHEMA).repartition(5)
    assert found(df, window) == expected(pairs() + more, window)


def test_hot_passage_in_every_text_and_one_very_long_text(spark):
    passage = " ".join(f"p{i}" for i in range(40))
    texts = [(i, f"a{i} {passage} b{i} {passage}") for i in range(300)] + [(999, " ".join(f"w{i % 5000}" for i in range(20_000)))]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(7)
    assert found(df, 35) == expected(texts, 35)


def test_empty_table_and_spans(spark):
    assert blocks.remove_repeats(frame(spark, empty=True)).collect() == []
    text = " ".join(f"w{i}" for i in range(50))
    df = spark.createDataFrame([(1, text), (2, f"x {text}"), (3, "w0 w1")], "doc_id long, text string")
    spans = {r["doc_id"]: [(s["a"], s["b"]) for s in r["removed"]] for r in blocks.remove_repeats(df).collect()}
    assert spans == {1: [(0, 50)], 2: [(1, 51)], 3: []}


def test_window_hashes_tell_windows_apart():
    words = np.asarray([random.Random(i % 97).getrandbits(64) for i in range(500)], np.uint64)
    for width in (1, 2, 3, 18, 35):
        h = blocks.window_hashes(words, width)
        assert len(h) == 500 - width + 1
        assert (h[:97] == h[97:194]).all() and len(set(h.tolist())) == 97
