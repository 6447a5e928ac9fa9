"""BPE against the library that the vocabulary was made for."""

import json
import random
from hashlib import sha256

import duckdb
import pytest
from text_cases import frame, pairs
from tokenizers import Tokenizer

from credilake.llm import bpe
from credilake.llm.queries import QUERIES, vocabulary_path


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(vocabulary_path())


@pytest.fixture(scope="module")
def model():
    with open(vocabulary_path(), encoding="utf-8") as f:
        return bpe.Bpe(f.read())


def test_random_words_are_encoded_like_the_library(model, library):
    rnd = random.Random(3)
    alphabets = ["ab", "aé !'", "the in at on er re", "<|startoftext|>s", "'st reΣς İ1٣", "aaaa", "\x00a\x85 b", "漢字かな"]
    for _ in range(3000):
        letters = rnd.choice(alphabets)
        text = "".join(rnd.choice(letters) for _ in range(rnd.randint(0, 30)))
        ids = library.encode(text, add_special_tokens=False).ids
        assert model.encode(text) == ids, text
        assert model.decode(ids) == library.decode(ids, skip_special_tokens=False), text


@pytest.mark.parametrize("form", ["a%sa", "!%s1", "A%s\u0301", "A%s\u0323", "a\u0345%s"])
def test_every_code_point_is_encoded_like_the_library(model, library, form):
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for k in range(0, len(points), 50_000):
        texts = [form.replace("%s", chr(c)) for c in points[k : k + 50_000]]
        wrong = [
            ascii(text)
            for text, found in zip(texts, library.encode_batch(texts, add_special_tokens=False))
            if model.encode(text) != found.ids
        ]
        assert not wrong


def test_marks_and_letters_in_random_order(model, library):
    rnd = random.Random(4)
    letters = "aAeĀ\u0301\u0323\u0345\u07fd\u0898\u0c3c\u1abf\U00011935\U00011930\u1c89\ua7cb\u0558\u208f가ᄀ\u1161\u11a8"
    for _ in range(5000):
        text = "".join(rnd.choice(letters) for _ in range(rnd.randint(0, 12)))
        assert model.encode(text) == library.encode(text, add_special_tokens=False).ids, ascii(text)


def test_long_words_leave_the_memory(model, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED_CHARS", 100)
    memory = {}
    for c in "abcdef":
        bpe._encoded(model, memory, [c * 90])
        assert memory[None] <= 190
        assert sum(len(w) for w in memory if isinstance(w, str)) == memory[None]


def test_special_tokens_in_a_text(model, library):
    text = "a<|endoftext|>b <|startoftext|><|ENDOFTEXT|> c"
    assert model.encode(text) == library.encode(text, add_special_tokens=False).ids


def test_compatible_is_what_merging_by_rank_leaves(model):
    with open(vocabulary_path(), encoding="utf-8") as f:
        spec = json.load(f)["model"]
    ranks = {tuple(m.split(" ") if isinstance(m, str) else m): r for r, m in enumerate(spec["merges"])}

    def merged(parts):
        while (best := min((ranks.get(p, len(ranks)) for p in zip(parts, parts[1:])), default=len(ranks))) < len(ranks):
            parts = _apply(parts, by_rank[best])
        return parts

    by_rank = list(ranks)
    rnd = random.Random(5)
    tokens = [t for t in spec["vocab"] if not t.endswith("</w>") and len(t) < 6]
    for _ in range(3000):
        a, b = rnd.choice(tokens), rnd.choice(tokens)
        assert model.compatible(spec["vocab"][a], spec["vocab"][b]) == (merged(list(a + b)) == [a, b])


def _apply(parts, pair):
    """The merge of a pair wherever it stands, from the left."""
    out, i = [], 0
    while i < len(parts):
        hit = tuple(parts[i : i + 2]) == pair
        out.append("".join(pair) if hit else parts[i])
        i += 1 + hit
    return out


def test_frame(spark, library):
    got = bpe.encode_decode(frame(spark), vocabulary_path()).collect()
    expected = []
    for i, t in pairs():
        ids = library.encode(t, add_special_tokens=False).ids
        expected.append((i, ids, library.decode(ids, skip_special_tokens=False)))
    order = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted((tuple(r) for r in got), key=order) == sorted(expected, key=order)
    assert bpe.encode_decode(frame(spark, empty=True), vocabulary_path()).count() == 0


def test_query(spark, library):
    docs = duckdb.sql("SELECT doc_id, coalesce(text, '') FROM '/root/testdata/sf0.001/documents.parquet'").fetchall()
    got = {r["doc_id"]: tuple(r) for r in QUERIES["op1_bpe"](spark, "/root/testdata/sf0.001").collect()}
    for i, t in docs:
        ids = library.encode(t, add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        digests = sha256(" ".join(map(str, ids)).encode()).hexdigest(), sha256(decoded.encode()).hexdigest()
        assert got[i] == (i, len(ids), *digests)
