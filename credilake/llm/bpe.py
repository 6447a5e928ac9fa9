"""BPE encoding in linear time by backtracking over longest matches, and decoding by an offset table."""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from credilake.llm.base import keyed, sliced

#: White space as the vocabulary's normalizer knows it.
BLANKS = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"

#: Stands behind the last character of a word while the word is encoded; no byte is written this way.
END = "\x00"

#: Code points that newer Unicode versions class as letters and the vocabulary's library as symbols.
LATER_LETTERS = (
    "\\u0558\\u058b-\\u058c\\u088f\\u0c5c\\u0cdc\\u208f\\u209d-\\u209f\\ua7ce-\\ua7cf\\ua7d2\\ua7d4\\ua7dd\\ua7e2\\ua7f1"
    "\\uab6c-\\uab6d\\U000107bb-\\U000107bf\\U00010940-\\U00010959\\U00010ec5-\\U00010ec7\\U00010ed9-\\U00010eee"
    "\\U00011b0a\\U00011db0-\\U00011ddb\\U00011df1\\U00016ea0-\\U00016eb8\\U00016ebb-\\U00016ed3\\U00016ff2-\\U00016ff3"
    "\\U000187f8-\\U000187ff\\U00018cd6-\\U00018cda\\U00018d09-\\U00018d20\\U00018d80-\\U00018df2\\U00018e00-\\U00019191"
    "\\U000191a0-\\U000191d2\\U0001b123-\\U0001b128\\U0001b168\\U0001d6a6\\U0001df1f-\\U0001df24\\U0001df2b-\\U0001df81"
    "\\U0001df90-\\U0001df96\\U0001dfcd-\\U0001dfff\\U0001e6c0-\\U0001e6de\\U0001e6e0-\\U0001e6e2\\U0001e6e4-\\U0001e6e5"
    "\\U0001e6e7-\\U0001e6ed\\U0001e6f0-\\U0001e6f4\\U0001e6fe-\\U0001e6ff\\U0002b73a-\\U0002b73f\\U0002b81e"
    "\\U0002cea2-\\U0002cead\\U000323b0-\\U00033479\\U0003d000-\\U0003fc3f"
)

#: The same for numbers.
LATER_NUMBERS = "\\U00011de0-\\U00011de9\\U0001246f\\U00012475-\\U0001247f\\U00012550-\\U00012686\\U00016ff4-\\U00016ff6"

#: Marks that the library's composition does not know: it neither reorders nor composes across them.
LATER_MARKS = (
    "\\u07fd\\u0898-\\u089f\\u08ca-\\u08d3\\u09fe\\u0c3c\\u0d3b-\\u0d3c\\u0eba\\u1715\\u1abf-\\u1ace\\u1df6-\\u1dfa\\ua82c"
    "\\U00010d24-\\U00010d27\\U00010eab-\\U00010eac\\U00010efd-\\U00010eff\\U00010f46-\\U00010f50\\U00010f82-\\U00010f85"
    "\\U00011070\\U0001133b\\U0001145e\\U00011839-\\U0001183a\\U00011930\\U0001193d-\\U0001193e\\U00011943\\U000119e0"
    "\\U00011a34\\U00011a47\\U00011a99\\U00011d42\\U00011d44-\\U00011d45\\U00011d97\\U00011f41-\\U00011f42"
    "\\U00016ff0-\\U00016ff1\\U0001e08f\\U0001e130-\\U0001e136\\U0001e2ae\\U0001e2ec-\\U0001e2ef\\U0001e4ec-\\U0001e4ef"
)

#: Capitals that the library lowers and this Python may not know yet.
LATER_CAPITALS = {
    0x1C89: 0x1C8A,
    0xA7CB: 0x0264,
    0xA7CC: 0xA7CD,
    0xA7CE: 0xA7CF,
    0xA7D2: 0xA7D3,
    0xA7D4: 0xA7D5,
    0xA7DA: 0xA7DB,
    0xA7DC: 0x019B,
    **{c: c + 32 for c in range(0x10D50, 0x10D66)},
    **{c: c + 27 for c in range(0x16EA0, 0x16EB9)},
}

#: Distinct words and characters of words that a worker remembers; the memory is started anew when it is full.
REMEMBERED = 300_000
REMEMBERED_CHARS = 64_000_000


def byte_letters() -> list[str]:
    """The printable character by which byte-level vocabularies write each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    letters = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [letters[b] for b in range(256)]


class Bpe:
    """A vocabulary of the word-end kind, made from the text of its ``tokenizer.json``."""

    def __init__(self, config: str):
        spec = json.loads(config)
        model = spec["model"]
        suffix = model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        names = {i: t for t, i in [*model["vocab"].items(), *self.special.items()]}
        size = max(names) + 1
        self.pair: dict[tuple[int, int], tuple[int, int]] = {}  # two tokens -> rank of their merge, merged token
        self.split: dict[int, tuple[int, int, int]] = {}  # token -> rank of the merge that makes it, its halves
        for rank, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            left, right, made = (model["vocab"][x] for x in (a, b, a + b))
            if (left, right) not in self.pair:
                self.pair[left, right] = rank, made
                self.split.setdefault(made, (rank, left, right))
        # tokens reach the automaton with END in place of the suffix
        self.automaton = ahocorasick.Automaton()
        for token, i in model["vocab"].items():
            form = token[: -len(suffix)] + END if token.endswith(suffix) and len(token) > len(suffix) else token
            self.automaton.add_word(form, (len(form), i))
        self.automaton.make_automaton()
        # decoding: tokens joined by one space, each written with the space behind it
        blob = [(names.get(i, "") + " ").encode() for i in range(size)]
        self.offsets = np.concatenate([[0], np.cumsum([len(x) for x in blob])]).astype(np.int64)
        self.blob = np.frombuffer(b"".join(blob), np.uint8)
        self.letters = {b: c for b, c in enumerate(byte_letters())}
        letter, number = r"\p{L}", r"\p{N}"
        known_letter, known_number = rf"[\p{{L}}--[{LATER_LETTERS}]]", rf"[\p{{N}}--[{LATER_NUMBERS}]]"
        words = "'s|'t|'re|'ve|'m|'ll|'d|[{0}]+|[{1}]|[^{2}{0}{1}]+"
        self.words = regex.compile(words.format(letter, number, BLANKS))
        self.words_of_rare = regex.compile("(?V1)" + words.format(known_letter, known_number, BLANKS))
        capitals = "".join(map(chr, LATER_CAPITALS))
        self.rare = regex.compile(f"[{LATER_LETTERS}{LATER_NUMBERS}{LATER_MARKS}{capitals}]")
        self.marks = regex.compile(f"([{LATER_MARKS}])")
        self.cut = regex.compile("|".join(regex.escape(s) for s in self.special)) if self.special else None
        self.known: dict[tuple[int, int], bool] = {}

    def compatible(self, left: int, right: int) -> bool:
        """Whether the merges leave ``left`` and ``right`` standing side by side.

        The seam is walked back in time: the later made of the two tokens at the seam is taken apart, until a
        merge across the seam is found that would have come first, or only letters are left.
        """
        key = left, right
        if (answer := self.known.get(key)) is not None:
            return answer
        bound = len(self.pair) + 1  # merges before this one are open at the seam
        bound_from_left = False
        answer = True
        while True:
            merge = self.pair.get((left, right))
            if merge and (merge[0] < bound or (merge[0] == bound and not bound_from_left)):
                answer = False
                break
            a, b = self.split.get(left), self.split.get(right)
            if not a and not b:
                break
            # of two halves made by the same merge the left one is made first, so the right one is undone first
            if not a or (b and b[0] >= a[0]):
                bound, bound_from_left, right = b[0], False, b[1]
            else:
                bound, bound_from_left, left = a[0], True, a[2]
        if len(self.known) > 4 * REMEMBERED:
            self.known.clear()
        self.known[key] = answer
        return answer

    def encode_word(self, word: str) -> list[int]:
        """Tokens of one word: longest match first, one step shorter where the pair would not have stood."""
        form = "".join(self.letters[b] for b in word.encode()) + END
        n = len(form)
        starting: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for end, match in self.automaton.iter(form):
            starting[end + 1 - match[0]].append(match)  # grows in length: matches come in the order of their ends
        dead = bytearray(n + 1)  # positions from which the end cannot be reached
        out: list[int] = []
        at, tried = 0, [len(starting[0])]
        lengths: list[int] = []
        while at < n:
            options, k = starting[at], tried[-1]
            while k:
                k -= 1
                length, token = options[k]
                if not dead[at + length] and (not out or self.compatible(out[-1], token)):
                    tried[-1] = k
                    out.append(token)
                    lengths.append(length)
                    at += length
                    tried.append(len(starting[at]) if at < n else 0)
                    break
            else:
                if not out:
                    raise ValueError("a byte is missing from the vocabulary")
                dead[at] = 1
                tried.pop()
                out.pop()
                at -= lengths.pop()
        return out

    def plain_pieces(self, text: str) -> list[str]:
        """Words of a text without special tokens; the few code points on which Unicode versions differ cost only the
        texts that hold them."""
        if text.isascii():
            return self.words.findall(text.lower())
        if not self.rare.search(text):
            return self.words.findall(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())  # no final sigma
        text = "".join(unicodedata.normalize("NFC", part) for part in self.marks.split(text))
        return self.words_of_rare.findall(text.replace("Σ", "σ").translate(LATER_CAPITALS).lower())

    def pieces(self, text: str) -> list[str | int]:
        """Words, and the ids of special tokens written out in the text."""
        if not self.cut or not self.cut.search(text):
            return self.plain_pieces(text)
        out: list[str | int] = []
        at = 0
        for m in self.cut.finditer(text):
            out += self.plain_pieces(text[at : m.start()])
            out.append(self.special[m.group()])
            at = m.end()
        return out + self.plain_pieces(text[at:])

    def encode(self, text: str) -> list[int]:
        return [i for p in self.pieces(text) for i in ([p] if isinstance(p, int) else self.encode_word(p))]

    def decode_all(self, ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """Texts of consecutive runs of ``ids``, whose ends are given: slices gathered through the offset table."""
        first, length = self.offsets[ids], self.offsets[ids + 1] - self.offsets[ids]
        stop = np.cumsum(length)
        buffer = self.blob[np.repeat(first - (stop - length), length) + np.arange(stop[-1] if len(stop) else 0)].tobytes()
        borders = np.r_[0, np.r_[0, stop][ends]]
        return [buffer[a : b - 1] if b > a else b"" for a, b in zip(borders[:-1], borders[1:])]

    def decode(self, ids: list[int]) -> str:
        return self.decode_all(np.asarray(ids, np.int64), np.asarray([len(ids)]))[0].decode()


@lru_cache(maxsize=2)
def _model(config: str) -> Bpe:
    return Bpe(config)


def _encoded(model: Bpe, memory: dict, all_texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of the texts one behind the other, and where each text ends. ``memory[None]`` counts the characters of
    the words in ``memory``."""
    flat: list[np.ndarray] = []
    ends = []
    total = 0
    for text in all_texts:
        found = model.pieces(text)
        if len(memory) > REMEMBERED or memory.get(None, 0) > REMEMBERED_CHARS:
            memory.clear()
        new = set(found).difference(memory)
        memory[None] = memory.get(None, 0) + sum(len(p) for p in new if isinstance(p, str))
        for piece in new:
            memory[piece] = np.asarray([piece] if isinstance(piece, int) else model.encode_word(piece), np.int32)
        own = [memory[p] for p in found]
        if own:
            own = np.concatenate(own)
            flat.append(own)
            total += len(own)
        ends.append(total)
    return np.concatenate(flat) if flat else np.empty(0, np.int32), np.asarray(ends, np.int64)


def encode_decode(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """``doc_id``, token ``ids`` (no special tokens added, no cut, no padding) and the text ``decoded`` from them.

    One pass without shuffle. The driver reads the vocabulary and sends it along (under 2 MB). A null or empty
    text has no tokens and decodes to an empty text; repeated rows and null ids are treated like any other;
    further columns are left out. Special tokens written out in a text are taken as these tokens.
    """
    with open(vocabulary_path, encoding="utf-8") as f:
        config = docs.sparkSession.sparkContext.broadcast(f.read())
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, memory = _model(config.value), {}
        for batch in sliced(batches, 256):
            ids, ends = _encoded(model, memory, batch.column("text").to_pylist())
            decoded = model.decode_all(ids, ends)
            yield pa.record_batch(
                [
                    batch.column("doc_id"),
                    pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pa.array(ids)),
                    pa.array(decoded, pa.binary()).cast(pa.string()),
                ],
                schema=schema,
            )

    return keyed(docs).mapInArrow(run, "doc_id long, ids array<int>, decoded string")
