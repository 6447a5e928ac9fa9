"""Small frames with the odd cases that every text operator must handle."""

import random

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, "
    # names that operators use themselves
    "row string, key string, size string, shard string, score string, fp string, spans string, doc string, "
    "node string, part string, n_lines string, at string, target string, ids string, words string, other string"
)
EXTRA = len(SCHEMA.split(", ")) - 5

LINE = "One line that many of these texts hold in common."


def words(seed: int, n: int) -> str:
    rnd = random.Random(seed)
    return " ".join("".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 7))) for _ in range(n))


def rows():
    long = words(1, 9000)
    base = words(2, 150)
    texts = [
        (1, None), (2, ""), (3, " \t\n\n "), (4, "ab"), (5, long), (6, base), (7, base), (7, base), (8, base + " end"),
        (None, base), (None, words(3, 40)), (9, f"x\n{LINE}\ny"), (10, f"{LINE}\n{LINE}"), (11, f"  {LINE.upper()} \nz"),
        (11, f"{LINE}\nanother text by the same id"), (12, words(4, 300)), (-5, words(4, 299)), (13, "Ünï ß " * 80),
        (14, base[:500] + "ζ" + base[500:]), (15, "\U0001f600" * 30), (16, words(5, 60) + "\n\n" + words(6, 70)),
    ]
    sources = ["b", None, "a", "ä", "", "b", "b"]
    return [
        (i, t, "en" if n % 3 else None, sources[n % len(sources)], None if n % 4 else 3, *["clash"] * EXTRA)
        for n, (i, t) in enumerate(texts)
    ]


def frame(spark, empty: bool = False):
    return spark.createDataFrame([] if empty else rows(), SCHEMA)


def pairs():
    """id and text with null as empty."""
    return [(r[0], r[1] or "") for r in rows()]
