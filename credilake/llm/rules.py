"""Quality rules: a table of thresholds compiled into one projection of built-in functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credilake.llm.base import SPACE

#: Frequent words of the four languages; a text in which none of them is frequent is not prose.
STOP_WORDS = (
    "the of and to a in is it that for on with as was be by this are not "
    "et de la le les des du en un une que qui dans pour par sur pas est "
    "der die das und den von zu mit sich ist im dem nicht ein eine "
    "el los las y se del con una su al lo como"
).split()

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

#: measure -> lowest and highest value that a kept text may have; None where a side is open.
THRESHOLDS: dict[str, tuple[float | None, float | None]] = {
    "mean_word_length": (2.5, 12.0),
    "symbols_per_char": (None, 0.03),
    "shouts_per_word": (None, 0.10),
    "stop_word_share": (0.05, None),
    "dup_line_share": (None, 0.60),
}


def counted(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the counts that the rules rest on, one row per row of ``docs``.

    A null or empty text has no words and only zeros; a null ``doc_id`` stays null; repeated rows stay
    repeated; other columns are left out. Windows of three words are sorted inside the row, so that equal ones
    become neighbours: n log n in the words of a text, and no shuffle.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    words = F.array_remove(F.split(text, f"{SPACE}+"), "")
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), words.alias("words"))
    n = F.size("words")
    lines = F.filter(F.split("text", "\n"), lambda line: F.length(F.btrim(line, F.lit(" \t\n\x0b\f\r"))) > 0)
    df = df.select(
        "doc_id",
        n.cast("long").alias("n_words"),
        F.length(F.regexp_replace("text", f"{SPACE}+", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.regexp_replace("text", "[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        F.size(F.filter("words", lambda w: w.endswith("!!"))).alias("n_shouts"),
        F.size(F.filter("words", lambda w: w.isin(STOP_WORDS))).alias("n_stop"),
        lines.alias("lines"),
        F.sort_array(
            F.transform(
                F.slice(
                    F.arrays_zip(
                        F.col("words").alias("a"),
                        F.slice("words", 2, F.greatest(n, F.lit(1))).alias("b"),
                        F.slice("words", 3, F.greatest(n, F.lit(1))).alias("c"),
                    ),
                    1,
                    F.greatest(n - 2, F.lit(0)),
                ),
                lambda x, i: F.struct(F.concat_ws(" ", x["a"], x["b"], x["c"]).alias("w"), i.alias("at")),
            )
        ).alias("windows"),
    )
    twice = F.filter(
        "windows",
        lambda x, i: (x["w"] == F.get("windows", i - 1)["w"]) | (x["w"] == F.get("windows", i + 1)["w"]),
    )
    df = df.withColumn("starts", F.sort_array(F.transform(twice, lambda x: x["at"])))
    # each start adds what its three words reach beyond the words covered so far
    covered = F.aggregate(
        "starts",
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda acc, at: F.struct(
            (acc["n"] + at + 3 - F.greatest(acc["end"], at)).alias("n"), (at + 3).alias("end")
        ),
        lambda acc: acc["n"],
    )
    return df.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_shouts",
        "n_stop",
        F.size("lines").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        covered.cast("long").alias("n_repeat_words"),
    )


def measures() -> dict[str, Column]:
    """The ratios named in ``THRESHOLDS``; of nothing they are zero."""
    ratio = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    return {
        "mean_word_length": ratio("word_chars", "n_words"),
        "symbols_per_char": ratio("n_symbols", "word_chars"),
        "shouts_per_word": ratio("n_shouts", "n_words"),
        "stop_word_share": ratio("n_stop", "n_words"),
        "dup_line_share": ratio("n_dup_lines", "n_lines"),
    }


def verdict(thresholds: dict[str, tuple[float | None, float | None]]) -> Column:
    """True where every measure lies within its limits."""
    at = measures()
    tests = [
        at[name] >= F.lit(low) if side == 0 else at[name] <= F.lit(high)
        for name, (low, high) in thresholds.items()
        for side in (0, 1)
        if (low, high)[side] is not None
    ]
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def apply_rules(docs: DataFrame, thresholds: dict[str, tuple[float | None, float | None]] | None = None) -> DataFrame:
    """Counts, ``base_failed`` and ``kept`` of every document; nulls, ties and repeats as in ``counted``."""
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return (
        counted(docs)
        .withColumn("base_failed", base)
        .withColumn("kept", ~base & verdict(THRESHOLDS if thresholds is None else thresholds))
    )
