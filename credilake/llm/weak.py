"""Quality classifier without labels: heuristic labellers, their accuracies by EM, and a hashed linear scorer."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credilake.llm.base import sliced, texts
from credilake.llm.rules import STOP_WORDS

#: Documents the scorer is fitted on, about; all others are only scored. Votes are counted over all documents.
TRAIN_ROWS = 4000
TRIGRAM_SLOTS = 1 << 12
MEASURE_SLOTS = 1 << 8
THRESHOLD = 0.5

_STOP = frozenset(w.encode() for w in STOP_WORDS)
_UPPER = bytes(range(65, 91))
_LETTERS = _UPPER + bytes(range(97, 123))
_SYMBOLS = b"#*$%&|<>"


@dataclass(slots=True)
class Measures:
    """What the labellers look at; shares of nothing are zero."""

    n_words: int
    symbols: float
    capitals: float
    shouts: float
    stop: float
    fresh: float
    doubled: float
    word_length: float
    bars: float
    stops: float

    def shares(self) -> tuple[float, ...]:
        return (
            self.symbols, self.capitals, self.shouts, self.stop, 1 - self.fresh, self.doubled, self.bars, self.stops,
            self.word_length / 20, min(1.0, self.n_words / 400),
        )


def measure(text: bytes) -> Measures:
    words = text.split()
    n = len(words)
    if not n:
        return Measures(0, *[0.0] * 9)
    chars = sum(map(len, words))
    letters = len(text) - len(text.translate(None, _LETTERS))
    windows = max(1, n - 2)
    return Measures(
        n,
        (len(text) - len(text.translate(None, _SYMBOLS))) / chars,
        (len(text) - len(text.translate(None, _UPPER))) / max(1, letters),
        text.count(b"!!") / n,
        sum(w in _STOP for w in words) / n,
        len(set(zip(words, words[1:], words[2:]))) / windows if n > 2 else 1.0,
        sum(map(eq, words, words[1:])) / n,
        chars / n,
        words.count(b"|") / n,
        (text.count(b".") + text.count(b",")) / n,
    )


BAD, NONE, GOOD, SILENT = range(4)


def _rule(enough: int, bad: Callable[[Measures], bool], good: Callable[[Measures], bool] | None = None):
    """A labeller that is silent on texts of fewer than ``enough`` words."""

    def vote(m: Measures) -> int:
        if m.n_words < enough:
            return SILENT
        return BAD if bad(m) else GOOD if good and good(m) else NONE

    return vote


#: They overlap, and none is right everywhere. NONE is an opinion of its own: the symptom is missing. A SILENT
#: labeller says nothing at all, so that a text too short to be judged keeps the odds of all documents.
LABELLERS: dict[str, Callable[[Measures], int]] = {
    "symbols": _rule(1, lambda m: m.symbols > 0.05),
    "capitals": _rule(4, lambda m: m.capitals > 0.5),
    "shouts": _rule(1, lambda m: m.shouts > 0.1),
    "bars": _rule(1, lambda m: m.bars > 0.05),
    "stop_words": _rule(30, lambda m: m.stop < 0.06, lambda m: m.stop > 0.15),
    "fresh_windows": _rule(6, lambda m: m.fresh < 0.5, lambda m: m.fresh > 0.8),
    "doubled_words": _rule(4, lambda m: m.doubled > 0.15),
    "word_length": _rule(6, lambda m: not 2.5 <= m.word_length <= 10),
    "sentence_marks": _rule(30, lambda m: m.stops < 0.02, lambda m: 0.05 < m.stops < 0.4),
}


def votes_code(m: Measures) -> int:
    """All votes as one number in base 4."""
    code = 0
    for vote in LABELLERS.values():
        code = 4 * code + vote(m)
    return code


def votes_of(codes: np.ndarray) -> np.ndarray:
    """Votes, a row per code."""
    k = len(LABELLERS)
    return codes[:, None] // 4 ** np.arange(k - 1, -1, -1) % 4


@dataclass
class LabelModel:
    """Share of good documents, and for either class how often each labeller, if not silent, votes bad, none, good."""

    good: float
    table: np.ndarray  # class, labeller, vote

    def posterior(self, codes: np.ndarray) -> np.ndarray:
        """Probability of a good document behind each code."""
        votes = votes_of(codes)
        at = np.arange(votes.shape[1])
        spoken = votes != SILENT
        log = [(np.log(self.table[c, at, np.minimum(votes, GOOD)]) * spoken).sum(axis=1) for c in (0, 1)]
        odds = log[1] - log[0] + math.log(self.good) - math.log(1 - self.good)
        return 1 / (1 + np.exp(-np.clip(odds, -50, 50)))


def fit_labels(codes: np.ndarray, counts: np.ndarray, rounds: int = 200, tolerance: float = 1e-9) -> LabelModel:
    """Expectation maximisation over the counts of vote patterns, begun at the balance of the votes."""
    votes = votes_of(codes)
    p = 1 / (1 + np.exp(6.0 * (votes == BAD).sum(axis=1) - 2.0 - 2.0 * (votes == GOOD).sum(axis=1)))
    total = max(1, counts.sum())
    model = LabelModel(0.5, np.full((2, votes.shape[1], 3), 1 / 3))
    for _ in range(rounds):
        before = p
        weight = np.stack([(1 - p) * counts, p * counts])
        table = np.stack([[(weight * (votes[:, j] == v)).sum(axis=1) for v in range(3)] for j in range(votes.shape[1])])
        table = table.transpose(2, 0, 1) + 1.0  # one vote of each kind to begin with
        table /= table.sum(axis=2, keepdims=True)
        good = float(np.clip((weight[1].sum() + 1) / (total + 2), 1e-6, 1 - 1e-6))
        model = LabelModel(good, table)
        p = model.posterior(codes)
        if np.abs(p - before).max(initial=0) < tolerance:
            break
    return model


def features(text: bytes, m: Measures) -> np.ndarray:
    """Hashed byte trigrams (logarithms of counts, scaled to length one) and hashed steps of the measures."""
    x = np.zeros(TRIGRAM_SLOTS + MEASURE_SLOTS, np.float32)
    b = np.frombuffer(text, np.uint8).astype(np.uint32)
    if len(b) > 2:
        h = (b[:-2] * np.uint32(0x9E3779B1) ^ b[1:-1] * np.uint32(0x85EBCA77) ^ b[2:] * np.uint32(0xC2B2AE3D)) >> np.uint32(20)
        counts = np.log1p(np.bincount(h, minlength=TRIGRAM_SLOTS))
        x[:TRIGRAM_SLOTS] = counts / np.sqrt((counts * counts).sum())
    for i, share in enumerate(m.shares()):
        step = min(15, int(16 * share**0.5))
        x[TRIGRAM_SLOTS + (16 * i + step) % MEASURE_SLOTS] = 1.0
    return x


@dataclass
class Scorer:
    weights: np.ndarray
    bias: float

    def score(self, x: np.ndarray) -> float:
        return float(1 / (1 + math.exp(-max(-50.0, min(50.0, float(x @ self.weights) + self.bias)))))


def fit_scorer(x: np.ndarray, y: np.ndarray, rounds: int = 300, rate: float = 0.05, decay: float = 1e-4) -> Scorer:
    """Logistic regression on soft labels by full gradients with moment estimates; both classes weigh the same."""
    w, b = np.zeros(x.shape[1], np.float32), 0.0
    if not len(x):
        return Scorer(w, 0.0)
    weight = np.where(y > 0.5, 0.5 / max(1e-9, (y > 0.5).mean()), 0.5 / max(1e-9, (y <= 0.5).mean())).astype(np.float32)
    m1, m2 = np.zeros(len(w) + 1, np.float64), np.zeros(len(w) + 1, np.float64)
    for i in range(1, rounds + 1):
        error = (1 / (1 + np.exp(-np.clip(x @ w + b, -50, 50))) - y) * weight
        gradient = np.append(x.T @ error.astype(np.float32) / len(x) + decay * w, error.mean())
        m1 = 0.9 * m1 + 0.1 * gradient
        m2 = 0.999 * m2 + 0.001 * gradient**2
        step = rate * (m1 / (1 - 0.9**i)) / (np.sqrt(m2 / (1 - 0.999**i)) + 1e-8)
        w = (w - step[:-1]).astype(np.float32)
        b -= float(step[-1])
    return Scorer(w, b)


@dataclass
class QualityModel:
    labels: LabelModel
    scorer: Scorer


def _text_only(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def fit(docs: DataFrame, train_rows: int = TRAIN_ROWS) -> QualityModel:
    """Label model from the votes on all documents, scorer from about ``train_rows`` of them.

    The driver gets one row per vote pattern (at most 4 to the number of labellers) and the features of the
    sample, which is chosen by a hash of the text, so that reruns agree and copies are taken or left together.
    """

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            codes = pa.array([votes_code(measure(t)) for t in texts(batch)], pa.int32())
            yield pa.record_batch([codes, batch.column("pick")], names=["code", "pick"])

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 64):
            found = [(t, measure(t)) for t in texts(batch)]
            yield pa.record_batch(
                [
                    batch.column("pick"),
                    pa.array([votes_code(m) for _, m in found], pa.int32()),
                    pa.array([features(t, m).astype(np.float16).tobytes() for t, m in found], pa.binary()),
                ],
                names=["pick", "code", "x"],
            )

    rows = _text_only(docs).withColumn("pick", F.pmod(F.xxhash64("text", F.lit(5)), F.lit(1 << 20)))
    patterns = rows.mapInArrow(vote, "code int, pick long").groupBy("code").agg(F.count(F.lit(1)).alias("n")).collect()
    codes = np.asarray([r["code"] for r in patterns], np.int64)
    counts = np.asarray([r["n"] for r in patterns], np.float64)
    labels = fit_labels(codes, counts)
    # the share goes by different texts, so that a table of copies gives as large a sample as any other
    distinct = rows.agg(F.approx_count_distinct(F.xxhash64("text"), 0.02)).first()[0]
    share = F.col("pick") < F.lit(min(1 << 20, (train_rows << 20) // max(1, distinct)))
    # copies of one text are one row of the sample, so a large group of them neither fills nor misses it
    chosen = rows.where(share).dropDuplicates(["text"]).mapInArrow(describe, "pick long, code int, x binary")
    sample = sorted((r["pick"], r["code"], bytes(r["x"])) for r in chosen.collect())
    x = np.stack([np.frombuffer(s[2], np.float16) for s in sample]).astype(np.float32) if sample else np.zeros((0, TRIGRAM_SLOTS + MEASURE_SLOTS), np.float32)
    y = labels.posterior(np.asarray([s[1] for s in sample], np.int64)) if sample else np.zeros(0)
    return QualityModel(labels, fit_scorer(x, y))


def judge(docs: DataFrame, model: QualityModel) -> DataFrame:
    """The columns of ``docs`` with ``weak_label`` (probability of good by the labellers) and ``score`` (by the
    scorer), one row per row, without shuffle. Null and empty texts are scored like any other; columns of
    ``docs`` by these two names are replaced. The model (under 40 KB) goes along with the task."""
    columns = [c for c in docs.columns if c not in ("weak_label", "score")]
    rows = docs.select(*columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            found = [(t, measure(t)) for t in texts(batch)]
            weak = model.labels.posterior(np.asarray([votes_code(m) for _, m in found], np.int64))
            scores = [model.scorer.score(features(t, m)) for t, m in found]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(weak, pa.float64()), pa.array(scores, pa.float64())],
                names=[*batch.schema.names, "weak_label", "score"],
            )

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, fields + ", weak_label double, score double")


def good_documents(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that a model fitted on ``docs`` scores at ``threshold`` or more."""
    return judge(docs, fit(docs)).where(F.col("score") >= threshold).select(*docs.columns)
