"""Quality classifier from weak labels.

Heuristic labellers vote good (1), bad (-1) or abstain (0) on every text. Expectation-maximisation
over the counts of vote patterns of all documents estimates each labeller's accuracy and the share
of good texts; a document's posterior follows from its votes. A linear scorer over hashed words and
word shapes is trained on the posteriors of a bounded sample and scores every whole text.

The pattern counts are at most 3 to the power of the number
of labellers, whatever the input, so the driver may hold them. The scorer's sample is at most
`sample_docs` documents, each of at most `dimensions` values.

Defined results: a null or empty text gets the votes of an empty one (bad by length) and is scored
by the bias alone. A very long text is counted as a whole. Ties at the threshold are kept. Repeated
rows each get their result, and ids may be null; an empty table gives an empty result; other columns
are left alone.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import islice
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Frequent words of the four languages.
STOP_WORDS = (
    "a", "al", "and", "as", "au", "avec", "be", "by", "con", "das", "de", "del", "dem", "den", "der", "des", "die",
    "du", "el", "ein", "eine", "en", "es", "et", "for", "from", "in", "is", "ist", "it", "la", "las", "le", "les",
    "los", "mit", "nicht", "of", "on", "or", "para", "pas", "por", "pour", "que", "qui", "se", "sich", "su", "sur",
    "that", "the", "this", "to", "un", "una", "und", "une", "von", "was", "with", "zu",
)


NAMES = ("symbols", "bars", "capitals", "shouts", "stop_words", "variety", "lines", "sentences", "word_length", "digits", "length", "echoes", "top_word")
_STOP = frozenset(STOP_WORDS)
_SYMBOLS, _BARS, _SHOUTS, _ENDS, _DIGITS = b"#$%&*@^~_", b"|{}<>=", b"!?", b".!?", b"0123456789"
_CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def labellers(text: str, words: Counter, echoes: int) -> tuple[int, ...]:
    """The votes on a text whose words are counted, echoes of them the same as the word before, in the order of NAMES. Thresholds are shares of characters or words."""
    raw = text.encode("utf-8", "replace")
    count = lambda chars: len(raw) - len(raw.translate(None, chars))
    vote = lambda bad, good: -1 if bad else 1 if good else 0
    n, size, lines = max(1, words.total()), max(1, len(text)), text.split("\n")
    symbols, bars, capitals, shouts, digits = map(count, (_SYMBOLS, _BARS, _CAPITALS, _SHOUTS, _DIGITS))
    stops = sum(k for w, k in words.items() if w.lower() in _STOP)
    fresh = len(set(lines)) / len(lines)
    return (
        vote(symbols > 0.1 * size, symbols < 0.03 * size),
        vote(bars > 0.15 * n, bars < 0.02 * n),
        vote(capitals > 0.3 * size, capitals < 0.1 * size),
        vote(shouts > 0.3 * n, shouts < 0.1 * n),
        vote(n >= 20 and stops < 0.03 * n, stops > 0.08 * n),
        vote(n >= 100 and len(words) < 0.25 * n, n >= 30 and len(words) > 0.35 * n),
        vote(len(lines) >= 4 and fresh < 0.6, fresh > 0.8),
        vote(n >= 40 and count(_ENDS) < 0.005 * n, count(b".") > 0.02 * n),
        vote(size > 14 * n or size < 3 * n, 4 * n <= size <= 10 * n),
        vote(digits > 0.25 * size, digits < 0.05 * size),
        vote(n < 5, n >= 20),
        vote(n >= 10 and echoes > 0.15 * n, echoes < 0.03 * n),
        vote(n >= 20 and max(words.values()) > 0.25 * n, n >= 20 and max(words.values()) < 0.2 * n),
    )


@dataclass
class LabelModel:
    """chances: probability of each vote (bad, abstain, good) by class (bad, good) and labeller."""

    chances: np.ndarray
    prior: float

    def weights(self) -> np.ndarray:
        """Log odds of good that a vote adds, by labeller and vote; abstaining adds none, and no vote counts against its own meaning."""
        w = np.log(self.chances[1] / self.chances[0])
        return np.stack([np.minimum(w[:, 0], 0), np.zeros(len(w)), np.maximum(w[:, 2], 0)], axis=1)

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """Probability of good for each row of votes."""
        w = self.weights()
        odds = sum((w[j, votes[:, j] + 1] for j in range(len(w))), np.zeros(len(votes)))
        return 1 / (1 + np.exp(-np.clip(odds + math.log(self.prior / (1 - self.prior)), -50, 50)))

    def accuracy(self) -> np.ndarray:
        """Of each labeller, where it votes."""
        p = np.array([1 - self.prior, self.prior])
        right = p[0] * self.chances[0][:, 0] + p[1] * self.chances[1][:, 2]
        return right / (right + p[0] * self.chances[0][:, 2] + p[1] * self.chances[1][:, 0])


def fit_labels(patterns: list[tuple[tuple[int, ...], int]], labellers: int, rounds: int = 200) -> LabelModel:
    """EM over distinct vote patterns and their counts. It starts from texts without a bad vote as good."""
    model = LabelModel(np.full((2, labellers, 3), 1 / 3), 0.8)
    if not patterns:
        return model
    votes, n = np.array([p for p, _ in patterns]).reshape(-1, labellers), np.array([c for _, c in patterns], float)
    good = np.where((votes < 0).any(1), 0.1, 0.95)
    for _ in range(rounds):
        chances = np.empty((2, labellers, 3))
        for y, share in enumerate((1 - good, good)):
            for v in (-1, 0, 1):
                chances[y, :, v + 1] = (n * share) @ (votes == v) + (0.1 if v else 0.01) * n.sum() / 1000 + 1e-3
        model = LabelModel(chances / chances.sum(2, keepdims=True), float(np.clip((n @ good) / n.sum(), 0.01, 0.99)))
        old, good = good, model.posterior(votes)
        if np.abs(good - old).max() < 1e-9:
            break
    return model


_RUN = re.compile(r"(.)\1+")


class Features:
    """Hashed words and shapes of words with their neighbours; values are roots of relative counts."""

    def __init__(self, dimensions: int):
        self.dimensions, self.memo = dimensions, {}

    def of_word(self, word: str) -> tuple[int, str]:
        if (found := self.memo.get(word)) is None:
            shape = "".join("A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in word)
            if len(self.memo) >= 200_000:
                self.memo.clear()
            found = self.memo[word] = zlib.crc32(word.lower().encode()) % self.dimensions, _RUN.sub(r"\1", shape)[:12]
        return found

    def of(self, words: Counter) -> tuple[np.ndarray, np.ndarray]:
        counts: Counter = Counter()
        shapes: Counter = Counter()
        for word, k in words.items():
            hashed, shape = self.of_word(word)
            counts[hashed] += k
            shapes[shape] += k
        for shape, k in shapes.items():
            counts[zlib.crc32(b"shape:" + shape.encode()) % self.dimensions] += k
        keys, n = np.fromiter(counts.keys(), "int32", len(counts)), np.fromiter(counts.values(), "float64", len(counts))
        return keys, np.sqrt(n / max(1, words.total()))


def train(rows: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray, dimensions: int, rounds: int = 150, rate: float = 2.0, decay: float = 1e-5) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels, by full gradients with per-weight rates."""
    weights, bias = np.zeros(dimensions), 0.0
    if not rows:
        return weights, bias
    cols, vals = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows])
    at = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    seen = np.full(dimensions, 1e-8)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(np.bincount(at, weights[cols] * vals, len(rows)) + bias)))
        off = (p - target) / len(rows)
        g = np.bincount(cols, off[at] * vals, dimensions) + decay * weights
        seen += g * g
        weights -= rate * g / np.sqrt(seen) * 0.1
        bias -= rate * off.sum()
    return weights, bias


def _parts(text: str | None) -> tuple[Counter, tuple[int, ...]]:
    listed = (text or "").split()
    words, echoes = Counter(listed), sum(map(eq, listed, islice(listed, 1, None)))
    votes = labellers(text or "", words, echoes)
    if echoes:
        words["\n"] = echoes  # no word; it is hashed as a feature
    return words, votes


def count_patterns(docs: DataFrame, text: str = "text") -> list[tuple[tuple[int, ...], int]]:
    """Every vote pattern with the number of documents that have it; at most 3 to the power of the labellers."""

    def votes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()
        for batch in batches:
            seen.update(_parts(t)[1] for t in batch["text"])
        if seen:
            yield pd.DataFrame({"votes": [list(v) for v in seen], "n": list(seen.values())})

    counted = docs.select(F.col(text).alias("text")).mapInPandas(votes, "votes array<int>, n long").groupBy("votes").agg(F.sum("n").alias("n"))
    return sorted((tuple(r["votes"]), r["n"]) for r in counted.collect())


@dataclass
class Scorer:
    """A fitted model; it is sent to executors, where every task makes its own hashing memo."""

    model: LabelModel
    weights: np.ndarray
    bias: float

    def texts(self, features: Features, texts: Iterable[str | None]) -> tuple[list[tuple[int, ...]], np.ndarray]:
        """Votes and the probability of good for each text."""
        votes, logits = [], []
        for t in texts:
            words, cast = _parts(t)
            keys, values = features.of(words)
            votes.append(cast)
            logits.append(float(self.weights[keys] @ values) + self.bias)
        return votes, 1 / (1 + np.exp(-np.clip(logits, -50, 50)))


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", sample_docs: int = 4_000, dimensions: int = 1 << 14) -> Scorer:
    """EM over the vote patterns of all documents, then the linear scorer on a sample of at most sample_docs."""
    patterns = count_patterns(docs, text)
    model = fit_labels(patterns, len(NAMES))
    total = sum(n for _, n in patterns)

    rank = F.pmod(F.xxhash64(F.col(doc_id).cast("string"), F.lit(5)), F.lit(1 << 31))
    near = math.ceil((1 << 31) * min(1.0, 1.5 * sample_docs / max(total, 1) + 0.001))
    rows = docs.select(F.col(doc_id).cast("string").alias("id"), F.col(text).alias("text"), rank.alias("rank"))
    sample = rows.where(F.col("rank") < near).orderBy("rank", "id").limit(sample_docs)

    def featurise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        features = Features(dimensions)
        for batch in filter(len, batches):
            parts = list(map(_parts, batch["text"]))
            made = [features.of(words) for words, _ in parts]
            yield pd.DataFrame({"votes": [list(v) for _, v in parts], "keys": [k for k, _ in made], "values": [v for _, v in made]})

    got = sample.select("text").mapInPandas(featurise, "votes array<int>, keys array<int>, values array<double>").toPandas()
    target = model.posterior(np.array(list(got["votes"]), int).reshape(len(got), len(NAMES)))
    weights, bias = train([(np.asarray(k, "int64"), np.asarray(v, float)) for k, v in zip(got["keys"], got["values"], strict=True)], target, dimensions)
    return Scorer(model, weights, bias)


def classify(docs: DataFrame, scorer: Scorer, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """doc_id, votes (in the order of NAMES), posterior, score, kept: score is the linear scorer's probability of good."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(len(scorer.weights))
        for batch in filter(len, batches):
            votes, p = scorer.texts(features, batch["text"].to_pylist())
            posterior = scorer.model.posterior(np.array(votes, int).reshape(len(votes), len(NAMES)))
            columns = [batch["doc_id"], pa.array(votes, pa.list_(pa.int32())), pa.array(posterior), pa.array(p), pa.array(p >= threshold)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "votes", "posterior", "score", "kept"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(score, f"doc_id {kind}, votes array<int>, posterior double, score double, kept boolean")


def accepted(docs: DataFrame, scorer: Scorer, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows whose text scores at least the threshold, unchanged."""

    @F.pandas_udf("boolean")
    def good(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        features = Features(len(scorer.weights))
        for batch in batches:
            yield pd.Series(scorer.texts(features, batch)[1] >= threshold, dtype=bool)

    return docs.where(good(text))
