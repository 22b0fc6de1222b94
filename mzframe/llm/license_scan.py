"""License scans: MinHash over overlapping windows retrieves templates, exact containment verifies.

A text is a sequence of shingles of five words (lower case, without punctuation at their ends); for
a template of fewer words, of as many words as it has.
Each template has a window size: `span` is the power of two that is at least 1.25 times its number
of shingles, and windows are two spans long at steps of one span, so that any run of up to one span
lies whole in a window. Every window has one minimum for each of `bands` hash functions, and each
minimum is a band of its own, looked up in a table from (band, minimum) to templates: a template that a window contains to the threshold has a Jaccard
similarity to it of at least threshold / (1 + 2 * 2.5 - threshold), 0.15 at 0.8, so that it is
retrieved with a probability of at least 1 - (1 - 0.15) ** bands, 0.9994 for 44 bands, and more
for the usual whole copy. What is retrieved is verified: the share of the template's distinct
shingles that the window holds must reach the threshold. A template of fewer than five words is one
shingle; its windows are one shingle long, so that one band retrieves it always.

Templates are a list that is a parameter, sent to executors with the code; texts are scanned as
wholes, in parts that overlap by two windows, without any shuffle.

Defined results: null and empty texts have no match, nor has a text of fewer words than a template's
shingle with that template; templates without words are refused. Matches of one template that overlap are one.
Repeated rows each get their result, and ids may be null; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

WORDS = 5
PART = 8_192
ORDER = itemgetter(1, 2, 0)
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], "uint64")
PUNCTUATION = "".join(map(chr, range(33, 48))) + ":;<=>?@[\\]^_`{|}~“”‘’«»©®"


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Words:
    """Hashes of words; the memo is bounded. A word that is nothing but punctuation has none."""

    def __init__(self) -> None:
        import xxhash

        self.hash, self.memo = xxhash.xxh64_intdigest, {}

    def of(self, word: str) -> int:
        bare = word.strip(PUNCTUATION)
        if len(self.memo) >= 300_000:
            self.memo.clear()
        h = self.memo[word] = (self.hash(bare.encode("utf-8", "replace")) or 1) if bare else 0
        return h

    def hashes(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """The hashes of the words that have one, in order, and their positions among the text's words."""
        memo, of = self.memo, self.of
        x = np.array([memo[w] if w in memo else of(w) for w in (text or "").lower().split()], "uint64")
        at = np.flatnonzero(x)
        return x[at], at

    def shingles(self, text: str | None, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
        """The shingles in order, and the position among the text's words of each word that has a hash."""
        x, at = self.hashes(text)
        return shingled(x, words), at


def shingled(x: np.ndarray, words: int) -> np.ndarray:
    """The shingles of so many words, from the words' hashes."""
    n = len(x) - words + 1
    if n <= 0:
        return np.zeros(0, "uint64")
    total = np.zeros(n, "uint64")
    for k in range(words):
        total += x[k : k + n] * _MULTIPLIERS[k]
    return _mix(total)


class BandTable:
    """From a band's minimum to the templates that have it, whatever their number."""

    def __init__(self, signatures: list[np.ndarray]):
        keys = np.concatenate([x.reshape(-1) for x in signatures])
        owners = np.repeat(np.arange(len(signatures)), len(signatures[0]))
        order = np.argsort(keys, kind="stable")
        self.keys, self.owners = keys[order], owners[order]
        bits = max(12, len(keys).bit_length() + 6)
        self.mask = np.uint64((1 << bits) - 1)
        self.some = np.zeros(1 << bits, bool)  # most minima are no template's; their low bits tell
        self.some[keys & self.mask] = True

    def lookup(self, minima: np.ndarray) -> list[tuple[int, int]]:
        """(window, template) of the columns that share a band with a template, each once, in order."""
        _, windows = at = np.nonzero(self.some[minima & self.mask])
        if not len(windows):
            return []
        asked = minima[at]
        low, high = np.searchsorted(self.keys, asked), np.searchsorted(self.keys, asked, "right")
        return sorted({(w, k) for w, a, b in zip(windows.tolist(), low.tolist(), high.tolist(), strict=True) for k in self.owners[a:b].tolist()})


class Scanner:
    """Scans for templates by shingles of one length. If that is less than WORDS, each template has to be one shingle."""

    def __init__(self, templates: Mapping[str, str], threshold: float, bands: int, length: int = WORDS):
        self.words, self.threshold, self.length = Words(), threshold, length
        bands = bands if length == WORDS else 1
        rng = np.random.default_rng(17)
        self.factors = (rng.integers(0, 1 << 63, bands, dtype="uint64") * np.uint64(2) + np.uint64(1))[:, None]
        self.salts = rng.integers(0, 1 << 63, bands, dtype="uint64")[:, None]
        self.by_span: dict[int, list[tuple[str, np.ndarray, np.ndarray]]] = {}
        for name, text in templates.items():
            s = np.unique(self.words.shingles(text, length)[0])
            if not len(s):
                raise ValueError(f"template {name} has fewer than {length} words")
            if length < WORDS and len(s) > 1:
                raise ValueError(f"template {name} has more than {length} words")
            span = 1 << max(2, int(np.ceil(np.log2(1.25 * len(s))))) if length == WORDS else 1
            self.by_span.setdefault(span, []).append((name, s, (s[None, :] * self.factors).min(1)))
        self.spans = sorted(self.by_span)
        self.tables = {span: BandTable([m[:, None] + self.salts for _, _, m in held]) for span, held in self.by_span.items()}

    def windows(self, shingles: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """For each span, the minima of all windows: one row per hash function, one column per step."""
        hashed = shingles[None, :] * self.factors
        top = np.uint64(0xFFFFFFFFFFFFFFFF)
        size = 1
        for span in self.spans:
            k = span // size
            if pad := -hashed.shape[1] % k:
                hashed = np.concatenate([hashed, np.full((len(hashed), pad), top)], axis=1)
            hashed = hashed.reshape(len(hashed), -1, k).min(2)
            size = span
            if span == 1:
                yield span, hashed
                continue
            after = np.concatenate([hashed[:, 1:], np.full((len(hashed), 1), top)], axis=1)
            yield span, np.minimum(hashed, after)

    def scan(self, text: str | None) -> list[tuple[str, int, int, float]]:
        """(template, first word, end word, containment), in order; words are counted by white space."""
        return sorted(self.matches(*self.words.hashes(text)), key=ORDER)

    def matches(self, hashes: np.ndarray, at: np.ndarray) -> list[tuple[str, int, int, float]]:
        """The same for a text's words, not in order."""
        shingles = shingled(hashes, self.length)
        found: dict[str, list[tuple[int, int, float]]] = {}
        longest = 2 * self.spans[-1] if self.spans else 1
        step = -(-PART // longest) * longest
        for start in range(0, len(shingles), step):
            part = shingles[start : start + step + longest]
            for span, minima in self.windows(part):
                for w, k in self.tables[span].lookup(minima + self.salts):
                    name, s, _ = self.by_span[span][k]
                    a = w * span
                    window = part[a : a + (2 * span if span > 1 else 1)]
                    held = np.isin(window, s)
                    share = len(np.unique(window[held])) / len(s)
                    if share >= self.threshold:
                        where = np.flatnonzero(held) + a + start
                        found.setdefault(name, []).append((int(at[where[0]]), int(at[where[-1] + self.length - 1]) + 1, share))
        out = []
        for name, spans in found.items():
            merged: list[tuple[int, int, float]] = []
            for a, b, share in sorted(spans):
                if merged and a < merged[-1][1]:
                    merged[-1] = (merged[-1][0], max(b, merged[-1][1]), max(share, merged[-1][2]))
                else:
                    merged.append((a, b, share))
            out += [(name, *m) for m in merged]
        return out


class Scanners:
    """A scanner for each shingle length: five words, or all words of a template that has fewer."""

    def __init__(self, templates: Mapping[str, str], threshold: float, bands: int):
        self.words = Words()
        lengths: dict[int, dict[str, str]] = {}
        for name, text in templates.items():
            if not (n := len(self.words.hashes(text)[0])):
                raise ValueError(f"template {name} has no words")
            lengths.setdefault(min(n, WORDS), {})[name] = text
        self.scanners = [Scanner(t, threshold, bands, n) for n, t in sorted(lengths.items())]

    def scan(self, text: str | None) -> list[tuple[str, int, int, float]]:
        """As a scanner's."""
        hashes, at = self.words.hashes(text)
        return sorted((m for s in self.scanners for m in s.matches(hashes, at)), key=ORDER)


def scan(docs: DataFrame, templates: Mapping[str, str], threshold: float = 0.8, bands: int = 44, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_matches, licenses (distinct names before the colon, sorted and joined by blanks),
    matches (array of template, first_word, end_word, containment)."""
    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"doc_id {kind}, n_matches long, licenses string, matches array<struct<template: string, first_word: int, end_word: int, containment: double>>"
    fields = list(to_arrow_schema(StructType.fromDDL(schema)))[1:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanners(templates, threshold, bands)
        for batch in batches:
            found = [scanner.scan(t.as_py()) for t in batch["text"]]
            columns = ([len(f) for f in found], [" ".join(sorted({m[0].partition(":")[0] for m in f})) for f in found], [[{"template": n, "first_word": a, "end_word": b, "containment": c} for n, a, b, c in f] for f in found])
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *(pa.array(c, f.type) for c, f in zip(columns, fields, strict=True))], names=["doc_id", *(f.name for f in fields)])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)
