"""Personal data: base patterns, and an offset-preserving deobfuscation that adds disguised cases.

Base spans are leftmost non-overlapping matches of fixed patterns, each kind by itself. Transducers
then normalise look-alike characters, spelled digits, invisible characters and at/dot disguises
while they keep, for every normalised character, the source characters that it came from. The same
patterns run over the normalised text, and what they find is mapped back to the source. A found
span is added if a disguise is part of it and it overlaps no base span of its kind.

Offsets are code points, ends exclusive. A null or empty text has no spans. Texts are searched as
wholes; the work is linear in their length. Repeated rows each get their result; other columns are
left alone. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int]

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: Matches of the ip pattern begin where a run of digits does, since they take whole runs.
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")


def emails(text: str) -> Iterator[Span]:
    """Every match holds one @; the part before it starts where the run of its characters does, or the last match ended."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at)):
            done = m.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def luhn(digits: str) -> bool:
    twice = (sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (sum(map(int, digits[-1::-2])) + sum(twice)) % 10 == 0


def find(text: str) -> dict[str, list[Span]]:
    """The base patterns' spans by kind."""
    out: dict[str, list[Span]] = {"email": list(emails(text)) if "@" in text else [], "ip": [], "card": [], "phone": []}
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                out["ip"].append(m.span())
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 13 and 13 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
                out["card"].append(m.span())
        if "+" in text:
            for m in PHONE.finditer(text):
                if 9 <= len(DIGIT.findall(m[0])) <= 15:
                    out["phone"].append(m.span())
    return out


#: Letters of other scripts that look like Latin ones, in pairs.
LOOK_ALIKES = (
    "АA ВB ЕE ЅS ІI ЈJ КK МM НH ОO РP СC ТT УY ХX аa сc еe ѕs іi јj оo рp уy хx һh ԁd ԛq ԝw "
    "ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX οo νv αa ρp ιi κk υu ɡg ɑa ıi օo ոn ѵv ꞏ. ․. 。. ∙. "
    "‐- ‑- ‒- –- —- −- ﹣- ⁃-"
)
#: Names of digits.
DIGIT_WORDS = {
    w: str(i)
    for i, words in enumerate((
        "zero oh null cero zéro", "one eins uno un", "two zwei dos deux", "three drei tres trois", "four vier cuatro quatre",
        "five fünf cinco cinq", "six sechs seis", "seven sieben siete sept", "eight acht ocho huit", "nine neun nueve neuf",
    ))
    for w in words.split()
}
_WORD = "|".join(sorted(DIGIT_WORDS, key=len, reverse=True))
HIDDEN = "­​‌‍⁠﻿"
_AT, _DOT = r"at|arroba|arobase", r"dot|punto|punkt|point"
#: A quick look for what the transducers rewrite. Of spelled digits it takes what SPELLED_RUN and edits() do:
#: two in a run, with numbers, dots and dashes between them, and the run's separators.
TRIGGER = re.compile(rf"[{HIDDEN}]|[\[({{<]\s?(?:{_AT}|@|{_DOT}|\.)\s?[\])}}>]|(?<!\w)(?:{_WORD})[ ,().-]{{1,3}}(?:(?:[0-9]+|{_DOT}|dash)[ ,().-]{{1,3}})*(?:{_WORD})(?!\w)|\b(?:{_AT}|{_DOT})\b", re.I)
SEPARATED = re.compile(r"\d(?:[\s.-]?\d)+")
BRACKET_AT = re.compile(rf"\s?[\[({{<]\s?(?:{_AT}|@)\s?[\])}}>]\s?", re.I)
BRACKET_DOT = re.compile(rf"\s?[\[({{<]\s?(?:{_DOT}|\.)\s?[\])}}>]\s?", re.I)
#: A spelled at counts only before a name with a spelled dot, or after a name that no sentence would hold: see spelled_at().
SPELLED_AT = re.compile(rf"(?<=[A-Za-z0-9])\s(?:{_AT})\s(?=[A-Za-z0-9-]+(?:\s(?:{_DOT})\s[A-Za-z0-9-]+|\.[A-Za-z0-9-]+\s(?:{_DOT})\s))|(?P<plain>(?<=[A-Za-z0-9._%+-])\s(?:{_AT})\s(?=[A-Za-z0-9-]+\.[A-Za-z0-9-]+))", re.I)
SPELLED_DOT = re.compile(rf"(?<=[A-Za-z0-9])\s(?:{_DOT})\s(?=[A-Za-z0-9])", re.I)
SPELLED_RUN = re.compile(rf"(?<!\w)(?:plus\s)?(?:(?:{_WORD}|[0-9]+|{_DOT}|dash)(?:[ ,().-]{{1,3}}|(?!\w)))+", re.I)
IN_RUN = re.compile(rf"(?P<digit>\b(?:{_WORD})\b)|(?P<dot>\s?\b(?:{_DOT})\b\s?)|(?P<dash>\s?\bdash\b\s?)|(?P<plus>\bplus\b\s?)|(?P<gap>[ ,-]+)", re.I)


@cache
def look_alikes() -> tuple[dict[int, str], np.ndarray]:
    """One character for one: the pairs above, and what Unicode calls compatible with one ASCII character (wide forms, digits in circles, mathematical letters)."""
    table = {}
    for c in range(0x80, 0x1FBFA):
        if not 0xD800 <= c < 0xE000:
            d = unicodedata.normalize("NFKC", chr(c))
            if len(d) == 1 and " " < d < "\x7f":
                table[c] = d
            elif unicodedata.category(chr(c)) == "Nd":
                table[c] = str(unicodedata.digit(chr(c)))
    table |= {ord(pair[0]): pair[1] for pair in LOOK_ALIKES.split()}
    table.pop(ord("ª"), None), table.pop(ord("º"), None)
    known = np.zeros(0x110000, bool)
    known[list(table)] = True
    return table, known


def spelled_at(text: str, m: re.Match) -> bool:
    """Before a plain name, the part before a spelled at has to hold a digit or a sign; a dot or dash at
    its edges may be a sentence's."""
    if m["plain"] is None:
        return True
    start = m.start()
    while start and text[start - 1] in LOCAL:
        start -= 1
    return any(not c.isalpha() for c in text[start : m.start()].strip(".-"))


def edits(text: str) -> list[tuple[int, int, str]]:
    """(start, end, replacement) of the rewriting transducers, in order and without overlaps."""
    found = [(m.start(), m.end(), "") for m in re.finditer(f"[{HIDDEN}]+", text)]
    found += [(*m.span(), "@") for m in BRACKET_AT.finditer(text)]
    found += [(*m.span(), ".") for m in BRACKET_DOT.finditer(text)]
    found += [(*m.span(), "@") for m in SPELLED_AT.finditer(text) if spelled_at(text, m)]
    spelled_dots = [(*m.span(), ".") for m in SPELLED_DOT.finditer(text)]
    for m in SPELLED_RUN.finditer(text):
        run = m[0]
        digits = [d for d in IN_RUN.finditer(run) if d["digit"]]
        if len(digits) < 2:
            continue
        for x in IN_RUN.finditer(run):
            a, b = x.start() + m.start(), x.end() + m.start()
            if x["digit"]:
                found.append((a, b, DIGIT_WORDS[x["digit"].lower()]))
            elif x["dot"]:
                found.append((a, b, "."))
            elif x["dash"]:
                found.append((a, b, "-"))
            elif x["plus"]:
                found.append((a, b, "+"))
            elif a > m.start() and b < m.end():
                found.append((a, b, ""))
    found += spelled_dots
    out: list[tuple[int, int, str]] = []
    for e in sorted(found, key=lambda e: (e[0], -e[1])):
        if not out or e[0] >= out[-1][1]:
            out.append(e)
    return out


class Normalised:
    """A text after the transducers, with the way back."""

    def __init__(self, text: str):
        self.changed: list[int] = []  # source positions of look-alikes, then normalised positions of all changes
        self.altered: list[int] = []
        source = text
        if not text.isascii():
            table, known = look_alikes()
            self.changed = np.flatnonzero(known[np.frombuffer(text.encode("utf-32-le"), "<u4")]).tolist()
            if self.changed:
                text = text.translate(table)
        parts, self.starts, self.origins, at, made = [], [0], [(0, 0, True)], 0, 0
        for a, b, new in edits(text) if TRIGGER.search(text) else ():
            for piece, origin in ((text[at:a], (at, a, True)), (new, (a, b, False))):
                if piece:
                    self.starts.append(made)
                    self.origins.append(origin)
                    parts.append(piece)
                    made += len(piece)
            self.altered.append(made - len(new) if new else made)
            at = b
        self.starts.append(made)
        self.origins.append((at, len(text), True))
        parts.append(text[at:])
        self.text = "".join(parts)
        self.changed = sorted(self.altered + [self.forth(c) for c in self.changed])
        self.same = self.text == source

    def back(self, start: int, end: int) -> Span:
        """Source span of a normalised one."""
        i, j = bisect_right(self.starts, start) - 1, bisect_right(self.starts, end - 1) - 1
        (a, _, plain), (b, stop, also) = self.origins[i], self.origins[j]
        return a + (start - self.starts[i] if plain else 0), b + end - self.starts[j] if also else stop

    def forth(self, at: int) -> int:
        """Normalised position of a source one that no edit covers."""
        k = bisect_right(self.origins, at, key=lambda o: o[0]) - 1
        return self.starts[k] + at - self.origins[k][0] if self.origins[k][2] else self.starts[k]

    def disguised(self, start: int, end: int) -> bool:
        """start and end are normalised positions."""
        k = bisect_right(self.changed, start - 1)
        return k < len(self.changed) and self.changed[k] < end


def search(text: str | None) -> tuple[dict[str, list[Span]], dict[str, list[Span]]]:
    """Base spans, and all spans with those that the transducers add."""
    text = text or ""
    base = find(text)
    norm = Normalised(text)
    if norm.same:
        return base, base
    every = {}
    for kind, spans in find(norm.text).items():
        new = (norm.back(*s) for s in spans if norm.disguised(*s))
        new = [s for s in new if s not in base[kind] and all(s[1] <= b[0] or s[0] >= b[1] or s[0] <= b[0] and b[1] <= s[1] for b in base[kind])]
        every[kind] = sorted(base[kind] + new)
    return base, every


def joined(spans: dict[str, list[Span]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind in KINDS for a, b in spans[kind])


def redact(text: str, spans: dict[str, list[Span]]) -> str:
    """The text with each span, or group of overlapping spans, replaced by the kind of its first."""
    parts, at = [], 0
    for a, b, kind in sorted((a, -b, k) for k in KINDS for a, b in spans[k]):
        if a >= at:
            parts += [text[at:a], f"<{kind.upper()}>"]
        at = max(at, -b)
    return "".join([*parts, text[at:]])


def detect(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256 (of the base spans, joined),
    spans (all, joined as kind:start:end), n_added (spans that the transducers add)."""
    kind = docs.schema[doc_id].dataType.simpleString()
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for t in batch["text"]:
                base, every = search(t.as_py())
                counts = [len(base[k]) for k in KINDS]
                rows.append((*counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(every), sum(map(len, every.values())) - sum(counts)))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *map(pa.array, zip(*rows, strict=True))] if rows else [batch["doc_id"], *(pa.array([], t) for t in (*[pa.int64()] * 4, pa.string(), pa.string(), pa.int64()))], names=names)

    schema = f"doc_id {kind}, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string, n_added long"
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)


def redacted(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows with every span in the text replaced by its kind; a null text stays null."""

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else redact(t, search(t)[1]))

    return docs.withColumn(text, clean(text))
