"""URL filters: host word segmentation and multinomial naive Bayes.

A unigram model of the words in all pages splits concatenated host names by a Viterbi search; a
multinomial naive Bayes model over the words of host and path gives a verdict to every url that no
rule decides. Both models are tables that Spark counts over all rows, and stay whole: the substrings
of each distinct host label are joined to the words before its search, the tokens of each page to
the tokens' weights. Only totals reach the driver.

Defined results: a null url, and one without ``://``, has an empty host and path; no rule fits an
empty host, and the classifier then has no tokens, so that the prior decides. A very long url is judged by all of its words; a host label is split as a
whole, by words of up to 24 letters. An empty table gives an empty result. Repeated rows are each
judged, and ids may be null. Columns beside the id and url are ignored.
"""

from __future__ import annotations

import math
import re
import string
from collections import Counter
from collections.abc import Iterable, Iterator, Mapping
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mzframe.llm.common import materialize

#: Words that mark an unwanted site; rows whose tokens hold one train the block class.
SEED_WORDS = (
    "adult", "bet", "bets", "betting", "bonus", "casino", "cheap", "cialis", "crack", "deals",
    "escort", "farm", "free", "gambling", "hack", "jackpot", "loan", "loans", "lottery", "nude",
    "payday", "pharma", "pharmacy", "pill", "pills", "poker", "porn", "replica", "rx", "sex",
    "slots", "spam", "torrent", "viagra", "warez", "win", "xxx",
)
#: Of these, the ones that mark it by themselves; the others need a second one beside them.
STRONG_WORDS = frozenset(("casino", "cialis", "escort", "gambling", "payday", "pills", "poker", "porn", "slots", "spam", "viagra", "warez", "xxx"))
#: Host labels without a meaning of their own.
PLAIN_LABELS = frozenset(("www", "m", "com", "net", "org", "www2", "blog"))


#: Letters of the words that are counted.
SHORTEST, LONGEST = 2, 24


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def rule(verdict: str, where: str) -> Rule:
    """rule("block", "example.com/en/")"""
    host, slash, path = where.partition("/")
    if verdict not in ("allow", "block") or not host or not slash:
        raise ValueError(f"not a rule: {verdict} {where}")
    return Rule(verdict, host, slash + path)


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    rest = url.substr(F.length(F.substring_index(url, "://", 1)) + 4, F.length(url))
    host = F.when(F.instr(url, "://") > 0, F.regexp_extract(rest, r"^[^/?#]*", 0))
    return F.coalesce(F.translate(host, string.ascii_uppercase, string.ascii_lowercase), F.lit(""))


def url_path(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end; else empty."""
    rest = url.substr(F.length(F.substring_index(url, "://", 1)) + 4, F.length(url))
    return F.coalesce(F.when(F.instr(url, "://") > 0, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)), F.lit(""))


def longest_rule(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, as columns; null without one."""
    name = verdict = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == r.host) | host.endswith(f".{r.host}")) & path.startswith(r.path)
        name, verdict = F.when(fits, r.name).otherwise(name), F.when(fits, r.verdict).otherwise(verdict)
    return name, verdict


def cheapest_split(name: str, costs: Mapping[str, float], unknown: float) -> list[str]:
    """Words of the cheapest split; a character that no word covers is a word at the cost of an unknown one."""
    best: list[tuple[float, int]] = [(0.0, 0)]
    for end in range(1, len(name) + 1):
        options = [(best[end - 1][0] + unknown, end - 1)]
        for start in range(max(0, end - LONGEST), end):
            if (c := costs.get(name[start:end])) is not None:
                options.append((best[start][0] + c, start))
        best.append(min(options))
    words, end = [], len(name)
    while end:
        words.append(name[best[end][1] : end])
        end = best[end][1]
    return words[::-1]


@dataclass
class UrlModel:
    """words: (word, n), total: the sum of n and 1; tokens: (token, weight), the log odds of block."""

    words: DataFrame
    total: int
    prior: float = 0.0
    tokens: DataFrame | None = None
    unseen: float = 0.0

    def split(self, labels: DataFrame) -> DataFrame:
        """(part, words) for distinct runs of a-z in column part."""
        total, unknown = self.total, math.log(self.total) + 10
        size = F.length("part")
        starts = labels.select("part", F.explode(F.sequence(F.lit(1), size)).alias("start")).where(F.col("start") < size)
        ends = F.sequence(F.lit(SHORTEST), F.least(F.lit(LONGEST), size - F.col("start") + 1))
        known = starts.select("part", "start", F.explode(ends).alias("n_letters")).select("part", F.col("part").substr(F.col("start"), F.col("n_letters")).alias("word")).distinct()
        known = known.join(self.words, "word").groupBy("part").agg(F.collect_list("word").alias("known"), F.collect_list("n").alias("n"))

        def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                out = []
                for part, found, counts in zip(batch["part"], batch["known"], batch["n"], strict=True):
                    costs = {} if found is None else {w: math.log(total / n) for w, n in zip(found, counts, strict=True)}
                    out.append(cheapest_split(part, costs, unknown))
                yield batch[["part"]].assign(words=out)

        return labels.join(known, "part", "left").mapInPandas(search, "part string, words array<string>")

    def segment(self, name: str) -> list[str]:
        """The words of one run of a-z."""
        rows = self.split(self.words.sparkSession.createDataFrame([(name,)], "part string")).collect()
        return list(rows[0]["words"])

    def host_words(self, hosts: DataFrame) -> DataFrame:
        """(host, host_words) for each distinct host: the words of its labels, in order; digits become one token."""
        labels = F.filter(F.split("host", "[^a-z0-9]+"), lambda x: (x != "") & ~x.isin(*PLAIN_LABELS))
        parts = F.flatten(F.transform(labels, lambda x: F.regexp_extract_all(x, F.lit("[a-z]+|[0-9]+"), F.lit(0))))
        hosts = materialize(hosts.select("host").distinct().select("host", parts.alias("parts")), "hosts")
        placed = hosts.select("host", F.posexplode("parts").alias("at", "part"))
        letters = F.col("part").rlike("^[a-z]")
        split = materialize(self.split(placed.where(letters).select("part").distinct()), "splits")
        found = placed.where(letters).join(split, "part").select("host", "at", "words")
        found = found.unionByName(placed.where(~letters).select("host", "at", F.array(F.lit("<n>")).alias("words")))
        ordered = F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("at", "words"))), lambda x: x["words"]))
        words = found.groupBy("host").agg(ordered.alias("host_words"))
        return materialize(hosts.select("host").join(words, "host", "left").select("host", F.coalesce("host_words", F.array().cast("array<string>")).alias("host_words")), "host_words")


def url_tokens(host_words: Iterable[str], path: str) -> list[str]:
    """h:word for the words of host labels, p:word for those of the path; digits become one token."""
    parts = re.findall(r"[^\W\d_]+|\d+", path.lower())
    return ["h:" + w for w in host_words] + ["p:<n>" if p[0].isdigit() else "p:" + p for p in parts]


def seed_label(tokens: list[str]) -> int:
    words = {t[2:] for t in tokens}
    return int(bool(words & STRONG_WORDS) or len(words & set(SEED_WORDS)) > 1)


def count_words(texts: DataFrame, html: str = "html") -> DataFrame:
    """(word, n): words of a-z in the text between tags of all rows, 2 to 24 letters long."""
    plain = F.lower(F.regexp_replace(F.coalesce(F.col(html), F.lit("")), r"<[^>]*>", " "))
    words = texts.select(F.explode(F.split(plain, r"[^a-z]+")).alias("word"))
    return words.where(F.length("word").between(SHORTEST, LONGEST)).groupBy("word").agg(F.count("*").alias("n"))


def fit(pages: DataFrame, url: str = "url", html: str = "html") -> UrlModel:
    """Counts words over all pages for the segmenter, then tokens by seed label over all urls for the classifier."""
    spark = pages.sparkSession
    words = materialize(count_words(pages, html), "words")
    top = words.agg(F.max("n")).first()[0] or 1
    seeds = spark.createDataFrame([(w, top // 1000 + 1) for w in SEED_WORDS], "word string, n long")  # known words even where no page's text holds them
    words = materialize(words.where(~F.col("word").isin(*SEED_WORDS)).union(words.where(F.col("word").isin(*SEED_WORDS)).union(seeds).groupBy("word").agg(F.max("n").alias("n"))), "seeded")
    model = UrlModel(words, words.agg(F.sum("n")).first()[0] + 1)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()
        for batch in batches:
            for host_words, path in zip(batch["host_words"], batch["path"], strict=True):
                tokens = url_tokens(host_words, path)
                block = seed_label(tokens)
                seen[("", block)] += 1
                seen.update((t, block) for t in tokens)
            if len(seen) > 100_000:
                yield pd.DataFrame([(*k, v) for k, v in seen.items()], columns=["token", "block", "n"])
                seen.clear()
        yield pd.DataFrame([(*k, v) for k, v in seen.items()], columns=["token", "block", "n"])

    parts = pages.select(url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path"))
    parts = parts.join(model.host_words(parts), "host")
    table = parts.mapInPandas(count, "token string, block int, n long").groupBy("token").agg(F.sum(F.when(F.col("block") == 1, F.col("n")).otherwise(0)).alias("yes"), F.sum(F.when(F.col("block") == 0, F.col("n")).otherwise(0)).alias("no"))
    table = materialize(table, "tokens")
    prior = table.where("token = ''").first()
    table = table.where("token <> ''")
    sums = table.agg(F.count("*").alias("n"), F.sum("yes").alias("yes"), F.sum("no").alias("no")).first()
    yes, no = ((sums[k] or 0) + sums["n"] + 1 for k in ("yes", "no"))
    model.tokens = table.select("token", (F.log((F.col("yes") + 1) / yes) - F.log((F.col("no") + 1) / no)).alias("weight"))
    if prior is not None:
        model.prior = math.log((prior["yes"] + 1) / (prior["no"] + 1))
    return model


def judge(pages: DataFrame, rules: list[Rule], model: UrlModel, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, words (the host's, joined by blanks), score (log odds of block)."""
    name, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    rows = pages.select(F.col(page_id).alias("page_id"), url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path"))
    rows = rows.select("*", name.alias("rule"), verdict.alias("ruled"))

    rows = rows.join(model.host_words(rows), "host").withColumn("row", F.monotonically_increasing_id())
    rows = materialize(rows, "pages")

    def tokenize(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            tokens = [url_tokens(w, p) for w, p in zip(batch["host_words"], batch["path"], strict=True)]
            yield batch[["row"]].assign(tokens=tokens)

    tokens = rows.select("row", "host_words", "path").mapInPandas(tokenize, "row long, tokens array<string>")
    tokens = tokens.select("row", F.posexplode("tokens").alias("at", "token")).join(model.tokens, "token", "left")
    # added in the tokens' order, so that a score does not depend on how rows were dealt
    weights = F.sort_array(F.collect_list(F.struct("at", F.coalesce("weight", F.lit(model.unseen)).alias("weight"))))
    scores = tokens.groupBy("row").agg(F.aggregate(weights, F.lit(0.0), lambda s, x: s + x["weight"]).alias("sum"))
    score = F.lit(model.prior) + F.coalesce("sum", F.lit(0.0))
    scored = rows.join(scores, "row", "left").select("*", score.alias("score"), F.array_join("host_words", " ").alias("words"))
    by_method = F.when(F.col("score") > 0, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("ruled", by_method).alias("verdict"), "words", "score")
