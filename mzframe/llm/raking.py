"""Mixing sources to target weights by iterative proportional fitting (raking).

Tokens are summed to cells of source, language and topic; raking scales the cells until their sums
by source, by language and by topic meet the targets. A document's factor is its cell's raked over
its natural weight, and documents are sampled with probability min(1, rate * factor), where the
rate is calibrated so that the expected tokens meet the budget. Sampling is decided by a hash of
the id, so it is repeatable, and repeated ids share their fate.

Built from DataFrame functions only. Each half sweep is a grouped sum, combined before the shuffle,
and a join to the cells; the cells' lineage is cut after each of them. No row of a document is
shuffled unless the cells outgrow a broadcast.

Defined results: a null or blank source, language or topic is the category ``unknown``; a null text
has no tokens; documents without tokens have factor 1 if their cell has none either. A category
without a target keeps its share of what the targets leave. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mzframe.llm.common import checkpoint, materialize

DIMENSIONS = ("source", "lang", "topic")


def token_count(text: Column) -> Column:
    """Runs of characters other than white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long")


def form_topic(text: Column) -> Column:
    """The topic where a table has none: that of the text's form, from counts of characters."""
    count = lambda chars: F.regexp_count(text, F.lit(chars))
    size = F.length(text)
    return (
        F.when(F.coalesce(size, F.lit(0)) == 0, "empty")
        .when(count(r"[|{}<>=;]") * 30 > size, "table")
        .when(count(r"[#$%&*@^~]") * 20 > size, "symbols")
        .when(count(r"[A-Z]") * 4 > size, "capitals")
        .when(size < 1000, "note")
        .when(size < 5000, "article")
        .otherwise("book")
    )


def _category(c: Column) -> Column:
    return F.when(F.trim(c) != "", c).otherwise("unknown")


def _targets(cells: DataFrame, dimension: str, target: float | Mapping[str, float]) -> DataFrame:
    """(dimension, goal): each present category's share. A number tempers the natural shares by this power;
    a mapping states shares, and what it leaves goes to the others by their tokens."""
    sums = cells.groupBy(dimension).agg(F.sum("tokens").cast("double").alias("own"))
    if isinstance(target, Mapping):
        stated = F.coalesce(*(F.when(F.col(dimension) == k, F.lit(float(v))) for k, v in sorted(target.items())), F.lit(None).cast("double")) if target else F.lit(None).cast("double")
        sums = sums.withColumn("stated", stated)
        others, given = sums.agg(F.sum(F.when(F.col("stated").isNull(), F.col("own"))), F.coalesce(F.sum("stated"), F.lit(0.0))).first()
        raw = sums.select(dimension, F.coalesce("stated", F.col("own") * (max(0.0, 1 - given) / (others or 1.0))).alias("raw"))
    else:
        raw = sums.select(dimension, F.pow("own", F.lit(float(target))).alias("raw"))
    total = raw.agg(F.sum("raw")).first()[0] or 1.0
    return raw.select(dimension, (F.col("raw") / F.lit(total)).alias(f"goal_{dimension}"))


def rake(cells: DataFrame, targets: Mapping[str, float | Mapping[str, float]], sweeps: int) -> DataFrame:
    """cells with `share`: raked, in sum 1. The sums by the last dimension meet their goals; the others to within what the sweeps reach.

    Every half sweep has the same small plan: a grouped sum joined to the cells, then a checkpoint."""
    cells = cells.where("tokens > 0")
    for d in targets:
        cells = cells.join(_targets(cells.select(d, "tokens"), d, targets[d]), d)
    cells = checkpoint(cells.withColumn("share", F.col("tokens").cast("double")))
    for _ in range(sweeps):
        for d in targets:
            sums = cells.groupBy(d).agg(F.sum("share").alias("sum"))
            cells = checkpoint(cells.join(sums, d).withColumn("share", F.col("share") * F.col(f"goal_{d}") / F.col("sum")).select(*cells.columns))
    return cells.drop(*(f"goal_{d}" for d in targets))


def calibrate(cells: DataFrame, budget_share: float, max_rounds: int = 100) -> DataFrame:
    """cells with `factor` (raked over natural weight) and `probability` = min(1, rate * factor), such
    that the expected tokens are budget_share of all, as far as cells with a factor allow.

    The rate grows until no further cell is certain; each round is one sum over the cells."""
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    cells = cells.withColumn("factor", F.col("share") * total / F.col("tokens"))
    rate = float(budget_share)
    for _ in range(max_rounds):
        sure = F.col("factor") * rate >= 1
        kept, weight = cells.agg(F.coalesce(F.sum(F.when(sure, F.col("tokens"))), F.lit(0)), F.coalesce(F.sum(F.when(~sure, F.col("share") * total)), F.lit(0.0))).first()
        if not weight or (new := (budget_share * total - kept) / weight) <= rate * (1 + 1e-12):
            break
        rate = new
    return cells.withColumn("probability", F.least(F.lit(1.0), F.col("factor") * rate))


def uniform(doc_id: Column, seed: int) -> Column:
    """In [0, 1), from 52 bits of a hash of id and seed."""
    digest = F.md5(F.concat_ws("/", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(1 << 52)


def describe(docs: DataFrame, topic: Column | None = None, text: str = "text") -> DataFrame:
    """docs with source_group, lang_group, topic_group and n_tokens; columns of these names are replaced."""
    return docs.withColumns({
        "source_group": _category(F.col("source")),
        "lang_group": _category(F.col("lang")),
        "topic_group": _category(topic if topic is not None else form_topic(F.col(text))),
        "n_tokens": token_count(F.col(text)),
    })


def sample(described: DataFrame, targets: Mapping[str, float | Mapping[str, float]], budget_share: float = 0.8, sweeps: int = 8, seed: int = 11, doc_id: str = "doc_id") -> DataFrame:
    """Described documents with factor, probability and sampled.

    targets: for each of source, lang and topic a power that tempers natural shares, or shares by
    category. `described` is read twice; where its texts are not needed, a narrow written table of
    its other columns spares the second look at them."""
    described = described.drop("factor", "probability", "sampled")
    groups = {f"{d}_group": d for d in DIMENSIONS}
    cells = materialize(described.groupBy(*groups).agg(F.sum("n_tokens").alias("tokens")), "cells")
    cells = rake(cells, {f"{d}_group": targets.get(d, 1.0) for d in DIMENSIONS}, sweeps)
    cells = materialize(calibrate(cells, budget_share).select(*groups, "factor", "probability"), "raked")
    out = described.join(cells, list(groups), "left")
    out = out.withColumns({"factor": F.coalesce("factor", F.lit(1.0)), "probability": F.coalesce("probability", F.lit(float(min(1.0, budget_share))))})
    return out.withColumn("sampled", uniform(F.col(doc_id), seed) < F.col("probability"))
