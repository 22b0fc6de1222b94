"""Embedding near-duplicates through an inverted multi-index.

Two codebooks, one for each half of the vectors, are fitted apart; the pairs of their centroids are
the cells of a product grid, which is finer the more vectors there are. Every vector is listed in its
own cell, and every vector visits cells in the order of the summed squared distances to the centroids
of both halves, as a multi-sequence traversal of the two sorted lists does, until the excess over its
own cell's sum passes a bound calibrated for a target recall. What it meets there is verified by cosine.

Cells are dealt out by pages: the cells of one left centroid whose right centroids lie near each
other, as many as hold about `block` entries. A vector is sent once to each page that has a cell it
visits. A page of more entries, or with many visitors, is dealt in blocks. A block gives one row per
entry that has links (its count of links, and the smallest entry that it is linked to within the
block), never one per pair.

Bounds: the codebooks and the calibration use a sample of at most `sample_rows` vectors, and a half
has at most MOST_CODEWORDS centroids; every vector is indexed. Equal vectors are one entry with a count.

Defined results: vectors link only if their labels are equal and not null and their lengths agree.
A vector that is null, empty, zero or holds null or non-finite components, or whose label or id is
null, has no links and is its own component. Repeated rows count as vectors of their own. Vectors of
a length that the sample missed share one cell. An empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mzframe.llm.common import connected_components, materialize


MOST_CODEWORDS = 512


def codewords_for(entries: int) -> int:
    """Of each half: so that a cell holds about four entries, if all lie alike."""
    return min(MOST_CODEWORDS, max(4, math.ceil(math.sqrt(entries) / 2)))


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared, of every row to every centre."""
    return np.maximum((x * x).sum(1)[:, None] + (centres * centres).sum(1) - 2 * x @ centres.T, 0)


def kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = _distances(x, centres).argmin(1)
        for c in range(len(centres)):
            if len(own := x[near == c]):
                centres[c] = own.mean(0)
    return centres


def units(rows: list) -> np.ndarray:
    x = np.array(rows, float)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@dataclass
class Grid:
    """The codebooks of vectors of one length, and how far over its own cell's sum a vector looks."""

    left: np.ndarray
    right: np.ndarray
    slack: float = 0.0

    def excess(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each half, how much each centroid's squared distance is over the nearest one's."""
        a, b = _distances(x[:, : self.left.shape[1]], self.left), _distances(x[:, self.left.shape[1] :], self.right)
        return a - a.min(1, keepdims=True), b - b.min(1, keepdims=True)

    def cell(self, x: np.ndarray) -> np.ndarray:
        a, b = self.excess(x)
        return a.argmin(1) * len(self.right) + b.argmin(1)

    def visits(self, x: np.ndarray) -> list[np.ndarray]:
        """The cells that each row visits, in order. Of the two sorted lists it takes the ranks whose own
        excess is within the slack; their sums' order is that of the multi-sequence traversal."""
        out = []
        for a, b in zip(*self.excess(x), strict=True):
            i, j = np.flatnonzero(a <= self.slack), np.flatnonzero(b <= self.slack)
            sums = a[i][:, None] + b[j]
            u, v = np.nonzero(sums <= self.slack)
            order = np.argsort(sums[u, v], kind="stable")
            out.append(i[u[order]] * len(self.right) + j[v[order]])
        return out

    def reaches(self, x: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """Whether each row visits the cell of the same place."""
        a, b = self.excess(x)
        at = np.arange(len(x))
        return a[at, cells // len(self.right)] + b[at, cells % len(self.right)] <= self.slack

    def right_order(self) -> np.ndarray:
        """The place of each right centroid along the direction in which they differ most."""
        if len(self.right) == 1:
            return np.zeros(1, int)
        centred = self.right - self.right.mean(0)
        direction = np.linalg.svd(centred, full_matrices=False)[2][0]
        return np.argsort(np.argsort(centred @ direction, kind="stable"), kind="stable")


def one_cell(dim: int) -> Grid:
    half = max(1, dim // 2)
    return Grid(np.zeros((1, half)), np.zeros((1, dim - half)))


def fit(x: np.ndarray, threshold: float, codewords: int, target_recall: float, seed: int = 7) -> Grid:
    """Codebooks on the halves of unit vectors x, and the slack that meets the target recall for
    neighbours at exactly the threshold, in random directions: closer ones are met more surely."""
    if x.shape[1] == 1:
        return one_cell(1)
    rng = np.random.default_rng(seed)
    half = x.shape[1] // 2
    grid = Grid(kmeans(x[:, :half], codewords, 12, rng), kmeans(x[:, half:], codewords, 12, rng))
    noise = rng.normal(size=x.shape)
    noise -= (noise * x).sum(1, keepdims=True) * x
    size = np.linalg.norm(noise, axis=1, keepdims=True)
    y = threshold * x + math.sqrt(max(0, 1 - threshold**2)) * noise / np.where(size > 0, size, 1)
    a, b = grid.excess(x)
    cells, at = grid.cell(y), np.arange(len(x))
    over = a[at, cells // len(grid.right)] + b[at, cells % len(grid.right)]
    grid.slack = float(np.quantile(over, target_recall)) + 1e-9
    return grid


def _blocks(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """The groups of rows that arrive sorted by keys, whatever the batches' borders."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if batch.empty:
            continue
        k = batch[keys].to_numpy()
        cuts = [0, *(np.flatnonzero((k[1:] != k[:-1]).any(1)) + 1), len(batch)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            part = batch.iloc[a:b]
            if held and (held[-1][keys].iloc[-1] != part[keys].iloc[0]).any():
                yield pd.concat(held) if len(held) > 1 else held[0]
                held = []
            held.append(part)
    if held:
        yield pd.concat(held) if len(held) > 1 else held[0]


def smallest_linked(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For n nodes and links between them, the smallest node that each reaches."""
    low = np.arange(n)
    while True:
        m = np.minimum(low[a], low[b])
        new = low.copy()
        np.minimum.at(new, a, m)
        np.minimum.at(new, b, m)
        new = new[new]
        if (new == low).all():
            return low
        low = new


def match(group: pd.DataFrame, grid: Grid, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """rep, links and root of the entries of one block that have links.

    A pair counts where its guest visits the listed one's cell; if both visit each other's, where the smaller one visits."""
    listed, guests = group[group["guest"] == 0], group[group["guest"] == 1]
    if listed.empty or guests.empty:
        return None
    x, y = (units(list(g["vec"])) for g in (guests, listed))
    xr, yr, xn, yn = guests["rep"].to_numpy(), listed["rep"].to_numpy(), guests["n"].to_numpy(), listed["n"].to_numpy()
    i, j = np.nonzero(x @ y.T >= threshold - 1e-9)
    if len(i):
        p, q = x[i], y[j]
        exact = ((p * q).sum(1) >= threshold) & (xr[i] != yr[j])
        i, j, p, q = i[exact], j[exact], p[exact], q[exact]
        here, back = grid.reaches(p, listed["own"].to_numpy()[j]), grid.reaches(q, guests["own"].to_numpy()[i])
        take = here & (~back | (xr[i] < yr[j]))
        i, j = i[take], j[take]
    if not len(i):
        return None
    reps, at = np.unique(np.concatenate([xr, yr]), return_inverse=True)
    ai, bj = at[: len(xr)][i], at[len(xr) :][j]
    links = np.bincount(ai, yn[j], len(reps)) + np.bincount(bj, xn[i], len(reps))
    root = reps[smallest_linked(len(reps), ai, bj)]
    some = links > 0
    return reps[some], links[some].astype("int64"), root[some]


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", codewords: int | None = None, target_recall: float = 0.99, sample_rows: int = 8_192, block: int = 256) -> DataFrame:
    """vec_id, n_links, component_id, kept: see the module. target_recall is that of one direction of
    visits; a pair is found if either of its vectors visits the other's cell. codewords: of each half;
    by the number of entries if not given."""
    doubles = F.transform(F.col(embedding), lambda v: v.cast("double") + F.lit(0.0))
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).alias("label"), doubles.alias("vec"))
    norm = F.aggregate("vec", F.lit(0.0), lambda s, v: s + v * v)
    good = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce((F.size("vec") > 0) & (norm > 0) & (norm < float("inf")) & ~F.isnan(norm), F.lit(False))
    rows = rows.select("vec_id", "label", F.when(good, F.col("vec")).alias("vec"))
    rows = rows.withColumns({"k1": F.when(good, F.xxhash64(F.lit(1), "vec")), "k2": F.when(good, F.xxhash64(F.lit(2), "vec"))})
    key = ["label", "k1", "k2"]
    entries = rows.where("vec is not null").groupBy(key).agg(F.min(F.struct("vec_id", "vec")).alias("first"), F.count("*").alias("n"))
    entries = materialize(entries.select(*key, F.col("first.vec_id").alias("rep"), F.col("first.vec").alias("vec"), "n"), "entries")

    sample = [r["vec"] for r in entries.select("vec").orderBy(F.xxhash64("vec")).limit(sample_rows).collect()]
    words = codewords or codewords_for(entries.count())
    grids = {d: fit(units([v for v in sample if len(v) == d]), threshold, words, target_recall) for d in {len(v) for v in sample}}
    orders = {d: g.right_order() for d, g in grids.items()}

    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for d, part in batch.groupby(batch["vec"].map(len)):
                grid = grids.get(d) or one_cell(d)
                order, m = orders.get(d, np.zeros(1, int)), len(grid.right)
                for k in range(0, len(part), 256):
                    p = part.iloc[k : k + 256]
                    x = units(list(p["vec"]))
                    own, cells = grid.cell(x), grid.visits(x)
                    met = [[{"left": int(a), "rights": np.unique(order[c[c // m == a] % m]).tolist()} for a in np.unique(c // m)] for c in cells]
                    yield p.assign(dim=int(d), own=own, left=own // m, right=order[own % m], rights=m, met=met)

    schema = f"label {entries.schema['label'].dataType.simpleString()}, rep long, n long, vec array<double>"
    entry_rows = entries.select("label", "rep", "n", "vec")
    visits = materialize(entry_rows.mapInPandas(visit, f"{schema}, dim int, own long, left long, right long, rights int, met array<struct<left: long, rights: array<long>>>"), "visits")
    side = ["label", "dim", "left"]
    entry = ["rep", "n", "vec", "own"]
    # how many pages the cells of a left centroid make
    pages = visits.groupBy(side).agg(F.least(F.ceil(F.count("*") / block), F.first("rights")).cast("int").alias("pages"), F.first("rights").alias("m"))
    pages = materialize(pages, "pages")
    page = lambda right: F.floor(right * F.col("pages") / F.col("m")).cast("int")
    listed = visits.join(pages, side).select(*side, page(F.col("right")).alias("page"), *entry)
    met = visits.select("label", "dim", *entry, F.explode("met").alias("c")).select("label", "dim", F.col("c.left").alias("left"), F.col("c.rights").alias("met"), *entry)
    guests = met.join(pages, side).select(*side, F.explode(F.array_distinct(F.transform("met", page))).alias("page"), *entry)
    at = [*side, "page"]
    sizes = listed.groupBy(at).agg(F.count("*").alias("listed")).join(guests.groupBy(at).agg(F.count("*").alias("guests")), at).where("guests > 1")
    sizes = materialize(sizes.select(*at, F.ceil(F.col("listed") / block).cast("int").alias("blocks"), F.ceil(F.col("guests") / (2 * block)).cast("int").alias("splits")), "sizes")

    spread = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    hosts = listed.join(sizes, at).select(*at, spread("blocks").alias("block"), all_of("splits").alias("split"), F.lit(0).alias("guest"), *entry)
    callers = guests.join(sizes, at).select(*at, all_of("blocks").alias("block"), spread("splits").alias("split"), F.lit(1).alias("guest"), *entry)
    place = [*at, "block", "split"]
    dealt = hosts.unionByName(callers).repartition(*place).sortWithinPartitions(*place)

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in _blocks(batches, place):
            d = int(group["dim"].iloc[0])
            if found := match(group, grids.get(d) or one_cell(d), threshold):
                yield pd.DataFrame(dict(zip(("rep", "links", "root"), found, strict=True)))

    found = materialize(dealt.mapInPandas(verify, "rep long, links long, root long"), "links")
    component = connected_components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    classes = entries.drop("vec").join(links, "rep", "left").join(component.withColumnRenamed("node", "rep"), "rep", "left")
    classes = materialize(classes.select(*key, (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id")), "classes")
    out = rows.drop("vec").join(classes, key, "left")
    component_id = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component_id.alias("component_id"), (F.col("vec_id") == component_id).alias("kept"))
