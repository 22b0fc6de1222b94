"""Near-duplicate documents: improved consistent weighted sampling over TF-IDF shingles.

A document is the multiset of its shingles of five lower-cased words, each weighted by its count
times an IDF weight. IDF comes from a sketch of a fixed size that counts, over all documents, how
many hold a shingle of each hash bucket. Improved consistent weighted sampling draws `samples`
shingles from each document, such that two documents draw the same one with the probability of
their weighted Jaccard similarity; bands of `rows` draws bring candidates together, and what they
propose is verified by the exact weighted Jaccard similarity of the whole texts.

Texts with the same words are one class from the start. In a bucket every class is first verified
against the smallest one; classes that this leaves in different components are then compared in
blocks. There every pair is verified unless its members are connected, an earlier band brings them
together too, or the sums of their weights are so unequal that they cannot reach the threshold;
classes of which this holds for all others of a bucket leave it before texts are fetched. So
copies are not expanded to pairs, a block's output is at most one link per member, and no link
between components that a band proposes is lost; what is lost is only what no band proposes.

Defined results: a null text has no words; all texts without words are copies of each other; a
text of fewer than five words is one shingle. Rows that share an id are one document: it is linked
to whatever any of its texts is linked to, and `deduplicated` keeps its smallest text. A row whose
id is null is kept and has no component. An empty table gives an empty result; other columns stay
out of the way. A very long text is one more row; its shingles are drawn from in parts.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mzframe.llm.common import connected_components, materialize

WORDS = 5
SKETCH = 1 << 18
SKETCH_BLOCKS = 16
#: A bucket of the sketch that holds its even share weighs 1, one that all shingles hit this much.
COMMON = 0.75
#: Texts whose draws a task remembers.
RECENT = 2_000
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], "uint64")


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class _Hashes(dict):
    """Hashes of words, made when first asked for."""

    def __init__(self) -> None:
        import xxhash

        super().__init__()
        self.hash = xxhash.xxh64_intdigest

    def __missing__(self, word: str) -> int:
        h = self[word] = self.hash(word.encode("utf-8", "replace"))
        return h


class Shingler:
    """Hashes of shingles. The memo of word hashes is bounded."""

    def __init__(self) -> None:
        self.memo = _Hashes()

    def words(self, text: str | None) -> list[str]:
        return (text or "").lower().split()

    def shingles(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Distinct shingle hashes, sorted, and their counts."""
        if len(self.memo) > 300_000:
            self.memo.clear()
        x = np.fromiter(map(self.memo.__getitem__, words), "uint64", len(words))
        n = max(1, len(x) - WORDS + 1) if len(x) else 0
        total = np.zeros(n, "uint64")
        for k in range(min(WORDS, len(x))):
            total += x[k : k + n] * _MULTIPLIERS[k]
        return np.unique(_mix(total), return_counts=True)


def buckets(shingles: np.ndarray) -> np.ndarray:
    """Of the sketch: the leading bits."""
    return (shingles >> np.uint64(65 - SKETCH.bit_length())).astype("int64")


def count_sketch(docs: DataFrame, text: str = "text") -> np.ndarray:
    """How many documents hold a shingle of each bucket, over all documents. A task adds up its
    documents and sends its counts compressed, in blocks; what reaches the driver has the sketch's size."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard

        shingler, counts = Shingler(), np.zeros(SKETCH, "int64")
        for batch in batches:
            for t in batch["text"]:
                s, _ = shingler.shingles(shingler.words(t))
                held = buckets(s)  # in order, as the shingles are
                counts[held[np.flatnonzero(np.diff(held, prepend=-1))]] += 1
        if counts.any():
            pack = zstandard.ZstdCompressor(1).compress
            yield pd.DataFrame({"block": range(SKETCH_BLOCKS), "counts": [pack(c.tobytes()) for c in counts.reshape(SKETCH_BLOCKS, -1)]})

    def add(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        total = np.zeros(SKETCH // SKETCH_BLOCKS, "int64")
        for c in rows["counts"]:
            total += np.frombuffer(unpack(c), "int64")
        return pd.DataFrame({"block": [key[0]], "counts": [total.tobytes()]})

    parts = docs.select(F.col(text).alias("text")).mapInPandas(count, "block int, counts binary")
    out = np.zeros((SKETCH_BLOCKS, SKETCH // SKETCH_BLOCKS), "int64")
    for r in parts.groupBy("block").applyInPandas(add, "block int, counts binary").collect():
        out[r["block"]] = np.frombuffer(r["counts"], "int64")
    return out.reshape(-1)


def idf_weights(counts: np.ndarray) -> np.ndarray:
    """From 1 for a bucket with its even share of all occurrences, or less, down to COMMON for one that has all."""
    share = np.maximum(counts, 1) / max(counts.sum(), 1)
    rare = np.clip(-np.log(share) / np.log(len(counts)), 0, 1)
    return COMMON + (1 - COMMON) * rare


@cache
def _gamma() -> tuple[np.ndarray, np.ndarray]:
    """The middles of 65,536 equal steps of a Gamma(2, 1) variable, and their logarithms.

    Its distribution is 1 - exp(-x) (1 + x), read backwards from a fine table."""
    x = np.concatenate([np.linspace(0, 1, 1 << 18) ** 2, np.linspace(1, 20, 1 << 18)[1:]])
    steps = np.interp((np.arange(65536) + 0.5) / 65536, -np.expm1(-x) - x * np.exp(-x), x)
    return steps, np.log(steps)


def sample(shingles: np.ndarray, weights: np.ndarray, samples: int, part: int = 1024) -> np.ndarray:
    """Improved consistent weighted sampling: for each of `samples` draws, a hash of the shingle and
    quantum that it picks. r and c are Gamma(2, 1), beta uniform, all from hashes of shingle and draw."""
    best, picked = np.full(samples, np.inf), np.zeros(samples, "uint64")
    seeds = _mix(np.arange(1, samples + 1, dtype="uint64") * _MULTIPLIERS[0])[:, None]
    (gamma, log_gamma), low = _gamma(), np.uint64(0xFFFF)
    for at in range(0, len(shingles), part):
        s, log_w = shingles[at : at + part], np.log(weights[at : at + part])
        z = (s[None, :] ^ seeds) * _MULTIPLIERS[3]  # shingles are mixed already
        z ^= z >> np.uint64(32)
        z *= _MULTIPLIERS[1]
        z ^= z >> np.uint64(29)
        r = gamma[z & low]
        beta = (z >> np.uint64(32)).astype(float)
        beta *= 2.0**-32
        t = log_w / r
        t += beta
        np.floor(t, out=t)
        log_a = log_gamma[(z >> np.uint64(16)) & low]
        beta -= t
        beta -= 1
        beta *= r
        log_a += beta
        k = log_a.argmin(1)
        rows = np.arange(samples)
        better = log_a[rows, k] < best
        best = np.where(better, log_a[rows, k], best)
        picked = np.where(better, _mix(s[k] + t[rows, k].astype("int64").astype("uint64") * _MULTIPLIERS[2]), picked)
    return picked


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard of two documents, given as sorted shingles and their weights."""
    (x, u), (y, v) = (a, b) if len(a[0]) <= len(b[0]) else (b, a)
    if not len(x):
        return float(not len(y))
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    both = y[at] == x
    common = np.minimum(u[both], v[at[both]]).sum()
    return float(common / (u.sum() + v.sum() - common))


class Weigher:
    """Texts as sorted shingles and weights."""

    def __init__(self, idf: np.ndarray):
        self.idf, self.shingler = idf, Shingler()

    def of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        s, n = self.shingler.shingles(words)
        return s, n * self.idf[buckets(s)]

    def of_text(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        return self.of(self.shingler.words(text))


def _groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """The groups of rows that arrive sorted by keys, whatever the batches' borders."""
    held: list[pd.DataFrame] = []
    for batch in filter(len, batches):
        for _, part in batch.groupby(keys, sort=False):
            if held and (held[-1][keys].iloc[-1] != part[keys].iloc[0]).any():
                yield pd.concat(held) if len(held) > 1 else held[0]
                held = []
            held.append(part)
    if held:
        yield pd.concat(held) if len(held) > 1 else held[0]


class Union:
    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (p := self.up.get(x, x)) != x:
            self.up[x] = x = self.up.get(p, p)
        return x

    def link(self, a: int, b: int) -> None:
        self.up[max(self.root(a), self.root(b))] = min(self.root(a), self.root(b))


class Shapes:
    """The shingles of a block's texts side by side, so that one text is compared with many at once."""

    def __init__(self, texts: list[tuple[np.ndarray, np.ndarray]]):
        sizes = [len(x) for x, _ in texts]
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        self.totals = np.array([w.sum() for _, w in texts])
        self.weights = np.concatenate([w for _, w in texts])
        distinct, at = np.unique(np.concatenate([x for x, _ in texts]), return_inverse=True)
        self.at, self.own = at, np.zeros(len(distinct))

    def similar(self, i: int, others: np.ndarray, threshold: float) -> np.ndarray:
        """Which of the others reach the threshold against text i."""
        mine = slice(self.starts[i], self.ends[i])
        self.own[self.at[mine]] = self.weights[mine]
        common = np.array([np.minimum(self.own[self.at[a:b]], self.weights[a:b]).sum() for a, b in zip(self.starts[others], self.ends[others], strict=True)])
        self.own[self.at[mine]] = 0
        both = self.totals[i] + self.totals[others]
        return common >= threshold * (both - common) - 1e-12 * both


def compare_blocks(group: pd.DataFrame, weigh: Weigher, threshold: float, bands: int) -> list[tuple[int, int]]:
    """Links between the components of one block's classes, or of two blocks' of one bucket."""
    group = group.reset_index(drop=True)
    draws = np.frombuffer(b"".join(group["draws"]), "<u8").reshape(len(group), -1)
    node, side = group["rep"].tolist(), group["own"].to_numpy()
    _, comp = np.unique(group["comp"].to_numpy(), return_inverse=True)
    band, rows = int(group["band"].iloc[0]), draws.shape[1] // bands
    two = group["low"].iloc[0] != group["high"].iloc[0]
    shapes, out, places = Shapes([weigh.of_text(t) for t in group["text"]]), [], np.arange(len(group))
    for i in range(len(group)):
        low, high = threshold * shapes.totals[i] * (1 - 1e-9), shapes.totals[i] / threshold * (1 + 1e-9)
        later = np.flatnonzero((places > i) & (comp != comp[i]) & (shapes.totals >= low) & (shapes.totals <= high) & ((side != side[i]) if two else True))
        if band and len(later):
            later = later[~(draws[later] == draws[i])[:, : band * rows].reshape(len(later), band, rows).all(2).any(1)]
        if not len(later):
            continue
        for j in later[shapes.similar(i, later, threshold)]:
            if comp[j] != comp[i]:
                comp[comp == comp[j]] = comp[i]
                out.append((node[i], node[j]))
    return out


def same_id_links(signed: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b) between the classes of an id that has several texts; as a rule there are none."""
    several = signed.where("doc_id is not null").groupBy("doc_id").agg(F.min("k1").alias("low1"), F.max("k1").alias("high1"), F.min("k2").alias("low2"), F.max("k2").alias("high2")).where("low1 <> high1 or low2 <> high2")
    rows = signed.select("doc_id", "k1", "k2").join(several.select("doc_id"), "doc_id", "left_semi").distinct()
    return rows.join(classes.select("k1", "k2", "rep"), ["k1", "k2"]).where("rep <> doc_id").select(F.col("rep").alias("a"), F.col("doc_id").alias("b")).distinct()


def _size(total: Column, threshold: float) -> Column:
    """A step of the sums of weights: sums that could reach the threshold are in one step or in neighbouring ones."""
    step = -math.log(max(threshold, 1e-9) * (1 - 1e-6))
    return F.coalesce(F.floor(F.log(total) / step), F.lit(-(1 << 40)))


def with_partners(rows: DataFrame, what: str) -> DataFrame:
    """Rows beside which their bucket has another value of `what` among classes whose sum of weights could reach the threshold.

    The similarity of two texts is at most the smaller sum of weights over the larger, so the rest has no link here."""
    place = ["band", "bucket", "size"]
    near = rows.groupBy(place).agg(F.min(what).alias("least"), F.max(what).alias("most"))
    near = near.withColumn("size", F.explode(F.array(F.col("size") - 1, F.col("size"), F.col("size") + 1)))
    near = near.groupBy(place).agg(F.min("least").alias("least"), F.max("most").alias("most")).where("least <> most").select(*place)
    return rows.join(near, place, "left_semi")


def near_duplicates(docs: DataFrame, threshold: float = 0.8, doc_id: str = "doc_id", text: str = "text", bands: int = 8, rows: int = 3, star_block: int = 256, block: int = 512) -> DataFrame:
    """doc_id, component_id (the smallest id of its group), n_copies (rows with the same words), kept.

    bands * rows draws are taken; a pair of similarity s meets in a band with probability
    1 - (1 - s**rows)**bands, that is 0.997 at 0.8."""
    spark = docs.sparkSession
    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("mark"), F.col(text).alias("text"))
    idf = spark.sparkContext.broadcast(idf_weights(count_sketch(base)))
    samples = bands * rows

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weigh, recent = Weigher(idf.value), {}
        for batch in batches:
            made = []
            for t in batch["text"]:
                words = weigh.shingler.words(t.as_py())
                key = hashlib.blake2b(" ".join(words).encode("utf-8", "replace"), digest_size=16).digest()
                if key not in recent:  # copies are drawn from once
                    if len(recent) >= RECENT:
                        recent.clear()
                    shape = weigh.of(words)
                    recent[key] = sample(*shape, samples), float(shape[1].sum())
                made.append((np.frombuffer(key, "<i8"), *recent[key]))
            k = np.array([m[0] for m in made], "int64").reshape(-1, 2)
            buckets = [_mix((d.reshape(bands, rows) * _MULTIPLIERS[:rows]).sum(1, dtype="uint64")).view("int64") for _, d, _ in made]
            columns = [batch["doc_id"], batch["mark"], pa.array(k[:, 0]), pa.array(k[:, 1]), pa.array(buckets, pa.list_(pa.int64())), pa.array([d.astype("<u8").tobytes() for _, d, _ in made], pa.binary()), pa.array([t for _, _, t in made], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "mark", "k1", "k2", "buckets", "draws", "total"])

    signed = materialize(base.mapInArrow(sign, "doc_id long, mark long, k1 long, k2 long, buckets array<long>, draws binary, total double"), "draws")
    classes = signed.groupBy("k1", "k2").agg(F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "mark"))).alias("first"), F.count("*").alias("n_copies"), F.min("buckets").alias("buckets"), F.min("draws").alias("draws"), F.min("total").alias("total"))
    classes = materialize(classes.select("k1", "k2", F.col("first.doc_id").alias("rep"), F.col("first.mark").alias("mark"), "n_copies", "buckets", "draws", "total"), "classes")
    # draws do not compress, so they stay behind until a block's classes are compared
    placed = classes.where("rep is not null").select("rep", "mark", "total", _size(F.col("total"), threshold).alias("size"), F.posexplode("buckets").alias("band", "bucket"))
    place = ["band", "bucket"]
    hubs = placed.groupBy(place).agg(F.min("rep").alias("hub"), F.min_by("total", "rep").alias("hub_total"), F.count("*").alias("n")).where("n > 1")
    hubs = materialize(hubs, "buckets")
    shared = materialize(placed.join(hubs, place), "met")
    shared = materialize(with_partners(shared, "rep"), "shared")

    # merge joins at every size: the ids grow with the documents, and a plan that broadcasts the few of
    # a small table would not be that of a large one
    met = shared.select(F.col("rep").alias("doc_id"), "mark").distinct().hint("merge")
    texts = base.where("doc_id is not null").join(met, ["doc_id", "mark"], "left_semi").groupBy("doc_id", "mark").agg(F.min("text").alias("text"))
    texts = materialize(texts.withColumnRenamed("doc_id", "rep"), "texts")

    fits = F.least("total", "hub_total") >= F.greatest("total", "hub_total") * (threshold * (1 - 1e-9))
    pairs = shared.where("rep <> hub").where(fits).groupBy("hub", "rep").agg(F.max("n").alias("n"))
    salted = F.pmod(F.xxhash64("rep"), F.ceil(F.col("n") / star_block)).cast("int").alias("salt")
    pairs = materialize(pairs.select("hub", "rep", salted), "pairs")
    wanted = pairs.select("hub", "salt", "rep", F.lit(1).alias("guest")).union(pairs.select("hub", "salt").distinct().select("hub", "salt", F.col("hub").alias("rep"), F.lit(0).alias("guest")))
    star = wanted.join(texts.hint("merge"), "rep").repartition("hub", "salt").sortWithinPartitions("hub", "salt", "guest")

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weigh, key, hub = Weigher(idf.value), None, []
        for batch in filter(len, batches):
            out = []
            for h, salt, rep, guest, t in zip(*(batch[c] for c in ("hub", "salt", "rep", "guest", "text")), strict=True):
                if (h, salt) != key:
                    key, hub = (h, salt), []
                shape = weigh.of_text(t)
                if not guest:
                    hub.append(shape)
                elif any(similarity(shape, x) >= threshold for x in hub):
                    out.append((h, rep))
            yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    links = star.select("hub", "salt", "rep", "guest", "text").mapInPandas(verify, "a long, b long")
    links = materialize(links.union(same_id_links(signed, classes)), "links")
    first = materialize(connected_components(links), "components").withColumnRenamed("node", "rep")
    left = shared.join(first, "rep", "left").withColumn("comp", F.coalesce("component", "rep")).drop("component")
    left = materialize(left, "left")
    left = with_partners(left, "comp")
    own = F.pmod(F.xxhash64("rep"), F.ceil(F.col("n") / block)).cast("int")
    left = left.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / block).cast("int") - 1)))
    low, high = F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high")
    left = left.select(*place, low, high, "own", "rep", "mark", "comp").join(texts.hint("merge"), ["rep", "mark"])
    left = left.join(classes.select("rep", "mark", "draws").hint("merge"), ["rep", "mark"])
    keys = [*place, "low", "high"]
    dealt = left.repartition(*keys).sortWithinPartitions(*keys)

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weigh = Weigher(idf.value)
        for group in _groups(batches, keys):
            if found := compare_blocks(group, weigh, threshold, bands):
                yield pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    more = materialize(dealt.mapInPandas(compare, "a long, b long"), "more")
    last = connected_components(links.union(more)).withColumnRenamed("node", "rep")
    grouped = classes.select("k1", "k2", "rep", "n_copies").join(last, "rep", "left")
    grouped = materialize(grouped.select("k1", "k2", "n_copies", F.coalesce("component", "rep").alias("component_id")), "groups")
    out = signed.select("doc_id", "k1", "k2").join(grouped, ["k1", "k2"])
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", component.alias("component_id"), "n_copies", _kept(component).alias("kept"))


def _kept(component: Column) -> Column:
    return F.coalesce(F.col("doc_id") == component, F.lit(True))


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options: object) -> DataFrame:
    """The rows of docs, one of each group: that with the smallest id, and of its rows one with the smallest text. Rows without an id stay."""
    kept = near_duplicates(docs, doc_id=doc_id, text=text, **options).where("kept and doc_id is not null").select(F.col("doc_id").alias(doc_id)).distinct()
    some = docs.where(F.col(doc_id).isNotNull()).join(kept.hint("merge"), doc_id, "left_semi")
    one = some.groupBy(F.col(doc_id).alias("id")).agg(F.min_by(F.struct(*docs.columns), F.coalesce(F.col(text), F.lit(""))).alias("row")).select("row.*")
    return one.unionByName(docs.where(F.col(doc_id).isNull()))
