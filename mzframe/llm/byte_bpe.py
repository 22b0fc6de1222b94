"""Byte-level BPE encoding and decoding of whole texts.

Every text is cut into overlapping chunks that are pre-tokenised apart. The pattern looks ahead
only, so from any position that is a boundary in two chunks on, both continue alike: neighbours
are stitched at the first boundary that both have in their overlap. The pieces between boundaries
are encoded beside their chunk, and stitching cuts the ids there. A text of one chunk is the case
in which there is nothing to stitch. Decoding concatenates the ids' raw bytes.

Where an overlap has no common boundary, the text from the last sure boundary on stays open. A
chunk without a boundary of its own only lengthens it; at the first one that has some, the open text
is pre-tokenised together with that chunk. So a long run without spaces is looked at once as a
whole, when it closes, and the result is always that of the whole text.

Texts are read once. Those of up to `dealt` characters are cut, coded and stitched in the task that
reads them. Longer ones are cut there into chunks of `dealt` characters, which are written,
dealt out, coded in parallel and brought together again by text; so no task codes more than that at
once, and only their ids come together.

Defined results: a null text is empty and has no ids. Repeated rows and ids stay rows of their
own, and ids may be null. An empty table gives an empty result. Other columns of the input are
ignored.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterable, Iterator
from itertools import accumulate, chain, groupby
from operator import itemgetter
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from mzframe.llm.common import materialize

#: White space as Unicode defines it, spelled out since regex libraries differ on control characters.
SPACES = r"\t-\r \x85\xa0  -     　"
#: Longest literal of the pattern and what follows it: a boundary so near a chunk's end may depend on what comes after.
LOOK = 4
MEMO = 200_000


def load_ranks(spark: SparkSession, path: str) -> bytes:
    """The rank file's bytes, read by the driver; vocabularies are files of a fixed size of about 1 MB."""
    with open(path, "rb") as f:
        return f.read()


class Coder:
    """Pre-tokenises, encodes pieces and decodes ids by a table of ranks."""

    def __init__(self, rank_file: bytes, pattern: str):
        import regex
        import tiktoken

        pairs = (line.split() for line in rank_file.splitlines() if line.strip())
        ranks = {base64.b64decode(a): int(b) for a, b in pairs}
        self.bytes = {i: b for b, i in ranks.items()}
        own = pattern.replace(r"[^\s", rf"[^{SPACES}").replace(r"\S", f"[^{SPACES}]").replace(r"\s", f"[{SPACES}]")
        self.find = regex.compile(own).findall
        self.memo: dict[str, bytes] = {}
        self.merge = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece

    def piece(self, piece: str) -> bytes:
        """Ids of one piece as little-endian 32-bit integers."""
        out = np.array(self.merge(piece.encode()), "<u4").tobytes()
        if len(piece) <= 40:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            self.memo[piece] = out
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist()))


class Part(NamedTuple):
    """A coded chunk. bounds: where its pieces start, in characters of the text, and the end; at: the same in
    bytes of ids; sure: the index of the last bound that no text behind the chunk can move."""

    start: int
    end: int
    sure: int
    bounds: list[int]
    at: list[int]
    ids: bytes


def chunk_part(coder: Coder, text: str, start: int, last: bool) -> Part:
    found, memo, piece = coder.find(text), coder.memo, coder.piece
    coded = [memo.get(p) or piece(p) for p in found]
    bounds = list(accumulate(map(len, found), initial=start))
    end = start + len(text)
    sure = len(found) if last else max(0, min(bisect_right(bounds, end - LOOK), len(found)) - 1)
    return Part(start, end, sure, bounds, list(accumulate(map(len, coded), initial=0)), b"".join(coded))


def trimmed(part: Part, overlap: int) -> Part:
    """With the bounds that stitching may ask for."""
    keep = [k for k, b in enumerate(part.bounds) if b <= part.start + overlap or b >= part.end - overlap or k == part.sure]
    return part._replace(sure=keep.index(part.sure), bounds=[part.bounds[k] for k in keep], at=[part.at[k] for k in keep])


def meeting(held: Part, done: int, part: Part) -> tuple[int, int] | None:
    """The indexes of the first bound that both are sure of; done: that of held's first bound still to come."""
    first = max(done, bisect_left(held.bounds, part.start))
    ours = dict(zip(held.bounds[first : held.sure + 1], range(first, held.sure + 1), strict=True))
    for k, b in enumerate(part.bounds[: part.sure + 1]):
        if b in ours:
            return ours[b], k
        if b > held.end:
            break
    return None


def stitch(coder: Coder, parts: Iterable[tuple[Part, bool]]) -> Iterator[bytes]:
    """The ids of a text, piecewise, from its chunks in order; each comes with whether it is the last."""
    held: Part | None = None
    done, start, end, open_text = 0, 0, 0, []
    for part, last in parts:
        if held is None and not open_text:
            held = part
            continue
        if held is not None:
            if met := meeting(held, done, part):
                yield held.ids[held.at[done] : held.at[met[0]]]
                held, done = part, met[1]
                continue
            cut = held.at[held.sure]
            yield held.ids[held.at[done] : cut]
            start, end, open_text, held = held.bounds[held.sure], held.end, [coder.decode(held.ids[cut:]).decode()], None
        open_text.append(coder.decode(part.ids).decode()[end - part.start :])
        end = part.end
        if part.sure or last:
            held, done, open_text = chunk_part(coder, "".join(open_text), start, last), 0, []
    if held is not None:
        yield held.ids[held.at[done] :]


def chunks(text: str, chunk: int, overlap: int) -> Iterator[tuple[int, str, bool]]:
    """(start, text, whether it is the last) of overlapping chunks."""
    stop = max(1, len(text) - overlap)
    for s in range(0, stop, chunk):
        last = s + chunk >= stop
        yield s, text[s:] if last else text[s : s + chunk + overlap], last


def encode(docs: DataFrame, rank_file: bytes, pattern: str, emit: Callable[[Coder, Iterator[bytes]], tuple], schema: str, doc_id: str = "doc_id", text: str = "text", chunk: int = 1_024, overlap: int = 64, dealt: int = 65_536) -> DataFrame:
    """doc_id and what emit makes of each text's ids, which it gets piecewise, as columns of schema.

    chunk, overlap, dealt: characters. emit runs on executors; `digests` and `token_ids` are two."""
    shared = docs.sparkSession.sparkContext.broadcast(rank_file)
    kind = docs.schema[doc_id].dataType.simpleString()
    out, cut = f"doc_id {kind}, {schema}", "row long, k int, start long, last boolean, chunk string"
    names = [f.name for f in StructType.fromDDL(schema)]
    coded = f"row long, k int, doc_id {kind}, start long, end long, last boolean, sure int, bounds array<long>, at array<long>, ids binary"
    arrow, arrow_begun, arrow_coded = (to_arrow_schema(StructType.fromDDL(x)) for x in (out, f"{out}, {cut}", coded))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def batched(made: Iterator[dict], kind: pa.Schema, most: int = 500) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for row in made:
            held.append(row)
            if len(held) >= most:
                yield pa.RecordBatch.from_pylist(held, schema=kind)
                held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=kind)

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Finished rows of texts that are not dealt out, and the others' chunks."""
        coder = Coder(shared.value, pattern)

        def made() -> Iterator[dict]:
            for batch in batches:
                for row, key, whole in zip(batch["row"].to_pylist(), batch["doc_id"].to_pylist(), batch["text"], strict=True):
                    t = whole.as_py()
                    if len(t) > dealt + overlap:
                        for k, (s, c, last) in enumerate(chunks(t, dealt, overlap)):
                            yield {"doc_id": key, "row": row, "k": k, "start": s, "last": last, "chunk": c}
                        continue
                    parts = ((chunk_part(coder, c, s, last), last) for s, c, last in chunks(t, chunk, overlap))
                    yield {"doc_id": key, **dict(zip(names, emit(coder, stitch(coder, parts)), strict=True))}

        yield from batched(made(), arrow_begun)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(shared.value, pattern)
        made = (r | trimmed(chunk_part(coder, r.pop("chunk"), r["start"], r["last"]), overlap)._asdict() for batch in batches for r in batch.to_pylist())
        yield from batched(made, arrow_coded, 20)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(shared.value, pattern)

        def made() -> Iterator[dict]:
            of_text = (r for batch in batches for r in batch.to_pylist())
            for _, group in groupby(of_text, itemgetter("row")):
                first = next(group)
                parts = ((Part(*(r[f] for f in Part._fields)), r["last"]) for r in chain([first], group))
                yield {"doc_id": first["doc_id"], **dict(zip(names, emit(coder, stitch(coder, parts)), strict=True))}

        yield from batched(made(), arrow, 20)

    begun = materialize(rows.mapInArrow(begin, f"{out}, {cut}"), "begun")
    whole = begun.where("chunk is null").select("doc_id", *names)
    long = begun.where("chunk is not null").select("row", "k", "doc_id", "start", "last", "chunk")
    parts = long.repartition("row", "k").mapInArrow(code, coded)
    return whole.unionByName(parts.repartition("row").sortWithinPartitions("row", "k").mapInArrow(join, out))


def token_ids(coder: Coder, ids: Iterator[bytes]) -> tuple:
    """For schema "ids array<long>"."""
    return (np.frombuffer(b"".join(ids), "<u4").astype("int64").tolist(),)


def digests(coder: Coder, ids: Iterator[bytes]) -> tuple:
    """For schema DIGESTS: counts and hashes the ids, decodes them, and hashes the decoded bytes."""
    n, of_ids, of_bytes = 0, hashlib.sha256(), hashlib.sha256()
    for part in ids:
        n += len(part) // 4
        of_ids.update(part)
        of_bytes.update(coder.decode(part))
    return n, of_ids.hexdigest(), of_bytes.hexdigest()


DIGESTS = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def decode(encoded: DataFrame, rank_file: bytes, pattern: str, ids: str = "ids") -> DataFrame:
    """The rows with a column `decoded` (binary): the raw bytes of their ids, joined."""
    shared = encoded.sparkSession.sparkContext.broadcast(rank_file)

    @F.pandas_udf("binary")
    def decoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        coder = Coder(shared.value, pattern)
        for batch in batches:
            yield batch.map(lambda x: coder.decode(np.asarray([] if x is None else x, "<u4").tobytes()))

    return encoded.withColumn("decoded", decoded(ids))
