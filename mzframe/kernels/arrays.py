"""Array codecs: raw little-endian values, byte shuffling, and the three numeric transforms, under zlib or zstd.

The transforms follow their public description (numpress): fixed point first as a big-endian
double; linear predicts each code from the two before it and writes the residuals, pic writes the
codes, both as runs of half bytes headed by how many leading half bytes are left out; slof writes
16-bit logarithms."""

from __future__ import annotations

import struct
import zlib
from functools import cache, lru_cache

import numpy as np

from mzframe import registry as R

NUMPY = {R.FLOAT64: "<f8", R.FLOAT32: "<f4", R.INT32: "<i4"}


class CodecError(ValueError):
    pass


def _starts(sizes: np.ndarray) -> np.ndarray:
    return np.cumsum(sizes) - sizes


def _cut(raw: bytes, sizes: np.ndarray) -> list[bytes]:
    ends = np.cumsum(sizes).tolist()
    return [raw[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def half_bytes_of(codes: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """Every 32-bit code of arrays that lie side by side as half bytes, the low one first. The head tells how
    many leading half bytes of zeros (0-8) or, plus 8, of ones (1-7) are left out. Each array fills whole bytes."""
    c = codes.astype("int64") & 0xFFFFFFFF
    nibbles = (c[:, None] >> np.arange(0, 32, 4)) & 15  # low first
    ones = nibbles[:, 7] == 15
    same = nibbles[:, ::-1] == np.where(ones, 15, 0)[:, None]
    lead = np.where(same.all(1), 8, same.argmin(1))
    lead = np.where(ones, np.minimum(lead, 7), np.where(nibbles[:, 7] == 0, lead, 0))
    table = np.concatenate([np.where(ones, lead + 8, lead)[:, None], nibbles], axis=1)
    flat = table[np.arange(9) <= (8 - lead)[:, None]].astype("uint8")
    used = np.bincount(np.repeat(np.arange(len(sizes)), sizes), 9 - lead, len(sizes)).astype("int64")
    odd = used % 2
    out = np.zeros(int((used + odd).sum()), "uint8")
    out[np.arange(len(flat)) + np.repeat(np.cumsum(odd) - odd, used)] = flat
    return _cut((out[0::2] << 4 | out[1::2]).tobytes(), (used + odd) // 2)


def half_bytes(codes: np.ndarray) -> bytes:
    return half_bytes_of(codes, np.array([len(codes)]))[0]


def from_half_bytes_of(raws: list[bytes], most: list[int]) -> tuple[np.ndarray, np.ndarray, list[bool]]:
    """The signed 32-bit codes of arrays side by side, how many each has, and which are well formed (others
    have none). A last half byte of zero is padding. Only the walk from head to head goes code by code."""
    packed = np.frombuffer(b"".join(raws), "uint8")
    flat = np.stack([packed >> 4, packed & 15], axis=1).reshape(-1)
    size = 9 - np.where(flat <= 8, flat, flat - 8).astype("int64")
    after = (np.arange(len(flat)) + size).tolist()
    stops = (2 * np.cumsum([len(r) for r in raws])).tolist()
    heads: list[int] = []
    counts, fine, at = [], [], 0
    for start, stop, n in zip([0, *stops], stops, most, strict=False):
        at, before = start, len(heads)
        end = stop - 1 if stop > start and flat[stop - 1] == 0 else stop
        while at < end:
            heads.append(at)
            at = after[at]
        ok = at <= stop and len(heads) - before <= n
        if not ok:
            del heads[before:]
        counts.append(len(heads) - before)
        fine.append(ok)
    k, places = np.array(heads, "int64"), np.arange(8)
    held = size[k] - 1
    nibbles = np.append(flat, np.zeros(9, "uint8")).astype("int64")[k[:, None] + 1 + places]
    filled = np.where(places < held[:, None], nibbles, np.where(flat[k] > 8, 15, 0)[:, None])
    codes = (filled << 4 * places).sum(1)
    return np.where(codes >= 1 << 31, codes - (1 << 32), codes), np.array(counts, "int64"), fine


def from_half_bytes(raw: bytes, most: int) -> np.ndarray:
    codes, _, fine = from_half_bytes_of([raw], [most])
    if not fine[0]:
        raise CodecError("half-byte data is malformed")
    return codes


def _linear(x: np.ndarray, sizes: np.ndarray, fps: np.ndarray) -> list[bytes | CodecError]:
    codes = np.floor(x * np.repeat(fps, sizes) + 0.5).astype("int64")
    place = np.arange(len(x)) - np.repeat(_starts(sizes), sizes)
    steps = np.zeros(len(x), "int64")
    steps[2:] = codes[2:] - 2 * codes[1:-1] + codes[:-2]
    first = place < 2
    large = np.where(first, codes >= 1 << 32, np.abs(steps) >= 1 << 31)
    bad = np.bincount(np.repeat(np.arange(len(sizes)), sizes), large, len(sizes)) > 0
    heads = _cut(codes[first].astype("<u4").tobytes(), 4 * np.minimum(sizes, 2))
    tails = half_bytes_of(steps[~first], np.maximum(sizes - 2, 0))
    return [CodecError("values are too large for the linear transform") if b else struct.pack(">d", fp) + h + t for b, fp, h, t in zip(bad, fps, heads, tails, strict=True)]


def _slof(x: np.ndarray, sizes: np.ndarray, fps: np.ndarray) -> list[bytes | CodecError]:
    codes = np.floor(np.log(x + 1) * np.repeat(fps, sizes) + 0.5).astype("int64")
    bad = np.bincount(np.repeat(np.arange(len(sizes)), sizes), codes > 0xFFFF, len(sizes)) > 0
    parts = _cut(codes.astype("<u2").tobytes(), 2 * sizes)
    return [CodecError("the fixed point is too large for the values") if b else struct.pack(">d", fp) + c for b, fp, c in zip(bad, fps, parts, strict=True)]


def _pic(x: np.ndarray, sizes: np.ndarray, fps: np.ndarray) -> list[bytes | CodecError]:
    return half_bytes_of(np.floor(x + 0.5), sizes)


def _from_linear(raws: list[bytes], fps: np.ndarray, most: list[int]) -> list[np.ndarray | CodecError]:
    steps, counts, fine = from_half_bytes_of([r[16:] for r in raws], most)
    firsts = np.array([min(2, (len(r) - 8) // 4) for r in raws])
    sizes = firsts + counts
    place = np.arange(sizes.sum()) - np.repeat(_starts(sizes), sizes)
    first = np.frombuffer(b"".join(r[8 : 8 + 4 * k] for r, k in zip(raws, firsts.tolist(), strict=True)), "<u4").astype("int64")
    base = np.zeros(len(place), "int64")
    base[place < 2] = first
    changes = np.zeros(len(place), "int64")
    changes[place >= 2] = steps
    second = np.flatnonzero(place == 1)
    changes[second] = base[second] - base[second - 1]
    for start in (np.zeros(len(place), "int64"), np.where(place == 0, base, 0)):  # the sums of the changes, then the codes
        changes = np.where(place == 0, start, changes)
        total = np.cumsum(changes)
        begins = np.flatnonzero(place == 0)
        changes = total - np.repeat(total[begins] - changes[begins], sizes[sizes > 0])
    return _arrays(changes / np.repeat(fps, sizes), sizes, fine)


def _from_slof(raws: list[bytes], fps: np.ndarray, most: list[int]) -> list[np.ndarray | CodecError]:
    sizes = np.array([(len(r) - 8) // 2 for r in raws])
    codes = np.frombuffer(b"".join(r[8:] for r in raws), "<u2")
    return _arrays(np.exp(codes / np.repeat(fps, sizes)) - 1, sizes, [True] * len(raws))


def _from_pic(raws: list[bytes], fps: np.ndarray, most: list[int]) -> list[np.ndarray | CodecError]:
    codes, sizes, fine = from_half_bytes_of(raws, most)
    return _arrays((codes & 0xFFFFFFFF).astype(float), sizes, fine)


def _arrays(flat: np.ndarray, sizes: np.ndarray, fine: list[bool]) -> list[np.ndarray | CodecError]:
    ends = np.cumsum(sizes).tolist()
    return [flat[a:b] if ok else CodecError("half-byte data is malformed") for a, b, ok in zip([0, *ends], ends, fine, strict=False)]


ENCODERS = {**dict.fromkeys(R.LINEAR, _linear), **dict.fromkeys(R.SLOF, _slof), **dict.fromkeys(R.PIC, _pic)}
DECODERS = {**dict.fromkeys(R.LINEAR, _from_linear), **dict.fromkeys(R.SLOF, _from_slof), **dict.fromkeys(R.PIC, _from_pic)}
PLAIN = (R.ZLIB, R.ZSTD, R.SHUFFLED_ZSTD)
DEFLATED = (R.ZLIB, R.LINEAR_ZLIB, R.SLOF_ZLIB, R.PIC_ZLIB)


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places that ranges cover, side by side."""
    return np.arange(int(sizes.sum())) + np.repeat(starts - _starts(sizes), sizes)


def _planes(sizes: np.ndarray, width: int) -> np.ndarray:
    """Where the bytes of each value stand when each array has the first bytes of its values first, then the second ones and so on."""
    place = np.arange(int(sizes.sum())) + np.repeat(_starts(sizes) * (width - 1), sizes)
    return place[:, None] + np.repeat(sizes, sizes)[:, None] * np.arange(width)


def _shuffle_many(values: np.ndarray, sizes: np.ndarray) -> bytes:
    out = np.empty(values.nbytes, "uint8")
    out[_planes(sizes, values.dtype.itemsize).reshape(-1)] = values.view("uint8")
    return out.tobytes()


def _from_plain(raws: list[bytes], comp: int, kind: int) -> list[np.ndarray]:
    """The values of arrays without transform, each of whole values."""
    width = np.dtype(NUMPY[kind]).itemsize
    sizes, raw = np.array([len(r) for r in raws]) // width, b"".join(raws)
    if comp == R.SHUFFLED_ZSTD:
        raw = np.frombuffer(raw, "uint8")[_planes(sizes, width)].tobytes()
    return _arrays(np.frombuffer(raw, NUMPY[kind]).astype(float), sizes, [True] * len(raws))


_deflated_before = lru_cache(32_768)(zlib.compress)


def _deflated(raw: bytes) -> bytes:
    """Short arrays, such as charges, are often alike, and a compressor costs much to set up."""
    return _deflated_before(raw) if len(raw) <= 32 else zlib.compress(raw)


def encode_flat(x: np.ndarray, starts: np.ndarray, sizes: np.ndarray, comps: np.ndarray, kinds: np.ndarray, fps: np.ndarray) -> list[bytes | CodecError]:
    """For arrays that are ranges of one buffer, each with codec, type and fixed point (0 for none): its bytes,
    or why it has none. All arrays of a codec are transformed together; only the compressors go array by array."""
    out: list = [None] * len(starts)
    kept = comps.astype("int64") << 32 | kinds
    for pair in np.unique(kept).tolist():
        comp, kind = pair >> 32, pair & 0xFFFFFFFF
        at = np.flatnonzero(kept == pair)
        n = sizes[at]
        values = x[_ranges(starts[at], n)]
        made: list = [CodecError(f"unknown codec {comp}")] * len(at)
        if comp in ENCODERS:
            made = ENCODERS[comp](np.maximum(values, 0), n, np.maximum(fps[at], 1).astype(float))
            if (values < 0).any():
                negative = np.bincount(np.repeat(np.arange(len(n)), n), values < 0, len(n)) > 0
                made = [CodecError("negative values have no lossy form") if bad else raw for bad, raw in zip(negative, made, strict=True)]
        elif comp in PLAIN:
            raw = values.astype(NUMPY[kind])
            made = _cut(_shuffle_many(raw, n) if comp == R.SHUFFLED_ZSTD else raw.tobytes(), n * raw.dtype.itemsize)
        pack = _deflated if comp in DEFLATED else _zstd()[0].compress
        for i, raw in zip(at.tolist(), made, strict=True):
            out[i] = pack(raw) if type(raw) is bytes else raw
    return out


def encode_many(items: list[tuple]) -> list[bytes | CodecError]:
    """The same for (values, codec, type, fixed point) each."""
    held = [np.asarray(values, float) for values, _, _, _ in items]
    sizes = np.array([len(x) for x in held], "int64")
    comps, kinds, fps = (np.array([item[i] or 0 for item in items], "int64") for i in (1, 2, 3))
    return encode_flat(np.concatenate([np.zeros(0), *held]), _starts(sizes), sizes, comps, kinds, fps)


def encode(values: list, comp: int, kind: int, fp: int | None) -> bytes:
    return _sure(encode_many([(values, comp, kind, fp)])[0])


def _sure(x: object) -> object:
    if isinstance(x, CodecError):
        raise x
    return x


@cache
def _zstd() -> tuple:
    """A compressor and a decompressor, made once in each worker."""
    import zstandard

    return zstandard.ZstdCompressor(3, write_content_size=True), zstandard.ZstdDecompressor(), zstandard.ZstdError


def _inflate(data: bytes, comp: int, most: int) -> bytes:
    """At most `most` bytes, whatever the data claims."""
    _, unpack, fault = _zstd()
    try:
        if comp in DEFLATED:
            z = zlib.decompressobj()
            raw = z.decompress(data, most)
            if z.unconsumed_tail or not z.eof and z.decompress(b"", 1):
                raise CodecError("array is larger than its declared length allows")
            if not z.eof:
                raise CodecError("compressed data ends early")
            return raw
        reader = unpack.stream_reader(data)
        raw = reader.read(most + 1)
    except (zlib.error, fault) as e:
        raise CodecError(f"compressed data is malformed: {e}") from e
    if len(raw) > most:
        raise CodecError("array is larger than its declared length allows")
    return raw


def _opened(data: bytes, comp: int, kind: int, fp: int | None, n: int) -> bytes | CodecError:
    """The bytes that the compressor was given."""
    try:
        if comp not in DECODERS and comp not in PLAIN:
            raise CodecError(f"unknown codec {comp}")
        raw = _inflate(data, comp, min(64 + 16 * n, R.MAX_BLOB_BYTES))
        if comp in PLAIN:
            if len(raw) % np.dtype(NUMPY[kind]).itemsize:
                raise CodecError("array data is malformed: it does not end with a whole value")
            return raw
        if comp not in R.PIC and (len(raw) < 8 or struct.unpack(">d", raw[:8])[0] != fp):
            raise CodecError("declared and embedded fixed point differ")
        if comp in R.SLOF and len(raw) % 2:
            raise CodecError("slof data has an odd length")
    except (ValueError, struct.error) as e:
        # a new error: the caught one holds, by its traceback, the decompressor and its window of 32 KB
        return CodecError(str(e) if isinstance(e, CodecError) else f"array data is malformed: {e}")
    return raw


def _checked(x: np.ndarray | CodecError, n: int, finite: bool) -> np.ndarray | CodecError:
    if isinstance(x, CodecError):
        return x
    if len(x) != n:
        return CodecError(f"array has {len(x)} values instead of {n}")
    return x if finite or np.isfinite(x).all() else CodecError("array holds a value that is not finite")


#: Bytes under zlib that cannot become more than about a megabyte.
SHORT = 1_000


def plain_doubles(packed: list[bytes | None], sizes: list[int]) -> bytes | None:
    """The values, side by side, of plain doubles under zlib, `sizes` of them in each; None if one is not as it should be."""
    out = []
    try:
        for data, n in zip(packed, sizes, strict=True):
            if data is not None:
                raw = zlib.decompress(data, bufsize=min(8 * n + 1, 65_536)) if len(data) <= SHORT else _inflate(data, R.ZLIB, min(64 + 16 * n, R.MAX_BLOB_BYTES))
                if len(raw) != 8 * n:
                    return None
                out.append(raw)
    except (zlib.error, CodecError):
        return None
    raw = b"".join(out)
    return raw if np.isfinite(np.frombuffer(raw, "<f8")).all() else None


def decode_many(items: list[tuple]) -> list[np.ndarray | CodecError]:
    """For (bytes, codec, type, fixed point, length) each: the values as doubles, or why there are none. A fixed
    point in the data must be the declared one. All arrays of a codec are transformed together."""
    out: list = [_opened(*item) for item in items]
    groups: dict = {}
    for i, (raw, item) in enumerate(zip(out, items, strict=True)):
        if type(raw) is bytes:
            groups.setdefault(DECODERS.get(item[1]) or (item[1], item[2]), []).append(i)
    for transform, members in groups.items():
        raws = [out[i] for i in members]
        if isinstance(transform, tuple):
            made = _from_plain(raws, *transform)
        else:
            made = transform(raws, np.array([items[i][3] or 1 for i in members], float), [items[i][4] for i in members])
        for i, x in zip(members, made, strict=True):
            out[i] = x
    held = [x for x in out if isinstance(x, np.ndarray)]
    finite = bool(np.isfinite(np.concatenate(held)).all()) if held else True  # as a rule, so that it is asked once
    return [_checked(x, item[4], finite) for x, item in zip(out, items, strict=True)]


def decode(data: bytes, comp: int, kind: int, fp: int | None, n: int) -> np.ndarray:
    return _sure(decode_many([(data, comp, kind, fp, n)])[0])
