"""Metadata columns of many spectra to CBOR, leaf by leaf over flat Arrow buffers.

The bytes are those of document.build. What that refuses, or writes in a rare form, raises Unusual
here: such rows are for document.build, which knows the fault of each."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa

from mzframe.kernels import cbor, document

Part = list  # of bytes, or None where there is none


class Unusual(Exception):
    pass


def ends_of(column: pa.Array) -> np.ndarray:
    """Offsets of a column of lists or maps; the buffers of an empty one may be missing."""
    return column.offsets.to_numpy().astype("int64") if len(column) else np.zeros(1, "int64")


def part_of(column: pa.Array, values: pa.Array) -> pa.Array:
    """Of the values below a column of lists or maps, those of its own rows: a slice shares the values of the whole batch."""
    ends = ends_of(column)
    return values.slice(int(ends[0]), int(ends[-1] - ends[0]))


def _fields(column: pa.Array) -> dict[str, pa.Array]:
    return dict(zip([f.name for f in column.type], column.flatten(), strict=True))


def _below(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The elements of lists, none of which may be null, and where each list begins and ends among them."""
    ends = ends_of(column)
    held = part_of(column, column.values)
    if held.null_count or column.null_count and (np.diff(ends)[~_valid(column)] > 0).any():
        raise Unusual
    return held, ends - ends[0]


def _valid(column: pa.Array) -> np.ndarray:
    return column.is_valid().to_numpy(zero_copy_only=False)


def _raw(column: pa.Array) -> Part:
    """Texts as bytes."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_numpy(zero_copy_only=False).tolist()


def _cut(table: np.ndarray) -> np.ndarray:
    """The rows of a table of bytes, as objects."""
    raw, width = table.tobytes(), table.shape[1]
    out = np.empty(len(table), object)
    out[:] = [raw[k : k + width] for k in range(0, len(raw), width)]
    return out


def wholes(x: np.ndarray) -> np.ndarray:
    """64-bit integers."""
    out = np.empty(len(x), object)
    n, major = np.where(x < 0, -1 - x, x).astype("uint64"), np.where(x < 0, 32, 0).astype("uint8")
    size = np.searchsorted(np.array([24, 1 << 8, 1 << 16, 1 << 32], "uint64"), n, "right")
    for k, (code, width) in enumerate(((0, 0), (24, 1), (25, 2), (26, 4), (27, 8))):
        at = np.flatnonzero(size == k)
        if len(at):
            head = major[at] + (n[at].astype("uint8") if k == 0 else np.uint8(code))
            out[at] = _cut(np.concatenate([head[:, None], n[at].astype(">u8").view("uint8").reshape(-1, 8)[:, 8 - width :]], axis=1))
    return out


def floats(x: np.ndarray) -> np.ndarray:
    """Doubles, in the shortest width that holds each."""
    out = np.empty(len(x), object)
    with np.errstate(over="ignore"):
        half, single = x.astype("f2").astype("f8") == x, x.astype("f4").astype("f8") == x
    wide, nan = np.where(half, 0, np.where(single, 1, 2)), np.isnan(x)
    for k, (code, kind) in enumerate(((0xF9, ">f2"), (0xFA, ">f4"), (0xFB, ">f8"))):
        at = np.flatnonzero((wide == k) & ~nan)
        if len(at):
            packed = x[at].astype(kind)
            out[at] = _cut(np.concatenate([np.full((len(at), 1), code, "uint8"), packed.view("uint8").reshape(len(at), -1)], axis=1))
    out[nan] = b"\xf9\x7e\x00"
    return out


def texts(column: pa.Array) -> Part:
    return [None if x is None else cbor.head(3, len(x)) + x for x in _raw(column)]


def tagged(column: pa.Array) -> list:
    """Tagged values; None where there is none."""
    f = _fields(column)
    kinds = f["kind"].dictionary_encode()
    names, codes = kinds.dictionary.to_pylist(), kinds.indices.fill_null(-1).to_numpy(zero_copy_only=False)
    out = np.empty(len(column), object)
    for kind, name, form in (("int", "i", wholes), ("float", "d", floats), ("str", "s", None)):
        at = np.flatnonzero((codes == names.index(kind)) & _valid(f[name])) if kind in names else ()
        if len(at):
            held = f[name].take(pa.array(at))
            out[at] = form(held.to_numpy(zero_copy_only=False)) if form else np.array([*texts(held), None], object)[:-1]
    return out.tolist()


def _coded(column: pa.Array, form) -> tuple[list, np.ndarray]:  # noqa: ANN001
    """The form of each different text, and which one each row has; -1 for null."""
    coded = column.dictionary_encode()
    try:
        made = [form(x) for x in coded.dictionary.to_pylist()]
    except document.DocumentError as e:
        raise Unusual from e
    return made, coded.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype("int64")


def params(column: pa.Array) -> list[bytes]:
    """A map for each list of parameters; an empty one for null."""
    held, ends = _below(column)
    if not len(held):
        return [b"\xa0"] * len(column)
    f = _fields(held)
    keys, codes = _coded(f["accession"], document._key)
    if (codes < 0).any():
        raise Unusual
    units, of = _coded(f["unit_accession"], document._unit)
    units.append(None)
    values = tagged(f["value"])
    items = [keys[k] + (b"\xf6" if v is None else v if units[u] is None else b"\x82" + v + units[u]) for k, v, u in zip(codes.tolist(), values, of.tolist(), strict=True)]
    counts = np.diff(ends)
    if counts.max() > 1:
        rank = np.empty(len(keys), "int64")
        rank[sorted(range(len(keys)), key=lambda k: (len(keys[k]), keys[k]))] = np.arange(len(keys))
        rows = np.repeat(np.arange(len(column)), counts)
        order = np.lexsort((rank[codes], rows))
        if ((rows[1:] == rows[:-1]) & (rank[codes][order][1:] == rank[codes][order][:-1])).any():
            raise Unusual  # an accession stands twice
        items = [items[k] for k in order.tolist()]
    return _joined(5, items, ends)


def _joined(major: int, items: list[bytes], ends: np.ndarray) -> list[bytes]:
    ends = ends.tolist()
    return [cbor.head(major, b - a) + b"".join(items[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]


def listed(items: list[bytes], ends: np.ndarray) -> Part:
    """A list of the items between two ends each; None for an empty one."""
    if not items:
        return [None] * (len(ends) - 1)
    return [x if n else None for x, n in zip(_joined(4, items, ends), np.diff(ends).tolist(), strict=True)]


def maps(n: int, *fields: tuple[bytes, Part]) -> list[bytes]:
    """n maps of keys with values, in their order; without absent parts."""
    fields = [(k, v) for k, v in fields if any(x is not None for x in v)]
    count = sum((np.array([x is not None for x in v], "int64") for _, v in fields), np.zeros(n, "int64"))
    parts = [[b"" if x is None else k + x for x in v] for k, v in fields]
    return list(map(b"".join, zip([cbor.head(5, c) for c in count.tolist()], *parts, strict=True)))


def windows(column: pa.Array) -> Part:
    made = params(_fields(column)["params"])
    return [x if ok else None for x, ok in zip(made, _valid(column).tolist(), strict=True)] if column.null_count else made


def _windows_in(column: pa.Array) -> Part:
    held, ends = _below(column)
    return listed(windows(held) if len(held) else [], ends)


def users(column: pa.Array) -> Part:
    held, ends = _below(column)
    if not len(held):
        return [None] * len(column)
    f = _fields(held)
    names = texts(f["name"])
    units, of = _coded(f["unit_accession"], document._unit)
    units.append(None)
    if any(x is None or x == b"\x60" for x in names):
        raise Unusual
    return listed(maps(len(held), (b"an", names), (b"at", texts(f["type"])), (b"au", [units[u] for u in of.tolist()]), (b"av", tagged(f["value"]))), ends)


def scans(column: pa.Array, combined: pa.Array) -> Part:
    """The scans of each spectrum and how they were combined, as one map."""
    held, ends = _below(column)
    made: Part = [None] * len(column)
    if len(held):
        f = _fields(held)
        made = listed(maps(len(held), (b"\0", params(f["params"])), (b"\1", _windows_in(f["windows"])), (b"\2", users(f["user_params"]))), ends)
    if combined.null_count == len(combined):
        return [None if s is None else b"\xa1as" + s for s in made]
    tails, of = _coded(_fields(combined)["accession"], _tail)
    if ((of < 0) & _valid(combined)).any():
        raise Unusual
    tails.append(None)
    return [(None if s is None else b"\xa1as" + s) if tails[c] is None else b"\xa2ac" + tails[c] + b"as" + (s or b"\x80") for s, c in zip(made, of.tolist(), strict=True)]


def _tail(accession: str) -> bytes:
    m = re.fullmatch(r"[^:]*:([0-9]+)", document._accession(accession))
    if not m:
        raise Unusual
    return cbor.dumps(int(m[1]))


def precursors(column: pa.Array) -> Part:
    held, ends = _below(column)
    if not len(held):
        return [None] * len(column)
    f = _fields(held)
    return listed(maps(len(held), (b"\0", windows(f["isolation_window"])), (b"\1", _windows_in(f["selected_ions"])), (b"\2", windows(f["activation"]))), ends)


def products(column: pa.Array) -> Part:
    held, ends = _below(column)
    return listed(maps(len(held), (b"\0", windows(_fields(held)["isolation_window"]))), ends) if len(held) else [None] * len(column)


def documents(columns: dict[str, pa.Array], descriptors: list[bytes], counts: np.ndarray) -> list[bytes]:
    """Documents of spectra, whose descriptors lie side by side, `counts` of them for each."""
    n = len(counts)
    own = columns["params"]
    some = np.diff(ends_of(own)) > 0
    return maps(
        n,
        (b"\0", wholes(columns["default_array_length"].fill_null(0).to_numpy(zero_copy_only=False).astype("int64")).tolist()), (b"\1", texts(columns["id"])),
        (b"\2", [x if k else None for x, k in zip(params(own), some.tolist(), strict=True)]), (b"\3", scans(columns["scans"], columns["scan_combination"])),
        (b"\4", precursors(columns["precursors"])), (b"\5", products(columns["products"])),
        (b"\6", _joined(4, descriptors, np.concatenate([[0], np.cumsum(counts)]))), (b"\7", texts(columns["interp"])), (b"\x08", users(columns["user_params"])),
    )
