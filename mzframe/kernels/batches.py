"""Arrow batches to documents and back: the flat buffers of a column's lists are read in place, a row
at a time only where bytes are compressed or parsed."""

from __future__ import annotations

import base64
import binascii
import gc
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute

from mzframe import registry as R
from mzframe.kernels import arrays, cbor, document
from mzframe.kernels import columns as columns_of
from mzframe.kernels.columns import ends_of, part_of

FAULTS = (document.DocumentError, cbor.CborError, arrays.CodecError)
CORE = ("mz", "intensity", "charge")


def _with_errors(made: list, kind: pa.StructType) -> pa.Array:
    """made: a value or an error's text (an Exception) for each row; None for a null one."""
    errors = [str(x) if isinstance(x, Exception) else None for x in made]
    values = [None if isinstance(x, Exception) else x for x in made]
    null = pa.array([x is None for x in made], pa.bool_())
    return pa.StructArray.from_arrays([pa.array(values, kind[0].type), pa.array(errors, kind[1].type)], fields=list(kind), mask=null)


def _tried(f: Callable, *args: object) -> object:
    """The result, or its fault: a new one, as the caught one holds all that was at work by its traceback."""
    try:
        return f(*args)
    except FAULTS as e:
        return type(e)(str(e))


def plain_rows(column: pa.Array) -> list:
    """The same as to_pylist, from the flat buffers of the leaves."""
    kind = column.type
    if not len(column):
        return []  # whose buffers may be missing
    if column.null_count == len(column):
        return [None] * len(column)
    if pa.types.is_struct(kind):
        names, fields = [f.name for f in kind], [plain_rows(c) for c in column.flatten()]
        out = [dict(zip(names, x, strict=True)) for x in zip(*fields, strict=True)]
    elif pa.types.is_list(kind):
        ends = column.offsets.to_numpy()
        held = plain_rows(column.values.slice(int(ends[0]), int(ends[-1] - ends[0])))
        ends = (ends - ends[0]).tolist()
        out = [held[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
    elif column.null_count and not (pa.types.is_string(kind) or pa.types.is_binary(kind)):
        return column.to_pylist()
    else:
        return column.to_numpy(zero_copy_only=False).tolist()
    if column.null_count:
        out = [x if ok else None for x, ok in zip(out, column.is_valid().to_numpy(zero_copy_only=False).tolist(), strict=True)]
    return out


#: Rows that a UDF holds as Python objects at a time; Spark's batches are larger.
SLICE = 1_000


def sliced(f: Callable, *columns: pa.Array) -> pa.Array:
    """f over a batch, a slice at a time, so that memory does not go by the size of Spark's batches."""
    n = len(columns[0])
    if n <= SLICE:
        return _uncollected(f, *columns)
    return pa.concat_arrays([_uncollected(f, *(c.slice(i, SLICE) for c in columns)) for i in range(0, n, SLICE)])


def _uncollected(f: Callable, *columns: pa.Array) -> pa.Array:
    """f without the collector of cycles, which would walk the many small objects of a slice again and again."""
    on = gc.isenabled()
    gc.disable()
    try:
        return f(*columns)
    finally:
        if on:
            gc.enable()


def build(rows: pa.Array, kind: pa.StructType) -> pa.Array:
    """Documents of spectra, which are structs of their columns and `plan`."""
    return _with_errors(_documents(rows), kind)


def build_tokens(rows: pa.Array, kind: pa.StructType, magic: str) -> pa.Array:
    """The same as tokens: identifier, document in base64url and CRC-32, with points between."""
    made = [_token(x, magic) if isinstance(x, bytes) else x for x in _documents(rows)]
    return _with_errors(made, kind)


def _token(raw: bytes, magic: str) -> bytes | document.DocumentError:
    if len(raw) > R.MAX_PAYLOAD_BYTES:
        return document.DocumentError("payload is too large")
    body = magic.encode() + b"." + binascii.b2a_base64(raw, newline=False).translate(TO_URL).rstrip(b"=")
    return b"%s.%08x" % (body, zlib.crc32(body))


TO_URL, FROM_URL = bytes.maketrans(b"+/", b"-_"), bytes.maketrans(b"-_", b"+/")
ALPHABET = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"
DIGITS = b"0123456789abcdef"


def payload(token: bytes | None, magic: bytes) -> bytes:
    """The document of a token. Its faults, in the order of functions.tokens.token_error, are DocumentErrors."""

    fault = None
    if token is None:
        fault = "null token"
    elif not token.isascii():
        fault = "token is not ASCII"
    elif not token.startswith(magic + b"."):
        fault = "wrong magic or version"
    elif token.count(b".") != magic.count(b".") + 2:
        fault = "wrong number of parts"
    else:
        body, _, stored = token.rpartition(b".")
        text = body[len(magic) + 1 :]
        bare = text.rstrip(b"=")
        if len(stored) != 8 or stored.translate(None, DIGITS):
            fault = "malformed checksum"
        elif zlib.crc32(body) != int(stored, 16):
            fault = "checksum mismatch"
        elif len(text) - len(bare) > 2 or len(bare) % 4 == 1 or bare.translate(None, ALPHABET):
            fault = "invalid base64url payload"
    if fault:
        raise document.DocumentError(fault)
    return binascii.a2b_base64(bare.translate(FROM_URL) + b"=" * (-len(bare) % 4))


def parse_tokens(tokens: pa.Array, kind: pa.StructType, magic: str) -> pa.Array:
    """Headers of tokens, given as bytes; arrays stay compressed."""
    mark = magic.encode()
    return _with_errors([_tried(lambda t: document.parse(payload(t, mark)), t) for t in plain_rows(tokens)], kind)


#: A plan's entry in the order of document.described, and metadata of a spectrum in that of document.build.
PLAN = ("type", "array", "comp", "fp", "name", "unit")
META = ("default_array_length", "id", "params", "scans", "scan_combination", "precursors", "products", "interp", "user_params")


def _documents(rows: pa.Array) -> list:
    """For each spectrum its document, an exception, or None for a null row.

    Where the values of each array of the plan lie in the flat buffers is worked out for all rows at once."""
    columns = dict(zip([f.name for f in rows.type], rows.flatten(), strict=True))
    valid, n = rows.is_valid().to_numpy(zero_copy_only=False), len(rows)
    extra, plan = columns["extra_arrays"], columns["plan"]
    x, starts, sizes = _values_of([*(columns[c] for c in CORE), part_of(extra, extra.items).field("values")])

    counts = np.where(valid, np.diff(ends_of(plan)), 0)
    entries = part_of(plan, plan.values)
    if counts.sum() != len(entries):  # what lies below null rows is passed over
        entries = entries.take(pa.array(arrays._ranges(ends_of(plan)[:-1] - ends_of(plan)[0], counts)))
    fields = dict(zip([f.name for f in entries.type], entries.flatten(), strict=True))
    keys = pa.concat_arrays([pa.array(CORE, fields["key"].type), part_of(extra, extra.keys), fields["key"]]).dictionary_encode()
    codes, n_keys = keys.indices.to_numpy().astype("int64"), len(keys.dictionary)
    n_extra = len(codes) - len(CORE) - len(entries)
    of_rows = np.repeat(np.arange(n), np.diff(ends_of(extra)))
    # a row's arrays by key: its own core arrays first, whose place extra arrays of their name would take
    ids = np.concatenate([*(np.arange(n) * n_keys + codes[k] for k in range(len(CORE))), of_rows * n_keys + codes[len(CORE) : len(CORE) + n_extra]])
    order = np.argsort(ids, kind="stable")
    wanted = np.repeat(np.arange(n), counts) * n_keys + codes[len(CORE) + n_extra :]
    at = order[np.searchsorted(ids[order], wanted, "right") - 1]
    if (ids[at] != wanted).any():
        raise KeyError("the plan names an array that the spectrum lacks")

    comps, kinds = (fields[c].to_numpy(zero_copy_only=False) for c in ("comp", "type"))
    data = arrays.encode_flat(x, starts[at], sizes[at], comps, kinds, fields["fp"].fill_null(0).to_numpy(zero_copy_only=False))
    try:
        if columns["default_array_length"].null_count > rows.null_count:
            raise columns_of.Unusual
        made = columns_of.documents(columns, _descriptors(fields, data), counts)
    except columns_of.Unusual:
        made = _documents_by_row(columns, fields, data, counts, valid)
    return made if valid.all() else [x if ok else None for x, ok in zip(made, valid.tolist(), strict=True)]


def _descriptors(fields: dict[str, pa.Array], data: list) -> list[bytes]:
    """The descriptors of arrays; what stands around their bytes is made once for each different plan."""
    ids = np.zeros(len(data), "int64")
    for name in PLAN:
        coded = fields[name].dictionary_encode()
        ids = np.unique(ids * (len(coded.dictionary) + 1) + coded.indices.fill_null(len(coded.dictionary)).to_numpy(zero_copy_only=False), return_inverse=True)[1]
    _, first = np.unique(ids, return_index=True)
    try:
        around = [document._around(*plan) for plan in zip(*(plain_rows(fields[c].take(pa.array(first))) for c in PLAN), strict=True)]
    except document.DocumentError as e:
        raise columns_of.Unusual from e
    if not all(type(raw) is bytes for raw in data):
        raise columns_of.Unusual
    around = [around[k] for k in ids.tolist()]
    return [front + cbor.head(2, len(raw)) + raw + behind for (front, behind), raw in zip(around, data, strict=True)]


def _documents_by_row(columns: dict[str, pa.Array], fields: dict[str, pa.Array], data: list, counts: np.ndarray, valid: np.ndarray) -> list:
    """The same with the fault of each row that has one."""
    plans = zip(*(plain_rows(fields[c]) for c in PLAN), strict=True)
    parts = list(map(document.described, plans, data))
    ends = np.cumsum(counts).tolist()
    meta = zip(*(plain_rows(columns[c]) for c in META), strict=True)
    return [_tried(document.build, *row, parts[a:b]) if ok else None for ok, row, a, b in zip(valid.tolist(), meta, [0, *ends], ends, strict=False)]


def _values_of(columns: list[pa.Array]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The flat values of columns of lists, one after the other, with the start and size of each list; null values are NaN."""
    flat, starts, sizes, base = [], [], [], 0
    for c in columns:
        ends = ends_of(c)
        flat.append(part_of(c, c.values).to_numpy(zero_copy_only=False))
        starts.append(ends[:-1] - ends[0] + base)
        sizes.append(np.diff(ends))
        base += int(ends[-1] - ends[0])
    return np.concatenate(flat).astype(float, copy=False), np.concatenate(starts), np.concatenate(sizes)


def parse(raw: pa.Array, kind: pa.StructType) -> pa.Array:
    """Headers of documents; arrays stay compressed."""
    return _with_errors([None if x is None else _tried(document.parse, x) for x in raw.to_pylist()], kind)


def inflate(descriptors: pa.Array, lengths: pa.Array, kind: pa.StructType) -> pa.Array:
    """The values of one array for each row, as a flat buffer with offsets."""
    fields = dict(zip([f.name for f in descriptors.type], descriptors.flatten(), strict=True))
    if (plain := _inflated(fields, lengths, kind)) is not None:
        return plain
    parts = list(zip(*(plain_rows(fields[n]) for n in ("data", "comp", "type", "fp")), plain_rows(lengths), strict=True))
    found = iter(arrays.decode_many([p for p in parts if p[0] is not None]))
    made = [None if p[0] is None else next(found) for p in parts]
    fine = [isinstance(x, np.ndarray) for x in made]
    sizes = [len(x) if ok else 0 for x, ok in zip(made, fine, strict=True)]
    flat = np.concatenate([x for x, ok in zip(made, fine, strict=True) if ok] or [np.zeros(0)])
    offsets = np.concatenate([[0], np.cumsum(sizes, dtype="int32")]).astype("int32")
    null = pa.array([not ok for ok in fine], pa.bool_())
    values = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.float64()), kind.field("values").type, mask=null)
    errors = pa.array([str(x) if isinstance(x, Exception) else None for x in made], pa.string())
    return pa.StructArray.from_arrays([values, errors], fields=list(kind))


def _inflated(fields: dict[str, pa.Array], lengths: pa.Array, kind: pa.StructType) -> pa.Array | None:
    """inflate() of arrays that are all plain doubles under zlib, and all good; None for others."""
    held = fields["data"].is_valid()
    comps, kinds = (fields[n].filter(held).unique().to_pylist() for n in ("comp", "type"))
    if comps != [R.ZLIB] or kinds != [R.FLOAT64]:
        return None
    sizes = np.where(held.to_numpy(zero_copy_only=False), lengths.fill_null(0).to_numpy(zero_copy_only=False), 0)
    raw = arrays.plain_doubles(plain_rows(fields["data"]), sizes.tolist())
    if raw is None:
        return None
    offsets = np.concatenate([[0], np.cumsum(sizes, dtype="int64")])
    if offsets[-1] >= 1 << 31:
        return None
    values = pa.ListArray.from_arrays(pa.array(offsets.astype("int32")), pa.Array.from_buffers(pa.float64(), int(offsets[-1]), [None, pa.py_buffer(raw)]), kind.field("values").type, mask=pa.compute.invert(held))
    return pa.StructArray.from_arrays([values, pa.nulls(len(values), kind.field("error").type)], fields=list(kind))


def inflate_lists(descriptors: pa.Array, lengths: pa.Array, kind: pa.StructType) -> pa.Array:
    """The same for a list of arrays for each row; a row's error is that of its first bad array."""
    offsets = descriptors.offsets.to_numpy().astype("int32")
    inner = pa.struct([pa.field("values", kind.field("values").type.value_type), pa.field("error", pa.string())])
    each = descriptors.values.slice(int(offsets[0]), int(offsets[-1] - offsets[0]))
    found = inflate(each, pa.array(np.repeat(lengths.fill_null(0).to_numpy(zero_copy_only=False), np.diff(offsets))), inner)
    texts, offsets = found.field("error").to_pylist(), offsets - offsets[0]
    errors = [next((e for e in texts[a:b] if e), None) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
    null = pa.array([e is not None or not ok for e, ok in zip(errors, descriptors.is_valid().to_pylist(), strict=True)], pa.bool_())
    values = pa.ListArray.from_arrays(pa.array(offsets), found.field("values"), kind.field("values").type, mask=null)
    return pa.StructArray.from_arrays([values, pa.array(errors, pa.string())], fields=list(kind))


def token_peaks(tokens: pa.Array, kind: pa.ListType, magic: str) -> pa.Array:
    """A list of (pos, mz, intensity, charge) for each token; null for a null one. The first fault is raised."""
    mark, texts = magic.encode(), plain_rows(tokens.cast(pa.binary()))
    headers = [None if t is None else document.parse(payload(t, mark)) for t in texts]
    sizes = np.array([h["default_array_length"] if h else 0 for h in headers], "int64")
    at = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    columns = [pa.array(at.astype("int32"))]
    for tail in CORE_TAILS:
        found = [next((d for d in h["descriptors"] if d["array"] == tail), None) if h else None for h in headers]
        columns.append(_flat(found, sizes))
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype("int32")
    null = pa.array([t is None for t in texts], pa.bool_())
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(columns, fields=list(kind.value_type)), type=kind, mask=null)


CORE_TAILS = (R.ARRAY_MZ, R.ARRAY_INTENSITY, R.ARRAY_CHARGE)


def _flat(found: list[dict | None], sizes: np.ndarray) -> pa.Array:
    """The values of an array of each spectrum, side by side; null where a spectrum has none."""
    held = np.array([d is not None for d in found], bool)
    there = [d for d in found if d is not None]
    if all(d["comp"] == R.ZLIB and d["type"] == R.FLOAT64 for d in there):
        raw = arrays.plain_doubles([d["data"] for d in there], sizes[held].tolist())
        values = None if raw is None else np.frombuffer(raw, "<f8")
    else:
        values = None
    if values is None:
        made = arrays.decode_many([(d["data"], d["comp"], d["type"], d["fp"], n) for d, n in zip(there, sizes[held].tolist(), strict=True)])
        values = np.concatenate([np.zeros(0), *map(arrays._sure, made)])
    if held.all():
        return pa.array(values, pa.float64())
    mask = np.repeat(~held, sizes)
    every = np.zeros(len(mask))
    every[~mask] = values
    return pa.array(every, pa.float64(), mask=mask)
