"""CBOR (RFC 8949) in the deterministic form that tokens use, and a strict one-pass reader."""

from __future__ import annotations

import math
import struct
from collections.abc import Callable
from functools import lru_cache

from mzframe import registry as R


class CborError(ValueError):
    pass


@lru_cache(8192)
def head(major: int, n: int) -> bytes:
    if n < 24:
        return bytes([major << 5 | n])
    for code, size in ((24, 1), (25, 2), (26, 4), (27, 8)):
        if n < 1 << 8 * size:
            return bytes([major << 5 | code]) + n.to_bytes(size, "big")
    raise CborError("integer beyond 64 bits")


def _float(x: float) -> bytes:
    """The shortest width that holds the value."""
    if math.isnan(x):
        return b"\xf9\x7e\x00"
    for head, form in ((b"\xf9", ">e"), (b"\xfa", ">f")):
        try:
            packed = struct.pack(form, x)
        except OverflowError:
            continue
        if struct.unpack(form, packed)[0] == x:
            return head + packed
    return b"\xfb" + struct.pack(">d", x)


def mapping(parts: dict[bytes, bytes]) -> bytes:
    """A map of encoded keys and values. Keys are sorted by length of their encoding, then bytewise."""
    keys = sorted(parts) if len({len(k) for k in parts}) < 2 else sorted(parts, key=lambda k: (len(k), k))
    return head(5, len(parts)) + b"".join([k + parts[k] for k in keys])


def _text(x: str) -> bytes:
    raw = x.encode()
    return head(3, len(raw)) + raw


FORMS = {
    type(None): lambda x: b"\xf6",
    bool: lambda x: b"\xf5" if x else b"\xf4",
    int: lambda x: head(0, x) if x >= 0 else head(1, -1 - x),
    float: _float,
    bytes: lambda x: head(2, len(x)) + x,
    str: _text,
    list: lambda x: head(4, len(x)) + b"".join(map(dumps, x)),
    tuple: lambda x: head(4, len(x)) + b"".join(map(dumps, x)),
    dict: lambda x: mapping({dumps(k): dumps(v) for k, v in x.items()}),
}


def dumps(x: object) -> bytes:
    """Map keys are sorted by length of their encoding, then bytewise."""
    form = FORMS.get(type(x)) or next((f for kind, f in FORMS.items() if isinstance(x, kind)), None)
    if form is None:
        raise CborError(f"no CBOR form for {type(x).__name__}")
    return form(x)


def loads(raw: bytes, known: Callable | None = None) -> object:
    """One item that fills the bytes; bounded in size, items and depth.

    known: looks at a map in a list of the outermost map first, from (bytes, where it begins); gives the
    map, the place behind it and its number of items, or None for a map that is to be read as any other."""
    size, at, items = len(raw), 0, 0
    if size > R.MAX_PAYLOAD_BYTES:
        raise CborError("payload is too large")

    def take(n: int) -> bytes:
        nonlocal at
        if at + n > size:
            raise CborError("truncated document")
        at += n
        return raw[at - n : at]

    def pairs(n: int, depth: int) -> dict:
        nonlocal at, items
        out: dict = {}
        for _ in range(n):
            if at < size and raw[at] < 24:  # keys of one byte
                key = raw[at]
                at += 1
                items += 1
            else:
                key = item(depth)
            if not isinstance(key, (int, str)) or isinstance(key, bool):
                raise CborError("a map key is neither integer nor text")
            if key in out:
                raise CborError("duplicate map key")
            out[key] = item(depth)
        return out

    def item(depth: int) -> object:
        nonlocal at, items
        items += 1
        if items > R.MAX_ITEMS:
            raise CborError("too many items")
        if depth > R.MAX_DEPTH:
            raise CborError("nested too deeply")
        if at >= size:
            raise CborError("truncated document")
        first = raw[at]
        at += 1
        major, code = first >> 5, first & 31
        if code > 27:
            raise CborError("indefinite or reserved length")
        n = code if code < 24 else int.from_bytes(take(1 << code - 24), "big")
        if major == 0:
            return n
        match major:
            case 1:
                return -1 - n
            case 2:
                return take(n)
            case 3:
                try:
                    return take(n).decode()
                except UnicodeDecodeError as e:
                    raise CborError("text is not UTF-8") from e
            case 4:
                return [item(depth + 1) for _ in range(n)]
            case 5:
                if known and depth == 2 and (found := known(raw, at - 1)):
                    out, at, more = found
                    items += more
                    if items > R.MAX_ITEMS:
                        raise CborError("too many items")
                    return out
                return pairs(n, depth + 1)
            case 6:
                raise CborError("tags are not supported")
        if code in (25, 26, 27):
            return struct.unpack({25: ">e", 26: ">f", 27: ">d"}[code], n.to_bytes(1 << code - 24, "big"))[0]
        if n in (20, 21, 22, 23):
            return {20: False, 21: True}.get(n)
        raise CborError("unknown simple value")

    out = item(0)
    if at != size:
        raise CborError("trailing bytes after the document")
    return out
