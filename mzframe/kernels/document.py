"""The CBOR document of a token: a map with integer keys for a spectrum's metadata and arrays."""

from __future__ import annotations

import re
import struct
from collections.abc import Callable
from functools import lru_cache

from mzframe import registry as R
from mzframe.kernels import arrays, cbor

ACCESSION = re.compile(r"[A-Za-z][A-Za-z0-9]*:[A-Za-z0-9]+")
SEVEN = re.compile(r"([^:]*):([0-9]{7})")


class DocumentError(ValueError):
    pass


# from rows to a document


def _accession(text: str) -> str:
    if not isinstance(text, str) or not ACCESSION.fullmatch(text):
        raise DocumentError(f"invalid accession {text!r}")
    return text


def _plain(v) -> object:  # noqa: ANN001
    return {"int": "i", "float": "d", "str": "s"}.get(v["kind"]) and v[{"int": "i", "float": "d", "str": "s"}[v["kind"]]] if v else None


def wire_unit(unit: str) -> object:
    m = SEVEN.fullmatch(_accession(unit))
    return unit if not m else int(m[2]) if m[1] == "UO" else [m[1], int(m[2])]


@lru_cache(65_536)
def _key(accession: str) -> bytes:
    m = SEVEN.fullmatch(_accession(accession))
    return cbor.dumps(int(m[2]) if m and m[1] == "MS" else accession)


@lru_cache(8192)
def _unit(unit: str) -> bytes:
    return cbor.dumps(wire_unit(unit))


def _params(params) -> bytes:  # noqa: ANN001
    out: dict[bytes, bytes] = {}
    for p in params or ():
        key = _key(p["accession"])
        if key in out:
            raise DocumentError(f"duplicate accession {p['accession']} in a parameter list")
        value, unit = _plain(p["value"]), p["unit_accession"]
        out[key] = cbor.dumps(value) if value is None or unit is None else b"\x82" + cbor.dumps(value) + _unit(unit)
    return cbor.mapping(out)


def _user(params) -> bytes | None:  # noqa: ANN001
    out = []
    for u in params or ():
        if not u["name"]:
            raise DocumentError("a user parameter has no name")
        fields = {"n": u["name"], "v": _plain(u["value"]), "t": u["type"], "u": u["unit_accession"] and wire_unit(u["unit_accession"])}
        out.append(cbor.dumps({k: v for k, v in fields.items() if v is not None}))
    return _items(out)


def _items(parts: list[bytes]) -> bytes | None:
    """A list of encoded items; none for an empty one."""
    return cbor.head(4, len(parts)) + b"".join(parts) if parts else None


def _of_window(w) -> bytes | None:  # noqa: ANN001
    return None if w is None else _params(w["params"])


def _map(*fields: tuple[int, bytes | None]) -> bytes:
    """A map with small integers, in their order, as keys; without absent parts."""
    held = [bytes([k]) + v for k, v in fields if v is not None]
    return cbor.head(5, len(held)) + b"".join(held)


@lru_cache(65_536)
def _around(kind: int, array: int, comp: int, fp: int | None, name: str | None, unit: str | None) -> tuple[bytes, bytes]:
    """What stands before and behind an array's bytes in its descriptor."""
    d = {R.DESC_TYPE: kind, R.DESC_ARRAY: array, R.DESC_COMP: comp, R.DESC_FP: fp, R.DESC_NAME: name, R.DESC_DATA: b"", R.DESC_UNIT: unit and wire_unit(unit)}
    held = [(k, cbor.dumps(v)) for k, v in d.items() if v is not None]
    part = lambda some: b"".join([bytes([k]) + v for k, v in held if some(k)])
    return cbor.head(5, len(held)) + part(lambda k: k < R.DESC_DATA) + bytes([R.DESC_DATA]), part(lambda k: k > R.DESC_DATA)


def described(e: tuple, data: bytes | arrays.CodecError) -> bytes | ValueError:
    """The descriptor of an array, or why there is none. e: type, array, codec, fixed point, name and unit of its plan."""
    if isinstance(data, arrays.CodecError):
        return data
    try:
        before, behind = _around(*e)
    except DocumentError as fault:
        return fault
    return b"".join([before, cbor.head(2, len(data)), data, behind])


def build(n: int, name: str | None, params, scans, combined, precursors, products, interp: str | None, users, descriptors: list) -> bytes:  # noqa: ANN001
    """A document of a spectrum's metadata and of its arrays' descriptors, any of which may be a fault instead."""
    listed = _items([_map((0, _params(s["params"])), (1, _items([_params(w["params"]) for w in s["windows"] or ()])), (2, _user(s["user_params"]))) for s in scans]) if scans else None
    if scans or combined is not None:
        parts = {b"as": listed or b"\x80"}
        if combined is not None:
            m = re.fullmatch(r"[^:]*:([0-9]+)", _accession(combined["accession"]))
            if not m:
                raise DocumentError("a scan combination has no numeric tail")
            parts[b"ac"] = cbor.dumps(int(m[1]))
        listed = cbor.mapping(parts)
    for d in descriptors:
        if type(d) is not bytes:
            raise d
    precursors = [_map((0, _of_window(p["isolation_window"])), (1, _items([_params(i["params"]) for i in p["selected_ions"] or ()])), (2, _of_window(p["activation"]))) for p in precursors] if precursors else ()
    products = [_map((0, _of_window(p["isolation_window"]))) for p in products] if products else ()
    text = lambda x: None if x is None else cbor.dumps(x)
    params = _params(params) if params else None
    return _map(
        (0, cbor.dumps(n)), (1, text(name)), (2, params), (3, listed), (4, _items(precursors)), (5, _items(products)),
        (6, _items(descriptors) or b"\x80"), (7, text(interp)), (8, _user(users) if users else None),
    )


# from a document to rows


def _check(ok: object, message: str) -> None:
    if not ok:
        raise DocumentError(message)


def _whole(x: object) -> bool:
    return isinstance(x, int) and not isinstance(x, bool)


def _value(v: object) -> dict:
    kind = "null" if v is None else "int" if _whole(v) else "float" if isinstance(v, float) else "str" if isinstance(v, str) else ""
    _check(kind, "a value is no number or text")
    _check(kind != "int" or -(1 << 63) <= v < 1 << 63, "an integer is beyond 64 bits")
    return {"kind": kind, "i": v if kind == "int" else None, "d": v if kind == "float" else None, "s": v if kind == "str" else None}


def unit_text(u: object) -> str:
    if isinstance(u, str):
        return u
    if _whole(u) and u >= 0:
        return f"UO:{u:07d}"
    _check(isinstance(u, list) and len(u) == 2 and isinstance(u[0], str) and _whole(u[1]), "invalid unit")
    return f"{u[0]}:{u[1]:07d}"


def _param_rows(m: object) -> list[dict]:
    _check(isinstance(m, dict), "a parameter list is no map")
    out = []
    for key, v in m.items():
        name = _accession(key) if isinstance(key, str) else f"MS:{key:07d}" if key >= 0 else _check(False, "invalid parameter key")
        unit = None
        if isinstance(v, list):
            _check(len(v) == 2, "a value with unit must have two items")
            v, unit = v[0], unit_text(v[1])
        out.append({"accession": name, "value": _value(v), "unit_accession": unit})
    return out


def _list(x: object) -> list:
    _check(isinstance(x, list), "a list is expected")
    return x


def _user_rows(x: object) -> list[dict]:
    out = []
    for m in _list(x):
        _check(isinstance(m, dict) and isinstance(m.get("n"), str) and m["n"], "a user parameter has no name")
        out.append({"name": m["n"], "value": _value(m.get("v")), "type": m.get("t"), "unit_accession": unit_text(m["u"]) if "u" in m else None})
    return out


def _window(x: dict, key: int) -> dict | None:
    return {"params": _param_rows(x[key])} if key in x else None


TYPES, COMPRESSIONS, FIXED = frozenset(R.DTYPES.values()), frozenset(R.CODECS.values()), frozenset((*R.LINEAR, *R.SLOF))


def _descriptor_fault(d: object) -> str | None:
    """What is wrong with an array descriptor by itself."""
    if not isinstance(d, dict):
        return "an array descriptor is no map"
    kind, array, comp, fp, name, unit = (d.get(k) for k in (R.DESC_TYPE, R.DESC_ARRAY, R.DESC_COMP, R.DESC_FP, R.DESC_NAME, R.DESC_UNIT))
    for x, label in ((kind, "type"), (array, "array"), (comp, "compression")):
        if not _whole(x):
            return f"an array descriptor has no {label}"
    if kind not in TYPES:
        return "unknown data type"
    if comp not in COMPRESSIONS:
        return f"unknown codec {comp}"
    if kind != R.FLOAT64 and comp in R.LOSSY:
        return "a lossy codec needs doubles"
    if comp in FIXED:
        if R.DESC_FP not in d:
            return "linear and slof codecs require fp"
        if not _whole(fp) or not 0 < fp <= R.MAX_SAFE_INTEGER:
            return "fp is no positive whole number"
    elif R.DESC_FP in d:
        return "a codec without fixed point has fp"
    if not isinstance(d.get(R.DESC_DATA), bytes):
        return "an array descriptor has no data"
    if (array == R.ARRAY_NON_STANDARD) != (name is not None):
        return "non-standard arrays, and they only, have a name"
    if name is not None and not (isinstance(name, str) and name and name not in R.CORE.values() and not ACCESSION.fullmatch(name)):
        return "invalid array name"
    if R.DESC_UNIT in d and not (_whole(unit) and unit >= 0 or isinstance(unit, (str, list))):
        return "invalid array unit"
    return None


class Known(dict):
    """An array descriptor whose other parts were seen before its bytes, with its row."""

    row: dict


@lru_cache(4096)
def _frame(before: bytes, behind: bytes = b"") -> tuple[dict, dict] | None:
    """The descriptor, and its row, that begins so and ends with its bytes and what is behind them; None if there is no such one."""
    try:
        d = cbor.loads(before + b"\x40" + behind)
        return d, _descriptor(d, set())
    except (DocumentError, cbor.CborError):
        return None


#: Up to its bytes: type, array and codec in four bytes each, a fixed point or none, a short name or none, the length of the bytes.
_USUAL = re.compile(
    rb"[\xa4-\xa6]\x00\x1a.{4}\x01\x1a.{4}\x02\x1a.{4}(?:\x03(?:[\x00-\x17]|\x18.|\x19.{2}|\x1a.{4}|\x1b.{8}))?"
    rb"(?:\x04(?:" + b"|".join(b"\\x%02x.{%d}" % (0x60 + k, k) for k in range(1, 24)) + rb"))?\x05(?:([\x40-\x57])|\x58(.)|\x59(.{2})|\x5a(.{4}))",
    re.DOTALL,
)


def _usual(raw: bytes, at: int) -> tuple[tuple[dict, dict], bytes, int] | None:
    """The frame, the bytes and the place behind a descriptor in its usual form."""
    m = _USUAL.match(raw, at)
    if not m:
        return None
    k, start = m.lastindex, m.end()
    size = raw[start - 1] - 0x40 if k == 1 else int.from_bytes(m[k], "big")
    if start + size > len(raw) or not (found := _frame(raw[at : m.start(k) - (k > 1)])):
        return None
    return found, raw[start : start + size], start + size


def _known(raw: bytes, at: int) -> tuple[dict, int, int] | None:
    """A descriptor in its usual form, as cbor.loads asks for it."""
    if not (found := _usual(raw, at)):
        return None
    (d, row), data, end = found
    out = Known(d)
    out[R.DESC_DATA] = data
    out.row = row | {"data": data}
    return out, end, 2 * len(out)


#: A length, an id and arrays; an interpretation may follow.
_FRONT = re.compile(rb"[\xa3\xa4]\x00(?:([\x00-\x17])|\x18(.)|\x19(.{2})|\x1a(.{4}))\x01(?:([\x60-\x77])|\x78(.)|\x79(.{2}))", re.DOTALL)
_TEXT = re.compile(rb"\x07(?:([\x60-\x77])|\x78(.)|\x79(.{2}))", re.DOTALL)


def _text_of(raw: bytes, m: re.Match, k: int) -> tuple[str, int]:
    """A text whose length the match's group k holds, and the place behind it."""
    start, short = m.end(), m.re.groups - 2
    end = start + (m[k][0] - 0x60 if k == short else int.from_bytes(m[k], "big"))
    if end > len(raw):
        raise ValueError
    return raw[start:end].decode(), end


def _bare(raw: bytes) -> dict | None:
    """A document without parameters whose parts are in their usual form; None for any other, good or bad."""
    m = _FRONT.match(raw)
    if not m or len(raw) > R.MAX_PAYLOAD_BYTES:
        return None
    n = int.from_bytes(next(g for g in m.groups()[:4] if g is not None), "big")
    try:
        name, at = _text_of(raw, m, m.lastindex)
        if n > R.MAX_PEAKS or raw[at] != 6 or not 0x80 <= raw[at + 1] < 0x98:
            return None
        held, at = raw[at + 1] - 0x80, at + 2
        descriptors = []
        for _ in range(held):
            if not (found := _usual(raw, at)):
                return None
            (_, row), data, at = found
            descriptors.append(row | {"data": data})
        interp = None
        if raw[0] == 0xA4:
            if not (m := _TEXT.match(raw, at)):
                return None
            interp, at = _text_of(raw, m, m.lastindex)
    except (ValueError, IndexError):
        return None
    if at != len(raw) or len({(d["array"], d["name"]) for d in descriptors}) < held:
        return None
    return {
        "default_array_length": n, "id": name, "params": [], "scans": [], "scan_combination": None, "precursors": [], "products": [],
        "interp": interp, "user_params": [], "descriptors": descriptors, "document_bytes": len(raw),
    }


class Rare(ValueError):
    """A part in another than its usual form, good or bad."""


_INT = rb"[\x00-\x17]|\x18.|\x19.{2}|\x1a.{4}|\x1b.{8}"
_WORD = b"|".join(b"\\x%02x.{%d}" % (0x60 + k, k) for k in range(1, 24))
_UNIT = rb"%s|%s|\x82(?:%s)(?:%s)" % (_INT, _WORD, _WORD, _INT)
_VALUE = rb"\xf6|\xf9.{2}|\xfa.{4}|\xfb.{8}|%s|[\x20-\x37]|\x38.|\x39.{2}|\x3a.{4}|\x3b.{8}|\x60|%s" % (_INT, _WORD)
#: A parameter: its key, then a value with a unit, a value, or the length of a longer text.
_ENTRY = re.compile(rb"(\x1a.{4}|%s)(?:(%s)|\x82(%s)(%s)|\x78(.)|\x79(.{2}))" % (_WORD, _VALUE, _VALUE, _UNIT), re.DOTALL)
_USER = re.compile(rb"([\xa1-\xa4])an(%s)(?:at(\x60|%s))?(?:au(%s))?(?:av(%s))?" % (_WORD, _WORD, _UNIT, _VALUE), re.DOTALL)
_SCANS = re.compile(rb"(?:\xa1|\xa2ac(%s))as" % _INT, re.DOTALL)
_BEHIND = re.compile(rb"\x06(?:%s)" % _UNIT, re.DOTALL)


@lru_cache(8192)
def _name_of(key: bytes) -> str:
    x = cbor.loads(key)
    return _accession(x) if isinstance(x, str) else f"MS:{x:07d}"


@lru_cache(8192)
def _known_value(raw: bytes) -> dict:
    return _value(cbor.loads(raw))


def _value_of(raw: bytes) -> dict:
    if raw[0] == 0xFB:
        return {"kind": "float", "i": None, "d": struct.unpack(">d", raw[1:])[0], "s": None}
    if 0x18 <= raw[0] <= 0x1A:
        return {"kind": "int", "i": int.from_bytes(raw[1:], "big"), "d": None, "s": None}
    return _known_value(raw)


@lru_cache(8192)
def _unit_of(raw: bytes) -> str:
    return unit_text(cbor.loads(raw))


class Reader:
    """A document whose parts are in their usual form, read from front to back; another one raises ValueError or IndexError."""

    def __init__(self, raw: bytes) -> None:
        self.raw, self.at = raw, 0

    def count(self, first: int) -> int:
        """How many items a short list (first: 0x80) or map (0xa0) has."""
        k = self.raw[self.at] - first
        if not 0 <= k < 24:
            raise Rare
        self.at += 1
        return k

    def bytes(self, n: int) -> bytes:
        self.at += n
        if self.at > len(self.raw):
            raise Rare
        return self.raw[self.at - n : self.at]

    def number(self) -> int:
        k = self.raw[self.at]
        self.at += 1
        if k > 27:
            raise Rare
        return k if k < 24 else int.from_bytes(self.bytes(1 << k - 24), "big")

    def match(self, pattern: re.Pattern) -> re.Match:
        m = pattern.match(self.raw, self.at)
        if not m:
            raise Rare
        self.at = m.end()
        return m

    def text(self) -> str:
        k = self.raw[self.at] - 0x60
        self.at += 1
        if k in (24, 25):
            k = int.from_bytes(self.bytes(k - 23), "big")
        elif not 0 <= k < 24:
            raise Rare
        return self.bytes(k).decode()

    def params(self) -> list[dict]:
        out = []
        for _ in range(self.count(0xA0)):
            m = _ENTRY.match(self.raw, self.at)
            if not m:
                raise Rare
            self.at = m.end()
            key, value, valued, unit, short, long = m.groups()
            if value:
                out.append({"accession": _name_of(key), "value": _value_of(value), "unit_accession": None})
            elif valued:
                out.append({"accession": _name_of(key), "value": _value_of(valued), "unit_accession": _unit_of(unit)})
            else:
                text = self.bytes(int.from_bytes(short or long, "big")).decode()
                out.append({"accession": _name_of(key), "value": {"kind": "str", "i": None, "d": None, "s": text}, "unit_accession": None})
        if len(out) > 1 and len({p["accession"] for p in out}) < len(out):
            raise Rare
        return out

    def windows(self) -> list[dict]:
        return [{"params": self.params()} for _ in range(self.count(0x80))]

    def users(self) -> list[dict]:
        out = []
        for _ in range(self.count(0x80)):
            head, name, kind, unit, value = self.match(_USER).groups()
            if head[0] - 0xA0 != 1 + sum(x is not None for x in (kind, unit, value)):
                raise Rare
            out.append({"name": name[1:].decode(), "value": _value_of(value or b"\xf6"), "type": kind and kind[1:].decode(), "unit_accession": unit and _unit_of(unit)})
        return out

    def map(self, *readers: tuple[str, Callable]) -> dict:
        """A map whose keys are 0, 1 and so on, in this order; without those that are absent."""
        left, out = self.count(0xA0), {}
        for key, (name, read) in enumerate(readers):
            if not left:
                break
            if self.raw[self.at] == key:
                self.at += 1
                left -= 1
                out[name] = read(self)
        if left:
            raise Rare
        return out

    def window(self) -> dict:
        return {"params": self.params()}

    def descriptors(self) -> list[dict]:
        out = []
        for _ in range(self.count(0x80)):
            start = self.at
            m = self.match(_USUAL)
            k = m.lastindex
            data = self.bytes(self.raw[self.at - 1] - 0x40 if k == 1 else int.from_bytes(m[k], "big"))
            behind = self.match(_BEHIND)[0] if self.raw[self.at : self.at + 1] == b"\6" else b""
            if not (found := _frame(self.raw[start : m.start(k) - (k > 1)], behind)):
                raise Rare
            out.append(found[1] | {"data": data})
        if len({(d["array"], d["name"]) for d in out}) < len(out):
            raise Rare
        return out

    def document(self) -> dict:
        left, last = self.count(0xA0), -1
        out = {
            "default_array_length": None, "id": None, "params": [], "scans": [], "scan_combination": None, "precursors": [], "products": [],
            "interp": None, "user_params": [], "descriptors": [], "document_bytes": len(self.raw),
        }
        for _ in range(left):
            key = self.raw[self.at]
            if key <= last:
                raise Rare
            self.at, last = self.at + 1, key
            match key:
                case 0:
                    out["default_array_length"] = self.number()
                case 1:
                    out["id"] = self.text()
                case 2:
                    out["params"] = self.params()
                case 3:
                    if combined := self.match(_SCANS)[1]:
                        out["scan_combination"] = {"accession": f"MS:{int.from_bytes(combined[len(combined) > 1 :], 'big'):07d}", "value": _value_of(b"\xf6"), "unit_accession": None}
                    empty = {"params": [], "windows": [], "user_params": []}
                    out["scans"] = [empty | self.map(*SCAN) for _ in range(self.count(0x80))]
                case 4:
                    empty = {"isolation_window": None, "selected_ions": [], "activation": None}
                    out["precursors"] = [empty | self.map(*PRECURSOR) for _ in range(self.count(0x80))]
                case 5:
                    out["products"] = [{"isolation_window": None} | self.map(*PRODUCT) for _ in range(self.count(0x80))]
                case 6:
                    out["descriptors"] = self.descriptors()
                case 7:
                    out["interp"] = self.text()
                case 8:
                    out["user_params"] = self.users()
                case _:
                    raise Rare
        if self.at != len(self.raw) or out["default_array_length"] is None or out["default_array_length"] > R.MAX_PEAKS:
            raise Rare
        return out


SCAN = (("params", Reader.params), ("windows", Reader.windows), ("user_params", Reader.users))
PRECURSOR = (("isolation_window", Reader.window), ("selected_ions", Reader.windows), ("activation", Reader.window))
PRODUCT = PRECURSOR[:1]

#: Bytes of a document that cannot hold too many items.
SHORT = 65_536


def _usual_document(raw: bytes) -> dict | None:
    """A document whose parts are in their usual form; None for any other, good or bad."""
    if len(raw) > SHORT:
        return None
    try:
        return Reader(raw).document()
    except (ValueError, IndexError):
        return None


def _descriptor(d: object, seen: set) -> dict:
    if type(d) is Known:
        _check((d.row["array"], d.row["name"]) not in seen, "duplicate array")
        seen.add((d.row["array"], d.row["name"]))
        return d.row
    if fault := _descriptor_fault(d):
        raise DocumentError(fault)
    kind, array, comp, fp, name, data = (d.get(k) for k in (R.DESC_TYPE, R.DESC_ARRAY, R.DESC_COMP, R.DESC_FP, R.DESC_NAME, R.DESC_DATA))
    unit = _accession(unit_text(d[R.DESC_UNIT])) if R.DESC_UNIT in d else None
    _check((array, name) not in seen, "duplicate array")
    seen.add((array, name))
    return {"type": kind, "array": array, "comp": comp, "fp": fp, "name": name, "data": data, "unit": unit}


SHAPES = {1: str, 2: dict, 3: dict, 4: list, 5: list, 6: list, 7: str, 8: list}


def parse(raw: bytes) -> dict:
    """The metadata columns and the descriptors; arrays stay compressed. Unknown keys are skipped."""
    if usual := _bare(raw) or _usual_document(raw):
        return usual
    return _parsed(cbor.loads(raw, _known), len(raw))


def _parsed(doc: object, size: int) -> dict:
    _check(isinstance(doc, dict), "the document is no map")
    _check(0 in doc, "the document has no array length")
    for key, shape in SHAPES.items():
        _check(key not in doc or isinstance(doc[key], shape), f"header key {key} has the wrong type")
    n, scans = doc[0], doc.get(3, {})
    _check(_whole(n) and 0 <= n <= R.MAX_PEAKS, "invalid array length")
    combined = scans.get("c")
    _check(combined is None or _whole(combined) and combined >= 0, "invalid scan combination")
    seen: set = set()
    each = lambda key: [x if isinstance(x, dict) else _check(False, "an entry is no map") for x in doc.get(key, [])]
    return {
        "default_array_length": n,
        "id": doc.get(1),
        "params": _param_rows(doc.get(2, {})),
        "scans": [{"params": _param_rows(s.get(0, {})), "windows": [{"params": _param_rows(w)} for w in _list(s.get(1, []))], "user_params": _user_rows(s.get(2, []))} for s in _list(scans.get("s", []))],
        "scan_combination": None if combined is None else {"accession": f"MS:{combined:07d}", "value": _value(None), "unit_accession": None},
        "precursors": [{"isolation_window": _window(p, 0), "selected_ions": [{"params": _param_rows(i)} for i in _list(p.get(1, []))], "activation": _window(p, 2)} for p in each(4)],
        "products": [{"isolation_window": _window(p, 0)} for p in each(5)],
        "interp": doc.get(7),
        "user_params": _user_rows(doc.get(8, [])),
        "descriptors": [_descriptor(d, seen) for d in doc.get(6, [])],
        "document_bytes": size,
    }
