"""Bytes: CBOR, half bytes and array codecs, without Spark."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from mzframe import registry as R
from mzframe.kernels import arrays, cbor, document


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 50])
@pytest.mark.parametrize("comp", sorted(R.CODECS.values()))
def test_round_trip_of_every_codec_at_boundary_lengths(n, comp):
    rng = np.random.default_rng(n)
    x = rng.integers(0, 5_000_000, n).astype(float) if comp in R.PIC else np.sort(rng.uniform(100, 2000, n))
    fp = R.LINEAR_FP if comp in R.LINEAR else R.SLOF_FP if comp in R.SLOF else None
    back = arrays.decode(arrays.encode(x, comp, R.FLOAT64, fp), comp, R.FLOAT64, fp, n)
    want = np.floor(x * fp + 0.5) / fp if comp in R.LINEAR else np.exp(np.floor(np.log(x + 1) * fp + 0.5) / fp) - 1 if comp in R.SLOF else x
    assert np.array_equal(back, want)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(-(2**31), 2**31 - 1), max_size=60))
def test_half_bytes_are_exact(codes):
    packed = arrays.half_bytes(np.array(codes, "int64")) if codes else b""
    assert arrays.from_half_bytes(packed, 100).tolist() == codes


def test_half_bytes_follow_the_public_format():
    assert arrays.half_bytes(np.array([0])) == b"\x80"
    assert arrays.half_bytes(np.array([1])) == b"\x71"
    assert arrays.half_bytes(np.array([-1])) == b"\xff"
    assert arrays.half_bytes(np.array([0x12])) == b"\x62\x10"


@settings(max_examples=200, deadline=None)
@given(st.recursive(st.none() | st.booleans() | st.integers(-(2**63), 2**63 - 1) | st.floats(allow_nan=False) | st.text(max_size=8) | st.binary(max_size=8), lambda x: st.lists(x, max_size=4) | st.dictionaries(st.integers(0, 99) | st.text(max_size=3), x, max_size=4), max_leaves=12))
def test_cbor_round_trip(x):
    assert cbor.loads(cbor.dumps(x)) == x


def test_map_keys_are_in_canonical_order():
    assert cbor.dumps({"b": 1, 100: 2, 7: 3, "aa": 4}) == bytes.fromhex("a4 07 03 18 64 02 61 62 01 62 61 61 04".replace(" ", ""))


@pytest.mark.parametrize(
    ("raw", "fault"),
    [
        ("a3000000000680", "duplicate"),
        ("a200000680ff", "trailing"),
        ("a200200680", "array length"),
        ("a200f93e000680", "array length"),
        ("a200f50680", "array length"),
        ("a200000681a4001a000f444b011a000f4442021a000f4cfa0540", "require fp"),
        ("a200000681a5001a000f444b011a000f4442021a000f447e054006f5", "unit"),
        ("9fff", "indefinite"),
        ("a2", "truncated"),
        ("81" * 40 + "00", "deeply"),
    ],
)
def test_malformed_documents_are_refused(raw, fault):
    with pytest.raises((document.DocumentError, cbor.CborError), match=fault):
        document.parse(bytes.fromhex(raw))


def test_arrays_that_inflate_beyond_their_length_are_refused():
    bomb = arrays.encode(np.zeros(100_000), R.ZLIB, R.FLOAT64, None)
    with pytest.raises(arrays.CodecError, match="larger"):
        arrays.decode(bomb, R.ZLIB, R.FLOAT64, None, 3)
    with pytest.raises(arrays.CodecError, match="larger"):
        arrays.decode(arrays.encode(np.zeros(100_000), R.ZSTD, R.FLOAT64, None), R.ZSTD, R.FLOAT64, None, 3)
    good = arrays.encode(np.arange(9.0), R.ZLIB, R.FLOAT64, None)
    with pytest.raises(arrays.CodecError, match="early"):
        arrays.decode(good[:-2], R.ZLIB, R.FLOAT64, None, 9)


def test_values_beyond_the_linear_transform_are_refused_and_fixed_points_compared():
    with pytest.raises(arrays.CodecError, match="too large"):
        arrays.encode(np.array([50_000.0, 60_000.0]), R.LINEAR_ZLIB, R.FLOAT64, R.LINEAR_FP)
    with pytest.raises(arrays.CodecError, match="negative"):
        arrays.encode(np.array([-1.0]), R.SLOF_ZLIB, R.FLOAT64, 10)
    packed = arrays.encode(np.array([1.0, 2.0]), R.LINEAR_ZLIB, R.FLOAT64, 100)
    with pytest.raises(arrays.CodecError, match="fixed point"):
        arrays.decode(packed, R.LINEAR_ZLIB, R.FLOAT64, 200, 2)


@settings(max_examples=300, deadline=None)
@given(st.binary(max_size=80))
def test_no_other_error_escapes_from_random_bytes(raw):
    try:
        document.parse(raw)
    except (document.DocumentError, cbor.CborError):
        pass


def test_descriptors_seen_before_are_read_as_any_other():
    part = {0: R.FLOAT64, 1: R.ARRAY_MZ, 2: R.ZLIB, 5: b"x" * 300}
    others = [{**part, 1: R.ARRAY_INTENSITY, 2: R.SLOF_ZLIB, 3: 3600}, {**part, 1: R.ARRAY_NON_STANDARD, 4: "tax"}, {**part, 1: R.ARRAY_CHARGE, 6: 10}, {**part, 1: R.ARRAY_NON_STANDARD, 4: "n" * 40, 5: b""}]
    for _ in range(2):
        raw = cbor.dumps({0: 0, 6: [part, *others]})
        assert cbor.loads(raw, document._known) == cbor.loads(raw)
        rows = document.parse(raw)["descriptors"]
        assert rows == [document._descriptor(d, set()) for d in cbor.loads(raw)[6]] and type(cbor.loads(raw, document._known)[6][1]) is document.Known
        for bad, fault in (({0: 0, 6: [part, part]}, "duplicate array"), ({0: 0, 6: [{**part, 2: 7}]}, "unknown codec 7")):
            with pytest.raises(document.DocumentError, match=fault):
                document.parse(cbor.dumps(bad))
        for cut in range(len(raw)):
            with pytest.raises(cbor.CborError, match="truncated"):
                cbor.loads(raw[:cut], document._known)


def test_bare_documents_are_read_as_any_other():
    part = {0: R.FLOAT64, 1: R.ARRAY_MZ, 2: R.ZLIB, 5: b"x" * 300}
    others = [{**part, 1: R.ARRAY_INTENSITY, 2: R.SLOF_ZLIB, 3: 3600}, {**part, 1: R.ARRAY_NON_STANDARD, 4: "tax", 5: b""}, {**part, 1: R.ARRAY_CHARGE, 6: 10, 5: b"y" * 24}]
    for name in ("", "7", "é" * 11, "i" * 24, "i" * 300):
        for more in ({}, {7: "PEP"}, {7: "A" * 500}):
            for n, held in ((2, [part, *others[:2]]), (70_000, [part, others[2]]), (0, [])):
                raw = cbor.dumps({0: n, 1: name, 6: held, **more})
                assert document.parse(raw) == document._parsed(cbor.loads(raw), len(raw))
                assert (document._bare(raw) is None) == (others[2] in held)  # a unit stands behind the bytes
    raw = cbor.dumps({0: 2, 1: "a", 6: [part], 7: "PEP"})
    for bad in (raw + b"\0", *(raw[:k] for k in range(len(raw))), cbor.dumps({0: 2, 1: "a", 6: [part, part]}), cbor.dumps({0: R.MAX_PEAKS + 1, 1: "a", 6: []}), raw.replace(b"PEP", b"P\xffP")):
        assert document._bare(bad) is None
        with pytest.raises((document.DocumentError, cbor.CborError)):
            document.parse(bad)


def test_arrays_of_one_buffer_are_encoded_as_alone():
    rng = np.random.default_rng(3)
    x = rng.uniform(1, 500, 400)
    comps = np.array([*sorted(R.CODECS.values())] * 4)
    starts, sizes = rng.integers(0, 300, len(comps)), rng.integers(0, 90, len(comps))
    fps = np.where(np.isin(comps, [*R.LINEAR, *R.SLOF]), 1000, 0)
    kinds = np.where(np.isin(comps, [*R.LOSSY]) | (np.arange(len(comps)) % 2 == 0), R.FLOAT64, R.INT32)
    made = arrays.encode_flat(x, starts, sizes, comps, kinds, fps)
    parts = [x[a : a + n] for a, n in zip(starts, sizes, strict=True)]
    assert made == [arrays.encode(p, c, k, f or None) for p, c, k, f in zip(parts, comps.tolist(), kinds.tolist(), fps.tolist(), strict=True)]
    back = arrays.decode_many([(m, c, k, f or None, len(p)) for m, c, k, f, p in zip(made, comps.tolist(), kinds.tolist(), fps.tolist(), parts, strict=True)])
    plain = [(p.astype("int32") if k == R.INT32 else p, b) for p, b, c, k in zip(parts, back, comps, kinds, strict=True) if c not in R.LOSSY]
    assert plain and all(np.array_equal(p, b) for p, b in plain)


def test_faults_that_are_kept_hold_no_decompressor():
    """A traceback would keep the window and the document of each fault until its batch ends."""
    import tracemalloc

    from mzframe.kernels import batches

    cut = (arrays.encode([1.0, 2.0], R.LINEAR_ZLIB, R.FLOAT64, 100)[:-3], R.LINEAR_ZLIB, R.FLOAT64, 100, 2)
    arrays.decode_many([cut])
    tracemalloc.start()
    try:
        faults = arrays.decode_many([cut] * 500)
        held, _ = tracemalloc.get_traced_memory()
    finally:
        tracemalloc.stop()
    assert {str(f) for f in faults} == {"compressed data ends early"} and held < 1_000_000
    assert batches._tried(document.parse, b"\xff").__traceback__ is None
