"""What goes through many rows at once gives what a row by itself gives."""

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from mzframe import catalog
from mzframe import registry as R
from mzframe import schema as S
from mzframe.functions import tokens as T
from mzframe.functions import urls as U
from mzframe.kernels import arrays, batches, cbor, columns, document
from mzframe.operators import tokens

DATA = "/root/testdata/sf0.001"
TEXT = st.text(max_size=5) | st.sampled_from(["t" * 23, "t" * 24, "é" * 200])
VALUE = st.none() | st.fixed_dictionaries({"kind": st.sampled_from(["int", "float", "str", "null"]), "i": st.none() | st.integers(-(2**63), 2**63 - 1) | st.integers(-300, 300), "d": st.none() | st.floats() | st.floats(width=16), "s": st.none() | TEXT})
UNIT = st.sampled_from([None, "UO:0000031", "UO:0000010", "MS:1000040", "X:1", "no"])
CV = st.fixed_dictionaries({"accession": st.sampled_from(["MS:1000511", "MS:1000016", "MS:0000005", "MS:12", "NCIT:C25330", "bad"]), "value": VALUE, "unit_accession": UNIT})
LIST = lambda x: st.none() | st.lists(x, max_size=3)
WINDOW = st.fixed_dictionaries({"params": LIST(CV)})
USER = st.fixed_dictionaries({"name": st.sampled_from(["a", "name", "n" * 30, ""]), "value": VALUE, "type": st.none() | TEXT, "unit_accession": UNIT})
SCAN = st.fixed_dictionaries({"params": LIST(CV), "windows": LIST(WINDOW), "user_params": LIST(USER)})
PRECURSOR = st.fixed_dictionaries({"isolation_window": st.none() | WINDOW, "selected_ions": LIST(WINDOW), "activation": st.none() | WINDOW})
META = st.fixed_dictionaries({
    "id": st.none() | TEXT, "params": LIST(CV), "scans": LIST(SCAN), "scan_combination": st.none() | CV, "precursors": LIST(PRECURSOR),
    "products": LIST(st.fixed_dictionaries({"isolation_window": st.none() | WINDOW})), "interp": st.none() | TEXT, "user_params": LIST(USER),
})


@pytest.fixture(scope="module")
def kinds(spark):
    arrow = lambda ddl: to_arrow_type(StructType.fromDDL(ddl))
    row = ", ".join(f"{k} {v}" for k, v in S.COLUMNS.items())
    return arrow(f"{row}, plan array<{S.PLAN}>"), arrow("token string, error string"), arrow(f"header struct<{tokens.HEADER}>, error string")


def plan(key, unit=None):
    return {"key": key, "array": R.ARRAY_NON_STANDARD if key == "x" else R.ARRAY_MZ, "type": R.FLOAT64, "comp": R.ZLIB, "fp": None, "name": key if key == "x" else None, "unit": unit}


def spectrum(meta, n):
    extra = [("x", {"dtype": "float64", "values": [0.5] * n})] if n % 2 else []
    return meta | {"default_array_length": n, "mz": [1.5] * n, "intensity": None, "charge": None, "extra_arrays": extra, "array_units": [], "plan": [plan("mz", "MS:1000040" if n > 1 else None), *(plan(k) for k, _ in extra)]}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.none() | st.tuples(META, st.sampled_from([0, 1, 2, 30])), min_size=1, max_size=4))
def test_documents_of_columns_are_those_of_rows(kinds, rows):
    column = pa.array([r and spectrum(*r) for r in rows], kinds[0])
    made = batches.build_tokens(column, kinds[1], U.MAGIC).to_pylist()
    keep, columns.documents = columns.documents, lambda *_: (_ for _ in ()).throw(columns.Unusual)
    try:
        assert made == batches.build_tokens(column, kinds[1], U.MAGIC).to_pylist()
    finally:
        columns.documents = keep


@settings(max_examples=300, deadline=None)
@given(META, st.sampled_from([0, 1, 2, 30, 300]), st.integers(0, 400), st.integers(0, 255))
def test_documents_in_usual_form_are_read_as_any_other(kinds, meta, n, spot, byte):
    token = batches.build_tokens(pa.array([spectrum(meta, n)], kinds[0]), kinds[1], U.MAGIC).to_pylist()[0]["token"]
    if token is None:
        return
    raw = batches.payload(token.encode(), U.MAGIC.encode())
    for doc in (raw, raw[:spot], raw + b"\0", raw[:spot] + bytes([byte]) + raw[spot + 1 :]):
        if (got := document._usual_document(doc)) is not None:
            assert repr(got) == repr(document._parsed(cbor.loads(doc), len(doc)))


def test_documents_of_every_kind_of_metadata_need_no_other_reader(spark):
    raws = [batches.payload(r[0].encode(), U.MAGIC.encode()) for r in tokens.encode(catalog.meta_spectra(spark, DATA)).select("token").collect()]
    got = [document._usual_document(raw) for raw in raws]
    assert got and got == [document._parsed(cbor.loads(raw), len(raw)) for raw in raws]


def test_metadata_is_typed_once(spark):
    """The number of a text had been matched 270 times in one expression."""
    text = catalog.meta_spectra(spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("RLIKE") <= 8


def test_numbers_have_their_shortest_form():
    x = np.array([0.0, -0.0, 0.5, 1 / 3, 65_504.0, 65_505.0, 1e5, 3.4028234663852886e38, 1e39, 1e300, 5e-324, 6e-8, np.inf, -np.inf, np.nan])
    n = np.array([0, 23, 24, 255, 256, 65_535, 65_536, 2**32 - 1, 2**32, 2**63 - 1, -1, -24, -25, -256, -257, -(2**63)])
    assert columns.floats(x).tolist() == list(map(cbor.dumps, x.tolist())) and columns.wholes(n).tolist() == list(map(cbor.dumps, n.tolist()))


def test_plain_arrays_are_inflated_together():
    kind = pa.struct([("values", pa.list_(pa.float64())), ("error", pa.string())])
    part = pa.struct([("data", pa.binary()), ("comp", pa.int32()), ("type", pa.int32()), ("fp", pa.int64())])
    of = lambda x, cut=None: {"data": arrays.encode(x, R.ZLIB, R.FLOAT64, None)[:cut], "comp": R.ZLIB, "type": R.FLOAT64, "fp": None}
    fine, lengths = [of([1.0, 2.0]), None, of([]), of(np.arange(3_000) / 7)], [2, 5, 0, 3_000]
    want = [([1.0, 2.0], None), (None, None), ([], None), ((np.arange(3_000) / 7).tolist(), None)]
    run = lambda rows, sizes: [(r["values"], r["error"]) for r in batches.inflate(pa.array(rows, part), pa.array(sizes, pa.int32()), kind).to_pylist()]
    d = pa.array(fine, part)
    assert batches._inflated(dict(zip(("data", "comp", "type"), d.flatten(), strict=False)), pa.array(lengths, pa.int32()), kind) is not None and run(fine, lengths) == want
    bad = [of([1.0], -3), of([1.0]), of([np.nan]), of(np.zeros(90_000))]
    faults = ["compressed data ends early", "array has 1 values instead of 2", "array holds a value that is not finite", "array is larger than its declared length allows"]
    for row, n, fault in zip(bad, (1, 2, 1, 2), faults, strict=True):
        assert run([*fine, row], [*lengths, n]) == [*want, (None, fault)]


def test_explode_token_goes_batch_by_batch(spark):
    tokens.register_functions(spark)
    spectra = spark.createDataFrame([("a", [1.0, 2.0], [3.0, 4.0], None), ("b", [5.0], None, [2.0]), ("c", [], [], None)], "id string, mz array<double>, intensity array<double>, charge array<double>")
    for lossless in (True, False):
        made = tokens.encode(spectra, lossless=lossless).select("id", "token").union(spark.createDataFrame([("n", None)], "id string, token string"))
        rows = spark.sql("SELECT t.id, p.pos, round(p.mz, 4), round(p.intensity, 1), p.charge FROM {t} t, LATERAL explode_token(t.token) p", t=made)
        assert sorted(map(tuple, rows.collect())) == [("a", 0, 1.0, 3.0, None), ("a", 1, 2.0, 4.0, None), ("b", 0, 5.0, None, 2.0)]
        text = rows._jdf.queryExecution().optimizedPlan().toString()
        assert "UDTF" not in text and "Join" not in text
    for bad in ("x", T.to_token(F.lit("plain text").cast("binary"))):
        with pytest.raises(Exception, match="wrong magic|trailing bytes|truncated|no map"):
            spark.range(1).select((F.lit(bad) if isinstance(bad, str) else bad).alias("token")).selectExpr("inline(token_peaks(token))").collect()


def test_a_lossless_plan_asks_no_values(spark):
    """Its entries had gone through three more lists of structs, each worked out element by element."""
    from mzframe.plans.encoding import encoding_plan

    rows = catalog.line_spectra(spark, DATA)
    text = rows.select(encoding_plan(True))._jdf.queryExecution().optimizedPlan().toString().split("\n")[0]
    assert "array_min" not in text
    assert text.count("transform(") <= 4  # two of them make the extra arrays
    plain, asked = (rows.select("id", encoding_plan(True, overrides).alias("p")) for overrides in (None, {"mz": "zlib"}))
    assert plain.schema["p"].dataType == asked.schema["p"].dataType and plain.orderBy("id").collect() == asked.orderBy("id").collect()


def test_code_of_metadata_is_short_enough_to_be_compiled(spark, capsys):
    """The JVM compiles no method of more than 8,000 bytes, and typing the texts in one stage had made one of 11,303."""
    import re

    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        catalog.meta_spectra(spark, DATA).explain("codegen")
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert max(map(int, re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out))) < 8_000
