"""Spectra, plans and tokens on small tables."""

import json

import pytest
from pyspark.sql import functions as F

from mzframe import catalog
from mzframe.functions import tokens as T
from mzframe.functions import urls as U
from mzframe.operators import params, peaks, tokens, validation
from mzframe.plans.encoding import check_overrides, encoding_plan, plan_table
from mzframe.sources import json_spectra, mzml


def spectra(spark, *rows):
    return peaks.complete(spark.createDataFrame(rows, "id string, mz array<double>, intensity array<double>, charge array<double>"))


def test_sort_is_stable_and_top_n_breaks_ties_by_mz(spark):
    df = spectra(spark, ("a", [200.0, 100.0, 200.0, 100.0], [1.0, 2.0, 3.0, 4.0], None), ("b", [100.0, 200.0, 300.0, 400.0], [5.0, 50.0, 10.0, 90.0], None), ("c", None, None, None), ("d", [], [], []))
    got = {r["id"]: r for r in peaks.canonical_sort(df).collect()}
    assert got["a"]["mz"] == [100.0, 100.0, 200.0, 200.0] and got["a"]["intensity"] == [2.0, 4.0, 1.0, 3.0]
    assert got["c"]["mz"] is None and got["d"]["mz"] == []
    top = {r["id"]: r for r in peaks.top_n(df, 2).collect()}
    assert top["b"]["mz"] == [200.0, 400.0] and top["b"]["intensity"] == [50.0, 90.0] and top["b"]["default_array_length"] == 2
    assert top["a"]["intensity"] == [4.0, 3.0] and top["c"]["mz"] is None
    none = {r["id"]: r for r in peaks.top_n(df, 0).collect()}
    assert none["a"]["mz"] == [] and none["a"]["default_array_length"] == 0
    with pytest.raises(ValueError):
        peaks.top_n(df, -1)


def test_validation_names_each_fault(spark):
    df = spectra(spark, ("len", [1.0], [1.0, 2.0], None), ("nan", [float("nan")], [1.0], None), ("neg", [-1.0], [1.0], None), ("inf", [1.0], [float("inf")], None), ("ok", [1.0], [1.0], [1.0]))
    got = {r["id"]: r["errors"] for r in validation.validate(df).collect()}
    assert got["ok"] == []
    assert [len(got[k]) for k in ("len", "nan", "neg", "inf")] == [1, 1, 1, 1]
    extra = df.where("id = 'ok'").withColumns({"extra_arrays": F.create_map(F.lit("MS:1000514"), F.struct(F.lit("float64").alias("dtype"), F.array(F.lit(1.0)).alias("values"))), "array_units": F.create_map(F.lit("x"), F.lit("UO:0000031"))})
    faults = validation.validate(extra).first()["errors"]
    assert any("field of its own" in e for e in faults) and any("names no array" in e for e in faults)


def test_overrides_that_cannot_be_met_are_refused():
    for bad, lossless, unsafe in (
        ({"mz": "numslof-zlib"}, False, False),
        ({"mz": "numlin-zlib"}, True, False),
        ({"mz": {"codec": "zlib", "fixed_point": 3}}, False, False),
        ({"mz": {"codec": "numlin-zlib", "fixed_point": 0}}, False, False),
        ({"custom": "numlin-zlib"}, False, False),
        ({"mz": "zlib", "MS:1000514": "zstd"}, False, False),
        ({"MS:1003870": "numlin-zlib"}, False, True),
        ({"mz": "nope"}, False, False),
        ({"mz": {"codek": 1}}, False, False),
    ):
        with pytest.raises(ValueError):
            check_overrides(bad, lossless, unsafe)
    assert check_overrides({"custom": "numlin-zlib"}, False, True)["custom"].tail() == 1002746


def test_plans_fall_back_on_negative_and_large_values(spark):
    df = spectra(spark, ("a", [1.0], [-1.0], [-1.0]), ("b", [90_000.0], [1e12], [2.0]))
    got = {(r["id"], r["array_key"]): (r["comp"], r["fp"]) for r in plan_table(df).collect()}
    assert got["a", "intensity"] == (1000574, None) and got["a", "charge"] == (1000574, None)
    assert got["b", "mz"] == (1000574, None) and got["b", "intensity"][0] == 1002748 and got["b", "intensity"][1] < 3600
    faults = df.select("id", F.transform(encoding_plan(overrides={"charge": "numpic-zlib", "intensity": {"codec": "numslof-zlib", "fixed_point": 3600}}), lambda e: e["error"]).alias("e"))
    assert all(any(r["e"]) for r in faults.collect())


META = {
    "id": "scan=1", "mz": [300.5, 100.25, 200.125], "intensity": [1.0, 2.0, 3.0], "interp": "ELVIS[Phospho]K/2",
    "params": [{"accession": "MS:1000511", "value": 2}, {"accession": "MS:1000127"}, {"accession": "NCIT:C25330", "value": "x"}, {"accession": "MS:1000016", "value": 2.5, "unit_accession": "UO:0000031"}],
    "scans": [{"params": [{"accession": "MS:1000016", "value": 2.0, "unit_accession": "MOD:00046"}], "windows": [{"params": [{"accession": "MS:1000501", "value": 100}]}], "user_params": [{"name": "u", "value": 1, "type": "t"}]}],
    "scan_combination": {"accession": "MS:1000795"},
    "precursors": [{"isolation_window": {"params": [{"accession": "MS:1000827", "value": 445.3, "unit_accession": "MS:1000040"}]}, "selected_ions": [{"params": [{"accession": "MS:1000744", "value": 445.34}]}], "activation": {"params": [{"accession": "MS:1000133"}]}}],
    "products": [{"isolation_window": {"params": [{"accession": "MS:1000827", "value": 1}]}}],
    "user_params": [{"name": "a", "value": "b"}, {"name": "a", "value": 1.5, "unit_accession": "UO:0000010"}],
    "extra_arrays": {"MS:1003008": [0.5, 0.25, 0.75], "own": {"dtype": "int32", "values": [3, -1, 2]}, "f": {"dtype": "float32", "values": [0.5, 1.5, 2.5]}},
    "array_units": {"mz": "MS:1000040", "MS:1003008": "MS:1002814"},
}


def test_json_token_and_back_keep_all_metadata(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(json.dumps(META) + "\n\n" + json.dumps({"id": "empty"}) + "\n")
    df = json_spectra.read_json(spark, str(tmp_path / "in"))
    encoded = tokens.encode(df, lossless=True, mode="PERMISSIVE").select("id", "token", "error")
    assert [r["error"] for r in encoded.collect()] == [None, None]
    encoded.write.parquet(str(tmp_path / "tokens"))
    back = tokens.decode(spark.read.parquet(str(tmp_path / "tokens")).select("token"))
    rows = {r["id"]: r.asDict(recursive=True) for r in back.collect()}
    got = rows["scan=1"]
    assert rows["empty"]["default_array_length"] == 0 and rows["empty"]["mz"] is None and rows["empty"]["params"] == []
    assert got["mz"] == [100.25, 200.125, 300.5] and got["intensity"] == [2.0, 3.0, 1.0]
    assert got["extra_arrays"]["own"] == {"dtype": "int32", "values": [-1.0, 2.0, 3.0]}
    assert got["extra_arrays"]["f"]["dtype"] == "float32" and got["extra_arrays"]["MS:1003008"]["values"] == [0.25, 0.75, 0.5]
    assert got["array_units"] == {"mz": "MS:1000040", "MS:1003008": "MS:1002814"} and got["interp"] == META["interp"]
    # parameters come back in the order of their keys
    assert [p["accession"] for p in got["params"]] == ["MS:1000016", "MS:1000127", "MS:1000511", "NCIT:C25330"]
    assert [p["value"]["kind"] for p in got["params"]] == ["float", "null", "int", "str"]
    assert got["scans"][0]["params"][0]["unit_accession"] == "MOD:00046" and got["scans"][0]["user_params"][0]["value"]["i"] == 1
    assert got["scan_combination"]["accession"] == "MS:1000795"
    assert got["precursors"][0]["activation"]["params"][0]["accession"] == "MS:1000133"
    assert got["products"][0]["isolation_window"]["params"][0]["value"]["i"] == 1
    assert [u["name"] for u in got["user_params"]] == ["a", "a"] and got["user_params"][1]["unit_accession"] == "UO:0000010"
    again = tokens.encode(back.drop("token", "checksum", "format_version", "error"), lossless=True).where("id = 'scan=1'").first()["token"]
    assert again == encoded.where("id = 'scan=1'").first()["token"]


def test_bad_tokens_have_errors_and_failfast_raises(spark):
    good = tokens.encode(spectra(spark, ("a", [1.0, 2.0], [3.0, 4.0], None))).first()["token"]
    body, crc = good.rsplit(".", 1)
    cases = {"null": None, "ascii": good + "é", "magic": "x" + good, "parts": body, "form": body + ".XYZ", "crc": body + "." + ("0" * 8 if crc != "0" * 8 else "1" * 8), "good": good}
    df = spark.createDataFrame(list(cases.items()), "k string, token string")
    got = {r["k"]: r["error"] for r in tokens.decode(df, mode="PERMISSIVE").collect()}
    assert got.pop("good") is None and all(got.values()) and len(set(got.values())) == 6
    with pytest.raises(Exception, match="checksum"):
        tokens.decode(df.where("k = 'crc'")).collect()
    dup = spectra(spark, ("a", [1.0], [1.0], None)).withColumn("params", F.from_json(F.lit('[{"accession":"MS:1"},{"accession":"MS:1"}]'), "array<struct<accession:string,value:struct<kind:string,i:bigint,d:double,s:string>,unit_accession:string>>"))
    assert "duplicate" in tokens.encode(dup, mode="PERMISSIVE").first()["error"]


def test_base64_is_strict(spark):
    df = spark.createDataFrame([("AAEC",), ("!!!!",), ("A",), ("AA==",), ("AA",), ("AA\n",), ("",)], "t string")
    got = {r["t"]: r["b"] for r in df.select("t", T.from_b64url(F.col("t")).alias("b")).collect()}
    assert got["AAEC"] == b"\0\1\2" and got["AA=="] == got["AA"] == b"\0" and got[""] == b""
    assert got["!!!!"] is None and got["A"] is None and got["AA\n"] is None
    text = spark.range(1).select(T.b64url(F.repeat(F.lit("ab?"), 99).cast("binary")).alias("t")).first()["t"]
    assert len(text) == 396 and not set("\r\n=+/") & set(text)


def test_urls(spark):
    token = f"{U.MAGIC}.AA.00000000"
    df = spark.createDataFrame([("https://x.org/p##",), ("https://x.org/p?d=1&e=&f=a%20b#z",)], "u string").withColumn("t", F.lit(token))
    assert df.select(U.to_fragment(F.col("t"), F.col("u"))).first()[0] == f"https://x.org/p#{token}"
    links = [r[0] for r in df.select(U.to_query(F.col("t"), F.col("u"))).collect()]
    assert links[1] == f"https://x.org/p?e=&f=a+b&d={token}#z"
    for link in (f"https://x.org/#{token}", f"https://x.org/?a=1&q={token}", f"{U.DATA_URI}{token}"):
        assert df.limit(1).select(U.extract_token(F.lit(link))).first()[0] == token
    assert df.limit(1).select(U.extract_token(F.lit("https://x.org/?a=1"))).first()[0] is None


MZML = """<?xml version="1.0"?>
<mzML xmlns="http://psi.hupo.org/ms/mzml"><referenceableParamGroupList count="1"><referenceableParamGroup id="g"><cvParam cvRef="MS" accession="MS:1000130" name="positive scan" value=""/></referenceableParamGroup></referenceableParamGroupList>
<run><spectrumList count="2"><spectrum index="0" id="scan=1" defaultArrayLength="2"><referenceableParamGroupRef ref="g"/><referenceableParamGroupRef ref="missing"/><cvParam cvRef="MS" accession="MS:1000511" name="ms level" value="2"/><userParam name="n" value="" type=""/>
<scanList count="1"><cvParam cvRef="MS" accession="MS:1000795" name="no combination" value=""/><scan><cvParam cvRef="MS" accession="MS:1000016" name="t" value="5.50" unitAccession="UO:0000031"/></scan></scanList>
<binaryDataArrayList count="1"><binaryDataArray encodedLength="24"><cvParam cvRef="MS" accession="MS:1000523" name="64-bit float" value=""/><cvParam cvRef="MS" accession="MS:1000576" name="no compression" value=""/><cvParam cvRef="MS" accession="MS:1000514" name="m/z array" value="" unitAccession="MS:1000040"/><binary>AAAAAAAA8D8AAAAAAAAAQA==</binary></binaryDataArray></binaryDataArrayList></spectrum>
<spectrum index="1" id="scan=2" defaultArrayLength="0"><cvParam cvRef="MS" accession="MS:1000511" name="ms level" value="1"/></spectrum></spectrumList></run></mzML>
"""


def test_mzml(spark, tmp_path):
    (tmp_path / "a.mzML").write_text(MZML)
    rows = {r["id"]: r for r in mzml.read_mzml(spark, str(tmp_path / "a.mzML")).collect()}
    a = rows["scan=1"]
    assert a["mz"] == [1.0, 2.0] and a["array_units"] == {"mz": "MS:1000040"}
    assert [p["accession"] for p in a["params"]] == ["MS:1000511", "MS:1000130"]
    assert a["scans"][0]["params"][0]["value"]["d"] == 5.5 and a["scan_combination"]["accession"] == "MS:1000795"
    assert a["user_params"][0]["name"] == "n" and a["user_params"][0]["type"] is None
    assert rows["scan=2"]["default_array_length"] == 0
    with pytest.raises(Exception, match="unresolved"):
        mzml.read_mzml(spark, str(tmp_path / "a.mzML"), strict=True).collect()


NESTED = """<?xml version="1.0"?>
<mzML xmlns="http://psi.hupo.org/ms/mzml"><referenceableParamGroupList count="2">
<referenceableParamGroup id="g"><cvParam accession="MS:1000130" value="{value}"/></referenceableParamGroup>
<referenceableParamGroup id="a"><cvParam accession="MS:1000523" value=""/><cvParam accession="MS:1000574" value=""/><cvParam accession="MS:1000514" value="" unitAccession="MS:1000040"/></referenceableParamGroup></referenceableParamGroupList>
<run><spectrumList count="1"><spectrum index="0" id="{id}" defaultArrayLength="2"><referenceableParamGroupRef ref="g"/>
<scanList count="1"><scan><referenceableParamGroupRef ref="g"/><scanWindowList count="1"><scanWindow><cvParam accession="MS:1000501" value="1"/><referenceableParamGroupRef ref="g"/></scanWindow></scanWindowList></scan></scanList>
<precursorList count="1"><precursor><isolationWindow><referenceableParamGroupRef ref="g"/></isolationWindow><selectedIonList count="1"><selectedIon><referenceableParamGroupRef ref="g"/></selectedIon></selectedIonList><activation><referenceableParamGroupRef ref="{last}"/></activation></precursor></precursorList>
<productList count="1"><product><isolationWindow><referenceableParamGroupRef ref="g"/></isolationWindow></product></productList>
<binaryDataArrayList count="1"><binaryDataArray encodedLength="24"><referenceableParamGroupRef ref="a"/><binary>{binary}</binary></binaryDataArray></binaryDataArrayList></spectrum></spectrumList></run></mzML>
"""


def test_groups_are_resolved_at_every_level_within_their_file(spark, tmp_path):
    import base64
    import struct
    import zlib

    binary = base64.b64encode(zlib.compress(struct.pack("<2d", 1.0, 2.0))).decode()
    for name, value, last in (("x", 7, "g"), ("y", 8, "gone")):
        (tmp_path / f"{name}.mzML").write_text(NESTED.format(id=name, value=value, last=last, binary=binary))
    read = lambda *names, **options: {r["id"]: r.asDict(recursive=True) for r in mzml.read_mzml(spark, [str(tmp_path / f"{n}.mzML") for n in names], **options).collect()}
    rows = read("x", "y")
    for name, value in (("x", 7), ("y", 8)):
        r = rows[name]
        scan, (precursor,), (product,) = r["scans"][0], r["precursors"], r["products"]
        lists = [r["params"], scan["params"], scan["windows"][0]["params"], precursor["isolation_window"]["params"], precursor["selected_ions"][0]["params"], product["isolation_window"]["params"]]
        assert [x[-1]["value"]["i"] for x in lists] == [value] * 6 and len(lists[2]) == 2
        assert r["mz"] == [1.0, 2.0] and r["array_units"] == {"mz": "MS:1000040"}
        assert [p["value"]["i"] for p in precursor["activation"]["params"]] == ([7] if name == "x" else [])
    assert read("x", strict=True)["x"]["mz"] == [1.0, 2.0]
    with pytest.raises(Exception, match="unresolved parameter group: gone"):
        read("y", strict=True)
    shared = mzml.read_param_groups(spark, str(tmp_path / "x.mzML")).drop("file")
    assert read("y", groups=shared)["y"]["params"][0]["value"]["i"] == 7
    plan = mzml.read_mzml(spark, str(tmp_path), groups=shared)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("ArrowEvalPython ") == 1


def test_mzml_parameters_are_typed_in_steps(spark, tmp_path):
    """In a lambda each mention of a part is worked out anew: two tests for a number for each list of parameters, no more."""
    (tmp_path / "a.mzML").write_text(MZML)
    plan = mzml.read_mzml(spark, str(tmp_path / "a.mzML"))._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.count("RLIKE") <= 20


def test_mzml_files_of_the_scan_are_small(spark, tmp_path, monkeypatch):
    """One task reads a file, so that their number must grow with the spectra, and rows are dealt before."""
    made = []
    monkeypatch.setattr(catalog, "_scratch", lambda _: made.append(tmp_path / f"s{len(made)}") or f"file://{made[-1]}")
    monkeypatch.setattr(catalog, "MZML_SPECTRA", 20)
    rows = catalog.mzml_scan(spark, "/root/testdata/sf0.001").collect()
    files = list(made[0].glob("part-*"))
    assert len(rows) > 1_000 and len({r["key"] for r in rows}) == len(rows)
    assert len(files) >= len(rows) / 20 and max(f.read_text().count("<spectrum ") for f in files) <= 20


def test_typed_values(spark):
    texts = ["2", "2.0", "1e3", "007", " 5 ", "x", "", "NaN", "5d", "2.5"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(params.typed_value(F.col("t")).alias("v"))
    got = [(r["v"]["kind"], r["v"]["i"] if r["v"]["i"] is not None else r["v"]["d"]) for r in df.collect()]
    assert got == [("int", 2), ("int", 2), ("int", 1000), ("int", 7), ("int", 5), ("str", None), ("null", None), ("str", None), ("str", None), ("float", 2.5)]



def test_failfast_stops_whatever_is_asked_for(spark, tmp_path):
    good = tokens.encode(spectra(spark, ("a", [1.0, 2.0], [3.0, 4.0], None))).first()["token"]
    bad = spark.createDataFrame([(good[:-1] + ("0" if good[-1] != "0" else "1"),)], "token string")
    for name in ("id", "mz", "intensity", "extra_arrays", "params", "default_array_length", "checksum", "format_version", "error"):
        with pytest.raises(Exception, match="checksum"):
            tokens.decode(bad).select(name).collect()
    wrong = spectra(spark, ("a", [1.0], [1.0, 2.0], None))
    for names in (("token",), ("id", "error"), ("long",)):
        with pytest.raises(Exception, match="array length"):
            tokens.encode(wrong).select(*names).collect()


def test_queries_run_the_udfs_of_their_columns_only(spark):
    df = spark.createDataFrame([("x",)], "token string")
    plan = lambda *names, mode="FAILFAST": tokens.decode(df, mode=mode).select(*names)._jdf.queryExecution().optimizedPlan().toString()
    runs = lambda text: text.count("ArrowEvalPython [")
    for mode in ("FAILFAST", "PERMISSIVE"):
        assert runs(plan("id", "params", mode=mode)) == 1
        one, all_ = plan("mz", mode=mode), plan("mz", "intensity", "charge", "extra_arrays", "error", mode=mode)
        assert runs(one) == 2 and runs(all_) == 2
        assert one.count("two(") < all_.count("two(")


def test_a_bad_array_leaves_the_others(spark):
    from mzframe.functions import tokens as T
    from mzframe.kernels import arrays, cbor

    part = lambda array, data: {0: 1000523, 1: array, 2: 1000574, 5: data}
    fine = arrays.encode([1.0, 2.0], 1000574, 1000523, None)
    for bad, name in ((fine[:-3], "intensity"), (arrays.encode([1.0], 1000574, 1000523, None), "intensity")):
        document = cbor.dumps({0: 2, 1: "a", 6: [part(1000514, fine), part(1000515, bad)]})
        df = spark.createDataFrame([(bytearray(document),)], "d binary").select(T.to_token(F.col("d")).alias("token"))
        row = tokens.decode(df, mode="PERMISSIVE").first()
        assert row["id"] == "a" and row["mz"] == [1.0, 2.0] and row[name] is None and row["error"]
        assert tokens.decode(df).select("mz").first()["mz"] == [1.0, 2.0]
        with pytest.raises(Exception, match="compressed data ends early|values instead"):
            tokens.decode(df).select(name).collect()


def test_sizes_beyond_an_int(spark):
    from mzframe.operators import analytics

    rows = spark.createDataFrame([(30_000_000,), (2_000_000_000,), (None,)], "n int")
    assert [r[0] for r in rows.select(analytics.format_bytes(F.col("n"))).collect()] == ["28.61 MB", "1907.35 MB", None]


def test_size_texts_of_long_pages(spark, tmp_path):
    from mzframe import catalog

    spark.range(1, 2).select(F.col("id").alias("page_id"), F.repeat(F.lit("a"), 8_000_000).alias("html")).write.parquet(f"{tmp_path}/pages.parquet")
    assert catalog.size_texts(spark, str(tmp_path)).first()["size"] == "2288.82 MB"


def test_token_faults_are_those_of_the_expressions(spark):
    from mzframe.kernels import batches, document

    good = tokens.encode(spectra(spark, ("a", [1.0, 2.0], [3.0, 4.0], None))).first()["token"]
    crc = lambda body: f"{body}.{__import__('zlib').crc32(body.encode()):08x}"
    body = good.rpartition(".")[0]
    cases = ["", "x", good, good + "é", "x" + good, body, good + ".", good.upper(), body + ".0000000G", body + ".00000000", *map(crc, (body + "=", body + "==", body + "===", body + "=A", body + "A", body + "AA", body + "+", body + " ", f"{U.MAGIC}.", f"{U.MAGIC}.A", f"{U.MAGIC}.=="))]
    df = spark.createDataFrame([(c,) for c in [*cases, None]], "t string")
    want = [r[0] for r in df.select(T.token_error(F.col("t"))).collect()]

    def fault(token):
        try:
            batches.payload(token, U.MAGIC.encode())
        except document.DocumentError as e:
            return str(e)

    assert [fault(c if c is None else c.encode()) for c in [*cases, None]] == want and len(set(want)) == 8
    made = spark.createDataFrame([(bytearray(b"\0\xff?>" * 99),)], "d binary").select(T.to_token(F.col("d"))).first()[0]
    assert batches._token(b"\0\xff?>" * 99, U.MAGIC) == made.encode() and batches.payload(made.encode(), U.MAGIC.encode()) == b"\0\xff?>" * 99


def test_long_texts_become_tokens_without_text_functions_of_spark(spark):
    """translate() over 12,000 characters, several times a row, had taken most of the time."""
    plan = tokens.encode(spectra(spark, ("a", [], [], None)))._jdf.queryExecution().optimizedPlan().toString()
    assert "translate(" not in plan and "crc32(" not in plan


def test_rows_of_a_small_file_are_dealt_before_they_grow(spark):
    from mzframe import catalog

    for rows in (catalog._texts(spark, "/root/testdata/sf0.001", 10), catalog.meta_spectra(spark, "/root/testdata/sf0.001")):
        assert rows.rdd.getNumPartitions() > 4


def test_batches_larger_than_a_slice(spark):
    df = spark.range(2_345).select(F.col("id").cast("string").alias("id"), F.array(F.col("id") + 0.5).alias("mz"), F.array(F.lit(2.0)).alias("intensity")).coalesce(1)
    back = tokens.decode(tokens.encode(df, lossless=True).select("token")).select("id", "mz", "error").collect()
    assert [(r["id"], r["mz"], r["error"]) for r in back] == [(str(i), [i + 0.5], None) for i in range(2_345)]


def test_a_plan_looks_at_each_array_once(spark):
    """What a lambda uses twice is worked out twice: the key's pattern had been matched dozens of times for each array."""
    plan = spectra(spark, ("a", [1.0], [1.0], None)).select(encoding_plan())._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RLIKE") <= 2
