"""mzML files through Spark's XML reader: a row for each spectrum element. One task reads a file.

A file is read once for its spectra and once for its parameter groups. The groups of a file come to
its spectra as one map, in one join by file, and are resolved at every level (spectrum, scan, window,
isolation, ion, activation, product, binary array) by lookups in that map. Arrays are decoded inside
their row by one Arrow UDF, so no spectrum is taken apart and put together again."""

from __future__ import annotations

import base64
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mzframe import registry as R
from mzframe import schema as S
from mzframe.operators.params import kind_of, number_in, tagged
from mzframe.operators.peaks import complete

_CV = "array<struct<_accession: string, _value: string, _unitAccession: string>>"
_USER = "array<struct<_name: string, _value: string, _type: string, _unitAccession: string>>"
_REF = "array<struct<_ref: string>>"
_PART = f"cvParam: {_CV}, userParam: {_USER}, referenceableParamGroupRef: {_REF}"
_GROUP = f"struct<{_PART}>"
BINARY = f"array<struct<cvParam: {_CV}, referenceableParamGroupRef: {_REF}, binary: string>>"
SPECTRUM = (
    f"_id string, _index int, _defaultArrayLength int, cvParam {_CV}, userParam {_USER}, referenceableParamGroupRef {_REF}, "
    f"scanList struct<cvParam: {_CV}, scan: array<struct<{_PART}, scanWindowList: struct<scanWindow: array<{_GROUP}>>>>>, "
    f"precursorList struct<precursor: array<struct<isolationWindow: {_GROUP}, selectedIonList: struct<selectedIon: array<{_GROUP}>>, activation: {_GROUP}>>>, "
    f"productList struct<product: array<struct<isolationWindow: {_GROUP}>>>, "
    f"binaryDataArrayList struct<binaryDataArray: {BINARY}>"
)
GROUP = f"_id string, cvParam {_CV}"
#: Accessions of types and compressions in mzML.
TYPES = {"MS:1000523": "<f8", "MS:1000521": "<f4", "MS:1000519": "<i4", "MS:1000522": "<i8"}


#: Groups that are given beside the files, for all of them, are a document's header, so they are few.
MOST_SHARED_GROUPS = 10_000


def _params(cv: Column) -> Column:
    # number, kind and value one after the other: a lambda works out each mention of a part anew
    rows = F.transform(cv, lambda p: F.struct(p["_accession"].alias("accession"), p["_value"].alias("text"), p["_unitAccession"].alias("unit"), number_in(p["_value"]).alias("number")))
    rows = F.transform(rows, lambda p: F.struct(p.alias("p"), kind_of(p["text"], p["number"]).alias("kind")))
    rows = F.transform(rows, lambda k: F.struct(k["p"]["accession"].alias("accession"), tagged(k["p"]["text"], k["p"]["number"], k["kind"]).alias("value"), F.nullif(k["p"]["unit"], F.lit("")).alias("unit_accession")))
    return F.coalesce(rows, F.array()).cast(f"array<{S.CV}>")


def _users(u: Column) -> Column:
    # user parameters keep their text
    value = lambda v: F.struct(F.when(F.coalesce(v, F.lit("")) == "", "null").otherwise("str").alias("kind"), F.lit(None).cast("bigint").alias("i"), F.lit(None).cast("double").alias("d"), F.nullif(v, F.lit("")).alias("s"))
    return F.coalesce(F.transform(u, lambda p: F.struct(p["_name"].alias("name"), value(p["_value"]).alias("value"), F.nullif(p["_type"], F.lit("")).alias("type"), F.nullif(p["_unitAccession"], F.lit("")).alias("unit_accession"))), F.array()).cast(f"array<{S.USER}>")


def _read(spark: SparkSession, path: str | list[str], tag: str, schema: str) -> DataFrame:
    rows = spark.read.format("xml").option("rowTag", tag).schema(schema).load(path).where("_id is not null")
    return rows.select("*", F.col("_metadata.file_path").alias("file"))


def read_param_groups(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, ref, params) of the reference parameter groups. A group's name holds within its file only."""
    rows = _read(spark, path, "referenceableParamGroup", GROUP)
    return rows.select("file", F.col("_id").alias("ref"), _params(F.col("cvParam")).alias("params"))


def _with_groups(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """rows with the map `groups` from names to parameters: those of the file, or the shared ones if groups has no file."""
    entry = F.struct("ref", "params")
    if "file" in groups.columns:  # of groups of one name, the last by parameters
        one = groups.groupBy("file", "ref").agg(F.max_by("params", F.to_json("params")).alias("params"))
        return rows.join(one.groupBy("file").agg(F.map_from_entries(F.collect_list(entry)).alias("groups")), "file", "left")
    if (n := groups.limit(MOST_SHARED_GROUPS + 1).count()) > MOST_SHARED_GROUPS:
        raise ValueError(f"{n} shared parameter groups; give them with their files")
    one = groups.groupBy("ref").agg(F.max_by("params", F.to_json("params")).alias("params"))
    text = one.agg(F.to_json(F.map_from_entries(F.collect_list(entry)))).first()[0]
    return rows.withColumn("groups", F.from_json(F.lit(text or "{}"), f"map<string, array<{S.CV}>>"))


class Refs:
    """Parameters of elements with those of the groups that they name behind them."""

    def __init__(self, strict: bool):
        self.strict, self.groups = strict, F.col("groups")

    def params(self, element: Column) -> Column:
        def of(ref: Column) -> Column:
            found = F.try_element_at(self.groups, ref["_ref"])
            if not self.strict:
                return F.coalesce(found, F.array().cast(f"array<{S.CV}>"))
            missing = F.raise_error(F.concat(F.lit("unresolved parameter group: "), F.coalesce(ref["_ref"], F.lit(""))))
            return F.when(found.isNull(), missing.cast(f"array<{S.CV}>")).otherwise(found)

        named = F.coalesce(F.flatten(F.transform(element["referenceableParamGroupRef"], of)), F.array().cast(f"array<{S.CV}>"))
        return F.concat(_params(element["cvParam"]), named)

    def window(self, element: Column) -> Column:
        return F.when(element.isNotNull(), F.struct(self.params(element).alias("params"))).cast(S.WINDOW)

    def windows(self, elements: Column) -> Column:
        return F.coalesce(F.transform(elements, self.window), F.array()).cast(f"array<{S.WINDOW}>")


def _decoded(text: str | None, kind: str | None, packed: bool) -> np.ndarray:
    if kind is None:
        return np.zeros(0)
    raw = base64.b64decode(text or "")
    return np.frombuffer(zlib.decompress(raw) if packed and raw else raw, TYPES[kind]).astype(float)


def _values(arrays: Column) -> Column:
    """The doubles of a row's arrays (text, type, packed); no built-in function reads bytes as numbers."""

    @F.arrow_udf("array<array<double>>")
    def decode(column: pa.Array) -> pa.Array:
        offsets = column.offsets.to_numpy()
        each = column.values.slice(int(offsets[0]), int(offsets[-1] - offsets[0]))
        fields = zip(*(c.to_pylist() for c in each.flatten()), strict=True)
        parts = [_decoded(*x) for x in fields]
        ends = np.concatenate([[0], np.cumsum([len(x) for x in parts], dtype="int64")]).astype("int32")
        inner = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0), *parts])))
        return pa.ListArray.from_arrays(pa.array((offsets - offsets[0]).astype("int32")), inner, mask=column.is_null())

    return decode(arrays)


def read_mzml(spark: SparkSession, path: str | list[str], strict: bool = False, groups: DataFrame | None = None) -> DataFrame:
    """Spectra of mzML files, with parameters of reference groups behind an element's own.

    groups: (ref, params) for all files, or with a column file for each; those of the files themselves
    otherwise. strict: a reference to a missing group is an error, at any level; else it is skipped.
    Chromatograms and the run's own metadata are left out. Arrays: 32 and 64 bit, plain or zlib; their
    type, compression and kind may come from groups."""
    raw = _with_groups(_read(spark, path, "spectrum", SPECTRUM), read_param_groups(spark, path) if groups is None else groups)
    refs = Refs(strict)
    every = F.coalesce(F.col("binaryDataArrayList.binaryDataArray"), F.array().cast(BINARY))
    raw = raw.withColumn("held", F.transform(every, lambda a: F.struct(a["binary"].alias("binary"), refs.params(a).alias("params"))))

    def sought(a: Column) -> Column:
        kind = F.try_element_at(F.filter(a["params"], lambda p: p["accession"].isin([f"MS:{t}" for t in R.ARRAYS])), F.lit(1))
        return F.struct(a["binary"].alias("binary"), kind.alias("kind"), F.transform(a["params"], lambda p: p["accession"]).alias("names"))

    def described(a: Column) -> Column:
        kind, names = a["kind"], a["names"]
        own = F.when(kind["accession"] == f"MS:{R.ARRAY_NON_STANDARD}", F.coalesce(kind["value"]["s"], kind["value"]["i"].cast("string"), kind["value"]["d"].cast("string"), F.lit("non-standard"))).otherwise(kind["accession"])
        dtype = F.try_element_at(F.filter(names, lambda n: n.isin(list(TYPES))), F.lit(1))
        return F.struct(own.alias("name"), kind["unit_accession"].alias("unit"), a["binary"].alias("text"), dtype.alias("type"), F.array_contains(names, "MS:1000574").alias("packed"))

    raw = raw.withColumn("held", F.filter(F.transform(F.transform("held", sought), described), lambda a: a["name"].isNotNull()))
    raw = raw.withColumn("values", _values(F.transform("held", lambda a: F.struct(a["text"], a["type"], a["packed"]))))
    dtype = lambda t: F.when(t == "MS:1000521", "float32").when(t == "MS:1000519", "int32").otherwise("float64")
    raw = raw.withColumn("arrays", F.zip_with("held", "values", lambda a, v: F.struct(a["name"].alias("name"), a["unit"].alias("unit"), dtype(a["type"]).alias("dtype"), F.when(a["type"].isNotNull(), v).alias("values"))))

    named = F.col("arrays")
    of = lambda accession: F.try_element_at(F.filter(named, lambda a: a["name"] == accession), F.lit(1))["values"]
    extra = F.filter(named, lambda a: ~a["name"].isin(list(R.CORE)))
    core = F.create_map(*(F.lit(x) for pair in R.CORE.items() for x in pair))
    units = F.filter(named, lambda a: a["unit"].isNotNull())
    scans = F.transform("scanList.scan", lambda s: F.struct(refs.params(s).alias("params"), refs.windows(s["scanWindowList"]["scanWindow"]).alias("windows"), _users(s["userParam"]).alias("user_params")))
    precursors = F.transform("precursorList.precursor", lambda p: F.struct(refs.window(p["isolationWindow"]).alias("isolation_window"), refs.windows(p["selectedIonList"]["selectedIon"]).alias("selected_ions"), refs.window(p["activation"]).alias("activation")))
    products = F.transform("productList.product", lambda p: F.struct(refs.window(p["isolationWindow"]).alias("isolation_window")))
    rows = raw.select(
        F.col("_id").alias("id"),
        F.col("_defaultArrayLength").alias("default_array_length"),
        of("MS:1000514").alias("mz"),
        of("MS:1000515").alias("intensity"),
        of("MS:1000516").alias("charge"),
        F.map_from_entries(F.transform(extra, lambda a: F.struct(a["name"], F.struct(a["dtype"].alias("dtype"), a["values"].alias("values"))))).alias("extra_arrays"),
        F.map_from_entries(F.transform(units, lambda a: F.struct(F.coalesce(F.try_element_at(core, a["name"]), a["name"]), a["unit"]))).alias("array_units"),
        refs.params(F.struct("cvParam", "referenceableParamGroupRef")).alias("params"),
        F.coalesce(scans, F.array()).cast(f"array<{S.SCAN}>").alias("scans"),
        F.try_element_at(_params(F.col("scanList.cvParam")), F.lit(1)).alias("scan_combination"),
        precursors.alias("precursors"),
        products.alias("products"),
        _users(F.col("userParam")).alias("user_params"),
    )
    return complete(rows)
