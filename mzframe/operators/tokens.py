"""Spectra to tokens and back.

Validation, order and plan are built-in expressions. One Arrow UDF makes a token of a document's
bytes; decoding has one for the metadata and one for each array, and a query runs those
of the columns that it asks for, so that one of metadata alone, or of one array, never inflates the
others."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, StructType

from mzframe import registry as R
from mzframe import schema as S
from mzframe.functions.urls import MAGIC
from mzframe.operators.peaks import canonical_sort, complete, drop_user_params
from mzframe.operators.validation import errors
from mzframe.plans.encoding import encoding_plan

HEADER = ", ".join(f"{k}: {v}" for k, v in {"default_array_length": "int", **S.METADATA, "descriptors": f"array<{S.DESCRIPTOR}>", "document_bytes": "int"}.items())


@cache
def _udfs() -> tuple:
    """build(spectrum with plan), parse(document), inflate(descriptor, length), inflate_lists(descriptors, length).

    Made once, when a session is there."""
    from mzframe.kernels import batches

    def made(f: Callable, kind: str) -> Callable:
        arrow = to_arrow_type(StructType.fromDDL(kind))

        def one(a: pa.Array) -> pa.Array:
            return batches.sliced(lambda x: f(x, arrow), a)

        def two(a: pa.Array, b: pa.Array) -> pa.Array:
            return batches.sliced(lambda x, y: f(x, y, arrow), a, b)

        # so marked, no filter or projection above a UDF is moved below it or makes Spark run it twice
        return F.arrow_udf(one if f in (batches.build, batches.parse) else two, kind).asNondeterministic()

    return (
        made(batches.build, "document binary, error string"),
        made(batches.parse, f"header struct<{HEADER}>, error string"),
        made(batches.inflate, "values array<double>, error string"),
        made(batches.inflate_lists, "values array<array<double>>, error string"),
    )


@cache
def _token_udfs(magic: str) -> tuple:
    """build(spectrum with plan) and parse(a token's bytes) with the text form around the document.

    Text functions of Spark that go character by character would take most of the time of a long token."""
    from mzframe.kernels import batches

    def made(f: Callable, kind: str) -> Callable:
        arrow = to_arrow_type(StructType.fromDDL(kind))

        def one(a: pa.Array) -> pa.Array:
            return batches.sliced(lambda x: f(x, arrow, magic), a)

        return F.arrow_udf(one, kind).asNondeterministic()

    return made(batches.build_tokens, "token string, error string"), made(batches.parse_tokens, f"header struct<{HEADER}>, error string")


def _failing(value: Column, error: Column) -> Column:
    """The value, or a failure of the job where there is an error."""
    return F.when(error.isNotNull(), F.raise_error(error)).otherwise(value)


def encode(spectra: DataFrame, lossless: bool = False, array_encodings: Mapping[str, object] | None = None, allow_unsafe_lossy_custom: bool = False, without_user_params: bool = False, max_len: int | None = None, magic: str = MAGIC, mode: str = "FAILFAST") -> DataFrame:
    """spectra with `token`, `long` (more characters than URLs bear well) and `error`.

    FAILFAST stops at the first error, whichever of the three is asked for; PERMISSIVE leaves token null
    and says why in error."""
    if mode not in ("FAILFAST", "PERMISSIVE"):
        raise ValueError(f"unknown mode {mode!r}")
    rows = complete(spectra)
    rows = rows.withColumn("_faults", errors())  # before the sort, which would hide that arrays differ in length
    rows = canonical_sort(drop_user_params(rows) if without_user_params else rows)
    rows = rows.withColumn("_plan", encoding_plan(lossless, array_encodings, allow_unsafe_lossy_custom))
    unknown = [k for k in map(str, array_encodings or {}) if k not in R.CORE and k not in R.CORE.values()]
    missing = F.array_except(F.array(*map(F.lit, unknown)), F.map_keys("extra_arrays")) if unknown else F.array().cast("array<string>")
    faults = F.concat("_faults", F.when(F.size(missing) > 0, F.array(F.concat(F.lit("encodings name unknown arrays: "), F.array_join(missing, ", ")))).otherwise(F.array().cast("array<string>")), F.array_compact(F.transform("_plan", lambda e: e["error"])))
    fault = F.try_element_at(faults, F.lit(1))
    plan = F.transform("_plan", lambda e: e.dropFields("error"))
    # bad rows enter the UDF as null: Spark may evaluate a UDF before a filter beside it
    row = F.when(F.size(faults) == 0, F.struct(*S.COLUMNS, plan.alias("plan")))
    built = rows.withColumn("_built", _token_udfs(magic)[0](row))
    token = F.col("_built.token")
    error = F.coalesce(fault, F.col("_built.error"))
    if max_len is not None:
        error = F.coalesce(error, F.when(F.length(token) > max_len, F.concat(F.lit("token is longer than "), F.lit(str(max_len)))))
    out = built.withColumn("error", error).withColumn("token", F.when(F.col("error").isNull(), token)).drop("_built", "_plan", "_faults")
    if mode == "FAILFAST":
        out = out.withColumns({"token": _failing(F.col("token"), F.col("error")), "error": _failing(F.lit(None).cast("string"), F.col("error"))})
    return out.withColumn("long", F.length("token") > R.WARN_LENGTH)


def read_header(tokens: DataFrame, token: str = "token", magic: str = MAGIC) -> DataFrame:
    """tokens with `header` (metadata and descriptors) and `error`; arrays stay compressed."""
    parsed = tokens.withColumn("_parsed", _token_udfs(magic)[1](F.col(token).cast("binary")))
    return parsed.withColumns({"header": F.col("_parsed.header"), "error": F.col("_parsed.error")}).drop("_parsed")


def decode(tokens: DataFrame, token: str = "token", magic: str = MAGIC, mode: str = "FAILFAST") -> DataFrame:
    """tokens with the columns of a spectrum, `checksum`, `format_version` and `error`.

    They replace other columns of their names. Each column needs only its own part of a token: metadata
    its document, an array its own bytes; a query of metadata alone inflates nothing. PERMISSIVE gives
    null for what is bad, and `error` the first fault of the whole token, for which it looks at all.
    FAILFAST stops at a fault in what is asked for, as Spark's own readers do when they prune columns."""
    if mode not in ("FAILFAST", "PERMISSIVE"):
        raise ValueError(f"unknown mode {mode!r}")
    made = {*S.COLUMNS, "checksum", "format_version", "error", "header"}
    keep = [c for c in tokens.columns if c not in made]
    source = tokens.select(*keep, *([F.col(token).alias("_token")] if token in made else []))
    text = F.col("_token" if token in made else token)
    rows = read_header(source, "_token" if token in made else token, magic)
    h, n = F.col("header"), F.col("header.default_array_length")
    _, _, inflate, inflate_lists = _udfs()
    core = {"mz": R.ARRAY_MZ, "intensity": R.ARRAY_INTENSITY, "charge": R.ARRAY_CHARGE}
    of = lambda tail: F.try_element_at(F.filter(h["descriptors"], lambda d: d["array"] == tail), F.lit(1))
    rows = rows.withColumns({**{f"_{name}": of(tail) for name, tail in core.items()}, "_others": F.filter(h["descriptors"], lambda d: ~d["array"].isin(*core.values()))})
    # in one projection, so that one pass through Python serves all arrays that are asked for
    rows = rows.withColumns({**{f"_{name}": inflate(F.col(f"_{name}"), n) for name in core}, "_extra": inflate_lists(F.col("_others"), n)})
    named = lambda d: F.coalesce(d["name"], F.concat(F.lit("MS:"), F.format_string("%07d", d["array"])))
    dtype = lambda d: F.when(d["type"] == R.FLOAT32, "float32").when(d["type"] == R.INT32, "int32").otherwise("float64")
    entries = F.zip_with("_others", "_extra.values", lambda d, v: F.struct(named(d), F.struct(dtype(d).alias("dtype"), v.alias("values"))))
    core_names = F.create_map(*(F.lit(x) for k, v in core.items() for x in (v, k)))
    units = F.map_from_entries(F.transform(F.filter(h["descriptors"], lambda d: d["unit"].isNotNull()), lambda d: F.struct(F.coalesce(F.try_element_at(core_names, d["array"]), named(d)), d["unit"])))
    whole = F.col("error")
    faults = {"mz": F.coalesce("_mz.error", F.when(F.array_min("_mz.values") < 0, "m/z is negative")), "intensity": F.col("_intensity.error"), "charge": F.col("_charge.error"), "extra_arrays": F.col("_extra.error")}
    values = {c: h[c] for c in S.METADATA} | {f: F.col(f"_{f}.values") for f in core}
    values |= {"default_array_length": n, "array_units": units, "extra_arrays": F.when(F.col("_extra.values").isNotNull(), F.map_from_entries(entries))}
    values |= {"checksum": F.substring_index(text, ".", -1), "format_version": F.lit(R.FORMAT_VERSION)}
    every = F.coalesce(whole, *faults.values())

    def shown(name: str) -> Column:
        fault, value = F.coalesce(whole, faults[name]) if name in faults else whole, values[name].cast(S.COLUMNS.get(name, "int" if name == "format_version" else "string"))
        return (_failing(value, fault) if mode == "FAILFAST" else F.when(fault.isNull(), value)).alias(name)

    error = _failing(F.lit(None).cast("string"), every) if mode == "FAILFAST" else every
    return rows.select(*keep, *map(shown, (*S.COLUMNS, "checksum", "format_version")), error.alias("error"))


def inspect(tokens: DataFrame, key: str, token: str = "token", magic: str = MAGIC) -> DataFrame:
    """A row for each array of each token: key, pos, array, name, type, compression, fixed_point, compressed_bytes, unit."""
    rows = read_header(tokens.select(key, token), token, magic).select(key, F.posexplode("header.descriptors").alias("pos", "d"))
    ms = lambda c: F.concat(F.lit("MS:"), F.format_string("%07d", c))
    return rows.select(key, "pos", ms(F.col("d.array")).alias("array"), F.col("d.name").alias("name"), ms(F.col("d.type")).alias("type"), ms(F.col("d.comp")).alias("compression"), F.col("d.fp").alias("fixed_point"), F.octet_length("d.data").alias("compressed_bytes"), F.col("d.unit").alias("unit"))


def breakdown(tokens: DataFrame, key: str, token: str = "token", magic: str = MAGIC) -> DataFrame:
    """A row for each part of each token: key, part, bytes. The header, first, is what the arrays leave of the document."""
    rows = read_header(tokens.select(key, token), token, magic).where("error is null")
    shown = {R.ARRAY_MZ: "m/z", R.ARRAY_INTENSITY: "intensity", R.ARRAY_CHARGE: "charge", 1000517: "signal-to-noise", **dict.fromkeys(R.MOBILITY_ARRAYS, "ion mobility")}
    names = F.create_map(*(F.lit(x) for pair in shown.items() for x in pair))
    part = lambda d: F.struct(F.coalesce(F.try_element_at(names, d["array"]), d["name"], F.concat(F.lit("MS:"), d["array"].cast("string"))).alias("part"), F.octet_length(d["data"]).alias("bytes"))
    ds = F.col("header.descriptors")
    data = F.aggregate(ds, F.lit(0), lambda s, d: s + F.octet_length(d["data"]))
    head = F.array(F.struct(F.lit("header").alias("part"), (F.col("header.document_bytes") - data).alias("bytes")))
    return rows.select(key, F.posexplode(F.concat(head, F.transform(ds, part))).alias("pos", "p")).select(key, "pos", "p.part", "p.bytes")


def dump(tokens: DataFrame, key: str, token: str = "token", magic: str = MAGIC) -> DataFrame:
    """key, document_bytes and header: the metadata as JSON, with the size of each array in place of its bytes. Bad tokens are left out."""
    rows = read_header(tokens.select(key, token), token, magic).where("error is null")
    h = F.col("header")
    arrays = F.transform(h["descriptors"], lambda d: d.dropFields("data").withField("compressed_bytes", F.octet_length(d["data"])))
    shown = F.to_json(h.withField("descriptors", arrays).dropFields("document_bytes"))
    return rows.select(key, F.col("header.document_bytes").alias("document_bytes"), shown.alias("header"))


def is_lossy(descriptors: Column) -> Column:
    return F.exists(descriptors, lambda d: d["comp"].isin(*R.LOSSY))


def mode_sizes(spectra: DataFrame, key: str = "id", **options: object) -> DataFrame:
    """key, lossy, lossless (characters of a token in either mode), percent (how much longer the lossless one is)."""
    lossy = encode(spectra, **options).select(*(c for c in spectra.columns), F.length("token").alias("_lossy"))
    both = encode(lossy, lossless=True)
    return both.select(key, F.col("_lossy").alias("lossy"), F.length("token").alias("lossless"), ((F.length("token") / F.col("_lossy") - 1) * 100).alias("percent"))


PEAKS = "pos int, mz double, intensity double, charge double"


@cache
def _peaks_udf() -> Callable:
    """The peaks of a token as a list. Not marked as nondeterministic, which a lateral subquery may not be."""
    from mzframe.kernels import batches

    arrow = to_arrow_type(ArrayType(StructType.fromDDL(PEAKS)))

    def peaks(a: pa.Array) -> pa.Array:
        return batches.sliced(lambda x: batches.token_peaks(x, arrow, MAGIC), a)

    return F.arrow_udf(peaks, f"array<struct<{PEAKS}>>")


def register_functions(spark: SparkSession) -> None:
    """For SQL: the scalar functions token_document(spectrum with plan), token_header(document),
    token_array(descriptor, length) and token_peaks(token), and the table function explode_token(token):
    pos, mz, intensity, charge, a row for each peak. A bad token is an error.

    The table function is one of SQL over token_peaks, which goes batch by batch; one of Python is called token by token."""
    build, parse, inflate, _ = _udfs()
    for name, f in (("token_document", build), ("token_header", parse), ("token_array", inflate), ("token_peaks", _peaks_udf())):
        spark.udf.register(name, f)
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION explode_token(token STRING) RETURNS TABLE({PEAKS}) RETURN SELECT p.pos, p.mz, p.intensity, p.charge FROM inline(token_peaks(explode_token.token)) p(pos, mz, intensity, charge)")
