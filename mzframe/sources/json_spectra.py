"""Spectra as JSON, an object a line.

Values of parameters keep whether they are whole, fractional or text. Extra arrays are plain lists,
read as doubles, or objects with dtype and values, as written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mzframe import schema as S
from mzframe.operators.peaks import complete


def _json_type(kind: str) -> str:
    """The schema with values and extra arrays left as variants."""
    return kind.replace(S.VALUE, "variant").replace(S.EXTRA, "variant")


def _value(v: Column) -> Column:
    shape = F.schema_of_variant(v)
    whole = shape.isin("BIGINT", "INT", "SMALLINT", "TINYINT")
    number = shape.startswith("DECIMAL") | shape.isin("DOUBLE", "FLOAT")
    kind = F.when(v.isNull() | (shape == "VOID"), "null").when(whole, "int").when(number, "float").otherwise("str")
    get = lambda when, t: F.when(kind == when, F.try_variant_get(v, "$", t))
    return F.struct(kind.alias("kind"), get("int", "bigint").alias("i"), get("float", "double").alias("d"), get("str", "string").alias("s"))


def _cv(p: Column) -> Column:
    return F.when(p.isNotNull(), F.struct(p["accession"].alias("accession"), _value(p["value"]).alias("value"), p["unit_accession"].alias("unit_accession")))


def _user(u: Column) -> Column:
    return F.struct(u["name"].alias("name"), _value(u["value"]).alias("value"), u["type"].alias("type"), u["unit_accession"].alias("unit_accession"))


def _list(c: Column, f) -> Column:  # noqa: ANN001
    return F.coalesce(F.transform(c, f), F.array())


def _window(w: Column) -> Column:
    return F.when(w.isNotNull(), F.struct(_list(w["params"], _cv).alias("params")))


def _extra(x: Column) -> Column:
    plain = F.try_variant_get(x, "$", "array<double>")
    return F.struct(F.coalesce(F.try_variant_get(x, "$.dtype", "string"), F.lit("float64")).alias("dtype"), F.coalesce(plain, F.try_variant_get(x, "$.values", "array<double>")).alias("values"))


def from_json(text: Column) -> dict[str, Column]:
    """Spectrum columns of a JSON text; what is missing is null or empty, the length that of the m/z array or 0."""
    kinds = {**S.COLUMNS, "extra_arrays": "map<string, variant>"}
    j = F.from_json(text, ", ".join(f"{k} {_json_type(v)}" for k, v in kinds.items()))
    out = {c: j[c] for c in S.COLUMNS}
    out["params"] = _list(j["params"], _cv)
    out["user_params"] = _list(j["user_params"], _user)
    out["scans"] = _list(j["scans"], lambda s: F.struct(_list(s["params"], _cv).alias("params"), _list(s["windows"], _window).alias("windows"), _list(s["user_params"], _user).alias("user_params")))
    out["scan_combination"] = _cv(j["scan_combination"])
    out["precursors"] = _list(j["precursors"], lambda p: F.struct(_window(p["isolation_window"]).alias("isolation_window"), _list(p["selected_ions"], _window).alias("selected_ions"), _window(p["activation"]).alias("activation")))
    out["products"] = _list(j["products"], lambda p: F.struct(_window(p["isolation_window"]).alias("isolation_window")))
    out["extra_arrays"] = F.transform_values(j["extra_arrays"], lambda _, x: _extra(x))
    out["default_array_length"] = F.coalesce(j["default_array_length"], F.size(F.coalesce(j["mz"], F.array().cast("array<double>"))))
    return out


def read_json(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.text(path).where("trim(value) <> ''")
    return complete(rows.select(*(c.alias(n) for n, c in from_json(F.col("value")).items())))


def _plain(v: Column) -> Column:
    """A tagged value as JSON text."""
    quoted = F.to_json(F.array(v["s"])).substr(F.lit(2), F.length(F.to_json(F.array(v["s"]))) - 2)
    return F.when(v["kind"] == "int", v["i"].cast("string")).when(v["kind"] == "float", v["d"].cast("string")).when(v["kind"] == "str", quoted).otherwise("null")


def to_json(spectra: DataFrame, column: str = "json") -> DataFrame:
    """spectra with their JSON text; nulls are written, checksum and version are not."""
    variant = lambda v: F.try_parse_json(_plain(v))
    cv = lambda p: p.withField("value", variant(p["value"]))
    window = lambda w: w.withField("params", F.transform(w["params"], cv))
    made = {c: F.col(c) for c in S.COLUMNS}
    made["params"], made["user_params"], made["scan_combination"] = F.transform("params", cv), F.transform("user_params", cv), cv(F.col("scan_combination"))
    made["scans"] = F.transform("scans", lambda s: F.struct(F.transform(s["params"], cv).alias("params"), F.transform(s["windows"], window).alias("windows"), F.transform(s["user_params"], cv).alias("user_params")))
    made["precursors"] = F.transform("precursors", lambda p: F.struct(window(p["isolation_window"]).alias("isolation_window"), F.transform(p["selected_ions"], window).alias("selected_ions"), window(p["activation"]).alias("activation")))
    made["products"] = F.transform("products", lambda p: F.struct(window(p["isolation_window"]).alias("isolation_window")))
    return spectra.withColumn(column, F.to_json(F.struct(*(c.alias(n) for n, c in made.items())), {"ignoreNullFields": "false"}))


def write_json(spectra: DataFrame, path: str) -> None:
    to_json(spectra, "value").select("value").write.text(path)
