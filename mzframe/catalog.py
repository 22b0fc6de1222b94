"""Registered queries of the spectrum operators and the SQL that gives the same rows.

An order is a spectrum and its line items are the peaks: m/z is the price over 100, the intensity
the quantity times 1,000, the charge the line number; discount and tax are extra arrays."""

from __future__ import annotations

import base64
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mzframe import registry as R
from mzframe import schema as S
from mzframe.functions import accessions as A
from mzframe.functions import quantize as Q
from mzframe.functions import tokens as T
from mzframe.functions import urls as U
from mzframe.operators import analytics, params, peaks, tokens, validation
from mzframe.plans.encoding import plan_table
from mzframe.sources import json_spectra, mzml, token_text
from mzframe.streaming.tokens import decoded_stream, error_counts

ORDER = ["l_linenumber", "l_partkey", "l_suppkey"]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _spread(rows: DataFrame) -> DataFrame:
    """Dealt over the cluster while rows are narrow: a small file is read by one task, whatever is made of its rows."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism)


def _key() -> Column:
    return F.col("id").cast("bigint").alias("key")


def _scratch(spark: SparkSession) -> str:
    """A new path in the folder that the cluster shares; one machine by itself may do with a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='mzframe-')}"
    return f"{base.rstrip('/')}/mzframe-{uuid.uuid4().hex}"


def _stored(rows: DataFrame) -> DataFrame:
    """Written and read again, as tokens are between a producer and a consumer."""
    path = _scratch(rows.sparkSession)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def line_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The peak table."""
    made = {"mz": F.col("l_extendedprice") / 100, "intensity": F.col("l_quantity") * 1000, "charge": F.col("l_linenumber").cast("double"), "noise": F.col("l_discount"), "tax": F.col("l_tax")}
    return _table(spark, sf_dir, "lineitem").select("l_orderkey", *ORDER, *(c.alias(n) for n, c in made.items()))


def line_spectra(spark: SparkSession, sf_dir: str, mz: Column | None = None, intensity: Column | None = None, spread: bool = False) -> DataFrame:
    """The spectrum table; mz and intensity replace those columns of the peaks. spread: in more parts than Spark
    would make of the bytes that it shuffles, for spectra that much is made of; still one shuffle."""
    rows = line_peaks(spark, sf_dir)
    rows = rows.repartition(4 * spark.sparkContext.defaultParallelism, F.col("l_orderkey").cast("string")) if spread else rows
    rows = rows.withColumns({n: c for n, c in (("mz", mz), ("intensity", intensity)) if c is not None})
    arrays = {"mz": "mz", "intensity": "intensity", "charge": "charge"}
    return peaks.spectra_from_peaks(rows, "l_orderkey", ORDER, arrays, {"MS:1000517": ("noise", "float64"), "tax": ("tax", "float64")})


def _peaks_of(spectra: DataFrame) -> DataFrame:
    return peaks.peak_table(spectra).select(_key(), "pos", "mz", "intensity", "charge")


def _rounded(rows: DataFrame, *names: str) -> DataFrame:
    return rows.withColumns({n: F.round(n, 6) for n in names})


def canonical_sort(spark, d):
    return _peaks_of(peaks.canonical_sort(line_spectra(spark, d)))


def canonical_sort_ties(spark, d):
    return _peaks_of(peaks.canonical_sort(line_spectra(spark, d, mz=F.floor(F.col("l_partkey") % 3).cast("double"))))


def top_n_3(spark, d):
    return _peaks_of(peaks.top_n(line_spectra(spark, d), 3))


def top_n_ties(spark, d):
    return _peaks_of(peaks.top_n(line_spectra(spark, d, intensity=F.floor(F.col("intensity") / 20000)), 2))


def top_n_0(spark, d):
    before = line_spectra(spark, d).withColumn("n_before", F.size("mz"))
    return peaks.top_n(before, 0).select(_key(), "n_before", "default_array_length", (F.size("mz") + F.size("intensity") + F.size("charge") + F.size(F.element_at("extra_arrays", "tax")["values"])).alias("left"))


def top_n_all(spark, d):
    return _peaks_of(peaks.top_n(line_spectra(spark, d), 1000))


def top_n_peak_table(spark, d):
    return peaks.rank_peaks(line_peaks(spark, d), "l_orderkey", 2, ORDER).select(F.col("l_orderkey").alias("key"), "rank", "mz", "intensity")


def drop_user_params(spark, d):
    spectra = meta_spectra(spark, d)
    users = lambda c: F.aggregate(F.col("scans"), F.size(c), lambda n, s: n + F.size(s["user_params"]))
    spectra = spectra.withColumn("n_before", users("user_params"))
    return peaks.drop_user_params(spectra).select(_key(), "n_before", users("user_params").alias("n_user"), F.size("params").alias("n_params"))


def mobility_view(spark, d):
    extra = F.map_concat("extra_arrays", F.create_map(F.lit("MS:1003008"), F.element_at("extra_arrays", "tax")))
    spectra = line_spectra(spark, d).withColumn("extra_arrays", extra)
    arrays = spectra.select(_key(), F.explode(peaks.mobility_arrays(F.col("extra_arrays"))).alias("name", "x"))
    return arrays.select("key", "name", F.posexplode("x.values").alias("pos", "value"))


def quantize_linear(spark, d):
    return _rounded(line_peaks(spark, d).select(F.col("l_orderkey").alias("key"), *ORDER, Q.linear_round_trip(F.col("mz")).alias("mz")), "mz")


def _slof(spark, d, factor):
    spectra = line_spectra(spark, d, intensity=F.col("intensity") * factor)
    fp = Q.safe_slof_fp(F.array_max("intensity"))
    rows = spectra.select(_key(), fp.alias("fp"), F.posexplode("intensity").alias("pos", "x"))
    return rows.select("key", "pos", "fp", F.round(Q.slof_round_trip(F.col("x"), F.col("fp")) / F.col("x"), 6).alias("ratio"))


def quantize_slof_fp(spark, d):
    return _slof(spark, d, 1.0)


def quantize_slof_clamped(spark, d):
    return _slof(spark, d, 1e5)


def quantize_pic(spark, d):
    return line_peaks(spark, d).select(F.col("l_orderkey").alias("key"), *ORDER, Q.pic_round_trip(F.col("mz")).alias("whole"))


def _round_trip(spark, d, **options):
    """Through real tokens and back."""
    decoded = tokens.decode(_stored(tokens.encode(line_spectra(spark, d), **options).select("token")))
    zipped = F.arrays_zip(F.col("mz").alias("a"), F.col("intensity").alias("b"), F.col("charge").alias("c"), F.element_at("extra_arrays", "MS:1000517")["values"].alias("x"), F.element_at("extra_arrays", "tax")["values"].alias("t"))
    rows = decoded.select(_key(), F.posexplode(zipped).alias("pos", "p"))
    return _rounded(rows.select("key", "pos", F.col("p.a").alias("mz"), F.col("p.b").alias("intensity"), F.col("p.c").alias("charge"), F.col("p.x").alias("noise"), F.col("p.t").alias("tax")), "mz", "intensity", "noise")


def round_trip_lossy(spark, d):
    return _round_trip(spark, d)


def round_trip_lossless(spark, d):
    return _round_trip(spark, d, lossless=True)


def round_trip_zstd(spark, d):
    return _round_trip(spark, d, lossless=True, array_encodings={"mz": "zstd", "intensity": "byte-shuffled-zstd", "charge": "zstd", "tax": "byte-shuffled-zstd"})


def round_trip_lossy_zstd(spark, d):
    return _round_trip(spark, d, array_encodings={"mz": "numlin-zstd", "intensity": "numslof-zstd", "charge": "numpic-zstd", "MS:1000517": "numslof-zstd"})


def round_trip_embeddings(spark, d):
    rows = _table(spark, d, "embeddings").where("embedding is not null")
    extra = F.create_map(F.lit("embedding"), F.struct(F.lit("float32").alias("dtype"), F.col("embedding").cast("array<double>").alias("values")))
    spectra = rows.select(F.col("vec_id").cast("string").alias("id"), F.size("embedding").alias("default_array_length"), extra.alias("extra_arrays"))
    back = tokens.decode(_stored(tokens.encode(spectra).select("token")))
    return back.select(F.col("id").cast("bigint").alias("key"), F.posexplode(F.element_at("extra_arrays", "embedding")["values"]).alias("pos", "x")).select("key", "pos", F.round("x", 6).alias("x"))


def _plan(spark, d, spectra=None, **options):
    spectra = line_spectra(spark, d) if spectra is None else spectra
    return plan_table(spectra, **options).select(_key(), "pos", "array_key", "array", "type", "comp", "fp")


def encoding_plan_default(spark, d):
    return _plan(spark, d)


def encoding_plan_lossless(spark, d):
    return _plan(spark, d, lossless=True)


def encoding_plan_override(spark, d):
    return _plan(spark, d, overrides={"MS:1000514": {"codec": "numlin-zstd", "fixed_point": 5000}, "intensity": "numlin-zlib", "tax": "zstd"})


def negative_fallback(spark, d):
    return _plan(spark, d, line_spectra(spark, d, intensity=F.col("intensity") - 5000))


def spectrum_summary(spark, d):
    return _rounded(analytics.summary(line_spectra(spark, d)).withColumn("key", F.col("id").cast("bigint")).drop("id"), "tic")


def precision_stats(spark, d):
    spectra = line_spectra(spark, d)
    back = F.transform("mz", lambda x: Q.linear_round_trip(x, 100))
    return _rounded(spectra.select(_key(), analytics.precision(F.col("mz"), back).alias("p")).select("key", "p.*"), "max_abs", "mean_abs", "max_ppm", "mean_ppm", "max_percent", "mean_percent")


def linear_residual(spark, d):
    rows = line_peaks(spark, d).withColumn("key", F.col("l_orderkey"))
    return analytics.linear_residuals(rows, "key", ["mz", *ORDER]).select("key", *ORDER, "code", "residual")


def residual_restore(spark, d):
    rows = analytics.linear_residuals(line_peaks(spark, d).withColumn("key", F.col("l_orderkey")), "key", ["mz", *ORDER])
    return analytics.codes_from_residuals(rows, "key", ["mz", *ORDER]).select("key", *ORDER, F.col("restored").alias("code"))


def _peptides(spark, d):
    letters = F.translate(F.md5(F.col("p_partkey").cast("string")), "0123456789abcdef", "GASPVTCLNDQKEMHF")
    return _table(spark, d, "part").select(F.col("p_partkey").alias("key"), F.substring(letters, 1, 12).alias("sequence"))


def ladder_prefix_sum(spark, d):
    return _rounded(analytics.ladders(_peptides(spark, d), "key"), "mz")


def peptide_mass(spark, d):
    mass = analytics.peptide_mass(F.col("sequence"))
    return _rounded(_peptides(spark, d).select("key", mass.alias("mass"), analytics.precursor_mz(mass, 2).alias("precursor_mz")), "mass", "precursor_mz")


def isotope_envelope(spark, d):
    envelope = analytics.isotope_envelope(F.col("mz"), F.col("intensity"), F.lit(2), 3)
    rows = line_peaks(spark, d).select(F.col("l_orderkey").alias("key"), *ORDER, F.posexplode(envelope).alias("pos", "e"))
    return _rounded(rows.select("key", *ORDER, "pos", "e.mz", "e.intensity"), "mz", "intensity")


def _cv(accession: str | Column, value: Column, unit: str | None = None) -> Column:
    return _cv_of(accession, params.typed_value(value), unit)


def _cv_of(accession: str | Column, value: Column, unit: str | None = None) -> Column:
    accession = F.lit(accession) if isinstance(accession, str) else accession
    return F.struct(accession.alias("accession"), value.alias("value"), F.lit(unit).cast("string").alias("unit_accession"))


def _typed(rows: DataFrame, **texts: Column) -> DataFrame:
    """rows with a tagged value of each text, made in steps: one expression of all of it works the same numbers out
    many times, and its code becomes a method too long for the JVM to compile."""
    numbers = F.transform(F.array(*texts.values()), lambda t: F.struct(t.alias("text"), params.number_in(t).alias("number")))
    kinds = F.transform(numbers, lambda x: F.struct(x["text"], x["number"], params.kind_of(x["text"], x["number"]).alias("kind")))
    rows = rows.withColumn("_typed", F.transform(kinds, lambda x: params.tagged(x["text"], x["number"], x["kind"])))
    return rows.withColumns({n: F.get("_typed", F.lit(i)) for i, n in enumerate(texts)}).drop("_typed")


def _user(name: str, value: Column, unit: str | None = None) -> Column:
    return F.struct(F.lit(name).alias("name"), value.alias("value"), F.lit("xsd:string").alias("type"), F.lit(unit).cast("string").alias("unit_accession"))


def meta_spectra(spark, d):
    """Orders as spectra of one peak with every kind of metadata; parts that some of them lack depend on the customer."""
    text = lambda c: F.col(c).cast("string")
    some = lambda k, c: F.when(F.col("o_custkey") % k == 0, F.array(c)).otherwise(F.array())
    window = lambda *p: F.struct(F.array(*p).alias("params"))
    used = ("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus", "o_orderpriority")
    rows = _typed(_spread(_table(spark, d, "orders").select(*used)), price=text("o_totalprice"), customer=text("o_custkey"), status=F.col("o_orderstatus"), level=F.substring("o_orderpriority", 1, 1), flag=F.lit(""))
    price, customer, status, flag = map(F.col, ("price", "customer", "status", "flag"))
    scan = F.struct(F.array(_cv_of("MS:1000016", price, "UO:0000031")).alias("params"), F.array(window(_cv_of("MS:1000501", customer))).alias("windows"), some(5, _user("status", status)).alias("user_params"))
    precursor = F.struct(window(_cv_of("MS:1000827", price, "MS:1000040")).alias("isolation_window"), F.array(window(_cv_of("MS:1000744", price))).alias("selected_ions"), window(_cv_of("MS:1000133", flag)).alias("activation"))
    made = {
        "id": text("o_orderkey"), "mz": F.array(F.col("o_totalprice")), "intensity": F.array(F.lit(1.0)), "array_units": F.create_map(F.lit("mz"), F.lit("MS:1000040")),
        "params": F.array(_cv_of("MS:1000511", F.col("level")), _cv_of("MS:1000127", flag), _cv_of("NCIT:C25330", status)),
        "scans": F.array(scan), "scan_combination": _cv_of("MS:1000795", flag), "precursors": some(2, precursor),
        "products": some(3, F.struct(window(_cv_of("MS:1000828", customer)).alias("isolation_window"))), "interp": F.concat("o_orderpriority", F.lit("/2")), "user_params": F.array(_user("customer", customer, "UO:0000010")),
    }
    return peaks.complete(rows.select(*(c.alias(n) for n, c in made.items())))


def metadata_round_trip(spark, d):
    """All metadata through real tokens and back, a row for each value."""
    back = tokens.decode(_stored(tokens.encode(meta_spectra(spark, d)).select("token")))
    row = lambda part, name, v, unit: F.struct(F.lit(part).alias("part"), name.alias("name"), F.round(params.number_of(v), 4).alias("number"), v["s"].alias("text"), unit.alias("unit"))
    of = lambda part, ps: F.transform(ps, lambda p: row(part, p["accession"], p["value"], p["unit_accession"]))
    users = lambda part, us: F.transform(us, lambda u: row(part, u["name"], u["value"], u["unit_accession"]))
    each = lambda c, f: F.flatten(F.transform(c, f))
    plain = lambda part, name, text: F.array(row(part, F.lit(name), F.struct(F.lit("str").alias("kind"), F.lit(None).cast("bigint").alias("i"), F.lit(None).cast("double").alias("d"), text.alias("s")), F.lit(None).cast("string")))
    rows = F.concat(
        of("spectrum", F.col("params")), each("scans", lambda s: of("scan", s["params"])), each("scans", lambda s: each(s["windows"], lambda w: of("window", w["params"]))), each("scans", lambda s: users("scan user", s["user_params"])),
        each("precursors", lambda p: of("isolation", p["isolation_window"]["params"])), each("precursors", lambda p: each(p["selected_ions"], lambda i: of("ion", i["params"]))), each("precursors", lambda p: of("activation", p["activation"]["params"])),
        each("products", lambda p: of("product", p["isolation_window"]["params"])), users("user", F.col("user_params")),
        plain("combination", "accession", F.col("scan_combination.accession")), plain("interpretation", "interp", F.col("interp")), plain("array", "unit", F.element_at("array_units", "mz")),
    )
    return back.select(_key(), F.explode(rows).alias("r")).select("key", "r.*")


def _texts(spark, d, most):
    """Orders as spectra of an id and a long interpretation, without arrays."""
    rows = _spread(_table(spark, d, "orders").select("o_orderkey")).select(F.col("o_orderkey").cast("string").alias("id"), F.repeat(F.lit("A"), (F.col("o_orderkey") % most).cast("int")).alias("interp"))
    return peaks.complete(rows)


def long_tokens(spark, d):
    """Tokens up to a length, and those that URLs bear badly."""
    out = tokens.encode(_texts(spark, d, 9_000), max_len=10_000, mode="PERMISSIVE")
    return out.select(_key(), F.length("token").alias("n"), "long", "error")


def codec_registry(spark, d):
    rows = _table(spark, d, "lineitem").select(F.element_at(F.array(*map(F.lit, R.CODECS)), (F.col("l_partkey") % len(R.CODECS) + 1).cast("int")).alias("name"))
    return rows.join(R.codecs(spark), "name").groupBy("name", "compression", "lossy", "transform").agg(F.count("*").alias("n"))


def array_registry(spark, d):
    """Arrays by name and transform, with a unit for each."""
    pick = lambda c, names: F.element_at(F.array(*map(F.lit, sorted(names))), (F.col(c) % len(names) + 1).cast("int"))
    rows = _table(spark, d, "lineitem").select(pick("l_partkey", R.ARRAY_NAMES).alias("accession"), pick("l_suppkey", R.UNIT_NAMES).alias("u"))
    units = R.units(spark).select(F.col("accession").alias("u"), F.col("name").alias("unit"))
    return rows.join(R.arrays(spark), "accession").join(units, "u").groupBy("accession", "name", "transform", "unit").agg(F.count("*").alias("n"))


def header_dump(spark, d):
    empty = F.array().cast("array<double>")
    spectra = _texts(spark, d, 300).withColumn("mz", empty)
    encoded = tokens.encode(spectra, lossless=True).select("id", "token")
    out = tokens.dump(_stored(encoded), "id")
    fine = validation.interpretation_parses(F.get_json_object("header", "$.interp"))
    return out.select(_key(), "document_bytes", "header", F.coalesce(fine, F.lit(False)).alias("parses"))


def validate_keys(spark, d):
    """Faults of the keys of extra arrays and of units."""
    names = F.array(*map(F.lit, ("MS:1000514", "MS:1000786", "charge", "NCIT:C25330", "MS:1003008", "own")))
    units = F.array(*map(F.lit, ("mz", "nothing", "MS:1000515")))
    one = F.struct(F.lit("float64").alias("dtype"), F.array(F.lit(1.0)).alias("values"))
    k = F.col("o_orderkey")
    rows = _table(spark, d, "orders").select(
        k.cast("string").alias("id"), F.array(F.lit(1.0)).alias("mz"), F.array(F.lit(1.0)).alias("intensity"), F.create_map(F.element_at(names, (k % 6 + 1).cast("int")), one).alias("extra_arrays"),
        F.create_map(F.element_at(units, (k % 3 + 1).cast("int")), F.when(k % 5 == 0, "second").otherwise("UO:0000010")).alias("array_units"),
    )
    return validation.validate(peaks.complete(rows)).select(_key(), F.posexplode("errors").alias("pos", "error"))


def malformed_documents(spark, d):
    """Documents with one array of two values: declared longer or shorter, under another fixed point, cut, or with bytes behind it."""
    from mzframe.kernels import arrays, cbor

    def document(n: int, data: bytes, comp: int = R.LINEAR_ZLIB, fp: int | None = 100) -> str:
        entry = {R.DESC_TYPE: R.FLOAT64, R.DESC_ARRAY: R.ARRAY_MZ, R.DESC_COMP: comp, R.DESC_DATA: data} | ({R.DESC_FP: fp} if fp else {})
        return cbor.dumps({0: n, 6: [entry]}).hex()

    two, many = (arrays.encode([1.0] * n, R.LINEAR_ZLIB, R.FLOAT64, 100) for n in (2, 5_000))
    plain = arrays.encode([1.0] * 5_000, R.ZLIB, R.FLOAT64, None)
    cases = [document(2, two), document(3, two), document(1, two), document(2, two, fp=101), document(2, two[:-3]), document(2, many), document(2, plain, R.ZLIB, None), document(2, two) + "00", document(2, two)[:-2]]
    k = F.col("o_orderkey")
    made = F.element_at(F.array(*map(F.lit, cases)), (k % len(cases) + 1).cast("int"))
    rows = _spread(_table(spark, d, "orders").select("o_orderkey")).select(k.alias("key"), T.to_token(F.unhex(made)).alias("token"))
    return tokens.decode(rows, mode="PERMISSIVE").select("key", "error", F.array_join("mz", " ").alias("mz"))


def token_sql(spark, d):
    """The registered SQL functions: peaks of tokens by a table function, their headers by a scalar one."""
    tokens.register_functions(spark)
    stored = _stored(tokens.encode(line_spectra(spark, d), lossless=True).select("id", "token"))
    return spark.sql("SELECT CAST(t.id AS BIGINT) AS key, p.pos, ROUND(p.mz, 6) AS mz, ROUND(p.intensity, 6) AS intensity, p.charge FROM {t} t, LATERAL explode_token(t.token) p", t=stored)


def stream_error_counts(spark, d):
    """Good and bad tokens by window of event time: a stream over files of tokens, whose state is kept by window."""
    source, sink, state = _scratch(spark), _scratch(spark), _scratch(spark)
    orders = _table(spark, d, "orders")
    made = tokens.encode(_texts(spark, d, 10)).select("id", "token").join(orders.select(F.col("o_orderkey").cast("string").alias("id"), "o_orderdate", "o_custkey"), "id")
    bad = F.when(F.col("o_custkey") % 5 == 0, F.concat(F.lit("x"), "token")).otherwise(F.col("token"))
    made.select(bad.alias("token"), F.col("o_orderdate").cast("timestamp").alias("at")).write.parquet(source)
    stream = spark.readStream.schema("token string, at timestamp").parquet(source)
    counts = error_counts(tokens.decode(stream, mode="PERMISSIVE").select("at", "error"), "at", "30 days", "1 day")
    query = counts.writeStream.outputMode("complete").option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(lambda rows, _: rows.write.mode("overwrite").parquet(sink)).start()
    query.awaitTermination()
    rows = spark.read.schema("window struct<start: timestamp, end: timestamp>, tokens bigint, bad bigint").parquet(sink)
    return rows.select(F.unix_timestamp("window.start").alias("start"), "tokens", "bad")


def _owners(spark, d):
    own = F.array(_cv("MS:1000016", F.col("o_totalprice").cast("string"), "UO:0000031"))
    return _table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), F.array("o_orderpriority", "o_orderstatus").alias("refs"), own.cast(f"array<{S.CV}>").alias("params"))


def _groups(spark, d):
    rows = _table(spark, d, "orders").where("o_orderpriority < '5'").select(F.col("o_orderpriority").alias("ref")).distinct()
    return rows.select("ref", F.array(_cv("MS:1000511", F.substring("ref", 1, 1)), _cv("MS:1000130", F.lit(""))).cast(f"array<{S.CV}>").alias("params"))


def refgroup_expand(spark, d):
    out = params.expand_refs(_owners(spark, d), _groups(spark, d))
    rows = out.select("key", F.posexplode("params").alias("pos", "p"))
    return rows.select("key", "pos", "p.accession", F.round(params.number_of(F.col("p.value")), 4).alias("value"))


def refgroup_unresolved(spark, d):
    return params.unresolved_refs(_owners(spark, d), _groups(spark, d))


def cv_label_join(spark, d):
    rows = _table(spark, d, "lineitem").select(F.concat(F.lit("MS:"), F.format_string("%07d", F.lit(1000500) + F.col("l_linenumber") * 5 + F.col("l_suppkey") % 30)).alias("accession"))
    return params.with_labels(rows).groupBy("accession", "label").agg(F.count("*").alias("n"))


def first_params(spark, d):
    own = F.array(_cv("MS:1000511", F.substring("o_orderpriority", 1, 1)), _cv("MS:1000016", F.col("o_totalprice").cast("string"), "UO:0000031"), _cv("MS:1000511", F.lit("9")))
    own = F.concat(own, F.when(F.col("o_custkey") % 2 == 0, F.array(_cv("MS:1000744", F.col("o_custkey").cast("string")))).otherwise(F.array().cast(f"array<{S.CV}>")))
    rows = _table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), own.cast(f"array<{S.CV}>").alias("params"))
    start = params.first_param(F.col("params"), "MS:1000016")
    ion = params.number_of(params.first_param(F.col("params"), "MS:1000744")["value"])
    return rows.select("key", params.ms_level(F.col("params")).alias("ms_level"), start["unit_accession"].alias("unit"), F.round(params.number_of(start["value"]), 4).alias("start"), ion.alias("ion"))


def find_params(spark, d):
    """The first value in lists of scans and of windows below them."""
    rows = meta_spectra(spark, d)
    start = params.find_param(F.col("scans"), "MS:1000016", "params")
    limit = params.find_param(F.flatten(F.transform("scans", lambda s: s["windows"])), "MS:1000501", "params")
    ion = params.find_param(F.flatten(F.transform("precursors", lambda p: p["selected_ions"])), "MS:1000744", "params")
    return rows.select(_key(), *(F.round(params.number_of(c["value"]), 4).alias(n) for n, c in (("start", start), ("low", limit), ("ion", ion))))


def size_texts(spark, d):
    size = F.octet_length("html").cast("bigint") * F.element_at(F.array(F.lit(1), F.lit(300)), (F.col("page_id") % 2 + 1).cast("int"))
    return _table(spark, d, "pages").select("page_id", analytics.format_bytes(size).alias("size"))


def mode_sizes(spark, d):
    """Of spectra without arrays, whose tokens have a known length in both modes."""
    sizes = tokens.mode_sizes(_texts(spark, d, 9_000))
    return sizes.select(_key(), "lossy", "lossless", "percent")


def duplicate_params(spark, d):
    accession = F.concat(F.lit("MS:"), F.format_string("%07d", F.lit(1000000) + F.col("l_suppkey") % 7))
    rows = _table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("key")).agg(F.collect_list(F.struct(accession.alias("accession"))).alias("params"))
    return rows.select("key", F.explode(params.duplicate_accessions(F.col("params"))).alias("accession"))


def canonical_params(spark, d):
    kinds = [F.lit("NCIT:C25330"), F.concat(F.lit("MS:"), F.format_string("%07d", F.col("o_custkey") + 1000000)), F.lit("MOD:00046"), F.lit("MS:1000511"), F.lit("UO:0000031")]
    rows = _table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), F.array(*(F.struct(k.alias("accession")) for k in kinds)).alias("params"))
    return rows.select("key", F.posexplode(params.canonical_order(F.col("params"))).alias("pos", "p")).select("key", "pos", "p.accession")


def typed_values(spark, d):
    text = F.when(F.col("o_orderkey") % 4 == 0, F.col("o_totalprice").cast("string")).when(F.col("o_orderkey") % 4 == 1, F.col("o_custkey").cast("string")).when(F.col("o_orderkey") % 4 == 2, F.col("o_orderpriority")).otherwise("")
    v = params.typed_value(text)
    return _table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), v["kind"].alias("kind"), F.round(params.number_of(v), 4).alias("number"), v["s"].alias("text"))


def flatten_params(spark, d):
    scan = F.array(F.struct(F.array(_cv("MS:1000016", F.col("o_totalprice").cast("string"), "UO:0000031")).alias("params"), F.array(F.struct(F.array(_cv("MS:1000501", F.col("o_custkey").cast("string"))).alias("params"))).alias("windows"), F.array().cast(f"array<{S.USER}>").alias("user_params")))
    rows = _table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("id"), F.array(_cv("MS:1000511", F.lit("2")), _cv("MS:1000127", F.lit(""))).alias("params"), scan.alias("scans"))
    out = params.flatten_params(peaks.complete(rows)).withColumn("key", F.col("id").cast("bigint"))
    return out.select("key", "part", "accession", "label", F.when(F.col("accession") != "MS:1000016", F.col("value")).alias("value"), "unit_accession")


def validate_spectra(spark, d):
    k = F.col("id").cast("bigint")
    spectra = line_spectra(spark, d)
    spectra = spectra.withColumns({
        "default_array_length": F.when(k % 5 == 0, F.col("default_array_length") + 1).otherwise(F.col("default_array_length")),
        "mz": F.when(k % 7 == 0, F.transform("mz", lambda x: -x)).otherwise(F.col("mz")),
        "charge": F.when(k % 11 == 0, F.transform("charge", lambda _: F.lit(float("nan")))).otherwise(F.col("charge")),
    })
    return validation.validate(spectra).select(F.explode("errors").alias("error")).groupBy("error").agg(F.count("*").alias("n"))


def accession_encode(spark, d):
    a = F.concat(F.element_at(F.array(F.lit("MS"), F.lit("UO"), F.lit("NCIT")), (F.col("p_partkey") % 3 + 1).cast("int")), F.lit(":"), F.when(F.col("p_partkey") % 4 == 0, F.col("p_partkey").cast("string")).otherwise(F.format_string("%07d", "p_partkey")))
    rows = _table(spark, d, "part").select(F.col("p_partkey").alias("key"), a.alias("accession"))
    c = F.col("accession")
    return rows.select("key", "accession", A.ontology(c).alias("ontology"), A.tail(c).alias("tail"), A.wire_key(c).alias("wire_key"), A.is_accession(c).alias("valid"))


def unit_encode(spark, d):
    rows = accession_encode(spark, d).select("key", F.col("accession").alias("unit"), A.wire_unit(F.col("accession")).alias("wire"))
    return rows.withColumn("back", A.unit_from_wire(F.col("wire")))


def _link_token() -> Column:
    return F.concat(F.lit(f"{U.MAGIC}."), F.md5("url"), F.lit(".00000000"))


def to_fragment(spark, d):
    return _table(spark, d, "pages").select("page_id", U.to_fragment(_link_token(), F.regexp_replace("url", "#.*$", "##")).alias("link"))


def to_query(spark, d):
    return _table(spark, d, "pages").select("page_id", U.to_query(_link_token(), F.col("url"), "page").alias("link"))


def to_data_uri(spark, d):
    return _table(spark, d, "pages").select("page_id", U.to_data_uri(_link_token()).alias("link"))


def extract_token(spark, d):
    base = F.regexp_replace("url", "#.*$", "")
    link = F.when(F.col("page_id") % 4 == 0, U.to_fragment(_link_token(), base)).when(F.col("page_id") % 4 == 1, U.to_query(_link_token(), base)).when(F.col("page_id") % 4 == 2, U.to_data_uri(_link_token())).otherwise(F.col("url"))
    return _table(spark, d, "pages").select("page_id", U.extract_token(link).alias("token"))


def b64url_text(spark, d):
    return _table(spark, d, "documents").select("doc_id", F.md5(T.b64url(F.col("text").cast("binary"))).alias("digest"))


def b64url_back(spark, d):
    back = T.from_b64url(T.b64url(F.col("text").cast("binary")))
    return _table(spark, d, "documents").select("doc_id", F.md5(back).alias("digest"))


def token_checksum(spark, d):
    return _table(spark, d, "documents").select("doc_id", T.checksum(F.col("text")).alias("checksum"))


def inspect_arrays(spark, d):
    out = tokens.inspect(_stored(tokens.encode(line_spectra(spark, d)).select("id", "token")), "id")
    return out.select(_key(), "pos", "array", "name", "type", "compression", "fixed_point")


def breakdown_bytes(spark, d):
    """Of spectra with empty arrays, whose documents have a known size; zlib makes eight bytes of nothing."""
    empty = F.array().cast("array<double>")
    spectra = _texts(spark, d, 300).withColumns({"mz": empty, "intensity": empty})
    return tokens.breakdown(_stored(tokens.encode(spectra, lossless=True).select("id", "token")), "id").select(_key(), "pos", "part", "bytes")


def size_ratio(spark, d):
    """Plain bytes of the arrays, and bytes a peak of texts as long as ten characters and the charges' sum."""
    raw = analytics.raw_bytes(F.col("default_array_length"), F.col("charge").isNotNull(), F.col("extra_arrays"))
    size = F.lit(10) + F.aggregate("charge", F.lit(0.0), lambda s, x: s + x)
    return line_spectra(spark, d).select(_key(), raw.cast("bigint").alias("raw_bytes"), F.round(analytics.bytes_per_peak(size, F.col("default_array_length")), 6).alias("per_peak"))


def malformed_codes(spark, d):
    k = F.col("id").cast("bigint") % 7
    encoded = _stored(tokens.encode(line_spectra(spark, d)).select("id", "token"))
    t = F.col("token")
    bad = (
        F.when(k == 0, F.concat(F.lit("x"), t))
        .when(k == 1, F.substring_index(t, ".", 3))
        .when(k == 2, F.concat(t.substr(F.lit(1), F.length(t) - 1), F.lit("G")))
        .when(k == 3, F.concat(F.substring_index(t, ".", 3), F.lit("A."), F.substring_index(t, ".", -1)))
        .when(k == 4, F.concat(F.lit("é"), t))
        .when(k == 5, T.to_token(F.lit("plain text").cast("binary")))
        .otherwise(t)
    )
    out = tokens.decode(encoded.select("id", bad.alias("token")).withColumnRenamed("id", "key"), mode="PERMISSIVE")
    return out.select(F.col("key").cast("bigint").alias("key"), F.when(F.col("error").isNull(), "fine").when(F.col("error").rlike("trailing|length|truncated|map|type"), "document").otherwise(F.col("error")).alias("fault"))


def tolerance_check(spark, d):
    spectra = line_spectra(spark, d)
    near = validation.within(F.transform("mz", lambda x: Q.linear_round_trip(x, 100)), F.col("mz"), 1e-6, 1e-5)
    return spectra.select(_key(), near.alias("near"))


def json_round_trip(spark, d):
    path = _scratch(spark)
    meta = F.array(_cv("MS:1000511", F.lit("2")), _cv("MS:1000016", F.lit("1.5"), "UO:0000031"), _cv("MS:1000127", F.lit("")))
    json_spectra.write_json(line_spectra(spark, d).withColumn("params", meta.cast(f"array<{S.CV}>")), path)
    back = json_spectra.read_json(spark, path)
    kinds = F.array_join(F.transform("params", lambda p: p["value"]["kind"]), " ")
    return back.select(_key(), "default_array_length", kinds.alias("kinds"), F.round(F.array_max("mz"), 4).alias("high_mz"), F.size(F.element_at("extra_arrays", "tax")["values"]).alias("n_tax"))


def _peak_sums(decoded):
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x)
    return decoded.select(_key(), "default_array_length", F.round(F.array_min("mz"), 6).alias("low"), F.round(F.array_max("intensity"), 6).alias("high"), total("charge").alias("charges"), "error")


def token_files(spark, d):
    path = _scratch(spark)
    token_text.write_tokens(tokens.encode(line_spectra(spark, d), lossless=True), path)
    return _peak_sums(tokens.decode(token_text.read_tokens(spark, path)))


#: Spectra that an mzML file of mzml_scan holds.
MZML_SPECTRA = 10_000


def mzml_scan(spark, d):
    """Writes the spectra as elements of mzML files with Spark's XML sink, and reads these with the mzML source.

    Parameters of the spectrum, the scan, the isolation window and the arrays stand in groups; the groups
    of an order's priority differ in their value."""
    path, groups = _scratch(spark), _scratch(spark)
    text = lambda v: v if isinstance(v, Column) else F.lit(v).cast("string")
    cv = lambda accession, value="", unit=None: F.struct(text(accession).alias("_accession"), text(value).alias("_value"), text(unit).alias("_unitAccession"))
    ref = lambda *names: F.array(*(F.struct(text(n).alias("_ref")) for n in names))
    pack = _little_endian()
    array = lambda c, accession: F.struct(F.array(cv(accession)).alias("cvParam"), ref("doubles").alias("referenceableParamGroupRef"), pack(c).alias("binary"))
    named = F.concat(F.lit("g"), (F.col("id").cast("bigint") % 5).cast("string"))
    elements = line_spectra(spark, d, spread=True).select(
        F.col("id").alias("_id"),
        F.col("default_array_length").alias("_defaultArrayLength"),
        ref(named, "missing").alias("referenceableParamGroupRef"),
        F.array(cv("MS:1000511", "1")).alias("cvParam"),
        F.struct(F.array(cv("MS:1000795")).alias("cvParam"), F.array(F.struct(F.array(cv("MS:1000016", "5.5", "UO:0000031")).alias("cvParam"), ref(named).alias("referenceableParamGroupRef"))).alias("scan")).alias("scanList"),
        F.struct(F.array(F.struct(F.struct(ref(named).alias("referenceableParamGroupRef")).alias("isolationWindow"))).alias("precursor")).alias("precursorList"),
        F.struct(F.array(array(F.col("mz"), "MS:1000514"), array(F.col("intensity"), "MS:1000515")).alias("binaryDataArray")).alias("binaryDataArrayList"),
    )
    # one task reads a file, so that few large ones would leave cores idle
    elements.write.format("xml").options(rootTag="mzML", rowTag="spectrum", indent="", maxRecordsPerFile=MZML_SPECTRA).save(path)
    orders = _table(spark, d, "orders").select((F.col("o_orderkey") % 5).alias("n")).distinct()
    some = orders.select(F.concat(F.lit("g"), F.col("n").cast("string")).alias("_id"), F.array(cv("MS:1000130", (F.col("n") * 10).cast("string"))).alias("cvParam"))
    doubles = orders.where("n = 0").select(F.lit("doubles").alias("_id"), F.array(cv("MS:1000523"), cv("MS:1000576")).alias("cvParam"))
    some.union(doubles).write.format("xml").options(rootTag="mzML", rowTag="referenceableParamGroup").save(groups)
    back = mzml.read_mzml(spark, path, groups=mzml.read_param_groups(spark, groups).drop("file"))
    value = lambda ps, accession: params.number_of(params.first_param(ps, accession)["value"])
    scan, window = F.try_element_at("scans", F.lit(1))["params"], F.try_element_at("precursors", F.lit(1))["isolation_window"]["params"]
    found = {"own": value(F.col("params"), "MS:1000130"), "of_scan": value(scan, "MS:1000130"), "of_window": value(window, "MS:1000130"), "start": value(scan, "MS:1000016"), "unit": params.first_param(scan, "MS:1000016")["unit_accession"]}
    return back.select(_key(), "default_array_length", *(c.alias(n) for n, c in found.items()), F.round(F.array_max("mz"), 4).alias("high_mz"), F.round(F.array_min("intensity"), 4).alias("low_intensity"))


def _little_endian():
    """The bytes of doubles in base64, read from an Arrow batch's flat buffer."""

    @F.arrow_udf("string")
    def pack(column: pa.Array) -> pa.Array:
        offsets = column.offsets.to_numpy().astype("int64")
        flat = column.values.to_numpy().astype("<f8").tobytes()
        return pa.array([base64.b64encode(flat[8 * a : 8 * b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], pa.string())

    return pack


def stream_decode(spark, d):
    """Tokens as files, decoded by a stream that ends when it has read them all, into a table of files."""
    source, sink, state = _scratch(spark), _scratch(spark), _scratch(spark)
    token_text.write_tokens(tokens.encode(line_spectra(spark, d), lossless=True), source)
    rows = _peak_sums(decoded_stream(spark, source))
    query = rows.writeStream.format("parquet").option("path", sink).option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(rows.schema).parquet(sink)


QUERIES = {f.__name__: f for f in (
    top_n_3, canonical_sort, canonical_sort_ties, top_n_ties, top_n_0, top_n_all, top_n_peak_table, drop_user_params, mobility_view,
    quantize_linear, quantize_slof_fp, quantize_slof_clamped, quantize_pic, round_trip_lossy, round_trip_lossless, round_trip_zstd,
    round_trip_lossy_zstd, round_trip_embeddings, encoding_plan_default, encoding_plan_lossless, encoding_plan_override, negative_fallback,
    spectrum_summary, precision_stats, linear_residual, residual_restore, ladder_prefix_sum, peptide_mass, isotope_envelope,
    refgroup_expand, refgroup_unresolved, cv_label_join, first_params, size_texts, mode_sizes, duplicate_params, canonical_params, typed_values, flatten_params,
    validate_spectra, accession_encode, unit_encode, to_fragment, to_query, to_data_uri, extract_token, b64url_text, b64url_back,
    token_checksum, inspect_arrays, breakdown_bytes, size_ratio, malformed_codes, tolerance_check, json_round_trip, token_files,
    mzml_scan, stream_decode, metadata_round_trip, find_params, long_tokens, codec_registry, validate_keys, malformed_documents, token_sql,
    stream_error_counts, array_registry, header_dump,
)}

_P = """WITH p AS (
  SELECT l_orderkey AS key, l_linenumber, l_partkey, l_suppkey, {mz} AS mz, {intensity} AS intensity, l_linenumber::DOUBLE AS charge, l_discount AS noise, l_tax AS tax,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, {mz}, {intensity}, l_discount, l_tax) - 1 AS i
  FROM lineitem
), s AS (SELECT *, (row_number() OVER (PARTITION BY key ORDER BY mz, i) - 1)::INTEGER AS pos, count(*) OVER (PARTITION BY key) AS n FROM p)
"""


def _sql(select: str, mz: str = "l_extendedprice / 100", intensity: str = "l_quantity * 1000") -> str:
    return _P.format(mz=mz, intensity=intensity) + select


def _top(n: int) -> str:
    return f"""SELECT key, (row_number() OVER (PARTITION BY key ORDER BY CASE WHEN n > {n} THEN mz ELSE 0 END, i) - 1)::INTEGER AS pos, mz, intensity, charge
FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY intensity DESC, mz, i) AS rank FROM s) WHERE rank <= {n}"""


_SLOF = """SELECT key, i::INTEGER AS pos, fp, round((exp(floor(ln(intensity + 1) * fp + 0.5) / fp) - 1) / intensity, 6) AS ratio FROM (
  SELECT *, floor(least(3600, 65535 / (ln(greatest(max(intensity) OVER (PARTITION BY key), 1) + 1) + 1e-9)))::BIGINT AS fp FROM s)"""
_FP = "floor(least(3600, 65535 / (ln(greatest(max({x}), 1) + 1) + 1e-9)))::BIGINT"
_LOSSY = f"""SELECT s.key, pos, round(floor(mz * 100000 + 0.5) / 100000, 6) AS mz, round(exp(floor(ln(intensity + 1) * fp + 0.5) / fp) - 1, 6) AS intensity, charge,
  round(exp(floor(ln(noise + 1) * xp + 0.5) / xp) - 1, 6) AS noise, tax
FROM s JOIN (SELECT key, {_FP.format(x='intensity')} AS fp, {_FP.format(x='noise')} AS xp FROM s GROUP BY key) f ON s.key = f.key"""
_LOSSLESS = "SELECT key, pos, round(mz, 6) AS mz, round(intensity, 6) AS intensity, charge, round(noise, 6) AS noise, tax FROM s"


def _plan_sql(mz: str, intensity: str, charge: str, noise: str, tax: str) -> str:
    """An entry for each array, over a spectrum's rows."""
    return " UNION ALL ".join(f"SELECT key, {i} AS pos, {x} FROM s GROUP BY key" for i, x in enumerate((mz, intensity, charge, noise, tax)))


def _e(key: str, array: int, comp: int | str, fp: str = "NULL") -> str:
    return f"'{key}' AS array_key, {array} AS \"array\", 1000523 AS type, ({comp})::INTEGER AS comp, ({fp})::BIGINT AS fp"


_TAX = _e("tax", 1000786, 1000574)
_DEFAULT_PLAN = _plan_sql(_e("mz", 1000514, 1002746, "100000"), _e("intensity", 1000515, 1002748, _FP.format(x="intensity")), _e("charge", 1000516, 1002747), _e("MS:1000517", 1000517, 1002748, _FP.format(x="noise")), _TAX)
_NEGATIVE = "CASE WHEN min(intensity) < 0 THEN {a} ELSE {b} END"
_MASSES = "map {" + ", ".join(f"'{k}': {v}::DOUBLE" for k, v in analytics.RESIDUES.items()) + "}"
_PEPTIDES = "SELECT p_partkey AS key, substr(translate(md5(p_partkey::VARCHAR), '0123456789abcdef', 'GASPVTCLNDQKEMHF'), 1, 12) AS sequence FROM part"
_TOKEN_SQL = f"'{U.MAGIC}.' || md5(url) || '.00000000'"
_LABEL_CASE = "CASE accession " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in R.LABELS.items()) + " ELSE accession END"
_ACCESSION_SQL = "(CASE p_partkey % 3 WHEN 0 THEN 'MS' WHEN 1 THEN 'UO' ELSE 'NCIT' END) || ':' || (CASE WHEN p_partkey % 4 = 0 THEN p_partkey::VARCHAR ELSE lpad(p_partkey::VARCHAR, 7, '0') END)"
_B64 = "rtrim(translate(base64(encode(text)), '+/', '-_'), '=')"
_PAIRS = """list_filter(string_split(regexp_extract(regexp_replace(url, '#.*$', ''), '\\?(.*)$', 1), '&'), lambda p: p <> '' AND split_part(p, '=', 1) <> 'page')"""

_PEAK_SUMS = _sql("SELECT key, count(*)::INTEGER AS default_array_length, round(min(mz), 6) AS low, round(max(intensity), 6) AS high, sum(charge) AS charges, NULL::VARCHAR AS error FROM s GROUP BY key")


def _documents(most: int) -> str:
    """(key, bytes): the documents of an id and an interpretation in CBOR: a map's head, then its keys 0, 1, 6 and 7 with their values, each text headed by one to three bytes."""
    head = "CASE WHEN {n} < 24 THEN 1 WHEN {n} < 256 THEN 2 ELSE 3 END"
    size, text = "length(o_orderkey::VARCHAR)", f"o_orderkey % {most}"
    return f"SELECT o_orderkey AS key, 1 + 2 + (1 + {head.format(n=size)} + {size}) + 2 + (1 + {head.format(n=text)} + {text}) AS bytes FROM orders"


#: A token is the identifier, the payload in base64 without padding and eight digits, with points between.
_TOKEN_LENGTH = f"({len(U.MAGIC)} + 1 + (bytes * 4 + 2) // 3 + 1 + 8)::INTEGER"
ORACLE_SQL = {
    "canonical_sort": _sql("SELECT key, pos, mz, intensity, charge FROM s"),
    "canonical_sort_ties": _sql("SELECT key, pos, mz, intensity, charge FROM s", mz="floor(l_partkey % 3)::DOUBLE"),
    "top_n_3": _sql(_top(3)),
    "top_n_ties": _sql(_top(2), intensity="floor(l_quantity * 1000 / 20000)"),
    "top_n_0": "SELECT l_orderkey AS key, count(*)::INTEGER AS n_before, 0 AS default_array_length, 0 AS \"left\" FROM lineitem GROUP BY l_orderkey",
    "top_n_all": _sql("SELECT key, i::INTEGER AS pos, mz, intensity, charge FROM s"),
    "top_n_peak_table": _sql("SELECT key, rank, mz, intensity FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY intensity DESC, mz, i)::INTEGER AS rank FROM s) WHERE rank <= 2"),
    "drop_user_params": "SELECT o_orderkey AS key, CASE WHEN o_custkey % 5 = 0 THEN 2 ELSE 1 END AS n_before, 0 AS n_user, 3 AS n_params FROM orders",
    "mobility_view": _sql("SELECT key, 'MS:1003008' AS name, i::INTEGER AS pos, tax AS value FROM s"),
    "quantize_linear": _sql("SELECT key, l_linenumber, l_partkey, l_suppkey, round(floor(mz * 100000 + 0.5) / 100000, 6) AS mz FROM s"),
    "quantize_slof_fp": _sql(_SLOF),
    "quantize_slof_clamped": _sql(_SLOF, intensity="l_quantity * 1000 * 1e5"),
    "quantize_pic": _sql("SELECT key, l_linenumber, l_partkey, l_suppkey, floor(mz + 0.5) AS whole FROM s"),
    "round_trip_lossy": _sql(_LOSSY),
    "round_trip_lossy_zstd": _sql(_LOSSY),
    "round_trip_lossless": _sql(_LOSSLESS),
    "round_trip_zstd": _sql(_LOSSLESS),
    "round_trip_embeddings": "SELECT vec_id AS key, unnest(range(len(embedding)))::INTEGER AS pos, round(unnest(embedding)::DOUBLE, 6) AS x FROM embeddings WHERE embedding IS NOT NULL",
    "encoding_plan_default": _sql(_DEFAULT_PLAN),
    "encoding_plan_lossless": _sql(_plan_sql(*(_e(k, a, 1000574) for k, a in (("mz", 1000514), ("intensity", 1000515), ("charge", 1000516), ("MS:1000517", 1000517), ("tax", 1000786))))),
    "encoding_plan_override": _sql(_plan_sql(_e("mz", 1000514, 1003783, "5000"), _e("intensity", 1000515, 1002746, "100000"), _e("charge", 1000516, 1002747), _e("MS:1000517", 1000517, 1002748, _FP.format(x="noise")), _e("tax", 1000786, 1003780))),
    "negative_fallback": _sql(_plan_sql(_e("mz", 1000514, 1002746, "100000"), _e("intensity", 1000515, _NEGATIVE.format(a=1000574, b=1002748), _NEGATIVE.format(a="NULL", b=_FP.format(x="intensity"))), _e("charge", 1000516, 1002747), _e("MS:1000517", 1000517, 1002748, _FP.format(x="noise")), _TAX), intensity="l_quantity * 1000 - 5000"),
    "spectrum_summary": _sql("SELECT key, count(*)::INTEGER AS n_peaks, first(mz ORDER BY intensity DESC, i) AS base_mz, max(intensity) AS base_intensity, min(mz) AS low_mz, max(mz) AS high_mz, round(sum(intensity), 6) AS tic FROM s GROUP BY key"),
    "precision_stats": _sql("SELECT key, round(max(a), 6) AS max_abs, round(avg(a), 6) AS mean_abs, round(max(r) * 1e6, 6) AS max_ppm, round(avg(r) * 1e6, 6) AS mean_ppm, round(max(r) * 100, 6) AS max_percent, round(avg(r) * 100, 6) AS mean_percent FROM (SELECT key, abs(mz - floor(mz * 100 + 0.5) / 100) AS a, CASE WHEN mz = 0 THEN 0 ELSE abs(mz - floor(mz * 100 + 0.5) / 100) / mz END AS r FROM s) GROUP BY key"),
    "linear_residual": _sql("SELECT key, l_linenumber, l_partkey, l_suppkey, code, code - (2 * lag(code) OVER w - lag(code, 2) OVER w) AS residual FROM (SELECT *, floor(mz * 100000 + 0.5)::BIGINT AS code FROM s) WINDOW w AS (PARTITION BY key ORDER BY mz, i)"),
    "residual_restore": _sql("SELECT key, l_linenumber, l_partkey, l_suppkey, floor(mz * 100000 + 0.5)::BIGINT AS code FROM s"),
    "ladder_prefix_sum": f"""WITH q AS ({_PEPTIDES}), r AS (SELECT key, i, {_MASSES}[substr(sequence, i::INTEGER, 1)] AS m FROM q, range(1, 13) t(i))
SELECT key, 'b' AS ion, i::INTEGER AS number, round(sum(m) OVER (PARTITION BY key ORDER BY i) + {analytics.PROTON}, 6) AS mz FROM r QUALIFY i < 12
UNION ALL SELECT key, 'y', (13 - i)::INTEGER, round(sum(m) OVER (PARTITION BY key ORDER BY i DESC) + {analytics.WATER} + {analytics.PROTON}, 6) FROM r QUALIFY i > 1""",
    "peptide_mass": f"""WITH q AS ({_PEPTIDES}), m AS (SELECT key, sum({_MASSES}[substr(sequence, i::INTEGER, 1)]) + {analytics.WATER} AS mass FROM q, range(1, 13) t(i) GROUP BY key)
SELECT key, round(mass, 6) AS mass, round((mass + 2 * {analytics.PROTON}) / 2, 6) AS precursor_mz FROM m""",
    "isotope_envelope": _sql(f"SELECT key, l_linenumber, l_partkey, l_suppkey, k::INTEGER AS pos, round(mz + k * ({analytics.ISOTOPE} / 2), 6) AS mz, round(intensity * exp(-0.55 * k), 6) AS intensity FROM s, range(3) t(k)"),
    "refgroup_expand": """SELECT o_orderkey AS key, 0 AS pos, 'MS:1000016' AS accession, round(o_totalprice, 4) AS value FROM orders
UNION ALL SELECT o_orderkey, 1, 'MS:1000511', substr(o_orderpriority, 1, 1)::DOUBLE FROM orders WHERE o_orderpriority < '5'
UNION ALL SELECT o_orderkey, 2, 'MS:1000130', NULL FROM orders WHERE o_orderpriority < '5'""",
    "refgroup_unresolved": "SELECT o_orderkey AS key, o_orderstatus AS ref FROM orders UNION ALL SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority >= '5'",
    "cv_label_join": f"SELECT accession, {_LABEL_CASE} AS label, count(*) AS n FROM (SELECT 'MS:' || lpad((1000500 + l_linenumber * 5 + l_suppkey % 30)::VARCHAR, 7, '0') AS accession FROM lineitem) GROUP BY ALL",
    "first_params": "SELECT o_orderkey AS key, substr(o_orderpriority, 1, 1)::DOUBLE AS ms_level, 'UO:0000031' AS unit, round(o_totalprice, 4) AS start, CASE WHEN o_custkey % 2 = 0 THEN o_custkey::DOUBLE END AS ion FROM orders",
    "find_params": "SELECT o_orderkey AS key, round(o_totalprice, 4) AS start, o_custkey::DOUBLE AS low, CASE WHEN o_custkey % 2 = 0 THEN round(o_totalprice, 4) END AS ion FROM orders",
    "metadata_round_trip": """WITH o AS (SELECT o_orderkey AS key, o_custkey AS c, round(o_totalprice, 4) AS price, o_orderstatus AS status, o_orderpriority AS priority FROM orders)
SELECT key, 'spectrum' AS part, 'MS:1000511' AS name, substr(priority, 1, 1)::DOUBLE AS number, NULL AS text, NULL AS unit FROM o
UNION ALL SELECT key, 'spectrum', 'MS:1000127', NULL, NULL, NULL FROM o UNION ALL SELECT key, 'spectrum', 'NCIT:C25330', NULL, status, NULL FROM o
UNION ALL SELECT key, 'scan', 'MS:1000016', price, NULL, 'UO:0000031' FROM o UNION ALL SELECT key, 'window', 'MS:1000501', c::DOUBLE, NULL, NULL FROM o
UNION ALL SELECT key, 'scan user', 'status', NULL, status, NULL FROM o WHERE c % 5 = 0
UNION ALL SELECT key, 'isolation', 'MS:1000827', price, NULL, 'MS:1000040' FROM o WHERE c % 2 = 0 UNION ALL SELECT key, 'ion', 'MS:1000744', price, NULL, NULL FROM o WHERE c % 2 = 0
UNION ALL SELECT key, 'activation', 'MS:1000133', NULL, NULL, NULL FROM o WHERE c % 2 = 0 UNION ALL SELECT key, 'product', 'MS:1000828', c::DOUBLE, NULL, NULL FROM o WHERE c % 3 = 0
UNION ALL SELECT key, 'user', 'customer', c::DOUBLE, NULL, 'UO:0000010' FROM o UNION ALL SELECT key, 'combination', 'accession', NULL, 'MS:1000795', NULL FROM o
UNION ALL SELECT key, 'interpretation', 'interp', NULL, priority || '/2', NULL FROM o UNION ALL SELECT key, 'array', 'unit', NULL, 'MS:1000040', NULL FROM o""",
    "long_tokens": f"""SELECT key, CASE WHEN n <= 10000 THEN n END AS n, CASE WHEN n <= 10000 THEN n > {R.WARN_LENGTH} END AS long, CASE WHEN n > 10000 THEN 'token is longer than 10000' END AS error
FROM (SELECT key, {_TOKEN_LENGTH} AS n FROM ({_documents(9_000)}))""",
    "codec_registry": """SELECT c.name, c.compression, c.lossy, c.transform, count(*) AS n FROM lineitem JOIN (VALUES (0, 'zlib', 1000574, false, 'raw'), (1, 'zstd', 1003780, false, 'raw'), (2, 'byte-shuffled-zstd', 1003781, false, 'raw'),
  (3, 'numlin-zlib', 1002746, true, 'linear'), (4, 'numlin-zstd', 1003783, true, 'linear'), (5, 'numslof-zlib', 1002748, true, 'slof'), (6, 'numslof-zstd', 1003785, true, 'slof'), (7, 'numpic-zlib', 1002747, true, 'pic'), (8, 'numpic-zstd', 1003784, true, 'pic')) c(i, name, compression, lossy, transform)
ON l_partkey % 9 = c.i GROUP BY ALL""",
    "array_registry": f"""WITH a AS (SELECT unnest([{', '.join(f"'{a}'" for a in sorted(R.ARRAY_NAMES))}]) AS accession, unnest([{', '.join(f"'{R.ARRAY_NAMES[a]}'" for a in sorted(R.ARRAY_NAMES))}]) AS name, unnest(range({len(R.ARRAY_NAMES)})) AS i),
u AS (SELECT unnest([{', '.join(f"'{R.UNIT_NAMES[a]}'" for a in sorted(R.UNIT_NAMES))}]) AS unit, unnest(range({len(R.UNIT_NAMES)})) AS k)
SELECT accession, name, CASE WHEN name LIKE '%mobility%' OR name IN ('m/z', 'time', 'wavelength', 'mass', 'sampled noise m/z') OR name LIKE 'scanning%' THEN 'linear' WHEN name = 'charge' THEN 'pic'
  WHEN name IN ('non-standard data', 'temperature', 'mean charge', 'measured element') THEN 'raw' ELSE 'slof' END AS transform, unit, count(*) AS n
FROM lineitem JOIN a ON l_partkey % {len(R.ARRAY_NAMES)} = i JOIN u ON l_suppkey % {len(R.UNIT_NAMES)} = k GROUP BY ALL""",
    "header_dump": f"""SELECT key, (bytes + 29)::INTEGER AS document_bytes, '{{"default_array_length":0,"id":"' || key::VARCHAR || '","params":[],"scans":[],"precursors":[],"products":[],"interp":"' || repeat('A', (key % 300)::INTEGER) ||
  '","user_params":[],"descriptors":[{{"type":1000523,"array":1000514,"comp":1000574,"compressed_bytes":8}}]}}' AS header, true AS parses FROM ({_documents(300)})""",
    "validate_keys": """WITH o AS (SELECT o_orderkey AS key, CASE o_orderkey % 6 WHEN 0 THEN 'core array accession MS:1000514 has a field of its own' WHEN 1 THEN 'non-standard arrays are keyed by their name' WHEN 2 THEN 'array name charge is reserved'
  WHEN 3 THEN 'array accession NCIT:C25330 is not a seven-digit MS one' END AS a, CASE WHEN o_orderkey % 3 = 1 THEN 'a unit names no array' END AS b, CASE WHEN o_orderkey % 5 = 0 THEN 'a unit is no accession' END AS c FROM orders)
SELECT key, (row_number() OVER (PARTITION BY key ORDER BY i) - 1)::INTEGER AS pos, error FROM (SELECT key, 0 AS i, a AS error FROM o UNION ALL SELECT key, 1, b FROM o UNION ALL SELECT key, 2, c FROM o) WHERE error IS NOT NULL""",
    "malformed_documents": """SELECT o_orderkey AS key, CASE o_orderkey % 9 WHEN 1 THEN 'array has 2 values instead of 3' WHEN 2 THEN 'array has 2 values instead of 1' WHEN 3 THEN 'declared and embedded fixed point differ' WHEN 4 THEN 'compressed data ends early'
  WHEN 5 THEN 'array is larger than its declared length allows' WHEN 6 THEN 'array is larger than its declared length allows' WHEN 7 THEN 'trailing bytes after the document' WHEN 8 THEN 'truncated document' END AS error,
  CASE WHEN o_orderkey % 9 = 0 THEN '1.0 1.0' END AS mz FROM orders""",
    "token_sql": _sql("SELECT key, pos, round(mz, 6) AS mz, round(intensity, 6) AS intensity, charge FROM s"),
    "stream_error_counts": """SELECT (epoch(o_orderdate)::BIGINT // 2592000) * 2592000 AS start, count(*) AS tokens, count(*) FILTER (o_custkey % 5 = 0) AS bad FROM orders GROUP BY 1""",
    "size_texts": """SELECT page_id, CASE WHEN n < 1024 THEN n::VARCHAR || ' B' WHEN n < 1048576 THEN (k // 10)::VARCHAR || '.' || (k % 10)::VARCHAR || ' KB' ELSE (m // 100)::VARCHAR || '.' || lpad((m % 100)::VARCHAR, 2, '0') || ' MB' END AS size
FROM (SELECT *, floor(n * 10 / 1024 + 0.5)::BIGINT AS k, floor(n * 100 / 1048576 + 0.5)::BIGINT AS m FROM (SELECT page_id, strlen(html) * (CASE WHEN page_id % 2 = 0 THEN 1 ELSE 300 END) AS n FROM pages))""",
    "mode_sizes": f"SELECT key, n AS lossy, n AS lossless, 0.0::DOUBLE AS percent FROM (SELECT key, {_TOKEN_LENGTH} AS n FROM ({_documents(9_000)}))",
    "duplicate_params": "SELECT l_orderkey AS key, 'MS:' || (1000000 + l_suppkey % 7)::VARCHAR AS accession FROM lineitem GROUP BY ALL HAVING count(*) > 1",
    "canonical_params": """SELECT key, (row_number() OVER (PARTITION BY key ORDER BY t, n, a) - 1)::INTEGER AS pos, a AS accession FROM (
  SELECT o_orderkey AS key, a, CASE WHEN a LIKE 'MS:%' THEN 0 ELSE 1 END AS t, CASE WHEN a LIKE 'MS:%' THEN substr(a, 4)::BIGINT ELSE strlen(a) END AS n
  FROM (SELECT o_orderkey, unnest(['NCIT:C25330', 'MS:' || (o_custkey + 1000000)::VARCHAR, 'MOD:00046', 'MS:1000511', 'UO:0000031']) AS a FROM orders))""",
    "typed_values": """SELECT o_orderkey AS key, CASE o_orderkey % 4 WHEN 0 THEN CASE WHEN o_totalprice = floor(o_totalprice) THEN 'int' ELSE 'float' END WHEN 1 THEN 'int' WHEN 2 THEN 'str' ELSE 'null' END AS kind,
  CASE o_orderkey % 4 WHEN 0 THEN round(o_totalprice, 4) WHEN 1 THEN o_custkey::DOUBLE END AS number, CASE WHEN o_orderkey % 4 = 2 THEN o_orderpriority END AS text FROM orders""",
    "flatten_params": """SELECT o_orderkey AS key, 'spectrum' AS part, 'MS:1000511' AS accession, 'ms level' AS label, '2' AS value, NULL AS unit_accession FROM orders
UNION ALL SELECT o_orderkey, 'spectrum', 'MS:1000127', 'centroid spectrum', 'flag', NULL FROM orders
UNION ALL SELECT o_orderkey, 'scan', 'MS:1000016', 'scan start time', NULL, 'UO:0000031' FROM orders
UNION ALL SELECT o_orderkey, 'scan window', 'MS:1000501', 'scan window lower limit', o_custkey::VARCHAR, NULL FROM orders""",
    "validate_spectra": """WITH k AS (SELECT DISTINCT l_orderkey AS key FROM lineitem), e AS (
  SELECT unnest(CASE WHEN key % 5 = 0 THEN ['array mz differs from the array length', 'array intensity differs from the array length', 'array charge differs from the array length', 'an extra array differs from the array length'] ELSE [] END
    || CASE WHEN key % 11 = 0 THEN ['array charge holds NaN or infinity'] ELSE [] END || CASE WHEN key % 7 = 0 THEN ['m/z is negative'] ELSE [] END) AS error FROM k)
SELECT error, count(*) AS n FROM e GROUP BY error""",
    "accession_encode": f"""SELECT p_partkey AS key, a AS accession, split_part(a, ':', 1) AS ontology, p_partkey AS tail, CASE WHEN regexp_full_match(a, 'MS:[0-9]{{7}}') THEN p_partkey::VARCHAR ELSE a END AS wire_key, true AS valid
FROM (SELECT p_partkey, {_ACCESSION_SQL} AS a FROM part)""",
    "unit_encode": f"""SELECT p_partkey AS key, a AS unit, CASE WHEN NOT regexp_full_match(a, '[A-Z]*:[0-9]{{7}}') THEN a WHEN a LIKE 'UO:%' THEN p_partkey::VARCHAR ELSE '[' || split_part(a, ':', 1) || ',' || p_partkey::VARCHAR || ']' END AS wire, a AS back
FROM (SELECT p_partkey, {_ACCESSION_SQL} AS a FROM part)""",
    "to_fragment": f"SELECT page_id, regexp_replace(url, '#.*$', '') || '#' || {_TOKEN_SQL} AS link FROM pages",
    "to_query": f"""SELECT page_id, regexp_replace(regexp_replace(url, '#.*$', ''), '\\?.*$', '') || '?' || array_to_string(list_append({_PAIRS}, 'page=' || {_TOKEN_SQL}), '&') || regexp_extract(url, '(#.*)$', 1) AS link FROM pages""",
    "to_data_uri": f"SELECT page_id, '{U.DATA_URI}' || {_TOKEN_SQL} AS link FROM pages",
    "extract_token": f"SELECT page_id, CASE WHEN page_id % 4 < 3 THEN {_TOKEN_SQL} END AS token FROM pages",
    "b64url_text": f"SELECT doc_id, md5({_B64}) AS digest FROM documents",
    "b64url_back": "SELECT doc_id, md5(text) AS digest FROM documents",
    "inspect_arrays": _sql(f"SELECT key, pos, CASE WHEN array_key = 'tax' THEN 'MS:1000786' ELSE 'MS:' || \"array\"::VARCHAR END AS \"array\", CASE WHEN array_key = 'tax' THEN 'tax' END AS name, 'MS:1000523' AS type, 'MS:' || comp::VARCHAR AS compression, fp AS fixed_point FROM ({_DEFAULT_PLAN})"),
    "breakdown_bytes": f"""SELECT key, pos::INTEGER AS pos, ['header', 'm/z', 'intensity'][pos + 1] AS part, CASE WHEN pos = 0 THEN bytes + 2 * (1 + 3 * (1 + 5) + 1 + 1) ELSE 8 END::INTEGER AS bytes FROM ({_documents(300)}), range(3) t(pos)""",
    "size_ratio": _sql("SELECT key, (count(*) * 40)::BIGINT AS raw_bytes, round((10 + sum(charge)) / count(*), 6) AS per_peak FROM s GROUP BY key"),
    "malformed_codes": "SELECT key, CASE key % 7 WHEN 0 THEN 'wrong magic or version' WHEN 1 THEN 'wrong number of parts' WHEN 2 THEN 'malformed checksum' WHEN 3 THEN 'checksum mismatch' WHEN 4 THEN 'token is not ASCII' WHEN 5 THEN 'document' ELSE 'fine' END AS fault FROM (SELECT DISTINCT l_orderkey AS key FROM lineitem)",
    "tolerance_check": _sql("SELECT key, bool_and(abs(floor(mz * 100 + 0.5) / 100 - mz) <= 1e-6 + 1e-5 * mz) AS near FROM s GROUP BY key"),
    "json_round_trip": _sql("SELECT key, count(*)::INTEGER AS default_array_length, 'int float null' AS kinds, round(max(mz), 4) AS high_mz, count(*)::INTEGER AS n_tax FROM s GROUP BY key"),
    "token_files": _PEAK_SUMS,
    "mzml_scan": _sql("SELECT key, count(*)::INTEGER AS default_array_length, (key % 5 * 10)::DOUBLE AS own, (key % 5 * 10)::DOUBLE AS of_scan, (key % 5 * 10)::DOUBLE AS of_window, 5.5::DOUBLE AS start, 'UO:0000031' AS unit, round(max(mz), 4) AS high_mz, round(min(intensity), 4) AS low_intensity FROM s GROUP BY key"),
    "stream_decode": _PEAK_SUMS,
}
