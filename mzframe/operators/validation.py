"""Checks of spectra before they are encoded. Each check is an expression; none stops a job."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mzframe import registry as R
from mzframe.functions import accessions as A

CORE_NAMES = ("mz", "intensity", "charge")


def finite(values: Column) -> Column:
    return F.forall(values, lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))


def extra_key_error(key: Column) -> Column:
    """Why a key cannot name an extra array, or null."""
    return (
        F.when(key.isin(list(R.CORE)), F.concat(F.lit("core array accession "), key, F.lit(" has a field of its own")))
        .when(key == f"MS:{R.ARRAY_NON_STANDARD}", "non-standard arrays are keyed by their name")
        .when(key.isin(list(CORE_NAMES)), F.concat(F.lit("array name "), key, F.lit(" is reserved")))
        .when(key.rlike(r"^MS:[0-9]{7}\z"), F.lit(None))
        .when(A.is_accession(key), F.concat(F.lit("array accession "), key, F.lit(" is not a seven-digit MS one")))
    )


def core_key(key: Column) -> Column:
    """mz, intensity or charge for their accessions; other keys unchanged."""
    named = F.create_map(*(F.lit(x) for pair in R.CORE.items() for x in pair))
    return F.coalesce(F.try_element_at(named, key), key)


def errors(extra: bool = True) -> Column:
    """All that is wrong with a spectrum, in the order of the checks; empty if nothing is."""
    n = F.col("default_array_length")
    found = [
        F.when(n.isNull() | (n < 0) | (n > R.MAX_PEAKS), f"array length is not within 0 and {R.MAX_PEAKS}"),
        *(F.when(F.size(c) != n, f"array {c} differs from the array length") for c in CORE_NAMES),
        *(F.when(~finite(F.col(c)), f"array {c} holds NaN or infinity") for c in CORE_NAMES),
        F.when(F.array_min("mz") < 0, "m/z is negative"),
    ]
    if extra:
        arrays, units = F.col("extra_arrays"), F.col("array_units")
        keys = F.transform(F.map_keys(units), core_key)
        valid = F.concat(F.array(*map(F.lit, CORE_NAMES)), F.map_keys(arrays))
        found += [
            F.when(F.exists(F.map_values(arrays), lambda x: F.size(x["values"]) != n), "an extra array differs from the array length"),
            F.when(F.exists(F.map_values(arrays), lambda x: (x["dtype"] != "int32") & ~finite(x["values"])), "an extra array holds NaN or infinity"),
            F.when(F.exists(F.map_values(arrays), lambda x: ~x["dtype"].isin(list(R.DTYPES))), "an extra array's type has no form in tokens"),
            F.try_element_at(F.filter(F.transform(F.map_keys(arrays), extra_key_error), lambda e: e.isNotNull()), F.lit(1)),
            F.when(F.size(F.array_except(keys, valid)) > 0, "a unit names no array"),
            F.when(F.size(F.array_distinct(keys)) < F.size(keys), "units name an array twice"),
            F.when(F.exists(F.map_values(units), lambda u: ~A.is_accession(u)), "a unit is no accession"),
        ]
    return F.array_compact(F.array(*found))


def interpretation_parses(interp: Column) -> Column:
    """Whether a peptide notation can be parsed, by the optional library pyteomics; true where that is not
    installed, and null for null. It warns of nothing and fails nothing: whoever minds filters by it."""

    @F.arrow_udf("boolean")
    def parses(texts: pa.Array) -> pa.Array:
        try:
            from pyteomics import proforma
        except ImportError:
            return pa.array([None if t is None else True for t in texts.to_pylist()], pa.bool_())

        def fine(text: str) -> bool:
            try:
                proforma.parse(text)
            except Exception:  # noqa: BLE001 - whatever the library raises means no
                return False
            return True

        return pa.array([None if t is None else fine(t) for t in texts.to_pylist()], pa.bool_())

    return parses(interp)


def validate(spectra: DataFrame) -> DataFrame:
    """spectra with `errors`, an array of texts."""
    return spectra.withColumn("errors", errors())


def within(a: Column, b: Column, absolute: float, relative: float) -> Column:
    """Whether two arrays agree to absolute + relative * |b|, value by value."""
    return (F.size(a) == F.size(b)) & F.forall(F.zip_with(a, b, lambda x, y: F.abs(x - y) <= absolute + relative * F.abs(y)), lambda ok: ok)
