"""Peaks of spectra: canonical order, the most intense ones, and peak tables.

A spectrum table has a row for each spectrum with parallel arrays; a peak table has a row for each
peak, with the spectrum's key and the peak's position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mzframe import registry as R
from mzframe import schema as S

EXTRA_MAP = f"map<string, {S.EXTRA}>"


def complete(spectra: DataFrame) -> DataFrame:
    """Every spectrum column, in the schema's types: missing ones are null, maps and lists empty, and the length is that of the arrays."""
    made = {}
    for name, kind in S.COLUMNS.items():
        c = F.col(name) if name in spectra.columns else F.lit(None)
        if kind.startswith("array<struct"):
            c = F.coalesce(c.cast(kind), F.from_json(F.lit("[]"), kind))
        elif kind.startswith("map"):
            c = F.coalesce(c.cast(kind), F.from_json(F.lit("{}"), kind))
        made[name] = c.cast(kind)
    made["default_array_length"] = F.coalesce(made["default_array_length"], F.size("mz") if "mz" in spectra.columns else F.lit(0), F.lit(0)).cast("int")
    made["default_array_length"] = F.when(made["default_array_length"] < 0, 0).otherwise(made["default_array_length"]) if "default_array_length" not in spectra.columns else made["default_array_length"]
    return spectra.withColumns(made)


def _pick(values: Column, order: Column) -> Column:
    """The values at zero-based positions; a null array stays null."""
    return F.when(values.isNotNull(), F.transform(order, lambda i: F.get(values, i)))


def _pick_extra(extra: Column, order: Column) -> Column:
    """Extra arrays of the same length as the order's source follow it."""
    return F.transform_values(extra, lambda _, x: x.withField("values", _pick(x["values"], order)))


def _reordered(spectra: DataFrame, order: Column, applies: Column, length: Column | None = None) -> DataFrame:
    """Arrays of each row where `applies`, at the positions that `order` gives."""
    out = spectra.withColumn("_order", F.when(applies, order))
    o = F.col("_order")
    change = lambda c, new: F.when(o.isNull(), c).otherwise(new)
    made = {n: change(F.col(n), _pick(F.col(n), o)) for n in ("mz", "intensity", "charge") if n in out.columns}
    if "extra_arrays" in out.columns:
        made["extra_arrays"] = change(F.col("extra_arrays"), _pick_extra(F.col("extra_arrays"), o))
    if length is not None and "default_array_length" in out.columns:
        made["default_array_length"] = change(F.col("default_array_length"), length)
    return out.withColumns(made).drop("_order")


def positions(values: Column) -> Column:
    """0 to the length less one; empty for an empty array."""
    return F.when(F.size(values) > 0, F.sequence(F.lit(0), F.size(values) - 1)).otherwise(F.array().cast("array<int>"))


def canonical_sort(spectra: DataFrame) -> DataFrame:
    """Peaks by ascending m/z, equal ones in their old order; charge and extra arrays go along. No m/z: unchanged."""
    keyed = F.array_sort(F.zip_with("mz", positions(F.col("mz")), lambda m, i: F.struct((m + F.lit(0.0)).alias("m"), i.alias("i"))))
    return _reordered(spectra, F.transform(keyed, lambda s: s["i"]), F.col("mz").isNotNull() & (F.size("mz") > 0))


def top_n(spectra: DataFrame, n: int) -> DataFrame:
    """The n most intense peaks of each spectrum, in canonical order.

    Ties go to the lower m/z (the position where there is none), then to the earlier peak. A
    spectrum without intensities or with up to n peaks is unchanged."""
    if n < 0:
        raise ValueError(f"n must not be negative: {n}")
    spot = positions(F.col("intensity"))
    second = F.coalesce(F.col("mz"), spot.cast("array<double>"))
    ranked = F.transform(F.arrays_zip(F.col("intensity").alias("x"), second.alias("m"), spot.alias("i")), lambda s: F.struct((-s["x"]).alias("x"), s["m"].alias("m"), s["i"].alias("i")))
    best = F.slice(F.array_sort(ranked), 1, n) if n else F.slice(ranked, 1, 0)
    order = F.transform(F.array_sort(F.transform(best, lambda s: F.struct(s["m"].alias("m"), s["i"].alias("i")))), lambda s: s["i"])
    return _reordered(spectra, order, F.col("intensity").isNotNull() & (F.size("intensity") > n), F.lit(n))


def drop_user_params(spectra: DataFrame) -> DataFrame:
    """Without the user parameters of spectra and of their scans."""
    empty = F.from_json(F.lit("[]"), f"array<{S.USER}>")
    return spectra.withColumns({"user_params": empty, "scans": F.transform("scans", lambda s: s.withField("user_params", empty))})


def mobility_arrays(extra: Column) -> Column:
    """The ion mobility arrays among extra arrays."""
    return F.map_filter(extra, lambda k, _: k.isin([f"MS:{t}" for t in R.MOBILITY_ARRAYS]))


def peak_table(spectra: DataFrame, key: str = "id") -> DataFrame:
    """A row for each peak: key, pos (from 0), mz, intensity, charge."""
    zipped = F.arrays_zip(*(F.coalesce(F.col(c), F.array().cast("array<double>")).alias(c) for c in ("mz", "intensity", "charge")))
    return spectra.select(key, F.posexplode(zipped).alias("pos", "p")).select(key, "pos", "p.mz", "p.intensity", "p.charge")


def spectra_from_peaks(peaks: DataFrame, key: str, position: list[str], arrays: dict[str, str], extra: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """A row for each key, with arrays in the order of the position columns.

    arrays: column by array name; extra: (column, dtype) by extra-array key. One shuffle by key."""
    fields = [F.col(c) for c in position] + [F.col(c).cast("double").alias(n) for n, c in arrays.items()]
    fields += [F.col(c).cast("double").alias(f"x{i}") for i, (c, _) in enumerate((extra or {}).values())]
    rows = peaks.groupBy(F.col(key).cast("string").alias("id")).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("peaks"))
    field = lambda n: F.transform("peaks", lambda p: p[n])
    made = {n: field(n) for n in arrays}
    made["default_array_length"] = F.size("peaks")
    if extra:
        pairs = []
        for i, (name, (_, dtype)) in enumerate(extra.items()):
            pairs += [F.lit(name), F.struct(F.lit(dtype).alias("dtype"), field(f"x{i}").alias("values"))]
        made["extra_arrays"] = F.create_map(*pairs)
    return complete(rows.withColumns(made).drop("peaks"))


def rank_peaks(peaks: DataFrame, key: str, n: int, position: list[str]) -> DataFrame:
    """The n most intense rows of each key in a peak table: a window whose rank limit Spark applies before the shuffle too."""
    order = W.partitionBy(key).orderBy(F.desc("intensity"), "mz", *position)
    return peaks.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
