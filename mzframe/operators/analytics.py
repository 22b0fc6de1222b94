"""Figures of spectra and of what encoding does to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mzframe import registry as R
from mzframe.functions import quantize as Q

PROTON = 1.0072764665
WATER = 18.0105646863
ISOTOPE = 1.00335
#: Masses of amino acid residues.
RESIDUES = {
    "G": 57.02146, "A": 71.03711, "S": 87.03203, "P": 97.05276, "V": 99.06841, "T": 101.04768, "C": 103.00919, "L": 113.08406, "I": 113.08406, "N": 114.04293,
    "D": 115.02694, "Q": 128.05858, "K": 128.09496, "E": 129.04259, "M": 131.04049, "H": 137.05891, "F": 147.06841, "R": 156.10111, "Y": 163.06333, "W": 186.07931,
}


def base_peak(mz: Column, intensity: Column) -> Column:
    """m/z and intensity of the first most intense peak; null without peaks."""
    top = F.array_max(intensity)
    at = F.array_position(intensity, top).cast("int")
    return F.when(F.size(intensity) > 0, F.struct(F.try_element_at(mz, at).alias("mz"), top.alias("intensity")))


def summary(spectra: DataFrame, key: str = "id") -> DataFrame:
    """key, n_peaks, base_mz, base_intensity, low_mz, high_mz, tic."""
    base = base_peak(F.col("mz"), F.col("intensity"))
    tic = F.aggregate("intensity", F.lit(0.0), lambda s, x: s + x)
    return spectra.select(key, F.col("default_array_length").alias("n_peaks"), base["mz"].alias("base_mz"), base["intensity"].alias("base_intensity"), F.array_min("mz").alias("low_mz"), F.array_max("mz").alias("high_mz"), tic.alias("tic"))


def precision(source: Column, decoded: Column) -> Column:
    """Largest and mean absolute difference, the same in parts per million and in percent; zero denominators count as 0."""
    apart = F.zip_with(source, decoded, lambda a, b: F.abs(a - b))
    share = F.zip_with(source, decoded, lambda a, b: F.when(a == 0, 0.0).otherwise(F.abs(a - b) / F.abs(a)))
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.greatest(F.size(a), F.lit(1))
    most = lambda a: F.coalesce(F.array_max(a), F.lit(0.0))
    return F.struct(most(apart).alias("max_abs"), mean(apart).alias("mean_abs"), (most(share) * 1e6).alias("max_ppm"), (mean(share) * 1e6).alias("mean_ppm"), (most(share) * 100).alias("max_percent"), (mean(share) * 100).alias("mean_percent"))


def linear_residuals(peaks: DataFrame, key: str, order: list[str], fp: int = R.LINEAR_FP) -> DataFrame:
    """peaks with `code` and `residual`: what linear prediction from the two codes before leaves; null for the first two."""
    w = W.partitionBy(key).orderBy(*order)
    code = Q.linear_code(F.col("mz"), fp)
    out = peaks.withColumn("code", code)
    return out.withColumn("residual", F.col("code") - (2 * F.lag("code", 1).over(w) - F.lag("code", 2).over(w)))


def codes_from_residuals(peaks: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The inverse: two running sums give the codes back. Needs code of the first two rows and residual of the others."""
    w = W.partitionBy(key).orderBy(*order)
    run = w.rowsBetween(W.unboundedPreceding, 0)
    first = F.first("code").over(run)
    step = F.when(F.row_number().over(w) == 1, F.lit(0)).when(F.row_number().over(w) == 2, F.col("code") - F.lag("code").over(w)).otherwise(F.col("residual"))
    out = peaks.withColumns({"_first": first, "_step": step}).withColumn("_rise", F.sum("_step").over(run))
    return out.withColumn("restored", F.col("_first") + F.sum("_rise").over(run)).drop("_first", "_step", "_rise")


def ladders(sequences: DataFrame, key: str, sequence: str = "sequence") -> DataFrame:
    """key, ion (b or y), number, mz: singly charged fragments, from running sums over the residues.

    Letters that are no residue count as 0."""
    masses = F.create_map(*(F.lit(x) for pair in RESIDUES.items() for x in pair))
    letters = sequences.select(key, F.posexplode(F.split(F.col(sequence), "")).alias("i", "letter")).where("letter <> ''")
    letters = letters.withColumn("mass", F.coalesce(F.try_element_at(masses, F.col("letter")), F.lit(0.0)))
    w = W.partitionBy(key)
    ahead = F.sum("mass").over(w.orderBy("i").rowsBetween(W.unboundedPreceding, 0))
    behind = F.sum("mass").over(w.orderBy("i").rowsBetween(1, W.unboundedFollowing))
    rows = letters.select(key, "i", ahead.alias("b"), behind.alias("y"), F.max("i").over(w).alias("last")).where("i < last")
    ions = F.array(F.struct(F.lit("b").alias("ion"), (F.col("i") + 1).alias("number"), (F.col("b") + PROTON).alias("mz")), F.struct(F.lit("y").alias("ion"), (F.col("last") - F.col("i")).alias("number"), (F.col("y") + WATER + PROTON).alias("mz")))
    return rows.select(key, F.inline(ions))


def peptide_mass(sequence: Column) -> Column:
    masses = F.create_map(*(F.lit(x) for pair in RESIDUES.items() for x in pair))
    return F.aggregate(F.split(sequence, ""), F.lit(WATER), lambda s, c: s + F.coalesce(F.try_element_at(masses, c), F.lit(0.0)))


def precursor_mz(mass: Column, charge: Column | int) -> Column:
    return (mass + charge * F.lit(PROTON)) / charge


def isotope_envelope(mz: Column, base: Column, charge: Column | int, n: int) -> Column:
    """n peaks (mz, intensity) at steps of the isotope spacing over the charge, each lower by exp(-0.55)."""
    spacing = F.lit(ISOTOPE) / charge
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct((mz + i * spacing).alias("mz"), (base * F.exp(i * F.lit(-0.55))).alias("intensity")))


def raw_bytes(n: Column, has_charge: Column, extra: Column) -> Column:
    """Bytes of the plain arrays: m/z and intensity as doubles, charge too if there is one, extra arrays by their types."""
    widths = F.transform(F.map_values(extra), lambda x: F.size(x["values"]) * F.when(x["dtype"] == "float64", 8).otherwise(4))
    return n * 16 + F.when(has_charge, n * 8).otherwise(0) + F.aggregate(widths, F.lit(0), lambda s, x: s + x)


def bytes_per_peak(token_bytes: Column, n: Column) -> Column:
    """Null for a spectrum without peaks."""
    return F.when(n > 0, token_bytes / n)


def format_bytes(n: Column) -> Column:
    """Bytes below 1,024, else kilobytes of 1,024 with one digit, or megabytes with two; halves are rounded up."""
    n = n.cast("bigint")  # 100 times an int may be no int

    def shown(unit: int, digits: int, name: str) -> Column:
        steps = F.floor(n * 10**digits / F.lit(unit) + 0.5).cast("bigint")
        return F.concat(F.floor(steps / 10**digits).cast("string"), F.lit("."), F.lpad((steps % 10**digits).cast("string"), digits, "0"), F.lit(f" {name}"))

    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1 << 20, shown(1 << 10, 1, "KB")).otherwise(shown(1 << 20, 2, "MB"))
