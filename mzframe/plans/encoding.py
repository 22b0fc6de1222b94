"""The encoding plan: codec, type and fixed point of every array, from its values alone.

A plan is an expression over the arrays' minima, maxima and types; nothing is encoded for it."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mzframe import registry as R
from mzframe import schema as S
from mzframe.functions import accessions as A
from mzframe.functions import quantize as Q


@dataclass(frozen=True)
class ArrayEncoding:
    """How one array is to be encoded. codec: a name, an accession or a tail; "auto" is the default for the array."""

    codec: str | int = "auto"
    fixed_point: int | None = None

    @staticmethod
    def of(value: ArrayEncoding | str | int | Mapping | None) -> ArrayEncoding:
        if value is None or isinstance(value, ArrayEncoding):
            return value or ArrayEncoding()
        if isinstance(value, Mapping):
            if more := set(value) - {"codec", "fixed_point"}:
                raise ValueError(f"unknown options of an array encoding: {', '.join(sorted(more))}")
            return ArrayEncoding(**value)
        if isinstance(value, (str, int)) and not isinstance(value, bool):
            return ArrayEncoding(value)
        raise TypeError(f"not an array encoding: {value!r}")

    def tail(self) -> int | None:
        if self.codec == "auto":
            return None
        if isinstance(self.codec, int):
            return self.codec
        if self.codec.startswith("MS:") and self.codec[3:].isdigit():
            return int(self.codec[3:])
        if self.codec not in R.CODECS:
            raise ValueError(f"unknown codec {self.codec!r}")
        return R.CODECS[self.codec]


def _transforms(key: str) -> tuple[int, ...]:
    """The lossy codecs that suit an array."""
    tail = int(key[3:]) if key.startswith("MS:") and key[3:].isdigit() else 0
    if key == "mz" or tail in R.LINEAR_ARRAYS:
        return R.LINEAR
    if key == "intensity" or tail in R.SLOF_ARRAYS:
        return (*R.LINEAR, *R.SLOF)
    if key == "charge" or tail in R.PIC_ARRAYS:
        return R.PIC
    return ()


def check_overrides(overrides: Mapping[str, object] | None, lossless: bool, allow_unsafe: bool) -> dict[str, ArrayEncoding]:
    """The overrides by canonical key. What is wrong with them whatever the data raises ValueError at once."""
    out: dict[str, ArrayEncoding] = {}
    for raw, value in (overrides or {}).items():
        key, e = R.CORE.get(raw, raw), ArrayEncoding.of(value)
        if key in out:
            raise ValueError(f"two encodings for array {key!r}")
        comp, fp = e.tail(), e.fixed_point
        if comp is not None:
            if comp not in R.CODECS.values():
                raise ValueError(f"unknown codec {e.codec!r}")
            if lossless and comp in R.LOSSY:
                raise ValueError(f"array {key!r} asks for a lossy codec in lossless mode")
            if fp is not None and comp not in (*R.LINEAR, *R.SLOF):
                raise ValueError(f"array {key!r} has a fixed point, but its codec takes none")
            suits = _transforms(key)
            if comp in R.LOSSY and comp not in suits and (suits or not allow_unsafe):
                raise ValueError(f"array {key!r} does not suit codec {e.codec!r}")
            if fp is not None and (isinstance(fp, bool) or not isinstance(fp, int) or not 0 < fp <= R.MAX_SAFE_INTEGER):
                raise ValueError(f"array {key!r} has a fixed point that is no positive whole number")
        out[key] = e
    return out


def _seen(key: Column, values: Column, tail: Column, kind: Column, unit: Column, name: Column, codec: Column, whole: bool) -> Column:
    """What the plan of an array needs to know of it. codec: the lossy one for its kind of array, or null."""
    fields = {"key": key, "array": tail.cast("int"), "type": kind.cast("int"), "unit": unit.cast("string"), "name": name.cast("string"), "codec": codec.cast("int")}
    fields |= {"low": F.array_min(values), "high": F.array_max(values), "whole": Q.is_whole(values) if whole else F.lit(True)}
    return F.struct(*(c.alias(n) for n, c in fields.items()))


def _plain(key: Column, values: Column, tail: Column, kind: Column, unit: Column, name: Column, codec: Column, whole: bool) -> Column:
    """The plan's entry of an array that is kept as it is, whatever its values."""
    fields = {"key": key, "array": tail.cast("int"), "type": kind.cast("int"), "comp": F.lit(R.ZLIB), "fp": F.lit(None).cast("bigint")}
    fields |= {"name": name.cast("string"), "unit": unit.cast("string"), "error": F.lit(None).cast("string")}
    return F.struct(*(c.alias(n) for n, c in fields.items()))


def _planned(entries: Column, lossless: bool, overrides: dict[str, ArrayEncoding]) -> Column:
    """Plan entries of what was seen of the arrays; `error` says why an override cannot be met.

    In steps, each a transform of its own: what a lambda uses twice it would work out twice, and all below it."""
    asked = {k: e for k, e in overrides.items() if e.tail() is not None}
    fits = lambda e, fp: F.coalesce(e["high"] * fp < float(1 << 29), F.lit(True))
    negative = lambda e: F.coalesce(e["low"] < 0, F.lit(False))

    def with_codec(e: Column) -> Column:
        bad = negative(e) | e["codec"].isin(*R.LINEAR) & ~fits(e, R.LINEAR_FP)
        comp = F.lit(R.ZLIB) if lossless else F.when(e["codec"].isNull() | bad, R.ZLIB).otherwise(e["codec"])
        fixed = F.lit(None).cast("bigint")
        for k, x in asked.items():
            comp = F.when(e["key"] == k, F.lit(x.tail())).otherwise(comp)
            fixed = F.when(e["key"] == k, F.lit(x.fixed_point).cast("bigint")).otherwise(fixed)
        return F.struct(*(e[n].alias(n) for n in ("key", "array", "type", "unit", "name", "low", "high", "whole")), comp.cast("int").alias("comp"), fixed.alias("fixed"))

    def with_fp(e: Column) -> Column:
        safe = F.when(e["comp"].isin(*R.SLOF), Q.safe_slof_fp(e["high"], F.coalesce(e["fixed"], F.lit(R.SLOF_FP))))
        fp = F.when(e["comp"].isin(*R.LINEAR), F.coalesce(e["fixed"], F.lit(R.LINEAR_FP))).otherwise(safe)
        return F.struct(*(e[n].alias(n) for n in ("key", "array", "type", "unit", "name", "low", "high", "whole", "comp", "fixed")), fp.cast("bigint").alias("fp"))

    def entry(e: Column) -> Column:
        key, comp, error = e["key"], e["comp"], F.lit(None)
        if asked:
            error = (
                F.when(comp.isin(*R.LOSSY) & negative(e), F.concat(F.lit("array "), key, F.lit(" is negative and its codec lossy")))
                .when(comp.isin(*R.PIC) & ~e["whole"], F.concat(F.lit("array "), key, F.lit(" has fractions and its codec takes whole numbers")))
                .when(comp.isin(*R.SLOF) & (e["fixed"] != e["fp"]), F.concat(F.lit("array "), key, F.lit(" would overflow at its fixed point")))
                .when(comp.isin(*R.LINEAR) & ~fits(e, e["fp"]), F.concat(F.lit("array "), key, F.lit(" is too large for its codec")))
            )
            error = F.when(key.isin(list(asked)), error)
        kind = F.when(comp.isin(*R.LOSSY), R.FLOAT64).otherwise(e["type"])
        return F.struct(key.alias("key"), e["array"].alias("array"), kind.cast("int").alias("type"), comp.alias("comp"), e["fp"].alias("fp"), e["name"].alias("name"), e["unit"].alias("unit"), error.cast("string").alias("error"))

    return F.transform(F.transform(F.transform(entries, with_codec), with_fp), entry)


def encoding_plan(lossless: bool = False, overrides: Mapping[str, object] | None = None, allow_unsafe: bool = False) -> Column:
    """An array with an entry for each array of a spectrum, in the order of a token's descriptors.

    By default m/z and like arrays are linear, intensities and like ones slof, charges pic, all under
    zlib; arrays that hold a negative value, m/z too large for the linear transform, others and all
    in lossless mode are plain zlib. Columns: mz, intensity, charge, extra_arrays, array_units."""
    chosen = check_overrides(overrides, lossless, allow_unsafe)
    units = F.col("array_units")
    unit = lambda name, accession: F.coalesce(F.try_element_at(units, F.lit(name)), F.try_element_at(units, F.lit(accession)))
    whole = any(e.tail() in R.PIC for e in chosen.values())
    plain = lossless and all(e.tail() is None for e in chosen.values())
    look = _plain if plain else _seen
    core = []
    for name, accession, codec in (("mz", "MS:1000514", R.LINEAR_ZLIB), ("intensity", "MS:1000515", R.SLOF_ZLIB), ("charge", "MS:1000516", R.PIC_ZLIB)):
        seen = look(F.lit(name), F.col(name), F.lit(int(accession[3:])), F.lit(R.FLOAT64), unit(name, accession), F.lit(None), F.lit(codec), whole)
        core.append(F.when(F.col(name).isNotNull(), seen))
    extra = F.col("extra_arrays")

    def known(key: Column) -> Column:
        return F.struct(key.alias("key"), F.element_at(extra, key).alias("x"), F.when(key.rlike(r"^MS:[0-9]{7}\z"), A.tail(key)).alias("tail"))

    def other(e: Column) -> Column:
        tail, dtype = e["tail"], e["x"]["dtype"]
        codec = F.when(tail.isin(*R.LINEAR_ARRAYS), R.LINEAR_ZLIB).when(tail.isin(*R.SLOF_ARRAYS), R.SLOF_ZLIB).when(tail.isin(*R.PIC_ARRAYS), R.PIC_ZLIB)
        kind = F.when(dtype == "float32", R.FLOAT32).when(dtype == "int32", R.INT32).otherwise(R.FLOAT64)
        return look(e["key"], e["x"]["values"], F.coalesce(tail, F.lit(R.ARRAY_NON_STANDARD)), kind, F.try_element_at(units, e["key"]), F.when(tail.isNull(), e["key"]), codec, whole)

    others = F.transform(F.transform(F.array_sort(F.map_keys(extra)), known), other)
    entries = F.concat(F.array_compact(F.array(*core)), others)
    return entries if plain else _planned(entries, lossless, chosen)


def plan_table(spectra: DataFrame, key: str = "id", **options: object) -> DataFrame:
    """A row for each array: key, pos, array_key, array, type, comp, fp, name, unit, error."""
    entries = spectra.select(key, F.posexplode(encoding_plan(**options)).alias("pos", "e"))
    return entries.select(key, "pos", F.col("e.key").alias("array_key"), "e.array", "e.type", "e.comp", "e.fp", "e.name", "e.unit", "e.error")


PLAN_TYPE = f"array<{S.PLAN}>"
