"""Parameters: reference groups, labels, duplicates, order, and a flat table of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mzframe import registry as R
from mzframe import schema as S
from mzframe.functions import accessions as A


def value_of(v: Column) -> Column:
    """A tagged value as text; null for a flag."""
    return F.when(v["kind"] == "int", v["i"].cast("string")).when(v["kind"] == "float", v["d"].cast("string")).otherwise(v["s"])


def number_of(v: Column) -> Column:
    return F.when(v["kind"] == "int", v["i"].cast("double")).when(v["kind"] == "float", v["d"])


def number_in(text: Column) -> Column:
    """The double that a text writes, or null."""
    bare = F.trim(text)
    return F.when(bare.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\z"), bare.try_cast("double"))


def kind_of(text: Column, number: Column) -> Column:
    """The kind of a text's tagged value; number: what number_in gives for it."""
    finite = number.isNotNull() & (F.abs(number) < float("inf"))
    whole = finite & (number == F.floor(number)) & (F.abs(number) < 9.2e18)
    return F.when(F.coalesce(text, F.lit("")) == "", "null").when(whole, "int").when(finite, "float").otherwise("str")


def tagged(text: Column, number: Column, kind: Column) -> Column:
    return F.struct(kind.alias("kind"), F.when(kind == "int", F.coalesce(F.trim(text).try_cast("bigint"), number.try_cast("bigint"))).alias("i"), F.when(kind == "float", number).alias("d"), F.when(kind == "str", text).alias("s")).cast(S.VALUE)


def typed_value(text: Column) -> Column:
    """Text as a tagged value: whole numbers are int, other finite ones float, the rest text; empty is null (a flag).

    In a lambda, where Spark shares no common parts, go by its three steps, with a list of structs between."""
    number = number_in(text)
    return tagged(text, number, kind_of(text, number))


def expand_refs(owners: DataFrame, groups: DataFrame, strict: bool = False) -> DataFrame:
    """owners with `params` followed by the parameters of the groups that `refs` names, in order.

    owners: key, refs (array of strings), params; groups: ref, params. A group that is missing is
    skipped, or with strict an error. Spark broadcasts the groups only if they are small."""
    refs = owners.select("key", F.posexplode("refs").alias("pos", "ref"))
    found = refs.join(groups.select("ref", F.col("params").alias("more")), "ref", "left")
    if strict:
        missing = F.concat(F.lit("unresolved parameter group: "), F.col("ref"))
        found = found.withColumn("more", F.when(F.col("more").isNull(), F.raise_error(missing).cast(f"array<{S.CV}>")).otherwise(F.col("more")))
    lists = found.where("more is not null").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("pos", "more"))).alias("lists"))
    joined = owners.join(lists, "key", "left")
    more = F.flatten(F.transform("lists", lambda x: x["more"]))
    return joined.withColumn("params", F.concat("params", F.coalesce(more, F.from_json(F.lit("[]"), f"array<{S.CV}>")))).drop("lists")


def unresolved_refs(owners: DataFrame, groups: DataFrame) -> DataFrame:
    """(key, ref) without a group."""
    return owners.select("key", F.explode("refs").alias("ref")).join(groups.select("ref"), "ref", "left_anti")


def with_labels(rows: DataFrame, accession: str = "accession") -> DataFrame:
    """rows with `label`: the accession's name, or itself. The names are a constant of the library."""
    names = F.create_map(*(F.lit(x) for pair in sorted(R.LABELS.items()) for x in pair))
    return rows.withColumn("label", F.coalesce(F.try_element_at(names, F.col(accession)), F.col(accession)))


def first_param(params: Column, accession: str) -> Column:
    """The first parameter of an accession, or null."""
    return F.try_element_at(F.filter(params, lambda p: p["accession"] == accession), F.lit(1))


def find_param(spectra_column: Column, accession: str, of: str) -> Column:
    """The first parameter of an accession in a list of parts (scans, windows), each with its params in the field `of`."""
    empty = F.from_json(F.lit("[]"), f"array<{S.CV}>")
    return first_param(F.flatten(F.transform(spectra_column, lambda x: F.coalesce(x[of], empty))), accession)


def ms_level(params: Column) -> Column:
    """The value of the ms level where it is a number."""
    return number_of(first_param(params, "MS:1000511")["value"])


def duplicate_accessions(params: Column) -> Column:
    """Accessions that stand more than once in one list."""
    every = F.transform(params, lambda p: p["accession"])
    return F.filter(F.array_distinct(every), lambda a: F.size(F.filter(every, lambda b: a == b)) > 1)


def canonical_order(params: Column) -> Column:
    """As a token's keys are ordered: bare tails by number, then other accessions by length and bytes."""
    keyed = F.transform(params, lambda p: F.struct(F.when(p["accession"].rlike(r"^MS:[0-9]{7}\z"), 0).otherwise(1).alias("text"), F.when(p["accession"].rlike(r"^MS:[0-9]{7}\z"), A.tail(p["accession"])).otherwise(F.octet_length(p["accession"]).cast("bigint")).alias("n"), p["accession"].alias("a"), p.alias("p")))
    return F.transform(F.array_sort(keyed, lambda x, y: F.when(x["text"] != y["text"], x["text"] - y["text"]).when(x["n"] != y["n"], F.when(x["n"] < y["n"], -1).otherwise(1)).when(x["a"] < y["a"], -1).when(x["a"] > y["a"], 1).otherwise(0)), lambda x: x["p"])


def flatten_params(spectra: DataFrame, key: str = "id") -> DataFrame:
    """A row for each controlled-vocabulary parameter: key, part, accession, label, value, unit_accession.

    Numbers are rounded to five places; a flag's value is ``flag``."""
    empty = F.from_json(F.lit("[]"), f"array<{S.CV}>")
    of = lambda windows: F.flatten(F.transform(windows, lambda w: F.coalesce(w["params"], empty)))
    parts = {
        "spectrum": F.col("params"),
        "scan": of(F.col("scans")),
        "scan window": F.flatten(F.transform("scans", lambda s: of(F.coalesce(s["windows"], F.from_json(F.lit("[]"), f"array<{S.WINDOW}>"))))),
        "isolation": of(F.transform("precursors", lambda p: p["isolation_window"])),
        "selected ion": F.flatten(F.transform("precursors", lambda p: of(F.coalesce(p["selected_ions"], F.from_json(F.lit("[]"), f"array<{S.WINDOW}>"))))),
        "activation": of(F.transform("precursors", lambda p: p["activation"])),
        "product": of(F.transform("products", lambda p: p["isolation_window"])),
    }
    tag = lambda n, c: F.transform(F.coalesce(c, empty), lambda p: F.struct(F.lit(n).alias("part"), p.alias("p")))
    tagged = F.concat(*(tag(n, c) for n, c in parts.items()))
    rows = spectra.select(key, F.explode(tagged).alias("t")).select(key, "t.part", F.col("t.p.accession").alias("accession"), F.col("t.p.value").alias("value"), F.col("t.p.unit_accession").alias("unit_accession"))
    v = F.col("value")
    text = F.when(v["kind"] == "null", "flag").when(v["kind"] == "float", F.round(v["d"], 5).cast("string")).otherwise(value_of(v))
    return with_labels(rows.withColumn("value", text))
