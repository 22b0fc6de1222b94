"""Accessions such as MS:1000511, their numeric tails, and units."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PATTERN = r"^[A-Za-z][A-Za-z0-9]*:[A-Za-z0-9]+\z"
SEVEN_DIGITS = r"^[^:]*:[0-9]{7}\z"


def is_accession(accession: Column) -> Column:
    return accession.rlike(PATTERN)


def ontology(accession: Column) -> Column:
    """What stands before the first colon."""
    return F.substring_index(accession, ":", 1)


def tail(accession: Column) -> Column:
    """The number behind the first colon; null where it is none."""
    return F.regexp_extract(accession, r"^[^:]*:([0-9]+)\z", 1).try_cast("bigint")


def from_tail(number: Column, prefix: Column | str = "MS") -> Column:
    """Seven digits, or more where the number has more."""
    prefix = F.lit(prefix) if isinstance(prefix, str) else prefix
    return F.concat(prefix, F.lit(":"), F.format_string("%07d", number))


def wire_key(accession: Column) -> Column:
    """A parameter's key: the bare tail of an MS accession with seven digits, else the whole accession, both as strings."""
    return F.when(accession.rlike(r"^MS:[0-9]{7}\z"), tail(accession).cast("string")).otherwise(accession)


def wire_unit(unit: Column) -> Column:
    """The bare tail of a UO unit with seven digits; ontology and tail of another one; else the whole accession."""
    number = tail(unit).cast("string")
    return F.when(~unit.rlike(SEVEN_DIGITS), unit).when(ontology(unit) == "UO", number).otherwise(F.concat(F.lit("["), ontology(unit), F.lit(","), number, F.lit("]")))


def unit_from_wire(wire: Column) -> Column:
    pair = F.regexp_extract(wire, r"^\[([^,]*),", 1)
    number = F.regexp_extract(wire, r"^(?:\[[^,]*,)?([0-9]+)\]?\z", 1).try_cast("bigint")
    return F.when(number.isNull(), wire).otherwise(from_tail(number, F.when(pair == "", "UO").otherwise(pair)))
