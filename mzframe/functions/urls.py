"""Tokens in URLs: fragments, query parameters and data URIs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAGIC = "mzframe.v1"
DATA_URI = "data:application/vnd.mzframe;v=1,"


def to_fragment(token: Column, base: Column) -> Column:
    """base without trailing #, then # and the token."""
    return F.concat(F.regexp_replace(base, "#+$", ""), F.lit("#"), token)


def to_query(token: Column, base: Column, param: str = "d") -> Column:
    """The token as the last query parameter; others stay, those of the same name go, the fragment stays last."""
    fragment = F.regexp_extract(base, r"(#.*)$", 1)
    whole = F.regexp_replace(base, r"#.*$", "")
    query = F.regexp_extract(whole, r"\?(.*)$", 1)
    pairs = F.filter(F.split(query, "&"), lambda p: (p != "") & (F.try_url_decode(F.substring_index(p, "=", 1)) != param))
    # parameters are decoded and encoded again, so that their spelling is uniform
    code = lambda s: F.coalesce(F.url_encode(F.try_url_decode(s)), s)
    shaped = F.transform(pairs, lambda p: F.concat(code(F.substring_index(p, "=", 1)), F.lit("="), code(F.when(F.instr(p, "=") > 0, p.substr(F.instr(p, "=") + 1, F.length(p))).otherwise(""))))
    named = F.array(F.concat(F.lit(f"{param}="), token))
    return F.concat(F.regexp_replace(whole, r"\?.*$", ""), F.lit("?"), F.array_join(F.concat(shaped, named), "&"), fragment)


def to_data_uri(token: Column, prefix: str = DATA_URI) -> Column:
    return F.concat(F.lit(prefix), token)


def extract_token(url: Column, magic: str = MAGIC, prefix: str = DATA_URI) -> Column:
    """From a data URI, else a fragment, else the first query value that begins with the magic; null if there is none."""
    start = f"{magic}."
    fragment = F.regexp_extract(url, r"#(.*)$", 1)
    query = F.regexp_extract(F.regexp_replace(url, r"#.*$", ""), r"\?(.*)$", 1)
    values = F.transform(F.split(query, "&"), lambda p: F.try_url_decode(F.when(F.instr(p, "=") > 0, p.substr(F.instr(p, "=") + 1, F.length(p)))))
    found = F.try_element_at(F.filter(values, lambda v: v.startswith(start)), F.lit(1))
    return F.when(url.startswith(prefix), url.substr(F.lit(len(prefix) + 1), F.length(url))).when(fragment.startswith(start), fragment).otherwise(found)
