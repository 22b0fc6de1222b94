"""The text form of a token: magic, base64url payload and CRC-32, all by built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mzframe.functions.urls import MAGIC


def b64url(data: Column) -> Column:
    """Without padding. Line ends, which Spark may put into long results, are taken out."""
    return F.translate(F.base64(data), "+/=\r\n", "-_")


def is_b64url(text: Column) -> Column:
    bare = F.length(F.rtrim(text, F.lit("=")))
    return text.rlike(r"^[A-Za-z0-9_-]*={0,2}\z") & (bare % 4 != 1)


def from_b64url(text: Column) -> Column:
    """Null where the alphabet or the length is wrong: unbase64 itself would skip what it does not know."""
    bare = F.translate(text, "-_=", "+/")
    padded = F.rpad(bare, ((F.length(bare) + 3) / 4).cast("int") * 4, "=")
    return F.when(is_b64url(text), F.unbase64(padded))


def checksum(body: Column) -> Column:
    """CRC-32 as eight lower-case hexadecimal digits."""
    return F.lower(F.lpad(F.hex(F.crc32(body.cast("binary"))), 8, "0"))


def to_token(payload: Column, magic: str = MAGIC) -> Column:
    body = F.concat(F.lit(f"{magic}."), b64url(payload))
    return F.concat(body, F.lit("."), checksum(body))


def parts(token: Column, magic: str = MAGIC) -> tuple[Column, Column, Column]:
    """The text before the checksum, the payload's text, and the stored checksum."""
    stored = F.substring_index(token, ".", -1)
    body = token.substr(F.lit(1), F.length(token) - F.length(stored) - 1)
    return body, body.substr(F.lit(len(magic) + 2), F.length(body)), stored


def token_error(token: Column, magic: str = MAGIC) -> Column:
    """The first fault of a token's text, or null: null, ascii, magic, parts, checksum form, checksum, base64."""
    body, payload, stored = parts(token, magic)
    dots = F.length(token) - F.length(F.replace(token, F.lit("."), F.lit("")))
    return (
        F.when(token.isNull(), "null token")
        .when(~token.rlike(r"^[\x00-\x7f]*\z"), "token is not ASCII")
        .when(~token.startswith(f"{magic}."), "wrong magic or version")
        .when(dots != magic.count(".") + 2, "wrong number of parts")
        .when(~stored.rlike(r"^[0-9a-f]{8}\z"), "malformed checksum")
        .when(checksum(body) != stored, "checksum mismatch")
        .when(~is_b64url(payload), "invalid base64url payload")
    )
