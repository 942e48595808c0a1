"""Checks of fields in documents, as columns that are true where a value is fine. Nulls are not."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the most bytes of a token or name.
LONGEST = 128


def token(value: Column) -> Column:
    """Letters, digits and . _ - : of ASCII."""
    return F.coalesce(value.rlike(r"\A[A-Za-z0-9._:-]{1,128}\z"), F.lit(False))


def name(value: Column) -> Column:
    """A name for people: not empty, not too long, without margins and control characters."""
    plain = value.rlike(r"(?U)\A(?!\s)[^\p{Cc}]+(?<!\s)\z")
    return F.coalesce(plain & (F.octet_length(value) <= LONGEST), F.lit(False))


def hex256(value: Column) -> Column:
    """A SHA-256 in lower-case digits."""
    return F.coalesce(value.rlike(r"\A[0-9a-f]{64}\z"), F.lit(False))


def quoted(text: Column) -> Column:
    """What stands between the first two single quotes; the whole text where there are none."""
    found = F.regexp_extract(text, "'([^']*)'", 1)
    return F.when(text.rlike("'[^']*'"), found).otherwise(text)
