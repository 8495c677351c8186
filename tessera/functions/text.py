"""Column expressions on text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of any script that surrounds a value: Java's \s with the Unicode flag, and the no-break spaces.
EDGE = r"(?U)^[\s   ﻿]+|[\s   ﻿]+$"


def trim_all(c: Column) -> Column:
    """Text without surrounding white space of any kind."""
    return F.regexp_replace(c, EDGE, "")


def norm_id(c: Column) -> Column:
    """An id, trimmed and in lower case; null if nothing is left."""
    return F.nullif(F.lower(trim_all(c)), F.lit(""))


def norm_name(c: Column) -> Column:
    """A name, trimmed; null if nothing is left. Letter case is kept."""
    return F.nullif(trim_all(c), F.lit(""))


def words(c: Column) -> Column:
    """Lower-cased runs of letters and digits, in order; an empty array for null."""
    return F.coalesce(F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), F.array().cast("array<string>"))
