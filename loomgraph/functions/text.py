"""Column functions over text; all of them stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Outer white space in the wide sense: tabs, line ends, no-break and other Unicode spaces, BOM and zero-width space.
SPACE_CLASS = r"[\s\p{Z}\x1c-\x1f\x85​﻿]"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{SPACE_CLASS}+|{SPACE_CLASS}+$", "")


def strip_spaces(c: Column) -> Column:
    """Outer white space only: zero-width marks stay."""
    return F.regexp_replace(c, r"^[\s\p{Z}\x1c-\x1f\x85]+|[\s\p{Z}\x1c-\x1f\x85]+$", "")


def words(c: Column) -> Column:
    """Maximal runs of Unicode letters or digits of the lower-cased text; null text gives an empty array."""
    return F.coalesce(F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), F.array().cast("array<string>"))


def fold_name(c: Column) -> Column:
    """Lower case, outer white space removed, '-' and inner space as '_'."""
    return F.regexp_replace(F.lower(strip(c)), r"[-\s\p{Z}]", "_")


def shingles(w: Column, size: int) -> Column:
    """Distinct 64-bit hashes of all runs of `size` successive words."""
    n = F.size(w) - F.lit(size - 1)
    run = F.transform(
        F.sequence(F.lit(1), n),
        lambda i: F.xxhash64(*[F.element_at(w, (i + F.lit(k)).cast("int")) for k in range(size)]),
    )
    return F.when(n > 0, F.array_distinct(run)).otherwise(F.array().cast("array<bigint>"))
