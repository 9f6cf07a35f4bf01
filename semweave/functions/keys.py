"""Optional key lists: pairs whose lists are known and disjoint need no decision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def known(keys: Column) -> Column:
    """The list's elements without nulls."""
    return F.filter(keys, lambda x: x.isNotNull())


def keys_overlap(a: Column | str, b: Column | str) -> Column:
    """True if either list is null (unknown) or they share an element that is not null; never null."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return a.isNull() | b.isNull() | F.coalesce(F.arrays_overlap(known(a), known(b)), F.lit(False))
