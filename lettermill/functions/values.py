"""Typed values out of text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def seconds_to_ns(text: Column) -> Column:
    """Decimal seconds to integer nanoseconds, cut after nine digits.

    Null when the text is not a number.
    """
    exact = F.trim(text).try_cast("decimal(38,18)")
    cut = F.when(exact < 0, -F.floor(-exact, F.lit(9))).otherwise(F.floor(exact, F.lit(9)))
    return (cut * F.lit(10**9).cast("decimal(10,0)")).cast("bigint")


def attrs_to_map(items: Column) -> Column:
    """Alternating name/value list to a map with upper-cased names.

    The last of several equal names wins; an odd number of items is an error.
    """
    n = F.size(items)
    pairs = F.transform(
        F.when(n >= 2, F.sequence(F.lit(0), n - 2, F.lit(2))).otherwise(
            F.array().cast("array<int>")
        ),
        lambda i: F.struct(
            F.upper(F.get(items, i)).alias("key"), F.get(items, i + 1).alias("value")
        ),
    )

    def last_of_each(bound):
        def is_last(pair, i):
            later = F.slice(bound["names"], i + 2, F.size(bound["names"]))
            return ~F.array_contains(later, pair["key"])

        return F.filter(bound["pairs"], is_last)

    # A list of one struct binds both arrays, so that each is built only once.
    bound = F.array(F.struct(pairs.alias("pairs"))).alias("_")
    bound = F.transform(
        bound,
        lambda b: F.struct(
            b["pairs"].alias("pairs"),
            F.transform(b["pairs"], lambda p: p["key"]).alias("names"),
        ),
    )
    result = F.map_from_entries(F.get(F.transform(bound, last_of_each), F.lit(0)))
    complaint = F.raise_error(F.concat(F.lit("odd number of attributes: "), n.cast("string")))
    return F.when(n % 2 == 1, complaint.cast("map<string,string>")).otherwise(result)
