"""Text rendering as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def imap_quote(text: Column) -> Column:
    """Quoted string: backslashes escaped first, then double quotes."""
    no_backslash = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    no_quote = F.replace(no_backslash, F.lit('"'), F.lit('\\"'))
    return F.concat(F.lit('"'), no_quote, F.lit('"'))


def imap_date(day: Column) -> Column:
    """``1-Jan-1970``: day without leading zero, English month, four-digit year."""
    return F.date_format(day, "d-MMM-yyyy")


def plural(n: Column, one: str, many: str) -> Column:
    """``one`` when n is 1, else ``many``; both are printf patterns taking n."""
    return F.when(n == 1, F.format_string(one, n)).otherwise(F.format_string(many, n))


def join_list(parts: Column) -> Column:
    return F.array_join(parts, ", ")
