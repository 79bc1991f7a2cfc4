"""Text expressions, all evaluated inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters on which a line ends, besides the pair CR LF.
LINE_BREAKS = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x85\\u2028\\u2029]"


def clean_id(c: Column | str) -> Column:
    """An id without outer spaces and in lower case; null if nothing is left."""
    c = F.col(c) if isinstance(c, str) else c
    return F.nullif(F.lower(F.trim(c.cast("string"))), F.lit(""))


def split_lines(c: Column | str) -> Column:
    """Lines without their ends; an end of line at the very end opens no further line."""
    c = F.col(c) if isinstance(c, str) else c
    parts = F.split(c, LINE_BREAKS, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def short_id(*parts: Column) -> Column:
    """The first 16 hex digits of the SHA-256 of the parts joined by ':'."""
    return F.substring(F.sha2(F.concat_ws(":", *parts), 256), 1, 16)


def cut_code(c: Column, most: int = 8000) -> Column:
    """A text of at most ``most`` characters: all before its code stays and the code is shortened; a plain cut only where that leaves the code no room."""
    mark, end = "\nCode:\n", F.lit("\n... [truncated]")
    text = F.regexp_replace(c, "(?U)^\\s+|\\s+$", "")
    text = F.when(text == "", "empty").otherwise(text)
    parts = F.split(text, mark, -1)
    head = F.element_at(parts, 1)
    room = F.lit(most - len(mark) - 30) - F.length(head)
    plain = F.concat(F.substring(text, 1, most - 20), end)
    return (
        F.when(F.length(text) <= most, text)
        .when(F.size(parts) < 2, plain)
        .when(room > 100, F.concat(head, F.lit(mark), F.substring(F.element_at(parts, F.least(F.lit(2), F.size(parts))), F.lit(1), room), end))
        .otherwise(F.concat(F.substring(head, 1, most - 20), end))
    )


def period(c: Column | str) -> Column:
    """Calendar month of a timestamp as yyyy-MM; null stays null."""
    return F.date_format(c, "yyyy-MM")
