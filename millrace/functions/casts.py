"""Lenient parsing: what does not parse becomes null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The date formats that are tried, in this order, each with how any text that it parses must begin. A text that
# doesn't fit costs an exception in the parser, so only those that begin that way get there.
_YMD = r"[+-]?[0-9]{4,}-[0-9]{2}-[0-9]{2}"
DATE_SHAPES = {
    "yyyy-MM-dd HH:mm:ss[.SSSSSS][XXX]": rf"^{_YMD} [0-9]{{2}}:[0-9]{{2}}:", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][XXX]": rf"^{_YMD}[Tt][0-9]{{2}}:[0-9]{{2}}:",
    "yyyy-MM-dd HH:mm": rf"^{_YMD} [0-9]{{2}}:", "yyyy-MM-dd'T'HH:mm": rf"^{_YMD}[Tt][0-9]{{2}}:", "yyyy-MM-dd": rf"^{_YMD}",
    "yyyy/MM/dd": r"^[+-]?[0-9]{4,}/[0-9]{2}/", "MM/dd/yyyy": r"^[0-9]{2}/[0-9]{2}/", "d MMM yyyy": r"^[+-]?[0-9]+ \S+ ",
    "d MMMM yyyy": r"^[+-]?[0-9]+ \S+ ", "MMM d, yyyy": r"^\S+ [+-]?[0-9]+, ", "MMMM d, yyyy": r"^\S+ [+-]?[0-9]+, "}
DATE_FORMATS = list(DATE_SHAPES)
# How a number begins, but for what a cast strips; "nan" is none.
NUMBER_SHAPE = r"^[^\x21-\x7E]*[-+.0-9iI]"


def to_number(c: Column) -> Column:
    """Number in a string, else null; NaN counts as missing, a type suffix (1d, 1f) does not parse."""
    x = F.when(F.rlike(c, F.lit(NUMBER_SHAPE)), c.try_cast("double"))
    return F.when(~F.isnan(x) & ~F.rlike(c, F.lit(r"[0-9.][dDfF]\s*$")), x)


def to_moment(c: Column) -> Column:
    """Timestamp in a string by the first format that fits, else null."""
    text = F.trim(c)
    return F.coalesce(*[F.when(F.rlike(text, F.lit(shape)), F.try_to_timestamp(text, F.lit(f)).cast("timestamp_ntz"))
                        for f, shape in DATE_SHAPES.items()])
