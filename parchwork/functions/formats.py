"""Fixed-width report lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pad_right(text: Column, width: Column) -> Column:
    """Text filled with spaces up to a width; longer text stays whole."""
    return F.concat(text, F.repeat(F.lit(" "), F.greatest(width - F.length(text), F.lit(0)).cast("int")))


def pad_left(text: Column, width: int) -> Column:
    return F.concat(F.repeat(F.lit(" "), F.greatest(F.lit(width) - F.length(text), F.lit(0))), text)


def seconds(value: Column) -> Column:
    """Seconds with six decimals."""
    return F.format_string("%.6f", value)


def open_line(path: Column, width: Column, value: Column, error: Column) -> Column:
    """A line of the opening log: path, seconds in twelve columns, and the error if there is one."""
    fault = F.when(error.isNull(), F.lit("")).otherwise(F.concat(F.lit("  ERROR: "), error))
    return F.concat(pad_right(path, width), F.lit("  "), pad_left(seconds(value), 12), fault)


def timing_line(path: Column, width: Column, value: Column, error: Column) -> Column:
    """A line of the timing report: path, and seconds or ERROR with the message."""
    shown = F.when(error.isNull(), seconds(value)).otherwise(F.lit("ERROR"))
    fault = F.when(error.isNull(), F.lit("")).otherwise(F.concat(F.lit("  ("), error, F.lit(")")))
    return F.concat(pad_right(path, width), F.lit("  "), pad_left(shown, 12), fault)
