"""Coordinates from links and from damaged text."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from placelab.functions.text import strip

# The two link forms that carry a position.
PIN_PATTERN = r"(?U)!8m2!3d(-?\d+\.\d+)!4d(-?\d+\.\d+)"
VIEW_PATTERN = r"(?U)@(-?\d+\.\d+),(-?\d+\.\d+)"

NUMBER_PATTERN = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"

REPAIR_METHODS = ("first", "last", "middle", "average")


def link_coordinates(link: Column) -> Column:
    """Struct (latitude, longitude): the pin position, else the view centre, else nulls."""

    def part(group: int) -> Column:
        pin = F.regexp_extract(link, PIN_PATTERN, group).try_cast("double")
        view = F.regexp_extract(link, VIEW_PATTERN, group).try_cast("double")
        return F.coalesce(pin, view)

    return F.struct(part(1).alias("latitude"), part(2).alias("longitude"))


def to_number(text: Column) -> Column:
    """Double of plain decimal text; Spark's suffix forms such as ``1.0d`` are refused."""
    return F.when(text.rlike(NUMBER_PATTERN), text.try_cast("double"))


def repair_coordinate(value: Column, method: str = "first", separator: str = "-", keep_sign: bool = False) -> Column:
    """One number out of text that may hold several joined by ``separator``.

    A whole-string number wins. Otherwise every part has to be a number, and
    ``method`` picks one (an unknown method picks the first). When the separator
    is the minus sign the leading sign is lost; ``keep_sign`` brings it back.
    """
    text = strip(value)
    pieces = F.filter(F.transform(F.split(text, re.escape(separator)), strip), lambda p: p != "")

    def chosen(numbers: Column) -> Column:
        n = F.size(numbers)
        if method == "last":
            one = F.try_element_at(numbers, n)
        elif method == "middle":
            one = F.try_element_at(numbers, F.floor(n / 2).cast("int") + 1)
        elif method == "average":
            one = F.aggregate(numbers, F.lit(0.0), lambda acc, x: acc + x) / n
        else:
            one = F.try_element_at(numbers, F.lit(1))
        return F.when((n > 0) & ~F.exists(numbers, lambda x: x.isNull()), one)

    # the list of numbers is bound once, as the only element of an array
    picked = F.element_at(F.transform(F.array(F.transform(pieces, to_number)), chosen), 1)
    if keep_sign and separator == "-":
        picked = F.when(text.startswith("-"), -picked).otherwise(picked)
    return F.coalesce(to_number(text), picked)
