"""Label parsing: structured text cells to columns, by regular expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from grainwise.functions.cleaning import col

# Fixed pattern: "<DETAIL> - <STATISTIC>, MEASURED IN <UNIT>"
ITEM_PATTERN = r"^(.*) - ([^,]+)(?:, MEASURED IN (.*))?$"
# Fixed pattern: "<name> <type>, <State>"
PLACE_PATTERN = r"^(.*) (\S+), (.+)$"


def _group(c: Column, pattern: str, g: int) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, g), F.lit(""))


def parse_item(c: str | Column) -> dict[str, Column]:
    c = col(c)
    return {k: _group(c, ITEM_PATTERN, g) for g, k in enumerate(("detail", "statistic", "unit"), 1)}


def parse_place(c: str | Column) -> dict[str, Column]:
    c = col(c)
    return {k: _group(c, PLACE_PATTERN, g) for g, k in enumerate(("place", "place_type", "state"), 1)}


def inside_parens(c: str | Column) -> Column:
    """Text inside ``: ( ... )``."""
    return _group(col(c), r": \(([^)]*)\)", 1)


def split_pair(c: str | Column, sep: str = "=") -> tuple[Column, Column]:
    """Split once on ``sep``."""
    parts = F.split(col(c), sep, 2)
    return F.trim(F.get(parts, F.lit(0))), F.trim(F.get(parts, F.lit(1)))
