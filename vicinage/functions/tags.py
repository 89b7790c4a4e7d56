"""Height and level tags to numbers with provenance, each as one regular expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

METRES_PER_FOOT = 0.3048
METRES_PER_LEVEL = 3.5
HIGHEST = 1000.0
NUMBER = r"[+-]?(?:[0-9]+[.]?[0-9]*|[.][0-9]+)(?:e[+-]?[0-9]+)?"
HEIGHT = rf"^[ ]*({NUMBER})[ ]*([ft]*'+|[ft]*ft)?[ ]*(m| meters| metres)?[ ]*$"
LEVELS = rf"^[ ]*({NUMBER})[ ]*$"


def height_m(tag: Column) -> Column:
    """Metres of a height tag, feet converted; NULL unless it parses to a value in (0, 1000]."""
    t = F.lower(tag)
    value = F.nullif(F.regexp_extract(t, HEIGHT, 1), F.lit("")).try_cast("double")
    value = value * F.when(F.regexp_extract(t, HEIGHT, 2) != "", F.lit(METRES_PER_FOOT)).otherwise(F.lit(1.0))
    return F.when((value > 0) & (value <= HIGHEST), value)


def levels(tag: Column) -> Column:
    """Whole levels, halves to even; NULL if it isn't a number that fits an int."""
    value = F.nullif(F.regexp_extract(F.lower(tag), LEVELS, 1), F.lit("")).try_cast("double")
    return F.bround(value, 0).try_cast("int")


def height_with_source(height_tag: Column, levels_tag: Column) -> tuple[Column, Column]:
    """(metres, provenance): the tag if it parses, else levels above zero, else nothing."""
    tagged, storeys = height_m(height_tag), levels(levels_tag)
    by_levels = F.when(storeys > 0, storeys * METRES_PER_LEVEL)
    source = F.when(tagged.isNotNull(), F.lit("tag")).when(by_levels.isNotNull(), F.lit("levels")).otherwise(F.lit("none"))
    return F.coalesce(tagged, by_levels), source
