"""Quantities in different units to pixels (problem 3), in Spark SQL expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import set_aside

# Unit, the kind it belongs to, factor and offset to the kind's base (px, um or share of the frame), aliases.
UNITS = [
    ("px", "pixel", 1.0, 0.0, ["px", "pix", "pixel", "pixels"]),
    ("um", "length", 1.0, 0.0, ["um", "µm", "μm", "micron", "microns", "micrometre", "micrometres", "micrometer", "micrometers"]),
    ("nm", "length", 0.001, 0.0, ["nm", "nanometre", "nanometer"]),
    ("mm", "length", 1000.0, 0.0, ["mm", "millimetre", "millimetres", "millimeter", "millimeters"]),
    ("cm", "length", 10000.0, 0.0, ["cm", "centimetre", "centimetres", "centimeter", "centimeters"]),
    ("m", "length", 1000000.0, 0.0, ["m", "metre", "metres", "meter", "meters"]),
    ("in", "length", 25400.0, 0.0, ["in", "inch", "inches", '"', "″", "”"]),
    ("mil", "length", 25.4, 0.0, ["mil", "mils", "thou"]),
    ("percent", "share", 0.01, 0.0, ["%", "％", "pct", "percent"]),
    ("fraction", "share", 1.0, 0.0, ["fraction", "ratio", "rel"]),
]

_SPACES = "\\s\u00a0\u2007\u2009\u202f"
_NUMBER = rf"([+\-−]?[0-9](?:[0-9.,'’{_SPACES}]*[0-9])?(?:[eE][+\-]?[0-9]+)?)"


def unit_table(spark) -> DataFrame:
    """alias, unit, kind, factor, offset: a fixed table of fewer than 50 rows."""
    rows = [(alias, unit, kind, factor, offset) for unit, kind, factor, offset, aliases in UNITS for alias in aliases]
    return spark.createDataFrame(rows, "alias string, unit string, kind string, factor double, offset double")


def number_of(text: Column, decimal_mark: Column) -> Column:
    """The first number in ``text``; signs other than ``decimal_mark`` group thousands. Null if there is none."""
    raw = F.regexp_replace(F.regexp_extract(text, _NUMBER, 1), "−", "-")
    comma = F.regexp_replace(F.regexp_replace(raw, rf"[.'’{_SPACES}]", ""), ",", ".")
    point = F.regexp_replace(raw, rf"[,'’{_SPACES}]", "")
    return F.when(decimal_mark == ",", comma).otherwise(point).try_cast("double")


def unit_text_of(text: Column) -> Column:
    """What follows the number, in lower case and without spaces at its ends; '' if nothing does."""
    rest = F.regexp_extract(text, rf"{_NUMBER}(.*)$", 2)
    return F.lower(F.regexp_replace(rest, rf"^[{_SPACES}]+|[{_SPACES}.]+$", ""))


def normalise_quantities(df: DataFrame, text: str, unit_field: str, default_unit: str, decimal_mark: str, um_per_px: str, frame: str) -> DataFrame:
    """``df`` with ``number``, ``unit``, ``value_px`` (double) and ``unit_status``.

    The unit is the one in the text, else in ``unit_field``, else
    ``default_unit`` (all names of columns). ``unit_status`` is ``ok``,
    ``no_number`` (null, blank or wordy texts), ``unknown_unit`` or
    ``no_scale`` (the scale that the unit needs is null or zero); only ``ok``
    rows have ``value_px``. The alias table is fixed and is broadcast. Columns
    of ``df`` that clash with the new ones get ``_in`` after their name.
    """
    df, name = set_aside(df, ["number", "unit", "value_px", "unit_status"])
    text, unit_field, default_unit, decimal_mark, um_per_px, frame = map(name, (text, unit_field, default_unit, decimal_mark, um_per_px, frame))
    aliases = F.broadcast(unit_table(df.sparkSession).select(F.col("alias").alias("__alias"), F.col("unit").alias("unit"), F.col("kind").alias("__kind"), F.col("factor").alias("__factor"), F.col("offset").alias("__offset")))
    blank = lambda c: F.when(F.trim(c) != "", F.lower(F.trim(c)))
    own = F.when(unit_text_of(F.col(text)) != "", unit_text_of(F.col(text)))
    named = df.withColumn("number", number_of(F.col(text), F.col(decimal_mark))).withColumn("__alias", F.coalesce(own, blank(F.col(unit_field)), blank(F.col(default_unit))))
    joined = named.join(aliases, "__alias", "left")
    base = F.col("number") * F.col("__factor") + F.col("__offset")
    per_px = F.when(F.col(um_per_px) > 0, F.col(um_per_px))
    px = F.when(F.col("__kind") == "pixel", base).when(F.col("__kind") == "length", base / per_px).when(F.col("__kind") == "share", base * F.col(frame))
    status = F.when(F.col("number").isNull(), "no_number").when(F.col("unit").isNull(), "unknown_unit").when(px.isNull(), "no_scale").otherwise("ok")
    return joined.select(*df.columns, "number", "unit", px.alias("value_px"), status.alias("unit_status"))
