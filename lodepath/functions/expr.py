"""Column expressions whose meaning must not depend on Spark's defaults."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Dates that both a lenient and a strict engine read alike.
DATE_SHAPE = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}.*)?$"


def active(c: str = "is_expired") -> Column:
    """Not expired; null counts as active. Reaches the scan as Not(EqualNullSafe(c, true))."""
    return ~F.col(c).eqNullSafe(True)


def trim_zs(c: Column) -> Column:
    """Trim what Unicode calls space separators; tabs, line ends and zero-width characters stay."""
    return F.regexp_replace(c, r"^\p{Zs}+|\p{Zs}+$", "")


def label(c: Column) -> Column:
    """Trimmed text, null if nothing is left."""
    return F.nullif(trim_zs(c), F.lit(""))


def number_text(c: Column) -> Column:
    """A double as 10000000.0 and 1e-05, not 1.0E7 and 1.0E-5: positional from 1e-4 to below 1e16."""
    plain = c.cast("string")
    wide = F.regexp_replace(plain.cast("decimal(38,20)").cast("string"), r"0+$", "")
    wide = F.when(wide.endswith("."), F.concat(wide, F.lit("0"))).otherwise(wide)
    mantissa = F.regexp_replace(F.regexp_extract(plain, r"^(-?[\d.]+)E", 1), r"\.0$", "")
    power = F.regexp_extract(plain, r"E(-?\d+)$", 1).cast("int")
    sign = F.when(power < 0, F.lit("e-")).otherwise(F.lit("e+"))
    scientific = F.concat(mantissa, sign, F.lpad(F.abs(power).cast("string"), 2, "0"))
    size = F.abs(c)
    odd = F.isnan(c) | (size == F.lit(float("inf")))
    return F.when(odd, F.lower(F.regexp_replace(plain, "Infinity", "inf"))).when((size == 0) | ((size >= 1e-4) & (size < 1e16)), wide).otherwise(scientific)


def as_text(c: Column, kind: str) -> Column:
    return number_text(c) if kind in ("double", "float") else c.cast("string")


def filled(c: Column, kind: str = "string") -> Column:
    """The value as text, null where it is empty or an empty array. Blanks count as filled."""
    return F.nullif(F.nullif(as_text(c, kind), F.lit("")), F.lit("[]"))


def wall_clock(c: Column) -> Column:
    """A date text as a timestamp without zone: its own wall clock; null if it is no date."""
    return F.when(c.rlike(DATE_SHAPE), c).try_cast("timestamp_ntz")


def instant(c: Column) -> Column:
    """A date text as an instant; null if it is no date. The session's zone must be UTC."""
    return F.when(c.rlike(DATE_SHAPE), c).try_cast("timestamp")


def mentions(c: Column) -> Column:
    """A JSON array's elements as texts; null elements stay; null, empty text and what is no JSON array give none.

    from_json() alone also takes single quotes and the like, so the text is tested by the strict parser first.
    """
    strict = F.try_variant_get(F.try_parse_json(c), "$", "array<string>").isNotNull()
    return F.from_json(F.when(strict, c), "array<string>")


def contains_text(columns: list[str], needle: str) -> Column:
    """Whether any column contains the needle as it is, whatever the case; no wildcards."""
    out = F.lit(False)
    for c in columns:
        out = out | F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lower(F.lit(needle)))
    return out
