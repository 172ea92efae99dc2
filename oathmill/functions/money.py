"""Money and counts out of text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Larger rupee values are plot or account numbers that strayed into a money cell.
MOST_RUPEES = 10_000_000_000_000
#: What \s stands for in a pattern.
WHITE = " \t\n\x0b\f\r"


def parse_inr(text: Column) -> Column:
    """Digits before the first tilde as rupees; 0 without any."""
    digits = F.regexp_replace(F.split_part(text, F.lit("~"), F.lit(1)), r"\D", "")
    return F.coalesce(F.nullif(digits, F.lit("")).try_cast("long"), F.lit(0).cast("long"))


def parse_cases(text: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(text, r"(\d+)", 1), F.lit("")).try_cast("int"), F.lit(0))


def candidate_id(href: Column) -> Column:
    return F.nullif(F.regexp_extract(href, r"candidate_id=(\d+)", 1), F.lit("")).try_cast("int")


def indian_int(text: Column) -> Column:
    """Digits and points of a number, truncated; null where they form none."""
    return F.regexp_replace(text, r"[^\d.]", "").try_cast("double").try_cast("long")


def spaced_number(raw: Column) -> Column:
    return F.trim(F.translate(F.coalesce(raw, F.lit("")), WHITE, ""), F.lit(" ,."))


def safe_inr(value: Column) -> Column:
    return F.when(value.between(0, MOST_RUPEES), value)


def pick_value(cells: Column) -> Column:
    """The largest sensible amount in cells: after "Rs", or a cell of digits alone."""
    def amounts(c: Column) -> Column:
        marked = F.regexp_extract_all(c, F.lit(r"(?i)Rs\.?\s*([\d,]+)"), F.lit(1))
        bare = F.when(F.trim(c).rlike(r"^[\d,\s]+$"), F.array(F.trim(c))).otherwise(F.array().cast("array<string>"))
        return F.when(F.size(marked) > 0, marked).otherwise(bare)

    values = F.transform(F.flatten(F.transform(cells, amounts)), lambda v: F.regexp_replace(v, r"[,\s]", "").try_cast("long"))
    return F.coalesce(F.array_max(F.filter(values, lambda v: v <= MOST_RUPEES)), F.lit(0).cast("long"))


def crore(value: Column) -> Column:
    return F.coalesce(value, F.lit(0)) / F.lit(10_000_000.0)


def crore_label(value: Column) -> Column:
    return F.format_number(crore(value), 2)
