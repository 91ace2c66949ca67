"""Column helpers that fix the null, rounding and date rules of the analyses.

The analyses come from a statistics language whose rules differ from SQL's in small ways
(set membership never yields null, minimum of a null is null, half rounds to even, month
steps overflow). Each helper states one such rule as a Spark expression.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, functions as F

DAYS_PER_YEAR = 365.25


def in_set(col: Column, values: Iterable) -> Column:
    """Membership that is false, never null, for a null input."""
    return F.coalesce(col.isin(list(values)), F.lit(False))


def not_in_set(col: Column, values: Iterable) -> Column:
    """Complement of `in_set`: keeps null rows."""
    return ~in_set(col, values)


def flag(condition: Column) -> Column:
    """1 / 0 / null for a three-valued condition."""
    return F.when(condition, F.lit(1)).when(~condition, F.lit(0))


def lower_of(value: Column, bound: float) -> Column:
    """Smaller of value and bound; null when the value is null."""
    return F.when(value.isNotNull(), F.least(value, F.lit(float(bound))))


def higher_of(value: Column, bound: float) -> Column:
    """Larger of value and bound; null when the value is null."""
    return F.when(value.isNotNull(), F.greatest(value, F.lit(float(bound))))


def month_step(day: Column, months: Column) -> Column:
    """Date some months on; a day past the month's end runs into the next month."""
    return F.date_add(F.add_months(F.trunc(day, "MM"), months), F.dayofmonth(day) - 1)


def date_of(year: Column, month: Column, day: Column) -> Column:
    """Date from parts, null where a part is null or the date does not exist."""
    zero = F.lit(0)
    return F.try_make_timestamp(
        year.cast("int"), month.cast("int"), day.cast("int"), zero, zero, zero
    ).cast("date")


def parse_date(text: Column, *formats: str) -> Column:
    """First format that parses, else null."""
    return F.coalesce(*[F.try_to_date(text, fmt) for fmt in formats])


def parse_id(text: Column) -> Column:
    """Integer id, null for text that is not a number."""
    return text.try_cast("bigint")


def years_between(later: Column, earlier: Column) -> Column:
    return F.datediff(later, earlier) / F.lit(DAYS_PER_YEAR)


def day_number(day: Column) -> Column:
    """Whole days since 2000-01-01."""
    return F.datediff(day, F.lit("2000-01-01").cast("date"))


def recode(col: Column, levels: Mapping[str, Iterable[str]], keep_rest: bool = True) -> Column:
    """Map listed values to a canonical level; other values stay as they are."""
    out = None
    for level, values in levels.items():
        hit = in_set(col, values)
        out = F.when(hit, F.lit(level)) if out is None else out.when(hit, F.lit(level))
    if out is None:
        return col
    return out.otherwise(col) if keep_rest else out


def fill_unknown(col: Column, substitute: Column, unknown: Iterable[str]) -> Column:
    """Take the second source where the first is null or an unknown marker."""
    return F.when(col.isNull() | in_set(col, unknown), substitute).otherwise(col)


def namespace(code: Column) -> Column:
    """Part of a code before the first colon."""
    return F.split_part(code, F.lit(":"), F.lit(1))


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays of doubles."""
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0),
        lambda acc, x: acc + x,
    )


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; null when either has no length."""
    size = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(size > 0, dot(a, b) / size)
