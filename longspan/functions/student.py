"""Student-t tail and quantile for whole degrees of freedom.

For a whole number of degrees of freedom the two-sided tail is a finite trigonometric sum, so both
are plain SQL expressions and need no numeric library. Arguments are SQL texts, such as names.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _tail(angle: str, df: str) -> str:
    """P(|T| > t) with angle = atan(t / sqrt(df)), t >= 0."""
    even = f"{df} % 2 = 0"
    terms = f"cast(if({even}, {df} div 2, ({df} - 1) div 2) as int)"
    series = f"""aggregate(
        if({terms} > 0, sequence(1, {terms}), cast(array() as array<int>)),
        named_struct('total', 0D, 'term', if({even}, 1D, cos({angle}))),
        (acc, k) -> named_struct(
          'total', acc.total + acc.term,
          'term', acc.term * if({even}, 2 * k - 1, 2 * k) / if({even}, 2 * k, 2 * k + 1)
                  * cos({angle}) * cos({angle})),
        acc -> acc.total)"""
    return f"""greatest(0D, 1 - if({even}, sin({angle}) * {series},
        ({angle} + sin({angle}) * {series}) * 2 / pi()))"""


def two_sided_p(t: str, df: str) -> Column:
    """P(|T| > |t|) with `df` whole degrees of freedom, null when either is null or df < 1."""
    # A one-element array names the angle, so that its formula is not repeated in the text.
    angles = f"array(atan(abs({t}) / sqrt(cast({df} as double))))"
    return F.expr(
        f"case when ({df}) >= 1 and ({t}) is not null"
        f" then transform({angles}, a -> {_tail('a', f'({df})')})[0] end"
    )


def critical_value(alpha: float, df: str) -> Column:
    """t whose two-sided tail is `alpha`, by halving the range of the angle sixty times."""
    beyond = f"{_tail('ends.middle', f'({df})')} > {alpha!r}D"
    return F.expr(
        f"""case when ({df}) >= 1 then sqrt(cast({df} as double)) * tan(aggregate(
          sequence(1, 60),
          named_struct('low', 0D, 'middle', pi() / 4, 'high', pi() / 2),
          (ends, _step) -> if({beyond},
            named_struct('low', ends.middle, 'middle', (ends.middle + ends.high) / 2,
                         'high', ends.high),
            named_struct('low', ends.low, 'middle', (ends.low + ends.middle) / 2,
                         'high', ends.middle)),
          ends -> ends.middle)) end"""
    )
