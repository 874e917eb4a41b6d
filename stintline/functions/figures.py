"""Statistics and comparisons with the exact definitions the figures use.

Three different medians are in use, and they are not interchangeable:

* ``true_median``   - mean of the two middle values (Spark ``median``);
* ``upper_median``  - ``sorted[n // 2]``;
* ``nearest_rank``  - ``sorted[min(n - 1, floor(p * n))]``.

All three are exact aggregates with a map-side combine: each task sends one
``value -> count`` map per group. They are for groups of bounded size (a lap, a
stint, the field of one lap); groups that grow with the data take ``ranks.ranked``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# percentile_disc(p) picks index ceil(p*n)-1. The nudge turns that into
# floor(p*n) when p*n is whole, and changes nothing otherwise (n < 5e7).
_NUDGE = 1e-9


def nearest_rank(value: str, p: float) -> Column:
    """``sorted[min(n - 1, floor(p * n))]`` of a column or SQL expression."""
    return F.expr(f"percentile_disc({p + _NUDGE:.12f}D) WITHIN GROUP (ORDER BY {value})")


def nearest_rank_of(values: Column, p: float) -> Column:
    """The same of an array without nulls; null if it is empty."""
    at = F.least(F.size(values) - 1, F.ceil((p + _NUDGE) * F.size(values)) - 1).cast("int")
    return F.when(at >= 0, F.get(F.sort_array(values), at))


def upper_median(value: str) -> Column:
    return nearest_rank(value, 0.5)


def true_median(value) -> Column:
    return F.median(value)


def rounded(c, digits: int = 6) -> Column:
    """Round, without ever returning a negative zero."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.abs(c) < 0.5 * 10.0**-digits, F.lit(0.0)).otherwise(F.round(c, digits))


def same_number(a, b, tolerance: float = 1e-9) -> Column:
    """Null equals only null; otherwise equal within the tolerance."""
    a, b = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    return F.coalesce(F.abs(a - b) <= tolerance, a.isNull() & b.isNull())


def lap_time_seconds(text) -> Column:
    """``'1:32.264'`` -> 92.264, plain seconds as they are, anything else null."""
    t = F.col(text) if isinstance(text, str) else text
    t = F.trim(t)
    minutes = F.try_to_number(F.regexp_extract(t, r"^(\d{1,6}):", 1), F.lit("999999"))
    seconds = F.regexp_extract(t, r"^\d{1,6}:(.+)$", 1)
    return F.when(
        t.rlike(r"^\d{1,6}:"), minutes.cast("double") * 60 + seconds.try_cast("double")
    ).otherwise(t.try_cast("double"))


def classified(status) -> Column:
    """Finished, Lapped or ``+N Lap(s)``."""
    s = F.col(status) if isinstance(status, str) else status
    return F.coalesce(s.isin("Finished", "Lapped") | s.rlike(r"^\+\S.* Laps?\.*$"), F.lit(False))


def classified_text(position_text) -> Column:
    """A position number marks a classified car, a letter code does not."""
    return F.coalesce(F.col(position_text).rlike(r"^\d+$"), F.lit(False))


def started_text(position_text) -> Column:
    return ~F.coalesce(F.col(position_text), F.lit("")).isin("W", "F")


def band(value, edges) -> Column:
    """How many of the ascending edges the magnitude reaches; 0 for no value."""
    v = F.abs(F.col(value) if isinstance(value, str) else value)
    return sum((F.when(v >= e, 1).otherwise(0) for e in edges), F.lit(0))


def parabola(n: Column, u2: Column, u3: Column, u4: Column, uv: Column, u2v: Column) -> tuple[Column, Column, Column]:
    """Bend and slope of v on u by least squares from moments about both means, and the determinant they share."""
    spread = u4 - u2 * u2 / n
    det = u2 * spread - u3 * u3
    return F.try_divide(u2v * u2 - uv * u3, det), F.try_divide(uv * spread - u2v * u3, det), det


def half_up(c) -> Column:
    """Round half towards +infinity, to a whole number."""
    return F.floor(c + 0.5)
