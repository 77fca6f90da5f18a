"""Column expressions: dates, cyclic encoding, normalising transforms, labels."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_date(c: Column, fmt: str = "yyyy-MM-dd") -> Column:
    return F.to_date(c, fmt)


def season(date: Column) -> Column:
    """Dec-Feb = 1, Mar-May = 2, Jun-Aug = 3, Sep-Nov = 4."""
    return (F.floor((F.month(date) % 12) / 3) + 1).cast("int")


def date_parts(date: Column) -> dict[str, Column]:
    return {
        "year": F.year(date),
        "month": F.month(date),
        "day": F.dayofmonth(date),
        "day_of_year": F.dayofyear(date),
        "quarter": F.quarter(date),
        "season": season(date),
    }


def cyclic(name: str, c: Column, period: int) -> dict[str, Column]:
    """Two columns that place a periodic number on the unit circle."""
    angle = 2 * math.pi * c / period
    return {f"{name}_sin": F.sin(angle), f"{name}_cos": F.cos(angle)}


def days_before(date: Column, days: int) -> Column:
    return F.date_sub(date, days)


def skew_candidates(x: Column) -> dict[str, Column]:
    """Transforms that may make a column look normal; null outside their domain."""
    return {
        "raw": x,
        "log": F.when(x > 0, F.ln(x)),
        "reciprocal": F.try_divide(F.lit(1.0), x),
        "sqroot": F.when(x >= 0, F.sqrt(x)),
        "exponential": F.when(x >= 0, F.pow(x, F.lit(1 / 1.2))),
    }


def sqrt_abs(x: Column) -> Column:
    return F.sqrt(F.abs(x))


def reciprocal(x: Column) -> Column:
    """1/x, null at zero."""
    return F.try_divide(F.lit(1.0), x)


def log_positive(x: Column) -> Column:
    return F.when(x > 0, F.ln(x))


def box_cox(x: Column, exponent: float) -> Column:
    """(x**e - 1) / e, or ln x at e = 0; null for x <= 0."""
    value = F.ln(x) if exponent == 0 else (F.pow(x, F.lit(float(exponent))) - 1) / exponent
    return F.when(x > 0, value)


def round_half_even(x: Column, digits: int = 0) -> Column:
    return F.bround(x, digits)


def truncate(x: Column) -> Column:
    """Whole part, towards zero."""
    return x.cast("int")


def log_grid(start: float, stop: float, n: int) -> list[float]:
    """`n` values from 10**start to 10**stop, evenly spaced in the exponent."""
    if n == 1:
        return [10.0**start]
    return [10.0 ** (start + (stop - start) * i / (n - 1)) for i in range(n)]


def recode(c: Column, mapping: dict, otherwise=None) -> Column:
    """Dictionary recode; values without an entry become null, or `otherwise`."""
    pairs = [F.lit(v) for kv in mapping.items() for v in kv]
    hit = F.create_map(*pairs)[c]
    return hit if otherwise is None else F.coalesce(hit, F.lit(otherwise))


def yes_no(c: Column) -> Column:
    return F.when(c == 0, "No").when(c == 1, "Yes").otherwise("No response")


def indicator(c: Column, value) -> Column:
    """1 where the column equals the value, else 0; null counts as 0."""
    return F.when(c == value, 1).otherwise(0)


def clip_upper(c: Column, cut) -> Column:
    """The smaller of value and cut; null becomes the cut."""
    return F.least(c, F.lit(cut))


def below(c: Column, threshold) -> Column:
    return F.when(c < threshold, 1).otherwise(0)


def keep_or(c: Column, keep: list, other: str = "o") -> Column:
    return F.when(c.isin(*keep), c).otherwise(other)


def kelvin(c: Column) -> Column:
    return c + 273.15


def replace_sentinel(c: Column, sentinel, value: Column | None = None) -> Column:
    """Sentinel to null, or to the given column."""
    return F.when(c == sentinel, value).otherwise(c)


# Coefficients of Wichura's algorithm AS 241 (PPND16), Applied Statistics 37 (1988),
# lowest power first; numerator and denominator of each of its three ranges.
AS241_CENTRE_NUM = [
    3.3871328727963666080, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4,
    4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3,
]
AS241_CENTRE_DEN = [
    1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3,
    2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3,
]
AS241_MIDDLE_NUM = [
    1.42343711074968357734, 4.63033784615654529590, 5.76949722146069140550, 3.64784832476320460504,
    1.27045825245236838258, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4,
]
AS241_MIDDLE_DEN = [
    1.0, 2.05319162663775882187, 1.67638483018380384940, 6.89767334985100004550e-1,
    1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9,
]
AS241_TAIL_NUM = [
    6.65790464350110377720, 5.46378491116411436990, 1.78482653991729133580, 2.96560571828504891230e-1,
    2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7,
]
AS241_TAIL_DEN = [
    1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2,
    7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15,
]


def _polynomial(x: Column, coefficients: list[float]) -> Column:
    total = F.lit(coefficients[-1])
    for c in reversed(coefficients[:-1]):
        total = total * x + F.lit(c)
    return total


def inverse_normal(p: Column) -> Column:
    """Standard normal quantile of a probability strictly between 0 and 1."""
    q = p - 0.5
    centre_r = 0.180625 - q * q
    tail = F.sqrt(-F.ln(F.least(p, 1 - p)))
    near, far = tail - 1.6, tail - 5.0
    centre = q * _polynomial(centre_r, AS241_CENTRE_NUM) / _polynomial(centre_r, AS241_CENTRE_DEN)
    middle = _polynomial(near, AS241_MIDDLE_NUM) / _polynomial(near, AS241_MIDDLE_DEN)
    outer = _polynomial(far, AS241_TAIL_NUM) / _polynomial(far, AS241_TAIL_DEN)
    size = F.when(tail <= 5.0, middle).otherwise(outer)
    return F.when(F.abs(q) <= 0.425, centre).otherwise(F.when(q < 0, -size).otherwise(size))
