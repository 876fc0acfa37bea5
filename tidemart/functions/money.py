"""Exact money and percentage arithmetic as Column expressions.

Money is LONG in minor units (VND has none), so every rounding step is an
integer expression with HALF_UP semantics: no double rounding and no
overflow of 32-bit products (the reference multiplies INT by INT, which
overflows past 2^31 and raises under ANSI mode).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def idiv(a, b) -> Column:
    """SQL integral division ``a div b`` (truncates toward zero)."""
    return F.call_function("div", col_(a), col_(b) if not isinstance(b, int) else F.lit(b))


def div_half_up(num, den) -> Column:
    """round(num / den) HALF_UP (away from zero), exact on LONGs; null when
    den is 0 or either side is null."""
    n, d = col_(num).cast("long"), col_(den).cast("long")
    sign = F.signum(n).cast("long") * F.signum(d).cast("long")
    mag = idiv(F.abs(n) * 2 + F.abs(d), F.abs(d) * 2)
    return F.when(d != 0, sign * mag)


#: factors below this have a doubled product that fits a LONG
SAFE_FACTOR = 1 << 30


def muldiv_half_up(a, b, den) -> Column:
    """round(a * b / den) HALF_UP for LONGs of any size, den > 0: in LONG
    where the product fits, else in DECIMAL(38,0)."""
    a, b, d = (col_(x).cast("long") for x in (a, b, den))
    small = (F.abs(a) < SAFE_FACTOR) & (F.abs(b) < SAFE_FACTOR) & (d < SAFE_FACTOR * SAFE_FACTOR)
    x, y, z = (v.cast("decimal(19,0)") for v in (a, b, d))
    product = (x * y).cast("decimal(38,0)")
    mag = idiv(F.abs(product), z)
    rest = F.abs(product) - mag.cast("decimal(19,0)") * z
    sign = F.signum(a).cast("long") * F.signum(b).cast("long")
    wide = sign * (mag + F.when(rest * 2 >= z, F.lit(1).cast("long")).otherwise(F.lit(0).cast("long")))
    return F.when(small, div_half_up(a * b, d)).otherwise(wide)


def pct_half_up(num, den, scale: int = 2) -> Column:
    """round(num / den * 100, scale) HALF_UP as a DOUBLE, computed exactly in
    integers; null when den is 0. Amounts whose scaled product passes a LONG
    are divided in DECIMAL(38,0); a quotient that would pass one (far beyond
    what a DOUBLE holds exactly) is divided as a DOUBLE."""
    units = 10 ** scale
    k = 100 * units
    n, d = col_(num).cast("long"), col_(den).cast("long")
    small = (F.abs(n) < (1 << 61) // k) & (F.abs(d) < 1 << 61)
    x, y = n.cast("decimal(19,0)"), d.cast("decimal(19,0)")
    product = (F.abs(x) * F.lit(k).cast("decimal(10,0)")).cast("decimal(38,0)")
    mag = idiv(product, F.abs(y))
    rest = product - mag.cast("decimal(19,0)") * F.abs(y)
    sign = (F.signum(x) * F.signum(y)).cast("long")
    wide = sign * (mag + F.when(rest * 2 >= F.abs(y), F.lit(1).cast("long")).otherwise(F.lit(0).cast("long")))
    fits = F.abs(n.cast("double") / d.cast("double")) < float((1 << 62) // k)
    exact = F.when(small, div_half_up(n * k, d)).when(fits, wide)
    return F.when(d != 0, F.coalesce(exact / F.lit(float(units)), n.cast("double") / d.cast("double") * 100))


def pct_units(pct, scale: int = 2) -> Column:
    """The exact integer behind a ``pct_half_up`` value (basis points for 2)."""
    return F.round(col_(pct) * (10 ** scale)).cast("long")


def avg_pct(pct, scale: int = 2) -> Column:
    """Mean of a ``pct_half_up`` column without summation-order drift: the
    integers are summed exactly, then divided once."""
    return F.try_divide(F.sum(pct_units(pct, scale)), F.count(col_(pct))) / F.lit(float(10 ** scale))


def cents(x) -> Column:
    """A 2-decimal DOUBLE amount as LONG minor units."""
    return F.round(col_(x) * 100).cast("long")
