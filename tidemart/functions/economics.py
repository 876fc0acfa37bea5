"""The one implementation of line economics, shared by batch and stream.

For a line of an order:
  gross_revenue      = quantity * unit_price
  allocated_discount = round(discount * gross_revenue / subtotal), HALF_UP,
                       0 when the subtotal is not positive or unknown
  net_revenue        = gross_revenue - allocated_discount (exact)
  total_cost         = unit_cost * quantity
  gross_profit       = net_revenue - total_cost
  gross_margin_pct   = round(gross_profit / net_revenue * 100, 2), null at 0
All money is LONG (SURVEY Q1, Q10, Q11). discount * gross_revenue can pass a
LONG; then the division is done in DECIMAL(38,0), with the same result.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .money import col_, muldiv_half_up, pct_half_up


def gross_revenue(quantity, unit_price) -> Column:
    return col_(quantity).cast("long") * col_(unit_price).cast("long")


def allocated_discount(discount, gross, subtotal) -> Column:
    d, g, s = col_(discount).cast("long"), col_(gross).cast("long"), col_(subtotal).cast("long")
    some = (s > 0) & d.isNotNull() & g.isNotNull()
    return F.when(some, muldiv_half_up(d, g, s)).otherwise(F.when(g.isNotNull(), F.lit(0).cast("long")))


def line_economics(quantity, unit_price, unit_cost, discount, subtotal) -> dict[str, Column]:
    """Named columns in dependency order; use with ``withColumns``."""
    return {
        "gross_revenue": gross_revenue(quantity, unit_price),
        "allocated_discount": allocated_discount(discount, F.col("gross_revenue"), subtotal),
        "total_cost": col_(unit_cost).cast("long") * col_(quantity).cast("long"),
        **after_discount(),
    }


def after_discount() -> dict[str, Column]:
    """What follows from gross_revenue, allocated_discount and total_cost."""
    net = F.col("gross_revenue") - F.col("allocated_discount")
    return {"net_revenue": net, "gross_profit": net - F.col("total_cost"), "gross_margin_pct": pct_half_up(net - F.col("total_cost"), net)}


def unit_margin_pct(unit_price, unit_cost) -> Column:
    """round((price - cost) / price * 100, 2), null when price is 0."""
    return pct_half_up(col_(unit_price).cast("long") - col_(unit_cost).cast("long"), unit_price)


def shipping_fee(subtotal, free_from: int, fee: int) -> Column:
    return F.when(col_(subtotal) < free_from, F.lit(fee).cast("long")).otherwise(F.lit(0).cast("long"))


def percent_discount(subtotal, percent) -> Column:
    """int(subtotal * pct / 100): truncating, as the storefront does; the
    percent is DECIMAL(5,2) so the product is exact."""
    return F.floor(col_(subtotal).cast("decimal(20,0)") * col_(percent).cast("decimal(5,2)") / 100).cast("long")
