"""Operator name -> (Spark query, DuckDB oracle SQL).

Every entry reads the given test tables (through the adapters) so its work
grows with them. Clock columns (``quarantined_at``, ``dw_*``) are not part
of query outputs; ``as_of`` is fixed (SURVEY Q9).
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession

from .lake import Lake
from .oracle import sql as O

QueryFn = Callable[[SparkSession, str], DataFrame]

_LAKES: dict[tuple, Lake] = {}
STORED: dict[str, str] = {}   # sf_dir -> root of a stored batch run


def lake(spark: SparkSession, sf_dir: str) -> Lake:
    """The Lake of a data folder: built from the sources, or the layers a
    batch run stored (``use_stored``), which is how the dashboard reads."""
    key = (id(spark), sf_dir, STORED.get(sf_dir))
    if key not in _LAKES:
        _LAKES.clear()
        root = STORED.get(sf_dir)
        _LAKES[key] = Lake.from_stored(spark, root) if root else Lake(spark, sf_dir)
        _LAKES[key].src = Lake(spark, sf_dir).src
    return _LAKES[key]


def use_stored(sf_dir: str, root: str | None) -> None:
    if root is None:
        STORED.pop(sf_dir, None)
    else:
        STORED[sf_dir] = root


QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


def _table_query(name: str, getter, oracle_table: str | None):
    register(name, O.table(oracle_table) if oracle_table else None)(
        lambda spark, sf_dir: getter(lake(spark, sf_dir)))


# ------------------------------------------------------------ silver layer
for _e in ["users", "products", "inventory", "promotions", "orders", "order_items", "inventory_logs", "reviews"]:
    _table_query(f"silver_{_e}", (lambda e: lambda lk: lk.silver(e))(_e), f"s_{_e}")
for _e in ["users", "products", "promotions", "orders", "order_items", "inventory_logs", "reviews"]:
    _table_query(f"quarantine_{_e}", (lambda e: lambda lk: lk.quarantine(e))(_e), f"q_{_e}")

# -------------------------------------------------------------- gold layer
for _t in ["dim_date", "dim_users", "dim_products", "dim_promotions", "dim_payment_method",
           "dim_order_status", "fact_orders", "fact_order_items", "fact_sales", "fact_inventory_log",
           "fact_reviews", "fact_user_events", "fact_page_views", "fact_cart_events", "fact_promo_events",
           "fact_orders_stream", "fact_order_items_stream", "fact_sales_stream", "fact_inventory_events",
           "fact_review_events"]:
    _table_query(_t, (lambda t: lambda lk: lk.table(t))(_t), _t)


def _all_quarantine(lk: Lake) -> DataFrame:
    from .schemas import ALL_TOPICS
    out = None
    for t in ALL_TOPICS:
        q = lk.topic(t).quarantine.drop("json_str")
        out = q if out is None else out.unionByName(q)
    return out


_table_query("stream_quarantine", _all_quarantine, "quarantine_events")


def load_marts():
    """Import the query modules so they register themselves."""
    from .plans import (advisor, autoregression, commerce_ops, exact_split, forecasting, heavy, live,  # noqa: F401
                        rollups, sales, search, wiring)
