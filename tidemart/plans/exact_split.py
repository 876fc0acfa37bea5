"""Sales facts whose line discounts add up to the order's:
the facts of batch and stream with the discount split by largest remainders."""

from __future__ import annotations

from ..operators import gold as G
from ..operators import stream_topics as ST
from ..oracle.sql import pct_sql, with_more
from ..registry import lake, register
from ..schemas import TOPIC_ORDER


def _split_sql(source: str, key: str, discount: str, tie: str) -> str:
    """``source`` (gross_revenue and a discount per line) with exact parts."""
    return f"""
weights AS (SELECT *, CAST(coalesce({discount}, 0) AS HUGEINT) AS whole, sum(gross_revenue) OVER (PARTITION BY {key}) AS weight FROM {source}),
shares AS (SELECT *, CASE WHEN weight > 0 THEN whole * gross_revenue // weight ELSE 0 END AS share, CASE WHEN weight > 0 THEN whole * gross_revenue % weight ELSE 0 END AS over FROM weights),
ranked AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY over DESC, {tie}) AS place, CASE WHEN weight > 0 THEN whole - sum(share) OVER (PARTITION BY {key}) ELSE 0 END AS units FROM shares),
exact AS (SELECT * REPLACE (CAST(share + CASE WHEN place <= units THEN 1 ELSE 0 END AS BIGINT) AS allocated_discount) FROM ranked)"""


def _after(cost: str) -> str:
    net = "gross_revenue - allocated_discount"
    return f"allocated_discount, {net} AS net_revenue, {cost} AS total_cost, {net} - {cost} AS gross_profit, {pct_sql(f'{net} - {cost}', net)} AS gross_margin_pct"


register("fact_sales_exact_split", with_more(_split_sql("fs_base", "order_id", "discount_amount", "item_id"), f"""
SELECT item_id, order_id, user_id, product_id, promo_id, payment_method, order_status, CAST(order_date AS DATE) AS date_key,
       product_name, brand, category, quantity, unit_price, gross_revenue, unit_cost, {_after('unit_cost * quantity')},
       subtotal AS order_subtotal, shipping_fee, discount_amount AS order_discount_amount, total_amount AS order_total_amount,
       order_date AS order_created_at, updated_at AS order_updated_at FROM exact"""))(
    lambda spark, d: G.fact_sales(lake(spark, d).silver("order_items"), lake(spark, d).silver("orders"), lake(spark, d).silver("products"), exact_split=True))

register("fact_sales_stream_exact_split", with_more(_split_sql("fss_base", "event_id", "d0", "j"), f"""
SELECT f.* REPLACE (e.allocated_discount AS allocated_discount, e.net_revenue AS net_revenue, e.gross_profit AS gross_profit, e.gross_margin_pct AS gross_margin_pct)
FROM (SELECT *, row_number() OVER (PARTITION BY source_event_id ORDER BY unit_price) AS line FROM fact_sales_stream) f
JOIN (SELECT event_id, row_number() OVER (PARTITION BY event_id ORDER BY i_unit_price) AS line, {_after('i_unit_cost * i_quantity')} FROM exact) e
  ON e.event_id = f.source_event_id AND e.line = f.line""").replace("SELECT f.*", "SELECT * EXCLUDE (line) FROM (SELECT f.*") + ")")(
    lambda spark, d: ST.fact_sales_stream(lake(spark, d).topic(TOPIC_ORDER).exploded, exact_split=True))
