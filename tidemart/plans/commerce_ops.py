"""Storefront logic re-aimed as whole-table operators.

The reference runs these per web session against the OLTP database; here
each is a DataFrame operator over all sessions, products and promotions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.economics import percent_discount, shipping_fee
from ..functions.timefilter import as_of_ts
from ..lake import ORDERS_AS_OF
from ..oracle.sql import with_ctes
from ..registry import lake, register
from ..schemas import (FREE_SHIPPING_FROM, LOW_STOCK_ALERT_BELOW, RESTOCK_AMOUNT,
                       RESTOCK_THRESHOLD, SHIPPING_FEE, TAG_BEST_SELLER_ABOVE,
                       TAG_LOW_STOCK_BELOW)

c = F.col

# The storefront's product tags, as the reference shows them.
TAG_LOW_STOCK = "Sắp hết hàng"
TAG_BEST_SELLER = "Bán chạy"


def catalog_listing(products: DataFrame, inventory: DataFrame) -> DataFrame:
    inv = inventory.select("product_id", c("stock_quantity").alias("stock"), c("import_price").alias("cost"))
    j = products.filter(c("is_active")).join(inv, "product_id", "left")
    tag = (F.when(c("stock").isNotNull() & (c("stock") != 0) & (c("stock") < TAG_LOW_STOCK_BELOW), TAG_LOW_STOCK)
            .when(c("price") > TAG_BEST_SELLER_ABOVE, TAG_BEST_SELLER))
    return (j.select(c("product_id").alias("id"), c("product_name").alias("name"), "brand", "category", "price",
                     "image_url", "stock", "cost", tag.alias("tag"))
             .orderBy(c("price").desc(), "id"))


def _open_range(ts):
    return ((c("start_date").isNull() | (c("start_date") <= ts)) & (c("end_date").isNull() | (c("end_date") >= ts)))


def active_promotions(promos: DataFrame, as_of=None) -> DataFrame:
    return (promos.filter(c("is_active") & _open_range(as_of_ts(as_of)))
                  .select("promo_id", "promo_code", "discount_percent")
                  .orderBy(c("discount_percent").desc(), "promo_id"))


def promo_validation(promo_events: DataFrame, promos: DataFrame) -> DataFrame:
    """Each submitted code (applied or invalid event; codes are already
    trimmed and upper-cased in Silver) checked against the promotions that
    are active at the event time: a left join on the code with the time
    window as a join condition."""
    sub = promo_events.filter(c("event_type").isin("promo_applied", "promo_invalid")).select(
        "event_id", "user_id", "session_id", c("promo_code").alias("submitted_code"), "event_ts").alias("e")
    p = promos.filter(c("is_active")).select("promo_code", "promo_id", "discount_percent",
                                              "start_date", "end_date").alias("p")
    on = (c("e.submitted_code") == c("p.promo_code")) & _open_range(c("e.event_ts"))
    # one promotion per submission, as the storefront looks up one: of several
    # with the code, the least id
    j = sub.join(p, on, "left").groupBy("event_id", "user_id", "session_id", "submitted_code", "event_ts").agg(
        F.min(F.struct("promo_id", "discount_percent")).alias("best"))
    return j.select("event_id", "user_id", "session_id", "submitted_code",
                    F.when(c("best.promo_id").isNotNull(), "promo_applied").otherwise("promo_invalid").alias("result"),
                    "best.promo_id", "best.discount_percent", "event_ts")


def cart_state(cart_events: DataFrame) -> DataFrame:
    """Latest quantity per (session, product); a removal leaves 0. ``max_by``
    aggregates partially on the map side, so a hot session is not one task."""
    return cart_events.groupBy("session_id", "product_id").agg(
        F.max_by("cart_quantity_after", F.struct("event_ts", "event_id")).alias("quantity"),
        F.max("event_ts").alias("last_event_ts"))


def cart_pricing(state: DataFrame, products: DataFrame, validation: DataFrame, promo_events: DataFrame) -> DataFrame:
    """Per cart: subtotal = sum(price * qty); the session's latest promo
    action decides the percent (applied and valid, else none); discount is
    int(subtotal * pct / 100); shipping below the free threshold."""
    # a line of an unknown product stays, at price 0
    lines = state.filter(c("quantity") > 0).join(products.select("product_id", "price"), "product_id", "left")
    carts = lines.groupBy("session_id").agg(F.sum("quantity").alias("items"),
                                            F.sum(F.coalesce("price", F.lit(0)) * c("quantity")).alias("subtotal"))
    actions = (validation.select("session_id", "event_ts", "event_id",
                                 F.when(c("result") == "promo_applied", c("discount_percent")).alias("pct"))
               .unionByName(promo_events.filter(c("event_type") == "promo_removed")
                            .select("session_id", "event_ts", "event_id", F.lit(None).cast("decimal(5,2)").alias("pct"))))
    latest = actions.groupBy("session_id").agg(F.max_by("pct", F.struct("event_ts", "event_id")).alias("pct"))
    j = carts.join(latest, "session_id", "left")
    pct = F.coalesce(c("pct"), F.lit(0).cast("decimal(5,2)"))
    j = j.withColumn("discount_percent", pct).withColumn("discount_amount", percent_discount("subtotal", pct))
    j = j.withColumn("shipping_fee", shipping_fee("subtotal", FREE_SHIPPING_FROM, SHIPPING_FEE))
    return j.select("session_id", "items", "subtotal", "discount_percent", "discount_amount", "shipping_fee",
                    (c("subtotal") - c("discount_amount") + c("shipping_fee")).alias("total_amount"))


def restock_candidates(inventory: DataFrame, products: DataFrame, threshold: int = RESTOCK_THRESHOLD) -> DataFrame:
    return (inventory.filter(c("stock_quantity") <= threshold)
                     .join(products.select("product_id", "product_name"), "product_id")
                     .select("product_id", "product_name", "stock_quantity"))


def restock_apply(inventory: DataFrame, products: DataFrame, threshold: int = RESTOCK_THRESHOLD,
                  amount: int = RESTOCK_AMOUNT, as_of=None) -> DataFrame:
    """The new inventory frame: candidates gain ``amount`` and a restock date."""
    known = products.select("product_id", F.lit(True).alias("_known"))
    j = inventory.join(known, "product_id", "left")
    cand = (c("stock_quantity") <= threshold) & c("_known").isNotNull()
    return j.select("product_id", "import_price",
                    F.when(cand, c("stock_quantity") + amount).otherwise(c("stock_quantity")).alias("stock_quantity"),
                    F.when(cand, as_of_ts(as_of)).otherwise(c("last_restock_date")).alias("last_restock_date"),
                    cand.alias("restocked"))


def restock_logs(candidates: DataFrame, amount: int = RESTOCK_AMOUNT, as_of=None) -> DataFrame:
    return candidates.select("product_id", F.lit("IN").alias("transaction_type"),
                             F.lit(amount).cast("long").alias("quantity_changed"), F.lit("Restock").alias("note"),
                             as_of_ts(as_of).alias("created_at"))


def restock_events(candidates: DataFrame, amount: int = RESTOCK_AMOUNT) -> DataFrame:
    return candidates.select("product_id", "product_name", F.lit("restock_auto").alias("event_type"),
                             F.lit(amount).alias("quantity_added"),
                             (c("stock_quantity") + amount).alias("stock_remaining"))


def low_stock_alerts(moves: DataFrame, inventory: DataFrame, below: int = LOW_STOCK_ALERT_BELOW) -> DataFrame:
    """The inventory holds the stock after all movements, so the stock after
    one of them is that stock less all later movements, in (time, log_id)
    order; an OUT movement that leaves less than ``below`` is an alert.

    Skew-safe running sum: deltas are summed per (product, hour) bucket, the
    bucket totals are summed up per product (one row per bucket, so a hot
    product is bounded by its number of hours), and the exact running sum is
    finished inside each (product, hour) group."""
    m = moves.select("product_id", "log_id", "order_id", "transaction_type", "quantity_delta",
                     "log_created_at", F.date_trunc("hour", "log_created_at").alias("bucket"))
    buckets = m.groupBy("product_id", "bucket").agg(F.sum("quantity_delta").alias("bsum"))
    wp = Window.partitionBy("product_id").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("bsum").over(Window.partitionBy("product_id"))
    buckets = buckets.withColumn("offset", F.coalesce(F.sum("bsum").over(wp), F.lit(0).cast("long")) - total)
    wi = (Window.partitionBy("product_id", "bucket").orderBy("log_created_at", "log_id")
                .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    j = (m.join(buckets.select("product_id", "bucket", "offset"), ["product_id", "bucket"])
          .join(inventory.select("product_id", c("stock_quantity").alias("current")), "product_id", "left"))
    j = j.withColumn("stock_after", F.coalesce(c("current"), F.lit(0).cast("long")) + c("offset")
                     + F.sum("quantity_delta").over(wi))
    return (j.filter((c("transaction_type") == "OUT") & (c("stock_after") < below))
             .select("product_id", "log_id", "order_id", "log_created_at", "stock_after"))


def product_search(products: DataFrame, term: str, category: str | None = None) -> DataFrame:
    t = term.lower()
    m = products.filter(c("is_active") & (F.lower("product_name").contains(t) | F.lower("brand").contains(t)))
    if category and category != "All":
        m = m.filter(c("category") == category)
    return m.select("product_id", "product_name", "brand", "category", "price")


def category_list(products: DataFrame) -> DataFrame:
    return products.filter(c("is_active")).select("category").distinct().orderBy("category")


# ------------------------------------------------------------ registration
def _s(spark, d, e):
    return lake(spark, d).silver(e)


def _topic(spark, d, t):
    return lake(spark, d).topic(t).silver


register("catalog_listing", with_ctes(f"""
SELECT p.product_id AS id, p.product_name AS name, p.brand, p.category, p.price, p.image_url,
       i.stock_quantity AS stock, i.import_price AS cost,
       CASE WHEN i.stock_quantity IS NOT NULL AND i.stock_quantity <> 0 AND i.stock_quantity < {TAG_LOW_STOCK_BELOW}
            THEN '{TAG_LOW_STOCK}' WHEN p.price > {TAG_BEST_SELLER_ABOVE} THEN '{TAG_BEST_SELLER}' END AS tag
FROM s_products p LEFT JOIN s_inventory i ON p.product_id = i.product_id
WHERE p.is_active ORDER BY p.price DESC"""))(
    lambda spark, d: catalog_listing(_s(spark, d, "products"), _s(spark, d, "inventory")))

register("active_promotions", with_ctes(f"""
SELECT promo_id, promo_code, discount_percent FROM s_promotions
WHERE is_active AND (start_date IS NULL OR start_date <= TIMESTAMP '{ORDERS_AS_OF}')
  AND (end_date IS NULL OR end_date >= TIMESTAMP '{ORDERS_AS_OF}') ORDER BY discount_percent DESC"""))(
    lambda spark, d: active_promotions(_s(spark, d, "promotions"), ORDERS_AS_OF))

_VALID_SQL = """
val AS (SELECT e.event_id, e.user_id, e.session_id, e.promo_code AS submitted_code,
               CASE WHEN count(p.promo_id) > 0 THEN 'promo_applied' ELSE 'promo_invalid' END AS result,
               min(p.promo_id) AS promo_id, arg_min(p.discount_percent, p.promo_id) AS discount_percent, e.event_ts
        FROM fact_promo_events e LEFT JOIN s_promotions p ON p.promo_code = e.promo_code AND p.is_active
             AND (p.start_date IS NULL OR p.start_date <= e.event_ts) AND (p.end_date IS NULL OR p.end_date >= e.event_ts)
        WHERE e.event_type IN ('promo_applied', 'promo_invalid') GROUP BY ALL)"""


def _nest(extra: str, final: str) -> str:
    return with_ctes("").rstrip() + "," + extra + "\n" + final


register("promo_validation", _nest(_VALID_SQL, "SELECT * FROM val"))(
    lambda spark, d: promo_validation(_topic(spark, d, "ecommerce.promo"), _s(spark, d, "promotions")))

_STATE_SQL = """
st AS (SELECT session_id, product_id, max_by(cart_quantity_after, (event_ts, event_id)) AS quantity,
              max(event_ts) AS last_event_ts FROM fact_cart_events GROUP BY 1, 2)"""

register("cart_state", _nest(_STATE_SQL, "SELECT * FROM st"))(
    lambda spark, d: cart_state(lake(spark, d).table("fact_cart_events")))

register("cart_pricing", _nest(_VALID_SQL + "," + _STATE_SQL + """,
carts AS (SELECT session_id, CAST(sum(quantity) AS BIGINT) AS items, CAST(sum(coalesce(price, 0) * quantity) AS BIGINT) AS subtotal
          FROM st LEFT JOIN s_products USING (product_id) WHERE quantity > 0 GROUP BY 1),
acts AS (SELECT session_id, event_ts, event_id,
                CASE WHEN result = 'promo_applied' THEN discount_percent END AS pct FROM val
         UNION ALL SELECT session_id, event_ts, event_id, CAST(NULL AS DECIMAL(5,2)) FROM fact_promo_events
         WHERE event_type = 'promo_removed'),
latest AS (SELECT session_id, arg_max_null(pct, (event_ts, event_id)) AS pct FROM acts GROUP BY 1)""", f"""
SELECT session_id, items, subtotal, CAST(coalesce(pct, 0) AS DECIMAL(5,2)) AS discount_percent,
       CAST(floor(CAST(subtotal AS DECIMAL(20,0)) * coalesce(pct, 0) / 100) AS BIGINT) AS discount_amount,
       CAST(CASE WHEN subtotal < {FREE_SHIPPING_FROM} THEN {SHIPPING_FEE} ELSE 0 END AS BIGINT) AS shipping_fee,
       subtotal - CAST(floor(CAST(subtotal AS DECIMAL(20,0)) * coalesce(pct, 0) / 100) AS BIGINT)
         + CASE WHEN subtotal < {FREE_SHIPPING_FROM} THEN {SHIPPING_FEE} ELSE 0 END AS total_amount
FROM carts LEFT JOIN latest USING (session_id)"""))(
    lambda spark, d: cart_pricing(cart_state(lake(spark, d).table("fact_cart_events")), _s(spark, d, "products"),
                                  promo_validation(_topic(spark, d, "ecommerce.promo"), _s(spark, d, "promotions")),
                                  _topic(spark, d, "ecommerce.promo")))

register("restock_candidates", with_ctes(f"""
SELECT i.product_id, p.product_name, i.stock_quantity FROM s_inventory i JOIN s_products p USING (product_id)
WHERE i.stock_quantity <= {RESTOCK_THRESHOLD}"""))(
    lambda spark, d: restock_candidates(_s(spark, d, "inventory"), _s(spark, d, "products")))

register("restock_apply", with_ctes(f"""
SELECT i.product_id, i.import_price,
       CASE WHEN i.stock_quantity <= {RESTOCK_THRESHOLD} AND p.product_id IS NOT NULL
            THEN i.stock_quantity + {RESTOCK_AMOUNT} ELSE i.stock_quantity END AS stock_quantity,
       CASE WHEN i.stock_quantity <= {RESTOCK_THRESHOLD} AND p.product_id IS NOT NULL
            THEN TIMESTAMP '{ORDERS_AS_OF}' ELSE i.last_restock_date END AS last_restock_date,
       coalesce(i.stock_quantity <= {RESTOCK_THRESHOLD} AND p.product_id IS NOT NULL, FALSE) AS restocked
FROM s_inventory i LEFT JOIN s_products p USING (product_id)"""))(
    lambda spark, d: restock_apply(_s(spark, d, "inventory"), _s(spark, d, "products"), as_of=ORDERS_AS_OF))

register("low_stock_alerts", with_ctes(f"""
SELECT product_id, log_id, order_id, log_created_at, stock_after FROM (
  SELECT m.*, CAST(coalesce(i.stock_quantity, 0) - coalesce(sum(m.quantity_delta) OVER (PARTITION BY m.product_id
           ORDER BY m.log_created_at DESC, m.log_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS stock_after
  FROM fact_inventory_log m LEFT JOIN s_inventory i USING (product_id))
WHERE transaction_type = 'OUT' AND stock_after < {LOW_STOCK_ALERT_BELOW}"""))(
    lambda spark, d: low_stock_alerts(lake(spark, d).table("fact_inventory_log"), _s(spark, d, "inventory")))

register("product_search", with_ctes("""
SELECT product_id, product_name, brand, category, price FROM s_products
WHERE is_active AND (contains(lower(product_name), 'rod') OR contains(lower(brand), 'rod'))"""))(
    lambda spark, d: product_search(_s(spark, d, "products"), "rod"))

_FOUND = "is_active AND (contains(lower(product_name), 'rod') OR contains(lower(brand), 'rod'))"
_CATEGORY = "PROMO"

register("product_search_in_category", with_ctes(f"""
SELECT product_id, product_name, brand, category, price FROM s_products WHERE category = '{_CATEGORY}'
INTERSECT SELECT product_id, product_name, brand, category, price FROM s_products
WHERE is_active AND (position('a' IN lower(product_name)) > 0 OR position('a' IN lower(brand)) > 0)"""))(
    lambda spark, d: product_search(_s(spark, d, "products"), "A", _CATEGORY))

register("product_search_count", with_ctes(f"""
SELECT count(*) AS results FROM s_products WHERE {_FOUND}"""))(
    lambda spark, d: product_search(_s(spark, d, "products"), "rod").agg(F.count("*").alias("results")))

_LOW = f"""s_products JOIN s_inventory USING (product_id) WHERE stock_quantity <= {RESTOCK_THRESHOLD}"""

register("restock_logs", with_ctes(f"""
SELECT product_id, 'IN' AS transaction_type, CAST({RESTOCK_AMOUNT} AS BIGINT) AS quantity_changed, 'Restock' AS note,
       TIMESTAMP '{ORDERS_AS_OF}' AS created_at FROM {_LOW}"""))(
    lambda spark, d: restock_logs(restock_candidates(_s(spark, d, "inventory"), _s(spark, d, "products")), as_of=ORDERS_AS_OF))

register("restock_events", with_ctes(f"""
SELECT product_id, product_name, 'restock_auto' AS event_type, CAST({RESTOCK_AMOUNT} AS INTEGER) AS quantity_added,
       stock_quantity + {RESTOCK_AMOUNT} AS stock_remaining FROM {_LOW}"""))(
    lambda spark, d: restock_events(restock_candidates(_s(spark, d, "inventory"), _s(spark, d, "products"))))

register("category_list", with_ctes("""
SELECT DISTINCT category FROM s_products WHERE is_active ORDER BY 1"""))(
    lambda spark, d: category_list(_s(spark, d, "products")))
