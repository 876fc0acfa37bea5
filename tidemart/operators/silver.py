"""Silver (batch): validate, quarantine, standardise, deduplicate.

Each entity has a rule list (``RULES``) and a projection; ``silver(name,
bronze)`` returns (good, bad). Good + bad = input for every entity, rules
included that the reference applied without a quarantine (SURVEY Q3).
Money and quantities stay LONG (Q1). Dedup keeps the newest row per
primary key with a total tie-break (Q5).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.quality import Rule, dedup_latest, dedup_latest_few, split_valid
from ..schemas import REASON_ORDER_ITEMS, REASON_ORDERS, REASON_PRODUCTS, REASON_RATING, REASON_USERS

c = F.col

PRIMARY_KEYS = {
    "users": "user_id", "products": "product_id", "inventory": "product_id",
    "promotions": "promo_id", "orders": "order_id", "order_items": "item_id",
    "inventory_logs": "log_id", "reviews": "review_id",
}

# Business timestamp used as the second dedup key (after ingested_at).
_BUSINESS_TS = {
    "users": "created_at", "products": "created_at", "inventory": "last_restock_date",
    "promotions": "start_date", "orders": "updated_at", "order_items": None,
    "inventory_logs": "created_at", "reviews": "review_date",
}


def rules(name: str) -> list[Rule]:
    r = {
        "users": [Rule(REASON_USERS, c("user_id").isNotNull()),
                  Rule(REASON_USERS, c("username").isNotNull())],
        "products": [Rule(REASON_PRODUCTS, c("product_id").isNotNull()),
                     Rule(REASON_PRODUCTS, c("price") > 0)],
        "inventory": [Rule("null product_id", c("product_id").isNotNull())],
        "promotions": [Rule("null promo_id or promo_code", c("promo_id").isNotNull()),
                       Rule("null promo_id or promo_code", c("promo_code").isNotNull())],
        "orders": [Rule(REASON_ORDERS, c("order_id").isNotNull()),
                   Rule(REASON_ORDERS, c("user_id").isNotNull()),
                   Rule(REASON_ORDERS, c("total_amount") > 0)],
        "order_items": [Rule(REASON_ORDER_ITEMS, c("order_id").isNotNull()),
                        Rule(REASON_ORDER_ITEMS, c("product_id").isNotNull()),
                        Rule(REASON_ORDER_ITEMS, c("quantity") > 0),
                        Rule(REASON_ORDER_ITEMS, c("unit_price") > 0)],
        "inventory_logs": [Rule("null product_id or transaction_type", c("product_id").isNotNull()),
                           Rule("null product_id or transaction_type", c("transaction_type").isNotNull())],
        "reviews": [Rule("null product_id or user_id", c("product_id").isNotNull()),
                    Rule("null product_id or user_id", c("user_id").isNotNull()),
                    Rule(REASON_RATING, c("rating").between(1, 5))],
    }
    return r[name]


def _t(x):
    return F.trim(c(x)).alias(x)


# Large tables whose keys come once but for faults: rows of other keys are not shuffled.
_SELDOM_REPEATED = {"order_items"}

_AUDIT = ["ingested_at", "batch_id"]


def project(name: str, df: DataFrame) -> DataFrame:
    """The standardising projection of a validated frame."""
    if name == "users":
        cols = [_t("user_id"), F.lower(F.trim(c("username"))).alias("username"), _t("full_name"),
                F.lower(F.trim(c("email"))).alias("email"), _t("phone"), _t("gender"), _t("location"),
                c("created_at").cast("timestamp").alias("created_at"),
                c("is_active").cast("boolean").alias("is_active")]
    elif name == "products":
        cols = [_t("product_id"), _t("product_name"), _t("brand"), _t("category"),
                c("price").cast("long").alias("price"), c("image_url"),
                c("created_at").cast("timestamp").alias("created_at"),
                c("is_active").cast("boolean").alias("is_active")]
    elif name == "inventory":
        cols = [_t("product_id"), c("import_price").cast("long").alias("import_price"),
                F.greatest(c("stock_quantity").cast("long"), F.lit(0).cast("long")).alias("stock_quantity"),
                c("last_restock_date").cast("timestamp").alias("last_restock_date")]
    elif name == "promotions":
        cols = [_t("promo_id"), F.upper(F.trim(c("promo_code"))).alias("promo_code"),
                c("discount_percent").cast("decimal(5,2)").alias("discount_percent"),
                c("start_date").cast("timestamp").alias("start_date"),
                c("end_date").cast("timestamp").alias("end_date"),
                c("is_active").cast("boolean").alias("is_active")]
    elif name == "orders":
        cols = [_t("order_id"), _t("user_id"), _t("promo_id"),
                c("subtotal").cast("long").alias("subtotal"),
                c("shipping_fee").cast("long").alias("shipping_fee"),
                F.coalesce(c("discount_amount").cast("long"), F.lit(0).cast("long")).alias("discount_amount"),
                c("total_amount").cast("long").alias("total_amount"),
                _t("payment_method"), _t("order_status"),
                c("order_date").cast("timestamp").alias("order_date"),
                c("updated_at").cast("timestamp").alias("updated_at")]
    elif name == "order_items":
        cols = [c("item_id").cast("long").alias("item_id"), _t("order_id"), _t("product_id"),
                c("quantity").cast("long").alias("quantity"), c("unit_price").cast("long").alias("unit_price"),
                c("unit_cost").cast("long").alias("unit_cost"), c("item_total").cast("long").alias("item_total")]
    elif name == "inventory_logs":
        cols = [c("log_id").cast("long").alias("log_id"), _t("product_id"), _t("order_id"),
                F.upper(F.trim(c("transaction_type"))).alias("transaction_type"),
                c("quantity_changed").cast("long").alias("quantity_changed"), c("note"),
                c("created_at").cast("timestamp").alias("created_at")]
    elif name == "reviews":
        cols = [c("review_id").cast("long").alias("review_id"), _t("product_id"), _t("user_id"),
                c("rating").cast("int").alias("rating"), _t("comment"),
                c("review_date").cast("timestamp").alias("review_date")]
    else:
        raise KeyError(name)
    return df.select(*cols, *_AUDIT)


def dedup(name: str, df: DataFrame) -> DataFrame:
    pk = PRIMARY_KEYS[name]
    order = [c("ingested_at")]
    if _BUSINESS_TS[name]:
        order.append(c(_BUSINESS_TS[name]))
    order.append(F.xxhash64(*[c(x) for x in df.columns]))
    return (dedup_latest_few if name in _SELDOM_REPEATED else dedup_latest)(df, pk, order)


def silver(name: str, bronze: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(silver table, quarantine rows) for one entity's Bronze frame."""
    good, bad = split_valid(bronze, rules(name))
    return dedup(name, project(name, good)), bad
