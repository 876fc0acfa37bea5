"""Gold (batch): star-schema dimensions and facts from Silver.

Joins are expressed plainly and left to Catalyst and AQE: no hint is given,
so a side is broadcast only when its measured size is under the broadcast
threshold and sort-merge joined otherwise. The payment and status
dimensions are fixed lookup rows; ``dim_date`` spans the dates of the data.
``as_of`` fixes the clock columns (SURVEY Q9).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.apportion import apportion
from ..functions.economics import after_discount, line_economics, unit_margin_pct
from ..functions.money import pct_half_up
from ..functions.timefilter import as_of_ts
from ..schemas import (ORDER_STATUS_ROWS, PAYMENT_METHOD_ROWS, SENTIMENT_NEGATIVE, SENTIMENT_NEUTRAL,
                       SENTIMENT_POSITIVE, STOCK_CRITICAL, STOCK_CRITICAL_LABEL, STOCK_HEALTHY_LABEL,
                       STOCK_LOW, STOCK_LOW_LABEL, STOCK_MEDIUM, STOCK_MEDIUM_LABEL)

c = F.col


# ----------------------------------------------------------------- dimensions
def dim_date(spark: SparkSession, start: str = "2023-01-01", end: str = "2030-12-31") -> DataFrame:
    """One row per day; day_of_week_num 1 = Sunday; ISO week of year."""
    d = spark.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"),
                                                   F.expr("INTERVAL 1 DAY"))).alias("date_key"))
    return _date_attributes(d)


def _date_attributes(d: DataFrame) -> DataFrame:
    k = c("date_key")
    return d.select(
        k, F.year(k).alias("year"), F.quarter(k).alias("quarter"), F.month(k).alias("month"),
        F.date_format(k, "MMMM").alias("month_name"), F.dayofmonth(k).alias("day"),
        F.dayofweek(k).alias("day_of_week_num"), F.date_format(k, "EEEE").alias("day_of_week_name"),
        F.weekofyear(k).alias("week_of_year"), F.dayofweek(k).isin(1, 7).alias("is_weekend"),
        F.date_format(k, "yyyy-MM").alias("year_month"))


def dim_users(silver_users: DataFrame, as_of=None) -> DataFrame:
    return silver_users.select(
        "user_id", "username", "full_name", "email", "phone", "gender", "location",
        c("created_at").alias("account_created_at"),
        F.to_date("created_at").alias("account_created_date"),
        "is_active",
        F.months_between(as_of_ts(as_of), c("created_at")).cast("int").alias("account_age_months"))


def stock_status(stock) -> F.Column:
    s = c(stock) if isinstance(stock, str) else stock
    return (F.when(s.isNull(), "Unknown").when(s < STOCK_CRITICAL, STOCK_CRITICAL_LABEL)
             .when(s < STOCK_LOW, STOCK_LOW_LABEL).when(s < STOCK_MEDIUM, STOCK_MEDIUM_LABEL)
             .otherwise(STOCK_HEALTHY_LABEL))


def dim_products(silver_products: DataFrame, silver_inventory: DataFrame) -> DataFrame:
    inv = silver_inventory.select("product_id", "import_price", "stock_quantity", "last_restock_date")
    j = silver_products.join(inv, "product_id", "left")
    return j.select(
        "product_id", "product_name", "brand", "category",
        c("price").alias("current_selling_price"), c("import_price").alias("current_unit_cost"),
        pct_half_up(c("price") - c("import_price"), c("price")).alias("gross_margin_pct"),
        c("stock_quantity").alias("current_stock"), stock_status("stock_quantity").alias("stock_status"),
        "is_active", "last_restock_date")


def dim_promotions(silver_promotions: DataFrame) -> DataFrame:
    return silver_promotions.select(
        "promo_id", "promo_code", "discount_percent", "start_date", "end_date",
        F.when(c("start_date").isNotNull() & c("end_date").isNotNull(),
               F.datediff(c("end_date"), c("start_date"))).alias("duration_days"),
        "is_active")


def date_span(*cols: tuple[DataFrame, str]) -> DataFrame:
    """One row (start, end): first and last date over several
    (frame, timestamp column) pairs."""
    u = None
    for df, col in cols:
        part = df.select(F.to_date(col).alias("x"))
        u = part if u is None else u.unionByName(part)
    return u.agg(F.min("x").alias("start"), F.max("x").alias("end"))


def dim_date_spanning(span: DataFrame) -> DataFrame:
    """dim_date over the dates of the data: one row per day from the first
    to the last date found (``span`` is the one-row result of date_span)."""
    d = span.select(F.explode(F.sequence("start", "end", F.expr("INTERVAL 1 DAY"))).alias("date_key"))
    return _date_attributes(d)


def dim_payment_method(spark: SparkSession) -> DataFrame:
    """The fixed rows; an order with another code has no payment method."""
    return spark.createDataFrame(
        PAYMENT_METHOD_ROWS,
        "payment_method_code string, payment_method_name string, payment_channel string, is_digital boolean")


def dim_order_status(spark: SparkSession) -> DataFrame:
    """The fixed rows; an order with another code has no status."""
    return spark.createDataFrame(
        ORDER_STATUS_ROWS, "status_code string, status_name_vi string, is_completed boolean, is_negative boolean")


# ---------------------------------------------------------------------- facts
def fact_orders(silver_orders: DataFrame) -> DataFrame:
    return silver_orders.select(
        "order_id", "user_id", "promo_id", "payment_method", "order_status",
        F.to_date("order_date").alias("date_key"),
        "subtotal", "shipping_fee", "discount_amount", "total_amount",
        (c("total_amount") - c("shipping_fee")).alias("net_revenue"),
        c("order_date").alias("order_created_at"), "updated_at")


def fact_order_items(silver_items: DataFrame, silver_orders: DataFrame) -> DataFrame:
    o = silver_orders.select("order_id", "user_id", "promo_id", "order_status", "payment_method", "order_date")
    j = silver_items.join(o, "order_id", "left")
    profit = c("unit_price") - c("unit_cost")
    return j.select(
        "item_id", "order_id", "user_id", "product_id", "promo_id", "order_status", "payment_method",
        F.to_date("order_date").alias("date_key"),
        "quantity", "unit_price", "unit_cost", "item_total",
        profit.alias("unit_gross_profit"), (profit * c("quantity")).alias("line_gross_profit"),
        unit_margin_pct("unit_price", "unit_cost").alias("gross_margin_pct"),
        c("order_date").alias("order_created_at"))


def fact_sales(silver_items: DataFrame, silver_orders: DataFrame, silver_products: DataFrame,
               exact_split: bool = False) -> DataFrame:
    """One row per order line, fully denormalised, with the order discount
    allocated to lines: rounded line by line, or with ``exact_split`` by
    largest remainders, so that they add up to the order's. The reference also
    joined inventory without using any of its columns; that join is dropped.
    Products are joined before orders: their three columns are all that the
    second shuffle of the lines has more than the first."""
    o = silver_orders.select("order_id", "user_id", "promo_id", "payment_method", "order_status",
                             "order_date", "updated_at", "subtotal", "shipping_fee",
                             "discount_amount", "total_amount")
    p = silver_products.select("product_id", "product_name", "brand", "category")
    j = silver_items.join(p, "product_id", "left").join(o, "order_id", "left")
    j = j.withColumns(line_economics("quantity", "unit_price", "unit_cost", "discount_amount", "subtotal"))
    if exact_split:
        # beside the join by order, whose partitions the orders' windows use as they are
        j = j.drop("allocated_discount")
        j = apportion(j, "order_id", "discount_amount", "gross_revenue", "item_id").withColumns(after_discount())
    return j.select(
        "item_id", "order_id", "user_id", "product_id", "promo_id", "payment_method", "order_status",
        F.to_date("order_date").alias("date_key"),
        "product_name", "brand", "category",
        "quantity", "unit_price", "gross_revenue", "allocated_discount", "net_revenue",
        "unit_cost", "total_cost", "gross_profit", "gross_margin_pct",
        c("subtotal").alias("order_subtotal"), "shipping_fee",
        c("discount_amount").alias("order_discount_amount"),
        c("total_amount").alias("order_total_amount"),
        c("order_date").alias("order_created_at"), c("updated_at").alias("order_updated_at"))


def fact_inventory_log(silver_logs: DataFrame, compat: bool = False) -> DataFrame:
    """quantity_delta: IN adds stock, OUT removes it; RETURN adds stock back
    (SURVEY Q6). ``compat=True`` keeps the reference rule (only IN adds)."""
    adds = ["IN"] if compat else ["IN", "RETURN"]
    return silver_logs.select(
        "log_id", "product_id", "order_id", "transaction_type", "quantity_changed",
        F.when(c("transaction_type").isin(adds), c("quantity_changed"))
         .otherwise(-c("quantity_changed")).alias("quantity_delta"),
        "note", F.to_date("created_at").alias("date_key"), c("created_at").alias("log_created_at"))


def sentiment_label(rating) -> F.Column:
    r = c(rating) if isinstance(rating, str) else rating
    return F.when(r >= 4, SENTIMENT_POSITIVE).when(r == 3, SENTIMENT_NEUTRAL).otherwise(SENTIMENT_NEGATIVE)


def fact_reviews(silver_reviews: DataFrame) -> DataFrame:
    return silver_reviews.select(
        "review_id", "product_id", "user_id", "rating", sentiment_label("rating").alias("sentiment_label"),
        "comment",
        (c("comment").isNotNull() & (F.trim(c("comment")) != "")).alias("has_comment"),
        F.to_date("review_date").alias("date_key"), c("review_date").alias("review_created_at"))
