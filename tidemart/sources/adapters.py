"""Test tables (TPC-H-like star + events) mapped onto the commerce entities.

Every rule is deterministic arithmetic on keys, so the DuckDB twin in
``tidemart.oracle`` computes the same rows. Reject cases (null keys, zero
prices, zero quantities, unknown types) are injected from key residues,
because the test tables hold no nulls. All money is LONG.

Scale notes: ``orders`` joins the per-order line sums, which is a partial
aggregate of lineitem followed by a sort-merge join on the order key;
lines are numbered once, by a range shuffle and the sizes of the ranges, for
both ``order_items`` and ``inventory_logs``.
"""

from __future__ import annotations

import threading
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import PROMOTION_SCHEMA
from ..session import scratch_path, write_and_clean


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _ts(c):
    return F.col(c).cast("timestamp")


def users(customer: DataFrame, nation: DataFrame) -> DataFrame:
    n = nation.select("n_nationkey", "n_name")
    c = customer.join(n, customer.c_nationkey == n.n_nationkey, "left")
    k = F.col("c_custkey")
    return c.select(
        F.concat(F.lit("U"), k.cast("string")).alias("user_id"),
        F.when(k % 97 != 0, F.concat(F.lit(" "), F.upper("c_name"))).alias("username"),
        F.concat(F.lit("pw"), k.cast("string")).alias("password"),
        F.col("c_name").alias("full_name"),
        F.concat(F.lit(" "), F.col("c_name"), F.lit("@Shop.Test")).alias("email"),
        F.concat(F.lit("09"), F.lpad(k.cast("string"), 8, "0")).alias("phone"),
        F.when(k % 3 == 0, "Male").when(k % 3 == 1, "Female").otherwise("Other").alias("gender"),
        F.col("n_name").alias("location"),
        F.date_add(F.lit("1994-01-01").cast("date"), (k % 300).cast("int")).cast("timestamp").alias("created_at"),
        (k % 10 != 0).alias("is_active"),
    )


def _base_price():
    k = F.col("p_partkey")
    return F.round(F.col("p_retailprice") * 100).cast("long") * (k % 300 + 1)


def products(part: DataFrame) -> DataFrame:
    k = F.col("p_partkey")
    return part.select(
        F.concat(F.lit("P"), k.cast("string")).alias("product_id"),
        F.col("p_name").alias("product_name"),
        F.col("p_brand").alias("brand"),
        F.col("p_type").alias("category"),
        F.when(k % 89 == 0, F.lit(0).cast("long")).when(k % 89 == 1, F.lit(None).cast("long"))
         .otherwise(_base_price()).alias("price"),
        F.concat(F.lit("img/P"), k.cast("string"), F.lit(".png")).alias("image_url"),
        F.lit("2023-01-01 00:00:00").cast("timestamp").alias("created_at"),
        (k % 17 != 0).alias("is_active"),
    )


def inventory(part: DataFrame) -> DataFrame:
    k = F.col("p_partkey")
    return part.filter(k % 83 != 0).select(
        F.concat(F.lit("P"), k.cast("string")).alias("product_id"),
        F.call_function("div", _base_price() * 7, F.lit(10)).alias("import_price"),
        (k % 60 - 2).alias("stock_quantity"),
        F.date_add(F.lit("2001-01-01").cast("date"), (k % 200).cast("int")).cast("timestamp").alias("last_restock_date"),
    )


# Fixed promotion rows: the reference's three seed codes with their percent;
# windows are fixed dates here (the seed used now() +- days).
PROMOTION_ROWS = [
    ("PROMO001", "SAVE10", "10.00", "1995-01-01 00:00:00", "1999-12-31 23:59:59", True),
    ("PROMO002", " welcome10 ", "10.00", "1997-01-01 00:00:00", "2001-12-31 23:59:59", True),
    ("PROMO003", "SPRING10", "10.00", "1996-01-01 00:00:00", None, True),
]


def promotions(spark: SparkSession, customer: DataFrame) -> DataFrame:
    """The seed codes plus personal voucher codes for every 25th customer
    (percent 5..15, a 180-day window or open-ended, some inactive, some
    with a missing code to exercise validation)."""
    import datetime as dt
    rows = [(a, b, c, dt.datetime.fromisoformat(d) if d else None,
             dt.datetime.fromisoformat(e) if e else None, f) for a, b, c, d, e, f in PROMOTION_ROWS]
    seeds = spark.createDataFrame(rows, PROMOTION_SCHEMA)
    k = F.col("c_custkey")
    start = F.date_add(F.lit("2000-01-01").cast("date"), (k % 365).cast("int")).cast("timestamp")
    vouchers = customer.filter(k % 25 == 0).select(
        F.concat(F.lit("PV"), k.cast("string")).alias("promo_id"),
        F.when(k % 200 != 0, F.concat(F.lit(" vip"), k.cast("string"), F.lit(" "))).alias("promo_code"),
        (k % 11 + 5).cast("string").alias("discount_percent"),
        start.alias("start_date"),
        F.when(k % 4 != 0, start + F.expr("INTERVAL 180 DAYS")).alias("end_date"),
        (k % 3 != 0).alias("is_active"))
    return seeds.unionByName(vouchers).withColumn("discount_percent", F.col("discount_percent").cast("decimal(5,2)"))


_ROW_BITS = 33   # monotonically_increasing_id: partition above, row of the partition below


def numbered_lines(lineitem: DataFrame, path: str) -> DataFrame:
    """Lines with a serial ``item_id``: 1, 2, ... in the order of all their
    columns, as a database sequence would give them. Nothing is packed into
    the number, so no count of lines makes two of them equal.

    Lines are dealt to ranges and sorted there (the one shuffle; a range may
    begin inside an order, so no order is too large), and written once below
    ``path`` with the row's place in its range. The places of the ranges follow
    from their sizes, one row a range."""
    spark, order = lineitem.sparkSession, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
                                           "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
    q = F.col("l_quantity").cast("long")
    unit_price = F.call_function("div", F.round(F.col("l_extendedprice") * 100).cast("long"), q)
    write_and_clean(lineitem.repartitionByRange(*order).sortWithinPartitions(*order).select(
        F.monotonically_increasing_id().alias("place"), "l_orderkey", "l_partkey", "l_returnflag", _ts("l_shipdate").alias("l_shipdate"),
        F.when(F.col("l_orderkey") % 101 == 0, F.lit(0).cast("long")).otherwise(q).alias("quantity"),
        unit_price.alias("unit_price")), path)
    lines = spark.read.parquet(path).withColumn("range", F.shiftrightunsigned("place", _ROW_BITS))
    starts, before = [], 0
    for r in sorted(lines.groupBy("range").count().collect()):
        starts.append((r["range"], before))
        before += r["count"]
    first = F.broadcast(spark.createDataFrame(starts, "range long, before long"))   # one row a range
    row = F.col("place").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return lines.join(first, "range").withColumn("item_id", F.col("before") + row + 1).drop("place", "range", "before")


def order_items(numbered: DataFrame) -> DataFrame:
    return numbered.select(
        "item_id",
        F.concat(F.lit("ORD_"), F.col("l_orderkey").cast("string")).alias("order_id"),
        F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("product_id"),
        "quantity", "unit_price",
        F.call_function("div", F.col("unit_price") * 7, F.lit(10)).alias("unit_cost"),
        (F.col("quantity") * F.col("unit_price")).alias("item_total"),
    )


def orders(orders_t: DataFrame, lineitem: DataFrame) -> DataFrame:
    # Line sums straight from lineitem: a map-side partial sum per order key,
    # then one sort-merge join on the LONG key (no window needed here).
    q = F.col("l_quantity").cast("long")
    unit_price = F.call_function("div", F.round(F.col("l_extendedprice") * 100).cast("long"), q)
    qty = F.when(F.col("l_orderkey") % 101 == 0, F.lit(0).cast("long")).otherwise(q)
    sums = (lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey"))
                    .agg(F.sum(qty * unit_price).alias("_sub")))
    o = orders_t.join(sums, "o_orderkey", "left")
    ok = F.col("o_orderkey")
    promo = ok % 10 < 3
    sub = F.coalesce(F.col("_sub"), F.lit(0).cast("long"))
    discount = (F.when(ok % 53 == 0, F.lit(None).cast("long"))
                 .when(promo, F.call_function("div", sub * 10, F.lit(100)))
                 .otherwise(F.lit(0).cast("long")))
    shipping = F.when(sub < 10_000_000, F.lit(15000).cast("long")).otherwise(F.lit(0).cast("long"))
    total = F.when(ok % 107 == 0, F.lit(0).cast("long")).otherwise(sub - F.coalesce(discount, F.lit(0)) + shipping)
    status = (F.when(F.col("o_orderstatus") == "F", "Delivered")
               .when(F.col("o_orderstatus") == "O",
                     F.when(ok % 3 == 0, "Pending").when(ok % 3 == 1, "Processing").otherwise("Shipped"))
               .otherwise(F.when(ok % 2 == 0, "Cancelled").otherwise("Returned")))
    pay = (F.when(ok % 4 == 0, "COD").when(ok % 4 == 1, "Credit Card")
            .when(ok % 4 == 2, "E-Wallet").otherwise("Bank Transfer"))
    return o.select(
        F.concat(F.lit("ORD_"), ok.cast("string")).alias("order_id"),
        F.when(ok % 103 != 0, F.concat(F.lit("U"), F.col("o_custkey").cast("string"))).alias("user_id"),
        F.when(promo, F.concat(F.lit("PROMO00"), (ok % 10 + 1).cast("string"))).alias("promo_id"),
        sub.alias("subtotal"), shipping.alias("shipping_fee"), discount.alias("discount_amount"),
        total.alias("total_amount"), pay.alias("payment_method"), status.alias("order_status"),
        _ts("o_orderdate").alias("order_date"),
        (_ts("o_orderdate") + F.expr("INTERVAL 2 DAYS")).alias("updated_at"),
    )


def inventory_logs(n: DataFrame, part: DataFrame) -> DataFrame:
    order_id = F.concat(F.lit("ORD_"), F.col("l_orderkey").cast("string"))
    product_id = F.concat(F.lit("P"), F.col("l_partkey").cast("string"))
    out = n.select(
        (F.col("item_id") * 3).alias("log_id"), product_id.alias("product_id"), order_id.alias("order_id"),
        F.when(F.col("l_orderkey") % 211 != 0, F.lit(" out")).alias("transaction_type"),
        F.col("quantity").alias("quantity_changed"), F.lit("checkout").alias("note"),
        F.col("l_shipdate").alias("created_at"))
    ret = n.filter(F.col("l_returnflag") == "R").select(
        (F.col("item_id") * 3 + 1).alias("log_id"), product_id.alias("product_id"), order_id.alias("order_id"),
        F.lit("Return ").alias("transaction_type"), F.col("quantity").alias("quantity_changed"),
        F.lit("return").alias("note"), (F.col("l_shipdate") + F.expr("INTERVAL 10 DAYS")).alias("created_at"))
    k = F.col("p_partkey")
    restock = part.select(
        (k * 3 + 2).alias("log_id"), F.concat(F.lit("P"), k.cast("string")).alias("product_id"),
        F.lit(None).cast("string").alias("order_id"), F.lit("IN").alias("transaction_type"),
        F.lit(50).cast("long").alias("quantity_changed"), F.lit("restock").alias("note"),
        F.lit("1995-01-01 00:00:00").cast("timestamp").alias("created_at"))
    return out.unionByName(ret).unionByName(restock)


def event_k(props="props"):
    return F.get_json_object(F.col(props), "$.k").cast("int")


def reviews(events: DataFrame) -> DataFrame:
    e = events.filter(F.col("event_type") == "view")
    eid, k = F.col("event_id"), event_k()
    return e.select(
        eid.alias("review_id"),
        F.concat(F.lit("P"), k.cast("string")).alias("product_id"),
        F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("user_id"),
        (eid % 7).cast("int").alias("rating"),
        F.when(eid % 3 == 1, F.lit("   ")).when(eid % 3 == 2, F.concat(F.lit(" nice product "), k.cast("string")))
         .alias("comment"),
        _ts("ts").alias("review_date"),
    )


class Sources:
    """The eight OLTP entities of one test-data folder, as lazy DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._lines: DataFrame | None = None
        self._lock = threading.Lock()

    def numbered(self) -> DataFrame:
        """The numbered lines, written once for all entities made of them."""
        with self._lock:
            if self._lines is None:
                self._lines = numbered_lines(self.t("lineitem"), scratch_path(self.spark, f"numbered-lines-{uuid.uuid4().hex}"))
            return self._lines

    def t(self, name: str) -> DataFrame:
        return read_table(self.spark, self.sf_dir, name)

    def entity(self, name: str) -> DataFrame:
        t = self.t
        return {
            "users": lambda: users(t("customer"), t("nation")),
            "products": lambda: products(t("part")),
            "inventory": lambda: inventory(t("part")),
            "promotions": lambda: promotions(self.spark, t("customer")),
            "orders": lambda: orders(t("orders"), t("lineitem")),
            "order_items": lambda: order_items(self.numbered()),
            "inventory_logs": lambda: inventory_logs(self.numbered(), t("part")),
            "reviews": lambda: reviews(t("events")),
        }[name]()

    ENTITIES = ["users", "products", "inventory", "promotions", "orders",
                "order_items", "inventory_logs", "reviews"]
