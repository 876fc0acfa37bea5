"""Plan-shape assertions: what a 100 TB run depends on."""
import pytest

import __spark_entry__ as E
from tidemart import registry
from tidemart.lake import Lake

registry.load_marts()
SKIP = {"source_jdbc", "source_kafka", "sink_table", "sink_quarantine", "sink_stream_append"}


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - SKIP))
def test_no_cartesian_or_nested_loop(spark, sf_dir, name):
    p = _plan(E.queries()[name](spark, sf_dir))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p, name


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    from pyspark.sql import functions as F
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet").filter(F.col("l_quantity") > 10).select("l_orderkey")
    p = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,10.0)]" in p
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in p


def test_small_dimension_is_broadcast_by_measured_size(spark, sf_dir):
    """No hint on the payment dimension: AQE broadcasts it because it is small."""
    import __spark_entry__ as E2
    df = E2.queries()["payment_split"](spark, sf_dir)
    df.collect()
    p = df._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in p


def test_kpis_do_not_join_sales_to_orders(spark, sf_dir):
    """batch_kpis reads the denormalised fact only (one scan, no big join)."""
    lk = Lake(spark, sf_dir)
    from tidemart.plans.sales import _tf, batch_kpis
    fs = lk.table("fact_sales")
    df = batch_kpis(fs, lk.table("dim_order_status"), _tf("date_key"))
    # the only shuffle joins are the ones that build fact_sales itself
    assert _plan(df).count("SortMergeJoin") <= _plan(fs).count("SortMergeJoin")


def test_hot_key_is_pre_aggregated_before_the_shuffle(spark):
    """A key holding a third of all rows is reduced map-side (partial
    aggregate before the Exchange) in dedup and cart state."""
    import datetime as dt

    from pyspark.sql import functions as F

    from tidemart.functions.quality import dedup_latest
    from tidemart.plans.commerce_ops import cart_state
    t = dt.datetime(2024, 1, 1)
    rows = [("hot" if i % 3 == 0 else f"k{i}", t + dt.timedelta(seconds=i), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "id string, ts timestamp, v long").repartition(8)
    d = dedup_latest(df, "id", [F.col("ts"), F.col("v")])
    assert d.filter(F.col("id") == "hot").first().v == 2997
    plan = _plan(d)
    # partial aggregate below the hash exchange on the key
    assert plan.index("partial_max_by") > plan.index("Exchange hashpartitioning(id"), plan
    ev = (df.withColumnRenamed("id", "session_id").withColumn("product_id", F.lit("P1"))
            .withColumn("cart_quantity_after", F.col("v")).withColumn("event_ts", F.col("ts"))
            .withColumn("event_id", F.col("v").cast("string")))
    cs = cart_state(ev)
    assert cs.filter(F.col("session_id") == "hot").first().quantity == 2997
    assert "partial_max_by" in _plan(cs)


def test_cli_batch(spark, sf_dir, tmp_path):
    from tidemart.__main__ import main
    main(["batch", "--sf-dir", sf_dir, "--out", str(tmp_path), "--as-of", "2001-08-02 00:00:00"])
    fs = spark.read.parquet(str(tmp_path / "gold" / "fact_sales"))
    assert fs.count() > 0
    # facts are partitioned by month: a query about recent days reads its months only
    import datetime as dt

    from tidemart.lake import FACT_MONTH
    recent = Lake.from_stored(spark, str(tmp_path)).table_since("fact_sales", 30, dt.datetime(1999, 1, 20))
    p = _plan(recent.select("net_revenue"))
    assert f"PartitionFilters: [isnotnull({FACT_MONTH}" in p and "ReadSchema: struct<net_revenue:bigint>" in p
    files, months = len(fs.inputFiles()), fs.select(FACT_MONTH).distinct().count()
    assert files <= 2 * months + 4


def test_rebuilt_fact_leaves_no_stale_partition(spark, tmp_path):
    from tidemart.sources.io import write_table
    path = str(tmp_path / "t")
    for day in ("2024-01-01", "2024-02-03"):        # a corrected row moves to another month
        write_table(spark.createDataFrame([(1, day)], "id int, m string"), path, partition_by=["m"])
    assert [tuple(r) for r in spark.read.parquet(path).select("id").collect()] == [(1,)]


@pytest.mark.parametrize("name", ["batch_kpis_30d", "category_revenue_30d", "ctx_kpis_30d", "history_30d", "stream_kpis_6h", "orders_per_minute_6h", "ctx_live_30d"])
def test_windows_exclude_rows(sf_dir, name):
    """The oracle's own result differs from that of the whole history."""
    import os
    import sys
    sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))
    from compare import duck
    con = duck(sf_dir)
    whole = name.removesuffix("_30d").removesuffix("_6h")
    few, all_ = (sorted(map(str, con.execute(registry.ORACLES[n]).fetchall())) for n in (name, whole))
    assert few and few != all_ and len(few) <= len(all_)


def test_fixed_dimensions_read_no_orders(spark, sf_dir):
    lk = Lake(spark, sf_dir)
    for t in ("dim_payment_method", "dim_order_status"):
        assert "FileScan" not in _plan(lk.table(t)) and "Scan parquet" not in _plan(lk.table(t))


def test_forecast_plan_has_no_self_join(spark, sf_dir):
    p = _plan(registry.QUERIES["forecast"](spark, sf_dir))
    series = _plan(registry.QUERIES["revenue_series"](spark, sf_dir))
    assert p.count("Join") == series.count("Join")


def test_lines_are_numbered_by_one_shuffle(spark, sf_dir):
    """Numbered lines are written once; what is made of them shuffles nothing
    more, and no window gathers the table."""
    lk = Lake(spark, sf_dir)
    items, logs = lk.src.entity("order_items"), lk.src.entity("inventory_logs")
    for df in (items, logs):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Window" not in plan and "SinglePartition" not in plan
        assert plan.count("Exchange") - plan.count("BroadcastExchange") == 0
    assert lk.src.numbered() is lk.src.numbered()
    ids = items.select("item_id").toPandas()["item_id"]
    assert sorted(ids) == list(range(1, spark.read.parquet(f"{sf_dir}/lineitem.parquet").count() + 1))
