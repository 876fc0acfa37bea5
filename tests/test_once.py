"""What makes a table (parses, joins) runs once, and tasks hold bounded parts."""
import datetime as dt
import glob
import os
import time
from unittest.mock import Mock

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from tidemart.functions.apportion import apportion
from tidemart.functions.quality import dedup_latest, dedup_latest_few
from tidemart.operators import silver as S
from tidemart.plans import wiring
from tidemart.registry import lake
from tidemart.schemas import ALL_TOPICS, TOPIC_CART
from tidemart.session import write_and_clean
from tidemart.sources.io import FEED, topic_dir


def _optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("table", ["fact_cart_events", "fact_sales_stream"])
def test_a_message_is_parsed_once(spark, sf_dir, table):
    assert _optimized(lake(spark, sf_dir).table(table)).count("from_json(") == 1


def test_stream_dedup_parses_each_topic_once(spark, sf_dir):
    assert _optimized(E.queries()["stream_dedup"](spark, sf_dir)).count("from_json(") == len(ALL_TOPICS)


def test_apportion_makes_the_lines_once(spark):
    lines = spark.createDataFrame([("a", 10, 1, 1), ("a", 10, 2, 2), (None, 5, 1, 3)], "k string, amount long, w long, tie long")
    got = apportion(lines, "k", "amount", "w", "tie", "part")
    assert _optimized(got).count("LogicalRDD") + _optimized(got).count("LocalRelation") == 1
    assert sorted((r.tie, r.part) for r in got.collect()) == [(1, 3), (2, 7), (3, 0)]


@pytest.mark.parametrize("name,source", [("ctx_report", "lineitem"), ("forecast_vs_actual", "events"), ("forecast_fit_ar_by_category", "events"),
                                         ("forecast_ar_by_category", "events"), ("stream_kpis_rollup", "events"), ("stream_kpis_rollup_6h", "events")])
def test_sources_are_not_read_again(spark, sf_dir, name, source):
    files = E.queries()[name](spark, sf_dir).inputFiles()
    assert files and not [f for f in files if f.endswith(f"/{source}.parquet")]


def test_only_sums_of_products_meet_their_category(spark, sf_dir):
    plan = _optimized(E.queries()["forecast_by_category"](spark, sf_dir))
    joined = plan[plan.index("Join Inner"):]
    assert "Aggregate [product_id" in joined[:joined.index("Generate")]


def test_files_of_the_raw_log_are_bounded(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(wiring, "RAW_FILE_ROWS", 50)
    monkeypatch.setattr(wiring, "_RAW_DIRS", {})
    events = lake(spark, sf_dir).raw("events").count()
    assert wiring.batch_files(spark, sf_dir) == max(1, min(wiring.BATCH_FILES, -(-events // 50) // 4))
    files = glob.glob(os.path.join(wiring.raw_files(spark, sf_dir), f"{FEED}={topic_dir(TOPIC_CART)}", "*.parquet"))
    most = max(spark.read.parquet(f).count() for f in files)
    assert most <= 100
    got = E.queries()["stream_dedup_state"](spark, sf_dir)
    whole = E.queries()["stream_dedup"](spark, sf_dir)
    assert sorted(r.event_id for r in got.select("event_id").collect()) == sorted(r.event_id for r in whole.select("event_id").collect())


#: rows of the events table at 6 GB (360 times sf0.1)
LARGE_LOG = 36_000_000


@pytest.mark.parametrize("table", ["fact_inventory_events", "fact_order_items_stream", "fact_promo_events", "fact_review_events", "fact_user_events", "fact_sales_stream"])
def test_a_sink_of_a_large_log_sorts_bounded_files(spark, sf_dir, monkeypatch, table):
    large, written = Mock(), []
    large.raw.return_value.count.return_value = LARGE_LOG
    with monkeypatch.context() as m:
        m.setattr(wiring, "_RAW_DIRS", {})
        m.setattr(wiring, "lake", lambda *_: large)
        m.setattr(wiring.io, "write_raw_files", lambda raw, path, n: written.append(n))
        wiring.raw_files(spark, sf_dir)
        assert -(-LARGE_LOG // written[0]) <= 250_000
        assert wiring.batch_files(spark, sf_dir) <= 8

    monkeypatch.setattr(wiring, "RAW_FILE_ROWS", 50)
    monkeypatch.setattr(wiring, "_RAW_DIRS", {})
    got = E.queries()[f"sink_stream_append_{table}"](spark, sf_dir)
    whole = lake(spark, sf_dir).table(table)
    assert got.count() == whole.count() > 0
    assert got.select(whole.columns).exceptAll(whole).isEmpty()


def _shuffles_of_lines(plan: str) -> list[str]:
    """The joins of the lines, last first."""
    joined = [line.split("(")[1].split("#")[0] for line in plan.splitlines() if "Join LeftOuter, (" in line]
    return [k for k in joined if k in ("order_id", "product_id")]


@pytest.mark.parametrize("name", ["fact_sales", "fact_sales_exact_split"])
def test_lines_are_shuffled_narrow(spark, sf_dir, name):
    """By item only where an item id repeats, by product before the columns of orders are there."""
    df = E.queries()[name](spark, sf_dir)
    assert _shuffles_of_lines(_optimized(df)) == ["order_id", "product_id"]
    assert "hashpartitioning(item_id" not in df._jdf.queryExecution().executedPlan().toString()


def test_sink_table_writes_narrow_shuffles(spark, sf_dir, monkeypatch):
    plans, write = [], wiring.io.write_table
    monkeypatch.setattr(wiring.io, "write_table", lambda df, path: plans.append(_optimized(df)) or write(df, path))
    got = E.queries()["sink_table"](spark, sf_dir)
    assert [_shuffles_of_lines(p) for p in plans] == [["order_id", "product_id"]]
    assert got.count() == lake(spark, sf_dir).silver("order_items").count() > 0


@pytest.mark.parametrize("few", [100, 1, 0])
def test_repeated_items_are_found_whatever_their_number(spark, few):
    t = dt.datetime(2024, 1, 1)
    rows = [(i, f"O{i}", i, t) for i in range(50)] + [(7, "later", 1, t + dt.timedelta(1)), (None, "a", 1, t), (None, "b", 2, t + dt.timedelta(2)), (9, "O9", 9, t)]
    df = spark.createDataFrame(rows, "id long, o string, q long, at timestamp").repartition(4)
    order = [F.col("at"), F.xxhash64("id", "o", "q", "at")]
    got = sorted(map(str, dedup_latest_few(df, "id", order, few).collect()))
    assert got == sorted(map(str, dedup_latest(df, "id", order).collect())) and len(got) == 51
    assert [r.o for r in dedup_latest_few(df, "id", order, few).filter("id = 7 or id is null").orderBy("id").collect()] == ["b", "later"]


def test_items_of_one_id_keep_the_newest(spark):
    cols = "item_id long, order_id string, product_id string, quantity long, unit_price long, unit_cost long, item_total long, ingested_at timestamp, batch_id string"
    t = dt.datetime(2024, 1, 1)
    rows = [(i, "O", "P", 1, 2, 1, 2, t, "b") for i in range(20)] + [(3, "O", "P", 5, 2, 1, 10, t + dt.timedelta(1), "c")]
    got = S.dedup("order_items", spark.createDataFrame(rows, cols))
    assert sorted((r.item_id, r.quantity) for r in got.collect()) == sorted((i, 5 if i == 3 else 1) for i in range(20))


def test_shuffle_files_of_a_written_table_go(spark, tmp_path):
    def shuffled() -> int:
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return sum("shuffle_" in files.apply(i).getName() for i in range(files.size()))

    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, setting = shuffled(), spark.conf.get(key)
    write_and_clean(spark.range(1000).repartitionByRange(3, "id"), str(tmp_path / "t"))
    until = time.time() + 20
    while shuffled() > before and time.time() < until:
        time.sleep(0.2)
    assert shuffled() <= before and spark.conf.get(key) == setting
    assert spark.read.parquet(str(tmp_path / "t")).count() == 1000
