"""Wiring items of SURVEY §2.1/§2.6 that have no query key."""
import datetime as dt
import tempfile

from tidemart.operators.bronze import new_batch_id
from tidemart.schemas import ALL_TOPICS, ENVELOPE_FIELDS, RAW_EVENT_SCHEMA, TOPIC_SCHEMAS
from tidemart.streaming import runner


def test_batch_id_format():
    assert new_batch_id(dt.datetime(2024, 3, 5, 7, 8, 9)) == "20240305_070809"


def test_schemas():
    assert len(ENVELOPE_FIELDS) == 9 and len(ALL_TOPICS) == 7 == len(TOPIC_SCHEMAS)
    assert all(s.names[:9] == ENVELOPE_FIELDS for s in TOPIC_SCHEMAS.values())
    assert TOPIC_SCHEMAS["ecommerce.order"]["items"].dataType.elementType.names == [
        "product_id", "product_name", "quantity", "unit_price", "unit_cost"]


def test_checkpoint_per_topic():
    assert runner.topic_dir("ecommerce.page_view") == "ecommerce_page_view"


def test_empty_batch_is_skipped(spark):
    empty = spark.createDataFrame([], RAW_EVENT_SCHEMA)
    from tidemart.operators import stream_topics as ST
    parsed = ST.parse(empty, "ecommerce.user")
    assert runner.process_raw_batch(parsed, 0, "ecommerce.user", tempfile.mkdtemp()) == {}
    assert runner.process_fact_batch(parsed, 0, "ecommerce.user", tempfile.mkdtemp()) == {}


def test_fan_out_starts_the_queries_of_each_topic(spark, sf_dir):
    from tidemart.plans.wiring import raw_files
    from tidemart.sources.io import read_raw_files_stream
    raw_dir = raw_files(spark, sf_dir)
    sources = {t: read_raw_files_stream(spark, raw_dir, 4, topic=t) for t in ALL_TOPICS}
    qs = runner.start_all(sources, tempfile.mkdtemp(), tempfile.mkdtemp(), trigger={"availableNow": True})
    assert len(qs) == 14 and len({q.name for q in qs}) == 14
    for q in qs:
        q.awaitTermination()
        assert q.exception() is None


def test_jdbc_parts_of_skewed_keys_are_even_and_a_second_run_reads_new_rows(spark):
    import uuid

    from pyspark.sql import functions as F

    from tidemart.sources import io
    url, props = f"jdbc:derby:memory:t_{uuid.uuid4().hex[:8]};create=true", {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    skewed = spark.range(1, 2001).select((F.col("id") * F.col("id") * F.col("id")).alias("k")).unionAll(spark.range(300).select(F.lit(50).cast("long")))
    io.write_jdbc(skewed, url, "T", properties=props)
    mark = io.HighWaterMark(spark, tempfile.mkdtemp() + "/mark")
    assert mark.value() is None
    new, upto = io.read_jdbc_new(spark, url, "T", '"k"', mark, 8, props)
    sizes = [r["count"] for r in new.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert sum(sizes) == 2300 and upto == 2000 ** 3 and len(sizes) >= 7 and max(sizes) <= 2 * 2300 / 8
    assert io.read_jdbc_new(spark, url, "T", '"k"', mark, 8, props)[1] == upto      # not stored: read again
    mark.advance(upto)
    mark.advance(5)
    assert mark.value() == upto
    assert io.read_jdbc_new(spark, url, "T", '"k"', mark, 8, props)[1] is None and io.read_jdbc_new(spark, url, "T", '"k"', mark, 8, props)[0].count() == 0
    io.write_jdbc(spark.createDataFrame([(upto + 7,), (3,)], "k long"), url, "T", properties=props)
    again, upto = io.read_jdbc_new(spark, url, "T", '"k"', mark, 8, props)
    assert [r.k for r in again.collect()] == [upto] == [2000 ** 3 + 7]


def test_a_stored_result_is_shared_and_follows_its_tables(spark):
    from tidemart.plans.catalog import SharedQueryCache
    root, path = tempfile.mkdtemp(), tempfile.mkdtemp() + "/t"
    spark.range(10).write.parquet(path)
    ask = lambda s: s.read.parquet(path).selectExpr("id % 3 AS k").groupBy("k").count()
    rows, hit = SharedQueryCache(spark, root).fetch(ask(spark))
    other = spark.newSession()
    again, found = SharedQueryCache(other, root).fetch(ask(other))
    assert not hit and found and sorted(map(tuple, rows.collect())) == sorted(map(tuple, again.collect()))
    assert not SharedQueryCache(spark, root, ttl_seconds=0).fetch(ask(spark))[1]                       # expired
    spark.range(20).write.mode("overwrite").parquet(path)
    rows, hit = SharedQueryCache(spark, root).fetch(ask(spark))
    assert not hit and sum(r["count"] for r in rows.collect()) == 20                                    # rewritten
    spark.read.parquet(path).createOrReplaceTempView("cached_t")
    cache = SharedQueryCache(spark, root)
    assert [cache.fetch("SELECT count(*) AS n FROM cached_t WHERE id > 4")[1] for _ in range(2)] == [False, True]
    cache.invalidate("SELECT count(*) AS n FROM cached_t WHERE id > 4")
    assert not cache.fetch("SELECT count(*) AS n FROM cached_t WHERE id > 4")[1]
