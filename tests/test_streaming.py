"""Structured Streaming: file twin, availableNow, restart and replay."""
import os
import tempfile

from pyspark.sql import functions as F

from tidemart.lake import Lake
from tidemart.operators import stream_topics as ST
from tidemart.plans.wiring import raw_files
from tidemart.schemas import RAW_EVENT_SCHEMA, TOPIC_INVENTORY, TOPIC_ORDER, TOPIC_USER
from tidemart.sources import io
from tidemart.streaming import runner, segments, windowed


def _undelivered(df):
    """What doesn't depend on which delivery of an event came through."""
    return df.drop("topic", "partition", "offset", "kafka_timestamp", "ingested_at")


def _cols(df):
    return [c for c in df.columns if c not in ("batch_id", "run_id", "ingested_at", "dw_loaded_at")]


def test_stream_equals_static_and_restart_adds_nothing(spark, sf_dir):
    raw_dir = raw_files(spark, sf_dir)
    root, ck = tempfile.mkdtemp(), tempfile.mkdtemp()
    runner.run_files_available_now(spark, raw_dir, root, ck, topics=[TOPIC_ORDER], max_files_per_trigger=1)
    got = runner.read_layer(spark, root, "gold", "fact_sales_stream")
    static = Lake(spark, sf_dir).table("fact_sales_stream")
    cols = _cols(static)
    assert got.select(cols).exceptAll(static.select(cols)).count() == 0
    assert static.select(cols).exceptAll(got.select(cols)).count() == 0
    n_batches = got.select("batch_id").distinct().count()
    assert n_batches >= 2                       # several micro-batches, one file each
    # restart from the same checkpoint: nothing new, nothing doubled
    runner.run_files_available_now(spark, raw_dir, root, ck, topics=[TOPIC_ORDER])
    assert runner.read_layer(spark, root, "gold", "fact_sales_stream").count() == got.count()


def test_replayed_batch_adds_nothing(spark):
    path = os.path.join(tempfile.mkdtemp(), "t")
    df = spark.range(5)
    assert [segments.append(df, path, n) for n in (7, 7, 8)] == [5, 5, 5]
    assert segments.append(df, path, 3) == 0            # before the last batch of its run
    assert segments.append(df, path, 0, "other") == 5
    assert segments.append(df.filter("id > 9"), path, 9) == 0
    assert segments.read(spark, path).count() == 15


def test_uncommitted_segment_is_invisible_and_replaced(spark):
    """A batch that failed between its write and its commit."""
    path = os.path.join(tempfile.mkdtemp(), "t")
    segments.append(spark.range(2), path, 0)
    io.write_table(spark.range(99), segments._segment(path, "run-000000000001"))
    assert segments.read(spark, path).count() == 2
    segments.append(spark.range(3), path, 1)
    assert segments.read(spark, path).count() == 5


def test_many_batches_leave_few_files_and_readers_see_each_row_once(spark):
    path, n, fan_in = os.path.join(tempfile.mkdtemp(), "t"), 70, 4
    for k in range(n):
        day = F.date_add(F.lit("2024-01-01").cast("date"), k % 2)
        before = segments.load(spark, path)
        segments.append(spark.range(k * 3, k * 3 + 3, 1, 1).withColumn("date_key", day), path, k, by="date_key", fan_in=fan_in)
        if k % 17 == 5:                 # a reader of the manifest before this batch and its compaction
            assert sorted(r.id for r in segments.read_manifest(spark, path, before).collect()) == list(range(k * 3))
    got = segments.read(spark, path)
    assert sorted(r.id for r in got.collect()) == list(range(3 * n))
    m = segments.load(spark, path)
    assert len(m.segments) < fan_in * 4 and max(s["level"] for s in m.segments) == 3
    day = got.filter(F.col("date_key") == "2024-01-02")
    assert len(day.inputFiles()) <= 2 * fan_in * 4 and "PartitionFilters: [isnotnull(date_key" in day._jdf.queryExecution().executedPlan().toString()
    assert segments.vacuum(spark, path, keep_seconds=-1) > 0      # what was merged goes
    left = os.listdir(os.path.join(path, "data"))
    assert len(left) == len(m.segments) and segments.read(spark, path).count() == 3 * n
    assert len(os.listdir(os.path.join(path, "_manifest"))) <= 4 * segments.KEEP_VERSIONS


def test_a_manifest_is_published_once(spark):
    """Of two writers from the same manifest one must start again."""
    path = os.path.join(tempfile.mkdtemp(), "t")
    segments.append(spark.range(1), path, 0)
    a, b = segments.load(spark, path), segments.load(spark, path)
    a.runs["a"] = b.runs["b"] = {"batch": 0, "rows": 0, "when": 0.0}
    assert segments.commit(spark, path, a) and not segments.commit(spark, path, b)
    segments._update(spark, path, lambda m: m.runs.update(b.runs))
    assert {"a", "b", "run"} <= set(segments.load(spark, path).runs)


def test_cross_batch_duplicates_dropped(spark, sf_dir):
    raw_dir = raw_files(spark, sf_dir)
    root, ck = tempfile.mkdtemp(), tempfile.mkdtemp()
    runner.run_files_available_now(spark, raw_dir, root, ck, topics=[TOPIC_INVENTORY], max_files_per_trigger=1)
    g = runner.read_layer(spark, root, "gold", "fact_inventory_events")
    assert g.count() == g.select("event_id").distinct().count()


def test_windowed_twin_matches_batch_for_closed_windows(spark, sf_dir):
    raw_dir = raw_files(spark, sf_dir)
    src = spark.readStream.schema(spark.read.parquet(raw_dir).schema).option("maxFilesPerTrigger", 1).parquet(raw_dir)
    out, ck = os.path.join(tempfile.mkdtemp(), "o"), tempfile.mkdtemp()
    q = (windowed.orders_per_minute_stream(src.filter(F.col("topic") == TOPIC_ORDER)).writeStream
         .format("parquet").option("path", out).option("checkpointLocation", ck).outputMode("append")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    got = {r.minute: (r.new_orders, r.cancellations) for r in spark.read.parquet(out).collect()}
    from tidemart.plans.live import orders_per_minute
    batch = {r.minute: (r.new_orders, r.cancellations) for r in
             orders_per_minute(Lake(spark, sf_dir).table("fact_orders_stream"), 100000, "2030-01-01").collect()}
    assert got, "no window was closed"
    for m, v in got.items():
        assert batch.get(m, (0, 0)) == v


def test_stock_direction_twin_matches_batch_for_closed_windows(spark, sf_dir):
    raw_dir = raw_files(spark, sf_dir)
    src = spark.readStream.schema(spark.read.parquet(raw_dir).schema).option("maxFilesPerTrigger", 1).parquet(raw_dir)
    out, ck = os.path.join(tempfile.mkdtemp(), "o"), tempfile.mkdtemp()
    q = (windowed.stock_direction_stream(src.filter(F.col("topic") == TOPIC_INVENTORY)).writeStream
         .format("parquet").option("path", out).option("checkpointLocation", ck).outputMode("append")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    got = {r.time_period: (r.stock_in, r.stock_out) for r in spark.read.parquet(out).collect()}
    from tidemart.plans.live import stock_direction
    batch = {r.time_period: (r.stock_in, r.stock_out) for r in
             stock_direction(Lake(spark, sf_dir).table("fact_inventory_events"), 100000, "2030-01-01").collect()}
    assert got
    for m, v in got.items():
        assert batch.get(m) == v


def _deliver(spark, raw_dir, ids, ts="2024-01-05 23:59:30", kafka_ts=None):
    """One file of user events on the file twin of the topic."""
    import datetime as dt
    msg = '{"event_id": "%s", "event_type": "user_login", "timestamp": "%s", "user_id": "U1"}'
    at = dt.datetime.fromisoformat(kafka_ts) if kafka_ts else None
    rows = [(TOPIC_USER, 0, i, at, msg % (e, ts)) for i, e in enumerate(ids)]
    io.write_raw_files(spark.createDataFrame(rows, RAW_EVENT_SCHEMA), raw_dir, 1)


def _drain(spark, raw_dir, root, ck):
    runner.run_files_available_now(spark, raw_dir, root, ck, topics=[TOPIC_USER])


def _gold_ids(spark, root):
    return sorted(r.event_id for r in runner.read_layer(spark, root, "gold", "fact_user_events").collect())


def test_redelivery_replay_and_late_events(spark):
    """Events delivered again, in the next micro-batch or after a restart, with
    another timestamp or an old one, add nothing to Silver or Gold; Bronze
    keeps every delivery. A late event is kept. A micro-batch whose commit was
    lost is run again and leaves the same tables."""
    raw, root, ck = tempfile.mkdtemp(), tempfile.mkdtemp(), tempfile.mkdtemp()
    _deliver(spark, raw, ["E1", "E2"], kafka_ts="2024-01-06 00:00:00")
    _drain(spark, raw, root, ck)
    _deliver(spark, raw, ["E1", "E3"], "2024-01-06 00:00:30", "2024-01-06 00:00:31")
    _drain(spark, raw, root, ck)
    _deliver(spark, raw, ["E4", "E2"], "1970-01-01 00:00:00", "1999-01-01 00:00:00")      # late by its event and its record
    _deliver(spark, raw, ["E5", "E5", "E1"], "1970-01-01 00:00:00", None)
    _drain(spark, raw, root, ck)
    want = ["E1", "E2", "E3", "E4", "E5"]
    assert _gold_ids(spark, root) == want
    bronze = ("bronze", "kafka_raw_events", "ecommerce_user")
    assert runner.read_layer(spark, root, *bronze).count() == 9
    for step in ("raw", "facts"):                     # the last commit of each query is lost
        commits = os.path.join(ck, "ecommerce_user", step, "commits")
        last = max(int(x) for x in os.listdir(commits) if x.isdigit())
        os.remove(os.path.join(commits, str(last)))
        crc = os.path.join(commits, f".{last}.crc")
        if os.path.exists(crc):
            os.remove(crc)
    _drain(spark, raw, root, ck)
    assert _gold_ids(spark, root) == want and runner.read_layer(spark, root, *bronze).count() == 9
    silver = runner.read_layer(spark, root, "silver", ST.TOPICS[TOPIC_USER].silver_table)
    assert silver.count() == 5


def test_ids_are_state_of_the_engine_and_leave_with_the_horizon(spark):
    held = {}
    for horizon in (0, 7):
        raw, root, ck = tempfile.mkdtemp(), tempfile.mkdtemp(), tempfile.mkdtemp()
        for k in range(4):
            _deliver(spark, raw, [f"E{k}a", f"E{k}b"])
        src = io.read_raw_files_stream(spark, raw, 1, TOPIC_USER)
        q = runner.start_topic(src, TOPIC_USER, root, ck, {"availableNow": True}, horizon, steps=("facts",))[0]
        q.awaitTermination()
        assert q.exception() is None
        state = q.recentProgress[-1]["stateOperators"][0]
        assert state["operatorName"] == "dedupeWithinWatermark" and any(k.startswith("rocksdb") for k in state["customMetrics"])
        assert _gold_ids(spark, root) == [f"E{k}{x}" for k in range(4) for x in "ab"]
        held[horizon] = state["numRowsTotal"]
    assert held[7] == 8 > held[0]


def test_new_checkpoint_keeps_rows_of_the_old_one(spark):
    """Batches of another query count from 0 again and replace nothing; what
    the other query accepted is not accepted again."""
    raw, root = tempfile.mkdtemp(), tempfile.mkdtemp()
    _deliver(spark, raw, ["E1"])
    _deliver(spark, raw, ["E2"])
    _drain(spark, raw, root, tempfile.mkdtemp())
    raw = tempfile.mkdtemp()
    _deliver(spark, raw, ["E3", "E1"])
    _drain(spark, raw, root, tempfile.mkdtemp())
    assert _gold_ids(spark, root) == ["E1", "E2", "E3"]


def test_restart_with_a_new_checkpoint(spark, sf_dir):
    raw_dir = raw_files(spark, sf_dir)
    root = tempfile.mkdtemp()
    for _ in range(2):
        runner.run_files_available_now(spark, raw_dir, root, tempfile.mkdtemp(), topics=[TOPIC_INVENTORY])
    g = runner.read_layer(spark, root, "gold", "fact_inventory_events")
    assert g.count() == g.select("event_id").distinct().count() == Lake(spark, sf_dir).table("fact_inventory_events").count()


def test_stored_layers_of_the_stream_are_a_lake(spark, sf_dir):
    """Every layer of the streaming job reads back like that of a batch run."""
    root = tempfile.mkdtemp()
    runner.run_files_available_now(spark, raw_files(spark, sf_dir), root, tempfile.mkdtemp(), topics=[TOPIC_ORDER])
    stored, static = Lake.from_stored(spark, runner.stream_root(root)).topic(TOPIC_ORDER), Lake(spark, sf_dir).topic(TOPIC_ORDER)
    for a, b in ((stored.quarantine.drop("ingested_at"), static.quarantine.drop("ingested_at")), (_undelivered(stored.exploded), _undelivered(static.exploded)),
                 (_undelivered(stored.silver), _undelivered(static.silver)), *[(stored.gold[n], static.gold[n]) for n in static.gold]):
        a = a.select(b.columns)
        assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_batch_and_stream_on_one_root(spark, sf_dir):
    from tidemart.plans.batch_run import run_batch
    root = tempfile.mkdtemp()
    runner.run_files_available_now(spark, raw_files(spark, sf_dir), root, tempfile.mkdtemp(), topics=[TOPIC_ORDER])
    streamed = runner.read_layer(spark, root, "gold", "fact_orders_stream").count()
    run_batch(spark, sf_dir, root)
    assert runner.read_layer(spark, root, "gold", "fact_orders_stream").count() == streamed
    assert Lake.from_stored(spark, root).table("fact_orders_stream").count() == streamed


def test_live_window_prunes_stored_days(spark, sf_dir):
    import datetime as dt

    from tidemart.plans.live import orders_per_minute
    root = tempfile.mkdtemp()
    runner.run_files_available_now(spark, raw_files(spark, sf_dir), root, tempfile.mkdtemp(), topics=[TOPIC_ORDER])
    gold = runner.read_layer(spark, root, "gold", "fact_orders_stream")
    df = orders_per_minute(gold, 1, dt.datetime(2024, 1, 20, 12))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date_key" in plan
    assert df.count() <= orders_per_minute(gold, 100000, dt.datetime(2024, 1, 20, 12)).count()


def test_cart_table_over_restart_and_replay(spark, sf_dir):
    """The kept table equals the batch operator after each run; a micro-batch
    run again, or a new query over the same events, changes nothing."""
    from tidemart.plans.commerce_ops import cart_state
    from tidemart.schemas import TOPIC_CART
    from tidemart.streaming import carts
    log = Lake(spark, sf_dir).raw_events().filter(F.col("topic") == TOPIC_CART)
    root, ck, raw = tempfile.mkdtemp(), tempfile.mkdtemp(), tempfile.mkdtemp()

    def run(checkpoint):
        q = carts.start_carts(io.read_raw_files_stream(spark, raw, 1, TOPIC_CART), root, checkpoint, {"availableNow": True}, buckets=4)
        q.awaitTermination()
        assert q.exception() is None
        return sorted(map(tuple, carts.read_carts(spark, root).collect()))

    def want(delivered):
        gold = ST.process_static(delivered, TOPIC_CART).gold["fact_cart_events"]
        return sorted(map(tuple, cart_state(gold).collect()))

    middle = log.agg(F.expr("percentile_approx(offset, 0.5)")).first()[0]
    io.write_raw_files(log.filter(F.col("offset") > middle), raw, 2)            # the later half first
    assert run(ck) == want(log.filter(F.col("offset") > middle))
    io.write_raw_files(log.filter(F.col("offset") <= middle), raw, 2)
    assert run(ck) == want(log)
    commits = os.path.join(ck, "carts", "commits")
    last = max(int(x) for x in os.listdir(commits) if x.isdigit())
    for name in (str(last), f".{last}.crc"):
        if os.path.exists(os.path.join(commits, name)):
            os.remove(os.path.join(commits, name))
    assert run(ck) == want(log) == run(tempfile.mkdtemp())


def test_upsert_rewrites_touched_buckets_only(spark):
    path = tempfile.mkdtemp() + "/t"
    rows = lambda xs: spark.createDataFrame(xs, "k long, v string, at long")
    segments.upsert(rows([(i, "a", 1) for i in range(40)]), path, 0, "r", ["k"], "at", 8)
    before = {s["bucket"]: s["name"] for s in segments.load(spark, path).segments}
    segments.upsert(rows([(3, "b", 2), (4, "old", 0), (99, "new", 1)]), path, 1, "r", ["k"], "at", 8)
    segments.upsert(rows([(3, "again", 9)]), path, 1, "r", ["k"], "at", 8)               # there already
    after = {s["bucket"]: s["name"] for s in segments.load(spark, path).segments}
    assert 1 <= sum(before.get(b) != n for b, n in after.items()) <= 3
    got = {r.k: (r.v, r["at"]) for r in segments.read_keyed(spark, path).collect()}
    assert got == {**{i: ("a", 1) for i in range(40)}, 3: ("b", 2), 99: ("new", 1)}
