"""Structured Streaming job: two queries per topic.

    raw topic records -> parse -> raw query:   Bronze, validate -> quarantine
                               -> facts query: valid -> dedup -> Silver, Gold

The raw query is stateless and keeps every delivery. The facts query removes
repeated event ids with ``dropDuplicatesWithinWatermark``: the ids are state
of the engine, in its RocksDB store, versioned with the query's checkpoint. A
micro-batch looks up and adds only its own ids, and the watermark removes ids
older than the horizon (7 days by default). The watermark is on arrival time
(the record's timestamp), never on the event's, and an arrival is taken to be
within the horizon of the micro-batch's own clock; so the watermark can't pass
a row, and none is dropped for being late, however old its event or how long
it waited in the topic. Of several deliveries in one micro-batch any one stays.

Layers live below ``<root>/stream`` in the layout of the batch run, as segment
tables (`segments`): each micro-batch is committed once, a replay adds
nothing, and small segments are merged. Gold is partitioned by ``date_key``,
so live windows read their days only.

A new checkpoint starts without ids. While another query's batches in the same
tables are younger than the horizon, the facts query therefore also drops the
ids that Silver holds from it (one anti-join, only then).
"""

from __future__ import annotations

import os
import time
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import stream_topics as ST
from ..schemas import ALL_TOPICS
from ..sources.io import read_raw_files_stream, topic_dir
from . import segments

c = F.col

DEDUP_HORIZON_DAYS = 7
IDLE_BATCHES = "spark.sql.streaming.noDataMicroBatches.enabled"
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def parse_stream(raw: DataFrame, topic: str) -> DataFrame:
    return ST.parse(raw, topic)


def stream_root(root: str) -> str:
    return os.path.join(root, "stream")


def arrival(horizon_days: int = DEDUP_HORIZON_DAYS) -> Column:
    """When a record arrived, as far as the dedup state goes: its record
    timestamp, but within ``horizon_days`` of the micro-batch's clock."""
    now = F.current_timestamp()
    return F.least(now, F.greatest(F.coalesce(c("kafka_timestamp"), now), now - F.expr(f"INTERVAL {int(horizon_days)} DAYS")))


def fresh_events(parsed: DataFrame, topic: str, horizon_days: int = DEDUP_HORIZON_DAYS) -> DataFrame:
    """Valid events of a parsed stream, each id once within the horizon."""
    good = parsed.filter(ST.passes_envelope(topic)).withColumn("_arrived", arrival(horizon_days))
    return good.withWatermark("_arrived", f"{int(horizon_days)} days").dropDuplicatesWithinWatermark(["event_id"]).drop("_arrived")


def _in_parallel(writes: dict) -> dict[str, int]:
    with ThreadPoolExecutor(max_workers=len(writes)) as pool:
        futures = {n: pool.submit(w) for n, w in writes.items()}
        return {n: f.result() for n, f in futures.items()}


def process_raw_batch(batch: DataFrame, batch_id: int, topic: str, root: str, run_id: str = "run") -> dict[str, int]:
    """Bronze and quarantine of one micro-batch; returns rows per table."""
    root, batch = stream_root(root), batch.persist()
    try:
        if batch.isEmpty():
            return {}
        bad = ST.rejected(batch, topic)
        return _in_parallel({
            "bronze_raw_events": lambda: segments.append(batch.select(*ST.COORDS, "json_str", "ingested_at"), os.path.join(root, "bronze", "kafka_raw_events", topic_dir(topic)), batch_id, run_id),
            "quarantine_events": lambda: segments.append(bad, os.path.join(root, "quarantine", "events", topic_dir(topic)), batch_id, run_id)})
    finally:
        batch.unpersist()


def unknown_to_others(fresh: DataFrame, silver_path: str, run_id: str, horizon_days: int = DEDUP_HORIZON_DAYS) -> DataFrame:
    """Without the ids that other queries stored here within the horizon."""
    spark = fresh.sparkSession
    others = segments.other_runs(spark, silver_path, run_id, time.time() - horizon_days * 86400)
    if not others:
        return fresh
    stored = segments.read(spark, silver_path).filter(c("run_id").isin(others)).select("event_id")
    return fresh.join(stored, "event_id", "left_anti").select(*fresh.columns)


def process_fact_batch(fresh: DataFrame, batch_id: int, topic: str, root: str, run_id: str = "run") -> dict[str, int]:
    """Silver and Gold of one micro-batch of fresh events; returns rows per table."""
    root, spec = stream_root(root), ST.TOPICS[topic]
    silver_path = os.path.join(root, "silver", spec.silver_table)
    fresh = fresh.persist()           # before any look at it: each would run the dedup again
    try:
        if fresh.isEmpty():
            return {}
        sv, gold, _ = ST.silver_and_gold(unknown_to_others(fresh, silver_path, run_id), topic)
        # Silver and Gold read the persisted batch and are independent:
        # submit their writes side by side
        writes = {n: lambda n=n, df=df: segments.append(df, os.path.join(root, "gold", n), batch_id, run_id, by="date_key") for n, df in gold.items()}
        writes[spec.silver_table] = lambda: segments.append(sv, silver_path, batch_id, run_id)
        return _in_parallel(writes)
    finally:
        fresh.unpersist()


def _query_id(df: DataFrame) -> str:
    """Id of the streaming query that runs this micro-batch."""
    run = df.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
    if not run:
        raise RuntimeError("not called from a streaming query: pass run_id")
    return run


def use_state_store(spark: SparkSession) -> None:
    """State in RocksDB, unless the session names a store of its own."""
    key = "spark.sql.streaming.stateStore.providerClass"
    if "HDFSBackedStateStoreProvider" in spark.conf.get(key):
        for k, v in STATE_STORE.items():
            spark.conf.set(k, v)


def start_topic(source: DataFrame, topic: str, root: str, checkpoint_root: str,
                trigger: dict | None = None, horizon_days: int = DEDUP_HORIZON_DAYS,
                steps: tuple[str, ...] = ("raw", "facts")) -> list[StreamingQuery]:
    """Start the two queries of one topic, or one of them (trigger default: every 60 s)."""
    spark = source.sparkSession
    use_state_store(spark)
    idle = spark.conf.get(IDLE_BATCHES)
    spark.conf.set(IDLE_BATCHES, "false")     # ids leave the state with the next batch that has rows
    parsed = parse_stream(source, topic)
    known = {"raw": (parsed, process_raw_batch), "facts": (fresh_events(parsed, topic, horizon_days), process_fact_batch)}
    out = []
    for name in steps:
        stream, step = known[name]
        w = (stream.writeStream.queryName(f"tidemart_{topic_dir(topic)}_{name}")
             .foreachBatch(lambda df, bid, step=step: step(df, bid, topic, root, _query_id(df)))
             .option("checkpointLocation", os.path.join(checkpoint_root, topic_dir(topic), name)))
        out.append(w.trigger(**(trigger or {"processingTime": "60 seconds"})).start())
    spark.conf.set(IDLE_BATCHES, idle)
    return out


def start_all(sources: dict[str, DataFrame], root: str, checkpoint_root: str,
              trigger: dict | None = None) -> list[StreamingQuery]:
    """Two queries per topic; the caller waits with
    ``spark.streams.awaitAnyTermination()``."""
    return [q for t in ALL_TOPICS if t in sources for q in start_topic(sources[t], t, root, checkpoint_root, trigger)]


def run_files_available_now(spark: SparkSession, raw_dir: str, root: str, checkpoint_root: str,
                            topics: list[str] | None = None, max_files_per_trigger: int = 1,
                            steps: tuple[str, ...] = ("raw", "facts")) -> None:
    """Drain a folder of raw record files through every topic's queries once
    (tests and backfills): ``availableNow`` processes what is there, in
    ``max_files_per_trigger`` steps, then stops."""
    qs = []
    for t in topics or ALL_TOPICS:
        src = read_raw_files_stream(spark, raw_dir, max_files_per_trigger, topic=t)
        qs += start_topic(src, t, root, checkpoint_root, trigger={"availableNow": True}, steps=steps)
    for q in qs:
        q.awaitTermination()
        if q.exception():
            raise q.exception()


def read_layer(spark: SparkSession, root: str, *parts: str) -> DataFrame:
    """A layer table of the streaming job."""
    return segments.read(spark, os.path.join(stream_root(root), *parts))
