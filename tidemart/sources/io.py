"""Readers and writers: JDBC, Kafka (and its file twin), layer tables.

Every writer reports its row count through ``DataFrame.observe`` — the count
is collected while the write runs, with no second pass over the data (the
reference cached and counted every frame before writing it).
"""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..schemas import RAW_EVENT_SCHEMA


# ------------------------------------------------------------------ JDBC
def read_jdbc(spark: SparkSession, url: str, table: str, partition_column: str | None = None,
              lower: int | None = None, upper: int | None = None, num_partitions: int | None = None,
              properties: dict | None = None) -> DataFrame:
    """Full-table scan. At scale pass a numeric ``partition_column`` with
    bounds so the scan is split into ``num_partitions`` parallel ranges
    (the reference read each table in a single partition)."""
    r = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    for k, v in (properties or {}).items():
        r = r.option(k, v)
    if partition_column:
        r = (r.option("partitionColumn", partition_column).option("lowerBound", lower)
              .option("upperBound", upper).option("numPartitions", num_partitions or 8))
    return r.load()


def write_jdbc(df: DataFrame, url: str, table: str, mode: str = "append", properties: dict | None = None) -> None:
    w = df.write.format("jdbc").option("url", url).option("dbtable", table).mode(mode)
    for k, v in (properties or {}).items():
        w = w.option(k, v)
    w.save()


class HighWaterMark:
    """The largest key that a job has read and stored: numbered small files,
    each renamed into place, of which the last counts."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _at(self, path: str):
        sc = self.spark.sparkContext
        p = sc._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(sc._jsc.hadoopConfiguration())

    def _versions(self) -> list[int]:
        p, fs = self._at(self.path)
        return sorted(int(s.getPath().getName()) for s in fs.listStatus(p) if s.getPath().getName().isdigit()) if fs.exists(p) else []

    def value(self) -> int | None:
        """The newest mark, None at first."""
        found = self._versions()
        if not found:
            return None
        p, fs = self._at(os.path.join(self.path, str(found[-1])))
        stream = fs.open(p)
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))["mark"]
        finally:
            stream.close()

    def advance(self, value: int) -> None:
        """Store a larger mark; a smaller one changes nothing."""
        now = self.value()
        if now is not None and value <= now:
            return
        found = self._versions()
        aside, fs = self._at(os.path.join(self.path, f".{uuid.uuid4().hex}"))
        out = fs.create(aside, False)
        out.write(bytearray(json.dumps({"mark": int(value)}).encode()))
        out.close()
        if not fs.rename(aside, self._at(os.path.join(self.path, str(found[-1] + 1 if found else 0)))[0]):
            raise OSError(f"the mark below {self.path} was not stored")


CELLS = 256


def jdbc_splits(spark: SparkSession, url: str, table: str, column: str, low: int, high: int, parts: int,
                properties: dict | None = None) -> list[tuple[int, int]]:
    """Ranges of an integer column, ends included, that hold about as many
    rows each. The database counts rows in ``CELLS`` cells of a range; a cell
    with more than a part's rows is counted again in cells of its own, down to
    single values, so skewed keys give even ranges. Counts alone travel."""
    def read(query: str) -> list:
        r = spark.read.format("jdbc").option("url", url).option("query", query)
        for k, v in (properties or {}).items():
            r = r.option(k, v)
        return r.load().collect()

    def cells(lo: int, hi: int) -> list[tuple[int, int, int]]:
        width = max(1, -(-(hi - lo + 1) // CELLS))
        rows = read(f"SELECT cell, COUNT(*) AS n FROM (SELECT ({column} - {lo}) / {width} AS cell FROM {table} WHERE {column} BETWEEN {lo} AND {hi}) c GROUP BY cell")
        return sorted((lo + int(r[0]) * width, min(hi, lo + (int(r[0]) + 1) * width - 1), int(r[1])) for r in rows)

    found = cells(low, high)
    most = max(1, -(-sum(n for *_, n in found) // parts))
    while wide := [c for c in found if c[2] > most and c[1] > c[0]]:
        found = sorted([c for c in found if c not in wide] + [x for lo, hi, _ in wide for x in cells(lo, hi)])
    out: list[tuple[int, int]] = []
    start, held = low, 0
    for i, (_lo, hi, n) in enumerate(found):
        held += n
        following = found[i + 1][2] if i + 1 < len(found) else 0
        if held + following > most and i + 1 < len(found):
            out.append((start, hi))
            start, held = hi + 1, 0
    return [*out, (start, high)]


def read_jdbc_new(spark: SparkSession, url: str, table: str, column: str, mark: HighWaterMark, parts: int = 8,
                  properties: dict | None = None) -> tuple[DataFrame, int | None]:
    """Rows whose integer ``column`` (as the database spells it) is above the mark, and the mark to store
    (``mark.advance``) once they are written; None if there are none. The upper
    end is fixed first, so rows added meanwhile come with the next run. Rows
    without a key are never new. A job that fails before it stores the mark
    reads the same rows again."""
    above = mark.value()
    where = f"WHERE {column} > {above}" if above is not None else f"WHERE {column} IS NOT NULL"
    r = spark.read.format("jdbc").option("url", url).option("query", f"SELECT MIN({column}) AS low, MAX({column}) AS high FROM {table} {where}")
    for k, v in (properties or {}).items():
        r = r.option(k, v)
    low, high = r.load().first()
    if high is None:
        return spark.read.jdbc(url, table, predicates=["1 = 0"], properties=properties or {}), None
    splits = jdbc_splits(spark, url, table, column, int(low), int(high), parts, properties)
    return spark.read.jdbc(url, table, predicates=[f"{column} BETWEEN {a} AND {z}" for a, z in splits], properties=properties or {}), int(high)


# ----------------------------------------------------------------- Kafka
def read_kafka_stream(spark: SparkSession, servers: str, topic: str, max_offsets_per_trigger: int = 5000,
                      starting_offsets: str = "earliest", fail_on_data_loss: bool = False) -> DataFrame:
    """Subscribe one topic; project the raw record shape of RAW_EVENT_SCHEMA.
    Needs the spark-sql-kafka package on the classpath."""
    raw = (spark.readStream.format("kafka")
           .option("kafka.bootstrap.servers", servers).option("subscribe", topic)
           .option("startingOffsets", starting_offsets)
           .option("failOnDataLoss", str(fail_on_data_loss).lower())
           .option("maxOffsetsPerTrigger", max_offsets_per_trigger).load())
    return raw.select(F.col("topic"), F.col("partition").cast("int").alias("partition"),
                      F.col("offset").cast("long").alias("offset"), F.col("timestamp").alias("kafka_timestamp"),
                      F.col("value").cast("string").alias("json_str"))


def topic_dir(topic: str) -> str:
    """One folder per topic, dots to underscores."""
    return topic.replace(".", "_")


#: partition column of a folder of raw record files: the topic's folder name
FEED = "feed"


def write_raw_files(raw: DataFrame, path: str, n_files: int) -> None:
    """Raw records as files below one folder per topic (the Kafka source's
    file twin), split by offset so that files are successive batches."""
    (raw.withColumn(FEED, F.replace("topic", F.lit("."), F.lit("_"))).repartitionByRange(n_files, "offset")
        .write.mode("append").partitionBy(FEED).parquet(path))


def read_raw_files_stream(spark: SparkSession, path: str, max_files_per_trigger: int = 1,
                          topic: str | None = None) -> DataFrame:
    """File twin of the Kafka source: parquet files of RAW_EVENT_SCHEMA rows
    written by `write_raw_files`; each trigger takes ``max_files_per_trigger``.
    The query of a topic lists and reads only the topic's folder."""
    if topic:
        path = os.path.join(path, f"{FEED}={topic_dir(topic)}")
    df = spark.readStream.schema(RAW_EVENT_SCHEMA).option("maxFilesPerTrigger", max_files_per_trigger).parquet(path)
    return df.select(*RAW_EVENT_SCHEMA.names)


def write_kafka(df: DataFrame, servers: str, topic: str) -> None:
    """Serialise each row as one JSON value (the producer side)."""
    (df.select(F.to_json(F.struct(*[F.col(c) for c in df.columns])).alias("value"))
       .write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).save())


def to_event_json(df: DataFrame) -> DataFrame:
    """Envelope + payload as one JSON text per row (``sink_event_json``)."""
    return df.select(F.to_json(F.struct(*[F.col(c) for c in df.columns])).alias("value"))


# ---------------------------------------------------------------- tables
def path_exists(spark: SparkSession, path: str) -> bool:
    """Does a table folder exist (on any Hadoop file system)?"""
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(sc._jsc.hadoopConfiguration()).exists(p))


def write_table(df: DataFrame, path: str, mode: str = "overwrite", partition_by: list[str] | None = None,
                fmt: str = "parquet", own_partitions: bool = False) -> int:
    """Write a layer table; return its row count, observed during the write.

    An overwrite replaces the whole table, so no partition of an earlier
    build stays behind; with ``own_partitions`` it replaces only those that
    ``df`` has rows for (a batch that writes its own partition again)."""
    obs = Observation(f"rows_{uuid.uuid4().hex}")
    w = df.observe(obs, F.count(F.lit(1)).alias("rows")).write.mode(mode).format(fmt)
    if partition_by:
        w = w.partitionBy(*partition_by).option("partitionOverwriteMode", "dynamic" if own_partitions else "static")
    w.save(path)
    return int(obs.get.get("rows", 0))


def write_quarantine(bad: DataFrame, path: str, quarantined_at=None) -> int:
    """Append rejects with ``quarantined_at``; an empty frame writes no rows."""
    ts = F.current_timestamp() if quarantined_at is None else F.lit(str(quarantined_at)).cast("timestamp")
    return write_table(bad.withColumn("quarantined_at", ts), path, mode="append")
