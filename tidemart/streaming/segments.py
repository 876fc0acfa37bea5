"""Append-only tables of a streaming job: segments listed in a manifest.

A micro-batch writes one segment (a folder of Parquet, partitioned like the
table); what a table holds is what its newest manifest lists. The manifest
is a small JSON file, replaced by a rename that fails if another writer was
first, so a reader sees the table before or after a commit and nothing else.

* A batch is committed once: the manifest keeps the last batch of each run
  (query), and a replay of it finds its rows there. A batch that failed
  before its commit left a folder that no manifest lists; the replay
  overwrites it.
* Segments have levels. As soon as a level has ``FAN_IN`` of them, they are
  rewritten as one of the next, and one commit swaps them. So a table of n
  batches has at most ``FAN_IN`` segments for each of log(n) levels, a day has
  that many files (more only where the data fill them), and a row is rewritten
  once a level.
* Swapped segments stay on disk for ``KEEP_SECONDS``, so readers that hold the
  manifest before finish; then they go.

Columns ``run_id`` and ``batch_id`` name the batch each row came with.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from dataclasses import asdict, dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources.io import path_exists, write_table

FAN_IN, KEEP_SECONDS, KEEP_VERSIONS, ATTEMPTS = 16, 3600, 20, 20
LIVE, DATA = "_manifest", "data"


@dataclass
class Manifest:
    version: int = 0
    schema: dict | None = None
    by: str | None = None
    runs: dict[str, dict] = field(default_factory=dict)       # run -> last batch, its rows, when
    segments: list[dict] = field(default_factory=list)        # name, level, rows
    retired: list[dict] = field(default_factory=list)         # name, when


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _delete(spark: SparkSession, path: str) -> None:
    _, p, fs = _fs(spark, path)
    fs.delete(p, True)


def is_table(spark: SparkSession, path: str) -> bool:
    return path_exists(spark, os.path.join(path, LIVE))


def _versions(spark: SparkSession, path: str) -> list[int]:
    if not is_table(spark, path):
        return []
    _, p, fs = _fs(spark, os.path.join(path, LIVE))
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def _file(path: str, version: int) -> str:
    return os.path.join(path, LIVE, f"{version:012d}.json")


def load(spark: SparkSession, path: str) -> Manifest:
    """The newest manifest; an empty one if the table doesn't exist yet."""
    versions = _versions(spark, path)
    if not versions:
        return Manifest()
    jvm, p, fs = _fs(spark, _file(path, versions[-1]))
    stream = fs.open(p)
    try:
        return Manifest(**json.loads(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
    finally:
        stream.close()


def commit(spark: SparkSession, path: str, manifest: Manifest) -> bool:
    """Publish ``manifest`` as the version after the one it was made from;
    False if another writer published that version before."""
    final = Manifest(**{**asdict(manifest), "version": manifest.version + 1})
    target = _file(path, final.version)
    jvm, temp, fs = _fs(spark, os.path.join(path, LIVE, f".{uuid.uuid4().hex}.tmp"))
    out = fs.create(temp, False)
    out.write(bytearray(json.dumps(asdict(final)).encode()))
    out.close()
    gateway = spark.sparkContext._gateway
    rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    options = gateway.new_array(rename, 1)
    options[0] = rename.NONE
    p = jvm.org.apache.hadoop.fs.Path(target)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    try:
        context.rename(context.makeQualified(temp), context.makeQualified(p), options)
    except Py4JJavaError as e:
        fs.delete(temp, False)
        if "FileAlreadyExists" in str(e.java_exception.getClass().getName()):
            return False
        raise
    if final.version > KEEP_VERSIONS:
        _delete(spark, _file(path, final.version - KEEP_VERSIONS))
    manifest.version = final.version
    return True


def _update(spark: SparkSession, path: str, change) -> Manifest | None:
    """Apply ``change(manifest)`` to the newest manifest and publish it; again
    from the new one if another writer was first. ``change`` returns False to
    give up (nothing is published then)."""
    for _ in range(ATTEMPTS):
        m = load(spark, path)
        if change(m) is False:
            return None
        if commit(spark, path, m):
            return m
    raise RuntimeError(f"no commit to {path} in {ATTEMPTS} attempts: too many writers")


def _segment(path: str, name: str) -> str:
    return os.path.join(path, DATA, f"segment={name}")


def append(df: DataFrame, path: str, batch_id: int, run_id: str = "run", by: str | None = None, fan_in: int = FAN_IN) -> int:
    """Add one micro-batch; returns its rows. A batch at or before the run's
    last one is there already and is not written again."""
    spark, batch_id = df.sparkSession, int(batch_id)
    last = load(spark, path).runs.get(run_id)
    if last and batch_id <= last["batch"]:
        return last["rows"] if batch_id == last["batch"] else 0
    df = df.withColumns({"run_id": F.lit(run_id), "batch_id": F.lit(batch_id).cast("long")})
    name = f"{run_id}-{batch_id:012d}"
    rows = write_table(df.hint("rebalance", by) if by else df, _segment(path, name), partition_by=[by] if by else None)

    def add(m: Manifest):
        m.schema, m.by = json.loads(df.schema.json()), by
        m.runs[run_id] = {"batch": batch_id, "rows": rows, "when": time.time()}
        if rows:
            m.segments.append({"name": name, "level": 0, "rows": rows})

    m = _update(spark, path, add)
    if not rows:
        _delete(spark, _segment(path, name))
    if len([s for s in m.segments if s["level"] == 0]) >= fan_in:
        compact(spark, path, fan_in)
    return rows


def read_manifest(spark: SparkSession, path: str, m: Manifest, names: list[str] | None = None) -> DataFrame:
    """The rows of a manifest (or of some of its segments)."""
    schema = StructType.fromJson(m.schema)
    names = [s["name"] for s in m.segments] if names is None else names
    if not names:
        return spark.createDataFrame([], schema)
    df = spark.read.schema(schema).option("basePath", os.path.join(path, DATA)).parquet(*[_segment(path, n) for n in names])
    return df.select(*[f"`{c}`" for c in schema.names])


def read(spark: SparkSession, path: str) -> DataFrame:
    """The table as of its newest manifest. A filter on its partition column
    reads only those folders."""
    m = load(spark, path)
    if m.schema is None:
        raise FileNotFoundError(path)
    return read_manifest(spark, path, m)


def compact(spark: SparkSession, path: str, fan_in: int = FAN_IN, keep_seconds: float = KEEP_SECONDS) -> int:
    """Rewrite full levels, the lowest first; returns the segments replaced."""
    replaced = 0
    while True:
        m = load(spark, path)
        levels = sorted({s["level"] for s in m.segments})
        full = next((x for x in levels if sum(s["level"] == x for s in m.segments) >= fan_in), None)
        if full is None:
            break
        old = [s["name"] for s in m.segments if s["level"] == full]
        name = f"merged-{uuid.uuid4().hex}"
        df = read_manifest(spark, path, m, old)
        rows = write_table(df.hint("rebalance", m.by) if m.by else df.hint("rebalance"), _segment(path, name), partition_by=[m.by] if m.by else None)

        def swap(now: Manifest, old=old, name=name, rows=rows, level=full + 1):
            if not set(old) <= {s["name"] for s in now.segments}:
                return False                    # another writer has replaced some of them
            now.segments = [s for s in now.segments if s["name"] not in old] + [{"name": name, "level": level, "rows": rows}]
            now.retired += [{"name": n, "when": time.time()} for n in old]

        if _update(spark, path, swap) is None:
            _delete(spark, _segment(path, name))
            break
        replaced += len(old)
    vacuum(spark, path, keep_seconds)
    return replaced


def vacuum(spark: SparkSession, path: str, keep_seconds: float = KEEP_SECONDS) -> int:
    """Delete segments that were swapped out more than ``keep_seconds`` ago."""
    before = time.time() - keep_seconds
    gone = {r["name"] for r in load(spark, path).retired if r["when"] < before}
    for name in gone:
        _delete(spark, _segment(path, name))

    def forget(m: Manifest):
        m.retired = [r for r in m.retired if r["name"] not in gone]

    if gone:
        _update(spark, path, forget)
    return len(gone)


def other_runs(spark: SparkSession, path: str, run_id: str, since: float) -> list[str]:
    """Runs other than ``run_id`` that committed after ``since``."""
    return sorted(r for r, x in load(spark, path).runs.items() if r != run_id and x["when"] >= since)


# ------------------------------------------------------------- keyed tables
BUCKET = "bucket"


def upsert(updates: DataFrame, path: str, batch_id: int, run_id: str, keys: list[str], newest: str, buckets: int = 64) -> int:
    """Merge one micro-batch of rows by key into a table of one row a key; of
    two rows of a key the one with the larger ``newest`` stays, the update on
    ties. Returns the rows of the buckets written.

    Rows are dealt to ``buckets`` by a hash of the keys. Only the buckets that
    the batch touches are read and written; a manifest says which segment holds
    each bucket, so readers see all of a batch or nothing. A batch at or before
    the run's last one is there already."""
    spark, batch_id = updates.sparkSession, int(batch_id)
    last = load(spark, path).runs.get(run_id)
    if last and batch_id <= last["batch"]:
        return last["rows"] if batch_id == last["batch"] else 0
    others = [x for x in updates.columns if x not in keys]
    updates = updates.withColumn(BUCKET, F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")).persist()
    try:
        touched = sorted(r[0] for r in updates.select(BUCKET).distinct().collect())      # at most `buckets`
        name, done = f"{run_id}-{batch_id:012d}", {}

        def merge(m: Manifest) -> None:
            held = {s["bucket"]: s["name"] for s in m.segments}
            version = tuple(held.get(b) for b in touched)
            if done.get("version") != version:          # first attempt, or another writer changed these buckets
                rows = updates.withColumn("_new", F.lit(1))
                if any(version):
                    old = _read_buckets(spark, path, StructType.fromJson(m.schema), {b: held[b] for b in touched if b in held})
                    rows = rows.unionByName(old.withColumn("_new", F.lit(0)))
                best = F.max_by(F.struct(*others), F.struct(newest, "_new")).alias("_row")
                merged = rows.groupBy(BUCKET, *keys).agg(best).select(*keys, "_row.*", BUCKET)
                done.update(version=version, rows=write_table(merged.hint("rebalance", BUCKET), _segment(path, name), partition_by=[BUCKET]))
            m.schema = json.loads(updates.schema.json())
            m.runs[run_id] = {"batch": batch_id, "rows": done["rows"], "when": time.time()}
            m.segments = [s for s in m.segments if s["bucket"] not in touched] + [{"name": name, "bucket": b} for b in touched]
            gone = set(held.values()) - {s["name"] for s in m.segments}
            m.retired += [{"name": n, "when": time.time()} for n in sorted(gone)]

        _update(spark, path, merge)
        vacuum(spark, path)
        return done["rows"]
    finally:
        updates.unpersist()


def _read_buckets(spark: SparkSession, path: str, schema: StructType, held: dict[int, str]) -> DataFrame:
    paths = [os.path.join(_segment(path, n), f"{BUCKET}={b}") for b, n in held.items()]
    if not paths:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", os.path.join(path, DATA)).parquet(*paths).select(*schema.names)


def read_keyed(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a table that `upsert` writes."""
    m = load(spark, path)
    if m.schema is None:
        raise FileNotFoundError(path)
    return _read_buckets(spark, path, StructType.fromJson(m.schema), {s["bucket"]: s["name"] for s in m.segments}).drop(BUCKET)
