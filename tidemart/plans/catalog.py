"""SQL access to the layers: temp views, ``query_sql`` and result caches.

``query_sql`` runs a SQL text over the registered views and raises on error
(the reference swallowed errors into an empty frame). ``QueryCache`` keeps
results persisted for a time-to-live and can be invalidated explicitly,
which Spark's own cache has no notion of. ``SharedQueryCache`` stores results
as tables, so that other sessions and applications find them.
"""

from __future__ import annotations

import hashlib
import json
import os
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..lake import GOLD_TABLES, STREAM_GOLD_TABLES, Lake


def register_views(lake: Lake, names: list[str] | None = None) -> list[str]:
    """Expose Gold tables (batch and stream) as temp views of their name."""
    names = names or GOLD_TABLES + STREAM_GOLD_TABLES
    for n in names:
        lake.table(n).createOrReplaceTempView(n)
    return names


def query_sql(spark: SparkSession, sql: str) -> DataFrame:
    return spark.sql(sql)


class QueryCache:
    """SQL text -> persisted result, for ``ttl_seconds`` (dashboard default
    300 s). ``invalidate()`` drops one entry or all of them."""

    def __init__(self, spark: SparkSession, ttl_seconds: float = 300.0):
        self.spark, self.ttl = spark, ttl_seconds
        self._entries: dict[str, tuple[float, DataFrame]] = {}

    def get(self, sql: str) -> DataFrame:
        now = time.monotonic()
        hit = self._entries.get(sql)
        if hit and now - hit[0] < self.ttl:
            return hit[1]
        if hit:
            hit[1].unpersist()
        df = query_sql(self.spark, sql).persist()
        self._entries[sql] = (now, df)
        return df

    def invalidate(self, sql: str | None = None) -> None:
        keys = [sql] if sql else list(self._entries)
        for k in keys:
            hit = self._entries.pop(k, None)
            if hit:
                hit[1].unpersist()


class SharedQueryCache:
    """Results as Parquet below ``root``, a folder all sessions share.

    A result's key is the query's canonical plan (names of views, aliases of
    columns inside and the order of equal conditions don't matter) and the
    version of the tables it reads: the names of their files, which differ
    after any rewrite or append. So a rewritten table is a miss at once, and a
    query over unchanged tables a hit until ``ttl_seconds`` have passed. Plans
    that read the clock or draw numbers differ each time and never hit.

    A result is written aside and renamed into place: readers see all of it or
    nothing, and of two writers one's result stays. Results are removed when
    twice their time has passed, so a reader that found one can finish."""

    def __init__(self, spark: SparkSession, root: str, ttl_seconds: float = 300.0):
        self.spark, self.root, self.ttl = spark, root, ttl_seconds

    def key(self, df: DataFrame) -> str:
        plan = df._jdf.queryExecution().optimizedPlan().canonicalized().toString()
        names = json.dumps([plan, df.schema.json(), sorted(df.inputFiles())])
        return hashlib.sha256(names.encode()).hexdigest()

    def _folder(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _stored(self, key: str) -> list[tuple[int, str]]:
        """(milliseconds when made, path) of the results of a key, newest first."""
        p, fs = self._folder(os.path.join(self.root, key))
        if not fs.exists(p):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        return sorted(((int(n.split("-")[0]), os.path.join(self.root, key, n)) for n in names if n[:1].isdigit()), reverse=True)

    def get(self, query: str | DataFrame) -> DataFrame:
        """The result of a SQL text or a DataFrame, stored or computed."""
        return self.fetch(query)[0]

    def fetch(self, query: str | DataFrame) -> tuple[DataFrame, bool]:
        """(result, whether it was stored already)."""
        df = query_sql(self.spark, query) if isinstance(query, str) else query
        key, now = self.key(df), int(time.time() * 1000)
        for made, path in self._stored(key):
            if now - made < self.ttl * 1000:
                return self.spark.read.schema(df.schema).parquet(path), True
            if now - made > 2 * self.ttl * 1000:
                old, fs = self._folder(path)
                fs.delete(old, True)
        aside = os.path.join(self.root, key, f"_{uuid.uuid4().hex}")
        df.write.parquet(aside)
        final = os.path.join(self.root, key, f"{now}-{uuid.uuid4().hex[:8]}")
        (a, fs), (b, _) = self._folder(aside), self._folder(final)
        if not fs.rename(a, b):
            raise OSError(f"{aside} was not renamed to {final}")
        return self.spark.read.schema(df.schema).parquet(final), False

    def invalidate(self, query: str | DataFrame) -> None:
        df = query_sql(self.spark, query) if isinstance(query, str) else query
        p, fs = self._folder(os.path.join(self.root, self.key(df)))
        fs.delete(p, True)
