"""Shared helpers of the operators in this subpackage."""

from __future__ import annotations

import sys
import types
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path

ARROW_ROWS, ARROW_BYTES = "2000", "8m"


def prepare(spark: SparkSession) -> None:
    """Bound the Arrow batches (rows and bytes) unless the user chose a bound:
    a batch of long texts must fit a Python worker."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") in ("67108864b", "64m", "64MB"):
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared checkpoint folder and read it
    back: cuts the lineage, and a lost executor loses nothing of it. The
    shuffle files behind it go once it is written."""
    spark, key = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    path = scratch_path(spark, f"llm-{name}-{uuid.uuid4().hex}")
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(key, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def release(*staged: DataFrame) -> None:
    """Drop tables that `stage` wrote, once what was made of them is staged itself."""
    for df in staged:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._staged_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def col(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def utf8(name: str) -> Column:
    """The UTF-8 bytes of a text column; null counts as the empty text."""
    return F.coalesce(col(name).cast("string"), F.lit("")).cast("binary")


def append(df: DataFrame, inputs: list[Column], fields: list[T.StructField],
           factory: Callable[[], Callable], drop: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with ``fields`` appended, computed batch by batch in Arrow.

    ``factory()`` runs once per task and returns f(*input arrays) -> list of
    arrays. Columns of ``df`` pass through; one with the name of a new field
    is replaced by it; those in ``drop`` go."""
    gone = {f.name.lower() for f in fields} | {d.lower() for d in drop}
    kept = [c for c in df.columns if c.lower() not in gone]
    schema = T.StructType([df.schema[c] for c in kept] + fields)
    src = df.select(*[col(c) for c in kept], *[e.alias(f"__llm_in{i}") for i, e in enumerate(inputs)])
    n, names = len(kept), kept + [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = factory()
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays(b.columns[:n] + f(*b.columns[n:]), names=names)

    return src.mapInArrow(run, schema)


def worker_cache() -> dict:
    """A dict that lives as long as the Python worker, across its tasks."""
    return sys.modules.setdefault("_tidemart_llm_cache", types.ModuleType("_tidemart_llm_cache")).__dict__


def cached(key: tuple, make: Callable):
    """Per-worker value of ``make()``; one value per kind (key[0]) is kept."""
    c = worker_cache()
    if c.get(key[0], (None,))[0] != key:
        c[key[0]] = (key, make())
    return c[key[0]][1]


def field(name: str, ddl: str) -> T.StructField:
    return T.StructField(name, T.DataType.fromDDL(ddl), True)
