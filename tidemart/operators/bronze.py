"""Bronze: raw snapshots with audit columns; nothing is transformed."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def new_batch_id(now: dt.datetime | None = None) -> str:
    """One id per run, ``yyyyMMdd_HHmmss``, shared by all tables of the run."""
    return (now or dt.datetime.now(dt.timezone.utc)).strftime("%Y%m%d_%H%M%S")


def bronze_snapshot(df: DataFrame, table: str, batch_id: str, ingested_at=None) -> DataFrame:
    """Source rows + ``ingested_at``, ``batch_id``, ``source``."""
    ts = F.current_timestamp() if ingested_at is None else F.lit(str(ingested_at)).cast("timestamp")
    return df.withColumns({
        "ingested_at": ts,
        "batch_id": F.lit(batch_id),
        "source": F.lit(f"postgresql.{table}"),
    })


def bronze_users(users: DataFrame, batch_id: str, ingested_at=None) -> DataFrame:
    """The password never reaches storage."""
    return bronze_snapshot(users.drop("password"), "users", batch_id, ingested_at)


def bronze_raw_events(raw: DataFrame, ingested_at=None) -> DataFrame:
    """Untouched message text + topic coordinates + ingested_at."""
    ts = F.current_timestamp() if ingested_at is None else F.lit(str(ingested_at)).cast("timestamp")
    return raw.select("topic", "partition", "offset", "kafka_timestamp", "json_str",
                      ts.alias("ingested_at"))
