"""Command line: the batch run and the streaming job.

    python -m tidemart batch  --sf-dir DIR --out ROOT [--as-of TS] [--no-partition]
    python -m tidemart stream --raw-dir DIR --out ROOT --checkpoint CK [--available-now]
    python -m tidemart stream --kafka HOST:PORT --out ROOT --checkpoint CK

On a cluster, run through spark-submit; the session's master and settings
come from the launcher.
"""

from __future__ import annotations

import argparse
import json

from .functions.timefilter import parse_as_of
from .lake import FACT_MONTH, ORDERS_AS_OF
from .operators.bronze import new_batch_id
from .plans.batch_run import run_batch
from .schemas import ALL_TOPICS
from .session import build_session
from .sources.io import read_kafka_stream, read_raw_files_stream
from .streaming import runner


def main(argv=None) -> None:
    p = argparse.ArgumentParser(prog="tidemart")
    sub = p.add_subparsers(dest="cmd", required=True)
    b = sub.add_parser("batch")
    b.add_argument("--sf-dir", required=True)
    b.add_argument("--out", required=True)
    b.add_argument("--as-of", default=None)
    b.add_argument("--no-partition", action="store_true")
    s = sub.add_parser("stream")
    s.add_argument("--raw-dir")
    s.add_argument("--kafka")
    s.add_argument("--out", required=True)
    s.add_argument("--checkpoint", required=True)
    s.add_argument("--available-now", action="store_true")
    s.add_argument("--trigger-seconds", type=int, default=60)
    a = p.parse_args(argv)
    spark = build_session()
    if a.cmd == "batch":
        as_of = parse_as_of(a.as_of) or ORDERS_AS_OF
        counts = run_batch(spark, a.sf_dir, a.out, as_of=as_of, batch_id=new_batch_id(),
                           fact_partition=None if a.no_partition else FACT_MONTH)
        print(json.dumps(counts, indent=1))
        return
    if a.raw_dir and a.available_now:
        runner.run_files_available_now(spark, a.raw_dir, a.out, a.checkpoint)
        return
    trigger = {"availableNow": True} if a.available_now else {"processingTime": f"{a.trigger_seconds} seconds"}
    sources = {t: (read_kafka_stream(spark, a.kafka, t) if a.kafka else read_raw_files_stream(spark, a.raw_dir, topic=t))
               for t in ALL_TOPICS}
    runner.start_all(sources, a.out, a.checkpoint, trigger)
    spark.streams.awaitAnyTermination()


if __name__ == "__main__":
    main()
