"""tidemart: a PySpark-native commerce analytics library.

Medallion ETL (Bronze, Silver with quarantine, Gold star schema), per-topic
Structured Streaming with idempotent sinks, live/sales/advisor/forecast
queries and storefront operators, all as DataFrame and SQL plans.

Entry points: ``tidemart.lake.Lake`` (every layer of a data folder),
``tidemart.plans.batch_run.run_batch`` (one written medallion run),
``tidemart.streaming.runner.start_all`` (one streaming query per topic),
``tidemart.registry`` (operator name -> query and DuckDB oracle).
"""

__version__ = "0.1.0"
