"""Analytics jobs on PySpark: tables, streams, models and event logs."""
