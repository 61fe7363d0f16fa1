"""How much goes to Python at a time."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Rows that are worked on at a time.
ROWS = 1024


def bound_batches(spark: SparkSession | None) -> None:
    """Let no more than ``ROWS`` rows go to Python at a time where the session keeps Spark's default of 10,000.

    A batch of texts is held several times over, beside the heap and in the worker.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark is not None and spark.conf.get(name) == "10000":
        spark.conf.set(name, str(ROWS))
