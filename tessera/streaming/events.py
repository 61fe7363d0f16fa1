"""Event-time operators that read the same from a batch and from a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT_SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, folder: str, delay: str = "10 minutes") -> DataFrame:
    """Parquet files of a folder as a stream with a watermark."""
    return spark.readStream.schema(EVENT_SCHEMA).parquet(folder).withWatermark("ts", delay)


def tumbling(events: DataFrame, width: str = "1 hour") -> DataFrame:
    out = events.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))
    return out.select(F.col("window.start").alias("started"), "event_type", "n", "value")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    out = events.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"), F.sum("value").alias("value"))
    return out.select("user_id", F.col("session_window.start").alias("started"), "n", "value")


def first_of_key(events: DataFrame, keys: list[str]) -> DataFrame:
    """At-most-once entries: later duplicates within the watermark are dropped."""
    return events.dropDuplicatesWithinWatermark(keys) if events.isStreaming else events.dropDuplicates(keys)


def append_stream(stream: DataFrame, target: str, checkpoint: str):
    """Run what is there to an append-only Parquet table, exactly once, then stop."""
    return stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


RUN_END = "run_id long, n_steps long, outcome string, spent double"


def run_ends(steps: DataFrame, cost_limit: float = 0.10, attempts: int = 2) -> DataFrame:
    """One row for each run of a stream of steps (run_id, ts, step_id, kind, cost) when it ends, by the rules of ``evidence.run_outcomes``.

    A run's state is four numbers. Steps are taken in order of (ts, step_id) within a
    micro-batch and in order of arrival across them; steps behind the end are dropped.
    """
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    def step(key, batches, state):
        n, spent, fails, ended = state.get if state.exists else (0, 0.0, 0, False)
        out = []
        for row in pd.concat(list(batches)).sort_values(["ts", "step_id"]).itertuples():
            if ended:
                break
            n, spent, fails = n + 1, spent + row.cost, fails + (row.kind == "fail")
            outcome = "resource_exhausted" if round(spent, 9) >= cost_limit else "terminal_quality_exhausted" if row.kind == "fail" and fails >= attempts else "published" if row.kind == "publish" else None
            if outcome:
                ended = True
                out.append((key[0], n, outcome, spent))
        state.update((n, spent, fails, ended))
        yield pd.DataFrame(out, columns=["run_id", "n_steps", "outcome", "spent"])

    return steps.groupBy("run_id").applyInPandasWithState(step, RUN_END, "n long, spent double, fails long, ended boolean", "append", GroupStateTimeout.NoTimeout)
