"""The job queue as a stream: states of jobs, folded from their events, and progress by time window."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE = "attempts int, status string, handled long"


def job_states(events: DataFrame, max_attempts: int = 3) -> DataFrame:
    """user_id, status, attempts, handled after each batch, for a stream of events(user_id, event_type, ts, event_id).

    A purchase completes a job and clears its attempts, an error is a failed attempt, and a job that has failed max_attempts
    times is failed until it completes; other events leave it as it is. Events of a batch are folded in the order of time.
    """

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        attempts, status, handled = state.get if state.exists else (0, "pending", 0)
        # of each chunk, only the last purchase and the places of the errors after it are held
        done, failed = None, []
        for rows in batches:
            handled += len(rows)
            at = pd.MultiIndex.from_frame(rows[["ts", "event_id"]])
            bought = at[(rows["event_type"] == "purchase").to_numpy()]
            if len(bought):
                done = max(bought) if done is None else max(done, max(bought))
            failed.append(at[(rows["event_type"] == "error").to_numpy()])
            failed = [x for x in (f if done is None else f[f > done] for f in failed) if len(x)]
        errors = sum(map(len, failed))
        attempts = errors if done is not None else attempts + errors
        if errors:
            status = "failed" if attempts >= max_attempts else "pending"
        elif done is not None:
            status = "completed"
        state.update((int(attempts), status, int(handled)))
        yield pd.DataFrame({"user_id": [key[0]], "status": [status], "attempts": [attempts], "handled": [handled]})

    return events.groupBy("user_id").applyInPandasWithState(fold, "user_id long, status string, attempts int, handled long", STATE, "update", GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, size: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Events by window and type; windows close when the watermark has passed them."""
    stamped = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return stamped.groupBy(F.window("at", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def run_to_table(stream: DataFrame, folder: str, mode: str) -> DataFrame:
    """Process all that is there, batch by batch, into a table under folder; each row has the number of its batch."""
    spark = stream.sparkSession

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")

    # each batch overwrites its own folder, so that a repeated batch does not count twice
    job = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(put).start()
    job.awaitTermination()
    return spark.read.parquet(f"{folder}/rows")
