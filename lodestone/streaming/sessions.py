"""Session state in Structured Streaming: an epoch and a position for each session.

Files may come in any order and any number of batches.  The state is kept for
each session and minute, counts alike whichever event comes first, and minutes
are put together by time at the end, so no session is gathered in one place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Files of a batch.
FILES = 1000


def session_states(events: DataFrame) -> DataFrame:
    """A stream of events (event_id, ts, user_id, reset) to a stream of the states of each session's minutes as they change.

    A state has the minute's events and resets, and ``after``: the events after
    its last reset, in order of time and id, nulls last; all, if it has none.
    """
    place = F.struct(F.col("ts").isNull().alias("no_ts"), "ts", F.col("event_id").isNull().alias("no_id"), "event_id")
    reset = F.coalesce("reset", F.lit(False))
    minutes = events.groupBy("user_id", F.date_trunc("minute", "ts").alias("minute")).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(reset).alias("resets"),
        F.max(F.when(reset, place)).alias("last"),
        F.collect_list(F.when(~reset, place)).alias("others"),
    )
    after = F.when(F.col("last").isNull(), F.size("others")).otherwise(F.size(F.filter("others", lambda x: x > F.col("last"))))
    return minutes.select("user_id", "minute", "n", "resets", after.cast("long").alias("after"))


def merged(states: DataFrame) -> DataFrame:
    """The sessions' states (user_id, epoch, depth, n_events) from the last state of each of their minutes."""
    minutes = states.withColumn("at", F.struct(F.col("minute").isNull().alias("no_minute"), "minute"))
    totals = minutes.groupBy(F.col("user_id").alias("user")).agg(
        F.sum("resets").alias("epoch"), F.sum("n").alias("n_events"), F.max(F.when(F.col("resets") > 0, F.struct("at", "after"))).alias("last")
    )
    later = minutes.join(totals, F.col("user_id").eqNullSafe(F.col("user"))).where("last IS NULL OR at > last.at")
    later = later.groupBy("user_id").agg(F.sum("n").alias("later"))
    depth = F.coalesce("last.after", F.lit(0)) + F.coalesce("later", F.lit(0))
    return totals.join(later, F.col("user_id").eqNullSafe(F.col("user")), "left").select(
        F.col("user").alias("user_id"), F.col("epoch").cast("long"), depth.cast("long").alias("depth"), F.col("n_events").cast("long")
    )


def run_to_end(events_path: str, spark, out_path: str, checkpoint: str, files: int = FILES) -> DataFrame:
    """Read all files under ``events_path`` as a stream, ``files`` a batch, and give the last state of every session."""
    schema = spark.read.parquet(events_path).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(events_path)
    rows = stream.select("event_id", "ts", "user_id", (F.col("event_type") == "error").alias("reset"))
    query = (
        session_states(rows)
        .writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{out_path}/batch={n}"))
        .start()
    )
    query.awaitTermination()
    states = spark.read.option("recursiveFileLookup", True).parquet(out_path)
    # A minute's events only become more, so its last state is the one with the most.
    states = states.groupBy("user_id", "minute").agg(F.max_by(F.struct("n", "resets", "after"), "n").alias("s")).select("user_id", "minute", "s.*")
    return merged(states)
