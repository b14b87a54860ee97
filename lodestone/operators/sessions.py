"""Sessions as batch transformations: resets, positions, breadcrumbs.

A session's events are cut into buckets of time.  Resets are counted by bucket,
buckets are summed in order, and only then are the events of a bucket ordered,
so a session with very many events is many small groups and not one large.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def islands(events: DataFrame, key: str, order: list[str], bucket: Column, reset: Column) -> DataFrame:
    """``events`` with ``epoch`` (resets so far, the own one included) and ``depth`` (events since the last reset).

    ``bucket`` must ascend with ``order``.  A reset has depth 0; before the first
    reset depth counts from 1.
    """
    rows = events.withColumn("_bucket", bucket).withColumn("_reset", F.when(F.coalesce(reset, F.lit(False)), 1).otherwise(0))
    place = F.struct(*order)
    ends = rows.groupBy(key, "_bucket").agg(F.sum("_reset").alias("_resets"), F.count(F.lit(1)).alias("_n"), F.max(F.when(F.col("_reset") == 1, place)).alias("_last"))
    # Events after a bucket's last reset, which those of later buckets still count.
    after = rows.join(ends.where("_last IS NOT NULL").select(key, "_bucket", "_last"), [key, "_bucket"]).where(place > F.col("_last"))
    after = after.groupBy(key, "_bucket").agg(F.count(F.lit(1)).alias("_after"))
    ends = ends.join(after, [key, "_bucket"], "left").withColumn("_tail", F.when(F.col("_resets") > 0, F.coalesce("_after", F.lit(0))).otherwise(F.col("_n")))
    before = Window.partitionBy(key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("_epochs", F.coalesce(F.sum("_resets").over(before), F.lit(0)))
    since = Window.partitionBy(key, "_epochs").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    # Buckets with equal counts of earlier resets follow the same reset's bucket.
    ends = ends.withColumn("_prior", F.lag(F.struct("_epochs", "_tail")).over(Window.partitionBy(key).orderBy("_bucket")))
    ends = ends.withColumn("_carry", F.coalesce(F.sum(F.when(F.col("_resets") == 0, F.col("_n"))).over(since), F.lit(0)))
    base = F.max(F.when(F.col("_prior._epochs") < F.col("_epochs"), F.col("_prior._tail"))).over(Window.partitionBy(key, "_epochs"))
    ends = ends.withColumn("_carry", F.col("_carry") + F.coalesce(base, F.lit(0))).select(key, "_bucket", "_epochs", "_carry")
    inside = Window.partitionBy(key, "_bucket").orderBy(*order)
    rows = rows.join(ends, [key, "_bucket"])
    rows = rows.withColumn("_seen", F.sum("_reset").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    spot = Window.partitionBy(key, "_bucket", "_seen").orderBy(*order)
    rank = F.row_number().over(spot)
    depth = F.when(F.col("_seen") > 0, rank - 1).otherwise(F.col("_carry") + rank)
    return rows.withColumn("epoch", (F.col("_epochs") + F.col("_seen")).cast("long")).withColumn("depth", depth.cast("long")).select(*events.columns, "epoch", "depth")


def breadcrumbs(steps: DataFrame, key: str, order: str, label: str, resets: str) -> DataFrame:
    """The labels clicked since the last reset, for each step of a short session (clicks of one person)."""
    run = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = steps.withColumn("_island", F.sum(F.when(F.col(resets), 1).otherwise(0)).over(run))
    trail = Window.partitionBy(key, "_island").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    kept = F.when(~F.col(resets) & (F.coalesce(F.col(label), F.lit("")) != ""), F.col(label))
    return rows.withColumn("path", F.collect_list(kept).over(trail)).drop("_island")
