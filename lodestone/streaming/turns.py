"""Turns of a dialogue as a stream: the state of each session lives in Spark's state store.

A turn is answered from the state that its session has when it arrives, and
turns of one batch are taken in order of time.  The state is a few values a
session: the trail of labels is kept as a pointer, the turn since which labels
count and how many there are.  It survives a restart from the checkpoint, and a
reset starts a new thread, named ``session:number``.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.graph import RESTART, resolve

_STATE = "resets long, epoch long, position string, completed boolean, labels long, since long"
_FRESH = (0, 0, None, False, 0, None)
OUT = "session string, turn_id long, error string, position string, completed boolean, epoch long, thread string, labels long, since long"


class TurnProcessor(StatefulProcessor):
    """The state of one session after each of its turns; ``root`` is the node at which labels are cleared."""

    def __init__(self, root: str):
        self.root = root

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("session", _STATE)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        # What one batch brings for a session; a batch holds the files of one trigger.
        kept = self.state.get()  # None if there is none
        now = _FRESH if kept is None else tuple(kept)
        for turn in sorted(rows, key=lambda r: (r.ts is None, r.ts if r.ts is not None else 0, r.turn_id is None, r.turn_id or 0)):
            now, error = self.after(now, turn)
            resets, epoch, position, completed, labels, since = now
            yield Row(session=key[0], turn_id=turn.turn_id, error=error, position=position, completed=completed, epoch=epoch, thread=f"{key[0]}:{resets}", labels=labels, since=since)
        if now == _FRESH:
            if kept is not None:
                self.state.clear()
        else:
            self.state.update(now)

    def after(self, now: tuple, turn) -> tuple[tuple, str | None]:
        """The state after ``turn``, and what was wrong with it."""
        resets, epoch, position, completed, labels, since = now
        if turn.kind == "reset":  # a new thread: nothing of the old one is left
            return (resets + 1, *_FRESH[1:]), None
        if turn.kind != "action":  # free text leaves the graph
            return (resets, epoch + 1, None, False, 0, turn.turn_id), None
        if turn.error is not None:
            return now, turn.error
        if turn.option_id == RESTART or turn.next_node_id == self.root:
            return (resets, epoch + 1, turn.next_node_id, False, 0, turn.turn_id), None
        known = isinstance(turn.label, str) and turn.label != ""
        return (resets, epoch, turn.next_node_id, bool(turn.is_end), labels + known, since), None

    def close(self) -> None:
        pass


def turn_stream(turns: DataFrame, edges: DataFrame, terminals: DataFrame, root: str) -> DataFrame:
    """A stream of ``turns`` (session, ts, turn_id, kind, node_id, option_id, label) to their sessions' states after each.

    ``kind`` is text, action or reset.  Columns: ``session``, ``turn_id``,
    ``error``, ``position``, ``completed``, ``epoch`` (how often the session's
    place was cleared in its thread), ``thread``, ``labels`` (labels pressed
    since) and ``since`` (the turn that cleared them last).  The graph is a
    table; the posted node counts, not the session's own.
    """
    ends = terminals.select(F.col("node_id").alias("next_node_id"), F.lit(True).alias("is_end")).distinct()
    rows = resolve(turns, edges).join(ends, "next_node_id", "left")
    rows = rows.select(F.col("session").cast("string"), "ts", F.col("turn_id").cast("long").alias("turn_id"), "kind", "option_id", "label", "next_node_id", F.coalesce("is_end", F.lit(False)).alias("is_end"), F.when(F.col("kind") == "action", F.col("error")).alias("error"))
    return rows.groupBy("session").transformWithState(TurnProcessor(root), OUT, "Update", "None")


def run_turns(spark: SparkSession, source: str, schema, shaped, edges: DataFrame, terminals: DataFrame, root: str, out: str, checkpoint: str, files: int = 1000) -> DataFrame:
    """Take in what is new under ``source`` since the last call with this ``checkpoint``; gives all turns so far, as written to ``out``.

    ``shaped`` turns the stream's rows into turns.  Files are taken in order of
    their times, ``files`` a batch.
    """
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)
        query = (
            turn_stream(shaped(stream), edges, terminals, root)
            .writeStream.outputMode("update")
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .foreachBatch(lambda rows, n: rows.write.mode("overwrite").parquet(f"{out}/batch={n}"))
            .start()
        )
        query.awaitTermination()
    finally:
        if before is None:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        else:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return spark.read.schema(OUT).option("recursiveFileLookup", True).parquet(out)
