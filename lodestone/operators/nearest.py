"""A stored table of vectors, searched by one byte a dimension and exact in its results.

Each vector is rounded to 255 steps of its largest component, and the length of
what that loses is stored.  A dot product with a question then lies within
question length times loss of the rounded one.  A search reads the bytes only,
keeps what may be among the best k by these bounds, and reads the full vectors
of those few.  That needs no structure in the data: cells with radii would skip
nothing where vectors lie in all directions.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import dot
from .retrieval import BLOCK, _pack_block, top
from .staging import staged

_BLOCKS = "ids binary, width long, codes binary, scales binary, losses binary, vectors binary"
#: Scores are rounded to six places, so bounds are a little wider.
ROUNDING = 1e-6


def rounded(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes of one byte, scale of each row, length of what rounding loses)."""
    scale = np.abs(x).max(axis=1) / 127.0
    codes = np.rint(x / np.where(scale > 0, scale, 1.0)[:, None]).astype(np.int8)
    return codes, scale, np.linalg.norm(x - codes * scale[:, None], axis=1) * (1 + 1e-12)


def _stored(batches):
    for batch in batches:
        table = pa.Table.from_batches([batch])
        for low in range(0, table.num_rows, BLOCK):
            part = table.slice(low, BLOCK)
            x = np.array(part.column(1).to_pylist(), dtype="<f8")
            codes, scale, loss = rounded(x)
            raw = (part.column(0).to_numpy().astype("<i8"), codes, scale, loss, x)
            ids, codes, scale, loss, x = (a.tobytes() for a in raw)
            yield pa.RecordBatch.from_pydict({"ids": [ids], "width": [raw[4].shape[1]], "codes": [codes], "scales": [scale], "losses": [loss], "vectors": [x]})


def store(vectors: DataFrame, path: str) -> None:
    """Write ``vectors`` (vec_id, embedding of one length) to ``path``, in blocks; nulls are left out."""
    rows = vectors.select(F.col("vec_id").cast("long"), "embedding").where("vec_id IS NOT NULL AND embedding IS NOT NULL")
    rows.mapInArrow(_stored, _BLOCKS).withColumn("block", F.monotonically_increasing_id()).write.parquet(path)


def _within(k: int):
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids, q_ids = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["q_ids"], "<i8")
                codes = np.frombuffer(row["codes"], np.int8).reshape(-1, row["width"]).astype(np.float32)
                scale, loss = (np.frombuffer(row[c], "<f8") for c in ("scales", "losses"))
                q = np.frombuffer(row["q_vectors"], "<f8").reshape(-1, row["width"])
                length = np.linalg.norm(q, axis=1)
                about = (q @ codes.T.astype(np.float64)) * scale
                about[q_ids[:, None] == ids[None, :]] = -np.inf  # not itself
                reach = length[:, None] * loss[None, :] + ROUNDING
                low = about - reach
                least = np.partition(low, max(low.shape[1] - k, 0), axis=1)[:, max(low.shape[1] - k, 0)]
                asks, at = np.nonzero((about + reach >= least[:, None]) & np.isfinite(about))
                yield pa.RecordBatch.from_pydict({"query_id": q_ids[asks], "vec_id": ids[at], "block": np.full(len(at), row["block"]), "low": low[asks, at], "high": (about + reach)[asks, at]})

    return run


def candidates(spark: SparkSession, path: str, queries: DataFrame, k: int) -> DataFrame:
    """``query_id``, ``vec_id`` and ``block`` of all that can be among the ``k`` best of each of ``queries`` (vec_id, embedding)."""
    many = queries.count() // BLOCK + 1
    asked = queries.select("vec_id", "embedding", F.pmod(F.xxhash64("vec_id"), F.lit(many)).alias("part")).where("vec_id IS NOT NULL AND embedding IS NOT NULL")
    right = asked.groupBy("part").applyInArrow(_pack_block, "block long, q_ids binary, q_vectors binary").withColumnRenamed("block", "part")
    left = spark.read.parquet(path).select("block", "ids", "width", "codes", "scales", "losses")
    pairs = left.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(many - 1).cast("long")))).join(right, "part")
    found = staged(pairs.mapInArrow(_within(k), "query_id long, vec_id long, block long, low double, high double"), "within")
    least = top(found, "query_id", "vec_id", k, "low").where(F.col("rank") == k).select("query_id", F.col("low").alias("least"))
    kept = found.join(least, "query_id", "left").where(F.col("least").isNull() | (F.col("high") >= F.col("least")))
    return kept.select("query_id", "vec_id", "block")


def _picked(batches):
    for batch in batches:
        for row in batch.to_pylist():
            ids, x = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["vectors"], "<f8").reshape(-1, row["width"])
            at = np.isin(ids, np.array(row["wanted"], dtype=np.int64))
            yield pa.RecordBatch.from_pydict({"vec_id": ids[at], "embedding": list(x[at])})


def nearest(spark: SparkSession, path: str, queries: DataFrame, k: int) -> DataFrame:
    """The ``k`` stored vectors with the largest dot product for each of ``queries`` (vec_id, embedding), itself left out: as :func:`retrieval.dense` finds them."""
    found = staged(candidates(spark, path, queries, k), "candidates")
    wanted = found.groupBy("block").agg(F.collect_set("vec_id").alias("wanted"))  # at most the ids of a block
    full = spark.read.parquet(path).select("block", "ids", "width", "vectors").join(wanted, "block").mapInArrow(_picked, "vec_id long, embedding array<double>")
    own = queries.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("asks"))
    scored = found.select("query_id", "vec_id").join(full, "vec_id").join(own, "query_id").select("query_id", "vec_id", F.round(dot(F.col("asks"), F.col("embedding")), 6).alias("score"))
    return top(scored, "query_id", "vec_id", k)
