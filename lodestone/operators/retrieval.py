"""Retrieval: chunks, BM25, dense search in blocks, rank fusion, and back to documents.

Parameters that the surveyed reports leave open are set here and named as such:
BM25 has k1 = 1.5 and b = 0.75 with a non-negative idf; ranks tie by id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import terms

K1, B, RRF = 1.5, 0.75, 60
#: Characters of a chunk; vectors of a block.
CHUNK, BLOCK = 700, 4096


def chunks(docs: DataFrame, size: int = CHUNK) -> DataFrame:
    """``doc_id``, ``ord`` and ``text`` of pieces of ``size`` characters; an empty text has none."""
    many = F.ceil(F.char_length("text") / F.lit(float(size))).cast("int")
    cut = F.when(many > 0, F.transform(F.sequence(F.lit(0), many - 1), lambda i: F.substring(F.col("text"), i * size + 1, F.lit(size))))
    return docs.select("doc_id", F.posexplode(cut).alias("ord", "text"))


def block_chunks(docs: DataFrame, size: int = CHUNK) -> DataFrame:
    """``doc_id``, ``start``, ``is_table`` and ``text`` of chunks of whole lines.

    Lines that begin in the same stretch of ``size`` characters make one chunk,
    so a chunk has less than twice ``size``; longer lines are cut first.  Rows
    of a table (lines that begin with ``|``) are apart from other lines, and so
    are two tables with text between them.  Chunks without visible text are
    left out, and so are null texts.  ``doc_id`` must tell documents apart.
    """
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    many = F.greatest(F.lit(1), F.ceil(F.char_length("line") / F.lit(float(size)))).cast("int")
    cuts = lines.select("doc_id", "pos", "line", F.col("line").startswith("|").alias("is_table"), F.explode(F.sequence(F.lit(0), many - 1)).alias("i"))
    broken = F.when((F.col("i") == 0) & (F.col("pos") > 0), "\n").otherwise("")
    pieces = cuts.select("doc_id", "pos", "i", "is_table", broken.alias("br"), F.substring(F.col("line"), F.col("i") * size + 1, F.lit(size)).alias("piece"))
    order = Window.partitionBy("doc_id").orderBy("pos", "i")
    changes = (F.col("is_table") != F.lag("is_table").over(order)).cast("int")
    placed = pieces.select(
        "*",
        (F.sum(F.char_length("br") + F.char_length("piece")).over(order) - F.char_length("piece")).alias("at"),
        F.coalesce(changes, F.lit(0)).alias("change"),
    ).withColumn("run", F.sum("change").over(order))
    parts = F.sort_array(F.collect_list(F.struct("pos", "i", "br", "piece")))
    joined = F.array_join(F.transform(parts, lambda x: F.concat(x["br"], x["piece"])), "")
    grouped = placed.groupBy("doc_id", "run", F.floor(F.col("at") / size).alias("stretch"), "is_table").agg(F.min("at").alias("start"), joined.alias("text"))
    return grouped.select("doc_id", "start", "is_table", F.regexp_replace("text", r"\A\n", "").alias("text")).where(F.col("text").rlike(r"\S"))


def bm25(docs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``query_id``, ``doc_id``, ``score`` and ``rank`` of the ``k`` best documents of each query (query_id, text).

    Only the queries' terms are counted; statistics cover all documents.
    """
    asked = queries.select("query_id", F.explode(F.array_distinct(terms(F.col("text")))).alias("term"))
    split = docs.select("doc_id", terms(F.col("text")).alias("w"))
    stats = split.agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg(F.size("w")).alias("mean"))
    wanted = asked.select("term").distinct()
    tf = split.select("doc_id", F.size("w").alias("len"), F.explode("w").alias("term")).join(wanted, "term", "left_semi").groupBy("doc_id", "len", "term").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("mean")))
    one = stats.first()  # two numbers
    weighed = tf.join(df, "term").withColumns({"n": F.lit(one["n"]), "mean": F.lit(one["mean"])}).select("term", "doc_id", weight.alias("w"))
    scored = weighed.join(asked, "term").groupBy("query_id", "doc_id").agg(F.round(F.sum("w"), 6).alias("score"))
    return top(scored, "query_id", "doc_id", k)


def top(scored: DataFrame, group: str, key: str, k: int, score: str = "score") -> DataFrame:
    """The ``k`` best rows of each group, ties by key; Spark limits each partition before it shuffles."""
    order = Window.partitionBy(group).orderBy(F.col(score).desc(), F.col(key).asc())
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _pack(batches):
    for batch in batches:
        table = pa.Table.from_batches([batch])
        for low in range(0, table.num_rows, BLOCK):
            part = table.slice(low, BLOCK)
            ids = part.column(0).to_numpy().astype("<i8")
            x = np.array(part.column(1).to_pylist(), dtype="<f8")
            yield pa.RecordBatch.from_pydict({"ids": [ids.tobytes()], "vectors": [x.tobytes()], "width": [x.shape[1]]})


def _pack_block(table):
    ids, x = table.column(0).to_numpy().astype("<i8"), np.array(table.column(1).to_pylist(), dtype="<f8")
    return pa.table({"block": table.column(2).slice(0, 1), "q_ids": [ids.tobytes()], "q_vectors": [x.tobytes()]})


def _multiply(k: int):
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids, q_ids = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["q_ids"], "<i8")
                x, q = (np.frombuffer(row[c], "<f8").reshape(-1, row["width"]) for c in ("vectors", "q_vectors"))
                scores = np.round(q @ x.T, 6)
                scores[q_ids[:, None] == ids[None, :]] = -np.inf  # not itself
                best = np.lexsort((np.broadcast_to(ids, scores.shape), -scores), axis=1)[:, :k]
                flat = np.take_along_axis(scores, best, axis=1).ravel()
                out = pa.RecordBatch.from_pydict({"query_id": np.repeat(q_ids, best.shape[1]), "vec_id": ids[best].ravel(), "score": flat})
                yield out.filter(pa.array(np.isfinite(flat)))

    return run


def dense(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The ``k`` rows of ``vectors`` (vec_id, embedding) with the largest dot product for each row of ``queries``, itself left out.

    Both sides are packed in blocks.  Every pair of blocks is one product of
    matrices, of which each query's ``k`` best go on; no pair of rows does.
    """
    left = vectors.select("vec_id", "embedding").where("vec_id IS NOT NULL AND embedding IS NOT NULL").mapInArrow(_pack, "ids binary, vectors binary, width long")
    many = queries.count() // BLOCK + 1
    asked = queries.select("vec_id", "embedding", F.pmod(F.xxhash64("vec_id"), F.lit(many)).alias("block")).where("vec_id IS NOT NULL AND embedding IS NOT NULL")
    right = asked.groupBy("block").applyInArrow(_pack_block, "block long, q_ids binary, q_vectors binary")
    pairs = left.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(many - 1).cast("long")))).join(right, "block")
    found = pairs.select("ids", "vectors", "width", "q_ids", "q_vectors").mapInArrow(_multiply(k), "query_id long, vec_id long, score double")
    return top(found, "query_id", "vec_id", k)


def fuse(lists: list[DataFrame], k: int, key: str = "doc_id") -> DataFrame:
    """Reciprocal rank fusion of ranked lists (query_id, key, rank): a list without a row adds nothing."""
    both = lists[0].select("query_id", key, "rank")
    for more in lists[1:]:
        both = both.unionByName(more.select("query_id", key, "rank"))
    summed = both.groupBy("query_id", key).agg(F.round(F.sum(1.0 / (RRF + F.col("rank"))), 9).alias("score"))
    return top(summed, "query_id", key, k)


def small_to_big(found: DataFrame, k: int) -> DataFrame:
    """From scored chunks (query_id, doc_id, score) to the ``k`` documents with the best chunks."""
    return top(found.groupBy("query_id", "doc_id").agg(F.max("score").alias("score")), "query_id", "doc_id", k)


def gated(found: DataFrame, docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Only what belongs to documents that were chosen (query_id, key)."""
    return found.join(docs.select("query_id", key).distinct(), ["query_id", key], "left_semi")


def floor(found: DataFrame, least: float) -> DataFrame:
    """For each query its best score, and whether it is refused."""
    return found.groupBy("query_id").agg(F.max("score").alias("best")).withColumn("refused", F.col("best") < least)


def answer_mode(figures: Column, scanned: Column, has_table: Column) -> Column:
    """How a page is read: by sight if it is mostly figures, or scanned with a table."""
    return F.when((figures >= 0.5) | (scanned & has_table), "vision").otherwise("text")


def reranked(found: DataFrame, scorer, k: int, least: float | None = None) -> DataFrame:
    """``found`` (query_id, doc_id, and what the scorer reads) in the order of a scorer of choice.

    ``scorer`` is a column, or a function of ``found`` that gives one: an
    expression, or a pandas UDF around a model.  Ties go by id.  With ``least``,
    rows below it are left out.
    """
    score = scorer(found) if callable(scorer) else scorer
    rows = found.drop("score", "rank").withColumn("score", score)
    return top(rows if least is None else rows.where(F.col("score") >= least), "query_id", "doc_id", k)


def with_retries(questions: DataFrame, attempts: list, resolved: Column) -> DataFrame:
    """``questions`` answered by the first of ``attempts`` that resolves them.

    Each attempt is a function from the questions still open to the same rows
    with its answer columns; ``resolved`` judges them.  A question meets an
    attempt only if all before it failed, and keeps the last one's row if none
    succeeds.  ``attempt`` counts from 1, so the loop is as long as the list.
    """
    done, left = None, questions
    for n, attempt in enumerate(attempts, 1):
        tried = attempt(left).withColumn("attempt", F.lit(n))
        good = F.coalesce(resolved, F.lit(False))
        kept = tried if n == len(attempts) else tried.where(good)
        done = kept if done is None else done.unionByName(kept)
        left = tried.where(~good).select(*questions.columns)
    return done
