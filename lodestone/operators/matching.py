"""Questions matched to curated ones: exactly, else by the two most similar keys."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import Lanes, ratios_of
from ..functions.text import normalized
from .catalogue import first_wins
from .staging import staged

#: Accepted from this score, and with this lead over the second.
THRESHOLD, MARGIN = 0.90, 0.05
#: Keys and questions of a block.
BLOCK, ASKED = 10_000, 2_000
#: Bits of the keys that are compared with a question at once.
LANES = 1 << 15


def exact(questions: DataFrame, keys: DataFrame, question: str, key: str) -> DataFrame:
    """``questions`` with the columns of the key that equals ``question``, or nulls."""
    return questions.join(keys, questions[question] == keys[key], "left")


def _groups(keys: list[dict]):
    """Keys of like lengths in lanes, with their ordinals."""
    group, bits = [], 0
    for key in sorted(keys, key=lambda k: len(k["text"])):
        group.append(key)
        bits += len(key["text"]) + 64
        if bits >= LANES:
            yield Lanes([k["text"] for k in group]), np.array([k["ordinal"] for k in group], dtype=np.int64)
            group, bits = [], 0
    if group:
        yield Lanes([k["text"] for k in group]), np.array([k["ordinal"] for k in group], dtype=np.int64)


def _best_two(batches):
    """Rows of a block of keys and a block of questions in; each question's best two keys of that block out."""
    for batch in batches:
        out: list[tuple] = []
        for keys, questions in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            groups = list(_groups(keys))
            low, high = (np.array([lanes.sizes[end] for lanes, _ in groups]) for end in (0, -1))
            for question in questions:
                text = question["text"]
                # No common subsequence is longer than the shorter text, so a group is bounded by its length nearest to the question's.
                nearest = np.clip(len(text), low, high)
                bounds = ratios_of(nearest, len(text), np.minimum(nearest, len(text)))
                top: list[tuple[float, int]] = []
                for g in np.argsort(-bounds, kind="stable").tolist():
                    if len(top) == 2 and bounds[g] < -top[1][0]:
                        break
                    lanes, ordinals = groups[g]
                    scores = lanes.ratios(text)
                    best = np.lexsort((ordinals, -scores))[:2]
                    top = sorted([*top, *zip((-scores[best]).tolist(), ordinals[best].tolist(), strict=True)])[:2]
                out += [(question["number"], ordinal, -score) for score, ordinal in top]
        cols = list(zip(*out, strict=True)) or [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.float64()), strict=True)], ["number", "ordinal", "score"])


def nearest_two(questions: DataFrame, keys: DataFrame, block: int = BLOCK, asked: int = ASKED) -> DataFrame:
    """For each question (number, text) its two best keys: ``best``, ``second``, ``ordinal``.

    ``keys`` (ordinal, text) is the curated table, of any size.  Both sides are
    packed in blocks of about ``block`` keys and at most about ``asked``
    questions, every pair of blocks is one row, and their best two are merged,
    so a question never meets more than two keys of a block in a row.  Of equal
    scores the smaller ordinal wins.
    """
    n = int(questions.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = keys.count() // block + 1
    parts = max(n, questions.count() // asked + 1)
    dealt = lambda column, many: F.pmod(F.xxhash64(column), F.lit(many).cast("long"))
    each = lambda many: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(many - 1).cast("long")))
    left = keys.select(dealt("ordinal", blocks).alias("block"), F.struct("ordinal", "text").alias("x")).groupBy("block").agg(F.collect_list("x").alias("keys"))
    right = questions.select(dealt("number", parts).alias("part"), F.struct("number", "text").alias("x")).groupBy("part").agg(F.collect_list("x").alias("questions"))
    left = left.withColumn("part", each(parts))
    right = right.withColumn("block", each(blocks)).repartition(n, "part", "block")
    found = right.join(left, ["part", "block"]).select("keys", "questions").mapInArrow(_best_two, "number long, ordinal long, score double")
    ranked = F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "ordinal")))  # two for each block
    return (
        found.groupBy("number")
        .agg(ranked.alias("r"))
        .select("number", (-F.get("r", F.lit(0))["s"]).alias("best"), F.coalesce(-F.get("r", F.lit(1))["s"], F.lit(0.0)).alias("second"), F.get("r", F.lit(0))["ordinal"].alias("ordinal"))
    )


def decision(best: Column, second: Column, threshold: float = THRESHOLD, margin: float = MARGIN) -> Column:
    """The score is judged before the lead; equality passes both."""
    return F.when(best < threshold, "reject_low_score").when(best - second < margin, "reject_ambiguous").otherwise("accept")


def match(questions: DataFrame, faq: DataFrame, threshold: float = THRESHOLD, margin: float = MARGIN, keyless: bool = False) -> DataFrame:
    """Every question (number, question) matched to the table ``faq`` (ordinal, id, question_normalized).

    Equal normalised questions match exactly, with constant scores; the first of
    equal keys stands for all.  A question that is empty once normalised and has
    no equal key is rejected with scores of 0 and no match.  The rest meet all
    keys; rejected ones keep the nearest key.  If ``faq`` has no key at all,
    ``keyless`` tells whether all questions are rejected like empty ones;
    without it they give no row.
    """
    keys = staged(first_wins(faq.select("ordinal", "id", "question_normalized"), "question_normalized", "ordinal"), "keys")
    asked = questions.select("number", "question", normalized(F.col("question")).alias("text"))
    # Exact first; only what it leaves goes to the costly stage.
    equal = staged(asked.join(keys.select(F.col("question_normalized").alias("text"), F.col("id").alias("matched_id")), "text", "left").select("number", "text", "matched_id"), "equal")
    direct = equal.where("matched_id IS NOT NULL").select("number", F.lit("exact").alias("decision"), F.lit(1.0).alias("best"), F.lit(0.0).alias("second"), F.lit(1.0).alias("margin"), "matched_id")
    far = F.lit(keyless and keys.isEmpty())
    empty = equal.where(F.col("matched_id").isNull() & ((F.col("text") == "") | far)).select(
        "number", F.lit("reject_low_score").alias("decision"), F.lit(0.0).alias("best"), F.lit(0.0).alias("second"), F.lit(0.0).alias("margin"), F.lit(None).cast("string").alias("matched_id")
    )
    near = nearest_two(equal.where("matched_id IS NULL AND text <> ''").where(~far).select("number", "text"), keys.select("ordinal", F.col("question_normalized").alias("text")))
    scored = near.join(keys.select("ordinal", "id"), "ordinal").select(
        "number", decision(F.col("best"), F.col("second"), threshold, margin).alias("decision"), "best", "second", (F.col("best") - F.col("second")).alias("margin"), F.col("id").alias("matched_id")
    )
    return direct.unionByName(empty).unionByName(scored)


