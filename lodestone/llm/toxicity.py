"""Toxicity by multiple-instance learning: sentences are scored, documents are labelled.

A sentence's score is a logistic function of its words; a document is toxic
unless none of its sentences is (noisy-or).  The weights are fitted to document
labels only, and then tell which sentences offend.

Words count whole and by their first letters, so inflected forms share weight.
"""

from __future__ import annotations

import math
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import small_batches

#: At most this many labelled documents of either label are fitted to, weighted to the share that either has of all.
SAMPLE = 20_000
#: Hashed features, those that a model may weigh, and the least evidence for one.
SLOTS, WEIGHED, LEAST_Z, LEAST_DOCS = 1 << 20, 1 << 16, 3.0, 4
#: First letters that count as features.
STEMS = (4, 5, 6)
#: Rounds and step of the fit, and the weight of its penalty.
ROUNDS, STEP, PENALTY = 400, 0.1, 1e-6
#: A document is called toxic from this score, a sentence offends from this one.
THRESHOLD, OFFENDS = 0.7, 0.5

SENTENCE = re.compile(r"[^.!?\n]+")
WORD = re.compile(r"[^\W\d_]+")


def features(word: str) -> list[int]:
    """The slots of a lower-case word."""
    names = [f"w{word}", *(f"{n}{word[:n]}" for n in STEMS if len(word) >= n)]
    return [zlib.crc32(x.encode()) % SLOTS for x in names]


class _Slots(dict):
    def __missing__(self, word: str) -> list[int]:
        out = features(word)
        if len(self) < 1 << 18:
            self[word] = out
        return out


def _count(batches):
    """(doc_id, text, label) in; for each slot, the documents of either label that have it."""
    slots, total = _Slots(), np.zeros((2, SLOTS), dtype=np.int64)
    for batch in batches:
        for text, label in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            found = {s for w in set(WORD.findall((text or "").lower())) for s in slots[w]}
            total[label, np.fromiter(found, np.int64, len(found))] += 1
    used = np.flatnonzero(total.any(axis=0))
    for i in range(0, len(used), 50_000):
        part = used[i : i + 50_000]
        yield pa.RecordBatch.from_pydict({"slot": part, "clean": total[0, part], "toxic": total[1, part]})


def _instances(weighed: np.ndarray):
    """(doc_id, text, label) in; the weighed slots of every sentence out, -1 for a sentence's end."""

    def run(batches):
        slots, held = _Slots(), set(weighed.tolist())
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                row: list[int] = []
                for sentence in SENTENCE.findall((text or "").lower()):
                    row += [s for w in WORD.findall(sentence) for s in slots[w] if s in held]
                    row.append(-1)
                out.append(row)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(out, pa.list_(pa.int32()))], ["doc_id", "label", "slots"])

    return run


def fit(labels: np.ndarray, slots: list[np.ndarray], start: dict[int, float], stands: np.ndarray | None = None) -> tuple[float, dict[int, float]]:
    """Bias and weights that make the noisy-or of the sentences' scores likely, by Adam.

    ``stands`` tells for how many labelled rows each row stands; one each if not given.
    """
    stands = np.ones(len(slots)) if stands is None else np.asarray(stands, dtype=np.float64)
    all_rows = stands.sum()
    names = np.array(sorted(start), dtype=np.int64)
    flat = np.concatenate([*slots, np.zeros(0, np.int64)]).astype(np.int64)
    ends = np.flatnonzero(flat == -1)
    sentence = np.searchsorted(ends, np.arange(len(flat)), side="left")
    doc = np.repeat(np.arange(len(slots)), [int((x == -1).sum()) for x in slots])
    real = flat >= 0
    column, row = np.searchsorted(names, flat[real]), sentence[real]
    w, b = np.array([start[int(s)] for s in names]), -6.0
    m1, m2 = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for t in range(1, ROUNDS + 1):
        z = b + np.bincount(row, weights=w[column], minlength=len(ends))
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        none = np.bincount(doc, weights=np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=len(slots))  # log of "no sentence is"
        any_ = np.maximum(-np.expm1(none), 1e-12)
        slope = np.where(labels[doc] == 1, p * np.exp(none)[doc] / any_[doc], -p) * stands[doc]
        grad = np.append(np.bincount(column, weights=slope[row], minlength=len(w)) / all_rows - PENALTY * w, slope.sum() / all_rows)
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.999 * m2 + 0.001 * grad**2
        step = STEP * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.999**t)) + 1e-8)
        w, b = w + step[:-1], min(b + step[-1], -3.0)
    return float(b), dict(zip(names.tolist(), w.tolist(), strict=True))


def labelled(labels: DataFrame, doc_id: str, label: str) -> DataFrame:
    """Ids with their label; an id labelled twice counts as toxic if either says so."""
    rows = labels.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).dropna()
    return rows.where("label IN (0, 1)").groupBy("doc_id").agg(F.max("label").alias("label"))


def sample_of(rows: DataFrame, most: int) -> DataFrame:
    """At most ``most`` of the labelled ids of either label, those with the least hash."""
    part = lambda k: rows.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return part(0).unionByName(part(1))


def learn(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "toxic", most: int = SAMPLE) -> tuple[float, dict[int, float]]:
    """Bias and weights learned from the labelled rows of ``docs``.

    The sample is at most ``2 * most`` ids, so its broadcast is bounded; the fit
    runs in one task over the sample's weighed features.  A label of more ids
    than ``most`` is sampled, so each of its rows stands for several in the fit
    and the share of toxic documents stays that of all labels.  The odds of a
    slot compare shares within either label, which sampling leaves as they are.
    """
    known = labelled(labels, doc_id, label)
    total = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    stands = {k: n / min(n, most) for k, n in total.items()}
    sample = F.broadcast(sample_of(known, most))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).join(sample, "doc_id").select("doc_id", "text", "label")
    counts = rows.mapInArrow(_count, "slot long, clean long, toxic long").groupBy("slot").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    sizes = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    clean, toxic = sizes.get(0, 0), sizes.get(1, 0)
    if not clean or not toxic:
        return -30.0, {}
    odds = F.log((F.col("toxic") + 0.5) / F.lit(toxic + 1.0)) - F.log((F.col("clean") + 0.5) / F.lit(clean + 1.0))
    z = odds / F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5))
    chosen = counts.where(F.col("toxic") + F.col("clean") >= LEAST_DOCS).select("slot", odds.alias("odds"), z.alias("z")).where(F.abs("z") >= LEAST_Z)
    chosen = chosen.orderBy(F.abs("z").desc(), "slot").limit(WEIGHED).toPandas()
    start = {int(s): 0.3 * float(np.clip(o, -5, 5)) for s, o in zip(chosen["slot"], chosen["odds"], strict=True)}
    weighed = np.array(sorted(start), dtype=np.int64)

    def train(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("doc_id")
        b, w = fit(group["label"].to_numpy(), [np.asarray(x, dtype=np.int64) for x in group["slots"]], start, group["label"].map(stands).to_numpy())
        return pd.DataFrame({"slot": [-1, *w], "weight": [b, *w.values()]})

    found = rows.mapInArrow(_instances(weighed), "doc_id long, label int, slots array<int>")
    model = found.groupBy().applyInPandas(train, "slot long, weight double").toPandas()
    weights = dict(zip(model["slot"].astype(int), model["weight"].astype(float), strict=True))
    return weights.pop(-1, -30.0), weights


class _Weights(dict):
    """The weight of a word: that of its slots together."""

    def __init__(self, weights: dict[int, float]):
        self.weights = weights

    def __missing__(self, word: str) -> float:
        out = sum(self.weights.get(s, 0.0) for s in features(word))
        if len(self) < 1 << 19:
            self[word] = out
        return out


def score_text(text: str, bias: float, weights: _Weights) -> tuple[float, list[dict]]:
    """(score of a document, its offending sentences with their character offsets)."""
    none, found = 0.0, []
    get = weights.__getitem__
    lower = text.lower()
    same = len(lower) == len(text)
    for m in SENTENCE.finditer(lower):
        z = bias + sum(map(get, WORD.findall(m[0])))
        none -= math.log1p(math.exp(min(z, 30.0)))
        if z >= 0:
            p = 1 / (1 + math.exp(-z))
            found.append({"start": m.start() if same else -1, "end": m.end() if same else -1, "score": p})
    return min(1.0, max(0.0, -math.expm1(none))), found


def _score(shared):
    def run(batches):
        bias, weights = shared.value
        weights = _Weights(weights)
        for batch in batches:
            rows = [score_text(t or "", bias, weights) for t in batch.column(0).to_pylist()]
            scores = pa.array([r[0] for r in rows], pa.float64())
            spans = pa.array([r[1] for r in rows], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], scores, spans], [*batch.schema.names[1:], "score", "sentences"])

    return run


def scored(docs: DataFrame, model: tuple[float, dict[int, float]], keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep`` of every row with ``score``, ``sentences`` and ``predicted``.

    ``sentences`` lists the offending ones: character offsets (-1 if
    lower-casing changes the text's length) and score.  Null and empty texts
    score 0.  Without labels of both kinds the model scores all near 0.
    Repeated rows all come back; an empty table gives an empty result.  Texts of
    any length are scored whole, sentence by sentence.  Columns of ``keep`` that have the names of new ones give way to them.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most WEIGHED weights
    keep = [c for c in keep if c not in ("score", "sentences", "predicted")]
    rows = docs.select(F.col(text).alias("_text"), *[F.col(f"`{c}`") for c in keep])
    spans = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("score", T.DoubleType())]))
    kinds = T.StructType([*rows.schema.fields[1:], T.StructField("score", T.DoubleType()), T.StructField("sentences", spans)])
    out = rows.mapInArrow(_score(shared), kinds)
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def held_out(doc_id: str = "doc_id", folds: int = 3, fold: int = 1):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == fold, F.lit(False))


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = learn(docs, labels.where(~held_out()))
    return scored(docs.select("doc_id", "text", held_out().alias("held_out")), model, ["doc_id", "held_out"]).drop("sentences")


QUERIES = {"op7_toxicity": op7_toxicity}
ORACLE_SQL: dict[str, str] = {}
