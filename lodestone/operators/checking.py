"""Answers checked against their evidence, and measures of retrieval quality."""

from __future__ import annotations

from collections import deque

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.grounding import SuffixAutomaton, runs, supported
from ..functions.text import numbers, spaced_terms, terms
from .staging import small_batches, staged

#: Phrases by which an answer owns up to not knowing.  The surveyed list is unknown; this one is ours.
ABSTAINING = ("cannot be confirmed", "no evidence", "not found in the documents")
#: Seconds within which an answer counts as quick.
QUICK = 20.0


def unsupported_numbers(answer: Column, evidence: Column) -> Column:
    """The numbers of an answer that its evidence does not have, each once, in order."""
    return F.array_except(numbers(answer), numbers(evidence))


def abstains(answer: Column) -> Column:
    return F.coalesce(F.exists(F.array(*[F.lit(p) for p in ABSTAINING]), lambda p: F.contains(F.lower(answer), p)), F.lit(False))


def flags(abstain: Column, unsupported: Column, mismatch: Column) -> Column:
    """What a verification found, as labels; a clean one says OK."""
    found = F.array_compact(
        F.array(
            F.when(F.coalesce(abstain, F.lit(False)), "abstain"),
            F.when(F.coalesce(F.size(unsupported), F.lit(0)) > 0, "unsupported_claims"),
            F.when(F.coalesce(mismatch, F.lit(False)), "ocr_mismatch"),
        )
    )
    return F.when(F.size(found) == 0, F.array(F.lit("OK"))).otherwise(found)


def hit_at(found: DataFrame, expected: DataFrame, k: int, key: str) -> DataFrame:
    """One row: how many of ``expected`` (query_id, key) have a hit among the ``k`` best, and their share."""
    hits = found.where(F.col("rank") <= k).join(expected, ["query_id", key], "left_semi").select("query_id").distinct().withColumn("hit", F.lit(1))
    asked = expected.select("query_id").distinct()
    joined = asked.join(hits, "query_id", "left").select(F.coalesce("hit", F.lit(0)).alias("hit"))
    return joined.agg(F.count(F.lit(1)).alias("queries"), F.sum("hit").alias("hits"), F.round(F.avg("hit"), 6).alias("hit_rate"))


def keyword_recall(rows: DataFrame, keywords: str, text: str) -> DataFrame:
    """The mean share of each row's keywords that its text contains; rows without keywords don't count."""
    met = F.size(F.filter(keywords, lambda w: F.contains(F.lower(F.col(text)), F.lower(w))))
    return rows.where(F.size(keywords) > 0).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(met / F.size(keywords)), 6).alias("recall"))


def latency(rows: DataFrame, group: str, seconds: str) -> DataFrame:
    """Mean, largest, and share within :data:`QUICK` seconds, by group."""
    quick = F.sum(F.when(F.col(seconds) < QUICK, 1).otherwise(0))
    return rows.groupBy(group).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(seconds), 4).alias("mean_s"), F.max(seconds).alias("max_s"), F.round(quick / F.count(F.lit(1)), 6).alias("quick_share"), F.round(F.sum(seconds), 2).alias("total_s")
    )


def calls(counters: list[str]) -> Column:
    """All model calls of a turn; a missing counter is 0."""
    total = F.lit(0)
    for c in counters:
        total = total + F.coalesce(F.col(c), F.lit(0))
    return total


def shown_stages(counters: dict[str, str]) -> Column:
    """The stages whose counters are above 0, in order."""
    rows = F.array(*[F.struct(F.lit(name).alias("stage"), F.coalesce(F.col(c), F.lit(0)).cast("long").alias("n")) for name, c in counters.items()])
    return F.filter(rows, lambda r: r["n"] > 0)


def safe_evidence(evidence: Column) -> Column:
    """Evidence without paths: rank from 1, document, page."""
    return F.transform(evidence, lambda e, i: F.struct((i + 1).alias("rank"), e["document_name"].alias("document_name"), e["page_number"].alias("page_number")))


def page_scores(pages: Column) -> Column:
    """Pages with their score; a score of 0 or null gives way to that of the reranker."""
    return F.transform(pages, lambda p: F.struct(p["document_name"].alias("document_name"), p["page_number"].alias("page_number"), F.coalesce(F.nullif(p["score"], F.lit(0.0)), p["rerank_score"]).alias("score")))


def zipped(a: Column, b: Column) -> Column:
    """Pairs by position, as many as the shorter array has."""
    n = F.least(F.size(a), F.size(b))
    return F.arrays_zip(F.slice(a, F.lit(1), n).alias("a"), F.slice(b, F.lit(1), n).alias("b"))


def answer_rates(rows: DataFrame, group: str) -> DataFrame:
    """How often answers refuse, misread, make things up or fail, by group.

    ``rows`` has ``refused``, ``irrelevant`` (the question should be refused),
    ``by_sight``, ``wrong``, ``unsupported`` (a number without evidence),
    ``has_evidence`` and ``calls``.  A rate over no row is null.
    """
    share = lambda good, of: F.round(F.sum(F.when(of & good, 1).otherwise(0)) / F.nullif(F.sum(F.when(of, 1).otherwise(0)), F.lit(0)), 6)
    c = {name: F.coalesce(F.col(name), F.lit(False)) for name in ("refused", "irrelevant", "by_sight", "wrong", "unsupported", "has_evidence")}
    return rows.groupBy(group).agg(
        F.count(F.lit(1)).alias("n"), share(c["refused"], c["irrelevant"]).alias("refusal_rate"), share(c["wrong"], c["by_sight"]).alias("misread_rate"),
        F.sum(F.when(c["unsupported"] & ~c["refused"], 1).otherwise(0)).alias("hallucinations"), share(c["wrong"], c["has_evidence"]).alias("failure_rate"), F.round(F.avg("calls"), 6).alias("mean_calls"),
    )


def token_costs(calls: DataFrame, group: str, in_price: float, out_price: float) -> DataFrame:
    """Tokens read and written by group, and their cost at prices for a million of either; a missing count is 0."""
    read, written = (F.coalesce(F.col(c), F.lit(0)).cast("long") for c in ("tokens_in", "tokens_out"))
    cost = (F.sum(read) * in_price + F.sum(written) * out_price) / 1e6
    return calls.groupBy(group).agg(F.count(F.lit(1)).alias("calls"), F.sum(read).alias("tokens_in"), F.sum(written).alias("tokens_out"), F.round(cost, 9).alias("cost"))


def sentences(text: Column) -> Column:
    """The sentences of a text, without the marks that end them; the rule is ours."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"[.!?\n]+"), lambda x: F.btrim(x)), lambda x: x != "")


def citations(answers: DataFrame, least: float) -> DataFrame:
    """For each sentence of each answer (id columns, answer, evidence), the share of its distinct words that the evidence has.

    ``cited`` tells whether that share is at least ``least``; a sentence without
    words is not.
    """
    ids = [c for c in answers.columns if c not in ("answer", "evidence")]
    rows = answers.select(*ids, F.array_distinct(terms(F.col("evidence"))).alias("_known"), F.posexplode(sentences(F.col("answer"))).alias("ord", "_sentence"))
    rows = rows.withColumn("_words", F.array_distinct(terms(F.col("_sentence"))))
    share = F.round(F.size(F.array_intersect("_words", "_known")) / F.nullif(F.size("_words"), F.lit(0)), 6)
    return rows.select(*ids, "ord", F.coalesce(share, F.lit(0.0)).alias("share")).withColumn("cited", F.col("share") >= least)


#: Words in a row that evidence must have for them to count as supported.
RUN = 3
#: Bytes of the texts of a group whose runs a task holds at once.
PIECE = 1 << 20


def _told(text: Column) -> Column:
    """The words of each sentence that has some."""
    return F.filter(F.transform(sentences(text), spaced_terms), lambda x: F.btrim(x) != "")


def _support(least: int):
    # Words come in one string a sentence and are cut row by row: a batch holds texts, not words.
    @F.pandas_udf("array<struct<words:long,covered:long,longest:long>>")
    def of(answers: pd.Series, evidence: pd.Series) -> pd.Series:
        def one(told, known):
            automaton = SuffixAutomaton(known.split())
            return [dict(zip(("words", "covered", "longest"), (len(x.split()), *supported(automaton, x.split(), least)), strict=True)) for x in told]

        return pd.Series([one(told, known) for told, known in zip(answers, evidence, strict=True)])

    return of


def grounded(answers: DataFrame, least: int = RUN) -> DataFrame:
    """For each sentence of each answer (id columns, answer, evidence), how much of it the evidence says in the same words.

    ``words`` are the sentence's, ``covered`` those within a run of at least
    ``least`` words that the evidence has in a row, ``longest`` the longest
    such run of any length, ``share`` the part that is covered.  Null evidence
    supports nothing; sentences without words have no row.  The texts of one
    row are in a task's memory, no more.
    """
    small_batches(answers.sparkSession)
    ids = [c for c in answers.columns if c not in ("answer", "evidence")]
    rows = answers.select(*ids, _told(F.col("answer")).alias("_told"), spaced_terms(F.col("evidence")).alias("_known"))
    both = rows.select(*ids, F.posexplode(_support(least)("_told", "_known")).alias("ord", "_x"))
    return both.select(*ids, "ord", "_x.words", "_x.covered", "_x.longest", F.round(F.col("_x.covered") / F.col("_x.words"), 6).alias("share"))


def _runs_before(least: int):
    """Rows (group, piece, order, row, sentences, words as evidence) in order to the sentences, with what earlier rows of the same piece say."""

    def run(batches):
        at, automaton, waiting = None, SuffixAutomaton(), deque()
        for batch in batches:
            nth, ords, words, longest, ends, starts, stops = [], [], [], [], [0], [], []
            for i, (group, piece, order, told, known) in enumerate(zip(*(batch.column(c).to_pylist() for c in (0, 1, 2, 4, 5)), strict=True)):
                if (group, piece) != at:
                    at, automaton, waiting = (group, piece), SuffixAutomaton(), deque()
                while told and waiting and waiting[0][0] != order:  # rows of the same place are not before it
                    automaton.add(waiting.popleft()[1].split())
                for nth_told, said in enumerate(x.split() for x in told or ()):
                    found, most = runs(automaton, said, least)
                    nth.append(i)
                    ords.append(nth_told)
                    words.append(len(said))
                    longest.append(most)
                    starts += [start for start, _ in found]
                    stops += [end for _, end in found]
                    ends.append(len(starts))
                if known is not None and order is not None:
                    waiting.append((order, known))
            spans = pa.StructArray.from_arrays([pa.array(starts, pa.int64()), pa.array(stops, pa.int64())], ["start", "end"])
            kept = [batch.column(c).take(pa.array(nth, pa.int64())) for c in (0, 2, 3)]
            own = [pa.array(ords, pa.int32()), pa.array(words, pa.int64()), pa.array(longest, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), spans)]
            yield pa.RecordBatch.from_arrays([*kept, *own], names=[*(batch.schema.names[c] for c in (0, 2, 3)), "ord", "words", "longest", "runs"])

    return run


def grounded_before(rows: DataFrame, group: str, order: str, least: int = RUN, piece: int = PIECE) -> DataFrame:
    """For each sentence of each row that is ``asked``, how much of it any earlier row of its group says in the same words.

    ``rows`` has ``group``, ``order``, ``text`` and ``asked``.  Columns are
    those of :func:`grounded`; every row with a smaller ``order`` is evidence
    of its own, so no run goes on from one to another.  Rows without group or
    order have no evidence and are none.  A group's rows pass in order, and
    each is taken in once.  A group of more than ``piece`` bytes is dealt to
    several tasks, each with some of the evidence and all that is asked, so a
    task holds no more runs than those of a piece or of one row; there the work
    is what is asked times the pieces.
    """
    small_batches(rows.sparkSession)
    many = F.ceil(F.sum(F.octet_length("text")) / piece).alias("_pieces")
    large = staged(rows.where(F.col(group).isNotNull()).groupBy(group).agg(many).where("_pieces > 1"), "large")
    cut, kinds = not large.isEmpty(), dict(rows.dtypes)
    rows = rows.select(group, order, "text", F.coalesce("asked", F.lit(False)).alias("asked"), F.monotonically_increasing_id().alias("_row"))
    rows = rows.join(large, group, "left") if cut else rows.withColumn("_pieces", F.lit(None).cast("long"))
    pieces, alone = F.coalesce("_pieces", F.lit(1)), F.col(group).isNull()
    rows = rows.withColumn("_own", F.when(alone, F.col("_row")).otherwise(F.pmod(F.xxhash64("_row"), pieces)))
    rows = rows.withColumn("_piece", F.explode(F.when(F.col("asked") & ~alone, F.sequence(F.lit(0).cast("long"), pieces - 1)).otherwise(F.array("_own"))))
    dealt = rows.repartition(group, "_piece").sortWithinPartitions(group, "_piece", order)
    words = dealt.select(group, "_piece", order, "_row", F.when(F.col("asked"), _told(F.col("text"))).alias("_told"), F.when(F.col("_piece") == F.col("_own"), spaced_terms(F.col("text"))).alias("_known"))
    found = words.mapInArrow(_runs_before(least), f"`{group}` {kinds[group]}, `{order}` {kinds[order]}, _row long, ord int, words long, longest long, runs array<struct<start:long,end:long>>")
    if cut:
        found = found.groupBy(group, order, "_row", "ord", "words").agg(F.max("longest").alias("longest"), F.flatten(F.collect_list("runs")).alias("runs"))
    none = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
    more = lambda x, r: F.struct((x["n"] + F.greatest(F.lit(0).cast("long"), r["end"] - F.greatest(x["end"], r["start"]))).alias("n"), F.greatest(x["end"], r["end"]).alias("end"))
    covered = F.aggregate(F.array_sort("runs"), none, more, lambda x: x["n"])
    return found.select(group, order, "ord", "words", covered.alias("covered"), "longest").withColumn("share", F.round(F.col("covered") / F.col("words"), 6))
