"""Answers from documents: sentences are chosen from the best ones, judged, and what falls short is asked once more.

The controller works on open questions only.  Each round searches the stored
index, chooses sentences and judges how much of the question they cover; what
stays open is rewritten by the terms of its own best documents.  A rewritten
question that does no better is rolled back to its first answer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import terms
from . import catalogue, matching, routing
from .inverted import Search
from .staging import staged

#: Sentences of an answer, documents that it is chosen from, and the share of the question's weight that it must cover.
SENTENCES, DOCUMENTS, LEAST = 3, 3, 0.6
#: What a sentence loses for a term that the answer has already, as a share of the term's weight.
REDUNDANT = 0.25
#: Terms that a rewritten question takes up, and the weight of the first of them.
EXPANDED, FEEDBACK = 5, 0.5
#: Where a sentence ends.
SENTENCE_END = r"[.!?\n]+"


def term_weights(asked: DataFrame, known: DataFrame, n: int) -> DataFrame:
    """``asked`` (query_id, term) with ``weight``: the idf of a term among ``n`` documents; ``known`` has term and df."""
    df = F.coalesce("df", F.lit(0))
    return asked.join(known, "term", "left").select("query_id", "term", F.log(1 + (F.lit(float(n)) - df + 0.5) / (df + 0.5)).alias("weight"))


def sentences(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``pos`` and ``sentence`` of the sentences with a term; ``pos`` counts all pieces between ends."""
    cut = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), SENTENCE_END)).alias("pos", "piece"))
    return cut.select("doc_id", "pos", F.btrim("piece").alias("sentence")).where(F.size(terms(F.col("sentence"))) > 0)


def extracts(weights: DataFrame, found: DataFrame, docs: DataFrame, most: int = SENTENCES) -> DataFrame:
    """At most ``most`` sentences for each question, chosen one by one: ``query_id``, ``nth``, ``doc_id``, ``pos``, ``sentence``, ``gain``.

    ``weights`` has query_id, term and weight, ``found`` query_id, doc_id and
    rank.  A sentence gains the weight of each term of the question that the
    answer lacks and loses :data:`REDUNDANT` of the others; the best one is
    taken while it gains anything.  Ties go by rank of the document, then by
    place.  A question without such a sentence has no row.
    """
    pool = sentences(docs.join(found.select("doc_id").distinct(), "doc_id", "left_semi"))
    said = pool.select("doc_id", "pos", F.explode(F.array_distinct(terms(F.col("sentence")))).alias("term"))
    # Only what questions ask for goes on: no more rows than terms of the best documents.
    held = staged(found.select("query_id", "doc_id", "rank").join(said, "doc_id").join(weights, ["query_id", "term"]), "held")
    has, chosen = None, None
    for nth in range(1, most + 1):
        rows = held.withColumn("worth", F.col("weight")) if has is None else held.join(has, ["query_id", "term"], "left").withColumn("worth", F.when(F.col("has"), -REDUNDANT * F.col("weight")).otherwise(F.col("weight")))
        gains = rows.groupBy("query_id", "doc_id", "rank", "pos").agg(F.round(F.sum("worth"), 6).alias("gain")).where("gain > 0")
        best = gains.groupBy("query_id").agg(F.min(F.struct((-F.col("gain")).alias("loss"), "rank", "pos", "doc_id")).alias("b"))
        now = staged(best.select("query_id", F.lit(nth).alias("nth"), "b.doc_id", "b.pos", (-F.col("b.loss")).alias("gain")), "chosen")
        chosen = now if chosen is None else chosen.unionByName(now)
        if nth < most:
            new = held.join(now.select("query_id", "doc_id", "pos"), ["query_id", "doc_id", "pos"], "left_semi").select("query_id", "term")
            new = new if has is None else new.unionByName(has.select("query_id", "term"))
            has = staged(new.distinct().withColumn("has", F.lit(True)), "has")
    return chosen.join(pool, ["doc_id", "pos"]).select("query_id", "nth", "doc_id", "pos", "sentence", "gain")


def coverage(weights: DataFrame, chosen: DataFrame) -> DataFrame:
    """``query_id`` and ``coverage``: the share of a question's weight whose terms its chosen sentences have."""
    said = chosen.select("query_id", F.explode(F.array_distinct(terms(F.col("sentence")))).alias("term")).distinct().withColumn("has", F.lit(True))
    share = F.sum(F.when(F.col("has"), F.col("weight")).otherwise(F.lit(0.0))) / F.sum("weight")
    return weights.join(said, ["query_id", "term"], "left").groupBy("query_id").agg(F.round(share, 6).alias("coverage"))


def rewritten(asked: DataFrame, found: DataFrame, docs: DataFrame, known: DataFrame, n: int, most: int = EXPANDED) -> DataFrame:
    """``asked`` (query_id, term) with ``factor``: 1 for its own terms, less for the ``most`` terms taken up from ``found``.

    A term's worth is its share of the words of each document found, times its
    idf, averaged over them; the best has the factor :data:`FEEDBACK`, others
    in proportion.  Ties go by term.
    """
    hits = found.select("query_id", "doc_id")
    split = docs.join(hits.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", terms(F.col("text")).alias("w")).select("doc_id", F.size("w").alias("len"), F.explode("w").alias("term"))
    shares = split.groupBy("doc_id", "len", "term").agg(F.count(F.lit(1)).alias("tf")).select("doc_id", "term", (F.col("tf") / F.col("len")).alias("share"))
    many = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("many"))
    idf = F.log(1 + (F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    worth = hits.join(shares, "doc_id").groupBy("query_id", "term").agg(F.sum("share").alias("share")).join(many, "query_id").join(known, "term")
    worth = worth.join(asked.select("query_id", "term"), ["query_id", "term"], "left_anti").select("query_id", "term", F.round(F.col("share") / F.col("many") * idf, 9).alias("worth"))
    best = worth.groupBy("query_id").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("worth")).alias("loss"), "term"))), 1, most).alias("best"))
    more = best.select("query_id", F.col("best")[0]["loss"].alias("top"), F.explode("best").alias("x")).select("query_id", "x.term", F.round(FEEDBACK * F.col("x.loss") / F.col("top"), 6).alias("factor"))
    return asked.select("query_id", "term", F.lit(1.0).alias("factor")).unionByName(more)


def _round(spark: SparkSession, path: str, docs: DataFrame, asked: DataFrame, factors: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, Search]:
    """One round: the documents found, the sentences chosen, and how much of ``asked`` they cover."""
    search = Search(spark, path, factors)
    found = staged(search.best(DOCUMENTS), "found")
    weights = staged(term_weights(asked, search.known, search.n), "weights")
    chosen = staged(extracts(weights, found, docs), "extracts")
    return found, chosen, staged(coverage(weights, chosen), "coverage"), search


def controlled(spark: SparkSession, path: str, docs: DataFrame, queries: DataFrame, least: float = LEAST, rounds: int = 2) -> DataFrame:
    """What the documents say to each of ``queries`` (query_id, text): one row for each that has a term.

    Columns: ``query_id``, ``attempt`` (whose answer it is), ``coverage``,
    ``cites`` (doc_id and pos of each sentence), ``answer``, ``resolved``
    (``least`` is covered) and ``warnings``.  ``path`` is an index of ``docs``
    (doc_id, text).  ``rounds`` of 1 forgoes the rewriting.
    """
    asked = staged(queries.select("query_id", F.explode(F.array_distinct(terms(F.col("text")))).alias("term")).distinct(), "asked")
    found, chosen, covered, search = _round(spark, path, docs, asked, asked.withColumn("factor", F.lit(1.0)))
    tried = covered.select("query_id", F.lit(1).alias("attempt"), "coverage")
    answers = chosen.withColumn("attempt", F.lit(1))
    if rounds > 1:
        left = staged(covered.where(F.col("coverage") < least).select("query_id"), "open")
        again = asked.join(left, "query_id", "left_semi")
        hits = found.join(left, "query_id", "left_semi")
        words = docs.join(hits.select("doc_id").distinct(), "doc_id", "left_semi").select(F.explode(F.array_distinct(terms(F.col("text")))).alias("term")).distinct()
        factors = staged(rewritten(again, hits, docs, search.frequencies(words), search.n), "factors")
        _, chosen2, covered2, _ = _round(spark, path, docs, again, factors)
        tried = tried.unionByName(covered2.select("query_id", F.lit(2).alias("attempt"), "coverage"))
        answers = answers.unionByName(chosen2.withColumn("attempt", F.lit(2)))
    # Of equal coverage the first attempt stays.
    kept = tried.groupBy("query_id").agg(F.max(F.struct("coverage", (-F.col("attempt")).alias("early"))).alias("k"), F.max("attempt").alias("tries"))
    kept = kept.select("query_id", (-F.col("k.early")).alias("attempt"), F.col("k.coverage").alias("coverage"), "tries")
    said = answers.join(kept.select("query_id", "attempt"), ["query_id", "attempt"]).groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("nth", "doc_id", "pos", "sentence"))).alias("s"))
    warned = lambda when, text: F.when(when, F.array(F.lit(text))).otherwise(F.expr("cast(array() as array<string>)"))
    warnings = F.concat(warned(F.col("tries") > 1, "rewritten"), warned(F.col("tries") > F.col("attempt"), "rolled_back"), warned(F.col("coverage") < least, "low_coverage"))
    return kept.join(said, "query_id", "left").select(
        "query_id", "attempt", "coverage", F.transform(F.coalesce("s", F.expr("array()").cast(dict(said.dtypes)["s"])), lambda x: F.struct(x["doc_id"].alias("doc_id"), x["pos"].alias("pos"))).alias("cites"),
        F.array_join(F.col("s.sentence"), ". ").alias("answer"), (F.col("coverage") >= least).alias("resolved"), warnings.alias("warnings"),
    )


def answered_by_cascade(spark: SparkSession, questions: DataFrame, faq: DataFrame, path: str, docs: DataFrame) -> DataFrame:
    """Every question (number, question) by the first step that has an answer: equal, similar, from documents, or none.

    ``faq`` is the curated table (ordinal, id, question_normalized, answer),
    ``path`` an index of ``docs``.  What one step answers does not reach the
    next; the warnings of all steps that a question has met are joined.
    """
    matched = staged(matching.match(questions, faq.drop("answer"), keyless=True).select("number", "decision", "matched_id"), "matched")
    curated = catalogue.last_wins(faq, "id", "ordinal").select(F.col("id").alias("matched_id"), F.col("answer").alias("scenario_answer"))
    text = lambda kind: F.lit(None).cast(kind)
    none = F.expr("cast(array() as array<string>)")
    sure = matched.where(F.col("decision").isin("exact", "accept")).join(curated, "matched_id", "left").where("scenario_answer IS NOT NULL")
    first = sure.select("number", F.lit("scenario").alias("route"), "scenario_answer", text("string").alias("rag_answer"), text("string").alias("rag_path"), text("string").alias("rag_confidence"), text("string").alias("web_answer"), none.alias("warnings"))
    left = staged(questions.join(sure.select("number"), "number", "left_anti").join(matched.select("number", "decision"), "number", "left"), "left")
    asked = left.select(F.col("number").alias("query_id"), F.col("question").alias("text"))
    found = controlled(spark, path, docs, asked).withColumnRenamed("query_id", "number")
    rows = left.select("number", "decision").join(found, "number", "left")
    answer = F.when(F.coalesce("resolved", F.lit(False)), F.col("answer"))
    mode = F.when(answer.isNotNull(), "text")
    confidence = F.when(F.col("attempt") == 1, "high").otherwise("low")  # what was asked anew is shown with caution
    gate = routing.after_rag(answer, mode, confidence, F.lit(False), False, "in_domain_unresolved")
    close = F.when(F.col("decision") == "reject_ambiguous", F.array(F.lit("two curated questions are alike"))).otherwise(none)
    joined = F.concat(close, F.coalesce("warnings", none), gate["warnings"])
    rest = rows.select("number", gate["route"].alias("route"), text("string").alias("scenario_answer"), answer.alias("rag_answer"), mode.alias("rag_path"), confidence.alias("rag_confidence"), text("string").alias("web_answer"), joined.alias("warnings"))
    return routing.final_rows(first.unionByName(rest))
