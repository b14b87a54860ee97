"""Which way a turn goes, and what its answer looks like."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean

WEB_SCOPES = ("in_domain_unresolved", "any_unresolved")
LOW = ("abstain", "low", "unknown")
CAUTION = "This answer rests on internal documents, but its confidence was rated low."
NOTHING_FOUND = "No answer was found in the internal documents, and web search is off."
ABSTAIN = "Sorry, the documents at hand do not answer this question."


def input_kind(input_type: Column) -> Column:
    return F.when(input_type == "action", "action").otherwise("text")


def input_error(message: Column, has_action: Column, action_type: Column, node_id: Column, option_id: Column) -> Column:
    """Null for a good turn: exactly one of message and action, and a whole action."""
    has_message = clean(message).isNotNull()
    broken = ~(action_type.eqNullSafe("scenario_option") & (F.coalesce(node_id, F.lit("")) != "") & (F.coalesce(option_id, F.lit("")) != ""))
    return F.when(has_message == has_action, F.when(message.isNotNull() & ~has_message & ~has_action, "empty_input").otherwise("invalid_request")).when(has_action & broken, "invalid_action")


def first_route(kind: Column, decision: Column) -> Column:
    return F.when((kind == "action") | F.coalesce(decision.isin("exact", "accept"), F.lit(False)), "scenario").otherwise("rag")


def after_rag(answer: Column, path: Column, confidence: Column, abstained: Column, web_enabled: bool, web_scope: str) -> Column:
    """Struct of route and warnings: an answer is shown, with caution if need be; without one the web is asked, or nothing said."""
    has = clean(answer).isNotNull() & path.isNotNull() & (path != "none")
    low = F.coalesce(confidence.isin(*LOW), F.lit(False)) | F.coalesce(abstained, F.lit(False))
    none = F.expr("cast(array() as array<string>)")
    web = web_enabled and web_scope in WEB_SCOPES
    return F.struct(
        F.when(has, "rag").otherwise("web_search" if web else "abstain").alias("route"),
        F.when(has & low, F.array(F.lit(CAUTION))).when(~has & F.lit(not web), F.array(F.lit(NOTHING_FOUND))).otherwise(none).alias("warnings"),
    )


def final_rows(turns: DataFrame) -> DataFrame:
    """The shape of every answer.  ``turns`` has number, route, scenario_answer, rag_answer, rag_path, rag_confidence, web_answer and warnings."""
    route = F.col("route")
    pick = lambda scenario, rag, web, abstain: F.when(route == "scenario", scenario).when(route == "rag", rag).when(route == "web_search", web).otherwise(abstain)
    return turns.select(
        "number", "route",
        pick(F.col("scenario_answer"), F.col("rag_answer"), F.coalesce("web_answer", F.lit("")), F.lit(ABSTAIN)).alias("answer"),
        pick(F.lit("none"), F.coalesce("rag_path", F.lit("none")), F.lit("none"), F.lit("none")).alias("path"),
        pick(F.lit("n/a"), F.coalesce("rag_confidence", F.lit("unknown")), F.lit("unknown"), F.lit("abstain")).alias("confidence"),
        "warnings",
    )
