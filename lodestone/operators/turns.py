"""Turns of a dialogue over a decision graph: where each leaves its session, and what it answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import RESTART, options_of, resolve
from .routing import ABSTAIN
from .sessions import islands

#: What a turn starts from; session fields (position, labels, completed) are not among them.
TURN_DEFAULTS = {
    "normalized_question": "string", "decision": "string", "best": "double", "margin": "double", "route": "string", "route_reason": "string", "answer": "string",
    "confidence": "string", "answer_path": "string", "answer_source": "string",
    "options": "array<struct<option_id:string,label:string>>", "evidence": "array<struct<rank:int,document_name:string,page_number:long>>",
    "warnings": "array<string>", "errors": "array<string>", "trace": "array<struct<node:string,detail:string>>",
}


def with_turn_defaults(turns: DataFrame) -> DataFrame:
    """``turns`` with every per-turn field at its default: an empty list, or null.  Columns of those names are replaced."""
    empty = lambda kind: F.expr("array()").cast(kind) if kind.startswith("array") else F.lit(None).cast(kind)
    return turns.withColumns({name: empty(kind) for name, kind in TURN_DEFAULTS.items()})


def traced(trace: Column, node: str, detail: Column) -> Column:
    """``trace`` with one more step."""
    return F.array_append(trace, F.struct(F.lit(node).alias("node"), detail.alias("detail")))


def turn_states(turns: DataFrame, edges: DataFrame, terminals: DataFrame, root: str, session: str, order: list[str], bucket: Column) -> DataFrame:
    """``turns`` with the state of their session after each of them.

    ``turns`` has ``kind`` (text or action), ``node_id``, ``option_id`` and
    ``label``.  New columns: ``error`` (an action without such an option),
    ``position``, ``completed``, ``epoch`` and ``labels``.  Free text leaves the
    graph; a restart or an arrival at ``root`` clears the labels; any other
    action moves on and adds its label, unless that is blank.  A wrong action
    changes nothing.  The posted node counts, not the session's own.

    ``bucket`` cuts a session into spans of time and must ascend with
    ``order``, so that one session's turns need not fit in a task; what lies
    between two resets does.
    """
    ends = terminals.select(F.col("node_id").alias("next_node_id"), F.lit(True).alias("_end")).distinct()
    action = F.col("kind") == "action"
    rows = resolve(turns, edges).join(ends, "next_node_id", "left").withColumn("error", F.when(action, F.col("error")))
    moved = action & F.col("error").isNull()
    cleared = moved & ((F.col("option_id") == RESTART) | (F.col("next_node_id") == root))
    rows = rows.withColumn("_reset", ~action | cleared)
    rows = islands(rows, session, order, bucket, F.col("_reset")).drop("depth")
    trail = Window.partitionBy(session, "epoch").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    state = F.when(moved, F.struct(F.col("next_node_id").alias("position"), (~cleared & F.coalesce("_end", F.lit(False))).alias("completed")))
    rows = rows.withColumn("_state", F.last(state, ignorenulls=True).over(trail))
    label = F.when(moved & ~cleared & (F.coalesce("label", F.lit("")) != ""), F.col("label"))
    return rows.select(
        *turns.columns, "error", F.col("_state.position").alias("position"), F.coalesce("_state.completed", F.lit(False)).alias("completed"), "epoch", F.collect_list(label).over(trail).alias("labels"),
    )


_META = "type", "node_id", "answer_source", "ref_sheet", "ref_row", "entry_id", "score"


def _meta(**known: Column) -> Column:
    kinds = {"ref_row": "long", "score": "double"}
    return F.struct(*[known.get(name, F.lit(None)).cast(kinds.get(name, "string")).alias(name) for name in _META])


def _answered(rows: DataFrame, answer: Column, path: Column, source: Column, confidence: Column, options: Column, completed: Column, meta: Column) -> DataFrame:
    return rows.select(
        "number", answer.alias("answer"), path.alias("answer_path"), source.alias("answer_source"), confidence.alias("confidence"),
        F.coalesce(options, F.expr("array()").cast("array<struct<option_id:string,label:string>>")).alias("options"), completed.alias("completed"), meta.alias("meta"),
    )


def graph_answers(steps: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """What the node that each of ``steps`` (number, node_id) has reached says: a terminal's answer, or a menu's text, with its options."""
    known = nodes.select("node_id", "type", "text", "answer_text", "answer_source", "ref_sheet", "ref_row")
    rows = steps.select("number", "node_id").join(known, "node_id").join(options_of(edges), "node_id", "left")
    end = F.col("type") == "terminal"
    meta = _meta(
        type=F.lit("scenario"), node_id=F.col("node_id"), answer_source=F.when(end, F.col("answer_source")), ref_sheet=F.when(end, F.col("ref_sheet")), ref_row=F.when(end, F.col("ref_row"))
    )
    return _answered(rows, F.when(end, F.col("answer_text")).otherwise(F.col("text")), F.lit("scenario"), F.lit("scenario_tree"), F.lit("n/a"), F.col("options"), end, meta)


def curated_answers(matches: DataFrame, faq: DataFrame) -> DataFrame:
    """The stored answers of matched questions, word for word; ``matches`` has number, matched_id and best.

    Of entries with equal ids the last one counts.  A match without an entry
    answers nothing.
    """
    last = faq.groupBy(F.col("id").alias("matched_id")).agg(F.max_by(F.struct("answer", "sheet", "row"), "ordinal").alias("e"))
    rows = matches.select("number", "matched_id", "best").join(last, "matched_id", "left")
    hit = F.col("e").isNotNull()
    meta = F.when(hit, _meta(type=F.lit("faq"), ref_sheet=F.col("e.sheet"), ref_row=F.col("e.row"), entry_id=F.col("matched_id"), score=F.col("best")))
    pick = lambda a, b: F.when(hit, a).otherwise(b)
    return _answered(rows, F.col("e.answer"), pick("scenario", "none"), pick("faq_match", "none"), pick("n/a", "unknown"), F.lit(None), F.lit(False), meta)


def match_reason(decision: Column, best: Column, margin: Column, threshold: float, lead: float) -> Column:
    """Why a question was matched or not, with scores to three places."""
    three = lambda x: F.format_string("%.3f", x)
    low = F.concat(F.lit("best "), three(best), F.lit(f" < {threshold:.3f}"))
    close = F.concat(F.lit("lead "), three(margin), F.lit(f" < {lead:.3f}"))
    good = F.concat(F.lit("best "), three(best), F.lit(f" >= {threshold:.3f}, lead "), three(margin), F.lit(f" >= {lead:.3f}"))
    return F.when(decision == "exact", "equal once normalised").when(decision == "reject_low_score", low).when(decision == "reject_ambiguous", close).when(decision == "accept", good)


def route_reason(kind: Column, decision: Column) -> Column:
    """Why a turn goes where :func:`..operators.routing.first_route` sends it."""
    found = decision.isin("exact", "accept")
    return F.when(kind == "action", "option pressed").when(found, F.concat(F.lit("curated question matched: "), decision)).otherwise(F.concat(F.lit("no curated question matched: "), F.coalesce(decision, F.lit("none"))))


def responses(turns: DataFrame) -> DataFrame:
    """The full shape of every answer, by its route.

    ``turns`` has number, route, warnings, seconds, the session's position and
    completed, and the structs ``scenario`` (as :func:`graph_answers` and
    :func:`curated_answers` give), ``rag`` (answer, answer_path, confidence,
    evidence, abstain, run_id) and ``web`` (answer, provider), null where a
    route did not run.  Evidence without a picture is left out.
    """
    route = F.col("route")
    pick = lambda scenario, rag, web, abstain: F.when(route == "scenario", scenario).when(route == "rag", rag).when(route == "web_search", web).otherwise(abstain)
    text = lambda x: F.lit(x)
    none = F.expr("array()")
    shown = F.filter("rag.evidence", lambda e: e["image_url"].isNotNull())
    return turns.select(
        "number", "route",
        pick(F.col("scenario.answer"), F.col("rag.answer"), F.coalesce("web.answer", text("")), text(ABSTAIN)).alias("answer"),
        pick(F.col("scenario.options"), none, none, none).alias("options"),
        pick(F.col("scenario.answer_path"), F.coalesce("rag.answer_path", text("none")), text("web"), text("none")).alias("answer_path"),
        pick(F.col("scenario.answer_source"), text("rag"), text("web"), text("none")).alias("answer_source"),
        pick(F.col("scenario.confidence"), F.coalesce("rag.confidence", text("unknown")), text("unknown"), text("abstain")).alias("confidence"),
        pick(none, F.coalesce(shown, none), none, none).alias("evidence"),
        F.when(route == "rag", F.coalesce("rag.abstain", F.lit(False))).alias("abstained"),
        pick(F.col("scenario.meta.type"), text("rag"), text("web"), text("abstain")).alias("meta_type"),
        F.when(route == "rag", F.col("rag.run_id")).when(route == "web_search", F.col("web.provider")).alias("meta_id"),
        F.struct(F.col("position").alias("node_id"), F.coalesce("completed", F.lit(False)).alias("completed")).alias("scenario"),
        F.coalesce("warnings", none.cast("array<string>")).alias("warnings"), F.round(F.coalesce("seconds", F.lit(0.0)), 3).alias("elapsed_seconds"),
    )


#: Status code of each error class: fixed values.
STATUS = {"invalid_request": 400, "empty_input": 400, "invalid_action": 400, "rag_busy": 429, "rag_unavailable": 503}


def status_of(error: Column) -> Column:
    """The status code of an error, 200 without one, 500 for one not known."""
    out = F.when(error.isNull(), F.lit(200))
    for name, code in STATUS.items():
        out = out.when(error == name, F.lit(code))
    return out.otherwise(F.lit(500))
