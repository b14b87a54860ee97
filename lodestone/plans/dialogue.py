"""Queries over turns, answers, ingest and corpus stores, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rendering
from ..functions import text as T
from ..operators import catalogue, checking, graph, matching, retrieval, routing, turns
from ..operators.staging import fresh_path, staged
from ..sources import corpus, faq, workbook
from . import catalog


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _text(c):
    return F.col(c).cast("string")


def _graph(spark, d):
    """The decision graph of regions, nations and customers, where every nation can start over."""
    again = _t(spark, d, "nation").select(F.concat(F.lit("n"), _text("n_nationkey")).alias("node_id"), F.lit(-1).cast("long").alias("ord"), F.lit(graph.RESTART).alias("option_id"), F.lit("Start over").alias("label"), F.lit("root").alias("next_node_id"))
    return catalog._tree(spark, d).unionByName(again)


GRAPH_SQL = f"""{catalog.TREE_SQL}, g AS (SELECT * FROM edges UNION ALL SELECT 'n' || n_nationkey, -1, '__restart__', 'Start over', 'root' FROM nation)"""


def _ways(spark, d):
    """The decision graph with its restarts, and suppliers, from which a way leads to their nation but none back."""
    more = _t(spark, d, "supplier").select(F.concat(F.lit("s"), _text("s_suppkey")).alias("node_id"), F.concat(F.lit("n"), _text("s_nationkey")).alias("next_node_id"))
    return _graph(spark, d).select("node_id", "next_node_id").unionByName(more)


WAYS_SQL = f"{GRAPH_SQL}, ways AS (SELECT DISTINCT node_id AS a, next_node_id AS b FROM g UNION SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier)"


def graph_findings(spark, d):
    """How far every node is from the root, which cannot be reached, and which menus lead nowhere: every third customer is no end."""
    ways = _ways(spark, d)
    nodes = ways.select("node_id").union(ways.select("next_node_id")).distinct()
    ends = _t(spark, d, "customer").where("c_custkey % 3 <> 0").select(F.concat(F.lit("c"), _text("c_custkey")).alias("node_id"))
    return graph.findings(nodes, ways, spark.range(1).select(F.lit("root").alias("node_id")), ends)


def graph_cycles(spark, d):
    """The nodes that restarts put on cycles, and their components."""
    return graph.cycles(_ways(spark, d))


def _presses(spark, d):
    return _presses_of(_t(spark, d, "events"))


def _presses_of(events):
    """Events as turns: every fourth is free text, the others press options at the root, a region or a nation; some don't exist."""
    e, k = F.col("event_id"), F.col("event_id") % 4
    node = F.when(k == 1, "root").when(k == 2, F.concat(F.lit("r"), (e % 5).cast("string"))).when(k == 3, F.concat(F.lit("n"), (e % 25).cast("string")))
    option = F.when(k == 1, F.concat(F.lit("o"), (e % 7).cast("string"))).when(k == 2, F.concat(F.lit("o"), (e % 25).cast("string")))
    option = option.when(k == 3, F.when(e % 3 == 0, graph.RESTART).otherwise(F.concat(F.lit("o"), (e % 150).cast("string"))))
    label = F.when((k != 0) & (e % 11 != 0), F.concat(F.lit("press "), option))
    return events.select("event_id", "user_id", "ts", F.when(k == 0, "text").otherwise("action").alias("kind"), node.alias("node_id"), option.alias("option_id"), label.alias("label"))


PRESS_SQL = f"""{GRAPH_SQL}, p AS (SELECT event_id, user_id, ts, event_id % 4 = 0 AS is_text,
CASE event_id % 4 WHEN 1 THEN 'root' WHEN 2 THEN 'r' || event_id % 5 WHEN 3 THEN 'n' || event_id % 25 END AS node_id,
CASE event_id % 4 WHEN 1 THEN 'o' || event_id % 7 WHEN 2 THEN 'o' || event_id % 25 WHEN 3 THEN CASE WHEN event_id % 3 = 0 THEN '__restart__' ELSE 'o' || event_id % 150 END END AS option_id FROM events),
r AS (SELECT p.*, next_node_id AS nxt, CASE WHEN event_id % 11 <> 0 THEN 'press ' || p.option_id END AS label FROM p LEFT JOIN g ON g.node_id = p.node_id AND g.option_id = p.option_id),
z AS (SELECT *, NOT is_text AND nxt IS NOT NULL AS moved, is_text OR coalesce(nxt = 'root', false) AS cleared FROM r),
i AS (SELECT *, sum(CASE WHEN cleared THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS epoch FROM z)"""


def _states(spark, d):
    rows, edges = _presses(spark, d), _graph(spark, d)
    ends = _t(spark, d, "customer").select(F.concat(F.lit("c"), _text("c_custkey")).alias("node_id"))
    return turns.turn_states(rows, edges, ends, "root", "user_id", ["ts", "event_id"], F.date_trunc("hour", "ts"))


def turn_state(spark, d):
    """Where each turn leaves its session."""
    return _states(spark, d).select("event_id", F.coalesce("error", F.lit("ok")).alias("error"), "position", "completed", "epoch")


def turn_state_stream(spark, d):
    """The same states from a stream: the events land in four files by time, each a batch."""
    from ..streaming.turns import run_turns

    base, events = fresh_path(spark, "turns"), _t(spark, d, "events")
    cuts = events.agg(F.percentile_approx("ts", [0.25, 0.5, 0.75])).first()[0] or []
    part = sum([(F.col("ts") > F.lit(c)).cast("int") for c in cuts], F.lit(0))
    for k in range(4):
        events.where(part == k).coalesce(1).write.mode("append").parquet(f"{base}/landed")
    shaped = lambda rows: _presses_of(rows).select(F.col("user_id").cast("string").alias("session"), "ts", F.col("event_id").alias("turn_id"), "kind", "node_id", "option_id", "label")
    ends = _t(spark, d, "customer").select(F.concat(F.lit("c"), _text("c_custkey")).alias("node_id"))
    found = run_turns(spark, f"{base}/landed", events.schema, shaped, _graph(spark, d), ends, "root", f"{base}/out", f"{base}/state", files=1)
    return found.select(F.col("turn_id").alias("event_id"), F.coalesce("error", F.lit("ok")).alias("error"), "position", "completed", "epoch")


def breadcrumb_paths(spark, d):
    """The labels pressed since the session was last cleared."""
    return _states(spark, d).select("event_id", F.array_join("labels", ">").alias("path"), F.size("labels").cast("long").alias("depth"))


def turn_status(spark, d):
    """The status code of each turn: wrong presses, and errors of the engine by the kind of event."""
    rows = graph.resolve(_presses(spark, d).join(_t(spark, d, "events").select("event_id", "event_type"), "event_id"), _graph(spark, d))
    engine = F.when((F.col("event_type") == "error"), F.when(F.col("event_id") % 8 == 0, "rag_busy").otherwise("rag_unavailable"))
    error = F.when(F.col("kind") == "action", F.col("error")).otherwise(engine)
    return rows.select("event_id", turns.status_of(error).cast("long").alias("status"))


def _nodes(spark, d):
    """Menus and terminals of the graph: every other customer's answer is a reference to a curated one."""
    none = F.lit(None).cast("string")
    menu = lambda rows, node, text: rows.select(node.alias("node_id"), F.lit("menu").alias("type"), text.alias("text"), none.alias("answer_text"), none.alias("answer_source"), none.alias("ref_sheet"), F.lit(None).cast("long").alias("ref_row"))
    c = _t(spark, d, "customer")
    ref = F.col("c_custkey") % 2 == 0
    ends = c.select(
        F.concat(F.lit("c"), _text("c_custkey")).alias("node_id"), F.lit("terminal").alias("type"), F.col("c_name").alias("text"), F.when(~ref, F.concat(F.lit("Segment "), "c_mktsegment")).alias("answer_text"),
        F.when(ref, "faq_ref").otherwise("scenario_ppt").alias("answer_source"), F.when(ref, "curated").alias("ref_sheet"), F.when(ref, F.col("c_custkey") % 20).alias("ref_row"),
    )
    faq_rows = _t(spark, d, "benchmark").select(F.lit("curated").alias("ref_sheet"), F.col("item_id").alias("ref_row"), F.concat(F.lit("Answer "), _text("item_id")).alias("curated"))
    ends = ends.join(faq_rows, ["ref_sheet", "ref_row"], "left").select("node_id", "type", "text", F.coalesce("answer_text", "curated").alias("answer_text"), "answer_source", "ref_sheet", "ref_row")
    roots = menu(spark.range(1), F.lit("root"), F.lit("Where?"))
    return roots.unionByName(menu(_t(spark, d, "region"), F.concat(F.lit("r"), _text("r_regionkey")), F.col("r_name"))).unionByName(menu(_t(spark, d, "nation"), F.concat(F.lit("n"), _text("n_nationkey")), F.col("n_name"))).unionByName(ends)


def _scenario_answers(spark, d):
    moved = graph.resolve(_presses(spark, d), _graph(spark, d)).where("error IS NULL").select(F.col("event_id").alias("number"), F.col("next_node_id").alias("node_id"))
    asked = catalog.exact_lookup(spark, d).select((-F.col("number") - 1_000_000_000_000).alias("number"), "matched_id", F.lit(1.0).alias("best"))
    entries = catalog._faq(spark, d).select("ordinal", "id", "answer", F.lit("curated").alias("sheet"), F.col("ordinal").alias("row"))
    return turns.graph_answers(moved, _nodes(spark, d), _graph(spark, d)).unionByName(turns.curated_answers(asked, entries))


def scenario_answers(spark, d):
    """What pressed options and exactly matched questions answer."""
    rows = _scenario_answers(spark, d)
    return rows.select(
        "number", "answer", "answer_path", "answer_source", "confidence", F.size("options").cast("long").alias("n_options"), "completed",
        F.col("meta.type").alias("meta_type"), F.col("meta.node_id").alias("node_id"), F.col("meta.answer_source").alias("node_source"), F.col("meta.ref_row").alias("ref_row"), F.col("meta.entry_id").alias("entry_id"),
    )


def turn_responses(spark, d):
    """Documents as turns: some answered from the graph, others by retrieval as their labels say, the rest by the web."""
    docs = _t(spark, d, "documents").join(_t(spark, d, "labels"), "doc_id", "left")
    quality, toxic = F.col("quality"), F.col("toxic")
    confidence = F.when(quality == 1, "high").when(quality == 0, "low")
    path = F.when(quality.isNull(), F.when(F.col("lang") == "en", "none")).otherwise("text")
    gate = routing.after_rag(F.col("text"), path, confidence, toxic == 1, True, "any_unresolved")
    pressed = F.col("doc_id") % 5 == 0
    line = lambda k: F.struct(F.lit(k).alias("rank"), F.col("source").alias("document_name"), F.when(F.col("n_chars") > 100 * k, F.concat(F.lit("/evidence/"), F.lit(str(k)))).alias("image_url"))
    none = F.expr("array()").cast("array<struct<option_id:string,label:string>>")
    scenario = F.struct(F.lit("A stored answer").alias("answer"), none.alias("options"), F.lit("scenario").alias("answer_path"), F.lit("scenario_tree").alias("answer_source"), F.lit("n/a").alias("confidence"), F.struct(F.lit("scenario").alias("type")).alias("meta"))
    rag = F.struct(F.col("text").alias("answer"), path.alias("answer_path"), confidence.alias("confidence"), F.array(line(1), line(2), line(3)).alias("evidence"), (toxic == 1).alias("abstain"), F.concat(F.lit("run"), _text("doc_id")).alias("run_id"))
    web = F.struct(F.col("lang").alias("answer"), F.lit("disabled").alias("provider"))
    rows = docs.select(
        F.col("doc_id").alias("number"), F.when(pressed, "scenario").otherwise(gate["route"]).alias("route"), gate["warnings"].alias("warnings"), (F.col("n_chars") / 7.0).alias("seconds"),
        F.when(pressed, F.lit("root")).alias("position"), F.when(pressed, F.lit(False)).alias("completed"), scenario.alias("scenario"), rag.alias("rag"), web.alias("web"),
    )
    out = turns.responses(rows.where("route <> 'rag' OR number % 3 <> 0").unionByName(rows.where("route = 'rag' AND number % 3 = 0").withColumn("route", F.lit("abstain"))))
    return out.select(
        "number", "route", F.md5("answer").alias("answer_md5"), "answer_path", "answer_source", "confidence", F.size("evidence").cast("long").alias("n_evidence"), F.coalesce("abstained", F.lit(False)).alias("abstained"),
        "meta_type", "meta_id", F.col("scenario.node_id").alias("node_id"), F.col("scenario.completed").alias("completed"), rendering.badge(F.col("confidence")).alias("badge"), F.floor(F.col("elapsed_seconds") * 10).alias("tenths"),
    )


def route_reasons(spark, d):
    """Why each question goes where it goes, by exact lookup alone."""
    rows = catalog.exact_lookup(spark, d)
    decision = F.when(F.col("matched_id").isNotNull(), "exact").otherwise("reject_low_score")
    none = F.lit(0.0)
    why = turns.match_reason(decision, F.when(F.col("matched_id").isNotNull(), 1.0).otherwise(none), none, matching.THRESHOLD, matching.MARGIN)
    return rows.select("number", routing.first_route(F.lit("text"), decision).alias("route"), why.alias("match_reason"), turns.route_reason(F.lit("text"), decision).alias("route_reason"))


def _sheet_rows(spark, d):
    """Conversations as the rows of workbook sheets, one for each role: heads with stray spaces, blank cells, short rows."""
    said = _t(spark, d, "conversations")
    row = (F.col("conv_id") * 100 + F.col("turn") + 2).cast("int")
    question = F.when(F.col("turn") % 5 == 4, F.lit("  ")).otherwise(F.substring_index("text", ".", 1))
    cells = F.array(_text("turn"), F.concat(F.lit(" "), question, F.lit("?")), F.when(F.col("turn") % 3 == 2, F.lit("")).otherwise(F.col("text")), F.lit("a.pdf; b.pdf\na.pdf"))
    cells = F.when(F.col("conv_id") % 7 == 3, F.slice(cells, 1, 2)).otherwise(cells)
    heads = F.array(F.lit("No"), F.lit(" 질 문 "), F.lit("답변"), F.lit("질문답변생성 근거파일명"), F.lit("질문"))
    return said.select(F.col("role").alias("sheet"), F.lit(1).alias("row"), heads.alias("cells")).distinct().unionByName(said.select(F.col("role").alias("sheet"), row.alias("row"), cells.alias("cells")))


_SHEETS = ["user", "assistant"]


def faq_ingest(spark, d):
    """Workbook rows to curated entries."""
    entries, _ = catalogue.entries_of(_sheet_rows(spark, d), _SHEETS)
    return entries.select("id", F.col("no").cast("long").alias("no"), "question", F.char_length("answer").cast("long").alias("answer_chars"), F.array_join("source_files", ",").alias("files"))


def ingest_summary(spark, d):
    """By sheet: entries, dropped rows, and entries whose question came before in any sheet."""
    entries, dropped = catalogue.entries_of(_sheet_rows(spark, d), _SHEETS)
    sheets = spark.createDataFrame([(s,) for s in _SHEETS], "sheet string")
    late = catalogue.later_duplicates(entries, "question_normalized", "ordinal", "id").select(F.substring_index("id", ":", 1).alias("sheet"))
    count = lambda rows, name: catalogue.counts_with_zero(sheets, rows, "sheet").withColumnRenamed("n", name)
    return count(entries, "entries").join(count(dropped, "dropped"), "sheet").join(count(late, "duplicates"), "sheet")


def workbook_round_trip(spark, d):
    """The sheets written to workbooks, one a task, and read again, one partition a sheet."""
    workbook.register(spark)
    path, rows = fresh_path(spark, "workbooks"), _sheet_rows(spark, d).where("sheet IS NOT NULL AND row > 1")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows.repartition(n, "row").sortWithinPartitions("sheet", "row").write.format("workbook").mode("append").save(path)
    found = spark.read.format("workbook").load(path)
    return found.select("sheet", F.col("row").cast("long").alias("row"), F.size("cells").cast("long").alias("n_cells"), F.md5(F.array_join("cells", "|", "-")).alias("cells_md5"))


def ingest_run(spark, d):
    """The counts of one pass that stores the entries, beside what is stored then."""
    stored, counts = catalogue.ingest(_sheet_rows(spark, d), _SHEETS, fresh_path(spark, "entries"))
    told = spark.createDataFrame([(s, counts[f"entries:{s}"], counts[f"dropped:{s}"]) for s in _SHEETS], "sheet string, entries long, dropped long")
    return told.join(stored.groupBy("sheet").agg(F.count(F.lit(1)).alias("stored")), "sheet", "left").select("sheet", "entries", "dropped", F.coalesce("stored", F.lit(0)).alias("stored"))


INGEST_SQL = r"""x AS (SELECT role AS sheet, conv_id * 100 + turn + 2 AS row, CAST(turn AS VARCHAR) AS no, conv_id % 7 = 3 AS short, text, turn,
' ' || CASE WHEN turn % 5 = 4 THEN '  ' ELSE string_split(text, '.')[1] END || '?' AS q, CASE WHEN turn % 3 = 2 THEN '' ELSE text END AS a FROM conversations WHERE role IN ('user', 'assistant')),
y AS (SELECT *, regexp_replace(q, '^\s+|\s+$', '', 'g') AS question, CASE WHEN short THEN NULL ELSE nullif(regexp_replace(a, '^\s+|\s+$', '', 'g'), '') END AS answer FROM x)"""


def graph_violations(spark, d):
    """Faults of a graph: customers of nations that are missing, doubled options, terminals without answers."""
    edges = _graph(spark, d)
    doubled = edges.where("option_id = 'o1' AND node_id LIKE 'r%'").withColumn("next_node_id", F.concat(F.lit("lost"), "node_id"))
    nodes = _nodes(spark, d).where("NOT (type = 'terminal' AND node_id LIKE '%99')").withColumn("key", F.when(F.col("node_id").endswith("50"), F.concat("node_id", F.lit("x"))).otherwise(F.col("node_id")))
    blank = F.when(F.col("node_id").endswith("33"), F.lit("")).otherwise(F.col("answer_text"))
    source = F.when(F.col("node_id").endswith("77"), F.lit("elsewhere")).otherwise(F.col("answer_source"))
    nodes = nodes.withColumn("answer_text", blank).withColumn("answer_source", source)
    known = _t(spark, d, "benchmark").where("item_id < 15").select(F.lit("curated").alias("sheet"), F.col("item_id").alias("row"))
    root = spark.range(1).select(F.lit("root").alias("node_id"))
    return graph.violations(nodes, edges.unionByName(doubled), root, known).select("rule", "node_id", "detail")


def answer_html(spark, d):
    """Turns shown as HTML: every third line a bullet, every fourth a heading."""
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.when(i % 3 == 1, F.concat(F.lit(" - **"), x, F.lit("** & <b>"))).when(i % 4 == 2, F.concat(F.lit("**"), x, F.lit("**:"))).when(i % 7 == 5, F.lit(" ")).otherwise(x))
    marked = F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n- next"))), "\n")
    return _t(spark, d, "conversations").select("conv_id", "turn", F.md5(rendering.answer_html(marked)).alias("html_md5"), F.char_length(rendering.answer_html(marked)).cast("long").alias("chars"))


def shown_fields(spark, d):
    """What the side panel of an answer shows of each event: pairs with a value, tags, badge, numbers."""
    pairs = F.create_map(F.lit("type"), F.col("event_type"), F.lit("user"), F.when(F.col("user_id") % 2 == 0, _text("user_id")), F.lit("note"), F.when(F.col("event_id") % 3 == 0, F.lit("")).otherwise(F.lit("n")))
    confidence = F.when(F.col("event_type") == "view", "high").when(F.col("event_type") == "error", "abstain").when(F.col("event_type") == "click", "low")
    tags = rendering.tags(["demo", "batch"], F.array(F.lit("batch"), F.col("event_type")), F.lit("slow"), F.col("event_id") % 2 == 0)
    name = F.concat(F.lit("ev"), F.when(F.col("event_id") % 5 == 0, F.lit("..")).otherwise(_text("event_id")), F.when(F.col("event_id") % 7 == 0, F.lit("/x")).otherwise(F.lit(".png")))
    return _t(spark, d, "events").select(
        "event_id", F.array_join(F.array_sort(F.map_keys(rendering.shown_pairs(pairs))), ",").alias("keys"), F.array_join(tags, ",").alias("tags"), rendering.badge(confidence).alias("badge"),
        rendering.fixed(F.when(F.col("event_id") % 2 == 0, F.floor(F.col("value"))), 1).alias("shown"), rendering.is_file_name(name).alias("served"),
    )


def answer_rates(spark, d):
    """Refusals, misreadings, inventions and failures of the assistant's turns, by how far into a conversation they are."""
    said = _t(spark, d, "conversations")
    heard = said.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("evidence"))
    rows = said.where("role = 'assistant'").join(heard, ["conv_id", "turn"], "left").join(_t(spark, d, "labels").withColumnRenamed("doc_id", "conv_id"), "conv_id", "left")
    loose = F.size(checking.unsupported_numbers(F.col("text"), F.col("evidence"))) > 0
    rows = rows.select(
        "turn", (checking.abstains(F.col("text")) | (F.col("toxic") == 1)).alias("refused"), (F.col("quality") == 0).alias("irrelevant"), (F.col("turn") % 4 == 1).alias("by_sight"),
        (F.col("conv_id") % 3 == 0).alias("wrong"), loose.alias("unsupported"), F.col("evidence").isNotNull().alias("has_evidence"), (F.col("turn") % 3 + 1).alias("calls"),
    )
    return checking.answer_rates(rows, "turn")


def token_costs(spark, d):
    """Words as tokens: what the turn before holds is read, the assistant's own are written."""
    said = _t(spark, d, "conversations")
    count = lambda c: F.size(T.terms(F.col(c)))
    heard = said.select("conv_id", (F.col("turn") + 1).alias("turn"), count("text").alias("tokens_in"))
    calls = said.where("role = 'assistant'").select("conv_id", "turn", count("text").alias("tokens_out")).join(heard, ["conv_id", "turn"], "left")
    return checking.token_costs(calls, "turn", 0.1, 0.4)


def sentence_citations(spark, d):
    """Which sentences of an assistant's turn have at least a fifth of their words from the turn before."""
    said = _t(spark, d, "conversations")
    heard = said.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("evidence"))
    return checking.citations(said.where("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("answer")).join(heard, ["conv_id", "turn"], "left"), 0.2)


def rerank_topk(spark, d):
    """BM25 hits in the order of another scorer: the share of the query's distinct words that a document has, from a tenth up."""
    found = catalog._bm25(spark, d, 20)
    asked = _t(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.array_distinct(T.terms(F.col("text"))).alias("wants"))
    hits = found.join(_t(spark, d, "documents").select("doc_id", "text"), "doc_id")
    # Staged before their words are taken, so that only documents that were found are split.
    pairs = staged(hits, "hits").join(asked, "query_id").select("query_id", "doc_id", F.array_distinct(T.terms(F.col("text"))).alias("has"), "wants")
    share = lambda rows: F.round(F.size(F.array_intersect("has", "wants")) / F.size("wants"), 6)
    return retrieval.reranked(pairs, share, 5, 0.1).select("query_id", "doc_id", "score", "rank")


def retry_once(spark, d):
    """Questions looked up as they are, and if that finds nothing once more without their first word."""
    keys = catalogue.first_wins(catalog._faq(spark, d), "question_normalized", "ordinal").select("question_normalized", "id")
    look_up = lambda rewrite: lambda rows: matching.exact(rows.withColumn("text", rewrite), keys, "text", "question_normalized").select("number", "question", F.col("id").alias("matched_id"))
    normal = T.normalized(F.col("question"))
    attempts = [look_up(normal), look_up(F.regexp_replace(normal, r"\A\S+ ", ""))]
    return retrieval.with_retries(catalog._questions(spark, d), attempts, F.col("matched_id").isNotNull()).select("number", "matched_id", F.col("attempt").cast("long").alias("attempt"))


def incremental_add(spark, d):
    """A corpus of nine tenths of the documents to which all are added, twice: each is held once."""
    docs = _t(spark, d, "documents").select("doc_id", "text", "lang")
    path = fresh_path(spark, "corpus")
    docs.where("doc_id % 10 <> 0").write.parquet(path)
    corpus.add_documents(docs, path)
    corpus.add_documents(docs, path)
    return spark.read.parquet(path).select("doc_id", F.md5("text").alias("text_md5"))


def page_store(spark, d):
    """The lines of documents as pages in a store; the second page of each, looked up by key."""
    pages = _t(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text")).select("doc_id", (F.col("pos") + 1).alias("page_no"), "text")
    path = fresh_path(spark, "pages")
    corpus.write_pages(pages, path)
    wanted = _t(spark, d, "documents").select("doc_id", F.lit(2).alias("page_no"))
    return corpus.read_pages(spark, path, wanted).select("doc_id", F.char_length("text").cast("long").alias("chars"))


def text_dump(spark, d):
    """Texts dumped as lines by language and read again."""
    path = fresh_path(spark, "dump")
    corpus.dump_texts(_t(spark, d, "documents"), path)
    return spark.read.text(path).groupBy("lang").agg(F.count(F.lit(1)).alias("lines"), F.sum(F.char_length("value")).cast("long").alias("chars"))


def results_report(spark, d):
    """Results written as JSON lines, nulls kept, and read again."""
    path = fresh_path(spark, "report")
    corpus.write_report(catalog.exact_lookup(spark, d), path)
    return spark.read.schema("number long, matched_id string").json(path)


def envelope_round_trip(spark, d):
    """Curated entries written to the envelope and read again."""
    entries, _ = catalogue.entries_of(_sheet_rows(spark, d), _SHEETS)
    counts = catalogue.counts_with_zero(spark.createDataFrame([(s,) for s in _SHEETS], "sheet string"), entries, "sheet")
    path = fresh_path(spark, "envelope")
    faq.envelope(entries, counts, "book.xlsx").select(F.to_json(F.struct("*")).alias("value")).write.text(path)
    return faq.read_entries(spark, path).select("id", F.col("ordinal").cast("long").alias("ordinal"), F.md5("answer").alias("answer_md5"))


def block_chunks(spark, d):
    """Documents cut into chunks of whole lines."""
    found = retrieval.block_chunks(_t(spark, d, "documents").select("doc_id", "text"))
    return found.select("doc_id", "start", "is_table", F.char_length("text").cast("long").alias("chars"), F.md5("text").alias("text_md5"))


_FUNCTIONS = (
    turn_state, turn_state_stream, graph_findings, graph_cycles, breadcrumb_paths, turn_status, scenario_answers, turn_responses, route_reasons, faq_ingest, ingest_summary, ingest_run, workbook_round_trip, graph_violations, answer_html, shown_fields,
    answer_rates, token_costs, sentence_citations, rerank_topk, retry_once, incremental_add, page_store, text_dump, results_report, envelope_round_trip, block_chunks,
)
QUERIES = {f.__name__: f for f in _FUNCTIONS}

_HEARD = "FROM conversations a LEFT JOIN conversations h ON h.conv_id = a.conv_id AND h.turn + 1 = a.turn"
_TERMS = r"list_filter(regexp_split_to_array(lower(coalesce({0}, '')), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"
_NUMBERS = r"list_transform(regexp_extract_all({0}, '\d+(?:[.,]\d+)*'), lambda x: replace(x, ',', ''))"
_RUN = "PARTITION BY user_id, epoch ORDER BY ts, event_id"

ORACLE_SQL = {
    "block_chunks": r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
c AS (SELECT doc_id, pos, line, starts_with(line, '|') AS is_table, unnest(generate_series(0, CAST(greatest(1, ceil(length(line) / 700.0)) AS BIGINT) - 1)) AS i FROM l),
p AS (SELECT doc_id, pos, i, is_table, CASE WHEN i = 0 AND pos > 1 THEN chr(10) ELSE '' END AS br, substr(line, i * 700 + 1, 700) AS piece FROM c),
a AS (SELECT *, CAST(sum(length(br) + length(piece)) OVER w - length(piece) AS BIGINT) AS begins, CASE WHEN is_table <> lag(is_table) OVER w THEN 1 ELSE 0 END AS change FROM p WINDOW w AS (PARTITION BY doc_id ORDER BY pos, i)),
r AS (SELECT *, sum(change) OVER (PARTITION BY doc_id ORDER BY pos, i) AS run FROM a),
g AS (SELECT doc_id, is_table, min(begins) AS start, regexp_replace(string_agg(br || piece, '' ORDER BY pos, i), '^\n', '') AS text FROM r GROUP BY doc_id, run, begins // 700, is_table)
SELECT doc_id, start, is_table, length(text) AS chars, md5(text) AS text_md5 FROM g WHERE regexp_matches(text, '\S')""",
    "turn_state": f"""WITH {PRESS_SQL}
SELECT event_id, CASE WHEN NOT is_text AND nxt IS NULL THEN 'invalid_action' ELSE 'ok' END AS error, last_value(CASE WHEN moved THEN nxt END IGNORE NULLS) OVER ({_RUN}) AS position,
coalesce(last_value(CASE WHEN moved THEN nxt LIKE 'c%' END IGNORE NULLS) OVER ({_RUN}), false) AS completed, CAST(epoch AS BIGINT) AS epoch FROM i""",
    "breadcrumb_paths": f"""WITH {PRESS_SQL}, k AS (SELECT event_id, list(CASE WHEN moved AND NOT cleared THEN label END) OVER ({_RUN}) AS x FROM i), l AS (SELECT event_id, list_filter(x, lambda v: v IS NOT NULL) AS x FROM k)
SELECT event_id, coalesce(array_to_string(x, '>'), '') AS path, len(x) AS depth FROM l""",
    "turn_status": f"""WITH {PRESS_SQL} SELECT event_id, CASE WHEN NOT is_text THEN CASE WHEN nxt IS NULL THEN 400 ELSE 200 END WHEN event_type = 'error' THEN CASE WHEN event_id % 8 = 0 THEN 429 ELSE 503 END ELSE 200 END AS status
FROM i JOIN (SELECT event_id, event_type FROM events) USING (event_id)""",
    "scenario_answers": f"""WITH {PRESS_SQL}, o AS (SELECT node_id, count(*) AS n FROM g GROUP BY node_id),
node AS (SELECT 'root' AS node_id, false AS ends, 'Where?' AS answer, NULL AS src, NULL AS ref UNION ALL SELECT 'r' || r_regionkey, false, r_name, NULL, NULL FROM region UNION ALL SELECT 'n' || n_nationkey, false, n_name, NULL, NULL FROM nation
UNION ALL SELECT 'c' || c_custkey, true, CASE WHEN c_custkey % 2 = 1 THEN 'Segment ' || c_mktsegment ELSE 'Answer ' || item_id END, CASE WHEN c_custkey % 2 = 1 THEN 'scenario_ppt' ELSE 'faq_ref' END, CASE WHEN c_custkey % 2 = 0 THEN c_custkey % 20 END
FROM customer LEFT JOIN benchmark ON item_id = c_custkey % 20 AND c_custkey % 2 = 0),
{catalog._ASKED}, bk AS (SELECT {catalog.NORM_SQL} AS key, CAST(min(item_id) AS VARCHAR) AS id FROM benchmark GROUP BY 1), m AS (SELECT number, id FROM (SELECT number, {catalog.NORM_SQL} AS key FROM asked) LEFT JOIN bk USING (key))
SELECT event_id AS number, answer, 'scenario' AS answer_path, 'scenario_tree' AS answer_source, 'n/a' AS confidence, coalesce(n, 0) AS n_options, ends AS completed, 'scenario' AS meta_type, node.node_id, src AS node_source, ref AS ref_row, NULL AS entry_id
FROM i JOIN node ON node.node_id = nxt LEFT JOIN o ON o.node_id = nxt WHERE moved
UNION ALL SELECT -number - 1000000000000, 'Answer ' || id, CASE WHEN id IS NULL THEN 'none' ELSE 'scenario' END, CASE WHEN id IS NULL THEN 'none' ELSE 'faq_match' END, CASE WHEN id IS NULL THEN 'unknown' ELSE 'n/a' END, 0, false, CASE WHEN id IS NOT NULL THEN 'faq' END, NULL, NULL, CAST(id AS BIGINT), id FROM m""",
    "turn_responses": f"""WITH r AS (SELECT doc_id, text, lang, n_chars, quality, toxic, CASE WHEN quality IS NULL THEN CASE WHEN lang = 'en' THEN 'none' END ELSE 'text' END AS path FROM documents LEFT JOIN labels USING (doc_id)),
h AS (SELECT *, trim(regexp_replace(text, '\\s+', ' ', 'g')) <> '' AND path IS NOT NULL AND path <> 'none' AS has FROM r),
w AS (SELECT *, CASE WHEN doc_id % 5 = 0 THEN 'scenario' WHEN NOT coalesce(has, false) THEN 'web_search' WHEN doc_id % 3 = 0 THEN 'abstain' ELSE 'rag' END AS route FROM h),
c AS (SELECT *, CASE route WHEN 'scenario' THEN 'n/a' WHEN 'rag' THEN CASE quality WHEN 1 THEN 'high' WHEN 0 THEN 'low' ELSE 'unknown' END WHEN 'web_search' THEN 'unknown' ELSE 'abstain' END AS confidence FROM w)
SELECT doc_id AS number, route, md5(CASE route WHEN 'scenario' THEN 'A stored answer' WHEN 'rag' THEN text WHEN 'web_search' THEN coalesce(lang, '') ELSE '{routing.ABSTAIN}' END) AS answer_md5,
CASE route WHEN 'scenario' THEN 'scenario' WHEN 'rag' THEN path WHEN 'web_search' THEN 'web' ELSE 'none' END AS answer_path, CASE route WHEN 'scenario' THEN 'scenario_tree' WHEN 'rag' THEN 'rag' WHEN 'web_search' THEN 'web' ELSE 'none' END AS answer_source,
confidence, CASE WHEN route = 'rag' THEN CAST(n_chars > 100 AS BIGINT) + CAST(n_chars > 200 AS BIGINT) + CAST(n_chars > 300 AS BIGINT) ELSE 0 END AS n_evidence, route = 'rag' AND coalesce(toxic = 1, false) AS abstained,
CASE route WHEN 'scenario' THEN 'scenario' WHEN 'rag' THEN 'rag' WHEN 'web_search' THEN 'web' ELSE 'abstain' END AS meta_type, CASE route WHEN 'rag' THEN 'run' || doc_id WHEN 'web_search' THEN 'disabled' END AS meta_id,
CASE WHEN route = 'scenario' THEN 'root' END AS node_id, false AS completed, CASE confidence WHEN 'high' THEN 'badge high' WHEN 'low' THEN 'badge low' WHEN 'unknown' THEN 'badge low' WHEN 'abstain' THEN 'badge abstain' ELSE 'badge' END AS badge,
CAST(floor(round(n_chars / 7.0, 3) * 10) AS BIGINT) AS tenths FROM c""",
    "route_reasons": f"""WITH {catalog._ASKED}, k AS (SELECT {catalog.NORM_SQL} AS key, CAST(min(item_id) AS VARCHAR) AS id FROM benchmark GROUP BY 1)
SELECT number, CASE WHEN id IS NULL THEN 'rag' ELSE 'scenario' END AS route, CASE WHEN id IS NULL THEN 'best 0.000 < 0.900' ELSE 'equal once normalised' END AS match_reason,
CASE WHEN id IS NULL THEN 'no curated question matched: reject_low_score' ELSE 'curated question matched: exact' END AS route_reason FROM (SELECT number, {catalog.NORM_SQL} AS key FROM asked) LEFT JOIN k USING (key)""",
    "faq_ingest": f"""WITH {INGEST_SQL} SELECT sheet || ':' || row AS id, CAST(no AS BIGINT) AS no, question, length(answer) AS answer_chars, 'a.pdf,b.pdf' AS files FROM y WHERE question <> '' AND answer IS NOT NULL""",
    "ingest_summary": f"""WITH {INGEST_SQL}, e AS (SELECT sheet, row, {catalog.NORM_SQL.replace("coalesce(text, '')", "question")} AS key FROM y WHERE question <> '' AND answer IS NOT NULL),
l AS (SELECT sheet, row_number() OVER (PARTITION BY key ORDER BY CASE sheet WHEN 'user' THEN 0 ELSE 1 END, row) > 1 AS late FROM e)
SELECT s.sheet, (SELECT count(*) FROM e WHERE e.sheet = s.sheet) AS entries, (SELECT count(*) FROM y WHERE y.sheet = s.sheet AND (question = '' OR answer IS NULL)) AS dropped, (SELECT count(*) FROM l WHERE l.sheet = s.sheet AND late) AS duplicates
FROM (SELECT unnest(['user', 'assistant']) AS sheet) s""",
    "graph_violations": f"""WITH {GRAPH_SQL}, e2 AS (SELECT * FROM g UNION ALL SELECT node_id, ord, option_id, label, 'lost' || node_id FROM g WHERE option_id = 'o1' AND node_id LIKE 'r%'),
n AS (SELECT 'root' AS node_id, false AS ends, NULL AS src, NULL AS ref, NULL AS txt UNION ALL SELECT 'r' || r_regionkey, false, NULL, NULL, NULL FROM region UNION ALL SELECT 'n' || n_nationkey, false, NULL, NULL, NULL FROM nation
UNION ALL SELECT 'c' || c_custkey, true, CASE WHEN c_custkey % 100 = 77 THEN 'elsewhere' WHEN c_custkey % 2 = 1 THEN 'scenario_ppt' ELSE 'faq_ref' END, CASE WHEN c_custkey % 2 = 0 THEN c_custkey % 20 END, CASE WHEN c_custkey % 100 = 33 THEN '' ELSE 'x' END FROM customer WHERE c_custkey % 100 <> 99)
SELECT 'key_mismatch' AS rule, node_id || 'x' AS node_id, node_id AS detail FROM n WHERE node_id LIKE '%50'
UNION ALL SELECT 'duplicate_option', node_id, option_id FROM e2 GROUP BY node_id, option_id HAVING count(*) > 1
UNION ALL SELECT 'no_text', node_id, 'terminal' FROM n WHERE ends AND src = 'scenario_ppt' AND txt = '' UNION ALL SELECT 'unknown_source', node_id, src FROM n WHERE src = 'elsewhere'
UNION ALL SELECT 'dangling_ref', node_id, 'curated' FROM n WHERE src = 'faq_ref' AND NOT EXISTS (SELECT 1 FROM benchmark WHERE item_id < 15 AND item_id = ref)
UNION ALL SELECT 'dangling_edge', node_id, next_node_id FROM e2 WHERE next_node_id NOT IN (SELECT node_id FROM n)""",
    "answer_html": r"""WITH l AS (SELECT conv_id, turn, list_transform(string_split(text, chr(10)), lambda x, i: CASE WHEN (i - 1) % 3 = 1 THEN ' - **' || x || '** & <b>' WHEN (i - 1) % 4 = 2 THEN '**' || x || '**:' WHEN (i - 1) % 7 = 5 THEN ' ' ELSE x END || chr(10) || '- next') AS y FROM conversations),
e AS (SELECT conv_id, turn, unnest(z) AS line, generate_subscripts(z, 1) AS pos FROM (SELECT conv_id, turn, string_split(array_to_string(y, chr(10)), chr(10)) AS z FROM l)),
t AS (SELECT conv_id, turn, pos, regexp_replace(line, '^\s+|\s+$', '', 'g') AS s FROM e),
k AS (SELECT *, regexp_matches(s, '^[*-]\s+') AS item, replace(replace(replace(s, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS esc FROM t),
h AS (SELECT *, CASE WHEN s = '' THEN '' WHEN item THEN '<li>' || regexp_replace(regexp_replace(esc, '^[*-]\s+', ''), '\*\*(.+?)\*\*', '<strong>\1</strong>', 'g') || '</li>'
WHEN regexp_matches(s, '^\*\*(.+?)\*\*[:：]?$') THEN '<div class="ans-h">' || regexp_extract(esc, '^\*\*(.+?)\*\*[:：]?$', 1) || '</div>' ELSE '<p>' || regexp_replace(esc, '\*\*(.+?)\*\*', '<strong>\1</strong>', 'g') || '</p>' END AS html,
coalesce(lag(item) OVER w, false) AS before, coalesce(lead(item) OVER w, false) AS after FROM k WINDOW w AS (PARTITION BY conv_id, turn ORDER BY pos)),
f AS (SELECT conv_id, turn, string_agg(CASE WHEN item AND NOT before THEN '<ul>' ELSE '' END || html || CASE WHEN item AND NOT after THEN '</ul>' ELSE '' END, '' ORDER BY pos) AS x FROM h GROUP BY ALL)
SELECT conv_id, turn, md5(x) AS html_md5, length(x) AS chars FROM f""",
    "shown_fields": """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '' ELSE 'note,' END || 'type' || CASE WHEN user_id % 2 = 0 THEN ',user' ELSE '' END AS keys, 'demo,batch,' || event_type || CASE WHEN event_id % 2 = 0 THEN ',slow' ELSE '' END AS tags,
CASE event_type WHEN 'view' THEN 'badge high' WHEN 'error' THEN 'badge abstain' WHEN 'click' THEN 'badge low' ELSE 'badge' END AS badge, CASE WHEN event_id % 2 = 0 THEN coalesce(CAST(CAST(floor(value) AS DECIMAL(18, 1)) AS VARCHAR), '-') ELSE '-' END AS shown,
event_id % 5 <> 0 AND event_id % 7 <> 0 AS served FROM events""",
    "answer_rates": f"""WITH r AS (SELECT a.turn, a.conv_id, contains(lower(a.text), 'cannot be confirmed') OR contains(lower(a.text), 'no evidence') OR contains(lower(a.text), 'not found in the documents') OR coalesce(toxic = 1, false) AS refused, coalesce(quality = 0, false) AS irr,
h.text IS NOT NULL AS ev, len(list_filter({_NUMBERS.format("a.text")}, lambda v: NOT list_contains(coalesce({_NUMBERS.format("h.text")}, []), v))) > 0 AS loose {_HEARD} LEFT JOIN labels l ON l.doc_id = a.conv_id WHERE a.role = 'assistant')
SELECT turn, count(*) AS n, round(count(*) FILTER (irr AND refused) / nullif(count(*) FILTER (irr), 0), 6) AS refusal_rate, CASE WHEN turn % 4 = 1 THEN round(count(*) FILTER (conv_id % 3 = 0) / count(*), 6) END AS misread_rate,
count(*) FILTER (loose AND NOT refused) AS hallucinations, round(count(*) FILTER (ev AND conv_id % 3 = 0) / nullif(count(*) FILTER (ev), 0), 6) AS failure_rate, CAST(turn % 3 + 1 AS DOUBLE) AS mean_calls FROM r GROUP BY turn""",
    "token_costs": f"""WITH r AS (SELECT a.turn, len({_TERMS.format("a.text")}) AS o, CASE WHEN h.text IS NULL THEN 0 ELSE len({_TERMS.format("h.text")}) END AS i {_HEARD} WHERE a.role = 'assistant')
SELECT turn, count(*) AS calls, CAST(sum(i) AS BIGINT) AS tokens_in, CAST(sum(o) AS BIGINT) AS tokens_out, round((sum(i) * 0.1::DOUBLE + sum(o) * 0.4::DOUBLE) / 1e6, 9) AS cost FROM r GROUP BY turn""",
    "sentence_citations": rf"""WITH s AS (SELECT a.conv_id, a.turn, list_filter(list_transform(regexp_split_to_array(a.text, '[.!?\n]+'), lambda x: trim(x)), lambda x: x <> '') AS s, list_distinct({_TERMS.format("h.text")}) AS known {_HEARD} WHERE a.role = 'assistant'),
e AS (SELECT conv_id, turn, generate_subscripts(s, 1) - 1 AS ord, unnest(s) AS x, known FROM s), w AS (SELECT conv_id, turn, ord, known, list_distinct({_TERMS.format("x")}) AS w FROM e),
r AS (SELECT conv_id, turn, ord, CASE WHEN len(w) = 0 THEN 0.0::DOUBLE ELSE round(len(list_filter(w, lambda v: list_contains(known, v))) / len(w)::DOUBLE, 6) END AS share FROM w) SELECT *, share >= 0.2 AS cited FROM r""",
    "rerank_topk": f"""WITH {catalog.BM25_SQL}, h AS (SELECT doc_id, list_distinct(w) AS has FROM d), a AS (SELECT query_id, list(term) AS wants FROM q GROUP BY query_id),
s2 AS (SELECT query_id, doc_id, round(len(list_intersect(has, wants)) / len(wants)::DOUBLE, 6) AS score FROM (SELECT query_id, doc_id FROM bm WHERE rank <= 20) JOIN h USING (doc_id) JOIN a USING (query_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s2 WHERE score >= 0.1) SELECT * FROM r WHERE rank <= 5""",
    "retry_once": f"""WITH {catalog._ASKED}, k AS (SELECT {catalog.NORM_SQL} AS key, CAST(min(item_id) AS VARCHAR) AS id FROM benchmark GROUP BY 1), a AS (SELECT number, {catalog.NORM_SQL} AS t FROM asked)
SELECT number, coalesce(x.id, y.id) AS matched_id, CASE WHEN x.id IS NULL THEN 2 ELSE 1 END AS attempt FROM a LEFT JOIN k x ON x.key = t LEFT JOIN k y ON y.key = regexp_replace(t, '^\\S+ ', '')""",
    "incremental_add": "SELECT doc_id, md5(text) AS text_md5 FROM documents",
    "page_store": "SELECT doc_id, length(string_split(text, chr(10))[2]) AS chars FROM documents WHERE len(string_split(text, chr(10))) >= 2",
    "text_dump": r"SELECT lang, count(*) AS lines, CAST(sum(length(regexp_replace(coalesce(text, ''), '[\r\n]+', ' ', 'g'))) AS BIGINT) AS chars FROM documents GROUP BY lang",
    "results_report": f"WITH {catalog._ASKED}, k AS (SELECT {catalog.NORM_SQL} AS key, CAST(min(item_id) AS VARCHAR) AS id FROM benchmark GROUP BY 1) SELECT number, id AS matched_id FROM (SELECT number, {catalog.NORM_SQL} AS key FROM asked) LEFT JOIN k USING (key)",
    "envelope_round_trip": f"""WITH {INGEST_SQL} SELECT sheet || ':' || row AS id, row_number() OVER (ORDER BY CASE sheet WHEN 'user' THEN 0 ELSE 1 END, row) - 1 AS ordinal, md5(answer) AS answer_md5 FROM y WHERE question <> '' AND answer IS NOT NULL""",
}

ORACLE_SQL["turn_state_stream"] = ORACLE_SQL["turn_state"]
ORACLE_SQL["graph_findings"] = f"""WITH RECURSIVE {WAYS_SQL}, walk AS (SELECT 'root' AS node_id, 0 AS depth UNION SELECT b, depth + 1 FROM walk JOIN ways ON a = node_id WHERE depth < 12),
far AS (SELECT node_id, CAST(min(depth) AS BIGINT) AS depth FROM walk GROUP BY node_id), nodes AS (SELECT a AS node_id FROM ways UNION SELECT b FROM ways)
SELECT node_id, depth, node_id NOT IN (SELECT a FROM ways) AND node_id NOT IN (SELECT 'c' || c_custkey FROM customer WHERE c_custkey % 3 <> 0) AS dead_end FROM nodes LEFT JOIN far USING (node_id)"""
ORACLE_SQL["graph_cycles"] = f"""WITH RECURSIVE {WAYS_SQL}, far AS (SELECT a, b FROM ways WHERE a NOT LIKE 's%' UNION SELECT far.a, ways.b FROM far JOIN ways ON far.b = ways.a),
mutual AS (SELECT x.a, x.b FROM far x JOIN far y ON x.a = y.b AND x.b = y.a) SELECT a AS node_id, min(b) AS component FROM mutual GROUP BY a"""
ORACLE_SQL["ingest_run"] = f"""WITH {INGEST_SQL} SELECT sheet, count(*) FILTER (question <> '' AND answer IS NOT NULL) AS entries, count(*) FILTER (question = '' OR answer IS NULL) AS dropped, count(*) FILTER (question <> '' AND answer IS NOT NULL) AS stored
FROM y GROUP BY sheet"""
ORACLE_SQL["workbook_round_trip"] = r"""WITH c AS (SELECT role AS sheet, conv_id * 100 + turn + 2 AS row, [CAST(turn AS VARCHAR), ' ' || CASE WHEN turn % 5 = 4 THEN '  ' ELSE string_split(text, '.')[1] END || '?', CASE WHEN turn % 3 = 2 THEN '' ELSE text END, 'a.pdf; b.pdf' || chr(10) || 'a.pdf'] AS x, conv_id % 7 = 3 AS short FROM conversations),
y AS (SELECT sheet, row, CASE WHEN short THEN x[:2] ELSE x END AS x FROM c) SELECT sheet, row, len(x) AS n_cells, md5(array_to_string(x, '|')) AS cells_md5 FROM y"""
