"""Every registered query of the engine and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rendering
from ..functions import text as T
from ..operators import catalogue, checking, graph, inverted, matching, retrieval, routing, sessions
from ..operators.staging import fresh_path, path_for


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def normalize_text(spark, d):
    return _t(spark, d, "conversations").select("conv_id", "turn", T.normalized(F.col("text")).alias("normalized"))


EDGE_SQL = """' ' || chr(9) || chr(13) || chr(10) || '?!.,~·…"' || chr(39) || '()[]{}'"""
NORM_SQL = f"""lower(trim(trim(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')), {EDGE_SQL})))"""


def faq_dedup_first(spark, d):
    rows = _t(spark, d, "documents").select("doc_id", T.normalized(F.col("text")).alias("key"))
    return catalogue.first_wins(rows, "key", "doc_id").select("doc_id", F.char_length("key").alias("key_chars"))


def faq_dedup_last(spark, d):
    rows = _t(spark, d, "documents").select("doc_id", T.normalized(F.col("text")).alias("key"))
    return catalogue.last_wins(rows, "key", "doc_id").select("doc_id", F.char_length("key").alias("key_chars"))


def faq_duplicates(spark, d):
    rows = _t(spark, d, "documents").select("doc_id", T.normalized(F.col("text")).alias("key"))
    return catalogue.later_duplicates(rows, "key", "doc_id", "doc_id")


def counts_with_zero(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", "source")
    toxic = docs.join(_t(spark, d, "labels").where("toxic = 1 AND quality = 0").select("doc_id"), "doc_id", "left_semi")
    return catalogue.counts_with_zero(docs, toxic, "source")


def split_distinct(spark, d):
    return _t(spark, d, "pages").select("page_id", T.file_names(F.col("url")).alias("parts"))


_SMALL = "abcdefghijklmnopqrstuvwxyz"


def _questions(spark, d):
    """User turns, and each curated text in three guises: as it is, shouted, and with an edit."""
    turns = _t(spark, d, "conversations").where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("number"), F.col("text").alias("question"))
    keys = _t(spark, d, "benchmark")
    guise = lambda k, x: keys.select((-(F.col("item_id") * 3 + k) - 1).alias("number"), x.alias("question"))
    return turns.unionByName(guise(0, F.col("text"))).unionByName(guise(1, F.concat(F.lit("  "), F.translate("text", _SMALL, _SMALL.upper()), F.lit(" ??")))).unionByName(guise(2, F.concat(F.lit("xq "), F.col("text"))))


def _faq(spark, d):
    return _t(spark, d, "benchmark").select(
        F.col("item_id").alias("ordinal"), F.col("item_id").cast("string").alias("id"), T.normalized(F.col("text")).alias("question_normalized"), F.concat(F.lit("Answer "), F.col("item_id").cast("string")).alias("answer")
    )


def exact_lookup(spark, d):
    asked = _questions(spark, d).select("number", T.normalized(F.col("question")).alias("text"))
    keys = catalogue.first_wins(_faq(spark, d), "question_normalized", "ordinal").select("question_normalized", "id")
    return matching.exact(asked, keys, "text", "question_normalized").select("number", F.col("id").alias("matched_id"))


def faq_match(spark, d):
    return matching.match(_questions(spark, d), _faq(spark, d).drop("answer"), keyless=True).withColumns({c: F.round(c, 6) for c in ("best", "second", "margin")})


def route_decide(spark, d):
    """Matched turns sent on, and the final shape of their answers; without a retrieval engine the rest abstain."""
    got = matching.match(_questions(spark, d), _faq(spark, d).drop("answer"), keyless=True).join(catalogue.last_wins(_faq(spark, d), "id", "ordinal").select(F.col("id").alias("matched_id"), "answer"), "matched_id", "left")
    first = routing.first_route(F.lit("text"), F.col("decision"))
    none = F.lit(None).cast("string")
    gate = routing.after_rag(none, none, none, F.lit(False), False, "in_domain_unresolved")
    rows = got.select(
        "number", "decision", F.when(first == "scenario", "scenario").otherwise(gate["route"]).alias("route"),
        F.col("answer").alias("scenario_answer"), none.alias("rag_answer"), none.alias("rag_path"), none.alias("rag_confidence"), none.alias("web_answer"), gate["warnings"].alias("warnings"),
    )
    return routing.final_rows(rows).drop("warnings")


def turn_errors(spark, d):
    """Which turns are no valid input; system turns stand for button presses, some of them without an option."""
    rows = _t(spark, d, "conversations")
    action = F.col("role") == "system"
    error = routing.input_error(F.when(~action, F.col("text")), action, F.when(F.col("turn") == 0, "scenario_option"), F.col("conv_id").cast("string"), F.when(F.col("conv_id") % 3 != 0, F.col("text")))
    return rows.select("conv_id", "turn", routing.input_kind(F.when(action, "action").otherwise("text")).alias("kind"), F.coalesce(error, F.lit("ok")).alias("error"))


def ref_integrity(spark, d):
    """Orders and labels whose parents are missing, and documents without labels."""
    missing = lambda rule, rows, key, parents, parent: rows.join(parents, rows[key] == parents[parent], "left_anti").select(F.lit(rule).alias("rule"), rows[key].cast("long").alias("key"))
    docs, labels = _t(spark, d, "documents"), _t(spark, d, "labels")
    return (
        missing("order_customer", _t(spark, d, "orders"), "o_custkey", _t(spark, d, "customer"), "c_custkey")
        .unionByName(missing("label_document", labels, "doc_id", docs, "doc_id"))
        .unionByName(missing("document_label", docs, "doc_id", labels, "doc_id"))
    )


def _tree(spark, d):
    """Regions, nations and customers as the nodes of a decision graph."""
    region, nation, customer = (_t(spark, d, x) for x in ("region", "nation", "customer"))
    node = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    edge = lambda rows, a, key, label, b: rows.select(a.alias("node_id"), F.col(key).cast("long").alias("ord"), F.concat(F.lit("o"), F.col(key).cast("string")).alias("option_id"), F.col(label).alias("label"), b.alias("next_node_id"))
    return (
        edge(region, F.lit("root"), "r_regionkey", "r_name", node("r", "r_regionkey"))
        .unionByName(edge(nation, node("r", "n_regionkey"), "n_nationkey", "n_name", node("n", "n_nationkey")))
        .unionByName(edge(customer, node("n", "c_nationkey"), "c_custkey", "c_name", node("c", "c_custkey")))
    )


TREE_SQL = """edges AS (
SELECT 'root' AS node_id, CAST(r_regionkey AS BIGINT) AS ord, 'o' || r_regionkey AS option_id, r_name AS label, 'r' || r_regionkey AS next_node_id FROM region
UNION ALL SELECT 'r' || n_regionkey, n_nationkey, 'o' || n_nationkey, n_name, 'n' || n_nationkey FROM nation
UNION ALL SELECT 'n' || c_nationkey, c_custkey, 'o' || c_custkey, c_name, 'c' || c_custkey FROM customer)"""


def edge_resolve(spark, d):
    """Each supplier presses the option with its own number at its nation's node: few of them exist."""
    steps = _t(spark, d, "supplier").select("s_suppkey", F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("node_id"), F.concat(F.lit("o"), F.col("s_suppkey").cast("string")).alias("option_id"))
    return graph.resolve(steps, _tree(spark, d)).select("s_suppkey", "next_node_id", F.coalesce("error", F.lit("ok")).alias("error"))


def option_lists(spark, d):
    return graph.options_of(_tree(spark, d)).select("node_id", F.size("options").cast("long").alias("n"), F.array_join(F.transform("options", lambda o: o["option_id"]), ",").alias("ids"))


def reach_paths(spark, d):
    return graph.paths(_tree(spark, d), "root")


def evidence_enumerate(spark, d):
    """The lines of each document as its evidence: ranked from 1, with the name of its file."""
    lines = _t(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return lines.select("doc_id", (F.col("pos") + 1).alias("rank"), T.evidence_name(F.col("pos") + 1, F.col("doc_id").cast("string"), F.col("line") == "", F.lit("")).alias("name"), F.char_length("line").alias("chars"))


def rag_gate(spark, d):
    """Labels as verdicts on documents as answers: quality is confidence, toxic is abstention."""
    rows = _t(spark, d, "documents").join(_t(spark, d, "labels"), "doc_id", "left")
    confidence = F.when(F.col("quality") == 1, "high").when(F.col("quality") == 0, "low")
    path = F.when(F.col("quality").isNull(), F.when(F.col("lang") == "en", "none")).otherwise("text")
    gate = routing.after_rag(F.col("text"), path, confidence, F.col("toxic") == 1, True, "any_unresolved")
    return rows.select("doc_id", gate["route"].alias("route"), F.size(gate["warnings"]).cast("long").alias("warnings"))


def metadata_filter(spark, d):
    m = F.map_concat(F.from_json("props", "map<string,string>"), F.create_map(F.lit("Token"), F.col("event_type"), F.lit("who"), F.when(F.col("event_type") != "error", F.col("user_id").cast("string"))))
    safe = T.safe_map(m)
    return _t(spark, d, "events").select("event_id", F.array_join(F.array_sort(F.map_keys(safe)), ",").alias("keys"), F.element_at(safe, "k").alias("k"))


def masked_errors(spark, d):
    return _t(spark, d, "pages").select("page_id", T.masked_error(F.lit("LoadError"), F.concat(F.lit("cannot read "), F.col("url"))).alias("message"))


def marked_up(spark, d):
    lines = _t(spark, d, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return lines.select("conv_id", "turn", "pos", rendering.line_html(F.concat(F.lit("- **"), "line", F.lit("**"))).alias("html"))


def html_strip(spark, d):
    """Pages without markup, by patterns alone: the plain stand-in for page parsing."""
    x = F.regexp_replace("html", r"(?is)<(script|style)\b.*?</(script|style)>|<!--.*?-->", " ")
    x = F.regexp_replace(F.regexp_replace(x, r"(?s)<[^>]*>", " "), r"\s+", " ")
    return _t(spark, d, "pages").select("page_id", F.btrim(x).alias("text"))


def chunk_docs(spark, d):
    return retrieval.chunks(_t(spark, d, "documents").select("doc_id", "text")).select("doc_id", "ord", F.char_length("text").alias("chars"), F.md5("text").alias("text_md5"))


def char_bigrams(spark, d):
    g = T.char_bigrams(F.col("text"))
    return _t(spark, d, "documents").select("doc_id", F.size(g).cast("long").alias("bigrams"), F.size(F.array_distinct(g)).cast("long").alias("distinct_bigrams"))


def _index(spark, d):
    """The stored index of the documents, built by the first query that asks for it."""
    path = path_for(spark, "bm25", f"{d}/documents.parquet")
    if not inverted.exists(spark, path):
        inverted.add_documents(_t(spark, d, "documents").select("doc_id", "text"), path)
    return path


def _bm25(spark, d, k):
    queries = _t(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return inverted.search(spark, _index(spark, d), queries, k)


def bm25_topk(spark, d):
    return _bm25(spark, d, 20)


def bm25_after_adds(spark, d):
    """The same by an index to which every third document is added later."""
    path, docs = fresh_path(spark, "bm25"), _t(spark, d, "documents").select("doc_id", "text")
    for part in (docs.where("doc_id % 3 <> 0"), docs):
        inverted.add_documents(part, path)
    queries = _t(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return inverted.search(spark, path, queries, 20)


BM25_SQL = r"""
d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents),
q AS (SELECT DISTINCT item_id AS query_id, unnest(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '')) AS term FROM benchmark),
st AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(len(w)) AS mean FROM d),
tf AS (SELECT doc_id, len, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS len, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
s AS (SELECT query_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * len / mean))), 6) AS score
      FROM tf JOIN df USING (term) JOIN q USING (term), st GROUP BY ALL),
bm AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s)"""


def _asked(spark, d):
    vectors = _t(spark, d, "embeddings")
    return retrieval.dense(vectors, vectors.where("vec_id % 100 = 0"), 10)


def dense_topk(spark, d):
    """Every hundredth vector asked against all others."""
    return _asked(spark, d).select("query_id", "vec_id", F.round("score", 4).alias("score"))


def rrf_fuse(spark, d):
    """BM25 fused with the order in which documents hold a query's distinct terms."""
    search = inverted.Search(spark, _index(spark, d), _t(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text"))
    return retrieval.fuse([search.best(20), search.fullest(20)], 10).select("query_id", "doc_id", "rank")


def small_to_big(spark, d):
    """Chunks scored by the share of letters 'e' they hold, back to each language's three best documents."""
    docs = _t(spark, d, "documents").select("doc_id", "text", "lang")
    pieces = retrieval.chunks(docs.select("doc_id", "text")).join(docs.select("doc_id", F.col("lang").alias("query_id")), "doc_id")
    share = F.round((F.char_length("text") - F.char_length(F.replace("text", F.lit("e"), F.lit("")))) / F.char_length("text"), 6)
    return retrieval.small_to_big(pieces.select("query_id", "doc_id", share.alias("score")), 3)


def doc_gate(spark, d):
    """BM25 hits that belong to the two best documents of their query."""
    found = _bm25(spark, d, 20)
    return retrieval.gated(found, found.where("rank <= 2")).select("query_id", "doc_id", "rank")


def rank_floor(spark, d):
    return retrieval.floor(_bm25(spark, d, 20), 60.0).select("query_id", "refused")


def vision_route(spark, d):
    docs = _t(spark, d, "documents")
    return docs.select("doc_id", retrieval.answer_mode(1000.0 / (F.col("n_chars") + 1), F.col("n_chars") < 50, F.col("source") == "src0").alias("mode"))


def number_check(spark, d):
    """Numbers of an assistant's turn that the turn before does not have."""
    rows = _t(spark, d, "conversations")
    said = rows.where("role = 'assistant'").alias("a")
    heard = rows.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("evidence"))
    joined = said.join(heard, ["conv_id", "turn"], "left")
    return joined.select("conv_id", "turn", F.array_join(F.array_sort(checking.unsupported_numbers(F.col("text"), F.col("evidence"))), ";").alias("unsupported"))


def verification_flags(spark, d):
    """What is to be said of each assistant's turn: abstention, unsupported numbers, or OK."""
    rows = _t(spark, d, "conversations")
    heard = rows.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("evidence"))
    joined = rows.where("role = 'assistant'").join(heard, ["conv_id", "turn"], "left")
    flags = checking.flags(checking.abstains(F.col("text")), checking.unsupported_numbers(F.col("text"), F.col("evidence")), F.col("turn") > 5)
    return joined.select("conv_id", "turn", F.array_join(flags, ",").alias("flags"))


def result_shape(spark, d):
    """The turns of each conversation as the pages of a result: ranked from 1, a score of 0 giving way to the reranker's."""
    page = F.struct("turn", F.col("role").alias("document_name"), F.col("turn").alias("page_number"), F.when(F.col("turn") > 1, F.char_length("text").cast("double")).when(F.col("turn") == 0, 0.0).alias("score"), (F.col("turn") + 0.5).cast("double").alias("rerank_score"))
    packed = _t(spark, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(page)).alias("pages"))
    both = checking.zipped(checking.safe_evidence(F.col("pages")), checking.page_scores(F.col("pages")))
    row = F.transform(both, lambda x: F.concat_ws("|", x["a"]["rank"].cast("string"), x["a"]["document_name"], x["b"]["page_number"].cast("string"), x["b"]["score"].cast("decimal(18,1)").cast("string")))
    return packed.select("conv_id", F.array_join(row, ";").alias("shaped"))


def hit_at_k(spark, d):
    """How often the three nearest vectors have one of the asker's label."""
    labels = _t(spark, d, "embeddings").select("vec_id", "label")
    found = _asked(spark, d).join(labels, "vec_id")
    expected = labels.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "label")
    return checking.hit_at(found, expected, 3, "label")


def keyword_recall(spark, d):
    """The share of each page's url words that its html has."""
    rows = _t(spark, d, "pages").select(F.filter(F.split("url", r"[^A-Za-z]+"), lambda w: F.char_length(w) > 2).alias("words"), "html")
    return checking.keyword_recall(rows, "words", "html")


def latency_summary(spark, d):
    return checking.latency(_t(spark, d, "events"), "event_type", "value")


def model_calls(spark, d):
    """Clicks, views and purchases of each user as counters: their sum, and the stages that ran."""
    count = lambda kind: F.sum(F.when(F.col("event_type") == kind, 1))
    rows = _t(spark, d, "events").groupBy("user_id").agg(count("click").alias("click"), count("view").alias("view"), count("none").alias("none"))
    stages = checking.shown_stages({"answer": "click", "judge": "none", "verify": "view"})
    return rows.select("user_id", checking.calls(["click", "view", "none"]).cast("long").alias("calls"), F.array_join(F.transform(stages, lambda s: s["stage"]), ",").alias("stages"))


def breadcrumbs(spark, d):
    """Where each event leaves its user: an error starts anew."""
    events = _t(spark, d, "events").select("event_id", "user_id", "ts", "event_type")
    return sessions.islands(events, "user_id", ["ts", "event_id"], F.date_trunc("hour", "ts"), F.col("event_type") == "error").select("event_id", "epoch", "depth")


def session_stream(spark, d):
    """The same state at the end of a stream over the event files."""
    from ..streaming.sessions import run_to_end

    base = fresh_path(spark, "sessions")
    return run_to_end(f"{d}/events*.parquet", spark, f"{base}/out", f"{base}/state")


_FUNCTIONS = (
    normalize_text, faq_dedup_first, faq_dedup_last, faq_duplicates, counts_with_zero, split_distinct, exact_lookup, faq_match, route_decide, turn_errors,
    ref_integrity, edge_resolve, option_lists, reach_paths, evidence_enumerate, rag_gate, metadata_filter, masked_errors, marked_up, html_strip, chunk_docs,
    char_bigrams, bm25_topk, bm25_after_adds, dense_topk, rrf_fuse, small_to_big, doc_gate, rank_floor, vision_route, number_check, verification_flags, result_shape, hit_at_k, keyword_recall, latency_summary,
    model_calls, breadcrumbs, session_stream,
)
QUERIES = {f.__name__: f for f in _FUNCTIONS}

_ISLANDS = """isl AS (SELECT event_id, user_id, ts, event_type, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS epoch FROM events),
dep AS (SELECT event_id, user_id, CAST(epoch AS BIGINT) AS epoch, row_number() OVER (PARTITION BY user_id, epoch ORDER BY ts, event_id) - CASE WHEN epoch > 0 THEN 1 ELSE 0 END AS depth, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS back, count(*) OVER (PARTITION BY user_id) AS n_events FROM isl)"""
_ASKED = f"""asked AS (SELECT conv_id * 1000 + turn AS number, text FROM conversations WHERE role = 'user'
UNION ALL SELECT -(item_id * 3) - 1, text FROM benchmark UNION ALL SELECT -(item_id * 3 + 1) - 1, '  ' || translate(text, '{_SMALL}', '{_SMALL.upper()}') || ' ??' FROM benchmark UNION ALL SELECT -(item_id * 3 + 2) - 1, 'xq ' || text FROM benchmark)"""

ORACLE_SQL = {
    "normalize_text": f"SELECT conv_id, turn, {NORM_SQL} AS normalized FROM conversations",
    "faq_dedup_first": f"WITH k AS (SELECT doc_id, {NORM_SQL} AS key FROM documents) SELECT min(doc_id) AS doc_id, length(key) AS key_chars FROM k GROUP BY key",
    "faq_dedup_last": f"WITH k AS (SELECT doc_id, {NORM_SQL} AS key FROM documents) SELECT max(doc_id) AS doc_id, length(key) AS key_chars FROM k GROUP BY key",
    "faq_duplicates": f"WITH k AS (SELECT doc_id, {NORM_SQL} AS key FROM documents), f AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY key) AS first_id FROM k) SELECT doc_id AS id, first_id FROM f WHERE doc_id > first_id",
    "counts_with_zero": "SELECT source, count(l.doc_id) AS n FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1 AND quality = 0) l USING (doc_id) GROUP BY source",
    "split_distinct": "SELECT page_id, (SELECT list(x ORDER BY i) FROM (SELECT trim(x) AS x, min(i) AS i FROM (SELECT unnest(regexp_split_to_array(url, '[\\n;,/]')) AS x, generate_subscripts(regexp_split_to_array(url, '[\\n;,/]'), 1) AS i) GROUP BY trim(x)) WHERE x <> '') AS parts FROM pages",
    "exact_lookup": f"WITH {_ASKED}, k AS (SELECT {NORM_SQL} AS key, CAST(min(item_id) AS VARCHAR) AS id FROM benchmark GROUP BY 1) SELECT number, id AS matched_id FROM (SELECT number, {NORM_SQL} AS key FROM asked) LEFT JOIN k USING (key)",
    "turn_errors": """WITH t AS (SELECT *, role = 'system' AS a FROM conversations)
SELECT conv_id, turn, CASE WHEN a THEN 'action' ELSE 'text' END AS kind,
CASE WHEN a THEN CASE WHEN turn = 0 AND conv_id % 3 <> 0 AND text <> '' THEN 'ok' ELSE 'invalid_action' END WHEN trim(regexp_replace(text, '\\s+', ' ', 'g')) <> '' THEN 'ok' ELSE 'empty_input' END AS error FROM t""",
    "ref_integrity": """SELECT 'order_customer' AS rule, o_custkey AS key FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey)
UNION ALL SELECT 'label_document', doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents) UNION ALL SELECT 'document_label', doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""",
    "edge_resolve": f"WITH {TREE_SQL} SELECT s_suppkey, next_node_id, CASE WHEN next_node_id IS NULL THEN 'invalid_action' ELSE 'ok' END AS error FROM supplier LEFT JOIN edges ON node_id = 'n' || s_nationkey AND option_id = 'o' || s_suppkey",
    "option_lists": f"WITH {TREE_SQL} SELECT node_id, count(*) AS n, string_agg(option_id, ',' ORDER BY ord) AS ids FROM edges GROUP BY node_id",
    "reach_paths": f"WITH RECURSIVE {TREE_SQL}, walk AS (SELECT 'root' AS node_id, 0 AS depth, 'root' AS path UNION ALL SELECT next_node_id, depth + 1, path || '>' || next_node_id FROM walk JOIN edges USING (node_id)) SELECT * FROM walk",
    "evidence_enumerate": """WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents), e AS (SELECT doc_id, unnest(x) AS line, generate_subscripts(x, 1) AS rank FROM l)
SELECT doc_id, rank, printf('ev%d_p%04d', rank, doc_id) || CASE WHEN line = '' THEN '_table' ELSE '' END || '.png' AS name, length(line) AS chars FROM e""",
    "rag_gate": """WITH r AS (SELECT doc_id, text, quality, toxic, CASE WHEN quality IS NULL THEN CASE WHEN lang = 'en' THEN 'none' END ELSE 'text' END AS path FROM documents LEFT JOIN labels USING (doc_id)),
h AS (SELECT *, trim(regexp_replace(text, '\\s+', ' ', 'g')) <> '' AND path IS NOT NULL AND path <> 'none' AS has FROM r)
SELECT doc_id, CASE WHEN has THEN 'rag' ELSE 'web_search' END AS route, CASE WHEN has AND (quality = 0 OR toxic = 1) THEN 1 ELSE 0 END AS warnings FROM h""",
    "metadata_filter": "SELECT event_id, CASE WHEN event_type = 'error' THEN 'k' ELSE 'k,who' END AS keys, json_extract_string(props, '$.k') AS k FROM events",
    "masked_errors": """SELECT page_id, substr('LoadError: ' || regexp_replace(regexp_replace(regexp_replace('cannot read ' || url, '[A-Za-z]:\\\\[^\\s''"]+', '<path>', 'g'), '/[^\\s''"]+/[^\\s''"]+', '<path>', 'g'), '[A-Za-z0-9_-]{20,}', '<redacted>', 'g'), 1, 300) AS message FROM pages""",
    "marked_up": """WITH l AS (SELECT conv_id, turn, string_split(text, chr(10)) AS x FROM conversations), e AS (SELECT conv_id, turn, unnest(x) AS line, generate_subscripts(x, 1) - 1 AS pos FROM l),
h AS (SELECT *, replace(replace(replace(line, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS y FROM e)
SELECT conv_id, turn, pos, '<li>' || regexp_replace('**' || y || '**', '\\*\\*(.+?)\\*\\*', '<strong>\\1</strong>', 'g') || '</li>' AS html FROM h""",
    "html_strip": """SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)\\b.*?</(script|style)>|<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')) AS text FROM pages""",
    "chunk_docs": "WITH c AS (SELECT doc_id, unnest(generate_series(0, CAST(ceil(length(text) / 700.0) AS BIGINT) - 1)) AS ord, text FROM documents) SELECT doc_id, ord, length(substr(text, ord * 700 + 1, 700)) AS chars, md5(substr(text, ord * 700 + 1, 700)) AS text_md5 FROM c",
    "char_bigrams": "WITH g AS (SELECT doc_id, unnest(generate_series(1, length(text) - 1)) AS i, text FROM documents), b AS (SELECT doc_id, count(*) AS bigrams, count(DISTINCT substr(text, i, 2)) AS distinct_bigrams FROM g GROUP BY doc_id) SELECT d.doc_id, coalesce(bigrams, 0) AS bigrams, coalesce(distinct_bigrams, 0) AS distinct_bigrams FROM documents d LEFT JOIN b USING (doc_id)",
    "bm25_after_adds": f"WITH {BM25_SQL} SELECT query_id, doc_id, score, rank FROM bm WHERE rank <= 20",
    "bm25_topk": f"WITH {BM25_SQL} SELECT query_id, doc_id, score, rank FROM bm WHERE rank <= 20",
    "dense_topk": """WITH p AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_sum(list_transform(list_zip(q.embedding, v.embedding), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE))), 6) AS score FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0 AND q.vec_id <> v.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k FROM p) SELECT query_id, vec_id, round(score, 4) AS score FROM r WHERE k <= 10""",
    "rrf_fuse": f"""WITH {BM25_SQL}, m AS (SELECT query_id, doc_id, count(*) AS score FROM (SELECT DISTINCT doc_id, term FROM tf) JOIN q USING (term) GROUP BY ALL),
mr AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM m),
f AS (SELECT query_id, doc_id, round(sum(1.0 / (60 + rank)), 9) AS score FROM (SELECT query_id, doc_id, rank FROM bm WHERE rank <= 20 UNION ALL SELECT * FROM mr WHERE rank <= 20) GROUP BY ALL),
r AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM f) SELECT * FROM r WHERE rank <= 10""",
    "small_to_big": """WITH c AS (SELECT doc_id, lang, unnest(generate_series(0, CAST(ceil(length(text) / 700.0) AS BIGINT) - 1)) AS ord, text FROM documents), p AS (SELECT doc_id, lang, substr(text, ord * 700 + 1, 700) AS x FROM c),
s AS (SELECT lang AS query_id, doc_id, max(round((length(x) - length(replace(x, 'e', ''))) / length(x), 6)) AS score FROM p GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s) SELECT * FROM r WHERE rank <= 3""",
    "doc_gate": f"WITH {BM25_SQL} SELECT query_id, doc_id, rank FROM bm WHERE rank <= 2",
    "rank_floor": f"WITH {BM25_SQL} SELECT query_id, max(score) < 60.0 AS refused FROM bm GROUP BY query_id",
    "vision_route": "SELECT doc_id, CASE WHEN 1000.0 / (n_chars + 1) >= 0.5 OR (n_chars < 50 AND source = 'src0') THEN 'vision' ELSE 'text' END AS mode FROM documents",
    "number_check": r"""WITH n AS (SELECT conv_id, turn, role, list_transform(regexp_extract_all(text, '\d+(?:[.,]\d+)*'), lambda x: replace(x, ',', '')) AS x FROM conversations)
SELECT a.conv_id, a.turn, coalesce(array_to_string(list_sort(list_distinct(list_filter(a.x, lambda v: NOT list_contains(coalesce(h.x, []), v)))), ';'), '') AS unsupported FROM n a LEFT JOIN n h ON h.conv_id = a.conv_id AND h.turn + 1 = a.turn WHERE a.role = 'assistant'""",
    "verification_flags": r"""WITH n AS (SELECT conv_id, turn, role, text, list_transform(regexp_extract_all(text, '\d+(?:[.,]\d+)*'), lambda x: replace(x, ',', '')) AS x FROM conversations),
f AS (SELECT a.conv_id, a.turn, concat_ws(',', CASE WHEN contains(lower(a.text), 'cannot be confirmed') OR contains(lower(a.text), 'no evidence') OR contains(lower(a.text), 'not found in the documents') THEN 'abstain' END,
CASE WHEN len(list_filter(a.x, lambda v: NOT list_contains(coalesce(h.x, []), v))) > 0 THEN 'unsupported_claims' END, CASE WHEN a.turn > 5 THEN 'ocr_mismatch' END) AS flags
FROM n a LEFT JOIN n h ON h.conv_id = a.conv_id AND h.turn + 1 = a.turn WHERE a.role = 'assistant') SELECT conv_id, turn, CASE WHEN flags = '' THEN 'OK' ELSE flags END AS flags FROM f""",
    "result_shape": """WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations)
SELECT conv_id, string_agg(k || '|' || role || '|' || turn || '|' || CAST(CAST(CASE WHEN turn > 1 AND length(text) > 0 THEN length(text) ELSE turn + 0.5 END AS DECIMAL(18,1)) AS VARCHAR), ';' ORDER BY turn) AS shaped FROM r GROUP BY conv_id""",
    "hit_at_k": """WITH p AS (SELECT q.vec_id AS query_id, q.label AS want, v.vec_id, v.label, round(list_sum(list_transform(list_zip(q.embedding, v.embedding), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE))), 6) AS score FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0 AND q.vec_id <> v.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k FROM p), h AS (SELECT query_id, max(CASE WHEN k <= 3 AND label = want THEN 1 ELSE 0 END) AS hit FROM r GROUP BY query_id)
SELECT count(*) AS queries, CAST(sum(hit) AS BIGINT) AS hits, round(avg(hit), 6) AS hit_rate FROM h""",
    "keyword_recall": """WITH w AS (SELECT list_filter(regexp_split_to_array(url, '[^A-Za-z]+'), lambda x: length(x) > 2) AS w, lower(html) AS h FROM pages)
SELECT count(*) AS n, round(avg(len(list_filter(w, lambda x: contains(h, lower(x)))) / len(w)), 6) AS recall FROM w WHERE len(w) > 0""",
    "latency_summary": "SELECT event_type, count(*) AS n, round(avg(value), 4) AS mean_s, max(value) AS max_s, round(count(*) FILTER (WHERE value < 20.0) / count(*), 6) AS quick_share, round(sum(value), 2) AS total_s FROM events GROUP BY event_type",
    "model_calls": """WITH c AS (SELECT user_id, count(*) FILTER (WHERE event_type = 'click') AS a, count(*) FILTER (WHERE event_type = 'view') AS v FROM events GROUP BY user_id)
SELECT user_id, a + v AS calls, concat_ws(',', CASE WHEN a > 0 THEN 'answer' END, CASE WHEN v > 0 THEN 'verify' END) AS stages FROM c""",
    "breadcrumbs": f"WITH {_ISLANDS} SELECT event_id, epoch, depth FROM dep",
    "session_stream": f"WITH {_ISLANDS} SELECT user_id, epoch, depth, n_events FROM dep WHERE back = 1",
}

from . import dialogue  # noqa: E402  (its queries use the helpers above)

QUERIES |= dialogue.QUERIES
ORACLE_SQL |= dialogue.ORACLE_SQL

from . import answers  # noqa: E402

QUERIES |= answers.QUERIES
ORACLE_SQL |= answers.ORACLE_SQL
