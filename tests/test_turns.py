"""Turns, answers, rendering, measures and corpus stores on small tables."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lodestone.functions import rendering
from lodestone.operators import checking, graph, retrieval, routing, turns
from lodestone.sources import corpus

EDGES = [
    ("root", 1, "a", "Apples", "m"), ("root", 2, "b", "Pears", "end"), ("m", 1, "x", "", "end"), ("m", 2, graph.RESTART, "Again", "m"), ("end", 1, "home", "Home", "root"), ("end", 2, "b", "Dead", "nowhere"),
]


def edges_of(spark):
    return spark.createDataFrame(EDGES, "node_id string, ord long, option_id string, label string, next_node_id string")


def walk(rows):
    """State after each turn, one turn at a time."""
    steps = {(a, o): b for a, _, o, _, b in EDGES}
    state, out = {}, {}
    for key, who, kind, node, option, label in rows:
        position, completed, labels = state.get(who, (None, False, []))
        error = None
        if kind == "text":
            position, completed, labels = None, False, []
        elif (node, option) not in steps:
            error = "invalid_action"
        else:
            position = steps[node, option]
            if option == graph.RESTART or position == "root":
                completed, labels = False, []
            else:
                completed, labels = position == "end", labels + [label] if label else labels
        state[who] = position, completed, labels
        out[key] = (error, position, completed, labels)
    return out


def test_turn_states(spark):
    rng = random.Random(3)
    rows = []
    for i in range(400):
        node = rng.choice(["root", "m", "end", "none"])
        option = rng.choice(["a", "b", "x", "home", graph.RESTART])
        rows.append((i, rng.choice([1, 1, 1, 2, None]), rng.choice(["text", "action", "action", "action"]), node, option, rng.choice(["One", "Two", "", None])))
    rows = [r for r in rows if r[1] is not None]
    frame = spark.createDataFrame(rows, "turn long, who long, kind string, node_id string, option_id string, label string")
    ends = spark.createDataFrame([("end",), ("end",)], "node_id string")
    for bucket in (F.lit(0), F.expr("turn div 7")):
        got = turns.turn_states(frame, edges_of(spark), ends, "root", "who", ["turn"], bucket).collect()
        assert {r["turn"]: (r["error"], r["position"], r["completed"], r["labels"]) for r in got} == walk(rows)
    assert turns.turn_states(frame.limit(0), edges_of(spark), ends, "root", "who", ["turn"], F.lit(0)).count() == 0


def test_answers_of_nodes_and_entries(spark):
    nodes = spark.createDataFrame(
        [("root", "menu", "Pick", None, None, None, None), ("end", "terminal", "t", "Done", "faq_ref", "s", 4)], "node_id string, type string, text string, answer_text string, answer_source string, ref_sheet string, ref_row long"
    )
    steps = spark.createDataFrame([(1, "root"), (2, "end"), (3, "lost")], "number long, node_id string")
    got = {r["number"]: r for r in turns.graph_answers(steps, nodes, edges_of(spark)).collect()}
    assert set(got) == {1, 2}
    assert (got[1]["answer"], got[1]["completed"], [o["option_id"] for o in got[1]["options"]]) == ("Pick", False, ["a", "b"])
    assert (got[2]["answer"], got[2]["completed"], got[2]["meta"]["answer_source"], got[2]["meta"]["ref_row"]) == ("Done", True, "faq_ref", 4)
    faq = spark.createDataFrame([("i", 1, "old", "s", 1), ("i", 2, "new", "s", 2)], "id string, ordinal long, answer string, sheet string, row long")
    matches = spark.createDataFrame([(1, "i", 0.95), (2, None, 0.1), (3, "gone", 0.9)], "number long, matched_id string, best double")
    got = {r["number"]: (r["answer"], r["answer_path"], r["answer_source"], r["confidence"], r["meta"] and r["meta"]["score"]) for r in turns.curated_answers(matches, faq).collect()}
    assert got == {1: ("new", "scenario", "faq_match", "n/a", 0.95), 2: (None, "none", "none", "unknown", None), 3: (None, "none", "none", "unknown", None)}


def test_defaults_trace_and_reasons(spark):
    row = turns.with_turn_defaults(spark.createDataFrame([(1, "kept", "old")], "number long, position string, answer string"))
    row = row.withColumn("trace", turns.traced(F.col("trace"), "normalize_input", F.lit("text"))).first()
    assert (row["position"], row["answer"], row["options"], row["warnings"]) == ("kept", None, [], [])
    assert [tuple(x) for x in row["trace"]] == [("normalize_input", "text")]
    rows = spark.createDataFrame([("exact", 1.0, 1.0), ("accept", 0.95, 0.2), ("reject_low_score", 0.5, 0.1), ("reject_ambiguous", 0.95, 0.01), (None, 0.0, 0.0)], "d string, b double, m double")
    got = [tuple(r) for r in rows.select(turns.match_reason(F.col("d"), F.col("b"), F.col("m"), 0.9, 0.05), turns.route_reason(F.lit("text"), F.col("d"))).collect()]
    assert [x[0] for x in got] == ["equal once normalised", "best 0.950 >= 0.900, lead 0.200 >= 0.050", "best 0.500 < 0.900", "lead 0.010 < 0.050", None]
    assert [x[1] for x in got][1::3] == ["curated question matched: accept", "no curated question matched: none"]
    errors = spark.createDataFrame([(None,), ("rag_busy",), ("invalid_action",), ("boom",)], "e string").select(turns.status_of(F.col("e")).alias("s"))
    assert [r["s"] for r in errors.collect()] == [200, 429, 400, 500]


def test_responses_by_route(spark):
    kinds = """number long, route string, warnings array<string>, seconds double, position string, completed boolean,
    scenario struct<answer:string,options:array<struct<option_id:string,label:string>>,answer_path:string,answer_source:string,confidence:string,meta:struct<type:string>>,
    rag struct<answer:string,answer_path:string,confidence:string,evidence:array<struct<rank:int,image_url:string>>,abstain:boolean,run_id:string>, web struct<answer:string,provider:string>"""
    rows = [
        (1, "scenario", None, 1.23456, "end", True, ("S", [("a", "A")], "scenario", "faq_match", "n/a", ("faq",)), None, None),
        (2, "rag", ["w"], None, None, None, None, ("R", None, None, [(1, None), (2, "/u")], None, "r1"), None),
        (3, "web_search", None, 0.0, None, None, None, None, (None, "off")),
        (4, "abstain", None, 0.0, None, None, None, None, None),
    ]
    got = {r["number"]: r for r in turns.responses(spark.createDataFrame(rows, kinds)).collect()}
    assert (got[1]["answer"], got[1]["answer_source"], len(got[1]["options"]), got[1]["elapsed_seconds"], tuple(got[1]["scenario"])) == ("S", "faq_match", 1, 1.235, ("end", True))
    assert (got[2]["answer_path"], got[2]["confidence"], [e["rank"] for e in got[2]["evidence"]], got[2]["abstained"], got[2]["warnings"], got[2]["elapsed_seconds"]) == ("none", "unknown", [2], False, ["w"], 0.0)
    assert (got[3]["answer"], got[3]["answer_path"], got[3]["meta_id"]) == ("", "web", "off")
    assert (got[4]["answer"], got[4]["confidence"], got[4]["answer_path"], got[4]["evidence"]) == (routing.ABSTAIN, "abstain", "none", [])


@pytest.mark.parametrize(
    ("text", "html"),
    [
        (None, ""), ("", ""), ("a < b", "<p>a &lt; b</p>"), ("**Head**:", '<div class="ans-h">Head</div>'), (" **Head** ", '<div class="ans-h">Head</div>'), ("**a** b", "<p><strong>a</strong> b</p>"),
        ("- x\n* **y**\n\n- z\nw", "<ul><li>x</li><li><strong>y</strong></li></ul><ul><li>z</li></ul><p>w</p>"), ("-x", "<p>-x</p>"), ("# no", "<p># no</p>"),
    ],
)
def test_answer_html(spark, text, html):
    assert spark.createDataFrame([(text,)], "t string").select(rendering.answer_html(F.col("t")).alias("h")).first()["h"] == html


def test_shown_values(spark):
    row = spark.range(1).select(
        rendering.fixed(F.lit(None).cast("double"), 2).alias("none"), rendering.fixed(F.lit(1.5), 2).alias("some"), rendering.badge(F.lit(None).cast("string")).alias("b"),
        rendering.tags(["a"], F.lit(None).cast("array<string>"), F.lit("c"), F.lit(None).cast("boolean")).alias("t"), *[rendering.is_file_name(F.lit(x)).alias(f"f{k}") for k, x in enumerate(["ev1.png", "../x", "a/b", "", "a..b", "x" * 129])],
    ).first()
    assert tuple(row) == ("-", "1.50", "badge", ["a"], True, False, False, False, False, False)


def test_measures(spark):
    kinds = "g string, refused boolean, irrelevant boolean, by_sight boolean, wrong boolean, unsupported boolean, has_evidence boolean, calls long"
    rows = [("a", True, True, False, False, True, False, 2), ("a", False, True, True, True, True, True, 3), ("a", None, None, None, None, None, None, None), ("b", False, False, False, True, False, False, 1)]
    got = {r["g"]: tuple(r)[1:] for r in checking.answer_rates(spark.createDataFrame(rows, kinds), "g").collect()}
    assert got == {"a": (3, 0.5, 1.0, 1, 1.0, 2.5), "b": (1, None, None, 0, None, 1.0)}
    calls = spark.createDataFrame([("a", 1_000_000, None), ("a", None, 500_000)], "g string, tokens_in long, tokens_out long")
    assert tuple(checking.token_costs(calls, "g", 0.1, 0.4).first()) == ("a", 2, 1_000_000, 500_000, 0.3)
    rows = spark.createDataFrame([(1, "The cat sat. Dogs bark! --", "a cat SAT down"), (2, None, "x"), (3, "y", None)], "id long, answer string, evidence string")
    got = [(r["id"], r["ord"], r["share"], r["cited"]) for r in checking.citations(rows, 0.5).orderBy("id", "ord").collect()]
    assert got == [(1, 0, 0.666667, True), (1, 1, 0.0, False), (1, 2, 0.0, False), (3, 0, 0.0, False)]


def test_rerank_and_retries(spark):
    found = spark.createDataFrame([(1, 5, 0.9), (1, 4, 0.9), (1, 3, 0.2), (2, 9, 0.05)], "query_id long, doc_id long, other double")
    got = [tuple(r) for r in retrieval.reranked(found, F.col("other"), 2, 0.1).select("query_id", "doc_id", "rank").collect()]
    assert sorted(got) == [(1, 4, 1), (1, 5, 2)]
    asked = spark.createDataFrame([(i,) for i in range(6)], "n long")
    seen = []

    def attempt(below):
        def run(rows):
            seen.append(sorted(r["n"] for r in rows.collect()))
            return rows.withColumn("found", F.when(F.col("n") < below, F.col("n")))

        return run

    got = {r["n"]: (r["found"], r["attempt"]) for r in retrieval.with_retries(asked, [attempt(2), attempt(4)], F.col("found").isNotNull()).collect()}
    assert got == {0: (0, 1), 1: (1, 1), 2: (2, 2), 3: (3, 2), 4: (None, 2), 5: (None, 2)}
    assert seen == [[0, 1, 2, 3, 4, 5], [2, 3, 4, 5]]


def test_corpus_stores(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a\nb", "en"), (2, None, "de"), (3, "c", "en")], "doc_id long, text string, lang string")
    docs.where("doc_id < 3").write.parquet(f"{tmp_path}/c")
    for _ in range(2):
        corpus.add_documents(docs, f"{tmp_path}/c")
    assert sorted(r["doc_id"] for r in spark.read.parquet(f"{tmp_path}/c").collect()) == [1, 2, 3]
    corpus.dump_texts(docs, f"{tmp_path}/t")
    assert sorted((r["lang"], r["value"]) for r in spark.read.text(f"{tmp_path}/t").collect()) == [("de", ""), ("en", "a b"), ("en", "c")]
    pages = spark.createDataFrame([(1, 1, "x"), (1, 2, "y"), (2, 1, "z")], "doc_id long, page_no int, text string")
    corpus.write_pages(pages, f"{tmp_path}/p")
    assert [r["text"] for r in corpus.read_pages(spark, f"{tmp_path}/p", pages.where("text = 'y'")).collect()] == ["y"]
    assert corpus.read_pages(spark, f"{tmp_path}/p").count() == 3
    corpus.write_report(docs, f"{tmp_path}/r")
    lines = [r["value"] for r in spark.read.text(f"{tmp_path}/r").collect()]
    assert any(re.search(r'"text":null', x) for x in lines)
