"""Operators on small tables: the decisions, routes and checks that the surveyed tests fix."""

import zipfile

import pytest
from pyspark.sql import functions as F

from lodestone.functions.similarity import ratio
from lodestone.operators import catalogue, checking, graph, matching, retrieval, routing, sessions
from lodestone.sources import faq

KEYS = ["도서관은 몇 시에 여나요?", "프린터 종이가 자꾸 걸려요", "강의실 창문이 닫히지 않아요"]


def table(spark, keys):
    from lodestone.functions.text import normalized

    rows = spark.createDataFrame([(i, f"s:{i + 2}", k) for i, k in enumerate(keys)], "ordinal long, id string, q string")
    return rows.select("ordinal", "id", normalized(F.col("q")).alias("question_normalized"))


def asked(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "number long, question string")


def matched(spark, keys, texts, **limits):
    return {r["number"]: r for r in matching.match(asked(spark, *texts), table(spark, keys), **limits).collect()}


def test_exact_and_low(spark):
    got = matched(spark, KEYS, [KEYS[0], "  도서관은   몇 시에  여나요??  ", "내일 비가 올지 궁금합니다", "???"])
    assert [got[i]["decision"] for i in range(4)] == ["exact", "exact", "reject_low_score", "reject_low_score"]
    assert (got[0]["best"], got[0]["second"], got[0]["margin"], got[0]["matched_id"]) == (1.0, 0.0, 1.0, "s:2")
    assert (round(got[2]["best"], 4), round(got[2]["second"], 4)) == (0.2857, 0.2759)
    assert got[2]["matched_id"] is not None
    assert (got[3]["best"], got[3]["matched_id"]) == (0.0, None)


def test_accept_and_ambiguous(spark):
    got = matched(spark, KEYS, ["도서관은 몇 시에 닫나요"], threshold=0.70, margin=0.05)[0]
    assert (got["decision"], got["matched_id"], round(got["best"], 4)) == ("accept", "s:2", 0.9231)
    got = matched(spark, ["문이 잠겨 있어요", "문이 잠겨 있나요"], ["문이 잠겨 있습니다"], threshold=0.5, margin=0.3)[0]
    assert (got["decision"], round(got["best"], 4)) == ("reject_ambiguous", 0.7368)


def test_one_key_repeated_keys_and_none(spark):
    got = matched(spark, ["abcd"], ["abce"])[0]
    assert (got["second"], got["margin"]) == (0.0, got["best"])
    got = matched(spark, ["abcdefghij", "abcdefghij"], ["abcdefghix"], threshold=0.9, margin=0.05)[0]
    assert (got["decision"], got["matched_id"]) == ("accept", "s:2")  # equal keys are one
    assert matching.match(asked(spark, "x"), table(spark, KEYS).limit(0)).count() == 0


def test_without_keys_questions_are_rejected(spark):
    got = matching.match(asked(spark, "x", "", "y"), table(spark, KEYS).limit(0), keyless=True).collect()
    assert {(r["number"], r["decision"], r["best"], r["second"], r["margin"], r["matched_id"]) for r in got} == {(i, "reject_low_score", 0.0, 0.0, 0.0, None) for i in range(3)}
    with_keys = [matching.match(asked(spark, "abcd", "", "zz"), table(spark, ["abce", "q"]), keyless=k).collect() for k in (False, True)]
    assert sorted(with_keys[0]) == sorted(with_keys[1]) and len(with_keys[0]) == 3


def test_limits_pass_when_equal(spark):
    got = spark.createDataFrame([(0.9, 0.85), (0.95, 0.90), (0.9, 0.5), (0.89, 0.0)], "b double, s double").select(matching.decision(F.col("b"), F.col("s"))).collect()
    assert [r[0] for r in got] == ["accept" if 0.9 - 0.85 >= 0.05 else "reject_ambiguous", "reject_ambiguous", "accept", "reject_low_score"]


def test_nearest_two_is_brute_force(spark):
    words = ["abc abd", "abcd", "xyz", "abd abc", "zzzz abc", "abc", "abca", "q"]
    texts = ["abc ab", "zz", "xyq abcd", "q"]
    keys = spark.createDataFrame(list(enumerate(words)), "ordinal long, text string")
    questions = spark.createDataFrame(list(enumerate(texts)), "number long, text string")
    for block in (3, 100):
        got = {r["number"]: (r["best"], r["second"], r["ordinal"]) for r in matching.nearest_two(questions, keys, block=block).collect()}
        for n, t in enumerate(texts):
            best = sorted(((-ratio(t, k), i) for i, k in enumerate(words)))[:2]
            assert got[n] == (-best[0][0], -best[1][0], best[0][1])


@pytest.mark.parametrize(
    ("confidence", "path", "answer", "web", "route", "warned"),
    [("high", "text", "ok", False, "rag", False), ("low", "vision", "a", False, "rag", True), ("abstain", "none", "", False, "abstain", True), ("unknown", "none", "", True, "web_search", False), ("high", None, "a", False, "abstain", True)],
)
def test_rag_gate(spark, confidence, path, answer, web, route, warned):
    row = spark.createDataFrame([(answer, path, confidence, False)], "a string, p string, c string, x boolean")
    got = row.select(routing.after_rag(F.col("a"), F.col("p"), F.col("c"), F.col("x"), web, "any_unresolved")).first()[0]
    assert (got["route"], bool(got["warnings"])) == (route, warned)


def test_first_route_and_errors(spark):
    rows = spark.createDataFrame([("action", None), ("text", "exact"), ("text", "accept"), ("text", "reject_low_score"), ("text", None)], "k string, d string")
    assert [r[0] for r in rows.select(routing.first_route(F.col("k"), F.col("d"))).collect()] == ["scenario"] * 3 + ["rag"] * 2
    rows = spark.createDataFrame([("hi", False, None), (" ", False, None), (None, False, None), ("hi", True, "scenario_option"), (None, True, "scenario_option"), (None, True, "x")], "m string, a boolean, t string")
    got = rows.select(routing.input_error(F.col("m"), F.col("a"), F.col("t"), F.lit("n"), F.lit("o"))).collect()
    assert [r[0] for r in got] == [None, "empty_input", "invalid_request", "invalid_request", None, "invalid_action"]


def nodes_edges(spark):
    nodes = spark.createDataFrame(
        [("root", "root", "menu", None, None, None, None), ("a", "a", "question", None, None, None, None), ("t", "t", "terminal", "done", "scenario_ppt", None, None), ("u", "v", "terminal", None, "faq_ref", "s", 9), ("w", "w", "terminal", None, "other", None, None)],
        "key string, node_id string, type string, answer_text string, answer_source string, ref_sheet string, ref_row int",
    )
    edges = spark.createDataFrame([("root", 0, "o", "A", "a"), ("a", 0, "p", "T", "t"), ("a", 1, "p", "again", "t"), ("a", 2, graph.RESTART, "R", "root"), ("a", 3, "q", "gone", "nowhere")], "node_id string, ord int, option_id string, label string, next_node_id string")
    return nodes, edges


def test_graph(spark):
    nodes, edges = nodes_edges(spark)
    table_ = spark.createDataFrame([("s", 2)], "sheet string, row int")
    found = {(r["rule"], r["node_id"]) for r in graph.violations(nodes, edges, spark.createDataFrame([("gone",)], "node_id string"), table_).collect()}
    assert found == {("root_missing", "gone"), ("key_mismatch", "u"), ("duplicate_option", "a"), ("unknown_source", "w"), ("dangling_ref", "v"), ("dangling_edge", "a")}
    steps = spark.createDataFrame([("root", "o"), ("root", "x"), ("a", graph.RESTART)], "node_id string, option_id string")
    got = {(r["node_id"], r["option_id"]): (r["next_node_id"], r["error"]) for r in graph.resolve(steps, edges).collect()}
    assert got == {("root", "o"): ("a", None), ("root", "x"): (None, "invalid_action"), ("a", graph.RESTART): ("root", None)}
    assert ("t", 2, "root>a>t") in {tuple(r) for r in graph.paths(edges, "root").collect()}


def workbook(path, sheets):
    """A small xlsx file: sheets of rows of texts, as inline strings and one as a shared one."""
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f"<workbook {ns}><sheets>" + "".join(f'<sheet name="{n}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(sheets)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="r{i}" Target="worksheets/s{i}.xml"/>' for i in range(len(sheets))) + "</Relationships>")
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>질문</t></si></sst>")
        for i, rows in enumerate(sheets.values()):
            body = ""
            for k, row in enumerate(rows, 1):
                cells = "".join(
                    f'<c r="{chr(65 + j)}{k}" t="s"><v>0</v></c>' if v == "질문" else f'<c r="{chr(65 + j)}{k}"><v>{v}</v></c>' if isinstance(v, (int, float)) else f'<c r="{chr(65 + j)}{k}" t="inlineStr"><is><t xml:space="preserve">{v}</t></is></c>'
                    for j, v in enumerate(row) if v is not None
                )
                body += f'<row r="{k}">{cells}</row>'
            z.writestr(f"xl/worksheets/s{i}.xml", f"<worksheet {ns}><sheetData>{body}</sheetData></worksheet>")


def test_workbook_to_envelope(spark, tmp_path):
    head = ["No", "질문 유형", "장애 유형", "질문", "답변", "질문 답변 생성 근거 파일명"]
    workbook(tmp_path / "w.xlsx", {"스쿨넷": [[*head, "junk"], [1, "t", "f", "q1", "a1", "a.pdf", "x"], [2.7, None, None, " ", "a", None], ["x", None, "f", "q2?", "a2", "b.pdf, c.pdf"]], "학내망": [["No", "질문유형", "장애 유형", "질문", "답변"]]})
    rows = faq.read_workbooks(spark, str(tmp_path / "w.xlsx"))
    entries, dropped = catalogue.entries_of(rows, ["스쿨넷", "학내망"])
    got = {r["id"]: r for r in entries.collect()}
    assert set(got) == {"스쿨넷:2", "스쿨넷:4"}
    assert (got["스쿨넷:2"]["no"], got["스쿨넷:4"]["no"], got["스쿨넷:4"]["question_type"]) == (1, None, None)
    assert (got["스쿨넷:4"]["question_normalized"], got["스쿨넷:4"]["source_files"]) == ("q2", ["b.pdf", "c.pdf"])
    assert [tuple(r) for r in dropped.collect()] == [("스쿨넷", 3)]
    sheets = spark.createDataFrame([("스쿨넷",), ("학내망",)], "sheet string")
    counts = catalogue.counts_with_zero(sheets, entries, "sheet")
    assert {tuple(r) for r in counts.collect()} == {("스쿨넷", 2), ("학내망", 0)}
    faq.write_envelope(faq.envelope(entries, counts, "w.xlsx"), str(tmp_path / "out"))
    back = faq.read_entries(spark, str(tmp_path / "out")).collect()
    assert [(r["ordinal"], r["id"]) for r in back] == [(0, "스쿨넷:2"), (1, "스쿨넷:4")]
    with pytest.raises(ValueError, match="no sheet"):
        catalogue.entries_of(rows, ["스쿨넷", "없음"])


def test_wins_and_duplicates(spark):
    rows = spark.createDataFrame([(3, "a"), (1, "a"), (2, "b"), (5, "a")], "id long, k string")
    assert {r["id"] for r in catalogue.first_wins(rows, "k", "id").collect()} == {1, 2}
    assert {r["id"] for r in catalogue.last_wins(rows, "k", "id").collect()} == {5, 2}
    assert {tuple(r) for r in catalogue.later_duplicates(rows, "k", "id", "id").collect()} == {(3, 1), (5, 1)}


def test_retrieval(spark):
    lists = [spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "query_id long, doc_id long, rank int"), spark.createDataFrame([(1, 11, 1)], "query_id long, doc_id long, rank int")]
    got = {r["doc_id"]: (r["rank"], r["score"]) for r in retrieval.fuse(lists, 5).collect()}
    assert got == {11: (1, round(1 / 62 + 1 / 61, 9)), 10: (2, round(1 / 61, 9))}
    docs = spark.createDataFrame([(1, "x" * 1500), (2, ""), (3, "ab")], "doc_id long, text string")
    assert [(r["doc_id"], r["ord"], len(r["text"])) for r in retrieval.chunks(docs).orderBy("doc_id", "ord").collect()] == [(1, 0, 700), (1, 1, 700), (1, 2, 100), (3, 0, 2)]
    refused = retrieval.floor(spark.createDataFrame([(1, 0.05), (2, 0.7)], "query_id long, score double"), 0.1)
    assert {(r["query_id"], r["refused"]) for r in refused.collect()} == {(1, True), (2, False)}


def test_dense_in_blocks(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(retrieval, "BLOCK", 3)
    x = np.random.default_rng(0).normal(size=(20, 4))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {(r["query_id"], r["rank"]): r["vec_id"] for r in retrieval.dense(rows, rows.where("vec_id % 4 = 0"), 3).collect()}
    for q in range(0, 20, 4):
        order = sorted((i for i in range(20) if i != q), key=lambda i: (-round(float(x[q] @ x[i]), 6), i))
        assert [got[q, k] for k in (1, 2, 3)] == order[:3]


def test_checks(spark):
    row = spark.createDataFrame([("costs 1,200 or 7", "costs 1200", True)], "a string, e string, x boolean")
    assert row.select(checking.unsupported_numbers(F.col("a"), F.col("e"))).first()[0] == ["7"]
    assert row.select(checking.flags(F.lit(False), F.array(F.lit("7")), F.lit(None).cast("boolean"))).first()[0] == ["unsupported_claims"]
    assert row.select(checking.flags(F.lit(False), F.lit(None).cast("array<string>"), F.lit(False))).first()[0] == ["OK"]
    assert row.select(checking.abstains(F.lit("This cannot be confirmed."))).first()[0] is True
    assert [tuple(p) for p in row.select(checking.zipped(F.array(F.lit(1), F.lit(2)), F.array(F.lit("x")))).first()[0]] == [(1, "x")]


def test_islands_over_buckets(spark):
    events = [(1, t, t in (3, 7, 8, 30)) for t in range(40)] + [(2, t, False) for t in range(25)] + [(3, t, t == 11) for t in range(35)]
    rows = spark.createDataFrame([(u, t, r) for u, t, r in events], "u long, t long, r boolean")
    want, state = {}, {}
    for u, t, r in events:
        e, d = state.get(u, (0, 0))
        state[u] = (e + 1, 0) if r else (e, d + 1)
        want[u, t] = state[u]
    for size in (1, 4, 10, 100):
        got = sessions.islands(rows, "u", ["t"], F.expr(f"t div {size}"), F.col("r")).collect()
        assert {(g["u"], g["t"]): (g["epoch"], g["depth"]) for g in got} == want


def test_breadcrumbs(spark):
    steps = spark.createDataFrame([(1, 0, "a", False), (1, 1, "", False), (1, 2, "b", False), (1, 3, "r", True), (1, 4, "c", False)], "s long, t long, label string, reset boolean")
    got = {r["t"]: r["path"] for r in sessions.breadcrumbs(steps, "s", "t", "label", "reset").collect()}
    assert got == {0: ["a"], 1: ["a"], 2: ["a", "b"], 3: [], 4: ["c"]}


def test_session_stream_in_any_order_of_files(spark, tmp_path):
    import datetime
    import os
    import random

    from lodestone.streaming.sessions import run_to_end

    rng = random.Random(6)
    start = datetime.datetime(2024, 1, 1)
    events = [(i, start + datetime.timedelta(minutes=10 * rng.randrange(60)), rng.choice([1, 2, None]), rng.choice(["error", "click", "view", "view", None])) for i in range(60)]
    events += [(100 + i, start + datetime.timedelta(minutes=7 * i), 3, "view") for i in range(20)]
    want = {}
    for _, _, user, kind in sorted(events, key=lambda e: (e[1], e[0])):
        epoch, depth, n = want.get(user, (0, 0, 0))
        want[user] = (epoch + 1, 0, n + 1) if kind == "error" else (epoch, depth + 1, n + 1)
    latest_first = sorted(events, key=lambda e: e[1], reverse=True)
    for k in range(4):
        path = f"{tmp_path}/events{k}.parquet"
        spark.createDataFrame(latest_first[k * 20 : k * 20 + 20], "event_id long, ts timestamp, user_id long, event_type string").coalesce(1).write.parquet(path)
        for name in os.listdir(path):
            os.utime(f"{path}/{name}", (1_700_000_000 + k, 1_700_000_000 + k))
    got = run_to_end(f"{tmp_path}/events*.parquet", spark, f"{tmp_path}/out", f"{tmp_path}/state", files=1).collect()
    assert {r["user_id"]: (r["epoch"], r["depth"], r["n_events"]) for r in got} == want
    assert len(os.listdir(f"{tmp_path}/out")) > 1


def test_paths_beyond_the_limits_of_recursion(spark):
    edges = spark.createDataFrame([(str(i), "o", str(i + 1)) for i in range(6)] + [("6", graph.RESTART, "0")], "node_id string, option_id string, next_node_id string")
    limits = {"spark.sql.cteRecursionLevelLimit": "3", "spark.sql.cteRecursionRowLimit": "4"}
    for k, v in limits.items():
        spark.conf.set(k, v)
    try:
        got = {tuple(r) for r in graph.paths(edges, "0").collect()}
    finally:
        for k in limits:
            spark.conf.unset(k)
    assert got == {(str(i), i, ">".join(map(str, range(i + 1)))) for i in range(7)}
    with pytest.raises(ValueError, match="cycle"):
        graph.paths(edges.withColumn("option_id", F.lit("o")), "0")


def test_nearest_two_collects_no_keys(spark, monkeypatch):
    keys = spark.createDataFrame([(i, f"key {i} of many") for i in range(40)], "ordinal long, text string")
    questions = spark.createDataFrame([(i, f"key {i} of man") for i in range(40)], "number long, text string")
    found = []
    collect = type(keys).collect
    monkeypatch.setattr(type(keys), "collect", lambda self: found.append(1) or collect(self))
    frame = matching.nearest_two(questions, keys, block=7, asked=3)
    assert not found
    for r in frame.toPandas().itertuples():
        best = sorted((-ratio(f"key {r.number} of man", f"key {i} of many"), i) for i in range(40))[:2]
        assert (r.best, r.second, r.ordinal) == (-best[0][0], -best[1][0], best[0][1])


def test_block_chunks_keep_lines_and_tables(spark):
    rows = [(1, "aaaa\nbbb\n| x\n| y\ncc\n| z\n"), (2, "a" * 25), (3, ""), (4, None), (5, "ab\n\ncd\n" + "e" * 7), (6, " \n ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"], r["start"], r["is_table"], r["text"]) for r in retrieval.block_chunks(docs, 10).collect())
    assert got == [
        (1, 0, False, "aaaa\nbbb"),
        (1, 9, True, "| x"),
        (1, 13, True, "| y"),
        (1, 17, False, "cc"),
        (1, 20, True, "| z"),
        (2, 0, False, "a" * 10),
        (2, 10, False, "a" * 10),
        (2, 20, False, "a" * 5),
        (5, 0, False, "ab\n\ncd\n" + "e" * 7),
    ]
    assert retrieval.block_chunks(docs.limit(0)).count() == 0
