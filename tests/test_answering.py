"""Sentences, rounds and the cascade on small tables; support by evidence against brute force."""

import random

from pyspark.sql import functions as F

from lodestone.functions.grounding import SuffixAutomaton, supported
from lodestone.functions.text import normalized
from lodestone.operators import answering, checking, inverted
from lodestone.operators.staging import fresh_path
from lodestone.plans.catalog import QUERIES


def test_runs_of_evidence():
    rng = random.Random(9)
    for _ in range(300):
        known = [rng.choice("abc") for _ in range(rng.randrange(0, 30))]
        words = [rng.choice("abcd") for _ in range(rng.randrange(0, 12))]
        runs = {tuple(known[i:j]) for i in range(len(known)) for j in range(i + 1, len(known) + 1)}
        pieces = [(i, j) for i in range(len(words)) for j in range(i + 1, len(words) + 1) if tuple(words[i:j]) in runs]
        for least in (1, 2, 3):
            covered = {k for i, j in pieces if j - i >= least for k in range(i, j)}
            assert supported(SuffixAutomaton(known), words, least) == (len(covered), max((j - i for i, j in pieces), default=0))


def test_grounded_edges(spark):
    rows = [(1, "The cat sat. On mats, it purred!", "a cat sat on mats"), (2, "Alone here", None), (3, None, "x"), (4, "...", "x")]
    got = sorted(tuple(r) for r in checking.grounded(spark.createDataFrame(rows, "id long, answer string, evidence string"), 2).collect())
    assert got == [(1, 0, 3, 2, 2, 0.666667), (1, 1, 4, 2, 2, 0.5), (2, 0, 2, 0, 0, 0.0)]


def test_runs_of_several_texts():
    rng = random.Random(10)
    for _ in range(300):
        texts = [[rng.choice("abc") for _ in range(rng.randrange(0, 12))] for _ in range(rng.randrange(0, 6))]
        words = [rng.choice("abcd") for _ in range(rng.randrange(0, 12))]
        automaton, have = SuffixAutomaton(), {tuple(x[i:j]) for x in texts for i in range(len(x)) for j in range(i + 1, len(x) + 1)}
        for x in texts:
            automaton.add(x)
        assert automaton.matched(words) == [max((n for n in range(end + 1) if tuple(words[end - n : end]) in have), default=0) for end in range(1, len(words) + 1)]
        assert len(automaton.size) <= 2 * sum(map(len, texts)) + 1


def test_grounded_in_all_earlier_turns(spark):
    # Turn 5 repeats what turns 0 and 3 say, after a gap; a run does not go on from one turn to the next, and what comes later counts for nothing.
    said = [(1, 0, "user", "the red pump leaks"), (1, 1, "assistant", "Check the valve."), (1, 3, "user", "oil it now"), (1, 5, "assistant", "Oil it. The red pump! Leaks oil it? Valve"), (1, 6, "user", "leaks oil it")]
    path = fresh_path(spark, "tables")
    spark.createDataFrame([*said, (2, 0, "user", "check the valve"), (2, 1, "assistant", None)], "conv_id long, turn long, role string, text string").write.parquet(f"{path}/conversations.parquet")
    got = sorted(tuple(r)[:6] for r in QUERIES["grounded_sentences"](spark, path).collect())
    assert got == [(1, 1, 0, 3, 0, 1), (1, 5, 0, 2, 2, 2), (1, 5, 1, 3, 3, 3), (1, 5, 2, 3, 2, 2), (1, 5, 3, 1, 0, 1)]


def test_grounded_before_by_brute_force(spark):
    rng = random.Random(11)
    key = lambda most: rng.choice([None, *range(most)])
    rows = [(key(4), key(9), rng.choice([None, " ".join(rng.choice(["a", "b", "B", "c.", "d!"]) for _ in range(rng.randrange(0, 9)))]), rng.choice([None, True, False, True])) for _ in range(150)]
    want = []
    for group, order, text, asked in rows:
        before = [(t or "").lower().replace(".", "").replace("!", "").split() for g, o, t, _ in rows if None not in (group, order, g, o) and g == group and o < order]
        have = {tuple(x[i:j]) for x in before for i in range(len(x)) for j in range(i + 1, len(x) + 1)}
        for ord_, said in enumerate([x.lower().split() for x in (text or "").replace("!", ".").split(".") if x.strip()] if asked else []):
            pieces = [(i, j) for i in range(len(said)) for j in range(i + 1, len(said) + 1) if tuple(said[i:j]) in have]
            covered = len({k for i, j in pieces if j - i >= 2 for k in range(i, j)})
            want.append((group, order, ord_, len(said), covered, max((j - i for i, j in pieces), default=0), round(covered / len(said), 6)))
    table = spark.createDataFrame(rows, "g long, o long, text string, asked boolean").repartition(3)
    for piece in (checking.PIECE, 60, 1):  # whole groups, a few pieces each, about a piece for each byte
        got = [tuple(r) for r in checking.grounded_before(table, "g", "o", 2, piece).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)


DOCS = [
    (1, "Pumps fail when valves jam. Rain fell. Valves jam in cold weather! Cold weather ends."),
    (2, "The printer needs paper. Trays hold paper and ink."),
    (3, "Ink dries when trays stay open. Open trays gather dust and dust harms printer heads."),
    (4, None),
]


def test_rounds(spark):
    docs, path = spark.createDataFrame(DOCS, "doc_id long, text string"), fresh_path(spark, "index")
    inverted.add_documents(docs, path)
    asked = spark.createDataFrame([(1, "valves jam cold"), (2, "printer zebra quagga unicorn"), (3, "nothing known"), (4, None)], "query_id long, text string")
    got = {r["query_id"]: r for r in answering.controlled(spark, path, docs, asked).collect()}
    assert set(got) == {1, 2, 3}
    assert got[1]["resolved"] and got[1]["coverage"] == 1.0 and got[1]["answer"] == "Valves jam in cold weather" and got[1]["warnings"] == []
    assert [(c["doc_id"], c["pos"]) for c in got[1]["cites"]] == [(1, 2)]
    # Rewriting finds no more of words that no document has: the first answer stays.
    assert (got[2]["attempt"], got[2]["resolved"], got[2]["warnings"]) == (1, False, ["rewritten", "rolled_back", "low_coverage"])
    assert (got[3]["coverage"], got[3]["answer"], got[3]["cites"]) == (0.0, None, []) or got[3]["answer"] == ""
    one = {r["query_id"]: r["warnings"] for r in answering.controlled(spark, path, docs, asked, rounds=1).collect()}
    assert one[2] == ["low_coverage"]


def test_sentences_are_chosen_by_what_they_add(spark):
    docs = spark.createDataFrame([(1, "a b c. a b d. d e. x y")], "doc_id long, text string")
    weights = spark.createDataFrame([(1, t, w) for t, w in (("a", 2.0), ("b", 2.0), ("c", 1.5), ("d", 1.0), ("e", 0.2), ("z", 9.0))], "query_id long, term string, weight double")
    found = spark.createDataFrame([(1, 1, 1)], "query_id long, doc_id long, rank int")
    got = sorted((r["nth"], r["pos"], r["gain"]) for r in answering.extracts(weights, found, docs).collect())
    # "a b d" would add 1.0 and lose a quarter of 4.0, "d e" adds 1.2; after that nothing adds.
    assert got == [(1, 0, 5.5), (2, 2, 1.2)]
    assert answering.coverage(weights, answering.extracts(weights, found, docs)).first()["coverage"] == round(6.7 / 15.7, 6)


def test_cascade(spark):
    docs, path = spark.createDataFrame(DOCS, "doc_id long, text string"), fresh_path(spark, "index")
    inverted.add_documents(docs, path)
    faq = spark.createDataFrame([(0, "q0", "How do I reset my password today", "Press reset."), (1, "q1", "How long is the warranty of the pump", "Two years."), (2, "q2", "How long is the warranty of the bump", "One year.")], "ordinal long, id string, question string, answer string")
    faq = faq.select("ordinal", "id", normalized(F.col("question")).alias("question_normalized"), "answer")
    questions = spark.createDataFrame(
        [(1, " how do I RESET my password today?"), (2, "How do I reset my pasword today"), (3, "How long is the warranty of the gump"), (4, "valves jam cold"), (5, "quagga"), (6, None)], "number long, question string"
    )
    got = {r["number"]: r for r in answering.answered_by_cascade(spark, questions, faq, path, docs).collect()}
    assert {n: r["route"] for n, r in got.items()} == {1: "scenario", 2: "scenario", 3: "abstain", 4: "rag", 5: "abstain", 6: "abstain"}
    assert got[1]["answer"] == got[2]["answer"] == "Press reset." and got[4]["answer"] == "Valves jam in cold weather"
    assert got[3]["warnings"][0] == "two curated questions are alike" and "low_coverage" in got[3]["warnings"] and len(got[5]["warnings"]) >= 3
