"""Conversation repair, mixing of sources and periodic runs against brute force."""

import hashlib
import itertools
import random
import zlib
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import conversation_repair as cr
from lodestone.llm import periodic_runs as pr
from lodestone.llm import source_mix as sm

# --- op11 -----------------------------------------------------------------


def cheapest(turns):
    """(cost, audit, roles) by trying every edit of every turn with up to two inserts anywhere."""
    best = None
    for edits in itertools.product(("K", "U", "A", "D"), repeat=len(turns)):
        if any(fault == "gone" and e != "D" for e, (_, fault) in zip(edits, turns, strict=True)):
            continue
        for puts in itertools.product(("", "u", "a", "ua", "au"), repeat=len(turns) + 1):
            roles, audit, cost = "", "", 0
            for put, e, turn in zip(puts, [*edits, ""], [*turns, None], strict=True):
                roles, audit, cost = roles + put, audit + "I" * len(put), cost + 3 * len(put)
                if e == "D":
                    audit, cost = audit + "D", cost + 4
                elif e:
                    roles += turn[0] if e == "K" else e.lower()
                    audit += "K" if e == "K" else "R"
                    cost += (0 if e == "K" else 3) + (3 if turn[1] else 0)
            rest = roles[1:] if roles[:1] == "s" else roles
            if roles and (not rest or rest != "ua" * (len(rest) // 2)):
                continue
            best = min(best or (cost, audit, roles), (cost, audit, roles))
    return best


def repaired(turns, size):
    pieces = [turns[i : i + size] for i in range(0, len(turns), size)]
    ways = [cr.ways_through(p, range(4) if i else (0,)) for i, p in enumerate(pieces)]
    path = cr.chosen_ways([[w[:4] for w in p] for p in ways])
    cost, script = 0, ""
    for p, (a, b) in zip(ways, path, strict=True):
        (way,) = (w for w in p if w[:2] == (a, b))
        cost, script = cost + way[2], script + way[4]
    tail = cr.TAILS[path[-1][1]]
    return cost + 3 * len(tail), (script + tail).translate(cr._AUDIT)


def test_edits_are_the_cheapest_and_least():
    rng = random.Random(4)
    for _ in range(150):
        turns = [(rng.choice("ssuuaax"), rng.choice(["", "", "cut", "gone"])) for _ in range(rng.randrange(1, 4))]
        want = cheapest(turns)[:2]
        assert repaired(turns, 10) == want
        assert repaired(turns, 1) == want


def table_search(turns):
    """The same by a table of whole scripts, for longer conversations."""
    now = {0: (0, "")}
    for initial, fault in turns:
        best = {}
        for state, (cost, audit) in now.items():
            for to, more, initials, _ in cr.STEPS[initial if initial in ("s", "u", "a") else "", fault][state]:
                way = (cost + more, audit + initials)
                best[to] = min(best.get(to, way), way)
        now = best
    return min((c + 3 * len(cr.TAILS[s]), a + "I" * len(cr.TAILS[s])) for s, (c, a) in now.items())


def test_pieces_join_like_one_search():
    rng = random.Random(8)
    for _ in range(120):
        turns = [(rng.choice("suuuaaa" if rng.random() < 0.7 else "su"), rng.choice(["", "", "", "cut", "gone"])) for _ in range(rng.randrange(1, 120))]
        want = table_search(turns)
        for size in (1, 7, 1000):
            assert repaired(turns, size) == want


def test_memory_stays_bounded():
    search, most = cr.Search(), 0
    for i in range(5000):
        search.step("ua"[i % 2], "" if i % 7 else "cut")
        most = max(most, sum(len(search.unresolved(s)) for s in search.survivors))
    assert most < 60


def conversation(rows):
    """Counts, audit and repaired lines of one conversation's (turn, role, text) rows, in plain Python."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
    seen, faults = set(), []
    for _, role, text in rows:
        body = text.strip(" \t\n\v\f\r")
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    cost, audit = table_search([(role[:1], {"": "", "truncated": "cut"}.get(f, "gone")) for (_, role, _), f in zip(rows, faults, strict=True)])
    lines, left = [], iter(rows)
    for edit in audit:
        at = len(lines) - (1 if lines and lines[0].startswith("s") else 0)
        due = ("user", "assistant")[at % 2]
        if edit == "I":
            lines.append(f"{due}:")
            continue
        _, role, text = next(left)
        if edit != "D":
            lines.append(f"{role if edit == 'K' else due}:{text}")
    turns = [t for t, _, _ in rows if t is not None]
    bad = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), bad, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def test_repair_of_a_table(spark, monkeypatch):
    monkeypatch.setattr(cr, "PIECE", 4)
    rng = random.Random(2)
    rows = []
    for conv, many in [(1, 200), (2, 3), (3, 1), (None, 40), (4, 9)]:
        for i in range(many):
            rows.append((conv, rng.choice([None, i, i // 2]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""]), rng.choice([None, "", " \n", "Yes.", "No", f"A {i}!", f"b {i} ", "ü?" * 50]), "x"))
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, seq string")
    found = cr.repair(table)
    digests = {r["conv_id"]: r["repaired_sha256"] for r in cr.line_digests(found.turns).collect()}
    empty = hashlib.sha256().hexdigest()
    got = {r["conv_id"]: (*(r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")), digests.get(r["conv_id"], empty)) for r in found.conversations.collect()}
    groups = defaultdict(list)
    for conv, turn, role, text, _ in rows:
        groups[conv].append((turn, " " if role is None else role, " " if text is None else text))
    assert got == {conv: conversation(g) for conv, g in groups.items()}
    assert cr.repair(table.limit(0)).conversations.count() == 0


def test_repair_query(spark, tmp_path):
    rng = random.Random(6)
    rows = [(c, t, rng.choice(["user", "assistant", "system", None]), rng.choice(["Hi.", "Well", "So! ", None, ""])) for c in (1, 2, 3, None) for t in [*range(12), None]]
    drops = next(i for i in range(1000) if zlib.crc32(f"{i}:7".encode()) % 20 == 0)
    rows.append((drops, 7, "user", "gone"))
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    groups = {c: [] for c, *_ in rows}
    for conv, turn, role, text in rows:
        how = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if how:
            row = (turn, "user" if how == 4 else role, "" if how == 1 else "".join(c for c in text if c not in ".!?") if how == 2 else text)
            groups[conv] += [row] * (2 if how == 3 else 1)
    none = (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())
    got = {r["conv_id"]: tuple(r)[1:] for r in cr.op11_conversation_repair(spark, str(tmp_path)).collect()}
    assert got == {conv: conversation(g) if g else none for conv, g in groups.items()}


# --- op12 -----------------------------------------------------------------


def test_mix(spark):
    rng = random.Random(3)
    rows = [(i if i % 50 else None, " ".join(["w"] * rng.choice([0, 1, 5, 40, 900])), rng.choice(["a", "a", "a", "b", "c", "é", None]), i) for i in range(2000)]
    rows += [(7, "same words here", "a", 1)] * 5 + [(9001, None, "b", 1), (9002, "", None, 1)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string, size long")
    got = sorted(map(tuple, sm.mixed(table).collect()), key=str)
    assert got == sorted(map(tuple, sm.mixed(table.repartition(7, "text")).collect()), key=str)
    assert len(got) == len(rows)
    size = defaultdict(int)
    for _, text, source, _ in rows:
        size[source] += len((text or "").split())
    order = sorted(s for s in size if s is not None) + [None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target = {s: Fraction(0) for s in order}
    left, open_ = Fraction(3, 2) * sum(size.values()), set(order)
    while left > 0:
        share, total = left, sum(weight[s] for s in open_)
        left = Fraction(0)
        for s in list(open_):
            target[s] += share * weight[s] / total
            if target[s] > 2 * size[s]:
                left += target[s] - 2 * size[s]
                target[s] = Fraction(2 * size[s])
                open_.discard(s)
    by_size = {size[s]: float(target[s]) for s in order}
    taken = defaultdict(int)
    for _, n, whole, aim, took in got:
        assert abs(aim - by_size[whole]) < 1e-6 * (1 + aim)
        assert took == 0 if n == 0 else took % n == 0 and took <= 2 * n
        taken[whole] += took
    for whole, took in taken.items():
        assert abs(took - by_size[whole]) <= 1
    assert sm.mixed(table.limit(0)).count() == 0


def test_mix_of_a_large_source_needs_steps(spark, monkeypatch):
    table = spark.range(30000).select(F.col("id").alias("doc_id"), F.lit("one two three").alias("text"), F.when(F.col("id") < 20000, "a").otherwise("b").alias("source"))
    few = sm.mixed(table, look=2)  # the search for the end goes several steps down
    taken = {r["source_size"]: (r["t"], r["target"]) for r in few.groupBy("source_size", "target").agg(F.sum("taken").alias("t")).collect()}
    assert all(abs(t - aim) <= 3 for t, aim in taken.values())


def test_inclusion_follows_the_boost(spark):
    table = spark.range(6000).select(F.col("id").alias("doc_id"), F.lit("w w").alias("text"), F.lit("a").alias("source"), (1 + F.col("id") % 4).cast("double").alias("b"))
    got = sm.mixed(table, total=0.25, boost="b").withColumn("b", F.col("doc_id") % 4 + 1).groupBy("b").agg(F.avg(F.col("taken") / 2).alias("share")).collect()
    assert all(abs(r["share"] - 0.1 * r["b"]) < 0.04 for r in got)
    # Copies stop at two: the others share what that leaves over.
    got = sm.mixed(table, total=1.9, boost="b").withColumn("b", F.col("doc_id") % 4 + 1).groupBy("b").agg(F.avg(F.col("taken") / 2).alias("share")).collect()
    share = {r["b"]: r["share"] for r in got}
    assert share[2] == share[3] == share[4] == 2.0 and abs(share[1] - 1.6) < 0.01


# --- op13 -----------------------------------------------------------------


def brute_runs(w, least=24, times=3):
    found = {}
    for p in range(1, len(w) // times + 1):
        i = 0
        while i + p < len(w):
            if w[i] != w[i + p]:
                i += 1
                continue
            start = i
            while i + p < len(w) and w[i] == w[i + p]:
                i += 1
            if i - start + p >= max(least, times * p):
                found.setdefault((start, i - start + p), p)
    return sorted(((s, n, p) for (s, n), p in found.items()), key=lambda r: (r[0], r[2]))


def made_words(rng):
    many, words = rng.choice([1, 2, 2, 3, 5, 50]), []
    for _ in range(rng.randrange(1, 7)):
        if rng.random() < 0.6:
            block = [rng.randrange(many) for _ in range(rng.randrange(1, 12))]
            words += (block * 40)[: rng.randrange(1, 120)]
        else:
            words += [rng.randrange(many) for _ in range(rng.randrange(0, 60))]
    return words


@pytest.mark.parametrize(("least", "times"), [(24, 3), (6, 3), (9, 4)])
def test_runs(least, times):
    rng = random.Random(least)
    for _ in range(40):
        texts = [made_words(rng) for _ in range(rng.randrange(1, 6))]
        got = pr.runs_of([np.array(t, dtype=np.int64) for t in texts], least, times)
        assert got == [brute_runs(t, least, times) for t in texts]


def test_runs_of_hard_texts():
    a, b = [0], [0, 1]
    while len(b) < 1500:
        a, b = b, b + a
    x = [w for i in range(2000) for w in (100 + i, *range(20))]  # one passage behind many words
    long = np.zeros(200_000, dtype=np.int64)
    assert pr.runs_of([np.array(b), np.array(x), long, np.array([], dtype=np.int64)]) == [brute_runs(b), [], [(0, 200_000, 1)], []]


def test_run_query(spark, tmp_path):
    rng = random.Random(12)
    texts = [None, "", " \t\n", "one", "x\x0by " * 30, "Ab ab " * 20 + "end", " é " * 40] + [" ".join(map(str, made_words(rng))) for _ in range(80)]
    ids = [*range(len(texts) - 1), None]
    spark.createDataFrame([(i, t, "z") for i, t in zip(ids, texts, strict=True)], "doc_id long, text string, runs string").write.parquet(f"{tmp_path}/documents.parquet")
    want = {}
    for i, t in zip(ids, texts, strict=True):
        w = (t or "").encode().split()
        h = 1 if i is None else zlib.crc32(str(i).encode())
        if h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
        runs = brute_runs(w)
        gone = {k for s, n, q in runs for k in range(s + q, s + n)}
        best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
        digests = [hashlib.sha256(x).hexdigest() for x in ("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode(), b" ".join(x for k, x in enumerate(w) if k not in gone))]
        want[i] = (len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], *digests)
    assert {r["doc_id"]: tuple(r)[1:] for r in pr.op13_periodic_runs(spark, str(tmp_path)).collect()} == want
    assert sum(1 for v in want.values() if v[0]) > 10
    assert pr.find_runs(spark.createDataFrame([], "doc_id long, text string")).count() == 0
