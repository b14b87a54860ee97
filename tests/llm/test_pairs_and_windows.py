"""Near and exact duplicates, repeated windows and decontamination against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import components, decontaminate, exact_dedup, jaccard_join, rolling, substring_dedup

SCHEMA = "doc_id long, text string, lang string, n long"


def corpus(seed, n=60, words=40, vocabulary=60):
    """Texts with copies, near copies, shared passages, odd white space, nulls, empty and long ones."""
    rng = random.Random(seed)
    word = lambda: rng.choice(["Ab", "cd", "é", "x", "Zz9", "foo", "bar", "ß"]) + str(rng.randrange(vocabulary))
    texts = [None, "", " \t\n", "one", "one", "One two", "a b c", "a\x0bb\x0cc", "A b c"]
    base = [word() for _ in range(120)]
    passage = [word() for _ in range(25)]
    for i in range(n):
        kind = i % 5
        w = list(base) if kind == 0 else [word() for _ in range(rng.randrange(1, words))]
        if kind == 0:
            for _ in range(rng.randrange(4)):
                w[rng.randrange(len(w))] = word()
        if kind == 1:
            at = rng.randrange(len(w) + 1)
            w[at:at] = passage
        texts.append(rng.choice([" ", "  ", "\n"]).join(w))
    texts += rng.sample(texts[9:], 8)
    texts.append(" ".join(word() for _ in range(4000)))
    return [(7 * i + 3, t, "en", i) for i, t in enumerate(texts)]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingles(text, k):
    w = split(lower(text))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def components_of(ids, links):
    least = {i: i for i in ids}
    while True:
        before = dict(least)
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b])
        if least == before:
            return least


def near(rows, k=4, percent=85):
    sets = {d: shingles(t, k) for d, t, *_ in rows}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    return {d: len(s) for d, s in sets.items()}, components_of(sets, links)


@pytest.mark.parametrize("block", [256, 3])
def test_jaccard(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    rows = corpus(block)
    sizes, comp = near(rows)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.similar_documents(frame(spark, rows)).collect()}
    assert got == {d: (sizes[d], comp[d]) for d in sizes}
    assert len(set(comp.values())) < len(comp) - 10


@pytest.mark.parametrize("block", [1024, 3])
def test_jaccard_links(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    rng = random.Random(block)
    rows = corpus(block)
    base = [f"n{i}" for i in range(90)]
    for i in range(12):  # near copies of each other, of which a component needs only some links
        w = list(base)
        w[rng.randrange(90)] = f"m{i % 9}"
        rows.append((1000 + i, " ".join(w), "en", i))
    sets = {d: shingles(t, 4) for d, t, *_ in rows}
    rep = {d: min(x for x in sets if sets[x] == s) if s else d for d, s in sets.items()}
    similar = {(a, b) for a in sets for b in sets if a != b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])}
    pairs, members = jaccard_join.similar_pairs(frame(spark, rows))
    assert sorted(map(tuple, pairs.collect())) == sorted({(rep[a], rep[b]) for a, b in similar if rep[a] < rep[b]})
    want = {d: (len(s), rep[d], sum(a == d for a, _ in similar)) for d, s in sets.items()}
    assert {r["doc_id"]: (r["n_shingles"], r["rep"], r["n_links"]) for r in members.collect()} == want
    assert any(n > 8 for *_, n in want.values())


def test_jaccard_links_odd_tables(spark):
    pairs, members = jaccard_join.similar_pairs(frame(spark, []))
    assert pairs.count() == members.count() == 0
    pairs, members = jaccard_join.similar_pairs(frame(spark, [(None, "a b", "en", 1), (2, "A b", "en", 2), (3, None, "en", 3), (4, "a b", "en", 4)]))
    assert pairs.count() == 0
    assert sorted(map(tuple, members.collect()), key=str) == [(2, 1, 2, 1), (3, 0, 3, 0), (4, 1, 2, 1), (None, 1, None, 0)]


def test_jaccard_with_common_shingles(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "COMMON", 3)
    monkeypatch.setattr(jaccard_join, "EXCESS", 0)
    rows = corpus(11)
    sizes, comp = near(rows)
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.similar_documents(frame(spark, rows)).collect()}
    assert got == comp


def twins(steps=10):
    """Two different words of 2 ** steps bytes that every polynomial modulo 2 ** 64 with an odd base takes for one."""
    word = "a"
    for _ in range(steps):
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_words_that_polynomials_confuse(spark):
    for steps in (10, 11):
        x, y = twins(steps)
        tail = [f"w{i}" for i in range(14)]
        rows = [(i, " ".join([*tail[:7], w, *tail[7:]]), "en", i) for i, w in enumerate((x, y))]
        got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in substring_dedup.remove_repeats(frame(spark, rows)).collect()}
        assert got == repeats(rows, 13)
        assert got[1][1] == 0
        sizes, comp = near(rows)
        found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.similar_documents(frame(spark, rows)).collect()}
        assert found == {d: (sizes[d], comp[d]) for d in sizes}


def test_words_built_for_one_table(spark):
    """Two words that shared all 64 bits while the table of random numbers was the same in every run."""
    x, y = "rnmjzgzhuvlgwkypzxukdvktiljfkirenawwvkzpqgwksyiftimmussgkedtfetv", "ledhjtwlipppwmbtggugdmehfymbilucnruwjopxkzrvwenrcxbbzghwixvmgrfx"
    rows = [(i, " ".join([w, *(f"w{k}" for k in range(12))]), "en", i) for i, w in ((1, x), (2, y))]
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in substring_dedup.remove_repeats(frame(spark, rows)).collect()}
    assert got == repeats(rows, 13) and got[2][1] == 0
    pairs, members = jaccard_join.similar_pairs(frame(spark, rows))
    assert len({r["rep"] for r in members.collect()}) == 2  # two classes, whether they link or not
    for key in (b"a" * 16, b"b" * 16):
        raw = np.frombuffer(f"{x} {y}".encode(), np.uint8)
        h, _ = rolling.word_hashes(raw, np.array([0, len(raw)]), lower=False, key=key)
        assert h[0] != h[1]


@pytest.mark.parametrize(("size", "percent", "width"), [(512, 80, 5), (512, 85, 4), (1024, 80, 5)])
def test_pairs_of_a_group_come_up_about_once(spark, monkeypatch, size, percent, width):
    """Near copies of one text, below and above the threshold to each other: few pairs leave the tiles, and no link is lost."""
    rng = random.Random(size + percent)
    base = [f"w{rng.randrange(10**6)}" for _ in range(size)]
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(rng.choice([2, size // 60, size // 40, size // 25])):
            w[rng.randrange(size)] = f"v{rng.randrange(10**6)}"
        rows.append((i, " ".join(w), "en", i))
    passage = [f"p{i}" for i in range(30)]  # one passage that many unlike documents share
    rows += [(100 + i, " ".join([*(f"u{rng.randrange(10**6)}" for _ in range(size - 30)), *passage]), "en", i) for i in range(40)]
    seen = []
    plain = jaccard_join._distinct_pairs
    monkeypatch.setattr(jaccard_join, "_distinct_pairs", lambda pairs: seen.append(pairs.count()) or plain(pairs))
    sizes, comp = near(rows, width, percent)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.similar_documents(frame(spark, rows), width=width, percent=percent).collect()}
    assert got == {d: (sizes[d], comp[d]) for d in sizes}
    sets = [shingles(t, width) for _, t, *_ in rows[:60]]
    close = sum(100 * len(a & b) >= (percent - 6) * len(a | b) for i, a in enumerate(sets) for b in sets[:i])
    assert seen[1] <= 4 * close + 60


def test_rows_grow_with_a_group_not_with_its_square(spark, monkeypatch):
    """Near copies of one text that are just unlike each other, or just alike: four times as many make no table more than about four times longer."""
    made, plain = {}, jaccard_join.staged

    def counted(df, name):
        made[name] = (out := plain(df, name)).count()
        return out

    monkeypatch.setattr(jaccard_join, "staged", counted)
    rng = random.Random(3)
    base = [f"w{rng.randrange(10**6)}" for _ in range(512)]
    rows = []
    for i in range(160):
        w = list(base)
        for at in rng.sample(range(512), rng.choice([5, 6, 7, 8])):
            w[at] = f"v{rng.randrange(10**6)}"
        rows.append((i, " ".join(w), "en", i))
    lengths = []
    for group in (rows[:40], rows):
        made.clear()
        sizes, comp = near(group, 5, 80)
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.similar_documents(frame(spark, group), width=5, percent=80).collect()}
        assert got == {d: (sizes[d], comp[d]) for d in sizes}
        assert len(set(comp.values())) > 1
        lengths.append(dict(made))
    assert [k for k, n in lengths[1].items() if n > 7 * max(lengths[0][k], 40)] == []
    assert lengths[1]["rest-links"] < 160  # less than one a row: a forest


def test_blocks_of_long_sets(spark, monkeypatch):
    """Blocks bounded by bytes, of three documents and of one each: no link is lost, and rows that repeat an id are one node."""
    rows = corpus(5)
    rows += [(rows[12][0], rows[20][1], "en", 1), (rows[15][0], rows[25][1], "en", 1)]
    alone = dict(enumerate(rows))
    _, comp = near([(k, r[1]) for k, r in alone.items()])
    ids = [r[0] for r in rows]
    want = components_of(ids, [(ids[k], ids[c]) for k, c in comp.items()])
    for size in (3 * 8 * 120, 1):
        monkeypatch.setattr(jaccard_join, "BLOCK_BYTES", size)
        got = {r["doc_id"]: r["component_id"] for r in jaccard_join.similar_documents(frame(spark, rows)).collect()}
        assert got == want


def test_near_duplicates_stage_judges_rows(spark):
    rng = random.Random(8)
    texts = [" ".join(f"w{rng.randrange(50)}" for _ in range(60)) for _ in range(6)]
    copy = lambda t: " ".join([*t.split()[:-1], "end"])
    kinds = "doc_id long, text string, rep string, number int"
    unique = [(5, texts[0]), (2, copy(texts[0])), (9, texts[1]), (4, None), (3, "")]
    mixed = [*unique, (2, texts[2]), (2, texts[3]), (None, copy(texts[3])), (None, texts[4]), (7, copy(texts[4])), (None, None), (8, texts[5]), (8, texts[5])]
    for rows, want in (
        (unique, [(2, copy(texts[0])), (9, texts[1]), (4, None), (3, "")]),
        (mixed, [(2, copy(texts[0])), (9, texts[1]), (4, None), (3, ""), (2, texts[2]), (2, texts[3]), (7, copy(texts[4])), (None, None), (8, texts[5]), (8, texts[5])]),
        ([], []),
    ):
        docs = spark.createDataFrame([(*r, "x", 1) for r in rows], kinds)
        got = jaccard_join.stage(spark, docs, "")
        assert got.columns == docs.columns
        assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str) == sorted(want, key=str)


def test_jaccard_odd_tables(spark):
    assert jaccard_join.similar_documents(frame(spark, [])).count() == 0
    rows = [(None, "a b c d e", "en", 1), (5, "a b c d e", "en", 1), (5, "a b c d e", "en", 1), (4, "a b c d e", "en", 1), (6, None, None, None)]
    got = sorted((str(r["doc_id"]), r["component_id"]) for r in jaccard_join.similar_documents(frame(spark, rows)).collect())
    assert got == [("4", 4), ("5", 4), ("5", 4), ("6", 6), ("None", None)]


def test_bitmaps_bound_the_overlap():
    import numpy as np

    rng = np.random.default_rng(3)
    for n, m in ((5, 9), (300, 340), (900, 1000)):
        both = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        u, v = np.unique(np.r_[both, rng.integers(0, 1 << 63, m - n, dtype=np.uint64)]), np.unique(np.r_[both[: n // 2], rng.integers(0, 1 << 63, n, dtype=np.uint64)])
        x, y = jaccard_join.bitmap(u), jaccard_join.bitmap(v)
        size = min(len(x), len(y))
        differ = int(np.bitwise_count(jaccard_join.folded(x, size) ^ jaccard_join.folded(y, size)).sum())
        assert len(np.intersect1d(u, v)) <= (len(u) + len(v) - differ) // 2


def test_components(spark):
    links = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 6), (6, 5), (20, 21)] + [(100, i) for i in range(101, 140)]
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == components_of({x for e in links for x in e}, links)


def repeats(rows, k):
    first = {}
    for d, t, *_ in rows:
        w = split(t)
        for i in range(len(w) - k + 1):
            key = tuple(w[i : i + k])
            first[key] = min(first.get(key, d), d)
    out = {}
    for d, t, *_ in rows:
        w = split(t)
        gone = set()
        for i in range(len(w) - k + 1):
            if first[tuple(w[i : i + k])] < d:
                gone |= set(range(i, i + k))
        out[d] = (len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone))
    return out


def test_repeats(spark, monkeypatch):
    rows = corpus(2)
    want = repeats(rows, 13)
    for mb in (4, 0.001):
        monkeypatch.setattr(substring_dedup, "RANGE_MB", mb)
        got = substring_dedup.remove_repeats(frame(spark, rows)).collect()
        assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in got} == want
        assert all(sum(s["end"] - s["start"] for s in r["intervals"]) == r["n_removed"] for r in got)
    assert sum(n for _, n, _ in want.values()) > 1000


def test_repeats_settled_within_a_task(spark, monkeypatch):
    """Windows that a task remembers from earlier pieces, with smaller and larger ids coming later."""
    rows = corpus(6, n=120)
    want = repeats(rows, 13)
    random.Random(1).shuffle(rows)
    monkeypatch.setattr(substring_dedup, "CHUNK", 700)
    monkeypatch.setattr(substring_dedup, "FREQUENT", 2)
    monkeypatch.setattr(substring_dedup, "RANGE_MB", 0.003)
    got = substring_dedup.remove_repeats(frame(spark, rows).coalesce(1)).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in got} == want


def test_repeats_odd_tables(spark):
    assert substring_dedup.remove_repeats(frame(spark, [])).count() == 0
    text = " ".join(map(str, range(20)))
    rows = [(None, text, "en", 1), (2, text, "en", 1), (2, text, "en", 1), (-3, "x " + text, "en", 1), (9, "a b", None, None)]
    got = sorted((str(r["doc_id"]), r["n_removed"]) for r in substring_dedup.remove_repeats(frame(spark, rows)).collect())
    assert got == [("-3", 0), ("2", 20), ("2", 20), ("9", 0), ("None", 0)]


def test_packing():
    import numpy as np

    for x in ([], [0], [5, 300, 70000], [1 << 63, (1 << 64) - 1]):
        x = np.array(x, dtype=np.uint64)
        assert (substring_dedup.unpacked(substring_dedup.packed(x)) == x).all()
        if len(x):
            assert (substring_dedup.unpacked_sorted(substring_dedup.packed_sorted(np.sort(x))) == np.sort(x)).all()


def item_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def hits(rows, items):
    out = {}
    for d, t, *_ in rows:
        w, hit, names = item_words(t), set(), set()
        for name, text in items:
            b = item_words(text)
            n = min(10, len(b))
            windows = {tuple(b[i : i + n]) for i in range(len(b) - n + 1)} if b else set()
            for i in range(len(w) - n + 1):
                if n and tuple(w[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
                    names.add(str(name))
        out[d] = (len(w), len(hit), sorted(names))
    return out


def test_decontaminate(spark):
    rng = random.Random(4)
    word = lambda: rng.choice(["Ab", "cd", "é", "x", "Zz9"]) + str(rng.randrange(9))
    items = [(i, " ".join(word() for _ in range(rng.choice([0, 1, 2, 4, 9, 10, 11, 30])))) for i in range(30)] + [(99, None), (100, "--")]
    rows = [(1, None, "en", 1), (2, "", "en", 2), (3, "a-b", None, 3)]
    for i in range(60):
        w = [word() for _ in range(rng.randrange(60))]
        b = item_words(rng.choice(items)[1])
        a = rng.randrange(len(b) + 1)
        w[rng.randrange(len(w) + 1) :][:0] = []
        at = rng.randrange(len(w) + 1)
        w[at:at] = b[a : a + rng.randrange(40)]
        rows.append((10 + i, rng.choice([" ", "-", ". "]).join(w).upper() if i % 3 else " ".join(w), "en", i))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in decontaminate.contaminated(frame(spark, rows), bench).collect()}
    want = hits(rows, items)
    assert got == want
    assert sum(bool(n) for _, n, _ in want.values()) > 10
    long_only = [x for x in items if len(item_words(x[1])) >= 10]
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in decontaminate.contaminated(frame(spark, rows), bench.where(F.col("item_id").isin([x[0] for x in long_only]))).collect()}
    assert got == hits(rows, long_only)
    assert decontaminate.contaminated(frame(spark, rows), bench.limit(0)).where("n_hit > 0").count() == 0
    assert decontaminate.contaminated(frame(spark, []), bench).count() == 0


def test_exact(spark):
    rows = [(i, t, "en", i) for i, t in enumerate(["a", "b", "a", "", None, "A", "a" * 50, "a" * 51, "a" * 50, "ab" * 25, "é" * 25, "x" * 1000, "x" * 1000, "x" * 999 + "y"])]
    for block in (4, 7, 8192):
        got = {r["doc_id"]: r for r in exact_dedup.exact_duplicates(frame(spark, rows), block=block).collect()}
        for d, t, *_ in rows:
            group = [e for e, u, *_ in rows if (u or "") == (t or "")]
            assert (got[d]["keep_id"], got[d]["group_size"], got[d]["kept"]) == (max(group), len(group), d == max(group))
            assert got[d]["text_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()


def test_exact_odd_tables(spark):
    assert exact_dedup.exact_duplicates(frame(spark, [])).count() == 0
    got = [tuple(r)[:4] for r in exact_dedup.exact_duplicates(frame(spark, [(1, "a", "", 0), (1, "a", "", 0), (None, "a", "", 0)])).collect()]
    assert sorted(map(str, got)) == sorted(map(str, [(1, 1, 3, True), (1, 1, 3, True), (None, 1, 3, False)]))
