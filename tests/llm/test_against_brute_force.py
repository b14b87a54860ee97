"""The queries op3, op7 and op9 against plain versions of their scores, on small tables."""

import math
import random
import time
import zlib

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from lodestone.llm import html_text, language_id, toxicity


def put(folder, name, **columns):
    pq.write_table(pa.table(columns), f"{folder}/{name}.parquet")


# --- HTML -----------------------------------------------------------------------------------------------------------


class Node:
    def __init__(self, tag, parent=None, name=None):
        self.tag, self.parent, self.name, self.kids = tag, parent, name, []
        self.depth = parent.depth + 1 if parent else 0

    def above(self):
        """The node and all it stands in, from the inside out."""
        at = self
        while at:
            yield at
            at = at.parent

    def below(self):
        """The node and all within it, in document order."""
        yield self
        for k in self.kids:
            if isinstance(k, Node):
                yield from k.below()

    def texts(self):
        for k in self.kids:
            if isinstance(k, Node):
                yield from k.texts()
            else:
                yield self, k

    def html(self):
        inner = "".join(k.html() if isinstance(k, Node) else k for k in self.kids)
        return f"<{self.tag}{f' class={self.name!r}' if self.name else ''}>{inner}</{self.tag}>" if self.parent else inner


#: What a class says: points for the element, and the share of the page's points from which it is kept (None: whatever it holds).
NAMES = {None: (0, None), "plain": (0, None), "content": (25, None), "sidebar": (0, 0.5), "comments": (0, 0.9), "content has-sidebar": (25, 0.2)}
INLINE, BLOCK = ("a", "b", "span"), ("div", "section", "article", "ul", "nav", "header", "p", "p", "p", "h1", "main")


def grow(rng, node, depth):
    words = lambda n: " ".join(rng.choice(("word", "a", "longer,", "words", "end.\n ", "more,")) for _ in range(rng.randrange(n)))
    for _ in range(rng.randrange(1, 5)):
        kinds = INLINE if node.tag in (*INLINE, "p", "h1") else ("li",) if node.tag == "ul" else (*BLOCK, *INLINE)
        kind = rng.choice((*kinds, "text", "text"))
        if kind == "text" or not depth:
            node.kids.append(words(60 if node.tag in ("p", "div", "section") else 8) + rng.choice(("", " ")))
        else:
            node.kids.append(Node(kind, node, rng.choice([None, *NAMES]) if kind in ("div", "section", "ul") else None))
            grow(rng, node.kids[-1], depth - 1)


def blocks_of(tag):
    return tag not in INLINE and tag != "#root"


def brute_main_text(root):
    nodes = list(root.below())
    size = lambda t: len("".join(t.split()))
    in_link = lambda x: any(a.tag == "a" for a in x.above())

    def never(x):
        return any(a.tag == "nav" or (a.tag == "header" and not any(u.tag in ("article", "main") for u in a.parent.above())) for a in x.above())

    class Sizes:
        def __init__(self, out):
            self.length = {x: sum(size(t) for y, t in x.texts() if not out[y]) for x in nodes}
            self.density = {x: sum(size(t) for y, t in x.texts() if not out[y] and in_link(y)) / max(1, self.length[x]) for x in nodes}
            self.points = {}
            for x in nodes:
                # Texts that no block within x holds.
                own = [t for y, t in x.texts() if not out[y] and next(a for a in y.above() if a is x or blocks_of(a.tag)) is x]
                n = sum(map(size, own))
                if n and not out[x] and x.tag in ("p", "li", "section", "div", "main", "article", "body", "#root"):
                    self.points[x] = ((1 if n >= 25 else 0.2) + sum(t.count(",") for t in own) + min(n / 100, 3)) * (1 - self.density[x])

    first = {x: never(x) for x in nodes}
    sizes = Sizes(first)
    out = dict(first)
    held = {x: sum(sizes.points.get(y, 0.0) for y in x.below()) for x in nodes}
    for x in nodes:
        share = NAMES[x.name][1]
        inner = [y.tag for y in x.below() if y is not x and not first[y]]
        if x.parent and out[x.parent]:
            out[x] = True
        elif share and not out[x] and "main" not in inner:
            share = 0.2 if "article" in inner else share
            out[x] = held[x] < share * held[root] or not held[x] or (share > 0.2 and sizes.density[x] > 0.33)
    named = Sizes(out)
    if any(named.points.values()) or not held[root]:
        sizes = named
    else:
        out = first
    score = dict.fromkeys(nodes, 0.0)
    for x, points in sizes.points.items():
        base = x.parent if x.tag in ("p", "li") else x
        for a in base.above():
            score[a] += points / (1, 2, 6, 9, 12, 15)[min(base.depth - a.depth, 5)]
    for x in nodes:
        if score[x] and not out[x]:
            score[x] = (score[x] + NAMES[x.name][0] + {"article": 30, "main": 25, "section": 5, "div": 5}.get(x.tag, 0)) * (1 - sizes.density[x])
    best = max((x for x in nodes if not out[x]), key=lambda x: score[x], default=root)
    most = score[best]
    best = next((a for a in reversed(list(best.above())) if a.tag == "article"), best) if most > 0 else root
    kept, path = {best}, {best}
    if not any(x.tag in ("article", "main") and sizes.length[x] and not out[x] for x in nodes):
        path |= {a for a in best.above() if a.parent is not None}
    above = {x.parent for x in path} - {None}
    for x in nodes:
        if x.parent in above and x not in path and not out[x] and sizes.length[x]:
            wraps = max(score[y] for y in x.below() if y is x or not out[y]) * (1 - sizes.density[x])
            if (score[x] if x.parent is best.parent else wraps) >= max(10.0, 0.2 * most) or (x.tag in ("p", "h1") and sizes.density[x] < 0.25 and (sizes.length[x] > 80 or x.tag == "h1")):
                kept.add(x)
    found = [""]

    def walk(x):
        found.append("") if blocks_of(x.tag) else None
        for k in x.kids:
            if isinstance(k, Node):
                walk(k)
            elif not out[x] and kept & set(x.above()):
                found[-1] += k
        found.append("") if blocks_of(x.tag) else None

    walk(root)
    return " ".join(" ".join(b.split()) for b in found if b.strip())


def test_known_main_texts():
    say = lambda x, n=3: "".join(f"<p>{x}{k} is a sentence, with some words, that goes on for a while so that it is read as text, and ends.</p>" for k in range(n))
    text = lambda *xs: " ".join(f"{x}{k} is a sentence, with some words, that goes on for a while so that it is read as text, and ends." for x in xs for k in range(3))
    menu = "<ul class=menu><li><a href=1>Home</a><li><a href=2>News</a></ul>"
    foot = "<div class=footer>Copyright, all rights reserved</div>"
    aside = "<div class=sidebar><a href=3>One more, and more</a> <a href=4>and another link, to follow</a></div>"
    nested = "".join(f"<div><div>{say(x)}</div></div>" for x in "ABC")
    rows = "".join(f"<div class=row><div class=col><div class=content>{say(x)}</div></div></div>" for x in "ABC")
    thread = f"<div class=comments>{say('R', 9)}</div>"
    assert html_text.main_text(f"<body>{nested}</body>") == text("A", "B", "C")
    assert html_text.main_text(f"<body>{menu}<div>{rows}</div>{aside}{foot}</body>") == text("A", "B", "C")
    assert html_text.main_text(f"<body>{menu}<article>{say('A')}</article>{thread}{foot}</body>") == text("A")
    assert html_text.main_text(f"<body><main><section>{say('A')}</section><div><div>{say('B')}</div></div></main>{aside}</body>") == text("A", "B")


@pytest.mark.parametrize("html", ["<b>" * 20_000 + "some text" + "</i>" * 20_000, "<p><table>" + "<b>" * 20_000 + "<div></div>" * 20_000, "".join(f"<div>{'word, ' * 10}" for _ in range(20_000))])
def test_nesting_takes_linear_time(html):
    began = time.process_time()
    html_text.main_text(html)
    assert time.process_time() - began < 5


def test_html_query_is_brute_force(spark, tmp_path):
    rng = random.Random(11)
    trees = []
    for _ in range(400):
        root = Node("#root")
        root.kids = [Node("body", root)]
        grow(rng, root.kids[0], 5)
        trees.append(root)
    want = [brute_main_text(t) for t in trees]
    assert sum(map(bool, want)) > 200
    html = [t.html() for t in trees]
    ids = [*range(400), 7, None, 401]
    put(tmp_path, "pages", page_id=pa.array(ids, pa.int64()), url=pa.array(["u"] * 403), html=pa.array([*html, html[7], "", None]))
    got = {}
    for r in html_text.op3_html_text(spark, str(tmp_path)).collect():
        assert r["n_chars"] == len(r["text"])
        got.setdefault(r["page_id"], []).append(r["text"])
    assert got == {**{i: [t] for i, t in enumerate(want)}, 7: [want[7]] * 2, None: [""], 401: [""]}
    put(tmp_path, "pages", page_id=pa.array([], pa.int64()), url=pa.array([], pa.string()), html=pa.array([], pa.string()))
    assert html_text.op3_html_text(spark, str(tmp_path)).count() == 0


# --- Toxicity and languages -----------------------------------------------------------------------------------------


def made_up(n, seed):
    """(text, lang, toxic) of ``n`` documents, with repeats, nulls and texts without letters."""
    rng = random.Random(seed)
    sounds = {"aa": "tion ing the and of", "bb": "ich ein und sch keit", "cc": "que ción de la os"}
    rows = []
    for _ in range(n):
        lang = rng.choice(list(sounds))
        words = ["".join(rng.choice(sounds[lang].split()) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(3, 40))]
        toxic = rng.random() < 0.25
        if toxic:
            words.insert(rng.randrange(len(words)), rng.choice(["idiot", "morons", "moronic"]))
        cut = rng.randrange(len(words))
        rows.append((" ".join(words[:cut]).capitalize() + ". " + " ".join(words[cut:]) + "!", lang, int(toxic)))
    rows += [rows[0]] * 3 + [(None, "aa", 0), ("", "bb", 1), ("12 !? 3", "cc", 0), ("漢", None, 0), (rows[1][0] * 60, rows[1][1], rows[1][2])]
    return rows


def documents(folder, rows):
    ids = pa.array([*range(len(rows)), None], pa.int64())
    put(folder, "documents", doc_id=ids, text=pa.array([*(r[0] for r in rows), rows[2][0]]), lang=pa.array([*(r[1] for r in rows), None]), score=ids)
    put(folder, "labels", doc_id=ids, quality=ids, toxic=pa.array([*(r[2] for r in rows), 1]))


def slots_of(word):
    names = [f"w{word}", *(f"{n}{word[:n]}" for n in (4, 5, 6) if len(word) >= n)]
    return [zlib.crc32(x.encode()) % toxicity.SLOTS for x in names]


def sentences_of(text):
    """The slots of each sentence."""
    lower = (text or "").lower()
    return [[s for w in toxicity.WORD.findall(x) for s in slots_of(w)] for x in toxicity.SENTENCE.findall(lower)]


def sigmoid(z):
    return 1 / (1 + math.exp(-z))


def brute_model(rows):
    """Bias and weights by plain loops over (text, label) rows."""
    docs = [(sentences_of(t), y) for t, y in rows]
    n = [sum(y == k for _, y in docs) for k in (0, 1)]
    have = {}
    for sentences, y in docs:
        for s in {s for x in sentences for s in x}:
            have.setdefault(s, [0, 0])[y] += 1
    w = {}
    for s, (clean, toxic) in have.items():
        odds = math.log((toxic + 0.5) / (n[1] + 1)) - math.log((clean + 0.5) / (n[0] + 1))
        if clean + toxic >= toxicity.LEAST_DOCS and abs(odds) / math.sqrt(1 / (toxic + 0.5) + 1 / (clean + 0.5)) >= toxicity.LEAST_Z:
            w[s] = 0.3 * min(5, max(-5, odds))
    docs = [([[s for s in x if s in w] for x in sentences], y) for sentences, y in docs]
    w["bias"] = -6.0
    m, v = dict.fromkeys(w, 0.0), dict.fromkeys(w, 0.0)
    for t in range(1, toxicity.ROUNDS + 1):
        slope = dict.fromkeys(w, 0.0)
        for sentences, y in docs:
            p = [sigmoid(w["bias"] + sum(w[s] for s in x)) for x in sentences]
            none = math.prod(1 - q for q in p)
            for x, q in zip(sentences, p, strict=True):
                d = q * none / (1 - none) if y else -q
                for s in (*x, "bias"):
                    slope[s] += d / len(docs)
        for s, d in slope.items():
            d -= 0 if s == "bias" else toxicity.PENALTY * w[s]
            m[s], v[s] = 0.9 * m[s] + 0.1 * d, 0.999 * v[s] + 0.001 * d * d
            w[s] += toxicity.STEP * (m[s] / (1 - 0.9**t)) / (math.sqrt(v[s] / (1 - 0.999**t)) + 1e-8)
        w["bias"] = min(w["bias"], -3.0)
    return w.pop("bias"), w


def test_toxicity_query_is_brute_force(spark, tmp_path):
    rows = made_up(500, 21)
    documents(tmp_path, rows)
    outside = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    bias, w = brute_model([(r[0], r[2]) for i, r in enumerate(rows) if not outside(i)])
    assert len(w) > 3
    got = toxicity.op7_toxicity(spark, str(tmp_path)).collect()
    assert len(got) == len(rows) + 1
    for r in got:
        text = rows[2 if r["doc_id"] is None else r["doc_id"]][0]
        want = 1 - math.prod(1 - sigmoid(bias + sum(w.get(s, 0.0) for s in x)) for x in sentences_of(text))
        assert abs(r["score"] - want) < 1e-4
        assert r["predicted"] == int(r["score"] >= 0.7)
        assert r["held_out"] == (r["doc_id"] is not None and outside(r["doc_id"]))
    assert 60 < sum(r["predicted"] for r in got) < 200
    documents(tmp_path, rows[:3])
    assert toxicity.op7_toxicity(spark, str(tmp_path)).count() == 4


def grams_of(text):
    raw = b" " + bytes(b if b > 127 or chr(b).isalpha() else 32 for b in (text or "").lower().encode()) + b" "
    while b"  " in raw:
        raw = raw.replace(b"  ", b" ")
    return [raw[i : i + n] for n in (3, 4) for i in range(len(raw) - n + 1)]


def brute_filters(rows):
    """For each language its n-grams, and the most frequent language, by plain loops over (text, lang) rows."""
    counts = {}
    for text, lang in rows:
        for g in grams_of(text):
            counts.setdefault(lang, {}).setdefault(g, 0)
            counts[lang][g] += 1
    total = {k: sum(c.values()) for k, c in counts.items()}
    share = {k: {g: n / total[k] for g, n in c.items()} for k, c in counts.items()}
    most = {}
    for c in share.values():
        for g, x in c.items():
            most[g] = max(x, most.get(g, 0.0))
    held = {k: {g for g, x in c.items() if most[g] >= language_id.LEAST_SHARE and x >= language_id.NEAR * most[g]} for k, c in share.items()}
    return held, max(total, key=lambda k: (total[k], k))


def slots_of_gram(g):
    """The filter's slots of an n-gram, by integer arithmetic on its own."""
    return {int(s[0]) for s in language_id._slots_of(language_id.np.array([int.from_bytes(g, "little")], dtype="u4"))}


def test_language_query_is_brute_force(spark, tmp_path):
    rows = made_up(160, 22)
    documents(tmp_path, rows)
    outside = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    held, common = brute_filters([r[:2] for i, r in enumerate(rows) if r[1] and not outside(i)])
    slots = {g: slots_of_gram(g) for g in {g for r in rows for g in grams_of(r[0])}}
    bits = {k: set().union(*(slots[g] for g in own)) for k, own in held.items()}
    chance = {k: (len(b) / language_id.SLOTS) ** language_id.LOOKUPS for k, b in bits.items()}
    got = language_id.op9_language_id(spark, str(tmp_path)).collect()
    assert len(got) == len(rows) + 1
    for r in got:
        text = rows[2 if r["doc_id"] is None else r["doc_id"]][0]
        assert r["held_out"] == (r["doc_id"] is not None and outside(r["doc_id"]))
        if not any(c.isalpha() for c in text or ""):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        found = grams_of(text)
        counts = {k: max(0.0, (sum(slots[g] <= bits[k] for g in found) - len(found) * chance[k]) / (1 - chance[k])) for k in sorted(held)}
        top, second = sorted(counts.values(), reverse=True)[:2]
        assert r["lang_pred"] == (max(counts, key=counts.get) if top else common)
        assert abs(r["score"] - (top / (top + second) if top else 0.0)) < 1e-9
        exact = {k: sum(g in own for g in found) for k, own in held.items()}
        assert not top or abs(top - max(exact.values())) < 0.02 * len(found)
