"""Extraction, tokens, shards, fixity, language and toxicity."""

import hashlib
import random
import unicodedata
import zlib

import numpy as np
import pyarrow.fs
import pytest
from pyspark.sql import functions as F

from lodestone.llm import bpe, html_text, language_id, token_shards, toxicity, warc_fixity

tokenizers = pytest.importorskip("tokenizers")


def texts(seed, n=60):
    rng = random.Random(seed)
    bits = ["the", " ", "  ", "\n", "'s", "'LL", "É", "Σ", "ΑΣ", "İ", "1", "²", "\x85", " ", "\x1c", "漢字", "é", "<|endoftext|>", "...", "ab", "\U0001f600", "Ж", "ﬁ"]
    return [None, "", "   ", "a" * 9000, "ab" * 3000 + "!" * 5000] + ["".join(rng.choice(bits) for _ in range(rng.randrange(60))) for _ in range(n)]


def docs_of(spark, values):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(values)], "doc_id long, text string, ids string")


def test_bpe_is_the_library(spark):
    library = tokenizers.Tokenizer.from_file(bpe.default_path())
    values = texts(1)
    got = {r["doc_id"]: r for r in bpe.encode_decode(docs_of(spark, values), bpe.default_path()).collect()}
    short = {r["doc_id"]: r for r in bpe.encoded_digests(docs_of(spark, values), bpe.default_path()).collect()}
    for i, t in enumerate(values):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert np.frombuffer(bytes(got[i]["ids"]), "<u4").tolist() == ids
        assert got[i]["decoded"] == library.decode(ids, skip_special_tokens=False)
        assert (short[i]["n_tokens"], short[i]["ids_sha256"]) == (len(ids), hashlib.sha256(got[i]["ids"]).hexdigest())
        assert short[i]["decoded_sha256"] == hashlib.sha256(got[i]["decoded"].encode()).hexdigest()
    assert bpe.encode_decode(docs_of(spark, []), bpe.default_path()).count() == 0


def test_bpe_composes_and_orders_marks_as_the_library():
    library = tokenizers.Tokenizer.from_file(bpe.default_path())
    t = bpe.transducer(bpe.default_path())
    marks = [c for c in map(chr, [*range(0x300, 0xD800), *range(0xE000, 0x110000)]) if unicodedata.combining(c)]
    whole = [c for c in map(chr, [*range(0x80, 0xD800), *range(0xE000, 0x110000)]) if unicodedata.decomposition(c)[:1] not in ("", "<")]
    tries = ["a\u0315\u08d3", "\U00011935\U00011930", *(f"a\u0315{m}\u0327 {m}b" for m in marks), *(f"{c} {unicodedata.normalize('NFD', c)}\u0301" for c in whole[::3])]
    rng = random.Random(3)
    tries += ["".join(rng.choice([rng.choice(marks), rng.choice(whole), rng.choice("ae1 ."), unicodedata.normalize("NFD", rng.choice(whole))]) for _ in range(9)) for _ in range(2000)]
    for text in tries:
        assert np.frombuffer(b"".join(t.encode(text)), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_bpe_streams_with_small_windows(monkeypatch):
    library = tokenizers.Tokenizer.from_file(bpe.default_path())
    t = bpe.Transducer(bpe.default_path())
    vocabulary = [k.removesuffix("</w>") for k in t.merges.vocab]
    rng = random.Random(9)
    for block, read in ((1, 5), (64, 100)):
        monkeypatch.setattr(bpe, "BLOCK", block)
        monkeypatch.setattr(bpe, "READ", read)
        for _ in range(4):
            word = "".join(c for c in "".join(rng.choice(vocabulary) for _ in range(1500)) if c.isascii() and c.isalpha())
            t.ids.clear()
            ids = np.frombuffer(b"".join(t.encode(word)), "<u4").tolist()
            assert ids == library.encode(word, add_special_tokens=False).ids


def test_decoder_holds_back_unfinished_characters():
    data = "añ漢\U0001f600b".encode()
    for step in (1, 2, 3, 5):
        assert "".join(bpe.decode_bytes(data[i : i + step] for i in range(0, len(data), step))) == data.decode()
    assert "".join(bpe.decode_bytes([b"a", b"\xe6\xbc"])) == "a�"
    t = bpe.transducer(bpe.default_path())
    ids = np.frombuffer(b"".join(t.encode("Crème 漢 brûlée")), "<u4").tolist()
    assert "".join(t.text_of(ids)).split() == ["crème", "漢", "brûlée"]


def test_shards(spark):
    library = tokenizers.Tokenizer.from_file(token_shards.default_path())
    values = texts(2)
    frame = docs_of(spark, values).withColumn("doc_id", F.col("doc_id") * 5 - 100)
    manifest = token_shards.write_shards(frame, token_shards.default_path(), block=200, shard=3000)
    assert manifest.count() > 4  # more shards than partitions
    got = token_shards.read_shards(manifest).orderBy("doc_id").collect()
    start = 0
    for i, (t, r) in enumerate(zip(values, got, strict=True)):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        assert (r["doc_id"], r["start"], r["n_tokens"]) == (i * 5 - 100, start, len(ids))
        assert np.frombuffer(bytes(r["ids"]), "<u4").tolist() == ids
        start += len(ids)
    shard = token_shards.ShardReader(manifest.orderBy("part", "seq").first()["path"])
    keys = [token_shards.id_of(k) for k, _ in shard.entries()]
    assert keys == sorted(keys)
    assert all(shard.get(k) is not None for k in keys)
    assert all(shard.get(k + 1) is None for k in keys)
    assert token_shards.write_shards(frame.limit(0), token_shards.default_path()).count() == 0


def test_shards_with_null_and_repeated_ids(spark):
    frame = spark.createDataFrame([(None, "a"), (3, "b b"), (3, "b"), (-1, None)], "doc_id long, text string")
    got = [(r["doc_id"], r["start"], r["n_tokens"]) for r in token_shards.read_shards(token_shards.write_shards(frame, token_shards.default_path())).orderBy("start").collect()]
    assert got == [(None, 0, 2), (-1, 2, 1), (3, 3, 2), (3, 5, 3)]


def test_shards_look_up(spark, monkeypatch):
    rows = [(3 * i - 90, f"text {i} " * (i % 5)) for i in range(200)] + [(None, "none"), (30, "again"), (-(1 << 63), "least"), ((1 << 63) - 1, "most")] + [(60, f"many {i:03d}") for i in range(80)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    manifest = token_shards.write_shards(frame, token_shards.default_path(), block=40, shard=100)
    assert manifest.count() > 20
    first = {}
    for r in token_shards.read_shards(manifest).orderBy("start").collect():
        first.setdefault(r["doc_id"], (r["n_tokens"], bytes(r["ids"])))
    ids = [None, 0, 0, 1, 30, 60, 61, -90, -91, 507, 508, 10**12, -(10**12), -(1 << 63), (1 << 63) - 1, *range(90, 300)]
    asked = spark.createDataFrame([(i, "x") for i in ids], "doc_id long, path string")
    for ranges in (1000, 3):
        monkeypatch.setattr(token_shards, "RANGES", ranges)
        got = token_shards.look_up(manifest, asked).collect()
        assert len(got) == len({r["doc_id"] for r in got})
        assert {r["doc_id"]: (r["n_tokens"], bytes(r["ids"])) for r in got} == {i: first[i] for i in ids if i in first}
    assert token_shards.look_up(manifest.limit(0), asked).count() == 0
    assert token_shards.look_up(manifest, asked.limit(0)).count() == 0


PAGES = {
    "<html><head><title>T</title><style>p{}</style><script>var a='</p>'</script></head><body><nav><a href=/>Home</a></nav><div class=ad>Buy, buy, buy now, it is cheap.</div>"
    "<article><h1>A title</h1><p><b>Bold start<br>next<p>Second &amp; third,\n with&nbsp;space.</p></article><footer>c</footer>": "A title Bold start next Second & third, with space.",
    "<body><header><h1>Site</h1></header><div id=sidebar><p>Side text, long enough, with commas, to count.</p></div><div id=content><h2>Head</h2><p>One, two, three words in a paragraph.</p>"
    "<form><p>Subscribe, please, today.</p></form><div class='comments'><p>Great, thanks, for, all, this, and more.</p></div></div></body>": "Head One, two, three words in a paragraph.",
    "plain words": "plain words",
    "<p>cut off <b>he": "cut off he",
    "": "",
}


def test_html(spark):
    rows = [(i, "u", h) for i, h in enumerate(PAGES)] + [(99, None, None)]
    got = {r["page_id"]: r["text"] for r in html_text.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string"), ["page_id", "url"]).collect()}
    assert got == {**dict(enumerate(PAGES.values())), 99: ""}
    deep = "<div>" * 5000 + "<p>deep, text" + "</div>" * 5000
    assert html_text.main_text(deep) == "deep, text"


def test_html_names_alone_remove_nothing():
    text = "<h1>Head</h1><p>One, two, three words in a paragraph that is long enough to count.</p><p>And another, with a comma, and more words.</p>"
    want = "Head One, two, three words in a paragraph that is long enough to count. And another, with a comma, and more words."
    side = "<div class=sidebar><p>Side text, short.</p></div><ul class=menu><li><a href=/>Home</a></ul>"
    for wrap in ("div class='content has-sidebar'", "div id=main class=no-sidebar", "div class=page-header-fixed", "div class=has-comments", "form id=aspnetForm", "dialog open"):
        tag = wrap.split()[0]
        assert html_text.main_text(f"<body><{wrap}>{side}{text}</{tag}></body>") == want
    article = f"<body><div class='overlay'><article>{text}</article></div><div class=comments><p>Yes, no, yes, no, yes, no, yes, no, yes, no, yes, no, yes.</p></div></body>"
    assert html_text.main_text(article) == want
    assert html_text.main_text(f"<body><div id=content>{text}<div class=post-comments><p>Great, thanks.</p></div><form><p>Your mail, please.</p></form></div></body>") == want
    assert html_text.main_text("<p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>x=1</annotation></math> be true, for now.</p>") == "Let x=1 be true, for now."


def test_warc(spark, monkeypatch):
    monkeypatch.setattr(warc_fixity, "FILE", 2000)
    rows = [(i, f"http://x/{i}", f"<p>{i * 'word '}</p>") for i in range(150)] + [(None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    index = warc_fixity.write_warc(pages)
    clean = warc_fixity.replicate(index)
    harmed = warc_fixity.replicate(index, F.col("page_id").isin(3, 77, 149))
    own = index.select("part", "seq", "path").distinct()
    got = warc_fixity.audit(index, [own, clean, harmed]).collect()
    assert len(got) == 151
    assert {r["page_id"]: r["bad_replicas"] for r in got if not r["intact"]} == {3: [2], 77: [2], 149: [2]}
    for r in got:
        want = next(x for x in rows if x[0] == r["page_id"])
        assert r["sha256"] == hashlib.sha256(warc_fixity.record(*want)).hexdigest()
    path = index.where("page_id = 5").first()
    fs, where = pyarrow.fs.FileSystem.from_uri(path["path"])
    assert warc_fixity.sound(fs.open_input_file(where).read_at(path["size"], path["at"]))
    assert warc_fixity.audit(warc_fixity.write_warc(pages.limit(0)), [own.limit(0), own.limit(0)]).count() == 0


def tree_root(leaves):
    """The root over leaf hashes, by plain Python."""
    while len(leaves) > 1:
        groups = [leaves[i : i + warc_fixity.FAN] for i in range(0, len(leaves), warc_fixity.FAN)]
        leaves = [hashlib.sha256("".join("-" if x is None else x.hex().upper() for x in g).encode()).digest() for g in groups]
    return leaves[0]


def test_warc_finds_lost_cut_and_longer_files(spark, monkeypatch):
    monkeypatch.setattr(warc_fixity, "FILE", 2000)
    rows = [(i, f"http://x/{i}", f"<p>{i * 'word '}</p>") for i in range(120)] + [(7, "http://x/7", "<p>again</p>")] * 2
    index = warc_fixity.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string"))
    own = index.select("part", "seq", "path").distinct()
    listed = sorted((r.asDict() for r in index.collect()), key=lambda r: r["leaf"])
    files = {}
    for r in listed:
        files.setdefault((r["part"], r["seq"]), []).append(r)
    leaves = []
    for r in listed:
        fs, where = pyarrow.fs.FileSystem.from_uri(r["path"])
        have = fs.open_input_file(where)
        length = have.size() if r is files[r["part"], r["seq"]][-1] else None
        leaves.append(warc_fixity.leaf_hash(r["at"], r["size"], have.read_at(r["size"], r["at"]), length))
    assert bytes(warc_fixity.merkle(index, own)[-1].first()["hash"]) == tree_root(leaves)
    copies = {(r["part"], r["seq"]): r["path"] for r in warc_fixity.replicate(index).collect()}
    names = sorted(copies)
    lost, short, longer, unlisted = names[0], names[1], names[2], names[-1]
    for key, change in ((lost, None), (short, lambda d: d[:-3]), (longer, lambda d: d + b"x")):
        fs, where = pyarrow.fs.FileSystem.from_uri(copies[key])
        data = fs.open_input_file(where).read()
        fs.delete_file(where)
        if change:
            with fs.open_output_stream(where, compression=None) as put:
                put.write(change(data))
    other = spark.createDataFrame([(*k, p) for k, p in copies.items() if k != unlisted], "part long, seq long, path string")
    want = {r["leaf"] for k in (lost, unlisted) for r in files[k]} | {files[short][-1]["leaf"], files[longer][-1]["leaf"]}
    got = warc_fixity.audit(index, [own, other]).collect()
    assert {r["leaf"]: r["bad_replicas"] for r in got if not r["intact"]} == dict.fromkeys(want, [1])
    alone = warc_fixity.audit(index, [other]).collect()
    assert len(alone) == len(rows)
    assert {r["leaf"]: r["bad_replicas"] for r in alone if not r["intact"]} == dict.fromkeys(want, [0])
    both = warc_fixity.audit(index, [other, other]).collect()
    lost_in_both = {r["leaf"] for k in (lost, unlisted) for r in files[k]} | {files[short][-1]["leaf"]}
    assert {r["leaf"]: r["bad_replicas"] for r in both if not r["intact"]} == dict.fromkeys(lost_in_both, [0, 1])


def test_bpe_cuts_long_texts_without_white_space_at_word_ends(monkeypatch):
    library = tokenizers.Tokenizer.from_file(bpe.default_path())
    rng = random.Random(4)
    t = bpe.Transducer(bpe.default_path())
    long = ["".join(rng.choice("abcXYZ0189+/='é漢\u0301") for _ in range(n)) for n in (300, 3000)]
    long += ["ab1" * 400_000, "\t".join(["word's"] * 5000), "漢" * 3000, "it's5're" * 500]
    for read in (7, 100, 1 << 16):
        monkeypatch.setattr(bpe, "READ", read)
        for text in long if read > 100 else [*long[:2], *long[3:]]:
            ids = library.encode(text, add_special_tokens=False).ids
            pieces = list(t.encode(text))
            assert np.frombuffer(b"".join(pieces), "<u4").tolist() == ids
            assert "".join(t.decode(pieces)) == library.decode(ids, skip_special_tokens=False)


def test_stages_with_clashing_columns_and_nothing_learned(spark):
    kinds = "doc_id long, text string, lang string, score double, lang_pred string, _text string, row int, number int, ids string, n_tokens long, decoded string"
    rows = [(i, t, None, 0.5, "p", "q", 1, 2, "i", 7, "d") for i, t in enumerate(["some words here", None, "12 !", "é", "some words here"])] + [(None, "a b", None, *[None] * 8)]
    docs = spark.createDataFrame(rows, kinds)
    kept = language_id.stage(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(r["text"] for r in kept.collect()) == ["a b", "some words here", "some words here", "é"]
    learned = language_id.stage(spark, docs.withColumn("lang", F.lit("xx")), "")
    assert sorted(map(tuple, learned.drop("lang").collect()), key=str) == sorted(map(tuple, kept.drop("lang").collect()), key=str)
    out = bpe.stage(spark, docs, "")
    assert out.columns == ["doc_id", "lang", "score", "lang_pred", "_text", "row", "number", "decoded", "n_tokens", "ids", "ids_sha256", "decoded_sha256"]
    library = tokenizers.Tokenizer.from_file(bpe.default_path())
    want = sorted(len(library.encode(r[1] or "", add_special_tokens=False).ids) for r in rows)
    assert sorted(r["n_tokens"] for r in out.collect()) == want
    assert language_id.predict(docs, language_id.learn(docs), []).columns == ["lang_pred", "score"]
    for stage in (language_id.stage, bpe.stage):
        assert stage(spark, docs.limit(0), "").count() == 0


def test_more_languages_than_bits_in_a_word(spark):
    letters = [chr(0x4E00 + 50 * k) for k in range(70)]
    rows = [(f"l{k:02d}", "".join(chr(ord(c) + j % 9) for j in range(40))) for k, c in enumerate(letters)]
    docs = spark.createDataFrame([(i, t, n) for i, (n, t) in enumerate(rows)], "doc_id long, text string, lang string")
    filters = language_id.learn(docs)
    assert len(filters.langs) == 70
    assert filters.table.shape[0] == 2
    assert all(r["lang"] == r["lang_pred"] for r in language_id.predict(docs, filters, ["lang"]).collect())


def labelled(n, seed):
    rng = random.Random(seed)
    sounds = {"aa": "tion ing the and of", "bb": "ich ein und sch keit", "cc": "que ción de la os"}
    rows = []
    for i in range(n):
        lang = rng.choice(list(sounds))
        words = ["".join(rng.choice(sounds[lang].split()) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(3, 40))]
        toxic = rng.random() < 0.2
        if toxic:
            words.insert(rng.randrange(len(words)), rng.choice(["idiot", "morons", "moronic"]))
        rows.append((i, " ".join(words).capitalize() + ". Ende.", lang, int(toxic)))
    return rows


def test_language(spark):
    frame = spark.createDataFrame([(*r[:3], 0) for r in labelled(400, 3)] + [(1000, None, None, 0), (1001, "12 !", "aa", 0), (1002, "", None, 0)], "doc_id long, text string, lang string, score long")
    rows = frame.select("doc_id", "text", "lang", language_id.held_out().alias("held_out"))
    got = language_id.predict(rows, language_id.learn(rows.where("NOT held_out")), ["doc_id", "lang", "held_out"]).collect()
    judged = [r for r in got if r["doc_id"] < 1000 and r["held_out"]]
    assert len(judged) > 40
    assert sum(r["lang"] == r["lang_pred"] for r in judged) / len(judged) > 0.97
    assert all(r["lang_pred"] == "und" and r["score"] == 0 for r in got if r["doc_id"] >= 1000)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert all(0 <= r["score"] <= 1 for r in got)
    nothing = language_id.predict(rows, language_id.learn(rows.limit(0)), ["doc_id"])
    assert {r["lang_pred"] for r in nothing.collect()} == {"und"}


def test_toxicity(spark):
    rows = labelled(600, 4)
    docs = spark.createDataFrame([(r[0], r[1]) for r in rows] + [(5000, None), (5001, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], 1, r[3]) for r in rows], "doc_id long, quality int, toxic int")
    model = toxicity.learn(docs, labels.where(~toxicity.held_out()))
    got = toxicity.scored(docs.withColumn("held_out", toxicity.held_out()), model, ["doc_id", "held_out"]).collect()
    truth = {r[0]: r[3] for r in rows}
    judged = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in judged) / len(judged) > 0.97
    assert all(r["score"] == 0 for r in got if r["doc_id"] >= 5000)
    spans = [(r, s) for r in got for s in r["sentences"] if r["predicted"]]
    texts_of = {r[0]: r[1] for r in rows}
    assert spans
    assert all(any(w in texts_of[r["doc_id"]][s["start"] : s["end"]].lower() for w in ("idiot", "moron")) for r, s in spans)
    blank = toxicity.learn(docs, labels.limit(0))
    assert toxicity.scored(docs, blank, ["doc_id"]).where("predicted = 1").count() == 0


def test_toxicity_keeps_the_share_of_toxic_documents(spark):
    # "odd" is in all 100 toxic documents and in about 230 of 1,900 clean ones: three of ten such documents are toxic.
    rows = [(i, "Some plain words. Odd." if i < 330 else "Some plain words. Even.", int(i < 100)) for i in range(2000)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    for most in (100, 5000):
        got = {r["doc_id"]: r for r in toxicity.scored(docs, toxicity.learn(docs, labels, most=most), ["doc_id"]).collect()}
        assert 0.15 < got[0]["score"] < 0.5
        assert got[0]["predicted"] == 0


def test_toxicity_fit_weighs_rows():
    rng = np.random.default_rng(5)
    slots = [np.array([*rng.integers(0, 4, rng.integers(1, 4)), -1]) for _ in range(30)]
    labels, stands, start = rng.integers(0, 2, 30), rng.integers(1, 5, 30), dict.fromkeys(range(4), 0.1)
    again = np.repeat(np.arange(30), stands)
    b, w = toxicity.fit(labels, slots, start, stands)
    b2, w2 = toxicity.fit(labels[again], [slots[i] for i in again], start)
    assert np.allclose([b, *w.values()], [b2, *w2.values()], atol=1e-4)
