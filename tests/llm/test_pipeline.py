"""The pipeline against a brute-force version on a small table."""

import hashlib
import random

import pytest

from .test_pairs_and_windows import hits, near

tokenizers = pytest.importorskip("tokenizers")


def test_pipeline(spark, tmp_path):
    import corpus_pipeline
    from lodestone.llm import bpe

    rng = random.Random(1)
    word = lambda: "".join(rng.choice(["the", "ing", "and", "tion", "er"]) for _ in range(rng.randrange(1, 4)))
    texts = [" ".join(word() for _ in range(rng.randrange(5, 80))) for _ in range(40)]
    items = [(i, " ".join(word() for _ in range(15))) for i in range(3)]
    near_copy = texts[5].split()
    near_copy[0] = "changed"
    texts += [texts[3], texts[3], " ".join(near_copy), "x " + items[1][1] + " y", "123 !!", "", None]
    rows = [(i, t, "en" if i % 7 else None, "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = [r for r in rows if r[1] and any(c.isalpha() for c in r[1])]
    kept = list({r[1]: r for r in kept}.values())  # of equal texts the last one
    _, comp = near(kept, 5, 80)
    kept = [r for r in kept if comp[r[0]] == r[0]]
    bad = hits(kept, items)
    kept = [r for r in kept if not bad[r[0]][1]]
    library = tokenizers.Tokenizer.from_file(bpe.default_path())
    want = {r[0]: (r[2], len(ids), hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()) for r in kept for ids in [library.encode(r[1], add_special_tokens=False).ids]}
    got = {r["doc_id"]: (r["lang"], r["n_tokens"], r["ids_sha256"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == want
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "jaccard_join", "decontaminate", "bpe"]


def test_pipeline_with_null_and_repeated_ids(spark, tmp_path):
    import corpus_pipeline
    from lodestone.llm import bpe

    rng = random.Random(2)
    word = lambda: "".join(rng.choice(["the", "ing", "and", "tion", "er"]) for _ in range(rng.randrange(1, 4)))
    texts = [" ".join(word() for _ in range(rng.randrange(20, 60))) for _ in range(18)]
    items = [(i, " ".join(word() for _ in range(15))) for i in range(2)]
    leak = [f"{word()} {text} {word()}" for _, text in items]
    rows = [(i, t) for i, t in enumerate(texts[:15])]
    rows += [(None, texts[15]), (None, texts[16]), (None, texts[3]), (None, leak[0]), (7, texts[9]), (11, leak[1]), (12, texts[12]), (None, ""), (2, None)]
    full = [(i, t, "en", "s", len(t or "")) for i, t in rows]
    spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = [r for r in rows if r[1]]
    last = {}
    for i, t in kept:
        last[t] = max(last.get(t, -1), -1 if i is None else i)
    kept = [(i, t) for i, t in kept if last[t] == (-1 if i is None else i)]
    own = hits(list(enumerate(t for _, t in kept)), items)
    kept = [r for n, r in enumerate(kept) if not own[n][1]]
    assert [i for i, _ in kept] == [*range(15), None, None, 12]
    library = tokenizers.Tokenizer.from_file(bpe.default_path())
    digest = lambda t: hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in library.encode(t, add_special_tokens=False).ids)).hexdigest()
    got = [(r["doc_id"], r["ids_sha256"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted([(i, digest(t)) for i, t in kept], key=str)
