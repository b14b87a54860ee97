"""Benchmark decontamination by winnowing, in DataFrame functions only.

The hash of every ``GRAM`` consecutive words is taken, and of every ``SPAN``
consecutive hashes the least is kept.  ``SPAN + GRAM - 1`` words always hold
one kept hash, and two equal runs of that length keep the same one, so joining
the kept hashes of documents and benchmark misses no shared window.  What the
join finds is then extended: the windows that a shared hash stands for are
compared word by word.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import staged

#: Words of a window, words of a hashed gram, and grams of which the least hash is kept.
WINDOW, GRAM = 10, 5
SPAN = WINDOW - GRAM + 1
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What lies between words: every ASCII character but digits and letters.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once a row however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """The words of ``text``; only A-Z are lower-cased."""
    text = F.coalesce(text, F.lit(""))
    plain = F.octet_length(text) == F.char_length(text)
    return F.array_remove(F.split(F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER)), BETWEEN), "")


def count_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _starts(n: Column, length: int, body: Callable[[Column], Column], kind: str) -> Column:
    """``body`` at each position where ``length`` items of ``n`` begin."""
    return F.when(n >= length, F.transform(F.sequence(F.lit(0), n - length), body)).otherwise(F.expr(f"cast(array() as {kind})"))


def kept_hashes(w: Column) -> Column:
    """For the window that begins at each word, the least hash of its grams."""

    def of(h: Column) -> Column:
        grams = _starts(F.size(h), GRAM, lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(GRAM)]), "array<bigint>")
        return let(grams, lambda g: _starts(F.size(g), SPAN, lambda i: F.least(*[F.get(g, i + j) for j in range(SPAN)]), "array<bigint>"))

    return let(F.transform(w, lambda x: F.xxhash64(x)), of)


def _short_hashes(w: Column, m: int) -> Column:
    """The hash of every ``m`` consecutive words, for items of fewer words than a window."""
    return _starts(F.size(w), m, lambda i: F.xxhash64(F.lit(m), F.slice(w, i + 1, m)), "array<bigint>")


def _windows(w: Column, length: int, hashes: Column, wanted: Column | None) -> Column:
    """(at, length, words) of the windows, of those with a wanted hash if such are given."""
    kind = "array<struct<at:int,length:int,words:string>>"
    cut = lambda i: F.struct(i.cast("int").alias("at"), F.lit(length).alias("length"), F.array_join(F.slice(w, i + 1, length), " ").alias("words"))

    def of(h: Column) -> Column:
        at = _starts(F.size(h), 1, lambda i: i, "array<int>")
        at = at if wanted is None else F.filter(at, lambda i: F.array_contains(wanted, F.get(h, i)))
        return F.transform(at, cut)

    return F.coalesce(let(hashes, of), F.expr(f"cast(array() as {kind})"))


def contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``n_words``, ``n_hit``, ``hits`` and ``items``.

    A window is ten consecutive words of an item; an item of fewer words is one
    window.  ``hits`` lists the windows found (first word and length), sorted;
    ``n_hit`` counts the words inside any of them; ``items`` lists the items
    with such a window, as strings in their order.

    Null and empty texts have no words and no hits, on either side.  Rows that
    repeat an id are judged by their own texts.  Null ids are allowed in
    ``docs``; items with a null id count under no name.  An empty table of
    documents gives an empty result, an empty benchmark no hits.  Other columns
    are not read.  Texts of any length are looked through whole, as one row.
    """
    return _judged(docs, benchmark, text, doc_id, item_id, item_text).drop("text_hash")


def _text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _judged(docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """What :func:`contaminated` gives, with the ``text_hash`` that tells rows of one id apart."""
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("text_hash", _text_hash(F.col("text")))
    items = benchmark.select(F.col(item_id).cast("string").alias("item_id"), words(F.col(item_text)).alias("w"))
    items = staged(items.where("size(w) > 0"), "items")
    short = sorted(r["n"] for r in items.where(F.size("w") < WINDOW).select(F.size("w").alias("n")).distinct().collect())  # at most nine numbers

    def hashes(w: Column) -> Column:
        return F.array_distinct(F.concat(kept_hashes(w), *[_short_hashes(w, m) for m in short]))

    def cut(w: Column, wanted: Column | None) -> Column:
        return F.concat(_windows(w, WINDOW, kept_hashes(w), wanted), *[_windows(w, m, _short_hashes(w, m), wanted) for m in short])

    own = lambda w: F.filter(cut(w, None), lambda x: x["length"] == F.least(F.size(w), F.lit(WINDOW)))
    of_items = staged(items.select(F.explode(hashes(F.col("w"))).alias("hash")).distinct(), "item-hashes")
    item_windows = staged(items.select("item_id", F.explode(own(F.col("w"))).alias("x")).select("item_id", "x.length", "x.words").distinct(), "item-windows")
    # Which kept hashes of a document the benchmark has too.
    met = docs.select("doc_id", "text_hash", F.explode(let(words(F.col("text")), hashes)).alias("hash")).join(of_items, "hash")
    met = staged(met.groupBy("doc_id", "text_hash").agg(F.collect_set("hash").alias("wanted")), "met")
    same = lambda other: docs["doc_id"].eqNullSafe(other["doc_id"]) & (docs["text_hash"] == other["text_hash"])
    # Those hashes extended to windows, and the windows compared as texts.
    near = docs.join(met, same(met)).select(docs["doc_id"], docs["text_hash"], "text", "wanted").distinct()
    near = near.select("doc_id", "text_hash", F.explode(let(words(F.col("text")), lambda w: cut(w, F.col("wanted")))).alias("x"))
    found = near.select("doc_id", "text_hash", "x.at", "x.length", "x.words").join(item_windows, ["length", "words"])
    found = found.groupBy("doc_id", "text_hash").agg(
        F.array_sort(F.collect_set(F.struct("at", "length"))).alias("hits"), F.array_sort(F.collect_set("item_id")).alias("items")
    )
    found = staged(found, "found")
    covered = F.aggregate(
        "hits",
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda acc, x: F.struct(
            F.greatest(acc["end"], x["at"] + x["length"]).alias("end"),
            (acc["n"] + F.greatest(F.lit(0), x["at"] + x["length"] - F.greatest(acc["end"], x["at"]))).alias("n"),
        ),
        lambda acc: acc["n"],
    )
    # Counted before the join, so that no text is shuffled for it.
    docs = docs.select("doc_id", "text_hash", count_words(F.col("text")).alias("n_words"))
    return docs.join(found, same(found), "left").select(
        docs["doc_id"],
        docs["text_hash"],
        "n_words",
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("hits", F.expr("cast(array() as array<struct<at:int,length:int>>)")).alias("hits"),
        F.coalesce("items", F.expr("cast(array() as array<string>)")).alias("items"),
    )


def _tables(spark, sf_dir: str):
    return spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")


def op5_decontaminate(spark, sf_dir: str) -> DataFrame:
    return contaminated(*_tables(spark, sf_dir)).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows without a window of the benchmark in their own text."""
    hit = _judged(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where("n_hit > 0").select("doc_id", "text_hash").distinct()
    same = docs["doc_id"].eqNullSafe(hit["doc_id"]) & (_text_hash(docs["text"]) == hit["text_hash"])
    return docs.join(hit, same, "left_anti").select(*docs.columns)


QUERIES = {"op5_decontaminate": op5_decontaminate}

ORACLE_SQL = {
    "op5_decontaminate": r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[p:p + 9], ' ') AS g FROM b, unnest(generate_series(1, greatest(1, len(w) - 9))) AS t(p) WHERE len(w) > 0),
size AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, p, n, array_to_string(w[p:p + n - 1], ' ') AS g FROM d, size, unnest(generate_series(1, len(w) - n + 1)) AS t(p)),
m AS (SELECT doc_id, p, n, item_id FROM dw JOIN bw USING (n, g)),
hit AS (SELECT doc_id, count(DISTINCT p + k) AS n_hit FROM m, unnest(generate_series(0, n - 1)) AS t(k) GROUP BY doc_id),
it AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS s FROM m GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""
}
