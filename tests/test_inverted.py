"""The stored inverted index against BM25 over the whole texts."""

import random

from pyspark.sql import functions as F

from lodestone.functions.text import terms
from lodestone.operators import inverted, retrieval
from lodestone.operators.staging import fresh_path

SCHEMA = "doc_id long, text string"


def documents(spark, n=400, seed=3):
    """Texts of common words, some of them with a rare one."""
    rng = random.Random(seed)
    rows = [(i, " ".join([rng.choice("abcdefgh") for _ in range(rng.randrange(1, 120))] + [f"rare{i % 40}"] * (i % 97 == 0))) for i in range(n)]
    return spark.createDataFrame([*rows, (n, None), (n + 1, "  "), (n + 2, "rare1 rare1")], SCHEMA)


def asked(spark):
    return spark.createDataFrame([(1, "rare1 a b"), (2, "Rare17, h!"), (3, "a b c d"), (4, "nowhere"), (5, None), (6, "rare0 rare1 rare2")], "query_id long, text string")


def ordered(frame):
    return sorted((r["query_id"], r["rank"], r["doc_id"], r["score"]) for r in frame.collect())


def test_search_after_additions(spark):
    docs, path = documents(spark), fresh_path(spark, "index")
    assert inverted.exists(spark, path) is False
    assert inverted.add_documents(docs.where("doc_id % 3 = 0"), path, span=16, buckets=8) == docs.where("doc_id % 3 = 0").count()
    assert ordered(inverted.search(spark, path, asked(spark), 5)) == ordered(retrieval.bm25(docs.where("doc_id % 3 = 0"), asked(spark), 5))
    # What is there already, and repeated or null ids, count once or not at all.
    more = docs.unionByName(docs.where("doc_id < 9")).unionByName(spark.createDataFrame([(None, "a")], SCHEMA))
    assert inverted.add_documents(more, path) == docs.where("doc_id % 3 <> 0").count()
    assert inverted.add_documents(docs, path) == 0
    for k in (1, 5, 1000):
        assert ordered(inverted.search(spark, path, asked(spark), k)) == ordered(retrieval.bm25(docs, asked(spark), k))


def test_most_blocks_are_skipped_and_an_unfinished_batch_is_none(spark):
    docs, path = documents(spark, 3000), fresh_path(spark, "index")
    inverted.add_documents(docs, path, span=16)
    want = ordered(retrieval.bm25(docs, asked(spark), 3))
    left = spark.read.parquet(f"{path}/postings").where("batch >= 0").limit(50).withColumn("batch", F.lit(7).cast("long"))
    left.write.mode("append").partitionBy("batch", "bucket").parquet(f"{path}/postings")  # as an addition that failed leaves it
    found = inverted.Search(spark, path, asked(spark).where("query_id = 2"))
    seeds = found.seeds()
    first = retrieval.top(found.scored(seeds), "query_id", "doc_id", 3)
    rest, pairs = found.rest(seeds, first, 3).count(), found.bounds.count()
    assert pairs > 150 and rest < pairs / 3
    assert ordered(inverted.search(spark, path, asked(spark), 3)) == want


def test_documents_without_words_fill_a_task(spark):
    bare = spark.createDataFrame([(i, (None, "", " ?! ")[i % 3]) for i in range(5)], SCHEMA).coalesce(1)
    docs, path = spark.createDataFrame([(7, "a rare1"), (8, "b")], SCHEMA), fresh_path(spark, "index")
    assert inverted.add_documents(bare, path, span=2) == 5
    assert inverted.search(spark, path, asked(spark), 3).count() == 0
    assert inverted.add_documents(docs, path) == 2
    assert ordered(inverted.search(spark, path, asked(spark), 3)) == ordered(retrieval.bm25(bare.unionByName(docs), asked(spark), 3))


def test_empty_index(spark):
    path = fresh_path(spark, "index")
    assert inverted.add_documents(documents(spark).limit(0), path) == 0
    assert inverted.search(spark, path, asked(spark), 3).count() == 0


def test_no_pair_leaves_a_task_but_the_best_of_its_group(spark):
    docs, path = documents(spark, 1500), fresh_path(spark, "index")
    inverted.add_documents(docs, path, span=64)
    many = docs.where("doc_id % 10 = 0").select(F.col("doc_id").alias("query_id"), "text")  # long questions: each meets nearly every document
    found = inverted.Search(spark, path, many)
    asks = found.terms.select("query_id").distinct().count()
    for counted in (False, True):
        assert found._met(3, counted).count() <= 4 * 3 * asks  # four groups
    assert ordered(found.best(3)) == ordered(retrieval.bm25(docs, many, 3))
    words = docs.select("doc_id", F.explode(F.array_distinct(terms(F.col("text")))).alias("term")).join(found.asked, "term")
    shared = words.groupBy("query_id", "doc_id").agg(F.count(F.lit(1)).alias("score"))
    assert ordered(found.fullest(3)) == ordered(retrieval.top(shared, "query_id", "doc_id", 3))
