"""Stored vectors against all dot products."""

import numpy as np

from lodestone.operators import nearest, retrieval
from lodestone.operators.staging import fresh_path

SCHEMA = "vec_id long, embedding array<float>"


def test_exact_and_few_candidates(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 24)).astype(np.float32)
    x[10:14] = x[9]  # ties
    x[20] = 0
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    vectors = spark.createDataFrame([*rows, (None, [0.0] * 24), (5000, None)], SCHEMA).repartition(3)
    asked = spark.createDataFrame([r for r in rows if r[0] % 100 in (0, 9)] + [(9001, [1.0] * 24)], SCHEMA)
    path = fresh_path(spark, "vectors")
    nearest.store(vectors, path)
    for k in (1, 7):
        want = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in retrieval.dense(vectors, asked, k).collect()}
        assert {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in nearest.nearest(spark, path, asked, k).collect()} == want
    n = nearest.candidates(spark, path, asked, 7).count()
    assert n < 20 * asked.count()  # of 3,000 vectors each


def test_few_rows_and_none(spark):
    vectors, path = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.5, 0.5])], SCHEMA), fresh_path(spark, "vectors")
    nearest.store(vectors, path)
    got = {(r["query_id"], r["vec_id"], r["rank"]) for r in nearest.nearest(spark, path, vectors, 5).collect()}
    assert got == {(1, 2, 1), (2, 1, 1)}
    assert nearest.nearest(spark, path, vectors.limit(0), 5).count() == 0
