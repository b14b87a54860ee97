"""Queries over answers from documents: the controller's rounds, the whole cascade, support by evidence; and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import dot
from ..operators import answering, checking, inverted, names, nearest, retrieval
from ..operators.staging import path_for, staged, written
from . import catalog


#: Chunks that a document has at most, for ids of chunks.
CHUNKS = 1_000_000


def _t(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark, d) -> DataFrame:
    return _t(spark, d, "documents").select("doc_id", "text")


def rag_rounds(spark, d):
    """What the documents say to each curated text, asked once or twice, and where the answer stands."""
    queries = _t(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    found = answering.controlled(spark, catalog._index(spark, d), _documents(spark, d), queries)
    cites = F.array_join(F.transform("cites", lambda c: F.concat_ws(":", c["doc_id"], c["pos"])), ",")
    return found.select("query_id", "attempt", "coverage", cites.alias("cites"), "resolved", F.array_join("warnings", ",").alias("warnings"))


def _cascade_questions(spark, d):
    """The curated texts in three guises, and the user's turns of every hundredth conversation."""
    asked = catalog._questions(spark, d)
    return asked.where((F.col("number") < 0) | (F.floor(F.col("number") / 1000) % 100 == 0))


def cascade(spark, d):
    return answering.answered_by_cascade(spark, _cascade_questions(spark, d), catalog._faq(spark, d), catalog._index(spark, d), _documents(spark, d))


def grounded_sentences(spark, d):
    """How much of each sentence of an assistant's turn stands in any of the turns before it in its conversation: in runs of two words and more."""
    said = _t(spark, d, "conversations").select("conv_id", "turn", "text", (F.col("role") == "assistant").alias("asked"))
    return checking.grounded_before(said, "conv_id", "turn", 2)


def _lists(spark, d):
    """Every hundredth document that has a vector asks for others: the 20 best by words, and by vectors."""
    vectors = _t(spark, d, "embeddings").select("vec_id", "embedding")
    docs = _documents(spark, d)
    asked = docs.where("doc_id % 100 = 0").join(vectors.select(F.col("vec_id").alias("doc_id")), "doc_id", "left_semi").select(F.col("doc_id").alias("query_id"), "text")
    sparse = inverted.search(spark, catalog._index(spark, d), asked, 21).where("query_id <> doc_id").drop("rank")
    dense = retrieval.dense(vectors, vectors.join(asked.select(F.col("query_id").alias("vec_id")), "vec_id", "left_semi"), 20)
    return staged(retrieval.top(sparse, "query_id", "doc_id", 20), "sparse"), staged(dense.select("query_id", F.col("vec_id").alias("doc_id"), "score", "rank"), "dense"), vectors


def hybrid_fuse(spark, d):
    """Both lists fused by reciprocal ranks."""
    sparse, dense, _ = _lists(spark, d)
    return retrieval.fuse([sparse, dense], 10).select("query_id", "doc_id", "rank")


def hybrid_gate(spark, d):
    """The hits by words in the order of their vectors, from a floor up; none for a question whose best vector is too far."""
    sparse, dense, vectors = _lists(spark, d)
    near = retrieval.floor(dense, 0.3).where("NOT refused").select("query_id")
    own = vectors.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("asks"))
    pairs = sparse.join(near, "query_id", "left_semi").join(vectors.withColumnRenamed("vec_id", "doc_id"), "doc_id").join(own, "query_id")
    ranked = retrieval.reranked(pairs, F.round(dot(F.col("asks"), F.col("embedding")), 6), 5, 0.0)
    return ranked.select("query_id", "doc_id", "rank")


def dense_gate(spark, d):
    """The hits by words that belong to the documents chosen by vectors."""
    sparse, dense, _ = _lists(spark, d)
    return retrieval.gated(sparse, dense).select("query_id", "doc_id", "rank")


def chunk_search(spark, d):
    """Chunks found by words in an index of their own, back to the five documents with the best of them."""
    path = path_for(spark, "bm25-chunks", f"{d}/documents.parquet")
    if not inverted.exists(spark, path):
        pieces = retrieval.chunks(_documents(spark, d)).select((F.col("doc_id") * CHUNKS + F.col("ord")).alias("doc_id"), "text")
        inverted.add_documents(pieces, path)
    asked = _t(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    found = inverted.search(spark, path, asked, 20).withColumn("doc_id", F.floor(F.col("doc_id") / CHUNKS))
    return retrieval.small_to_big(found, 5)


def dense_stored(spark, d):
    """Every hundredth vector asked against the stored ones."""
    vectors, path = _t(spark, d, "embeddings"), path_for(spark, "vectors", f"{d}/embeddings.parquet")
    if not written(spark, path):
        nearest.store(vectors, path)
    return nearest.nearest(spark, path, vectors.where("vec_id % 100 = 0"), 10).select("query_id", "vec_id", F.round("score", 4).alias("score"))


def file_catalog(spark, d):
    """The hosts of all pages matched to a catalogue of hosts: those of every third page, without their first label."""
    host = F.regexp_extract("url", r"^[a-z]+://([^/?#]*)", 1)
    pages = _t(spark, d, "pages").select("page_id", host.alias("name"))
    entries = pages.where("page_id % 3 = 0").select(F.regexp_replace("name", r"^[^.]*\.", "").alias("entry"))
    return names.catalogued(pages, entries)


QUERIES = {f.__name__: f for f in (rag_rounds, cascade, grounded_sentences, file_catalog, hybrid_fuse, hybrid_gate, dense_gate, chunk_search, dense_stored)}

_SPLIT = r"list_filter(regexp_split_to_array(lower(coalesce({}, '')), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"


def _found(k: int, asked: str) -> str:
    """SQL of one round: the best documents of ``asked`` (query_id, term, factor), the sentences chosen, and the coverage."""
    out = f"""
bm{k} AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (
  SELECT query_id, doc_id, round(sum(factor * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * len / mean))), 6) AS score
  FROM tf JOIN df USING (term) JOIN {asked} USING (term), st GROUP BY ALL) QUALIFY rank <= 3),
held{k} AS (SELECT query_id, doc_id, rank, pos, term, weight FROM bm{k} JOIN said USING (doc_id) JOIN wt USING (query_id, term)),
has{k}_0 AS (SELECT query_id, term FROM held{k} WHERE false)"""
    for nth in (1, 2, 3):
        out += f""",
pick{k}_{nth} AS (SELECT query_id, doc_id, pos FROM (
  SELECT query_id, doc_id, rank, pos, round(sum(CASE WHEN h.term IS NULL THEN weight ELSE -0.25 * weight END), 6) AS gain
  FROM held{k} LEFT JOIN has{k}_{nth - 1} h USING (query_id, term) GROUP BY ALL) WHERE gain > 0 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY gain DESC, rank, pos) = 1),
has{k}_{nth} AS (SELECT query_id, term FROM has{k}_{nth - 1} UNION SELECT query_id, term FROM held{k} JOIN pick{k}_{nth} USING (query_id, doc_id, pos))"""
    return f"""{out},
cov{k} AS (SELECT query_id, {k} AS attempt, round(sum(CASE WHEN h.term IS NULL THEN 0.0::DOUBLE ELSE weight END) / sum(weight), 6) AS coverage
  FROM wt LEFT JOIN has{k}_3 h USING (query_id, term) WHERE query_id IN (SELECT query_id FROM {asked}) GROUP BY query_id)"""


_HYBRID = (
    catalog.BM25_SQL.replace("item_id AS query_id", "doc_id AS query_id").replace("FROM benchmark", "FROM documents WHERE doc_id % 100 = 0 AND doc_id IN (SELECT vec_id FROM embeddings)").replace("AS rank FROM s)", "AS rank FROM s WHERE query_id <> doc_id)")
    + """,
vp AS (SELECT q.vec_id AS query_id, v.vec_id AS doc_id, round(list_sum(list_transform(list_zip(q.embedding, v.embedding), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE))), 6) AS score
  FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0 AND q.vec_id IN (SELECT doc_id FROM documents) AND q.vec_id <> v.vec_id),
dr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM vp QUALIFY rank <= 20)"""
)

_CHUNKED = catalog.BM25_SQL.replace("FROM documents)", "FROM (SELECT doc_id * 1000000 + ord AS doc_id, substr(text, ord * 700 + 1, 700) AS text FROM (SELECT doc_id, text, unnest(generate_series(0, CAST(ceil(length(text) / 700.0) AS BIGINT) - 1)) AS ord FROM documents)))")

ORACLE_SQL = {
    "chunk_search": f"""WITH {_CHUNKED}, b AS (SELECT query_id, doc_id // 1000000 AS doc_id, max(score) AS score FROM bm WHERE rank <= 20 GROUP BY ALL)
SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM b QUALIFY rank <= 5""",
    "dense_stored": catalog.ORACLE_SQL["dense_topk"],
    "hybrid_fuse": f"""WITH {_HYBRID},
f AS (SELECT query_id, doc_id, round(sum(1.0 / (60 + rank)), 9) AS score FROM (SELECT query_id, doc_id, rank FROM bm WHERE rank <= 20 UNION ALL SELECT query_id, doc_id, rank FROM dr) GROUP BY ALL)
SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM f QUALIFY rank <= 10""",
    "hybrid_gate": f"""WITH {_HYBRID}
SELECT query_id, doc_id, place AS rank FROM (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY vp.score DESC, doc_id) AS place FROM bm JOIN vp USING (query_id, doc_id)
WHERE bm.rank <= 20 AND vp.score >= 0 AND query_id IN (SELECT query_id FROM dr GROUP BY query_id HAVING max(score) >= 0.3)) WHERE place <= 5""",
    "dense_gate": f"WITH {_HYBRID} SELECT query_id, doc_id, bm.rank FROM bm SEMI JOIN dr USING (query_id, doc_id) WHERE bm.rank <= 20",
    "rag_rounds": f"""
WITH words AS (SELECT doc_id, {_SPLIT.format("text")} AS w FROM documents),
st AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(len(w)) AS mean FROM words),
tf AS (SELECT doc_id, len, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS len, unnest(w) AS term FROM words) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
q1 AS (SELECT DISTINCT item_id AS query_id, unnest({_SPLIT.format("text")}) AS term, 1.0::DOUBLE AS factor FROM benchmark),
wt AS (SELECT query_id, term, ln(1 + (n - coalesce(df, 0) + 0.5) / (coalesce(df, 0) + 0.5)) AS weight FROM q1 LEFT JOIN df USING (term), st),
pieces AS (SELECT doc_id, regexp_split_to_array(coalesce(text, ''), '[.!?\\n]+') AS p FROM documents),
said AS (SELECT DISTINCT doc_id, pos, unnest({_SPLIT.format("piece")}) AS term FROM (SELECT doc_id, unnest(p) AS piece, generate_subscripts(p, 1) - 1 AS pos FROM pieces)),
{_found(1, "q1")},
again AS (SELECT query_id FROM cov1 WHERE coverage < 0.6),
hits AS (SELECT query_id, doc_id, count(*) OVER (PARTITION BY query_id) AS many FROM bm1 SEMI JOIN again USING (query_id)),
worth AS (SELECT query_id, term, round(sum(tf / len) / any_value(many) * ln(1 + (any_value(n) - any_value(df) + 0.5) / (any_value(df) + 0.5)), 9) AS worth
  FROM hits JOIN tf USING (doc_id) JOIN df USING (term), st WHERE NOT EXISTS (SELECT 1 FROM q1 WHERE q1.query_id = hits.query_id AND q1.term = tf.term) GROUP BY query_id, term),
q2 AS (SELECT query_id, term, factor FROM q1 SEMI JOIN again USING (query_id) UNION ALL
  SELECT query_id, term, round(0.5 * worth / max(worth) OVER (PARTITION BY query_id), 6) FROM worth QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY worth DESC, term) <= 5),
{_found(2, "q2")},
tried AS (SELECT * FROM cov1 UNION ALL SELECT * FROM cov2),
kept AS (SELECT *, max(attempt) OVER (PARTITION BY query_id) AS tries FROM tried QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY coverage DESC, attempt) = 1),
picks AS ({" UNION ALL ".join(f"SELECT query_id, {k} AS attempt, {nth} AS nth, doc_id || ':' || pos AS c FROM pick{k}_{nth}" for k in (1, 2) for nth in (1, 2, 3))}),
cites AS (SELECT query_id, attempt, string_agg(c, ',' ORDER BY nth) AS cites FROM picks GROUP BY ALL)
SELECT query_id, attempt, coverage, coalesce(cites, '') AS cites, coverage >= 0.6 AS resolved,
  concat_ws(',', CASE WHEN tries > 1 THEN 'rewritten' END, CASE WHEN tries > attempt THEN 'rolled_back' END, CASE WHEN coverage < 0.6 THEN 'low_coverage' END) AS warnings
FROM kept LEFT JOIN cites USING (query_id, attempt)""",
    "grounded_sentences": f"""
WITH t AS MATERIALIZED (SELECT *, row_number() OVER () AS id FROM conversations),
a AS (SELECT id, conv_id, turn, list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '[.!?\\n]+'), lambda s: {_SPLIT.format("s").replace("lambda x: x", "lambda y: y")}), lambda w: len(w) > 0) AS ss FROM t WHERE role = 'assistant'),
s AS (SELECT id, conv_id, turn, unnest(ss) AS w, generate_subscripts(ss, 1) - 1 AS ord FROM a),
e AS (SELECT id AS told, conv_id, turn AS earlier, {_SPLIT.format("text")} AS w FROM t),
sw AS (SELECT id, conv_id, turn, ord, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM s),
ew AS (SELECT told, conv_id, earlier, unnest(w) AS word, generate_subscripts(w, 1) AS j FROM e),
m AS (SELECT id, ord, told, i, i - j AS diagonal, i - row_number() OVER (PARTITION BY id, ord, told, i - j ORDER BY i) AS island FROM sw JOIN ew USING (conv_id, word) WHERE earlier < turn),
r AS (SELECT id, ord, min(i) AS first, count(*) AS n FROM m GROUP BY id, ord, told, diagonal, island),
c AS (SELECT id, ord, count(DISTINCT i) AS covered FROM (SELECT id, ord, unnest(generate_series(first, first + n - 1)) AS i FROM r WHERE n >= 2) GROUP BY ALL),
l AS (SELECT id, ord, max(n) AS longest FROM r GROUP BY ALL)
SELECT conv_id, turn, ord, len(w) AS words, coalesce(covered, 0) AS covered, coalesce(longest, 0) AS longest, round(coalesce(covered, 0) / len(w), 6) AS share
FROM s LEFT JOIN c USING (id, ord) LEFT JOIN l USING (id, ord)""",
    "file_catalog": """
WITH p AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS name FROM pages),
f AS (SELECT DISTINCT name FROM p), e AS (SELECT DISTINCT regexp_replace(name, '^[^.]*\\.', '') AS entry FROM p WHERE page_id % 3 = 0),
s AS (SELECT name, entry, len(name) + len(entry) AS n, string_split(entry, '') AS b,
  list_reduce(string_split(name, ''), lambda before, c: list_reduce(range(1, len(entry) + 1), lambda now, j: list_append(now, CASE WHEN string_split(entry, '')[j] = c THEN before[j] + 1 ELSE greatest(before[j + 1], now[j]) END), [0]), list_transform(range(len(entry) + 1), lambda z: 0))[-1] AS common
  FROM f, e WHERE name <> '' AND entry <> '' AND abs(len(name) - len(entry)) <= 0.15 * (len(name) + len(entry)) + 0.001),
k AS (SELECT name, entry, ((1.0::DOUBLE - (n - 2 * common)::DOUBLE / n) * 100.0::DOUBLE) / 100.0::DOUBLE AS score FROM s),
r AS (SELECT *, count(*) OVER (PARTITION BY name) - 1 AS rivals FROM k WHERE score >= 0.85 QUALIFY row_number() OVER (PARTITION BY name ORDER BY score DESC, entry) = 1)
SELECT name, entry, round(score, 6) AS score, coalesce(rivals, 0) AS rivals FROM f LEFT JOIN r USING (name)""",
}
