"""A stored inverted index for BM25: built once, added to, and searched without the texts.

A block holds the postings of one term in one range of documents.  A range is
made where its documents are read, without a shuffle: a task sorts some
thousands of them by length and cuts them in ranges of at most :data:`SPAN`.
The blocks go once through a shuffle, to their bucket of terms.

A search sends the blocks of the wanted terms once through a shuffle too, to
groups of ranges, where the questions meet them: frequent terms as a product of
matrices, the others term by term.  No pair of a question and a document leaves
a task but those among the task's own k best of the question, so what a search
moves grows with the postings and with groups times questions.

A block has, for each count that occurs in it, the smallest length of a document
with that count: the most that its term can add to a score there, whatever the
mean length is by then.  By these bounds (:meth:`Search.rest`) a search for rare
terms can leave out ranges whose bound is below the k-th score found.

An index is a folder with three Parquet tables: ``postings`` by batch and bucket
of terms, sorted by term, ``documents`` with their lengths, and ``batches``,
whose rows are written last: a batch without its row does not exist, so a failed
addition leaves nothing behind.
"""

from __future__ import annotations

import uuid
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import spaced_terms, terms
from .retrieval import K1, B, top
from .staging import parts_for, small_batches, staged

#: Documents of a range, buckets of terms, and ranges that a search scores first for each question.
SPAN, BUCKETS, SEEDS = 4096, 64, 4
#: Wanted terms up to which the scan is told all of them, beyond their buckets.
FEW_TERMS = 1000
#: Words that a task holds while it builds, and postings while it scores; of a group of ranges; questions of a block, and of a step.
HELD, SCORED, GROUP, ASKED, STEP = 2_000_000, 500_000, 8_000_000, 16_384, 256
#: Terms of a product of matrices, and the share of a step's pairs from which a term is one of them.
DENSE, SHARE = 256, 0.02

_BATCH = "batch long, n long, total long, buckets int"
_BLOCK = "term string, range string, n long, peaks array<struct<tf:int,len:int>>, first long, steps array<long>, tfs array<int>, lens array<int>"
_POSTINGS = f"{_BLOCK}, batch long, bucket int"
_DOCUMENTS = "doc_id long, len int, batch long"
_PEAK = pa.struct([("tf", pa.int32()), ("len", pa.int32())])
_ARROW = pa.schema([("term", pa.string()), ("range", pa.string()), ("n", pa.int64()), ("peaks", pa.list_(_PEAK)), ("first", pa.int64()), ("steps", pa.list_(pa.int64())), ("tfs", pa.list_(pa.int32())), ("lens", pa.list_(pa.int32()))])


def _batches(spark: SparkSession, path: str) -> DataFrame | None:
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/batches")
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return None  # no batch was ever added
    return spark.read.schema(_BATCH).parquet(f"{path}/batches")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` holds an index with at least one batch."""
    found = _batches(spark, path)
    return found is not None and not found.isEmpty()


def _bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def _lists(ends: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), values)


def _ranges(held: list[tuple], span: int, prefix: str, made: int):
    """The blocks of some documents: one batch for each range, in it a row for each term and, without a term, one for the documents."""
    ids, lens = (np.concatenate([h[i] for h in held]) for i in (0, 1))
    said = pa.chunked_array([h[2] for h in held], pa.string()).dictionary_encode()  # one dictionary for all
    names = said.chunk(0).dictionary if said.num_chunks else pa.array([], pa.string())  # documents without words leave no chunk
    word = np.concatenate([np.zeros(0, np.int64), *(c.indices.to_numpy() for c in said.chunks)]).astype(np.int64)
    pair, tf = np.unique(np.repeat(np.arange(len(ids)), lens) * max(len(names), 1) + word, return_counts=True)
    doc, code = np.divmod(pair, max(len(names), 1))
    many, by_length = -(-len(ids) // span), np.lexsort((ids, lens))
    place = np.empty(len(ids), np.int64)
    place[by_length] = np.arange(len(ids)) * many // len(ids)
    by_range = np.lexsort((ids, place))  # of one range, in the order of ids
    rank = np.empty(len(ids), np.int64)
    rank[by_range] = np.arange(len(ids))
    key = (place[doc] * len(names) + code) * len(ids) + rank[doc]
    order = np.argsort(key)
    block, doc, code, tf = (key // len(ids))[order], doc[order], code[order], tf[order]
    starts = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]])) if len(block) else np.zeros(0, np.int64)
    cuts = np.searchsorted(block[starts], np.arange(many + 1) * len(names))  # blocks of a range
    ends = np.append(starts, len(block))
    for r in range(many):
        low, high = ends[cuts[r]], ends[cuts[r + 1]]
        at, n = starts[cuts[r] : cuts[r + 1]], np.diff(ends[cuts[r] : cuts[r + 1] + 1])
        own_tf, own_len, own_id = tf[low:high], lens[doc[low:high]], ids[doc[low:high]]
        nth = np.repeat(np.arange(len(at)), n)
        low_first = np.lexsort((own_len, own_tf, nth))
        a, t = nth[low_first], own_tf[low_first]
        least = low_first[np.concatenate([[True], (a[1:] != a[:-1]) | (t[1:] != t[:-1])])] if len(a) else low_first
        peaks = pa.StructArray.from_arrays([pa.array(own_tf[least], pa.int32()), pa.array(own_len[least], pa.int32())], fields=list(_PEAK))
        first = ids[doc[at]]
        told = names.take(pa.array(code[at], pa.int64()))
        label, own = f"{prefix}/{made + r}", by_range[np.searchsorted(place[by_range], r) : np.searchsorted(place[by_range], r, "right")]
        yield pa.RecordBatch.from_arrays(
            [
                told, pa.array([label] * len(at), pa.string()), pa.array(n, pa.int64()), _lists(np.cumsum(np.bincount(nth[least], minlength=len(at))), peaks), pa.array(first, pa.int64()),
                _lists(np.cumsum(n), pa.array(own_id - np.repeat(first, n), pa.int64())), _lists(np.cumsum(n), pa.array(own_tf, pa.int32())), _lists(np.cumsum(n), pa.array(own_len, pa.int32())),
            ],
            schema=_ARROW,
        )
        size = np.array([len(own)])
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([None], pa.string()), pa.array([label]), pa.array(size, pa.int64()), _lists(np.array([0]), pa.array([], _PEAK)), pa.array([0], pa.int64()),
                _lists(size, pa.array(ids[own], pa.int64())), _lists(np.array([0]), pa.array([], pa.int32())), _lists(size, pa.array(lens[own], pa.int32())),
            ],
            schema=_ARROW,
        )


def _inverted(span: int, batch: int):
    """Documents (doc_id, words between spaces) to the blocks of ranges; a task holds about :data:`HELD` words."""

    def run(batches):
        held, docs, words, made = [], 0, 0, 0
        prefix = f"{batch}/{TaskContext.get().partitionId()}"
        for one in batches:
            if not one.num_rows:
                continue
            cut = pc.split_pattern(one.column(1), " ")
            owner, said = np.repeat(np.arange(len(cut)), pc.list_value_length(cut).to_numpy()), cut.flatten()
            whole = pc.not_equal(said, "")
            lens = np.bincount(owner[whole.to_numpy(zero_copy_only=False)], minlength=len(cut))
            held.append((one.column(0).to_numpy(), lens, said.filter(whole)))
            docs, words = docs + len(cut), words + int(lens.sum())
            if words >= HELD or docs >= 8 * span:
                yield from _ranges(held, span, prefix, made)
                made += -(-docs // span)
                held, docs, words = [], 0, 0
        if held:
            yield from _ranges(held, span, prefix, made)

    return run


def add_documents(docs: DataFrame, path: str, span: int = SPAN, buckets: int = BUCKETS) -> int:
    """Add ``docs`` (doc_id, text) to the index at ``path``, which is made if there is none; returns how many were new.

    Documents that the index has, and null ids, are left out; of an id that
    repeats in ``docs``, the smallest text counts.  ``buckets`` is settled by
    the first batch.  Null texts have no terms but count as documents.
    """
    spark = docs.sparkSession
    small_batches(spark)
    before = _batches(spark, path)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id IS NOT NULL")
    parts = parts_for(rows, "text")
    batch = uuid.uuid4().int >> 66  # never that of an addition that failed
    if before is not None:
        last = before.agg(F.max("buckets")).first()[0]
        if last is not None:
            buckets = last
            have = spark.read.schema(_DOCUMENTS).parquet(f"{path}/documents").join(F.broadcast(before.select("batch")), "batch", "left_semi")
            rows = rows.repartition(parts, "doc_id").join(have.select("doc_id").repartition(parts, "doc_id"), "doc_id", "left_anti")
    # Only ids go through a shuffle to find those that repeat, and only the texts of these follow.
    ids = rows.select("doc_id") if before is None else docs.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id IS NOT NULL")
    twice = staged(ids.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id"), "twice")
    if not twice.isEmpty():
        rows = rows.join(twice, "doc_id", "left_anti").unionByName(rows.join(twice, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text")))
    blocks = staged(rows.select("doc_id", spaced_terms(F.col("text")).alias("w")).mapInArrow(_inverted(span, batch), _BLOCK), "blocks")
    coded = blocks.where("term IS NOT NULL").select("*", F.lit(batch).cast("long").alias("batch"), _bucket(F.col("term"), buckets).alias("bucket"))
    piece = F.pmod(F.shiftright(F.xxhash64("term"), 20), F.lit(-(-parts // buckets)))
    coded.repartition(parts, "bucket", piece).sortWithinPartitions("bucket", "term", "range").write.mode("append").partitionBy("batch", "bucket").parquet(f"{path}/postings")
    sizes = blocks.where("term IS NULL").select(F.explode(F.arrays_zip("steps", "lens")).alias("e")).select(F.col("e.steps").alias("doc_id"), F.col("e.lens").alias("len"))
    sizes.withColumn("batch", F.lit(batch).cast("long")).write.mode("append").partitionBy("batch").parquet(f"{path}/documents")
    total = sizes.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("len"), F.lit(0)).alias("total"))
    row = total.select(F.lit(batch).cast("long").alias("batch"), "n", F.col("total").cast("long"), F.lit(buckets).alias("buckets"))
    staged(row, "batch").write.mode("append").parquet(f"{path}/batches")
    return spark.read.schema(_BATCH).parquet(f"{path}/batches").where(F.col("batch") == batch).first()["n"]


def _weight(idf: Column, tf: Column, size: Column, mean: float) -> Column:
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / F.lit(mean)))


def _blocks(spark: SparkSession, path: str, wanted: DataFrame, done: DataFrame, buckets: int) -> DataFrame:
    """The postings of ``wanted`` terms: other buckets are not listed, and where terms are few, the scan skips others by their range in a file."""
    used = [r["b"] for r in wanted.select(_bucket(F.col("term"), buckets).alias("b")).distinct().collect()]  # at most as many as there are buckets
    few = wanted.limit(FEW_TERMS + 1).collect()
    found = spark.read.schema(_POSTINGS).parquet(f"{path}/postings").where(F.col("bucket").isin(used) if used else F.lit(False))
    if len(few) <= FEW_TERMS:
        found = found.where(F.col("term").isin([r["term"] for r in few]))
    else:
        found = found.join(wanted, "term", "left_semi")
    return found.join(F.broadcast(done.select("batch")), "batch", "left_semi")


class _Best:
    """The questions of a block and their best documents so far, step by step of :data:`STEP` questions."""

    def __init__(self, k: int, told: list[tuple]):
        self.k, self.codes = k, {term: c for c, (term, _, _) in enumerate(told)}
        sizes = np.array([len(q) for _, q, _ in told])
        query, weight = (np.concatenate([x[i] for x in told]) for i in (1, 2))
        self.queries, at = np.unique(query, return_inverse=True)
        code = np.repeat(np.arange(len(told)), sizes)
        self.steps = []
        for low in range(0, len(self.queries), STEP):
            own = np.flatnonzero((at >= low) & (at < low + STEP))  # still in the order of terms
            ends = np.searchsorted(code[own], np.arange(len(told) + 1))
            self.steps.append((at[own] - low, weight[own], ends, self.queries[low : low + STEP]))
        self.best = [tuple(np.zeros(0, t) for t in (np.int64, np.float64, np.int64)) for _ in self.steps]
        self.least = [(np.full(len(s[3]), -np.inf), np.full(len(s[3]), np.iinfo(np.int64).max)) for s in self.steps]

    def add(self, codes: np.ndarray, sizes: np.ndarray, docs: np.ndarray, weights: np.ndarray) -> None:
        """Score whole ranges: a row of postings for each of ``codes``."""
        ids, doc = np.unique(docs, return_inverse=True)
        starts = np.cumsum(sizes) - sizes
        found = np.bincount(codes, sizes, len(self.codes))
        posting_code = np.repeat(codes, sizes)
        for step, (query, factor, ends, queries) in enumerate(self.steps):
            asks = np.diff(ends)
            cost = asks * found
            dense = np.argsort(-cost, kind="stable")[:DENSE]
            dense = dense[cost[dense] >= SHARE * len(queries) * len(ids)]
            scores = self._product(dense, query, factor, ends, posting_code, doc, weights, len(queries), len(ids))
            left = asks[codes] > 0
            if len(dense):
                left &= ~np.isin(codes, dense)
            rows = np.flatnonzero(left)
            pairs = asks[codes[rows]] * sizes[rows]
            for r in rows[pairs >= 4096].tolist():
                a, b = slice(ends[codes[r]], ends[codes[r] + 1]), slice(starts[r], starts[r] + sizes[r])
                scores[query[a][:, None], doc[b][None, :]] += factor[a][:, None] * weights[b][None, :]
            rows, pairs = rows[pairs < 4096], pairs[pairs < 4096]
            cuts = np.searchsorted(np.cumsum(pairs), np.arange(0, pairs.sum(), 1 << 20)) if len(rows) else []
            for some in np.split(np.arange(len(rows)), cuts[1:]) if len(rows) else ():
                r, n = rows[some], pairs[some]
                nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                a, b = np.divmod(nth, np.repeat(sizes[r], n))
                a, b = a + np.repeat(ends[codes[r]], n), b + np.repeat(starts[r], n)
                np.add.at(scores.reshape(-1), query[a] * len(ids) + doc[b], factor[a] * weights[b])
            self._keep(step, scores, ids)

    def _product(self, dense, query, factor, ends, posting_code, doc, weights, rows: int, columns: int) -> np.ndarray:
        if not len(dense):
            return np.zeros((rows, columns))
        place = np.full(len(self.codes), -1)
        place[dense] = np.arange(len(dense))
        asked, held = np.zeros((rows, len(dense))), np.zeros((len(dense), columns))
        for j, c in enumerate(dense.tolist()):
            asked[query[ends[c] : ends[c + 1]], j] = factor[ends[c] : ends[c + 1]]
        own = np.flatnonzero(place[posting_code] >= 0)
        held[place[posting_code[own]], doc[own]] = weights[own]
        return asked @ held

    def _keep(self, step: int, scores: np.ndarray, ids: np.ndarray) -> None:
        least, least_id = self.least[step]
        mask = (scores > 0) & (scores >= least[:, None] - 1e-6)
        if mask.sum() > 8 * self.k * len(scores) and scores.shape[1] > self.k:
            near = np.partition(scores, -self.k, axis=1)[:, -self.k]
            mask &= scores >= near[:, None] - 2e-6
        q, d = np.nonzero(mask)
        score, found = np.round(scores[q, d], 6), ids[d]
        good = (score > least[q]) | ((score == least[q]) & (found < least_id[q]))
        q, score, found = (np.concatenate([old, new[good]]) for old, new in zip(self.best[step], (q, score, found), strict=True))
        order = np.lexsort((found, -score, q))
        q, score, found = q[order], score[order], found[order]
        nth = np.arange(len(q)) - np.searchsorted(q, q)
        kept = nth < self.k
        self.best[step] = q[kept], score[kept], found[kept]
        full = nth == self.k - 1
        least[q[full]], least_id[q[full]] = score[full], found[full]

    def rows(self):
        for (_, _, _, queries), (q, score, found) in zip(self.steps, self.best, strict=True):
            yield pa.RecordBatch.from_pydict({"query_id": queries[q], "doc_id": found, "score": score})


def _scored(k: int, mean: float, counted: bool):
    """Rows of a group, its questions first and then blocks by range, to the group's ``k`` best of each question."""

    def run(batches):
        group, told, best, held, postings, last = None, [], None, [], 0, None
        for batch in batches:
            names, places, groups = (batch.column(c).to_pylist() for c in ("term", "range", "group"))
            lists = {c: batch.column(c).flatten().to_numpy() for c in ("steps", "tfs", "lens", "factors")}
            ends = np.concatenate([[0], np.cumsum(pc.list_value_length(batch.column("steps")).to_numpy())]).astype(np.int64)
            asks = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(batch.column("factors")), 0).to_numpy())]).astype(np.int64)
            first, had = batch.column("first").to_numpy(), ends - asks  # questions have no counts and lengths
            low = 0
            while low < len(names):
                high = low + 1
                while high < len(names) and places[high] == places[low] and groups[high] == groups[low]:
                    high += 1
                if groups[low] != group:
                    if best and held:
                        best.add(*(np.concatenate(x) for x in zip(*held, strict=True)))
                    if best:
                        yield from best.rows()
                    group, told, best, held, postings, last = groups[low], [], None, [], 0, None
                if places[low] is None:
                    told += [(names[i], lists["steps"][ends[i] : ends[i + 1]], lists["factors"][asks[i] : asks[i + 1]]) for i in range(low, high)]
                elif told:
                    best = best or _Best(k, told)
                    if places[low] != last and postings >= SCORED:
                        best.add(*(np.concatenate(x) for x in zip(*held, strict=True)))
                        held, postings = [], 0
                    last = places[low]
                    code = np.array([best.codes.get(x, -1) for x in names[low:high]])
                    size = np.diff(ends[low : high + 1])
                    own = np.repeat(code >= 0, size)
                    docs = np.repeat(first[low:high], size) + lists["steps"][ends[low] : ends[high]]
                    tf, length = (lists[c][had[low] : had[high]].astype(np.float64) for c in ("tfs", "lens"))
                    weight = np.ones(len(tf)) if counted else tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))
                    held.append((code[code >= 0], size[code >= 0], docs[own], weight[own]))
                    postings += int(own.sum())
                low = high
        if best and held:
            best.add(*(np.concatenate(x) for x in zip(*held, strict=True)))
        if best:
            yield from best.rows()

    return run


class Search:
    """A search of the index at ``path`` for ``queries`` (query_id, text, or query_id, term and factor: what a term counts).

    ``n`` and ``mean`` are the number of documents and their mean length,
    ``known`` has the asked terms that occur and their ``df``.  ``bounds`` has, for each question and range with one of its terms, the most
    that a document there can score.
    """

    def __init__(self, spark: SparkSession, path: str, queries: DataFrame):
        done = _batches(spark, path)
        if done is None:
            raise ValueError(f"no index at {path}")
        small_batches(spark)
        stats = done.agg(F.sum("n"), F.sum("total"), F.max("buckets")).first()
        self.n, self.mean = stats[0] or 0, (stats[1] or 0) / max(stats[0] or 0, 1) or 1.0
        if "factor" not in queries.columns:
            queries = queries.select("query_id", F.explode(F.array_distinct(terms(F.col("text")))).alias("term")).distinct().withColumn("factor", F.lit(1.0))
        self.asked = staged(queries.select("query_id", "term", "factor"), "asked")
        self.spark, self.path, self.done, self.buckets = spark, path, done, stats[2] or BUCKETS
        wanted = staged(self.asked.select("term").distinct(), "wanted")
        self.blocks = _blocks(spark, path, wanted, done, self.buckets)
        self.known = staged(self.blocks.groupBy("term").agg(F.sum("n").alias("df")), "known")
        idf = F.log(1 + (F.lit(float(self.n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        self.terms = staged(self.asked.join(self.known, "term").select("query_id", "term", (F.col("factor") * idf).alias("idf")), "terms")

    @cached_property
    def bounds(self) -> DataFrame:
        # Only the bounds of the blocks: a scan without the postings.
        most = F.array_max(F.transform("peaks", lambda x: _weight(F.col("idf"), x["tf"], x["len"], self.mean)))
        return staged(self.terms.join(self.blocks.select("term", "range", "peaks"), "term").groupBy("query_id", "range").agg(F.sum(most).alias("most"), F.count(F.lit(1)).alias("blocks")), "bounds")

    def frequencies(self, words: DataFrame) -> DataFrame:
        """``term`` and ``df`` of other ``words`` (term)."""
        return _blocks(self.spark, self.path, staged(words, "words"), self.done, self.buckets).groupBy("term").agg(F.sum("n").alias("df"))

    def scored(self, places: DataFrame) -> DataFrame:
        """``query_id``, ``doc_id`` and ``score`` of the documents in ``places`` (query_id, range)."""
        wanted = self.terms.join(places.select("query_id", "range"), "query_id")
        needed = self.blocks.join(wanted.select("term", "range").distinct(), ["term", "range"], "left_semi")
        entries = needed.select("term", "range", "first", F.explode(F.arrays_zip("steps", "tfs", "lens")).alias("e")).select(
            "term", "range", (F.col("first") + F.col("e.steps")).alias("doc_id"), F.col("e.tfs").alias("tf"), F.col("e.lens").alias("len")
        )
        weight = _weight(F.col("idf"), F.col("tf"), F.col("len"), self.mean)
        return wanted.join(entries, ["term", "range"]).groupBy("query_id", "doc_id").agg(F.round(F.sum(weight), 6).alias("score"))

    def seeds(self, many: int = SEEDS) -> DataFrame:
        """The ranges that promise most."""
        return top(self.bounds, "query_id", "range", many, "most").select("query_id", "range")

    def rest(self, seeds: DataFrame, found: DataFrame, k: int) -> DataFrame:
        """The other ranges whose bound reaches the score of the k-th document found."""
        least = found.where(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
        left = self.bounds.join(seeds, ["query_id", "range"], "left_anti").join(least, "query_id", "left")
        return left.where(F.col("least").isNull() | (F.col("most") + 1e-6 >= F.col("least"))).select("query_id", "range", "blocks")

    def _met(self, k: int, counted: bool) -> DataFrame:
        """``query_id``, ``doc_id`` and ``score`` of the best of each group of ranges."""
        postings = self.known.agg(F.sum("df")).first()[0] or 0
        groups = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), int(postings) // GROUP + 1)
        blocks = self.terms.select("query_id").distinct().count() // ASKED + 1
        each = lambda many: F.explode(F.sequence(F.lit(0), F.lit(many - 1)))
        factor = F.lit(1.0) if counted else F.greatest("idf", F.lit(1e-300))  # a factor of 0 still finds a document
        told = self.terms.select(F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block"), "term", F.struct(F.col("query_id").cast("long").alias("q"), factor.alias("f")).alias("x"))
        told = staged(told.groupBy("block", "term").agg(F.collect_list("x").alias("x")).select("block", "term", F.col("x.q").alias("steps"), F.col("x.f").alias("factors")), "told")
        none, text = F.expr("cast(array() as array<int>)"), F.lit(None).cast("string")
        questions = told.select(each(groups).alias("g"), "block", "term", "steps", "factors")
        questions = questions.select((F.col("g") * blocks + F.col("block")).alias("group"), text.alias("range"), "term", F.lit(0).cast("long").alias("first"), "steps", none.alias("tfs"), none.alias("lens"), "factors")
        met = self.blocks.select(each(blocks).alias("block"), "range", "term", "first", "steps", "tfs", "lens")
        place = F.pmod(F.xxhash64("range"), F.lit(groups)).cast("int")
        met = met.select((place * blocks + F.col("block")).alias("group"), "range", "term", "first", "steps", "tfs", "lens", F.expr("cast(array() as array<double>)").alias("factors"))
        dealt = questions.unionByName(met).repartitionById(groups * blocks, F.col("group")).sortWithinPartitions("group", "range")
        kind = dict(self.terms.dtypes)["query_id"]
        return dealt.mapInArrow(_scored(k, self.mean, counted), "query_id long, doc_id long, score double").withColumn("query_id", F.col("query_id").cast(kind))

    def best(self, k: int) -> DataFrame:
        """``query_id``, ``doc_id``, ``score`` and ``rank`` of the ``k`` best documents of each question; ties by id."""
        return top(self._met(k, False), "query_id", "doc_id", k)

    def fullest(self, k: int) -> DataFrame:
        """The same by how many of a question's terms a document has."""
        return top(self._met(k, True).withColumn("score", F.col("score").cast("long")), "query_id", "doc_id", k)


def search(spark: SparkSession, path: str, queries: DataFrame, k: int) -> DataFrame:
    """The ``k`` best documents of the index for each of ``queries`` (query_id, text), as :func:`retrieval.bm25` finds them."""
    return Search(spark, path, queries).best(k)
