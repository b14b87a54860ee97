"""Substring deduplication by Rabin-Karp hashes of every fixed-length token window.

Every window of ``width`` words is hashed.  The hashes are dealt to ranges of
the hash space; each range finds, for every hash, the smallest document that
has it.  A window that some smaller document has too is repeated, and the
repeated windows of a document merge into maximal intervals of words.

A second hash of 32 bits goes with the first one of 64, so windows of different
words are told apart by 96 bits; the words themselves have 64, of a key that is
new in each run.

What many documents share does not pile up: a task settles the copies that it
sees within one piece of its input, and of a window that is frequent there
(:data:`FREQUENT`) it remembers the smallest document, so that later pieces
send it again only if they hold a smaller one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rolling import CHECK_BASE, fresh_key, mixed, slices, string_bytes, window_hashes, word_hashes
from .shared import FILTER_BITS, in_filter, partitions, small_batches, staged, text_mb

#: Words of a window.
WIDTH = 13
#: Bytes of text hashed and sorted at a time, and megabytes of text for each range of hashes or group of documents.
CHUNK, RANGE_MB = 4 << 20, 4
#: How often one piece has a window, from which on a task remembers it.
FREQUENT = 4


def packed(x: np.ndarray) -> bytes:
    """Non-negative integers in as few bytes each as the largest one needs; the first byte says how many."""
    x = np.ascontiguousarray(x, dtype="<u8")
    wide = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
    return bytes([wide]) + x.view(np.uint8).reshape(-1, 8)[:, :wide].tobytes()


def unpacked(blob: bytes) -> np.ndarray:
    raw = np.frombuffer(blob, dtype=np.uint8)
    wide = int(raw[0])
    out = np.zeros(((len(raw) - 1) // wide, 8), dtype=np.uint8)
    out[:, :wide] = raw[1:].reshape(-1, wide)
    return out.view("<u8").ravel()


def packed_sorted(x: np.ndarray) -> bytes:
    """Ascending integers as the steps between them."""
    return packed(x[:1]) + packed(np.diff(x))


def unpacked_sorted(blob: bytes) -> np.ndarray:
    first = blob[0] + 1
    return np.cumsum(np.concatenate([unpacked(blob[:first]), unpacked(blob[first:])]), dtype=np.uint64)


def windows(words: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, second hash of 32 bits, index of the row, position of the first word) of the windows that lie within one row."""
    hashes, checks = window_hashes(words, width), window_hashes(words, width, CHECK_BASE)
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    inside = row[: len(hashes)] == row[width - 1 : width - 1 + len(hashes)]
    where = np.flatnonzero(inside)
    return hashes[where], (checks[where] >> np.uint64(32)).astype(np.uint32), row[where], where


def _doc_group(doc: np.ndarray, groups: int) -> np.ndarray:
    return (mixed(doc.astype(np.uint64)) % np.uint64(groups)).astype(np.int64)


def _rows(key: np.ndarray, docs: np.ndarray, hashes: np.ndarray, checks: np.ndarray | None = None):
    """(key, documents, hashes, second hashes if given) for each run of equal keys; within a run hashes ascend."""
    cuts = np.flatnonzero(np.diff(key)) + 1
    for a, b in zip(np.r_[0, cuts], np.r_[cuts, len(key)], strict=True):
        if b > a:
            base = int(docs[a:b].min())
            second = () if checks is None else (checks[a:b].tobytes(),)
            yield int(key[a]), base, packed((docs[a:b] - base).astype(np.uint64)), packed_sorted(hashes[a:b]), *second


_SENT = pa.schema([("bucket", pa.int64()), ("base", pa.int64()), ("docs", pa.binary()), ("hashes", pa.binary()), ("checks", pa.binary())])
_FLAGS = pa.schema([("doc_group", pa.int64()), ("base", pa.int64()), ("docs", pa.binary()), ("hashes", pa.binary())])


def _batch(rows, schema):
    cols = list(zip(*rows, strict=True)) or [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


def _by_document(docs: np.ndarray, hashes: np.ndarray, groups: int):
    """Rows of (document group, ...) for (document, hash) pairs."""
    group = _doc_group(docs, groups)
    order = np.lexsort((hashes, group))
    return _rows(group[order], docs[order], hashes[order])


def _hash_windows(width: int, ranges: int, groups: int, key: bytes):
    """Documents in; hashes by range, and what the task has settled (negative keys: document groups)."""

    def run(batches):
        often = _Least()
        for batch in batches:
            batch = pa.Table.from_batches([batch.filter(batch.column(0).is_valid())])
            _, at = string_bytes(batch.column(1))
            for low, high in slices(np.diff(at), CHUNK):
                part = batch.slice(low, high - low).sort_by("doc_id")
                ids = part.column(0).to_numpy().astype(np.int64)
                words, rows = word_hashes(*string_bytes(part.column(1)), lower=False, key=key)
                hashes, checks, row, _ = windows(words, rows, width)
                if not len(hashes):
                    continue
                hashes, checks, docs, first = _grouped(hashes, checks, ids[row])
                starts = np.flatnonzero(first)
                sizes = np.diff(np.r_[starts, len(docs)])
                own = np.minimum.reduceat(docs, starts)
                least = np.minimum(own, often.of(hashes[starts], checks[starts]))
                known = docs > np.repeat(least, sizes)
                often.add(hashes[starts], checks[starts], least, sizes >= FREQUENT)
                new = own <= least
                sent, theirs = starts[new], own[new]
                bucket = ((hashes[sent] >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
                out = list(_rows(bucket, theirs, hashes[sent], checks[sent]))
                out += [(-1 - g, *rest, b"") for g, *rest in _by_document(docs[known], hashes[known], groups)]
                for i in range(0, len(out), 512):
                    yield _batch(out[i : i + 512], _SENT)

    return run


def _grouped(hashes: np.ndarray, checks: np.ndarray, docs: np.ndarray):
    """The same, ordered by both hashes, and which of them begins a run of equal ones."""
    order = np.argsort(hashes, kind="stable")
    hashes, checks, docs = hashes[order], checks[order], docs[order]
    first = np.r_[True, hashes[1:] != hashes[:-1]]
    if (~first[1:] & (checks[1:] != checks[:-1])).any():
        order = np.lexsort((checks, hashes))
        hashes, checks, docs = hashes[order], checks[order], docs[order]
        first = np.r_[True, (hashes[1:] != hashes[:-1]) | (checks[1:] != checks[:-1])]
    return hashes, checks, docs, first


class _Least:
    """The smallest document of the windows that a task has found to be frequent."""

    NONE = np.iinfo(np.int64).max

    def __init__(self):
        self.hashes, self.checks, self.docs = np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def _at(self, hashes: np.ndarray, checks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the given hashes are, and whether they are there."""
        if not len(self.hashes):
            return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), dtype=bool)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return at, (self.hashes[at] == hashes) & (self.checks[at] == checks)

    def of(self, hashes: np.ndarray, checks: np.ndarray) -> np.ndarray:
        at, there = self._at(hashes, checks)
        out = np.full(len(hashes), self.NONE)
        out[there] = self.docs[at[there]]
        return out

    def add(self, hashes: np.ndarray, checks: np.ndarray, docs: np.ndarray, new: np.ndarray) -> None:
        """Lower what is known; take up ``new`` ones, of windows with equal first hashes one only."""
        at, there = self._at(hashes, checks)
        self.docs[at[there]] = np.minimum(self.docs[at[there]], docs[there])
        new = new & ~there
        if len(self.hashes):
            new &= self.hashes[at] != hashes
        if new.any():
            all_hashes = np.concatenate([self.hashes, hashes[new]])
            self.hashes, first = np.unique(all_hashes, return_index=True)
            self.checks, self.docs = np.concatenate([self.checks, checks[new]])[first], np.concatenate([self.docs, docs[new]])[first]


def _repeated(groups: int):
    """One range of hashes in; by document group, the hashes that a smaller document has."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        if rows and rows[0]["bucket"] < 0:
            return pa.Table.from_batches([_batch([(-1 - r["bucket"], r["base"], r["docs"], r["hashes"]) for r in rows], _FLAGS)])
        docs = np.concatenate([unpacked(r["docs"]).astype(np.int64) + r["base"] for r in rows])
        hashes = np.concatenate([unpacked_sorted(r["hashes"]) for r in rows])
        checks = np.concatenate([np.frombuffer(r["checks"], np.uint32) for r in rows])
        hashes, _, docs, first = _grouped(hashes, checks, docs)
        starts = np.flatnonzero(first)
        late = docs > np.repeat(np.minimum.reduceat(docs, starts), np.diff(np.r_[starts, len(docs)]))
        return pa.Table.from_batches([_batch(list(_by_document(docs[late], hashes[late], groups)), _FLAGS)])

    return run


def _slots(batches):
    """Which words of the fixed-size filter the flagged documents set."""
    for batch in batches:
        bits = np.zeros(FILTER_BITS // 64, dtype=np.int64)
        for row in batch.to_pylist():
            slot = (mixed(np.unique(unpacked(row["docs"]) + np.uint64(row["base"] % (1 << 64)))) % np.uint64(FILTER_BITS)).astype(np.int64)
            np.bitwise_or.at(bits, slot >> 6, np.int64(1) << (slot & 63))
        used = np.flatnonzero(bits)
        yield pa.RecordBatch.from_pydict({"w": used, "b": bits[used]})


def _flagged_filter(flags: DataFrame) -> np.ndarray:
    merged = flags.select("base", "docs").mapInArrow(_slots, "w long, b long").groupBy("w").agg(F.bit_or("b").alias("b")).toPandas()
    out = np.zeros(FILTER_BITS // 64, dtype=np.int64)
    out[merged["w"].to_numpy(dtype=np.int64)] = merged["b"].to_numpy(dtype=np.int64)
    return out


_OUT = "doc_id long, n_words long, n_removed long, intervals array<struct<start:long,end:long>>, kept_text string"
_OUT_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("intervals", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept_text", pa.string())]
)


def _whole(row_id, text):
    words = (text or "").encode().split()
    return row_id, len(words), 0, [], b" ".join(words).decode()


def _emit(rows):
    size, part = 0, []
    for row in rows:
        part.append(row)
        size += len(row[4])
        if size > CHUNK:
            yield _batch(part, _OUT_ARROW)
            size, part = 0, []
    if part:
        yield _batch(part, _OUT_ARROW)


def _keep_all(held: np.ndarray):
    """Documents outside the filter: all their words stay."""

    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            slot = (mixed(ids.fill_null(0).to_numpy().astype(np.uint64)) % np.uint64(FILTER_BITS)).astype(np.int64)
            out = ~in_filter(held, slot) | np.asarray(ids.is_null())
            part = batch.filter(pa.array(out))
            yield from _emit(map(_whole, part.column(0).to_pylist(), part.column(1).to_pylist()))

    return run


def _maybe_flagged(held: np.ndarray, groups: int):
    """Documents that the filter holds, with their group."""

    def run(batches):
        for batch in batches:
            batch = batch.filter(batch.column(0).is_valid())
            ids = batch.column(0).to_numpy().astype(np.int64)
            slot = (mixed(ids.astype(np.uint64)) % np.uint64(FILTER_BITS)).astype(np.int64)
            part = batch.filter(pa.array(in_filter(held, slot)))
            group = _doc_group(part.column(0).to_numpy().astype(np.int64), groups)
            yield pa.RecordBatch.from_arrays([pa.array(group, pa.int64()), part.column(0), part.column(1)], ["doc_group", "doc_id", "text"])

    return run


def _cut(width: int, key: bytes):
    """The documents of a group and their repeated hashes in; documents without the repeated words out."""

    def run(docs: pa.Table, flags: pa.Table) -> pa.Table:
        wanted = [np.zeros(0, np.uint64)]
        for r in flags.to_pylist():
            of = unpacked(r["docs"]) + np.uint64(r["base"] % (1 << 64))
            wanted.append(unpacked_sorted(r["hashes"]) ^ mixed(of))
        wanted = np.unique(np.concatenate(wanted))
        out = []
        raw, at = string_bytes(docs.column("text")) if docs.num_rows else (None, np.zeros(1, np.int64))
        for low, high in slices(np.diff(at), CHUNK):
            part = docs.slice(low, high - low)
            ids = part.column("doc_id").to_numpy().astype(np.int64)
            words, rows = word_hashes(*string_bytes(part.column("text")), lower=False, key=key)
            hashes, _, row, where = windows(words, rows, width)
            hit = where[np.isin(hashes ^ mixed(ids[row].astype(np.uint64)), wanted)]
            step = np.zeros(len(words) + 1, dtype=np.int64)
            np.add.at(step, hit, 1)
            np.add.at(step, hit + width, -1)
            gone = np.cumsum(step[:-1]) > 0
            for i, text in enumerate(part.column("text").to_pylist()):
                a, b = int(rows[i]), int(rows[i + 1])
                if not gone[a:b].any():
                    out.append(_whole(int(ids[i]), text))
                    continue
                mask = gone[a:b]
                edge = np.flatnonzero(np.diff(np.r_[False, mask, False].astype(np.int8)))
                spans = [{"start": int(s), "end": int(e)} for s, e in zip(edge[::2], edge[1::2], strict=True)]
                kept = [w for w, g in zip(text.encode().split(), mask.tolist(), strict=True) if not g]
                out.append((int(ids[i]), b - a, int(mask.sum()), spans, b" ".join(kept).decode()))
        return pa.Table.from_batches(list(_emit(out)) or [_batch([], _OUT_ARROW)])

    return run


def remove_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = WIDTH) -> DataFrame:
    """``docs`` without the words that repeat windows of documents with smaller ids.

    A window is ``width`` consecutive words of one document; it is repeated if
    its words also start somewhere in a document with a smaller id.  Columns:
    ``doc_id``, ``n_words``, ``n_removed``, ``intervals`` (maximal runs of
    removed words, end exclusive), ``kept_text`` (the rest, one space between
    words).

    Null and empty texts have no words.  Texts shorter than a window are kept.
    Rows with a null id are neither compared nor cut.  Rows that repeat an id
    don't cut each other and both come back.  An empty table gives an empty
    result; other columns are not read.  Texts of any length are hashed whole,
    a few megabytes of words at a time; a task holds its longest text.  Windows
    are told apart by 96 bits, words by 64 of a key drawn for each run: no two
    words can be built to share them.
    """
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    small_batches(docs.sparkSession)
    mb = text_mb(docs)
    ranges = groups = int(mb / RANGE_MB) + 1
    key = fresh_key()
    tasks = partitions(docs.sparkSession, mb)
    sent = docs.mapInArrow(_hash_windows(width, ranges, groups, key), "bucket long, base long, docs binary, hashes binary, checks binary")
    flags = staged(sent.repartition(tasks, "bucket").groupBy("bucket").applyInArrow(_repeated(groups), "doc_group long, base long, docs binary, hashes binary"), "repeats")
    held = _flagged_filter(flags)
    some = docs.mapInArrow(_maybe_flagged(held, groups), "doc_group long, doc_id long, text string")
    some, flags = some.repartition(tasks, "doc_group"), flags.repartition(tasks, "doc_group")
    cut = some.groupBy("doc_group").cogroup(flags.groupBy("doc_group")).applyInArrow(_cut(width, key), _OUT)
    return docs.mapInArrow(_keep_all(held), _OUT).unionByName(cut)


def op2_substring_dedup(spark, sf_dir: str) -> DataFrame:
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


QUERIES = {"op2_substring_dedup": op2_substring_dedup}

ORACLE_SQL = {
    "op2_substring_dedup": r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
win AS (SELECT doc_id, p, md5(array_to_string(w[p:p + 12], ' ')) AS h FROM d, unnest(generate_series(1, len(w) - 12)) AS t(p)),
least_doc AS (SELECT h, min(doc_id) AS m FROM win GROUP BY h),
gone AS (SELECT DISTINCT doc_id, p + k AS p FROM win JOIN least_doc USING (h), unnest(generate_series(0, 12)) AS t(k) WHERE m < doc_id),
word AS (SELECT doc_id, p, w[p] AS word FROM d, unnest(generate_series(1, len(w))) AS t(p)),
kept AS (SELECT word.doc_id, string_agg(word, ' ' ORDER BY p) AS s FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY word.doc_id),
cut AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
FROM d LEFT JOIN cut USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
}
