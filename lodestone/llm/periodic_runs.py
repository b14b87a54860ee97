"""Runs of words that repeat with a period: found by maximal pairs in a tree of LCP intervals.

Two places of a text make a maximal pair if the words from both are equal as
far as possible to the right and the words before them differ.  If their
distance p is at most half of the common length l, the stretch from the first
to the end of the second has period p, l + p words and can't be extended: it is
a run, and every run with at least three periods is such a pair.

The pairs come from the suffix array of a text's words (by doubling, in numpy)
and its intervals of common prefixes, walked from the deepest to the root.  An
interval keeps the places below it in order, with the word to the left of each,
and the smaller list is merged into the larger one.  Places of one interval no
further apart than half its depth stand at equal distances, and all but the
first have the same word to the left.  So a run's first two places are
neighbours when their lists meet, and lists with one and the same left word
throughout have no pair at all.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import lean, small_batches

#: Words and periods that a run has at least.
LEAST, TIMES = 24, 3
#: Words of the texts that are looked through at once; one longer text is looked through alone.
AT_ONCE = 1 << 20


def suffix_ranks(codes: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """For k = 1, 2, 4, ...: the rank of each place among all by its next k words, until all differ.

    ``ends`` has for each place the end of its text; words never count beyond
    it.  Equal ranks mean equal words.  Only places that are still tied are
    sorted again.
    """
    n = len(codes)
    order = np.argsort(codes, kind="stable")
    fresh = np.r_[True, codes[order][1:] != codes[order][:-1]]
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    levels, k = [rank], 1
    tied = order[_tied(fresh)]
    while len(tied):
        later = tied + k
        beyond = later >= ends[tied]
        second = np.where(beyond, 0, rank[np.minimum(later, n - 1)] + 1)
        key = rank[tied] * (n + 1) + second
        by = np.argsort(key, kind="stable")
        tied, key = tied[by], key[by]
        group = rank[tied]
        at = np.arange(len(tied))
        opens = np.r_[True, group[1:] != group[:-1]]
        fresh = np.r_[True, key[1:] != key[:-1]]
        inside = at - np.maximum.accumulate(np.where(opens, at, 0))
        start = np.maximum.accumulate(np.where(fresh, at, 0))
        rank = rank.copy()
        rank[tied] = group + inside[start]
        levels.append(rank)
        tied, k = tied[_tied(fresh)], 2 * k
    return levels


def _tied(fresh: np.ndarray) -> np.ndarray:
    """Which places of an order share their key with a neighbour; ``fresh`` marks where a new key begins."""
    return ~(fresh & np.r_[fresh[1:], True])


def common_lengths(levels: list[np.ndarray], ends: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many words from places ``a`` and ``b`` on are equal."""
    n, out = len(ends), np.zeros(len(a), dtype=np.int64)
    for level in range(len(levels) - 1, -1, -1):
        x, y, rank = np.minimum(a + out, n - 1), np.minimum(b + out, n - 1), levels[level]
        same = (a + out < ends[a]) & (b + out < ends[b]) & (rank[x] == rank[y])
        out += same * (1 << level)
    return out


def _windows_repeat(codes: np.ndarray, text_of: np.ndarray, ends: np.ndarray, width: int, texts: int) -> np.ndarray:
    """Which texts have some ``width`` words twice, by hashes: a text without is left alone, one with others is looked at in full."""
    n = len(codes)
    rng = np.random.default_rng(width)
    with np.errstate(over="ignore"):
        h = rng.integers(1, 1 << 63, int(codes.max()) + 1, dtype=np.uint64)[codes]
        have = 1
        while have < width:
            step = min(have, width - have)
            h = h[:-step] * np.uint64(0x9E3779B97F4A7C15 | 1) + (h[step:] ^ (h[step:] >> np.uint64(29)))
            have += step
        inside = np.flatnonzero(np.arange(len(h)) + width <= ends[: len(h)])
        keys = h[inside] ^ (text_of[inside].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    order = np.argsort(keys)
    twice = keys[order][1:] == keys[order][:-1]
    found = np.zeros(texts, dtype=bool)
    found[text_of[inside[order[1:][twice]]]] = True
    return found


class _Interval:
    """Places below an LCP interval, in order, and the word to the left of all of them if it is one."""

    __slots__ = ("depth", "left", "places")

    def __init__(self, depth: int, places: list[int], left: int | None):
        self.depth, self.places, self.left = depth, places, left


def _meet(a: _Interval, b: _Interval, depth: int, left: np.ndarray, least: int, times: int, found: list) -> _Interval:
    """``a`` and ``b`` as one interval of ``depth``; the maximal pairs across them that are runs go to ``found``."""
    large, small = (a, b) if len(a.places) >= len(b.places) else (b, a)
    places = large.places
    if large.left is None or large.left != small.left:
        for i in small.places:
            at = bisect_left(places, i)
            for x in places[max(at - 1, 0) : at + 1]:
                p = abs(i - x)
                if p * (times - 1) <= depth and p + depth >= least and left[i] != left[x]:
                    found.append((min(i, x), p + depth, p))
    if 8 * len(small.places) > len(places):
        places = sorted(places + small.places)
    else:
        for i in small.places:
            insort(places, i)
    return _Interval(depth, places, large.left if large.left == small.left else None)


def _runs_below(places: list[int], shared: list[int], left: np.ndarray, least: int, times: int) -> list[tuple[int, int, int]]:
    """Runs among neighbours in suffix order with ``shared`` first words, bottom-up."""
    found: list[tuple[int, int, int]] = []
    leaf = lambda i: _Interval(0, [i], int(left[i]))
    stack: list[_Interval] = []
    now = leaf(places[0])
    for depth, place in zip([*shared, 0], [*places[1:], -1], strict=True):
        while stack and stack[-1].depth > depth:
            top = stack.pop()
            now = _meet(top, now, top.depth, left, least, times, found)
        if place < 0:
            break
        if stack and stack[-1].depth == depth:
            stack[-1] = _meet(stack[-1], now, depth, left, least, times, found)
        else:
            now.depth = depth
            stack.append(now)
        now = leaf(place)
    return found


def runs_of(texts: list[np.ndarray], least: int = LEAST, times: int = TIMES) -> list[list[tuple[int, int, int]]]:
    """For each text, given as numbers of words, its runs (start, length, period) by start and period.

    A run has at least ``least`` words and ``times`` smallest periods (three or
    more), and no neighbouring word continues it.
    """
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    # A pair's common length: p + l >= least and l >= (times - 1) * p.
    shortest = -(-least * (times - 1) // times)
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    if not len(sizes) or sizes.max() < least:
        return out
    codes = np.concatenate(texts).astype(np.int64)
    text_of = np.repeat(np.arange(len(texts)), sizes)
    ends = np.repeat(np.cumsum(sizes), sizes)
    some = _windows_repeat(codes, text_of, ends, shortest, len(texts)) if len(codes) >= shortest else np.zeros(len(texts), dtype=bool)
    if not some.any():
        return out
    kept = some[text_of]
    numbers = np.flatnonzero(some)
    codes, text_of = codes[kept], np.repeat(np.arange(len(numbers)), sizes[some])
    ends = np.repeat(np.cumsum(sizes[some]), sizes[some])
    starts = np.cumsum(sizes[some]) - sizes[some]
    n = len(codes)
    levels = suffix_ranks(text_of * (int(codes.max()) + 1) + codes, ends)  # words of two texts are never the same
    array = np.empty(n, dtype=np.int64)
    array[levels[-1]] = np.arange(n)
    left = np.r_[-1, codes[:-1]]
    left[starts] = -1  # no word, unlike any
    named = levels[min(shortest.bit_length() - 1, len(levels) - 1)]  # equal for the first 2^k <= shortest words
    near = np.flatnonzero(named[array[1:]] == named[array[:-1]])
    shared = common_lengths(levels, ends, array[near], array[near + 1])
    near, shared = near[shared >= shortest], shared[shared >= shortest]
    del levels
    cuts = np.flatnonzero(np.diff(near) != 1) + 1
    for at, depth in zip(np.split(near, cuts), np.split(shared, cuts), strict=True):
        if not len(at):
            continue
        places = array[at[0] : at[-1] + 2]
        if np.diff(np.sort(places)).min() * (times - 1) > depth.max():
            continue  # too far apart
        of = int(text_of[places[0]])
        for start, length, period in _runs_below(places.tolist(), depth.tolist(), left, least, times):
            out[numbers[of]].append((start - int(starts[of]), length, period))
    for number in numbers.tolist():
        # A run shows with multiples of its period too: the smallest counts.
        smallest: dict[tuple[int, int], int] = {}
        for start, length, period in out[number]:
            smallest[start, length] = min(period, smallest.get((start, length), period))
        out[number] = sorted(((start, length, period) for (start, length), period in smallest.items()), key=lambda r: (r[0], r[2]))
    return out


def best_of(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with most periods, by exact fractions; the first of equals."""
    best = None
    for run in runs:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def collapsed_words(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """``words`` with each run cut to its first period: a word goes if any run has it behind that."""
    keep = np.ones(len(words), dtype=bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return words if not runs else [words[i] for i in np.flatnonzero(keep).tolist()]


RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_SCHEMA = "n_words long, runs array<struct<start:long,length:long,period:long>>, best struct<start:long,length:long,period:long>, collapsed string"


def _looked_through(least: int, times: int):
    def run(batches):
        for batch in batches:
            low = 0
            while low < batch.num_rows:
                words, held, high = [], 0, low
                while high < batch.num_rows and held < AT_ONCE:
                    words.append((batch.column(1)[high].as_py() or "").encode().split())
                    held += len(words[-1])
                    high += 1
                sizes = np.array([len(w) for w in words])
                codes = pa.array([w for text in words for w in text], pa.binary()).dictionary_encode().indices.to_numpy()
                runs = runs_of(np.split(codes, np.cumsum(sizes)[:-1]), least, times)
                row = lambda r: None if r is None else dict(zip(("start", "length", "period"), r, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(low, high - low),
                        pa.array(sizes, pa.int64()),
                        pa.array([[row(r) for r in rs] for rs in runs], pa.list_(RUN)),
                        pa.array([row(best_of(rs)) for rs in runs], RUN),
                        pa.array([b" ".join(collapsed_words(w, rs)).decode() for w, rs in zip(words, runs, strict=True)], pa.string()),
                    ],
                    ["doc_id", "n_words", "runs", "best", "collapsed"],
                )
                low = high

    return lean(run)


def find_runs(docs: DataFrame, text: str | Column = "text", doc_id: str = "doc_id", least: int = LEAST, times: int = TIMES) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``n_words``, ``runs``, ``best`` and ``collapsed``.

    Words are what ASCII white space parts.  ``runs`` are stretches of at least
    ``least`` words and ``times`` (three or more) of their smallest period that
    no neighbouring word continues, by start and period; ``best`` is the one
    with most periods (ties: first start, then smallest period; null without
    runs).  ``collapsed`` is the text with every run cut to its first period,
    words joined by one space.

    Rows are judged one by one, so null and repeated ids and repeated rows are
    just rows.  Null texts count as empty and have no runs.  An empty table
    gives an empty result; other columns are not read.  A text of any length is
    looked through whole: a task holds some 250 bytes for each word of its
    longest text, or of :data:`AT_ONCE` words.  There is no shuffle.
    """
    small_batches(docs.sparkSession)
    column = F.col(text) if isinstance(text, str) else text
    rows = docs.select(F.col(doc_id).alias("doc_id"), column.alias("text"))
    return rows.mapInArrow(_looked_through(least, times), f"doc_id {dict(rows.dtypes)['doc_id']}, {_SCHEMA}")


def periodised(text: str = "text", doc_id: str = "doc_id") -> Column:
    """The text, which in one document of ten is made periodic from some word on: the query's own input."""
    h = F.crc32(F.col(doc_id).cast("string"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), 0)

    def changed(w: Column) -> Column:
        n = F.size(w)
        start = F.pmod(g, n).cast("int")
        period = (1 + F.floor((n - start) / (3 + F.pmod(g, F.lit(8))))).cast("int")
        return F.concat(F.slice(w, 1, start), F.slice(F.flatten(F.array_repeat(F.slice(w, start + 1, period), F.ceil((n - start) / period).cast("int"))), 1, n - start))

    # A lambda's variable, so that the words are split once.
    made = F.transform(F.array(words), lambda w: F.array_join(changed(w), " "))[0]
    return F.when((F.pmod(h, F.lit(10)) == 0) & F.coalesce(F.col(text).rlike(r"[^\x20\x09-\x0D]"), F.lit(False)), made).otherwise(F.col(text))


def op13_periodic_runs(spark, sf_dir: str) -> DataFrame:
    found = find_runs(spark.read.parquet(f"{sf_dir}/documents.parquet"), periodised())
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES = {"op13_periodic_runs": op13_periodic_runs}

#: Runs need all periods of all stretches, which SQL only tries one by one; tests compare with that.
ORACLE_SQL: dict[str, str] = {}
