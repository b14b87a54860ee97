"""Language identification by bit-sliced Bloom filters of n-grams.

Each slot of the filter holds one bit for each language, so one look-up tells
all languages that have an n-gram.  A document counts, for each language, the
n-grams that the filter says it has, takes off those that a filter of that fill
says by chance, and the largest count decides.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .rolling import mixed, slices, string_bytes
from .shared import lean, small_batches, staged

#: Bytes of the n-grams.
LENGTHS = (3, 4)
#: Slots of the filter and look-ups for each n-gram; 8 MB for each 63 languages, at any size of the corpus.
SLOTS, LOOKUPS = 1 << 20, 3
#: Languages in one word of a slot.
WORD = 63
#: A language has an n-gram whose share of its text is at least ``LEAST_SHARE``, and ``NEAR`` of the largest share in any language.
LEAST_SHARE, NEAR = 1e-6, 0.25
#: Bytes of text at a time.
CHUNK = 1 << 19
UNKNOWN = "und"

_SPACE = np.uint8(32)
_LETTERS = np.arange(256, dtype=np.uint8)
_LETTERS[:128] = _SPACE
for _a, _z in ((65, 91), (97, 123)):
    _LETTERS[_a:_z] = np.arange(97, 123)


def grams(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n-gram keys, row of each) of lower-case UTF-8 texts.

    All but letters and non-ASCII characters is white space, runs of it count
    once, and every text stands between two spaces.
    """
    n_rows = len(at) - 1
    # A space before and after each row.
    padded = np.full(len(raw) + 2 * n_rows, _SPACE)
    row = np.repeat(np.arange(n_rows), np.diff(at))
    padded[np.arange(len(raw)) + 2 * row + 1] = _LETTERS[raw]
    row = np.repeat(np.arange(n_rows), np.diff(at) + 2)
    space = padded == _SPACE
    keep = np.ones(len(padded), dtype=bool)
    keep[1:] = ~(space[1:] & space[:-1] & (row[1:] == row[:-1]))
    text, row = padded[keep].astype(np.uint32), row[keep]
    keys, rows = [], []
    for n in LENGTHS:
        m = len(text) - n + 1
        if m <= 0:
            continue
        key = np.zeros(m, dtype=np.uint32)
        for j in range(n):
            key |= text[j : j + m] << np.uint32(8 * j)
        inside = row[:m] == row[n - 1 :]
        keys.append(key[inside])
        rows.append(row[:m][inside])
    return (np.concatenate(keys), np.concatenate(rows)) if keys else (np.zeros(0, np.uint32), np.zeros(0, np.int64))


def _merged(keys, counts):
    keys, counts = np.concatenate(keys), np.concatenate(counts)
    found, where = np.unique(keys, return_inverse=True)
    return found, np.bincount(where, weights=counts, minlength=len(found)).astype(np.int64)


def _count(batches):
    """(text, lang) in; n-gram counts of the whole partition by language out."""
    held: dict[str, tuple[list, list]] = {}
    for batch in batches:
        raw, at = string_bytes(batch.column(0))
        langs = np.array(batch.column(1).to_pylist(), dtype=object)
        for low, high in slices(np.diff(at), CHUNK):
            keys, rows = grams(raw[at[low] : at[high]], at[low : high + 1] - at[low])
            own = langs[low:high]
            for lang in set(own):
                found, n = np.unique(keys[(own == lang)[rows]], return_counts=True)
                part = held.setdefault(lang, ([], []))
                part[0].append(found)
                part[1].append(n)
                if sum(map(len, part[0])) > 2_000_000:
                    found, n = _merged(*part)
                    held[lang] = ([found], [n])
    for lang, part in held.items():
        found, n = _merged(*part)
        for i in range(0, len(found), 50_000):
            key, some = found[i : i + 50_000], n[i : i + 50_000]
            yield pa.RecordBatch.from_pydict({"lang": [lang] * len(key), "gram": key.astype(np.int64), "n": some})


def _slots_of(keys: np.ndarray) -> list[np.ndarray]:
    h = mixed(keys.astype(np.uint64) + np.uint64(1))
    return [((h >> np.uint64(20 * j)) % np.uint64(SLOTS)).astype(np.int64) for j in range(LOOKUPS)]


def _fill(batches):
    """(gram, word, mask) in; (slot, word, mask) of each look-up out."""
    for batch in batches:
        word, mask = batch.column(1).to_numpy(), batch.column(2).to_numpy()
        slots = _slots_of(batch.column(0).to_numpy())
        yield pa.RecordBatch.from_pydict({"slot": np.concatenate(slots), "word": np.tile(word, LOOKUPS), "mask": np.tile(mask, LOOKUPS)})


class Filters:
    """The languages, and for each slot a bit for each of them, :data:`WORD` bits in a word."""

    def __init__(self, langs: list[str], table: np.ndarray, fallback: str | None):
        self.langs, self.table, self.fallback = langs, table, fallback
        fill = [np.count_nonzero(table[j // WORD] & (np.uint64(1) << np.uint64(j % WORD))) / table.shape[1] for j in range(len(langs))]
        self.chance = np.array(fill) ** LOOKUPS

    def corrected_counts(self, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
        """For each row and language, the n-grams found less those expected by chance."""
        keys, rows = grams(raw, at)
        slots = _slots_of(keys)
        n_rows = len(at) - 1
        total = np.bincount(rows, minlength=n_rows)
        out = np.zeros((n_rows, len(self.langs)))
        for j in range(len(self.langs)):
            if j % WORD == 0:
                mask = np.full(len(keys), ~np.uint64(0))
                for slot in slots:
                    mask &= self.table[j // WORD][slot]
            hits = np.bincount(rows[(mask >> np.uint64(j % WORD)) & np.uint64(1) == 1], minlength=n_rows)
            out[:, j] = np.maximum(0, (hits - total * self.chance[j]) / max(1e-9, 1 - self.chance[j]))
        return out


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", near: float = NEAR) -> Filters:
    """Filters from the rows of ``docs`` whose ``lang`` is not null.

    Counts cover all rows; n-grams are counted by partition, then merged by
    key.  The driver gets the languages and the masks of the slots: at most
    ``SLOTS`` of them for each 63 languages.  Null and empty texts add nothing,
    but their ``lang`` counts as one to be learned if another row of it has an
    n-gram.  Repeated rows count as often as they occur.  Without a labelled
    row nothing is learned.
    """
    rows = docs.where(F.col(lang).isNotNull()).select(F.lower(F.coalesce(F.col(text), F.lit(""))).alias("text"), F.col(lang).cast("string").alias("lang"))
    counted = staged(rows.mapInArrow(lean(_count), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams")
    totals = {r["lang"]: r["n"] for r in counted.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    langs = sorted(totals)
    words = max(1, -(-len(langs) // WORD))
    table = np.zeros((words, SLOTS), dtype=np.uint64)
    if not langs:
        return Filters([], table, None)
    entry = lambda k, v: F.struct(F.lit(k // WORD).alias("word"), F.lit(1 << k % WORD).cast("long").alias("bit"), F.lit(float(totals[v])).alias("total"))
    of = F.create_map(*[x for k, v in enumerate(langs) for x in (F.lit(v), entry(k, v))])
    known = counted.select("gram", "n", of[F.col("lang")].alias("of"))
    shares = known.select("gram", "of.word", "of.bit", (F.col("n") / F.col("of.total")).alias("share"))
    largest = shares.groupBy("gram").agg(F.max("share").alias("most"), F.collect_list(F.struct("word", "bit", "share")).alias("each")).where(F.col("most") >= LEAST_SHARE)
    bits = largest.select("gram", F.explode(F.filter("each", lambda x: x["share"] >= near * F.col("most"))).alias("x"))
    filled = bits.select("gram", "x.word", "x.bit").mapInArrow(lean(_fill), "slot long, word int, mask long").groupBy("slot", "word").agg(F.bit_or("mask").alias("mask")).toPandas()
    table[filled["word"].to_numpy(dtype=np.int64), filled["slot"].to_numpy(dtype=np.int64)] = filled["mask"].to_numpy(dtype=np.int64).view(np.uint64)
    return Filters(langs, table, max(langs, key=lambda x: (totals[x], x)))


def _predict(shared):
    def run(batches):
        filters = shared.value
        names = np.array([*filters.langs, UNKNOWN], dtype=object)
        for batch in batches:
            raw, at = string_bytes(batch.column(0))
            lettered = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            best, score = np.full(len(lettered), len(filters.langs)), np.zeros(len(lettered))
            if filters.langs:
                for low, high in slices(np.diff(at), CHUNK):
                    counts = filters.corrected_counts(raw[at[low] : at[high]], at[low : high + 1] - at[low])
                    top = np.sort(counts, axis=1)[:, ::-1]
                    second = top[:, 1] if top.shape[1] > 1 else np.zeros(len(top))
                    best[low:high] = np.where(top[:, 0] > 0, counts.argmax(axis=1), filters.langs.index(filters.fallback))
                    score[low:high] = np.divide(top[:, 0], top[:, 0] + second, out=np.zeros(len(top)), where=top[:, 0] > 0)
                best[~lettered], score[~lettered] = len(filters.langs), 0.0
            cols = [pa.array(names[best].tolist(), pa.string()), pa.array(score)]
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], *cols], [*batch.schema.names[2:], "lang_pred", "score"])

    return run


def predict(docs: DataFrame, filters: Filters, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep`` of ``docs`` with ``lang_pred`` and ``score``.

    ``score`` is the best language's share of the counts of the two best, so 0.5
    to 1, or 0 where no n-gram is known; such texts get the most common
    language learned.  Of languages with equal counts the first by name wins.
    Null texts and texts without a letter get ``und`` and 0, and so does
    everything if nothing was learned.  Texts of any length count whole; a task
    holds its longest one.  Columns of ``keep`` that are named
    ``lang_pred`` or ``score`` give way to the new ones.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(filters)  # 8 MB for each 63 languages
    keep = [c for c in keep if c not in ("lang_pred", "score")]
    texts = [F.lower(F.coalesce(F.col(text), F.lit(""))).alias("_text"), F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias("_lettered")]
    rows = docs.select(*texts, *[F.col(f"`{c}`") for c in keep])
    kinds = T.StructType([*rows.schema.fields[2:], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(lean(_predict(shared)), kinds)


def held_out(doc_id: str = "doc_id", folds: int = 5, fold: int = 0):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == fold, F.lit(False))


def op9_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", held_out().alias("held_out"))
    return predict(docs, learn(docs.where("NOT held_out")), ["doc_id", "held_out"])


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in a language that was learned; those without any letter go.

    If no row has a language, nothing can be learned and no language rejected:
    then all documents with a letter stay.  Null and repeated ids play no part
    (rows with a null id are learned from).  All columns come back, whatever
    their names.
    """
    filters = learn(docs.where(~held_out()))
    if not filters.langs:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    rows = docs.select("text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return predict(rows, filters, ["row"]).where(F.col("lang_pred") != UNKNOWN).select("row.*")


QUERIES = {"op9_language_id": op9_language_id}
ORACLE_SQL: dict[str, str] = {}
