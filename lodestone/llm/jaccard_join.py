"""N-gram Jaccard join: which documents share at least 85 % of their word shingles.

Each document's set of shingle hashes is a sorted array.  Two sets that reach
the threshold share one of the first few elements of both (the prefix) in any
fixed order of the shingles, and their sizes differ little.  So documents meet
in tiles: one per prefix shingle and band of sizes.  Within a tile, bitmaps of
the hashed shingles bound every overlap from above by a bit count, and what
passes is intersected exactly as sorted arrays.

Large groups of copies are not multiplied out.  Equal sets count as one.  Each
tile first links its documents to its smallest one, its hub; only tiles that
then still hold several components are compared in full, by blocks of fixed
size.  Near copies meet in many tiles; those of one hub become one tile where
that is less work, so that a pair comes up about once and not once a tile.
Pairs of such a tile are settled in its task and only links that join two
components leave it, so what is shuffled grows with the tile's documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .rolling import fresh_key, mixed, slices, string_bytes, window_hashes, word_hashes
from .shared import filter_slot, id_filter, in_filter, lean, small_batches, staged

#: Words of a shingle, and the least similarity in percent.
SHINGLE, PERCENT = 4, 85
#: Least bits of a bitmap, documents of a block of a tile, bytes hashed at a time.
BITS, BLOCK, CHUNK = 256, 1024, 4 << 20
#: Bytes of a block's sorted arrays, about; a block of longer sets has fewer documents.
BLOCK_BYTES = 32 << 20
#: Bits of a bitmap for each element, at least: with fewer, unlike sets pass the bound.
DENSITY = 2
#: Counters of the sketch that finds common shingles, one for every ``DOCS_EACH`` documents within these bounds.
COUNTERS, MOST_COUNTERS, DOCS_EACH = 1 << 18, 1 << 24, 4
#: A counter is common above ``COMMON`` and ``EXCESS`` times the mean.
COMMON, EXCESS = 1000, 8
#: Low bits of a shingle's hash that its key in a tile leaves out; keys that then collide meet in vain.
SHORTER = 16


def shingle_sets(raw: np.ndarray, at: np.ndarray, width: int, key: bytes):
    """The sorted distinct shingle hashes of each row."""
    words, rows = word_hashes(raw, at, lower=True, key=key)
    full = window_hashes(words, width)
    for a, b in zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True):
        if b - a >= width:
            yield np.unique(full[a : b - width + 1])
        elif b > a:
            yield window_hashes(words[a:b], b - a)
        else:
            yield full[:0]


def prefix_length(n: int, percent: int) -> int:
    """How many first elements two sets must share one of: the overlap is at least ``percent`` of either."""
    return n - (percent * n + 99) // 100 + 1


def bitmap(u: np.ndarray) -> bytes:
    """Parities of the hashed elements, at least :data:`DENSITY` bits for each of them.

    Each element flips one bit, so bits that differ are at most elements that
    differ.  The number of bits is a power of two, and a bitmap folds to half
    by exclusive or, so bitmaps of any two sizes compare.
    """
    bits = max(BITS, 1 << max(0, DENSITY * len(u) - 1).bit_length())
    slot = (mixed(u ^ np.uint64(0xA5A5)) % np.uint64(bits)).astype(np.int64)
    return np.packbits((np.bincount(slot, minlength=bits) & 1).astype(np.uint8)).tobytes()


def folded(bits: bytes, size: int) -> np.ndarray:
    """The bitmap in ``size`` bytes, as 64-bit words."""
    words = np.frombuffer(bits, np.uint64)
    return np.bitwise_xor.reduce(words.reshape(-1, size // 8), axis=0) if len(bits) > size else words


def _counter(u: np.ndarray, counters: int) -> np.ndarray:
    return (mixed(u ^ np.uint64(0x33)) % np.uint64(counters)).astype(np.int64)


def _prefix(u: np.ndarray, percent: int, common: np.ndarray | None) -> np.ndarray:
    """The first elements of a set: common ones last, else by hash.  ``common`` holds a bit for each counter."""
    if common is not None:
        at = _counter(u, 8 * len(common))
        late = (common[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & np.uint8(1)).astype(bool)
        u = np.concatenate([u[~late], u[late]])
    return u[: prefix_length(len(u), percent)]


def _count_prefixes(width: int, percent: int, counters: int, key: bytes):
    """A sketch of how many documents have each shingle in their prefix: one counter for many shingles."""

    def run(batches):
        total = np.zeros(counters, dtype=np.int32)
        for batch in batches:
            raw, at = string_bytes(batch.column(0))
            for low, high in slices(np.diff(at), CHUNK):
                sets = shingle_sets(raw[at[low] : at[high]], at[low : high + 1] - at[low], width, key)
                met = np.concatenate([_counter(_prefix(u, percent, None), counters) for u in sets if len(u)] or [np.zeros(0, np.int64)])
                found, n = np.unique(met, return_counts=True)
                total[found] += n.astype(np.int32)
        used = np.flatnonzero(total)
        for i in range(0, len(used), 50_000):
            yield pa.RecordBatch.from_pydict({"counter": used[i : i + 50_000], "n": total[used[i : i + 50_000]].astype(np.int64)})

    return run


_SETS = "doc_id long, n long, s1 long, s2 long, bits binary, prefix array<long>"


def _signatures(width: int, percent: int, common: np.ndarray | None, key: bytes):
    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_pylist()
            raw, at = string_bytes(batch.column(1))
            for low, high in slices(np.diff(at), CHUNK):
                out = []
                for u in shingle_sets(raw[at[low] : at[high]], at[low : high + 1] - at[low], width, key):
                    if not len(u):
                        out.append((0, 0, 0, b"", np.zeros(0, np.int64)))
                        continue
                    sums = [int(mixed(u ^ np.uint64(k)).sum(dtype=np.uint64).view(np.int64)) for k in (0x11, 0x22)]
                    keys = np.unique(_prefix(u, percent, common) >> np.uint64(SHORTER))
                    out.append((len(u), *sums, bitmap(u), keys.view(np.int64)))
                n, s1, s2, bits, prefix = zip(*out, strict=True)
                flat = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, prefix)]), pa.int32()), pa.array(np.concatenate(prefix), pa.int64()))
                cols = [pa.array(ids[low:high], pa.int64()), pa.array(n, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.array(bits, pa.binary()), flat]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n", "s1", "s2", "bits", "prefix"])

    return run


def _representatives(held: np.ndarray):
    """Rows of ``found``, marked ``sure`` if the filter of the other members of classes does not hold them."""

    def run(batches):
        for batch in batches:
            sure = ~in_filter(held, batch.column(batch.num_columns - 1).to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sure)], [*batch.schema.names[:-1], "sure"])

    return run


def _full_sets(width: int, held: np.ndarray, key: bytes):
    """The sorted arrays of the documents that the filter holds."""

    def run(batches):
        for batch in batches:
            batch = batch.filter(batch.column(0).is_valid())
            batch = batch.filter(pa.array(in_filter(held, batch.column(2).to_numpy())))
            raw, at = string_bytes(batch.column(1))
            for low, high in slices(np.diff(at), CHUNK):
                sets = [u.tobytes() for u in shingle_sets(raw[at[low] : at[high]], at[low : high + 1] - at[low], width, key)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[low:high], pa.array(sets, pa.binary())], ["doc_id", "items"])

    return run


def _similar(n1, n2, overlap, percent):
    return 100 * overlap >= percent * (n1 + n2 - overlap)


def _exact(percent: int):
    """Pairs with both sorted arrays in; the pairs that reach the threshold out."""

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                u, v = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                keep.append(_similar(len(u), len(v), len(np.intersect1d(u, v, assume_unique=True)), percent))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _bounded(percent: int):
    """Pairs whose bitmaps allow the threshold."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            differ = np.empty(batch.num_rows, dtype=np.int64)
            for k, (x, y) in enumerate(zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)):
                size = min(len(x), len(y))
                differ[k] = np.bitwise_count(folded(x, size) ^ folded(y, size)).sum(dtype=np.int64)
            n1, n2 = (batch.column(i).to_numpy() for i in (2, 3))
            fits = _similar(n1, n2, np.minimum((n1 + n2 - differ) // 2, np.minimum(n1, n2)), percent)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(fits))

    return run


def _whole_tiles(batches):
    """Rows ordered by tile as tables of whole tiles, each with the edges of its tiles."""
    held = None
    for batch in _with_end(batches):
        table = held if batch is None else pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        if table is None or not table.num_rows:
            continue
        tile = table.column("tile").to_numpy()
        cuts = np.flatnonzero(np.diff(tile)) + 1
        edges = np.r_[0, cuts, len(tile)] if batch is None else np.r_[0, cuts]
        whole = int(edges[-1])
        yield table.slice(0, whole), [(a, b) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True) if b - a > 1]
        held = table.slice(whole)


def _possible(comp, n, bits, side, percent):
    """Rows of a tile, each with those in other components that its bitmap allows at the threshold.

    A tile's rows hold at most two blocks: ``side`` 0 is compared with ``side``
    1, or with itself if there is no other.  Two bitmaps are compared at the
    smaller one's size.  ``comp`` may change meanwhile.
    """
    size = np.array([len(x) for x in bits])
    at = {s: np.stack([folded(x, s) if len(x) >= s else np.zeros(s // 8, np.uint64) for x in bits]) for s in np.unique(size).tolist()}
    zero = side == 0
    left = np.flatnonzero(zero)
    right = np.flatnonzero(~zero) if not zero.all() else left
    for i in left.tolist():
        rest = right[right > i] if right is left else right
        fits = rest[comp[rest] != comp[i]]
        if not len(fits):
            continue
        differ, shared = np.zeros(len(fits), dtype=np.int64), np.minimum(size[fits], size[i])
        for s, folds in at.items():
            own = shared == s
            differ[own] = np.bitwise_count(folds[fits[own]] ^ folds[i]).sum(axis=1, dtype=np.int64)
        most = np.minimum((n[fits] + n[i] - differ) // 2, np.minimum(n[fits], n[i]))
        fits = fits[_similar(n[fits], n[i], most, percent)]
        if len(fits):
            yield i, fits


_PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _tile_pairs(percent: int):
    """Rows ordered by tile in; pairs of different components whose bitmaps allow the threshold out."""

    def run(batches):
        for table, tiles in _whole_tiles(batches):
            rep, comp, n, side = (table.column(c).to_numpy() for c in ("rep", "component", "n", "side"))
            bits = table.column("bits").to_pylist()
            a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for low, high in tiles:
                s = slice(low, high)
                for i, fits in _possible(comp[s], n[s], bits[s], side[s], percent):
                    a.append(np.minimum(rep[s][fits], rep[low + i]))
                    b.append(np.maximum(rep[s][fits], rep[low + i]))
            both = np.unique(np.stack([np.concatenate(a), np.concatenate(b)], axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0], pa.int64()), pa.array(both[:, 1], pa.int64())], schema=_PAIRS)

    return run


def _tile_ends(percent: int):
    """Rows ordered by tile and rep in; of them, once, those that some such pair of their tile has out."""

    def run(batches):
        for table, tiles in _whole_tiles(batches):
            tile, rep, comp, n, side = (table.column(c).to_numpy() for c in ("tile", "rep", "component", "n", "side"))
            bits = table.column("bits").to_pylist()
            met = np.zeros(len(rep), dtype=bool)
            for low, high in tiles:
                s = slice(low, high)
                for i, fits in _possible(comp[s], n[s], bits[s], side[s], percent):
                    met[low + i] = True
                    met[low + fits] = True
            at = np.flatnonzero(met)
            at = at[np.r_[True, (np.diff(tile[at]) != 0) | (np.diff(rep[at]) != 0)]] if len(at) else at  # an id may have several sets
            yield from table.select(["tile", "rep", "component", "side"]).take(pa.array(at)).combine_chunks().to_batches()

    return run


def _tile_links(percent: int):
    """Rows ordered by tile in, with sorted arrays; links that join the tile's components out, fewer than its rows."""

    def links(rep, comp, side, items):
        n = np.array([len(u) for u in items])
        at = np.r_[0, np.cumsum(n)].tolist()
        found, place = np.unique(np.concatenate(items), return_inverse=True)
        mark = np.zeros(len(found), dtype=bool)
        for i, fits in _possible(comp, n, [bitmap(u) for u in items], side, percent):
            own = place[at[i] : at[i + 1]]
            mark[own] = True
            for j in fits.tolist():
                if comp[j] != comp[i] and _similar(n[i], n[j], np.count_nonzero(mark[place[at[j] : at[j + 1]]]), percent):
                    comp[comp == comp[j]] = comp[i]
                    yield min(rep[i], rep[j]), max(rep[i], rep[j])
            mark[own] = False

    def run(batches):
        for table, tiles in _whole_tiles(batches):
            rep, comp, side = (table.column(c).to_numpy() for c in ("rep", "component", "side"))
            items = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("items")]
            out = []
            for low, high in tiles:
                s = slice(low, high)
                out += links(rep[s], comp[s].copy(), side[s], items[s])
            a, b = zip(*out, strict=True) if out else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=_PAIRS)

    return run


def _with_end(batches):
    yield from batches
    yield None


def _distinct_pairs(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _items(docs: DataFrame, ends: DataFrame, width: int, key: bytes, name: str) -> DataFrame:
    """The sorted arrays (doc_id, items) of the documents ``ends`` (doc_id)."""
    held = id_filter(ends, "doc_id")
    items = docs.select("doc_id", "text", filter_slot("doc_id").alias("slot")).mapInArrow(lean(_full_sets(width, held, key)), "doc_id long, items binary")
    return staged(items.join(ends, "doc_id", "left_semi"), f"{name}-items")


def _verified(pairs: DataFrame, docs: DataFrame, sets: DataFrame, width: int, percent: int, key: bytes, name: str) -> DataFrame:
    """The ``pairs`` (a, b) that reach the threshold: by size, then bit counts, then sorted arrays."""
    side = lambda x: sets.select(F.col("rep").alias(x), F.col("n").alias(f"n_{x}"), F.col("bits").alias(f"bits_{x}"))
    sized = pairs.join(side("a"), "a").join(side("b"), "b").where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    near = staged(sized.select("a", "b", "n_a", "n_b", "bits_a", "bits_b").mapInArrow(lean(_bounded(percent)), "a long, b long"), f"{name}-near")
    ends = near.select(F.col("a").alias("doc_id")).union(near.select(F.col("b").alias("doc_id"))).distinct()
    items = _items(docs, ends, width, key, name)
    with_a = near.join(items.select(F.col("doc_id").alias("a"), F.col("items").alias("items_a")), "a")
    with_both = with_a.join(items.select(F.col("doc_id").alias("b"), F.col("items").alias("items_b")), "b")
    return staged(with_both.select("a", "b", "items_a", "items_b").mapInArrow(lean(_exact(percent)), "a long, b long"), f"{name}-links")


def _by_hub(placed: DataFrame, hubs: DataFrame) -> DataFrame:
    """Rows (tile, rep, n, component, docs, most) with the tiles of one hub made one tile, where all its pairs are fewer than those of its tiles."""
    rows = placed.join(hubs.select("tile", "hub"), "tile")
    once = rows.select("hub", "rep", "n", "component").distinct()
    costs = rows.groupBy("hub").agg(F.sum(F.col("docs").cast("double")).alias("pairs"))
    sizes = once.groupBy("hub").agg(F.count(F.lit(1)).alias("members"), F.max("n").alias("most"))
    joins = staged(sizes.join(costs, "hub").where(F.col("members").cast("double") * F.col("members") <= F.col("pairs")).select("hub", "members", "most"), "joins")
    apart = rows.join(joins, "hub", "left_anti").select("tile", "rep", "n", "component", "docs", "most")
    return apart.unionByName(once.join(joins, "hub").select(F.xxhash64(F.lit("hub"), "hub").alias("tile"), "rep", "n", "component", F.col("members").alias("docs"), "most"))


def _common_counters(docs: DataFrame, width: int, percent: int, key: bytes) -> np.ndarray | None:
    """Which counters of the sketch are common, a bit for each, or None if none is: at most 2 MB."""
    counters = min(MOST_COUNTERS, max(COUNTERS, 1 << (docs.count() // DOCS_EACH).bit_length()))
    counts = docs.select("text").mapInArrow(lean(_count_prefixes(width, percent, counters, key)), "counter long, n long").groupBy("counter").agg(F.sum("n").alias("n"))
    counts = staged(counts, "counters")
    total = counts.agg(F.sum("n")).first()[0] or 0
    most = max(COMMON, EXCESS * total // counters)
    found = counts.where(F.col("n") > most).select("counter").toPandas()  # fewer than counters / EXCESS
    out = np.zeros(counters, dtype=bool)
    out[found["counter"].to_numpy(dtype=np.int64)] = True
    return np.packbits(out) if len(found) else None


def _prepared(docs: DataFrame, width: int, percent: int, key: bytes) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """Of ``docs`` (doc_id, text): the signature of every row, classes of equal sets, and their representatives' bitmaps, tiles and hubs."""
    common = _common_counters(docs, width, percent, key)
    found = staged(docs.mapInArrow(lean(_signatures(width, percent, common, key)), _SETS), "sets")
    # Equal sets are one class; its smallest id stands for it.
    own = found.where("n > 0 AND doc_id IS NOT NULL")
    classes = staged(own.groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("members")), "classes")
    copied = own.select("doc_id", "n", "s1", "s2").join(classes.where("members > 1"), ["n", "s1", "s2"])
    held = id_filter(copied.where("doc_id <> rep").select("doc_id").distinct(), "doc_id")
    marked = own.select("doc_id", "n", "s1", "s2", "bits", "prefix", filter_slot("doc_id").alias("slot"))
    marked = marked.mapInArrow(lean(_representatives(held)), f"{_SETS}, sure boolean")
    unsure = marked.where("NOT sure").join(classes.select("n", "s1", "s2", F.col("rep").alias("doc_id")), ["doc_id", "n", "s1", "s2"], "left_semi")
    reps = marked.where("sure").unionByName(unsure).select(F.col("doc_id").alias("rep"), "n", "bits", "prefix")
    posted = reps.select("rep", "n", F.explode("prefix").alias("key"))
    keys = staged(posted.groupBy("key").agg(F.count(F.lit(1)).alias("docs")).where("docs > 1").select("key"), "keys")
    sets = staged(reps.select("rep", "n", "bits"), "bitmaps")
    # Sizes at the threshold's ratio lie in one band or in neighbours; a family is a band with the next one.
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / percent * 1.001)))
    tiles = posted.join(keys, "key").select("rep", "n", "key", band.alias("band"))
    tiles = staged(tiles.select("rep", "n", F.explode(F.array(F.col("band"), F.col("band") - 1)).alias("family"), "key").select("rep", "n", F.xxhash64("key", "family").alias("tile")), "tiles")
    # Tiles of the same documents are one tile.
    members = [F.count(F.lit(1)).alias("docs"), F.bit_xor(F.xxhash64("rep")).alias("xor"), F.max("n").alias("most")]
    hubs = tiles.groupBy("tile").agg(F.min("rep").alias("hub"), *members).where("docs > 1")
    hubs = staged(hubs.groupBy("hub", "docs", "xor").agg(F.min("tile").alias("tile"), F.max("most").alias("most")).select("tile", "hub", "docs", "most"), "hubs")
    tiles = staged(tiles.join(hubs, "tile"), "kept-tiles")
    return found, classes, sets, tiles, hubs


def _by_tile(rows: DataFrame) -> DataFrame:
    n_parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n_parts, "tile").sortWithinPartitions("tile", "rep")


def _dealt(joined: DataFrame, sets: DataFrame) -> DataFrame:
    """The tiles ``joined`` (tile, rep, n, component, docs, most), with bitmaps, in tiles of at most two blocks, ordered."""
    blocks = F.ceil(F.greatest(F.col("docs") / F.lit(float(BLOCK)), F.col("docs") * F.col("most") * F.lit(8.0 / BLOCK_BYTES))).cast("int")
    blocks = F.least(F.col("docs").cast("int"), blocks)
    dealt = joined.join(sets.select("rep", "bits"), "rep").withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks").cast("long")).cast("int"))
    # Each pair of blocks is a tile of its own: a document goes to those of its block with every other one.
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select(
        F.xxhash64("tile", F.least("own", "other"), F.greatest("own", "other")).alias("tile"),
        "rep", "component", "n", "bits", (F.col("own") > F.col("other")).cast("int").alias("side"),
    )
    return _by_tile(dealt)


def _compared(joined: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components in the tiles ``joined`` whose bitmaps allow the threshold."""
    return _dealt(joined, sets).mapInArrow(lean(_tile_pairs(percent)), "a long, b long")


def _joining(joined: DataFrame, docs: DataFrame, sets: DataFrame, width: int, percent: int, key: bytes, name: str) -> DataFrame:
    """Links between different components in the tiles ``joined``: enough to join all that their links join.

    Rows whose bitmaps allow some pair of their tile come with their sorted
    arrays; the pairs themselves never leave the task that compares them.
    """
    near = staged(_dealt(joined, sets).mapInArrow(lean(_tile_ends(percent)), "tile long, rep long, component long, side int"), f"{name}-near")
    items = _items(docs, near.select(F.col("rep").alias("doc_id")).distinct(), width, key, name)
    full = near.join(items.withColumnRenamed("doc_id", "rep"), "rep").select("tile", "rep", "component", "side", "items")
    return staged(_distinct_pairs(_by_tile(full).mapInArrow(lean(_tile_links(percent)), "a long, b long")), f"{name}-links")


def similar_documents(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id`` of every row of ``docs``.

    Words are runs of characters other than ASCII white space, A-Z lower-cased.
    A set holds the distinct shingles of ``width`` words; a shorter text is one
    shingle.  Documents link when their Jaccard similarity is at least
    ``percent`` / 100; ``component_id`` is the smallest id reachable by links.

    Null, empty and blank texts have no shingles and link with nothing, so
    they are their own component.  A null id gives a null component.  Rows that
    repeat an id are one node of the graph and all come back.  An empty table
    gives an empty result; other columns are not read.  Texts of any length are
    hashed whole, a few megabytes of words at a time; a task holds its longest
    text.  Shingles are told apart by 64-bit hashes of a key drawn for each run.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    key = fresh_key()
    found, classes, sets, tiles, hubs = _prepared(docs, width, percent, key)
    stars = staged(_distinct_pairs(tiles.where("rep <> hub").select(F.col("hub").alias("a"), F.col("rep").alias("b"))), "stars")
    links = _verified(stars, docs, sets, width, percent, key, "stars")
    labels = staged(connected_components(links), "labels")
    # Tiles that still hold more than one component are compared in full.
    member = F.coalesce("component", "rep").alias("component")
    placed = staged(tiles.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("tile", "rep", "n", member), "placed")
    mixed_tiles = staged(placed.groupBy("tile").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("docs"), F.max("n").alias("most")).where("low < high").select("tile", "docs", "most"), "mixed")
    joined = staged(_by_hub(placed.join(mixed_tiles, "tile"), hubs), "joined")
    more = _joining(joined, docs, sets, width, percent, key, "rest")
    of_class = connected_components(links.unionByName(more))
    classes = classes.join(of_class.withColumnRenamed("node", "rep"), "rep", "left").select("n", "s1", "s2", F.coalesce("component", "rep").alias("component"))
    out = found.select("doc_id", "n", "s1", "s2").join(staged(classes, "named"), ["n", "s1", "s2"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))


def similar_pairs(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = SHINGLE, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """The links themselves, as (pairs, members).

    ``pairs`` has every link between different sets once, as ``a`` < ``b``: the
    smallest ids of two classes of equal sets.  ``members`` has ``doc_id``,
    ``n_shingles``, ``rep`` (that smallest id of the row's own class) and
    ``n_links`` of every row: the other rows that it links with, copies too.
    So no link is lost, and copies are not multiplied out.

    Documents, sets and links are those of :func:`similar_documents`, but no
    pair is left out because links reach it already, so a group of D unlike
    near copies has up to D * D / 2 of them.  Rows without shingles or without
    an id have no links, and ``rep`` is their own id.  Ids are expected once;
    where one repeats, its rows' sets count as one class.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    key = fresh_key()
    found, classes, sets, tiles, hubs = _prepared(docs, width, percent, key)
    placed = tiles.select("tile", "rep", "n", F.col("rep").alias("component"), "docs", "most")
    pairs = staged(_distinct_pairs(_compared(_by_hub(placed, hubs), sets, percent)), "pairs")
    pairs = _verified(pairs, docs, sets, width, percent, key, "pairs")
    rows = classes.groupBy("rep").agg(F.sum("members").alias("rows"))
    ends = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = ends.join(rows.withColumnRenamed("rep", "b"), "b").groupBy(F.col("a").alias("rep")).agg(F.sum("rows").alias("near"))
    links = rows.join(near, "rep", "left").select("rep", (F.col("rows") - 1 + F.coalesce("near", F.lit(0))).alias("n_links"))
    own = classes.select("n", "s1", "s2", "rep").join(links, "rep")
    members = found.select("doc_id", "n", "s1", "s2").join(own, ["n", "s1", "s2"], "left")
    known = F.col("doc_id").isNotNull()
    out = members.select("doc_id", F.col("n").alias("n_shingles"), F.when(known, F.coalesce("rep", "doc_id")).alias("rep"), F.when(known, F.coalesce("n_links", F.lit(0))).otherwise(0).alias("n_links"))
    return pairs, out


def op1_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return similar_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates (shingles of five words, 0.8): the one with the smallest id.

    Rows are judged, not ids: where ids repeat or are null, rows are numbered
    in the order of id (null last) and text, and the first of a group stays,
    with the rows that repeat both its id and its text: they are one document.
    Texts without words are near nothing and stay; an empty table stays empty.
    All columns come back, whatever their names.
    """
    unlike = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1 OR doc_id IS NULL")
    if unlike.isEmpty():
        found = similar_documents(docs, width=5, percent=80)
        keep = found.where("doc_id = component_id").select("doc_id")
        return docs.join(keep, "doc_id", "left_semi").select(*docs.columns)
    by = [F.col("row.doc_id").asc_nulls_last(), F.col("row.text").asc_nulls_first()]
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).repartitionByRange(n_parts, *by).sortWithinPartitions(*by)
    rows = staged(rows.select(F.monotonically_increasing_id().alias("number"), "row"), "numbered")
    found = similar_documents(rows.select("number", "row.text"), doc_id="number", width=5, percent=80)
    keep = found.where("doc_id = component_id").select(F.col("doc_id").alias("number"))
    digest = F.sha2(F.coalesce("row.text", F.lit("")), 256)
    keep = rows.join(keep, "number", "left_semi").select(F.col("row.doc_id").alias("id"), digest.alias("digest")).distinct()
    return rows.join(keep, F.col("row.doc_id").eqNullSafe(F.col("id")) & (digest == F.col("digest")), "left_semi").select("row.*")


QUERIES = {"op1_jaccard_join": op1_jaccard_join}

ORACLE_SQL = {
    "op1_jaccard_join": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(w[p:p + 3], ' ')) AS g FROM d, unnest(generate_series(1, greatest(1, len(w) - 3))) AS t(p) WHERE len(w) > 0),
c AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y USING (g) WHERE x.doc_id <> y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM o JOIN c x ON x.doc_id = a JOIN c y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least_id AS (SELECT a AS doc_id, min(b) AS m FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN least_id USING (doc_id)
"""
}
