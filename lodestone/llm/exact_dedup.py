"""Exact deduplication by deterministic block naming.

Every text is cut into fixed-size blocks of bytes.  The distinct blocks are
sorted and numbered; then each document's adjacent names are paired, the
distinct pairs are sorted and numbered in turn, and so on until every document
has one integer.  Two documents have the same integer exactly if their texts
are the same bytes: a name stands for one content only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import staged

#: Bytes of a block.
BLOCK = 8192


def _blocks(block: int):
    """The blocks of the column ``raw``, in order; an empty text is one empty block."""
    count = F.greatest(F.lit(1), F.ceil(F.octet_length("raw") / F.lit(float(block))).cast("int"))
    return F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substring(F.col("raw"), i * block + 1, F.lit(block)))


def _digest(x, seed: int):
    return F.struct(F.xxhash64(F.lit(seed), x).alias("hi"), F.xxhash64(x, F.lit(seed)).alias("lo"))


def _numbered(keys: DataFrame, by: list[str], after: int, name: str) -> DataFrame:
    """``keys`` (distinct) with integer names in sorted order, all above ``after``."""
    n = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = keys.repartitionByRange(n, *by).sortWithinPartitions(*by)
    return staged(ordered.select(*by, (F.monotonically_increasing_id() + F.lit(after + 1)).alias("name")), name)


def block_names(docs: DataFrame, text: str = "text", key: str = "row_id", block: int = BLOCK) -> DataFrame:
    """``key`` and ``name`` of each row of ``docs``; equal names mean equal texts.

    ``key`` must be unique and stable.  Null texts count as empty.  Blocks are
    routed by a 128-bit digest but told apart by their bytes: if two different
    blocks ever share a digest, the step is repeated with another seed.
    """
    source = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("raw"))
    seed = 1
    while True:
        digests = staged(source.select(key, F.transform(_blocks(block), lambda b: _digest(b, seed)).alias("parts")), "digests")
        distinct = source.select(F.explode(_blocks(block)).alias("block")).select(_digest(F.col("block"), seed).alias("d"), "block").distinct()
        counted = staged(distinct.groupBy("d").agg(F.count(F.lit(1)).alias("contents")), "blocks")
        if counted.where("contents > 1").isEmpty():
            break
        seed += 1
    names = _numbered(counted.select("d"), ["d"], 0, "names0")
    parts = digests.select(key, F.posexplode("parts").alias("at", "d"))
    named = parts.join(names, "d").select(key, "at", "name")
    done: list[DataFrame] = []
    level = 0
    # A document's blocks are few enough to lie in one row, as its text did.
    rows = staged(named.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "name"))), lambda x: x["name"]).alias("names")), "level0")
    while True:
        done.append(rows.where(F.size("names") == 1).select(key, F.col("names")[0].alias("name")))
        longer = rows.where(F.size("names") > 1)
        top = longer.agg(F.count(F.lit(1)).alias("n"), F.max(F.array_max("names")).alias("top")).first()
        if not top["n"]:
            break
        level += 1
        used = max(top["top"], rows.agg(F.max(F.array_max("names"))).first()[0])
        # A last name without a partner is paired with 0, which names nothing.
        pairs = longer.select(
            key,
            F.posexplode(
                F.transform(
                    F.sequence(F.lit(0), F.expr("(size(names) + 1) div 2").cast("int") - 1),
                    lambda i: F.struct(F.col("names")[i * 2].alias("a"), F.coalesce(F.get("names", i * 2 + 1), F.lit(0)).alias("b")),
                )
            ).alias("at", "pair"),
        ).select(key, "at", "pair.a", "pair.b")
        names = _numbered(pairs.select("a", "b").distinct(), ["a", "b"], used, f"names{level}")
        named = pairs.join(names, ["a", "b"]).select(key, "at", "name")
        rows = staged(named.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "name"))), lambda x: x["name"]).alias("names")), f"level{level}")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def exact_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", block: int = BLOCK) -> DataFrame:
    """One row per row of ``docs``: which row of its group of equal texts stays.

    Columns: ``doc_id``, ``keep_id`` (the largest doc_id of the group),
    ``group_size``, ``kept``, ``text_sha256``.  Null texts count as empty, and
    all empty texts form one group.  Rows that repeat a doc_id with the same
    text are counted one by one, and all rows that carry ``keep_id`` are
    marked kept (a repeated row is the same document).  Null ids sort below
    all others.  An empty table gives an empty result; other columns are not
    read.
    """
    rows = staged(
        docs.select(
            F.monotonically_increasing_id().alias("row_id"),
            F.col(doc_id).alias("doc_id"),
            F.coalesce(F.col(text), F.lit("")).alias("text"),
        ).select("row_id", "doc_id", F.sha2("text", 256).alias("text_sha256"), "text"),
        "rows",
    )
    named = staged(rows.select("row_id", "doc_id", "text_sha256").join(block_names(rows, "text", "row_id", block), "row_id").select("doc_id", "text_sha256", "name"), "named")
    groups = staged(named.groupBy("name").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "groups")
    out = named.join(groups, "name")
    return out.select("doc_id", "keep_id", F.col("group_size").cast("long"), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def op10_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that :func:`exact_duplicates` keeps, with all columns: told apart by id, null ids too, and text."""
    keep = exact_duplicates(docs).where("kept").select("doc_id", "text_sha256").distinct()
    same = docs["doc_id"].eqNullSafe(keep["doc_id"]) & (F.sha2(F.coalesce(docs["text"], F.lit("")), 256) == keep["text_sha256"])
    return docs.join(keep, same, "left_semi").select(*docs.columns)


QUERIES = {"op10_exact_dedup": op10_exact_dedup}

ORACLE_SQL = {
    "op10_exact_dedup": """
SELECT doc_id,
       max(doc_id) OVER w AS keep_id,
       count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
}
