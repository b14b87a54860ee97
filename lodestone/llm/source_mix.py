"""Mixing sources to target weights by Pareto order sampling.

Each source gets a target in words.  A document's share of it is a number of
copies: the whole ones are certain, and for the fraction left the documents of
the source are ranked by random odds divided by inclusion odds.  The sample
takes them in that order until the words still wanted are full, so its size is
fixed in words, not in documents: what is fixed is what a mix is measured in.

Everything is DataFrame functions.  No source is ever sorted or gathered as a
whole: the place where its sample ends is found by counting words in 4,096
parts of the order, then in 4,096 parts of the part where it ends, and so on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import staged

#: Words of a text.
WORD = r"[^\x20\x09-\x0D]+"
#: Relative weights of the sources, in turn; the words of the mix for each word there is; most copies of a document.
WEIGHTS, TOTAL, MOST = (3, 1, 2), 1.5, 2
#: Documents behind the end of a sample that may still fill its gap, about.
LOOK = 1000
#: Bits of a place in the order, and of one step of the search for its end.
PLACE_BITS, STEP_BITS = 36, 12
#: Sources up to which their table is sent to every task.
FEW_SOURCES = 100_000


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, total: float = TOTAL, most: float = MOST) -> DataFrame:
    """``source``, ``source_size`` and ``n`` with ``target``, the words that the mix takes of each source.

    Sources are ordered by code point, null last, and have ``weights`` in turn.
    They share ``total`` times all words by weight; no target is above ``most``
    times its source, and what that leaves over is shared again by weight.
    That has a closed form: in order of size by weight the sources at their
    limit come first, and the others get the same number of words by weight.
    """
    named = sizes.withColumn("turn", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    weighed = named.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("turn") - 1, F.lit(len(weights))) + 1).cast("int")))
    full = weighed.withColumn("limit", F.col("source_size") * most).withColumn("full_at", F.col("limit") * 1.0 / F.col("weight"))
    order = Window.orderBy("full_at", "turn")
    whole = Window.partitionBy()
    left = F.sum("source_size").over(whole) * total - (F.sum("limit").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("limit"))
    level = left / F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    placed = full.withColumn("place", F.row_number().over(order)).withColumn("level", level)
    open_ = F.when(F.col("full_at") > F.col("level"), F.struct("place", "level"))
    first = placed.withColumn("first", F.min(open_).over(whole))
    target = F.when(F.col("first").isNull() | (F.col("place") < F.col("first.place")), F.col("limit") * 1.0).otherwise(F.col("weight") * F.col("first.level"))
    return first.select("source", "source_size", "n", target.alias("target"))


def _random(doc_id: str, text: str, seed: str) -> Column:
    """A number between 0 and 1, the same for the same id and text in every run."""
    key = F.concat_ws(":", F.lit(seed), F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.md5(F.coalesce(F.col(text), F.lit(""))))
    return (F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("long") + 0.5) / float(1 << 52)


def _with(rows: DataFrame, table: DataFrame, few: bool) -> DataFrame:
    """``rows`` with the columns of their source."""
    table = table.withColumnRenamed("source", "of")
    return rows.join(F.broadcast(table) if few else table, F.col("source").eqNullSafe(F.col("of"))).drop("of")


def _copies(rows: DataFrame, table: DataFrame, most: float, few: bool) -> DataFrame:
    """``table`` with ``rate``: a document of the source gets ``least(most, rate * boost)`` copies, and the words add up to the target.

    Documents whose copies would be above ``most`` get just that and the others
    share the rest; as that may lift more of them, it is done until none is.
    """
    plain = table.withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))
    if "boost" not in rows.columns:
        return plain
    plain = plain.withColumn("rate", F.lit(0.0))  # rises until no further document is lifted to its most
    while True:
        at_most = F.col("rate") * F.col("boost") >= most
        sums = _with(rows, plain.select("source", "rate"), few).groupBy("source").agg(
            F.sum(F.when(at_most, F.col("size")).otherwise(0)).alias("fixed"), F.sum(F.when(at_most, 0.0).otherwise(F.col("size") * F.col("boost"))).alias("rest")
        )
        better = F.when(F.col("rest") > 0, (F.col("target") - F.col("fixed") * most) / F.col("rest")).otherwise(F.col("before"))
        last = plain.withColumnRenamed("rate", "before")
        table = staged(_with(last, sums, few).select(*last.columns, F.greatest(better, F.col("before")).alias("rate")), "rates")
        done = table.where(F.col("rate") > F.col("before") * (1 + 1e-12)).isEmpty()
        plain = table.drop("before")
        if done:
            return plain


def mixed(
    docs: DataFrame, weights: tuple = WEIGHTS, total: float = TOTAL, most: float = MOST, look: int = LOOK, seed: str = "mix", text: str = "text", source: str = "source",
    doc_id: str = "doc_id", boost: str | None = None,
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``size``, ``source_size``, ``target`` and ``taken``, the words that the mix takes.

    ``taken`` is a whole number of copies of the document, at most ``most``.
    Within a source all documents have the same number of copies to expect, or
    one in proportion to the column ``boost`` (not negative, null is 0), up to
    ``most``.  The sample of the fractions takes documents in Pareto order; the
    one that would pass the target is left out, and of about ``look`` after it
    in the order those that still fit are taken.  So a source is at its target
    to within its smallest documents where it has enough of them, and else to
    within the document left out.

    Null texts have no words; documents without words are taken for nothing.
    Null ids are allowed.  Rows that repeat id and text have the same random
    number and are judged one by one, in no order that shows.  A null source is
    a source, the last.  An empty table gives an empty result; other columns
    are not read.  Texts of any length are only counted; what is staged has a
    few numbers a row.  The same table gives the same rows in every run.
    """
    spark = docs.sparkSession
    named = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size"), _random(doc_id, text, seed).alias("u"),
        *([F.coalesce(F.col(boost).cast("double"), F.lit(0.0)).alias("boost")] if boost else []),
    )
    rows = staged(named, "mix_rows")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    table = staged(source_targets(sizes, weights, total, most), "mix_targets")
    few = table.count() <= FEW_SOURCES
    table = _copies(rows, table, most, few)
    copies = F.least(F.lit(float(most)), F.col("rate") * F.col("boost")) if boost else F.col("rate")
    odds = F.col("share") * (1 - F.col("u"))
    ranked = (
        _with(rows, table, few)
        .withColumn("copies", copies)
        .withColumn("whole", F.floor("copies"))
        .withColumn("share", F.col("copies") - F.col("whole"))
        # Random odds by inclusion odds, x = (u / (1 - u)) / (share / (1 - share)), as x / (1 + x).
        .withColumn("rank", F.when((F.col("share") > 0) & (F.col("size") > 0), F.col("u") * (1 - F.col("share")) / (F.col("u") * (1 - F.col("share")) + odds)))
        .select("row", "doc_id", "source", "size", "source_size", "n", "target", "whole", "rank", F.floor(F.col("rank") * float(1 << PLACE_BITS)).cast("long").alias("place"))
    )
    ranked = staged(ranked, "mix_ranked")
    certain = ranked.groupBy("source", "target", "n").agg(F.sum(F.col("size") * F.col("whole")).alias("certain"))
    wanted = F.greatest(F.lit(0), F.round(F.col("target") - F.col("certain")).cast("long"))
    ends = staged(certain.select("source", "n", F.lit(0).cast("long").alias("prefix"), wanted.alias("left")), "mix_ends")
    shift, inside = PLACE_BITS, ranked.where("rank IS NOT NULL").select("source", "size", "place")
    while shift > 0:
        shift -= STEP_BITS
        met = _with(inside, ends.select("source", "prefix"), few).where(F.shiftright("place", shift + STEP_BITS) == F.col("prefix"))
        parts = met.groupBy("source", "prefix", F.shiftright("place", shift).alias("part")).agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("rows"))
        order = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
        run = _with(parts.withColumn("upto", F.sum("words").over(order)), ends.select("source", "left"), few)
        over = F.when(F.col("upto") > F.col("left"), F.struct("part", (F.col("upto") - F.col("words")).alias("before"), "rows"))
        # Where nothing goes over, all of it is taken and the order goes on after it.
        cut = run.groupBy("source").agg(F.min(over).alias("cut"), F.max("upto").alias("all"))
        known = ends.join(cut.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")), "left")
        behind = F.shiftleft(F.col("prefix") + 1, STEP_BITS)
        ends = staged(
            known.select(
                "source", "n", F.coalesce(F.col("cut.part"), behind).alias("prefix"),
                (F.col("left") - F.coalesce(F.col("cut.before"), F.col("all"), F.lit(0))).alias("left"), F.coalesce(F.col("cut.rows"), F.lit(0)).alias("rows"),
            ),
            "mix_ends",
        )
        if (ends.agg(F.max("rows")).first()[0] or 0) <= look:
            break
    ahead = F.lit(float(look)) / F.col("n")
    ends = ends.select("source", F.shiftleft("prefix", shift).alias("start"), (F.shiftleft(F.col("prefix") + 1, shift) + F.ceil(ahead * float(1 << PLACE_BITS)) + 1).alias("stop"), "left", ahead.alias("ahead"))
    placed = _with(ranked, ends, few)
    near = F.coalesce((F.col("place") >= F.col("start")) & (F.col("place") < F.col("stop")), F.lit(False))
    taken = lambda extra: (F.col("size") * (F.col("whole") + extra)).cast("long").alias("taken")
    out = ("doc_id", "size", "source_size", "target")
    clear = placed.where(~near).select(*out, taken(F.coalesce((F.col("place") < F.col("start")).cast("int"), F.lit(0))))
    gap = placed.where(near).groupBy("source", "source_size", "target", "left", "ahead").agg(F.sort_array(F.collect_list(F.struct("rank", "doc_id", "row", "size", "whole"))).alias("queue"))
    filled = gap.select(
        "source_size",
        "target",
        F.explode(
            F.aggregate(
                "queue",
                F.struct(F.col("left"), F.lit(2.0).alias("end"), F.expr("CAST(array() AS array<struct<doc_id:" + dict(ranked.dtypes)["doc_id"] + ",size:bigint,whole:bigint,extra:int>>)").alias("met")),
                lambda acc, x: F.struct(
                    F.when((x["size"] <= acc["left"]) & (x["rank"] <= acc["end"]), acc["left"] - x["size"]).otherwise(acc["left"]).alias("left"),
                    F.when((x["size"] > acc["left"]) & (acc["end"] == 2.0), x["rank"] + F.col("ahead")).otherwise(acc["end"]).alias("end"),
                    F.array_append(acc["met"], F.struct(x["doc_id"].alias("doc_id"), x["size"].alias("size"), x["whole"].alias("whole"), ((x["size"] <= acc["left"]) & (x["rank"] <= acc["end"])).cast("int").alias("extra"))).alias("met"),
                ),
                lambda acc: acc["met"],
            )
        ).alias("x"),
    )
    return clear.unionByName(filled.select("x.doc_id", "x.size", "source_size", "target", (F.col("x.size") * (F.col("x.whole") + F.col("x.extra"))).cast("long").alias("taken")))


def op12_source_mix(spark, sf_dir: str) -> DataFrame:
    return mixed(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op12_source_mix": op12_source_mix}

ORACLE_SQL = {
    "op12_source_mix": r"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         (('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n, row_number() OVER (ORDER BY source NULLS LAST) AS turn FROM d GROUP BY source
), w AS (SELECT *, [3, 1, 2][(turn - 1) % 3 + 1] AS weight, 2 * source_size AS cap, (2 * source_size)::DOUBLE / [3, 1, 2][(turn - 1) % 3 + 1]::DOUBLE AS full_at FROM s),
l AS (
  SELECT *, row_number() OVER o AS place,
         ((SELECT sum(source_size) FROM s)::DOUBLE * 1.5::DOUBLE - (sum(cap) OVER (o ROWS UNBOUNDED PRECEDING) - cap)::DOUBLE)
           / (sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
  FROM w WINDOW o AS (ORDER BY full_at, turn)
), t AS (
  SELECT source, source_size, n,
         CASE WHEN place < coalesce((SELECT min(place) FROM l WHERE full_at > level), 1e18) THEN cap::DOUBLE
              ELSE weight::DOUBLE * (SELECT min_by(level, place) FROM l WHERE full_at > level) END AS target
  FROM l
), c AS (
  SELECT d.*, t.source_size, t.n, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size::DOUBLE ELSE 0::DOUBLE END AS copies
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), f AS (SELECT *, floor(copies)::BIGINT AS whole, copies - floor(copies) AS share FROM c),
r AS (
  SELECT *, CASE WHEN share > 0 AND size > 0 THEN u * (1::DOUBLE - share) / (u * (1::DOUBLE - share) + share * (1::DOUBLE - u)) END AS rank,
         greatest(0, round(target - (sum(size * whole) OVER (PARTITION BY source))::DOUBLE)::BIGINT) AS wanted
  FROM f
), q AS (
  SELECT source, wanted, n, list({'rank': rank, 'row': row, 'size': size} ORDER BY rank, doc_id, row) AS queue FROM r WHERE rank IS NOT NULL GROUP BY source, wanted, n
), e AS (
  SELECT list_reduce(queue, lambda acc, x: {
           'left': CASE WHEN x.size <= acc.left AND x.rank <= acc.stop THEN acc.left - x.size ELSE acc.left END,
           'stop': CASE WHEN x.size > acc.left AND acc.stop = 2 THEN x.rank + 1000::DOUBLE / n::DOUBLE ELSE acc.stop END,
           'rows': CASE WHEN x.size <= acc.left AND x.rank <= acc.stop THEN list_append(acc.rows, x.row) ELSE acc.rows END
         }, {'left': wanted, 'stop': 2::DOUBLE, 'rows': []::BIGINT[]}).rows AS rows FROM q
), x AS (SELECT unnest(rows) AS row FROM e)
SELECT doc_id, size, source_size, target, (size * (whole + (row IN (SELECT row FROM x))::INT))::BIGINT AS taken FROM r
"""
}
