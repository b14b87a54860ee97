"""Names matched to a catalogue by Indel similarity: an exact join by segments.

Where two names are alike to ``least``, few edits part them: at most
``(1 - least) * (a + b)`` for lengths a and b.  A catalogue name is cut into one
segment more than the edits that any name like it can need, so one segment is
whole in the other name, not far from its place.  Names meet by segment, length
of the segment and stretch of places; the longest common subsequence decides.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.similarity import indel_ratio

#: Similarity from which a file counts as the catalogue's.
LEAST = 0.85


@F.pandas_udf(StringType())
def composed(text: pd.Series) -> pd.Series:
    """NFC: file systems part accents from their letters."""
    return text.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFC", x))


def reach(size: Column, least: float) -> tuple[Column, Column]:
    """(shortest, longest) length of a name that can be alike to one of length ``size``."""
    ratio = least / (2.0 - least)
    return F.ceil(size * ratio - 1e-9).cast("int"), F.floor(size / ratio + 1e-9).cast("int")


def candidates(files: DataFrame, catalogue: DataFrame, least: float = LEAST) -> DataFrame:
    """Distinct pairs ``name``, ``entry`` that share a segment about the same place; every pair alike to ``least`` is among them.

    ``files`` has name, ``catalogue`` has entry; nulls and empty names pair with nothing.
    """
    size = F.char_length("entry")
    shortest, longest = reach(size, least)
    edits = F.floor((1.0 - least) * (size + longest) + 1e-9).cast("int")
    many = F.least(edits + 1, size)  # a name shorter than that has segments of one character: all its letters
    entries = catalogue.select("entry").where("entry <> ''").distinct().withColumns({"size": size, "shortest": shortest, "longest": longest, "edits": edits, "many": many})
    low, high = F.floor(F.col("i") * F.col("size") / F.col("many")).cast("int"), F.floor((F.col("i") + 1) * F.col("size") / F.col("many")).cast("int")
    cut = entries.select("*", F.explode(F.sequence(F.lit(0), F.col("many") - 1)).alias("i")).select("*", low.alias("at"), (high - low).alias("long"))
    # A segment moves by no more places than there are edits.
    places = F.sequence(F.floor(F.greatest(F.col("at") - F.col("edits"), F.lit(0)) / F.col("wide")).cast("int"), F.floor((F.col("at") + F.col("edits")) / F.col("wide")).cast("int"))
    kept = cut.withColumn("wide", _wide(F.col("edits"))).select("entry", "shortest", "longest", "at", "edits", "long", "wide", F.substring(F.col("entry"), F.col("at") + 1, F.col("long")).alias("segment"), F.explode(places).alias("stretch"))
    lengths = kept.select("long", "wide", "shortest", "longest").groupBy("long", "wide").agg(F.min("shortest").alias("from"), F.max("longest").alias("to"))  # a few: both follow from the length alone
    names = files.select("name").where("name <> ''").distinct().withColumn("chars", F.char_length("name"))
    parts = names.join(F.broadcast(lengths), (F.col("chars") >= F.col("from")) & (F.col("chars") <= F.col("to")) & (F.col("chars") >= F.col("long")))
    parts = parts.select("name", "chars", "long", "wide", F.explode(F.sequence(F.lit(0), F.col("chars") - F.col("long"))).alias("place"))
    parts = parts.select("name", "chars", "long", "wide", "place", F.substring(F.col("name"), F.col("place") + 1, F.col("long")).alias("segment"), F.floor(F.col("place") / F.col("wide")).cast("int").alias("stretch"))
    met = parts.join(kept, ["long", "wide", "segment", "stretch"]).where((F.abs(F.col("place") - F.col("at")) <= F.col("edits")) & F.col("chars").between(F.col("shortest"), F.col("longest")))
    return met.select("name", "entry").distinct()


def _wide(edits: Column) -> Column:
    """Places of a stretch: a power of two about as large as the edits, so there are few sizes."""
    return F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(edits, F.lit(1)).cast("double")))).cast("int")


def alike(files: DataFrame, catalogue: DataFrame, least: float = LEAST) -> DataFrame:
    """``name``, ``entry`` and ``score`` of all pairs whose similarity is at least ``least``, equal ones included."""
    scored = candidates(files, catalogue, least).withColumn("score", indel_ratio("name", "entry"))
    return scored.where(F.col("score") >= least)


def catalogued(files: DataFrame, catalogue: DataFrame, least: float = LEAST) -> DataFrame:
    """Every distinct name of ``files`` (name) with the ``entry`` of ``catalogue`` (entry) most like it, or nulls.

    Both are compared in NFC.  ``rivals`` counts the other entries within reach;
    ties go to the smaller entry.  Null names have no row.
    """
    names = files.select(F.col("name").alias("raw"), composed("name").alias("name")).where("raw IS NOT NULL").distinct()
    entries = catalogue.select(composed("entry").alias("entry"))
    found = alike(names.select("name"), entries, least)
    best = found.groupBy("name").agg(F.min(F.struct((-F.col("score")).alias("loss"), "entry")).alias("b"), (F.count(F.lit(1)) - 1).alias("rivals"))
    rows = names.join(best, "name", "left")
    return rows.select(F.col("raw").alias("name"), F.col("b.entry").alias("entry"), F.round(-F.col("b.loss"), 6).alias("score"), F.coalesce("rivals", F.lit(0)).alias("rivals"))

