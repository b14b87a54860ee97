"""Column functions on text: normalisation, parsing, splitting, masking."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Characters that are stripped from both ends of a question: fixed values.
EDGE = " \t\r\n?!.,~·…\"'()[]{}"
#: Words read as true: fixed values.
TRUE_WORDS = ("1", "true", "yes", "on", "y", "t")
#: Keys that never leave the process: fixed values.
SECRET_KEYS = ("api_key", "password", "secret", "token", "authorization")
#: What is masked in an error, and by what: fixed values.
MASKS = ((r"[A-Za-z]:\\[^\s'\"]+", "<path>"), (r"/[^\s'\"]+/[^\s'\"]+", "<path>"), (r"[A-Za-z0-9_\-]{20,}", "<redacted>"))
#: Names of runs: a fixed value.
RUN_ID = r"\A[A-Za-z0-9_\-]{1,64}\z"
#: Unicode white space, which a plain trim does not know.
WHITE = r"(?U)\s"


@F.pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """NFKC, for which Spark has no function; one Arrow batch at a time."""
    return text.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFKC", x))


def strip(text: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(text, rf"(?U)\A\s+|\s+\z", "")


def normalized(text: Column) -> Column:
    """The form in which questions are compared; null gives the empty text."""
    x = F.coalesce(text, F.lit(""))
    wide = F.when(F.octet_length(x) > F.char_length(x), x)  # texts of ASCII alone don't leave the JVM
    x = F.regexp_replace(F.coalesce(nfkc(wide), x), WHITE + "+", " ")
    return F.lower(strip(F.btrim(strip(x), F.lit(EDGE))))


def clean(text: Column) -> Column:
    """Stripped; blank is null."""
    return F.nullif(strip(text), F.lit(""))


def header_name(text: Column) -> Column:
    """A header without its spaces."""
    return F.coalesce(strip(F.replace(text, F.lit(" "), F.lit(""))), F.lit(""))


def integer(text: Column) -> Column:
    """An integer, or null where there is none; the fraction of a number is cut."""
    return F.coalesce(text.try_cast("int"), text.try_cast("double").try_cast("int"))


def file_names(text: Column) -> Column:
    """The names in a cell that lists files, each once, in order."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), r"[\n;,/]"), strip)
    return F.array_distinct(F.filter(parts, lambda x: x != ""))


def truth(text: Column, default: bool) -> Column:
    """A flag from a word; null and blank give the default."""
    return F.coalesce(F.lower(clean(text)).isin(*TRUE_WORDS), F.lit(default))


def number(text: Column, default: float) -> Column:
    return F.coalesce(text.try_cast("double"), F.lit(default))


def text_or(text: Column, default: str) -> Column:
    return F.coalesce(F.nullif(text, F.lit("")), F.lit(default))


def masked_error(kind: Column, message: Column) -> Column:
    """The first line of an error without paths and long tokens, at most 300 characters."""
    line = F.regexp_extract(F.coalesce(message, F.lit("")), r"\A[^\n\x0b\x0c\r\x1c-\x1e\x85\u2028\u2029]*", 0)
    line = F.when(line == "", kind).otherwise(line)
    for pattern, put in MASKS:
        line = F.regexp_replace(line, pattern, put)
    return F.substring(F.concat(kind, F.lit(": "), line), 1, 300)


def safe_map(m: Column) -> Column:
    """A map without secret keys and nulls."""
    return F.map_filter(m, lambda k, v: ~F.lower(k).isin(*SECRET_KEYS) & v.isNotNull())


def is_run_id(text: Column) -> Column:
    return F.coalesce(text.rlike(RUN_ID), F.lit(False))


def evidence_name(rank: Column, page: Column, table: Column, suffix: Column) -> Column:
    """The file name of a piece of evidence; a page that is no number is 0000."""
    page = F.coalesce(page.try_cast("int"), F.lit(0))
    return F.concat(F.format_string("ev%d_p%04d", rank, page), F.when(table, "_table").otherwise(""), F.coalesce(F.nullif(suffix, F.lit("")), F.lit(".png")))


def last_part(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def characters(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), ""), "")


def char_bigrams(text: Column) -> Column:
    """All pairs of neighbouring characters, in order; linear in the length of the text."""
    chars = characters(text)
    later = F.slice(chars, 2, F.greatest(F.size(chars), F.lit(1)))
    pairs = F.zip_with(chars, later, lambda a, b: F.concat(a, b))
    return F.filter(pairs, lambda x: x.isNotNull())


def terms(text: Column) -> Column:
    """Lower-case words of letters and digits."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def spaced_terms(text: Column) -> Column:
    """The terms of a text in one string, with spaces between them and maybe around."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " ")


def numbers(text: Column) -> Column:
    """The numbers written in a text, without thousands separators."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\d+(?:[.,]\d+)*"), 0), lambda x: F.replace(x, F.lit(","), F.lit("")))
