"""Column functions on how an answer is shown: light markup, labels, numbers, tags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

#: Badge classes of confidences: fixed values.
BADGES = {"high": "badge high", "low": "badge low", "unknown": "badge low", "abstain": "badge abstain", "none": "badge abstain"}
#: Patterns of light markup: fixed values.
BULLET, BOLD, HEADING = r"\A[*\-]\s+(.*)\z", r"\*\*(.+?)\*\*", r"\A\*\*(.+?)\*\*[:：]?\z"
#: Names of files that are served: a fixed value.
FILE_NAME = r"\A[A-Za-z0-9._\-]{1,128}\z"


def escaped(text: Column) -> Column:
    """HTML escapes of the three characters that need them."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def inline(text: Column) -> Column:
    return F.regexp_replace(escaped(text), BOLD, "<strong>$1</strong>")


def line_kind(line: Column) -> Column:
    """blank, bullet, heading (bold throughout) or text."""
    line = strip(line)
    return F.when(line == "", "blank").when(line.rlike(BULLET), "bullet").when(line.rlike(HEADING), "heading").otherwise("text")


def line_html(line: Column) -> Column:
    """One line of an answer; a blank one gives nothing."""
    kind, bare = line_kind(line), strip(line)
    item = F.concat(F.lit("<li>"), inline(F.regexp_extract(bare, BULLET, 1)), F.lit("</li>"))
    head = F.concat(F.lit('<div class="ans-h">'), escaped(F.regexp_extract(bare, HEADING, 1)), F.lit("</div>"))
    return F.when(kind == "blank", "").when(kind == "bullet", item).when(kind == "heading", head).otherwise(F.concat(F.lit("<p>"), inline(bare), F.lit("</p>")))


def answer_html(text: Column) -> Column:
    """A whole answer: neighbouring bullets share a list."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    done = F.transform(lines, lambda x: F.struct((line_kind(x) == "bullet").alias("item"), line_html(x).alias("html")))
    piece = lambda x, i: F.concat(
        F.when(x["item"] & ~F.coalesce(F.get(done, i - 1)["item"], F.lit(False)), "<ul>").otherwise(""),
        x["html"],
        F.when(x["item"] & ~F.coalesce(F.get(done, i + 1)["item"], F.lit(False)), "</ul>").otherwise(""),
    )
    return F.array_join(F.transform(done, piece), "")


def badge(confidence: Column) -> Column:
    out = F.when(confidence.isNull(), "badge")
    for name, value in BADGES.items():
        out = out.when(confidence == name, value)
    return out.otherwise("badge")


def fixed(number: Column, places: int) -> Column:
    """A number with a fixed number of decimals; null gives a dash."""
    return F.when(number.isNull(), "-").otherwise(F.format_string(f"%.{places}f", number.cast("double")))


def shown_pairs(m: Column) -> Column:
    """A map without the keys whose value is null or empty."""
    return F.map_filter(m, lambda k, v: v.isNotNull() & (v != ""))


def tags(base: list[str], extra: Column, conditional: Column, when: Column) -> Column:
    """``base`` and ``extra`` in order, each once, with ``conditional`` at the end where ``when`` holds."""
    both = F.array_union(F.array(*[F.lit(x) for x in base]), F.coalesce(extra, F.expr("array()").cast("array<string>")))
    return F.when(F.coalesce(when, F.lit(False)), F.array_union(both, F.array(conditional))).otherwise(both)


def is_file_name(text: Column) -> Column:
    """A plain name of a picture, without folders or steps up."""
    safe = text.rlike(FILE_NAME) & ~F.contains(text, F.lit(".."))
    return F.coalesce(safe, F.lit(False))
