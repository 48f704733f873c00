"""How hits and progress are shown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataform.functions.text import xml_escape
from strataform.operators.lexical import SEPARATOR

DETAIL = 100


def document_url(doc_id: Column) -> Column:
    return F.concat(F.lit("https://docs.google.com/document/d/"), doc_id, F.lit("/edit"))


def suggestion(name: Column, breadcrumbs: Column, snippet: Column) -> Column:
    """One line of markup: name, place, and a hundred characters of text, cut before escaping."""
    place = F.array_join(breadcrumbs, SEPARATOR)
    where = F.when(F.length(place) > 0, F.concat(F.lit(" <dim>"), xml_escape(place), F.lit("</dim>"))).otherwise("")
    return F.concat(F.lit("<match>"), xml_escape(name), F.lit("</match>"), where, F.lit(" — "), xml_escape(F.substring(snippet, 1, DETAIL)))


def percent(done: Column, total: Column) -> Column:
    return F.when(total > 0, F.floor(100 * done / total + 0.5)).otherwise(0)


def remaining_text(seconds: Column) -> Column:
    minutes = F.floor(seconds / 60 + 0.5)
    return F.when(seconds.isNull(), "estimating…").when(seconds < 60, F.concat(seconds.cast("string"), F.lit(" s"))).otherwise(F.concat(minutes.cast("string"), F.lit(" min")))


def score_table(scores: DataFrame, width: int = 10) -> DataFrame:
    """Metrics with three decimals, padded; a longer mode name isn't cut."""
    cell = lambda c: F.lpad(F.format_number(c, 3), width, " ")
    pad = F.when(F.length("mode") >= width, F.col("mode")).otherwise(F.rpad("mode", width, " "))
    return scores.select(F.concat(pad, *[cell(c) for c in scores.columns if c != "mode"]).alias("line"))
