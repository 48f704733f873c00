"""Listing documents and reading their bodies from files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataform.operators.changefeed import DOCUMENT_MIME


def list_documents(files: DataFrame, mime: str = DOCUMENT_MIME) -> DataFrame:
    """``id, name, modified_time`` of the documents that aren't trashed, newest first.

    Filter and columns reach the file scan.
    """
    kept = files.where((F.col("mime_type") == mime) & ~F.coalesce(F.col("trashed"), F.lit(False)))
    return kept.select("id", "name", "modified_time").orderBy(F.col("modified_time").desc_nulls_last(), "id")


def read_bodies(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, text`` of whole text files; the id is the file's name without its ending."""
    files = spark.read.text(path, wholetext=True)
    name = F.element_at(F.split(F.input_file_name(), "/"), -1)
    return files.select(F.regexp_replace(name, r"\.[^.]*$", "").alias("doc_id"), F.col("value").alias("text"))


def with_bodies(docs: DataFrame, bodies: DataFrame) -> DataFrame:
    """Listed documents with their body, null where there is none."""
    return docs.join(bodies, docs["id"] == bodies["doc_id"], "left").select(docs["*"], bodies["text"])
