"""The texts of sections and parsed documents in one form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veinwork.session import table


def section_rows(spark: SparkSession, sf_dir: str, together: str | None = None) -> DataFrame:
    """Sections with one row for each key; a key delivered twice keeps its longest text.

    With together = 'doc_id' they are shuffled once, by document, and may be joined by it as they are.
    """
    s = table(spark, sf_dir, "sections").select("doc_id", "sec_no", "heading", "text", "page")
    s = s.repartition(together) if together else s
    kept = s.groupBy("doc_id", "sec_no").agg(F.max(F.struct(F.length("text").alias("n"), "text", "heading", "page")).alias("r"))
    return kept.select("doc_id", "sec_no", "r.heading", "r.text", "r.page")


def delivered_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, sec_no, text): sections as delivered, some twice, and full texts with sec_no 0; no shuffle."""
    full = table(spark, sf_dir, "parsed_documents").select("doc_id", F.lit(0).alias("sec_no"), F.col("full_text").alias("text"))
    return table(spark, sf_dir, "sections").select("doc_id", "sec_no", "text").unionByName(full)


def all_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, sec_no, text): sections, each once, and full texts with sec_no 0."""
    full = table(spark, sf_dir, "parsed_documents").select("doc_id", F.lit(0).alias("sec_no"), F.col("full_text").alias("text"))
    return section_rows(spark, sf_dir).select("doc_id", "sec_no", "text").unionByName(full)
