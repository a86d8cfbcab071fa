"""Reading pages: scans of JSON files and the delivered page table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagewright.functions import text

PAGE = T.StructType([T.StructField("url", T.StringType()), T.StructField("content", T.StringType())])


def scan_json(spark: SparkSession, folder: str) -> DataFrame:
    """Pages of a folder of ``*.json`` files, one page a file, as ``docid, url, content``.

    The docid is the 1-based place of the file's path in path order, so it does not depend on how the
    files are listed; missing fields are empty strings.
    """
    from pagewright.operators.ranking import row_number_by_text

    reader = spark.read.schema(PAGE).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json")
    rows = reader.json(folder).withColumn("path", F.col("_metadata.file_path"))
    named = row_number_by_text(rows, "path", "docid")
    return named.select("docid", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("content", F.lit("")).alias("content"))


def delivered(pages: DataFrame) -> DataFrame:
    """One row a docid of a page table in which pages were delivered again: the first arrival.

    Ties and null times go by url and content; rows with a null docid are left out. Only the ids are
    grouped over the whole table; contents are moved and sorted for pages that came more than once.
    """
    rows = pages.filter("docid IS NOT NULL")
    several = rows.groupBy("docid").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("docid")
    order = [F.col("ingested_at").asc_nulls_last()] if "ingested_at" in pages.columns else []
    first = Window.partitionBy("docid").orderBy(*order, "url", "content")
    again = rows.join(several, "docid", "left_semi").withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")
    once = rows.join(several, "docid", "left_anti").unionByName(again)
    return once.select("docid", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("content", F.lit("")).alias("content"))


def clean(pages: DataFrame) -> DataFrame:
    """Pages with stripped content, without those that then are empty."""
    return pages.withColumn("content", text.strip(F.col("content"))).filter(F.length("content") > 0)
