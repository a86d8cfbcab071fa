"""Registered queries of the storage maintenance operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pagewright.sources.compaction import consolidate_store, rewritten_store
from pagewright.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def p5_found(spark: SparkSession, directory: str) -> DataFrame:
    """Ids of the records in the consolidated crawl store."""
    return consolidate_store(spark, f"{directory}/page_files.parquet").select("rec_id")


def p5_consolidated(spark: SparkSession, directory: str) -> DataFrame:
    """The consolidated crawl store itself."""
    return consolidate_store(spark, f"{directory}/page_files.parquet")


def p5_compacted(spark: SparkSession, directory: str) -> DataFrame:
    """The crawl store as real small files, one a row, compacted: files in and out, lines and records."""
    return rewritten_store(table(spark, directory, "page_files"))


QUERIES: dict[str, Query] = {"p5_found": p5_found, "p5_consolidated": p5_consolidated, "p5_compacted": p5_compacted}

_RECORDS = r"""
WITH lines AS (
  SELECT trim(unnest(regexp_split_to_array(content, '[\r\n]+')), E' \t\f\v') AS line FROM page_files
), ok AS (
  SELECT CAST(json_extract_string(line, '$.rec_id') AS BIGINT) AS rec_id,
         json_extract_string(line, '$.url') AS url, json_extract_string(line, '$.content') AS content
  FROM lines WHERE line LIKE '{%}' AND json_valid(line)
)
"""

ORACLE: dict[str, str] = {
    "p5_compacted": _RECORDS
    + """SELECT (SELECT count(*) FROM page_files) AS files_in,
      (SELECT CAST(greatest(1, ceil(sum(octet_length(encode(coalesce(content, ''))) + 1) / 134217728)) AS BIGINT) FROM page_files) AS files_out,
      (SELECT count(*) FROM lines WHERE regexp_matches(line, '[^ \\t\\n\\f\\r\\v]')) AS lines, (SELECT count(DISTINCT rec_id) FROM ok) AS records""",
    "p5_found": _RECORDS + "SELECT DISTINCT rec_id FROM ok WHERE rec_id IS NOT NULL",
    "p5_consolidated": _RECORDS
    + """SELECT rec_id, v.url AS url, v.content AS content FROM (
      SELECT rec_id, max({'url': url, 'content': content}) AS v FROM ok WHERE rec_id IS NOT NULL GROUP BY rec_id)""",
}
