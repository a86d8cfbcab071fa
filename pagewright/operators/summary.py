"""Summaries of pages: what a model is given, an offline default, and the lookup of stored ones."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.functions import text

Model = Callable[[Iterator[pd.Series]], Iterator[pd.Series]]


def inputs(pages: DataFrame, length: int = 512) -> DataFrame:
    """``docid, text``: a page's visible text with white space collapsed, cut to ``length`` characters."""
    return pages.select("docid", F.substring(text.collapse(text.html_text(F.col("content"))), 1, length).alias("text"))


def lead(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The default model: the first 60 words."""
    for some in texts:
        yield some.map(lambda t: " ".join(t.split()[:60]))


def summarize(pages: DataFrame, model: Model = lead) -> DataFrame:
    """``docid, summary`` by a model that maps batches of texts; empty pages have none."""
    run = F.pandas_udf(model, "string")
    return inputs(pages).filter(F.length("text") > 0).select("docid", run("text").alias("summary"))


def latest(summaries: DataFrame, order: str = "seq") -> DataFrame:
    """Of repeated summaries of a page the last one."""
    return summaries.groupBy("docid").agg(F.max_by("summary", order).alias("summary"))


def lookup(docids: DataFrame, summaries: DataFrame) -> DataFrame:
    """Each docid's summary, or the note that there is none."""
    joined = docids.join(summaries, "docid", "left")
    return joined.withColumn("summary", F.when(F.length("summary") > 0, F.col("summary")).otherwise("Summary not found"))
