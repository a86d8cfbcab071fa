"""Indexing in batches: resume after an interruption, duplicates told against all earlier batches."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagewright.functions import hashing
from pagewright.operators import dedup, index
from pagewright.params import COMPAT, Params
from pagewright.plans.materialize import exists, materialize

VERSION = 1
REGISTERED = T.StructType(
    [
        T.StructField("docid", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("crc", T.LongType()),
        T.StructField("n_bytes", T.IntegerType()),
        T.StructField("fp", T.LongType()),
        T.StructField("kept", T.BooleanType()),
        T.StructField("batch", T.LongType()),
    ]
)
MANIFEST = T.StructType([T.StructField(n, T.LongType()) for n in ("version", "last_docid", "batch")])


def _stored(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)


def last_docid(spark: SparkSession, folder: str) -> int:
    """The last docid of the completed batches; raises if they were written by another version."""
    row = _stored(spark, f"{folder}/manifest", MANIFEST).agg(F.max("last_docid").alias("last"), F.min("version").alias("low"), F.max("version").alias("high")).first()
    if row["low"] is not None and (row["low"], row["high"]) != (VERSION, VERSION):
        raise ValueError(f"index of version {row['low']}, expected {VERSION}")
    return row["last"] or 0


def append(pages: DataFrame, folder: str, batch: int, params: Params = COMPAT) -> None:
    """Add a batch of cleaned pages ``docid, url, content`` to the index in a folder.

    Pages up to the last indexed docid are skipped. Addresses and contents are compared with all that
    earlier batches registered, fingerprints with the last ones kept, so the result is that of one build
    over all pages. Each part goes to a partition of its own and the manifest last: a batch that failed
    is simply written again.
    """
    spark = pages.sparkSession
    earlier = _stored(spark, f"{folder}/registered", REGISTERED).filter(F.col("batch") < batch)
    key = F.col("url") if params.compat else F.substring_index("url", "#", 1)
    fresh = materialize(pages.filter(F.col("docid") > last_docid(spark, folder)), "batch")
    crc, size = hashing.exact_hash(F.col("content"))
    by_url = dedup.by_url(fresh, params).withColumn("_key", key).join(earlier.select(key.alias("_key")).distinct(), "_key", "left_anti").drop("_key")
    by_url = materialize(by_url.withColumns({"crc": crc, "n_bytes": size}), "batch-urls")
    unique = dedup.by_content(by_url).join(earlier.select("crc", "n_bytes").distinct(), ["crc", "n_bytes"], "left_anti")
    unique = materialize(unique, "batch-unique")
    counts = materialize(index.token_counts(unique, params), "batch-counts")
    vocab = index.vocabulary(counts)
    prints = materialize(index.fingerprints(unique, counts, vocab), "batch-prints")
    tail = earlier.filter("kept").select("docid", "fp").orderBy(F.desc("docid")).limit(params.window)
    kept = materialize(dedup.by_fingerprint(tail.unionByName(prints), params).join(prints, "docid", "left_semi"), "batch-kept")
    part = index.build(unique.join(kept, "docid", "left_semi").select("docid", "url", "content"), replace(params, hamming=-1))
    flags = by_url.select("docid", "url", "crc", "n_bytes").join(prints, "docid", "left").join(kept.withColumn("kept", F.lit(True)), "docid", "left")
    flags.withColumn("kept", F.coalesce("kept", F.lit(False))).write.mode("overwrite").parquet(f"{folder}/registered/batch={batch}")
    index.save(part, f"{folder}/parts/batch={batch}")
    done = fresh.agg(F.lit(VERSION).cast("long").alias("version"), F.coalesce(F.max("docid"), F.lit(0)).cast("long").alias("last_docid"))
    done.write.mode("overwrite").parquet(f"{folder}/manifest/batch={batch}")


def load(spark: SparkSession, folder: str) -> index.Index:
    """The index of all completed batches."""
    batches = sorted(r.batch for r in _stored(spark, f"{folder}/manifest", MANIFEST).select("batch").distinct().collect())
    if not batches:
        raise ValueError(f"no completed batch in {folder}")
    parts = [index.load(spark, f"{folder}/parts/batch={b}") for b in batches]
    out = parts[0]
    for p in parts[1:]:
        out = index.Index(out.docinfo.unionByName(p.docinfo), out.postings.unionByName(p.postings), out.doclinks.unionByName(p.doclinks))
    return out
