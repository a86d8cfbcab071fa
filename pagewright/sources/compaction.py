"""Consolidating a mass of tiny files into few well-sized ones.

Spark itself does the packing: the reader combines small files into one split until
``spark.sql.files.maxPartitionBytes`` is reached, counting ``spark.sql.files.openCostInBytes``
for each file. Both are tuned from the listing's own figures, the combined splits are joined
further with ``coalesce`` (no shuffle), and the output is written to a staging folder, verified
and only then renamed into place.
"""

from __future__ import annotations

import contextlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagewright.plans.materialize import delete_path, new_path

RECORD = T.StructType(
    [
        T.StructField("rec_id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("content", T.StringType()),
    ]
)
_PARSED = T.StructType([*RECORD.fields, T.StructField("_broken", T.StringType())])


@dataclass(frozen=True)
class SplitPlan:
    """What the reader and the writer are told.

    ``max_partition_bytes`` and ``open_cost_bytes`` steer how many files make one split;
    ``partitions`` is the number of output files.
    """

    max_partition_bytes: int
    open_cost_bytes: int
    partitions: int


def plan_splits(n_files: int, total_bytes: int, target_bytes: int, slots: int, growth: float = 1.0) -> SplitPlan:
    """Split sizes for ``n_files`` files of ``total_bytes`` in all.

    The open cost is the mean file size, held between 4 kB and 4 MB: a split then holds about
    as many files as their bytes warrant, neither one task a file nor a single task for a
    million opens. ``growth`` is the expected output size over input size.
    """
    mean = total_bytes / n_files if n_files else 0
    open_cost = int(min(max(mean, 4 << 10), 4 << 20))
    weight = total_bytes + n_files * open_cost
    per_slot = math.ceil(weight / max(slots, 1))
    split = int(min(max(per_slot, 1 << 20), target_bytes))
    partitions = max(1, math.ceil(total_bytes * growth / target_bytes))
    return SplitPlan(split, open_cost, partitions)


@contextlib.contextmanager
def split_settings(spark: SparkSession, plan: SplitPlan) -> Iterator[None]:
    """The reader's split settings, put back afterwards."""
    wanted = {
        "spark.sql.files.maxPartitionBytes": str(plan.max_partition_bytes),
        "spark.sql.files.openCostInBytes": str(plan.open_cost_bytes),
        "spark.sql.files.minPartitionNum": "1",
    }
    before = {k: spark.conf.get(k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def listing(spark: SparkSession, path: str, glob: str = "*") -> tuple[int, int]:
    """Number of files and bytes below a path, those with hidden names left out; nothing of them is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    found = files.agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("bytes")).first()
    return found["n"], found["bytes"] or 0


def _fingerprint(columns: list[str]) -> Column:
    """Order-free checksum of rows: a sum of 64-bit row hashes held in 38 digits."""
    packed = F.struct(*[F.col(f"`{c}`") for c in columns])
    return F.sum(F.xxhash64(F.to_json(packed)).cast("decimal(38,0)"))


def _rename(spark: SparkSession, source: str, target: str) -> None:
    jvm = spark.sparkContext._jvm
    src, dst = jvm.org.apache.hadoop.fs.Path(source), jvm.org.apache.hadoop.fs.Path(target)
    fs = dst.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(dst):
        raise FileExistsError(target)
    parent = dst.getParent()
    if parent is not None:
        fs.mkdirs(parent)
    if not fs.rename(src, dst):
        raise OSError(f"rename of {source} failed")


def publish(df: DataFrame, target: str) -> DataFrame:
    """Write ``df`` beside ``target``, verify it, rename it into place and return it as read back.

    The expected row count and checksum come from an observation of the very rows that were
    written, so ``df`` is computed once; the staged files are then read again and compared. A
    difference removes the staging folder and raises ``ValueError``; ``target`` is untouched.
    """
    from pyspark.sql import Observation

    spark = df.sparkSession
    staged = f"{target}.staging"
    delete_path(spark, staged)
    seen = Observation()
    checks = [F.count(F.lit(1)).alias("n"), _fingerprint(df.columns).alias("sum")]
    df.observe(seen, *checks).write.mode("overwrite").parquet(staged)
    wrote = seen.get
    found = spark.read.schema(df.schema).parquet(staged).agg(*checks).first()
    if (found["n"], found["sum"]) != (wrote["n"], wrote["sum"]):
        delete_path(spark, staged)
        raise ValueError(f"staged output differs: {found['n']} rows for {wrote['n']}")
    _rename(spark, staged, target)
    return spark.read.schema(df.schema).parquet(target)


def compact_files(spark: SparkSession, source: str, target: str, fmt: str = "text", target_bytes: int = 128 << 20, **options: str) -> DataFrame:
    """Rewrite the files below ``source`` as few Parquet files of about ``target_bytes`` at ``target``.

    Every row is kept as often as it was there; rows are neither sorted nor shuffled. An empty
    folder gives one empty output. ``target`` must not exist yet.
    """
    n_files, total = listing(spark, source)
    plan = plan_splits(n_files, total, target_bytes, spark.sparkContext.defaultParallelism)
    with split_settings(spark, plan):
        rows = spark.read.format(fmt).options(recursiveFileLookup="true", **options).load(source)
        return publish(rows.coalesce(plan.partitions), target)


def complete_records(files: DataFrame, content: str = "content") -> DataFrame:
    """The records that stand complete in the files' contents, one row for each occurrence.

    A record is one line holding one whole JSON object with a ``rec_id``; white space around it,
    blank lines and both kinds of line ends are allowed. Null or empty contents, cut-off lines,
    lines of other kinds and objects without a ``rec_id`` give no row. Columns of ``files`` other
    than ``content`` are not looked at.
    """
    lines = files.select(F.explode(F.split(F.col(content), r"[\r\n]+")).alias("line"))
    whole = F.regexp_replace("line", r"^[\s\x{FEFF}]+|\s+$", "").alias("line")
    lines = lines.select(whole).filter(F.col("line").startswith("{") & F.col("line").endswith("}"))
    parsed = F.from_json("line", _PARSED, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"})
    rows = lines.select(parsed.alias("r")).filter("r._broken IS NULL AND r.rec_id IS NOT NULL")
    return rows.select("r.rec_id", "r.url", "r.content")


def unique_records(records: DataFrame) -> DataFrame:
    """One row for each ``rec_id``; of differing versions the greatest (url, content) stays.

    The aggregate combines before it shuffles, so an often repeated record moves once a task.
    """
    version = F.struct(F.col("url").isNotNull(), F.col("url"), F.col("content").isNotNull(), F.col("content"))
    kept = records.groupBy("rec_id").agg(F.max(version).alias("v"))
    return kept.select("rec_id", F.col("v.url").alias("url"), F.col("v.content").alias("content"))


def consolidate_store(
    spark: SparkSession,
    store: str,
    target: str | None = None,
    content: str = "content",
    target_bytes: int = 128 << 20,
) -> DataFrame:
    """Consolidate a crawl store, a table with one row a small file, into few Parquet files.

    Returns the consolidated records ``rec_id, url, content``, each complete record exactly once,
    as read back from the verified output at ``target`` (a new folder in the shared folder if
    none is given). An empty store gives an empty output. Splits are planned from the number and bytes
    of the files that the rows stand for; all complete records are packed by coalescing splits, written
    and verified. Then only ids are grouped: records that stand once are taken over as they lie, those
    that stand several times, or differ, are moved and reduced to one.
    """
    size = F.sum(F.coalesce(F.octet_length(content), F.lit(0)))
    listed = spark.read.parquet(store).agg(F.count(F.lit(1)).alias("n"), size.alias("bytes")).first()
    slots = spark.sparkContext.defaultParallelism
    plan = plan_splits(listed["n"], listed["bytes"] or 0, target_bytes, slots)
    packed_at = new_path(spark, "packed")
    with split_settings(spark, plan):
        records = complete_records(spark.read.parquet(store).select(content), content)
        packed = publish(records.coalesce(max(plan.partitions, slots)), packed_at)
        several = packed.groupBy("rec_id").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("rec_id")
        once = packed.join(several, "rec_id", "left_anti")
        rows = once.unionByName(unique_records(packed.join(several, "rec_id", "left_semi"))).select("rec_id", "url", "content")
        out = publish(rows.coalesce(plan.partitions), target or new_path(spark, "consolidated"))
    delete_path(spark, packed_at)
    return out


def write_small_files(files: DataFrame, folder: str, content: str = "content") -> None:
    """Write each row's content as a text file of its own, a null one as an empty file."""
    rows = files.select(F.coalesce(F.col(content), F.lit("")).alias("value"))
    rows.write.mode("overwrite").option("maxRecordsPerFile", 1).text(folder)


def rewritten_store(files: DataFrame, content: str = "content", target_bytes: int = 128 << 20) -> DataFrame:
    """Lay a store out as real small files, compact their folder, and say what came of it.

    One row: ``files_in, files_out, lines, records``; ``lines`` counts the lines that are not blank.
    """
    spark = files.sparkSession
    small, large = new_path(spark, "small-files"), new_path(spark, "compacted")
    write_small_files(files, small, content)
    before = listing(spark, small, "*.txt")[0]
    packed = compact_files(spark, small, large, target_bytes=target_bytes)
    after = listing(spark, large, "*.parquet")[0]
    delete_path(spark, small)
    lines = packed.filter(r"value RLIKE '[^\\s]'").agg(F.count(F.lit(1)).alias("lines"))
    records = complete_records(packed.withColumnRenamed("value", "content")).agg(F.countDistinct("rec_id").alias("records"))
    figures = [F.lit(before).cast("long").alias("files_in"), F.lit(after).cast("long").alias("files_out")]
    return lines.join(F.broadcast(records)).select(*figures, "lines", "records")
