"""How distinctive a term is for a record: log-odds with an informative Dirichlet prior."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from pagewright.operators.skew import join_weighted, partitions_for
from pagewright.plans.materialize import materialize


#: Records with at least this part of all rows count as hot; no more than so many can be.
HOT_RECORDS = 256
_SALTS = 64


def term_frequencies(postings: DataFrame, record: str = "docid", term: str = "token", count: str = "tf") -> tuple[DataFrame, int]:
    """``record, term, tf, n``: a record's count of each term and its total; and the number of records.

    Repeated rows count once, several different rows of a term in a record are added. Rows with a
    null record, term or count, or a count below 1, are left out. One shuffle, by record. Records that
    hold a large part of all rows, of which there are ``HOT_RECORDS`` at most, are spread by their terms
    instead, their repeated rows combined before the shuffle.
    """
    columns = [record, term, count, *(c for c in ("bid", "important") if c in postings.columns)]
    valid = postings.select(*columns).filter(f"`{record}` IS NOT NULL AND `{term}` IS NOT NULL AND `{count}` > 0")
    total = postings.count()
    least = total / HOT_RECORDS
    rows = materialize(valid.groupBy(record).agg(F.count(F.lit(1)).alias("rows")), "record-rows")
    records = rows.count()
    hot = [r[0] for r in rows.filter((F.col("rows") >= least) & (F.col("rows") >= HOT_RECORDS)).select(record).collect()]
    place = ["record"]
    valid = valid.withColumnsRenamed({record: "record", term: "term", count: "tf"})
    if hot:
        is_hot = F.col("record").isin(hot)
        valid = valid.filter(~is_hot).unionByName(valid.filter(is_hot).dropDuplicates())
        valid = valid.withColumn("_salt", F.when(is_hot, F.pmod(F.xxhash64("term"), F.lit(_SALTS))).otherwise(F.lit(0)))
        place = ["record", "_salt"]
    once = valid.repartition(partitions_for(postings.sparkSession, total), *place).dropDuplicates()
    summed = once.groupBy(*place, "term").agg(F.sum("tf").alias("tf"))
    totalled = summed.withColumn("n", F.sum("tf").over(Window.partitionBy(*place)))
    if hot:
        whole = summed.filter(F.col("record").isin(hot)).groupBy("record").agg(F.sum("tf").alias("_n"))
        totalled = totalled.join(F.broadcast(whole), "record", "left").withColumn("n", F.coalesce("_n", "n"))
    return totalled.select("record", "term", "tf", "n"), records


@dataclass(frozen=True)
class Collection:
    """A collection's counts: ``tf`` (record, term, tf, n), ``terms`` (term, all_tf, df) and its totals."""

    tf: DataFrame
    terms: DataFrame
    rows: int
    records: int
    everything: int
    largest: int


def collection(postings: DataFrame, record: str = "docid", term: str = "token", count: str = "tf") -> Collection:
    """Count a collection once; both tables are written."""
    tf, records = term_frequencies(postings, record, term, count)
    seen = Observation()
    figures = [F.count(F.lit(1)).alias("rows"), F.sum("tf").alias("everything"), F.max("n").alias("largest")]
    tf = materialize(tf.observe(seen, *figures), "term-frequencies")
    terms = materialize(tf.groupBy("term").agg(F.sum("tf").alias("all_tf"), F.count(F.lit(1)).alias("df")), "terms")
    known = seen.get
    return Collection(tf, terms, known["rows"], records, int(known["everything"] or 0), int(known["largest"] or 0))


def _scored(c: Collection, prior: float) -> DataFrame:
    joined = join_weighted(c.tf, c.terms, "term", "df", c.rows)
    y, n, rest = F.col("tf").cast("double"), F.col("n").cast("double"), (F.col("all_tf") - F.col("tf")).cast("double")
    a = F.col("all_tf") * F.lit(prior) / F.lit(float(max(c.everything, 1)))
    here = F.try_divide(y + a, n + prior - y - a)
    there = F.try_divide(rest + a, F.lit(float(c.everything)) - n + prior - rest - a)
    error = F.sqrt(F.lit(1.0) / (y + a) + F.lit(1.0) / (rest + a))
    odds = F.when((here > 0) & (there > 0), (F.ln(here) - F.ln(there)) / error)
    return joined.select("record", "term", "tf", "n", "df", F.lit(c.records).cast("long").alias("records"), odds.alias("z"))


def distinctive_terms(postings: DataFrame, record: str = "docid", term: str = "token", count: str = "tf", prior: float | None = None) -> DataFrame:
    """Score each term of each record against the whole collection.

    Log-odds ratio of the record versus all other records, with a Dirichlet prior proportional to
    the collection's counts, divided by its standard error. Columns: ``record, term, tf, n`` (the
    record's total), ``df`` (records with the term), ``records`` (records in all), ``z``. ``prior``
    is the prior's total weight, by default the mean record length. A collection of one record or
    one term, where no odds exist, has null ``z``. An empty table gives no rows.
    """
    c = collection(postings, record, term, count)
    return _scored(c, prior if prior is not None else c.everything / max(c.records, 1))


def least_z(share: float, heaviest: int, largest: int, everything: int, prior: float) -> float:
    """A bound that no term falls below that makes up ``share`` of its record and stands in others too.

    ``heaviest`` is the greatest count of such a term in all records, ``largest`` the greatest total of a
    record. A term's smoothed share of its record is least where one occurrence just makes up the share;
    that of the rest is at most the heaviest term's. Both counts are 1 at least, which bounds the error.
    """
    here = 1 / (1 / share + prior)
    weight = heaviest * (1 + prior / everything)
    there = weight / (everything - largest + prior)
    if there >= 1:
        return -math.inf
    gap = math.log(here / (1 - here)) - math.log(there / (1 - there))
    return gap / math.sqrt(2) if gap >= 0 else gap / math.sqrt(2 / weight)


def filling_terms(
    postings: DataFrame, record: str = "docid", term: str = "token", count: str = "tf", share_percent: int = 3, least_df: int = 2, most_df: int = 12, df_percent: int = 5
) -> DataFrame:
    """Terms that fill a record and are rare in the collection, as ``record, term``.

    Every term of every record gets its z-score; candidates are those whose score reaches the bound that
    the criterion implies for this collection (:func:`least_z`). They are written, then their shares and
    numbers of records are checked exactly. See :func:`term_frequencies` for rows that do not count.
    """
    if least_df < 2:
        raise ValueError("a term of one record has no rest to be compared with")
    c = collection(postings, record, term, count)
    rare = F.col("df").between(least_df, most_df) & (F.col("df") * 100 <= F.lit(c.records) * df_percent)
    heaviest, prior = c.terms.filter(rare).agg(F.max("all_tf")).first()[0], c.everything / max(c.records, 1)
    bound = least_z(share_percent / 100, int(heaviest), c.largest, c.everything, prior) if heaviest else -math.inf
    likely = materialize(_scored(c, prior).filter(F.col("z") >= bound - 1e-9), "likely-terms")
    fills = F.col("tf") * 100 >= F.col("n") * share_percent
    return likely.filter(fills & rare).select(F.col("record").alias(record), F.col("term").alias(term))
