"""Registered queries of the training-text operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm import distinctive, encoding, fusion, mainbody, neardup, packing, residue, spans, stuffing
from pagewright.sources.tables import spread, table

Query = Callable[[SparkSession, str], DataFrame]
SCORES = ["pr_quality", "hub_quality", "auth_quality"]


def p1_found(spark: SparkSession, directory: str) -> DataFrame:
    """Blocks of the pages' main bodies."""
    return mainbody.main_body(table(spark, directory, "page_blocks"), spread(spark, directory, "pages"))


def p1_bodies(spark: SparkSession, directory: str) -> DataFrame:
    """The main body of every page, from its HTML alone."""
    return mainbody.bodies(spread(spark, directory, "pages"))


def p2_found(spark: SparkSession, directory: str) -> DataFrame:
    """Pages that are mainly repeated keywords or bare links."""
    return stuffing.stuffed_pages(spread(spark, directory, "pages"), table(spark, directory, "doclinks")).filter("stuffed").select("docid")


def p2_link_profile(spark: SparkSession, directory: str) -> DataFrame:
    """How many distinct targets and hosts each page links to."""
    profile = stuffing.link_profile(table(spark, directory, "doclinks"))
    return profile.select("src", "links", "hosts", F.round("top_share", 6).alias("top_share"))


def p3_found(spark: SparkSession, directory: str) -> DataFrame:
    """Pairs of pages that share at least half of their three-word sequences."""
    members, links = neardup.near_duplicates(spread(spark, directory, "pages"), width=3, threshold=0.5)
    return neardup.all_pairs(members, links)


def p3_groups(spark: SparkSession, directory: str) -> DataFrame:
    """Each page's class of equal texts, its links to other classes and its group."""
    members, links = neardup.near_duplicates(spread(spark, directory, "pages"), width=3, threshold=0.5)
    return neardup.duplicate_groups(members, links)


def p4_found(spark: SparkSession, directory: str) -> DataFrame:
    """Pages that show template residue, filler, errors or a demand for scripts."""
    return residue.page_residue(spread(spark, directory, "pages")).filter("residue").select("docid")


def p6_found(spark: SparkSession, directory: str) -> DataFrame:
    """Tokens that fill a record and are rare in the collection."""
    return distinctive.filling_terms(table(spark, directory, "postings"))


def p6_scores(spark: SparkSession, directory: str) -> DataFrame:
    """Every token of every record with its z-score."""
    scored = distinctive.distinctive_terms(table(spark, directory, "postings"))
    return scored.select(F.col("record").alias("docid"), F.col("term").alias("token"), "tf", "n", "df", F.round("z", 6).alias("z"))


def p7_found(spark: SparkSession, directory: str) -> DataFrame:
    """Records in the best tenth by each score."""
    standings = fusion.score_standings(table(spark, directory, "docinfo"), "docid", SCORES)
    return fusion.best_by_all(standings, "docid", SCORES)


def p7_standings(spark: SparkSession, directory: str) -> DataFrame:
    """Each record's percentile by each score."""
    standings = fusion.score_standings(table(spark, directory, "docinfo"), "docid", SCORES)
    return standings.select("docid", *[f"{s}_above" for s in SCORES], *[F.round(f"{s}_pct", 9).alias(f"{s}_pct") for s in SCORES])


def p7_ranking(spark: SparkSession, directory: str) -> DataFrame:
    """The one ranking of all records."""
    return fusion.fused_ranking(table(spark, directory, "docinfo"), "docid", SCORES)


def p8_ids(spark: SparkSession, directory: str) -> DataFrame:
    """The ids of every document by byte_bpe_50k."""
    return encoding.encode_corpus(spread(spark, directory, "documents"))


def p9_found(spark: SparkSession, directory: str) -> DataFrame:
    """Documents that alone are larger than a container and so were split."""
    packed = packing.pack(encoding.token_counts(spread(spark, directory, "documents")))
    return packed.filter("pieces > 1").select("doc_id").distinct()


def p9_containers(spark: SparkSession, directory: str) -> DataFrame:
    """Which container each document, or each piece of a split one, is in."""
    return packing.pack(encoding.token_counts(spread(spark, directory, "documents")))


def p10_found(spark: SparkSession, directory: str) -> DataFrame:
    """Pairs of documents with a run of 200 characters in common."""
    members, _, sets = spans.shared_spans(spread(spark, directory, "documents"))
    return spans.sharing_pairs(members, sets)


def p10_shares(spark: SparkSession, directory: str) -> DataFrame:
    """How much of each document stands word for word in others."""
    members, intervals, _ = spans.shared_spans(spread(spark, directory, "documents"))
    return spans.shared_shares(members, intervals)


def p10_groups(spark: SparkSession, directory: str) -> DataFrame:
    """Each document's class of equal texts, its links to other classes and its group."""
    members, _, sets = spans.shared_spans(spread(spark, directory, "documents"))
    return spans.sharing_groups(members, sets)


QUERIES: dict[str, Query] = {
    "p1_found": p1_found,
    "p1_bodies": p1_bodies,
    "p2_found": p2_found,
    "p2_link_profile": p2_link_profile,
    "p3_found": p3_found,
    "p3_groups": p3_groups,
    "p4_found": p4_found,
    "p6_found": p6_found,
    "p6_scores": p6_scores,
    "p7_found": p7_found,
    "p7_standings": p7_standings,
    "p7_ranking": p7_ranking,
    "p8_ids": p8_ids,
    "p9_found": p9_found,
    "p9_containers": p9_containers,
    "p10_found": p10_found,
    "p10_shares": p10_shares,
    "p10_groups": p10_groups,
}

_P6 = """
WITH d AS (SELECT docid, token, sum(tf) AS tf FROM (SELECT DISTINCT * FROM postings WHERE tf > 0) GROUP BY ALL),
n AS (SELECT docid, sum(tf) AS n FROM d GROUP BY docid),
t AS (SELECT token, sum(tf) AS all_tf, count(*) AS df FROM d GROUP BY token),
s AS (SELECT sum(n) AS everything, count(*) AS records, sum(n) / count(*) AS a0 FROM n)
"""
_P6_Z = (
    _P6
    + """, x AS (SELECT docid, token, tf, n, df, all_tf * a0 / everything AS a, tf + all_tf * a0 / everything AS ya,
  all_tf - tf + all_tf * a0 / everything AS ra, n + a0 AS na, everything - n + a0 AS nr
  FROM d JOIN n USING (docid) JOIN t USING (token), s)
SELECT docid, token, CAST(tf AS BIGINT) AS tf, CAST(n AS BIGINT) AS n, df,
  round((ln(ya / (na - ya)) - ln(ra / (nr - ra))) / sqrt(1 / ya + 1 / ra), 6) AS z FROM x"""
)
_ONE = "WITH o AS (SELECT docid, " + ", ".join(f"max(CASE WHEN {s} >= 0 AND NOT isnan({s}) THEN CAST({s} AS DOUBLE) END) AS {s}" for s in SCORES) + " FROM docinfo WHERE docid IS NOT NULL GROUP BY docid)"
_STAND = (
    _ONE
    + ", r AS (SELECT docid, count(*) OVER () AS n, "
    + ", ".join(f"{s}, rank() OVER (ORDER BY {s} DESC NULLS LAST) - 1 AS {s}_above, count(*) OVER (PARTITION BY {s}) AS {s}_ties" for s in SCORES)
    + " FROM o)"
)
_PCT = ", ".join(f"(n - {s}_above - {s}_ties / 2) / n AS {s}_pct" for s in SCORES)


def _inverse_normal(p: str) -> str:
    def horner(c: tuple[float, ...], x: str) -> str:
        out = repr(c[0]) + "::DOUBLE"
        for k in c[1:]:
            out = f"({out} * {x} + {k!r}::DOUBLE)"
        return out

    r, t = f"(({p} - 0.5) * ({p} - 0.5))", f"sqrt(-2.0 * ln(least({p}, 1.0 - {p})))"
    tail = f"{horner(fusion.TAIL_NUM, t)} / {horner(fusion.TAIL_DEN, t)}"
    return f"CASE WHEN {p} < {fusion.TAIL} THEN {tail} WHEN {p} > {1 - fusion.TAIL} THEN -({tail}) ELSE {horner(fusion.CENTRE_NUM, r)} * ({p} - 0.5) / {horner(fusion.CENTRE_DEN, r)} END"


ORACLE: dict[str, str] = {
    "p2_link_profile": """
WITH e AS (SELECT DISTINCT src, dst_url FROM doclinks WHERE src IS NOT NULL AND dst_url IS NOT NULL),
h AS (SELECT src, regexp_extract(dst_url, '^[a-zA-Z]+://([^/?#]*)', 1) AS host, count(*) AS n FROM e GROUP BY ALL)
SELECT src, CAST(sum(n) AS BIGINT) AS links, count(*) AS hosts, round(max(n) / sum(n), 6) AS top_share FROM h GROUP BY src""",
    "p6_found": _P6 + "SELECT docid, token FROM d JOIN n USING (docid) JOIN t USING (token), s WHERE tf * 100 >= n * 3 AND df BETWEEN 2 AND 12 AND df * 100 <= records * 5",
    "p6_scores": _P6_Z,
    "p7_found": _STAND + " SELECT docid FROM r WHERE " + " AND ".join(f"{s} IS NOT NULL AND {s}_above * 10 < n" for s in SCORES),
    "p7_standings": _STAND + ", q AS (SELECT *, " + _PCT + " FROM r) SELECT docid, " + ", ".join(f"{s}_above, round({s}_pct, 9) AS {s}_pct" for s in SCORES) + " FROM q",
    "p7_ranking": _STAND
    + ", q AS (SELECT *, "
    + _PCT
    + " FROM r), z AS (SELECT docid, round(("
    + " + ".join(_inverse_normal(f"{s}_pct") for s in SCORES)
    + ") / 3.0, 9) AS score FROM q) SELECT docid, score, row_number() OVER (ORDER BY score DESC, docid) AS rank FROM z",
}
