"""Keyword-stuffed and link-list pages, told by how their terms recur."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm import lexicon
from pagewright.llm.markup import Block, blocks
from pagewright.llm.residue import filler_words

_WORD = re.compile(r"[^\W\d_]+|\d+")
_END = re.compile(r"[.!?](?:\s|$)")
COLUMNS = "terms int, recurring double, regular double, autocorrelation double, function double, linked double, stuffed boolean"


#: Terms from which shares count as they are.
MANY = 60


class Recurrence(NamedTuple):
    """How the terms of one page recur.

    ``recurring`` is the share of terms that are content words standing again within the lag window;
    ``regular`` the number of gaps, short or outside running text, that lie close to their term's mean
    gap, as a share of the terms;
    ``autocorrelation`` the greatest share, over lags, of content terms equal to the one a lag before,
    beyond the short lags outside running text only;
    ``function`` the share of function words and ``linked`` that of characters in links.
    """

    terms: int
    recurring: float
    regular: float
    autocorrelation: float
    function: float
    linked: float
    stuffed: bool


NOTHING = Recurrence(0, 0.0, 0.0, 0.0, 0.0, 0.0, False)


def _surely(share: float, n: int, z: float = 4.0) -> float:
    """The share that so many terms prove: the lower bound of Wilson's interval at ``z`` standard errors."""
    return (share + z * z / (2 * n) - z * float(np.sqrt(max(share * (1 - share), 0.0) / n + z * z / (4 * n * n)))) / (1 + z * z / n)


def _matches(ids: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """For each lag below ``n``, how many of the terms ``ids`` standing ``at`` places equal the one that lag before.

    Frequent terms by Fourier transform, the others pair by pair.
    """
    out = np.zeros(n, dtype=np.int64)
    order = np.argsort(ids, kind="stable")
    who, where = ids[order], at[order]
    hot = np.bincount(who) > np.sqrt(32 * n) if len(who) else np.zeros(0, dtype=bool)
    for k in np.flatnonzero(hot):
        row = np.zeros(2 * n)
        row[where[who == k]] = 1.0
        out += np.rint(np.fft.irfft(np.abs(np.fft.rfft(row)) ** 2, 2 * n)[:n]).astype(np.int64)
    cold = ~hot[who]
    who, where = who[cold], where[cold]
    for m in range(1, len(who)):
        same = who[m:] == who[:-m]
        if not same.any():
            break
        out += np.bincount((where[m:] - where[:-m])[same], minlength=n)
    out[0] = 0
    return out


def _listed(units: list[tuple[str, int, int, int, int]], n: int, bare: float) -> bool:
    """Whether most of the page's terms stand in blocks or paths that no sentence holds together.

    ``units`` has each block's path, terms, words, function words and sentence ends. Function words must be
    less than ``bare``, and there must be words enough to tell that from chance.
    """

    def is_list(terms: int, words: int, functions: int, ends: int) -> bool:
        return functions < bare * words and ends * 40 < terms and words > 0.6 * terms

    paths: dict[str, np.ndarray] = {}
    for path, *figures in units:
        paths[path] = paths.get(path, 0) + np.array(figures)
    whole = {path for path, figures in paths.items() if is_list(*figures)}
    chosen = [u for u in units if u[0] in whole or (u[1] >= 20 and is_list(*u[1:]))]
    terms, words, functions = (sum(u[k] for u in chosen) for k in (1, 2, 3))
    return terms >= 0.5 * n and words > 0 and _surely(1 - functions / words, words) >= 0.85


def _least(share: float, n: int) -> float:
    """The share that ``n`` terms must reach: ``share`` for :data:`MANY` terms or more, the more for fewer."""
    return share * max(1.0, MANY / n) ** 1.5


def recurrence(page: list[Block], window: int = 40, lags: int = 24, least: float = 0.3, periodic: float = 0.15, bare: float = 0.03, even: float = 0.3) -> Recurrence:
    """Measure one page and flag it if its terms recur like keywords.

    Flagged are pages of which ``least`` of the terms recur within ``window`` terms, or ``periodic``
    repeat at one lag, or ``even`` stand at regular gaps, or of which half stands in blocks or paths in
    which function words make up less than ``bare`` and that no sentence holds together. Lags and gaps
    may be as long as the page; beyond ``lags`` and ``window``, text that is running (with 15 % function
    words) does not count, as copied paragraphs would. Shares must be larger the fewer the terms
    (:func:`_least`), or proven by their number. The title, numbers, words of up to two letters, filler text and
    rows of a table (5 to 40 words, two numbers or more among them) do not count as recurring.
    """
    body = [b for b in page if b.tag != "title"]
    words: list[str] = []
    tabular: list[bool] = []
    running: list[bool] = []
    units: list[tuple[str, int, int, int, int]] = []
    ends = 0
    for b in body:
        found = _WORD.findall(b.text.lower())
        if filler_words(found) >= 5:
            continue
        words += found
        numbers = sum(w[0].isdigit() for w in found)
        tabular += [5 <= len(found) <= 40 and numbers >= 2 and numbers >= 0.15 * len(found)] * len(found)
        functions, stops = sum(w in lexicon.FUNCTION_WORDS for w in found), len(_END.findall(b.text))
        running += [functions >= 0.15 * len(found)] * len(found)
        units.append((b.path, len(found), len(found) - numbers, functions, stops))
        ends += stops
    n = len(words)
    if not n:
        return NOTHING
    number: dict[str, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), dtype=np.int32, count=n)
    digits = np.array([w[0].isdigit() for w in number])
    function_word = np.array([w in lexicon.FUNCTION_WORDS for w in number])
    counts = ~digits & ~function_word & np.array([len(w) > 2 for w in number])
    content, alphabetic, functional = counts[ids] & ~np.array(tabular), ~digits[ids], function_word[ids]
    order = np.argsort(ids, kind="stable")
    ranked = ids[order]
    gaps = np.diff(order)
    free = content & ~np.array(running)
    same = (ranked[1:] == ranked[:-1]) & content[order[1:]] & content[order[:-1]]
    near = (ranked[1:] == ranked[:-1]) & content[order[1:]] & (gaps <= window)
    again = np.zeros(n, dtype=bool)
    again[order[1:][near]] = True
    again[order[:-1][near]] = True
    counted = near | (same & free[order[1:]] & free[order[:-1]])
    chosen, owner = gaps[counted], ranked[1:][counted]
    regular = 0.0
    if len(chosen):
        times = np.bincount(owner, minlength=len(number))
        mean = np.bincount(owner, weights=chosen, minlength=len(number)) / np.maximum(times, 1)
        steady = (times[owner] >= 3) & (np.abs(chosen - mean[owner]) <= np.maximum(1, 0.25 * mean[owner]))
        regular = float(steady.sum() / n)
    key = np.where(content, ids, -np.arange(1, n + 1))
    short = max((float(np.count_nonzero(key[k:] == key[:-k])) / n for k in range(1, min(lags, n - 1) + 1)), default=0.0)
    far = _matches(ids[free], np.flatnonzero(free), n)[lags + 1 :]
    auto = max(short, float(far.max(initial=0)) / n)
    function = float(functional.sum() / max(alphabetic.sum(), 1))
    linked = sum(b.linked for b in body) / max(sum(len(b.text) for b in body), 1)
    share = float(again.mean())
    listed = function < bare and _surely(1 - function, n) >= 0.75 and ends * 40 < n and alphabetic.mean() > 0.6
    plain = share >= _least(least, n) or short >= _least(periodic, n) or listed
    stuffed = plain or _surely(share, n) >= least or _surely(auto, n) >= periodic or _surely(min(regular, 1.0), n) >= even or _listed(units, n, bare)
    return Recurrence(n, share, regular, auto, function, min(linked, 1.0), bool(stuffed))


def page_recurrence(pages: DataFrame, key: str = "docid", content: str = "content") -> DataFrame:
    """Recurrence figures for each page: ``key`` and the columns of :class:`Recurrence`.

    One row a distinct key; of repeated or differing rows with one key the greatest figures stay. Rows
    with a null key are left out; null, empty and white-space contents have zero figures. Texts are
    read whole. Other columns are not looked at; an empty table gives no rows.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [recurrence(blocks(c)) if isinstance(c, str) and c.strip() else NOTHING for c in batch["content"]]
            yield pd.concat([batch[["key"]].reset_index(drop=True), pd.DataFrame(rows, columns=Recurrence._fields)], axis=1)

    kind = pages.schema[key].dataType.simpleString()
    chosen = pages.filter(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(content).alias("content"))
    seen = chosen.mapInPandas(run, f"key {kind}, {COLUMNS}")
    return seen.groupBy(F.col("key").alias(key)).agg(*[F.max(c).alias(c) for c in Recurrence._fields])


def link_profile(links: DataFrame, source: str = "src", target: str = "dst_url") -> DataFrame:
    """``source, links, hosts, top_share`` of each page: distinct targets, their hosts, the largest host's share.

    Repeated rows and null targets do not count; the hosts are counted before they are joined, so a
    target that a third of all rows share costs no more than any other.
    """
    edges = links.filter(F.col(source).isNotNull() & F.col(target).isNotNull()).select(source, target).distinct()
    host = F.regexp_extract(F.col(target), r"^[a-zA-Z]+://([^/?#]*)", 1)
    per_host = edges.groupBy(source, host.alias("host")).agg(F.count(F.lit(1)).alias("n"))
    out = per_host.groupBy(source).agg(F.sum("n").alias("links"), F.count(F.lit(1)).alias("hosts"), F.max("n").alias("top"))
    return out.select(source, "links", "hosts", (F.col("top") / F.col("links")).alias("top_share"))


def stuffed_pages(pages: DataFrame, links: DataFrame, key: str = "docid", content: str = "content", linked: float = 0.5, targets: float = 0.2, bare: float = 0.06) -> DataFrame:
    """The figures of :func:`page_recurrence` and :func:`link_profile`, and ``stuffed`` by either.

    By its links a page is stuffed if ``linked`` of its characters stand in links, it has at least
    ``targets`` different targets a term, and fewer function words than ``bare``: a heap of links that no
    sentence annotates. Pages without links, and links without a page, are as in the two functions.
    """
    profile = link_profile(links).withColumnRenamed("src", key)
    joined = page_recurrence(pages, key, content).join(profile, key, "left")
    heaped = (F.col("linked") >= linked) & (F.col("links") >= F.col("terms") * targets) & (F.col("function") < bare)
    return joined.withColumn("stuffed", F.col("stuffed") | F.coalesce(heaped, F.lit(False)))
