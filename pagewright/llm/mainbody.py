"""The main body of pages, by ratios of root-to-leaf tag paths.

Each block of text is placed on its tag path. For every path, within its page and over its site, text
length and punctuation that no boilerplate evidence speaks against are added up per node; the two
ratios are smoothed over the page's neighbouring paths and fused, and paths below a threshold are
dropped. Evidence is what a path cannot tell where one element holds everything: text standing on many
pages of a site or of the crawl, trails, lists of links or tags, and links that open a teaser.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagewright.llm.markup import Block, blocks
from pagewright.operators.skew import join_weighted
from pagewright.plans.materialize import materialize

_WORD = re.compile(r"[^\W\d_]+")
_DIGITS = re.compile(r"\d+")
_SPACE = re.compile(r"\s+")
_TRAIL = re.compile(r"\s[>»›·|/→]\s")
_LABEL = re.compile(r"^[^\W\d_][\w-]*(?: [\w-]+)? ?: ")
_STOP = re.compile(r"[.!?;:,…]")

#: Pages that are Python objects at a time; the rest of a batch stays in Arrow.
PAGES = 256
#: Sites whose figures may be broadcast.
FEW_SITES = 500_000
#: Words from which a text that is equal but for its numbers is taken for the same text.
SAME_WORDS = 8

FEATURES = (
    "docid long, block_no int, site long, title long, plain long, masked long, path long, place int, chars int, stops int, certain boolean, named boolean, loose boolean"
)


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text) - (1 << 63)


def _host(url: object) -> str:
    return re.sub(r"^[a-z]+://", "", url.lower()).split("/")[0] if isinstance(url, str) else ""


def mask(text: str, host: str) -> str:
    """A block's text without numbers and without the words of its host's name."""
    short = _DIGITS.sub("#", text)
    return _WORD.sub(lambda m: "@" if len(m.group()) >= 5 and m.group().lower() in host else m.group(), short)


def is_loose(text: str) -> bool:
    """Whether a text is so short and holds numbers, so that others are equal to it but for theirs by chance."""
    return bool(_DIGITS.search(text)) and len(_WORD.findall(text)) < SAME_WORDS


def is_certain(text: str, links: int, linked: int) -> bool:
    """Whether a block by itself is navigation, a trail, a list of tags or a teaser.

    ``linked`` is the number of characters inside links, -1 where unknown.
    """
    ended = text[-1:] in ".?!"
    if links >= 3 and (linked > 0.5 * len(text) or (linked < 0 and not ended)):
        return True
    if links >= 1 and not ended and _TRAIL.search(text):
        return True
    items = _LABEL.sub("", text).split(", ")
    if len(items) >= 4 and not ended and all(x.count(" ") < 2 for x in items):
        return True
    return links >= 1 and 0 < linked < len(text) and text[linked : linked + 2] == ". "


def _place(rows: list[dict], page: list[Block]) -> list[Block | None]:
    """The parsed block of each row, equal texts in their order; None where the page has no such text."""
    by_text: dict[str, list[Block]] = defaultdict(list)
    for b in reversed(page):
        if b.tag != "title":
            by_text[b.text].append(b)
    return [by_text[t].pop() if by_text.get(t := _SPACE.sub(" ", r["content"] or "").strip()) else None for r in rows]


def _name(page: list[Block], rows: list[dict]) -> str:
    """What copies of a page have in common: its title, else its first heading, else its longest block."""
    for tag in ("title", "h1"):
        for b in page:
            if b.tag == tag:
                return b.text
    return max((r["content"] or "" for r in rows), key=lambda t: (len(t), t), default="")


def _features(docid: int, rows: list[dict], url: object, content: object) -> list[tuple]:
    page = blocks(content) if isinstance(content, str) else []
    host = _host(url)
    title = _name(page, rows) or str(docid)
    rows = sorted(rows, key=lambda r: (r["block_no"], r["content"] or ""))
    order: dict[str, int] = {}
    out = []
    for row, at in zip(rows, _place(rows, page), strict=True):
        text = _SPACE.sub(" ", row["content"] or "").strip()
        path = at.path if at else f"?{row['tag']}"
        links = at.links if at else (row["n_links"] or 0)
        place = order.setdefault(path, len(order))
        stops = len(_STOP.findall(text))
        certain = not text or is_certain(text, links, at.linked if at else -1)
        loose = is_loose(text)
        out.append((docid, row["block_no"], _hash(host), _hash(title), _hash(_DIGITS.sub("#", text)), _hash(mask(text, host)), _hash(path), place, len(text), stops, certain, text == title, loose))
    return out


def block_features(page_blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """Keys, path and figures of each block, the table of :data:`FEATURES`; repeated rows count once."""
    fields = F.struct("block_no", "tag", "n_links", "content")
    grouped = page_blocks.filter("docid IS NOT NULL AND block_no IS NOT NULL").groupBy("docid").agg(F.collect_set(fields).alias("rows"))
    joined = grouped.join(pages.select("docid", "url", F.col("content").alias("page")), "docid", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}
        fields = [x.split() for x in FEATURES.split(", ")]
        for batch in batches:
            for k in range(0, batch.num_rows, PAGES):
                part = batch.slice(k, PAGES).to_pylist()
                out = [x for r in part for x in _features(r["docid"], r["rows"], r["url"], r["page"])]
                columns = zip(*out, strict=True) if out else [[] for _ in fields]
                arrays = [pa.array(list(c), kinds[kind]) for c, (_, kind) in zip(columns, fields, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, [name for name, _ in fields])

    return joined.mapInArrow(run, FEATURES).dropDuplicates(["docid", "block_no"])


def repeated_keys(features: DataFrame, site_share: float = 0.02, crawl_share: float = 0.001, least: int = 3, dense: float = 0.1) -> DataFrame:
    """Text keys that stand under many titles: ``key, rows, everywhere, sites``.

    A key is repeated if, on one site, at least ``least`` titles and ``site_share`` of the site's pages
    have it, or over the whole crawl ``least`` and ``crawl_share``. Copies of a page share its title and
    so do not make its text repeated. A loose key (a room and its hour, equal but for the numbers) comes
    up on pages that have nothing in common; it is repeated only if, of the other pages of a site that has
    it, ``site_share`` have it too, as text of a frame does, taken over all sites and on more than a
    single pair of pages; or else only on those ``sites`` where ``least`` titles and ``dense`` of the other pages have it.
    """
    pages = features.select("site", "docid").distinct()
    per_site = pages.groupBy("site").agg(F.count(F.lit(1)).alias("pages"))
    total = pages.count()
    keyed = features.select("site", "title", "loose", F.explode(F.array_distinct(F.array("plain", "masked"))).alias("key"))
    counted = keyed.groupBy("site", "title", "key").agg(F.count(F.lit(1)).alias("rows"), F.max("loose").alias("loose"))
    here = counted.groupBy("site", "key").agg(F.count(F.lit(1)).alias("titles"), F.sum("rows").alias("rows"), F.max("loose").alias("loose"))
    local = (F.col("titles") >= least) & (F.col("titles") >= F.col("pages") * site_share)
    more, others = F.col("titles") - 1, F.col("pages") - 1
    packed = F.col("loose") & (F.col("titles") >= least) & (more >= others * dense)
    many_sites = per_site.count() > FEW_SITES
    marked = here.join(per_site if many_sites else F.broadcast(per_site), "site").withColumns({"local": local, "packed": packed, "met": F.col("titles") * more, "meetable": F.col("titles") * others})
    titles = counted.select("key", "title").distinct().groupBy("key").agg(F.count(F.lit(1)).alias("titles"))
    sums = {c: F.sum(c).alias(c) for c in ("rows", "met", "meetable")}
    sites = F.collect_list(F.when(F.col("packed"), F.col("site"))).alias("sites")
    keys = marked.groupBy("key").agg(F.max("local").alias("local"), F.max("loose").alias("loose"), *sums.values(), sites).join(titles, "key")
    many = (F.col("titles") >= least) & (F.col("titles") >= total * crawl_share)
    together = (F.col("met") > 2) & (F.col("met") >= F.col("meetable") * site_share)
    judged = keys.withColumn("everywhere", (F.col("local") | many) & (~F.col("loose") | together))
    kept = judged.filter(F.col("everywhere") | (F.size("sites") > 0))
    return kept.select("key", "rows", "everywhere", F.when(~F.col("everywhere"), F.col("sites")).alias("sites"))


def main_body(page_blocks: DataFrame, pages: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The blocks of each page's main body: ``docid, block_no``.

    ``page_blocks`` has ``docid, block_no, tag, n_links, content``, ``pages`` has ``docid, url, content``
    (HTML), from which the paths are read; a block that its page does not show gets its ``tag`` for a
    path. Rows with a null ``docid`` or ``block_no`` are left out, empty blocks are never main body,
    repeated rows count once. Other columns are not looked at; empty tables give no rows.
    """
    features = materialize(block_features(page_blocks, pages), "block-features")
    keys = materialize(repeated_keys(features), "repeated-keys")
    total = keys.agg(F.sum("rows")).first()[0] or 0
    keyed = features.select("docid", "block_no", "site", F.explode(F.array_distinct(F.array("plain", "masked"))).alias("key"))
    met = join_weighted(keyed, keys, "key", "rows", total).filter(F.col("everywhere") | F.array_contains("sites", F.col("site")))
    repeated = met.select("docid", "block_no").distinct().withColumn("again", F.lit(True))
    judged = features.join(repeated, ["docid", "block_no"], "left").withColumn("against", F.col("certain") | (F.coalesce("again", F.lit(False)) & ~F.col("named")))
    free = lambda c: F.sum(F.when(~F.col("against"), F.col(c)).otherwise(0))
    paths = judged.groupBy("docid", "site", "path").agg(
        F.min("place").alias("place"), F.count(F.lit(1)).alias("nodes"), F.sum("chars").alias("chars"), free("chars").alias("free"), free("stops").alias("stops")
    )
    paths = materialize(paths, "paths")
    over_site = paths.groupBy("site", "path").agg(F.sum("chars").alias("s_chars"), F.sum("free").alias("s_free"), F.count(F.lit(1)).alias("pages"))
    paths = join_weighted(paths, materialize(over_site, "site-paths"), ["site", "path"], "pages", paths.count())
    whole = Window.partitionBy("docid")
    near = whole.orderBy("place").rowsBetween(-1, 1)
    purity = (F.col("free") / F.greatest("chars", F.lit(1)) + F.col("s_free") / F.greatest("s_chars", F.lit(1))) / 2
    paths = paths.withColumns({"length": F.col("free") / F.col("nodes"), "marks": F.col("stops") / F.col("nodes"), "pure": purity})
    paths = paths.withColumns({c: 0.75 * F.col(c) + 0.25 * F.avg(c).over(near) for c in ("length", "marks")})
    most = {c: F.greatest(F.max(c).over(whole), F.lit(1e-9)) for c in ("length", "marks")}
    fused = F.col("pure") * (0.5 + 0.5 * F.sqrt((F.col("length") / most["length"]) * (F.col("marks") / most["marks"])))
    kept = paths.withColumn("ratio", fused).filter(F.col("ratio") >= threshold).select("docid", "path")
    return judged.filter("NOT against").join(kept, ["docid", "path"], "left_semi").select("docid", "block_no")


def html_blocks(pages: DataFrame) -> DataFrame:
    """``docid, block_no, tag, n_links, content`` of every page's visible blocks, for pages that come without such a table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = ["docid", "block_no", "tag", "n_links", "content"], [pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.string()]
        for batch in batches:
            for k in range(0, batch.num_rows, PAGES):
                part = batch.slice(k, PAGES).to_pylist()
                out = [(r["docid"], n, b.tag, b.links, b.text) for r in part for n, b in enumerate(x for x in blocks(r["content"]) if x.tag != "title")]
                columns = zip(*out, strict=True) if out else [[] for _ in names]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), kind) for c, kind in zip(columns, kinds, strict=True)], names)

    chosen = pages.filter("docid IS NOT NULL").select("docid", "content")
    return chosen.mapInArrow(run, "docid long, block_no int, tag string, n_links int, content string")


def bodies(pages: DataFrame) -> DataFrame:
    """``docid, body``: the main body of every page ``docid, url, content``, out of its HTML alone.

    Its blocks are joined by line ends in page order; of pages that came several times the blocks of
    each number are taken once. Pages without a main body have no row.
    """
    cut = materialize(html_blocks(pages).dropDuplicates(["docid", "block_no"]), "html-blocks")
    kept = cut.join(main_body(cut, pages), ["docid", "block_no"], "left_semi")
    ordered = F.sort_array(F.collect_list(F.struct("block_no", "content")))
    return kept.groupBy("docid").agg(F.array_join(F.transform(ordered, lambda b: b["content"]), "\n").alias("body"))
