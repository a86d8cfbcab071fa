"""Text functions as Spark expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions import rules, stem
from pagewright.params import IMPORTANT_TAGS
from pagewright.plans.materialize import materialize


def _sub(text: Column, rule: tuple[str, str]) -> Column:
    return F.regexp_replace(text, F.lit(rule[0]), F.lit(rules.java(rule[1])))


def strip(text: Column) -> Column:
    """Without leading and trailing white space by Unicode."""
    return F.btrim(text, F.lit(rules.SPACES))


def collapse(text: Column) -> Column:
    """Words parted by single spaces."""
    return F.trim(_sub(text, rules.COLLAPSE))


def without_hidden(page: Column) -> Column:
    """HTML without comments, scripts and styles."""
    return reduce(_sub, rules.HIDDEN, page)


def decoded(text: Column) -> Column:
    """Character entities of the fixed list decoded; texts without an ampersand pass untouched."""
    plain = reduce(lambda t, e: F.replace(t, F.lit(e[0]), F.lit(e[1])), rules.ENTITIES, text)
    return F.when(F.instr(text, "&") > 0, plain).otherwise(text)


def html_text(page: Column, separator: str = "") -> Column:
    """All visible text of a page, adjacent elements' text joined by a separator, by default none."""
    return decoded(_sub(without_hidden(page), (rules.TAGS[0], separator)))


def marked(text: Column) -> Column:
    """Text with a mark wherever the tokenizer parts it besides its white space."""
    return reduce(_sub, rules.TREEBANK, text)


def tokens(text: Column) -> Column:
    """Lower-case Treebank tokens of a text, raw quotes kept.

    Wide spaces become plain ones first, so that the patterns that look at every character need ASCII
    classes only.
    """
    plain = F.translate(text, rules.WIDE_SPACES, " " * len(rules.WIDE_SPACES))
    found = F.regexp_extract_all(marked(plain), F.lit(rules.ASCII_TOKEN), F.lit(0))
    return F.array_remove(F.split(F.lower(F.array_join(found, rules.PART)), rules.PART), "")


def with_ngrams(df: DataFrame, text: str, n: int, out: str = "ngrams") -> DataFrame:
    """Add all runs of n tokens as slices of the raw text, lower-case; texts of fewer tokens have none.

    Tokens and the gaps between them are columns of their own first, so each text is parted once.
    """
    if n < 1:
        raise ValueError("n must be positive")
    parted = df.withColumn("_marked", F.regexp_replace(marked(F.col(text)), F.lit(rf"\A{rules.GAP}"), F.lit("")))
    parted = parted.withColumn("_words", F.regexp_extract_all("_marked", F.lit(rules.TOKEN), F.lit(0)))
    gaps = F.transform(F.regexp_extract_all("_marked", F.lit(rules.GAP), F.lit(0)), lambda g: F.replace(g, F.lit(rules.PART), F.lit("")))
    parted = parted.withColumn("_gaps", gaps)

    def slice_at(k: Column) -> Column:
        parts = [F.get("_words", k)]
        for i in range(1, n):
            parts += [F.get("_gaps", k + (i - 1)), F.get("_words", k + i)]
        return F.lower(F.concat(*parts))

    last = F.size("_words") - n
    runs = F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), slice_at)).otherwise(F.array().cast("array<string>"))
    return parted.withColumn(out, runs).drop("_marked", "_words", "_gaps")


def with_flat_ngrams(df: DataFrame, text: str, n: int, out: str) -> DataFrame:
    """Add one list of a text's tokens and, after them, its runs of 2 to ``n`` tokens."""
    parts = [f"_{k}" for k in range(1, n + 1)]
    for k, part in enumerate(parts, 1):
        df = with_ngrams(df, text, k, part)
    return df.withColumn(out, F.concat(*parts)).drop(*parts)


def important_text(page: Column, tag: str) -> Column:
    """Text of all elements of a tag, joined with spaces."""
    found = F.regexp_extract_all(page, F.lit(rf"(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}\s*>"), F.lit(1))
    return decoded(_sub(F.array_join(found, " "), rules.TAGS))


def without_element(page: Column, tag: str) -> Column:
    return F.regexp_replace(page, F.lit(rf"(?is)<{tag}(?:\s[^>]*)?>.*?</{tag}\s*>"), F.lit(""))


def hrefs(page: Column, keep_important: bool = False) -> Column:
    """The targets of all links; unless kept, those inside important elements are lost."""
    source = without_hidden(page)
    if not keep_important:
        source = reduce(without_element, IMPORTANT_TAGS, source)
    return F.regexp_extract_all(source, F.lit(rules.HREF), F.lit(1))


def defrag(url: Column) -> Column:
    """A URL up to its first ``#``."""
    return F.substring_index(url, "#", 1)


def _without_dots(path: Column) -> Column:
    """A path from the root with its ``.`` and ``..`` segments taken out, however many there are."""
    whole = F.when(path.rlike(rules.DOT_END), F.concat(path, F.lit("/"))).otherwise(path)
    up = lambda acc: F.regexp_replace(acc, r"/[^/]*\z", "")
    step = lambda acc, x: F.when(x == "..", up(acc)).when(x == ".", acc).otherwise(F.concat(acc, F.lit("/"), x))
    folded = F.aggregate(F.slice(F.split(whole, "/"), 2, 1 << 30), F.lit(""), step)
    return F.when(folded == "", F.lit("/")).otherwise(folded)


def resolved(base: Column, href: Column) -> Column:
    """A link's target against its page's URL by RFC 3986: absolute, ``//host``, ``/path``, ``?query``, ``#fragment`` and relative.

    As common libraries do, a relative path leaves no empty segments between those of the page and its own.
    """
    origin = F.regexp_extract(base, rules.ORIGIN, 1)
    page = F.regexp_replace(base, r"[?#].*\z", "")
    folder = F.when(page == origin, F.lit("/")).otherwise(F.regexp_replace(F.substring(page, F.length(origin) + 1, F.length(page)), r"[^/]*\z", ""))
    path = F.regexp_replace(href, r"[?#].*\z", "")
    rest = F.substring(href, F.length(path) + 1, F.length(href))
    joined = F.when(path.startswith("/"), path).otherwise(F.regexp_replace(F.concat(folder, path), "/{2,}", "/"))
    return (
        F.when(href.rlike(rules.SCHEME), href)
        .when(href.startswith("//"), F.concat(F.regexp_extract(base, rules.SCHEME, 0), href))
        .when(href.startswith("?"), F.concat(page, href))
        .when(href.startswith("#"), F.concat(defrag(base), href))
        .otherwise(F.concat(origin, F.when(joined.rlike(rules.DOTS), _without_dots(joined)).otherwise(joined), rest))
    )


def stemmed(words: DataFrame, word: str, out: str) -> DataFrame:
    """Add the Porter stem of a column, meant for tables of distinct words.

    The result is written: filters that later joins infer would otherwise be pushed through the chain of
    steps, each of which reads the one before it several times, and blow the expression up.
    """
    quote = lambda p: 'r"' + p + '"'
    test = lambda value, pattern: f"{value} RLIKE {quote(pattern)}"
    sub = lambda value, pattern, new: f"regexp_replace({value}, {quote(pattern)}, '{rules.java(new)}')"
    df = words.withColumn("w0", F.col(word)).withColumn("w", F.col(word))
    for expression in stem.steps(test, sub):
        df = df.withColumn("w", F.expr(expression))
    return materialize(df.withColumn(out, F.col("w")).drop("w0", "w"), "stems")


def is_stopword(word: Column) -> Column:
    return word.isin(*rules.STOPWORDS)


def is_alphanumeric(word: Column) -> Column:
    return word.rlike(rules.ALPHANUMERIC)


def bucket(word: Column) -> Column:
    """The index bucket of a token: its first code point, 128 for all from there on."""
    return F.least(F.ascii(word), F.lit(128))
