"""Text rules shared by the Spark expressions and the SQL they are checked against.

Patterns are written so that Java's and RE2's engines agree; ``{n}`` in a replacement is a group, which
each dialect writes its own way.
"""

from __future__ import annotations

#: White space by Unicode, as a class body.
SPACE = r"\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: Put where a rule parts a token, so that the text's own white space stays known.
PART = "\x01"

COLLAPSE = (rf"[{SPACE}]+", " ")

HIDDEN = (
    (r"(?s)<!--.*?-->", ""),
    (r"(?is)<script\b.*?</script[^>]*>", ""),
    (r"(?is)<style\b.*?</style[^>]*>", ""),
)
TAGS = (r"(?s)<[^>]*>", "")
# Character entities that are decoded, the ampersand last.
ENTITIES = (
    ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&nbsp;", " "), ("&copy;", "©"),
    ("&auml;", "ä"), ("&ouml;", "ö"), ("&uuml;", "ü"), ("&Auml;", "Ä"), ("&Ouml;", "Ö"), ("&Uuml;", "Ü"), ("&szlig;", "ß"),
    ("&agrave;", "à"), ("&eacute;", "é"), ("&egrave;", "è"), ("&ecirc;", "ê"), ("&ccedil;", "ç"), ("&ntilde;", "ñ"),
    ("&aacute;", "á"), ("&iacute;", "í"), ("&oacute;", "ó"), ("&uacute;", "ú"), ("&laquo;", "«"), ("&raquo;", "»"), ("&amp;", "&"),
)

HREF = r"""(?is)<a\s[^>]*?href\s*=\s*["']?([^"'\s>]+)"""
SCHEME = r"\A[a-zA-Z][a-zA-Z0-9+.\-]*:"
#: A path with dot segments, and one that ends with them.
DOTS, DOT_END = r"/\.{1,2}(/|\z)", r"/\.{1,2}\z"
ORIGIN = r"\A([a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*)"

_P = PART
_END = rf"([{SPACE}\x01]|\z)"
_WORD_START = r"(\A|[^a-zA-Z0-9_])"
# The published sed rules of the Treebank tokenizer, as (pattern, replacement). Quotes stay
# raw, so opening ones need no rule of their own; every pattern starts with a character that is rare.
TREEBANK = (
    (r"``", f"{_P}``{_P}"),
    (r"([:,])([^0-9])", f"{_P}{{1}}{_P}{{2}}"),
    (r"([:,])\z", f"{_P}{{1}}{_P}"),
    (r"\.\.\.", f"{_P}...{_P}"),
    (r"([;@#$%&])", f"{_P}{{1}}{_P}"),
    (rf"([^.])(\.)([\]\)}}>\"'{SPACE}]*)\z", f"{{1}}{_P}{{2}}{{3}}"),
    (r"([?!])", f"{_P}{{1}}{_P}"),
    (r"([\]\[(){}<>])", f"{_P}{{1}}{_P}"),
    (r"--", f"{_P}--{_P}"),
    (r"''", f"{_P}''{_P}"),
    (r'"', f'{_P}"{_P}'),
    (rf"('['sSmMdD]?){_END}", f"{_P}{{1}}{{2}}"),
    (rf"('(?:ll|LL|re|RE|ve|VE)){_END}", f"{_P}{{1}}{{2}}"),
    (rf"(n't|N'T){_END}", f"{_P}{{1}}{{2}}"),
    (rf"(?i){_WORD_START}(can)(not)\b", f"{{1}}{_P}{{2}}{_P}{{3}}{_P}"),
    (rf"(?i){_WORD_START}(d)('ye)\b", f"{{1}}{_P}{{2}}{_P}{{3}}{_P}"),
    (rf"(?i){_WORD_START}(gim|lem)(me)\b", f"{{1}}{_P}{{2}}{_P}{{3}}{_P}"),
    (rf"(?i){_WORD_START}(gon)(na)\b", f"{{1}}{_P}{{2}}{_P}{{3}}{_P}"),
    (rf"(?i){_WORD_START}(got)(ta)\b", f"{{1}}{_P}{{2}}{_P}{{3}}{_P}"),
    (rf"(?i){_WORD_START}(more)('n)\b", f"{{1}}{_P}{{2}}{_P}{{3}}{_P}"),
    (rf"(?i){_WORD_START}(wan)(na)([{SPACE}\x01])", f"{{1}}{_P}{{2}}{_P}{{3}}{{4}}"),
    (rf"(?i){_WORD_START}('t)(is|was)\b", f"{{1}}{_P}{{2}}{_P}{{3}}{_P}"),
)
TOKEN = rf"[^{SPACE}\x01]+"
GAP = rf"[{SPACE}\x01]+"
#: The spaces beyond ASCII, and the class of a token in text where they have been replaced.
WIDE_SPACES = "\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
SPACES = " \t\n\x0b\f\r\x1c\x1d\x1e\x1f" + WIDE_SPACES
ASCII_TOKEN = r"[^ \t\n\x0b\f\r\x1c-\x1f\x01]+"
ALPHANUMERIC = r"\A[\p{L}\p{N}]+\z"


def java(replacement: str) -> str:
    """A replacement as Java writes it."""
    return _groups(replacement.replace("$", r"\$"), "$")


def re2(replacement: str) -> str:
    """A replacement as RE2 writes it."""
    return _groups(replacement, "\\")


def _groups(replacement: str, mark: str) -> str:
    for k in range(1, 5):
        replacement = replacement.replace(f"{{{k}}}", f"{mark}{k}")
    return replacement


# English stopwords, contractions included.
STOPWORDS = tuple(
    """
    a about above after again against all am an and any are aren't as at be because been before being below between
    both but by can't cannot could couldn't did didn't do does doesn't doing don't down during each few for from
    further had hadn't has hasn't have haven't having he he'd he'll he's her here here's hers herself him himself
    his how how's i i'd i'll i'm i've if in into is isn't it it's its itself let's me more most mustn't my myself no
    nor not of off on once only or other ought our ours ourselves out over own same shan't she she'd she'll she's
    should shouldn't so some such than that that's the their theirs them themselves then there there's these they
    they'd they'll they're they've this those through to too under until up very was wasn't we we'd we'll we're
    we've were weren't what what's when when's where where's which while who who's whom why why's with won't would
    wouldn't you you'd you'll you're you've your yours yourself yourselves
    """.split()
)
