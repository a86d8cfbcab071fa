"""The engine's queries as SQL for an independent engine, over the same rule tables."""

from __future__ import annotations

from functools import reduce

from pagewright.functions import hashing, rules, stem
from pagewright.params import COMPAT, IMPORTANT_TAGS


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _sub(value: str, rule: tuple[str, str]) -> str:
    return f"regexp_replace({value}, {_q(rule[0])}, {_q(rules.re2(rule[1]))}, 'g')"


def _strip(value: str) -> str:
    return f"trim({value}, {_q(rules.SPACES)})"


def _collapse(value: str) -> str:
    return f"trim({_sub(value, rules.COLLAPSE)}, ' ')"


def _decoded(value: str) -> str:
    plain = reduce(lambda v, e: f"replace({v}, {_q(e[0])}, {_q(e[1])})", rules.ENTITIES, value)
    return f"CASE WHEN contains({value}, '&') THEN {plain} ELSE {value} END"


def _html_text(value: str) -> str:
    return f"(SELECT {_decoded('v')} FROM (SELECT {_sub(reduce(_sub, rules.HIDDEN, value), rules.TAGS)} AS v))"


def _marked(value: str) -> str:
    return reduce(_sub, rules.TREEBANK, value)


def _lower(value: str) -> str:
    """Lower case by Unicode's full mapping, which gives the dotted capital I two code points."""
    return f"lower(replace({value}, chr(304), 'i' || chr(775)))"


def _tokens(value: str) -> str:
    return f"list_transform(regexp_extract_all({_marked(value)}, {_q(rules.TOKEN)}), lambda x: {_lower('x')})"


def _stems(source: str, word: str) -> str:
    """A subquery ``word, token`` over a subquery of distinct words."""
    test = lambda value, pattern: f"regexp_matches({value}, {_q(pattern)})"
    sub = lambda value, pattern, new: _sub(value, (pattern, new))
    inner = f"SELECT DISTINCT {word} AS w0, {word} AS w FROM {source}"
    for expression in stem.steps(test, sub):
        inner = f"SELECT w0, {expression} AS w FROM ({inner})"
    return f"SELECT w0 AS word, w AS token FROM ({inner})"


def _element(value: str, tag: str) -> str:
    return f"regexp_replace({value}, {_q(rf'(?is)<{tag}(?:\s[^>]*)?>.*?</{tag}\s*>')}, '', 'g')"


def _without_dots(path: str) -> str:
    whole = f"CASE WHEN regexp_matches({path}, {_q(rules.DOT_END)}) THEN {path} || '/' ELSE {path} END"
    step = "lambda acc, x: CASE WHEN x = '..' THEN regexp_replace(acc, '/[^/]*\\z', '') WHEN x = '.' THEN acc ELSE acc || '/' || x END"
    return f"coalesce(nullif(list_reduce(string_split({whole}, '/')[2:], {step}, ''), ''), '/')"


def _resolved(base: str, href: str) -> str:
    origin = f"regexp_extract({base}, {_q(rules.ORIGIN)}, 1)"
    page = f"regexp_replace({base}, '[?#].*\\z', '')"
    folder = f"CASE WHEN {page} = {origin} THEN '/' ELSE regexp_replace(substr({page}, length({origin}) + 1), '[^/]*\\z', '') END"
    path = f"regexp_replace({href}, '[?#].*\\z', '')"
    joined = f"(CASE WHEN starts_with({path}, '/') THEN {path} ELSE regexp_replace({folder} || {path}, '/{{2,}}', '/', 'g') END)"
    plain = f"CASE WHEN regexp_matches({joined}, {_q(rules.DOTS)}) THEN {_without_dots(joined)} ELSE {joined} END"
    return f"""CASE WHEN regexp_matches({href}, {_q(rules.SCHEME)}) THEN {href}
      WHEN starts_with({href}, '//') THEN regexp_extract({base}, {_q(rules.SCHEME)}) || {href}
      WHEN starts_with({href}, '?') THEN {page} || {href} WHEN starts_with({href}, '#') THEN split_part({base}, '#', 1) || {href}
      ELSE {origin} || {plain} || substr({href}, length({path}) + 1) END"""


_STOPWORDS = "(" + ", ".join(_q(w) for w in rules.STOPWORDS) + ")"
_ALNUM = f"regexp_matches(token, {_q(rules.ALPHANUMERIC)})"

PAGES = """d AS MATERIALIZED (SELECT docid, coalesce(url, '') AS url, coalesce(content, '') AS content FROM (
  SELECT *, row_number() OVER (PARTITION BY docid ORDER BY ingested_at ASC NULLS LAST, url NULLS FIRST, content NULLS FIRST) AS n
  FROM pages WHERE docid IS NOT NULL) WHERE n = 1)"""
CLEAN = PAGES + f", c AS MATERIALIZED (SELECT docid, url, {_strip('content')} AS content FROM d WHERE length({_strip('content')}) > 0)"
URL = CLEAN + ", u AS MATERIALIZED (SELECT * FROM c WHERE docid IN (SELECT min(docid) FROM c GROUP BY url))"
EXACT = URL + ", e AS MATERIALIZED (SELECT * FROM u WHERE docid IN (SELECT min(docid) FROM u GROUP BY md5(content), length(content)))"


def _counts(pages: str) -> str:
    words = f"SELECT docid, unnest({_tokens('t')}) AS word FROM (SELECT docid, {_html_text('content')} AS t FROM {pages})"
    return f"k AS MATERIALIZED (SELECT docid, word, CAST(count(*) AS INT) AS tf FROM ({words}) GROUP BY ALL)"


_VOCAB = f"v AS MATERIALIZED ({_stems('k', 'word')})"
_BAGS = "b AS MATERIALIZED (SELECT docid, token, CAST(sum(tf) AS INT) AS tf FROM k JOIN v USING (word) GROUP BY ALL)"
_HEX = "'0123456789ABCDEF'"
_BYTES = f"[CAST((instr({_HEX}, substr(h, 2 * i + 1, 1)) - 1) * 16 + instr({_HEX}, substr(h, 2 * i + 2, 1)) - 1 AS UBIGINT) for i in range(CAST(length(h) / 2 AS BIGINT))]"


def _crc_table(bits: int, table: list[int], source: str, column: str) -> str:
    """``column, crc`` of a source, its table of remainders built once."""
    ones = (1 << bits) - 1
    lut = "[" + ", ".join(f"{x}::UBIGINT" for x in table) + "]"
    step = f"list_reduce(o, lambda acc, x: xor(acc >> 8, t[CAST(xor(acc, x) & 255 AS INT) + 1]), {ones}::UBIGINT)"
    octets = f"SELECT {column}, {_BYTES} AS o FROM (SELECT {column}, hex(encode({column})) AS h FROM {source})"
    return f"SELECT {column}, CASE WHEN len(o) > 0 THEN xor({step}, {ones}::UBIGINT) ELSE 0::UBIGINT END AS crc FROM ({octets}), (SELECT {lut} AS t)"


_LOW = f"l AS MATERIALIZED (SELECT word, CAST(crc & 4294967295 AS BIGINT) AS low FROM ({_crc_table(64, hashing.crc64_table(), '(SELECT DISTINCT word FROM k)', 'word')}))"
_SUMS = ", ".join(f"sum(CASE WHEN (low >> {i}) & 1 = 1 THEN tf ELSE -tf END) AS s{i}" for i in range(32))
_BITS = " + ".join(f"(CASE WHEN s{i} > 0 THEN {1 << i} ELSE 0 END)::BIGINT" for i in range(32))
_PRINTS = f"f AS MATERIALIZED (SELECT docid, coalesce(fp, 0) AS fp FROM (SELECT docid FROM e) LEFT JOIN (SELECT docid, {_BITS} AS fp FROM (SELECT docid, {_SUMS} FROM k JOIN l USING (word) GROUP BY docid)) USING (docid))"
PRINTS = f"{EXACT}, {_counts('e')}, {_LOW}, {_PRINTS}"
_KEPT = """o AS MATERIALIZED (SELECT row_number() OVER (ORDER BY docid) AS n, docid, fp FROM f),
r AS (SELECT 0::BIGINT AS n, NULL::BIGINT AS docid, false AS kept, []::BIGINT[] AS w
  UNION ALL SELECT n, docid, NOT near, CASE WHEN near THEN w WHEN len(w) < 200 THEN list_append(w, fp) ELSE list_append(w[2:], fp) END
  FROM (SELECT o.n, o.docid, o.fp, r.w, len(list_filter(r.w, lambda x: bit_count(xor(x, o.fp)) <= 3)) > 0 AS near FROM r JOIN o ON o.n = r.n + 1)),
kept AS MATERIALIZED (SELECT docid FROM r WHERE kept)"""
BUILT = f"WITH RECURSIVE {PRINTS}, {_KEPT}, {_VOCAB}, b AS MATERIALIZED (SELECT docid, token, CAST(sum(tf) AS INT) AS tf FROM k JOIN v USING (word) WHERE docid IN (SELECT docid FROM kept) GROUP BY ALL)"


def _links(pages: str) -> str:
    source = reduce(_element, IMPORTANT_TAGS, reduce(_sub, rules.HIDDEN, "content"))
    found = f"SELECT DISTINCT docid, url, unnest(regexp_extract_all({source}, {_q(rules.HREF)}, 1)) AS href FROM {pages}"
    return f"SELECT docid, href, {_resolved('url', 'plain')} AS resolved FROM (SELECT docid, url, href, {_decoded('href')} AS plain FROM ({found}))"


def _important() -> str:
    parts = []
    for rank, tag in enumerate(IMPORTANT_TAGS, 1):
        pattern = _q(rf"(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}\s*>")
        text = f"(SELECT {_decoded('x')} FROM (SELECT {_sub(f'array_to_string(regexp_extract_all(page, {pattern}, 1), {_q(" ")})', rules.TAGS)} AS x))"
        parts.append(f"SELECT docid, {rank} AS rank, unnest({_tokens('t')}) AS word FROM (SELECT docid, {text} AS t FROM g)")
    pages = f"g AS MATERIALIZED (SELECT docid, {reduce(_sub, rules.HIDDEN, 'content')} AS page FROM c)"
    rows = f"k AS MATERIALIZED (SELECT docid, word, min(rank) AS rank FROM ({' UNION ALL '.join(parts)}) GROUP BY ALL)"
    return f"WITH {CLEAN}, {pages}, {rows}, {_VOCAB} SELECT docid, token, CAST(min(rank) AS INT) AS important FROM k JOIN v USING (word) GROUP BY docid, token"


_GAPS = f"regexp_replace({_marked('text')}, {_q(chr(92) + 'A' + rules.GAP)}, '', 'g')"


def _runs(n: int) -> str:
    """All runs of ``n`` tokens of ``w``, with the gaps ``g`` between them."""
    gaps = [f"replace(g[i + {k}], {_q(rules.PART)}, '') || w[i + {k + 1}]" for k in range(n - 1)]
    return f"CASE WHEN len(w) >= {n} THEN [{_lower(' || '.join(['w[i]', *gaps]))} for i in range(1, len(w) - {n - 2})] ELSE [] END"


_PARTED = f"(SELECT doc_id, regexp_extract_all(m, {_q(rules.TOKEN)}) AS w, regexp_extract_all(m, {_q(rules.GAP)}) AS g FROM (SELECT doc_id, {_GAPS} AS m FROM documents WHERE text IS NOT NULL))"
_BIGRAMS = f"SELECT doc_id, {_runs(2)} AS n FROM {_PARTED}"
_FLAT = f"SELECT doc_id, {_runs(1)} || {_runs(2)} || {_runs(3)} AS n FROM {_PARTED}"

_QUALITIES = ("pr_quality", "hub_quality", "auth_quality")
DOCS = "docs AS MATERIALIZED (SELECT docid, max(total_tokens) AS total_tokens, " + ", ".join(f"coalesce(max(CASE WHEN {c} >= 0 THEN {c} END), 1.0::FLOAT) AS {c}" for c in _QUALITIES) + ", max(url) AS url FROM docinfo WHERE docid IS NOT NULL GROUP BY docid)"
NODES = "nodes AS MATERIALIZED (SELECT unnest(range(1, (SELECT max(docid) FROM docs) + 1)) AS docid)"
EDGES = "edges AS MATERIALIZED (SELECT DISTINCT src, dst FROM (SELECT DISTINCT src, dst_url AS url FROM doclinks WHERE src IS NOT NULL AND dst_url IS NOT NULL) JOIN (SELECT url, max(docid) AS dst FROM docs GROUP BY url) USING (url) WHERE src IN (SELECT docid FROM docs))"
DEGREE = "deg AS MATERIALIZED (SELECT src, count(*) AS degree FROM edges GROUP BY src)"


def _settled(prefix: str, columns: tuple[str, ...]) -> str:
    """The vector that a run ends with: the one before the first step that moves all values by less than the tolerance."""
    gaps = ", ".join(f"abs(n.{c} - o.{c})" for c in columns)
    moved = " UNION ALL ".join(
        f"SELECT {i} AS step, max(greatest({gaps}, 0)) AS moved FROM {prefix}{i} o JOIN {prefix}{i + 1} n USING (docid)" for i in range(COMPAT.iterations)
    )
    every = " UNION ALL ".join(f"SELECT {i} AS step, * FROM {prefix}{i}" for i in range(COMPAT.iterations + 1))
    end = f"(SELECT coalesce(min(step), {COMPAT.iterations}) FROM ({moved}) WHERE moved < {COMPAT.tolerance!r}::DOUBLE)"
    return f"{prefix}_end AS MATERIALIZED (SELECT * FROM ({every}) WHERE step = {end})"


def _pagerank() -> str:
    steps = ["p0 AS MATERIALIZED (SELECT docid, 1.0::DOUBLE / (SELECT count(*) FROM nodes) AS pr FROM nodes)"]
    for i in range(COMPAT.iterations):
        steps.append(
            f"p{i + 1} AS MATERIALIZED (SELECT docid, (1 - 0.85::DOUBLE) + 0.85::DOUBLE * coalesce(s, 0) AS pr FROM nodes LEFT JOIN (SELECT dst AS docid, sum(pr / degree) AS s "
            f"FROM edges JOIN deg USING (src) JOIN p{i} ON p{i}.docid = src GROUP BY dst) USING (docid))"
        )
    return f"{DOCS}, {NODES}, {EDGES}, {DEGREE}, {', '.join(steps)}, {_settled('p', ('pr',))}"


def _hits() -> str:
    steps = ["h0 AS MATERIALIZED (SELECT docid, 1.0::DOUBLE AS hub, 1.0::DOUBLE AS auth FROM nodes)"]
    for i in range(COMPAT.iterations):
        raw = f"SELECT nodes.docid, coalesce(h, 0) AS hub, coalesce(a, 0) AS auth FROM nodes LEFT JOIN (SELECT src, sum(auth) AS h, sum(hub) AS a FROM edges JOIN h{i} ON docid = dst GROUP BY src) ON src = nodes.docid"
        norm = lambda c: f"CASE WHEN sum({c} * {c}) OVER () > 0 THEN sqrt(sum({c} * {c}) OVER ()) ELSE 1 END"
        steps.append(f"h{i + 1} AS MATERIALIZED (SELECT docid, hub / {norm('hub')} AS hub, auth / {norm('auth')} AS auth FROM ({raw}))")
    return ", ".join([*steps, _settled("h", ("hub", "auth"))])


POSTINGS = "p AS MATERIALIZED (SELECT DISTINCT bid, token, docid, tf, important FROM postings WHERE tf > 0 AND token IS NOT NULL AND docid IS NOT NULL)"
_BUCKET = "least(unicode(token), 128)"
FREQ = f"df AS MATERIALIZED (SELECT token, count(*) AS df FROM p GROUP BY token), reach AS MATERIALIZED (SELECT token, df FROM (SELECT token, df, {_BUCKET} AS bid, min(token) OVER (PARTITION BY {_BUCKET}) AS first FROM df) WHERE bid < 128 AND token <> first)"
QTOKENS = f"qw AS MATERIALIZED (SELECT query_id, unnest({_tokens('query')}) AS word FROM queries WHERE query_id IS NOT NULL), qv AS MATERIALIZED ({_stems('qw', 'word')}), qt AS MATERIALIZED (SELECT query_id, token, count(*) AS qtf FROM qw JOIN qv USING (word) GROUP BY ALL)"
PRUNED = f"""{POSTINGS}, {FREQ}, {QTOKENS},
qk AS (SELECT query_id, token, qtf, df, (df IS NOT NULL AND token IN {_STOPWORDS}) AS stop, (df IS NULL AND {_ALNUM}) AS lost FROM qt LEFT JOIN reach USING (token)),
qn AS (SELECT *, coalesce(sum(CASE WHEN lost THEN qtf END) OVER q, 0) AS n_lost, coalesce(sum(CASE WHEN df IS NOT NULL THEN qtf END) OVER q, 0) AS n_valid,
  count(df) OVER q AS n_kinds, sum(CAST(stop AS INT)) OVER q AS n_stop, row_number() OVER (PARTITION BY query_id, stop ORDER BY df, qtf, token) AS place FROM qk WINDOW q AS (PARTITION BY query_id)),
pr AS MATERIALIZED (SELECT query_id, token, qtf, df FROM qn WHERE df IS NOT NULL AND n_lost <= 2 * n_valid
  AND (NOT stop OR (n_stop >= 0.4 * n_kinds AND place <= length(bin(n_stop)) - 1)))"""
MATCHED = PRUNED + ", need AS (SELECT query_id, count(*) AS needed FROM pr GROUP BY query_id), hit AS MATERIALIZED (SELECT * FROM (SELECT pr.query_id, p.token, docid, tf, important, qtf, df, needed, count(*) OVER (PARTITION BY pr.query_id, docid) AS have FROM pr JOIN p USING (token) JOIN need ON need.query_id = pr.query_id) WHERE have = needed)"
_IMPORTANCE = "[" + ", ".join(f"{x}::DOUBLE" for x in COMPAT.importance) + "]"


def _share(column: str) -> str:
    norm = f"sqrt(sum({column} * {column}) OVER (PARTITION BY query_id))"
    return f"CASE WHEN {norm} > 0 THEN {column} / {norm} ELSE 0 END"


SCORED = f"""{MATCHED}, {DOCS},
m AS (SELECT query_id, count(DISTINCT docid) AS m FROM hit JOIN docs USING (docid) WHERE total_tokens > 0 GROUP BY query_id),
x AS (SELECT hit.query_id, docid, url, {', '.join(f'{c}::DOUBLE AS {c}' for c in _QUALITIES)}, tf::DOUBLE / total_tokens * idf * {_IMPORTANCE}[important + 1] AS w,
  qtf::DOUBLE / sum(qtf) OVER (PARTITION BY hit.query_id, docid) * idf AS wq FROM hit JOIN docs USING (docid)
  JOIN (SELECT query_id, ln((1.0::DOUBLE + (SELECT count(*) FROM docs)) / (1.0::DOUBLE + m)) AS idf FROM m) i ON i.query_id = hit.query_id WHERE total_tokens > 0),
y AS (SELECT query_id, docid, max(url) AS url, {', '.join(f'max({c}) AS {c}' for c in _QUALITIES)}, sum(w) AS tfidf,
  CASE WHEN sum(w * w) > 0 AND sum(wq * wq) > 0 THEN sum(w * wq) / (sqrt(sum(w * w)) * sqrt(sum(wq * wq))) ELSE 0 END AS cosine FROM x GROUP BY query_id, docid),
z AS MATERIALIZED (SELECT *, CASE WHEN cosine > 0.4 THEN rel ELSE 0 END AS relevance FROM (SELECT *, 0.73 * {_share('tfidf')} + (1 - 0.73) * {_share('cosine')} AS rel,
  0.59 * {_share('pr_quality')} + 0.23 * {_share('hub_quality')} + 0.18 * {_share('auth_quality')} AS quality FROM y)),
s AS MATERIALIZED (SELECT query_id, docid, url, tfidf, cosine, relevance, quality, 0.61 * relevance + (1 - 0.61) * quality AS score FROM z)"""
RANKED = "SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, docid) AS INT) AS rank, docid, url, score FROM s"
_URL = "CASE WHEN length(url) > 0 THEN url ELSE 'URL not found' END"


def _escaped(value: str) -> str:
    return reduce(lambda v, e: f"replace({v}, {_q(e[0])}, {_q(e[1])})", (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")), value)


_SUMMARY = f"SELECT docid, substr({_collapse('t')}, 1, 512) AS text FROM (SELECT docid, {_html_text('content')} AS t FROM c)"
ALT = f"""{POSTINGS}, {FREQ}, {DOCS}, qr AS (SELECT query_id, query, unnest(string_split({_collapse('query')}, ' ')) AS raw FROM queries WHERE query_id IS NOT NULL),
qw AS MATERIALIZED (SELECT query_id, query, {_lower('raw')} AS word FROM qr WHERE length(raw) > 0 AND raw NOT IN {_STOPWORDS}), qv AS MATERIALIZED ({_stems('qw', 'word')}),
qt AS (SELECT DISTINCT query_id, query, token FROM qw JOIN qv USING (word)),
wt AS MATERIALIZED (SELECT query_id, token, wq, sqrt(sum(wq * wq) OVER (PARTITION BY query_id)) AS length, count(*) OVER (PARTITION BY query_id) AS needed FROM (
  SELECT query_id, token, CASE WHEN qn > 0 THEN 1 + ln(qn) ELSE 0 END * log2((1.0::DOUBLE + (SELECT count(*) FROM docs)) / (1.0::DOUBLE + df)) AS wq
  FROM (SELECT query_id, token, (length(query) - length(replace(query, token, ''))) // length(token) AS qn FROM qt) JOIN reach USING (token))),
hit AS (SELECT * FROM (SELECT wt.*, docid, (1 + ln(tf)) * CASE WHEN important > 0 THEN 1.2 ELSE 1.0 END AS wd, count(*) OVER (PARTITION BY query_id, docid) AS have FROM wt JOIN p USING (token)) WHERE have = needed),
y AS (SELECT query_id, docid, max(url) AS url, {', '.join(f'max({c})::DOUBLE AS {c}' for c in _QUALITIES)},
  CASE WHEN sum(wd * wd) > 0 AND max(length) > 0 THEN sum(wd * wq) / (sqrt(sum(wd * wd)) * max(length)) ELSE 0 END AS cosine FROM hit JOIN docs USING (docid) GROUP BY query_id, docid),
s AS (SELECT query_id, docid, url, cosine, cosine + {' + '.join(f'CASE WHEN max({c}) OVER q > 0 THEN {c} / max({c}) OVER q ELSE 0 END' for c in _QUALITIES)} AS score FROM y WINDOW q AS (PARTITION BY query_id))"""

ORACLE: dict[str, str] = {
    "scan_pages": f"WITH {PAGES} SELECT docid, url, CAST(octet_length(encode(content)) AS INT) AS n_bytes FROM d",
    "scan_json": f"WITH {PAGES} SELECT url, md5(content) AS content_md5 FROM d",
    "clean_pages": f"WITH {CLEAN} SELECT * FROM c",
    "html_text": f"WITH {CLEAN} SELECT docid, {_html_text('content')} AS text FROM c",
    "important_tokens": _important(),
    "links": f"WITH {CLEAN} SELECT DISTINCT docid AS src, split_part(resolved, '#', 1) AS dst_url FROM ({_links('c')})",
    "url_resolve": f"WITH {CLEAN} {_links('c')}",
    "url_defrag": f"WITH {PAGES} SELECT docid, split_part(url, '#', 1) AS base, CASE WHEN contains(url, '#') THEN substr(url, instr(url, '#') + 1) ELSE '' END AS fragment FROM d",
    "tokenize": f"SELECT doc_id, CAST(len(t) AS INT) AS n_tokens, md5(array_to_string(t, chr(10))) AS tokens_md5 FROM (SELECT doc_id, {_tokens('text')} AS t FROM documents WHERE text IS NOT NULL)",
    "ngrams": f"SELECT doc_id, CAST(len(n) AS INT) AS n_bigrams, md5(coalesce(array_to_string(n, '|'), '')) AS bigrams_md5 FROM ({_BIGRAMS})",
    "ngrams_flat": f"SELECT doc_id, CAST(len(n) AS INT) AS n, md5(coalesce(array_to_string(n, '|'), '')) AS flat_md5 FROM ({_FLAT})",
    "stem_vocab": f"WITH {CLEAN}, {_counts('c')}, {_VOCAB} SELECT word, token FROM v",
    "stopword_flag": f"WITH {CLEAN}, {_counts('c')}, {_VOCAB} SELECT DISTINCT token, token IN {_STOPWORDS} AS stopword FROM v",
    "word_count": f"WITH {CLEAN}, {_counts('c')}, {_VOCAB}, {_BAGS} SELECT docid, token, tf FROM b",
    "exact_hash": f"WITH {CLEAN} SELECT docid, CAST(crc AS BIGINT) AS crc, CAST(octet_length(encode(content)) AS INT) AS n_bytes FROM c JOIN ({_crc_table(32, hashing.crc32_table(), '(SELECT DISTINCT content FROM c)', 'content')}) USING (content)",
    "crc64_vocab": f"WITH {CLEAN}, {_counts('c')} SELECT word, lower(lpad(to_hex(crc), 16, '0')) AS crc FROM ({_crc_table(64, hashing.crc64_table(), '(SELECT DISTINCT word FROM k)', 'word')})",
    "simhash": f"WITH {PRINTS} SELECT docid, fp FROM f",
    "hamming_pairs": f"WITH {PRINTS}, x AS (SELECT DISTINCT fp FROM f) SELECT a.fp AS fp_a, b.fp AS fp_b, CAST(bit_count(xor(a.fp, b.fp)) AS INT) AS bits FROM x a JOIN x b ON a.fp < b.fp WHERE bit_count(xor(a.fp, b.fp)) <= 3",
    "dedup_url": f"WITH {URL} SELECT docid, url FROM u",
    "dedup_exact": f"WITH {EXACT} SELECT docid, url FROM e",
    "dedup_similar": f"WITH RECURSIVE {PRINTS}, {_KEPT} SELECT docid FROM kept",
    "inverted_index": f"WITH {CLEAN}, {_counts('c')}, {_VOCAB}, {_BAGS} SELECT token, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf, min(docid) AS first_docid, max(docid) AS last_docid FROM b GROUP BY token",
    "doc_freq": f"WITH {POSTINGS} SELECT token, count(*) AS df FROM p GROUP BY token",
    "docinfo": f"{BUILT} SELECT docid, CAST(coalesce(n, 0) AS INT) AS total_tokens, 1.0::FLOAT AS pr_quality, 1.0::FLOAT AS hub_quality, 1.0::FLOAT AS auth_quality, split_part(url, '#', 1) AS url FROM e JOIN kept USING (docid) LEFT JOIN (SELECT docid, count(*) AS n FROM b GROUP BY docid) USING (docid)",
    "built_postings": f"{BUILT} SELECT {_BUCKET} AS bid, token, docid, tf, 0 AS important FROM b",
    "batched_postings": f"{BUILT} SELECT {_BUCKET} AS bid, token, docid, tf, 0 AS important FROM b",
    "resume_point": f"WITH {CLEAN} SELECT max(docid) AS last_docid FROM c WHERE docid <= (SELECT max(docid) // 2 FROM c)",
    "docinfo_dense": f"WITH {DOCS}, {NODES} SELECT docid, coalesce(total_tokens, 0) AS total_tokens, {', '.join(f'coalesce({c}, 1.0::FLOAT) AS {c}' for c in _QUALITIES)}, coalesce(url, '') AS url, docs.total_tokens IS NULL AND docs.url IS NULL AS empty FROM nodes LEFT JOIN docs USING (docid)",
    "doclinks": "SELECT DISTINCT src, dst_url FROM doclinks WHERE src IS NOT NULL AND dst_url IS NOT NULL",
    "postings_bucketed": f"WITH {POSTINGS} SELECT {_BUCKET} AS bid, count(*) AS n, count(DISTINCT token) AS n_tokens, min(token) AS first, max(token) AS last FROM p GROUP BY 1",
    "lookup_postings": f"WITH {POSTINGS}, {QTOKENS} SELECT token, docid, tf, CAST(important AS INT) AS important FROM p WHERE token IN (SELECT token FROM qt) AND bid = {_BUCKET}",
    "index_stats": f"WITH {DOCS}, {POSTINGS} SELECT max(docid) AS last_docid, count(*) AS n_docs, CAST(coalesce(sum(CAST(coalesce(total_tokens, 0) <= 0 AS INT)), 0) AS BIGINT) AS n_empty, CAST(count(*) FILTER (total_tokens > 0) AS BIGINT) AS n_nonempty, (SELECT count(DISTINCT token) FROM p) AS n_tokens FROM docs",
    "saved_lookup": f"WITH {POSTINGS}, {QTOKENS} SELECT token, docid, tf, CAST(important AS INT) AS important FROM p WHERE token IN (SELECT token FROM qt)",
    "saved_search": f"WITH {SCORED} SELECT query_id, rank, docid, url, round(score, 6) AS score FROM ({RANKED}) WHERE rank <= 5",
    "index_append": f"WITH {CLEAN}, {_counts('c')}, {_VOCAB}, {_BAGS} SELECT token, count(*) AS df FROM b GROUP BY token",
    "link_graph": f"WITH {DOCS}, {EDGES} SELECT src, dst FROM edges",
    "out_degree": f"WITH {DOCS}, {EDGES}, {DEGREE} SELECT src, degree FROM deg",
    "pagerank": f"WITH {_pagerank()} SELECT docid, round(pr, 6) AS pr FROM p_end",
    "hits": f"WITH {DOCS}, {NODES}, {EDGES}, {_hits()} SELECT docid, round(hub, 6) AS hub, round(auth, 6) AS auth FROM h_end",
    "docinfo_quality": f"WITH {_pagerank()}, {_hits()} SELECT docid, total_tokens, round(CAST(CAST(pr AS FLOAT) AS DOUBLE), 5) AS pr_quality, round(CAST(CAST(hub AS FLOAT) AS DOUBLE), 5) AS hub_quality, round(CAST(CAST(auth AS FLOAT) AS DOUBLE), 5) AS auth_quality, url FROM docs JOIN p_end USING (docid) JOIN h_end USING (docid)",
    "query_prune": f"WITH {PRUNED} SELECT query_id, token, qtf, df FROM pr",
    "match_conjunctive": f"WITH {MATCHED} SELECT DISTINCT query_id, docid FROM hit",
    "match_intersect": f"WITH {PRUNED}, two AS (SELECT query_id, min(token) AS s, max(token) AS t FROM pr GROUP BY query_id HAVING min(token) < max(token)) SELECT query_id, docid FROM two JOIN p ON token = s INTERSECT SELECT query_id, docid FROM two JOIN p ON token = t",
    **{f"score_{n}": f"WITH {SCORED} SELECT query_id, docid, round({c}, 6) AS {c} FROM s" for n, c in (("tfidf", "tfidf"), ("cosine", "cosine"), ("relevance", "relevance"), ("quality", "quality"), ("net", "score"))},
    "search_full": f"WITH {SCORED} SELECT query_id, rank, docid, url, round(score, 6) AS score FROM ({RANKED})",
    "search_topk": f"WITH {SCORED} SELECT query_id, rank, docid, url, round(score, 6) AS score FROM ({RANKED}) WHERE rank <= 5",
    "format_tty": f"WITH {SCORED} SELECT query_id, rank, printf('Rank %d: %s (Score: %.2f)', rank, {_URL}, score) AS line FROM ({RANKED}) WHERE rank <= 5",
    "format_web": f"""WITH {CLEAN}, {SCORED} SELECT query_id, rank, printf('%d. <a href="%s" target="_blank">%s</a> (Score: %.2f)<br>Summary: %s', rank, {_escaped(_URL)}, {_escaped(_URL)}, score,
      {_escaped("CASE WHEN length(text) > 0 THEN text ELSE 'Summary not found' END")}) AS line FROM ({RANKED}) LEFT JOIN ({_SUMMARY}) USING (docid) WHERE rank <= 5""",
    "alt_score": f"WITH {ALT} SELECT query_id, docid, round(cosine, 6) AS cosine, round(score, 6) AS score FROM s",
    "alt_search": f"WITH {ALT} SELECT query_id, rank, docid, url, round(score, 6) AS score FROM ({RANKED}) WHERE rank <= 5",
    "format_alternative": f"""WITH {ALT} SELECT query_id, rank, printf('%d. <a href="%s" target="_blank">%s</a> (Score: %.2f)', rank, {_escaped(_URL)}, {_escaped(_URL)}, score) AS line FROM ({RANKED}) WHERE rank <= 5""",
    "summarize": f"WITH {CLEAN} SELECT docid, array_to_string(regexp_split_to_array(text, ' +')[:60], ' ') AS summary FROM (SELECT docid, trim(text, ' ') AS text FROM ({_SUMMARY})) WHERE length(text) > 0",
    "summary_latest": "SELECT docid, arg_max(coalesce(url, ''), {'a': ingested_at, 'b': coalesce(url, '')}) AS summary FROM pages WHERE docid IS NOT NULL AND ingested_at IS NOT NULL GROUP BY docid",
    "summary_input": f"WITH {CLEAN} {_SUMMARY}",
    "summary_lookup": f"WITH {CLEAN} SELECT docid, CASE WHEN length(text) > 0 THEN text ELSE 'Summary not found' END AS summary FROM (SELECT DISTINCT docid FROM pages) LEFT JOIN ({_SUMMARY}) USING (docid)",
}
