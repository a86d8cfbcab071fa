"""Matches of a batch of queries and their scores, found documents by documents without moving or writing a match."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.operators.ranking import row_number_within
from pagewright.plans.materialize import discard, materialize, materialize_counted

#: Tokens of bags that are sent to the tasks at once, rows of a batch that tasks return, queries that may be broadcast.
SLICE, ROWS, FEW_QUERIES = 1_000_000, 200_000, 1_000_000
#: Documents whose addresses may be broadcast, and matches of a bag that one task may put in order.
FEW_DOCS, FEW_MATCHES = 500_000, 4_000_000
#: Rows that documents with repeated postings are expanded to at once.
EXPANDED = 2_000_000
QUALITIES = ("pr_quality", "hub_quality", "auth_quality")


@dataclass(frozen=True)
class Bags:
    """Some of a batch's bags, from ``first`` on: their tokens as places in ``vocab``, with weights, bag by bag."""

    first: int
    vocab: np.ndarray
    starts: np.ndarray
    tokens: np.ndarray
    weights: np.ndarray

    @property
    def lengths(self) -> np.ndarray:
        return np.sqrt(np.add.reduceat(self.weights * self.weights, self.starts[:-1])) if len(self.tokens) else np.zeros(0)

    def __len__(self) -> int:
        return len(self.starts) - 1


@dataclass(frozen=True)
class Batch:
    """Queries that ask for the same tokens with the same weights share a bag, which is answered once.

    ``queries``: query_id, bag_id. ``packed``: one row a document with all its postings of the batch's tokens.
    """

    queries: DataFrame
    n_queries: int
    slices: list[Bags]
    packed: DataFrame
    n_packed: int


def batch(asked: DataFrame, postings: DataFrame, docs: DataFrame) -> Batch:
    """A batch of ``query_id, token, wq`` over ``token, docid, w`` and ``docid, url, total_tokens`` with qualities."""
    bagged = materialize(asked.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("token", "wq"))).alias("bag")), "bags")
    numbered = lambda df, out: df.repartition(1).withColumn(out, F.monotonically_increasing_id())
    bags, n_bags = materialize_counted(numbered(bagged.select("bag").distinct(), "bag_id"), "distinct-bags")
    queries, n_queries = materialize_counted(bagged.join(bags, "bag").select("query_id", "bag_id"), "bags-of-queries")
    vocab, n_vocab = materialize_counted(numbered(asked.select("token").distinct(), "tid"), "vocabulary")
    flat = bags.select("bag_id", F.posexplode("bag").alias("pos", "t")).select("bag_id", "pos", "t.token", "t.wq").join(vocab, "token")
    flat, n_flat = materialize_counted(flat.select("bag_id", "pos", "tid", "wq"), "bag-tokens")
    each = max(1, n_bags * SLICE // max(n_flat, 1))
    slices = [_slice(flat, at, min(at + each, n_bags)) for at in range(0, n_bags, each)]
    known = postings.join(F.broadcast(vocab) if n_vocab <= FEW_QUERIES else vocab, "token").select("docid", F.struct("tid", "w").alias("p"))
    of_doc = known.repartition("docid").groupBy("docid").agg(F.collect_list("p").alias("p"))
    wide = docs.select("docid", "url", F.col("total_tokens").cast("double").alias("total_tokens"), *[F.col(c).cast("double").alias(c) for c in QUALITIES])
    packed, n_packed = materialize_counted(of_doc.join(wide, "docid").select(*wide.columns, F.col("p.tid").alias("tids"), F.col("p.w").alias("ws")), "packed")
    discard(bagged, bags, vocab, flat)
    return Batch(queries, n_queries, slices, packed, n_packed)


def _slice(flat: DataFrame, first: int, end: int) -> Bags:
    rows = flat.filter(F.col("bag_id").between(first, end - 1)).orderBy("bag_id", "pos").toArrow()
    vocab, tokens = np.unique(rows["tid"].to_numpy(), return_inverse=True)
    starts = np.searchsorted(rows["bag_id"].to_numpy(), np.arange(first, end + 1))
    return Bags(first, vocab, starts, tokens, rows["wq"].to_numpy().astype("float64"))


#: What is known of documents that match a bag: its place in the slice, their rows in the batch, the sums of w, w * wq, w * w, wq * wq.
Block = tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def blocks(rows: pa.RecordBatch, bags: Bags) -> Iterator[Block]:
    """The documents of ``rows`` that have as many postings of a bag's tokens as it has tokens, bag by bag."""
    held = rows.column("tids")
    t, w = held.flatten().to_numpy(), rows.column("ws").flatten().to_numpy(zero_copy_only=False)
    d = np.repeat(np.arange(rows.num_rows), held.value_lengths().to_numpy())
    if not len(bags.vocab) or not len(t):
        return
    place = np.minimum(np.searchsorted(bags.vocab, t), len(bags.vocab) - 1)
    here = np.flatnonzero(bags.vocab[place] == t)
    here = here[np.argsort(place[here], kind="stable")]
    t, d, w = place[here], d[here], w[here]
    odd = np.zeros(rows.num_rows, bool)
    again = np.lexsort((d, t))
    t, d, w = t[again], d[again], w[again]
    odd[d[1:][(t[1:] == t[:-1]) & (d[1:] == d[:-1])]] = True
    odd[d[np.isnan(w)]] = True
    if odd.any():
        yield from _repeated(t[odd[d]], d[odd[d]], w[odd[d]], rows.num_rows, bags)
        t, d, w = (x[~odd[d]] for x in (t, d, w))
    begin, end = (np.searchsorted(t, np.arange(len(bags.vocab)), side) for side in ("left", "right"))
    counts, places = end - begin, {}

    def locate(token: int, found: np.ndarray) -> np.ndarray:
        """Where a token's postings of some documents are, below 0 without one; tokens of many documents keep a table."""
        own = d[begin[token] : end[token]]
        if len(own) * 8 < rows.num_rows:
            at = np.minimum(np.searchsorted(own, found), len(own) - 1)
            return np.where(own[at] == found, begin[token] + at, -1)
        if token not in places:
            places[token] = np.full(rows.num_rows, -1, "int32")
            places[token][own] = np.arange(begin[token], end[token])
        return places[token][found]

    least = np.minimum.reduceat(counts[bags.tokens], bags.starts[:-1])
    for bag in np.flatnonzero(least):
        own = slice(bags.starts[bag], bags.starts[bag + 1])
        tokens, wq = bags.tokens[own], bags.weights[own]
        order = np.argsort(counts[tokens], kind="stable")
        found = d[begin[tokens[order[0]]] : end[tokens[order[0]]]]
        for k in order[1:]:
            found = found[locate(tokens[k], found) >= 0]
            if not len(found):
                break
        if len(found):
            ws = [w[locate(token, found)] for token in tokens]
            yield bag, found, sum(ws), sum(x * y for x, y in zip(ws, wq, strict=True)), sum(x * x for x in ws), np.full(len(found), float(wq @ wq))


def _repeated(t: np.ndarray, d: np.ndarray, w: np.ndarray, n_rows: int, bags: Bags) -> Iterator[Block]:
    """The same for documents with several postings of a token, which count each, or with ones of no weight."""
    bag_of = np.repeat(np.arange(len(bags)), np.diff(bags.starts))
    by_token = np.argsort(bags.tokens, kind="stable")
    begin, end = (np.searchsorted(bags.tokens[by_token], np.arange(len(bags.vocab)), side) for side in ("left", "right"))
    order = np.argsort(d, kind="stable")
    t, d, w = t[order], d[order], w[order]
    many = (end - begin)[t]
    ends = np.flatnonzero(np.append(d[1:] != d[:-1], True)) + 1
    cut = np.append(True, np.diff(np.cumsum(many)[ends - 1] // EXPANDED) > 0)
    borders = [0, *ends[:-1][cut[1:]].tolist(), len(d)]
    for lo, hi in zip(borders[:-1], borders[1:], strict=True):
        row = np.repeat(np.arange(lo, hi), many[lo:hi])
        inside = np.arange(len(row)) - np.repeat(np.cumsum(many[lo:hi]) - many[lo:hi], many[lo:hi])
        entry = by_token[begin[t[row]] + inside]
        keys, at = np.unique(bag_of[entry] * n_rows + d[row], return_inverse=True)
        x, y, none = np.nan_to_num(w[row], nan=0.0), bags.weights[entry], np.isnan(w[row])
        add = lambda v: np.bincount(at, v, len(keys))
        w_sum, both, ww, qq, void = add(x), add(x * y), add(x * x), add(y * y), add(~none) == 0
        w_sum[void] = np.nan
        full = np.flatnonzero(np.bincount(at, minlength=len(keys)) == np.diff(bags.starts)[keys // n_rows])
        of = keys[full] // n_rows
        for part in np.split(full, np.flatnonzero(of[1:] != of[:-1]) + 1):
            if len(part):
                yield int(keys[part[0]] // n_rows), keys[part] % n_rows, w_sum[part], both[part], ww[part], qq[part]


@dataclass(frozen=True)
class Scorer:
    """``figures(block, documents, bags)`` are arrays of a block's documents; ``greatest`` tells whether a bag's are maxima or sums of squares.

    ``columns(figures, m, whole)`` has the scores, given the size of the bag's result and its figures put together.
    """

    figures: Callable[[Block, dict[str, np.ndarray], Bags], list[np.ndarray]]
    columns: Callable[[list[np.ndarray], int, np.ndarray], dict[str, np.ndarray]]
    n_figures: int
    greatest: bool


def _documents(rows: pa.RecordBatch) -> dict[str, np.ndarray]:
    return {c: rows.column(c).to_numpy(zero_copy_only=False) for c in ("total_tokens", *QUALITIES)}


def norms(packed: DataFrame, bags: Bags, scorer: Scorer) -> np.ndarray:
    """A row a bag: the size of its result and the scorer's figures put together; each task returns a row a bag."""
    n, names = scorer.n_figures, [f"f{i}" for i in range(scorer.n_figures)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((len(bags), n + 1))
        if scorer.greatest:
            out[:, 1:] = -np.inf
        with np.errstate(all="ignore"):
            for rows in batches:
                documents = _documents(rows)
                for block in blocks(rows, bags):
                    out[block[0], 0] += len(block[1])
                    for i, x in enumerate(scorer.figures(block, documents, bags), 1):
                        if scorer.greatest:
                            out[block[0], i] = np.maximum(out[block[0], i], x.max())
                        else:
                            x = x[~np.isnan(x)] if i == 1 else x
                            out[block[0], i] += x @ x
        some = np.flatnonzero(out[:, 0])
        yield pa.RecordBatch.from_arrays([pa.array(some), *[pa.array(out[some, i]) for i in range(n + 1)]], ["bag", "m", *names])

    found = packed.mapInArrow(run, f"bag long, m double, {', '.join(f'{x} double' for x in names)}").groupBy("bag")
    table = found.agg(F.sum("m").alias("m"), *[(F.max(x) if scorer.greatest else F.sum(x)).alias(x) for x in names]).toArrow()
    out = np.zeros((len(bags), n + 1))
    out[table["bag"].to_numpy()] = np.column_stack([table[x].to_numpy() for x in ("m", *names)]) if len(table) else 0
    return out if scorer.greatest else np.column_stack([out[:, :1], np.sqrt(out[:, 1:])])


def _rounded(score: np.ndarray) -> np.ndarray:
    """Scores to nine places, as whole numbers; what is near a half is rounded by its digits, as Spark does it. Scores that are no number come last."""
    scaled = score * 1e9 + 0.5
    out = np.floor(scaled)
    for i in np.flatnonzero(np.isfinite(score) & (np.floor(scaled - 1e-5) != np.floor(scaled + 1e-5))):
        out[i] = float(Decimal(repr(float(score[i]))).scaleb(9).quantize(Decimal(1), ROUND_HALF_UP))
    return np.where(np.isnan(score), -np.inf, out)


def _best(score: np.ndarray, docid: np.ndarray, k: int) -> np.ndarray:
    """Places of the best ``k`` by rounded score, then docid."""
    whole = _rounded(score)
    some = np.flatnonzero(whole >= np.partition(whole, len(whole) - k)[len(whole) - k]) if len(whole) > k else np.arange(len(whole))
    return some[np.lexsort((docid[some], -whole[some]))[:k]]


def scored(found: Batch, scorer: Scorer, columns: tuple[str, ...], k: int | None = None) -> DataFrame:
    """``query_id`` and the columns of all matches; with ``k``, the best ``k`` of each query out of each of the tasks' batches."""
    parts = [_rows(found, bags, norms(found.packed, bags, scorer), scorer, columns, k) for bags in found.slices]
    return _of_queries(_union(found, parts, _schema(found, columns)), found)


def ordered(found: Batch, scorer: Scorer) -> DataFrame:
    """``query_id, rank, docid, url, score`` of all matches, best first, ties by docid.

    A bag's docids and scores are moved once, packed, to one task that orders them; bags with more than
    ``FEW_MATCHES`` matches are ordered range by range.
    """
    parts = []
    for bags in found.slices:
        whole = norms(found.packed, bags, scorer)
        few = whole[:, 0] <= FEW_MATCHES
        parts.append(_numbered(found, bags, whole, scorer, few))
        if not few.all():
            rows = _rows(found, bags, whole, scorer, ("docid", "score"), only=~few).withColumn("_less", -F.round("score", 9))
            parts.append(row_number_within(rows, "bag_id", ["_less", "docid"], "rank").select("bag_id", "rank", "docid", "score"))
    rows, urls = _union(found, parts, f"rank long, {_schema(found, ('docid', 'score'))}"), found.packed.select("docid", "url")
    rows = rows.join(F.broadcast(urls) if found.n_packed <= FEW_DOCS else urls, "docid")
    return _of_queries(rows.select("bag_id", "rank", "docid", "url", "score"), found)


def _planes(values: np.ndarray) -> bytes:
    """Eight-byte numbers by places of their bytes, which compress well together."""
    return values.view("uint8").reshape(-1, 8).T.tobytes()


def _numbers(planes: bytes, kind: str) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes, "uint8").reshape(8, -1).T).reshape(-1).view(kind)


def _numbered(found: Batch, bags: Bags, whole: np.ndarray, scorer: Scorer, only: np.ndarray) -> DataFrame:
    """``bag_id, rank, docid, score`` of a slice's matches of the bags that ``only`` marks."""
    names = ["bag_id", "rank", "docid", "score"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            docid, parts = rows.column("docid").to_numpy().astype("int64"), []
            for bag, at, figures in _scores(rows, bags, whole, scorer, only):
                order = np.argsort(docid[at])
                parts.append((bags.first + bag, _planes(np.diff(docid[at][order], prepend=0)), _planes(figures["score"][order])))
                if len(parts) == 1000:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*parts, strict=True)], ["bag_id", "docids", "scores"])
                    parts = []
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*parts, strict=True)], ["bag_id", "docids", "scores"])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, docids, scores, done, n = None, [], [], [], 0
        for rows in batches:
            for bag, docid, score in zip(*(rows.column(c).to_pylist() for c in ("bag_id", "docids", "scores")), strict=True):
                if bag != last and docids:
                    done.append(order(last, docids, scores))
                    n, docids, scores = n + len(done[-1][0]), [], []
                    if n >= ROWS:
                        yield from table(done)
                        done, n = [], 0
                last = bag
                docids.append(np.cumsum(_numbers(docid, "int64")))
                scores.append(_numbers(score, "float64"))
        if docids:
            done.append(order(last, docids, scores))
            yield from table(done)

    def order(bag: int, docids: list[np.ndarray], scores: list[np.ndarray]) -> tuple[np.ndarray, ...]:
        docid, score = np.concatenate(docids), np.concatenate(scores)
        by = np.lexsort((docid, -_rounded(score)))
        return np.full(len(by), bag), np.arange(1, len(by) + 1), docid[by], score[by]

    def table(done: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        whole_table = pa.table([pa.array(np.concatenate(x)) for x in zip(*done, strict=True)], names=names)
        yield from whole_table.to_batches(max_chunksize=ROWS)

    packed = found.packed.mapInArrow(pack, "bag_id long, docids binary, scores binary")
    rows = packed.repartition("bag_id").sortWithinPartitions("bag_id").mapInArrow(number, "bag_id long, rank long, docid long, score double")
    return rows.withColumn("docid", F.col("docid").cast(dict(found.packed.dtypes)["docid"]))


def _union(found: Batch, parts: list[DataFrame], schema: str) -> DataFrame:
    if not parts:
        return found.packed.sparkSession.createDataFrame([], f"bag_id long, {schema}")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _of_queries(rows: DataFrame, found: Batch) -> DataFrame:
    few = F.broadcast(found.queries) if found.n_queries <= FEW_QUERIES else found.queries
    return rows.join(few, "bag_id").select("query_id", *[c for c in rows.columns if c != "bag_id"])


def _schema(found: Batch, columns: tuple[str, ...]) -> str:
    kinds = dict(found.packed.dtypes)
    return ", ".join(f"{c} {kinds[c] if c in ('docid', 'url') else 'double'}" for c in columns)


def _rows(found: Batch, bags: Bags, whole: np.ndarray, scorer: Scorer, columns: tuple[str, ...], k: int | None = None, only: np.ndarray | None = None) -> DataFrame:
    """``bag_id`` and the columns of a slice's matches, of the bags that ``only`` marks if it is given."""

    def table(rows: pa.RecordBatch, parts: list[tuple[int, np.ndarray, dict[str, np.ndarray]]]) -> pa.RecordBatch:
        at = np.concatenate([p[1] for p in parts])
        ids = np.repeat([bags.first + p[0] for p in parts], [len(p[1]) for p in parts])
        stored = lambda c: rows.column(c).take(pa.array(at))
        score = lambda c: pa.array(np.concatenate([p[2][c] for p in parts]), from_pandas=c == "tfidf")
        return pa.RecordBatch.from_arrays([pa.array(ids), *[stored(c) if c in ("docid", "url") else score(c) for c in columns]], ["bag_id", *columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            parts, n = [], 0
            for bag, at, figures in _scores(rows, bags, whole, scorer, only):
                if k is not None:
                    best = _best(figures["score"], rows.column("docid").to_numpy()[at], k)
                    at, figures = at[best], {c: x[best] for c, x in figures.items()}
                parts.append((bag, at, figures))
                n += len(at)
                if n >= ROWS:
                    yield table(rows, parts)
                    parts, n = [], 0
            if n:
                yield table(rows, parts)

    return found.packed.mapInArrow(run, f"bag_id long, {_schema(found, columns)}")


def _scores(rows: pa.RecordBatch, bags: Bags, whole: np.ndarray, scorer: Scorer, only: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, dict[str, np.ndarray]]]:
    documents = _documents(rows)
    with np.errstate(all="ignore"):
        for block in blocks(rows, bags):
            bag = block[0]
            if only is None or only[bag]:
                yield bag, block[1], scorer.columns(scorer.figures(block, documents, bags), int(whole[bag, 0]), whole[bag, 1:])
