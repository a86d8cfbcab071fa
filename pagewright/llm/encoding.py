"""Encoding a corpus with a public byte-level BPE, each shared chunk of text once.

Texts are cut where a rolling hash of their content says so, so equal stretches of different texts give
equal chunks. A chunk that several texts have is encoded once, in one text that owns it, and the ids are
spliced into all others. A chunk's first and last ids depend on its neighbours; around each join the text
is encoded again, from the last place in front of it to the first place behind it where both sides
provably part, and the splice is taken only if the chunk's ids part there too.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.batches import pieces
from pagewright.operators.skew import HOT, join_weighted
from pagewright.plans.materialize import discard, materialize

BYTE_BPE = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern by which the vocabulary's texts are first parted.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Chunks are cut at one of 2 ** MASK_BITS places, not before LEAST and not after MOST characters.
MASK_BITS, LEAST, MOST = 8, 64, 4096
_WINDOW = 16
#: Bytes of spliced ids up to which they are broadcast to the texts; more are shuffled.
BROADCAST_BYTES = 64 << 20

#: Encoded texts that a task remembers for their copies.
COPIES = 256

_LOADED: dict[str, tuple] = {}


def tokenizer(path: str = BYTE_BPE):
    """The encoder of a vocabulary file and each id's number of bytes, loaded once a process."""
    if path not in _LOADED:
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        encoder = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        widths = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        for token, rank in ranks.items():
            widths[rank] = len(token)
        _LOADED[path] = encoder, widths
    return _LOADED[path]


def chunk_ends(text: str) -> list[int]:
    """Where the chunks of a text end; the last is the text's end."""
    n = len(text)
    if n <= LEAST:
        return [n] if n else []
    h = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    width = 1
    while width < _WINDOW:
        h = h[:-width] * np.uint64(0x5851F42D4C957F2D) + (h[width:] ^ (h[width:] >> np.uint64(31)))
        width *= 2
    h ^= h >> np.uint64(32)
    wanted = np.flatnonzero((h & np.uint64((1 << MASK_BITS) - 1)) == 0) + _WINDOW
    out, last = [], 0
    for end in [*wanted.tolist(), n]:
        while end - last > MOST:
            last += MOST
            out.append(last)
        if end - last >= LEAST or end == n:
            if end > last:
                out.append(end)
            last = end
    return out


def parts_at(text: str, at: int) -> bool:
    """Whether every scan of the text parts at a place: an end, or white space after something else.

    No piece of the pattern holds white space behind another character, and a piece is found by looking
    ahead only, so what is before such a place and what is behind it are encoded independently.
    """
    return at == 0 or at == len(text) or (text[at] in " \n" and not text[at - 1].isspace())


def splice(text: str, start: int, end: int, ids: np.ndarray, widths: np.ndarray) -> tuple[int, int, np.ndarray] | None:
    """The largest stretch of a chunk whose ids hold inside the text, and those ids; None if there is none.

    Candidate places are tried from the chunk's ends inwards until both part the text and fall between
    two ids of the chunk.
    """
    bounds = np.concatenate([[0], np.cumsum(widths[ids])])
    chunk = text[start:end]
    ascii_only = chunk.isascii()

    def between(at: int) -> int | None:
        offset = at - start if ascii_only else len(chunk[: at - start].encode("utf-8"))
        k = int(np.searchsorted(bounds, offset))
        return k if k < len(bounds) and bounds[k] == offset else None

    left = start
    while left < end and not (parts_at(text, left) and between(left) is not None):
        left += 1
    right = end
    while right > left and not (parts_at(text, right) and between(right) is not None):
        right -= 1
    if left >= right:
        return None
    return left, right, ids[between(left) : between(right)]


def encode_spliced(text: str, known: list[tuple[int, int, np.ndarray]], encoder, widths: np.ndarray) -> list[int]:
    """The ids of a text, using ``known`` ids of chunks ``(start, end, ids)`` where they hold."""
    out: list[int] = []
    done = 0
    for start, end, ids in sorted(known, key=lambda k: k[0]):
        if start < done:
            continue
        found = splice(text, start, end, ids, widths)
        if found is None:
            continue
        left, right, middle = found
        if left > done:
            out += encoder.encode_ordinary(text[done:left])
        out += middle.tolist()
        done = right
    if done < len(text):
        out += encoder.encode_ordinary(text[done:])
    return out


def _signed(n: int) -> int:
    return n - (1 << 64) if n >= 1 << 63 else n


def _by_chunk(rows: DataFrame, dim: DataFrame, times: DataFrame) -> DataFrame:
    """``rows`` of chunks joined with ``dim``, one row a chunk; a chunk in a large part of all rows has its row broadcast.

    ``times`` has how often each chunk stands in ``rows``.
    """
    figures = times.agg(F.sum("times").alias("total"), F.max("times").alias("most")).first()
    total, most = figures["total"] or 0, figures["most"] or 0
    if most <= HOT or most * HOT < total:
        return rows.join(dim, ["h", "g"])
    return join_weighted(rows, dim.join(times, ["h", "g"]), ["h", "g"], "times", total).drop("times")


def shared_chunks(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``h, g, tid, start, stop`` of every chunk that several places have, and ``h, g, times``; h and g are its 128-bit hash.

    A text that a task has met before is not cut again.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        met: set[str] = set()
        for batch in pieces(batches):
            rows = []
            for tid, text in zip(batch["tid"], batch["text"], strict=True):
                if tid in met:
                    continue
                met.add(tid)
                last = 0
                for end in chunk_ends(text):
                    d = xxhash.xxh3_128_intdigest(text[last:end].encode("utf-8", "surrogatepass"))
                    rows.append((_signed(d >> 64), _signed(d & ((1 << 64) - 1)), tid, last, end))
                    last = end
            yield pd.DataFrame(rows, columns=["h", "g", "tid", "start", "stop"])

    chunks = materialize(texts.mapInPandas(run, "h long, g long, tid string, start int, stop int"), "chunks")
    often = materialize(chunks.groupBy("h", "g").agg(F.count(F.lit(1)).alias("times")).filter("times > 1"), "often")
    shared = materialize(_by_chunk(chunks, often.select("h", "g"), often), "shared-chunks")
    discard(chunks)
    return shared, often


def _with_text(texts: DataFrame, lists: DataFrame, how: str, size: int) -> DataFrame:
    return texts.join(F.broadcast(lists) if size <= BROADCAST_BYTES else lists, "tid", how)


def encode_corpus(documents: DataFrame, key: str = "doc_id", text: str = "text", path: str = BYTE_BPE) -> DataFrame:
    """``key, ids``: the ids of each row's text, without special tokens.

    Null and empty texts have an empty list; every row, repeated ones and those with a null key too,
    gives one row. Texts that look like special tokens are ordinary text. Other columns are not looked at.
    """
    rows = documents.select(F.col(key).alias("key"), F.col(text).alias("text"), F.md5(F.col(text)).alias("tid"))
    filled = rows.filter(F.length("text") > 0)
    shared, often = shared_chunks(filled.select("tid", "text"))
    owner = F.min(F.struct("tid", "start", "stop")).alias("o")
    owners = shared.groupBy("h", "g").agg(owner).groupBy("o.tid").agg(F.collect_list(F.struct("h", "g", "o.start", "o.stop")).alias("spans"))
    owners = materialize(owners, "owners")
    owned = owners.agg(F.sum(F.size("spans") * 24)).first()[0] or 0

    def encode_owned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, _ = tokenizer(path)
        for batch in pieces(batches):
            out = []
            for content, spans in zip(batch["text"], batch["spans"], strict=True):
                out += [(s["h"], s["g"], np.array(encoder.encode_ordinary(content[s["start"] : s["stop"]]), dtype="<i4").tobytes()) for s in spans]
            yield pd.DataFrame(out, columns=["h", "g", "ids"])

    encoded = _with_text(filled, owners, "inner", owned).mapInPandas(encode_owned, "h long, g long, ids binary")
    encoded = materialize(encoded.dropDuplicates(["h", "g"]), "encoded-chunks")
    places = _by_chunk(shared.select("h", "g", "tid", "start", "stop"), encoded, often).dropDuplicates(["tid", "start"])
    known = materialize(places.groupBy("tid").agg(F.collect_list(F.struct("start", "stop", "ids")).alias("known")), "known")
    weight = known.agg(F.sum(F.aggregate("known", F.lit(0).cast("long"), lambda acc, k: acc + F.length(k["ids"]) + 24))).first()[0] or 0

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, widths = tokenizer(path)
        done: dict[str, list[int]] = {}
        for batch in pieces(batches):
            ids = []
            for tid, content, given in zip(batch["tid"], batch["text"], batch["known"], strict=True):
                if not content:
                    ids.append([])
                elif tid in done:
                    ids.append(done[tid])
                elif given is None:
                    ids.append(encoder.encode_ordinary(content))
                else:
                    ids.append(encode_spliced(content, [(k["start"], k["stop"], np.frombuffer(k["ids"], dtype="<i4")) for k in given], encoder, widths))
                    if len(done) >= COPIES:
                        done.clear()
                    done[tid] = ids[-1]
            yield pd.DataFrame({"key": batch["key"], "ids": ids})

    kind = documents.schema[key].dataType.simpleString()
    out = _with_text(rows, known, "left", weight).select("key", "tid", "text", "known").mapInPandas(encode, f"key {kind}, ids array<int>")
    return out.withColumnRenamed("key", key)


def token_counts(documents: DataFrame, key: str = "doc_id", text: str = "text", path: str = BYTE_BPE) -> DataFrame:
    """``key, tokens`` of each row with a key; null and empty texts have 0."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, _ = tokenizer(path)
        for batch in pieces(batches):
            yield pd.DataFrame({"key": batch["key"], "tokens": [len(encoder.encode_ordinary(t)) if t else 0 for t in batch["text"]]})

    chosen = documents.filter(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"))
    return chosen.mapInPandas(run, f"key {documents.schema[key].dataType.simpleString()}, tokens int").withColumnRenamed("key", key)
