"""Fingerprints as Spark expressions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The reflected polynomial of CRC-64/XZ.
CRC64_POLYNOMIAL = 0xC96C5795D7870F42


def crc64_table() -> list[int]:
    """The table of CRC-64/XZ by its rule, unsigned."""
    out = []
    for byte in range(256):
        for _ in range(8):
            byte = byte >> 1 ^ (CRC64_POLYNOMIAL if byte & 1 else 0)
        out.append(byte)
    return out


def crc32_table() -> list[int]:
    """The table of CRC-32 by its rule."""
    out = []
    for byte in range(256):
        for _ in range(8):
            byte = byte >> 1 ^ (0xEDB88320 if byte & 1 else 0)
        out.append(byte)
    return out


def crc64_of(words: list[bytes]) -> np.ndarray:
    """CRC-64/XZ of each word, 0 for empty ones, signed: one table look-up for all words at each place."""
    table = np.array(crc64_table(), dtype=np.uint64)
    lengths = np.array([len(w) for w in words], dtype=np.int64)
    order = np.argsort(-lengths, kind="stable")
    ranked = lengths[order]
    starts = np.concatenate([[0], np.cumsum(lengths)])[:-1][order]
    octets = np.frombuffer(b"".join(words), dtype=np.uint8)
    crc = np.full(len(words), np.uint64(0xFFFFFFFFFFFFFFFF))
    for k in range(int(lengths.max(initial=0))):
        n = int(np.searchsorted(-ranked, -k, side="left"))
        crc[:n] = crc[:n] >> np.uint64(8) ^ table[((crc[:n] ^ octets[starts[:n] + k]) & np.uint64(255)).astype(np.int64)]
    out = np.empty(len(words), dtype=np.uint64)
    out[order] = np.where(ranked > 0, ~crc, np.uint64(0))
    return out.astype(np.int64)


def crc64(word: Column) -> Column:
    """CRC-64/XZ of a word's UTF-8 bytes, as a signed 64-bit number; null for null. Works on Arrow batches."""

    @F.pandas_udf("long")
    def run(words: pd.Series) -> pd.Series:
        crc = pd.Series(crc64_of([w.encode("utf-8", "surrogatepass") if w is not None else b"" for w in words]), index=words.index)
        return crc.where(words.notna(), None)

    return run(word)


def exact_hash(text: Column) -> list[Column]:
    """CRC-32 and number of bytes of a text."""
    return [F.crc32(F.encode(text, "UTF-8")).alias("crc"), F.octet_length(text).alias("n_bytes")]


def simhash(bags: DataFrame, doc: str = "docid", count: str = "tf", low: str = "low") -> DataFrame:
    """32-bit fingerprints ``docid, fp`` of bags with the words' lower 32 CRC bits in ``low``.

    A bit is set where the counts of words having it outweigh the others; a tie clears it. All 32 sums
    are partial aggregates of one pass.
    """
    bit = lambda k: F.shiftright(F.col(low), k).bitwiseAND(F.lit(1))
    sums = [F.sum(F.when(bit(k) == 1, F.col(count)).otherwise(-F.col(count))).alias(f"s{k}") for k in range(32)]
    summed = bags.groupBy(doc).agg(*sums)
    fp = sum((F.when(F.col(f"s{k}") > 0, F.lit(1 << k)).otherwise(F.lit(0)).cast("long") for k in range(32)), F.lit(0).cast("long"))
    return summed.select(doc, fp.alias("fp"))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))
