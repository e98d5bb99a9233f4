"""Fingerprints and near-duplicate lines: FNV-1a, SipHash-1-3, SimHash over byte 4-grams, multi-index Hamming join, ordered dedup."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

# Fixed values of FNV-1a with 64 bits.
FNV_BASIS, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3
U64 = np.uint64


def fnv1a(grams: np.ndarray) -> np.ndarray:
    """FNV-1a of each row of bytes."""
    h = np.full(len(grams), FNV_BASIS, U64)
    for column in grams.T:
        h = (h ^ column.astype(U64)) * U64(FNV_PRIME)
    return h


def _rotl(x: np.ndarray, n: int) -> np.ndarray:
    return (x << U64(n)) | (x >> U64(64 - n))


def siphash13(words: np.ndarray, size: int, key: tuple[int, int] = (0, 0)) -> np.ndarray:
    """SipHash-1-3 of many messages of size bytes at once: words holds their 64-bit little-endian words, the last one padded
    with zeros (a whole word of zeros where size is a multiple of 8)."""
    k0, k1 = U64(key[0]), U64(key[1])
    start = [k0 ^ U64(0x736F6D6570736575), k1 ^ U64(0x646F72616E646F6D), k0 ^ U64(0x6C7967656E657261), k1 ^ U64(0x7465646279746573)]
    a, b, c, d = (np.full(len(words), v, U64) for v in start)

    def turn(a, b, c, d):
        a, c = a + b, c + d
        b, d = _rotl(b, 13) ^ a, _rotl(d, 16) ^ c
        a = _rotl(a, 32)
        c, a = c + b, a + d
        b, d = _rotl(b, 17) ^ c, _rotl(d, 21) ^ a
        return a, b, _rotl(c, 32), d

    for i in range(words.shape[1]):
        m = words[:, i] | U64((size & 0xFF) << 56) if i == words.shape[1] - 1 else words[:, i]
        a, b, c, d = turn(a, b, c, d ^ m)
        a = a ^ m
    c = c ^ U64(0xFF)
    for _ in range(3):
        a, b, c, d = turn(a, b, c, d)
    return a ^ b ^ c ^ d


def sip_bytes(grams: np.ndarray) -> np.ndarray:
    """SipHash-1-3 with a zero key of each row of bytes, their number (as 64 bits) before them."""
    n = grams.shape[1]
    padded = np.zeros((len(grams), (8 + n) // 8 * 8 + 8), np.uint8)
    padded[:, 0] = n  # rows have fewer than 256 bytes
    padded[:, 8 : 8 + n] = grams
    return siphash13(padded.view("<u8"), 8 + n)


def simhash(text: str | None, hashed=fnv1a) -> int:
    """A signed 64-bit fingerprint: each byte 4-gram votes on each bit; shorter texts hash whole, the empty text is 0."""
    data = np.frombuffer((text or "").encode(), np.uint8)
    if not len(data):
        return 0
    grams = data[None, :] if len(data) < 4 else np.lib.stride_tricks.sliding_window_view(data, 4)
    hashes = hashed(grams)
    if len(data) < 4:
        return int(hashes.view(np.int64)[0])
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    votes = 2 * bits.sum(axis=0, dtype=np.int64) > len(hashes)
    return int(np.packbits(votes, bitorder="little").view(np.int64)[0])


@F.pandas_udf(LongType())
def simhash_udf(texts: pd.Series) -> pd.Series:
    return texts.map(simhash).astype("int64")


@F.pandas_udf(LongType())
def sip_simhash_udf(texts: pd.Series) -> pd.Series:
    """simhash() with SipHash-1-3 in place of FNV-1a."""
    return texts.map(lambda t: simhash(t, sip_bytes)).astype("int64")


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def blocks_of(most: int) -> list[tuple[int, int]]:
    """(first bit, width) of the blocks that 64 bits are cut into: three more than most, so that of blocks with a differing
    bit at least three are left."""
    n = most + 3
    edges = [64 * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def similar_pairs(rows: DataFrame, most: int = 3, id_col: str = "id", hash_col: str = "hash") -> DataFrame:
    """Pairs (a < b) of rows whose fingerprints differ in at most most bits.

    A multi-index: of most + 3 blocks a similar pair differs in most at most, so it agrees on three of them. Each three
    blocks together, about 32 bits for most = 3, are a table; rows meet in the tables under the table's number and their bits
    of these blocks, and only in the first table in which they do is a pair kept. Equal fingerprints are collapsed first:
    pairs are between the smallest ids of each fingerprint.
    """
    reps = rows.groupBy(hash_col).agg(F.min(id_col).alias("id"))
    tables = list(combinations(blocks_of(most), 3))
    masks = [sum(((1 << width) - 1) << first for first, width in t) for t in tables]
    masks = [m - (1 << 64) if m >> 63 else m for m in masks]
    keys = reps.select("id", F.col(hash_col).alias("h"), F.posexplode(F.array(*[F.col(hash_col).bitwiseAND(F.lit(m)) for m in masks])).alias("table", "key"))
    x, y = keys.alias("x"), keys.alias("y")
    near = x.join(y, (F.col("x.table") == F.col("y.table")) & (F.col("x.key") == F.col("y.key")) & (F.col("x.id") < F.col("y.id")))
    near = near.filter(hamming(F.col("x.h"), F.col("y.h")) <= most)
    differ = F.col("x.h").bitwiseXOR(F.col("y.h"))
    first = F.coalesce(*[F.when(differ.bitwiseAND(F.lit(m)) == 0, i) for i, m in enumerate(masks)])
    return near.filter(F.col("x.table") == first).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), hamming(F.col("x.h"), F.col("y.h")).alias("bits"))


class Recent:
    """The last size fingerprints; a new one is a duplicate within most bits of any."""

    def __init__(self, most: int = 3, size: int = 1000, held: list[int] | None = None):
        self.most, self.held = most, deque(held or [], maxlen=size)

    def duplicate(self, h: int) -> bool:
        if self.held:
            x = np.fromiter(self.held, np.int64, len(self.held)).view(np.uint64) ^ np.uint64(h & (2**64 - 1))
            if (np.bitwise_count(x) <= self.most).any():
                return True
        self.held.append(h)
        return False


def _fold(hashed: DataFrame, make, extra: str) -> DataFrame:
    """hashed (doc_id, line_no, line, hash) with keep, by a walk over each document's lines in order.

    Lines are sorted by Spark and walked batch by batch; what make() returns for a document is all that is held of it.
    """
    ordered = hashed.repartition("doc_id").sortWithinPartitions("doc_id", "line_no")
    names = ordered.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, judge = object(), None
        for batch in batches:
            keep = []
            for doc, line, h in zip(*(batch.column(names.index(c)).to_pylist() for c in ("doc_id", "line", "hash")), strict=True):
                if doc != now:
                    now, judge = doc, make()
                keep.append(judge(line, h))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keep, pa.bool_())], [*names, extra])

    return ordered.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in ordered.schema), f"{extra} boolean"]))


def window_dedup(lines: DataFrame, most: int = 3, size: int = 1000) -> DataFrame:
    """Lines of each document that are near none of the last size kept ones; blank lines always stay."""

    def judge():
        recent = Recent(most, size)
        return lambda line, h: not line.strip() or not recent.duplicate(h)

    hashed = lines.select("doc_id", "line_no", "line", simhash_udf("line").alias("hash"))
    return _fold(hashed, judge, "keep").filter("keep").select("doc_id", "line_no", "line")


class Near:
    """All fingerprints kept so far, in tables by blocks, so that a new one is compared with those of an equal block only."""

    def __init__(self, most: int = 3):
        n = most + 1
        edges = [64 * i // n for i in range(n + 1)]
        self.most, self.blocks, self.tables = most, [(a, (1 << b - a) - 1) for a, b in zip(edges, edges[1:], strict=False)], [{} for _ in range(n)]

    def duplicate(self, h: int) -> bool:
        """Whether h is within most bits of a kept one; if not, it is kept."""
        h &= 2**64 - 1
        keys = [h >> a & mask for a, mask in self.blocks]
        if any((h ^ x).bit_count() <= self.most for key, table in zip(keys, self.tables, strict=True) for x in table.get(key, ())):
            return True
        for key, table in zip(keys, self.tables, strict=True):
            table.setdefault(key, []).append(h)
        return False


def count_unique(lines: DataFrame, most: int = 3) -> DataFrame:
    """doc_id, n_unique: lines that are farther than most bits from every kept one before.

    Equal fingerprints of a document are collapsed first, so the walk goes over distinct ones in the order of their first line.
    """

    def judge():
        near = Near(most)
        return lambda line, h: not near.duplicate(h)

    hashed = lines.filter(F.btrim("line") != "").select("doc_id", "line_no", simhash_udf("line").alias("hash"))
    first = hashed.groupBy("doc_id", "hash").agg(F.min("line_no").alias("line_no")).withColumn("line", F.lit(""))
    return _fold(first, judge, "keep").filter("keep").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_unique"))
