"""Helpers shared by the operators: shared storage, table loading, text hashing."""

from __future__ import annotations

import ctypes
import os
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words and is stripped from lines: space and \t \n \v \f \r.
WS = b" \t\n\x0b\x0c\r"
U64 = np.uint64


#: Bytes of an Arrow batch that a Python worker holds at once; a larger setting of the session is lowered to it.
BATCH_BYTES = 8 << 20


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a local session without one gets a temporary folder, a cluster an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="textloom-shared-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release() -> None:
    """Give memory that earlier tasks of this Python worker have freed back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each string of an Arrow column; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary()).to_pylist()]


def total_bytes(docs: DataFrame, text_col: str = "text") -> tuple[int, int]:
    """Rows and UTF-8 bytes of the text column."""
    row = docs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(text_col)).alias("b")).first()
    return row["n"], row["b"] or 0


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, elementwise on uint64."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * U64(0x9E3779B97F4A7C15))
_POW = {"up": np.ones(1, dtype=np.uint64), "down": np.ones(1, dtype=np.uint64)}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POW["up"]) < n:
        size = max(n, 1 << 16)
        for key, base in (("up", _BASE), ("down", _INVERSE)):
            step = np.full(size, base, dtype=np.uint64)
            step[0] = 1
            _POW[key] = np.multiply.accumulate(step)
    return _POW["up"][:n], _POW["down"][:n]


def prefix_hash(buf: np.ndarray) -> np.ndarray:
    """Prefix sums of byte codes times powers of a fixed base (modulo 2**64); see span_hash()."""
    up, _ = _powers(len(buf) + 1)
    out = np.zeros(len(buf) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[buf] * up[:-1], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of buf[start:end] for many spans at once, equal for equal bytes wherever they lie."""
    _, down = _powers(len(prefix))
    return mix64((prefix[end] - prefix[start]) * down[start] + (end - start).astype(np.uint64) * U64(0xD6E8FEB86659FD93))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[list(WS)] = True


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """One byte buffer of all texts, a newline after each, and the offset at which each begins (one more at the end)."""
    sizes = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
    return np.frombuffer(b"\n".join([*texts, b""]), dtype=np.uint8), np.concatenate([[0], np.cumsum(sizes)])


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, A-Z lower-cased, and the word offset at which each text begins."""
    buf, offsets = joined(texts)
    if not len(buf):
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    buf = _LOWER[buf]
    inside = ~_IS_SPACE[buf]
    edges = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).view(np.int8)))
    starts, ends = edges[0::2], edges[1::2]
    return span_hash(prefix_hash(buf), starts, ends), np.searchsorted(starts, offsets)


_PLACE = mix64(np.arange(1, 65, dtype=np.uint64) * U64(0xA0761D6478BD642F)) | U64(1)


def shingle_sets(texts: list[bytes], width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct word shingles of each text as sorted 64-bit hashes, concatenated, and the offset of each text.

    A text with fewer words than width has its whole word sequence as one shingle; a text without words has none.
    """
    words, offsets = word_hashes(texts)
    counts = np.diff(offsets)
    n_shingles = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    doc = np.repeat(np.arange(len(texts)), n_shingles)
    first = np.repeat(offsets[:-1], n_shingles) + (np.arange(len(doc)) - np.repeat(np.cumsum(n_shingles) - n_shingles, n_shingles))
    length = np.minimum(np.repeat(counts, n_shingles), width)
    hashed = length.astype(np.uint64) * U64(0xE7037ED1A0B428DB)
    for k in range(width):
        here = length > k
        hashed[here] += words[first[here] + k] * _PLACE[k]
    hashed = mix64(hashed)
    order = np.lexsort((hashed, doc))
    doc, hashed = doc[order], hashed[order]
    keep = np.ones(len(doc), dtype=bool)
    keep[1:] = (doc[1:] != doc[:-1]) | (hashed[1:] != hashed[:-1])
    return hashed[keep], np.searchsorted(doc[keep], np.arange(len(texts) + 1))


def slices(texts: list[bytes], limit: int = 1 << 20):
    """Index ranges whose texts together hold about limit bytes, so that numpy scratch space stays bounded."""
    begin, size = 0, 0
    for i, t in enumerate(texts):
        if i > begin and size + len(t) > limit:
            yield begin, i
            begin, size = i, 0
        size += len(t)
    if begin < len(texts):
        yield begin, len(texts)


def with_arrow_columns(df: DataFrame, make, made: dict[str, str], drop: tuple[str, ...] = ()) -> DataFrame:
    """df and the columns made (name: type) that make(batch) returns as Arrow arrays; columns of these names are replaced.

    drop: columns that make() needs and the result leaves out.
    """
    df = df.drop(*made)
    kept = [f for f in df.schema if f.name not in drop]
    places = [i for i, f in enumerate(df.schema) if f.name not in drop]
    names = [*(f.name for f in kept), *made]

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in places), *make(batch)], names)

    return df.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), *(f"`{k}` {v}" for k, v in made.items())]))
