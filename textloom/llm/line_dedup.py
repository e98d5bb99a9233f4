"""Operator 1: reversible line dedup with sharded cuckoo filters backed by exact reference counts.

A line's key is the line with white space stripped at both ends and A-Z lower-cased, held as a 128-bit digest. The index
is two tables: exact reference counts (how many documents hold a key) and, per shard of the key space, a cuckoo filter
of the shard's keys. Documents can be inserted and deleted again: deltas are aggregated per key first, so that a key
which a third of all documents hold still reaches its shard as one row; a delta key that the shard's filter denies is
new and skips the lookup in the count table, and a key whose count falls to 0 leaves the filter. Shards are sized by
rows, so a shard fits in one task at any corpus size.

Removal: keys found in at least min_docs documents lose their lines everywhere. Keys with more than 1/HEAVY_SHARE of all
postings, or more than SHARD_ROWS of them, are looked up by a join (broadcast while they can be at most BROADCAST_KEYS by
counting, else one whose hot keys Spark splits); the postings of other keys meet their shard, where the filter of removable
keys rejects most and the exact table decides the rest. No key brings more than SHARD_ROWS postings to a shard.

Defined results: null or empty text is one empty line; keys shorter than min_len code points never count; each row is a
document, repeated doc_ids included; extra columns of docs are ignored by the query and kept by dedup_lines(); an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import WS, load, materialize, text_bytes, with_arrow_columns

MIN_LEN, MIN_DOCS = 1, 10
SHARD_ROWS = 65_536
HEAVY_SHARE, BROADCAST_KEYS = 1_000, 500_000
COUNTS = "shard long, h1 long, h2 long, refs long"
FILTERS = "shard long, filter binary, n_keys long"


class CuckooFilter:
    """A cuckoo filter over 64-bit key pairs: 4 slots of 16-bit fingerprints a bucket, batch operations in numpy."""

    SLOTS = 4

    def __init__(self, n_buckets: int, table: np.ndarray | None = None):
        self.n_buckets = n_buckets
        self.table = np.zeros((n_buckets, self.SLOTS), np.uint16) if table is None else table

    @classmethod
    def sized(cls, n_keys: int) -> CuckooFilter:
        return cls(1 << max(1, int(np.ceil(np.log2(max(n_keys, 1) / (cls.SLOTS * 0.8) + 1)))))

    @classmethod
    def of(cls, h1: np.ndarray, h2: np.ndarray) -> CuckooFilter:
        """A filter that holds the keys; grows until every key finds a place."""
        out = cls.sized(len(h1))
        while not out.insert(h1, h2):
            out = cls(out.n_buckets * 2)
        return out

    def to_bytes(self) -> bytes:
        return self.table.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> CuckooFilter:
        table = np.frombuffer(data, np.uint16).reshape(-1, cls.SLOTS).copy()
        return cls(len(table), table)

    def _places(self, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mark = (h1.view(np.uint64) >> np.uint64(48)).astype(np.uint16)
        mark[mark == 0] = 1
        first = (h2.view(np.uint64) % np.uint64(self.n_buckets)).astype(np.int64)
        return mark, first, self._other(first, mark)

    def _other(self, bucket: np.ndarray, mark: np.ndarray) -> np.ndarray:
        return bucket ^ ((mark.astype(np.int64) * 0x5BD1E995) & (self.n_buckets - 1))

    def contains(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        mark, a, b = self._places(h1, h2)
        return ((self.table[a] == mark[:, None]) | (self.table[b] == mark[:, None])).any(axis=1)

    def insert(self, h1: np.ndarray, h2: np.ndarray, rounds: int = 500) -> bool:
        """False if some key found no place; the filter is then to be rebuilt larger."""
        mark, bucket, other = self._places(h1, h2)
        rng = np.random.default_rng(len(h1))
        left = self._settle(mark, bucket)
        mark, bucket = mark[left], other[left]
        for _ in range(rounds):
            left = self._settle(mark, bucket)
            mark, bucket = mark[left], bucket[left]
            if not len(mark):
                return True
            slot = rng.integers(0, self.SLOTS, len(mark))
            _, one = np.unique(bucket, return_index=True)  # one eviction a bucket and round
            out = self.table[bucket[one], slot[one]].copy()
            self.table[bucket[one], slot[one]] = mark[one]
            mark[one] = out
            bucket[one] = self._other(bucket[one], out)
        return False

    def _settle(self, mark: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        """Put marks into free slots of their buckets; the indices of those left over."""
        left = np.arange(len(mark))
        for slot in range(self.SLOTS):
            free = left[self.table[bucket[left], slot] == 0]
            _, one = np.unique(bucket[free], return_index=True)
            put = free[one]
            self.table[bucket[put], slot] = mark[put]
            left = np.setdiff1d(left, put, assume_unique=True)
        return left

    def delete(self, h1: np.ndarray, h2: np.ndarray) -> None:
        """Remove one copy of each key's fingerprint; the keys must be in the filter."""
        for mark, a, b in zip(*self._places(h1, h2), strict=True):
            for bucket in (a, b):
                at = np.flatnonzero(self.table[bucket] == mark)
                if len(at):
                    self.table[bucket, at[0]] = 0
                    break


def line_keys(text: bytes, min_len: int) -> list[bytes | None]:
    """The 128-bit key of each line; None for lines whose key is too short to count."""
    out: list[bytes | None] = []
    for line in text.lower().split(b"\n"):  # bytes.lower() changes A-Z only
        line = line.strip(WS)
        short = len(line) < min_len or (len(line) < 4 * min_len and len(line.decode("utf-8", "replace")) < min_len)
        out.append(None if short else hashlib.blake2b(line, digest_size=16).digest())
    return out


def postings(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", min_len: int = MIN_LEN) -> DataFrame:
    """(doc_id, h1, h2): the distinct line keys of each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, keys = [], []
            for i, text in enumerate(text_bytes(batch.column(1))):
                own = {k for k in line_keys(text, min_len) if k}
                rows += [i] * len(own)
                keys += own
            halves = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(halves[:, 0]), pa.array(halves[:, 1])], ["doc_id", "h1", "h2"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, h1 long, h2 long")


def shard_count(rows: int) -> int:
    return max(1, -(-rows // SHARD_ROWS))


def _shard(n_shards: int):
    return F.pmod(F.col("h1"), F.lit(n_shards))


def key_deltas(posts: DataFrame, n_shards: int, sign: int = 1) -> DataFrame:
    """One row a key: how many documents of posts hold it, times sign."""
    return posts.groupBy("h1", "h2").agg((F.count(F.lit(1)) * sign).alias("refs")).select(_shard(n_shards).alias("shard"), "h1", "h2", "refs")


def build_filters(counts: DataFrame) -> DataFrame:
    """A cuckoo filter for each shard of a count table."""

    def build(part: pd.DataFrame) -> pd.DataFrame:
        made = CuckooFilter.of(part.h1.to_numpy(), part.h2.to_numpy())
        return pd.DataFrame({"shard": part.shard.iloc[:1], "filter": [made.to_bytes()], "n_keys": [len(part)]})

    return counts.groupBy("shard").applyInPandas(build, FILTERS)


class LineIndex:
    """Reference counts and filters of all documents inserted so far and not deleted again."""

    def __init__(self, counts: DataFrame, filters: DataFrame, n_shards: int):
        self.counts, self.filters, self.n_shards = counts, filters, n_shards

    @classmethod
    def empty(cls, spark: SparkSession, n_shards: int = 16) -> LineIndex:
        return cls(spark.createDataFrame([], COUNTS), spark.createDataFrame([], FILTERS), n_shards)

    def insert(self, docs: DataFrame, **columns) -> LineIndex:
        return self._apply(key_deltas(postings(docs, **columns), self.n_shards, 1))

    def delete(self, docs: DataFrame, **columns) -> LineIndex:
        """Take documents out again; they must have been inserted before."""
        return self._apply(key_deltas(postings(docs, **columns), self.n_shards, -1))

    def _apply(self, deltas: DataFrame) -> LineIndex:
        n_shards = self.n_shards
        known = self.filters.select("shard", F.lit(0).cast("long").alias("h1"), F.lit(0).cast("long").alias("h2"), F.lit(0).cast("long").alias("refs"), "filter")
        known = known.unionByName(self.counts.withColumn("filter", F.lit(None).cast("binary")))

        def update(old: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
            held = old[old["filter"].notna()]
            table = old[old["filter"].isna()][["h1", "h2", "refs"]]
            cuckoo = CuckooFilter.from_bytes(held["filter"].iloc[0]) if len(held) else CuckooFilter.sized(len(new))
            maybe = cuckoo.contains(new.h1.to_numpy(), new.h2.to_numpy()) if len(new) else np.zeros(0, bool)
            fresh, seen = new[~maybe][["h1", "h2", "refs"]], new[maybe][["h1", "h2", "refs"]]
            merged = table.merge(seen, on=["h1", "h2"], how="outer", suffixes=("", "_d"), indicator=True)
            merged["refs"] = (merged.refs.fillna(0) + merged.refs_d.fillna(0)).astype("int64")
            added = pd.concat([fresh[fresh.refs > 0], merged[(merged._merge == "right_only") & (merged.refs > 0)][["h1", "h2", "refs"]]])
            gone = merged[(merged._merge == "both") & (merged.refs <= 0)]
            counts = pd.concat([merged[(merged._merge != "right_only") & (merged.refs > 0)][["h1", "h2", "refs"]], added])
            cuckoo.delete(gone.h1.to_numpy(), gone.h2.to_numpy())
            if len(added) and not cuckoo.insert(added.h1.to_numpy(), added.h2.to_numpy()):
                cuckoo = CuckooFilter.of(counts.h1.to_numpy(), counts.h2.to_numpy())
            shard = int((old if len(old) else new).shard.iloc[0])
            head = pd.DataFrame({"h1": [0], "h2": [0], "refs": [len(counts)], "filter": [cuckoo.to_bytes()]})
            return pd.concat([head, counts.assign(filter=None)]).assign(shard=shard)[["shard", "h1", "h2", "refs", "filter"]]

        both = known.groupBy("shard").cogroup(deltas.groupBy("shard")).applyInPandas(update, f"{COUNTS}, filter binary")
        both = materialize(both, "line-index")
        return LineIndex(
            both.filter("filter is null").drop("filter"),
            both.filter("filter is not null").select("shard", "filter", F.col("refs").alias("n_keys")),
            n_shards,
        )


def removable(posts: DataFrame, counts: DataFrame, n_shards: int, min_docs: int = MIN_DOCS) -> DataFrame:
    """The postings (doc_id, h1, h2) whose key at least min_docs documents hold."""
    hot = counts.filter(F.col("refs") >= min_docs)
    total = counts.agg(F.sum("refs")).first()[0] or 0
    bar = min(max(total // HEAVY_SHARE, 1), SHARD_ROWS)
    heavy = hot.filter(F.col("refs") > bar).select("h1", "h2", F.lit(True).alias("heavy"))  # at most total / bar keys, as the refs sum to total
    tested = posts.join(F.broadcast(heavy) if total // bar <= BROADCAST_KEYS else heavy, ["h1", "h2"], "left")
    by_heavy = tested.filter("heavy").select("doc_id", "h1", "h2")
    rest = tested.filter("heavy is null").select(_shard(n_shards).alias("shard"), "doc_id", "h1", "h2")
    few = hot.filter(F.col("refs") <= bar)
    sides = few.select("shard", "h1", "h2", F.lit(None).cast("binary").alias("filter"))
    sides = sides.unionByName(build_filters(few).select("shard", F.lit(0).cast("long").alias("h1"), F.lit(0).cast("long").alias("h2"), "filter"))
    schema = f"doc_id {posts.schema['doc_id'].dataType.simpleString()}, h1 long, h2 long"

    def probe(part: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
        held = index[index["filter"].notna()]
        if not len(part) or not len(held):
            return part.iloc[:0][["doc_id", "h1", "h2"]]
        cuckoo = CuckooFilter.from_bytes(held["filter"].iloc[0])
        maybe = part[cuckoo.contains(part.h1.to_numpy(), part.h2.to_numpy())]
        exact = index[index["filter"].isna()][["h1", "h2"]]
        return maybe.merge(exact, on=["h1", "h2"])[["doc_id", "h1", "h2"]]

    by_shard = rest.groupBy("shard").cogroup(sides.groupBy("shard")).applyInPandas(probe, schema)
    return by_heavy.unionByName(by_shard)


def drop_lines(docs: DataFrame, drops: DataFrame, text_col: str = "text", id_col: str = "doc_id", min_len: int = MIN_LEN) -> DataFrame:
    """docs with kept_text, n_lines and n_dropped (which replace columns of these names); drops holds (doc_id, h1, h2)."""
    docs = docs.drop("kept_text", "n_lines", "n_dropped", "_keys", "_doc_id")
    keys = drops.groupBy("doc_id").agg(F.collect_list(F.struct("h1", "h2")).alias("_keys")).withColumnRenamed("doc_id", "_doc_id")
    found = docs.join(keys, docs[id_col].eqNullSafe(keys["_doc_id"]), "left").drop("_doc_id")

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        kept, n_lines, n_dropped = [], [], []
        for text, keys in zip(text_bytes(batch.column(text_col)), batch.column("_keys").to_pylist(), strict=True):
            lines = text.split(b"\n")
            n_lines.append(len(lines))
            if keys:
                gone = {np.array([k["h1"], k["h2"]], np.int64).tobytes() for k in keys}
                lines = [x for x, k in zip(lines, line_keys(text, min_len), strict=True) if k not in gone]
            n_dropped.append(n_lines[-1] - len(lines))
            kept.append(b"\n".join(lines).decode())
        return [pa.array(kept, pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())]

    return with_arrow_columns(found, make, {"kept_text": "string", "n_lines": "long", "n_dropped": "long"}, drop=("_keys",))


def dedup_lines(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", min_len: int = MIN_LEN, min_docs: int = MIN_DOCS) -> DataFrame:
    """docs with kept_text, n_lines and n_dropped, by an index built over docs itself."""
    posts = materialize(postings(docs, text_col, id_col, min_len), "line-postings")
    n_shards = shard_count(posts.count())
    counts = materialize(key_deltas(posts, n_shards), "line-counts")
    return drop_lines(docs, removable(posts, counts, n_shards, min_docs), text_col, id_col, min_len)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


#: The keys are compared as text here; line breaks are split with an empty line for null.
ORACLE = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines),
hot AS (SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10),
marked AS (SELECT keyed.*, hot.k IS NOT NULL AS gone FROM keyed LEFT JOIN hot ON keyed.k = hot.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
