"""Operator 12: benchmark decontamination as a prefix-filtered set join with exact containment.

Words are lower-cased runs of letters, digits and non-ASCII characters. Each item is cut into windows of WINDOW consecutive
words (an item of fewer words is one window), and a window's set is that of its word shingles (SHINGLE words, or the whole
window where it is shorter). A document contains a window only if it contains every shingle of it, so one shingle, the
prefix of the set in order of rarity, is all that has to be joined:

1. all documents are counted for the items' shingles (a bit table of bounded size stands before the shuffle); a window one of
   whose shingles occurs nowhere is dropped, each other one is filed under its rarest shingle;
2. documents send the places of such shingles with the words around them, as far as a window can reach;
3. places and windows are joined by shingle, cut by length and position (the window must fit between the document's
   bounds), and the item-sized stretch of words is compared as text. Hashes only choose; text decides.

Skew: a shingle of a passage that a third of all documents hold is a large key of one equi join, which Spark splits; windows
that belong to the same items are one class, and documents with the same classes get their list of items once. Nothing of
the items is broadcast but bit tables of at most 2**MAX_BITS bits (32 MB); beyond 8 million shingles they let more places pass,
which the join then rejects.

Defined results: null text or item has no words and no windows; a null item id marks words but is in no list of items; rows
of one item id are one item; every row of docs is a document, repeated and null doc_ids included; other columns are
ignored, and names may clash; without items nothing is hit; an empty table gives an empty result. Windows are told apart by
128-bit digests, classes of windows and documents by two 64-bit sums.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.llm.common import _LOWER, _PLACE, U64, joined, load, materialize, mix64, prefix_hash, slices, span_hash, text_bytes

WINDOW, SHINGLE = 10, 3
MIN_BITS, MAX_BITS, BITS_EACH = 16, 28, 32
BLOCK = 1 << 20

_IS_WORD = np.zeros(256, dtype=bool)
_IS_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


class Words:
    """The words of several texts: 64-bit hashes, the texts' bounds in words, and the words themselves, one blank apart."""

    def __init__(self, texts: list[bytes]):
        buf, offsets = joined(texts)
        buf = _LOWER[buf]
        inside = _IS_WORD[buf]
        edges = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).view(np.int8)))
        starts, ends = edges[0::2], edges[1::2]
        self.bounds = np.searchsorted(starts, offsets)
        self.hashes = np.empty(len(starts), np.uint64)
        i = 0
        while i < len(starts):  # in blocks, as the sums of a long text need eight bytes a byte
            j = max(i + 1, int(np.searchsorted(ends, starts[i] + BLOCK)))
            self.hashes[i:j] = span_hash(prefix_hash(buf[starts[i] : ends[j - 1]]), starts[i:j] - starts[i], ends[i:j] - starts[i])
            i = j
        buf[~inside] = 32
        inside[ends] = True  # a text ends with a newline in joined(), so there is a byte after each word
        self.plain = buf[inside]
        self.at = np.concatenate([[0], np.cumsum(ends - starts + 1)])

    def text(self, first: int, last: int) -> bytes:
        """Words first to last - 1."""
        return self.plain[self.at[first] : self.at[last] - 1].tobytes()

    def shingles(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the runs of width words that lie within one text, and the place of each run's first word."""
        n = len(self.hashes) - width + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        total = np.full(n, width * 0x9FB21C651E98DF25 & (1 << 64) - 1, np.uint64)
        for k in range(width):
            total += self.hashes[k : k + n] * _PLACE[k]
        place = np.arange(n)
        ends = self.bounds[np.searchsorted(self.bounds, place, side="right")]
        whole = place + width <= ends
        return mix64(total[whole]), place[whole]


class BitTable:
    """Two bits a hash; says no for nearly all hashes that were not put in."""

    def __init__(self, bits: int, words: np.ndarray):
        self.bits, self.words = bits, words

    @staticmethod
    def size(n: int) -> int:
        return min(MAX_BITS, max(MIN_BITS, (n * BITS_EACH - 1).bit_length()))

    @classmethod
    def of(cls, tokens: DataFrame, n: int) -> BitTable:
        """tokens has a column t; the table is put together from one row for each of its 64-bit words that has a bit."""
        bits = cls.size(n)
        mask = (1 << bits) - 1
        slot = F.explode(F.array(F.col("t").bitwiseAND(F.lit(mask)), F.shiftrightunsigned("t", 64 - bits)))
        rows = tokens.select(slot.alias("slot")).groupBy(F.shiftright("slot", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(slot & 63 AS INT))")).alias("v")).toArrow()
        words = np.zeros(1 << bits - 6, np.uint64)
        words[rows["w"].to_numpy()] = rows["v"].to_numpy().view(np.uint64)
        return cls(bits, words)

    def contains(self, hashes: np.ndarray) -> np.ndarray:
        out = np.zeros(len(hashes), bool)
        low = hashes & U64((1 << self.bits) - 1)
        some = np.flatnonzero(self.words[low >> U64(6)] >> (low & U64(63)) & U64(1))
        high = hashes[some] >> U64(64 - self.bits)
        out[some] = (self.words[high >> U64(6)] >> (high & U64(63)) & U64(1)).astype(bool)
        return out


def windows(items: DataFrame, item_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(item, w1, w2, n, words): the distinct windows of each row of items."""

    def run(batches):
        for batch in batches:
            rows, keys, sizes, texts = [], [], [], []
            for i, text in enumerate(text_bytes(batch.column(1))):
                found = Words([text])
                n = len(found.hashes)
                size = min(n, window)
                for words in {found.text(k, k + size) for k in range(n - size + 1)} if n else ():
                    rows.append(i)
                    keys.append(hashlib.blake2b(words, digest_size=16).digest())
                    sizes.append(size)
                    texts.append(words.decode())
            halves = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.array(sizes, pa.int32()), pa.array(texts, pa.string())], ["item", "w1", "w2", "n", "words"])

    chosen = items.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text"))
    return chosen.mapInArrow(run, "item string, w1 long, w2 long, n int, words string")


def window_tokens(distinct: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(w1, w2, o, t): the shingles of each window and where they lie in it."""

    def run(batches):
        for batch in batches:
            sizes = batch.column(2).to_numpy()
            found = Words(text_bytes(batch.column(3)))
            rows, places, hashes = [], [], []
            for width in range(1, shingle + 1):
                t, at = found.shingles(width)
                row = np.searchsorted(found.bounds, at, side="right") - 1
                own = np.minimum(sizes[row], shingle) == width
                rows.append(row[own])
                places.append((at - found.bounds[row])[own])
                hashes.append(t[own])
            row = pa.array(np.concatenate(rows))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(1).take(row), pa.array(np.concatenate(places).astype(np.int32)), pa.array(np.concatenate(hashes).view(np.int64))], ["w1", "w2", "o", "t"])

    return distinct.select("w1", "w2", "n", "words").mapInArrow(run, "w1 long, w2 long, o int, t long")


def count_tokens(docs: DataFrame, table: BitTable, widths: list[int], text_col: str = "text") -> DataFrame:
    """(t, n): how often the shingles that the table lets pass occur in all of docs."""
    shared = docs.sparkSession.sparkContext.broadcast((table.bits, table.words))

    def run(batches):
        known = BitTable(*shared.value)
        for batch in batches:
            texts, passed = text_bytes(batch.column(0)), []
            for i, j in slices(texts):
                found = Words(texts[i:j])
                for width in widths:
                    t, _ = found.shingles(width)
                    passed.append(t[known.contains(t)])
            t, n = np.unique(np.concatenate([*passed, np.zeros(0, np.uint64)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(t.view(np.int64)), pa.array(n)], ["t", "n"])

    return docs.select(text_col).mapInArrow(run, "t long, n long").groupBy("t").agg(F.sum("n").alias("n"))


PLACES = pa.list_(pa.struct([("t", pa.int64()), ("p", pa.int32()), ("b", pa.int32()), ("size", pa.int32()), ("words", pa.string())]))


def places(docs: DataFrame, table: BitTable | None, widths: list[int], id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """(row_id, doc_id, n_words, places): for each row of docs the shingles that the table lets pass.

    A place has the shingle t, its position p, the words around it, how many of them (size), and how many before it (b).
    """
    shared = docs.sparkSession.sparkContext.broadcast(table and (table.bits, table.words))

    def run(batches):
        known, row = shared.value and BitTable(*shared.value), TaskContext.get().partitionId() << 33
        for batch in batches:
            texts, out, sizes = text_bytes(batch.column(1)), [], []
            for i, j in slices(texts):
                found = Words(texts[i:j])
                own = [[] for _ in range(i, j)]
                for width in widths if known else ():
                    t, at = found.shingles(width)
                    hit = np.flatnonzero(known.contains(t))
                    reach = window - width if width == shingle else 0
                    text = np.searchsorted(found.bounds, at[hit], side="right") - 1
                    first = np.maximum(found.bounds[text], at[hit] - reach)
                    last = np.minimum(found.bounds[text + 1], at[hit] + width + reach)
                    for k, p, key, a, z in zip(text.tolist(), at[hit].tolist(), t[hit].view(np.int64).tolist(), first.tolist(), last.tolist(), strict=True):
                        own[k].append({"t": key, "p": p - int(found.bounds[k]), "b": p - a, "size": z - a, "words": found.text(a, z).decode()})
                out += own
                sizes += np.diff(found.bounds).tolist()
            rows = pa.array(np.arange(row, row + len(texts)))
            row += len(texts)
            yield pa.RecordBatch.from_arrays([rows, batch.column(0), pa.array(sizes, pa.int64()), pa.array(out, PLACES)], ["row_id", "doc_id", "n_words", "places"])

    kind = docs.schema[id_col].dataType.simpleString()
    shape = "array<struct<t:bigint,p:int,b:int,size:int,words:string>>"
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"row_id long, doc_id {kind}, n_words long, places {shape}")


def matches(placed: DataFrame, needles: DataFrame) -> DataFrame:
    """(row_id, w1, w2, p, n): the occurrences of windows; needles holds (t, o, n, words, w1, w2)."""
    sent = placed.select("row_id", F.explode("places").alias("x")).select("row_id", "x.*").withColumnRenamed("words", "around")
    fits = (F.col("o") <= F.col("b")) & (F.col("n") - F.col("o") <= F.col("size") - F.col("b"))
    same = F.array_join(F.slice(F.split("around", " "), F.col("b") - F.col("o") + 1, F.col("n")), " ") == F.col("words")
    return sent.join(needles, "t").filter(fits).filter(same).select("row_id", "w1", "w2", (F.col("p") - F.col("o")).alias("p"), "n")


def hit_spans(found: DataFrame) -> DataFrame:
    """(row_id, spans): the maximal runs [first, last) of words that occurrences cover."""
    order = Window.partitionBy("row_id").orderBy("p", "n")
    before = F.max(F.col("p") + F.col("n")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(before >= F.col("p"), 0).otherwise(1)
    runs = found.select("row_id", "p", "n").distinct().withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(order))
    runs = runs.groupBy("row_id", "run").agg(F.struct(F.min("p").alias("first"), F.max(F.col("p") + F.col("n")).alias("last")).alias("span"))
    return runs.groupBy("row_id").agg(F.sort_array(F.collect_list("span")).alias("spans"))


def _sums(*columns: str) -> tuple[Column, Column]:
    """A set's two 64-bit sums (exclusive or) of the hashes of its distinct rows."""
    return F.bit_xor(F.xxhash64(*columns)), F.bit_xor(F.xxhash64(F.lit("second"), *columns))


def hit_items(found: DataFrame, held: DataFrame) -> DataFrame:
    """(row_id, items): the sorted ids of the items whose windows occur; held holds (item, w1, w2)."""
    by_row = materialize(found.select("row_id", "w1", "w2").distinct(), "row-windows")
    near = held.select("item", "w1", "w2").filter("item is not null").join(by_row.select("w1", "w2").distinct(), ["w1", "w2"])
    near = materialize(near.distinct(), "window-items")
    one, two = _sums("item")
    classes = near.groupBy("w1", "w2").agg(one.alias("c1"), two.alias("c2"))
    members = near.join(classes, ["w1", "w2"]).select("c1", "c2", "item").distinct()
    rows = by_row.join(classes, ["w1", "w2"]).select("row_id", "c1", "c2").distinct()
    one, two = _sums("c1", "c2")
    signed = rows.groupBy("row_id").agg(one.alias("s1"), two.alias("s2"))
    first = signed.groupBy("s1", "s2").agg(F.min("row_id").alias("row_id"))
    listed = first.join(rows, "row_id").join(members, ["c1", "c2"]).groupBy("s1", "s2").agg(F.array_sort(F.collect_set("item")).alias("items"))
    return signed.join(listed, ["s1", "s2"]).select("row_id", "items")


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, spans, items) for each row of docs: hit words as runs [first, last), and the sorted item ids."""
    held = materialize(windows(items, item_col, item_text_col, window), "windows")
    distinct = held.dropDuplicates(["w1", "w2"]).select("w1", "w2", "n", "words")
    tokens = materialize(window_tokens(distinct), "window-tokens")
    widths = sorted(r[0] for r in distinct.select(F.least("n", F.lit(SHINGLE))).distinct().collect())
    table, needles = None, tokens.select("t", "o", F.lit(0).alias("n"), F.lit("").alias("words"), "w1", "w2")
    if widths:
        counts = count_tokens(docs, BitTable.of(tokens.select("t").distinct(), tokens.count()), widths, text_col)
        ranked = tokens.join(counts, "t", "left").groupBy("w1", "w2").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("seen"), "t", "o")).alias("x"))
        needles = ranked.filter("x.seen > 0").select("w1", "w2", "x.t", "x.o").join(distinct, ["w1", "w2"])
        needles = materialize(needles.select("t", "o", "n", "words", "w1", "w2"), "needles")
        widths = sorted(r[0] for r in needles.select(F.least("n", F.lit(SHINGLE))).distinct().collect())
        table = BitTable.of(needles.select("t").distinct(), needles.count()) if widths else None
    placed = materialize(places(docs, table, widths, id_col, text_col, window), "places")
    found = materialize(matches(placed, needles), "matches")
    rows = placed.select("row_id", "doc_id", "n_words").join(hit_spans(found), "row_id", "left").join(hit_items(found, held), "row_id", "left")
    none = F.array().cast
    return rows.select("doc_id", "n_words", F.coalesce("spans", none("array<struct<first:int,last:int>>")).alias("spans"), F.coalesce("items", none("array<string>")).alias("items"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(load(spark, sf_dir, "documents").select("doc_id", "text"), load(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


#: All windows of all documents meet all windows of all items as texts here.
ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w
  FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w
  FROM benchmark),
needles AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS x
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM needles),
stretches AS (
  SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS x
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
found AS (SELECT r, i, needles.n, item_id FROM stretches JOIN needles ON needles.x = stretches.x AND needles.n = stretches.n),
covered AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT r, i, n FROM found)) GROUP BY r),
listed AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT r, item_id::VARCHAR AS item FROM found WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (r) LEFT JOIN listed USING (r)
"""
