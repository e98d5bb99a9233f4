"""Operator 6: exact n-gram Jaccard join with PartEnum signatures.

Sets of five-word shingles with Jaccard similarity of at least 0.8 have similar sizes, so sizes are cut into bands and
each set takes part in the instances of its own band and the next. Within an instance the symmetric difference of a
similar pair has at most k = 2 * largest size / 9 elements. The shingle domain is hashed into partitions:

* k >= 4: into n > k / 2 partitions of three parts each; at least n - k / 2 partitions of a similar pair differ in one
  element at most, so two of their parts agree: each two parts of a partition are a signature. Signatures of few elements,
  or of common ones only (passages that many documents share), say little: each set leaves out those below the largest bar
  that fewer than n - k / 2 of its partitions fall short of. As equal signatures have equally many elements, rare or not,
  one that both sets keep remains, whatever counts as common.
* k <= 3: into k + 3 partitions; a similar pair agrees on three of them at least, so every subset of three is a signature.
* k = 0: similar sets are equal and meet as copies below.

A signature without any element is emitted crossed with the set's signatures under another hash seed, which a similar
pair shares as well, so that short documents do not meet in one group.

Sets that are equal are collapsed first (128-bit digests). Only connected components are wanted, so the join runs twice:

1. Under the SEEDS smallest of their signatures sets meet the smallest set that shares one. What is linked there, most of
   each family of near copies, has a label from then on.
2. Under all signatures labels meet: blocks hold one set of each label for a signature, so a family that a third of all
   documents belong to sends one row a batch. A signature with one label says nothing new; of up to SMALL labels each two
   pair up by these sets; more labels pair up with a label of several sets, and the others form the open group of that
   label; where all sets are alone, they form an open group.
3. Labels that met without a link are compared set by set in tiles of TILE x TILE, by sizes and parity sketches: at first
   the NEAREST for each set, then, where a set had more, all that are left in different components.

All pairs are verified on the sets (64-bit hashes of their shingles); links lead to components. No similar pair of
different components is left out.

Defined results: A-Z is lower-cased, words are separated by space and \\t \\n \\v \\f \\r; null, empty and blank texts have
an empty set and link with nothing; fewer than five words are one shingle; repeated rows are copies. Rows are told apart by
a 64-bit key of id and text, so ids may be null, repeated with other texts, or of any type that hashes; component_id is the
smallest id of the component, null if all of its ids are.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import load, materialize, mix64, release, shingle_sets, slices, text_bytes, total_bytes, with_arrow_columns
from textloom.llm.components import components

WIDTH = 5
SEEDS, SMALL, NEAREST, TILE = 12, 8, 16, 4096
SKETCH = 1024
SALTS = 16
BUCKET_BYTES = 8 << 20
#: Shingles in this share of the sets count as common, told by SLOTS counters; groups of more labels are merged across buckets.
COMMON_SHARE, SLOTS, LARGE = 0.002, 1 << 20, 64
TILE_ROWS = 16_384
BROADCAST_IDS = 500_000
U64 = np.uint64


def _bands() -> np.ndarray:
    low, out = 1, []
    while low < 1 << 40:
        out.append(low)
        low = low * 5 // 4 + 1
    return np.array(out)


#: Smallest size of each band: sets of similarity 0.8 lie in the same band or in neighbouring ones.
LOW = _bands()


def _shape(instance: int) -> tuple[int, int]:
    """(k, partitions) of an instance, which joins the bands instance - 1 and instance."""
    largest = int(LOW[instance]) * 5 // 4
    k = 2 * largest // 9
    return k, (k + 3 if k <= 3 else -(-(k // 2 + 1) * 5 // 4) + 1)


def _slot(hashes: np.ndarray) -> np.ndarray:
    return (mix64(hashes ^ U64(0x6A09E667F3BCC909)) >> U64(44)).astype(np.int64)


def _one_instance(hashes: np.ndarray, offsets: np.ndarray, instance: int, seed: int, common: np.ndarray | None):
    """Signatures of some sets in an instance: (set, signature) without elements apart: (set, signature), (set, empty signature)."""
    k, n = _shape(instance)
    sizes = np.diff(offsets)
    if not k:
        none = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        return none, none
    owner = np.repeat(np.arange(len(sizes)), sizes)
    salt = mix64(np.array([seed * 1_000_003 + instance + 1], np.uint64))[0]
    slots = n if k <= 3 else 3 * n
    slot = owner * slots + ((mix64(hashes ^ salt) >> U64(32)) * U64(slots) >> U64(32)).astype(np.int64)
    content = np.zeros(len(sizes) * slots, np.uint64)
    np.add.at(content, slot, mix64(hashes + salt))
    filled = np.bincount(slot, minlength=len(content)).reshape(-1, slots)
    content = content.reshape(-1, slots)
    if k <= 3:
        subsets = list(combinations(range(n), n - k))
        signs = np.stack([mix64(content[:, s].sum(axis=1, dtype=np.uint64) ^ mix64(np.array([i * 8191 + 5], np.uint64) + salt)) for i, s in enumerate(subsets)], axis=1)
        some = np.stack([filled[:, s].any(axis=1) for s in subsets], axis=1)
        needed = ~some
    else:
        pair = lambda x: np.stack([x[:, i::3] + x[:, j::3] for i, j in ((0, 1), (0, 2), (1, 2))], axis=2).reshape(len(sizes), slots)
        signs = mix64(pair(content) ^ mix64(np.arange(slots, dtype=np.uint64) * U64(8191) + salt))
        held = pair(filled)
        if common is not None:
            rare = np.bincount(slot[~common[_slot(hashes)]], minlength=content.size).reshape(-1, slots)
            held = held + (pair(rare) << 32)
        # the sets' poorest signatures go: fewer than n - k / 2 partitions may have one below the bar
        agree = n - k // 2
        bar = np.partition(held.reshape(len(sizes), n, 3).min(axis=2), agree - 1, axis=1)[:, agree - 1]
        some = held >= np.maximum(bar, 1)[:, None]  # rare elements count first
        needed = (held == 0) & (bar == 0)[:, None]
    a, b = np.nonzero(some), np.nonzero(needed)
    return (a[0], signs[a]), (b[0], signs[b])


def signatures(hashes: np.ndarray, offsets: np.ndarray, common: np.ndarray | None = None, seed: int = 0, depth: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """(set, 64-bit signature) rows of the sets hashes[offsets[i]:offsets[i + 1]]; common: by slot, whether shingles are."""
    sizes = np.diff(offsets)
    band = np.searchsorted(LOW, sizes, side="right") - 1
    sets, signs, bare_sets, bare_signs = [], [], [], []
    for b in np.unique(band[sizes > 0]):
        mine = np.flatnonzero((band == b) & (sizes > 0))
        at = np.concatenate([[0], np.cumsum(sizes[mine])])
        elements = hashes[np.repeat(offsets[mine] - at[:-1], sizes[mine]) + np.arange(at[-1])]
        for instance in (int(b), int(b) + 1):
            (s, v), (es, ev) = _one_instance(elements, at, instance, seed, common)
            sets.append(mine[s])
            signs.append(v)
            bare_sets.append(mine[es])
            bare_signs.append(ev)
    if not sets:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    es, ev = np.concatenate(bare_sets), np.concatenate(bare_signs)
    if len(es) and depth:
        few = np.unique(es)
        at = np.concatenate([[0], np.cumsum(sizes[few])])
        elements = hashes[np.repeat(offsets[few] - at[:-1], sizes[few]) + np.arange(at[-1])]
        s2, v2 = signatures(elements, at, common, seed + 1, depth - 1)
        order = np.argsort(s2, kind="stable")
        s2, v2 = s2[order], v2[order]
        cuts = np.searchsorted(s2, np.arange(len(few) + 1))
        for s, v in zip(es, ev, strict=True):
            i = np.searchsorted(few, s)
            crossed = mix64(v2[cuts[i] : cuts[i + 1]] ^ v)
            sets.append(np.full(len(crossed), s))
            signs.append(crossed)
    elif len(es):
        sets.append(es)
        signs.append(ev)
    return np.concatenate(sets), np.concatenate(signs)


def _digests(hashes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit digests of each set."""
    out = []
    for add in (0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179):
        upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(hashes + U64(add)), dtype=np.uint64)])
        out.append(mix64(upto[offsets[1:]] - upto[offsets[:-1]]))
    return out[0], out[1]


def _sketches(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The parity of each set's elements in SKETCH bins: the bins in which two sketches differ bound their symmetric difference below."""
    n = len(offsets) - 1
    slot = np.repeat(np.arange(n), np.diff(offsets)) * SKETCH + (mix64(hashes + U64(0x2545F4914F6CDD1D)) % U64(SKETCH)).astype(np.int64)
    odd = (np.bincount(slot, minlength=n * SKETCH) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little")


def _seeds(hashes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The SEEDS smallest signatures of each set (fewer if it has fewer) and the offset of each set."""
    own, sign = signatures(hashes, offsets)
    order = np.lexsort((sign, own))
    own, sign = own[order], sign[order]
    at = np.searchsorted(own, np.arange(len(offsets)))
    low = np.arange(len(own)) - at[own] < SEEDS
    return sign[low], np.searchsorted(own[low], np.arange(len(offsets)))


def _subset(hashes: np.ndarray, offsets: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.diff(offsets)[which]
    at = np.concatenate([[0], np.cumsum(sizes)])
    return hashes[np.repeat(offsets[which] - at[:-1], sizes) + np.arange(at[-1])], at


def row_key(text_col: str = "text", id_col: str = "doc_id") -> Column:
    """A key that is never null: equal where id and text are."""
    return F.xxhash64(F.col(id_col).isNull(), id_col, text_col)


def set_digests(docs: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """(doc_id, key, n_shingles, d1, d2, sketch, seeds, common) of every row; common, at the first row of a batch, holds
    slot << 32 | sets for the slots of shingles that many sets of the batch have."""

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        release()
        n, one, two, sketch, seeds, many = [], [], [], [], [], []
        seen = np.zeros(SLOTS, np.int64)
        texts = text_bytes(batch.column("text"))
        for a, b in slices(texts):
            hashes, offsets = shingle_sets(texts[a:b], WIDTH)
            d1, d2 = _digests(hashes, offsets)
            n.append(np.diff(offsets))
            one.append(d1.view(np.int64))
            two.append(d2.view(np.int64))
            _, first, again = np.unique(np.stack([d1, d2], axis=1), axis=0, return_index=True, return_inverse=True)
            again = again.reshape(-1)
            hashes, offsets = _subset(hashes, offsets, first)
            seen += np.bincount(_slot(hashes), minlength=SLOTS)
            sketch.append(_sketches(hashes, offsets).reshape(-1, SKETCH // 8)[again].reshape(-1))
            values, at = _subset(*_seeds(hashes, offsets), again)
            seeds.append(values.view(np.int64))
            many.append(np.diff(at))
        cat = lambda x, kind=np.int64: np.concatenate(x) if x else np.zeros(0, kind)
        held = pa.FixedSizeBinaryArray.from_buffers(pa.binary(SKETCH // 8), len(texts), [None, pa.py_buffer(cat(sketch, np.uint8).tobytes())]).cast(pa.binary())
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(cat(many))]), pa.int32()), pa.array(cat(seeds), pa.int64()))
        often = np.flatnonzero(seen >= max(4 + 4 * seen.mean(), COMMON_SHARE * len(texts)))
        common = [(often << 32 | seen[often]).tolist(), *[None] * (len(texts) - 1)] if texts else []
        return [*(pa.array(cat(x), pa.int64()) for x in (n, one, two)), held, lists, pa.array(common, pa.list_(pa.int64()))]

    rows = docs.select(F.col(id_col).alias("doc_id"), row_key(text_col, id_col).alias("key"), F.col(text_col).alias("text"))
    return with_arrow_columns(rows, make, {"n_shingles": "long", "d1": "long", "d2": "long", "sketch": "binary", "seeds": "array<long>", "common": "array<long>"}, drop=("text",))


def _common(sets: DataFrame, n: int) -> np.ndarray:
    """By slot, of n different sets, whether its shingles are in COMMON_SHARE of the sets; at most 1 / COMMON_SHARE slots a shingle of a set reach the driver.

    This decides which signatures are left out, not which pairs are found."""
    counts = sets.select(F.explode("common").alias("c")).groupBy(F.shiftright("c", 32).alias("slot")).agg(F.sum(F.col("c").bitwiseAND(F.lit((1 << 32) - 1))).alias("n"))
    out = np.zeros(SLOTS, bool)
    out[[r.slot for r in counts.filter(F.col("n") >= COMMON_SHARE * n).select("slot").collect()]] = True
    return out


def _blocks(rows: DataFrame, n_buckets: int, common: np.ndarray) -> DataFrame:
    """(bucket, block): the signatures of an Arrow batch of (key, label, text) that fall into a bucket, one set for each label.

    label is null for sets that are alone."""
    bits = np.packbits(common).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = np.unpackbits(np.frombuffer(bits, np.uint8)).astype(bool)
        for batch in batches:
            release()
            keys, texts = batch.column(0).to_numpy(), text_bytes(batch.column(2))
            alone = batch.column(1).is_null().to_numpy(zero_copy_only=False)
            labels = np.where(alone, keys, batch.column(1).fill_null(0).to_numpy())
            for a, b in slices(texts):
                hashes, offsets = shingle_sets(texts[a:b], WIDTH)
                own, sign = signatures(hashes, offsets, common)
                id_, label, single = keys[a:b], labels[a:b], alone[a:b]
                order = np.lexsort((own, label[own], sign))
                own, sign = own[order], sign[order]
                fresh = np.ones(len(own), bool)
                fresh[1:] = (sign[1:] != sign[:-1]) | (label[own[1:]] != label[own[:-1]])
                own, sign = own[fresh], sign[fresh]
                bucket = (sign >> U64(32)) % U64(n_buckets)
                order = np.lexsort((own, single[own], bucket))  # sets with a label first
                own, sign, bucket = own[order], sign[order].astype(np.uint32), bucket[order]
                names, first = np.unique(bucket, return_index=True)
                blocks = []
                for lo, hi in zip(first, np.append(first, len(own))[1:], strict=True):
                    part = own[lo:hi]
                    starts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
                    here, runs = part[starts], np.diff(np.append(starts, len(part)))
                    named = label[here][~single[here]]
                    head = np.array([len(here), len(named)], np.int64).tobytes()
                    blocks.append(head + id_[here].tobytes() + named.tobytes() + runs.astype(np.int32).tobytes() + sign[lo:hi].tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(names.astype(np.int64)), pa.array(blocks, pa.binary())], ["bucket", "block"])

    return rows.select("key", "label", "text").mapInArrow(run, "bucket long, block binary")


def _unpack(block: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(set, label, whether it is alone, signature) rows of a block."""
    n, m = np.frombuffer(block, np.int64, 2).tolist()
    ids = np.frombuffer(block, np.int64, n, 16)
    labels = np.concatenate([np.frombuffer(block, np.int64, m, 16 + 8 * n), ids[m:]])
    at = 16 + 8 * (n + m)
    runs = np.frombuffer(block, np.int32, n, at)
    return np.repeat(ids, runs), np.repeat(labels, runs), np.repeat(np.arange(n) >= m, runs), np.frombuffer(block, np.uint32, -1, at + 4 * n)


def _merge(groups: list[np.ndarray]) -> list[np.ndarray]:
    """Fewer groups of which each given one is part: a group joins an earlier one that holds most of it, if that grows little."""
    merged: list[list[np.ndarray]] = []
    size: list[int] = []
    most: list[int] = []
    home: dict[int, int] = {}
    for own in sorted(groups, key=len, reverse=True):
        seen = np.array([home.get(i, -1) for i in own.tolist()])
        known = seen[seen >= 0]
        if len(known):
            at = int(np.bincount(known).argmax())
            fresh = own[seen != at]
            if 2 * len(fresh) <= len(own) and size[at] + len(fresh) <= most[at]:
                merged[at].append(fresh)
                size[at] += len(fresh)
                home |= dict.fromkeys(fresh.tolist(), at)
                continue
        home |= dict.fromkeys(own.tolist(), len(merged))
        merged.append([own])
        size.append(len(own))
        most.append(2 * len(own))
    return [np.unique(np.concatenate(m)) for m in merged]


MET = "a long, b long, la long, lb long, hot long, open boolean"


def _meet(table: pa.Table, small: int) -> pa.Table:
    """Of one bucket: pairs of sets a and b of the labels la and lb, and the labels la of open groups (hot).

    open: whether one of the labels may have other sets than these; null for the rows of open groups."""
    release()
    if not table.num_rows:
        return pa.table([*[pa.array([], pa.int64())] * 5, pa.array([], pa.bool_())], ["a", "b", "la", "lb", "hot", "open"])
    parts = [_unpack(x) for x in table.column("block").to_pylist()]
    rows = [np.concatenate([p[i] for p in parts]) for i in range(4)]
    pick = lambda which: [x[which] for x in rows]
    rows = pick(np.argsort(rows[3], kind="stable"))
    # most signatures are alone: drop them before the exact order
    many = np.zeros(len(rows[3]), bool)
    many[1:] = rows[3][1:] == rows[3][:-1]
    many[:-1] |= many[1:]
    rows = pick(many)
    rows = pick(np.lexsort((rows[0], rows[1], rows[3])))
    keep = np.ones(len(rows[0]), bool)
    keep[1:] = (rows[3][1:] != rows[3][:-1]) | (rows[1][1:] != rows[1][:-1])
    ids, labels, single, sign = pick(keep)
    first = np.flatnonzero(np.concatenate([[True], sign[1:] != sign[:-1]])) if len(sign) else np.zeros(0, np.int64)
    size = np.diff(np.concatenate([first, [len(ids)]]))
    first, size = first[size > 1], size[size > 1]
    left, right = [], []
    for m in range(2, small + 1):
        at = first[size == m]
        for i, j in combinations(range(m), 2):
            left.append(at + i)
            right.append(at + j)
    large: dict[bytes, np.ndarray] = {}
    around: dict[int, list[np.ndarray]] = {}
    for at, m in zip(first[size > small], size[size > small], strict=True):
        own, named = np.arange(at, at + m), np.flatnonzero(~single[at : at + m])
        centre = at + (named[mix64(labels[at + named].view(np.uint64)).argmin()] if len(named) else 0)
        left.append(np.full(m - 1, centre))
        right.append(own[own != centre])
        if len(named):
            around.setdefault(int(labels[centre]), []).append(labels[right[-1]])
        else:
            large.setdefault(labels[own].tobytes(), labels[own])
    # open groups of unlabelled sets that are large go by the one with the smallest hash, so that those of different buckets are one
    groups = {label: np.unique(np.concatenate(x)) for label, x in around.items()}
    for n, g in enumerate(_merge(list(large.values()))):
        groups[~int(mix64(g.view(np.uint64)).min() >> U64(1)) if len(g) > LARGE else int(table.column("bucket")[0].as_py()) << 32 | n] = g
    cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    a, b = cat(left), cat(right)
    pairs = np.unique(np.stack([ids[a], ids[b], labels[a], labels[b], ~(single[a] & single[b])], axis=1), axis=0)
    swap = pairs[:, 0] > pairs[:, 1]
    pairs[swap] = pairs[swap][:, [1, 0, 3, 2, 4]]
    pairs = np.unique(pairs, axis=0)
    merged, hot = list(groups.values()), cat([np.full(len(g), name) for name, g in groups.items()])
    none = pa.nulls(len(hot), pa.int64())
    columns = [pa.concat_arrays([pa.array(pairs[:, i], pa.int64()), pa.array(cat(merged), pa.int64()) if i == 2 else none]) for i in range(4)]
    more = [pa.concat_arrays([pa.nulls(len(pairs), pa.int64()), pa.array(hot, pa.int64())]), pa.concat_arrays([pa.array(pairs[:, 4] > 0), pa.nulls(len(hot), pa.bool_())])]
    return pa.table([*columns, *more], ["a", "b", "la", "lb", "hot", "open"])


def _may_link(n1: np.ndarray, n2: np.ndarray, differ: np.ndarray) -> np.ndarray:
    """Sizes and the number of bins in which two sketches differ allow a similarity of 0.8 (the difference is at most a ninth of the sizes' sum)."""
    return (5 * np.minimum(n1, n2) >= 4 * np.maximum(n1, n2)) & (9 * differ <= n1 + n2)


def _words(sketches: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(sketches.to_pylist()), np.uint64).reshape(-1, SKETCH // 64)


def _possible(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """The pairs (a, b and other columns) that sizes and sketches allow."""
    one = known.select(F.col("key").alias("a"), F.col("n_shingles").alias("_na"), F.col("sketch").alias("_sa"))
    two = known.select(F.col("key").alias("b"), F.col("n_shingles").alias("_nb"), F.col("sketch").alias("_sb"))
    near = pairs.join(one, "a").join(two, "b").filter("5 * least(_na, _nb) >= 4 * greatest(_na, _nb)")
    names = pairs.columns

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = batch.column("_na").to_numpy(), batch.column("_nb").to_numpy()
            differ = np.bitwise_count(_words(batch.column("_sa")) ^ _words(batch.column("_sb"))).sum(axis=1, dtype=np.int64)
            mask = pa.array(_may_link(na, nb, differ), pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(mask) for c in names], names)

    return near.select(*names, "_na", "_nb", "_sa", "_sb").mapInArrow(check, pairs.schema)


def verify(pairs: DataFrame, docs: DataFrame, text_col: str, id_col: str, repeated: bool = True) -> DataFrame:
    """The pairs (a, b and other columns) whose texts' shingle sets have 100 * |intersection| >= 80 * |union|.

    repeated: rows may be equal in id and text; without such rows the sets need no shuffle before that of the join."""
    ids = materialize(pairs.select("a").union(pairs.select("b")).distinct().withColumnRenamed("a", "_need"), "pair-ids")
    need = F.broadcast(ids) if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else ids
    texts = docs.select(row_key(text_col, id_col).alias("id"), F.col(text_col).alias("text")).join(need, F.col("id") == F.col("_need")).drop("_need")

    def sets(batch: pa.RecordBatch) -> list[pa.Array]:
        release()
        out = []
        texts = text_bytes(batch.column("text"))
        for a, b in slices(texts):
            hashes, offsets = shingle_sets(texts[a:b], WIDTH)
            out += [hashes[offsets[i] : offsets[i + 1]].tobytes() for i in range(b - a)]
        return [pa.array(out, pa.binary())]

    held = with_arrow_columns(texts, sets, {"elements": "binary"}, drop=("text",))
    held = materialize(held.dropDuplicates(["id"]) if repeated else held, "sets")
    both = pairs.join(held.select(F.col("id").alias("b"), F.col("elements").alias("_right")), "b")
    names = pairs.columns
    both = both.join(held.select(F.col("id").alias("a"), F.col("elements").alias("_left")), "a").select(*names, "_left", "_right")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column("_left"), batch.column("_right"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                z = np.concatenate([x, y])
                z.sort(kind="stable")
                common = int((z[1:] == z[:-1]).sum())
                good.append(100 * common >= 80 * (len(z) - common))
            mask = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(mask) for c in names], names)

    return both.mapInArrow(check, pairs.schema)


def _seed_pairs(known: DataFrame) -> DataFrame:
    """(a, b): each set with the smallest set that shares a seed. Members of a seed are spread over salts, so that a hot one is no hot task."""
    seeds = known.select("key", F.explode("seeds").alias("seed"))
    lead = seeds.groupBy("seed").agg(F.min("key").alias("lead"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    lead = lead.select("seed", "lead", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    members = seeds.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int"))
    return members.join(lead, ["seed", "salt"]).filter("key <> lead").select(F.least("key", "lead").alias("a"), F.greatest("key", "lead").alias("b")).distinct()


def _tile(table: pa.Table, nearest: int) -> pa.Table:
    """Pairs of sets of different labels in the tiles of one task that may link; of each right set the nearest (0: all), with more set if it had others.

    side: 0 left, 1 right, 2 both."""
    order = table.sort_by([("tile", "ascending"), ("side", "ascending"), ("id", "ascending")])
    tile, side = order.column("tile").to_numpy(), order.column("side").to_numpy()
    ids, labels, n = (order.column(c).to_numpy() for c in ("id", "label", "n_shingles"))
    words = _words(order.column("sketch"))
    out = []
    edges = np.flatnonzero(np.concatenate([[True], tile[1:] != tile[:-1], [True]])) if len(tile) else np.zeros(1, np.int64)
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        alone = side[lo] == 2
        cut = hi if alone else lo + int(np.searchsorted(side[lo:hi], 1))
        for x in range(lo if alone else cut, hi, 64):
            right = np.arange(x, min(x + 64, hi))
            apart = ids[right][:, None] > ids[None, lo:cut] if alone else ids[right][:, None] != ids[None, lo:cut]
            j, i = np.nonzero(
                apart & (labels[right][:, None] != labels[None, lo:cut])
                & (5 * np.minimum(n[right][:, None], n[None, lo:cut]) >= 4 * np.maximum(n[right][:, None], n[None, lo:cut]))
            )
            for at in range(0, len(i), 1 << 15):
                j1, i1 = right[j[at : at + (1 << 15)]], lo + i[at : at + (1 << 15)]
                differ = np.bitwise_count(words[j1] ^ words[i1]).sum(axis=1, dtype=np.int64)
                good = _may_link(n[j1], n[i1], differ)
                out.append(np.stack([j1[good], i1[good], differ[good]], axis=1))
    found = np.concatenate(out) if out else np.zeros((0, 3), np.int64)
    more = np.zeros(len(found), bool)
    if nearest and len(found):
        found = found[np.lexsort((found[:, 1], found[:, 2], found[:, 0]))]
        begin, end = (np.searchsorted(found[:, 0], found[:, 0], side) for side in ("left", "right"))
        low = np.arange(len(found)) - begin < nearest
        found, more = found[low], (end - begin > nearest)[low]
    j, i = found[:, 0], found[:, 1]
    swap = ids[i] > ids[j]
    a, b = np.where(swap, j, i), np.where(swap, i, j)
    pairs = np.stack([ids[a], ids[b], labels[a], labels[b]], axis=1)
    return pa.table([*(pa.array(pairs[:, k], pa.int64()) for k in range(4)), pa.array(more)], ["a", "b", "la", "lb", "more"])


def _open_pairs(met: DataFrame, members: DataFrame, now: DataFrame, nearest: int) -> DataFrame:
    """(a, b, la, lb, more): sets of labels that met and are still apart, compared in tiles by sizes and sketches.

    members: (was, id, n_shingles, sketch), was being the label under which a set met; now: (was, label), labels since."""
    part = lambda n: F.pmod(F.xxhash64("id", F.lit(7)), F.greatest(F.ceil(n / F.lit(TILE)), F.lit(1))).cast("int")
    upto = lambda n: F.greatest(F.ceil(n / F.lit(TILE)), F.lit(1)).cast("int")
    size = members.groupBy("was").agg(F.count(F.lit(1)).alias("n"))

    # two labels: the sets of the larger one on the left, those of all smaller ones that met it on the right
    # (two sets that are alone are compared already: only pairs with an open label are looked up, once for each side)
    stand = lambda k, new, n: now.join(size, "was").select(F.col("was").alias(k), F.col("label").alias(new), F.col("n").alias(n))
    two = met.filter("open").select(F.least("la", "lb").alias("la"), F.greatest("la", "lb").alias("lb")).distinct()
    two = two.join(stand("la", "na", "sa"), "la").join(stand("lb", "nb", "sb"), "lb").filter("na <> nb")
    first = F.struct(F.col("sa"), F.col("la")) >= F.struct(F.col("sb"), F.col("lb"))
    pick = lambda x, y, name: F.when(first, F.col(x)).otherwise(F.col(y)).alias(name)
    two = materialize(two.select(pick("la", "lb", "big"), pick("lb", "la", "small"), pick("sa", "sb", "n_big"), pick("sb", "sa", "n_small")), "open-labels")
    tasks = two.groupBy("big").agg(F.first("n_big").alias("n_big"), F.sum("n_small").alias("n_right"))
    each = members.join(now, "was")
    left = each.join(tasks.withColumnRenamed("big", "was"), "was").withColumn("j", F.explode(F.sequence(F.lit(0), upto(F.col("n_right")) - 1)))
    left = left.select(F.lit(0).alias("kind"), F.col("was").alias("task"), part(F.col("n_big")).alias("i"), "j", F.lit(0).alias("side"), "id", "label", "n_shingles", "sketch")
    right = two.select("big", F.col("small").alias("was")).join(tasks, "big").join(each, "was").withColumn("i", F.explode(F.sequence(F.lit(0), upto(F.col("n_big")) - 1)))
    right = right.select(F.lit(0).alias("kind"), F.col("big").alias("task"), "i", part(F.col("n_right")).alias("j"), F.lit(1).alias("side"), "id", "label", "n_shingles", "sketch")

    # open groups: all of their sets on both sides
    hot = met.filter("hot is not null").select("hot", F.col("la").alias("was")).distinct()
    mixed = hot.join(now, "was").join(size, "was").groupBy("hot").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.sum("n").alias("n_hot")).filter("lo < hi").select("hot", "n_hot")
    inside = hot.join(mixed, "hot").join(each, "was").withColumn("h", part(F.col("n_hot"))).withColumn("last", upto(F.col("n_hot")) - 1)
    inside = materialize(inside.select("hot", "h", "last", "id", "label", "n_shingles", "sketch"), "open-groups")
    keep = ["kind", "task", "i", "j", "side", "id", "label", "n_shingles", "sketch"]
    tiles = inside.withColumn("_", F.explode(F.sequence(F.lit(0), F.col("last")))).withColumns({"kind": F.lit(1), "task": F.col("hot"), "i": F.least("h", "_"), "j": F.greatest("h", "_")})
    tiles = tiles.withColumn("side", F.when(F.col("i") == F.col("j"), 2).when(F.col("h") == F.col("i"), 0).otherwise(1))

    rows = left.unionByName(right).unionByName(tiles.select(keep))
    rows = rows.select(F.xxhash64("kind", "task", "i", "j").alias("tile"), "side", "id", "label", "n_shingles", "sketch")
    n_rows = two.agg(F.sum("n_small")).first()[0] or 0
    n_tasks = max(8, (n_rows + (inside.agg(F.sum(F.col("last") + 1)).first()[0] or 0)) // TILE_ROWS)
    found = rows.groupBy(F.pmod("tile", F.lit(n_tasks)).alias("part")).applyInArrow(lambda t: _tile(t, nearest), "a long, b long, la long, lb long, more boolean")
    return found.groupBy("a", "b", "la", "lb").agg(F.max("more").alias("more"))


def near_duplicates(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", small: int = SMALL) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of docs; a signature of up to small labels yields their pairs at once."""
    return labelled(docs, text_col, id_col, small).select("doc_id", "n_shingles", "component_id")


def keep_one(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row of each component: that with the smallest id (null last); rows without words all stay."""
    rows = materialize(labelled(docs, text_col, id_col).select("doc_id", "key", "n_shingles", "component"), "labelled")
    copies = rows.filter("n_shingles > 0").groupBy("component", "key").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))
    first = copies.groupBy("component").agg(F.min_by(F.struct("key", "copies"), F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("first"))
    kept = materialize(first.select(F.col("first.key").alias("_kept"), F.col("first.copies").alias("copies")), "kept")
    again = kept.filter("copies > 1")
    gone = copies.select(F.col("key").alias("_gone")).join(kept, F.col("_gone") == F.col("_kept"), "left_anti")
    gone = materialize(gone.unionByName(again.select(F.col("_kept").alias("_gone"))), "gone")
    few = gone.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS  # texts are shuffled only beyond that
    name = "_key"
    while name in docs.columns:
        name += "_"
    keyed = docs.withColumn(name, row_key(text_col, id_col))
    out = keyed.join(F.broadcast(gone) if few else gone, keyed[name] == gone["_gone"], "left_anti").select(*docs.columns)
    if not again.isEmpty():  # rows equal in id and text: the smallest by all columns
        same = keyed.join(again, keyed[name] == again["_kept"], "left_semi")
        out = out.unionByName(same.groupBy(name).agg(F.min(F.struct(*docs.columns)).alias("row")).select("row.*"))
    return out


def _relabel(now: DataFrame, links: DataFrame) -> DataFrame:
    """(was, label) after links (la, lb) between labels."""
    merged = components(links.select(F.col("la").alias("a"), F.col("lb").alias("b"))).withColumnRenamed("id", "label")
    return now.join(merged, "label", "left").select("was", F.coalesce("component_id", "label").alias("label"))


def labelled(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", small: int = SMALL) -> DataFrame:
    """(doc_id, key, n_shingles, component, component_id) for each row of docs: component is a key, component_id the smallest id."""
    sets = materialize(set_digests(docs, text_col, id_col), "set-digests")
    some = F.col("n_shingles") > 0
    reps = sets.filter(some).groupBy("d1", "d2").agg(F.min("key").alias("rep"), F.min("doc_id").alias("name"))
    named = sets.drop("sketch", "seeds").join(reps, ["d1", "d2"], "left")
    classes = materialize(named.select("doc_id", "key", "n_shingles", *(F.when(some, F.col(c)).otherwise(F.col(o)).alias(c) for c, o in (("rep", "key"), ("name", "doc_id")))), "classes")
    known = sets.filter(some).select("key", "n_shingles", "sketch", "seeds").join(reps.select("rep"), F.col("key") == F.col("rep"), "left_semi").dropDuplicates(["key"])
    known = materialize(known, "representatives")
    repeated = not sets.groupBy("key").count().filter("count > 1").isEmpty()
    to_verify = lambda pairs: verify(pairs, docs, text_col, id_col, repeated)

    # 1: sets that share one of their smallest signatures
    tried = materialize(_possible(_seed_pairs(known), known), "seed-pairs")
    labels = materialize(components(to_verify(tried)), "labels").withColumnRenamed("component_id", "label")

    # 2: all signatures, one set of each label; copies stay out
    marks = classes.filter("n_shingles > 0").select("key", "rep").distinct().join(labels.withColumnRenamed("id", "rep"), "rep", "left")
    marks = materialize(marks.filter("key <> rep or label is not null").select(F.col("key").alias("_marked"), F.when(F.col("key") == F.col("rep"), F.col("label")).alias("_label")), "marks")
    few = marks.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    rows = docs.select(row_key(text_col, id_col).alias("key"), F.col(text_col).alias("text"))
    rows = rows.join(F.broadcast(marks) if few else marks, F.col("key") == F.col("_marked"), "left").filter("_marked is null or _label is not null")
    rows = rows.select("key", F.col("_label").alias("label"), "text")
    n_buckets = max(8, total_bytes(docs, text_col)[1] // BUCKET_BYTES)
    met = materialize(_blocks(rows, n_buckets, _common(sets, known.count())).groupBy("bucket").applyInArrow(lambda t: _meet(t, small), MET), "met")
    pairs = met.filter("hot is null").select("a", "b", "la", "lb").distinct().join(tried, ["a", "b"], "left_anti")
    pairs = materialize(_possible(pairs, known), "pairs")
    tried = tried.unionByName(pairs.select("a", "b"))
    members = known.select(F.col("key").alias("id"), "n_shingles", "sketch").join(labels, "id", "left")
    members = materialize(members.select(F.coalesce("label", "id").alias("was"), "id", "n_shingles", "sketch"), "members")
    now = members.select("was", F.col("was").alias("label")).distinct()
    now = materialize(_relabel(now, to_verify(pairs)), "labels-now")

    # 3: sets of labels that met but stayed apart
    for nearest in (NEAREST, 0):
        late = materialize(_open_pairs(met, members, now, nearest), "late-pairs")
        fresh = materialize(late.drop("more").join(tried, ["a", "b"], "left_anti"), "fresh-pairs")
        if not fresh.isEmpty():
            tried = tried.unionByName(fresh.select("a", "b"))
            now = materialize(_relabel(now, to_verify(fresh)), "labels-now")
        if late.filter("more").isEmpty():
            break

    final = members.select("was", F.col("id").alias("rep")).join(now, "was").select("rep", "label")
    out = classes.join(final, "rep", "left").withColumn("component", F.coalesce("label", "rep"))
    out = materialize(out.select("doc_id", "key", "n_shingles", "component", "name"), "components")
    names = out.groupBy("component").agg(F.min("name").alias("component_id"))
    return out.drop("name").join(names, "component").select("doc_id", "key", "n_shingles", "component", "component_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(load(spark, sf_dir, "documents").select("doc_id", "text"))
