"""Operator 13: how the sources of a language differ in their terms, by mergeable radix tries.

1. Each partition counts the terms of its documents into one byte trie a language, whose leaves have counters by source
   (occurrences, documents). A full trie is sent on and begun anew, so a task's memory is bounded.
2. A trie is sent in pieces, one for each prefix of DEPTH bytes: the front-coded preorder of that subtree. Pieces are counted
   by prefix, prefixes are put together to ranges of about RANGE counters, and the tries of a range are merged in one
   task; a prefix with more counters than a range is cut again at twice the depth. A hot source or term is a counter of
   each trie, so it reaches its range once a partition.
3. Terms in at least MIN_DOCS documents of their language stay. Totals by source and language are sums over the ranges.
4. Each range is walked in UTF-8 order once more, with the totals: it adds up the pairs of sources (sparse: what a term
   without an occurrence adds is the same for all terms, so only counters are visited, and terms that both sources of a pair
   have) and keeps the TOP terms of each source, ties in walking order. Ranks come from sums and tops of the ranges.

All arithmetic is exact on 64-bit integers: quotients by long division in base 1000, for totals below 2**53.

Defined results: null text, lang and source are empty strings; each row is a document, repeated and null doc_ids included
(ids are not read); other columns are ignored; a language without kept terms has pairs of value 0 and no terms; a language
with one source has no pairs; an empty table gives an empty result. Memory of a task is bounded by a range and by the
square of the sources of one language, which is also the size of that part of the result.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.llm.common import load, materialize, text_bytes

MIN_DOCS, TOP, SCALE = 3, 200, 1_000_000_000
DEPTH, MAX_DEPTH, RANGE, LEAVES = 3, 96, 500_000, 1_000_000
SLICE = 4 << 20
CELLS = 1 << 20

#: Letters and non-ASCII bytes stay, A-Z lower-cased; every other byte separates terms.
_TERM = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

PIECES = "lang string, unit binary, size long, sources array<string>, shared array<int>, rest array<binary>, width array<int>, source array<int>, n array<long>, docs array<long>"
KEPT = "lang string, range_id string, term string, sources array<string>, counts array<long>"


def _list(offsets: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values)


def _flat(column: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
    """The values of a column of lists, one after the other, and the size of each list."""
    whole = column.combine_chunks()
    whole = whole if isinstance(whole, pa.Array) else pa.concat_arrays(column.chunks)
    return whole.flatten(), whole.value_lengths().to_numpy(zero_copy_only=False)


def _binary(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Byte strings of these sizes, one after the other in data."""
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def _bytes_of(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of large binary strings and where each string begins, one more at the end."""
    offsets = np.frombuffer(strings.buffers()[1], np.int64)[strings.offset : strings.offset + len(strings) + 1]
    data = strings.buffers()[2]
    return np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8), offsets


def common_prefixes(terms: pa.Array) -> np.ndarray:
    """How many bytes each of some sorted terms shares with the one before it: the depth at which it leaves that one's path."""
    n, width = len(terms), 24
    out = np.zeros(n, np.int64)
    data, offsets = _bytes_of(terms)
    sizes = np.diff(offsets)
    for i in range(1, n, CELLS // width):
        j = min(n, i + CELLS // width)
        at = offsets[i - 1 : j, None] + np.arange(width)
        heads = np.where(np.arange(width) < sizes[i - 1 : j, None], data[np.minimum(at, len(data) - 1)].astype(np.int16), -1)
        same = heads[1:] == heads[:-1]
        out[i:j] = np.minimum(np.where(same.all(axis=1), width, same.argmin(axis=1)), np.minimum(sizes[i - 1 : j - 1], sizes[i:j]))
    for i in np.flatnonzero(out >= width).tolist():
        a, b = data[offsets[i - 1] : offsets[i]], data[offsets[i] : offsets[i + 1]]
        k = min(len(a), len(b))
        unlike = np.flatnonzero(a[:k] != b[:k])
        out[i] = unlike[0] if len(unlike) else k
    return out


class RadixTrie:
    """A byte trie with merged edges, as arrays: its leaves in preorder, and how deep each one leaves the path before it.

    An inner node is a stretch of leaves whose depths are at least its own; cutting at a depth is cutting where depths are
    lower. Each leaf has counters (occurrences, documents) by source.
    """

    def __init__(self, terms: pa.Array, begin: np.ndarray, names: list[str], source: np.ndarray, n: np.ndarray, docs: np.ndarray):
        self.terms, self.begin, self.names, self.source, self.n, self.docs = terms, begin, names, source, n, docs

    @property
    def size(self) -> int:
        return len(self.n)

    @classmethod
    def of(cls, terms: pa.Array, term: np.ndarray, names: list[str], source: np.ndarray, n: np.ndarray, docs: np.ndarray, sum_docs: bool = True) -> RadixTrie:
        """From counters of terms[term] in any order; equal ones are added up (documents of one text's slices are not)."""
        coded = pa.DictionaryArray.from_arrays(pa.array(term.astype(np.int32)), terms).dictionary.dictionary_encode()
        order = pc.sort_indices(coded.dictionary).to_numpy()
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        key = rank[coded.indices.to_numpy()][term] * max(len(names), 1) + source
        by = np.argsort(key, kind="stable")
        key = key[by]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        leaf, own = np.divmod(key[first], max(len(names), 1))
        used = np.unique(leaf)
        add = lambda values, how=np.add: how.reduceat(values[by], first) if len(first) else values[:0]
        begin = np.concatenate([np.searchsorted(leaf, used), [len(leaf)]])
        return cls(coded.dictionary.take(pa.array(order[used])), begin, names, own, add(n), add(docs, np.add if sum_docs else np.maximum))

    @classmethod
    def merge(cls, tries: list[RadixTrie], sum_docs: bool = True) -> RadixTrie:
        names = sorted({x for t in tries for x in t.names})
        place = {x: i for i, x in enumerate(names)}
        shift = np.cumsum([0, *(len(t.terms) for t in tries)])
        term = np.concatenate([np.repeat(np.arange(len(t.terms)), np.diff(t.begin)) + shift[i] for i, t in enumerate(tries)])
        source = np.concatenate([np.array([place[x] for x in t.names], np.int64)[t.source] for t in tries])
        join = lambda name: np.concatenate([getattr(t, name) for t in tries])
        return cls.of(pa.concat_arrays([t.terms for t in tries]), term, names, source, join("n"), join("docs"), sum_docs)

    def pieces(self, lang: str, depth: int) -> Iterator[pa.RecordBatch]:
        """A row for each prefix of depth bytes (a shorter term is a prefix of its own): its subtree in preorder, front-coded."""
        if not len(self.terms):
            return
        shared = common_prefixes(self.terms)
        cut = np.flatnonzero(np.concatenate([[True], shared[1:] < depth]))
        shared[cut] = 0
        data, offsets = _bytes_of(self.terms)
        sizes = np.diff(offsets) - shared
        at = np.repeat(offsets[:-1] + shared, sizes) + _ramp(sizes)
        heads = np.minimum(np.diff(offsets)[cut], depth)
        unit = _binary(data[np.repeat(offsets[:-1][cut], heads) + _ramp(heads)], heads)
        leaves, counters = np.concatenate([cut, [len(self.terms)]]), np.concatenate([self.begin[cut], [self.size]])
        of_unit = np.repeat(np.arange(len(cut)), np.diff(counters))
        kinds, local = np.unique(of_unit * len(self.names) + self.source, return_inverse=True)
        held = np.searchsorted(kinds, np.arange(len(cut) + 1) * len(self.names))
        columns = [
            pa.array([lang] * len(cut), pa.string()),
            unit.cast(pa.binary()),
            pa.array(np.diff(counters)),
            _list(held, pa.array(self.names, pa.string()).take(pa.array(kinds % len(self.names)))),
            _list(leaves, pa.array(shared.astype(np.int32))),
            _list(leaves, _binary(data[at], sizes).cast(pa.binary())),
            _list(leaves, pa.array(np.diff(self.begin).astype(np.int32))),
            _list(counters, pa.array((local - held[of_unit]).astype(np.int32))),
            _list(counters, pa.array(self.n)),
            _list(counters, pa.array(self.docs)),
        ]
        whole = pa.RecordBatch.from_arrays(columns, ["lang", "unit", "size", "sources", "shared", "rest", "width", "source", "n", "docs"])
        for i in range(0, len(cut), 256):
            yield whole.slice(i, 256)

    @classmethod
    def of_pieces(cls, table: pa.Table) -> RadixTrie:
        """The merged tries of pieces of one language."""
        shared, _ = _flat(table["shared"])
        rest, _ = _flat(table["rest"])
        width, _ = _flat(table["width"])
        source, counters = _flat(table["source"])
        names, held = _flat(table["sources"])
        terms, term = [], b""
        for k, x in zip(shared.to_pylist(), rest.to_pylist(), strict=True):
            term = term[:k] + x
            terms.append(term)
        coded = names.dictionary_encode()
        first = np.concatenate([[0], np.cumsum(held)])[:-1]
        own = coded.indices.to_numpy()[np.repeat(first, counters) + source.to_numpy()].astype(np.int64)
        leaf = np.repeat(np.arange(len(terms)), width.to_numpy())
        return cls.of(pa.array(terms, pa.large_binary()), leaf, coded.dictionary.to_pylist(), own, _flat(table["n"])[0].to_numpy(), _flat(table["docs"])[0].to_numpy())


def _ramp(sizes: np.ndarray) -> np.ndarray:
    """0 to size - 1 for each of sizes, one after the other."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def slices(texts: list[bytes], size: int = SLICE) -> Iterator[tuple[list[int], list[bytes], bool]]:
    """Texts (by index) of about size bytes in all with separators for bytes that no term has; a long text comes in parts (True)."""
    rows, held, total = [], [], 0
    for i, text in enumerate(texts):
        plain = text.translate(_TERM)
        if len(plain) > size:
            at = 0
            while at < len(plain):
                end = plain.find(b" ", at + size)
                end = len(plain) if end < 0 else end
                yield [i], [plain[at:end]], True
                at = end
            continue
        rows.append(i)
        held.append(plain)
        total += len(plain)
        if total > size:
            yield rows, held, False
            rows, held, total = [], [], 0
    if rows:
        yield rows, held, False


def count_slice(texts: list[bytes], group: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Terms, and for each group and term that occurs in it: group, term, occurrences, documents."""
    buf = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    inside = buf != 32
    edges = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).view(np.int8)))
    starts, ends = edges[0::2], edges[1::2]
    bounds = np.cumsum([len(t) + 1 for t in texts])
    doc = np.searchsorted(bounds, starts, side="right")
    coded = _binary(buf[inside], ends - starts).dictionary_encode()
    n = max(len(coded.dictionary), 1)
    key = (group[doc] * n + coded.indices.to_numpy()) * len(texts) + doc
    key.sort()
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    times = np.diff(np.concatenate([first, [len(key)]]))
    pair = key[first] // len(texts)
    one = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]])) if len(pair) else np.zeros(0, np.int64)
    of_group, term = np.divmod(pair[one], n)
    return coded.dictionary, of_group, term, np.add.reduceat(times, one) if len(one) else times, np.diff(np.concatenate([one, [len(pair)]]))


def count_terms(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", depth: int = DEPTH, leaves: int = LEAVES, size: int = SLICE) -> DataFrame:
    """The pieces of the tries of each partition of docs."""

    def run(batches):
        held: dict[str, list[RadixTrie]] = defaultdict(list)
        for batch in batches:
            langs, sources, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist(), text_bytes(batch.column(2))
            for rows, parts, long in _together(slices(texts, size)):
                groups = sorted({(langs[i], sources[i]) for i in rows})
                place = {g: k for k, g in enumerate(groups)}
                group = np.array([place[langs[i], sources[i]] for i in rows], np.int64)
                for lang, trie in _by_lang(parts, group, groups, long):
                    held[lang].append(trie)
            if sum(t.size for tries in held.values() for t in tries) > leaves:
                yield from _send(held, depth)
        yield from _send(held, depth)

    text = lambda name: F.coalesce(F.col(name).cast("string"), F.lit("")).alias(name)
    return docs.select(text(lang_col), text(source_col), text_col).mapInArrow(run, PIECES)


def _together(parts: Iterator[tuple[list[int], list[bytes], bool]]) -> Iterator[tuple[list[int], list[bytes], bool]]:
    """The parts of one long text in one list."""
    long: tuple[list[int], list[bytes]] | None = None
    for rows, texts, is_long in parts:
        if long and (not is_long or long[0] != rows):
            yield *long, True
            long = None
        if is_long:
            long = (rows, (long[1] if long else []) + texts)
        else:
            yield rows, texts, False
    if long:
        yield *long, True


def _by_lang(texts: list[bytes], group: np.ndarray, groups: list[tuple[str, str]], long: bool) -> Iterator[tuple[str, RadixTrie]]:
    """A trie a language; the parts of a long text count as one document."""
    if long:
        (lang, source), tries = groups[0], []
        for part in texts:
            terms, own, term, n, docs = count_slice([part], group)
            tries.append(RadixTrie.of(terms, term, [source], own, n, docs))
        yield lang, RadixTrie.merge(tries, sum_docs=False)
        return
    terms, own, term, n, docs = count_slice(texts, group)
    for lang in dict.fromkeys(g[0] for g in groups):
        mine = [k for k, g in enumerate(groups) if g[0] == lang]
        some = (own >= mine[0]) & (own <= mine[-1])  # groups are sorted, so those of a language lie side by side
        yield lang, RadixTrie.of(terms, term[some], [groups[k][1] for k in mine], own[some] - mine[0], n[some], docs[some])


def _send(held: dict[str, list[RadixTrie]], depth: int) -> Iterator[pa.RecordBatch]:
    for lang in list(held):
        yield from RadixTrie.merge(held.pop(lang)).pieces(lang, depth)


def cut_again(pieces: DataFrame, depth: int) -> DataFrame:
    """The same counters in pieces of longer prefixes."""

    def cut(batches):
        for batch in batches:
            table = pa.Table.from_batches([batch])
            for lang in table["lang"].unique().to_pylist():
                yield from RadixTrie.of_pieces(table.filter(pc.equal(table["lang"], lang))).pieces(lang, depth)

    return pieces.mapInArrow(cut, PIECES)


def by_range(pieces: DataFrame, most: int = RANGE, depth: int = DEPTH) -> DataFrame:
    """pieces with range_id: neighbouring prefixes with about most counters in all tries, within one first byte."""
    while True:
        weights = materialize(pieces.groupBy("lang", "unit").agg(F.sum("size").alias("weight")), "prefix-weights")
        heavy = weights.filter((F.col("weight") > most) & (F.length("unit") == depth)).select("lang", "unit")
        if depth >= MAX_DEPTH or not heavy.limit(1).count():
            break
        depth *= 2
        light = pieces.join(heavy, ["lang", "unit"], "left_anti")
        pieces = materialize(light.unionByName(cut_again(pieces.join(heavy, ["lang", "unit"], "left_semi"), depth)), "trie-pieces")
    order = Window.partitionBy("lang", "head").orderBy("unit").rowsBetween(Window.unboundedPreceding, -1)
    ranged = weights.withColumn("head", F.substring("unit", 1, 1)).withColumn("below", F.coalesce(F.sum("weight").over(order), F.lit(0)))
    ranged = ranged.select("lang", "unit", F.concat(F.hex("head"), F.lit("-"), F.expr(f"below div {most}")).alias("range_id"))
    return pieces.join(ranged, ["lang", "unit"])


def merge_ranges(ranged: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, range_id, term, sources, counts): the merged leaves of terms that at least min_docs documents hold."""

    def merge(table: pa.Table) -> pa.Table:
        trie = RadixTrie.of_pieces(table)
        kept = np.flatnonzero(np.add.reduceat(trie.docs, trie.begin[:-1]) >= min_docs)
        width = np.diff(trie.begin)[kept]
        at = np.repeat(trie.begin[kept], width) + _ramp(width)
        offsets = np.concatenate([[0], np.cumsum(width)])
        return pa.table(
            {
                "lang": pa.array([table["lang"][0].as_py()] * len(kept), pa.string()),
                "range_id": pa.array([table["range_id"][0].as_py()] * len(kept), pa.string()),
                "term": trie.terms.take(pa.array(kept)).cast(pa.large_string()).cast(pa.string()),
                "sources": _list(offsets, pa.array(trie.names, pa.string()).take(pa.array(trie.source[at]))),
                "counts": _list(offsets, pa.array(trie.n[at])),
            }
        )

    return ranged.groupBy("lang", "range_id").applyInArrow(merge, KEPT)


def share(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * (count + 1) / total), for count + 1 <= total < 2**53."""
    left, out = count + 1, 0
    for _ in range(3):
        left = left * 1000
        out = out * 1000 + left // total
        left = left % total
    return 1 + out


def gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def pair_sums(n_terms: int, term: np.ndarray, source: np.ndarray, count: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """For each two sources the sum of gap(p, q) over n_terms terms, from the counters (term, source, count) sorted by term.

    A sum starts from the gap of two terms without occurrence, is mended for each counter of either source, once for each
    distinct (source, count), and for each two counters of one term.
    """
    n = len(totals)
    zero = share(np.zeros(n, np.int64), totals)
    base = gap(zero[:, None], zero[None, :])
    out = base * n_terms
    kinds, times = np.unique(np.stack([source, count]), axis=1, return_counts=True)
    step = max(1, CELLS // max(n, 1))
    for i in range(0, kinds.shape[1], step):
        s, c, m = kinds[0, i : i + step], kinds[1, i : i + step], times[i : i + step, None]
        p = share(c, totals[s])[:, None]
        np.add.at(out, s, (gap(p, zero[None, :]) - base[s]) * m)
        np.add.at(out.T, s, (gap(zero[None, :], p) - base[:, s].T) * m)
    p = share(count, totals[source])
    begin = np.searchsorted(term, term, side="left")
    width = np.searchsorted(term, term, side="right") - begin
    work = np.cumsum(width)
    i = 0
    while i < len(term):
        j = max(i + 1, int(np.searchsorted(work, (work[i - 1] if i else 0) + CELLS)))
        a = np.repeat(np.arange(i, j), width[i:j])
        b = np.repeat(begin[i:j] - (work[i:j] - width[i:j]), width[i:j]) + np.arange(work[i] - width[i], work[j - 1])
        s, t = source[a], source[b]
        np.add.at(out, (s, t), gap(p[a], p[b]) - gap(p[a], zero[t]) - gap(zero[s], p[b]) + base[s, t])
        i = j
    return out


def top_terms(term: np.ndarray, source: np.ndarray, count: np.ndarray, totals: np.ndarray, whole: int, top: int = TOP) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the counters of the top terms of each source against the language, and their values."""
    p = share(count, totals[source])
    q = share(np.bincount(term, count).astype(np.int64) if count.sum() < 1 << 53 else _sums(term, count), np.int64(whole))[term]
    value = np.where(p > q, gap(p, q), -1)
    order = np.lexsort((term, -value, source))
    order = order[value[order] >= 0]
    first = np.searchsorted(source[order], source[order], side="left")
    order = order[np.arange(len(order)) - first < top]
    return order, value[order]


def _sums(term: np.ndarray, count: np.ndarray) -> np.ndarray:
    out = np.zeros(term.max() + 1, np.int64)
    np.add.at(out, term, count)
    return out


def divergence(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_docs: int = MIN_DOCS, top: int = TOP, most: int = RANGE, leaves: int = LEAVES) -> DataFrame:
    """(lang, source, part, item, value, rank): pairs of sources, and terms by which a source differs from its language."""
    pieces = materialize(count_terms(docs, text_col, lang_col, source_col, leaves=leaves), "trie-pieces")
    kept = materialize(merge_ranges(by_range(pieces, most), min_docs), "kept-terms")
    text = lambda name, to: F.coalesce(F.col(name).cast("string"), F.lit("")).alias(to)
    groups = docs.select(text(lang_col, "lang"), text(source_col, "source")).distinct()
    counts = kept.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("x")).groupBy("lang", F.col("x.sources").alias("source")).agg(F.sum("x.counts").alias("n"))
    sizes = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"))
    totals = groups.join(counts, ["lang", "source"], "left").join(sizes, "lang", "left").select("lang", "source", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("v", F.lit(0)).alias("v"))
    totals = materialize(totals, "term-totals")
    ranges = kept.select("lang", F.concat("range_id", F.lit("")).alias("range_id")).distinct().unionByName(totals.select("lang", F.lit("none").alias("range_id")).distinct())

    def walk(found: pa.Table, given: pa.Table) -> pa.Table:
        names = sorted(zip(given["source"].to_pylist(), given["n"].to_pylist(), strict=True))
        source_of = {s: i for i, (s, _) in enumerate(names)}
        v = given["v"][0].as_py()
        totals = np.array([n for _, n in names], np.int64) + v
        order = pc.sort_indices(found["term"].cast(pa.binary()))  # the order of a walk through the trie
        found = found.take(order)
        held, width = _flat(found["sources"])
        coded = held.dictionary_encode()
        source = np.array([source_of[x] for x in coded.dictionary.to_pylist()], np.int64)[coded.indices.to_numpy()] if len(held) else np.zeros(0, np.int64)
        term = np.repeat(np.arange(len(width)), width)
        count = _flat(found["counts"])[0].to_numpy()
        n = len(names)
        sums = pair_sums(len(width), term, source, count, totals) if v else np.zeros((n, n), np.int64)
        chosen, value = top_terms(term, source, count, totals, sum(c for _, c in names) + v, top) if len(width) else (np.zeros(0, np.int64),) * 2
        left, right = np.nonzero(~np.eye(n, dtype=bool))
        label = pa.array([s for s, _ in names], pa.string())
        return pa.table(
            {
                "lang": pa.array([given["lang"][0].as_py()] * (len(left) + len(chosen)), pa.string()),
                "source": pa.chunked_array([label.take(pa.array(left)), label.take(pa.array(source[chosen]))]),
                "part": pa.array(["pair"] * len(left) + ["term"] * len(chosen), pa.string()),
                "item": pa.chunked_array([label.take(pa.array(right)), found["term"].combine_chunks().take(pa.array(term[chosen]))]),
                "value": pa.array(np.concatenate([sums[left, right], value])),
            }
        )

    both = kept.groupBy("lang", "range_id").cogroup(totals.join(ranges, "lang").groupBy("lang", "range_id"))
    walked = materialize(both.applyInArrow(walk, "lang string, source string, part string, item string, value long"), "range-values")
    pairs = walked.filter("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(order))
    return ranked(pairs).unionByName(ranked(walked.filter("part = 'term'")).filter(F.col("rank") <= top))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(load(spark, sf_dir, "documents").select("lang", "source", "text"))


#: Every group meets every kept term here, in 128-bit integers.
ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{80}-\x{10FFFF}]+') AS w
  FROM documents),
occurrences AS (SELECT r, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term FROM occurrences GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
sizes AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM d),
counted AS (SELECT lang, source, term, count(*) AS n FROM occurrences GROUP BY lang, source, term),
whole AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0)::HUGEINT AS n
  FROM groups g JOIN kept k ON k.lang = g.lang LEFT JOIN counted c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
ps AS (SELECT w.lang, source, term, n, 1 + (1000000000 * (n + 1)) // (sum(n) OVER (PARTITION BY w.lang, source) + v)::HUGEINT AS p FROM whole w JOIN sizes s ON s.lang = w.lang),
qs AS (
  SELECT t.lang, term, 1 + (1000000000 * (n + 1)) // (sum(n) OVER (PARTITION BY t.lang) + v)::HUGEINT AS q
  FROM (SELECT lang, term, sum(n)::HUGEINT AS n FROM whole GROUP BY lang, term) t JOIN sizes s ON s.lang = t.lang),
sums AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM ps a JOIN ps b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums ON sums.lang = a.lang AND sums.source = a.source AND sums.item = b.source),
tops AS (
  SELECT ps.lang, source, 'term' AS part, ps.term AS item, ((p - q) * (p - q) // q)::BIGINT AS value
  FROM ps JOIN qs ON ps.lang = qs.lang AND ps.term = qs.term WHERE n > 0 AND p > q),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM tops))
SELECT lang, source, part, item, value, rank::INT AS rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""
