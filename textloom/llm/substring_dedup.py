"""Operator 3: exact substring dedup on a suffix array built column by column over many short strings.

A byte goes if it lies in a WINDOW-byte string that also starts in a document with a smaller id. Only windows matter, so
documents are cut into strings that each hold a run of consecutive windows: windows whose smallest K-gram hash (the
minimizer) is the same. Equal windows have equal minimizers, so hashing the minimizer deals all occurrences of a window
to one bucket, and buckets are sorted independently.

Candidates first: a shared window holds its minimizer and ARM bytes to the left or to the right of it. 32-bit hashes of
these arms are counted per bucket of hashes, and each group of documents (by a hash of the id) learns which of its arms
occur in more than one document. Only strings with such an arm travel on, as compressed blocks; within a slice of
documents a string that occurs often is sent once, with the smallest of its documents, and the others lose it at once.

In a bucket the Burrows-Wheeler transform and common-prefix lengths of all strings are built column-wise: every round
inserts one symbol for each string, from its end to its start; the place of each new suffix follows from its
predecessor's rank, and the stream of rows is rewritten front to back with the new rows merged in. At the end, neighbours
with common prefixes of WINDOW or more are equal windows, and the smallest document of each group decides. A string that
has no arm in common with a different one has nothing to be sorted among. The streams of a bucket are arrays: a bucket is sized
to fit its task. Cuts return to the group of their document.

Defined results: null text is empty; texts shorter than WINDOW bytes keep all; a document's own repeats don't count, nor
does a row of the same id; rows without an id take no part and keep all; cuts may split a character (kept bytes are then
no valid UTF-8, kept_text replaces it).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import joined, load, mix64, slices, text_bytes, total_bytes

WINDOW, K, ARM = 50, 12, 19
SPREAD = WINDOW - K + 1
MAX_RUN = 43
BUCKET_BYTES, GROUP_BYTES, SLICE, BLOCK = 4 << 20, 8 << 20, 4 << 20, 1 << 17
U64 = np.uint64


def _words(buf: np.ndarray) -> np.ndarray:
    """The 8 bytes that begin at each place of buf (zeros after its end) as integers."""
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    return np.ndarray((len(buf),), "<u8", padded, 0, (1,)).copy()


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    out, span = x.copy(), 1
    while span * 2 <= width:
        out[:-span] = np.minimum(out[:-span], out[span:])
        span *= 2
    if rest := width - span:
        out[:-rest] = np.minimum(out[:-rest], out[rest:])
    return out


def _minimizers(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each place: the 36-bit hash of its gram, the smallest hash of the window that begins there, and the first and last place of it.

    Done in BLOCK places at a time, which stay in the processor's cache."""
    n = len(buf)
    grams, least = np.empty(n, np.uint64), np.empty(n, np.uint64)
    left, right = np.empty(n, np.uint8), np.empty(n, np.uint8)
    low = U64((1 << 28) - 1)
    for lo in range(0, n, BLOCK):
        hi = min(lo + BLOCK, n)
        words = _words(buf[lo : hi + SPREAD - 1 + K])
        g = words * U64(0x9E3779B97F4A7C15)
        g[:-4] ^= words[4:] * U64(0xC2B2AE3D27D4EB4F)
        g ^= g >> U64(32)
        g *= U64(0x94D049BB133111EB)
        g &= ~low
        grams[lo:hi] = g[: hi - lo]
        where = np.arange(len(g), dtype=np.uint64)
        # the smallest hash of each window with its first place below it, and again with its last
        first, last = _sliding_min(g | where, SPREAD)[: hi - lo], _sliding_min(g | (low - where), SPREAD)[: hi - lo]
        least[lo:hi] = first >> U64(28)
        left[lo:hi] = (first & low) - where[: hi - lo]
        right[lo:hi] = low - (last & low) - where[: hi - lo]
    grams >>= U64(28)
    return grams, least, left, right


def window_runs(texts: list[bytes]):
    """Strings of windows of the texts: buffer, start, length, text, offset in the text, minimizer hash, its place (255: not unique), (string, place) of the others."""
    buf, offsets = joined(texts)
    sizes = np.diff(offsets) - 1
    n_windows = np.maximum(sizes - WINDOW + 1, 0)
    total = int(n_windows.sum())
    if not total:
        return None
    grams, smallest, leftmost, rightmost = _minimizers(buf)
    begin = np.cumsum(n_windows) - n_windows
    shift = np.repeat(offsets[:-1] - begin, n_windows)
    start = np.arange(total) + shift
    least = smallest[start]
    new = np.ones(total, bool)
    new[1:] = (least[1:] != least[:-1]) | (np.diff(start) != 1)
    first = np.flatnonzero(new)
    length = np.diff(np.concatenate([first, [total]]))
    pieces = -(-length // MAX_RUN)  # long runs (a repeated character) in pieces
    if pieces.max() > 1:
        nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        length = np.minimum(np.repeat(length, pieces) - nth * MAX_RUN, MAX_RUN)
        first = np.repeat(first, pieces) + nth * MAX_RUN
    a, low = start[first], least[first]
    size = length + WINDOW - 1
    left = leftmost[a].astype(np.int64)
    right = rightmost[a + length - 1] + length - 1
    text = np.searchsorted(offsets, a, side="right") - 1
    # a minimizer that occurs again in its string: all its places
    unsure = np.flatnonzero(left != right)
    strings, places = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for o in range(int(size[unsure].max(initial=K)) - K + 1):
        fits = unsure[size[unsure] - K >= o]
        hit = fits[grams[a[fits] + o] == low[fits]]
        strings.append(hit)
        places.append(np.full(len(hit), o))
    return buf, a, size, text, a - offsets[text], mix64(low), np.where(left == right, left, 255), (np.concatenate(strings), np.concatenate(places))


def _spans_of(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Indices start[i] .. start[i] + size[i] - 1 one after another."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def _hash_spans(buf: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hashes of spans of up to 96 bytes, by whole words and a masked last one."""
    words = _words(buf)
    out = size.astype(np.uint64) * U64(0xD6E8FEB86659FD93)
    for at in range(0, int(size.max(initial=0)), 8):
        here = np.flatnonzero(size > at)
        rest = np.minimum(size[here] - at, 8)
        word = words[start[here] + at] & (U64(0xFFFFFFFFFFFFFFFF) >> (U64(64) - U64(8) * rest.astype(np.uint64)))
        out[here] = mix64(out[here] * U64(0x9E3779B97F4A7C15) + word)
    return out


def _pack_cuts(ids: np.ndarray, keys: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> bytes:
    """Removed byte ranges [lo, hi) of documents (id, text key), compressed."""
    raw = np.array([len(ids)], np.int64).tobytes() + ids.astype(np.int64).tobytes() + keys.astype(np.uint64).tobytes() + lo.astype(np.int32).tobytes() + hi.astype(np.int32).tobytes()
    return _zip(raw)


def _unpack_cuts(block: bytes) -> tuple[np.ndarray, ...]:
    raw = _unzip(block)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    return np.frombuffer(raw, np.int64, n, 8), np.frombuffer(raw, np.uint64, n, 8 + 8 * n), np.frombuffer(raw, np.int32, n, 8 + 16 * n), np.frombuffer(raw, np.int32, n, 8 + 20 * n)


def _zip(raw: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(raw)


def _unzip(raw: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(raw)


def text_key(text: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(text, digest_size=8).digest(), "little")


def _group_of(ids: np.ndarray, n_groups: int) -> np.ndarray:
    return (mix64(ids.astype(np.int64).view(np.uint64)) % U64(n_groups)).astype(np.int64)


def _cut_rows(ids: np.ndarray, keys: np.ndarray, lo: np.ndarray, hi: np.ndarray, n_groups: int) -> tuple[list[int], list[bytes]]:
    """Cuts packed by the group of their document."""
    if not len(ids):
        return [], []
    group = _group_of(ids, n_groups)
    order = np.lexsort((lo, ids, group))
    ids, keys, lo, hi, group = ids[order], keys[order], lo[order], hi[order], group[order]
    # touching ranges of a document in one
    joint = (ids[1:] == ids[:-1]) & (keys[1:] == keys[:-1]) & (lo[1:] <= hi[:-1])
    top = np.flatnonzero(np.concatenate([[True], ~joint]))
    ids, keys, group, hi, lo = ids[top], keys[top], group[top], np.maximum.reduceat(hi, top), lo[top]
    names, first = np.unique(group, return_index=True)
    ends = [*first[1:], len(ids)]
    return names.tolist(), [_pack_cuts(ids[a:b], keys[a:b], lo[a:b], hi[a:b]) for a, b in zip(first, ends, strict=True)]


def _arms(buf: np.ndarray, start: np.ndarray, size: np.ndarray, place: np.ndarray, n_buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys (bucket << 32 | hash) of the bytes right and left of each string's minimizer with it; 0 where there are too few."""
    out = []
    for begin, fits in ((place, size - place >= K + ARM), (place - ARM, place >= ARM)):
        has = np.flatnonzero(fits & (place < 255))
        h = _hash_spans(buf, start[has] + begin[has], np.full(len(has), K + ARM))
        keys = np.zeros(len(start), np.uint64)
        keys[has] = ((h >> U64(40)) % U64(n_buckets)) << U64(32) | (h & U64(0xFFFFFFFF)) | U64(1)
        out.append(keys)
    return out[0], out[1]


def _mark(docs: DataFrame, text_col: str, id_col: str, n_buckets: int, n_groups: int) -> DataFrame:
    """(bucket, arms): arms of the strings of a slice of documents by group; twice where a group has them in several documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(batch.column(0).is_valid())
            all_ids, all_texts = batch.column(0).to_numpy(zero_copy_only=False), text_bytes(batch.column(1))
            for i, j in slices(all_texts, SLICE):
                ids = all_ids[i:j].astype(np.int64)
                made = window_runs(all_texts[i:j])
                if made is None:
                    continue
                buf, start, size, text, _, _, place, (again, places) = made
                rows, place = np.concatenate([np.arange(len(start)), again]), np.concatenate([place, places])
                right, left = _arms(buf, start[rows], size[rows], place, n_buckets)
                keys, doc = np.concatenate([right, left]), ids[text[np.concatenate([rows, rows])]]
                keys, doc = keys[keys > 0], doc[keys > 0]
                group = _group_of(doc, n_groups)
                # documents lie together already; where one comes back, its arm counts as repeated, which only sends more
                order = np.argsort(((keys >> U64(32)) * U64(n_groups) + group.astype(np.uint64)) << U64(32) | (keys & U64(0xFFFFFFFF)), kind="stable")
                keys, doc, group = keys[order], doc[order], group[order]
                nth = np.ones(len(keys), np.int64)  # how many documents of the group hold the arm up to here
                same = (keys[1:] == keys[:-1]) & (group[1:] == group[:-1])
                fresh = np.concatenate([[True], ~same])
                other = np.concatenate([[False], same & (doc[1:] != doc[:-1])])
                first = np.flatnonzero(fresh)
                nth = np.cumsum(other) - np.repeat(np.cumsum(other)[first], np.diff(np.concatenate([first, [len(keys)]])))
                keep = fresh | (other & (nth == 1))
                keys, group = keys[keep], group[keep]
                names, cut = np.unique(keys >> U64(32), return_index=True)
                blocks = []
                for lo, hi in zip(cut, [*cut[1:], len(keys)], strict=True):
                    g, runs = np.unique(group[lo:hi], return_counts=True)
                    blocks.append(np.array([len(g)], np.int64).tobytes() + g.astype(np.int32).tobytes() + runs.astype(np.int32).tobytes() + keys[lo:hi].astype(np.uint32).tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(names.astype(np.int64)), pa.array(blocks, pa.binary())], ["bucket", "arms"])

    return docs.select(id_col, text_col).mapInArrow(run, "bucket long, arms binary")


def _repeated(table: pa.Table) -> pa.Table:
    """(grp, shared): the arms of one bucket that occur more than once, for each group that has them."""
    groups, arms = [], []
    for block in table.column("arms").to_pylist():
        n = int(np.frombuffer(block, np.int64, 1)[0])
        groups.append(np.repeat(np.frombuffer(block, np.int32, n, 8), np.frombuffer(block, np.int32, n, 8 + 4 * n)))
        arms.append(np.frombuffer(block, np.uint32, -1, 8 + 8 * n))
    group, arm = np.concatenate(groups), np.concatenate(arms)
    order = np.argsort(arm, kind="stable")
    group, arm = group[order], arm[order]
    many = np.zeros(len(arm), bool)
    many[1:] = arm[1:] == arm[:-1]
    many[:-1] |= many[1:]
    pairs = np.unique(group[many].astype(np.int64) << 32 | arm[many])
    names, cut = np.unique(pairs >> 32, return_index=True)
    bucket = np.array([table.column("bucket")[0].as_py()], np.int64).tobytes()
    blocks = [_zip(bucket + (pairs[lo:hi] & 0xFFFFFFFF).astype(np.uint32).tobytes()) for lo, hi in zip(cut, [*cut[1:], len(pairs)], strict=True)] if len(pairs) else []
    return pa.table({"grp": pa.array(names.tolist(), pa.int64()), "shared": pa.array(blocks, pa.binary())})


def _deal(texts: pa.Table, shared: pa.Table, n_buckets: int, n_groups: int) -> pa.Table:
    """(bucket, strings, grp, cuts) of a group of documents: strings for their bucket, and cuts that a slice can tell by itself."""
    known = [np.zeros(0, np.uint64)]
    for block in shared.column("shared").to_pylist():
        raw = _unzip(block)
        known.append(np.frombuffer(raw, np.uint32, -1, 8).astype(np.uint64) | U64(int(np.frombuffer(raw, np.int64, 1)[0]) << 32))
    known = np.sort(np.concatenate(known))
    out: dict[str, list] = {"bucket": [], "strings": [], "grp": [], "cuts": []}
    rows = [(i, t) for block in texts.column("texts").to_pylist() for row in pa.ipc.open_stream(_unzip(block)) for i, t in zip(row.column(0).to_pylist(), row.column(1).to_pylist(), strict=True) if i is not None]
    for i, j in slices([t for _, t in rows], SLICE):
        ids, slice_texts = np.array([r[0] for r in rows[i:j]], np.int64), [r[1] for r in rows[i:j]]
        made = window_runs(slice_texts)
        if made is None:
            continue
        buf, start, size, text, at, mark, place, _ = made
        keep = place == 255
        for arm in _arms(buf, start, size, place, n_buckets):
            slot = np.searchsorted(known, arm)
            keep |= (arm > 0) & (known[np.minimum(slot, len(known) - 1)] == arm if len(known) else False)
        if not keep.any():
            continue
        start, size, text, at, mark, place = (x[keep] for x in (start, size, text, at, mark, place))
        keys = np.fromiter((text_key(t) for t in slice_texts), np.uint64, len(slice_texts))
        same = _hash_spans(buf, start, size)
        order = np.lexsort((at, ids[text], same))
        head = np.ones(len(order), bool)
        head[1:] = same[order][1:] != same[order][:-1]
        lowest = ids[text[order]][head][np.cumsum(head) - 1]
        later = ids[text[order]] > lowest
        gone, kept = order[later], order[~later]
        groups, cuts = _cut_rows(ids[text[gone]], keys[text[gone]], at[gone], at[gone] + size[gone], n_groups)
        out["bucket"] += [g % n_buckets for g in groups]
        out["strings"] += [None] * len(groups)
        out["grp"] += groups
        out["cuts"] += cuts
        head = head[~later]
        bucket = ((mark >> U64(32)) % U64(n_buckets)).astype(np.int64)
        one, counts = kept[head], np.bincount(np.cumsum(head) - 1)  # occurrences of a string lie together
        firsts = np.cumsum(counts) - counts
        by_bucket = np.lexsort((mark[one], bucket[one]))
        names, cut = np.unique(bucket[one][by_bucket], return_index=True)
        for name, lo, hi in zip(names.tolist(), cut, [*cut[1:], len(by_bucket)], strict=True):
            mine = by_bucket[lo:hi]
            s = one[mine]
            occ = kept[_spans_of(firsts[mine], counts[mine])]
            docs_here, doc = np.unique(text[occ], return_inverse=True)
            raw = np.array([len(s), len(occ), len(docs_here)], np.int64).tobytes() + ids[docs_here].tobytes() + keys[docs_here].tobytes()
            raw += np.diff(mark[s].astype(np.uint32), prepend=np.uint32(0)).tobytes() + size[s].astype(np.uint8).tobytes() + place[s].astype(np.uint8).tobytes() + counts[mine].astype(np.int32).tobytes()
            raw += doc.astype(np.int32).tobytes() + at[occ].astype(np.int32).tobytes() + buf[_spans_of(start[s], size[s])].tobytes()
            out["bucket"].append(name)
            out["strings"].append(_zip(raw))
            out["grp"].append(None)
            out["cuts"].append(None)
    kinds = {"bucket": pa.int64(), "strings": pa.binary(), "grp": pa.int64(), "cuts": pa.binary()}
    return pa.table({k: pa.array(v, kinds[k]) for k, v in out.items()})


def _read_block(block: bytes) -> dict[str, np.ndarray]:
    raw = _unzip(block)
    n, m, d = np.frombuffer(raw, np.int64, 3).tolist()
    at, out = 24, {}
    for name, kind, count in (("ids", np.int64, d), ("keys", np.uint64, d), ("mark", np.uint32, n), ("size", np.uint8, n), ("place", np.uint8, n), ("count", np.int32, n), ("doc", np.int32, m), ("at", np.int32, m)):
        out[name] = np.frombuffer(raw, kind, count, at)
        at += out[name].nbytes
    out["bytes"] = np.frombuffer(raw, np.uint8, -1, at)
    out["mark"] = np.cumsum(out["mark"], dtype=np.uint32)
    return out


def column_sort(buf: np.ndarray, start: np.ndarray, size: np.ndarray, cap: int = WINDOW, least: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All suffixes of the strings in order: (string, suffix length, common prefix with the one before, up to cap).

    Column-wise construction: round j inserts the suffix of length j of each string that has one. A row of the stream is
    owner * 128 + length; beside it run its common prefix and the transform, the symbol before the suffix (0: none).
    Common prefixes are kept up in rounds from least on; below, suffixes are shorter than any prefix that counts.
    """
    n = len(start)
    words = _words(buf)
    present = np.flatnonzero(np.bincount(buf, minlength=256))
    code = np.zeros(256, np.uint8)
    code[present] = np.arange(1, len(present) + 1)  # keeps order; leaves 0 free (at most 243 byte values occur in UTF-8)
    text = code[buf]
    stream, bwt, prefix = np.arange(n, dtype=np.uint32) << 7, text[start + size - 1], np.zeros(n, np.uint8)
    active, place = np.arange(n), np.arange(n)

    def common(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Common prefix of the suffixes of two arrays of rows, up to cap."""
        most = np.full(len(left), cap)
        at = []
        for rows in (left, right):
            owner, length = (rows >> 7).astype(np.int64), (rows & 127).astype(np.int64)
            most = np.minimum(most, length)
            at.append(start[owner] + size[owner] - length)
        out, open_ = np.zeros(len(left), np.int64), np.flatnonzero(most > 0)
        for done in range(0, cap, 8):
            differ = words[at[0][open_] + done] ^ words[at[1][open_] + done]
            same = differ == 0
            low = (differ & (~differ + U64(1))).astype(np.float64)
            equal = np.where(same, 8, (np.frexp(low)[1] - 1) >> 3)
            out[open_] = np.minimum(done + equal, most[open_])
            open_ = open_[same]
            open_ = open_[most[open_] > done + 8]
            if not len(open_):
                break
        return out

    for j in range(1, int(size.max(initial=0)) + 1):
        keep = size[active] >= j
        active, place = active[keep], place[keep]
        # rows in the stable order of their symbols are the suffixes of the next stream; the n empty ones come first
        order = np.argsort(bwt, kind="stable")
        rank = np.empty(len(bwt), np.int32)
        rank[order] = np.arange(len(bwt), dtype=np.int32)
        place = rank[place].astype(np.int64) + (n - np.count_nonzero(bwt == 0))
        order = np.argsort(place)
        active, place = active[order], place[order]
        old = np.ones(len(stream) + len(place), bool)
        old[place] = False
        at = np.flatnonzero(old)
        previous = np.where(size[active] > j, text[np.maximum(start[active] + size[active] - j - 1, 0)], 0)
        rows, symbols = np.empty(len(old), np.uint32), np.empty(len(old), np.uint8)
        rows[at], rows[place] = stream, active << 7 | j
        symbols[at], symbols[place] = bwt, previous
        stream, bwt = rows, symbols
        if j >= least:
            follows = place[np.concatenate([place[1:] != place[:-1] + 1, [place[-1] + 1 < len(stream)]])] + 1
            changed = np.concatenate([place, follows])
            merged = np.zeros(len(stream), np.uint8)
            merged[at] = prefix
            prefix = merged
            prefix[changed] = common(stream[changed - 1], stream[changed])
        elif j + 1 == least:
            prefix = np.zeros(len(stream), np.uint8)
    return (stream >> 7).astype(np.int64), (stream & 127).astype(np.int64), prefix.astype(np.int64)


def _shared(key: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """True where rows of equal key have more than one document; lo and hi: the smallest and largest of each row."""
    _, group = np.unique(key, return_inverse=True)
    least, most = np.full(group.max(initial=-1) + 1, np.iinfo(np.int64).max), np.full(group.max(initial=-1) + 1, np.iinfo(np.int64).min)
    np.minimum.at(least, group, lo)
    np.maximum.at(most, group, hi)
    return (least < most)[group]


def _overlapping(text: np.ndarray, start: np.ndarray, size: np.ndarray, place: np.ndarray, mark: np.ndarray) -> np.ndarray:
    """The strings (all different) that may share a window with another: same minimizer and an arm in common."""
    _, kin, many = np.unique(mark, return_inverse=True, return_counts=True)
    unsure = np.zeros(len(many), bool)
    unsure[kin[place == 255]] = True  # its strings are compared whatever their arms
    out = unsure[kin]
    for begin, fits in ((place, size - place >= K + ARM), (place - ARM, place >= ARM)):
        has = np.flatnonzero(fits & (place < 255))
        arm = _hash_spans(text, start[has] + begin[has], np.full(len(has), K + ARM))
        _, twin, count = np.unique(arm, return_inverse=True, return_counts=True)
        out[has[count[twin] > 1]] = True
    return np.flatnonzero(out & (many[kin] > 1))


def _solve(table: pa.Table, n_groups: int) -> pa.Table:
    """(grp, cuts) of one bucket."""
    passed = table.filter(table.column("cuts").is_valid())
    groups, cuts = passed.column("grp").to_pylist(), passed.column("cuts").to_pylist()
    parts = [_read_block(b) for b in table.column("strings").to_pylist() if b is not None]
    if parts:
        sizes = np.concatenate([p["size"] for p in parts]).astype(np.int64)
        mark, place = (np.concatenate([p[k] for p in parts]) for k in ("mark", "place"))
        text = np.concatenate([p["bytes"] for p in parts])
        start = np.cumsum(sizes) - sizes
        count = np.concatenate([p["count"] for p in parts]).astype(np.int64)
        ids, keys = (np.concatenate([p[k][p["doc"]] for p in parts]) for k in ("ids", "keys"))
        at = np.concatenate([p["at"] for p in parts]).astype(np.int64)
        first = np.cumsum(count) - count
        doc = ids[first]  # all occurrences of a string that a block holds are of one document
        live = np.flatnonzero(_shared(mark, doc, doc))
    if parts and len(live):
        same = _hash_spans(text, start[live], sizes[live])
        _, one, string = np.unique(same, return_index=True, return_inverse=True)
        least = np.full(len(one), np.iinfo(np.int64).max)
        np.minimum.at(least, string, doc[live])
        size, origin = sizes[live[one]], start[live[one]]
        n_windows = size - WINDOW + 1
        slot = np.cumsum(n_windows) - n_windows
        winner = np.repeat(least, n_windows)
        sort = _overlapping(text, origin, size, place[live[one]].astype(np.int64), mark[live[one]])
        if len(sort):
            body = text[_spans_of(origin[sort], size[sort])]
            owner, length, prefix = column_sort(body, np.cumsum(size[sort]) - size[sort], size[sort], least=WINDOW)
            full = np.flatnonzero(length >= WINDOW)
            _, group = np.unique(np.cumsum(prefix < WINDOW)[full], return_inverse=True)
            owner, length = sort[owner[full]], length[full]
            lowest = np.full(group.max(initial=-1) + 1, np.iinfo(np.int64).max)
            np.minimum.at(lowest, group, least[owner])
            winner[slot[owner] + size[owner] - length] = lowest[group]
        # windows of each occurrence, removed where a smaller document has them
        occ = _spans_of(first[live], count[live])
        s = np.repeat(string, count[live])
        w = _spans_of(slot[s], n_windows[s])
        who = np.repeat(occ, n_windows[s])
        lo = at[who] + (w - np.repeat(slot[s], n_windows[s]))
        gone = winner[w] < ids[who]
        g, c = _cut_rows(ids[who][gone], keys[who][gone], lo[gone], lo[gone] + WINDOW, n_groups)
        groups, cuts = groups + g, cuts + c
    return pa.table({"grp": pa.array(groups, pa.int64()), "cuts": pa.array(cuts, pa.binary())})


def _text_blocks(docs: DataFrame, text_col: str, id_col: str, n_groups: int) -> DataFrame:
    """(grp, texts): the documents of each group, compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), text_bytes(batch.column(1))
            group = _group_of(np.array([-1 if i is None else i for i in ids], np.int64), n_groups)
            names, blocks = np.unique(group).tolist(), []
            for g in names:
                mine = np.flatnonzero(group == g)
                table = pa.record_batch({"id": pa.array([ids[i] for i in mine], pa.int64()), "text": pa.array([texts[i] for i in mine], pa.large_binary())})
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, table.schema) as out:
                    out.write_batch(table)
                blocks.append(_zip(sink.getvalue().to_pybytes()))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(blocks, pa.binary())], ["grp", "texts"])

    return docs.select(id_col, text_col).mapInArrow(run, "grp long, texts binary")


def _cut(texts: pa.Table, cuts: pa.Table) -> Iterator[tuple]:
    """(id, bytes, spans, kept bytes) of each document of a group; spans are maximal removed ranges."""
    found: dict[tuple[int, int], list] = {}
    parts = [_unpack_cuts(c) for c in cuts.column("cuts").to_pylist()]
    if parts:
        ids, keys, lo, hi = (np.concatenate([p[k] for p in parts]) for k in range(4))
        order = np.lexsort((lo, keys, ids))
        ids, keys, lo, hi = ids[order], keys[order], lo[order], hi[order]
        first = np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]) | (keys[1:] != keys[:-1])])) if len(ids) else []
        for a, b in zip(first, [*first[1:], len(ids)], strict=True):
            found[int(ids[a]), int(keys[a])] = [lo[a:b], hi[a:b]]
    for block in texts.column("texts").to_pylist():
        for row in pa.ipc.open_stream(_unzip(block)):
            for id_, text in zip(row.column(0).to_pylist(), row.column(1).to_pylist(), strict=True):
                own = found.get((id_, text_key(text))) if id_ is not None and found else None
                if own is None:
                    yield id_, text, [], text
                    continue
                lo, hi = own[0], np.maximum.accumulate(own[1])
                new = np.concatenate([[True], lo[1:] > hi[:-1]])
                spans = list(zip(lo[new].tolist(), hi[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(hi) - 1]])].tolist(), strict=True))
                edges = [0, *(x for s in spans for x in s), len(text)]
                yield id_, text, spans, b"".join(text[a:b] for a, b in zip(edges[0::2], edges[1::2], strict=True))


def dedup_substrings(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, spans, kept) for each row: spans are [start, end) byte ranges, kept is binary."""
    size = total_bytes(docs, text_col)[1]
    n_buckets, n_groups = max(16, size // BUCKET_BYTES), max(8, size // GROUP_BYTES)
    texts = _text_blocks(docs, text_col, id_col, n_groups)
    shared = _mark(docs, text_col, id_col, n_buckets, n_groups).groupBy("bucket").applyInArrow(_repeated, "grp long, shared binary")
    dealt = texts.groupBy("grp").cogroup(shared.groupBy("grp")).applyInArrow(lambda t, k: _deal(t, k, n_buckets, n_groups), "bucket long, strings binary, grp long, cuts binary")
    solved = dealt.groupBy("bucket").applyInArrow(lambda t: _solve(t, n_groups), "grp long, cuts binary")

    def finish(texts: pa.Table, cuts: pa.Table) -> pa.Table:
        rows = list(_cut(texts, cuts))
        return pa.table({
            "doc_id": pa.array([r[0] for r in rows], pa.int64()),
            "n_bytes": pa.array([len(r[1]) for r in rows], pa.int64()),
            "n_removed": pa.array([len(r[1]) - len(r[3]) for r in rows], pa.int64()),
            "n_spans": pa.array([len(r[2]) for r in rows], pa.int64()),
            "spans": pa.array([[{"start": a, "end": b} for a, b in r[2]] for r in rows], pa.list_(pa.struct({"start": pa.int64(), "end": pa.int64()}))),
            "kept": pa.array([r[3] for r in rows], pa.binary()),
        })

    return texts.groupBy("grp").cogroup(solved.groupBy("grp")).applyInArrow(finish, "doc_id long, n_bytes long, n_removed long, n_spans long, spans array<struct<start: bigint, end: bigint>>, kept binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = dedup_substrings(load(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
