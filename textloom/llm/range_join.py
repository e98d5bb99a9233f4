"""Operator 2: embedding near-dedup by an exact metric range join.

Vectors are scaled to unit length; cosine >= 0.9 is then a Euclidean distance of at most eps = sqrt(2 - 2 * 0.9). Pivots
(a bounded, documented number of vectors, those with the smallest hashes) partition the vectors: each goes to the cell
of its nearest pivot. By the triangle inequality a partner of v lies in cell c only if d(v, c) <= d(v, own) + 2 * eps
and d(v, c) <= radius of c + eps; v is replicated to those of these cells that host its own (of two cells one hosts the
other, so a pair is looked at once). Each cell then joins its own vectors with all that came to it, independently of
other cells.

Equal vectors are collapsed before, so copies cost one row a class. The vectors of a cell lie in packs of at most BLOCK,
each one row of bytes; replicas are packs too, at most one of each pack and cell, and are sent on as they are made. GATHER
packs of a cell meet about as many replicas, in rows, in a task of their own, so no task holds more than that, however many
cells a vector is replicated to. They are joined in tiles of BLOCK by BLOCK; a task emits counts of links and spanning
forests of its tiles, never their pairs, and nothing for vectors without a link; components() joins the forests. In a tile, products in single precision decide all pairs but those within the rounding
error of the threshold, which are worked out in double precision.

Defined results: vectors that are null, empty, of zero length or hold null, NaN or infinite components link with
nothing and form a component alone, as do vectors of a dimension that no other has; equal vectors link with each other;
repeated vec_ids are rows of their own; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import BATCH_BYTES, load, materialize, release
from textloom.llm.components import components

THRESHOLD, MAX_PIVOTS, ROWS_A_PIVOT, BLOCK = 0.9, 256, 8192, 4096
#: Packs of a cell that meet as many rows of replicas in one task; rows of a tile at once.
GATHER, STRIP = 8, 256
PACK = ["ids", "n", "v"]


def valid(column: str):
    """True where a vector takes part: present, without null or non-finite components, not zero."""
    c = F.col(column)
    bad = F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(c.isNotNull() & (F.size(c) > 0) & ~bad & F.exists(c, lambda x: x != 0), F.lit(False))


def vector_key(column: str):
    """A digest that is equal for equal vectors (0 and -0 alike)."""
    return F.sha2(F.array_join(F.transform(column, lambda x: F.when(x == 0, F.lit("0")).otherwise(x.cast("string"))), ","), 256)


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to unit length in double precision; scaled by the largest component first, so nothing overflows."""
    vectors = vectors.astype(np.float64)
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


def rows_a_pack(dim: int) -> int:
    return min(BLOCK, max(64, BATCH_BYTES // (8 * dim)))


def hosts(a, b):
    """Of two different cells or packs exactly one hosts the other, each about half of the others."""
    return (a < b) != ((a + b) % 2 == 1)


def _flat(column: pa.Array, dim: int) -> np.ndarray:
    """Arrow lists of one length as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _forest(left: np.ndarray, right: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Of links (left, right) between places below size, as many as keep what they connect connected: (root, place)."""
    label = np.arange(size)
    while True:
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, label[left], low)
        np.minimum.at(new, label[right], low)
        new = new[new]
        new = np.minimum(new[label], label)
        if (new == label).all():
            break
        label = new
    other = np.flatnonzero(label != np.arange(size))
    return label[other], other


def _pairs(x: np.ndarray, y: np.ndarray, threshold: float, same: bool):
    """Places (p, q) of the rows of x and y with a cosine >= threshold, strip by strip; same: x is y, only p < q."""
    dim = x.shape[1]
    error = (dim + 8) * 2.0**-23  # over what rounding to single precision can change in a product of unit vectors
    a, b = x.astype(np.float32), np.ascontiguousarray(y.T, np.float32)
    room, mask = (np.empty((min(STRIP, len(x)), len(y)), t) for t in (np.float32, bool))
    step = max(1, (1 << 20) // dim)
    for lo in range(0, len(x), STRIP):
        product = np.matmul(a[lo : lo + STRIP], b, out=room[: len(x) - lo])
        if product.max() < threshold - error:
            continue
        near = np.flatnonzero(np.greater_equal(product, threshold - error, out=mask[: len(product)]))
        p, q = near // len(y), near % len(y)
        if same:
            p, q = p[p + lo < q], q[p + lo < q]
        keep = product[p, q] > threshold + error
        p += lo
        unsure = np.flatnonzero(~keep)
        for k in range(0, len(unsure), step):
            some = unsure[k : k + step]
            keep[some] = np.einsum("ij,ij->i", x[p[some]], y[q[some]]) >= threshold
        yield p[keep], q[keep]


def tile(x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray, threshold: float, same: bool):
    """Links of each row of x and of y (n and m: how many vectors a row is), and a forest of (root, place), y's places after x's."""
    links, size = np.zeros(len(x) + len(y), np.int64), len(x) + len(y)
    shift = 0 if same else len(x)
    roots, places = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for p, q in _pairs(x, y, threshold, same):
        links += np.bincount(p, m[q], minlength=size).astype(np.int64)
        links += np.bincount(q + shift, n[p], minlength=size).astype(np.int64)
        r, o = _forest(p, q + shift, size)
        roots.append(r)
        places.append(o)
    return links, *_forest(np.concatenate(roots), np.concatenate(places), size)


def _each(batch: pa.RecordBatch):
    """The rows of a batch, one at a time."""
    for k in range(batch.num_rows):
        yield [c[k].as_py() for c in batch.columns]


def in_batches(rows, schema: pa.Schema):
    """Tuples as record batches of about BATCH_BYTES, the last value of each being the bytes that it holds."""
    held, size = [], 0
    for *row, n in rows:
        held.append(row)
        size += n
        if size >= BATCH_BYTES or len(held) >= 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)


def link_vectors(rows: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id) for each row."""
    spark = rows.sparkSession
    kind = "array<float>" if rows.schema[vector_col].dataType.simpleString() == "array<float>" else "array<double>"
    rows = rows.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast(kind).alias("v"))
    good = rows.filter(valid("v")).withColumn("key", vector_key("v"))
    good = materialize(good, "vectors")
    # one row for each distinct vector: an id of its own, the smallest vec_id and how many rows have it
    classes = good.groupBy("key").agg(F.min("vec_id").alias("name"), F.count(F.lit(1)).alias("n"), F.min("v").alias("v"))
    classes = materialize(classes.withColumn("id", F.xxhash64("key")), "vector-classes")
    total = classes.count()
    eps = math.sqrt(max(2 - 2 * threshold, 0)) * (1 + 1e-9) + 1e-6  # over the rounding of distances near zero, a square root of it
    n_pivots = max(1, min(MAX_PIVOTS, total // ROWS_A_PIVOT))
    chosen = classes.select("v", "key").orderBy(F.xxhash64("key")).limit(n_pivots).collect()  # bounded by MAX_PIVOTS
    by_size: dict[int, list] = {}
    for r in chosen:
        by_size.setdefault(len(r.v), []).append(r.v)
    pivots = spark.sparkContext.broadcast({d: unit(np.array(p, float)) for d, p in by_size.items()})

    def distances(dim: int, v: np.ndarray) -> np.ndarray:
        p = pivots.value.get(dim)
        if p is None:  # no pivot of this dimension: one cell
            return np.zeros((len(v), 1))
        return np.sqrt(np.maximum(2 - 2 * (v @ p.T), 0))

    def assign(batches):
        for batch in batches:
            dims = batch.column("v").value_lengths().to_numpy(zero_copy_only=False)
            for d in np.unique(dims):
                part = batch.filter(pa.array(dims == d))
                far = distances(int(d), unit(_flat(part.column("v"), d)))
                own = far.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("n"), pa.array(np.full(len(own), d, np.int64)), pa.array(own), pa.array(far[np.arange(len(own)), own]), part.column("v")], ["id", "n", "dim", "cell", "d", "v"])

    homes = materialize(classes.select("id", "n", "v").mapInArrow(assign, f"id long, n long, dim long, cell long, d double, v {kind}"), "homes")
    cells = homes.groupBy("dim", "cell").agg(F.max("d").alias("radius"), F.count(F.lit(1)).alias("rows")).collect()  # at most MAX_PIVOTS cells and one a dimension
    cells = [(r.dim, r.cell, r.radius, math.ceil(r.rows / rows_a_pack(r.dim))) for r in cells]
    shared = spark.sparkContext.broadcast({(dim, cell): radius for dim, cell, radius, _ in cells})
    packs = spark.createDataFrame(cells, "dim long, cell long, radius double, packs long").select("dim", "cell", "packs")

    step = {dim: rows_a_pack(dim) for dim, *_ in cells}

    def pack(t: pa.Table) -> pa.Table:
        v = t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        columns = {k: t.column(k)[:1] for k in ("dim", "cell", "part")} | {k: pa.array([c.tobytes()], pa.binary()) for k, c in zip(PACK, (t.column("id").to_numpy(), t.column("n").to_numpy(), v), strict=True)}
        return pa.table(columns)

    packed = homes.join(F.broadcast(packs), ["dim", "cell"]).select("dim", "cell", F.pmod(F.xxhash64("id"), F.col("packs")).alias("part"), "id", "n", "v")
    packed = packed.groupBy("dim", "cell", "part").applyInArrow(pack, "dim long, cell long, part long, ids binary, n binary, v binary")
    packed = materialize(packed, "packs")
    real = np.float32 if kind == "array<float>" else np.float64

    def replicas(dim: int, cell: int, part: int, ids: bytes, n: bytes, v: bytes):
        """Of one pack, for each cell that its vectors are sent to, those that are."""
        i, m, vectors = np.frombuffer(ids, np.int64), np.frombuffer(n, np.int64), np.frombuffer(v, real).reshape(-1, dim)
        far = distances(dim, unit(vectors))
        limit = far[:, cell] + 2 * eps
        for c in range(far.shape[1]):
            radius = shared.value.get((dim, c))
            if c == cell:
                yield dim, c, cell, part, ids, n, v, len(ids) + len(n) + len(v)
            elif radius is not None and hosts(c, cell):
                sent = (far[:, c] <= limit) & (far[:, c] <= radius + eps)
                if sent.all():
                    yield dim, c, cell, part, ids, n, v, len(ids) + len(n) + len(v)
                elif sent.any():
                    out = [x[sent].tobytes() for x in (i, m, vectors)]
                    yield dim, c, cell, part, *out, sum(map(len, out))

    fields = pa.schema([(k, pa.int64()) for k in ("dim", "cell", "from_cell", "from_part")] + [(k, pa.binary()) for k in PACK])

    def visit(batches):
        yield from in_batches((row for batch in batches for row in _each(batch) for row in replicas(*row)), fields)

    sizes = pa.schema([(k, pa.int64()) for k in ("dim", "cell", "rows")])

    def count(batches):
        yield from in_batches(((dim, cell, len(ids) // 8, 24) for batch in batches for row in _each(batch) for dim, cell, _, _, ids, *_ in replicas(*row)), sizes)

    # packs of a cell go to so many groups, replicas that come to it to so many deals: each group meets each deal
    rows_came = {(r.dim, r.cell): r.rows for r in packed.mapInArrow(count, "dim long, cell long, rows long").groupBy("dim", "cell").agg(F.sum("rows").alias("rows")).collect()}
    spread = [(dim, cell, math.ceil(packs / GATHER), math.ceil(rows_came[dim, cell] / (GATHER * rows_a_pack(dim)))) for dim, cell, _, packs in cells]
    spread = F.broadcast(spark.createDataFrame(spread, "dim long, cell long, groups long, deals long"))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    came = packed.mapInArrow(visit, "dim long, cell long, from_cell long, from_part long, ids binary, n binary, v binary").join(spread, ["dim", "cell"])
    came = came.withColumns({"deal": F.pmod(F.xxhash64("from_cell", "from_part"), F.col("deals")), "group": each("groups")})
    own = packed.join(spread, ["dim", "cell"]).withColumns({"group": F.floor(F.col("part") / GATHER), "deal": each("deals")})
    keys = ["dim", "cell", "group", "deal"]

    def join(a: pa.Table, b: pa.Table) -> pa.Table:
        release()
        made = [(np.zeros(0, np.int64),) * 3]
        dim, cell = (t[k][0].as_py() if t.num_rows else 0 for t, k in ((a, "dim"), (a, "cell")))

        def packs_of(t: pa.Table, part: str):
            for k, *columns in zip(*(t[c].to_pylist() for c in (part, *PACK)), strict=True):
                ids, n, v = (np.frombuffer(c, kind) for c, kind in zip(columns, (np.int64, np.int64, real), strict=True))
                yield k, ids, n, v.reshape(-1, dim)

        here = pa.array([c == cell for c in b["from_cell"].to_pylist()], pa.bool_())
        others = list(packs_of(b.filter(here), "from_part"))
        if outer := list(packs_of(b.filter(pc.invert(here)), "from_part")):  # replicas from other cells, which may be small, side by side
            ids, n, v = (np.concatenate(c) for c in list(zip(*outer, strict=True))[1:])
            others += [(None, ids[k : k + step[dim]], n[k : k + step[dim]], v[k : k + step[dim]]) for k in range(0, len(ids), step[dim])]
            del outer
        packs = [(part, ids, n, unit(v), np.zeros(len(ids), np.int64)) for part, ids, n, v in packs_of(a, "part")]
        for other, bi, m, y in others:
            y = unit(y)
            for part, ai, n, x, links in packs:
                # a pack meets the packs of its own cell that it hosts, and itself
                if other is None or other == part or hosts(part, other):
                    found, roots, places = tile(x, y, n, m, threshold, other == part)
                    links += found[: len(ai)]
                    ids, linked = np.concatenate([ai, bi]), np.flatnonzero(found[len(ai) :])
                    made += [(bi[linked], found[len(ai) + linked], bi[linked]), (ids[places], np.zeros(len(places), np.int64), ids[roots])]
        made += [(ai[links > 0], links[links > 0], ai[links > 0]) for _, ai, _, _, links in packs]
        return pa.table(dict(zip(("id", "links", "root"), map(np.concatenate, zip(*made, strict=True)), strict=True)))

    found = own.select(*keys, "part", *PACK).groupBy(*keys).cogroup(came.select(*keys, "from_cell", "from_part", *PACK).groupBy(*keys)).applyInArrow(join, "id long, links long, root long")
    found = materialize(found, "links")
    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    labels = components(found.select(F.col("root").alias("a"), F.col("id").alias("b"))).withColumnRenamed("id", "_id")
    merged = classes.select("key", "id", "name", "n").join(counts, "id", "left").join(labels, F.col("id") == F.col("_id"), "left")
    merged = merged.select("key", "name", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component_id", "id").alias("group"))
    merged = materialize(merged, "vector-groups")
    names = merged.groupBy("group").agg(F.min("name").alias("component_id"))
    merged = merged.join(names, "group").select("key", "n_links", "component_id")
    linked = good.select("vec_id", "key").join(merged, "key").select("vec_id", "n_links", "component_id")
    alone = rows.filter(~valid("v")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = link_vectors(load(spark, sf_dir, "embeddings"))
    return linked.withColumn("kept", F.col("vec_id") == F.col("component_id"))


ORACLE = """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
links AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id
  WHERE list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e)) / sqrt(list_dot_product(b.e, b.e)) >= 0.9),
reach AS (
  WITH RECURSIVE r(id, seen) AS (
    SELECT vec_id, vec_id FROM v UNION SELECT r.id, links.b FROM r JOIN links ON r.seen = links.a) SELECT id, min(seen) AS component_id FROM r GROUP BY id)
SELECT id AS vec_id, (SELECT count(*) FROM links WHERE a = id) AS n_links, component_id, id = component_id AS kept FROM reach
"""
