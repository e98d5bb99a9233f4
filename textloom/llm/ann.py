"""Operator 7: approximate nearest neighbours with score-aware (anisotropic) quantisation.

The squared distance |x|^2 - 2 <q, x> + |q|^2 makes the search one for large inner products. Every row is product-quantised
to four bits for each DIMS components; codebooks are trained on a bounded sample (SAMPLE distinct vectors, those with the
smallest hashes; a documented bound) and codes chosen under the score-aware loss, which weighs the residual's part
parallel to the vector by ETA against the rest. The index holds every row: two codes a byte, the exact squared norm.

Search: index rows lie in blocks of BLOCK rows and queries in blocks of QUERIES; a task scans one pair of blocks with a
table of 256 sums per code byte and query, ranks the KEEP best of the block, what ties with the last of them and all
rows that the tables can't tell apart (near_rows) exactly on the original vectors in double precision, and sends its k
best on. The last step ranks what the blocks sent. Equal vectors are one row of the index, with the k + 1 smallest ids; a search needs no more of them.

Defined results: vectors that are null, empty, zero or hold null or non-finite components take no part, nor do
candidates of another dimension than the query's; distances tie towards the smaller id; fewer candidates than k give them
all; repeated ids are rows of their own; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.llm.common import load, materialize
from textloom.llm.range_join import valid, vector_key

K, EVERY, DIMS, CENTRES, ETA, SAMPLE, BLOCK, QUERIES, KEEP, ROUNDS = 10, 100, 2, 16, 2.6, 8_192, 8_192, 512, 160, 8


class Quantiser:
    """Codebooks (parts, CENTRES, DIMS) over vectors padded to a whole number of parts."""

    def __init__(self, books: np.ndarray, dim: int):
        self.books, self.dim = books, dim

    @staticmethod
    def parts_of(x: np.ndarray) -> np.ndarray:
        n, d = x.shape
        pad = -d % (2 * DIMS)  # an even number of codes: two a byte
        return np.pad(x, ((0, 0), (0, pad))).reshape(n, -1, DIMS)

    @classmethod
    def fit(cls, x: np.ndarray, seed: int = 3) -> Quantiser:
        rng = np.random.default_rng(seed)
        parts = cls.parts_of(x)
        along = parts / np.maximum(np.sqrt((x * x).sum(axis=1)), 1e-300)[:, None, None]  # each part of the unit vector
        books = np.empty((parts.shape[1], CENTRES, DIMS))
        for m in range(parts.shape[1]):
            p, u = parts[:, m], along[:, m]
            centre = p[rng.choice(len(p), CENTRES, replace=len(p) < CENTRES)].copy()
            weight = np.eye(DIMS)[None] + (ETA - 1) * u[:, :, None] * u[:, None, :]
            for _ in range(ROUNDS):
                r = p[:, None] - centre[None]
                loss = (r * r).sum(axis=2) + (ETA - 1) * np.einsum("ncd,nd->nc", r, u) ** 2
                code = loss.argmin(axis=1)
                for c in range(CENTRES):
                    w = weight[code == c]
                    if len(w):  # the minimum of the weighted loss, in closed form
                        centre[c] = np.linalg.solve(w.sum(axis=0), np.einsum("nij,nj->i", w, p[code == c]))
            books[m] = centre
        return cls(books, x.shape[1])

    def encode(self, x: np.ndarray) -> np.ndarray:
        """Codes (rows, parts) under the score-aware loss of whole vectors, by one sweep of coordinate descent."""
        parts = self.parts_of(x)
        along = parts / np.maximum(np.sqrt((x * x).sum(axis=1)), 1e-300)[:, None, None]
        r = parts[:, :, None] - self.books[None]  # rows, parts, centres, dims
        square = (r * r).sum(axis=3)
        parallel = np.einsum("nmcd,nmd->nmc", r, along)
        code = (square + (ETA - 1) * parallel**2).argmin(axis=2)
        rows = np.arange(len(x))
        total = np.take_along_axis(parallel, code[:, :, None], 2)[:, :, 0].sum(axis=1)
        for m in range(parts.shape[1]):
            rest = total - parallel[rows, m, code[:, m]]
            code[:, m] = (square[:, m] + (ETA - 1) * (rest[:, None] + parallel[:, m]) ** 2).argmin(axis=1)
            total = rest + parallel[rows, m, code[:, m]]
        return code.astype(np.uint8)

    def decode(self, code: np.ndarray) -> np.ndarray:
        """The vectors that unpacked codes stand for (padded)."""
        return self.books[np.arange(len(self.books)), code].reshape(len(code), -1)

    def pack(self, code: np.ndarray) -> np.ndarray:
        return code[:, 0::2] | (code[:, 1::2] << 4)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """(queries, bytes, 256): the inner product of a query with what each code byte stands for."""
        single = np.einsum("qmd,mcd->qmc", self.parts_of(q), self.books)
        return (single[:, 1::2, :, None] + single[:, 0::2, None, :]).reshape(len(q), -1, 256).astype(np.float32)


def near_rows(model: Quantiser | None, own: np.ndarray, x: np.ndarray, code: np.ndarray, hat: np.ndarray, err: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and exact distances of the rows of a block that are ranked exactly for one query.

    These are the KEEP (twice k, if that is more) best by the tables and all that tie with the last, and every row that may lie nearer to the query
    than to its own code (and than the k-th found): such rows the tables can't tell apart, as in a group of near copies.
    """
    keep = max(KEEP, 2 * (k + 1))
    if model is None or len(x) <= keep:
        pick = np.arange(len(x))
        return pick, np.sqrt(((x - own) ** 2).sum(axis=1))
    table = model.tables(own[None])[0]
    inner = np.zeros(len(x), np.float32)
    for b in range(code.shape[1]):
        inner += table[b][code[:, b]]
    near = (x * x).sum(axis=1) - 2.0 * inner
    pick = np.flatnonzero(near <= np.partition(near, keep - 1)[keep - 1])
    exact = np.sqrt(((x[pick] - own) ** 2).sum(axis=1))
    bar = np.partition(exact, k)[k]
    far = np.sqrt(np.maximum(own @ own - 2.0 * inner + hat, 0))
    more = np.setdiff1d(np.flatnonzero(far <= (err + np.minimum(bar, err)) * 1.0001 + 1e-6), pick, assume_unique=True)
    return np.concatenate([pick, more]), np.concatenate([exact, np.sqrt(((x[more] - own) ** 2).sum(axis=1))])


def fit_quantisers(classes: DataFrame) -> dict[int, Quantiser]:
    rows = classes.select("v", "key").orderBy(F.xxhash64("key")).limit(SAMPLE).collect()  # bounded by SAMPLE
    by_size: dict[int, list] = {}
    for r in rows:
        by_size.setdefault(len(r.v), []).append(r.v)
    return {d: Quantiser.fit(np.array(v, float)) for d, v in by_size.items()}


def build_index(rows: DataFrame, keep_ids: int, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, object]:
    """The index (ids, v, code, dim, key) of all rows, and the broadcast quantisers."""
    good = rows.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("v")).filter(valid("v")).withColumn("key", vector_key("v"))
    few = good.withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy("vec_id"))).filter(F.col("n") <= keep_ids)  # limited within tasks before the shuffle
    classes = materialize(few.groupBy("key").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"), F.min("v").alias("v")), "ann-classes")
    shared = rows.sparkSession.sparkContext.broadcast(fit_quantisers(classes))
    kind = classes.schema["v"].dataType.simpleString()

    def encode(parts):
        for pdf in parts:
            sizes = pdf.v.map(len).to_numpy()
            for d in np.unique(sizes):
                part = pdf[sizes == d]
                q = shared.value.get(d)
                x = np.stack(part.v.to_numpy()).astype(float)
                if q is None:  # no vector of this dimension in the sample: searched without tables
                    yield pd.DataFrame({"key": part.key, "ids": part.ids, "v": part.v, "dim": d, "code": b"", "hat": 0.0, "err": 0.0})
                    continue
                code = q.encode(x)
                hat = q.decode(code)
                err = np.sqrt(((np.pad(x, ((0, 0), (0, hat.shape[1] - d))) - hat) ** 2).sum(axis=1))
                yield pd.DataFrame({"key": part.key, "ids": part.ids, "v": part.v, "dim": d, "code": [c.tobytes() for c in q.pack(code)], "hat": (hat * hat).sum(axis=1), "err": err})

    return classes.mapInPandas(encode, f"key string, ids array<long>, v {kind}, dim long, code binary, hat double, err double"), shared


def search(rows: DataFrame, queries: DataFrame, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows found for each query, the query's own row left out."""
    index, shared = build_index(rows, k + 1, id_col, vector_col)
    index = materialize(index, "ann-index")
    asked = materialize(queries.select(F.col(id_col).alias("query_id"), F.col(vector_col).alias("q")).filter(valid("q")).withColumn("dim", F.size("q").cast("long")), "ann-queries")
    n_rows, n_queries = index.count(), asked.count()
    row_blocks, query_blocks = max(1, -(-n_rows // BLOCK)), max(1, -(-n_queries // QUERIES))
    left = index.withColumn("rb", F.pmod(F.xxhash64("key"), F.lit(row_blocks))).withColumn("qb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(query_blocks - 1).cast("long"))))
    right = asked.withColumn("qb", F.pmod(F.xxhash64("query_id"), F.lit(query_blocks))).withColumn("rb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(row_blocks - 1).cast("long"))))
    keys = ["dim", "rb", "qb"]

    def scan(part: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": [], "vec_id": [], "score": []}
        if len(part) and len(asked):
            x = np.stack(part.v.to_numpy()).astype(float)
            q = np.stack(asked.q.to_numpy()).astype(float)
            model = shared.value.get(int(part["dim"].iloc[0]))
            code = np.frombuffer(b"".join(part.code), np.uint8).reshape(len(part), -1)
            hat, err = part.hat.to_numpy(), part.err.to_numpy()
            for own, ids in zip(q, asked.query_id, strict=True):
                pick, exact = near_rows(model, own, x, code, hat, err, k)
                if len(pick) > k + 1:  # classes that can still reach the first k
                    edge = np.partition(exact, k)[k]
                    pick, exact = pick[exact <= edge], exact[exact <= edge]
                held = [(d, v) for d, p in zip(exact, pick, strict=True) for v in part.ids.iloc[p] if v != ids]
                for d, v in sorted(held)[:k]:
                    out["query_id"].append(ids)
                    out["vec_id"].append(v)
                    out["score"].append(d)
        return pd.DataFrame({c: pd.Series(v, dtype="float64" if c == "score" else "int64") for c, v in out.items()})

    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(scan, "query_id long, vec_id long, score double")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "embeddings")
    return search(rows, rows.filter(F.col("vec_id") % EVERY == 0))
