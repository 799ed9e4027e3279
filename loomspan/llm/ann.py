"""Approximate nearest neighbours by randomly rotated one-bit codes.

A vector's residual to the centroid of its list is rotated by a random orthogonal matrix and
kept as the signs of its components, packed in bits, with two correction scalars: its norm
and the inner product of the unit residual with its own code.  From a query's rotated
residual, the code gives an unbiased estimate of the inner product, and the second scalar
bounds its error; so each squared distance has an estimate and a lower bound.  The exact
distances of the best estimates give a k-th distance, and every vector whose lower bound
isn't above it is reranked by its exact distance in double precision.

Lists.  Centroids are fitted to a bounded sample (SAMPLE vectors); every vector is in the
list of its nearest centroid.  There are about sqrt(n) / 2 lists, and each query searches
the `share` of them whose centroids are nearest.  A list is cut into chunks of CHUNK vectors, so a
large one, as of many equal vectors, is searched by as many tasks; each gives its k nearest.
Queries travel to the chunks in blocks of ASKED, and each block meets each chunk of a list.

Nulls: vectors that are null, zero or hold null or non-finite components take no part, nor do
those whose length isn't the most frequent one of the others.  Finite components may be as
large as a float can be: estimates are made in parts of the largest component, distances in
double precision.  Equal distances are ordered by the smaller id.  Rows with one id are
vectors of their own: each is a query if its id is, and a candidate of the others.  Fewer
candidates than k: all that were found.  An empty table gives no rows.  Other columns are
dropped, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import prepare
from .common import arrow_pass, save

SAMPLE, CHUNK, ASKED, ERROR = 20_000, 2048, 4096, 2.5


def usable(v: Column, dim: Column | int) -> Column:
    """Whether a vector takes part."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(v) == dim) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def rotation(dim: int, seed: int = 7) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def fit_centroids(sample: np.ndarray, lists: int, rounds: int = 8, seed: int = 11) -> np.ndarray:
    """Lloyd's algorithm; an empty list keeps its centroid."""
    rng = np.random.default_rng(seed)
    centroids = sample[rng.choice(len(sample), min(lists, len(sample)), replace=False)].astype(np.float64)
    for _ in range(rounds):
        own = nearest(sample, centroids, 1)[:, 0]
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, sample)
        n = np.bincount(own, minlength=len(centroids))
        centroids[n > 0] = sums[n > 0] / n[n > 0, None]
    return centroids


def nearest(x: np.ndarray, centroids: np.ndarray, k: int) -> np.ndarray:
    d = (centroids**2).sum(1) - 2 * x @ centroids.T
    if k == 1:
        return d.argmin(1)[:, None]
    k = min(k, len(centroids))
    return np.argsort(d, axis=1, kind="stable")[:, :k]


def encode(residuals: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rotated residuals -> packed signs, norms, and inner products of unit residual and unit code."""
    norm = np.linalg.norm(residuals, axis=1)
    inner = np.abs(residuals).sum(1) / np.maximum(norm, 1e-30) / np.sqrt(residuals.shape[1])
    return np.packbits(residuals > 0, axis=1), norm, np.where(norm > 0, inner, 1.0)


def estimate(queries: np.ndarray, codes: np.ndarray, norm: np.ndarray, inner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances of rotated query residuals (rows) to coded residuals (columns): estimates and lower bounds."""
    dim = queries.shape[1]
    signs = np.unpackbits(codes, axis=1, count=dim).astype(np.float32)
    unit = max(np.abs(queries).max(initial=0.0), 1e-300)  # single precision holds parts of it
    products = ((queries / unit).astype(np.float32) @ signs.T).astype(np.float64) * (2 * unit)
    products = (products - queries.sum(1, keepdims=True)) / np.sqrt(dim)
    length = np.linalg.norm(queries, axis=1, keepdims=True)
    guess = norm**2 + length**2 - products * (2 * norm / inner)
    error = ERROR / np.sqrt(max(1, dim - 1)) * np.sqrt(np.maximum(0, 1 - inner**2)) / inner
    return guess, guess - length * (2 * norm * error)


def search_chunk(rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray, coded: tuple, centroid: np.ndarray, turned: np.ndarray, q_rows: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query rows, ids and distances of each query's k nearest of a chunk; a query's own row is none of them.

    The 4 k vectors of the smallest estimates give the k-th distance; every other vector
    whose lower bound isn't above it is reranked too.
    """
    guesses, bounds = estimate((queries - centroid) @ turned, *coded)
    out = []
    for q, v, guess, bound in zip(q_rows, queries, guesses, bounds, strict=True):
        other = rows != q
        guess[~other] = np.inf
        first = np.argpartition(guess, 4 * k)[: 4 * k] if len(guess) > 4 * k else np.arange(len(guess))
        first = first[other[first]]
        d = ((vectors[first] - v) ** 2).sum(1)
        worst = np.partition(d, k - 1)[k - 1] if len(d) > k else np.inf
        more = (bound <= worst * (1 + 1e-6)) & other
        more[first] = False
        more = np.flatnonzero(more)
        at = np.concatenate([first, more])
        d = np.sqrt(np.concatenate([d, ((vectors[more] - v) ** 2).sum(1)]))
        best = np.lexsort((ids[at], d))[:k]
        out.append((np.full(len(best), q), ids[at][best], d[best]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def neighbours(spark: SparkSession, rows: DataFrame, is_query: Column, k: int = 10, share: float = 0.8, max_lists: int = 4096) -> DataFrame:
    """rows (vec_id, embedding) -> query_id, rank, vec_id, score (Euclidean distance)."""
    prepare(spark)
    rows = rows.select("vec_id", F.col("embedding").cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = rows.filter(F.col("vec_id").isNotNull() & usable(F.col("v"), F.size("v"))).withColumn("row", F.monotonically_increasing_id())
    rows = save(spark, rows, "ann-rows")  # the rows' numbers stay as they are
    common = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    if common is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, n = common["dim"], common["count"]
    rows = rows.filter(F.size("v") == dim)
    sample = np.array([r[0] for r in rows.orderBy(F.xxhash64("vec_id", "v")).limit(min(SAMPLE, 40 * max_lists)).select("v").collect()])
    lists = int(min(max_lists, max(1, np.sqrt(n) / 2)))
    centroids = fit_centroids(sample, lists)
    turned = rotation(dim)

    def place(each_k: int):
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            x = batch["v"].flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            near = [nearest(x[a : a + 1024], centroids, each_k) for a in range(0, len(x), 1024)]
            near = np.concatenate(near) if near else np.zeros((0, 1), np.int64)
            at = np.repeat(np.arange(len(x)), near.shape[1])
            at = pa.array(at)
            out = [batch["row"].take(at), batch["vec_id"].take(at), pa.array(near.ravel().astype(np.int32)), batch["v"].take(at)]
            return pa.RecordBatch.from_arrays(out, names=["row", "vec_id", "list", "v"])

        return each

    schema = "row long, vec_id long, list int, v array<double>"
    index = save(spark, arrow_pass(rows, place(1), schema), "ann-index")
    asked = save(spark, arrow_pass(rows.filter("asks"), place(max(1, round(share * lists))), schema), "ann-asked")
    blocks = lambda x, size, name: x.groupBy("list").agg(F.ceil(F.count("*") / size).cast("int").alias(name))
    sizes = blocks(index, CHUNK, "chunks").join(blocks(asked, ASKED, "parts"), "list")  # a row a list: at most max_lists
    dealt = lambda x, own, other: (
        x.join(F.broadcast(sizes), "list")
        .withColumn(own[:-1], F.pmod(F.xxhash64("row"), F.col(own)).cast("int"))
        .withColumn(other[:-1], F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
        .drop(own, other)
    )
    index, asked = dealt(index, "chunks", "parts"), dealt(asked, "parts", "chunks")

    kinds = pa.schema([("query_row", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def search(key: tuple, base: pa.Table, asked: pa.Table) -> pa.Table:
        out = [kinds.empty_table()]
        if base.num_rows and asked.num_rows:
            matrix = lambda x: x["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            own, ids, vectors, centroid = base["row"].to_numpy(), base["vec_id"].to_numpy(), matrix(base), centroids[key[0].as_py()]
            coded = encode((vectors - centroid) @ turned)
            q_rows, queries = asked["row"].to_numpy(), matrix(asked)
            names = dict(zip(q_rows.tolist(), asked["vec_id"].to_pylist(), strict=True))
            for a in range(0, len(q_rows), 256):
                q, near, d = search_chunk(own, ids, vectors, coded, centroid, turned, q_rows[a : a + 256], queries[a : a + 256], k)
                out.append(pa.Table.from_arrays([pa.array(q), pa.array([names[x] for x in q.tolist()], pa.int64()), pa.array(near), pa.array(d)], schema=kinds))
        return pa.concat_tables(out)

    found = index.groupBy("list", "chunk", "part").cogroup(asked.groupBy("list", "chunk", "part")).applyInArrow(search, "query_row long, query_id long, vec_id long, score double")
    order = Window.partitionBy("query_row").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
