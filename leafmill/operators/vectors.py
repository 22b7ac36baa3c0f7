"""Vectors: normalising, exact search, filtered search, statistics. V-numbers are the survey's."""

from __future__ import annotations

import functools
import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

DIMENSION = 64
OVERFETCH = 5


def hash_embedding(text: str, dimension: int = DIMENSION) -> list[float]:
    """The default embedder: a bag of hashed words, of unit length. Deterministic, and no more than a stand-in for a model."""
    v = np.zeros(dimension, np.float64)
    for word in text.lower().split():
        h = zlib.crc32(word.encode())
        v[h % dimension] += 1.0 if h & 0x80000000 else -1.0
    n = np.linalg.norm(v)
    return (v / n if n else v).astype(np.float32).tolist()


def embed(text: Column, embedder: Callable[[str], list[float]] = hash_embedding, unit: bool = False) -> Column:
    """V1, V2: an embedding for each text, in Arrow batches; any function from a string to numbers fits. With ``unit`` V4
    follows at once, as a Python result cannot go through a higher-order function in the same plan node."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(texts: pd.Series) -> pd.Series:
        made = [None if t is None else np.asarray(embedder(t), np.float64) for t in texts]
        if unit:
            made = [v if v is None or not (n := np.linalg.norm(v)) else v / n for v in made]
        return pd.Series([None if v is None else v.astype(np.float32) for v in made], dtype=object)

    return run(text)


@functools.lru_cache(maxsize=1024)
def query_embedding(text: str) -> tuple[float, ...]:
    """V3: the embedding of a query, of unit length, kept for the next time."""
    v = np.asarray(hash_embedding(text), np.float64)
    n = np.linalg.norm(v)
    return tuple((v / n if n else v).tolist())


def _as_double(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(_as_double(v), F.lit(0.0), lambda s, x: s + x * x))


def normalized(v: Column) -> Column:
    """V4: unit length; a zero vector stays zero."""
    n = norm(v)
    return F.transform(_as_double(v), lambda x: F.when(n > 0, x / n).otherwise(x))


def inner_product(a: Column, b: Column) -> Column:
    """V5, in the JVM, though its higher-order functions are interpreted element by element; null for vectors of different
    lengths. Many queries at once go through ``knn_many``, which multiplies matrices."""
    return F.aggregate(F.zip_with(_as_double(a), _as_double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def squared_distance(a: Column, b: Column) -> Column:
    """V6."""
    return F.aggregate(F.zip_with(_as_double(a), _as_double(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def array_literal(values) -> Column:
    """A vector as one literal expression, in one call whatever its length."""
    numbers = [float(x) for x in values]
    if not all(map(math.isfinite, numbers)):
        raise ValueError("a query vector must have finite numbers only")
    return F.expr("array(" + ", ".join(f"{x!r}D" for x in numbers) + ")") if numbers else F.array().cast("array<double>")


def scored(vectors: DataFrame, query: Column | list[float] | tuple[float, ...], metric: str = "ip", vector_col: str = "embedding") -> DataFrame:
    """Every vector with its score against one query vector, given as an array literal; rows without a score are dropped."""
    q = query if isinstance(query, Column) else array_literal(query)
    v = F.col(vector_col)
    score = {"ip": lambda: inner_product(v, q), "cosine": lambda: inner_product(normalized(v), q), "l2": lambda: squared_distance(v, q)}[metric]()
    return vectors.withColumn("score", score).filter(F.col("score").isNotNull() & ~F.isnan("score"))


def knn(vectors: DataFrame, query, k: int, metric: str = "ip", id_col: str = "idx", vector_col: str = "embedding") -> DataFrame:
    """V7: the k best by score, ties by id: a bounded heap in every task, then one merge."""
    if k < 1:
        raise ValueError("k must be at least 1")
    best = F.asc("score") if metric == "l2" else F.desc("score")
    return scored(vectors, query, metric, vector_col).select(id_col, "score").orderBy(best, id_col).limit(k)


#: Bytes of packed query vectors that may go to every task; more queries meet the vectors in blocks.
QUERY_BYTES = 32 << 20
#: Vectors of a block, and queries of a block, where the queries are too many to be sent.
BLOCK = 100_000


def _matrix(lists: pa.Array, dimension: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, matrix) of the vectors that have ``dimension`` numbers and no null among them."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    fits = (pc.fill_null(pc.list_value_length(lists), -1).to_numpy(zero_copy_only=False) == dimension).nonzero()[0]
    flat = lists.take(pa.array(fits)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dimension)
    whole = ~np.isnan(flat).any(axis=1)
    return fits[whole], flat[whole]


def _best_of(queries: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int, metric: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query numbers, ids, scores): the k best vectors of each query, ties by id, in pieces of bounded memory."""
    out: list[list[np.ndarray]] = [[np.empty(0, np.int64)], [ids[:0]], [np.empty(0)]]
    squares = (vectors * vectors).sum(axis=1)
    step = max(1, 4_000_000 // max(1, len(vectors)))
    for start in range(0, len(queries) if len(vectors) else 0, step):
        some = queries[start : start + step]
        score = some @ vectors.T
        if metric == "l2":
            score = np.maximum(0, (some * some).sum(axis=1)[:, None] - 2 * score + squares)
        score = np.round(score, 12)
        order = score if metric == "l2" else -score
        # All rows as good as the k-th, so that the ties among them can go by id.
        limit = np.partition(order, k - 1, axis=1)[:, k - 1 : k] if k < order.shape[1] else np.full((len(order), 1), np.inf)
        q, v = np.nonzero(order <= limit)
        by = np.lexsort((ids[v], order[q, v], q))
        q, v = q[by], v[by]
        keep = np.arange(len(q)) - np.searchsorted(q, q) < k
        for part, x in zip(out, (q[keep] + start, ids[v[keep]], score[q[keep], v[keep]])):
            part.append(x)
    return tuple(np.concatenate(x) for x in out)


def knn_many(vectors: DataFrame, queries: DataFrame, k: int, metric: str = "ip", id_col: str = "idx", vector_col: str = "embedding", query_id: str = "query_id", query_vector: str = "query_vector") -> DataFrame:
    """J7 for a stated set of queries, (query_id, id, score, rank): matrix products in Arrow batches, of which each keeps the
    k best of every query, and a last choice among those.

    Queries of up to ``QUERY_BYTES`` are sent to the tasks that scan the vectors, which are not moved at all. More of them
    meet the vectors block by block, each block of ``BLOCK`` vectors with every block of queries: copies of queries move, the
    vectors move once. Ids are whole numbers. Vectors of another length than most queries, or with a null or NaN, have no
    score; a query or vector row that is repeated counts as often; k below 1 is an error.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    spark = vectors.sparkSession
    asked = queries.select(F.col(query_id).cast("bigint").alias("__q"), F.col(query_vector).cast("array<double>").alias("__v")).filter(F.col("__q").isNotNull() & F.col("__v").isNotNull())
    stored = vectors.select(F.col(id_col).cast("bigint").alias("__id"), F.col(vector_col).cast("array<double>").alias("__v")).filter(F.col("__id").isNotNull() & F.col("__v").isNotNull())
    sizes = {r["d"]: r["count"] for r in asked.groupBy(F.size("__v").alias("d")).count().collect()}
    dimension, n = (max(sizes, key=lambda d: (sizes[d], d)), sum(sizes.values())) if sizes else (1, 0)
    schema = f"{query_id} bigint, {id_col} bigint, score double"

    def table(q_ids, q, ids, v) -> pa.RecordBatch:
        number, found, score = _best_of(q, v, ids, k, metric)
        return pa.RecordBatch.from_arrays([pa.array(q_ids[number], pa.int64()), pa.array(found, pa.int64()), pa.array(score, pa.float64())], names=[query_id, id_col, "score"])

    if n * (dimension + 1) * 8 <= QUERY_BYTES:
        rows = asked.filter(F.size("__v") == dimension).collect()
        q_ids, q = np.array([r["__q"] for r in rows], np.int64), np.array([r["__v"] for r in rows], np.float64).reshape(-1, dimension)
        fit = ~np.isnan(q).any(axis=1)
        sent = spark.sparkContext.broadcast((q_ids[fit], q[fit]))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[tuple[np.ndarray, np.ndarray]] = []
            for batch in batches:
                at, v = _matrix(batch.column(1), dimension)
                held.append((batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)[at], v))
                if sum(len(x) for x, _ in held) >= BLOCK:
                    yield table(*sent.value, *map(np.concatenate, zip(*held)))
                    held = []
            if held:
                yield table(*sent.value, *map(np.concatenate, zip(*held)))

        found = stored.mapInArrow(scan, schema)
    else:
        blocks = max(1, -(-stored.count() // BLOCK))
        parts = max(1, -(-n // BLOCK))
        number = lambda c, m: F.pmod(F.xxhash64(c), F.lit(m)).cast("int")
        left = asked.select("__q", "__v", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("__b"), number("__q", parts).alias("__p"), F.lit(True).alias("__ask")).withColumnRenamed("__q", "__id")
        right = stored.select("__id", "__v", number("__id", blocks).alias("__b"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("__p"), F.lit(False).alias("__ask"))

        def block(group: pa.Table) -> pa.Table:
            side = group.column("__ask").to_numpy()
            at, m = _matrix(group.column("__v"), dimension)
            ids, side = group.column("__id").to_numpy()[at], side[at]
            return pa.Table.from_batches([table(ids[side], m[side], ids[~side], m[~side])])

        found = left.unionByName(right).groupBy("__b", "__p").applyInArrow(block, schema)
    best = Window.partitionBy(query_id).orderBy(F.asc("score") if metric == "l2" else F.desc("score"), id_col)
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def within(hits: DataFrame, threshold: float, metric: str = "ip") -> DataFrame:
    """of the k best, those within a threshold."""
    return hits.filter(F.col("score") <= threshold if metric == "l2" else F.col("score") >= threshold)


def distance_stats(vectors: DataFrame, query, metric: str = "ip", vector_col: str = "embedding") -> DataFrame:
    """V12, A8."""
    return scored(vectors, query, metric, vector_col).agg(F.min("score").alias("min_score"), F.max("score").alias("max_score"), F.avg("score").alias("mean_score"))


def cardinality(vectors: DataFrame) -> DataFrame:
    """V11."""
    return vectors.agg(F.count("*").alias("n_vectors"))


def self_lookup(vectors: DataFrame, query, id_col: str = "idx") -> DataFrame:
    """The nearest one."""
    return knn(vectors, query, 1, "ip", id_col)


def first_vector(vectors: DataFrame, id_col: str = "idx", vector_col: str = "embedding", near: int = 1000) -> list[float]:
    """The vector of the lowest id that has a direction: looked for among ids below ``near`` first, where a pushed-down filter
    leaves few rows to decode, then among all."""
    usable = vectors.filter(F.col(vector_col).isNotNull()).select(id_col, vector_col)
    for some in (usable.filter(F.col(id_col) < near), usable):
        row = some.filter(norm(F.col(vector_col)) > 0).orderBy(id_col).first()
        if row is not None:
            return [float(x) for x in row[1]]
    raise ValueError("no vector has a direction")


def stored_vector(vectors: DataFrame, key: int, id_col: str = "idx", vector_col: str = "embedding") -> list[float]:
    """The vector stored under an id: one row through a pushed-down filter."""
    row = vectors.filter(F.col(id_col) == key).select(vector_col).first()
    if row is None or row[0] is None:
        raise KeyError(key)
    return [float(x) for x in row[0]]
