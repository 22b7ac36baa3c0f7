"""The most similar vectors of every vector, with vantage-point trees.

Vectors are scaled to unit length, where cosine c and Euclidean distance sqrt(2 - 2c) order alike. A node of a tree has
a vantage point and the median distance to it; the triangle inequality says that neighbours within a radius r of a
vector lie on one side of the node unless the vector's own distance is within r of the median. The search relaxes this
to ``factor`` * r: with factor 1 and one tree nothing is lost; with a small factor and several independent trees little
is lost and each vector stands in few places.

The trees are fitted on a sample of at most ``SAMPLE`` vectors and broadcast; they send every vector to its shards, of
``LEAF_ROWS`` vectors on average. For pairs, what is sent is a sketch of 256 bits; the bits that two sketches differ in tell
their angle, and pairs within ``SIGMAS`` standard deviations of the least cosine are then compared exactly, by the vectors
as stored. Vectors that are the same in all components are one class, compared once.

Defined results: null, zero, non-finite vectors and vectors of another dimension than most have no neighbours; classes count
components to 1/32767 of the largest in their vector, and so do the cosines of ``nearest``, which moves them by about
0.00001; ties go to the lower id; repeated rows (an id with the same vector again) count once; of an id with several
vectors one is compared; an empty table gives an empty one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window, functions as F

from ..sources.scratch import materialize

#: Vectors that the routing trees are fitted on, at most; all vectors are indexed.
SAMPLE = 32_768
#: Vectors that are compared with each other in one block.
LEAF_ROWS = 4_000
NODE_SAMPLE = 4
#: Bits of the sketches that pairs are sought by, and how far beyond their mean a pair may lie.
BITS, SIGMAS = 256, 4.5
#: Trees for pairs, at the least.
TREES = 5
FACTOR = 0.01
#: For the k nearest, whose radius is large in a space without clusters.
KNN_FACTOR = 0.2


def _normal(batch: pa.RecordBatch, dimension: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, vectors of unit length) of the rows that have a direction."""
    ids, lists = batch.column(0), batch.column(1)
    good = (pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False) == dimension) & ids.is_valid().to_numpy(zero_copy_only=False)
    kept = lists.filter(pa.array(good))
    flat = kept.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dimension)
    norm = np.sqrt((flat * flat).sum(axis=1))
    with np.errstate(all="ignore"):
        finite = np.isfinite(norm) & (norm > 0)
        unit = flat[finite] / norm[finite, None]
    return ids.filter(pa.array(good)).to_numpy(zero_copy_only=False)[finite].astype(np.int64), unit


def _pack(unit: np.ndarray) -> list[bytes]:
    peak = np.abs(unit).max(axis=1, keepdims=True) if len(unit) else unit
    return [row.tobytes() for row in np.rint(unit / peak * 32767).astype(np.int16)]


def _unpack(column: pa.Array | pa.ChunkedArray, dimension: int) -> np.ndarray:
    raw = np.frombuffer(b"".join(column.to_pylist()), np.int16).reshape(-1, dimension).astype(np.float32)
    return raw / np.linalg.norm(raw, axis=1, keepdims=True) if len(raw) else raw


def _prepare(dimension: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, unit = _normal(batch, dimension)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(_pack(unit), pa.binary())], names=["id", "vec"])

    return run


class Forest:
    """Vantage points and medians of several trees, each a heap: the children of node n are 2n+1 and 2n+2. Vantage points are
    places in one sample that all trees share, so a deeper tree costs eight bytes a node."""

    def __init__(self, sample: np.ndarray, depth: int, trees: int, seed: int) -> None:
        self.depth, self.trees, self.sample = depth, trees, sample.astype(np.float32)
        nodes = 2**depth - 1
        self.points = np.zeros((trees, max(nodes, 1)), np.int32)
        self.medians = np.zeros((trees, max(nodes, 1)), np.float32)
        random = np.random.default_rng(seed)
        for t in range(trees):
            members = {0: np.arange(len(sample))}
            for node in range(nodes):
                inside = members.pop(node)
                pool = inside if len(inside) else np.arange(len(sample))
                point = pool[random.integers(len(pool))]
                distance = np.sqrt(np.maximum(0, 2 - 2 * (sample[inside] @ sample[point])))
                median = float(np.median(distance)) if len(inside) else math.sqrt(2)
                self.points[t, node], self.medians[t, node] = point, median
                members[2 * node + 1], members[2 * node + 2] = inside[distance <= median], inside[distance > median]

    def route(self, unit: np.ndarray, slack: np.ndarray | float) -> tuple[np.ndarray, np.ndarray]:
        """(rows, shards): every shard that a row belongs to when both sides within ``slack`` of a median are followed."""
        rows, shards = [], []
        slack = np.broadcast_to(np.asarray(slack, np.float32), (len(unit),))
        for t in range(self.trees):
            row, node = np.arange(len(unit)), np.zeros(len(unit), np.int64)
            for _ in range(self.depth):
                distance = np.sqrt(np.maximum(0, 2 - 2 * np.einsum("ij,ij->i", unit[row], self.sample[self.points[t, node]])))
                off = distance - self.medians[t, node]
                low, high = off <= slack[row], off > -slack[row]
                row, node = np.concatenate([row[low], row[high]]), np.concatenate([2 * node[low] + 1, 2 * node[high] + 2])
            rows.append(row)
            shards.append(node - (2**self.depth - 1) + t * 2**self.depth)
        return np.concatenate(rows), np.concatenate(shards)


@lru_cache(maxsize=8)
def _planes(dimension: int) -> np.ndarray:
    """``BITS`` directions in sets that are at right angles, the same everywhere."""
    random = np.random.default_rng(1_000_003)
    sets = [np.linalg.qr(random.standard_normal((dimension, dimension)))[0] for _ in range(-(-BITS // dimension))]
    return np.concatenate(sets, axis=1)[:, :BITS].astype(np.float32)


def sketch(unit: np.ndarray) -> np.ndarray:
    """On which side of each of ``BITS`` planes a vector lies, as words of 64 bits. Vectors at an angle differ in the share
    angle / pi of their bits."""
    return np.packbits(unit.astype(np.float32) @ _planes(unit.shape[1]) > 0, axis=1).view(np.uint64)


def bits_apart(least: float) -> int:
    """The bits that vectors with a cosine of ``least`` differ in, and ``SIGMAS`` standard deviations more."""
    share = math.acos(min(1.0, least)) / math.pi
    return min(BITS, math.ceil(BITS * share + SIGMAS * math.sqrt(BITS * share * (1 - share))))


WORDS = ("s0", "s1", "s2", "s3")
_ROUTED = "shard bigint, id bigint, " + ", ".join(f"{w} bigint" for w in WORDS)


def _route(forest: Forest, dimension: int, slack: float, sketched: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                unit = _unpack(batch.column(1), dimension)
                row, shard = forest.route(unit, slack)
                order = pa.array(row)
                if sketched:
                    words = sketch(unit)[row].view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int64()), batch.column(0).take(order), *(pa.array(words[:, k]) for k in range(len(WORDS)))], names=["shard", "id", *WORDS])
                else:
                    yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int64()), batch.column(0).take(order), batch.column(1).take(order)], names=["shard", "id", "vec"])

    return run


def _shard_candidates(most: int):
    """Pairs of a shard whose sketches differ in ``most`` bits at most, block by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches(batches)
        ids = whole.column("id").to_numpy()
        words = np.column_stack([whole.column(w).to_numpy() for w in WORDS]).view(np.uint64)
        step = max(1, 2_000_000 // max(1, len(ids)))
        for start in range(0, len(ids), step):
            apart = np.zeros((min(step, len(ids) - start), len(ids) - start), np.uint16)
            for k in range(len(WORDS)):
                apart += np.bitwise_count(words[start : start + step, None, k] ^ words[None, start:, k])
            a, b = np.nonzero(apart <= most)
            keep = a < b
            a, b = ids[start + a[keep]], ids[start + b[keep]]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    return run


def _cosines(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.float64).reshape(batch.num_rows, -1) for k in (2, 3))
            cosine = np.einsum("ij,ij->i", x, y)
            keep = pa.array(cosine >= least - 1e-12)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cosine)], names=["a", "b", "cosine"]).filter(keep)

    return run


def _exact(dimension: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, unit = _normal(batch, dimension)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([row.tobytes() for row in unit], pa.binary())], names=["id", "unit"])

    return run


def _dimension(vectors: DataFrame, vector_col: str) -> int:
    row = vectors.filter(F.col(vector_col).isNotNull()).groupBy(F.size(vector_col).alias("d")).count().orderBy(F.desc("count"), "d").first()
    return max(1, row["d"]) if row else 1


def _fit(packed: DataFrame, dimension: int, trees: int, seed: int, n: int) -> tuple[Forest, np.ndarray]:
    """The routing forest and the sample that it was fitted on: the vectors with the lowest hashes of their ids."""
    share = min(1.0, SAMPLE / max(n, 1))
    chosen = packed.filter(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1_000_003)) <= int(1_000_003 * share)) if share < 1 else packed
    sample = _unpack(pa.array([r["vec"] for r in chosen.select("vec").limit(2 * SAMPLE).collect()], pa.binary()), dimension)
    # No deeper than the sample can tell: ``NODE_SAMPLE`` vectors are the least to have a median of.
    depth = min(_levels(n), max(0, int(math.log2(max(1, len(sample) / NODE_SAMPLE)))))
    return Forest(sample, depth, trees, seed), sample


def _levels(n: int) -> int:
    """How often n vectors are halved before a block holds ``LEAF_ROWS``, in the routing trees and in the shards."""
    return max(0, math.ceil(math.log2(max(1, n / LEAF_ROWS))))


def trees_for(n: int) -> int:
    """Trees for n vectors: ``TREES``, or one for every level of a deeper tree, as every level parts some pairs."""
    return max(TREES, _levels(n))


def similar_pairs(vectors: DataFrame, id_col: str = "idx", vector_col: str = "embedding", *, least: float = 0.9, trees: int | None = None, factor: float = FACTOR, seed: int = 7, expand: bool = True) -> DataFrame:
    """(a, b, cosine): pairs of ids, a < b, whose cosine is at least ``least``.

    With ``expand`` members of a class of equal vectors are paired too; without, pairs are between the least ids of classes.
    The number of trees grows with the table (``trees_for``) unless it is given.
    """
    if not 0 < least <= 1:
        raise ValueError("the least cosine must be above 0 and at most 1")
    dimension = _dimension(vectors, vector_col)
    packed = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col)).mapInArrow(_prepare(dimension), "id bigint, vec binary")
    n = vectors.count()
    forest, _ = _fit(packed, dimension, trees or trees_for(n), seed, n)
    classes = packed.groupBy("vec").agg(F.min("id").alias("id"), F.max("id").alias("last"))
    # Sketches of 32 bytes go to the shards, not vectors; the few pairs that they leave are compared exactly.
    shards = classes.select("id", "vec").mapInArrow(_route(forest, dimension, factor * math.sqrt(2 - 2 * least), True), _ROUTED)
    met = materialize(shards.groupBy("shard").applyInArrow(_shard_candidates(bits_apart(least)), "a bigint, b bigint").distinct(), "vector-pairs")
    holders = met.select(F.col("a").alias("id")).union(met.select(F.col("b").alias("id"))).distinct()
    exact = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col)).join(holders, "id", "left_semi").mapInArrow(_exact(dimension), "id bigint, unit binary").dropDuplicates(["id"])
    exact = materialize(exact, "vector-units")
    both = met.join(exact.select(F.col("id").alias("a"), F.col("unit").alias("x")), "a").join(exact.select(F.col("id").alias("b"), F.col("unit").alias("y")), "b")
    pairs = both.select("a", "b", "x", "y").mapInArrow(_cosines(least), "a bigint, b bigint, cosine double")
    if not expand:
        return pairs
    hashes = (F.xxhash64("vec").alias("h"), F.hash("vec").alias("g"))
    shared = packed.groupBy(*hashes).agg(F.min("id").alias("rep"), F.max("id").alias("last")).filter("rep < last").drop("last")
    members = packed.select("id", *hashes).join(shared, ["h", "g"]).select("rep", "id").distinct()
    for side in ("a", "b"):
        own = members.select(F.col("rep").alias(side), F.col("id").alias("member"))
        pairs = pairs.join(own, side, "left").withColumn(side, F.coalesce("member", side)).drop("member")
    same = members.withColumnRenamed("id", "a").join(members.withColumnRenamed("id", "b"), "rep").filter("a < b").select("a", "b", F.lit(1.0).alias("cosine"))
    ordered = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "cosine")
    return ordered.unionByName(same).groupBy("a", "b").agg(F.max("cosine").alias("cosine"))


def _route_queries(forest: Forest, sample: np.ndarray, dimension: int, k: int, factor: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                unit = _unpack(batch.column(1), dimension)
                near = np.concatenate([np.partition(unit[i : i + 256] @ sample.T, -min(k + 1, len(sample)), axis=1)[:, -min(k + 1, len(sample))] for i in range(0, len(unit), 256)])
                radius = np.sqrt(np.maximum(0, 2 - 2 * near)) if len(sample) > k else np.full(len(unit), 2.0)
                row, shard = forest.route(unit, factor * radius)
                order = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int64()), batch.column(0).take(order), batch.column(1).take(order), pa.array(np.ones(len(row), bool))], names=["shard", "id", "vec", "is_query"])

    return run


def _shard_nearest(dimension: int, k: int):
    def run(group: pa.Table) -> pa.Table:
        asks = group.column("is_query").to_numpy()
        ids, unit = group.column("id").to_numpy(), _unpack(group.column("vec"), dimension)
        q_ids, q, v_ids, v = ids[asks], unit[asks], ids[~asks], unit[~asks]
        out: list[list[np.ndarray]] = [[], [], []]
        step = max(1, 2_000_000 // max(1, len(v)))  # so much memory, however large the shard
        for start in range(0, len(q) if len(v) else 0, step):
            block = (q[start : start + step] @ v.T).astype(np.float64)
            block[q_ids[start : start + step, None] == v_ids[None, :]] = -2
            take = min(k, len(v))
            best = np.argpartition(-block, take - 1, axis=1)[:, :take]
            value = np.take_along_axis(block, best, axis=1)
            out[0].append(np.repeat(q_ids[start : start + step], take))
            out[1].append(v_ids[best].ravel())
            out[2].append(value.ravel())
        cols = [np.concatenate(x) if x else np.empty(0) for x in out]
        keep = cols[2] > -2
        return pa.table({"id": pa.array(cols[0][keep], pa.int64()), "neighbour": pa.array(cols[1][keep], pa.int64()), "cosine": pa.array(cols[2][keep], pa.float64())})

    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "idx", vector_col: str = "embedding", *, factor: float = KNN_FACTOR, seed: int = 7) -> DataFrame:
    """(id, rank, neighbour, cosine): the k nearest vectors of every query vector, itself left out.

    Every vector stands in one shard of one tree; a query goes to all shards within ``factor`` times the distance of its
    k-th nearest in the sample, an upper bound of its true radius. Of a class of equal vectors k + 1 are enough.

    How much this prunes depends on the vectors. Where the tenth neighbour is nearly as far as any vector, a factor that keeps
    the recall follows nearly all shards; the README has the shares compared.
    """
    dimension = _dimension(vectors, vector_col)
    pack = lambda df: df.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col)).mapInArrow(_prepare(dimension), "id bigint, vec binary")
    packed = pack(vectors)
    forest, sample = _fit(packed, dimension, 1, seed, vectors.count())
    copies = Window.partitionBy("vec").orderBy("id")
    enough = packed.distinct().withColumn("copy", F.row_number().over(copies)).filter(F.col("copy") <= k + 1).select("id", "vec")
    stored = enough.mapInArrow(_route(forest, dimension, 0.0, False), "shard bigint, id bigint, vec binary").withColumn("is_query", F.lit(False))
    asked = pack(queries).distinct().mapInArrow(_route_queries(forest, sample, dimension, k, factor), "shard bigint, id bigint, vec binary, is_query boolean")
    found = stored.unionByName(asked).groupBy("shard").applyInArrow(_shard_nearest(dimension, k), "id bigint, neighbour bigint, cosine double")
    best = Window.partitionBy("id").orderBy(F.desc("cosine"), "neighbour")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("id", "rank", "neighbour", "cosine")
