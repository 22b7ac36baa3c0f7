"""Near-duplicate texts: groups and pairs whose sets of word shingles overlap enough.

A BK-tree over Hamming distances cannot carry this: see ``bk_tree_visits`` and the README. At a Jaccard threshold of 0.6
the radius that loses no pair is about half of the distance between unrelated texts, and the triangle inequality then
excludes no edge. What is used instead:

1. Candidates are sought by longer shingles (``SEARCH`` words), as short ones recur by chance in more and more pairs of
   unrelated texts as a collection grows. An edit that costs a text r >= 2 neighbouring shingles of three words costs it
   at most 2r of five words, so texts that overlap by a share t in the short ones overlap by (3t - 1) / (1 + t) of the
   larger set in the long ones. Below a threshold of 0.5, and with ``by_rule`` False, the short shingles are used for the
   search themselves: then sharing enough of the rarest is not a rule about edits but follows from the overlap.
2. Shingles are counted over the whole corpus in a hashed histogram of fixed size, which orders them from rare to common.
3. Two texts that overlap enough share at least ``SHARED`` of their rarest shingles (the prefix of the ordered set that
   the threshold allows to be missed, and a few more). Texts meet in buckets by those shingles only.
4. Pairs that met often enough are checked exactly on their whole sets of short shingles.

Texts with one and the same set are one class, known by a hash of the set: a class meets others once a batch, never once
a copy, so copies of one text cannot make a bucket large. A shingle that more than ``HOT`` texts share is split over
pairs of blocks of texts, so that no task holds all of them.

Defined results: null texts and texts below ``min_words`` words have no class and no partner; the empty and the very long
are treated alike; a repeated id with the same text is one member; an empty table gives an empty one.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..sources.scratch import materialize
from ._graph import connected_components

SHINGLE = 3
SEARCH = 5
THRESHOLD = 0.6
MIN_WORDS = 20
#: Rare shingles that two texts have to share before they are compared.
SHARED = 8
#: Cells of the histogram (4 bytes each) and of the filter for candidates (1 bit each, sent as bytes).
CELLS = 1 << 20
CHUNKS = 64
FILTER = 1 << 23
#: Estimated texts of a shingle above which it is split over blocks of texts.
HOT = 20_000
BUCKET_ROWS = 2_000_000
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * _A
    x = (x ^ (x >> np.uint64(32))) * _B
    return x ^ (x >> np.uint64(31))


class Shingler:
    """The distinct shingle hashes of a batch of texts, for texts with enough words."""

    def __init__(self, size: int, min_words: int) -> None:
        import xxhash

        self.size, self.min_words, self.digest, self.known = size, max(min_words, size), xxhash.xxh3_64_intdigest, {}

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(rows, starts, hashes): the hashes of the text in row rows[i] are hashes[starts[i]:starts[i + 1]], ascending."""
        rows, lengths, words = [], [], []
        for i, text in enumerate(texts):
            if text:
                split = text.lower().split()
                if len(split) >= self.min_words:
                    rows.append(i)
                    lengths.append(len(split))
                    words += split
        known = self.known
        if len(known) > 500_000:
            known.clear()
        for w in set(words) - known.keys():
            known[w] = self.digest(w)
        each = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        with np.errstate(over="ignore"):
            mixed = np.zeros(max(0, len(each) - self.size + 1), np.uint64)
            for k in range(self.size):
                mixed = _mix(mixed + each[k : len(mixed) + k] * _C + np.uint64(k + 1))
        text_of = np.repeat(np.arange(len(rows)), lengths)
        ends = np.cumsum(lengths, dtype=np.int64)
        inside = np.arange(len(mixed)) + self.size <= ends[text_of[: len(mixed)]] if len(mixed) else np.empty(0, bool)
        hashes, owner = mixed[inside], text_of[: len(mixed)][inside]
        order = np.lexsort((hashes, owner))
        hashes, owner = hashes[order], owner[order]
        first = np.ones(len(hashes), bool)
        first[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
        hashes, owner = hashes[first], owner[first]
        starts = np.searchsorted(owner, np.arange(len(rows) + 1))
        return np.array(rows, np.int64), starts, hashes


def _class_keys(starts: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """A 63-bit hash of every set."""
    if len(starts) < 2:
        return np.empty(0, np.int64)
    with np.errstate(over="ignore"):
        total = np.add.reduceat(_mix(hashes + _C), starts[:-1])
        return (_mix(total + np.diff(starts).astype(np.uint64) * _B) >> np.uint64(1)).astype(np.int64)


def _chunks(cells: np.ndarray) -> pa.RecordBatch:
    parts = cells.reshape(CHUNKS, -1)
    used = [k for k in range(CHUNKS) if parts[k].any()]
    return pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([zlib.compress(parts[k].tobytes(), 1) for k in used], pa.binary())], names=["chunk", "cells"])


def _sum_chunks(group: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(zlib.decompress(x), np.uint32).astype(np.uint64) for x in group.column("cells").to_pylist())
    return pa.table({"chunk": group.column("chunk")[:1], "cells": pa.array([zlib.compress(np.minimum(total, 0xFFFFFFFF).astype(np.uint32).tobytes(), 1)], pa.binary())})


def _histogram(parts: DataFrame, cells: int) -> np.ndarray:
    """The cells summed over all partitions: an array of fixed size."""
    out = np.zeros(cells, np.uint32)
    for r in parts.groupBy("chunk").applyInArrow(_sum_chunks, "chunk int, cells binary").collect():
        part = np.frombuffer(zlib.decompress(r["cells"]), np.uint32)
        out[r["chunk"] * len(part) : (r["chunk"] + 1) * len(part)] = part
    return out


def _survey(size: int, min_words: int, cells: int):
    """Members (id, class, number of shingles) and, at the end, this partition's histogram."""
    schema = pa.schema([("kind", pa.int32()), ("id", pa.int64()), ("class", pa.int64()), ("n", pa.int32()), ("chunk", pa.int32()), ("cells", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, total = Shingler(size, min_words), np.zeros(cells, np.uint32)
        for batch in batches:
            rows, starts, hashes = shingler(batch.column(1).to_pylist())
            total += np.bincount((hashes % np.uint64(cells)).astype(np.int64), minlength=cells).astype(np.uint32)
            ids = batch.column(0).take(pa.array(rows))
            none = [pa.nulls(len(rows), t) for t in (pa.int32(), pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(rows), np.int32)), ids, pa.array(_class_keys(starts, hashes)), pa.array(np.diff(starts).astype(np.int32)), *none], schema=schema)
        last = _chunks(total)
        none = [pa.nulls(last.num_rows, t) for t in (pa.int64(), pa.int64(), pa.int32())]
        yield pa.RecordBatch.from_arrays([pa.array(np.ones(last.num_rows, np.int32)), *none, *last.columns], schema=schema)

    return run


_ROW = np.dtype([("shingle", "<u8"), ("class", "<i8"), ("n", "<i4"), ("side", "<i1")])


def _needed(n: np.ndarray, threshold: float, shared: int) -> np.ndarray:
    """Shingles that a set of ``n`` shares at least with any set that overlaps enough, up to ``shared``."""
    return np.minimum(shared, np.ceil(threshold * n - 1e-9)).astype(np.int64)


def _emit(size: int, min_words: int, counts: np.ndarray, threshold: float, shared: int, buckets: int):
    schema = pa.schema([("bucket", pa.int32()), ("rows", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(size, min_words)
        for batch in batches:
            _, starts, hashes = shingler(batch.column(1).to_pylist())
            if not len(hashes):
                continue
            keys, n = _class_keys(starts, hashes), np.diff(starts)
            _, once = np.unique(keys, return_index=True)
            owner = np.repeat(np.arange(len(n)), n)
            cell = counts[(hashes % np.uint64(len(counts))).astype(np.int64)]
            order = np.lexsort((hashes, cell, owner))
            place = np.arange(len(hashes)) - np.repeat(starts[:-1], n)
            length = n - np.ceil(threshold * n - 1e-9).astype(np.int64) + _needed(n, threshold, shared)
            chosen = np.isin(owner, once) & (place < np.repeat(length, n))
            taken = order[chosen]
            # A cell that counts one text has no second text to meet.
            taken = taken[cell[taken] > 1]
            rows = np.zeros(len(taken), _ROW)
            rows["shingle"], rows["class"], rows["n"], rows["side"] = hashes[taken], keys[owner[taken]], n[owner[taken]], 2
            hot = cell[taken] > HOT
            if hot.any():
                rows = np.concatenate([rows[~hot], _split_hot(rows[hot], cell[taken][hot])])
            bucket = ((rows["shingle"] >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)
            by = np.argsort(bucket, kind="stable")
            rows, bucket = rows[by], bucket[by]
            cuts = np.searchsorted(bucket, np.arange(buckets + 1))
            filled = [b for b in range(buckets) if cuts[b + 1] > cuts[b]]
            yield pa.RecordBatch.from_arrays([pa.array(filled, pa.int32()), pa.array([_packed(rows[cuts[b] : cuts[b + 1]]) for b in filled], pa.binary())], schema=schema)

    return run


def _packed(rows: np.ndarray) -> bytes:
    """Column by column, as repeated classes and counts lie together then."""
    rows = rows[np.argsort(rows["class"], kind="stable")]
    return zlib.compress(np.int64(len(rows)).tobytes() + b"".join(np.ascontiguousarray(rows[c]).tobytes() for c in ("class", "n", "side")), 1) + b"|" + rows["shingle"].tobytes()


def _unpacked(blob: bytes) -> np.ndarray:
    d = zlib.decompressobj()
    head = d.decompress(blob)
    count = int(np.frombuffer(head[:8], np.int64)[0])
    rows = np.zeros(count, _ROW)
    at = 8
    for c in ("class", "n", "side"):
        width = _ROW[c].itemsize * count
        rows[c] = np.frombuffer(head[at : at + width], _ROW[c])
        at += width
    rows["shingle"] = np.frombuffer(d.unused_data[1:], "<u8")
    return rows


def _split_hot(rows: np.ndarray, estimate: np.ndarray) -> np.ndarray:
    """Each row once for every pair of blocks that its text's block is in; the blocks follow from the shingle's count."""
    out = []
    blocks = np.ceil(estimate / HOT).astype(np.int64)
    for b in np.unique(blocks):
        some = rows[blocks == b]
        own = (_mix(some["class"].astype(np.uint64)) % np.uint64(b)).astype(np.int64)
        for other in range(b):
            copy = some.copy()
            low, high = np.minimum(own, other), np.maximum(own, other)
            with np.errstate(over="ignore"):
                copy["shingle"] = _mix(some["shingle"] + (low * b + high + 1).astype(np.uint64) * _C)
            copy["side"] = np.where(low == high, 2, np.where(own == low, 0, 1))
            out.append(copy)
    return np.concatenate(out)


def _meet(threshold: float, shared: int):
    """Pairs of classes that share shingles within a bucket, with how many. Output leaves in bounded pieces."""

    def pieces(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        rows = rows[np.lexsort((rows["side"], rows["class"], rows["shingle"]))]
        new = np.ones(len(rows), bool)
        new[1:] = (rows["shingle"][1:] != rows["shingle"][:-1]) | (rows["class"][1:] != rows["class"][:-1]) | (rows["side"][1:] != rows["side"][:-1])
        rows = rows[new]
        alike = np.flatnonzero(rows["shingle"][1:] == rows["shingle"][:-1])
        got, size, step = [], 0, 1
        while len(alike):
            a, b = rows[alike], rows[alike + step]
            fits = (np.minimum(a["n"], b["n"]) >= threshold * np.maximum(a["n"], b["n"]) - 1e-9) & (a["class"] != b["class"]) & ((a["side"] == 2) | (a["side"] != b["side"]))
            pairs = np.zeros(int(fits.sum()), np.dtype([("a", "<i8"), ("b", "<i8"), ("need", "<i4")]))
            pairs["a"], pairs["b"] = np.minimum(a["class"], b["class"])[fits], np.maximum(a["class"], b["class"])[fits]
            pairs["need"] = _needed(np.minimum(a["n"], b["n"])[fits], threshold, shared)
            got.append(pairs)
            size += len(pairs)
            if size > 2_000_000:
                yield tally(np.concatenate(got))
                got, size = [], 0
            step += 1
            alike = alike[alike + step < len(rows)]
            alike = alike[rows["shingle"][alike + step] == rows["shingle"][alike]]
        if size:
            yield tally(np.concatenate(got))

    def tally(pairs: np.ndarray) -> pa.RecordBatch:
        pairs = pairs[np.lexsort((pairs["b"], pairs["a"]))]
        first = np.ones(len(pairs), bool)
        first[1:] = (pairs["a"][1:] != pairs["a"][:-1]) | (pairs["b"][1:] != pairs["b"][:-1])
        at = np.flatnonzero(first)
        unique, n = pairs[at], np.diff(np.append(at, len(pairs)))
        return pa.RecordBatch.from_arrays([pa.array(unique["a"]), pa.array(unique["b"]), pa.array(unique["need"]), pa.array(n.astype(np.int32))], names=["a", "b", "need", "met"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, blobs = None, []
        for batch in batches:
            for bucket, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if bucket != at and blobs:
                    yield from pieces(np.concatenate(blobs))
                    blobs = []
                at = bucket
                blobs.append(_unpacked(blob))
        if blobs:
            yield from pieces(np.concatenate(blobs))

    return run


def _mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cells = np.zeros(FILTER, np.uint32)
    for batch in batches:
        cells[(_mix(batch.column(0).to_numpy().astype(np.uint64)) % np.uint64(FILTER)).astype(np.int64)] = 1
    yield _chunks(cells)


def _sets(size: int, min_words: int, marked: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(size, min_words)
        bits = np.unpackbits(np.frombuffer(marked, np.uint8))
        for batch in batches:
            ids = batch.column(0)
            asked = bits[(_mix(ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.uint64)) % np.uint64(FILTER)).astype(np.int64)].astype(bool)
            some = batch.filter(pa.array(asked & ids.is_valid().to_numpy(zero_copy_only=False)))
            rows, starts, hashes = shingler(some.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([some.column(0).take(pa.array(rows)), pa.array([hashes[s:e].tobytes() for s, e in zip(starts[:-1], starts[1:])], pa.binary())], names=["id", "shingles"])

    return run


def _check(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, value = [], []
            for i, (x, y) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                common = len(np.intersect1d(p, q, assume_unique=True))
                whole = len(p) + len(q) - common
                if common >= threshold * whole - 1e-9:
                    keep.append(i)
                    value.append(common / whole)
            chosen = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([chosen.column(0), chosen.column(1), pa.array(value, pa.float64())], names=["a", "b", "similarity"])

    return run


def _search_by(shingle: int, threshold: float, min_words: int) -> tuple[int, float]:
    """The length of the shingles that candidates are sought by, and the share of them that two texts have in common."""
    if threshold < 0.5 or not shingle < SEARCH <= min_words or SEARCH - shingle > 2:
        return shingle, threshold
    return SEARCH, (3 * threshold - 1) / (1 + threshold)


def class_links(docs: DataFrame, id_col: str, text_col: str, *, threshold: float = THRESHOLD, shingle: int = SHINGLE, min_words: int = MIN_WORDS, shared: int = SHARED, by_rule: bool = True) -> tuple[DataFrame, DataFrame]:
    """(members, links): (id, class) of every text with enough words, and (a, b, similarity) of classes that overlap enough.

    ``by_rule`` False seeks candidates by the short shingles themselves, which proves that no pair is lost, whatever the edits
    are, and costs more meetings of unrelated texts."""
    if not 0 < threshold <= 1:
        raise ValueError("the threshold must be above 0 and at most 1")
    spark = docs.sparkSession
    search, share = _search_by(shingle, threshold, min_words) if by_rule else (shingle, threshold)
    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).filter(F.col("id").isNotNull() & F.col("text").isNotNull())
    survey = materialize(texts.mapInArrow(_survey(search, min_words, CELLS), "kind int, id bigint, class bigint, n int, chunk int, cells binary"), "shingle-survey", ["kind"])
    counts = _histogram(survey.filter("kind = 1").select("chunk", "cells"), CELLS)
    members = survey.filter("kind = 0").select("id", "class")
    per_text = int(counts.sum(dtype=np.uint64)) * (1 - share)
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(per_text / BUCKET_ROWS))
    met = texts.select("id", "text").mapInArrow(_emit(search, min_words, counts, share, shared, buckets), "bucket int, rows binary")
    met = met.repartitionById(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(_meet(share, shared), "a bigint, b bigint, need int, met int")
    candidates = materialize(met.groupBy("a", "b").agg(F.sum("met").alias("met"), F.max("need").alias("need")).filter("met >= need").select("a", "b"), "shingle-candidates")
    holders = members.join(candidates.select(F.col("a").alias("class")).union(candidates.select(F.col("b").alias("class"))).distinct(), "class", "left_semi").groupBy("class").agg(F.min("id").alias("id"))
    holders = materialize(holders, "shingle-holders")
    marked = np.packbits(_histogram(holders.select("id").mapInArrow(_mark, "chunk int, cells binary"), FILTER) > 0).tobytes()
    sets = texts.mapInArrow(_sets(shingle, min_words, marked), "id bigint, shingles binary").join(holders, "id").select("class", "shingles").dropDuplicates(["class"])
    both = candidates.join(sets.select(F.col("class").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("class").alias("b"), F.col("shingles").alias("y")), "b")
    links = both.select("a", "b", "x", "y").mapInArrow(_check(threshold), "a bigint, b bigint, similarity double")
    return members, links


def near_duplicate_pairs(docs: DataFrame, id_col: str, text_col: str, **limits) -> DataFrame:
    """(a, b, similarity): all pairs of ids, a < b, whose texts overlap enough, copies of one text included.

    As large as its result: a class of n copies gives all of its pairs. ``near_duplicate_groups`` stays linear.
    """
    members, links = class_links(docs, id_col, text_col, **limits)
    members = members.distinct()
    shared = members.groupBy("class").agg(F.min("id").alias("low"), F.max("id").alias("high")).filter("low < high").select("class")
    copies = members.join(shared, "class", "left_semi")
    same = copies.withColumnRenamed("id", "a").join(copies.withColumnRenamed("id", "b"), "class").filter("a < b").select("a", "b", F.lit(1.0).alias("similarity"))
    apart = links.join(members.select(F.col("class").alias("a"), F.col("id").alias("ia")), "a").join(members.select(F.col("class").alias("b"), F.col("id").alias("ib")), "b")
    return apart.select(F.least("ia", "ib").alias("a"), F.greatest("ia", "ib").alias("b"), "similarity").unionByName(same)


def near_duplicate_groups(docs: DataFrame, id_col: str, text_col: str, **limits) -> DataFrame:
    """(id_col, class, group, n_links, n_copies): one row for every text with enough words.

    The group is the connected component of classes under the links, n_links the number of other classes that the
    text's class is linked with, n_copies the number of ids in the class.
    """
    members, links = class_links(docs, id_col, text_col, **limits)
    links = materialize(links.select("a", "b"), "shingle-links")
    groups = connected_components(links.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    degree = links.select(F.col("a").alias("class")).union(links.select(F.col("b").alias("class"))).groupBy("class").agg(F.count("*").alias("n_links"))
    classes = members.distinct().groupBy("class").agg(F.count("*").alias("n_copies"))
    classes = classes.join(degree, "class", "left").join(groups.withColumnRenamed("node", "class"), "class", "left")
    classes = classes.select("class", F.coalesce("component", "class").alias("group"), F.coalesce("n_links", F.lit(0)).alias("n_links"), "n_copies")
    return members.distinct().join(classes, "class").select(F.col("id").alias(id_col), "class", "group", "n_links", "n_copies")


def bk_tree_visits(fingerprints: np.ndarray, queries: np.ndarray, radius: int) -> float:
    """The share of a BK-tree's nodes that queries within ``radius`` visit: children are keyed by their integer Hamming
    distance to the parent, and only edges within the radius are followed. ``fingerprints`` are rows of bits."""
    children: list[dict[int, int]] = [{} for _ in fingerprints]
    distance = lambda x, y: int((x != y).sum())
    for i in range(1, len(fingerprints)):
        at = 0
        while (nxt := children[at].get(d := distance(fingerprints[at], fingerprints[i]))) is not None:
            at = nxt
        children[at][d] = i
    seen = 0
    for q in queries:
        stack = [0]
        while stack:
            node = stack.pop()
            seen += 1
            d = distance(fingerprints[node], q)
            stack += [c for k, c in children[node].items() if d - radius <= k <= d + radius]
    return seen / (len(queries) * len(fingerprints))
