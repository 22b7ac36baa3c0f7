"""Dense ids in an order, without sorting everything in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..sources.scratch import materialize

#: Bits of ``monotonically_increasing_id`` that count within a partition.
_WITHIN = 33


def _hashable(kind: T.DataType) -> bool:
    if isinstance(kind, T.MapType):
        return False
    if isinstance(kind, T.ArrayType):
        return _hashable(kind.elementType)
    return all(_hashable(f.dataType) for f in kind.fields) if isinstance(kind, T.StructType) else True


def _tie(rows: DataFrame) -> Column:
    """A hash of a row's columns, so that rows alike in the order columns always come out alike."""
    return F.xxhash64(*(F.col(f"`{f.name}`") for f in rows.schema.fields if _hashable(f.dataType)))


def with_ids(rows: DataFrame, order: list[str], name: str = "idx") -> DataFrame:
    """Ids 0, 1, 2, ... in the order of the columns, ties by a hash of the whole row; a column ``name`` is replaced.

    Rows are ranged over partitions, sorted there and written once with their partition and place. Only then are the
    partitions counted, so the ids rest on one sample and one order, whatever is computed again later. The counts are one
    number a partition: they come to the driver and go out again as a table of that size.
    """
    tied = rows.drop(name).withColumn("__tie", _tie(rows.drop(name)))
    placed = tied.repartitionByRange(*order, "__tie").sortWithinPartitions(*order, "__tie").withColumn("__at", F.monotonically_increasing_id())
    written = materialize(placed.drop("__tie"), "ids")
    part = F.shiftright("__at", _WITHIN).cast("int")
    counts = sorted((r["part"], r["n"]) for r in written.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
    starts, total = [], 0
    for p, n in counts:
        starts.append((p, total))
        total += n
    table = rows.sparkSession.createDataFrame(starts, "__part int, __start bigint")
    found = written.withColumn("__part", part).join(F.broadcast(table), "__part")
    return found.withColumn(name, F.col("__start") + F.col("__at").bitwiseAND((1 << _WITHIN) - 1)).drop("__part", "__start", "__at")
