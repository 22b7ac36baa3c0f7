"""Lines repeated across the documents of one source, and the documents without them.

Lines become nodes of a graph, weighted with the number of different documents that hold them within one source;
lines that follow each other become edges, weighted alike. Nodes and edges of high support are kept, the connected
components of what is left are the source's boilerplate blocks, and every occurrence of a block's line is deleted.

Two lines are the same if their letters are, lower-cased, in the same order; the rest of a line is ignored.

Defined results: rows with a null id, source or text have no repeated line and keep their text; a document that holds
a line twice supports it once, and so do rows that repeat an id; ties cannot arise; an empty table gives empty ones.
Only (source, line) pairs are counted, after a partial count, so a source with a third of all documents is no one
task's burden.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..sources.scratch import materialize
from ._graph import connected_components

MIN_LETTERS = 30
MIN_SUPPORT = 8
#: Documents that two lines have to follow each other in to be one block.
MIN_EDGE = 8


def letters(line: Column) -> Column:
    """The lower-cased letters (Unicode category L) of a line, without anything else."""
    return F.regexp_replace(F.lower(line), r"\P{L}+", "")


#: Kept lines (24 bytes each) that may be broadcast to the tasks that hold the occurrences.
BROADCAST_LINES = 1_000_000
KEY = ("a", "b", "n")


def _bounded(nodes: DataFrame) -> DataFrame:
    """Marked for broadcast if counted to be few: a repeated line is a hot key by its nature, and so need not be moved. Beyond
    the bound the join is a shuffle, whose skewed partitions Spark splits as it runs."""
    return F.broadcast(nodes) if nodes.count() <= BROADCAST_LINES else nodes


def lines_of(docs: DataFrame, id_col: str, source_col: str, text_col: str, min_letters: int = MIN_LETTERS) -> DataFrame:
    """(id, line_no, a, b, n): the lines with enough letters, as a written table. 96 bits and the length stand for a source
    and the letters of one of its lines, so neither is shuffled as text. A line with fewer characters is left out before the
    pattern runs."""
    present = docs.filter(F.col(id_col).isNotNull() & F.col(source_col).isNotNull() & F.col(text_col).isNotNull() & (F.length(text_col) >= min_letters))
    lines = present.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.posexplode(F.split(text_col, "\n", -1)).alias("line_no", "line")).filter(F.length("line") >= min_letters)
    kept = lines.select("id", "source", "line_no", letters(F.col("line")).alias("letters")).filter(F.length("letters") >= min_letters)
    return materialize(kept.select("id", "line_no", F.xxhash64("source", "letters").alias("a"), F.hash("letters", "source").alias("b"), F.length("letters").alias("n")), "lines")


def occurrences(lines: DataFrame, min_support: int = MIN_SUPPORT) -> DataFrame:
    """(id, line_no, node, support) of every line that stands in enough documents of its source, as a written table."""
    support = lines.groupBy(*KEY, "id").agg(F.lit(1).alias("one")).groupBy(*KEY).agg(F.count("*").alias("support"))
    nodes = materialize(support.filter(F.col("support") >= min_support).withColumn("node", F.xxhash64(*KEY)), "line-nodes")
    return materialize(lines.join(_bounded(nodes), list(KEY)).select("id", "line_no", "node", "support"), "line-occurrences")


def line_edges(found: DataFrame, min_edge: int = MIN_EDGE) -> DataFrame:
    """(src, dst, weight): kept lines of which one stands one or two lines below the other in enough documents."""
    here = found.select("id", "node", "line_no")
    below = here.select("id", F.col("node").alias("dst"), F.explode(F.array(F.col("line_no") - 1, F.col("line_no") - 2)).alias("line_no"))
    pairs = here.withColumnRenamed("node", "src").join(below, ["id", "line_no"]).filter("src <> dst").select("src", "dst", "id").distinct()
    return pairs.groupBy("src", "dst").agg(F.count("*").alias("weight")).filter(F.col("weight") >= min_edge)


def repeated_lines(docs: DataFrame, id_col: str, source_col: str, text_col: str, *, min_letters: int = MIN_LETTERS, min_support: int = MIN_SUPPORT, min_edge: int = MIN_EDGE) -> DataFrame:
    """(id_col, line_no, block, support): every occurrence of a boilerplate block's line. A line without an edge is a block of
    its own: components name the blocks, support alone decides what is one."""
    found = occurrences(lines_of(docs, id_col, source_col, text_col, min_letters), min_support)
    blocks = materialize(connected_components(line_edges(found, min_edge).select("src", "dst")), "line-blocks")
    return found.join(_bounded(blocks), "node", "left").select(F.col("id").alias(id_col), "line_no", F.coalesce("component", "node").alias("block"), "support").distinct()


def boilerplate_blocks(docs: DataFrame, id_col: str, source_col: str, text_col: str, **limits: int) -> DataFrame:
    """(source_col, block, n_lines, support): how many occurrences the blocks of every source have, and their best support."""
    hits = repeated_lines(docs, id_col, source_col, text_col, **limits)
    owned = docs.select(id_col, source_col).filter(F.col(id_col).isNotNull() & F.col(source_col).isNotNull()).distinct()
    return hits.join(owned, id_col).groupBy(source_col, "block").agg(F.count("*").alias("n_lines"), F.max("support").alias("support"))


def remove_repeated_lines(docs: DataFrame, id_col: str, source_col: str, text_col: str, **limits: int) -> DataFrame:
    """(id_col, source_col, n_removed, text_col): every row, its text without the repeated lines; null stays null."""
    hits = repeated_lines(docs, id_col, source_col, text_col, **limits).groupBy(id_col).agg(F.collect_set("line_no").alias("__gone"))
    joined = docs.select(id_col, source_col, text_col).join(hits, id_col, "left")
    kept = F.filter(F.split(text_col, "\n", -1), lambda line, i: ~F.array_contains(F.col("__gone"), i))
    clean = F.when(F.col("__gone").isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n"))
    return joined.select(id_col, source_col, F.coalesce(F.size("__gone"), F.lit(0)).alias("n_removed"), clean.alias(text_col))
