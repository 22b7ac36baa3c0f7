"""Writers. A table's chunks and vectors are written together, so they cannot drift apart."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def write_index(chunks: DataFrame, path: str, partition_by: str | None = None) -> bool:
    """K1, K2: chunks with their embedding as one Parquet table; nothing is written, and False comes back, without rows."""
    if chunks.isEmpty():
        return False
    writer = chunks.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    return True


def write_page_maps(pages: DataFrame, path: str, key: str = "file", value: str = "text") -> None:
    """K3: one JSON object for each file, with its pages as a map."""
    grouped = pages.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("page_number", value)))).alias("pages"))
    grouped.write.mode("overwrite").json(path)


def write_texts(documents: DataFrame, path: str, key: str = "file", value: str = "text") -> None:
    """K4: a folder of text for each document, named by its relative path; empty texts are left out."""
    documents.filter(F.length(value) > 0).select(F.col(key).alias("file"), F.col(value).alias("value")).write.mode("overwrite").partitionBy("file").text(path)


def write_books(books: DataFrame, path: str) -> None:
    """K5: the book dimension as JSON lines, one file."""
    books.coalesce(1).write.mode("overwrite").json(path)


def write_paths(chunks: DataFrame, path: str) -> None:
    """K6: file paths, one a line, in the order of idx."""
    chunks.orderBy("idx").select(F.col("file_path").alias("value")).write.mode("overwrite").text(path)


def as_json(results: DataFrame) -> DataFrame:
    """K8: each result as a JSON object."""
    return results.select(F.to_json(F.struct(*(F.col(f"`{c}`") for c in results.columns))).alias("json"))


def envelope(results: DataFrame) -> DataFrame:
    """K8: one row with the whole response, {"results": [...]}, in the order of the rows' ``rank`` column, which is left out.
    For results that are cut to a top_k, and so of bounded size."""
    shown = [c for c in results.columns if c != "rank"]
    ranked = results.select("rank", F.struct(*(F.col(f"`{c}`") for c in shown)).alias("row"))
    rows = F.transform(F.array_sort(F.collect_list(F.struct("rank", "row"))), lambda x: x["row"])
    return ranked.agg(F.to_json(F.struct(rows.alias("results"))).alias("json"))
