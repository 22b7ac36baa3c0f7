"""From files to the searchable table: pages, books, chunks, embeddings, ids."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from ..functions import paths as P
from ..functions import text as TX
from ..operators import chunking as C
from ..operators import dimensions as D
from ..operators import vectors as V
from ..operators.ids import with_ids


def embedded(chunks: DataFrame, embedder: Callable[[str], list[float]] = V.hash_embedding) -> DataFrame:
    """Embedding of unit length, snippet_norm and tokens, computed once."""
    made = chunks.withColumn("embedding", V.embed(F.col("snippet"), embedder, unit=True))
    made = made.withColumn("snippet_norm", TX.prepare_text(F.col("snippet")))
    return made.withColumn("tokens", TX.tokens(F.col("snippet_norm")))


def chunks_from_pages(pages: DataFrame, books: DataFrame, base_url: str, root: str, size: int = C.CHUNK, overlap: int = C.OVERLAP, embedder: Callable[[str], list[float]] = V.hash_embedding) -> DataFrame:
    """Q14: pages (path, page_number, text, headings) to chunks, ready for ``write_index``."""
    normal = pages.withColumn("text", TX.normalize_text(F.col("text"))).withColumn("chapter_name", C.chapter_name(F.col("headings")))
    cut = C.chunk_words(normal, "text", ["path", "page_number", "chapter_name"], size, overlap).withColumnRenamed("path", "file_path")
    known = D.lookup_books(cut, books).withColumn("pdf_url", P.page_url(base_url, root, F.col("file_path"), F.col("page_number")))
    ids = with_ids(known.withColumnRenamed("chunk", "snippet"), ["file_path", "page_number", "chunk_no"])
    return embedded(ids.select("idx", "file_path", "pdf_url", "book_title", "author", "group", "priority", "chapter_name", "snippet", "page_number"), embedder)


def chunks_from_texts(texts: DataFrame, base_url: str, root: str, size: int = C.CHUNK, overlap: int = C.OVERLAP, embedder: Callable[[str], list[float]] = V.hash_embedding) -> DataFrame:
    """Q15: whole texts (path, text) to chunks by chapter; a chunk's page is its number, from 1."""
    joined = texts.withColumn("text", TX.dehyphenate(TX.normalize_text(F.col("text"), quotes=False)))
    cut = C.chapter_chunks(joined, "path", "text", size, overlap)
    rows = cut.select(F.col("path").alias("file_path"), P.text_to_pdf_url(base_url, root, F.col("path")).alias("pdf_url"), F.col("title").alias("chapter_name"), F.col("chunk").alias("snippet"), (F.col("chunk_no") + 1).alias("page_number"))
    return embedded(with_ids(rows, ["file_path", "page_number"]), embedder)


def vectors_from_texts(texts: DataFrame, embedder: Callable[[str], list[float]] = V.hash_embedding) -> DataFrame:
    """Q16: one vector for each file."""
    rows = with_ids(texts.select(F.col("path").alias("file_path"), "text"), ["file_path"])
    return rows.withColumn("embedding", V.embed(F.col("text"), embedder)).select("idx", "file_path", "embedding")


def page_texts(pages: DataFrame, root: str) -> DataFrame:
    """Q17: pages keyed by their path below root, with forward slashes, and normalised text."""
    below = F.regexp_replace(F.regexp_replace("path", r"\\", "/"), "^.*?" + root.strip("/").split("/")[-1] + "/", "")
    return pages.select(below.alias("file"), "page_number", TX.normalize_text(F.col("text"), quotes=False).alias("text"), "headings")
