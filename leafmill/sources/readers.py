"""Readers: PDF and text directories, JSON metadata and dimensions, vector tables, configuration."""

from __future__ import annotations

import logging
import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from pathlib import Path

import pandas as pd
from pyspark import Accumulator
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

CHUNK_SCHEMA = "idx bigint, file_path string, pdf_url string, book_title string, author string, `group` string, priority int, chapter_name string, snippet string, page_number int"
BOOK_VALUE = "struct<book_title: string, author: string, `group`: string, priority: int, year: int, language: string, isbn: string, tags: array<string>, format: string, availability: string, description: string>"

#: From a PDF's bytes to (page number, text, headings) of its pages, counted from 1.
PageExtractor = Callable[[bytes], Iterator[tuple[int, str, list[str]]]]


@dataclass(frozen=True)
class EngineConfig:
    """Where things are, from the environment; missing files are an error at once."""

    index_path: str
    metadata_path: str
    book_mapping_path: str
    pdf_directory: str = "./pdf"
    port: int = 5000

    @classmethod
    def from_environment(cls, env: dict[str, str] | None = None, check: bool = True) -> EngineConfig:
        env = dict(os.environ) if env is None else env
        paths = [env.get(k) for k in ("FAISS_INDEX_PATH", "METADATA_PATH", "BOOK_MAPPING_PATH")]
        if check:
            for p in paths:
                if not p or not Path(p).exists():
                    raise FileNotFoundError(p or "a path is not set")
        return cls(*(p or "" for p in paths), env.get("PDF_DIRECTORY", "./pdf"), int(env.get("PORT", "5000")))


def pdf_files(spark: SparkSession, directory: str, any_case: bool = True) -> DataFrame:
    """(path, content) of all PDFs below a directory of any file system Spark reads, object stores included."""
    glob = "*.[pP][dD][fF]" if any_case else "*.pdf"
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(directory).select("path", "content")


def pdf_file(spark: SparkSession, directory: str, subpath: str) -> DataFrame:
    """One file's bytes; no row if it isn't there. Paths that leave the directory are refused."""
    if ".." in Path(subpath).parts or subpath.startswith("/"):
        raise ValueError("the path leaves the directory")
    return pdf_files(spark, directory).filter(F.col("path").endswith("/" + subpath))


def pages(files: DataFrame, extract: PageExtractor, failed: Accumulator | None = None) -> DataFrame:
    """(path, page_number, text, headings) through any extractor. A file that fails keeps the pages read so far; it
    is logged on its executor and counted in ``failed``, an accumulator of the session's, which a task that is run again
    counts again."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        log = logging.getLogger("leafmill.pages")
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"]):
                try:
                    for number, text, headings in extract(bytes(content)):
                        rows.append((path, number, text, headings))
                except Exception:  # noqa: BLE001 - a broken file must not end the job
                    log.exception("no more pages from %s", path)
                    if failed is not None:
                        failed.add(1)
            yield pd.DataFrame(rows, columns=["path", "page_number", "text", "headings"])

    return files.mapInPandas(run, "path string, page_number int, text string, headings array<string>")


def plain_pages(content: bytes) -> Iterator[tuple[int, str, list[str]]]:
    """An extractor for files that are text with form feeds between pages; headings are lines all in capitals."""
    for number, text in enumerate(content.decode("utf-8", "replace").split("\f"), 1):
        yield number, text, [line.strip() for line in text.split("\n") if line.strip().isupper() and len(line.strip()) > 1]


def text_files(spark: SparkSession, directory: str) -> DataFrame:
    """(path, text), a row for each .txt file, in UTF-8."""
    return spark.read.text(directory, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.txt").select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def json_chunks(spark: SparkSession, path: str) -> DataFrame:
    """The chunk table from one file with a JSON array, with its schema given; the array is read element by element, never
    held as a whole. idx is the position in the array unless an element has its own. For a table of a size that counts, write
    it as Parquet once: a JSON array can only be read by one task."""
    rows = spark.read.schema(CHUNK_SCHEMA).option("multiLine", True).json(path)
    return rows.withColumn("idx", F.coalesce("idx", F.monotonically_increasing_id()))


def json_books(spark: SparkSession, path: str) -> DataFrame:
    """The book dimension from a JSON object keyed by file name."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", f"map<string, {BOOK_VALUE}>").alias("books"))
    return raw.select(F.explode("books").alias("pdf_filename", "b")).select("pdf_filename", "b.*")


def vector_table(spark: SparkSession, path: str) -> DataFrame:
    """S9."""
    return spark.read.schema(T.StructType([T.StructField("idx", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType()))])).parquet(path)
