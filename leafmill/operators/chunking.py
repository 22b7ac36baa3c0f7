"""Cutting documents into chunks: overlapping word windows, chapters, pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import WS, collapse_space
from .ids import with_ids

CHUNK, OVERLAP = 1000, 200
#: Fixed value: what a chapter heading looks like.
HEADING = r"^(?:Chapter\s+\w+.*|PART\s+\w+.*|BOOK\s+\w+.*|[A-Z][A-Z\s\-',:&]+)$"
FIRST_TITLE = "Introduction"


def words_of(text: Column) -> Column:
    """The words between white space; none for a blank text."""
    flat = collapse_space(text)
    return F.when(flat == "", F.array().cast("array<string>")).otherwise(F.split(flat, " "))


def windows(words: Column, size: int = CHUNK, overlap: int = OVERLAP) -> Column:
    """Windows of ``size`` words that start every ``size - overlap`` words; the last may lie inside the one before it."""
    if size == overlap:
        raise ValueError("the overlap must differ from the size")
    if size < overlap:
        return F.array().cast("array<string>")
    starts = F.sequence(F.lit(1), F.greatest(F.size(words), F.lit(1)), F.lit(size - overlap))
    return F.when(F.size(words) > 0, F.transform(starts, lambda i: F.array_join(F.slice(words, i, size), " "))).otherwise(F.array().cast("array<string>"))


def chunk_words(docs: DataFrame, text_col: str, keep: list[str], size: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """T10 as rows: the columns ``keep``, chunk_no and chunk."""
    split = docs.select(*keep, words_of(F.col(text_col)).alias("__words"))
    return split.select(*keep, F.posexplode(windows(F.col("__words"), size, overlap)).alias("chunk_no", "chunk"))


def is_heading(line: Column) -> Column:
    """T12."""
    return line.rlike("(?U)" + HEADING)


def chapters(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, section, title, text): sections between headings, headings joined with a title line below them.

    A line is body unless it is a heading or a number; a section without body is left out. Lines of a document meet in one
    task, as its sections depend on each other.
    """
    strip = lambda c: F.regexp_replace(F.regexp_replace(c, "^" + WS + "+", ""), WS + "+$", "")
    lines = docs.select(id_col, F.posexplode(F.split(text_col, "\n", -1)).alias("pos", "raw")).withColumn("line", strip(F.col("raw")))
    order = Window.partitionBy(id_col).orderBy("pos")
    number = F.col("line").rlike(r"^\p{Nd}+$")
    marked = lines.withColumn("heading", is_heading(F.col("line"))).withColumn("number", number)
    marked = marked.withColumn("next", F.lead("line").over(order)).withColumn("next_heading", F.lead("heading").over(order)).withColumn("next_number", F.lead("number").over(order))
    joins = (F.coalesce("next", F.lit("")) != "") & ~F.coalesce("next_number", F.lit(False)) & ~F.coalesce("next_heading", F.lit(False))
    title = F.when(F.col("heading"), F.when(joins, F.concat("line", F.lit(" - "), "next")).otherwise(F.col("line")))
    marked = marked.withColumn("title", title).withColumn("section", F.sum(F.col("heading").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    body = F.when(~F.col("heading") & ~F.col("number"), F.struct("pos", "raw"))
    sections = marked.groupBy(id_col, "section").agg(F.max("title").alias("title"), F.array_sort(F.collect_list(body)).alias("body"))
    text = F.array_join(F.transform("body", lambda x: x["raw"]), " ")
    return sections.select(id_col, F.col("section").cast("int").alias("section"), F.coalesce("title", F.lit(FIRST_TITLE)).alias("title"), text.alias("text")).filter(F.length(F.trim(F.regexp_replace("text", WS + "+", " "))) > 0)


def chapter_chunks(docs: DataFrame, id_col: str, text_col: str, size: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Chunks within chapters, numbered through the document."""
    chunks = chunk_words(chapters(docs, id_col, text_col), "text", [id_col, "section", "title"], size, overlap)
    number = Window.partitionBy(id_col).orderBy("section", "chunk_no")
    return chunks.select(id_col, (F.row_number().over(number) - 1).alias("chunk_no"), "title", "chunk")


def explode_pages(docs: DataFrame, key: str, pages_col: str, value: str = "text") -> DataFrame:
    """A map of pages as rows."""
    return docs.select(key, F.explode(pages_col).alias("page_number", value))


def collect_pages(pages: DataFrame, key: str, value: str = "text") -> DataFrame:
    """K3: rows of pages as a map for each file."""
    return pages.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("page_number", value)))).alias("pages"))


def concat_pages(pages: DataFrame, key: str, value: str = "text", separator: str = "") -> DataFrame:
    """The pages of a file as one text, in order; a page without text counts as empty."""
    ordered = F.array_sort(F.collect_list(F.struct("page_number", F.coalesce(value, F.lit("")).alias("v"))))
    return pages.groupBy(key).agg(F.array_join(F.transform(ordered, lambda x: x["v"]), separator).alias("text"))


def merge_pages(*files: DataFrame, order: tuple[str, ...] = ("page_number",)) -> DataFrame:
    """K7: the pages of several files in one sequence, file by file as given and by ``order`` within one, counted anew from 1."""
    whole = None
    for place, pages in enumerate(files):
        part = pages.withColumn("__file", F.lit(place))
        whole = part if whole is None else whole.unionByName(part)
    placed = with_ids(whole, ["__file", *order], "__place")
    return placed.withColumn("page_number", (F.col("__place") + 1).cast("int")).drop("__file", "__place")


def chapter_name(headings: Column, separator: str = " | ") -> Column:
    """A10: a page's headings as one string; empty where there is none."""
    return F.coalesce(F.array_join(headings, separator), F.lit(""))


def heading_by_size(spans: Column, least: float = 14.0) -> Column:
    """Of spans (text, size), those of large type that are all capitals."""
    return F.transform(F.filter(spans, lambda s: (s["size"] >= least) & (F.upper(s["text"]) == s["text"]) & s["text"].rlike(r"\p{Lu}")), lambda s: s["text"])


def heading_by_mean_size(sizes: Column, least: float = 14.0) -> Column:
    """Whether a line's mean character size is that of a heading."""
    mean = F.aggregate(sizes, F.lit(0.0), lambda s, x: s + x) / F.size(sizes)
    return F.when(F.size(sizes) > 0, mean >= least).otherwise(False)
