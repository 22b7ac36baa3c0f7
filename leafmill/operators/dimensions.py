"""The book dimension: lookups, facets, and building it from file names."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import paths as P

#: What a file without an entry gets.
UNKNOWN, UNKNOWN_PRIORITY = "Unknown", 999
#: Bytes of a dimension that may be broadcast; beyond that the planner chooses.
BROADCAST_BYTES = 32 << 20


def small(df: DataFrame) -> DataFrame:
    """Marked for broadcast if its rows, written out as JSON, are small in all: an upper bound of their size, counted first."""
    size = df.agg(F.sum(F.octet_length(F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns))))).alias("n")).first()["n"]
    return F.broadcast(df) if (size or 0) <= BROADCAST_BYTES else df


def lookup_books(chunks: DataFrame, books: DataFrame) -> DataFrame:
    """The attributes of a chunk's book by file name, with defaults for files that have no entry and for attributes that are null."""
    attributes = books.select(F.col("pdf_filename").alias("__file"), *(F.col(f"`{c}`").alias(f"__{c}") for c in ("book_title", "author", "group", "priority")))
    joined = chunks.join(small(attributes.dropDuplicates(["__file"])), P.basename(F.col("file_path")) == F.col("__file"), "left")
    for c in ("book_title", "author", "group"):
        joined = joined.withColumn(c, F.coalesce(f"__{c}", F.lit(UNKNOWN)))
    joined = joined.withColumn("priority", F.coalesce("__priority", F.lit(UNKNOWN_PRIORITY)))
    return joined.drop("__file", "__book_title", "__author", "__group", "__priority")


def lookup_headings(chunks: DataFrame, headings: DataFrame) -> DataFrame:
    """The headings of a chunk's page as its chapter name; '' without any."""
    own = headings.select("file_path", F.explode("headings").alias("page_number", "__found"))
    joined = chunks.drop("chapter_name").join(own, ["file_path", "page_number"], "left")
    return joined.withColumn("chapter_name", F.coalesce(F.array_join("__found", " | "), F.lit(""))).drop("__found")


def facet_authors(books: DataFrame) -> DataFrame:
    """A1: distinct authors in code-point order."""
    return books.select("author").filter("author IS NOT NULL").distinct().orderBy("author")


def group_rank(order: tuple[str, ...] = P.GROUP_ORDER):
    return F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, order)), F.col("group")), F.lit(0)), F.lit(len(order) + 1))


def facet_groups(books: DataFrame, order: tuple[str, ...] = P.GROUP_ORDER) -> DataFrame:
    """A2: the known groups in their order, then the others by name."""
    return books.select("group").filter("`group` IS NOT NULL").distinct().withColumn("rank", group_rank(order).cast("int")).orderBy("rank", "group")


def titles_by_group(books: DataFrame) -> DataFrame:
    """A3: a group's titles in order, repeats kept."""
    return books.groupBy("group").agg(F.array_sort(F.collect_list("book_title")).alias("titles"))


def titles_flat(books: DataFrame, order: tuple[str, ...] = P.GROUP_ORDER) -> DataFrame:
    """A4: all titles by group order and title, repeats kept."""
    return books.select(group_rank(order).cast("int").alias("rank"), "group", "book_title").orderBy("rank", "group", "book_title")


def distinct_titles(books: DataFrame) -> DataFrame:
    """A5."""
    return books.select("book_title").filter("book_title IS NOT NULL").distinct().orderBy("book_title")


def facets(books: DataFrame, order: tuple[str, ...] = P.GROUP_ORDER) -> DataFrame:
    """Q11: one row with all lists, over a dimension of bounded size."""
    grouped = F.array_sort(F.collect_set(F.struct(group_rank(order).alias("rank"), F.col("group").alias("name"))))
    titles = F.array_sort(F.collect_list(F.struct(group_rank(order).alias("rank"), F.col("group").alias("name"), F.col("book_title").alias("title"))))
    row = books.agg(F.array_sort(F.collect_set("author")).alias("authors"), grouped.alias("g"), titles.alias("t"))
    names = F.transform("g", lambda x: x["name"])
    by_group = F.map_from_arrays(names, F.transform(names, lambda g: F.transform(F.filter(F.col("t"), lambda x: x["name"] == g), lambda x: x["title"])))
    return row.select("authors", names.alias("groups"), F.transform("t", lambda x: x["title"]).alias("book_titles"), by_group.alias("titles_by_group"))


def legacy_facets(books: DataFrame) -> DataFrame:
    """Q12: one row with the distinct authors, groups and titles, each in code-point order, without regard to the group order."""
    return books.agg(*(F.array_sort(F.collect_set(c)).alias(name) for c, name in (("author", "authors"), ("group", "groups"), ("book_title", "book_titles"))))


def allow_list(authors: DataFrame, order: list[str]) -> DataFrame:
    """SO5: the listed authors that exist, in the list's order."""
    return authors.agg(F.array_intersect(F.array(*map(F.lit, order)), F.collect_set("author")).alias("authors"))


def dependent_titles(books: DataFrame, group: str | None) -> DataFrame:
    """The titles of the chosen group, or all."""
    return (books.filter(F.col("group") == group) if group else books).select("book_title").orderBy("book_title")


#: Fixed values (U8): what every book made from a file has.
FILE_DEFAULTS = {"priority": 99, "language": "English", "isbn": "", "format": "PDF", "availability": "Public"}
FILE_TAGS = ("Yoga", "Philosophy", "Spirituality")


def books_from_files(files: DataFrame, path_col: str = "path", folders: dict[str, tuple[str, str]] | None = None, defaults: dict[str, object] = FILE_DEFAULTS, tags: tuple[str, ...] = FILE_TAGS) -> DataFrame:
    """A dimension made from paths: title from the name, group and author from the folder (``folders`` as in
    ``folder_group``), the rest from ``defaults`` and ``tags``. Of files with one name the last path wins."""
    parts = files.select(F.col(path_col).alias("path"), P.basename(F.col(path_col)).alias("pdf_filename"), F.element_at(F.split(path_col, "/"), -2).alias("folder")).filter(F.col("pdf_filename").endswith(".pdf"))
    last = parts.groupBy("pdf_filename").agg(F.max_by("folder", "path").alias("folder"))
    made = last.select("pdf_filename", P.format_title(F.col("pdf_filename")).alias("book_title"), P.capitalize(F.col("folder")).alias("author"), P.folder_group(F.col("folder"), folders).alias("group"), P.folder_description(F.col("folder"), folders).alias("description"))
    made = made.withColumns({c: F.lit(v) for c, v in defaults.items()}).withColumn("tags", F.array(*map(F.lit, tags)))
    return made.select("pdf_filename", "book_title", "author", "group", "priority", "language", "isbn", "tags", "format", "availability", "description")


def ingest_counts(chunks: DataFrame) -> DataFrame:
    """A6."""
    return chunks.agg(F.count_distinct("file_path").alias("n_files"), F.count_distinct("file_path", "page_number").alias("n_pages"), F.count("*").alias("n_chunks"))
