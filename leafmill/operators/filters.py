"""Equality filters and match predicates over the chunk table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

#: The columns that a request may filter by.
FILTER_COLUMNS = ("author", "group", "book_title")


def used_filters(filters: dict[str, str | None] | None) -> dict[str, str]:
    """the filters of the known columns that have a value."""
    return {c: v for c in FILTER_COLUMNS if (v := (filters or {}).get(c))}


def apply_filters(chunks: DataFrame, filters: dict[str, str] | None) -> DataFrame:
    """all equalities have to hold; null fails; a column that isn't there gives no row; no filter passes all."""
    if not filters:
        return chunks
    if any(c not in chunks.columns for c in filters):
        return chunks.filter(F.lit(False))
    return chunks.filter(reduce(lambda a, b: a & b, (F.col(f"`{c}`") == v for c, v in filters.items())))


def exact_phrase(prepared: Column, query: str) -> Column:
    """the phrase as a substring, without word boundaries."""
    return F.contains(prepared, F.lit(query))


def exact_phrase_plain(text: Column, query: str) -> Column:
    """lower case is all the normalisation there is."""
    return F.contains(F.lower(text), F.lit(query.lower()))


def all_words(words_of_text: Column, words: list[str]) -> Column:
    """every word of the query is a token of the text; punctuation belongs to its token."""
    return F.size(F.array_except(F.array(*map(F.lit, words)), words_of_text)) == 0 if words else F.lit(True)


def all_substrings(prepared: Column, words: list[str]) -> Column:
    """every word of the query stands somewhere in the text."""
    return reduce(lambda a, b: a & b, (F.contains(prepared, F.lit(w)) for w in words), F.lit(True))


def any_word(prepared: Column, words: list[str]) -> Column:
    """F8: one word of the query is enough; without words everything matches."""
    return reduce(lambda a, b: a | b, (F.contains(prepared, F.lit(w)) for w in words)) if words else F.lit(True)


def raw_positions(chunks: DataFrame, text_col: str, needle: str) -> DataFrame:
    """the ids of rows that hold a string as it is."""
    return chunks.filter(F.contains(F.col(text_col), F.lit(needle))).select("idx")


def path_contains(chunks: DataFrame, part: str) -> DataFrame:
    """F14."""
    return chunks.filter(F.contains("file_path", F.lit(part)))


def mismatches(rows: DataFrame, id_col: str, expected: dict[str, str]) -> DataFrame:
    """(id, field, expected, actual) wherever a field isn't what it should be; missing is a mismatch."""
    fields = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.lit(v).alias("expected"), (F.col(f"`{f}`").cast("string") if f in rows.columns else F.lit(None).cast("string")).alias("actual")) for f, v in expected.items())))
    return rows.select(id_col, fields.alias("x")).select(id_col, "x.field", "x.expected", "x.actual").filter(~F.col("actual").eqNullSafe(F.col("expected")))
