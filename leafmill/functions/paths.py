"""URLs, file names, titles and display values, as column expressions."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

#: The known groups, in the order that facets show them. Folders named like a group belong to it.
GROUP_ORDER = ("CWSA", "CWM", "Disciples")
DEFAULT_FOLDERS = {g.lower(): (g, "") for g in GROUP_ORDER}


def basename(path: Column) -> Column:
    """U3."""
    return F.element_at(F.split(path, "[/\\\\]"), -1)


def page_url(base: str, root: str, path: Column, page: Column | None = None) -> Column:
    """Base, the path below root with forward slashes, and the page as a fragment."""
    below = F.regexp_replace(F.regexp_replace(path, r"\\", "/"), "^" + re.escape(root.rstrip("/")) + "/", "")
    url = F.concat(F.lit(base.rstrip("/") + "/"), below)
    return url if page is None else F.concat(url, F.lit("#page="), page.cast("string"))


def text_to_pdf_url(base: str, root: str, path: Column) -> Column:
    """The URL of the PDF that a text file was made from."""
    return F.replace(page_url(base, root, path), F.lit(".txt"), F.lit(".pdf"))


def url_without_page(url: Column) -> Column:
    """U4."""
    return F.substring_index(url, "#page=", 1)


def url_page(url: Column) -> Column:
    """U4: the page of a URL, 1 where it has none."""
    return F.coalesce(F.regexp_extract(url, r"#page=(\d+)", 1).try_cast("int"), F.lit(1))


def encode_uri(url: Column) -> Column:
    """Percent-encoding that keeps a URL's own marks."""
    found = F.replace(F.url_encode(url), F.lit("+"), F.lit("%20"))
    for mark in ";,/?:@&=+$-_.!~*'()#":
        found = F.replace(found, F.lit("%{:02X}".format(ord(mark))), F.lit(mark))
    return found


def viewer_link(url: Column, page: Column, query: Column) -> Column:
    """A link into the viewer, with page and search term."""
    quoted = lambda c: F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))
    return F.concat(F.lit("viewer.html?file="), quoted(url), F.lit("#page="), page.cast("string"), F.lit("&search="), quoted(query))


def title_case(text: str) -> str:
    """Capitals after anything that is no letter, as Python does it."""
    return text.title()


@F.pandas_udf(T.StringType())
def _title(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else title_case(t))


#: Fixed values (U6): numbers that a file name begins with, and where its words part.
LEADING_NUMBER, WORDS_PART = r"^[0-9]+[-_]*", "([a-z])([A-Z])"


def format_title(file: Column, exact: bool = True) -> Column:
    """A title from a file name. ``exact`` capitalises also after apostrophes and digits, which takes an Arrow UDF."""
    name = F.regexp_replace(F.replace(file, F.lit(".pdf"), F.lit("")), LEADING_NUMBER, "")
    spaced = F.translate(F.regexp_replace(name, WORDS_PART, "$1 $2"), "_-", "  ")
    return _title(spaced) if exact else F.initcap(spaced)


def folder_group(folder: Column, folders: dict[str, tuple[str, str]] | None = None) -> Column:
    """The group of a folder, the first of ``GROUP_ORDER`` where it is unknown. ``folders``: (group, description) by lower-cased name."""
    found = F.lit(GROUP_ORDER[0])
    for key, (group, _) in (folders or DEFAULT_FOLDERS).items():
        found = F.when(F.lower(folder) == key, group).otherwise(found)
    return found


def folder_description(folder: Column, folders: dict[str, tuple[str, str]] | None = None) -> Column:
    """The description of a folder, empty where it is unknown."""
    found = F.lit("")
    for key, (_, text) in (folders or DEFAULT_FOLDERS).items():
        found = F.when(F.lower(folder) == key, text).otherwise(found)
    return found


def capitalize(text: Column) -> Column:
    """First letter upper, the rest lower."""
    return F.concat(F.upper(F.left(text, F.lit(1))), F.lower(F.substr(text, F.lit(2))))


def group_label(group: Column, labels: dict[str, str]) -> Column:
    """The label of a group code, or the code."""
    found = group
    for code, label in labels.items():
        found = F.when(group == code, label).otherwise(found)
    return found


def two_decimals(value: Column) -> Column:
    """U9."""
    return F.format_string("%.2f", value)


def display(value: Column, default: str) -> Column:
    """A default for null and empty."""
    return F.coalesce(F.when(value != "", value), F.lit(default))
