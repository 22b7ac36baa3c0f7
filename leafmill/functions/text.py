"""Text functions: normalisation, tokens, highlighting, result snippets, sanitising.

Built-in expressions wherever Spark has them; Arrow UDFs for Unicode normalisation, the sanitiser, and for marks and
snippets of texts whose characters Java and Python treat differently.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Callable
from functools import lru_cache, reduce
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

#: The white space of Python's str.split(), 29 code points, as a Java character class.
WS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Quotes and dashes, and what they become after NFKC.
QUOTES, PLAIN = "“”‘’′–—", "\"\"'''--"
CHUNK_WORDS, OVERLAP_WORDS = 1000, 200


def normalize(text: str | None, quotes: bool = True) -> str | None:
    """NFKC, then plain quotes and dashes; T2 without the latter."""
    if text is None or text.isascii():
        return text
    found = unicodedata.normalize("NFKC", text)
    return found.translate(str.maketrans(QUOTES, PLAIN)) if quotes else found


def prepare(text: str | None) -> str | None:
    """T3 for one string: what queries go through on the driver."""
    return None if text is None else " ".join(normalize(text).split()).lower()


def _normalizer(quotes: bool):
    @F.pandas_udf(T.StringType())
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([normalize(t, quotes) for t in texts], index=texts.index, dtype=object)

    return run


def is_ascii(text: Column) -> Column:
    """Whether every character takes one byte."""
    return F.octet_length(text) == F.length(text)


def normalize_text(text: Column, quotes: bool = True) -> Column:
    """T1 and T2 as a column: only texts that are not ASCII leave the JVM."""
    return F.when(is_ascii(text), text).otherwise(_normalizer(quotes)(F.when(~is_ascii(text), text)))


def _collapsed(text: Column) -> Column:
    """Runs of ASCII white space become one blank, none is left at the ends. A single blank is no match, so little is replaced."""
    return F.trim(F.regexp_replace(text, r"\x20*+[\t-\r\x1c-\x1f][\t-\r\x1c-\x20]*+|\x20{2,}+", " "))


def collapse_space(text: Column) -> Column:
    """Runs of white space become one blank, none is left at the ends; a class of few ranges does for texts that are ASCII."""
    return F.when(is_ascii(text), _collapsed(text)).otherwise(F.trim(F.regexp_replace(text, WS + "+", " ")))


@F.pandas_udf(T.StringType())
def _prepared(texts: pd.Series) -> pd.Series:
    return pd.Series([prepare(t) for t in texts], index=texts.index, dtype=object)


def prepare_text(text: Column) -> Column:
    """Normalise, collapse white space, lower case; texts that are not ASCII in one go in an Arrow batch. Computed once at
    ingest, as ``snippet_norm``."""
    return F.when(is_ascii(text), F.lower(_collapsed(text))).otherwise(_prepared(F.when(~is_ascii(text), text)))


def tokens(prepared: Column) -> Column:
    """T4: the words of a prepared text; none for an empty one."""
    return F.when(prepared == "", F.array().cast("array<string>")).otherwise(F.split(prepared, " "))


def dehyphenate(text: Column) -> Column:
    """T5: a hyphen right before a line end joins the lines."""
    return F.replace(text, F.lit("-\n"), F.lit(""))


def truncate(text: Column, most: int = 500) -> Column:
    """The first ``most`` code points."""
    return F.substring(text, 1, most)


def breaks(text: Column, tag: str = "<br>") -> Column:
    """Line ends as tags."""
    return F.replace(text, F.lit("\n"), F.lit(tag))


def highlight_plain(text: Column, query: str) -> Column:
    """Every occurrence, in any case, without regard to word boundaries."""
    return F.regexp_replace(text, r"(?iu)(" + java_quote(query) + ")", "<mark>$1</mark>")


def java_quote(text: str) -> str:
    return "\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E"


#: What a query is prepared to, kept, as every line of a text asks for it.
_wanted = lru_cache(maxsize=1024)(prepare)


@lru_cache(maxsize=100_000)
def _changes(ch: str) -> bool:
    """Whether a character does not stand for itself, in either case, when texts are compared in lower case after NFKC."""
    return ch == "ı" or len(ch.lower()) != 1 or unicodedata.normalize("NFKC", ch) != ch


@lru_cache(maxsize=256)
def _phrase(wanted: str) -> re.Pattern:
    """A prepared phrase of ASCII characters, as it stands in a text none of whose characters ``_changes``."""
    alike = {p: f"[{re.escape(p)}{''.join(q for q, x in zip(QUOTES, PLAIN) if x == p)}]" for p in set(PLAIN)}
    return re.compile(r"\b" + r"\s+".join("".join(alike.get(ch) or re.escape(ch) for ch in w) for w in wanted.split(" ")) + r"\b", re.IGNORECASE)


def highlight(text: str, query: str, parity: bool = False) -> str:
    """The whole phrase between word boundaries, found in the normalised text and marked in the original.

    By default positions are carried back through the normalisation; with ``parity`` the offsets of the normalised text
    are used as they are, and drift where it changed the length.
    """
    wanted = _wanted(query)
    if not wanted or not text:
        return text
    if parity:
        spans = [m.span() for m in re.finditer(r"\b" + re.escape(wanted) + r"\b", prepare(text))]
    elif wanted.isascii() and (text.isascii() or not any(map(_changes, set(text)))):
        spans = [m.span() for m in _phrase(wanted).finditer(text)]
    else:
        shown, origin = [], []
        for i, ch in enumerate(text):
            for x in normalize(ch).lower():
                blank = x.isspace()
                if not (blank and shown and shown[-1] == " "):
                    shown.append(" " if blank else x)
                    origin.append(i)
        spans = [(origin[a], origin[b - 1] + 1) for a, b in (m.span() for m in re.finditer(r"\b" + re.escape(wanted) + r"\b", "".join(shown)))]
    out, at = [], 0
    for a, b in spans:
        out += [text[at:a], "<mark>", text[a:b], "</mark>"]
        at = b
    return "".join([*out, text[at:]])


class _Cleaner(HTMLParser):
    """Keeps br and mark without attributes, drops other tags but not their text, escapes the rest, closes open marks."""

    def __init__(self, allowed: frozenset[str]) -> None:
        super().__init__(convert_charrefs=True)
        self.allowed, self.out, self.open = allowed, [], []

    def handle_starttag(self, tag, attrs):
        if tag in self.allowed:
            self.out.append(f"<{tag}>")
            if tag != "br":
                self.open.append(tag)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag in self.open:
            while self.open:
                last = self.open.pop()
                self.out.append(f"</{last}>")
                if last == tag:
                    break

    def handle_data(self, data):
        self.out.append(html.escape(data, quote=False))


def sanitize(text: str | None, allowed: frozenset[str] = frozenset({"br", "mark"})) -> str | None:
    """An allow-list of tags."""
    if text is None or not re.search("[<>&]", text):
        return text
    cleaner = _Cleaner(allowed)
    # A '<' that opens no tag is text.
    cleaner.feed(re.sub(r"<(?![a-zA-Z/!?])", "&lt;", text))
    cleaner.close()
    cleaner.out += [f"</{tag}>" for tag in reversed(cleaner.open)]
    return "".join(cleaner.out)


def _lines_window(lines: list[str], hits: list[int], query: str, before: int, after: int, least: int, widen: int) -> str:
    start, end = max(0, hits[0] - before), min(len(lines), hits[-1] + after)
    mark = lambda a, b: [highlight(x, query) for x in lines[a:b]]
    chosen = mark(start, end)
    if len("\n".join(chosen)) < least:
        chosen = mark(max(0, start - widen), min(len(lines), end + widen))
    return "\n".join(chosen)


def snippet_lines(text: str | None, query: str, least: int = 200, most: int = 500) -> str | None:
    """Lines with any word of the query, five lines around them, marked, sanitised, cut last."""
    if text is None:
        return None
    words = (_wanted(query) or "").split()
    lines = text.split("\n")
    hits = [i for i, line in enumerate(lines) if not words or any(w in prepare(line) for w in words)]
    found = _lines_window(lines, hits, query, 5, 6, least, 5) if hits else highlight(text[:most], query)
    return sanitize(found.replace("\n", "<br/>"))[:most]


def snippet_first_line(text: str | None, query: str, least: int = 200, most: int = 500) -> str | None:
    """The first line with the whole query, lines stripped; without one, the head of the text, marked after the cut."""
    if text is None:
        return None
    lines = text.split("\n")
    at = next((i for i, line in enumerate(lines) if query.lower() in line.lower()), None)
    if at is None:
        return highlight(sanitize(text[:most].replace("\n", "<br/>")), query)
    a, b = max(0, at - 5), min(len(lines), at + 5)
    chosen = [highlight(x.strip(), query) for x in lines[a:b]]
    if len("\n".join(chosen)) < least:
        chosen = [highlight(x.strip(), query) for x in lines[max(0, a - 5) : min(len(lines), b + 5)]]
    return sanitize("<br/>".join(chosen))[:most]


def snippet_sentences(text: str | None, query: str, least: int = 200, most: int = 500) -> str | None:
    """Two sentences around the first with the query; sentences end at a mark before white space."""
    if text is None:
        return None
    parts = re.split(r"(?<=[.!?])\s+", text)
    at = next((i for i, s in enumerate(parts) if query.lower() in s.lower()), None)
    if at is None:
        return highlight(text[:most], query)
    a, b = max(0, at - 2), min(len(parts), at + 3)
    found = " ".join(highlight(s, query) for s in parts[a:b])
    if len(found) < least:
        found = " ".join(highlight(s, query) for s in parts[max(0, a - 2) : b + 2])
    return found[:most]


SNIPPETS = {"lines": snippet_lines, "first_line": snippet_first_line, "sentences": snippet_sentences}


def _simple(text: Column) -> Column:
    """Whether the built-in forms of T20 and T22 give what Python gives: ASCII but for the quotes and dashes of ``QUOTES``, and
    without signs of markup."""
    return ~text.rlike(f"[^\\x00-\\x7F{QUOTES}]|[<>&]")


def _plain_query(query: str) -> bool:
    return query.isascii()


def marked(text: Column, query: str) -> Column:
    """T20 in the JVM, for a query of ASCII characters and ``_simple`` texts: blanks of the query stand
    for any white space, quotes and dashes for all that become them, and word boundaries are where Python's are."""
    words = (prepare(query) or "").split()
    if not words:
        return text
    alike = {p: f"[{re.escape(p)}{''.join(q for q, x in zip(QUOTES, PLAIN) if x == p)}]" for p in set(PLAIN)}
    phrase = (WS + "+").join("".join(alike.get(ch) or java_quote(ch) for ch in w) for w in words)
    inside = r"[\p{L}\p{N}_]"
    edge = lambda ch, look, other: f"({look}!{inside})" if re.match(r"\w", ch) else f"({look}={other})"
    before, after = edge(words[0][0], "?<", inside), edge(words[-1][-1], "?", inside)
    return F.regexp_replace(text, f"(?iu){before}({phrase}){after}", "<mark>$1</mark>")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _lines_builtin(text: Column, query: str, least: int, most: int) -> Column:
    """T22 in the JVM, under the conditions of ``marked``; there is nothing to sanitise then but the line ends."""
    words = (prepare(query) or "").split()
    quoted = any(p in w for w in words for p in PLAIN)
    plain = lambda line: F.lower(F.translate(line, QUOTES, PLAIN) if quoted else line)
    hit = lambda line: reduce(lambda a, b: a | b, (F.contains(plain(line), F.lit(w)) for w in words)) if words else F.lit(True)
    show = lambda lines, a, b: F.array_join(F.transform(F.slice(lines, a + 1, b - a), lambda line: marked(line, query)), "\n")

    def around(lines: Column, hits: Column) -> Column:
        start, end = F.greatest(F.element_at(hits, 1) - 5, F.lit(0)), F.least(F.element_at(hits, -1) + 6, F.size(lines))
        wide = show(lines, F.greatest(start - 5, F.lit(0)), F.least(end + 5, F.size(lines)))
        return _let(show(lines, start, end), lambda narrow: F.when(F.length(narrow) >= least, narrow).otherwise(wide))

    def of(lines: Column) -> Column:
        places = F.filter(F.transform(lines, lambda line, i: F.when(hit(line), i)), lambda i: i.isNotNull())
        return _let(places, lambda hits: F.when(F.size(hits) == 0, marked(F.substring(text, 1, most), query)).otherwise(around(lines, hits)))

    return F.substring(F.replace(_let(F.split(text, "\n", -1), of), F.lit("\n"), F.lit("<br>")), 1, most)


def snippet(text: Column, query: str, kind: str = "lines") -> Column:
    """A result snippet as a column; to be used on matching rows only. T22 stays in the JVM for texts that are
    ``_simple``; the other kinds, which need a sanitiser or a sentence splitter, run in Arrow batches."""
    make = SNIPPETS[kind]

    @F.pandas_udf(T.StringType())
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else make(t, query) for t in texts], index=texts.index, dtype=object)

    if kind != "lines" or not _plain_query(query):
        return run(text)
    simple = _simple(text)
    return F.when(simple, _lines_builtin(text, query, 200, 500)).otherwise(run(F.when(~simple, text)))


def highlighted(text: Column, query: str, parity: bool = False) -> Column:
    """T20 as a column: in the JVM for ``_simple`` texts, but for the drifting offsets of ``parity``."""

    @F.pandas_udf(T.StringType())
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else highlight(t, query, parity) for t in texts], index=texts.index, dtype=object)

    if parity or not _plain_query(query):
        return run(text)
    simple = _simple(text)
    return F.when(simple, marked(text, query)).otherwise(run(F.when(~simple, text)))


@F.pandas_udf(T.StringType())
def sanitize_html(texts: pd.Series) -> pd.Series:
    """T27 as a column: only texts with markup are parsed."""
    found = texts.copy()
    with_markup = texts.notna() & texts.str.contains("[<>&]", regex=True, na=False)
    found[with_markup] = [sanitize(t) for t in texts[with_markup]]
    return found
