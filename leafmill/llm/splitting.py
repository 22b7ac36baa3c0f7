"""Cutting oversized items into overlapping pieces at natural boundaries.

The text is parsed into a tree of spans. Headings (markdown, numbered chapters, lines in capitals, HTML) own the section
below them, up to the next heading of their level; within a section blocks stand between empty lines; list entries own
what is indented below them; HTML elements own what they enclose. Below a block come sentences, lines, clauses, words and
grapheme clusters, which are only looked for where a block is too long.

Pieces are packed bottom-up: a subtree that fits is one unit; only an oversized one is opened, its children are packed by
themselves, and units that stand side by side are merged while they fit, within their subtree before they meet the next. A
heading, and a line that ends in a colon, belong to the first unit of what follows them and never end a piece, unless
nothing follows.

Defined results: null texts and texts within the limit give no piece; every piece has at most ``limit`` code points,
repeats the last ``overlap`` code points of the piece before it, and the pieces without their repeats are the text,
character by character; repeated rows are cut each for itself; other columns are carried along under their names; markup
that is not closed ends with what encloses it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

LIMIT = 1200
OVERLAP = 150
#: What ends a part of a block at each level, from the strongest boundary to the weakest. A part keeps its end.
LEVELS = (
    r"""(?:(?<!\b\p{L}|\b(?:Mr|Mrs|Dr|St|No|vol|Prof|cf|ch|pp|e\.g|i\.e))[.]|[!?…։።፧؟]|[।॥။]|[.!?][”"»’)\]]+)[”"»’)\]]*\s+|[。！？][」』”）]*""",
    r"\n",
    r"[,;:،；：，、၊፣—–][”\"»’)\]]*\s*",
    r"\s+",
    r"\X",
)
#: Elements of HTML that hold text of their own, and those of them that end where the next of their kind begins.
ELEMENTS = "html|head|body|main|article|section|div|header|footer|nav|aside|ul|ol|li|dl|dt|dd|p|blockquote|pre|table|thead|tbody|tr|td|th|figure|figcaption|h[1-6]"
CLOSED_BY = {"li": ("li",), "p": ("p", "ul", "ol", "table", "div", "section", "blockquote", "h1", "h2", "h3", "h4", "h5", "h6"), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th", "tr"), "th": ("td", "th", "tr")}


@dataclass
class Span:
    """A node of the structure tree: the text from ``start`` to ``end``, in the order of its children. ``lead`` marks a span that
    belongs with the one behind it, ``heading`` one that is a heading or a section of headings alone."""

    start: int
    end: int
    children: list[Span] = field(default_factory=list)
    lead: bool = False
    heading: bool = False
    name: str = ""


@lru_cache(maxsize=1)
def _patterns() -> dict:
    import regex

    made = {
        "markdown": r"\s{0,3}(#{1,6})\s+\S", "chapter": r"\s*(?i:(?:part|book|volume)|(chapter|canto|section|letter|talk))\s+[\divxlcIVXLC]+\b[^.!?]*$", "capitals": r"\s*[\p{Lu}\p{N}\p{M}\p{P}\p{Zs}]*\p{Lu}[\p{Lu}\p{N}\p{M}\p{P}\p{Zs}]+$",
        "item": r"([ \t]*)(?:[-*•–—+]|\(?(?:\d{1,4}|\p{L}|[ivxlc]{1,6})[.)])[ \t]+\S", "tag": rf"<(/?)({ELEMENTS})\b[^<>]*>",
    }
    return {k: regex.compile(p) for k, p in made.items()} | {"levels": [regex.compile(p) for p in LEVELS]}


def _heading(line: str) -> int:
    """The level of a heading, from 1; 0 for any other line."""
    match = _patterns()
    if m := match["markdown"].match(line):
        return 2 + len(m[1])
    if m := match["chapter"].match(line):
        return 2 if m[1] else 1
    return 9 if match["capitals"].match(line) and sum(map(str.isalpha, line)) > 2 else 0


def _lines(text: str, start: int, end: int) -> Iterator[tuple[int, int, str]]:
    at = start
    while at < end:
        stop = text.find("\n", at, end)
        stop = end if stop < 0 else stop + 1
        yield at, stop, text[at:stop].rstrip()
        at = stop


def _sections(text: str, start: int, end: int) -> list[Span]:
    """Sections within sections, by the levels of their headings; what stands before the first heading comes first."""
    root = Span(start, end)
    path: list[tuple[int, Span]] = [(0, root)]
    body: int | None = None

    def flush(at: int) -> None:
        nonlocal body
        if body is not None and body < at:
            above, first = path[-1][1].children, at - len(text[body:at].lstrip())
            if above:  # empty lines end the heading above them
                above[-1].end = body = at if first == at else max(body, text.rfind("\n", body, first) + 1)
            if body < at:
                above += _blocks(text, body, at)
        body = None

    blank = True
    for at, stop, line in _lines(text, start, end):
        # Capitals head a section only where they stand apart, so that a line of verse or a shout within a block does not.
        level = _heading(line) if line else 0
        if level == 9 and not blank:
            level = 0
        if level:
            flush(at)
            while path[-1][0] >= level:
                path.pop()[1].end = at
            section = Span(at, end, [Span(at, stop, lead=True, heading=True)])
            path[-1][1].children.append(section)
            path.append((level, section))
        elif body is None:
            body = at
        blank = not line
    flush(end)
    _bare(root)
    return root.children


def _bare(node: Span) -> bool:
    """Marks sections of nothing but headings, which lead to what stands behind them."""
    bare = [_bare(child) for child in node.children if not child.lead]
    if node.children and node.children[0].heading and all(bare):
        node.lead = node.heading = True
    return node.lead


def _blocks(text: str, start: int, end: int) -> list[Span]:
    """Blocks between empty lines, which end the block above them; blocks with list entries are trees of those."""
    found: list[list[tuple[int, int, str]]] = [[]]
    ended = False
    for row in _lines(text, start, end):
        if row[2] and ended:
            found.append([])
        ended = not row[2] and any(r[2] for r in found[-1])
        found[-1].append(row)
    return [_block(rows) for rows in found if rows]


def _block(rows: list[tuple[int, int, str]]) -> Span:
    """A block: its list entries own the entries and lines that are indented below them."""
    item = _patterns()["item"].match
    whole = Span(rows[0][0], rows[-1][1])
    path: list[tuple[int, Span]] = [(-1, whole)]
    for at, stop, line in rows:
        m = item(line)
        if m:
            indent = len(m[1].expandtabs(4))
            while path[-1][0] >= indent:
                path.pop()[1].end = at
            if not path[-1][1].children and path[-1][1].start < at:
                path[-1][1].children.append(Span(path[-1][1].start, at, lead=True))
            entry = Span(at, rows[-1][1])
            path[-1][1].children.append(entry)
            path.append((indent, entry))
    return whole


def _elements(text: str) -> list[Span] | None:
    """HTML elements as a tree, with the text between them as leaves; None for a text without any."""
    tags = list(_patterns()["tag"].finditer(text))
    if not any(not m[1] for m in tags):
        return None
    root = Span(0, len(text))
    path = [root]

    def finish(at: int) -> None:
        node = path.pop()
        node.end = at

    for m in tags:
        name = m[2].lower()
        if not m[1]:
            while len(path) > 1 and name in CLOSED_BY.get(path[-1].name, ()):
                finish(m.start())
            node = Span(m.start(), len(text), name=name, lead=(heading := name[0] == "h" and name[1:].isdigit()), heading=heading)
            path[-1].children.append(node)
            path.append(node)
        elif any(node.name == name for node in path[1:]):
            while path[-1].name != name:
                finish(m.start())
            finish(m.end())
    while len(path) > 1:
        finish(len(text))
    return root.children


def _filled(text: str, start: int, end: int, children: list[Span]) -> list[Span]:
    """The children with what stands between them: short gaps go with the child behind, longer ones are read as text."""
    out: list[Span] = []
    at = start
    for child in children:
        if at < child.start:
            if text[at : child.start].strip():
                out += _sections(text, at, child.start)
            else:
                child.start = at
        out.append(child)
        at = child.end
    if at < end:
        if not out or text[at:end].strip():
            out += _sections(text, at, end)
        else:
            out[-1].end = end
    return out


def structure(text: str) -> Span:
    """The structure tree of a text."""
    elements = _elements(text)
    if elements is None:
        return Span(0, len(text), _sections(text, 0, len(text)))

    def read(node: Span) -> None:
        if node.children:
            for child in node.children:
                read(child)
            node.children = _filled(text, node.start, node.end, node.children)
        elif not node.lead:
            parts = _sections(text, node.start, node.end)
            node.children = parts if len(parts) > 1 else []

    root = Span(0, len(text), elements)
    read(root)
    return root


def _glued(text: str, children: list[Span], begin: int, room: int) -> list[tuple[Span, int]]:
    """Each child with where its units begin, the first at ``begin``: earlier than the child, where headings or an opening line
    lead to it. What leads takes half a
    piece at most, so that the first words of what follows fit beside it; of a longer row of headings the last do."""
    out: list[tuple[Span, int]] = []
    last = begin  # where the last heading begins
    for k, child in enumerate(children):
        opens = child.lead or (not child.children and text[child.start : child.end].rstrip().endswith((":", "：")))
        leads = k + 1 < len(children) and (child.heading or opens and child.end - begin <= room // 2)
        # Headings that lead here from above may part from a further heading, but not from an entry's own text.
        if (k or child.heading) and begin < child.start and (child.end if leads else child.start) - begin > room // 2:
            part = last if not leads and begin < last and child.start - last <= room // 2 else child.start
            out.append((Span(begin, part), begin))
            begin = part
        if leads:
            last = child.start if k or child.heading else begin
        else:
            out.append((child, begin))
            begin = child.end
    return out


def _units(text: str, node: Span, start: int, room: int, level: int = 0) -> list[int]:
    """Where the units of a node end, which begins at ``start``; each has at most ``room`` characters."""
    if node.end - start <= room:
        return [node.end]
    if node.children:
        children = _glued(text, node.children, start, room)
    else:
        levels = _patterns()["levels"]
        if level == len(levels):  # a cluster longer than the limit
            return [*range(start + room, node.end, room), node.end]
        ends = [m.end() for m in levels[level].finditer(text, node.start, node.end) if m.end() < node.end] + [node.end]
        begins = [node.start, *ends[:-1]]
        children = [(Span(a, b), a) for a, b in zip(begins, ends)]
        children[0] = (children[0][0], start)
        level += 1
    out: list[int] = []
    at = start  # where the last unit begins
    for child, begin in children:
        for end in _units(text, child, begin, room, 0 if node.children else level):
            if out and end - at <= room:
                out[-1] = end
            else:
                at = out[-1] if out else start
                out.append(end)
    return out


def cut_points(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[int]:
    """Where the pieces of ``text`` end, in order; the last is its length. ``overlap`` must be less than ``limit``."""
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be at least 0 and less than the limit")
    root = structure(text)
    ends = _units(text, root, 0, limit - overlap)
    # The first piece repeats nothing, and so has room for what the second begins with, if that is all of it.
    return ends[1:] if len(ends) > 1 and ends[1] <= limit else ends


def _pieces(n_carried: int, limit: int, overlap: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, cols = [], [[] for _ in range(6)]
            for i, text in enumerate(batch.column(n_carried).to_pylist()):
                if text is None or len(text) <= limit:
                    continue
                ends = cut_points(text, limit, overlap)
                for k, end in enumerate(ends):
                    begin = max(0, ends[k - 1] - overlap) if k else 0
                    rows.append(i)
                    for c, v in zip(cols, (k, len(ends), begin, end, ends[k - 1] - begin if k else 0, text[begin:end])):
                        c.append(v)
            carried = pa.RecordBatch.from_arrays(batch.columns[:n_carried], names=batch.schema.names[:n_carried]).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*carried.columns, *(pa.array(c, type=f.type) for c, f in zip(cols, list(schema)[n_carried:]))], schema=schema)

    return run


def split_oversized(items: DataFrame, text_col: str, carry: list[str], *, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """The columns ``carry`` and piece_no, n_pieces, start_pos, end_pos, repeated, piece for every item over ``limit``."""
    from pyspark.sql.pandas.types import to_arrow_schema

    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be at least 0 and less than the limit")
    over = items.filter(F.length(text_col) > limit).select(*carry, F.col(text_col).alias("__text"))
    out = T.StructType([*(T.StructField(c, items.schema[c].dataType) for c in carry), *(T.StructField(c, T.IntegerType()) for c in ("piece_no", "n_pieces", "start_pos", "end_pos", "repeated")), T.StructField("piece", T.StringType())])
    return over.mapInArrow(_pieces(len(carry), limit, overlap, to_arrow_schema(out)), out)
