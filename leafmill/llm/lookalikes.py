"""One form for text that looks the same but is stored in different characters.

Look-alike strings (a letter and its full-width form, a letter with a separate accent and the composed letter, a blank
and its typographic kin, letters of different scripts with one shape) are joined to classes by union-find, so that
classes are transitive. The representative of a class is its most frequent member in the corpus, within the script of
the word where a letter stands. A multi-pattern automaton finds all members in one pass and rewrites the longest from
the left.

What stays: words wholly in one script, full-width punctuation, joiners between letters whose spelling needs them
(after or before a virama, between Arabic letters) or between emoji, typographic quotes, dashes and hyphens, tabs and
line ends.

Defined results: null stays null, an empty text empty; letters of a foreign script without a look-alike in the word's
own script stay; ties in frequency go to the lower code point, ties between a word's scripts to the script that the
whole value has more of, then to the one that comes first in ``SCRIPTS``.
"""

from __future__ import annotations

import unicodedata as ud
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

#: Letters of other scripts that have the shape of a Latin letter.
SHAPES = {
    "a": "аα", "c": "сϲ", "d": "ԁ", "e": "е", "g": "ց", "h": "һհ", "i": "іιı", "j": "јϳ", "k": "кκ", "l": "ӏ", "m": "м", "n": "ոη", "o": "оοօ", "p": "рρ",
    "q": "ԛզ", "r": "г", "s": "ѕտ", "t": "тτ", "u": "υսц", "v": "νѵ", "w": "ԝա", "x": "хχ", "y": "уγу", "z": "ᴢ",
    "A": "АΑ", "B": "ВΒ", "C": "СϹ", "E": "ЕΕ", "F": "Ϝ", "G": "Ԍ", "H": "НΗ", "I": "ІΙӀ", "J": "ЈͿ", "K": "КΚ", "L": "Լ", "M": "МΜ", "N": "Ν", "O": "ОΟՕ", "P": "РΡ",
    "Q": "Ԛ", "S": "ЅՏ", "T": "ТΤ", "U": "Ս", "V": "Ѵ", "W": "Ԝ", "X": "ХΧ", "Y": "ҮΥ", "Z": "Ζ",
}
SCRIPTS = ("LATIN", "GREEK", "CYRILLIC", "ARMENIAN")
BLANKS = [chr(c) for c in (0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F)]
INVISIBLE = [chr(c) for c in (0xAD, 0x34F, 0x180E, 0x200B, 0x200E, 0x200F, *range(0x202A, 0x202F), *range(0x2060, 0x2065), *range(0x2066, 0x206A), 0xFEFF)]
JOINERS = "‌‍"
PRESENTATION = [range(0xFB00, 0xFB50), range(0xFB50, 0xFE00), range(0xFE70, 0xFEFF), range(0xFF00, 0xFFF0), range(0x1D400, 0x1D800)]


@lru_cache(maxsize=None)
def script(char: str) -> str:
    """The script of a letter, '' for anything else. Full-width and mathematical letters count as what they show."""
    if not ud.category(char).startswith("L"):
        return ""
    name = ud.name(char, "").split()[0] if ud.name(char, "") else ""
    return script(ud.normalize("NFKC", char)[0]) if name in ("FULLWIDTH", "MATHEMATICAL") and ud.normalize("NFKC", char)[0] != char else name


class Classes:
    """Union-find over strings."""

    def __init__(self) -> None:
        self.parent: dict[str, str] = {}

    def find(self, x: str) -> str:
        self.parent.setdefault(x, x)
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def join(self, a: str, b: str) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)

    def members(self) -> dict[str, list[str]]:
        found: dict[str, list[str]] = defaultdict(list)
        for x in self.parent:
            found[self.find(x)].append(x)
        return found


@lru_cache(maxsize=1)
def look_alikes() -> Classes:
    """All classes, built from Unicode's decompositions and the table of shapes."""
    classes = Classes()
    for block in PRESENTATION:
        for code in block:
            plain = ud.normalize("NFKC", char := chr(code))
            if plain != char and ud.category(char)[0] in "LN" and all(ud.category(x)[0] in "LNM" for x in plain):
                classes.join(char, plain)
    for code in range(0xC0, 0x2000):
        char = chr(code)
        apart = ud.normalize("NFD", char)
        if apart != char and script(apart[0]) in SCRIPTS:
            composed = ud.normalize("NFC", char)
            for form in {apart, char, *(ud.normalize("NFC", apart[:k]) + apart[k:] for k in range(1, len(apart)))}:
                if form != composed:
                    classes.join(form, composed)
    for char in ("K", "Å", *map(chr, range(0xF900, 0xFB00))):
        if ud.normalize("NFC", char) != char:
            classes.join(char, ud.normalize("NFC", char))
    for latin, others in SHAPES.items():
        for other in others:
            classes.join(other, latin)
    for blank in BLANKS:
        classes.join(blank, " ")
    for char in (*INVISIBLE, *JOINERS):
        classes.join(char, "")
    return classes


@lru_cache(maxsize=1)
def _single_members() -> np.ndarray:
    return np.array(sorted(ord(x) for x in look_alikes().parent if len(x) == 1))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each one-character member stands in these texts."""
    total = np.zeros(0x110000, np.int64)
    for batch in batches:
        for column in batch.columns:
            whole = "".join(x for x in column.to_pylist() if x)
            total += np.bincount(np.frombuffer(whole.encode("utf-32-le", "replace"), np.uint32), minlength=0x110000)
    members = _single_members()
    members = members[total[members] > 0]
    yield pa.RecordBatch.from_arrays([pa.array(members.astype(np.int32)), pa.array(total[members])], names=["code", "n"])


def member_counts(docs: DataFrame, text_cols: list[str]) -> dict[str, int]:
    """Occurrences of every class member in the whole corpus; as many entries at most as the classes have characters."""
    counts = docs.select(*text_cols).mapInArrow(_count, "code int, n bigint").groupBy("code").agg(F.sum("n").alias("n"))
    return {chr(r["code"]): r["n"] for r in counts.collect()}


class Rewriter:
    """The automaton over all members and the representatives that ``counts`` decide."""

    def __init__(self, counts: dict[str, int]) -> None:
        import ahocorasick
        import regex

        self.automaton = ahocorasick.Automaton()
        self.by_script: dict[str, dict[str, str]] = {}
        self.word = regex.compile(r"\p{L}[\p{L}\p{M}­​-‍⁠﻿]*")
        shapes = {x for k, v in SHAPES.items() for x in (k, *v)}
        for members in look_alikes().members().values():
            stable = [m for m in members if ud.normalize("NFKC", m) == m] or members
            rank = lambda m: (-counts.get(m, 0), -ud.is_normalized("NFC", m), m)
            if "" in members:
                whole = ""
            elif " " in members:
                whole = " "
            else:
                whole = min(stable, key=rank)
            scripts = {script(m[0]) for m in members if m} & set(SCRIPTS)
            own = {s: min((m for m in stable if m and script(m[0]) == s), key=rank, default=None) for s in scripts}
            for m in members:
                if m in shapes and ud.normalize("NFKC", m) == m:  # its own script's letter: only a foreign word changes it
                    self.by_script[m] = {s: r for s, r in own.items() if r}
                    self.automaton.add_word(m, (m, "shape", m))
                elif m and m in JOINERS:
                    self.automaton.add_word(m, (m, "joiner", ""))
                elif m and m not in (" ", ""):
                    target = whole if len(scripts) < 2 else own.get(script(m[0])) or whole
                    if target != m and not (len(stable) and m == target):
                        self.automaton.add_word(m, (m, "always", target))
        self.automaton.make_automaton()

    def suspect(self) -> str:
        """A pattern (RE2) that every text which the automaton changes has a match of, made from the automaton itself: a
        character of every string that is always replaced, or two scripts in one word."""
        single, whole = set(), set()
        for key, (_, kind, _) in self.automaton.items():
            if kind != "shape":
                strange = [ch for ch in key if not ch.isascii()]
                (single if strange else whole).add(strange[-1] if strange else key)
        word = r"[\p{L}\p{M}\x{AD}\x{200B}-\x{200D}\x{2060}\x{FEFF}]*"
        names = [s.capitalize() for s in SCRIPTS]
        mixed = [rf"\p{{{s}}}{word}[{''.join(rf'\p{{{o}}}' for o in names if o != s)}]" for s in names]
        chars = "[" + "".join(f"\\x{{{ord(ch):X}}}" for ch in sorted(single)) + "]"
        return "|".join([chars, *mixed, *("\\x{" + "}\\x{".join(f"{ord(ch):X}" for ch in key) + "}" for key in sorted(whole))])

    @staticmethod
    def _needed(text: str, at: int) -> bool:
        """Whether the joiner at ``at`` belongs to the spelling."""
        before, after = text[at - 1 : at], text[at + 1 : at + 2]
        if not before or not after:
            return False
        if ud.combining(before) == 9 or ud.combining(after) == 9:
            return True
        if ud.bidirectional(before) in ("AL", "NSM") and ud.bidirectional(after) == "AL":
            return True
        return ud.category(before) in ("So", "Sk", "Mn") and ud.category(after) in ("So", "Sk") or before == "️"

    def _mixed(self, text: str) -> dict[int, str]:
        """For every position inside a word of several scripts, the script that the word is to have."""
        found: dict[int, str] = {}
        whole: Counter | None = None
        for m in self.word.finditer(text):
            if m.group().isascii():
                continue
            own = Counter(s for s in map(script, m.group()) if s in SCRIPTS)
            if len(own) > 1:
                if whole is None:
                    whole = Counter(s for s in map(script, text) if s in SCRIPTS)
                best = max(own, key=lambda s: (own[s], whole[s], -SCRIPTS.index(s)))
                found.update(dict.fromkeys(range(m.start(), m.end()), best))
        return found

    def __call__(self, text: str | None) -> str | None:
        if not text or text.isascii():
            return text
        mixed = self._mixed(text)
        out, at = [], 0
        for end, (found, kind, target) in self.automaton.iter_long(text):
            start = end - len(found) + 1
            if kind == "shape":
                target = self.by_script[found].get(mixed.get(start, ""), found)
            elif kind == "joiner" and self._needed(text, start):
                target = found
            elif kind == "always" and start in mixed and target in self.by_script:
                target = self.by_script[target].get(mixed[start], target)
            if target != found:
                out += [text[at:start], target]
                at = end + 1
        return "".join([*out, text[at:]]) if out else text


def _rewrite(rewriter_counts: dict[str, int], n_carried: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rewriter = Rewriter(rewriter_counts)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:n_carried], *(pa.array(map(rewriter, c.to_pylist()), pa.string()) for c in batch.columns[n_carried:])], schema=schema)

    return run


def unify(docs: DataFrame, text_cols: list[str], carry: list[str]) -> DataFrame:
    """The columns ``carry`` as they are, and each of ``text_cols`` in its one form. Every row comes out."""
    from pyspark.sql.pandas.types import to_arrow_schema

    chosen = docs.select(*carry, *text_cols)
    return chosen.mapInArrow(_rewrite(member_counts(docs, text_cols), len(carry), to_arrow_schema(chosen.schema)), chosen.schema)


def _changed(rewriter_counts: dict[str, int], schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rewriter = Rewriter(rewriter_counts)
        suspect = rewriter.suspect()
        for batch in batches:
            some = batch.filter(pc.match_substring_regex(batch.column(2), suspect))
            changed = [rewriter(value) != value for value in some.column(2).to_pylist()]
            yield some.filter(pa.array(changed, pa.bool_())).select([0, 1]).cast(schema)

    return run


def changed_values(docs: DataFrame, text_cols: list[str], id_col: str) -> DataFrame:
    """(id_col, field): the values that ``unify`` changes. ASCII values never leave the JVM, and only those that match the
    automaton's own ``suspect`` pattern are rewritten."""
    from pyspark.sql.pandas.types import to_arrow_schema

    rows = F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in text_cols)))
    values = docs.select(F.col(id_col), rows.alias("v")).select(id_col, "v.field", "v.value").filter(F.octet_length("value") > F.length("value"))
    out = values.select(id_col, "field")
    return values.mapInArrow(_changed(member_counts(docs, text_cols), to_arrow_schema(out.schema)), out.schema).distinct()
