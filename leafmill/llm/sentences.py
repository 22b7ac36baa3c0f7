"""Sentences of texts in any script.

Follows the character properties of Unicode's sentence-break rules: a run of terminators (STerm, ATerm), the closing quotes
and brackets behind it (Close) and the blanks behind those (Sp, Sep) end a sentence, unless a rule below keeps it together:
a small letter (Lower) or a mark that continues (SContinue) right behind it, or what the text's language shortens with a full
stop. Tailored where the default rules go wrong: quotations that end inside a sentence, marks that count only in one script
(the Greek question mark), and scripts that part sentences with a blank.

Shortened words are those of the text's language; a word in another script than the language's is looked up in the languages
of its own script. Some are shortened words before a number alone ('No. 4', but 'I said no.'), some as titles before a name
('Col. Vask', but 'He hit col.'). A language that isn't given, or isn't known, is guessed from the text's script, and among
those of Latin script from its commonest words.

Defined results: null texts and texts without a visible character have no sentence; what follows the last terminator is
a sentence; a text without any terminator is one; an empty line ends a sentence, a single line end does not; repeated
rows are cut each for itself; a null language is an unknown one.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

#: By language, the shortened words after which a sentence goes on.
NEVER_FINAL = {
    "en": ("e.g", "i.e", "cf", "vol", "vols", "p", "pp", "ch", "chs", "nos", "mr", "mrs", "ms", "dr", "prof", "figs", "ed", "eds", "vs", "viz", "messrs"),
    "fr": ("cf", "vol", "vols", "p", "pp", "ch", "chap", "mme", "mlle", "m", "mm", "dr", "prof", "p. ex", "par ex", "fig", "éd", "st"),
    "de": ("nr", "bzw", "z. b", "z.b", "d. h", "d.h", "u. a", "u.a", "vgl", "bd", "hr", "fr", "dr", "prof", "ca", "evtl", "st", "s", "p", "pp", "vol"),
    "ru": ("т. е", "т.е", "стр", "др", "г", "гл", "см", "ср", "проф"),
    "el": ("π.χ", "δηλ", "σελ", "κ", "κεφ", "βλ"),
    "fa": ("ص", "ج"), "ar": ("ص", "ج"), "hy": ("դոկտ", "տես", "էջ"), "am": ("ቁ",), "hi": ("डॉ", "पृ", "सं", "श्री"), "bn": ("ডা", "পৃ", "ড"), "ta": ("நூ", "பக்", "திரு", "டாக்"),
}
#: Words that are shortened only before a number.
BEFORE_NUMBER = {"en": ("no", "fig", "art", "sec", "col", "st"), "fr": ("no", "art", "col"), "de": ("art", "abs")}
#: Words that are shortened only as a title, with a capital, before a name.
BEFORE_NAME = {"en": ("st", "rev", "fr", "capt", "gen", "col", "lt", "hon"), "fr": ("st", "ste", "mgr"), "de": ("hl",)}
#: Shortened words that end a sentence if a capital follows.
SOMETIMES_FINAL = {"en": ("etc", "a.m", "p.m", "inc", "ltd", "jr", "sr", "co"), "fr": ("etc",), "de": ("usw", "etc"), "ru": ("и т. д", "т. д", "т.д", "т. п", "и др")}
#: The script of each language, and names that stand for its code.
SCRIPT_OF = {"en": "Latin", "fr": "Latin", "de": "Latin", "ru": "Cyrillic", "el": "Greek", "fa": "Arabic", "ar": "Arabic", "hy": "Armenian", "am": "Ethiopic", "hi": "Devanagari", "bn": "Bengali", "ta": "Tamil"}
NAMES = {"english": "en", "french": "fr", "german": "de", "russian": "ru", "greek": "el", "persian": "fa", "arabic": "ar", "armenian": "hy", "amharic": "am", "hindi": "hi", "bengali": "bn", "tamil": "ta"}
#: Words that tell the languages of Latin script apart.
COMMON_WORDS = {"en": "the of and to is that with".split(), "fr": "le la les et des une est dans que".split(), "de": "der die das und ist nicht ein mit".split()}
#: And letters that do.
LETTERS = {"en": "", "fr": "éèêçàâîôûœ", "de": "äöüß"}
BLANKS = " \t\r\n\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200C))) + "\u2028\u2029\u202f\u205f\u2060\u3000\ufeff"


@lru_cache(maxsize=1024)
def language_code(name: str | None) -> str | None:
    """The code of a language that is given as a code, with or without a region, or by its English name, the first of several."""
    first = (name or "").strip().lower().replace("_", "-").split(",")[0].split("-")[0].strip()
    code = NAMES.get(first, first)
    return code if code in SCRIPT_OF else None


@lru_cache(maxsize=1)
def _tools():
    import regex

    # Marks of SB=STerm and SB=ATerm but the Arabic and Myanmar ones that part clauses; what SB=Close has that may stand behind them.
    opening = r"[“„«\"'‘(\[]*"
    close = r"[\p{SB=Close}--\p{Ps}]"
    made = {
        "marks": r"(?P<mark>(?:[\p{SB=STerm}\p{SB=ATerm}…۔--[၊]])+|(?<=\p{Greek}[»”\"')]*)[;·\u037e](?!\S*\p{Latin}))"
        rf"(?P<close>{close}*)(?P<space>[\s\p{{Z}}\u200b\ufeff]*)|(?P<para>\n[ \t\r]*\n\s*)|(?<=\p{{Thai}}|\p{{Lao}}|\p{{Khmer}})(?P<gap>[ \n]+)(?=[“\"(]?(?:\p{{Thai}}|\p{{Lao}}|\p{{Khmer}}))",
        "word": r"(?r)(?:^|(?<=[\s\p{Z}(\[“„«\"'‘—–]))(?:[\p{L}\p{M}/]+\.\s?){0,2}[\p{L}\p{M}/]+",
        "lower": opening + r"\p{SB=Lower}", "upper": opening + r"\p{SB=Upper}", "letter": opening + r"[\p{SB=Upper}\p{Lt}\p{SB=OLetter}]", "number": opening + r"\p{N}",
        "roman": r"\s*[ivxlcIVXLC]+\b|\s*[§#]?\p{N}", "lower_word": r"(?r)\p{Ll}{2}", "scripts": "|".join(rf"(?P<{s}>\p{{{s}}})" for s in dict.fromkeys(SCRIPT_OF.values())), "words": r"\p{L}+",
    }
    return {name: regex.compile("(?V1)" + pattern) for name, pattern in made.items()}


def guess_language(text: str) -> str:
    """The language of a text, by its script, and for Latin script by its commonest words; English where nothing tells."""
    tools = _tools()
    counts = Counter(m.lastgroup for m in tools["scripts"].finditer(text))
    script = max(counts, key=lambda s: (counts[s], s)) if counts else "Latin"
    if script != "Latin":
        return next(code for code, s in SCRIPT_OF.items() if s == script)
    small = text.lower()
    words, letters = Counter(tools["words"].findall(small)), Counter(small)
    return max(COMMON_WORDS, key=lambda code: (sum(words[w] for w in COMMON_WORDS[code]) + sum(letters[x] for x in LETTERS[code]), code == "en"))


@lru_cache(maxsize=256)
def _shortened(language: str, script: str) -> tuple[frozenset[str], ...]:
    """The four lists for a word in ``script`` within a text of ``language``."""
    codes = [language] if SCRIPT_OF[language] == script else [c for c, s in SCRIPT_OF.items() if s == script]
    return tuple(frozenset(w for c in codes for w in table.get(c, ())) for table in (NEVER_FINAL, BEFORE_NUMBER, BEFORE_NAME, SOMETIMES_FINAL))


def _stop_ends(text: str, start: int, end: int, language: str) -> bool:
    """Whether the full stop at ``start`` ends its sentence; ``end`` is where the next begins."""
    tools = _tools()
    rest = end < len(text)
    if tools["lower"].match(text, end):
        return False
    here = tools["word"].match(text, 0, start)
    if not here:
        return True
    token = " ".join(here.group().lower().split())
    tail = token.rsplit(" ", 1)[-1]
    last = tail.rsplit(".", 1)[-1]
    found = tools["scripts"].search(last)
    never, numbers, names, sometimes = _shortened(language, found.lastgroup if found else SCRIPT_OF[language])
    ends_with = lambda known: any(token == x or token.endswith(" " + x) for x in known)
    if ends_with(sometimes):
        return not rest or bool(tools["upper"].match(text, end))
    if tail in never or last in never or ends_with(x for x in never if " " in x):
        return not rest
    if last in numbers and tools["roman"].match(text, end):
        return False
    if last in names and here.group()[-len(last)].isupper() and tools["upper"].match(text, end):
        return False
    if len(last) == 1 and (text[start - 1].isupper() or last.islower()):  # an initial, or the first part of a shortened pair
        return not rest
    return True


def sentence_ends(text: str | None, language: str | None = None) -> list[int]:
    """For every sentence, the number of characters up to its last visible one."""
    if not text:
        return []
    tools = _tools()
    language = language_code(language) or guess_language(text)
    lower, number, upper, letter = (tools[k].match for k in ("lower", "number", "upper", "letter"))
    ends: list[int] = []
    begin, size = 0, len(text)

    def close(at: int, nxt: int) -> None:
        nonlocal begin
        while at > begin and text[at - 1] in BLANKS:
            at -= 1
        if at > begin:
            ends.append(at)
        begin = max(nxt, begin)

    for m in tools["marks"].finditer(text):
        nxt = m.end()
        if m["mark"] is None:
            close(m.start(), nxt)
            continue
        mark, quoted, space = m["mark"], m["close"], m["space"]
        at = nxt - len(space)
        if nxt == size or "\n\n" in space.replace("\r", "").replace(" ", ""):
            close(at, nxt)
            continue
        if lower(text, nxt) and (quoted or mark[-1] in ".…．?!") and not (not space and not quoted and mark[-1] not in ".…．"):
            continue
        if mark in (".", "．"):
            if not space and not quoted:
                # No blank: a decimal, an address, letters with stops - or a blank that was lost between two sentences.
                if not (upper(text, nxt) and tools["lower_word"].match(text, 0, m.start())):
                    continue
                if not _stop_ends(text, m.start(), nxt, language):
                    continue
            elif not quoted or quoted in "’'":
                if not _stop_ends(text, m.start(), nxt, language):
                    continue
        elif not space and not quoted and number(text, nxt) and mark[-1] in ".…":
            continue
        elif not space and not quoted and mark[-1] in "!?" and not letter(text, nxt) and text[nxt] not in "“„«「『（(»”\"'’‹›)]}）］｝」』】〉》〕":
            continue
        elif quoted and not space and letter(text, nxt) and not upper(text, nxt) and quoted[-1] in "」』”»" and mark[-1] in "。．！？!?":
            # A quotation with its own mark, with the sentence going on behind it.
            continue
        close(at, nxt)
    close(size, size)
    return ends


def _split(schema: pa.Schema, n_carried: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, number, begins, finish, pieces = [], [], [], [], []
            for i, (text, language) in enumerate(zip(batch.column(n_carried).to_pylist(), batch.column(n_carried + 1).to_pylist())):
                begin = 0
                for k, end in enumerate(sentence_ends(text, language)):
                    begin += len(text[begin:end]) - len(text[begin:end].lstrip())
                    rows.append(i)
                    number.append(k)
                    begins.append(begin)
                    finish.append(end)
                    if with_text:
                        pieces.append(text[begin:end])
                    begin = end
            carried = pa.RecordBatch.from_arrays(batch.columns[:n_carried], names=batch.schema.names[:n_carried]).take(pa.array(rows, pa.int64())).columns
            made = [pa.array(number, pa.int32()), pa.array(begins, pa.int32()), pa.array(finish, pa.int32())] + ([pa.array(pieces, pa.string())] if with_text else [])
            yield pa.RecordBatch.from_arrays([*carried, *made], schema=schema)

    return run


def split_sentences(docs: DataFrame, text_col: str, carry: list[str], *, language: Column | None = None, with_text: bool = True) -> DataFrame:
    """The columns ``carry`` and sentence_no, begin_pos, end_pos and, if asked for, the sentence, in order. ``language`` is a
    code or a name; where it is null or unknown, it is guessed from the text."""
    from pyspark.sql.pandas.types import to_arrow_schema

    out = T.StructType([*(T.StructField(c, docs.schema[c].dataType) for c in carry), *(T.StructField(c, T.IntegerType()) for c in ("sentence_no", "begin_pos", "end_pos")), *([T.StructField("sentence", T.StringType())] if with_text else [])])
    return docs.select(*carry, F.col(text_col).alias("__text"), (F.lit(None).cast("string") if language is None else language).alias("__language")).filter(F.col("__text").isNotNull()).mapInArrow(_split(to_arrow_schema(out), len(carry), with_text), out)
