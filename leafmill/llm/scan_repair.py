"""Repair of text from scanned pages: divided words, misread characters, running headers and page numbers.

Words are counted over the whole corpus. A word meets its candidates, which are far more frequent, in an inverted join
of positional character q-grams. What recognition confuses is learned from the corpus: for every exchange of characters
('c' for 'e', 'rn' for 'm') that would make a word of a candidate, the different words that show it are counted; chance
shows few. Gradient-boosted trees see that count beside lengths, places and frequencies, are trained on words misread on
purpose, and score each candidate; the best above ``ACCEPT`` is the correction. Two classifiers of the same kind look at
pairs of lines: a line and a title (is it furniture?), and the two sides of a line end (is the word divided, or a compound?),
the latter by what the corpus says of the joined and of the hyphenated word. Both are trained on the corpus itself: titles
spoiled on purpose against lines of text, frequent words divided on purpose against compounds. What a page number looks
like, and which line ends part paragraphs, are rules.

Defined results: null and empty texts have no noise and stay as they are; a null or empty chapter has no header; a word of
two letters alone is never corrected, as it cannot be told from another word, but one with a digit or sign is; the first
and last word of a text may be halves and are corrected only for a character that no word has; look-alike letters of other
scripts, accents and case are no misreadings; ties between candidates go to the more frequent, then to the lesser word;
repeated rows are treated each for itself.
"""

from __future__ import annotations

import math
import re
import unicodedata as ud
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..sources.scratch import materialize
from .boosting import BoostedTrees
from .lookalikes import script
from .neardup import FILTER, _chunks, _histogram

#: Lengths of the q-grams; the short ones are for words of up to ``SHORT`` characters, whose long ones one misreading may all spoil.
Q, Q_SHORT, SHORT = 3, 2, 5
#: Q-grams that two misread places can spoil, and one more: so many of its rarest a candidate is known by.
RARE_GRAMS = 2 * (Q + 1) + 1
#: A correction is at least so frequent, and so many times as frequent as the word it replaces.
MIN_FREQUENT = 12
RATIO = 15
ACCEPT = 0.5
#: Words that the trees are trained on, at most: the bound of the one sample that is taken.
TRAIN_WORDS = 3_000
#: Different words that show an exchange of characters before it is taught as a misreading, each with ``KEPT`` characters
#: that agree; fewer can be chance. The fixed list below counts as so many words, for a corpus too small to show its own.
SEEN, KEPT = 6, 4
#: Exchanges that training takes misreadings from, the commonest first.
TRAIN_EXCHANGES = 1_000
#: What recognition takes letters for. Left what was printed, right what comes out.
CONFUSIONS = (
    ("e", "c"), ("c", "e"), ("s", "5"), ("l", "1"), ("l", "I"), ("i", "1"), ("i", "l"), ("i", "!"), ("l", "!"), ("a", "@"), ("o", "0"), ("g", "9"), ("q", "9"), ("b", "6"), ("b", "8"), ("z", "2"), ("t", "7"), ("l", "|"), ("i", "|"), ("s", "$"),
    ("t", "f"), ("f", "t"), ("h", "b"), ("b", "h"), ("n", "ri"), ("u", "ii"), ("m", "rn"), ("rn", "m"), ("d", "cl"), ("cl", "d"), ("w", "vv"), ("vv", "w"), ("li", "h"), ("h", "li"), ("n", "u"), ("u", "n"), ("in", "m"), ("m", "in"), ("m", "nn"), ("nn", "m"), ("ri", "n"), ("y", "v"), ("v", "y"), ("o", "c"), ("a", "o"),
)
MARKS = "-‐¬­"
EDGE = ".,;:?()[]{}“”„«»\"'’‘—–…*_।॥。，、！？؟،"
#: Whether a text has a mark before a blank or a line end at all; most have not, and need no look at their words.
_BREAK = re.compile(rf"[{MARKS}](?:[ \t]*\r?\n| )").search
_SYMBOLS = set("0123456789@!|$")


def bare(token: str) -> str:
    """A token without the punctuation around it."""
    return token.strip(EDGE).rstrip("!").strip(EDGE + MARKS)


def form(word: str) -> str:
    """The form that words are counted and corrected in: lower case, but for a capital I that stands among small letters."""
    if word.islower():
        return word
    if "I" in word and not word.isupper():
        return "".join(c if c == "I" and (k or word[1:2].islower()) else c.lower() for k, c in enumerate(word))
    return word.lower()


@lru_cache(maxsize=1)
def _regexes():
    import regex

    number = r"(?:\d{1,4}(?:\s*/\s*\d{1,4})?|[ivxlc]{1,7})"
    return {
        "divided": regex.compile(rf"([\p{{L}}\p{{M}}]+)([{MARKS}])([ \t]*\r?\n[ \t]*| +)([\p{{L}}\p{{M}}]+)"),
        "number": regex.compile(rf"^[\s~\-—–\[\](){{}}|.*·]*(?:(?i:page|pg\.|p\.))?\s*{number}[\s~\-—–\[\](){{}}|.*·]*$"),
        "before": regex.compile(rf"^[\s~\-—–\[\](){{}}|*·]*(?:(?i:page|pg\.|p\.))?\s*{number}\s*[~\-—–\])}}|.*·]*(?:\s{{2,}}|\s*[|—–-]\s+|\s+[|—–-]\s*|\s+)(?=\S)"),
        "after": regex.compile(rf"(?<=\S)(?:\s{{2,}}|\s+[|—–-]\s*|\s+)[~\-—–\[({{|*·]*\s*(?:(?i:page|pg\.|p\.))?\s*{number}[\s~\-—–\])}}|.*·]*$"),
        "digit": regex.compile(r"\d"),
        "label": regex.compile(r"^(?i:chapter|part|talk|book|letter|section|canto)\s+[\divxlcIVXLC]+\s*[:.\-—–]\s*"),
    }


@lru_cache(maxsize=10_000)
def _parts(title: str) -> tuple[str, str, frozenset[str]]:
    """A title in small letters, its letters and digits alone, and their pairs."""
    folded = title.casefold()
    bare_title = "".join(filter(str.isalnum, folded))
    return folded, bare_title, frozenset(bare_title[i : i + 2] for i in range(len(bare_title) - 1))


@lru_cache(maxsize=8)
def _letters(line: str) -> tuple[str, str]:
    """A line in small letters, and its letters and digits alone; asked for every title in turn."""
    folded = line.casefold()
    return folded, "".join(filter(str.isalnum, folded))


def line_features(line: str, title: str) -> tuple[float, ...]:
    """What the furniture classifier sees of a line and a title: how alike their letters are in order, their lengths, and the
    share of the line's letter pairs that the title has."""
    import difflib

    raw, a = _letters(line)
    folded, b, grams = _parts(title)
    if raw == folded or a == b and b:
        return (1.0, 1.0, 1.0)
    return (round(difflib.SequenceMatcher(None, a, b, False).ratio(), 2), _longer(a, b), _shared(a, grams))


@lru_cache(maxsize=10_000)
def _places(text: str) -> dict[str, int]:
    """For each character, the places where it stands, as bits."""
    found: dict[str, int] = {}
    for k, ch in enumerate(text):
        found[ch] = found.get(ch, 0) | 1 << k
    return found


def _in_order(a: str, b: str) -> int:
    """The length of the longest common subsequence, all places of ``b`` at once in the bits of one number."""
    places, whole = _places(b), (1 << len(b)) - 1
    left, get = whole, places.get
    for ch in a:
        hit = left & get(ch, 0)
        if hit:
            left = (left + hit | left - hit) & whole
    return len(b) - left.bit_count()


def _longer(a: str, b: str) -> float:
    return round(min(len(a) / max(1, len(b)), 5.0), 1)


def _shared(a: str, grams: frozenset[str]) -> float:
    return round(len([i for i in range(len(a) - 1) if a[i : i + 2] in grams]) / max(1, len(a) - 1), 1)


class Alike:
    """Whether a line repeats a title, exactly or with a few other characters: boosted trees, asked once for each set of features.

    Likeness is dear to compute and is bounded by what is cheap: by the lengths, and by the longest common subsequence, of which
    matching blocks are a part. For every length and share of pairs the classifier itself is asked for the least likeness that
    it accepts; where a bound lies below that, the answer is no, and computing the likeness could not change it.
    """

    def __init__(self, model: BoostedTrees) -> None:
        self.model, self.least, self.accepted = model, {}, {}
        # Fixed to the rounding of line_features: every set of features there is.
        ratios = np.arange(101) / 100
        for longer in range(51):
            for shared in range(11):
                grid = np.column_stack([ratios, np.full(101, longer / 10), np.full(101, shared / 10)])
                yes = model.predict(grid) >= ACCEPT
                self.accepted[longer, shared] = yes
                self.least[longer, shared] = float(ratios[yes.argmax()]) if yes.any() else 2.0
        self.by_length = {longer: min(self.least[longer, k] for k in range(11)) for longer in range(51)}

    def __call__(self, line: str, title: str) -> bool:
        raw, a = _letters(line)
        folded, b, grams = _parts(title)
        if raw == folded or a == b and b:
            return True
        if not b or not a:
            return False
        longer = round(10 * _longer(a, b))
        bound, whole = self.by_length[longer] - 0.006, len(a) + len(b)
        if 2 * min(len(a), len(b)) < bound * whole or 2 * _in_order(a, b) < bound * whole:
            return False
        shared = round(10 * _shared(a, grams))
        if self.least[longer, shared] > 1:
            return False
        import difflib

        return bool(self.accepted[longer, shared][round(100 * round(difflib.SequenceMatcher(None, a, b, False).ratio(), 2))])


def train_furniture(titles: list[str], lines: list[str], seed: int = 12) -> Alike:
    """The classifier of lines, trained on titles with misread, lost and added characters against lines of text and other titles."""
    random = np.random.default_rng(seed)
    titles = [t for t in titles if len(t) >= 8] or ["The First Chapter", "Of Other Things"]
    words = [w for x in (*titles, *lines) for w in x.split()]
    rows, labels = [(1.0, 1.0, 1.0)], [1.0]
    for t in titles * math.ceil(100 / len(titles)):
        mixed = " ".join(words[random.integers(len(words))] for _ in t.split())
        rows.append(line_features(mixed, t))
        labels.append(float(rows[-1][0] == 1.0))
        for spoiled in (1, 2, 3):
            text = t
            for _ in range(spoiled):
                right, wrong = CONFUSIONS[random.integers(len(CONFUSIONS))]
                k = int(random.integers(len(text)))
                text = text.replace(right, wrong, 1) if random.random() < 0.7 else text[:k] + text[k + 1 :]
            rows.append(line_features(text, t))
            labels.append(1.0)
        for other in (titles[random.integers(len(titles))], *(lines[random.integers(len(lines))] for _ in range(min(3, len(lines))))):
            if other.casefold() != t.casefold():
                rows.append(line_features(other, t))
                labels.append(0.0)
    return Alike(BoostedTrees(rounds=30).fit(np.array(rows), np.array(labels)))


def join_features(n_whole: int, n_apart: int, mark: str, corrected: bool) -> tuple[float, ...]:
    """What the classifier of line ends sees: how often the corpus has the whole and the hyphenated word, the mark, and whether a line ends there."""
    return (round(float(np.log1p(n_whole)), 1), round(float(np.log1p(n_apart)), 1), float(np.sign(n_whole - n_apart)), float(mark[:1] == "-"), float(mark[1:] == "\n"), float(corrected))


def train_joins(frequent: list[tuple[str, int]], compounds: list[tuple[str, int]], seed: int = 13) -> BoostedTrees:
    """The classifier of line ends, trained on frequent and on unseen words divided on purpose against compounds and hanging hyphens."""
    random = np.random.default_rng(seed)
    rows, labels = [], []
    for n in [1, 2, 4, 8, 16] * 10 + ([n for _, n in frequent] or [20, 50, 200]):
        for mark in MARKS:
            for gap in "\n ":
                rows += [join_features(n, 0, mark + gap, False), join_features(0, 0, mark + gap, True)]
                labels += [1.0, 1.0]
                rows.append(join_features(0, 0, mark + gap, False))
                labels.append(float(gap == "\n" or mark != "-"))
                rows.append(join_features(n, int(random.integers(0, max(1, n // 4))), mark + gap, False))
                labels.append(1.0)
    for n in [1, 2, 4, 8, 16] * 10 + [n for _, n in compounds]:
        for mark in MARKS:
            for gap in "\n ":
                for whole in (0, int(random.integers(0, max(1, n // 4)))):
                    rows.append(join_features(whole, n, mark + gap, False))
                    labels.append(0.0)
    return BoostedTrees(rounds=40).fit(np.array(rows), np.array(labels))


def _joined(model: BoostedTrees):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for batch in batches:
            keep = []
            for whole, apart, mark, corrected in zip(*(batch.column(c).to_pylist() for c in ("n_whole", "n_apart", "mark", "corrected"))):
                seen = join_features(whole, apart, mark, corrected)
                if seen not in known:
                    known[seen] = bool(model.predict(np.array([seen]))[0] >= ACCEPT)
                keep.append(known[seen])
            yield batch.filter(pa.array(keep, pa.bool_())).select(["id", "kind", "a", "b"])

    return run


def titles_of(chapter: str | None) -> list[str]:
    """The chapter and its parts, with and without labels such as 'Chapter V:'."""
    if not chapter or not chapter.strip():
        return []
    found = [chapter.strip(), *(p.strip() for p in chapter.split("|"))]
    found += [_regexes()["label"].sub("", t) for t in found]
    return [t for t in dict.fromkeys(found) if len(t) >= 3]


def furniture(line: str, titles: list[str], alike) -> tuple[bool, bool]:
    """(header, page_number): what a line holds."""
    stripped = line.strip()
    if not stripped:
        return False, False
    match = _regexes()
    if match["number"].match(stripped):
        return False, True
    longest = max(map(len, titles), default=0)
    if not longest:
        return False, False
    ends = stripped.split(None, 1)[0].strip(EDGE + "~|-"), stripped.rsplit(None, 1)[-1].strip(EDGE + "~|-")
    numbered = match["digit"].search(stripped) is not None or any(e and not e.strip("ivxlc") for e in ends)
    header = False
    for t in titles:
        whole = alike(stripped, t)
        header = header or whole
        for side in ("before", "after") if numbered else ():
            m = match[side].search(stripped)
            if not m:
                continue
            rest = stripped[: m.start()] + stripped[m.end() :]
            if alike(rest, t) and not any(ch.isdigit() for ch in t) if whole else alike(rest.strip(" |—–-"), t):
                return True, True
    return header, False


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of each batch with their counts; parts of hyphenated words count as well."""
    for batch in batches:
        tokens = pa.array([t for x in batch.column(0).to_pylist() if x for t in x.split()], pa.string())
        counted: dict[str, int] = {}
        for entry in tokens.value_counts().to_pylist():
            token, n = entry["values"], entry["counts"]
            word = form(bare(token))
            if word:
                counted[word] = counted.get(word, 0) + n
                if "-" in word:
                    for part in word.split("-"):
                        if part:
                            counted[part] = counted.get(part, 0) + n
        yield pa.RecordBatch.from_arrays([pa.array(list(counted), pa.string()), pa.array(list(counted.values()), pa.int64())], names=["word", "n"])


def word_counts(docs: DataFrame, text_col: str) -> DataFrame:
    """(word, n) over the whole corpus, as a written table."""
    counts = docs.select(text_col).mapInArrow(_word_counts, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return materialize(counts, "word-counts")


def _difference(word: str, candidate: str) -> tuple[str, str, int]:
    """(read, printed, where): the two strings between the common start and the common end."""
    p, most = 0, min(len(word), len(candidate))
    while p < most and word[p] == candidate[p]:
        p += 1
    q = 0
    while q < most - p and word[-1 - q] == candidate[-1 - q]:
        q += 1
    return word[p : len(word) - q], candidate[p : len(candidate) - q], p


def _plain_word(word: str) -> bool:
    """Whether a word is of letters, digits and signs that stand for themselves; others are look-alikes, not misreadings."""
    return word.isascii() or ud.normalize("NFKC", word) == word and not any(ud.category(ch)[0] in "CZ" for ch in word)


def exchange(word: str, candidate: str) -> tuple[str, str, bool] | None:
    """(read, printed, twice): the exchange of characters that would make a misread word of a candidate, if there is one: one
    or two characters for one or two letters of the candidate's own script, once, or one character for another wherever it
    stands. None for another word, another spelling (case, accents) or a look-alike letter of another script."""
    if not _plain_word(word) or not _plain_word(candidate):
        return None
    read, printed, _ = _difference(word, candidate)
    places = {(x, y) for x, y in zip(read, printed) if x != y} if len(read) == len(printed) > 1 else set()
    if twice := len(places) == 1:
        read, printed = places.pop()
    if not read or not printed or max(len(read), len(printed)) > 2:
        return None
    fold = lambda x: ud.normalize("NFD", x.casefold())[:1]
    if len(read) == len(printed) and all(fold(x) == fold(y) for x, y in zip(read, printed)):
        return None
    scripts = {script(ch) for ch in candidate if ch.isalpha()}
    if len(scripts) != 1 or any(script(ch) not in scripts for ch in word if ch.isalpha()) or not any(map(str.isalpha, word)):
        return None
    return read, printed, twice


def features(word: str, n: int, candidate: str, m: int, read: str, printed: str, twice: bool, seen: float) -> list[float]:
    """What the trees see of a word, a candidate, and the exchange between them; ``seen`` is how many words of the corpus show
    the same exchange."""
    _, _, at = _difference(word, candidate)
    strange = float(any(c in _SYMBOLS or c == "I" for c in word))
    return [float(np.log1p(seen)), strange, float(len(read)), float(len(printed)), float(twice), float(min(len(word), 12)), float(at == 0), float(at + len(read) == len(word)), float(np.log((m + 1) / (n + 1))), float(np.log(n + 1))]


def train(frequent: list[tuple[str, int]], exchanges: list[tuple[str, str, float]], seed: int = 11) -> BoostedTrees:
    """Trees trained on misreadings made from frequent words by the corpus's exchanges (read, printed, seen), once or wherever
    they fit, against words that an exchange which few words show would make of them."""
    random = np.random.default_rng(seed)
    words = [w for w, _ in frequent if len(w) >= 3 and w.isalpha()] or ["word", "letter"]
    known, rows, labels = dict(frequent), [], []
    alphabet = sorted({ch for w in words for ch in w})
    often = {(read, printed): seen for read, printed, seen in exchanges if seen >= SEEN}

    def add(word: str, n: int, candidate: str, seen: float | None, label: float) -> None:
        found = exchange(word, candidate)
        if found is not None:
            seen = often.get(found[:2], 0.0) if seen is None else seen
            rows.append(features(word, n, candidate, known.get(candidate, 100), *found, seen))
            labels.append(label)

    for w in words:
        n = int(random.integers(1, max(2, known.get(w, 100) // RATIO)))
        fits = [x for x in often if x[1] in w]
        for read, printed in [fits[i] for i in random.integers(len(fits), size=3)] if fits else ():
            spots = [k for k in range(len(w)) if w[k : k + len(printed)] == printed]
            k = spots[random.integers(len(spots))]
            once = w[:k] + read + w[k + len(printed) :]
            add(once, n, w, None, 1.0)
            add(once, n, w, float(SEEN), 1.0)
            add(w.replace(printed, read), n, w, None, 1.0)
            add(once, n, w, float(random.integers(0, SEEN - 1)), 0.0)
        for _ in range(3):
            k, size = int(random.integers(len(w))), int(random.integers(1, 3))
            other = "".join(alphabet[i] for i in random.integers(len(alphabet), size=int(random.integers(1, 3))))
            if (other, w[k : k + size]) not in often:
                add(w[:k] + other + w[k + size :], n, w, float(random.integers(0, SEEN - 1)), 0.0)
    return BoostedTrees().fit(np.array(rows), np.array(labels))


def _pair_schema() -> str:
    return "word string, n bigint, candidate string, m bigint, read string, printed string, twice boolean"


def _exchanges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of a word and a candidate with the exchange between them; pairs without one are no misreadings."""
    for batch in batches:
        found = [exchange(w, c) for w, c in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())]
        kept = pa.array([x is not None for x in found], pa.bool_())
        cols = list(zip(*(x for x in found if x is not None))) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([*batch.filter(kept).columns, pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.bool_())], names=["word", "n", "candidate", "m", "read", "printed", "twice"])


def _score(model: BoostedTrees):
    prior = {(read, printed) for printed, read in CONFUSIONS}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w, n, c, m, read, printed, twice, seen = (batch.column(k).to_pylist() for k in ("word", "n", "candidate", "m", "read", "printed", "twice", "seen"))
            every = [s + SEEN * ((x, y) in prior) for s, x, y in zip(seen, read, printed)]
            score = model.predict(np.array([features(*x) for x in zip(w, n, c, m, read, printed, twice, every)])) if w else np.empty(0)
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("candidate"), batch.column("m"), pa.array(score, pa.float64())], names=["word", "candidate", "m", "score"])

    return run


def candidate_pairs(counts: DataFrame) -> DataFrame:
    """(word, n, candidate, m, read, printed, twice): every word with the frequent words that it may be a misreading of.

    Words of any script and length take part. A candidate is entered under its rarest grams only, more than two misread places
    can spoil, so no common gram brings many words together; a word is looked up by all of its own. Grams meet at places that
    differ by one at most, and only for words whose length some frequent word comes near.
    """
    kept = counts.filter(F.col("word").rlike(r"^[\p{L}\p{M}\p{N}\p{P}\p{S}]+$") & F.col("word").rlike(r"\p{L}"))
    frequent = kept.filter((F.col("n") >= MIN_FREQUENT) & F.col("word").rlike(r"^[\p{L}\p{M}]{2,}$"))
    lengths = frequent.select(F.explode(F.array(*(F.length("word") + k for k in (-1, 0, 1)))).alias("length")).distinct()
    rare = kept.withColumn("length", F.length("word")).join(lengths, "length", "left_semi").filter((F.col("length") >= 3) | F.col("word").rlike(r"[\p{N}\p{S}\p{P}]"))
    padded = F.concat(F.lit("^"), F.col("word"), F.lit("$"))
    grams = lambda q: F.transform(F.sequence(F.lit(1), F.length("word") + 3 - q), lambda i: F.struct(i.alias("at"), F.substring(padded, i, F.lit(q)).alias("gram")))
    every = F.concat(F.when(F.length("word") >= SHORT - 1, grams(Q)).otherwise(F.array().cast("array<struct<at:int,gram:string>>")), F.when(F.length("word") <= SHORT, grams(Q_SHORT)).otherwise(F.array().cast("array<struct<at:int,gram:string>>")))
    left = rare.select("word", "n", F.explode(every).alias("g")).select("word", "n", "g.gram", F.explode(F.array(F.col("g.at") - 1, F.col("g.at"), F.col("g.at") + 1)).alias("at"))
    right = frequent.select(F.col("word"), F.col("n").alias("m"), F.explode(every).alias("g")).select(F.col("word").alias("candidate"), "m", "g.gram", "g.at")
    rarity = right.groupBy("gram", "at").agg(F.count("*").alias("held"))
    order = Window.partitionBy("candidate", F.length("gram")).orderBy("held", "gram", "at")
    right = right.join(rarity, ["gram", "at"]).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= RARE_GRAMS)
    near = (F.abs(F.length("word") - F.length("candidate")) <= 1) & (F.col("m") >= RATIO * F.col("n")) & (F.col("word") != F.col("candidate"))
    met = left.join(right.select("candidate", "m", "gram", "at"), ["gram", "at"]).filter(near).select("word", "n", "candidate", "m").distinct()
    return met.mapInArrow(_exchanges, _pair_schema())


def corrections(counts: DataFrame) -> DataFrame:
    """(word, correction, score), as a written table."""
    pairs = materialize(candidate_pairs(counts), "misread-pairs")
    seen = pairs.filter(F.length("word") - F.length("read") >= KEPT).groupBy("read", "printed").agg(F.count_distinct("word").alias("seen"))
    common = {(r["read"], r["printed"]): float(r["seen"]) for r in seen.filter(F.col("seen") >= SEEN).orderBy(F.desc("seen"), "read", "printed").limit(TRAIN_EXCHANGES).collect()}
    for printed, read in CONFUSIONS:
        common[read, printed] = common.get((read, printed), 0.0) + SEEN
    sample = counts.filter((F.col("n") >= MIN_FREQUENT) & F.col("word").rlike(r"^\p{L}{3,}$")).orderBy(F.xxhash64("word")).limit(TRAIN_WORDS)
    model = train([(r["word"], r["n"]) for r in sample.collect()], [(*key, n) for key, n in sorted(common.items())])
    shown = pairs.join(seen, ["read", "printed"], "left").withColumn("seen", F.coalesce(F.col("seen").cast("double"), F.lit(0.0)))
    scored = shown.mapInArrow(_score(model), "word string, candidate string, m bigint, score double").filter(F.col("score") >= ACCEPT)
    best = Window.partitionBy("word").orderBy(F.desc("score"), F.desc("m"), "candidate")
    return materialize(scored.withColumn("place", F.row_number().over(best)).filter("place = 1").select("word", F.col("candidate").alias("correction"), "score"), "corrections")


def _hash(word: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(word)


def _mark_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cells = np.zeros(FILTER, np.uint32)
    for batch in batches:
        cells[np.array([_hash(w) % FILTER for w in batch.column(0).to_pylist()], np.int64)] = 1
    yield _chunks(cells)


def suspects(text: str, chapter: str | None, asked, alike) -> list[tuple[str, str, str, str]]:
    """(kind, a, b, mark) of one text: furniture lines, divided words with their two readings, and words to look up."""
    found: list[tuple[str, str, str, str]] = []
    body = text
    if "\n" in text:
        titles, kept = titles_of(chapter), []
        for k, line in enumerate(text.split("\n")):
            header, number = furniture(line, titles, alike)
            if header:
                found.append(("header", str(k), "", ""))
            if number:
                found.append(("page_number", str(k), "", ""))
            if not (header or number):
                kept.append(line)
        if found:  # a word may be divided around the furniture
            body = "\n".join(kept)
    halves: set[str] = set()
    if _BREAK(body):
        for m in _regexes()["divided"].finditer(body):
            a, mark, gap, b = m.groups()
            halves |= {a, b}
            found.append(("hyphen", (a + b).lower(), (a + "-" + b).lower(), mark + ("\n" if "\n" in gap else " ")))
            joined = form(a + b)
            if asked(joined):
                found.append(("misread", joined, "", ""))
    tokens = text.split()
    last = len(tokens) - 1
    seen = asked.known.get
    for k in [k for k, token in enumerate(tokens) if seen(token, True)]:
        token = tokens[k]
        if not asked(token):
            continue
        word = form(bare(token))
        if bare(token) in halves or ((k == 0 or k == last and token[-1].isalnum()) and not any(c in _SYMBOLS or c == "I" for c in word)):
            continue
        found.append(("misread", word, "", ""))
        for part in word.split("-") if "-" in word else ():
            found.append(("misread", part, "", ""))
    return found


class Asked:
    """Whether a token's word may be in the table of corrections; never wrong about a 'no'. One look-up for each distinct token."""

    def __init__(self, marked: bytes) -> None:
        self.bits, self.known = np.unpackbits(np.frombuffer(marked, np.uint8)), {}

    def __call__(self, token: str) -> bool:
        answer = self.known.get(token)
        if answer is None:
            if len(self.known) > 500_000:
                self.known.clear()
            word = form(bare(token))
            answer = bool(word) and any(self.bits[_hash(w) % FILTER] for w in (word, *(word.split("-") if "-" in word else ())))
            self.known[token] = answer
        return answer


def _find(marked: bytes, alike: Alike, id_type: pa.DataType):
    names = ["id", "kind", "a", "b", "mark"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = Asked(marked)
        for batch in batches:
            rows, found = [], []
            for i, (text, chapter) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                got = list(dict.fromkeys(suspects(text, chapter, asked, alike)))
                rows += [i] * len(got)
                found += got
            cols = list(zip(*found)) if found else [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), *(pa.array(list(c), pa.string()) for c in cols)], names=names)

    return run


def noise(docs: DataFrame, id_col: str, text_col: str, chapter_col: str) -> DataFrame:
    """(id, kind, a, b): every finding. header and page_number: a is the line's number; hyphen: a is the whole word, b the
    hyphenated reading it replaces; misread: a is the word as read, b what was printed."""
    from pyspark.sql.pandas.types import to_arrow_type

    texts = docs.filter(F.col(text_col).isNotNull() & (F.col(text_col) != "")).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(chapter_col).alias("chapter"))
    counts = word_counts(texts, "text")
    table = corrections(counts)
    marked = np.packbits(_histogram(table.select("word").mapInArrow(_mark_words, "chunk int, cells binary"), FILTER) > 0).tobytes()
    kind, alike = texts.schema["id"].dataType, _train_furniture_on(texts)
    found = materialize(texts.mapInArrow(_find(marked, alike, to_arrow_type(kind)), f"id {kind.simpleString()}, kind string, a string, b string, mark string"), "scan-noise")
    lines = found.filter(F.col("kind").isin("header", "page_number")).select("id", "kind", "a", "b")
    read = found.filter("kind = 'misread'").select("id", "kind", "a").join(table.select(F.col("word").alias("a"), F.col("correction").alias("b")), "a").select("id", "kind", "a", "b")
    whole, apart = counts.select(F.col("word").alias("a"), F.col("n").alias("n_whole")), counts.select(F.col("word").alias("b"), F.col("n").alias("n_apart"))
    divided = found.filter("kind = 'hyphen'").join(whole, "a", "left").join(apart, "b", "left").join(table.select(F.col("word").alias("a"), "correction"), "a", "left")
    divided = divided.select("id", "kind", "a", "b", "mark", F.coalesce("n_whole", F.lit(0)).alias("n_whole"), F.coalesce("n_apart", F.lit(0)).alias("n_apart"), F.col("correction").isNotNull().alias("corrected"))
    joins = divided.mapInArrow(_joined(_train_joins_on(counts)), lines.schema)
    return lines.unionByName(read).unionByName(joins)


def _train_joins_on(counts: DataFrame) -> BoostedTrees:
    pick = lambda df: [(r["word"], r["n"]) for r in df.orderBy(F.xxhash64("word")).limit(TRAIN_WORDS // 3).collect()]
    return train_joins(pick(counts.filter((F.col("n") >= MIN_FREQUENT) & F.col("word").rlike(r"^\p{L}{4,}$"))), pick(counts.filter((F.col("n") >= 2) & F.col("word").rlike(r"^\p{L}+-\p{L}+$"))))


def _train_furniture_on(texts: DataFrame) -> Alike:
    """Titles and lines of the texts with the lowest hashes, ``TRAIN_WORDS`` / 3 texts at most."""
    some = texts.filter("chapter IS NOT NULL AND chapter <> ''").select("chapter", "text", F.xxhash64("chapter", "text").alias("h")).orderBy("h").limit(TRAIN_WORDS // 3).collect()
    titles = list(dict.fromkeys(p.strip() for r in some for p in r["chapter"].split("|")))
    lines = [x.strip() for r in some for x in r["text"].split("\n")[2:8] if x.strip()]
    return train_furniture(titles, lines)


def noise_kinds(docs: DataFrame, id_col: str, text_col: str, chapter_col: str) -> DataFrame:
    """(id_col, kind): what each text suffers from."""
    return noise(docs, id_col, text_col, chapter_col).select(F.col("id").alias(id_col), "kind").distinct()


def repair_text(text: str, findings: list[tuple[str, str, str]]) -> str:
    """Continuous paragraphs: furniture dropped, divided words joined, misread words replaced, line ends within a paragraph made blanks."""
    gone = {int(a) for kind, a, _ in findings if kind in ("header", "page_number")}
    whole = {a for kind, a, _ in findings if kind == "hyphen"}
    printed = {a: b for kind, a, b in findings if kind == "misread"}
    if gone:
        text = "\n".join(line for k, line in enumerate(text.split("\n")) if k not in gone)
    if whole:
        text = _regexes()["divided"].sub(lambda m: m[1] + m[4] if (m[1] + m[4]).lower() in whole else m[0], text)

    def corrected(token: str) -> str:
        core = bare(token)
        new = printed.get(form(core))
        if new is None and "-" in core:
            new = "-".join(printed.get(form(p), p) for p in core.split("-"))
        if not core or new is None:
            return token
        new = new.upper() if core.isupper() and len(core) > 1 else new.capitalize() if core[0].isupper() and core[0] != "I" else new
        return token.replace(core, new, 1)

    lines, out, widest = text.split("\n"), "", max((len(x) for x in text.split("\n")), default=0)
    for k, line in enumerate(lines):
        stripped = line.strip()
        if printed:
            stripped = " ".join(map(corrected, stripped.split(" ")))
        if not stripped:
            out = out.rstrip() + "\n\n" if out else out
        elif not out or out.endswith("\n"):
            out += stripped
        else:
            hyphen = out[-1] in "-‐" and out[-2:-1].isalpha() and stripped[0].islower()  # a compound, cut at its own hyphen
            out += ("" if hyphen else " " if _continues(lines[k - 1], line, widest) else "\n") + stripped
    return out.rstrip()


def _continues(above: str, below: str, widest: int) -> bool:
    """Whether a pair of lines belongs to one paragraph: the upper is full or unfinished, and the lower doesn't start one."""
    a, b = above.rstrip(), below.lstrip()
    if not a or not b:
        return False
    first = len(b.split(" ", 1)[0])
    full = len(a) + 1 + first >= 0.9 * widest
    return full or b[0].islower() or a[-1] in ",;-" or not (a[-1] in ".!?:।。”»\")" or b[0].isupper())


def repair(docs: DataFrame, id_col: str, text_col: str, chapter_col: str) -> DataFrame:
    """(id_col, text_col): every row, its text as continuous paragraphs. Findings of one id are few: at most its words."""
    found = noise(docs, id_col, text_col, chapter_col).groupBy("id").agg(F.collect_set(F.struct("kind", "a", "b")).alias("findings"))
    joined = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(found, "id", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if t is None else repair_text(t, [(x["kind"], x["a"], x["b"]) for x in f or ()]) for t, f in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    return joined.mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, text string").select(F.col("id").alias(id_col), F.col("text").alias(text_col))
