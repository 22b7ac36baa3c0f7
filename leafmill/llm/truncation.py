"""Texts that were cut off, and how often each source cuts.

For every source, the lengths of its texts in characters and in bytes are counted. A length is a spike if far more
texts have it than its neighbours would suggest: the mark of a field limit. How a text ends then decides: a text that
ends inside a word or a sentence was cut, wherever it stands; one whose last line has no terminal mark, but could be
a line of its own (a name, a heading), was cut only if its length is a spike of its source.

The histogram alone cannot give the result, as texts also break off at other lengths and as a field limit may fall
between two sentences.

Defined results: null, empty and wordless texts are no cases; a null source is a source of its own; repeated rows are
each counted; ties don't matter, as every length is tested for itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

#: A spike has at least so many texts, and so many times what the lengths around it have on average.
MIN_SPIKE = 5
SPIKE_FACTOR = 8.0
NEIGHBOURS = 50
#: Shortened words that stand inside sentences, in the languages of the corpus.
INNER_ABBREVIATIONS = (
    r"e\.g|i\.e|cf|viz|vol|vols|ch|chap|No|Nos|pp?|St|Dr|Mr|Mrs|Ms|Mme|Mlle|Prof|fig|ed|eds|art|p\.\s?ex|Nr|bzw|z\.\s?B|d\.\s?h|usw\. z|S|Bd|vgl|т\.\s?е|стр|гл|см|д-р|"
    r"π\.χ|σελ|δηλ|κεφ|αρ|ص|ج|ر\.ک|डॉ|पृ|श्री|ডা|পৃ|திரு|பக்|ப|տես|էջ|ቁ|a\.m|p\.m"
)
CLOSERS = "\"'”’»«“„‟)\\]）」』》›*_~"
TERMINAL = r".!?。！？।॥؟։።፧။…‽"


#: Blanks that may follow a text.
BLANKS = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200C))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"


@lru_cache(maxsize=1)
def _patterns() -> dict:
    import regex

    # Searched from the end (r), where most are anchored, so that a long text or a long run of one sign costs no more.
    made = {
        "signs": rf"(?:[{BLANKS}]*(?:\[\d{{1,3}}\]|[\p{{So}}\p{{Sk}}\u200d\ufe0f--[\ufffd\ufffc]]))+$",
        "letters": r"[\p{L}\p{N}]",
        "colophon": r"^(?:\(.*\)|[—–―-].*[—–―-]|[—–―]\s*\p{Lu}[\p{L}\p{M}.'’ -]*,\s*\p{L}+\s+\d+|.*\.{3,}\s*\d+)$",
        "numbered": r"^\p{Lu}[^.!?;:]*\s\d+$",
        "line_ended": rf"(?:[{TERMINAL};\]]|[^\p{{L}}\p{{N}}\p{{M}},])[{CLOSERS}]*$",
        "greek": rf"\p{{Greek}}[{CLOSERS}]*[;·][{CLOSERS}]*$",
        "terminal": rf"[{TERMINAL}][{CLOSERS}]*$",
        "ellipsis": rf"(?:^|[^.!?…。！？।])\s*(?:\.\.\.|…)[{CLOSERS}]*$",
        "shortened": rf"(?:(?<![\p{{L}}\p{{M}}\p{{N}}])(?:{INNER_ABBREVIATIONS}|\p{{Lu}})\.|(?:^|[\s(])\d{{1,3}}\.)$",
        "signature": r"^[—–―]\s*\p{Lu}[\p{L}\p{M}.'’-]+(?:\s+\p{Lu}[\p{L}\p{M}.'’-]*){0,3}$",
        "heading": r"^\p{Lu}[\p{Lu}\p{N}\p{M}\s\p{P}]*$",
    }
    return {name: regex.compile("(?V1r)" + pattern).search for name, pattern in made.items()} | {"paragraph": regex.compile(r"\n\s*\n").search}


def ending(text: str) -> str:
    """'ended', 'cut', or 'open' for a last line that may be complete without a terminal mark; needs the whole text, as a quote or bracket may open anywhere."""
    match = _patterns()
    text = match["signs"](text) and text[: match["signs"](text).start()].rstrip(BLANKS) or text
    before, _, own = text.replace("\r", "\n").rpartition("\n")
    before, own = before.rstrip(BLANKS), own.strip(BLANKS)
    lines, words = "\n" in text or "\r" in text, len(own.split())
    ended_before = not before or bool(match["line_ended"](before))
    if not match["letters"](own) and lines:
        return "cut" if "\ufffd" in own else "ended"
    if match["colophon"](own) or (lines and ended_before and words <= 9 and match["numbered"](own)):
        return "ended"
    if match["terminal"](text) or match["greek"](text):
        quote = text.rfind("“")
        quote_open = quote > text.rfind("”") and "„" not in text and text.count("“") > text.count("”") and not match["paragraph"](text, quote)
        paren = text.rfind("(")
        paren_open = paren > text.rfind(")") and not match["paragraph"](text, paren)
        return "cut" if quote_open or paren_open or match["ellipsis"](text) or match["shortened"](text) else "ended"
    if ended_before and (match["signature"](own) or (words >= 2 and lines and match["heading"](own))):
        return "open"
    return "cut"


def _judge(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array((ending(text.as_py()) for text in batch.columns[-1]), pa.string())], schema=schema)

    return run


def length_spikes(docs: DataFrame, source_col: str, text_col: str) -> DataFrame:
    """(source, unit, length, n, around): lengths that far more texts of a source have than lengths nearby."""
    lengths = docs.filter(F.length(text_col) > 0).select(
        F.col(source_col).alias("source"), F.explode(F.array(F.struct(F.lit("characters").alias("unit"), F.length(text_col).alias("length")), F.struct(F.lit("bytes").alias("unit"), F.octet_length(text_col).alias("length")))).alias("x")
    )
    histogram = lengths.groupBy("source", "x.unit", "x.length").agg(F.count("*").alias("n"))
    near = Window.partitionBy("source", "unit").orderBy("length").rangeBetween(-NEIGHBOURS, NEIGHBOURS)
    counted = histogram.withColumn("around", (F.sum("n").over(near) - F.col("n")) / F.lit(2.0 * NEIGHBOURS))
    return counted.filter((F.col("n") >= MIN_SPIKE) & (F.col("n") >= SPIKE_FACTOR * F.col("around")))


def truncated(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(id_col, source_col, at_spike, is_cut) for every row with a word in its text."""
    from pyspark.sql.pandas.types import to_arrow_schema

    texts = docs.select(id_col, source_col, text_col).filter(F.col(text_col).rlike(r"[\p{L}\p{N}]"))
    whole = texts.select(id_col, source_col, F.length(text_col).alias("chars"), F.octet_length(text_col).alias("bytes"), F.rtrim(text_col, F.lit(BLANKS)).alias("state"))
    judged = whole.mapInArrow(_judge(to_arrow_schema(whole.schema)), whole.schema)
    spikes = length_spikes(docs, source_col, text_col).groupBy(F.col("source").alias("__source")).agg(F.collect_set(F.struct("unit", "length")).alias("spikes"))
    joined = judged.join(spikes, F.col(source_col).eqNullSafe(F.col("__source")), "left")
    at = F.coalesce(F.array_contains("spikes", F.struct(F.lit("characters").alias("unit"), F.col("chars").alias("length"))) | F.array_contains("spikes", F.struct(F.lit("bytes").alias("unit"), F.col("bytes").alias("length"))), F.lit(False))
    return joined.select(id_col, source_col, at.alias("at_spike"), ((F.col("state") == "cut") | ((F.col("state") == "open") & at)).alias("is_cut"))


def truncation_report(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(source_col, n_docs, n_cut, cut_share, n_cut_at_spike) over all rows of each source, the null source included."""
    judged = truncated(docs, id_col, source_col, text_col).groupBy(source_col).agg(F.sum(F.col("is_cut").cast("bigint")).alias("n_cut"), F.sum((F.col("is_cut") & F.col("at_spike")).cast("bigint")).alias("n_cut_at_spike"))
    every = docs.groupBy(source_col).agg(F.count("*").alias("n_docs")).withColumnRenamed(source_col, "__source")
    joined = every.join(judged, F.col("__source").eqNullSafe(F.col(source_col)), "left")
    cut = F.coalesce("n_cut", F.lit(0))
    return joined.select(F.col("__source").alias(source_col), "n_docs", cut.alias("n_cut"), F.round(cut / F.col("n_docs"), 6).alias("cut_share"), F.coalesce("n_cut_at_spike", F.lit(0)).alias("n_cut_at_spike"))
