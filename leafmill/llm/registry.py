"""The queries of this package, over the tables of a directory, with the parameters meant for production."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.dimensions import small
from ..sources.tables import table
from . import boilerplate, lookalikes, mixing, neardup, neighbours, scan_repair, sentences, splitting, tokens, truncation

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.similar_pairs(table(spark, d, "vectors")).select(F.col("a").alias("idx_a"), F.col("b").alias("idx_b"))


def p1_nearest(spark: SparkSession, d: str) -> DataFrame:
    """The ten nearest among all vectors, for every vector whose idx is divisible by 50."""
    vectors = table(spark, d, "vectors")
    found = neighbours.nearest(vectors, vectors.filter("idx % 50 = 0"))
    return found.select(F.col("id").alias("idx"), "rank", "neighbour", F.round("cosine", 4).alias("cosine"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return boilerplate.repeated_lines(table(spark, d, "metadata"), "idx", "book_title", "snippet").select("idx", "line_no")


def p2_blocks(spark: SparkSession, d: str) -> DataFrame:
    """The boilerplate blocks of each title: the occurrences of their lines and their support."""
    return boilerplate.boilerplate_blocks(table(spark, d, "metadata"), "idx", "book_title", "snippet")


def p2_clean(spark: SparkSession, d: str) -> DataFrame:
    return boilerplate.remove_repeated_lines(table(spark, d, "metadata"), "idx", "book_title", "snippet")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    # An idx that were listed under two languages would be cut by the lesser.
    chosen = table(spark, d, "sentence_sample").groupBy("idx").agg(F.min("lang").alias("lang"))
    snippets = table(spark, d, "metadata").select("idx", "snippet").join(chosen, "idx")
    return sentences.split_sentences(snippets, "snippet", ["idx"], language=F.col("lang"), with_text=False).select("idx", "end_pos").distinct()


def p3_sentences(spark: SparkSession, d: str) -> DataFrame:
    """All snippets, by the language of their book; guessed where the book is unknown."""
    books = table(spark, d, "books").groupBy(F.col("pdf_filename").alias("__file")).agg(F.min("language").alias("__book_language"))
    known = table(spark, d, "metadata").select("idx", "snippet", F.element_at(F.split("file_path", "[/\\\\]"), -1).alias("__file")).join(small(books), "__file", "left")
    return sentences.split_sentences(known, "snippet", ["idx"], language=F.col("__book_language"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return scan_repair.noise_kinds(table(spark, d, "metadata"), "idx", "snippet", "chapter_name")


def p4_repaired(spark: SparkSession, d: str) -> DataFrame:
    return scan_repair.repair(table(spark, d, "metadata"), "idx", "snippet", "chapter_name")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.near_duplicate_pairs(table(spark, d, "metadata"), "idx", "snippet").select(F.col("a").alias("idx_a"), F.col("b").alias("idx_b"))


def p5_groups(spark: SparkSession, d: str) -> DataFrame:
    return neardup.near_duplicate_groups(table(spark, d, "metadata"), "idx", "snippet")


def p6_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_oversized(table(spark, d, "metadata"), "snippet", ["idx", "page_number"])


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_pieces(spark, d).filter("piece_no = 0").select("idx").distinct()


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalikes.changed_values(table(spark, d, "metadata"), ["snippet", "book_title"], "idx")


def p7_unified(spark: SparkSession, d: str) -> DataFrame:
    return lookalikes.unify(table(spark, d, "metadata"), ["book_title", "snippet"], ["idx"])


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode(table(spark, d, "documents"))


def p8_decoded(spark: SparkSession, d: str) -> DataFrame:
    """Every document's text, encoded and decoded again."""
    return tokens.decode(tokens.encode(table(spark, d, "documents")))


def _mixed(spark: SparkSession, d: str, whole: bool = False) -> tuple[DataFrame, DataFrame]:
    targets = table(spark, d, "mix_targets")
    sized = mixing.counted(table(spark, d, "documents"), targets)
    total = sized.agg(F.sum("n_tokens")).first()[0] if whole else None
    return mixing.mix(sized, targets, total=total), targets


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d)[0].withColumnRenamed("id", "doc_id")


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and reached shares of the largest mix that reaches every target."""
    return mixing.reached(*_mixed(spark, d))


def p9_shares_whole(spark: SparkSession, d: str) -> DataFrame:
    """The same for a mix as large as the target sources are, where some source may run short."""
    return mixing.reached(*_mixed(spark, d, whole=True))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return truncation.truncated(table(spark, d, "documents")).filter("is_cut").select("doc_id").distinct()


def p10_report(spark: SparkSession, d: str) -> DataFrame:
    return truncation.truncation_report(table(spark, d, "documents"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (p1_found, p1_nearest, p2_found, p2_blocks, p2_clean, p3_found, p3_sentences, p4_found, p4_repaired, p5_found, p5_groups, p6_found, p6_pieces, p7_found, p7_unified, p8_ids, p8_decoded, p9_mix, p9_shares, p9_shares_whole, p10_found, p10_report)}

ORACLES: dict[str, str] = {
    "p1_found": """
        WITH v AS MATERIALIZED (SELECT DISTINCT idx, embedding::DOUBLE[] AS e FROM vectors WHERE embedding IS NOT NULL), u AS MATERIALIZED (SELECT * FROM v WHERE list_inner_product(e, e) > 0)
        SELECT DISTINCT a.idx AS idx_a, b.idx AS idx_b FROM u a JOIN u b ON a.idx < b.idx AND list_cosine_similarity(a.e, b.e) >= 0.9""",
    "p2_found": r"""
        WITH l AS (
          SELECT idx, book_title, line_no, regexp_replace(lower(line), '\P{L}+', '', 'g') AS k
          FROM (SELECT idx, book_title, unnest(string_split(snippet, chr(10))) AS line, generate_subscripts(string_split(snippet, chr(10)), 1) - 1 AS line_no
                FROM metadata WHERE book_title IS NOT NULL AND snippet IS NOT NULL)),
        r AS (SELECT book_title, k FROM l WHERE length(k) >= 30 GROUP BY 1, 2 HAVING count(DISTINCT idx) >= 8)
        SELECT DISTINCT idx, CAST(line_no AS INTEGER) AS line_no FROM l JOIN r USING (book_title, k)""",
    "p2_clean": r"""
        WITH s AS (SELECT idx, book_title, snippet, string_split(snippet, chr(10)) AS lines FROM metadata),
        l AS (SELECT idx, book_title, line_no, regexp_replace(lower(lines[line_no + 1]), '\P{L}+', '', 'g') AS k FROM (SELECT *, unnest(range(len(lines))) AS line_no FROM s WHERE book_title IS NOT NULL AND snippet IS NOT NULL)),
        r AS (SELECT book_title, k FROM l WHERE length(k) >= 30 GROUP BY 1, 2 HAVING count(DISTINCT idx) >= 8),
        g AS (SELECT idx, list(DISTINCT line_no) AS gone FROM l JOIN r USING (book_title, k) GROUP BY 1)
        SELECT s.idx, s.book_title, CAST(coalesce(len(gone), 0) AS INTEGER) AS n_removed,
          CASE WHEN gone IS NULL THEN snippet ELSE array_to_string(list_transform(list_filter(range(len(lines)), lambda i: NOT list_contains(gone, i)), lambda i: lines[i + 1]), chr(10)) END AS snippet FROM s LEFT JOIN g USING (idx)""",
    "p5_found": r"""
        WITH w AS (SELECT idx, regexp_split_to_array(trim(regexp_replace(lower(snippet), '[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ' ', 'g')), ' ') AS w FROM metadata WHERE snippet IS NOT NULL),
        s AS (SELECT DISTINCT idx, unnest(list_transform(range(1, len(w) - 1), lambda i: concat_ws(' ', w[i], w[i + 1], w[i + 2]))) AS t FROM w WHERE len(w) >= 20),
        n AS (SELECT idx, count(*) AS n FROM s GROUP BY 1),
        c AS (SELECT a.idx AS idx_a, b.idx AS idx_b, count(*) AS c FROM s a JOIN s b ON a.t = b.t AND a.idx < b.idx GROUP BY 1, 2)
        SELECT idx_a, idx_b FROM c JOIN n x ON x.idx = idx_a JOIN n y ON y.idx = idx_b WHERE c >= 0.6 * (x.n + y.n - c)""",
    "p6_found": "SELECT DISTINCT idx FROM metadata WHERE length(snippet) > 1200",
    "p8_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
}
