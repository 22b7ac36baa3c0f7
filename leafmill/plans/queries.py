"""The registry of the search engine's own queries, each over whole tables, with SQL wherever SQL can express it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import paths as P
from ..functions import text as TX
from ..operators import chunking as C
from ..operators import dimensions as D
from ..operators import filters as FI
from ..operators import ranking as R
from ..operators import search as S
from ..operators import vectors as V
from ..operators.ids import with_ids
from ..sources import sinks
from ..sources.scratch import shared_dir
from ..sources.tables import table
from ..streaming import requests as RS
from . import api, ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

PHRASE = "inner light"
COMMON = "of the"
K = 100
LABELS = {"CWSA": "Collected works, first series", "CWM": "Collected works, second series", "Disciples": "Works of disciples"}
AUTHORS = ["Mirelle Adravane", "Nobody", "Kesh Ivarthen", "Orlin Sundrai"]
BASE, ROOT = "https://books.example/pdfs", "scans"

# What NFKC does to the characters of the tables, in SQL: full-width forms by rule, ligatures one by one.
_WIDE = "".join(map(chr, range(0xFF01, 0xFF5F)))
_NARROW = "".join(map(chr, range(0x21, 0x7F)))
_LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "…": "...", "ϲ": "ς", "Ϲ": "Σ"}
_SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
_BLANKS = "".join(map(chr, [0xA0, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000]))


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _nfkc_sql(x: str) -> str:
    x = f"translate({x}, {_q(_WIDE + _BLANKS)}, {_q(_NARROW + ' ' * len(_BLANKS))})"
    for a, b in _LIGATURES.items():
        x = f"replace({x}, {_q(a)}, {_q(b)})"
    return f"translate(nfc_normalize({x}), {_q(TX.QUOTES)}, {_q(TX.PLAIN)})"


def _flat_sql(x: str) -> str:
    return f"trim(regexp_replace({x}, {_q(_SPACE)}, ' ', 'g'))"


def _prepared_sql(x: str) -> str:
    return f"lower({_flat_sql(_nfkc_sql(x))})"


def _title_sql(file: str) -> str:
    """Runs of letters begin with a capital and go on small."""
    spaced = f"translate(regexp_replace(regexp_replace(replace({file}, '.pdf', ''), '^[0-9]+[-_]*', ''), '([a-z])([A-Z])', '\\1 \\2', 'g'), '_-', '  ')"
    return f"array_to_string(list_transform(regexp_extract_all({spaced}, '\\p{{L}}+|\\P{{L}}+'), lambda x: upper(left(x, 1)) || lower(substr(x, 2))), '')"


def _marked_sql(x: str, phrase: str) -> str:
    """T20 of an ASCII phrase; a letter may be full-width."""
    either = lambda ch: f"[{ch}{_WIDE[_NARROW.index(ch)]}{_WIDE[_NARROW.index(ch.upper())]}]"
    words = _SPACE.join("".join(map(either, w)) for w in phrase.split())
    return f"regexp_replace({x}, {_q(rf'(^|[^0-9A-Za-z_])({words})($|[^0-9A-Za-z_])')}, '\\1<mark>\\2</mark>\\3', 'gi')"


def _snippets_sql(phrase: str) -> str:
    """T22 of every chunk, as the table sn (idx, text)."""
    hit = " OR ".join(f"contains(lower({_nfkc_sql('l[i]')}), {_q(w)})" for w in phrase.split())
    show = lambda a, b: f"array_to_string(list_transform(l[{a} + 1:{b}], lambda x: {_marked_sql('x', phrase)}), chr(10))"
    return f"""sn0 AS (SELECT idx, snippet, string_split(snippet, chr(10)) AS l FROM metadata WHERE snippet IS NOT NULL),
  sn1 AS (SELECT *, list_filter(range(1, len(l) + 1), lambda i: {hit}) AS h FROM sn0),
  sn2 AS (SELECT *, greatest(0, h[1] - 6) AS a, least(len(l), h[-1] + 5) AS b FROM sn1),
  sn3 AS (SELECT *, {show('a', 'b')} AS narrow, {show('greatest(0, a - 5)', 'least(len(l), b + 5)')} AS wide FROM sn2),
  sn AS (SELECT idx, substring(replace(CASE WHEN len(h) = 0 THEN {_marked_sql('substring(snippet, 1, 500)', phrase)} WHEN length(narrow) >= 200 THEN narrow ELSE wide END, chr(10), '<br>'), 1, 500) AS text FROM sn3)"""


_DOT = "list_inner_product(embedding::DOUBLE[], q::DOUBLE[])"
_V = "v AS MATERIALIZED (SELECT idx, embedding::DOUBLE[] AS e FROM vectors WHERE embedding IS NOT NULL), f AS (SELECT e AS q FROM v WHERE list_inner_product(e, e) > 0 ORDER BY idx LIMIT 1)"
_SCORE = "list_inner_product(e, q)"
_SEVEN = "(SELECT embedding AS q FROM embeddings WHERE vec_id = 7)"
_LEX = f"""base AS (SELECT *, {_prepared_sql('snippet')} AS n FROM metadata WHERE snippet IS NOT NULL AND length(snippet) >= 10),
  ex AS (SELECT idx, 1 AS category_priority, 0.0::DOUBLE AS distance, coalesce(priority, 0) AS priority, idx AS ord FROM base WHERE contains(n, {_q(PHRASE)})),
  aw AS (SELECT idx, 3 AS category_priority, 0.1::DOUBLE AS distance, coalesce(priority, 0) AS priority, idx AS ord FROM base WHERE list_has_all(string_split(n, ' '), ['inner', 'light']) AND idx NOT IN (SELECT idx FROM ex))"""


def _knn_sql(k: int) -> str:
    return f"{_V}, knn AS (SELECT idx, {_SCORE} AS score FROM v, f ORDER BY score DESC, idx LIMIT {k})"


def _near_sql(k: int, without: str, where: str = "TRUE") -> str:
    return f"se AS (SELECT idx, 4 AS category_priority, score AS distance, coalesce(priority, 0) AS priority, row_number() OVER (ORDER BY score DESC, idx) AS ord FROM knn JOIN base USING (idx) WHERE idx NOT IN ({without}) AND {where} ORDER BY ord LIMIT {k})"


_OUT = "idx, category_priority, priority, round(distance, 6) AS distance"


def _out(df: DataFrame) -> DataFrame:
    return df.select("idx", "category_priority", "priority", F.round("distance", 6).alias("distance"))


def query(sql: str | None = None):
    """Registers a function under its name, with the SQL for the same rows."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def _meta(spark, d):
    return table(spark, d, "metadata")


def _vector(spark, d) -> list[float]:
    """The first vector that has a direction."""
    return V.first_vector(table(spark, d, "vectors"))


# Text


@query(f"SELECT idx, {_nfkc_sql('snippet')} AS text FROM metadata")
def normalize_text(spark, d):
    return _meta(spark, d).select("idx", TX.normalize_text(F.col("snippet")).alias("text"))


@query(f"SELECT idx, {_prepared_sql('snippet')} AS text FROM metadata")
def prepare_text(spark, d):
    return _meta(spark, d).select("idx", TX.prepare_text(F.col("snippet")).alias("text"))


@query(f"SELECT doc_id, CAST(CASE WHEN {_flat_sql('text')} = '' THEN 0 ELSE len(string_split({_flat_sql('text')}, ' ')) END AS INTEGER) AS n_words FROM documents WHERE text IS NOT NULL")
def tokenize_counts(spark, d):
    return table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", F.size(TX.tokens(TX.collapse_space(F.col("text")))).alias("n_words"))


@query("SELECT idx, replace(snippet, '-' || chr(10), '') AS text FROM metadata")
def dehyphenate(spark, d):
    return _meta(spark, d).select("idx", TX.dehyphenate(F.col("snippet")).alias("text"))


@query(f"SELECT idx, {_marked_sql('snippet', COMMON)} AS text FROM metadata WHERE snippet IS NOT NULL")
def highlight(spark, d):
    return _meta(spark, d).filter("snippet IS NOT NULL").select("idx", TX.highlighted(F.col("snippet"), COMMON).alias("text"))


@query(f"SELECT idx, regexp_replace(snippet, '({COMMON})', '<mark>\\1</mark>', 'gi') AS text FROM metadata")
def highlight_legacy(spark, d):
    return _meta(spark, d).select("idx", TX.highlight_plain(F.col("snippet"), COMMON).alias("text"))


@query(f"WITH {_snippets_sql(COMMON)} SELECT idx, text FROM sn")
def snippet_lines(spark, d):
    return _meta(spark, d).filter("snippet IS NOT NULL").select("idx", TX.snippet(F.col("snippet"), COMMON).alias("text"))


def _first_line_sql(phrase: str) -> str:
    """T24 of every chunk."""
    strip = lambda x: f"regexp_replace(regexp_replace({x}, '^' || {_q(_SPACE)}, ''), {_q(_SPACE)} || '$', '')"
    show = lambda a, b: f"array_to_string(list_transform(l[{a} + 1:{b}], lambda x: {_marked_sql(strip('x'), phrase)}), chr(10))"
    head = _marked_sql("replace(substring(snippet, 1, 500), chr(10), '<br>')", phrase)
    return f"""WITH f0 AS (SELECT idx, snippet, string_split(snippet, chr(10)) AS l FROM metadata WHERE snippet IS NOT NULL),
  f1 AS (SELECT *, list_filter(range(1, len(l) + 1), lambda i: contains(lower(l[i]), {_q(phrase)}))[1] AS h FROM f0),
  f2 AS (SELECT *, greatest(0, h - 6) AS a, least(len(l), h + 4) AS b FROM f1),
  f3 AS (SELECT *, {show('a', 'b')} AS narrow, {show('greatest(0, a - 5)', 'least(len(l), b + 5)')} AS wide FROM f2)
  SELECT idx, CASE WHEN h IS NULL THEN {head} ELSE substring(replace(CASE WHEN length(narrow) >= 200 THEN narrow ELSE wide END, chr(10), '<br>'), 1, 500) END AS text FROM f3"""


@query(_first_line_sql(COMMON))
def snippet_first_line(spark, d):
    return _meta(spark, d).filter("snippet IS NOT NULL").select("idx", TX.snippet(F.col("snippet"), COMMON, "first_line").alias("text"))


@query()
def snippet_sentences(spark, d):
    return _meta(spark, d).filter("snippet IS NOT NULL").select("idx", TX.snippet(F.col("snippet"), COMMON, "sentences").alias("text"))


@query("""SELECT request_id, CASE WHEN len(string_split(t, '<mark>')) > len(string_split(t, '</mark>')) THEN t || '</mark>' ELSE t END AS text
  FROM (SELECT request_id, regexp_replace(snippet, '<([^>]*)$', '&lt;\\1') AS t FROM results)""")
def sanitize_html(spark, d):
    return table(spark, d, "results").select("request_id", TX.sanitize_html(F.col("snippet")).alias("text"))


@query("SELECT idx, substring(snippet, 1, 500) AS head, replace(snippet, chr(10), '<br>') AS broken FROM metadata")
def truncate_and_breaks(spark, d):
    return _meta(spark, d).select("idx", TX.truncate(F.col("snippet")).alias("head"), TX.breaks(F.col("snippet")).alias("broken"))


# Chunks


@query(f"""WITH w AS (SELECT doc_id, CASE WHEN {_flat_sql('text')} = '' THEN [] ELSE string_split({_flat_sql('text')}, ' ') END AS w FROM documents WHERE text IS NOT NULL)
  SELECT doc_id, CAST(i AS INTEGER) AS chunk_no, array_to_string(list_slice(w, i * 80 + 1, i * 80 + 100), ' ') AS chunk FROM w, unnest(range(0, CAST(ceil(len(w) / 80.0) AS BIGINT))) AS r(i)""")
def chunk_words(spark, d):
    return C.chunk_words(table(spark, d, "documents").filter("text IS NOT NULL"), "text", ["doc_id"], 100, 20)


@query(f"""WITH w AS (SELECT doc_id, CASE WHEN {_flat_sql('text')} = '' THEN 0 ELSE len(string_split({_flat_sql('text')}, ' ')) END AS n FROM documents WHERE text IS NOT NULL)
  SELECT count(*) FILTER (WHERE n > 0) AS n_documents, CAST(sum(ceil(n / 800.0)) AS BIGINT) AS n_chunks FROM w""")
def chunk_stats(spark, d):
    chunks = C.chunk_words(table(spark, d, "documents").filter("text IS NOT NULL"), "text", ["doc_id"])
    return chunks.agg(F.count_distinct("doc_id").alias("n_documents"), F.count("*").alias("n_chunks"))


@query("SELECT count(DISTINCT file_path) AS n_files, count(DISTINCT (file_path, page_number)) FILTER (WHERE file_path IS NOT NULL AND page_number IS NOT NULL) AS n_pages, count(*) AS n_chunks FROM metadata")
def ingest_counts(spark, d):
    return D.ingest_counts(_meta(spark, d))


_HEADING_SQL = C.HEADING.replace(r"\w", r"[\p{L}\p{M}\p{N}_]")


@query(f"""WITH l AS (SELECT idx, i AS pos, lines[i] AS raw, regexp_replace(regexp_replace(lines[i], '^' || {_q(_SPACE)}, ''), {_q(_SPACE)} || '$', '') AS line FROM (SELECT idx, lines, unnest(range(1, len(lines) + 1)) AS i FROM (SELECT idx, string_split(snippet, chr(10)) AS lines FROM metadata WHERE snippet IS NOT NULL))),
  h AS (SELECT *, regexp_matches(line, {_q(_HEADING_SQL)}) AS heading, regexp_matches(line, '^\\p{{Nd}}+$') AS number FROM l),
  n AS (SELECT *, lead(line) OVER w AS next, lead(heading) OVER w AS next_heading, lead(number) OVER w AS next_number, sum(CAST(heading AS INTEGER)) OVER w AS section FROM h WINDOW w AS (PARTITION BY idx ORDER BY pos)),
  s AS (SELECT idx, section, coalesce(max(CASE WHEN heading THEN CASE WHEN coalesce(next, '') <> '' AND NOT coalesce(next_number, FALSE) AND NOT coalesce(next_heading, FALSE) THEN line || ' - ' || next ELSE line END END), '{C.FIRST_TITLE}') AS title,
    string_agg(raw, ' ' ORDER BY pos) FILTER (WHERE NOT heading AND NOT number) AS body FROM n GROUP BY 1, 2),
  w AS (SELECT idx, section, title, string_split({_flat_sql('body')}, ' ') AS w FROM s WHERE {_flat_sql('body')} <> ''),
  c AS (SELECT idx, section, title, i, array_to_string(list_slice(w, i * 80 + 1, i * 80 + 100), ' ') AS chunk FROM w, unnest(range(0, CAST(ceil(len(w) / 80.0) AS BIGINT))) AS r(i))
  SELECT idx, CAST(row_number() OVER (PARTITION BY idx ORDER BY section, i) - 1 AS INTEGER) AS chunk_no, title, chunk FROM c""")
def chapter_chunks(spark, d):
    return C.chapter_chunks(_meta(spark, d).filter("snippet IS NOT NULL"), "idx", "snippet", 100, 20)


@query("SELECT file_path, CAST(page_number AS INTEGER) AS page_number, array_to_string(h, ' | ') AS chapter_name FROM (SELECT file_path, unnest(map_keys(headings)) AS page_number, unnest(map_values(headings)) AS h FROM page_headings)")
def page_map_roundtrip(spark, d):
    rows = C.explode_pages(table(spark, d, "page_headings"), "file_path", "headings", "headings")
    back = C.explode_pages(C.collect_pages(rows, "file_path", "headings"), "file_path", "pages", "headings")
    return back.select("file_path", "page_number", C.chapter_name(F.col("headings")).alias("chapter_name"))


@query("SELECT file_path, string_agg(chapter_name, '' ORDER BY page_number, idx) AS text FROM (SELECT idx, file_path, page_number, coalesce(chapter_name, '') AS chapter_name FROM metadata WHERE page_number IS NOT NULL AND file_path IS NOT NULL) GROUP BY 1")
def concat_pages(spark, d):
    rows = _meta(spark, d).filter("page_number IS NOT NULL AND file_path IS NOT NULL").select("file_path", F.struct("page_number", "idx").alias("page_number"), "chapter_name")
    return C.concat_pages(rows, "file_path", "chapter_name")


@query()
def ingest_documents(spark, d):
    pages = table(spark, d, "documents").filter("text IS NOT NULL").select(F.concat(F.lit(f"{ROOT}/"), F.coalesce("pdf_filename", F.lit("none.pdf"))).alias("path"), F.col("doc_id").cast("int").alias("page_number"), "text", F.array("title").alias("headings"))
    return ingest.chunks_from_pages(pages, table(spark, d, "books"), BASE, ROOT)


@query("SELECT count(*) AS n, count(*) AS n_distinct, 0::BIGINT AS lowest, count(*) - 1 AS highest, CAST(sum(doc_id) AS BIGINT) AS docs FROM documents")
def ingest_ids(spark, d):
    """Dense ids over whole documents, in the order of their texts; the texts make the rows that are moved large."""
    ids = with_ids(table(spark, d, "documents").select("doc_id", "text"), ["text"])
    return ids.agg(F.count("*").alias("n"), F.count_distinct("idx").alias("n_distinct"), F.min("idx").alias("lowest"), F.max("idx").alias("highest"), F.sum("doc_id").alias("docs"))


@query("SELECT doc_id, row_number() OVER (ORDER BY written_at NULLS FIRST, doc_id) - 1 AS idx FROM documents")
def ingest_order(spark, d):
    return with_ids(table(spark, d, "documents").select("doc_id", "written_at", "text"), ["written_at", "doc_id"]).select("doc_id", "idx")


# Lexical search


@query(f"SELECT idx FROM (SELECT idx, {_prepared_sql('snippet')} AS n FROM metadata WHERE snippet IS NOT NULL AND length(snippet) >= 10) WHERE contains(n, {_q(COMMON)})")
def exact_match(spark, d):
    return S.exact_match(_meta(spark, d), COMMON, kind=None).select("idx")


@query(f"SELECT idx FROM (SELECT idx, {_prepared_sql('snippet')} AS n FROM metadata WHERE snippet IS NOT NULL AND length(snippet) >= 10 AND \"group\" = 'CWSA') WHERE contains(n, {_q(COMMON)})")
def exact_match_filtered(spark, d):
    return S.exact_match(_meta(spark, d), COMMON, {"group": "CWSA", "author": ""}, kind=None).select("idx")


@query(f"SELECT idx FROM metadata WHERE contains(lower(snippet), {_q(COMMON)})")
def exact_match_legacy(spark, d):
    return _meta(spark, d).filter(FI.exact_phrase_plain(F.col("snippet"), COMMON)).select("idx")


@query("SELECT idx FROM (SELECT idx, " + _prepared_sql("snippet") + " AS n FROM metadata WHERE snippet IS NOT NULL AND length(snippet) >= 10) WHERE list_has_all(string_split(n, ' '), ['inner', 'light'])")
def all_words_tokens(spark, d):
    return S.all_words_match(_meta(spark, d), PHRASE, kind=None).select("idx")


@query("SELECT idx FROM (SELECT idx, " + _prepared_sql("snippet") + " AS n FROM metadata WHERE snippet IS NOT NULL AND length(snippet) >= 10) WHERE contains(n, 'inner') AND contains(n, 'light')")
def all_words_substring(spark, d):
    return S.all_words_match(_meta(spark, d), PHRASE, substrings=True, kind=None).select("idx")


@query(f"WITH {_LEX} SELECT idx FROM aw")
def all_words_excluding_exact(spark, d):
    chunks = S.with_prepared(_meta(spark, d))
    return S.all_words_match(chunks, PHRASE, exclude=S.exact_match(chunks, PHRASE, kind=None), kind=None).select("idx")


@query("SELECT idx, CAST(count(*) AS BIGINT) AS n_lines FROM (SELECT idx, unnest(string_split(snippet, chr(10))) AS l FROM metadata WHERE snippet IS NOT NULL) WHERE contains(lower(l), 'ancient') OR contains(lower(l), 'river') GROUP BY 1")
def any_word_lines(spark, d):
    lines = _meta(spark, d).filter("snippet IS NOT NULL").select("idx", F.explode(F.split("snippet", "\n", -1)).alias("line"))
    return lines.filter(FI.any_word(F.lower("line"), ["ancient", "river"])).groupBy("idx").agg(F.count("*").alias("n_lines"))


@query("SELECT idx FROM metadata WHERE contains(snippet, 'Beyond the')")
def snippet_positions(spark, d):
    return FI.raw_positions(_meta(spark, d), "snippet", "Beyond the")


@query("SELECT idx, file_path FROM metadata WHERE contains(file_path, 'Lectures')")
def path_filter(spark, d):
    return FI.path_contains(_meta(spark, d), "Lectures").select("idx", "file_path")


@query("""SELECT idx, field, expected, actual FROM (SELECT idx, 'group' AS field, 'CWSA' AS expected, "group" AS actual FROM metadata UNION ALL SELECT idx, 'author', 'Kesh Ivarthen', author FROM metadata) WHERE actual IS DISTINCT FROM expected""")
def metadata_verify(spark, d):
    return FI.mismatches(_meta(spark, d), "idx", {"group": "CWSA", "author": "Kesh Ivarthen"})


# Vectors


@query(f"SELECT vec_id, round({_DOT}, 6) AS score FROM embeddings, {_SEVEN} ORDER BY {_DOT} DESC, vec_id LIMIT 25")
def knn_ip(spark, d):
    e = table(spark, d, "embeddings")
    return V.knn(e, V.stored_vector(e, 7, "vec_id"), 25, "ip", "vec_id").select("vec_id", F.round("score", 6).alias("score"))


@query(f"WITH {_V} SELECT idx, round(s, 6) AS score FROM (SELECT idx, {_SCORE} / CASE WHEN list_inner_product(e, e) > 0 THEN sqrt(list_inner_product(e, e)) ELSE 1 END AS s FROM v, f) ORDER BY s DESC, idx LIMIT 25")
def knn_cosine(spark, d):
    return V.knn(table(spark, d, "vectors"), _vector(spark, d), 25, "cosine").select("idx", F.round("score", 6).alias("score"))


@query(f"""SELECT vec_id, round(s, 6) AS score FROM (SELECT vec_id, list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]) - 2 * {_DOT} + list_inner_product(q::DOUBLE[], q::DOUBLE[]) AS s FROM embeddings, {_SEVEN}) ORDER BY s, vec_id LIMIT 25""")
def knn_l2(spark, d):
    e = table(spark, d, "embeddings")
    return V.knn(e, V.stored_vector(e, 7, "vec_id"), 25, "l2", "vec_id").select("vec_id", F.abs(F.round("score", 6)).alias("score"))


@query("""SELECT query_id, vec_id, rank FROM (SELECT a.vec_id AS query_id, b.vec_id, CAST(row_number() OVER (PARTITION BY a.vec_id ORDER BY list_inner_product(b.embedding::DOUBLE[], a.embedding::DOUBLE[]) DESC, b.vec_id) AS INTEGER) AS rank
  FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0) WHERE rank <= 10""")
def knn_batch(spark, d):
    e = table(spark, d, "embeddings")
    asked = e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    return V.knn_many(e, asked, 10, "ip", "vec_id").select("query_id", "vec_id", "rank")


@query(f"SELECT vec_id FROM (SELECT vec_id, {_DOT} AS s FROM embeddings, {_SEVEN} ORDER BY s DESC, vec_id LIMIT 50) WHERE s >= 0.3")
def knn_threshold(spark, d):
    e = table(spark, d, "embeddings")
    return V.within(V.knn(e, V.stored_vector(e, 7, "vec_id"), 50, "ip", "vec_id"), 0.3).select("vec_id")


@query("WITH " + _V + " SELECT idx, round(CASE WHEN n > 0 THEN e[1] / n ELSE e[1] END, 6) AS first_component, round(CASE WHEN n > 0 THEN 1.0 ELSE 0.0 END, 6)::DOUBLE AS length FROM (SELECT idx, e, sqrt(list_inner_product(e, e)) AS n FROM v)")
def vector_normalize(spark, d):
    unit = table(spark, d, "vectors").filter("embedding IS NOT NULL").select("idx", V.normalized(F.col("embedding")).alias("u"))
    return unit.select("idx", F.round(F.get("u", F.lit(0)), 6).alias("first_component"), F.round(V.norm(F.col("u")), 6).alias("length"))


@query("SELECT count(*) AS n_vectors FROM vectors")
def index_count(spark, d):
    return V.cardinality(table(spark, d, "vectors"))


@query(f"WITH {_V} SELECT round(min({_SCORE}), 6) AS min_score, round(max({_SCORE}), 6) AS max_score, round(avg({_SCORE}), 6) AS mean_score FROM v, f")
def distance_stats(spark, d):
    return V.distance_stats(table(spark, d, "vectors"), _vector(spark, d)).select(*(F.round(c, 6).alias(c) for c in ("min_score", "max_score", "mean_score")))


@query(f"SELECT vec_id FROM embeddings, {_SEVEN} ORDER BY {_DOT} DESC, vec_id LIMIT 1")
def self_lookup(spark, d):
    e = table(spark, d, "embeddings")
    return V.self_lookup(e, V.stored_vector(e, 7, "vec_id"), "vec_id").select("vec_id")


@query()
def embed_documents(spark, d):
    return table(spark, d, "documents").select("doc_id", V.embed(F.col("text")).alias("embedding"))


# Semantic and hybrid search


@query(f"WITH base AS (SELECT * FROM metadata WHERE snippet IS NOT NULL AND length(snippet) >= 10), {_knn_sql(5 * K)}, {_near_sql(K, 'SELECT -1', chr(34) + 'group' + chr(34) + chr(39).join([' = ', 'CWM', '']))} SELECT {_OUT} FROM se")
def semantic_postfilter(spark, d):
    return _out(S.semantic_match(_meta(spark, d), table(spark, d, "vectors"), PHRASE, _vector(spark, d), K, {"group": "CWM"}, kind=None))


@query(f"WITH {_V} SELECT idx, round({_SCORE}, 6) AS distance FROM metadata JOIN v USING (idx), f WHERE snippet IS NOT NULL AND length(snippet) >= 10 AND \"group\" = 'CWM'")
def semantic_prefilter(spark, d):
    found = S.semantic_match(_meta(spark, d), table(spark, d, "vectors"), PHRASE, _vector(spark, d), K, {"group": "CWM"}, overfetch=None, kind=None)
    return found.select("idx", F.round("distance", 6).alias("distance"))


@query(f"WITH {_V} SELECT idx, round({_SCORE}, 6) AS score FROM v, f WHERE idx NOT IN (SELECT idx FROM metadata)")
def semantic_bounds(spark, d):
    """Vectors that have no chunk: what the inner join of the search drops."""
    return V.scored(table(spark, d, "vectors"), _vector(spark, d)).join(_meta(spark, d).select("idx"), "idx", "left_anti").select("idx", F.round("score", 6).alias("score"))


_ALL = f"WITH {_LEX}, {_knn_sql(5 * K)}, {_near_sql(K, 'SELECT idx FROM ex UNION ALL SELECT idx FROM aw')}, r AS (SELECT * FROM ex UNION ALL SELECT * FROM aw UNION ALL SELECT * FROM se)"


@query(f"{_ALL} SELECT {_OUT} FROM (SELECT * FROM r ORDER BY category_priority, priority DESC, distance DESC, ord LIMIT {K})")
def hybrid_all(spark, d):
    return _out(S.search(_meta(spark, d), table(spark, d, "vectors"), S.Request(PHRASE, K), _vector(spark, d), kind=None))


@query(f"WITH {_LEX} SELECT {_OUT} FROM (SELECT * FROM ex ORDER BY category_priority, priority DESC, distance, ord LIMIT {K})")
def search_exact(spark, d):
    """O1: one tier, by priority."""
    found = S.search(_meta(spark, d), table(spark, d, "vectors"), S.Request(PHRASE, K, "exact"), kind=None, keep_ids=True)
    return _out(found)


@query(f"WITH {_LEX.replace(' AND idx NOT IN (SELECT idx FROM ex)', '')} SELECT {_OUT} FROM (SELECT * FROM aw ORDER BY category_priority, priority DESC, distance, ord LIMIT {K})")
def search_all_words(spark, d):
    return _out(S.search(_meta(spark, d), table(spark, d, "vectors"), S.Request(PHRASE, K, "all_words"), kind=None, keep_ids=True))


@query(f"WITH base AS (SELECT * FROM metadata WHERE snippet IS NOT NULL AND length(snippet) >= 10), {_knn_sql(5 * K)}, {_near_sql(K, 'SELECT -1')} SELECT {_OUT} FROM se")
def search_semantic(spark, d):
    """The most similar, by priority."""
    return _out(S.search(_meta(spark, d), table(spark, d, "vectors"), S.Request(PHRASE, K, "semantic"), _vector(spark, d), kind=None, keep_ids=True))


@query(f"{_ALL} SELECT {_OUT} FROM (SELECT * FROM r ORDER BY category_priority, priority DESC, distance, ord LIMIT {K})")
def hybrid_distance_order(spark, d):
    """O3, Q5, Q6: smaller distances first in every tier, as for squared distances."""
    return _out(S.search(_meta(spark, d), table(spark, d, "vectors"), S.Request(PHRASE, K), _vector(spark, d), kind=None, order="l2"))


@query("SELECT request_id, regexp_replace(snippet, '(the)', '<mark>\\1</mark>', 'gi') AS text FROM results")
def rehighlight(spark, d):
    """What a client marks again in a snippet that it shows."""
    return table(spark, d, "results").select("request_id", TX.highlight_plain(F.col("snippet"), "the").alias("text"))


_ALL_SHOWN = f"WITH {_snippets_sql(PHRASE)}, " + _ALL.replace("WITH ", "", 1).replace("FROM metadata WHERE snippet IS NOT NULL AND length(snippet) >= 10", "FROM metadata JOIN sn USING (idx) WHERE length(text) >= 10")


@query(f"{_ALL_SHOWN} SELECT idx, category_priority, r.priority, round(distance, 6) AS distance, text AS snippet FROM (SELECT * FROM r ORDER BY category_priority, priority DESC, distance DESC, ord LIMIT {K}) r JOIN sn USING (idx)")
def search_all(spark, d):
    """The same with its snippets, whose length after markup decides."""
    found = S.search(_meta(spark, d), table(spark, d, "vectors"), S.Request(PHRASE, K), _vector(spark, d))
    return found.select("idx", "category_priority", "priority", F.round("distance", 6).alias("distance"), "snippet")


@query(f"""{_ALL}, p AS (SELECT idx, CASE WHEN score IS NOT NULL AND category_priority = 3 THEN 2 ELSE category_priority END AS category_priority, CASE WHEN score IS NOT NULL AND category_priority = 3 THEN score ELSE distance END AS distance, priority, ord FROM r LEFT JOIN knn USING (idx))
  SELECT {_OUT} FROM (SELECT * FROM p ORDER BY category_priority, priority DESC, distance DESC, ord LIMIT {K})""")
def hybrid_promoted(spark, d):
    return _out(S.search(_meta(spark, d), table(spark, d, "vectors"), S.Request(PHRASE, K), _vector(spark, d), promote=True, kind=None))


@query(f"""WITH {_LEX.replace(">= 10", ">= 20").replace("list_has_all(string_split(n, ' '), ['inner', 'light'])", "contains(n, 'inner') AND contains(n, 'light')")}, {_knn_sql(K)}, {_near_sql(K, 'SELECT idx FROM ex UNION ALL SELECT idx FROM aw')},
  r AS (SELECT * FROM ex UNION ALL SELECT * FROM aw UNION ALL SELECT * FROM se) SELECT {_OUT} FROM (SELECT * FROM r ORDER BY category_priority, ord LIMIT {K})""")
def hybrid_quota(spark, d):
    return _out(S.quota_search(_meta(spark, d), table(spark, d, "vectors"), PHRASE, _vector(spark, d), K))


@query(f"WITH {_LEX.replace('length(snippet) >= 10', 'TRUE')}, {_knn_sql(K)}, {_near_sql(K, 'SELECT -1')} SELECT {_OUT} FROM (SELECT * FROM ex UNION ALL SELECT * FROM se)")
def hybrid_union_all(spark, d):
    return _out(S.union_search(_meta(spark, d), table(spark, d, "vectors"), PHRASE, _vector(spark, d), K))


@query(f"""WITH base AS (SELECT idx, snippet, coalesce(priority, 999) AS priority FROM metadata WHERE snippet IS NOT NULL),
  ex AS (SELECT idx, snippet, priority, 0.0::DOUBLE AS distance, 0 AS part FROM base WHERE contains(lower(snippet), {_q(PHRASE)})), {_knn_sql(3 * K)},
  se AS (SELECT idx, snippet, priority, score AS distance, 1 AS part FROM knn JOIN base USING (idx) ORDER BY distance DESC, idx LIMIT greatest({K} - least((SELECT count(*) FROM ex), {K}), 1)),
  u AS (SELECT *, row_number() OVER (PARTITION BY snippet ORDER BY part, priority, distance, idx) AS place FROM (SELECT * FROM ex UNION ALL SELECT * FROM se))
  SELECT idx, priority, round(distance, 6) AS distance FROM (SELECT * FROM u WHERE place = 1 ORDER BY priority, distance, idx LIMIT {K})""")
def hybrid_dedupe_snippet(spark, d):
    found = S.legacy_search(_meta(spark, d), table(spark, d, "vectors"), PHRASE, _vector(spark, d), K)
    return found.select("idx", "priority", F.round("distance", 6).alias("distance"))


@query("SELECT request_id, rank, priority, distance FROM (SELECT request_id, priority, distance, CAST(row_number() OVER (PARTITION BY request_id ORDER BY priority NULLS FIRST, distance NULLS FIRST, file_path NULLS FIRST, page_number NULLS FIRST, snippet NULLS FIRST) AS INTEGER) AS rank FROM results)")
def order_priority_asc(spark, d):
    """All rows; nulls stand first where a column ascends, last where it descends."""
    order = Window.partitionBy("request_id").orderBy(*R.tier_order("legacy", "file_path"), "page_number", "snippet")
    return table(spark, d, "results").withColumn("rank", F.row_number().over(order)).select("request_id", "rank", "priority", "distance")


@query("SELECT request_id, rank, priority, distance FROM (SELECT request_id, priority, distance, CAST(row_number() OVER (PARTITION BY request_id ORDER BY distance DESC NULLS LAST, priority NULLS FIRST, file_path NULLS FIRST, page_number NULLS FIRST, snippet NULLS FIRST) AS INTEGER) AS rank FROM results)")
def order_score_first(spark, d):
    """All rows; nulls stand first where a column ascends, last where it descends."""
    order = Window.partitionBy("request_id").orderBy(*R.tier_order("score_first", "file_path"), "page_number", "snippet")
    return table(spark, d, "results").withColumn("rank", F.row_number().over(order)).select("request_id", "rank", "priority", "distance")


@query("SELECT category_priority, count(*) AS n FROM results GROUP BY 1")
def tier_counts(spark, d):
    return S.tier_counts(table(spark, d, "results"))


@query(f"{_ALL} SELECT {_OUT} FROM (SELECT * FROM r ORDER BY category_priority, priority DESC, distance DESC, ord LIMIT 10 OFFSET 20)")
def pagination(spark, d):
    found = S.search(_meta(spark, d), table(spark, d, "vectors"), S.Request(PHRASE, K), _vector(spark, d), kind=None)
    return _out(R.page(found, 3, 10, R.tier_order("all")))


@query("SELECT CAST(c AS BIGINT) AS current, CAST(p AS BIGINT) AS page FROM (SELECT c, unnest(range(greatest(1, least(c - 2, 3)), greatest(1, least(c - 2, 3)) + 5)) AS p FROM range(1, 8) AS t(c))")
def pager_window(spark, d):
    return spark.createDataFrame([(c, p) for c in range(1, 8) for p in R.pager_window(c, 7)], "current bigint, page bigint")


@query("SELECT idx, coalesce(author, 'Unknown') AS author, coalesce(\"group\", 'Unknown') AS \"group\", coalesce(book_title, 'Unknown') AS book_title, coalesce(chapter_name, 'N/A') AS chapter_name, coalesce(CAST(page_number AS VARCHAR), 'N/A') AS page_number, coalesce(priority, 0) AS priority FROM metadata")
def result_defaults(spark, d):
    return S.with_defaults(_meta(spark, d)).select("idx", "author", "group", "book_title", "chapter_name", "page_number", "priority")


@query()
def results_json(spark, d):
    return api.get_search(_meta(spark, d), table(spark, d, "vectors"), {"query": PHRASE, "top_k": "50"}, _vector(spark, d))


# Dimensions and facets


@query("SELECT DISTINCT author FROM books WHERE author IS NOT NULL")
def facet_authors(spark, d):
    return D.facet_authors(table(spark, d, "books"))


@query("SELECT DISTINCT \"group\", CAST(CASE \"group\" WHEN 'CWSA' THEN 1 WHEN 'CWM' THEN 2 WHEN 'Disciples' THEN 3 ELSE 4 END AS INTEGER) AS rank FROM books WHERE \"group\" IS NOT NULL")
def facet_groups(spark, d):
    return D.facet_groups(table(spark, d, "books"))


@query("SELECT \"group\", array_to_string(list_sort(list(book_title)), '|') AS titles FROM books GROUP BY 1")
def facet_titles_by_group(spark, d):
    return D.titles_by_group(table(spark, d, "books")).select("group", F.array_join("titles", "|").alias("titles"))


@query("SELECT CAST(CASE \"group\" WHEN 'CWSA' THEN 1 WHEN 'CWM' THEN 2 WHEN 'Disciples' THEN 3 ELSE 4 END AS INTEGER) AS rank, \"group\", book_title FROM books")
def facet_titles_flat(spark, d):
    return D.titles_flat(table(spark, d, "books"))


@query("SELECT DISTINCT book_title FROM books WHERE book_title IS NOT NULL")
def facet_distinct_titles(spark, d):
    return D.distinct_titles(table(spark, d, "books"))


_RANK = "CASE \"group\" WHEN 'CWSA' THEN 1 WHEN 'CWM' THEN 2 WHEN 'Disciples' THEN 3 ELSE 4 END"


@query(f"""SELECT array_to_string(list_sort(list(DISTINCT author)), '|') AS authors, (SELECT string_agg("group", '|' ORDER BY {_RANK}, "group") FROM (SELECT DISTINCT "group" FROM books)) AS groups, string_agg(book_title, '|' ORDER BY {_RANK}, "group", book_title) AS book_titles,
  (SELECT string_agg("group" || ': ' || t, '; ' ORDER BY {_RANK}, "group") FROM (SELECT "group", string_agg(book_title, ', ' ORDER BY book_title) AS t FROM books GROUP BY 1)) AS titles_by_group FROM books""")
def facets(spark, d):
    """Q11, every list in its order."""
    row = D.facets(table(spark, d, "books"))
    by_group = F.transform("groups", lambda g: F.concat(g, F.lit(": "), F.array_join(F.element_at("titles_by_group", g), ", ")))
    return row.select(*(F.array_join(c, "|").alias(c) for c in ("authors", "groups", "book_titles")), F.array_join(by_group, "; ").alias("titles_by_group"))


@query("""SELECT array_to_string(list_sort(list(DISTINCT author)), '|') AS authors, array_to_string(list_sort(list(DISTINCT "group")), '|') AS groups, array_to_string(list_sort(list(DISTINCT book_title)), '|') AS book_titles FROM books""")
def facets_legacy(spark, d):
    """Q12: distinct authors, groups and titles, each by name."""
    row = D.legacy_facets(table(spark, d, "books"))
    return row.select(*(F.array_join(c, "|").alias(c) for c in ("authors", "groups", "book_titles")))


@query("SELECT array_to_string(list_filter(['Mirelle Adravane', 'Nobody', 'Kesh Ivarthen', 'Orlin Sundrai'], lambda x: list_contains(l, x)), '|') AS authors FROM (SELECT list(DISTINCT author) AS l FROM books)")
def author_allowlist(spark, d):
    return D.allow_list(table(spark, d, "books"), AUTHORS).select(F.array_join("authors", "|").alias("authors"))


@query("SELECT book_title FROM books WHERE \"group\" = 'CWM'")
def dependent_titles(spark, d):
    return D.dependent_titles(table(spark, d, "books"), "CWM")


@query("""SELECT m.idx, coalesce(b.book_title, 'Unknown') AS book_title, coalesce(b.author, 'Unknown') AS author, coalesce(b."group", 'Unknown') AS "group", coalesce(b.priority, 999) AS priority FROM metadata m LEFT JOIN books b ON b.pdf_filename = regexp_extract(m.file_path, '[^/]*$')""")
def dimension_lookup_defaults(spark, d):
    return D.lookup_books(_meta(spark, d), table(spark, d, "books")).select("idx", "book_title", "author", "group", "priority")


@query("""SELECT m.idx, coalesce(array_to_string(h.h, ' | '), '') AS chapter_name FROM metadata m LEFT JOIN (SELECT file_path, unnest(map_keys(headings)) AS page_number, unnest(map_values(headings)) AS h FROM page_headings) h USING (file_path, page_number)""")
def headings_lookup(spark, d):
    return D.lookup_headings(_meta(spark, d), table(spark, d, "page_headings")).select("idx", "chapter_name")


@query(f"""WITH f AS (SELECT regexp_extract(file_path, '[^/]*$') AS pdf_filename, arg_max(string_split(file_path, '/')[-2], file_path) AS folder FROM metadata WHERE ends_with(file_path, '.pdf') GROUP BY 1)
  SELECT pdf_filename, {_title_sql('pdf_filename')} AS book_title, upper(left(folder, 1)) || lower(substr(folder, 2)) AS author, CASE lower(folder) WHEN 'cwm' THEN 'CWM' WHEN 'disciples' THEN 'Disciples' ELSE 'CWSA' END AS "group", 99 AS priority,
    'English' AS language, '' AS isbn, 'Yoga|Philosophy|Spirituality' AS tags, 'PDF' AS format, 'Public' AS availability, '' AS description FROM f""")
def books_from_files(spark, d):
    return D.books_from_files(_meta(spark, d).filter("file_path IS NOT NULL").select(F.col("file_path").alias("path")).distinct()).withColumn("tags", F.array_join("tags", "|"))


# Paths and display


@query(f"SELECT idx, '{BASE}/' || regexp_replace(file_path, '^{ROOT}/', '') || '#page=' || page_number AS url FROM metadata")
def url_build(spark, d):
    return _meta(spark, d).select("idx", P.page_url(BASE, ROOT, F.col("file_path"), F.col("page_number")).alias("url"))


@query(f"SELECT DISTINCT file_path, '{BASE}/' || replace(regexp_replace(replace(file_path, '.pdf', '.txt'), '^{ROOT}/', ''), '.txt', '.pdf') AS url FROM metadata")
def url_of_text(spark, d):
    return _meta(spark, d).select("file_path", P.text_to_pdf_url(BASE, ROOT, F.replace("file_path", F.lit(".pdf"), F.lit(".txt"))).alias("url")).distinct()


@query("SELECT idx, split_part(pdf_url, '#page=', 1) AS url, coalesce(TRY_CAST(nullif(regexp_extract(pdf_url, '#page=(\\d+)', 1), '') AS INTEGER), 1) AS page FROM metadata WHERE pdf_url IS NOT NULL")
def url_parse_page(spark, d):
    return _meta(spark, d).filter("pdf_url IS NOT NULL").select("idx", P.url_without_page(F.col("pdf_url")).alias("url"), P.url_page(F.col("pdf_url")).alias("page"))


@query("SELECT DISTINCT pdf_filename, url_encode(pdf_filename) AS encoded FROM books")
def encode_names(spark, d):
    return table(spark, d, "books").select("pdf_filename", P.encode_uri(F.col("pdf_filename")).alias("encoded")).distinct()


@query(f"SELECT idx, 'viewer.html?file=' || url_encode(pdf_url) || '#page=' || coalesce(page_number, 1) || '&search=' || url_encode({_q(PHRASE)}) AS link FROM metadata")
def viewer_links(spark, d):
    return _meta(spark, d).select("idx", P.viewer_link(F.col("pdf_url"), F.coalesce("page_number", F.lit(1)), F.lit(PHRASE)).alias("link"))


@query(f"SELECT pdf_filename, {_title_sql('pdf_filename')} AS title FROM books")
def format_titles(spark, d):
    return table(spark, d, "books").select("pdf_filename", P.format_title(F.col("pdf_filename")).alias("title"))


@query("SELECT DISTINCT folder, CASE lower(folder) WHEN 'cwsa' THEN 'CWSA' WHEN 'cwm' THEN 'CWM' WHEN 'disciples' THEN 'Disciples' ELSE 'CWSA' END AS \"group\", upper(left(folder, 1)) || lower(substr(folder, 2)) AS author FROM (SELECT string_split(file_path, '/')[-2] AS folder FROM metadata WHERE file_path IS NOT NULL)")
def folder_details(spark, d):
    folder = _meta(spark, d).filter("file_path IS NOT NULL").select(F.element_at(F.split("file_path", "/"), -2).alias("folder"))
    return folder.select("folder", P.folder_group(F.col("folder")).alias("group"), P.capitalize(F.col("folder")).alias("author")).distinct()


@query("SELECT DISTINCT \"group\", " + "CASE \"group\" " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in LABELS.items()) + " ELSE \"group\" END AS label FROM books")
def group_labels(spark, d):
    return table(spark, d, "books").select("group", P.group_label(F.col("group"), LABELS).alias("label")).distinct()


@query("SELECT request_id, coalesce(nullif(book_title, ''), 'Untitled') AS title, coalesce(nullif(snippet, ''), 'No snippet available.') AS snippet, coalesce(printf('%.2f', distance), 'N/A') AS distance FROM results")
def display_values(spark, d):
    r = table(spark, d, "results")
    return r.select("request_id", P.display(F.col("book_title"), "Untitled").alias("title"), P.display(F.col("snippet"), "No snippet available.").alias("snippet"), F.coalesce(F.when(F.col("distance").isNotNull(), P.two_decimals(F.col("distance"))), F.lit("N/A")).alias("distance"))


# The request log


@query("SELECT DISTINCT * FROM requests")
def requests_once(spark, d):
    return table(spark, d, "requests").distinct()


@query("""SELECT date_trunc('hour', requested_at) AS hour, search_type, count(*) AS n FROM (SELECT DISTINCT request_id, search_type, requested_at FROM requests) GROUP BY 1, 2""")
def requests_hourly(spark, d):
    once = table(spark, d, "requests").select("request_id", "search_type", "requested_at").distinct()
    return once.groupBy(F.date_trunc("hour", "requested_at").cast("timestamp_ntz").alias("hour"), "search_type").agg(F.count("*").alias("n"))


@query("""SELECT count(*) AS n, count(*) FILTER (WHERE trim(coalesce(query, '')) <> '' AND top_k >= 1 AND search_type IN ('all', 'exact', 'all_words', 'semantic')) AS n_valid FROM (SELECT DISTINCT request_id, query, top_k, search_type FROM requests)""")
def requests_valid(spark, d):
    once = table(spark, d, "requests").select("request_id", "query", "top_k", "search_type").distinct()
    valid = (F.trim(F.coalesce("query", F.lit(""))) != "") & (F.col("top_k") >= 1) & F.col("search_type").isin(*S.SEARCH_TYPES)
    return once.agg(F.count("*").alias("n"), F.count_if(F.coalesce(valid, F.lit(False))).alias("n_valid"))


@query("SELECT request_id, count(*) AS n_results FROM results GROUP BY 1")
def results_per_request(spark, d):
    return table(spark, d, "results").groupBy("request_id").agg(F.count("*").alias("n_results"))


@query("""SELECT date_trunc('hour', requested_at) AS hour, search_type, count(*) AS n FROM (SELECT DISTINCT request_id, search_type, requested_at FROM requests) GROUP BY 1, 2""")
def requests_stream(spark, d):
    """The log read as a stream, and counted as a whole. The table may be one file or a folder of files of any name; its path is
    given, as a filter for names would see those of the files inside."""
    path = f"{shared_dir(spark)}/requests-{uuid.uuid4().hex}"
    return RS.run_once(RS.hourly_totals(RS.request_stream(spark, f"{d}/requests.parquet", "*")), path, "complete")


@query("""SELECT CAST(row_number() OVER (ORDER BY file_path, page_number) AS INTEGER) AS page_number, file_path, array_to_string(h, ' | ') AS chapter_name
  FROM (SELECT file_path, unnest(map_keys(headings)) AS page_number, unnest(map_values(headings)) AS h FROM page_headings)""")
def merged_pages(spark, d):
    pages = C.explode_pages(table(spark, d, "page_headings"), "file_path", "headings", "headings")
    return C.merge_pages(pages, order=("file_path", "page_number")).select("page_number", "file_path", C.chapter_name(F.col("headings")).alias("chapter_name"))
