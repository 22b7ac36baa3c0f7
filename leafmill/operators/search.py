"""Lexical, vector and hybrid search over the chunk table: one lazy plan for a request.

``chunks`` has idx, snippet and the descriptive columns; where ``with_prepared`` was run at ingest, snippet_norm and
tokens are read instead of computed.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as TX
from . import filters as P
from . import ranking as R
from . import vectors as V

#: What a missing attribute becomes in results.
DEFAULTS = {"author": "Unknown", "book_title": "Unknown", "group": "Unknown", "chapter_name": "N/A", "file_path": "", "pdf_url": ""}
EXACT, PROMOTED, ALL_WORDS, SEMANTIC = 1, 2, 3, 4
SEARCH_TYPES = ("all", "exact", "all_words", "semantic")


@dataclass
class Request:
    """A search request, checked before any plan is made."""

    query: str
    top_k: int = 100
    search_type: str = "all"
    filters: dict[str, str | None] = field(default_factory=dict)
    min_snippet: int = 10

    def __post_init__(self) -> None:
        if self.query is None or not self.query.strip():
            raise ValueError("the query is empty")
        if not isinstance(self.top_k, int) or isinstance(self.top_k, bool) or self.top_k < 1:
            raise ValueError("top_k must be an integer of at least 1")
        self.filters = P.used_filters(self.filters)


def with_prepared(chunks: DataFrame) -> DataFrame:
    """snippet_norm and tokens, for chunks that have none yet."""
    if "snippet_norm" not in chunks.columns:
        chunks = chunks.withColumn("snippet_norm", TX.prepare_text(F.col("snippet")))
    return chunks if "tokens" in chunks.columns else chunks.withColumn("tokens", TX.tokens(F.col("snippet_norm")))


def with_defaults(results: DataFrame) -> DataFrame:
    """null attributes get their defaults; a page number is text, 'N/A' where unknown; a missing priority is 0."""
    made = {c: f"coalesce(`{c}`, '{default}')" if c in results.columns else f"'{default}'" for c, default in DEFAULTS.items()}
    made |= {"page_number": "coalesce(cast(page_number AS string), 'N/A')", "priority": "coalesce(priority, 0)"}
    return results.withColumns({c: F.expr(x) for c, x in made.items()})


RESULT = ("author", "book_title", "chapter_name", "file_path", "group", "page_number", "pdf_url", "priority", "category_priority", "snippet", "distance")


def _tier(rows: DataFrame, category: int, distance: Column, ordinal: Column, query: str, least: int, kind: str | None = "lines") -> DataFrame:
    """A tier's rows with their constant columns and their snippet, which has to be long enough."""
    found = rows.withColumn("category_priority", F.lit(category)).withColumn("distance", distance).withColumn("ord", ordinal.cast("bigint"))
    if kind:
        found = found.withColumn("snippet", TX.snippet(F.col("snippet"), query, kind))
    return with_defaults(found.filter(F.length("snippet") >= least)).select("idx", *RESULT, "ord")


def exact_match(chunks: DataFrame, query: str, filters: dict | None = None, min_snippet: int = 10, kind: str | None = "lines") -> DataFrame:
    """Q1: rows that hold the normalised query, in tier 1."""
    rows = P.apply_filters(chunks, P.used_filters(filters)).filter(F.col("snippet").isNotNull())
    return _tier(with_prepared(rows).filter(P.exact_phrase(F.col("snippet_norm"), TX.prepare(query))), EXACT, F.lit(0.0), F.col("idx"), query, min_snippet, kind)


def all_words_match(chunks: DataFrame, query: str, filters: dict | None = None, min_snippet: int = 10, exclude: DataFrame | None = None, substrings: bool = False, kind: str | None = "lines") -> DataFrame:
    """Q2: rows with all words of the query, in tier 3, without the rows of ``exclude``."""
    words = list(dict.fromkeys(TX.prepare(query).split()))
    rows = with_prepared(P.apply_filters(chunks, P.used_filters(filters)).filter(F.col("snippet").isNotNull()))
    rows = rows.filter(P.all_substrings(F.col("snippet_norm"), words) if substrings else P.all_words(F.col("tokens"), words))
    if exclude is not None:
        rows = rows.join(exclude.select("idx").distinct(), "idx", "left_anti")
    return _tier(rows, ALL_WORDS, F.lit(0.1), F.col("idx"), " ".join(words), min_snippet, kind)


def _accepted(flagged: DataFrame, query: str, words: list[str], least: int, kind: str | None) -> DataFrame:
    """The tier that accepts each row, if any, and the snippet it shows there. A snippet for all words is made only where the
    one for the phrase doesn't serve, and where both read alike there is one."""
    text, joined = F.col("snippet"), " ".join(words)
    make = (lambda c, q: TX.snippet(c, q, kind)) if kind else (lambda c, q: c)
    if not kind or TX.prepare(query) == joined:
        cut = flagged.withColumn("__snippet", make(F.when(F.col("__exact") | F.col("__words"), text), joined))
        long = F.length("__snippet") >= least
        return cut.withColumn("category_priority", F.when(F.col("__exact") & long, EXACT).when(F.col("__words") & long, ALL_WORDS))
    cut = flagged.withColumn("__s1", make(F.when(F.col("__exact"), text), query))
    exact = F.coalesce(F.length("__s1") >= least, F.lit(False))
    cut = cut.withColumn("__s3", make(F.when(F.col("__words") & ~exact, text), joined))
    return cut.withColumn("category_priority", F.when(exact, EXACT).when(F.length("__s3") >= least, ALL_WORDS)).withColumn("__snippet", F.when(exact, F.col("__s1")).otherwise(F.col("__s3")))


def _lexical(rows: DataFrame, query: str, least: int, kind: str | None) -> DataFrame:
    """Tiers 1 and 3, disjoint. Rows that match nothing are gone before a snippet is made."""
    words = list(dict.fromkeys(TX.prepare(query).split()))
    prepared = with_prepared(rows)
    phrase, every = P.exact_phrase(F.col("snippet_norm"), TX.prepare(query)), P.all_words(F.col("tokens"), words)
    # All words as substrings first: that is cheap, holds of both tiers, and spares most rows the look at their tokens.
    flagged = prepared.filter(P.all_substrings(F.col("snippet_norm"), words)).filter(phrase | every).withColumn("__exact", phrase).withColumn("__words", every)
    found = _accepted(flagged, query, words, least, kind).filter(F.col("category_priority").isNotNull())
    found = found.withColumn("snippet", F.col("__snippet")).withColumn("distance", F.when(F.col("category_priority") == EXACT, 0.0).otherwise(0.1)).withColumn("ord", F.col("idx").cast("bigint"))
    return with_defaults(found).select("idx", *RESULT, "ord")


def _ranked(hits: DataFrame, metric: str) -> DataFrame:
    """The hits, at most overfetch * top_k, with their place in the order of their scores."""
    key = F.col("score") if metric == "l2" else -F.col("score")
    whole = hits.agg(F.array_sort(F.collect_list(F.struct(key.alias("key"), "idx", "score"))).alias("hits"))
    return whole.select(F.posexplode("hits").alias("place", "hit")).select("hit.idx", "hit.score", "place")


def semantic_match(chunks: DataFrame, vectors: DataFrame, query: str, query_vector, top_k: int, filters: dict | None = None, min_snippet: int = 10, exclude: DataFrame | None = None, overfetch: int | None = V.OVERFETCH, metric: str = "ip", kind: str | None = "lines", without_lexical: bool = False) -> DataFrame:
    """Q3, V9: the best ``overfetch`` * top_k of all vectors, then exclusion, join (F10, J2), filters and snippet, then the
    first top_k by similarity. With ``overfetch`` None the filters come first and nothing is cut (V10). ``without_lexical``
    leaves out rows that the lexical tiers accept, by looking at the few hits themselves instead of joining those tiers."""
    if overfetch is None:
        kept = P.apply_filters(chunks, P.used_filters(filters))
        hits = V.scored(vectors.join(kept.select("idx"), "idx", "left_semi"), query_vector, metric).select("idx", "score")
    else:
        hits = V.knn(vectors, query_vector, top_k * overfetch, metric)
    if exclude is not None:
        hits = hits.join(exclude.select("idx").distinct(), "idx", "left_anti")
    if overfetch is not None:
        hits = _ranked(hits, metric)
    rows = P.apply_filters(chunks.filter(F.col("snippet").isNotNull()).join(hits, "idx"), P.used_filters(filters))
    if without_lexical:
        words = list(dict.fromkeys(TX.prepare(query).split()))
        # With the score in its input, the normalisation stays above the join: it sees the few hits instead of every chunk.
        prepared = with_prepared(rows.withColumn("snippet", F.when(F.col("score").isNotNull(), F.col("snippet"))))
        flagged = prepared.withColumn("__exact", P.exact_phrase(F.col("snippet_norm"), TX.prepare(query))).withColumn("__words", P.all_words(F.col("tokens"), words))
        rows = _accepted(flagged, query, words, min_snippet, kind).filter(F.col("category_priority").isNull()).select(*rows.columns)
    tier = _tier(rows, SEMANTIC, F.col("score"), F.col("place") if overfetch is not None else F.col("idx"), query, min_snippet, kind)
    return tier.orderBy("ord").limit(top_k) if overfetch is not None else tier


def search(chunks: DataFrame, vectors: DataFrame, request: Request, query_vector=None, *, promote: bool = False, metric: str = "ip", kind: str | None = "lines", order: str | None = None, keep_ids: bool = False) -> DataFrame:
    """Q4: the ordered results of a request, at most top_k; an unknown search type has none. ``promote`` puts rows with all
    words that are also near into tier 2 (J4); ``order`` names another order of ``tier_order`` (Q5, Q6: 'l2'). Mode 'all'
    keeps idx and ord, which pages are cut by; the others drop them (F19) unless ``keep_ids``."""
    mode, k = request.search_type, request.top_k
    gone = () if keep_ids else ("idx", "ord")
    if mode not in SEARCH_TYPES:
        return exact_match(chunks.filter(F.lit(False)), request.query, kind=None).drop(*gone)
    order = R.tier_order(order or ("l2" if metric == "l2" and mode in ("all", "semantic") else mode))
    if mode == "exact":
        return R.top_k(exact_match(chunks, request.query, request.filters, request.min_snippet, kind), k, order).drop(*gone)
    if mode == "all_words":
        return R.top_k(all_words_match(chunks, request.query, request.filters, request.min_snippet, kind=kind), k, order).drop(*gone)
    vector = query_vector if query_vector is not None else V.query_embedding(request.query)
    near = semantic_match(chunks, vectors, request.query, vector, k, request.filters, request.min_snippet, metric=metric, kind=kind, without_lexical=mode == "all")
    if mode == "semantic":
        return R.top_k(near, k, order).drop(*gone)
    # One pass over the chunks for both lexical tiers; the vectors are another, and only their best meet the chunks again.
    rows = P.apply_filters(chunks, request.filters).filter(F.col("snippet").isNotNull())
    lexical = _lexical(rows, request.query, request.min_snippet, kind)
    if promote:
        hits = V.knn(vectors, vector, k * V.OVERFETCH, metric).select("idx", "score")
        near_too = (F.col("category_priority") == ALL_WORDS) & F.col("score").isNotNull()
        promoted = lexical.join(hits, "idx", "left").withColumn("distance", F.when(near_too, F.col("score")).otherwise(F.col("distance"))).withColumn("category_priority", F.when(near_too, PROMOTED).otherwise(F.col("category_priority")))
        lexical = promoted.select(lexical.columns)
    return R.top_k(lexical.unionByName(near), k, order)


def legacy_search(chunks: DataFrame, vectors: DataFrame, query: str, query_vector, top_k: int = 10, filters: dict | None = None, mode: str = "both", overfetch: int = 3) -> DataFrame:
    """Q9: plain lower-case phrases, over-fetched neighbours up to the quota (O9), one row for each snippet (A12), lower
    priority numbers first (O4)."""
    rows = P.apply_filters(chunks.filter(F.col("snippet").isNotNull()), P.used_filters(filters)).withColumn("priority", F.coalesce("priority", F.lit(999)))
    exact = rows.filter(P.exact_phrase_plain(F.col("snippet"), query)).select("idx", "snippet", "priority", F.lit(0.0).alias("distance"), F.lit(0).alias("part"))
    hits = V.knn(vectors, query_vector, top_k * overfetch)
    near = rows.join(hits, "idx").select("idx", "snippet", "priority", F.col("score").alias("distance"), F.lit(1).alias("part"))
    if mode == "exact":
        found = exact
    elif mode == "similarity":
        found = near.orderBy(F.desc("distance"), "idx").limit(top_k)
    else:
        taken = exact.limit(top_k).count()
        found = exact.unionByName(R.quota_stop(near, top_k, taken, [F.desc("distance"), F.asc("idx")]))
    first = R.keep_first(found, "snippet", [F.asc("part"), F.asc("priority"), F.asc("distance"), F.asc("idx")])
    return R.top_k(first, top_k, [F.asc("priority"), F.asc("distance"), F.asc("idx")])


def quota_search(chunks: DataFrame, vectors: DataFrame, query: str, query_vector, top_k: int, filters: dict | None = None, min_snippet: int = 20) -> DataFrame:
    """Q7: exact rows first, then rows with all words as substrings, then neighbours by similarity, until top_k is full."""
    exact = exact_match(chunks, query, filters, min_snippet, None)
    words = all_words_match(chunks, query, filters, min_snippet, exact, substrings=True, kind=None)
    near = semantic_match(chunks, vectors, query, query_vector, top_k, filters, min_snippet, exact.unionByName(words), overfetch=1, kind=None)
    return R.quota_fill([exact, words, near], top_k, [F.asc("ord")])


def union_search(chunks: DataFrame, vectors: DataFrame, query: str, query_vector, top_k: int, filters: dict | None = None) -> DataFrame:
    """Q8, SO2: exact rows and neighbours side by side, overlap and all."""
    exact = exact_match(chunks, query, filters, 0, None)
    return exact.unionByName(semantic_match(chunks, vectors, query, query_vector, top_k, filters, 0, overfetch=1, kind=None))


def tier_counts(results: DataFrame) -> DataFrame:
    """A9."""
    return results.groupBy("category_priority").agg(F.count("*").alias("n"))
