"""The request surface: parameters as they come from a client, to results as they go back."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, Window, functions as F

from ..operators import dimensions as D
from ..operators.ranking import tier_order
from ..operators.search import SEARCH_TYPES, Request, search
from ..sources.sinks import as_json, envelope

log = logging.getLogger(__name__)  # K9: where it goes is the application's affair

DEFAULT_TOP_K = 100


def parse_request(params: dict[str, str | None]) -> Request:
    """Q10, Q20, F16: the request of a client's parameters; what is wrong with it is a ValueError."""
    raw = params.get("top_k")
    try:
        top_k = DEFAULT_TOP_K if raw in (None, "") else int(raw)
    except (TypeError, ValueError):
        raise ValueError("top_k must be an integer of at least 1") from None
    return Request(params.get("query") or "", top_k, params.get("search_type") or "all", {k: params.get(k) for k in ("author", "group", "book_title")})


def get_search(chunks: DataFrame, vectors: DataFrame, params: dict[str, str | None], query_vector=None) -> DataFrame:
    """Q10, K8: results as JSON objects."""
    found = search(chunks, vectors, parse_request(params), query_vector)
    return as_json(found.drop("idx", "ord"))


def get_response(chunks: DataFrame, vectors: DataFrame, params: dict[str, str | None], query_vector=None) -> DataFrame:
    """Q10, K8: the whole response as one JSON object, {"results": [...]}: at most top_k results, in their order."""
    request = parse_request(params)
    log.info("search %r, %s, filters %s", request.query, request.search_type, request.filters)
    found = search(chunks, vectors, request, query_vector, keep_ids=True)
    order = tier_order(request.search_type if request.search_type in SEARCH_TYPES else "all")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))  # top_k rows at most
    return envelope(ranked.drop("idx", "ord"))


def get_filters(books: DataFrame) -> DataFrame:
    """Q11."""
    return as_json(D.facets(books))


def toggle_mode(current: str, clicked: str) -> str:
    """Q21: choosing the chosen mode again goes back to all."""
    return "all" if current == clicked else clicked
