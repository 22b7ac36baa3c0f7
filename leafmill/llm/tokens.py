"""Encoding a corpus with a public byte-level tokenizer, each distinct word once.

Documents are cut into pre-tokens by the tokenizer's own pattern. A block of documents lists its distinct words and,
for every document, the positions as indexes into that list. The distinct words of all blocks meet in one shuffle and
are encoded once each; their ids go back to the blocks, which put them together by position. A word that stands in
every document crosses the network once a block, never once an occurrence.

Defined results: a null or empty text has an empty list of ids; text that looks like a special token is ordinary text;
rows with the same or a null id are encoded each for itself; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import itertools
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from ..sources.scratch import materialize

#: Where the vocabulary files lie; every function takes the path as a parameter.
TOKENIZER_DIR = "/opt/tokenizers"
DEFAULT_RANKS = f"{TOKENIZER_DIR}/byte_bpe_50k.tiktoken"
#: Fixed value: the pre-token pattern published with the byte-level vocabularies.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters of a block, unless a single document has more.
BLOCK_CHARS = 4_000_000


@lru_cache(maxsize=2)
def _ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


@lru_cache(maxsize=2)
def _encoder(path: str):
    import tiktoken

    return tiktoken.Encoding(os.path.basename(path), pat_str=PRE_TOKEN, mergeable_ranks=_ranks(path), special_tokens={})


@lru_cache(maxsize=1)
def _splitter():
    """The pre-token pattern with its commonest case first and no backtracking into runs; its matches are the same."""
    import regex

    return regex.compile(r" ?\p{L}++|'(?:s|t|re|ve|m|ll|d)| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s+(?!\S)|\s+").findall


def _block_rows(block: int, ids: list, texts: list) -> tuple[list, list]:
    """The rows of one block: its distinct words with their index, and one row with every document's indexes."""
    split = _splitter()
    found = [split(text) if text else [] for text in texts]
    coded = pa.array(itertools.chain.from_iterable(found), type=pa.string()).dictionary_encode()
    words = [(block, k, w, None, None, None) for k, w in enumerate(coded.dictionary.to_pylist())]
    return words, [(block, None, None, ids, [len(x) for x in found], coded.indices.to_numpy().astype(np.int32).tobytes())]


def _blocks(block_chars: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 32
        counter = itertools.count()
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            start, size = 0, 0
            for i, text in enumerate(texts):
                size += len(text) if text else 0
                if size >= block_chars or i == len(texts) - 1:
                    words, docs = _block_rows(base | next(counter), ids[start : i + 1], texts[start : i + 1])
                    start, size = i + 1, 0
                    for rows in (words, docs):
                        if rows:
                            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return run


def _encode_words(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(path).encode_ordinary
        for batch in batches:
            ids = [encode(w) for w in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, type=pa.list_(pa.int32()))], names=["word", "ids"])

    return run


def _assemble(id_type: pa.DataType, counts: bool):
    value = pa.int64() if counts else pa.list_(pa.int32())
    out = pa.schema([("__id", id_type), ("__value", value)])

    def run(group: pa.Table) -> pa.Table:
        is_word = group.column("k").is_valid()
        words = group.filter(is_word).combine_chunks()
        docs = group.filter(group.column("doc_ids").is_valid()).combine_chunks()
        lists = words.column("ids").combine_chunks() if words.num_rows else pa.array([], pa.list_(pa.int32()))
        if isinstance(lists, pa.ChunkedArray):
            lists = pa.concat_arrays(lists.chunks) if lists.num_chunks else pa.array([], pa.list_(pa.int32()))
        order = np.argsort(words.column("k").to_numpy()) if words.num_rows else np.empty(0, np.int64)
        flat, offsets = lists.flatten().to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
        offsets = offsets - (offsets[0] if len(offsets) else 0)
        starts, sizes = offsets[:-1][order], np.diff(offsets)[order]
        ids_out, arrays = [], []
        for ids, lengths, positions in zip(docs.column("doc_ids").to_pylist(), docs.column("lengths").to_pylist(), docs.column("positions").to_pylist()):
            seq = np.frombuffer(positions, dtype=np.int32)
            per_word = sizes[seq] if len(seq) else np.empty(0, np.int64)
            ends = np.concatenate([[0], np.cumsum(per_word)]).astype(np.int64)
            bounds = ends[np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)]
            ids_out.extend(ids)
            if counts:
                arrays.append(pa.array(np.diff(bounds), type=pa.int64()))
            else:
                where = np.repeat(starts[seq] - ends[:-1], per_word) + np.arange(ends[-1]) if len(seq) else np.empty(0, np.int64)
                arrays.append(pa.ListArray.from_arrays(pa.array(bounds, type=pa.int32()), pa.array(flat[where] if len(where) else np.empty(0, np.int32), type=pa.int32())))
        values = pa.concat_arrays(arrays) if arrays else pa.array([], type=value)
        return pa.Table.from_arrays([pa.array(ids_out, type=id_type), values], schema=out)

    return run


def _encoded(docs: DataFrame, id_col: str, text_col: str, ranks: str, block_chars: int, counts: bool) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_type

    id_type = docs.schema[id_col].dataType
    schema = T.StructType(
        [T.StructField("block", T.LongType()), T.StructField("k", T.IntegerType()), T.StructField("word", T.StringType()), T.StructField("doc_ids", T.ArrayType(id_type)), T.StructField("lengths", T.ArrayType(T.IntegerType())), T.StructField("positions", T.BinaryType())]
    )
    arrow = pa.schema([("block", pa.int64()), ("k", pa.int32()), ("word", pa.string()), ("doc_ids", pa.list_(to_arrow_type(id_type))), ("lengths", pa.list_(pa.int32())), ("positions", pa.binary())])
    blocks = materialize(docs.select(F.col(id_col), F.col(text_col)).mapInArrow(_blocks(block_chars, arrow), schema), "token-blocks")
    words = blocks.filter("k IS NOT NULL").select("block", "k", "word")
    table = words.select("word").distinct().mapInArrow(_encode_words(ranks), "word string, ids array<int>")
    back = words.join(table, "word").select("block", "k", "ids", F.lit(None).cast(schema["doc_ids"].dataType).alias("doc_ids"), F.lit(None).cast("array<int>").alias("lengths"), F.lit(None).cast("binary").alias("positions"))
    payload = blocks.filter("k IS NULL").select("block", F.lit(None).cast("int").alias("k"), F.lit(None).cast("array<int>").alias("ids"), "doc_ids", "lengths", "positions")
    out = T.StructType([T.StructField("__id", id_type), T.StructField("__value", T.LongType() if counts else T.ArrayType(T.IntegerType()))])
    return back.unionByName(payload).groupBy("block").applyInArrow(_assemble(to_arrow_type(id_type), counts), out)


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, ranks: str = DEFAULT_RANKS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(id_col, ids): the ids of every row's text, without special tokens; ``[]`` for null and empty texts."""
    return _encoded(docs, id_col, text_col, ranks, block_chars, False).select(F.col("__id").alias(id_col), F.col("__value").alias("ids"))


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, ranks: str = DEFAULT_RANKS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(id_col, n_tokens): the length of what ``encode`` gives; only lengths are moved."""
    return _encoded(docs, id_col, text_col, ranks, block_chars, True).select(F.col("__id").alias(id_col), F.col("__value").alias("n_tokens"))


@lru_cache(maxsize=2)
def _bytes_by_id(path: str) -> pa.Array:
    """The token-byte table as an array: the bytes of id i at place i, and none at the last place, for ids it doesn't have."""
    ranks = _ranks(path)
    table: list[bytes] = [b""] * (max(ranks.values(), default=-1) + 2)
    for token, rank in ranks.items():
        table[rank] = token
    return pa.array(table, pa.binary())


def _decode(path: str, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _bytes_by_id(path)
        for batch in batches:
            lists = batch.column(1)
            flat = pc.fill_null(lists.flatten(), -1).to_numpy(zero_copy_only=False)
            known = np.where((flat >= 0) & (flat < len(table) - 1), flat, len(table) - 1).astype(np.int64)
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
            whole = pc.binary_join(pa.ListArray.from_arrays(offsets, table.take(pa.array(known))), b"")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([b.decode("utf-8", "replace") for b in whole.to_pylist()], pa.string())], schema=schema)

    return run


def decode(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", *, ranks: str = DEFAULT_RANKS) -> DataFrame:
    """(id_col, text): every row's ids joined with the token-byte table, in their order; '' for an empty or null list.

    The table is as large as the vocabulary and lies whole beside every task, so the join moves no row. Ids that the
    vocabulary doesn't have give no bytes; bytes that are no UTF-8 become U+FFFD.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    out = T.StructType([T.StructField(id_col, encoded.schema[id_col].dataType), T.StructField("text", T.StringType())])
    return encoded.select(id_col, F.col(ids_col).cast("array<int>").alias("__ids")).mapInArrow(_decode(ranks, to_arrow_schema(out)), out)
