import random

import pytest
from pyspark.sql import functions as F

from leafmill.llm import tokens as T

SCHEMA = "doc_id bigint, text string, ids string, block int, word string"


def rows():
    texts = [None, "", " ", "Hello  world\n\n x", "<|endoftext|> is text", "naïve — café 你好", "a" * 20_000, "same", "same", "it's we'll\t\tdon't 12 345", "​﻿"]
    return [(i, t, "clash", 1, "clash") for i, t in enumerate(texts)]


def reference(text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return t.encode(text, add_special_tokens=False).ids if text else []


def test_ids_are_those_of_the_library(spark):
    got = {r["doc_id"]: r["ids"] for r in T.encode(spark.createDataFrame(rows(), SCHEMA)).collect()}
    assert got == {i: reference(t) for i, t, *_ in rows()}


def test_blocks_do_not_matter_and_decoding_comes_back(spark):
    random.seed(1)
    alphabet = "ab é\n\t你 'st0.9"
    texts = ["".join(random.choices(alphabet, k=random.randrange(60))) for _ in range(80)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    encoded = T.encode(docs, block_chars=50)
    assert {r["doc_id"]: r["ids"] for r in encoded.collect()} == {i: reference(t) for i, t in enumerate(texts)}
    assert {r["doc_id"]: r["text"] for r in T.decode(encoded).collect()} == dict(enumerate(texts))


def test_counts_nulls_and_repeats(spark):
    docs = spark.createDataFrame([(None, "one two"), (None, None), (5, "one"), (5, "one")], "doc_id bigint, text string")
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"]) for r in T.count_tokens(docs).collect())
    assert got == sorted([(True, 0, len(reference("one two"))), (True, 0, 0), (False, 5, 1), (False, 5, 1)])


def test_empty_table(spark):
    assert T.encode(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []
    got = T.decode(spark.createDataFrame([(1, []), (2, None), (None, [15496]), (3, [99_999, -1, 15496])], "doc_id bigint, ids array<int>")).collect()
    assert [r["text"] for r in got] == ["", "", "Hello", "Hello"]


def test_unknown_vocabulary_is_an_error(spark):
    with pytest.raises(Exception):
        T.encode(spark.createDataFrame([(1, "x")], "doc_id bigint, text string"), ranks="/nowhere").collect()
