"""Encoding against a second library with the same vocabulary, and exact round trips."""

import base64
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

encode = pytest.importorskip("evalspark.llm.encode")

TEXTS = ["", None, "plain words", "<|endoftext|> is text", "é😀👩‍💻 Größe \x07\x1b[0m", "\r\n\t  x", "次の実行", "a" * 3000, "﻿{}", "plain words"]


@pytest.fixture(scope="module")
def other():
    tiktoken = pytest.importorskip("tiktoken")
    public = pytest.importorskip("public_tokenizers")
    with open(f"{encode.VOCABULARIES}/byte_bpe_50k.tiktoken", "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("other", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids_equal_the_other_library(spark, other):
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(TEXTS)], "doc_id bigint, text string, ids string")
    found = {r.doc_id: r.ids for r in encode.encode(df).collect()}
    assert found == {i: other.encode_ordinary(t or "") for i, t in enumerate(TEXTS)}
    assert encode.encode(df.limit(0)).count() == 0
    back = {r.doc_id: r.text for r in encode.decode(encode.encode(df)).collect()}
    assert back == {i: t or "" for i, t in enumerate(TEXTS)}


def test_round_trips_and_split_characters(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string")
    rows = {r.doc_id: r for r in encode.round_trips(df).collect()}
    assert all(r.exact for r in rows.values()) and rows[4].n_split > 0 and rows[2].n_split == 0 and rows[1].n_tokens == 0


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=40))
def test_spans_cover_the_text(text):
    ids = next((found for rows, found in encode.encode_texts([text]) if rows and found is not None), [])
    assert encode.decode_ids(ids) == text
    start, end = encode.spans(ids)
    assert len(start) == len(ids)
    if ids:
        assert start[0] == 0 and end[-1] == len(text) and (start[1:] <= end[:-1]).all() and (start[1:] >= end[:-1] - 1).all()


def test_cut_lists_decode_to_a_mark():
    ids = next(f for r, f in encode.encode_texts(["😀"]) if r and f)
    assert "�" in encode.decode_ids(ids[:1])


def test_calls_are_bounded():
    texts = [("w " * random.Random(1).randint(1, 9)) for _ in range(50)]
    assert [t for some in encode.calls(texts) for t in some] == texts
