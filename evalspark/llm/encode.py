"""Encoding of whole corpora with the public byte-level tokenizer, and the way back.

Texts go through the tokenizers library an Arrow batch at a time, each distinct text of a batch once. The
library's vocabulary spells every byte as a printable character; `byte_alphabet` is that table by its rule, and
decoding reverses it: the bytes of all tokens are joined before UTF-8 is read, so a character that is split over
several tokens comes back whole.
"""

from __future__ import annotations

import functools
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from evalspark.shared import spread

VOCABULARIES = os.environ.get("PUBLIC_TOKENIZERS", "/opt/tokenizers")
NAME = "byte_bpe_50k"
# One call to the library holds about this many characters, so that a batch of long texts stays small in memory.
CALL_CHARS = 2_000_000


@functools.cache
def byte_alphabet() -> dict[str, int]:
    """The character that spells each byte, reversed: printable bytes spell themselves, the others follow from U+0100."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(0x100 + i): b for i, b in enumerate(rest)}


@functools.cache
def tokenizer(folder: str, name: str = NAME):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(f"{folder}/{name}.json")
    found.encode_special_tokens = True
    return found


@functools.cache
def token_bytes(folder: str, name: str = NAME) -> list[bytes]:
    """The bytes of every id; the special token spells itself."""
    with open(f"{folder}/{name}.json", encoding="utf-8") as file:
        loaded = json.load(file)
    table, alphabet = {}, byte_alphabet()
    for token, i in loaded["model"]["vocab"].items():
        table[i] = bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode()
    for token in loaded.get("added_tokens", []):
        table[token["id"]] = token["content"].encode()
    return [table.get(i, b"") for i in range(max(table) + 1)]


def calls(texts: list[str]) -> Iterator[list[str]]:
    some, size = [], 0
    for text in texts:
        some.append(text)
        size += len(text)
        if size >= CALL_CHARS:
            yield some
            some, size = [], 0
    if some:
        yield some


def encode_texts(texts: list[str | None], folder: str = VOCABULARIES, name: str = NAME) -> Iterator[tuple[list[int], list]]:
    """(indices of rows, their ids) call by call; a null and an empty text have no ids."""
    rows: dict[str, list[int]] = {}
    for i, text in enumerate(texts):
        rows.setdefault(text or "", []).append(i)
    yield rows.pop("", []), None
    tok = tokenizer(folder, name)
    for some in calls(list(rows)):
        for text, found in zip(some, tok.encode_batch(some, add_special_tokens=False), strict=True):
            yield rows[text], found.ids


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", folder: str = VOCABULARIES, name: str = NAME) -> DataFrame:
    """(key, ids) of every row, without special tokens; their strings in a text are ordinary text.

    A null text and an empty text give an empty list. Other columns aren't read.
    """

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text).to_pylist()
            ids: list = [()] * len(texts)
            for rows, found in encode_texts(texts, folder, name):
                found = np.asarray(found if found is not None else [], np.int32)
                for row in rows:
                    ids[row] = found
            sizes = np.cumsum([0, *map(len, ids)])
            flat = np.concatenate([np.asarray(x, np.int32) for x in ids]) if ids else np.empty(0, np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(flat, pa.int32()))], [key, "ids"])

    return spread(df.select(key, text)).mapInArrow(convert, f"{key} bigint, ids array<int>")


def count_tokens(df: DataFrame, keep: str, text: str = "text", folder: str = VOCABULARIES, name: str = NAME) -> DataFrame:
    """The columns `keep` (comma-separated) with n_tokens of each row."""
    columns = [c.strip() for c in keep.split(",")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*columns).schema) + ", n_tokens bigint"

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.zeros(batch.num_rows, np.int64)
            for rows, found in encode_texts(batch.column(text).to_pylist(), folder, name):
                sizes[rows] = len(found) if found is not None else 0
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(sizes)], [*columns, "n_tokens"])

    return spread(df.select(*columns, text)).mapInArrow(convert, schema)


def decode_ids(ids: list[int], folder: str = VOCABULARIES, name: str = NAME) -> str:
    """The text of a list of ids; bytes that are no UTF-8 (a cut list) become U+FFFD."""
    table = token_bytes(folder, name)
    return b"".join(table[i] for i in ids).decode("utf-8", "replace")


def decode(df: DataFrame, key: str = "doc_id", folder: str = VOCABULARIES, name: str = NAME) -> DataFrame:
    """(key, text) from (key, ids); null ids give a null text, an empty list an empty one."""

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if ids is None else decode_ids(ids, folder, name) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(texts, pa.string())], [key, "text"])

    return df.select(key, "ids").mapInArrow(convert, f"{key} bigint, text string")


def spans(ids: list[int], folder: str = VOCABULARIES, name: str = NAME) -> tuple[np.ndarray, np.ndarray]:
    """For each token the characters [start, end) it touches; tokens that share a split character overlap in it."""
    table = token_bytes(folder, name)
    pieces = [table[i] for i in ids]
    data = np.frombuffer(b"".join(pieces), np.uint8)
    ends = np.cumsum([len(p) for p in pieces]) if pieces else np.empty(0, np.int64)
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    character = np.cumsum((data & 0xC0) != 0x80) - 1
    starts = np.concatenate(([0], ends[:-1]))
    return character[starts], character[ends - 1] + 1


def round_trips(df: DataFrame, key: str = "doc_id", text: str = "text", folder: str = VOCABULARIES, name: str = NAME) -> DataFrame:
    """(key, n_tokens, n_split, exact): tokens, tokens that begin inside a character, and whether decoding gives the text back."""

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text).to_pylist()
            out = [(0, 0, True)] * len(texts)
            for rows, found in encode_texts(texts, folder, name):
                if found is None or not rows:
                    continue
                start, end = spans(found, folder, name)
                split = int((start[1:] < end[:-1]).sum())
                for row in rows:
                    out[row] = (len(found), split, decode_ids(found, folder, name) == texts[row])
            columns = list(zip(*out, strict=True)) if out else [(), (), ()]
            types = (pa.int64(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(key), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], [key, "n_tokens", "n_split", "exact"])

    return spread(df.select(key, text)).mapInArrow(convert, f"{key} bigint, n_tokens bigint, n_split bigint, exact boolean")
