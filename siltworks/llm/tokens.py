"""Sizes of texts in tokens of a public tokenizer, whose vocabulary file is a parameter."""

from __future__ import annotations

import base64
from collections.abc import Iterator, Sequence
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how byte-level BPE splits a text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def encoder(vocabulary: str):
    """The tokenizer, loaded once per worker process."""
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_count(text: Column, vocabulary: str = DEFAULT_VOCABULARY) -> Column:
    """The number of tokens of each text; null for null, 0 for an empty text."""

    @F.pandas_udf("int")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = encoder(vocabulary)
        for s in batches:
            yield pd.Series([None if t is None else len(enc.encode_ordinary(t)) for t in s], dtype="Int32")

    return count(text)


def piece_sizes(text: Column, capacities: Sequence[int], vocabulary: str = DEFAULT_VOCABULARY) -> Column:
    """Per capacity the sizes in tokens of the pieces of a text: one piece unless it exceeds the capacity.

    A cut falls on the last token border within the capacity at which a character begins, so no character is
    split (unless a single character is larger than the capacity). Null for null, one piece of 0 for ''.
    """

    @F.pandas_udf("array<array<int>>")
    def sizes(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = encoder(vocabulary)
        for s in batches:
            yield pd.Series([None if t is None else _pieces(enc, t, capacities) for t in s], dtype=object)

    return sizes(text)


def _pieces(enc, text: str, capacities: Sequence[int]) -> list[list[int]]:
    ids = enc.encode_ordinary(text)
    n = len(ids)
    if n <= min(capacities):
        return [[n]] * len(capacities)
    inside = set() if text.isascii() else {i for i, b in enumerate(enc.decode_tokens_bytes(ids)) if 0x80 <= b[0] < 0xC0}
    return [_cut(n, c, inside) for c in capacities]


def _cut(n: int, capacity: int, inside: set[int]) -> list[int]:
    out, start = [], 0
    while n - start > capacity:
        end = next((e for e in range(start + capacity, start, -1) if e not in inside), start + capacity)
        out.append(end - start)
        start = end
    return [*out, n - start]
