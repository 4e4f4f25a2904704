"""Token counts of texts with a public subword tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Folder and file of the default vocabulary; both are parameters of every operator that counts tokens.
FOLDER, FILE = "/opt/tokenizers", "byte_bpe_50k.tiktoken"
#: The split before the merges that the vocabulary was made with: a fixed value.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_KNOWN: dict[str, object] = {}


def encoder(path: str):
    """The encoding of a rank file, made once per process."""
    if path not in _KNOWN:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines)}
        _KNOWN[path] = tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
    return _KNOWN[path]


class Counter:
    """Tokens per text; 0 for null."""

    def __init__(self, path: str) -> None:
        self.encode = encoder(path).encode_ordinary

    def count(self, text: str | None) -> int:
        return len(self.encode(text)) if text else 0


def token_count(column: Column, folder: str = FOLDER, file: str = FILE) -> Column:
    """Number of tokens of a text; 0 for null and empty texts."""
    path = f"{folder}/{file}"

    def counts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = Counter(path)
        for texts in batches:
            yield pd.Series([counter.count(x) for x in texts], dtype="int64")

    return F.pandas_udf(counts, "long")(column)
