"""Counting of tokens: the public word-punctuation pattern, or a public tokenizer's file given by path."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = re.compile(r"\w+|[^\w\s]+")


def token_count(column: Column | str) -> Column:
    """Number of word-punctuation tokens of a text; 0 for null and blank ones. Vectorised over Arrow batches."""

    @F.pandas_udf("long")
    def count(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            yield s.map(lambda t: 0 if t is None else len(TOKEN.findall(t))).astype("int64")

    return count(column)


def file_token_count(column: Column | str, tokenizer_file: str) -> Column:
    """Number of tokens by a public tokenizer's ``.json`` file; the file must be readable at the same path on every executor."""

    @F.pandas_udf("long")
    def count(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(tokenizer_file)
        tok.encode_special_tokens = True
        for s in texts:
            yield pd.Series([len(e.ids) for e in tok.encode_batch([t or "" for t in s], add_special_tokens=False)], dtype="int64")

    return count(column)


Counter = Callable[[Column | str], Column]
