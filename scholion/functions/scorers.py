"""Pluggable models as vectorised functions, with deterministic stand-ins that need no model files."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from scholion.functions.text import overlap_ratio

Embedder = Callable[[list[str]], np.ndarray]
Reranker = Callable[[list[str], list[str]], np.ndarray]


def hashing_embedder(size: int = 64) -> Embedder:
    """Signed feature hashing of words, of length 1: a stand-in for an embedding model."""

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), size))
        for i, t in enumerate(texts):
            for w in (t or "").lower().split():
                h = zlib.crc32(w.encode())
                out[i, h % size] += 1 if h >> 31 else -1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    return embed


def embedding(text: Column | str, load: Callable[[], Embedder] = hashing_embedder, prefix: str = "", batch: int = 32) -> Column:
    """Vectors of a text column; ``load`` is called once a Python worker and gives the model."""

    @F.pandas_udf("array<float>")
    def embed(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for s in texts:
            parts = [model([prefix + (t or "") for t in s.iloc[i : i + batch]]) for i in range(0, len(s), batch)]
            yield pd.Series([v.astype(np.float32) for p in parts for v in p])

    return embed(text)


def paper_text(title: Column, abstract: Column, most: int = 6000) -> Column:
    """Text of a paper to be embedded; the three templates in use are made one (titles and abstracts trimmed, null ones empty)."""
    part = lambda c: F.trim(F.coalesce(c, F.lit("")))
    return F.substring(F.trim(F.concat(F.lit("Title: "), part(title), F.lit("\n\nAbstract: "), part(abstract))), 1, most)


def chunk_text(section: Column, text: Column) -> Column:
    """Text of a chunk to be embedded: under its section's title, if it has one."""
    return F.when(F.coalesce(section, F.lit("")) != "", F.concat(F.lit("Section: "), section, F.lit("\n\n"), text)).otherwise(text)


def rerank_score(query: Column | str, text: Column | str, load: Callable[[], Reranker] | None = None, batch: int = 16) -> Column:
    """Relevance of a text to a query by a model; without one, the share of the query's tokens in the text, which stays in generated code."""
    if load is None:
        return overlap_ratio(query, text)

    @F.pandas_udf("double")
    def rank(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = load()
        for q, t in pairs:
            yield pd.Series(np.concatenate([model(list(q.iloc[i : i + batch]), list(t.iloc[i : i + batch])) for i in range(0, len(q), batch)]) if len(q) else [], dtype="float64")

    return rank(query, text)


def tag_scores(logits: Column) -> Column:
    """Softmax of each tag's logit pairs (templates x [no, yes]) averaged over the templates, in per cent, rounded to 2."""
    yes = F.transform(logits, lambda t: F.exp(t[1]) / (F.exp(t[0]) + F.exp(t[1])))
    return F.bround(100.0 * F.aggregate(yes, F.lit(0.0), lambda s, x: s + x) / F.size(yes), 2)


def best_tags(tags: Column, least: float = 50.0, most: int = 3) -> Column:
    """Up to ``most`` tags (name, score) of at least ``least``, best first, ties by name."""
    kept = F.filter(tags, lambda t: t["score"] >= least)
    ordered = F.array_sort(kept, lambda a, b: F.when(a["score"] > b["score"], -1).when(a["score"] < b["score"], 1).when(a["name"] < b["name"], -1).when(a["name"] > b["name"], 1).otherwise(0))
    return F.slice(ordered, 1, most)
