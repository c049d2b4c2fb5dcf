"""Splitting of oversized texts at natural boundaries by lexical cohesion.

The text is cut into units (sentences, else lines, else runs of tokens). At each gap between units the words of the blocks on either side
are compared; a valley of that similarity marks a change of topic. Within each size window the gap of the deepest valley is the cut, a
paragraph's end counting as deeper than a sentence's, and the next piece starts up to ``overlap`` tokens before it, at a sentence's start.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholion.llm.tokens import TOKEN
from scholion.tables import spread

LIMIT, OVERLAP = 600, 60
#: Tokens on either side of a gap whose words are compared; the share of the limit that a piece reaches before a cut is looked for.
BLOCK, LEAST = 80, 0.5
#: What the end of a paragraph and of a line add to the depth of a valley (similarities are between 0 and 1).
PARAGRAPH, LINE_PENALTY = 0.35, 0.5

_ABBREVIATION = re.compile(r"(?:\b(?:e\.g|i\.e|cf|al|Fig|Figs|Sect|Eq|vs|No|Vol|Dr|Prof|St|approx|ca|etc|resp|pp|p|Ref|Refs|Tab)|\b[A-Z])\.$")
_SENTENCE = re.compile(r"[.!?…。！？][\"'”’»)\]]*\s+(?=[\"'“‘«(\[¿¡]?[A-Z0-9À-ÖØ-ÞĀ-ſ¿¡一-鿿])")
_PARAGRAPH = re.compile(r"\n[ \t\r]*\n\s*")
_LINE = re.compile(r"\n")


def boundaries(text: str) -> dict[int, int]:
    """Character offsets at which a unit starts: 3 a paragraph, 2 a sentence, 1 a line."""
    at: dict[int, int] = {}
    for m in _LINE.finditer(text):
        at[m.end()] = 1
    for m in _SENTENCE.finditer(text):
        head = text[max(0, m.start() - 12) : m.start() + 1]
        if not (text[m.start()] == "." and _ABBREVIATION.search(head)):
            at[m.end()] = 2
    for m in _PARAGRAPH.finditer(text):
        at[m.end()] = 3
    return at


def valley_depths(words: list[str], gaps: list[int], block: int = BLOCK, reach: int = 2 * BLOCK) -> list[float]:
    """Depth of the similarity valley at each gap (token index): how far the peaks to its left and right, within ``reach`` tokens, rise above it."""
    left, right, sims = Counter(), Counter(), []
    lo = mid = hi = 0
    for g in gaps:
        while hi < min(len(words), g + block):
            right[words[hi]] += 1
            hi += 1
        while mid < g:
            w = words[mid]
            right[w] -= 1
            left[w] += 1
            mid += 1
        while lo < max(0, g - block):
            left[words[lo]] -= 1
            lo += 1
        dot = sum(n * right[w] for w, n in left.items() if n > 0)
        norm = math.sqrt(sum(n * n for n in left.values()) * sum(n * n for n in right.values()))
        sims.append(dot / norm if norm else 0.0)
    depths = []
    for i, s in enumerate(sims):
        peak_left = s
        for j in range(i - 1, -1, -1):
            if sims[j] < peak_left or gaps[j] < gaps[i] - reach:
                break
            peak_left = sims[j]
        peak_right = s
        for j in range(i + 1, len(sims)):
            if sims[j] < peak_right or gaps[j] > gaps[i] + reach:
                break
            peak_right = sims[j]
        depths.append((peak_left - s) + (peak_right - s))
    return depths


def split(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int]]:
    """Pieces of ``text`` as (start, end, tokens), each of at most ``limit`` tokens, together covering every token.

    Consecutive pieces share at most ``overlap`` tokens. A text within the limit is one piece, whole. Where no boundary lies in the window
    the cut falls between two tokens. Runs in time linear in the text but for the depth of valleys.
    """
    n = len(TOKEN.findall(text))
    if n <= limit:
        return [(0, len(text), n)]
    spans = [m.span() for m in TOKEN.finditer(text)]
    starts = [s for s, _ in spans]
    kinds: dict[int, int] = {}
    for at, kind in boundaries(text).items():
        k = bisect_left(starts, at)
        if 0 < k < n:
            kinds[k] = max(kind, kinds.get(k, 0))
    gaps = sorted(kinds)
    words = [text[a:b].lower() for a, b in spans]
    depth = dict(zip(gaps, valley_depths(words, gaps)))
    pieces, first, last = [], 0, 0
    while True:
        if n - first <= limit:
            pieces.append((first, n))
            break
        # every cut lies beyond the last one, so that no piece is part of the one before
        lo, hi = bisect_left(gaps, max(last + 1, first + max(1, int(limit * LEAST)))), bisect_right(gaps, first + limit)
        window = gaps[lo:hi] or gaps[bisect_right(gaps, max(last, first + overlap)) : hi]
        strong = [g for g in window if kinds[g] >= 2] or window
        cut = max(strong, key=lambda g: (depth[g] + PARAGRAPH * (kinds[g] == 3) - LINE_PENALTY * (kinds[g] == 1), g)) if strong else first + limit
        pieces.append((first, cut))
        last = cut
        back = gaps[bisect_left(gaps, max(cut - overlap, first + 1)) : bisect_left(gaps, cut)]
        back = [g for g in back if kinds[g] >= 2] or ([] if kinds.get(cut, 0) >= 2 else back)
        first = back[0] if back else cut if cut in kinds else max(first + 1, cut - overlap)
    return [(spans[a][0] if a else 0, spans[b - 1][1] if b < n else len(text), b - a) for a, b in pieces]


def split_texts(df: DataFrame, key: str, text: str, offset: str | None = None, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Pieces of every text: ``(key, piece, pieces, text, token_count, char_start, char_end)``.

    ``char_start`` and ``char_end`` count characters from ``offset`` (a column with the place of the text in its document; 0 where null).
    A null text gives no row; an empty or blank one gives one piece of no tokens. Repeated rows are split each. A text of any length is
    handled where it is read; there is no shuffle.
    """
    taken = df.select(F.col(key).alias("key"), F.col(text).alias("whole"), (F.coalesce(F.col(offset), F.lit(0)) if offset else F.lit(0)).cast("long").alias("base"))
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, whole, base in zip(b["key"], b["whole"], b["base"]):
                if whole is None:
                    continue
                parts = split(whole, limit, overlap)
                rows += [(k, i, len(parts), whole[s:e], t, base + s, base + e) for i, (s, e, t) in enumerate(parts)]
            yield pd.DataFrame(rows, columns=["key", "piece", "pieces", "text", "token_count", "char_start", "char_end"])

    out = spread(taken).mapInPandas(run, f"key {kind}, piece int, pieces int, text string, token_count int, char_start long, char_end long")
    return out.withColumnRenamed("key", key)


def split_chunks(chunks: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Every chunk's pieces with the ``section_title`` of the chunk (joined through the key that is unique to a row)."""
    taken = chunks.select("id", "text", "section_title", "char_start")
    packed = taken.select(F.struct("id", "section_title").alias("of"), "text", "char_start")
    out = split_texts(packed, "of", "text", "char_start", limit, overlap)
    return out.select("of.id", "piece", "pieces", "text", "token_count", "char_start", "char_end", "of.section_title")
