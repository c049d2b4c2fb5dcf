"""Filling containers of fixed capacity with whole texts: lexical retrieval packing.

Texts are put in shards of bounded size in which related ones are near each other. In a shard, a BM25 index returns the unused neighbours
of each seed text, which fill the seed's container in order of score while any fits; only what room no neighbour fits goes to the longest
unused text that does. Containers that are still short are emptied and packed again, all shards' leftovers together in the same lexical
order, until few enough remain for one shard or a round fills no more.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholion.llm.splitting import split
from scholion.llm.tokens import TOKEN
from scholion.tables import cut, spread

CAPACITY = 2048
#: Texts in a shard at most; the share of the capacity below which a container is emptied and packed again.
SHARD, FULL = 3000, 0.97
K1, B = 1.2, 0.75
_WORD = re.compile(r"[^\W\d_]{3,}")


class Index:
    """BM25 inverted index over the texts of a shard, as arrays."""

    def __init__(self, texts: list[str], lengths: np.ndarray, average: float) -> None:
        vocabulary: dict[str, int] = {}
        self.terms: list[np.ndarray] = []
        docs, terms, freqs = [], [], []
        for d, t in enumerate(texts):
            counts: dict[int, int] = {}
            for w in _WORD.findall(t.lower()):
                k = vocabulary.setdefault(w, len(vocabulary))
                counts[k] = counts.get(k, 0) + 1
            own = np.fromiter(counts, np.int64, len(counts))
            self.terms.append(own)
            docs.append(np.full(len(own), d, np.int32))
            terms.append(own)
            freqs.append(np.fromiter(counts.values(), np.float32, len(counts)))
        n = len(texts)
        doc, term, freq = (np.concatenate(x) if x else np.zeros(0) for x in (docs, terms, freqs))
        order = np.argsort(term, kind="stable")
        self.doc = doc[order].astype(np.int64)
        df = np.bincount(term.astype(np.int64), minlength=len(vocabulary))
        self.starts = np.concatenate(([0], np.cumsum(df)))
        idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
        norm = K1 * (1 - B + B * np.maximum(lengths, 1) / max(average, 1))
        f = freq[order]
        self.weight = (idf[term[order].astype(np.int64)] * f * (K1 + 1) / (f + norm[self.doc])).astype(np.float32)
        self.n = n

    def scores(self, d: int) -> np.ndarray:
        """BM25 scores of all texts for the words of text ``d``."""
        out = np.zeros(self.n, np.float32)
        for t in self.terms[d]:
            a, b = self.starts[t], self.starts[t + 1]
            out[self.doc[a:b]] += self.weight[a:b]
        return out


def pack(texts: list[str], sizes: list[int], capacity: int = CAPACITY, average: float | None = None) -> list[list[int]]:
    """Containers as lists of item numbers, each item once and no container over the capacity.

    The longest unused item is the seed; its neighbours by BM25 follow while they fit, best first; the longest that fits fills the rest.
    Items of no tokens go with the first container. Ties go to the smaller number.
    """
    lengths = np.array(sizes, dtype=np.int64)
    index = Index(texts, lengths, average or float(lengths.mean() if len(lengths) else 1))
    unused = np.ones(len(texts), bool)
    free = sorted((int(s), -i) for i, s in enumerate(sizes))  # (size, -number): the last is the longest, smallest number first
    seeds = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    out: list[list[int]] = []

    def use(i: int) -> None:
        unused[i] = False
        k = bisect_right(free, (int(lengths[i]), -i)) - 1
        free.pop(k)

    for seed in seeds:
        if not unused[seed]:
            continue
        box, room = [seed], capacity - int(lengths[seed])
        use(seed)
        if room > 0 and free and free[0][0] <= room:
            scores = index.scores(seed)
            scores[~unused] = -1
            fits = np.flatnonzero((scores > 0) & (lengths <= room))
            least = int(lengths[fits].min()) if len(fits) else 0
            for i in fits[np.lexsort((fits, -scores[fits]))]:
                if room < least:
                    break
                if lengths[i] <= room:
                    box.append(int(i))
                    use(int(i))
                    room -= int(lengths[i])
            while free:
                k = bisect_right(free, (room, 1)) - 1
                if k < 0:
                    break
                i = -free[k][1]
                box.append(i)
                use(i)
                room -= int(lengths[i])
        out.append(box)
    return out


def sized(documents: DataFrame, capacity: int, tokenizer_file: str | None = None) -> DataFrame:
    """``(doc_id, part, text, tokens, word)``: texts as items, those over the capacity split; ``word`` is a lexical key for sharding."""
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = None
        if tokenizer_file:
            from tokenizers import Tokenizer

            tok = Tokenizer.from_file(tokenizer_file)
            tok.encode_special_tokens = True
            encode = lambda t: len(tok.encode(t, add_special_tokens=False).ids)
        for b in batches:
            rows = []
            for d, t in zip(b["doc_id"], b["text"]):
                if t is None:
                    continue
                n = encode(t) if encode else sum(1 for _ in TOKEN.finditer(t))
                parts = [(t, n)]
                if n > capacity:
                    limit = capacity
                    while True:  # the pieces' sizes by another tokenizer may differ from those the cut was made by
                        parts = [(t[s:e], k) for s, e, k in split(t, limit, 0)]
                        if encode:
                            parts = [(x, encode(x)) for x, _ in parts]
                        if all(k <= capacity for _, k in parts) or limit < 16:
                            break
                        limit = limit * 3 // 4
                    while encode and any(k > capacity for _, k in parts):  # signs that are many tokens each: halves
                        parts = [(y, encode(y)) for x, k in parts for y in ((x[: len(x) // 2], x[len(x) // 2 :]) if k > capacity and len(x) > 1 else (x,))]
                        if all(len(x) == 1 for x, k in parts if k > capacity):
                            break
                for i, (x, k) in enumerate(parts):
                    words = [w for w in _WORD.findall(x.lower()) if len(w) > 5]
                    rows.append((d, i, x, k, min(words, key=lambda w: (hash_word(w), w), default="")))
            yield pd.DataFrame(rows, columns=["doc_id", "part", "text", "tokens", "word"])

    return spread(documents.select("doc_id", "text")).mapInPandas(run, f"doc_id {kind}, part int, text string, tokens long, word string")


def hash_word(word: str) -> int:
    import zlib

    return zlib.crc32(word.encode())


def _packed(items: DataFrame, shards: int, capacity: int, average: float, number: int) -> DataFrame:
    """One round: (box, doc_id, part, text, tokens, word, fill). Texts of one lexical key are together, those of a hot key in as many parts as it fills shards.

    Which texts meet depends on keys and ids alone, so a round gives the same containers whenever it is run.
    """
    hot = items.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > SHARD).select("word", F.ceil(F.col("n") / SHARD).cast("int").alias("parts"))
    split = F.pmod(F.xxhash64("doc_id", "part"), F.coalesce("parts", F.lit(1)))
    placed = items.join(hot, "word", "left").withColumn("split", split).select("doc_id", "part", "text", "tokens", "word", "split")
    placed = placed.repartition(shards, "word", "split").sortWithinPartitions(F.xxhash64("word"), "word", "split", "doc_id", "part").drop("split")
    kind = items.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        count = 0
        for b in batches:
            held.append(b)
            count += len(b)
            while count >= SHARD:  # a partition longer than a shard is packed shard by shard
                whole = pd.concat(held, ignore_index=True)
                yield shard(whole.iloc[:SHARD])
                held, count = [whole.iloc[SHARD:]], len(whole) - SHARD
        if count:
            yield shard(pd.concat(held, ignore_index=True))

    def shard(p: pd.DataFrame) -> pd.DataFrame:
        p = p.reset_index(drop=True)
        boxes = pack(list(p["text"]), [int(x) for x in p["tokens"]], capacity, average)
        name, fill = [""] * len(p), [0] * len(p)
        for box in boxes:
            total = int(p["tokens"].iloc[box].sum())
            first = box[0]
            label = f"{p['doc_id'].iloc[first]}.{p['part'].iloc[first]}.{number}"
            for i in box:
                name[i], fill[i] = label, total
        return p.assign(box=name, fill=fill)[["box", "doc_id", "part", "text", "tokens", "word", "fill"]]

    return placed.mapInPandas(run, f"box string, doc_id {kind}, part int, text string, tokens long, word string, fill long")


def fill_containers(documents: DataFrame, capacity: int = CAPACITY, tokenizer_file: str | None = None) -> DataFrame:
    """``(box, doc_id, part, tokens, fill)``: every text in one container, none over the capacity.

    Texts over the capacity are split at natural boundaries into parts that fit. Null texts have no row; texts without tokens take no room
    but keep their row; repeated rows are packed each. Shards hold at most SHARD texts whatever the data's size, hot words are split, and
    the leftovers of all shards are packed again together.
    """
    items = cut(sized(documents, capacity, tokenizer_file))
    stats = items.agg(F.count(F.lit(1)).alias("n"), F.avg("tokens").alias("avg")).first()
    n, average = stats["n"], float(stats["avg"] or 1)
    if not n:
        return items.select(F.lit("").alias("box"), "doc_id", "part", "tokens", F.lit(0).cast("long").alias("fill"))
    done: list[DataFrame] = []
    number = 0
    while True:
        shards = max(1, -(-n // (SHARD * 9 // 10)))
        packed = cut(_packed(items, shards, capacity, average, number))
        short = F.col("fill") < FULL * capacity
        left = packed.where(short).count() if shards > 1 else 0
        if not left or left > 0.9 * n:  # one shard, nothing short, or no more to be had
            done.append(packed)
            break
        done.append(packed.where(~short))
        items, n, number = packed.where(short).select("doc_id", "part", "text", "tokens", "word"), left, number + 1
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select("box", "doc_id", "part", "tokens", "fill")


def filling_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Containers, tokens and the share of room used."""
    boxes = packed.groupBy("box").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("items"))
    return boxes.agg(F.count(F.lit(1)).alias("containers"), F.sum("items").alias("items"), F.sum("tokens").alias("tokens"), F.max("tokens").alias("fullest"), (F.sum("tokens") / (F.count(F.lit(1)) * capacity)).alias("filled"))
