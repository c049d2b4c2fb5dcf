"""Section-aware chunking of documents into token-bounded pieces."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scholion.functions.text import section_key

LEAST, MOST, OVERLAP = 300, 600, 0.1
_BLOCK = re.compile(r"\n[ \t]*\n")
_SENTENCE = re.compile(r"(?<=[.!?])\s+")
_TEX = re.compile(r"\$\$|\\begin\{|\\\[")
_HEADING = re.compile(r"^(?:#{1,6}\s+(.+)|(\d+(?:\.\d+)*\.?\s+[A-Z].{0,80})|([A-Z][A-Z \-]{3,60}))$")

Counter = Callable[[str], int]


def word_count(text: str) -> int:
    """Default token count: runs of word characters and runs of signs."""
    return len(re.findall(r"\w+|[^\w\s]+", text))


def pack_blocks(blocks: list[str], most: int = MOST, overlap: float = OVERLAP, count: Counter = word_count) -> list[str]:
    """Blocks packed in order up to ``most`` tokens; whole blocks of up to ``overlap`` of it are carried into the next piece.

    A block over the limit is cut into sentences, unless it is a formula, which stays whole; a sentence over the limit is a piece of its own.
    """
    units: list[tuple[str, int]] = []
    for b in blocks:
        n = count(b)
        units += [(s, count(s)) for s in _SENTENCE.split(b) if s.strip()] if n > most and not _TEX.search(b) else [(b, n)] if b.strip() else []
    out, now, size, budget, fresh = [], [], 0, int(overlap * most), 0
    for text, n in units:
        if now and size + n > most:
            if fresh:
                out.append("\n\n".join(t for t, _ in now))
            carried: list[tuple[str, int]] = []
            total = 0
            for t, k in reversed(now):
                if total + k > budget or total + k + n > most:
                    break
                carried.insert(0, (t, k))
                total += k
            now, size, fresh = carried, total, 0
        now.append((text, n))
        size += n
        fresh += 1
    if fresh:
        out.append("\n\n".join(t for t, _ in now))
    return out


def split_sections(text: str) -> list[tuple[str | None, str]]:
    """(title, body) of a text by its headings; what comes before the first has no title."""
    out: list[tuple[str | None, list[str]]] = [(None, [])]
    for line in text.split("\n"):
        m = _HEADING.match(line.strip())
        if m:
            out.append((next(g for g in m.groups() if g).strip(), []))
        else:
            out[-1][1].append(line)
    return [(t, "\n".join(b).strip()) for t, b in out if "\n".join(b).strip()]


def chunk_text(text: str, most: int = MOST, overlap: float = OVERLAP, least: int = 0, count: Counter = word_count) -> list[tuple[str | None, str, int]]:
    """(section title, text, tokens) of a document's chunks; a tail under ``least`` tokens joins the chunk before it in its section if it fits."""
    out = []
    for title, body in split_sections(text):
        pieces = [body] if count(body) <= most else pack_blocks(_BLOCK.split(body), most, overlap, count)
        if least and len(pieces) > 1 and count(pieces[-1]) < least and count(pieces[-2]) + count(pieces[-1]) <= most:
            pieces[-2:] = ["\n\n".join(pieces[-2:])]
        out += [(title, p, count(p)) for p in pieces]
    return out


def chunk_documents(docs: DataFrame, key: str, text: str, most: int = MOST, overlap: float = OVERLAP, least: int = LEAST, count: Counter = word_count) -> DataFrame:
    """``(key, chunk_id, chunk_index, section_title, text, token_count, char_start, char_end)``; places count from chunk to chunk, two characters between.

    Null and blank texts have no chunk. A document is handled where it is read.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, t in zip(b["key"], b["text"]):
                at = 0
                for i, (title, piece, n) in enumerate(chunk_text(t, most, overlap, least, count) if t and t.strip() else []):
                    rows.append((k, f"{k}::C{i}", i, title, piece, n, at, at + len(piece)))
                    at += len(piece) + 2
            yield pd.DataFrame(rows, columns=["key", "chunk_id", "chunk_index", "section_title", "text", "token_count", "char_start", "char_end"])

    out = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInPandas(run, f"key {kind}, chunk_id string, chunk_index int, section_title string, text string, token_count int, char_start int, char_end int")
    return out.withColumnRenamed("key", key)


def table_rows(cells: DataFrame, table_key: str) -> DataFrame:
    """Text of tables from cells (table, row, col, text): cells of a row in order, parted by bars, rows by line ends."""
    rows = cells.groupBy(table_key, "row").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", F.coalesce("text", F.lit("")).alias("t")))), lambda c: c["t"]), " | ").alias("line"))
    return rows.groupBy(table_key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "line"))), lambda r: r["line"]), "\n").alias("text"))


def majority(rows: DataFrame, group: str, label: str) -> DataFrame:
    """Most frequent label of each group, ties to the smallest; counted before the choice, so that no group is gathered."""
    counts = rows.where(F.col(label).isNotNull()).groupBy(group, label).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(group).agg(F.min_by(label, F.struct(-F.col("n"), label)).alias(label))


def evidence_links(evidence: DataFrame, texts: DataFrame, k: int = 3) -> DataFrame:
    """Top texts of one document for each piece of evidence: same page 3, next 1, one further 0.5; same section 4, one title within the other 2.

    Both are (doc, id, page, section). Pairs come from document and page (each piece of evidence tries the pages within two) and from
    document and section: titles are compared once a document and pair of sections, not once a pair of texts. Sections are compared by
    :func:`section_key`. Ties go to the nearer page (an unknown one counts as 99 away), then the smaller id.
    """
    e = evidence.select("doc", F.col("id").alias("evidence"), "page", section_key("section").alias("key"))
    t = texts.select("doc", F.col("id").alias("text_id"), F.col("page").alias("tp"), section_key("section").alias("tk"))
    akin = e.where("key <> ''").select("doc", "key").distinct().join(t.where("tk <> ''").select("doc", "tk").distinct(), "doc")
    akin = akin.where(F.col("key").contains(F.col("tk")) | F.col("tk").contains(F.col("key"))).withColumn("kin", F.when(F.col("key") == F.col("tk"), 4.0).otherwise(2.0))
    near = e.where("page is not null").withColumn("tp", F.explode(F.expr("sequence(page - 2, page + 2)"))).join(t, ["doc", "tp"]).select("doc", "evidence", "text_id", "page", "tp", "key", "tk")
    same = e.join(akin, ["doc", "key"]).join(t, ["doc", "tk"]).select("doc", "evidence", "text_id", "page", "tp", "key", "tk")
    both = near.unionByName(same).dropDuplicates(["evidence", "text_id"]).join(akin, ["doc", "key", "tk"], "left")
    far = F.abs(F.col("page") - F.col("tp"))
    score = F.when(far == 0, 3.0).when(far == 1, 1.0).when(far == 2, 0.5).otherwise(0.0) + F.coalesce("kin", F.lit(0.0))
    w = Window.partitionBy("doc", "evidence").orderBy(F.col("score").desc(), "far", "text_id")
    return both.withColumn("score", score).withColumn("far", F.coalesce(far, F.lit(99))).where("score > 0").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("doc", "evidence", "text_id", "score", "rank")


def token_stats(chunks: DataFrame, tokens: str) -> DataFrame:
    return chunks.agg(F.count(F.lit(1)).alias("chunks"), F.avg(tokens).alias("mean"), F.min(tokens).alias("least"), F.max(tokens).alias("most"))
