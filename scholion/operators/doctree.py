"""Chunks of structured documents: sections of a document tree or of TEI, tables, figures and formulas as evidence, key sections.

A document tree is a table of items (doc, pos, label, layer, text, orig, level, page), of table cells (doc, table, page, row, col, text) and of
captions (doc, kind, number, page, text). Sections are grouped by a running count of headers, so that only one document's items are sorted together.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholion.functions.text import clean_noise, collapsed, is_boilerplate, is_formula, section_key
from scholion.operators.chunking import MOST, OVERLAP, Counter, majority, word_count

# Labels of formulas, and what a chunk of evidence begins with.
FORMULA_LABELS = ("formula", "equation", "math", "equation_block", "formula_block")
LEADS = {
    "table": "This chunk summarizes tabular evidence with key values and captions.", "formula": "This chunk summarizes formula/equation evidence and symbolic expressions.",
    "figure": "This chunk summarizes figure/chart evidence with key caption details.",
}
_BLOCK, _SENTENCE, _TEX = re.compile(r"\n[ \t]*\n\s*"), re.compile(r"(?<=[.!?])\s+"), re.compile(r"\$\$|\\begin\{|\\\[")


def normal_label(label: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(F.coalesce(label, F.lit("")))), "[- ]", "_")


def body_items(items: DataFrame) -> DataFrame:
    """Items without furniture and blank ones, with normalised label and cleaned text (the original where there is none)."""
    filled = F.coalesce(F.nullif(F.trim("text"), F.lit("")), F.trim("orig"))
    out = items.where(F.coalesce(F.col("layer"), F.lit("")) != "furniture").withColumn("text", clean_noise(filled)).withColumn("label", normal_label(F.col("label")))
    return out.where("text <> ''")


def page_anchors(items: DataFrame) -> DataFrame:
    """``(doc, page, anchor)``: the header in force at the first item of each page; ``Document`` before any."""
    w = Window.partitionBy("doc").orderBy("pos")
    seen = body_items(items).withColumn("anchor", F.coalesce(F.last(F.when(F.col("label") == "section_header", F.col("text")), ignorenulls=True).over(w), F.lit("Document")))
    return seen.where("page is not null").groupBy("doc", "page").agg(F.min_by("anchor", "pos").alias("anchor"))


def table_texts(cells: DataFrame, captions: DataFrame) -> DataFrame:
    """``(doc, number, page, text)``: captions, then rows with their cells in order, parted by bars; blank cells and rows are left out."""
    c = cells.where(F.trim(F.coalesce("text", F.lit(""))) != "")
    rows = c.groupBy("doc", "number", "row").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", F.trim("text").alias("t")))), lambda x: x["t"]), " | ").alias("line"))
    body = rows.groupBy("doc", "number").agg(F.transform(F.array_sort(F.collect_list(F.struct("row", "line"))), lambda x: x["line"]).alias("lines"))
    named = captions.where("kind = 'table'").withColumn("t", clean_noise("text")).where("t <> ''").groupBy("doc", "number").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "t"))), lambda x: x["t"]).alias("heads"))
    pages = cells.select("doc", "number", "page").unionByName(captions.where("kind = 'table'").select("doc", "number", "page")).groupBy("doc", "number").agg(F.min("page").alias("page"))
    none = F.array().cast("array<string>")
    joined = pages.join(body, ["doc", "number"], "left").join(named, ["doc", "number"], "left")
    return joined.select("doc", "number", "page", F.array_join(F.concat(F.coalesce("heads", none), F.coalesce("lines", none)), "\n").alias("text")).where("text <> ''")


def table_blocks(cells: DataFrame, captions: DataFrame) -> DataFrame:
    """``(doc, page, block)``: the tables of each page in order, each as a block of text."""
    t = table_texts(cells, captions).where("page is not null")
    blocks = t.groupBy("doc", "page").agg(F.transform(F.array_sort(F.collect_list(F.struct("number", "text"))), lambda x: F.concat(F.lit("[TABLE]\n"), x["text"])).alias("b"))
    return blocks.select("doc", "page", F.array_join("b", "\n\n").alias("block"))


def tree_sections(items: DataFrame, blocks: DataFrame | None = None) -> DataFrame:
    """``(doc, section, title, level, page, label, text)``: the items under each header, with the tables on their pages after them.

    The page is that of the last item, the label the most frequent one; headers without items have no section.
    """
    w = Window.partitionBy("doc").orderBy("pos")
    lines = body_items(items).withColumn("header", F.col("label") == "section_header").withColumn("section", F.sum(F.col("header").cast("int")).over(w))
    heads = lines.where("header").groupBy("doc", "section").agg(F.min_by(F.struct("text", "level"), "pos").alias("h"))
    own = lines.where("not header")
    texts = own.groupBy("doc", "section").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "\n\n").alias("text"), F.max_by("page", F.when(F.col("page").isNotNull(), F.col("pos"))).alias("page"))
    labels = majority(own.select(F.struct("doc", "section").alias("at"), "label"), "at", "label").select("at.doc", "at.section", "label")
    out = texts.join(heads, ["doc", "section"], "left").join(labels, ["doc", "section"], "left")
    if blocks is not None:
        on = own.where("page is not null").select("doc", "section", "page").distinct().join(blocks, ["doc", "page"])
        more = on.groupBy("doc", "section").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "block"))), lambda x: x["block"]), "\n\n").alias("tables"))
        out = out.join(more, ["doc", "section"], "left").withColumn("text", F.concat_ws("\n\n", "text", "tables")).drop("tables")
    return out.select("doc", "section", F.col("h.text").alias("title"), F.col("h.level").alias("level"), "page", "label", "text")


def pack_spans(text: str, most: int = MOST, overlap: float = OVERLAP, count: Counter = word_count) -> list[tuple[int, int, int]]:
    """Pieces (start, end, tokens) of a text: whole blocks up to ``most`` tokens, whole blocks of up to ``overlap`` of it carried into the next piece.

    A block over the limit is cut at sentences unless it is a formula; a sentence or formula over the limit is a piece of its own. A text
    within the limit is one piece.
    """
    if count(text) <= most:
        return [(0, len(text), count(text))]
    units: list[tuple[int, int, int]] = []

    def add(a: int, b: int, parts: re.Pattern | None) -> None:
        cuts = [a, *(x for m in parts.finditer(text, a, b) for x in (m.start(), m.end())), b] if parts else [a, b]
        for s, e in zip(cuts[::2], cuts[1::2]):
            n = count(text[s:e])
            if not n:
                continue
            if parts is _BLOCK and n > most and not _TEX.search(text, s, e):
                add(s, e, _SENTENCE)
            else:
                units.append((s, e, n))

    add(0, len(text), _BLOCK)
    out, now, size, fresh, budget = [], [], 0, 0, int(overlap * most)
    for u in units:
        if fresh and size + u[2] > most:
            out.append((now[0][0], now[-1][1], size))
            carried: list[tuple[int, int, int]] = []
            total = 0
            for v in reversed(now):
                if total + v[2] > budget or total + v[2] + u[2] > most:
                    break
                carried.insert(0, v)
                total += v[2]
            now, size, fresh = carried, total, 0
        now.append(u)
        size += u[2]
        fresh += 1
    if fresh:
        out.append((now[0][0], now[-1][1], size))
    return out


def chunk_sections(sections: DataFrame, most: int = MOST, overlap: float = OVERLAP, count: Counter = word_count) -> DataFrame:
    """``(doc, chunk_id, chunk_index, title, level, page, label, text, token_count, char_start, char_end)`` of the sections of each document.

    No chunk crosses a section. Places count through the document, two characters between sections. Sections are packed one by one,
    whatever document they are of; only their lengths are summed up by document.
    """
    before = Window.partitionBy("doc").orderBy("section").rowsBetween(Window.unboundedPreceding, -1)
    s = sections.where("trim(text) <> ''").withColumn("base", F.coalesce(F.sum(F.length("text") + 2).over(before), F.lit(0)))
    kind, order = sections.schema["doc"].dataType.simpleString(), sections.schema["section"].dataType.simpleString()
    columns = ["doc", "section", "piece", "title", "level", "page", "label", "text", "token_count", "char_start", "char_end"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for doc, section, title, level, page, label, text, base in b.itertuples(index=False, name=None):
                for i, (x, y, n) in enumerate(pack_spans(text, most, overlap, count)):
                    rows.append((doc, section, i, title, level, page, label, text[x:y], n, base + x, base + y))
            out = pd.DataFrame(rows, columns=columns)
            yield out.astype({"level": "Int32", "page": "Int32"})

    schema = f"doc {kind}, section {order}, piece int, title string, level int, page int, label string, text string, token_count int, char_start long, char_end long"
    pieces = s.select("doc", "section", "title", F.col("level").cast("int"), F.col("page").cast("int"), "label", "text", "base").mapInPandas(run, schema)
    index = F.row_number().over(Window.partitionBy("doc").orderBy("section", "piece")) - 1
    return pieces.withColumn("chunk_index", index).select("doc", F.concat(F.col("doc").cast("string"), F.lit("::C"), F.col("chunk_index")).alias("chunk_id"), "chunk_index", *columns[3:])


def tei_sections(tei: DataFrame, key: str) -> DataFrame:
    """The abstract and the sections of parsed TEI documents (key, abstract, sections) as sections to be chunked."""
    first = F.struct(F.lit("Abstract").alias("title"), F.trim(F.coalesce("abstract", F.lit(""))).alias("text"), F.lit("abstract").alias("label"))
    rest = F.transform(F.coalesce("sections", F.expr("cast(array() as array<struct<title:string,content:string>>)")), lambda s: F.struct(F.trim(s["title"]).alias("title"), F.trim(s["content"]).alias("text"), F.lit("section").alias("label")))
    rows = tei.select(F.col(key).alias("doc"), F.posexplode(F.concat(F.array(first), rest)).alias("section", "s"))
    return rows.select("doc", "section", "s.title", F.lit(1).alias("level"), F.lit(None).cast("int").alias("page"), "s.label", "s.text").where("text <> ''")


def packed_paragraphs(paragraphs: DataFrame, most: int = MOST, count: Counter = word_count) -> DataFrame:
    """``(doc, number, title, page, text, token_count)``: paragraphs (doc, pos, title, page, text) of a document put together in order.

    A piece ends where section or page change or the next paragraph would go over the limit; a paragraph over the limit is cut at its
    sentences. Boilerplate is left out. Runs of a document that no change of section or page interrupts are packed one by one.
    """
    p = paragraphs.where(~is_boilerplate("text")).withColumn("text", clean_noise("text")).withColumn("key", section_key("title"))
    w = Window.partitionBy("doc").orderBy("pos")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    # the section and page in force are the last ones given
    last_key, last_page = F.last(F.nullif("key", F.lit("")), ignorenulls=True).over(before), F.last("page", ignorenulls=True).over(before)
    change = F.coalesce((F.col("key") != "") & (F.col("key") != last_key), F.lit(False)) | F.coalesce(F.col("page") != last_page, F.lit(False))
    runs = p.withColumn("change", change).withColumn("run", F.sum(F.col("change").cast("int")).over(w))
    g = runs.groupBy("doc", "run").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]).alias("texts"), F.min_by("title", F.when(F.col("key") != "", F.col("pos"))).alias("title"), F.min_by("page", F.when(F.col("page").isNotNull(), F.col("pos"))).alias("page"))
    kind = paragraphs.schema["doc"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for doc, number, texts, title, page in b.itertuples(index=False, name=None):
                held: list[str] = []
                size = i = 0

                def flush(doc=doc, number=number, title=title, page=page) -> None:
                    nonlocal held, size, i
                    if held:
                        text = "\n\n".join(held)
                        rows.append((doc, number, i, title, page, text, count(text)))
                        i += 1
                    held, size = [], 0

                for t in texts:
                    n = count(t)
                    if n > most:
                        flush()
                        for x, y, k in pack_spans(t, most, OVERLAP, count):
                            rows.append((doc, number, i, title, page, t[x:y], k))
                            i += 1
                        continue
                    if size + n > most:
                        flush()
                    held.append(t)
                    size += n
                flush()
            yield pd.DataFrame(rows, columns=["doc", "run", "piece", "title", "page", "text", "token_count"]).astype({"page": "Int32"})

    out = g.select("doc", "run", "texts", "title", F.col("page").cast("int")).mapInPandas(run, f"doc {kind}, run long, piece int, title string, page int, text string, token_count int")
    return out.withColumn("number", F.row_number().over(Window.partitionBy("doc").orderBy("run", "piece")) - 1).select("doc", "number", "title", "page", "text", "token_count")


def evidence_chunks(items: DataFrame, cells: DataFrame, captions: DataFrame, kinds: tuple[str, ...] = ("table",)) -> DataFrame:
    """``(doc, kind, number, title, page, text)``: tables, figures and formulas as chunks of evidence under the header of their page."""
    lines = lambda c: F.array_join(F.filter(F.transform(F.split(c, "\n"), lambda x: collapsed(x)), lambda x: x != ""), "\n")
    parts = []
    if "table" in kinds:
        parts.append(table_texts(cells, captions).select("doc", F.lit("table").alias("kind"), F.col("number").cast("long"), "page", lines("text").alias("text")))
    if "figure" in kinds:
        f = captions.where("kind = 'figure'").withColumn("t", clean_noise("text")).where("t <> ''").groupBy("doc", "number").agg(F.min("page").alias("page"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "t"))), lambda x: x["t"]), " ").alias("text"))
        parts.append(f.select("doc", F.lit("figure").alias("kind"), F.col("number").cast("long"), "page", collapsed("text").alias("text")))
    if "formula" in kinds:
        found = body_items(items).where(F.col("label").isin(*FORMULA_LABELS) | is_formula("text"))
        parts.append(found.select("doc", F.lit("formula").alias("kind"), F.col("pos").cast("long").alias("number"), "page", collapsed("text").alias("text")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    lead = F.create_map(*(F.lit(x) for k, v in LEADS.items() for x in (k, v)))[F.col("kind")]
    named = F.concat(F.initcap("kind"), F.lit(" Evidence"))
    return out.join(page_anchors(items), ["doc", "page"], "left").select("doc", "kind", "number", F.concat_ws(" / ", "anchor", named).alias("title"), "page", F.concat(lead, F.lit("\n\n"), F.col("text")).alias("text"))


# What headers of the key sections say; the first that matches holds.
KEY_SECTIONS = (("abstract", "abstract"), ("introduction", "introduction|overview"), ("methodology", "method|approach|model|architecture"), ("results", "result|experiment|evaluation|finding"), ("conclusion", "conclusion|discussion|future work"))


def key_sections(items: DataFrame) -> DataFrame:
    """``(doc, part, text)``: abstract, introduction, methodology, results and conclusion of each document, and its ``full_text``.

    Headers of a level over 2 and other headers end a section. Of several sections of one part the last with a text holds.
    """
    raw = items.where((F.coalesce(F.col("layer"), F.lit("")) != "furniture") & (F.coalesce("text", F.lit("")) != ""))
    w = Window.partitionBy("doc").orderBy("pos")
    lines = raw.withColumn("header", F.coalesce(F.col("label") == "section_header", F.lit(False))).withColumn("section", F.sum(F.col("header").cast("int")).over(w))
    low, part = F.lower("text"), F.lit(None).cast("string")
    for name, pattern in reversed(KEY_SECTIONS):
        part = F.when(low.rlike(pattern), name).otherwise(part)
    heads = lines.where("header").select("doc", "section", F.when(F.coalesce("level", F.lit(0)) <= 2, part).alias("part"))
    own = lines.where("label in ('text', 'paragraph')")
    joined = lambda rows, by: rows.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "\n\n").alias("text"))
    texts = joined(own, ["doc", "section"]).join(heads.where("part is not null"), ["doc", "section"])
    return texts.groupBy("doc", "part").agg(F.max_by("text", "section").alias("text")).unionByName(joined(own, ["doc"]).select("doc", F.lit("full_text").alias("part"), "text"))
