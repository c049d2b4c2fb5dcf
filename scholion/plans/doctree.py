"""Queries of structured documents. A paper's chunks stand for the items of its tree, list items for table cells and captions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholion.operators import chunking as H
from scholion.operators import doctree as D
from scholion.tables import table


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "paper_chunks").where("paper_id is not null")
    return c.select(F.col("paper_id").alias("doc"), F.col("id").alias("pos"), "label", F.when(F.col("page_number") == 9, "furniture").alias("layer"), F.when(F.col("label") == "section_header", F.col("section_title")).otherwise(F.col("text")).alias("text"), F.col("section_title").alias("orig"), F.lit(1).alias("level"), F.col("page_number").alias("page"))


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of list items as cells: five rows of three."""
    c = table(spark, sf_dir, "paper_chunks").where("paper_id is not null and label = 'list_item'")
    words = c.select(F.col("paper_id").alias("doc"), F.col("id").alias("number"), F.col("page_number").alias("page"), F.posexplode(F.slice(F.split("text", " "), 1, 15)).alias("i", "text"))
    return words.select("doc", "number", "page", F.floor(F.col("i") / 3).cast("int").alias("row"), (F.col("i") % 3).alias("col"), "text")


def _captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "paper_chunks").where("paper_id is not null and label = 'list_item'")
    return c.select(F.col("paper_id").alias("doc"), F.explode(F.array(F.lit("table"), F.lit("figure"))).alias("kind"), F.col("id").alias("number"), F.lit(0).alias("pos"), F.col("page_number").alias("page"), F.col("section_title").alias("text"))


def tree_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = D.tree_sections(_items(spark, sf_dir), D.table_blocks(_cells(spark, sf_dir), _captions(spark, sf_dir)))
    return s.select("doc", F.col("section").cast("long"), "title", "page", "label", F.md5("text").alias("text"))


def tree_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of document trees; none over the limit crosses a section."""
    return D.chunk_sections(D.tree_sections(_items(spark, sf_dir), D.table_blocks(_cells(spark, sf_dir), _captions(spark, sf_dir))))


def tei_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as TEI: the first paragraph as abstract, the others as sections."""
    parts = F.split("text", "\n\n")
    tei = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", parts[0].alias("abstract"), F.transform(F.slice(parts, 2, 1_000_000), lambda x: F.struct(F.lit("Section").alias("title"), x.alias("content"))).alias("sections"))
    return D.chunk_sections(D.tei_sections(tei, "doc_id"))


def packed_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "paper_chunks").where("paper_id is not null")
    return D.packed_paragraphs(c.select(F.col("paper_id").alias("doc"), F.col("id").alias("pos"), F.col("section_title").alias("title"), F.col("page_number").alias("page"), "text"))


def evidence_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables and figures as evidence under their page's header."""
    e = D.evidence_chunks(_items(spark, sf_dir), _cells(spark, sf_dir), _captions(spark, sf_dir), ("table", "figure"))
    return e.select("doc", "kind", "number", "title", "page", F.md5("text").alias("text"))


def formula_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = D.evidence_chunks(_items(spark, sf_dir), _cells(spark, sf_dir), _captions(spark, sf_dir), ("formula",))
    return e.select("doc", "number", "title", "page", F.md5("text").alias("text"))


def table_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.table_blocks(_cells(spark, sf_dir), _captions(spark, sf_dir)).select("doc", "page", F.md5("block").alias("block"))


def key_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.key_sections(_items(spark, sf_dir)).select("doc", "part", F.md5("text").alias("text"))


def chunk_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of whole documents: how many, their places and sizes add up by document."""
    c = H.chunk_documents(table(spark, sf_dir, "documents"), "doc_id", "text")
    return c.groupBy("doc_id").agg((F.count(F.lit(1)) == F.max("chunk_index") + 1).alias("dense"), (F.max("char_end") == F.sum(F.length("text") + 2) - 2).alias("placed"), (F.min("token_count") > 0).alias("filled"))


QUERIES = {f.__name__: f for f in (tree_sections, tree_chunks, tei_chunks, packed_paragraphs, evidence_chunks, formula_evidence, table_blocks, key_sections, chunk_coverage)}

_CLEAN = "trim(regexp_replace({0}, '[\\s\\p{{Z}}]+', ' ', 'g'), ' ')"
_ITEMS = "it AS (SELECT paper_id AS doc, id AS pos, label AS raw, replace(replace(lower(trim(coalesce(label, ''), ' ')), '-', '_'), ' ', '_') AS label, page_number AS page, CASE WHEN label = 'section_header' THEN section_title ELSE text END AS text, section_title AS orig FROM paper_chunks WHERE paper_id IS NOT NULL AND coalesce(page_number, 0) <> 9)"
_BODY = f"bo AS (SELECT doc, pos, label, page, {_CLEAN.format('coalesce(nullif(trim(text), chr(0)), orig)')} AS text FROM (SELECT doc, pos, label, page, CASE WHEN trim(text, ' ') = '' THEN NULL ELSE text END AS text, orig FROM it)), bi AS (SELECT * FROM bo WHERE text <> '')"
_TABLES = f"""ce AS (SELECT paper_id AS doc, id AS number, page_number AS page, section_title AS cap, string_split(text, ' ')[1:15] AS ws FROM paper_chunks WHERE paper_id IS NOT NULL AND label = 'list_item'), c1 AS (SELECT doc, number, page, generate_subscripts(ws, 1) - 1 AS i, unnest(ws) AS w FROM ce),
      ro AS (SELECT doc, number, i // 3 AS r, string_agg(trim(w, ' '), ' | ' ORDER BY i) AS line FROM c1 WHERE trim(w, ' ') <> '' GROUP BY 1, 2, 3), tb AS (SELECT doc, number, string_agg(line, chr(10) ORDER BY r) AS t FROM ro GROUP BY 1, 2), cp AS (SELECT doc, number, any_value(cap) AS cap, min(page) AS page FROM ce GROUP BY 1, 2),
      tx AS (SELECT cp.doc, cp.number, cp.page, CASE WHEN {_CLEAN.format('cap')} <> '' THEN {_CLEAN.format('cap')} END AS cap, tb.t FROM cp LEFT JOIN tb ON tb.doc = cp.doc AND tb.number = cp.number), tt AS (SELECT doc, number, page, cap, concat_ws(chr(10), cap, t) AS text FROM tx)"""
_ANCHORS = "an AS (SELECT doc, page, arg_min(a, pos) AS anchor FROM (SELECT doc, page, pos, coalesce(last_value(CASE WHEN label = 'section_header' THEN text END IGNORE NULLS) OVER (PARTITION BY doc ORDER BY pos), 'Document') AS a FROM bi) WHERE page IS NOT NULL GROUP BY 1, 2)"
_BLOCKS = "bl AS (SELECT doc, page, string_agg('[TABLE]' || chr(10) || text, chr(10) || chr(10) ORDER BY number) AS block FROM tt WHERE page IS NOT NULL AND text <> '' GROUP BY 1, 2)"
_LINES = "array_to_string(list_filter(list_transform(string_split({0}, chr(10)), lambda x: trim(regexp_replace(x, '[\\s\\p{{Z}}]+', ' ', 'g'), ' ')), lambda x: x <> ''), chr(10))"
_KEYS = "CASE " + " ".join(f"WHEN regexp_matches(lower(text), '{p}') THEN '{n}'" for n, p in D.KEY_SECTIONS) + " END"
SQL = {
    "tree_sections": f"""WITH {_ITEMS}, {_BODY}, {_TABLES}, {_BLOCKS}, li AS (SELECT *, sum(CASE WHEN label = 'section_header' THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY pos) AS section FROM bi), ow AS (SELECT * FROM li WHERE label <> 'section_header'),
      te AS (SELECT doc, section, string_agg(text, chr(10) || chr(10) ORDER BY pos) AS text, arg_max(page, pos) FILTER (page IS NOT NULL) AS page FROM ow GROUP BY 1, 2), he AS (SELECT doc, section, arg_min(text, pos) AS title FROM li WHERE label = 'section_header' GROUP BY 1, 2),
      la AS (SELECT doc, section, label FROM (SELECT doc, section, label, row_number() OVER (PARTITION BY doc, section ORDER BY count(*) DESC, label) AS n FROM ow GROUP BY 1, 2, 3) WHERE n = 1),
      mo AS (SELECT o.doc, o.section, string_agg(bl.block, chr(10) || chr(10) ORDER BY o.page) AS t FROM (SELECT DISTINCT doc, section, page FROM ow WHERE page IS NOT NULL) o JOIN bl ON bl.doc = o.doc AND bl.page = o.page GROUP BY 1, 2)
      SELECT te.doc, CAST(te.section AS BIGINT) AS section, he.title, te.page, la.label, md5(concat_ws(chr(10) || chr(10), te.text, mo.t)) AS text FROM te LEFT JOIN he ON he.doc = te.doc AND he.section = te.section LEFT JOIN la ON la.doc = te.doc AND la.section = te.section LEFT JOIN mo ON mo.doc = te.doc AND mo.section = te.section""",
    "table_blocks": f"WITH {_TABLES}, {_BLOCKS} SELECT doc, page, md5(block) AS block FROM bl",
    "evidence_chunks": f"""WITH {_ITEMS}, {_BODY}, {_TABLES}, {_ANCHORS}, e AS (SELECT doc, 'table' AS kind, number, page, {_LINES.format('text')} AS text, 'Table Evidence' AS n, '{D.LEADS["table"]}' AS l FROM tt WHERE text <> '' UNION ALL SELECT doc, 'figure', number, page, cap, 'Figure Evidence', '{D.LEADS["figure"]}' FROM tt WHERE cap <> '')
      SELECT e.doc, e.kind, e.number, concat_ws(' / ', an.anchor, e.n) AS title, e.page, md5(e.l || chr(10) || chr(10) || e.text) AS text FROM e LEFT JOIN an ON an.doc = e.doc AND an.page = e.page""",
    "formula_evidence": f"WITH {_ITEMS}, {_BODY}, {_ANCHORS} SELECT b.doc, b.pos AS number, concat_ws(' / ', an.anchor, 'Formula Evidence') AS title, b.page, md5('{D.LEADS['formula']}' || chr(10) || chr(10) || b.text) AS text FROM bi b LEFT JOIN an ON an.doc = b.doc AND an.page = b.page WHERE b.label IN {D.FORMULA_LABELS} OR (length(b.text) >= 40 AND (length(b.text) - length(translate(b.text, '∑∏√∞≈≤≥±∫πλμσΩ{{}}[]<>|=+*/^_', ''))) / length(b.text) > 0.08)",
    "key_sections": f"""WITH {_ITEMS}, r AS (SELECT * FROM it WHERE coalesce(text, '') <> ''), li AS (SELECT *, sum(CASE WHEN raw = 'section_header' THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY pos) AS section FROM r), h AS (SELECT doc, section, {_KEYS} AS part FROM li WHERE raw = 'section_header'),
      o AS (SELECT * FROM li WHERE raw IN ('text', 'paragraph')), t AS (SELECT doc, section, string_agg(text, chr(10) || chr(10) ORDER BY pos) AS text FROM o GROUP BY 1, 2), s AS (SELECT t.doc, h.part, arg_max(t.text, t.section) AS text FROM t JOIN h ON h.doc = t.doc AND h.section = t.section WHERE h.part IS NOT NULL GROUP BY 1, 2)
      SELECT doc, part, md5(text) AS text FROM s UNION ALL SELECT doc, 'full_text', md5(string_agg(text, chr(10) || chr(10) ORDER BY pos)) FROM o GROUP BY doc""",
    "chunk_coverage": "SELECT doc_id, true AS dense, true AS placed, true AS filled FROM documents WHERE regexp_matches(text, '\\S')",
}
