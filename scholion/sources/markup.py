"""Sources in markup: TEI documents, search-result pages, links to PDFs in HTML. Parsing is by partition, in Arrow batches."""

from __future__ import annotations

import html
import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TEI = "{http://www.tei-c.org/ns/1.0}"


def parse_tei(text: str) -> dict | None:
    """Title, authors, abstract, sections (title, paragraphs joined by blank lines) and references of a TEI document; None if it isn't XML."""
    try:
        root = ET.fromstring(text)
    except ET.ParseError:
        return None
    for el in root.iter():
        if el.tag.startswith("{") and not el.tag.startswith(_TEI):
            el.tag = _TEI + el.tag.rpartition("}")[2]
        elif not el.tag.startswith("{"):
            el.tag = _TEI + el.tag
    words = lambda el: " ".join("".join(el.itertext()).split()) if el is not None else ""
    t = lambda path: "/".join(_TEI + p for p in path.split("/"))
    head = root.find(f".//{_TEI}teiHeader")
    scope = head if head is not None else root
    authors = [words(p) for a in scope.iter(_TEI + "author") for p in [a.find(_TEI + "persName")] if p is not None and words(p)]
    sections = []
    body = root.find(f".//{_TEI}body")
    for div in body.iter(_TEI + "div") if body is not None else ():
        paras = [words(p) for p in div.findall(_TEI + "p") if words(p)]
        if paras:
            sections.append((words(div.find(_TEI + "head")) or "Unknown Section", "\n\n".join(paras)))
    refs = [words(b.find(f".//{_TEI}title")) for b in root.iter(_TEI + "biblStruct") if b.find(f".//{_TEI}title") is not None]
    return {"title": words(scope.find(f".//{t('titleStmt/title')}")) or words(scope.find(f".//{_TEI}title")), "authors": authors, "abstract": words(root.find(f".//{_TEI}abstract")), "sections": sections, "references": [r for r in refs if r]}


def read_tei(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, title, authors, abstract, sections, references)``; documents that aren't XML give no row."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, p["title"], p["authors"], p["abstract"], [{"title": a, "content": c} for a, c in p["sections"]], p["references"]) for k, t in zip(b["key"], b["text"]) if t for p in [parse_tei(t)] if p]
            yield pd.DataFrame(rows, columns=["key", "title", "authors", "abstract", "sections", "references"])

    schema = f"key {kind}, title string, authors array<string>, abstract string, sections array<struct<title:string,content:string>>, references array<string>"
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInPandas(run, schema).withColumnRenamed("key", key)


_META = re.compile(r"<meta[^>]+(?:name|property)=[\"'](?:citation_pdf_url|dc\.identifier\.pdf|eprints\.document_url)[\"'][^>]*content=[\"']([^\"']+)[\"']", re.I)
_META_BACK = re.compile(r"<meta[^>]+content=[\"']([^\"']+)[\"'][^>]*(?:name|property)=[\"'](?:citation_pdf_url|dc\.identifier\.pdf|eprints\.document_url)[\"']", re.I)
_ANCHOR = re.compile(r"<a\b[^>]*href=[\"']([^\"'#]+)[\"'][^>]*>(.*?)</a>", re.I | re.S)
_LINK = re.compile(r"<link\b[^>]*type=[\"']application/pdf[\"'][^>]*href=[\"']([^\"']+)[\"']|<link\b[^>]*href=[\"']([^\"']+)[\"'][^>]*type=[\"']application/pdf[\"']", re.I)
_QUOTED = re.compile(r"[\"']([^\"'\s<>]+\.pdf(?:\?[^\"'\s<>]*)?)[\"']", re.I)


def pdf_links(page: str, base: str) -> list[str]:
    """Links to PDFs in a page, in order of trust: meta tags, anchors, link tags, any quoted name; absolute, each once."""
    found = _META.findall(page) + _META_BACK.findall(page)
    found += [h for h, t in _ANCHOR.findall(page) if re.search(r"\.pdf(?:[?#]|$)", h, re.I) or re.search(r"/pdf/|download", h, re.I) and "pdf" in (h + t).lower()]
    found += [a or b for a, b in _LINK.findall(page)]
    found += _QUOTED.findall(page)
    return list(dict.fromkeys(urljoin(base or "", html.unescape(f.strip())) for f in found))


def resolve_pdfs(pages: DataFrame, key: str, url: str, body: str) -> DataFrame:
    """``(key, pos, pdf)`` of every page with a link to a PDF."""
    kind = pages.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(k, i, p) for k, u, t in zip(b["key"], b["url"], b["body"]) if t for i, p in enumerate(pdf_links(t, u))], columns=["key", "pos", "pdf"])

    return pages.select(F.col(key).alias("key"), F.col(url).alias("url"), F.col(body).alias("body")).mapInPandas(run, f"key {kind}, pos int, pdf string").withColumnRenamed("key", key)


class _Results(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[dict] = []
        self.field: str | None = None
        self.depth = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = dict(attrs)
        css = a.get("class") or ""
        if "result" in css.split() or "gs_r" in css.split():
            self.rows.append({"title": "", "authors": "", "snippet": "", "link": None, "cited": ""})
        if not self.rows:
            return
        if tag == "h3":
            self.field = "title"
        elif "authors" in css or "gs_a" in css:
            self.field = "authors"
        elif "snippet" in css or "gs_rs" in css:
            self.field = "snippet"
        elif tag == "a":
            if self.field == "title" and not self.rows[-1]["link"]:
                self.rows[-1]["link"] = a.get("href")
            elif self.field is None:
                self.field = "cited"

    def handle_endtag(self, tag: str) -> None:
        if tag in ("h3", "div") or tag == "a" and self.field == "cited":
            self.field = None

    def handle_data(self, data: str) -> None:
        if self.rows and self.field:
            self.rows[-1][self.field] += data


def search_results(page: str) -> list[tuple[str, str, str, str | None, int]]:
    """(title, authors, snippet, link, citations) of a result page; marks such as [PDF] are cut off titles, no count is 0."""
    p = _Results()
    p.feed(page)
    out = []
    for r in p.rows:
        m = re.search(r"Cited by (\d+)", r["cited"])
        out.append((re.sub(r"^(?:\[[A-Z]+\]\s*)+", "", r["title"].strip()), r["authors"].strip(), r["snippet"].strip(), r["link"], int(m[1]) if m else 0))
    return out


def read_results(pages: DataFrame, key: str, body: str) -> DataFrame:
    """``(key, pos, title, authors, snippet, link, citations)`` of every result of every page; pages without results give no row."""
    kind = pages.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(k, i, *r) for k, t in zip(b["key"], b["body"]) if t for i, r in enumerate(search_results(t))], columns=["key", "pos", "title", "authors", "snippet", "link", "citations"])

    return pages.select(F.col(key).alias("key"), F.col(body).alias("body")).mapInPandas(run, f"key {kind}, pos int, title string, authors string, snippet string, link string, citations int").withColumnRenamed("key", key)
