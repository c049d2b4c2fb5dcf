"""A provider of scholarly records as a Spark data source: pages of JSON lines read by token, in batch and as a stream.

Offline the pages are files ``page_00000.jsonl`` in a folder; a page's number is the continuation token.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader
from pyspark.sql.types import StructType

#: A file of this name in the folder pauses the stream; it goes on from its token when the file is gone.
PAUSED = "paused"
SCHEMA = "paper_id string, title string, abstract string, year int, publication_date string, venue string, citation_count int, doi string, source string, is_open_access boolean, authors array<struct<name:string,author_id:string,orcid:string,institutions:array<string>>>, topics array<struct<display_name:string,score:double>>, issn array<string>, issn_l string"


class Page(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


def normalized(raw: dict) -> tuple:
    """A record of either provider in common columns; a year without a date becomes the first of January."""
    openalex = "display_name" in raw or str(raw.get("id", "")).rpartition("/")[2][:1] == "W"
    ids = raw.get("externalIds") or raw.get("ids") or {}
    doi = raw.get("doi") or ids.get("DOI") or ids.get("doi")
    doi = doi.lower().removeprefix("https://doi.org/") if doi else None
    year = raw.get("publication_year") if openalex else raw.get("year")
    date = raw.get("publication_date") if openalex else raw.get("publicationDate")
    if openalex:
        words = raw.get("abstract_inverted_index") or {}
        places = sorted((i, w) for w, at in words.items() for i in at)
        abstract = " ".join(w for _, w in places) or None
        located = [x for x in [raw.get("primary_location"), raw.get("best_oa_location"), *(raw.get("locations") or [])] if isinstance(x, dict)]
        sources = [x["source"] for x in located if isinstance(x.get("source"), dict)]
        authors = [((a.get("author") or {}).get("display_name"), _end((a.get("author") or {}).get("id")), _end((a.get("author") or {}).get("orcid")), [_end(i.get("id")) for i in a.get("institutions") or []]) for a in raw.get("authorships") or []]
        topics = [(t.get("display_name"), float(t["score"]) if t.get("score") is not None else None) for t in raw.get("topics") or []]
        issn = next((s["issn"] for s in sources if s.get("issn")), None)
        return (
            _end(raw.get("id")), raw.get("display_name") or raw.get("title"), abstract, year, date or (f"{year}-01-01" if year else None), next((s.get("display_name") for s in sources), None), raw.get("cited_by_count"), doi, "openalex",
            (raw.get("open_access") or {}).get("is_oa"), authors, topics, issn, next((s["issn_l"] for s in sources if s.get("issn_l")), None),
        )
    authors = [(a.get("name"), a.get("authorId"), (a.get("externalIds") or {}).get("ORCID"), list(a.get("affiliations") or [])) for a in raw.get("authors") or []]
    topics = [(f.get("category"), None) for f in raw.get("s2FieldsOfStudy") or []]
    return (raw.get("paperId"), raw.get("title"), raw.get("abstract"), year, date or (f"{year}-01-01" if year else None), raw.get("venue"), raw.get("citationCount"), doi, "semantic_scholar", raw.get("isOpenAccess"), authors, topics, None, None)


def _end(address: str | None) -> str | None:
    return str(address).rstrip("/").rpartition("/")[2] if address else None


# Comparisons that a provider can answer itself, by the columns of the result.
_COLUMNS = [c.strip().split(" ")[0] for c in ("paper_id string", "title string", "abstract string", "year int", "publication_date string", "venue string", "citation_count int", "doi string", "source string")]
_TESTS = {"EqualTo": lambda a, b: a == b, "GreaterThan": lambda a, b: a > b, "GreaterThanOrEqual": lambda a, b: a >= b, "LessThan": lambda a, b: a < b, "LessThanOrEqual": lambda a, b: a <= b}


def _pages(path: str) -> list[Path]:
    return sorted(Path(path).glob("page_*.jsonl"))


def _rows(path: str | Path) -> Iterator[tuple]:
    with open(path, encoding="utf-8") as lines:
        for line in lines:
            if line.strip():
                yield normalized(json.loads(line))


class _Reader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

        self.tests: list[tuple[int, str, object]] = []

    def partitions(self) -> list[InputPartition]:
        return [Page(str(p)) for p in _pages(self.path)] or [Page("")]

    def read(self, partition: Page) -> Iterator[tuple]:
        for row in _rows(partition.path) if partition.path else ():
            if all(row[i] is not None and _TESTS[name](row[i], value) for i, name, value in self.tests):
                yield row


class _Pushed(_Reader):
    def pushFilters(self, filters: list) -> Iterator:
        """Take over comparisons of plain columns with a value; the others are left to Spark."""
        for f in filters:
            name = type(f).__name__
            if name in _TESTS and len(f.attribute) == 1 and f.attribute[0] in _COLUMNS:
                self.tests.append((_COLUMNS.index(f.attribute[0]), name, f.value))
            else:
                yield f


class _Stream(SimpleDataSourceStreamReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def initialOffset(self) -> dict:
        return {"page": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        pages = _pages(self.path)
        if start["page"] >= len(pages) or Path(self.path, PAUSED).exists():  # a paused job keeps its token
            return iter(()), start
        return _rows(pages[start["page"]]), {"page": start["page"] + 1}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        for p in _pages(self.path)[start["page"] : end["page"]]:
            yield from _rows(p)


class ProviderSource(DataSource):
    """``spark.read.format("scholarly_provider").load(folder)`` and ``spark.readStream...``.

    With the option ``pushdown`` (and ``spark.sql.python.filterPushdown.enabled``) comparisons are answered by the source itself.
    """

    @classmethod
    def name(cls) -> str:
        return "scholarly_provider"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return (_Pushed if self.options.get("pushdown", "").lower() == "true" else _Reader)(self.options["path"])

    def simpleStreamReader(self, schema: StructType) -> SimpleDataSourceStreamReader:
        return _Stream(self.options["path"])
