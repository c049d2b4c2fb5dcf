"""Filters: parsed settings, metadata conditions, lookups, selectors and listings."""

from __future__ import annotations

from dataclasses import dataclass, field, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Other spellings of the settings.
_ALIASES = {
    "author": ("author_name", "authorName", "author"), "year_from": ("year_from", "yearFrom", "min_year", "year_min"), "year_to": ("year_to", "yearTo", "max_year", "year_max"), "venue": ("venue",),
    "min_citations": ("min_citation_count", "minCitationCount", "min_citations", "minCitations"), "max_citations": ("max_citation_count", "maxCitationCount", "max_citations", "maxCitations"),
    "quartile": ("journal_quartile", "journalQuartile", "journal_rank", "journalRank"), "fields": ("fields_of_study", "fieldsOfStudy", "field_of_study", "fieldOfStudy"),
}


@dataclass(frozen=True)
class Filters:
    author: str | None = None
    year_from: int | None = None
    year_to: int | None = None
    venue: str | None = None
    min_citations: int | None = None
    max_citations: int | None = None
    quartile: str | None = None
    fields: tuple[str, ...] = field(default=())

    @classmethod
    def parse(cls, given: dict | None) -> Filters:
        """Settings from a mapping in any spelling; the first spelling that is given holds, 0 included; blank texts count as not given."""
        out: dict = {}
        for f in fields(cls):
            for alias in _ALIASES[f.name]:
                v = (given or {}).get(alias)
                if v is None or isinstance(v, str) and not v.strip():
                    continue
                if f.name == "fields":
                    v = tuple(x for x in ([v] if isinstance(v, str) else v) if x)
                elif f.name in ("year_from", "year_to", "min_citations", "max_citations"):
                    v = int(v)
                out[f.name] = v
                break
        return cls(**out)


def like(column: Column | str, text: str) -> Column:
    """Case-insensitive ``contains`` in which the text's own % and _ are ordinary characters."""
    c = F.col(column) if isinstance(column, str) else column
    return F.contains(F.lower(c), F.lit(text.lower()))


def apply_filters(papers: DataFrame, f: Filters, authors: DataFrame | None = None, journals: DataFrame | None = None, id_column: str = "rec_id", journal_key: str = "venue") -> DataFrame:
    """Papers that meet all given conditions. ``authors`` is (paper, name) and, where there are any, display_name, author_string and
    external_ids (a map), any of which may hold the name; ``journals`` has ``title`` and ``sjr_best_quartile``.

    Conditions on columns reach the scan; authors and quartiles are semi joins, so no row is repeated.
    """
    cond = F.lit(True)
    for value, make in (
        (f.year_from, lambda v: F.col("year") >= v), (f.year_to, lambda v: F.col("year") <= v), (f.venue, lambda v: like("venue", v)), (f.min_citations, lambda v: F.col("citation_count") >= v), (f.max_citations, lambda v: F.col("citation_count") <= v),
    ):
        if value is not None:
            cond = cond & make(value)
    if f.fields:
        text = F.lower(F.array_join("fields_of_study", "\n"))
        any_of = F.lit(False)
        for x in f.fields:
            any_of = any_of | F.contains(text, F.lit(x.lower()))
        cond = cond & any_of
    out = papers.where(cond)
    if f.author is not None and authors is not None:
        named = F.coalesce(like("name", f.author), F.lit(False))
        for c in ("display_name", "author_string", "external_ids"):
            if c in authors.columns:
                named = named | F.coalesce(like(F.to_json(c) if c == "external_ids" else c, f.author), F.lit(False))
        out = out.join(authors.where(named).select(F.col("paper").alias(id_column)), id_column, "left_semi")
    if f.quartile is not None and journals is not None:
        out = out.join(journals.where(F.upper("sjr_best_quartile") == f.quartile.upper()).select(F.col("title").alias(journal_key)).distinct(), journal_key, "left_semi")
    return out


def listing(rows: DataFrame, order: list[Column], offset: int = 0, limit: int = 20) -> DataFrame:
    """One page of rows in a full order."""
    return rows.orderBy(*order).offset(offset).limit(limit)


def in_request_order(request: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Rows for requested keys ``(pos, key)``, each key once at its first place, with that place."""
    first = request.where(F.col(key).isNotNull()).groupBy(key).agg(F.min("pos").alias("pos"))
    return first.join(rows, key)


def exists_map(request: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Every requested key with whether it is there."""
    there = rows.select(key).distinct().withColumn("there", F.lit(True))
    return request.select(key).distinct().join(there, key, "left").select(key, F.coalesce("there", F.lit(False)).alias("exists"))


def by_any_id(rows: DataFrame, ids: str, wanted: DataFrame) -> DataFrame:
    """Rows whose id map has one of the wanted ``(kind, value)``, DOIs before others; one row a wanted id."""
    flat = rows.select("rec_id", F.explode(ids).alias("kind", "value")).select("rec_id", F.lower("kind").alias("kind"), F.lower("value").alias("value"))
    hit = wanted.select(F.lower("kind").alias("kind"), F.lower("value").alias("value")).distinct().join(flat, ["kind", "value"])
    return hit.groupBy("value").agg(F.min_by("rec_id", F.struct(F.when(F.col("kind") == "doi", 0).otherwise(1), "rec_id")).alias("rec_id"))
