"""Rows of authors, institutions and papers from provider records, their links, trust metrics and profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholion.functions.score import conflict
from scholion.functions.text import canonical_ids
from scholion.operators.graph import coauthors, quartile_breakdown, referencing_authors, top_by, trust_metrics
from scholion.operators.ingest import align_authors
from scholion.operators.listings import stale


def tail(c: Column) -> Column:
    """What comes after the last slash of an address; the value itself where it has none."""
    return F.regexp_extract(F.regexp_replace(F.trim(c), "/+$", ""), r"([^/]*)$", 1)


def _given(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def author_rows(people: DataFrame) -> DataFrame:
    """A row for each ``author_id`` from mentions (author_id, name, orcid, openalex_id, url, citations, papers, h_index, seen), the first by ``seen``.

    Mentions without a name or an id are left out. ORCIDs lose their address, and an author with one is verified; external ids hold
    what there is. Counts come from the first mention alone and stay null where it has none.
    """
    first = people.where(_given(F.col("name")).isNotNull() & _given(F.col("author_id")).isNotNull()).groupBy("author_id").agg(F.min_by(F.struct("name", "orcid", "openalex_id", "url", "citations", "papers", "h_index"), "seen").alias("p")).select("author_id", "p.*")
    orcid = _given(tail(F.col("orcid")))
    openalex = _given(F.regexp_replace("openalex_id", "^https://openalex.org/", ""))
    out = first.select("author_id", F.trim("name").alias("name"), orcid.alias("orcid"), openalex.alias("openalex_id"), _given(F.col("url")).alias("url"), "citations", "papers", "h_index")
    entry = lambda k, c: F.when(c.isNotNull(), F.struct(F.lit(k).alias("key"), c.alias("value")))
    ids = F.array_compact(F.array(entry("semantic_scholar", F.col("url")), entry("orcid", F.concat(F.lit("https://orcid.org/"), "orcid")), entry("openalex", F.concat(F.lit("https://openalex.org/"), "openalex_id"))))
    return out.select("author_id", "name", "orcid", "openalex_id", F.col("orcid").isNotNull().alias("verified"), F.map_from_entries(ids).alias("external_ids"), "citations", "papers", "h_index")


def institution_rows(mentions: DataFrame) -> DataFrame:
    """A row for each institution from mentions (id, display_name, ror, country_code, type, seen): the last by ``seen`` overwrites; without an id there is none."""
    named = mentions.where(_given(F.col("id")).isNotNull()).withColumn("institution_id", tail(F.col("id")))
    last = named.groupBy("institution_id").agg(F.max_by(F.struct("id", "display_name", "ror", "country_code", "type"), "seen").alias("i"))
    return last.select("institution_id", F.coalesce("i.display_name", F.lit("Unknown Institution")).alias("name"), _given(tail(F.col("i.ror"))).alias("ror_id"), "i.country_code", "i.type")


def located_issn(locations: Column) -> Column:
    """``(issn, issn_l)`` of a paper's locations, in order of trust: the first that has any ISSN, and the first that has a linking one.

    Locations are structs with ``issn`` (array) and ``issn_l``; a number counts if it has eight signs without hyphens. The ISSNs are sorted.
    """
    eight = lambda c: F.upper(F.regexp_replace(F.trim(c), "-", ""))
    valid = lambda xs: F.array_sort(F.array_distinct(F.filter(F.transform(F.coalesce(xs, F.array().cast("array<string>")), eight), lambda x: F.length(x) == 8)))
    lists = F.filter(F.transform(locations, lambda l: valid(l["issn"])), lambda x: F.size(x) > 0)
    links = F.filter(F.transform(locations, lambda l: eight(l["issn_l"])), lambda x: F.length(x) == 8)
    return F.struct(F.get(lists, F.lit(0)).alias("issn"), F.get(links, F.lit(0)).alias("issn_l"))


def with_defaults(papers: DataFrame, counts: list[str], ids: str) -> DataFrame:
    """Papers ready to be stored: null counts are 0, external ids have their usual keys."""
    return papers.withColumns({c: F.coalesce(c, F.lit(0)) for c in counts} | {ids: canonical_ids(F.col(ids))})


def author_links(authorships: DataFrame, existing: DataFrame) -> DataFrame:
    """Links (paper, author_id, position, institution) that aren't there yet: an author once a paper, at the first place, with its first institution."""
    first = authorships.where("author_id is not null").groupBy("paper", "author_id").agg(F.min_by(F.struct("position", "institution"), "position").alias("l"))
    return first.select("paper", "author_id", "l.*").join(existing.select("paper", "author_id"), ["paper", "author_id"], "left_anti")


def relationship_rows(edges: DataFrame, citations: DataFrame, k: int = 10_000) -> DataFrame:
    """``(author, other, kind, count)``: collaborations, citing and referenced authors, of each kind the ``k`` most frequent of an author."""
    together = coauthors(edges).select("author", F.col("coauthor").alias("other"), F.col("papers").alias("count"))
    refers = referencing_authors(citations, edges.distinct()).withColumnRenamed("citations", "count")
    out = None
    for kind, rows in (("collaboration", together), ("referenced", refers), ("citing", refers.select(F.col("other").alias("author"), F.col("author").alias("other"), "count"))):
        part = top_by(rows, "author", "count", "other", k).select("author", "other", F.lit(kind).alias("kind"), "count")
        out = part if out is None else out.unionByName(part)
    return out


def linked_ids(response: Column, side: str = "cited") -> Column:
    """Ids of the papers in a provider's answer about references (``cited``) or citations (``citing``), whichever of its three shapes an element has."""
    shape = f"struct<data:array<struct<{side}Paper:struct<paperId:string>,{side}_paper:struct<paper_id:string>,paperId:string>>>"
    rows = F.coalesce(F.from_json(response, shape)["data"], F.expr(f"cast(array() as array<struct<{side}Paper:struct<paperId:string>,{side}_paper:struct<paper_id:string>,paperId:string>>)"))
    ids = F.transform(rows, lambda r: F.coalesce(F.nullif(r[f"{side}Paper"]["paperId"], F.lit("")), F.nullif(r[f"{side}_paper"]["paper_id"], F.lit("")), F.nullif(r["paperId"], F.lit(""))))
    return F.filter(ids, lambda x: x.isNotNull())


def index_step(records: DataFrame, existing: DataFrame, order: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(new papers, reference edges, counters): records (paper, references, ...) not there yet, the first of each; edges of all records, new or not."""
    first = records.where("paper is not null").groupBy("paper").agg(F.min_by(F.struct(*[c for c in records.columns if c != "paper"]), order).alias("r")).select("paper", "r.*")
    fresh = first.join(existing.select("paper"), "paper", "left_anti")
    edges = records.where("paper is not null").select(F.col("paper").alias("citing"), F.explode("references").alias("cited")).where("cited is not null").distinct()
    known = existing.select("paper").distinct().withColumn("there", F.lit(True))
    counters = records.join(known, "paper", "left").agg(F.count(F.lit(1)).alias("records"), F.count_if(F.col("there").isNotNull()).alias("skipped"), F.count_if(F.col("paper").isNull()).alias("errors"))
    return fresh, edges, counters


def provider_merge(base: DataFrame, extra: DataFrame, key: str, order: str) -> DataFrame:
    """Base rows in which the other provider's non-null fields overwrite, the last row of a key by ``order`` holding; rows without a match stay."""
    cols = [c for c in extra.columns if c not in (key, order)]
    last = extra.where(F.col(key).isNotNull()).groupBy(key).agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(f"_{c}") for c in cols))
    joined = base.join(last, key, "left")
    return joined.select(*(F.coalesce(f"_{c}", c).alias(c) if c in cols else F.col(c) for c in base.columns), *(F.col(f"_{c}").alias(c) for c in cols if c not in base.columns))


def merged_authors(base: DataFrame, extra: DataFrame) -> DataFrame:
    """Authors (paper, pos, name, orcid, institution) of one provider, with ORCID and institution of the other's author of equal surname beside them."""
    pairs = align_authors(base.select("paper", "pos", "name"), extra.select("paper", "pos", "name"))
    there = extra.select("paper", F.col("pos").alias("right_pos"), F.col("orcid").alias("_orcid"), F.col("institution").alias("_institution"))
    out = base.join(pairs.withColumnRenamed("left_pos", "pos"), ["paper", "pos"], "left").join(there, ["paper", "right_pos"], "left")
    return out.select("paper", "pos", "name", F.coalesce("_orcid", "orcid").alias("orcid"), F.coalesce("_institution", "institution").alias("institution"))


def author_trust(authors: DataFrame, external: DataFrame, works: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Per author (author, external_id, citations, papers, h_index, is_conflict): works, retractions, i10, and whether the providers contradict each other.

    They do where at least two of citations, papers and h-index differ by the threshold; without the other provider's row the flag stays.
    """
    own = trust_metrics(works).select("author", F.col("papers").alias("works"), "retracted", "retracted_rate", "i10")
    o = external.where("external_id is not null").select("external_id", F.col("citations").alias("_c"), F.col("papers").alias("_p"), F.col("h_index").alias("_h"), F.lit(True).alias("_there"))
    j = authors.join(o, "external_id", "left").join(own, "author", "left")
    far = sum((conflict(F.col(a), F.col(b), threshold, False).cast("int") for a, b in (("papers", "_p"), ("h_index", "_h"))), conflict(F.col("citations"), F.col("_c"), threshold, False).cast("int"))
    flag = F.when(F.col("_there").isNotNull(), far >= 2).otherwise(F.coalesce("is_conflict", F.lit(False)))
    return j.select("author", F.coalesce("works", F.lit(0)).alias("works"), F.coalesce("retracted", F.lit(0)).alias("retracted"), "retracted_rate", F.coalesce("i10", F.lit(0)).alias("i10"), flag.alias("is_conflict"), F.col("_there").isNotNull().alias("compared"))


def trust_counters(trust: DataFrame) -> DataFrame:
    return trust.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("compared")).alias("processed"), F.count_if(F.col("is_conflict")).alias("conflicts"))


def author_profiles(authors: DataFrame, works: DataFrame, edges: DataFrame, now: Column, papers: int = 20, others: int = 10) -> DataFrame:
    """Per author (author, indexed_at): newest papers, quartiles, most frequent co-authors, and whether the profile must be brought up to date.

    ``works`` is (author, paper, year, quartile); lists hold at most ``papers`` and ``others`` ids, in order.
    """
    w = Window.partitionBy("author").orderBy(F.col("year").desc_nulls_last(), "paper")
    top = works.select("author", "paper", "year").distinct().withColumn("n", F.row_number().over(w)).where(F.col("n") <= papers)
    ordered = lambda rows, place, value, name: rows.groupBy("author").agg(F.transform(F.array_sort(F.collect_list(F.struct(place, value))), lambda x: x[value]).alias(name))
    listed = ordered(top, "n", "paper", "papers")
    peers = ordered(top_by(coauthors(edges), "author", "papers", "coauthor", others), "rank", "coauthor", "coauthors")
    quartiles = quartile_breakdown(works.select("author", "paper", "quartile").distinct(), "author", "quartile")
    out = authors.join(listed, "author", "left").join(peers, "author", "left").join(quartiles, "author", "left")
    return out.select("author", "papers", "coauthors", "q1", "q2", "q3", "q4", "unknown", stale(F.col("indexed_at"), now).alias("needs_enrichment"))
