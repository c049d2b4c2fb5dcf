"""Linking and merging of records on their way in: upserts, priorities, provider merges, alignment of author lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholion.functions.text import issn_variants, normalize_title, surname


def latest(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The newest row of each key by ``order`` (largest first), by partial aggregation: no group is gathered."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("row")).select(*keys, "row.*")


def upsert_latest(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """New rows replace old ones of their key, the newest of repeated ones holding."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(latest(new, keys, F.col(order)).select(*old.columns))


def upsert_filled(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Only non-null new values overwrite; of several new rows, each column takes its newest non-null value."""
    rest = [c for c in old.columns if c not in keys]
    newest = new.groupBy(*keys).agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(f"_{c}") for c in rest))
    return old.join(newest, keys, "full").select(*keys, *(F.coalesce(f"_{c}", c).alias(c) for c in rest))


def insert_new(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """New rows whose key isn't there yet, the first of repeated ones."""
    fresh = new.join(old.select(*keys).distinct(), keys, "left_anti")
    rest = [c for c in fresh.columns if c not in keys]
    return fresh.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("row")).select(*keys, "row.*")


def overlap_join(left: DataFrame, right: DataFrame, left_values: str, right_values: str, left_key: str, right_key: str) -> DataFrame:
    """Distinct pairs of keys whose arrays share an element: exploded and joined on it, never all with all."""
    a = left.select(F.col(left_key).alias("left_key"), F.explode(F.array_distinct(left_values)).alias("v")).where("v is not null")
    b = right.select(F.col(right_key).alias("right_key"), F.explode(F.array_distinct(right_values)).alias("v")).where("v is not null")
    return a.join(b, "v").select("left_key", "right_key").distinct()


def all_issn_variants(values: str) -> Column:
    return F.array_distinct(F.flatten(F.transform(F.coalesce(F.col(values), F.array().cast("array<string>")), lambda v: issn_variants(v))))


def link_journals(papers: DataFrame, journals: DataFrame) -> DataFrame:
    """``(paper, journal, tier)``: linking ISSN, else any ISSN, else normalised title; the newest ``data_year``, then the smallest id, holds.

    ``papers`` has paper, issn_l, issn (array), venue. Each tier falls through to the next.
    """
    newest = Window.partitionBy("paper").orderBy("tier", F.col("data_year").desc_nulls_last(), "journal")
    j = journals.select(F.col("id").alias("journal"), "data_year", "issn", "title")
    by_issn = j.select("journal", "data_year", F.explode(all_issn_variants("issn")).alias("v"))
    p1 = papers.select("paper", F.explode(issn_variants("issn_l")).alias("v"), F.lit(1).alias("tier"))
    p2 = papers.select("paper", F.explode(all_issn_variants("issn")).alias("v"), F.lit(2).alias("tier"))
    hits = p1.unionByName(p2).join(by_issn, "v").select("paper", "journal", "data_year", "tier")
    titled = papers.select("paper", normalize_title("venue").alias("t"), F.lit(3).alias("tier")).where("t <> ''").join(j.select("journal", "data_year", normalize_title("title").alias("t")), "t").select("paper", "journal", "data_year", "tier")
    return hits.unionByName(titled).withColumn("rn", F.row_number().over(newest)).where("rn = 1").select("paper", "journal", "tier")


def match_conferences(papers: DataFrame, conferences: DataFrame, ranks: dict[str, int]) -> DataFrame:
    """``(paper, conference)``: the acronym equals the venue, or a title word run contains it; best by primary, rank, id.

    The acronym is an equality join. Titles that contain the venue are found through the venue's longest word, so that no pair without a
    common word is looked at.
    """
    v = papers.select("paper", F.lower(F.trim("venue")).alias("v")).where("v <> ''")
    distinct = v.select("v").distinct()
    c = conferences.select(F.col("id").alias("conference"), F.lower("acronym").alias("acronym"), F.lower("title").alias("title"), "is_primary", "rank")
    equal = distinct.join(c, distinct.v == c.acronym).select("v", "conference", "is_primary", "rank")
    words = lambda col: F.array_distinct(F.regexp_extract_all(col, F.lit(r"(?U)\w+"), F.lit(0)))
    longest = distinct.select("v", F.aggregate(words(F.col("v")), F.lit(""), lambda a, x: F.when(F.length(x) > F.length(a), x).otherwise(a)).alias("w")).where("w <> ''")
    within = longest.join(c.withColumn("w", F.explode(words(F.col("title")))), "w").where(F.contains("title", "v")).select("v", "conference", "is_primary", "rank")
    order = F.create_map(*(F.lit(x) for k, n in ranks.items() for x in (k, n)))[F.col("rank")] if ranks else F.lit(0)
    best = equal.unionByName(within).distinct().groupBy("v").agg(F.min_by("conference", F.struct(F.when(F.col("is_primary"), 0).otherwise(1), F.coalesce(order, F.lit(99)), "conference")).alias("conference"))
    return v.join(best, "v").select("paper", "conference")


def enrich(base: DataFrame, extra: DataFrame, key: str, order: str, keep_unkeyed: bool = True) -> DataFrame:
    """Columns of ``extra`` fill nulls of ``base`` by key; of repeated extras the last by ``order`` holds; base rows without key are kept or dropped."""
    cols = [c for c in extra.columns if c not in (key, order)]
    last = extra.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*cols), order).alias("x"))
    rows = base if keep_unkeyed else base.where(F.col(key).isNotNull())
    joined = rows.join(last, key, "left")
    return joined.select(*(F.coalesce(F.col(c), F.col(f"x.{c}")).alias(c) if c in cols else F.col(c) for c in base.columns), *(F.col(f"x.{c}").alias(c) for c in cols if c not in base.columns))


def align_authors(left: DataFrame, right: DataFrame) -> DataFrame:
    """``(paper, left_pos, right_pos)``: authors of two lists of one paper with equal surname, at the same place, else one before, else one after.

    Both are (paper, pos, name). The join is on paper, surname and place, so a paper's lists are never compared all with all.
    """
    a = left.select("paper", F.col("pos").alias("left_pos"), surname("name").alias("s")).where("s is not null")
    b = right.select("paper", F.col("pos").alias("right_pos"), surname("name").alias("s")).where("s is not null")
    tries = a.select("paper", "s", "left_pos", F.explode(F.array(*(F.struct(F.lit(i).alias("try"), (F.col("left_pos") + d).alias("right_pos")) for i, d in enumerate((0, -1, 1))))).alias("t"))
    hit = tries.select("paper", "s", "left_pos", "t.try", "t.right_pos").join(b, ["paper", "s", "right_pos"])
    return hit.groupBy("paper", "left_pos").agg(F.min_by("right_pos", "try").alias("right_pos"))


def authorship_rows(records: DataFrame, key: str = "rec_id") -> DataFrame:
    """Flat authorships with 1-based place, author id and first institution; nameless places are left out."""
    flat = records.select(key, F.posexplode("authors").alias("pos", "a")).where("a.name is not null")
    return flat.select(key, (F.col("pos") + 1).alias("position"), F.col("a.author_id").alias("author_id"), F.col("a.name").alias("name"), F.try_element_at(F.filter("a.institutions", lambda i: i["id"].isNotNull()), F.lit(1))["id"].alias("institution"))


def resolve_requested(request: DataFrame, papers: DataFrame) -> DataFrame:
    """``(requested, rec_id, way)``: by paper id, else by external id, a DOI also after ``DOI:``; the first row by id holds. Unresolved requests have null."""
    by_id = request.join(papers.groupBy(F.col("paper_id").alias("requested")).agg(F.min("rec_id").alias("by_id")), "requested", "left")
    entries = papers.select("rec_id", F.explode("external_ids").alias("k", "v"))
    keys = F.array(F.col("v"), F.when(F.lower("k") == "doi", F.concat(F.lit("DOI:"), "v")))
    ext = entries.select("rec_id", F.explode(F.array_compact(keys)).alias("requested")).groupBy("requested").agg(F.min("rec_id").alias("by_ext"))
    out = by_id.join(ext, "requested", "left")
    return out.select("requested", F.coalesce("by_id", "by_ext").alias("rec_id"), F.when(F.col("by_id").isNotNull(), "paper_id").when(F.col("by_ext").isNotNull(), "external_id").alias("way"))
