"""Queries of filters, linking, merging and message windows. Events stand for messages and for a pipeline's log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scholion.operators import context as C
from scholion.operators import ingest as I
from scholion.operators.filters import Filters, apply_filters, by_any_id, exists_map, in_request_order, listing
from scholion.tables import table


def filtered_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "paper_records")
    f = Filters.parse({"yearFrom": 2005, "max_year": 2022, "minCitations": 0, "author_name": "an", "field_of_study": "Medicine", "journal_rank": "q1"})
    authors = r.select(F.col("rec_id").alias("paper"), F.explode("authors").alias("a")).select("paper", "a.name", F.col("a.author_id").alias("author_string"), F.create_map(F.lit("orcid"), F.col("a.orcid")).alias("external_ids"))
    return apply_filters(r, f, authors, table(spark, sf_dir, "journals")).select("rec_id", "year", "citation_count")


def paper_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "paper_records").where("is_open_access and source = 'openalex'")
    return listing(r, [F.col("created_at").desc_nulls_last(), F.col("rec_id")], 20, 20).select("rec_id", "paper_id")


def requested_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "paper_chunks").select(F.col("id").alias("pos"), "paper_id")
    r = table(spark, sf_dir, "paper_records").select("paper_id", "rec_id")
    return in_request_order(c, r, "paper_id").select("pos", "paper_id", "rec_id")


def existing_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exists_map(table(spark, sf_dir, "paper_chunks"), table(spark, sf_dir, "paper_records"), "paper_id")


def external_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "paper_records")
    wanted = r.where("rec_id % 50 = 0").select(F.explode("external_ids").alias("kind", "value"))
    return by_any_id(r, "external_ids", wanted)


def latest_journals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.latest(table(spark, sf_dir, "journals").select("source_id", "data_year", "id", "title", "h_index"), ["source_id"], F.col("data_year"), F.col("id")).select("source_id", "data_year", "id", "title", "h_index")


def upsert_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows loaded late overwrite what is known of their cluster, nulls aside."""
    a = table(spark, sf_dir, "author_records").select("cluster_id", "row_id", "name", "orcid", "h_index")
    first = a.groupBy("cluster_id").agg(F.min_by(F.struct("name", "orcid", "h_index", "row_id"), "row_id").alias("r")).select("cluster_id", "r.name", "r.orcid", "r.h_index")
    return I.upsert_filled(first, a.withColumn("seq", F.col("row_id")), ["cluster_id"], "seq")


def insert_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Authors of profiles that records don't know, by ORCID as written."""
    old = table(spark, sf_dir, "author_records").select("orcid")
    new = table(spark, sf_dir, "author_profiles").where("orcid is not null").select("orcid", "profile_id", "display_name")
    return I.insert_new(old.where("orcid is not null"), new, ["orcid"], "profile_id").select("orcid", "profile_id", "display_name")


def overlap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Journals that share an ISSN with another entry."""
    j = table(spark, sf_dir, "journals").withColumn("v", I.all_issn_variants("issn"))
    return I.overlap_join(j, j, "v", "v", "id", "id").where("left_key < right_key")


def _papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the ISSNs of their journal's smallest entry, every other without the linking one; records give the venues."""
    r = table(spark, sf_dir, "paper_records")
    j = table(spark, sf_dir, "journals").select(F.col("id").alias("jid"), "issn")
    p = r.withColumn("jid", F.pmod("rec_id", F.lit(2000))).join(j, "jid", "left")
    return p.select(F.col("rec_id").alias("paper"), F.when(F.col("rec_id") % 3 == 0, F.try_element_at("issn", F.lit(1))).alias("issn_l"), F.when(F.col("rec_id") % 3 == 1, F.col("issn")).alias("issn"), "venue")


def journal_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.link_journals(_papers(spark, sf_dir), table(spark, sf_dir, "journals"))


def conference_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Journals of conference type stand for conferences, their first letters for acronyms."""
    c = table(spark, sf_dir, "journals").where("type like 'conference%'").select("id", F.regexp_replace("title", "[^A-Z]", "").alias("acronym"), "title", F.coalesce("is_open_access", F.lit(False)).alias("is_primary"), F.col("sjr_best_quartile").alias("rank"))
    p = table(spark, sf_dir, "paper_records").select(F.col("rec_id").alias("paper"), "venue")
    return I.match_conferences(p, c, {"Q1": 0, "Q2": 1, "Q3": 2, "Q4": 3})


def enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null years and venues of records filled from other rows of the same paper id."""
    r = table(spark, sf_dir, "paper_records").select("rec_id", "paper_id", "year", "venue")
    extra = table(spark, sf_dir, "paper_records").where("year is not null and venue is not null").select("paper_id", "year", "venue", F.col("rec_id").alias("seq"))
    return I.enrich(r, extra, "paper_id", "seq")


def aligned_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Author lists of every delivery of a paper against those of the next."""
    r = table(spark, sf_dir, "paper_records").where("paper_id is not null")
    steps = r.select("rec_id", F.lead("rec_id").over(Window.partitionBy("paper_id").orderBy("rec_id")).alias("next")).where("next is not null")
    names = r.select("rec_id", F.posexplode("authors").alias("pos", "x")).select("rec_id", "pos", F.col("x.name").alias("name"))
    left = steps.select(F.col("rec_id").alias("paper"), "rec_id").join(names, "rec_id").select("paper", "pos", "name")
    right = steps.select(F.col("rec_id").alias("paper"), F.col("next").alias("rec_id")).join(names, "rec_id").select("paper", "pos", "name")
    return I.align_authors(left, right)


def authorships(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.authorship_rows(table(spark, sf_dir, "paper_records"))


def resolved_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "paper_records")
    ids = r.where("rec_id % 50 = 0").select(F.explode("external_ids").alias("k", "v"))
    asked = table(spark, sf_dir, "paper_chunks").select(F.col("paper_id").alias("requested")).union(ids.select("v")).union(ids.select(F.concat_ws(":", F.lit("DOI"), "v"))).where("requested is not null").distinct()
    return I.resolve_requested(asked, r)


def context_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return C.context_window(e, "user_id", ["ts", "event_id"], C.token_estimate("props"), 60).select("user_id", "event_id", "back", "used")


def last_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.last_messages(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], 10).select("user_id", "event_id", "back")


def summary_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("summarised", F.col("event_type") == "signup")
    return C.needs_summary(e, "user_id", C.token_estimate("props"), "summarised")


def next_assistant_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first purchase after each view and before the next."""
    return C.next_answer(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type", "view", "purchase", "event_id")


def event_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of the second half of the month numbered on from the first."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    half = F.lit("2024-01-16").cast("timestamp")
    log = C.with_sequence(e.where(F.col("ts") < half), spark.createDataFrame([], "user_id long, sequence long"), "user_id", ["ts", "event_id"])
    return C.with_sequence(e.where(F.col("ts") >= half), log.select("user_id", "sequence"), "user_id", ["ts", "event_id"]).select("event_id", "user_id", F.col("sequence").cast("long").alias("sequence"))


def section_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of a paper grouped under their latest section header."""
    c = table(spark, sf_dir, "paper_chunks").where("paper_id is not null")
    return C.sections(c, "paper_id", "id", F.coalesce(F.col("label") == "section_header", F.lit(False))).select("id", "paper_id", F.col("section").cast("long").alias("section"))


def page_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "paper_chunks").where("paper_id is not null")
    return C.page_anchors(c, "paper_id", "id", "page_number", F.when(F.col("label") == "section_header", F.col("section_title")))


QUERIES = {
    f.__name__: f
    for f in (filtered_papers, paper_listing, requested_order, existing_ids, external_lookup, latest_journals, upsert_merge, insert_new, overlap_join, journal_links, conference_match, enriched, aligned_authors, authorships, resolved_requests, context_window, last_messages, summary_due, next_assistant_turn, event_sequence, section_groups, page_anchors)
}

_VAR = "(SELECT id, unnest(CASE WHEN regexp_full_match(b, '\\d{7}[0-9X]') THEN [b, substr(b, 1, 4) || '-' || substr(b, 5, 4)] ELSE [] END) AS v FROM (SELECT id, upper(regexp_replace(raw, '[\\s-]', '', 'g')) AS b FROM (SELECT id, unnest(issn) AS raw FROM journals)))"
_NT = "trim(regexp_replace(regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}_\\s-]', '', 'g'), '\\s+', ' ', 'g'))"
_TOK = "(CAST(floor(length(props) / 4) AS BIGINT) + 4)"
SQL = {
    "filtered_papers": "SELECT rec_id, year, citation_count FROM paper_records WHERE year BETWEEN 2005 AND 2022 AND citation_count >= 0 AND contains(lower(array_to_string(fields_of_study, chr(10))), 'medicine') AND rec_id IN (SELECT rec_id FROM (SELECT rec_id, unnest(authors) AS a FROM paper_records) WHERE coalesce(contains(lower(a.name), 'an'), false) OR coalesce(contains(lower(a.author_id), 'an'), false) OR (a.orcid IS NOT NULL AND contains(lower(a.orcid), 'an'))) AND venue IN (SELECT title FROM journals WHERE upper(sjr_best_quartile) = 'Q1')",
    "paper_listing": "SELECT rec_id, paper_id FROM paper_records WHERE is_open_access AND source = 'openalex' ORDER BY created_at DESC NULLS LAST, rec_id LIMIT 20 OFFSET 20",
    "requested_order": "SELECT c.pos, c.paper_id, r.rec_id FROM (SELECT paper_id, min(id) AS pos FROM paper_chunks WHERE paper_id IS NOT NULL GROUP BY 1) c JOIN paper_records r ON r.paper_id = c.paper_id",
    "existing_ids": "SELECT DISTINCT paper_id, paper_id IS NOT NULL AND paper_id IN (SELECT paper_id FROM paper_records WHERE paper_id IS NOT NULL) AS exists FROM paper_chunks",
    "external_lookup": "WITH f AS (SELECT rec_id, lower(e.key) AS kind, lower(e.value) AS value FROM (SELECT rec_id, unnest(map_entries(external_ids)) AS e FROM paper_records)), w AS (SELECT DISTINCT kind, value FROM f WHERE rec_id % 50 = 0) SELECT f.value, arg_min(f.rec_id, CASE WHEN f.kind = 'doi' THEN 0 ELSE 1 END * 1000000000 + f.rec_id) AS rec_id FROM f JOIN w ON w.kind = f.kind AND w.value = f.value GROUP BY f.value",
    "latest_journals": "SELECT source_id, data_year, id, title, h_index FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY data_year DESC, id DESC) AS n FROM journals) WHERE n = 1",
    "upsert_merge": "SELECT cluster_id, arg_max(name, row_id) FILTER (name IS NOT NULL) AS name, arg_max(orcid, row_id) FILTER (orcid IS NOT NULL) AS orcid, arg_max(h_index, row_id) FILTER (h_index IS NOT NULL) AS h_index FROM author_records GROUP BY cluster_id",
    "insert_new": "SELECT orcid, min(profile_id) AS profile_id, arg_min(display_name, profile_id) AS display_name FROM author_profiles WHERE orcid IS NOT NULL AND orcid NOT IN (SELECT orcid FROM author_records WHERE orcid IS NOT NULL) GROUP BY orcid",
    "overlap_join": f"SELECT DISTINCT a.id AS left_key, b.id AS right_key FROM {_VAR} a JOIN {_VAR} b ON a.v = b.v AND a.id < b.id",
    "journal_links": f"""WITH p AS (SELECT r.rec_id AS paper, CASE WHEN r.rec_id % 3 = 0 THEN [j.issn[1]] WHEN r.rec_id % 3 = 1 THEN j.issn END AS issn, CASE WHEN r.rec_id % 3 = 0 THEN 1 ELSE 2 END AS tier, r.venue FROM paper_records r LEFT JOIN journals j ON j.id = r.rec_id % 2000),
      v AS (SELECT paper, tier, upper(regexp_replace(raw, '[\\s-]', '', 'g')) AS b FROM (SELECT paper, tier, unnest(issn) AS raw FROM p)),
      h AS (SELECT v.paper, j.id AS journal, j.data_year, v.tier FROM v JOIN (SELECT DISTINCT id, v FROM {_VAR}) x ON x.v = v.b JOIN journals j ON j.id = x.id WHERE regexp_full_match(v.b, '\\d{{7}}[0-9X]')
            UNION ALL SELECT p.paper, j.id, j.data_year, 3 FROM p JOIN journals j ON {_NT.format('p.venue')} = {_NT.format('j.title')} WHERE {_NT.format('p.venue')} <> '')
      SELECT paper, journal, tier FROM (SELECT *, row_number() OVER (PARTITION BY paper ORDER BY tier, data_year DESC NULLS LAST, journal) AS n FROM h) WHERE n = 1""",
    "conference_match": """WITH c AS (SELECT id, lower(regexp_replace(title, '[^A-Z]', '', 'g')) AS acronym, lower(title) AS title, coalesce(is_open_access, false) AS p, sjr_best_quartile AS q FROM journals WHERE type LIKE 'conference%'),
      v AS (SELECT rec_id AS paper, lower(trim(venue, ' ')) AS v FROM paper_records WHERE trim(venue, ' ') <> ''), d AS (SELECT DISTINCT v FROM v),
      h AS (SELECT d.v, c.id, CASE WHEN p THEN 0 ELSE 1 END * 1000 + coalesce(CASE q WHEN 'Q1' THEN 0 WHEN 'Q2' THEN 1 WHEN 'Q3' THEN 2 WHEN 'Q4' THEN 3 END, 99) AS o FROM d JOIN c ON d.v = c.acronym OR (contains(c.title, d.v) AND regexp_matches(d.v, '[\\p{L}\\p{N}_]')
        AND list_contains(regexp_extract_all(c.title, '[\\p{L}\\p{N}_]+'), list_reduce(regexp_extract_all(d.v, '[\\p{L}\\p{N}_]+'), lambda a, b: CASE WHEN length(b) > length(a) THEN b ELSE a END))))
      SELECT v.paper, b.conference FROM v JOIN (SELECT v, arg_min(id, o * 1000000 + id) AS conference FROM h GROUP BY v) b ON b.v = v.v""",
    "enriched": "WITH x AS (SELECT paper_id, arg_max(year, rec_id) AS y, arg_max(venue, rec_id) AS v FROM paper_records WHERE year IS NOT NULL AND venue IS NOT NULL AND paper_id IS NOT NULL GROUP BY 1) SELECT r.rec_id, r.paper_id, coalesce(r.year, x.y) AS year, coalesce(r.venue, x.v) AS venue FROM paper_records r LEFT JOIN x ON x.paper_id = r.paper_id",
    "authorships": "WITH f AS (SELECT rec_id, generate_subscripts(authors, 1) AS position, unnest(authors) AS a FROM paper_records) SELECT rec_id, CAST(position AS INT) AS position, a.author_id AS author_id, a.name AS name, list_filter(a.institutions, lambda i: i.id IS NOT NULL)[1].id AS institution FROM f WHERE a.name IS NOT NULL",
    "resolved_requests": "WITH q AS (SELECT DISTINCT requested FROM (SELECT paper_id AS requested FROM paper_chunks UNION ALL SELECT unnest(map_values(external_ids)) FROM paper_records WHERE rec_id % 50 = 0 UNION ALL SELECT 'DOI:' || unnest(map_values(external_ids)) FROM paper_records WHERE rec_id % 50 = 0) WHERE requested IS NOT NULL), i AS (SELECT paper_id, min(rec_id) AS r FROM paper_records GROUP BY 1), x AS (SELECT rec_id, unnest(map_entries(external_ids)) AS e FROM paper_records), e AS (SELECT v, min(rec_id) AS r FROM (SELECT rec_id, e.value AS v FROM x UNION ALL SELECT rec_id, 'DOI:' || e.value FROM x WHERE lower(e.key) = 'doi') GROUP BY 1) SELECT q.requested, coalesce(i.r, e.r) AS rec_id, CASE WHEN i.r IS NOT NULL THEN 'paper_id' WHEN e.r IS NOT NULL THEN 'external_id' END AS way FROM q LEFT JOIN i ON i.paper_id = q.requested LEFT JOIN e ON e.v = q.requested",
    "context_window": f"SELECT user_id, event_id, back, used FROM (SELECT user_id, event_id, CAST(row_number() OVER w AS INT) AS back, CAST(sum({_TOK}) OVER w AS BIGINT) AS used FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts DESC, event_id DESC ROWS UNBOUNDED PRECEDING)) WHERE back = 1 OR used <= 60",
    "last_messages": "SELECT user_id, event_id, back FROM (SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS INT) AS back FROM events) WHERE back <= 10",
    "summary_due": f"SELECT user_id, messages, since, tokens, (NOT a AND messages > 20) OR (a AND since > 10) OR tokens > 16000 AS due FROM (SELECT user_id, count(*) AS messages, count(*) FILTER (event_type <> 'signup') AS since, CAST(sum({_TOK}) AS BIGINT) AS tokens, bool_or(event_type = 'signup') AS a FROM events GROUP BY 1)",
    "next_assistant_turn": "WITH n AS (SELECT user_id, event_id, ts, event_type, count(*) FILTER (event_type = 'view') OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS turn FROM events WHERE event_type IN ('view', 'purchase')), r AS (SELECT user_id, turn, arg_min(event_id, (ts, event_id)) AS answer FROM n WHERE event_type = 'purchase' AND turn > 0 GROUP BY 1, 2) SELECT n.user_id, n.event_id AS question, r.answer FROM n LEFT JOIN r ON r.user_id = n.user_id AND r.turn = n.turn WHERE n.event_type = 'view'",
    "event_sequence": "SELECT event_id, user_id, sequence FROM (SELECT event_id, user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sequence FROM events) WHERE ts >= TIMESTAMP '2024-01-16'",
    "section_groups": "SELECT id, paper_id, CAST(sum(CASE WHEN label = 'section_header' THEN 1 ELSE 0 END) OVER (PARTITION BY paper_id ORDER BY id) AS BIGINT) AS section FROM paper_chunks WHERE paper_id IS NOT NULL",
    "page_anchors": "WITH s AS (SELECT id, paper_id, page_number, last_value(CASE WHEN label = 'section_header' THEN section_title END IGNORE NULLS) OVER (PARTITION BY paper_id ORDER BY id) AS anchor FROM paper_chunks WHERE paper_id IS NOT NULL), m AS (SELECT paper_id, page_number, min(id) AS id FROM s WHERE page_number IS NOT NULL GROUP BY 1, 2) SELECT m.paper_id, m.page_number, s.anchor FROM m JOIN s ON s.id = m.id",
    "aligned_authors": """WITH n AS (SELECT rec_id AS paper_id, rec_id AS a, lead(rec_id) OVER (PARTITION BY paper_id ORDER BY rec_id) AS b FROM paper_records WHERE paper_id IS NOT NULL),
      s AS (SELECT rec_id, pos, nullif(lower(list_extract(string_split_regex(trim(name, ' '), '\\s+'), -1)), '') AS s FROM (SELECT rec_id, generate_subscripts(authors, 1) - 1 AS pos, unnest(authors).name AS name FROM paper_records)),
      h AS (SELECT n.paper_id AS paper, x.pos AS l, y.pos AS r, CASE y.pos - x.pos WHEN 0 THEN 0 WHEN -1 THEN 1 WHEN 1 THEN 2 END AS t FROM n JOIN s x ON x.rec_id = n.a JOIN s y ON y.rec_id = n.b AND y.s = x.s AND abs(y.pos - x.pos) <= 1)
      SELECT paper, CAST(l AS INT) AS left_pos, CAST(arg_min(r, t) AS INT) AS right_pos FROM h GROUP BY paper, l""",
}
