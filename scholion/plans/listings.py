"""Queries of listings, lookups and changes of state. Events stand for messages and tasks, chunks for bookmarks and messages of papers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholion.operators import evaluate as E
from scholion.operators import ingest as I
from scholion.operators import listings as L
from scholion.operators.context import next_answer
from scholion.operators.search import best_scored, first_seen
from scholion.plans.graph import _CITE, citation_edges
from scholion.sources.files import coerced_list
from scholion.streaming.events import task_state
from scholion.tables import cut, table


def _first(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Columns of the first record of each paper id."""
    r = table(spark, sf_dir, "paper_records").where("paper_id is not null").groupBy(F.col("paper_id").alias("paper")).agg(F.min_by(F.struct(*columns), "rec_id").alias("r"))
    return r.select("paper", "r.*")


def conversation_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Papers as conversations, their chunks as messages: by title or EXISTS."""
    c = _first(spark, sf_dir, "title", "is_open_access", "fetched_at").select(F.col("paper").alias("id"), "title", F.when(F.col("is_open_access"), "single_paper").otherwise("chat").alias("kind"), F.col("fetched_at").alias("updated"))
    m = table(spark, sf_dir, "paper_chunks").select(F.col("paper_id").alias("conversation"), "text", F.col("label").isNotNull().alias("active"))
    return L.conversation_search(c, m, "seasonal").select("id", "updated", "rank")


def bookmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = table(spark, sf_dir, "paper_chunks").select("id", F.col("paper_id").alias("paper"), F.col("section_title").alias("notes"), F.col("label").isNotNull().alias("active"))
    papers = _first(spark, sf_dir, "title", "venue", "year", "citation_count", "is_open_access").withColumnsRenamed({"citation_count": "citations", "is_open_access": "open_access"})
    authors = table(spark, sf_dir, "paper_records").where("paper_id is not null").select(F.col("paper_id").alias("paper"), F.explode("authors.name").alias("name"))
    return L.bookmarks(marks, papers, authors, "and", has_notes=True).select("id", "paper", "hits", "total", "next_offset")


def author_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "author_records").select(F.col("row_id").alias("id"), "name", F.col("citation_count").alias("citations"), "verified")
    return L.people(a, "an", verified=True, offset=10).select("id", "name", "citations", "total", "next_offset")


def institution_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = table(spark, sf_dir, "institutions")
    return L.people(i, "of", ("display_name",), by="total_papers", key="institution_id", type="education").select("institution_id", "total_papers", "total", "next_offset")


def validation_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors as checks of chunks."""
    checks = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.pmod("event_id", F.lit(1500)).alias("message"), F.col("ts").alias("created"), "event_type")
    m = table(spark, sf_dir, "paper_chunks").select("id", F.col("paper_id").alias("conversation"), "text")
    return L.history(checks, m, F.col("event_type") == "error", offset=50).select("id", "conversation", F.md5("preview").alias("preview"), "total", "next_offset")


def messages_by_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.messages_where(table(spark, sf_dir, "events"), "user_id", "props", "k", "7", F.col("event_type") != "error").select("event_id", "user_id", "ts")


def open_access_pdfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An id of another index stands for the address."""
    return L.open_access_pdfs(table(spark, sf_dir, "paper_records"), "is_open_access", F.col("external_ids")["MAG"]).select("rec_id")


def newest_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.newest(table(spark, sf_dir, "events"), ["user_id", "event_type"], [F.col("ts").desc_nulls_last(), F.col("event_id").desc()]).select("user_id", "event_type", "event_id", "place")


def stale_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "author_profiles").select("profile_id", L.stale(F.col("fetched_at"), F.lit("2025-05-01").cast("timestamp")).alias("stale"))


def merged_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = F.create_map(F.lit("OpenAlex"), F.col("source"), F.lit("row"), F.col("rec_id").cast("string"))
    return table(spark, sf_dir, "paper_records").select("rec_id", F.explode(L.merged_maps(F.col("external_ids"), new)).alias("k", "v"))


def insert_or_touch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Venues known from one source, and met again in the other."""
    r = table(spark, sf_dir, "paper_records").where("venue is not null").select("venue", "paper_id", F.col("fetched_at").alias("at"), "rec_id", "source")
    old = r.where("source = 'openalex'").groupBy("venue").agg(F.min_by("paper_id", "rec_id").alias("paper_id"), F.max("at").alias("at"))
    return L.insert_or_touch(old, r.where("source = 'semantic_scholar'"), "venue", "at", "rec_id").select("venue", "paper_id", "at")


def _conversations(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, sf_dir, "events")
    heads = e.select(F.col("user_id").alias("conversation"), F.col("user_id").alias("user")).distinct()
    wanted = heads.select("conversation", (F.col("user") + F.col("conversation") % 2).alias("user"), (F.col("conversation") + 5000).alias("new_id"))
    return L.cloned(heads, e.select(F.col("event_id").alias("id"), F.col("user_id").alias("conversation"), F.col("user_id").alias("user")), wanted)


def cloned_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _conversations(spark, sf_dir)[0]


def cloned_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _conversations(spark, sf_dir)[1]


def soft_deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views of a large value are deleted, and the purchase that answers each."""
    e = table(spark, sf_dir, "events")
    answers = next_answer(e, "user_id", ["ts", "event_id"], "event_type", "view", "purchase", "event_id").select("question", "answer")
    m = e.select(F.col("event_id").alias("id"), (F.col("event_type") != "error").alias("active"))
    return L.soft_deleted(m, e.where("event_type = 'view' and value > 50").select(F.col("event_id").alias("id")), answers)


def _status(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    names = F.create_map(*(F.lit(x) for p in (("click", "pending"), ("view", "processing"), ("purchase", "completed"), ("error", "failed")) for x in p))
    return L.status_table(e.select("user_id", "event_id", F.coalesce(names[F.col("event_type")], F.lit("pending")).alias("status"), F.when(F.col("event_type") == "error", F.col("props")).alias("error")), "user_id", "event_id")


def task_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _status(spark, sf_dir)


def job_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.job_counters(_status(spark, sf_dir))


def event_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of events, largest sequence and whether a task is done."""
    return task_state(table(spark, sf_dir, "events"), "user_id", "event_id", "purchase")


def papers_with_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "paper_records")
    links = r.select(F.col("rec_id").alias("paper"), F.posexplode("authors").alias("position", "a")).select("paper", "position", F.col("a.author_id").alias("author"))
    p = table(spark, sf_dir, "author_profiles").withColumn("author", F.coalesce("openalex_id", "s2_author_id")).where("author is not null").groupBy("author").agg(F.min("profile_id").alias("profile_id"))
    return L.papers_with_authors(r.select(F.col("rec_id").alias("paper"), "year"), links, p).select("paper", "position", "author", "profile_id")


def citing_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("paper"), F.year("o_orderdate").alias("year"))
    return L.citing_page(citation_edges(spark, sf_dir), o, "citing", 5, 1)


def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Papers of chunks by their id, and records by the chunk's number."""
    c = table(spark, sf_dir, "paper_chunks")
    wanted = c.select(F.col("paper_id").alias("value")).unionByName(c.select(F.col("id").cast("string").alias("value")))
    return L.point_lookup(table(spark, sf_dir, "paper_records").select("rec_id", "paper_id"), wanted, "rec_id", "paper_id")


def first_seen_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first_seen(table(spark, sf_dir, "paper_chunks").select("paper_id", "id", "label"), ["paper_id"], "id")


def best_scored_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_scored(table(spark, sf_dir, "paper_chunks").where("token_count is not null").select("paper_id", "id", F.col("token_count").alias("score")), ["paper_id"], "id")


def mean_with_skips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts as text, some of them no numbers; chunks without a label are skipped."""
    rows = table(spark, sf_dir, "paper_chunks").select(F.when(F.col("page_number") == 2, "n/a").otherwise(F.col("token_count").cast("string")).alias("v"), F.col("label").isNull().alias("skip"))
    return E.mean_with_skips(rows, "v", "skip").withColumn("mean", F.round("mean", 9))


def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newer deliveries overwrite the first of their cluster in every field."""
    a = table(spark, sf_dir, "author_records").select("cluster_id", "row_id", "name", "h_index")
    first = a.groupBy("cluster_id").agg(F.min("row_id").alias("first"))
    old = a.join(first, "cluster_id").where("row_id = first").drop("first")
    new = a.join(first, "cluster_id").where("row_id > first").drop("first")
    return I.upsert_latest(old, new, ["cluster_id"], "row_id")


def coerced_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of study as JSON text, as text with bars, or blank."""
    r = table(spark, sf_dir, "paper_records").where("fields_of_study is not null")
    cell = F.expr("CASE rec_id % 3 WHEN 0 THEN to_json(fields_of_study) WHEN 1 THEN array_join(fields_of_study, ' | ') ELSE ' ' END")
    return r.select("rec_id", F.array_join(coerced_list(cell), ";").alias("fields"))


QUERIES = {
    f.__name__: f
    for f in (conversation_search, bookmarks, author_listing, institution_listing, validation_history, messages_by_metadata, open_access_pdfs, newest_tasks, stale_profiles, merged_maps, insert_or_touch, cloned_conversations, cloned_messages, soft_deleted, task_status, job_counters, event_state, papers_with_authors, citing_page, point_lookup, first_seen_chunks, best_scored_chunks, mean_with_skips, upsert_latest, coerced_lists)
}

_FIRST = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY rec_id) AS n FROM paper_records WHERE paper_id IS NOT NULL) WHERE n = 1)"
_STATUS = "(SELECT user_id, event_id, CASE event_type WHEN 'click' THEN 'pending' WHEN 'view' THEN 'processing' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'pending' END AS status, CASE WHEN event_type = 'error' THEN props END AS error FROM events)"
_STATES = f"SELECT user_id, arg_max(status, event_id) AS status, bool_or(status = 'completed') AS is_processed, arg_max(error, event_id) FILTER (error <> '') AS error, count(*) AS changes FROM {_STATUS} GROUP BY 1"


def _page(body: str, columns: str, order: str, offset: int, limit: int) -> str:
    return f"WITH x AS ({body}) SELECT {columns}, total, CAST(CASE WHEN {offset + limit} < total THEN {offset + limit} END AS INT) AS next_offset FROM (SELECT *, count(*) OVER () AS total FROM x) ORDER BY {order} LIMIT {limit} OFFSET {offset}"


SQL = {
    "conversation_search": f"WITH c AS (SELECT paper_id AS id, title, fetched_at AS updated FROM {_FIRST} WHERE NOT coalesce(is_open_access, false)) SELECT id, updated, CAST(row_number() OVER (ORDER BY updated DESC NULLS LAST, id) AS INT) AS rank FROM c WHERE coalesce(contains(lower(title), 'seasonal'), false) OR EXISTS (SELECT 1 FROM paper_chunks m WHERE m.paper_id = c.id AND m.label IS NOT NULL AND contains(lower(m.text), 'seasonal'))",
    "bookmarks": _page(f"SELECT m.id, m.paper_id AS paper, CASE WHEN list_contains(w.ws, 'and') THEN CAST(len(list_filter(w.ws, lambda x: x = 'and')) AS INT) ELSE 0 END AS hits FROM paper_chunks m LEFT JOIN {_FIRST} p ON p.paper_id = m.paper_id, LATERAL (SELECT regexp_extract_all(lower(concat_ws(' ', p.title, p.venue, m.section_title)), '[a-z0-9]+') AS ws) w WHERE m.label IS NOT NULL AND length(trim(coalesce(m.section_title, ''), ' ')) > 0 AND (list_contains(w.ws, 'and') OR m.paper_id IN (SELECT paper_id FROM (SELECT paper_id, unnest(authors) AS a FROM paper_records WHERE paper_id IS NOT NULL) WHERE contains(lower(a.name), 'and')))", "id, paper, hits", "hits DESC NULLS LAST, id DESC", 0, 50),
    "author_listing": _page("SELECT row_id AS id, name, citation_count AS citations FROM author_records WHERE verified AND contains(lower(name), 'an')", "id, name, citations", "citations DESC NULLS LAST, id", 10, 20),
    "institution_listing": _page("SELECT institution_id, total_papers FROM institutions WHERE type = 'education' AND contains(lower(display_name), 'of')", "institution_id, total_papers", "total_papers DESC NULLS LAST, institution_id", 0, 20),
    "validation_history": _page("SELECT e.event_id AS id, c.paper_id AS conversation, md5(nullif(substr(c.text, 1, 280), '')) AS preview, e.ts FROM events e LEFT JOIN paper_chunks c ON c.id = e.event_id % 1500 WHERE e.event_type = 'error'", "id, conversation, preview", "ts DESC NULLS LAST, id", 50, 50),
    "messages_by_metadata": "SELECT event_id, user_id, ts FROM events WHERE json_extract_string(props, '$.k') = '7' AND event_type <> 'error'",
    "open_access_pdfs": "SELECT rec_id FROM paper_records WHERE is_open_access AND trim(coalesce(external_ids['MAG'], ''), ' ') <> ''",
    "newest_tasks": "SELECT user_id, event_type, event_id, place FROM (SELECT *, CAST(row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC NULLS LAST, event_id DESC) AS INT) AS place FROM events) WHERE place <= 20",
    "stale_profiles": "SELECT profile_id, fetched_at IS NULL OR TIMESTAMPTZ '2025-05-01 00:00:00+00' - fetched_at > INTERVAL 30 DAY AS stale FROM author_profiles",
    "merged_maps": "WITH o AS (SELECT rec_id, unnest(map_entries(external_ids)) AS e FROM paper_records) SELECT rec_id, e.key AS k, e.value AS v FROM o WHERE e.key NOT IN ('OpenAlex', 'row') UNION ALL SELECT rec_id, 'OpenAlex', source FROM paper_records UNION ALL SELECT rec_id, 'row', CAST(rec_id AS VARCHAR) FROM paper_records",
    "insert_or_touch": "WITH g AS (SELECT venue, source, arg_min(paper_id, rec_id) AS paper_id, max(fetched_at) AS at FROM paper_records WHERE venue IS NOT NULL GROUP BY 1, 2), a AS (SELECT * FROM g WHERE source = 'openalex'), b AS (SELECT * FROM g WHERE source = 'semantic_scholar') SELECT coalesce(a.venue, b.venue) AS venue, CASE WHEN a.venue IS NOT NULL THEN a.paper_id ELSE b.paper_id END AS paper_id, coalesce(b.at, a.at) AS at FROM a FULL JOIN b ON a.venue = b.venue",
    "cloned_conversations": "SELECT user_id + 5000 AS conversation, user_id + 1 AS user, user_id AS copied_from, count(*) AS messages FROM events WHERE user_id % 2 = 1 GROUP BY user_id",
    "cloned_messages": "SELECT user_id + 5000 AS conversation, user_id + 1 AS user, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS INT) AS place, event_id AS copied_from FROM events WHERE user_id % 2 = 1",
    "soft_deleted": "WITH n AS (SELECT user_id, event_id, ts, event_type, value, count(*) FILTER (event_type = 'view') OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS turn FROM events WHERE event_type IN ('view', 'purchase')), r AS (SELECT user_id, turn, arg_min(event_id, (ts, event_id)) AS answer FROM n WHERE event_type = 'purchase' AND turn > 0 GROUP BY 1, 2), d AS (SELECT event_id, user_id, turn FROM n WHERE event_type = 'view' AND value > 50), g AS (SELECT event_id FROM d UNION SELECT r.answer FROM d JOIN r ON r.user_id = d.user_id AND r.turn = d.turn) SELECT e.event_id AS id, e.event_type <> 'error' AND e.event_id NOT IN (SELECT event_id FROM g) AS active FROM events e",
    "task_status": _STATES,
    "job_counters": f"SELECT count(*) AS total, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'processing') AS processing, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed FROM ({_STATES})",
    "event_state": "SELECT user_id, count(*) AS events, max(event_id) AS max_sequence, bool_or(event_type = 'purchase') AS has_done FROM events GROUP BY 1",
    "papers_with_authors": "WITH l AS (SELECT rec_id, CAST(generate_subscripts(authors, 1) - 1 AS INT) AS position, unnest(authors).author_id AS author FROM paper_records), p AS (SELECT coalesce(openalex_id, s2_author_id) AS author, min(profile_id) AS profile_id FROM author_profiles WHERE coalesce(openalex_id, s2_author_id) IS NOT NULL GROUP BY 1) SELECT r.rec_id AS paper, l.position, l.author, p.profile_id FROM paper_records r LEFT JOIN l ON l.rec_id = r.rec_id LEFT JOIN p ON p.author = l.author",
    "citing_page": f"SELECT paper, other, year, place FROM (SELECT c.cited AS paper, c.citing AS other, CAST(year(o.o_orderdate) AS INT) AS year, CAST(row_number() OVER (PARTITION BY c.cited ORDER BY year(o.o_orderdate) DESC NULLS LAST, c.citing) AS INT) AS place FROM ({_CITE}) c JOIN orders o ON o.o_orderkey = c.citing) WHERE place BETWEEN 2 AND 6",
    "point_lookup": "WITH w AS (SELECT DISTINCT trim(v, ' ') AS value FROM (SELECT paper_id AS v FROM paper_chunks UNION ALL SELECT CAST(id AS VARCHAR) FROM paper_chunks) WHERE v IS NOT NULL) SELECT w.value, r.rec_id, r.paper_id FROM w JOIN paper_records r ON CASE WHEN regexp_full_match(w.value, '\\d+') THEN CAST(r.rec_id AS VARCHAR) = w.value ELSE r.paper_id = w.value END",
    "first_seen_chunks": "SELECT paper_id, id, label FROM (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY id) AS n FROM paper_chunks) WHERE n = 1",
    "best_scored_chunks": "SELECT paper_id, id, token_count AS score FROM (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY token_count DESC, id) AS n FROM paper_chunks WHERE token_count IS NOT NULL) WHERE n = 1",
    "mean_with_skips": "SELECT round(avg(token_count), 9) AS mean, count(token_count) AS used FROM paper_chunks WHERE label IS NOT NULL AND coalesce(page_number, 0) <> 2",
    "upsert_latest": "SELECT cluster_id, row_id, name, h_index FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY row_id DESC) AS n FROM author_records) WHERE n = 1",
    "coerced_lists": "SELECT rec_id, CASE WHEN rec_id % 3 = 2 THEN '' ELSE coalesce(array_to_string(list_filter(list_transform(fields_of_study, lambda x: trim(x, ' ')), lambda x: x <> ''), ';'), '') END AS fields FROM paper_records WHERE fields_of_study IS NOT NULL",
}
