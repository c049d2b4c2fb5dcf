"""Queries of the answer operators, and selectors of what is still to be done."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scholion.functions.text import GREETINGS
from scholion.functions.text import scoped_citations as scoped
from scholion.operators import answers as A
from scholion.operators.listings import lacking
from scholion.operators.search import bm25, cosine_topk
from scholion.plans import corpus as C
from scholion.plans.search import RANKED, bm25_sql, cosine_sql, vector_queries
from scholion.tables import cut, table


def boosted_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = cosine_topk(vector_queries(spark, sf_dir), table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 30)
    out = A.boosted_similarity(hits.drop("rank"), "score", F.col("key") % 3 == 0, k=10)
    return out.select("query_id", "key", F.round("boosted", 6).alias("boosted"), "rank")


def valid_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "paper_records").select("rec_id", "title", "venue", "publication_date", "year")
    return A.valid_rows(r, {"question": ("title",), "date": ("publication_date", "year"), "place": ("venue",)}).select("rec_id", "question", "date", "place")


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers that cite: each record's title and venue, with its paper's id and a place in it."""
    r = table(spark, sf_dir, "paper_records")
    cite = F.concat(F.lit(" (cite:"), F.coalesce("paper_id", F.lit("none")), F.lit(")"))
    return r.select(F.col("rec_id").alias("id"), F.concat(F.coalesce("title", F.lit("")), cite, F.lit(". "), F.coalesce("venue", F.lit("")), cite, F.lit(" and so on (cite:"), F.col("source"), F.lit("|C"), F.col("rec_id"), F.lit("|3|41) (cite:a|b) (cite:7) (cite:12)")).alias("answer"))


def claims_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = A.claims_by_source(_answers(spark, sf_dir))
    return c.select("id", "source", "claims", "first", "longest", "confidence")


def scoped_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _answers(spark, sf_dir)
    return a.select("id", F.explode(scoped(F.col("answer"))).alias("c")).select("id", "c.*")


def id_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.grouped_ids(table(spark, sf_dir, "paper_records"), "venue", "paper_id")


def value_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = A.spread(table(spark, sf_dir, "paper_records"), "source", "citation_count")
    return s.withColumn("mean", F.round("mean", 9)).withColumn("median", F.round("median", 9))


def _contexts(spark: SparkSession, sf_dir: str, with_dois: bool = False) -> DataFrame:
    """Contexts of the stated queries: the five papers of nearest title and their first twenty chunks; papers' ids stand for DOIs on request."""
    p, c = cut(C.papers(spark, sf_dir)), C.chunks(spark, sf_dir)
    if with_dois:
        p = p.withColumn("doi", F.concat(F.lit("10.1234/"), F.lower("paper")))
    hits = cut(bm25(C.questions(spark, sf_dir), p, "paper", {"title": 1.0}, 5).select("query_id", "rank", F.col("key").alias("paper")))
    top = Window.partitionBy("query_id").orderBy("chunk_id")
    own = hits.select("query_id", "paper").join(c, "paper").withColumn("rank", F.row_number().over(top)).where("rank <= 20")
    return A.assembled_context(hits.join(p.select("paper", "title", "year", "doi", F.col("quartile").alias("citation")), "paper"), own)


def assembled_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _contexts(spark, sf_dir).select("query_id", F.md5("context").alias("context"), "papers", "chunks")


def context_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The papers and chunks that contexts name."""
    named = F.explode(F.concat(F.transform(A.context_papers("context"), lambda x: F.struct(F.lit("paper").alias("kind"), x.alias("named"))), F.transform(A.context_chunks("context"), lambda x: F.struct(F.lit("chunk").alias("kind"), x.alias("named")))))
    return cut(_contexts(spark, sf_dir)).select("query_id", named.alias("n")).select("query_id", "n.*")


def context_legend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut(_contexts(spark, sf_dir)).select("query_id", F.explode(A.context_legend("context")).alias("l")).select("query_id", "l.*")


def context_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of contexts read back, and the source numbers in them."""
    c = cut(_contexts(spark, sf_dir))
    return c.select("query_id", F.size(A.context_passages("context")).alias("passages"), F.array_join(A.context_sources("context"), ",").alias("sources"))


def validation_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stated titles as questions of two datasets, their venues as answers; every other question asks for its own paper, the others for an unknown one."""
    r = table(spark, sf_dir, "paper_records").where("rec_id % 50 = 0 and title is not null")
    checks = cut(_contexts(spark, sf_dir, True)).join(r.select(F.col("rec_id").alias("query_id"), F.upper("title").alias("question")), "query_id").select(F.col("query_id").alias("id"), "question", F.col("query_id").alias("message"), "context", F.when(F.col("query_id") % 350 == 0, "failed").otherwise("completed").alias("status"))
    own = F.concat(F.lit("https://doi.org/10.1234/"), F.coalesce("paper_id", F.lit("none")))
    q = r.select(F.explode(F.array(F.struct(F.lit("litqa").alias("dataset"), F.lit(0).alias("priority")), F.struct(F.lit("scifact").alias("dataset"), F.lit(1).alias("priority")))).alias("d"), F.col("title").alias("text"), F.array(F.when(F.col("rec_id") % 100 == 0, own).otherwise("10.1234/w98000000001"), F.lit("none")).alias("doi"), F.col("venue").alias("key_passage"), F.lit("").alias("ideal"), "rec_id")
    q = q.where("d.dataset = 'scifact' or rec_id % 150 = 0").select("d.dataset", "d.priority", "text", "doi", "key_passage", "ideal")
    p = C.papers(spark, sf_dir).select("paper", F.concat(F.lit("10.1234/"), F.lower("paper")).alias("doi"))
    e = A.validation_export(checks, r.select(F.col("rec_id").alias("message"), F.col("venue").alias("content")), q, p)
    return e.select("id", "dataset", "answer", F.size("contexts").alias("contexts"), F.array_join("paper_ids", ",").alias("paper_ids"), F.array_join("truth_ids", ",").alias("truth_ids"), F.array_join("doi", ",").alias("doi"), "ground_truth")


def query_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plans read from answers of several shapes, built from records: whole, with fields of a wrong kind, and no JSON at all."""
    r = table(spark, sf_dir, "paper_records")
    shape = F.col("rec_id") % 4
    whole = F.to_json(F.struct(F.col("venue").alias("clarified_question"), F.col("fields_of_study").alias("hybrid_queries"), F.lit("Author_Papers ").alias("intent"), F.lit(True).alias("has_doi"), F.struct("year").alias("filters"), F.array(F.lit("A"), F.lit(" ")).alias("skip")))
    odd = F.to_json(F.struct(F.lit("x").alias("hybrid_queries"), F.lit("nonsense").alias("intent"), F.lit("true").alias("has_doi"), F.lit("a, B,").alias("skip")))
    answer = F.when(shape == 0, whole).when(shape == 1, odd).when(shape == 2, "no plan").otherwise("{}")
    p = r.select("rec_id", A.query_plan(answer, F.coalesce("title", F.lit(""))).alias("p"))
    return p.select("rec_id", "p.question", F.array_join("p.queries", "|").alias("queries"), F.size("p.papers").alias("papers"), "p.intent", F.array_join("p.skip", "|").alias("skip"), "p.has_doi")


def gibberish(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names, ids and titles as questions; the words in use are those of the documents."""
    words = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("word")).where("length(word) > 1").distinct()
    r = table(spark, sf_dir, "author_records")
    asked = r.select("row_id", F.expr("CASE row_id % 3 WHEN 0 THEN name WHEN 1 THEN openalex_id ELSE substring(name, 1, 4) END").alias("text"))
    return A.gibberish(asked, "row_id", "text", words)


def fenced_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Properties of events as a fenced answer."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", A.fenced_json(F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n```")), "k int")["k"].alias("k"))


def new_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "paper_records")
    asked = F.coalesce(F.expr("transform(s2_fields_of_study, x -> x.category)"), F.array().cast("array<string>"))
    return r.select("rec_id", F.array_join(A.new_queries(F.filter(asked, lambda x: x.isNotNull()), F.coalesce("fields_of_study", F.array().cast("array<string>"))), "|").alias("fresh"))


def merged_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles and venues as two rounds of search over the chunks."""
    r = table(spark, sf_dir, "paper_records").where("rec_id % 50 = 0")
    c = table(spark, sf_dir, "paper_chunks").where("paper_id is not null")
    rounds = None
    for column in ("title", "venue"):
        hits = bm25(r.where(F.col(column).isNotNull()).select(F.col("rec_id").alias("query_id"), F.col(column).alias("text")), c, "id", {"text": 1.0}, 20)
        rounds = hits if rounds is None else rounds.unionByName(hits)
    out = A.merged_rounds(rounds, c.select(F.col("id").alias("key"), F.col("paper_id").alias("paper")), 10)
    return out.select("query_id", "paper", F.round("chunk_score", 6).alias("chunk_score"), F.round("rrf", 6).alias("rrf"), "rank")


def null_as_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = A.null_as_zero_means(table(spark, sf_dir, "author_records"), ["citation_count", "h_index"], {"verified_papers": F.when(F.col("verified"), F.col("paper_count"))})
    return m.select("rows", *(F.round(c, 9).alias(c) for c in ("citation_count", "h_index", "verified_papers")))


def to_do(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest records of each kind that lack something: a nested document, authors, or a venue."""
    kinds = {"document": F.col("openalex_data").isNull(), "authors": F.coalesce(F.size("authors"), F.lit(0)) <= 0, "venue": F.coalesce(F.trim("venue"), F.lit("")) == ""}
    return lacking(table(spark, sf_dir, "paper_records"), kinds, [F.col("created_at").desc_nulls_last(), F.col("rec_id")], 20).select("kind", "rec_id")


QUERIES = {f.__name__: f for f in (boosted_similarity, valid_rows, claims_by_source, scoped_citations, id_groups, value_spread, assembled_context, context_evidence, context_legend, context_passages, validation_export, query_plans, gibberish, fenced_json, new_queries, merged_rounds, null_as_zero, to_do)}

_SCOPED = "\\(cite:([^|)]+)\\|([^|)]+)(?:\\|(\\d+)\\|(\\d+))?\\)"
_ANSWER = "SELECT rec_id AS id, coalesce(title, '') || ' (cite:' || coalesce(paper_id, 'none') || '). ' || coalesce(venue, '') || ' (cite:' || coalesce(paper_id, 'none') || ') and so on (cite:' || source || '|C' || rec_id || '|3|41) (cite:a|b) (cite:7) (cite:12)' AS answer FROM paper_records"
_MARKS = f"an AS ({_ANSWER}), sp AS (SELECT id, answer, string_split_regex(answer, '\\(cite:[^)]+\\)') AS parts, regexp_extract_all(answer, '\\(cite:[^)]+\\)') AS ms FROM an), mk AS (SELECT id, answer, list_transform(generate_series(1, len(ms)), lambda i: {{'mark': ms[i], 'source': regexp_extract(ms[i], '\\(cite:([^)]+)\\)', 1), 'pos': CAST(list_sum(list_transform(parts[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i-1], lambda x: length(x))), 0) AS BIGINT)}}) AS marks FROM sp)"
_CONTEXT = f"""WITH {C.PAPERS}, {C.CHUNKS}, {C.QUESTIONS}, {bm25_sql('b', 'SELECT query_id, text FROM qq', 'pp', 'paper', {'title': 1.0}, 5)},
      lg AS (SELECT b.query_id, CAST(b.rank - 1 AS INT) AS number, pp.paper, coalesce(pp.title, '') AS title, pp.year, pp.doi, pp.quartile FROM b JOIN pp ON pp.paper = b.key),
      ch AS (SELECT * FROM (SELECT lg.query_id, lg.number, cc.chunk_id, cc.section, cc.text, row_number() OVER (PARTITION BY lg.query_id ORDER BY cc.chunk_id) AS r FROM lg JOIN cc ON cc.paper = lg.paper) WHERE r <= 20),
      l2 AS (SELECT query_id, count(*) AS n, string_agg('PAPER ID: ' || number || ' | Title: ' || title || ' (' || coalesce(CAST(year AS VARCHAR), 'N/A') || ') | DOI: ' || coalesce(doi, 'N/A') || ' | APA: ' || coalesce(quartile, 'N/A'), chr(10) ORDER BY number) AS t FROM lg GROUP BY 1),
      c2 AS (SELECT query_id, count(*) AS n, string_agg('SOURCE_ID: ' || number || chr(10) || 'CHUNK_ID: ' || chunk_id || chr(10) || 'SECTION: ' || coalesce(nullif(section, ''), 'Main text') || chr(10) || 'CONTENT: ' || text, chr(10) || chr(10) ORDER BY r) AS t FROM ch GROUP BY 1),
      ctx AS (SELECT l2.query_id, '{A.LEGEND}' || chr(10) || l2.t || chr(10) || chr(10) || '{A.CONTENT}' || chr(10) || coalesce(c2.t, '') AS context, CAST(l2.n AS INT) AS papers, CAST(coalesce(c2.n, 0) AS INT) AS chunks FROM l2 LEFT JOIN c2 ON c2.query_id = l2.query_id)"""


_CONTEXT_DOI = _CONTEXT.replace("pp.year, pp.doi, pp.quartile", "pp.year, '10.1234/' || lower(pp.paper) AS doi, pp.quartile")


def _named(patterns: tuple[str, ...]) -> str:
    parts = [f"regexp_extract_all(context, '{p}', 1)" for p in patterns]
    out = parts[0]
    for p in parts[1:]:
        out = f"list_concat({out}, {p})"
    return out


_C = "(SELECT * FROM paper_chunks WHERE paper_id IS NOT NULL)"
SQL = {
    "boosted_similarity": f"WITH {cosine_sql('v', 'q.vec_id % 50 = 0', 30)}, b AS (SELECT query_id, key, score * CASE WHEN key % 3 = 0 THEN 1.1 ELSE 1.0 END AS score FROM v) SELECT query_id, key, round(score, 6) AS boosted, rank FROM (SELECT *, CAST({RANKED} AS INT) AS rank FROM b) WHERE rank <= 10",
    "valid_rows": "SELECT rec_id, trim(title, ' ') AS question, coalesce(nullif(trim(publication_date, ' '), ''), CAST(year AS VARCHAR)) AS date, trim(venue, ' ') AS place FROM paper_records WHERE trim(title, ' ') <> '' AND coalesce(nullif(trim(publication_date, ' '), ''), CAST(year AS VARCHAR)) IS NOT NULL AND trim(venue, ' ') <> ''",
    "claims_by_source": f"WITH {_MARKS}, c AS (SELECT id, m.source AS source, m.pos AS first, trim(substr(answer, greatest(m.pos - 150, 0) + 1, least(m.pos, 150)), ' ') AS w FROM (SELECT id, answer, unnest(marks) AS m FROM mk)), d AS (SELECT id, source, first, CASE WHEN contains(w, '.') THEN trim(string_split(w, '.')[-1], ' ') WHEN contains(w, '!') THEN trim(string_split(w, '!')[-1], ' ') WHEN contains(w, '?') THEN trim(string_split(w, '?')[-1], ' ') ELSE w END AS claim FROM c), g AS (SELECT id, source, count(*) AS claims, CAST(min(first) AS INT) AS first, arg_max(claim, length(claim) * 100000 - first) AS longest, floor(avg(length(claim))) AS mean FROM d GROUP BY 1, 2) SELECT id, source, claims, first, longest, CAST(round(greatest(0, least(1, 0.8 + 0.05 + CASE WHEN mean > 100 THEN 0.1 WHEN mean < 30 THEN -0.1 ELSE 0 END + CASE WHEN claims > 2 THEN 0.05 ELSE 0 END)), 9) AS DOUBLE) AS confidence FROM g",
    "scoped_citations": f"WITH {_MARKS} SELECT id, regexp_extract(m.mark, '{_SCOPED}', 1) AS paper, regexp_extract(m.mark, '{_SCOPED}', 2) AS chunk, TRY_CAST(regexp_extract(m.mark, '{_SCOPED}', 3) AS INT) AS char_start, TRY_CAST(regexp_extract(m.mark, '{_SCOPED}', 4) AS INT) AS char_end, CAST(m.pos AS INT) AS position, m.mark AS marker FROM (SELECT id, unnest(marks) AS m FROM mk) WHERE regexp_full_match(m.mark, '{_SCOPED}')",
    "id_groups": "SELECT venue, CAST(row_number() OVER (PARTITION BY venue ORDER BY paper_id) AS INT) AS pos, paper_id FROM (SELECT DISTINCT venue, paper_id FROM paper_records WHERE venue IS NOT NULL AND paper_id IS NOT NULL)",
    "value_spread": "SELECT source, round(avg(citation_count), 9) AS mean, round(median(citation_count), 9) AS median, min(citation_count) AS least, max(citation_count) AS most, count(DISTINCT citation_count) AS values FROM paper_records WHERE citation_count IS NOT NULL GROUP BY source",
    "assembled_context": f"{_CONTEXT} SELECT query_id, md5(context) AS context, papers, chunks FROM ctx",
    "context_evidence": f"{_CONTEXT}, n AS (SELECT query_id, 'paper' AS kind, unnest({_named(A.PAPER_NAMES)}) AS named FROM ctx UNION ALL SELECT query_id, 'chunk', unnest({_named(A.CHUNK_NAMES)}) FROM ctx) SELECT DISTINCT query_id, kind, regexp_replace(trim(named, ' '), '^,+|,+$', '', 'g') AS named FROM n",
    "context_legend": f"{_CONTEXT} SELECT query_id, number, trim(title, ' ') || ' (' || coalesce(CAST(year AS VARCHAR), 'N/A') || ')' AS title, coalesce(doi, 'N/A') AS doi, coalesce(quartile, 'N/A') AS apa FROM lg",
    "context_passages": f"{_CONTEXT} SELECT ctx.query_id, chunks AS passages, coalesce(s, '') AS sources FROM ctx LEFT JOIN (SELECT query_id, string_agg(CAST(number AS VARCHAR), ',' ORDER BY f) AS s FROM (SELECT query_id, number, min(r) AS f FROM ch GROUP BY 1, 2) GROUP BY 1) x ON x.query_id = ctx.query_id",
    "validation_export": f"""{_CONTEXT_DOI}, r AS (SELECT * FROM paper_records WHERE rec_id % 50 = 0 AND title IS NOT NULL), qs AS (SELECT lower(trim(regexp_replace(title, '[\\s\\p{{Z}}]+', ' ', 'g'), ' ')) AS k, CASE WHEN rec_id % 150 = 0 THEN 0 ELSE 1 END AS pr, CASE WHEN rec_id % 150 = 0 THEN 'litqa' ELSE 'scifact' END AS dataset, CASE WHEN rec_id % 100 = 0 THEN '10.1234/' || lower(coalesce(paper_id, 'none')) ELSE '10.1234/w98000000001' END AS doi, trim(coalesce(venue, ''), ' ') AS kp FROM r),
      q1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY pr, doi, kp) AS n FROM qs) WHERE n = 1), ck AS (SELECT ctx.query_id AS id, lower(trim(regexp_replace(upper(r.title), '[\\s\\p{{Z}}]+', ' ', 'g'), ' ')) AS k, ctx.context, ctx.chunks, trim(coalesce(r.venue, ''), ' ') AS answer FROM ctx JOIN r ON r.rec_id = ctx.query_id WHERE ctx.query_id % 350 <> 0),
      so AS (SELECT query_id, string_agg(CAST(number AS VARCHAR), ',' ORDER BY f) AS s FROM (SELECT query_id, number, min(r) AS f FROM ch GROUP BY 1, 2) GROUP BY 1), nu AS (SELECT ck.id, string_agg(CAST(lg.number AS VARCHAR), ',' ORDER BY lg.number) AS t FROM ck JOIN q1 ON q1.k = ck.k JOIN lg ON lg.query_id = ck.id AND lower(lg.doi) = q1.doi GROUP BY 1),
      pa AS (SELECT '10.1234/' || lower(paper) AS doi, string_agg(paper, ',' ORDER BY paper) AS t FROM pp GROUP BY 1)
      SELECT ck.id, q1.dataset, ck.answer, CAST(ck.chunks AS INT) AS contexts, coalesce(so.s, '') AS paper_ids, coalesce(nu.t, pa.t, '') AS truth_ids, q1.doi, q1.kp AS ground_truth FROM ck JOIN q1 ON q1.k = ck.k LEFT JOIN so ON so.query_id = ck.id LEFT JOIN nu ON nu.id = ck.id LEFT JOIN pa ON pa.doi = q1.doi WHERE ck.answer <> '' AND ck.chunks > 0""",
    "query_plans": "WITH p AS (SELECT *, rec_id % 4 AS k FROM paper_records) SELECT rec_id, trim(CASE WHEN k = 0 THEN coalesce(nullif(venue, ''), coalesce(title, '')) ELSE coalesce(title, '') END, ' ') AS question, CASE WHEN k = 0 THEN coalesce(array_to_string(list_filter(list_transform(fields_of_study, lambda x: trim(x, ' ')), lambda x: x <> ''), '|'), '') ELSE '' END AS queries, CAST(0 AS INT) AS papers, CASE WHEN k = 0 THEN 'author_papers' ELSE 'comprehensive_search' END AS intent, CASE k WHEN 0 THEN 'a' WHEN 1 THEN 'a|b' ELSE '' END AS skip, k IN (0, 1) AS has_doi FROM p",
    "gibberish": f"WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents), u AS (SELECT list(word) AS ws FROM w WHERE length(word) > 1), t AS (SELECT row_id, trim(CASE row_id % 3 WHEN 0 THEN name WHEN 1 THEN openalex_id ELSE substr(name, 1, 4) END, ' ') AS t FROM author_records), e AS (SELECT row_id, unnest(regexp_extract_all(lower(t), '[a-z]+')) AS word FROM t), s AS (SELECT e.row_id, avg(CASE WHEN length(e.word) > 1 AND w.word IS NOT NULL THEN 1 ELSE 0 END) AS share FROM e LEFT JOIN w ON w.word = e.word GROUP BY 1), p AS (SELECT t.row_id, t.t, coalesce(s.share, 0) AS share, regexp_replace(lower(t.t), '[^a-z]', '', 'g') AS l, string_split(replace(t.t, ' ', ''), '') AS c FROM t LEFT JOIN s ON s.row_id = t.row_id), v AS (SELECT *, CASE WHEN length(l) = 0 THEN 0 WHEN length(l) < 3 THEN 1 ELSE length(regexp_replace(l, '[^aeiou]', '', 'g')) / length(l) END AS v, length(regexp_replace(l, '[^aeiou]', '', 'g')) / nullif(length(l), 0) AS v2 FROM p), x AS (SELECT *, CAST(v < 0.2 OR v > 0.9 AS INT) + CAST(share < 0.3 AS INT) + CAST(coalesce(list_aggregate(c, 'entropy'), 0) > 4.5 AS INT) + CAST(length(l) > 5 AND NOT regexp_matches(l, '[aeiou]') AS INT) + CAST(len(list_filter(list_distinct(c), lambda y: y <> '' AND contains(t, repeat(y, 5)))) > 0 AS INT) AS score FROM v) SELECT row_id, coalesce(t = '' OR length(t) <= 2 OR lower(t) IN {GREETINGS} OR regexp_matches(t, '^[a-zA-Z_][a-zA-Z0-9_]*\\d+') OR ((contains(t, '_') OR regexp_matches(lower(t), '[a-z][0-9]|[0-9][a-z]')) AND length(l) > 2 AND v2 < 0.25) OR (length(t) <= 5 AND lower(t) NOT IN (SELECT word FROM w WHERE length(word) > 1)) OR score >= 2, true) AS gibberish, CAST(coalesce(score, 0) AS INT) AS score FROM x",
    "fenced_json": "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events",
    "merged_rounds": "WITH " + bm25_sql("a", "SELECT rec_id AS query_id, title AS text FROM paper_records WHERE rec_id % 50 = 0 AND title IS NOT NULL", _C, "id", {"text": 1.0}, 20) + ", " + bm25_sql("b", "SELECT rec_id AS query_id, venue AS text FROM paper_records WHERE rec_id % 50 = 0 AND venue IS NOT NULL", _C, "id", {"text": 1.0}, 20)
    + ", u AS (SELECT * FROM a UNION ALL SELECT * FROM b), f AS (SELECT query_id, key, sum(1.0 / (60 + rank)) AS r, max(score) AS score FROM u GROUP BY 1, 2), g AS (SELECT *, r / max(r) OVER (PARTITION BY query_id) AS share FROM f), p AS (SELECT query_id, c.paper_id AS paper, max(score) AS chunk_score, max(share) AS rrf FROM g JOIN paper_chunks c ON c.id = g.key GROUP BY 1, 2) "
    "SELECT query_id, paper, round(chunk_score, 6) AS chunk_score, round(rrf, 6) AS rrf, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(chunk_score, 9) DESC, round(rrf, 9) DESC, paper) AS INT) AS rank FROM p) WHERE rank <= 10",
    "null_as_zero": "SELECT count(*) AS rows, round(avg(coalesce(citation_count, 0)), 9) AS citation_count, round(avg(coalesce(h_index, 0)), 9) AS h_index, round(avg(paper_count) FILTER (verified), 9) AS verified_papers FROM author_records",
    "to_do": "WITH k AS (SELECT rec_id, created_at, unnest(list_filter([CASE WHEN openalex_data IS NULL THEN 'document' END, CASE WHEN coalesce(len(authors), 0) <= 0 THEN 'authors' END, CASE WHEN coalesce(trim(venue, ' '), '') = '' THEN 'venue' END], lambda x: x IS NOT NULL)) AS kind FROM paper_records) SELECT kind, rec_id FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY created_at DESC NULLS LAST, rec_id) AS n FROM k) WHERE n <= 20",
    "new_queries": "WITH e AS (SELECT rec_id, fields_of_study AS f, generate_subscripts(s2_fields_of_study, 1) AS p, unnest(s2_fields_of_study) AS x FROM paper_records), v AS (SELECT rec_id, x.category AS v, min(p) AS p FROM e WHERE x.category IS NOT NULL AND trim(x.category, ' ') <> '' AND NOT coalesce(list_contains(list_transform(f, lambda y: lower(trim(y, ' '))), lower(trim(x.category, ' '))), false) GROUP BY 1, 2), o AS (SELECT *, row_number() OVER (PARTITION BY rec_id ORDER BY p) AS n FROM v), g AS (SELECT rec_id, string_agg(v, '|' ORDER BY p) AS fresh FROM o WHERE n <= 2 GROUP BY 1) SELECT r.rec_id, coalesce(g.fresh, '') AS fresh FROM paper_records r LEFT JOIN g ON g.rec_id = r.rec_id",
}
