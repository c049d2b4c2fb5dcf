"""Queries of the evaluation operators and text functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholion.functions import text as X
from scholion.operators import evaluate as E
from scholion.operators.search import bm25
from scholion.plans.search import K, RANKED, TITLES, bm25_sql, title_queries
from scholion.tables import table


def _run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25(title_queries(spark, sf_dir), table(spark, sf_dir, "paper_records").where("title is not null"), "rec_id", {"title": 1.0}, 20)


def _qrels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record is relevant to a query record of the same venue and year, and twice so if it is the same row."""
    r = table(spark, sf_dir, "paper_records").where("venue is not null and year is not null")
    q = r.where("rec_id % 50 = 0 and title is not null").select(F.col("rec_id").alias("query_id"), "venue", "year")
    return q.join(r.select(F.col("rec_id").alias("key"), "venue", "year"), ["venue", "year"]).select("query_id", "key", F.when(F.col("query_id") == F.col("key"), 2).otherwise(1).alias("rel"))


def ir_metrics_per_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = E.ir_metrics(_run(spark, sf_dir), _qrels(spark, sf_dir))
    return m.select("query_id", *(F.round(c, 9).alias(c) for c in m.columns[1:]))


def ir_metrics_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = E.mean_metrics(E.ir_metrics(_run(spark, sf_dir), _qrels(spark, sf_dir)))
    return m.select("queries", *(F.round(c, 9).alias(c) for c in m.columns[1:]))


def citation_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bracketed numbers of a document as citations of the sources of its language."""
    d = table(spark, sf_dir, "documents").where("text is not null").select(F.col("doc_id").alias("id"), F.col("text").alias("answer"), F.lit(30).alias("papers"))
    return E.numeric_citation_check(d).withColumn("accuracy", F.round("accuracy", 9))


def marker_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of documents as markers with a place, and sources as markers, against contexts that cite sources themselves."""
    d = table(spark, sf_dir, "documents").where("text is not null")
    answer = F.concat(F.regexp_replace("text", r"\[(\d+)\]", "(cite:$1|c)"), F.lit(" (cite:"), F.coalesce("source", F.lit("none")), F.lit(") (cite:S5) (cite:nowhere|x)"))
    contexts = F.array(F.col("section_title"), F.lit(""), F.lit("see (cite:S5)"), *(F.lit(f"c{i}") for i in range(20)))
    return E.citation_validity(d.select(F.col("doc_id").alias("id"), answer.alias("answer"), contexts.alias("contexts"), F.array(F.lit("beir"), F.lit(" tei ")).alias("paper_ids"), F.lit(None).cast("array<string>").alias("truth_ids"))).withColumn("validity", F.round("validity", 9))


def text_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as answers to the title of the record of the same number."""
    d = table(spark, sf_dir, "documents").where("text is not null").select(F.col("doc_id").alias("id"), F.col("text").alias("context"))
    r = table(spark, sf_dir, "paper_records").where("title is not null").select(F.col("rec_id").alias("id"), F.concat(F.col("title"), F.lit(". "), F.coalesce("venue", F.lit(""))).alias("answer"))
    return E.text_match(d.join(r, "id"), X.STOPWORDS).withColumn("percentage", F.round("percentage", 9))


def passage_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles as key passages of the chunks of their paper."""
    r = table(spark, sf_dir, "paper_records").where("title is not null").groupBy("paper_id").agg(F.min("title").alias("passage"))
    c = table(spark, sf_dir, "paper_chunks").where("text is not null").select("paper_id", F.col("text").alias("context"))
    pairs = r.join(c, "paper_id").select(F.col("paper_id").alias("id"), "passage", F.array("context").alias("contexts"))
    return E.passage_overlap(pairs).withColumn("overlap", F.round("overlap", 9))


def run_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = E.run_statistics(table(spark, sf_dir, "events"), "event_type", "value")
    return s.select("event_type", "runs", *(F.round(c, 6).alias(c) for c in ("mean", "least", "most", "median")))


def no_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where(E.says_no_evidence("text")).select("doc_id")


def pending_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without a vector: still to be embedded."""
    return E.pending(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id")), table(spark, sf_dir, "embeddings"), "vec_id")


def doi_and_issn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ISSNs of journals in both spellings, exploded."""
    j = table(spark, sf_dir, "journals").select("id", F.explode("issn").alias("raw"))
    return j.select("id", "raw", X.normalize_issn("raw").alias("issn"), F.explode_outer(X.issn_variants("raw")).alias("variant"))


def external_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "paper_records").where("external_ids is not null")
    return r.select("rec_id", F.explode(X.canonical_ids(F.col("external_ids"))).alias("id_kind", "id_value"))


def normalized_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "journals").select("id", X.normalize_title("title").alias("title"))


def surnames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "author_records").select("row_id", X.surname("name").alias("surname"))


def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.posexplode(X.sentences("text")).alias("pos", "sentence"))


def token_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of a title's tokens in the venue's name."""
    return table(spark, sf_dir, "paper_records").where("title is not null and venue is not null").select("rec_id", F.round(X.overlap_ratio("title", "venue"), 9).alias("overlap"))


def gibberish_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vowel ratio, entropy and identifier form of names as typed."""
    n = table(spark, sf_dir, "author_records").where("name is not null")
    return n.select("row_id", F.round(X.vowel_ratio("name"), 9).alias("vowels"), F.round(X.shannon_entropy("name"), 9).alias("entropy"), X.looks_like_identifier("openalex_id").alias("identifier"))


def section_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles that look like headings, texts that are formulas or boilerplate, and titles for comparison."""
    c = table(spark, sf_dir, "paper_chunks").where("section_title is not null")
    line = F.element_at(F.split("text", "\n"), 1)
    return c.select("id", X.is_section_header("section_title").alias("header"), X.is_formula(F.element_at(F.split("text", "\n"), -1)).alias("formula"), X.is_boilerplate(line).alias("boilerplate"), X.section_key(F.concat("section_title", F.lit(" / table  Evidence "))).alias("key"), X.truncated("section_title", 10).alias("short"))


def clean_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks without noise, by their hash."""
    noisy = F.concat(F.lit("Please cite this article as: "), F.col("text"))
    return table(spark, sf_dir, "paper_chunks").where("text is not null").select("id", F.md5(X.clean_noise(noisy)).alias("clean"), F.md5(X.plain_string("text")).alias("plain"), F.md5(X.question_key("text")).alias("question"))


def fields_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of study of both kinds in one list, each once whatever its case."""
    r = table(spark, sf_dir, "paper_records")
    both = F.concat(F.coalesce("fields_of_study", F.array().cast("array<string>")), F.coalesce(F.expr("transform(s2_fields_of_study, x -> x.category)"), F.array().cast("array<string>")))
    return r.select("rec_id", F.array_join(X.first_wins(both), "|").alias("fields"))


QUERIES = {
    f.__name__: f
    for f in (ir_metrics_per_query, ir_metrics_mean, citation_validity, marker_validity, text_match, passage_overlap, run_statistics, no_evidence, pending_rows, doi_and_issn, external_ids, normalized_titles, surnames, sentence_split, token_overlap, gibberish_flags, section_headers, clean_lines, fields_first_wins)
}

_RUN = bm25_sql("b", TITLES, "(SELECT * FROM paper_records WHERE title IS NOT NULL)", "rec_id", {"title": 1.0}, 20)
_QRELS = "qr AS (SELECT q.rec_id AS query_id, r.rec_id AS key, CASE WHEN q.rec_id = r.rec_id THEN 2 ELSE 1 END AS rel FROM paper_records q JOIN paper_records r ON r.venue = q.venue AND r.year = q.year WHERE q.rec_id % 50 = 0 AND q.title IS NOT NULL)"
_METRIC = []
for _k in (10, 20):
    _METRIC.append(f"hits{_k} / n{_k} AS precision_{_k}, hits{_k} / relevant AS recall_{_k}, CASE WHEN hits{_k} > 0 THEN 2.0 * (hits{_k} / n{_k}) * (hits{_k} / relevant) / (hits{_k} / n{_k} + hits{_k} / relevant) ELSE 0 END AS f1_{_k}, coalesce(dcg{_k} / nullif(idcg{_k}, 0), 0) AS ndcg_{_k}")
_IR = (
    f"WITH {_RUN}, {_QRELS}, j AS (SELECT b.query_id, b.rank AS r, coalesce(qr.rel, 0) AS rel FROM b LEFT JOIN qr ON qr.query_id = b.query_id AND qr.key = b.key), "
    "g AS (SELECT query_id, " + ", ".join(f"CAST(count(*) FILTER (r <= {k}) AS DOUBLE) AS n{k}, CAST(count(*) FILTER (r <= {k} AND rel > 0) AS DOUBLE) AS hits{k}, sum(rel / log2(r + 1)) FILTER (r <= {k}) AS dcg{k}" for k in (10, 20)) + ", min(r) FILTER (rel > 0) AS f FROM j GROUP BY 1), "
    "i AS (SELECT query_id, rel, row_number() OVER (PARTITION BY query_id ORDER BY rel DESC, key) AS i FROM qr), "
    "d AS (SELECT i.query_id, " + ", ".join(f"sum(rel / log2(i + 1)) FILTER (i <= least({k}, n{k})) AS idcg{k}" for k in (10, 20)) + " FROM i JOIN g ON g.query_id = i.query_id GROUP BY 1), "
    "v AS (SELECT query_id, CAST(count(*) AS DOUBLE) AS relevant FROM qr GROUP BY 1), "
    "m AS (SELECT v.query_id, " + ", ".join(_METRIC) + ", coalesce(1.0 / f, 0) AS mrr FROM v LEFT JOIN g ON g.query_id = v.query_id LEFT JOIN d ON d.query_id = v.query_id) "
)
_NAMES = [f"{m}_{k}" for k in (10, 20) for m in ("precision", "recall", "f1", "ndcg")] + ["mrr"]
_TOK = "list_distinct(regexp_extract_all(lower({0}), '[a-z0-9]+'))"
_TERMS = "list_filter(list_distinct(regexp_extract_all(lower({0}), '[a-z0-9_-]+')), lambda w: length(w) >= 4 AND w NOT IN " + str(X.STOPWORDS) + ")"
_SENT = "list_filter(list_transform(string_split_regex(regexp_replace({0}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: trim(s, ' ')), lambda s: s <> '')"
SQL = {
    "ir_metrics_per_query": _IR + "SELECT query_id, " + ", ".join(f"round({n}, 9) AS {n}" for n in _NAMES) + " FROM m",
    "ir_metrics_mean": _IR + "SELECT count(*) AS queries, " + ", ".join(f"round(avg({n}), 9) AS {n}" for n in _NAMES) + " FROM m",
    "citation_validity": "WITH c AS (SELECT doc_id AS id, list_distinct(list_transform(regexp_extract_all(text, '\\[(\\d{1,4})\\]', 1), lambda x: CAST(x AS INT))) AS c FROM documents WHERE text IS NOT NULL), d AS (SELECT id, CAST(len(c) AS INT) AS total, CAST(len(list_filter(c, lambda x: x BETWEEN 1 AND 30)) AS INT) AS correct FROM c) SELECT id, total, correct, total - correct AS hallucinated, greatest(0, 30 - total) AS missing, round(CASE WHEN total > 0 THEN correct / total ELSE 0 END, 9) AS accuracy FROM d",
    "marker_validity": "WITH c AS (SELECT doc_id AS id, list_distinct(list_transform(regexp_extract_all(regexp_replace(text, '\\[(\\d+)\\]', '(cite:\\1|c)', 'g') || ' (cite:' || coalesce(source, 'none') || ') (cite:S5) (cite:nowhere|x)', '(?i)\\(cite:([^)]+)\\)', 1), lambda x: trim(x, ' '))) AS c, 21 + CASE WHEN trim(coalesce(section_title, ''), ' ') <> '' THEN 1 ELSE 0 END AS n FROM documents WHERE text IS NOT NULL), b AS (SELECT id, n, list_transform(c, lambda x: trim(string_split(x, '|')[1], ' ')) AS b FROM c), d AS (SELECT id, CAST(len(b) AS INT) AS markers, CAST(len(list_filter(b, lambda x: CASE WHEN regexp_full_match(x, '\\d+') THEN CAST(x AS BIGINT) BETWEEN 1 AND n ELSE x IN ('beir', 'tei', 'S5') END)) AS INT) AS valid FROM b) SELECT id, markers, valid, round(valid / markers, 9) AS validity FROM d",
    "passage_overlap": f"WITH r AS (SELECT paper_id, min(title) AS passage FROM paper_records WHERE title IS NOT NULL GROUP BY 1), t AS (SELECT r.paper_id AS id, {_TOK.format('passage')} AS a, {_TOK.format('c.text')} AS b FROM r JOIN paper_chunks c ON c.paper_id = r.paper_id WHERE c.text IS NOT NULL) SELECT id, round(max(CASE WHEN len(a) > 0 THEN len(list_intersect(a, b)) / len(a) ELSE 0 END), 9) AS overlap FROM t GROUP BY id",
    "run_statistics": "SELECT event_type, count(*) AS runs, round(avg(value), 6) AS mean, round(min(value), 6) AS least, round(max(value), 6) AS most, round(median(value), 6) AS median FROM events GROUP BY 1",
    "no_evidence": "SELECT doc_id FROM documents WHERE " + " OR ".join("contains(lower(text), '" + p.replace("'", "''") + "')" for p in E.NO_EVIDENCE),
    "pending_rows": "SELECT doc_id AS vec_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)",
    "doi_and_issn": "WITH j AS (SELECT id, unnest(issn) AS raw FROM journals), n AS (SELECT id, raw, upper(regexp_replace(raw, '[\\s-]', '', 'g')) AS b FROM j), v AS (SELECT id, raw, CASE WHEN regexp_full_match(b, '\\d{7}[0-9X]') THEN b END AS issn FROM n) SELECT id, raw, issn, unnest(CASE WHEN issn IS NULL THEN [NULL] ELSE [issn, substr(issn, 1, 4) || '-' || substr(issn, 5, 4)] END) AS variant FROM v",
    "external_ids": "WITH e AS (SELECT rec_id, unnest(map_entries(external_ids)) AS e FROM paper_records WHERE external_ids IS NOT NULL) SELECT rec_id, CASE lower(e.key) WHEN 'corpusid' THEN 'corpus_id' WHEN 'pubmed' THEN 'pmid' WHEN 'pubmedcentral' THEN 'pmcid' ELSE lower(e.key) END AS id_kind, e.value AS id_value FROM e WHERE e.value IS NOT NULL",
    "normalized_titles": "SELECT id, trim(regexp_replace(regexp_replace(lower(title), '[^\\p{L}\\p{N}_\\s-]', '', 'g'), '\\s+', ' ', 'g')) AS title FROM journals",
    "surnames": "SELECT row_id, nullif(lower(list_extract(string_split_regex(trim(name), '\\s+'), -1)), '') AS surname FROM author_records",
    "token_overlap": f"SELECT rec_id, round(CASE WHEN len(a) > 0 THEN len(list_intersect(a, b)) / len(a) ELSE 0 END, 9) AS overlap FROM (SELECT rec_id, {_TOK.format('title')} AS a, {_TOK.format('venue')} AS b FROM paper_records WHERE title IS NOT NULL AND venue IS NOT NULL)",
    "gibberish_flags": "WITH n AS (SELECT row_id, name, openalex_id AS o, regexp_replace(lower(name), '[^a-z]', '', 'g') AS l, regexp_replace(lower(openalex_id), '[^a-z]', '', 'g') AS ol, string_split(replace(name, ' ', ''), '') AS c FROM author_records WHERE name IS NOT NULL) SELECT row_id, round(CASE WHEN length(l) = 0 THEN 0 WHEN length(l) < 3 THEN 1 ELSE length(regexp_replace(l, '[^aeiou]', '', 'g')) / length(l) END, 9) AS vowels, round(coalesce(list_aggregate(c, 'entropy'), 0), 9) AS entropy, regexp_matches(o, '^[a-zA-Z_][a-zA-Z0-9_]*\\d+') OR ((contains(o, '_') OR regexp_matches(lower(o), '[a-z][0-9]|[0-9][a-z]')) AND length(ol) > 2 AND length(regexp_replace(ol, '[^aeiou]', '', 'g')) / length(ol) < 0.25) AS identifier FROM n",
    "fields_first_wins": "WITH f AS (SELECT rec_id, list_concat(coalesce(fields_of_study, []), coalesce(list_transform(s2_fields_of_study, lambda x: x.category), [])) AS a FROM paper_records), e AS (SELECT rec_id, generate_subscripts(a, 1) AS p, unnest(a) AS v FROM f), d AS (SELECT rec_id, arg_min(v, p) AS v, min(p) AS p FROM e WHERE v IS NOT NULL GROUP BY rec_id, lower(v)), g AS (SELECT rec_id, string_agg(v, '|' ORDER BY p) AS fields FROM d GROUP BY rec_id) SELECT r.rec_id, coalesce(g.fields, '') AS fields FROM paper_records r LEFT JOIN g ON g.rec_id = r.rec_id",
    "section_headers": "WITH c AS (SELECT id, section_title, trim(section_title, ' ') AS t, string_split(text, chr(10))[-1] AS f, lower(trim(regexp_replace(coalesce(string_split(text, chr(10))[1], ''), '\\s+', ' ', 'g'), ' ')) AS b FROM paper_chunks WHERE section_title IS NOT NULL) SELECT id, length(t) <= 120 AND NOT contains(t, chr(10)) AND regexp_matches(t, '^(\\d+(?:\\.\\d+)*)?\\s*[A-Z][A-Za-z0-9\\-,:()\\s]{2,}$') AS header, length(f) >= 40 AND (length(f) - length(translate(f, '" + X.FORMULA_SIGNS + "', ''))) / greatest(length(f), 1) > 0.08 AS formula, b = '' OR NOT regexp_matches(b, '[a-z0-9]') OR regexp_matches(b, '^please cite this article as:?$|^corresponding author|^tel\\s*\\+?\\d') AS boilerplate, lower(trim(regexp_replace(section_title, '\\s+', ' ', 'g'), ' ')) AS key, CASE WHEN length(section_title) > 10 THEN substr(section_title, 1, 7) || '...' ELSE section_title END AS short FROM c",
    "clean_lines": "SELECT id, md5(trim(regexp_replace(text, '[\\s\\p{Z}]+', ' ', 'g'), ' ')) AS clean, md5(trim(regexp_replace(translate(lower(text), '.,:;', ''), '[\\s\\p{Z}]+', ' ', 'g'), ' ')) AS plain, md5(trim(lower(regexp_replace(text, '[\\s\\p{Z}]+', ' ', 'g')), ' ')) AS question FROM paper_chunks WHERE text IS NOT NULL",
    "sentence_split": f"WITH d AS (SELECT doc_id, {_SENT.format('text')} AS s FROM documents) SELECT doc_id, CAST(generate_subscripts(s, 1) - 1 AS INT) AS pos, unnest(s) AS sentence FROM d",
    "text_match": f"""WITH p AS (SELECT d.doc_id AS id, lower(d.text) AS c, r.title || '. ' || coalesce(r.venue, '') AS a FROM documents d JOIN paper_records r ON r.rec_id = d.doc_id WHERE d.text IS NOT NULL AND r.title IS NOT NULL),
      t AS (SELECT id, c, {_TERMS.format('a')} AS own, {_SENT.format('a')} AS s FROM p)
      SELECT id, CAST(len(own) AS INT) AS terms, CAST(len(list_filter(own, lambda t: contains(c, t))) AS INT) AS matched, round(CASE WHEN len(own) > 0 THEN 100.0 * len(list_filter(own, lambda t: contains(c, t))) / len(own) ELSE 0 END, 9) AS percentage,
        CAST(len(list_filter(s, lambda x: len(string_split_regex(trim(x, ' '), '\\s+')) >= 4 AND len({_TERMS.format('x')}) > 0 AND len(list_filter({_TERMS.format('x')}, lambda t: contains(c, t))) / len({_TERMS.format('x')}) < 0.4)) AS INT) AS suspicious FROM t""",
}
