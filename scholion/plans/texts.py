"""Queries of identifiers, addresses, markup and search results in text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholion.functions import score as S
from scholion.functions import text as X
from scholion.sources.files import retrieval_log
from scholion.sources.markup import read_results, resolve_pdfs
from scholion.streaming.events import offered
from scholion.tables import table


def _written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A DOI of each record in one of several notations, some of them none."""
    r = table(spark, sf_dir, "paper_records").where("paper_id is not null")
    doi = F.concat(F.lit("10."), F.lit(1000) + F.col("rec_id") % 9000, F.lit("/"), F.col("paper_id"))
    forms = F.array(F.concat(F.lit("https://doi.org/"), doi), F.concat(F.lit("DOI: "), doi), F.concat(doi, F.lit("/")), F.concat(F.lit("http://dx.doi.org/"), doi), F.lit("10.12/x"), F.col("paper_id"), doi)
    return r.select("rec_id", F.get(forms, (F.col("rec_id") % 7).cast("int")).alias("written"), "title")


def normalized_dois(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _written(spark, sf_dir).select("rec_id", X.normalize_doi("written").alias("doi"))


def extracted_dois(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.coalesce("title", F.lit("")), F.lit(" (see "), F.col("written"), F.lit("), and "), F.col("written"), F.lit("."))
    return _written(spark, sf_dir).select("rec_id", F.explode(X.extract_dois(text)).alias("doi"))


def arxiv_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """arXiv ids in five forms, versions kept, and texts without one."""
    number = F.concat(F.lpad((F.col("rec_id") % 10_000).cast("string"), 4, "0"), F.lit("."), F.lpad((F.col("rec_id") % 100_000).cast("string"), 5, "0"), F.lit("v2"))
    forms = F.array(F.concat(F.lit("https://doi.org/10.48550/arXiv."), number), F.concat(F.lit("http://arxiv.org/pdf/"), number, F.lit(".pdf?x=1")), F.concat(F.lit("see arXiv:"), number, F.lit(" there")), number, F.concat(F.lit("hep-th/"), F.lpad(F.col("rec_id").cast("string"), 7, "0")), F.col("venue"))
    return table(spark, sf_dir, "paper_records").select("rec_id", X.extract_arxiv(F.get(forms, (F.col("rec_id") % 6).cast("int"))).alias("arxiv"))


def download_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _written(spark, sf_dir).select("rec_id", X.normalize_target("written").alias("target"))


def denied_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks as pages, with words of refusal put in, and servers as headers."""
    c = table(spark, sf_dir, "paper_chunks")
    said = F.get(F.array(*(F.lit(x) for x in ("checked by Cloudflare", "a reCAPTCHA", "please subscribe", "403 Forbidden", "", "akamai edge"))), (F.col("id") % 6).cast("int"))
    return c.select("id", X.denied_reason(F.concat_ws(" ", "text", said), F.when(F.col("id") % 12 == 4, "AkamaiGHost"), F.when(F.col("id") % 30 == 10, "ray")).alias("reason"))


def sanitized_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "paper_records").where("title is not null")
    t = F.when(F.col("rec_id") % 10 == 0, F.concat(F.lit("title:("), "title", F.lit(")"))).otherwise(F.concat(F.lit("it's "), "title", F.lit(' "x*"')))
    return r.select("rec_id", X.sanitized(t, ["title", "abstract"]).alias("query"))


def repaired_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain ASCII chunks with folded spaces and line ends, by their hash; normal forms are checked in the tests."""
    c = table(spark, sf_dir, "paper_chunks").where(F.col("text").rlike(r"^[\n\x20-\x7e]*$"))
    return c.select("id", F.md5(X.repaired_encoding(F.concat(F.col("text"), F.lit("  x\n\n\n\ny​€")))).alias("text"))


def result_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records put into a page of search results each, and read back."""
    esc = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    r = table(spark, sf_dir, "paper_records").where("title is not null and citation_count >= 0")
    page = F.concat(F.lit('<div class="gs_r"><h3><a href="https://x.example/'), F.col("rec_id"), F.lit('">[PDF] '), esc(F.col("title")), F.lit('</a></h3><div class="gs_a">'), esc(F.coalesce("source", F.lit(""))), F.lit('</div><div class="gs_rs">text</div><a>Cited by '), F.col("citation_count"), F.lit("</a></div>"))
    return read_results(r.select("rec_id", page.alias("html")), "rec_id", "html")


def pdf_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with a meta tag, an anchor and a quoted name of a PDF, made of records."""
    r = table(spark, sf_dir, "paper_records")
    page = F.concat(F.lit('<meta name="citation_pdf_url" content="/m/'), F.col("rec_id"), F.lit('.pdf"><a href="a/'), F.col("rec_id"), F.lit('.pdf">PDF</a><script>"/q/'), F.col("rec_id"), F.lit('.pdf"</script>'))
    return resolve_pdfs(r.select("rec_id", F.lit("https://x.example/d/p").alias("url"), page.alias("html")), "rec_id", "url", "html")


def retrieval_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of a retrieval log: records by source, with another index' id as address."""
    r = table(spark, sf_dir, "paper_records").withColumn("pdf_url", F.col("external_ids")["MAG"])
    return retrieval_log(r, ["source", "year"])


def weight_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weights of the scores as a table."""
    return spark.createDataFrame(sorted((k, float(v)) for k, v in S.WEIGHTS.items()), "component string, weight double")


def offered_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What subscribers with forty slots get of each user's events, and how many they lose."""
    return offered(table(spark, sf_dir, "events"), 40).select("user_id", "event_id", "slot", "dropped")


QUERIES = {f.__name__: f for f in (normalized_dois, extracted_dois, arxiv_ids, download_targets, denied_reasons, sanitized_queries, repaired_texts, result_pages, pdf_links, retrieval_counts, weight_sums, offered_events)}

_W = "w AS (SELECT rec_id, title, CASE rec_id % 7 WHEN 0 THEN 'https://doi.org/' || d WHEN 1 THEN 'DOI: ' || d WHEN 2 THEN d || '/' WHEN 3 THEN 'http://dx.doi.org/' || d WHEN 4 THEN '10.12/x' WHEN 5 THEN paper_id ELSE d END AS v FROM (SELECT *, '10.' || (1000 + rec_id % 9000) || '/' || paper_id AS d FROM paper_records WHERE paper_id IS NOT NULL))"
SQL = {
    "normalized_dois": f"WITH {_W}, b AS (SELECT rec_id, regexp_replace(regexp_replace(lower(trim(v, ' ')), '^(?:https?://)?(?:dx\\.)?doi\\.org/|^doi:\\s*', ''), '[/\\s]+$', '') AS b FROM w) SELECT rec_id, CASE WHEN regexp_full_match(b, '10\\.\\d{{4,9}}/\\S+') THEN b END AS doi FROM b",
    "extracted_dois": f"WITH {_W} SELECT rec_id, unnest(list_distinct(list_transform(regexp_extract_all(lower(coalesce(title, '') || ' (see ' || v || '), and ' || v || '.'), '10\\.\\d{{4,9}}/[^\\s\"<>]+'), lambda d: regexp_replace(d, '[.,;:)\\]]+$', '')))) AS doi FROM w",
    "arxiv_ids": "WITH n AS (SELECT rec_id, venue, lpad(CAST(rec_id % 10000 AS VARCHAR), 4, '0') || '.' || lpad(CAST(rec_id % 100000 AS VARCHAR), 5, '0') || 'v2' AS n FROM paper_records) SELECT rec_id, CASE WHEN rec_id % 6 < 4 THEN n WHEN rec_id % 6 = 4 THEN 'hep-th/' || lpad(CAST(rec_id AS VARCHAR), 7, '0') END AS arxiv FROM n",
    "download_targets": f"WITH {_W}, t AS (SELECT rec_id, trim(v, ' ') AS u FROM w) SELECT rec_id, CASE WHEN u IS NULL OR u = '' THEN NULL WHEN regexp_matches(u, '(?i)^https?://') THEN u WHEN regexp_matches(u, '(?i)^doi:') THEN 'https://doi.org/' || regexp_replace(u, '(?i)^doi:\\s*', '') WHEN starts_with(u, '10.') THEN 'https://doi.org/' || u ELSE 'https://' || u END AS target FROM t",
    "denied_reasons": "WITH c AS (SELECT id, lower(coalesce(text, '') || ' ' || ['checked by Cloudflare', 'a reCAPTCHA', 'please subscribe', '403 Forbidden', '', 'akamai edge'][id % 6 + 1]) AS m, id % 12 = 4 AS s, id % 30 = 10 AS r FROM paper_chunks) SELECT id, CASE WHEN contains(m, 'cloudflare') OR contains(m, 'cf-challenge') OR r THEN 'Cloudflare bot/challenge protection' WHEN contains(m, 'captcha') THEN 'CAPTCHA or human verification required' WHEN contains(m, 'paywall') OR contains(m, 'purchase') OR contains(m, 'subscribe') THEN 'Publisher paywall / subscription required' WHEN contains(m, 'access denied') OR contains(m, 'forbidden') THEN 'Generic access-control policy denied the request' WHEN contains(m, 'akamai') OR s THEN 'Akamai edge security policy denied the request' ELSE 'Unknown (inspect headers/body snippet)' END AS reason FROM c",
    "sanitized_queries": "WITH t AS (SELECT rec_id, CASE WHEN rec_id % 10 = 0 THEN 'title:(' || title || ')' ELSE 'it''s ' || title || ' \"x*\"' END AS t FROM paper_records WHERE title IS NOT NULL), w AS (SELECT rec_id, t, trim(regexp_replace(regexp_replace(replace(t, '''', ''), '[-+!(){}\\[\\]^\"~*?:\\\\/]', ' ', 'g'), '[\\s\\p{Z}]+', ' ', 'g'), ' ') AS w FROM t) SELECT rec_id, CASE WHEN contains(t, 'title:') OR contains(t, 'abstract:') THEN t WHEN w = '' THEN '' ELSE 'title:(' || w || ') OR abstract:(' || w || ')' END AS query FROM w",
    "repaired_texts": "SELECT id, md5(trim(regexp_replace(regexp_replace(text || '  x' || repeat(chr(10), 4) || 'ye', ' +', ' ', 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10))) AS text FROM paper_chunks WHERE regexp_full_match(text, '[\\n\\x20-\\x7e]*')",
    "result_pages": "SELECT rec_id, CAST(0 AS INT) AS pos, regexp_replace(trim('[PDF] ' || title, ' '), '^(?:\\[[A-Z]+\\]\\s*)+', '') AS title, trim(coalesce(source, ''), ' ') AS authors, 'text' AS snippet, 'https://x.example/' || rec_id AS link, citation_count AS citations FROM paper_records WHERE title IS NOT NULL AND citation_count >= 0",
    "pdf_links": "SELECT rec_id, CAST(0 AS INT) AS pos, 'https://x.example/m/' || rec_id || '.pdf' AS pdf FROM paper_records UNION ALL SELECT rec_id, 1, 'https://x.example/d/a/' || rec_id || '.pdf' FROM paper_records UNION ALL SELECT rec_id, 2, 'https://x.example/q/' || rec_id || '.pdf' FROM paper_records",
    "retrieval_counts": "SELECT source, year, count(*) AS total_results, count(*) FILTER (trim(coalesce(external_ids['MAG'], ''), ' ') <> '') AS results_with_pdf_url, count(*) FILTER (coalesce(is_open_access, false)) AS results_open_access FROM paper_records GROUP BY 1, 2",
    "weight_sums": "SELECT component, CAST(weight AS DOUBLE) AS weight FROM (VALUES ('author_citation_count', 0.15), ('author_h_index', 0.2), ('author_productivity', 0.1), ('citation_quality', 0.25), ('coauthor_network', 0.15), ('diversity_boost', 0.15), ('field_normalization', 0.1), ('influential_citations', 0.15), ('institution_reputation', 0.15), ('novelty_score', 0.1), ('open_access_bonus', 0.05), ('recency_factor', 0.1), ('venue_prestige', 0.2)) t(component, weight)",
    "offered_events": "SELECT user_id, event_id, slot, dropped FROM (SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INT) AS slot, CAST(greatest(count(*) OVER (PARTITION BY user_id) - 40, 0) AS INT) AS dropped FROM events) WHERE slot <= 40",
}
