"""Sources and sinks of the engine's files. Schemas are given, never inferred."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Columns of the journal ranking file.
_RANKING = [
    "Rank", "Sourceid", "Title", "Type", "Issn", "Publisher", "Open Access", "Open Access Diamond", "SJR", "SJR Best Quartile", "H index", "Total Docs. ({year})", "Total Docs. (3years)", "Total Refs.",
    "Total Citations (3years)", "Citable Docs. (3years)", "Citations / Doc. (2years)", "Ref. / Doc.", "%Female", "Overton", "SDG", "Country", "Region", "Coverage", "Categories", "Areas",
]


def _strings(names: list[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def decimal_comma(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.trim(c), r"\.(?=\d{3}(\D|$))", ""), ",", ".").try_cast("double")


def whole_number(c: Column) -> Column:
    return F.trim(c).try_cast("int")


def parted(c: Column) -> Column:
    """List in a cell, parted by semicolons, else by commas; null cells give an empty list."""
    cell = F.coalesce(c, F.lit(""))
    parts = F.when(cell.contains(";"), F.split(cell, ";")).otherwise(F.split(cell, ","))
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")


def read_journal_ranking(spark: SparkSession, path: str) -> DataFrame:
    """Journal ranking files ``scimagojr_YYYY.csv``: semicolons, decimal commas, the year in the file's and a column's name."""
    year = re.search(r"(\d{4})\.csv", path)
    names = [n.format(year=year[1] if year else "year") for n in _RANKING]
    raw = spark.read.option("sep", ";").option("header", True).option("enforceSchema", True).option("quote", '"').schema(_strings(names)).csv(path)
    at = lambda n: F.col(f"`{n}`")
    yes = lambda n: F.lower(F.trim(at(n))) == "yes"
    data_year = F.coalesce(F.regexp_extract(F.col("_metadata.file_path"), r"scimagojr_(\d{4})\.csv", 1).try_cast("int"), F.lit(int(year[1])) if year else F.lit(None).cast("int"))
    return raw.select(
        at("Sourceid").alias("source_id"), at("Title").alias("title"), at("Type").alias("type"), parted(at("Issn")).alias("issn"), at("Publisher").alias("publisher"), at("Country").alias("country"), decimal_comma(at("SJR")).alias("sjr_score"),
        F.nullif(F.upper(F.trim(at("SJR Best Quartile"))), F.lit("-")).alias("sjr_best_quartile"), whole_number(at("H index")).alias("h_index"), decimal_comma(at("Citations / Doc. (2years)")).alias("cites_per_doc_2years"), parted(at("Categories")).alias("categories"),
        parted(at("Areas")).alias("areas"), yes("Open Access").alias("is_open_access"), yes("Open Access Diamond").alias("is_open_access_diamond"), data_year.alias("data_year"),
    )


def read_conference_ranking(spark: SparkSession, path: str) -> DataFrame:
    """Headerless conference ranking: lines of fewer than five cells or without a whole number first are left out, a blank rank is ``Unranked``, field codes are joined.

    The number of cells is that of the line, blank ones included, whatever they hold; cells may be in double quotes and span no lines.
    """
    names = ["core_id", "title", "acronym", "source", "rank", "is_primary", "for1", "for2", "for3"]
    lines = spark.read.text(path).where("trim(value) <> ''")
    # a separator is a comma outside quotes: one that an even number of quotes follows
    cells = F.size(F.split("value", ',(?=(?:[^"]*"[^"]*")*[^"]*$)', -1))
    row = F.from_csv("value", ", ".join(f"{n} string" for n in names))
    raw = lines.where(cells >= 5).select(row.alias("r")).select("r.*")
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    filled = F.filter(F.array("for1", "for2", "for3"), lambda x: x.isNotNull() & (x != ""))
    number = blank("core_id").try_cast("int")
    return raw.where(number.isNotNull()).select(
        number.alias("core_id"), blank("title").alias("title"), blank("acronym").alias("acronym"), blank("source").alias("source"), F.coalesce(F.nullif(blank("rank"), F.lit("")), F.lit("Unranked")).alias("rank"), (F.lower(blank("is_primary")) == "yes").alias("is_primary"), F.array_join(filled, ",").alias("for_codes"),
    )


def coerced_list(c: Column) -> Column:
    """List of a cell that holds JSON, or else parts between bars; blank parts are left out, and a null or blank cell is empty."""
    cell = F.trim(F.coalesce(c, F.lit("")))
    parts = F.when(cell.startswith("["), F.coalesce(F.from_json(cell, "array<string>"), F.split(cell, r"\|"))).otherwise(F.split(cell, r"\|"))
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))


def read_jsonl(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """One object a line; blank lines are passed over; a malformed line fails the read, or with ``strict`` off gives no row."""
    if strict:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_csv_with_json(spark: SparkSession, path: str, columns: list[str], lists: list[str], objects: dict[str, str] | None = None) -> DataFrame:
    """CSV whose ``lists`` cells hold JSON arrays: other cells of these columns, and broken ones, become one-element arrays of their text.

    ``objects`` gives the type of cells that hold JSON objects; they are decoded beside the text itself, in ``{column}_decoded``, null where broken.
    """
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').schema(_strings(columns)).csv(path)
    decode = lambda c: F.when(F.trim(F.col(c)).startswith("["), F.coalesce(F.from_json(c, "array<string>"), F.array(F.col(c)))).when(F.trim(F.col(c)) == "", F.array().cast("array<string>")).otherwise(F.array(F.col(c)))
    told = [F.when(F.trim(F.col(c)).startswith("{"), F.from_json(c, kind)).alias(f"{c}_decoded") for c, kind in (objects or {}).items()]
    return raw.select(*(decode(c).alias(c) if c in lists else F.col(c) for c in columns), *told)


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    """Relevance judgements, tab-separated with a header; judgements of 0 are left out."""
    raw = spark.read.option("sep", "\t").option("header", True).option("enforceSchema", True).schema("query_id string, key string, rel int").csv(path)
    return raw.where("rel <> 0")


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    return read_jsonl(spark, path, "_id string, title string, text string").withColumnRenamed("_id", "key")


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """Queries with their parts, if any: the original, or each sub-query of a decomposed one."""
    raw = read_jsonl(spark, path, "_id string, id string, text string, original_text string, decomposed struct<clarified_question:string,hybrid_queries:array<string>,intent:string>")
    whole = F.coalesce("text", "original_text")
    subs = F.when(F.size("decomposed.hybrid_queries") > 0, F.col("decomposed.hybrid_queries")).otherwise(F.array(whole))
    return raw.select(F.coalesce("_id", "id").alias("query_id"), F.posexplode(subs).alias("part", "text"))


# Names that a file of decomposed queries may have, the first that exists being read.
DECOMPOSED = ("queries_decomposed.json", "queries_decomposed.jsonl", "decomposed_queries.json", "decomposed_queries.jsonl")
_QUERY = "struct<_id:string,id:string,text:string,original_text:string,decomposed:struct<clarified_question:string,hybrid_queries:array<string>,intent:string>>"


def read_decomposed(spark: SparkSession, folder: str) -> DataFrame | None:
    """Queries with their parts ``(query_id, part, text)`` from the first file of a known name: lines, a list, or an object by query id; None without one."""
    jvm = spark.sparkContext._jvm
    for name in DECOMPOSED:
        path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            break
    else:
        return None
    if name.endswith("l"):
        rows = spark.read.text(str(path)).where("trim(value) <> ''").select(F.from_json("value", _QUERY).alias("q"), F.lit(None).cast("string").alias("key"))
    else:
        whole = spark.read.text(str(path), wholetext=True)
        listed = whole.where(F.ltrim("value").startswith("[")).select(F.explode(F.from_json("value", f"array<{_QUERY}>")).alias("q")).withColumn("key", F.lit(None).cast("string"))
        rows = listed.unionByName(whole.where(F.ltrim("value").startswith("{")).select(F.explode(F.from_json("value", f"map<string,{_QUERY}>")).alias("key", "q")))
    text = F.coalesce("q.text", "q.original_text", "q.decomposed.clarified_question")
    subs = F.filter(F.coalesce("q.decomposed.hybrid_queries", F.array().cast("array<string>")), lambda x: F.coalesce(F.trim(x), F.lit("")) != "")
    return rows.select(F.coalesce("q._id", "q.id", "key").alias("query_id"), F.posexplode(F.when(F.size(subs) > 0, subs).otherwise(F.array(text))).alias("part", "text")).where("query_id is not null and text is not null")


def select_questions(questions: DataFrame, exceptions: DataFrame, indexed: DataFrame | None = None, full_text: DataFrame | None = None) -> DataFrame:
    """Open questions ``(id, question, doi, is_opensource)`` with replaced DOIs, known to both sets where given, each question text once.

    ``exceptions`` is (doi, ver_doi): a row with ``ver_doi`` replaces the DOI, one without drops it. The smallest id of a text holds.
    """
    ex = exceptions.select(F.lower("doi").alias("doi"), F.lower("ver_doi").alias("ver_doi"), F.lit(True).alias("listed"))
    q = questions.where("is_opensource").withColumn("doi", F.lower("doi")).join(ex, "doi", "left").where("listed is null or ver_doi is not null").withColumn("doi", F.coalesce("ver_doi", "doi")).drop("ver_doi", "listed")
    for known in (indexed, full_text):
        if known is not None:
            q = q.join(known.select(F.lower("doi").alias("doi")).distinct(), "doi", "left_semi")
    text = F.regexp_replace(F.lower(F.trim("question")), r"\s+", " ")
    return q.withColumn("norm", text).groupBy("norm").agg(F.min_by(F.struct("id", "question", "doi"), "id").alias("q")).select("q.*")


def write_chunks(chunks: DataFrame, path: str, buckets: int = 64) -> None:
    """Chunks without NUL characters, laid out by a hash of their paper so that a paper's chunks are read together."""
    clean = chunks.withColumn("text", F.translate("text", "\0", "")).withColumn("bucket", F.pmod(F.xxhash64("paper_id"), F.lit(buckets)).cast("int"))
    clean.repartition("bucket").sortWithinPartitions("bucket", "paper_id").write.mode("overwrite").partitionBy("bucket").parquet(path)


def write_export(rows: DataFrame, path: str, kind: str = "csv") -> None:
    """Rows for other tools: lists and objects as JSON text, nulls as empty text in CSV."""
    flat = [F.to_json(f.name).alias(f.name) if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)) else F.col(f.name) for f in rows.schema]
    if kind == "csv":
        rows.select(*[F.coalesce(c.cast("string"), F.lit("")).alias(f.name) for c, f in zip(flat, rows.schema)]).write.mode("overwrite").option("header", True).option("escape", '"').option("emptyValue", "").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    else:
        rows.write.mode("overwrite").json(path)


def append_new(rows: DataFrame, path: str, key: str, by: str | None = None) -> None:
    """Append what isn't there yet: ids already in the folder are left out, so that a run can be taken up again."""
    spark = rows.sparkSession
    try:
        done = spark.read.schema(rows.schema).parquet(path).select(key)
        rows = rows.join(done, key, "left_anti")
    except Exception as e:  # noqa: BLE001 - only a missing folder is expected
        if "PATH_NOT_FOUND" not in str(e):
            raise
    (rows.write.mode("append").partitionBy(by) if by else rows.write.mode("append")).parquet(path)


def joined_export(rows: DataFrame, sources: DataFrame, key: str) -> DataFrame:
    """Evaluated rows with the columns of their source row that they lack, joined on the id as text; rows without a source stay."""
    more = [c for c in sources.columns if c not in rows.columns]
    own = sources.select(F.trim(F.col(key).cast("string")).alias("_key"), *more).dropDuplicates(["_key"])
    return rows.withColumn("_key", F.trim(F.col(key).cast("string"))).join(own, "_key", "left").drop("_key")


def write_benchmark(path: str, per_query: DataFrame, components: DataFrame, metrics: list[str]) -> None:
    """The five files of a benchmark below ``path``: all rows as JSON, means a variant, component times, rows by query, and a comparison as text.

    ``per_query`` is (query_id, variant, metrics...), ``components`` (variant, numbers...). Each is written by the executors.
    """
    means = per_query.groupBy("variant").agg(F.count(F.lit(1)).alias("queries"), *(F.format_string("%.6f", F.avg(m)).alias(m) for m in metrics))
    times = components.groupBy("variant").agg(*(F.format_string("%.2f", F.avg(c)).alias(c) for c in components.columns if c != "variant"))
    for name, df in (("summary", means), ("components", times), ("per_query", per_query)):
        write_export(df, f"{path}/{name}")
    per_query.write.mode("overwrite").json(f"{path}/results")
    line = F.concat_ws("  ", F.rpad("variant", 32, " "), *(F.concat(F.lit(f"{m}="), F.col(m)) for m in metrics))
    means.orderBy(F.col(metrics[0]).desc(), "variant").select(line.alias("value")).write.mode("overwrite").text(f"{path}/comparison")


def write_run_log(runs: DataFrame, path: str) -> None:
    """Append executions (execution_id, pipeline_type, ...) to a log laid out by pipeline; those logged already are left out, so a batch can be repeated."""
    append_new(runs, path, "execution_id", "pipeline_type")


def retrieval_log(records: DataFrame, by: list[str]) -> DataFrame:
    """Per search: how many records came back, how many of them with a PDF and open access, and the hash of their ids in order."""
    return records.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_results"), F.count_if(F.coalesce(F.trim("pdf_url"), F.lit("")) != "").alias("results_with_pdf_url"), F.count_if(F.coalesce("is_open_access", F.lit(False))).alias("results_open_access"),
    )


def write_retrieval_log(records: DataFrame, path: str, by: list[str]) -> None:
    """The records of searches as JSON, by search, and the counts beside them."""
    records.write.mode("overwrite").partitionBy(*by).json(f"{path}/results")
    retrieval_log(records, by).write.mode("overwrite").json(f"{path}/metadata")
