"""Lexical and vector top-k search and the fusion of rankings.

Every ranking is ``(query_id, key, score, rank)``, ranks from 1, ties in score broken by the key, so that a rank never depends on row order.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholion.functions.text import tokens
from scholion.tables import cut, gathered, release, spread

K1, B, RRF_K = 1.2, 0.75, 60
#: Sums in another order differ by less than this.
EPSILON = 1e-8
#: Queries that are sent to the executors at a time, and whose terms texts are tokenised for at a time.
QUERY_BLOCK, TERM_BLOCK = 4096, 65_536
#: Postings that are searched at a time.
POSTINGS = 2_000_000


def ranked(scores: DataFrame, k: int | None = None) -> DataFrame:
    """Add ranks by query and keep the first ``k``; the cut is pushed below the shuffle as a window group limit."""
    w = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), F.col("key"))  # sums in another order differ in the last digits
    out = scores.select("query_id", "key", "score", F.row_number().over(w).alias("rank"))
    return out.where(F.col("rank") <= k) if k else out


def query_terms(queries: DataFrame) -> DataFrame:
    """``(query_id, terms)``: the distinct terms of each query; rows of one id are one query, and one without terms is left out."""
    return queries.select("query_id", F.explode(tokens("text")).alias("term")).groupBy("query_id").agg(F.array_sort(F.collect_set("term")).alias("terms"))


def blocks_of(rows: DataFrame, key: str, size: int = QUERY_BLOCK) -> Iterator[pa.Table]:
    """A stated query set in Arrow tables of about ``size`` rows, one at a time on the driver; the parts are cut by a hash of the key."""
    parts = -(-rows.count() // size)
    for i in range(parts):
        yield (rows.where(F.pmod(F.xxhash64(key), F.lit(parts)) == i) if parts > 1 else rows).toArrow()


_TOKEN = re.compile("[a-z0-9]+")


def _term_lists(docs: DataFrame, key: str, fields: list[str], vocabulary: dict[str, int]) -> DataFrame:
    """``(key, lengths, terms, tfs)``: each text tokenised once, with its length a field and the counts of the terms asked for.

    A term of field ``f`` has the number ``f * len(vocabulary)`` and its own.
    """
    kind, size = docs.schema[key].dataType.simpleString(), len(vocabulary)
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # the words of one block of queries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for b in batches:
            lengths, terms, tfs = [], [], []
            for texts in zip(*(b.column(f"f{i}").to_pylist() for i in range(len(fields)))):
                own: dict[int, int] = {}
                sizes = []
                for i, t in enumerate(texts):
                    words = _TOKEN.findall(t.lower()) if t else []
                    sizes.append(len(words))
                    for w in words:
                        n = known.get(w)
                        if n is not None:
                            n += i * size
                            own[n] = own.get(n, 0) + 1
                lengths.append(sizes)
                terms.append(list(own))
                tfs.append(list(own.values()))
            yield pa.RecordBatch.from_arrays([b.column("key"), *(pa.array(x, pa.list_(pa.int32())) for x in (lengths, terms, tfs))], names=["key", "lengths", "terms", "tfs"])

    taken = docs.select(F.col(key).alias("key"), *(F.col(f).alias(f"f{i}") for i, f in enumerate(fields)))
    return spread(taken).mapInArrow(run, f"key {kind}, lengths array<int>, terms array<int>, tfs array<int>")


class _Kept:
    """The best rows that a task has met for each query, in order of rounded score and key."""

    def __init__(self, queries: int, k: int, margin: float) -> None:
        self.k, self.margin, self.rows = k, margin, [[] for _ in range(queries)]

    def floor(self, q: int) -> float:
        """The score that a further row of the query must reach."""
        rows = self.rows[q]
        return rows[self.k - 1][2] - self.margin - EPSILON if len(rows) >= self.k else 0.0

    def add(self, q: int, scores: np.ndarray, keys: list) -> None:
        rows = sorted([*self.rows[q], *zip((-np.round(scores, 9)).tolist(), keys, scores.tolist())], key=lambda r: r[:2])
        if len(rows) > self.k:
            least = rows[self.k - 1][2] - self.margin
            rows = rows[: self.k] + ([r for r in rows[self.k :] if r[2] >= least] if self.margin else [])
        self.rows[q] = rows


def _matches(terms: np.ndarray, doc: np.ndarray, weight: np.ndarray, ends: np.ndarray, top: np.ndarray, count: int, floor: float, k: int | None, margin: float) -> tuple[np.ndarray, np.ndarray]:
    """(rows, scores) of a batch that may be among the best ``k`` of a query, ``terms`` being its posting lists from the rarest on.

    Once the largest gains of the lists to come add up to less than what the best rows so far have, a row met in none of the lists before
    cannot be among the best: from then on only the rows met are looked up in the longer lists.
    """
    rest = np.append(np.cumsum(top[terms][::-1])[::-1], 0.0)
    if rest[0] < floor:
        return np.zeros(0, np.int64), np.zeros(0)
    score, check = np.zeros(count), 1
    for i, t in enumerate(terms):
        if k and i >= check:
            check *= 2
            met = np.flatnonzero(score)
            if len(met) >= k:
                floor = max(floor, float(np.partition(score[met], len(met) - k)[len(met) - k]) - margin - EPSILON)
        if rest[i] < floor:
            break
        a, b = ends[t], ends[t + 1]
        score[doc[a:b]] += weight[a:b]
    else:
        met = np.flatnonzero(score)
        return met, score[met]
    met = np.flatnonzero(score)
    got = score[met]
    for j in range(i, len(terms)):
        near = got + rest[j] >= floor
        met, got = met[near], got[near]
        a, b = ends[terms[j]], ends[terms[j] + 1]
        at = np.minimum(np.searchsorted(doc[a:b], met), b - a - 1)
        got = got + np.where(doc[a:b][at] == met, weight[a:b][at], 0.0)
    return met, got


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches, small ones in one, so that a query is looked up once in all of them."""
    held, n = [], 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            n += len(b.column("terms").flatten())
        if n > POSTINGS:
            yield pa.concat_batches(held)
            held, n = [], 0
    if held:
        yield pa.concat_batches(held)


def _searched(lists: DataFrame, block: pa.Table, asked: list[np.ndarray], idf: np.ndarray, average: np.ndarray, k: int | None, k1: float, b: float, margin: float, schema: str) -> DataFrame:
    """Each task's best rows of each query of a block."""
    size = len(idf) // len(average)
    shared = lists.sparkSession.sparkContext.broadcast((block.column("query_id").combine_chunks(), asked, idf, average))  # one block of queries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, asked, idf, average = shared.value
        kept, kind = _Kept(len(asked), k, margin) if k else None, None
        slot = np.full(len(idf), -1, np.int64)
        for batch in _joined(batches):
            kind = batch.schema.field("key").type
            keys, tf = batch.column("key"), batch.column("tfs").flatten().to_numpy(zero_copy_only=False)
            term, sizes = batch.column("terms").flatten().to_numpy(zero_copy_only=False), np.diff(batch.column("terms").offsets.to_numpy())
            doc = np.repeat(np.arange(batch.num_rows), sizes)
            length = batch.column("lengths").flatten().to_numpy(zero_copy_only=False)[doc * len(average) + term // size]
            weight = idf[term] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / average[term // size]))
            order = np.argsort(term, kind="stable")
            doc, weight = doc[order], weight[order]
            own, starts = np.unique(term[order], return_index=True)
            ends, top = np.append(starts, len(doc)), np.maximum.reduceat(weight, starts)
            slot[own] = np.arange(len(own))
            long = np.diff(ends)
            for q, wanted in enumerate(asked):
                here = slot[wanted]
                here = here[here >= 0]
                if not len(here):
                    continue
                here = here[np.argsort(long[here], kind="stable")]
                floor = kept.floor(q) if kept else 0.0
                rows, scores = _matches(here, doc, weight, ends, top, batch.num_rows, floor, k, margin)
                if not kept:
                    if len(rows):
                        yield pa.RecordBatch.from_arrays([ids.take(pa.array(np.full(len(rows), q))), keys.take(pa.array(rows)), pa.array(scores)], names=["query_id", "key", "score"])
                    continue
                if len(rows) > k:
                    floor = max(floor, float(np.partition(scores, len(rows) - k)[len(rows) - k]) - margin - EPSILON)
                near = scores >= floor
                if near.any():
                    kept.add(q, scores[near], keys.take(pa.array(rows[near])).to_pylist())
            slot[own] = -1
        found = [(q, r[1], r[2]) for q, rows in enumerate(kept.rows if kept else []) for r in rows]
        for i in range(0, len(found), 10_000):
            q, key, score = zip(*found[i : i + 10_000])
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(q)), pa.array(key, kind), pa.array(score, pa.float64())], names=["query_id", "key", "score"])

    return lists.where("size(terms) > 0 and key is not null").mapInArrow(run, schema)


class _Lists:
    """The term lists of all rows for one block of queries, their statistics, and each query's terms by number."""

    def __init__(self, block: pa.Table, docs: DataFrame, key: str, fields: dict[str, float]) -> None:
        names, weights = list(fields), list(fields.values())
        terms = block.column("terms").combine_chunks()
        coded = terms.flatten().dictionary_encode()  # a text of the driver's memory for each word, not for each word of a query
        vocabulary = {w: i for i, w in enumerate(coded.dictionary.to_pylist())}
        self.rows = cut(_term_lists(docs, key, names, vocabulary))
        sizes = [F.col("lengths")[i] for i in range(len(names))]
        stats = self.rows.agg(*(F.count_if(n > 0) for n in sizes), *(F.avg(F.when(n > 0, n)) for n in sizes)).first()
        n, self.average = np.array(stats[: len(names)], float), np.array([x or 1.0 for x in stats[len(names) :]])
        df = np.zeros(len(vocabulary) * len(names))
        seen = self.rows.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).toArrow()  # a number a word of the block
        df[seen.column("term").to_numpy()] = seen.column("df").to_numpy()
        rows = np.repeat(n, len(vocabulary))
        self.idf = np.log(1 + (rows - df + 0.5) / (df + 0.5)) * np.repeat(weights, len(vocabulary))
        codes = coded.indices.to_numpy().astype(np.int64)
        self.asked = [np.concatenate([c + f * len(vocabulary) for f in range(len(names))]) for c in np.split(codes, terms.offsets.to_numpy()[1:-1] - terms.offsets[0].as_py())]


def bm25(queries: DataFrame, docs: DataFrame, key: str, fields: dict[str, float], k: int | None = None, k1: float = K1, b: float = B, within: DataFrame | None = None, margin: float = 0.0) -> DataFrame:
    """BM25 of each query ``(query_id, text)`` against all rows: distinct query terms, any of which may match; fields add up by weight.

    The queries are a stated set, sent to the executors in blocks; those of the same terms are searched once. Every text is tokenised once
    for up to ``TERM_BLOCK`` queries, into a table of the terms asked for; statistics come from it and cover all rows with a token in the
    field. Of several blocks each is searched, ranked and written before the next begins, in as many tasks as there are cores. Each task then keeps its best ``k`` rows of each query,
    exactly: posting lists are gone through from the rarest term on, and long ones only for rows that can still be among the best. So no
    row leaves a task but its ``k`` a query, however frequent a term is. ``within`` is a table with the ``key`` of the rows that may be
    found; with ``margin`` the rows that fall short of the ``k``-th score by no more than it stay in too. Null texts and keys match nothing.
    """
    spark = docs.sparkSession
    schema = f"query_id {queries.schema['query_id'].dataType.simpleString()}, key {docs.schema[key].dataType.simpleString()}, score double"
    asked = cut(query_terms(queries).withColumn("like", F.min("query_id").over(Window.partitionBy("terms"))))
    heads = asked.where(F.col("query_id") == F.col("like")).select("query_id", "terms")
    every, count = asked.count(), heads.count()

    def parts() -> Iterator[DataFrame]:
        for block in blocks_of(heads, "query_id", TERM_BLOCK):
            lists = _Lists(block, docs, key, fields)
            rows = lists.rows if within is None else lists.rows.join(within.select(F.col(key).alias("key")).distinct(), "key", "left_semi")
            if count > QUERY_BLOCK:  # each task hands on its best rows of each query
                rows = rows.coalesce(spark.sparkContext.defaultParallelism)
            for i in range(0, block.num_rows, QUERY_BLOCK):
                found = _searched(rows, block.slice(i, QUERY_BLOCK), lists.asked[i : i + QUERY_BLOCK], lists.idf, lists.average, k, k1, b, margin, schema)
                yield ranked(found, None if margin else k)
            if count > QUERY_BLOCK:
                release(lists.rows)

    if not count:
        return ranked(spark.createDataFrame([], schema), k)
    out = gathered(parts()) if count > QUERY_BLOCK else next(parts())
    return shared(out, asked.select("query_id", "like")) if every > count else out


def like(*by: str) -> Column:
    """One name for all queries with the same values of ``by``."""
    return F.struct(F.min("query_id").over(Window.partitionBy(*by)).alias("first"), F.xxhash64(*by).alias("hash"))


def shared(ranking: DataFrame, alike: DataFrame) -> DataFrame:
    """The ranking of a query for all that are ``like`` it, ``alike`` being (query_id, like)."""
    return ranking.withColumnRenamed("query_id", "like").join(alike, "like").select("query_id", "key", "score", "rank")


def bm25_pairs(queries: DataFrame, docs: DataFrame, key: str, fields: dict[str, float], pairs: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    """BM25 of the given pairs ``(query_id, key)`` only, those above 0; statistics are those of all rows, as in :func:`bm25`."""
    schema = f"query_id {queries.schema['query_id'].dataType.simpleString()}, key {docs.schema[key].dataType.simpleString()}, score double"
    out = docs.sparkSession.createDataFrame([], schema)
    for block in blocks_of(cut(query_terms(queries)), "query_id", TERM_BLOCK):
        lists = _Lists(block, docs, key, fields)
        size = len(lists.idf) // len(lists.average)
        shared = docs.sparkSession.sparkContext.broadcast((block.column("query_id").to_pylist(), lists.asked, lists.idf, lists.average))  # one block of queries

        def run(batches: Iterator[pd.DataFrame], shared=shared, size=size) -> Iterator[pd.DataFrame]:
            ids, asked, idf, average = shared.value
            terms_of = {str(q): a for q, a in zip(ids, asked)}
            for p in batches:
                scores = np.zeros(len(p))
                for i, (q, lengths, terms, tf) in enumerate(zip(p["query_id"], p["lengths"], p["terms"], p["tfs"])):
                    wanted = terms_of.get(str(q))
                    if wanted is None or not len(terms):
                        continue
                    hit = np.isin(terms, wanted)
                    t, f = terms[hit], tf[hit]
                    scores[i] = (idf[t] * f * (k1 + 1) / (f + k1 * (1 - b + b * np.asarray(lengths)[t // size] / average[t // size]))).sum()
                yield pd.DataFrame({"query_id": p["query_id"], "key": p["key"], "score": scores})

        found = pairs.join(lists.rows.where("size(terms) > 0"), "key").select("query_id", "key", "lengths", "terms", "tfs")
        out = out.unionByName(found.mapInPandas(run, schema).where("score > 0"))
    return out


def cosine_topk(queries: DataFrame, vectors: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    """Exact top-k by cosine of each query ``(query_id, vector)`` against all rows with a vector of the same size.

    The queries are a stated set: they are sent to the executors in blocks, every partition keeps its best ``k`` of each query, and the
    partitions' bests are ranked. Queries of one vector are searched once; of several blocks each is ranked and written before the next
    begins. Null, empty and zero vectors match nothing.
    """
    spark = vectors.sparkSession
    taken = vectors.select(F.col(key).alias("key"), F.col(vector).alias("v")).where("key is not null and v is not null and size(v) > 0")
    asked = cut(queries.select("query_id", "vector").where("vector is not null and size(vector) > 0").withColumn("like", like("vector")))
    heads = asked.select(F.col("like").alias("query_id"), "vector").dropDuplicates(["query_id"])
    kind, qkind = vectors.schema[key].dataType.simpleString(), asked.schema["like"].dataType.simpleString()
    every, ids, count = asked.agg(F.count(F.lit(1)), F.count_distinct("query_id"), F.count_distinct("like")).first()

    def search(block: list) -> DataFrame:
        ids = [q for q, _ in block]
        matrix = np.array([v for _, v in block], dtype=np.float64)
        matrix /= np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-300)
        shared = spark.sparkContext.broadcast((ids, matrix))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ids, m = shared.value
            kept = _Kept(len(ids), k, 0.0)
            for b in batches:
                b = b[[len(v) == m.shape[1] for v in b["v"]]] if len(b) else b
                if not len(b):
                    continue
                x = np.stack(b["v"].to_numpy()).astype(np.float64)
                norm = np.linalg.norm(x, axis=1)
                x, keys = x[norm > 0] / norm[norm > 0, None], b["key"].to_numpy()[norm > 0]
                s = m @ x.T
                for q in range(len(ids) if len(keys) else 0):
                    # all that tie with the last one taken stay in, so that ties are broken by key and not by position
                    least = max(kept.floor(q) or -2.0, np.partition(s[q], len(keys) - k)[len(keys) - k] - EPSILON if len(keys) > k else -2.0)
                    take = np.flatnonzero(s[q] >= least)
                    if len(take):
                        kept.add(q, s[q][take], keys[take].tolist())
            found = [(ids[q], r[1], r[2]) for q, rows in enumerate(kept.rows) for r in rows]
            yield pd.DataFrame(found, columns=["query_id", "key", "score"])

        return taken.mapInPandas(run, f"query_id {qkind}, key {kind}, score double")

    if not count:
        return ranked(spark.createDataFrame([], f"query_id {queries.schema['query_id'].dataType.simpleString()}, key {kind}, score double"), k)
    parts = (ranked(search(list(zip(t.column("query_id").to_pylist(), t.column("vector").to_pylist()))), k) for t in blocks_of(heads, "query_id"))
    out = shared(gathered(parts) if count > QUERY_BLOCK else next(parts), asked.select("query_id", "like"))
    return out if every == ids else ranked(out, k)


#: Vectors that the cells of the index are fitted on at most, and rounds of the fit.
IVF_SAMPLE, IVF_ROUNDS = 20_000, 8
#: Sampled vectors that are asked to find the number of probes.
IVF_ASKED = 500


def ivf_fit(vectors: DataFrame, vector: str, k: int, recall: float = 0.95, cells: int | None = None, sample: int = IVF_SAMPLE) -> tuple[np.ndarray, int]:
    """(centroids, probes) of an inverted-file index, fitted on a bounded sample (drawn by hash); every row is indexed with them all the same.

    Without ``cells`` there are as many as the square root of the rows, at most one to ten sampled vectors. ``probes`` is the least number
    of cells in which the sample's own queries find ``recall`` of their ``k`` nearest: few where vectors cluster, most where they don't.
    """
    count = vectors.count()
    share = min(1.0, sample / max(count, 1))
    rows = vectors.where(F.col(vector).isNotNull()).where(F.pmod(F.xxhash64(F.col(vector)), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)))).select(vector).limit(sample).collect()
    if not rows:
        return np.zeros((0, 0)), 1
    x = np.array([r[0] for r in rows], dtype=np.float64)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    x = x[np.lexsort(x.T)]
    cells = cells or min(round(count**0.5), max(1, len(x) // 10))
    centres = x[np.linspace(0, len(x) - 1, min(cells, len(x))).astype(int)].copy()
    for _ in range(IVF_ROUNDS):
        own = (x @ centres.T).argmax(1)
        total = np.zeros_like(centres)
        np.add.at(total, own, x)
        some = np.bincount(own, minlength=len(centres)) > 0
        centres[some] = total[some] / np.maximum(np.linalg.norm(total[some], axis=1, keepdims=True), 1e-300)
    asked = x[:: max(1, len(x) // IVF_ASKED)]
    nearest = np.argsort(-(asked @ x.T), axis=1, kind="stable")[:, : k + 1]  # each is its own nearest besides
    place = np.argsort(np.argsort(-(asked @ centres.T), axis=1, kind="stable"), axis=1)  # of each cell in the order of a query
    at = np.take_along_axis(place, (x @ centres.T).argmax(1)[nearest], 1)
    return centres, int(np.quantile(at, recall, method="higher")) + 1


def ivf_assign(vectors: DataFrame, id_column: str, vector: str, centres: np.ndarray) -> DataFrame:
    """``(cell, id, v)``: each row in its nearest cell."""
    shared = vectors.sparkSession.sparkContext.broadcast(centres)  # cells x dimension, fixed by the index
    kind = vectors.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = shared.value
        for b in batches:
            b = b[[len(v) == c.shape[1] for v in b["v"]]] if len(b) else b
            if len(b):
                x = np.stack(b["v"].to_numpy()).astype(np.float64)
                yield pd.DataFrame({"cell": (x @ c.T).argmax(1).astype(np.int32), "id": b["id"].to_numpy(), "v": b["v"].to_numpy()})

    return vectors.select(F.col(id_column).alias("id"), F.col(vector).alias("v")).where("v is not null and size(v) > 0").mapInPandas(run, f"cell int, id {kind}, v array<float>")


def ivf_index(vectors: DataFrame, key: str, vector: str, centres: np.ndarray) -> DataFrame:
    """The index as a table laid out by cell, a hot cell in as many files as it has tasks; nothing is gathered by cell."""
    return cut(ivf_assign(vectors, key, vector, centres).sortWithinPartitions("cell"))


def ivf_topk(queries: DataFrame, index: DataFrame, centres: np.ndarray, k: int, probes: int) -> DataFrame:
    """Approximate top-k of each query ``(query_id, vector)``: it is compared with the rows of its ``probes`` nearest cells only.

    The queries are a stated set, sent to the executors in blocks. Rows of an index ``(cell, id, v)`` are read in its order, and each run
    of a cell is multiplied with the queries that probe it; cells that no query probes are left out in the scan. There is no join by cell.
    """
    spark = index.sparkSession
    kind, qkind = index.schema["id"].dataType.simpleString(), queries.schema["query_id"].dataType.simpleString()
    schema = f"query_id {qkind}, key {kind}, score double"
    out = spark.createDataFrame([], schema)
    for t in blocks_of(queries.select("query_id", "vector").where("vector is not null and size(vector) > 0"), "query_id"):
        held = [(q, v) for q, v in zip(t.column("query_id").to_pylist(), t.column("vector").to_pylist()) if len(v) == centres.shape[1]]
        if not held or not len(centres):
            continue
        m = np.array([v for _, v in held], dtype=np.float64)
        m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
        near = np.argsort(-(m @ centres.T), axis=1, kind="stable")[:, :probes]
        by_cell = {int(c): np.flatnonzero((near == c).any(1)) for c in np.unique(near)}
        shared = spark.sparkContext.broadcast(([q for q, _ in held], m, by_cell))

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            ids, m, by_cell = shared.value
            kept = _Kept(len(ids), k, 0.0)
            for b in batches:
                cells = b["cell"].to_numpy()
                ends = np.flatnonzero(np.diff(cells, prepend=cells[:1] - 1, append=cells[-1:] - 1)) if len(b) else []
                for i, j in zip(ends, ends[1:]):
                    asked = by_cell.get(int(cells[i]), ())
                    if not len(asked):
                        continue
                    x = np.stack(b["v"].to_numpy()[i:j]).astype(np.float64)
                    keys, norm = b["id"].to_numpy()[i:j], np.linalg.norm(x, axis=1)
                    scores = m[asked] @ (x[norm > 0] / norm[norm > 0, None]).T
                    keys = keys[norm > 0]
                    for q, s in zip(asked, scores):
                        if len(s):
                            take = s >= (np.partition(s, len(s) - k)[len(s) - k] - EPSILON if len(s) > k else -2)
                            kept.add(q, s[take], keys[take].tolist())
            found = [(ids[q], r[1], r[2]) for q, rows in enumerate(kept.rows) for r in rows]
            yield pd.DataFrame(found, columns=["query_id", "key", "score"])

        out = out.unionByName(index.where(F.col("cell").isin(sorted(by_cell))).mapInPandas(run, schema))
    return ranked(out, k)


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine of two vectors in double precision; null where either is null or has no length."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return dot / F.nullif(norm(a) * norm(b), F.lit(0.0))


def rrf(rankings: DataFrame, k: int | None = None, constant: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of rankings stacked with their ``rank``; an optional ``weight`` column scales a ranking's part."""
    weight = F.col("weight") if "weight" in rankings.columns else F.lit(1.0)
    return ranked(rankings.groupBy("query_id", "key").agg(F.sum(weight / (constant + F.col("rank"))).alias("score")), k)


def _paired(lexical: DataFrame, semantic: DataFrame) -> DataFrame:
    left = lexical.select("query_id", "key", F.col("score").alias("s_l"), F.col("rank").alias("r_l"))
    right = semantic.select("query_id", "key", F.col("score").alias("s_v"), F.col("rank").alias("r_v"))
    return left.join(right, ["query_id", "key"], "full")


def weighted_rrf(lexical: DataFrame, semantic: DataFrame, w_lexical: float = 0.4, w_semantic: float = 0.6, k: int | None = None, constant: int = RRF_K) -> DataFrame:
    part = lambda w, r: F.coalesce(F.lit(w) / (constant + F.col(r)), F.lit(0.0))
    return ranked(_paired(lexical, semantic).select("query_id", "key", (part(w_lexical, "r_l") + part(w_semantic, "r_v")).alias("score")), k)


def hybrid(lexical: DataFrame, semantic: DataFrame, w_lexical: float = 0.3, w_semantic: float = 0.7, k: int | None = None, rrf_only: bool = False, constant: int = RRF_K) -> DataFrame:
    """Reciprocal ranks plus each ranking's score as a share of its query's best; a best of 0 or less adds nothing."""
    best = Window.partitionBy("query_id")
    both = _paired(lexical, semantic).withColumn("m_l", F.max("s_l").over(best)).withColumn("m_v", F.max("s_v").over(best))
    score = F.coalesce(1.0 / (constant + F.col("r_l")), F.lit(0.0)) + F.coalesce(1.0 / (constant + F.col("r_v")), F.lit(0.0))
    if not rrf_only:
        for w, s, m in ((w_lexical, "s_l", "m_l"), (w_semantic, "s_v", "m_v")):
            score = score + F.coalesce(F.when(F.col(m) > 0, w * F.col(s) / F.col(m)), F.lit(0.0))
    return ranked(both.select("query_id", "key", score.alias("score")), k)


def lexical_then_cosine(lexical: DataFrame, queries: DataFrame, vectors: DataFrame, key: str, vector: str, w_lexical: float = 0.7, w_semantic: float = 0.3, k: int | None = None) -> DataFrame:
    """Only lexical matches, their raw scores blended with the cosine.

    A match that falls short of the best ``k`` by more than a cosine can make up need not be handed in: see :func:`cosine_reach`.
    """
    q = queries.select("query_id", F.col("vector").alias("q"))
    v = vectors.select(F.col(key).alias("key"), F.col(vector).alias("v"))
    score = w_lexical * F.col("score") + w_semantic * F.coalesce(cosine("q", "v"), F.lit(0.0))
    return ranked(lexical.join(q, "query_id").join(v, "key").select("query_id", "key", score.alias("score")), k)


def cosine_reach(w_lexical: float = 0.7, w_semantic: float = 0.3) -> float:
    """The lexical score that a cosine, between -1 and 1, can make up for at most: the margin of a lexical search to be blended."""
    return 2 * w_semantic / w_lexical


def normalized_weights(lexical: float, semantic: float) -> tuple[float, float]:
    """Weights that add up to 1; a total of 0 or less gives a tenth and nine tenths."""
    total = lexical + semantic
    return (0.1, 0.9) if total <= 0 else (lexical / total, semantic / total)


def sanitized_query(text: str, fields: list[str]) -> str:
    """A query for a fielded index: a text with a known ``field:`` passes, else signs are dropped and the words are asked of each field."""
    if any(f"{f}:" in text for f in fields):
        return text
    words = "".join(" " if c in '+-!(){}[]^"~*?:\\/' else "" if c == "'" else c for c in text).split()
    return " OR ".join(f"{f}:({' '.join(words)})" for f in fields) if words else ""


def first_seen(rows: DataFrame, by: list[str], order: str) -> DataFrame:
    """The earliest row of each key."""
    w = Window.partitionBy(*by).orderBy(order)
    return rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def best_scored(rows: DataFrame, by: list[str], tie: str) -> DataFrame:
    """The best-scored row of each key, ties to the smallest ``tie``."""
    w = Window.partitionBy(*by).orderBy(F.col("score").desc(), tie)
    return rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
