"""Retrieval: dense and sparse scoring, rank fusion, reranking, in single and batch form."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.runtime import stage_table

#: Queries that are scored at a time, and rows they meet at a time.
QUERY_BLOCK = 4_096
_ROW_BLOCK = 256


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays in double precision; 0 when a norm is 0."""
    wide = lambda x: F.transform(x, lambda v: v.cast("double"))
    dot = lambda x, y: F.aggregate(F.zip_with(wide(x), wide(y), lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, F.lit(0.0)).otherwise(dot(a, b) / norm)


def check_query(text: str | None = None, limit: int = 1, top_n: int = 1) -> None:
    """Errors of a search: a blank query, or limits below 1."""
    if text is not None and not text.strip():
        raise ValueError("the query is blank")
    if limit < 1 or top_n < 1:
        raise ValueError("limits must be 1 or more")


def dense_top(index: DataFrame, query: list[float], limit: int = 10, doc_id: str | None = None, id_col: str = "vec_id", vector_col: str = "dense") -> DataFrame:
    """(id, score): the ``limit`` vectors of highest cosine, ties by id; only those of the query's length, of ``doc_id`` if given."""
    check_query(limit=limit)
    rows = index.where(F.size(vector_col) == len(query))
    rows = rows.where(F.col("doc_id") == doc_id) if doc_id is not None else rows
    q = F.array(*[F.lit(float(x)) for x in query])
    return rows.select(F.col(id_col), cosine(F.col(vector_col), q).alias("score")).dropDuplicates([id_col]).orderBy(F.desc("score"), id_col).limit(limit)


def postings(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, term, tf, length): lower-case ASCII words and numbers with their counts."""
    terms = F.filter(F.split(F.lower(F.col(text_col)), "[^a-z0-9]+"), lambda t: t != "")
    cut = docs.select(F.col(id_col).alias("id"), terms.alias("terms")).where(F.size("terms") > 0)
    return cut.select("id", F.size("terms").alias("length"), F.explode("terms").alias("term")).groupBy("id", "length", "term").agg(F.count("*").alias("tf")).select("id", "term", "tf", "length")


def corpus_stats(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(n, avg_length): how many documents have a term, and how many terms they have on average."""
    terms = F.filter(F.split(F.lower(F.col(text_col)), "[^a-z0-9]+"), lambda t: t != "")
    return docs.select(F.size(terms).alias("s")).where("s > 0").agg(F.count("*").alias("n"), F.avg("s").alias("avg_length"))


def bm25_scores(docs: DataFrame, queries: DataFrame, id_col: str = "doc_id", text_col: str = "text", k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(query_id, id, score) of every document that shares a term with a query (query_id, query): Okapi BM25, query weights 1."""
    wanted = queries.select("query_id", F.explode(F.array_distinct(F.filter(F.split(F.lower("query"), "[^a-z0-9]+"), lambda t: t != ""))).alias("term"))
    slim = docs.select(F.col(id_col), F.col(text_col)).where(F.col(id_col).isNotNull()).dropDuplicates([id_col])
    stats = corpus_stats(slim, id_col, text_col)
    held = stage_table(postings(slim, id_col, text_col).join(wanted.select("term").distinct(), "term", "left_semi"), "postings")
    df = held.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("avg_length")))
    weighted = held.join(df, "term").join(F.broadcast(stats)).select("id", "term", weight.alias("weight"))  # stats is one row
    return weighted.join(wanted, "term").groupBy("query_id", "id").agg(F.sum("weight").alias("score"))


def top_per_query(scores: DataFrame, limit: int) -> DataFrame:
    """The best rows of each query with their ``rank`` from 1, ties by id."""
    check_query(limit=limit)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return scores.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= limit)


class _Best:
    """The best ``limit`` rows of each query of a block, by score rounded to 6 digits, ties by id."""

    def __init__(self, queries: int, limit: int) -> None:
        self.limit, self.floor = limit, np.full(queries, -np.inf)
        self.query, self.id, self.score = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)

    def add(self, ids: np.ndarray, scores: np.ndarray, held: np.ndarray | None = None) -> None:
        """Scores (rows, queries) of further rows; ``held`` says which of them count."""
        scores = np.floor(scores * 1e6 + 0.5) / 1e6
        if held is not None:
            scores[~held] = -np.inf
        floor = self.floor
        if len(ids) >= self.limit and np.isneginf(floor).any():
            floor = np.maximum(floor, np.partition(scores, len(ids) - self.limit, axis=0)[len(ids) - self.limit])
        row, query = np.nonzero((scores >= floor) & (scores > -np.inf))
        query, id_, score = np.concatenate([self.query, query]), np.concatenate([self.id, ids[row]]), np.concatenate([self.score, scores[row, query]])
        order = np.lexsort((id_, -score, query))
        query, id_, score = query[order], id_[order], score[order]
        nth = np.arange(len(query)) - np.searchsorted(query, query)
        keep = nth < self.limit
        full = nth == self.limit - 1
        self.floor[query[full]] = score[full]
        self.query, self.id, self.score = query[keep], id_[keep], score[keep]


def _blockwise(rows: DataFrame, queries: DataFrame, column: str, limit: int, scorer: Callable[[list], Callable]) -> DataFrame:
    """(query_id, id, score, rank): the best ``limit`` rows of every query. Queries go to the driver and the tasks in blocks, one
    after the other; a task keeps its best of each query, so no score matrix is shuffled. rows: (id, payload), ids once."""
    check_query(limit=limit)
    spark, found = rows.sparkSession, []
    numbered = stage_table(queries.where("query_id is not null").dropDuplicates(["query_id"]).select(F.col("query_id").cast("bigint").alias("query_id"), column), "queries")
    blocks = -(-numbered.count() // QUERY_BLOCK)
    rows = stage_table(rows, "rows")
    for block in range(blocks):
        part = numbered.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block).orderBy("query_id").collect()  # about QUERY_BLOCK rows
        if not part:
            continue
        names = spark.sparkContext.broadcast(np.array([r[0] for r in part], np.int64))
        score = spark.sparkContext.broadcast(scorer([r[1] for r in part]))

        def run(batches: Iterator[pa.RecordBatch], names=names, score=score) -> Iterator[pa.RecordBatch]:
            best = _Best(len(names.value), limit)
            for batch in batches:
                for lo in range(0, batch.num_rows, _ROW_BLOCK):
                    some = batch.slice(lo, _ROW_BLOCK)
                    at, scores, held = score.value(some.column(1))
                    best.add(some.column(0).to_numpy()[at], scores, held)
            yield pa.RecordBatch.from_arrays([pa.array(names.value[best.query]), pa.array(best.id), pa.array(best.score)], names=["query_id", "id", "score"])

        found.append(stage_table(top_per_query(rows.mapInArrow(run, "query_id bigint, id bigint, score double"), limit), "found"))
        names.destroy()
        score.destroy()
    if not found:
        return spark.createDataFrame([], "query_id bigint, id bigint, score double, rank int")
    return reduce(DataFrame.unionByName, found)


class _Cosines:
    def __init__(self, vectors: list) -> None:
        q = np.array(vectors, np.float64)
        norm = np.linalg.norm(q, axis=1)
        self.q = q / np.where(norm == 0, 1, norm)[:, None]

    def __call__(self, column: pa.Array) -> tuple:
        v = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)
        norm = np.linalg.norm(v, axis=1)
        return np.arange(len(v)), (v / np.where(norm == 0, 1, norm)[:, None]) @ self.q.T, None


def dense_top_of_set(index: DataFrame, queries: DataFrame, limit: int = 10, dim: int = 64, id_col: str = "vec_id", vector_col: str = "dense") -> DataFrame:
    """(query_id, id, score, rank): exact cosine search for a query set (query_id, vector) of any size, against all vectors of
    ``dim`` components; 0 when a norm is 0."""
    rows = index.where(F.size(vector_col) == dim).where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).alias("v")).dropDuplicates(["id"])
    return _blockwise(rows, queries.where(F.size("vector") == dim), "vector", limit, _Cosines)


_NO_TERM = re.compile("[^a-z0-9]+")


def _terms(text: str | None) -> list[str]:
    return [t for t in _NO_TERM.split((text or "").lower()) if t]


class _Okapi:
    """BM25 of documents with a block of queries: for each term the queries that hold it."""

    def __init__(self, queries: list, idf: Callable[[list[str]], dict[str, float]], average: float, k1: float, b: float) -> None:
        holders: dict[str, list[int]] = {}
        for n, text in enumerate(queries):
            for t in dict.fromkeys(_terms(text)):
                holders.setdefault(t, []).append(n)
        self.n, self.average, self.k1, self.b = len(queries), average, k1, b
        weights = idf(list(holders))
        self.terms = {t: (weights[t], np.array(h, np.int64)) for t, h in holders.items() if t in weights}

    def __call__(self, column: pa.Array) -> tuple:
        scores, held = np.zeros((len(column), self.n)), np.zeros((len(column), self.n), bool)
        for i, text in enumerate(column.to_pylist()):
            terms = _terms(text)
            tf: dict[str, int] = {}
            for t in terms:
                if t in self.terms:
                    tf[t] = tf.get(t, 0) + 1
            if not tf:
                continue
            damp = self.k1 * (1 - self.b + self.b * len(terms) / self.average)
            who = [self.terms[t][1] for t in tf]
            weight = [self.terms[t][0] * n * (self.k1 + 1) / (n + damp) for t, n in tf.items()]
            at = np.concatenate(who)
            scores[i] = np.bincount(at, np.repeat(weight, [len(w) for w in who]), self.n)
            held[i, at] = True
        return np.arange(len(column)), scores, held


def bm25_top_of_set(docs: DataFrame, queries: DataFrame, limit: int = 10, id_col: str = "doc_id", text_col: str = "text", k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(query_id, id, score, rank): ``bm25_scores`` for a query set (query_id, query) of any size, the best of each query."""
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).dropDuplicates(["id"])
    stats = corpus_stats(rows, "id", "text").first()
    df = stage_table(postings(rows, "id", "text").groupBy("term").agg(F.count("*").alias("df")), "df")

    def idf(terms: list[str]) -> dict[str, float]:
        wanted = df.sparkSession.createDataFrame([(t,) for t in terms], "term string")
        return {r.term: float(np.log(1 + (stats.n - r.df + 0.5) / (r.df + 0.5))) for r in df.join(wanted, "term").collect()}  # terms of one block

    return _blockwise(rows, queries, "query", limit, lambda part: _Okapi(part, idf, stats.avg_length or 1.0, k1, b))


def fuse(legs: list[DataFrame], limit: int = 10, prefetch: int = 30, k: int = 60) -> DataFrame:
    """(query_id, id, score, rank): reciprocal rank fusion of ranked legs (query_id, id, rank), each cut at max(limit, prefetch)."""
    cut = [leg.where(F.col("rank") <= max(limit, prefetch)).select("query_id", "id", (1.0 / (k + F.col("rank"))).alias("part")) for leg in legs]
    union = cut[0]
    for leg in cut[1:]:
        union = union.unionByName(leg)
    return top_per_query(union.groupBy("query_id", "id").agg(F.sum("part").alias("score")), limit)


def rerank(candidates: DataFrame, texts: DataFrame, queries: DataFrame, top_n: int = 10) -> DataFrame:
    """(query_id, id, relevance, rank): candidates by the share of the query's terms that their text holds, then by fused score.

    A plain stand-in for a cross-encoder, whose scores can't be had here; any Column of (query, text) can take its place.
    """
    check_query(top_n=top_n)
    terms = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda t: t != ""))
    both = candidates.join(queries, "query_id").join(texts, "id")
    share = F.size(F.array_intersect(terms(F.col("query")), terms(F.coalesce("text", F.lit(""))))) / F.greatest(F.size(terms(F.col("query"))), F.lit(1))
    order = Window.partitionBy("query_id").orderBy(F.desc("relevance"), F.desc("score"), "id")
    return both.withColumn("relevance", share).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_n).select("query_id", "id", "relevance", "rank")


def hits_json(hits: DataFrame) -> DataFrame:
    """(query_id, hits): the results of a query as JSON under 'results', missing texts as empty strings."""
    hit = F.struct(F.coalesce("text", F.lit("")).alias("text"), F.col("score"), F.coalesce("doc_id", F.lit("")).alias("doc_id"), F.coalesce("section_path", F.lit("")).alias("section_path"))
    return hits.groupBy("query_id").agg(F.to_json(F.struct(F.transform(F.array_sort(F.collect_list(F.struct("rank", hit.alias("hit")))), lambda x: x["hit"]).alias("results"))).alias("hits"))
