"""Ranking: dense and BM25 search, fusion, reranking, and what is done with hits."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.functions import arrow_udf

from sedgewood.functions.text import words
from sedgewood.operators.state import settle

#: Query vectors that are searched for at once; more take more passes, never a larger block.
QUERY_BLOCK = 4096
#: The same for word queries, whose words are held as well.
BM25_BLOCK = 512
#: Queries and rows of one tile of scores, and words that an embedder remembers: what a task holds, whatever the batches' size.
TILE_QUERIES, TILE_ROWS, KNOWN = 512, 1024, 100_000


def top(df: DataFrame, by: str, k: int, *order: Column) -> DataFrame:
    """The first k rows of each group with their rank."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order)).cast("long")).where(F.col("rank") <= k)


class Best:
    """The k rows of largest score, ties to the smaller id, that a task has seen for each of its queries."""

    def __init__(self, n: int, k: int) -> None:
        self.k, self.seen = k, 0
        self.score, self.id = np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max)

    def add(self, start: int, scores: np.ndarray, own: np.ndarray) -> None:
        """A tile of scores, its queries from ``start`` and its rows with the ids ``own``."""
        at = start + np.flatnonzero(scores.max(1) >= self.score[start : start + len(scores), -1])  # the others keep theirs
        s = np.concatenate([self.score[at], scores[at - start]], axis=1)
        i = np.concatenate([self.id[at], np.broadcast_to(own, (len(at), len(own)))], axis=1)
        take = np.lexsort((i, -s), axis=1)[:, : self.k]
        self.score[at], self.id[at] = np.take_along_axis(s, take, 1), np.take_along_axis(i, take, 1)

    def rows(self, ids: np.ndarray, sign: int = 1) -> Iterator[pa.RecordBatch]:
        """query_id, id, score of what was kept; ids are those of the queries."""
        n = min(self.k, self.seen)
        for i in range(0, len(ids) if n else 0, TILE_QUERIES):
            some = slice(i, i + TILE_QUERIES)
            columns = np.repeat(ids[some], n), self.id[some, :n].reshape(-1), sign * self.score[some, :n].reshape(-1)
            yield pa.record_batch([pa.array(c) for c in columns], names=["query_id", "id", "score"])


def dense_topk(corpus: DataFrame, queries: DataFrame, k: int, metric: str = "cosine") -> DataFrame:
    """query_id, id, score and rank of the k nearest rows of corpus(id, vector) to each row of queries(query_id, vector).

    Exact.  Queries are taken in blocks of a fixed size; each task scores its rows against a block tile by tile and keeps k
    rows a query, so neither its memory nor what it shuffles depends on the number of its rows.
    ``metric``: cosine (largest first) or l2 (squared distance, smallest first).
    """
    worst = np.inf if metric == "cosine" else -np.inf  # for scores that are no number: Spark sorts them as the largest

    def scan(block: pd.DataFrame) -> DataFrame:
        ids = block["query_id"].to_numpy()
        q = np.stack([np.asarray(v, np.float64) for v in block["vector"]])
        if metric == "cosine":
            q = q / np.maximum(np.sqrt((q * q).sum(1, keepdims=True)), 1e-300)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best, squares = Best(len(ids), k), (q * q).sum(1)[:, None]
            for batch in batches:
                for row in range(0, batch.num_rows, TILE_ROWS):
                    some = batch.slice(row, TILE_ROWS)
                    some = some.filter(some.column(1).is_valid())
                    if not some.num_rows:
                        continue
                    x = np.asarray(some.column(1).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(some.num_rows, -1)
                    own, own_squares = some.column(0).to_numpy(zero_copy_only=False), (x * x).sum(1)
                    if metric == "cosine":
                        x = x / np.maximum(np.sqrt(own_squares[:, None]), 1e-300)
                    best.seen += len(own)
                    for i in range(0, len(ids), TILE_QUERIES):
                        s = q[i : i + TILE_QUERIES] @ x.T
                        if metric != "cosine":
                            s = -(squares[i : i + TILE_QUERIES] - 2 * s + own_squares[None, :])
                        np.round(s, 9, out=s)  # equal vectors must tie, whatever order their products are added in
                        s[np.isnan(s)] = worst
                        best.add(i, s, own)
            if metric == "cosine":
                best.score[np.isposinf(best.score)] = np.nan
            yield from best.rows(ids, 1 if metric == "cosine" else -1)

        return corpus.select("id", "vector").mapInArrow(run, "query_id long, id long, score double")

    n = queries.count()
    blocks = max(1, -(-n // QUERY_BLOCK))
    found = None
    for b in range(blocks):
        part = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)
        block = part.select("query_id", "vector").toPandas()
        if len(block):
            found = scan(block) if found is None else found.unionByName(scan(block))
    if found is None:
        return corpus.sparkSession.createDataFrame([], "query_id long, id long, score double, rank long")
    order = F.desc("score") if metric == "cosine" else F.asc("score")
    return top(found, "query_id", k, order, F.asc("id"))


def term_statistics(corpus: DataFrame) -> DataFrame:
    """term, df, n_docs, avg_len, raw_idf of every word of corpus(id, text)."""
    own = words(F.coalesce("text", F.lit("")))
    totals = corpus.agg(F.count("*").alias("n_docs"), F.avg(F.size(own)).alias("avg_len"))
    df = corpus.select(F.explode(F.array_distinct(own)).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    raw = F.ln(F.col("n_docs") - F.col("df") + 0.5) - F.ln(F.col("df") + 0.5)
    return df.join(F.broadcast(totals), how="cross").withColumn("raw_idf", raw)  # one row of totals


def bm25_topk(corpus: DataFrame, queries: DataFrame, k: int, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """query_id, id, score and rank of the k best rows of corpus(id, text) for each row of queries(query_id, text).

    Words are white-space tokens, case kept; a negative idf becomes a quarter of the mean idf over all words; repeated
    query words count; rows without a word of the query score 0 and follow by id.  Queries are taken in blocks of a
    fixed size: a block's words and weights go to every task, which scores its rows and keeps k a query.
    """
    statistics = term_statistics(corpus)
    asked = queries.select("query_id", F.explode_outer(words(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count("term").alias("times"))
    mean = statistics.agg(F.avg("raw_idf").alias("mean_idf"), F.max("avg_len").alias("avg_len"))
    wanted = statistics.join(asked.select("term").distinct(), "term", "left_semi").join(F.broadcast(mean.select("mean_idf")), how="cross")
    idf = wanted.select("term", "avg_len", F.when(F.col("raw_idf") < 0, 0.25 * F.col("mean_idf")).otherwise(F.col("raw_idf")).alias("idf"))

    def scan(rows: list) -> DataFrame:
        ids = sorted({r["query_id"] for r in rows})
        place, known = {q: i for i, q in enumerate(ids)}, {}
        weights, avg_len = [], 1.0
        for r in rows:
            if r["idf"] is not None:
                avg_len = r["avg_len"]
                if r["term"].encode() not in known:
                    known[r["term"].encode()] = len(known)
                    weights.append(np.zeros(len(ids)))
                weights[known[r["term"].encode()]][place[r["query_id"]]] = r["idf"] * r["times"]
        matrix, names = np.array(weights).reshape(len(weights), len(ids)), np.array(ids)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = Best(len(ids), k)
            for batch in batches:
                for row in range(0, batch.num_rows, TILE_ROWS):
                    some = batch.slice(row, TILE_ROWS)
                    scores = np.zeros((some.num_rows, len(ids)))
                    for i, text in enumerate(some.column(1)):
                        own = (text.as_py() or b"").split()
                        at, tf = np.unique(np.array([known[w] for w in own if w in known], np.int64), return_counts=True)
                        if len(at):
                            scores[i] = (tf * (k1 + 1) / (tf + k1 * (1 - b + b * len(own) / avg_len))) @ matrix[at]
                    best.seen += some.num_rows
                    best.add(0, np.round(scores.T, 9), some.column(0).to_numpy())
            yield from best.rows(names)

        return corpus.select("id", F.col("text").cast("binary").alias("text")).mapInArrow(run, "query_id long, id long, score double")

    n = queries.count()
    blocks, found = max(1, -(-n // BM25_BLOCK)), None
    if blocks > 1:
        idf = settle(idf)  # the words of the corpus are counted once, not for each block
    for block in range(blocks):
        part = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block)
        rows = part.join(idf, "term", "left").collect()
        if rows:
            found = scan(rows) if found is None else found.unionByName(scan(rows))
    if found is None:
        return corpus.sparkSession.createDataFrame([], "query_id long, id long, score double, rank long")
    return top(found, "query_id", k, F.desc("score"), F.asc("id"))


def fuse(lists: list[tuple[DataFrame, float]], key: str, c: int = 60) -> DataFrame:
    """Weighted reciprocal rank fusion of lists(query_id, rank, key): query_id, key, score and rank of the whole union."""
    parts = [df.select("query_id", key, (F.lit(w) / (c + F.col("rank"))).alias("part")) for df, w in lists]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    fused = every.groupBy("query_id", key).agg(F.round(F.sum("part"), 9).alias("score"))
    return fused.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc(key))).cast("long"))


def overlap_score(query: Column, text: Column) -> Column:
    """Default pair scorer: the share of the query's distinct words that the text has."""
    q = F.array_distinct(words(F.lower(query)))
    return F.round(F.size(F.array_intersect(q, words(F.lower(text)))) / F.greatest(F.size(q), F.lit(1)), 9)


def rerank(pairs: DataFrame, k: int, scorer: Callable[[Column, Column], Column] = overlap_score) -> DataFrame:
    """The k best of pairs(query_id, query, id, text) for each query by the scorer, with ``rerank_score`` and rank."""
    return top(pairs.withColumn("rerank_score", scorer(F.col("query"), F.col("text"))), "query_id", k, F.desc("rerank_score"), F.asc("id"))


def maxpool_rerank(pairs: DataFrame, token_weight: Callable[[Column], Column], k: int) -> DataFrame:
    """Token-likelihood rerank: the largest weight of each token over the text's places, summed over the query's tokens."""
    spread = pairs.select("query_id", "id", "query", F.posexplode(words(F.lower("text"))).alias("pos", "token"))
    pooled = spread.groupBy("query_id", "id", "token").agg(F.max(token_weight(F.col("pos"))).alias("w"))
    asked = pairs.select("query_id", "query").distinct().select("query_id", F.explode(words(F.lower("query"))).alias("token"))
    sums = asked.join(pooled, ["query_id", "token"]).groupBy("query_id", "id").agg(F.round(F.sum("w"), 9).alias("rerank_score"))
    full = pairs.select("query_id", "id").distinct().join(sums, ["query_id", "id"], "left").fillna(0.0, ["rerank_score"])
    return top(full, "query_id", k, F.desc("rerank_score"), F.asc("id"))


def first_of_content(hits: DataFrame, key: str) -> DataFrame:
    """Hits without later ones of the same content, in rank order."""
    w = Window.partitionBy("query_id", key).orderBy("rank")
    return hits.withColumn("seen", F.row_number().over(w)).where("seen = 1").drop("seen")


def context(hits: DataFrame, text: str, sep: str = "\n\n") -> DataFrame:
    """query_id and the texts of its hits joined in rank order."""
    return hits.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", text))), lambda x: x[text]), sep).alias("context"))


def expand_queries(queries: DataFrame, generate: Callable[[Column], Column], mode: str = "concat") -> DataFrame:
    """Queries with a hypothetical passage in place of the text, or after it."""
    passage = generate(F.col("text"))
    return queries.withColumn("text", passage if mode == "replace" else F.concat_ws("\n\n", F.col("text"), passage))


def hashed_vectors(df: DataFrame, id_col: str, text: str, dims: int = 64) -> DataFrame:
    """id, vector by the default embedder: counts of lower-case words by a bucket from their MD5."""

    @arrow_udf("array<double>")
    def embed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known: dict[str, int] = {}
        for texts in batches:
            out = np.zeros((len(texts), dims))
            for i, t in enumerate(texts):  # one text at a time, so that no batch is held as words
                places = []
                for w in (t.as_py() or "").lower().split():
                    if w not in known:
                        if len(known) >= KNOWN:
                            known.clear()
                        known[w] = int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % dims
                    places.append(known[w])
                if places:
                    out[i] = np.bincount(places, minlength=dims)
            yield pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * dims), pa.array(out.reshape(-1)))

    return df.select(F.col(id_col).alias("id"), embed(F.col(text)).alias("vector"))


def embed_distinct(df: DataFrame, text: str, embed: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """df with ``vector``: ``embed`` makes (id, vector) of (id, text) rows, and gets each distinct text once."""
    distinct = df.select(F.col(text).alias("text")).where("text is not null").distinct()
    made = embed(distinct.select(F.col("text").alias("id"), "text")).withColumnRenamed("id", text)
    return df.join(made, text, "left")
