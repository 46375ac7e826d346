"""Approximate dense search: vectors in cells around centroids, stored by cell, of which a query reads the nearest.

Centroids are fitted by k-means on a bounded sample (``SAMPLE`` rows, the first by hash of their id); they, and nothing
else of the collection, go through the driver.  Every row is dealt to its nearest centroid and written into that cell's
folder, and a cell of many rows into many files.  A search picks the ``probes`` nearest cells of each query, reads only
the folders that some query asked for, and scores their rows exactly; a row is scored only for queries that probe its cell.
How many cells a wanted recall takes is measured on the sample, of which ``TRIED`` rows are searched for among all: nearest
rows of a sample lie further away than those of the whole, so the number is rather too large than too small.
``dense_topk`` is the exact way, and so is a search that probes all cells.

Defined cases: rows with a null vector are not indexed; zero vectors score 0 and lie in one cell; equal vectors lie in one
cell; ties go to the smaller id; an empty collection gives an empty index, and an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from sedgewood.operators.retrieval import QUERY_BLOCK, top

#: Rows that centroids are fitted on; most cells; rounds of the fit; rows and nearest rows by which recall is measured.
SAMPLE, MOST_CELLS, ROUNDS, TRIED, NEAREST = 32_768, 1024, 12, 256, 5


@dataclass
class VectorIndex:
    path: str
    centroids: np.ndarray
    recall: np.ndarray  # of the sample's nearest rows, by the number of cells

    def probes(self, recall: float) -> int:
        """The fewest cells that reach this recall on the sample."""
        return int(np.searchsorted(self.recall, recall - 1e-12)) + 1

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema("id long, vector array<double>, cell int").parquet(f"{self.path}/cells")


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-300)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), -1)


def fit(corpus: DataFrame, cells: int | None = None, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """Unit centroids of corpus(id, vector), by default the square root of the number of rows, at most ``MOST_CELLS``, and recall."""
    some = corpus.where("vector is not null").orderBy(F.xxhash64("id"), "id").limit(sample).select("vector").toArrow()
    if not some.num_rows:
        return np.zeros((0, 0)), np.zeros(0)
    x = np.unique(_unit(_matrix(some.column(0).combine_chunks())), axis=0)
    if cells is None:
        cells = min(MOST_CELLS, int(np.ceil(np.sqrt(corpus.count()))))
    centroids = x[np.random.default_rng(0).permutation(len(x))[:cells]]
    for _ in range(ROUNDS):
        own = (x @ centroids.T).argmax(1)
        order = np.argsort(own, kind="stable")
        used, first = np.unique(own[order], return_index=True)
        centroids = np.unique(_unit(np.add.reduceat(x[order], first)), axis=0)  # an empty cell goes
    return centroids, _recall(x, centroids)


def _recall(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The share of the nearest rows of x to some of its rows, themselves left out, that lie in the nearest 1, 2, ... cells."""
    q = x[np.random.default_rng(1).permutation(len(x))[:TRIED]]
    near = np.argsort(-(q @ x.T), axis=1, kind="stable")[:, 1 : NEAREST + 1]
    rank = np.argsort(np.argsort(-(q @ centroids.T), axis=1, kind="stable"), axis=1)
    at = np.take_along_axis(rank, (x @ centroids.T).argmax(1)[near], 1).reshape(-1)
    return np.bincount(at, minlength=len(centroids)).cumsum() / max(len(at), 1)


def build(corpus: DataFrame, path: str, cells: int | None = None, sample: int = SAMPLE) -> VectorIndex:
    """The index of corpus(id, vector), written below path."""
    centroids, recall = fit(corpus, cells, sample)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = (_unit(_matrix(batch.column(1))) @ centroids.T).argmax(1) if batch.num_rows else np.zeros(0)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(cell, pa.int32())], names=["id", "vector", "cell"])

    slim = corpus.where("vector is not null").select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<double>").alias("vector"))
    # rebalanced, not hashed: a cell of many rows is written by several tasks
    slim.mapInArrow(deal, "id long, vector array<double>, cell int").hint("rebalance", "cell").write.partitionBy("cell").parquet(f"{path}/cells")
    spark = corpus.sparkSession
    spark.createDataFrame([(i, c.tolist(), r) for i, (c, r) in enumerate(zip(centroids, recall.tolist(), strict=True))], "cell int, vector array<double>, recall double").coalesce(1).write.parquet(f"{path}/centroids")
    return VectorIndex(path, centroids, recall)


def load(spark: SparkSession, path: str) -> VectorIndex:
    rows = spark.read.parquet(f"{path}/centroids").orderBy("cell").collect()
    return VectorIndex(path, np.array([r["vector"] for r in rows], np.float64).reshape(len(rows), -1), np.array([r["recall"] for r in rows], np.float64))


def search(index: VectorIndex, queries: DataFrame, k: int, probes: int) -> DataFrame:
    """query_id, id, cosine score and rank of the k nearest rows of queries(query_id, vector) within each one's ``probes`` nearest cells."""
    spark, n = queries.sparkSession, queries.count()
    blocks, found = max(1, -(-n // QUERY_BLOCK)), None
    for b in range(blocks if len(index.centroids) else 0):
        part = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)
        block = part.where("vector is not null").select("query_id", F.col("vector").cast("array<double>")).toArrow()
        if block.num_rows:
            hits = _scan(index, spark, block.column(0).to_numpy(), _unit(_matrix(block.column(1).combine_chunks())), k, probes)
            found = hits if found is None else found.unionByName(hits)
    if found is None:
        return spark.createDataFrame([], "query_id long, id long, score double, rank long")
    return top(found, "query_id", k, F.desc("score"), F.asc("id"))


def _scan(index: VectorIndex, spark: SparkSession, ids: np.ndarray, q: np.ndarray, k: int, probes: int) -> DataFrame:
    near = np.argsort(-(q @ index.centroids.T), axis=1, kind="stable")[:, :probes]
    asks = {c: np.flatnonzero((near == c).any(1)) for c in np.unique(near).tolist()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, own, cells = _unit(_matrix(batch.column(1))), batch.column(0).to_numpy(), batch.column(2).to_numpy()
            for c in np.unique(cells).tolist():
                at, who = np.flatnonzero(cells == c), asks[c]
                s = np.round(q[who] @ x[at].T, 9)
                take = np.lexsort((np.broadcast_to(own[at], s.shape), -s), axis=1)[:, :k]
                yield pa.record_batch([pa.array(np.repeat(ids[who], take.shape[1])), pa.array(own[at][take].reshape(-1)), pa.array(np.take_along_axis(s, take, 1).reshape(-1))], names=["query_id", "id", "score"])

    return index.rows(spark).where(F.col("cell").isin(sorted(asks))).mapInArrow(run, "query_id long, id long, score double")
