"""Quality selection by importance resampling over hashed n-grams.

Texts are read as runs of letters and digits and runs of punctuation; single runs and pairs are hashed into buckets.
Two bag-of-n-grams models are fitted, one on all documents (raw) and one on labelled good documents (target), and a
document's importance weight is the log ratio of its probability under both, tempered by the square root of its number of n-grams,
since a sum over n-grams would let length decide among texts of one kind.  Documents are drawn without replacement
by Gumbel top-k: each log weight gets Gumbel noise from a hash of its id, and the k largest are kept.

Raw counts come from every document.  Target documents are those of at most ``LABELS`` labelled ids (in hash order;
the bound is a parameter), so their ids and the model, a row for each bucket, are small enough to send to every task.
k is the share of good ones among the labelled ids used, times the number of documents.  The k-th key is found by
narrowing a histogram, so no task or driver holds the keys.

Defined cases: a null or empty text has weight 0; null labels count for nothing; a null id is drawn by its text's
length alone; repeated rows have equal keys, and ties at the k-th key are all kept; without labels, or without good
ones, everything is kept; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sedgewood.llm._state import settle
from sedgewood.llm._text import IS_SPACE, buffers, mix, pieces, span_hash

BUCKETS, LABELS, SMOOTHING, SEED = 1 << 16, 20_000, 1.0, 42
_U = np.uint64
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), 95, *range(128, 256)]] = True


def ngrams(buf: np.ndarray, offsets: np.ndarray, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each n-gram and its row."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = np.where(_WORD[buf], 1, np.where(IS_SPACE[buf], 0, 2)).astype(np.int8)
    new = np.ones(len(buf), bool)
    new[1:] = kind[1:] != kind[:-1]
    new[offsets[:-1][np.diff(offsets) > 0]] = True
    edge = np.flatnonzero(new)
    end = np.append(edge[1:], len(buf))
    some = kind[edge] > 0
    start, end = edge[some], end[some]
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = span_hash(buf, kind > 0, start, end)
    row = np.searchsorted(offsets, start, "right") - 1
    pair = row[1:] == row[:-1]
    second = mix(h[:-1] * _U(3) + h[1:])[pair]
    return (np.concatenate([h, second]) % _U(buckets)).astype(np.int64), np.concatenate([row, row[:-1][pair]])


def target_ids(labels: DataFrame, id_col: str, good: str, most: int) -> tuple[np.ndarray, float]:
    """Ids of the labelled good documents used, ascending, and the share of good ones."""
    used = labels.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.expr(f"coalesce({good}, false)").alias("good"))
    rows = used.orderBy(F.xxhash64("id", F.lit(SEED)), "id", "good").limit(most).collect()
    ids = np.array(sorted({r["id"] for r in rows if r["good"]}), np.int64)
    return ids, (sum(r["good"] for r in rows) / len(rows) if rows else 1.0)


def log_ratio(docs: DataFrame, ids: np.ndarray, buckets: int = BUCKETS, smoothing: float = SMOOTHING) -> np.ndarray:
    """Log of target over raw probability of each bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, buckets), np.int64)
        for batch in batches:
            buf, offsets = buffers(batch.column(1))
            own = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False)
            good = np.isin(own, ids) & batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            for i, j in pieces(offsets):
                bucket, row = ngrams(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], buckets)
                total[0] += np.bincount(bucket, minlength=buckets)
                total[1] += np.bincount(bucket[good[row + i]], minlength=buckets)
        some = np.flatnonzero(total[0])
        yield pa.record_batch([pa.array(some), pa.array(total[0][some]), pa.array(total[1][some])], names=["bucket", "raw", "target"])

    counts = np.zeros((2, buckets))
    for r in docs.mapInArrow(count, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect():
        counts[:, r["bucket"]] = r["raw"], r["target"]
    p = (counts + smoothing) / (counts.sum(1, keepdims=True) + smoothing * buckets)
    return np.log(p[1] / p[0])


def weights(docs: DataFrame, ratio: np.ndarray) -> DataFrame:
    """doc_id, n_grams and log_weight of each row."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = buffers(batch.column(1))
            n, s = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
            for i, j in pieces(offsets):
                bucket, row = ngrams(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], len(ratio))
                n[i:j] = np.bincount(row, minlength=j - i)
                s[i:j] = np.bincount(row, weights=ratio[bucket], minlength=j - i)
            s /= np.sqrt(np.maximum(n, 1))
            yield pa.record_batch([batch.column(0), pa.array(n), pa.array(s)], names=["doc_id", "n_grams", "log_weight"])

    return docs.mapInArrow(score, "doc_id long, n_grams long, log_weight double")


def kth_largest(keys: DataFrame, column: str, k: int, bins: int = 4096) -> float:
    """The k-th largest value of a double column, by narrowing a histogram."""
    lo, hi = keys.agg(F.min(column), F.max(column)).first()
    above = 0
    while lo < hi:
        width = (hi - lo) / bins
        if lo + width == lo:  # neighbours as doubles: the larger side decides
            n = keys.where(F.col(column) >= hi).count()
            return hi if n >= k else lo
        part = keys.where((F.col(column) >= lo) & (F.col(column) <= hi))
        at = F.least(F.floor((F.col(column) - lo) / width), F.lit(bins - 1))
        rows = part.groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi")).orderBy(F.desc("bin")).collect()
        for r in rows:
            if above + r["n"] >= k:
                lo, hi = r["lo"], r["hi"]
                break
            above += r["n"]
    return lo


def select(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", good: str = "quality = 1", most_labels: int = LABELS) -> DataFrame:
    """doc_id, n_grams, log_weight, gumbel_key and kept of each row."""
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    ids, share = target_ids(labels, id_col, good, most_labels)
    scored = weights(slim, log_ratio(slim, ids))
    u = (F.expr(f"shiftrightunsigned(xxhash64(coalesce(doc_id, n_grams), {SEED}), 11)").cast("double") + 0.5) / float(1 << 53)
    keyed = settle(scored.withColumn("gumbel_key", F.col("log_weight") - F.ln(-F.ln(u))))
    n = keyed.count()
    k = round(share * n)
    if not len(ids) or k >= n or not n:
        return keyed.withColumn("kept", F.lit(True))
    return keyed.withColumn("kept", F.col("gumbel_key") >= kth_largest(keyed, "gumbel_key", k) if k else F.lit(False))
