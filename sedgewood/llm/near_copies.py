"""Near copies: documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more, by MinHash.

A fingerprint of 64 bits cannot reach this similarity: such pairs differ in some 10 bits and up to 17, more than a trie
join can be given.  So candidates come from MinHash instead: ``BANDS`` bands of ``ROWS`` minima each, and documents that
agree in a band are a candidate pair.  A pair at 0.8 exactly is no candidate with a probability of
``(1 - 0.8 ** 5) ** 30``, seven in a million, and less above.  Each candidate pair is then verified: shared and all
shingles are counted, so no pair below 0.8 is linked.

Equal sets are one node.  Shingles that only one candidate has are counted first: a set that has over a fifth of them
cannot be similar enough to any other, and a pair only if both have enough in common with others.  Then each node is
verified against the most common one of each of its buckets, which connects a group of copies to the copy with the
fewest edits; then the pairs of a bucket that are not connected by that and can still be similar enough.  No pair above
the limit is lost by this: both bounds hold for every pair.  Links are closed by distributed connected components.

Defined cases: words are told apart by white space and lose the case of ASCII letters; a text of fewer than five words
has them all as one shingle; texts without words, null texts too, are equal to each other and to nothing else.  Shingles
and sets are compared by 64-bit hash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sedgewood.llm._state import connected_components, settle
from sedgewood.llm._text import MIX, buffers, mix, pieces, rolling, words

SHINGLE, BANDS, ROWS = 5, 30, 5
#: Least similarity, as a fraction.
NUMERATOR, DENOMINATOR = 4, 5

_U = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_RANDOM = mix(np.arange(1, 2 * BANDS * ROWS + 1, dtype=np.uint64) * MIX)
_FACTOR, _TERM = _RANDOM[: BANDS * ROWS] | _U(1), _RANDOM[BANDS * ROWS :]


def shingles(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all rows, ascending within each row, and the index of each row's first with their number appended."""
    w = words(_LOWER[buf], offsets)
    n, count = len(offsets) - 1, np.diff(w.first)
    h = rolling(w.hash, SHINGLE)
    ok = w.row[: len(h)] == w.row[SHINGLE - 1 :][: len(h)]
    found, rows = [h[ok]], [w.row[: len(h)][ok]]
    for k in range(1, SHINGLE):
        short = np.flatnonzero(count == k)
        if len(short):
            found.append(rolling(w.hash, k)[w.first[short]])
            rows.append(short)
    h, row = np.concatenate(found), np.concatenate(rows)
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    h, row = h[new], row[new]
    return h, np.searchsorted(row, np.arange(n + 1))


def keys(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Hash of each row's set of shingles."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h ^ MIX), dtype=np.uint64)])
    return mix((total[first[1:]] - total[first[:-1]]) ^ (np.diff(first).astype(np.uint64) * MIX))


def bands(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A row of band hashes for each row; rows without shingles have zeros."""
    out = np.zeros((len(first) - 1, BANDS), np.uint64)
    some = np.flatnonzero(np.diff(first) > 0)
    if len(some):
        for b in range(BANDS):
            total = np.full(len(some), b + 1, np.uint64)
            for k in range(b * ROWS, (b + 1) * ROWS):
                total = mix(total * MIX + np.minimum.reduceat(h * _FACTOR[k] + _TERM[k], first[:-1][some]))
            out[some, b] = total
    return out


def simhashes(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """SimHash of each row: the majority of each bit of its shingles; zero without shingles."""
    out = np.zeros(len(first) - 1, np.uint64)
    some, n = np.flatnonzero(np.diff(first) > 0), np.diff(first)
    if len(some):
        mixed = mix(h ^ MIX)
        for b in range(64):
            ones = np.add.reduceat((mixed >> _U(b)) & _U(1), first[:-1][some])
            out[some] |= (2 * ones > n[some].astype(np.uint64)).astype(np.uint64) << _U(b)
    return out


def signatures(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text_hash, key, n, fp, bands) for each row of df."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = buffers(batch.column(2))
            for i, j in pieces(offsets):
                h, first = shingles(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                flat = pa.array(bands(h, first).reshape(-1).view(np.int64))
                rows = pa.ListArray.from_arrays(pa.array(np.arange(j - i + 1, dtype=np.int32) * BANDS), flat)
                yield pa.record_batch([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(keys(h, first).view(np.int64)), pa.array(np.diff(first)), pa.array(simhashes(h, first).view(np.int64)), rows], names=["doc_id", "text_hash", "key", "n", "fp", "bands"])

    slim = df.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    return slim.mapInArrow(run, "doc_id long, text_hash long, key long, n long, fp long, bands array<long>")


def _texts(df: DataFrame, id_col: str, text_col: str, docs: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, text): one row's text for each of the keys."""
    own = docs.select("key", "doc_id", "text_hash").join(keys, "key", "left_semi")
    one = own.groupBy("key").agg(F.min(F.struct("doc_id", "text_hash")).alias("row")).select("key", F.col("row.doc_id").alias("of"), F.col("row.text_hash").alias("h"))
    every = df.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    met = every.join(one, (F.col("text_hash") == F.col("h")) & F.col("doc_id").eqNullSafe(F.col("of")))
    return met.select("key", "text").dropDuplicates(["key"])  # rows that are repeated whole


def _sets(texts: DataFrame) -> DataFrame:
    """(key, shingles) for each row of texts(key, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = buffers(batch.column(1))
            for i, j in pieces(offsets):
                h, first = shingles(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                rows = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(h.view(np.int64)))
                yield pa.record_batch([batch.column(0).slice(i, j - i), rows], names=["key", "shingles"])

    return texts.mapInArrow(run, "key long, shingles array<long>")


def _overlaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs(a, b) with the number of shingles that they share and whether they are similar enough."""
    left = sets.select(F.col("key").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("key").alias("b"), F.col("shingles").alias("y"))
    both = pairs.join(left, "a").join(right, "b").withColumn("shared", F.size(F.array_intersect("x", "y")))
    return both.select("a", "b", "shared", F.expr(f"{DENOMINATOR} * shared >= {NUMERATOR} * (size(x) + size(y) - shared)").alias("similar"))


def _unshared(sets: DataFrame) -> DataFrame:
    """(key, own): how many of a set's shingles no other set of sets(key, shingles) has; no row where it is none."""
    once = sets.select("key", F.explode("shingles").alias("shingle")).groupBy("shingle").agg(F.count("*").alias("n"), F.min("key").alias("key")).where("n = 1")
    return once.groupBy("key").agg(F.count("*").alias("own"))


def _close(nodes: DataFrame, join: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Pairs (a, b) of nodes(key, n, fp) that connect those of equal fingerprints and those that ``join`` of (fp) links."""
    own = nodes.where("n > 0").select("key", "fp")
    heads = settle(own.groupBy("fp").agg(F.min("key").alias("head")))
    equal = own.join(heads, "fp").where("key <> head").select(F.col("head").alias("a"), F.col("key").alias("b"))
    a, b = heads.select(F.col("fp").alias("a"), F.col("head").alias("x")), heads.select(F.col("fp").alias("b"), F.col("head").alias("y"))
    return equal.union(join(heads.select("fp")).join(a, "a").join(b, "b").select("x", "y")).distinct()


def components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", near: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(doc_id, text_hash, root, component_id) for each row of df: its group, and the smallest id in that, or null.

    ``near`` joins SimHash fingerprints (fp) of the sets into links (a, b).  These are verified like the others, and MinHash
    looks only for what they do not connect.
    """
    docs = settle(signatures(df, id_col, text_col))
    nodes = docs.groupBy("key").agg(F.min("doc_id").alias("least"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("bands").alias("bands"))
    spread = nodes.where("n > 0").select("key", "n", F.explode("bands").alias("band"))
    several = spread.groupBy("band").agg(F.count("*").alias("size")).where("size > 1").select("band")
    candidates = settle(spread.join(several, "band"))
    wanted, close = candidates.select("key"), None
    if near is not None:
        close = settle(_close(nodes, near))
        wanted = wanted.union(close.select("a")).union(close.select("b"))
    sets = settle(_sets(_texts(df, id_col, text_col, docs, wanted.distinct())))
    # two sets share at most what either has in common with any other; below four fifths of its size there is no partner
    members = candidates.join(_unshared(sets), "key", "left").withColumn("common", F.col("n") - F.coalesce("own", F.lit(0))).drop("own")
    members = settle(members.where(f"{DENOMINATOR} * common >= {NUMERATOR} * n"))
    sizes = f"{NUMERATOR} * greatest({{0}}, {{1}}) <= {DENOMINATOR} * least({{0}}, {{1}})"
    enough = f"{NUMERATOR + DENOMINATOR} * ({{0}}) >= {NUMERATOR} * ({{1}} + {{2}})"  # so many shared shingles make a pair similar
    # the head of a bucket is its most common set, which of an edited text's copies is the one with the fewest edits
    head = F.max(F.struct((F.col("common") / F.col("n")).alias("share"), "key", "n", "common")).alias("head")
    headed = settle(members.join(members.groupBy("band").agg(head), "band").select("band", "key", "n", "common", *(F.col(f"head.{c}").alias(f"head_{c}") for c in ("key", "n", "common"))))
    near = f"key <> head_key and {sizes.format('n', 'head_n')} and {enough.format('least(common, head_common)', 'n', 'head_n')}"
    met = settle(_overlaps(headed.where(near).select(F.col("head_key").alias("a"), F.col("key").alias("b")).distinct(), sets))
    links = met.where("similar").select("a", "b")
    if close is not None:
        links = settle(links.union(_overlaps(close, sets).where("similar").select("a", "b")))
    # what the heads did not connect, pair by pair.  Two sets share at most what both share with their head, and of the
    # rest what either has in common with any other
    roots = settle(connected_components(links))
    rooted = headed.join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    rooted = rooted.join(met.select(F.col("a").alias("head_key"), F.col("b").alias("key"), "shared"), ["head_key", "key"], "left")
    rooted = rooted.withColumn("shared", F.when(F.col("key") == F.col("head_key"), F.col("n")).otherwise(F.col("shared"))).select("band", "key", "n", "common", "shared", "root")
    open_ = settle(rooted.join(rooted.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("band"), "band", "left_semi"))
    a, b = (open_.select("band", *(F.col(c).alias(f"{c}_{x}") for c in ("key", "n", "common", "shared", "root"))) for x in "ab")
    most = "least(common_a, common_b, if(shared_a is null or shared_b is null, common_a, least(shared_a, shared_b) + least(common_a - shared_a, common_b - shared_b)))"
    reach = f"{sizes.format('n_a', 'n_b')} and {enough.format(most, 'n_a', 'n_b')}"
    apart = a.join(b, (a["band"] == b["band"]) & F.expr(f"key_a < key_b and root_a <> root_b and {reach}"))
    rest = apart.select(F.col("key_a").alias("a"), F.col("key_b").alias("b")).distinct().join(met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti")
    roots = connected_components(links.union(_overlaps(rest, sets).where("similar").select("a", "b")))
    rooted = nodes.select("key", "least").join(roots.withColumnRenamed("node", "key"), "key", "left").select("key", "least", F.coalesce("root", "key").alias("root"))
    found = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("key", "root", "component_id")
    return docs.join(found, "key").select("doc_id", "text_hash", "root", "component_id")
