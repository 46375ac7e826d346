"""SimHash near-duplicates: fingerprints linked at three differing bits or fewer, by a binary trie self-join.

Texts become fingerprints of 64 bits (majority of the bits of the XXH64 of their three-word shingles); equal
fingerprints are one node from then on.  Two fingerprints with at most three differing bits agree in one of four
16-bit blocks, so each distinct fingerprint goes to the four subtries below its blocks' values, and each subtrie is
joined with itself by traversing node pairs (``_trie``).  Tasks return a spanning star of what they connected, never
all pairs; the stars are closed by distributed connected components.

A subtrie with more than ``hot`` fingerprints is split by its next eight bits into node pairs within the budget, each
a task's work of its own, so that no task holds a subtrie of any size.

Defined cases: a null text, like a text without words, has fingerprint zero and is linked like any other; a null id
takes part and its row gets the smallest id it reaches, or null; repeated rows are one node; an empty table gives an
empty result.  Other columns are not looked at, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from sedgewood.llm import _trie, near_copies
from sedgewood.llm._blocks import partitions
from sedgewood.llm._state import connected_components, fresh, settle

SEED, SHINGLE, BUDGET, BLOCKS = 42, 3, 3, 4
HOT = 1_000_000


def fingerprint(text: bytes) -> int:
    """Signed 64-bit SimHash of a UTF-8 text."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(words, words[1:], words[2:]))
    n = max(1, len(words) - SHINGLE + 1)
    h = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), np.uint64, n)
    count = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 16):
        part = h[i : i + (1 << 16)]
        count += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * count > n, bitorder="little").view("<i8")[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) for each row of df."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(x.as_py() or b"") for x in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    slim = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return slim.mapInArrow(run, "doc_id long, fp long")


def _rotated(fp: np.ndarray, block: np.ndarray) -> np.ndarray:
    """Fingerprints turned so that their block comes first."""
    s = (block * 16).astype(np.uint64)
    return np.where(s == 0, fp, (fp << s) | (fp >> ((np.uint64(64) - s) % np.uint64(64))))


def stars(fps: DataFrame, hot: int = HOT) -> DataFrame:
    """Links (a, b) that connect the distinct fingerprints fps(fp) as all links within the budget do."""
    n = 4 * partitions(fps.sparkSession)
    block = F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1))).alias("block")
    spread = fps.select("fp", block).withColumn("value", F.expr("shiftrightunsigned(fp, 48 - 16 * block) & 65535"))
    counts = spread.groupBy("block", "value").count().where(F.col("count") > hot).select("block", "value", F.lit(True).alias("hot"))
    # the eight bits after the block, cyclically
    after = F.expr("cast(shiftrightunsigned(fp, pmod(40 - 16 * block, 64)) & 255 as int)")
    near = F.filter(F.sequence(F.lit(0), F.lit(255)), lambda x: F.bit_count(x.bitwiseXOR(F.col("own"))) <= BUDGET)
    nodes = F.when(F.col("hot"), F.transform(near, lambda x: F.least(x, F.col("own")) * 256 + F.greatest(x, F.col("own")))).otherwise(F.array(F.lit(-1)))
    tasks = (
        spread.join(counts, ["block", "value"], "left")
        .withColumn("own", after)
        .select("fp", "block", "value", "own", F.explode(nodes).alias("node"))
        .withColumn("side", F.when((F.col("node") >= 0) & (F.col("node") % 256 == F.col("own")) & (F.floor(F.col("node") / 256) != F.col("own")), 1).otherwise(0))
        .withColumn("task", F.pmod(F.xxhash64("block", "value", "node"), F.lit(n)).cast("int"))
    )

    def run(table: pa.Table) -> pa.Table:
        fp = table["fp"].to_numpy().view(np.uint64)
        block, node, side = (table[c].to_numpy().astype(np.int64) for c in ("block", "node", "side"))
        turned = _rotated(fp, block)
        top = (turned >> np.uint64(48)).astype(np.int64)
        # by subtrie and node pair, then side, then fingerprint
        order = np.lexsort((turned, side, node, top, block))
        fp, turned, side = fp[order], turned[order], side[order]
        k = np.stack([block[order], top[order], node[order]], 1)
        group = np.cumsum(np.concatenate([[0], (k[1:] != k[:-1]).any(1)]))
        label = _trie.join(turned, group, 64, BUDGET, side)
        linked = label != np.arange(len(label))
        return pa.table({"a": fp[linked].view(np.int64), "b": fp[label[linked]].view(np.int64)})

    return tasks.select("task", "fp", "block", "node", "side").groupBy("task").applyInArrow(run, "a long, b long").distinct()


def components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of df."""
    docs = settle(fingerprints(df, id_col, text_col))
    fps = docs.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = connected_components(stars(fps.select("fp"), hot))
    rooted = fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    found = rooted.join(ids, "root").select("fp", "component_id")
    return docs.join(found, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def dedup_stage(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df with one row of each group of near copies: that of the smallest id.  Rows without an id stay.

    SimHash fingerprints of five-word shingles, joined by the trie, link first, and their links are verified.  Pairs with
    a similarity of 0.8 are beyond three bits: what the fingerprints do not connect, ``near_copies`` looks for by MinHash.
    Rows of one id are of one group only if their texts are near copies.
    """
    h, place = fresh(df, "h"), fresh(df, "place")
    found = near_copies.components(df, id_col, text_col, stars).where("doc_id = component_id")
    chosen = found.groupBy("root").agg(F.min(F.struct("doc_id", "text_hash")).alias("row")).select(F.col("row.doc_id").alias(id_col), F.col("row.text_hash").alias(h)).distinct()
    kept = df.withColumn(h, F.xxhash64(text_col)).join(chosen, [id_col, h])
    # of rows that are repeated whole, one; dealt as the join deals them
    once = kept.withColumn(place, F.row_number().over(Window.partitionBy(id_col, h).orderBy(F.xxhash64(*df.columns)))).where(F.col(place) == 1)
    return once.select(*df.columns).union(df.where(F.col(id_col).isNull()))
