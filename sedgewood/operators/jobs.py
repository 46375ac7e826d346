"""Batch requests: envelopes, packing under a token budget, and the life of jobs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from sedgewood.operators.state import settle


def first_fit_next(sizes: np.ndarray, budget: int) -> np.ndarray:
    """For each item, the item that starts the next part if a part starts here; the number of items at the end."""
    total = np.concatenate([[0], np.cumsum(sizes)])
    nxt = np.searchsorted(total, total[:-1] + budget, "right") - 1
    return np.maximum(nxt, np.arange(len(sizes)) + 1)


def summary_of(sizes: np.ndarray, budget: int) -> dict:
    """What a block of rows does to the open part: for each row that can be the first not to fit, the sum up to it, how
    many parts the block then opens and how much is in the last; and the sum of all."""
    n, nxt = len(sizes), first_fit_next(sizes, budget)
    total = np.concatenate([[0], np.cumsum(sizes)])
    # by doubling: how many parts start from a row on, and where the last of them starts
    jump, count = np.append(nxt, n), np.append(np.ones(n, np.int64), 0)
    last = np.where(nxt == n, np.arange(n), np.minimum(nxt, n - 1))
    while (jump[:-1] < n).any():
        count = count + count[jump]
        jump = jump[jump]
        last = last[last]
    can = np.flatnonzero(total[:-1] <= budget)
    return {"upto": total[can + 1], "count": count[can], "used": (total[n] - total[last])[can], "whole": int(total[n])}


def composed(a: dict, b: dict, budget: int) -> dict:
    """The summary of one block followed by another."""
    upto, count, used = (np.asarray(b[c], np.int64) for c in ("upto", "count", "used"))
    mine = np.asarray(a["used"], np.int64)
    j = np.searchsorted(upto, budget - mine, "right")
    opens, at = j < len(upto), np.minimum(j, max(len(upto) - 1, 0))
    first = np.asarray(a["count"], np.int64) + np.where(opens, count[at] if len(upto) else 0, 0)
    left = np.where(opens, used[at] if len(upto) else 0, mine + b["whole"])
    late = np.concatenate([[0], upto[:-1]])[: len(upto)] + a["whole"] <= budget
    return {
        "upto": np.concatenate([np.asarray(a["upto"], np.int64), a["whole"] + upto[late]]), "count": np.concatenate([first, count[late]]),
        "used": np.concatenate([left, used[late]]), "whole": int(a["whole"] + b["whole"]),
    }


def advanced(part: int, used: int, block: dict, budget: int) -> tuple[int, int]:
    """The open part and what is in it, after a block."""
    # the first row that does not fit, or that opens the very first part
    i = 0 if part < 0 else int(np.searchsorted(used + np.asarray(block["upto"], np.int64), budget, "right"))
    if i < len(block["upto"]):
        return part + int(block["count"][i]), int(block["used"][i])
    return part, used + int(block["whole"])


#: Blocks that are put together before the chain.
CHAINED = 256


def next_fit(df: DataFrame, order: list[str], size: str, budget: int) -> DataFrame:
    """df with ``part``: rows in order go into the open part while it stays within the budget, else start a new one.

    No part is empty; a row over the budget stands alone.  The state is sequential, but what a block of rows does to it
    depends only on which row first starts a new part, so blocks are summarised in parallel (one entry for each row
    that can be the first, which a part's budget bounds).  Summaries can be composed: those of ``CHAINED`` neighbouring
    blocks become one, only these are chained one after the other, and then blocks and rows are numbered in parallel.
    """
    spark = df.sparkSession
    ranged = settle(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("block", F.spark_partition_id()))

    def summary(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [(b["block"].iloc[0], b[size].to_numpy(np.int64)) for b in batches if len(b)]
        if parts:
            yield pd.DataFrame([{"block": parts[0][0], **summary_of(np.concatenate([s for _, s in parts]), budget)}])

    def together(rows: pd.DataFrame) -> pd.DataFrame:
        out = None
        for r in rows.sort_values("block").to_dict("records"):
            out = r if out is None else composed(out, r, budget)
        return pd.DataFrame([{"super": rows["super"].iloc[0], **{c: out[c] for c in ("upto", "count", "used", "whole")}}])

    def chain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, used = -1, 0
        for batch in batches:
            out = []
            for r in batch.to_dict("records"):
                out.append((r["super"], part, used))
                part, used = advanced(part, used, r, budget)
            yield pd.DataFrame(out, columns=["super", "part0", "used0"])

    def within(rows: pd.DataFrame, starts: pd.DataFrame) -> pd.DataFrame:
        (part, used), out = starts[["part0", "used0"]].iloc[0], []
        for r in rows.sort_values("block").to_dict("records"):
            out.append((r["block"], part, used))
            part, used = advanced(int(part), int(used), r, budget)
        return pd.DataFrame(out, columns=["block", "part0", "used0"])

    body = "upto array<long>, count array<long>, used array<long>, whole long"
    summaries = settle(ranged.select("block", size).mapInPandas(summary, f"block int, {body}").withColumn("super", F.floor(F.col("block") / CHAINED).cast("int")))
    supers = summaries.groupBy("super").applyInPandas(together, f"super int, {body}")
    # one short row for every ``CHAINED`` blocks goes through one task
    heads = supers.repartition(1).sortWithinPartitions("super").mapInPandas(chain, "super int, part0 long, used0 long")
    starts = summaries.groupBy("super").cogroup(heads.groupBy("super")).applyInPandas(within, "block int, part0 long, used0 long")

    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block, part, used = None, -1, 0
        for b in batches:
            out, blocks, sizes = np.empty(len(b), np.int64), b["block"].to_numpy(), b[size].to_numpy(np.int64)
            edge = np.append(np.flatnonzero(np.concatenate([[True], blocks[1:] != blocks[:-1]])), len(b)) if len(b) else []
            for a, z in zip(edge[:-1], edge[1:]):
                if blocks[a] != block:
                    block, part, used = blocks[a], int(b["part0"].iloc[a]), int(b["used0"].iloc[a])
                total, i = np.concatenate([[0], np.cumsum(sizes[a:z])]), 0
                while i < z - a:
                    base = used - total[i]
                    j = i if part < 0 else max(i, int(np.searchsorted(total[1:], budget - base, "right")))
                    out[a + i : a + j] = part
                    used = int(base + total[j])
                    if j < z - a:
                        part, used = part + 1, int(sizes[a + j])
                        out[a + j] = part
                    i = j + 1
            yield b.drop(columns=["part0", "used0", "block"]).assign(part=out)

    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in df.schema.fields)}, part long"
    return ranged.join(starts, "block").sortWithinPartitions("block", *order).select(*df.columns, "block", "part0", "used0").mapInPandas(number, schema)


def running_parts(df: DataFrame, order: list[str], size: str, budget: int, group: list[str]) -> DataFrame:
    """df with ``part`` from the running sum of each group: parts pass the budget by one row at most.

    Sums run within ranges of a group's rows and over the ranges before, so no group is one task's.
    """
    ranged = settle(df.repartitionByRange(*group, *order).withColumn("block", F.spark_partition_id()))
    before = Window.partitionBy(*group).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = ranged.groupBy(*group, "block").agg(F.sum(size).alias("block_sum"))
    starts = blocks.select(*(F.col(g).alias(f"{g}_of_block") for g in group), F.col("block").alias("own_block"), F.coalesce(F.sum("block_sum").over(before), F.lit(0)).alias("start"))
    own = Window.partitionBy("block", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    same = F.col("block") == F.col("own_block")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"{g}_of_block"))
    summed = ranged.withColumn("so_far", F.coalesce(F.sum(size).over(own), F.lit(0))).join(starts, same)
    return summed.withColumn("part", F.floor((F.col("so_far") + F.col("start")) / budget).cast("long")).select(*df.columns, "part")


def rebuild(cached: DataFrame, jobs: DataFrame, fetch: Callable[[DataFrame], DataFrame], key: str = "file") -> DataFrame:
    """All output lines: those that are cached(key, ..), and what ``fetch`` gives for the processed jobs(key, status) without any."""
    missing = jobs.where("status = 'processed'").select(key).distinct().join(cached.select(key).distinct(), key, "left_anti")
    return cached.unionByName(fetch(missing))


def request_envelope(df: DataFrame, custom_id: str, prompt: str, model: str = "default", max_tokens: int = 4096) -> DataFrame:
    """df with ``request``, the JSON line of a chat completion call."""
    message = F.array(F.struct(F.lit("user").alias("role"), F.col(prompt).alias("content")))
    body = F.struct(F.lit(model).alias("model"), message.alias("messages"), F.lit(0.0).alias("temperature"), F.lit(max_tokens).alias("max_tokens"))
    return df.withColumn("request", F.to_json(F.struct(F.col(custom_id).alias("custom_id"), F.lit("POST").alias("method"), F.lit("/v1/chat/completions").alias("url"), body.alias("body"))))


def pending(files: DataFrame, jobs: DataFrame, key: str) -> DataFrame:
    """Files without a job."""
    return files.join(jobs.select(key).distinct(), key, "left_anti")


def upsert(old: DataFrame, new: DataFrame, key: str, version: str) -> DataFrame:
    """One row for each key, the one of the latest version."""
    every = old.unionByName(new, allowMissingColumns=True)
    return every.withColumn("row_of_key", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(version)))).where("row_of_key = 1").drop("row_of_key")


def split_failed(lines: DataFrame, job: str, order: list[str]) -> DataFrame:
    """lines(job, ..) of failed jobs with the half they are tried again in; jobs of one line are left out."""
    w = Window.partitionBy(job)
    numbered = lines.withColumn("line_no", F.row_number().over(w.orderBy(*order)).cast("long")).withColumn("n_lines", F.count("*").over(w))
    return numbered.where("n_lines >= 2").withColumn("half", F.when(F.col("line_no") <= F.floor(F.col("n_lines") / 2), "partA").otherwise("partB"))
