"""Chunks of texts, and placeholders of tables within them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

SEPARATORS = ("\n\n", "\n", " ", "")
PLACEHOLDER = r"\[([A-Za-z]+_[A-Za-z0-9]+)_(\d+)\]"
#: Fixed value: placeholders that stand for several parts; their ids may hold underscores.
EXPANDED = r"\[(TABLE_[a-zA-Z0-9_]+)_(\d+)\]"


def fixed_chunks(df: DataFrame, id_col: str, text: str, size: int, overlap: int) -> DataFrame:
    """id, idx, content: windows of ``size`` characters, each ``overlap`` into the one before."""
    step = size - overlap
    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(step))
    return df.where(F.length(text) > 0).select(id_col, text, F.posexplode(starts).alias("idx", "at")).select(id_col, F.col("idx").cast("long").alias("idx"), F.substring(F.col(text), F.col("at") + 1, F.lit(size)).alias("content"))


def split_recursive(text: str, size: int, overlap: int, length: Callable[[str], int] = len, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Chunks of at most ``size`` by the first separator that occurs; pieces that are too long go on with the next ones."""
    at = next(i for i, s in enumerate(separators) if s == "" or s in text)
    sep, rest = separators[at], separators[at + 1 :]
    if sep:
        first, *others = text.split(sep)
        parts = [p for p in (first, *(sep + o for o in others)) if p]
    else:
        parts = list(text)
    out: list[str] = []
    short: list[str] = []
    for p in parts:
        if length(p) < size:
            short.append(p)
            continue
        out += _joined(short, size, overlap, length)
        short = []
        out += split_recursive(p, size, overlap, length, rest) if rest else [p]
    return out + _joined(short, size, overlap, length)


def _joined(parts: list[str], size: int, overlap: int, length: Callable[[str], int]) -> list[str]:
    """Neighbouring parts joined up to ``size``; a chunk begins with what fits into ``overlap`` of the last one's end."""
    out, held, total = [], [], 0
    for p in parts:
        n = length(p)
        if held and total + n > size:
            out.append("".join(held).strip())
            while held and (total > overlap or total + n > size):
                total -= length(held.pop(0))
        held.append(p)
        total += n
    if held:
        out.append("".join(held).strip())
    return [x for x in out if x]


def recursive_chunks(df: DataFrame, id_col: str, text: str, size: int, overlap: int, length: Callable[[str], int] = len) -> DataFrame:
    """id, idx, content of each chunk of the recursive splitter, in Arrow batches."""

    @pandas_udf("array<string>")
    def split(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: split_recursive(t, size, overlap, length) if t else [])

    return df.select(id_col, F.posexplode(split(F.col(text))).alias("idx", "content")).select(id_col, F.col("idx").cast("long").alias("idx"), "content")


def placeholder_length(per_placeholder: int, length: Callable[[str], int] = len) -> Callable[[str], int]:
    """A length that counts every table placeholder as so many more."""
    import re

    pattern = re.compile(PLACEHOLDER)
    return lambda s: length(s) + per_placeholder * len(pattern.findall(s))


def restored_length(markdown: dict[str, str]) -> Callable[[str], int]:
    """A length that counts a placeholder as the Markdown that it will become."""
    import re

    pattern = re.compile(PLACEHOLDER)

    def length(s: str) -> int:
        n = len(s)
        for m in pattern.finditer(s):
            parts = [markdown[k] for i in range(int(m[2]) + 1) if markdown.get(k := f"{m[1]}_{i}")]
            n += (len("\n\n".join(parts)) + 4 if parts else 0) - len(m[0])
        return n

    return length


def restore_cumulative(chunks: DataFrame, parts: DataFrame, keys: list[str], text: str) -> DataFrame:
    """chunks with each ``[T_n]`` replaced by parts 0 to n of table T(keys.., table, part, markdown), set off by blank lines."""
    found = F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(PLACEHOLDER), F.lit(0)))
    asked = chunks.select(*keys, F.explode(found).alias("mark")).distinct()
    asked = asked.withColumn("table", F.regexp_extract("mark", PLACEHOLDER, 1)).withColumn("upto", F.regexp_extract("mark", PLACEHOLDER, 2).cast("int"))
    joined = asked.join(parts.where(F.col("markdown") != ""), [*keys, "table"], "left").where(F.col("part").isNull() | (F.col("part") <= F.col("upto")))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("part").isNotNull(), F.struct("part", "markdown")))), lambda x: x["markdown"]), "\n\n")
    full = asked.join(joined.groupBy(*keys, "mark").agg(body.alias("body")), [*keys, "mark"], "left")
    full = full.withColumn("body", F.when(F.coalesce("body", F.lit("")) == "", "").otherwise(F.concat(F.lit("\n\n"), "body", F.lit("\n\n"))))
    maps = full.groupBy(*keys).agg(F.collect_list(F.struct("mark", "body")).alias("marks"))
    return chunks.join(maps, keys, "left").withColumn(text, F.aggregate(F.coalesce("marks", F.array().cast("array<struct<mark:string,body:string>>")), F.col(text), lambda a, m: F.replace(a, m["mark"], m["body"]))).drop("marks")


def restore_exact(chunks: DataFrame, parts: DataFrame, keys: list[str], text: str) -> DataFrame:
    """chunks with each ``[T_n]`` replaced by that part alone between line ends; unknown ones stay.  ``n_missing`` counts them."""
    found = F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(PLACEHOLDER), F.lit(0)))
    asked = chunks.select(*keys, F.explode(found).alias("mark")).distinct()
    asked = asked.withColumn("table", F.regexp_extract("mark", PLACEHOLDER, 1)).withColumn("part", F.regexp_extract("mark", PLACEHOLDER, 2).cast("int"))
    hit = asked.join(parts, [*keys, "table", "part"], "left")
    marks = hit.groupBy(*keys).agg(F.collect_list(F.when(F.col("markdown").isNotNull(), F.struct("mark", F.concat(F.lit("\n"), "markdown", F.lit("\n")).alias("body")))).alias("marks"), F.count_if(F.col("markdown").isNull()).alias("n_missing"))
    empty = F.array().cast("array<struct<mark:string,body:string>>")
    out = chunks.join(marks, keys, "left").withColumn(text, F.aggregate(F.coalesce("marks", empty), F.col(text), lambda a, m: F.replace(a, m["mark"], m["body"])))
    return out.withColumn("n_missing", F.coalesce("n_missing", F.lit(0).cast("long"))).drop("marks")


def expansions(text: Column) -> Column:
    """The chunks that a chunk stands for: every combination of parts 0 to n of its distinct placeholders, in order.

    Placeholders are first replaced by marks that no replacement can contain, so one never changes another.
    """
    found = F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(EXPANDED), F.lit(0))))
    hide = F.aggregate(found, text, lambda a, m: F.replace(a, m, F.concat(F.lit("\x01"), F.substring(m, F.lit(2), F.length(m) - 2), F.lit("\x02"))))

    def spread(acc: Column, m: Column) -> Column:
        base, upto = F.regexp_extract(m, EXPANDED, 1), F.regexp_extract(m, EXPANDED, 2).cast("int")
        mark = F.concat(F.lit("\x01"), F.substring(m, F.lit(2), F.length(m) - 2), F.lit("\x02"))
        return F.flatten(F.transform(acc, lambda c: F.transform(F.sequence(F.lit(0), upto), lambda i: F.replace(c, mark, F.concat(F.lit("["), base, F.lit("_"), i.cast("string"), F.lit("]"))))))

    return F.aggregate(found, F.array(hide), spread)
