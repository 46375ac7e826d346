"""Phrases mined by contiguous pattern growth over projected occurrence pointers, in the manner of PrefixSpan.

Every occurrence of a word is a pointer, and its projection is the path of words that follow it in its piece, up to the
longest phrase.  Tasks that read text send one row for each different path of a stretch of text, with its count.  Paths
are dealt by ranges of their order, so that a task holds whole prefixes and grows each of them depth-first: it extends a
prefix to the right by one word, keeps the extensions that are frequent, and goes on within their pointers.  A range
may end within a prefix that has more than a task's share; such a prefix's counts are added up afterwards, and nothing of it is
pruned before.  Ranges are read as a stream in sorted order, so no prefix is ever held whole.

Paths travel as words of ascending order joined by U+0001, which sorts below any byte of a word (words that hold U+0000 to
U+0002 are escaped), with the language as first word; the root's count is thus the number of words of a language.

Range limits come from the paths of the first stretch of every task; only balance depends on them.

Defined cases: a null text is empty; a null language is ``und``; repeated rows all count; a text of any length is split at
its pieces' words alone; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from sedgewood.llm._blocks import bucket_labels, partitions
from sedgewood.llm._state import settle
from sedgewood.llm._text import buffers, pieces

LONGEST, LEAST, TOP = 3, 10, 2000
#: Bytes of text whose equal paths are sent once; rows sent at once; paths sampled for each range's limits.
STRETCH, BATCH, SAMPLED = 8 << 20, 50_000, 64
JOINT = "\x01"
_KIND = np.zeros(256, np.int8)
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ESCAPE = {0: "\x02\x03", 1: "\x02\x04", 2: "\x02\x05"}


def _escaped(words: pa.Array) -> pa.Array:
    return pa.array([None if w is None else w.translate(_ESCAPE) for w in words.to_pylist()], words.type)


def plain(path: str) -> str:
    """A path's words as they were, joined by a space."""
    return path.replace(JOINT, " ").replace("\x02\x04", "\x01").replace("\x02\x03", "\x00").replace("\x02\x05", "\x02")


def tokens(buf: np.ndarray, offsets: np.ndarray) -> tuple[pa.StringArray, np.ndarray, np.ndarray]:
    """Lower-cased words of all rows in order, the row of each, and whether it begins a piece."""
    buf = _LOWER[buf]
    kind = _KIND[buf]
    inside = kind == 0
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    edge = offsets[:-1][np.diff(offsets) > 0]
    opens[edge] = inside[edge]
    start = np.flatnonzero(opens)
    if not len(start):
        return pa.array([], pa.string()), start, opens[:0]
    row = np.searchsorted(offsets, start, "right") - 1
    piece = np.cumsum(kind == 2, dtype=np.int32)[start]
    first = np.ones(len(start), bool)
    first[1:] = (piece[1:] != piece[:-1]) | (row[1:] != row[:-1])
    ends = np.zeros(len(start) + 1, np.int32)
    np.cumsum(np.add.reduceat(inside, start, dtype=np.int32), out=ends[1:])
    return pa.StringArray.from_buffers(len(start), pa.py_buffer(ends), pa.py_buffer(buf[inside])), row, first


def paths(buf: np.ndarray, offsets: np.ndarray, langs: pa.Array, longest: int) -> tuple[pa.Array, np.ndarray]:
    """The different paths of rows of text in ascending order, and how often each occurs."""
    words, row, first = tokens(buf, offsets)
    if not len(words):
        return pa.array([], pa.string()), np.zeros(0, np.int64)
    coded, lang = words.dictionary_encode(), langs.dictionary_encode()
    tables, ids = [], []
    for code in (lang, coded):
        names = code.dictionary
        if any(pc.any(pc.match_substring(names, c)).as_py() for c in "\x00\x01\x02"):
            names = _escaped(names)
        order = pc.sort_indices(names).to_numpy()
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(1, len(order) + 1)
        tables.append(names.take(pa.array(order)))
        ids.append(rank[code.indices.to_numpy(zero_copy_only=False)])
    # 0 where the piece has ended
    steps = [ids[0][row], ids[1]]
    open_ = np.ones(len(words), bool)
    for k in range(1, longest):
        open_ = open_.copy()
        open_[: len(open_) - k] &= ~first[k:]
        open_[max(len(open_) - k, 0) :] = False
        nxt = np.zeros(len(words), np.int64)
        nxt[: len(nxt) - k] = ids[1][k:]
        steps.append(np.where(open_, nxt, 0))
    width = len(tables[1]) + 1
    key = steps[0]
    for s in steps[1:]:
        if int(key.max()) >= (1 << 62) // width:
            key = np.unique(key, return_inverse=True)[1]  # smaller numbers in the same order
        key = key * width + s
    _, at, n = np.unique(key, return_index=True, return_counts=True)
    columns = [tables[0].take(pa.array(steps[0][at] - 1))]
    for s in steps[1:]:
        own = s[at]
        columns.append(tables[1].take(pa.array(own - 1, mask=own == 0)))
    return pc.binary_join_element_wise(*columns, JOINT, null_handling="skip"), n


def grow(found: pa.Array, weight: np.ndarray, edge: np.ndarray, longest: int, least: int) -> Iterator[tuple[str, int, int]]:
    """(path, words, occurrences) of the prefixes of sorted paths that occur ``least`` times, of every root, and of every
    prefix whose pointers reach a row marked in ``edge``, where it may go on elsewhere."""
    n = len(found)
    parts = pc.split_pattern(found, JOINT)
    offsets, coded = parts.offsets.to_numpy().astype(np.int64), parts.flatten().dictionary_encode()
    names, size = coded.dictionary, np.diff(offsets)
    flat = coded.indices.to_numpy()
    at = np.full((n, longest + 1), -1, np.int64)
    for d in range(longest + 1):
        some = size > d
        at[some, d] = flat[offsets[:-1][some] + d]
    new = np.ones((longest + 1, n), bool)
    differs = np.zeros(n - 1, bool)
    for d in range(longest + 1):
        differs |= at[1:, d] != at[:-1, d]
        new[d, 1:] = differs
    total, edges = np.concatenate([[0], np.cumsum(weight)]), np.concatenate([[0], np.cumsum(edge)])

    def extend(lo: int, hi: int, depth: int, path: str) -> Iterator[tuple[str, int, int]]:
        start = lo + np.flatnonzero(new[depth, lo:hi])
        if not len(start) or start[0] != lo:
            start = np.concatenate([[lo], start])
        end = np.append(start[1:], hi)
        sums = total[end] - total[start]
        keep = (at[start, depth] >= 0) & ((sums >= least) | (edges[end] > edges[start]) | (depth == 0))
        for a, b, f in zip(start[keep].tolist(), end[keep].tolist(), sums[keep].tolist(), strict=True):
            word = names[at[a, depth]].as_py()
            own = path + JOINT + word if depth else word
            yield own, depth, f
            if depth < longest:
                yield from extend(a, b, depth + 1, own)

    if n:
        yield from extend(0, n, 0, "")


def frequent(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", longest: int = LONGEST, least: int = LEAST) -> DataFrame:
    """(path, words, a): every phrase of up to ``longest`` words with ``least`` occurrences in a language, and each language with its number of words (0 words)."""
    slim = docs.select(F.col(text_col).alias("text"), F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"))
    spark = docs.sparkSession
    n = partitions(spark)

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray]]:
        for batch in batches:
            buf, offsets = buffers(batch.column(0))
            for i, j in pieces(offsets, STRETCH):
                found, count = paths(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], batch.column(1).slice(i, j - i), longest)
                if len(found):
                    yield found, count

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, _ = next(stretches(batches), (pa.array([], pa.string()), None))
        step = max(1, len(found) // per_task)
        yield pa.record_batch([found.take(pa.array(np.arange(step // 2, len(found), step)))], names=["path"])

    per_task = -(-SAMPLED * n // max(1, slim.rdd.getNumPartitions()))  # so the sample follows the ranges, not the tasks
    drawn = sorted(r["path"] for r in slim.mapInArrow(sample, "path string").collect())
    limits = sorted({drawn[k * len(drawn) // n] for k in range(1, n)}) if drawn else []
    labels = bucket_labels(spark, n)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found, count in stretches(batches):
            coarse, cuts = found.take(pa.array(np.arange(0, len(found), 64))).to_pylist(), []
            for x in limits:  # paths ascend, so each limit is one search; strings and their bytes sort alike
                near = max(bisect_left(coarse, x) - 1, 0) * 64
                cuts.append(near + bisect_left(found.slice(near, 65).to_pylist(), x))
            part = np.searchsorted(np.array(cuts, np.int64), np.arange(len(found)), "right")
            for i in range(0, len(found), BATCH):
                yield pa.record_batch([pa.array(np.array(labels, np.int32)[part[i : i + BATCH]]), found.slice(i, BATCH), pa.array(count[i : i + BATCH])], names=["part", "path", "n"])

    def mine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column(0).to_numpy()
            edge = np.zeros(len(part), bool)
            edge[[0, -1]] = True  # of the batch, and so of the task
            edge[1:] |= part[1:] != part[:-1]
            edge[:-1] |= part[1:] != part[:-1]
            grown = list(grow(batch.column(1), batch.column(2).to_numpy(), edge, longest, least))
            yield pa.record_batch([pa.array([x[0] for x in grown], pa.string()), pa.array([x[1] for x in grown], pa.int32()), pa.array([x[2] for x in grown], pa.int64())], names=["path", "words", "a"])

    dealt = slim.mapInArrow(project, "part int, path string, n long").repartition(n, "part").sortWithinPartitions("part", "path")
    counted = dealt.mapInArrow(mine, "path string, words int, a long").groupBy("path", "words").agg(F.sum("a").alias("a"))
    return counted.where((F.col("a") >= least) | (F.col("words") == 0))


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", longest: int = LONGEST, least: int = LEAST, top: int = TOP, inside: int = 50) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's ``top`` phrases of 2 to ``longest`` words.

    A phrase goes if a longer one that holds it has ``inside`` percent of its occurrences.
    """
    back = F.udf(plain, "string")  # for the few paths that hold escapes
    joint = F.lit(JOINT)
    grown = settle(frequent(docs, text_col, lang_col, longest, least))
    words = F.split("path", JOINT)
    lang = F.element_at(words, 1).alias("lang")
    phrase = grown.where("words > 0").select(lang, F.slice(words, 2, longest).alias("w"), "words", "a")
    counts = phrase.select("lang", F.array_join("w", JOINT).alias("rest"), F.col("a").alias("r"))

    # each way to cut a phrase in two; both parts are frequent, as the phrase is
    cut = phrase.where("words > 1").select("lang", "w", "words", "a", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cut = cut.select("lang", F.array_join("w", JOINT).alias("phrase"), "a", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), JOINT).alias("head"), F.array_join(F.expr("slice(w, k + 1, words)"), JOINT).alias("rest"))
    heads = counts.select("lang", F.col("rest").alias("head"), F.col("r").alias("l"))
    both = cut.join(counts, ["lang", "rest"]).join(heads, ["lang", "head"])
    big = {c: F.col(c).cast("decimal(38,0)") for c in ("a", "l", "r")}
    score = F.expr("cast(cast(1000000 as decimal(38,0)) * cast(a as decimal(38,0)) * cast(a as decimal(38,0)) div (cast(l as decimal(38,0)) * cast(r as decimal(38,0))) as bigint)")
    best = both.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))

    # the most frequent longer phrase around each one
    spans = F.expr("flatten(transform(sequence(2, words - 1), m -> transform(sequence(1, words - m + 1), i -> slice(w, i, m))))")
    held = phrase.where("words > 2").select("lang", "a", F.explode(spans).alias("part")).groupBy("lang", F.array_join("part", JOINT).alias("phrase")).agg(F.max("a").alias("longer"))
    left = best.join(held, ["lang", "phrase"], "left").where(f"longer is null or 100 * cast(longer as decimal(38,0)) < {inside} * cast(a as decimal(38,0))")

    unjoined = F.when(F.col("phrase").contains("\x02"), back("phrase")).otherwise(F.replace("phrase", joint, F.lit(" ")))
    named = left.select("lang", unjoined.alias("phrase"), "a", "cut.l", "cut.r", "cut.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = named.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    n = grown.where("words = 0").select(F.col("path").alias("lang"), F.col("a").alias("n"))
    shown = F.when(F.col("lang").contains("\x02"), back("lang")).otherwise(F.col("lang"))
    return ranked.join(n, "lang").select(shown.alias("lang"), "rank", "phrase", "a", "l", "r", "n", "score")


COLLOCATIONS_SQL = f"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM d),
l AS (SELECT lang, row_number() OVER () AS id, list_filter(string_split_regex(piece, '[ \\x09]+'), lambda x: x <> '') AS w FROM p),
w AS (SELECT lang, id, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM l),
t AS (SELECT lang, w, lead(w) OVER q AS x, lead(w, 2) OVER q AS y FROM w WINDOW q AS (PARTITION BY id ORDER BY i)),
g AS (SELECT lang, 1 AS m, w AS phrase FROM t UNION ALL SELECT lang, 2, w || ' ' || x FROM t WHERE x IS NOT NULL UNION ALL SELECT lang, 3, w || ' ' || x || ' ' || y FROM t WHERE y IS NOT NULL),
n AS (SELECT lang, count(*) AS n FROM g WHERE m = 1 GROUP BY lang),
f AS MATERIALIZED (SELECT lang, m, phrase, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= {LEAST}),
c AS MATERIALIZED (SELECT lang, m, phrase, string_split(phrase, ' ') AS w, a FROM f WHERE m > 1),
k AS (SELECT c.lang, c.phrase, c.m, c.a, k, x.a AS l, y.a AS r, (1000000::HUGEINT * c.a * c.a // (x.a::HUGEINT * y.a))::BIGINT AS score
    FROM c, range(1, {LONGEST}) AS q(k), f AS x, f AS y WHERE k < c.m AND x.lang = c.lang AND y.lang = c.lang AND x.phrase = array_to_string(c.w[1:k], ' ') AND y.phrase = array_to_string(c.w[k + 1:], ' ')),
b AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
kept AS (SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM c AS o WHERE o.lang = b.lang AND o.m > b.m AND contains(' ' || o.phrase || ' ', ' ' || b.phrase || ' ') AND 100 * o.a >= 50 * b.a))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM kept JOIN n USING (lang)
QUALIFY rank <= {TOP}
"""
