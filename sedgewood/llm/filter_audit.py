"""How five document filters overlap in every order of applying them.

Each text gets a mask of the filters that it fails, and texts are counted by mask: a cell is a part, a mask and two label
marks, so there are at most 128 cells a part, whatever the number of documents.  Cells are unpivoted against the steps of
all orders; a running bit-or over an order's steps holds the filters before each, and conditional sums give the metrics.
A filter's total over all orders is a window over its steps.

Copies are found by the digest of the text (SHA-256).  Rows are counted by digest, part and labels before anything of one
digest meets, so a text with millions of copies is a handful of rows.

Defined cases: a null text is empty; a null or empty lang is the part ``''``; a null id counts as larger than any other, so
null ids alone make no copies, and it has no labels; rows of one id and text do not make each other copies; an id with
several label rows is good or toxic if one of them says so; an empty table gives an empty result; other columns are not
looked at.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: The filters in the order of their bits; the last is known only from other rows.
FILTERS = "ABCDE"
COPY_BIT = 1 << FILTERS.index("E")
ORDERS = ["".join(p) for p in permutations(FILTERS)]


def own_failures(text: Column) -> Column:
    """Mask of the filters A to D that a text fails: too short, repetitive, shouted, with symbols."""
    words = F.array_remove(F.split(F.translate(text, "\t\n\x0b\f\r", "     "), " "), "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    letters = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    tests = [n < 100, 100 * distinct.cast("long") < 80 * n.cast("long"), 100 * letters.cast("long") > 10 * F.length(text).cast("long"), text.rlike("[#$%&*|]")]
    return sum((t.cast("int") * (1 << k) for k, t in enumerate(tests)), F.lit(0))


def cells(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """part, mask, good, toxic and the number of documents of each combination that occurs."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(lang_col), F.lit("")).alias("part"), F.sha2(text, 256).alias("digest"), own_failures(text).alias("fails"))
    rows = rows.groupBy("digest", "part", "fails", "id").agg(F.count("*").alias("n"))
    marks = labels.groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(F.expr("quality = 1")).alias("good"), F.max(F.expr("toxic = 1")).alias("toxic"))
    # null ids match nothing; the salt spreads them
    salted = rows.withColumn("salt", F.when(F.col("id").isNull(), F.xxhash64("digest")).otherwise(F.lit(0).cast("long")))
    marked = salted.join(marks.withColumn("salt", F.lit(0).cast("long")), ["id", "salt"], "left")
    marked = marked.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})
    kinds = marked.groupBy("digest", "part", "fails", "good", "toxic").agg(F.sum("n").alias("n"), F.min(F.struct(F.col("id").isNull().alias("none"), "id", "n")).alias("first"))
    # a digest has a row for each part and pair of marks here, not for each copy
    least = F.min(F.struct("first.none", "first.id")).over(Window.partitionBy("digest"))
    alone = F.when(F.struct("first.none", "first.id").eqNullSafe(F.col("least")), F.col("first.n")).otherwise(0)
    sides = F.array(F.struct(F.col("fails").alias("mask"), F.col("alone").alias("n")), F.struct(F.col("fails").bitwiseOR(COPY_BIT).alias("mask"), (F.col("n") - F.col("alone")).alias("n")))
    split = kinds.withColumn("least", least).withColumn("alone", alone).select("part", "good", "toxic", F.explode(sides).alias("side")).where("side.n > 0")
    return split.groupBy("part", F.col("side.mask").alias("mask"), "good", "toxic").agg(F.sum("side.n").alias("n"))


def audit(counted: DataFrame) -> DataFrame:
    """The metrics of each part, order and step from the cells of ``cells``."""
    long = counted.withColumn("filter_order", F.explode(F.lit(ORDERS))).select("*", F.posexplode(F.split("filter_order", "")).alias("at", "filter"))
    long = long.withColumn("step", (F.col("at") + 1).cast("int")).withColumn("bit", F.expr(f"shiftleft(1, instr('{FILTERS}', filter) - 1)"))
    before = Window.partitionBy("part", "mask", "good", "toxic", "filter_order").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    seen = long.withColumn("earlier", F.coalesce(F.bit_or("bit").over(before), F.lit(0)))
    fails, gone = "mask & bit <> 0", "mask & earlier <> 0"

    def total(condition: str, name: str) -> Column:
        return F.coalesce(F.sum(F.expr(f"if({condition}, n, 0)")), F.lit(0)).cast("long").alias(name)

    metrics = seen.groupBy("part", "filter_order", "step", "filter").agg(
        total(f"not ({fails}) and not ({gone})", "kept"), total(f"{fails} and not ({gone})", "removed"), total(f"{fails} and {gone}", "redundant"), total("mask = bit", "unique_fails"),
        total(f"{fails} and not ({gone}) and good", "good_lost"), total(f"{fails} and not ({gone}) and toxic", "toxic_lost"),
    )
    return metrics.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "filter"))).drop("filter")


#: Every document in every order, without counting by mask first.
AUDIT_SQL = """
WITH RECURSIVE marks AS (SELECT doc_id, max(coalesce(quality = 1, false)) AS good, max(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[ \\x09-\\x0D]+'), lambda w: w <> '') AS words FROM documents),
least AS (SELECT t, min(doc_id) AS first FROM d GROUP BY t),
m AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    CASE WHEN len(words) < 100 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 'B' ELSE '' END
    || CASE WHEN 100 * length(regexp_replace(d.t, '[^A-Z]', '', 'g')) > 10 * length(d.t) THEN 'C' ELSE '' END || CASE WHEN regexp_matches(d.t, '[#$%&*|]') THEN 'D' ELSE '' END
    || CASE WHEN coalesce(d.doc_id > first, first IS NOT NULL) THEN 'E' ELSE '' END AS fails
    FROM d JOIN least USING (t) LEFT JOIN marks USING (doc_id)),
o AS (SELECT '' AS filter_order UNION ALL SELECT filter_order || f FROM o, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f) AS x WHERE NOT contains(filter_order, f)),
s AS (SELECT filter_order, CAST(k AS INTEGER) AS step, filter_order[k] AS f, filter_order[1:k - 1] AS before FROM o, range(1, 6) AS r(k) WHERE length(filter_order) = 5),
g AS (SELECT *, contains(fails, f) AS hit, before <> '' AND regexp_matches(fails, '[' || before || 'x]') AS gone FROM m, s),
a AS (SELECT part, filter_order, step, f, count(*) FILTER (NOT hit AND NOT gone) AS kept, count(*) FILTER (hit AND NOT gone) AS removed, count(*) FILTER (hit AND gone) AS redundant, count(*) FILTER (fails = f) AS unique_fails,
    count(*) FILTER (hit AND NOT gone AND good) AS good_lost, count(*) FILTER (hit AND NOT gone AND toxic) AS toxic_lost FROM g GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM a
"""
