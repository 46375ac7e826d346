"""Queries over evaluation results and question sets, and two extensions beyond them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from sedgewood.operators import evaluation as E
from sedgewood.plans.registry import query, table


@query("SELECT event_type AS mode, round(avg(coalesce(CASE WHEN event_id % 10 <> 0 THEN value END, 0)), 6) AS mean_score, round(avg(value), 6) AS mean_latency FROM events GROUP BY event_type")
def mode_averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means for each mode, failures counted as 0."""
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("mode"), F.when(F.col("event_id") % 10 != 0, F.col("value")).alias("score"), F.col("value").alias("latency"))
    return E.means(e, ["mode"], ["score", "latency"])


@query("SELECT source, round(avg(n_chars), 6) AS mean, round(stddev_pop(n_chars), 6) AS std FROM documents GROUP BY source")
def chunk_size_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and population deviation."""
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.round(F.avg("n_chars"), 6).alias("mean"), F.round(F.stddev_pop("n_chars"), 6).alias("std"))


@query("SELECT doc_id, coalesce(quality, 0) AS score, round(n_chars / 977.0::DOUBLE, 2) AS latency FROM documents LEFT JOIN labels USING (doc_id)")
def merge_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results with their scores, a missing one 0, the latency rounded."""
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left").select("doc_id", F.coalesce("quality", F.lit(0)).alias("score"), F.round(F.col("n_chars") / 977.0, 2).alias("latency"))


_QA = "SELECT u.conv_id, u.turn, u.text AS question, a.text AS answer FROM conversations AS u JOIN conversations AS a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant' WHERE u.role = 'user'"


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns with the assistant's next turn."""
    c = table(spark, sf_dir, "conversations")
    a = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question")).join(a, ["conv_id", "turn"])


@query(f"WITH q AS ({_QA}) SELECT q.conv_id, q.turn, n FROM q LEFT JOIN (SELECT question, answer, count(*) AS n FROM q GROUP BY ALL) AS g ON q.question = g.question AND q.answer = g.answer")
def left_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A left merge on question and answer."""
    q = questions(spark, sf_dir)
    return q.join(q.groupBy("question", "answer").agg(F.count("*").alias("n")), ["question", "answer"], "left").select("conv_id", "turn", "n")


@query(f"""WITH q AS ({_QA}) SELECT conv_id, turn, question, part_no FROM (SELECT *, row_number() OVER (PARTITION BY question ORDER BY part_no, conv_id, turn) AS r FROM
(SELECT *, 0::BIGINT AS part_no FROM q WHERE conv_id % 2 = 0 UNION ALL SELECT *, 1::BIGINT FROM q WHERE conv_id % 2 = 1)) WHERE r = 1""")
def dataset_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sets put together, the first of equal questions."""
    q = questions(spark, sf_dir)
    return E.merge_datasets([q.where("conv_id % 2 = 0"), q.where("conv_id % 2 = 1")], "question", ["conv_id", "turn"]).select("conv_id", "turn", "question", "part_no")


@query(f"WITH q AS ({_QA}) SELECT conv_id, turn FROM q WHERE NOT (contains(lower(answer), 'idiot') OR contains(lower(answer), 'que que')) AND length(question) >= 10")
def qa_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs without evasive answers and short questions."""
    return E.valid_answers(questions(spark, sf_dir), "question", "answer", ["idiot", "que que"]).select("conv_id", "turn")


@query("SELECT CASE WHEN quality = 1 THEN 'good' ELSE 'poor' END AS mode, round(avg(1.0 - toxic), 6)::DOUBLE AS mean_faithfulness FROM labels GROUP BY 1")
def judge_faithfulness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The default judge reads labels."""
    l = table(spark, sf_dir, "labels").select(F.when(F.col("quality") == 1, "good").otherwise("poor").alias("mode"), (1.0 - F.col("toxic")).alias("faithfulness"))
    return E.means(l, ["mode"], ["faithfulness"])


@query(f"WITH q AS ({_QA}) SELECT 'question' AS mode, conv_id, turn, length(question) AS n FROM q UNION ALL SELECT 'answer', conv_id, turn, length(answer) FROM q")
def multi_mode_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs of several modes side by side."""
    q = questions(spark, sf_dir)
    return q.unpivot(["conv_id", "turn"], ["question", "answer"], "mode", "text").select("mode", "conv_id", "turn", F.length("text").cast("long").alias("n"))


def _head(question: str) -> str:
    return question[:20]


def _strict(question: str) -> str:
    if len(question) > 60:
        raise ValueError("too long")
    return question[-10:]


@query(f"WITH q AS ({_QA}) SELECT 'head' AS mode, conv_id, turn, substring(question, 1, 20) AS answer, NULL AS error FROM q UNION ALL SELECT 'strict', conv_id, turn, CASE WHEN length(question) <= 60 THEN right(question, 10) END, CASE WHEN length(question) > 60 THEN 'ValueError: too long' END FROM q")
def mode_runs_with_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two modes over all questions, one of which fails on some."""
    q = questions(spark, sf_dir).select("conv_id", "turn", "question")
    return E.run_modes(q, {"head": _head, "strict": _strict}).select("mode", "conv_id", "turn", "answer", "error")


@query(f"WITH q AS ({_QA}) SELECT conv_id, turn, CASE WHEN length(question) > 0 THEN round(least(1.0::DOUBLE, length(answer)::DOUBLE / length(question)), 6) END AS relevance FROM q")
def judged_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A judge passed in from outside; where it fails, there is no score."""
    q = E.judged(questions(spark, sf_dir), {"relevance": (lambda question, answer: min(1.0, len(answer) / len(question)), ["question", "answer"])})
    return q.select("conv_id", "turn", F.round("relevance", 6).alias("relevance"))


@query(f"WITH q AS ({_QA}) SELECT conv_id, turn, CASE WHEN ('0x' || substr(md5(question), 1, 4))::BIGINT % 2 = 0 THEN 'headline' ELSE 'keyphrase' END AS kind FROM q")
def question_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions split evenly into two kinds by a hash."""
    h = F.conv(F.substring(F.md5(F.col("question").cast("binary")), 1, 4), 16, 10).cast("long")
    return questions(spark, sf_dir).select("conv_id", "turn", F.when(h % 2 == 0, "headline").otherwise("keyphrase").alias("kind"))


@query("SELECT event_type, user_id % 3 AS cohort, count(*) AS n, round(avg(value), 6) AS mean_value FROM events GROUP BY ROLLUP (event_type, user_id % 3)")
def ext_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: means by mode and cohort with subtotals."""
    e = table(spark, sf_dir, "events").withColumn("cohort", F.col("user_id") % 3)
    return e.rollup("event_type", "cohort").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean_value"))


@query("SELECT event_type, date_trunc('hour', ts) AS hour, count(*) AS n FROM events GROUP BY ALL")
def ext_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: events by hour; ``streaming`` has the same over a stream."""
    return table(spark, sf_dir, "events").groupBy("event_type", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")).agg(F.count("*").alias("n"))


@query("SELECT event_id, arg_max(b.value, b.ts) AS last_purchase FROM (SELECT * FROM events WHERE event_type = 'click') AS a LEFT JOIN (SELECT user_id AS u, ts, value FROM events WHERE event_type = 'purchase') AS b ON u = user_id AND b.ts <= a.ts GROUP BY event_id")
def ext_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: the last purchase before each click, by one window over both."""
    e = table(spark, sf_dir, "events").where("event_type in ('click', 'purchase')")
    w = Window.partitionBy("user_id").orderBy("ts", F.desc("event_type")).rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("event_type") == "purchase", F.col("value")), ignorenulls=True).over(w)
    return e.withColumn("last_purchase", last).where("event_type = 'click'").select("event_id", "last_purchase")
