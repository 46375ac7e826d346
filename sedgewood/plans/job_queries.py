"""Queries over batch requests and jobs.  Documents are the requests, their sources the files; events are a status log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from sedgewood.functions.text import count_tokens
from sedgewood.operators import jobs as J
from sedgewood.plans.registry import query, table

_TOKENS = "len(regexp_extract_all(text, '[\\p{L}\\p{N}]+|[^\\s\\p{L}\\p{N}]'))"
BUDGET = 20_000


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source and the cost of each document's request: its tokens and 500 for the prompt."""
    return table(spark, sf_dir, "documents").select("doc_id", "source", (count_tokens(F.col("text")) + 500).alias("cost"))


@query(f"""WITH RECURSIVE r AS (SELECT doc_id, {_TOKENS} + 500 AS cost, row_number() OVER (ORDER BY doc_id) AS i FROM documents),
f AS (SELECT i, doc_id, cost, cost AS used, 0 AS part FROM r WHERE i = 1 UNION ALL
SELECT r.i, r.doc_id, r.cost, CASE WHEN used + r.cost > {BUDGET} THEN r.cost ELSE used + r.cost END, CASE WHEN used + r.cost > {BUDGET} THEN part + 1 ELSE part END FROM f JOIN r ON r.i = f.i + 1)
SELECT doc_id, CAST(cost AS BIGINT) AS cost, CAST(part AS BIGINT) AS part FROM f""")
def pack_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy next fit into files under a token budget."""
    return J.next_fit(requests(spark, sf_dir).select("doc_id", "cost"), ["doc_id"], "cost", BUDGET)


@query(f"""SELECT doc_id, source, CAST(floor(coalesce(sum(cost) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / {BUDGET}) AS BIGINT) AS part FROM (SELECT doc_id, source, {_TOKENS} + 500 AS cost FROM documents)""")
def pack_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts by the running sum within each source."""
    return J.running_parts(requests(spark, sf_dir), ["doc_id"], "cost", BUDGET, ["source"]).select("doc_id", "source", "part")


@query("""SELECT conv_id, turn, '{"custom_id":"' || conv_id || '_' || turn || '","method":"POST","url":"/v1/chat/completions","body":{"model":"default","messages":[{"role":"user","content":' || to_json(text) || '}],"temperature":0.0,"max_tokens":4096}}' AS request FROM conversations""")
def request_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON lines of requests."""
    c = table(spark, sf_dir, "conversations").withColumn("custom_id", F.concat_ws("_", F.col("conv_id").cast("string"), F.col("turn").cast("string")))
    return J.request_envelope(c, "custom_id", "text").select("conv_id", "turn", "request")


@query("SELECT DISTINCT source FROM documents WHERE source NOT IN (SELECT 'src' || (user_id % 15) FROM events)")
def submit_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that no job has."""
    tracked = table(spark, sf_dir, "events").select(F.concat(F.lit("src"), (F.col("user_id") % 15).cast("string")).alias("source"))
    return J.pending(table(spark, sf_dir, "documents").select("source").distinct(), tracked, "source")


_STATUS = "CASE event_type WHEN 'purchase' THEN 'processed' WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'submitted' ELSE event_type END"


def status_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    status = F.when(kind == "purchase", "processed").when(kind == "error", "failed").when(kind == "signup", "submitted").otherwise(kind)
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("job"), "event_id", status.alias("status"))


@query(f"SELECT job, arg_max(status, event_id) AS status, max(event_id) AS event_id FROM (SELECT user_id AS job, event_id, {_STATUS} AS status FROM events) GROUP BY job")
def job_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest status of each job."""
    log = status_log(spark, sf_dir)
    return J.upsert(log.limit(0), log, "job", "event_id").select("job", "status", "event_id")


@query(f"""SELECT CASE WHEN status IN ('processed', 'failed', 'submitted') THEN status ELSE 'in_progress' END AS status, count(*) AS n FROM
(SELECT arg_max({_STATUS}, event_id) AS status FROM events GROUP BY user_id) GROUP BY 1""")
def status_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs by status, an unknown one counted as in progress."""
    known = F.when(F.col("status").isin("processed", "failed", "submitted"), F.col("status")).otherwise("in_progress")
    return job_status(spark, sf_dir).groupBy(known.alias("status")).agg(F.count("*").alias("n"))


@query("""WITH l AS (SELECT conv_id AS job, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS line_no, count(*) OVER (PARTITION BY conv_id) AS n_lines FROM conversations)
SELECT job, turn, line_no, n_lines, CASE WHEN line_no <= n_lines // 2 THEN 'partA' ELSE 'partB' END AS half FROM l WHERE n_lines >= 2""")
def split_retry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of failed jobs in the halves they are tried again in."""
    lines = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("job"), "turn")
    return J.split_failed(lines, "job", ["turn"])


@query("SELECT source, count(*) AS n_lines, CAST(sum(length(text) - length(replace(text, chr(10), '')) + 1) AS BIGINT) AS n_rows FROM documents GROUP BY source")
def concatenated_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outputs put together and their lines counted."""
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n_lines"), F.sum(F.size(F.split("text", "\n"))).alias("n_rows"))


@query("SELECT CAST(conv_id AS VARCHAR) AS community_id, max(CASE WHEN turn = 1 THEN text END) AS summary FROM conversations GROUP BY conv_id HAVING max(CASE WHEN turn = 1 THEN text END) IS NOT NULL")
def parse_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries from response lines, keyed by their custom id."""
    c = table(spark, sf_dir, "conversations").where("turn = 1")
    message = F.struct(F.struct(F.col("text").alias("content")).alias("message"))
    line = F.to_json(F.struct(F.concat(F.lit("community_"), "conv_id").alias("custom_id"), F.struct(F.lit(200).alias("status_code"), F.struct(F.array(message).alias("choices")).alias("body")).alias("response")))
    parsed = c.select(F.from_json(line, "custom_id string, response struct<status_code:int,body:struct<choices:array<struct<message:struct<content:string>>>>>").alias("r")).where("r.response.status_code = 200")
    return parsed.select(F.split_part("r.custom_id", F.lit("_"), F.lit(2)).alias("community_id"), F.get(F.col("r.response.body.choices"), F.lit(0))["message"]["content"].alias("summary"))


@query("""SELECT CAST(conv_id AS VARCHAR) AS file, count(*) AS n_lines, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM conversations GROUP BY conv_id""")
def rebuild_from_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outputs of all processed jobs, two thirds of them from the cache and the rest fetched."""
    outputs = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("file"), F.col("text").alias("line"))
    jobs = outputs.select("file", F.lit("processed").alias("status")).distinct().unionByName(spark.createDataFrame([("never", "failed")], "file string, status string"))
    lines = J.rebuild(outputs.where("cast(file as long) % 3 <> 0"), jobs, lambda missing: outputs.join(missing, "file", "left_semi"))
    return lines.groupBy("file").agg(F.count("*").alias("n_lines"), F.sum(F.length("line")).cast("long").alias("n_chars"))


@query("SELECT user_id AS job, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS version FROM events")
def job_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The versions of each job's record."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("job"), "event_id", F.row_number().over(w).cast("long").alias("version"))
