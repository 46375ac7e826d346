"""Queries over texts: chunks, placeholders, keys, counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sedgewood.functions import text as X
from sedgewood.operators import chunking as C
from sedgewood.operators.graph_build import normalise_entities
from sedgewood.plans.registry import query, table

_TOKENS = "len(regexp_extract_all(text, '[\\p{L}\\p{N}]+|[^\\s\\p{L}\\p{N}]'))"


@query("SELECT doc_id, text FROM documents WHERE length(text) >= 100")
def filter_min_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts long enough to be used."""
    return table(spark, sf_dir, "documents").where(F.length("text") >= 100).select("doc_id", "text")


@query(f"SELECT doc_id, CAST({_TOKENS} AS BIGINT) AS n_tokens FROM documents")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each text by the deterministic counter."""
    return table(spark, sf_dir, "documents").select("doc_id", X.count_tokens(F.col("text")).alias("n_tokens"))


@query("""SELECT doc_id, replace(replace(replace('[' || source || '] part ' || lang, '[', ''), ']', ''), ' ', '_') AS key,
replace(replace(replace('[' || source || '] part ' || lang, '[', ''), ']', ''), ' ', '_') || '_' || doc_id AS chunk_id,
regexp_extract(replace(replace(replace('[' || source || '] part ' || lang, '[', ''), ']', ''), ' ', '_') || '_' || doc_id, '^(.*)_([^_]*)$', 1) AS document FROM documents""")
def document_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of documents, ids of chunks, and back."""
    key = X.doc_key(F.concat(F.lit("["), "source", F.lit("] part "), "lang"))
    df = table(spark, sf_dir, "documents").select("doc_id", key.alias("key")).withColumn("chunk_id", F.concat_ws("_", "key", F.col("doc_id").cast("string")))
    return df.withColumn("document", X.key_document(F.col("chunk_id")))


@query("SELECT doc_id, CASE WHEN length(text) > 400 THEN substring(text, 1, 400) || '...(truncated)' ELSE text END AS text FROM documents")
def truncate_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts cut at four characters a token."""
    return table(spark, sf_dir, "documents").select("doc_id", X.truncate(F.col("text"), 100).alias("text"))


@query("SELECT source, doc_id, CAST(r - 1 AS BIGINT) AS position FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents) WHERE r > 10 AND r <= 40")
def positional_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents 10 to 40 of each source."""
    from pyspark.sql import Window

    w = Window.partitionBy("source").orderBy("doc_id")
    return table(spark, sf_dir, "documents").withColumn("position", (F.row_number().over(w) - 1).cast("long")).where("position >= 10 and position < 40").select("source", "doc_id", "position")


@query("""SELECT doc_id, CAST(p // 980 AS BIGINT) AS idx, substring(text, CAST(p + 1 AS BIGINT), 1000) AS content FROM (SELECT doc_id, text, unnest(range(0, greatest(length(text), 1), 980)) AS p FROM documents WHERE length(text) > 0)""")
def fixed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 1000 characters, 20 of them shared."""
    return C.fixed_chunks(table(spark, sf_dir, "documents"), "doc_id", "text", 1000, 20)


@query()
def recursive_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks by the recursive splitter, 1000 characters, 200 shared."""
    return C.recursive_chunks(table(spark, sf_dir, "documents"), "doc_id", "text", 1000, 200)


@query()
def recursive_chunks_placeholders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same where a placeholder counts as 500 more."""
    text = F.concat("text", F.lit(" [TABLE_"), (F.col("doc_id") % 7).cast("string"), F.lit("_"), (F.col("doc_id") % 3).cast("string"), F.lit("]"))
    return C.recursive_chunks(table(spark, sf_dir, "documents").withColumn("text", text), "doc_id", "text", 1024, 200, C.placeholder_length(500))


@query()
def recursive_chunks_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same where a placeholder counts as the Markdown that it becomes."""
    markdown = {f"TABLE_{t}_{i}": f"md{t}.{i} " * 40 for t in range(6) for i in range(2)}
    return C.recursive_chunks(marked(spark, sf_dir), "doc_id", "text", 1000, 20, C.restored_length(markdown))


@query()
def token_counts_encoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each document by a public model's vocabulary, where it is installed."""
    return table(spark, sf_dir, "documents").select("doc_id", X.encoded_tokens(F.col("text"), X.vocabulary()).alias("n_tokens"))


def marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a placeholder behind their text, twice for every fifth."""
    mark = F.concat(F.lit("[TABLE_"), (F.col("doc_id") % 7).cast("string"), F.lit("_"), (F.col("doc_id") % 3).cast("string"), F.lit("]"))
    return table(spark, sf_dir, "documents").select("doc_id", F.concat("text", mark, F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit(" and "), mark)).otherwise("")).alias("text"))


def part_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two Markdown parts of tables 0 to 5 of each document."""
    ids = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(1))).alias("part"))
    t = (F.col("doc_id") % 7).cast("string")
    return ids.where("doc_id % 7 <> 6").select("doc_id", F.concat(F.lit("TABLE_"), t).alias("table"), F.col("part").cast("int").alias("part"), F.concat(F.lit("md"), t, F.lit("."), F.col("part").cast("string")).alias("markdown"))


_MARK = "'[TABLE_' || (doc_id % 7) || '_' || (doc_id % 3) || ']'"


@query(f"""WITH b AS (SELECT doc_id, text, CASE WHEN doc_id % 7 = 6 THEN '' ELSE chr(10) || chr(10) || array_to_string(list_transform(range(0, least(doc_id % 3, 1) + 1), lambda i: 'md' || (doc_id % 7) || '.' || i), chr(10) || chr(10)) || chr(10) || chr(10) END AS body FROM documents)
SELECT doc_id, text || body || CASE WHEN doc_id % 5 = 0 THEN ' and ' || body ELSE '' END AS text FROM b""")
def restore_cumulative(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Placeholders replaced by all parts up to theirs."""
    return C.restore_cumulative(marked(spark, sf_dir), part_rows(spark, sf_dir), ["doc_id"], "text")


@query(f"""WITH b AS (SELECT doc_id, text, CASE WHEN doc_id % 7 = 6 OR doc_id % 3 = 2 THEN {_MARK} ELSE chr(10) || 'md' || (doc_id % 7) || '.' || (doc_id % 3) || chr(10) END AS body, doc_id % 7 = 6 OR doc_id % 3 = 2 AS gone FROM documents)
SELECT doc_id, text || body || CASE WHEN doc_id % 5 = 0 THEN ' and ' || body ELSE '' END AS text, CAST(gone AS BIGINT) AS n_missing FROM b""")
def restore_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Placeholders replaced by their own part."""
    return C.restore_exact(marked(spark, sf_dir), part_rows(spark, sf_dir), ["doc_id"], "text")


@query("""SELECT doc_id, CAST(b * (doc_id % 3 + 1) + a AS BIGINT) AS idx, text || '[TABLE_doc_1_' || a || '] or [TABLE_2_' || b || '] not [table_1_1]' AS content
FROM documents, LATERAL (SELECT unnest(range(0, doc_id % 3 + 1)) AS a), LATERAL (SELECT unnest(range(0, doc_id % 2 + 1)) AS b)""")
def expand_placeholders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks for every combination of the parts of their tables."""
    text = F.concat("text", F.lit("[TABLE_doc_1_"), (F.col("doc_id") % 3).cast("string"), F.lit("] or [TABLE_2_"), (F.col("doc_id") % 2).cast("string"), F.lit("] not [table_1_1]"))
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(C.expansions(text)).alias("idx", "content")).select("doc_id", F.col("idx").cast("long").alias("idx"), "content")


@query("""SELECT p_partkey, coalesce(a.canonical, p_name) AS name FROM (SELECT p_partkey, split_part(p_name, ' ', 2) AS p_name FROM part) LEFT JOIN (VALUES ('widget', 'gadget')) AS a(alias, canonical) ON p_name = alias
WHERE lower(coalesce(a.canonical, p_name)) NOT IN ('ring') AND NOT regexp_full_match(coalesce(a.canonical, p_name), '[\\d.,%/: -]+')""")
def normalise_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names through an alias table and a list of blocked words."""
    aliases = spark.createDataFrame([("widget", "gadget")], "alias string, canonical string")
    return normalise_entities(table(spark, sf_dir, "part").select("p_partkey", F.split_part("p_name", F.lit(" "), F.lit(2)).alias("name")), "name", aliases, ["ring"])


@query(f"SELECT DISTINCT source FROM documents WHERE lang IN (SELECT lang FROM documents GROUP BY lang HAVING count(*) > 100)")
def known_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that are known elsewhere: a semi join."""
    docs = table(spark, sf_dir, "documents")
    return docs.join(docs.groupBy("lang").count().where("count > 100"), "lang", "left_semi").select("source").distinct()
