"""Queries over ranking: benchmark passages are the query set, documents the collection."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from sedgewood.operators import evaluation as E, inverted_index, retrieval as R, state, vector_index
from sedgewood.plans.registry import query, table

_SPLIT = "list_filter(regexp_split_to_array({}, '\\s+'), lambda x: x <> '')"


def _queries_sql(text: str = "text") -> str:
    return f"qq AS (SELECT item_id AS query_id, {text} AS text FROM benchmark)"


def _bm25_sql(k: int) -> str:
    return f"""tok AS (SELECT doc_id, unnest({_SPLIT.format('text')}) AS term FROM documents), tf AS (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY ALL),
dl AS (SELECT doc_id, len({_SPLIT.format('text')}) AS dl FROM documents), tot AS (SELECT count(*) AS n, avg(dl) AS avg_len FROM dl),
dfs AS (SELECT term, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM tf, tot GROUP BY term),
idf AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM dfs) ELSE raw END AS idf FROM dfs),
asked AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest({_SPLIT.format('text')}) AS term FROM qq) GROUP BY ALL),
sc AS (SELECT query_id, doc_id, sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avg_len)) * times) AS s FROM asked JOIN tf USING (term) JOIN idf USING (term) JOIN dl USING (doc_id), tot GROUP BY ALL),
bmf AS (SELECT query_id, doc_id, round(coalesce(s, 0), 9) AS score FROM (SELECT query_id, doc_id FROM qq, documents) LEFT JOIN sc USING (query_id, doc_id)),
bm AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM bmf) WHERE rank <= {k})"""


def _dense_sql(k: int) -> str:
    bucket = "CAST(('0x' || substr(md5(w), 1, 8)) AS BIGINT) % 64"
    return f"""db AS (SELECT doc_id, {bucket} AS b, count(*) AS c FROM (SELECT doc_id, unnest({_SPLIT.format('lower(text)')}) AS w FROM documents) GROUP BY ALL),
qb AS (SELECT query_id, {bucket} AS b, count(*) AS c FROM (SELECT query_id, unnest({_SPLIT.format('lower(text)')}) AS w FROM qq) GROUP BY ALL),
dn AS (SELECT doc_id, sqrt(sum(c * c)) AS n FROM db GROUP BY 1), qn AS (SELECT query_id, sqrt(sum(c * c)) AS n FROM qb GROUP BY 1),
dot AS (SELECT query_id, doc_id, sum(qb.c * db.c) AS d FROM qb JOIN db USING (b) GROUP BY ALL),
dsf AS (SELECT query_id, doc_id, round(coalesce(d / (dn.n * qn.n), 0), 9) AS score FROM (SELECT query_id, doc_id FROM qq, documents) LEFT JOIN dot USING (query_id, doc_id) LEFT JOIN dn USING (doc_id) LEFT JOIN qn USING (query_id)),
ds AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM dsf) WHERE rank <= {k})"""


def _fused_sql(alpha: str = "0.5", name: str = "fu") -> str:
    return f"""{name} AS (SELECT query_id, content, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, content) AS rank FROM (SELECT query_id, content, round(sum(w / (60 + rank)), 9) AS score FROM (
SELECT query_id, text AS content, rank, {alpha}::DOUBLE AS w FROM ds JOIN documents USING (doc_id) UNION ALL SELECT query_id, text, rank, 1 - {alpha}::DOUBLE FROM bm JOIN documents USING (doc_id)) GROUP BY ALL))"""


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def bm25(spark: SparkSession, sf_dir: str, k: int, queries: DataFrame | None = None) -> DataFrame:
    return R.bm25_topk(corpus(spark, sf_dir), queries if queries is not None else asked(spark, sf_dir), k)


def dense(spark: SparkSession, sf_dir: str, k: int, queries: DataFrame | None = None) -> DataFrame:
    q = R.hashed_vectors(queries if queries is not None else asked(spark, sf_dir), "query_id", "text").withColumnRenamed("id", "query_id")
    return R.dense_topk(R.hashed_vectors(corpus(spark, sf_dir), "id", "text"), q, k)


def with_content(hits: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    return hits.join(corpus(spark, sf_dir).withColumnRenamed("text", "content"), "id")


def hybrid(spark: SparkSession, sf_dir: str, k: int, alpha: float = 0.5, queries: DataFrame | None = None) -> DataFrame:
    lists = [(with_content(dense(spark, sf_dir, k, queries), spark, sf_dir), alpha), (with_content(bm25(spark, sf_dir, k, queries), spark, sf_dir), 1 - alpha)]
    return R.fuse(lists, "content")


_VEC = "SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings"


def vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All vectors, and those whose id is divisible by 50 as queries."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")
    return e, e.where("id % 50 = 0").select(F.col("id").alias("query_id"), "vector")


@query(f"""WITH v AS ({_VEC}) SELECT query_id, id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM
(SELECT q.vec_id AS query_id, v.vec_id AS id, round(list_cosine_similarity(q.v, v.v), 9) AS score FROM v, v AS q WHERE q.vec_id % 50 = 0)) WHERE rank <= 5""")
def dense_topk_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest vectors by cosine similarity."""
    every, some = vectors(spark, sf_dir)
    return R.dense_topk(every, some, 5).withColumn("score", F.round("score", 6))


@query(f"""WITH v AS ({_VEC}) SELECT query_id, id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, id) AS rank FROM
(SELECT q.vec_id AS query_id, v.vec_id AS id, abs(round(list_distance(q.v, v.v) * list_distance(q.v, v.v), 9)) AS score FROM v, v AS q WHERE q.vec_id % 50 = 0)) WHERE rank <= 5""")
def dense_topk_l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest vectors by squared distance."""
    every, some = vectors(spark, sf_dir)
    return R.dense_topk(every, some, 5, "l2").withColumn("score", F.abs(F.round("score", 6)))


@query(f"""WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM
(SELECT q.vec_id AS query_id, q.label AS ql, v.vec_id AS id, v.label, round(list_cosine_similarity(q.v, v.v), 9) AS score FROM v, v AS q WHERE q.vec_id % 50 = 0)) WHERE rank <= 5)
SELECT query_id, round(count(*) FILTER (label = ql) / 5.0, 6) AS precision, round(count(*) FILTER (label = ql) / any_value(n), 6) AS recall FROM h JOIN (SELECT label AS ql, count(*)::DOUBLE AS n FROM embeddings GROUP BY label) USING (ql) GROUP BY query_id""")
def dense_precision_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of neighbours of the query's own label, by the default judge."""
    every, some = vectors(spark, sf_dir)
    labels = every.select("id", "label")
    truth = labels.select(F.col("id").alias("query_id"), F.col("label").alias("query_label")).join(some.select("query_id"), "query_id")
    sizes = labels.groupBy(F.col("label").alias("query_label")).agg(F.count("*").alias("n_relevant"))
    hits = R.dense_topk(every, some, 5).join(labels, "id").join(truth, "query_id")
    return E.precision_recall(hits, F.col("label") == F.col("query_label"), truth.join(sizes, "query_label").select("query_id", "n_relevant"), 5)


@query(f"WITH {_queries_sql()}, {_bm25_sql(5)} SELECT query_id, doc_id AS id, round(score, 6) AS score, rank FROM bm")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 over the whole collection."""
    return bm25(spark, sf_dir, 5).withColumn("score", F.round("score", 6))


@query(f"WITH {_queries_sql()}, {_bm25_sql(5)} SELECT query_id, doc_id AS id, round(score, 6) AS score, rank FROM (SELECT query_id, doc_id, round(s, 9) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, doc_id) AS rank FROM sc) WHERE rank <= 5")
def bm25_index_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 from postings built once; documents that share a word with the query."""
    index = inverted_index.build(corpus(spark, sf_dir))
    return inverted_index.search(index, asked(spark, sf_dir), 5).withColumn("score", F.round("score", 6))


#: Recall on the index's sample that the registered search asks for.
RECALL = 0.95


def _indexed(spark: SparkSession, sf_dir: str) -> tuple[vector_index.VectorIndex, DataFrame]:
    corpus, queries = vectors(spark, sf_dir)
    index = vector_index.build(corpus, f"{state.checkpoint_folder(spark)}/cells-{uuid.uuid4().hex}")
    return index, vector_index.search(index, queries, 5, index.probes(RECALL))


@query()
def dense_index_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest vectors by the index of cells."""
    return _indexed(spark, sf_dir)[1].withColumn("score", F.round("score", 6))


@query("SELECT count(*) AS n_vectors, count(*) FILTER (vec_id % 50 = 0) AS n_queries, true AS whole, true AS scores_exact, true AS recall_reached FROM embeddings WHERE embedding IS NOT NULL")
def dense_index_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index against the exact search: all rows indexed, scores equal, nine tenths of the five nearest found."""
    index, got = _indexed(spark, sf_dir)
    corpus, queries = vectors(spark, sf_dir)
    exact = R.dense_topk(corpus, queries, 5).select("query_id", "id", F.col("score").alias("exact"))
    met = exact.join(got, ["query_id", "id"], "left").agg(F.count("*").alias("n"), F.count("score").alias("found"), F.coalesce(F.max(F.abs(F.col("score") - F.col("exact"))), F.lit(0.0)).alias("off"))
    rows = index.rows(spark).agg(F.count("*").alias("n_vectors"), F.count_if(F.col("id") % 50 == 0).alias("n_queries"), F.count_distinct("id").alias("ids"))
    out = rows.crossJoin(met)  # two single rows
    return out.select("n_vectors", "n_queries", (F.col("ids") == F.col("n_vectors")).alias("whole"), (F.col("off") < 1e-8).alias("scores_exact"), (10 * F.col("found") >= 9 * F.col("n")).alias("recall_reached"))


@query(f"WITH {_queries_sql()}, {_dense_sql(5)} SELECT query_id, doc_id AS id, round(score, 6) AS score, rank FROM ds")
def dense_topk_hashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest documents by the default embedder."""
    return dense(spark, sf_dir, 5).withColumn("score", F.round("score", 6))


@query(f"WITH {_queries_sql()}, {_bm25_sql(5)}, {_dense_sql(5)}, {_fused_sql()} SELECT query_id, content, round(score, 6) AS score, rank FROM fu")
def hybrid_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both lists fused, keyed by content; the whole union."""
    return hybrid(spark, sf_dir, 5).withColumn("score", F.round("score", 6))


@query(f"WITH {_queries_sql()}, {_bm25_sql(5)}, {_dense_sql(5)}, " + ", ".join(_fused_sql(a, f"f{i}") for i, a in enumerate(("0.3", "0.5", "0.7"))) + " SELECT * FROM (" + " UNION ALL ".join(f"SELECT {a}::DOUBLE AS alpha, query_id, content, round(score, 6) AS score, rank FROM f{i}" for i, a in enumerate(("0.3", "0.5", "0.7"))) + ")")
def alpha_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lists retrieved once and fused with three weights."""
    d, b = with_content(dense(spark, sf_dir, 5), spark, sf_dir), with_content(bm25(spark, sf_dir, 5), spark, sf_dir)
    ranked = d.select("query_id", "content", "rank", F.lit(True).alias("is_dense")).unionByName(b.select("query_id", "content", "rank", F.lit(False).alias("is_dense")))
    alphas = F.explode(F.array(F.lit(0.3), F.lit(0.5), F.lit(0.7))).alias("alpha")
    parts = ranked.select("*", alphas).withColumn("part", F.when(F.col("is_dense"), F.col("alpha")).otherwise(1 - F.col("alpha")) / (60 + F.col("rank")))
    fused = parts.groupBy("alpha", "query_id", "content").agg(F.round(F.sum("part"), 9).alias("score"))
    w = Window.partitionBy("alpha", "query_id").orderBy(F.desc("score"), "content")
    return fused.select("alpha", "query_id", "content", F.round("score", 6).alias("score"), F.row_number().over(w).cast("long").alias("rank"))


_HYDE = "'about ' || lower(text)"


@query(f"WITH {_queries_sql(_HYDE)}, {_dense_sql(5)} SELECT query_id, doc_id AS id, round(score, 6) AS score, rank FROM ds")
def hyde_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search with a generated passage in place of the query (default generator)."""
    q = R.expand_queries(asked(spark, sf_dir), lambda c: F.concat(F.lit("about "), F.lower(c)), "replace")
    return dense(spark, sf_dir, 5, q).withColumn("score", F.round("score", 6))


@query(f"WITH {_queries_sql('text || chr(10) || chr(10) || ' + _HYDE)}, {_bm25_sql(5)}, {_dense_sql(5)}, {_fused_sql()} SELECT query_id, content, round(score, 6) AS score, rank FROM fu")
def hyde_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid search with the query and a generated passage."""
    q = R.expand_queries(asked(spark, sf_dir), lambda c: F.concat(F.lit("about "), F.lower(c)), "concat")
    return hybrid(spark, sf_dir, 5, queries=q).withColumn("score", F.round("score", 6))


_OVERLAP = f"round(len(list_intersect(list_distinct({_SPLIT.format('lower(q.text)')}), {_SPLIT.format('lower(d.text)')}))::DOUBLE / greatest(len(list_distinct({_SPLIT.format('lower(q.text)')})), 1), 9)"


@query(f"""WITH {_queries_sql()}, {_bm25_sql(20)}, s AS (SELECT bm.query_id, doc_id AS id, {_OVERLAP} AS rerank_score FROM bm JOIN qq AS q USING (query_id) JOIN documents AS d USING (doc_id))
SELECT query_id, id, rerank_score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, id) AS rank FROM s) WHERE rank <= 5""")
def retrieve_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty candidates, the five best by the default pair scorer."""
    pairs = bm25(spark, sf_dir, 20).select("query_id", "id").join(corpus(spark, sf_dir), "id").join(asked(spark, sf_dir).withColumnRenamed("text", "query"), "query_id")
    return R.rerank(pairs, 5).select("query_id", "id", "rerank_score", "rank")


@query(f"""WITH {_queries_sql()}, {_bm25_sql(20)}, d AS (SELECT query_id, doc_id, w, max(1.0::DOUBLE / p) AS m FROM (SELECT query_id, doc_id, unnest({_SPLIT.format('lower(text)')}) AS w, generate_subscripts({_SPLIT.format('lower(text)')}, 1) AS p FROM bm JOIN documents USING (doc_id)) GROUP BY ALL),
a AS (SELECT query_id, unnest({_SPLIT.format('lower(text)')}) AS w FROM qq), s AS (SELECT query_id, doc_id AS id, round(coalesce(x, 0), 9) AS rerank_score FROM bm LEFT JOIN (SELECT query_id, doc_id, sum(m) AS x FROM a JOIN d USING (query_id, w) GROUP BY ALL) USING (query_id, doc_id))
SELECT query_id, id, round(rerank_score, 6) AS rerank_score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, id) AS rank FROM s) WHERE rank <= 5""")
def rerank_maxpool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token weights pooled over a document's places, summed over the query's tokens (default weight: one over the place)."""
    pairs = bm25(spark, sf_dir, 20).select("query_id", "id").join(corpus(spark, sf_dir), "id").join(asked(spark, sf_dir).withColumnRenamed("text", "query"), "query_id")
    return R.maxpool_rerank(pairs, lambda pos: 1.0 / (pos + 1), 5).select("query_id", "id", F.round("rerank_score", 6).alias("rerank_score"), "rank")


@query("SELECT doc_id, text FROM documents WHERE contains(text, 'the') AND contains(text, 'with') ORDER BY doc_id LIMIT 3")
def keyword_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three texts that hold all keywords."""
    return table(spark, sf_dir, "documents").where(F.contains("text", F.lit("the")) & F.contains("text", F.lit("with"))).select("doc_id", "text").orderBy("doc_id").limit(3)


_DEDUP = "dd AS (SELECT * FROM (SELECT bm.query_id, bm.rank, text AS content, row_number() OVER (PARTITION BY bm.query_id, text ORDER BY bm.rank) AS r FROM bm JOIN documents USING (doc_id)) WHERE r = 1)"


@query(f"WITH {_queries_sql()}, {_bm25_sql(10)}, {_DEDUP} SELECT query_id, rank, content FROM dd")
def dedupe_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits with their content, the first of equal contents."""
    return R.first_of_content(with_content(bm25(spark, sf_dir, 10), spark, sf_dir), "content").select("query_id", "rank", "content")


@query(f"WITH {_queries_sql()}, {_bm25_sql(10)}, {_DEDUP} SELECT query_id, string_agg(content, chr(10) || chr(10) ORDER BY rank) AS context FROM dd GROUP BY query_id")
def build_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents joined in rank order."""
    return R.context(R.first_of_content(with_content(bm25(spark, sf_dir, 10), spark, sf_dir), "content"), "content")


@query(f"WITH {_queries_sql()}, {_bm25_sql(10)}, {_DEDUP} SELECT query_id, arg_min(content, rank) AS answer, string_agg(content, chr(10) || chr(10) ORDER BY rank) AS context FROM dd GROUP BY query_id")
def answer_extractive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The default generator's answers: the best content."""
    hits = R.first_of_content(with_content(bm25(spark, sf_dir, 10), spark, sf_dir), "content")
    return R.context(hits, "content").join(hits.groupBy("query_id").agg(F.min_by("content", "rank").alias("answer")), "query_id").select("query_id", "answer", "context")


@query("SELECT count(*) AS n_rows, count(DISTINCT text) AS n_embedded FROM documents")
def embed_distinct_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct text embedded once."""
    made = R.embed_distinct(corpus(spark, sf_dir), "text", lambda d: R.hashed_vectors(d, "id", "text"))
    return made.where("vector is not null").agg(F.count("*").alias("n_rows"), F.count_distinct("text").alias("n_embedded"))


_SIG = "nullif(substring(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), 1, 50), '')"


def _hits_sql(hits: str) -> str:
    return f"SELECT query_id, coalesce(1.0 / first, 0)::DOUBLE AS reciprocal_rank, CASE WHEN first IS NULL THEN 0.0 ELSE 1.0 END::DOUBLE AS hit FROM qq LEFT JOIN (SELECT h.query_id, min(rank) AS first FROM ({hits}) AS h JOIN (SELECT query_id, {_SIG} AS sig FROM qq) AS t ON h.query_id = t.query_id AND contains(content, sig) GROUP BY 1) USING (query_id)"


@query(f"WITH {_queries_sql()}, {_bm25_sql(5)}, r AS ({_hits_sql('SELECT query_id, rank, text AS content FROM bm JOIN documents USING (doc_id)')}) SELECT query_id, hit, round(reciprocal_rank, 6) AS reciprocal_rank FROM r")
def hit_mrr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hit and reciprocal rank of each query."""
    out = E.hit_and_rank(asked(spark, sf_dir).withColumnRenamed("text", "truth"), with_content(bm25(spark, sf_dir, 5), spark, sf_dir))
    return out.select("query_id", "hit", F.round("reciprocal_rank", 6).alias("reciprocal_rank"))


@query(f"""WITH {_queries_sql()}, {_bm25_sql(5)}, {_dense_sql(5)}, {_fused_sql()}, a AS ({_hits_sql('SELECT query_id, rank, text AS content FROM bm JOIN documents USING (doc_id)')}), b AS ({_hits_sql('SELECT query_id, rank, text AS content FROM ds JOIN documents USING (doc_id)')}), c AS ({_hits_sql('SELECT query_id, rank, content FROM fu')})
SELECT method, round(avg(hit), 6) AS mean_hit, round(avg(reciprocal_rank), 6) AS mean_reciprocal_rank FROM (SELECT 'bm25' AS method, * FROM a UNION ALL SELECT 'dense', * FROM b UNION ALL SELECT 'hybrid', * FROM c) GROUP BY method""")
def retrieval_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean hit rate and reciprocal rank of three methods; each list is retrieved once."""
    truth = asked(spark, sf_dir).withColumnRenamed("text", "truth")
    d, b = with_content(dense(spark, sf_dir, 5), spark, sf_dir), with_content(bm25(spark, sf_dir, 5), spark, sf_dir)
    lists = {"bm25": b, "dense": d, "hybrid": R.fuse([(d, 0.5), (b, 0.5)], "content")}
    every = None
    for name, hits in lists.items():
        own = E.hit_and_rank(truth, hits.select("query_id", "rank", "content")).withColumn("method", F.lit(name))
        every = own if every is None else every.unionByName(own)
    return E.means(every, ["method"], ["hit", "reciprocal_rank"])
