"""Models are given from outside.  Each kind has a small interface and a deterministic default that SQL can mirror."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame, functions as F

from sedgewood.functions.text import words


class Embedder(Protocol):
    def __call__(self, texts: DataFrame) -> DataFrame:
        """(id, vector) of (id, text)."""


class PairScorer(Protocol):
    def __call__(self, query: Column, text: Column) -> Column:
        """A score, larger for a better match."""


class QueryExpander(Protocol):
    def __call__(self, query: Column) -> Column:
        """A passage that could answer the query."""


class Scorer(Protocol):
    def __call__(self, text: Column) -> Column:
        """How relevant a text is, 0 if not at all."""


class Extractor(Protocol):
    def __call__(self, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
        """entities(chunk_id, pos, name, type, description) and relations(chunk_id, pos, source, target, relation) of (chunk_id, text)."""


class Judge(Protocol):
    def __call__(self, *texts: str) -> float:
        """A score of 0 to 1 for the texts (a question, a context, an answer), one row at a time; may fail."""


class Answerer(Protocol):
    def __call__(self, question: str) -> str:
        """The answer of one mode to a question; may fail."""


NAME = r"[\p{Lu}][\p{L}]{3,}"


def extract_names(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Default extractor: capitalised words of four letters or more are entities, neighbouring different ones are related."""
    found = chunks.select("chunk_id", F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(NAME), F.lit(0)).alias("names"))
    entities = found.select("chunk_id", F.posexplode("names").alias("pos", "name")).select("chunk_id", F.col("pos").cast("long").alias("pos"), "name", F.lit("NAME").alias("type"), F.lit("").alias("description"))
    pairs = F.transform(F.slice("names", 2, F.greatest(F.size("names") - 1, F.lit(0))), lambda n, i: F.struct(F.get("names", i).alias("source"), n.alias("target")))
    relations = found.select("chunk_id", F.posexplode(pairs).alias("pos", "p")).where("p.source <> p.target")
    return entities, relations.select("chunk_id", F.col("pos").cast("long").alias("pos"), "p.source", "p.target", F.lit("NEXT_TO").alias("relation"))


def query_terms(queries: DataFrame) -> DataFrame:
    """Default finder of a query's entities: its words.  (query_id, target)"""
    return queries.select("query_id", F.explode(words(F.col("text"))).alias("target")).distinct()


def generate_until(generate, have: DataFrame, target: int, batch: int, key: str) -> DataFrame:
    """have with batches of ``generate(n, done)`` added until there are ``target`` rows with different keys, or a batch brings none."""
    out, n = have, have.select(key).distinct().count()
    while n < target:
        new = generate(min(batch, target - n), n).dropDuplicates([key]).join(out, key, "left_anti")
        m = new.count()
        if not m:
            break
        out, n = out.unionByName(new.limit(target - n)), min(target, n + m)
    return out
