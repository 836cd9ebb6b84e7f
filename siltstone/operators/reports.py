"""Corpus reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions import text

from .index import token_rows, tokenized


def missing_values(docs: DataFrame) -> DataFrame:
    """(column_name, missing) of every column, in one pass."""
    counts = docs.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in docs.columns])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("missing")) for c in docs.columns])).alias("r")).select("r.*")


def per_group(docs: DataFrame, group: str = "decade") -> DataFrame:
    """(group, documents), by group."""
    return docs.groupBy(group).agg(F.count("*").alias("documents")).orderBy(group)


def spread(docs: DataFrame, value: Column) -> DataFrame:
    """One row: mean, median (interpolated), least, most of a number; nulls are skipped."""
    return docs.select(value.alias("v")).agg(F.avg("v").alias("mean"), F.median("v").alias("median"), F.min("v").cast("long").alias("least"), F.max("v").cast("long").alias("most"))


def text_lengths(docs: DataFrame) -> DataFrame:
    return spread(docs, F.length("plot"))


def token_counts(docs: DataFrame) -> DataFrame:
    return spread(tokenized(docs), F.size("tokens"))


def top_terms(docs: DataFrame, k: int = 20) -> DataFrame:
    """(term, occurrences) of the most frequent terms; ties to the one that occurs first."""
    rows = token_rows(docs).groupBy("term").agg(F.count("*").alias("occurrences"), F.min(F.struct("doc_id", "pos")).alias("first"))
    return rows.orderBy(F.desc("occurrences"), "first").limit(k).select("term", "occurrences")


def previews(docs: DataFrame, k: int = 3, chars: int = 150) -> DataFrame:
    """The first k documents: title and shortened plot."""
    return docs.where(F.col("doc_id") < k).orderBy("doc_id").select("doc_id", "title", text.preview(F.col("plot"), chars).alias("preview"))


def token_previews(docs: DataFrame, k: int = 3, n: int = 15) -> DataFrame:
    """The first k documents: plot length, number of tokens, and the first n of them."""
    some = tokenized(docs.where(F.col("doc_id") < k))
    return some.orderBy("doc_id").select("doc_id", F.length("plot").cast("long").alias("chars"), F.size("tokens").cast("long").alias("tokens"), F.array_join(F.slice("tokens", 1, n), " ").alias("first_tokens"))
