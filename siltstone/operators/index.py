"""The inverted index as tables: postings, document statistics, lexicon and collection statistics."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions import text


@dataclass(frozen=True)
class Index:
    """postings (term, doc_id, tf) and doc_stats (doc_id, title, doc_len). Everything else derives from the two."""

    postings: DataFrame
    doc_stats: DataFrame
    tokenizer: text.Tokenizer = text.tokens

    @cached_property
    def size(self) -> tuple[int, float | None]:
        """(number of documents, mean length), read once for an index. Documents without tokens count."""
        row = self.doc_stats.agg(F.count("*"), F.avg("doc_len")).first()
        return row[0], row[1]

    @property
    def lexicon(self) -> DataFrame:
        """(term, df, cf)."""
        return self.postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))

    def terms(self, *terms: str) -> DataFrame:
        """Postings of some terms; the terms are literals, so that the filter reaches a sorted table's statistics."""
        return self.postings.where(F.col("term").isin(list(terms)))

    def document_frequency(self, term: str) -> int:
        return self.terms(term).count()

    def collection_frequency(self, term: str) -> int:
        return self.terms(term).agg(F.coalesce(F.sum("tf"), F.lit(0))).first()[0]

    def term_frequency(self, term: str, doc_id: int) -> int:
        row = self.terms(term).where(F.col("doc_id") == doc_id).select("tf").first()
        return row[0] if row else 0

    def query_tokens(self, query: str | None) -> list[str]:
        """The tokens of a query, by the index's own tokenizer."""
        if self.tokenizer is text.tokens:
            return text.query_tokens(query)
        return self.postings.sparkSession.range(1).select(self.tokenizer(F.lit(query or ""))).first()[0]

    def add(self, doc_id: int, title: str | None, plot: str | None, **options) -> Index:
        """The index with one document more; many are better built at once and united."""
        one = self.postings.sparkSession.createDataFrame([(doc_id, title, plot)], "doc_id long, title string, plot string")
        new = build(one, tokenizer=self.tokenizer, **options)
        return Index(self.postings.unionByName(new.postings), self.doc_stats.unionByName(new.doc_stats), self.tokenizer)

    def as_map(self, term: str) -> DataFrame:
        """One row (term, postings map<doc_id, tf>)."""
        return self.terms(term).groupBy("term").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("doc_id", "tf")))).alias("postings"))

    def forward(self, doc_id: int) -> DataFrame:
        """(term, tf) of one document."""
        return self.postings.where(F.col("doc_id") == doc_id).select("term", "tf")

    def statistics(self) -> DataFrame:
        """One row: n, avgdl, total_tokens, vocabulary, total_postings, avg_postings."""
        docs = self.doc_stats.agg(F.count("*").alias("n"), F.avg("doc_len").alias("avgdl"), F.coalesce(F.sum("doc_len"), F.lit(0)).alias("total_tokens"))
        terms = self.lexicon.agg(F.count("*").alias("vocabulary"), F.coalesce(F.sum("df"), F.lit(0)).alias("total_postings"))
        return docs.join(terms).withColumn("avg_postings", F.coalesce(F.try_divide(F.col("total_postings"), F.col("vocabulary")), F.lit(0.0)))


def tokenized(docs: DataFrame, fields: tuple[str, ...] = ("title", "plot"), tokenizer: text.Tokenizer = text.tokens, pandas_nulls: bool = False) -> DataFrame:
    """docs and their tokens."""
    return docs.withColumn("tokens", tokenizer(text.body(*fields, pandas_nulls=pandas_nulls)))


def token_rows(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, pos, term): one row per occurrence."""
    return tokenized(docs, **options).select("doc_id", F.posexplode("tokens").alias("pos", "term")).select("doc_id", F.col("pos").cast("long").alias("pos"), "term")


def postings_of(toks: DataFrame) -> DataFrame:
    """(term, doc_id, tf) of tokenized documents. A document's terms are counted before any shuffle, as all come from one
    row; documents that lie dealt by doc_id need none."""
    return toks.select("doc_id", F.explode("tokens").alias("term")).groupBy("term", "doc_id").agg(F.count("*").alias("tf"))


def stats_of(toks: DataFrame) -> DataFrame:
    return toks.select("doc_id", "title", F.size("tokens").cast("long").alias("doc_len"))


def build(docs: DataFrame, fields: tuple[str, ...] = ("title", "plot"), tokenizer: text.Tokenizer = text.tokens, pandas_nulls: bool = False) -> Index:
    """Index of documents (doc_id, title, plot)."""
    toks = tokenized(docs, fields, tokenizer, pandas_nulls)
    return Index(postings_of(toks), stats_of(toks), tokenizer)


def overlay(main: DataFrame, aux: DataFrame) -> DataFrame:
    """Postings of main with those of aux in place of equal (term, doc_id)."""
    return main.join(aux.select("term", "doc_id"), ["term", "doc_id"], "left_anti").unionByName(aux)


def without(rows: DataFrame, tombstones: DataFrame) -> DataFrame:
    """Rows of documents that aren't deleted."""
    return rows.join(tombstones.select("doc_id").distinct(), "doc_id", "left_anti")


def differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that one of two tables has more often than the other, as often as that. Each table is made once."""
    signed = left.withColumn("_n", F.lit(1)).unionByName(right.select(*left.columns).withColumn("_n", F.lit(-1)))
    odd = signed.groupBy(*left.columns).agg(F.sum("_n").alias("_n")).where("_n <> 0")
    side = F.when(F.col("_n") > 0, F.lit("left")).otherwise(F.lit("right"))
    return odd.select(*left.columns, side.alias("side"), F.explode(F.array_repeat(F.lit(0), F.abs("_n").cast("int")))).drop("col")
