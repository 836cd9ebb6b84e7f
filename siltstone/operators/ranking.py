"""Ranked retrieval: BM25, SMART weighting, boolean AND, one query or many.

Results are ordered by score, then by the place of the first query term that the document has, then by doc_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .index import Index


#: Query terms of a batch up to which they are broadcast, counted before; more are joined by term.
BROADCAST_TERMS = 500_000
#: Pairs of a query of a batch and a document that a task sums at most, if every query meets every document.
PAIRS = 1_000_000


def query_terms(index: Index, queries: str | DataFrame) -> tuple[DataFrame, list[str] | None]:
    """(query_id, term, qtf, first_pos) and, for a single query, its distinct terms. Tokens are those of the index."""
    spark = index.postings.sparkSession
    if isinstance(queries, str):
        found = index.query_tokens(queries)
        terms = list(dict.fromkeys(found))
        rows = [(0, t, found.count(t), found.index(t)) for t in terms]
        return spark.createDataFrame(rows, "query_id long, term string, qtf long, first_pos long"), terms
    toks = queries.select("query_id", F.posexplode(index.tokenizer(F.col("query"))).alias("pos", "term"))
    return toks.groupBy("query_id", "term").agg(F.count("*").alias("qtf"), F.min("pos").cast("long").alias("first_pos")), None


def _asked(index: Index, queries: str | DataFrame, *frequency: str) -> tuple[DataFrame, DataFrame]:
    """Query terms with the wanted frequencies ("df", "cf") of those that occur, and the postings of these terms. A single
    query filters by literals before any aggregation, a batch by its distinct terms."""
    asked, terms = query_terms(index, queries)
    few = terms is not None or asked.count() <= BROADCAST_TERMS
    small = F.broadcast if few else lambda df: df
    postings = index.terms(*terms) if terms is not None else index.postings.join(small(asked.select("term").distinct()), "term", "left_semi")
    # df by way of tf, so that its plan reads the very postings that are joined, and they are made once
    sums = {"df": F.sum(F.when(F.col("tf") > 0, 1).otherwise(0)), "cf": F.sum("tf")}
    return small(asked.join(postings.groupBy("term").agg(*[sums[f].alias(f) for f in frequency]), "term")), postings


def _with_lengths(postings: DataFrame, index: Index, queries: str | DataFrame) -> DataFrame:
    """Postings by document with doc_len, 0 where it is not known. They meet the query terms afterwards, so the rows of one
    document and all queries are where its score is summed. For a batch documents are dealt to so many tasks that what a
    task sums does not grow with their number."""
    if not isinstance(queries, str):
        pairs = index.size[0] * queries.select("query_id").distinct().count()
        tasks = int(index.postings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        postings = postings.repartition(max(tasks, -(-pairs // PAIRS)), "doc_id")
    return postings.join(index.doc_stats.select("doc_id", "doc_len"), "doc_id", "left").withColumn("doc_len", F.coalesce("doc_len", F.lit(0)))


def _ranked(scored: DataFrame, index: Index, top_k: int | None, single: bool) -> DataFrame:
    scores = scored.groupBy("query_id", "doc_id").agg(F.round(F.sum("w"), 6).alias("score"), F.min("first_pos").alias("first_pos"))
    order = [F.desc("score"), "first_pos", "doc_id"]
    if single and top_k is not None:
        scores = scores.orderBy(*order).limit(top_k)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(*order)).cast("long")
    best = scores.withColumn("rank", rank)
    best = best if top_k is None else best.where(F.col("rank") <= top_k)
    return best.join(index.doc_stats.select("doc_id", "title"), "doc_id", "left").select("query_id", "rank", "doc_id", "title", "score")


def bm25(index: Index, queries: str | DataFrame, top_k: int | None = 10, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(query_id, rank, doc_id, title, score): sum over query tokens, repeats included, of
    ln(N / df) * tf (k1 + 1) / (tf + k1 (1 - b + b len / avgdl)). Terms in every document retrieve with weight 0; a document
    without statistics has length 0 and no title."""
    n, avgdl = index.size
    asked, postings = _asked(index, queries, "df")
    found = _with_lengths(postings, index, queries).join(asked, "term")
    idf = F.ln(F.lit(float(n)) / F.col("df"))
    norm = F.lit(k1) * (F.lit(1.0 - b) + F.lit(b) * F.coalesce(F.try_divide(F.col("doc_len"), F.lit(avgdl or 0.0)), F.lit(0.0)))
    weight = F.col("qtf") * idf * F.col("tf") * F.lit(k1 + 1.0) / (F.col("tf") + norm)
    return _ranked(found.withColumn("w", weight), index, top_k, isinstance(queries, str))


def smart(index: Index, queries: str | DataFrame, weighting: str = "ltc.ltc", top_k: int | None = 10) -> DataFrame:
    """Cosine-normalised query weights (ltc: (1 + ln tf) idf, ntc: tf idf) times 1 + ln tf of the document.

    What follows the dot of ``weighting`` has no effect. A query of norm 0 (only terms of all documents) scores 0.
    """
    if weighting[:3] not in ("ltc", "ntc"):
        raise ValueError(f"unknown weighting {weighting!r}: it begins with ltc or ntc")
    n, _ = index.size
    asked, postings = _asked(index, queries, "df")
    tf: Column = 1 + F.ln("qtf") if weighting.startswith("ltc") else F.col("qtf").cast("double")
    raw = asked.withColumn("raw", tf * F.ln(F.lit(float(n)) / F.col("df")))
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy("query_id")))
    weights = raw.withColumn("wq", F.coalesce(F.try_divide(F.col("raw"), norm), F.lit(0.0))).select("query_id", "term", "first_pos", "wq")
    small = weights if not isinstance(queries, str) and asked.count() > BROADCAST_TERMS else F.broadcast(weights)
    scored = _with_lengths(postings, index, queries).join(small, "term").withColumn("w", F.col("wq") * (1 + F.ln("tf")))
    return _ranked(scored, index, top_k, isinstance(queries, str))


def boolean_and(index: Index, query: str) -> DataFrame:
    """(doc_id, tf): documents with all of the query's terms, and the least tf of them."""
    terms = list(dict.fromkeys(index.query_tokens(query)))
    return index.terms(*terms).groupBy("doc_id").agg(F.count("*").alias("n"), F.min("tf").alias("tf")).where(F.col("n") == len(terms)).select("doc_id", "tf")


def language_model(index: Index, queries: str | DataFrame, top_k: int | None = 10, lam: float = 0.5) -> DataFrame:
    """Extension: query likelihood with Jelinek-Mercer smoothing, as a sum of ln(1 + lam tf/len / ((1 - lam) cf/|C|))."""
    total = index.doc_stats.agg(F.coalesce(F.sum("doc_len"), F.lit(0))).first()[0]
    asked, postings = _asked(index, queries, "cf")
    found = _with_lengths(postings, index, queries).where("doc_len > 0").join(asked, "term")
    ratio = F.lit(lam) * F.col("tf") / F.col("doc_len") / (F.lit(1.0 - lam) * F.col("cf") / F.lit(float(total or 1)))
    return _ranked(found.withColumn("w", F.col("qtf") * F.ln(1 + ratio)), index, top_k, isinstance(queries, str))
