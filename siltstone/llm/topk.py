"""Exact top-k by inner product: exhaustive term-at-a-time accumulation.

Vectors become sparse integer rows. Candidates are dealt into blocks of bounded size; a block holds postings by term
(dimension): the rows where the term is not zero and their weights. For each query the terms are taken one after the
other, and each scatters its weight times the postings into an array of the block's scores. Where a term's postings
hold every row of the block the scatter is an addition of whole arrays. The k best of a block follow from a partition
selection, and the blocks' winners are merged by query. Queries are dealt into blocks as well, and a task is one block of
queries against one block of candidates: the work is queries x candidates, a task holds the two blocks, the scores of a
batch of queries and k rows a query, and nothing is broadcast. Blocks grow in number with the rows, never in size.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import table

#: Candidates and queries in a block, and queries whose scores are held at once.
BLOCK, ASKED, BATCH = 4096, 2048, 64


def sparse_rows(df: DataFrame, vector: str = "embedding", scale: float = 64.0) -> DataFrame:
    """Rows with a whole, finite vector; ``v`` holds floor(scale * x), x as double, as array<long>."""
    d = F.transform(F.col(vector).cast("array<double>"), lambda x: x)
    sound = F.col(vector).isNotNull() & F.forall(d, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return df.where(sound).withColumn("v", F.transform(d, lambda x: F.floor(x * F.lit(scale))))


def _matrix(rows: pd.Series) -> np.ndarray:
    width = max((len(r) for r in rows), default=0)
    out = np.zeros((len(rows), width), np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def _postings(block: np.ndarray, kind) -> list[tuple[np.ndarray | None, np.ndarray]]:
    """By term: (rows, weights); rows None: all of them."""
    out = []
    for column in block.T.astype(kind, order="C"):
        rows = np.flatnonzero(column)
        out.append((None, column) if 2 * len(rows) > len(column) else (rows, column[rows]))
    return out


def block_top(queries: pd.DataFrame, block: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k best candidates of one block for each query; ties to the smaller id."""
    block = block.sort_values("vec_id", kind="stable")
    ids, c, q = block["vec_id"].to_numpy(), _matrix(block["v"]), _matrix(queries["v"])
    bound = float(np.abs(c).max(initial=0)) * float(np.abs(q).max(initial=0)) * max(c.shape[1], 1)
    kind = np.int32 if bound < 2**31 else np.int64
    postings = _postings(c, kind)
    terms = min(q.shape[1], len(postings))
    out = []
    held = np.empty(len(ids), kind)
    for i, own in enumerate(queries["query_id"].to_numpy()):
        scores = np.zeros(len(ids), kind)
        weights = q[i].astype(kind)
        for t in np.flatnonzero(weights[:terms]):
            rows, w = postings[t]
            if rows is None:
                scores += np.multiply(w, weights[t], out=held)
            else:
                scores[rows] += weights[t] * w
        others = np.flatnonzero(ids != own)
        s = scores[others]
        if len(s) > k:  # what beats the k-th best, and of its ties the smallest ids: rows stand in id order
            least = np.partition(s, len(s) - k)[len(s) - k]
            above, ties = np.flatnonzero(s > least), np.flatnonzero(s == least)
            best = np.concatenate([above, ties[: k - len(above)]])
        else:
            best = np.arange(len(s))
        out.append(pd.DataFrame({"query_id": own, "vec_id": ids[others[best]], "score": s[best].astype(np.int64)}))
    return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype=np.int64)


def pairs_of_blocks(queries: DataFrame, candidates: DataFrame, block: int, asked: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with columns (a, b), the blocks of queries and of candidates that meet: each query once with each block of
    candidates and each candidate once with each block of queries."""
    n_asked, n_blocks = (max(1, -(-df.count() // size)) for df, size in ((queries, asked), (candidates, block)))
    # by content and not by id alone: an id that repeats must not fill a block
    deal = lambda df, key, n: F.pmod(F.xxhash64(key, "v"), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = queries.withColumn("a", deal(queries, "query_id", n_asked)).withColumn("b", every(n_blocks))
    right = candidates.withColumn("b", deal(candidates, "vec_id", n_blocks)).withColumn("a", every(n_asked))
    return left, right


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 20, block: int = BLOCK, asked: int = ASKED) -> DataFrame:
    """queries (query_id, v) and candidates (vec_id, v), v array<long> -> (query_id, rank, vec_id, score).

    A candidate with the query's id is the query's own row and left out; a null id takes no part. Vectors of unequal
    length are as if filled up with zeros. Repeated candidates count one by one. Repeated queries count once; of several
    vectors under one query_id the least one, compared by component, asks. Scores beyond 64 bits are not defined. A query
    without candidates, or an empty table, gives no row.
    """
    queries = queries.where("query_id is not null").groupBy("query_id").agg(F.min("v").alias("v"))
    left, right = pairs_of_blocks(queries, candidates.where("vec_id is not null"), block, asked)

    def search(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        parts = [block_top(q.iloc[i : i + BATCH], c, k) for i in range(0, len(q), BATCH)] if len(c) else []
        return pd.concat(parts) if parts else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype=np.int64)

    found = left.groupBy("a", "b").cogroup(right.groupBy("a", "b")).applyInPandas(search, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best of all rows for each row whose vec_id is divisible by 20."""
    rows = sparse_rows(table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")).select("vec_id", "v")
    return top_k(rows.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id"), rows)


OP3_SQL = """
WITH rows AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM rows q JOIN rows c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""
