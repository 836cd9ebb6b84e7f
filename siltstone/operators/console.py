"""The corpus and index report as text: ``python -m siltstone.operators.console FOLDER [QUERY...]``.

FOLDER holds <decade>-movies.csv files. All figures come from the operators; here they are only written out.
"""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.sources import readers

from . import index as ix
from . import ranking, reports


def amount(n: float | int | None, digits: int = 0) -> str:
    """With separators of thousands; a dash for nothing."""
    return "-" if n is None else f"{n:,.{digits}f}"


def shape(docs: DataFrame) -> tuple[int, list[str]]:
    """(rows, columns)."""
    return docs.count(), docs.columns


def corpus_lines(docs: DataFrame, group: str = "decade") -> list[str]:
    rows, columns = shape(docs)
    out = [f"Documents: {amount(rows)}", f"Columns: {', '.join(columns)}", "Missing values:"]
    out += [f"  {r.column_name}: {amount(r.missing)}" for r in reports.missing_values(docs).collect()]
    if group in columns:
        out += [f"Documents by {group}:", *(f"  {r[group]}: {amount(r.documents)}" for r in reports.per_group(docs, group).collect())]
    for name, found in (("Characters of a plot", reports.text_lengths(docs)), ("Tokens of a document", reports.token_counts(docs))):
        r = found.first()
        out.append(f"{name}: mean {amount(r['mean'], 1)}, median {amount(r['median'], 1)}, least {amount(r.least)}, most {amount(r.most)}")
    out += ["First documents:", *(f"  {r.title}: {r.preview}" for r in reports.previews(docs).collect())]
    out += [f"  {amount(r.tokens)} tokens: {r.first_tokens}" for r in reports.token_previews(docs).collect()]
    return [*out, "Most frequent terms:", *(f"  {r.term}: {amount(r.occurrences)}" for r in reports.top_terms(docs).collect())]


def index_lines(index: ix.Index, terms: list[str]) -> list[str]:
    s = index.statistics().first()
    out = [f"Index: {amount(s.n)} documents, {amount(s.total_tokens)} tokens, {amount(s.vocabulary)} terms, {amount(s.total_postings)} postings, {amount(s.avg_postings, 2)} a term"]
    for term in terms:
        first = index.terms(term).orderBy("doc_id").limit(5).collect()
        out.append(f"  {term}: in {amount(index.document_frequency(term))} documents; {', '.join(f'{r.doc_id}:{r.tf}' for r in first)}")
    return out


def query_lines(index: ix.Index, query: str, shown: int = 5) -> list[str]:
    out = []
    for name, found in (("BM25", ranking.bm25(index, query)), ("SMART ltc", ranking.smart(index, query))):
        rows = found.where(F.col("rank") <= shown).orderBy("rank").collect()
        out += [f"{name}, {query!r}:", *(f"  {r['rank']}. {r.title} ({r.score:.4f})" for r in rows)] if rows else [f"{name}, {query!r}: no document"]
    return out


def report(docs: DataFrame, queries: list[str], terms: list[str]) -> str:
    index = ix.build(docs)
    lines = [*corpus_lines(docs), *index_lines(index, terms)]
    for q in queries:
        lines += query_lines(index, q)
    return "\n".join(lines)


def main() -> None:
    folder, *queries = sys.argv[1:]
    spark = SparkSession.builder.getOrCreate()
    print(report(readers.decade_files(spark, folder), queries, sorted({t for q in queries for t in q.lower().split()})))


if __name__ == "__main__":
    main()
