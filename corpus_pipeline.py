"""Cleaning and packing of a corpus in five stages, each written as Parquet and read again by the next.

quality      documents that the co-trained classifier rejects go
near_copies  of each group of near copies (5-word shingles, Jaccard 0.8 or more) the one with the smallest key stays
secrets      spans of secrets are replaced by marks in the text
mixing       sources are brought to their target weights; documents repeat whole, in training order
packing      token sequences of at most 4096

A stage takes nulls in any column, empty texts, repeated rows and empty tables. Columns other than those of documents are
left out by the first stage that meets them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.common import Scratch, table
from siltstone.llm.jaccard import near_duplicates
from siltstone.llm.mixing import mix, training_order
from siltstone.llm.packing import packed_digest
from siltstone.llm.quality import keep_good
from siltstone.llm.secrets import scan

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; those without a score stay."""
    return keep_good(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))


def with_key(docs: DataFrame) -> DataFrame:
    """The columns of documents and _key, which tells rows apart by all columns and sorts as doc_id does, null last."""
    number = F.coalesce(F.lpad((F.col("doc_id").cast("decimal(20,0)") + F.lit(str(2**63)).cast("decimal(20,0)")).cast("string"), 20, "0"), F.lit("~"))
    rest = F.to_json(F.struct("lang", "source", "n_chars"))  # nulls are left out of it
    return docs.select(*COLUMNS).withColumn("_key", F.concat_ws(":", number, F.coalesce(F.md5("text"), F.lit("-")), F.md5(rest)))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the one with the smallest doc_id, and among equal ids the one whose other columns
    have the smallest digest. Rows equal in all columns are copies too. Rows without a word are copies of nothing; all stay."""
    keyed = with_key(docs)
    worded = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    found = near_duplicates(spark, keyed.where(worded), size=5, percent=80, key="_key")
    stay = found.where("doc_id = component_id").select(F.col("doc_id").alias("_key"))
    kept = keyed.where(worded).dropDuplicates(["_key"]).join(stay, "_key", "left_semi")
    return kept.select(*COLUMNS).unionByName(keyed.where(~worded).select(*COLUMNS))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; its secrets don't."""
    changed = F.col("spans") != ""
    return scan(docs.select(*COLUMNS)).select("doc_id", F.col("redacted").alias("text"), "lang", "source", F.when(changed, F.length("redacted").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix in training order. Documents are taken whole: the last one of a source's stream may exceed the target by less
    than its size. What a source's target has no room for is left out, and so are documents without a word, which have no
    size to be mixed by."""
    # the mix is found without texts; equal rows share one text
    keyed = with_key(docs)
    mixed = mix(spark, keyed, keep=("_key",)).where("taken > 0").drop("doc_id", "source")
    return training_order(mixed.join(keyed.dropDuplicates(["_key"]), "_key")).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences; the columns of op10."""
    return packed_digest(spark, docs)


STAGES = [("quality", quality), ("near_copies", near_copies), ("secrets", secrets), ("mixing", mixing), ("packing", packing)]

#: Classifier and tokenizer have no SQL form; tests hold each stage and the whole run against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; intermediate tables go to the shared folder, each until the next one is written."""
    scratch = Scratch(spark, "pipeline")
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
        if before:
            scratch.drop(before)
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
