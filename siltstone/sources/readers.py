"""Sources of documents: CSV files by decade, folders of texts, Parquet tables; dense ids in load order."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scratch import Scratch

MOVIES = "title string, image string, plot string"
#: Stands for a field that is missing, where an empty text is none.
NO_TEXT = "\x00 no text \x00"
DECADES = ("1970s", "1980s", "1990s", "2000s", "2010s", "2020s")


def csv_files(spark: SparkSession, path: str | list[str], pattern: str = "*.csv", quoted_empty: bool = False) -> DataFrame:
    """(title, image, plot, file): quoted fields may hold line feeds and doubled quotes. An empty field is null; with
    ``quoted_empty`` only one without quotes is, and two quotes are an empty text."""
    reader = spark.read.schema(MOVIES).option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').option("pathGlobFilter", pattern)
    if quoted_empty:  # a field equal to nullValue is null, quoted or not
        reader = reader.option("nullValue", NO_TEXT)
    return reader.csv(path).select("*", F.col("_metadata.file_name").alias("file"))


def decade_files(spark: SparkSession, folder: str, decades: tuple[str, ...] = DECADES) -> DataFrame:
    """(doc_id, title, plot, decade) of <decade>-movies.csv in the given order of decades."""
    read = csv_files(spark, [f"{folder}/{d}-movies.csv" for d in decades])
    decade = F.regexp_extract("file", r"^(.*)-movies\.csv$", 1)
    nth = F.array_position(F.array(*map(F.lit, decades)), decade)
    return dense_ids(read.withColumns({"decade": decade, "nth": nth}), ["nth"]).select("doc_id", "title", "plot", "decade")


def csv_folder(spark: SparkSession, folder: str, quoted_empty: bool = False) -> DataFrame:
    """(doc_id, title, image, plot) of all *.csv files of a folder, by file name and place in the file."""
    return dense_ids(csv_files(spark, folder, quoted_empty=quoted_empty), ["file"]).select("doc_id", "title", "image", "plot")


def first_rows(spark: SparkSession, folder: str, n: int = 10) -> DataFrame:
    """The first n rows of the folder's first CSV file by name."""
    files = sorted(csv_files(spark, folder).inputFiles())
    return dense_ids(csv_files(spark, files[:1]), ["file"]).where(F.col("doc_id") < n).select("doc_id", "title", "image", "plot")


def empty_files(spark: SparkSession, folder: str, chunk: int = 4096) -> list[str]:
    """Names of a folder's files of no bytes, which Spark's readers leave out, as they do hidden ones."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(folder)
    found = where.getFileSystem(spark._jsc.hadoopConfiguration()).listStatusIterator(where)
    listed, names = jvm.org.apache.hadoop.util.functional.RemoteIterators.toList(found), []
    n = listed.size()
    for i in range(0, n, chunk):  # written out by the JVM, as a call for each file takes longer than to read it
        said = listed.subList(i, min(i + chunk, n)).toString()
        names += [path.rsplit("/", 1)[-1] for path in re.findall(r"path=((?:(?!; isDirectory=).)*); isDirectory=false; length=0;", said, re.DOTALL)]
    return [n for n in names if not n.startswith(("_", "."))]


def text_folder(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, title, plot) of a folder's files: title is the file's name, plot its whole text, ids by name."""
    read = spark.read.text(folder, wholetext=True).select(F.col("_metadata.file_name").alias("title"), F.col("value").alias("plot"))
    empty = [(name, "") for name in empty_files(spark, folder)]
    read = read.unionByName(spark.createDataFrame(empty, "title string, plot string")) if empty else read
    return dense_ids(read, ["title"]).select("doc_id", "title", "plot")


def folder_with(spark: SparkSession, folder: str, read: Callable[[str, bytes], tuple[str, str]]) -> DataFrame:
    """(doc_id, title, plot) of a folder's files in any format: read(name, content) gives title and text; ids by name."""

    def run(frames):
        for pdf in frames:
            found = [read(name, bytes(content)) for name, content in zip(pdf["file"], pdf["content"], strict=True)]
            yield pd.DataFrame({"file": pdf["file"], "title": [t for t, _ in found], "plot": [x for _, x in found]})

    files = spark.read.format("binaryFile").load(folder).select(F.col("_metadata.file_name").alias("file"), "content")
    empty = [(name, bytearray()) for name in empty_files(spark, folder)]
    files = files.unionByName(spark.createDataFrame(empty, "file string, content binary")) if empty else files
    return dense_ids(files.mapInPandas(run, "file string, title string, plot string"), ["file"]).select("doc_id", "title", "plot")


def parquet_documents(spark: SparkSession, path: str, title: str = "source", plot: str = "text", decade: str = "lang", whole: bool = False) -> DataFrame:
    """(doc_id, title, plot, decade) of a table that has ids already. ``whole``: all postings will be counted."""
    read = spark.read.parquet(path).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(title).alias("title"), F.col(plot).alias("plot"), F.col(decade).alias("decade"))
    return dealt(read, path, whole)


def dealt(docs: DataFrame, path: str, whole: bool = False, row_group: int = 16 << 20, share: int = 8 << 20) -> DataFrame:
    """docs, dealt out by doc_id if the files at ``path`` are too small to have a row group for each core, or if ``whole``.

    A row group is read by one task, and so is all that follows up to the next shuffle. Dealt by doc_id, a document's terms
    need no other shuffle: a text is moved once and its postings, which are more bytes, are not. A task gets ``share`` bytes
    of the files, so that the terms which it counts don't grow with the table.
    """
    spark = docs.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    size = where.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(where).getLength()
    cores = spark.sparkContext.defaultParallelism
    if whole:
        return docs.repartition(max(cores, -(-size // share)), "doc_id")
    return docs.repartition(cores, "doc_id") if size < cores * row_group else docs


def complete(docs: DataFrame) -> DataFrame:
    """Documents whose title and plot have more than white space."""
    has = lambda c: F.length(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", "")) > 0
    return docs.where(has("title") & has("plot"))


def dense_ids(df: DataFrame, order: list[str], start: int = 0) -> DataFrame:
    """Adds doc_id: start, start + 1, ... by ``order`` and, within equals, by place in the input.

    The rows are sorted by ranges into a table of the shared folder, once, so that a row's range and place in it are
    the same for whatever reads them afterwards. Its id is its place shifted by the sizes of the ranges before.
    """
    kept = [c for c in df.columns if c != "doc_id"]
    placed = df.withColumn("_at", F.monotonically_increasing_id())
    ranged = placed.repartitionByRange(*order, "_at").sortWithinPartitions(*order, "_at")
    held = Scratch(df.sparkSession, "ids").table(ranged.drop("_at").withColumn("_place", F.monotonically_increasing_id()), "ranged")
    # monotonically_increasing_id: the task in the upper bits, the row's place in the lower 33
    held = held.withColumns({"_range": F.shiftright("_place", 33), "_own": F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))})
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shift = held.groupBy("_range").count().select("_range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_shift"))
    # a row for each task that wrote: as many as shuffle partitions at most
    return held.join(F.broadcast(shift), "_range").select((F.col("_own") + F.col("_shift") + start).alias("doc_id"), *kept)
