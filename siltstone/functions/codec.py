"""Gap and variable-byte coding of postings as native expressions.

A number is cut into 7-bit groups, highest first; the last byte has 128 added. A posting list is the concatenation of
the codes of (gap to the doc_id before, tf) in doc_id order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


#: Documents that a block of a posting list spans.
BLOCK_DOCS = 1 << 16


def vb_hex(n: Column) -> Column:
    """Hex of the code of a number from 0 to 2^63 - 1. Codes of up to three bytes, which nearly all are, take one step."""
    byte = lambda x: F.lpad(F.hex(x), 2, "0")
    parts = [F.when(n >= F.lit(1 << 7 * k), byte(F.shiftrightunsigned(n, 7 * k).bitwiseAND(F.lit(127)))).otherwise("") for k in range(8, 0, -1)]
    last = n.bitwiseAND(F.lit(127)).bitwiseOR(F.lit(128))
    group = lambda k: F.shiftleft(F.shiftrightunsigned(n, 7 * k).bitwiseAND(F.lit(127)), 8 * k)
    two = F.lpad(F.hex(group(1).bitwiseOR(last)), 4, "0")
    three = F.lpad(F.hex(group(2).bitwiseOR(group(1)).bitwiseOR(last)), 6, "0")
    return F.when(n < 1 << 7, F.hex(last)).when(n < 1 << 14, two).when(n < 1 << 21, three).otherwise(F.concat(*parts, byte(last)))


def vb_encode(n: Column) -> Column:
    return F.unhex(vb_hex(n))


def vb_decode(blob: Column) -> Column:
    """array<bigint> of the numbers in a blob, in time linear in its length. Decoding ends at an unfinished last number or
    at a code of more than nine bytes, which no number of vb_encode has."""
    # a character for each byte
    codes = F.regexp_extract_all(F.decode(blob, "ISO-8859-1"), F.lit(r"\G[\x00-\x7F]{0,8}[\x80-\xFF]"), F.lit(0))

    def number(code: Column) -> Column:
        byte = lambda k: F.ascii(F.substring(code, k, 1))
        size, first = F.length(code), F.ascii(code)
        whole = F.lpad(F.hex(F.encode(code, "ISO-8859-1")), 18, "0")
        low = F.conv(F.right(whole, F.lit(16)), 16, 10).cast("bigint")
        groups = [F.shiftleft(F.shiftrightunsigned(low, 8 * k).bitwiseAND(F.lit(127)), 7 * k) for k in range(8)]
        ninth = F.shiftleft(F.conv(F.left(whole, F.lit(2)), 16, 10).cast("bigint"), 56)
        short = F.when(size == 1, first - 128).when(size == 2, first * 128 + byte(2) - 128).when(size == 3, first * 16384 + byte(2) * 128 + byte(3) - 128)
        return short.otherwise(sum(groups[1:], groups[0]) + ninth).cast("bigint")

    return F.transform(codes, number)


def with_gaps(postings: DataFrame) -> DataFrame:
    """Adds gap: doc_id minus the doc_id before in the term, the first against 0."""
    return postings.withColumn("gap", F.col("doc_id") - F.lag("doc_id", 1, 0).over(Window.partitionBy("term").orderBy("doc_id")))


def from_gaps(gaps: DataFrame, order: str) -> DataFrame:
    """doc_id again as the running sum of the gaps of a term in the order of a column."""
    running = Window.partitionBy("term").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return gaps.withColumn("doc_id", F.sum("gap").over(running))


def compress(postings: DataFrame, with_df: bool = False) -> DataFrame:
    """(term, df, cf, blob): one blob a term; ``with_df`` puts the code of df before it. A list is one value here and must
    stay below 2 GB; ``compress_blocks`` has no such bound, and indexes on disk store blocks."""
    coded = with_gaps(postings).select("term", "doc_id", "tf", F.concat(vb_hex(F.col("gap")), vb_hex(F.col("tf"))).alias("code"))
    lists = coded.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"), F.sort_array(F.collect_list(F.struct("doc_id", "code"))).alias("l"))
    codes = F.array_join(F.col("l.code"), "")
    return lists.select("term", "df", "cf", F.unhex(F.concat(vb_hex(F.col("df")), codes) if with_df else codes).alias("blob"))


def decompress(compressed: DataFrame, with_df: bool = False) -> DataFrame:
    """(term, doc_id, tf). A blob that doesn't hold df whole pairs is damaged and gives no rows. A list is decoded where its
    blob is: no posting is shuffled."""
    at = 1 if with_df else 0
    numbers = compressed.select("term", "df", vb_decode(F.col("blob")).alias("x"))
    whole = numbers.where(F.size("x") == 2 * F.col("df") + at)
    return _rows(whole.select("term", F.slice("x", at + 1, 2 * F.col("df")).alias("x"), F.lit(0).cast("bigint").alias("base")))


def _rows(numbers: DataFrame) -> DataFrame:
    """(term, doc_id, tf) of (term, x, base): x has a gap and a tf in turn, the first gap is from base."""
    every = lambda r: F.filter("x", lambda _, i: i % 2 == r)
    halves = numbers.select("term", "base", every(0).alias("gaps"), every(1).alias("tfs"))
    pairs = F.arrays_zip(F.col("ids").alias("doc_id"), F.col("tfs").alias("tf"))
    return with_running(halves, "gaps", "base", "ids").select("term", F.explode(pairs).alias("p")).select("term", F.col("p.doc_id").alias("doc_id"), F.col("p.tf").alias("tf"))


def encode(pairs: Column, base: Column) -> Column:
    """The codes of an array of (doc_id, tf), the first gap from ``base``; an empty array gives empty bytes."""
    # the ids before are an argument and not part of the function, which would make them anew for each pair
    before = F.slice(F.concat(F.array(base.cast("bigint")), F.transform(pairs, lambda x: x["doc_id"])), F.lit(1), F.size(pairs))
    return F.unhex(F.array_join(F.zip_with(pairs, before, lambda x, b: F.concat(vb_hex(x["doc_id"] - b), vb_hex(x["tf"]))), ""))


def compress_blocks(postings: DataFrame, docs: int = BLOCK_DOCS) -> DataFrame:
    """(term, block, df, cf, blob): a term's documents from block * docs on, up to the next block. The first gap is taken
    from there, so that a block is read without the others and no list is gathered whole."""
    by_block = postings.withColumn("block", F.expr(f"doc_id div {docs}L")).groupBy("term", "block")
    lists = by_block.agg(F.count("*").alias("df"), F.sum("tf").alias("cf"), F.sort_array(F.collect_list(F.struct("doc_id", "tf"))).alias("l"))
    return lists.select("term", "block", "df", "cf", encode(F.col("l"), F.col("block") * docs).alias("blob"))


def with_running(df: DataFrame, numbers: str, start: str, out: str, part: int = 64, levels: int = 3) -> DataFrame:
    """Adds out: start plus the sums of the first one, two, ... numbers of an array, within the row. Parts of a fixed size are
    summed apart and shifted by the parts before them, as an array that grows by one is copied each time; the parts' own
    sums are summed in the same way. Each step is a column, as a function of an array would make it anew for each item."""
    grown = lambda acc, x: F.array_append(acc, F.element_at(acc, -1) + x)
    sums = lambda p, b: F.slice(F.aggregate(p, F.array(b), grown), F.lit(2), F.size(p))
    if levels == 1:
        return df.withColumn(out, sums(F.col(numbers), F.col(start)))
    parts, totals, ends = (f"_{x}{levels}" for x in ("parts", "totals", "ends"))
    df = df.withColumn(parts, F.transform(F.expr(f"sequence(0, cast((size({numbers}) - 1) div {part} as int))"), lambda i: F.slice(numbers, i * part + 1, part)))
    df = df.withColumn(totals, F.transform(parts, lambda p: F.aggregate(p, F.lit(0).cast("bigint"), lambda a, x: a + x)))
    df = with_running(df, totals, start, ends, part, levels - 1)
    before = F.slice(F.concat(F.array(start), F.col(ends)), F.lit(1), F.size(parts))
    return df.withColumn(out, F.flatten(F.zip_with(parts, before, sums))).drop(parts, totals, ends)


def decompress_blocks(blocks: DataFrame, docs: int = BLOCK_DOCS) -> DataFrame:
    """(term, doc_id, tf). A blob that doesn't hold df whole pairs is damaged and gives no rows."""
    numbers = blocks.select("term", "block", "df", vb_decode(F.col("blob")).alias("x")).where(F.size("x") == 2 * F.col("df"))
    return _rows(numbers.select("term", "x", (F.col("block") * docs).alias("base")))


def skip_entries(postings: DataFrame) -> DataFrame:
    """(term, doc_id, nth, byte_offset): an entry at every floor(sqrt(df))-th posting but the first, for terms with more
    postings than that. byte_offset: where the posting's code begins in the term's blob."""
    by_doc = Window.partitionBy("term").orderBy("doc_id")
    coded = with_gaps(postings).withColumn("bytes", (F.length(vb_hex(F.col("gap"))) + F.length(vb_hex(F.col("tf")))) / 2)
    placed = coded.select("term", "doc_id", (F.row_number().over(by_doc) - 1).cast("bigint").alias("nth"), F.count("*").over(Window.partitionBy("term")).alias("df"), F.coalesce(F.sum("bytes").over(by_doc.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("bigint").alias("byte_offset"))
    step = F.greatest(F.lit(1), F.floor(F.sqrt("df")))
    return placed.where((F.col("nth") > 0) & (F.col("nth") % step == 0) & (F.col("df") > step)).select("term", "doc_id", "nth", "byte_offset")


def segment(postings: DataFrame, skips: DataFrame, target: int, head: bool = True) -> DataFrame:
    """Postings from the last skip entry at or before ``target`` up to it. Where a term has no such entry they are those from
    the list's head, or none without ``head``."""
    start = skips.where(F.col("doc_id") <= target).groupBy("term").agg(F.max("doc_id").alias("start"))
    found = postings.where(F.col("doc_id") <= target).join(start, "term", "left" if head else "inner")
    return found.where(F.col("start").isNull() | (F.col("doc_id") >= F.col("start"))).select("term", "doc_id", "tf")
