"""Indexes on disk: immutable snapshots, added segments and tombstones under a versioned manifest.

A change writes new Parquet folders and then commits the next manifest by a rename that never overwrites. A folder that
no manifest lists is as if it weren't there, so a failed or repeated job leaves the index as it was. Added segments are
merged in tiers, so that a posting is rewritten about log(n) times; ``merge`` makes one snapshot of everything.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltstone.functions import codec, text
from siltstone.sources.readers import dense_ids
from siltstone.sources.scratch import Scratch

from .index import Index, build, postings_of, stats_of, tokenized, without

POSTINGS = "term string, doc_id long, tf long"
BLOCKS = "term string, block long, df long, cf long, blob binary"
DOC_STATS = "doc_id long, title string, doc_len long"
#: Version of the manifest's form. Form 1 listed parts by name alone.
FORMAT = 2
#: A segment is merged with the older ones before it while these have at most so many times its documents.
FAN = 4


class IndexStore:
    """An index below ``root`` on any Hadoop file system. Document ids are never used twice.

    ``compressed`` stores new posting lists as gap and variable-byte codes, in blocks; readers take either form.
    """

    def __init__(self, spark: SparkSession, root: str, merge_threshold: int = 100, fields: tuple[str, ...] = ("title", "plot"), tokenizer: text.Tokenizer = text.tokens, compressed: bool = False):
        self.spark, self.root, self.merge_threshold, self.fields, self.tokenizer, self.compress = spark, root.rstrip("/"), merge_threshold, fields, tokenizer, compressed
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._conf = spark._jsc.hadoopConfiguration()

    def _path(self, name: str):
        return self._hadoop.Path(f"{self.root}/{name}")

    def _drop(self, name: str) -> None:
        path = self._path(name)
        path.getFileSystem(self._conf).delete(path, True)

    def manifest(self) -> dict:
        """The newest version: parts (folders of postings and doc_stats, the snapshot first, with their numbers of
        documents), tombstones, next_id, pending, and the last batch taken from each stream."""
        top = self._path("manifests")
        fs = top.getFileSystem(self._conf)
        names = [s.getPath().getName() for s in fs.listStatus(top)] if fs.exists(top) else []
        last = max((n for n in names if n.startswith("v")), default=None)
        empty = {"format": FORMAT, "version": 0, "parts": [], "tombstones": [], "next_id": 0, "pending": 0, "streams": {}}
        if last is None:
            return empty
        stream = fs.open(self._path(f"manifests/{last}"))
        try:
            found = json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        if found.get("format", 1) > FORMAT:
            raise ValueError(f"the index has form {found['format']}; this version reads forms up to {FORMAT}")
        if found.get("format", 1) == 1:
            found["parts"] = [{"path": p, "docs": None, "blocks": False} for p in found["parts"]]
        return empty | found | {"format": FORMAT}

    def _commit(self, old: dict, **changes) -> dict:
        new = old | changes | {"version": old["version"] + 1}
        held, final = self._path(f"manifests/.{uuid.uuid4().hex}"), self._path(f"manifests/v{new['version']:09d}.json")
        fs = held.getFileSystem(self._conf)
        out = fs.create(held, False)
        out.write(bytearray(json.dumps(new).encode()))
        out.close()
        none = self.spark.sparkContext._gateway.new_array(self._hadoop.Options.Rename, 0)
        try:
            self._hadoop.FileContext.getFileContext(final.toUri(), self._conf).rename(held, final, none)
        except Exception:
            fs.delete(held, False)
            raise
        return new

    def _sorted(self, postings: DataFrame, folder: str) -> None:
        """Sorted by term over ranges of terms, so that statistics of row groups find a term."""
        rows, place = (codec.compress_blocks(postings), "block") if self.compress else (postings.select("term", "doc_id", "tf"), "doc_id")
        rows.repartitionByRange("term", place).sortWithinPartitions("term", place).write.parquet(folder)

    def _write(self, docs: DataFrame | None = None, index: Index | None = None) -> dict:
        """A new part of docs, whose texts are tokenized once, or of an index."""
        name = f"parts/{uuid.uuid4().hex[:12]}"
        at = f"{self.root}/{name}"
        if docs is not None:
            toks = tokenized(docs, self.fields, self.tokenizer).select(F.col("doc_id").cast("long").alias("doc_id"), "title", "tokens")
            toks.write.parquet(f"{at}/tokens")
            toks = self.spark.read.schema(toks.schema).parquet(f"{at}/tokens")
            self._sorted(postings_of(toks), f"{at}/postings")
            stats_of(toks).write.parquet(f"{at}/doc_stats")
            self._drop(f"{name}/tokens")
        else:
            self._sorted(index.postings, f"{at}/postings")
            index.doc_stats.select("doc_id", "title", "doc_len").write.parquet(f"{at}/doc_stats")
        stored = self.spark.read.schema(BLOCKS if self.compress else POSTINGS).parquet(f"{at}/postings")
        df, cf = (F.sum("df"), F.sum("cf")) if self.compress else (F.count("*"), F.sum("tf"))
        stored.groupBy("term").agg(df.alias("df"), cf.alias("cf")).write.parquet(f"{at}/lexicon")
        part = {"path": name, "docs": 0, "blocks": self.compress}
        return part | {"docs": self._stats([part]).count()}

    def _ids(self, part: dict) -> tuple[int, int | None, int | None]:
        """(documents, least and largest id) of a part; a null or repeated id is an error and the part goes."""
        n, known, distinct, least, most = self._stats([part]).agg(F.count("*"), F.count("doc_id"), F.count_distinct("doc_id"), F.min("doc_id"), F.max("doc_id")).first()
        if n != distinct or n != known:
            self._drop(part["path"])
            raise ValueError("a doc_id is null or repeats")
        return n, least, most

    def create(self, docs: DataFrame) -> dict:
        """Replace the whole index by one of docs (doc_id, title, plot). Ids must differ."""
        old = self.manifest()
        part = self._write(docs)
        top = self._ids(part)[2]
        return self._commit(old, parts=[part], tombstones=[], pending=0, next_id=max(old["next_id"], 0 if top is None else top + 1))

    def _stats(self, parts: list[dict]) -> DataFrame:
        return self.spark.read.schema(DOC_STATS).parquet(*[f"{self.root}/{p['path']}/doc_stats" for p in parts]) if parts else self.spark.createDataFrame([], DOC_STATS)

    def _postings(self, parts: list[dict]) -> DataFrame:
        """Postings of some parts in rows. A filter by term reaches the files of either form."""
        found = self.spark.createDataFrame([], POSTINGS)
        for blocks, schema in ((False, POSTINGS), (True, BLOCKS)):
            own = [f"{self.root}/{p['path']}/postings" for p in parts if p["blocks"] == blocks]
            if own:
                rows = self.spark.read.schema(schema).parquet(*own)
                rows = codec.decompress_blocks(rows) if blocks else rows
                found = rows if len(own) == len(parts) else found.unionByName(rows)
        return found

    def tombstones(self, manifest: dict | None = None) -> DataFrame:
        paths = [f"{self.root}/{t}" for t in (manifest or self.manifest())["tombstones"]]
        return self.spark.read.schema("doc_id long").parquet(*paths) if paths else self.spark.createDataFrame([], "doc_id long")

    def _index(self, now: dict, parts: list[dict]) -> Index:
        postings, stats = self._postings(parts), self._stats(parts)
        if now["tombstones"]:
            dead = self.tombstones(now)
            postings, stats = without(postings, dead), without(stats, dead)
        return Index(postings, stats, self.tokenizer)

    def view(self) -> Index:
        """Snapshot and segments without deleted documents; statistics leave them out too."""
        now = self.manifest()
        return self._index(now, now["parts"])

    def lexicon(self) -> DataFrame:
        """(term, df, cf) without reading postings, where nothing has been deleted since the last merge."""
        now = self.manifest()
        if now["tombstones"] or not now["parts"]:
            return self.view().lexicon
        stored = self.spark.read.schema("term string, df long, cf long").parquet(*[f"{self.root}/{p['path']}/lexicon" for p in now["parts"]])
        return stored if len(now["parts"]) == 1 else stored.groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))

    def compressed(self) -> DataFrame:
        """(term, df, cf, blob) of the view."""
        return codec.compress(self.view().postings)

    def blocks(self) -> DataFrame:
        """(term, block, df, cf, blob) as stored, of the parts that hold blocks."""
        own = [f"{self.root}/{p['path']}/postings" for p in self.manifest()["parts"] if p["blocks"]]
        return self.spark.read.schema(BLOCKS).parquet(*own) if own else self.spark.createDataFrame([], BLOCKS)

    def add(self, docs: DataFrame, batch: tuple[str, int] | None = None) -> range:
        """Append docs (title, plot) as a segment under new ids, in their order; merges once enough are pending.

        Docs may bring a doc_id, from the next free one on. ``batch``: the name of a stream and the number of its batch;
        one that has been added already is left out, so that a batch may come again.
        """
        now = self.manifest()
        if batch and now["streams"].get(batch[0], -1) >= batch[1]:
            return range(now["next_id"], now["next_id"])
        part = self._write(dense_ids(docs, [], now["next_id"]) if "doc_id" not in docs.columns else docs)
        n, least, most = self._ids(part)
        if least is not None and least < now["next_id"]:
            self._drop(part["path"])
            raise ValueError("an id is in use already")
        after = now["next_id"] if most is None else most + 1
        streams = now["streams"] | ({batch[0]: batch[1]} if batch else {})
        new = self._commit(now, parts=[*now["parts"], part], next_id=after, pending=now["pending"] + n, streams=streams)
        if new["pending"] >= self.merge_threshold:
            self._merge_tier()
        return range(now["next_id"], after)

    def delete(self, ids: DataFrame | list[int]) -> None:
        """Hide documents at once. Ids not given out yet are an error, unknown older ones have no effect."""
        now = self.manifest()
        ids = ids.select("doc_id") if isinstance(ids, DataFrame) else self.spark.createDataFrame([(i,) for i in ids], "doc_id long")
        if ids.where((F.col("doc_id") >= now["next_id"]) | (F.col("doc_id") < 0)).take(1):
            raise ValueError("an id has not been given out")
        name = f"tombstones/{uuid.uuid4().hex[:12]}"
        ids.select(F.col("doc_id").cast("long").alias("doc_id")).write.parquet(f"{self.root}/{name}")
        self._commit(now, tombstones=[*now["tombstones"], name])

    def update(self, doc_id: int, title: str, plot: str) -> int:
        """Delete and add; the new id."""
        self.delete([doc_id])
        return self.add(self.spark.createDataFrame([(title, plot)], "title string, plot string"))[0]

    def _merge_tier(self) -> None:
        """Merge the newest segments and as many older parts as are not much larger than all that came after them.

        Tombstones stay, as parts that weren't merged may hold their documents; the merged part has none of these.
        """
        now = self.manifest()
        sizes = [p["docs"] if p["docs"] is not None else self._stats([p]).count() for p in now["parts"]]
        at = len(sizes) - 1
        while at > 0 and sizes[at - 1] <= FAN * sum(sizes[at:]):
            at -= 1
        if at < len(sizes) - 1:
            merged = self._write(index=self._index(now, now["parts"][at:]))
            now = self._commit(now, parts=[*now["parts"][:at], merged], pending=0, **({"tombstones": []} if not at else {}))
        else:
            self._commit(now, pending=0)

    def merge(self) -> None:
        """One new snapshot of the view; segments and tombstones are done with."""
        now = self.manifest()
        self._commit(now, parts=[self._write(index=self._index(now, now["parts"]))], tombstones=[], pending=0)


def packed_layout(postings: DataFrame) -> DataFrame:
    """(term, df, cf, start, length, record): the file of all records, each df and then its pairs, in the order of terms.

    Records are sorted by ranges into a table of the shared folder; a record starts at its range's start and what comes
    before it there, so no task sees more than a range.
    """
    records = codec.compress(postings, with_df=True).withColumnRenamed("blob", "record")
    ranged = records.repartitionByRange("term").sortWithinPartitions("term").withColumn("_range", F.spark_partition_id())
    held = Scratch(postings.sparkSession, "packed").table(ranged, "records").withColumn("length", F.length("record").cast("long"))
    upto = (Window.unboundedPreceding, -1)
    sizes = held.groupBy("_range").agg(F.sum("length").alias("n"))
    starts = sizes.select("_range", F.coalesce(F.sum("n").over(Window.orderBy("_range").rowsBetween(*upto)), F.lit(0)).alias("base"))
    own = F.coalesce(F.sum("length").over(Window.partitionBy("_range").orderBy("term").rowsBetween(*upto)), F.lit(0))
    # a row for each task that wrote
    placed = held.withColumn("own", own).join(F.broadcast(starts), "_range")
    return placed.select("term", "df", "cf", (F.col("base") + F.col("own")).alias("start"), "length", "record")


def file_skips(postings: DataFrame, layout: DataFrame) -> DataFrame:
    """(term, doc_id, file_offset): skip entries with the place of their pair in the packed file."""
    head = (F.length(codec.vb_hex(F.col("df"))) / 2).cast("long")
    found = codec.skip_entries(postings).join(layout.select("term", "df", "start"), "term")
    return found.select("term", "doc_id", (F.col("start") + head + F.col("byte_offset")).alias("file_offset"))


def create_index(spark: SparkSession, mode: str, docs: DataFrame | None = None, root: str | None = None, **options):
    """memory: an Index of docs; disk or updatable: an IndexStore below root, built of docs if they are given."""
    if mode == "memory":
        return build(docs if docs is not None else spark.createDataFrame([], "doc_id long, title string, plot string"), **options)
    if mode not in ("disk", "updatable"):
        raise ValueError(f"unknown mode {mode!r}: memory, disk or updatable")
    if not root:
        raise ValueError("an index on disk needs a folder")
    store = IndexStore(spark, root, **options)
    if docs is not None:
        store.create(docs)
    return store
