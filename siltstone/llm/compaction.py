"""Size-tiered compaction of document shards, with DataFrame operations only.

A store is a folder of immutable Parquet files and a chain of manifests. A manifest is one JSON file named after its
version that lists the live files with their bytes and the run that they belong to. It is written under another name
and renamed without overwriting, so of two writers of one version exactly one succeeds, readers see a whole version or
none, and a job that dies before its commit leaves files that no manifest lists.

* append: an arrival becomes a run of small files, written in one pass over the input.
* compact: runs are put into tiers by size (each tier ``fan`` times the one before). While a tier has ``fan`` runs or
  more, they are merged into files of about ``target_bytes`` as one run, and the next manifest is committed. Files read
  by tasks are packed by size, so a merge has no shuffle and no sort, and rows keep to the task that reads them.
* files that the last ``keep_versions`` manifests don't list are deleted by ``expire``, and so are older manifests.
  A writer that loses a race for a version tries again on the newer one (an append) or drops what it wrote (a merge);
  files of a job that died before its commit are found by ``vacuum``.

A manifest has some 150 bytes a file: with files of the target size it stays in the tens of MB at 100 TB.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table


@dataclass(frozen=True)
class File:
    path: str
    bytes: int
    run: str


def nullable(node):
    """A schema's JSON in which everything may be null."""
    if isinstance(node, list):
        return [nullable(x) for x in node]
    if isinstance(node, dict):
        return {k: True if k in ("nullable", "containsNull", "valueContainsNull") else v if k == "metadata" else nullable(v) for k, v in node.items()}
    return node


class ShardStore:
    """A folder (any Hadoop file system) of shards under versioned manifests."""

    def __init__(self, spark: SparkSession, root: str, target_bytes: int = 64 << 20, fan: int = 4, smallest: int = 1 << 20):
        self.spark, self.root, self.target_bytes, self.fan, self.smallest = spark, root.rstrip("/"), target_bytes, fan, smallest
        self._fs = spark._jvm.org.apache.hadoop.fs
        self._conf = spark._jsc.hadoopConfiguration()

    # metadata on the driver: a few bytes per file
    def _path(self, name: str):
        return self._fs.Path(name if "://" in name or name.startswith("file:") else f"{self.root}/{name}")

    def _system(self):
        return self._path("manifests").getFileSystem(self._conf)

    def version(self) -> int:
        """The newest committed version; 0: none."""
        top = self._path("manifests")
        fs = self._system()
        return max((self._number(s.getPath().getName()) for s in fs.listStatus(top)), default=0) if fs.exists(top) else 0

    @staticmethod
    def _number(name: str) -> int:
        """A manifest's version by its name; 0: not a manifest."""
        return int(name[1:-5]) if name[0] == "v" and name.endswith(".json") else 0

    def manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if not version:
            return {"version": 0, "schema": None, "files": []}
        stream = self._system().open(self._path(f"manifests/v{version:09d}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def files(self, version: int | None = None) -> list[File]:
        return [File(**f) for f in self.manifest(version)["files"]]

    def commit(self, based_on: int, files: list[File], schema: str) -> int:
        """Write the version after ``based_on``; FileExistsError if another writer has done so."""
        version = based_on + 1
        final, held = self._path(f"manifests/v{version:09d}.json"), self._path(f"manifests/.{uuid.uuid4().hex}")
        fs = self._system()
        out = fs.create(held, False)
        out.write(bytearray(json.dumps({"version": version, "schema": schema, "files": [vars(f) for f in files]}).encode()))
        out.close()
        context = self._fs.FileContext.getFileContext(final.toUri(), self._conf)
        none = self.spark.sparkContext._gateway.new_array(self._fs.Options.Rename, 0)
        try:
            context.rename(held, final, none)
        except Exception as e:
            fs.delete(held, False)
            if "AlreadyExists" in str(e):
                raise FileExistsError(f"version {version} is there already") from e
            raise
        return version

    def _written(self, folder: str, run: str) -> list[File]:
        """The Parquet files below a folder that a finished write has left."""
        top = self._path(folder)
        found, files = self._system().listFiles(top, True), []
        while found.hasNext():
            s = found.next()
            if s.getPath().getName().endswith(".parquet"):
                files.append(File(s.getPath().toString(), s.getLen(), run))
        return files

    def _drop(self, files: list[File]) -> None:
        for f in files:
            self._system().delete(self._fs.Path(f.path), False)

    def append(self, df: DataFrame, arrival: str | None = None, tries: int = 10) -> int:
        """Commit df as one run or, with ``arrival``, as one run and one version for each value of that column, written in a
        single pass; the newest version.

        The column ``arrival`` isn't stored. An empty df commits a version without new files. Columns must be those of the
        store by name and type, whether they may hold nulls or not.
        """
        run = uuid.uuid4().hex[:12]
        schema = json.dumps(nullable(json.loads((df.drop(arrival) if arrival else df).schema.json())))
        before = self.manifest()["schema"]
        if before not in (None, schema):
            raise ValueError("the columns differ from the store's")
        writer = df.write.option("compression", "zstd")
        (writer.partitionBy(arrival) if arrival else writer).parquet(f"{self.root}/runs/{run}")
        new = self._written(f"runs/{run}", run)
        if arrival:
            new = [File(f.path, f.bytes, f"{run}-{f.path.rsplit('/', 2)[1]}") for f in new]
        version = 0
        for one in sorted({f.run for f in new}) or [run]:
            own = [f for f in new if f.run == one]
            for k in range(tries):
                now = self.manifest()
                try:
                    version = self.commit(now["version"], [File(**f) for f in now["files"]] + own, schema)
                    break
                except FileExistsError:  # another writer was first
                    if k == tries - 1:
                        self._drop(own)
                        raise
        return version

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of a version, exactly once."""
        found = self.manifest(version)
        if found["schema"] is None:
            raise ValueError("nothing has been committed")
        schema = self.spark._jvm.org.apache.spark.sql.types.DataType.fromJson(found["schema"]).toDDL()
        if not found["files"]:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f["path"] for f in found["files"]])

    def tier(self, size: int) -> int:
        """0 up to ``smallest`` bytes, then one more for each factor of ``fan``."""
        return max(0, math.ceil(math.log(max(size, 1) / self.smallest, self.fan)))

    def due(self, files: list[File]) -> list[str]:
        """The runs to merge next: those of the lowest tier that has ``fan`` of them. A run that consists of files of
        the target size gains nothing and is left alone."""
        runs: dict[str, list[int]] = {}
        for f in files:
            runs.setdefault(f.run, []).append(f.bytes)
        tiers: dict[int, list[str]] = {}
        for run, sizes in runs.items():
            if sum(sizes) / len(sizes) < 0.5 * self.target_bytes:
                tiers.setdefault(self.tier(sum(sizes)), []).append(run)
        return next((sorted(tiers[t]) for t in sorted(tiers) if len(tiers[t]) >= self.fan), [])

    def compact(self) -> int:
        """Merge until no tier is due; the newest version."""
        while True:
            now = self.manifest()
            files = [File(**f) for f in now["files"]]
            runs = set(self.due(files))
            if not runs:
                return now["version"]
            old = [f for f in files if f.run in runs]
            run = uuid.uuid4().hex[:12]
            schema = self.spark._jvm.org.apache.spark.sql.types.DataType.fromJson(now["schema"]).toDDL()
            n = max(1, math.ceil(sum(f.bytes for f in old) / self.target_bytes))
            merged = self.spark.read.schema(schema).parquet(*[f.path for f in old])
            merged.coalesce(n).write.option("compression", "zstd").parquet(f"{self.root}/runs/{run}")
            new = self._written(f"runs/{run}", run)
            try:
                self.commit(now["version"], [f for f in files if f.run not in runs] + new, now["schema"])
            except FileExistsError:
                self._drop(new)

    def expire(self, keep_versions: int = 1) -> None:
        """Delete files that only versions before the last ``keep_versions`` list, and these versions."""
        last = self.version()
        first = max(1, last - keep_versions + 1)
        live = {f.path for v in range(first, last + 1) for f in self.files(v)}
        fs, top = self._system(), self._path("manifests")
        old = sorted(v for s in (fs.listStatus(top) if fs.exists(top) else []) if (v := self._number(s.getPath().getName())) and v < first)
        for v in old:
            self._drop([f for f in self.files(v) if f.path not in live])
            fs.delete(self._path(f"manifests/v{v:09d}.json"), False)

    def vacuum(self, older_than: float = 7 * 86400) -> int:
        """Delete files below runs that no version lists and that are older than so many seconds, as no job that wrote them
        can still be on its way to a commit; how many."""
        fs, top = self._system(), self._path("manifests")
        versions = [v for s in (fs.listStatus(top) if fs.exists(top) else []) if (v := self._number(s.getPath().getName()))]
        live = {f.path for v in versions for f in self.files(v)}
        runs, gone, limit = self._path("runs"), 0, 1000 * (time.time() - older_than)
        found = fs.listFiles(runs, True) if fs.exists(runs) else None
        while found is not None and found.hasNext():
            s = found.next()
            if s.getPath().toString() not in live and s.getModificationTime() <= limit:
                fs.delete(s.getPath(), False)
                gone += 1
        return gone


def op2_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, appended as 32 arrivals of unequal size, compacted, and read back through the manifest."""
    docs = table(spark, sf_dir, "documents")
    # arrivals by a hash of the row: half of them draw from all rows, half from a quarter
    h = F.pmod(F.xxhash64("doc_id", "text"), F.lit(64))
    arrival = F.when(h < 16, h).otherwise(16 + h % 16)
    store = ShardStore(spark, Scratch(spark, "shards").root)
    name = "arrival" + "_" * max(map(len, docs.columns), default=0)  # none of the table's own
    store.append(docs.withColumn(name, arrival), arrival=name)
    store.compact()
    store.expire()
    return store.read().select("doc_id", "lang", "source", "n_chars", F.octet_length("text").cast("long").alias("n_bytes"), F.md5("text").alias("text_md5"))


OP2_SQL = "SELECT doc_id, lang, source, n_chars, CAST(strlen(text) AS BIGINT) AS n_bytes, md5(text) AS text_md5 FROM documents"
