"""Exact n-gram Jaccard self-join with several global token orders.

A document is its set of distinct word shingles. Two sets of a common threshold t link only if they share a token among
the first n - ceil(t n) + 1 of their n tokens, whatever total order all tokens are put in. So a pair must share a prefix
token under each of several orders; the filters are intersected before a pair is verified on whole sets. All orders put
rare tokens first (prefixes of rare tokens meet few others, and a passage that many documents share stays out of them)
and differ in how they order tokens of one frequency.

Steps, none of which gathers more than bounded blocks in a task:

1. Documents are read in chunks of a bounded number of tokens: shingles are computed, a chunk's distinct texts kept in a
   file of the shared folder, and its token counts sent as compressed sorted runs, one for each range of the hash space.
   A document becomes a row (doc_id, n, sig) with sig a 128-bit digest of its set: documents of one sig form a class.
2. For each range the runs are merged to document frequencies; each chunk gets back those of its tokens that others
   have as well. Tokens of one document alone can't link, so most documents end here.
3. For each chunk, the prefixes of its classes under each order: classes with a prefix token that others have.
4. Candidates share a prefix token of the first order. The home of a class is the least class that it shares one with;
   classes of one home are cut by size level and hash into units of at most ``SETS``. For each token, its classes go to
   the units that its other classes are in: a task is a pair of units. A token whose classes are spread over more than
   ``FEW`` units has tasks of its own instead: its classes are dealt into blocks, and each pair of blocks is a task.
   So copies that share many tokens meet in one place and go there once, and no task or row depends on chains of
   candidates, which may run through a whole corpus.
5. In a task the prefix filters of all orders are intersected and the remaining pairs verified. A pair that shares
   tokens of the second kind is left to the task of the least of these, so each pair counts once. Every link counts,
   and a spanning forest of the links goes on.
6. Components over classes, then over documents.

Frequencies only order tokens; counting a token twice in different chunks or a collision of truncated hashes costs
time, never a link. A set is compared by 64-bit hashes of shingles.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, filesystem, sized, table, trim_memory, utf8
from .components import connected_components
from .shingles import mix, text_sets

ORDERS = 3
#: Tokens of a chunk, and of a hash range.
RUN, RANGE = 3_000_000, 1_000_000
#: Bytes of text that a task turns into sets at once.
TEXT_BYTES = 4 << 20
#: Sets and tokens of a unit or block, and units that a token's classes go to by pairs of units.
SETS, SET_TOKENS, FEW = 512, 2_000_000, 32
_SALT = [np.uint64(0), np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)]


def pack_sorted(keys: np.ndarray) -> bytes:
    """Ascending integers as the byte planes of their differences, compressed."""
    gaps = np.diff(keys, prepend=np.uint64(0)).astype("<u8")
    width = max(1, (int(gaps.max(initial=0)).bit_length() + 7) // 8)
    planes = np.ascontiguousarray(gaps.view(np.uint8).reshape(-1, 8)[:, :width].T)
    return bytes([width]) + zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack_sorted(data: bytes) -> np.ndarray:
    width, planes = data[0], np.frombuffer(zstandard.decompress(data[1:]), np.uint8)
    gaps = np.zeros((len(planes) // width, 8), np.uint8)
    gaps[:, :width] = planes.reshape(width, -1).T
    return np.cumsum(gaps.view("<u8")[:, 0], dtype=np.uint64)


def prefix_length(n: int, percent: int) -> int:
    """n - ceil(t n) + 1."""
    return n - -(-percent * n // 100) + 1


def prefixes(tokens: np.ndarray, df: np.ndarray, percent: int) -> list[np.ndarray]:
    """Under each order, the tokens of the prefix that another document may have (df over 1)."""
    p = prefix_length(len(tokens), percent)
    alone = int((df < 2).sum())
    if alone >= p:
        return []
    shared, often, take = tokens[df > 1], df[df > 1], p - alone
    return [shared[np.lexsort((mix(shared ^ salt) if k else shared, often))[:take]] for k, salt in enumerate(_SALT[:ORDERS])]


def common_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each left with each right set."""
    out = np.zeros((len(left), len(right)), np.float32)
    a, b = (np.concatenate(x) if x else np.empty(0, np.uint64) for x in (left, right))
    both = np.intersect1d(a, b)
    ia, ib = (np.repeat(np.arange(len(x)), [len(s) for s in x]) for x in (left, right))
    ja, jb = (np.minimum(np.searchsorted(both, x), max(len(both) - 1, 0)) for x in (a, b))
    if not len(both):
        return out
    for i, j, x in ((0, ja, a), (1, jb, b)):
        keep = both[j] == x
        if i == 0:
            ia, ja = ia[keep], j[keep]
        else:
            ib, jb = ib[keep], j[keep]
    order_a, order_b = np.argsort(ja, kind="stable"), np.argsort(jb, kind="stable")
    ia, ja, ib, jb = ia[order_a], ja[order_a], ib[order_b], jb[order_b]
    step = 2048
    for at in range(0, len(both), step):
        m = []
        for rows, cols, n in ((ia, ja, len(left)), (ib, jb, len(right))):
            lo, hi = np.searchsorted(cols, [at, at + step])
            x = np.zeros((n, step), np.float32)
            x[rows[lo:hi], cols[lo:hi] - at] = 1
            m.append(x)
        out += m[0] @ m[1].T
    return out


def block_links(left: list[list[np.ndarray]], right: list[list[np.ndarray]], percent: int, same: bool) -> np.ndarray:
    """Which of the pairs link. Each set comes with its prefixes behind it and with tokens that two sets of a pair must not
    share: [set, prefix 1, prefix 2, ..., others]."""
    n, m = (np.array([len(x[0]) for x in side], np.int64) for side in (left, right))
    maybe = (100 * np.minimum.outer(n, m) >= percent * np.maximum.outer(n, m)) & (n > 0)[:, None] & (m > 0)[None, :]
    if same:
        maybe &= np.triu(np.ones(maybe.shape, bool), 1)
    for k in range(1, ORDERS + 1):
        if not maybe.any():
            return maybe
        rows, cols = np.flatnonzero(maybe.any(1)), np.flatnonzero(maybe.any(0))
        maybe[np.ix_(rows, cols)] &= common_counts([left[i][k] for i in rows], [right[j][k] for j in cols]) > 0
    if any(len(x[-1]) for x in left) and any(len(x[-1]) for x in right):
        maybe &= common_counts([x[-1] for x in left], [x[-1] for x in right]) == 0
    i, j = np.nonzero(maybe)
    if len(i) > 4 * (len(n) + len(m)):
        rows, cols = np.unique(i), np.unique(j)
        shared = np.zeros(maybe.shape, np.int64)
        shared[np.ix_(rows, cols)] = common_counts([left[x][0] for x in rows], [right[x][0] for x in cols])
        shared = shared[i, j]
    else:
        shared = np.array([len(np.intersect1d(left[a][0], right[b][0], assume_unique=True)) for a, b in zip(i, j, strict=True)], np.int64)
    good = 100 * shared >= percent * (n[i] + m[j] - shared)
    out = np.zeros(maybe.shape, bool)
    out[i[good], j[good]] = True
    return out


def forest(n: int, pairs: np.ndarray) -> list[int]:
    """A root for each of n nodes, the same for nodes that pairs connect."""
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs.tolist():
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _chunks(scratch: Scratch, docs: DataFrame, key: str, key_type: str, size: int, key_bits: int, range_bits: int) -> DataFrame:
    """Step 1: rows (doc_id, n, sig) and rows (chunk, range, keys, counts) in one table, and the chunks' files."""
    root = scratch.path("chunks")
    schema = pa.schema([("doc_id", pa.int64() if key_type == "long" else pa.string()), ("n", pa.int64()), ("sig", pa.binary()), ("chunk", pa.int64()), ("range", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])
    kept = pa.schema([("sig", pa.binary()), ("text", pa.large_string())])

    def run(batches):
        from pyspark import TaskContext

        task = TaskContext.get()
        fs, top = filesystem(root)
        fs.create_dir(top, recursive=True)
        chunk, held, seen, n_held, out = task.partitionId() << 24, [], set(), 0, None

        def temporary():
            return f"{top}/.{chunk}.{task.taskAttemptId()}"

        def runs():
            """The chunk's counts; its file gets its name."""
            out.close()
            fs.move(temporary(), f"{top}/{chunk}.parquet")
            keys, counts = np.unique(np.concatenate(held) >> np.uint64(64 - key_bits), return_counts=True)
            cuts = np.searchsorted(keys, np.arange((1 << range_bits) + 1, dtype=np.uint64) << np.uint64(key_bits - range_bits))
            zip_ = zstandard.ZstdCompressor(level=1)
            for r in np.flatnonzero(np.diff(cuts)).tolist():
                a, b = cuts[r], cuts[r + 1]
                base = np.uint64(r) << np.uint64(key_bits - range_bits)
                yield _batch([(None, None, None, chunk, r, pack_sorted(keys[a:b] - base), zip_.compress(np.minimum(counts[a:b], 65535).astype("<u2").tobytes()))], schema)

        for some in sized(batches, 1, TEXT_BYTES):
            rows, fresh, sigs = [], [], []
            for i, (doc, tokens) in enumerate(zip(some.column(0).to_pylist(), text_sets(some.column(1), size), strict=True)):
                sig = hashlib.blake2b(tokens.tobytes(), digest_size=16).digest() if len(tokens) else None
                rows.append((doc, len(tokens), sig, None, None, None, None))
                if sig is not None and sig not in seen:
                    seen.add(sig)
                    fresh.append(i)
                    sigs.append(sig)
                    held.append(tokens)
                    n_held += len(tokens)
            yield _batch(rows, schema)
            if fresh:
                if out is None:
                    out = pq.ParquetWriter(fs.open_output_stream(temporary()), kept, compression="zstd")
                out.write_table(pa.table([pa.array(sigs, pa.binary()), some.column(1).take(pa.array(fresh)).cast(pa.large_string())], schema=kept))
            if n_held >= RUN:
                yield from runs()
                chunk, held, seen, n_held, out = chunk + 1, [], set(), 0, None
        if held:
            yield from runs()

    rows = docs.select(F.col(key).cast(key_type).alias("doc_id"), utf8("text").alias("text"))
    return scratch.table(rows.mapInArrow(run, f"doc_id {key_type}, n long, sig binary, chunk long, range long, keys binary, counts binary"), "sets")


def _frequencies(runs: DataFrame) -> DataFrame:
    """Step 2: for each chunk and range the chunk's keys that occur more than once anywhere, and how often."""

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        keys = [unpack_sorted(k) for k in pdf["keys"]]
        counts = [np.frombuffer(zstandard.decompress(c), "<u2") for c in pdf["counts"]]
        every, place = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(place, np.concatenate(counts)).astype(np.int64)
        at, out = 0, []
        for chunk, own in zip(pdf["chunk"], keys, strict=True):
            df = total[place[at : at + len(own)]]
            at += len(own)
            if (df > 1).any():
                out.append((chunk, int(pdf["range"].iloc[0]), pack_sorted(own[df > 1]), zstandard.compress(np.minimum(df[df > 1], 65535).astype("<u2").tobytes(), 1)))
        return pd.DataFrame(out, columns=["chunk", "range", "keys", "counts"])

    return runs.groupBy("range").applyInPandas(merge, "chunk long, range long, keys binary, counts binary")


def _classes(scratch: Scratch, shared: DataFrame, size: int, percent: int, key_bits: int, range_bits: int) -> DataFrame:
    """Step 3: (sig, n, tokens, p1, p2, p3) of the classes that may link; p1 as array<long>, the rest as bytes. A task
    holds one chunk's tokens and a batch of its texts."""
    root = scratch.path("chunks")
    types = [pa.binary(), pa.int64(), pa.binary(), pa.list_(pa.int64()), *[pa.binary()] * (ORDERS - 1)]
    schema = pa.schema(list(zip(["sig", "n", "tokens", *[f"p{k}" for k in range(1, ORDERS + 1)]], types, strict=True)))

    def find(chunk, parts):
        keys, counts = [], []
        for r, k, c in parts:
            keys.append(unpack_sorted(k) + (np.uint64(r) << np.uint64(key_bits - range_bits)))
            counts.append(np.frombuffer(zstandard.decompress(c), "<u2"))
        keys, counts = np.concatenate(keys), np.concatenate(counts).astype(np.int64)
        fs, top = filesystem(root)
        with fs.open_input_file(f"{top}/{chunk}.parquet") as f:
            for some in sized(pq.ParquetFile(f).iter_batches(512), 1, TEXT_BYTES):
                out = []
                for sig, tokens in zip(some.column(0).to_pylist(), text_sets(some.column(1), size), strict=True):
                    short = tokens >> np.uint64(64 - key_bits)
                    at = np.minimum(np.searchsorted(keys, short), len(keys) - 1)
                    df = np.where(keys[at] == short, counts[at], 1)
                    if found := prefixes(tokens, df, percent):
                        out.append((sig, len(tokens), tokens.tobytes(), found[0].view(np.int64), *[p.tobytes() for p in found[1:]]))
                if out:
                    yield _batch(out, schema)

    def run(batches):
        now, parts = None, []
        for batch in batches:
            for row in batch.to_pylist():
                if row["chunk"] != now and parts:
                    yield from find(now, parts)
                    parts = []
                now = row["chunk"]
                parts.append((row["range"], row["keys"], row["counts"]))
        if parts:
            yield from find(now, parts)
        trim_memory()

    ordered = shared.repartition("chunk").sortWithinPartitions("chunk", "range")
    return ordered.mapInArrow(run, "sig binary, n long, tokens binary, p1 array<long>, " + ", ".join(f"p{k} binary" for k in range(2, ORDERS + 1)))


def _tasks(scratch: Scratch, classes: DataFrame, whole: DataFrame, percent: int) -> DataFrame:
    """Step 4: a row for each class and task, keyed by (token, a, b): the token of the second kind or null, and the units or
    blocks that meet; mine: the class's own. Classes go by a 64-bit hash of sig here, as the rows are many: two classes of
    one hash go where either has to, and each pair still meets once. Aggregates that are joined again are tables, so that
    Spark can split what is skewed in those joins."""
    table_ = scratch.table
    sid = F.xxhash64("sig").alias("sid")
    tokens_of = table_(classes.select(sid, F.explode("p1").alias("token")), "tokens")
    hubs = table_(tokens_of.groupBy("token").agg(F.min("sid").alias("hub"), F.count("*").alias("m")).where("m > 1"), "hubs")
    # joined by sorting at every size: these sides grow with the corpus, and one plan shows on a small one how
    shared = table_(tokens_of.join(hubs.drop("m").hint("merge"), "token"), "shared")
    scratch.drop("tokens")
    level = F.floor(F.log("n") / math.log(100 / percent)).cast("long")
    sizes_of = classes.groupBy(sid).agg(F.max("n").alias("n"))
    homes = table_(shared.groupBy("sid").agg(F.min("hub").alias("home")).join(sizes_of, "sid").withColumn("level", level), "homes")
    sizes = table_(homes.groupBy("home", "level").agg(F.count("*").alias("m"), F.sum("n").alias("t")), "sizes")
    one = sizes.groupBy("home").agg(((F.sum("m") <= SETS) & (F.sum("t") <= SET_TOKENS)).alias("one"))
    cut = table_(sizes.join(one, "home").withColumn("parts", F.greatest(F.ceil(F.col("m") / SETS), F.ceil(F.col("t") / SET_TOKENS))).select("home", "level", "one", "parts"), "cut")
    # a small home is one unit of all levels (-1); two units of one hash would be one, which loses nothing
    own = F.when(F.col("one"), F.lit(-1)).otherwise(F.col("level")).cast("long")
    part = F.when(F.col("one"), F.lit(0)).otherwise(F.pmod(F.xxhash64("sid"), F.col("parts"))).cast("long")
    units = table_(homes.join(cut, ["home", "level"]).select("sid", own.alias("level"), F.xxhash64("home", own, part).alias("unit")), "units")

    placed = table_(shared.select("sid", "token").join(units.hint("merge"), "sid"), "placed")
    scratch.drop("shared")
    places = table_(placed.select("token", "unit", "level").distinct(), "places")
    spread = table_(places.groupBy("token").agg(F.count("*").alias("k")).where("k > 1"), "spread")
    few = table_(places.join(spread.where(F.col("k") <= FEW), "token").groupBy("token").agg(F.collect_list(F.struct("unit", "level")).alias("others")), "few")
    often = table_(spread.where(F.col("k") > FEW).join(hubs, "token").select("token", F.ceil(F.col("m") / SETS).alias("blocks")), "often")

    none = F.lit(None).cast("long").alias("token")
    inside = units.select("sid", none, F.col("unit").alias("a"), F.col("unit").alias("b"), F.col("unit").alias("mine"))
    meet = placed.join(few.hint("merge"), "token").select("sid", "unit", "level", F.explode("others").alias("o"))
    near = (F.col("level") < 0) | (F.col("o.level") < 0) | (F.abs(F.col("level") - F.col("o.level")) <= 1)
    across = meet.where((F.col("unit") != F.col("o.unit")) & near).select("sid", none, F.least("unit", "o.unit").alias("a"), F.greatest("unit", "o.unit").alias("b"), F.col("unit").alias("mine")).distinct()
    held = placed.select("sid", "token").join(often, "token").withColumn("mine", F.pmod(F.xxhash64("sid"), F.col("blocks")))
    blocks = held.withColumn("x", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).select("sid", "token", F.least("mine", "x").alias("a"), F.greatest("mine", "x").alias("b"), "mine")
    apart = held.groupBy("sid").agg(F.collect_list("token").alias("apart"))
    copies = whole.select(sid, F.col("sig").alias("whole_sig"), "copies")
    known = inside.unionByName(across).unionByName(blocks).join(apart, "sid", "left").join(copies.hint("merge"), "sid")
    tasks = table_(known, "tasks")
    scratch.drop("hubs", "homes", "sizes", "cut", "units", "placed", "places", "spread", "few", "often")
    # sets go through this one join
    return tasks.hint("merge").join(classes.withColumnRenamed("sig", "whole_sig"), "whole_sig").withColumnRenamed("whole_sig", "sig")


def _links(tasks: DataFrame, percent: int) -> DataFrame:
    """Step 5: for each class of each task, a class that it is connected to (itself: none) and its links."""

    def verify(key, pdf: pd.DataFrame) -> pd.DataFrame:
        token, a, b = key
        token = np.iinfo(np.int64).max if pd.isna(token) else int(token)
        apart = [np.empty(0, np.int64) if x is None else np.asarray(x, np.int64) for x in pdf["apart"]]
        apart = [x if pd.isna(key[0]) else x[x < token] for x in apart]
        sets = [
            [np.frombuffer(t, np.uint64), np.asarray(p, np.int64).view(np.uint64), *[np.frombuffer(x, np.uint64) for x in rest], np.unique(own).view(np.uint64)]
            for t, p, own, *rest in zip(pdf["tokens"], pdf["p1"], apart, *[pdf[f"p{k}"] for k in range(2, ORDERS + 1)], strict=True)
        ]
        size, mine = pdf["copies"].to_numpy(), pdf["mine"].to_numpy()
        i = np.arange(len(pdf)) if a == b else np.flatnonzero(mine == a)
        j = i if a == b else np.flatnonzero(mine == b)
        linked = block_links([sets[x] for x in i], [sets[x] for x in j], percent, a == b)
        p, q = np.nonzero(linked)
        p, q = i[p], j[q]
        links = np.bincount(p, size[q], len(pdf)) + np.bincount(q, size[p], len(pdf))
        root = forest(len(pdf), np.stack([p, q], 1))
        sig = pdf["sig"].to_numpy()
        some = (links > 0) | (np.array(root) != np.arange(len(pdf)))
        return pd.DataFrame({"sig": sig[some], "to": sig[root][some], "links": links[some].astype(np.int64)})

    return tasks.groupBy("token", "a", "b").applyInPandas(verify, "sig binary, to binary, links long")


def near_duplicates(spark: SparkSession, docs: DataFrame, size: int = 5, percent: int = 80, key: str = "doc_id") -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links) of each row of docs.

    Rows link when 100 * intersection >= percent * union of their sets of ``size``-word shingles. component_id is the
    smallest doc_id that links lead to, the row's own included; n_links the number of rows that it links with. A null or
    blank text is an empty set without links and its own component. Rows may repeat: copies link with each other. A null
    doc_id counts as larger than any (a component of such rows alone has none). An empty table gives no row. ``key`` names
    another column (integer or text) to stand for doc_id. All other columns are ignored.
    """
    key_type = "long" if dict(docs.dtypes)[key] in ("tinyint", "smallint", "int", "bigint") else "string"
    scratch = Scratch(spark, "jaccard")
    tokens = max(1, (docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // 6)
    range_bits = max(3, math.ceil(math.log2(tokens / RANGE))) if tokens > RANGE else 3
    key_bits = min(63, max(40, 18 + math.ceil(math.log2(tokens + 1))))
    sets = _chunks(scratch, docs, key, key_type, size, key_bits, range_bits)
    rows = scratch.table(sets.where("chunk is null").select("doc_id", "n", "sig"), "rows")
    shared = _frequencies(sets.where("chunk is not null").select("chunk", "range", "keys", "counts"))
    classes = scratch.table(_classes(scratch, shared, size, percent, key_bits, range_bits), "classes0")
    scratch.drop("chunks", "sets")
    classes = scratch.table(classes.dropDuplicates(["sig"]), "classes")
    scratch.drop("classes0")

    whole = scratch.table(rows.where("sig is not null").groupBy("sig").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies")), "whole")
    links = scratch.table(_links(_tasks(scratch, classes, whole, percent), percent), "links")
    scratch.drop("classes", "tasks")
    roots = connected_components(scratch, links.where("sig <> to").select(F.col("sig").alias("u"), F.col("to").alias("v")), "linked")
    degree = links.groupBy("sig").agg(F.sum("links").alias("links"))

    linked = roots.select(F.col("node").alias("sig"), "root").join(whole, "sig")
    smallest = linked.groupBy("root").agg(F.min("first").alias("component"))
    linked = linked.join(smallest, "root").join(degree, "sig").select("sig", "component", "links")
    known = whole.join(linked, "sig", "left").select("sig", F.coalesce("component", "first").alias("component_id"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    known = scratch.table(known, "known")
    alone = rows.where("sig is null").select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links"))
    return rows.where("sig is not null").join(known, "sig").select("doc_id", F.col("n").alias("n_shingles"), "component_id", "n_links").unionByName(alone)


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 4-word shingles have a Jaccard similarity of 0.85 or more."""
    return near_duplicates(spark, table(spark, sf_dir, "documents"), size=4, percent=85)


OP8_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' '))) END AS s FROM words),
tokens AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM sets),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, a.n AS nx, b.n AS ny, count(*) AS c FROM tokens a JOIN tokens b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM shared WHERE 100 * c >= 85 * (nx + ny - c)),
reach AS (SELECT x AS doc_id, x AS node FROM (SELECT DISTINCT x FROM links) UNION SELECT r.doc_id, l.y FROM reach r JOIN links l ON l.x = r.node),
least AS (SELECT doc_id, min(node) AS c FROM reach GROUP BY doc_id),
degree AS (SELECT x AS doc_id, count(*) AS d FROM links GROUP BY x)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, coalesce(l.c, s.doc_id) AS component_id, CAST(coalesce(d.d, 0) AS BIGINT) AS n_links
FROM sets s LEFT JOIN least l USING (doc_id) LEFT JOIN degree d USING (doc_id)
"""
