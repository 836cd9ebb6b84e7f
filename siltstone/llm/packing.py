"""Packing token sequences by non-negative least squares over a length histogram.

A document gives whole windows, which need no plan, and one rest shorter than the window. Rests fall into bins of
``window / bins`` tokens. Every combination of up to ``depth`` bins that fills the window is a pattern; the repeat
counts x >= 0 that bring the patterns' use of each bin closest to the histogram are found by non-negative least
squares, rounded down, cut where a bin runs out, and topped up greedily. Rests without a place in a pattern, and as
many more as the patterns' own gaps need, form a stream: it is cut freely to fill the gaps that bins leave in each
sequence, and what remains of it is laid greedily into further sequences, the last of them a row of powers of two.
So padding is left only if the gaps hold more than all rests outside the patterns.

Only the histogram (one row per bin) comes to the driver.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import ENCODE_BYTES, Scratch, running_sum, sized, table, utf8
from .encoding import encoder

#: Tokens of the stream that one task matches against gaps.
CELL = 1 << 18


def nonnegative_least_squares(a: np.ndarray, b: np.ndarray, rounds: int = 1000) -> np.ndarray:
    """Lawson and Hanson's active-set solution of min |a x - b| over x >= 0."""
    n = a.shape[1]
    x, passive = np.zeros(n), np.zeros(n, bool)
    tol = 1e-9 * max(1.0, float(np.abs(a).sum(0).max(initial=0)) * float(np.abs(b).max(initial=0)))
    for _ in range(rounds):
        w = a.T @ (b - a @ x)
        w[passive] = -np.inf
        if passive.all() or w.max() <= tol:
            break
        passive[int(w.argmax())] = True
        while True:
            s = np.zeros(n)
            s[passive] = np.linalg.lstsq(a[:, passive], b, rcond=None)[0]
            if not passive.any() or s[passive].min() > 0:
                break
            low = passive & (s <= 0)
            step = float(np.min(x[low] / np.maximum(x[low] - s[low], 1e-300)))
            x = x + step * (s - x)
            passive &= x > 1e-12
            x[~passive] = 0
        x = s
    return x


def patterns(bins: int, depth: int) -> list[tuple[int, ...]]:
    """Combinations of up to ``depth`` bins (1 to bins) that add up to ``bins``."""
    return [c for d in range(1, depth + 1) for c in combinations_with_replacement(range(1, bins + 1), d) if sum(c) == bins]


@dataclass
class Plan:
    """repeats[i] sequences of combos[i]; places[b]: (first rank, past the last, first sequence, uses) in bin b."""

    combos: list[tuple[int, ...]]
    repeats: list[int]
    places: dict[int, list[tuple[int, int, int, int]]]

    @property
    def sequences(self) -> int:
        return sum(self.repeats)


def make_plan(counts: np.ndarray, tokens: np.ndarray, window: int, depth: int) -> Plan:
    """counts and tokens of the rests in bins 1 to len(counts)."""
    bins, width = len(counts), window // len(counts)
    combos = patterns(bins, depth)
    a = np.zeros((bins, len(combos)))
    for i, c in enumerate(combos):
        for b in c:
            a[b - 1, i] += 1
    scale = max(1.0, float(counts.max(initial=0)))
    x = np.floor(nonnegative_least_squares(a, counts / scale) * scale + 1e-6).astype(np.int64)
    left = counts.astype(np.int64).copy()
    for i in np.argsort(-x, kind="stable"):
        use = a[:, i].astype(np.int64)
        x[i] = min(x[i], int((left[use > 0] // use[use > 0]).min()))
        left -= use * x[i]
    for i, c in sorted(enumerate(combos), key=lambda e: (len(e[1]), e[0])):  # greedily, what rounding left
        use = a[:, i].astype(np.int64)
        more = int((left[use > 0] // use[use > 0]).min())
        x[i] += more
        left -= use * more
    # the patterns' gaps need as many tokens outside the patterns: give up repeats until there are enough
    mean = np.divide(tokens, counts, out=np.zeros(bins), where=counts > 0)
    gap = np.array([sum(width * b - mean[b - 1] for b in c) for c in combos])
    gaps, spare = float(gap @ x), float(mean @ left)
    if gaps > spare and x.sum():
        share = min(1.0, 1.02 * (gaps - spare) / max(1.0, window * float(x.sum())))
        x = np.maximum(0, x - np.ceil(x * share).astype(np.int64))
    places: dict[int, list] = {}
    used, first = np.zeros(bins + 1, np.int64), 0
    for c, n in zip(combos, x.tolist(), strict=True):
        for b in dict.fromkeys(c):
            m = c.count(b)
            if n:
                places.setdefault(b, []).append((int(used[b]), int(used[b]) + n * m, first, m))
                used[b] += n * m
        first += n
    return Plan(combos, x.tolist(), places)


def tail_sizes(tokens: int) -> list[int]:
    """Powers of two that add up to the tokens of the last, unfilled sequence."""
    return [1 << k for k in reversed(range(tokens.bit_length())) if tokens >> k & 1]


def _match(gaps: pd.DataFrame, rests: pd.DataFrame, cell: int, gap_total: int, rest_total: int, base: int, window: int) -> pd.DataFrame:
    """Pieces of the rests' stream within one cell: cut where a gap, a sequence or a rest ends."""
    lo, hi = cell * CELL, min((cell + 1) * CELL, rest_total)
    rests, gaps = rests.sort_values("at"), gaps.sort_values("at")
    over = max(0, rest_total - gap_total)
    whole = over // window
    tail = np.cumsum([0, *tail_sizes(over - whole * window)])
    starts = np.arange(max(0, (lo - gap_total) // window), max(0, (hi - gap_total) // window) + 1) * window
    marks = np.concatenate([gaps["at"], gaps["at"] + gaps["size"], rests["at"], rests["at"] + rests["size"], starts + gap_total, tail + gap_total + whole * window, [lo, hi, gap_total]]).astype(np.int64)
    marks = np.unique(marks[(marks >= lo) & (marks <= hi)])
    at, size = marks[:-1], np.diff(marks)
    r = np.searchsorted(rests["at"].to_numpy(), at, "right") - 1
    in_gap = at < gap_total
    g = np.searchsorted(gaps["at"].to_numpy(), at, "right") - 1
    past = at - gap_total
    k = np.searchsorted(tail, past - whole * window, "right") - 1
    seq = np.where(past < whole * window, base + past // window, base + whole + k)
    off = np.where(past < whole * window, past % window, past - whole * window - tail[np.clip(k, 0, None)])
    if len(gaps):
        seq = np.where(in_gap, gaps["seq"].to_numpy()[g], seq)
        off = np.where(in_gap, at - gaps["at"].to_numpy()[g] + gaps["off"].to_numpy()[g], off)
    return pd.DataFrame({"rid": rests["rid"].to_numpy()[r], "start": at - rests["at"].to_numpy()[r] + rests["from"].to_numpy()[r], "length": size, "sequence_id": seq, "offset": off})


def _cells(df: DataFrame, extra: list[str]) -> DataFrame:
    """Intervals (at, size) cut at the cells' edges; the columns ``extra`` advance with the cut."""
    cut = df.withColumn("cell", F.explode(F.sequence(F.expr(f"at div {CELL}"), F.expr(f"(at + size - 1) div {CELL}"))))
    cut = cut.withColumn("lo", F.greatest("at", F.col("cell") * CELL)).withColumn("hi", F.least(F.col("at") + F.col("size"), (F.col("cell") + 1) * CELL))
    return cut.withColumns({c: F.col(c) + F.col("lo") - F.col("at") for c in extra}).withColumn("size", F.col("hi") - F.col("lo")).withColumn("at", F.col("lo")).drop("lo", "hi")


def plan_pieces(scratch: Scratch, lengths: DataFrame, window: int = 4096, bins: int = 64, depth: int = 3) -> DataFrame:
    """(rid, n) of each document -> (rid, start, length, sequence_id, offset) of each piece."""
    spark, width = scratch.spark, window // bins
    cut = lengths.select("rid", F.expr(f"n div {window}").alias("q"), F.expr(f"n % {window}").cast("long").alias("r"))
    cut = cut.withColumn("bin", F.expr(f"(r + {width - 1}) div {width}")).withColumn("one", F.lit(1).cast("long"))
    ranked = scratch.table(running_sum(scratch, cut, "binned", ["rid"], {"rank": "one"}, per="bin", whole={"whole": "q"}), "ranked")
    scratch.drop("binned")
    rows = ranked.groupBy("bin").agg(F.count("*").alias("n"), F.sum("r").alias("t")).collect()  # a row per bin
    counts, tokens = np.zeros(bins), np.zeros(bins)
    for row in rows:
        if row["bin"]:
            counts[row["bin"] - 1], tokens[row["bin"] - 1] = row["n"], row["t"]
    plan = make_plan(counts, tokens, window, depth)
    places = {b: np.array(v, np.int64) for b, v in plan.places.items()}

    @F.pandas_udf("long")
    def sequence_of(bin_: pd.Series, rank: pd.Series) -> pd.Series:
        """The pattern sequence that a rest belongs to; -1: none."""
        out = np.full(len(rank), -1, np.int64)
        b, k = bin_.to_numpy(), rank.to_numpy()
        for one in np.unique(b):
            if (p := places.get(int(one))) is not None:
                mine = np.flatnonzero((b == one) & (k < p[-1, 1]))
                at = np.searchsorted(p[:, 0], k[mine], "right") - 1
                out[mine] = p[at, 2] + (k[mine] - p[at, 0]) // p[at, 3]
        return pd.Series(out)

    rests = scratch.table(ranked.where("r > 0").withColumn("seq", sequence_of("bin", "rank")), "rests")
    full = ranked.where("q > 0").select("rid", "whole", F.posexplode(F.sequence(F.lit(0).cast("long"), F.col("q") - 1)).alias("i", "_"))
    in_seq = Window.partitionBy("seq").orderBy(F.desc("r"), "rid")
    placed = rests.where("seq >= 0").withColumn("offset", F.coalesce(F.sum("r").over(in_seq.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    gaps = rests.where("seq >= 0").groupBy("seq").agg(F.sum("r").alias("off")).withColumn("size", window - F.col("off")).where("size > 0")
    gaps = scratch.table(running_sum(scratch, gaps, "gaps0", ["seq"], {"at": "size"}), "gaps")
    loose = rests.where("seq < 0").select("rid", F.col("r").alias("size"), (F.col("q") * window).alias("from"))
    loose = scratch.table(running_sum(scratch, loose, "loose0", ["rid"], {"at": "size"}), "loose")
    gap_total, rest_total = (f.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0] for f in (gaps, loose))
    base = plan.sequences

    def match(key, g, r):
        return _match(g, r, int(key[0]), gap_total, rest_total, base, window)

    cut_gaps = _cells(gaps.where(F.col("at") < rest_total).withColumn("size", F.least("size", rest_total - F.col("at"))), ["off"])
    streamed = cut_gaps.groupBy("cell").cogroup(_cells(loose, ["from"]).groupBy("cell")).applyInPandas(match, "rid long, start long, length long, sequence_id long, offset long")
    after = base + max(0, rest_total - gap_total) // window + window.bit_length()
    return full.select("rid", (F.col("i") * window).cast("long").alias("start"), F.lit(window).cast("long").alias("length"), (F.col("whole") + F.col("i") + after).alias("sequence_id"), F.lit(0).cast("long").alias("offset")).unionByName(
        placed.select("rid", (F.col("q") * window).alias("start"), F.col("r").alias("length"), F.col("seq").alias("sequence_id"), "offset")
    ).unionByName(streamed)


def pack(spark: SparkSession, docs: DataFrame, tokenizer: str, end_id: int = 2, window: int = 4096, bins: int = 64, depth: int = 3) -> DataFrame:
    """(doc_id, start, length, sequence_id, offset, doc_tokens, ids) of each piece; ids are little-endian unsigned 32 bits.

    Every row is a document, also if its doc_id is null or repeats. A null or empty text has the end id alone.
    An empty table gives no piece. Columns other than doc_id and text are ignored.
    """
    scratch = Scratch(spark, "packing")

    def encode(batches):
        from pyspark import TaskContext

        rid, tokens = TaskContext.get().partitionId() << 40, encoder(tokenizer)
        for some in sized(batches, 1, ENCODE_BYTES):
            ids, at = tokens.encode(some.column(1), end_id)
            n, ends = some.num_rows, at.tolist()
            small = len(ids) and ids.max() < 65536
            wide = ids.astype("<u2" if small else "<u4")
            packed = [wide[a:b].tobytes() + (b"\2" if small else b"\4") for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(range(rid, rid + n), pa.int64()), some.column(0).cast(pa.int64()), pa.array(np.diff(at)), pa.array(packed, pa.binary())], ["rid", "doc_id", "n", "packed"])
            rid += n

    tokens = scratch.table(docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8("text").alias("text")).mapInArrow(encode, "rid long, doc_id long, n long, packed binary"), "tokens")
    pieces = plan_pieces(scratch, tokens.select("rid", "n"), window, bins, depth)
    grouped = pieces.groupBy("rid").agg(F.collect_list(F.struct("start", "length", "sequence_id", "offset")).alias("pieces"))

    def cut(batches):
        for batch in sized(batches, 2, ENCODE_BYTES):
            for at in range(0, batch.num_rows, 256):
                out = []
                for row in batch.slice(at, 256).to_pylist():
                    width = row["packed"][-1]
                    for p in row["pieces"]:
                        part = row["packed"][p["start"] * width : (p["start"] + p["length"]) * width]
                        out.append((row["doc_id"], p["start"], p["length"], part if width == 4 else np.frombuffer(part, "<u2").astype("<u4").tobytes(), row["n"], p["sequence_id"], p["offset"]))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

    return tokens.join(grouped, "rid").select("doc_id", "n", "packed", "pieces").mapInArrow(cut, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def packed_digest(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The contract's columns for op10 and the last stage of the pipeline."""
    import public_tokenizers

    pieces = pack(spark, docs, public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 4096 tokens."""
    return packed_digest(spark, table(spark, sf_dir, "documents"))
