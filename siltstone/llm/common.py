"""Helpers shared by the training-data operators: the shared scratch folder, tables that cut lineage,
a distributed running sum, and file access for executors."""

from __future__ import annotations

import ctypes
import gc
import threading
import time
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltstone.sources.scratch import Scratch

#: White space between words, as the contracts define it.
SPACE = r"[\x20\x09-\x0D]+"
#: Bytes of text that a task tokenizes at once.
ENCODE_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(name: str) -> Column:
    """A text column with null read as the empty text."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def trim_memory() -> None:
    """Give freed memory back to the system, that of Arrow's pool included."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


#: Parameters of glibc's mallopt (fixed values): arenas, and the size from which freed memory goes back at once.
M_ARENA_MAX, M_MMAP_THRESHOLD = -8, -3


@cache
def be_frugal() -> None:
    """Once for a Python worker: few arenas and threads, and large arrays that go back to the system when they are freed, as
    an executor's workers share its memory with the JVM."""
    mallopt = getattr(ctypes.CDLL(None), "mallopt", None)
    if mallopt is not None:
        mallopt(M_ARENA_MAX, 2)
        mallopt(M_MMAP_THRESHOLD, 1 << 21)
    pa.set_cpu_count(1)


def sized(batches, column: int, limit: int):
    """The rows of record batches in their order, as batches whose ``column`` (text or binary) has at most ``limit`` bytes,
    or one row. Small batches are joined, so that the size of Spark's batches doesn't matter."""
    be_frugal()
    held, size = [], 0

    def joined():
        return held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = int(ends[at - 1]) if at else 0
            stop = int(np.searchsorted(ends, before + limit - size, "right"))
            if stop <= at and held:
                yield joined()
                held, size = [], 0
                continue
            stop = max(stop, at + 1)
            held.append(batch.slice(at, stop - at))
            size += int(ends[stop - 1]) - before
            at = stop
    if held:
        yield joined()
    held = batch = ends = None
    trim_memory()


_STATE: dict = {}
_USED = [0.0]
#: Seconds after which a worker that no task asks for its state gives it up.
IDLE = 15


def _forget_when_idle() -> None:
    while time.monotonic() - _USED[0] < IDLE:
        time.sleep(1)
    _STATE.clear()
    trim_memory()


def worker_state(name: str, make):
    """What a Python worker keeps from task to task: one thing at a time, so that an operator's caches go when the
    worker turns to another operator, and nothing once it is idle."""
    _USED[0] = time.monotonic()
    found = _STATE.get(name)
    if found is None:
        if _STATE:
            _STATE.clear()
            trim_memory()
        found = _STATE[name] = make()
        threading.Thread(target=_forget_when_idle, daemon=True).start()
    return found


def filesystem(uri: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system of a shared folder and the path in it, for code on executors."""
    import pyarrow.fs as pafs

    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def running_sum(scratch: Scratch, df: DataFrame, name: str, order: list, values: dict[str, str], per: str | None = None, whole: dict[str, str] | None = None) -> DataFrame:
    """Add, for each ``out: column``, the sum of the column over the rows before this one.

    ``order`` is a total order (ties must be equal rows). Sums of ``values`` restart for each value of the column
    ``per``, those of ``whole`` don't. No task ever holds more than one range of rows, however large a ``per``
    group is: rows are range-partitioned by (per, order), summed within each range, and shifted by the sums of the
    ranges before it. Those range sums are one row per range and group, so the last step is small.
    """
    whole = whole or {}
    keys = [F.col(per).asc_nulls_last()] if per else []
    cols = [o if isinstance(o, Column) else F.col(o) for o in order]
    ranged = scratch.table(df.repartitionByRange(*keys, *cols).withColumn("_range", F.spark_partition_id()), name)
    out = ranged
    for k, (group, sums) in enumerate(((per, values), (None, whole))):
        if not sums:
            continue
        by = ["_range", *([group] if group else [])]
        within = Window.partitionBy(*by).orderBy(*([] if group else keys), *cols).rowsBetween(Window.unboundedPreceding, -1)
        before = (Window.partitionBy(group) if group else Window.partitionBy()).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
        shifts = ranged.groupBy(*by).agg(*[F.sum(c).alias(f"_of_{o}") for o, c in sums.items()])
        shifts = shifts.select(*[F.col(g).alias(f"_at{k}_{g}") for g in by], *[F.coalesce(F.sum(f"_of_{o}").over(before), F.lit(0)).alias(f"_base_{o}") for o in sums])
        out = out.withColumns({f"_in_{o}": F.coalesce(F.sum(c).over(within), F.lit(0)) for o, c in sums.items()})
        out = out.join(shifts, [F.col(g).eqNullSafe(F.col(f"_at{k}_{g}")) for g in by])
    out = out.withColumns({o: F.col(f"_in_{o}") + F.col(f"_base_{o}") for o in (*values, *whole)})
    return out.select(*df.columns, *values, *whole)
