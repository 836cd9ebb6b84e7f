"""Quality classifier by co-training of two views.

The text view sees hashed character n-grams of the text; the page view sees the page's metadata alone: its source, its
language, its recorded length, and pairs of these. Each is a sparse logistic regression, calibrated by a temperature. Over
several rounds each view scores all documents without a label, labels those that it is surest of, good and bad in the
ratio of the labels, and hands them to the other view's training set: as many as the square root of the documents'
number, as long as it is confident of them. Both are calibrated on labelled rows that neither has seen, and the
calibrated log-odds are added to those of the labels.

Fitting takes a bounded sample of labelled rows (``labelled``, a documented parameter); the search for documents to label
and the scores cover every whole document. Rows to train on become features where they lie; one task trains on these.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass
from functools import reduce
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from .common import Scratch, sized, table, trim_memory
from .langid import bounded_sample, label_sizes
from .linear import Linear, counts, row_logits, temperature, train

META_BITS, TEXT_BITS = 14, 18
#: Bytes of text that a task scores at once.
TEXT_BYTES = 2 << 20
META = ("lang", "source", "n_chars")


def page_features(lang: str | None, source: str | None, n_chars: int | None) -> np.ndarray:
    """Hashed indicator features of a page's metadata; a null is a value of its own."""
    import xxhash

    size = None if n_chars is None else int(np.log2(max(n_chars, 0) + 1) * 3)
    values = {"source": source, "lang": lang, "size": size, "source+lang": (source, lang), "source+size": (source, size), "lang+size": (lang, size)}
    return np.unique(np.array([xxhash.xxh32_intdigest(f"{k}={v}") & ((1 << META_BITS) - 1) for k, v in values.items()], np.int64))


@dataclass
class CoTrained:
    text: Linear
    page: Linear
    prior: float  # log-odds of good quality among all labels, sampled or not; either view is trained on balanced classes
    pseudo: int = 0  # labels that the views gave each other

    def text_odds(self, texts: list[str | None]) -> np.ndarray:
        """Calibrated log-odds of good quality, classes in balance."""
        return self.text.text_odds([t or "" for t in texts], "all") / self.text.temperature

    def page_odds(self, rows: list[np.ndarray]) -> np.ndarray:
        z = row_logits(self.page, [(f, np.ones(len(f))) for f in rows])
        return (z[:, 1] - z[:, 0]) / self.page.temperature


def co_train(text: list, page: list, y: np.ndarray, views: list[str | None], good: float) -> CoTrained:
    """text: (features, counts), page: features; y: labels; views: None for labelled rows, or the view that a pseudo-label
    is given to; good: share of good quality among all labels. Every fourth labelled row is left for calibration."""
    own = [i for i, v in enumerate(views) if v is None]
    held = np.arange(len(own)) % 4 == 3
    if len(set(y[own][~held].tolist())) < 2 or not held.any():
        held[:] = False
    at = [i for i, h in zip(own, held, strict=True) if h]
    base = [i for i, h in zip(own, held, strict=True) if not h]
    ones = [(f, np.ones(len(f), np.int64)) for f in page]

    def fitted(view: str) -> Linear:
        x, setting = (text, {"bits": TEXT_BITS}) if view == "text" else (ones, {"bits": META_BITS, "scale": 12.0, "shrink": 0.0})
        rows = base + [i for i, v in enumerate(views) if v == view]
        share = np.bincount(y[rows], minlength=2) / len(rows)
        model = train([x[i] for i in rows], y[rows], 2, weight=0.5 / np.maximum(share[y[rows]], 1e-9), **setting)
        model.temperature = temperature(row_logits(model, [x[i] for i in at]), y[at])
        return model

    share = float(np.clip(good, 0.01, 0.99))
    return CoTrained(fitted("text"), fitted("page"), float(np.log(share / (1 - share))), len(views) - len(own))


def mapped(docs: DataFrame, keep: list[str], text: str | None, out: str, make) -> DataFrame:
    """The columns ``keep`` of docs and, as columns ``out`` ("name type, ..."), what make(batch) has for its rows. Batches
    are bounded by the bytes of the column ``text``."""
    place, named = [docs.columns.index(c) for c in keep], [*keep, *(c.split()[0] for c in out.split(", "))]
    column = docs.columns.index(text) if text else None

    def run(batches):
        steps = batches if column is None else sized(batches, column, TEXT_BYTES)
        for some in steps:
            yield pa.RecordBatch.from_arrays([*(some.column(i) for i in place), *make(some)], named)

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    return docs.mapInArrow(run, ", ".join([*(f"{c} {kinds[c]}" for c in keep), out]))


def with_features(rows: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` and the features of both views: feature, count, page."""
    at = {c: rows.columns.index(c) for c in ("text", *META)}

    def make(batch):
        found = counts([t or "" for t in batch.column(at["text"]).to_pylist()], "all", TEXT_BITS)
        page = [page_features(*x) for x in zip(*(batch.column(at[c]).to_pylist() for c in META), strict=True)]
        return [*(pa.array([x[i] for x in found], pa.list_(pa.int32())) for i in (0, 1)), pa.array([x.astype(np.int32) for x in page], pa.list_(pa.int32()))]

    return mapped(rows, keep, "text", "feature array<int>, count array<int>, page array<int>", make)


def fit_once(rows: DataFrame, good: float) -> CoTrained | None:
    """Fit on rows (doc_id, key, place, label, view, feature, count, page): labelled ones have no view. By one task; the
    driver gets the weights alone."""

    def run(frames):
        import pandas as pd

        held = [f for f in frames if len(f)]
        if not held:
            return
        pdf = pd.concat(held).sort_values(["place", "doc_id", "key"], kind="stable")
        y, views = pdf["label"].to_numpy(int), [None if pd.isna(v) else v for v in pdf["view"]]
        if len(set(y[[v is None for v in views]].tolist())) == 2:
            text = [(np.asarray(f, np.int32), np.asarray(c, np.int32)) for f, c in zip(pdf["feature"], pdf["count"], strict=True)]
            page = [np.asarray(f, np.int64) for f in pdf["page"]]
            yield pd.DataFrame({"model": [pickle.dumps(co_train(text, page, y, views, good))]})
        trim_memory()

    found = rows.repartition(1).mapInPandas(run, "model binary").collect()
    return pickle.loads(found[0][0]) if found else None


def views(page: DataFrame, pool: DataFrame, model: CoTrained) -> DataFrame:
    """(key, text, page): calibrated log-odds of each key of pool (key, page) from either view; texts come from page."""
    gain = (model.page.weights.astype(np.float64) @ [-1.0, 1.0])[model.page.row]
    bias, shrink, warmth = model.page.bias[1] - model.page.bias[0], model.page.shrink, model.page.temperature

    def by_page(batch):
        lists = batch.column(1)
        size = np.diff(lists.offsets.to_numpy())
        sums = np.bincount(np.repeat(np.arange(len(size)), size), gain[lists.flatten().to_numpy()], len(size))
        return [pa.array((sums / np.maximum(size + shrink, 1) + bias) / warmth)]

    def by_text(batch):
        return [pa.array(model.text_odds(batch.column(1).to_pylist()))]

    text = mapped(page.select("key", "text"), ["key"], "text", "text double", by_text).groupBy("key").agg(F.min("text").alias("text"))
    seen = mapped(pool.select("key", F.col("page").alias("features")), ["key"], None, "page double", by_page)
    return seen.join(text, "key").select("key", "text", "page")


def surest(scored: DataFrame, taken: DataFrame, n_bad: int, n_good: int, confident: float = 0.0) -> dict[str, list[tuple[int, int]]]:
    """For each view, what it hands to the other: the (key, label) of the bad and the good ones that it is surest of, among all rows
    (key, text, page) of scored without those in taken (key) whose log-odds are beyond ``confident``. What the text view
    takes the page view can't. taken, and what comes to the driver, grow with the square root of the documents."""
    free = scored.join(F.broadcast(taken), "key", "left_anti")
    parts = []
    for view, more in (("text", 0), ("page", n_bad + n_good)):
        for label, n, order in ((0, n_bad, F.col(view)), (1, n_good, -F.col(view))):
            top = free.where(order < -confident).select("key", F.lit(view).alias("view"), F.lit(label).alias("label"), order.alias("place"))
            parts.append(top.orderBy("place", "key").limit(n + more))
    found = sorted(reduce(DataFrame.unionByName, parts).collect(), key=lambda r: (r.view == "page", r.label, r.place, r.key))
    out: dict[str, list[tuple[int, int]]] = {"text": [], "page": []}
    used: set[int] = set()
    left = {(v, c): n for v in out for c, n in ((0, n_bad), (1, n_good))}
    for r in found:
        if r.key not in used and left[r.view, r.label]:
            left[r.view, r.label] -= 1
            used.add(r.key)
            out["page" if r.view == "text" else "text"].append((r.key, r.label))
    return out


def fit(docs: DataFrame, labels: DataFrame, labelled: int = 2000, rounds: int = 4, per_round: int = 40, confident: float = 2.0) -> CoTrained | None:
    """Fit on at most ``labelled`` rows of labels (doc_id, quality), as many good as bad while they last, and on what
    the views hand to each other. In each round either view scores all documents without a label, equal ones as one,
    and hands over as many as the square root of their number, at least ``per_round``, as long as its calibrated log-odds
    are ``confident`` or more. Several labels of an id: the least counts. None without labels of both kinds. A missing
    column among lang, source and n_chars counts as null; other columns are ignored."""
    one = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(F.expr("cast(quality > 0 as int)")).alias("quality"))
    sizes = label_sizes(one, "quality", 2)
    good = sizes.get(1, 0) / max(sum(sizes.values()), 1)  # of the sample it would move with the number of labels
    if len(sizes) < 2:
        return None
    scratch = Scratch(docs.sparkSession, "quality")
    known = bounded_sample(one, "quality", labelled, ["doc_id"]).select("doc_id", F.col("quality").alias("label"))
    kinds = {"text": "string", "lang": "string", "source": "string", "n_chars": "long"}
    columns = [(F.col(c).cast(t) if c in docs.columns else F.lit(None).cast(t)).alias(c) for c, t in kinds.items()]
    page = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *columns).withColumn("key", F.xxhash64(*[x for c in kinds for x in (F.col(c), F.col(c).isNull())]))
    kept = ["doc_id", "key", "place", "label", "view"]
    # at most ``labelled`` ids are broadcast; by content too, so that an id or a text that repeats can't fill the sample
    own = page.join(F.broadcast(known), "doc_id").dropDuplicates(["doc_id", "key"])
    place = F.xxhash64("doc_id", "key")
    own = own.withColumns({"place": place, "view": F.lit(None).cast("string"), "_nth": F.row_number().over(Window.partitionBy("doc_id").orderBy(place, "key"))}).where("_nth <= 2")
    rows = scratch.table(with_features(own.drop("_nth"), kept), "rows0")
    model = fit_once(rows, good)
    if model is None:
        return None

    def features(batch):
        found = [page_features(*x) for x in zip(*(batch.column(i).to_pylist() for i in range(1, 4)), strict=True)]
        return [pa.array([x.astype(np.int16) for x in found], pa.list_(pa.int16()))]

    # the content of all documents without a label, and what the page view sees of it
    free = page.select("doc_id", "key", *META).join(one.select("doc_id"), "doc_id", "left_anti").groupBy("key").agg(*[F.min(c).alias(c) for c in META])
    pool = scratch.table(mapped(free, ["key"], None, "page array<short>", features), "pool")
    n = pool.count()
    more = max(per_round, isqrt(n))
    n_bad = min(max(1, round(more * (1 - good))), more - 1)
    taken: list[tuple[int]] = []
    spark = docs.sparkSession
    for k in range(1, rounds + 1):
        chosen = surest(scratch.table(views(page, pool, model), f"scored{k}"), spark.createDataFrame(taken, "key long"), n_bad, more - n_bad, confident)
        scratch.drop(f"scored{k}")
        new = [(key, label, view) for view, found in chosen.items() for key, label in found]
        if not new:
            break
        taken += [(key,) for key, *_ in new]
        given = page.join(F.broadcast(spark.createDataFrame(new, "key long, label int, view string")), "key").dropDuplicates(["key"])
        given = given.withColumns({"doc_id": F.lit(0).cast("long"), "place": F.lit(k).cast("long")})
        rows = rows.unionByName(scratch.table(with_features(given, kept), f"rows{k}"))
        model = fit_once(rows, good)
    scratch.drop("pool", *[f"rows{k}" for k in range(rounds + 1)])
    return model


def score(docs: DataFrame, model: CoTrained | None) -> DataFrame:
    """All columns of docs, and text_score, page_score, quality_score: probabilities of good quality.

    Null text counts as empty. Without a model the scores are null. Columns of docs named like a result are replaced.
    """
    added = ["text_score", "page_score", "quality_score"]
    docs = docs.drop(*added)
    schema = StructType(list(docs.schema.fields))
    for c in added:
        schema = schema.add(c, "double")
    place = {c: docs.columns.index(c) for c in ("text", *META) if c in docs.columns}

    def run(batches):
        for some in sized(batches, place["text"], TEXT_BYTES) if "text" in place else batches:
            n = some.num_rows
            if model is None:
                cols = [pa.nulls(n, pa.float64())] * 3
            else:
                get = lambda c: some.column(place[c]).to_pylist() if c in place else [None] * n  # noqa: E731, B023
                a = model.text_odds(get("text"))
                b = model.page_odds([page_features(*x) for x in zip(*map(get, META), strict=True)])
                cols = [pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500)))) for z in (a, b, a + b + model.prior)]
            yield pa.RecordBatch.from_arrays([*some.columns, *cols], [*some.schema.names, *added])

    return docs.mapInArrow(run, schema)


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """The documents that the classifier doesn't reject: quality_score of at least ``least``, or no score."""
    return score(docs, fit(docs, labels)).where(F.col("quality_score").isNull() | (F.col("quality_score") >= least)).select(*docs.columns)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents and whether each is kept."""
    docs = table(spark, sf_dir, "documents")
    scored = score(docs.select("doc_id", "text", *META), fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", "text_score", "page_score", "quality_score", (F.col("quality_score") >= 0.5).alias("kept"))
