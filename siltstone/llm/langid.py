"""Language identification: sparse multinomial logistic regression on TF-IDF of character n-grams.

Fitting takes a bounded sample of labelled rows (``sample``, spread evenly over the languages by a hash of the row),
of which a part calibrates the temperature; predicting reads every whole text and nothing but the text. The rows of the
sample become n-gram counts where they lie, one task trains on these, and the driver gets the weights.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from .common import sized, table, trim_memory, utf8
from .linear import Linear, counts, row_logits, temperature, train

UNKNOWN = "und"


def fold(name: str):
    """crc32 of the id as text, modulo 4; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(name).cast("string"), F.lit(""))) % 4


def label_sizes(rows: DataFrame, label: str, most: int) -> dict:
    """Rows of each label, of which there may be ``most``: a sample of so many rows can't hold more."""
    found = rows.groupBy(label).count().limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} different values of {label}: too many to learn from {most} rows")
    return {r[0]: r[1] for r in found}


def bounded_sample(rows: DataFrame, label: str, sample: int, tie: list[str]) -> DataFrame:
    """At most ``sample`` rows, about as many of each label, and their _draw. Rows equal in ``tie`` are one; the others are
    drawn by a 64-bit hash of it, so that reruns agree. An excess is cut within its label."""
    drawn = rows.withColumn("_draw", F.xxhash64(*tie))
    sizes = label_sizes(drawn.select(label, "_draw").distinct(), label, sample)
    if not sizes:
        return drawn.limit(0)
    each = max(1, sample // len(sizes))
    kind = rows.schema[label].dataType
    chance = rows.sparkSession.createDataFrame([(v, min(1.0, 1.2 * each / n)) for v, n in sizes.items()], StructType().add(label, kind).add("_chance", "double"))
    share = F.shiftrightunsigned("_draw", 11).cast("double") * F.lit(2.0**-53)
    # a row for each of at most ``sample`` labels
    drawn = drawn.join(F.broadcast(chance), label).where(share < F.col("_chance")).drop("_chance").dropDuplicates([label, "_draw"])
    place = F.row_number().over(Window.partitionBy(label).orderBy(F.shiftrightunsigned("_draw", 11), "_draw"))
    return drawn.withColumn("_place", place).where(F.col("_place") <= each).drop("_place").select(*rows.columns, "_draw")


def fit(docs: DataFrame, sample: int = 3000, bits: int = 18) -> tuple[Linear, list[str]] | None:
    """Learn from text and non-null lang of the rows outside the held-out fold (remainder 2); remainder 3 calibrates.
    None if no such row has a letter."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("text", F.col("lang").cast("string").alias("lang"), fold("doc_id").alias("fold")).where("fold <> 2")
    picked = bounded_sample(known, "lang", sample, ["text", "lang", "fold"])

    def count(batches):
        for some in sized(batches, 0, 4 << 20):
            found = counts(some.column(0).to_pylist(), "letters", bits)
            yield pa.RecordBatch.from_arrays([*some.columns[1:], *[pa.array([x[i] for x in found], pa.list_(pa.int32())) for i in (0, 1)]], ["lang", "fold", "draw", "feature", "count"])

    def learn(frames):
        import pandas as pd

        held = [f for f in frames if len(f)]
        if not held:
            return
        pdf = pd.concat(held).sort_values(["draw", "lang"], kind="stable")
        langs = sorted(set(pdf["lang"]))
        y = np.array([langs.index(x) for x in pdf["lang"]])
        x = [(np.asarray(f, np.int32), np.asarray(c, np.int32)) for f, c in zip(pdf["feature"], pdf["count"], strict=True)]
        held = (pdf["fold"] == 3).to_numpy()
        if held.all() or not held.any() or len(set(y[~held].tolist())) < len(langs):
            held[:] = False
        model = train([x[i] for i in np.flatnonzero(~held)], y[~held], len(langs), bits)
        at = np.flatnonzero(held)
        model.temperature = temperature(row_logits(model, [x[i] for i in at]), y[at])
        yield pd.DataFrame({"model": [pickle.dumps((model, langs))]})
        del pdf, x
        trim_memory()

    rows = picked.select("text", "lang", "fold", F.col("_draw").alias("draw")).mapInArrow(count, "lang string, fold long, draw long, feature array<int>, count array<int>")
    found = rows.repartition(1).mapInPandas(learn, "model binary").collect()
    return pickle.loads(found[0][0]) if found else None


def predict(docs: DataFrame, fitted: tuple[Linear, list[str]] | None) -> DataFrame:
    """doc_id -> (doc_id, held_out, lang_pred, score): every row. ``und`` with score 0 for a text that is null or has
    no letter, or if nothing was learned; a text's languages that tie go to the first by code point. All columns of docs
    but doc_id and text are ignored, lang and source among them."""

    def run(batches):
        for some in sized(batches, 2, 1 << 20):
            texts = some.column(2).to_pylist()
            has = np.array([any(map(str.isalpha, t)) for t in texts], bool)
            lang, score = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
            if fitted is not None and has.any():
                model, langs = fitted
                p = model.share(model.text_logits([t for t, h in zip(texts, has, strict=True) if h], "letters"))
                lang[has], score[has] = np.array(langs, object)[p.argmax(1)], p.max(1)
            yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(lang.tolist(), pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold("doc_id") == 2).alias("held_out"), utf8("text").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return predict(docs, fit(docs))
