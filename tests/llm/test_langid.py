"""op7: the sample that it fits on, odd rows, and accuracy on held-out documents."""

import random
import zlib
from collections import Counter

import pytest

from siltstone.llm import langid


def test_copies_count_once_and_no_label_pays_for_another(spark):
    rows = [(f"common {i}", "en", 0) for i in range(2000)] + [(f"rare {i}", "de", 0) for i in range(60)]
    copies = [(f"copied {k}", "en", 0) for k in range(40) for _ in range(300)]
    known = spark.createDataFrame(rows + copies, "text string, lang string, fold int")
    got = langid.bounded_sample(known, "lang", 120, ["text", "lang", "fold"]).collect()
    assert max(Counter(r.text for r in got).values()) == 1
    sizes = Counter(r.lang for r in got)
    assert sizes["de"] == 60 and 40 <= sizes["en"] <= 60


def test_too_many_labels_are_refused(spark):
    known = spark.createDataFrame([(f"text {i}", f"l{i}", 0) for i in range(20)], "text string, lang string, fold int")
    with pytest.raises(ValueError):
        langid.bounded_sample(known, "lang", 10, ["text"])
    assert langid.bounded_sample(known.limit(0), "lang", 10, ["text"]).count() == 0


def test_held_out_accuracy_and_calibration(spark):
    """Languages that share an alphabet and differ in their syllables; a fourth of the documents is held out."""
    rnd = random.Random(12)
    parts = {k: [a + b for a in first for b in "aeiou"] for k, first in {"x": "bdfglm", "y": "lmnprs", "z": "prstvb"}.items()}
    rows = []
    for i in range(900):
        lang = rnd.choice("xxxxyz")
        rows.append((i, " ".join("".join(rnd.choices(parts[lang], k=rnd.randint(1, 3))) for _ in range(rnd.randint(2, 25))), lang))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.predict(docs, langid.fit(docs)).collect()}
    held = [(got[i], lang) for i, _, lang in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    right = [r.lang_pred == lang for r, lang in held]
    assert len(held) > 150 and all(r.held_out for r, _ in held) and sum(right) / len(held) > 0.95
    assert abs(sum(r.score for r, _ in held) / len(held) - sum(right) / len(held)) < 0.05


def test_ties_repeats_and_clashing_names(spark):
    rows = [(i, "aa bb", "p" if i % 2 else "q") for i in range(40)]  # the same text in two languages
    odd = [(100, None, None), (101, " 12!", "p"), (None, "aa", "q"), (None, "aa", "q"), (102, "a" * 400_000, None)]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string").selectExpr("*", "1 as draw", "'x' as score", "2 as fold")
    model = langid.fit(docs)
    got = langid.predict(docs, model).collect()
    assert len(got) == 45 and got == langid.predict(docs, langid.fit(docs)).collect()
    assert sorted(r.lang_pred for r in got if r.doc_id in (100, 101)) == ["und"] * 2 and sum(r.doc_id is None for r in got) == 2
    assert len({(r.lang_pred, r.score) for r in got if r.doc_id is not None and r.doc_id < 40}) == 1
    assert langid.predict(docs.limit(0), model).count() == 0
