"""The fit of op9 on tables of different sizes."""

import inspect
import math
import random

from siltstone.llm import quality


def tables(spark, n, bad=5, seed=3):
    """n documents, each ``bad``th of them bad, and labels of the first half."""
    rnd = random.Random(seed)
    words = ["".join(rnd.choices("abcdefgh", k=5)) for _ in range(200)]
    # either view can tell: the text by marks, the page by its source
    rows = [(i, " ".join(rnd.choices(words, k=30)) + (" ### $$$" * 20 if i % bad == 0 else ""), "en", "s" if i % bad else "b", 10) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return docs, spark.createDataFrame([(i, int(i % bad != 0)) for i in range(n // 2)], "doc_id long, quality int")


def test_prior_is_that_of_all_labels(spark):
    want = math.log(0.8 / 0.2)
    for n, labelled in ((200, 2000), (800, 2000), (800, 100)):
        docs, labels = tables(spark, n)
        assert abs(quality.fit(docs, labels, labelled=labelled).prior - want) < 1e-9


def test_sample_is_as_large_as_before_the_cut():
    assert inspect.signature(quality.fit).parameters["labelled"].default >= 2000


def test_all_documents_without_a_label_are_candidates(spark):
    rnd = random.Random(4)
    rows = [(k, rnd.uniform(-3, 3), rnd.choice([-2.0, -1.0, 1.0, 2.0])) for k in range(3000)]
    scored = spark.createDataFrame(rows, "key long, text double, page double").repartition(5)
    got = quality.surest(scored, spark.createDataFrame([(k,) for k in range(0, 3000, 2)], "key long"), 30, 50)
    free = [r for r in rows if r[0] % 2]
    want = {"page": [(k, 0) for k, *_ in sorted(free, key=lambda r: r[1])[:30]] + [(k, 1) for k, *_ in sorted(free, key=lambda r: -r[1])[:50]]}
    free = [r for r in free if r[0] not in {k for k, _ in want["page"]}]
    want["text"] = [(k, 0) for k, *_ in sorted(free, key=lambda r: (r[2], r[0]))[:30]] + [(k, 1) for k, *_ in sorted(free, key=lambda r: (-r[2], r[0]))[:50]]
    assert got == want


def test_pseudo_labels_grow_with_the_documents(spark):
    docs, labels = tables(spark, 6000)
    copies = docs.where("doc_id = 5999").crossJoin(spark.range(500).select("id")).selectExpr("10000 + id as doc_id", "text", "lang", "source", "n_chars")
    model = quality.fit(docs.union(copies), labels.where("doc_id < 300"), rounds=2)
    # 5700 texts without a label, of which each view hands over 75 a round; 500 copies of one count once
    assert model.pseudo == 2 * 2 * 75


def test_the_views_are_apart():
    """The page view gets no text, the text view no metadata."""
    assert list(inspect.signature(quality.page_features).parameters) == ["lang", "source", "n_chars"]
    assert list(inspect.signature(quality.CoTrained.text_odds).parameters) == ["self", "texts"]


def auc(score, good):
    pairs = [(a > b) + 0.5 * (a == b) for a, g in zip(score, good, strict=True) if g for b, h in zip(score, good, strict=True) if not h]
    return sum(pairs) / len(pairs)


def test_rounds_teach_the_text_view(spark):
    """Most kinds of text, good and bad, are in no labelled row, but the sources are: only the page view can pass them on."""
    rnd = random.Random(11)
    word = lambda letters: "".join(rnd.choices(letters, k=5))
    kinds = [["stuv", "klmn", "opqr"], ["abcd", "efgh", "wxyz"]]
    rows = []
    for i in range(1500):
        good = i % 3 > 0
        letters = kinds[good][0] if i < 120 else rnd.choice(kinds[good])
        rows.append((i, " ".join(word(letters) for _ in range(20)), "en", f"good{i % 4}" if good else f"bad{i % 4}", 120))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(120)], "doc_id long, quality int")
    found = []
    for rounds in (0, 3):
        model = quality.fit(docs, labels, rounds=rounds, confident=1.0)
        found.append(auc(model.text_odds([t for _, t, *_ in rows[120:]]), [i % 3 > 0 for i, *_ in rows[120:]]))
    assert found[1] > max(0.98, found[0])


def test_odd_rows(spark):
    """Nulls, empty texts, ties, repeated rows, clashing names, missing metadata, several labels."""
    docs, labels = tables(spark, 200)
    model = quality.fit(docs, labels)
    odd = [(1, None, None, None, None, 0.5), (1, None, None, None, None, 0.5), (None, "", "en", "s", -3, None), (2, "x" * 300_000, "en", "s", 300_000, 1.0)]
    frame = spark.createDataFrame(odd, "doc_id long, text string, lang string, source string, n_chars long, quality_score double")
    got = quality.score(frame, model).collect()
    assert len(got) == 4 and all(0 <= r.quality_score <= 1 for r in got) and got[0] == got[1]
    assert quality.score(frame.limit(0), model).count() == 0
    narrow = quality.score(frame.select("doc_id", "text"), model)
    assert narrow.columns == ["doc_id", "text", "text_score", "page_score", "quality_score"] and narrow.count() == 4
    more = labels.unionByName(labels).unionByName(spark.createDataFrame([(None, 1), (3, None), (0, 1)], labels.schema)).withColumn("key", labels.doc_id)
    again = quality.fit(docs.unionByName(docs).withColumn("label", docs.n_chars), more)
    assert abs(again.prior - model.prior) < 1e-9
