"""The stages of the corpus pipeline, one by one and in a row, against plain versions on a small corpus."""

import hashlib
import json
import random
import re
import struct
import zlib
from collections import Counter

import corpus_pipeline as pipeline
import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from siltstone.llm import quality

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
KEY = "AKIA" + "Q7" * 8


def corpus():
    rnd = random.Random(21)
    words = ["".join(rnd.choices("abcdefgh", k=rnd.randint(2, 7))) for _ in range(400)]
    out = []
    for i in range(160):
        text = " ".join(rnd.choices(words, k=rnd.randint(8, 90)))
        if i % 4 == 0:
            text += " ### $$$" * 15
        if i % 9 == 0:
            text = f"{text} secret = hunter2hunter2 and {KEY}."
        out.append((i, text, rnd.choice(["en", "de", None]), rnd.choice(["a", "b", "c", None]) if i % 4 else "junk", len(text)))
    for i in range(160, 220):  # near copies, chains of them, and exact copies under other ids
        text = out[rnd.randrange(len(out))][1].split(" ")
        if i % 3:
            text[rnd.randrange(len(text))] = "changed"
        out.append((i, " ".join(text), "en", "a", None))
    odd = [(None, None, None, None, None), (None, "", "en", "a", 0), (300, " \n", "en", "b", 2), (301, "one two", None, None, 7), (302, "One  TWO", "de", "b", 8), (None, "no id " * 5, "en", "c", 30)]
    out += odd + odd + [out[5], out[5], (5, out[5][1], "xx", "b", out[5][4]), (303, "long text, " * 9000, "en", "c", 99_000)]
    return out


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("sf")
    extra = spark.createDataFrame(corpus(), SCHEMA).selectExpr("*", "'x' as _key", "1.0D as quality_score", "'y' as spans", "7L as size", "true as component_id")
    extra.repartition(3).write.parquet(f"file://{top}/documents.parquet")
    labels = [(i, int(i % 4 != 0)) for i in range(0, 160, 2)] + [(i, int(i % 4 != 0)) for i in range(1, 40, 2)]
    spark.createDataFrame(labels + [(None, 1), (7, None)], "doc_id long, quality int").write.parquet(f"file://{top}/labels.parquet")
    return f"file://{top}"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def tuples(df):
    assert df.columns == list(pipeline.COLUMNS)
    return [tuple(r) for r in df.collect()]


def order(rows):
    return sorted(rows, key=repr)


def plain_quality(model, rows):
    """Scores one row at a time, by the sums of all classes."""
    out = []
    for r in rows:
        z = model.text.text_logits([r[1] or ""], "all")[0]
        f = quality.page_features(r[2], r[3], r[4])
        y = model.page.bias + model.page.weights[model.page.row[f]].astype(float).sum(0) / max(len(f) + model.page.shrink, 1)
        odds = (z[1] - z[0]) / model.text.temperature + (y[1] - y[0]) / model.page.temperature + model.prior
        if odds >= 0:
            out.append(r)
    return out


def plain_near_copies(rows):
    def key(r):
        rest = json.dumps({k: v for k, v in zip(("lang", "source", "n_chars"), r[2:], strict=True) if v is not None}, separators=(",", ":"), ensure_ascii=False)
        return (r[0] is None, r[0] if r[0] is not None else 0, hashlib.md5(r[1].encode()).hexdigest(), hashlib.md5(rest.encode()).hexdigest())

    out, worded = [], []
    for r in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in r[1] or ""))
        if w:
            worded.append((key(r), r, {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}))
        else:
            out.append(r)
    worded.sort(key=lambda x: x[0])
    group = list(range(len(worded)))
    find = lambda x: x if group[x] == x else find(group[x])
    for i, (_, _, a) in enumerate(worded):
        for j in range(i):
            b = worded[j][2]
            if 100 * len(a & b) >= 80 * len(a | b):
                group[max(find(i), find(j))] = min(find(i), find(j))
    return out + [worded[i][1] for i in range(len(worded)) if find(i) == i]


def plain_secrets(rows):
    out = []
    for doc_id, text, *rest in rows:
        new = text and re.sub(r"secret = hunter2hunter2", "[ASSIGN]", text).replace(KEY, "[ACCESS]")
        out.append((doc_id, new, *rest[:2], len(new) if new != text else rest[2]))
    return out


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def plain_mixing(rows):
    """How often each row is taken."""
    size = Counter()
    for r in rows:
        size[r[3]] += words(r[1])
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight, full, total = {s: i % 3 + 1 for i, s in enumerate(names)}, set(), sum(size.values())
    while True:
        rate = (total - sum(3 * size[s] for s in full)) / max(1, sum(w for s, w in weight.items() if s not in full))
        more = {s for s in names if s not in full and rate * weight[s] > 3 * size[s]}
        if not more:
            break
        full |= more
    taken = Counter()
    for s in names:
        goal = round(3 * size[s] if s in full else rate * weight[s])
        draw = lambda r: hashlib.md5((str(r[0]) if r[0] is not None else r[1] or "").encode()).hexdigest()
        own, at = sorted((r for r in rows if r[3] == s), key=lambda r: (draw(r), words(r[1]))), 0
        for r in own:
            n = words(r[1])
            if n:
                laps = goal // size[s]
                more = max(0, min(n, goal - laps * size[s] - at))
                taken[r] += laps + (more > 0)
            at += n
    return taken


def check_packing(rows, pieces, whole):
    left = Counter()
    for r in rows:
        ids = struct.pack(f"<{(n := len(ids := whole.encode(r[1] or '', add_special_tokens=False).ids + [2]))}I", *ids)
        left[r[0], n, zlib.crc32(ids) if n <= 1 else 0] += 1
    total = Counter()
    for p in pieces:
        total[p.doc_id] += p.length
        if p.length == p.doc_tokens and p.doc_tokens > 1:
            assert p.start == 0
    want = Counter()
    for (doc_id, n, _), k in left.items():
        want[doc_id] += n * k
    assert total == want
    by_seq = {}
    for p in pieces:
        by_seq.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for parts in by_seq.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 4096


def test_every_stage(spark, folder, tmp_path):
    """Each stage on the whole of what the plain version of the one before has left."""
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = corpus()
    model = quality.fit(docs.select(*pipeline.COLUMNS), labels)
    kept = plain_quality(model, rows)
    assert order(tuples(pipeline.quality(spark, docs, folder))) == order(kept)
    assert 0 < sum(r[3] == "junk" for r in rows) and not any(r[3] == "junk" for r in kept) and len(kept) > len(rows) // 2

    single = plain_near_copies(kept)
    got = tuples(pipeline.near_copies(spark, frame(spark, kept), folder))
    assert order(got) == order(single) and len(single) < len(kept)
    assert sum(not words(r[1]) for r in single) == sum(not words(r[1]) for r in kept)

    clean = plain_secrets(single)
    assert order(tuples(pipeline.secrets(spark, frame(spark, single), folder))) == order(clean)
    assert any(KEY in (r[1] or "") for r in single) and not any(KEY in (r[1] or "") or "hunter2" in (r[1] or "") for r in clean)

    taken = plain_mixing(clean)
    mixed = tuples(pipeline.mixing(spark, frame(spark, clean), folder))
    assert Counter(mixed) == +taken

    check_packing(mixed, pipeline.packing(spark, frame(spark, mixed), folder).collect(), Tokenizer.from_file(P.path("word_bpe_49k.json")))


def test_run_is_the_stages_in_a_row(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = quality.fit(docs.select(*pipeline.COLUMNS), spark.read.parquet(f"{folder}/labels.parquet"))
    taken = plain_mixing(plain_secrets(plain_near_copies(plain_quality(model, corpus()))))
    pieces = pipeline.run(spark, folder).collect()
    check_packing(list(taken.elements()), pieces, Tokenizer.from_file(P.path("word_bpe_49k.json")))


def test_stages_of_nothing(spark, tmp_path):
    empty = frame(spark, [])
    empty.write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"file://{tmp_path}/labels.parquet")
    for name, stage in pipeline.STAGES:
        assert stage(spark, empty, f"file://{tmp_path}").count() == 0, name
    # without labels nothing is rejected
    assert pipeline.quality(spark, frame(spark, corpus()[:9]), f"file://{tmp_path}").count() == 9
    assert np.isfinite([len(c) for c in pipeline.COLUMNS]).all()
