"""op2 to op9 against brute force on small tables with nulls, empty texts, repeated rows and clashing columns."""

import hashlib
import random
import re
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.llm import compaction, jaccard, langid, linear, matroska, mixing, quality, secrets, topk

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rank int, block long, sig string, spans string, cum long"
WORDS = [f"w{i}" for i in range(60)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, source, None, 1, 1, "x", "y", 0) for i, t, lang, source in rows], SCHEMA)


def texts(n=120, seed=5):
    rnd = random.Random(seed)
    out = [(0, None, None, None), (1, "", "en", "b"), (2, " \n\t ", "en", "a"), (3, "one", None, "a"), (4, "One", "en", "a"), (5, "one two three", "de", "b")]
    base = [" ".join(rnd.choices(WORDS, k=rnd.randint(3, 60))) for _ in range(12)]
    for i in range(6, n):
        words = rnd.choice(base).split(" ")
        for _ in range(rnd.choice([0, 0, 1, 1, 2, 4])):
            words[rnd.randrange(len(words))] = rnd.choice(WORDS)
        out.append((i, rnd.choice([" ", "\n"]).join(words), rnd.choice(["en", "de"]), rnd.choice("abcde")))
    return out + [(n, "w1 " * 30_000, "en", "c"), out[20], out[20], (None, out[21][1], "en", "c")]


def brute(rows, size, percent):
    sets = []
    for _, t, *_ in rows:
        low = "".join(c.lower() if c.isascii() else c for c in t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} or ({tuple(w)} if w else set()))
    root = list(range(len(rows)))
    find = lambda x: x if root[x] == x else find(root[x])
    links = [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                links[i], links[j] = links[i] + 1, links[j] + 1
                root[max(find(i), find(j))] = min(find(i), find(j))
    ids = {}
    for i, r in enumerate(rows):
        ids.setdefault(find(i), []).append(r[0])
    return sorted((str(r[0]), len(sets[i]), str(min((x for x in ids[find(i)] if x is not None), default=None)), links[i]) for i, r in enumerate(rows))


@pytest.mark.parametrize("size, percent, sets, few, run", [(4, 85, 512, 32, 3_000_000), (5, 80, 8, 1, 500), (1, 60, 5, 2, 1), (1, 50, 3, 32, 3_000_000)])
def test_near_duplicates(spark, monkeypatch, size, percent, sets, few, run):
    for name, value in (("SETS", sets), ("FEW", few), ("RUN", run)):
        monkeypatch.setattr(jaccard, name, value)
    rows = texts()
    got = jaccard.near_duplicates(spark, frame(spark, rows), size, percent).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.n_links) for r in got) == brute(rows, size, percent)


def test_near_duplicates_of_nothing(spark):
    assert jaccard.near_duplicates(spark, frame(spark, [])).count() == 0


def test_top_k(spark):
    rnd = np.random.default_rng(1)
    rows = [(i, [float(x) for x in v], "x") for i, v in enumerate(np.round(rnd.normal(size=(90, 6)), 1))]
    rows += [(100, None, "x"), (120, [1.0, None], "x"), (140, [float("nan")], "x"), (160, [float("inf")], "x"), (180, [], "x"), (200, [2.0], "x"), (20, rows[20][1], "x"), (None, [1.0], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, block string")
    v = topk.sparse_rows(df).select("vec_id", "v")
    asked = v.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    got = topk.top_k(asked, v, 7, block=10, asked=2).collect()
    left, right = topk.pairs_of_blocks(asked.union(asked), v, 10, 3)
    for side, most in ((left, 9), (right, 30)):
        assert side.groupBy("a", "b").count().agg(F.max("count")).first()[0] <= most  # no task sees all rows
    assert sorted(r.vec_id for r in topk.top_k(asked.union(spark.createDataFrame([(40, [-(2**40)])], asked.schema)), v, 1).where("query_id = 40").collect()) == [int(min(sound0, key=lambda e: (e[1][0], e[0]))[0]) for sound0 in [[(i, np.floor(64 * np.array(e, float))) for i, e, _ in rows if i not in (None, 40) and e and all(x is not None and np.isfinite(x) for x in e)]]]
    sound = [(i, np.floor(64 * np.array(e, float)).astype(int)) for i, e, _ in rows if i is not None and e is not None and all(x is not None and np.isfinite(x) for x in e)]
    want = []
    for q in {i for i, _ in sound if i % 20 == 0}:
        mine = next(e for i, e in sound if i == q)
        scored = sorted((-int(sum(a * b for a, b in zip(mine, e))), i) for i, e in sound if i != q)[:7]  # noqa: B905
        want += [(q, k, i, -s) for k, (s, i) in enumerate(scored, 1)]
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == sorted(want)


def test_matroska_round_trip(spark):
    for text in ("", "a", "é" * 700, "x" * 576, "y" * 400_000):
        payload, n = matroska.payload_of(text)
        found = matroska.parse(matroska.write(payload))
        data = matroska.write(payload)
        assert n == len(text.encode()) and b"".join(data[a:b] for _, _, a, b, _, _ in found["packets"]) == payload
        assert [p[1] for p in found["packets"]] == [i * 72_000_000 for i in range(len(payload) // 576)] and len(found["cues"]) == found["clusters"]
        assert all(data[c[2] : c[2] + 4] == b"\x1f\x43\xb6\x75" for c in found["cues"])
    rows = [(1, None, None, None), (2, "", None, None), (3, "abc" * 999, None, None), (3, "abc" * 999, None, None)]
    media = matroska.encode_media(frame(spark, rows))
    for r in matroska.media_digest(media).collect():
        payload, n = matroska.payload_of(dict((i, t) for i, t, *_ in rows)[r.doc_id])
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
    assert matroska.packets(media).count() == 1 + 1 + 6 + 6
    bad = spark.createDataFrame([(1, None), (2, b"\x1a\x45"), (3, b"")], "doc_id long, media binary")
    found = {r.doc_id: r for r in matroska.media_digest(bad.selectExpr("*", "5L as n_bytes", "'x' as feature")).collect()}
    assert found[1].media_bytes is None and found[1].feature is None and found[1].n_bytes == 5
    assert found[2].feature.startswith("error=") and found[2].media_bytes == 2 and found[2].payload_bytes is None and found[3].payload_bytes == 0
    assert [(r.doc_id, r.error is None) for r in matroska.packets(bad).collect()] == [(2, False)]


def test_matroska_lacings_and_unknown_sizes():
    m = matroska
    frames = [b"a" * 300, b"b" * 20, b"c" * 255, b"d" * 7]
    xiph = bytes([3]) + b"\xff\x2d" + b"\x14" + b"\xff\x00" + b"".join(frames)
    ebml = bytes([3]) + b"\x41\x2c" + (20 - 300 + 0x1FFF | 0x4000).to_bytes(2, "big") + (255 - 20 + 0x1FFF | 0x4000).to_bytes(2, "big") + b"".join(frames)
    for body, lacing in ((xiph, 1), (ebml, 3), (bytes([1]) + b"x" * 20, 2), (b"z", 0)):
        got = [body[a:b] for a, b in m.frame_ranges(body, 0, len(body), lacing)]
        assert got == (frames if lacing in (1, 3) else [b"x" * 10] * 2 if lacing == 2 else [b"z"])
    block = b"\x81\x00\x05\x00" + b"data"
    cluster = m.uint(m.CLUSTER_TIME, 10) + m.element(m.BLOCK_GROUP, m.element(m.BLOCK, block) + m.uint(m.REFERENCE, 1))
    unknown = b"\x18\x53\x80\x67\x01" + b"\xff" * 7 + (b"\x1f\x43\xb6\x75\xff" + cluster) * 2
    found = m.parse(unknown)
    assert found["clusters"] == 2 and [p[1] for p in found["packets"]] == [15_000_000] * 2 and not found["packets"][0][4]
    with pytest.raises(ValueError):
        m.parse(m.element(m.SEGMENT, m.element(m.CLUSTER, m.element(m.SIMPLE_BLOCK, b"\x81\x00\x00\x02\x05" + b"x" * 7))))


def test_secrets(spark):
    made = ["password = hunter2hunter2", 'API_KEY: "abc.def/ghi+jk" token=short', "secret=token=abcdefgh", "AKIA" + "A1" * 6, "AKIA123", "é😀 " + "0123456789abcdef" * 2, "f" * 31, "PASSWD:'0123456789abcdef0123456789abcdef'", "ſecret=abcdefghij", "ghp_" + "a" * 36, None, "", "x" * 100_000 + " Secret := no"]
    rows = [(i, t, None, None) for i, t in enumerate(made)] + [(0, made[0], None, None)]
    kinds = ["assign", "access", "hex"]
    pats = [re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), re.compile("AKIA[A-Z0-9]+"), re.compile("[0-9a-f]+")]
    for r in secrets.scan(frame(spark, rows)).collect():
        t = made[r.doc_id] or ""
        spans = [(m.start(), k, m.end()) for k, (p, n, g) in enumerate(zip(pats, (8, 16, 32), (2, 0, 0), strict=True)) for m in p.finditer(t) if len(m[g]) >= n]
        own = ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in sorted(spans))
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s[1] == k for s in spans) for k in range(3)), t
        assert r.base_sha256 == hashlib.sha256(own.encode()).hexdigest() and set(filter(None, own.split(","))) <= set(r.spans.split(","))
        assert (r.redacted is None) == (r.text is None) and (r.redacted == r.text or r.spans)
    assert secrets.trigram_query("a+b*") is None and secrets.trigram_query("abcd|xyz") == ("or", (("and", (b"abc", b"bcd")), b"xyz"))


def test_mixing(spark):
    rows = texts()
    got = mixing.mix(spark, frame(spark, rows))
    out = got.collect()
    assert len(out) == len(rows)
    size = {}
    for r in out:
        size[r.source] = size.get(r.source, 0) + r.size
    total, order = sum(size.values()), sorted(size, key=lambda s: (s is None, s or ""))
    share, full = {s: i % 3 + 1 for i, s in enumerate(order)}, set()
    while True:
        rate = (total - sum(3 * size[s] for s in full)) / sum(w for s, w in share.items() if s not in full)
        more = {s for s in order if s not in full and rate * share[s] > 3 * size[s]}
        if not more:
            break
        full |= more
    for s in order:
        mine = [r for r in out if r.source == s]
        want = 3 * size[s] if s in full else rate * share[s]
        assert all(abs(r.target - want) < 1e-6 for r in mine) and all(0 <= r.taken <= 3 * r.size for r in mine)
        assert abs(sum(r.taken for r in mine) - want) <= 1
    copies = mixing.training_order(got).collect()
    assert sum(r.words for r in copies) == sum(r.taken for r in out) and all(0 <= r.position <= 1 for r in copies)
    assert [r.position for r in copies] == sorted(r.position for r in copies)
    assert mixing.mix(spark, frame(spark, [])).count() == 0
    for rates in ((0.5, 1.5), (1.0, 1.0), (3.0, 0.0, 1.0, 2.0), (0.0, 1.0)):
        shares = [k / 40 for k in range(41)]
        found = [r[0] for r in spark.createDataFrame([(x,) for x in shares], "x double").coalesce(1).select(mixing.inverse(F.col("x"), rates)).collect()]
        grid = np.linspace(0, 1, 200_001)
        rate = np.interp(grid, np.linspace(0, 1, len(rates)), rates)
        demand = np.concatenate([[0], np.cumsum((rate[1:] + rate[:-1]) / 2)])
        demand /= demand[-1]
        assert np.allclose(np.interp(found, grid, demand), shares, atol=1e-4) and found == sorted(found)
    late = mixing.training_order(got, ((0.0, 1.0),)).collect()
    assert sum(r.words for r in late) == sum(r.taken for r in out) and min(r.position for r in late) >= 0
    for bad in ((1.0,), (0.0, 0.0), (-1.0, 2.0)):
        with pytest.raises(ValueError):
            mixing.inverse(F.lit(0.5), bad)
    assert [(r.taken, r.target) for r in mixing.mix(spark, frame(spark, [(1, None, "en", "a"), (2, "", "en", None)])).collect()] == [(0, 0.0)] * 2


def test_language_and_quality(spark):
    rnd = random.Random(3)
    alphabet = {"en": "abcde", "de": "fghij"}
    rows = [(i, " ".join("".join(rnd.choices(alphabet[lang], k=5)) for _ in range(30)), lang, "s") for i in range(200) for lang in [rnd.choice(["en", "de"])]]
    odd = [(500, None, "en", None), (501, "", None, None), (502, "123 !?", "de", None), (None, rows[0][1], rows[0][2], None), (503, rows[1][1] * 900, None, None)]
    docs = frame(spark, rows + odd)
    got = {r.doc_id: r for r in langid.predict(docs, langid.fit(docs)).collect()}
    assert all(got[i].lang_pred == lang and 0.5 < got[i].score <= 1 for i, _, lang, _ in rows)
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, *_ in rows)
    assert [got[i].lang_pred for i in (500, 501, 502, 503)] == ["und"] * 3 + [rows[1][2]]
    assert langid.fit(frame(spark, [])) is None and langid.predict(frame(spark, []), None).count() == 0
    assert langid.predict(docs, None).where("lang_pred <> 'und'").count() == 0
    marks = [(i, t + (" ### $$$" * 20 if i % 5 == 0 else ""), lang, s) for i, t, lang, s in rows]
    labels = spark.createDataFrame([(i, int(i % 5 != 0), 0) for i in range(120)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    scored = quality.score(frame(spark, marks + odd), quality.fit(frame(spark, marks + odd), labels)).collect()
    assert all((r.quality_score >= 0.5) == (r.doc_id % 5 != 0) for r in scored if r.doc_id is not None and r.doc_id < 200) and len(scored) == len(marks) + len(odd)
    assert quality.fit(docs, labels.where("quality = 1")) is None
    assert quality.keep_good(docs, labels.limit(0)).count() == docs.count()


def test_whole_texts_are_scored():
    model = linear.train(linear.counts(["aaaa", "bbbb"], "letters", 12), np.array([0, 1]), 2, 12, l1=0.0)
    long = "a" * (linear.PIECE + 10) + " " + "b" * (3 * linear.PIECE)
    assert model.text_logits([long, "aa", ""], "letters").argmax(1).tolist()[:2] == [1, 0]


def test_compaction(spark, tmp_path):
    store = compaction.ShardStore(spark, f"file://{tmp_path}/s", target_bytes=1 << 20, fan=3, smallest=1000)
    docs = frame(spark, texts())
    for _ in range(3):
        store.append(docs.select("doc_id", "text"))
    assert len({f.run for f in store.files()}) == 3 and store.version() == 3
    store.compact()
    assert len({f.run for f in store.files()}) == 1 and store.version() == 4
    assert store.read().count() == 3 * docs.count() == store.read(3).count()
    with pytest.raises(FileExistsError):
        store.commit(3, [], store.manifest()["schema"])
    with pytest.raises(ValueError):
        store.append(docs.select("doc_id"))
    store.expire()
    assert store.read().exceptAll(docs.select("doc_id", "text").union(docs.select("doc_id", "text")).union(docs.select("doc_id", "text"))).count() == 0
    # equal columns that may not be null are the same columns; a run that no version lists goes by vacuum alone
    store.append(docs.limit(0).selectExpr("coalesce(doc_id, 0L) as doc_id", "coalesce(text, '') as text"))
    docs.write.parquet(f"file://{tmp_path}/s/runs/lost")
    assert store.vacuum() == 0 and store.vacuum(-5) > 0 and store.read().count() == 3 * docs.count()
    # a writer that loses a race for a version tries again on the newer one
    commit, lost = store.commit, []

    def raced(based_on, files, schema):
        if not lost:
            lost.append(commit(based_on, store.files(), schema))
        return commit(based_on, files, schema)

    store.commit = raced
    before = store.version()
    assert store.append(docs.select("doc_id", "text")) == before + 2 and store.read().count() == 4 * docs.count()
    # one run and one version for each arrival, and a table with a column of that name
    many = compaction.ShardStore(spark, f"file://{tmp_path}/m")
    many.append(docs.selectExpr("doc_id", "text", "'own' as arrival", "doc_id % 5 as part"), arrival="part")
    assert many.version() == len({f.run for f in many.files()}) == 6 and set(many.read().columns) == {"doc_id", "text", "arrival"}
    assert many.read().count() == docs.count() and many.read().where("arrival = 'own'").count() == docs.count()


def test_tiers(spark, tmp_path):
    store = compaction.ShardStore(spark, f"file://{tmp_path}/s", target_bytes=1000, fan=2, smallest=10)
    assert [store.tier(n) for n in (0, 10, 11, 20, 21, 40, 41)] == [0, 0, 1, 1, 2, 2, 3]
    f = lambda run, *sizes: [compaction.File(f"{run}{i}", n, run) for i, n in enumerate(sizes)]
    assert store.due(f("a", 9) + f("b", 300) + f("c", 8)) == ["a", "c"]
    assert store.due(f("a", 9) + f("b", 300) + f("c", 280)) == ["b", "c"]
    assert store.due(f("a", 900, 950) + f("b", 900, 980)) == [] and store.due([]) == []


def test_compaction_of_nothing(spark, tmp_path):
    docs = frame(spark, texts())
    empty = compaction.ShardStore(spark, f"file://{tmp_path}/e")
    empty.append(docs.limit(0).select("doc_id", "text"))
    assert empty.compact() == 1 and empty.read().count() == 0


def test_packed_keys():
    keys = np.unique(np.random.default_rng(2).integers(0, 2**47, 5000, np.uint64))
    assert (jaccard.unpack_sorted(jaccard.pack_sorted(keys)) == keys).all()
    assert struct.calcsize("<I") == 4
