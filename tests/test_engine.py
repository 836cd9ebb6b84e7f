"""The retrieval engine against small fixtures with known results."""

import hashlib
import json
import random
import re
import time
from math import log, sqrt

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltstone.functions import codec, text
from siltstone.operators import index as ix
from siltstone.operators import ranking, reports
from siltstone.operators.store import IndexStore, create_index, file_skips, packed_layout
from siltstone.sources import readers

DOCS = "doc_id long, title string, plot string"
MICRO = [(0, "Alpha", "Love story love"), (1, "Beta", "space love ship"), (2, "Gamma", "space ship space alien"), (3, "Delta", "story of the alien"), (4, "", "")]


@pytest.fixture(scope="module")
def micro(spark):
    return ix.build(spark.createDataFrame(MICRO, DOCS))


@pytest.mark.parametrize(
    "given, want",
    [(None, []), ("", []), ("!!!", []), ("Hello, World-2024!", ["hello", "world", "2024"]), ("don't", ["don", "t"]), ("Pelé_7", ["pel", "7"]), ("İstanbul", ["i", "stanbul"]), ("K", ["k"])],
)
def test_tokens(spark, given, want):
    assert spark.createDataFrame([(given,)], "t string").select(text.tokens(F.col("t"))).first()[0] == want
    assert text.query_tokens(given) == want


def test_micro_index(micro):
    s = micro.statistics().first()
    assert (s.n, s.avgdl, s.vocabulary, s.total_postings, s.total_tokens) == (5, 3.6, 11, 16, 18)
    assert micro.as_map("space").first().postings == {1: 1, 2: 2}
    assert (micro.document_frequency("love"), micro.collection_frequency("love"), micro.term_frequency("love", 0), micro.term_frequency("love", 3)) == (2, 3, 2, 0)
    assert {r.term: r.tf for r in micro.forward(1).collect()} == {"beta": 1, "space": 1, "love": 1, "ship": 1}
    assert micro.terms("zzz").count() == 0


@pytest.mark.parametrize(
    "q, bm25, ltc, ntc",
    [
        ("love story", {0: 2.136507, 1: 0.872658, 3: 0.779822}, {0: 1.904343, 1: 0.707107, 3: 0.707107}, None),
        ("space alien space", {2: 3.106909, 1: 1.745316, 3: 0.779822}, {2: 1.966405, 1: 0.861037, 3: 0.508542}, {2: 1.96161, 1: 0.894427, 3: 0.447214}),
        ("love zzz", {0: 1.263849, 1: 0.872658}, {0: 1.693147, 1: 1.0}, None),
        ("zzz", {}, {}, None),
        ("", {}, {}, None),
    ],
)
def test_micro_ranking(micro, q, bm25, ltc, ntc):
    got = lambda df: {r.doc_id: r.score for r in df.orderBy("rank").collect()}
    for found, want in ((ranking.bm25(micro, q), bm25), (ranking.smart(micro, q), ltc), (ranking.smart(micro, q, "ntc.ltc"), ntc or ltc)):
        found = got(found)
        assert list(found) == list(want) and all(abs(found[k] - want[k]) < 2e-6 for k in want)


def test_batch_is_single(spark, micro):
    qs = [(5, "love story"), (6, "space alien space"), (7, "zzz"), (8, None), (9, "the of")]
    many = spark.createDataFrame(qs, "query_id long, query string")
    for rank in (ranking.bm25, ranking.smart, ranking.language_model):
        got = {(r.query_id, r.rank): (r.doc_id, r.score) for r in rank(micro, many).collect()}
        want = {(i, r.rank): (r.doc_id, r.score) for i, q in qs for r in rank(micro, q or "").collect()}
        assert got == want


def test_ranking_edges(spark, micro):
    with pytest.raises(ValueError):
        ranking.smart(micro, "love", "xyz")
    every = ix.build(spark.createDataFrame([(0, "a", "x"), (1, "a", "x y")], DOCS))
    assert [r.score for r in ranking.bm25(every, "a").collect()] == [0.0, 0.0]
    assert [r.score for r in ranking.smart(every, "a").collect()] == [0.0, 0.0]
    empty = create_index(spark, "memory")
    assert ranking.bm25(empty, "a").count() == 0 and empty.statistics().first().avg_postings == 0
    assert {r.doc_id: r.tf for r in ranking.boolean_and(micro, "space ship").collect()} == {1: 1, 2: 1}


def test_bm25_against_python(spark):
    rnd = random.Random(1)
    docs = [(i, "t", " ".join(rnd.choices("abcdefgh", k=rnd.randint(0, 12)))) for i in range(60)]
    index = ix.build(spark.createDataFrame(docs, DOCS))
    toks = {i: re.findall("[a-z0-9]+", f"{t} {p}".lower()) for i, t, p in docs}
    avgdl = sum(map(len, toks.values())) / len(toks)
    for q in ("a b a", "h c", "t a"):
        scores, first = {}, {}
        for pos, term in enumerate(q.split()):
            have = {i: t.count(term) for i, t in toks.items() if term in t}
            for i, tf in have.items():
                first.setdefault(i, pos)
                scores[i] = scores.get(i, 0) + log(len(toks) / len(have)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(toks[i]) / avgdl))
        want = sorted(scores, key=lambda i: (-round(scores[i], 6), first[i], i))[:10]
        assert [r.doc_id for r in ranking.bm25(index, q).orderBy("rank").collect()] == want


def test_codec_vectors(spark):
    values = {0: "80", 1: "81", 5: "85", 127: "FF", 128: "0180", 129: "0181", 300: "02AC", 824: "06B8", 16383: "7FFF", 16384: "010080", 214577: "0D0CB1", 2**62: None}
    for r in spark.createDataFrame([(v,) for v in values], "n long").select("n", F.hex(codec.vb_encode(F.col("n"))).alias("h"), codec.vb_decode(codec.vb_encode(F.col("n"))).alias("back")).collect():
        assert values[r.n] in (None, r.h) and r.back == [r.n]
    p = spark.createDataFrame([("x", d, t) for d, t in ((0, 1), (3, 2), (131, 1), (500, 300))], "term string, doc_id long, tf long")
    packed = codec.compress(p)
    assert packed.select(F.hex("blob")).first()[0] == "8081838201808102F102AC"
    assert sorted(codec.decompress(packed).collect()) == sorted(p.collect())
    assert sorted(codec.decompress(codec.compress(p, True), True).collect()) == sorted(p.collect())
    cut = packed.withColumn("blob", F.expr("substring(blob, 1, length(blob) - 1)"))
    assert codec.decompress(cut).count() == 0
    odd = spark.sql("select unhex(h) as b, want from values ('81010801', array(1L)), ('8201', array(2L)), (repeat('01', 12) || '81', cast(array() as array<bigint>)), (null, null) as t(h, want)")
    assert all(r[0] == r.want for r in odd.select(codec.vb_decode(F.col("b")), "want").collect())
    assert spark.sql("select cast('' as binary) as b").select(codec.vb_decode(F.col("b"))).first()[0] == []


def test_codec_round_trip(spark):
    rnd = random.Random(2)
    rows = [(t, d, rnd.randint(1, 500)) for t in "abc" for d in rnd.sample(range(10**6), 200)]
    p = spark.createDataFrame(rows, "term string, doc_id long, tf long")
    assert sorted(codec.decompress(codec.compress(p)).collect()) == sorted(p.collect())
    skips = codec.skip_entries(p).where("term = 'a'").orderBy("doc_id").collect()
    ids = sorted(d for t, d, _ in rows if t == "a")
    assert [s.doc_id for s in skips] == ids[14::14] and all(s.nth % int(sqrt(200)) == 0 for s in skips)
    assert all(r.doc_id >= skips[2].doc_id for r in codec.segment(p.where("term = 'a'"), codec.skip_entries(p), skips[3].doc_id - 1).collect())


def test_updates(spark, tmp_path):
    store = IndexStore(spark, f"file://{tmp_path}/i", fields=("plot",))
    add = lambda title, plot: store.add(spark.createDataFrame([(title, plot)], "title string, plot string"))[0]
    get = lambda term: {r.doc_id: r.tf for r in store.view().terms(term).collect()}
    assert (add("doc1", "information retrieval bm25"), add("doc2", "bm25 ranking algorithm")) == (0, 1)
    assert get("bm25") == {0: 1, 1: 1}
    store.merge()
    assert get("bm25") == {0: 1, 1: 1}
    assert store.update(0, "doc1_v2", "tf idf information") == 2
    assert get("information") == {2: 1} and get("retrieval") == {}
    store.merge()
    assert get("information") == {2: 1} and get("bm25") == {1: 1}
    store.delete([1])
    store.merge()
    store = IndexStore(spark, f"file://{tmp_path}/i", fields=("plot",))
    assert get("bm25") == {} and {r.title for r in store.view().doc_stats.collect()} == {"doc1_v2"}
    with pytest.raises(ValueError):
        store.delete([99])
    store.delete([2])
    store.merge()
    assert add("x", "again") == 3  # an id is never used again
    for bad in ([(5, "a", "b"), (5, "c", "d")], [(None, "a", "b")], [(0, "a", "b")]):
        with pytest.raises(ValueError):
            store.add(spark.createDataFrame(bad, DOCS))
    with pytest.raises(ValueError):
        IndexStore(spark, f"file://{tmp_path}/k").create(spark.createDataFrame([(1, "a", "b"), (1, "c", "d")], DOCS))
    small = IndexStore(spark, f"file://{tmp_path}/j", merge_threshold=2)
    for i in range(3):
        small.add(spark.createDataFrame([(f"d{i}", "word")], "title string, plot string"))
    assert len(small.manifest()["parts"]) == 2 and small.view().document_frequency("word") == 3


def test_modes(spark, tmp_path, micro):
    docs = spark.createDataFrame(MICRO, DOCS)
    disk = create_index(spark, "disk", docs, f"file://{tmp_path}/d")
    assert ix.differences(micro.postings, disk.view().postings).count() == 0
    assert ix.differences(micro.lexicon, disk.lexicon()).count() == 0
    assert ix.differences(codec.decompress(disk.compressed()), micro.postings).count() == 0
    plan = disk.view().terms("love")._jdf.queryExecution().toString()
    assert re.search(r"PushedFilters: \[.*term", plan)
    for bad in (("other", "x"), ("disk", None)):
        with pytest.raises(ValueError):
            create_index(spark, bad[0], docs, bad[1])


def test_sources(spark, tmp_path):
    for d, body in (("1970s", '"A ""b"", c",i,"line 1\nline 2"\nNull,i,\nx,i,NaN\n'), ("1980s", "y,i,z\n")):
        (tmp_path / f"{d}-movies.csv").write_text("title,image,plot\n" + body)
    got = readers.decade_files(spark, str(tmp_path), ("1970s", "1980s")).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == [(0, 'A "b", c', "line 1\nline 2", "1970s"), (1, "Null", None, "1970s"), (2, "x", "NaN", "1970s"), (3, "y", "z", "1980s")]
    (tmp_path / "t").mkdir()
    for i in (2, 10):
        (tmp_path / "t" / f"doc_{i}.txt").write_text(f"body {i}\nmore")
    assert [(r.doc_id, r.title, r.plot) for r in readers.text_folder(spark, str(tmp_path / "t")).orderBy("doc_id").collect()] == [(0, "doc_10.txt", "body 10\nmore"), (1, "doc_2.txt", "body 2\nmore")]
    (tmp_path / "c").mkdir()
    for name, rows_ in (("b.csv", "b1,,x\nb2,,y\n"), ("a.csv", "a1,,x\n"), ("z.txt", "no")):
        (tmp_path / "c" / name).write_text("title,image,plot\n" + rows_)
    assert [(r.doc_id, r.title) for r in readers.csv_folder(spark, str(tmp_path / "c")).orderBy("doc_id").collect()] == [(0, "a1"), (1, "b1"), (2, "b2")]
    assert [r.title for r in readers.first_rows(spark, str(tmp_path / "c"), 1).collect()] == ["a1"]
    own = readers.folder_with(spark, str(tmp_path / "t"), lambda name, content: (name.upper(), content.decode().split()[1]))
    assert [tuple(r) for r in own.orderBy("doc_id").collect()] == [(0, "DOC_10.TXT", "10"), (1, "DOC_2.TXT", "2")]
    assert readers.complete(spark.createDataFrame([("a", "b"), (" \n", "b"), ("a", None)], "title string, plot string")).count() == 1
    assert ix.tokenized(spark.createDataFrame([(0, None, "b")], DOCS), pandas_nulls=True).first().tokens == ["nan", "b"]


@pytest.mark.parametrize("adaptive", ["true", "false"])
@pytest.mark.parametrize("partitions", [8, 200])
def test_dense_ids_of_many_rows(spark, adaptive, partitions):
    """No id is lost or given twice, whatever the partitions."""
    n = 100_000
    rows = spark.range(0, n, 1, 13).select(F.concat(F.lit("t"), F.pmod(F.xxhash64("id"), F.lit(997)).cast("string")).alias("title"), F.repeat(F.md5(F.col("id").cast("string")), 16).alias("plot"), "id")
    kept = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        for order in ([], ["title"]):
            got = readers.dense_ids(rows, order, 7)
            assert tuple(got.agg(F.count_if(F.length("plot") == 512), F.min("doc_id"), F.max("doc_id"), F.count_distinct("doc_id"), F.count_distinct("id")).first()) == (n, 7, n + 6, n, n)
            place = F.lag(F.struct(*order, "id")).over(Window.orderBy("doc_id"))
            assert got.where(F.col("doc_id").between(7, 20_000)).withColumn("before", place).where(F.col("before") > F.struct(*order, "id")).count() == 0
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


@pytest.mark.parametrize("compressed", [False, True])
def test_postings_and_statistics_of_added_documents_agree(spark, tmp_path, compressed):
    n = 20_000
    store = IndexStore(spark, f"file://{tmp_path}/big", merge_threshold=1 << 40, compressed=compressed)
    docs = spark.range(0, n, 1, 7).select(F.concat(F.lit("t"), F.col("id").cast("string")).alias("title"), F.concat_ws(" ", F.lit("all"), F.md5(F.col("id").cast("string"))).alias("plot"))
    for i in range(2):
        assert store.add(docs) == range(i * n, (i + 1) * n)
    view = store.view()
    assert tuple(view.doc_stats.agg(F.count("*"), F.count_distinct("doc_id"), F.max("doc_id")).first()) == (2 * n, 2 * n, 2 * n - 1)
    own = view.postings.groupBy("doc_id").agg(F.sum("tf").alias("n"))
    assert own.count() == 2 * n and own.join(view.doc_stats, "doc_id").where("n <> doc_len").count() == 0
    # the added documents keep their order
    assert view.postings.where("term like 't%'").where(F.col("term") != F.concat(F.lit("t"), (F.col("doc_id") % n).cast("string"))).count() == 0
    assert store.lexicon().where("term = 'all'").first().df == 2 * n


def test_blocks_round_trip(spark):
    rnd = random.Random(8)
    rows = [(t, d, rnd.randint(1, 300)) for t, k in (("a", 1), ("b", 70), ("c", 900), ("d", 3000)) for d in rnd.sample(range(4000), k)]
    rows += [("a", 2**40, 1), ("e", 0, 1)]
    p = spark.createDataFrame(rows, "term string, doc_id long, tf long")
    for width in (1, 64, 1 << 16):
        blocks = codec.compress_blocks(p, width)
        assert sorted(tuple(r) for r in codec.decompress_blocks(blocks, width).collect()) == sorted(rows)
        assert blocks.agg(F.max("df")).first()[0] <= width
    assert spark.range(1).select(codec.encode(F.array().cast("array<struct<doc_id:bigint,tf:bigint>>"), F.lit(0))).first()[0] == b""
    assert codec.compress(p.limit(0)).count() == 0
    cut = codec.compress_blocks(p).withColumn("blob", F.expr("substring(blob, 1, length(blob) - 1)"))
    assert codec.decompress_blocks(cut).count() == 0


@pytest.mark.parametrize("n", [20_000])
def test_long_lists_in_linear_time(spark, n):
    """A block of many documents and a whole list are coded and decoded in seconds; by the square of n it takes minutes."""
    began = time.monotonic()
    p = spark.range(n).select(F.lit("a").alias("term"), (3 * F.col("id")).alias("doc_id"), (1 + F.col("id") % 300).alias("tf"))
    blocks = codec.compress_blocks(p)
    assert ix.differences(codec.decompress_blocks(blocks), p).count() == 0
    whole = codec.compress(p)
    assert ix.differences(codec.decompress(whole), p).count() == 0
    # no posting of a decoded list is shuffled
    plan = codec.decompress(spark.createDataFrame([("a", 1, bytearray(b"\x81\x81"))], "term string, df long, blob binary"))
    assert "Window" not in plan._jdf.queryExecution().toString() and plan.collect()[0][:] == ("a", 1, 1)
    assert time.monotonic() - began < 60


def test_codes_of_all_lengths(spark):
    values = [v for k in range(1, 10) for v in (2 ** (7 * k) - 1, 2 ** (7 * k), 2 ** (7 * k) + 5) if v < 2**63] + [0, 2**63 - 1]
    for r in spark.createDataFrame([(v,) for v in values], "n long").select("n", codec.vb_encode(F.col("n")).alias("b"), codec.vb_decode(codec.vb_encode(F.col("n"))).alias("back")).collect():
        groups = [r.n >> 7 * k & 127 for k in range(8, -1, -1)]
        code = groups[next((i for i, g in enumerate(groups) if g), 8) :]
        assert bytes(r.b) == bytes([*code[:-1], code[-1] | 128]) and r.back == [r.n]


def against_sql(spark, folder, name, docs):
    """Rows of a registered query over docs (doc_id, text, lang, source), and those of its SQL."""
    import duckdb

    from siltstone.plans import catalog

    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    want = duckdb.connect()
    want.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    key = lambda r: tuple((x is None, str(x)) for x in r)
    return sorted(map(tuple, catalog.QUERIES[name](spark, str(folder)).collect()), key=key), sorted(want.sql(catalog.ORACLES[name]).fetchall(), key=key)


@pytest.mark.parametrize("ids, rows", [((1, 2, 600, 700, 800), 0), ((1, 2, 3, 400, 500, 600), 1)])
def test_segment_without_an_entry_before(spark, tmp_path, ids, rows):
    got, want = against_sql(spark, tmp_path, "skip_segment", [(i, "the end", "en", "s") for i in ids])
    assert got == want and len(got) == rows
    p = spark.createDataFrame([("the", i, 1) for i in ids], "term string, doc_id long, tf long")
    assert codec.segment(p, codec.skip_entries(p), 2).count() == 2  # a look-up reads from the list's head


@pytest.mark.parametrize("name", ["csv_ids", "text_folder_ids"])
def test_odd_texts_are_loaded_as_they_are(spark, tmp_path, name):
    """Missing and empty texts, white space at the ends, line ends, quotes and signs of CSV."""
    odd = [None, "", " lead", "trail \n", "\n\nx", "a\rb", "a\r\nb\r", 'q"uo"te', 'back\\"slash\\', "#hash", "NUL\0x", "\0", "a,b", "Null", "\\", '"', "\u2028z", "\r", "", "end"]
    titles = ["s", None, "", " t ", "#"]
    got, want = against_sql(spark, tmp_path, name, [(3 * i, x, "en", titles[i % 5]) for i, x in enumerate(odd)])
    assert got == want and len(got) == len(odd)


def test_differences(spark):
    left, right = (spark.createDataFrame([(x,) for x in xs], "x long") for xs in ([1, 1, 1, 2, None], [1, 2, 3, 3]))
    assert sorted(map(str, ix.differences(left, right).collect())) == sorted(["Row(x=1, side='left')"] * 2 + ["Row(x=None, side='left')"] + ["Row(x=3, side='right')"] * 2)
    plan = ix.differences(left.distinct(), right)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan ExistingRDD") == 2  # each side once


def test_packed_file(spark):
    """Records lie one behind the other in the order of terms, and a skip entry's place is where its pair begins."""
    rnd = random.Random(9)
    rows = [(t, d, rnd.randint(1, 300)) for t, k in (("b", 70), ("a", 3), ("ab", 1), ("c", 400)) for d in rnd.sample(range(4000), k)]
    p = spark.createDataFrame(rows, "term string, doc_id long, tf long")
    layout = packed_layout(p)
    records = {r.term: r for r in layout.collect()}
    file = b"".join(bytes(records[t].record) for t in sorted(records))
    assert all(file[r.start : r.start + r.length] == bytes(r.record) for r in records.values()) and len(file) == sum(r.length for r in records.values())

    def number(at):
        n = 0
        while file[at] < 128:
            n, at = n * 128 + file[at], at + 1
        return n * 128 + file[at] - 128, at + 1

    skips = file_skips(p, layout).collect()
    by_term = {t: sorted((d, f) for u, d, f in rows if u == t) for t in records}
    for s in skips:
        i = [d for d, _ in by_term[s.term]].index(s.doc_id)
        gap, at = number(s.file_offset)
        assert gap == s.doc_id - by_term[s.term][i - 1][0] and number(at)[0] == by_term[s.term][i][1]
    assert len(skips) == (70 - 1) // 8 + (400 - 1) // 20 + 2


def test_stripped(spark):
    found = spark.createDataFrame([(" \t a b\n ",), ("",), (None,)], "t string").select(text.stripped(F.col("t"))).collect()
    assert [r[0] for r in found] == ["a b", "", None]


def test_tiers_and_forms(spark, tmp_path):
    store = IndexStore(spark, f"file://{tmp_path}/t", merge_threshold=3)
    docs = lambda n: spark.createDataFrame([("t", "word")] * n, "title string, plot string")
    store.add(docs(100))
    sizes = []
    for _ in range(12):
        store.add(docs(3))
        sizes.append(sum(p["docs"] for p in store.manifest()["parts"]))
    assert sizes == [103 + 3 * i for i in range(12)] and len(store.manifest()["parts"]) <= 4
    store.delete([0, 130])
    store.add(docs(3))
    assert store.view().document_frequency("word") == 100 + 39 - 2
    # a manifest of the form before, which listed parts by name
    now = store.manifest()
    old = {k: v for k, v in now.items() if k not in ("format", "streams")} | {"parts": [p["path"] for p in now["parts"]], "version": now["version"] + 1}
    (tmp_path / "t" / "manifests" / f"v{old['version']:09d}.json").write_text(json.dumps(old))
    assert store.view().document_frequency("word") == 137
    store.add(docs(3))
    assert store.view().document_frequency("word") == 140
    later = store.manifest() | {"format": 99, "version": 10**6}
    (tmp_path / "t" / "manifests" / "v001000000.json").write_text(json.dumps(later))
    with pytest.raises(ValueError):
        store.view()


def test_tokenizer_options_hold_for_queries(spark):
    docs = spark.createDataFrame([(0, "", "the cat 9 the cats"), (1, "", "a dog")], DOCS)
    assert spark.createDataFrame([("a b a",)], "t string").select(text.stop_words_removed(text.tokens(F.col("t")), [])).first()[0] == ["a", "b", "a"]
    own = text.tokenizer(["the"], alphabetic=True, least=2, stem=lambda t: F.regexp_replace(t, "s$", ""))
    index = ix.build(docs, tokenizer=own)
    assert {(r.term, r.doc_id): r.tf for r in index.postings.collect()} == {("cat", 0): 2, ("dog", 1): 1}
    assert [r.doc_id for r in ranking.bm25(index, "cats").collect()] == [0]
    many = spark.createDataFrame([(1, "cats the")], "query_id long, query string")
    assert [r.doc_id for r in ranking.smart(index, many).collect()] == [0]
    assert index.add(2, "x", "cats").document_frequency("cat") == 2
    assert spark.range(1).select(text.term_key(F.lit("film"))).first()[0] == hashlib.md5(b"film").hexdigest()


def test_ranking_without_broadcast_and_without_statistics(spark, micro, monkeypatch):
    many = spark.createDataFrame([(5, "love story"), (6, "space alien space")], "query_id long, query string")
    rows = lambda df: sorted((r.query_id, r["rank"], r.doc_id, r.score) for r in df.collect())
    want = [rows(f(micro, many)) for f in (ranking.bm25, ranking.smart, ranking.language_model)]
    monkeypatch.setattr(ranking, "BROADCAST_TERMS", -1)
    assert [rows(f(micro, many)) for f in (ranking.bm25, ranking.smart, ranking.language_model)] == want
    bare = ix.Index(micro.postings, micro.doc_stats.where("doc_id <> 0"))
    got = {r.doc_id: r.title for r in ranking.bm25(bare, "love story").collect()}
    assert got[0] is None and len(got) == 3


def test_tasks_of_a_batch_grow_with_its_pairs(spark, micro, monkeypatch):
    """A task's share of (query, document) pairs is bounded, whatever spark.sql.shuffle.partitions is."""
    many = spark.createDataFrame([(i, "love story") for i in range(4)], "query_id long, query string")
    want = sorted(map(tuple, ranking.smart(micro, many).collect()))
    monkeypatch.setattr(ranking, "PAIRS", 2)
    for f in (ranking.bm25, ranking.smart, ranking.language_model):
        assert "hashpartitioning(doc_id#" in (plan := f(micro, many)._jdf.queryExecution().executedPlan().toString()) and re.search(r"hashpartitioning\(doc_id#\d+L?, 10\)", plan)
    assert sorted(map(tuple, ranking.smart(micro, many).collect())) == want


def test_dealt_by_document(spark, tmp_path):
    """A table of which all postings are counted is dealt by doc_id at every size, in shares of bounded size."""
    path = f"{tmp_path}/d.parquet"
    spark.range(1000).select(F.col("id").alias("doc_id"), F.lit("t").alias("source"), F.md5(F.col("id").cast("string")).alias("text"), F.lit("en").alias("lang")).write.parquet(path)
    docs = spark.read.parquet(path)
    assert readers.dealt(docs, path, whole=True, row_group=1, share=1000).rdd.getNumPartitions() > 8
    plan = ix.build(readers.parquet_documents(spark, path, whole=True)).postings._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "REPARTITION_BY_NUM" in plan
    assert ix.build(readers.parquet_documents(spark, path, whole=True)).statistics().first().n == 1000


def test_console(spark):
    from siltstone.operators import console

    docs = spark.createDataFrame([(i, f"t{i}", "red fish " * i, "1970s") for i in range(3)], "doc_id long, title string, plot string, decade string")
    out = console.report(docs, ["fish", "zzz"], ["red"])
    assert "Documents: 3" in out and "BM25, 'zzz': no document" in out and "red: in 2 documents; 1:1, 2:2" in out and "Index: 3 documents" in out
    assert console.amount(1234567.891, 2) == "1,234,567.89" and console.amount(None) == "-"


def test_reports(spark):
    docs = spark.createDataFrame([(0, "a", "one two"), (1, None, "x" * 151), (2, "b", None)], DOCS)
    assert {r.column_name: r.missing for r in reports.missing_values(docs).collect()} == {"doc_id": 0, "title": 1, "plot": 1}
    assert [r.preview for r in reports.previews(docs).collect()] == ["one two", "x" * 150 + "...", None]
    assert tuple(reports.text_lengths(docs).first()) == (79.0, 79.0, 7, 151)
    assert reports.top_terms(docs, 2).collect()[0].term == "a"


def test_streamed_documents(spark, tmp_path):
    from siltstone.streaming.ingest import ingest

    spark.createDataFrame([("a", "red fish"), ("b", "blue fish")], "title string, plot string").write.parquet(f"{tmp_path}/in")
    store = IndexStore(spark, f"file://{tmp_path}/s")
    ingest(spark.readStream.schema("title string, plot string").parquet(f"{tmp_path}/in"), store, f"{tmp_path}/c").awaitTermination(60)
    assert store.view().document_frequency("fish") == 2
    commits = tmp_path / "c" / "commits"
    for f in commits.iterdir():
        f.unlink()  # the driver died before the batch was noted; it comes again
    ingest(spark.readStream.schema("title string, plot string").parquet(f"{tmp_path}/in"), store, f"{tmp_path}/c").awaitTermination(60)
    assert store.view().document_frequency("fish") == 2 and store.manifest()["streams"] == {f"{tmp_path}/c": 0}
