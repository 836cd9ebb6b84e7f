"""op1, op10 and the chunk encoder against the tokenizers library and exact round trips."""

import io
import json
import random
import struct
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from siltstone.llm import packing, sstable
from siltstone.llm.common import sized
from siltstone.llm.encoding import Encoder

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, seq long, cell string"
ODD = ["", " ", " a", "a  b", "a   b\n\n c ", "don't I'LL 's x", "a<|endoftext|> b <|startoftext|>", "\x1c a", "a \x1cb", "ΑΣ ΑΣ ΟΔΥΣΣΕΥΣ", "é ́x", "a b c", " 　 x y", "a\tb \n c d\x00 e f", "x" * 300 + " " + "y" * 90, "퟿ \U0001f600 ok"]


def rows():
    out = [(i, t, None, None, None, "k", 1, "c") for i, t in enumerate(ODD)]
    out += [(100, None, "en", "s", 3, None, None, None), (None, "no id here", None, None, None, None, None, None), (None, "no id here", None, None, None, None, None, None)]
    out += [(7, "again the same id", None, None, None, None, None, None)] * 3 + [(200, "long text, " * 9000, None, None, None, None, None, None)]
    rnd = random.Random(4)
    return out + [(1000 + i, " ".join(rnd.choices(["alpha", "beta", "gamma", "Delta."], k=rnd.randint(1, 900))), "en", "s", 1, "", 0, "") for i in range(120)]


ODD += ["\n", "\n\n", "a\n\n\nb", "a\nb \nc", "\na", "x\n", "İa ıI ȺȾ Ɂ", "l'std we'll 've", "a1b2 ²³ ½x «q» ¿Que? (word) a'", "\xad \x85a \xa0b", "日本語 text 漢字. Привет мир!", "a\u2003b c", "\0 a\0b", "pre<|endoftext|>post", "é" * 60 + "."]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_chunks_give_the_ids_of_the_whole_text(name):
    chunked, whole = Encoder(P.path(name)), Tokenizer.from_file(P.path(name))
    assert chunked.kind != "whole" and chunked.quick
    rnd = random.Random(name)
    signs = ["a", "b", "é", "Ü", "1", "'s", "'", ".", "-", " ", " ", "  ", "\n", "\t", "ß", "ll", "日", "\xa0"]
    made = ODD + ["".join(rnd.choices(signs, k=rnd.randint(1, 40))) for _ in range(3000)]
    for text, ids in zip(made, chunked.ids(made), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids, repr(text)
    ids, at = chunked.encode(pa.array([None, "", "two words"]), 7)
    assert at[:3].tolist() == [0, 1, 2] and ids[[0, 1, -1]].tolist() == [7] * 3
    ids, at = chunked.encode(pa.array([], pa.string()), 7)
    assert len(ids) == 0 and at.tolist() == [0]


def test_unknown_splitting_is_left_to_the_library(tmp_path):
    """A file that splits otherwise is not cut at spaces."""
    file = json.loads(open(P.path("word_bpe_49k.json")).read())
    file["pre_tokenizer"]["pretokenizers"][0]["pattern"] = {"Regex": "[a-z ]+"}
    (tmp_path / "t.json").write_text(json.dumps(file))
    mine, whole = Encoder(str(tmp_path / "t.json")), Tokenizer.from_file(str(tmp_path / "t.json"))
    assert mine.kind == "whole"
    for text in ODD:
        assert np.frombuffer(mine.ids([text])[0], "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids


def test_batches_of_bounded_size():
    rnd = random.Random(6)
    rows = [(i, rnd.choice([None, "", "x" * rnd.randint(0, 30), "y" * 200])) for i in range(400)]
    table = pa.table({"i": [i for i, _ in rows], "t": [t for _, t in rows]})
    for step in (1, 7, 400):
        out = list(sized(table.to_batches(step), 1, 100))
        assert [tuple(r.values()) for b in out for r in b.to_pylist()] == rows
        assert all(b.num_rows == 1 or sum(len(t or "") for t in b.column(1).to_pylist()) <= 100 for b in out)
        assert len(out) < 300
    assert list(sized([], 1, 100)) == []


def test_shard_round_trip_and_lookup():
    out = io.BytesIO()
    writer = sstable.ShardWriter(out, block_bytes=200)
    entries = [(sstable.key_bytes(k), bytes([k % 251]) * (k % 40)) for k in sorted([-5, -5, *range(0, 900, 3), 6, 6, 1 << 62])]
    entries = [(sstable.key_bytes(None), b"null"), *entries]
    for k, v in entries:
        writer.add(k, v, len(v))
    size = writer.close()
    data = out.getvalue()
    assert size == len(data)
    shard = sstable.Shard(lambda p, n: data[p : p + n], size)
    assert list(shard.scan()) == entries and len(shard.index) > 5 and shard.entries == len(entries)
    for k in (None, -5, 6, 300, 1 << 62):
        assert shard.get(sstable.key_bytes(k)) == [v for key, v in entries if key == sstable.key_bytes(k)]
    assert shard.get(sstable.key_bytes(7)) == [] and shard.get(sstable.key_bytes(5000)) == []
    assert sum(shard.maybe(sstable.key_bytes(k)) for k in range(10_000, 11_000)) < 60
    assert [sstable.key_value(sstable.key_bytes(v)) for v in (None, -3, 9, "é")] == [None, -3, 9, "é"]
    with pytest.raises(ValueError):
        sstable.Shard(lambda p, n: (data[:-70] + b"x" + data[-69:])[p : p + n], size)


def test_op1_against_the_library(spark):
    whole = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    store = sstable.write_tokens(spark, spark.createDataFrame(rows(), SCHEMA), P.path("byte_bpe_50k.json"), 2, shard_bytes=3000)
    got = store.documents().collect()
    assert store.manifest.count() > 1
    want = {}
    for r in rows():
        want.setdefault(r[0], []).append(whole.encode(r[1] or "", add_special_tokens=False).ids + [2])
    assert len(got) == len(rows())
    for r in got:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        want[r.key].remove(ids)
        assert r.n_tokens == len(ids)
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    order = [r.key for r in sorted(got, key=lambda r: r.start)]
    assert order == sorted(order, key=lambda k: (k is not None, k))
    found = store.lookup(spark.createDataFrame([(7,), (200,), (999,), (1005,)], "doc_id long")).collect()
    assert sorted(r.key for r in found) == [7, 7, 7, 7, 200, 1005]
    assert store.lookup(spark.createDataFrame([(None,)], "doc_id long")).count() == 2


def test_op1_small_shards_share_tasks_and_a_manifest_file(spark):
    """Many tiny shards are neither a manifest file nor a task each."""
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(400)], "doc_id long, text string")
    held = {"spark.sql.shuffle.partitions": "20", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        store = sstable.write_tokens(spark, docs, P.path("byte_bpe_50k.json"), 2)
        few, shards = store.documents(), store.manifest.count()
        assert shards > 10 and len(store.manifest.inputFiles()) == 1
        assert few.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism < shards
        each = store.documents(task_bytes=1)
        assert each.rdd.getNumPartitions() == shards
        # one shard a task
        assert each.mapInArrow(lambda batches: iter([pa.RecordBatch.from_arrays([pa.array([sum(b.num_rows for b in batches)])], ["n"])]), "n long").filter("n > 0").count() == shards
        got = sorted(map(tuple, few.collect()))
        assert got == sorted(map(tuple, each.collect())) and [r[0] for r in got] == list(range(400))
        assert [r[1] for r in got] == [sum(r[2] for r in got[:i]) for i in range(400)]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_op1_of_nothing(spark):
    store = sstable.write_tokens(spark, spark.createDataFrame([], SCHEMA), P.path("byte_bpe_50k.json"), 2)
    assert store.documents().count() == 0


def test_least_squares():
    rnd = np.random.default_rng(3)
    for _ in range(20):
        a, b = rnd.random((6, 9)), rnd.random(6) - 0.2
        x = packing.nonnegative_least_squares(a, b)
        slope = a.T @ (b - a @ x)
        assert x.min() >= 0 and slope.max() < 1e-6 and abs(slope[x > 0]).max(initial=0) < 1e-6


def check_pieces(pieces, docs, window=4096):
    """Each id lies in exactly one piece and each sequence is gapless; the tokens of padding."""
    by_doc, by_seq = {}, {}
    for p in pieces:
        by_seq.setdefault(p.sequence_id, []).append((p.offset, p.length))
        by_doc.setdefault(p.doc_id, []).append(p)
    for k, texts in docs.items():
        left = [bytes(t) for t in texts]
        got = sorted(by_doc.pop(k), key=lambda p: p.start)
        assert sum(p.length for p in got) == sum(len(t) for t in left) // 4
        for p in got:
            part = [t for t in left if bytes(p.ids) == t[p.start * 4 : (p.start + p.length) * 4] and p.doc_tokens == len(t) // 4]
            assert part
        if len(left) == 1:
            assert b"".join(bytes(p.ids) for p in got) == left[0]
    assert not by_doc
    waste = 0
    for parts in by_seq.values():
        at = 0
        for off, n in sorted(parts):
            assert off == at and n > 0
            at += n
        assert at <= window
        waste += 0 if at & (at - 1) == 0 else window - at
    return waste


def test_op10_pieces(spark):
    whole = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    docs = {}
    for r in rows():
        docs.setdefault(r[0], []).append(struct.pack(f"<{(n := len(ids := whole.encode(r[1] or '', add_special_tokens=False).ids + [2]))}I", *ids) if True else n)
    pieces = packing.pack(spark, spark.createDataFrame(rows(), SCHEMA), P.path("word_bpe_49k.json")).collect()
    total = sum(p.length for p in pieces)
    assert check_pieces(pieces, docs) <= max(4096, total * 0.02)


def test_op10_of_nothing_and_of_one(spark):
    assert packing.pack(spark, spark.createDataFrame([], SCHEMA), P.path("word_bpe_49k.json")).count() == 0
    one = packing.pack(spark, spark.createDataFrame([(None,) * 8], SCHEMA), P.path("word_bpe_49k.json")).collect()
    assert [(p.doc_id, p.start, p.length, bytes(p.ids), p.doc_tokens, p.offset) for p in one] == [(None, 0, 1, struct.pack("<I", 2), 1, 0)]


def test_digest_is_of_the_ids(spark):
    assert zlib.crc32(struct.pack("<I", 2)) == packing.packed_digest(spark, spark.createDataFrame([(1, "")], "doc_id long, text string")).first().ids_crc32
