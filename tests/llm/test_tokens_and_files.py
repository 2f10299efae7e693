"""Token ids, bit-plane files and packing: exact round trips."""

import io
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from textsluice.llm import bitplane, common
from textsluice.llm.bitplane import PlaneReader, PlaneWriter, from_planes, round_trip, to_planes
from textsluice.llm.packing import Schedule, pack
from textsluice.llm.tokens import WordEncoder, chunks, default_tokenizer

from test_dedup_and_joins import corpus, docs

TEXTS = [
    "Don't stop, e-mail me.", "", None, "İstanbul ΑΣ ́x ٣x", "a\x0bb\x0cc\x1cd e f", "<|endoftext|> x<|startoftext|>y", "日本語 🙂‍ ﬁ", "a" * 50_000, "word " * 3000,
]


def reference(texts):
    t = Tokenizer.from_file(default_tokenizer())
    return [np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], "<u4") for x in texts]


def test_encoder_equals_the_tokenizer():
    encoder = WordEncoder(default_tokenizer())
    for _ in range(2):  # from a cold and from a warm cache
        ids, lengths = encoder.encode(pa.array(TEXTS))
        for got, want in zip(np.split(ids, np.cumsum(lengths)[:-1]), reference(TEXTS), strict=True):
            assert got.tolist() == want.tolist()
    assert [len(c) for _, c in chunks(pa.array(["aa", "b" * 20, "c"]), 5)] == [1, 1, 1]


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_planes_and_files(kind):
    rng = np.random.default_rng(1)
    for top in (1, 2, 300, 70_000, 2**32):
        ids = rng.integers(0, top, 1000).astype("<u4")
        assert (from_planes(to_planes(ids, kind), 1000, kind) == ids).all()
    sink, all_ids = io.BytesIO(), rng.integers(0, 50_000, 200_000).astype("<u4")
    writer = PlaneWriter(sink, kind)
    lengths = np.array([0, 70_000, 1, 129_999], np.int64)
    writer.add([3, None], all_ids[:70_000], lengths[:2])
    writer.add([5, 9], all_ids[70_000:], lengths[2:])
    assert writer.close()[:2] == (4, 200_000)
    reader = PlaneReader(sink)
    assert (reader.ids(65_000, 140_000) == all_ids[65_000:140_000]).all()
    found = [(d, s, np.concatenate([*p, np.zeros(0, "<u4")])) for d, s, p in reader.documents()]
    assert [f[0] for f in found] == [3, None, 5, 9]
    assert all((x == all_ids[s : s + n]).all() and len(x) == n for (_, s, x), n in zip(found, lengths, strict=True))
    with pytest.raises(ValueError, match="bit-plane"):
        PlaneReader(io.BytesIO(sink.getvalue()[:-1]))


def test_round_trip(spark):
    rows = [(i * 7 % 31, t, None, None, None) for i, t in enumerate(TEXTS)] + corpus(60)[20:]
    rows = list({r[0]: r for r in rows}.values())
    got = {r.doc_id: r for r in round_trip(docs(spark, rows).repartition(5)).collect()}
    start = 0
    for (i, *_), ids in zip(sorted(rows), reference([r[1] for r in sorted(rows)]), strict=True):
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert round_trip(docs(spark, [])).count() == 0


def test_round_trip_holds_few_texts_gives_memory_back_and_makes_one_index_file(spark, monkeypatch):
    tidied = []
    monkeypatch.setattr(bitplane, "tidy", lambda run, encodes=False: tidied.append(encodes) or common.tidy(run, encodes), raising=False)
    forty = docs(spark, [(i, "some words", None, None, None) for i in range(40)])
    assert round_trip(forty).count() == 40
    assert tidied == [True, False]

    def sizes(folder, tokenizer, kind):
        def write(batches):
            for b in batches:
                yield pa.RecordBatch.from_pydict({"part": pa.array([0], pa.int32()), "path": [""], "docs": [b.num_rows], "ids": [0], "bytes": [0]})

        return write

    monkeypatch.setattr(bitplane, "_write", sizes)
    monkeypatch.setattr(bitplane, "read_ids", lambda index, folder: index)
    monkeypatch.setattr(common, "TEXT_ROWS", 3)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several tasks that write
    try:
        index = round_trip(forty)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    n = [r.docs for r in index.collect()]
    assert sum(n) == 40 and max(n) <= 3
    assert len(index.inputFiles()) == 1


def test_schedule_is_gapless_and_keeps_to_the_targets():
    s = Schedule([10_000, 5_000, 50], [2.0, 1.0, 0.0], 1024)
    spans = sorted((at, b - a, k) for k, n in enumerate([10_000, 5_000, 50]) for a, b, at in s.spans(k, 0, n))
    end, seen = 0, [0, 0, 0]
    for at, n, k in spans:
        assert at == end
        end, seen[k] = at + n, seen[k] + n
        if k == 1 and end < 14_000:
            assert abs(seen[0] - 2 * seen[1]) <= 4  # what is carried on stays below a token or so
    assert end == 15_050 and spans[-1][2] == 2


def test_pack(spark):
    rows = [(i, t, "en", None if i % 3 else "s", 0) for i, t in enumerate(TEXTS)] + [(50 + i, *r[1:]) for i, r in enumerate(corpus(60))]
    for targets in (None, {"s": 3.0, "s0": 1.0}):
        pieces = pack(docs(spark, rows).repartition(4), targets=targets, seq_len=256, window_sequences=4).withColumn("crc", F.crc32("ids")).collect()
        by_doc, by_seq = {}, {}
        for p in pieces:
            by_doc.setdefault(p.doc_id, []).append(p)
            by_seq.setdefault(p.sequence_id, []).append(p)
        for (i, *_), ids in zip(rows, reference([r[1] for r in rows]), strict=True):
            at = 0
            for p in sorted(by_doc[i], key=lambda p: p.start):
                assert (p.start, p.doc_tokens, p.crc) == (at, len(ids), zlib.crc32(ids[at : at + p.length].tobytes()))
                at += p.length
            assert at == len(ids)
        full = 0
        for own in by_seq.values():
            at = 0
            for p in sorted(own, key=lambda p: p.offset):
                assert p.offset == at
                at += p.length
            full += at == 256
            assert at <= 256
        assert full >= len(by_seq) - 1
    assert pack(docs(spark, [])).count() == 0


def test_a_later_stage_lets_encoders_go():
    from textsluice.llm import common, tokens

    tokens.encoder(tokens.default_tokenizer())
    assert list(common.tidy(iter, encodes=True)(iter([1]))) == [1] and tokens.encoder.cache_info().currsize
    assert list(common.tidy(iter)(iter([1]))) == [1] and not tokens.encoder.cache_info().currsize
