import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from conftest import SCHEMA, TEXTS
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from narrata.llm import bpe, common, mixing, wavelet

JSON, RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
PIECES = ["a", "the", " ", " ", "  ", "\n", "\n\n", "\t", "\r\n", "é", "ß", "ñ", "中", "😀", "\0", "'s", "12", "٣", ".", ",", "<|endoftext|>", "\x1c", "\x85", "​", " ", "Word"]


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(8)
    return ["".join(rnd.choices(PIECES, k=rnd.randrange(25))) for _ in range(3000)] + ["", " ", "\n", "a" * 20000, " " * 500, "\0"]


def test_ids_are_the_libraries(texts):
    hf = Tokenizer.from_file(JSON)
    hf.encode_special_tokens = True
    tt = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
    usual = Tokenizer.from_file(JSON)
    for enc, plain in (
        (bpe.Encoder(JSON), lambda t: hf.encode(t, add_special_tokens=False).ids),
        (bpe.Encoder(JSON, special=True), lambda t: usual.encode(t, add_special_tokens=False).ids),
        (bpe.Encoder(RANKS, PATTERN), tt.encode_ordinary),
    ):
        for at in range(0, len(texts), 700):
            part = texts[at : at + 700]
            ids, lens = enc.encode(part)
            ends = np.cumsum(lens)
            for t, e, n in zip(part, ends, lens):
                assert ids[e - n : e].tolist() == plain(t), repr(t)
                assert enc.decode(ids[e - n : e]) == t.encode()


def test_offsets():
    enc = bpe.Encoder(RANKS, PATTERN)
    text = "né 😀x"
    ids, _ = enc.encode([text])
    starts, ends = enc.offsets(ids)
    for i, a, b in zip(ids, starts, ends):
        assert enc.tokens[i] in text[a:b].encode()
    assert starts[0] == 0 and ends[-1] == len(text)


def test_round_trip(docs, empty):
    tt = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
    want = []
    for d, t, _, _ in TEXTS:
        ids = tt.encode_ordinary(t or "")
        want.append((str(d), len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    got = bpe.round_trip(docs, RANKS, PATTERN).collect()
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == sorted(want)
    full = bpe.encode(docs, RANKS, PATTERN)
    assert sorted(bytes(r.text) for r in bpe.decode(full, RANKS, PATTERN).collect()) == sorted((t or "").encode() for _, t, _, _ in TEXTS)
    assert bpe.round_trip(empty, RANKS, PATTERN).count() == 0


@pytest.mark.parametrize("ids", [[], [0], [5, 5, 5], list(range(300)) * 5, np.random.default_rng(0).integers(0, 100_000, 4000).tolist()])
def test_wavelet_matrix(ids):
    m = wavelet.WaveletMatrix(wavelet.pack(np.array(ids, np.uint32)))
    assert m.to_ids().tolist() == list(ids)
    for p in range(0, len(ids), max(1, len(ids) // 40)):
        v = ids[p]
        assert m.access(p) == v and m.count(v, p) == ids[:p].count(v) and m.select(v, ids[:p].count(v)) == p
    assert m.count(77_777_777) == 0 and m.select(3, 10**6) == -1


def test_lookups_open_few_chunks():
    """A lookup in a file of many chunks opens at most a few per level."""
    rnd = np.random.default_rng(3)
    ids = rnd.integers(0, 50_000, 1_000_000).astype(np.uint32)
    data = wavelet.pack(ids)
    places = np.flatnonzero(ids == ids[777_777])
    for look, want in (
        (lambda m: m.access(777_777), ids[777_777]),
        (lambda m: m.count(int(ids[777_777])), len(places)),
        (lambda m: m.select(int(ids[777_777]), len(places) - 1), places[-1]),
    ):
        m = wavelet.WaveletMatrix(data)
        assert look(m) == want and 0 < m.opened <= 3 * m.width < sum(map(len, m.ends)) / 4


def test_shards(spark, docs, empty):
    hf = Tokenizer.from_file(JSON)  # the library's defaults, special tokens' strings included
    for size in (1 << 20, 7):
        path = f"{common.shared_dir(spark)}/shards"
        got = wavelet.read(wavelet.write(docs, path, JSON, shard_ids=size)).orderBy("start").collect()
        start = 0
        for r, (d, t, _, _) in zip(got, sorted(TEXTS, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or ""))):
            ids = [*hf.encode(t or "", add_special_tokens=False).ids, 0]
            assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
            start += len(ids)
    assert wavelet.read(wavelet.write(empty, f"{common.shared_dir(spark)}/none", JSON)).count() == 0


def test_mix(spark, docs, empty):
    rows = mixing.mix(docs).collect()
    size = {str(d): len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t, _, _ in TEXTS}
    assert len(rows) == len(TEXTS) and all(r.size == size[str(r.doc_id)] and 0 <= r.taken <= 2 * r.size for r in rows)
    per = {}
    for r in rows:
        x = per.setdefault(r.source, [0, 0, r.target, r.source_size])
        x[0] += r.taken
        x[1] += r.size
    assert all(taken == int(target + 0.5) and s == total for taken, total, target, s in per.values())
    assert abs(sum(x[2] for x in per.values()) - 1.5 * sum(size[str(d)] for d, _, _, _ in TEXTS)) < 1e-6
    assert sorted(map(str, mixing.mix(docs).collect())) == sorted(map(str, rows)) and mixing.mix(empty).count() == 0


def test_targets_share_the_excess(spark):
    s = spark.createDataFrame([("a", 10, 1), ("b", 1000, 1), ("c", 1000, 1), (None, 500, 1)], "source string, source_size long, n long")
    got = {r.source: r.target for r in mixing.targets(s, (5, 2, 1), 1.5, 2).collect()}
    size, weight = {"a": 10, "b": 1000, "c": 1000, None: 500}, {"a": 5, "b": 2, "c": 1, None: 5}
    want, open_, left = {}, set(size), 1.5 * 2510
    while True:
        level = left / sum(weight[k] for k in open_)
        over = {k for k in open_ if level * weight[k] > 2 * size[k]}
        if not over:
            break
        for k in over:
            want[k] = 2.0 * size[k]
            left -= want[k]
        open_ -= over
    want |= {k: level * weight[k] for k in open_}
    assert all(abs(got[k] - want[k]) < 1e-6 for k in want)


def test_large_source_in_ranges(spark):
    df = spark.range(30_000).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"), F.when(F.col("id") % 3 == 0, "hot").otherwise("x").alias("source"))
    out = mixing.mix(df).groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g"), F.max("taken").alias("m")).collect()
    assert all(abs(r.t - r.g) <= 0.5 and r.m <= 6 for r in out)


def test_schema_is_documents(spark, docs):
    assert docs.schema.simpleString() == spark.createDataFrame([], SCHEMA).schema.simpleString()
