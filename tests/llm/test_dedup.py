import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from conftest import SCHEMA, TEXTS
from pyspark.sql import functions as F

from narrata.llm import exact, simhash, suffix

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_fingerprint(text, width=4):
    words = WORD.findall((text or "").translate(LOW))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(rows):
    root = list(range(len(rows)))
    fps = [plain_fingerprint(t) for _, t in rows]

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted((str(d), f"{fps[i]:016x}", str(least.get(find(i)))) for i, (d, _) in enumerate(rows))


@pytest.mark.parametrize("hot, block", [(32, 1024), (1, 2)])
def test_simhash_against_brute_force(spark, hot, block):
    rnd = random.Random(5)
    base = [" ".join(rnd.choices("alpha beta gamma delta epsilon zeta eta theta".split(), k=60)) for _ in range(6)]
    texts = [(i, t) for i, (_, t, _, _) in enumerate(TEXTS)]
    for b in base:
        for _ in range(12):
            w = b.split()
            w[rnd.randrange(60)] = "changed"
            texts.append((len(texts), " ".join(w)))
    df = spark.createDataFrame([(i, t, "en", "a", 0, "x", "y") for i, t in texts], SCHEMA)
    got = simhash.near_duplicates(df, hot=hot, block=block).collect()
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in got) == brute_components(texts)


def test_pigeonring_loses_no_link(spark):
    rnd = random.Random(1)
    fps = set()
    for _ in range(40):
        c = rnd.getrandbits(64)
        fps |= {c, *(c ^ sum(1 << b for b in rnd.sample(range(64), k)) for k in (1, 2, 3, 4, 4, 5))}
    signed = [int(np.uint64(f).view(np.int64)) for f in fps]
    from narrata.llm import common
    got = {(r.a, r.b) for r in simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), common.shared_dir(spark), hot=10**6).distinct().collect()}
    want = {(min(a, b), max(a, b)) for a in signed for b in signed if a < b and (int(np.int64(a).view(np.uint64)) ^ int(np.int64(b).view(np.uint64))).bit_count() <= 4}
    assert got == want


def test_simhash_edges(docs, empty):
    assert simhash.near_duplicates(docs).count() == len(TEXTS)
    assert simhash.near_duplicates(empty).count() == 0


def test_exact(docs, empty):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = {}
    for d, t, _, _ in TEXTS:
        groups.setdefault(norm(t), []).append(d)
    want = []
    for d, t, _, _ in TEXTS:
        ids = groups[norm(t)]
        keep = min((i for i in ids if i is not None), default=None)
        want.append((str(d), str(keep), len(ids), d == keep, hashlib.sha256(norm(t).encode()).hexdigest()))
    collide = (F.length("norm") % 3).cast("long")  # few hashes, so that chains hold several texts
    for kw in ({}, {"capacity": 1, "depth": 0}, {"capacity": 2, "hashed": collide}):
        got = [(str(r.doc_id), str(r.keep_id), r.group_size, r.kept, r.text_sha256) for r in exact.exact_duplicates(docs, **kw).collect()]
        assert sorted(got) == sorted(want)
    assert exact.exact_duplicates(empty).count() == 0


def test_bitmap_misses_nothing(spark):
    rnd = random.Random(6)
    hashes = [rnd.getrandbits(64) - (1 << 63) for _ in range(3000)]
    rows, held = (spark.createDataFrame([(h,) for h in x], "h long") for x in (hashes, hashes[::3]))
    got = [r.h for r in exact.probably_in(rows, held).collect()]
    assert set(hashes[::3]) <= set(got) and len(got) < 1300
    assert exact.probably_in(rows, held.filter("false")).count() == 0


def test_one_row_stays(spark):
    rows = [(1, "a"), (1, "a"), (None, "a"), (None, "b"), (None, "b"), (2, None), (2, ""), (3, "c")]
    df = spark.createDataFrame([(i, t, "en", "a", n, "x", "y") for n, (i, t) in enumerate(rows)], SCHEMA)
    got = exact.exact_duplicates(df, carry=("n_chars",)).filter("stays").collect()
    assert sorted(r.c_n_chars for r in got) == [0, 3, 5, 7]


def test_directory_doubles(spark):
    from narrata.llm import common
    even = spark.createDataFrame([(i << 58,) for i in range(-32, 32)], "h long")
    cells = exact.directory(even, common.shared_dir(spark), 4, 0).collect()
    assert {c.depth for c in cells} == {4} and len({c.bucket for c in cells}) == 16 and len(cells) == 64
    skewed = spark.createDataFrame([(i,) for i in range(50)] + [(1 << 62,)], "h long")
    cells = exact.directory(skewed, common.shared_dir(spark), 4, 2).collect()  # splits go on to the last bits
    assert max(c.depth for c in cells) == 62 and len(cells) == 51
    assert all(c.h >> (64 - c.depth) << (64 - c.depth) == c.bucket for c in cells if c.depth)
    assert max(Counter((c.depth, c.bucket) for c in cells).values()) <= 4


def test_index_chains_collisions(spark, docs):
    """Texts of one hash are one chain: its entries differ in bytes, and each document is in the entry of its own."""
    from narrata.llm import common
    index = exact.build_index(docs, common.shared_dir(spark), hashed=F.lit(7).cast("long")).collect()
    norm = {re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t, _, _ in TEXTS}
    assert {r.h for r in index} == {7} and {r.chain for r in index} == set(range(1, len(norm) + 1))
    assert sum(len(r.members) for r in index) == len(TEXTS)


def brute_removal(rows, length):
    seen, out = set(), []
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            if w in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(w)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("length, k, hot, block", [(100, 40, 20000, 1 << 20), (20, 8, 2, 400), (12, 4, 10**6, 100)])
def test_suffix_against_brute_force(spark, length, k, hot, block):
    rnd = random.Random(length)
    passage = "".join(rnd.choices("abcd é", k=150))
    texts = [None, "", "short", "ab" * 150, "ab" * 151, passage] + [
        "".join(rnd.choices("abcdefgh ", k=rnd.randrange(120))) + passage[rnd.randrange(50) : 150 - rnd.randrange(30)] + "".join(rnd.choices("xyz", k=rnd.randrange(60))) for _ in range(25)]
    rows = [(i * 3, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame([(i, t, "en", "a", 0, "x", "y") for i, t in rows], SCHEMA).repartition(3)
    got = suffix.remove_repeats(df, length, k=k, hot=hot, block=block).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute_removal(rows, length)
    assert all(sum(s.end - s.start for s in r.spans) == r.n_removed for r in got)


def test_matching_statistics():
    """The index's statistics, rows and classes against a plain suffix order."""
    rnd = random.Random(4)
    for trial in range(12):
        base = bytes(rnd.choices(b"ab\0\xff", k=60))
        texts = [base[rnd.randrange(30) : rnd.randrange(31, 60)] + bytes(rnd.choices(b"ab", k=rnd.randrange(12))) for _ in range(15)] + [b"a" * 40, b"a" * 40]
        index = suffix.RunLengthIndex(texts, 9)
        places = [(t, p) for t in range(len(texts)) for p in range(len(texts[t]) + 1)]
        plain = sorted(places, key=lambda x: (texts[x[0]][x[1] :], x))
        flat, stats = {x: int(index.starts[x[0]]) + x[1] for x in places}, index.statistics()
        for a, b in zip(plain, plain[1:]):
            x, y = texts[a[0]][a[1] :], texts[b[0]][b[1] :]
            shared = next((i for i in range(min(len(x), len(y))) if x[i] != y[i]), min(len(x), len(y)))
            assert stats[flat[b]] == shared
        windows = np.array([max(0, len(t) - 8) for t in texts])
        of = {}
        for t, p, c in zip(*index.classes(windows)):
            of.setdefault(int(c), set()).add(texts[t][p : p + 9])
        assert all(len(x) == 1 for x in of.values()) and len(of) == len({x for v in of.values() for x in v})


def test_suffix_edges(docs, empty):
    got = suffix.remove_repeats(docs).collect()
    assert len(got) == len(TEXTS) and {r.doc_id: r.n_bytes for r in got}[4] == 0
    assert suffix.remove_repeats(empty).count() == 0


def test_long_text_in_pieces():
    text = bytes(random.Random(2).choices(b"abc", k=5000))
    m, d, p, n = suffix.parsed([b"x" * 10, text], 100, 20, most=700)
    assert sorted(a + j for a, c in zip(p.tolist(), n.tolist()) for j in range(c)) == list(range(5000 - 99)) and set(d.tolist()) == {1}
