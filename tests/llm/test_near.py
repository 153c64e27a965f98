import random

import corpus_pipeline
from conftest import SCHEMA

from narrata.llm import simhash


def jaccard(a, b, width=5):
    sets = [{tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} for w in (a.lower().split(), b.lower().split())]
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def changed(rnd, text, n):
    words = text.split()
    for i in rnd.sample(range(len(words)), n):
        words[i] = f"other{rnd.randrange(10**9)}"
    return " ".join(words)


def frame(spark, pairs):
    return spark.createDataFrame([(i, t, "en", "s", 0, "x", "y") for i, t in pairs], SCHEMA)


def groups(texts):
    """The least id of each text's component, by comparing all pairs."""
    of = {i: i for i in texts}
    near_pairs = [(a, b) for a in texts for b in texts if a < b and jaccard(texts[a], texts[b]) >= 0.8]
    for _ in texts:
        for a, b in near_pairs:
            of[a] = of[b] = min(of[a], of[b])
    return of


def test_near_copies_by_jaccard(spark):
    rnd, texts = random.Random(7), {}
    for g in range(30):
        base = " ".join(f"w{rnd.randrange(5000)}" for _ in range(150 + 8 * g))
        for n in (0, 1, 2, 3, 4, 6, 12, 40):
            texts[len(texts)] = changed(rnd, base, n)
    of = groups(texts)
    kept = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, frame(spark, texts.items()), "").collect()}
    assert kept == set(of.values())
    assert len(kept) < len(texts) / 2


def test_blocks_chains_and_rows(spark):
    """Drifting copies share keys without being near their first row; small blocks; verdicts for rows, not ids."""
    rnd, texts = random.Random(5), {}
    text = " ".join(f"w{i}" for i in range(200))
    for i in range(40):
        texts[i] = text
        text = changed(rnd, text, 2)
    assert set(groups(texts).values()) == {0}
    rows = [*texts.items(), (3, "quite another text of the same id that nobody else has"), (None, changed(rnd, texts[0], 1)), (None, "no id but clean"), (50, None), (51, " \n")]
    for large in (10**6, 3):
        out = simhash.without_near_copies(frame(spark, rows), block=4, large=large)
        assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted([(0, texts[0]), (3, rows[40][1]), (None, "no id but clean"), (50, None)], key=str)


def test_no_rows(spark):
    assert simhash.without_near_copies(frame(spark, [])).count() == 0


def test_one_row_of_equal_texts_stays(spark):
    rows = [(1, "a text"), (1, "a text"), (1, "another text"), (2, "a  text"), (None, "no id"), (None, "no id"), (3, "a text"), (4, None), (4, "")]
    out = corpus_pipeline.drop_copies(spark, frame(spark, rows), "")
    assert sorted(((r.doc_id, r.text or "") for r in out.collect()), key=str) == sorted([(1, "a text"), (1, "another text"), (None, "no id"), (4, "")], key=str)
    assert out.columns == frame(spark, []).columns


def test_large_keys_are_compared(spark):
    """Two texts at 0.8 that share a single key, one of over ``large`` rows: pairs with their other keys do not find them."""
    words = "w876 w384 w193 w778 w41 w640 w893 w416 w708 w861 w845 w725 w726".split()
    texts = {1: " ".join(words), 2: " ".join(words[:-1] + ["other"])}
    keys = [set(simhash.bands(simhash.shingles(t.encode()))) for t in texts.values()]
    assert jaccard(*texts.values()) == 0.8 and len(keys[0] & keys[1]) == 1
    assert [r.doc_id for r in simhash.without_near_copies(frame(spark, texts.items()), large=1).collect()] == [1]


def test_blocks_of_a_large_key(spark):
    """Rows of one key in several components, over many blocks: every link between components is found, blocks of one are not dealt."""
    rnd = random.Random(11)
    base = [f"w{i}" for i in range(60)]
    texts = {i: " ".join(base[:-1] + [f"x{i}"]) for i in range(40)} | {100 + i: changed(rnd, " ".join(base), 2) for i in range(6)}
    sets = {i: simhash.shingles(t.encode()) for i, t in texts.items()}
    fps = {i: simhash._signed(simhash.of_hashes(s)) for i, s in sets.items()}
    mixed = spark.createDataFrame([(1, i, 0 if i < 40 else i, fps[i], len(sets[i])) for i in texts], "key long, row long, component long, fp long, size int")
    stored = spark.createDataFrame([(i, bytearray(s.tobytes())) for i, s in sets.items()], "row long, s binary")
    dealt = simhash._dealt(mixed, stored, simhash.common.shared_dir(spark), block=4).cache()
    of = {i: 0 if i < 40 else i for i in texts}
    near = {(of[a], of[b]) for a in texts for b in texts if of[a] < of[b] and jaccard(texts[a], texts[b]) >= 0.8}
    links = {tuple(sorted((of[r.a], of[r.b]))) for r in dealt.groupBy("key", "i", "j").applyInArrow(simhash._set_links, "a long, b long").collect()}

    def joined(pairs):
        root = {c: c for c in set(of.values())}
        for _ in root:
            for a, b in pairs:
                root[a] = root[b] = min(root[a], root[b])
        return root

    assert near and links <= near and joined(links) == joined(near)
    assert dealt.filter("component = 0").groupBy("row").count().agg({"count": "max"}).first()[0] <= 4 < 12
