"""Pairs of rows by classes of equal words, against all pairs of rows."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from narrata.operators import similarity
from narrata.plans import scoring

NAMES, TYPES = ["Red ring", "ring red", "red bolt", "old bolt bolt", "-", None], ["SMALL", "LARGE big", "", None]


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    rows = [(k, NAMES[k % 6], TYPES[k // 6 % 4], f"B{k % 2}") for k in range(120)] + [(200 + k, "red ring", "SMALL", "B7") for k in range(40)] + [(300, "red ring", "SMALL", None)]
    d = tmp_path_factory.mktemp("parts")
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_type string, p_brand string").write.parquet(f"{d}/part.parquet")
    return str(d), rows


def vectors(texts):
    counts = [Counter(re.findall("[a-z0-9]+", (t or "").lower())) for t in texts]
    df = Counter(t for c in counts for t in c)
    raw = [{t: n * (math.log((len(texts) + 1) / (df[t] + 1)) + 1) for t, n in c.items()} for c in counts]
    return [{t: w / math.sqrt(sum(v * v for v in r.values())) for t, w in r.items()} for r in raw]


def by_rows(rows):
    name, kind = vectors([r[1] for r in rows]), vectors([r[2] for r in rows])
    out = {}
    for i, a in enumerate(rows):
        for j, b in enumerate(rows):
            if a[3] is not None and a[3] == b[3] and a[0] < b[0] and (name[i].keys() & name[j].keys() or kind[i].keys() & kind[j].keys()):
                out[a[3], a[0], b[0]] = sum(v * name[j].get(t, 0) for t, v in name[i].items()) * 0.6 + sum(v * kind[j].get(t, 0) for t, v in kind[i].items()) * 0.4
    return out


def test_floor_pairs_of_copies(spark, parts):
    d, rows = parts
    got = {(r.p_brand, r.a, r.b): r.sim for r in scoring.floor_pairs(spark, d).collect()}
    assert got == pytest.approx({k: v for k, v in by_rows(rows).items() if v >= 0.65 + 1e-9}, abs=1e-6)
    # Copies are compared once: what is joined and shuffled does not grow with them.
    classes, sims = scoring._sims(spark, d)
    assert sims.count() < 200 < len(got)
    # Lists of few keys give the same pairs, each once.
    some = sims.filter("sim >= 0.65 + 1e-9")
    split = [(r.p_brand, r.a, r.b) for r in classes.expanded(some, most=3).collect()]
    assert len(split) == len(set(split)) and set(split) == set(got)


def test_dual_similarity_of_copies(spark, parts):
    d, rows = parts
    want = defaultdict(list)
    for (brand, _, _), sim in by_rows(rows).items():
        want[brand].append(sim)
    got = {r.p_brand: (r.pairs, r.best, r.mean) for r in scoring.dual_similarity(spark, d).collect()}
    assert got.keys() == want.keys() and got["B7"] == (780, 1.0, 1.0)
    for brand, sims in want.items():
        assert got[brand] == pytest.approx((len(sims), max(sims), sum(sims) / len(sims)), abs=1e-6)
    classes, sims = scoring._sims(spark, d)
    assert classes.counted(sims).filter("p_brand = 'B7'").count() == 1


def shuffled(df):
    """Rows that the exchanges of a frame have written, once it has run."""
    def walk(node):
        name = node.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            return walk(node.executedPlan())
        if name.endswith("QueryStage"):
            return walk(node.plan())
        own = node.metrics().apply("shuffleRecordsWritten").value() if name == "Exchange" else 0
        return own + sum(walk(node.children().apply(i)) for i in range(node.children().size()))

    return walk(df._jdf.queryExecution().executedPlan())


def distinct_parts(n):
    """No two parts have the same words; some words are common, some few have, some only one."""
    return [(k, f"w{k % 7} w{k % 11} w{k % 7} r{k // 3} " + (f"one{k}" if k % 5 else ""), f"T{k % 6} R{k % 97} {'x ' * (k // 300)}", f"B{k % 50 // 49}") for k in range(n)]


def test_dual_similarity_of_distinct_texts(spark, tmp_path):
    rows = distinct_parts(900) + [(2000, "lone words", None, "B9"), (2001, None, "others", "B9"), (2002, "w1 w1", "T1", None), (2003, "w1 w1", "T1", None)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_type string, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    want = defaultdict(list)
    for (brand, _, _), sim in by_rows(rows).items():
        want[brand].append(sim)
    df = scoring.dual_similarity(spark, str(tmp_path))
    got = {r.p_brand: (r.pairs, r.best, r.mean) for r in df.collect()}
    assert got.keys() == want.keys() == {"B0", "B1"}
    for brand, sims in want.items():
        assert got[brand] == pytest.approx((len(sims), max(sims), sum(sims) / len(sims)), abs=1e-6)
    # No exchange holds the pairs.
    assert shuffled(df) < 60_000 < len(want["B0"])


def test_pair_totals_of_blocks(spark, parts, tmp_path):
    """Small blocks, and few similarities at once, give the same totals."""
    spark.createDataFrame(distinct_parts(400), "p_partkey long, p_name string, p_type string, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    for d in (parts[0], str(tmp_path)):
        vectors = scoring._classes(spark, d).vectors()
        whole, *others = [
            {r.p_brand: (r.pairs, r.best, r.mean) for r in similarity.pair_totals(vectors, "p_brand", [0.6, 0.4], *sizes).collect()} for sizes in ((), (60,), (1000, 500))
        ]
        for some in others:
            assert some.keys() == whole.keys() and all(some[b] == pytest.approx(whole[b], abs=1e-9) for b in whole)


def test_block_in_steps(monkeypatch):
    rng = np.random.default_rng(7)
    lengths, share = rng.integers(1, 9, 300), np.where(np.arange(400) % 2, 0.6, 0.4)
    code = np.concatenate([rng.choice(400, k, replace=False) // (1 + rng.integers(0, 40)) for k in lengths])
    row = np.repeat(np.arange(300), lengths)
    keep = np.unique(row * 400 + code)
    row, code = np.divmod(keep, 400)
    lengths, weight, n, own = np.bincount(row, minlength=300), rng.random(len(code)), rng.integers(1, 4, 300), rng.integers(0, 2, 300)
    x = np.zeros((300, 400))
    x[row, code] = weight
    sim, rows = (x * share) @ x.T, np.outer(n, n)
    monkeypatch.setattr(similarity, "CELLS", 1000)
    for lo, hi in ((0, 0), (0, 1), (1, 1)):
        m = (own[:, None] == lo) & (own[None, :] == hi)
        times = np.where(m, rows, 0) if lo != hi else np.where(m, np.triu(rows, 1) + np.diag(n * (n - 1) // 2), 0)
        times = np.where(sim > 0, times, 0)
        got = similarity._block(own, lo, hi, n, lengths, code, weight, share)
        assert got == pytest.approx((times.sum(), sim[times > 0].max(), (sim * times).sum()))
