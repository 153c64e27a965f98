"""Toxicity by gradient-boosted trees over dense features, calibrated by isotonic regression.

A lexicon of words and word beginnings is learned from labelled rows by log
odds; each text then gives a short vector: densities of lexicon hits, how near
they are to a second-person pronoun, rates of capitals, punctuation and
obfuscated words.  The model is fitted on a bounded sample of labelled rows
(``FIT_ROWS``); features and scores cover every whole text.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Labelled rows that a model is fitted on, at most: those with the least hash of their id.
FIT_ROWS = 20_000
#: Entries of the learned lexicon, at most.
LEXICON = 600
#: Bytes of word beginnings that count as lexicon candidates beside whole words.
STEMS = (4, 5, 6)
#: Bytes by which a longer word is known.
LONGEST = 40
#: Second-person pronouns of a few languages.
SECOND_PERSON = frozenset("you your yours yourself u ur thou thee du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos usted ustedes vosotros tú ti tuyo vuestro".encode().split())
#: ASCII capitals to small letters; ASCII punctuation and control characters to spaces.
PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
#: Letters that digits and signs stand for in obfuscated words.
LEET = bytes.maketrans(b"013457@$!", b"oieastasi")
MIXED = re.compile(rb"[A-Za-z]+[0-9@$!*][A-Za-z0-9@$!*]*[A-Za-z]")
PUNCTUATION = bytes(b for b in range(33, 127) if not chr(b).isalnum())
NOT_CAPITAL = bytes(b for b in range(256) if not 65 <= b <= 90)
FEATURES = ("hit_weight", "hits", "hit_kinds", "top_weight", "near_you", "you", "capitals", "shouted", "marks", "punctuation", "mixed", "mixed_hits", "words")


def stems(word: bytes) -> list[bytes]:
    """A word's lexicon candidates: itself, or the head of a very long one, and its beginnings, marked with an asterisk."""
    own = word if len(word) <= LONGEST else word[:LONGEST] + b"*"
    return [own, *(word[:n] + b"*" for n in STEMS if len(word) >= n)]


def stem_counts(sample: DataFrame) -> DataFrame:
    """(stem, bad, good): labelled texts with each stem, combined per slice and then per stem."""

    def run(batch):
        bad: dict[bytes, int] = {}
        good: dict[bytes, int] = {}
        for t, y in zip(batch.column("t").to_pylist(), batch.column("y").to_pylist()):
            into = bad if y else good
            for s in {s for w in set(t.translate(PLAIN).split()) if len(w) >= 3 for s in stems(w)}:
                into[s] = into.get(s, 0) + 1
        keys = list(bad.keys() | good.keys())
        return pa.record_batch([pa.array(keys, pa.binary()), *(pa.array([c.get(k, 0) for k in keys], pa.int64()) for c in (bad, good))], ["stem", "bad", "good"])

    return common.map_slices(sample, run, "stem binary, bad long, good long", "t").groupBy("stem").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))


def learn_lexicon(sample: DataFrame, most: int = LEXICON) -> dict[bytes, float]:
    """stem -> log odds, for stems of toxic texts that other texts hardly have."""
    n_bad, n_good = sample.agg(F.count_if(F.col("y") == 1), F.count_if(F.col("y") == 0)).first()
    if not n_bad or not n_good:
        return {}
    odds = F.log((F.col("bad") + 0.5) / (n_bad + 1.0)) - F.log((F.col("good") + 0.5) / (n_good + 1.0))
    chosen = (
        stem_counts(sample).filter(F.col("bad") >= max(3, n_bad // 100)).withColumn("odds", odds).filter("odds >= 2.5")
        .orderBy(F.desc(F.col("odds") * F.sqrt("bad")), "stem").limit(most).collect()
    )
    return {bytes(r["stem"]): float(r["odds"]) for r in chosen}


def features(texts: list[bytes], lexicon: dict[bytes, float]) -> np.ndarray:
    """A row of FEATURES per text; the empty text has zeros."""
    heads = {s.rstrip(b"*")[:3] for s in lexicon}
    out = np.zeros((len(texts), len(FEATURES)), np.float64)

    def weight(word: bytes) -> float:
        return max((lexicon.get(s, 0.0) for s in stems(word)), default=0.0)

    for row, t in zip(out, texts):
        if not t:
            continue
        words = t.translate(PLAIN).split()
        n, size = max(1, len(words)), len(t)
        hits = [(i, w, x) for i, w in enumerate(words) if w[:3] in heads and (x := weight(w)) > 0]
        you = [i for i, w in enumerate(words) if w in SECOND_PERSON]
        mixed = MIXED.findall(t)
        plain = [w.lower().translate(LEET).replace(b"*", b"") for w in mixed]
        mixed_hits = sum(weight(w) > 0 for w in plain)
        if hits:
            row[0] = sum(x for _, _, x in hits) / n
            row[1] = np.log1p(len(hits))
            row[2] = len({w for _, w, _ in hits})
            row[3] = max(x for _, _, x in hits)
            if you:
                at, yous = np.array([i for i, _, _ in hits]), np.array(you)
                right = np.searchsorted(yous, at)
                gap = np.minimum(np.abs(yous[np.minimum(right, len(yous) - 1)] - at), np.abs(at - yous[np.maximum(right - 1, 0)]))
                row[4] = 1.0 / (1.0 + gap.min())
        row[5] = len(you) / n
        capitals = len(t.translate(None, NOT_CAPITAL))
        row[6] = capitals / size
        row[7] = sum(len(w) > 2 and w.isupper() for w in t.split()) / n if capitals > 3 * n // 10 else 0.0
        row[8] = (t.count(b"!") + t.count(b"?")) / n
        row[9] = (size - len(t.translate(None, PUNCTUATION))) / size
        row[10] = len(mixed) / n
        row[11] = mixed_hits
        row[12] = np.log1p(len(words))
    return out


class Trees:
    """Gradient-boosted regression trees for the logistic loss over quantile bins."""

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, least: int = 8):
        self.rounds, self.depth, self.rate, self.bins, self.least = rounds, depth, rate, bins, least
        self.edges: list[np.ndarray] = []
        self.trees: list[list] = []
        self.prior = 0.0

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(self.edges)], axis=1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        qs = np.linspace(0, 1, self.bins + 1)[1:-1]
        # values away from a column's most frequent one get bins too, however rare they are
        self.edges = [np.unique(np.concatenate([np.quantile(c, qs), np.quantile(c[c > c.min()], qs) if (c > c.min()).any() else []])) for c in x.T]
        b = self._binned(x)
        share = min(max(y.mean(), 1e-3), 1 - 1e-3)
        self.prior = float(np.log(share / (1 - share)))
        margin = np.full(len(y), self.prior)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-margin))
            tree = self._grow(b, y - p, p * (1 - p), np.arange(len(y)), self.depth)
            self.trees.append(tree)
            margin += self._walk(tree, b)
        return self

    def _grow(self, b, g, h, rows, depth):
        gs, hs = g[rows].sum(), h[rows].sum()
        best = (1e-6, None, None)
        if depth and len(rows) >= 2 * self.least:
            for j in range(b.shape[1]):
                own, size = b[rows, j], len(self.edges[j]) + 1
                gl, hl, nl = (np.cumsum(np.bincount(own, w, size))[:-1] for w in (g[rows], h[rows], None))
                gain = gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1)
                gain[(nl < self.least) | (len(rows) - nl < self.least)] = -1
                if len(gain) and gain.max() > best[0]:
                    best = (float(gain.max()), j, int(gain.argmax()))
        if best[1] is None:
            return self.rate * float(gs / (hs + 1))
        left = b[rows, best[1]] <= best[2]
        return [best[1], best[2], self._grow(b, g, h, rows[left], depth - 1), self._grow(b, g, h, rows[~left], depth - 1)]

    def _walk(self, tree, b) -> np.ndarray:
        if not isinstance(tree, list):
            return np.full(len(b), tree)
        return np.where(b[:, tree[0]] <= tree[1], self._walk(tree[2], b), self._walk(tree[3], b))

    def margins(self, x: np.ndarray) -> np.ndarray:
        b, out = self._binned(x), np.full(len(x), self.prior)
        for tree in self.trees:
            out += self._walk(tree, b)
        return out


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing least-squares fit of ``y`` to ``x`` (adjacent violators pooled)."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []  # sum of y, count, sum of x
    for a, b in zip(x[order].tolist(), y[order].tolist()):
        pools.append([b, 1.0, a])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            s, c, t = pools.pop()
            pools[-1] = [pools[-1][0] + s, pools[-1][1] + c, pools[-1][2] + t]
    return np.array([p[2] / p[1] for p in pools]), np.array([(p[0] + 0.01) / (p[1] + 0.02) if p[1] > 2 else p[0] / p[1] for p in pools])


class Model:
    """Lexicon, trees and calibration.  Without both labels in the sample every score is the share of toxic rows."""

    def __init__(self, lexicon, trees, knots):
        self.lexicon, self.trees, self.knots = lexicon, trees, knots

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if self.trees is None:
            return np.full(len(texts), self.knots[1][0])
        return np.clip(np.interp(self.trees.margins(features(texts, self.lexicon)), *self.knots), 0.0, 1.0)


def fit(docs: DataFrame, labels: DataFrame, most: int = FIT_ROWS) -> Model:
    """Fits on at most ``most`` rows of ``labels(doc_id, toxic)``; rows with a null label or id don't count.

    A doc_id that labels repeat is toxic if one of them says so, and of rows
    that share a doc_id the least text is taken, so the sample has ``most`` rows
    at most.  Three of four sampled rows grow the trees, the fourth calibrates.
    """
    chosen = labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    folder = common.shared_dir(docs.sparkSession)
    chosen = common.stored(chosen.withColumnRenamed("doc_id", "l_id"), folder, "chosen")
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_bytes().alias("t"))
    sample = text.join(F.broadcast(chosen), F.col("doc_id") == F.col("l_id"))  # at most `most` rows
    sample = common.stored(sample.groupBy("doc_id", "y").agg(F.min("t").alias("t")), folder, "sample")
    lexicon = learn_lexicon(sample)

    def run(batch):
        x = features(batch.column("t").to_pylist(), lexicon)
        return pa.record_batch([batch.column("doc_id"), batch.column("y"), *(pa.array(c) for c in x.T)], ["doc_id", "y", *FEATURES])

    rows = common.map_slices(sample, run, "doc_id long, y int, " + ", ".join(f"{f} double" for f in FEATURES), "t").toArrow()
    rows = rows.sort_by([("doc_id", "ascending"), *((f, "ascending") for f in FEATURES)])
    x, y = np.stack([np.asarray(rows[f]) for f in FEATURES], axis=1) if rows.num_rows else np.zeros((0, len(FEATURES))), np.asarray(rows["y"]).astype(float)
    if not len(y) or y.min() == y.max():
        return Model(lexicon, None, (np.zeros(1), np.array([y.mean() if len(y) else 0.0])))
    held = np.arange(len(y)) % 4 == 3
    if not 0 < y[held].sum() < held.sum() or not 0 < y[~held].sum() < (~held).sum():
        held = np.zeros(len(y), bool)  # too few for a split: calibrate on all
    trees = Trees().fit(x[~held], y[~held])
    calibrate = held if held.any() else ~held
    return Model(lexicon, trees, isotonic(trees.margins(x[calibrate]), y[calibrate]))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, predicted): the calibrated probability of every row of ``docs``.

    Null and empty texts are scored by their zero features; rows that repeat a
    doc_id are scored each; texts of any length are read whole; other columns
    are ignored, whatever their names; an empty table gives an empty result.
    """

    def run(batch):
        scores = model.scores(batch.column("t").to_pylist())
        return pa.record_batch([batch.column("doc_id"), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_bytes().alias("t"))
    return common.map_slices(rows, run, "doc_id long, score double, predicted int", "t")


def without_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs``, all columns, that the model does not predict to be toxic; the rules of ``score``."""
    at = docs.columns.index("text")

    def run(batch):
        texts = batch.column(at).cast(pa.binary()).fill_null(b"").to_pylist()
        return batch.filter(pa.array(model.scores(texts) < 0.5))

    return common.map_slices(docs, run, docs.schema, "text")
