"""Language identification of mixed text: scripts narrow, trigrams score words, Viterbi labels spans.

Per word, the languages that write in its script, by their training texts, are
candidates; hashed character trigrams give each a log probability; and the best
sequence of languages pays a penalty for every switch, so that spans of one
language come out whole.  The Viterbi steps run over all documents of a slice at
once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Trigram buckets; a model has this many floats per language.
BUCKETS = 1 << 16
#: Training texts per language, about: a hash of the id picks the share that gives so many.
PER_LANGUAGE = 3000
#: Distinct languages that a model can tell apart.
MOST_LANGUAGES = 2000
#: Log probability that a switch of language costs.
SWITCH = 8.0
#: A language is a candidate for a script if this share of the language's own training letters is in it.
SHARE = 0.001
#: Script ranges of Unicode blocks (first, last, script).
SCRIPTS = (
    (0x0041, 0x024F, "latin"), (0x0250, 0x02AF, "latin"), (0x0370, 0x03FF, "greek"), (0x0400, 0x052F, "cyrillic"), (0x0530, 0x058F, "armenian"),
    (0x0590, 0x05FF, "hebrew"), (0x0600, 0x06FF, "arabic"), (0x0700, 0x074F, "syriac"), (0x0750, 0x077F, "arabic"), (0x0780, 0x07BF, "thaana"),
    (0x0900, 0x097F, "devanagari"), (0x0980, 0x09FF, "bengali"), (0x0A00, 0x0A7F, "gurmukhi"), (0x0A80, 0x0AFF, "gujarati"), (0x0B00, 0x0B7F, "oriya"),
    (0x0B80, 0x0BFF, "tamil"), (0x0C00, 0x0C7F, "telugu"), (0x0C80, 0x0CFF, "kannada"), (0x0D00, 0x0D7F, "malayalam"), (0x0D80, 0x0DFF, "sinhala"),
    (0x0E00, 0x0E7F, "thai"), (0x0E80, 0x0EFF, "lao"), (0x0F00, 0x0FFF, "tibetan"), (0x1000, 0x109F, "myanmar"), (0x10A0, 0x10FF, "georgian"),
    (0x1100, 0x11FF, "hangul"), (0x1200, 0x137F, "ethiopic"), (0x1780, 0x17FF, "khmer"), (0x1800, 0x18AF, "mongolian"), (0x1E00, 0x1EFF, "latin"),
    (0x1F00, 0x1FFF, "greek"), (0x3040, 0x309F, "kana"), (0x30A0, 0x30FF, "kana"), (0x3400, 0x4DBF, "han"), (0x4E00, 0x9FFF, "han"),
    (0xAC00, 0xD7AF, "hangul"), (0xF900, 0xFAFF, "han"), (0x20000, 0x2FA1F, "han"), (0x30000, 0x323AF, "han"),
)
NAMES = ["other", *dict.fromkeys(s for _, _, s in SCRIPTS)]

_tables: list[np.ndarray] = []


def _code_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By code point: is it a letter, its script, its lower case (only where that is one character)."""
    if not _tables:
        n = 0x110000
        letter, script, lower = np.zeros(n, bool), np.zeros(n, np.uint8), np.arange(n, dtype=np.uint32)
        for c in range(n):
            ch = chr(c)
            if ch.isalpha():
                letter[c] = True
                if len(low := ch.lower()) == 1:
                    lower[c] = ord(low)
        for a, b, name in SCRIPTS:
            script[a : b + 1] = NAMES.index(name)
        _tables.extend([letter, script, lower])
    return tuple(_tables)


class Words:
    """The words (runs of letters) of a slice of texts, with the trigram buckets of their letters."""

    def __init__(self, texts: list[str]):
        letter, script, lower = _code_tables()
        parts = [t.encode("utf-32-le", "surrogatepass") for t in texts]
        sizes = np.fromiter((len(p) // 4 + 1 for p in parts), np.int64, len(parts))
        codes = np.frombuffer(b" \0\0\0" + b" \0\0\0".join(parts) + b" \0\0\0", np.uint32)
        is_letter = letter[codes]
        c = np.where(is_letter, lower[codes], 32).astype(np.uint64)
        at = np.flatnonzero(is_letter)
        h = c[at - 1] * np.uint64(0x9E3779B97F4A7C15) + c[at] * np.uint64(0xC2B2AE3D27D4EB4F) + c[at + 1] * np.uint64(0x165667B19E3779F9)
        self.bucket = ((h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(48)).astype(np.int64)
        first = np.concatenate([[True], np.diff(at) > 1]) if len(at) else np.zeros(0, bool)
        self.starts = np.flatnonzero(first)  # of words, among letters
        self.size = np.diff(np.append(self.starts, len(at)))
        begin = at[self.starts]
        text_at = np.cumsum(sizes) - sizes + 1
        self.doc = np.searchsorted(text_at, begin, "right") - 1
        self.begin = begin - text_at[self.doc] if len(begin) else begin
        self.script = script[codes[begin]]
        self.letter_doc = np.repeat(self.doc, self.size)
        self.per_doc = np.bincount(self.doc, minlength=len(texts))


class Model:
    """Trigram log probabilities (BUCKETS x languages) and the candidate languages of each script."""

    def __init__(self, languages: list[str], logp: np.ndarray, allowed: np.ndarray):
        self.languages, self.logp, self.allowed = languages, logp, allowed

    def label(self, words: Words, switch: float = SWITCH) -> np.ndarray:
        """The language number of each word."""
        n, count = len(words.starts), len(self.languages)
        if not n:
            return np.zeros(0, np.int64)
        scores = np.add.reduceat(self.logp[words.bucket], words.starts, axis=0)
        scores[~self.allowed[words.script]] -= 1e6
        docs = np.flatnonzero(words.per_doc)
        docs = docs[np.argsort(-words.per_doc[docs], kind="stable")]
        lens = words.per_doc[docs]
        begin = (np.cumsum(words.per_doc) - words.per_doc)[docs]
        came = np.zeros((n, count), np.uint8 if count < 256 else np.uint32)
        best = scores[begin].astype(np.float64)
        stay = np.arange(count, dtype=came.dtype)
        active = np.searchsorted(-lens, -np.arange(1, int(lens[0]) + 1), "right")  # documents with over t words
        out = np.zeros(n, np.int64)
        for t in range(1, int(lens[0])):
            k = active[t]
            now = best[:k]
            top = now.argmax(axis=1)
            leap = now[np.arange(k), top][:, None] - switch
            rows = begin[:k] + t
            moved = leap > now
            came[rows] = np.where(moved, top[:, None].astype(came.dtype), stay)
            best[:k] = np.where(moved, leap, now) + scores[rows]
        state = np.zeros(len(docs), np.int64)
        for t in range(int(lens[0]) - 1, -1, -1):
            k = active[t]
            ends = lens[:k] == t + 1
            if ends.any():
                state[:k][ends] = best[:k][ends].argmax(axis=1)
            rows = begin[:k] + t
            out[rows] = state[:k]
            if t:
                state[:k] = came[rows, state[:k]]
        return out


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """Learns from ``docs(doc_id, text, lang)``; rows with a null lang don't count.

    The sample is bounded by ``per_language`` times the number of languages,
    about; counts are combined per slice and per bucket before they come to the
    driver (BUCKETS per language at most).  More than ``MOST_LANGUAGES`` distinct
    values of lang raise: such a column holds something else.
    """
    named = docs.filter("lang is not null").groupBy("lang").agg(F.count("*").alias("n")).limit(MOST_LANGUAGES + 1).collect()
    if len(named) > MOST_LANGUAGES:
        raise ValueError(f"over {MOST_LANGUAGES} values of lang")
    counts = {r["lang"]: r["n"] for r in named}
    languages = sorted(counts)
    if not languages:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros((len(NAMES), 0), bool))
    number = F.create_map(*[x for i, k in enumerate(languages) for x in (F.lit(k), F.lit(i))])
    share = F.create_map(*[x for k in languages for x in (F.lit(k), F.lit(min(1.0, per_language / counts[k])))])
    unit = F.shiftrightunsigned(F.xxhash64("doc_id"), 11) / F.lit(float(1 << 53))
    sample = docs.filter(F.col("lang").isNotNull() & (unit < share[F.col("lang")])).select(number[F.col("lang")].alias("y"), F.coalesce("text", F.lit("")).alias("t"))

    def run(batch):
        words = Words(batch.column("t").to_pylist())
        y = np.asarray(batch.column("y")).astype(np.int64)
        n = len(languages)
        key, c = np.unique(words.bucket * n + y[words.letter_doc], return_counts=True)
        s_key, s_c = np.unique(np.repeat(words.script, words.size).astype(np.int64) * n + y[words.letter_doc], return_counts=True)
        return pa.record_batch([pa.array(np.concatenate([key, s_key + BUCKETS * n])), pa.array(np.concatenate([c, s_c]))], ["k", "c"])

    table = common.map_slices(sample, run, "k long, c long", "t").groupBy("k").agg(F.sum("c").alias("c")).toArrow()
    flat = np.zeros((BUCKETS + len(NAMES)) * len(languages))
    flat[np.asarray(table["k"])] = np.asarray(table["c"])
    grid = flat.reshape(-1, len(languages))
    tri, by_script = grid[:BUCKETS] + 0.1, grid[BUCKETS:]
    allowed = by_script >= SHARE * np.maximum(by_script.sum(axis=0, keepdims=True), 1)
    allowed[~allowed.any(axis=1)] = True  # a script that training never showed narrows nothing
    return Model(languages, np.log(tri / tri.sum(axis=0)).astype(np.float32), allowed)


def identify(docs: DataFrame, model: Model, switch: float = SWITCH, spans: bool = True) -> DataFrame:
    """(doc_id, lang_pred, score[, spans array<struct<start, end, lang>>]): one row per row of ``docs``.

    ``lang_pred``: the language with the most letters (ties: the first by
    name); ``score``: its share of the letters.  Spans are character offsets of
    words joined while their language lasts.  Text that is null or without a
    letter is ``und`` with score 0 and no spans, as is any text when the model
    knows no language.  Rows that repeat a doc_id are labelled each.  Texts of
    any length are labelled whole, a slice of rows at a time; other columns are
    ignored, whatever their names.  An empty table gives an empty result.
    """

    def run(batch):
        texts = batch.column("t").to_pylist()
        words = Words(texts)
        n = len(model.languages)
        preds, scores = ["und"] * len(texts), np.zeros(len(texts))
        found: list[list] = [[] for _ in texts]
        if n and len(words.starts):
            label = model.label(words, switch)
            letters = np.bincount(words.doc * n + label, weights=words.size, minlength=len(texts) * n).reshape(-1, n)
            total = letters.sum(axis=1)
            top = letters.argmax(axis=1)
            scores = np.where(total > 0, letters[np.arange(len(texts)), top] / np.maximum(total, 1), 0.0)
            preds = [model.languages[i] if x else "und" for i, x in zip(top.tolist(), total.tolist())]
            if spans:
                new = np.flatnonzero(np.concatenate([[True], (label[1:] != label[:-1]) | (words.doc[1:] != words.doc[:-1])]))
                last = np.append(new[1:], len(label)) - 1
                for d, s, e, x in zip(words.doc[new].tolist(), words.begin[new].tolist(), (words.begin[last] + words.size[last]).tolist(), label[new].tolist()):
                    found[d].append({"start": s, "end": e, "lang": model.languages[x]})
        columns, names = [batch.column("doc_id"), pa.array(preds), pa.array(scores)], ["doc_id", "lang_pred", "score"]
        if spans:
            columns.append(pa.array(found, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))))
            names.append("spans")
        return pa.record_batch(columns, names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("t"))
    schema = "doc_id long, lang_pred string, score double" + ", spans array<struct<start: long, end: long, lang: string>>" * spans
    return common.map_slices(rows, run, schema, "t", max(1 << 16, (16 << 20) // max(4, len(model.languages))))
