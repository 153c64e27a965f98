"""Quality rules per document, and host verdicts shrunk towards an empirical beta prior.

Each document is measured against rules; a host (the source) has a rate of
documents that fail any.  Rates of small hosts are noise, so each is shrunk
towards the hosts' common rate with the strength that the spread of the rates
implies (moments of a beta distribution).  On a host whose shrunk rate stands out
from that prior, by ``over`` of its standard deviations, a document must pass
every rule; elsewhere the base rule alone decides.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .bpe import _Numbers, spread

SYMBOLS = b"#*$%&|<>"
WHITE = b"\t\n\x0b\x0c\r "
CONTINUATION = bytes(range(0x80, 0xC0))
#: Words of a window whose repeats count.
WINDOW = 5
#: The prior counts as so many documents at least and at most.
STRENGTH = (1.0, 1000.0)
#: Standard deviations of the prior by which a strict host's shrunk rate is above the prior's mean.
OVER = 0.5

_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def repeat_words(words: list[list[bytes]], window: int = WINDOW) -> np.ndarray:
    """Per document, the words that lie in a window of words found twice or more in it."""
    counts = np.fromiter(map(len, words), np.int64, len(words))
    units = _Numbers()
    codes = np.fromiter((units[w] for d in words for w in d), np.uint64, int(counts.sum()))
    has = np.maximum(counts - window + 1, 0)
    starts = np.cumsum(counts) - counts
    at = spread(starts, has)
    if not len(at):
        return np.zeros(len(words), np.int64)
    doc = np.repeat(np.arange(len(words)), has)
    h = (doc.astype(np.uint64) + np.uint64(1)) * np.uint64(0xE7037ED1A0B428DB)
    for j in range(window):
        x = codes[at + j] * _FACTORS[j % len(_FACTORS)] + h
        h = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    order = np.argsort(h)
    same = h[order][1:] == h[order][:-1]
    twice = np.zeros(len(h), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    marked = np.zeros(len(codes) + 1, bool)
    for j in range(window):
        marked[at[twice] + j] = True
    upto = np.concatenate([[0], np.cumsum(marked[:-1])])
    return upto[starts + counts] - upto[starts]


def measures(docs: DataFrame) -> DataFrame:
    """(doc_id, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words): the measures of every whole text."""

    def run(batch):
        texts = batch.column("t").to_pylist()
        words = [t.split() for t in texts]
        columns = [
            [len(w) for w in words],
            [len(t.translate(None, WHITE + CONTINUATION)) for t in texts],
            [len(t) - len(t.translate(None, SYMBOLS)) for t in texts],
            [len(lines) - len(set(lines)) for lines in ([x for x in t.split(b"\n") if x and not x.isspace()] for t in texts)],
            repeat_words(words),
        ]
        return pa.record_batch([batch.column("doc_id"), batch.column("host"), *(pa.array(c, pa.int64()) for c in columns)], ["doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("host"), common.text_bytes().alias("t"))
    return common.map_slices(rows, run, "doc_id long, host string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long", "t")


#: Rules in SQL that both engines read: the base rule, then the softer ones.
BASE = "n_words < 10 OR 100 * n_repeat_words > 20 * n_words"
SOFT = "10 * n_symbols > word_chars OR 4 * n_dup_lines > n_words OR word_chars < 2 * n_words OR word_chars > 20 * n_words"


def host_rules(docs: DataFrame, over: float = OVER) -> DataFrame:
    """Measures with base_failed, failed, host_rate (shrunk), host_strict and kept: one row per row of ``docs``.

    Null text has no words and so fails the base rule; a null source is a host
    of its own; rows that repeat a doc_id are judged each.  Texts of any length
    are measured whole; other columns are ignored, whatever their names.  Where
    all hosts have one rate, none stands out.  An empty table gives an empty
    result.  Counts per host are combined before the shuffle, so a hot host is
    one row per task.
    """
    folder = common.shared_dir(docs.sparkSession)
    rows = measures(docs).withColumn("base_failed", F.expr(BASE)).withColumn("failed", F.expr(f"{BASE} OR {SOFT}"))
    rows = common.stored(rows, folder, "measures")
    hosts = rows.groupBy("host").agg(F.count("*").alias("n"), F.count_if("failed").alias("bad"))
    hosts = common.stored(hosts, folder, "hosts")
    rate = F.col("bad") / F.col("n")
    mean, spread_of = hosts.agg(F.avg(rate), F.var_pop(rate)).first()  # one row
    mean, strength = mean or 0.0, STRENGTH[1]
    if spread_of:
        strength = min(STRENGTH[1], max(STRENGTH[0], mean * (1 - mean) / spread_of - 1))
    limit = mean + over * (max(0.0, mean * (1 - mean)) / (strength + 1)) ** 0.5
    verdicts = hosts.select(F.col("host").alias("h"), ((F.col("bad") + F.lit(mean * strength)) / (F.col("n") + F.lit(strength))).alias("host_rate"))
    return rows.join(verdicts, rows.host.eqNullSafe(verdicts.h)).drop("h").withColumn("host_strict", F.col("host_rate") > limit).withColumn(
        "kept", ~F.col("base_failed") & ~(F.col("host_strict") & F.col("failed")))


ORACLE = rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(w) - 3)) AS i, w FROM d WHERE len(w) >= 5),
k AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i:i+4]) AS c FROM g),
p AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM k, (SELECT unnest(range(0, 5)) AS j) WHERE c > 1 GROUP BY doc_id),
l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d),
q AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (SELECT d.doc_id, d.source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
             len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(q.n, 0)::BIGINT AS n_dup_lines, coalesce(p.n, 0)::BIGINT AS n_repeat_words
      FROM d LEFT JOIN p USING (doc_id) LEFT JOIN q USING (doc_id)),
f AS (SELECT *, ({BASE}) AS base_failed, ({BASE} OR {SOFT}) AS failed FROM m),
h AS (SELECT source, count(*) AS n, count(*) FILTER (failed) AS bad FROM f GROUP BY source),
s AS (SELECT avg(bad / n) AS mu, var_pop(bad / n) AS v FROM h),
a AS (SELECT mu, CASE WHEN v > 0 THEN least(1000.0, greatest(1.0, mu * (1 - mu) / v - 1)) ELSE 1000.0 END AS st FROM s),
r AS (SELECT source, (bad + mu * st) / (n + st) > mu + {OVER} * sqrt(mu * (1 - mu) / (st + 1)) AS strict FROM h, a)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT (strict AND failed) AS kept
FROM f JOIN r ON f.source IS NOT DISTINCT FROM r.source
"""
