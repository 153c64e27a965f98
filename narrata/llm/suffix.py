"""Repeated passages removed with run-length (RLBWT) indexes.

Rule: a byte goes if a string of ``length`` bytes that covers it also starts
earlier (smaller doc_id, or the same document at an earlier byte), judged on
the input.

1. Parse.  Every window of ``length`` bytes is assigned to its minimizer, the
   least hash among its ``k``-byte strings.  Equal windows have equal
   minimizers, so windows whose minimizer occurs once in the corpus cannot
   repeat.  Consecutive windows with one minimizer form a phrase.  As in
   prefix-free parsing, the dictionary of distinct phrases is what gets indexed;
   copies only count, with their first place.
2. Runs.  Where a minimizer has one distinct phrase, the phrase's suffixes have
   one context each: whole runs of the transform that need no sorting.  The
   first place survives.
3. Index.  The phrases of all other minimizers are dealt out by minimizer.  Each
   task builds run-length Burrows-Wheeler indexes over blocks of whole minimizer
   groups: runs, their LF targets, and suffix samples at run starts and ends.
   Comparing the suffixes sampled on either side of a run's start gives their
   matching statistics, and within runs the statistics follow from these.  It
   streams each phrase through the index, from its end to its start, one LF step
   per byte; at a window start the rows whose statistics reach ``length`` are the
   window's class, and the earliest of the class survives.
4. Mark.  The windows of phrases with repeated minimizers go, but for survivors.

A minimizer with over ``HOT`` distinct phrases (a common passage's edge in very
many documents) would not fit a task; its phrases are parsed again by minimizers
that are not as common, and go through the index then.  Windows that consist of
such common strings only are matched by a 128-bit hash in a shuffle that combines
them first.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Bytes of a string under the minimizer hash: long enough that chance hardly repeats one.
K = 40
#: Distinct phrases of a minimizer that one index takes; beyond, they are parsed again.
HOT = 20_000
#: Bytes of phrases in an index block.
BLOCK = 1 << 19
#: Bytes of text that are parsed at once.
PARSED = 1 << 20
#: Base of the rolling hash (odd) and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)

_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    held = _powers.get(base)
    if held is None or len(held) < n:
        held = np.full(max(n, 1 << 16), base, np.uint64)
        held[0] = 1
        held = _powers[base] = np.multiply.accumulate(held)
    return held[:n]


def _mix(h: np.ndarray) -> np.ndarray:
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, None)):
        h = h ^ (h >> np.uint64(shift))
        if factor:
            h = h * np.uint64(factor)
    return h


def phrases(data: np.ndarray, ends: np.ndarray, length: int, k: int = K, avoid: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(minimizer, document, first window, windows) of each phrase of the documents in ``data``.

    ``ends``: where each document ends.  Windows do not cross documents.  The
    leftmost of equal hashes counts, so the choice depends on the window alone.
    Strings whose hash the bitmap ``avoid`` holds count only where a window has
    no other.
    """
    n = len(data)
    none = (np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3)))
    if n < length:
        return none
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power(BASE, n), dtype=np.uint64)])
    hashes = _mix((sums[k:] - sums[:-k]) * _power(INVERSE, n - k + 1))
    low = np.uint64((1 << 32) - 1)
    v = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)
    if avoid is not None:
        v[common.in_bitmap(avoid, hashes.view(np.int64))] |= ~low
    w, span = length - k + 1, 1
    while 2 * span <= w:
        v = np.minimum(v[:-span], v[span:])
        span *= 2
    if span < w:
        v = np.minimum(v[: len(v) - (w - span)], v[w - span :])
    at = (v & low).astype(np.int64)
    starts = np.concatenate([[0], ends[:-1]])
    lens = ends - starts
    has = np.maximum(lens - length + 1, 0)
    doc = np.repeat(np.arange(len(ends)), has)
    window = np.repeat(starts - (np.cumsum(has) - has), has) + np.arange(int(has.sum()))
    if not len(window):
        return none
    own = at[window]
    first = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (doc[1:] != doc[:-1])]))
    count = np.diff(np.append(first, len(own)))
    return hashes[own[first]], doc[first], window[first] - starts[doc[first]], count


def parsed(texts: list[bytes], length: int, k: int = K, most: int = PARSED) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``phrases`` of texts of any length: about ``most`` bytes at a time, longer texts in pieces that overlap by a window."""
    out, held, size = [], [], 0

    def flush():
        data = np.frombuffer(b"".join(x[2] for x in held), np.uint8)
        m, piece, pos, n = phrases(data, np.cumsum(np.fromiter((len(x[2]) for x in held), np.int64, len(held))), length, k)
        out.append((m, np.array([x[0] for x in held], np.int64)[piece], pos + np.array([x[1] for x in held], np.int64)[piece], n))

    for d, text in enumerate(texts):
        for at in range(0, max(1, len(text) - length + 1), most):
            held.append((d, at, text[at : at + most + length - 1]))
            size += len(held[-1][2])
            if size >= most:
                flush()
                held, size = [], 0
    if held or not out:
        held = held or [(0, 0, b"")]
        flush()
    return tuple(np.concatenate([o[i] for o in out]) for i in range(4))


def minimizers(docs: DataFrame, length: int, k: int) -> DataFrame:
    """(m long): the minimizer of every phrase."""

    def run(batch):
        m = parsed(batch.column("t").to_pylist(), length, k)[0]
        return pa.record_batch([pa.array(m.view(np.int64))], ["m"])

    return common.map_slices(docs.select(common.text_bytes().alias("t")), run, "m long", "t", PARSED)


def repeated_places(docs: DataFrame, bitmap: np.ndarray, length: int, k: int) -> DataFrame:
    """(doc_id, th, m, s, pos, n): per document, arrays over its phrases whose minimizer the bitmap holds.

    ``s`` is the hash of a phrase's bytes, ``th`` that of the text.
    """
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)  # of fixed size

    def run(batch):
        texts = batch.column("t").to_pylist()
        m, doc, pos, n, s, th = _kept_phrases(texts, shared.value, length, k)[:6]
        if not len(m):
            return None
        first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
        offsets = pa.array(np.append(first, len(doc)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (m, s, pos.astype(np.int32), n.astype(np.int32))]
        return pa.record_batch([batch.column("doc_id").take(pa.array(doc[first])), pa.array(th[doc[first]]), *lists], ["doc_id", "th", "m", "s", "pos", "n"])

    return common.map_slices(_rows(docs), run, "doc_id long, th long, m array<long>, s array<long>, pos array<int>, n array<int>", "t", PARSED)


def _kept_phrases(texts: list[bytes], bitmap: np.ndarray, length: int, k: int):
    m, doc, pos, n = parsed(texts, length, k)
    keep = np.flatnonzero(common.in_bitmap(bitmap, m.view(np.int64)))
    m, doc, pos, n = m[keep].view(np.int64), doc[keep], pos[keep], n[keep]
    own = [texts[d][p : p + c - 1 + length] for d, p, c in zip(doc.tolist(), pos.tolist(), n.tolist())]
    s = np.fromiter(map(xxhash.xxh3_64_intdigest, own), np.uint64, len(own)).view(np.int64)
    th = np.fromiter(map(xxhash.xxh3_64_intdigest, texts), np.uint64, len(texts)).view(np.int64)
    return m, doc, pos, n, s, th, own


def phrase_texts(docs: DataFrame, bitmap: np.ndarray, length: int, k: int) -> DataFrame:
    """(m, s, doc_id, th, pos, n, phrase): the phrases themselves, for minimizers that the bitmap holds."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)  # of fixed size

    def run(batch):
        m, doc, pos, n, s, th, own = _kept_phrases(batch.column("t").to_pylist(), shared.value, length, k)
        if not len(m):
            return None
        ids = batch.column("doc_id").take(pa.array(doc))
        return pa.record_batch([pa.array(m), pa.array(s), ids, pa.array(th[doc]), pa.array(pos.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(own, pa.binary())], ["m", "s", "doc_id", "th", "pos", "n", "phrase"])

    return common.map_slices(_rows(docs), run, "m long, s long, doc_id long, th long, pos int, n int, phrase binary", "t", PARSED)


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_bytes().alias("t"))


class RunLengthIndex:
    """A run-length BWT over phrases, each closed by a terminator below all bytes.

    ``heads``: where runs start; ``lf``: the LF target of each head; ``firsts``
    and ``tails``: text positions sampled at run starts and ends; ``stats``:
    matching statistics at the sampled positions; ``cuts``: rows whose statistic
    is below the length.  The suffix order itself is not kept.
    """

    def __init__(self, texts: list[bytes], length: int):
        lens = np.fromiter(map(len, texts), np.int64, len(texts))
        ends = np.cumsum(lens + 1)
        self.length, self.starts, self.lens, n = length, ends - lens - 1, lens, int(ends[-1])
        data = np.zeros(n + 8, np.uint8)
        inside = np.ones(n, bool)
        inside[ends - 1] = False
        data[:n][inside] = np.frombuffer(b"".join(texts), np.uint8)
        sym = np.where(inside, data[:n].astype(np.uint16) + 1, 0).astype(np.uint16)
        left = (np.repeat(ends, lens + 1) - np.arange(n)).astype(np.int32)  # symbols up to and with the terminator
        order = self._order(sym, left)
        bwt = np.where(order == np.repeat(self.starts, lens + 1)[order], 0, sym[order - 1])
        # Terminators do not match each other, so what they precede is a run of its own for the samples.
        new = np.concatenate([[True], bwt[1:] != bwt[:-1]])
        self.heads = np.flatnonzero(new)
        self.chars = bwt[self.heads]
        sizes = np.diff(np.append(self.heads, n))
        by_char = np.argsort(self.chars, kind="stable")
        self.lf = np.zeros(len(sizes), np.int64)
        self.lf[by_char] = np.cumsum(sizes[by_char]) - sizes[by_char]  # runs of smaller symbols, then earlier runs of the same
        at = np.flatnonzero(new | (bwt == 0))
        self.firsts, self.tails = order[at], order[np.maximum(at - 1, 0)]
        match = self._extension(data, left, self.firsts, self.tails)
        match[0] = 0  # the first suffix has none before it
        by_place = np.argsort(self.firsts)
        self.sampled, self.stats = self.firsts[by_place], match[by_place]
        self.n = n
        self.cuts = np.flatnonzero(self.statistics()[order] < length)  # rows where a class of equal windows begins

    @classmethod
    def _order(cls, sym: np.ndarray, left: np.ndarray) -> np.ndarray:
        """The suffix order, by doubling; what follows a terminator does not count, equal suffixes stay in text order."""
        n = len(sym)
        key = np.zeros(n, np.uint64)
        for i in range(7):  # ranks by the first symbols: nine bits each
            part = np.zeros(n, np.uint64)
            part[: n - i] = sym[i:]
            key = (key << np.uint64(9)) | np.where(left > i, part, 0).astype(np.uint64)
        rank, depth, longest = cls._ranked(key), 7, int(left.max())
        while depth < longest:
            rank = cls._ranked(cls._pair(rank, left, depth))
            depth *= 2
        return np.argsort(rank, kind="stable")

    @staticmethod
    def _extension(data: np.ndarray, left: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Bytes that the suffixes at ``a`` and ``b`` share, eight at a time; terminators end them."""
        words = np.lib.stride_tricks.sliding_window_view(data, 8)
        most = np.minimum(left[a], left[b]).astype(np.int64) - 1
        out = np.zeros(len(a), np.int64)
        alive = np.flatnonzero(most > 0)
        while len(alive):
            x, y = (words[p[alive] + out[alive]] for p in (a, b))
            same = np.ascontiguousarray(x).view(np.uint64).ravel() ^ np.ascontiguousarray(y).view(np.uint64).ravel()
            lowest = same & (~same + np.uint64(1))  # the lowest bit that differs lies in the first byte that does
            got = np.where(same == 0, 8, np.bitwise_count(lowest - np.uint64(1)) >> 3).astype(np.int64)
            out[alive] = np.minimum(out[alive] + got, most[alive])
            alive = alive[(got == 8) & (out[alive] < most[alive])]
        return out

    def statistics(self) -> np.ndarray:
        """Matching statistics of all text positions against the suffix before each in suffix order.

        They fall by one from a position to the next wherever both suffixes
        stand in the same run, so the sample before a position gives them.
        """
        run = np.diff(np.append(self.sampled, self.n))
        return np.maximum(np.repeat(self.stats + self.sampled, run) - np.arange(self.n), 0)

    @staticmethod
    def _ranked(key: np.ndarray) -> np.ndarray:
        order = np.argsort(key)
        ordered = key[order]
        rank = np.empty(len(key), np.int32)
        rank[order] = np.cumsum(np.concatenate([[0], ordered[1:] != ordered[:-1]]), dtype=np.int32)
        return rank

    @staticmethod
    def _pair(rank: np.ndarray, left: np.ndarray, by: int) -> np.ndarray:
        second = np.zeros(len(rank), np.int32)
        if by < len(rank):
            second[: len(rank) - by] = rank[by:] + 1
        second[left <= by] = 0
        return (rank.astype(np.uint64) << np.uint64(32)) | second.astype(np.uint64)

    def step(self, i: np.ndarray) -> np.ndarray:
        """LF: from the row of a suffix to the row of the suffix one symbol longer."""
        run = np.searchsorted(self.heads, i, "right") - 1
        return self.lf[run] + (i - self.heads[run])

    def classes(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(phrase, window, class) of every window start, the first ``windows`` positions of each phrase.

        All phrases stream at once, from their terminators' rows towards their
        starts.  A window's class is the stretch of rows around it whose
        matching statistics reach the length.
        """
        row = np.arange(len(self.lens))  # the terminators are the least suffixes, in text order
        which = np.arange(len(self.lens))
        out = []
        at = self.lens.copy()
        while len(which):
            row, at = self.step(row), at - 1
            start = at < windows[which]
            if start.any():
                out.append((which[start], at[start], np.searchsorted(self.cuts, row[start], "right")))
            go = at > 0
            row, at, which = row[go], at[go], which[go]
        return tuple(np.concatenate([o[i] for o in out]) for i in range(3))


def _survivors(table: pa.Table, length: int) -> pa.RecordBatch:
    """Runs of windows of a block of phrases that are the earliest of their class, as (doc_id, th, pos, n)."""
    doc, th = (np.asarray(table[c].fill_null(-(1 << 63)) if table[c].null_count else table[c]) for c in ("doc_id", "th"))
    pos, n = np.asarray(table["pos"]).astype(np.int64), np.asarray(table["n"]).astype(np.int64)
    which, window, cls = RunLengthIndex(table["phrase"].to_pylist(), length).classes(n)
    start = pos[which] + window
    order = np.lexsort((th[which], start, doc[which], cls))
    first = np.sort(order[np.concatenate([[True], cls[order][1:] != cls[order][:-1]])])
    # Windows of one phrase in a row make a run; they came out by falling offset.
    first = first[np.lexsort((window[first], which[first]))]
    w, p = which[first], window[first]
    new = np.flatnonzero(np.concatenate([[True], (w[1:] != w[:-1]) | (p[1:] != p[:-1] + 1)]))
    count = np.diff(np.append(new, len(w)))
    ids = table["doc_id"].combine_chunks().take(pa.array(w[new]))
    return pa.record_batch([ids, pa.array(th[w[new]]), pa.array(start[first[new]].astype(np.int32)), pa.array(count.astype(np.int32))], ["doc_id", "th", "pos", "n"])


def _index_blocks(length: int, block: int):
    """Batches in the order of ``m`` -> survivors, from indexes over whole minimizer groups of about ``block`` bytes."""

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for part in common.slices(batch, "phrase", block):
                held.append(part)
                size += part.column("phrase").nbytes
                if size < block:
                    continue
                table = pa.Table.from_batches(held)
                m = np.asarray(table["m"])
                other = np.flatnonzero(m != m[-1])  # the last group may go on in the next part
                whole = int(other[-1]) + 1 if len(other) else 0
                if whole:
                    yield _survivors(table.slice(0, whole), length)
                held = table.slice(whole).combine_chunks().to_batches()
                size = sum(x.column("phrase").nbytes for x in held)
        if held:
            yield _survivors(pa.Table.from_batches(held), length)

    return run


def _parsed_again(length: int, k: int, avoid):
    """Phrases -> (m, s, doc_id, th, pos, n, phrase): their windows by minimizers that ``avoid`` does not hold."""

    def run(batches):
        for batch in batches:
            for part in common.slices(batch, "phrase", PARSED):
                texts = part.column("phrase").to_pylist()
                m, of, at, n = phrases(np.frombuffer(b"".join(texts), np.uint8), np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts))), length, k, avoid.value)
                own = [texts[t][p : p + c - 1 + length] for t, p, c in zip(of.tolist(), at.tolist(), n.tolist())]
                hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, own), np.uint64, len(own)).view(np.int64)
                ids, th, pos = (part.column(c).take(pa.array(of)) for c in ("doc_id", "th", "pos"))
                yield pa.record_batch([pa.array(m.view(np.int64)), pa.array(hashes), ids, th, pa.array((np.asarray(pos) + at).astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(own, pa.binary())],
                                      ["m", "s", "doc_id", "th", "pos", "n", "phrase"])

    return run


def _window_hashes(length: int):
    """Phrases -> a row per window with the 128-bit hash of its bytes."""

    def run(batches):
        for batch in batches:
            for part in common.slices(batch, "phrase", 1 << 18):
                texts, n = part.column("phrase").to_pylist(), np.asarray(part.column("n"))
                which = np.repeat(np.arange(len(n)), n)
                window = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
                h = np.array([divmod(xxhash.xxh3_128_intdigest(texts[w][p : p + length]), 1 << 64) for w, p in zip(which.tolist(), window.tolist())], np.uint64).view(np.int64)
                ids, th = (part.column(c).take(pa.array(which)) for c in ("doc_id", "th"))
                yield pa.record_batch([pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy()), ids, th, pa.array((np.asarray(part.column("pos"))[which] + window).astype(np.int32))], ["h1", "h2", "doc_id", "th", "pos"])

    return run


def repeated_windows(docs: DataFrame, folder: str, length: int, k: int = K, hot: int = HOT, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Windows that may repeat, (doc_id, th, pos array, n array); and the survivors among them, (doc_id, th, pos, n)."""
    repeated = minimizers(docs, length, k).groupBy("m").agg(F.count("*").alias("c")).filter("c > 1").select("m")
    found = common.stored(repeated_places(docs, common.bitmap_of(common.stored(repeated, folder, "minimizers"), "m"), length, k), folder, "found")
    place = F.struct("doc_id", "pos", "th", "n")
    rows = found.select("doc_id", "th", F.inline(F.arrays_zip("m", "s", "pos", "n")))
    # One row of fixed size per minimizer, combined before the shuffle.
    groups = common.stored(rows.groupBy("m").agg(F.min("s").alias("s1"), F.max("s").alias("s2"), F.min(place).alias("f")), folder, "groups")
    alone = groups.filter("s1 = s2").select("f.doc_id", "f.th", "f.pos", "f.n")
    bitmap = common.bitmap_of(groups.filter("s1 <> s2"), "m")
    # What the bitmap passes beyond those groups is indexed too, with the same result.
    distinct = _distinct(phrase_texts(docs, bitmap, length, k), folder, "distinct")
    schema = "doc_id long, th long, pos int, n int"

    def indexed(rows: DataFrame) -> DataFrame:
        return rows.repartition("m").sortWithinPartitions("m").mapInArrow(_index_blocks(length, block), schema)

    hot_m = _crowded(distinct, hot, folder, "hot")
    found_in = [alone, indexed(distinct.join(hot_m, "m", "left_anti"))]
    if not hot_m.isEmpty():
        # Another string of each window is its minimizer; what is still crowded has crowded strings only.
        avoid = docs.sparkSession.sparkContext.broadcast(common.bitmap_of(hot_m, "m"))  # of bounded size
        crowded = distinct.join(hot_m, "m", "left_semi").mapInArrow(_parsed_again(length, k, avoid), f"m long, s long, {schema}, phrase binary")
        again = _distinct(crowded, folder, "again")
        still = _crowded(again, hot, folder, "still")
        found_in.append(indexed(again.join(still, "m", "left_anti")))
        windows = again.join(still, "m", "left_semi").select("doc_id", "th", "pos", "n", "phrase").mapInArrow(_window_hashes(length), "h1 long, h2 long, doc_id long, th long, pos int")
        found_in.append(windows.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "pos", "th")).alias("f")).select("f.doc_id", "f.th", "f.pos", F.lit(1).alias("n")))
    survivors = found_in[0]
    for more in found_in[1:]:
        survivors = survivors.unionByName(more)
    return found.select("doc_id", "th", "pos", "n"), common.stored(survivors, folder, "survivors")


def _distinct(phrase_rows: DataFrame, folder: str, name: str) -> DataFrame:
    """(m, doc_id, th, pos, n, phrase): a row per distinct phrase, with its first place."""
    place = F.struct("doc_id", "pos", "th", "n")
    rows = phrase_rows.groupBy("m", "s").agg(F.min(place).alias("f"), F.first("phrase").alias("phrase"))
    return common.stored(rows.select("m", "f.doc_id", "f.th", "f.pos", "f.n", "phrase"), folder, name)


def _crowded(distinct: DataFrame, hot: int, folder: str, name: str) -> DataFrame:
    """(m): minimizers of over ``hot`` distinct phrases."""
    return common.stored(distinct.groupBy("m").agg(F.count("*").alias("contexts")).filter(F.col("contexts") > hot).select("m"), folder, name)


def remove_repeats(docs: DataFrame, length: int = 100, k: int = K, hot: int = HOT, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans): one row per row of ``docs``.

    ``spans``: the maximal removed runs as array<struct<start, end>>, byte
    offsets.  Null text counts as empty; texts shorter than ``length`` stay
    whole.  Rows that repeat a doc_id and a text are one document and share a
    verdict; rows that repeat a doc_id with other texts are ordered by start,
    then text hash.  A null doc_id comes first.  An empty table gives an empty
    result.
    """
    folder = common.shared_dir(docs.sparkSession)
    windows, survivors = repeated_windows(docs, folder, length, k, hot, block)
    # Rows that repeat a doc_id and a text found the same; one of them is enough.
    may = windows.groupBy("doc_id", "th").agg(F.first(F.arrays_zip("pos", "n")).alias("runs"))
    keep = survivors.groupBy("doc_id", "th").agg(F.collect_list(F.struct("pos", "n")).alias("keep"))
    a, b = may.alias("a"), keep.alias("b")
    marks = a.join(b, F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.th") == F.col("b.th")), "left").select(
        F.col("a.doc_id").alias("m_id"), F.col("a.th").alias("m_th"), "runs", "keep")
    marks = common.stored(marks, folder, "marks")
    bitmap = docs.sparkSession.sparkContext.broadcast(common.bitmap_of(marks, "m_th"))  # of fixed size

    def dealt(batch):
        """Text goes on only where there may be marks; the rest is done here."""
        texts = batch.column("t").to_pylist()
        th = np.array([xxhash.xxh3_64_intdigest(t) for t in texts], np.uint64).view(np.int64)
        may_be = common.in_bitmap(bitmap.value, th).tolist()
        shas = [hashlib.sha256(t).hexdigest() for t in texts]
        return pa.record_batch([batch.column("doc_id"), pa.array(th), pa.array([len(t) for t in texts], pa.int64()), pa.array(shas), pa.array([t if m else None for t, m in zip(texts, may_be)], pa.binary())], ["doc_id", "th", "n_bytes", "sha", "t"])

    rows = common.map_slices(docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_bytes().alias("t")), dealt, "doc_id long, th long, n_bytes long, sha string, t binary", "t")

    def cut(batches):
        for batch in batches:
            for part in common.slices(batch, "t", PARSED):
                out = [[] for _ in range(4)]
                n_bytes, shas = part.column("n_bytes").to_pylist(), part.column("sha").to_pylist()
                runs, keep = _runs(part.column("runs")), _runs(part.column("keep"))
                for i, text in enumerate(part.column("t")):
                    found = _spans(runs[i], keep[i], length, n_bytes[i]) if len(runs[i]) else []
                    if found:
                        at, left, data = 0, [], text.as_py()
                        for s, e in found:
                            left.append(data[at:s])
                            at = e
                        shas[i] = hashlib.sha256(b"".join([*left, data[at:]])).hexdigest()
                    for column, value in zip(out, (sum(e - s for s, e in found), len(found), shas[i], [{"start": s, "end": e} for s, e in found])):
                        column.append(value)
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
                yield pa.record_batch([part.column("doc_id"), part.column("n_bytes"), *(pa.array(x, k) for x, k in zip(out, kinds))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    joined = rows.join(marks, F.col("doc_id").eqNullSafe(F.col("m_id")) & (F.col("th") == F.col("m_th")), "left")
    return joined.select("doc_id", "n_bytes", "sha", "t", "runs", "keep").mapInArrow(
        cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start: long, end: long>>")


def _runs(column: pa.ListArray) -> list[np.ndarray]:
    """Per row the (pos, n) of its runs, as rows of an array; none for null."""
    offsets, values = np.asarray(column.offsets), column.values
    flat = np.stack([np.asarray(values.field("pos")), np.asarray(values.field("n"))], axis=1) if len(values) else np.zeros((0, 2), np.int32)
    return [flat[a:b] if ok else flat[:0] for a, b, ok in zip(offsets[:-1].tolist(), offsets[1:].tolist(), column.is_valid().to_pylist())]


def _spans(runs: np.ndarray, keep: np.ndarray, length: int, n: int) -> list[tuple[int, int]]:
    """Maximal covered byte runs of the windows in ``runs`` without those in ``keep``."""
    gone = np.zeros(n + 1, bool)
    for pos, count in runs.tolist():
        gone[pos : pos + count] = True
    for pos, count in keep.tolist():
        gone[pos : pos + count] = False
    starts = np.flatnonzero(gone)
    if not len(starts):
        return []
    new = np.flatnonzero(np.concatenate([[True], starts[1:] > starts[:-1] + length]))
    last = np.append(new[1:] - 1, len(starts) - 1)
    return list(zip(starts[new].tolist(), (starts[last] + length).tolist()))
