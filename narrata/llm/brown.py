"""Language-model scores from a Brown class-based bigram model.

P(text) is the product over its tokens, from a boundary on, of
P(class | class before) * P(token | class).  Word counts cover all training
text, and every training word gets its class by exchange:

1. The ``frequent`` most frequent words are put into classes by exchange over
   their bigram counts (each word moves to the class that raises the likelihood
   of the class bigrams most).  All other words stand in classes by their ending,
   and the end of a text is a class of its own.
2. All other words then move, too.  A pass over the text counts the classes on
   either side of each of them; owner tasks take ranges of words, by hash, and
   move each to the class that raises the likelihood most, to the first order: a
   rare word hardly changes the counts that it is measured by.
3. A pass counts the bigrams of the classes as they then are.

The classes of the other words are an array by a hash of the word that grows
with the vocabulary (two to four places a word, up to ``MOST_PLACES``; words of
one place move together).  Only words that training never showed have their
class by their ending alone.  Counts of the ``head`` most frequent words travel
with the tasks; the counts of all others are joined in.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import LOWER

#: Words whose bigram counts, a matrix, come to the driver; the exchange among them lays out the classes.
FREQUENT = 1000
#: Classes that they start from.
CLASSES = 48
#: Classes by ending, where the other words start.
ENDINGS = 32
#: Words whose counts travel with the tasks, at most, and the longest of them in bytes.
HEAD, HEAD_BYTES = 300_000, 64
#: Passes of the exchange among the frequent words.
ROUNDS = 6
#: Passes in which all other words move.
SWEEPS = 1
#: Weight of the class unigrams in the class transitions, as so many tokens.
BACKING = 5.0
#: Places of the array of classes, at most (a byte each), and in a block of it.
MOST_PLACES, PLACES = 1 << 25, 1 << 16
#: A place where no training word is.
EMPTY = 255
#: Context counts that are worked on at once.
COUNTS = 20_000


def words_of(text: bytes) -> list[bytes]:
    """Words of a text with A-Z lower-cased, then the end, which is the empty string."""
    out = text.translate(LOWER).split()
    out.append(b"")
    return out


def ending(word: bytes) -> int:
    """The ending class of a word."""
    return zlib.crc32(word[-2:]) % ENDINGS


class Tokens:
    """The tokens of a slice of texts (strings): ``words``, the distinct ones; ``code``, of each token; ``lens``, of each text.

    The last of the distinct words is the end, which closes each text.
    """

    def __init__(self, texts: pa.Array):
        lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
        flat, lens = lists.flatten(), np.asarray(lists.value_lengths()).astype(np.int64)
        full = np.asarray(pc.binary_length(flat)) > 0
        if not full.all():
            lens = np.bincount(np.repeat(np.arange(len(lens)), lens)[full], minlength=len(lens))
            flat = flat.filter(pa.array(full))
        coded = flat.dictionary_encode()
        self.dictionary = pa.concat_arrays([coded.dictionary.cast(pa.binary()), pa.array([b""], pa.binary())])
        self.end = len(coded.dictionary)
        self.code = np.insert(np.asarray(coded.indices), np.cumsum(lens), self.end)
        self.lens = lens + 1

    @property
    def words(self) -> list[bytes]:
        return self.dictionary.to_pylist()


def _texts(docs: DataFrame, *columns) -> DataFrame:
    return docs.select(*columns, F.coalesce(F.col("text"), F.lit("")).alias("t"))


def word_counts(train: DataFrame) -> DataFrame:
    """(word binary, c): counts over all texts, combined per slice and again before the shuffle."""

    def run(batch):
        tokens = Tokens(batch.column("t"))
        return pa.record_batch([tokens.dictionary, pa.array(np.bincount(tokens.code, minlength=tokens.end + 1))], ["word", "c"])

    return common.map_slices(_texts(train), run, "word binary, c long", "t", 16 << 20).groupBy("word").agg(F.sum("c").alias("c"))


def most_frequent(counts: DataFrame, most: int) -> DataFrame:
    """The words above the least count that leaves at most ``most`` of them; no sort, and ties stay together."""
    short = counts.filter(F.length("word") <= HEAD_BYTES)
    histogram = sorted(short.groupBy("c").agg(F.count("*").alias("n")).collect(), key=lambda r: -r["c"])  # one row per distinct count
    total, least = 0, None
    for r in histogram:
        if total + r["n"] > most:
            break
        total, least = total + r["n"], r["c"]
    return short.filter(F.lit(False) if least is None else F.col("c") >= least)


def _grid(train: DataFrame, number, size: int) -> np.ndarray:
    """Counts of neighbouring units over all training text, the text's end before its first word: size**2 cells.

    ``number``: distinct words -> their units.
    """

    def run(batch):
        tokens = Tokens(batch.column("t"))
        unit = number(tokens.words)
        u = np.concatenate([unit[-1:], unit[tokens.code]])
        key, c = np.unique(u[:-1] * size + u[1:], return_counts=True)
        return pa.record_batch([pa.array(key), pa.array(c)], ["k", "c"])

    table = common.map_slices(_texts(train), run, "k long, c long", "t").groupBy("k").agg(F.sum("c").alias("c")).toArrow()
    out = np.zeros(size * size)
    out[np.asarray(table["k"])] = np.asarray(table["c"])
    return out.reshape(size, size)


def bigrams(train: DataFrame, clustered: list[bytes]) -> np.ndarray:
    """The bigram counts of the clustered words and, beyond them, the ending classes."""
    units = {w: i for i, w in enumerate(clustered)}
    base = len(clustered)

    def number(words):
        return np.fromiter((base + ending(w) if (u := units.get(w)) is None else u for w in words), np.int64, len(words))

    return _grid(train, number, base + ENDINGS)


def _f(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def exchange(matrix: np.ndarray, movable: np.ndarray, classes: int = CLASSES, rounds: int = ROUNDS) -> np.ndarray:
    """The class of every unit: ``movable`` units share ``classes`` classes, each other unit has its own.

    Units in the order of frequency move to the class with the greatest class
    bigram likelihood, until a round moves none or ``rounds`` are over.
    """
    n = len(matrix)
    free = np.flatnonzero(movable)
    fixed = np.flatnonzero(~movable)
    classes = max(1, min(classes, len(free)))
    of = np.zeros(n, np.int64)
    free = free[np.argsort(-matrix[free].sum(axis=1), kind="stable")]
    of[free] = np.arange(len(free)) % classes
    of[fixed] = classes + np.arange(len(fixed))
    total = classes + len(fixed)
    onehot = np.zeros((n, total))
    onehot[np.arange(n), of] = 1
    grid = onehot.T @ matrix @ onehot
    for _ in range(rounds):
        moved = 0
        for u in free:
            out, into, own = matrix[u] @ onehot, matrix[:, u] @ onehot, matrix[u, u]
            old = of[u]
            out[old] -= own  # bigrams of the unit with itself are counted apart
            into[old] -= own
            grid[old] -= out
            grid[:, old] -= into
            grid[old, old] -= own
            k = np.arange(classes)
            rows, cols = grid[:classes], grid[:, :classes].T
            gain = (_f(rows + out) - _f(rows)).sum(axis=1) + (_f(cols + into) - _f(cols)).sum(axis=1)
            here = grid[k, k]
            gain += _f(here + out[k] + into[k] + own) - _f(here) - (_f(here + out[k]) - _f(here)) - (_f(here + into[k]) - _f(here))
            # Whatever the target, each class regains its bigrams with the unit; the target also takes the unit's own.
            left, right = grid.sum(axis=1)[:classes] + into[:classes], grid.sum(axis=0)[:classes] + out[:classes]
            gain -= _f(left + out.sum() + own) - _f(left) + _f(right + into.sum() + own) - _f(right)
            new = int(gain.argmax())
            grid[new] += out
            grid[:, new] += into
            grid[new, new] += own
            if new != old:
                onehot[u, old], onehot[u, new], of[u] = 0, 1, new
                moved += 1
        if not moved:
            break
    return of


class Classes:
    """The class of every word: ``clustered`` by name, all others by the place of their hash, unseen ones by their ending."""

    def __init__(self, clustered: dict[bytes, int], by_ending: np.ndarray, places: np.ndarray):
        self.clustered, self.by_ending, self.places = clustered, by_ending, places
        self.count = 1 + int(max(max(clustered.values()), by_ending.max()))
        self.end = clustered[b""]

    def place(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(zlib.crc32, words), np.int64, len(words)) & (len(self.places) - 1)

    def of(self, words: list[bytes]) -> np.ndarray:
        named = np.fromiter((self.clustered.get(w, -1) for w in words), np.int64, len(words))
        out = self.places[self.place(words)].astype(np.int64)
        for i in np.flatnonzero((out == EMPTY) & (named < 0)).tolist():
            out[i] = self.by_ending[ending(words[i])]
        return np.where(named >= 0, named, out)


def contexts(train: DataFrame, classes: Classes) -> DataFrame:
    """(k, c): how often the words of a place stand after a class (k = place * 2n + class) and before one (+ n)."""
    shared = train.sparkSession.sparkContext.broadcast(classes)  # `frequent` words and MOST_PLACES bytes at most
    n = classes.count

    def run(batch):
        own, tokens = shared.value, Tokens(batch.column("t"))
        words = tokens.words
        cls, place = own.of(words), own.place(words)
        free = ~np.fromiter(map(own.clustered.__contains__, words), bool, len(words))
        c = np.concatenate([[own.end], cls[tokens.code]])
        at = np.flatnonzero(free[tokens.code])
        base = place[tokens.code[at]] * (2 * n)
        key, count = np.unique(np.concatenate([base + c[at], base + n + c[at + 2]]), return_counts=True)  # an end follows every word
        return pa.record_batch([pa.array(key), pa.array(count.astype(np.int32))], ["k", "c"])

    return common.map_slices(_texts(train), run, "k long, c int", "t")


def affinities(grid: np.ndarray) -> np.ndarray:
    """(2n, n): what a neighbour adds to the likelihood of a class, first the classes before, then those after."""
    smooth = grid + BACKING * np.outer(grid.sum(axis=1) + 1, grid.sum(axis=0) + 1) / (grid.sum() + len(grid)) / (BACKING + grid.sum(axis=1, keepdims=True))
    before = np.log(smooth) - np.log(smooth.sum(axis=0, keepdims=True))
    after = (np.log(smooth) - np.log(smooth.sum(axis=1, keepdims=True))).T
    return np.concatenate([before, after])


def _moved(weights: np.ndarray, n: int):
    """Sorted context counts -> (block, bytes of its places); only the last place's counts wait for the next batch."""

    def choose(block, places, counts):
        return places - block * PLACES, (counts @ weights).argmax(axis=1).astype(np.uint8)

    def run(batches):
        block, held, out = -1, [], np.full(PLACES, EMPTY, np.uint8)
        waiting, row = -1, np.zeros(2 * n, np.float32)

        def work(last: bool):
            nonlocal block, out, waiting, row
            k = np.concatenate([x for x, _ in held]) if held else np.zeros(0, np.int64)
            c = np.concatenate([x for _, x in held]) if held else np.zeros(0, np.int32)
            held.clear()
            place, column = k // (2 * n), k % (2 * n)
            names, at = np.unique(np.append(place, waiting) if waiting >= 0 else place, return_inverse=True)
            if not len(names):
                return
            counts = np.bincount(at[: len(place)] * 2 * n + column, weights=c, minlength=len(names) * 2 * n).astype(np.float32).reshape(-1, 2 * n)
            if waiting >= 0:
                counts[at[-1]] += row
            if not last:
                waiting, row = int(names[-1]), counts[-1].copy()
                names, counts = names[:-1], counts[:-1]
            for b in np.unique(names // PLACES).tolist():
                if b != block:
                    if block >= 0:
                        yield pa.record_batch([pa.array([block], pa.int64()), pa.array([out.tobytes()], pa.binary())], ["block", "classes"])
                    block, out = b, np.full(PLACES, EMPTY, np.uint8)
                mine = names // PLACES == b
                places, picked = choose(b, names[mine], counts[mine])
                out[places] = picked
            if last and block >= 0:
                yield pa.record_batch([pa.array([block], pa.int64()), pa.array([out.tobytes()], pa.binary())], ["block", "classes"])

        for batch in batches:
            if batch.num_rows:
                held.append((np.asarray(batch.column("k")), np.asarray(batch.column("c"))))
            if sum(len(x) for x, _ in held) >= COUNTS:
                yield from work(False)
        yield from work(True)

    return run


def moved(train: DataFrame, classes: Classes, grid: np.ndarray) -> Classes:
    """``classes`` after every word that is not clustered has moved to its best class (the end's class takes none)."""
    n = classes.count
    weights = affinities(grid).astype(np.float32)
    weights[:, classes.end] = -1e6  # far below any other, yet finite: a count of zero times it is zero
    counted = contexts(train, classes).withColumn("block", F.floor(F.col("k") / F.lit(2 * n * PLACES)))
    sorted_ = counted.repartition("block").sortWithinPartitions("k").select("k", "c")
    table = sorted_.mapInArrow(_moved(weights, n), "block long, classes binary").toArrow()  # a byte per place
    places = np.full(len(classes.places), EMPTY, np.uint8)
    for block, own in zip(table["block"].to_pylist(), table["classes"].to_pylist()):
        places[block * PLACES : (block + 1) * PLACES] = np.frombuffer(own, np.uint8)[: len(places)]
    return Classes(classes.clustered, classes.by_ending, places)


class Model:
    """Head words with their counts, the classes of all words, class transitions and the normalisers of the emissions."""

    def __init__(self, head: dict[bytes, int], log_c: np.ndarray, classes: Classes, transition: np.ndarray, norm: np.ndarray, tokens: int, types: int):
        self.head, self.log_c, self.classes = head, log_c, classes
        self.transition, self.norm, self.tokens, self.types = transition, norm, tokens, types


def fit(train: DataFrame, folder: str, frequent: int = FREQUENT, classes: int = CLASSES, head: int = HEAD, sweeps: int = SWEEPS) -> tuple[Model, DataFrame]:
    """The model and the table of all counts (word, c), which scoring joins."""
    if classes + ENDINGS + 1 > EMPTY:
        raise ValueError(f"at most {EMPTY - ENDINGS - 1} classes")
    counts = common.stored(word_counts(train), folder, "counts")
    tokens, types = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    top = sorted(((bytes(r["word"]), r["c"]) for r in most_frequent(counts, head).collect()), key=lambda x: (-x[1], x[0]))
    clustered = [w for w, _ in top[:frequent] if w]
    clustered.append(b"")  # the end is a unit of its own wherever its count stands
    matrix = bigrams(train, clustered)
    movable = np.arange(len(matrix)) < len(clustered) - 1
    of = exchange(matrix, movable, classes) if movable.any() else np.arange(len(matrix))
    n = int(of.max()) + 1
    grid = np.zeros((n, n))
    np.add.at(grid, (of[:, None], of[None, :]), matrix)
    size = min(MOST_PLACES, max(PLACES, 1 << (2 * int(types)).bit_length()))
    found = Classes(dict(zip(clustered, of.tolist())), of[len(clustered) :], np.full(size, EMPTY, np.uint8))
    context = train.sparkSession.sparkContext
    for _ in range(sweeps if tokens else 0):
        found = moved(train, found, grid)
        shared = context.broadcast(found)
        grid = _grid(train, lambda words, shared=shared: shared.value.of(words), n)
    shared = context.broadcast(found)

    def totals(batch):
        cls, c = shared.value.of(batch.column("word").to_pylist()), np.asarray(batch.column("c"))
        return pa.record_batch([pa.array(np.arange(n)), pa.array(np.bincount(cls, weights=c, minlength=n).astype(np.int64)), pa.array(np.bincount(cls, minlength=n))], ["k", "n", "v"])

    n_k, v_k = np.zeros(n), np.zeros(n)  # token and type totals of each class
    for r in common.map_slices(counts, totals, "k long, n long, v long", "word").groupBy("k").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect():
        n_k[r["k"]], v_k[r["k"]] = r["n"], r["v"]
    norm = np.log10(n_k + 0.5 * (v_k + 1))  # the unknown type is counted once
    unigram = (grid.sum(axis=0) + 0.5) / (grid.sum() + 0.5 * n)
    transition = np.log10((grid + BACKING * unigram[None, :]) / (grid.sum(axis=1, keepdims=True) + BACKING))
    words = {w: i for i, (w, _) in enumerate(top)}
    log_c = np.log10(np.array([c for _, c in top], float) + 0.5)
    if b"" not in words:  # its count is in the tail, or there is no training text
        c = counts.filter(F.col("word") == F.lit(b"")).select("c").first()
        words[b""] = len(top)
        log_c = np.append(log_c, np.log10((c[0] if c else 0) + 0.5))
    return Model(words, log_c, found, transition, norm, int(tokens), int(types)), counts


def local_scores(docs: DataFrame, model: Model) -> DataFrame:
    """What a document gives without the tail's counts: (doc_id, n_tokens, known, log_c, rest, tail).

    ``log_c``: sum of log10(c + 0.5) over head words; ``rest``: class
    transitions less the emissions' normalisers; ``tail``: the other words.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # HEAD words of HEAD_BYTES and MOST_PLACES bytes at most

    def run(batch):
        m, tokens = shared.value, Tokens(batch.column("t"))
        words = tokens.words
        number = np.fromiter((m.head.get(w, -1) for w in words), np.int64, len(words))
        known = (number >= 0) & bool(m.tokens)
        log_c = np.where(number >= 0, m.log_c[np.maximum(number, 0)], 0.0)
        cls = m.classes.of(words)[tokens.code]
        starts = np.cumsum(tokens.lens) - tokens.lens
        before = np.concatenate([[m.classes.end], cls[:-1]])
        sums = [np.add.reduceat(x, starts) for x in (known[tokens.code].astype(np.int64), log_c[tokens.code], m.transition[before, cls] - m.norm[cls])]
        tail = np.flatnonzero(number[tokens.code] < 0)
        offsets = np.searchsorted(tail, np.append(starts, len(cls)))
        rare = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), tokens.dictionary.take(pa.array(tokens.code[tail])))
        return pa.record_batch([batch.column("doc_id"), pa.array(tokens.lens), *map(pa.array, sums), rare], ["doc_id", "n_tokens", "known", "log_c", "rest", "tail"])

    rows = _texts(docs, F.col("doc_id").cast("long").alias("doc_id"))
    return common.map_slices(rows, run, "doc_id long, n_tokens long, known long, log_c double, rest double, tail array<binary>", "t")


def score(docs: DataFrame, train: DataFrame, frequent: int = FREQUENT, classes: int = CLASSES, head: int = HEAD, sweeps: int = SWEEPS) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score, perplexity): one row per row of ``docs``.

    ``base_score`` is the add-half unigram log10 probability, ``score`` the
    class model's.  Null text counts as empty and has the end alone.  Rows that
    repeat a doc_id are scored each.  Texts and words of any length count whole;
    other columns are ignored, whatever their names.  Without training text both
    scores come from the smoothing alone; an empty table gives an empty result.
    """
    folder = common.shared_dir(docs.sparkSession)
    model, counts = fit(train, folder, frequent, classes, head, sweeps)
    rows = common.stored(local_scores(docs, model).withColumn("row", F.monotonically_increasing_id()), folder, "local")
    tail = rows.select("row", F.explode("tail").alias("word")).join(counts, "word", "left")
    tail = tail.groupBy("row").agg(F.count("c").alias("t_known"), F.sum(F.log10(F.coalesce("c", F.lit(0)) + F.lit(0.5))).alias("t_log"))
    log_c = F.col("log_c") + F.coalesce("t_log", F.lit(0.0))
    base = float(np.log10(model.tokens + 0.5 * (model.types + 1)))
    return rows.drop("tail").join(tail, "row", "left").select(
        "doc_id", "n_tokens", (F.col("known") + F.coalesce("t_known", F.lit(0))).alias("n_known"), F.lit(model.tokens).cast("long").alias("train_tokens"),
        (log_c - F.col("n_tokens") * F.lit(base)).alias("base_score"), (log_c + F.col("rest")).alias("score"),
        F.pow(F.lit(10.0), -(log_c + F.col("rest")) / F.col("n_tokens")).alias("perplexity"))
