"""SimHash near-duplicates with pigeonring filtering.

A 64-bit fingerprint is cut into a ring of five segments.  Two fingerprints at
Hamming distance d <= 4 must have a start segment from which every chain of
l = 1..5 consecutive segments differs in at most floor(4 l / 5) bits (the
pigeonring principle).  Keys come from these chains: the first segment has no
difference, and of the ``parts`` that the rest of a chain of l segments is cut
into, at most floor(4 l / 5) differ, so the pair shares one of the keys of the
first segment's bits and the bits of the other parts.  ``LADDER`` lists chains
and parts; the more fingerprints there are, the longer the key that is taken,
so a key's share of the table stays small.  The longer chains prune the
candidates, and the full Hamming check decides.

Only distinct fingerprints are paired.  Where more than ``HOT`` share a key, they
are compared at once, chain by chain, and give a spanning forest of links instead
of the pairs; where more than ``BLOCK`` share it, they go down the ladder to the
longer keys of their start segment.  Nothing is capped, and a large group of near
copies does not return the square of its size.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .common import LOWER

#: Segment offsets and widths of the ring.
SEGMENTS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
#: Bits by which linked fingerprints may differ.
DISTANCE = 4
#: Chains and the parts that all but their first segment are cut into; keys of 26, 32 and 38 bits.
LADDER = ((3, 4), (4, 6), (5, 8))
#: Bits by which keys are longer than it takes to tell the fingerprints apart: chance then pairs fewer than there are.
SPARE = 4
#: Keys that more distinct fingerprints share give a spanning forest.
HOT = 16
#: Fingerprints that are compared at once; keys that more share go down the ladder.
BLOCK = 4096


def fingerprint(words: list[bytes], width: int = 4) -> int:
    """The SimHash of a word list: bit i is set where over half of the shingles' hashes have it."""
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(joined, 42)
    lens = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lens + 1) - 1
    starts = ends - lens
    return of_hashes(np.fromiter(
        (xxhash.xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts[: 1 - width].tolist(), ends[width - 1 :].tolist())),
        np.uint64, len(words) - width + 1,
    ))


def of_hashes(hashes: np.ndarray) -> int:
    """The SimHash of shingle hashes."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """(doc_id, fp long): one row per row of ``docs``; null text counts as empty and has fingerprint zero."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = [fingerprint(t.translate(LOWER).split(), width) for t in batch.column("t").to_pylist()]
        return pa.record_batch([batch.column("doc_id"), pa.array(np.array(fps, np.uint64).view(np.int64))], ["doc_id", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_bytes().alias("t"))
    return common.map_slices(rows, run, "doc_id long, fp long", "t")


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def _bits(ring, start: int, links: int) -> list[int]:
    """The bits of a chain, segment by segment."""
    return [at + b for j in range(links) for at, width in [ring[(start + j) % len(ring)]] for b in range(width)]


def masks(start: int, links: int, parts: int) -> list[int]:
    """The keys' bits of a start segment on a rung of the ladder."""
    bits = _bits(SEGMENTS, start, links)
    first, rest = bits[: SEGMENTS[start][1]], bits[SEGMENTS[start][1] :]
    cuts = [rest[len(rest) * p // parts : len(rest) * (p + 1) // parts] for p in range(parts)]
    equal = parts - DISTANCE * links // len(SEGMENTS)
    return [_signed(sum(1 << b for b in itertools.chain(first, *picked))) for picked in itertools.combinations(cuts, equal)]


def rung(n: int) -> int:
    """The first rung whose keys are long enough for ``n`` even fingerprints."""
    need = math.log2(max(1, n)) + SPARE
    fits = (i for i, rung_ in enumerate(LADDER) if min((m & 0xFFFFFFFFFFFFFFFF).bit_count() for m in masks(0, *rung_)) >= need)
    return next(fits, len(LADDER) - 1)


def chain_masks(ring, start: int) -> list[int]:
    """The bits of each chain of two and more segments."""
    return [_signed(sum(1 << b for b in _bits(ring, start, links))) for links in range(2, len(ring) + 1)]


def chains_hold(x: Column, start: Column) -> Column:
    """The pigeonring test of a difference ``x``: cumulative differences of each chain from ``start`` stay in budget."""
    by_start = [chain_masks(SEGMENTS, s) for s in range(len(SEGMENTS))]
    ok = F.lit(True)
    for links in range(2, len(SEGMENTS) + 1):
        mask = F.element_at(F.array(*[F.lit(m[links - 2]) for m in by_start]), start + 1)
        ok = ok & (F.bit_count(x.bitwiseAND(mask)) <= DISTANCE * links // len(SEGMENTS))
    return ok


def block_links(left: np.ndarray, right: np.ndarray, start: int, step: int = 256) -> list[tuple[int, int]]:
    """A spanning forest of the links between two arrays of fingerprints: chain by chain from ``start``, then the full check."""
    tests = [(np.uint64(m & 0xFFFFFFFFFFFFFFFF), DISTANCE * (i + 2) // len(SEGMENTS)) for i, m in enumerate(chain_masks(SEGMENTS, start))]
    root: dict[int, int] = {}

    def find(v: int) -> int:
        while (up := root.get(v, v)) != v:
            root[v] = up = root.get(up, up)
            v = up
        return v

    out, right_bits = [], right.view(np.uint64)
    for at in range(0, len(left), step):
        part = left[at : at + step]
        x = part.view(np.uint64)[:, None] ^ right_bits[None, :]
        i, j = np.nonzero(np.bitwise_count(x & tests[0][0]) <= tests[0][1])
        x = x[i, j]
        for mask, budget in tests[1:]:  # the last chain is the whole fingerprint
            ok = np.bitwise_count(x & mask) <= budget
            i, j, x = i[ok], j[ok], x[ok]
        for a, b in zip(part[i].tolist(), right[j].tolist()):
            if (ra := find(a)) != (rb := find(b)):
                root[ra] = rb
                out.append((a, b))
    return out


def _links_of_blocks(table: pa.Table) -> pa.Table:
    """Links within one block or between two; the input is one group of a key and two block numbers."""
    fps, block = table["fp"].to_numpy(), table["block"].to_numpy()
    left, right = (fps[block == table[c][0].as_py()] for c in ("i", "j"))
    pairs = np.array(block_links(left, right, table["start"][0].as_py()), np.int64).reshape(-1, 2)
    return pa.table({"a": pairs.min(axis=1), "b": pairs.max(axis=1)})


def _keyed(rows: DataFrame, level: int) -> DataFrame:
    """(fp, start, mask, value, n) of the keys that several of ``rows(fp, start)`` share on a rung; ``n``: how many."""
    of = F.array(*[F.array(*[F.lit(m) for m in masks(s, *LADDER[level])]) for s in range(len(SEGMENTS))])
    keys = rows.withColumn("mask", F.explode(F.element_at(of, F.col("start") + 1))).withColumn("value", F.col("fp").bitwiseAND(F.col("mask")))
    return keys.withColumn("n", F.count("*").over(Window.partitionBy("start", "mask", "value"))).filter("n > 1")


def _pairs(keyed: DataFrame) -> DataFrame:
    """Links within keys that few share: each fingerprint tests those after it in the key's list, so only links become rows."""
    lists = keyed.groupBy("start", "mask", "value").agg(F.array_sort(F.collect_list("fp")).alias("fps"))
    sides = lists.select("start", "fps", F.posexplode("fps").alias("i", "a"))
    linked = F.filter(F.expr("slice(fps, i + 2, size(fps))"), lambda b: chains_hold(F.col("a").bitwiseXOR(b), F.col("start")))
    return sides.select("a", F.explode(linked).alias("b"))


def _forest(keyed: DataFrame, block: int) -> DataFrame:
    """Links within keys that many share, block against block, as spanning forests."""
    dealt = (
        keyed.withColumn("m", F.ceil(F.col("n") / F.lit(block)).cast("int"))
        .withColumn("block", F.pmod(F.xxhash64("fp"), F.col("m")).cast("int"))
        .withColumn("other", F.explode(F.expr("sequence(0, m - 1)")))
        .select("start", "mask", "value", "fp", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    )
    return dealt.groupBy("start", "mask", "value", "i", "j").applyInArrow(_links_of_blocks, "a long, b long").filter("a < b")


def links(distinct: DataFrame, folder: str, hot: int = HOT, block: int = BLOCK) -> DataFrame:
    """(a, b) with a < b, some more than once: links between distinct fingerprints ``distinct(fp)``.

    Complete up to reachability: within keys that over ``hot`` fingerprints
    share, a spanning forest stands for the pairs.
    """
    level = rung(distinct.count())
    rows, found = distinct.select("fp", F.explode(F.sequence(F.lit(0), F.lit(len(SEGMENTS) - 1))).alias("start")), []
    while True:
        keyed = common.stored(_keyed(rows, level), folder, f"keyed_{level}")
        found += [_pairs(keyed.filter(F.col("n") <= hot)), _forest(keyed.filter((F.col("n") > hot) & (F.col("n") <= block)), block)]
        large = keyed.filter(F.col("n") > F.lit(max(hot, block)))
        if large.isEmpty():
            break
        level += 1
        if level == len(LADDER):
            found.append(_forest(large, block))
            break
        rows = large.select("fp", "start").distinct()
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def near_duplicates(docs: DataFrame, width: int = 4, hot: int = HOT, block: int = BLOCK) -> DataFrame:
    """(doc_id, fingerprint, component_id): one row per row of ``docs``.

    ``component_id`` is the smallest doc_id reachable over links, its own
    included.  Empty and null texts
    have fingerprint zero and link like any other; rows that repeat a doc_id
    are kept; a null doc_id never becomes a component's id unless no other is
    there.  Texts of any length are hashed whole.  Other columns are ignored,
    whatever their names; an empty table gives an empty result.
    """
    folder = common.shared_dir(docs.sparkSession)
    fps = common.stored(fingerprints(docs, width), folder, "fps")
    reps = common.stored(fps.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), folder, "reps")
    edges = links(reps.select("fp"), folder, hot, block)
    roots = common.connected_components(edges, folder)
    linked = roots.join(reps, roots.v == reps.fp).select("v", "root", "first")
    ids = linked.groupBy("root").agg(F.min("first").alias("component"))
    of_linked = linked.join(ids, "root").select("v", "component")
    # Fingerprints of one row need no join: their component is the row itself.
    classes = reps.join(of_linked, reps.fp == of_linked.v, "left").filter("n > 1 or v is not null").select(
        F.col("fp").alias("c_fp"), F.coalesce("component", "first").alias("component"))
    return fps.join(classes, fps.fp == classes.c_fp, "left").select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.coalesce("component", "doc_id").alias("component_id"),
    )


# --- near copies by the similarity of their shingle sets ---

#: Words of a shingle, and the least Jaccard similarity of near copies, as a ratio.
WIDTH, LEAST = 5, (4, 5)
#: Minhash keys of a document and minima in a key.
BANDS, ROWS = 24, 4
#: The ring and the radius that prune candidates: sets at the least similarity differ in about 10 bits.
WIDE = tuple((8 * i, 8) for i in range(8))
RADIUS = 26
#: Rows that share a key before its pairs with the rows' other keys are starred too.
LARGE = 4096
#: Rows and bytes of shingle sets in a block.
SETS, SET_BYTES = 512, 8 << 20

_RANDOM = np.random.Generator(np.random.PCG64(42))
_XOR = _RANDOM.integers(0, 1 << 63, BANDS * ROWS, np.uint64)[:, None]
_TIMES = _RANDOM.integers(0, 1 << 63, BANDS * ROWS, np.uint64)[:, None] | np.uint64(1)


def shingles(text: bytes, width: int = WIDTH) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles; a text of at most ``width`` words is one shingle."""
    words = text.translate(LOWER).split()
    joined = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
    lens = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lens + 1) - 1
    starts = ends - lens
    hashes = (xxhash.xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts[: 1 - width].tolist(), ends[width - 1 :].tolist()))
    return np.unique(np.fromiter(hashes, np.uint64, len(words) - width + 1))


def bands(hashes: np.ndarray) -> list[int]:
    """The keys of a shingle set."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 2048):
        np.minimum(least, ((hashes[None, at : at + 2048] ^ _XOR) * _TIMES).min(axis=1), out=least)
    data, step = least.tobytes(), 8 * ROWS
    return [xxhash.xxh64_intdigest(data[b * step : (b + 1) * step], b) for b in range(BANDS)]


def _similar(shared, a, b):
    """Whether sets of ``a`` and ``b`` elements that share ``shared`` are similar enough."""
    return LEAST[1] * shared >= LEAST[0] * (a + b - shared)


def _some_chain_holds(x: Column) -> Column:
    """The pigeonring test over the wide ring: from some start all chains stay in budget.  No pair within RADIUS fails."""
    found = F.lit(False)
    for start in range(len(WIDE)):
        ok = F.bit_count(x.bitwiseAND(F.lit(_signed(sum(1 << b for b in _bits(WIDE, start, 1)))))) <= RADIUS // len(WIDE)
        for i, mask in enumerate(chain_masks(WIDE, start)):
            ok = ok & (F.bit_count(x.bitwiseAND(F.lit(mask))) <= RADIUS * (i + 2) // len(WIDE))
        found = found | ok
    return found


def _sized_alike(a: str, b: str) -> Column:
    """Sizes that the least similarity allows."""
    return LEAST[1] * F.least(a, b) >= LEAST[0] * F.greatest(a, b)


def _signatures(rows: DataFrame) -> DataFrame:
    """(row, fp, size, keys) of (row, text): fingerprint and size of the shingle set, and its keys."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingles(t) for t in batch.column("t").to_pylist()]
        fps = np.array([of_hashes(s) for s in sets], np.uint64).view(np.int64)
        keys = np.array([bands(s) for s in sets], np.uint64).reshape(-1).view(np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(keys) + 1, BANDS, dtype=np.int32)), pa.array(keys))
        return pa.record_batch([batch.column("row"), pa.array(fps), pa.array([len(s) for s in sets], pa.int32()), lists], ["row", "fp", "size", "keys"])

    return common.map_slices(rows.select("row", common.text_bytes().alias("t")), run, "row long, fp long, size int, keys array<long>", "t")


def _sets(rows: DataFrame) -> DataFrame:
    """(row, s) of (row, text): the shingle set."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingles(t).tobytes() for t in batch.column("t").to_pylist()]
        return pa.record_batch([batch.column("row"), pa.array(sets, pa.binary())], ["row", "s"])

    return common.map_slices(rows.select("row", common.text_bytes().alias("t")), run, "row long, s binary", "t")


def _linked(pairs: DataFrame) -> DataFrame:
    """The pairs (a, b, sa, sb) whose sets are similar enough."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ok = []
        for x, y in zip(batch.column("sa"), batch.column("sb")):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            ok.append(_similar(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y)))
        return batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return common.map_slices(pairs, run, "a long, b long", "sa")


def _in_chains(x: np.ndarray) -> np.ndarray:
    """``_some_chain_holds`` over an array."""
    found = np.zeros(len(x), bool)
    for start in range(len(WIDE)):
        alive = np.flatnonzero(~found)
        for i, mask in enumerate([sum(1 << b for b in _bits(WIDE, start, 1)), *chain_masks(WIDE, start)]):
            alive = alive[np.bitwise_count(x[alive] & np.uint64(mask & 0xFFFFFFFFFFFFFFFF)) <= RADIUS * (i + 1) // len(WIDE)]
        found[alive] = True
    return found


def _set_links(table: pa.Table) -> pa.Table:
    """Links between rows of different components in one block or two; the input is one group of a key and two block numbers."""
    block, row, component, fp, size = (table[c].to_numpy() for c in ("block", "row", "component", "fp", "size"))
    left, right = (np.flatnonzero(block == table[c][0].as_py()) for c in ("i", "j"))
    out: list[tuple[int, int]] = []
    root: dict[int, int] = {}

    def find(v: int) -> int:
        while (up := root.get(v, v)) != v:
            root[v] = up = root.get(up, up)
            v = up
        return v

    if len(left) and len(right):
        sets = [np.frombuffer(s.as_buffer(), np.uint64) for s in table["s"]]
        names, ids = np.unique(np.concatenate(sets), return_inverse=True)
        starts = np.cumsum(size, dtype=np.int64) - size
        flat = np.concatenate([ids[starts[r] : starts[r] + size[r]] for r in right])
        at = np.cumsum(size[right], dtype=np.int64) - size[right]
        marked = np.zeros(len(names), np.int32)
        for x in left:
            near = (component[right] != component[x]) & (LEAST[1] * np.minimum(size[right], size[x]) >= LEAST[0] * np.maximum(size[right], size[x]))
            near[near] = _in_chains((fp[right[near]] ^ fp[x]).view(np.uint64))
            if not near.any():
                continue
            own = ids[starts[x] : starts[x] + size[x]]
            marked[own] = 1
            shared = np.add.reduceat(marked[flat], at)  # one pass over the block for all of them
            marked[own] = 0
            for y in right[near & _similar(shared.astype(np.int64), int(size[x]), size[right])]:
                if (a := find(int(component[x]))) != (b := find(int(component[y]))):
                    root[a] = b
                    out.append((int(row[x]), int(row[y])))
    pairs = np.array(out, np.int64).reshape(-1, 2)
    return pa.table({"a": pairs.min(axis=1), "b": pairs.max(axis=1)})


def _together(keyed: DataFrame) -> DataFrame:
    """Adds ``n``, the rows of a key, and ``first``, one of them; keys of one row go."""
    of_key = Window.partitionBy("key")
    return keyed.withColumn("n", F.count("*").over(of_key)).withColumn("first", F.min(F.struct("row", "fp", "size")).over(of_key)).filter("n > 1")


def _dealt(mixed: DataFrame, sets: DataFrame, folder: str, block: int) -> DataFrame:
    """Rows (key, row, component, fp, size, s) once for each two blocks (i, j) of their key that may hold a link, with their own ``block``.

    Blocks follow the larger components, then sizes.  Two blocks of one
    component have nothing to link, nor have two whose sizes are too far apart;
    every other two meet.
    """
    members = F.count("*").over(Window.partitionBy("key", "component"))
    place = Window.partitionBy("key").orderBy("large", "size", "row")
    before = F.coalesce(F.sum(8 * F.col("size").cast("long")).over(place.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # Each part only grows along the order, so the sum changes wherever one of them does.
    number = F.floor((F.row_number().over(place) - 1) / F.lit(block)) + F.floor(before / F.lit(SET_BYTES)) + F.dense_rank().over(Window.partitionBy("key").orderBy("large"))
    ranked = mixed.withColumn("large", F.when(members >= block, F.col("component"))).withColumn("block", number.cast("long")).drop("large")
    ranked = common.stored(ranked.select("key", "row", "component", "fp", "size", "block"), folder, "ranked")
    blocks = ranked.groupBy("key", "block").agg(F.min("component").alias("c1"), F.max("component").alias("c2"), F.min("size").alias("s1"), F.max("size").alias("s2"))
    i, j = (blocks.select("key", *[F.col(c).alias(f"{c}_{side}") for c in ("block", "c1", "c2", "s1", "s2")]) for side in "ij")
    one = (F.col("c1_i") == F.col("c2_i")) & (F.col("c1_j") == F.col("c2_j")) & (F.col("c1_i") == F.col("c1_j"))
    apart = (LEAST[1] * F.col("s2_i") < LEAST[0] * F.col("s1_j")) | (LEAST[1] * F.col("s2_j") < LEAST[0] * F.col("s1_i"))
    meet = i.join(j, "key").filter("block_i <= block_j").filter(~one & ~apart).select("key", F.col("block_i").alias("i"), F.col("block_j").alias("j"))
    sides = meet.select("key", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("block"))
    return ranked.join(sides, ["key", "block"]).join(sets, "row").select("key", "row", "component", "fp", "size", "s", "block", "i", "j")


def without_near_copies(docs: DataFrame, block: int = SETS, large: int = LARGE) -> DataFrame:
    """``docs`` with one row of each group of rows that near copies connect: that of the smallest doc_id.

    Near copies have sets of five-word shingles with a Jaccard similarity of
    0.8 or more.  Their fingerprints differ in 10 of 64 bits on average, too
    many for equal segments to find them; so keys of least shingle hashes give
    the candidates, of which a pair at 0.8 shares none with a probability of
    (1 - 0.8**4)**24, three in a million.  Pigeonring chains within a radius of
    ``RADIUS`` prune them, and the shingle sets decide every link.

    Candidates are first compared with the first row of each key; of a key that
    more than ``large`` rows share also with the first row of its pairs with each
    of the rows' other keys, so that its near copies come together.  Every key,
    large or not, whose rows are then still in several components is compared
    whole, block against block but for blocks of one component, so nothing is
    capped and a large group of near copies does not return the square of its
    size.

    A null doc_id counts as greater than any other; among rows of one doc_id an
    arbitrary one stays.  Verdicts hold for rows, so rows that share a doc_id
    do not share a verdict.  Null text counts as empty, and empty texts are
    near copies of each other.  Texts of any length count whole, all columns are
    carried whatever their names, and an empty table gives an empty result.
    """
    folder = common.shared_dir(docs.sparkSession)
    whole = common.numbered(docs, folder)
    texts = whole.select("row", "doc.text")
    signed = common.stored(_signatures(texts), folder, "signed")
    shared = common.stored(_together(signed.select("row", "fp", "size", F.explode("keys").alias("key"))), folder, "shared")
    starred, over = shared, shared.filter(F.col("n") > large)
    if not over.isEmpty():
        both = over.select("row", "fp", "size", "key").join(signed.select("row", "keys"), "row").withColumn("other", F.explode("keys")).filter("other <> key")
        longer = both.select("row", "fp", "size", F.xxhash64(F.least("key", "other"), F.greatest("key", "other")).alias("key")).distinct()
        starred = common.stored(shared.unionByName(_together(longer)), folder, "longer")

    sets = common.stored(_sets(texts.join(shared.select("row").distinct(), "row")), folder, "sets")
    sides = [sets.select(F.col("row").alias(c), F.col("s").alias(f"s{c}")) for c in "ab"]
    pairs = starred.filter("row <> first.row").select(F.col("first.row").alias("a"), F.col("first.fp").alias("fa"), F.col("first.size").alias("na"), F.col("row").alias("b"), F.col("fp").alias("fb"), F.col("size").alias("nb"))
    pairs = pairs.filter(_sized_alike("na", "nb")).filter(_some_chain_holds(F.col("fa").bitwiseXOR(F.col("fb")))).select("a", "b").distinct()
    star = common.stored(_linked(pairs.join(sides[0], "a").join(sides[1], "b")), folder, "star")
    labels = common.connected_components(star, folder, "near")

    placed = shared.select("key", "row", "fp", "size").join(labels, F.col("row") == F.col("v"), "left").select("key", "row", "fp", "size", F.coalesce("root", "row").alias("component"))
    of_key = Window.partitionBy("key")
    mixed = placed.withColumn("c1", F.min("component").over(of_key)).withColumn("c2", F.max("component").over(of_key)).filter("c1 <> c2").drop("c1", "c2")
    full = _dealt(mixed, sets, folder, block).groupBy("key", "i", "j").applyInArrow(_set_links, "a long, b long")
    linked = common.connected_components(star.union(full), folder, "all")
    ids = whole.select("row", F.col("doc.doc_id").cast("long").alias("doc_id"))
    linked = linked.join(ids, F.col("v") == F.col("row")).select("root", "row", "doc_id")
    kept = linked.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("k")).select("root", F.col("k.row").alias("stays"))
    gone = linked.join(kept, "root").filter("row <> stays").select("row")
    return whole.join(gone, "row", "left_anti").select("doc.*")
